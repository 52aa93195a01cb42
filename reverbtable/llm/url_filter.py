"""URL filters: allow and block entries in a trie over reversed host labels and path segments; the longest fits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reverbtable.llm.book import query, table

MAX_BROADCAST = 8 << 20  # bytes of entries that may go to every task; more are joined by host instead
SALTS = 16  # parts of one host's pages where entries are joined
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str     # labels, lower case; fits the host and its subdomains
    path: str     # the url's path must start with it
    verdict: str  # allow or block


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end; empty for null or no ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def build(rules: list[Rule]) -> dict:
    """Trie: host labels from the right; under the key None of a node the path trie, whose segments end in tails.

    Tails of a node are (entries by tail, lengths of the tails from the longest on), so that the longest one that a
    segment starts with takes one look per length.
    """
    root: dict = {}
    # the same host and path twice: block wins, as it comes last
    for rule in sorted(rules, key=lambda r: r.verdict == "block"):
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *segments, tail = rule.path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        tails, lengths = node.setdefault(None, ({}, []))
        tails[tail] = rule
        if len(tail) not in lengths:
            lengths.append(len(tail))
            lengths.sort(reverse=True)
    return root


def match(trie: dict, host: str, path: str) -> Rule | None:
    """The longest rule that fits; of equally long ones that with the longer host."""
    best, rank, node = None, (-1, -1), trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        inner = node.get(None)
        for segment in segments:
            if inner is None:
                break
            tails, lengths = inner.get(None, ({}, []))
            rule = next((tails[segment[:n]] for n in lengths if n <= len(segment) and segment[:n] in tails), None)
            if rule and (score := (len(rule.host) + len(rule.path), len(rule.host))) > rank:
                best, rank = rule, score
            inner = inner.get(segment)
    return best


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow",
          max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages with host, path, rule (host and path of the fitting entry, else null) and verdict (default where none).

    Columns of pages with these names are replaced. A null url or one without :// has empty host and path. rules may
    be a table (host, path, verdict); where it takes more than max_broadcast bytes it is joined, not sent out.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        if size > max_broadcast:
            return _joined(pages, rules, default)
        rules = [Rule(*r) for r in rules.select("host", "path", "verdict").distinct().collect()]
    elif sum(len(r.host) + len(r.path) + 64 for r in rules) > max_broadcast:
        raise ValueError("give this many entries as a table")
    trie = pages.sparkSession.sparkContext.broadcast(build(list(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [match(trie.value, h, p) for h, p in
                     zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            rule = pa.array([r and r.host + r.path for r in found], pa.string())
            said = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, said], [*batch.schema.names, "rule", "verdict"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{plain}, rule string, verdict string")


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equality join on every suffix of the host; for entry tables of any size.

    Each distinct (host, path) is looked up once, so repeated rows need no number of their own. The paths of a host
    meet its entries in SALTS parts, and rows find their entry by (host, path) in as many parts.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, k, F.size(labels)), "."))
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    hosts = pages.select("host", "path").distinct().select("host", "path", salt.alias("_salt"), F.explode(suffixes).alias("_host"))
    entries = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict").distinct().withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = hosts.join(entries, ["_host", "_salt"]).where(F.startswith("path", "_path"))
    size = F.length("_host") + F.length("_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), "verdict"), F.struct(
        size, F.length("_host"), F.col("verdict") == "block")).alias("_best"))
    spread = best.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int")
    found = pages.withColumn("_part", part).join(spread, ["host", "path", "_part"], "left")
    return found.select(*pages.columns, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


# fixed values
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]

_VALUES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)


@query("op7_url_filters", f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
p as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(rh, rp, verdict) as (values {_VALUES}),
fits as (select page_id, host, path, rh || rp as rule, verdict, row_number() over (
           partition by page_id order by length(rh) + length(rp) desc, length(rh) desc) as k
         from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from p left join fits f on f.page_id = p.page_id and f.k = 1""")
def op7(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select(
        "page_id", "host", "path", "rule", "verdict")
