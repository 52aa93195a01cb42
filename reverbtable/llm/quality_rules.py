"""Quality rules: a decision list over text statistics, learned from labelled documents by sequential covering.

All statistics are column expressions of the row. The learner repeats: grow a conjunction of threshold conditions on
two thirds of the labelled rows (each step one aggregate over all conditions), prune it on the other third, keep it
if it is precise there, remove the rows it covers. A rule that fails sets aside the growing rows that it covers, so
that it does not hide other kinds of bad rows behind it. Covering ends when fewer bad rows are left to grow from than
a rule must cover. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from reverbtable.llm.book import query, table
from reverbtable.session import written

MAX_LABELLED = 20_000  # labelled rows used for fitting, drawn by the hash of their ids
CUTS = 24              # thresholds tried per feature, at quantiles of the labelled rows
MIN_COVER = 5          # rejected rows a rule must cover when pruned, and that must be left to grow another one
MIN_PRECISION = 0.95

# fixed values
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
MARKS = "!?.,;:"
WINDOW = 8

MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept", "_w", "_l",
        "_upper", "_digits", "_marks", "_n_lines", "_n_distinct", "words", "mean_word", "symbols", "upper", "digits",
        "marks", "repeats", "dup_lines", "distinct", "line_words"]
FEATURES = ["words", "mean_word", "symbols", "upper", "digits", "marks", "repeats", "dup_lines", "distinct", "line_words"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that stand twice or more in the text."""
    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    def covered(w):
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            last = F.size(s) - 1
            again = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                             | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"])))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(_let(pairs, places), start, lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["sum"] + p + WINDOW - F.greatest(p, a["end"])).alias("sum")), lambda a: a["sum"])

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    counted = _let(_let(hashed, windows), lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(counted).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the
    features of the learner (integers, shares in thousandths). Words are runs of [^\\x20\\x09-\\x0D]; null is no text.
    Columns of docs with these names are replaced, others stay; repeated rows each give a row.
    """
    docs = docs.drop(*[c for c in MADE if c in docs.columns])
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.length(_without(t, WHITE))
    flat = F.translate(t, WHITE, " " * len(WHITE))
    one = docs.select(*[c for c in docs.columns if c != text], F.filter(F.split(flat, " "), lambda w: w != "").alias("_w"),
                      F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, WHITE)) > 0).alias("_l"),
                      blank.cast("long").alias("word_chars"),
                      (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
                      *[(F.length(t) - F.length(_without(t, c))).alias(n) for n, c in
                        (("_upper", UPPER), ("_digits", DIGITS), ("_marks", MARKS))])
    two = one.select(*[c for c in one.columns if c not in ("_w", "_l")], F.size("_w").cast("long").alias("n_words"),
                     (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                     F.size("_l").alias("_n_lines"), F.size(F.array_distinct("_w")).alias("_n_distinct"),
                     _repeat_words(F.col("_w")).alias("n_repeat_words"))
    share = lambda a, b, by=1000: F.coalesce(F.expr(f"({by} * {a}) div nullif({b}, 0)"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    three = two.withColumns({
        "base_failed": failed, "words": F.col("n_words"), "mean_word": share("word_chars", "n_words", 100),
        "symbols": share("n_symbols", "word_chars"), "upper": share("_upper", "word_chars"),
        "digits": share("_digits", "word_chars"), "marks": share("_marks", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "_n_lines"),
        "distinct": share("_n_distinct", "n_words"), "line_words": share("n_words", "_n_lines", 1)})
    return three.drop("_upper", "_digits", "_marks", "_n_lines", "_n_distinct")


def learn(stats: DataFrame, bad: str = "bad") -> list[list[tuple[str, str, int]]]:
    """Ordered rules, each a conjunction of (feature, '<=' or '>', threshold), that reject rows with bad = 1.

    stats is a bounded table of labelled rows with FEATURES and doc_id. No labelled row on one side gives no rules.
    """
    cut_list = stats.agg(*[F.percentile_approx(f, [(k + 0.5) / CUTS for k in range(CUTS)], 10_000).alias(f)
                           for f in FEATURES]).first()
    if cut_list[0] is None:
        return []
    cuts = {f: sorted(set(cut_list[f])) for f in FEATURES}
    bins = F.array(*[F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: F.col(f) > c)) for f in FEATURES])
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    rows = written(stats.select(*FEATURES, F.col(bad).cast("int").alias("bad"), bins.alias("bins"), grow.alias("grow"))
                   .coalesce(2), "labelled")
    rules: list = []
    failed: list = []
    while True:
        left = rows.where(~_any(rules))
        rule = _grow(left.where(F.col("grow") & ~_any(failed)), cuts)
        if not rule:
            return rules
        kept = _prune(left.where("not grow"), rule)
        if kept:
            rules.append(kept)
        else:
            failed.append(rule)


def _grow(rows: DataFrame, cuts: dict) -> list[tuple[str, str, int]]:
    """Conditions of the largest information gain one after the other, until no good row is left or nothing gains."""
    rule: list = []
    while True:
        seen = rows.where(_all(rule)).select("bad", F.posexplode("bins").alias("f", "bin"))
        found = seen.groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        count = {}
        for r in found:
            count.setdefault(r.f, {})[r.bin] = (r.p, r.n)
        all_p = sum(p for p, _ in count.get(0, {}).values())
        all_n = sum(n for _, n in count.get(0, {}).values())
        if not all_n or (not rule and all_p < MIN_COVER):
            return rule
        best = (0.0, None)
        for f, by_bin in sorted(count.items()):
            p = n = 0
            for k, cut in enumerate(cuts[FEATURES[f]]):
                add = by_bin.get(k, (0, 0))
                p, n = p + add[0], n + add[1]
                for sign, a, b in (("<=", p, n), (">", all_p - p, all_n - n)):
                    if a:
                        gain = a * (math.log2(a / (a + b)) - math.log2(all_p / (all_p + all_n)))
                        best = max(best, (gain, (FEATURES[f], sign, cut)), key=lambda x: x[0])
        if best[1] is None or best[1] in rule:
            return rule
        rule.append(best[1])


def _prune(rows: DataFrame, rule: list) -> list:
    """The prefix of the rule, or prefix without one condition, that is worth most on held-out rows (of equal ones the
    shortest, then the first); empty unless it covers enough and is precise."""
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    tried = sorted([*prefixes, *(p[:j] + p[j + 1:] for p in prefixes for j in range(len(p) - 1))], key=len)
    got = rows.agg(*[F.coalesce(F.sum(F.when(_all(r), F.col("bad") if good else 1 - F.col("bad"))), F.lit(0))
                     for r in tried for good in (True, False)]).first()
    value = lambda k: ((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k)
    best = max(range(len(tried)), key=value)
    p, n = got[2 * best], got[2 * best + 1]
    return tried[best] if p >= MIN_COVER and p >= MIN_PRECISION * (p + n) else []


def _all(rule: list) -> Column:
    out = F.lit(True)
    for f, sign, cut in rule:
        out = out & ((F.col(f) <= cut) if sign == "<=" else (F.col(f) > cut))
    return out


def _any(rules: list) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _all(r)
    return out


def verdict(rules: list) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that fires, else 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list:
    """Learn rules from labels(doc_id, quality: 0 bad, 1 good) of docs(doc_id, text).

    Labels without id or quality are not used; several labels of an id count as bad if one is. Rows that the fixed
    base rule rejects are left out. No usable label gives an empty list, which keeps everything.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    every = max(1, math.ceil(one.count() / max_labelled))  # the hash thins the labels before they meet in one task
    some = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most max_labelled short rows
    return learn(written(statistics(found).where("not base_failed"), "statistics"))


def judge(docs: DataFrame, rules: list) -> DataFrame:
    """docs without text plus the statistics, base_failed, rule (0: none fired) and kept. One row per row of docs."""
    out = statistics(docs).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that base rule and decision list keep; all columns stay."""
    rules = fit(docs, labels)
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), "text"), rules)
    return judged.where("kept").select("_row.*")


@query("op5_quality_rules")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "rule")
