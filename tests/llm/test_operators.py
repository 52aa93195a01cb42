"""Operators on hand-made tables: brute force, nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reverbtable.llm import (decontaminate, html_text, license_scan, line_dedup, ngram_join, packing, quality_rules, sharding,
                             token_blocks, url_filter)
from reverbtable.llm.components import components
from reverbtable.llm.tokens import tokenizer_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


LONG = prose(9, 30_000)
BASE = prose(1, 60)
TEXTS = [(1, BASE), (2, BASE), (3, BASE + " extra"), (4, prose(2, 60)), (5, ""), (6, None), (7, "two words"), (8, "Two words"),
         (9, LONG), (9, LONG), (10, " \n\t "), (None, prose(3, 40)), (None, None), (11, BASE.replace(" ", "\n", 3)), (12, "é" * 50)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def check_join(got, rows):
    """rows: id to text; every class, link count and copy against all pairs."""
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links, near = Counter(), defaultdict(set)
    for i in rows:
        for j in rows:
            if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links.update((i, j))
                if sets[i] != sets[j]:
                    near[i].add(sets[j])
                    near[j].add(sets[i])
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in got:
        assert (r.class_id, r.n_links, r.n_near) == (find(r.doc_id), links[r.doc_id], len(near[r.doc_id])), r
        assert r.copy_id == (min(j for j in rows if sets[j] == sets[r.doc_id]) if sets[r.doc_id] else r.doc_id)


def test_join_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, words = {}, prose(8, 400).split()
    for k in range(60):  # copies with a few words changed, similarities on both sides of the threshold
        at = list(words[(k % 5) * 60:(k % 5) * 60 + 80])
        for i in rng.choice(80, rng.integers(0, 4), replace=False):
            at[i] = f"x{k % 7}"
        rows[k] = " ".join(at)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    check_join(ngram_join.near_duplicates(df).collect(), rows)
    # buckets and groups far over their limits split, and lose nothing
    check_join(ngram_join.near_duplicates(df, leaf=4, block=6).collect(), rows)


def test_join_on_odd_rows(odd, none):
    got = ngram_join.near_duplicates(odd.withColumnRenamed("lang", "node").withColumnRenamed("source", "unit")).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    assert by[1].class_id == by[2].class_id == by[3].class_id == by[11].class_id == 1 and by[4].class_id == 4
    assert by[7].class_id == by[8].class_id == 7 and by[8].n_near == 0 and by[8].n_links == 1
    assert by[9].n_links == 1 and by[9].n_near == 0 and by[5].n_links == by[6].n_links == by[10].n_links == 0
    assert ngram_join.near_duplicates(none).collect() == []
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10, 12]
    assert ngram_join.keep_one(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 230)] + [(300, k) for k in range(301, 340)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_statistics(spark, odd):
    rep = " ".join(f"w{k}" for k in range(9))
    texts = {1: f"{rep} x {rep} # $5 A!\n\nsame\nsame\n \nsame", 2: None, 3: "", 4: "a " * 40, 5: LONG + "\n" + LONG[:500]}
    df = spark.createDataFrame([(k, t, 1, True) for k, t in texts.items()], "doc_id long, text string, words int, kept boolean")
    for r in quality_rules.judge(df, []).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), failed, not failed)


def test_quality_rules_learn_and_keep(spark, odd, none):
    rows = [(k, prose(k, 40) if k % 3 else " ".join(x + "###" for x in prose(k, 40).split())) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(180)] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules
    for r in quality_rules.judge(docs, rules).collect():
        assert r.kept == (r.doc_id % 3 > 0) and (r.rule > 0) == (not r.kept)
    no_labels = labels.where("false")
    assert quality_rules.fit(docs, no_labels) == [] and quality_rules.fit(none, labels) == []
    assert quality_rules.keep_good(none, labels).collect() == []
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns and all(len((r.text or "").split()) >= 20 for r in kept.collect())


def test_line_dedup(spark, none):
    note = "this long boiler plate passage has well over twenty words in it so that two documents are quite enough to drop it here"
    rows = [(k, f"{prose(k, 30)}\nPosted by user{k} on day {k} of the year\n{note if k < 2 else prose(50 + k, 25)}\nIs it?\n{prose(99 + k, 12)}")
            for k in range(6)]
    rows += [(10, rows[3][1]), (11, None), (12, ""), (None, "one\nand the same line here\nand the same line here")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_lines int, template string")
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0  # the first document keeps everything
    for k in range(1, 6):
        want = [x for x in rows[k][1].split("\n") if not x.startswith("Posted") and x != note]
        assert got[k].text.split("\n") == want and got[k].template == "x" and got[k].n_lines == 5
    assert got[10].text == "Is it?\n" + rows[3][1].split("\n")[4]  # a copy: lines of three documents or of many words
    assert got[11].text is None and got[12].text == "" and got[None].n_dropped == 0
    assert line_dedup.dedup(none).count() == 0


def test_packing(spark, odd, none):
    out = packing.pack_documents(odd).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, t in TEXTS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((i, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert packing.pack_documents(none).count() == 0
    pieces = spark.createDataFrame([(1, 3, 8), (1, 3, 8)], "k int, length int, offset int")
    assert sorted(map(tuple, packing.pack(pieces, ["k"], capacity=6).collect())) == [(1, 3, 0, 0), (1, 3, 0, 3)]
    with pytest.raises(Exception, match="piece lengths"):
        packing.pack(spark.createDataFrame([(1, 9)], "k int, length int"), ["k"], capacity=6).collect()


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "hello"), (3, None)], "doc_id long, text string")
    pieces = packing.pieces_of(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)
    [row] = packing.sequences(packing.pack(pieces, ["doc_id"])).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    by = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in ((1, "a b c"), (2, "hello"), (3, ""))}
    assert row.ids == [x for i in row.doc_ids for x in by[i]] and sorted(row.doc_ids) == [1, 2, 3]


def test_token_files(spark, odd, none, tmp_path):
    token_blocks.write(odd, str(tmp_path / "a"), tokenizer_path("byte_bpe_50k.json"), parts=3)
    got = sorted(token_blocks.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (i, t) in zip(got, order, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_blocks.write(none, str(tmp_path / "b"), tokenizer_path("byte_bpe_50k.json"))
    assert token_blocks.read(spark, str(tmp_path / "b")).count() == 0


def test_sharding(spark, odd, none, tmp_path):
    rows = [(k, t) for k, t in TEXTS] + [(k, prose(k % 40, 50)) for k in range(100, 400)]
    got = sharding.assign(spark.createDataFrame([(*r, "g") for r in rows], "doc_id long, text string, slice string"), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        home[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in home.values())
    assert set(slots) <= set(range(7)) and sharding.assign(none, 7).count() == 0
    sharding.write_shards(odd, 3, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(TEXTS)


def test_urls(spark):
    urls = ["http://A.Example.org/en/1x?q#f", "https://example.org/es/", "x", None, "", "ftp://y.com/de/#a", "http://com/fr/", "http://org",
            "a://b://c.org/x", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert [got[k].verdict for k in range(10)] == ["block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert [got[k].rule for k in (0, 1, 3, 5, 6, 7, 9)] == ["example.org/en/1", "example.org/es/", None, "com/de/", "com/fr/", None, "org/"]
    assert (got[0].host, got[0].path, got[8].host, got[3].host, got[7].path) == ("a.example.org", "/en/1x", "b:", "", "")
    table = spark.createDataFrame([tuple(r) for r in url_filter.RULES], "host string, path string, verdict string")
    joined = url_filter.judge(pages, table, max_broadcast=1)
    assert {r.page_id: r for r in joined.collect()} == got
    assert url_filter.judge(pages.where("false"), table).count() == 0
    twice = pages.union(pages).union(pages.where("url is null"))
    assert Counter(url_filter.judge(twice, table, max_broadcast=1).collect()) == Counter(url_filter.judge(twice, url_filter.RULES).collect())


def test_many_entries_of_one_host(spark):
    rules = [url_filter.Rule("shop.com", f"/item/{k}", "block" if k % 3 else "allow") for k in range(20_000)]
    trie = url_filter.build(rules)
    start = time.perf_counter()
    for k in range(0, 40_000, 4):
        found = url_filter.match(trie, "www.shop.com", f"/item/{k}x")
        want = next((p for p in (str(k)[:n] for n in range(5, 0, -1)) if int(p) < 20_000), None)
        assert found.path == f"/item/{want}"
    assert time.perf_counter() - start < 5


def test_licenses(spark, odd, none):
    notices = [n for _, n in license_scan.TEMPLATES]
    rows = [*TEXTS, *((100 + k, f"{prose(k, 10 + 9 * k)} {n}. {prose(77 + k, 50)} CC-BY all rights reserved") for k, n in enumerate(notices))]
    got = license_scan.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    texts = dict(rows)
    for r in got:
        if r.doc_id is None:
            continue
        w, starts, base, labels, best = cut(texts[r.doc_id]), [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES:
            q = phrase.split()
            here = [i for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
            starts += here
            base |= {label} if here else set()
        for at in range(0, len(w), 32):
            block = set(w[at:at + 64])
            for label, notice in license_scan.TEMPLATES:
                own = set(cut(notice))
                if len(own & block) >= 0.9 * len(own) - 1e-9:
                    labels.add(label)
                    best = max(best, len(own & block) / len(own))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (
            len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), best)
    assert license_scan.scan(none).count() == 0


def test_pages(spark):
    page = "<title>t</title><nav><a>m</a></nav><article><p>One &lt; two</p><p>three  four</article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "u", page, 3), (1, "u", page, 3), (2, None, None, 4), (3, "u", "", 5),
                                   (4, "u", f"<main><p>{LONG}</main>", 6)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter(
        [(1, "One < two\nthree four", 20)] * 2 + [(2, "", 0), (3, "", 0), (4, LONG, len(LONG))])
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("furniture", ["nav", "nav|footer"])
def test_pages_without_named_content(spark, furniture):
    """Of pages that the weights were not counted on, article, main (and more) become div and all attributes go."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    taught, held = pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")
    weights = html_text.learn(taught)
    bare = F.regexp_replace("html", rf"<(/?)(article|main|{furniture})\b[^>]*>", "<$1div>")
    bare = F.regexp_replace(bare, r"<(\w+)\s[^>]*>", "<$1>")
    want = {r.page_id: r.text for r in html_text.extract(held, weights).collect()}
    got = {r.page_id: r.text for r in html_text.extract(held.withColumn("html", bare), weights).collect()}
    assert len(want) > 100 and sum(got[k] == t for k, t in want.items()) >= 0.95 * len(want)
    # the scan decides: with weights that know no places, words beside the content come in
    blind = {k: w for k, w in weights.items() if k[0] not in "/."}
    got = {r.page_id: r.text for r in html_text.extract(held.withColumn("html", bare), blind).collect()}
    assert sum(got[k] == t for k, t in want.items()) < 0.5 * len(want)


def test_leaks(spark, odd, none):
    items = {k: prose(1000 + k, 20 + 7 * k) for k in range(8)}
    bench = spark.createDataFrame([*((k, t, "x") for k, t in items.items()), (50, None, "x"), (51, "", "x"), (None, "one lone word", "x")],
                                  "item_id long, text string, doc_id string")
    rows = [(k, prose(k, 90 + 11 * k)) for k in range(30)]
    planted = {}
    for k in range(8):  # verbatim at any place, and with every sixth word replaced
        words = items[k].split()
        planted[100 + k] = k
        rows.append((100 + k, f"{prose(200 + k, 13 * k)} {items[k]} {prose(300 + k, 40)}"))
        changed = " ".join("other" if j % 6 == 5 else w for j, w in enumerate(words))
        planted[200 + k] = k
        rows.append((200 + k, f"{prose(400 + k, 70)} {changed} {prose(500 + k, 5 * k)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == set(planted.items())
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, max_broadcast=900).collect()} == got
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.count() == docs.count() - len(planted)
    assert decontaminate.leaks(none, bench).count() == decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_svd_finds_the_leading_directions(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 12)) + 0.01 * rng.standard_normal((200, 12))
    rows = spark.createDataFrame([(list(range(12)), r.tolist()) for r in a], "words array<int>, weights array<double>").repartition(4)
    got, want = decontaminate.randomised_svd(rows, 12, 3), np.linalg.svd(a)[2][:3].T
    assert np.allclose(np.abs(np.sum(got * want, axis=0)), 1, atol=1e-3)


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == odd.columns
            out.write.parquet(str(tmp_path / f"{name}-{id(docs)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{id(docs)}"))
        assert docs.columns[:2] == ["doc_id", "piece"]
    assert docs.count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage's decision recomputed on its own input; this table has too few labels for a rule of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            rules = quality_rules.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            assert rules == [] and 0 < len(after) < len(before) and all(after[i].text == before[i] for i in after)
            assert all(len((before[i] or "").split()) >= 20 for i in after)
        elif name == "line_dedup":
            count = Counter(x for t in before.values() for x in set(t.split("\n")) if len(x.split()) >= 20)
            first = {}
            for i in sorted(before):
                for x in before[i].split("\n"):
                    first.setdefault(x, i)
            for i, r in after.items():
                assert all(count[x] < 2 or first[x] == i for x in r.text.split("\n")) and r.n_chars == len(r.text)
        elif name == "near_duplicates":
            sets = {i: shingles(t) for i, t in before.items()}
            pairs = [(i, j) for i in after for j in after if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            assert pairs == []
            assert all(any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in before if j != i) for i in before.keys() - after.keys())
        elif name == "decontamination":
            cut = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)))
            items = [f" {cut(r.text)} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dirty = {i for i, t in before.items() if any(x in f" {cut(t)} " for x in items)}
            assert dirty and before.keys() - after.keys() == dirty
        else:
            assert {r.doc_id for r in docs.collect()} == before.keys()
