"""Cases beyond the small tables: what a fixed bound inside an operator would lose."""

import numpy as np

from reverbtable.llm import decontaminate, flatwords as fw, license_scan, line_dedup, ngram_join


def test_leaks_of_a_large_benchmark_against_brute_force(spark):
    """2,200 items, planted verbatim and as paraphrases; every document is found with its item, and the share is right."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{k}x" for k in range(9000)])
    weights = 1 / (np.arange(9000) + 20)
    draw = lambda n: list(rng.choice(vocabulary, n, p=weights / weights.sum()))
    items = [draw(n) for n in rng.integers(15, 60, 2200)]
    rows = []
    for k, words in enumerate(items):
        inside = list(words)
        if k % 2:  # three in ten words give way, the rarest do not
            common = np.argsort([int(x[1:-1]) for x in words])[:len(words) * 3 // 10]
            for j in common:
                inside[j] = "other"
        rows.append((k, " ".join(draw(rng.integers(5, 90)) + inside + draw(rng.integers(5, 90)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, bench).collect()}
    index = decontaminate.build(docs, bench)
    want = {}
    for i in index.items:  # a document against the item planted in it, at every block
        w = fw.hash_words(rows[i.item_id][1].split()).tolist()
        for b in range(0, len(w), decontaminate.STRIDE):
            here = w[max(0, b - len(i.words)):b + decontaminate.PASSAGE + len(i.words)]
            share = decontaminate.common_subsequence(i.words, here) / len(i.words)
            answers = len(i.answer.intersection(here)) / len(i.answer)
            if share >= decontaminate.VERBATIM or (share >= decontaminate.PARAPHRASE and answers >= decontaminate.ANSWER):
                want[i.item_id, i.item_id] = max(share, want.get((i.item_id, i.item_id), 0))
    assert len(want) > 2100
    assert {k: v for k, v in got.items() if k[0] == k[1]} == want


def test_every_template_of_a_full_leaf(spark, monkeypatch):
    """A leaf with more templates than one round has heads for; templates against a greedy run to the end."""
    rng = np.random.default_rng(3)
    texts = ["this article was first seen in an old magazine"] * 50 + ["this article was never read by any living person"] * 40
    texts += [f"this article was written by {x} for the herald" for x in "abcdefghijklmnopqrst"]
    texts += ["this article was " + " ".join("abcdefgh"[i] for i in rng.integers(0, 8, 6)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.parsed(docs.selectExpr("doc_id as rid", "doc_id", "text")).cache()
    left = {r.line: (r["count"], r.line, r.marks) for r in lines.groupBy("line", "marks").count().collect()}
    want, n_heads = {}, 0
    while left:
        _, head, marks = max(left.values())
        mine = [k for k, x in left.items() if 10 * sum(a == b for a, b in zip(x[2], marks)) >= 7 * len(marks)]
        want |= {k: head for k in mine if k != head}
        left = {k: x for k, x in left.items() if k not in mine}
        n_heads += 1
    assert n_heads > 256
    assert {r.line: r.template for r in line_dedup.templates(lines).collect()} == want
    # few heads a round and many parts a leaf change nothing
    monkeypatch.setattr(line_dedup, "PART_LINES", 50)
    assert {r.line: r.template for r in line_dedup.templates(lines, most=100).collect()} == want
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup(docs).collect()}
    assert got[90] == 0 and all(got[k] == 1 for k in range(91, 110))


def test_lines_by_brute_force(spark, monkeypatch):
    """Documents of few phrases, a line that stands everywhere, one that fills a document: dedup against plain Python,
    whichever lines are sent to every task."""
    rng = np.random.default_rng(8)
    pool = ["hot line of this site"] * 6 + [" ".join("abcdef"[i] for i in rng.integers(0, 6, n)) for n in rng.integers(2, 24, 40)]
    texts = ["\n".join(pool[i] for i in rng.integers(0, len(pool), 8)) for _ in range(60)]
    texts += ["one giant line of its own\n" * 3000, "mine and mine alone\n" * 2, None, "", "hot line of this site"]
    texts += [" ".join(f"w{chr(97 + i)}" for i in range(22))] * 2 + ["of two documents only"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    lines = line_dedup.parsed(docs.selectExpr("doc_id as rid", "doc_id", "text")).collect()
    joined = {r.line: r.template for r in line_dedup.templates(
        line_dedup.parsed(docs.selectExpr("doc_id as rid", "doc_id", "text"))).collect()}
    held = {}
    for r in lines:
        held.setdefault((joined.get(r.line, r.line), r.n), set()).add(r.doc_id)
    gone = {(r.doc_id, r.pos) for r in lines for d in [held[joined.get(r.line, r.line), r.n]]
            if len(d) >= (2 if r.n >= line_dedup.LONG_WORDS else line_dedup.MIN_DOCS) and r.doc_id != min(d)}
    want = {k: t and "\n".join(s for p, s in enumerate(t.split("\n")) if (k, p) not in gone) for k, t in enumerate(texts)}
    assert len(gone) > 200 and any(len(d) == 2 for d in held.values())
    for hot in (1, 20, 1 << 40):
        monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
        assert {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()} == want


def test_whole_license_paragraphs(spark):
    """Every paragraph is met wherever it stands, with few words missing, and under its own label alone."""
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 999, n))
    paragraphs = license_scan.PARAGRAPHS
    assert max(len(t.split()) for _, t, _ in paragraphs) > 2 * license_scan.STRIDE
    rows = []
    for k, (label, wording, phrases) in enumerate(paragraphs):
        for j, before in enumerate((0, 17, 33, 70, 131)):
            words = wording.split()
            if j % 2:  # one word that no phrase holds is missing
                words.remove(max(words, key=lambda x: (x.lower() not in " ".join(phrases), len(x))))
            rows.append((10 * k + j, f"{filler(before)} {' '.join(words)} {filler(80)}", label))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {r.doc_id: r for r in license_scan.scan(docs, paragraphs).collect()}
    for k, _, label in rows:
        assert {b.label for b in got[k].blocks} == {label} and got[k].score >= 0.9, (k, label, got[k])
    long = " ".join(f"t{x}" for x in range(700))
    [r] = license_scan.scan(spark.createDataFrame([(1, f"{filler(900)} {long} {filler(50)}")], "doc_id long, text string"),
                            [("long", long)]).collect()
    assert r.labels == "long" and r.score == 1


def test_repeated_ids_with_different_texts(spark):
    """An id on two texts: each text is judged by itself."""
    rng = np.random.default_rng(6)
    a, b, c, d = (" ".join(f"v{x}" for x in rng.integers(0, 5000, 60)) for _ in range(4))
    docs = spark.createDataFrame([(1, b), (3, a), (3, b + " more"), (5, a), (7, c), (7, c + " more"), (9, d), (9, d)],
                                 "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept)[:2] == [(1, b), (3, a)] and sorted(i for i, _ in kept) == [1, 3, 7, 9]
    bench = spark.createDataFrame([(1, " ".join(a.split()[10:40]))], "item_id long, text string")
    clean = [tuple(r) for r in decontaminate.keep_clean(docs, bench).collect()]
    assert sorted(clean) == sorted(tuple(r) for r in docs.collect() if r.text != a)
