"""Piece table, conversation trie and importance resampling against the library and brute force."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from reverbtable.llm import conversation_trie, importance, piece_table
from reverbtable.llm.tokens import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [(1, "The cat  sat. "), (1, "The cat  sat. "), (2, None), (3, ""), (4, " \n\t "), (None, "null id"), (None, None), (5, "▁a▁▁b <s> <0x41>"),
       (6, "日本語 テキスト𐍈𐍈 \0"), (7, "x" * 5000), (8, "word, " * 4000), (9, "a b\n\nc" * 300), (10, " " * 77)]


@pytest.fixture(scope="module")
def odd(spark):
    # columns named like those that the operators add
    return spark.createDataFrame([(i, t, 7, "s", b"z", -1) for i, t in ODD],
                                 "doc_id long, text string, ids int, score string, tie binary, rank int")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_of_odd_texts(spark, odd):
    sp = library()
    rows = piece_table.decode(piece_table.encode(odd, MODEL), MODEL).collect()
    got = Counter((r.doc_id, r.ids, r.text) for r in rows)
    want = Counter()
    for i, t in ODD:
        ids = [1, *sp.encode(t or ""), 2]
        want[i, np.array(ids, "<u4").tobytes(), sp.decode(ids)] += 1
    assert {(i, bytes(b), t): n for (i, b, t), n in got.items()} == want
    assert piece_table.encode(odd.limit(0), MODEL).count() == 0


def test_pieces_of_random_texts():
    sp, table, rng = library(), piece_table.PieceTable(MODEL), random.Random(4)
    kinds = ["ab ", "the onrisdlc", "01=-*#._ \n\t", "".join(map(chr, [*range(0xE0, 0x100), *range(0x430, 0x450), *range(0x4E00, 0x4E20), 0x2581, 32]))]
    for k in range(6000):
        text = "".join(rng.choice(kinds[k % 4]) for _ in range(rng.randint(0, 60)))
        ids = sp.encode(text)
        assert np.frombuffer(table.encode(text), "<u4").tolist() == ids, text
        assert table.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)
    for n in range(140):
        for text in (" " * n + "the", "x" + " " * n, "a" * n + "  b"):
            assert np.frombuffer(table.encode(text), "<u4").tolist() == sp.encode(text)
    for _ in range(3000):  # ids that no text gives
        ids = [rng.choice([rng.randint(3, 258), rng.randint(0, 31999), 1, 2, 0, 28705]) for _ in range(rng.randint(0, 8))]
        assert table.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids), ids


def test_pieces_of_long_texts(monkeypatch):
    sp, table = library(), piece_table.PieceTable(MODEL)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de\n") for _ in range(5000)), "日本" * 3000, " " * 3000 + "a", "ab" * 4000]
    whole = [table.encode(t) for t in texts]
    assert [np.frombuffer(w, "<u4").tolist() for w in whole] == sp.encode(texts)
    monkeypatch.setattr(piece_table, "STRIDE", 37)
    monkeypatch.setattr(piece_table, "MEMORY_BYTES", 3000)
    assert [table.encode(t) for t in texts] == whole


def test_compatible_is_merging_both(monkeypatch):
    table, rng = piece_table.PieceTable(MODEL), random.Random(2)
    pieces = [p for p in table.pieces if len(p) < 5]
    for _ in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert table.compatible(a, b) == (table.merge(a + b) == [a, b]), (a, b)


def brute_trie(rows, branch=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:]) if branch else tuple(own)
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, block binary"


def check_trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA)
    turns = conversation_trie.ordered(df)
    convs = turns.select("conv_id").distinct()
    got = conversation_trie.trie(conversation_trie.branched(turns, convs), convs)
    assert Counter(tuple(r) for r in got.select(NODE).collect()) == brute_trie(rows)
    return turns, convs


def test_trie(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), *range(9_990, 10_020)]:
        n = rng.choice([0, 1, 1, 2, 3, 7, 8, 9, 15, 16, 17, 26])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hé", "yes", "", None, "a longer one"])) for t in range(n)]
    same = [("user", "hi"), ("assistant", "hello"), ("user", "bye")] * 6
    rows += [(c, t, *x) for c in range(300, 340) for t, x in enumerate(same)]  # copies
    rows += [(50, None, "user", "no number"), (50, None, "user", "no number"), (50, 0, "a", "tie"), (50, 0, "b", "tie"),
             (None, 1, "user", "nobody's"), (51, 2**40, None, None), (52, -5, "user", "before all")]
    rows += [(777, t, "user", f"only {t}") for t in range(2)]  # no conversation 700: may be left without turns
    turns, convs = check_trie(spark, rows)
    monkeypatch.setattr(conversation_trie, "RUN", 4)  # every run, block and digest row is cut
    check_trie(spark, rows)
    plain = Counter(tuple(r) for r in conversation_trie.trie(turns, convs).select(NODE).collect())
    assert plain == brute_trie(rows, branch=False)


def test_trie_of_nothing(spark):
    check_trie(spark, [])
    check_trie(spark, [(None, 1, "a", "b")])
    check_trie(spark, [(701, 0, "a", "b")])


def test_trie_many_children(spark):
    check_trie(spark, [(c, t, "user", "start" if t == 0 else f"{c}") for c in range(700) for t in range(2)])


def brute_resample(rows, target, percent=10, least=20, longest=1):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return [zlib.crc32(" ".join(w[k:k + n]).encode()) % 10000 for n in range(1, longest + 1) for k in range(len(w) - n + 1)], len(w)
    found = [features(t) for _, t in rows]
    s, t = Counter(), Counter()
    for f, _ in found:
        s.update(f)
    for x in target:
        t.update(features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (f, n) in zip(rows, found):
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(may[:percent * len(may) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def prose(rng, n):
    return " ".join("".join(rng.choice("aBé1") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, odd, monkeypatch, longest):
    rng = random.Random(3)
    rows = ODD + [(i, prose(rng, rng.randint(0, 60))) for i in range(100, 700)] + [(42, "same text again " * 9)] * 300
    rows += [(None, "of nobody " * 15)] * 50
    target = [None, "", prose(rng, 400), "same text"]
    extra = spark.createDataFrame([(i, t, 7, "s", b"z", -1) for i, t in rows[len(ODD):]], odd.schema)
    docs, marks = odd.union(extra), spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(importance, "REST", 5)
    monkeypatch.setattr(importance, "RUN", 16)
    for percent in (10, 60, 100, 0):
        got = Counter(tuple(r) for r in importance.resample(docs, marks, percent, longest=longest).collect())
        assert got == brute_resample(rows, target, percent, longest=longest)
    assert importance.resample(odd.limit(0), marks).count() == 0
    assert Counter(tuple(r) for r in importance.resample(odd, marks.limit(0)).collect()) == brute_resample(ODD, [])


def test_features_cut_anywhere(monkeypatch):
    import pyarrow as pa
    rng = random.Random(5)
    texts = [None, "", "Ab c  d-e é1 ", *(prose(rng, rng.randint(0, 50)) for _ in range(40)), "x" * 500 + " y", "zz yy " * 3000]
    want = Counter()
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        want.update((zlib.crc32(" ".join(w[k:k + n]).encode()) % 10000, i) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    for stride in (1 << 20, 100):
        monkeypatch.setattr(importance, "STRIDE", stride)
        got = Counter()
        for bucket, row in importance.features(pa.array(texts, pa.string()), 3):
            got.update(zip(bucket.tolist(), row.tolist()))
        assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_cutoff_is_the_kth_key(spark, monkeypatch, parts):
    rng = random.Random(6)
    keys = sorted({(rng.choice([0, 0, 0, rng.randint(-9, 9)]), rng.randint(0, 40), t) for t in range(3000)})
    df = spark.createDataFrame(rng.sample(keys, len(keys)), "a long, b long, c long").repartition(parts).cache()
    monkeypatch.setattr(importance, "REST", 1)
    monkeypatch.setattr(importance, "RUN", 64)
    for k in (1, 2, 1500, 2999, 3000):
        assert importance.cutoff(df, ["a", "b", "c"], k) == keys[k - 1]
    assert importance.cutoff(df, ["a", "b", "c"], 0) is None
    df.unpersist()
