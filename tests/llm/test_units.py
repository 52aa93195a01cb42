"""The parts of the operators that need no session, against plain versions."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest

from reverbtable.llm import decontaminate, html_text, ngram_join, packing, sharding, token_blocks, url_filter


def test_capacity_is_the_minimax():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.choice([0, 1, 2, 3, 9, 50]) for _ in range(rnd.randint(1, 8))]
        shards = rnd.randint(1, 5)
        ends = range(len(sizes) + 1)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes))))
                   for c in itertools.combinations_with_replacement(ends, shards - 1))
        assert sharding.capacity(sizes, shards) == best
        firsts = sharding.cuts(sizes, shards)
        parts = [sum(sizes[a:b]) for a, b in zip((0, *firsts), (*firsts, len(sizes)))]
        assert len(parts) == shards and firsts == sorted(firsts) and max(parts) <= best


def test_fullest_bin_by_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        counts = dict(Counter(rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))))
        used = packing.fullest(counts, 20)
        assert all(n <= counts[k] for k, n in used.items()) and max(counts) in used
        rest = list(Counter(counts).elements())
        rest.remove(max(counts))
        fits = [max(counts) + sum(c) for r in range(len(rest) + 1) for c in itertools.combinations(rest, r)]
        assert sum(k * n for k, n in used.items()) == max(f for f in fits if f <= 20)


def test_combinations_use_every_piece_once():
    rng = np.random.default_rng(3)
    counts = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 30_000) + 1).astype(int).tolist())
    left = Counter()
    found = packing.combinations(counts)
    for times, used in found:
        assert sum(k * n for k, n in used.items()) <= 4096
        for k, n in used.items():
            left[k] += times * n
    assert left == counts and packing.combinations({}) == []
    assert sum(t for t, _ in found) <= -(-sum(k * n for k, n in counts.items()) // 4096) + 1
    assert packing.combinations({4096: 2, 1: 5}) == [(2, {4096: 1}), (1, {1: 5})]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 100, 50_257, 2**32])
def test_token_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    data = token_blocks.encode(ids)
    assert (token_blocks.decode(data) == ids).all() and (token_blocks.decode(data, 5, 200) == ids[5:200]).all()


def test_outliers_are_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[::128] = 2**31
    assert len(token_blocks.encode(ids)) < 20 + 10 * 16 + 10 * 8 + 1
    assert (token_blocks.decode(token_blocks.encode(ids)) == ids).all()
    with pytest.raises(ValueError):
        token_blocks.decode(b"\0" * 20)


def test_trie_against_all_rules():
    rnd = random.Random(4)
    hosts = ["org", "a.org", "b.a.org", "com", "xa.org", ""]
    paths = ["/", "/x", "/x/", "/x/y", "/x/y/1", "", "/xy"]
    for _ in range(300):
        rules = [url_filter.Rule(rnd.choice(hosts[:4]), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(6)]
        host, path = rnd.choice(hosts), rnd.choice(paths)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        got = url_filter.match(url_filter.build(rules), host, path)
        want = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)
        assert got == want


def test_region_by_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        scores = [rnd.randint(-5, 5) for _ in range(rnd.randint(0, 9))]
        lo, hi = html_text.best_region(scores)
        assert sum(scores[lo:hi]) == max([0] + [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])


WEIGHTS = html_text.weights_of({"word": 1000, "<+p": 50}, {"outer": 20, "link": 60, "furniture": 60, "<nav": 10, "<div": 20,
                                                           "<a": 60, "<p": 2, "<footer": 10})


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<!-- x", ""), ("<p>only words", "only words"), ("<<<>>> a < b <p", "<<<>>> a < b <p"),
    ("<script>var a='</p>';</script><p>ok &amp; so", "ok & so"),
    ("<nav><ul><li>Menu</ul><article><h1>T  &eacute;\n x</h1><p><b>One<br><p>two <a href='>'>three</a>.</article><footer>f", "T é x\nOne\ntwo three."),
    ("<article><header><h1>H</h1></header><p>a</p><aside>no no no</aside><div class='ad-box ads'>buy</div><p>b</p>"
     "<form>mail</form></article><section id=comments><article><p>nice read</p></article></section>", "H\na\nb"),
    ("<div class=top><a href=1>Home</a></div><div><h2>Big title here</h2><p>Plain words go on and on.</p></div>"
     "<div class=footer>us</div>", "Big title here\nPlain words go on and on."),
])
def test_page_text(page, text):
    assert html_text.text_of(page, WEIGHTS) == text


def test_common_subsequence():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a), b) == t[-1][-1]


def test_runs_reach_the_recall():
    assert ngram_join.runs_needed(0.99) < ngram_join.runs_needed(0.9999) <= 5


@pytest.mark.parametrize("unit", ["<script ", "<a ", "<div>", "</p>", '<b ">"', "<p><div></p>", "<article></p><p>", "<title \"'>", "<a b='"])
def test_malformed_pages_take_one_pass(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    html_text.text_of(page, WEIGHTS)
    long = time.perf_counter() - start
    start = time.perf_counter()
    html_text.text_of(page[:len(page) // 4], WEIGHTS)
    assert long < 30 and long < 16 * (time.perf_counter() - start) + 1  # the square would take 16 times as long, and hours


def test_places_decide_without_named_content():
    weights = html_text.weights_of({"word": 900, "/p": 850, "/li": 50, ".post": 800, "<+p": 40},
                                   {"outer": 40, "link": 60, "/div": 30, "/li+a": 60, "/p": 10, ".teaser": 10, "<div": 9, "<p": 1})
    assert weights["/p"] > 0 < weights[".post"] and weights["/div"] < 0 > weights["/li+a"] and weights[".teaser"] < 0
    page = "<div>Buy this now</div><div><p>One two three.<p>Four <a href=x>five</a> six seven eight.</div><div>All rights of us</div>"
    assert html_text.text_of(page, weights) == "One two three.\nFour five six seven eight."
    page = "<div><p class='teaser'>Read that one too</p></div><p>One two three.</p><p>Four.</p><p class=teaser>And that</p>"
    assert html_text.text_of(page, weights) == "One two three.\nFour."
    # no place weighs positive: plain words do
    assert html_text.text_of("<div>Only words in one box</div>", weights) == "Only words in one box"


def test_ends_of_tags():
    page = "<a b=\"c>d\">x</a><a 'e>f</g><script u=\">\">no</ScRipt ><!-- <p> -->j<!doctype k>l<?m>n<1<"
    got = [(k, t or x) for k, t, _, x in html_text._parts(page)]
    assert got == [("open", "a"), ("text", "x"), ("end", "a"), ("open", "a"), ("text", "f"), ("end", "g"), ("raw", "script"), ("text", "j"),
                   ("text", "l"), ("text", "n"), ("text", "<"), ("text", "1"), ("text", "<")]


def test_many_short_texts_and_long_parts(tmp_path):
    from reverbtable.llm import tokens
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    long = "x" * 5000
    assert len(encoder.encode([long])[0]) > 0 and long not in encoder.memory


def test_token_memory_turns_over(monkeypatch):
    from reverbtable.llm import tokens
    monkeypatch.setattr(tokens, "MEMORY", 50)
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choices("abcdeé12.,", k=rnd.randint(1, 6))) for _ in range(400)) for _ in range(6)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = tokens.tokenizer_path(name)
        tokens._encoders.pop(path, None)
        encoder = tokens.Encoder(path)
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.memory) <= 51 and len(encoder.memory.old) <= 51
        monkeypatch.setattr(tokens, "LETTERS", 100)
        encoder.encode(texts)
        assert encoder.memory.letters <= 100 + tokens.PART
        tokens._encoders.pop(path)
