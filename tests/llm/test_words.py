import re
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from reverbtable.llm import flatwords as fw
from reverbtable.llm.tokens import Encoder, tokenizer_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
KINDS = [(fw.spaced(), r"[^\x20\x09-\x0D]+"), (fw.alphanumeric(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]
TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB z\n\t\x0b,é😀0-_"), max_size=30)), max_size=8)


@pytest.mark.parametrize("kind", [0, 1])
@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_words_are_the_pattern_s(kind, texts):
    table, pattern = KINDS[kind]
    w = fw.words(pa.array(texts, pa.string()), table)
    want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for row in want for x in row]
    assert (w.hashes == fw.hash_words(flat)).all() and len(set(flat)) == len(set(w.hashes.tolist()))


@settings(max_examples=100, deadline=None)
@given(texts=TEXTS)
def test_shingles(texts):
    w = fw.words(pa.array(texts, pa.string()), fw.spaced())
    hashes, row = fw.ngrams(w, 3)
    want = []
    for k, t in enumerate(texts):
        x = re.findall(KINDS[0][1], (t or "").translate(LOWER))
        want += [(k, tuple(x[i:i + 3])) for i in range(len(x) - 2)] or ([(k, tuple(x))] if x else [])
    assert sorted(row.tolist()) == sorted(k for k, _ in want)
    assert len(set(hashes.tolist())) == len({g for _, g in want})


def test_slices_cover_all_rows():
    texts = pa.array(["x" * 10, "", None, "y" * 100, "z"], pa.string())
    assert [r for lo, hi in fw.slices(texts, 12) for r in range(lo, hi)] == list(range(5))
    assert list(fw.slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aBc'sé \n\t \x1c\x85́Σ.,<|>1😀"), max_size=40), max_size=6))
def test_encoding_in_parts_is_exact(name, texts):
    encoder = Encoder(tokenizer_path(name))
    texts = [*texts, "a  b   c ", " lead", "x \n y", "<|endoftext|> and <|endoftext|>", "don't I'll  'S", ""]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
