"""SentencePiece merges without merging: a prefix table filled by automaton matches and pair-compatibility tests.

Every prefix of a text has one merge encoding and so one last token. A token that ends at a position is that last
token exactly if it is compatible with the last token of the prefix before it, that is, if merging the two side by
side leaves both whole. An automaton over all pieces names the tokens that end at each position, longest first; the
first compatible one goes into the table, and the ids are read backwards from the end. The time is linear in the text.

Whether two tokens are compatible follows from their merge histories: along their border stand, at any time, one node
of the left token's right edge and one of the right token's left edge, and the border survives if no such two nodes
form a piece that is merged before either is merged into its own token. Pieces whose history is not in order of their
scores (runs of spaces in some models) are tested by merging the two.

Texts are cut between two characters that stand side by side in no piece, first before spaces and then inside words
not met before; equal parts are encoded once per worker while a memory bounded in bytes holds them.
"""

from __future__ import annotations

import array
import codecs
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reverbtable.llm import flatwords as fw
from reverbtable.llm.book import query, table
from reverbtable.llm.tokens import tokenizer_path

SPACE = "▁"
MEMORY_BYTES = 128 << 20 # parts and ids that a worker remembers before it forgets all
PART = 256               # longer parts are not remembered
PAIRS = 1_000_000        # pair tests remembered
STRIDE = 1 << 20         # characters of a long text that are cut at a time
BEGIN, END = 1, 2

_models: dict = {}


def _one_by_one(error):
    return "�", error.start + 1


codecs.register_error("one_by_one", _one_by_one)


class PieceTable:
    """Encoder and decoder of a merge-type model file; one per worker process and file.

    Read from the file are the pieces, their scores and kinds. Models that change characters (a normaliser other than
    spaces to U+2581 with one put in front) or lack byte pieces are refused.
    """

    def __new__(cls, path: str):
        if path not in _models:
            made = super().__new__(cls)
            made._load(path)
            _models[path] = made
        return _models[path]

    def _load(self, path: str) -> None:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  a　 ﬁ ") != SPACE * 3 + "a　" + SPACE + "ﬁ" + SPACE:
            raise ValueError("only models that leave characters alone are supported")
        kinds = range(len(model))
        byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in kinds if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.byte = [byte[b] for b in range(256)]
        plain = [i for i in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        self.time = {p: -model.get_score(i) for p, i in self.pieces.items()}  # merges go in order of time
        self.output = [b""] * len(model)
        for i in kinds:
            if model.is_byte(i):
                self.output[i] = bytes([int(model.id_to_piece(i)[1:-1], 16)])
            elif model.is_unknown(i):
                self.output[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.output[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        self.led = {i for p, i in self.pieces.items() if p.startswith(SPACE)}
        self.marks = [i for i in kinds if model.is_control(i)]
        self.known = {c for p in self.pieces for c in p}
        self.pairs = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.cuts = not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        self.automaton = ahocorasick.Automaton()
        for p in {*self.pieces, *self.known}:  # a character of a piece that is no piece itself can still be merged
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.history: dict = {}
        self.pair: dict = {}
        self.memory: dict = {}  # ids of parts
        self.words: dict = {}   # ids of words with one space in front, by the words alone
        self.used = 0

    def merge(self, text: str) -> list[str]:
        """By definition: the two neighbours whose union is the earliest piece are merged, the leftmost first."""
        return self._merge(text)[0]

    def _merge(self, text: str):
        at, made, last = list(text), [], None
        while len(at) > 1:
            best = min(((self.time[a + b], k) for k, (a, b) in enumerate(zip(at, at[1:])) if a + b in self.time), default=None)
            if best is None:
                break
            t, k = best
            last = (at[k], at[k + 1])
            made.append(t)
            at[k:k + 2] = [at[k] + at[k + 1]]
        return at, made, last

    def _edges(self, piece: str):
        """(whole, in order, left edge, right edge): nodes from the outer character to the piece with their end times."""
        got = self.history.get(piece)
        if got is None:
            at, made, last = self._merge(piece)
            whole = len(at) == 1
            if not whole or not last:
                own = ((piece, float("inf")),)
                got = (whole, True, own, own)
            else:
                a, b = self._edges(last[0]), self._edges(last[1])
                t = self.time[piece]
                ordered = a[1] and b[1] and all(t > self.time[p] for p in last if len(p) > 1)
                left = (*a[2][:-1], (last[0], t), (piece, float("inf")))
                right = (*b[3][:-1], (last[1], t), (piece, float("inf")))
                got = (True, ordered, left, right)
            self.history[piece] = got
        return got

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a and b side by side leaves both whole."""
        key = (a, b)
        got = self.pair.get(key)
        if got is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            got = self.pair[key] = self._border(a, b)
        return got

    def _border(self, a: str, b: str) -> bool:
        of_a, of_b = self._edges(a), self._edges(b)
        if not (of_a[0] and of_b[0]):
            return False
        if not (of_a[1] and of_b[1]):
            return self.merge(a + b) == [a, b]
        right, left, i, j = of_a[3], of_b[2], 0, 0
        while True:
            (x, x_end), (y, y_end) = right[i], left[j]
            t = self.time.get(x + y)
            if t is not None and t < x_end and t <= y_end:  # at equal times the leftmost merge goes first
                return False
            if i + 1 == len(right) and j + 1 == len(left):
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[str | None]:
        """The last token of every prefix of a text in the model's own characters; None stands for an unknown character."""
        last: list[str | None] = [None] * (len(text) + 1)
        done, known = 0, self.pair.get
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            before = last[end - size]
            if before is None:  # the text's start and an unknown character are no neighbours to merge with
                fits = self._edges(piece)[0]
            else:
                fits = known((before, piece))
                if fits is None:
                    fits = self.compatible(before, piece)
            if fits:
                last[end] = piece
                done = end
        return last

    def _ids(self, text: str) -> bytes:
        last, at, out = self.table(text), len(text), []
        while at:
            piece = last[at]
            if piece is None:
                piece = text[at - 1]
            number = self.pieces.get(piece)
            if number is None:
                out.extend(self.byte[b] for b in reversed(piece.encode()))
            else:
                out.append(number)
            at -= len(piece)
        return array.array("I", reversed(out)).tobytes()

    def part(self, text: str) -> bytes:
        got = self.memory.get(text)
        if got is None:
            pairs = self.pairs
            ends = [k for k in range(1, len(text)) if text[k - 1:k + 1] not in pairs]
            if ends and len(text) <= PART:
                got = b"".join([self.part(text[i:j]) for i, j in zip([0, *ends], [*ends, len(text)])])
            else:
                got = self._ids(text)
            if len(text) <= PART:
                self._remember(self.memory, text, got)
        return got

    def word(self, text: str) -> bytes:
        got = self.words.get(text)
        if got is None:
            # where a space and a character stand side by side in no piece the rest is a part of its own
            ends = [k for k in range(1, len(text)) if text[k - 1:k + 1] not in self.pairs]
            cut = ends[0] if ends and len(text) <= PART else len(text)
            got = self._ids(SPACE + text[:cut]) if cut == len(text) else self.word(text[:cut]) + self.part(text[cut:])
            if len(text) <= PART:
                self._remember(self.words, text, got)
        return got

    def _remember(self, memory: dict, text: str, ids: bytes) -> None:
        size = 2 * len(text) + len(ids) + 150
        if self.used + size > MEMORY_BYTES:
            self.memory.clear()
            self.words.clear()
            self.used = 0
        memory[text] = ids
        self.used += size

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes, as the library's encode gives them; null is an empty text."""
        if not text:
            return b""
        out, lo = [], 0
        text = " " + text
        while lo < len(text):
            hi = self._stop(text, lo + STRIDE)
            out.append(self._words(text[lo:hi]))
            lo = hi
        return b"".join(out)

    def _stop(self, text: str, at: int) -> int:
        """The first place from `at` on that may be cut."""
        for k in range(max(at, 1), len(text)):
            if text[k - 1:k + 1].replace(" ", SPACE) not in self.pairs:
                return k
        return len(text)

    def _words(self, text: str) -> bytes:
        if not self.cuts:
            return self.part(text.replace(" ", SPACE))
        if "  " in text or SPACE in text or text[-1] == " " or text[0] != " ":
            return b"".join(map(self.part, _RUN.findall(text.replace(" ", SPACE))))
        known = self.words.get
        return b"".join([known(w) or self.word(w) for w in text[1:].split(" ")])

    def decode(self, ids: bytes | None) -> str:
        """Text of ids, as the library's decode gives it: bytes that are no UTF-8 become U+FFFD one by one."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        output, first = self.output, True
        raw = []
        for part in self._between_marks(numbers):
            one = b"".join([output[i] for i in part])
            if first and one:  # the space put in front goes again
                one, first = one[part[0] in self.led:], False
            raw.append(one.decode("utf-8", "one_by_one"))
        return "".join(raw)

    def _between_marks(self, numbers: list[int]) -> Iterator[list[int]]:
        """Runs of ids without control ids, which have no output and end a run of byte pieces."""
        lo = 0
        for mark in sorted(k for m in self.marks if m in numbers for k, i in enumerate(numbers) if i == m):
            yield numbers[lo:mark]
            lo = mark + 1
        yield numbers[lo:]

_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", begin: int | None = BEGIN,
           end: int | None = END) -> DataFrame:
    """doc_id, ids: the ids of every whole text as little-endian unsigned 32-bit bytes, with begin and end ids.

    A null text is an empty one: the begin and end ids alone. Null and repeated doc_ids stay as they are, one row out
    per row in; other columns are not read; an empty table gives no rows. A text of any length is encoded in strides
    of about a million characters.
    """
    head, tail = (b"" if x is None else int(x).to_bytes(4, "little") for x in (begin, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceTable(path)
        for batch in batches:
            for lo, hi in fw.slices(batch.column(1)):
                cut = batch.slice(lo, hi - lo)
                ids = [head + model.encode(t) + tail for t in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows(doc_id, ids) with the text that the ids stand for; null ids stand for an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceTable(path)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                cut = batch.slice(lo, 64)
                texts = [model.decode(x) for x in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")


@query("op11_piece_table")
def op11(spark, sf_dir):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
