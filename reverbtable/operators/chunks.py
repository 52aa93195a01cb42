"""Signals of long records as chunk rows: key, chunk_no, samples, all of ``size`` samples but a record's last.

A record is never one row and never meets in one task. What an operator needs beyond a chunk's edge comes as a halo:
the neighbours hand over the samples that are needed, by key. What it leaves beyond the edge goes to the next chunk
by key and is added there.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions import arrays as A
# by name: tasks take along what their functions name, and a module would come whole
from reverbtable.functions.kernels import PolyphaseBank, _fftconv_full, _lists, _nested, _overlap_add, _rows, _stft, hann
from reverbtable.functions.scan import attach

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALUES = 1 << 21  # numbers handed back at once


def cut(df: DataFrame, keys: list[str], x: str, size: int) -> DataFrame:
    """Arrays as chunk rows: keys, chunk_no, samples."""
    parts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int"))
    return (df.where(F.size(x) > 0).select(*keys, x, F.explode(parts).alias("chunk_no"))
            .select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), A.cut(F.col(x), F.col("chunk_no") * size, size).alias("samples")))


def with_halo(chunks: DataFrame, keys: list[str], size: int, left: int, right: int) -> DataFrame:
    """Chunks with up to ``left`` samples before and ``right`` behind them: keys, chunk_no, n (own samples), t0 (place
    of the first sample held), samples.

    A chunk sends only the samples that a neighbour asks for; what lies before the first or behind the last sample of
    a record is not there.
    """
    reach_left, reach_right = -(-left // size), -(-right // size)
    no, at = F.col("chunk_no"), F.col("chunk_no") * size
    sent = chunks.select(*keys, no, "samples", F.explode(F.sequence(no - reach_right, no + reach_left)).alias("_to")).where("_to >= 0")
    lo = F.greatest(F.col("_to") * size - left - at, F.lit(0)).cast("int")
    hi = F.least((F.col("_to") + 1) * size + right - at, F.size("samples")).cast("int")
    piece = F.when(no == F.col("_to"), F.col("samples")).otherwise(F.slice("samples", lo + 1, F.greatest(hi - lo, F.lit(0))))
    parts = sent.select(*keys, F.col("_to").alias("chunk_no"), F.struct((at + lo).alias("t0"), piece.alias("x")).alias("_p"),
                        F.when(no == F.col("_to"), F.size("samples")).alias("_n")).where(F.size("_p.x") > 0)
    # as many pieces as chunks reach over: a few
    met = parts.groupBy(*keys, "chunk_no").agg(F.sort_array(F.collect_list("_p")).alias("_p"), F.max("_n").alias("n"))
    return met.where("n IS NOT NULL").select(*keys, "chunk_no", "n", F.col("_p")[0]["t0"].alias("t0"),
                                             F.flatten(F.transform("_p", lambda p: p["x"])).alias("samples"))


def add_arrays(xs: Column) -> Column:
    """Elementwise sum of arrays, the shorter ones taken as zero behind their ends."""
    zero = F.lit(0.0)
    return F.aggregate(xs, F.array().cast("array<double>"), lambda acc, x: F.zip_with(
        acc, x, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)))


def _mapped(df: DataFrame, keys: list[str], columns: list[str], schema: str, one) -> DataFrame:
    """``one`` of the columns of every row yields tuples for the columns of schema; the row's keys stand before them."""
    names, kinds = zip(*[c.split(" ", 1) for c in schema.split(", ")])
    rows = df.select(*keys, *columns)
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    made_of = {"long": lambda v: pa.array(v, pa.int64()), "array<double>": _lists, "array<array<double>>": _nested}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = [_rows(a) if pa.types.is_list(a.type) else a.to_pylist() for a in (batch.column(c) for c in columns)]
            owner, out, held = [], [[] for _ in names], 0
            for k, row in enumerate(zip(*args)):
                for values in one(*row):
                    owner.append(k)
                    for column, v in zip(out, values):
                        column.append(v)
                        held += np.size(v)
                if out[0] and (held > VALUES or k + 1 == len(batch)):
                    mine = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(mine) for c in keys],
                                                      *[made_of[t](v) for t, v in zip(kinds, out)]], [*keys, *names])
                    owner, out, held = [], [[] for _ in names], 0

    return rows.mapInArrow(run, f"{key_types}, {schema}")


def convolve(chunks: DataFrame, taps: DataFrame, keys: list[str], on: list[str], size: int) -> DataFrame:
    """Source chunks(keys, chunk_no, samples) through the responses taps(on, ch, h), cut to the source's length:
    keys, ch, chunk_no, samples. ``on`` are those of keys that name the response.

    Blocks of ``size`` taps and chunks are convolved by FFT; the second half of a product is added to the next chunk
    (overlap-add). A chunk is added up from at most two products per block of taps.
    """
    blocks = cut(taps, [*on, "ch"], "h", size).withColumnsRenamed({"chunk_no": "_j", "samples": "_h"})
    pairs = attach(chunks.withColumnRenamed("chunk_no", "_i"), blocks, on)

    def product(i, j, x, h):
        full = _fftconv_full(x, h)
        yield i + j, full[:size], len(x) if j == 0 else None
        if len(full) > size:
            yield i + j + 1, full[size:], None

    parts = _mapped(pairs, [*keys, "ch"], ["_i", "_j", "samples", "_h"], "chunk_no long, y array<double>, n long", product)
    # a chunk that only tails reach lies behind the source's end
    return parts.groupBy(*keys, "ch", "chunk_no").agg(add_arrays(F.collect_list("y")).alias("_y"), F.max("n").alias("_n")).where(
        "_n IS NOT NULL").select(*keys, "ch", "chunk_no", F.slice("_y", F.lit(1), F.col("_n").cast("int")).alias("samples"))


def stft(chunks: DataFrame, keys: list[str], size: int, win: int = 512, hop: int = 256) -> DataFrame:
    """Spectra of all complete frames: keys, chunk_no, frame (first one of the row), re, im [frame][bin].

    A frame belongs to the chunk in which it starts; the samples behind the chunk's end come from the next ones.
    """
    w = hann(win)

    def spectra(no, n, t0, x):
        first = -(-no * size // hop)
        start = first * hop - t0
        found = _stft(x[start:], win, hop, w) if start < len(x) else np.zeros((0, 1))
        found = found[:max(0, -(-(no * size + n - first * hop) // hop))]  # frames that start inside
        if len(found):
            yield no, first, found.real, found.imag

    held = with_halo(chunks, keys, size, 0, win - 1)
    return _mapped(held.withColumnRenamed("chunk_no", "_no"), keys, ["_no", "n", "t0", "samples"],
                   "chunk_no long, frame long, re array<array<double>>, im array<array<double>>", spectra)


def istft(spectra: DataFrame, keys: list[str], size: int, win: int = 512, hop: int = 256) -> DataFrame:
    """Samples of rows of spectra(frame, re, im): keys, chunk_no, samples.

    Each row adds its windowed inverse frames and their window power over the chunks that they touch; sums of both
    meet by chunk, and samples are the one over the other.
    """
    w = hann(win)

    def overlapped(first, re, im):
        y, p = _overlap_add(re + 1j * im, win, hop, w)
        at = first * hop
        for no in range(at // size, (at + len(y) - 1) // size + 1):
            lo, hi = max(no * size, at), min((no + 1) * size, at + len(y))
            lead = np.zeros(lo - no * size)
            yield no, np.concatenate([lead, y[lo - at:hi - at]]), np.concatenate([lead, p[lo - at:hi - at]])

    rows = spectra.withColumns({"_b": F.size(F.get("re", F.lit(0))), "_re": F.flatten("re"), "_im": F.flatten("im")})
    parts = _mapped(rows, keys, ["frame", "_b", "_re", "_im"], "chunk_no long, y array<double>, p array<double>",
                    lambda first, b, re, im: overlapped(first, re.reshape(-1, b), im.reshape(-1, b)))
    summed = parts.groupBy(*keys, "chunk_no").agg(add_arrays(F.collect_list("y")).alias("_y"), add_arrays(F.collect_list("p")).alias("_p"))
    return summed.select(*keys, "chunk_no", F.zip_with("_y", "_p", lambda y, p: y / F.when(p > 1e-10, p).otherwise(1.0)).alias("samples"))


def resample(chunks: DataFrame, keys: list[str], size: int, fs_in: int, fs_out: int) -> DataFrame:
    """Rational rate change: keys, chunk_no, t0 (first sample at the new rate), samples. The same values as in one row.

    A chunk makes the samples that fall into it, with the few samples beyond its edges that the filter covers.
    """
    g = math.gcd(fs_in, fs_out)
    up, down = fs_out // g, fs_in // g
    if up == down:
        return chunks.select(*keys, "chunk_no", (F.col("chunk_no") * size).alias("t0"), "samples")
    bank = PolyphaseBank(up, down)

    def run(no, n, t0, x):
        first, last = -(-no * size * up // down), -(-(no * size + n) * up // down)
        if last > first:
            yield no, first, bank.outputs(x, t0, first, last)

    held = with_halo(chunks, keys, size, bank.before, bank.after)
    return _mapped(held.withColumnRenamed("chunk_no", "_no"), keys, ["_no", "n", "t0", "samples"],
                   "chunk_no long, t0 long, samples array<double>", run)
