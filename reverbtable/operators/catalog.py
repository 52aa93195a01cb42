"""Recording catalogue: selection, expansion over microphone pairs, item weights, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions.scan import Agg, attach, row_index, scan, with_row_blocks


def path_attributes(df: DataFrame, names: list[str], path: str = "path") -> DataFrame:
    """Last path components as columns, outermost first."""
    parts = F.split(F.col(path), "/")
    return df.withColumns({n: F.element_at(parts, i - len(names)) for i, n in enumerate(names)})


def pair_name_attributes(name: Column) -> dict[str, Column]:
    """Source and microphone pair of names such as SP1-2-3_MP4-0-5."""
    return {"sp": F.regexp_extract(name, r"SP([0-9-]+)", 1),
            "array_pos": F.regexp_extract(name, r"MP(\d+)-\d+-\d+", 1).cast("int"),
            "m1": F.regexp_extract(name, r"MP\d+-(\d+)-\d+", 1).cast("int"),
            "m2": F.regexp_extract(name, r"MP\d+-\d+-(\d+)", 1).cast("int")}


def long_enough(df: DataFrame, seconds: float, duration: str = "duration_s") -> DataFrame:
    return df.filter(F.col(duration) >= seconds)


def in_stage(df: DataFrame, split_def: DataFrame, stage: str, on: list[str]) -> DataFrame:
    """Keep rows whose (corpus, room, ...) is listed for a stage."""
    return df.join(split_def.filter(F.col("stage") == stage).select(*on).distinct(), on, "left_semi")


def not_named(names: list[str], col: str) -> Column:
    return ~F.col(col).isin(names)


def spoken(df: DataFrame, keep_empty: Column | bool = False, text: str = "text") -> DataFrame:
    keep = keep_empty if isinstance(keep_empty, Column) else F.lit(keep_empty)
    return df.filter(keep | (F.col(text) != ""))


def not_direct_path(path: str = "path") -> Column:
    return ~F.col(path).endswith("_dp.wav")


def of_types(col: str, wanted: list[str] | None) -> Column:
    """Type filter; None keeps everything."""
    return F.lit(True) if wanted is None else F.col(col).isin(wanted)


def in_id_range(col: str, lo: int, hi: int) -> Column:
    return F.col(col).between(lo, hi)


def drop_channels_from(df: DataFrame, first_dropped: int, ch: str = "ch") -> DataFrame:
    return df.filter(F.col(ch) < first_dropped)


def right_array_type(mic_id: str, type_id: str) -> Column:
    return F.concat(F.lit("01-"), F.col(mic_id).cast("string")) == F.col(type_id)


def items(recordings: DataFrame, pairs: DataFrame, mode: set[str] = frozenset(),
          array: str = "array_id") -> DataFrame:
    """Recordings times the pairs of their array, with a sampling weight.

    Only keys are expanded; samples join later. ``mode`` may hold 'duration' (weight by
    length), 'micpair' (every pair counts in full) and 'room' (rooms of a corpus count equally).
    """
    # an array's pairs are one row with as many entries as its microphones allow; they unfold after the join
    listed = pairs.groupBy(array).agg(F.array_sort(F.collect_list(F.struct("m1", "m2"))).alias("_pairs"))
    weight = F.col("duration_s") if "duration" in mode else F.lit(1.0)
    if "micpair" not in mode:
        weight = weight / F.size("_pairs")
    out = recordings.join(listed, array).withColumn("weight", weight)
    if "room" in mode:
        # a room's total comes from its recordings, before they unfold
        per_room = out.groupBy("corpus", "room").agg(F.sum(F.col("weight") * F.size("_pairs")).alias("_rw"))
        out = out.join(per_room, ["corpus", "room"]).withColumn("weight", F.col("weight") / F.col("_rw")).drop("_rw")
    return out.withColumn("_p", F.explode("_pairs")).select(*recordings.columns, "_p.m1", "_p.m2", "weight")


def corpus_hours(recordings: DataFrame, pairs: DataFrame, by: list[str], array: str = "array_id") -> DataFrame:
    """Hours of the files whose array has a pair, with subtotals; files are counted, not their pairs."""
    files = recordings.join(pairs.select(array).distinct(), array, "left_semi")
    return files.rollup(*by).agg(F.count(F.lit(1)).alias("n_files"),
                                 (F.sum("duration_s") / 3600.0).alias("hours"))


def files_to_rows(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """One wide row per group of single-channel files, channels in order.

    A group is one measurement: as many rows as the device has microphones.
    """
    packed = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*group).agg(F.transform(packed, lambda p: p[value]).alias(value))


def sheets(report: DataFrame, duration: str, item: str, rows: int) -> DataFrame:
    """The report with sheet_no: longest first, ``rows`` to a sheet; equal durations in order of ``item`` (whole numbers).

    Durations are counted first and placed by a running count over the distinct ones; the rows of one duration are
    then numbered in blocks of their own, so a usual duration is not one task.
    """
    counts = report.groupBy(duration).agg(F.count(F.lit(1)).alias("n")).withColumn("_down", -F.col(duration))
    # a second holds no more distinct durations than it has samples
    starts = scan(counts, [], ["_down"], F.floor("_down").cast("long"), {"_start": Agg("sum", F.col("n"), exclusive=True)}).select(duration, "_start")
    inside = row_index(with_row_blocks(report, [duration], item), [duration], [item], F.col("_cut"), "_n")
    placed = attach(inside, starts, [duration])
    return placed.withColumn("sheet_no", F.floor((F.col("_start") + F.col("_n")) / rows).cast("long")).select(*report.columns, "sheet_no")
