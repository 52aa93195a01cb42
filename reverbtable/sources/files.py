"""File readers for audio corpora and their annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reverbtable.functions.arrays import let
from reverbtable.sources import wav


def list_files(spark: SparkSession, root: str, ext: str = "wav") -> DataFrame:
    """Recursive listing with size and time; the content column is never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*.{ext}").load(root)
            .select("path", F.col("length"), F.col("modificationTime").alias("mtime")))


def wav_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Rate, channels and duration of every WAV file. Only the heads of files are read; a file whose header is not
    understood keeps its row with nulls and an error."""
    return wav.sized(wav.with_heads(list_files(spark, root).select("path", "length")))


def read_wav(spark: SparkSession, root: str, chunk: int = wav.PIECE) -> DataFrame:
    """Samples as chunk rows per channel, scaled to [-1, 1); a file that cannot be read is one row with an error."""
    return wav.read_chunks(spark, root, chunk)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Time tables; the file path tells the record."""
    return (spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)
            .withColumn("file", F.col("_metadata.file_path")))


def day_seconds() -> Column:
    return F.col("hour") * 3600.0 + F.col("minute") * 60.0 + F.col("second")


def read_ace_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV separated by comma and space; columns renamed and typed."""
    # fixed values: columns of the label file
    names = {"Mic config:": "array", "Room decode:": "room", "Room config:": "position", "Chan:": "ch",
             "FB T60:": "t60", "FB DRR:": "drr"}
    raw = spark.read.csv(path, sep=", ", header=True)
    typed = {"ch": "int", "t60": "double", "drr": "double"}
    return raw.select(*[F.col(f"`{c}`").cast(typed.get(n, "string")).alias(n) for c, n in names.items()])


def key_value_map(text: Column) -> Column:
    """Two-token lines to a map; the first character of a key is a marker and is dropped."""
    words = F.transform(F.split(text, "\r?\n"), lambda line: F.split(F.trim(line), r"\s+"))
    pairs = F.filter(words, lambda w: F.size(w) == 2)
    # a repeated key keeps its last value
    entries = F.transform(pairs, lambda w: F.struct(
        F.substr(F.get(w, F.lit(0)), F.lit(2)).alias("k"), F.get(w, F.lit(1)).alias("v")))
    last = let(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(
        F.slice(es, i + 2, F.size(es)), lambda o: o["k"] == e["k"])))
    return F.map_from_entries(last)


def read_key_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), key_value_map(F.col("value")).alias("m"))
    return text.select("file", *[F.col("m")[k].alias(k) for k in keys])


def read_session_json(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("samplerate INT").json(path, multiLine=True)
            .select(F.col("_metadata.file_path").alias("file"), "samplerate"))


def textgrid_intervals(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Intervals of a TextGrid in long form: keys, speaker (tier), st_s, en_s, text."""
    interval = r'intervals \[\d+\]:\s*xmin = ([0-9.eE+-]+)\s*xmax = ([0-9.eE+-]+)\s*text = "((?:[^"]|"")*)"'
    tiers = df.select(*keys, F.explode(let(F.split(F.col(text), r"item \[\d+\]:"), lambda s: F.slice(
        s, F.lit(2), F.size(s)))).alias("_t"))
    part = lambda g: F.regexp_extract_all(F.col("_t"), F.lit(interval), F.lit(g))
    rows = tiers.select(*keys, F.regexp_extract("_t", r'name = "([^"]*)"', 1).alias("speaker"),
                        F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("_i"))
    return rows.select(*keys, "speaker", F.col("_i.a").cast("double").alias("st_s"),
                       F.col("_i.b").cast("double").alias("en_s"), F.replace(F.col("_i.c"), F.lit('""'), F.lit('"')).alias("text"))


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), "value")
    return textgrid_intervals(files, ["session"], "value")


def nested_walk(df: DataFrame, keys: list[str], nested: str, axes: list[str], value: str = "h") -> DataFrame:
    """Nested arrays (room -> trajectory -> height -> point ...) to rows keyed by position."""
    out = df.select(*keys, F.col(nested).alias("_n"))
    for i, axis in enumerate(axes):
        out = out.select(*keys, *axes[:i], F.posexplode("_n").alias(axis, "_n2")).withColumnRenamed("_n2", "_n")
    return out.withColumnRenamed("_n", value)


def rir_set_checks(rirs: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """Is every response set complete and of one length?"""
    return rirs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ch"), F.countDistinct(F.size("h")).alias("n_lengths"), F.max(F.size("h")).alias("length")
    ).withColumn("complete", (F.col("n_ch") == channels) & (F.col("n_lengths") == 1))


def with_annotation(signals: DataFrame, annotation: DataFrame, stem: str = "stem", keep_all: bool = False) -> DataFrame:
    """Sidecar annotations by file stem."""
    return signals.join(annotation, stem, "left" if keep_all else "inner")


def apply_chain(df: DataFrame, transforms: list) -> DataFrame:
    """A list of DataFrame functions applied in order."""
    for fn in transforms:
        df = df.transform(fn)
    return df


def requested(df: DataFrame, outputs: str, keys: list[str]) -> DataFrame:
    """Only the labels named in a list such as 'TDOA-T60-DRR'; unknown names fail."""
    return df.select(*keys, *outputs.split("-"))
