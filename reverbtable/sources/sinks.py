"""Writers. Existing output is an error unless overwriting is asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Parquet under ``by`` folders. Rows of a folder are brought together and a large folder is split again by size
    (spark.sql.adaptive.advisoryPartitionSizeInBytes), so its files follow its bytes, whatever its records' keys."""
    (df.hint("rebalance", *by).write.mode("overwrite" if overwrite else "errorifexists")
     .partitionBy(*by).parquet(path))


def write_signals(df: DataFrame, path: str, **kw) -> None:
    write_partitioned(df, path, ["stage", "corpus"], **kw)


def write_rirs(df: DataFrame, path: str, **kw) -> None:
    write_partitioned(df, path, ["corpus", "room", "array"], **kw)


def write_scenarios(df: DataFrame, args: dict[str, str], path: str, overwrite: bool = False) -> None:
    """Scenario rows together with the arguments they were drawn with."""
    pairs = [F.lit(x) for kv in sorted(args.items()) for x in kv]
    (df.withColumn("args", F.create_map(*pairs)).write
     .mode("overwrite" if overwrite else "errorifexists").parquet(path))


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Report tables (raw, best, averaged, room configurations, durations) as CSV with header."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- sets of folders with a manifest ---------------------------------------------------------
#
# path/_runs/<run>/<by folders>/   rows, never changed once written
# path/_manifest/<version>/        per folder: run, rows and digest; valid once Spark has marked it as complete

RUNS, MANIFEST = "_runs", "_manifest"


def publish(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> DataFrame:
    """Replace the ``by`` folders that df has rows for, or add them; the others stay. Returns the new manifest.

    Rows go to a run of their own; then a manifest names, for every folder, its run, rows and digest. Readers see the
    old manifest until the new one is complete, so a run that is interrupted changes nothing and the same run again
    gives the same manifest. A folder that exists already is an error unless ``overwrite``, before anything is
    written; two runs at once do not both get the next version.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    version, old = _newest(spark, path)
    if old is not None and not overwrite:
        there = df.select(*by).distinct().join(old.select(*by), by).limit(1).collect()
        if there:
            raise FileExistsError(f"{path} exists for {there[0].asDict()}; ask for overwriting")
    to = f"{path}/{RUNS}/{run}"
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(to)
    made = _counted(_run(spark, path, run, df), by).withColumn("run", F.lit(run))
    if old is not None:
        made = made.unionByName(old.join(made.select(*by), by, "left_anti"))
    # as many rows as folders
    made.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{MANIFEST}/{version + 1:010d}")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Folders of the newest complete version: by columns, n_rows, digest."""
    _, rows = _newest(spark, path)
    if rows is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return rows.drop("run")


def published(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """All rows of the newest complete version. With ``check`` every folder's rows and digest are compared with the
    manifest first, in one pass over the data; a difference is an error."""
    _, rows = _newest(spark, path)
    if rows is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    by = [c for c in rows.columns if c not in ("n_rows", "digest", "run")]
    parts = None
    for run in sorted(r["run"] for r in rows.select("run").distinct().collect()):
        here = _run(spark, path, run).join(F.broadcast(rows.where(F.col("run") == run).select(*by)), by, "left_semi")
        parts = here if parts is None else parts.unionByName(here, allowMissingColumns=True)
    if check:
        found = _counted(parts, by)
        said = rows.drop("run")
        odd = said.exceptAll(found).union(found.exceptAll(said)).limit(1).collect()
        if odd:
            raise ValueError(f"{path} does not agree with its manifest at {odd[0].asDict()}")
    return parts


def clear_unused(spark: SparkSession, path: str) -> list[str]:
    """Delete the runs that the newest version does not name; only while nobody publishes or reads older versions."""
    _, rows = _newest(spark, path)
    kept = {r["run"] for r in rows.select("run").distinct().collect()} if rows is not None else set()
    fs, root = _hadoop(spark, f"{path}/{RUNS}")
    gone = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName() not in kept]
    for p in gone:
        fs.delete(p, True)
    return [p.getName() for p in gone]


def _run(spark: SparkSession, path: str, run: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read.schema(like.schema) if like is not None else spark.read
    return reader.parquet(f"{path}/{RUNS}/{run}")


def _counted(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and an order-free digest per folder: the sum of the rows' hashes over the columns by name."""
    rest = sorted(c for c in df.columns if c not in by)
    row = F.xxhash64(*[F.to_json(F.struct(c)) if _has_map(df, c) else F.col(c) for c in rest]).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).cast("string").alias("digest"))


def _has_map(df: DataFrame, c: str) -> bool:
    return "map<" in df.schema[c].dataType.simpleString()


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _newest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Highest version tried, and the manifest of the highest complete one."""
    fs, root = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(root):
        return 0, None
    names = sorted((s.getPath().getName() for s in fs.listStatus(root)), reverse=True)
    for name in names:
        done = spark._jvm.org.apache.hadoop.fs.Path(root, f"{name}/_SUCCESS")
        if fs.exists(done):
            return int(names[0]), spark.read.parquet(f"{path}/{MANIFEST}/{name}")
    return int(names[0]) if names else 0, None


# ---- reports ------------------------------------------------------------------------------------

# fixed values: columns of the three reports
RAW = ["Task", "FT", "ModelData", "Embed", "Trial(or Cross-Val)", "BS", "LR", "Val loss", "Val MAE", "Test loss", "Test MAE"]
BEST = ["FT", "TASK", "ModelData", "RoomNum(sim)", "DataNum(/epoch-real)", "Embed", "Trial(or Cross-Val)", "BS", "LR", "Val MAE", "Test MAE"]
AVERAGED = ["FT", "TASK", "ModelData", "RoomNum(sim)", "DataNum(/epoch-real)", "Embed", "Val MAE", "Test MAE"]


def write_reports(raw: DataFrame, best: DataFrame, averaged: DataFrame, path: str, overwrite: bool = False) -> None:
    """The three result reports as CSV folders raw, best and best_avgtri below path, with the reports' own headings.

    Columns are taken by position, in the order in which operators.evaluate.reports gives them.
    """
    for name, df, heads in (("raw", raw, RAW), ("best", best, BEST), ("best_avgtri", averaged, AVERAGED)):
        write_report(df.toDF(*heads), f"{path}/{name}", overwrite)
