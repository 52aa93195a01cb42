"""Streaming forms of the batch operators. Each function takes a streaming (or batch) frame."""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reverbtable.sources import files, wav

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def block_energy(df: DataFrame, key: str, ts: str, value: str, block: str = "10 minutes",
                 late: str = "1 hour") -> DataFrame:
    """Energy and size per tumbling block; rows later than the watermark may be dropped."""
    return (df.withWatermark(ts, late).groupBy(key, F.window(ts, block).alias("_w"))
            .agg(F.sum(F.col(value) * F.col(value)).alias("energy"), F.count(F.lit(1)).alias("n"))
            .select(key, F.col("_w.start").alias("start"), "energy", "n"))


def activity_sessions(df: DataFrame, key: str, ts: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Stretches of activity separated by at least ``gap`` of silence."""
    return (df.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("_w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n"))


def fold(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """s = alpha*s + (1-alpha)*x along x, from start or (None) from the first value.

    A running sum of x scaled by alpha^-i, in blocks over which alpha^i stays far from zero.
    """
    if alpha <= 0 or not len(x):
        return np.array(x, float)
    s, out = float(x[0]) if start is None else float(start), np.empty(len(x))
    size = len(x) if alpha >= 1 else max(1, int(-60 / np.log(alpha)))
    for lo in range(0, len(x), size):
        part = x[lo:lo + size]
        decay = alpha ** np.arange(1, len(part) + 1)
        out[lo:lo + size] = decay * (s + (1 - alpha) * np.cumsum(part / decay))
        s = out[lo + len(part) - 1]
    return out


class Smoother(StatefulProcessor):
    """One double per key; a timer in event time forgets it when the key has been silent for long enough."""

    def __init__(self, alpha: float, quiet_ms: int):
        self.alpha, self.quiet_ms = alpha, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("smooth", "s double")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values("ms", kind="stable")
        start = self.state.get()[0] if self.state.exists() else None
        smooth = fold(batch["x"].to_numpy(float), self.alpha, start)
        self.state.update((float(smooth[-1]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["ms"].iloc[-1]) + self.quiet_ms)
        yield pd.DataFrame({"key": key[0], "t": batch["t"].to_numpy(), "smooth": smooth})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_smoother(df: DataFrame, key: str, ts: str, value: str, alpha: float = 0.8, late: str = "1 hour",
                     quiet_s: float = 86400.0) -> DataFrame:
    """s = alpha*s + (1-alpha)*x per key over event order: key, t, smooth.

    The state of a key is one double. It is forgotten once the watermark (``late`` behind the newest row of all) is
    ``quiet_s`` past the key's last row; the key then starts anew. Rows of a key are ordered within a micro-batch, so
    the source's trigger limit bounds what is held. Needs the RocksDB state store, which is set here.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active  # starts the coordinator of state stores, which a batch frame would go without
    out = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("t", df.schema[ts].dataType),
                        T.StructField("smooth", T.DoubleType())])
    # worker names cannot start with an underscore
    rows = df.withWatermark(ts, late).select(F.col(key).alias("k"), F.col(ts).alias("t"), F.unix_millis(
        F.col(ts).cast("timestamp")).alias("ms"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("k").transformWithStateInPandas(Smoother(alpha, int(quiet_s * 1000)), out, "Append", "EventTime")


# ---- catalogue of arriving files ----------------------------------------------------------------

def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, ext: str = "wav"):
    """Add newly arrived files with their heads to the catalogue and stop when all are taken.

    Each micro-batch is one folder named after its number and replaces what an earlier try of it left, so a batch that
    runs twice changes nothing. A file that cannot be read keeps its row, with an error.
    """
    found = (spark.readStream.format("binaryFile")
             .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*.{ext}").load(root)
             .select("path", "length", F.col("modificationTime").alias("mtime")))

    def put(batch: DataFrame, number: int) -> None:
        wav.with_heads(batch).write.mode("overwrite").parquet(f"{out}/batch=s{number:012d}")

    return (found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def refresh(spark: SparkSession, root: str, out: str, ext: str = "wav") -> int:
    """Bring the catalogue up to date with a listing: files that are new or have another time or length are read and
    added. Returns how many; a second call finds none. A stream alone never looks at a path twice."""
    listed = files.list_files(spark, root, ext)
    try:
        known = spark.read.parquet(out).select("path", "length", "mtime")
    except AnalysisException:  # no catalogue yet
        known = listed.limit(0)
    fresh = listed.join(known, ["path", "length", "mtime"], "left_anti")
    name = f"batch=r{uuid.uuid4().hex}"
    wav.with_heads(fresh).write.parquet(f"{out}/{name}")
    return spark.read.schema("path string").parquet(f"{out}/{name}").count()


def catalogue(spark: SparkSession, out: str) -> DataFrame:
    """The current row of every path: the latest time, the last batch where times agree. Equal rows count once."""
    rows = spark.read.parquet(out)
    kept = [c for c in rows.columns if c not in ("path", "batch")]
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*kept), F.struct("mtime", "batch")).alias("_r"))
    return wav.sized(latest.select("path", "_r.*"))
