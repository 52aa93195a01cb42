"""Losses, baselines, smoothing, early stopping and model choice on metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions.scan import BLOCK_ROWS, Agg, attach, ewma, scan
from reverbtable.session import durable


def _block(n: str) -> Column:
    return F.floor(F.col(n) / BLOCK_ROWS).cast("long")


def loss_and_metric(df: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Mean squared error and mean absolute error."""
    d = F.col(pred) - F.col(gt)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def loss_by_batch(df: DataFrame, by: list[str], batch: str) -> DataFrame:
    """Mean of batch means: a short batch weighs as much as a full one."""
    return loss_and_metric(df, [*by, batch]).groupBy(*by).agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))


def mean_baseline(df: DataFrame, task: str = "task", split: str = "split", gt: str = "gt") -> DataFrame:
    """Error of always predicting the training mean, per task.

    Two partial aggregations. The second one only needs per-task (value -> count) totals, so
    rows are folded by value before they meet the mean, and no hot task is joined row by row.
    """
    train = F.col(split) == "train"
    stats = df.filter(train).groupBy(task).agg(F.avg(gt).alias("train_mean"), F.min(gt).alias("train_min"),
                                               F.max(gt).alias("train_max"))
    folded = df.groupBy(task, split, gt).agg(F.count(F.lit(1)).alias("_c"))
    err = F.abs(F.col(gt) - F.col("train_mean")) * F.col("_c")
    mae = lambda cond: F.sum(F.when(cond, err)) / F.sum(F.when(cond, F.col("_c")))
    return (attach(folded, stats, [task]).groupBy(task)
            .agg(F.first("train_mean").alias("train_mean"), F.first("train_min").alias("train_min"),
                 F.first("train_max").alias("train_max"), mae(train).alias("train_mae"),
                 mae(~train).alias("test_mae"),
                 F.min(F.when(~train, F.col(gt))).alias("test_min"), F.max(F.when(~train, F.col(gt))).alias("test_max")))


def best_config(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """(lr, bs) with the lowest mean over trials; ties go to the first in (lr, bs) order."""
    mean = results.groupBy(*by, "lr", "bs").agg(F.round(F.avg(value), 9).alias(value))
    return (mean.groupBy(*by).agg(F.min(F.struct(value, "lr", "bs")).alias("_b"))
            .select(*by, "_b.lr", "_b.bs", f"_b.{value}"))


def best_per_trial(results: DataFrame, by: list[str], trial: str = "trial") -> DataFrame:
    """Lowest validation loss inside each trial, then the mean of those runs over trials."""
    pick = F.min(F.struct("val_loss", "lr", "bs", "test_loss", "test_mae"))
    return (results.groupBy(*by, trial).agg(pick.alias("_b")).groupBy(*by)
            .agg(F.avg("_b.val_loss").alias("val_loss"), F.avg("_b.test_loss").alias("test_loss"),
                 F.avg("_b.test_mae").alias("test_mae"), F.count(F.lit(1)).alias("n_trials")))


def reports(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw, best and best-averaged rows of runs: task, ft, model_data, num, embed, trial, bs, lr, val_loss, val_mae,
    test_loss, test_mae.

    Raw: every run. Best: per trial the run of lowest validation loss (ties: first in (lr, bs) order), with the number
    of rooms for simulated data named <name>R<rooms> and the records per epoch for real data, else "invalid".
    Averaged: the best runs' metrics, mean over trials.
    """
    raw = results.select("task", "ft", "model_data", "embed", "trial", "bs", "lr", "val_loss", "val_mae", "test_loss", "test_mae")
    name = F.col("model_data")
    rooms = F.regexp_extract(name, r"^[^R]*R(\d+)$", 1)
    named = name.contains("sim") & (rooms != "")
    shown = results.withColumns({
        "room_num": F.when(named, rooms).otherwise("invalid"),
        "data_num": F.when(name.contains("real"), F.col("num").cast("string")).otherwise("invalid"),
        "model_data": F.when(named, F.regexp_extract(name, r"^([^R]*)R\d+$", 1)).otherwise(name)})
    by = ["ft", "task", "model_data", "room_num", "data_num", "embed"]
    pick = F.min(F.struct("val_loss", "lr", "bs", "val_mae", "test_mae"))
    best = shown.groupBy(*by, "trial").agg(pick.alias("_b")).select(*by, "trial", "_b.bs", "_b.lr", "_b.val_mae", "_b.test_mae")
    averaged = best.groupBy(*by).agg(F.avg("val_mae").alias("val_mae"), F.avg("test_mae").alias("test_mae"))
    return raw, best, averaged


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(
        F.avg("test_loss").alias("mean_loss"), F.avg("test_mae").alias("mean_mae"),
        F.min("test_mae").alias("min_mae"), F.max("test_mae").alias("max_mae"))


def cube_to_rows(df: DataFrame, keys: list[str], cube: str, axes: tuple = ("lr_idx", "bs_idx", "trial"),
                 value: str = "value") -> DataFrame:
    """Nested [lr, bs, trial] arrays as rows; zero means not run and gives no row."""
    out = df.select(*keys, F.posexplode(cube).alias(axes[0], "_a"))
    out = out.select(*keys, axes[0], F.posexplode("_a").alias(axes[1], "_b"))
    out = out.select(*keys, axes[0], axes[1], F.posexplode("_b").alias(axes[2], value))
    return out.filter(F.col(value) != 0)


def bias_corrected(df: DataFrame, keys: list[str], n: str, x: str, beta: float = 0.99) -> DataFrame:
    """Running average from zero, divided by 1 - beta^(n+1)."""
    run = ewma(df, keys, n, x, beta, "_m", first_counts_full=False)
    return run.withColumn("avg_loss", F.col("_m") / (1.0 - F.pow(F.lit(beta), F.col(n) + 1.0))).drop("_m")


def forgetting_mean(df: DataFrame, keys: list[str], n: str, x: str, horizon: int) -> DataFrame:
    """mu_t = a*mu_{t-1} + (1-a)*x_t with a = (t-1)/(t+1) up to the horizon, constant after it.

    Up to the horizon this is 2*sum(k*x_k)/(t*(t+1)) (and 2*x_0 at t = 0); after it an
    exponential average that starts from the horizon's mean.
    """
    t = F.col(n).cast("double")
    run = scan(df, keys, [n], _block(n), {"_kx": Agg("sum", t * F.col(x))})
    early = F.when(F.col(n) == 0, 2.0 * F.col(x)).otherwise(2.0 * F.col("_kx") / (t * (t + 1)))
    head = run.withColumn("_mu", early)
    a = (horizon - 1.0) / (horizon + 1.0)
    tail = (head.filter(F.col(n) >= horizon)
            .select(*keys, (F.col(n) - horizon).alias("_j"), F.when(F.col(n) == horizon, F.col("_mu")).otherwise(F.col(x)).alias("_x")))
    late = ewma(tail, keys, "_j", "_x", a, "mu").select(*keys, (F.col("_j") + horizon).alias(n), "mu")
    return (head.filter(F.col(n) < horizon).select(*keys, n, F.col("_mu").alias("mu")).unionByName(late))


def early_stop(df: DataFrame, run: str, epoch: str, loss: str, patience: int = 10) -> DataFrame:
    """Epochs where training would slow down (stop1) and end (stop2), and the best epoch.

    An epoch is best when its loss is not above any earlier one, so the last best epoch is the
    running minimum of (loss, -epoch). The counter is n - last best, restarted once at stop1;
    both stops are minima over running values and no sequential fold is needed.
    """
    best_so_far = F.struct(F.col(loss).alias("l"), (-F.col(epoch)).alias("e"))
    run_min = scan(df.select(run, epoch, loss), [run], [epoch], _block(epoch), {"_b": Agg("min", best_so_far)})
    # three aggregations read this: keep it instead of scanning three times
    last = durable(run_min.select(run, epoch, (-F.col("_b.e")).alias("_last"))
                   .withColumn("_is_best", F.col("_last") == F.col(epoch)))
    n = F.col(epoch)
    stop1 = last.groupBy(run).agg(F.min(F.when(n - F.col("_last") >= patience, n)).alias("stop1"))
    second = attach(last, stop1, [run])
    since = n - F.greatest("_last", "stop1")
    stop2 = second.groupBy(run).agg(
        F.first("stop1").alias("stop1"),
        F.min(F.when((n > F.col("stop1")) & ~F.col("_is_best") & (since >= patience), n)).alias("stop2"))
    best = attach(last, stop2, [run]).filter(F.col("_is_best") & (F.col("stop2").isNull() | (n <= F.col("stop2"))))
    return best.groupBy(run).agg(F.first("stop1").alias("stop1"), F.first("stop2").alias("stop2"),
                                 F.max(n).alias("best_epoch"))


def ensemble_epochs(metrics: DataFrame, best: DataFrame, run: str, epoch: str, width: int = 5) -> DataFrame:
    """The best epoch and the ones just before it."""
    return attach(metrics, best.select(run, "best_epoch"), [run]).filter(
        F.col(epoch).between(F.greatest(F.lit(1), F.col("best_epoch") - (width - 1)), F.col("best_epoch")))


def record_targets(segments: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """One target per record: segment labels averaged, then transformed."""
    return segments.groupBy(key).agg(*[F.avg(v).alias(k) for k, v in values.items()])
