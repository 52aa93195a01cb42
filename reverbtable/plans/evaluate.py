"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions.arrays import rnd
from reverbtable.functions.scan import ewma
from reverbtable.operators import evaluate as E
from reverbtable.plans.book import Book
from reverbtable.session import durable
from reverbtable.sources import tables as T
from reverbtable.sources.tables import load, r, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle


def rounded(df, keys, digits=6):
    return df.select(*keys, *[rnd(F.col(c), digits).alias(c) if t == "double" else F.col(c)
                              for c, t in df.dtypes if c not in keys])


@query("mse_mae", with_views("prediction", f"""SELECT task, {r('avg((pred-gt)*(pred-gt))')} AS mse, {r('avg(abs(pred-gt))')} AS mae
    FROM prediction GROUP BY 1"""))
def mse_mae(spark, sf):
    return rounded(E.loss_and_metric(T.predictions(spark, sf), ["task"]), ["task"])


@query("mse_mae_batches", f"""SELECT task, {r('avg(mse)')} AS mse, {r('avg(mae)')} AS mae FROM (
      SELECT l_returnflag AS task, l_orderkey // 128 AS b, avg((l_quantity*(1+l_discount)-l_quantity)*(l_quantity*(1+l_discount)-l_quantity)) AS mse,
        avg(abs(l_quantity*(1+l_discount)-l_quantity)) AS mae FROM lineitem GROUP BY ALL) GROUP BY 1""")
def mse_mae_batches(spark, sf):
    li = load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("task"), F.floor(F.col("l_orderkey") / 128).cast("long").alias("batch"),
        F.col("l_quantity").alias("gt"), (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("pred"))
    return rounded(E.loss_by_batch(li, ["task"], "batch"), ["task"])


@query("mean_baseline", with_views("prediction", f"""
    tr AS (SELECT task, avg(gt) AS m, min(gt) AS lo, max(gt) AS hi FROM prediction WHERE split = 'train' GROUP BY 1)
    SELECT task, {r('any_value(m)')} AS train_mean, any_value(lo) AS train_min, any_value(hi) AS train_max,
      {r("avg(abs(gt-m)) FILTER (split = 'train')")} AS train_mae, {r("avg(abs(gt-m)) FILTER (split = 'test')")} AS test_mae,
      min(gt) FILTER (split = 'test') AS test_min, max(gt) FILTER (split = 'test') AS test_max
    FROM prediction JOIN tr USING (task) GROUP BY task"""))
def mean_baseline(spark, sf):
    return rounded(E.mean_baseline(T.predictions(spark, sf)), ["task"])


BEST = lambda v: with_views("result", f"""m AS (SELECT task, lr, bs, round(avg({v}), 9) AS {v} FROM result GROUP BY ALL)
    SELECT task, lr, bs, {v} FROM m QUALIFY row_number() OVER (PARTITION BY task ORDER BY {v}, lr, bs) = 1""")


@query("best_config", BEST("val_mae"))
def best_config(spark, sf):
    return E.best_config(T.results(spark, sf), ["task"], "val_mae")


@query("best_config_by_loss", BEST("val_loss"))
def best_config_by_loss(spark, sf):
    return E.best_config(T.results(spark, sf), ["task"], "val_loss")


@query("best_per_trial", with_views("result", f"""b AS (SELECT * FROM result
      QUALIFY row_number() OVER (PARTITION BY task, trial ORDER BY val_loss, lr, bs) = 1)
    SELECT task, {r('avg(val_loss)')} AS val_loss, {r('avg(test_loss)')} AS test_loss, {r('avg(test_mae)')} AS test_mae, count(*) AS n_trials
    FROM b GROUP BY task"""))
def best_per_trial(spark, sf):
    return rounded(E.best_per_trial(T.results(spark, sf), ["task"]), ["task"])


@query("result_summary", with_views("result", f"""SELECT task, {r('avg(test_loss)')} AS mean_loss, {r('avg(test_mae)')} AS mean_mae,
    {r('min(test_mae)')} AS min_mae, {r('max(test_mae)')} AS max_mae FROM result GROUP BY 1"""))
def result_summary(spark, sf):
    return rounded(E.summary(T.results(spark, sf), ["task"]), ["task"])


@query("result_cube", """SELECT o_orderkey AS run, a::INTEGER AS lr_idx, b::INTEGER AS bs_idx, c::INTEGER AS trial, value FROM (
      SELECT o_orderkey, a, b, c, ((o_orderkey + a*3 + b*5 + c*7) % 4)::DOUBLE AS value FROM orders, range(0,2) x(a), range(0,3) y(b), range(0,2) z(c))
    WHERE value <> 0""")
def result_cube(spark, sf):
    """Nested [lr, bs, trial] matrices to rows; zeros are runs that never happened."""
    cell = lambda a, b, c: ((F.col("o_orderkey") + a * 3 + b * 5 + c * 7) % 4).cast("double")
    cube = F.array(*[F.array(*[F.array(*[cell(a, b, c) for c in range(2)]) for b in range(3)]) for a in range(2)])
    df = load(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), cube.alias("cube"))
    return E.cube_to_rows(df, ["run"], "cube")


SMOOTH = """sm AS (WITH RECURSIVE s(key, n, s) AS (SELECT key, n, x FROM series WHERE n = 0
      UNION ALL SELECT s.key, r.n, 0.8::DOUBLE*s.s + (1-0.8::DOUBLE)*r.x FROM s JOIN series r ON r.key = s.key AND r.n = s.n + 1)
    SELECT * FROM s)"""


@query("smooth", with_views("series", SMOOTH + f" SELECT key, n, {r('s')} AS smooth FROM sm"))
def smooth(spark, sf):
    return ewma(T.series(spark, sf), ["key"], "n", "x", 0.8, "smooth").select("key", "n", rnd(F.col("smooth")).alias("smooth"))


@query("running_loss", with_views("series", f"""sm AS (WITH RECURSIVE s(key, n, s) AS (SELECT key, n, (1-0.99::DOUBLE)*x FROM series WHERE n = 0
      UNION ALL SELECT s.key, r.n, 0.99::DOUBLE*s.s + (1-0.99::DOUBLE)*r.x FROM s JOIN series r ON r.key = s.key AND r.n = s.n + 1)
    SELECT * FROM s) SELECT key, n, {r('s/(1 - pow(0.99::DOUBLE, n+1))')} AS avg_loss FROM sm"""))
def running_loss(spark, sf):
    out = E.bias_corrected(T.series(spark, sf).select("key", "n", "x"), ["key"], "n", "x")
    return out.select("key", "n", rnd(F.col("avg_loss")).alias("avg_loss"))


@query("forgetting_norm", with_views("series", f"""fm AS (WITH RECURSIVE s(key, n, mu) AS (SELECT key, n, 2*x FROM series WHERE n = 0
      UNION ALL SELECT s.key, r.n, a*mu + (1-a)*x FROM s JOIN (
        SELECT *, CASE WHEN n <= 20 THEN (n-1)::DOUBLE/(n+1) ELSE 19.0::DOUBLE/21.0 END AS a FROM series) r ON r.key = s.key AND r.n = s.n + 1)
    SELECT * FROM s) SELECT key, n, {r('mu')} AS mu FROM fm"""))
def forgetting_norm(spark, sf):
    out = E.forgetting_mean(T.series(spark, sf).select("key", "n", "x"), ["key"], "n", "x", 20)
    return out.select("key", "n", rnd(F.col("mu")).alias("mu"))


STOP = SMOOTH + """,
  ep AS (SELECT key AS run, n + 1 AS epoch, round(s, 9) AS loss FROM sm),
  st AS (WITH RECURSIVE z(run, epoch, best, cnt, stops, stop1, stop2, best_epoch) AS (
      SELECT run, epoch, loss, 0, 0, NULL::BIGINT, NULL::BIGINT, epoch FROM ep WHERE epoch = 1
      UNION ALL SELECT run, epoch, CASE WHEN hit THEN loss ELSE best END, CASE WHEN hit OR (stop AND stops = 0) THEN 0 ELSE cnt + 1 END,
        stops + CASE WHEN stop THEN 1 ELSE 0 END, CASE WHEN stop AND stops = 0 THEN epoch ELSE stop1 END,
        CASE WHEN stop AND stops = 1 THEN epoch ELSE stop2 END, CASE WHEN hit THEN epoch ELSE best_epoch END
      FROM (SELECT z.run, e.epoch, e.loss, z.best, z.cnt, z.stops, z.stop1, z.stop2, z.best_epoch, e.loss <= z.best AS hit,
              NOT (e.loss <= z.best) AND z.cnt + 1 >= 10 AS stop
            FROM z JOIN ep e ON e.run = z.run AND e.epoch = z.epoch + 1 WHERE z.stops < 2))
    SELECT * FROM z),
  fin AS (SELECT run, stop1, stop2, best_epoch FROM st QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1)"""


def epochs(spark, sf):
    sm = ewma(T.series(spark, sf), ["key"], "n", "x", 0.8, "s")
    return sm.select(F.col("key").alias("run"), (F.col("n") + 1).alias("epoch"), F.round("s", 9).alias("loss"))


@query("early_stop", with_views("series", STOP + " SELECT run, stop1, stop2, best_epoch FROM fin"))
def early_stop(spark, sf):
    return E.early_stop(epochs(spark, sf), "run", "epoch", "loss", 10)


@query("ensemble_epochs", with_views("series", STOP + f""" SELECT run, count(*) AS n_epochs, {r('avg(loss)')} AS mean_loss
    FROM ep JOIN fin USING (run) WHERE epoch BETWEEN greatest(1, best_epoch - 4) AND best_epoch GROUP BY run"""))
def ensemble_epochs(spark, sf):
    ep = durable(epochs(spark, sf))
    kept = E.ensemble_epochs(ep, E.early_stop(ep, "run", "epoch", "loss", 10), "run", "epoch")
    return kept.groupBy("run").agg(F.count(F.lit(1)).alias("n_epochs"), rnd(F.avg("loss")).alias("mean_loss"))
