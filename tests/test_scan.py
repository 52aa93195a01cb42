"""Blocked ordered operators against plain Python, with one hot key and odd partition counts."""

import random

import pytest
from pyspark.sql import functions as F

from reverbtable.functions.scan import Agg, asof, ewma, row_index, scan, time_block


def rows(seed=3, n=600):
    rng = random.Random(seed)
    out, seen = [], set()
    for i in range(n):
        key = 0 if rng.random() < 0.5 else rng.randint(1, 5)  # one key holds half of the rows
        t = rng.randint(0, 3000)
        if (key, t) not in seen:
            seen.add((key, t))
            out.append((key, t, i, float(rng.randint(-50, 50)) if rng.random() < 0.8 else None))
    return out


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("fan", [None, 4])
def test_scan_matches_loop(spark, parts, reverse, fan):
    data = rows()
    df = spark.createDataFrame(data, "k int, t long, i int, v double").repartition(parts)
    got = scan(df, ["k"], ["t"], time_block("t", 100), {
        "s": Agg("sum", F.col("v"), False, reverse), "c": Agg("count", None, True, reverse),
        "mx": Agg("max", F.col("v"), True, reverse), "mn": Agg("min", F.col("v"), False, reverse),
        "la": Agg("last", F.col("v"), True, reverse)}, fan=fan)
    got = {r.i: (r.s, r.c, r.mx, r.mn, r.la) for r in got.collect()}
    want = {}
    for key in {r[0] for r in data}:
        seen = []
        for _, t, i, v in sorted((r for r in data if r[0] == key), key=lambda r: r[1], reverse=reverse):
            past = [x for x in seen if x is not None]
            now = past + ([v] if v is not None else [])
            want[i] = (sum(now), len(seen), max(past, default=None), min(now, default=None), past[-1] if past else None)
            seen.append(v)
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [True, False])
def test_asof_matches_loop(spark, strict, forward):
    data = rows(5, 300)
    left = [(k, t + d, i) for k, t, i, _ in data for d in (0, 37)]
    right = spark.createDataFrame([(k, t, v) for k, t, _, v in data], "k int, t long, v double")
    out = asof(spark.createDataFrame(left, "k int, t long, i int"), right, ["k"], "t", ["v"], 100, strict, forward)
    got = {(r.k, r.t, r.i): (r.hit.t if r.hit else None) for r in out.collect()}
    assert len(got) == len(set(left))
    for k, t, i in left:
        if forward:
            hits = [u for kk, u, _, _ in data if kk == k and (u > t if strict else u >= t)]
            best = min(hits, default=None)
        else:
            hits = [u for kk, u, _, _ in data if kk == k and (u < t if strict else u <= t)]
            best = max(hits, default=None)
        assert got[(k, t, i)] == best


def test_row_index_is_dense(spark):
    df = row_index(spark.createDataFrame(rows(), "k int, t long, i int, v double"), ["k"], ["t"], time_block("t", 64))
    per = df.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c"), F.countDistinct("n").alias("d"))
    assert all(r.a == 0 and r.b == r.c - 1 and r.c == r.d for r in per.collect())


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.8])
def test_ewma_over_many_blocks(spark, alpha):
    n = 900  # with alpha 0.05 a block is 23 rows, with 0.8 it is 309
    xs = [random.Random(i).uniform(-5, 5) for i in range(n)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, n long, x double")
    got = {r.n: r.s for r in ewma(df, ["k"], "n", "x", alpha, "s").collect()}
    s = xs[0]
    for i, x in enumerate(xs):
        s = x if i == 0 else alpha * s + (1 - alpha) * x
        assert got[i] == pytest.approx(s, abs=1e-9)


def test_hot_key_join_is_splittable(spark):
    """Both inputs of a lookup join are plain exchanges, which skew handling needs."""
    from reverbtable.functions.scan import attach
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
        plan = attach(df, df.groupBy("k").agg(F.count("*").alias("c")), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = [x.strip(" :+-") for x in plan.splitlines()]
    sorts = [i for i, x in enumerate(lines) if x.startswith("Sort ")]
    assert len(sorts) == 2 and all(lines[i + 1].startswith("Exchange hashpartitioning(k") for i in sorts)
