"""Weighted draws, splits, folds, quotas and scenario draws, all reproducible from hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions import acoustics as ac
from reverbtable.functions.arrays import let
from reverbtable.functions.draws import digest, pick_index, uniform, uniform_range
from reverbtable.functions.scan import BLOCK_ROWS, SLICE_ROWS, Agg, asof, attach, digest_block, row_index, scan, slices, spread


def shuffled_index(df: DataFrame, keys: list[str], seed: str, item: str, name: str = "n") -> DataFrame:
    """Position of every row in a seeded shuffle, per key or (no keys) over the whole table."""
    hashed = _sliced(df.withColumn("_h", digest(seed, item)), keys)
    return row_index(hashed, keys, ["_h", item], digest_block("_h", F.col("_slices")), name).drop("_h", "_slices")


def _sliced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add into how many slices of a seeded order a row's key is cut (or the table): one for all but large keys."""
    if not keys:
        return df.withColumn("_slices", slices(df))
    size = df.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / SLICE_ROWS) + 1).cast("long").alias("_slices"))
    return attach(df, size, keys)


def cdf(df: DataFrame, keys: list[str], weight: str, item: str, seed: str = "cdf") -> DataFrame:
    """Add the normalised cumulative weight in seeded order; the last row of a key is exactly 1.

    The seeded order spreads heavy and light items, so blocks stay even.
    """
    # totals and slices come from one pass per key, or one for the table
    aggs = [F.sum(weight).alias("_tot"), F.count(F.lit(1)).alias("_cnt")]
    w = df.withColumn("_h", digest(seed, item))
    if keys:
        w = attach(w, df.groupBy(*keys).agg(*aggs), keys)
    else:
        whole = df.agg(F.struct(*aggs).alias("_w")).scalar()
        w = w.withColumn("_w", whole).select(*df.columns, "_h", "_w._tot", "_w._cnt")
    cut = (F.floor(F.col("_cnt") / SLICE_ROWS) + 1).cast("long")
    run = scan(w, keys, ["_h", item], digest_block("_h", cut), {"_cum": Agg("sum", F.col(weight)), "_pos": Agg("count")})
    value = F.when(F.col("_pos") == F.col("_cnt"), F.lit(1.0)).otherwise(F.col("_cum") / F.col("_tot"))
    return run.withColumn("cdf", value).select(*df.columns, "cdf")


def draw(draws: DataFrame, item_cdf: DataFrame, keys: list[str], u: str, values: list[str]) -> DataFrame:
    """First item with cdf >= u for every draw.

    Both sides meet in slices of the unit interval, so an item that takes a third of all
    draws is spread over a third of the slices.
    """
    right = item_cdf.select(*keys, F.col("cdf").alias(u), *values)
    found = asof(draws, right, keys, u, values, block_width=F.lit(1.0) / slices(draws), strict=False, forward=True, out="_hit")
    return found.select(*draws.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def prefix_split(df: DataFrame, keys: list[str], seed: str, item: str, lo: float, hi: float) -> DataFrame:
    """Rows int(n*lo) .. int(n*hi)-1 of the seeded order of each key."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    pos = attach(shuffled_index(df, keys, seed, item, "pos"), size, keys)
    return pos.filter((F.col("pos") >= F.floor(F.col("_size") * lo))
                      & (F.col("pos") < F.floor(F.col("_size") * hi))).drop("_size")


def quota(df: DataFrame, keys: list[str], seed: str, item: str, ratio: Column, total: int) -> DataFrame:
    """First ceil(total*ratio) rows of each key in seeded order."""
    pos = shuffled_index(df, keys, seed, item, "pos")
    return pos.filter(F.col("pos") < F.ceil(F.lit(total) * ratio))


def crop_start(n: Column, want: Column, u: Column) -> Column:
    """Uniform start of a crop; both end positions are possible. 0 when too short."""
    return F.when(n > want, F.floor(u * (n - want + 1))).otherwise(0).cast("long")


def half_for_short(duration: Column, r0: Column, r1: Column, short_s: float = 10.0) -> tuple[Column, Column]:
    """Sub-range of a session; recordings below ``short_s`` use the half the range lies in."""
    first_half = (r0 + r1) / 2 < 0.5
    short = duration < short_s
    return (F.when(short, F.when(first_half, 0.0).otherwise(0.5)).otherwise(r0),
            F.when(short, F.when(first_half, 0.5).otherwise(1.0)).otherwise(r1))


def room_folds(rooms: DataFrame, room: str, seed: str) -> DataFrame:
    """Leave-one-room-out: a fold per test room with a random other room for validation.

    Training rooms are the rest, so a fold is stated by two rooms instead of R rows.
    """
    ranked = shuffled_index(rooms.select(room).distinct(), [], seed, room, "rank")
    n = rooms.select(F.countDistinct(room)).scalar()
    step = 1 + pick_index(n - 1, seed + ":val", room)
    folds = ranked.withColumn("val_rank", F.pmod(F.col("rank") + step, n)).withColumn("n_rooms", n)
    return (folds.join(ranked.select(F.col(room).alias("val_room"), F.col("rank").alias("val_rank")), "val_rank")
            .select(F.col("rank").alias("fold"), F.col(room).alias("test_room"), "val_room",
                    (F.col("n_rooms") - 2).alias("n_train_rooms")))


def fold_role(room: Column) -> Column:
    """Role of a record's room inside a fold row."""
    return (F.when(room == F.col("test_room"), "test").when(room == F.col("val_room"), "val")
            .otherwise("train"))


def range_split(room_idx: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    """Room-index ranges to split names; the upper bound is exclusive."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in bounds.items():
        out = F.when((room_idx >= lo) & (room_idx < hi), F.lit(name)).otherwise(out)
    return out


def trial_of(room: Column, nroom: int) -> Column:
    """Rooms are numbered from 1 and dealt to trials in runs of ``nroom``."""
    return F.floor((room - 1) / nroom).cast("long")


def trial_plan(nroom: Column) -> dict[str, Column]:
    return {"n_trials": F.greatest(F.lit(1), F.rint(32.0 / (nroom + 1e-3)).cast("int")),
            "n_records": nroom * 100}


def other_speaker(utts: DataFrame, seed: str, speaker: str = "speaker", utt: str = "utt_id") -> DataFrame:
    """One utterance of a different, uniformly drawn speaker for every utterance.

    Drawing among S-1 positions and stepping over the own one replaces redrawing until
    the speakers differ; nothing is paired and no draw is lost.
    """
    rows = utts.select(speaker, utt)
    ranks = shuffled_index(rows.select(speaker).distinct(), [], seed, speaker, "rank")
    n = rows.select(F.countDistinct(speaker)).scalar()
    size = rows.groupBy(speaker).agg(F.count(F.lit(1)).alias("size"))
    catalogue = ranks.join(size, speaker).select(F.col(speaker).alias("speaker_b"), F.col("rank").alias("rank_b"),
                                                 F.col("size").alias("size_b"))
    j = pick_index(n - 1, seed + ":spk", utt)
    want = (attach(rows, ranks, [speaker])
            .withColumn("rank_b", j + F.when(j >= F.col("rank"), 1).otherwise(0))
            .join(catalogue, "rank_b")
            .withColumn("pos_b", pick_index(F.col("size_b"), seed + ":utt", utt)))
    listed = shuffled_index(rows, [speaker], seed + ":list", utt, "pos_b").select(
        F.col(speaker).alias("speaker_b"), F.col(utt).alias(f"{utt}_b"), "pos_b")
    return want.join(listed, ["speaker_b", "pos_b"]).select(speaker, utt, "speaker_b", f"{utt}_b")


def distinct_positions(n: Column, k: int, seed: str, *ids: str | Column) -> Column:
    """k different positions below n as an array, every set equally likely: for each j of the last k positions a draw
    up to j, or j itself where that draw is taken already. Fewer than k positions are an error."""
    def add(taken, i):
        j = n - k + i
        return let(F.floor(uniform(seed, *ids, i) * (j + 1)).cast("long"), lambda t: F.concat(
            taken, F.array(F.when(F.array_contains(taken, t), j).otherwise(t))))

    none = F.array().cast("array<long>")
    drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), none, add) if k else none
    short = F.raise_error(F.concat(F.lit(f"{k} different positions are asked of "), n.cast("string"))).cast("array<long>")
    return F.when(n >= k, drawn).otherwise(short)


def speakers_mix(utts: DataFrame, k: int, seed: str, speaker: str = "speaker", utt: str = "utt_id") -> DataFrame:
    """k utterances of k different speakers for every utterance: speaker, utt_id, slot, speaker_b, utt_id_b.

    Slot 0 is the utterance itself. The others are drawn as distinct positions among the other speakers, in the row;
    an utterance of each is then looked up by a drawn position. Nothing is paired and nothing is drawn again.
    """
    rows = utts.select(speaker, utt)
    ranks = shuffled_index(rows.select(speaker).distinct(), [], seed, speaker, "rank")
    n = rows.select(F.countDistinct(speaker)).scalar()
    size = rows.groupBy(speaker).agg(F.count(F.lit(1)).alias("size_b"))
    catalogue = ranks.join(size, speaker).select(F.col(speaker).alias("speaker_b"), F.col("rank").alias("rank_b"), "size_b")
    drawn = distinct_positions(F.col("_n"), k - 1, seed + ":spk", utt)
    asked = attach(rows, ranks, [speaker]).withColumn("_n", n - 1).select(speaker, utt, "rank", F.posexplode(drawn).alias("_i", "_j"))
    want = asked.select(speaker, utt, (F.col("_i") + 1).alias("slot"), (F.col("_j") + F.when(F.col("_j") >= F.col("rank"), 1).otherwise(0)).alias("rank_b"))
    want = attach(want, catalogue, ["rank_b"]).withColumn("pos_b", pick_index(F.col("size_b"), seed + ":utt", utt, F.col("slot")))
    listed = shuffled_index(rows, [speaker], seed + ":list", utt, "pos_b").select(
        F.col(speaker).alias("speaker_b"), F.col(utt).alias(f"{utt}_b"), "pos_b")
    others = want.join(listed, ["speaker_b", "pos_b"]).select(speaker, utt, "slot", "speaker_b", f"{utt}_b")
    return rows.select(speaker, utt, F.lit(0).alias("slot"), F.col(speaker).alias("speaker_b"), F.col(utt).alias(f"{utt}_b")).union(others)


def match_one(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
              seed: str) -> DataFrame:
    """One hash-drawn right row per left row of the same key; null where the key has none.

    The drawn position is part of the join key, so a key with m x n rows yields m, not m*n.
    """
    size = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    want = attach(left, size, keys, "left").withColumn("_pos", pick_index(F.col("_size"), seed, left_id))
    listed = shuffled_index(right.select(*keys, right_id), keys, seed + ":list", right_id, "_pos")
    return want.join(listed, [*keys, "_pos"], "left").select(*left.columns, right_id)


def concat_plan(utts: DataFrame, want: int, speaker: str = "speaker", utt: str = "utt_id",
                length: str = "n") -> DataFrame:
    """Which utterances of the same speaker follow each utterance until ``want`` samples are
    reached, wrapping round: start utterance, position, used utterance, sample offset.

    Utterances sit at their cumulative offset; a start asks for offsets in
    [own, own + want). Offsets and requests meet in bins of width ``want``.
    """
    run = scan(utts.select(speaker, utt, length), [speaker], [utt], F.floor(F.col(utt) / BLOCK_ROWS).cast("long"),
               {"at": Agg("sum", F.col(length), exclusive=True)})
    total = utts.groupBy(speaker).agg(F.sum(length).alias("total"))
    run = attach(run, total, [speaker])
    binned = run.select(speaker, F.col(utt).alias("used"), F.col("at").alias("used_at"),
                        F.floor(F.col("at") / want).cast("long").alias("bin"))
    # a speaker without a sample has nothing to ask for
    lap = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.try_divide(F.col("at") + want - 1, F.col("total"))).cast("long")))
    asks = run.withColumn("lap", lap).select(
        speaker, F.col(utt).alias("start"), "at", "total", "lap",
        F.greatest(F.col("at") - F.col("lap") * F.col("total"), F.lit(0)).alias("lo"),
        F.least(F.col("at") + want - F.col("lap") * F.col("total"), F.col("total")).alias("hi"))
    asks = asks.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / want).cast("long"),
                                                       F.floor((F.col("hi") - 1) / want).cast("long"))))
    met = asks.join(binned, [speaker, "bin"]).filter(
        (F.col("used_at") >= F.col("lo")) & (F.col("used_at") < F.col("hi")))
    return met.select(speaker, "start", "used",
                      (F.col("used_at") + F.col("lap") * F.col("total") - F.col("at")).alias("offset"))


def concat_signals(plan: DataFrame, signals: DataFrame, want: int, seed: str | None = None) -> DataFrame:
    """Build the signals of a plan: up to want + one utterance samples per start, or with a seed a random crop of
    want samples of that (ends included)."""
    parts = plan.join(signals.select(F.col("sig_id").alias("used"), "x"), "used")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "x"))), lambda p: p["x"]))
    out = parts.groupBy("start").agg(whole.alias("x"))
    if seed is None:
        return out
    at = crop_start(F.size("x"), F.lit(want), uniform(seed, "start"))
    return out.select("start", F.slice("x", (at + 1).cast("int"), F.lit(want)).alias("x"))


def mixed_origins(real: DataFrame, simulated: DataFrame, use: tuple[bool, bool], weight: str = "weight") -> DataFrame:
    """Real records, simulated ones, or both in one list with a column origin; each origin in use carries an equal
    part of the total weight. Using neither is an error."""
    sides = [(df, name) for df, name, on in ((real, "real", use[0]), (simulated, "simulated", use[1])) if on]
    if not sides:
        raise ValueError("use real records, simulated ones or both")
    parts = [df.withColumn("origin", F.lit(name)).withColumn(
        weight, F.lit(1.0 / len(sides)) / df.select(F.count(F.lit(1))).scalar()) for df, name in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


# ---- scenarios ------------------------------------------------------------------------

WEIGHT_NAMES = ("x0", "x1", "y0", "y1", "z0", "z1")


def scenarios(ids: DataFrame, key: str, seed: str, room_range: dict, t60_range: tuple, weight_range: tuple,
              attempts: int = 16, ism_db: float = 12.0, c: float = ac.SOUND_SPEED) -> DataFrame:
    """Room size, wanted T60 and wall weights per id, redrawn until physically feasible.

    Redraws are candidates inside the row and the first feasible one wins. If none of
    them is, T60 is drawn inside the interval that is feasible for the last weights, so no
    row depends on the number of attempts; a room without such an interval gives null.
    """
    dims = {k: uniform_range(*room_range[k], f"{seed}:{k}", key) for k in ("lx", "ly", "lz")}
    # ids are narrow and the draws heavy: spread them whatever the input file layout
    rooms = spread(ids.select(key)).select(key, *[v.alias(k) for k, v in dims.items()])
    size = {k: F.col(k) for k in dims}

    def candidate(i):
        t60 = uniform_range(*t60_range, f"{seed}:t60", F.col(key), i)
        ws = [uniform_range(*weight_range, f"{seed}:w:{w}", F.col(key), i) for w in WEIGHT_NAMES]
        return F.struct(i.alias("attempt"), t60.alias("t60"), F.array(*ws).alias("w"))

    def judged(cand):
        ws = [F.get(cand["w"], F.lit(k)) for k in range(6)]
        top = F.greatest(*ws)
        unit = let(top, lambda m: F.transform(cand["w"], lambda v: v / m))

        def solve(un):
            alpha = [F.get(un, F.lit(k)) for k in range(6)]
            return let(ac.wall_absorption(**size, walls=alpha), lambda area: let(
                F.least(F.lit(1.0), ac.SABINE * ac.volume(**size) / (cand["t60"] * area)),
                lambda x: verdict(un, area, x)))

        def verdict(un, area, x):
            shortest = F.greatest(ac.SABINE * ac.volume(**size) / area,
                                  3.0 * ac.norm(*size.values()) / F.lit(c * ism_db / 60.0),
                                  F.lit(float(t60_range[0])))
            walls = [x * F.get(un, F.lit(k)) for k in range(6)]
            return F.struct(cand["attempt"].alias("attempt"), cand["t60"].alias("t60"), x.alias("x"),
                            shortest.alias("shortest"), area.alias("area"),
                            ac.t60_feasible(**size, t60=cand["t60"], walls=walls, c=c, ism_db=ism_db).alias("ok"))

        return let(unit, solve)

    tries = F.transform(F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), candidate), judged)
    choice = let(tries, lambda t: F.struct(F.get(F.filter(t, lambda v: v["ok"]), F.lit(0)).alias("first"),
                                           F.element_at(t, -1).alias("last")))
    picked = rooms.withColumn("choice", choice).select(key, *size, "choice.first", "choice.last")
    spare = F.when(F.col("last.shortest") < t60_range[1],
                   uniform_range(F.col("last.shortest"), float(t60_range[1]), f"{seed}:spare", key))
    out = picked.select(key, *size, F.col("first.attempt").alias("attempt"),
                        F.coalesce(F.col("first.t60"), spare).alias("t60"),
                        F.when(F.col("first").isNotNull(), F.col("first.x"))
                        .otherwise(ac.SABINE * ac.volume(**size) / (spare * F.col("last.area"))).alias("x"))
    return out


def placements(rooms: DataFrame, key: str, seed: str, ratio: tuple = (0.3, 0.7), margin: float = 0.3,
               scale: tuple = (0.5, 1.0), rot: tuple = (-90.0, 90.0), snr: tuple = (15.0, 30.0)) -> DataFrame:
    """Array position, rotation and scale, source position with a wall margin, and SNR."""
    cols = {}
    for a in "xyz":
        length = F.col(f"l{a}")
        cols[f"array_{a}"] = uniform_range(length * ratio[0], length * ratio[1], f"{seed}:array:{a}", key)
        cols[f"src_{a}"] = uniform_range(F.lit(margin), length - margin, f"{seed}:src:{a}", key)
    cols["array_rot"] = uniform_range(*rot, f"{seed}:rot", key)
    cols["array_scale"] = uniform_range(*scale, f"{seed}:scale", key)
    cols["snr"] = uniform_range(*snr, f"{seed}:snr", key)
    return rooms.withColumns(cols)


def trajectory(scenes: DataFrame, key: str, seed: str, margin: float = 0.3, n_points: Column | None = None,
               step: float = 0.1) -> DataFrame:
    """Moving source: a straight line between two drawn points plus a sinusoid per axis.

    Points are counted by ``n_points`` or, if None, one per ``step`` metres of the line.
    """
    ends = {}
    for a in "xyz":
        hi = F.col(f"l{a}") - margin
        ends[f"p{a}"] = uniform_range(F.lit(margin), hi, f"{seed}:from:{a}", key)
        ends[f"q{a}"] = uniform_range(F.lit(margin), hi, f"{seed}:to:{a}", key)
    s = scenes.select(key, "lx", "ly", "lz").withColumns(ends)
    line = ac.norm(*[F.col(f"q{a}") - F.col(f"p{a}") for a in "xyz"])
    count = n_points if n_points is not None else F.floor(line / step) + 1
    s = s.withColumn("n_points", count.cast("int"))
    swing = {}
    for a in "xyz":
        p, q, hi = F.col(f"p{a}"), F.col(f"q{a}"), F.col(f"l{a}") - margin
        room_left = F.least(p - margin, hi - p, q - margin, hi - q, F.lit(1.0))
        swing[f"a{a}"] = uniform(f"{seed}:amp:{a}", key) * room_left
        swing[f"w{a}"] = F.lit(4 * math.pi) * uniform(f"{seed}:osc:{a}", key) / F.col("n_points")
    s = s.withColumns(swing).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_points") - 1)))
    frac = F.col("k") / F.greatest(F.col("n_points") - 1, F.lit(1))
    at = {a: F.col(f"p{a}") + (F.col(f"q{a}") - F.col(f"p{a}")) * frac
          + F.col(f"a{a}") * F.sin(F.col(f"w{a}") * F.col("k")) for a in "xyz"}
    return s.select(key, "k", *[v.alias(a) for a, v in at.items()])


def scenario_grid(rooms: DataFrame, room: str, n_rir: Column, n_sig: Column, seed: int) -> DataFrame:
    """Rooms x responses x signals with a consecutive seed per room, generated inside each row."""
    return (rooms.withColumn("rir", F.explode(F.sequence(F.lit(0), n_rir.cast("int") - 1)))
            .withColumn("sig", F.explode(F.sequence(F.lit(0), n_sig.cast("int") - 1)))
            .withColumn("seed", F.lit(seed) + (F.col(room) * n_rir + F.col("rir")) * n_sig + F.col("sig")))
