"""Prefix trie of conversations: one ROLLUP over positional columns of turn ids counts all prefixes of all lengths.

A conversation is cut into blocks of eight turns. A row per block holds the turns' ids in positional columns and the
node that the block continues; GROUP BY that node, ROLLUP (t0, ..., t7) with grouping_id then gives every prefix of
every block at once, so long conversations need no second pass. A node is known by the sum of digests of (position,
turn) along its path, in four lanes of 32 bits: sums of a prefix are running sums, whatever the conversation's length.

Sums over subtrees need no walk either. A node belongs to its smallest member, and what a conversation owns is the end
of its path from some depth on; so leaves and distinct turns below a node are plain sums over its members of what each
owns, which a second ROLLUP takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reverbtable.functions.scan import Agg, attach, scan
from reverbtable.llm.book import query, table
from reverbtable.session import written

WIDTH = 8             # turns per block
RUN = 4096            # turn numbers, blocks or conversation ids that are put in order at once
HOT = 512             # a parent of more than one in so many nodes is looked up by broadcast: fewer than so many rows
TURNS = [f"t{k}" for k in range(WIDTH)]
LANES = ["s1", "s2", "s3", "s4"]
LOW = 0xFFFFFFFF


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes: a digest of role and text, and the text's code points; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))


def ordered(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, pos (from 0), turn_id: turns by number, null first; turns of one number by their digest.

    Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A
    conversation that holds most turns is numbered in runs of turn numbers, so it isn't sorted in one task; the turns
    of one number in one conversation are.
    """
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("turn_id"))
    alike = rows.groupBy("conv_id", "turn", "turn_id").agg(F.count("*").alias("n"))
    run = F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 60))).cast("long")
    placed = scan(alike, ["conv_id"], ["turn", "turn_id"], run, {"before": Agg("sum", F.col("n"), exclusive=True)})
    return placed.select("conv_id", "turn_id", F.explode(F.sequence("before", F.expr("before + n - 1"))).alias("pos"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of turns(conv_id, pos, turn_id) of the conversations in convs(conv_id, one row each).

    conv_id is the node's smallest member, parent_conv_id that of its parent (null for the root); depth, n_convs
    (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens (code points that sharing saves in
    the subtree), ends_sha256 (digest of the members that end here). Positions must be gapless from 0. Conversations
    without turns are members of the root; no conversations give no nodes.
    """
    paths = written(_blocks(turns, convs), "paths")
    nodes = written(_nodes(_rollup(paths, "min(conv_id) AS owner")), "nodes")
    children = nodes.where("depth > 0").groupBy("up1", "up2").agg(F.count("*").alias("n_children"))
    owned = written(_owned(paths, nodes, children), "owned")
    sums = """count(*) AS n_convs, min(conv_id) AS owner, sum(total) AS total, sum(rest) AS rest, sum(leaf) AS n_leaves,
              min_by(total, conv_id) AS own_total, min_by(rest, conv_id) AS own_rest, min_by(since, conv_id) AS since, min_by(above, conv_id) AS above"""
    found = _nodes(_rollup(attach(paths, owned, ["conv_id"]), sums))
    all_turns = F.col("total") - F.col("n_convs") * F.col("before")
    distinct = F.col("rest") - F.col("own_rest") + F.col("own_total") - F.col("before")
    kids = children.withColumnsRenamed({"up1": "k1", "up2": "k2"})
    return found.join(kids, ["k1", "k2"], "left").join(_ends(paths, owned), ["k1", "k2"], "left").select(
        F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("since"), F.col("above")).otherwise(F.col("owner")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        (all_turns - distinct).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _lanes(pos: Column, turn: Column) -> list[Column]:
    """128 bits of (position, turn) as four numbers, whose sums do not overflow."""
    a, b = (F.xxhash64(F.lit(seed), pos.cast("long"), turn) for seed in (11, 12))
    return [x for h in (a, b) for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW)))]


def _chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def _key(sums: list[Column]) -> list[Column]:
    return [F.shiftleft(a.bitwiseAND(F.lit(LOW >> 1)), 32).bitwiseOR(b.bitwiseAND(F.lit(LOW))) for a, b in (sums[:2], sums[2:])]


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, block, sums and characters of the blocks before, t0 to t7; a conversation without turns has block 0."""
    bare = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_id"))
    rows = turns.select("conv_id", F.col("pos").cast("long").alias("pos"), "turn_id").union(bare)
    lanes = _lanes(F.col("pos"), F.col("turn_id"))
    real = F.col("turn_id").isNotNull()
    wide = rows.withColumn("block", F.floor(F.col("pos") / WIDTH).cast("long")).groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("pos") % WIDTH == k, F.col("turn_id"))).alias(t) for k, t in enumerate(TURNS)],
        *[F.coalesce(F.sum(F.when(real, x)), F.lit(0)).cast("long").alias(f"own_{s}") for s, x in zip(LANES, lanes)],
        F.coalesce(F.sum(F.when(real, _chars(F.col("turn_id")))), F.lit(0)).cast("long").alias("own_chars"))
    running = {s: Agg("sum", F.col(f"own_{s}"), exclusive=True) for s in [*LANES, "chars"]}
    return scan(wide, ["conv_id"], ["block"], F.floor(F.col("block") / RUN).cast("long"), running)


def _rollup(paths: DataFrame, sums: str) -> DataFrame:
    """Sums of every prefix in every block. Groups behind a conversation's end, which ROLLUP makes too, are no nodes;
    nor is the empty prefix of a later block, as it is the last one of the block before."""
    key = ", ".join(["block", *LANES, "chars"])
    real = " ".join(f"WHEN {(1 << WIDTH - 1 - k) - 1} THEN {t} IS NOT NULL" for k, t in enumerate(TURNS))
    return paths.sparkSession.sql(
        f"SELECT {key}, {', '.join(TURNS)}, {sums} FROM {{paths}} GROUP BY {key}, ROLLUP ({', '.join(TURNS)}) "
        f"HAVING CASE grouping_id() {real} ELSE block = 0 END", paths=paths)


def _nodes(groups: DataFrame) -> DataFrame:
    """Groups as nodes: key k1, k2, the parent's up1, up2, depth, and the characters before the last turn."""
    here = [F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in TURNS]
    depth = F.col("block") * WIDTH + sum(here[1:], here[0])
    last = F.coalesce(*[F.col(t) for t in reversed(TURNS)])
    each = [_lanes(F.col("block") * WIDTH + k, F.col(t)) for k, t in enumerate(TURNS)]
    sums = [F.col(s) + sum((F.when(F.col(t).isNotNull(), e[i]).otherwise(0) for t, e in zip(TURNS[1:], each[1:])),
                           F.when(F.col(TURNS[0]).isNotNull(), each[0][i]).otherwise(0)) for i, s in enumerate(LANES)]
    total = F.col("chars") + sum((F.coalesce(_chars(F.col(t)), F.lit(0)) for t in TURNS[1:]), F.coalesce(_chars(F.col(TURNS[0])), F.lit(0)))
    rows = groups.withColumns({"depth": depth, "_last": last, "_total": total, **{f"_{s}": x for s, x in zip(LANES, sums)}})
    ends = _lanes(F.col("depth") - 1, F.col("_last"))
    k1, k2 = _key([F.col(f"_{s}") for s in LANES])
    up1, up2 = _key([F.col(f"_{s}") - e for s, e in zip(LANES, ends)])
    deep = F.col("depth") > 0
    return rows.withColumns({"k1": k1, "k2": k2, "up1": F.when(deep, up1), "up2": F.when(deep, up2),
                             "before": F.col("_total") - F.coalesce(_chars(F.col("_last")), F.lit(0))}).drop(
        "block", "chars", "_last", "_total", *TURNS, *LANES, *[f"_{s}" for s in LANES])


def _owned(paths: DataFrame, nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Per conversation: its characters, and of the end of its path that it owns the first depth (since), the owner of
    the node above (above), the characters (rest) and whether it ends in a leaf (leaf: 1 or 0); k1, k2 of its end."""
    ends = paths.groupBy("conv_id").agg(F.max(F.col("chars") + F.col("own_chars")).alias("total"), *[
        F.max(F.col(s) + F.col(f"own_{s}")).alias(s) for s in LANES])  # sums grow along the blocks
    k1, k2 = _key([F.col(s) for s in LANES])
    ends = ends.select("conv_id", "total", k1.alias("k1"), k2.alias("k2"))
    firsts = nodes.groupBy("owner").agg(F.min("depth").alias("since"), F.min_by("before", "depth").alias("before"),
                                        F.min_by("up1", "depth").alias("up1"), F.min_by("up2", "depth").alias("up2"))
    names = nodes.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("owner").alias("above"))
    size = nodes.select((F.count("*") / HOT).alias("n")).scalar()
    hot = F.broadcast(names.join(children.where(F.col("n_children") > size), ["up1", "up2"]).select("up1", "up2", "above"))
    tried = firsts.join(hot, ["up1", "up2"], "left")
    sure = (F.col("since") == 0) | F.col("above").isNotNull()
    known = tried.where(sure).select("owner", "since", "before", "above")
    rest = tried.where(~sure).drop("above").join(names, ["up1", "up2"]).select("owner", "since", "before", "above")
    leaves = nodes.join(children.withColumnsRenamed({"up1": "k1", "up2": "k2"}), ["k1", "k2"], "left_anti").select(
        F.col("owner").alias("conv_id"), F.lit(1).alias("leaf"))
    first = known.union(rest).withColumnRenamed("owner", "conv_id")
    return ends.join(first, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", "total", "k1", "k2", "since", "above", F.coalesce(F.col("total") - F.col("before"), F.lit(0)).alias("rest"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"))


def _ends(paths: DataFrame, owned: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of nodes at which conversations end.

    Members are put in order within runs of ids, at most RUN to a row; a task then feeds a node's rows one after
    the other to the digest, which has no other order, and holds one row at a time.
    """
    runs = owned.groupBy("k1", "k2", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, ([], [], [])
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (k1, k2) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    for column, value in zip(out, (*now, state.hexdigest())):
                        column.append(value)
                now, state = (k1, k2), hashlib.sha256(ids.encode())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names)
                out = ([], [], [])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], names)

    names = ["k1", "k2", "ends_sha256"]
    return runs.select("k1", "k2", "run", "ids").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "run").mapInArrow(
        digest, "k1 long, k2 long, ends_sha256 string")


def branched(turns: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that share beginnings: the first h turns of conversation c - c % group, then c's own after its first h.

    h is crc32 of the decimal c modulo `most`; all turns are taken where there are fewer, none where that conversation
    is absent. % is that of SQL (it has the sign of c).
    """
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_id"))).alias("first"))
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    rule = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), taken.cast("int").alias("h")).join(
        first, "base", "left").select("conv_id", "h", F.coalesce(F.slice("first", 1, F.col("h")), F.array()).alias("first"))
    begun = rule.select("conv_id", F.explode("first").alias("x")).select("conv_id", "x.pos", "x.turn_id")
    own = attach(turns, rule.select("conv_id", "h", F.size("first").alias("m")), ["conv_id"]).where(F.col("pos") >= F.col("h"))
    return begun.union(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn_id"))


SQL = """
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
          md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS tid, turn
          FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT c, text, tid, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) - 1 AS pos FROM turns),
convs AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM turns), crc_table),
sizes AS (SELECT v.c, v.h, least(v.h, count(b.pos)) AS m FROM convs v LEFT JOIN placed b ON b.c = v.c - v.c % 100 GROUP BY v.c, v.h),
built AS (SELECT v.c, b.pos, b.text, b.tid FROM convs v JOIN placed b ON b.c = v.c - v.c % 100 AND b.pos < v.h
          UNION ALL SELECT s.c, s.m + p.pos - s.h, p.text, p.tid FROM sizes s JOIN placed p ON p.c = s.c AND p.pos >= s.h),
paths AS (SELECT v.c, coalesce(list(tid ORDER BY pos) FILTER (WHERE tid IS NOT NULL), []) AS path,
            coalesce(list(length(text) ORDER BY pos) FILTER (WHERE tid IS NOT NULL), []) AS sizes FROM convs v LEFT JOIN built USING (c) GROUP BY v.c),
prefixes AS (SELECT c, d, array_to_string(path[1:d], ',') AS k, array_to_string(path[1:d - 1], ',') AS up, coalesce(sizes[d], 0) AS n, d = len(path) AS ends
             FROM (SELECT c, path, sizes, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT k, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up, d),
below AS (SELECT p.k, p.d, sum(u.saved) AS saved_tokens, count(*) FILTER (WHERE coalesce(x.n_children, 0) = 0) AS n_leaves
          FROM nodes u JOIN prefixes p ON p.c = u.c AND p.d <= u.d LEFT JOIN kids x ON x.k = u.k AND x.d = u.d GROUP BY p.k, p.d)
SELECT n.c AS conv_id, n.d AS depth, a.c AS parent_conv_id, n.n_convs, coalesce(x.n_children, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (k, d) LEFT JOIN kids x USING (k, d) LEFT JOIN nodes a ON a.k = n.up AND a.d = n.d - 1
"""


@query("op12_conversation_trie", SQL)
def op12(spark, sf_dir):
    turns = written(ordered(table(spark, sf_dir, "conversations")), "turns")
    convs = written(turns.select("conv_id").distinct(), "convs")
    return trie(branched(turns, convs), convs)
