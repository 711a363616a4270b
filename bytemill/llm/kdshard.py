"""Sharding by a k-d tree over metadata, split at distributed weighted medians.

Documents with equal texts are one group and stay together. A group has a point (logarithm of its texts' size, and hashes of its
least language and source, 20 bits each) and a weight (bytes). A node holds a number of leaves and is split along its widest
dimension (next to the root's width; ties: the first) where the weight divides as the leaves of its two halves need it, until each node is one
leaf. A place is a 60-bit key: 20 bits of the dimension, 40 of the group's hash, which breaks ties.

Groups are indivisible, so all the weight goes down the tree in strata: those above a quarter of a leaf, above a 32nd, above a 256th, and the
rest. A node splits each stratum at its own median along the node's dimension, the heaviest first, and the next stratum's goal makes up for what the
one before could not divide; so sizes differ by less than a light group wherever a node has light groups. A group that outweighs a leaf counts
as exactly one leaf (the level at which this holds for all is found by sums) and ends alone in it, by splits like any other.

Medians are found by histograms of BINS bins, refined within the bin that holds the goal until that bin is one group or below TOLERANCE of a
leaf. The cumulated bins stay in Spark; the driver gets one bin and one line of statistics per node and stratum, and nodes are never more
than shards. Their tables of bounds and cuts are what is broadcast.

Null texts count as empty (size 1), null metadata as a value of its own; repeated rows each get their own slot; a text of any length is hashed
in the JVM; an empty table gives an empty result; columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytemill.llm.shared import kept

BINS, TOLERANCE = 2048, 0.002
#: Strata: the share of a leaf above which a group is in the first, the second, ...
STRATA = (1 / 4, 1 / 32, 1 / 256)
#: Rows of a shard that are numbered together; groups' shards up to so many rows are broadcast; levels between written tables.
SLOTS, FEW, LEVELS = 50_000, 200_000, 4
_TIE, _END, _DIMS = 40, 1 << 60, 3


def _small(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """A broadcast table of a few rows a node: nodes are never more than shards."""
    return F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, pa.float64() if any(isinstance(x, float) for x in v) else pa.int64()) for k, v in columns.items()})))


def _key(dim: Column) -> Column:
    return F.when(dim == 0, F.col("k0")).when(dim == 1, F.col("k1")).otherwise(F.col("k2"))


def _crossed(groups: DataFrame, state: dict[int, dict], stratum: int) -> dict[int, tuple]:
    """For each node the bin in which the cumulated weight passes its goal: weight before it, its weight, its groups, least and greatest key."""
    nodes = list(state)
    of = lambda k: [state[n][k] for n in nodes]
    bounds = _small(groups.sparkSession, node=nodes, dim=of("dim"), low=of("low"), high=of("high"), step=[max(1, -(-(state[n]["high"] - state[n]["low"] + 1) // BINS)) for n in nodes], below=of("below"), goal=[float(g) for g in of("goal")])
    inside = groups.where(F.col("stratum") == stratum).join(bounds, "node").withColumn("key", _key(F.col("dim"))).where("key between low and high")
    bins = inside.groupBy("node", F.expr("(key - low) div step").alias("bin"), "below", "goal").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    found = bins.withColumn("upto", upto).where("upto > goal and upto - w <= goal")
    return {r["node"]: (r["upto"] - r["w"], r["w"], r["n"], r["least"], r["most"]) for r in found.collect()}


def _cuts(groups: DataFrame, stratum: int, dim: dict[int, int], goal: dict[int, float], total: dict[int, int], tolerance: float) -> dict[int, tuple[int, int]]:
    """For each node the key at which the stratum's weight below comes closest to the goal, and that weight."""
    found: dict[int, tuple[int, int]] = {}
    state = {n: {"dim": dim[n], "low": 0, "high": _END, "below": 0, "goal": g} for n, g in goal.items()}
    while state:
        crossed = _crossed(groups, state, stratum)
        for n in list(state):
            if n not in crossed:  # the goal is all of it
                found[n] = _END, total[n]
                del state[n]
                continue
            before, w, count, least, most = crossed[n]
            if count == 1 or least == most or w <= tolerance:
                more = goal[n] - before > before + w - goal[n]
                found[n] = (most + 1, before + w) if more else (least, before)
                del state[n]
            else:
                state[n] |= {"low": least, "high": most, "below": before}
    return found


def _leaves(groups: DataFrame, shards: int, leaf: float) -> DataFrame:
    """groups (h, weight, stratum, k0, k1, k2) with shard."""
    spark, strata = groups.sparkSession, range(len(STRATA) + 1)
    now, nodes, width, level = groups.withColumn("node", F.lit(0).cast("long")), {0: (0, shards)}, None, 0
    while open_ := {k: v for k, v in nodes.items() if v[1] - v[0] > 1}:
        place = [F.shiftright(f"k{i}", _TIE) for i in range(_DIMS)]
        said = now.groupBy("node").agg(*[(F.max(p) - F.min(p)).alias(f"s{i}") for i, p in enumerate(place)], *[F.sum(F.when(F.col("stratum") == j, F.col("weight")).otherwise(0)).alias(f"w{j}") for j in strata])
        stats = {r["node"]: r for r in said.collect() if r["node"] in open_}
        if not stats:
            break
        width = width or [max(stats[0][f"s{i}"], 1) for i in range(_DIMS)]
        dim = {k: max(range(_DIMS), key=lambda i: (r[f"s{i}"] / width[i], -i)) for k, r in stats.items()}
        half = {k: (a + b) // 2 for k, (a, b) in open_.items()}
        share = {k: (half[k] - open_[k][0]) / (open_[k][1] - open_[k][0]) for k in stats}
        seen, left, rows = dict.fromkeys(stats, 0), dict.fromkeys(stats, 0), []
        for j in strata:
            own = {k: r[f"w{j}"] for k, r in stats.items() if r[f"w{j}"]}
            for k, w in own.items():
                seen[k] += w
            goal = {k: min(max(seen[k] * share[k] - left[k], 0), w) for k, w in own.items()}
            for k, (cut, w) in _cuts(now, j, dim, goal, own, TOLERANCE * leaf).items():
                left[k] += w
                rows.append((k, j, dim[k], cut))
        k, j, d, c = (list(x) for x in zip(*rows, strict=True))
        now = now.join(_small(spark, node=k, stratum=j, dim=d, cut=c), ["node", "stratum"], "left")
        now = now.withColumn("node", F.col("node") * 2 + F.coalesce((_key(F.col("dim")) >= F.col("cut")).cast("int"), F.lit(0))).drop("dim", "cut")
        nodes = {2 * k + i: x for k, (a, b) in nodes.items() for i, x in enumerate([(a, half[k]), (half[k], b)] if k in open_ else [(a, b)])}
        level += 1
        if level % LEVELS == 0:
            now = kept(now)
    of = _small(spark, node=list(nodes), shard=[a for a, _ in nodes.values()])
    return now.join(of, "node").withColumn("shard", F.col("shard").cast("int"))


def _level(groups: DataFrame, shards: int) -> int:
    """What a leaf weighs if groups that outweigh it count as one leaf each."""
    level = None
    while True:
        heavy = F.col("weight") > level if level is not None else F.lit(False)
        r = groups.agg(F.sum(F.when(~heavy, F.col("weight"))).alias("light"), F.count(F.when(heavy, 1)).alias("n"), F.min("weight").alias("least")).first()
        if r["light"] is None:  # all groups are heavier, or there are none
            return r["least"] or 1
        now = max(1, math.ceil(r["light"] / (shards - r["n"])))
        if now == level:
            return now
        level = now


def shard(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of df: id_col, size, text_crc32, shard, slot. Give the number of shards, or the bytes of one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = kept(df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("h"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source")))
    tie = F.conv(F.substring(F.hex("h"), 1, _TIE // 4), 16, 10).cast("long")
    code = lambda c: F.shiftright(F.crc32(F.min(c)), 12)
    size = F.least(F.lit((1 << 20) - 1), F.floor(F.log2(F.max("size")) * (1 << 15))).cast("long")
    groups = kept(rows.groupBy("h").agg(F.sum("size").alias("weight"), *[x.alias(f"p{i}") for i, x in enumerate((size, code("lang"), code("source")))]).select(
        "h", "weight", *[(F.shiftleft(f"p{i}", _TIE) + tie).alias(f"k{i}") for i in range(_DIMS)]))
    shards = shards or max(1, math.ceil((groups.agg(F.sum("weight")).first()[0] or 0) / target_bytes))
    leaf = _level(groups, shards)
    stratum = F.lit(len(STRATA))
    for j, s in reversed(list(enumerate(STRATA))):
        stratum = F.when(F.col("weight") > s * leaf, j).otherwise(stratum)
    weighed = groups.withColumn("stratum", stratum.cast("long")).withColumn("weight", F.least("weight", F.lit(leaf)))
    where = kept(_leaves(weighed, shards, leaf).select("h", "shard"))
    found = rows.join(F.broadcast(where) if where.count() <= FEW else where, "h")
    subs = max(1, math.ceil(rows.count() / shards / SLOTS))
    found = found.withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(subs)).cast("int"))
    counts = found.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("k"))
    base = counts.select("shard", "sub", (F.sum("k").over(Window.partitionBy("shard").orderBy("sub")) - F.col("k")).alias("base"))
    numbered = found.withColumn("nr", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("id", "row")) - 1)
    return numbered.join(base, ["shard", "sub"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("nr")).cast("long").alias("slot"))
