"""K-d tree partitioning: leaves of near-equal bytes by recursive splits at distributed weighted
medians along the widest metadata dimension. DataFrame operations only.

A point is a group of equal texts. All rows of a group share their coordinates (those of its smallest
id), so that equal texts stay in one leaf; a leaf weighs no more than its share of the bytes and the
heaviest group beside it. With a finite group_share, a group that weighs more than that share of a leaf is split by id into
pieces below it, each a point, for a balance that no group can spoil. A median is found by radix refinement: the ordinals of a node are histogrammed
by their highest bits, then by the next ones within the bin that holds the median. The driver
sees at most 2**RADIX_BITS sums per node and round, whatever the input is.

Defined results: a null text has the size, checksum and group of an empty one; null metadata is
the lowest coordinate; repeated rows each get a slot; an empty table gives an empty result;
columns other than the named ones are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.llm.common import BROADCAST_IDS, cut, gapless_rank, table
from dealgraph.llm.mixing import random_key

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Of a leaf's target bytes, the most that one piece of a group of equal texts weighs: by default groups are never split, however heavy.
GROUP_SHARE = math.inf
#: An ordinal: 12 bits of the coordinate, then 21 bits of the piece's hash, refined in 3 rounds of 11 bits.
COORD_BITS, TIE_BITS, RADIX_BITS, ROUNDS = 12, 21, 11, 3
#: Shares of a label in a join with more labels than are broadcast.
SALTS = 32


def _label_ranks(rows: DataFrame, label: str) -> DataFrame:
    """(_label, _rank): the dense ranks, from 0, of a label's distinct values by their bytes; _label is the value's digest.
    Values are range-partitioned and numbered within each partition, whose counts are added up."""
    spread = cut(rows.select(F.col(label).alias("_v")).where("_v is not null").distinct().orderBy(F.encode("_v", "UTF-8")).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    before = counts.select("_q", F.coalesce(F.sum("_n").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.encode("_v", "UTF-8"))) - 1
    return spread.withColumn("_r", inside).join(F.broadcast(before), F.col("_p") == F.col("_q")).select(F.md5("_v").alias("_label"), (F.col("_before") + F.col("_r")).cast("double").alias("_rank"))


def _with_rank(groups: DataFrame, ranks: DataFrame, digest: Column, name: str) -> DataFrame:
    """Adds the rank of a label's digest; null is lowest. The ranks, of a fixed width, are broadcast if they are counted to be
    few; otherwise both sides are dealt out by label and a salt, as a label may be that of a third of all groups."""
    ranks = cut(ranks)
    keyed = groups.withColumn("_d", digest)
    if ranks.count() <= BROADCAST_IDS:
        out = keyed.join(F.broadcast(ranks), F.col("_d") == F.col("_label"), "left")
    else:
        salted = ranks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = keyed.withColumn("_t", F.pmod(F.xxhash64("_group"), F.lit(SALTS)).cast("int")).join(salted, (F.col("_d") == F.col("_label")) & (F.col("_t") == F.col("_s")), "left")
    return out.withColumn(name, F.coalesce("_rank", F.lit(-1.0))).select(*groups.columns, name)


def points(docs: DataFrame, shards: int, doc_id: str, text: str, labels: Sequence[str], group_share: float = GROUP_SHARE) -> tuple[DataFrame, float, list[str]]:
    """Rows (doc_id, size, text_crc32, o0, o1, ...) with an ordinal per dimension, and their total bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                           F.crc32(body).alias("text_crc32"), F.md5(body).alias("_group"),
                           *[F.col(c).cast("string").alias(f"_m{i}") for i, c in enumerate(labels)]))
    groups = rows.groupBy("_group").agg(
        F.sum("size").alias("_weight"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *[F.md5(f"_m{i}").alias(f"_m{i}") for i in range(len(labels))])).alias("_first"), F.max("size").alias("_one"))
    for i in range(len(labels)):
        groups = _with_rank(groups, _label_ranks(rows, f"_m{i}"), F.col(f"_first._m{i}"), f"_rank{i}")
    dims = [F.col(f"_rank{i}") for i in range(len(labels))] + [F.log2(F.col("_one").cast("double"))]
    groups = cut(groups.select(F.col("_group").alias("_g"), "_weight", *[d.alias(f"_d{i}") for i, d in enumerate(dims)]))
    ranges = groups.agg(F.sum("_weight").alias("total"), *[f(f"_d{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = float(ranges["total"] or 0)
    # a share without bound leaves one piece
    pieces = F.ceil(F.col("_weight") / max(1.0, total / shards * group_share)) if math.isfinite(group_share) else F.lit(1)
    piece = F.when(pieces > 1, F.pmod(F.xxhash64("doc_id"), pieces)).otherwise(F.lit(0))
    tie = F.shiftrightunsigned(F.xxhash64("_group", piece.cast("long")), 64 - TIE_BITS)
    top = (1 << COORD_BITS) - 1

    def ordinal(i: int) -> Column:
        lo, hi = ranges[f"lo{i}"] or 0.0, ranges[f"hi{i}"] or 0.0
        coord = F.floor((F.col(f"_d{i}") - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0) * top)
        return (F.shiftleft(coord.cast("long"), TIE_BITS) + tie).alias(f"o{i}")

    names = [f"o{i}" for i in range(len(dims))]
    joined = rows.join(groups, F.col("_group") == F.col("_g"))
    return cut(joined.select("doc_id", "size", "text_crc32", *[ordinal(i) for i in range(len(dims))])), total, names


class Node:
    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.dim, self.cut, self.left, self.right = None, 0, None, None

    def expr(self, leaf) -> Column:
        if self.dim is None:
            return F.lit(leaf(self))
        return F.when(F.col(self.dim) < F.lit(self.cut), self.left.expr(leaf)).otherwise(self.right.expr(leaf))


def _split(rows: DataFrame, root: Node, level: list[Node], dims: list[str]) -> None:
    """Finds dimension and cut of each node of a level, all nodes in the same jobs."""
    at = {id(n): k for k, n in enumerate(level)}
    placed = rows.withColumn("_node", root.expr(lambda n: at.get(id(n), -1))).where("_node >= 0")
    stats = {r["_node"]: r for r in placed.groupBy("_node").agg(
        F.sum("size").alias("weight"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    goal, base, prefix = {}, {}, {}
    for k, n in enumerate(level):
        r = stats.get(k)
        # the widest dimension: the first of those with the largest range of coordinates
        n.dim = max(dims, key=lambda d: (r[f"hi_{d}"] >> TIE_BITS) - (r[f"lo_{d}"] >> TIE_BITS)) if r else dims[0]
        goal[k], base[k], prefix[k] = (r["weight"] if r else 0) * (n.shards // 2) / n.shards, 0, 0
    pick = F.lit(0).cast("long")
    for k, n in enumerate(level):
        pick = F.when(F.col("_node") == k, F.col(n.dim)).otherwise(pick)
    placed = placed.select("_node", "size", pick.alias("_o"))
    for step in range(ROUNDS):
        shift = RADIX_BITS * (ROUNDS - 1 - step)
        held = F.lit(False)
        for k in range(len(level)):
            held = held | ((F.col("_node") == k) & (F.shiftright("_o", shift + RADIX_BITS) == prefix[k]))
        sums = np.zeros((len(level), 1 << RADIX_BITS))
        histogram = placed.where(held).groupBy("_node", F.shiftright("_o", shift).bitwiseAND((1 << RADIX_BITS) - 1).alias("_bin")).agg(F.sum("size").alias("_w"))
        for r in histogram.collect():  # at most 2**RADIX_BITS rows a node
            sums[r["_node"], r["_bin"]] = r["_w"]
        for k in range(len(level)):
            upto = base[k] + np.cumsum(sums[k])
            b = min(int(np.searchsorted(upto, goal[k])), (1 << RADIX_BITS) - 1)
            base[k] = float(upto[b - 1]) if b else base[k]
            prefix[k] = (prefix[k] << RADIX_BITS) | b
            if step == ROUNDS - 1:  # the nearer side of the last bin
                level[k].cut = prefix[k] + int(abs(upto[b] - goal[k]) < abs(base[k] - goal[k]))
    for n in level:
        half = n.shards // 2
        n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)


def kd_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", labels: Sequence[str] = ("source", "lang"), group_share: float = GROUP_SHARE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row. Dimensions: the labels, by the ranks of
    their whole values (4 096 steps), and the logarithm of the size. shards may be any number: a node of n leaves is cut
    at the weighted (n // 2) / n quantile."""
    rows, _, dims = points(docs, shards, doc_id, text, labels, group_share)
    root = Node(0, shards)
    level = [root] if shards > 1 else []
    while level:
        _split(rows, root, level, dims)
        level = [c for n in level for c in (n.left, n.right) if c.shards > 1]
    placed = rows.select("doc_id", "size", "text_crc32", root.expr(lambda n: n.first).cast("int").alias("shard"))
    return gapless_rank(placed, ["shard"], random_key("doc_id"), tie=("doc_id", "text_crc32")).withColumnRenamed("rank", "slot")


def shards_for(docs: DataFrame, target_bytes: int, text: str = "text") -> int:
    """The number of leaves at which none is above the target, give or take a group's piece."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + ROW_BYTES)).first()[0] or 0
    return max(1, -(-int(total) // target_bytes))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
