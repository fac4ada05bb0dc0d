"""Joins of records, vendors, files and logs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgraph.functions.workers import ship


def co_occurring(links: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """Pairs of items that share at least `least` groups, each pair once.

    Items of a group are few (vendors of a deal); the pairs are counted by partial aggregation."""
    a = links.select(F.col(group).alias("_g"), F.col(item).alias("a"))
    b = links.select(F.col(group).alias("_g"), F.col(item).alias("b"))
    return a.join(b, "_g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def related_either(records: DataFrame, record_id: str, keys: tuple[str, ...], of: DataFrame) -> DataFrame:
    """Records that share any of the keys with the given ones, not themselves; one equi join per
    key and a union, instead of one join on an OR."""
    out = None
    for key in keys:
        part = (of.select(F.col(record_id).alias("of_id"), key).join(records.select(F.col(record_id).alias("related_id"), key), key)
                .where("of_id <> related_id").select("of_id", "related_id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def similar_nearby(records: DataFrame, equal: str, value: str, at: str, share: float = 0.10, days: int = 90) -> DataFrame:
    """Pairs (smaller id first) of the same key with values within a share and dates within days."""
    a = records.select(F.col("id").alias("id_1"), equal, F.col(value).alias("v1"), F.col(at).alias("t1"))
    b = records.select(F.col("id").alias("id_2"), equal, F.col(value).alias("v2"), F.col(at).alias("t2"))
    near = F.col("v2").between(F.col("v1") * (1 - share), F.col("v1") * (1 + share)) & (F.abs(F.datediff("t1", "t2")) <= days)
    return a.join(b, equal).where("id_1 < id_2").where(near).select("id_1", "id_2", equal)


def count_per(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """A count per row of the left side, pre-aggregated; 0 where there is none."""
    n = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def overlapping(lists: DataFrame, record_id: str, items: str) -> DataFrame:
    """Pairs of records whose lists overlap: an equi join on the exploded items, not on arrays_overlap."""
    one = lists.select(F.col(record_id).alias("_id"), F.explode(items).alias("_item"))
    a, b = one.select(F.col("_id").alias("id_1"), "_item"), one.select(F.col("_id").alias("id_2"), "_item")
    return a.join(b, "_item").where("id_1 < id_2").groupBy("id_1", "id_2").agg(F.count("*").alias("shared"))


def lineage(history: DataFrame, entity: str, field: str, at: str, source: str) -> DataFrame:
    """Per entity and field, changes, sources and the newest value's time."""
    return history.groupBy(entity, field).agg(F.count("*").alias("changes"), F.countDistinct(source).alias("source_count"), F.max(at).alias("last_at"))


def cross_source(records: DataFrame, files: DataFrame, wanted: list[str]) -> DataFrame:
    """Correlation keys that more than one record (id, key) has of those seen in one of the wanted files (id, file): (key, n, first_id, last_id)."""
    seen = files.where(F.col("file").isin(*wanted)).select("id").distinct()
    return records.where(F.coalesce("key", F.lit("")) != "").join(seen, "id", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def supersede(history: DataFrame, entity: str, field: str, at: str, key: str) -> DataFrame:
    """C11: each value with the one that replaced it, and whether it is current."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity, field).orderBy(at, key)
    return history.withColumns({"superseded_by": F.lead(key).over(w), "superseded_at": F.lead(at).over(w)}).withColumn("is_current", F.col("superseded_by").isNull())


#: Names of a block that are compared with as many others at once, and pairs that are handed on at once.
TOGETHER, PAIRS_AT_ONCE = 1_000, 200_000


def _rounded(common: int, total: int) -> float:
    """common / total to six digits, halves up, as round() gives it."""
    return float(Decimal(repr(common / total)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if total else math.nan


def _of_parts(a: pa.StructArray, b: pa.StructArray, same: bool) -> Iterator[pa.RecordBatch]:
    ids, codes, owner = [], [], []
    for part in (a, b):
        key, texts = part.flatten()
        ids.append(key.to_numpy())
        letters = np.frombuffer("".join(texts.to_pylist()).encode("ascii"), np.uint8).reshape(-1, 3).astype(np.int64)
        codes.append(letters @ np.array([1 << 16, 1 << 8, 1]))
        owner.append(np.repeat(np.arange(len(part)), pc.binary_length(texts).to_numpy() // 3))
    kinds, sizes = np.intersect1d(*codes), [np.bincount(o, minlength=len(k)) for o, k in zip(owner, ids, strict=True)]
    held = [np.zeros((len(k), len(kinds)), np.float32) for k in ids]
    for h, c, o in zip(held, codes, owner, strict=True):
        both = np.isin(c, kinds)
        h[o[both], np.searchsorted(kinds, c[both])] = 1
    step = max(1, PAIRS_AT_ONCE // len(b))
    for at in range(0, len(a), step):
        common = np.rint(held[0][at : at + step] @ held[1].T).astype(np.int64)
        one, two = np.broadcast_arrays(ids[0][at : at + step, None], ids[1][None, :])
        # within a part, each pair is met from both sides
        rows = one < two if same else one != two
        total = sizes[0][at : at + step, None] + sizes[1][None, :] - common
        width = int(total.max(initial=0)) + 1
        keys = (common * width + total)[rows]
        table = np.zeros(int(keys.max(initial=0)) + 1)
        for k in np.flatnonzero(np.bincount(keys)).tolist():
            table[k] = _rounded(*divmod(k, width))
        one, two = one[rows], two[rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(table[keys], from_pandas=True)], names=["id_1", "id_2", "sim"])


def trigram_pairs(names: DataFrame) -> DataFrame:
    """(id_1, id_2, sim): all pairs of a block's names (id, grams: their distinct trigrams, block), the smaller id first, with their Jaccard similarity. A block is dealt into parts; the join pairs parts, not names, and
    what two parts have in common is a matrix product."""
    number = F.row_number().over(Window.partitionBy("block").orderBy("id"))
    dealt = names.where("block is not null").select(F.col("id").cast("bigint").alias("id"), F.array_join("grams", "").alias("text"), "block", F.floor((number - 1) / TOGETHER).alias("part"))
    parts = dealt.groupBy("block", "part").agg(F.collect_list(F.struct("id", "text")).alias("names"))
    one, two = parts.select("block", F.col("part").alias("part_1"), F.col("names").alias("a")), parts.select("block", F.col("part").alias("part_2"), F.col("names").alias("b"))
    met = one.join(two, "block").where("part_1 <= part_2").select("a", "b", (F.col("part_1") == F.col("part_2")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _of_parts(batch.column(0)[k].values, batch.column(1)[k].values, batch.column(2)[k].as_py())

    ship(names.sparkSession)
    return met.mapInArrow(run, "id_1 bigint, id_2 bigint, sim double")
