"""Ranked lexical search: WAND over an inverted index in document shards.

The index is a table with a row per shard of whole documents (about SHARD_BYTES of text, at least one
document): the sorted 64-bit hashes of its terms, where each term's postings start, and the postings
(document in the shard, occurrences), in the order of documents. It holds all terms and no weights, so
it is written once and searched by any set of queries.

A search takes its queries in blocks of bounded size. Document frequencies of a block's terms, and N and L,
are summed over all shards; then every shard ranks its documents for every query by WAND: the cursors of the
query's posting lists are kept in the order of their next document; the terms' maximum impacts in the shard,
added up in this order, give the pivot, the first document that could reach the heap's threshold; lists
before it skip to it, and only a pivot with all earlier lists on it is scored. The threshold is the least
score of the shard's heap, or the one that earlier shards of the task or the first shards of the index
(ranked beforehand, in full) have reached already: it bounds the k-th best score from below, so what can't
reach it isn't in the result, and ties with it are kept. The shards' heaps are merged by ranked rows, of
which Spark keeps k a query in each task before the shuffle.

Terms are compared by 64-bit hashes. Defined results: null or empty texts have no terms and no ranks; each
row is a document of its own, so repeated rows and ids rank beside one another; null ids rank after others
of an equal score; each query row is a query of its own, also if ids repeat or are null; a query
without known terms has no rows; an empty index or no queries give no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dealgraph.llm.common import byte_chunks, hash_words, lower_ascii, map_arrow, stored, table, words_in

SHARD_BYTES = 16_000_000
#: Terms of the queries that are searched at once; what the driver and each task hold is in proportion.
BLOCK_TERMS = 500_000
#: Tasks of the index whose shards are ranked in full for the first thresholds (which never change the result).
SEED_PARTS = 4
TOP = 50
K1_SCALE, B = 20, 50

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Shard:
    """Collects documents until they make a row of the index."""

    def __init__(self):
        self.ids, self.sizes, self.hashes, self.docs, self.n, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> None:
        raw = lower_ascii(raw)
        starts, ends, first = words_in(raw, offsets, IS_TERM)
        sizes = np.diff(first)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.hashes.append(hash_words(raw, starts, ends))
        self.docs.append(np.repeat(np.arange(self.n, self.n + len(sizes), dtype=np.int32), sizes))
        self.n += len(sizes)
        self.bytes += len(raw)

    def row(self) -> list[pa.Array]:
        h, d = np.concatenate(self.hashes), np.concatenate(self.docs)
        order = np.argsort(h, kind="stable")  # documents stay in order
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        posting = new.copy()
        posting[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(posting)
        starts = np.append(np.flatnonzero(new[at]), len(at)).astype(np.int64)
        sizes = np.concatenate(self.sizes).astype(np.int64)
        ids = pa.concat_arrays(self.ids)
        arrays = [h[new], starts, d[at], np.diff(np.append(at, len(h))).astype(np.int32)]
        return [pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([sizes.tobytes()], pa.binary()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, a row per shard: (part, n_docs, n_terms, ids, sizes, terms, starts, docs, tfs). Write it as Parquet to keep it."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["part", "n_docs", "n_terms", "ids", "sizes", "terms", "starts", "docs", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = pa.array([TaskContext.get().partitionId()], pa.int32()), Shard()
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch):
                shard.add(batch.column(0).slice(a, b - a), raw, offsets)
                if shard.bytes >= shard_bytes:
                    yield pa.RecordBatch.from_arrays([part, *shard.row()], names=names)
                    shard = Shard()
        if shard.n:
            yield pa.RecordBatch.from_arrays([part, *shard.row()], names=names)

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), run,
                     f"part int, n_docs bigint, n_terms bigint, ids array<{kind}>, sizes binary, terms binary, starts binary, docs binary, tfs binary")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + K1_SCALE * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Postings:
    """What a block's terms have in one shard: documents and impacts, by the term's number."""

    def __init__(self, row: dict, block: dict):
        terms, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int64)
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
        n, total = block["n"], block["total"]
        self.n_docs = len(row["sizes"]) // 8
        m = np.array([100 - B + (B * int(x) * n) // total if total else 0 for x in np.frombuffer(row["sizes"], np.int64)], np.int64)
        at = np.searchsorted(terms, block["terms"])
        known = (at < len(terms)) & (terms[np.minimum(at, max(0, len(terms) - 1))] == block["terms"]) if len(terms) else np.zeros(len(at), bool)
        self.lists = {}
        for t in np.flatnonzero(known & (block["weights"] > 0)).tolist():
            d = docs[starts[at[t]] : starts[at[t] + 1]]
            self.lists[t] = (d, block["weights"][t] * impact(tfs[starts[at[t]] : starts[at[t] + 1]], m[d]))
        self.ready: dict[int, tuple[list, list, int]] = {}

    def cursor(self, t: int) -> tuple[list, list, int]:
        """Documents, impacts and the maximum impact of a term, as WAND reads them one by one."""
        if t not in self.ready:
            d, x = self.lists[t]
            self.ready[t] = (d.tolist(), x.tolist(), int(x.max()))
        return self.ready[t]


def in_full(postings: Postings, query: np.ndarray, k: int) -> np.ndarray:
    """The k best scores of a shard, from all of its postings (for thresholds, and the test of wand())."""
    total = np.zeros(postings.n_docs, np.int64)
    for t in query.tolist():
        if t in postings.lists:
            d, x = postings.lists[t]
            total[d] += x
    total = total[total > 0]
    return np.partition(total, len(total) - k)[len(total) - k :] if len(total) > k else total


def wand(lists: list[tuple[list, list, int]], tie: list, k: int, floor: int) -> list[tuple[int, int, int]]:
    """The k best (score, -tie, document) that reach `floor` (at least 1), unordered; tie: a rank for each document, smaller is better."""
    bits = max(1, len(lists)).bit_length()
    mask = (1 << bits) - 1
    heap: list[tuple[int, int, int]] = []
    at = [0] * len(lists)
    bounds = [x[2] for x in lists]
    cursors = sorted((x[0][0] << bits) | t for t, x in enumerate(lists))  # next document, then the list's number
    while cursors:
        bound = 0
        for place, c in enumerate(cursors):
            bound += bounds[c & mask]
            if bound >= floor:
                break
        else:
            break  # no document that is left can reach the threshold
        pivot = c >> bits
        moved = 0
        if cursors[0] >> bits == pivot:
            score = 0
            for c in cursors:
                if c >> bits != pivot:
                    break
                t = c & mask
                score += lists[t][1][at[t]]
                at[t] += 1
                moved += 1
            if score >= floor:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -tie[pivot], pivot))
                else:
                    heapq.heappushpop(heap, (score, -tie[pivot], pivot))
                if len(heap) == k:
                    floor = max(floor, heap[0][0])
        else:
            for c in cursors[:place]:
                if c >> bits == pivot:
                    break
                t = c & mask
                at[t] = bisect_left(lists[t][0], pivot, at[t] + 1)
                moved += 1
        cursors[:moved] = [(lists[t][0][at[t]] << bits) | t for t in (c & mask for c in cursors[:moved]) if at[t] < len(lists[t][0])]
        cursors.sort()
    return heap


def _known(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents of the index each of the terms (sorted hashes) is."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1), strict=True):
                own, starts = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(starts.as_py(), np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    df += np.where(own[at] == wanted, starts[at + 1] - starts[at], 0)
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(df[t])], names=["t", "df"])

    found = np.zeros(len(terms), np.int64)
    for r in map_arrow(index.select("terms", "starts"), run, "t bigint, df bigint").groupBy("t").agg(F.sum("df").alias("df")).toLocalIterator():
        found[r["t"]] = r["df"]
    shared.unpersist()
    return found


def _floors(index: DataFrame, shared, n_queries: int, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best score: the k-th best of the first shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                postings = Postings(row, block)
                best = [in_full(postings, q, k) for q in block["queries"]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), [len(x) for x in best]), pa.int64()), pa.array(np.concatenate(best), pa.int64())], names=["q", "score"])

    scores = map_arrow(index.where(F.col("part") < SEED_PARTS).select("sizes", "terms", "starts", "docs", "tfs"), run, "q bigint, score bigint")
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k)
    floors = np.ones(n_queries, np.int64)
    for r in ranked.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toLocalIterator():
        floors[r["q"]] = r["score"]
    return floors


def _blocks(queries: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Item ids and sorted distinct term hashes of the queries, in blocks; only one block is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch):
                raw = lower_ascii(raw)
                starts, ends, first = words_in(raw, offsets, IS_TERM)
                h = hash_words(raw, starts, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.unique(h[first[k] : first[k + 1]]).tobytes() for k in range(b - a)], pa.binary())], names=["item", "terms"])

    kind = queries.schema[item_id].dataType.simpleString()
    items, terms, n = [], [], 0
    for r in map_arrow(queries.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text")), run, f"item {kind}, terms binary").toLocalIterator():
        own = np.frombuffer(bytes(r["terms"]), np.uint64)
        if len(own):
            items.append(r["item"])
            terms.append(own)
            n += len(own)
        if n >= block_terms:
            yield items, terms
            items, terms, n = [], [], 0
    if items:
        yield items, terms


def search(index: DataFrame, queries: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index (a table, as it is read several times) for each row of queries."""
    spark = index.sparkSession
    n, total = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    id_type = index.schema["ids"].dataType.elementType
    item_type = queries.schema[item_id].dataType
    item_arrow = to_arrow_type(item_type)
    names = ["q", "item_id", "doc_id", "score"]
    schema = f"q bigint, item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score bigint"
    out = None
    for items, own in _blocks(queries, item_id, text, block_terms):
        terms = np.unique(np.concatenate(own))
        df = _known(index, terms)
        weights = np.array([weight(n, x) if x else 0 for x in df.tolist()], np.int64)
        block = {"n": n, "total": total, "terms": terms, "weights": weights, "queries": [np.searchsorted(terms, x) for x in own]}
        shared = spark.sparkContext.broadcast(block)
        floors = spark.sparkContext.broadcast(_floors(index, shared, len(items), k))
        keys = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, floors=floors, keys=keys) -> Iterator[pa.RecordBatch]:
            block, floor = shared.value, floors.value.copy()
            for batch in batches:
                for j in range(batch.num_rows):
                    row = {c: batch.column(batch.schema.get_field_index(c))[j].as_py() for c in ("sizes", "terms", "starts", "docs", "tfs")}
                    ids = batch.column(batch.schema.get_field_index("ids"))[j].values
                    postings = Postings(row, block)
                    order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
                    tie = np.empty(len(ids), np.int64)
                    tie[order] = np.arange(len(ids))
                    tie = tie.tolist()
                    qs, docs, scores = [], [], []
                    for q, query in enumerate(block["queries"]):
                        lists = [postings.cursor(t) for t in query.tolist() if t in postings.lists]
                        best = wand(lists, tie, k, int(floor[q]))
                        if len(best) == k:
                            floor[q] = max(floor[q], min(best)[0])
                        for score, _, doc in best:
                            qs.append(q)
                            docs.append(doc)
                            scores.append(score)
                    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array([keys.value[q] for q in qs], item_arrow), ids.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], names=names)

        heaps = map_arrow(index.select("ids", "sizes", "terms", "starts", "docs", "tfs"), run, schema)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = heaps.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint")
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(stored(build_index(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with terms as (
  select rowid d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t
  from (select row_number() over () rowid, * from documents)),
sizes as (select d, any_value(doc_id) doc_id, count(*) n from terms group by 1),
whole as (select count(*) docs, sum(n)::bigint l from sizes),
postings as (select d, t, count(*) tf from terms group by 1, 2),
weights as (select t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint w from postings, whole group by t, docs),
asked as (
  select distinct i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t
  from (select row_number() over () i, * from benchmark)),
scored as (
  select i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::bigint score
  from asked join weights using (t) join postings using (t) join sizes using (d), whole group by all)
select item_id, rank::int rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id) rank from scored where score > 0) where rank <= 50
"""
