"""Substring deduplication with fixed-block anchors.

A word goes if a window of WINDOW words over it also starts in a document with a smaller id.
Every window holds a whole reference block: the documents' BLOCK-word blocks at multiples of
BLOCK, and 2 * BLOCK - 1 <= WINDOW. So the reference blocks are indexed, every rolling window of
BLOCK words probes the index, and a hit that lies in two documents is an anchor; anchors are extended
to the exact windows of WINDOW words around them, whose runs are the maximal exact repeats.

The work is dealt out twice. Documents are dealt to segments by a hash of the id, compressed and
kept in the shared folder; hashes are dealt to shards by their top bits. A segment sends each
shard its distinct hashes as one sorted block, the shard answers with one bit per hash in the
same order, so a passage that very many documents share is one hash per segment. Of exact
copies only the smallest id is dealt out. Segments and shards grow in number with the input,
not in size.

  1. segment -> shard: block hashes (32 bits within the shard), with a bit each for "is a
     reference block" and "in two documents here"; back: is it an anchor?
  2. segment -> shard: hashes of the windows around anchors (64 bits) with their smallest id
     in the segment; back: is there a smaller id in another segment?

Defined results: a null or wordless text has no words; texts of fewer words than a window lose
none; a document never loses words to itself or to rows that repeat its id, each of which is judged by its own
text; a null id loses
nothing and takes nothing away; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import BLANK, U, cut, cut_by, hash_windows, hash_words, map_arrow, ship, stored, table, words_in

WINDOW, BLOCK = 13, 7
#: Text bytes of a segment and of a partition, and bytes of hashes of a shard, about.
SEGMENT_BYTES, PARTITION_BYTES, SHARD_BYTES = 3_000_000, 12_000_000, 8_000_000


class Segment:
    """The documents of one segment: words, their hashes, and which windows lie within a document."""

    def __init__(self, rows: pa.Table):
        ids, digests, bodies = (rows.column(n).to_pylist() for n in ("doc_id", "digest", "body"))
        copies = {(i, d) for i, d, b in zip(ids, digests, bodies, strict=True) if b is None}
        given = [(i, d, b) for i, d, b in zip(ids, digests, bodies, strict=True) if b is not None]
        own = sorted(((i, b) for i, d, b in given if i is not None and (i, d) not in copies), key=lambda x: x[0])
        self.copies = [(i, zlib.decompress(b)) for i, d, b in given if (i, d) in copies]
        self.unnamed = [(i, zlib.decompress(b)) for i, _, b in given if i is None]
        self.ids = [i for i, _ in own]
        texts = [zlib.decompress(b) for _, b in own]
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.starts, self.ends, self.firsts = words_in(self.raw, np.cumsum([0, *map(len, texts)]), ~BLANK)
        self.words = hash_words(self.raw, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(own)), np.diff(self.firsts))
        # documents with equal ids count as one
        self.owner = np.unique(np.array(self.ids), return_inverse=True)[1][self.doc] if own else self.doc

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of the windows within a document, and their hashes."""
        h = hash_windows(self.words, size)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[size - 1 : size - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start positions; distinct hashes; each position's hash number; per hash: is it a
        reference block, is it in two documents."""
        at, h = self.windows(BLOCK)
        distinct, number = np.unique(h, return_inverse=True)
        aligned = np.zeros(len(distinct), bool)
        aligned[number[(at - self.firsts[self.doc[at]]) % BLOCK == 0]] = True
        least = np.full(len(distinct), len(self.words) + 1)
        np.minimum.at(least, number, self.owner[at])
        shared = np.zeros(len(distinct), bool)
        shared[number[self.owner[at] != least[number]]] = True
        return at, distinct, number, aligned, shared

    def candidates(self, anchors: np.ndarray, at: np.ndarray, number: np.ndarray):
        """Windows that hold an anchor: positions, distinct hashes, each position's hash number and,
        per hash, the number of the smallest id."""
        start, h = self.windows(WINDOW)
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[at[anchors[number]] + 1] = 1
        upto = np.cumsum(hit)
        keep = upto[start + WINDOW - BLOCK + 1] > upto[start]
        start = start[keep]
        distinct, number = np.unique(h[keep], return_inverse=True)
        least = np.full(len(distinct), len(self.words) + 1)
        np.minimum.at(least, number, self.owner[start])
        return start, distinct, number, least


def _per_shard(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of the runs of sorted hashes with the same top bits."""
    shard = (hashes >> U(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *edges], [*edges, len(shard)], strict=True):
        if b > a:
            yield int(shard[a]), int(a), int(b)


def _answers(rows: pa.Table, n: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """One bit per hash from the shards' answers."""
    out = np.zeros(n, bool)
    if rows.num_rows:
        got = dict(zip(rows.column("shard").to_pylist(), rows.column("answer").to_pylist(), strict=True))
        for shard, a, b in _per_shard(hashes, bits):
            if shard in got:
                out[a:b] = np.unpackbits(np.frombuffer(got[shard], np.uint8), count=b - a)
    return out


def _back(segments: list, shards: list, answers: list[np.ndarray]) -> pa.Table:
    some = [k for k, a in enumerate(answers) if a.any()]
    return pa.table({"segment": pa.array([segments[k] for k in some], pa.int64()), "shard": pa.array([shards[k] for k in some], pa.int64()),
                     "answer": pa.array([np.packbits(answers[k]).tobytes() for k in some], pa.binary())})


ANSWER = "segment bigint, shard bigint, answer binary"


def deal_out(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Rows (segment, doc_id, digest, body) by segment, compressed, in the shared folder; a copy of a text
    with a smaller id is named by a further row without a body. Also the number of shard bits."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    seen = cut(src.select("doc_id", F.unhex(F.md5("body")).alias("digest"), F.octet_length("body").alias("n")))
    size = seen.agg(F.sum("n")).first()[0] or 0
    segments = max(1, math.ceil(size / SEGMENT_BYTES))
    partitions = max(8, math.ceil(size / PARTITION_BYTES))
    bits = max(3, math.ceil(math.log2(max(1, size / 6 * 4 / SHARD_BYTES))))
    # a table of its own, so that the join deals both sides out anew and Spark splits a digest of very many rows
    first = stored(seen.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    copies = seen.select("doc_id", "digest").join(first, "digest").where("doc_id > first")
    kind = docs.schema[doc_id].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = [x.as_py() for x in batch.column(1).slice(a, 1000)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1000), pa.array([hashlib.md5(x).digest() for x in part], pa.binary()),
                                                  pa.array([zlib.compress(x, 1) for x in part], pa.binary())], names=["doc_id", "digest", "body"])

    rows = map_arrow(src, squeeze, f"doc_id {kind}, digest binary, body binary").unionByName(copies.select("doc_id", "digest", F.lit(None).cast("binary").alias("body")))
    segment = F.pmod(F.xxhash64("doc_id"), F.lit(segments))
    return cut_by(rows.select(segment.alias("segment"), "doc_id", "digest", "body"), partitions, "segment"), bits


def find_anchors(rows: DataFrame, bits: int) -> DataFrame:
    """Step 1: (segment, shard, answer) over the segments' distinct block hashes."""

    def probe(key: tuple, group: pa.Table) -> pa.Table:
        own = Segment(group)
        _, distinct, _, aligned, shared = own.blocks()
        low = (distinct >> U(32 - bits)).astype(np.uint32)
        runs = list(_per_shard(distinct, bits))
        return pa.table({"segment": pa.array([key[0].as_py()] * len(runs), pa.int64()), "shard": pa.array([s for s, _, _ in runs], pa.int64()),
                         "keys": pa.array([low[a:b].tobytes() for _, a, b in runs], pa.binary()),
                         "aligned": pa.array([np.packbits(aligned[a:b]).tobytes() for _, a, b in runs], pa.binary()),
                         "shared": pa.array([np.packbits(shared[a:b]).tobytes() for _, a, b in runs], pa.binary())})

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()]
        flags = [np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(group.column(n).to_pylist(), keys, strict=True)]).astype(bool) for n in ("aligned", "shared")]
        distinct, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        reference, shared = np.zeros(len(distinct), bool), count > 1
        reference[number[flags[0]]] = True
        shared[number[flags[1]]] = True
        hit = (reference & shared)[number]
        ends = np.cumsum([len(k) for k in keys])
        return _back(group.column("segment").to_pylist(), group.column("shard").to_pylist(), np.split(hit, ends[:-1]))

    sent = rows.groupBy("segment").applyInArrow(probe, "segment bigint, shard bigint, keys binary, aligned binary, shared binary")
    return cut(sent.groupBy("shard").applyInArrow(answer, ANSWER))


def find_earlier(rows: DataFrame, anchors: DataFrame, bits: int, kind: str) -> DataFrame:
    """Step 2: (segment, shard, answer) over the segments' distinct windows around anchors."""

    def probe(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        own = Segment(group)
        at, distinct, number, _, _ = own.blocks()
        _, windows, _, least = own.candidates(_answers(found, len(distinct), distinct, bits), at, number)
        names = np.unique(np.array(own.ids)) if own.ids else np.zeros(0, np.int64)
        runs = list(_per_shard(windows, bits))
        return pa.table({"segment": pa.array([key[0].as_py()] * len(runs), pa.int64()), "shard": pa.array([s for s, _, _ in runs], pa.int64()),
                         "keys": pa.array([windows[a:b].tobytes() for _, a, b in runs], pa.binary()),
                         "least": pa.array([names[least[a:b]].tolist() for _, a, b in runs], pa.list_(found_kind(kind)))})

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, U) for x in group.column("keys").to_pylist()]
        least = np.concatenate([np.asarray(x.values) for x in group.column("least").combine_chunks()])
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        order = np.lexsort((least, number))
        first = np.searchsorted(number[order], np.arange(len(distinct)))
        earlier = least[order][first][number] < least
        ends = np.cumsum([len(k) for k in keys])
        return _back(group.column("segment").to_pylist(), group.column("shard").to_pylist(), np.split(earlier, ends[:-1]))

    sent = rows.groupBy("segment").cogroup(anchors.groupBy("segment")).applyInArrow(probe, f"segment bigint, shard bigint, keys binary, least array<{kind}>")
    return cut(sent.groupBy("shard").applyInArrow(answer, ANSWER))


def found_kind(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; kept are the words that stay, joined by one blank (UTF-8)."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows, bits = deal_out(docs, doc_id, text)
    anchors = find_anchors(rows, bits)
    earlier = find_earlier(rows, anchors, bits, kind)
    both = anchors.withColumn("step", F.lit(1)).unionByName(earlier.withColumn("step", F.lit(2)))

    def finish(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        own = Segment(group)
        step = found.column("step").to_numpy() if found.num_rows else np.zeros(0, np.int64)
        one, two = found.filter(pa.array(step == 1)), found.filter(pa.array(step == 2))
        at, distinct, number, _, _ = own.blocks()
        start, windows, number, least = own.candidates(_answers(one, len(distinct), distinct, bits), at, number)
        gone = _answers(two, len(windows), windows, bits)[number] | (least[number] < own.owner[start])
        edge = np.zeros(len(own.words) + 1, np.int64)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + WINDOW, -1)
        removed = np.cumsum(edge[:-1]) > 0
        out = []
        for d, name in enumerate(own.ids):
            a, b = int(own.firsts[d]), int(own.firsts[d + 1])
            keep = np.flatnonzero(~removed[a:b]) + a
            out.append((name, b - a, b - a - len(keep), b" ".join(own.raw[own.starts[k] : own.ends[k]].tobytes() for k in keep)))
        for name, body in own.copies:
            words = body.split()
            out.append((name, len(words), len(words), b"") if len(words) >= WINDOW else (name, len(words), 0, b" ".join(words)))
        for name, body in own.unnamed:
            words = body.split()
            out.append((name, len(words), 0, b" ".join(words)))
        kinds = [found_kind(kind), pa.int64(), pa.int64(), pa.binary()]
        return pa.table({n: pa.array([r[k] for r in out], kinds[k]) for k, n in enumerate(("doc_id", "n_words", "n_removed", "kept"))})

    return rows.groupBy("segment").cogroup(both.groupBy("segment")).applyInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(docs: list[tuple]) -> dict:
    """id: (n_words, n_removed, kept), word by word (for tests)."""
    texts = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - WINDOW + 1):
            first.setdefault(tuple(texts[d][i : i + WINDOW]), d)
    out = {}
    for d, words in texts.items():
        gone: set[int] = set()
        for i in range(len(words) - WINDOW + 1):
            if first[tuple(words[i : i + WINDOW])] < d:
                gone.update(range(i, i + WINDOW))
        out[d] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone))
    return out
