"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments, one row each: the documents of one Arrow piece, with a
posting list of word positions for every one of its terms. The segments are written once to the
shared folder, where any test set can be searched: each benchmark window starts from the postings of
its rarest term in the segment and intersects them with the offset-adjusted postings of the others,
rarest first. A segment holds whole documents, so no posting is ever shuffled, and a frequent term
costs one list in each segment.

The windows of the test set are broadcast in blocks of bounded size, each searched against the stored
segments; rows are numbered before the segments are written, and what the blocks find is united
by that number.

A proximity match is a minimal covering window: an interval of a document that has all terms of a
benchmark window, in any order, holds no smaller such interval, and is at most `slop` words longer
than the window. It does not depend on how documents are dealt to segments.

Defined results: a null or wordless text has no words, no hits and no items; a null or wordless
item has no window; repeated items count once per item id; repeated rows each get their result;
a null id is kept as null; empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import byte_chunks, cut, drop_ids, hash_words, lower_ascii, map_arrow, table, words_in

#: Consecutive words of a window.
WINDOW = 10
#: Words by which a proximity match may be longer than the window.
SLOP = 20
#: Words of the items of one block, about; its windows are broadcast (WINDOW numbers of 8 bytes a word, so 24 MB).
BLOCK_WORDS = 300_000

#: Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII bytes.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def text_words(text: str | bytes | None) -> np.ndarray:
    """The word hashes of one text."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = lower_ascii(np.frombuffer(text.encode() if isinstance(text, str) else bytes(text), np.uint8))
    starts, ends, _ = words_in(raw, np.array([0, len(raw)]), IS_WORD)
    return hash_words(raw, starts, ends)


def item_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words) of every item, its words as 64-bit hashes."""
    src = benchmark.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_words(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())],
                                             names=["item", "words"])

    return cut(map_arrow(src, hashed, f"item {src.schema['item'].dataType.simpleString()}, words binary"))


class Windows:
    """The distinct windows of a block of items (item, word hashes): `terms`, ascending hashes; `window`, the
    windows' terms as numbers of these (windows, WINDOW), -1 beyond a short item; `owners`, the items of each window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        words = [np.frombuffer(hashes, np.uint64) for _, hashes in items]
        self.terms = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        owners: dict[tuple, set] = {}
        for (item, _), hashes in zip(items, words, strict=True):
            own = np.searchsorted(self.terms, hashes).tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(str(item))
        flat = list(owners)
        self.window = np.full((len(flat), window), -1, np.int64)
        for row, w in enumerate(flat):
            self.window[row, : len(w)] = w
        self.sizes = (self.window >= 0).sum(1)
        self.owners = [sorted(owners[w]) for w in flat]


def index_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments (doc_ids, firsts, terms, counts, postings, rows): rows number the documents of all segments,
    firsts are the documents' first word positions (and the end), terms the ascending hashes of the segment's
    words, counts their postings, postings the ascending word positions of one term after another, as 32-bit integers."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(2)
            for a, b, raw, offsets in byte_chunks(batch):
                raw = lower_ascii(raw)
                starts, ends, firsts = words_in(raw, offsets, IS_WORD)
                words = hash_words(raw, starts, ends)
                order = np.argsort(words, kind="stable")
                words = words[order]
                new = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(ids.type)),
                    pa.array([firsts.astype("<i4").tobytes()], pa.binary()),
                    pa.array([words[new].tobytes()], pa.binary()),
                    pa.array([np.diff(np.r_[new, len(words)]).astype("<i4").tobytes()], pa.binary()),
                    pa.array([order.astype("<i4").tobytes()], pa.binary()),
                    pa.array([rows.slice(a, b - a).to_pylist()], pa.list_(pa.int64()))],
                    names=["doc_ids", "firsts", "terms", "counts", "postings", "rows"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    return cut(map_arrow(src, build, f"doc_ids array<{kind}>, firsts binary, terms binary, counts binary, postings binary, rows array<bigint>"))


def _covering(lists: list[np.ndarray], most: int, firsts: np.ndarray) -> np.ndarray:
    """Starts of the minimal intervals of at most `most` words of one document that meet all lists, the shortest list first."""
    ends = np.unique(np.concatenate(lists))
    rare = lists[0]  # an interval has a position of the rarest term
    at = np.searchsorted(rare, ends - most, "right")
    at[at == len(rare)] = len(rare) - 1
    ends = ends[(rare[at] > ends - most) & (rare[at] < ends + most)]
    begin = np.full(len(ends), np.iinfo(np.int64).max)
    for held in lists:  # the last position of each term up to the end
        k = np.searchsorted(held, ends, "right") - 1
        begin = np.minimum(begin, np.where(k >= 0, held[np.maximum(k, 0)], -1))
    doc = np.searchsorted(firsts, ends, "right") - 1
    ok = (begin >= firsts[doc]) & (ends - begin < most)
    return np.unique(begin[ok])  # of the intervals that begin at one place the first is minimal


def search_segment(windows: Windows, firsts: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray,
                   slop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, start positions of exact matches, start positions of proximity matches)."""
    if not len(terms) or not len(windows.sizes):
        return
    number = np.searchsorted(terms, windows.terms)
    number[number == len(terms)] = 0
    number[terms[number] != windows.terms] = -1
    ends = np.cumsum(counts)
    begins = ends - counts
    have = np.where(windows.window >= 0, number[windows.window], -1)
    whole = ((have >= 0) | (windows.window < 0)).all(1) & (windows.sizes > 0)
    lengths = np.where(have >= 0, counts[np.maximum(have, 0)], np.iinfo(np.int64).max)
    for w in np.flatnonzero(whole):
        n = int(windows.sizes[w])
        rarest = np.argsort(lengths[w, :n], kind="stable")
        lists = [postings[begins[have[w, k]] : ends[have[w, k]]] for k in range(n)]
        found = lists[rarest[0]] - rarest[0]
        for k in rarest[1:]:
            if not len(found):
                break
            at = np.searchsorted(lists[k], found + k)
            at[at == len(lists[k])] = 0
            found = found[lists[k][at] == found + k]
        if len(found):  # the words must be of one document
            doc = np.searchsorted(firsts, found, "right")
            found = found[(found >= 0) & (found + n <= firsts[np.minimum(doc, len(firsts) - 1)])]
        near = np.zeros(0, np.int64) if slop is None else _covering([lists[k] for k in rarest], n + slop, firsts)
        if len(found) or len(near):
            yield int(w), found, near


def _unpack(batch: pa.RecordBatch, row: int):
    firsts, terms, counts, postings = (np.frombuffer(batch.column(k)[row].as_py(), np.uint64 if k == 2 else "<i4") for k in (1, 2, 3, 4))
    return batch.column(0)[row].values, firsts.astype(np.int64), terms, counts.astype(np.int64), postings.astype(np.int64)


def blocks(words: DataFrame, window: int = WINDOW, per_block: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The items' windows in blocks of bounded size, streamed through the driver one block at a time. An item
    longer than a block is cut with an overlap, so that every window of it is in one piece."""
    block, size = [], 0
    for item, hashes in words.select("item", "words").toLocalIterator():
        n = len(hashes) // 8
        for a in range(0, max(1, n - window + 1), per_block):
            part = bytes(hashes[8 * a : 8 * (a + per_block + window - 1)])
            block.append((item, part))
            size += len(part) // 8
            if size >= per_block:
                yield Windows(block, window)
                block, size = [], 0
    if block:
        yield Windows(block, window)


def scan(segments: DataFrame, windows: Windows, kind: str) -> DataFrame:
    """Per row: (row, doc_id, n_words, hits, items): hits are the positions of hit words in the
    document as 32-bit integers, items the ids of the items with occurring windows."""
    held = segments.sparkSession.sparkContext.broadcast(windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, firsts, terms, counts, postings = _unpack(batch, row)
                edge = np.zeros(int(firsts[-1]) + 1, np.int64)
                items: list[set] = [set() for _ in range(len(firsts) - 1)]
                for k, found, _ in search_segment(w, firsts, terms, counts, postings):
                    np.add.at(edge, found, 1)
                    np.add.at(edge, found + int(w.sizes[k]), -1)
                    for d in set((np.searchsorted(firsts, found, "right") - 1).tolist()):
                        items[d].update(w.owners[k])
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                part = np.searchsorted(hit, firsts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(5)[row].values, ids, pa.array(np.diff(firsts)),
                    pa.array([(hit[part[d] : part[d + 1]] - firsts[d]).astype("<i4").tobytes() for d in range(len(items))], pa.binary()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "hits", "items"])

    return map_arrow(segments, search, f"row bigint, doc_id {kind}, n_words bigint, hits binary, items array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
            window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Every match: (doc_id, item_id, kind, position). kind `phrase`: the window's words stand at
    word `position` and after; kind `near`: a minimal covering window of all its terms starts at `position`."""
    out, kind = None, docs.schema[doc_id].dataType.simpleString()
    spark = docs.sparkSession
    segments = index_segments(docs, doc_id, text)
    for windows in blocks(item_words(benchmark, item_id, text), window, BLOCK_WORDS):
        held = spark.sparkContext.broadcast(windows)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w = held.value
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, firsts, terms, counts, postings = _unpack(batch, row)
                    rows = []
                    for k, found, near in search_segment(w, firsts, terms, counts, postings, slop):
                        for name, at in (("phrase", found), ("near", near)):
                            doc = np.searchsorted(firsts, at, "right") - 1
                            rows += [(int(d), o, name, int(p - firsts[d])) for d, p in zip(doc, at, strict=True) for o in w.owners[k]]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
                        names=["doc_id", "item_id", "kind", "position"])

        part = map_arrow(segments, search, f"doc_id {kind}, item_id string, kind string, position bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"doc_id {kind}, item_id string, kind string, position bigint")
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row, hits as in scan()."""
    kind = docs.schema[doc_id].dataType.simpleString()
    segments = index_segments(docs, doc_id, text)
    todo = blocks(item_words(benchmark, item_id, text), window, BLOCK_WORDS)
    out = scan(segments, next(todo, None) or Windows([], window), kind)
    # of further blocks, the rows that they hit
    rest = [cut(scan(segments, windows, kind).where("octet_length(hits) > 0")) for windows in todo]
    if not rest:
        return out.drop("row")
    merged = reduce(DataFrame.unionByName, rest, out).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("_h"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in xs])).astype("<i4").tobytes() for xs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.binary()), batch.column(3)],
                                             names=["doc_id", "n_words", "hits", "items"])

    return map_arrow(merged.select("doc_id", "n_words", "_h", "items"), unite, f"doc_id {kind}, n_words bigint, hits binary, items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have no window of the benchmark. They are told
    apart by their texts, on which alone it depends; rows without an id or with the same id are not one."""
    names = docs.columns
    # positions for names, so that no column clashes with another or with ours
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = F.col(f"c{names.index(text)}")
    keyed = plain.withColumn("key", F.sha2(body.cast("binary"), 256))
    found = decontaminate(keyed.select("key", body.alias(text)), benchmark, "key", item_id, text)
    clean = drop_ids(keyed, found.where("octet_length(hits) > 0").select("doc_id"), "key")
    return clean.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", (F.octet_length("hits") / 4).cast("long").alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.octet_length("hits") > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same on a few rows, word by word (for tests)."""
    import re

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    spans: dict[tuple, set] = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            spans.setdefault(tuple(ws[i : i + window]), set()).add(str(item))
    sizes = {len(s) for s in spans}
    out = []
    for doc, text in docs:
        ws, hit, got = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if own := spans.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    got |= own
        out.append((doc, len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
