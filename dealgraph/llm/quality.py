"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy
network with temperature-calibrated probabilities.

Word vectors: every word has a sparse ternary index vector drawn from its hash, plus those of its
character trigrams and of its shape, over all of its bytes, so that unseen words are placed too. The context vector of a
word that the sample has twice is the sum of the index vectors of its neighbours over the training sample; its word
vector is the sum of both, each normalised. A document is pooled twice: the mean of its word
vectors, and the mean product of the vectors of adjacent words, which shows repetition; its
length's logarithm and share of distinct words are added.

The fit uses a bounded sample: at most MAX_FIT labelled documents (by hash of the id), of which a
fifth sets the temperature. Scoring reads
every whole text. Labels are joined by id; neither ids nor any other column enter a score.

Defined results: a null or wordless text pools to zeros and gets the network's score for that;
without labels of both classes every score is the share of label 1 (0.5 without labels); rows
with null labels or ids don't train; repeated rows get equal scores; empty tables give empty results.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import BLANK, U, byte_chunks, cut, hash_words, lower_ascii, map_arrow, mix, table, words_in

#: Labelled documents that the fit uses at most. All words that occur twice in them have context vectors.
MAX_FIT = 4_000
#: Words whose vectors are made and sent at once.
WORDS_AT_ONCE = 8_000
DIM, NONZERO, WINDOW = 64, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 120, 0.01, 1e-4
THRESHOLD = 0.3


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod folds is the held-out remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def _index(keys: np.ndarray) -> np.ndarray:
    """Sparse ternary index vectors of hashed keys."""
    out = np.zeros((len(keys), DIM), np.float32)
    rows = np.arange(len(keys))
    h = mix(keys)
    for k in range(NONZERO):
        h = mix(h + U(0x9E3779B97F4A7C15))
        np.add.at(out, (rows, (h % U(DIM)).astype(np.int64)), np.where((h >> U(40)) & U(1), np.float32(1), np.float32(-1)))
    return out


#: Classes of bytes for the shape: lower case (and non-ASCII), upper case, digits, and four of signs.
_CLASS = np.arange(256, dtype=np.int64) % 4 + 3
_CLASS[0x61:0x7B], _CLASS[0x80:], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 0, 1, 2
#: Index vectors of hashed trigrams and shapes.
_GRAMS = _index(mix(np.arange(1 << 14, dtype=U) + U(1 << 32)))
_SHAPES = _index(mix(np.arange(1 << 12, dtype=U) + U(1 << 33)))
#: Words of more bytes than this are added up one at a time, in pieces of so many bytes.
_LONG, _PIECE = 256, 1 << 18


def _keys(low: np.ndarray, back: np.ndarray, back2: np.ndarray) -> np.ndarray:
    """The numbers of the trigrams that end at each byte."""
    return (low * np.uint32(0x9E3779B1) + back * np.uint32(0x85EBCA6B) + back2 * np.uint32(0xC2B2AE35)) >> np.uint32(18)


def _long(word: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum of a long word's trigrams' index vectors, and a bit for each class of its bytes."""
    count, some = np.zeros(len(_GRAMS), np.int64), np.zeros(8, bool)
    for a in range(0, len(word), _PIECE):
        low = np.zeros(len(part := word[a : a + _PIECE]) + 2, np.uint32)
        low[2:] = lower_ascii(part)
        if a:
            low[:2] = lower_ascii(word[a - 2 : a])
        key = _keys(low[2:], low[1:-1], low[:-2])
        some[_CLASS[part]] = True
        if len(word) <= 8192:  # counting first pays for longer words only
            return _GRAMS[key].sum(0), int((1 << np.flatnonzero(some)).sum())
        count += np.bincount(key, minlength=len(_GRAMS))
    used = np.flatnonzero(count)
    return (count[used].astype(np.float64) @ _GRAMS[used]).astype(np.float32), int((1 << np.flatnonzero(some)).sum())


def _static(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unit vectors of words from themselves: the mean of their trigrams' index vectors, and that of
    their shape (the classes of bytes they have, the first and the last one), which weighs more."""
    sums, some = np.zeros((len(starts), DIM), np.float32), np.zeros(len(starts), np.int64)
    short = np.flatnonzero(ends - starts <= _LONG)
    if len(short):
        sums[short], some[short] = _short(raw, starts[short], ends[short])
    for k in np.flatnonzero(ends - starts > _LONG):
        sums[k], some[k] = _long(raw[starts[k] : ends[k]])
    shape = some | _CLASS[raw[starts]] << 7 | _CLASS[raw[ends - 1]] << 10
    return _unit(_unit(sums) + 1.5 * _unit(_SHAPES[(mix(shape.astype(U)) >> U(52)).astype(np.int64)]))


def _short(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _long() gives, of many short words at once."""
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first - starts, n)
    low = lower_ascii(raw[at]).astype(np.uint32)
    back = low.copy()
    back[1:] = low[:-1]
    back[first] = 0
    back2 = back.copy()
    back2[1:] = back[:-1]
    back2[first] = 0
    key = _keys(low, back, back2)
    order = np.argsort(-n, kind="stable")
    begin, grams = first[order], np.zeros((len(n), DIM), np.float32)
    for k in range(int(n.max(initial=0))):  # the k-th trigram of all words that are long enough
        m = int(np.count_nonzero(n > k))
        grams[:m] += _GRAMS[key[begin[:m] + k]]
    grams[order] = grams.copy()
    return grams, np.bitwise_or.reduceat(1 << _CLASS[raw[at]], first)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-6)


class Pool:
    """Pools texts with the word vectors of a vocabulary; other words are placed by _static()."""

    def __init__(self, hashes: np.ndarray, vectors: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.vectors = hashes[order], vectors.astype(np.float16)[order]  # half the size to hand out, and no less told

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, firsts = words_in(raw, offsets, ~BLANK)
        n = np.diff(firsts)
        out = np.zeros((len(n), 2 * DIM + 2), np.float32)
        if not len(starts):
            return out
        distinct, first, at = np.unique(hash_words(raw, starts, ends), return_index=True, return_inverse=True)
        vectors = np.zeros((len(distinct), DIM), np.float32)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            k = np.searchsorted(self.hashes, distinct)
            k[k == len(self.hashes)] = 0
            known = self.hashes[k] == distinct
            vectors[known] = self.vectors[k[known]]
        new = np.flatnonzero(~known)
        for a in range(0, len(new), 5000):
            part = new[a : a + 5000]
            vectors[part] = _static(raw, starts[first[part]], ends[first[part]])
        full = np.flatnonzero(n)
        for a in range(0, len(full), 64):  # some documents at a time, to bound the vectors held
            docs = full[a : a + 64]
            lo, hi = int(firsts[docs[0]]), int(firsts[docs[-1] + 1])
            v = vectors[at[lo:hi]]
            begin = firsts[docs] - lo
            for d, b in zip(docs, begin, strict=True):
                own = v[b : b + n[d]]
                out[d, :DIM] = own.sum(0) / n[d]
                out[d, DIM : 2 * DIM] = np.einsum("ij,ij->j", own[1:], own[:-1]) / max(1, n[d] - 1)
        out[:, -2] = np.log1p(n) / 10
        for d in full:
            out[d, -1] = len(np.unique(at[firsts[d] : firsts[d + 1]])) / n[d]
        return out


def _contexts(sample: DataFrame, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors of the words: sums over the sample of their neighbours' index vectors.
    Each task adds up its own documents; the driver adds up one bounded matrix per task."""
    if not words:
        return np.zeros(0, U), np.zeros((0, DIM), np.float32)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    hashes, static = np.empty(len(words), U), np.empty((len(words), DIM), np.float32)
    for at in range(0, len(words), WORDS_AT_ONCE):  # the vectors of all characters' trigrams at once would be many times as large
        part = slice(at, at + WORDS_AT_ONCE)
        own = flat[starts[at] : ends[part][-1]]
        hashes[part] = hash_words(own, starts[part] - starts[at], ends[part] - starts[at])
        static[part] = _static(own, starts[part] - starts[at], ends[part] - starts[at])
    del flat
    order = np.argsort(hashes)
    hashes, static = hashes[order], static[order]
    held = sample.sparkSession.sparkContext.broadcast((hashes, static))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = held.value
        total = np.zeros((len(names), DIM), np.float32)
        for batch in batches:
            for _, _, raw, offsets in byte_chunks(batch, chunk=200_000):
                starts, ends, firsts = words_in(raw, offsets, ~BLANK)
                h = hash_words(raw, starts, ends)
                k = np.searchsorted(names, h)
                k[k == len(names)] = 0
                known = names[k] == h
                v = np.where(known[:, None], own[k], 0)
                doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                for gap in range(1, WINDOW + 1):
                    same = doc[gap:] == doc[:-gap]
                    for a, b in ((np.flatnonzero(same & known[gap:]) + gap, -gap), (np.flatnonzero(same & known[:-gap]), gap)):
                        np.add.at(total, k[a], v[a + b])
        used = np.flatnonzero(np.abs(total).sum(1))
        for at in range(0, len(used), WORDS_AT_ONCE):
            rows = used[at : at + WORDS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array([rows.astype("<i4").tobytes()]), pa.array([total[rows].tobytes()])], names=["rows", "sums"])

    total = np.zeros((len(words), DIM), np.float32)
    for row in map_arrow(sample.coalesce(8), run, "rows binary, sums binary").toLocalIterator():
        total[np.frombuffer(row["rows"], "<i4")] += np.frombuffer(row["sums"], np.float32).reshape(-1, DIM)
    held.destroy()  # a session that fits again and again would keep them all
    for at in range(0, len(total), WORDS_AT_ONCE):
        rows = slice(at, at + WORDS_AT_ONCE)
        static[rows] = _unit(static[rows] + 0.5 * _unit(total[rows]))
    return hashes, static


class Network:
    """Inputs standardised, one hidden layer of tanh, a logistic output divided by the temperature."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.layers, self.temperature = prior, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        if len(y):
            self.prior = float(y.mean())
        if len(np.unique(y)) < 2:
            return self
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        cal = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        z, t = ((x - self.mean) / self.scale)[~cal], y[~cal].astype(np.float32)
        w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(t))
            for a in range(0, len(t), 256):
                zb, tb = z[order[a : a + 256]], t[order[a : a + 256]]
                h = np.tanh(zb @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3][0]))) - tb) / len(tb)
                dh = np.outer(d, w[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((zb.T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], np.array([d.sum()]))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = [p.astype(np.float32) for p in w]
        if cal.any() and len(np.unique(y[cal])) == 2:
            # the temperature of the least log loss on the calibration part; its targets stay off 0 and 1
            # by the share that one more document of either class would have
            logit, n1, n0 = self.logits(x[cal]).astype(np.float64), int(y[cal].sum()), int((1 - y[cal]).sum())
            t = np.where(y[cal] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
            self.temperature = float(min(np.geomspace(0.25, 32, 85), key=lambda k: float(np.mean(np.logaddexp(0, logit / k) - t * logit / k))))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w[0] + w[1]) @ w[2] + w[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))


def _let_go() -> None:
    """Gives freed memory back to the system. The C library keeps that of arrays of some MB, which stays the driver's through all that follows a fit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fit(train: DataFrame) -> tuple[Pool, Network]:
    """Fits on a bounded sample (doc_id, text binary, label 0/1)."""
    sample = cut(train.coalesce(8))
    pieces = sample.select(F.explode(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    top = pieces.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy("w")
    hashes, vectors = _contexts(sample, [r["w"].encode() for r in top.select("w").toLocalIterator()])
    pool = Pool(hashes, vectors)
    del hashes, vectors
    held = sample.sparkSession.sparkContext.broadcast(pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch):
                x = held.value(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).cast(pa.int32()),
                                                  pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(sample, run, f"doc_id {kind}, label int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label").collect()  # MAX_FIT rows at most
    held.destroy()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(len(rows), 2 * DIM + 2)
    network = Network().fit(x, np.array([r["label"] for r in rows], np.int64))
    del rows, x
    _let_go()
    return pool, network


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int = MAX_FIT) -> DataFrame:
    """At most `most` labelled rows (doc_id, text, label), the same in each run; of several texts of one id the smallest, null before all."""
    ids = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
           .where(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, score) for every row: the calibrated probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, doc_id, text, label)))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, network = model.value
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(network(pool(raw, offsets)).astype(np.float64))],
                                                 names=["doc_id", "score"])

    return map_arrow(src, run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels, doc_id, text, label)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, network = model.value
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch, text):
                yield batch.slice(a, b - a).filter(pa.array(network(pool(raw, offsets)) >= threshold))

    return map_arrow(docs, run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
