"""Language identification by nearest centroids: normalised TF-IDF vectors of character n-grams,
several clustered centroids per language, cosine similarity, and rejection by distance.

Features are the byte trigrams and bigrams of the lower-cased text with every run of signs, digits
and blanks as one blank, hashed to BUCKETS; the document frequencies behind the IDF weights are
counted over all training rows. Centroids are spherical k-means of at most SAMPLE documents of
each language (by hash of the id), CLUSTERS each; a language's own group holds that bounded
sample only. A text whose best cosine is below its centroid's REJECT quantile over that sample,
less a margin, is marked as rejected (an unknown language); the nearest language is still given.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; without
any training rows every text is `und`; null languages or ids don't train; ties go to the first
language by name; repeated rows get equal results; empty tables give empty results; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import BROADCAST_IDS, byte_chunks, cut, map_arrow, table
from dealgraph.llm.quality import held_out

BUCKETS = 1 << 12
#: Per language: documents that are clustered at most, and centroids.
SAMPLE, CLUSTERS, STEPS = 800, 4, 12
#: The quantile of cosines, and what is taken off it, below which a text is rejected.
REJECT, MARGIN = 0.01, 0.05

#: Lower-cased letters stand for themselves (non-ASCII bytes are parts of letters), all else is a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B], _FOLD[0x80:] = np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts, BUCKETS) of hashed bigrams and trigrams, and whether a text has a letter."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    folded = _FOLD[raw]
    letters = folded != 32
    for d in range(n):
        own = folded[offsets[d] : offsets[d + 1]]
        keep = letters[offsets[d] : offsets[d + 1]].copy()
        keep[1:] |= keep[:-1].copy()  # the first blank after a letter stays
        own = own[keep].astype(np.uint32)
        if len(own) < 2:
            continue
        two = own[:-1] * _MULT[0] + own[1:] * _MULT[1]
        three = two[:-1] + own[2:] * _MULT[2]
        out[d] = np.bincount(np.concatenate([two, three]) * np.uint32(0x27D4EB2F) >> np.uint32(20), minlength=BUCKETS)
    if not n:
        return out, np.zeros(0, bool)
    filled = np.diff(offsets) > 0
    some = np.maximum.reduceat(np.append(folded, 32), offsets[:-1])
    plain = np.add.reduceat(np.append(letters & (folded < 0x80), False).astype(np.int64), offsets[:-1]) > 0
    has = filled & plain
    for d in np.flatnonzero(filled & ~plain & (some >= 0x80)):  # without a-z: is there another letter?
        has[d] = any(c.isalpha() for c in raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "ignore"))
    return out, has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, of unit length."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """IDF over all training rows (text binary); each task gives one row of BUCKETS counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, raw, offsets in byte_chunks(batch, chunk=500_000):
                for a in range(0, len(offsets) - 1, 256):
                    part = offsets[a : a + 257]
                    counts, has = features(raw[part[0] : part[-1]], part - part[0])
                    total, n = total + (counts > 0).sum(0), n + int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "df"])

    parts = cut(map_arrow(train.select("text"), run, "n bigint, df array<bigint>"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(BUCKETS, np.float32)
    for r in parts.select(F.posexplode("df").alias("k", "df")).groupBy("k").agg(F.sum("df").alias("df")).collect():  # BUCKETS rows
        out[r["k"]] = np.log((1 + n) / (1 + r["df"])) + 0.1
    return np.maximum(out, 0)


def cluster(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """Centroids of spherical k-means; an empty cluster takes the vector farthest from its centroid."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        cosine = x @ c.T
        own = cosine.argmax(1)
        for j in range(k):
            members = x[own == j]
            c[j] = members.mean(0) if len(members) else x[cosine.max(1).argmin()]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    """langs: a language per centroid; centroids (n, BUCKETS); floors: cosines below which a text is rejected."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, has = features(raw, offsets)
        if not self.langs:
            return ["und"] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, top, 0.0), ~has | (top < self.floors[best])


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Fits on rows (doc_id, text binary, lang), all of them for the IDF."""
    spark = train.sparkSession
    idf = inverse_frequencies(train)
    held = spark.sparkContext.broadcast(idf)
    # a share of each language by hash of the id: about `sample` rows of each, however many it has
    share = cut(train.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), sample / F.col("n")).alias("share")))
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32("text")), 33) / F.lit(float(1 << 31))
    chosen = train.join(F.broadcast(share) if share.count() <= BROADCAST_IDS else share, "lang").where(spread < F.col("share")).select("lang", "text")

    def centroids(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bodies = sorted(rows["text"])
        offsets = np.cumsum([0, *map(len, bodies)])
        counts, has = features(np.frombuffer(b"".join(bodies), np.uint8), offsets)
        x = vectors(counts[has], held.value)
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        c = cluster(x, clusters)
        cosine = x @ c.T
        own = cosine.argmax(1)
        floors = [float(np.quantile(cosine[own == j, j], REJECT)) - MARGIN if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": key[0], "centroid": [r.astype("<f4").tobytes() for r in c], "floor": floors})

    found = chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, floor double").collect()  # CLUSTERS rows a language
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["centroid"])))
    c = np.array([np.frombuffer(r["centroid"], "<f4") for r in found], np.float32).reshape(-1, BUCKETS)
    return Model(idf, [r["lang"] for r in found], c, np.array([r["floor"] for r in found]))


def identify(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of docs; score is the best cosine."""
    rows = train.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("doc_id is not null and lang is not null and text is not null")))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, offsets in byte_chunks(batch, chunk=500_000):
                for k in range(0, len(offsets) - 1, 256):  # to bound the dense counts
                    part = offsets[k : k + 257]
                    langs, score, rejected = model.value(raw[part[0] : part[-1]], part - part[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + k, len(langs)), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)],
                                                     names=["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(src, run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out("doc_id", 4, 2)))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
