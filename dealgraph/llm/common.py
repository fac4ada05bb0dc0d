"""Helpers that the corpus operators share: cutting lineage, size-checked joins,
distributed ranks and prefix sums, connected components, and numpy kernels that
tokenise and hash whole Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of (id) that may be broadcast; 8 bytes each, so 4 MB before hashing.
BROADCAST_IDS = 500_000
#: Text bytes that a numpy kernel handles at once (a longer text is a chunk of its own).
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder of the session;
    only where none is configured (tests, a local shell) is a local folder set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        set_dir = sc.getConf().get("spark.checkpoint.dir")
        if not set_dir and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="dealgraph-checkpoint-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a table written to the shared folder of the session. Where steps build on one
    another this is to be preferred to cut(): a checkpoint keeps the size that was estimated for its plan, and
    that of a join is the product of both sides', so in a chain of joins the number's digits double each time
    until they fill the driver's memory. A table has the size of its files."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        cut(spark.range(0))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def forget(df: DataFrame) -> None:
    """Deletes the files of a table of stored() that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(os.path.dirname(df.inputFiles()[0])) if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_by(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Deals the rows out by the keys and cuts the lineage. The plan of what is read again says so
    that later groupings by the keys shuffle nothing; for that, the one job here runs without
    adaptive execution, which hides the partitioning of its result."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(partitions, *keys))
    finally:
        conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_dealgraph_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="dealgraph-"), "dealgraph_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("dealgraph", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._dealgraph_shipped = True


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def only(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that extra columns of an input never clash."""
    return docs.select(*[F.col(c) for c in cols])


def semi_join(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids; ids are broadcast only if their counted size is small."""
    small = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    return df.join(small, key, "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not among ids (doc_id), which are counted before they are
    broadcast; null ids can't be told apart and go together."""
    gone = cut(ids.select(F.col("doc_id").alias("_gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[doc_id].eqNullSafe(side["_gone"]), "left_anti")


def gapless_rank(df: DataFrame, parts: Sequence[str], key: Column, bits: int = 32, rows_per_cell: int = 50_000,
                 weight: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Adds `rank` (0-based, by `key` within `parts`) and, with `weight`, `before` (sum of the
    weights ranked earlier) without putting a whole partition in one task.

    key is an integer column spread evenly over [0, 2**bits): its top bits deal the rows of each
    part to cells of about rows_per_cell rows, cells are summed and their sums added up, and only
    the rows of one cell are sorted together. tie orders rows with equal keys.
    """
    n = df.count()
    cell_bits = max(0, min(bits - 1, int(np.ceil(np.log2(max(1, n / rows_per_cell))))))
    keyed = df.withColumn("_key", key).withColumn("_cell", F.shiftrightunsigned(F.col("_key"), bits - cell_bits))
    sums = keyed.groupBy(*parts, "_cell").agg(F.count("*").alias("_n"), *([F.sum(weight).alias("_w")] if weight else []))
    over = Window.partitionBy(*parts).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parts)], F.col("_cell").alias("_c"),
                          F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"),
                          *([F.coalesce(F.sum("_w").over(over), F.lit(0)).alias("_w0")] if weight else []))
    same = F.col("_cell") == F.col("_c")
    for i, p in enumerate(parts):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    inside = Window.partitionBy(*parts, "_cell").orderBy("_key", *tie)
    ranked = keyed.withColumn("_r", F.row_number().over(inside) - 1)
    if weight:
        ranked = ranked.withColumn("_b", F.coalesce(
            F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranked.join(offsets, same, "left").withColumn("rank", (F.col("_n0") + F.col("_r")).cast("long"))
    if weight:
        out = out.withColumn("before", (F.col("_w0") + F.col("_b")).cast("long"))
    return out.select(*df.columns, "rank", *(["before"] if weight else []))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(src, dst): (id, component) with the smallest id reachable.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join on the
    vertex, until a round changes nothing; Spark splits the join of a vertex with very many neighbours."""
    e = stored(edges.select("src", "dst").where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.distinct())
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        forget(e)
        e = after
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


# ---------------------------------------------------------------- numpy kernels

U = np.uint64
#: Byte classes: blanks are \x20 and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Multiplier of the byte polynomial (odd, so it has an inverse modulo 2**64).
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for name, base in (("p", _P), ("i", _PI)):
            a = np.full(n, base, U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_chunks(batch: pa.RecordBatch, text: str = "text", chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) for pieces of a batch of texts.
    Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(text))
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_in(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the concatenated texts, and each text's first word (n + 1 entries)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[raw]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begin[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    p, pi = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * p[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * pi[starts] + (ends - starts).astype(U))


_ODD = mix(np.arange(1, 65, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words (over all words; callers drop runs that cross texts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n] * _ODD[0]
    for k in range(1, size):
        out += words[k : k + n] * _ODD[k]
    return mix(out)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def take_rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
