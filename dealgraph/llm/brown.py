"""LM scoring with Brown's class-based bigrams.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)), both smoothed by additive counts, interpolated
with add-one unigrams. The training words are counted over the whole corpus. Exchange clustering moves units between CLASSES
classes, one at a time, to where the mutual information of adjacent classes is largest. A
unit is one of the TOP most frequent words, or all rarer words that agree in their last two
bytes and in having signs (TAILS units at most), so that every word, seen or not, has a class.
The clustering reads the bigram counts of units (a bounded matrix, added up over all training
texts); class transitions and emissions then follow from the same counts.

Counts of the HEAD most frequent words are broadcast (a bounded table); an occurrence of any other
word is joined with the table of all counts on the word, so nothing is cut off. Rare words with
many occurrences don't exist, so that join has no hot key.

A text's score is the log10 probability of its words and of one end token; it starts after an end.

Defined results: a null or blank text is an end token alone; an empty training set gives N = V = 0
and every token the probability 1; null ids never train; repeated rows train and are scored each;
empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import cut, map_arrow, table
from dealgraph.llm.quality import held_out

#: Words that are units by themselves, units of rarer words, classes, and rounds of exchanges.
TOP, TAILS, CLASSES, SWEEPS = 1_500, 200, 48, 6
#: Words whose counts are broadcast (some 4 MB).
HEAD = 150_000
#: Weight of the class model against add-one unigrams, and what is added to a word's count within its class.
LAMBDA, DELTA = 0.95, 0.25
#: The end token; no word has a blank in it.
END = b" "


def tokens(body: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end token."""
    return [*body.lower().split(), END]


def tail_unit(word: bytes) -> int:
    """The unit of a word that is not among the most frequent."""
    signs = not word.isalnum() and any(b < 0x80 and not (48 <= b < 58 or 97 <= b < 123) for b in word)
    return zlib.crc32(word.rstrip(b".,;:!?")[-2:] + (b"!" if signs else b"")) % TAILS


def count_words(train: DataFrame) -> DataFrame:
    """(word binary, n) over all rows (text binary), the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for body in batch.column(0):
                total.update(tokens(body.as_py() or b""))
                if len(total) > 400_000:  # bounds the memory of a task; what was sent is added up by the shuffle
                    yield flush()
        if total:
            yield flush()

    return map_arrow(train.select("text"), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_units(train: DataFrame, top: dict[bytes, int], units: int) -> np.ndarray:
    """Counts (units, units) of adjacent units over all rows. A task's matrix is sent in one row per
    unit and added up by unit; the driver gets one row per unit."""
    held = train.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = dict(held.value), np.zeros((units, units), np.int32)
        rare: dict[bytes, int] = {}
        for batch in batches:
            for body in batch.column(0):
                ids = []
                for w in tokens(body.as_py() or b""):
                    u = own.get(w)
                    if u is None:
                        u = rare.get(w)
                        if u is None:
                            if len(rare) > 200_000:
                                rare.clear()
                            u = rare[w] = len(own) + tail_unit(w)
                    ids.append(u)
                x = np.array([own[END], *ids])
                np.add.at(total.reshape(-1), x[:-1] * units + x[1:], 1)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([zlib.compress(total[k].tobytes(), 1) for k in some], pa.binary())], names=["unit", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["unit", "counts"])

    def add_table(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(key, rows.to_batches())))

    out = np.zeros((units, units), np.int64)
    parts = map_arrow(train.select("text"), run, "unit bigint, counts binary")
    for r in parts.groupBy("unit").applyInArrow(add_table, "unit bigint, counts binary").toLocalIterator():  # a row per unit
        out[r["unit"]] = np.frombuffer(r["counts"], np.int64)
    return out


def rare_types(counts: DataFrame, top: dict[bytes, int]) -> DataFrame:
    """(unit, types): the number of distinct words of each unit of rarer words."""
    held = counts.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = held.value, np.zeros(TAILS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word not in own:
                    total[tail_unit(word)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS) + len(own)), pa.array(total)], names=["unit", "types"])

    return map_arrow(counts.select("word"), run, "unit bigint, types bigint").groupBy("unit").agg(F.sum("types").alias("types"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, fixed: int = 0) -> np.ndarray:
    """A class per unit from the counts of adjacent units. Unit `fixed` (the end) keeps class 0 for
    itself. Units start by frequency, in turn, and each in turn moves to the class that raises
    sum N(c, d) log N(c, d) - 2 sum N(c) log N(c) the most, until a sweep moves none."""
    units = len(pairs)
    n = pairs.sum(1).astype(np.float64)
    order = [u for u in np.argsort(-n, kind="stable") if u != fixed]
    own = np.zeros(units, np.int64)
    for k, u in enumerate(order):
        own[u] = 1 + k % (classes - 1)
    joint = np.zeros((classes, classes))
    np.add.at(joint, (own[:, None], own[None, :]), pairs)
    size = joint.sum(1)
    pairs_t = np.ascontiguousarray(pairs.T)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not n[u]:
                continue
            a = own[u]
            loop = float(pairs[u, u])
            after = np.bincount(own, pairs[u], classes)  # u -> class
            before = np.bincount(own, pairs_t[u], classes)  # class -> u
            after[a] -= loop
            before[a] -= loop
            # take u out of its class
            joint[a] -= after
            joint[:, a] -= before
            joint[a, a] -= loop
            size[a] -= n[u]
            # the gain of each class: its row and column change, and its size
            row, col = joint + after, joint + before[:, None]
            gain = (_xlogx(row) - _xlogx(joint)).sum(1) + (_xlogx(col) - _xlogx(joint)).sum(0)
            d = np.diag(joint)
            gain += _xlogx(d + after + before + loop) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
            gain -= 2 * (_xlogx(size + n[u]) - _xlogx(size))
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += after
            joint[:, b] += before
            joint[b, b] += loop
            size[b] += n[u]
            own[u] = b
            moved += b != a
        if not moved:
            break
    return own


class Model:
    """What scoring needs: the units of the most frequent words, a class per unit, log-free transition
    probabilities over emission totals, N, V, and the counts of the head."""

    def __init__(self, top: dict[bytes, int], own: np.ndarray, pairs: np.ndarray, types: np.ndarray, total: int, vocabulary: int, head: dict[bytes, int], lam: float = LAMBDA):
        classes = int(own.max()) + 1
        joint = np.zeros((classes, classes))
        np.add.at(joint, (own[:, None], own[None, :]), pairs)
        size = joint.sum(0)
        words = np.bincount(own, types, classes)
        # transitions over the emissions' totals; the emission's numerator n(w) + DELTA is put in later
        self.step = lam * (joint + 1) / (joint.sum(1, keepdims=True) + classes) / (size + DELTA * (words + 1))
        self.top, self.own, self.total, self.vocabulary, self.head, self.lam = top, own, total, vocabulary, head, lam if total else 0.0

    def sort(self, words: list[bytes], memory: dict) -> np.ndarray:
        """The classes of the words."""
        out = []
        for w in words:
            c = memory.get(w)
            if c is None:
                if len(memory) > 300_000:
                    memory.clear()
                u = self.top.get(w)
                c = memory[w] = int(self.own[len(self.top) + tail_unit(w) if u is None else u])
            out.append(c)
        return np.array(out)


def fit(train: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of rows (text binary), and the table (word, n) of all training words."""
    counts = cut(count_words(train))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    frequent = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(head).toLocalIterator()]
    # the end token comes first, then the most frequent words
    top = {END: 0}
    for w, _ in frequent[: TOP + 1]:
        top.setdefault(w, len(top))
    units = len(top) + TAILS
    pairs = count_units(train, top, units)
    types = np.zeros(units, np.int64)
    types[: len(top)] = 1
    for r in rare_types(counts, top).collect():  # a row per unit of rarer words
        types[r["unit"]] = r["types"]
    return Model(top, exchange(pairs), pairs, types, total["n"] or 0, total["v"] or 0, dict(frequent)), counts


def score_texts(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs."""
    model, counts = fit(train.where(F.col(doc_id).isNotNull()).select(F.col(text).cast("binary").alias("text")))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    # rows are numbered, so that those with equal ids stay apart; each is numbered once, before the checkpoint
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = held.value, {}
        scale = m.total + m.vocabulary + 1
        names = ["row", "doc_id", "word", "times", "rate", "tokens", "known", "base", "score"]
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for name, body, key in zip(batch.column(0).slice(a, 200).to_pylist(), batch.column(1).slice(a, 200), batch.column(2).slice(a, 200).to_pylist(), strict=True):
                    body = body.as_py() or b""
                    words = tokens(body)
                    n = np.array([m.head.get(w, 0) for w in words], np.float64)
                    kinds = m.sort(words, memory)
                    rate = m.step[np.r_[0, kinds[:-1]], kinds]
                    low = (n + 1) / scale
                    sure = n > 0
                    out.append((key, name, None, 0, 0.0, len(words), int(sure.sum()), float(np.log10(low[sure]).sum()),
                                float(np.log10(rate[sure] * (n[sure] + DELTA) + (1 - m.lam) * low[sure]).sum())))
                    rest = Counter((words[k], float(rate[k])) for k in np.flatnonzero(~sure))
                    out += [(key, None, w, times, r, 0, 0, 0.0, 0.0) for (w, r), times in rest.items()]
                kinds = [pa.int64(), batch.column(0).type, pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(9)], names=names)

    return _finish(map_arrow(src, run, f"row bigint, doc_id {kind}, word binary, times bigint, rate double, tokens bigint, known bigint, base double, score double"), counts, model)


def _finish(parts: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    parts = cut(parts)
    scale, lam = float(model.total + model.vocabulary + 1), model.lam
    rare = parts.where("word is not null").select("row", "word", "times", "rate").join(counts, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    low = (n + 1) / scale
    tail = rare.select("row", F.lit(None).cast(parts.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("bigint").alias("tokens"),
                       F.when(n > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(low)).alias("base"),
                       (F.col("times") * F.log10(F.col("rate") * (n + DELTA) + (1 - lam) * low)).alias("score"))
    whole = parts.where("word is null").select("row", "doc_id", "tokens", "known", "base", "score").unionByName(tail)
    out = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
    return out.select("doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("tokens")).alias("perplexity"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, docs.where(~held_out("doc_id", 7, 2)))
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
