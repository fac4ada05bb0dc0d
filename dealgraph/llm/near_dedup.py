"""MinHash near-duplicates with tensored banding.

Instead of one small collection of minhashes for each of L tables, two collections of SIDE band
keys are computed (2 * SIDE * ROWS minhashes in all) and every pair of a left and a right key is
the key of one of SIDE**2 tables. Two sets of similarity s meet in some table with probability
(1 - (1 - s**ROWS)**SIDE)**2: 0.997 at s = 0.75 with 64 tables from 32 minhashes, where plain
banding would take 256.

Equal sets are grouped first by a 128-bit signature, so that only distinct sets are compared.
A pair meets in a table only if it meets on either side, so keys whose left or right half is
unique are never formed. Candidates are verified on full shingle sets. The pairs of a bucket of up
to SMALL members are all verified, each pair in one of its buckets only, that of the first keys it
shares on either side, and only if the sets' sizes allow the similarity. Members of larger buckets are
first compared with PIVOTS members of their bucket, one after the other: those that share most of their
elements with other sets. What is linked gets one label, and pairs of one label add nothing to its
component, so that a large group of copies costs some comparisons a member. Then all pairs of different
labels are verified, but for those that exact bounds rule out: two sets have no more elements in
common than either has that occur in any other set, and, beside what either has in common with a pivot,
no more than either has of such elements outside the pivot. So this finds the components that comparing all
pairs would, without emitting all pairs of a large group.

Defined results: a null or wordless text has an empty set and no links; texts of fewer words
than a shingle have their whole word sequence as the only element; repeated rows are exact
copies; rows that repeat an id with other texts are linked each for itself; a null id links with
nothing and its row stays; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import BLANK, BROADCAST_IDS, U, byte_chunks, components, hash_windows, hash_words, lower_ascii, map_arrow, mix, stored, table, words_in

SHINGLE = 5
#: 100 * intersection >= PERCENT * union links two sets.
PERCENT = 75
#: Band keys of each side, and minhashes of a band key.
SIDE, ROWS = 8, 2
#: Members (distinct sets) up to which all pairs of a bucket are verified at once.
SMALL = 32
#: Members with which those of a larger bucket are compared, one after the other, before the pairs that are left.
PIVOTS = 3

_SEEDS = mix(np.arange(1, 2 * SIDE * ROWS + 1, dtype=U) * U(0x9E6C63D0876A9A35))
_FACTORS = mix(_SEEDS) | U(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = lower_ascii(raw)
    starts, ends, firsts = words_in(raw, offsets, ~BLANK)
    words = hash_words(raw, starts, ends)
    windows = hash_windows(words, size)
    for d in range(len(offsets) - 1):
        a, b = int(firsts[d]), int(firsts[d + 1])
        if b - a >= size:
            found = np.sort(windows[a : b - size + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            yield hash_windows(words[a:b], b - a) + U(b - a)
        else:
            yield np.zeros(0, U)


def band_keys(found: np.ndarray) -> np.ndarray:
    """2 * SIDE band keys of a non-empty set: the left ones, then the right ones."""
    least = np.empty(len(_SEEDS), U)
    for at in range(0, len(found), 4096):
        part = (found[at : at + 4096, None] ^ _SEEDS) * _FACTORS
        least = part.min(0) if at == 0 else np.minimum(least, part.min(0))
    key = np.arange(2 * SIDE, dtype=U)
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + least[r::ROWS])
    return key


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n_shingles, signature, bands) for rows (doc_id, text binary, key binary)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch):
                n, signature, bands = [], [], []
                for found in shingle_sets(raw, offsets, size):
                    n.append(len(found))
                    signature.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    bands.append(band_keys(found).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(signature, pa.binary()),
                                                  pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "signature", "bands"])

    return map_arrow(docs, run, f"doc_id {kind}, key binary, n_shingles bigint, signature binary, bands array<bigint>")


def full_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, elements) for rows (id, text binary): the shingle hashes, sorted as unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in byte_chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.view(np.int64) for x in shingle_sets(raw, offsets, size)], pa.list_(pa.int64()))],
                                                 names=["id", "elements"])

    return map_arrow(docs, run, "id bigint, elements array<bigint>")


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, left, right, id, n, bands, m): the members of the tables' buckets that have at least
    two distinct sets, m in number. reps: (id, n, bands)."""
    halves = reps.select("id", F.posexplode("bands").alias("k", "band"))
    alive = halves.groupBy("k", "band").agg(F.count("*").alias("n")).where("n > 1").select("k", "band")
    # what is left of a set's keys: 2 * SIDE at most
    kept = halves.join(alive, ["k", "band"], "left_semi").groupBy("id").agg(F.collect_list(F.struct("k", "band")).alias("h"))
    pairs = (kept.select("id", F.explode(F.filter("h", lambda x: x["k"] < SIDE)).alias("l"), F.filter("h", lambda x: x["k"] >= SIDE).alias("r"))
             .select("id", "l", F.explode("r").alias("r")))
    keyed = stored(pairs.select(F.xxhash64("l.k", "r.k", "l.band", "r.band").alias("bucket"), F.col("l.k").alias("left"), F.col("r.k").alias("right"), "id"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    return stored(keyed.join(shared, "bucket").join(reps, "id"))


def first_meeting(a: str, b: str) -> Column:
    """Whether `left` and `right` are the first keys of either side that two sets share."""
    def first(lo: int, hi: int) -> Column:
        out = F.lit(-1)
        for k in reversed(range(lo, hi)):
            out = F.when(F.col(a)[k] == F.col(b)[k], k).otherwise(out)
        return out

    return (F.col("left") == first(0, SIDE)) & (F.col("right") == first(SIDE, 2 * SIDE))


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar enough."""
    return measured(pairs, sets, percent).where("linked").select("a", "b")


def measured(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, common, linked) of pairs (a, b) of ids: the size of their sets' intersection, and whether they are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            commons, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy().view(U), y.values.to_numpy().view(U)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                commons.append(common)
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(commons, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "common", "linked"])

    return map_arrow(both, run, f"a {kind}, b {kind}, common bigint, linked boolean")


def linkable(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, common) of the sets that may have a link with another of these at all: `common` of a set's elements
    occur in any other one. A link needs `percent` of a set's elements in one other set, so a set with fewer has
    none; nor do its elements help any other set, so it is done twice. This spares a large group of copies the
    comparison of those of its members that differ too much from each other."""
    one = stored(sets.select("id", F.size("elements").alias("n"), F.explode("elements").alias("h")))
    for _ in range(2):
        shared = one.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
        found = stored(one.join(shared, "h", "left_semi").groupBy("id").agg(F.count("*").alias("common"), F.first("n").alias("n")).where(100 * F.col("common") >= percent * F.col("n")).select("id", "common"))
        one = one.join(found.select("id"), "id", "left_semi")
    return found


def may_link(percent: int, n: str, common: str, other_n: str, other_common: str) -> Column:
    """Whether two sets of these sizes, with so many elements that occur in any other set, may be similar enough."""
    most = F.least(common, other_common)
    return 100 * most >= percent * (F.col(n) + F.col(other_n) - most)


def may_link_beside(percent: int) -> Column:
    """The same, where it is known what the two sets have in common with the pivots that their bucket had: beside no more of the pivot than either has, they can only share
    elements outside of it that occur in any other set."""
    most = F.least("common", "pc")
    for step in range(PIVOTS):
        mine, other = F.col(f"ov{step}"), F.col(f"po{step}")
        most = F.least(most, F.when(mine.isNotNull() & other.isNotNull(), F.least(mine, other) + F.least(F.col("common") - mine, F.col("pc") - other)).otherwise(most))
    return 100 * most >= percent * (F.col("n") + F.col("pn") - most)


def pairs_of_small(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the candidate pairs in buckets of at most SMALL members, each pair once."""
    one = members.where(F.col("m") <= SMALL)
    other = one.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("other"))
    meet = (F.col("id") < F.col("b")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")) & first_meeting("bands", "other")
    return one.join(other, "bucket").where(meet).select(F.col("id").alias("a"), "b")


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after the links (a, b): every label goes to the least one that it is linked
    with, and on to where that one goes."""
    x, y = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    joined = links.join(x, "a").join(y, "b").select(F.greatest("x", "y").alias("label"), F.least("x", "y").alias("least")).where("label <> least")
    hook = stored(joined.groupBy("label").agg(F.min("least").alias("least")))
    onward = hook.select(F.col("label").alias("least"), F.col("least").alias("onward"))
    hook = hook.join(onward, "least", "left").select("label", F.coalesce("onward", "least").alias("to"))
    return labels.join(hook, "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def links_of_large(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> list[DataFrame]:
    """Links (a, b) that give the buckets of more than SMALL members their components."""
    large = members.where(F.col("m") > SMALL).select("bucket", "left", "right", "id", "n", "bands")
    ids = stored(large.select("id").distinct())
    if ids.isEmpty():
        return []
    may = stored(linkable(sets.join(ids, "id", "left_semi"), percent))
    large = stored(large.join(may, "id"))
    labels, links = may.select("id", F.col("id").alias("label")), []
    chosen, shared = [], []  # the pivots of each step, and what was in common with them
    for step in range(PIVOTS + 1):
        # stored, as both what follows and the pairs read it; the bands are needed for the last pairs alone
        placed = large.drop("bands") if step < PIVOTS else large
        placed = stored(placed.join(labels, "id") if step else placed.withColumn("label", F.col("id")))
        # buckets that span several labels, and the label that most of their members have
        size = placed.groupBy("bucket", "label").agg(F.count("*").alias("m"))
        spans = size.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("_x"), F.count("*").alias("k")).where("k > 1").select("bucket", F.col("_x.label").alias("main"))
        placed = placed.join(spans, "bucket")
        if step < PIVOTS:
            # the most central member; later another central one of that label
            share = F.col("common") / F.col("n")
            central = F.struct((F.floor(share * 20) if step else share).alias("share"), F.xxhash64("id", F.lit(step)).alias("by"), F.col("id").alias("pivot"), F.col("label").alias("pl"), F.col("n").alias("pn"), F.col("common").alias("pc"))
            pivots = placed.where((F.col("label") == F.col("main")) if step else F.lit(True)).groupBy("bucket").agg(F.max(central).alias("_p")).select("bucket", "_p.*")
            fits = (F.col("label") != F.col("pl")) & may_link(percent, "n", "common", "pn", "pc")
            pivots = stored(pivots)
            pairs = placed.join(pivots, "bucket").where(fits).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
            told = stored(measured(pairs, sets, percent))
            links.append(told.where("linked").select("a", "b"))
            labels = stored(relabel(labels, links[-1]))
            chosen.append(pivots.select("bucket", F.lit(step).alias("step"), "pivot"))
            shared.append(told.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("pivot"), "common"), F.struct(F.col("b").alias("id"), F.col("a").alias("pivot"), "common"))).alias("_s")).select("_s.*"))
        else:
            # what each member has in common with its buckets' pivots, where they were compared: a set has a few buckets, so a few entries
            of = reduce(DataFrame.unionByName, chosen).groupBy("bucket").agg(*[F.max(F.when(F.col("step") == k, F.col("pivot"))).alias(f"p{k}") for k in range(PIVOTS)])
            known = reduce(DataFrame.unionByName, shared).groupBy("id", "pivot").agg(F.max("common").alias("ov")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "ov"))).alias("_k"))
            placed = stored(placed.join(of, "bucket", "left").join(known, "id", "left").select(*placed.columns, *[F.try_element_at("_k", F.col(f"p{k}")).alias(f"ov{k}") for k in range(PIVOTS)]))
            other = placed.select("bucket", F.col("id").alias("b"), F.col("label").alias("pl"), F.col("n").alias("pn"), F.col("common").alias("pc"), F.col("bands").alias("other"), *[F.col(f"ov{k}").alias(f"po{k}") for k in range(PIVOTS)])
            fits = (F.col("id") < F.col("b")) & (F.col("label") != F.col("pl")) & may_link_beside(percent) & first_meeting("bands", "other")
            links.append(stored(verify(placed.join(other, "bucket").where(fits).select(F.col("id").alias("a"), "b"), sets, percent)))
    return links


def found_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, best) for every row of docs (doc_id, text binary, key binary):
    key is a digest of the text, best whether the row is of the one text that stays of its component."""
    rows = stored(sketch(docs, size))
    linked = rows.where("signature is not null and doc_id is not null")
    reps = stored(linked.groupBy("signature").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
                  .withColumn("id", F.monotonically_increasing_id()))
    members = buckets(reps.select("id", "n", "bands"))
    ids = stored(members.select("id").distinct().join(reps, "id").select("id", F.col("best.doc_id").alias("_d"), F.col("best.key").alias("_k")))
    n_ids = ids.count()
    texts = docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, (docs["doc_id"] == ids["_d"]) & (docs["key"] == ids["_k"])).select("id", "text")
    sets = stored(full_sets(texts, size).dropDuplicates(["id"]))
    links = [stored(verify(pairs_of_small(members, percent), sets, percent)), *links_of_large(members, sets, percent)]
    comps = components(reduce(DataFrame.unionByName, links).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = reps.select("id", "signature", "best").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("best").alias("least"))
    named = stored(named.join(least, "component").select(F.col("signature").alias("_s"), F.col("least.doc_id").alias("_c"), F.col("least.key").alias("_k")))
    # rows without an id or words have no component, and no key to meet on
    out = rows.select("doc_id", "key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("signature")).alias("_o")).join(named, F.col("_o") == F.col("_s"), "left")
    best = F.coalesce((F.col("doc_id") == F.col("_c")) & (F.col("key") == F.col("_k")), F.lit(True))
    return out.select("doc_id", "key", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"), best.alias("best"), F.col("_s").isNotNull().alias("named"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; component_id is the smallest id
    reachable over links, itself included; kept whether it is the row's own."""
    body = F.col(text).cast("binary")
    out = found_rows(docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.unhex(F.md5(body)).alias("key")), size, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one per group of near-duplicates stays: one
    with the smallest id. Rows without an id or without words stay all."""
    names = docs.columns
    # positions for names, so that no column clashes with another or with ours
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = F.col(f"c{names.index(text)}").cast("binary")
    keyed = plain.withColumns({"_key": F.unhex(F.md5(body)), "_id": F.col(f"c{names.index(doc_id)}")})
    found = stored(found_rows(keyed.select(F.col("_id").alias("doc_id"), body.alias("text"), F.col("_key").alias("key"))).where("named"))
    # per id and text: does it go, or do its rows repeat? Exact copies with other ids are such rows
    odd = stored(found.groupBy("doc_id", "key").agg(F.first("best").alias("best"), F.count("*").alias("n")).where("not best or n > 1")
              .select(F.col("doc_id").alias("_g_id"), F.col("key").alias("_g_key"), "best"))
    same = (F.col("_id") == F.col("_g_id")) & (F.col("_key") == F.col("_g_key"))
    n = odd.count()
    out = keyed.join(F.broadcast(odd) if n <= BROADCAST_IDS else odd, same, "left_anti")
    twice = odd.where("best")
    if not twice.isEmpty():
        again = keyed.join(F.broadcast(twice) if n <= BROADCAST_IDS else twice, same, "left_semi")
        out = out.unionByName(again.dropDuplicates(["_id", "_key"]))
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute(docs: list[tuple], size: int = SHINGLE, percent: int = PERCENT) -> dict:
    """id: (set size, component), by comparing all pairs (for tests)."""
    import re

    sets = {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}
