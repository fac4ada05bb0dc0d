"""Linking vendor mentions to a vendor catalogue.

Similar names and combined factors are in vendor_search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgraph.functions.normalize import email_domain, vendor_key
from dealgraph.functions.similarity import grams
from dealgraph.functions.workers import ship

def by_name(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The same normalised name."""
    v = catalogue.select("vendor_id", vendor_key(F.col("vendor_name")).alias("_k"))
    return mentions.select("mention_id", vendor_key(F.col("name")).alias("_k")).join(v, "_k").select("mention_id", "vendor_id", F.lit("exact").alias("strategy"), F.lit(1.0).alias("confidence"))


def by_alias(mentions: DataFrame, catalogue: DataFrame, confidence: float = 0.95) -> DataFrame:
    """A known alias."""
    v = catalogue.select("vendor_id", vendor_key(F.col("alias")).alias("_k"))
    return mentions.select("mention_id", vendor_key(F.col("name")).alias("_k")).join(v, "_k").select("mention_id", "vendor_id", F.lit("alias").alias("strategy"), F.lit(confidence).alias("confidence"))


def by_domain(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The mention's e-mail is at one of the vendor's domains."""
    v = catalogue.select("vendor_id", F.lower("domain").alias("_k"))
    return mentions.select("mention_id", email_domain(F.col("email")).alias("_k")).join(v, "_k").select("mention_id", "vendor_id", F.lit("domain").alias("strategy"), F.lit(0.9).alias("confidence"))


def level(confidence: Column) -> Column:
    """V14."""
    return F.when(confidence >= 0.9, "High").when(confidence >= 0.7, "Medium").otherwise("Low")


def learn_aliases(matches: DataFrame, least: float, times: int) -> DataFrame:
    """Names that were matched to a vendor often and surely."""
    g = matches.where(F.col("confidence") >= least).groupBy("vendor_id", "alias").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= times)
    return g.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.7 + F.col("frequency") / 10 * 0.25), 6))


def review_queue(detections: DataFrame) -> DataFrame:
    """Unmatched names with their number of detections and first and last time."""
    return detections.groupBy(vendor_key(F.col("name")).alias("alias")).agg(F.count("*").alias("detections"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def domain_owner(domains: DataFrame) -> DataFrame:
    """The vendor with the most matches per domain, the smallest id among equals."""
    return domains.groupBy("domain").agg(F.max_by("vendor_id", F.struct("match_count", -F.col("vendor_id"))).alias("vendor_id"))


# ---------------------------------------------------------------- containment, products, texts

def contained_in(shorts: DataFrame, longs: DataFrame, gram: int = 6) -> DataFrame:
    """Pairs (short, long) of distinct strings, short a substring of long, empty ones left out. An equi join on
    the first `gram` characters of the short one (all, if it has fewer) with the long one's substrings of that
    length, then the exact test: no pair is lost and none is tried that shares no gram."""
    s = shorts.select("short").where("short <> ''").distinct().withColumn("_k", F.left("short", F.lit(gram)))
    lengths = [r[0] for r in s.select(F.length("_k")).distinct().collect()]  # at most `gram` numbers
    if not lengths:
        return s.select("short", F.col("short").alias("long"))
    one = F.col("long")
    keys = F.array_distinct(F.flatten(F.array(*[grams(one, n) for n in sorted(lengths)])))
    t = longs.select("long").where("long <> ''").distinct().select("long", F.explode(keys).alias("_k"))
    return s.join(t, "_k").where(F.contains("long", F.col("short"))).select("short", "long").distinct()


def by_containment(mentions: DataFrame, catalogue: DataFrame, least: float = 0.75) -> DataFrame:
    """The same normalised name, else one that holds the other and is not much longer; the surest, then the smallest vendor."""
    m = mentions.select("mention_id", text_key(F.col("name")).alias("m"))
    v = catalogue.select("vendor_id", text_key(F.col("vendor_name")).alias("v"))
    a = contained_in(v.select(F.col("v").alias("short")), m.select(F.col("m").alias("long"))).select(F.col("short").alias("v"), F.col("long").alias("m"))
    b = contained_in(m.select(F.col("m").alias("short")), v.select(F.col("v").alias("long"))).select(F.col("long").alias("v"), F.col("short").alias("m"))
    share = F.least(F.length("m"), F.length("v")) / F.greatest(F.length("m"), F.length("v"))
    near = a.unionByName(b).distinct().withColumn("confidence", share).where(F.col("confidence") >= least)
    best = m.join(near, "m").join(v, "v").groupBy("mention_id").agg(F.max(F.struct("confidence", (-F.col("vendor_id")).alias("v"))).alias("b"))
    return best.select("mention_id", (-F.col("b.v")).alias("vendor_id"), F.round("b.confidence", 6).alias("confidence"), F.when(F.col("b.confidence") == 1, "normalized").otherwise("fuzzy").alias("strategy"))


#: Characters of a piece of a text that is scanned at once.
PIECE = 1 << 16
#: The most beginnings of names that are handed to the tasks, and the characters of one.
HEADS, HEAD = 500_000, 12
_STEP, _TABLE = 0x9E3779B97F4A7C15, 20


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k codes from each place on, modulo 2**64."""
    n = max(0, len(codes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_STEP)
        out += codes[j : j + n]
    return out ^ (out >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _beginnings(pieces: DataFrame, heads: list[str], piece: int, longest: int) -> DataFrame:
    """(text_id, head, w): the places of pieces (text_id, p) at which one of the heads stands, each with the characters of the longest name. Hashes of all places are made batch by batch with numpy;
    what a table of their first bits lets through is compared with the heads themselves."""
    lengths = sorted({len(h) for h in heads})
    tables = {k: np.zeros(1 << _TABLE, bool) for k in lengths}
    for k in lengths:
        tables[k][np.array([_hashes(_codes(h), k)[0] for h in heads if len(h) == k], np.uint64) >> np.uint64(64 - _TABLE)] = True
    ship(pieces.sparkSession)
    shared = pieces.sparkSession.sparkContext.broadcast((frozenset(heads), {k: np.packbits(x) for k, x in tables.items()}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, packed = shared.value
        let = {k: np.unpackbits(x).astype(bool) for k, x in packed.items()}
        for frame in frames:
            ids, ps = frame["text_id"].tolist(), frame["p"].tolist()
            starts = np.cumsum([0, *[len(p) + 1 for p in ps]])
            codes, found = _codes("\0".join(ps)), set()
            for k, table in let.items():
                places = np.flatnonzero(table[_hashes(codes, k) >> np.uint64(64 - _TABLE)])
                for at, j in zip(places.tolist(), (np.searchsorted(starts, places, "right") - 1).tolist(), strict=True):
                    i = at - int(starts[j])
                    if i < piece and (head := ps[j][i : i + k]) in known:
                        found.add((ids[j], head, ps[j][i : i + longest]))
            yield pd.DataFrame(list(found), columns=["text_id", "head", "w"])

    kind = pieces.schema["text_id"].dataType.simpleString()
    return pieces.mapInPandas(run, f"text_id {kind}, head string, w string")


def _all_beginnings(pieces: DataFrame, heads: DataFrame, piece: int, longest: int, lengths: list[int]) -> DataFrame:
    """The same for more heads (head) than tasks should hold: each place's beginnings meet them in an equi join."""
    i = F.col("i")
    places = pieces.select("text_id", "p", F.explode(F.sequence(F.lit(1), F.least(F.length("p"), F.lit(piece)))).alias("i"))
    each = places.select("text_id", F.explode(F.array(*[F.substring("p", i, F.lit(n)) for n in lengths])).alias("head"), F.substring("p", i, F.lit(longest)).alias("w"))
    return each.join(heads, "head", "left_semi").distinct()


def found_in_texts(texts: DataFrame, names: DataFrame, piece: int = PIECE, most: int = HEADS) -> DataFrame:
    """(text_id, name): the names (name, distinct) that a text (text_id, text) holds anywhere, in lower case. Texts are cut into pieces that overlap by the longest name's
    length, and scanned for the names' first characters (up to 12). Where such a beginning stands, the text from there on, cut to each length that names with this beginning
    have, meets the names in an equi join. So a text is never copied, a piece of any text is a bounded row, and many names with one beginning don't meet all its places."""
    known = names.select(F.lower("name").alias("low"), "name").where("low <> ''").distinct().withColumn("n", F.length("low")).withColumn("head", F.left("low", F.lit(HEAD)))
    longest = known.agg(F.max("n")).first()[0] or 0
    heads = known.select("head").distinct()
    lengths = sorted(r["k"] for r in heads.select(F.length("head").alias("k")).distinct().collect())  # at most 12 numbers
    if not lengths:
        return texts.select("text_id", F.lit("").alias("name")).limit(0)
    low = texts.select("text_id", F.lower("text").alias("t"))
    few = heads.limit(most + 1).collect()
    piece = min(piece, 256) if len(few) > most else piece  # there a place is found by counting characters from the start
    piece = max(piece, longest)  # so that a name ends in the next piece at the latest
    cut_ = low.where("t <> ''").select("text_id", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)).alias("ps"))  # one pass, where substrings would each count from the start
    pieces = cut_.select("text_id", F.explode(F.transform("ps", lambda p, k: F.concat(p, F.left(F.coalesce(F.get("ps", k + 1), F.lit("")), F.lit(longest - 1))))).alias("p"))
    at = _beginnings(pieces, [r["head"] for r in few], piece, longest) if len(few) <= most else _all_beginnings(pieces, heads, piece, longest, lengths)
    cuts = at.join(known.select("head", "n").distinct(), "head").where(F.length("w") >= F.col("n")).select("text_id", F.left("w", F.col("n")).alias("low")).distinct()
    return cuts.join(known.select("low", "name"), "low").select("text_id", "name").distinct()


def text_key(text: Column) -> Column:
    """Lower case, without suffix words wherever they stand (with a dot, if they have one) and without signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\b(inc|llc|ltd|corp|corporation|company|co)\b\.?", ""), r"[^\w\s]", ""))


def in_texts(texts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(text_id, vendor_id, confidence, strategy): vendors whose normalised name a text (text_id, text) holds, or at whose
    domain it has an address; a name wins."""
    v = catalogue.select("vendor_id", text_key(F.col("vendor_name")).alias("name"), F.lower("domain").alias("domain"))
    named = found_in_texts(texts, v.select("name")).join(v.select("vendor_id", "name"), "name").select("text_id", "vendor_id", F.lit("fuzzy").alias("strategy"))
    domains = texts.select("text_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z|]{2,})\b"), F.lit(1))).alias("domain")).select("text_id", F.lower("domain").alias("domain"))
    at = domains.distinct().join(v.where("domain is not null"), "domain").select("text_id", "vendor_id", F.lit("domain").alias("strategy"))
    found = named.unionByName(at).groupBy("text_id", "vendor_id").agg(F.max("strategy").alias("strategy"))
    return found.withColumn("confidence", F.when(F.col("strategy") == "fuzzy", 0.8).otherwise(0.9))


def cross_reference(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(mention_id, vendor_id, match, confidence): the first vendor (by id) that a mentioned name (lower case, trimmed) fits: the same name or normalised name (1.0), else one of its domains (domains: an
    array) holds the name or is held by it (.8), else its name does (.7). Blank names fit none."""
    def low(c: str) -> Column:
        return F.trim(F.lower(c))

    m = mentions.select("mention_id", low("name").alias("m")).where("m <> ''")
    v = catalogue.select("vendor_id", low("vendor_name").alias("v"), low("normalized_name").alias("k"), F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: F.lower(d)).alias("ds"))
    exact = v.select("vendor_id", F.col("v").alias("w"), F.lit(0).alias("rank")).unionByName(v.select("vendor_id", F.col("k").alias("w"), F.lit(0).alias("rank")))
    names = m.select(F.col("m").alias("short")), m.select(F.col("m").alias("long"))

    def holding(words: DataFrame, rank: int) -> DataFrame:
        """(vendor_id, m, rank) for words (vendor_id, w) that hold a name or are held by it."""
        held = contained_in(words.select(F.col("w").alias("short")), names[1]).select(F.col("short").alias("w"), F.col("long").alias("m"))
        holds = contained_in(names[0], words.select(F.col("w").alias("long"))).select(F.col("long").alias("w"), F.col("short").alias("m"))
        return held.unionByName(holds).distinct().join(words, "w").select("vendor_id", "m", F.lit(rank).alias("rank"))

    found = exact.withColumnRenamed("w", "m").unionByName(holding(v.select("vendor_id", F.explode("ds").alias("w")), 1)).unionByName(holding(v.select("vendor_id", F.col("v").alias("w")), 2))
    first = m.join(found.distinct(), "m").groupBy("mention_id").agg(F.min(F.struct("vendor_id", "rank")).alias("b"))
    kinds = F.array(*[F.struct(F.lit(n).alias("match"), F.lit(c).alias("confidence")) for n, c in (("exact", 1.0), ("partial", 0.8), ("fuzzy", 0.7))])
    return first.select("mention_id", "b.vendor_id", F.get(kinds, F.col("b.rank")).alias("k")).select("mention_id", "vendor_id", "k.match", "k.confidence")


# ---------------------------------------------------------------- aliases, detections, reviews

def best_alias(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The surest alias (alias, vendor_id, confidence, usage), then the most used, then the smallest vendor."""
    a = aliases.select(vendor_key(F.col("alias")).alias("_k"), "vendor_id", F.coalesce("confidence", F.lit(0.95)).alias("confidence"), "usage")
    a = a.groupBy("_k").agg(F.max(F.struct("confidence", "usage", (-F.col("vendor_id")).alias("v"))).alias("b"))
    return mentions.select("mention_id", vendor_key(F.col("name")).alias("_k")).join(a, "_k").select("mention_id", (-F.col("b.v")).alias("vendor_id"), F.col("b.confidence").alias("confidence"))


def strategy_statistics(log: DataFrame, metadata: str) -> DataFrame:
    """Matches and mean confidence by strategy of a JSON column, and of all (strategy null)."""
    m = log.select(F.get_json_object(metadata, "$.matchStrategy").alias("strategy"), F.get_json_object(metadata, "$.matchConfidence").try_cast("double").alias("c")).where("strategy is not null")
    return m.rollup("strategy").agg(F.count("*").alias("matches"), F.round(F.avg("c"), 6).alias("avg_confidence"))


def detection_confidence(match: Column, source: Column, domain: Column, mentioned: Column, known: Column) -> Column:
    """The match's confidence or 0.45, raised by a talking source, a domain, a mention and a hint; 0 to 1."""
    def plus(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    score = F.coalesce(match, F.lit(0.45)) + plus(source.isin("email", "transcript"), 0.1) + plus(F.coalesce(domain, F.lit("")) != "", 0.1) + plus(mentioned, 0.05) + plus(known, 0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def alias_usage(aliases: DataFrame, used: DataFrame, corrected: DataFrame) -> DataFrame:
    """Aliases (vendor_id, alias, confidence, usage) after uses (vendor_id, alias, confidence), which keep the larger
    confidence, and users' corrections (vendor_id, alias), which start at 0.9 and add 0.1 each, up to 1."""
    def rows(df: DataFrame, confidence: Column, usage: Column, corrections: int) -> DataFrame:
        return df.select("vendor_id", vendor_key(F.col("alias")).alias("alias"), confidence.alias("c"), usage.alias("u"), F.lit(corrections).alias("k"))

    all_ = rows(aliases, F.col("confidence"), F.col("usage"), 0).unionByName(rows(used, F.col("confidence"), F.lit(1).cast("long"), 0)).unionByName(rows(corrected, F.lit(None).cast("double"), F.lit(1).cast("long"), 1))
    g = all_.groupBy("vendor_id", "alias").agg(F.max("c").alias("c"), F.sum("u").alias("usage"), F.sum("k").alias("k"))
    return g.select("vendor_id", "alias", F.round(F.least(F.lit(1.0), F.coalesce(F.col("c") + F.col("k") * 0.1, 0.8 + F.col("k") * 0.1)), 6).alias("confidence"), "usage")


def unmatched_log(found: DataFrame) -> DataFrame:
    """Unmatched names (name, source, at): occurrences, first and last time, and the number of sources."""
    return found.groupBy(vendor_key(F.col("name")).alias("name")).agg(F.count("*").alias("occurrences"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.countDistinct("source").alias("sources"))


def promote(pending: DataFrame, reviews: DataFrame) -> DataFrame:
    """Parked deals (deal_id, review_id) with their reviews' outcome (review_id, status, vendor_id): promoted, dropped or still pending."""
    state = F.when(F.col("status") == "approved", "promoted").when(F.col("status") == "denied", "dropped").otherwise("pending")
    return pending.join(reviews, "review_id", "left").select("deal_id", state.alias("state"), F.when(F.col("status") == "approved", F.col("vendor_id")).alias("vendor_id"))
