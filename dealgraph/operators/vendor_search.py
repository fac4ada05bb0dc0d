"""Vendors by similar names and combined factors (V01, V05-V07, V10, V11, V15): top-k similarity search.

Names meet as distinct names, through an inverted index of the catalogue's bigrams. A first round looks up only the rarest bigrams of
each mention and scores what it finds; the k-th best score is a bound that the result can't fall below. The second round derives
from each mention's own bound how many of its bigrams (or pieces, for a score without dice) a better name may miss, and
looks up the rarest ones, one more than that. So mentions with a good match read few lists, those without one read
more, and nothing that could be among the best is lost, ties included.

Mentions: mention_id, name, email, products, keywords; catalogue: vendor_id, vendor_name, domains, products, each of the last two an array. Of
several vendors with the best score the first by name, then id, counts. Names without letters or digits, and nulls, have no match."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgraph.functions.normalize import email_domain, vendor_key
from dealgraph.functions.similarity import dice_of_plain, gram_keys, ratio
from dealgraph.functions.workers import cut, ship
from dealgraph.operators.fuzzy_join import frequencies, pieces, pieces_of, similar_pairs
from dealgraph.operators.vendor_match import contained_in

#: Bands of the fuzzy score, weights of the combined score, its least and highest value.
BANDS = ((95, 0.98, "fuzzy_exact"), (85, 0.85, "fuzzy_high"), (70, 0.70, "fuzzy_medium"), (50, 0.50, "fuzzy_low"))
WEIGHTS = {"name": 0.40, "domain": 0.25, "product": 0.20, "keyword": 0.10}
LEAST, MOST = 0.3, 0.95
SUGGEST = (50, 85, 5)
#: Bigrams of a mention that the first round looks up.
FIRST = 3


def _lookups(texts: DataFrame, often: dict[str, int], kind: str) -> DataFrame:
    """(text, piece) for texts (text, bound in percent): what a better match than the bound must have one of. kind: "first" (the rarest bigrams), "both" for the
    mean of ratio and dice, "ratio"."""
    def chosen(text: str, bound: float) -> list[str]:
        bare = text.replace(" ", "")
        own = sorted((bare[k : k + 2] for k in range(len(bare) - 1)), key=lambda p: (often.get(p, 0), p))
        if kind == "first":
            return list(dict.fromkeys(p for p in own if p in often))[:FIRST]
        if kind == "ratio":
            return pieces(text, max(0.5, (bound - 0.5) / 100), often)
        t = 2 * (bound - 0.25) / 100 - 1  # as a ratio is at most 1 (and rounded to whole percents), dice must reach this
        return sorted(set(own if t <= 0 else own[: len(own) - math.ceil(t / (2 - t) * len(own) - 1e-9) + 1]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": frame["text"], "pieces": [chosen(x, b) for x, b in zip(frame["text"], frame["bound"], strict=True)]})

    ship(texts.sparkSession)
    return texts.select("text", "bound").mapInPandas(run, "text string, pieces array<string>").select("text", F.explode("pieces").alias("piece"))


def _index(names: DataFrame) -> DataFrame:
    return names.select(F.col("text").alias("other"), F.explode(pieces_of(F.col("text"))).alias("piece"))


def _scored(candidates: DataFrame, kind: str) -> DataFrame:
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = candidates.repartition(n, "text", "other").distinct().withColumn("ratio", ratio(F.col("text"), F.col("other")))
    return pairs.withColumn("score", F.col("ratio") if kind == "ratio" else (F.col("ratio") + 100 * dice_of_plain(F.col("text"), F.col("other"))) / 2)


def best_names(mentioned: DataFrame, names: DataFrame, k: int, least: float, below: float = 101, kind: str = "both") -> DataFrame:
    """(text, other, score): for each of `mentioned` (text, distinct) the texts of `names` (text, distinct) whose score is among its k best in [least, below), with all that
    tie with the k-th. kind: "both" for the mean of ratio and dice (percent; least: 50 or more), or "ratio"."""
    often = frequencies(names)
    index = _index(names)

    def in_range(candidates: DataFrame) -> DataFrame:
        return _scored(candidates, kind).where((F.col("score") >= least) & (F.col("score") < below)).select("text", "other", "score")

    ranked = Window.partitionBy("text").orderBy(F.desc("score"))
    first = in_range(_lookups(mentioned.withColumn("bound", F.lit(float(least))), often, "first").join(index, "piece").select("text", "other"))
    kth = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("text", F.col("score").alias("bound"))
    bounded = mentioned.join(kth, "text", "left").select("text", F.coalesce("bound", F.lit(float(least))).alias("bound"))
    again = _lookups(bounded, often, kind).join(index, "piece").select("text", "other")
    equal = mentioned.join(names, "text").select("text", F.col("text").alias("other"))
    found = in_range(again.unionByName(equal))
    return found.withColumn("r", F.rank().over(ranked)).where(F.col("r") <= k).select("text", "other", "score")


def _keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.withColumn("_k", vendor_key(F.col(name))).where(F.col("_k") != "").select(key, "_k", name)


def _first_of(vendors: DataFrame, key: str) -> DataFrame:
    """(key, vendor_name, vendor_id): of the vendors of each key the first by name, then id."""
    return vendors.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("vendor_name", "vendor_id")).alias("_v")).select(key, "_v.*")


def by_similar_name(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(mention_id, vendor_id, score, confidence, strategy): the vendor with the best mean of ratio and dice, in bands from 50 on."""
    m, v = _keyed(mentions, "mention_id", "name"), _keyed(catalogue, "vendor_id", "vendor_name")
    best = best_names(m.select(F.col("_k").alias("text")).distinct(), v.select(F.col("_k").alias("text")).distinct(), 1, BANDS[-1][0])
    # of a name's best others (all with the same score) the first vendor, before mentions meet it
    first = _first_of(best.join(v, best["other"] == v["_k"]).select("text", "vendor_name", "vendor_id"), "text").join(best.groupBy("text").agg(F.max("score").alias("score")), "text")
    found = m.join(first, m["_k"] == first["text"]).groupBy("mention_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "vendor_name", "vendor_id")).alias("b"))
    found = found.select("mention_id", "b.vendor_id", (-F.col("b.s")).alias("score"))
    confidence, strategy = F.lit(None).cast("double"), F.lit(None).cast("string")
    for least, value, name in reversed(BANDS):
        confidence, strategy = F.when(F.col("score") >= least, value).otherwise(confidence), F.when(F.col("score") >= least, name).otherwise(strategy)
    return found.select("mention_id", "vendor_id", "score", confidence.alias("confidence"), strategy.alias("strategy"))


def suggestions(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(mention_id, rank, vendor_id, confidence): the five vendors with the best ratios from 50 to below 85."""
    least, below, k = SUGGEST
    m, v = _keyed(mentions, "mention_id", "name"), _keyed(catalogue, "vendor_id", "vendor_name")
    best = best_names(m.select(F.col("_k").alias("text")).distinct(), v.select(F.col("_k").alias("text")).distinct(), k, least, below, "ratio")
    # many vendors may tie with the fifth: a name's five are chosen before mentions, of which many have the name, meet them
    found = best.join(v.select(F.col("_k").alias("other"), "vendor_id", "vendor_name"), "other")
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "vendor_name", "vendor_id"))
    five = found.withColumn("rank", rank).where(F.col("rank") <= k).select("text", "score", F.col("vendor_name").alias("named"), "vendor_id")
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "named", "vendor_id"))
    return m.join(five, m["_k"] == five["text"]).withColumn("rank", rank).where(F.col("rank") <= k).select("mention_id", "rank", "vendor_id", (F.col("score") / 100).alias("confidence"))


# ---------------------------------------------------------------- products and keywords

def held_terms(terms: DataFrame, words: DataFrame, least_ratio: float | None = None) -> DataFrame:
    """(term, word): normalised terms and words (both: text) of which one holds the other, or, with `least_ratio`, with such a ratio."""
    a = contained_in(words.select(F.col("text").alias("short")), terms.select(F.col("text").alias("long"))).select(F.col("long").alias("term"), F.col("short").alias("word"))
    b = contained_in(terms.select(F.col("text").alias("short")), words.select(F.col("text").alias("long"))).select(F.col("short").alias("term"), F.col("long").alias("word"))
    out = a.unionByName(b)
    if least_ratio is not None:
        near = similar_pairs(terms, words, least_ratio).withColumn("ratio", ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least_ratio)
        out = out.unionByName(near.select(F.col("a").alias("term"), F.col("b").alias("word")))
    return out.distinct()


def term_hits(sets: DataFrame, catalogue: DataFrame, least_ratio: float | None = None) -> DataFrame:
    """(terms, vendor_id, hits): for each distinct array `terms` of sets, how many of its terms (repeats counted) a vendor's products hold or are held by."""
    kinds = sets.select("terms").where(F.size("terms") > 0).distinct()
    each = kinds.select("terms", F.posexplode("terms").alias("_pos", "term")).withColumn("term", vendor_key(F.col("term")))
    words = catalogue.select("vendor_id", F.explode("products").alias("word")).select("vendor_id", vendor_key(F.col("word")).alias("word")).distinct()
    vendors_of = held_terms(each.select(F.col("term").alias("text")), words.select(F.col("word").alias("text")), least_ratio).join(words, "word").select("term", "vendor_id").distinct()
    return each.join(vendors_of, "term").groupBy("terms", "vendor_id").agg(F.count("*").alias("hits"))


def by_product_terms(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The vendor that matches most of a mention's products (one holds the other, or a ratio of 85 or more). Equal product sets are matched once."""
    sets = mentions.select("mention_id", F.col("products").alias("terms"))
    best = term_hits(sets, catalogue, 85).join(catalogue.select("vendor_id", "vendor_name"), "vendor_id")
    w = Window.partitionBy("terms").orderBy(F.desc("hits"), "vendor_name", "vendor_id")
    best = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("terms", "vendor_id", "hits")
    confidence = F.least(F.lit(0.85), 0.5 + F.col("hits") / F.size("terms") * 0.35)
    return sets.join(best, "terms").select("mention_id", "vendor_id", F.lit("product_match").alias("strategy"), F.round(confidence, 6).alias("confidence"))


def product_ratio(products: Column, keywords: Column) -> Column:
    """The share of the mentioned products that hold one of the keywords or are held by one; 0 if either is empty."""
    p, k = F.transform(products, vendor_key), F.transform(keywords, vendor_key)
    hit = F.filter(p, lambda x: F.exists(k, lambda y: F.contains(x, y) | F.contains(y, x)))
    return F.when((F.size(k) == 0) | (F.size(p) == 0), 0.0).otherwise(F.size(hit) / F.size(p))


# ---------------------------------------------------------------- combined

#: Rows of names' bigrams that are handed to the tasks.
BROADCAST_GRAMS = 500_000
#: Stands for no domain, which has no sign like it.
NOWHERE = "@"


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def _listed(terms: Column) -> Column:
    return F.coalesce(terms, F.array().cast("array<string>"))


def best_sums(mentions: DataFrame, vendors: DataFrame, products: Callable[[DataFrame, DataFrame], DataFrame], keywords: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(mention_id, vendor_id, score): the vendor with the best sum of weights, from LEAST on. mentions: mention_id, x (key), domain, products, keywords; vendors: vendor_id, rank (orders equal scores before
    the id), y (key), domains, products, keywords. products, keywords: of (terms), distinct, and a catalogue the shares (terms, vendor_id, share).

    Mentions that are equal but for their id are one kind, vendors with the same products and keywords one profile. What a kind's terms give depends on the profile alone, so of a profile only the
    vendor with the name most like the mention's can be the best, unless it has the mention's domain: a kind meets profiles and the vendors of its domain, never all vendors that one of its terms fits."""
    none = F.lit(0.0)
    m = mentions.select("mention_id", F.coalesce("x", F.lit("")).alias("x"), F.coalesce("domain", F.lit(NOWHERE)).alias("domain"), _listed(F.col("products")).alias("products"), _listed(F.col("keywords")).alias("keywords"))
    kinds = _numbered(m.select("x", "domain", "products", "keywords").distinct(), "kind")
    v = vendors.select("vendor_id", "rank", F.coalesce("y", F.lit("")).alias("y"), "domains", _listed(F.col("products")).alias("products"), _listed(F.col("keywords")).alias("keywords"))
    profiles = _numbered(v.select("products", "keywords").distinct(), "s")
    v = cut(v.join(profiles, ["products", "keywords"]).select("vendor_id", "rank", "y", "domains", "s"))

    # what terms give, by profile
    catalogue = profiles.withColumnRenamed("s", "vendor_id")
    shares = [f(kinds.select(F.col(c).alias("terms")).where(F.size("terms") > 0).distinct(), catalogue).select(F.col("terms").alias(c), F.col("vendor_id").alias("s"), (F.col("share") * WEIGHTS[w]).alias(w))
              for f, c, w in ((products, "products", "product"), (keywords, "keywords", "keyword"))]
    sets = _numbered(kinds.select("products", "keywords").distinct(), "t")
    parts = [sets.join(shares[0], "products").select("t", "s", "product", none.alias("keyword")), sets.join(shares[1], "keywords").select("t", "s", none.alias("product"), "keyword")]
    given = cut(parts[0].unionByName(parts[1]).groupBy("t", "s").agg((F.max("product") + F.max("keyword")).alias("given")))
    kinds = cut(kinds.join(sets, ["products", "keywords"]).select("kind", "x", "domain", "t"))

    # of each mentioned name and profile the vendor with the most like name
    mine = cut(kinds.select("x").where("x <> ''").distinct().withColumn("gx", gram_keys(F.col("x"))))
    first = v.groupBy("y", "s").agg(F.min(F.struct("rank", "vendor_id")).alias("v"))
    theirs = first.groupBy("y").agg(F.collect_list(F.struct("s", "v")).alias("vs")).where("y <> ''").withColumn("gy", gram_keys(F.col("y")))
    asked = mine.select("x", F.size("gx").alias("nx"), F.explode("gx").alias("g"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_GRAMS else asked
    common = theirs.select("y", F.size("gy").alias("ny"), F.explode("gy").alias("g")).join(asked, "g").groupBy("y", "x", "nx", "ny").agg(F.count("*").alias("n"))
    alike = common.select("x", "y", (2.0 * F.col("n") / (F.col("nx") + F.col("ny"))).alias("d")).join(first, "y")
    nearest = cut(alike.groupBy("x", "s").agg(F.min(F.struct((-F.col("d")).alias("d"), "v.rank", "v.vendor_id")).alias("b")).select("x", "s", (-F.col("b.d")).alias("d"), "b.rank", "b.vendor_id"))

    # a kind's vendors: by name alone, by terms (with the nearest name of the profile, or any), by domain
    score = F.round(WEIGHTS["name"] * F.col("d") + F.col("given"), 9)
    named = nearest.where(F.col("d") >= LEAST / WEIGHTS["name"] - 1e-9).groupBy("x").agg(F.min(F.struct((-F.col("d")).alias("d"), "rank", "vendor_id")).alias("b"))
    named = kinds.join(named, "x").select("kind", (-F.col("b.d")).alias("d"), none.alias("given"), "b.rank", "b.vendor_id")
    fitting = kinds.select("x", "t").distinct().join(given, "t").join(nearest, ["x", "s"]).where(score >= LEAST)
    fitting = fitting.groupBy("x", "t").agg(F.min(F.struct((-score).alias("d"), "rank", "vendor_id")).alias("b"))
    fitting = kinds.join(fitting, ["x", "t"]).select("kind", none.alias("d"), (-F.col("b.d")).alias("given"), "b.rank", "b.vendor_id")
    any_name = given.where(F.round("given", 9) >= LEAST).join(first.groupBy("s").agg(F.min("v").alias("v")), "s").groupBy("t").agg(F.min(F.struct((-F.col("given")).alias("g"), "v.rank", "v.vendor_id")).alias("b"))
    any_name = kinds.join(any_name, "t").select("kind", none.alias("d"), (-F.col("b.g")).alias("given"), "b.rank", "b.vendor_id")
    # of a domain, name and profile again only one vendor
    at = v.select("vendor_id", "rank", "y", "s", F.explode(F.array_distinct("domains")).alias("domain")).where(F.col("domain") != NOWHERE).groupBy("domain", "y", "s").agg(F.min(F.struct("rank", "vendor_id")).alias("v"))
    at = at.withColumn("gy", gram_keys(F.col("y")))
    met = kinds.select("x", "domain").distinct().join(mine, "x", "left").join(at, "domain")
    near = F.coalesce(2.0 * F.size(F.array_intersect("gx", "gy")) / F.nullif(F.size("gx") + F.size("gy"), F.lit(0)), none)
    met = met.select("x", "domain", "s", F.when(F.col("gx").isNull(), none).otherwise(near).alias("d"), "v").groupBy("x", "domain", "s").agg(F.min(F.struct((-F.col("d")).alias("d"), "v.rank", "v.vendor_id")).alias("b"))
    domained = kinds.join(met, ["x", "domain"]).join(given, ["t", "s"], "left").select("kind", (-F.col("b.d")).alias("d"), (F.coalesce("given", none) + WEIGHTS["domain"]).alias("given"), "b.rank", "b.vendor_id")

    found = named.unionByName(fitting).unionByName(any_name).unionByName(domained).select("kind", score.alias("score"), "rank", "vendor_id").where(F.col("score") >= LEAST)
    best = found.groupBy("kind").agg(F.min(F.struct((-F.col("score")).alias("score"), "rank", "vendor_id")).alias("b"))
    of_kind = m.join(kinds.join(sets, "t"), ["x", "domain", "products", "keywords"]).select("mention_id", "kind")
    best = of_kind.join(best, "kind").groupBy("mention_id").agg(F.min("b").alias("b"))
    return best.select("mention_id", "b.vendor_id", (-F.col("b.score")).alias("score"))


def by_factors(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The vendor with the best sum of .40 dice of the names, .25 for the e-mail's domain, and .20 and .10 times the shares of matched products and keywords; from
    .3 on, at most .95."""
    def keyed(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.withColumn(key, vendor_key(F.col(name)))

    def share(terms: DataFrame, known: DataFrame) -> DataFrame:
        return term_hits(terms, known).withColumn("share", F.col("hits") / F.size("terms"))

    m = keyed(mentions, "name", "x").withColumn("domain", email_domain(F.col("email")))
    v = keyed(catalogue, "vendor_name", "y").withColumn("rank", F.col("vendor_name")).withColumn("keywords", F.lit(None).cast("array<string>"))
    best = best_sums(m, v, share, share)
    return best.select("mention_id", "vendor_id", F.lit("combined_factors").alias("strategy"), F.least(F.lit(MOST), F.col("score")).alias("confidence"))


#: In the order that decides ties.
STRATEGIES = ("exact_name", "alias_match", "email_domain", "fuzzy", "product_match", "combined_factors")


def cascade(mentions: DataFrame, catalogue: DataFrame, aliases: DataFrame, keep: int = 4) -> DataFrame:
    """The best of the six strategies' vendors, and up to three alternatives, per mention: (mention_id, rank, vendor_id, strategy, confidence). aliases:
    alias, vendor_id, confidence; of an alias the surest, then the smallest vendor."""
    m, v = _keyed(mentions, "mention_id", "name"), _keyed(catalogue, "vendor_id", "vendor_name")
    # a key's first vendor is chosen before mentions meet it
    exact = _first_of(m.join(_first_of(v.select("_k", "vendor_name", "vendor_id"), "_k"), "_k"), "mention_id").select("mention_id", "vendor_id", F.lit("exact_name").alias("strategy"), F.lit(1.0).alias("confidence"))
    known = _keyed(aliases, "vendor_id", "alias").join(aliases, ["vendor_id", "alias"]).groupBy("_k").agg(F.max(F.struct(F.coalesce("confidence", F.lit(0.95)).alias("c"), (-F.col("vendor_id")).alias("v"))).alias("b"))
    aliased = m.join(known, "_k").select("mention_id", (-F.col("b.v")).alias("vendor_id"), F.lit("alias_match").alias("strategy"), F.col("b.c").alias("confidence"))
    domains = catalogue.select("vendor_id", "vendor_name", F.explode("domains").alias("domain")).select("vendor_id", "vendor_name", F.lower("domain").alias("domain"))
    domained = _first_of(mentions.select("mention_id", email_domain(F.col("email")).alias("domain")).join(_first_of(domains, "domain"), "domain"), "mention_id")
    domained = domained.select("mention_id", "vendor_id", F.lit("email_domain").alias("strategy"), F.lit(0.9).alias("confidence"))
    similar = by_similar_name(mentions, catalogue).select("mention_id", "vendor_id", "strategy", "confidence")
    found = exact.unionByName(aliased).unionByName(domained).unionByName(similar).unionByName(by_product_terms(mentions, catalogue)).unionByName(by_factors(mentions, catalogue))
    order = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.when(F.col("strategy").startswith("fuzzy"), "fuzzy").otherwise(F.col("strategy")))
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("confidence"), order))
    return found.where(F.col("confidence") >= LEAST).withColumn("rank", rank).where(F.col("rank") <= keep).select("mention_id", "rank", "vendor_id", "strategy", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- the second engine

#: The confidences of its strategies, and the least mean of ratio and dice.
ENGINE = {"exact": 1.0, "high": 0.9, "medium": 0.7, "fuzzy": 0.7, "step": 0.1}
ENGINE_STRATEGIES = ("exact_name", "normalized_name", "alias", "email_domain", "fuzzy_name", "product", "combined")


def engine_key(text: Column) -> Column:
    """V15's normaliser: lower case, one company suffix at the end taken off, without signs, single blanks."""
    out = F.regexp_replace(F.lower(text), r"\s+(inc|llc|ltd|corp|corporation|company|co|limited|gmbh|ag|sa|bv|nv)\.?$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\w\s]", ""), r"\s+", " "))


def _engine_shares(sets: DataFrame, catalogue: DataFrame, words_of: str) -> DataFrame:
    """(terms, vendor_id, share): the share of terms (distinct) that a vendor's words hold."""
    each = sets.select("terms", F.posexplode("terms").alias("_p", "term")).withColumn("term", engine_key(F.col("term")))
    words = catalogue.select("vendor_id", F.explode(words_of).alias("word")).select("vendor_id", engine_key(F.col("word")).alias("word")).distinct()
    held = contained_in(each.select(F.col("term").alias("short")), words.select(F.col("word").alias("long"))).select(F.col("short").alias("term"), F.col("long").alias("word"))
    hits = each.join(held.join(words, "word").select("term", "vendor_id").distinct(), "term").groupBy("terms", "vendor_id").agg(F.count("*").alias("hits"))
    return hits.select("terms", "vendor_id", (F.col("hits") / F.size("terms")).alias("share"))


def engine(mentions: DataFrame, catalogue: DataFrame, keep: int = 3) -> DataFrame:
    """The second engine, over mentions and a catalogue with `aliases` and `keywords` beside the columns named above. (mention_id, rank, vendor_id, strategy, confidence): rank 1 is
    the surest strategy's vendor, the ranks after it are the next `keep` results without those of the same vendor. The first vendor is the one with the smallest id."""
    v = catalogue.select("vendor_id", F.lower("vendor_name").alias("low"), engine_key(F.col("vendor_name")).alias("k"))
    m = mentions.where(F.coalesce("name", F.lit("")) != "").select("mention_id", F.lower("name").alias("low"), engine_key(F.col("name")).alias("k"))

    def result(found: DataFrame, strategy: str, confidence: Column) -> DataFrame:
        return found.select("mention_id", "vendor_id", F.lit(strategy).alias("strategy"), confidence.alias("confidence"))

    def first(asking: DataFrame, vendors: DataFrame, key: str, strategy: str, confidence: float) -> DataFrame:
        """A key's first vendor is chosen before mentions meet it."""
        found = asking.join(vendors.groupBy(key).agg(F.min("vendor_id").alias("vendor_id")), key)
        return result(found.groupBy("mention_id").agg(F.min("vendor_id").alias("vendor_id")), strategy, F.lit(confidence))

    aliases = catalogue.select("vendor_id", F.explode("aliases").alias("a")).select("vendor_id", engine_key(F.col("a")).alias("k"))
    domain = F.lower(F.when(F.contains("email", F.lit("@")), F.split("email", "@")[1]).otherwise(F.col("email")))
    domains = catalogue.select("vendor_id", F.explode("domains").alias("d")).select("vendor_id", F.lower("d").alias("d")).distinct()
    names = best_names(m.select(F.col("k").alias("text")).where("text <> ''").distinct(), v.select(F.col("k").alias("text")).where("text <> ''").distinct(), 1, 100 * ENGINE["fuzzy"])
    most = names.join(v.select(F.col("k").alias("other"), "vendor_id"), "other").groupBy("text").agg(F.max(F.struct(F.round(F.col("score") / 100, 9).alias("s"), (-F.col("vendor_id")).alias("v"))).alias("b"))
    fuzzy = m.join(most, m["k"] == most["text"]).groupBy("mention_id").agg(F.max("b").alias("b")).select("mention_id", (-F.col("b.v")).alias("vendor_id"), F.col("b.s").alias("score"))

    # a product counts that is one of the vendor's, or holds its name or is held by it
    sets = mentions.select("mention_id", F.col("products").alias("terms")).where(F.size("terms") > 0)
    each = sets.select("terms").distinct().select("terms", F.posexplode("terms").alias("_p", "term")).withColumn("term", engine_key(F.col("term")))
    own = catalogue.select("vendor_id", F.explode("products").alias("w")).select("vendor_id", engine_key(F.col("w")).alias("term"))
    terms, vendor_names = each.select(F.col("term").alias("text")), v.select(F.col("k").alias("text"))
    by_name = held_terms(terms, vendor_names).join(v.select("vendor_id", F.col("k").alias("word")), "word").select("vendor_id", "term")
    hits = each.join(own.unionByName(by_name).distinct(), "term").groupBy("terms", "vendor_id").agg(F.count("*").alias("hits"))
    hits = hits.groupBy("terms").agg(F.min(F.struct("vendor_id", "hits")).alias("b")).select("terms", "b.*")
    product = result(sets.join(hits, "terms"), "product", F.round(F.least(F.lit(ENGINE["high"]), ENGINE["medium"] + F.col("hits") * ENGINE["step"]), 9))

    def share(of: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
        return lambda terms, known: _engine_shares(terms, known, of)

    factored = mentions.where(F.coalesce("name", F.lit("")) != "").withColumn("x", engine_key(F.col("name"))).withColumn("domain", F.nullif(domain, F.lit("")))
    known = catalogue.withColumns({"y": engine_key(F.col("vendor_name")), "rank": F.lit(""), "domains": F.transform("domains", lambda x: F.lower(x))})
    combined = best_sums(factored, known, share("products"), share("keywords"))

    mailed = mentions.select("mention_id", domain.alias("d")).where("d <> ''")
    found = first(m, v, "low", "exact_name", ENGINE["exact"])
    for more in (first(m.where("k <> ''"), v, "k", "normalized_name", ENGINE["exact"]), first(m, aliases, "k", "alias", ENGINE["high"]),
                 first(mailed, domains, "d", "email_domain", ENGINE["high"]), result(fuzzy, "fuzzy_name", F.col("score")), product, result(combined, "combined", F.least(F.lit(1.0), F.col("score")))):
        found = found.unionByName(more)
    order = F.array_position(F.array(*[F.lit(s) for s in ENGINE_STRATEGIES]), F.col("strategy"))
    w = Window.partitionBy("mention_id").orderBy(F.desc("confidence"), order)
    ranked = found.where(F.col("confidence") >= LEAST).withColumn("rank", F.row_number().over(w)).withColumn("_best", F.first("vendor_id").over(w))
    kept = ranked.where((F.col("rank") == 1) | ((F.col("rank") <= keep + 1) & (F.col("vendor_id") != F.col("_best"))))
    return kept.select("mention_id", F.row_number().over(Window.partitionBy("mention_id").orderBy("rank")).alias("rank"), "vendor_id", "strategy", F.round("confidence", 6).alias("confidence"))
