"""Mixing sources to target weights: hash-random order within each source, distributed prefix
sums of the word counts, and a cut at each source's exact budget; a source whose budget is
above its size is taken in whole epochs and then cut.

Defined results: a null or blank text has size 0 and nothing is taken of it; a null source is
a source of its own, after all others; repeated rows are taken each for itself; ties of the
random key are ordered by id, then size; an empty table gives an empty result. Columns other than the id,
the text and the source are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.llm.common import BROADCAST_IDS, cut, gapless_rank, only, table

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MAX_EPOCHS = 3
#: Words are runs of bytes other than blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str) -> Column:
    """32 evenly spread bits from the id alone, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size",
                   weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """One row per source: its size and its target.

    The words to share are `share` of all. A target stops at max_epochs times its source's size
    and the excess is shared again by weight among the rest: with sources ordered by
    max_epochs * size / weight, those before the first that can hold its share are full and the
    rest get the remainder by weight. Only one row per source is windowed here."""
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("_room", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("_room") / F.col("weight"), F.col("source").asc_nulls_last())
    full, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    per = (per.withColumn("_full", F.coalesce(F.sum("_room").over(full), F.lit(0)))
           .withColumn("_left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
           .withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
           .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_left_weight")))
    # the level holds from the first source whose room is at least its share of what is left
    level = F.min(F.when(F.col("_room") >= F.col("_level") * F.col("weight"), F.struct(F.col("_room") / F.col("weight"), F.col("_level").alias("v")))).over(all_rows)
    per = per.withColumn("_l", level["v"])
    return per.select("source", "source_size", "weight", F.least(F.col("_room").cast("double"),
                      F.coalesce(F.col("_l") * F.col("weight"), F.col("_room").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, before, taken, copies) for every row.

    before: words of the same source with a smaller random key. taken: words taken, repeats
    counted: `epochs` times the document, and of the last, partial epoch what lies below the
    rounded budget, so that a source's taken words equal it. copies: the same in whole documents
    (the document at the cut is taken if its middle lies below the budget)."""
    rows = cut(only(docs, doc_id, source, text).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                                       word_count(text).alias("size")))
    return _mixed(rows, random_key("doc_id"), ("doc_id", "size"), weights, max_epochs, share)


def _mixed(rows: DataFrame, key: Column, tie: tuple[str, ...], weights: tuple[int, ...], max_epochs: int, share: float) -> DataFrame:
    """The mix of rows (doc_id, source, size, ...), in the order of the key and the tie within a source."""
    targets = source_targets(rows, weights=weights, max_epochs=max_epochs, share=share)
    ranked = gapless_rank(rows, ["source"], key, weight="size", tie=tie)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    out = ranked.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    budget = F.floor(F.col("target") + F.lit(0.5))
    out = (out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
           .withColumn("_rest", budget - F.col("epochs") * F.col("source_size")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("before")))
    whole = F.when((F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("_rest")), 1).otherwise(0)
    return out.select(*[c for c in rows.columns if c != "size"], "size", "source_size", "target", "epochs", "before",
                      (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
                      (F.col("epochs") + whole).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """The rows of the mix, with all the columns of docs (whatever their names): each as often as the mix takes it in whole
    documents. Rows are told apart by their id and text, and those that repeat both by their number among these, so
    that each is taken for itself; which of the equal rows gets which number changes nothing. Rows without an id are placed by their text."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {n: F.col(f"c{names.index(n)}") for n in (doc_id, text, source)}
    digest = F.md5(F.coalesce(of[text].cast("binary"), F.lit("").cast("binary")))
    identity = F.xxhash64(of[doc_id].cast("string"), digest, of[source].cast("string"))
    # rows that repeat id, text and source are counted, not numbered: a copy's turn is drawn for it
    kinds = plain.select(of[doc_id].alias("doc_id"), of[source].alias("source"), digest.alias("digest"), identity.alias("identity"), F.coalesce(F.regexp_count(of[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut(kinds.groupBy("doc_id", "source", "digest", "identity", "size").agg(F.count("*").alias("n")).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n"))
    spread = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.col("digest")), F.when(F.col("turn") > 1, F.col("turn")).cast("string"))), 1, 8), 16, 10).cast("long")
    told = _mixed(rows, spread, ("doc_id", "digest", "turn"), weights, max_epochs, share)
    # equal rows are interchangeable: what counts is how many of them are wanted in all
    copies = cut(told.groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
                 .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("digest").alias("_g"), "copies", "n"))
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    here = of[doc_id].eqNullSafe(F.col("_d")) & of[source].eqNullSafe(F.col("_s")) & (digest == F.col("_g"))
    out = plain.join(side, here)
    if copies.where("n > 1").isEmpty():
        out = out.withColumn("_t", F.col("copies"))
    else:
        # n equal rows share `copies`: each is taken copies div n times, and the first copies mod n of them once more. They are numbered within
        # the partitions of a stored table, whose counts are added up, so that no task holds all of very many
        group = ["_d", "_s", "_g"]
        several = cut(out.where("n > 1").withColumn("_p", F.spark_partition_id()))
        counts = several.groupBy(*group, "_p").agg(F.count("*").alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select(*[F.col(c).alias(f"{c}o") for c in group], F.col("_p").alias("_po"), before.alias("_before"))
        same = (F.col("_p") == F.col("_po")) & (F.col("_g") == F.col("_go")) & F.col("_d").eqNullSafe(F.col("_do")) & F.col("_s").eqNullSafe(F.col("_so"))
        number = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_p").orderBy(F.lit(0)))
        several = several.join(offsets, same).withColumn("_t", F.floor(F.col("copies") / F.col("n")) + F.when(number <= F.col("copies") % F.col("n"), 1).otherwise(0))
        single = out.where("n = 1").withColumn("_t", F.col("copies"))
        out = single.select(*plain.columns, "_t").unionByName(several.select(*plain.columns, "_t"))
    taken = out.where("_t > 0").withColumn("_t", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_t").cast("bigint"))))
    return taken.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3 AS room,
        CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM s),
f AS (SELECT *, CAST(coalesce(sum(room) OVER (ORDER BY room / weight, source COLLATE "binary" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS filled,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room / weight, source COLLATE "binary" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight,
        CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
l AS (SELECT arg_min((total - filled) / left_weight, room / weight) AS level FROM f
      WHERE room >= (total - filled) / left_weight * weight),
t AS (SELECT source, source_size, least(CAST(room AS DOUBLE), coalesce((SELECT level FROM l) * weight, CAST(room AS DOUBLE))) AS target FROM w),
p AS (SELECT doc_id, d.source, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(k, 1, 8), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
