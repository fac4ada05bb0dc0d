"""Duplicate detection between records (D04, D08-D20, D27) and survivorship.

Names meet by the fuzzy similarity join (operators.fuzzy_join), on distinct names; records then meet by equi joins on what is
alike: pairs of names, vendors, and buckets of values or dates as wide as the score allows. No strategy compares
all pairs, needs an equal name, or loses a pair. `asked` picks the records that are compared with all others
(rows (asked, other)); without it, each pair of the whole table is found once, the smaller id first. A hot key's
rows are split by AQE, as both sides of the joins are shuffled by the join's keys alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgraph.functions import similarity
from dealgraph.functions.normalize import company_key, plain
from dealgraph.functions.workers import cut as _cut
from dealgraph.operators.fuzzy_join import similar_pairs, similar_rows

AUTO, REVIEW = 0.95, 0.85
#: Thresholds of the strategies.
NAME_LEAST, NAME_MEAN, ALIKE, VENDOR_ALIKE, FACTORS = 70, 85, 0.85, 0.80, 0.70
#: Candidates of one record on line, the newest first.
NEWEST = 200
_FIELDS = ("id", "_n", "_m", "_k", "vendor_id", "deal_value", "created_at")


def pairs_by(records: DataFrame, block: str, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """Pairs (smaller id first) of records in one block: columns end in _1 and _2."""
    def side(k: int) -> DataFrame:
        return records.where(F.col(block).isNotNull()).select(F.col(block).alias("_block"), *[F.col(c).alias(f"{c}_{k}") for c in (key, *columns)])

    return side(1).join(side(2), "_block").where(f"{key}_1 < {key}_2")


def both(f, name: str) -> Column:
    return f(F.col(f"{name}_1"), F.col(f"{name}_2"))


def prepared(records: DataFrame) -> DataFrame:
    """Records (id, deal_name, customer_name, vendor_id, deal_value, created_at) with the forms that are compared: _n and _m, the plain
    names of deal and customer, and _k, the customer's without company suffixes."""
    return records.select("id", plain(F.col("deal_name")).alias("_n"), plain(F.col("customer_name")).alias("_m"), company_key(F.col("customer_name")).alias("_k"), "vendor_id", "deal_value", "created_at")


def _sides(r: DataFrame, asked: Column | str | None, fields: tuple[str, ...] = _FIELDS) -> tuple[DataFrame, DataFrame, Column]:
    left = (r if asked is None else r.where(asked)).select([F.col(c).alias(f"{c}_1") for c in fields])
    return left, r.select([F.col(c).alias(f"{c}_2") for c in fields]), F.col("id_1") < F.col("id_2") if asked is None else F.col("id_1") != F.col("id_2")


def alike(r: DataFrame, asked: Column | str | None, form: str, least: float) -> DataFrame:
    """(a, b, score 0 to 1): the forms of asked records, and the forms of all records that are alike, equal ones included."""
    mine = r if asked is None else r.where(asked)
    return similar_pairs(mine.select(F.col(form).alias("text")), r.select(F.col(form).alias("text")), least * 100).withColumn("score", F.col("score") / 100)


def _by_customer(r: DataFrame, asked: Column | str | None, customers: DataFrame, near: Column, other: Column) -> DataFrame:
    """Pairs with alike customers (a, b, score: _c) of which a value of the array `near` of the first is `other` of the second."""
    left, right, order = _sides(r, asked)
    left = left.join(customers.select(F.col("a").alias("_k_1"), F.col("b").alias("_to"), F.col("score").alias("_c")), "_k_1").withColumn("_near", F.explode(near))
    return left.join(right.withColumn("_near", other).withColumnRenamed("_k_2", "_to"), ["_to", "_near"]).where(order)


def _value_bucket(value: Column, percent: float, steps: tuple[int, ...] = (0,)) -> Column:
    """Buckets of values as wide as `percent` of the mean allows two values to lie apart; with -1, 0 and 1 as steps, all that may be near."""
    width = math.log((2 + percent / 100) / (2 - percent / 100)) + 1e-9
    bucket = F.when(value > 0, F.floor(F.log(value) / width))
    return F.transform(F.array(*[F.lit(k) for k in steps]), lambda k: bucket + k) if len(steps) > 1 else bucket


def _date_bucket(at: Column, days: int, steps: tuple[int, ...] = (0,)) -> Column:
    """Buckets of so many days; with -1, 0 and 1 as steps, all that may be near."""
    bucket = F.floor(F.datediff(at, F.lit("1970-01-01").cast("date")) / days)
    return F.transform(F.array(*[F.lit(k) for k in steps]), lambda k: bucket + k) if len(steps) > 1 else bucket


def _found(pairs: DataFrame, strategy: str, score: Column) -> DataFrame:
    return pairs.select("id_1", "id_2", F.lit(strategy).alias("strategy"), score.alias("score"))


def exact(r: DataFrame, asked: Column | str | None = None) -> DataFrame:
    """The same plain name and company, values less than 1 apart where both are known and not 0."""
    left, right, order = _sides(r, asked)
    p = left.join(right, (F.col("_n_1") == F.col("_n_2")) & (F.col("_k_1") == F.col("_k_2"))).where(order)
    known = (F.coalesce("deal_value_1", F.lit(0.0)) != 0) & (F.coalesce("deal_value_2", F.lit(0.0)) != 0)
    return _found(p.where(~known | (F.abs(F.col("deal_value_1") - F.col("deal_value_2")) < 1)), "exact", F.lit(1.0))


def fuzzy_name(r: DataFrame, asked: Column | str | None = None) -> DataFrame:
    """Deal and customer names (suffixes and all) at least 70 percent alike, and 85 in the mean. Distinct deal names meet first; then, within the deals of one name, the customers of those that are asked and have
    a like name are compared with theirs, against what the mean still asks of them. Only pairs that are found are made."""
    left, right, order = _sides(r, asked)
    names = alike(r, asked, "_n", NAME_LEAST / 100).select(F.col("a").alias("_n_1"), F.col("b").alias("key"), (F.col("score") * 100).alias("given"))
    mine = left.join(names, "_n_1").select("key", F.col("id_1").alias("id"), F.col("_m_1").alias("text"), F.greatest(F.lit(float(NAME_LEAST)), 2 * NAME_MEAN - F.col("given") - 1e-6).alias("least"), "given")
    met = similar_rows(mine, right.select(F.col("_n_2").alias("key"), F.col("id_2").alias("id"), F.col("_m_2").alias("text"))).where(order & (F.round(F.col("given") + F.col("score"), 7) >= 2 * NAME_MEAN))
    return _found(met, "fuzzy_name", (F.col("given") + F.col("score")) / 200)


def customer_value(r: DataFrame, asked: Column | str | None = None, customers: DataFrame | None = None, least: float = ALIKE) -> DataFrame:
    """Customers and values alike; values meet in buckets. customers: alike(..., "_k", at most `least`), if it is there."""
    customers = (alike(r, asked, "_k", least) if customers is None else customers).where(F.col("score") >= least)
    percent = (1 - least) / 0.3 * 10
    p = _by_customer(r, asked, customers, _value_bucket(F.col("deal_value_1"), percent, (-1, 0, 1)), _value_bucket(F.col("deal_value_2"), percent))
    v = both(similarity.value_similarity, "deal_value")
    return _found(p.where(v >= least), "customer_value", 0.6 * F.col("_c") + 0.4 * v)


def customer_date(r: DataFrame, asked: Column | str | None = None, customers: DataFrame | None = None, least: float = ALIKE) -> DataFrame:
    """Customers and dates alike; dates meet in buckets of days."""
    customers = (alike(r, asked, "_k", least) if customers is None else customers).where(F.col("score") >= least)
    days = math.floor((1 - least) / 0.3 * 7 + 1e-9) + 1
    p = _by_customer(r, asked, customers, _date_bucket(F.col("created_at_1"), days, (-1, 0, 1)), _date_bucket(F.col("created_at_2"), days))
    d = both(similarity.date_similarity, "created_at")
    return _found(p.where(d >= least), "customer_date", 0.6 * F.col("_c") + 0.4 * d)


def vendor_customer(r: DataFrame, asked: Column | str | None = None, least: float = VENDOR_ALIKE) -> DataFrame:
    """The same vendor and alike customers; the deals' names add to the score. Deals meet by their vendor, and the customers' outlines are compared inside the join: a vendor has
    far fewer deals than there are alike names, and none but pairs that may be alike leave it."""
    left, right, order = _sides(r, asked)
    left, right = left.withColumn("_o_1", similarity.outline(F.col("_k_1"))), right.withColumn("_o_2", similarity.outline(F.col("_k_2")))
    met = left.join(right, (F.col("vendor_id_1") == F.col("vendor_id_2")) & order & similarity.may_reach(F.col("_o_1"), F.col("_o_2"), 100 * least))
    p = met.select("id_1", "id_2", "_n_1", "_n_2", (both(lambda a, b: similarity.fuzzy_of_plain(a, b, 100 * least), "_k") / 100).alias("_c")).where(F.col("_c") >= least)
    return _found(p, "vendor_customer", F.least(F.lit(1.0), 0.3 + 0.5 * F.col("_c") + 0.2 * both(similarity.fuzzy_of_plain, "_n") / 100))


def multi_factor(r: DataFrame, asked: Column | str | None = None, least: float = FACTORS) -> DataFrame:
    """The weighted score of name, customer, vendor, value and date. Equal names leave a rest that the other three must reach, which takes two of them: a pair meets by vendor and value bucket, by vendor
    and date bucket, or by both buckets, once. Inside the join its rest, and what that asks of the names' outlines, are checked, so that few pairs are compared by name. Where both buckets are all that is
shared, the customers of a bucket are compared in cells, so that no pair is made but those that they allow."""
    w = similarity.WEIGHTS
    rest_least = least - w["name"] - w["customer"]
    # the least similarity of values without a vendor, and of dates without one of the two
    value_least, date_least = (rest_least - w["date"]) / w["value"], (rest_least - max(w["vendor"], w["value"])) / w["date"]
    if min(value_least, date_least) <= 0:
        raise ValueError("at so low a score, pairs with only one factor in common would count")
    percent = (1 - value_least) / 0.3 * 10 if value_least > 0.7 else 10 + 20 * (1 - value_least / 0.7)
    days = math.floor(((1 - date_least) / 0.3 * 7 if date_least > 0.7 else 7 + 21 * (1 - date_least / 0.7)) + 1e-9) + 1
    # made once for all ways of meeting
    outlined = _cut(r.select(*_FIELDS, similarity.outline(F.col("_n")).alias("_on"), similarity.outline(F.col("_k")).alias("_ok")))
    left, right, order = _sides(outlined, asked, (*_FIELDS, "_on", "_ok"))
    same = F.coalesce(F.col("vendor_id_1") == F.col("vendor_id_2"), F.lit(False))
    value = both(similarity.value_similarity, "deal_value")
    valued = (F.col("deal_value_1") > 0) & (F.col("deal_value_2") > 0) & (value > 0)
    rest = w["vendor"] * same.cast("double") + w["value"] * value + w["date"] * both(similarity.date_similarity, "created_at")

    def reach(form: str, weight: str) -> Column:
        asks = 100 * (least - rest - (w["name"] + w["customer"] - w[weight])) / w[weight] - 1e-6
        return (asks <= 55) | similarity.may_reach(F.col(f"_o{form}_1"), F.col(f"_o{form}_2"), asks)

    enough = order & (rest >= rest_least - 1e-9) & reach("n", "name") & reach("k", "customer")

    def near(x: DataFrame, name: str, buckets: Column, key: str) -> DataFrame:
        return x.where(F.col(name).isNotNull()).withColumn(key, F.explode(buckets))

    def met(keys: list[str], one: DataFrame, two: DataFrame, which: Column) -> DataFrame:
        found = one.alias("x").join(two.alias("y"), [*(F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys), which, enough])
        return found.select("id_1", "id_2", "_n_1", "_n_2", "_k_1", "_k_2", rest.alias("_rest"))

    steps = (-1, 0, 1)
    wide, wides = (_value_bucket(F.col(f"deal_value_{k}"), 30, x) for k, x in ((2, (0,)), (1, steps)))
    narrow, narrows = (_value_bucket(F.col(f"deal_value_{k}"), percent, x) for k, x in ((2, (0,)), (1, steps)))
    dated, dates = _date_bucket(F.col("created_at_2"), days), _date_bucket(F.col("created_at_1"), days, steps)
    by_value = met(["_v", "_w"], near(left, "deal_value_1", wides, "_w").withColumn("_v", F.col("vendor_id_1")), right.withColumn("_w", wide).withColumn("_v", F.col("vendor_id_2")), valued)
    by_date = met(["_v", "_d"], near(left, "created_at_1", dates, "_d").withColumn("_v", F.col("vendor_id_1")), right.withColumn("_d", dated).withColumn("_v", F.col("vendor_id_2")), ~F.coalesce(valued, F.lit(False)))
    one, two = near(left, "created_at_1", dates, "_d"), right.withColumn("_d", dated)
    # without a vendor, customers must be so much alike
    customers = 100 * (rest_least + w["customer"] - w["value"] - w["date"]) / w["customer"] - 1e-6
    if customers > 55:
        def of(x: DataFrame, k: int, *more: Column) -> DataFrame:
            return x.where(F.col(f"deal_value_{k}") > 0).select(F.col("_d").cast("string").alias("key"), F.col(f"id_{k}").alias("id"), F.col(f"_k_{k}").alias("text"), *more)

        pairs = similar_rows(of(one, 1, F.lit(customers).alias("least"), F.lit(0.0).alias("given")), of(two, 2)).where(order).select("id_1", "id_2")
        others = pairs.join(left, "id_1").join(right, "id_2").where(~same & enough).select("id_1", "id_2", "_n_1", "_n_2", "_k_1", "_k_2", rest.alias("_rest"))
    else:
        others = met(["_w", "_d"], near(one, "deal_value_1", narrows, "_w"), two.withColumn("_w", narrow), ~same)
    p = by_value.unionByName(by_date).unionByName(others)
    score = F.col("_rest") + w["name"] * both(similarity.fuzzy_of_plain, "_n") / 100 + w["customer"] * both(similarity.fuzzy_of_plain, "_k") / 100
    return _found(p.withColumn("_score", F.round(score, 9)).where(F.col("_score") >= least), "multi_factor", F.col("_score"))


#: In the order that decides ties.
STRATEGIES = ("exact", "fuzzy_name", "customer_value", "customer_date", "vendor_customer", "multi_factor")


def combine(*found: DataFrame, least: float = REVIEW) -> DataFrame:
    """The best strategy per pair, earlier ones winning ties, and what to do with it. One
    partial aggregate, no window."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    rank = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    best = out.groupBy("id_1", "id_2").agg(F.max(F.struct(F.round("score", 6).alias("score"), (-rank).alias("rank"), "strategy")).alias("b"))
    scored = best.select("id_1", "id_2", "b.strategy", "b.score").where(F.col("score") >= least)
    return scored.withColumn("action", F.when(F.col("score") >= AUTO, "auto_merge").otherwise("manual_review"))


def detect(records: DataFrame, asked: Column | str | None = None, least: float = REVIEW) -> DataFrame:
    """Duplicates by all six strategies. The records and the alike customers are computed once."""
    r = _cut(prepared(records))
    customers = _cut(alike(r, asked, "_k", ALIKE))
    return combine(exact(r, asked), fuzzy_name(r, asked), customer_value(r, asked, customers), customer_date(r, asked, customers), vendor_customer(r, asked), multi_factor(r, asked), least=least)


def online_candidates(records: DataFrame, asked: Column | str, newest: int = NEWEST) -> DataFrame:
    """(id_1, id_2, rank): what an asked record (id, customer_name, vendor_id, status, created_at) is compared with on line: records that are not
    rejected, have the same vendor or hold the customer's name in theirs, the newest (then the smallest id) first. No more than `newest` of a
    vendor or of a name can be among the newest of both, so only these are joined."""
    from dealgraph.operators.vendor_match import contained_in

    low = records.withColumn("_c", F.lower("customer_name"))
    newest_first = [F.desc("created_at"), F.asc("id")]

    def newest_of(key: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))
        return low.where(F.coalesce("status", F.lit("")) != "rejected").where(F.col(key).isNotNull()).withColumn("_r", rank).where(F.col("_r") <= newest).select(key, F.col("id").alias("id_2"), F.col("created_at").alias("_at"))

    mine = low.where(asked).select(F.col("id").alias("id_1"), "vendor_id", "_c")
    held = contained_in(mine.select(F.col("_c").alias("short")), low.select(F.col("_c").alias("long")))
    named = mine.join(held, F.col("_c") == F.col("short")).select("id_1", F.col("long").alias("_c")).join(newest_of("_c"), "_c").select("id_1", "id_2", "_at")
    found = named.unionByName(mine.select("id_1", "vendor_id").join(newest_of("vendor_id"), "vendor_id").select("id_1", "id_2", "_at")).distinct()
    rank = F.row_number().over(Window.partitionBy("id_1").orderBy(F.desc("_at"), F.asc("id_2")))
    return found.withColumn("rank", rank).where(F.col("rank") <= newest).where("id_1 <> id_2").select("id_1", "id_2", "rank")


def judged(r: DataFrame, pairs: DataFrame, least: float = REVIEW) -> DataFrame:
    """D15-D17 of given pairs (id_1, id_2, each once) of prepared records: what detect finds among them. Each pair is scored by all strategies where it stands, so the work grows with the pairs
    alone. The names of deals count only where the customers are alike, by either form, and are compared only there."""
    if least < REVIEW:
        raise ValueError("below REVIEW, customers that are less alike would count")
    w, alike_from = similarity.WEIGHTS, 100 * VENDOR_ALIKE - 0.01
    left, right, _ = _sides(r, None)
    p = pairs.select("id_1", "id_2").join(left, "id_1").join(right, "id_2")
    p = p.withColumn("_c", both(lambda a, b: similarity.fuzzy_of_plain(a, b, alike_from), "_k"))
    near = F.col("_c") >= alike_from
    p = p.withColumn("_y", both(lambda a, b: similarity.fuzzy_of_plain(a, b, NAME_LEAST), "_m"))
    p = p.withColumn("_x", similarity.fuzzy_of_plain(F.when(near | (F.col("_y") >= NAME_LEAST), F.col("_n_1")), F.col("_n_2")))
    p = p.withColumns({"_c": F.col("_c") / 100, "_v": both(similarity.value_similarity, "deal_value"), "_d": both(similarity.date_similarity, "created_at"), "_same": F.coalesce(F.col("vendor_id_1") == F.col("vendor_id_2"), F.lit(False))})
    known = (F.coalesce("deal_value_1", F.lit(0.0)) != 0) & (F.coalesce("deal_value_2", F.lit(0.0)) != 0)
    n, c, v, d, same = F.col("_x") / 100, F.col("_c"), F.col("_v"), F.col("_d"), F.col("_same")
    factors = F.round(w["name"] * n + w["customer"] * c + w["vendor"] * same.cast("double") + w["value"] * v + w["date"] * d, 9)
    scores = {
        "exact": F.when((F.col("_n_1") == F.col("_n_2")) & (F.col("_k_1") == F.col("_k_2")) & (~known | (F.abs(F.col("deal_value_1") - F.col("deal_value_2")) < 1)), 1.0),
        "fuzzy_name": F.when((F.col("_x") >= NAME_LEAST) & (F.col("_y") >= NAME_LEAST) & (F.round(F.col("_x") + F.col("_y"), 7) >= 2 * NAME_MEAN), (F.col("_x") + F.col("_y")) / 200),
        "customer_value": F.when((c >= ALIKE) & (v >= ALIKE), 0.6 * c + 0.4 * v),
        "customer_date": F.when((c >= ALIKE) & (d >= ALIKE), 0.6 * c + 0.4 * d),
        "vendor_customer": F.when(same & (c >= VENDOR_ALIKE), F.least(F.lit(1.0), 0.3 + 0.5 * c + 0.2 * n)),
        "multi_factor": F.when((c > 0) & (factors >= FACTORS), factors),
    }
    found = [F.when(x.isNotNull(), F.struct(F.round(x, 6).alias("score"), F.lit(-STRATEGIES.index(s)).alias("rank"), F.lit(s).alias("strategy"))) for s, x in scores.items()]
    best = p.select("id_1", "id_2", F.array_max(F.array(*found)).alias("b")).select("id_1", "id_2", "b.strategy", "b.score").where(F.col("score") >= least)
    return best.withColumn("action", F.when(F.col("score") >= AUTO, "auto_merge").otherwise("manual_review"))


def find_similar(records: DataFrame, asked: Column | str, least: float = 0.5) -> DataFrame:
    """The duplicates of each asked record among its on-line candidates, the surest first: (id_1, rank, id_2, strategy, score, action). Only the candidates, of which a record has
    at most NEWEST, are compared."""
    records = _cut(records)
    found = judged(prepared(records), online_candidates(records, asked), max(least, REVIEW))
    rank = F.row_number().over(Window.partitionBy("id_1").orderBy(F.desc("score"), "id_2"))
    return found.withColumn("rank", rank).select("id_1", "rank", "id_2", "strategy", "score", "action")


def batch_summary(asked: DataFrame, found: DataFrame) -> DataFrame:
    """How many records (id) were asked, and how many of them have a duplicate in found (id_1, ...)."""
    hit = found.select(F.col("id_1").alias("id")).distinct().withColumn("_hit", F.lit(1))
    return asked.select("id").join(hit, "id", "left").agg(F.count("*").alias("total"), F.count("_hit").alias("duplicates_found"), (F.count("*") - F.count("_hit")).alias("unique_entities"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster_id, id): connected components of the pairs, by minimum labels that are also
    jumped along, until nothing changes. The lineage is cut in the session's checkpoint folder."""
    edges = pairs.select(F.col("id_1").alias("a"), F.col("id_2").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = _cut(edges)
    labels = _cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jumped = stepped.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next").select("id", "label", F.least("next", "far").alias("next"))
        jumped = _cut(jumped)
        if jumped.where("label <> next").isEmpty():
            break
        labels = jumped.select("id", F.col("next").alias("label"))
    return labels.select(F.col("label").alias("cluster_id"), "id")


def cluster_keys(members: DataFrame) -> DataFrame:
    """Size and key of a cluster; the key is the digest of the sorted ids (a fold over the
    ids would put a cluster into one row)."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("size > 1")


def best_records(members: DataFrame, quality: str, key: str = "id") -> DataFrame:
    """The record of the highest quality per cluster, the smallest id among equals."""
    return members.groupBy("cluster_id").agg(F.max_by(key, F.struct(F.col(quality), -F.col(key))).alias("master_id"), F.max(quality).alias("quality"))


def field_conflicts(members: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields with more than one value per cluster, null being a value; over two need review."""
    rows = members.unpivot(["cluster_id"], [F.col(f).cast("string").alias(f) for f in fields], "field", "value")
    n = F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))
    return rows.groupBy("cluster_id", "field").agg(n.alias("values")).where("values > 1").withColumn("manual_review", F.col("values") > 2)


def survivors(members: DataFrame, fields: tuple[str, ...], at: str) -> DataFrame:
    """Per cluster and field, the newest value that is there."""
    return members.groupBy("cluster_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(at, -F.col("id")))).alias(f) for f in fields])


def ordered_pair_log(found: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Each pair once, smaller id first, with its best score."""
    return found.select(F.least(a, b).alias("id_1"), F.greatest(a, b).alias("id_2"), score).groupBy("id_1", "id_2").agg(F.max(score).alias(score))


def file_duplicates(files: DataFrame, key: str, content: str) -> DataFrame:
    """Files whose digest another one with a smaller key has."""
    digest = files.select(F.col(key), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return digest.join(first, "digest").where(F.col(key) > F.col("first")).select(key, F.col("first").alias("duplicate_of"))
