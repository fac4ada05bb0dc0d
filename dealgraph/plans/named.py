"""Deals with company and deal names as several people write them, and the fuzzy similarity of all pairs of names in SQL.

Five customers of the tables are one company, whose name is spelt from its number; each order writes it, and the part's name, in one of several forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import SQL, deals, table

CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxz", "aeiou"
#: A prime and two multipliers, by which numbers are mixed before they are spelt, so that numbers near each other give other names.
PRIME, FIRST, SECOND = 1_000_003, 654_321, 389
CUSTOMERS = ["{}", "{} Inc.", "{} Corporation", "The {}", "{} Co., Ltd", "{}", "{} & Sons", "{}s"]
NAMES = ["{}", "{} order", "New {}", "{} - phase 2", "{}", "Renewal: {}"]
#: What asks: the stated query set of a search.
ASKED = 50


def _word(m: Column) -> Column:
    """Five letters of a number, consonants and vowels in turn."""
    def letter(letters: str, by: int) -> Column:
        return F.substring(F.lit(letters), (F.floor(m / by) % len(letters) + 1).cast("int"), F.lit(1))

    return F.initcap(F.concat(letter(CONSONANTS, 1), letter(VOWELS, 20), letter(CONSONANTS, 100), letter(VOWELS, 2_000), letter(CONSONANTS, 10_000)))


def with_company(df: DataFrame, key: Column, name: str = "company") -> DataFrame:
    """df with the name of the company with a number. In steps, as one expression would hold each number ten times."""
    out = df.withColumn("_k", key).withColumn("_m", (F.col("_k") * FIRST + 98_765) % PRIME).withColumn("_n", (F.col("_m") * SECOND + 7) % PRIME)
    return out.withColumn(name, F.concat(_word(F.col("_m")), F.lit(" "), _word(F.col("_n")), F.when(F.col("_k") >= PRIME, F.concat(F.lit(" "), F.floor(F.col("_k") / PRIME).cast("string"))).otherwise(""))).drop("_k", "_m", "_n")


def named_deals(s: SparkSession, d: str) -> DataFrame:
    """(id, deal_name, customer_name, vendor_id, deal_value, created_at, status, customer_id)."""
    x = with_company(deals(s, d), F.floor(F.col("customer_id") / 5))
    return x.select("id", written(F.col("deal_name"), F.col("id"), NAMES).alias("deal_name"), F.when(F.col("customer_id").isNotNull(), written(F.col("company"), F.col("id"), CUSTOMERS)).alias("customer_name"),
                    "vendor_id", F.when(F.col("id") % 11 > 0, F.col("deal_value")).alias("deal_value"), "created_at", F.when(F.col("id") % 13 == 0, "rejected").otherwise("open").alias("status"), "customer_id")


def product_sets(s: SparkSession, d: str) -> DataFrame:
    """(id, products, emails): the types and brands of an order's parts, and its customer's addresses."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey"))
    kinds = lines.join(table(s, d, "part").select("p_partkey", "p_type"), "p_partkey").groupBy("id").agg(F.collect_set("p_type").alias("products"))
    return kinds.join(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("a"), (F.col("o_custkey") % 100).cast("string"), F.lit("@x.com")), F.concat(F.lit("B"), F.col("o_custkey").cast("string"), F.lit("@Y.com"))).alias("emails")), "id")


def _word_sql(m: str) -> str:
    first, *rest = [f"'{letters}'[{m} // {by} % {len(letters)} + 1]" for letters, by in ((CONSONANTS, 1), (VOWELS, 20), (CONSONANTS, 100), (VOWELS, 2_000), (CONSONANTS, 10_000))]
    return " || ".join([f"upper({first})", *rest])


def _company_of(k: str) -> str:
    m = f"(({k} * {FIRST} + 98765) % {PRIME})"
    return f"{_word_sql(m)} || ' ' || {_word_sql(f'(({m} * {SECOND} + 7) % {PRIME})')} || CASE WHEN {k} >= {PRIME} THEN ' ' || {k} // {PRIME} ELSE '' END"


_COMPANY = _company_of("(customer_id // 5)")


def plain_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"


def company_sql(x: str) -> str:
    """D02 in SQL."""
    from dealgraph.functions.normalize import TRAILING_SUFFIXES

    out = plain_sql(x)
    for suffix in TRAILING_SUFFIXES:
        out = rf"trim(regexp_replace({out}, '\b{suffix}$', ''))"
    return out


#: Common table expressions: nd, the named deals with the forms that are compared.
NAMED = SQL + f"""
, raw AS (SELECT id, {written_sql('deal_name', 'id', NAMES)} AS deal_name, {written_sql(f'({_COMPANY})', 'id', CUSTOMERS)} AS customer_name, vendor_id, CASE WHEN id % 11 > 0 THEN deal_value END AS deal_value, created_at,
  CASE WHEN id % 13 = 0 THEN 'rejected' ELSE 'open' END AS status, customer_id FROM deals),
nd AS (SELECT *, {plain_sql('deal_name')} AS n, {plain_sql('customer_name')} AS m, {company_sql('customer_name')} AS k FROM raw)"""


def fuzzy_ctes(name: str, pairs: str) -> str:
    """Common table expressions that end in `name`(a, b, score): D03 of the distinct pairs (a, b) of plain texts that `pairs` selects, by comparing
    whole texts, without any index. Longest common subsequences are counted with the bits of one number (texts of up to 60 characters)."""
    grams = "list_transform(range(1, length({0})), lambda i: {0}[i:i+1])"
    mask = "list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN x[i] = c THEN 1::BIGINT << (i - 1)::INT ELSE 0 END))::BIGINT"
    return f"""
{name}_p AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''),
{name}_w AS (SELECT a, b, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM {name}_p WHERE a <> b),
{name}_t AS (SELECT a, b, array_to_string(list_sort(wa), ' ') AS sa, array_to_string(list_sort(wb), ' ') AS sb, list_sort(list_distinct(list_intersect(wa, wb))) AS base,
  list_sort(list_distinct(list_filter(wa, lambda w: NOT list_contains(wb, w)))) AS oa, list_sort(list_distinct(list_filter(wb, lambda w: NOT list_contains(wa, w)))) AS ob,
  CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM {name}_w),
{name}_s AS (SELECT *, array_to_string(base, ' ') AS c, array_to_string(list_concat(base, oa), ' ') AS one, array_to_string(list_concat(base, ob), ' ') AS two FROM {name}_t),
{name}_q AS (SELECT a, b, unnest([{{'x': a, 'y': b}}, {{'x': sa, 'y': sb}}, {{'x': one, 'y': two}}, {{'x': c, 'y': one}}, {{'x': c, 'y': two}}] || list_transform(range(0, length(long) - length(short) + 1), lambda i: {{'x': short, 'y': long[i + 1 : i + length(short)]}})) AS v FROM {name}_s),
{name}_m AS (SELECT x, length(x)::INT AS l, map_from_entries(list_transform(list_distinct(string_split(x, '')), lambda c: struct_pack(k := c, v := {mask}))) AS ms FROM (SELECT DISTINCT v.x AS x FROM {name}_q WHERE v.x <> '')),
{name}_r AS (SELECT a, b, max(floor(200.0 * (l - bit_count(list_reduce([(1::BIGINT << l) - 1] || list_transform(string_split(v.y, ''), lambda c: coalesce(ms[c], 0)::BIGINT), lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << l) - 1)))) / (l + length(v.y)) + 0.5)) AS r
  FROM {name}_q JOIN {name}_m ON v.x = x WHERE v.y <> '' GROUP BY 1, 2),
{name}_g AS (SELECT a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM {name}_w),
{name}_d AS (SELECT a, b, CASE WHEN x = y THEN 100 WHEN length(x) < 2 OR length(y) < 2 THEN 0 ELSE 200.0 * coalesce(list_sum(list_transform(list_distinct(gx), lambda e: least(len(list_filter(gx, lambda q: q = e)), len(list_filter(gy, lambda q: q = e))))), 0) / (len(gx) + len(gy)) END::DOUBLE AS d
  FROM (SELECT *, {grams.format('x')} AS gx, {grams.format('y')} AS gy FROM {name}_g)),
{name} AS (SELECT a, b, greatest(r, d)::DOUBLE AS score FROM {name}_r JOIN {name}_d USING (a, b) UNION ALL SELECT a, b, 100 FROM {name}_p WHERE a = b)"""


# ---------------------------------------------------------------- vendors and mentions of them

MENTIONED = ["{}", "{} Inc.", "{} Hldgs", "{}s LLC", "the {}", "{} Grp.", "x{}", "{}", None, "LLC"]


def vendor_catalogue(s: SparkSession, d: str) -> DataFrame:
    """(vendor_id, vendor_name, domains, products): suppliers as companies; the products are the name (whole or its last word) and the type of the part with their number."""
    k = F.col("s_suppkey")
    part = table(s, d, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name", "p_type")
    return with_company(table(s, d, "supplier"), k).join(part, "s_suppkey", "left").select(
        k.alias("vendor_id"), F.concat("company", F.when(k % 3 == 0, ", Inc.").otherwise("")).alias("vendor_name"),
        F.array(F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com")), F.concat(F.lit("m"), (k % 60).cast("string"), F.lit(".example.com"))).alias("domains"),
        F.array(F.when(k % 2 == 0, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), -1)), F.lower("p_type")).alias("products"))


def vendor_mentions(s: SparkSession, d: str) -> DataFrame:
    """(mention_id, name, email, products, keywords): customers as mentions of vendors, some of them unknown."""
    k = F.col("c_custkey")
    part = table(s, d, "part").select(F.col("p_partkey").alias("_p"), "p_name", "p_type")
    return with_company(table(s, d, "customer"), k * 7 % 130).withColumn("_p", k % 150).join(part, "_p", "left").select(
        k.alias("mention_id"), written(F.col("company"), k, MENTIONED).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("x@s"), (k * 3 % 120).cast("string"), F.lit(".example.com"))).when(k % 4 == 1, F.concat(F.lit("y@m"), (k % 70).cast("string"), F.lit(".example.com"))).alias("email"),
        F.when(k % 3 == 0, F.array(F.initcap("p_name"), F.element_at(F.split("p_name", " "), 1))).when(k % 3 == 1, F.array(F.concat("p_name", F.lit("x")))).otherwise(F.array().cast("array<string>")).alias("products"),
        F.when(k % 5 == 0, F.array(F.lower("p_type"), F.lit("none"))).otherwise(F.array().cast("array<string>")).alias("keywords"))


def key_sql(x: str) -> str:
    """V08 in SQL."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'), '\b(inc|llc|ltd|corp|corporation|company|co)\b', '', 'g'))"


def ratio_ctes(name: str, pairs: str) -> str:
    """Common table expressions that end in `name`(a, b, ratio, dice), in percent, of the distinct pairs of texts that `pairs` selects."""
    grams = "list_transform(range(1, length({0})), lambda i: {0}[i:i+1])"
    mask = "list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::BIGINT << (i - 1)::INT ELSE 0 END))::BIGINT"
    return f"""
{name}_p AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''),
{name}_m AS (SELECT a, length(a)::INT AS l, map_from_entries(list_transform(list_distinct(string_split(a, '')), lambda c: struct_pack(k := c, v := {mask}))) AS ms FROM (SELECT DISTINCT a FROM {name}_p)),
{name}_r AS (SELECT a, b, floor(200.0 * (l - bit_count(list_reduce([(1::BIGINT << l) - 1] || list_transform(string_split(b, ''), lambda c: coalesce(ms[c], 0)::BIGINT), lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << l) - 1)))) / (l + length(b)) + 0.5) AS ratio,
  replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM {name}_p JOIN {name}_m USING (a)),
{name} AS (SELECT a, b, ratio::DOUBLE AS ratio, CASE WHEN x = y THEN 100 WHEN length(x) < 2 OR length(y) < 2 THEN 0 ELSE 200.0 * coalesce(list_sum(list_transform(list_distinct(gx), lambda e: least(len(list_filter(gx, lambda q: q = e)), len(list_filter(gy, lambda q: q = e))))), 0) / (len(gx) + len(gy)) END::DOUBLE AS dice
  FROM (SELECT *, {grams.format('x')} AS gx, {grams.format('y')} AS gy FROM {name}_r))"""


#: vc, the catalogue, and vm, the mentions, with their normalised names; nr, ratio and dice of all pairs of names.
VENDORS = f"""WITH vc AS (SELECT s_suppkey AS vendor_id, ({_company_of('s_suppkey')}) || CASE WHEN s_suppkey % 3 = 0 THEN ', Inc.' ELSE '' END AS vendor_name, ['s' || s_suppkey || '.example.com', 'm' || (s_suppkey % 60) || '.example.com'] AS domains,
  [CASE WHEN s_suppkey % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[-1] END, lower(p_type)] AS products, {key_sql('vendor_name')} AS k FROM supplier LEFT JOIN part ON p_partkey = s_suppkey),
vm AS (SELECT c_custkey AS mention_id, {written_sql(f"({_company_of('(c_custkey * 7 % 130)')})", 'c_custkey', MENTIONED)} AS name,
  CASE c_custkey % 4 WHEN 0 THEN 's' || (c_custkey * 3 % 120) || '.example.com' WHEN 1 THEN 'm' || (c_custkey % 70) || '.example.com' END AS domain,
  CASE c_custkey % 3 WHEN 0 THEN [p_name, string_split(p_name, ' ')[1]] WHEN 1 THEN [p_name || 'x'] ELSE [] END AS products, CASE WHEN c_custkey % 5 = 0 THEN [lower(p_type), 'none'] ELSE [] END AS keywords, {key_sql('name')} AS k FROM customer LEFT JOIN part ON p_partkey = c_custkey % 150),
""" + ratio_ctes("nr", "SELECT x.k AS a, y.k AS b FROM (SELECT DISTINCT k FROM vm) x, (SELECT DISTINCT k FROM vc) y")
