"""Scalar functions over table columns, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import normalize, similarity
from dealgraph.operators import joins
from dealgraph.plans.named import fuzzy_ctes
from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import SQL, deals, table, vendors

COMPANIES = ["{} Corp.", "  {}   Corporation, Inc. ", "{} Co LLC", "O'{} & Sons Ltd", "", "{}", "{} Company Limited", "{}-Industries, GmbH", "{}, Inc.", "{} Inc", "{} Co. Ltd", "{} PLC", "{} Capital S.A.", "Inc", None]


def companies(s: SparkSession, d: str) -> DataFrame:
    """(id, x): the parts' names as companies."""
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), written(F.initcap("p_name"), F.col("p_partkey"), COMPANIES).alias("x"))


_INITCAP = "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
_COMPANIES = f"WITH t AS (SELECT p_partkey AS id, {written_sql(_INITCAP, 'p_partkey', COMPANIES)} AS x FROM part) "
PLAIN = r"trim(regexp_replace(regexp_replace(lower(trim(x)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
register("d01_plain", lambda s, d: companies(s, d).select("id", normalize.plain(F.col("x")).alias("y")), _COMPANIES + f"SELECT id, {PLAIN} AS y FROM t")


def _suffixes(x: str) -> str:
    for suffix in normalize.TRAILING_SUFFIXES:
        x = rf"trim(regexp_replace({x}, '\b{suffix}$', ''))"
    return x


register("d02_company_key", lambda s, d: companies(s, d).select("id", normalize.company_key(F.col("x")).alias("y")), _COMPANIES + f"SELECT id, {_suffixes(PLAIN)} AS y FROM t")
register("v08_vendor_key", lambda s, d: companies(s, d).select("id", normalize.vendor_key(F.col("x")).alias("y")), _COMPANIES + r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'), '\b(inc|llc|ltd|corp|corporation|company|co)\b', '', 'g')) AS y FROM t""")


def _company_sql() -> str:
    squeezed = r"regexp_replace(trim(x), '\s+', ' ', 'g')"
    cases = " ".join(rf"WHEN regexp_matches({squeezed}, '(?i)[,\s]+{suffix}$') THEN trim(regexp_replace({squeezed}, '(?i)[,\s]+{suffix}$', ''))" for suffix in normalize.COMPANY_SUFFIXES)
    return f"CASE {cases} ELSE {squeezed} END"


register("f05_company", lambda s, d: companies(s, d).select("id", normalize.company(F.col("x")).alias("c")).select("id", "c.value", "c.confidence"), _COMPANIES + f"SELECT id, {_company_sql()} AS value, CAST(CASE WHEN {_company_sql()} = x THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM t")

MAILS = ["Jane.{}@Example.COM ", "no at sign {}", None, "a@b", "x.{}@sub.domain.co.uk", "", "two@@{}.com", "{}@mail.example.org"]


def customers(s: SparkSession, d: str, forms: list[str | None]) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), written(F.col("c_custkey").cast("string"), F.col("c_custkey"), forms).alias("x"))


def customers_sql(forms: list[str | None]) -> str:
    return f"WITH t AS (SELECT c_custkey AS id, {written_sql('c_custkey::VARCHAR', 'c_custkey', forms)} AS x FROM customer) "


register("v09_email_domain", lambda s, d: customers(s, d, MAILS).select("id", normalize.email_domain(F.col("x")).alias("y")), customers_sql(MAILS) + r"SELECT id, nullif(regexp_extract(lower(trim(x)), '@([a-z0-9.-]+\.[a-z]{2,})$', 1), '') AS y FROM t")
register("f04_email", lambda s, d: customers(s, d, MAILS).select("id", normalize.email(F.col("x")).alias("e")).select("id", "e.value", "e.confidence"), customers_sql(MAILS) + r"""
SELECT id, lower(trim(coalesce(x, ''))) AS value, CAST(CASE WHEN lower(trim(coalesce(x, ''))) = '' THEN 1.0 WHEN regexp_matches(lower(trim(x)), '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 1.0 ELSE 0.3 END AS DOUBLE) AS confidence FROM t""")

PHONES = ["+1 (555) 123-{}", "555-{}-4567", "1-555-{}-4567", "44207123{}", "{}", "none", None, "+49 30 1234{}", "12345678{}90"]
register("f03_phone", lambda s, d: customers(s, d, PHONES).select("id", normalize.phone(F.col("x")).alias("p")).select("id", "p.value", "p.confidence", "p.valid"), customers_sql(PHONES) + r"""
, g AS (SELECT id, x, regexp_replace(coalesce(x, ''), '[^\d+]', '', 'g') AS g FROM t)
SELECT id, CASE WHEN trim(coalesce(x, '')) = '' OR g = '' THEN '' WHEN g LIKE '+%' AND length(g) BETWEEN 11 AND 15 THEN g WHEN length(g) = 10 THEN '+1' || g WHEN length(g) = 11 AND g LIKE '1%' THEN '+1' || g[2:] WHEN length(g) BETWEEN 11 AND 15 THEN '+' || g ELSE g END AS value,
CAST(CASE WHEN trim(coalesce(x, '')) = '' THEN 1.0 WHEN g = '' THEN 0.0 WHEN g LIKE '+%' AND length(g) BETWEEN 11 AND 15 THEN 0.95 WHEN length(g) = 10 OR length(g) = 11 AND g LIKE '1%' THEN 0.85 WHEN length(g) BETWEEN 11 AND 15 THEN 0.7 ELSE 0.3 END AS DOUBLE) AS confidence,
trim(coalesce(x, '')) <> '' AND (g LIKE '+%' AND length(g) BETWEEN 11 AND 15 OR length(g) = 10 OR length(g) BETWEEN 11 AND 15) AS valid FROM g""")

STATUSES = ["New", " closed won ", "In-Progress", "weird {}", None, "Canceled", "", "{}"]
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in normalize.DEAL_STATUS.items()) + "}"
register("f06_status", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), written(F.col("o_orderstatus"), F.col("o_orderkey"), STATUSES).alias("x")).select("id", normalize.status(F.col("x")).alias("c")).select("id", "c.value", "c.confidence"), f"""
WITH l AS (SELECT o_orderkey AS id, lower(trim(coalesce({written_sql('o_orderstatus', 'o_orderkey', STATUSES)}, ''))) AS l, {_MAP} AS m FROM orders) SELECT id, CASE WHEN l = '' THEN 'registered' ELSE coalesce(m[l], l) END AS value, CAST(CASE WHEN l = '' THEN 1.0 WHEN m[l] IS NOT NULL THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence FROM l""")

MONEY = ["${}", "{}K", "${}.5M USD", "€{}.50", "1.2B", "GBP {}", "n/a", None, "₹ {} 000", "CHF {}k", "{} EUR", "¥{}", "+{}", "approx. {}"]


def f02(s: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice")
    grouped = F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    t = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), written(grouped, F.col("o_orderkey"), MONEY).alias("x"))
    return t.select("id", normalize.currency(F.col("x")).alias("c")).select("id", "c.value", "c.currency", "c.confidence")


_GROUPED = "(floor(o_totalprice)::BIGINT // 1000)::VARCHAR || ',' || lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0')"
_SYMBOL = "CASE " + " ".join(f"WHEN contains(x, '{k}') THEN '{k}'" for k in normalize.CURRENCY_SYMBOLS) + " END"
register("f02_currency", f02, f"""
WITH t AS (SELECT o_orderkey AS id, trim(coalesce({written_sql(_GROUPED, 'o_orderkey', MONEY)}, '')) AS x FROM orders),
a AS (SELECT id, x, {_SYMBOL} AS symbol, MAP {{{', '.join(f"'{k}': '{v}'" for k, v in normalize.CURRENCY_SYMBOLS.items())}}} AS names FROM t),
b AS (SELECT id, x, names[symbol] AS named, CASE WHEN symbol IS NULL THEN x ELSE trim(x[1:strpos(x, symbol) - 1] || x[strpos(x, symbol) + length(symbol):]) END AS rest FROM a),
c AS (SELECT id, x, named, regexp_extract(rest, '\\b([A-Z]{{3}})\\b', 1) AS capitals, regexp_replace(regexp_replace(rest, '^(.*?)\\b[A-Z]{{3}}\\b', '\\1'), '[,\\s]', '', 'g') AS rest FROM b),
e AS (SELECT *, coalesce(nullif(capitals, ''), named, 'USD') AS code, CASE {' '.join(f"WHEN regexp_matches(rest, '(?i)[0-9][.]?{k}') THEN '{k}'" for k in normalize.MULTIPLIERS)} END AS letter FROM c),
f AS (SELECT *, try_cast(nullif(CASE WHEN letter IS NULL THEN regexp_extract(rest, '^([+-]?[0-9]*[.]?[0-9]+)', 1) ELSE regexp_extract(rest, '(?i)([0-9]+[.]?[0-9]*)' || letter, 1) END, '') AS DOUBLE) AS n FROM e)
SELECT id, CASE WHEN x = '' OR n IS NULL THEN 0.0 ELSE round(n * CASE letter {' '.join(f"WHEN '{k}' THEN {v:.0f}" for k, v in normalize.MULTIPLIERS.items())} ELSE 1 END, 4) END::DOUBLE AS value,
CASE WHEN x = '' OR n IS NULL THEN 'USD' ELSE code END AS currency, CASE WHEN x = '' THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM f""")

#: Patterns of Spark and of SQL, and forms around the written date.
DATES = [("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("MMM d, yyyy", "%b %-d, %Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d-M-yyyy", "%-d-%-m-%Y"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ")]
DATE_FORMS = ["{}", "{}", " {} ", "{}", "garbage {}", None, "", "Q3 2024", "q1  1999", "13-13-2024", "{}"]


def f01(s: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.lit(None).cast("string")
    for k, (pattern, _) in enumerate(DATES):
        text = F.when(key % len(DATES) == k, F.date_format("o_orderdate", pattern)).otherwise(text)
    return table(s, d, "orders").select(key.alias("id"), normalize.date(written(text, key, DATE_FORMS)).alias("c")).select("id", "c.value", "c.confidence", "c.format")


_DATE = f"CASE o_orderkey % {len(DATES)} " + " ".join(f"WHEN {k} THEN strftime(o_orderdate, '{p}')" for k, (_, p) in enumerate(DATES)) + " END"
register("f01_date", f01, rf"""
WITH t AS (SELECT o_orderkey AS id, trim(coalesce({written_sql(_DATE, 'o_orderkey', DATE_FORMS)}, '')) AS x FROM orders),
a AS (SELECT id, x, CASE WHEN regexp_matches(x, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN try_strptime(x[1:10], '%Y-%m-%d') WHEN regexp_matches(x, '^\d+[-/]\d+[-/]\d{{4}}$') THEN try_strptime(replace(x, '-', '/'), '%m/%d/%Y') ELSE coalesce(try_strptime(x, '%b %d, %Y'), try_strptime(x, '%B %d, %Y')) END AS easy,
  CASE WHEN regexp_matches(x, '^\d+[-/]\d+[-/]\d{{4}}$') THEN try_strptime(replace(x, '-', '/'), '%d/%m/%Y') END AS british,
  CASE WHEN regexp_matches(x, '(?i)^q[1-4]\s+\d{{4}}$') THEN make_date(right(x, 4)::INT, x[2]::INT * 3 - 2, 1) END AS quarter FROM t)
SELECT id, strftime(coalesce(easy, british, quarter), '%Y-%m-%d') AS value, CASE WHEN x = '' THEN 1.0 WHEN easy IS NOT NULL THEN 0.8 WHEN coalesce(british, quarter) IS NOT NULL THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence,
CASE WHEN x = '' THEN 'none' WHEN easy IS NOT NULL THEN 'auto' WHEN british IS NOT NULL THEN 'UK_DMY' WHEN quarter IS NOT NULL THEN 'QUARTER' ELSE 'failed' END AS format FROM a""")

SUBJECTS = ["Re: {}", "FWD: re: {}", "{}", " fw:  {} ", "AW: {}"]
register("e21_subject", lambda s, d: table(s, d, "pages").select("page_id", normalize.subject(written(F.col("url"), F.col("page_id"), SUBJECTS)).alias("y")), rf"SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim({written_sql('url', 'page_id', SUBJECTS)})), '^(re|fwd|fw):\s*', ''), '\s+', ' ', 'g')) AS y FROM pages")

LABELS = [*normalize.LABEL_WEIGHTS, "UNKNOWN"]
_WEIGHTS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in normalize.LABEL_WEIGHTS.items()) + "}"


def f31(s: SparkSession, d: str) -> DataFrame:
    """Messages with two labels and, for every third, no more than one."""
    names, k = F.array(*[F.lit(x) for x in LABELS]), F.col("event_id")
    pick = F.array(F.get(names, k % len(LABELS)), F.get(names, F.floor(k / 7) % len(LABELS)))
    return table(s, d, "events").select(k, normalize.label_score(F.slice(pick, 1, F.when(k % 3 == 0, 1).otherwise(2))).alias("score")).withColumn("process", F.col("score") >= normalize.LABEL_PASS)


register("f31_label_score", f31, f"""
WITH t AS (SELECT event_id, {LABELS} AS names FROM events), x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [names[event_id % {len(LABELS)} + 1]] ELSE [names[event_id % {len(LABELS)} + 1], names[event_id // 7 % {len(LABELS)} + 1]] END AS x FROM t),
w AS (SELECT event_id, CAST(list_sum(list_transform(x, lambda l: coalesce({_WEIGHTS}[l], 0))) AS INT) AS score FROM x) SELECT event_id, score, score >= 30 AS process FROM w""")

# ---------------------------------------------------------------- similarities

PAIRED = ["{}", "{} corp", "the {}", "{}s", "{}", "web {}", ""]


def name_pairs(s: SparkSession, d: str) -> DataFrame:
    """(id, a, b): each part's name, and the next part's as somebody writes it."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    following = p.select((F.col("id") - 1).alias("id"), written(F.col("a"), F.col("id"), PAIRED).alias("b"))
    return p.join(following, "id").unionByName(p.select(-F.col("id") - 1, "a", written(F.col("a"), F.col("id"), PAIRED)).toDF("id", "a", "b"))


_PAIRS = f"""WITH t AS (SELECT p.p_partkey AS id, p.p_name AS a, {written_sql('q.p_name', 'q.p_partkey', PAIRED)} AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
UNION ALL SELECT -p_partkey - 1, p_name, {written_sql('p_name', 'p_partkey', PAIRED)} FROM part) """
_BIGRAMS = r"list_transform(range(1, length({0})), lambda i: {0}[i:i+1])"
_X, _Y = r"regexp_replace(a, '\s+', '', 'g')", r"regexp_replace(b, '\s+', '', 'g')"
register("v05_dice", lambda s, d: name_pairs(s, d).select("id", F.round(similarity.dice(F.col("a"), F.col("b")), 6).alias("dice")), _PAIRS + f"""
, g AS (SELECT id, {_X} AS x, {_Y} AS y FROM t), h AS (SELECT *, {_BIGRAMS.format('x')} AS gx, {_BIGRAMS.format('y')} AS gy FROM g)
SELECT id, round(CASE WHEN x = y THEN 1.0 WHEN length(x) < 2 OR length(y) < 2 THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(gx), lambda e: least(len(list_filter(gx, lambda q: q = e)), len(list_filter(gy, lambda q: q = e))))), 0) / (len(gx) + len(gy)) END, 6)::DOUBLE AS dice FROM h""")
register("d03_fuzzy", lambda s, d: name_pairs(s, d).select("id", "a", "b", F.round(similarity.fuzzy(F.col("a"), F.col("b")), 4).alias("score")), _PAIRS + "," + fuzzy_ctes("f", "SELECT trim(a) AS a, trim(b) AS b FROM t") + """
SELECT id, t.a, t.b, round(coalesce(score, 0), 4)::DOUBLE AS score FROM t LEFT JOIN f ON f.a = trim(t.a) AND f.b = trim(t.b)""")


def d05(s: SparkSession, d: str) -> DataFrame:
    """Values of successive orders; every ninth is missing, every fifth equal, every second within some percent."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("a"))
    n = o.select((F.col("id") - 1).alias("id"), F.col("a").alias("next"))
    b = F.when(F.col("id") % 5 == 0, F.col("a")).when(F.col("id") % 2 == 0, F.col("a") * (1 + F.col("id") % 40 / 100)).otherwise(F.col("next"))
    return o.join(n, "id").select("id", F.round(similarity.value_similarity(F.col("a"), b), 6).alias("sim"))


register("d05_value_similarity", d05, """
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS a FROM orders), t AS (SELECT o.id, o.a, CASE WHEN o.id % 5 = 0 THEN o.a WHEN o.id % 2 = 0 THEN o.a * (1 + o.id % 40 / 100) ELSE n.a END AS b FROM o JOIN o n ON n.id = o.id + 1),
p AS (SELECT id, a, b, abs(a - b) / ((a + b) / 2) * 100 AS p FROM t)
SELECT id, round(CASE WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN 0 WHEN a = b THEN 1 WHEN p <= 10 THEN 1 - p / 10 * 0.3 WHEN p <= 30 THEN 0.7 * (1 - (p - 10) / 20) ELSE 0 END, 6)::DOUBLE AS sim FROM p""")


def d06(s: SparkSession, d: str) -> DataFrame:
    o = deals(s, d).select("id", "created_at")
    return o.select("id", F.round(similarity.date_similarity(F.col("created_at"), F.lit("1998-06-15").cast("date")), 6).alias("sim")).where("sim > 0")


register("d06_date_similarity", d06, SQL + """
, x AS (SELECT id, abs(date_diff('day', DATE '1998-06-15', created_at::DATE)) AS n FROM deals)
SELECT id, round(CASE WHEN n <= 7 THEN 1 - n / 7 * 0.3 WHEN n <= 28 THEN 0.7 * (1 - (n - 7) / 21) ELSE 0 END, 6)::DOUBLE AS sim FROM x WHERE n < 28""")


def d07(s: SparkSession, d: str) -> DataFrame:
    """Orders by their set of product types: pairs of sets that share a type, each set under its smallest order."""
    p = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    sets = p.groupBy("t").agg(F.min("l_orderkey").alias("id"), F.count("*").alias("n"))
    a, b = sets.select(F.col("id").alias("a"), F.col("t").alias("x"), F.col("n").alias("orders_a")), sets.select(F.col("id").alias("b"), F.col("t").alias("y"), F.col("n").alias("orders_b"))
    # a pair meets at the first type that both have
    shared = a.withColumn("k", F.explode("x")).join(b.withColumn("k", F.explode("y")), "k").where("a < b").where(F.col("k") == F.array_min(F.array_intersect("x", "y")))
    return shared.select("a", "b", "orders_a", "orders_b", F.round(similarity.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


register("d07_product_jaccard", d07, """
WITH p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT p_type)) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), s AS (SELECT t, min(k) AS id, count(*) AS n FROM p GROUP BY 1)
SELECT x.id AS a, y.id AS b, x.n AS orders_a, y.n AS orders_b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6)::DOUBLE AS jaccard FROM s x JOIN s y ON x.id < y.id AND list_has_any(x.t, y.t)""")


def j06(s: SparkSession, d: str) -> DataFrame:
    """Pairs of similar names: blocked on the number's last three digits, then scored."""
    v = table(s, d, "customer").select(F.col("c_custkey").alias("id"), similarity.trigrams(F.col("c_name")).alias("grams"), F.substring("c_name", -3, 3).alias("block"))
    return joins.trigram_pairs(v)


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i+2]))))"
register("j06_trigram_pairs", j06, f"""
WITH v AS (SELECT c_custkey AS id, {_TRI.format('c_name')} AS g, right(c_name, 3) AS k FROM customer)
SELECT a.id AS id_1, b.id AS id_2, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6)::DOUBLE AS sim FROM v a JOIN v b ON a.k = b.k AND a.id < b.id""")


def v02(s: SparkSession, d: str) -> DataFrame:
    """Exact match on the normalised name, of documents' sources to vendors by a padded number."""
    v = vendors(s, d).select("vendor_id", normalize.vendor_key(F.col("vendor_name")).alias("k"))
    q = table(s, d, "customer").select("c_custkey", normalize.vendor_key(F.regexp_replace("c_name", "Customer", "Supplier")).alias("k"))
    return q.join(v, "k").select("c_custkey", "vendor_id", F.lit(1.0).alias("confidence"))


register("v02_exact_match", v02, "SELECT c_custkey, s_suppkey AS vendor_id, CAST(1.0 AS DOUBLE) AS confidence FROM customer JOIN supplier ON replace(c_name, 'Customer', '') = replace(s_name, 'Supplier', '')")
