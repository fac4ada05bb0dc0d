"""Amounts, companies, entities, relations and like deals in texts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.operators import entities
from dealgraph.plans.extraction import texts, texts_sql
from dealgraph.plans.registry import register

SAID = ["The deal value: $1,250,000.00 and a $2.5M upside, about two hundred thousand dollars. {} Total value 75,000 or $75,050.", "{} a $40k order for $40,000 contract, $1200 and $999 and $1.5 million", "{}",
        "My name is Jane Doe, reach out to John Smith. Jane Doe works for Acme Widgets Inc since Q3 2024. John Smith, Director of Sales. {} call 555-123-4567 or jane@acme.com", None,
        "Customer: Globex Holdings, with {} Initech Group supplier of Hooli Systems. For Umbrella company we quote $12,345 by Jan 5, 2025; client is The Firm will pay one million and five dollars",
        "Acme Corp is currently using Hooli Systems Inc and our partner Stark Technologies. {}\nThe vendor is Wayne Enterprises. Speaking with Peter Parker at Daily Bugle Company. $5000 next week, 12/31/2024"]


def group_sql(g: int) -> str:
    return f", {g}" if g else ""


def spans_ctes(name: str, pattern: str, groups: tuple[int, ...] = ()) -> str:
    """Common table expressions that end in `name`(text_id, k, start, end, g0, ...), the matches of a pattern in t."""
    p = pattern.replace("'", "''")
    cols = "".join(f", unnest(regexp_extract_all(text, '{p}', {g})) AS g{g}" for g in (0, *groups))
    return f"""
{name}_g AS (SELECT text_id, unnest(string_split_regex(text, '{p}')) AS gap, generate_subscripts(string_split_regex(text, '{p}'), 1) - 1 AS k FROM t WHERE text IS NOT NULL),
{name}_m AS (SELECT text_id, generate_subscripts(regexp_extract_all(text, '{p}'), 1) - 1 AS k{cols} FROM t WHERE text IS NOT NULL),
{name} AS (SELECT * EXCLUDE (gap, "end"), ("end" - length(g0))::INT AS start, "end"::INT AS "end" FROM (SELECT text_id, k, gap, {', '.join(f'g{g}' for g in (0, *groups))}, sum(length(gap) + length(g0)) OVER (PARTITION BY text_id ORDER BY k) AS "end" FROM {name}_g JOIN {name}_m USING (text_id, k)))"""


_NUM = r"try_cast(nullif(regexp_extract(replace(g1, ',', ''), '^(\d+\.?\d*|\.\d+)', 1), '') AS DOUBLE)"
_UNIT = "CASE WHEN lower(g2) LIKE 'm%' THEN 1e6 WHEN lower(g2) IN ('k', 'thousand') THEN 1e3 ELSE 1 END"
_WORDS = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in entities.NUMBER_WORDS.items()) + "}"
register("e14_amounts", lambda s, d: entities.amounts(texts(s, d, SAID)), texts_sql(SAID, True) + "," + ",".join([
    spans_ctes("a1", entities.LABELLED, (1,)), spans_ctes("a2", entities.QUALIFIED, (1, 2)), spans_ctes("a3", entities.ABBREVIATED, (1, 2)), spans_ctes("a4", entities.WRITTEN), spans_ctes("a5", entities.PLAIN_AMOUNT, (1,))]) + f"""
, s AS (SELECT text_id, 'deal_value' AS label, {_NUM} AS value, 0.9::DOUBLE AS confidence, start, "end" FROM a1 UNION ALL SELECT text_id, 'deal_value', {_NUM} * {_UNIT}, 0.9, start, "end" FROM a2 UNION ALL SELECT text_id, 'estimated_value', {_NUM} * {_UNIT}, 0.8, start, "end" FROM a3),
w(text_id, start, "end", rest, total, now) AS (SELECT text_id, start, "end", string_split_regex(lower(g0), '\\s+'), 0::DOUBLE, 0::DOUBLE FROM a4
  UNION ALL SELECT text_id, start, "end", rest[2:], CASE rest[1] WHEN 'thousand' THEN total + now * 1000 WHEN 'million' THEN total + now * 1000000 ELSE total END, CASE WHEN rest[1] = 'hundred' THEN now * 100 WHEN rest[1] IN ('thousand', 'million') THEN 0 ELSE now + coalesce({_WORDS}[rest[1]], 0) END FROM w WHERE len(rest) > 0),
r AS (SELECT * FROM s UNION ALL SELECT text_id, 'written_amount', total + now, 0.7, start, "end" FROM w WHERE len(rest) = 0
  UNION ALL SELECT text_id, 'possible_value', v, 0.6, start, "end" FROM (SELECT *, {_NUM} AS v FROM a5) x WHERE v >= 1000 AND NOT EXISTS (SELECT 1 FROM s WHERE s.text_id = x.text_id AND abs(s.value - x.v) < 100 AND s.value > 0))
SELECT * FROM r WHERE value > 0""")

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_VALID = rf"lower(name) NOT IN {entities.NO_NAMES} AND length(name) BETWEEN 3 AND 100 AND NOT regexp_matches(name, '^\d+$') AND len(string_split_regex(name, '\s+')) <= 8"
register("e15_companies", lambda s, d: entities.companies(texts(s, d, SAID)), texts_sql(SAID) + "," + ",".join([spans_ctes(f"c{i}", p, (1,)) for i, p in enumerate(entities.CUSTOMERS)] + [spans_ctes("c3", entities.SUFFIXED, (1, 2))]) + f"""
, n AS ({' UNION ALL '.join(f"SELECT text_id, k, {_TRIM.format('g1')} AS name, {i} AS rule, 'customer' AS type, 0.9::DOUBLE AS confidence FROM c{i}" for i in range(3))}
 UNION ALL SELECT text_id, k, {_TRIM.format('g1')} || ' ' || g2, 3, CASE {' '.join(f"WHEN regexp_matches(lower(text[greatest(0, start - 50) + 1 : " + '"end"' + f" + 50]), '{p}') THEN '{r}'" for r, p in entities.ROLE_WORDS)} ELSE 'unknown' END, 0.75 FROM c3 JOIN t USING (text_id)),
v AS (SELECT *, {_TRIM.format("regexp_replace(regexp_replace(name, '\\s+', ' ', 'g'), '[,;]$', '')")} AS clean FROM n WHERE {_VALID})
SELECT text_id, clean AS name, type, confidence FROM v QUALIFY row_number() OVER (PARTITION BY text_id, lower(clean) ORDER BY confidence DESC, rule, k) = 1""")

_FOUND = ",".join(spans_ctes(f"x{i}", p, (1, g) if g else ()) for i, (_, _, g, p) in enumerate(entities.ENTITIES)) + ", ent AS (" + " UNION ALL ".join(
    f"""SELECT text_id, '{kind}' AS type, g{g} AS text, {c}::DOUBLE AS confidence, {'(start + length(g1) + 1)::INT' if g else 'start'} AS start, "end" FROM x{i}""" for i, (kind, c, g, _) in enumerate(entities.ENTITIES)) + ")"
register("e30_entities", lambda s, d: entities.entities(texts(s, d, SAID)), texts_sql(SAID) + "," + _FOUND + " SELECT * FROM ent")


def _fit(alias: str, kind: str, group: int) -> str:
    test = f"{alias}.text = r.g{group}" if kind == "PERSON" else f"contains({alias}.text, r.g{group})"
    return f"(SELECT arg_min({alias}.text, ({alias}.start, {alias}.text)) FROM ent {alias} WHERE {alias}.text_id = r.text_id AND {alias}.type = '{kind}' AND {test})"


register("e31_relations", lambda s, d: entities.relations(texts(s, d, SAID)), texts_sql(SAID) + "," + _FOUND + "," + ",".join(spans_ctes(f"y{i}", p, tuple(sorted((a, b)))) for i, (_, _, _, a, _, b, p) in enumerate(entities.RELATIONS)) + ", rel AS (" + " UNION ALL ".join(
    f"SELECT text_id, '{name}' AS relation, {_fit('a', k1, g1)} AS one, {_fit('b', k2, g2)} AS two, {c}::DOUBLE AS confidence, start FROM y{i} r" for i, (name, c, k1, g1, k2, g2, _) in enumerate(entities.RELATIONS)) + ") SELECT * FROM rel WHERE one IS NOT NULL AND two IS NOT NULL")


def d23(s: SparkSession, d: str) -> DataFrame:
    """Lines of a text as deals: its first three words are the name, the next two the customer."""
    words = F.split(F.col("text"), "[\n.]+")
    deal = lambda x, i: F.struct(F.array_join(F.slice(F.split(F.trim(x), " "), 1, 3), " ").alias("name"), F.nullif(F.array_join(F.slice(F.split(F.trim(x), " "), 4, 2), " "), F.lit("")).alias("customer"), F.length(x).cast("double").alias("value"),
                                 F.when(i % 3 > 0, F.when(F.length(x) % 2 == 0, "won").otherwise("open")).alias("status"), (i * 7 % 10 / 10).alias("confidence"))
    t = texts(s, d, ["{}"]).select("text_id", entities.unique_deals(F.transform(F.filter(words, lambda x: F.trim(x) != ""), deal)).alias("u"))
    return t.select("text_id", F.size("u.unique").alias("n_unique"), F.size("u.duplicates").alias("n_duplicates"), F.md5(F.array_join(F.transform("u.unique", lambda x: F.concat_ws("|", x["name"], x["customer"], F.format_number(x["value"], 0), x["status"], F.format_number(x["confidence"], 1))), ";")).alias("digest"))


_ALIKE = "CASE WHEN lower({0}) = lower({1}) THEN 1 ELSE len(list_intersect(list_distinct(string_split(lower({0}), ' ')), list_distinct(string_split(lower({1}), ' ')))) / len(list_distinct(string_split(lower({0}), ' ') || string_split(lower({1}), ' '))) END"
_LIKE = f"""round((0.4 * {_ALIKE.format('d.name', 'u.name')} + CASE WHEN d.customer IS NOT NULL AND u.customer IS NOT NULL THEN 0.3 * {_ALIKE.format('d.customer', 'u.customer')} ELSE 0 END + 0.2 * (1 - abs(d.value - u.value) / greatest(d.value, u.value)) + CASE WHEN d.status = u.status THEN 0.1 ELSE 0 END)
 / (0.6 + CASE WHEN d.customer IS NOT NULL AND u.customer IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN d.status IS NOT NULL AND u.status IS NOT NULL THEN 0.1 ELSE 0 END), 9) >= 0.85"""
register("d23_unique_deals", d23, f"""
WITH RECURSIVE x AS (SELECT doc_id AS text_id, list_filter(string_split_regex(text, '[\\n.]+'), lambda l: trim(l) <> '') AS lines FROM documents WHERE text IS NOT NULL),
e AS (SELECT text_id, unnest(lines) AS l, generate_subscripts(lines, 1) - 1 AS i FROM x),
f AS (SELECT text_id, i, struct_pack(name := array_to_string(string_split(trim(l), ' ')[1:3], ' '), customer := nullif(array_to_string(string_split(trim(l), ' ')[4:5], ' '), ''), value := length(l), status := CASE WHEN i % 3 > 0 THEN CASE WHEN length(l) % 2 = 0 THEN 'won' ELSE 'open' END END, confidence := i * 7 % 10) AS d FROM e),
s(text_id, i, uniq, dups) AS (SELECT text_id, -1::BIGINT, []::STRUCT(name VARCHAR, customer VARCHAR, value BIGINT, status VARCHAR, confidence BIGINT)[], 0 FROM x UNION ALL
  SELECT text_id, i, CASE WHEN p = 0 THEN uniq || [d] WHEN d.confidence > uniq[p].confidence THEN uniq[1:p - 1] || [d] || uniq[p + 1:] ELSE uniq END, dups + (p > 0)::INT
  FROM (SELECT s.text_id, f.i, s.uniq, s.dups, f.d, coalesce(list_position(list_transform(s.uniq, lambda u: {_LIKE}), true), 0) AS p FROM s JOIN f ON f.text_id = s.text_id AND f.i = s.i + 1)),
z AS (SELECT text_id, uniq, dups FROM s QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY i DESC) = 1)
SELECT text_id, len(uniq)::INT AS n_unique, dups::INT AS n_duplicates, md5(array_to_string(list_transform(uniq, lambda u: concat_ws('|', u.name, u.customer, format('{{:,}}', u.value), u.status, (u.confidence / 10)::DECIMAL(3, 1))), ';')) AS digest FROM z""")
