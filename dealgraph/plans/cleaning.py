"""Signatures and the cleaning of mails, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import cleaning
from dealgraph.operators import extraction
from dealgraph.plans import texts as plans
from dealgraph.plans.extraction import texts, texts_sql
from dealgraph.plans.registry import register

SIGNED = ["{}\n-- \nJane Roe\nSenior Engineer\nAcme Systems\njane@acme.com\n+1 (555) 123-4567\nThis email is confidential and\nmore of it", "Hi {}\nall good\nBest regards,\nJohn Smith\nSales LEAD, Big Company\nBig Company Inc.\njohn@x.org", "{}",
          "Thanks,\n{}", "a\nCheers\n1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n11", "-----\n{}", "", None, "{}\nAnn Other\nVP\nann@y.net 5551234567\nend", "> quoted {}\nx\n  —smart “quotes” and​ zero…\né composed\n\n\n\n\tTab!!!!\nSent from my iPhone\nIf you are not the intended recipient, stop", "short\n> q {}", "  \n\t"]

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _first(test: str, last: int | None) -> str:
    return f"list_min(list_filter(range(1, len(ls) + 1), lambda i: {f'i > len(ls) - {last} AND ' if last else ''}{test}))"


def _contact(x: str) -> str:
    return f"(regexp_matches({x}, '{cleaning.ADDRESS}') OR regexp_matches({x}, '{cleaning.PHONE}'))"


def signs(source: str, name: str) -> str:
    """Common table expressions that end in `name`: text_id, x, ls, line (from 0), confidence, marker, body, signature of the texts x of `source`."""
    return f"""
{name}_l AS (SELECT text_id, x, string_split(x, chr(10)) AS ls FROM {source} WHERE x IS NOT NULL),
{name}_a AS (SELECT *, {_first(f"regexp_matches({_TRIM.format('ls[i]')}, '{cleaning.DELIMITER}')", None)} AS a, {_first(f"regexp_matches({_TRIM.format('ls[i]')}, '{cleaning.CLOSINGS}')", 10)} AS b, {_first(_contact('ls[i]'), 5)} AS c FROM {name}_l),
{name}_s AS (SELECT text_id, x, ls, CASE WHEN {_TRIM.format('x')} = '' THEN NULL ELSE coalesce(a - 1, b - 1, CASE WHEN c IS NOT NULL THEN greatest(c - 3, 0) END) END::INT AS line, CASE WHEN a IS NOT NULL THEN 1.0 WHEN b IS NOT NULL THEN 0.8 WHEN c IS NOT NULL THEN 0.6 END::DOUBLE AS confidence,
  CASE WHEN a IS NOT NULL THEN 'delimiter' WHEN b IS NOT NULL THEN 'pattern' WHEN c IS NOT NULL THEN 'heuristic' END AS marker FROM {name}_a),
{name} AS (SELECT *, CASE WHEN line IS NULL THEN x ELSE {_TRIM.format("array_to_string(ls[1:line], chr(10))")} END AS body, CASE WHEN line IS NOT NULL THEN {_TRIM.format("array_to_string(ls[line + 1:], chr(10))")} END AS signature FROM {name}_s)"""


def e04(s: SparkSession, d: str) -> DataFrame:
    x = cleaning.split_signature(texts(s, d, SIGNED))
    return x.select("text_id", "sign.line", "sign.confidence", "sign.marker", F.md5("body").alias("body"))


_SIGNED = texts_sql(SIGNED) + ", tx AS (SELECT text_id, text AS x FROM t)"
register("e04_signatures", e04, _SIGNED + "," + signs("tx", "g") + " SELECT text_id, line, CASE WHEN line IS NOT NULL THEN confidence END AS confidence, CASE WHEN line IS NOT NULL THEN marker END AS marker, md5(body) AS body FROM g UNION ALL SELECT text_id, NULL, NULL, NULL, NULL FROM tx WHERE x IS NULL")


def e05(s: SparkSession, d: str) -> DataFrame:
    x = cleaning.split_signature(texts(s, d, SIGNED)).where("signature is not null")
    return x.select("text_id", cleaning.parsed_signature(F.col("signature")).alias("p")).select("text_id", *[F.md5(f"p.{c}").alias(c) for c in ("name", "title", "company", "email", "phone", "disclaimer")])


_NAMED = "|".join(f"{w}|{w.lower()}".replace(".", "\\.") for w in cleaning.COMPANIES)
_DISCLAIMER = "CASE " + " ".join(f"WHEN regexp_extract(signature, '((?i:{p})(?s:.*))', 1) <> '' THEN {_TRIM.format(f'''left(regexp_extract(signature, '((?i:{p})(?s:.*))', 1), 500)''')}" for p in cleaning.DISCLAIMERS) + " END"
register("e05_parsed_signatures", e05, _SIGNED + "," + signs("tx", "g") + f"""
, n AS (SELECT text_id, signature, list_filter(list_transform(string_split(signature, chr(10)), lambda l: {_TRIM.format('l')}), lambda l: l <> '') AS ks FROM g WHERE signature IS NOT NULL),
m AS (SELECT *, list_filter(ks[2:4], lambda l: NOT {_contact('l')}) AS near FROM n),
o AS (SELECT *, list_min(list_filter(range(1, len(near) + 1), lambda i: regexp_matches(lower(near[i]), '{'|'.join(cleaning.TITLES)}'))) AS k FROM m)
SELECT text_id, md5(CASE WHEN NOT regexp_matches(ks[1], '{cleaning.NO_NAME}') AND NOT regexp_matches(ks[1], '{cleaning.ADDRESS}') THEN ks[1] END) AS name, md5(near[k]) AS title, md5(list_filter(near, lambda l, i: regexp_matches(l, '{_NAMED}') AND i IS DISTINCT FROM k)[1]) AS company,
 md5(CASE WHEN regexp_matches(signature, '{cleaning.ADDRESS}') THEN regexp_extract(signature, '{cleaning.ADDRESS}', 1) END) AS email, md5(CASE WHEN regexp_matches(signature, '{cleaning.PHONE}') THEN {_TRIM.format(f"regexp_extract(signature, '{cleaning.PHONE}', 1)")} END) AS phone, md5({_DISCLAIMER}) AS disclaimer FROM o""")


def e01(s: SparkSession, d: str) -> DataFrame:
    return cleaning.cleaned(texts(s, d, SIGNED)).withColumns({"cleaned": F.md5("cleaned"), "signature": F.md5("signature")})


register("e01_cleaned", e01, _SIGNED + rf"""
, i AS (SELECT text_id, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS k FROM tx),
q AS (SELECT *, regexp_matches(trim(l, ' '), '(?i){extraction.QUOTE_LINE}') AS q, trim(l, ' ') = '' OR regexp_matches(trim(l, ' '), '(?i)^(from|to|cc|bcc|subject|date|sent):\s*.+$') AS soft FROM i),
r AS (SELECT *, q OR soft AND coalesce((SELECT arg_max(o.q, o.k) FROM q o WHERE o.text_id = q.text_id AND o.k < q.k AND (o.q OR NOT o.soft)), false) AS gone FROM q),
u AS (SELECT text_id, regexp_replace(regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT gone), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS y, bool_or(gone) AS cut FROM r GROUP BY 1),
p AS (SELECT text_id, tx.x AS original, CASE WHEN cut THEN y ELSE tx.x END AS x FROM tx JOIN u USING (text_id) WHERE tx.x IS NOT NULL),""" + signs("p", "g") + rf"""
, b AS (SELECT text_id, original, {_TRIM.format('original')} = '' AS blank, g.x AS plain, signature, nfc_normalize(body) AS x FROM g JOIN p USING (text_id)),
c AS (SELECT *, trim(regexp_replace({plans._T}, '(?m)^ +| +$', '', 'g'), ' ') AS y FROM b),
n AS (SELECT *, CASE WHEN blank THEN '' ELSE replace(replace(regexp_replace(regexp_replace(regexp_replace(y, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\x{{2018}}\x{{2019}}\x{{2032}}\x{{2033}}]', '''', 'g'), '[\x{{201C}}\x{{201D}}]', '"', 'g'), chr(8212), '--'), chr(8211), '-') END AS z FROM c)
SELECT text_id, md5(z) AS cleaned, md5(CASE WHEN NOT blank THEN signature END) AS signature, NOT blank AND length(original) <> length(plain) AS had_quotes, NOT blank AND signature IS NOT NULL AS had_signature, length(original)::INT AS original_length, length(z)::INT AS cleaned_length, length({_TRIM.format('z')}) >= 10 AS has_content FROM n
UNION ALL SELECT text_id, md5(''), NULL, false, false, 0, 0, false FROM tx WHERE x IS NULL""")
