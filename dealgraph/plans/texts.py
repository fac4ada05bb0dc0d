"""Queries over texts, conversations, pages and opportunities, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.functions import cleaning, text
from dealgraph.operators import extraction, opportunity
from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import SQL, deal_vendors, deals, table

#: What is said in every turn of a conversation beside its own text.
TURNS = ["{} What is the price of this?", "{}\nWe are struggling with our current system, it is too slow", "Sounds good, send me a proposal. {}", "It is too expensive for us {}", "Can you explain the onboarding process? {}",
         "{}", "{} When can we go live? How soon can we get started?", "We need approval from the board\n{}", "{} show me a demo", "what's our budget {}", "{} worth $1,200.50 or $3M, maybe $75k", "{}"]


def turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", written(F.col("text"), F.col("conv_id") * 5 + F.col("turn"), TURNS).alias("x"))


_TURNS = f"WITH t AS (SELECT conv_id, turn, {written_sql('text', '(conv_id * 5 + turn)', TURNS)} AS x FROM conversations)"


def _alt(groups: dict) -> list[str]:
    return ["(?i)" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") for ps in groups.values()]


def _hits(groups: dict) -> str:
    return " + ".join(f"regexp_matches(x, '{p}')::INT" for p in _alt(groups))


def e27(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d).select("conv_id", *[text.signal_hits(F.col("x"), g).alias(n) for n, g in (("e", text.EXPLICIT), ("i", text.IMPLICIT), ("g", text.ENGAGEMENT))])
    c = t.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in "eig"])
    return c.withColumn("score", F.round(text.signal_score(F.col("e"), F.col("i"), F.col("g")), 6)).withColumn("registerable", F.col("score") >= 0.5)


register("e27_buying_signals", e27, _TURNS + f"""
, h AS (SELECT conv_id, CAST(sum({_hits(text.EXPLICIT)}) AS BIGINT) AS e, CAST(sum({_hits(text.IMPLICIT)}) AS BIGINT) AS i, CAST(sum({_hits(text.ENGAGEMENT)}) AS BIGINT) AS g FROM t GROUP BY 1)
SELECT *, round(0.4 * least(e / 3, 1) + 0.3 * least(i / 5, 1) + 0.3 * least(g / 4, 1), 6)::DOUBLE AS score, score >= 0.5 AS registerable FROM h""")
_OBJECTION = "(?i)" + "|".join(f"(?:{p})" for ps in text.OBJECTIONS.values() for p in ps).replace("'", "''")
register("e29_intents", lambda s, d: turns(s, d).select("conv_id", "turn", text.intent(F.col("x")).alias("intent")), _TURNS + f" SELECT conv_id, turn, CASE WHEN regexp_matches(x, '{_OBJECTION}') THEN 'raising_objection' " + " ".join("WHEN regexp_matches(x, '(?i){}') THEN '{}'".format(p.replace("'", "''"), n) for n, p, _ in text.INTENTS) + " ELSE 'off_topic' END AS intent FROM t")
register("e28_conversation_signals", lambda s, d: table(s, d, "conversations").select("conv_id", text.signal_hits(F.col("text"), text.EXPLICIT).alias("h"), text.intent(F.col("text")).alias("intent")).groupBy("conv_id", "intent").agg(F.sum("h").alias("hits"), F.count("*").alias("turns")),
         f"SELECT conv_id, CASE WHEN regexp_matches(x, '{_OBJECTION}') THEN 'raising_objection' " + " ".join("WHEN regexp_matches(x, '(?i){}') THEN '{}'".format(p.replace("'", "''"), n) for n, p, _ in text.INTENTS) + f" ELSE 'off_topic' END AS intent, CAST(sum({_hits(text.EXPLICIT)}) AS BIGINT) AS hits, count(*) AS turns FROM (SELECT conv_id, text AS x FROM conversations) GROUP BY 1, 2")

_H = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->', '', 'g')"
_H = rf"regexp_replace(regexp_replace(regexp_replace({_H}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g')"
for _n, _c in text.ENTITIES:
    _H = "replace({}, '{}', '{}')".format(_H, _n, _c.replace("'", "''"))
register("e08_html_text", lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("digest")), rf"SELECT page_id, md5(trim(regexp_replace(regexp_replace({_H}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM pages")

MESSY = ["{} Wow!!!! Really????? Wait...... Break------here", "a\tb   c\r\nd\n\n\n\n\n{}", "ctrl\x01\x02x  {}  ", "  lead\n  both  \n{} \n end", "", None, "{}"]


def documents(s: SparkSession, d: str, forms: list[str | None]) -> DataFrame:
    return table(s, d, "documents").select("doc_id", written(F.col("text"), F.col("doc_id"), forms).alias("x"))


def _documents(forms: list[str | None]) -> str:
    return f"WITH t AS (SELECT doc_id, {written_sql('text', 'doc_id', forms)} AS x FROM documents) "


_T = r"regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
_T = rf"regexp_replace(regexp_replace(regexp_replace({_T}, '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), ' {{2,}}', ' ', 'g')"
for _p, _s in ((r"!{3,}", "'!!'"), (r"\?{3,}", "'??'"), (r"\.{4,}", "'...'"), (r"-{4,}", "'---'"), (r"\n{3,}", "chr(10) || chr(10)")):
    _T = f"regexp_replace({_T}, '{_p}', {_s}, 'g')"


register("e06_tidy", lambda s, d: documents(s, d, MESSY).select("doc_id", F.md5(text.tidy(cleaning.composed(F.col("x")))).alias("digest")), _documents(MESSY) + rf"SELECT doc_id, md5(trim(regexp_replace({_T}, '(?m)^ +| +$', '', 'g'), ' ')) AS digest FROM (SELECT doc_id, nfc_normalize(x) AS x FROM t)")

MAILS = ["Hello\n> quoted\n{}\n> more\nbye", "{}\nOn Mon, Jan 1, A wrote:\n> x\n> y", "no quotes {}", "> all\n> quoted {}", "{}\n----- Original Message -----\nold", "From: someone\n{}", "", None, " > {}\nfrom here: on\nFROM: x@y.z\nend"]
_QUOTED = "list_filter(string_split({}, chr(10)), lambda l: trim(l, ' ') LIKE '>%')"
register("e03_quote_share", lambda s, d: documents(s, d, MAILS).select("doc_id", text.quote_share(F.col("x")).alias("pct")), _documents(MAILS) + f"SELECT doc_id, round(len({_QUOTED.format('x')}) * 100 / len(string_split(x, chr(10))), 4)::DOUBLE AS pct FROM t")
ANSWERED = [*MAILS, "top\nOn Mon, A wrote:\n> q\n\nFrom: b@c\nanswer below {}", "a\n\n\n\n> q\n{}\n\n\n\nb", "> {}\nTo: x\n\n"]
register("e02_unquoted", lambda s, d: extraction.unquoted(documents(s, d, ANSWERED).select(F.col("doc_id").alias("text_id"), F.col("x").alias("text"))).select(F.col("text_id").alias("doc_id"), F.md5("text").alias("digest")), _documents(ANSWERED) + rf"""
, i AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS k FROM t),
q AS (SELECT *, regexp_matches(trim(l, ' '), '(?i){extraction.QUOTE_LINE}') AS q, trim(l, ' ') = '' OR regexp_matches(trim(l, ' '), '(?i)^(from|to|cc|bcc|subject|date|sent):\s*.+$') AS soft FROM i),
r AS (SELECT *, q OR soft AND coalesce((SELECT arg_max(o.q, o.k) FROM q o WHERE o.doc_id = q.doc_id AND o.k < q.k AND (o.q OR NOT o.soft)), false) AS gone FROM q),
g AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT gone), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS y, bool_or(gone) AS cut FROM r GROUP BY 1)
SELECT doc_id, md5(CASE WHEN cut THEN y ELSE x END) AS digest FROM t LEFT JOIN g USING (doc_id)""")
SIGNED = ["{}\n-- \nJane\nCEO", "Hi {}\nall good\nBest regards,\nJohn", "{}", "Thanks,\n{}", "a\nCheers\n1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n11", "--\n{}", "", None, "{}\nthank you\n\nX\nsincerely,"]
register("e04_unsigned", lambda s, d: documents(s, d, SIGNED).select("doc_id", F.md5(text.unsigned(F.col("x"))).alias("digest")), _documents(SIGNED) + r"""
, l AS (SELECT doc_id, string_split(regexp_replace(x, '(?m)^-- ?$(?s:.*)', ''), chr(10)) AS l FROM t),
c AS (SELECT doc_id, l, list_min(list_filter(range(1, len(l) + 1), lambda i: i > len(l) - 10 AND regexp_matches(lower(trim(l[i], ' ')), '^(best|kind|warm)? ?(regards|wishes),?$|^(thanks|cheers|sincerely|thank you),?$'))) AS k FROM l)
SELECT doc_id, md5(trim(array_to_string(CASE WHEN k IS NULL THEN l ELSE l[1:k - 1] END, chr(10)), ' ')) AS digest FROM c""")

KEYS = ["the", "und", "para", "quote", "license", "password", "les"]
register("e10_keywords", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text"), KEYS), ",").alias("found")), "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in KEYS) + ") AS found FROM documents")
register("e12_first_keyword", lambda s, d: table(s, d, "documents").groupBy(F.coalesce(F.get(text.keywords(F.col("text"), KEYS[2:]), F.lit(0)), F.lit("none")).alias("kind")).agg(F.count("*").alias("n")), "SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{k}'" for k in KEYS[2:]) + " ELSE 'none' END AS kind, count(*) AS n FROM documents GROUP BY 1")
register("e34_stage_hints", lambda s, d: table(s, d, "documents").groupBy(text.stage_hint(F.col("text")).alias("hint")).agg(F.count("*").alias("n")), "SELECT CASE WHEN lower(text) LIKE '%po%' THEN 'po_in_progress' WHEN lower(text) LIKE '%rfq%' OR lower(text) LIKE '%quote%' THEN 'quote' WHEN lower(text) LIKE '%integration%' THEN 'integration' WHEN lower(text) LIKE '%research%' THEN 'research' ELSE 'unknown' END AS hint, count(*) AS n FROM documents GROUP BY 1")
GARBLED = ["{}", "{}\ufffd\ufffd", "\ufffd" * 70 + "{}", "{}" + "\x01" * 40, "ééé", "{}\x0b\x0c", "", None]
_COUNT = "(length(x) - length(regexp_replace(x, '{0}', '', 'g')))"
register("e40_text_quality", lambda s, d: documents(s, d, GARBLED).select("doc_id", F.round(text.quality_score(F.col("x")), 6).alias("score")), _documents(GARBLED) + rf"""
, c AS (SELECT doc_id, x, greatest(length(x), 1) AS n, {_COUNT.format('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} / greatest(length(x), 1) AS f FROM t)
SELECT doc_id, round(greatest(0, least(1, (1.0::DOUBLE - least(0.5::DOUBLE, {_COUNT.format(chr(92) + 'x{FFFD}')} * 0.01::DOUBLE) - least(0.3::DOUBLE, {_COUNT.format('[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B' + chr(92) + 'x0C' + chr(92) + 'x0E-' + chr(92) + 'x1F]')} * 0.01::DOUBLE))
 * (0.5 + {_COUNT.format("[a-zA-Z0-9" + chr(92) + "s" + chr(92) + "x0B.,!?;:''" + chr(34) + "()-]")} / n * 0.5) - CASE WHEN f > 0.3 THEN (f - 0.3) * 0.5 ELSE 0 END)), 6)::DOUBLE AS score FROM c""")
_MONEY = r"\$([0-9][0-9,]*(?:\.[0-9]+)?[KMBkmb]?)"
register("e13_money", lambda s, d: turns(s, d).select("conv_id", "turn", F.explode(F.regexp_extract_all("x", F.lit(_MONEY), F.lit(1))).alias("amount")), _TURNS + f" SELECT conv_id, turn, unnest(regexp_extract_all(x, '{_MONEY}', 1)) AS amount FROM t")


def e19(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("root_role"), F.countDistinct("role").alias("participants"))


register("e19_thread_rollup", e19, "SELECT conv_id, count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(role, turn) AS root_role, count(DISTINCT role) AS participants FROM conversations GROUP BY 1")


def w04(s: SparkSession, d: str) -> DataFrame:
    """Turns of one speaker in a row are one utterance."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("new", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1)))
    return c.withColumn("utterance", F.sum("new").over(w)).groupBy("conv_id", "utterance").agg(F.first("role").alias("role"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


register("w04_utterances", w04, """
WITH n AS (SELECT *, coalesce((lag(role) OVER w <> role)::INT, 1) AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), u AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS utterance FROM n)
SELECT conv_id, CAST(utterance AS BIGINT) AS utterance, any_value(role) AS role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM u GROUP BY 1, 2""")


def e37(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "conversations").select("conv_id", F.explode(F.split("text", r"[.!?]+")).alias("x")).withColumn("x", F.trim("x")).where("x <> ''")
    return t.groupBy("conv_id").agg(F.count("*").alias("sentences"), F.max(F.length("x")).alias("longest"))


register("e37_sentences", e37, "WITH t AS (SELECT conv_id, trim(unnest(string_split_regex(text, '[.!?]+')), ' ') AS x FROM conversations) SELECT conv_id, count(*) AS sentences, CAST(max(length(x)) AS INT) AS longest FROM t WHERE x <> '' GROUP BY 1")

# ---------------------------------------------------------------- opportunities


def o02(s: SparkSession, d: str) -> DataFrame:
    actors = deal_vendors(s, d).groupBy(F.col("deal_id").alias("id")).agg(F.collect_set("vendor_id").alias("actors"))
    r = deals(s, d).withColumn("key", F.concat_ws(":", F.col("customer_id").cast("string"), "product_type")).join(actors, "id")
    return opportunity.correlate(r, "key", "actors")


register("o02_correlate", o02, SQL + """
, r AS (SELECT concat_ws(':', customer_id, product_type) AS key, id, stage FROM deals WHERE vendor_id IS NOT NULL), g AS (SELECT key, count(*) AS members, min(list_position(['po_in_progress', 'quote', 'rfq'], stage)) AS rank FROM r GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT key, max(n) AS most FROM (SELECT key, stage, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1), a AS (SELECT key, dv.vendor_id, count(*) AS n FROM r JOIN deal_vendors dv ON dv.deal_id = r.id GROUP BY 1, 2),
c AS (SELECT key, count(*) AS c FROM a JOIN g USING (key) WHERE n = members GROUP BY 1)
SELECT key, members, ['po_in_progress', 'quote', 'rfq'][rank] AS stage, round(most / members, 6)::DOUBLE AS stage_confidence, coalesce(c, 0) AS common_actors, round(0.5::DOUBLE + 0.3::DOUBLE * least(coalesce(c, 0) / 3, 1) + 0.2::DOUBLE * (most / members), 3)::DOUBLE AS score FROM g JOIN s USING (key) LEFT JOIN c USING (key)""")
register("o05_consolidate", lambda s, d: opportunity.consolidate(deals(s, d), "customer_id", ("stage", "priority")), SQL + """
SELECT customer_id, count(*) AS members, CASE WHEN count(DISTINCT stage) > 1 THEN array_to_string(list_sort(list(DISTINCT stage)), ';') ELSE '' END AS stage_conflicts, CASE WHEN count(DISTINCT priority) > 1 THEN array_to_string(list_sort(list(DISTINCT priority)), ';') ELSE '' END AS priority_conflicts FROM deals GROUP BY 1""")
ALIASES = ["PO", "purchase_order", "rollout", "Discovery", "{}", "??", None, " quote "]
register("o01_stage_alias", lambda s, d: deals(s, d).select("id", opportunity.stage_alias(written(F.col("stage"), F.col("id"), ALIASES)).alias("stage")), SQL + f"""
, t AS (SELECT id, lower(trim({written_sql('stage', 'id', ALIASES)})) AS x FROM deals)
SELECT id, CASE WHEN x IN ('po', 'purchase_order', 'po_in_progress') THEN 'po_in_progress' WHEN x IN ('deploy', 'rollout', 'integration') THEN 'integration' WHEN x IN ('discovery', 'research') THEN 'research' WHEN x IN ('quote', 'rfq') THEN x ELSE 'unknown' END AS stage FROM t""")
register("f30_record_ids", lambda s, d: deals(s, d).select("id", opportunity.record_id(F.col("customer_name"), F.col("deal_name")).alias("rid")), SQL + "SELECT id, sha1(concat_ws('|', customer_name, deal_name))[1:12] AS rid FROM deals")
register("o06_overrides", lambda s, d: opportunity.override(deals(s, d).select("id", "stage", "priority"), deals(s, d).where("id % 10 = 0").select("id", F.lit("integration").alias("stage")), ("stage",)), SQL + "SELECT id, CASE WHEN id % 10 = 0 THEN 'integration' ELSE stage END AS stage, priority FROM deals")


def o07(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "supplier").select(F.col("s_suppkey").alias("insight_id"), F.when(F.col("s_suppkey") > 1, F.col("s_suppkey")).alias("vendor_id"), (F.col("s_suppkey") % 3 / 3 + 0.5).alias("confidence"))
    return opportunity.applicable(i, deals(s, d))


register("o07_insights", o07, SQL + ", i AS (SELECT s_suppkey AS insight_id, CASE WHEN s_suppkey > 1 THEN s_suppkey END AS vendor_id, s_suppkey % 3 / 3 + 0.5 AS confidence FROM supplier) SELECT id, insight_id FROM deals d JOIN i ON i.confidence >= 0.8 AND (i.vendor_id IS NULL OR i.vendor_id = d.vendor_id)")
