"""Sections, quote blocks, threads and people in texts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import scoring
from dealgraph.operators import extraction
from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import SQL, deals, table

LISTED = ["Deal: first\n{}\nCustomer - x\nand more of it, on a line of its own that is long enough\nCLIENT# y\nOpportunity Name : z {}", "no labels {}", "{}\nLead:\nDeal Name: a b\nProject: p\n\nCompany: c of some length, with words, and more words than fifty characters need\ndeal: q", "Opportunity: {}",
          "Customer:\n\n\nDeal: abcde\nPartner: 12345678901234567890123456789012345678901234567890\nLead: 1 2 3 4 5 6 7 8 9 0", "", None]


def texts(s: SparkSession, d: str, forms: list[str | None], name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(s, d, name).select(F.col(key).alias("text_id"), written(F.col("text"), F.col(key), forms).alias("text"))


def texts_sql(forms: list[str | None], recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}t AS (SELECT doc_id AS text_id, {written_sql('text', 'doc_id', forms)} AS text FROM documents)"


_LINES = """
, i AS (SELECT text_id, length(text) AS n, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM t),
l AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY text_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM i),
h AS (""" + " UNION ALL ".join(f"SELECT text_id, n, line, start, {c}::DOUBLE AS confidence FROM l WHERE regexp_matches(x, '(?i)^({'|'.join(words)})\\s*[:#-]')" for _, c, words in extraction.TIERS) + """),
b AS (SELECT text_id, n, start, coalesce(lead(start) OVER w, n)::INT AS "end", confidence, CAST(line + 1 AS INT) AS line, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY text_id ORDER BY start, confidence DESC))"""
register("e22_boundaries", lambda s, d: extraction.boundaries(texts(s, d, LISTED)), texts_sql(LISTED) + _LINES + """ SELECT text_id, start, "end", confidence, line, 'keyword' AS method FROM b""")
_MERGED = _LINES + """
, m AS (SELECT text_id, k, start, "end", confidence, line, 1 AS island FROM b WHERE k = 1
  UNION ALL SELECT b.text_id, b.k, CASE WHEN j AND m.confidence >= b.confidence THEN m.start ELSE b.start END, CASE WHEN j THEN greatest(m."end", b."end") ELSE b."end" END, CASE WHEN j AND m.confidence >= b.confidence THEN m.confidence ELSE b.confidence END,
    CASE WHEN j AND m.confidence >= b.confidence THEN m.line ELSE b.line END, m.island + (NOT j)::INT FROM m JOIN b ON b.text_id = m.text_id AND b.k = m.k + 1, LATERAL (SELECT m."end" > b.start OR abs(m.start - b.start) < 50 AS j)),
g AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY text_id, island ORDER BY k DESC) = 1)"""
register("e23_merged_boundaries", lambda s, d: extraction.merged_boundaries(extraction.boundaries(texts(s, d, LISTED))), texts_sql(LISTED, True) + _MERGED + """ SELECT text_id, start, "end", confidence, line, 'keyword' AS method FROM g""")


def e24(s: SparkSession, d: str) -> DataFrame:
    t = texts(s, d, LISTED)
    return extraction.valid_boundaries(extraction.merged_boundaries(extraction.boundaries(t)), t).drop("method")


register("e24_valid_boundaries", e24, texts_sql(LISTED, True) + _MERGED + """
, v AS (SELECT text_id, start, coalesce(lead(start) OVER (PARTITION BY text_id ORDER BY start), length(text))::INT AS "end", confidence, line, text FROM g JOIN t USING (text_id))
SELECT text_id, start, "end", confidence, line FROM v WHERE "end" - start >= 20 AND regexp_matches(text[start + 1:"end"], '[a-zA-Z]{5,}')""")

MINUTES = ["Attendees:\nAnn\n Bob \nNext steps\nsend it\n- [x] call them\nPricing\n* Send the quote\n5% off\n10 USD\n{}", "{}", "cost is high\n20%\nTODO list\nfirst\n\nparticipants\n{}", "• action: a\n{}\nIn attendance: c\nd\nquote\n7 %", None, ""]
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{p}') THEN '{n}'" for n, p in extraction.SECTIONS) + " END"
register("e35_sections", lambda s, d: extraction.sections(texts(s, d, MINUTES)).select("text_id", "line", "section", F.md5("x").alias("digest")), texts_sql(MINUTES) + rf"""
, i AS (SELECT text_id, unnest(string_split_regex(text, '\r?\n')) AS x, CAST(generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 AS INT) AS line FROM t),
j AS (SELECT text_id, line, trim(x, ' ') AS x FROM i WHERE trim(x, ' ') <> ''), a AS (SELECT *, regexp_matches(x, '(?i){extraction.ACTION_LINE}') AS acts FROM j),
l AS (SELECT *, CASE WHEN NOT acts THEN {_LABEL} END AS label FROM a), u AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY line) AS under FROM l),
s AS (SELECT text_id, line, CASE WHEN acts THEN 'action_items' WHEN label IS NOT NULL THEN label WHEN under = 'pricing' AND contains(x, '%') THEN 'margins' ELSE under END AS section, md5(x) AS digest FROM u)
SELECT * FROM s WHERE section IS NOT NULL""")

QUOTED = ["{}\n> a\n>b\n\nFrom: x\nBcc:\n> c\nno\n\n> d", "{}", "> {}\nSubject: y\nend\nOn Monday, A wrote:\nx\n-- Original message --\nBegin forwarded message:", "\n\n> a\n{}\n >b\nTo: z", None, ""]
register("w05_quote_blocks", lambda s, d: extraction.quote_blocks(texts(s, d, QUOTED)), texts_sql(QUOTED) + rf"""
, i AS (SELECT text_id, unnest(string_split(text, chr(10))) AS x, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line FROM t),
q AS (SELECT text_id, line, regexp_matches(trim(x, ' '), '(?i){extraction.QUOTE_LINE}') AS q, trim(x, ' ') = '' OR regexp_matches(trim(x, ' '), '(?i)^(from|to|cc|bcc|subject|date|sent):\s*.+$') AS soft FROM i),
r AS (SELECT *, (SELECT coalesce(max(o.line), -1) FROM q o WHERE o.text_id = q.text_id AND o.line < q.line AND NOT o.q AND NOT o.soft) AS hard FROM q WHERE q OR soft),
f AS (SELECT text_id, hard, min(line) AS first_line FROM r WHERE q GROUP BY 1, 2)
SELECT text_id, first_line, max(line) AS last_line, count(*) FILTER (q) AS quoted FROM r JOIN f USING (text_id, hard) WHERE line >= first_line GROUP BY text_id, hard, first_line""")

SUBJECTS = ["Re: topic {}", "topic {}", "FWD: topic {}", "other {}", ""]


def e18(s: SparkSession, d: str) -> DataFrame:
    """Events as mails: some reply to the one before of their user's, some refer further back, others have a subject alone."""
    k = F.col("event_id")
    m = table(s, d, "events").select(k.alias("id"), F.when(k % 7 == 1, k - 7).when(k % 11 == 3, k + 1_000_000_000).alias("in_reply_to"), F.when(k % 13 == 2, F.array(k - 26, k - 13)).when(k % 2 == 0, F.array().cast("array<bigint>")).alias("refs"),
                                     written((k % 97).cast("string"), k, SUBJECTS).alias("subject"), F.col("ts").alias("at"))
    return extraction.threads(m)


register("e18_threads", e18)
ADDRESSES = ["jane.doe{}@Example.COM", "j_r-smith@gmail.com", "{}@x.org", "info@{}", None, "O.NEIL.42@pm.me", "nobody", "ann  b@sub.acme.co.uk"]


def e38(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "customer").select(F.col("c_custkey").alias("id"), written(F.col("c_custkey").cast("string"), F.col("c_custkey"), ADDRESSES).alias("x"))
    return x.select("id", extraction.person_of(F.col("x")).alias("person"), extraction.company_domain(F.col("x")).alias("domain"))


register("e38_people", e38, rf"""
WITH x AS (SELECT c_custkey AS id, {written_sql('c_custkey::VARCHAR', 'c_custkey', ADDRESSES)} AS x FROM customer),
p AS (SELECT id, lower(x) AS x, list_filter(string_split_regex(regexp_replace(split_part(x, '@', 1), '[._0-9-]', ' ', 'g'), '\s+'), lambda w: w <> '') AS w, nullif(lower(regexp_extract(x, '@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})$', 1)), '') AS domain FROM x)
SELECT id, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda v: upper(v[1]) || lower(v[2:])), ' ') END AS person, CASE WHEN domain NOT IN ({', '.join(f"'{n}'" for n in extraction.PERSONAL_DOMAINS)}) THEN domain END AS domain FROM p""")
CONTEXTS = ["{} is the prime  contractor and partner", "teaming with {}", "Tier 2: {}", "a Distributor {}", "{} channel partner", "{}", "sub contractor, reseller {}"]
register("e39_vendor_roles", lambda s, d: texts(s, d, CONTEXTS).select("text_id", extraction.vendor_role(F.col("text"), F.col("text_id") % 2 == 0).alias("role")), texts_sql(CONTEXTS) + " SELECT text_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in extraction.ROLES) + " WHEN text_id % 2 = 0 THEN 'partner' ELSE 'unknown' END AS role FROM t")
WORDS = ("deal", "quote", "die ", "proposal")
register("e11_relevant", lambda s, d: table(s, d, "documents").select("doc_id", extraction.relevant(F.col("text"), WORDS, F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5 == 0)).alias("relevant")), "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + " OR coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 = 0 END, false) AS relevant FROM documents")


def e32(s: SparkSession, d: str) -> DataFrame:
    score = extraction.transcript_confidence(F.col("id") % 11 / 10, F.col("id") % 20, F.col("id") % 3 > 0, F.col("deal_value") > 100_000)
    return deals(s, d).select("id", F.round(score, 6).alias("score"))


register("e32_transcript_confidence", e32, SQL + """
SELECT id, round(least(1, greatest(0, 0.3::DOUBLE * (id % 11 / 10) + 0.3::DOUBLE * least(id % 20 / 15, 1) + 0.29::DOUBLE - CASE WHEN id % 3 > 0 THEN 0 ELSE 0.25 END::DOUBLE - CASE WHEN deal_value > 100000 THEN 0 ELSE 0.15 END::DOUBLE - CASE WHEN id % 11 < 2 THEN 0.2 ELSE 0 END::DOUBLE)), 6)::DOUBLE AS score FROM deals""")
register("f23_mail_confidence", lambda s, d: deals(s, d).select("id", F.round(scoring.mail_confidence(F.col("id") % 5, F.col("id") % 7, F.col("id") % 13, F.col("id") % 6, F.col("id") % 6 * 0.05), 6).alias("score")), SQL + """
SELECT id, round(least(1, 0.3::DOUBLE * least(1, id % 5 / 3) + 0.15::DOUBLE * least(1, id % 7 / 5) + 0.05::DOUBLE * least(1, id % 13 / 10) + 0.3::DOUBLE * (id % 6) / 5 + least(0.2::DOUBLE, id % 6 * 0.05::DOUBLE)), 6)::DOUBLE AS score FROM deals""")


def e41(s: SparkSession, d: str) -> DataFrame:
    """Extracted deals of some confidence are kept, the others recorded with the reason."""
    c = F.round(F.col("deal_value") / 500_000, 4)
    return deals(s, d).select("id", c.alias("confidence"), (c >= 0.3).alias("kept"), F.when(c < 0.15, "far_below_threshold").when(c < 0.3, "below_threshold").otherwise("").alias("reason"))


register("e41_kept_deals", e41, SQL + """
, c AS (SELECT id, round(deal_value / 500000, 4) AS c FROM deals) SELECT id, c AS confidence, c >= 0.3 AS kept, CASE WHEN c < 0.15 THEN 'far_below_threshold' WHEN c < 0.3 THEN 'below_threshold' ELSE '' END AS reason FROM c""")

# ---------------------------------------------------------------- fields of sections

FORMS = ["Deal: Big one\nCustomer: Globex\nValue: $1,200.50 k\nStatus: Closed Won\nOwner - Ann\nExpected Close Date: 2024-03-05\nProbability: 80%\nContact: Bob\nNotes: first line\n second line\nmore of it\nStage: none\n{}",
         "Opportunity Name: Web {}\nClient: A b c\nAmount# 5M\nPhase: negotiating now\nAssigned to: Zed\nTimeline: Q2 2025\n120 % likely\nDeal-\nLead: next section of the text\nSize: 12\nClosing: March 3, 2024\nState: new",
         "Project: p\nPrice: 77\nRep: someone\nDue Date: 12/31/2024\nConfidence: 30\nDetails: {}", "Customer Name - only a customer and $ 900 \nEnd-User: nobody\nClose: soon\nManager: M. M.", "{}", "Account: {}\nlead: 3) Deal# Acme Widgets Inc\nSummary: s", None]


def e25(s: SparkSession, d: str) -> DataFrame:
    from dealgraph.operators import deal_fields

    t = texts(s, d, FORMS)
    v = extraction.valid_boundaries(extraction.merged_boundaries(extraction.boundaries(t)), t).join(t, "text_id")
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    out = deal_fields.extract(v.select("text_id", "start", part.alias("part"), "confidence"))
    return out.withColumns({c: F.md5(c) for c in ("deal_name", "customer_name", "description")}).withColumn("close_date", F.col("close_date").cast("string"))


def _e25_sql() -> str:
    from dealgraph.operators import deal_fields

    rows = {}
    for name, kind, _, patterns in deal_fields.FIELDS:
        ps = [p.replace("'", "''") for p in patterns]
        if kind == "lines":
            # the same without looking ahead: lines go on until one is empty or opens with a label
            ps = [p.split("([^")[0] + "([^\\n]+)" for p in ps]
            hits = " ".join(f"WHEN regexp_extract(part, '{p}', 1) <> '' THEN part[strpos(part, regexp_extract(part, '{p}')) + length(regexp_extract(part, '{p}')) - length(regexp_extract(part, '{p}', 1)):]" for p in ps)
            rows[name] = f"(SELECT nullif({_T.format(_JOIN)}, '') FROM (SELECT string_split(CASE {hits} END, chr(10)) AS ls) WHERE ls IS NOT NULL)"
            continue
        value = "CASE " + " ".join(f"WHEN regexp_extract(part, '{p}', 1) <> '' THEN regexp_extract(part, '{p}', 1)" for p in ps) + " END"
        if kind == "money":
            unit = "CASE " + " ".join(f"WHEN regexp_extract(part, '{p}', 1) <> '' THEN " + (f"regexp_extract(part, '{p}', 2)" if "([kKmM])" in p else "''") for p in ps) + " END"
            rows[name] = rf"try_cast(nullif(regexp_extract(replace({value}, ',', ''), '^(\d+\.?\d*)', 1), '') AS DOUBLE) * CASE lower({unit}) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END"
        elif kind == "status":
            pairs = ", ".join(f"'{k}': '{v}'" for k, v in deal_fields.STATUSES.items())
            rows[name] = f"coalesce(MAP {{{pairs}}}[lower({_T.format(value)})], nullif({_T.format(value)}, ''))"
        elif kind == "date":
            x = _T.format(value)
            rows[name] = (rf"coalesce(CASE WHEN regexp_matches({x}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN try_strptime({x}, '%Y-%m-%d') WHEN regexp_matches({x}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN try_strptime({x}, '%m/%d/%Y') "
                          rf"ELSE coalesce(try_strptime({x}, '%b %d, %Y'), try_strptime({x}, '%B %d, %Y')) END, CASE WHEN regexp_extract({x}, '(?i)Q([1-4])\s+(\d{{4}})', 1) <> '' THEN make_date(regexp_extract({x}, '(?i)Q([1-4])\s+(\d{{4}})', 2)::INT, regexp_extract({x}, '(?i)Q([1-4])\s+(\d{{4}})', 1)::INT * 3, 30) END)::DATE::VARCHAR")
        elif kind == "percent":
            rows[name] = f"least(100, coalesce(try_cast({value} AS INT), CASE WHEN {value} IS NOT NULL THEN 100 END))"
        else:
            rows[name] = f"nullif({_T.format(value)}, '')"
    boosts = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {b} ELSE 0 END::DOUBLE" for n, _, b, _ in deal_fields.FIELDS)
    count = " + ".join(f"({n} IS NOT NULL)::INT" for n, *_ in deal_fields.FIELDS)
    return texts_sql(FORMS, True) + _MERGED + rf"""
, v AS (SELECT text_id, start, coalesce(lead(start) OVER (PARTITION BY text_id ORDER BY start), length(text))::INT AS "end", confidence, text FROM g JOIN t USING (text_id)),
z AS (SELECT text_id, start, text[start + 1:"end"] AS part, confidence FROM v WHERE "end" - start >= 20 AND regexp_matches(text[start + 1:"end"], '[a-zA-Z]{{5,}}')),
e1 AS (SELECT *, {', '.join(f'{c} AS {n}' for n, c in rows.items())}, {_T.format("regexp_extract(part, '(?m)^[^\\S\\n]*(\\S[^\\n]*)', 1)")} AS line,
  regexp_extract(part, '([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|LLC|Ltd|Co)\.?)', 1) AS company, regexp_extract(part, '(?m)^([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{0,4}})\s*$', 1) AS capitals FROM z),
e2 AS (SELECT *, {_T.format("regexp_replace(regexp_replace(regexp_replace(line, '^[\\d.)\\-•]\\s*', ''), '(?i)^Deal[\\s:#-]*', ''), '(?i)^Opportunity[\\s:#-]*', '')")} AS clean FROM e1),
e3 AS (SELECT *, CASE WHEN length(line) < 100 AND regexp_matches(line, '[a-zA-Z]{{3,}}') AND length(clean) > 2 THEN clean WHEN company <> '' THEN company WHEN capitals <> '' AND length(capitals) < 60 THEN capitals END AS inferred FROM e2)
SELECT text_id, start, md5(coalesce(deal_name, inferred, 'Unknown Deal')) AS deal_name, md5(customer_name) AS customer_name, deal_value, status, owner, close_date, probability, decision_maker, md5(description) AS description,
  ({count} + (deal_name IS NULL AND inferred IS NOT NULL)::INT)::INT AS n_fields, round(least(1, confidence + {boosts}), 6)::DOUBLE AS confidence FROM e3"""


_T = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_JOIN = r"regexp_replace(array_to_string(list_filter(ls, lambda l, i: i = 1 OR i < coalesce(list_position(list_transform(range(2, len(ls) + 1), lambda j: ls[j] = '' OR regexp_matches(array_to_string(ls[j:], chr(10)), '^[A-Za-z]+\s*[:#-]')), true) + 1, len(ls) + 1)), chr(10)), '\n\s+', ' ', 'g')"
register("e25_deal_fields", e25, _e25_sql())
