"""Secret scans with a trigram inverted index. DataFrame operations only.

From each rule's regex a Boolean trigram query is derived: an OR of ANDs of trigrams that every
match must contain. The index holds postings (trigram, id) of all texts' overlapping trigrams, as far
as some rule asks for them; a rule's candidates are the ids whose postings fill one of its ANDs. Only candidates
are verified, with the rule's regex over the whole text. A rule without mandatory trigrams (a run
of hexadecimal digits) scans every text.

Kinds in order: assign, access, hex (base), then github, slack, private_key and jwt (added).

Defined results: a null or empty text has no span; matches of a kind are leftmost and do not
overlap, those of different kinds may; offsets count code points, the end is exclusive; repeated
rows each get their result; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.llm.common import BROADCAST_IDS, cut, stored, table

#: kind: (regex, group whose length counts, least length). Java, Python and RE2 read them alike.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
}
BASE = ("assign", "access", "hex")
#: The same regex with the least length put in, where leftmost matches stay the same: every match
#: of these is a maximal run, so that a longer run can't start inside a failed one.
TIGHT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Strings of one stretch that are followed up apart; beyond, the stretch ends.
MOST_STRINGS = 16


def _pieces(tree) -> list[set[str] | None]:
    """A regex as a row of sets of possible strings; None where anything may stand."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append({chr(arg)})
        elif op is sre.IN and len(arg) <= MOST_STRINGS and all(k is sre.LITERAL for k, _ in arg):
            out.append({chr(c) for _, c in arg})
        elif op is sre.SUBPATTERN:
            out += _pieces(arg[3])
        elif op is sre.BRANCH:
            ways = [_strings(_pieces(b)) for b in arg[1]]
            out.append(set().union(*ways) if all(w is not None for w in ways) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and (inner := _strings(_pieces(arg[2]))) is not None:
            out.append(inner | {""})
        else:  # a repeated class and the like: what stands next to it is not known
            out.append(None)
    return out


def _strings(pieces: list[set[str] | None]) -> set[str] | None:
    """All strings of the pieces together, if they are few."""
    if any(p is None for p in pieces):
        return None
    n = reduce(lambda a, b: a * b, (len(p) for p in pieces), 1)
    return {"".join(x) for x in product(*pieces)} if n <= MOST_STRINGS else None


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that hold for every match; empty if there are none."""
    stretches, run = [], []
    for piece in [*_pieces(sre_parser.parse(regex)), None]:
        if piece is None or (run and _strings([*run, piece]) is None):
            if run:
                stretches.append(_strings(run))
            run = [] if piece is None else [piece]
        else:
            run.append(piece)
    query = [frozenset()]
    for strings in stretches:
        grams = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings}
        if all(grams):  # else a string of under three characters may match: nothing is mandatory
            query = list({a | b for a in query for b in grams})
    query = sorted(set(query), key=sorted)
    return [] if query == [frozenset()] else [q for q in query if not any(o < q for o in query)]


#: Characters of a piece of text whose trigrams are posted together (two more overlap with the next).
PIECE = 20_000
SPANS = "array<struct<start:int,kind:int,stop:int>>"


def build_index(docs: DataFrame, queries: dict[str, list[frozenset[str]]], doc_id: str, text: str) -> DataFrame:
    """Postings (trigram, id), written to the shared folder: the texts' trigrams, overlapping, in pieces of
    bounded length, as far as any rule asks for them."""
    grams = F.array(*[F.lit(g) for g in sorted({g for q in queries.values() for clause in q for g in clause})])
    cutter = F.lit("(?s)(.{1,%d})(?=(.{0,2}))" % PIECE)
    low = docs.select(F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("_t"))
    pieces = low.select("id", F.explode(F.arrays_zip(F.regexp_extract_all("_t", cutter, F.lit(1)).alias("a"), F.regexp_extract_all("_t", cutter, F.lit(2)).alias("b"))).alias("_p"))
    found = F.array_intersect(F.regexp_extract_all(F.concat("_p.a", "_p.b"), F.lit("(?s)(?=(...))"), F.lit(1)), grams)
    return cut(pieces.select(F.explode(found).alias("trigram"), "id").distinct())


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, rules): the ids whose postings fill a clause of a rule."""
    wanted = [F.struct(F.lit(rule).alias("rule"), F.lit(n).alias("clause"), F.lit(g).alias("trigram"), F.lit(1 << k).cast("long").alias("bit"), F.lit((1 << len(clause)) - 1).cast("long").alias("full"))
              for rule, q in queries.items() for n, clause in enumerate(q) for k, g in enumerate(sorted(clause))]
    clauses = index.sparkSession.range(1).select(F.inline(F.array(*wanted)))
    hit = (index.join(F.broadcast(clauses), "trigram")  # a row per trigram of the fixed rules
           .groupBy("rule", "clause", "id").agg(F.bit_or("bit").alias("got"), F.first("full").alias("full")).where("got = full"))
    return hit.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def matches_of(text: Column, kind: str) -> Column:
    """Array of (kind, g, m, keep) of a rule's matches in a text: the lengths of what stands before the match
    (since the one before it) and of the match, and whether it is long enough."""
    regex, group, least = RULES[kind]
    pattern = F.lit(TIGHT.get(kind, regex))
    matched, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, TIGHT.get(kind, regex), -1)
    counted = F.regexp_extract_all(text, pattern, F.lit(group)) if group else matched
    zipped = F.filter(F.arrays_zip(gaps.alias("g"), matched.alias("m"), counted.alias("c")), lambda x: x["m"].isNotNull())
    return F.transform(zipped, lambda x: F.struct(F.lit(list(RULES).index(kind)).alias("kind"), F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), (F.length(x["c"]) >= least).alias("keep")))


def spans_of(found: DataFrame) -> DataFrame:
    """(id, spans) from rows (id, pos, kind, g, m, keep): positions are running sums over a text's matches of a kind."""
    upto = Window.partitionBy("id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = found.withColumn("stop", F.sum(F.col("g") + F.col("m")).over(upto).cast("int")).where("keep")
    span = F.struct((F.col("stop") - F.col("m")).alias("start"), "kind", "stop")
    return at.groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: spans are (start, kind, stop) structs by start, then kind number. Texts are
    told apart by a digest, so that rows with equal ids stay apart and copies are searched alike."""
    queries = {kind: trigram_query(regex) for kind, (regex, _, _) in RULES.items()}
    body = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.unhex(F.md5(body)).alias("key"))
    rules = cut(candidates(build_index(src, queries, "key", "text"), queries).select(F.col("id").alias("_id"), "rules"))
    joined = src.join(F.broadcast(rules) if rules.count() <= BROADCAST_IDS else rules, F.col("key") == F.col("_id"), "left")
    none = F.array().cast("array<struct<kind:int,g:int,m:int,keep:boolean>>")
    lists = [F.when(F.array_contains("rules", kind) if query else F.rlike("text", F.lit(TIGHT.get(kind, RULES[kind][0]))), matches_of(F.col("text"), kind)).otherwise(none)
             for kind, query in queries.items()]
    rows = cut(joined.select("doc_id", "key", F.concat(*lists).alias("_m")))
    once = rows.where(F.size("_m") > 0).groupBy("key").agg(F.first("_m").alias("_m"))
    spans = stored(spans_of(once.select(F.col("key").alias("id"), F.posexplode("_m").alias("pos", "_x")).select("id", "pos", "_x.*")).select(F.col("id").alias("_key"), "spans"))
    out = rows.select("doc_id", "key").join(spans, F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in RULES])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count_of(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")

    counts = [count_of(k) for k in range(len(BASE))]
    return out.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    rules = []
    for n, (kind, (regex, group, least)) in enumerate(RULES.items()):
        p = "'" + regex.replace("'", "''") + "'"
        rules.append(f"""SELECT doc_id, {n} AS kind, '{kind}' AS name, {least} AS least, m, c, g, i FROM (
  SELECT doc_id, unnest(regexp_extract_all(t, {p})) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS c,
    unnest(list_slice(string_split_regex(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS g, generate_subscripts(regexp_extract_all(t, {p}), 1) AS i FROM d)""")
    one = "name || ':' || start || ':' || (start + length(m))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(rules)}),
s AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS BIGINT) AS start FROM r),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind}" for k, kind in enumerate(BASE))},
  string_agg({one}, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({one}, ',' ORDER BY start, kind) AS spans
  FROM s WHERE length(c) >= least GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


OP10_SQL = _sql()
