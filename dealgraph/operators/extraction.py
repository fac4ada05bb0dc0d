"""What texts hold: deal sections, labelled sections, quote blocks, threads of messages, and people behind addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgraph.functions.normalize import subject
from dealgraph.operators.dedupe import clusters

# Labels, patterns and lists that results depend on.
TIERS = (("tier1", 0.95, ("deal", "opportunity", "deal name", "opportunity name")), ("tier2", 0.8, ("account", "customer", "prospect", "lead", "project")), ("tier3", 0.65, ("company", "client", "partner")))
NEAR = 50
SHORTEST = 20
SECTIONS = (("attendees", r"\b(attendees|participants|present|in attendance)\b"), ("action_items", r"\b(next steps?|action items?|todo|follow ups?)\b"), ("pricing", r"\b(pricing|price|cost|quote|rfq|margin)\b"))
ACTION_LINE = r"^[-*•]\s*(?:\[.\]\s*)?(?:action|todo|follow up|send|schedule|call|email|deliver|ping)\b"
QUOTE_LINE = r"^>|^On .+ wrote:|^From:.+Sent:.+To:.+Subject:|^-+\s*Original Message\s*-+|^-+\s*Forwarded message\s*-+|^Begin forwarded message:"
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "mac.com", "protonmail.com", "pm.me")
ROLES = (("primary", r"prime\s+contractor|lead\s+vendor|primary\s+vendor"), ("partner", r"partner|teaming|joint\s+venture|alliance"), ("subcontractor", r"subcontractor|sub\s+contractor|tier\s+2|secondary"), ("reseller", r"reseller|distributor|channel\s+partner"))
SUBJECT_DAYS = 7


def lines_of(texts: DataFrame) -> DataFrame:
    """(text_id, line, start, n, x): the lines of texts (text_id, text), with the offset of their first character."""
    rows = texts.select("text_id", F.length("text").alias("n"), F.posexplode(F.split("text", "\n")).alias("line", "x"))
    before = F.sum(F.length("x") + 1).over(Window.partitionBy("text_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))


def boundaries(texts: DataFrame) -> DataFrame:
    """E22, keyword tiers: (text_id, start, end, confidence, line, method): a line that opens with a label starts a section
    once per tier; it ends where the next one starts, or with the text."""
    lines = lines_of(texts)
    hits = F.array_compact(F.array(*[F.when(F.col("x").rlike(rf"(?i)^(?:{'|'.join(words)})\s*[:#-]"), F.lit(c)) for _, c, words in TIERS]))
    found = lines.select("text_id", "n", "line", "start", F.explode(hits).alias("confidence"))
    w = Window.partitionBy("text_id").orderBy("start", F.desc("confidence"))
    return found.select("text_id", "start", F.coalesce(F.lead("start").over(w), "n").alias("end"), "confidence", (F.col("line") + 1).alias("line"), F.lit("keyword").alias("method"))


def merged_boundaries(found: DataFrame) -> DataFrame:
    """Boundaries that overlap or start within NEAR characters of the one before become one, at the place of the surer;
    different methods add 0.1. A section is compared with what the one before has become, so it is a fold over a text's
    boundaries in order (those of one text at a time)."""
    columns = ["start", "end", "confidence", "line", "method"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for b in pdf.sort_values(["start", "confidence"], ascending=[True, False], kind="stable")[columns].values.tolist():
            now = out[-1] if out else None
            if now is None or not (now[1] > b[0] or abs(now[0] - b[0]) < NEAR):
                out.append(b)
                continue
            end = max(now[1], b[1])
            if b[2] > now[2]:
                now[:] = b
            now[1] = end
            if now[4] != b[4]:
                now[2], now[4] = min(1.0, now[2] + 0.1), "hybrid"
        merged = pd.DataFrame(out, columns=columns)
        merged.insert(0, "text_id", pdf["text_id"].iloc[0])
        return merged

    kind = found.schema["text_id"].dataType.simpleString()
    return found.groupBy("text_id").applyInPandas(fold, f"text_id {kind}, start int, end int, confidence double, line int, method string")


def valid_boundaries(merged: DataFrame, texts: DataFrame) -> DataFrame:
    """Sections that reach to the next one's start or the text's end, of at least SHORTEST characters, with a word of five letters."""
    w = Window.partitionBy("text_id").orderBy("start")
    b = merged.join(texts.select("text_id", "text"), "text_id").withColumn("end", F.coalesce(F.lead("start").over(w), F.length("text")))
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return b.where(F.col("end") - F.col("start") >= SHORTEST).where(part.rlike("[a-zA-Z]{5,}")).select("text_id", "start", "end", "confidence", "line", "method")


def sections(texts: DataFrame, action: str = ACTION_LINE) -> DataFrame:
    """(text_id, line, section, x): lines under the last label seen; lines of an action are action items wherever they
    stand and open no section; percentages under prices are margins."""
    rows = texts.select("text_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "x")).withColumn("x", F.trim("x")).where("x <> ''")
    acts = F.col("x").rlike("(?i)" + action)
    label = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        label = F.when(F.lower("x").rlike(pattern), name).otherwise(label)
    rows = rows.withColumn("label", F.when(~acts, label)).withColumn("acts", acts)
    under = F.last("label", ignorenulls=True).over(Window.partitionBy("text_id").orderBy("line"))
    section = F.when(F.col("acts"), "action_items").when(F.col("label").isNotNull(), F.col("label")).when((under == "pricing") & F.contains("x", F.lit("%")), "margins").otherwise(under)
    return rows.select("text_id", "line", section.alias("section"), "x").where("section is not null")


def quote_blocks(texts: DataFrame) -> DataFrame:
    """(text_id, first_line, last_line, quoted): runs of quoted lines; blank and header lines go on with a run that has
    begun, any other line ends it. Gaps and islands over the ordered lines."""
    rows = texts.select("text_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    quote = F.trim("x").rlike("(?i)" + QUOTE_LINE)
    soft = (F.trim("x") == "") | F.trim("x").rlike(r"(?i)^(from|to|cc|bcc|subject|date|sent):\s*.+$")
    w = Window.partitionBy("text_id").orderBy("line")
    rows = rows.withColumn("q", quote).withColumn("hard", (~quote & ~soft).cast("int")).withColumn("run", F.sum("hard").over(w)).where("hard = 0")
    inside = rows.withColumn("begun", F.max(F.col("q").cast("int")).over(Window.partitionBy("text_id", "run").orderBy("line"))).where("begun = 1")
    return inside.groupBy("text_id", "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count_if("q").alias("quoted")).drop("run")


def unquoted(texts: DataFrame) -> DataFrame:
    """(text_id, text) without the lines of quote blocks, wherever they stand; of what is left, no more than one empty line in a row, and no blanks around it. A
    text without a quote stays as it is; null stays null. Lines of one text meet again in their order."""
    rows = texts.where("text is not null").select("text_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    quote = F.trim("x").rlike("(?i)" + QUOTE_LINE)
    soft = (F.trim("x") == "") | F.trim("x").rlike(r"(?i)^(from|to|cc|bcc|subject|date|sent):\s*.+$")
    so_far = Window.partitionBy("text_id").orderBy("line")
    last = F.max(F.when(quote, F.col("line"))).over(so_far), F.max(F.when(~quote & ~soft, F.col("line"))).over(so_far)
    inside = last[0].isNotNull() & (last[0] > F.coalesce(last[1], F.lit(-1)))
    kept = rows.withColumn("_in", inside).groupBy("text_id").agg(F.max("_in").alias("_any"), F.array_sort(F.collect_list(F.when(~F.col("_in"), F.struct("line", "x")))).alias("ls"))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("ls", lambda l: l["x"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    out = texts.join(kept.where("_any").select("text_id", joined.alias("_t"), "_any"), "text_id", "left")
    return out.select("text_id", F.when(F.col("_any"), F.col("_t")).otherwise(F.col("text")).alias("text"))


def threads(messages: DataFrame, days: int = SUBJECT_DAYS) -> DataFrame:
    """(thread_id, id) of messages (id, in_reply_to, refs, subject, at): connected by replies and references to
    messages that are there, or, where a message has none of these, to the messages of the same plain subject right before and after it, within `days`.
    The order of the messages decides nothing, unlike in a scan that assigns them one by one."""
    messages = messages.withColumn("at", F.col("at").cast("timestamp"))
    known = messages.select(F.col("id").alias("id_1"))
    up = messages.select("id", F.explode(F.array_distinct(F.array_compact(F.array_append(F.coalesce("refs", F.array().cast(messages.schema["refs"].dataType)), F.col("in_reply_to"))))).alias("id_1"))
    replies = up.where("id <> id_1").join(known, "id_1").select(F.least("id", "id_1").alias("id_1"), F.greatest("id", "id_1").alias("id_2"), F.col("id").alias("of"))
    m = messages.select("id", subject(F.col("subject")).alias("s"), "at", F.unix_date(F.to_date("at")).alias("day")).where("s <> ''")
    # neighbours within a subject's day, and over days by each day's first and last message: no task holds a whole subject
    of_day, of_days = Window.partitionBy("s", "day").orderBy("at", "id"), Window.partitionBy("s").orderBy("day")
    ends = m.groupBy("s", "day").agg(F.min(F.struct("at", "id")).alias("first"), F.max(F.struct("at", "id")).alias("last"))
    ends = ends.select("s", "day", F.lag("last").over(of_days).alias("back"), F.lead("first").over(of_days).alias("on"))
    here = F.struct("at", "id")
    by_subject = m.withColumns({"p": F.lag(here).over(of_day), "q": F.lead(here).over(of_day)}).join(ends, ["s", "day"]).withColumns({"p": F.coalesce("p", "back"), "q": F.coalesce("q", "on")})
    by_subject = by_subject.select("id", "at", F.col("p.id").alias("prev"), F.col("p.at").alias("before"), F.col("q.id").alias("next"), F.col("q.at").alias("after"))
    alone = by_subject.join(replies.select(F.col("of").alias("id")).distinct(), "id", "left_anti")
    near = [alone.where(F.col(o).isNotNull() & (F.abs(F.unix_seconds("at") - F.unix_seconds(t)) <= days * 86400)).select(F.least("id", o).alias("id_1"), F.greatest("id", o).alias("id_2")) for o, t in (("prev", "before"), ("next", "after"))]
    found = clusters(replies.select("id_1", "id_2").unionByName(near[0]).unionByName(near[1]))
    return messages.select("id").join(found, "id", "left").select(F.coalesce("cluster_id", "id").alias("thread_id"), "id")


def person_of(address: Column) -> Column:
    """The local part of an address as a name; null if nothing of it is left."""
    local = F.trim(F.regexp_replace(F.regexp_replace(F.split_part(address, F.lit("@"), F.lit(1)), r"[._-]+", " "), r"[0-9]+", " "))
    return F.nullif(F.initcap(F.regexp_replace(local, r"\s+", " ")), F.lit(""))


def company_domain(address: Column) -> Column:
    """The address's domain unless it is one of persons' providers."""
    domain = F.nullif(F.lower(F.regexp_extract(address, r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})$", 1)), F.lit(""))
    return F.when(~domain.isin(*PERSONAL_DOMAINS), domain)


def vendor_role(context: Column, is_vendor: Column) -> Column:
    """The first role that the words around a company name."""
    out = F.when(is_vendor, "partner").otherwise("unknown")
    for name, pattern in reversed(ROLES):
        out = F.when(context.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def relevant(text: Column, words: tuple[str, ...], from_vendor: Column) -> Column:
    """A keyword of the first two tiers, or mail from a vendor's domain."""
    low = F.lower(text)
    has = F.lit(False)
    for w in words:
        has = has | F.contains(low, F.lit(w))
    return has | F.coalesce(from_vendor, F.lit(False))


def transcript_confidence(signals: Column, filled: Column, has_customer: Column, has_value: Column) -> Column:
    """Signals, filled fields of fifteen, and fixed corroboration and entity shares, less what is missing; 0 to 1."""
    score = 0.3 * signals + 0.3 * F.least(filled / 15, F.lit(1.0)) + 0.2 * 0.7 + 0.2 * 0.75
    for bad, cost in ((~has_customer, 0.25), (~has_value, 0.15), (signals < 0.2, 0.20)):
        score = score - F.when(bad, cost).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
