"""File sources (S02-S31) and sinks (K01-K05): CSV, mbox, transcripts, JSON and folders."""

from __future__ import annotations

import email
import email.policy
import itertools
import re
from collections.abc import Iterator, Sequence
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.functions.workers import ship

# Header signatures by format.
SIGNATURES = {
    "hubspot": ("Deal Name", "Deal Stage", "Pipeline", "Close Date", "Amount", "Deal Owner"),
    "salesforce": ("Opportunity ID", "Opportunity Name", "Account Name", "Stage", "Close Date", "Probability"),
    "zoho": ("Deal Name", "Account Name", "Closing Date", "Amount", "Stage", "Expected Revenue"),
    "generic_deal": ("Vendor Name", "Deal Name", "Deal Value", "Currency", "Customer Name", "Registration Date"),
}
COLUMN_SYNONYMS = {
    "deal_name": ("Deal Name", "Opportunity Name", "Name"), "customer_name": ("Company Name", "Account Name", "Customer Name", "Customer", "Company"),
    "deal_value": ("Amount", "Deal Value", "Value", "Expected Revenue"), "stage": ("Deal Stage", "Stage", "Status"), "close_date": ("Close Date", "Closing Date", "Expected Close"),
    "owner": ("Deal Owner", "Owner"), "vendor_name": ("Vendor Name", "Vendor"), "contact_email": ("Contact Email", "Email"),
}


def clean_header(name: str) -> str:
    return name.replace("﻿", "").strip().strip('"').strip()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under cleaned names, no schema inference over the data."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[clean_header(c) for c in df.columns])


def detect_format(columns: Sequence[str]) -> tuple[str, float]:
    """The format whose signature fits best (a partial hit counts half), above one half; else generic."""
    names = [c.lower() for c in map(clean_header, columns)]
    if any(c.startswith("vendors ") for c in names) and any(c.startswith("deals ") for c in names):
        return "deals_with_vendors", 0.95
    best = ("generic", 0.0)
    for kind, signature in SIGNATURES.items():
        hits = 0.0
        for wanted in map(str.lower, signature):
            hits += 1.0 if wanted in names else 0.5 if any(wanted in c or c in wanted for c in names) else 0.0
        if hits / len(signature) > max(best[1], 0.5):
            best = (kind, hits / len(signature))
    return best


def first_filled(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the aliases that the table has and that is not blank."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{have[n.lower()]}`")), F.lit("")) for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def deals_from_csv(df: DataFrame) -> DataFrame:
    """A CRM export as deals, whatever its headers are called."""
    out = df.select(*[first_filled(df, names).alias(k) for k, names in COLUMN_SYNONYMS.items()])
    value = F.regexp_replace("deal_value", r"[^0-9.\-]", "")
    return out.withColumn("deal_value", F.nullif(value, F.lit("")).try_cast("double")).withColumn("close_date", F.coalesce(F.try_to_date("close_date", "yyyy-MM-dd"), F.try_to_date("close_date", "M/d/yyyy")))


def vendor_from_file_name(path: Column) -> Column:
    """`X - Deals.xlsx`, `X_deals.csv` and the like."""
    name = F.regexp_extract(path, r"([^/]+)\.[A-Za-z0-9]+$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)[\s_-]*(deals?|registrations?|pipeline|vendors?)\s*$", ""), "_", " "))


_BREAK = "\nFrom "


def opens_message(line: str, after_blank: bool) -> bool:
    """A line that starts a message of a mail folder: `From ` with three words, a year and a time, or with any second word after an empty line."""
    words = line.split(" ")
    if not line.startswith("From "):
        return False
    if len(words) >= 3 and re.search(r"[0-9]{4}", line) and re.search(r"[0-9]{1,2}:[0-9]{2}", line):
        return True
    return after_blank and len(words) >= 2 and words[1].strip() != ""


def _splice(pieces: Iterator[tuple[str, int, str]]) -> Iterator[tuple]:
    """(file, block, k, head, tail, opens, blank, message) of the pieces between line breaks that `From ` follows, in order: the messages of each block (a split of a file). Whether a
    block's first piece opens a message may depend on the block before: then `opens` is null."""
    now, out = None, []

    def flush() -> Iterator[tuple]:
        for k, (opens, parts) in enumerate(out):
            text = "".join(parts)
            yield (*now, k, k == 0, k == len(out) - 1, opens, text.rsplit("\n", 1)[-1].strip() == "", text)

    for file, block, piece in pieces:
        if (file, block) != now:
            yield from flush()
            now, out = (file, block), []
            line = piece.split("\n", 1)[0].rstrip("\r")
            if block == 0:
                out.append((opens_message(line, False), [piece]))
            else:
                line = "From " + line
                out.append((True if opens_message(line, False) else None if opens_message(line, True) else False, ["From " + piece]))
            continue
        line = "From " + piece.split("\n", 1)[0].rstrip("\r")
        before = out[-1][1][-1]
        if opens_message(line, before.rsplit("\n", 1)[-1].strip() == ""):
            out.append((True, ["From " + piece]))
        else:
            out[-1][1].append(_BREAK + piece)
    yield from flush()


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(file, message) of mail folders, each message from its `From ` line on. The reader splits large files at any break before `From `, and gives the pieces of a
    split in order; each task splices those that no message starts with to the ones before. Only the first and the last message of each split meet again, in the order of the splits, as a
    message may go on over a split's end. What stands before a file's first message is no message."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "block", "k", "head", "tail", "opens", "blank", "message"]
        rows = _splice((f, b, v) for pdf in batches for f, b, v in zip(pdf["file"], pdf["block"], pdf["value"], strict=True))
        while chunk := list(itertools.islice(rows, 500)):
            yield pd.DataFrame(chunk, columns=names).astype({"opens": "object"})

    pieces = spark.read.text(path, lineSep=_BREAK).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ship(spark)
    rows = pieces.mapInPandas(run, "file string, block bigint, k int, head boolean, tail boolean, opens boolean, blank boolean, message string")
    inner = rows.where("not head and not tail").select("file", "message")
    w = Window.partitionBy("file").orderBy("block", "k")
    edges = rows.where("head or tail").withColumn("opens", F.coalesce("opens", F.lag("blank").over(w), F.lit(False)))
    joined = edges.withColumn("_m", F.sum(F.col("opens").cast("int")).over(w)).where("_m > 0").groupBy("file", "_m").agg(F.array_sort(F.collect_list(F.struct("block", "k", "message"))).alias("ps"))
    return inner.unionByName(joined.select("file", F.array_join(F.transform("ps", lambda p: p["message"]), "\n").alias("message")))


HEADER = "message_id string, sender string, recipients array<string>, subject string, date string, in_reply_to string, refs array<string>, labels array<string>, body string, html string, attachments int"


def parse_messages(messages: DataFrame) -> DataFrame:
    """MIME messages as rows; a malformed one gives what could be read."""
    names = [c.split()[0] for c in HEADER.split(", ")]

    def one(raw: str) -> tuple:
        first, _, rest = raw.partition("\n")
        m = email.message_from_string(rest if ":" not in first.split(" ")[0] else raw, policy=email.policy.default)
        plain, html, files = None, None, 0
        for part in m.walk():
            if part.is_multipart():
                continue
            if part.get_content_disposition() == "attachment":
                files += 1
            elif part.get_content_type() in ("text/plain", "text/html"):
                try:
                    content = part.get_content()
                except (LookupError, ValueError):
                    content = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
                if part.get_content_type() == "text/plain":
                    plain = plain or content
                else:
                    html = html or content

        def ids(name: str) -> list[str]:
            return [x.strip("<>") for x in str(m.get(name, "")).split()]

        def people(name: str) -> list[str]:
            return [a.lower() for _, a in getaddresses([str(x) for x in m.get_all(name, [])]) if a]

        return ((ids("Message-ID") or [None])[0], (people("From") or [None])[0], people("To") + people("Cc"), m.get("Subject"), m.get("Date"), (ids("In-Reply-To") or [None])[0], ids("References"),
                [x.strip() for x in str(m.get("X-Gmail-Labels", "")).split(",") if x.strip()], (plain or html or "").strip(), html, files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(x) for x in pdf["message"]], columns=names)

    return messages.select("message").mapInPandas(run, HEADER)


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """(file, cue, start, stop, speaker, text), seconds; speakers by voice tags or `Name:`."""
    def seconds(part: Column) -> Column:
        p = F.split(part, ":")
        return F.aggregate(p, F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))

    blocks = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n\s*\n")).alias("cue", "block"))
    cues = blocks.where(F.contains("block", F.lit("-->")))
    span = F.regexp_extract("block", r"([0-9:.]+)\s+-->\s+([0-9:.]+)", 1), F.regexp_extract("block", r"([0-9:.]+)\s+-->\s+([0-9:.]+)", 2)
    body = F.trim(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n", ""))
    voice, named = F.regexp_extract(body, r"^<v ([^>]+)>", 1), F.regexp_extract(body, r"^([^:\n]{1,49}):\s", 1)
    speaker = F.when(voice != "", voice).when(named != "", named)
    return cues.select("file", "cue", seconds(span[0]).alias("start"), seconds(span[1]).alias("stop"), speaker.alias("speaker"),
                       F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"^<v [^>]+>|</v>", ""), r"^[^:\n]{1,49}:\s", ""), r"^\s+|\s+$", "").alias("text"))


def speaker_turns(text: Column) -> Column:
    """(pos, at, speaker, text) structs of `[hh:mm:ss] Name: text` and `Name: text` lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^(\[[0-9:]+\]\s*)?[A-Z][\w .'-]{0,48}:\s"))
    return F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.nullif(F.regexp_extract(x, r"^\[([0-9:]+)\]", 1), F.lit("")).alias("at"),
                                                   F.regexp_extract(x, r"^(?:\[[0-9:]+\]\s*)?([^:\[\]]+):\s", 1).alias("speaker"), F.trim(F.regexp_extract(x, r"^(?:\[[0-9:]+\]\s*)?[^:\[\]]+:\s(.*)$", 1)).alias("text")))


def json_turns(body: Column) -> Column:
    """Turns under `transcript` or `segments`, with the keys' usual variants."""
    kind = "array<struct<speaker:string,name:string,text:string,content:string,start:double,timestamp:double>>"
    found = F.coalesce(*[F.from_json(F.get_json_object(body, f"$.{k}"), kind) for k in ("transcript", "segments")])
    return F.transform(found, lambda x, i: F.struct(i.alias("pos"), F.coalesce(x["start"], x["timestamp"]).alias("at"), F.coalesce(x["speaker"], x["name"], F.lit("Unknown")).alias("speaker"), F.coalesce(x["text"], x["content"]).alias("text")))


def scan_folder(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """Files with size, time and checksum, found recursively."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    out = files.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"), F.md5("content").alias("checksum"))
    return out if most is None else out.orderBy("path").limit(most)


def file_kind(path: Column) -> Column:
    """What reads a file, by its name."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (F.when(ext.isin("mbox", "eml"), "mail").when(ext.isin("csv", "tsv"), "table").when(ext.isin("xlsx", "xls"), "spreadsheet").when(ext == "vtt", "transcript")
            .when(ext.isin("pdf", "docx", "txt"), "document").when(ext.isin("json", "jsonl"), "json").otherwise("unknown"))


def file_name_parts(name: Column) -> Column:
    """(source, date, description) of `source_YYYY-MM-DD_description.ext`."""
    pattern = r"^([A-Za-z0-9-]+)_(\d{4}-\d{2}-\d{2})_(.+)\.[A-Za-z0-9]+$"
    return F.struct(*[F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).alias(n) for k, n in ((1, "source"), (2, "date"), (3, "description"))])


def vendor_rows(table: DataFrame) -> DataFrame:
    """Vendors of an import with their domains, once per normalised name."""
    from dealgraph.functions.normalize import vendor_key

    name = first_filled(table, ("Vendor Name", "Vendor", "Company"))
    domains = F.filter(F.transform(F.split(F.coalesce(first_filled(table, ("Domains", "Domain", "Website", "Email")), F.lit("")), "[,;]"), lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^.*@|^https?://", ""), r"^www\.|/.*$", "")), lambda x: x != "")
    rows = table.select(name.alias("vendor_name"), domains.alias("domains")).where("vendor_name is not null").withColumn("key", vendor_key(F.col("vendor_name")))
    return rows.groupBy("key").agg(F.min("vendor_name").alias("vendor_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("domains"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; lists are joined with semicolons."""
    cols = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Csv, json or parquet."""
    if kind == "csv":
        write_csv(df, path)
    elif kind in ("json", "parquet", "orc"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown format {kind}")
