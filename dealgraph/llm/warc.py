"""WARC archives: writing pages as captures, reading records back, and assembling transactions.

Writing: each page becomes a request, a response (or a revisit, where a page with a larger id has the
same payload) and a metadata record, all three in the file of one task; request and metadata name the response in
WARC-Concurrent-To. A record ends with two line breaks, so the text writer with that line separator
writes archives, one gzip file a task; nothing is gathered. Revisits refer to the record of the response.

Reading: the text reader with the same separator gives the pieces of a gzip file in order to one task, which
puts records together by their Content-Length; it holds one record at a time. Bytes are kept as they are.

Assembly: request and metadata records meet their response through the concurrent-to identifiers, in either
direction, and a capture is one nested row. Where a capture has several requests or metadata records, the one
with the smallest record id is nested and all are counted; loose() returns the others, and those without a
capture, so that nothing is lost and no group is gathered. Revisits then get the size and digest of the
payload that they refer to, by a join of narrow rows on the record id; a record with very many revisits is
one row on one side, so Spark splits the other.

Defined results: null HTML is an empty payload; null ids are smaller than all others and written as an absent
field; of rows with equal payloads and equal ids (ties, repeated rows) one is the response; every row has record
ids of its own; control characters of a URL are percent-encoded; an empty table gives an empty archive; a
record cut off at a file's end is returned with `truncated`; other columns are never read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import BROADCAST_IDS, map_arrow, shared_path, stored, table

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
RECORD = ("record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, block_bytes bigint, truncated boolean, "
          "http_status int, payload_bytes bigint, payload_digest string, fields map<string,string>")


# ---------------------------------------------------------------- writing

def _record(kind: Column, rid: Column, date: str, block: Column, content_type: str, **headers: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(name.replace("_", "-") + ": "), value) for name, value in headers.items()]  # a null value leaves its line out
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, date: str | None = None) -> None:
    """Writes the archives of all pages to the folder `path`. date: of all records (by default now)."""
    date, salt = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), uuid.uuid4().hex
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    # written once, so that a row keeps its number
    rows = stored(pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"),
                               F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size")))
    first = stored(rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max(F.struct("page_id", "row"))["row"].alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select("digest", "first"))
    rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_IDS else first, "digest", "left")

    def rid(kind: str, row: str) -> Column:
        return F.regexp_replace(F.md5(F.concat(F.lit(f"{salt}:{kind}:"), F.col(row).cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")

    again = F.col("first").isNotNull() & (F.col("first") != F.col("row"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20\\x7F]", "%20")
    place = F.coalesce(F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END), F.when(again, F.lit("")).otherwise(F.col("body")))
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    answer_id, digest = rid("response", "row"), F.concat(F.lit("sha1:"), F.col("digest"))
    records = F.array(
        _record(F.lit("request"), rid("request", "row"), date, asked, "application/http; msgtype=request", WARC_Target_URI=uri, WARC_Concurrent_To=answer_id),
        _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), answer_id, date, answer, "application/http; msgtype=response", WARC_Target_URI=uri, WARC_Payload_Digest=digest,
                WARC_Profile=F.when(again, F.lit(PROFILE)), WARC_Refers_To=F.when(again, rid("response", "first"))),
        _record(F.lit("metadata"), rid("metadata", "row"), date, about, "application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=answer_id))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).text(path, compression="gzip")


# ---------------------------------------------------------------- reading

def _fields(lines: str) -> list[tuple[str, str]]:
    """Named fields; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse_record(head: bytes, block: bytes, truncated: bool) -> dict:
    names: dict[str, list[str]] = {}
    for name, value in _fields(head.decode("utf-8", "replace")):
        names.setdefault(name.lower(), []).append(value)

    def one(name: str) -> str | None:
        return names.get(name, [None])[0]

    kind, content = one("warc-type"), (one("content-type") or "").lower()
    status, payload, fields = None, block, None
    if content.startswith("application/http"):
        top, _, payload = block.partition(END.encode())
        word = top.split(b"\r\n", 1)[0].split()
        status = int(word[1]) if kind != "request" and len(word) > 1 and word[1].isdigit() else None
    elif content.startswith("application/warc-fields"):
        fields = list(dict(_fields(block.decode("utf-8", "replace"))).items())
    return {"record_id": one("warc-record-id"), "type": kind, "date": one("warc-date"), "target_uri": one("warc-target-uri"), "concurrent_to": names.get("warc-concurrent-to"), "refers_to": one("warc-refers-to"),
            "block_bytes": len(block), "truncated": truncated, "http_status": status, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "fields": fields, "payload": payload}


class Splicer:
    """Records of one archive from its pieces between double line breaks."""

    def __init__(self):
        self.head, self.parts, self.have, self.need = None, [], 0, 0

    def push(self, piece: bytes) -> Iterator[dict]:
        if self.head is None:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                return
            size = next((v for k, v in _fields(piece.decode("utf-8", "replace")) if k.lower() == "content-length"), "0")
            self.head, self.parts, self.have, self.need = piece, [], 0, int(size) if size.isdigit() else 0
            if not self.need:
                yield self.take(b"", False)
            return
        if self.parts:
            self.parts.append(END.encode())
            self.have += len(END)
        self.parts.append(piece)
        self.have += len(piece)
        if self.have >= self.need:
            whole = b"".join(self.parts)
            rest = whole[self.need:]
            yield self.take(whole[: self.need], False)
            yield from self.push(rest)

    def take(self, block: bytes, truncated: bool) -> dict:
        record = parse_record(self.head, block, truncated)
        self.head, self.parts, self.have = None, [], 0
        return record

    def end(self) -> Iterator[dict]:
        if self.head is not None:
            yield self.take(b"".join(self.parts), True)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all gzip archives in the folder `path`, as RECORD; with `payloads`, each with its payload (the block
    without HTTP headers). Digests and sizes are computed from what is read."""
    kinds = [("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("block_bytes", pa.int64()),
             ("truncated", pa.bool_()), ("http_status", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))] + [("payload", pa.binary())] * payloads

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in kinds], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, splicer, found, held = None, Splicer(), [], 0
        for batch in batches:
            for value, name, start in zip(*(batch.column(k) for k in range(3)), strict=True):
                if start.as_py():
                    raise ValueError(f"{name.as_py()} is read in parts: archives must be compressed with gzip")
                if name.as_py() != file:
                    found += splicer.end()
                    file, splicer = name.as_py(), Splicer()
                for record in splicer.push(value.as_py()):
                    found.append(record)
                    held += record["payload_bytes"]
                    if not payloads:
                        record["payload"] = None
                    if len(found) >= 2_000 or held >= 16_000_000:
                        yield rows(found)
                        found, held = [], 0
        found += splicer.end()
        if found:
            yield rows(found)

    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")
    return map_arrow(pieces, run, RECORD + ", payload binary" * payloads)


# ---------------------------------------------------------------- transactions

def _sides(records: DataFrame) -> DataFrame:
    return records.where(~F.col("type").isin(*CAPTURES, "warcinfo"))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture (response, revisit, resource): its columns, then `request` and `metadata` (structs, null where there is
    none) and how many there are of each. Records are linked by WARC-Concurrent-To of either side."""
    sides, found = _sides(records), records.where(F.col("type").isin(*CAPTURES))
    own = sides.select("*", F.explode("concurrent_to").alias("capture_id"))
    back = found.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")).join(sides, "record_id")
    linked = own.unionByName(back).dropDuplicates(["record_id", "capture_id"])
    inner = F.struct("record_id", "date", "target_uri", "fields", "payload_bytes", "payload_digest", *(["payload"] if "payload" in records.columns else []))

    def smallest(kind: str) -> list[Column]:
        return [F.min_by(inner, F.when(F.col("type") == kind, F.col("record_id"))).alias(kind), F.count_if(F.col("type") == kind).alias(f"n_{kind}")]

    nested = linked.groupBy("capture_id").agg(*smallest("request"), *smallest("metadata"))
    nested = nested.select(F.col("capture_id").alias("record_id"), F.when(F.col("n_request") > 0, F.col("request")).alias("request"), F.when(F.col("n_metadata") > 0, F.col("metadata")).alias("metadata"), "n_request", "n_metadata")
    return found.join(nested, "record_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_request", "n_metadata")})


def loose(records: DataFrame, assembled: DataFrame) -> DataFrame:
    """The records that no row of captures() holds."""
    held = assembled.select(F.explode(F.array("record_id", "request.record_id", "metadata.record_id")).alias("record_id")).where("record_id is not null").distinct()
    return records.join(held, "record_id", "left_anti")


def with_targets(assembled: DataFrame) -> DataFrame:
    """Captures (a table, as it is read twice) with `target`: for a revisit the record id, size, digest and metadata of the capture that
    it refers to, null if that isn't there."""
    target = assembled.where("type <> 'revisit'").select(F.struct("record_id", "payload_bytes", "payload_digest", "metadata").alias("target"), F.col("record_id").alias("refers_to"))
    revisits = assembled.where("type = 'revisit'").join(target, "refers_to", "left").select(*assembled.columns, "target")
    return revisits.unionByName(assembled.where("type <> 'revisit'").withColumn("target", F.lit(None).cast(revisits.schema["target"].dataType)))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    records = stored(read_archives(spark, path, payloads=False))
    whole = F.coalesce("target", F.struct("record_id", "payload_bytes", "payload_digest", "metadata"))
    kind = pages.schema["page_id"].dataType
    return with_targets(stored(captures(records))).select(
        F.col("metadata.fields")["page_id"].cast(kind).alias("page_id"), whole["payload_bytes"].alias("payload_bytes"), whole["payload_digest"].alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("target.metadata.fields")["page_id"].cast(kind).alias("refers_to"), "target_uri", F.col("request.record_id").isNotNull().alias("has_request"))


OP11_SQL = """
with p as (select *, sha1(coalesce(html, '')) digest, strlen(coalesce(html, ''))::bigint size from pages),
w as (select *, max(page_id) over (partition by digest) last from p)
select page_id, size payload_bytes, digest payload_digest, case when size >= 1000 and page_id < last then 'revisit' else 'response' end record_type,
  case when size >= 1000 and page_id < last then last end refers_to, url target_uri, true has_request
from w
"""
