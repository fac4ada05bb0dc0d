"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs; a reference holds the
digest of its payload and its caption. Payloads are stored apart, once per digest and task, as
lossless 8-bit greyscale PNG images (64 samples a row; a payload's bytes are its samples). A join
on the digest resolves the references; positions and captions stay with them, so the sequences
come back as they were written. Only digests, positions, captions and features meet in the
join: the payloads are read back where they are stored, and never shuffled.

Defined results: null HTML has an empty sequence; a reference without a stored payload stays, with
null payload columns; empty texts have a payload of 64 zero bytes; repeated rows and equal texts share
their payload's digest; a null id is kept; empty tables give empty results; columns other than
the named ones are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.llm.common import cut, map_arrow, stored, table

#: Samples of an image's row; payloads are padded to a positive multiple.
ROW = 64
SCHEME = "digest:"
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_PNG = b"\x89PNG\r\n\x1a\n"


def pad(body: bytes) -> bytes:
    """The payload of a text: its bytes, then zeros to a positive multiple of ROW."""
    return body + bytes(max(1, -(-len(body) // ROW)) * ROW - len(body))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A greyscale image, 8 bits a sample, ROW samples a row, without row filters."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    """The samples of an image that encode_png() made; checks every chunk's sum."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, size = 8, b"", None
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None or size[0] != ROW or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this kind")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Height, mean, deviation and entropy (bits, of the samples), and a 64-bit hash of block means."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    blocks = np.array([b.mean() if len(b) else 0.0 for b in np.array_split(x.astype(np.float64), 64)])
    bits = int("".join("1" if b else "0" for b in blocks > np.median(blocks)), 2)
    entropy = -float((p[p > 0] * np.log2(p[p > 0])).sum())
    return f"h={len(x) // ROW};mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};hash={bits:016x}"


_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "nav", "blockquote", "figure"}
_SKIP = {"script", "style", "head", "template", "noscript"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Reader(HTMLParser):
    """Ordered items of a page: text between blocks, and media references with their captions
    (the figure's figcaption, or else the alternative text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.skipped = [], [], []
        self.figure, self.caption = None, None

    def flush(self):
        text = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(self.words)).strip(" ")
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if self.skipped == ["head"] and (tag == "body" or tag in _BLOCKS or tag in _MEDIA):
            self.skipped.clear()  # a head's end tag may be left out
        if tag in _SKIP:
            self.skipped.append(tag)
        if self.skipped:
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            source = a.get("src") or ""
            if source:
                self.flush()
                digest = source[len(SCHEME):] if source.startswith(SCHEME) else hashlib.sha256(source.encode("utf-8", "replace")).hexdigest()
                self.items.append({"kind": "media", "text": None, "digest": digest, "caption": a.get("alt") or a.get("title")})

    def handle_endtag(self, tag):
        if tag in _SKIP:
            if tag in self.skipped:  # what was opened in it and not closed ends with it
                del self.skipped[self.skipped.index(tag):]
            return
        if self.skipped:
            return
        if tag == "figcaption" and self.caption is not None:
            caption = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(self.caption)).strip(" ")
            self.caption = None
            for item in self.items[self.figure or 0:] if self.figure is not None else self.items[-1:]:
                if item["kind"] == "media" and caption:
                    item["caption"] = caption
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skipped:
            (self.words if self.caption is None else self.caption).append(data)


def read_html(page: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return [{"pos": k, **x} for k, x in enumerate(reader.items)]


def parse_sequences(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, sequence): the ordered items of every page."""
    kind = pages.schema[page_id].dataType.simpleString()
    item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                rows = [read_html(x) for x in batch.column(1).slice(a, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 200), pa.array(rows, pa.list_(item))], names=[page_id, "sequence"])

    return map_arrow(pages.select(page_id, F.col(html).cast("string").alias("html")), run, f"{page_id} {kind}, sequence {SEQUENCE}")


def store_payloads(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored table (doc_id, n_bytes, digest, media): a row per document, with the image in the
    first row of a task that has the digest and null in later ones. Written to the shared folder."""
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                sizes, digests, media = [], [], []
                for body in batch.column(1).slice(a, 500):
                    body = body.as_py()
                    payload = pad(body)
                    digest = hashlib.sha256(payload + len(body).to_bytes(8, "little")).digest()
                    sizes.append(len(body))
                    digests.append(digest.hex())
                    media.append(None if digest in seen else encode_png(payload))
                    if len(seen) < 1_000_000:  # beyond, a digest may be stored again, which harms nothing
                        seen.add(digest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sizes)), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(media, pa.binary())],
                                                 names=["doc_id", "n_bytes", "digest", "media"])

    return cut(map_arrow(src, run, f"doc_id {kind}, n_bytes bigint, digest string, media binary"))


def read_back(store: DataFrame) -> DataFrame:
    """Per digest of the stored images, what is read back from them: (digest, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = []
                for digest, image in zip(batch.column(0).slice(a, 500), batch.column(1).slice(a, 500), strict=True):
                    image = image.as_py()
                    payload = decode_png(image)
                    rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)

    found = map_arrow(store.where("media is not null").select("digest", "media"), run,
                      "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    # a table of its own, so that a join with it deals both sides out anew and Spark splits a digest of very many rows
    return stored(found.dropDuplicates(["digest"]))


def resolve(sequences: DataFrame, payloads: DataFrame, page_id: str) -> DataFrame:
    """The items of all sequences with what the payloads of their references give: (page_id, pos, kind, text,
    caption, digest, ...). Texts, and references without a payload, have nulls there; `pos` gives the order. A page without
    items is a row of nulls, so that it stays."""
    items = sequences.select(page_id, F.explode_outer("sequence").alias("_i")).select(page_id, "_i.pos", "_i.kind", "_i.text", "_i.caption", "_i.digest")
    more = [c for c in payloads.columns if c != "digest"]
    names = [page_id, "pos", "kind", "text", "caption", "digest", *more]
    media = items.where("kind = 'media'").join(payloads, "digest", "left").select(*names)
    return media.unionByName(items.where("kind is null or kind <> 'media'").select("*", *[F.lit(None).cast(payloads.schema[c].dataType).alias(c) for c in more]))


def interleave(items: DataFrame, page_id: str) -> DataFrame:
    """(page_id, items): resolved items put back in the order of their page; a page without items has none. Pages are told apart by their id."""
    rest = [c for c in items.columns if c not in (page_id, "pos")]
    return items.groupBy(page_id).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", *rest)))).alias("items"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = store_payloads(table(spark, sf_dir, "documents"))
    # the interleaved document: a heading, the text as a figure, and its size as the caption
    page = F.concat(F.lit("<article><h1>payload</h1><figure><img src=\"" + SCHEME), F.col("digest"), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure></article>"))
    sequences = parse_sequences(store.select("doc_id", page.alias("html")), "doc_id", "html")
    out = resolve(sequences, read_back(store), "doc_id").where("kind = 'media'")
    return out.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos")
