"""Captures, ranked search and spelling variants: nulls, empty and very long texts, ties, repeated rows, empty tables,
clashing columns, and brute force."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealgraph.llm import lexical, spelling, warc
from dealgraph.llm.common import stored


def folder(tmp_path):
    return f"{tmp_path}/archives"


# ---------------------------------------------------------------- captures

PAGE = "<p>" + "x" * 1200 + "</p>"
ROWS = [(1, "http://a.example/x?y=1#z", PAGE, "clash"), (2, "http://b.example", PAGE, ""), (2, "http://b.example", PAGE, None), (3, None, None, ""), (4, "no url \r\nEvil: 1", "", ""), (None, "http://n.example/", PAGE, ""),
        (None, "http://n.example/", "short", ""), (5, "http://e.example/", "short", ""), (6, "http://sep.example/", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\nü\r\n" * 40 + "\r\n\r\n", ""),
        (7, "http://long.example/", "lö" * 400_000, ""), (8, "u", "\r\n", ""), (9, "u", "\r", "")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string, digest string").selectExpr("*", "'clash' as row", "'clash' as first", "'clash' as body").repartition(3)


def test_captures(spark, pages, tmp_path):
    warc.write_archives(pages, folder(tmp_path), date="2026-01-01T00:00:00Z")
    records = stored(warc.read_archives(spark, folder(tmp_path)))
    found = records.collect()
    assert len(found) == 3 * len(ROWS) == len({r.record_id for r in found}) and not any(r.truncated for r in found)
    assert Counter(r.type for r in found) == {"request": 12, "metadata": 12, "response": 9, "revisit": 3}
    assembled = stored(warc.captures(records))
    assert warc.loose(records, assembled).collect() == []
    got = warc.with_targets(assembled).collect()
    assert len(got) == len(ROWS) and all(r.n_request == r.n_metadata == 1 and r.request.target_uri == r.target_uri == r.metadata.target_uri for r in got)
    texts = Counter((p, (h or "").encode()) for p, _, h, _ in ROWS)
    assert Counter((int(r.metadata.fields["page_id"]) if "page_id" in r.metadata.fields else None, bytes(r.payload)) for r in got if r.type == "response") + Counter(
        {(1, PAGE.encode()): 1, (2, PAGE.encode()): 1, (None, PAGE.encode()): 1}) == texts
    for r in got:
        if r.type == "revisit":  # one of the two equal rows of page 2 is the response
            assert (r.target.payload_digest, r.target.payload_bytes, r.target.metadata.fields["page_id"], r.payload_bytes) == (hashlib.sha1(PAGE.encode()).hexdigest(), len(PAGE), "2", 0)
    assert {r.target_uri for r in got} >= {"no%20url%20%0D%0AEvil:%201", None}


def test_empty_archive(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), folder(tmp_path))
    assert warc.captures(warc.read_archives(spark, folder(tmp_path))).collect() == []


def test_foreign_archives(spark, tmp_path):
    """Members of their own, links in either direction, several sides, orphans, a cut-off record, a folded field."""
    def record(kind, rid, block, *more):
        return ("\r\n".join([ "WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not\r\nA: b\r\n\r\n\xff\xfe\r\n\r\nend\r\n"
    parts = [record("warcinfo", "w", b"software: x\r\n", "Content-Type: application/warc-fields"),
             record("response", "r1", http, "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m1>"),
             record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request", "WARC-Concurrent-To: <r1>"),
             record("request", "q0", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request", "WARC-Concurrent-To: <r1>"),
             record("metadata", "m1", b"a: 1\r\n  2\r\nb:\r\n", "Content-Type: application/warc-fields"),
             record("metadata", "lost", b"", "WARC-Concurrent-To: <nowhere>"), record("resource", "s", b"\r\n\r\n"), record("response", "cut", b"abcdef")[:-7]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(record("response", "other", b"x")))
    records = stored(warc.read_archives(spark, f"{tmp_path}/in"))
    got = {r.record_id: r for r in warc.captures(records).collect()}
    assert set(got) == {"<r1>", "<s>", "<cut>", "<other>"}
    r = got["<r1>"]
    assert (r.http_status, bytes(r.payload), r.request.record_id, r.n_request, r.metadata.fields, r.n_metadata) == (404, b"\xff\xfe\r\n\r\nend\r\n", "<q0>", 2, {"a": "1 2", "b": ""}, 1)
    assert (got["<s>"].request, bytes(got["<s>"].payload), got["<cut>"].truncated, bytes(got["<cut>"].payload), got["<other>"].n_request) == (None, b"\r\n\r\n", True, b"abc", 0)
    assert {r.record_id for r in warc.loose(records, stored(warc.captures(records))).collect()} == {"<w>", "<q1>", "<lost>"}


def test_splicer_takes_any_bytes():
    rng = random.Random(5)
    for _ in range(300):
        blocks = [bytes(rng.choice(b"\r\na") for _ in range(rng.randrange(14))) for _ in range(4)]
        whole = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
        pieces = whole.split(b"\r\n\r\n")
        splicer = warc.Splicer()
        got = [r for p in (pieces[:-1] if pieces[-1] == b"" else pieces) for r in splicer.push(p)] + list(splicer.end())
        assert [(r["payload"], r["truncated"]) for r in got] == [(b, False) for b in blocks]


# ---------------------------------------------------------------- ranked search

def ranked(docs, items, k=lexical.TOP):
    """Brute force: all scores of all documents."""
    def terms(t):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    tfs = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tfs:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            scores.append((sum(lexical.weight(n, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c), d))
        best = sorted(((s, d) for s, d in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out += [(item, r, d, s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(60)]
    return [(r.randrange(n), " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(60)], k=r.randrange(1, 60)))) for _ in range(n)]


def test_search_against_brute_force(spark):
    rows = corpus(1, 300) + [(None, "w1é w2é"), (None, "w1é w2é"), (5, None), (6, ""), (7, "... --"), (8, "W1É w3é " * 30_000), (9, "solo"), (9, "solo"), (10, "SOLO")]
    items = [(1, "w1é w40é w59é w59é"), (1, "Solo"), (None, "w2é, w2é. w30é!"), (3, None), (4, ""), (5, "unknown"), (6, " ".join(f"w{k}é" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as ids", "'clash' as score").repartition(5)
    queries = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'clash' as doc_id", "'clash' as terms")
    for shard_bytes, block, k in ((lexical.SHARD_BYTES, lexical.BLOCK_TERMS, 50), (400, 4, 50), (400, 3, 3), (1, 1, 1)):
        index = stored(lexical.build_index(docs, shard_bytes=shard_bytes))
        got = lexical.search(index, queries, k, block_terms=block)
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items, k)
    assert lexical.search(index, queries.limit(0)).collect() == []
    empty = stored(lexical.build_index(docs.limit(0)))
    assert lexical.search(empty, queries).collect() == []


def test_wand_skips_and_agrees():
    rng = random.Random(2)
    for _ in range(200):
        n, k = rng.randrange(1, 80), rng.randrange(1, 6)
        lists = []
        for _ in range(rng.randrange(1, 7)):
            d = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            x = [rng.randrange(1, 9) for _ in d]
            lists.append((d, x, max(x)))
        total = np.zeros(n, int)
        for d, x, _ in lists:
            total[d] += x
        tie = rng.sample(range(n), n)
        floor = rng.randrange(1, 12)
        want = sorted(((int(s), -tie[d], d) for d, s in enumerate(total) if s >= floor), reverse=True)[:k]
        assert sorted(lexical.wand(lists, tie, k, floor), reverse=True) == want

    class Counted(list):
        read = 0

        def __getitem__(self, k):
            Counted.read += 1
            return super().__getitem__(k)

    # a document with the rare term can't be beaten: the common term's list is never scored elsewhere
    common = (list(range(10_000)), Counted([1] * 10_000), 1)
    assert lexical.wand([common, ([7_000], [50], 50)], list(range(10_000)), 1, 2) == [(51, -7_000, 7_000)] and Counted.read == 1


# ---------------------------------------------------------------- spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def forms(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abÿ", k=rng.randrange(1, 7))): rng.choice([1, 1, 2, 10, 10, 100, 2000]) for _ in range(500)}
    words |= {"z": 1, "zz": 10, "zzz": 100, "zzzz": 1000, "zzzzz": 10_000, "zzzzzz": 100_000, "alone": 3, "q" * 300: 5, "q" * 299: 50}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint").selectExpr("*", "'clash' as node", "'clash' as heavy").repartition(4)
    assert set(map(tuple, spelling.variants(frame).collect())) == forms(words)
    links = spelling.one_edit_links(frame.select("word", "n")).collect()
    assert len(links) == len({(r.word, r.near) for r in links}) and {(r.word, r.near) for r in links} == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert spelling.variants(frame.limit(0)).collect() == []
    assert [tuple(r) for r in spelling.variants(frame.where("word = 'alone'")).collect()] == [("alone", None, "alone", 3, 0, None)]


def test_vocabulary(spark):
    rows = [(1, "Straßen straßen STRASSEN ÄÖÜäöüß x1234567 abcdefg"), (1, "abcdefg"), (None, "nullids nullids"), (2, None), (3, ""), (4, "abcdef ab"), (5, "longword" * 50_000 + " " + "longword" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as word", "'clash' as n", "'clash' as h", "'clash' as r", "'clash' as i")
    got = {r.word: r.n for r in spelling.vocabulary(docs, every=None).collect()}
    assert got == {"straßen": 2, "abcdefg": 2, "nullids": 2, "longword" * 50_000: 2}
    import zlib

    rows = [(k, " ".join("Perturbed" if j else "words é" for j in range(3))) for k in range(400)] + [(None, "Perturbed")]
    want = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.lower()
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.word: r.n for r in spelling.vocabulary(frame).collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and len(want) > 3
    assert spelling.vocabulary(frame.limit(0)).withColumn("x", F.lit(1)).collect() == []


def test_fit_gives_its_memory_back(spark, monkeypatch):
    """The words' vectors are handed out as they are sorted, and the driver's freed memory goes back to the system once a fit."""
    from dealgraph.llm import quality

    words = [f"word{k}".encode() for k in range(2_000)]
    sample = spark.createDataFrame([(k, bytearray(b" ".join(words)), k % 2) for k in range(2)], "doc_id bigint, text binary, label int")
    hashes, vectors = quality._contexts(sample, words)
    assert len(hashes) == len(words) == len(vectors) and (hashes[1:] > hashes[:-1]).all()
    let_go, calls = quality._let_go, []
    monkeypatch.setattr(quality, "_let_go", lambda: calls.append(let_go()))
    pool, _ = quality.fit(sample)
    assert len(calls) == 1 and len(pool.hashes) == len(words)
