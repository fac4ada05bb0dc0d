"""The registered queries on the smallest tables, against SQL, brute force or held-out labels."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from dealgraph.llm import decontaminate, mixing, near_dedup, quality, substring_dedup

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, n):
    name = next(k for k in contract.queries() if k.startswith(f"op{n}_"))
    return {r.doc_id: r for r in contract.queries()[name](spark, SF).collect()}


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_every_operator_is_registered_once():
    names = [k for k in contract.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_op1(spark, docs):
    got = run(spark, 1)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (fold(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[d].predicted, q) for d, q in labels.items() if got[d].held_out]
    assert sum(p == q for p, q in held) / len(held) >= 0.85


def test_op2(spark, docs):
    got = run(spark, 2)
    assert all(r.held_out == (fold(d, 4) == 2) for d, r in got.items())
    held = [(r.lang_pred, docs[d].lang) for d, r in got.items() if r.held_out]
    assert sum(p == q for p, q in held) / len(held) >= 0.95


def test_op3(spark, docs):
    got = run(spark, 3)
    by_text = {}
    for d, r in docs.items():
        body = (r.text or "").encode()
        payload = body + b"\0" * (max(1, -(-len(body) // 64)) * 64 - len(body))
        x = got[d]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by_text.setdefault(r.text, set()).add((x.media_bytes, x.media_sha256, x.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_op4(spark, docs):
    got = run(spark, 4)
    toks = {d: re.findall(r"[^\x20\x09-\x0D]+", low(r.text)) + [" "] for d, r in docs.items()}
    c = Counter(w for d, ws in toks.items() if fold(d, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in toks.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op5(spark, docs):
    got = run(spark, 5)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [tuple(got[x[0]]) for x in sorted(decontaminate.brute([(d, r.text) for d, r in docs.items()], items))] == sorted(decontaminate.brute([(d, r.text) for d, r in docs.items()], items))


def test_op6(spark, docs):
    ref = near_dedup.brute([(d, r.text) for d, r in docs.items()])
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in run(spark, 6).items()} == {d: (n, c, c == d) for d, (n, c) in ref.items()}


def test_op7(spark, docs):
    ref = substring_dedup.brute([(d, r.text) for d, r in docs.items()])
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in run(spark, 7).items()} == {d: (n, x, hashlib.sha256(k).hexdigest()) for d, (n, x, k) in ref.items()}


@pytest.mark.parametrize("n", [8, 10, 11, 12, 13])
def test_sql(spark, n):
    import duckdb

    name = next(k for k in contract.queries() if k.startswith(f"op{n}_"))
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    result = c.sql(contract.oracle_sql()[name])
    at = [result.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in result.fetchall()), key=repr)


def test_op9(spark, docs):
    got = run(spark, 9)
    assert {r.law for r in got.values()} == {"bytes"} and {r.grown_shard for r in got.values()} == {None}
    slots = {}
    for d, r in got.items():
        assert (r.size, r.text_crc32) == (len((docs[d].text or "").encode()) + 8, zlib.crc32((docs[d].text or "").encode()))
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage on its own input: the classifier's decisions are its operator's, the others brute force's."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = frame.columns

    good = stages["quality"](spark, frame, SF)
    scores = {r.doc_id: r.score for r in quality.score_quality(frame, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == names and {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= quality.THRESHOLD}

    kept = stages["near_dedup"](spark, frame, SF)
    ref = near_dedup.brute([(d, r.text) for d, r in docs.items()])
    assert kept.columns == names and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in ref.items() if c == d)

    clean = stages["decontaminate"](spark, frame, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == names and sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in decontaminate.brute([(d, r.text) for d, r in docs.items()], items) if not x[5])

    mixed = stages["mix"](spark, frame, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(frame).collect()}
    assert mixed.columns == names and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})

    shards = stages["shard"](spark, mixed, SF).collect()
    assert len(shards) == sum(copies.values())


def test_pipeline_runs(spark):
    rows = contract.queries()["pipeline"](spark, SF).collect()
    assert rows and all(0 <= r.shard < 24 for r in rows)


def test_the_rest_does_not_need_the_corpus_operators(tmp_path):
    """Without the subpackage and the pipeline, the contract's module still gives the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "dealgraph"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "dealgraph" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
