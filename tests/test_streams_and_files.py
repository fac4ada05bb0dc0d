"""Streams give what their batch twins give; files are read and written as described."""

import pytest
from pyspark.sql import functions as F

from dealgraph.functions import scoring, similarity
from dealgraph.operators import dedupe
from dealgraph.sources import files
from dealgraph.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in four files, in time order, as a stream would see them."""
    path = tmp_path_factory.mktemp("events")
    pdf = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts")
    for k in range(4):
        pdf.iloc[k * len(pdf) // 4 : (k + 1) * len(pdf) // 4].to_parquet(path / f"{k}.parquet", coerce_timestamps="us")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_throttle(spark, parts):
    batch = rows(jobs.throttle(spark.read.schema(jobs.EVENTS).parquet(parts), 86_400, 1))
    stream = jobs.run_to_memory(jobs.throttle(jobs.event_stream(spark, parts), 86_400, 1), "throttled")
    assert rows(stream) == batch and 0 < len(batch)


def test_once_only(spark, parts):
    stream = jobs.run_to_memory(jobs.once_only(jobs.event_stream(spark, parts)).select("event_id"), "once")
    assert rows(stream) == rows(spark.read.parquet(parts).select("event_id").distinct())


def test_hourly_trend(spark, parts):
    stream = jobs.run_to_memory(jobs.hourly_trend(jobs.event_stream(spark, parts)).select("period", "event_type", "n"), "hourly", "complete")
    assert rows(stream) == rows(jobs.hourly_trend(spark.read.schema(jobs.EVENTS).parquet(parts)).select("period", "event_type", "n"))


def test_upsert_batches(spark, parts, tmp_path):
    events = jobs.event_stream(spark, parts).select("user_id", "ts", "value")
    q = jobs.upsert_batches(events, str(tmp_path / "t"), "user_id", "ts", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(str(tmp_path / "t" / "v3"))
    expected = spark.read.schema(jobs.EVENTS).parquet(parts).groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert rows(last.select("user_id", "ts")) == rows(expected)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"Deal Name", Deal Stage ,Pipeline,Close Date,Amount,Deal Owner,Company Name\nBig,won,p,2024-01-05,"$1,200.50",Ann,Acme\n,,,,,,\n', encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns[:2] == ["Deal Name", "Deal Stage"]
    assert files.detect_format(df.columns) == ("hubspot", 1.0)
    assert files.detect_format(["x", "y"]) == ("generic", 0.0)
    assert files.detect_format(["Vendors Name", "Deals Name"])[0] == "deals_with_vendors"
    got = files.deals_from_csv(df).collect()[0]
    assert (got.deal_name, got.customer_name, got.deal_value, str(got.close_date)) == ("Big", "Acme", 1200.5, "2024-01-05")


MBOX = """From a@x Mon Jan 01 10:00:00 2024
Message-ID: <1@x>
From: Ann <ANN@x.com>
To: bob@y.com, Cy <cy@z.org>
Subject: Hi
X-Gmail-Labels: INBOX,IMPORTANT
Content-Type: text/plain

Hello
there

From b@y Mon Jan 01 11:00:00 2024
Message-ID: <2@y>
In-Reply-To: <1@x>
References: <0@q> <1@x>
From: bob@y.com
Subject: Re: Hi
Content-Type: text/html

<p>Yes</p>
"""


def test_mbox(spark, tmp_path):
    (tmp_path / "m.mbox").write_text(MBOX)
    got = {r.message_id: r for r in files.parse_messages(files.read_mbox(spark, str(tmp_path / "m.mbox"))).collect()}
    assert set(got) == {"1@x", "2@y"}
    assert got["1@x"].sender == "ann@x.com" and got["1@x"].recipients == ["bob@y.com", "cy@z.org"] and got["1@x"].body == "Hello\nthere" and got["1@x"].labels == ["INBOX", "IMPORTANT"]
    assert got["2@y"].in_reply_to == "1@x" and got["2@y"].refs == ["0@q", "1@x"] and got["2@y"].html.strip() == "<p>Yes</p>"


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\nNOTE x\n\n1\n00:00:01.000 --> 00:00:03.500\n<v Ann Lee>Hello all</v>\n\n00:01:00.000 --> 00:01:02.000\nBob: Hi\n")
    got = [(r.start, r.stop, r.speaker, r.text) for r in files.read_vtt(spark, str(tmp_path / "a.vtt")).orderBy("cue").collect()]
    assert got == [(1.0, 3.5, "Ann Lee", "Hello all"), (60.0, 62.0, "Bob", "Hi")]


def test_folder_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, tags array<string>")
    for kind in ("csv", "json", "parquet"):
        files.export(df, str(tmp_path / kind), kind)
    assert rows(files.read_csv(spark, str(tmp_path / "csv")).select("id", F.coalesce("tags", F.lit("")))) == [("1", "a;b"), ("2", "")]
    assert files.scan_folder(spark, str(tmp_path), "*.csv").count() >= 1
    with pytest.raises(ValueError):
        files.export(df, str(tmp_path / "z"), "xlsx")


def test_vendor_rows(spark):
    t = spark.createDataFrame([("Acme Inc", "https://www.acme.com/x; info@acme.org"), ("ACME, Inc.", ""), (None, "z.com")], "`Vendor Name` string, Website string")
    got = files.vendor_rows(t).collect()
    assert [(r.key, r.vendor_name, r.domains) for r in got] == [("acme", "ACME, Inc.", ["acme.com", "acme.org"])]


def test_fixed_similarities(spark):
    r = spark.createDataFrame([("acme corp", "acme corporation"), ("night", "nacht")], "a string, b string").select(F.round(similarity.dice(F.col("a"), F.col("b")), 6)).collect()
    assert [x[0] for x in r] == [0.666667, 0.25]
    d = spark.createDataFrame([(n,) for n in (0, 1, 7, 14, 28, 29)], "n int").select(F.round(similarity.date_similarity(F.lit("2024-01-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n"))), 6)).collect()
    assert [x[0] for x in d] == [1.0, 0.957143, 0.7, 0.466667, 0.0, 0.0]


def test_fuzzy_is_symmetric(spark):
    pairs = [("acme deal one", "deal acme two"), ("x", "xyz"), ("same", "same"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(similarity.fuzzy(F.col("a"), F.col("b")).alias("x"), similarity.fuzzy(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(r.x == r.y and 0 <= r.x <= 100 for r in df) and df[2].x == 100.0


def test_win_probability(spark):
    one = spark.range(1).select(scoring.win_probability(F.lit("po_in_progress"), F.lit("high"), F.lit(False), F.lit(True)).alias("w"), scoring.momentum(F.lit(True), F.lit(1), F.lit(2)).alias("m"),
                                F.round(scoring.completeness([F.lit("x")] * 8 + [F.lit(None)]), 6).alias("c")).first()
    assert (one.w, one.m, one.c) == (0.9, 0.8, 0.624295)


def test_clusters_partition_their_ids(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (20, 21)], "id_1 int, id_2 int")
    assert rows(dedupe.clusters(pairs)) == [(1, 1), (1, 2), (1, 3), (10, 10), (10, 11), (10, 12), (10, 13), (10, 14), (20, 20), (20, 21)]




def scanned(text):
    """A mail folder's messages by a scan of its lines."""
    out, blank = [], False
    for line in text.split("\n"):
        if files.opens_message(line.rstrip("\r"), blank):
            out.append([])
        if out:
            out[-1].append(line)
        blank = line.strip() == ""
    return ["\n".join(m) for m in out]


def test_mail_folders_in_many_splits(spark, tmp_path):
    """Body lines that begin with `From ` open no message, wherever a file is split."""
    body = ["Dear all", "From here on it is body", "", "x" * 150, "From 2024 to 10:30 we met", "From ", "end", ""]
    text = "a line before any message\nFrom nobody\n" + "\n".join("\n".join(([f"From a{k}@x Mon Jan 01 10:00:{k:02d} 2024"] if k % 3 else ["", f"From plain{k}@x"]) + ["Subject: s", "", *body[: k % 9]]) for k in range(40))
    (tmp_path / "many.mbox").write_text(text)
    (tmp_path / "none.mbox").write_text("no message\nFrom x\nat all")
    (tmp_path / "bare.mbox").write_text("From a@x Mon Jan 01 10:00:00 2024\nFrom here\n\nFrom weak\nz")
    want = scanned(text)
    assert 30 < len(want) and any("From here on" in m for m in want)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("134217728", "700", "97", "31"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = files.read_mbox(spark, str(tmp_path)).collect()
            assert sorted(r.message for r in got if r.file.endswith("many.mbox")) == sorted(want), size
            assert sorted(r.message for r in got if r.file.endswith("bare.mbox")) == sorted(scanned((tmp_path / "bare.mbox").read_text())) and not [r for r in got if r.file.endswith("none.mbox")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chunk_states_after_a_restart(spark, tmp_path):
    """The states of a stream that is stopped in the middle and goes on are those of the batch."""
    from dealgraph.plans.mapped import chunk_log

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        log = chunk_log(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        q = (jobs.chunk_states(log).writeStream.outputMode("update").option("checkpointLocation", mark)
             .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n={n}")).trigger(availableNow=True).start())
        q.awaitTermination()

    events.where("event_id % 3 = 1").repartition(2).write.mode("append").parquet(folder)
    run()
    events.where("event_id % 3 <> 1").repartition(2).write.mode("append").parquet(folder)  # also earlier events, that come late
    run()
    updates = spark.read.parquet(out)
    cols = [c for c in updates.columns if c not in ("n", "chunk_id")]
    final = updates.groupBy("chunk_id").agg(F.max_by(F.struct(*cols), "n").alias("s")).select("chunk_id", "s.*")
    batch = jobs.chunk_states(chunk_log(events))
    assert rows(final.select(sorted(final.columns))) == rows(batch.select(sorted(batch.columns))) and batch.count() > 5


def test_reseeded_intersections(spark):
    from dealgraph.operators import opportunity

    lists = [(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["x"]), (1, 4, ["y", "z", "y"]), (1, 5, ["z", "y"]), (2, 1, []), (2, 2, ["q", "q"]), (3, 1, None), (None, 1, ["n"]), (None, 2, ["n", "m"]), (4, 1, ["s"]), (4, 2, [])]
    df = spark.createDataFrame(lists, "k bigint, o bigint, xs array<string>").repartition(3)
    got = {r.k: r.xs for r in opportunity.reseeded_intersections(df, "k", "o", "xs").collect()}
    # 1: b, then nothing, so the fourth list starts anew and keeps its order
    assert got == {1: ["y", "z"], 2: ["q"], 3: [], None: ["n"], 4: []}
    assert opportunity.reseeded_intersections(df.limit(0), "k", "o", "xs").collect() == []


def test_reseeded_intersections_of_one_order(spark):
    """Lists of one order go by themselves, whatever order they are read in."""
    from dealgraph.operators import opportunity

    lists = [(1, 1, ["b"]), (1, 1, ["a", "c"]), (1, 1, ["a", "b"]), (1, 2, ["d", "a"])]
    for rows in (lists, lists[::-1], lists[2:] + lists[:2]):
        df = spark.createDataFrame(rows, "k bigint, o bigint, xs array<string>").coalesce(1)
        # a; then nothing is left, so the fourth list starts anew
        assert [r.xs for r in opportunity.reseeded_intersections(df, "k", "o", "xs").collect()] == [["d", "a"]]


def test_transforms(spark):
    from dealgraph.functions import transforms

    df = spark.createDataFrame([("$1,234.5k", "a", "1/5/2024"), ("12%", None, "2024-01-05T10:00:00Z"), ("x", "", "Jan 5, 2024"), (None, "b", "never"), (" -3.5e2 ", "c", None)], "x string, y string, z string")
    specs = spark.createDataFrame([("a", ["x"], '{"type": "parse_currency"}'), ("b", ["x"], '{"type": "parse_number"}'), ("c", ["z"], '{"type": "parse_date"}'), ("d", ["x", "y"], '{"type": "concat", "params": {"separator": "+"}}'),
                                   ("e", ["x"], '{"type": "split", "params": {"separator": ",", "index": 1}}'), ("f", ["x"], '{"type": "nonsense"}'), ("g", ["x"], None)], "target string, sources array<string>, spec string")
    got = [tuple(r) for r in transforms.apply_specs(df, specs).collect()]
    assert got == [(1234500.0, None, "2024-01-05", "$1,234.5k+a", "234.5k", "$1,234.5k", "$1,234.5k"), (12.0, 0.12, "2024-01-05", "12%", None, "12%", "12%"), (None, None, "2024-01-05", "x", None, "x", "x"),
                   (None, None, None, "b", None, None, None), (-350.0, -350.0, None, " -3.5e2 +c", None, " -3.5e2 ", " -3.5e2 ")]
