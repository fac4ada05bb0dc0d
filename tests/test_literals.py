"""Known answers for single values, and similarities against another implementation."""

from functools import lru_cache

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from dealgraph.functions import normalize, similarity, text
from dealgraph.operators import extraction
from dealgraph.plans import registry
from dealgraph.sources import files


def answers(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, x string").select("id", column(F.col("x")).alias("y")).orderBy("id").collect()
    return [tuple(r.y) if hasattr(r.y, "asDict") else r.y for r in rows]


def test_dates(spark):
    got = answers(spark, ["2024-01-15", "01/15/2024", "25/12/2024", "Q3 2024", "Jan 5, 2024", "garbage", None, "January 15, 2024", "13-13-2024", "2024-02-01T10:00:00Z"], normalize.date)
    assert got == [("2024-01-15", 0.8, "auto"), ("2024-01-15", 0.8, "auto"), ("2024-12-25", 0.95, "UK_DMY"), ("2024-07-01", 0.95, "QUARTER"), ("2024-01-05", 0.8, "auto"),
                   (None, 0.0, "failed"), (None, 1.0, "none"), ("2024-01-15", 0.8, "auto"), (None, 0.0, "failed"), ("2024-02-01", 0.8, "auto")]


def test_money(spark):
    got = answers(spark, ["$100,000", "100K", "$1.5M USD", "€2,500.50", "1.2B", "GBP 300", "n/a", None, "₹ 75 000", "CHF 12k"], normalize.currency)
    assert got == [(100000.0, "USD", 0.9), (100000.0, "USD", 0.9), (1500000.0, "USD", 0.9), (2500.5, "EUR", 0.9), (1.2e9, "USD", 0.9), (300.0, "GBP", 0.9), (0.0, "USD", 0.0),
                   (0.0, "USD", 1.0), (75000.0, "INR", 0.9), (12000.0, "CHF", 0.9)]


def test_quotes_and_signatures(spark):
    mails = ["Hello\n> quoted\n> more\nbye", "Top\nOn Mon, Jan 1, A wrote:\n> x\n> y", "no quotes\n\n\n\nat all ", "> all\n> quoted", "text\n----- Original Message -----\nold", "top\nOn Mon, A wrote:\n> q\n\nFrom: b@c\nanswer below", "", None, "a\n> b\nTo: c\n\n> d\n\n\n\ne"]
    got = extraction.unquoted(spark.createDataFrame(list(enumerate(mails)), "text_id int, text string")).orderBy("text_id").collect()
    assert [r.text for r in got] == ["Hello\nbye", "Top", "no quotes\n\n\n\nat all ", "", "text\nold", "top\nanswer below", "", None, "a\ne"]
    assert answers(spark, ["Body\n-- \nJane\nCEO", "Hi\nall good\nBest regards,\nJohn", "nothing here", "Thanks,\nX"], lambda x: F.regexp_replace(text.unsigned(x), r"\n+$", "")) == ["Body", "Hi\nall good", "nothing here", ""]


def test_file_names(spark):
    assert answers(spark, ["/x/Acme Corp - Deals.xlsx", "/y/globex_deals.csv", "/z/notes.txt"], files.vendor_from_file_name) == ["Acme Corp", "globex", "notes"]
    assert answers(spark, ["teams_2024-05-01_weekly-sync.vtt", "notes.txt"], files.file_name_parts) == [("teams", "2024-05-01", "weekly-sync"), (None, None, None)]


def common(a, b):
    """The length of the longest common subsequence, by recursion."""
    @lru_cache(None)
    def at(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + at(i + 1, j + 1) if a[i] == b[j] else max(at(i + 1, j), at(i, j + 1))

    return at(0, 0)


def brute_fuzzy(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0

    def ratio(x, y):
        return int(200 * common(x, y) / (len(x) + len(y)) + 0.5) if x and y else 0.0

    short, long = sorted((a, b), key=len)
    ta, tb = set(a.split()), set(b.split())
    base, one, two = (" ".join(p).strip() for p in ([" ".join(sorted(ta & tb))], [" ".join(sorted(ta & tb)), " ".join(sorted(ta - tb))], [" ".join(sorted(ta & tb)), " ".join(sorted(tb - ta))]))
    scores = [ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), ratio(one, two)]
    scores += [ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)]
    scores += [ratio(base, one), ratio(base, two)] if base else []
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if x == y:
        return 100.0
    gx, gy = ([t[i : i + 2] for i in range(len(t) - 1)] for t in (x, y))
    if len(x) > 1 and len(y) > 1:
        scores.append(200 * sum(min(gx.count(g), gy.count(g)) for g in set(gx)) / (len(gx) + len(gy)))
    return max(scores)


def test_fuzzy_similarity(spark):
    pairs = [("Acme Corp deal", "acme corp deal"), ("alpha beta", "beta alpha"), ("", "x"), ("red ring", "blue gear"), ("a", "ab"), ("healed", "sealed"), ("web app", "webapp"), ("acme corp", "acme corporation of x")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id int, a string, b string").select("a", "b", similarity.fuzzy(F.col("a"), F.col("b")).alias("score")).collect()
    rows += registry.queries()["d03_fuzzy"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 300
    for r in rows:
        assert abs(r.score - brute_fuzzy(r.a.lower(), r.b.lower())) < 1e-3, r
