"""Known answers for names, domains, checks, signals, signatures and cleaned mails, written from the rules."""

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from dealgraph.functions import business, cleaning, fields, text
from dealgraph.operators import vendor_match


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_company_names(spark):
    rows = [("Javelintelecom",), ("ACME_CORP",), ("north power",), ("",), (None,), ("IBM-ab",), ("powerPOWER x",)]
    assert [x for x, in values(spark, rows, "x string", business.titled_company(F.col("x")))] == ["Javelin Telecom", "ACME CORP", "North Power", "", None, "IBM Ab", "Power Power X"]
    rows = [("cisco.com",), ("www.dell-emc.com",), ("my-shop.io",), ("",), (None,), ("a.gov",)]
    assert [x for x, in values(spark, rows, "x string", business.company_of_domain(F.col("x")))] == ["Cisco", "Dell EMC", "My Shop", "Unknown", "Unknown", "A"]
    rows = [("a@B.com", "https://www.b.com/x", ["c@b.com", "d@e.org", None]), (None, "shop.net", None), (None, None, [])]
    assert values(spark, rows, "m string, w string, c array<string>", business.domains_of(F.col("m"), F.col("w"), F.col("c"))) == [(["b.com", "e.org"],), (["shop.net"],), ([],)]


def test_values_and_ranges(spark):
    rows = [("1500", "usd", "it is 1,500 now"), ("1500.50", "EUR", "it is 1,500.5"), ("-3", None, None), ("x", "XXX", ""), ("50", "", "nothing"), ("20000000", "GBP", "20000000")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "v string, c string, s string").select(business.value_issues(F.col("v"), F.col("c"), F.col("s"))).collect()]
    assert got == [([], True, 0.0), ([], True, 0.0), (["value_positive:critical", "value_range:warning"], False, -0.3), (["value_positive:critical", "currency_valid:warning"], False, -0.3),
                   (["value_range:warning", "value_context_check:warning"], True, -0.1), (["value_range:warning"], True, -0.1)]
    assert [x for x, in values(spark, [("12h",), ("7d",), ("2w",), ("7",), (None,), ("d7",)], "x string", fields.range_hours(F.col("x")))] == [12, 168, 336, 24, 24, 24]
    assert values(spark, [('see <a class="x" href="u">the <b>site</b></a>',), ("a < b",), (None,)], "x string", text.linked_text(F.col("x")), text.is_html(F.col("x"))) == [("see [the <b>site</b>](u)", True), ("a < b", False), (None, False)]


def test_signals(spark):
    sample = "\n    Ann Lee requested an RFQ for the Marshalling Cabinet deal covering 5-10 cabinets,\n    plus 40 units and 80 unit pilot batches. Target pricing should land at $7-8k per cabinet,\n    margins must stay around 27-30%, and the team wants a purchase order in 6 weeks."
    x = spark.createDataFrame([(sample,), (None,)], "t string").select(business.signals(F.col("t"), {"marshalling-cabinet": ("marshalling", "cabinet")}, {"ann": ("ann lee",), "bob": ("bob",)}).alias("s")).collect()[0].s
    assert set(x.quantities) >= {"5-10 cabinets", "40 units"} and x.prices[0] == "$7-8k per cabinet" and x.margins == ["27-30%"] and x.timelines == ["6 weeks"]
    assert (x.tags, x.actors, x.hints) == (["marshalling-cabinet"], ["ann"], ["rfq", "po_in_progress"])


def test_signatures_and_cleaning(spark):
    mails = ["Hello there, friend\n\n-- \nJane Roe\nSenior Engineer\nAcme Systems\njane@acme.com\n+1 555 123 4567\nThis email is confidential", "Some body text\nBest regards,\nJohn", "Only text here", None, "  ", "> all quoted\n> of it",
             "Answer “yes” — really\n\nOn Mon, A wrote:\n> q\nCall me\nAnn\n555 123 4567 890"]
    t = spark.createDataFrame(list(enumerate(mails)), "text_id int, text string")
    got = {r.text_id: r for r in cleaning.cleaned(t).collect()}
    assert [got[k].cleaned for k in range(6)] == ["Hello there, friend", "Some body text", "Only text here", "", "", ""]
    assert [got[k].had_signature for k in range(7)] == [True, True, False, False, False, False, True] and [got[k].had_quotes for k in range(7)] == [False] * 5 + [True, True]
    assert got[6].cleaned == 'Answer "yes" -- really' and got[6].signature == "Call me\nAnn\n555 123 4567 890" and [got[k].has_content for k in range(7)] == [True, True, True, False, False, False, True]
    p = cleaning.split_signature(t).where("text_id = 0").select(cleaning.parsed_signature(F.col("signature")).alias("p")).first().p
    # the delimiter itself is the signature's first line
    assert (p.name, p.title, p.company, p.email, p.phone, p.disclaimer) == ("--", "Senior Engineer", "Acme Systems", "jane@acme.com", "+1 555 123 4567", "This email is confidential")


def test_vendor_references(spark):
    m = spark.createDataFrame([(1, " Acme Systems "), (2, "shop"), (3, "Big Beta"), (4, ""), (5, None), (6, "zzz")], "mention_id bigint, name string")
    c = spark.createDataFrame([(10, "Acme Systems", "acme", ["acme.com"]), (11, "Beta", "beta", ["shop.org"]), (12, "Big Beta", "big beta", None)], "vendor_id bigint, vendor_name string, normalized_name string, domains array<string>")
    assert sorted(tuple(r) for r in vendor_match.cross_reference(m, c).collect()) == [(1, 10, "exact", 1.0), (2, 11, "partial", 0.8), (3, 11, "fuzzy", 0.7)]
