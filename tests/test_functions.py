import pytest
from pyspark.sql import functions as F

from listingmill.functions import mail, money, places, text, urls
from listingmill.operators import listings


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("t,want", [("SDE: $~262k (TTM)", 262_000.0), ("$3 million in sales", 3e6), ("$ 1,234.50", 1234.5), ("$6,400,000\nAdjusted EBITDA", 6.4e6), ("$2.5MM", 2.5e6), ("no money", None)])
def test_first_amount(spark, t, want):
    assert one(spark, money.first_amount(F.col("t")), t=t) == want


@pytest.mark.parametrize("t,want", [("$1,234", 1234.0), ("Not Disclosed", None), ("N/A", None), ("", None), ("12.5", 12.5)])
def test_plain_amount(spark, t, want):
    assert one(spark, money.plain_amount(F.col("t")), t=t) == want


@pytest.mark.parametrize("v,want", [(1_250_000.0, "$1.3M"), (12_000_000.0, "$12M"), (840_400.0, "$840K"), (0.0, "$0K")])
def test_short(spark, v, want):
    assert one(spark, money.short(F.col("v")), v=v) == want


@pytest.mark.parametrize(
    "u,want",
    [
        ("https://X.example/a/?utm_source=m&recordId=R1#top", "https://x.example/a/?recordid=r1"),
        ("https://x.example/a/", "https://x.example/a"),
        ("https://x.example/a?ref=q&source=z", "https://x.example/a"),
        ("https://x.example/a?reference=1", "https://x.example/a?reference=1"),
        (None, ""),
    ],
)
def test_norm_url(spark, u, want):
    assert one(spark, urls.norm_url(F.col("u")), u=u) == want


@pytest.mark.parametrize("u,want", [("https://x.example/p/?q=123&u=1", "123"), ("https://x.example/biz/name/1234567/", "1234567"), ("https://x.example/12345/", ""), ("https://x.example/1234567/?x=1", "1234567")])
def test_listing_id(spark, u, want):
    assert one(spark, urls.listing_id(F.col("u")), u=u) == want


def test_pick_link_never_declines(spark):
    t = "Pass (https://m.beta.example/d?id=7&action=decline) Pursue (https://m.beta.example/d?id=7&action=pursue)"
    assert one(spark, urls.pick_link(F.col("t"), "beta.example"), t=t) == "https://m.beta.example/d?id=7&action=pursue"
    assert one(spark, urls.pick_link(F.col("t"), "beta.example"), t="x https://m.beta.example/d?action=decline&id=9.") == "https://m.beta.example/d?action=pursue&id=9"
    assert one(spark, urls.pick_link(F.col("t"), "beta.example"), t="none") == ""


@pytest.mark.parametrize(
    "t,want",
    [
        ("Travis County, TX", (None, "TX", "Travis")),
        ("Plumbing Company\nGeorgetown, TX", ("Georgetown", "TX", None)),
        ("in Pennsylvania, United States", (None, "PA", None)),
        ("Toronto, ON then Miami, FL", ("Miami", "FL", None)),
        ("serving West Virginia", (None, "WV", None)),
        ("nowhere", (None, None, None)),
    ],
)
def test_location(spark, t, want):
    assert tuple(one(spark, places.location(F.col("t")), t=t)) == want


@pytest.mark.parametrize("t,want", [("ships nationally", "NATIONAL"), ("a regional firm in three states", "REGIONAL"), ("HVAC crews", "LOCAL_SERVICE"), ("something", "")])
def test_business_model(spark, t, want):
    assert one(spark, places.business_model(F.col("t")), t=t) == want


def test_attribution(spark):
    fwd = "note\n---------- Forwarded message ---------\nFrom: Deals <Info@Beta.example>\nSubject: s"
    assert tuple(one(spark, mail.attribution(F.col("s"), F.col("b")), s="A <a@gmail.com>", b=fwd)) == ("beta.example", "info@beta.example")
    assert tuple(one(spark, mail.attribution(F.col("s"), F.col("b")), s="A <a@gmail.com>", b="go to https://www.found.example/x")) == ("found.example", "")
    assert tuple(one(spark, mail.attribution(F.col("s"), F.col("b")), s="A <a@gmail.com>", b="nothing")) == ("gmail.com", "a@gmail.com")


@pytest.mark.parametrize("b,want", [("short", True), ("Plumbing Company of Texas in Waco", True), ("It serves hospitals and schools with a staff of ninety and long contracts everywhere.", False), (None, True)])
def test_thin(spark, b, want):
    assert one(spark, text.blurb_is_thin(F.col("t"), F.col("b")), t="Plumbing Company of Texas", b=b) is want


def test_strip_html(spark):
    h = "<style>x</style><p>Hi <a href='https://a.example/b'>there</a></p><ul><li>one<li>two</ul>5 &amp; 6"
    assert one(spark, text.strip_html(F.col("h")), h=h).split("\n") == ["Hi there (https://a.example/b)", "", "- one", "- two", "5 & 6"]


def test_lead_sentence(spark):
    assert one(spark, text.lead_sentence(F.col("t")), t="One thing.  Another") == "One thing."
    assert one(spark, text.lead_sentence(F.col("t")), t="x" * 300) == "x" * 200


@pytest.mark.parametrize(
    "t,want",
    [
        ("Revenue: $3.5M\nEBITDA: $238K", {"revenue": 3.5e6, "ebitda": 238e3}),
        ("$50M in revenue, $15M in EBITDA", {"revenue": 50e6, "ebitda": 15e6}),
        ("SDE of $~262k and asking $900,000", {"sde": 262e3, "asking": 900e3}),
        ("Asking Price\n\n$1,200,000", {"asking": 1.2e6}),
        ("Profit (2025): $850K", {"sde": 850e3}),
        ("nothing here", {}),
    ],
)
def test_nearest_amounts(t, want):
    got = {k: v for k, v in listings.nearest_amounts(t).items() if v is not None}
    assert got == want


def test_year_table():
    t = "2022\n2024\n2023\nRevenue\n$1\n$3\n$2\nEBITDA\n$10\n$30\n$20\nrest"
    assert listings.year_table(t).split("\n") == ["Revenue: $3", "EBITDA: $30", "rest"]
