"""Queues, calls to action, survey counts, repairs and notes on flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.functions import mail, urls
from listingmill.operators.formats import Catalog, under

ACTIONABLE = ("shortlist", "contacted", "nda")


def playbook(source: Column, nickname: Column, url: Column, host: str, network: str) -> Column:
    """struct(id, label, href): pursue on one network, else open the listing; null without an address."""
    raw = F.nullif(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[).,;]+$", ""), F.lit(""))
    own = F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit(host)) | (F.lower(F.coalesce(nickname, F.lit(""))) == network.lower())
    label = F.coalesce(F.nullif(F.trim(nickname), F.lit("")), F.lit("listing"))
    swapped = F.regexp_replace(F.regexp_replace(raw, "(?i)action=decline", "action=pursue"), "(?i)utm_content=pass", "utm_content=pursue")
    out = F.when(own, F.struct(F.lit("pursue").alias("id"), F.lit(f"Pursue on {network}").alias("label"), swapped.alias("href"))).otherwise(F.struct(F.lit("listing").alias("id"), F.concat(F.lit("Open "), label).alias("label"), raw.alias("href")))
    return F.when(raw.isNotNull(), out)


def action_queue(deals: DataFrame, skipped: DataFrame, host: str, network: str) -> DataFrame:
    """Deals in an early stage with something to open, but those skipped."""
    d = deals.where(F.col("stage").isin(*ACTIONABLE)).where(playbook(F.col("source"), F.col("nickname"), F.col("url"), host, network).isNotNull())
    return d.join(skipped.select("id"), "id", "left_anti")


def thread_url(url: Column, account: str) -> Column:
    """A mail thread's link that opens in one account, from any link that names the thread."""
    key = F.regexp_extract(url, r"(?i)#(?:all|inbox|sent|search)/([a-zA-Z0-9]+)", 1)
    own = F.concat(F.lit(f"https://mail.google.com/mail/?authuser={account.replace('@', '%40')}#all/"), key)
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", F.lit(None)).when(F.contains(F.lower(url), F.lit("authuser=" + account.lower())), url).when(key != "", own).otherwise(F.trim(url))


def repair_counts(deals: DataFrame) -> DataFrame:
    """How many addresses still decline, and how many pursue."""
    u = F.col("url")
    bad = u.ilike("%action=decline%") | u.ilike("%utm_content=pass%")
    good = u.ilike("%action=pursue%") | u.ilike("%utm_content=pursue%")
    return deals.agg(F.count_if(bad).alias("bad"), F.count_if(good).alias("good"))


def append_absent(a: Column, b: Column) -> Column:
    """The first list followed by what it lacks of the second, in order, each once."""
    return F.array_distinct(F.concat(a, b))


# What a message is asked for, by name; the first part of the body alone for the last two.
SIGNALS = {
    "has_asking_price": r"asking\s*price\s*:",
    "has_new_business_matches": r"\bnew business matches?\b",
    "has_match_search_criteria": r"match your search criteria",
    "has_in_todays_issue": r"in today[’']?s issue",
    "has_new_listing": r"(?m)^new listing\b",
    "has_nda": r"sign\s+(?:the\s+)?nda|\bcim\b",
    "has_money": r"\$\s?[\d,]+",
    "has_franchise_section": r"franchise\s+(?:opportunit|listing)",
}
NUMBERED = r"(?m)^#\d+:"


def signals(messages: DataFrame, scan: int | None = 8000) -> DataFrame:
    """Messages with what their first ``scan`` characters hold (None: all of them): a column for each of ``SIGNALS``, and the number of numbered items."""
    body = F.coalesce("body", F.lit(""))
    d = messages.withColumn("_hay", F.lower(F.concat_ws(" ", "sender", "subject", F.substring(body, 1, scan) if scan else body)))
    found = {name: F.col("_hay").rlike(pattern) for name, pattern in SIGNALS.items()}
    return d.withColumns(found | {"numbered_items": F.regexp_count("_hay", F.lit(NUMBERED))}).drop("_hay")


def field_presence(messages: DataFrame, labels: dict[str, str]) -> DataFrame:
    """How many bodies hold each label, in one pass."""
    row = messages.agg(*[F.count_if(F.col("body").rlike("(?m)" + p)).alias(n) for n, p in labels.items()])
    return row.unpivot([], list(labels), "field", "messages")


def shape_counts(messages: DataFrame, shapes: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Messages by the first shape (name, pattern of the address, pattern of the subject) that fits, else by address."""
    a = mail.address(F.col("sender"))
    shape = F.coalesce(*[F.when(a.rlike(x) & F.coalesce("subject", F.lit("")).rlike(y or "(?s)^"), F.lit(n)) for n, x, y in shapes], F.concat(F.lit("other:"), a))
    return messages.groupBy(shape.alias("shape")).agg(F.count("*").alias("messages"))


def learned_points(text: Column, learned: tuple[tuple[str, int, int], ...], least: int = 3, cap: int = 25) -> Column:
    """Sum of the weights, within the cap, of patterns with enough evidence that a lower-case text holds."""
    return sum((F.when(F.contains(text, F.lit(p.lower())), max(-cap, min(cap, w))).otherwise(0) for p, n, w in learned if n >= least), F.lit(0))


def mark_skips(deals: DataFrame, marks: DataFrame) -> DataFrame:
    """``deals`` with rejected and reject_reason set for marked ones that were not rejected before."""
    m = marks.select("id", F.col("reason").alias("_reason"))
    new = F.col("_reason").isNotNull() & ~F.col("rejected")
    return deals.join(m, "id", "left").withColumns({"reject_reason": F.when(new, F.col("_reason")).otherwise(F.col("reject_reason")), "rejected": F.col("rejected") | new}).drop("_reason")


# What to look at for each kind of complaint, by the reason that reviewers choose.
FOCUS = {
    "EBITDA, Rev, Asking Price": ("ebitda", "sde", "revenue", "asking", "expected_fields.absent", "gotchas"),
    "Location": ("location", "city", "state", "county", "detect.body_open", "gotchas"),
    "Blurb": ("title", "blurb", "detect.subject_patterns", "gotchas"),
    "Duplicate listing": ("dedupe", "ext_id", "url"),
    "Not a real deal": ("email_type", "status", "split", "control"),
    "Other": ("gotchas", "detect", "expected_fields"),
}


def focus_fields(reason: Column) -> Column:
    out = F.array(*[F.lit(x) for x in FOCUS["Other"]])
    for k, v in FOCUS.items():
        out = F.when(reason == k, F.array(*[F.lit(x) for x in v])).otherwise(out)
    return out


def suggested_note(reason: Column, detail: Column, title: Column) -> Column:
    return F.substring(F.concat(F.lit("Train ("), reason, F.lit("): "), F.coalesce(F.nullif(F.trim(detail), F.lit("")), title)), 1, 280)


def format_of(catalog: Catalog, source: Column, sub_source: Column, nickname: Column) -> Column:
    """The format behind a stored deal: by mailbox, by its subcategory's default, by nickname, by domain if one is active."""
    exact = [F.when(sub_source == a, F.lit(f.id)) for f in catalog.formats for a in (*f.addresses, *((f.sub_source,) if f.sub_source and "*" not in f.sub_source else ()))]
    default = [F.when(sub_source.rlike(("^" if "*" not in s.mailbox else r"@(?:.*\.)?") + s.mailbox.replace("*@", "").replace(".", r"\.") + "$"), F.lit(s.default_format)) for s in catalog.subcategories if s.default_format]
    named = [F.when(nickname == n, F.lit(f.id)) for d, n in catalog.nicknames for f in catalog.formats if f.status == "active" and (d in f.domains or d == f.source)]
    domain = [F.when(under(source, d), F.lit(f.id)) for f in catalog.formats if f.status == "active" for d in f.domains]
    return F.coalesce(*exact, *default, *named, *domain, F.lit(None).cast("string"))


def catalog_summary(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Formats by family, and how many of them are active."""
    rows = spark.createDataFrame([(f.family, f.status) for f in catalog.formats], "family string, status string")
    return rows.groupBy("family").agg(F.count("*").alias("formats"), F.count_if(F.col("status") == "active").alias("active"))
