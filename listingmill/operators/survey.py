"""Counts of a surveyed mailbox, of a run, proposals for formats that are not known, and notes for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmill.functions import mail, text

RUN_KEYS = ("source", "sub_source", "nickname", "family", "format_id", "email_type")


def survey_counts(messages: DataFrame) -> DataFrame:
    """(kind, value, messages, zero): messages by domain, address and nickname, and in all, with how many kept no listing."""
    long = messages.select(
        (F.coalesce("kept_listings", F.lit(0)) == 0).alias("zero"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit("")).alias("value")) for k, c in (("domain", "source"), ("email", "sub_source"), ("nickname", "nickname"))], F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")))).alias("k"),
    )
    return long.groupBy("k.kind", "k.value").agg(F.count("*").alias("messages"), F.count_if("zero").alias("zero"))


def run_counts(listings: DataFrame, merged: str = "n_merged") -> DataFrame:
    """raw, kept and merged of a run, from its kept listings and how many each took in."""
    return listings.agg((F.count("*") + F.coalesce(F.sum(merged), F.lit(0))).alias("raw"), F.count("*").alias("kept"), F.coalesce(F.sum(merged), F.lit(0)).cast("long").alias("merged"))


def run_counts_by(listings: DataFrame, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """(kind, value, n): listings of a run by each key, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("value")) for k in keys]))
    return listings.select(pairs.alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def classified_counts(messages: DataFrame) -> DataFrame:
    """(what, value, n) of messages matched to formats: by subcategory, by format, unmatched, known formats without a parser, and control formats that yield."""
    matched = F.coalesce(F.col("format_id"), F.lit("")) != ""
    facts = F.array_compact(
        F.array(
            F.when(matched, F.struct(F.lit("subcategory").alias("what"), F.coalesce(F.nullif("subcategory", F.lit("")), F.lit("(none)")).alias("value"))),
            F.struct(F.lit("format").alias("what"), F.when(matched, F.col("format_id")).otherwise("(unmatched)").alias("value")),
            F.when(~matched, F.struct(F.lit("unmatched").alias("what"), F.lit("").alias("value"))),
            F.when(F.col("status") == "needs_parser", F.struct(F.lit("needs_parser").alias("what"), F.lit("").alias("value"))),
            F.when((F.col("status") == "control") & (F.coalesce("kept_listings", F.lit(0)) > 0), F.struct(F.lit("bad_control").alias("what"), F.lit("").alias("value"))),
        )
    )
    return messages.select(F.explode(facts).alias("f")).groupBy("f.what", "f.value").agg(F.count("*").alias("n"))


def proposals(messages: DataFrame, subjects: int = 5, openings: int = 3) -> DataFrame:
    """A draft for each mailbox whose mail matches no format: its count, first subjects and openings (by seq), and the entry to fill in.

    Only the rows of the first places of a mailbox are gathered, so a mailbox with a third of all mail is no large group.
    """
    un = messages.where(F.coalesce(F.col("format_id"), F.lit("")) == "").withColumn("mailbox", F.lower(F.coalesce(F.nullif("sub_source", F.lit("")), F.nullif("source", F.lit("")), F.lit("unknown"))))
    counts = un.groupBy("mailbox").agg(F.count("*").alias("messages"))
    place = F.row_number().over(Window.partitionBy("mailbox").orderBy("seq"))
    head = un.select("mailbox", "seq", "source", "sub_source", "subject", "opening").withColumn("_at", place).where(F.col("_at") <= max(subjects, openings))
    pick = lambda c, n: F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.when((F.col("_at") <= n) & (F.coalesce(c, F.lit("")) != ""), F.col(c)).alias("v")))), lambda x: x["v"]))
    first = head.groupBy("mailbox").agg(pick("subject", subjects).alias("subjects"), pick("opening", openings).alias("openings"), F.min_by("source", "_at").alias("source"), F.min_by("sub_source", "_at").alias("sub_source"))
    return counts.join(first, "mailbox").select("mailbox", "messages", "subjects", "openings", stub(F.col("source"), F.col("sub_source")).alias("draft"))


def stub(domain: Column, address: Column) -> Column:
    """The entry of the catalog that a person fills in for a mailbox: id, source, sub_source, subcategory, nickname, and what it is found by."""
    dom, addr = F.coalesce(domain, F.lit("")), F.coalesce(address, F.lit(""))
    core = mail.domain_core(dom)
    slug = F.when(addr != "", text.mailbox_slug(addr)).otherwise("any")
    wild = F.when(addr != "", addr).when(dom != "", F.concat(F.lit("*@"), dom)).otherwise("unknown")
    return F.struct(
        F.concat_ws(".", F.when(core != "", core).otherwise("unknown"), slug).alias("id"),
        F.lit("newsletter").alias("family"),
        F.when(dom != "", dom).otherwise("unknown").alias("source"),
        wild.alias("sub_source"),
        slug.alias("subcategory"),
        F.initcap(core).alias("nickname"),
        F.lit("single_listing").alias("email_type"),
        F.lit("needs_samples").alias("status"),
        F.array_compact(F.array(F.when((addr != "") & ~addr.startswith("*"), addr))).alias("addresses"),
        F.array_compact(F.array(F.when(dom != "", dom))).alias("domains"),
        F.lit("newsletter").alias("split"),
    )


def review_notes(flags: DataFrame, gotchas: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(name, note): a note in Markdown for each flag (deal_id, ext_id, reason, detail, format_id, source, sub_source, title, focus, checklist), with what
    ``gotchas`` (format_id, gotchas) knows of its format, and the columns to ``keep``. The table of formats is configuration; Spark broadcasts it where it is small.
    """
    f = flags.join(gotchas, "format_id", "left")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c)
    known = F.col("gotchas").isNotNull()
    entry = F.coalesce(F.nullif("format_id", F.lit("")), F.lit("(unmatched)"))
    bullets = lambda c, mark: F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x)), "\n")
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    section = lambda title, body: F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))
    said = F.when(text_of("detail") != "", text_of("detail")).when(text_of("title") != "", text_of("title")).otherwise("see deal")
    note = F.concat_ws(
        "\n",
        F.lit("# Training flag for review\n"),
        F.concat_ws("\n", line("deal_id", text_of("deal_id")), line("ext_id", text_of("ext_id")), line("reason", text_of("reason")), line("detail", text_of("detail")), line("format_id", entry), line("source / sub_source", F.concat_ws(" / ", text_of("source"), text_of("sub_source"))), line("title", text_of("title"))),
        F.lit(""),
        F.when(some(F.col("focus")), section("Focus fields", bullets("focus", "- "))),
        F.when(some(F.col("checklist")), section("Inspection checklist", bullets("checklist", "- [ ] "))),
        F.when(known, section("Current gotchas", F.when(some(F.col("gotchas")), bullets("gotchas", "- ")).otherwise("- (none)"))),
        F.when(known, section("Gotcha to append", F.concat(F.lit("- "), text_of("reason"), F.lit(": "), said))),
        F.when(~known, section("Action", F.lit("- No format matched: survey the mailbox and propose one."))),
    )
    slug = F.substring(F.regexp_replace(F.lower(F.concat_ws("_", text_of("deal_id"), text_of("reason"))), r"[^a-z0-9]+", "-"), 1, 60)
    return f.select(*(keep or []), slug.alias("name"), note.alias("note"))
