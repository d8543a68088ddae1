"""Views and ranked lists over deals and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmill.functions import money


def v_deals(deals: DataFrame) -> DataFrame:
    """``deals`` with earnings, their basis, and the margin on raw earnings."""
    e, s = F.col("ebitda"), F.col("sde")
    return deals.withColumns({"earnings": money.earnings(e, s), "earnings_basis": money.earnings_basis(e, s), "margin": money.margin(money.earnings(e, s), F.col("revenue"))})


def sources_concat(refs: DataFrame) -> DataFrame:
    """deal_id and its distinct sources, sorted and joined by commas."""
    return refs.groupBy("deal_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def ranked(deals: DataFrame) -> list[Column]:
    return [F.col("earnings").desc_nulls_last(), F.col("last_seen").desc_nulls_last(), F.col("id").desc()]


def list_deals(view: DataFrame, n: int | None = None) -> DataFrame:
    """Deals by earnings, then by last sight, then by id; with ``n`` a top-k and no full sort."""
    out = view.orderBy(*ranked(view))
    return out.limit(n) if n else out


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def attach_extras(view: DataFrame, verdicts: DataFrame, flags: DataFrame, outreach: DataFrame) -> DataFrame:
    """Deals with their members' verdicts and flags as maps, and the latest outreach.

    Each side is reduced to one row a deal before it joins, so no join multiplies rows.
    """
    as_map = lambda df, value, name: df.groupBy("deal_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", value)))).alias(name))
    last = latest(outreach, ["deal_id"], [F.desc("created_at"), F.desc("event_id")]).select("deal_id", F.col("outcome").alias("last_outcome"))
    return (
        view.join(as_map(verdicts, "action", "verdicts").withColumnRenamed("deal_id", "id"), "id", "left")
        .join(as_map(flags, "intent", "train_flags").withColumnRenamed("deal_id", "id"), "id", "left")
        .join(last.withColumnRenamed("deal_id", "id"), "id", "left")
    )


def review_stats(view: DataFrame, verdicts: DataFrame, member: str) -> DataFrame:
    """One row: all deals, to review, shortlisted, passed, and with needs, for a member."""
    own = verdicts.where(F.col("member") == member).select(F.col("deal_id").alias("id"), "action")
    d = view.join(own, "id", "left")
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("action").isNull()).alias("to_review"), F.count_if(F.col("action") == "short").alias("short"), F.count_if(F.col("action") == "pass").alias("passed"), F.count_if(F.size("needs_llm") > 0).alias("needs_info"))


def team_shortlist(verdicts: DataFrame, members: tuple[str, str]) -> DataFrame:
    """Deals that one member shortlists, or that both want to discuss; and whether they disagree."""
    a, b = (F.max(F.when(F.col("member") == m, F.col("action"))) for m in members)
    d = verdicts.groupBy("deal_id").agg(a.alias("a"), b.alias("b"))
    short = (F.col("a") == "short") | (F.col("b") == "short") | ((F.col("a") == "discuss") & (F.col("b") == "discuss"))
    return d.select("deal_id", F.coalesce(short, F.lit(False)).alias("shortlisted"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))


#: The stages of the pipeline in their order.
STAGES = ("inbox", "shortlist", "contacted", "nda", "cim", "call", "loi", "diligence", "offer", "closed", "dead")


def stage_groups(deals: DataFrame) -> DataFrame:
    """Deals on the board by stage, in the order of the stages."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")) - 1
    return deals.where("stage <> 'inbox'").groupBy("stage").agg(F.count("*").alias("deals"), F.sum("earnings").alias("earnings")).withColumn("place", place.cast("long")).orderBy("place")


def stage_dwell(events: DataFrame) -> DataFrame:
    """Each stage event with the stage it came from and the seconds since the last one of its deal."""
    w = Window.partitionBy("deal_id").orderBy("ts", "event_id")
    return events.select("deal_id", "event_id", "stage", F.lag("stage").over(w).alias("from_stage"), (F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))).alias("dwell_s"))


def source_bucket(text: Column, keys: tuple[str, ...], other: str = "newsletter") -> Column:
    """The first of the keys that the text holds when its white space is gone, else ``other``."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    out = F.lit(other)
    for k in reversed(keys):
        out = F.when(F.contains(s, F.lit(k)), k).otherwise(out)
    return out


def review_filters(view: DataFrame) -> DataFrame:
    """How many deals each review filter shows; ``fit_level``, ``surfaced``, ``action`` and ``needs_llm`` are read.

    A passed deal is shown by "passed" alone.
    """
    open_ = F.coalesce(F.col("action") != "pass", F.lit(True))
    filters = {
        "todo": F.col("action").isNull() & F.col("surfaced"),
        "priority": (F.col("fit_level") == "priority") & open_,
        "fits": F.col("fit_level").isin("priority", "fits") & open_,
        "unknown": (F.col("fit_level") == "unknown") & open_,
        "low": (F.col("fit_level") == "low") & open_,
        "out": (F.col("fit_level") == "out") & open_,
        "short": F.col("action") == "short",
        "discuss": F.col("action") == "discuss",
        "needs": (F.size("needs_llm") > 0) & open_,
        "passed": F.col("action") == "pass",
    }
    row = view.agg(*[F.count_if(c).alias(n) for n, c in filters.items()])
    return row.unpivot([], list(filters), "filter", "deals")


def flags_with_deals(flags: DataFrame, deals: DataFrame, order: str = "updated_at") -> DataFrame:
    """Training flags of known deals with the deals' own columns, newest first; a flag without a time comes last, ties by deal and member."""
    known = deals.select(F.col("id").alias("deal_id"), "ext_id", "title", "source", "sub_source", "nickname", "revenue", "ebitda", "sde", "asking", "blurb")
    return flags.join(known, "deal_id").orderBy(F.desc_nulls_last(order), "deal_id", "member")
