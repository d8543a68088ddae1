"""Enrichment: which deals to look up, the join with what was found, and the update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.functions import money, text, urls
from listingmill.operators.merge import fill_nulls
from listingmill.operators.rules import headline_reject


def candidates(view: DataFrame, host: str, n: int | None = None) -> DataFrame:
    """Deals of one marketplace that lack earnings, an asking price or a real blurb and are not out of the box.

    Ordered newest first; ``n`` counts rows kept after all tests.
    """
    short = F.col("earnings").isNull() | F.col("asking").isNull() | text.blurb_is_thin(F.col("title"), F.col("blurb"))
    d = view.where(F.contains(F.lower(F.coalesce("url", F.lit(""))), F.lit(host))).where(short).where(headline_reject(F.col("title"), F.col("blurb")).isNull())
    d = d.withColumn("listing_id", urls.listing_id(F.col("url")))
    return d.orderBy(F.desc("last_seen"), F.desc("id")).limit(n) if n else d


def map_items(items: DataFrame) -> DataFrame:
    """Scraped items under their alias names as (listing_id, asking, sde, ebitda, revenue, blurb, seq)."""
    pick = lambda *names: F.coalesce(*[money.plain_amount(F.col(x)) for x in names if x in items.columns], F.lit(None).cast("double"))
    texts = [F.col(x) for x in ("fullDescription", "shortDescription", "description") if x in items.columns]
    return items.select(urls.listing_id(F.col("url")).alias("listing_id"), pick("askingPrice", "price").alias("asking"), pick("cashFlow", "sde").alias("sde"), pick("ebitda").alias("ebitda"), pick("grossRevenue", "revenue").alias("revenue"), F.coalesce(*texts, F.lit(None).cast("string")).alias("blurb"), "seq")


def latest_items(items: DataFrame) -> DataFrame:
    """The last item of each listing."""
    cols = [c for c in items.columns if c not in ("listing_id", "seq")]
    return items.where("listing_id <> ''").groupBy("listing_id").agg(F.max_by(F.struct(*cols), "seq").alias("_i")).select("listing_id", "_i.*")


def apply(deals: DataFrame, items: DataFrame) -> DataFrame:
    """``deals`` (with listing_id) with nulls filled, thin blurbs replaced, and "earnings" struck from the needs once known."""
    found = latest_items(items)
    d = fill_nulls(deals, found.select("listing_id", "asking", "sde", "ebitda", "revenue"), "listing_id", ["asking", "sde", "ebitda", "revenue"])
    d = d.join(found.select("listing_id", F.col("blurb").alias("_blurb")), "listing_id", "left")
    better = text.listing_blurb(F.col("_blurb"), F.col("title"))
    blurb: Column = F.when(text.blurb_is_thin(F.col("title"), F.col("blurb")), F.coalesce(better, F.col("blurb"))).otherwise(F.col("blurb"))
    needs = F.when(F.coalesce("ebitda", "sde").isNotNull(), F.array_remove("needs_llm", "earnings")).otherwise(F.col("needs_llm"))
    return d.withColumns({"blurb": blurb, "needs_llm": needs}).drop("_blurb")
