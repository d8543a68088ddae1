"""Events of pursued deals, applied as they come: batches with a log, links, stages and files as their outputs, and tables of what they leave to know."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmill.operators.merge import MOVES

LINK_EVENTS = ("nda_available", "nda_signed")
#: Stages that events move through, in order; every move's earlier stages are all of those before it.
STAGES = ("inbox", "shortlist", "contacted", "nda", "cim")
#: Every so many batches what is known is written whole, and what has expired is left out.
WHOLE = 16
_LINK = "struct<ms: bigint, msg_id: string, url: string>"
_DEALS, _SEEN = f"key string, known struct<stage: string, nda: {_LINK}, thread: {_LINK}, step: bigint, newest: bigint>", "key string, msg_id string, ms long"


def apply_events(events: DataFrame, stages: DataFrame | None = None, ttl: str = "90 days") -> DataFrame:
    """``events`` as ``write_applied`` takes them, a batch at a time, in the order of the batches.

    ``events``: msg_id, deal_id (null where none matches), event_type, at, nda_url, thread_url, file. ``stages``: deal_id, stage that a deal of which nothing is known begins
    with, one row a deal; "inbox" without. A message that came before is a duplicate and does nothing; one without id or time is left out, and so is one
    ``ttl`` older than the newest of earlier batches, since nothing is known any more of what came before it. Stages go
    forward only, to "cim" only with a file; a link gives way to one of a later time, so the end does not depend on the order of delivery. Events without a
    deal are told apart by their message, so no key holds them all.
    """
    if stages is not None:
        events = events.join(stages.where("deal_id IS NOT NULL").select("deal_id", F.col("stage").alias("start")), "deal_id", "left")
    else:
        events = events.withColumn("start", F.lit(None).cast("string"))
    key = F.when(F.col("deal_id").isNull(), F.concat(F.lit("msg:"), "msg_id")).otherwise(F.concat(F.lit("deal:"), F.col("deal_id").cast("string")))
    ttl_ms = F.lit(int(pd.Timedelta(ttl).total_seconds() * 1000)).cast("long").alias("ttl_ms")
    return events.where("msg_id IS NOT NULL AND at IS NOT NULL").select(key.alias("key"), "msg_id", "deal_id", "event_type", "at", F.unix_millis("at").alias("ms"), "nda_url", "thread_url", "file", "start", ttl_ms)


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def applied(events: DataFrame, deals: DataFrame, seen: DataFrame, newest: int | None) -> DataFrame:
    """What each event of a batch does to its deal: its status, its file where that is saved, and what is known of the deal after it (``now``).

    ``deals`` (key, known) and ``seen`` (key, msg_id, ms) are of the batches before, ``newest`` is their latest time. Events of a deal count in the order of their times.
    What is known goes ahead of the events of its key, so all of it is one shuffle, and running counts and maxima over the rows of a key.
    """
    if newest is not None:
        events = events.where(F.col("ms") > F.lit(newest) - F.col("ttl_ms"))
    rows = deals.withColumn("kind", F.lit(0)).unionByName(seen.withColumn("kind", F.lit(1)), True).unionByName(events.withColumn("kind", F.lit(2)), True)
    own = Window.partitionBy("key")
    rows = rows.withColumns({"known": F.max("known").over(own), "start": F.max("start").over(own), "ttl_ms": F.max("ttl_ms").over(own)})
    is_event, matched = F.col("kind") == 2, ~F.col("key").startswith("msg:")
    ties = ("event_type", "nda_url", "thread_url", "file")
    # a deal remembers the messages of the last ttl before its newest one; a message without a deal is remembered for as long as it might come again
    held = F.when(matched, F.col("ms") >= F.col("known.newest") - F.col("ttl_ms")).otherwise(F.col("ms") + 2 * F.col("ttl_ms") > F.lit(newest))
    same = Window.partitionBy("key", "msg_id").orderBy("kind", "ms", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max((F.col("kind") == 1) & F.coalesce(held, F.lit(False))).over(same) | (F.count(F.when(is_event, 1)).over(same) > 1)
    rows = rows.withColumn("again", before)

    run = Window.partitionBy("key").orderBy("kind", "ms", "msg_id", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = is_event & matched & ~F.col("again")
    link = lambda url, when: F.max(F.when(counts & _some(url) & when, F.struct("ms", "msg_id", F.col(url).alias("url")))).over(run)
    reach = F.lit(None).cast("int")
    for name, to, _ in MOVES:
        reach = F.when((F.col("event_type") == name) & (_some("file") if name == "cim_received" else F.lit(True)), STAGES.index(to)).otherwise(reach)
    first = F.coalesce("known.stage", F.nullif("start", F.lit("")), F.lit("inbox"))
    place = (F.array_position(F.array(*[F.lit(s) for s in STAGES]), first) - 1).cast("int")
    reached = F.greatest(place, F.max(F.when(counts, reach)).over(run))
    now = F.struct(
        F.when(place < 0, first).otherwise(F.get(F.array(*[F.lit(s) for s in STAGES]), reached)).alias("stage"),
        F.greatest("known.nda", link("nda_url", F.col("event_type").isin(*LINK_EVENTS))).alias("nda"),
        F.greatest("known.thread", link("thread_url", F.lit(True))).alias("thread"),
        (F.coalesce("known.step", F.lit(0)) + F.count(F.when(is_event, 1)).over(run)).alias("step"),
        F.greatest("known.newest", F.max(F.when(is_event & ~F.col("again"), F.col("ms"))).over(run)).alias("newest"),
    )
    status = F.when(F.col("again"), "duplicate").when(matched, "applied").otherwise("unmatched")
    saved = F.when((status == "applied") & (F.col("event_type") == "cim_received"), F.col("file"))
    out = rows.select("kind", "key", "msg_id", "deal_id", "event_type", "at", "ms", "ttl_ms", status.alias("status"), saved.alias("saved_file"), now.alias("now"))
    return out.where("kind = 2").drop("kind")


def write_applied(df: DataFrame, number: int, folder: str) -> None:
    """A batch's outputs, under its number: the log of all events, deals as they are now, saved files; and under ``state`` what later batches have to know.

    Batches have running numbers from 0. What is known is the batch's own rows, every ``WHOLE`` batches all rows that have not expired, so a batch reads at most
    so many folders. A batch that is tried again reads the same folders and writes the same folders.
    """
    spark = df.sparkSession
    names = range((number - 1) // WHOLE * WHOLE, number) if number else ()

    def known(what: str, schema: str) -> DataFrame:
        if not names:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{folder}/state/{what}/batch_no={k}" for k in names])

    last = lambda rows: rows.groupBy("key").agg(F.max_by("known", F.col("known.step")).alias("known"))
    newest = spark.read.schema("newest long").parquet(f"{folder}/state/clock/batch_no={number - 1}").first()[0] if number else None
    deals, seen = last(known("deals", _DEALS)), known("seen", _SEEN)
    rows = applied(df, deals, seen, newest).persist()
    rows.select("msg_id", "deal_id", "event_type", "at", "status").write.mode("overwrite").parquet(f"{folder}/log/batch_no={number}")
    now = rows.where("status = 'applied'").groupBy("deal_id").agg(F.max_by("now", F.col("now.step")).alias("d"))
    now.select("deal_id", "d.stage", F.col("d.nda.url").alias("nda_url"), F.col("d.thread.url").alias("thread_url"), "d.step").write.mode("overwrite").parquet(f"{folder}/deals/batch_no={number}")
    rows.where("saved_file IS NOT NULL").select("deal_id", "msg_id", F.col("saved_file").alias("file")).write.mode("overwrite").parquet(f"{folder}/files/batch_no={number}")

    fresh = rows.where("deal_id IS NOT NULL").select("key", F.col("now").alias("known"))
    new = rows.where("status <> 'duplicate' OR deal_id IS NULL").select("key", "msg_id", "ms")
    latest, ttl_ms = rows.agg(F.max("ms"), F.max("ttl_ms")).first()
    newest = max((x for x in (newest, latest) if x is not None), default=None)
    whole = number > 0 and number % WHOLE == 0
    if whole:
        fresh, new = fresh.unionByName(deals), new.unionByName(seen)
    fresh = last(fresh)
    fresh.write.mode("overwrite").parquet(f"{folder}/state/deals/batch_no={number}")
    if whole and ttl_ms is not None:
        ends = spark.read.schema(_DEALS).parquet(f"{folder}/state/deals/batch_no={number}").select("key", F.col("known.newest").alias("_newest"))
        kept = new.join(ends, "key", "left").where(F.coalesce(F.col("ms") >= F.col("_newest") - ttl_ms, F.col("ms") + 2 * ttl_ms > F.lit(newest)))
        new = kept.groupBy("key", "msg_id").agg(F.max("ms").alias("ms"))
    new.write.mode("overwrite").parquet(f"{folder}/state/seen/batch_no={number}")
    spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/clock/batch_no={number}")
    rows.unpersist()
