"""Writes with merge semantics, as plans that return the new table.

File tables have no MERGE, so an upsert is a full outer join on the key; a batch is reduced to
one row a key first, in its own order, which is what row-by-row writes would have left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW_WINS = ("city", "state", "county", "revenue", "ebitda", "sde", "asking", "url", "blurb", "source", "sub_source", "nickname")


def last_known(batch: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a key: for each column the last value that is not null."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return batch.groupBy(key).agg(*aggs)


def upsert_new_wins(stored: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert on ext_id: new values win over old ones unless they are null.

    Rows without ext_id or title, or titled "location: ...", are left out. The title is always
    new, times and sights take the greater, old model labels count as blank.
    """
    ok = (F.trim(F.coalesce("ext_id", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "") & ~F.lower(F.trim("title")).startswith("location:")
    model = F.when(~F.trim(F.coalesce("business_model_type", F.lit(""))).isin("", "AMBIGUOUS", "LOCATION_AGNOSTIC"), F.col("business_model_type"))
    b = batch.where(ok).withColumn("business_model_type", model)
    columns = [*NEW_WINS, "title", "business_model_type", "last_seen", "times_seen", "first_seen"]
    reduced = b.groupBy("ext_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns if c not in ("last_seen", "times_seen", "first_seen")],
        F.max("last_seen").alias("last_seen"),
        F.max("times_seen").alias("times_seen"),
        F.min_by("first_seen", order).alias("first_seen"),
    )
    o, n = stored.alias("o"), reduced.alias("n")
    j = o.join(n, "ext_id", "full_outer")
    old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    return j.select(
        "ext_id",
        F.coalesce(new("title"), old("title")).alias("title"),
        *[F.coalesce(new(c), old(c)).alias(c) for c in NEW_WINS],
        F.coalesce(new("business_model_type"), old("business_model_type")).alias("business_model_type"),
        F.coalesce(old("first_seen"), new("first_seen")).alias("first_seen"),
        F.greatest(new("last_seen"), old("last_seen")).alias("last_seen"),
        F.greatest(new("times_seen"), old("times_seen")).alias("times_seen"),
    )


def fill_nulls(stored: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``stored`` with nulls filled from ``found`` (one row a key); what is known stays."""
    n = found.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return stored.join(n, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def fold_verdicts(events: DataFrame) -> DataFrame:
    """The last action of each member on each deal, by the events' own time as text, file and position; a null action deletes."""
    w = Window.partitionBy("deal_id", "member").orderBy(F.desc("at"), F.desc("file"), F.desc("pos"))
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 AND action IS NOT NULL").drop("_rn")


def apply_verdicts(stored: DataFrame, batch: DataFrame, deals: DataFrame, members: tuple[str, ...], actions: tuple[str, ...] = ("short", "discuss", "pass")) -> DataFrame:
    """Verdicts after a batch: valid ones on known deals win if strictly newer than what is stored."""
    ok = batch.where(F.col("member").isin(*members) & F.col("action").isin(*actions)).join(deals.select(F.col("id").alias("deal_id")), "deal_id", "left_semi")
    both = stored.withColumn("_old", F.lit(1)).withColumn("_pos", F.lit(-1).cast("long")).unionByName(ok.withColumn("_old", F.lit(0)).withColumn("_pos", F.col("pos")).drop("pos"))
    w = Window.partitionBy("deal_id", "member").orderBy(F.desc("updated_at"), F.desc("_old"), "_pos")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_old", "_pos")


def verdict_rules(batch: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """A pass keeps its reason if it is a known one; notes of 500 characters stay on the other two; a null action clears."""
    keep = F.col("action").isin("short", "discuss")
    return batch.withColumns({"reason": F.when((F.col("action") == "pass") & F.col("reason").isin(*reasons), F.col("reason")), "note": F.when(keep, F.substring("note", 1, 500)), "clears": F.col("action").isNull()})


def purge_like(deals: DataFrame, term: str, columns: tuple[str, ...] = ("source", "sub_source", "nickname", "url", "ext_id")) -> DataFrame:
    """``deals`` without the rows that hold a term in any of the columns, in any case."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
    return deals.where(~hit)


def stage_from_outcomes(outcomes: Column) -> Column:
    """Dead on either ending, else the furthest of materials, agreement, contact; null if none is named."""
    has = lambda v: F.array_contains(outcomes, v)
    return F.when(has("not_pursuing") | has("unavailable"), "dead").when(has("cim_received"), "cim").when(has("nda_signed"), "nda").when(has("messaged") | has("waiting"), "contacted")


#: An event moves a deal to a stage only from an earlier one of these.
MOVES = (("nda_available", "contacted", ("inbox", "shortlist")), ("nda_signed", "nda", ("inbox", "shortlist", "contacted")), ("cim_received", "cim", ("inbox", "shortlist", "contacted", "nda")))


def forward_stage(stage: Column, event: Column) -> Column:
    out = stage
    for name, to, earlier in MOVES:
        out = F.when((event == name) & stage.isin(*earlier), to).otherwise(out)
    return out


def fold_stages(start: DataFrame, events: DataFrame) -> DataFrame:
    """deal_id and its stage after all events in order, from the stage in ``start`` ("inbox" if it has none).

    Every move goes forward to a fixed stage, so the fold is the furthest stage that an event
    may reach: a maximum, which Spark combines before the shuffle. A stage beyond the moves'
    range never changes.
    """
    order = ("inbox", "shortlist", "contacted", "nda", "cim")
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    to = F.lit(None).cast("long")
    for name, stage, _ in MOVES:
        to = F.when(F.col("event_type") == name, order.index(stage) + 1).otherwise(to)
    reach = events.withColumn("_to", to).groupBy("deal_id").agg(F.max("_to").alias("_to"))
    d = start.join(reach, "deal_id", "full_outer").withColumn("stage", F.coalesce("stage", F.lit("inbox")))
    best = F.greatest(rank, F.coalesce("_to", F.lit(0)))
    return d.select("deal_id", F.when(rank > 0, F.get(F.array(*[F.lit(s) for s in order]), (best - 1).cast("int"))).otherwise(F.col("stage")).alias("stage"))
