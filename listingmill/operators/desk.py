"""What reviewers write: verdicts, stages, flags, notes, files, corrections, deals of their own; each a batch merged into a table.

A batch is in the order of its ``seq``. Every write returns the new table, and where it also
appends events, those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest file that is stored.
MOST_BYTES = 4 << 20
CORRECTABLE = ("title", "blurb", "revenue", "ebitda", "sde", "asking")


def _latest(batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key."""
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), "seq").alias("_v")).select(*keys, "_v.*")


def replace_rows(stored: DataFrame, batch: DataFrame, keys: list[str], clears: str | None = None) -> DataFrame:
    """``stored`` with the last row of each key of the batch in place of its own; where ``clears`` holds, with none."""
    columns = [c for c in stored.columns if c not in keys]
    own = columns + ([clears] if clears else [])
    last = _latest(batch, keys, own)
    kept = stored.join(last.select(*keys), keys, "left_anti")
    new = last.where(~F.coalesce(F.col(clears), F.lit(False))) if clears else last
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def move_stage(deals: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deals after moves (seq, deal_id, stage, member, at, only_from), and the events (deal_id, from_stage, to_stage, member, at, seq).

    A move of an unknown deal, to the stage the deal has, or with an ``only_from`` that is another stage, does nothing. The moves
    of one deal are few (people make them) and are taken in order.
    """
    start = deals.select(F.col("id").alias("deal_id"), F.col("stage").alias("_start"))
    made = moves.join(start, "deal_id").groupBy("deal_id").agg(F.first("_start").alias("_start"), F.sort_array(F.collect_list(F.struct("seq", "stage", "member", "at", "only_from"))).alias("_moves"))
    none = F.array().cast("array<struct<from_stage:string,to_stage:string,member:string,at:timestamp,seq:bigint>>")

    def step(acc, m):
        goes = (m["stage"] != acc["stage"]) & (m["only_from"].isNull() | (m["only_from"] == acc["stage"]))
        event = F.struct(acc["stage"].alias("from_stage"), m["stage"].alias("to_stage"), m["member"].alias("member"), m["at"].cast("timestamp").alias("at"), m["seq"].cast("bigint").alias("seq"))
        return F.struct(F.when(goes, m["stage"]).otherwise(acc["stage"]).alias("stage"), F.when(goes, F.concat(acc["events"], F.array(event))).otherwise(acc["events"]).alias("events"))

    folded = made.select("deal_id", F.reduce("_moves", F.struct(F.col("_start").alias("stage"), none.alias("events")), step).alias("_f"))
    events = folded.select("deal_id", F.explode("_f.events").alias("e")).select("deal_id", "e.*")
    last = events.groupBy("deal_id").agg(F.max_by(F.struct("to_stage", "member", "at"), "seq").alias("_l"))
    d = deals.join(last, deals["id"] == last["deal_id"], "left")
    moved = {"stage": F.coalesce("_l.to_stage", "stage"), "stage_changed_at": F.col("_l.at"), "stage_changed_by": F.col("_l.member")}
    for c in ("stage_changed_at", "stage_changed_by"):
        if c in deals.columns:
            moved[c] = F.coalesce(moved[c], deals[c])
    return d.withColumns(moved).drop("deal_id", "_l"), events


def set_verdicts(verdicts: DataFrame, deals: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts, deals and stage events after a batch (seq, deal_id, member, action, reason, note, updated_at).

    The last verdict of a member on a deal stands, a null action clears it, and every shortlisting moves a deal from the inbox to the shortlist.
    """
    b = batch.withColumn("_clear", F.col("action").isNull())
    after = replace_rows(verdicts, b, ["deal_id", "member"], "_clear")
    shorts = batch.where("action = 'short'").select("seq", "deal_id", F.lit("shortlist").alias("stage"), "member", F.col("updated_at").alias("at"), F.lit("inbox").alias("only_from"))
    return after, *move_stage(deals, shorts)


def set_train_flags(flags: DataFrame, batch: DataFrame) -> DataFrame:
    """The last flag of each member on each deal; an intent belongs to criteria alone; a null reason clears."""
    b = batch.withColumns({"theme": F.coalesce("theme", F.lit("listing")), "_clear": F.col("reason").isNull()})
    b = b.withColumn("criteria_intent", F.when(F.col("theme") == "criteria", F.col("criteria_intent")))
    return replace_rows(flags, b, ["deal_id", "member"], "_clear")


def correct_listings(deals: DataFrame, batch: DataFrame) -> DataFrame:
    """Deals with the fields that a correction names: (seq, deal_id, fields, and a column each); a field named may be null."""
    aggs = [F.max_by(F.struct(F.lit(True).alias("set"), F.col(c).alias("v")), F.when(F.array_contains("fields", c), F.col("seq"))).alias(f"_{c}") for c in CORRECTABLE]
    last = batch.groupBy("deal_id").agg(*aggs)
    d = deals.join(last, deals["id"] == last["deal_id"], "left")
    return d.withColumns({c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in CORRECTABLE}).drop("deal_id", *[f"_{c}" for c in CORRECTABLE])


def add_notes(notes: DataFrame, batch: DataFrame) -> DataFrame:
    """Notes with a batch (deal_id, member, body, at) appended, trimmed."""
    return notes.unionByName(batch.select("deal_id", "member", F.trim("body").alias("body"), "at"))


def save_files(files: DataFrame, deals: DataFrame, batch: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with those of a batch (seq, deal_id, member, kind, filename, content_type, content) that are not too large, deals that point to
    their last one, and the rows that were too large."""
    ok = F.octet_length("content") <= most_bytes
    fresh = batch.where(ok).withColumn("file_id", F.substring(F.sha2(F.concat_ws("/", F.col("deal_id").cast("string"), F.col("seq").cast("string"), "filename"), 256), 1, 16))
    last = fresh.groupBy("deal_id").agg(F.max_by("file_id", "seq").alias("_file"))
    d = deals.join(last, deals["id"] == last["deal_id"], "left").withColumn("cim_url", F.coalesce(F.concat(F.lit("/api/deal-files/"), "_file"), deals["cim_url"] if "cim_url" in deals.columns else F.lit(None)))
    columns = ["file_id", "deal_id", "member", "kind", "filename", "content_type", "content"]
    return files.unionByName(fresh.select(*columns)), d.drop("deal_id", "_file"), batch.where(~F.coalesce(ok, F.lit(False)))


def deals_from_documents(drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New deals of reviewed drafts (draft_id, member, title, blurb, city, state, revenue, ebitda, sde, asking, business_model_type, url, at),
    their first stage events, and the verdicts that put them on their member's list. A draft without a title makes none.
    """
    d = drafts.where(F.trim(F.coalesce("title", F.lit(""))) != "")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    needs = F.array_compact(F.array(F.when(F.coalesce("ebitda", "sde").isNull(), "earnings"), F.when(blank("state").isNull(), "location")))
    deals = d.select(
        F.concat(F.lit("cim:"), "draft_id").alias("ext_id"), F.trim("title").alias("title"), blank("blurb").alias("blurb"), F.lit("manual").alias("source"), F.col("member").alias("sub_source"), F.lit("CIM upload").alias("nickname"),
        blank("city").alias("city"), blank("state").alias("state"), F.lit(None).cast("string").alias("county"), "revenue", "ebitda", "sde", "asking",
        F.coalesce(blank("business_model_type"), F.lit("")).alias("business_model_type"), needs.alias("needs_llm"), blank("url").alias("url"), F.lit("cim").alias("stage"), F.col("member").alias("stage_changed_by"), F.lit(1).alias("times_seen"),
    )
    events = d.select(F.concat(F.lit("cim:"), "draft_id").alias("ext_id"), F.lit(None).cast("string").alias("from_stage"), F.lit("cim").alias("to_stage"), "member", "at")
    verdicts = d.select(F.concat(F.lit("cim:"), "draft_id").alias("ext_id"), "member", F.lit("short").alias("action"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("note"))
    return deals, events, verdicts
