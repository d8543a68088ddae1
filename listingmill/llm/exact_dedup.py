"""Exact dedup by progressive refinement, in DataFrame operations only.

Texts of one length are grouped first, then by a hash of their first characters, and only
texts that still share a group have their whole content compared, by its SHA-256. One scan
writes the narrow keys of all rows in the shared folder; the refinement works on them and no
text ever enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm import common
from listingmill.llm.common import join_groups, materialize

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, prefix_chars: int = PREFIX_CHARS, broadcast_rows: int | None = None, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and text_sha256 if ``digest``.

    Of equal texts the row with the largest id stays. ``digest`` asks for the hash of every text, which
    the first scan then takes along. Without it only survivors of the first two steps are
    hashed: those whose (length, prefix hash) is in a counted short list, or, where that list
    is long, every text where it lies, since 32 bytes move with less work than a text.

    Defined cases: a null text is the empty text; a null id is smaller than any id, and if all
    ids of a group are null its keep_id is null and its rows are kept; repeated rows with the
    largest id are all kept, unless ``row_col`` names a column that tells rows apart: then the one with
    its largest value stays, and the column is returned as ``row``; other columns, of any name, are
    not read; an empty table gives an empty result.
    """
    broadcast_rows = common.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    row = docs[row_col] if row_col else F.lit(0)
    own = docs.select(row.cast("long").alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size, head = F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("head")
    full = F.unhex(F.sha2("text", 256)).alias("full")

    keys = materialize(own.select("row", "doc_id", size, head, *([full] if digest else [])), "keys")
    lengths = materialize(keys.groupBy("size").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    same_length = join_groups(keys, lengths, ["size"], "n", "left_semi", broadcast_rows)
    heads = materialize(same_length.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1"), "heads")

    if digest:
        survivors = join_groups(keys, heads, ["size", "head"], "n", "left_semi", broadcast_rows)
    elif heads.count() <= broadcast_rows:
        survivors = materialize(own.select("row", "doc_id", size, head, "text").join(F.broadcast(heads), ["size", "head"], "left_semi").select("row", "doc_id", full), "survivors")
    else:
        survivors = materialize(join_groups(own.select("row", "doc_id", size, head, full), heads, ["size", "head"], "n", "left_semi", broadcast_rows).select("row", "doc_id", "full"), "survivors")
    groups = materialize(survivors.groupBy("full").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1"), "groups")

    met = join_groups(keys if digest else survivors, groups, ["full"], "n", "left", broadcast_rows)
    if not digest:
        lone = join_groups(keys, heads, ["size", "head"], "n", "left_anti", broadcast_rows)
        nothing = [F.lit(None).cast(t).alias(c) for c, t in groups.dtypes]
        met = met.select("row", "doc_id", *groups.columns).unionByName(lone.select("row", "doc_id", *nothing))
    grouped = F.col("n").isNotNull()
    keep_id = F.when(grouped, F.col("keep.doc_id")).otherwise(F.col("doc_id"))
    kept = ~grouped | (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("row") == F.col("keep.row")))
    out = ["doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept")]
    return met.select(*out, *([F.lower(F.hex("full")).alias("text_sha256")] if digest else []), *(["row"] if row_col else []))
