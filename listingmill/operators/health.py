"""Yields of a run by several keys at once, and alerts against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("format_family", "domain", "address", "nickname", "format_id", "email_type")
BASELINE = (("alpha", 12), ("beta", 4), ("newsletter", 8))


def yield_stats(messages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Blocks and messages by each key in one pass (grouping sets); messages without blocks count too."""
    grouped = messages.groupingSets([[k] for k in keys], *keys).agg(F.sum("blocks").alias("blocks"), F.count("*").alias("messages"), F.grouping_id().alias("_g"))
    n = len(keys)
    bit = {k: ((1 << n) - 1) ^ (1 << (n - 1 - i)) for i, k in enumerate(keys)}
    kind = F.coalesce(*[F.when(F.col("_g") == bit[k], F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.col("_g") == bit[k], F.col(k)) for k in keys], F.lit("(none)"))
    return grouped.select(kind.alias("kind"), value.alias("value"), "blocks", "messages")


def health(counts: DataFrame, baseline: tuple[tuple[str, int], ...] = BASELINE, share: float = 0.4) -> DataFrame:
    """Alerts (source, level, got, expected): none at all is critical, under a share of the baseline a warning, a source without one news."""
    base = counts.sparkSession.createDataFrame(list(baseline), "source string, expected int")
    j = F.broadcast(base).join(counts.select("source", F.col("n").alias("got")), "source", "full_outer").select("source", F.coalesce("got", F.lit(0)).cast("long").alias("got"), F.col("expected").cast("long").alias("expected"))
    level = F.when(F.col("expected").isNull(), "INFO").when((F.col("got") == 0) & (F.col("expected") > 0), "CRITICAL").when(F.col("got") < F.col("expected") * share, "WARN")
    return j.withColumn("level", level).where("level IS NOT NULL").select("source", "level", "got", "expected")
