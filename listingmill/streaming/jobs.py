"""Micro-batch jobs over file sources. Each reads what is new (the checkpoint is the ledger of files), and
running it again adds nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listingmill.streaming import buckets


def read_stream(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_messages(stream: DataFrame, id_col: str, time_col: str, late: str = "7 days") -> DataFrame:
    """Each message once, however often it is delivered within ``late`` of its first delivery; state is dropped after that."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def run_to_end(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop."""
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()


def upsert_latest(stream: DataFrame, table: str, checkpoint: str, key: str, order: list[str], most_rows: int = 1_000_000, share: float = 0.25) -> None:
    """Keep the last row of each key in a table of buckets (see ``buckets``), batch by batch: a batch writes its own rows, and buckets that are due for it."""

    def batch(df: DataFrame, number: int) -> None:
        buckets.upsert(df, number, table, key, order, most_rows, share)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


current = buckets.current


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    from listingmill.operators.merge import MOVES

    stage = state.get[0] if state.exists else "inbox"
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for event in rows["event_type"]:
        for name, to, earlier in MOVES:
            if event == name and stage in earlier:
                stage = to
    state.update((stage,))
    yield pd.DataFrame({"deal_id": [key[0]], "stage": [stage], "last_event": [int(rows["event_id"].iloc[-1])]})


def stage_machine(events: DataFrame) -> DataFrame:
    """Each deal's stage after each batch of its events; the state of a deal is its stage."""
    return events.groupBy("deal_id").applyInPandasWithState(_advance, "deal_id long, stage string, last_event long", "stage string", "update", "NoTimeout")


def _attempts(limit: int, window_ms: int):
    """Attempts of a key in the order of their times, each as soon as the watermark has passed it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, reset_at, times, ids = state.get if state.exists else (0, -1, [], [])
        passed = state.getCurrentWatermarkMs()
        rows = list(zip(times, ids, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                rows += [(int(t), int(i)) for t, i in zip(part["ms"], part["attempt_id"], strict=True) if t > passed]  # what is older came too late
        out, held = [], []
        for ms, i in sorted(rows):
            if ms > passed:
                held.append((ms, i))
                continue
            if not count or reset_at < ms:
                count, reset_at = 0, ms + window_ms
            count += 1
            out.append((key[0], i, count, count > limit))
        if held or reset_at > passed:
            state.update((count, reset_at, [t for t, _ in held], [i for _, i in held]))
            # when the watermark is beyond this, the next attempt is due, or the window is over and nothing is left to know
            state.setTimeoutTimestamp(max(held[0][0] if held else reset_at, passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "attempt_id", "attempt", "denied"])

    return step


def limited_attempts(stream: DataFrame, key: str, id_col: str, time_col: str, limit: int = 10, window: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(key, attempt_id, attempt, denied) of every attempt, in windows that begin with the first attempt after the last one is over.

    ``attempt`` counts in the window; those over ``limit`` are denied. Attempts may come in any order within ``late``: they are counted by their own
    times once the watermark has passed them, older ones are left out. The state of a key is dropped with its window.
    """
    window_ms = int(pd.Timedelta(window).total_seconds() * 1000)
    timed = stream.withWatermark(time_col, late).select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("attempt_id"), F.unix_millis(time_col).alias("ms"), F.col(time_col).alias("at"))
    return timed.groupBy("key").applyInPandasWithState(_attempts(limit, window_ms), "key string, attempt_id long, attempt int, denied boolean", "count int, reset_at long, times array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
