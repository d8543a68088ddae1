"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

Each map task hashes every window of its texts and sends the hashes, in blocks, to the
bucket that their leading bits name. A bucket sorts its hashes and reports those windows
whose sequence also starts in a text with a smaller id. Repeats inside one block are found
before the shuffle, so a passage that a third of all texts share reaches its bucket once
per block and not once per text. Where there are so many buckets that a block would hold
next to nothing for each, blocks go to ranges of buckets first, where they are put together
and dealt out once more. The reports meet their texts again by id, where the
repeated windows merge into maximal removal intervals.

The bucket comes from a second, independent hash, so two windows count as equal only if 64 bits
and the bucket agree: the hash grows by the logarithm of the number of buckets, with the
corpus, and no further byte is sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm import rolling
from listingmill.llm.common import BROADCAST_ROWS, id_text, materialize

#: Windows that a map task gathers before it sends a block.
BLOCK = 1 << 19
#: Bytes of text whose windows share a bucket, on average.
BUCKET_BYTES = 4 << 20
#: Buckets, or ranges of buckets, that one exchange deals blocks to at most.
FAN_OUT = 8192

_SENT = "bucket long, spread boolean, hashes binary, ids binary"
_FOUND = "doc_id long, hash long"
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def _pack_ids(ids: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(ids, prepend=np.int64(0)).tobytes())


def _unpack_ids(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64))


def _rows(h: np.ndarray, ids: np.ndarray, bucket: np.ndarray, spread: bool):
    """A row for each bucket of these windows."""
    order = np.lexsort((ids, bucket))
    h, ids, bucket = h[order], ids[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[s]), spread, h[s:e].tobytes(), _pack_ids(ids[s:e])) for s, e in zip(cut, np.r_[cut[1:], len(bucket)], strict=True)]


def _block(h: np.ndarray, ids: np.ndarray, bucket: np.ndarray, buckets: int, ranges: int):
    """Rows for one block: distinct windows with their smallest id, by bucket or by range of buckets, and repeats already proven.

    For a range the buckets of its windows go along behind the hashes.
    """
    order = np.argsort(h, kind="stable")
    h, ids, bucket = h[order], ids[order], bucket[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])])
    least = np.minimum.reduceat(ids, first)
    known = ids > np.repeat(least, np.diff(np.r_[first, len(h)]))
    if ranges == buckets:
        rows = _rows(h[first], least, bucket[first], False)
    else:
        h1, b1 = h[first], bucket[first]
        part = b1 * ranges // buckets
        order = np.lexsort((least, part))
        h1, b1, least, part = h1[order], b1[order], least[order], part[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = [(int(part[s]), False, np.r_[h1[s:e], b1[s:e].astype(np.uint64)].tobytes(), _pack_ids(least[s:e])) for s, e in zip(cut, np.r_[cut[1:], len(part)], strict=True)]
    if known.any():
        rows += _rows(h[known], ids[known], (rolling.mix(ids[known].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), True)
    return _sent(rows)


def _sent(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "spread", "hashes", "ids"])


def _bucket_of(words: np.ndarray, counts: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """The bucket of every window, from a Rabin-Karp hash over other values of the words."""
    g, _ = rolling.window_hashes(rolling.mix(words ^ _OTHER), counts, width)
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _joined(held) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _send(width: int, buckets: int, ranges: int):
    """Blocks for each bucket, or with fewer ``ranges`` than buckets for each range of buckets."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            buf, bounds = rolling.text_buffer(texts)
            for a, z in rolling.text_groups(texts):
                words, counts = rolling.word_hashes(buf, bounds[a : z + 1])
                h, windows = rolling.window_hashes(words, counts, width)
                held.append((h, np.repeat(ids[a:z], windows), _bucket_of(words, counts, width, buckets)))
                n += len(h)
                if n >= BLOCK:
                    yield _block(*_joined(held), buckets, ranges)
                    held, n = [], 0
        if n:
            yield _block(*_joined(held), buckets, ranges)

    return run


def _deal(buckets: int):
    """Windows of ranges of buckets, put together into blocks and dealt out to the buckets themselves."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            proven = pa.compute.filter(batch, batch.column(1))
            if proven.num_rows:
                yield proven
            for spread, pair, owners in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if spread:
                    continue
                h, bucket = np.frombuffer(pair, np.uint64).reshape(2, -1)
                held.append((h, _unpack_ids(owners), bucket.astype(np.int64)))
                n += len(h)
                if n >= BLOCK:
                    yield _block(*_joined(held), buckets, buckets)
                    held, n = [], 0
        if n:
            yield _block(*_joined(held), buckets, buckets)

    return run


def _found(ids: np.ndarray, h: np.ndarray) -> pa.Table:
    """A row for each repeated window: its document and its hash."""
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "hash": pa.array(h.view(np.int64), pa.int64())})


def _bucket(rows: pa.Table) -> pa.Table:
    """All repeats of one bucket: a window repeats where a smaller id has its hash too."""
    h, ids, h2, id2 = [], [], [], []
    for spread, hashes, owners in zip(rows["spread"].to_pylist(), rows["hashes"].to_pylist(), rows["ids"].to_pylist(), strict=True):
        (h2 if spread else h).append(np.frombuffer(hashes, np.uint64))
        (id2 if spread else ids).append(_unpack_ids(owners))
    out_h, out_id = np.concatenate(h2) if h2 else np.empty(0, np.uint64), np.concatenate(id2) if id2 else np.empty(0, np.int64)
    if h:
        h, ids = np.concatenate(h), np.concatenate(ids)
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        later = ids > np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(h)]))
        out_h, out_id = np.r_[out_h, h[later]], np.r_[out_id, ids[later]]
    return _found(out_id, out_h)


_KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def _remove(width: int):
    def run(batches):
        for batch in batches:
            ids, texts, marks = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            cuts, marks = marks.offsets.to_numpy(), marks.values.to_numpy().view(np.uint64)
            buf, bounds = rolling.text_buffer(texts)
            out = []
            for i, doc in enumerate(ids):
                raw = buf[bounds[i] : bounds[i + 1]].tobytes()
                words = raw.split()
                spans = []
                if cuts[i] < cuts[i + 1]:
                    v, c = rolling.word_hashes(buf, bounds[i : i + 2])
                    h, _ = rolling.window_hashes(v, c, width)
                    at = np.flatnonzero(np.isin(h, marks[cuts[i] : cuts[i + 1]]))
                    if len(at):
                        new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + width])
                        spans = [(int(at[s]), int(at[e - 1]) + width) for s, e in zip(new, np.r_[new[1:], len(at)], strict=True)]
                kept, to = [], 0
                for s, e in spans:
                    kept += words[to:s]
                    to = e
                kept += words[to:]
                out.append((doc, len(words), len(words) - len(kept), [{"start": s, "end": e} for s, e in spans], b" ".join(kept).decode()))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, fan_out: int = FAN_OUT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Words of each text without those that a repeated window of ``width`` words covers.

    A window repeats when its word sequence also starts in a text with a smaller id, judged
    on the input. Returns one row per input row: doc_id, n_words, n_removed, spans (maximal
    intervals of removed words, as word positions [start, end)), kept_text (kept words joined
    by one space).

    Defined cases: a null text has no words; texts under ``width`` words lose none; rows that
    share an id are one document in comparisons and each get a result; a row with a null id
    comes after all ids, and such rows after one another in the order in which they are written down,
    so none makes a row with an id lose words; other columns, of any name, are not read; an
    empty table gives an empty result.
    """
    keyed, total = _keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    ranges = buckets if buckets <= fan_out else math.ceil(buckets / fan_out) if buckets <= fan_out**2 else fan_out
    sent = keyed.select("key", "text").mapInArrow(_send(width, buckets, ranges), _SENT)
    if ranges < buckets:
        sent = sent.repartition(max(1, min(ranges, 1 << 16)), "bucket").mapInArrow(_deal(buckets), _SENT)
    marks = materialize(sent.groupBy("bucket").applyInArrow(_bucket, _FOUND), "windows")
    marked = materialize(marks.select(F.col("doc_id").alias("_id")).distinct(), "window-ids")
    by_doc = marks.groupBy("doc_id").agg(F.collect_list("hash").alias("marks"))
    none = F.array().cast("array<bigint>")
    if marked.count() <= broadcast_rows:
        side = F.broadcast(marked)
        clean = keyed.join(side, keyed["key"] == F.col("_id"), "left_anti").select("doc_id", "text", none.alias("marks"))
        touched = keyed.join(side, keyed["key"] == F.col("_id"), "left_semi").join(by_doc, F.col("key") == by_doc["doc_id"]).select(keyed["doc_id"], "text", "marks")
        met = clean.unionByName(touched)
    else:  # the texts meet their marks in one shuffle, on a key that no two documents share
        met = keyed.join(by_doc, keyed["key"] == by_doc["doc_id"], "left").select(keyed["doc_id"], "text", F.coalesce("marks", none).alias("marks"))
    return met.mapInArrow(_remove(width), _KEPT)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(key, doc_id, text), where key is the id or, for each row without one, a number after all ids; and the bytes of all texts."""
    own = id_text(docs, id_col, text_col)
    sums = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    if not sums["none"]:
        return own.select(F.col("doc_id").alias("key"), "doc_id", "text"), sums["bytes"] or 0
    after = max(sums["last"] + 1, 0) if sums["last"] is not None else 0
    numbered = materialize(own.where("doc_id IS NULL").withColumn("_n", F.monotonically_increasing_id()), "without-id")
    key = F.least(F.col("_n").cast("decimal(20)") + F.lit(str(after)).cast("decimal(20)"), F.lit(str((1 << 63) - 1)).cast("decimal(20)")).cast("long")
    return own.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), "doc_id", "text").unionByName(numbered.select(key.alias("key"), "doc_id", "text")), sums["bytes"] or 0
