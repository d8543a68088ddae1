"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Of two fingerprints that differ in at most
four bits, some segment differs in at most one bit, so the two share a variant of it with
one bit wiped out. Every fingerprint is indexed under its 64 one-wildcard variants; an
equality join on the variants gives candidates, which are verified on all 64 bits. A pair is
reported under its first shared variant alone, so none comes twice.

Equal fingerprints are joined once, as one. A segment value that very many different
fingerprints share would pair them all; those hot fingerprints are linked among themselves
through the centres of the balls of radius two around them instead: two fingerprints at a
distance of four or less have such a centre in common, all members of one centre are that
near, and there are at most 2,081 of them, so a star to the smallest is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm import rolling
from listingmill.llm.common import checked_broadcast, join_groups, materialize

#: (first bit, bits) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: At most so many bits differ between linked fingerprints.
DISTANCE = 4
#: Different fingerprints that may share a segment value before they count as hot.
HOT = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of a text in UTF-8."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of up to 255 rows fit in a byte, which numpy adds fastest
        whole = len(part) // 255 * 255
        ones += part[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + part[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _prints(shingle: int):
    def run(batches):
        for batch in batches:
            buf, bounds = rolling.text_buffer(batch.column(2))
            out = np.fromiter((fingerprint(buf[s:e].tobytes(), shingle) for s, e in zip(bounds[:-1], bounds[1:], strict=True)), np.uint64, len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["row", "doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, row_col: str | None = None) -> DataFrame:
    """row, doc_id and fp (the fingerprint's bits as a signed long) of every row; texts without words have fp 0."""
    row = docs[row_col] if row_col else F.lit(0)
    own = docs.select(row.cast("long").alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return own.mapInArrow(_prints(shingle), "row long, doc_id long, fp long")


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _variants(fp: Column) -> list[Column]:
    """The 64 keys: the wildcard's place above, the segment without that bit below."""
    return [
        _part(fp, first, bits).bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << i)).cast("long")).bitwiseOR(F.lit((first + i) << 22).cast("long"))
        for first, bits in SEGMENTS
        for i in range(bits)
    ]


def _first_place(diff: Column) -> Column:
    """The wildcard's place of the first variant shared by two fingerprints with these differing bits."""
    out = F.lit(None).cast("long")
    for first, bits in reversed(SEGMENTS):
        d = _part(diff, first, bits)
        one = F.lit(first) + F.bit_count(d - 1)  # the place of a single set bit
        out = F.when(F.bit_count(d) == 0, F.lit(first).cast("long")).when(F.bit_count(d) == 1, one.cast("long")).otherwise(out)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_pairs(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp``, each of ``nodes`` once: all at ``DISTANCE`` or less
    for the others, and for hot ones as many as join the same groups."""
    n = nodes.count()
    limit = max(hot, 8 * n // (1 << 21))
    parts = [nodes.select(F.lit(k).alias("seg"), _part(F.col("fp"), *s).alias("part"), "fp") for k, s in enumerate(SEGMENTS)]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2])
    values = materialize(each.groupBy("seg", "part").count().where(F.col("count") > limit).select("seg", "part"), "hot-values")
    any_hot = values.limit(1).count() > 0
    # Spark takes an exploded table for as small as its source, so the joins say that none is broadcast
    keys = nodes.select("fp", F.explode(F.array(*_variants(F.col("fp")))).alias("key"))
    a, b = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    close = (F.bit_count(diff) <= DISTANCE) & (F.shiftright(F.col("key"), 22) == _first_place(diff))
    if not any_hot:
        return a.hint("merge").join(b, "key").where(close & (F.col("a") < F.col("b"))).select("a", "b")

    hot_fp = materialize(each.join(checked_broadcast(values), ["seg", "part"], "left_semi").select("fp").distinct(), "hot-prints")
    cold = materialize(nodes.join(hot_fp, "fp", "left_anti"), "cold-prints")
    cold_keys = cold.select("fp", F.explode(F.array(*_variants(F.col("fp")))).alias("key")).select("key", F.col("fp").alias("a"))
    flagged = keys.join(hot_fp.withColumn("is_hot", F.lit(True)), "fp", "left").select("key", F.col("fp").alias("b"), F.coalesce("is_hot", F.lit(False)).alias("b_hot"))
    pairs = cold_keys.hint("merge").join(flagged, "key").where(close & (F.col("b_hot") | (F.col("a") < F.col("b")))).select("a", "b")
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))]
    flips = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    balls = hot_fp.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("centre", "a")
    stars = balls.hint("merge").join(least, "centre").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): for every node of the links (a, b), the smallest node it can reach.

    Each round points every node to the smallest of its neighbours and itself, follows that
    pointer once more, and contracts the links to the nodes pointed to. Links inside a group
    vanish with its first rounds, so dense groups are not joined again and again; the smallest
    node of a group points to itself throughout and is what remains. Every round is written.
    """
    edges = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("to"))
        points = materialize(low.unionByName(ends).groupBy("node").agg(F.min("to").alias("to")), "points")
        over = points.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        points = materialize(points.join(over, points["to"] == over["_n"]).select("node", F.col("_t").alias("to")), "points")
        end_a, end_b = points.select(F.col("node").alias("a"), F.col("to").alias("a2")), points.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(end_a, "a").join(end_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = materialize(moved.distinct(), "edges")
        if labels is None:
            labels = points.select("node", F.col("to").alias("label"))
        else:
            new = points.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            labels = materialize(labels.join(new, labels["label"] == new["_n"], "left").select("node", F.coalesce("_t", "label").alias("label")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, hot: int = HOT, row_col: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest id reachable over links of ``DISTANCE`` bits or fewer, its own
    included. With ``row_col``, a column that tells rows apart, the result also has it as ``row``, and ``kept``, which is
    true for one row of each component: the one with the smallest id, and of those the smallest row.

    Defined cases: a null or blank text has fingerprint zero, which links like any
    other; a null id gets the component of its fingerprint but names none (a component of null
    ids alone has a null component_id); repeated rows each get a result; other columns, of any
    name, are not read; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, row_col), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = materialize(prints.groupBy("fp").agg(first, F.count("*").alias("n")), "nodes")
    reached = materialize(components(near_pairs(nodes.select("fp"), hot)), "reached")
    linked = nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    named = linked.groupBy("label").agg(F.min("first").alias("least"))
    ids = materialize(linked.join(named, "label").select("fp", "n", "least"), "component-ids")
    out = join_groups(prints, ids, ["fp"], "n", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), *(["row", kept.alias("kept")] if row_col else []))
