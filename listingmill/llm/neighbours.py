"""Approximate nearest neighbours by cross-polytope hashing.

Each of several tables rotates the unit vectors with rounds of random signs and a fast Hadamard
transform; a vector goes to the nearest of the 2d signed axes. Where a table of that many cells
would hold too many rows in each, further rotations, the last one cut to fewer axes, are joined
to the first: the number of cells grows with the number of rows. A query probes, in every
table, the cells whose axes lie nearest to it together. How many it probes is set on a bounded
sample of queries, whose true neighbours one pass over all rows finds.

The search has two passes. A first one, over a few tables and cells, gives each query a score that its last
neighbour reaches in any case; in the second one every cell returns only what reaches it, so what comes out of the cells grows with the
queries and not with the cells they look into.

Vectors meet their queries by cell. A cell with many of either is split into blocks of
bounded size, several small cells share a task's group, and every cell returns the nearest by
the exact cosine of the original vectors. Equal vectors are indexed through the few smallest
ids that can appear in an answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmill.llm.common import checked_broadcast, materialize

#: Tables; rows of one cell on average; rows of a block; seed.
TABLES, CELL_ROWS, BLOCK, SEED = 10, 32, 8192, 11
#: Tables, and cells of each, that the first pass looks into.
FIRST_TABLES, FIRST_PROBES = 3, 4
#: The share of true neighbours that the probes must reach on the sample, its queries, and how many cells of one table are looked at first.
TARGET, SAMPLE, FIRST_CELLS = 0.965, 64, 4096


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """Random signs, (count, 3, padded dimension)."""
    padded = 1 << max(0, dim - 1).bit_length()
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1.0, 1.0]), (count, 3, padded))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and a fast Hadamard transform, over rows padded with zeros."""
    n = signs.shape[-1]
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    for s in signs:
        out *= s
        h = 1
        while h < n:
            pair = out.reshape(len(out), n // (2 * h), 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(out), n)
            h *= 2
        out /= np.sqrt(n)
    return out


def widths(dim: int, rows: int, cell_rows: int = CELL_ROWS) -> list[int]:
    """Signed axes of each hash of a table, so that about ``cell_rows`` rows share a cell."""
    full = 2 << max(0, dim - 1).bit_length()
    cells, out = max(1, rows // cell_rows), [full]
    while cells > out[-1] > 1:
        cells = cells // out[-1]
        out.append(min(full, 1 << (cells - 1).bit_length()))
    return [w for w in out if w > 1] or [full]


class Hashes:
    """The hashes of all tables. Small; it is sent to tasks by value."""

    def __init__(self, dim: int, tables: int, of: list[int], seed: int):
        self.tables, self.of, self.cells = tables, of, int(np.prod(of, dtype=object))
        self.signs = rotations(dim, tables * len(of), seed)

    def _sides(self, x: np.ndarray, table: int):
        """For each hash of a table, how near every row is to its signed axes."""
        for j, w in enumerate(self.of):
            r = rotate(x, self.signs[table * len(self.of) + j])[:, : w // 2]
            yield np.concatenate([r, -r], 1)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of every unit vector in each table, (rows, tables)."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for w, s in zip(self.of, self._sides(x, t), strict=True):
                out[:, t] = out[:, t] * w + s.argmax(1)
            out[:, t] += t * self.cells
        return out

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to every unit vector, nearest first, (rows, tables, probes or all).

        Sums over some hashes that are among the largest extend to the largest over all.
        """
        out = np.empty((len(x), self.tables, min(probes, self.cells)), np.int64)
        for t in range(self.tables):
            sides = list(self._sides(x, t))
            for i in range(len(x)):
                total, cell = np.zeros(1), np.zeros(1, np.int64)
                for w, s in zip(self.of, sides, strict=True):
                    total, cell = (total[:, None] + s[i]).ravel(), (cell[:, None] * w + np.arange(w)).ravel()
                    if len(total) > probes:
                        top = np.argpartition(-total, probes - 1)[:probes]
                        total, cell = total[top], cell[top]
                out[i, t] = cell[np.argsort(-total, kind="stable")] + t * self.cells
        return out


def _vectors(batch, dim: int) -> np.ndarray:
    column = batch.column(1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(hashes: Hashes, dim: int, probes: int, with_vector: bool):
    """(cell, id, vector, bar) for every cell of each vector: its own ones, or with ``probes`` those a query looks into."""
    step = max(1, min(1024, (1 << 16) // (max(1, probes) * hashes.tables)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, x = part.column(0).to_numpy(), _vectors(part, dim)
                unit = _unit(x)
                cells = (hashes.near(unit, probes) if probes else hashes.own(unit)).reshape(len(x), -1)
                cols = [pa.array(cells.ravel()), pa.array(np.repeat(ids, cells.shape[1]))]
                if with_vector:
                    cols.append(pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))))
                    cols.append(pa.array(np.repeat(part.column(2).to_numpy(), cells.shape[1])))
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "id", "vector", "bar"][: len(cols)])

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that row of ``b``, in double precision, each on its own."""
    a, b = a.astype(float), b.astype(float)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _top(ids, x, unit, qi, di, k, bars=None):
    """(query id, id, score, row) of the ``k`` nearest rows ``di`` of each row ``qi``, those below the query's bar left out."""
    data = unit[di].T
    for at in range(0, len(qi), 256):
        part = qi[at : at + 256]
        near = unit[part] @ data
        near[ids[part][:, None] == ids[di][None, :]] = -np.inf
        # a little slack: rounding of the block product must not decide between near-equal ones
        least = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
        least = np.maximum(least, -2 if bars is None else bars[part])
        r, c = np.nonzero(near >= least[:, None] - 1e-9)
        score = cosine(x[part[r]], x[di[c]])
        order = np.lexsort((ids[di[c]], -score, r))
        r, c, score = r[order], c[order], score[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield ids[part[r[top]]], ids[di[c[top]]], score[top], di[c[top]]


def _nearest(dim: int, dtype: str, k: int):
    def run(group: pa.Table) -> pa.Table:
        query, ids = group["query"].to_numpy(), group["id"].to_numpy()
        x = np.frombuffer(b"".join(group["vector"].to_pylist()), dtype).reshape(-1, dim)
        unit, bars = _unit(x), group["bar"].to_numpy()
        keys = [group[c].to_numpy() for c in ("cell", "d", "q")]
        order = np.lexsort(keys)
        changes = np.logical_or.reduce([np.diff(key[order]) != 0 for key in keys])
        out = []
        for rows in np.split(order, np.flatnonzero(changes) + 1):
            qi, di = rows[query[rows]], rows[~query[rows]]
            if len(qi) and len(di):
                out += _top(ids, x, unit, qi, di, k, bars)
        cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, float))]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def true_neighbours(index: DataFrame, asked: list[tuple[int, bytes]], dim: int, dtype: str, k: int) -> list:
    """The ``k`` nearest of each of a few queries among all rows, with their vectors, by one pass over the index."""
    q_ids = np.array([i for i, _ in asked], np.int64)
    q = np.frombuffer(b"".join(v for _, v in asked), dtype).reshape(-1, dim)

    def run(batches):
        for batch in batches:
            own_ids, own = batch.column(0).to_numpy(), _vectors(batch, dim)
            ids, x = np.r_[q_ids, own_ids], np.concatenate([q, own])
            for a, b, s, rows in _top(ids, x, _unit(x), np.arange(len(q)), np.arange(len(q), len(x)), k) if len(own) else ():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array([x[r].tobytes() for r in rows], pa.binary())], names=["query_id", "vec_id", "score", "vector"])

    best = index.mapInArrow(run, "query_id long, vec_id long, score double, vector binary")
    return _ranked(best.dropDuplicates(["query_id", "vec_id", "vector"]), k).select("query_id", "vector").collect()


def tuned_probes(index: DataFrame, queries: DataFrame, hashes: Hashes, dim: int, dtype: str, k: int, target: float = TARGET, sample: int = SAMPLE, most: int = FIRST_CELLS) -> int:
    """The fewest cells a table with which the sample's queries would reach ``target`` of their true neighbours.

    At most ``sample`` queries (by a hash of their ids) and ``k`` neighbours of each come to the driver. Where the ``most`` nearest cells do not
    reach the target, twice as many are looked at, up to all.
    """
    asked = [(r["id"], np.array(r["vector"], dtype).tobytes()) for r in queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not asked:
        return 1
    vector = {i: np.frombuffer(v, dtype) for i, v in asked}
    pairs = true_neighbours(index, asked, dim, dtype, k)
    if not pairs:
        return 1
    own = hashes.own(_unit(np.stack([np.frombuffer(r["vector"], dtype) for r in pairs])))
    unit, wanted = _unit(np.stack(list(vector.values()))), max(1, int(np.ceil(target * len(pairs))))
    most = min(most, hashes.cells)
    while True:
        order = dict(zip(vector, hashes.near(unit, most), strict=True))
        need = []
        for r, cells in zip(pairs, own, strict=True):
            hit = order[r["query_id"]] == cells[:, None]
            need.append(min((int(h.argmax()) + 1 for h in hit if h.any()), default=most + 1))
        need.sort()
        if need[wanted - 1] <= most:
            return need[wanted - 1]
        most = min(hashes.cells, 2 * most)


def _search(index: DataFrame, queries: DataFrame, hashes: Hashes, dim: int, dtype: str, k: int, probes: int, block: int) -> DataFrame:
    def counted(df, p, name):
        return df.mapInArrow(_cells(hashes, dim, p, False), "cell long, id long").groupBy("cell").agg(F.count("*").alias(name))

    met = counted(index, 0, "n").join(counted(queries, probes, "m"), "cell")
    counts = materialize(met.select("cell", "n", "m", F.ceil(F.col("n") / block).cast("int").alias("nd"), F.ceil(F.col("m") / block).cast("int").alias("nq")), "cells")
    # only cells over one block: at most (rows x tables + queries x probes) / block of them
    large = materialize(counts.where("nd > 1 OR nq > 1").select("cell", "nd", "nq"), "large-cells")
    dealt_rows = counts.agg(F.sum(F.col("n") * F.col("nq") + F.col("m") * F.col("nd"))).first()[0] or 0
    kind = "cell long, id long, vector binary, bar double"
    index, queries = (d if "bar" in d.columns else d.withColumn("bar", F.lit(-2.0)) for d in (index, queries))
    rows = index.mapInArrow(_cells(hashes, dim, 0, True), kind).withColumn("query", F.lit(False)).unionByName(queries.mapInArrow(_cells(hashes, dim, probes, True), kind).withColumn("query", F.lit(True)))
    nd, nq = F.coalesce("nd", F.lit(1)), F.coalesce("nq", F.lit(1))
    place = lambda n: F.array(F.pmod(F.xxhash64("id"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    dealt = rows.join(checked_broadcast(large), "cell", "left").withColumn("d", F.explode(F.when(F.col("query"), every(nd)).otherwise(place(nd)))).withColumn("q", F.explode(F.when(F.col("query"), place(nq)).otherwise(every(nq))))
    # small cells share a group of about a block of rows
    bucket = F.pmod(F.xxhash64("cell", "d", "q"), F.lit(1 + dealt_rows // block))
    found = dealt.select("cell", "id", "vector", "bar", "query", "d", "q", bucket.alias("bucket")).groupBy("bucket").applyInArrow(_nearest(dim, dtype, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(best, k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, probes: int | None = None, block: int = BLOCK, seed: int = SEED, cell_rows: int = CELL_ROWS, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found of every query, by cosine.

    Queries are the rows where ``is_query`` holds (default: id divisible by 50); candidates are
    all rows but those with the query's id. Ties go to the smaller id. ``probes`` is the number of cells
    each query looks into in each table; by default it is tuned to ``target``. A query for which the
    probes find fewer than ``k`` is compared with all rows, in blocks.

    Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do rows with a null id or a length other than the most common one (the
    longer at a tie; a cosine needs two vectors of one length); repeated rows count once; if an id
    has several vectors its best one counts; other columns, of any name, are not read; an
    empty table gives an empty result.
    """
    v = F.col("vector")
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"), (is_query if is_query is not None else vectors[id_col] % 50 == 0).alias("query"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    own = own.where("id IS NOT NULL AND vector IS NOT NULL").where(finite)
    lengths = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["dim"]
    dtype = "float32" if "array<float>" in dict(own.dtypes)["vector"] else "float64"
    if dtype == "float64":
        own = own.withColumn("vector", v.cast("array<double>"))
    own = own.where(F.size("vector") == dim).dropDuplicates(["id", "vector"])
    # of equal vectors only the k + 1 smallest ids can be in an answer (one may be the query's own)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    index = materialize(own.withColumn("_place", place).where(F.col("_place") <= k + 1).select("id", "vector"), "index")
    queries = materialize(own.where("query").select("id", "vector"), "queries")
    hashes = Hashes(dim, tables, widths(dim, index.count(), cell_rows), seed)
    probes = probes or tuned_probes(index, queries, hashes, dim, dtype, k, target)
    few = Hashes(dim, min(tables, FIRST_TABLES), hashes.of, seed)
    first = _search(index, queries, few, dim, dtype, k, min(probes, FIRST_PROBES), block)
    bars = first.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_bar"))
    barred = materialize(queries.join(bars, queries["id"] == bars["_q"], "left").select("id", "vector", F.coalesce("_bar", F.lit(-2.0)).alias("bar")), "barred")
    found = materialize(_search(index, barred, hashes, dim, dtype, k, probes, block), "found")
    short = queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    short = materialize(short, "short")
    if not short.limit(1).count():
        return found
    one = Hashes(dim, 1, widths(dim, 1), seed)
    whole = _search(index, short, one, dim, dtype, k, one.cells, block)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(whole)
