"""Near-duplicate vectors through an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codes, one of either half, are the
cells of a product grid, and every vector lies in one of them. A vector visits the cells nearest to it in the order of the
multi-sequence algorithm. How many it visits is set on sampled vectors, whose true links one
pass over all rows finds, so that the target share of them finds all its links. Candidates are verified by
the exact cosine of the original vectors.

Equal vectors are one, with their number. A cell with many rows or visitors is split into blocks. A
block reports, for each of its vectors, how many links were found and the smallest vector its links reach
within the block, not the links themselves, so a dense group of n vectors makes rows in proportion to n and not to its square. A pair
that either vector could find is counted where the cell with the larger number is searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm.alignment import groups_of
from listingmill.llm.common import checked_broadcast, join_groups, materialize
from listingmill.llm.neighbours import _unit, cosine
from listingmill.llm.simhash_dedup import components

#: Cosine of a link; rows of a cell on average; most codes of a half; vectors the codebooks are fitted on, for each code.
THRESHOLD, CELL_ROWS, MOST_CODES, FIT_ROWS = 0.9, 32, 2048, 64
#: Share of sampled vectors with links that must find all of them; sampled vectors with links wanted; vectors sampled at first and at most.
TARGET, WANTED, SAMPLE, MOST_SAMPLE = 0.99, 200, 512, 8192
#: Rows, and visitors, of a block; seed.
BLOCK, SEED = 4096, 17
#: Equal vectors are joined by their components; so many of them at most are broadcast.
_WIDE_ROWS = 20_000


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centres: seeds drawn by squared distance, so that copies do not take several, then Lloyd's rounds."""
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = x[:1] if len(x) else np.zeros((1, x.shape[1]))
    gap = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and gap.sum() > 1e-9:
        new = x[draw.choice(len(x), p=gap / gap.sum())]
        centres = np.vstack([centres, new])
        gap = np.minimum(gap, ((x - new) ** 2).sum(1))
    for _ in range(rounds):
        own = np.concatenate([_gaps(part, centres).argmin(1) for part in np.array_split(x, 1 + len(x) // 4096)])
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T


class Grid:
    """Codebooks of both halves. Small; it is sent to tasks by value."""

    def __init__(self, sample: np.ndarray, codes: int, seed: int = SEED):
        self.half = sample.shape[1] // 2
        # a vector of one component has an empty first half, and so one code there
        self.books = [kmeans(part, codes, seed + i) for i, part in enumerate((sample[:, : self.half], sample[:, self.half :]))]
        self.sizes = [len(b) for b in self.books]
        self.cells = self.sizes[0] * self.sizes[1]

    def gaps(self, x: np.ndarray) -> list[np.ndarray]:
        """How far every unit vector's halves lie from the codes of their books."""
        return [_gaps(x[:, : self.half], self.books[0]), _gaps(x[:, self.half :], self.books[1])]

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells (or all) of every unit vector, nearest first; the first one is its own cell.

        The multi-sequence order for many vectors at once: behind the i-th code of one half and the j-th of the other lie
        at least (i + 1)(j + 1) - 1 cells that come no later, so only combinations up to ``count`` are looked at.
        """
        count = min(count, self.cells)
        gaps = self.gaps(x)
        orders = [np.argsort(g, 1, kind="stable")[:, :count] for g in gaps]
        a, b = (np.take_along_axis(g, o, 1) for g, o in zip(gaps, orders, strict=True))
        lengths = [min(b.shape[1], max(1, count // (i + 1))) for i in range(a.shape[1])]
        i, j = np.repeat(np.arange(a.shape[1]), lengths), np.concatenate([np.arange(n) for n in lengths])
        out = np.empty((len(x), count), np.int64)
        step = max(1, (1 << 20) // len(i))
        for at in range(0, len(x), step):
            part = slice(at, at + step)
            first = np.argsort(a[part][:, i] + b[part][:, j], 1, kind="stable")[:, :count]
            out[part] = np.take_along_axis(orders[0][part][:, i], first, 1) * self.sizes[1] + np.take_along_axis(orders[1][part][:, j], first, 1)
        return out

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """At which place of its order each unit vector meets a given cell (of cells equally near, the last)."""
        out = np.empty(len(x), np.int64)
        for n, (a, b, c) in enumerate(zip(*self.gaps(x), cell, strict=True)):
            to = a[c // self.sizes[1]] + b[c % self.sizes[1]]
            out[n] = np.searchsorted(np.sort(b), to - a + 1e-12, "right").sum()
        return np.minimum(out, self.cells)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _links(x: np.ndarray, unit: np.ndarray, qi: np.ndarray, di: np.ndarray, least: float):
    """Pairs (row of qi, row of di) whose exact cosine is at least ``least``, in bounded parts."""
    for at in range(0, len(qi), 512):
        for by in range(0, len(di), 4096):
            q, d = qi[at : at + 512], di[by : by + 4096]
            r, c = np.nonzero(unit[q] @ unit[d].T >= least - 1e-9)
            for some in np.array_split(np.arange(len(r)), 1 + len(r) // 65536):
                a, b = q[r[some]], d[c[some]]
                good = cosine(x[a], x[b]) >= least
                yield a[good], b[good]


def sampled_needs(index: DataFrame, grid: Grid, dim: int, sample: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How many cells each of about ``sample`` vectors would have to visit to meet all its links, for those that have any, and all sampled unit vectors.

    A link is met as soon as one of its two vectors visits the other.
    """
    n = index.count()
    share = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(1, n)))
    asked = index.where(share).select("node", "vector").collect()
    nodes = np.array([r["node"] for r in asked], np.int64)
    q = np.array([r["vector"] for r in asked], float).reshape(-1, dim)
    if not len(q):
        return np.empty(0, np.int64), q
    unit_q = _unit(q)
    own_q = grid.visits(unit_q, 1)[:, 0]

    def run(batches):
        for batch in batches:
            ids, y = batch.column(0).to_numpy(), _matrix(batch.column(1), dim).astype(float)
            if not len(y):
                continue
            x, unit = np.concatenate([q, y]), np.concatenate([unit_q, _unit(y)])
            own = np.r_[own_q, grid.visits(unit[len(q) :], 1)[:, 0]]
            most = np.zeros(len(q), np.int64)
            for a, b in _links(x, unit, np.arange(len(q)), np.arange(len(q), len(x)), least):
                other = nodes[a] != ids[b - len(q)]
                a, b = a[other], b[other]
                need = np.minimum(grid.rank(unit[a], own[b]), grid.rank(unit[b], own[a]))
                np.maximum.at(most, a, need)
            hit = np.flatnonzero(most)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(most[hit])], names=["q", "need"])

    needs = index.select("node", "vector").mapInArrow(run, "q long, need long").groupBy("q").agg(F.max("need").alias("need")).collect()
    return np.array([r["need"] for r in needs], np.int64), unit_q


def tuned_visits(index: DataFrame, grid: Grid, dim: int, least: float, target: float = TARGET, wanted: int = WANTED, sample: int = SAMPLE, most_sample: int = MOST_SAMPLE) -> int:
    """The fewest cells with which ``target`` of the sampled vectors that have links would meet all of them.

    The sample grows until ``wanted`` vectors with links are in it, it holds all rows, or ``most_sample``; that many vectors come to the
    driver at most, give or take the chance of a draw by hash. Where too few have links, vectors moved to just ``least`` in
    random directions stand in for the rest.
    """
    n = index.count()
    needs, unit = sampled_needs(index, grid, dim, sample, least)
    while len(needs) < wanted and sample < min(n, most_sample):
        sample *= 4
        needs, unit = sampled_needs(index, grid, dim, min(sample, most_sample), least)
    if len(needs) < wanted and len(unit):
        draw = np.random.Generator(np.random.PCG64(SEED))
        x = unit[draw.integers(0, len(unit), wanted - len(needs))]
        aside = draw.standard_normal(x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        y = least * x + np.sqrt(max(0.0, 1 - least * least)) * np.where(length > 1e-9, aside / np.maximum(length, 1e-9), 0)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        own_x, own_y = grid.visits(x, 1)[:, 0], grid.visits(y, 1)[:, 0]
        needs = np.r_[needs, np.minimum(grid.rank(x, own_y), grid.rank(y, own_x))]
    return int(np.sort(needs)[max(0, int(np.ceil(target * len(needs))) - 1)]) if len(needs) else 1


_VISIT = "cell long, node long, size long, own long, vector binary, visited binary"


def _visits(grid: Grid, dim: int, count: int, narrow: bool):
    """Of every vector, a row for its own cell, with the other cells it visits, and a row for each cell it visits."""
    step = max(1, (1 << 16) // count)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column(1), dim)
                if not len(x):
                    continue
                cells = grid.visits(_unit(x), count)
                row = np.repeat(np.arange(len(x)), cells.shape[1])
                if narrow:
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(cells[row, 0] == cells.ravel())], names=["cell", "is_own"])
                    continue
                node, size = part.column(0).to_numpy(), part.column(2).to_numpy()
                vector = pa.array([v.tobytes() for v in x], pa.binary())
                visited = pa.array([np.sort(c).tobytes() for c in cells], pa.binary())
                own = pa.RecordBatch.from_arrays([pa.array(cells[:, 0].copy()), pa.array(node), pa.array(size), pa.array(cells[:, 0].copy()), vector, visited], names=["cell", "node", "size", "own", "vector", "visited"])
                yield own
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(node[row]), pa.array(size[row]), pa.array(cells[row, 0]), vector.take(take), pa.nulls(len(row), pa.binary())], names=own.schema.names)

    return run


def _verified(dim: int, dtype: str, least: float):
    """Of each vector with a link in the group: the links found, by the number of equal vectors, and the smallest node its links reach in the group."""

    def run(group: pa.Table) -> pa.Table:
        node, size, own, cell = (group[c].to_numpy() for c in ("node", "size", "own", "cell"))
        x = np.frombuffer(b"".join(group["vector"].to_pylist()), dtype).reshape(-1, dim)
        visited = group["visited"].to_pylist()
        data = np.array([v is not None for v in visited], bool)
        unit = _unit(x)
        keys = [group[c].to_numpy() for c in ("cell", "d", "q")]
        order = np.lexsort(keys)
        changes = np.logical_or.reduce([np.diff(key[order]) != 0 for key in keys])
        names, place = np.unique(node, return_inverse=True)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for rows in np.split(order, np.flatnonzero(changes) + 1):
            qi, di = rows[~data[rows]], rows[data[rows]]
            if not len(qi) or not len(di):
                continue
            for a, b in _links(x, unit, qi, di, least):
                # of a pair within the cell the smaller node's visit counts; of others, where both visit each other, that to the larger cell
                here = own[a] == cell[a]
                count = np.where(here, node[a] < node[b], True)
                for k in np.flatnonzero(~here & (own[a] > cell[a])):
                    back = np.frombuffer(visited[b[k]], np.int64)
                    at = np.searchsorted(back, own[a[k]])
                    count[k] = at == len(back) or back[at] != own[a[k]]
                a, b = a[count], b[count]
                np.add.at(links, place[a], size[b])
                np.add.at(links, place[b], size[a])
                root = _joined(root, place[a], place[b])
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(names[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "root": pa.array(names[root[hit]], pa.int64())})

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` with the sets of each pair joined."""
    return groups_of(np.r_[root[a], np.arange(len(root))], np.r_[root[b], root], len(root))


def linked_nodes(index: DataFrame, grid: Grid, dim: int, dtype: str, visits: int, least: float, block: int = BLOCK) -> DataFrame:
    """node, links and root, one or more rows of every node that has links, of the table ``index`` (node, vector, size)."""
    counts = index.mapInArrow(_visits(grid, dim, visits, True), "cell long, is_own boolean").groupBy("cell").agg(F.count_if("is_own").alias("n"), F.count("*").alias("m"))
    counts = materialize(counts.where("n > 0").select("cell", "n", "m", F.ceil(F.col("n") / block).cast("int").alias("nd"), F.ceil(F.col("m") / block).cast("int").alias("nq")), "grid-cells")
    # only cells over one block: at most rows x (visits + 1) / block of them
    large = materialize(counts.where("nd > 1 OR nq > 1").select("cell", "nd", "nq"), "large-cells")
    dealt_rows = counts.agg(F.sum(F.col("n") * F.col("nq") + F.col("m") * F.col("nd"))).first()[0] or 0
    rows = index.mapInArrow(_visits(grid, dim, visits, False), _VISIT)
    nd, nq = F.coalesce("nd", F.lit(1)), F.coalesce("nq", F.lit(1))
    place = lambda n: F.array(F.pmod(F.xxhash64("node"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    is_data = F.col("visited").isNotNull()
    dealt = rows.join(checked_broadcast(large), "cell", "left").withColumn("d", F.explode(F.when(is_data, place(nd)).otherwise(every(nd)))).withColumn("q", F.explode(F.when(is_data, every(nq)).otherwise(place(nq))))
    # small cells share a group of about a block of rows
    bucket = F.pmod(F.xxhash64("cell", "d", "q"), F.lit(1 + dealt_rows // (2 * block)))
    dealt = dealt.select("cell", "node", "size", "own", "vector", "visited", "d", "q", bucket.alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(_verified(dim, dtype, least), "node long, links long, root long")


def fitted(index: DataFrame, n: int, cell_rows: int = CELL_ROWS, most_codes: int = MOST_CODES, fit_rows: int = FIT_ROWS) -> Grid:
    """Codebooks of about the square root of (rows / ``cell_rows``) codes, fitted on about ``fit_rows`` vectors a code, or all if fewer."""
    codes = min(most_codes, max(1, int(np.ceil(np.sqrt(n / cell_rows)))))
    share = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, max(1024, fit_rows * codes) / n))
    sample = index.where(share).select("vector").collect() or index.select("vector").limit(1).collect()
    return Grid(_unit(np.array([r["vector"] for r in sample], float)), codes)


def near_vectors(vectors: DataFrame, least: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", visits: int | None = None, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, by links between vectors whose cosine is at least ``least``.

    ``visits`` is how many cells each vector visits; by default it is tuned. Beyond some ``MOST_CODES``² x ``cell_rows`` rows cells hold more
    rows, and are split into more blocks.

    Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and those of a length
    other than the most common one (the longer at a tie), link with nothing, and their component is their own id; equal
    vectors link with each other, and repeated rows count as vectors of their own; a null id takes part in links
    but names no component, and is kept where its component has no id; other columns, of any name, are not read; an empty table gives
    an empty result.
    """
    spark, v = vectors.sparkSession, F.col("vector")
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    dtype = "float32" if "array<float>" in dict(own.dtypes)["vector"] else "float64"
    if dtype == "float64":
        own = own.withColumn("vector", v.cast("array<double>"))
    finite = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    lengths = own.where(finite).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else -1
    own = materialize(own.select("id", F.when(finite & (F.size("vector") == dim), v).alias("vector")), "vectors")
    alone = own.where("vector IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return alone
    classes = own.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("least_id"), F.count("*").alias("size"))
    index = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "vector", "size", "least_id"), "classes")
    part = index.select("node", "vector", "size")
    grid = fitted(index, index.count(), cell_rows)
    found = materialize(linked_nodes(part, grid, dim, dtype, visits or tuned_visits(part, grid, dim, least), least, block), "linked")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    named = index.join(links, "node", "left").join(reached, index["node"] == reached["_node"], "left")
    named = materialize(named.select("vector", "size", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")), "labelled")
    groups = materialize(named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "components")
    result = materialize(join_groups(named, groups, ["label"], "n", "left").select("vector", "size", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"), "classes-found")
    out = join_groups(own.where("vector IS NOT NULL"), result, ["vector"], "size", "left", max_rows=_WIDE_ROWS)
    out = out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
