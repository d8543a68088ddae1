"""Op 12 against brute force: links, components, copies, dense groups, blocks, odd vectors."""

import numpy as np
import pytest

from listingmill.llm import multi_index, queries
from listingmill.llm.neighbours import _unit


def brute(rows, least=0.9):
    """n_links and component_id by row of (id, vector), compared in pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x.reshape(0, 1)
    near = x @ x.T >= least
    links, group = [0] * len(rows), {i: {i} for i in range(len(rows))}
    for a in range(len(ok)):
        for b in np.flatnonzero(near[a]):
            if a != b:
                links[ok[a]] += 1
                if group[ok[a]] is not group[ok[b]]:
                    both = group[ok[a]] | group[ok[b]]
                    for k in both:
                        group[k] = both
    return sorted(((rows[i][0], links[i], min((rows[k][0] for k in group[i] if rows[k][0] is not None), default=None)) for i in range(len(rows))), key=repr)


def planted(seed=3, n=1500, dim=64, groups=40, big=300):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    parts = [x]
    for _ in range(groups):  # looser copies, chains and exact ones among them
        base = x[r.integers(n)]
        parts.append(base + r.standard_normal((r.integers(1, 6), dim)) * r.choice([0.0, 0.05, 0.3, 0.42]))
    parts.append(x[0] + 0.02 * r.standard_normal((big, dim)))
    return np.concatenate(parts).astype("float32")


def table(spark, x):
    return spark.createDataFrame([(i * 3, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block,visits", [(4096, None), (64, None), (50, 10**6)])
def test_planted(spark, block, visits):
    x = planted()
    rows = [(i * 3, v) for i, v in enumerate(x)]
    got = found(multi_index.near_vectors(table(spark, x), block=block, visits=visits))
    want = brute(rows)
    assert len(got) == len(want)
    if visits:  # every cell is visited: nothing may be lost, or counted twice
        assert got == want
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert np.mean([g[1] == w[1] for g, w in zip(got, want, strict=True) if w[1]]) >= 0.9
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) >= 0.97


def test_few_visits_count_no_pair_twice(spark):
    x = planted(seed=8, n=400, big=60)
    want = {r[0]: r[1] for r in brute([(i * 3, v) for i, v in enumerate(x)])}
    for visits in (1, 3, 9):
        got = found(multi_index.near_vectors(table(spark, x), visits=visits, cell_rows=4))
        assert all(n <= want[i] for i, n, _ in got)


def test_multi_sequence_order():
    r = np.random.default_rng(1)
    x = _unit(r.standard_normal((200, 10)))
    grid = multi_index.Grid(x, 9)
    a, b = grid.gaps(x)
    every = a[:, :, None] + b[:, None, :]
    for count in (1, 2, 7, grid.cells, 10**6):
        cells = grid.visits(x, count)
        want = np.sort(every.reshape(len(x), -1), 1)[:, : min(count, grid.cells)]
        assert np.allclose(np.take_along_axis(every.reshape(len(x), -1), cells, 1), want)
        assert all(len(set(c)) == len(c) for c in cells.tolist())
    assert (grid.rank(x, cells[:, 4]) == 5).all() and (grid.rank(x, cells[:, 0]) == 1).all()


def test_kmeans_spends_no_codes_on_copies():
    x = np.r_[np.zeros((500, 3)), np.eye(3)]
    assert len(multi_index.kmeans(x, 10, 1)) == 4


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, inf]), (10, [0.0, 1.0]), (None, [0.0, 3.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]), (13, [3e30, 1e28]), (None, [-5.0, -9.0]), (None, None), (14, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, size int")
    out = multi_index.near_vectors(df)
    assert found(out) == brute([(i, v if v is None or len(v) < 3 else None) for i, v in rows])
    kept = {r.vec_id: r.kept for r in out.collect() if r.vec_id is not None}
    assert kept[1] and not kept[2] and not kept[3] and kept[4] and kept[10] and kept[14]
    assert {r.kept for r in out.where("vec_id IS NULL").collect() if r.component_id is None} == {True}


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_short_vectors(spark, dim):
    r = np.random.default_rng(dim)
    x = r.standard_normal((60, dim)).astype("float32")
    got = found(multi_index.near_vectors(table(spark, x), visits=10**6, cell_rows=4))
    assert got == brute([(i * 3, v) for i, v in enumerate(x)])


def test_empty_and_unusable(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.near_vectors(none).collect() == []
    bad = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert found(multi_index.near_vectors(bad)) == [(1, 0, 1), (2, 0, 2)]


def test_query(spark, sf_dir):
    out = queries.op12_embedding_dedup(spark, sf_dir)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(out) == brute(rows)
