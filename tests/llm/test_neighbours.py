import numpy as np
import pytest

from listingmill.llm import neighbours, queries


def brute(rows, k=5):
    """(query, rank, id, score) of the nearest by cosine in double precision, found row by row."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    norms = np.array([np.sqrt(sum(c * c for c in v)) for v in x])
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            s = np.array([float(np.dot(x[i], v)) / (norms[i] * float(np.sqrt(np.dot(v, v)))) for i in range(len(x))])
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_ranks_and_scores_on_driver_table(spark):
    df = queries.op7_neighbours(spark, "/root/testdata/sf0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows), answers(df)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        a = np.array(vectors[q], float)
        for i, s in found:
            b = np.array(vectors[i], float)
            assert s == pytest.approx(float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))), abs=1e-14)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def test_cells_grow_with_rows(spark):
    assert [int(np.prod(neighbours.widths(64, n))) for n in (100, 50_000, 10**6, 10**9)] == [128, 2048, 16384, 33_554_432]
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * r.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), answers(neighbours.nearest_neighbours(df, cell_rows=2, block=64))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / 200 >= 0.9


def test_nearest_cells_are_those_of_the_largest_sums():
    h = neighbours.Hashes(8, 2, [16, 16, 4], 5)
    x = np.random.default_rng(1).normal(size=(3, 8))
    for i, cells in enumerate(h.near(x, 50)):
        for t in range(2):
            a, b, c = (list(h._sides(x[i : i + 1], t))[j][0] for j in range(3))
            sums = (a[:, None, None] + b[None, :, None] + c[None, None, :]).ravel()
            assert np.allclose(sums[cells[t] - t * h.cells], -np.sort(-sums)[:50]) and len(set(cells[t])) == 50
            assert h.own(x[i : i + 1])[0, t] == cells[t][0]


@pytest.mark.parametrize("block", [8192, 3])
def test_ties_copies_and_odd_vectors(spark, block):
    r = np.random.default_rng(4)
    base = [r.normal(size=6).tolist() for _ in range(12)]
    rows = [(i, base[0] if i < 30 else base[i % 12]) for i in range(60)]
    odd = [(100, None), (150, [0.0] * 6), (200, [float("nan")] + [1.0] * 5), (250, [float("inf")] + [1.0] * 5), (300, [1.0, 2.0]), (350, []), (None, base[1]), (3, base[0])]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows + odd], "vec_id long, embedding array<double>, query string")
    df = df.union(spark.createDataFrame([(400, [None] + [1.0] * 5, "q")], "vec_id long, embedding array<double>, query string"))
    got, want = answers(neighbours.nearest_neighbours(df, probes=64, block=block)), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in sorted(neighbours.nearest_neighbours(df).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert neighbours.nearest_neighbours(df.where("vec_id < 0")).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48))
    for s in neighbours.rotations(48, 3, 1):
        assert np.allclose(np.linalg.norm(neighbours.rotate(x, s), axis=1), np.linalg.norm(x, axis=1))


def test_no_cap_on_the_probes_that_the_target_takes(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    x = r.standard_normal((600, 32)).astype("float32")
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<float>")
    hashes = neighbours.Hashes(32, 2, [64, 4], 3)
    queries = df.where(F.col("id") % 20 == 0)
    want = neighbours.tuned_probes(df, queries, hashes, 32, "float32", 5, 0.99, most=10**6)
    assert want > 8
    assert all(neighbours.tuned_probes(df, queries, hashes, 32, "float32", 5, 0.99, most=m) == want for m in (1, 3, want))
