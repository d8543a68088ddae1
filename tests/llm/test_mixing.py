import numpy as np
import pytest
from pyspark.sql import functions as F

from listingmill.llm import mixing, queries


def test_rake_meets_all_marginals():
    r = np.random.default_rng(1)
    cells = r.integers(1, 100, (4, 3, 2)).astype(float)
    shares = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.7, 0.3])]
    out = mixing.rake(cells, shares)
    for axis, share in enumerate(shares):
        have = out.sum(tuple(i for i in range(3) if i != axis)) / out.sum()
        assert np.allclose(have, share, atol=1e-8)


def test_sampling_meets_targets_in_expectation(spark):
    r = np.random.default_rng(2)
    rows = [(i, "w " * (5 + i % 7), "src0" if i % 3 else f"src{r.integers(20)}", ("en", "de", "fr", "es")[r.integers(4)]) for i in range(6000)] + [(None, None, None, None), (1, "", "odd", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix_sources(df, keep_share=None).join(df.select("doc_id", "source", "lang"), "doc_id").toPandas()
    assert len(mixing.mix_sources(df).collect()) == len(rows)
    listed = out[out.source.str.startswith("src")]
    mass = (listed.n_tokens * listed.probability).groupby(listed.source).sum()
    assert np.allclose(mass / mass.sum(), 1 / len(mass), atol=0.01)
    assert out.probability.max() <= 1 and (out.sampled == (out.draw < out.probability)).all()
    half = mixing.mix_sources(df, keep_share=0.5).toPandas()
    assert abs((half.n_tokens * half.probability).sum() / half.n_tokens.sum() - 0.5) < 1e-6


def test_topics_and_empty(spark, empty):
    df = spark.createDataFrame([("a | b | c |",), ("#### $$$$ word",), ("LOUD!! WORDS!! here",), ("plain words",), (None,)], "text string")
    assert [r[0] for r in df.select(mixing.topic_of(df.text)).collect()] == ["table", "symbols", "shouting", "prose", "prose"]
    assert mixing.mix_sources(empty).count() == 0


def test_registered_parameters_meet_all_targets_on_a_hot_source(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    monkeypatch.setattr(queries, "_read", lambda *_: docs)
    out = queries.op5_mixing(spark, "").join(docs.select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic")), "doc_id").toPandas()
    mass = out.n_tokens * out.probability
    for kind in ("source", "lang", "topic"):
        wanted = {k: v for k, v in mixing.DEFAULT.of(kind).items() if (out[kind] == k).any()}
        have = mass.groupby(out[kind]).sum().reindex(list(wanted))
        assert np.allclose(have / have.sum(), np.array(list(wanted.values())) / sum(wanted.values()), atol=1e-5), kind
    assert out.probability.max() <= 1 and mass.sum() / out.n_tokens.sum() > 0.1
    print("kept share", mass.sum() / out.n_tokens.sum(), "weights up to", out.weight.max())


def test_bounded_raking_moves_mass_between_cells():
    cells = np.array([[100.0, 10.0], [10.0, 100.0]])
    wanted = [np.array([60.0, 60.0]), np.array([60.0, 60.0])]
    w, met = mixing.rake_within(cells, np.array([[0.1, 9.0], [9.0, 0.1]]), wanted)
    assert met and w.max() <= 1 and np.allclose((cells * w).sum(0), 60, atol=1e-4) and np.allclose((cells * w).sum(1), 60, atol=1e-4)
    assert not mixing.rake_within(cells, np.ones((2, 2)), [np.array([115.0, 5.0]), np.array([60.0, 60.0])])[1]


def test_weights_and_draws_against_brute_force(spark, sf_dir):
    """The registered query over every document: cells counted, raked and drawn in plain Python."""
    import re
    import struct

    import xxhash

    from listingmill.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op5_mixing(spark, sf_dir).collect()}
    want = mixing.DEFAULT
    kinds = [[v for v, _ in want.of(k).items()] + ["*"] for k in ("source", "lang", "topic")]

    def topic(t):
        n, marks = len(t), sum(t.count(c) for c in "#$%&*")
        return "table" if t.count("|") * 50 > n else "symbols" if marks * 20 > n else "shouting" if t.count("!") * 50 > n else "prose"

    cells, of, size = {}, {}, {}
    for d in docs:
        t = d.text or ""
        own = (d.source, d.lang, topic(t))
        cell = tuple(v if v in k else "*" for v, k in zip(own, kinds, strict=True))
        of[d.doc_id], size[d.doc_id] = cell, len(re.findall("[^ \t-\r]+", t))
        cells[cell] = cells.get(cell, 0) + size[d.doc_id]
    total = sum(cells.values())
    shares = []
    for i, k in enumerate(kinds):
        have = {v: sum(n for c, n in cells.items() if c[i] == v) / total for v in k}
        goal = {v: (dict(want.of(("source", "lang", "topic")[i])).get(v, 0) if have[v] else 0) for v in k[:-1]}
        scale = (1 - have["*"]) / sum(goal.values())
        shares.append({**{v: x * scale for v, x in goal.items()}, "*": have["*"]})
    raked = {c: float(n) for c, n in cells.items()}
    for _ in range(400):
        for i, k in enumerate(kinds):
            for v in k:
                now = sum(n for c, n in raked.items() if c[i] == v)
                for c in raked:
                    if c[i] == v and now:
                        raked[c] *= shares[i][v] * total / now
    kept = sum(size[i] * r.probability for i, r in rows.items())
    assert abs(kept / total - 0.5) < 0.01
    for i, r in rows.items():
        h = xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(str(i).encode(), 42))
        assert r.n_tokens == size[i] and r.draw == (h >> 11) / (1 << 53) and r.sampled == (r.draw < r.probability) and 0 <= r.probability <= 1
    # without a share to keep, the weights are the raked over the observed tokens
    for r in mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_share=None).collect():
        c = of[r.doc_id]
        assert r.weight == pytest.approx(raked[c] / cells[c] if cells[c] else 1.0, rel=1e-3, abs=1e-6)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "src0", "en", 7, 8), (None, None, None, None, 7, 8)], "doc_id long, text string, source string, lang string, cell int, n_tokens int")
    assert sorted(r.n_tokens for r in mixing.mix_sources(docs).collect()) == [0, 2]
    assert mixing.sampled(docs, keep_share=1.0).columns == docs.columns
