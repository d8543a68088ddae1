import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listingmill.llm import quality, toxicity
from listingmill.llm.common import LONGEST, held_out, labelled_sample


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out(spark, module, label, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = module.fit(docs, labels)
    out = module.score(docs, model)
    assert out.count() == docs.count()
    x = out.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(x[label].to_numpy(), x.score.to_numpy()) >= least
    assert x.score.between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_missing_labels(spark, odd, empty, module):
    label = "quality" if module is quality else "toxic"
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    ones = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    for labels in (none, ones):
        model = module.fit(odd, labels)
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score(empty, model).count() == 0


def test_labels_of_the_held_out_fifth_are_not_read(spark):
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).voters == []


def test_label_model_discounts_copies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    fire = lambda a, b: np.where(y, r.random(4000) < a, r.random(4000) < b)
    one, two = fire(0.7, 0.05), fire(0.7, 0.05)
    noise = fire(0.2, 0.2)
    votes = np.column_stack([one, two, *[noise] * 6]).astype(float)
    three = fire(0.6, 0.03)
    votes = np.column_stack([votes, three, ~(one | two | three)]).astype(float)
    post, rate, corr = toxicity.label_model(votes, 0.2, np.array([1, 1] + [0] * 6 + [1, -1]))
    # no label is seen: the rates come from the votes' agreement alone
    assert ((post > 0.5) == y).mean() > 0.88
    assert corr[2, 3] > 0.9 and abs(rate[1, 0] - 0.7) < 0.15 and abs(rate[0, 0] - 0.05) < 0.06 and abs(rate[1, 8] - 0.6) < 0.15


def test_pattern_voters():
    model = toxicity.ToxicModel([b"idiot", b"^moro"])
    names = lambda t: {model.voters[i].decode() for i in model.votes(t.encode())}
    assert names("a calm text") == names("") == {"!none"}
    assert names("you utter idiot") == {"idiot", "!person"} and names("the idiot said that he saw you") == {"idiot"}
    assert names("an IDIOT and a moron!!!") == {"idiot", "^moro", "!several", "!marks"}
    assert names("WHAT A TERRIBLE SHOUTED TEXT") == {"!none", "!capitals"} and "!drawn" in names("soooo")
    assert model.votes(b"\xff\xfe idiot") == [0]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_one_giant_labelled_text_leaves_the_rest_of_its_class(spark, module, label):
    good, bad = "a calm report about rivers and their old bridges ", "buy cheap slurword pills now click "
    for giant in (0, 1):
        rows = [(i, (good, bad)[i % 2] * (2 + i % 5), i % 2) for i in range(600)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
        known = docs.where(~held_out() & (F.col("y") == giant)).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
        first = known.first().doc_id
        text = F.when(F.col("doc_id") == first, F.repeat("text", 400_000)).otherwise(F.col("text"))
        docs = docs.select("doc_id", text.alias("text"), F.col("y").alias(label))
        sample, counts = labelled_sample(docs, docs, label, module.PER_CLASS, module.MOST_BYTES)
        assert {y: sum(1 for *_, z in sample if z == y) for y in (0, 1)} == counts
        assert all(len(t.encode()) <= LONGEST for _, t, _ in sample)
        scored = module.score(docs.where(F.length("text") < 1000), module.fit(docs, docs)).join(docs.select("doc_id", label), "doc_id").toPandas()
        assert (scored.predicted == scored[label]).mean() > 0.95


def test_labels_without_documents(spark, empty):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 20 * (i % 2), i % 2) for i in range(20)], "doc_id long, quality int")
    for d in (docs, empty):
        assert {r.score for r in quality.score(docs, quality.fit(d, labels)).collect()} == {0.5}
    assert quality.accepted(docs, quality.fit(docs, labels)).count() == 20
    with pytest.raises(ValueError, match="fits"):
        labelled_sample(docs, labels, "quality", 10, 5)


def test_quality_scores_against_brute_force(spark, sf_dir):
    """Every whole document, compressed chunk by chunk with a fresh compressor."""
    import zstandard as z

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    frame = z.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    for d in docs.collect():
        text, sizes = (d.text or "").encode(), [0, 0]
        for at in range(0, len(text), quality.CHUNK):
            for k, data in enumerate((model.good, model.bad)):
                sizes[k] += len(z.ZstdCompressor(compression_params=frame, dict_data=z.ZstdCompressionDict(data)).compress(text[at : at + quality.CHUNK]))
        diff, ratio = ((sizes[1] - sizes[0]) / sum(sizes), sum(sizes) / 2 / len(text)) if text else (0.0, 0.5)
        a, b = min(max(10 * diff, -10), 10), min(max(ratio, 0), 3)
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-np.dot([a, b, a * a, b * b, a * b, 1], model.curve))), abs=1e-9)


def test_toxicity_scores_against_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for d in docs.collect():
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (d.text or "").lower()).split()
        lexicon = [v.decode() for v in model.lexicon]
        starts = lambda w, stem: len(w.encode()) > len(stem.encode()) and w.encode().startswith(stem.encode())
        fired = [i for i, v in enumerate(lexicon) if any(starts(w, v[1:]) if v.startswith("^") else w == v for w in words)]
        assert fired == [v for v in model.votes((d.text or "").encode()) if v < len(lexicon)]
        z = model.weights[-1] + sum(model.weights[v] for v in model.votes((d.text or "").encode())) + model.weights[-2] * np.log1p(len(fired))
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-min(max(z, -30), 30))), abs=1e-9)


def test_labels_that_reach_beyond_the_documents(spark):
    """Only labels with documents are picked and counted, however many others there are."""
    import zlib

    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.range(100_000).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS quality")
    rows, counts = labelled_sample(docs, labels, "quality", 60, 1 << 20)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r[0] for r in rows) == ids
    assert counts == {y: sum((i % 3 == 0) == y for i in ids) for y in (0, 1)}
    for per_class in (7, 1):
        rows, same = labelled_sample(docs, labels, "quality", per_class, 1 << 20)
        assert same == counts and all(sum(r[2] == y for r in rows) == per_class for y in (0, 1))


def test_a_class_of_empty_texts_is_sampled(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "some words") for i in range(40)], "doc_id long, text string")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows, counts = labelled_sample(docs, labels, "quality", 100, 1 << 20)
    assert {y: sum(r[2] == y for r in rows) for y in (0, 1)} == counts and min(counts.values()) > 0


def test_a_class_without_room_is_an_error(spark):
    docs = spark.createDataFrame([(i, "w " * 500 if i % 2 else "w") for i in range(40)], "doc_id long, text string")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    with pytest.raises(ValueError, match="class"):
        labelled_sample(docs, labels, "quality", 100, 100)
