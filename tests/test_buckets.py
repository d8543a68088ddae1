import random

import pytest
from pyspark.sql import functions as F

from listingmill.streaming import buckets

SCHEMA = "k long, t long, v string"


def put(spark, table, number, rows, most_rows=20, share=0.25):
    buckets.upsert(spark.createDataFrame(rows, SCHEMA), number, table, "k", ["t"], most_rows, share)


def held(spark, table):
    return {r.k: (r.t, r.v) for r in buckets.current(spark, table, spark.createDataFrame([], SCHEMA).schema).collect()}


def test_buckets_split_and_keep_the_last(spark, tmp_path):
    r, table, want = random.Random(3), str(tmp_path / "t"), {}
    for number in range(4):
        rows = [(r.choice([None, *range(150)]), r.randint(0, 50) * 10 + number, f"{number}.{i}") for i in range((120, 5, 60, 0)[number])]
        rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
        put(spark, table, number, rows)
        if number == 2:
            put(spark, table, number, rows)  # a batch that is tried again
        for k, t, v in rows:
            if k not in want or want[k][0] <= t:
                want[k] = (t, v)
        assert held(spark, table) == want
    _, at = buckets.buckets(spark, table)
    rows = at.collect()
    assert len(rows) > 4 and max(x.base_rows for x in rows) <= 40
    assert sum(2.0 ** -x.depth for x in rows) == 1.0  # every key has one bucket


def test_small_batch_rewrites_no_base(spark, tmp_path):
    table = str(tmp_path / "t")
    put(spark, table, 0, [(i, 0, "x" * 20) for i in range(3000)], most_rows=500)
    before = {f for f in tmp_path.rglob("bases/**/*.parquet")}
    put(spark, table, 1, [(i * 300, 1, "new") for i in range(10)], most_rows=500)
    assert {f for f in tmp_path.rglob("bases/**/*.parquet")} == before
    assert sum(v == (1, "new") for v in held(spark, table).values()) == 10


def test_half_written_batch_is_not_seen(spark, tmp_path):
    table = str(tmp_path / "t")
    put(spark, table, 0, [(1, 1, "a")])
    spark.createDataFrame([(1, 9, "half", 0, 0)], SCHEMA + ", depth int, prefix int").write.parquet(f"{table}/deltas/batch_no=1")
    assert held(spark, table) == {1: (1, "a")}
    put(spark, table, 1, [(1, 2, "b"), (2, 1, "c")])
    assert held(spark, table) == {1: (2, "b"), 2: (1, "c")}


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty_and_null(spark, tmp_path, rows):
    put(spark, str(tmp_path / "t"), 0, rows)
    assert held(spark, str(tmp_path / "t")) == {k: (t, v) for k, t, v in rows}


def test_slots_spread(spark):
    assert spark.range(10000).select(buckets._slot("id").alias("s")).agg(F.count_distinct(F.col("s"))).first()[0] > 9900
