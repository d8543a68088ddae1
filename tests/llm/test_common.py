import zlib

from listingmill.llm import common


def test_rows_are_dropped_one_by_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (None, "c", 2), (2, "b", 3)], "doc_id long, text string, _row int")
    rows, key = common.with_row_key(docs)
    assert key not in docs.columns and rows.select(key).distinct().count() == 4
    gone = rows.where("_row = 3 OR doc_id IS NULL").select(key)
    for bound in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        left = common.drop_rows(rows, key, gone)
        assert sorted(tuple(r) for r in left.collect()) == [(1, "a", 5), (2, "b", 1)] and left.columns == docs.columns
    alone, key = common.with_row_key(docs.where("_row IN (5, 1)"))
    assert sorted(r[key] for r in alone.collect()) == [1, 2]


def test_checked_broadcast_has_another_way(spark):
    t = common.materialize(spark.range(10), "t")
    wide = spark.range(100).join(common.checked_broadcast(t, 100), "id")
    assert wide.count() == spark.range(100).join(common.checked_broadcast(t, 1), "id").count() == 10


def test_held_out_is_the_fifth_by_crc(spark):
    df = spark.range(500).selectExpr("id AS doc_id").select("doc_id", common.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (None, 0)], "doc_id long, quality int")
    rows, counts = common.labelled_sample(docs, labels, "quality", 20, 1500)
    assert len([1 for *_, y in rows if y == 1]) == 15 and len(rows) == 30
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows) and sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


def test_sample_of_long_texts_disagreeing_labels_and_shared_ids(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 0]
    docs = spark.createDataFrame([(i, "word " * 200_000 if i % 10 == 1 else f"text {i}") for i in ids] + [(ids[0], "another"), (ids[2], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[1], 1 - ids[1] % 2)], "doc_id long, quality int")
    first = common.labelled_sample(docs, labels, "quality", 500, common.LONGEST)
    again = common.labelled_sample(docs.repartition(3), labels.repartition(2), "quality", 500, common.LONGEST)
    assert first == again
    rows, counts = first
    by = {i: t for i, t, _ in rows}
    assert ids[1] not in by and sum(counts.values()) == len(ids) - 1
    assert {y for *_, y in rows} == {0, 1} and all(len(t.encode()) <= common.LONGEST for t in by.values())
    # a long text that does not fit takes no other's place
    assert all(i in by for i in ids if i % 10 != 1 and i != ids[1])


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
