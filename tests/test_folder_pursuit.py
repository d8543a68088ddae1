import datetime as dt

from pyspark.sql import functions as F

from listingmill.sources import readers
from listingmill.streaming import jobs, pursuit


def test_saved_body_is_what_follows_the_line(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Subject: x\n" + "=" * 72 + "\nfirst\nsecond\n")
    (tmp_path / "two.txt").write_text("no line\nat all")
    assert {r.file: r.body for r in readers.read_bodies(spark, str(tmp_path)).collect()} == {"one.txt": "first\nsecond\n", "two.txt": "no line\nat all"}


def test_folder_stream_keeps_each_header_and_reads_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    run = lambda: jobs.run_to_end(readers.folder_stream(spark, src), out, check)
    rows = lambda: sorted((r.file, r.title, r.revenue, r.cells.get("more")) for r in spark.read.parquet(out).collect())
    for i in range(40):
        (tmp_path / "in" / f"{i:02}.csv").write_text(("title,revenue\n", "revenue, title ,more\n")[i % 2] + ('"A, ""b""\nc",$1', '"$1", x ,y')[i % 2] + "\n\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    (tmp_path / "in" / "head.csv").write_text("﻿title,url\n")
    (tmp_path / "in" / "ragged.csv").write_text("﻿title,url\nonly\nt,u,extra\n")
    run()
    first = rows()
    assert len(first) == 42 and first[0] == ("00.csv", 'A, "b"\nc', 1.0, None) and first[1] == ("01.csv", "x", 1.0, "y")
    run()
    assert rows() == first
    (tmp_path / "in" / "late.csv").write_text("title\nnew\n")
    run()
    assert len(rows()) == 43
    assert readers.import_folder(spark, src, spark.createDataFrame([("late.csv",)], "file string")).count() == 42


EVENT = "msg_id string, deal_id long, event_type string, at timestamp, nda_url string, thread_url string, file string"


def test_pursuit_goes_forward_and_counts_a_message_once(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    batches = [
        [("a", 1, "nda_signed", day(5), "n5", "t5", None), ("b", 1, "cim_received", day(6), None, None, None), ("c", None, "nda_signed", day(6), "n", None, None)],
        [("a", 1, "nda_signed", day(5), "n5", "t5", None), ("d", 1, "nda_available", day(2), "n2", "t9", None), ("c", None, "nda_signed", day(6), "n", None, None), (None, 1, "cim_received", day(7), None, None, "x.pdf"), ("z", 2, "cim_received", None, None, None, "x.pdf")],
        [("e", 1, "cim_received", day(8), "n8", None, "cim.pdf"), ("e", 1, "cim_received", day(8), "n8", None, "cim.pdf"), ("f", 2, "nda_available", day(8), None, "", None), ("g", 3, "cim_received", day(8), None, None, "c.pdf")],
    ]
    for b in batches:
        spark.createDataFrame(b, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stages = spark.createDataFrame([(2, "shortlist"), (3, "dead"), (None, "x")], "deal_id long, stage string")
    stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema, files=1)
    out = pursuit.apply_events(stream, stages)
    out.writeStream.outputMode("append").foreachBatch(lambda df, n: pursuit.write_applied(df, n, str(tmp_path))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    log, deals, files = (spark.read.parquet(str(tmp_path / x)) for x in ("log", "deals", "files"))
    assert sorted((r.msg_id, r.status) for r in log.collect()) == [("a", "applied"), ("a", "duplicate"), ("b", "applied"), ("c", "duplicate"), ("c", "unmatched"), ("d", "applied"), ("e", "applied"), ("e", "duplicate"), ("f", "applied"), ("g", "applied")]
    now = {r.deal_id: (r.d.stage, r.d.nda_url, r.d.thread_url) for r in deals.groupBy("deal_id").agg(F.max_by(F.struct("stage", "nda_url", "thread_url"), "step").alias("d")).collect()}
    assert now == {1: ("cim", "n5", "t5"), 2: ("contacted", None, None), 3: ("dead", None, None)}
    assert sorted((r.deal_id, r.msg_id, r.file) for r in files.collect()) == [(1, "e", "cim.pdf"), (3, "g", "c.pdf")]
