"""Nested messages, the login counter and the capped report on odd rows."""

import base64
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from listingmill.operators import rules
from listingmill.sources import readers
from listingmill.streaming import jobs


def b64(raw):
    return base64.urlsafe_b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode()


def leaf(mime, raw, **more):
    return {"mimeType": mime, "body": {"data": b64(raw)}, **more}


def walked(payload):
    found = {}

    def walk(part):
        mime = (part.get("mimeType") or "").lower()
        data = (part.get("body") or {}).get("data")
        if data and mime not in found:
            found[mime] = base64.urlsafe_b64decode(data).decode("utf-8", errors="replace")
        for child in part.get("parts") or []:
            walk(child)

    walk(payload or {})
    return found.get("text/plain"), found.get("text/html")


def test_nested_mailbox(spark, tmp_path):
    deep = leaf("text/plain", "deep")
    for _ in range(30):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    payloads = {
        "one": leaf("TEXT/Plain", "only ÿ_–?>"), "deep": {"parts": [deep, leaf("text/plain", "later"), leaf("text/html", "<p>")]}, "order": {"parts": [{"parts": [leaf("text/html", "h1")]}, leaf("text/plain", "p1"), {"parts": [leaf("text/plain", "p2"), leaf("text/html", "h2")]}]},
        "broken": leaf("text/html", b"a\xffb"), "empty": {}, "blank": {"parts": [leaf("text/plain", ""), leaf("text/plain", "next")]}, "none": None, "named": {"parts": [{"mimeType": "image/png", "filename": "a.png", "body": {"size": 7, "attachmentId": "x"}}]},
    }
    lines = [json.dumps({"id": k, "payload": v}) for k, v in payloads.items()] + ["not json", "{}", "[1]", json.dumps({"id": "odd", "payload": {"parts": [1, "x", None, [], {"mimeType": 3, "body": 5, "parts": "no"}]}}), json.dumps({"id": "bad", "payload": {"mimeType": "text/plain", "body": {"data": "***"}}})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    parts = readers.walk_parts(readers.read_nested_mailbox(spark, str(tmp_path))).checkpoint()
    got = {r.id: (r.plain, r.html) for r in readers.first_texts(parts).collect()}
    assert got == {k: walked(v) for k, v in payloads.items()} | {"odd": (None, None), "bad": (None, None)}
    named = parts.where("filename <> ''").collect()
    assert [(r.id, r.path, r.filename, r.size, r.attachment_id) for r in named] == [("named", [0], "a.png", 7, "x")]
    assert parts.agg(F.max(F.size("path"))).first()[0] == 31


def counted(rows, limit, window):
    """Attempts one by one, as a counter in memory does it."""
    buckets, out = {}, set()
    for at, i, key in sorted(rows):
        count, reset = buckets.get(key, (0, -1))
        count, reset = (count + 1, reset) if count and reset >= at else (1, at + window)
        buckets[key] = (count, reset)
        out.add((key, i, count, count > limit))
    return out


def test_attempts_in_any_order_within_the_lateness(spark, tmp_path):
    r = random.Random(3)
    start = 1_700_000_000_000
    rows = sorted((start + r.randrange(0, 3_600_000), i, r.choice("abc")) for i in range(300))
    shuffled = sorted(rows, key=lambda x: x[0] + r.randrange(0, 55_000))  # up to a minute late
    late = (start, 999, "a")
    files = [shuffled[:100], shuffled[100:200], [late, *shuffled[200:]], [(start + 90_000_000, -1, "tick")]]
    kind = "ms long, attempt_id long, account string"
    for part in files:
        spark.createDataFrame(part, kind).withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files=1)
    for _ in range(2):  # run again: nothing is added
        jobs.run_to_end(jobs.limited_attempts(stream, "account", "attempt_id", "at", limit=3), f"{tmp_path}/out", f"{tmp_path}/check")
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").where("key <> 'tick'").collect()]
    want = counted(rows, 3, 600_000)
    assert len(got) == len(set(got)) and set(got) == want and any(d for *_, d in want)


@pytest.mark.parametrize("cap", [0, 1, 3, 25])
def test_capped_report(spark, cap):
    r = random.Random(5)
    rows = [(i, r.randint(0, 3), r.random() < 0.2, r.random() < 0.1, dt.date(2026, 1, r.randint(1, 4)) if r.random() < 0.9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, score int, strategic boolean, rejected boolean, day date")
    want = []
    for day in {x[4] for x in rows}:
        due = sorted((x for x in rows if x[4] == day and not x[3]), key=lambda x: (not x[2], -x[1], x[0]))
        want += [(x[0], place) for place, x in enumerate(due, 1) if x[2] or place <= cap]
    assert sorted((x.id, x.place) for x in rules.capped_report(df, "day", cap).collect()) == sorted(want)
