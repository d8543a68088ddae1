"""Readers with explicit schemas; malformed input becomes nulls and is left out, never an error."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.functions.money import to_number

MESSAGE = "msg_id string, sender string, subject string, received string, body string"
PARTS = "id string, threadId string, headers array<struct<name:string,value:string>>, parts array<struct<mime:string,data:string,filename:string,attachment_id:string,size:long>>"
SNAPSHOT = "schema string, exportedAt string, deals array<struct<extId:string,title:string,blurb:string,source:string,subSource:string,nickname:string,city:string,state:string,county:string,revenue:double,ebitda:double,sde:double,asking:double,businessModelType:string,needsLlm:array<string>,url:string,firstSeen:string,lastSeen:string,timesSeen:int>>, verdicts array<struct<extId:string,member:string,action:string,reason:string,note:string,createdAt:string>>"
VERDICT_LOG = "schema string, member string, written_at string, verdicts array<struct<deal_id:string,action:string,reason:string,at:string>>"


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name; null if absent."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def part(parts: Column, mime: str) -> Column:
    """Text of the first part of a kind, from URL-safe base64."""
    data = F.get(F.filter(parts, lambda x: (x["mime"] == mime) & x["data"].isNotNull()), F.lit(0))["data"]
    return F.decode(F.unbase64(F.translate(data, "-_", "+/")), "UTF-8")


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages with flattened parts, one JSON object a line, as messages."""
    from listingmill.functions.mail import best_body

    raw = spark.read.schema(PARTS).json(path)
    return raw.select(F.col("id").alias("msg_id"), header(F.col("headers"), "from").alias("sender"), header(F.col("headers"), "subject").alias("subject"), header(F.col("headers"), "date").alias("received"), best_body(part(F.col("parts"), "text/plain"), part(F.col("parts"), "text/html")).alias("body"))


PART = "mimeType string, filename string, body struct<data:string,size:long,attachmentId:string>"


def decoded(data: Column) -> Column:
    """Text of a body in URL-safe base64: bytes that are not UTF-8 are replaced, a body that is not base64 is null."""
    return F.make_valid_utf8(F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64")).cast("string"))


def walk_parts(messages: DataFrame) -> DataFrame:
    """(id, path, mime, data, filename, size, attachment_id) of every part, at any depth, of messages (id, payload: variant).

    ``path`` numbers the parts from the payload down, so its order is that of a walk from the top. Parts are unnested a level at a time until
    none holds others: as many steps as the deepest message has levels. A part that is no object, or has fields of other types, has nulls for them.
    """
    field = lambda name, kind: F.try_variant_get("part", name, kind)
    level = messages.select("id", F.array().cast("array<int>").alias("path"), F.col("payload").alias("part"))
    levels = []
    while True:
        own = level.select("id", "path", F.lower(F.coalesce(field("$.mimeType", "string"), F.lit(""))).alias("mime"), field("$.body.data", "string").alias("data"), field("$.filename", "string").alias("filename"), field("$.body.size", "long").alias("size"), field("$.body.attachmentId", "string").alias("attachment_id"))
        levels.append(own)
        below = level.select("id", "path", F.posexplode(field("$.parts", "array<variant>")).alias("i", "below"))
        level = below.select("id", F.array_append("path", F.col("i")).alias("path"), F.col("below").alias("part")).checkpoint()
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)


def first_texts(parts: DataFrame) -> DataFrame:
    """(id, plain, html): the first text of either kind, in the order of a walk, of every message that has parts."""
    first = lambda mime: F.min_by("data", F.when((F.col("mime") == mime) & (F.coalesce("data", F.lit("")) != ""), F.col("path")))
    texts = parts.groupBy("id").agg(first("text/plain").alias("plain"), first("text/html").alias("html"))
    return texts.select("id", decoded(F.col("plain")).alias("plain"), decoded(F.col("html")).alias("html"))


def read_nested_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages (id, payload: variant with its headers and parts) of JSON objects, one a line; lines that are none, or without id, are left out."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    return raw.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.payload", "variant").alias("payload")).where("id IS NOT NULL")


def attachments(messages: DataFrame) -> DataFrame:
    """(id, filename, mime, size, attachment_id) of every named part."""
    return messages.select("id", F.explode("parts").alias("p")).where("p.filename <> ''").select("id", "p.filename", "p.mime", "p.size", "p.attachment_id")


def read_snapshot(spark: SparkSession, path: str, schema: str = "flow_import_v1") -> tuple[DataFrame, DataFrame]:
    """Deals and verdicts of snapshot documents, under their column names."""
    doc = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).where(F.col("schema") == schema)
    d = doc.select(F.explode("deals").alias("d")).select("d.*")
    v = doc.select(F.explode("verdicts").alias("v")).select("v.*")
    names = {"extId": "ext_id", "subSource": "sub_source", "businessModelType": "business_model_type", "needsLlm": "needs_llm", "firstSeen": "first_seen", "lastSeen": "last_seen", "timesSeen": "times_seen"}
    return d.withColumnsRenamed(names), v.withColumnsRenamed({"extId": "ext_id", "createdAt": "created_at"})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV snapshot by its header: trimmed, lenient numbers, JSON lists, an id made from the address or the title."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in CSV_TEXTS + CSV_NUMBERS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return typed_csv(raw)


CSV_TEXTS = ("ext_id", "title", "url", "url_norm", "state", "blurb", "needs_llm")
CSV_NUMBERS = ("revenue", "ebitda", "sde", "asking")


def typed_csv(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("url", F.coalesce("url", "url_norm"))
    return raw.withColumns({c: to_number(F.col(c)) for c in CSV_NUMBERS} | {"needs_llm": F.coalesce(F.from_json("needs_llm", "array<string>"), F.array().cast("array<string>")), "ext_id": F.coalesce("ext_id", csv_ext_id(F.col("url"), F.col("title"), F.col("state")))})


def csv_ext_id(url: Column, title: Column, state: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 72)
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("csv:"), url)).otherwise(F.concat(F.lit("csv:"), slug, F.lit(":"), F.lower(F.coalesce(F.nullif(state, F.lit("")), F.lit("na")))))


def read_verdict_logs(spark: SparkSession, path: str, seen: DataFrame | None = None, schema: str = "verdict_log_v1") -> DataFrame:
    """Events of verdict logs (deal_id, member, action, reason, at, file, pos); unknown schemas and files in ``seen`` are skipped."""
    raw = spark.read.schema(VERDICT_LOG).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_name")).where(F.col("schema") == schema)
    if seen is not None:
        raw = raw.join(seen.select("file"), "file", "left_anti")
    return raw.select("file", "member", F.posexplode("verdicts").alias("pos", "v")).select("v.deal_id", "member", "v.action", "v.reason", "v.at", "file", F.col("pos").cast("long").alias("pos"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Saved bodies: what follows the line of 72 equal signs in each file."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return raw.select("file", F.coalesce(F.get(F.split("value", "={72}\\n?", 2), F.lit(1)), F.col("value")).alias("body"))


THREAD = "messages array<struct<id:string,sender:string,subject:string,date:string,plaintextBody:string,htmlBody:string>>"


def read_threads(spark: SparkSession, path: str, wanted: DataFrame | None = None, pattern: str = "*get_thread*.txt") -> DataFrame:
    """Messages of saved threads (one JSON document a file), those whose id is in ``wanted`` (msg_id, name) under its name; all without it."""
    from listingmill.functions.mail import best_body

    docs = spark.read.schema(THREAD).option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    m = docs.select(F.explode("messages").alias("m")).select("m.*")
    m = m.select(F.col("id").alias("msg_id"), "sender", "subject", F.col("date").alias("received"), best_body(F.col("plaintextBody"), F.col("htmlBody")).alias("body"))
    return m if wanted is None else m.join(wanted, "msg_id").withColumn("msg_id", F.col("name")).drop("name")


def newer_than(messages: DataFrame, days: int, now: Column, received: str = "received") -> DataFrame:
    """Messages whose date, as mail headers write it or in ISO form, lies at most so many days before ``now``; those without a readable date are left out."""
    text = F.regexp_replace(F.regexp_replace(F.trim(received), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(received)))
    return messages.where(at >= now - F.make_dt_interval(F.lit(days)))


def _cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole CSV files as maps by each file's own header, at most 10,000 at a time; empty cells are left out."""
    for part_ in parts:
        for file, text in zip(part_["file"], part_["value"], strict=True):
            lines = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), skipinitialspace=True)
            names = [n.strip() for n in next(lines, [])]
            held: list[tuple] = []
            for row in lines:
                cells = {n: c.strip() for n, c in zip(names, row, strict=False) if n and c.strip()}
                if cells:
                    held.append((file, cells))
                if len(held) == 10_000:
                    yield pd.DataFrame(held, columns=["file", "cells"])
                    held = []
            yield pd.DataFrame(held, columns=["file", "cells"])


def csv_files(texts: DataFrame) -> DataFrame:
    """Rows of CSV files (file, value: the whole text) whose headers may all differ, as one plan: the known columns, typed, and ``cells`` with every named cell.

    A column that a file lacks is null, one that is not known is in ``cells``; of a name that repeats the last cell counts. A file without rows gives none.
    """
    rows = texts.mapInPandas(_cells, "file string, cells map<string,string>")
    known = [F.try_element_at("cells", F.lit(c)).alias(c) for c in CSV_TEXTS + CSV_NUMBERS]
    return typed_csv(rows.select("file", *known, "cells"))


def _file_texts(reader, path: str, pattern: str) -> DataFrame:
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")


def import_folder(spark: SparkSession, path: str, seen: DataFrame, pattern: str = "*.csv") -> DataFrame:
    """Rows of the CSV files of a folder whose names are not in ``seen`` (file), each with its file's name and its own header."""
    return csv_files(_file_texts(spark.read, path, pattern).join(seen.select("file").distinct(), "file", "left_anti"))


def folder_stream(spark: SparkSession, path: str, pattern: str = "*.csv", files: int = 1000) -> DataFrame:
    """The same as a stream, in which a file is read once: the checkpoint of the query that writes it is the ledger of files."""
    return csv_files(_file_texts(spark.readStream.option("maxFilesPerTrigger", files), path, pattern))
