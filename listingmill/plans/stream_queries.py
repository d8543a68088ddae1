"""Streaming jobs run to their end over the event table; results equal those of a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.plans import projections as p
from listingmill.sources import readers
from listingmill.streaming import jobs, pursuit

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; one of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    folder = _folder(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{folder}/in")
    return jobs.read_stream(spark, f"{folder}/in", e.schema), folder


@query("stream_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _upsert(s, d):
    folder = _folder(s)
    e = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = jobs.read_stream(s, f"{folder}/in", e.schema, files=2)  # two batches or more, of rows in no order
    jobs.upsert_latest(stream, f"{folder}/table", f"{folder}/check", "user_id", ["ts", "event_id"])
    return jobs.current(s, f"{folder}/table", stream.schema).select("user_id", "event_id", "event_type")


@query("stream_dedupe", "SELECT DISTINCT event_id // 3 AS msg_id FROM events")
def _dedupe(s, d):
    stream, folder = _source(s, d)
    first = jobs.first_messages(stream.withColumn("msg_id", F.floor(F.col("event_id") / 3)), "msg_id", "ts", "400 days")
    jobs.run_to_end(first.select("msg_id"), f"{folder}/out", f"{folder}/check")
    return s.read.schema("msg_id long").parquet(f"{folder}/out")


@query("stream_stage", f"WITH outreach AS ({p.duck(p.OUTREACH)}), r AS (SELECT deal_id, max(CASE event_type WHEN 'nda_available' THEN 2 WHEN 'nda_signed' THEN 3 WHEN 'cim_received' THEN 4 ELSE 1 END) AS k FROM outreach GROUP BY 1) SELECT deal_id, (['inbox', 'contacted', 'nda', 'cim'])[k] AS stage FROM r")
def _stage(s, d):
    stream, folder = _source(s, d)
    kind = F.when(F.col("event_type") == "purchase", "nda_signed").when(F.col("event_type") == "view", "nda_available").when(F.col("event_type") == "click", "cim_received").otherwise("call_request")
    events = stream.select(F.col("user_id").alias("deal_id"), "event_id", "ts", kind.alias("event_type"))
    out = jobs.stage_machine(events)

    def keep(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/v{number}")

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    found = s.read.parquet(f"{folder}/out/*")
    return found.groupBy("deal_id").agg(F.max_by("stage", "batch").alias("stage"))


#: Attempts of the event table: two kinds of events are logins of one of 40 accounts, in hundredths of their real times, so that they come close.
ATTEMPTS = "SELECT event_id AS attempt_id, 'a' || CAST(user_id % 40 AS STRING) AS account, {at} AS tried FROM {{events}} WHERE event_type IN ('click', 'view')"


@query(
    "login_attempts",
    f"""WITH RECURSIVE e AS ({ATTEMPTS.format(at="epoch_ms(ts::TIMESTAMP) // 100").format(events="events")}), w AS (
  SELECT account, min(tried) AS opened FROM e GROUP BY account
  UNION ALL SELECT e.account, min(e.tried) FROM w JOIN e ON e.account = w.account AND e.tried > w.opened + 600000 GROUP BY e.account
), r AS (
  SELECT e.attempt_id, e.account, row_number() OVER (PARTITION BY e.account, w.opened ORDER BY e.tried, e.attempt_id) AS attempt
  FROM e JOIN w ON w.account = e.account AND e.tried BETWEEN w.opened AND w.opened + 600000
)
SELECT account AS key, attempt_id, attempt::INTEGER AS attempt, attempt > 10 AS denied FROM r""",
)
def _logins(s, d):
    folder = _folder(s)
    e = p.spark_view(s, d, ATTEMPTS.format(at="timestamp_millis(unix_millis(CAST(ts AS TIMESTAMP)) div 100)"))
    # three deliveries, the attempts of each in any order, then a tick a day later with which all of them are due
    cuts = e.agg(F.min("tried").alias("a"), F.max("tried").alias("z")).select(*[F.expr(f"a + (z - a) * {k} / 3") for k in range(4)], F.expr("z + INTERVAL 1 DAY")).first()
    for k in range(3):
        e.where((F.col("tried") > F.lit(cuts[k]) if k else F.lit(True)) & (F.col("tried") <= F.lit(cuts[k + 1]) if k < 2 else F.lit(True))).orderBy(F.xxhash64("attempt_id")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s.range(1).select(F.lit(-1).cast("long").alias("attempt_id"), F.lit("tick").alias("account"), F.lit(cuts[4]).alias("tried")).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.read_stream(s, f"{folder}/in", e.schema, files=1)
    jobs.run_to_end(jobs.limited_attempts(stream, "account", "attempt_id", "tried"), f"{folder}/out", f"{folder}/check")
    return s.read.schema("key string, attempt_id long, attempt int, denied boolean").parquet(f"{folder}/out").where("key <> 'tick'")


#: Files of fifty customers each. Every fourth has the same header: names in another order, other names, columns that nothing knows, texts over two lines.
_FILES = """SELECT c_custkey AS n, c_custkey div 50 AS file_no, (c_custkey div 50) % 4 AS kind, CASE (c_custkey div 50) % 4
 WHEN 0 THEN concat(c_name, ',https://x.example/', c_custkey, ',\"$1,', lpad(c_custkey % 1000, 3, '0'), '\"')
 WHEN 1 THEN concat(c_custkey, ' ,  ', c_name, ' , TX')
 WHEN 2 THEN concat('\"[\"\"earnings\"\"]\",https://y.example/', c_custkey, ',n/a,', c_name)
 ELSE concat('\"', c_name, '\n(second line)\",,', c_mktsegment) END AS line FROM {customer}"""
_HEADS = ("title,url,revenue", "asking, title ,state", "needs_llm,url_norm,sde,title", "title,blurb,segment")


@query(
    "folder_import",
    """WITH c AS (SELECT *, (c_custkey // 50) % 4 AS kind, CASE (c_custkey // 50) % 4 WHEN 0 THEN 'https://x.example/' || c_custkey WHEN 2 THEN 'https://y.example/' || c_custkey END AS u FROM customer)
SELECT CASE WHEN u IS NOT NULL THEN 'csv:' || u ELSE 'csv:' || trim(regexp_replace(lower(c_name || CASE kind WHEN 3 THEN ' (second line)' ELSE '' END), '[^a-z0-9]+', '-', 'g'), '-') || CASE kind WHEN 1 THEN ':tx' ELSE ':na' END END AS ext_id,
 c_name || CASE kind WHEN 3 THEN chr(10) || '(second line)' ELSE '' END AS title, u AS url, CASE kind WHEN 1 THEN 'TX' END AS state, CASE kind WHEN 0 THEN 1000.0::DOUBLE + c_custkey % 1000 END AS revenue, CASE kind WHEN 1 THEN c_custkey::DOUBLE END AS asking, NULL::DOUBLE AS sde,
 CASE kind WHEN 2 THEN 'earnings' ELSE '' END AS needs, CASE kind WHEN 3 THEN c_mktsegment END AS segment FROM c""",
)
def _folder_import(s, d):
    """Files come in two deliveries; the job runs after each, and once more when there is nothing new."""
    folder = _folder(s)
    lines = p.spark_view(s, d, _FILES)
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.first("kind") + 1).cast("int"))
    texts = lines.groupBy("file_no").agg(F.concat_ws("\n", head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("text"))  # fifty lines a file
    for half in (0, 1):
        texts.where(F.col("file_no") % 2 == half).repartition("file_no").write.mode("append").partitionBy("file_no").text(f"{folder}/in")
        for _ in range(1 + half):
            jobs.run_to_end(readers.folder_stream(s, f"{folder}/in", "*.txt"), f"{folder}/out", f"{folder}/check")
    out = s.read.parquet(f"{folder}/out")
    return out.select("ext_id", "title", "url", "state", "revenue", "asking", "sde", F.array_join("needs_llm", ",").alias("needs"), F.try_element_at("cells", F.lit("segment")).alias("segment"))


#: Mail of half the events, about deals of their users (none for each seventh); each third message is delivered again later.
_MAIL = """SELECT 'm' || CAST(event_id AS STRING) AS msg_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS deal_id, CASE event_type WHEN 'purchase' THEN 'nda_signed' WHEN 'view' THEN 'nda_available' WHEN 'click' THEN 'cim_received' ELSE 'call_request' END AS event_type, {at} AS at,
 CASE WHEN event_id % 4 < 2 THEN 'https://nda.example/' || CAST(event_id AS STRING) END AS nda_url, CASE WHEN event_id % 5 > 0 THEN 'https://mail.example/' || CAST(event_id % 1000 AS STRING) END AS thread_url, CASE WHEN event_id % 6 = 0 THEN 'cim.pdf' END AS file, event_id FROM {{events}} WHERE event_id % 2 = 0"""
_STARTS = "SELECT DISTINCT user_id AS deal_id, CASE user_id % 5 WHEN 0 THEN 'shortlist' WHEN 1 THEN 'cim' WHEN 2 THEN 'dead' ELSE 'inbox' END AS stage FROM {events} WHERE user_id % 3 = 0"


@query(
    "pursuit_events",
    f"""WITH m AS ({_MAIL.format(at="epoch_ms(ts::TIMESTAMP)").format(events="events")}), st AS ({_STARTS.format(events="events")}),
d AS (SELECT deal_id, max(CASE WHEN event_type = 'nda_available' THEN 3 WHEN event_type = 'nda_signed' THEN 4 WHEN event_type = 'cim_received' AND file IS NOT NULL THEN 5 ELSE 0 END) AS k,
 arg_max(nda_url, row(m.at, m.msg_id)) FILTER (nda_url IS NOT NULL AND event_type IN ('nda_available', 'nda_signed')) AS nda_url, arg_max(thread_url, row(m.at, m.msg_id)) FILTER (thread_url IS NOT NULL) AS thread_url,
 count(*) AS applied, count(*) FILTER (event_id % 3 = 0) AS duplicates, count(*) FILTER (event_type = 'cim_received' AND file IS NOT NULL) AS files FROM m WHERE deal_id IS NOT NULL GROUP BY 1),
j AS (SELECT d.*, coalesce(st.stage, 'inbox') AS s FROM d LEFT JOIN st USING (deal_id))
SELECT deal_id, CASE s WHEN 'dead' THEN s ELSE (['inbox', 'shortlist', 'contacted', 'nda', 'cim'])[greatest(k, list_position(['inbox', 'shortlist', 'contacted', 'nda', 'cim'], s))] END AS stage, nda_url, thread_url, applied, duplicates, files FROM j
UNION ALL SELECT NULL, 'unmatched', NULL, NULL, count(*), count(*) FILTER (event_id % 3 = 0), 0 FROM m WHERE deal_id IS NULL HAVING count(*) > 0""",
)
def _pursuit(s, d):
    """Three deliveries in no order of time; the third repeats messages of the first two, and some events of old times come last. The job runs after each."""
    folder = _folder(s)
    mail = p.spark_view(s, d, _MAIL.format(at="CAST(ts AS TIMESTAMP)"))
    turn = F.pmod(F.xxhash64("event_id"), F.lit(3))
    stages = p.spark_view(s, d, _STARTS).checkpoint()
    for k in range(3):
        part = mail.where(turn == k)
        if k == 2:
            part = part.unionByName(mail.where(F.col("event_id") % 3 == 0))
        part.drop("event_id").write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_stream(s, f"{folder}/in", mail.drop("event_id").schema)
        out = pursuit.apply_events(stream, stages, "4000 days")
        out.writeStream.outputMode("append").foreachBatch(lambda df, n: pursuit.write_applied(df, n, folder)).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    log, deals, files = (s.read.parquet(f"{folder}/{x}") for x in ("log", "deals", "files"))
    n = log.groupBy("deal_id").agg(F.count_if(F.col("status") != "duplicate").alias("applied"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))
    now = deals.groupBy("deal_id").agg(F.max_by(F.struct("stage", "nda_url", "thread_url"), "step").alias("d")).select("deal_id", "d.*")
    saved = files.groupBy("deal_id").agg(F.count("*").alias("files"))
    both = n.where("deal_id IS NOT NULL").join(now, "deal_id").join(saved, "deal_id", "left")
    rest = n.where("deal_id IS NULL").select("deal_id", F.lit("unmatched").alias("stage"), F.lit(None).cast("string").alias("nda_url"), F.lit(None).cast("string").alias("thread_url"), "applied", "duplicates", F.lit(0).cast("long").alias("files"))
    return both.select("deal_id", "stage", "nda_url", "thread_url", "applied", "duplicates", F.coalesce("files", F.lit(0)).alias("files")).unionByName(rest)
