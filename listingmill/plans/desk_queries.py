"""What reviewers write: verdicts, stages, flags, corrections, notes, files, deals of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingmill.operators import desk, survey, views
from listingmill.plans import projections as p
from listingmill.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}
_D = f"deals AS ({p.duck(p.DEALS)})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BATCH = "SELECT event_id AS seq, user_id AS deal_id, CASE WHEN event_id % 2 = 0 THEN 'ann' ELSE 'bob' END AS member, CASE event_type WHEN 'purchase' THEN 'short' WHEN 'view' THEN 'discuss' WHEN 'click' THEN 'pass' END AS action, CAST(event_id % 3 AS STRING) AS reason, 'note ' || CAST(event_id AS STRING) AS note, CAST(ts AS TIMESTAMP) AS updated_at FROM {events}"
_HAD = "SELECT o_orderkey AS deal_id, 'ann' AS member, 'discuss' AS action, 'old' AS reason, CAST(NULL AS STRING) AS note, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM {orders} WHERE o_orderkey % 3 = 0"
_LAST = f"b AS ({p.duck(_BATCH)}), had AS ({p.duck(_HAD)}), last AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY deal_id, member ORDER BY seq DESC) = 1)"


def _write(s, d):
    return desk.set_verdicts(p.spark_view(s, d, _HAD), p.deals(s, d), p.spark_view(s, d, _BATCH))


@query("set_verdict", f"WITH {_LAST} SELECT deal_id, member, action, reason, note FROM last WHERE action IS NOT NULL UNION ALL SELECT deal_id, member, action, reason, note FROM had h WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.deal_id = h.deal_id AND l.member = h.member)")
def _verdicts(s, d):
    return _write(s, d)[0].select("deal_id", "member", "action", "reason", "note")


@query("shortlist_stages", f"WITH {_D}, {_LAST}, f AS (SELECT deal_id, min(seq) AS seq FROM b WHERE action = 'short' GROUP BY 1) SELECT d.id, CASE WHEN f.seq IS NOT NULL AND d.stage = 'inbox' THEN 'shortlist' ELSE d.stage END AS stage FROM deals d LEFT JOIN f ON f.deal_id = d.id")
def _stages(s, d):
    return _write(s, d)[1].select("id", "stage")


@query("shortlist_events", f"WITH {_D}, {_LAST}, f AS (SELECT deal_id, min(seq) AS seq, arg_min(member, seq) AS member FROM b WHERE action = 'short' GROUP BY 1) SELECT f.deal_id, 'inbox' AS from_stage, 'shortlist' AS to_stage, f.member, f.seq FROM f JOIN deals d ON d.id = f.deal_id WHERE d.stage = 'inbox'")
def _events(s, d):
    return _write(s, d)[2].select("deal_id", "from_stage", "to_stage", "member", "seq")


_MOVES = f"SELECT event_id AS seq, user_id AS deal_id, {p.pick('event_id', ('contacted', 'nda', 'contacted', 'dead'))} AS stage, 'ann' AS member, CAST(ts AS TIMESTAMP) AS at, CASE WHEN event_id % 3 = 0 THEN 'contacted' END AS only_from FROM {{events}}"


@query(
    "move_stage",
    f"""WITH RECURSIVE {_D}, m AS ({p.duck(_MOVES)}), n AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY seq) AS i FROM m WHERE deal_id IN (SELECT id FROM deals)),
w AS (SELECT id AS deal_id, stage, 0::BIGINT AS i, 0::BIGINT AS moves FROM deals WHERE id IN (SELECT deal_id FROM n) UNION ALL
 SELECT w.deal_id, CASE WHEN n.stage <> w.stage AND (n.only_from IS NULL OR n.only_from = w.stage) THEN n.stage ELSE w.stage END, n.i, w.moves + CASE WHEN n.stage <> w.stage AND (n.only_from IS NULL OR n.only_from = w.stage) THEN 1 ELSE 0 END FROM w JOIN n ON n.deal_id = w.deal_id AND n.i = w.i + 1),
e AS (SELECT deal_id, arg_max(stage, i) AS stage, max(moves) AS moves FROM w GROUP BY 1)
SELECT d.id, coalesce(e.stage, d.stage) AS stage, coalesce(e.moves, 0)::BIGINT AS moves FROM deals d LEFT JOIN e ON e.deal_id = d.id""",
)
def _moves(s, d):
    after, made = desk.move_stage(p.deals(s, d), p.spark_view(s, d, _MOVES))
    n = made.groupBy("deal_id").agg(F.count("*").alias("n"))
    return after.join(n, after["id"] == n["deal_id"], "left").select("id", "stage", F.coalesce("n", F.lit(0)).alias("moves"))


_FLAGS = f"SELECT event_id AS seq, user_id AS deal_id, CASE WHEN event_id % 2 = 0 THEN 'ann' ELSE 'bob' END AS member, {p.pick('event_id', ('listing', 'criteria', None))} AS theme, {p.pick('event_id', ('looser', 'tighter'))} AS criteria_intent, {p.pick('event_id', ('title', 'money', None, 'place', 'other'))} AS reason, 'd' || CAST(event_id AS STRING) AS detail, 'alpha.digest' AS format_id FROM {{events}}"


@query(
    "set_train_flag",
    f"WITH b AS ({p.duck(_FLAGS)}), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY deal_id, member ORDER BY seq DESC) = 1) SELECT deal_id, member, coalesce(theme, 'listing') AS theme, CASE WHEN theme = 'criteria' THEN criteria_intent END AS criteria_intent, reason, detail FROM l WHERE reason IS NOT NULL",
)
def _flags(s, d):
    b = p.spark_view(s, d, _FLAGS)
    return desk.set_train_flags(b.drop("seq").limit(0), b).select("deal_id", "member", "theme", "criteria_intent", "reason", "detail")


_FIXES = "SELECT event_id AS seq, user_id AS deal_id, 'Fixed ' || CAST(event_id AS STRING) AS title, CAST(NULL AS STRING) AS blurb, CAST(event_id AS DOUBLE) AS revenue, CAST(NULL AS DOUBLE) AS ebitda, CAST(NULL AS DOUBLE) AS sde, CAST(2 AS DOUBLE) AS asking, event_id % 4 AS k FROM {events}"


@query(
    "correct_listing",
    f"""WITH {_D}, b AS ({p.duck(_FIXES)}), t AS (SELECT deal_id, arg_max(title, seq) AS title FROM b WHERE k = 0 GROUP BY 1), r AS (SELECT deal_id, arg_max(struct_pack(v := CASE WHEN k = 1 THEN revenue END), seq).v AS revenue FROM b WHERE k IN (1, 2) GROUP BY 1)
SELECT d.id, coalesce(t.title, d.title) AS title, CASE WHEN r.deal_id IS NOT NULL THEN r.revenue ELSE d.revenue END AS revenue, d.asking FROM deals d LEFT JOIN t ON t.deal_id = d.id LEFT JOIN r ON r.deal_id = d.id""",
)
def _fixes(s, d):
    b = p.spark_view(s, d, _FIXES)
    named = F.when(F.col("k") == 0, F.array(F.lit("title"))).when(F.col("k").isin(1, 2), F.array(F.lit("revenue"))).otherwise(F.array().cast("array<string>"))
    b = b.withColumn("fields", named).withColumn("revenue", F.when(F.col("k") == 1, F.col("revenue")))
    return desk.correct_listings(p.deals(s, d), b).select("id", "title", "revenue", "asking")


_NOTES = "SELECT user_id AS deal_id, 'ann' AS member, '  note ' || CAST(event_id AS STRING) || ' ' AS body, CAST(ts AS TIMESTAMP) AS at FROM {events}"


@query("add_note", "SELECT user_id AS deal_id, 'note ' || CAST(event_id AS STRING) AS body FROM events UNION ALL SELECT o_orderkey, 'had' FROM orders")
def _notes(s, d):
    had = p.spark_view(s, d, "SELECT o_orderkey AS deal_id, 'bob' AS member, 'had' AS body, CAST(o_orderdate AS TIMESTAMP) AS at FROM {orders}")
    return desk.add_notes(had, p.spark_view(s, d, _NOTES)).select("deal_id", "body")


_FILES = "SELECT event_id AS seq, user_id AS deal_id, 'ann' AS member, 'cim' AS kind, 'f' || CAST(event_id AS STRING) || '.pdf' AS filename, 'application/pdf' AS content_type, repeat('x', CAST(event_id % 30 AS INT)) AS body FROM {events}"


@query(
    "save_file",
    f"WITH {_D}, b AS ({p.duck(_FILES)}), f AS (SELECT deal_id, count(*) AS files, sum(length(body)) AS bytes, arg_max(filename, seq) AS last FROM b WHERE length(body) <= 20 GROUP BY 1) SELECT d.id, coalesce(f.files, 0) AS files, coalesce(f.bytes, 0)::BIGINT AS bytes, f.last AS last_file FROM deals d LEFT JOIN f ON f.deal_id = d.id",
)
def _files(s, d):
    b = p.spark_view(s, d, _FILES).withColumn("content", F.encode("body", "UTF-8"))
    none = b.select(F.lit("").alias("file_id"), "deal_id", "member", "kind", "filename", "content_type", "content").limit(0)
    files, deals, _ = desk.save_files(none, p.deals(s, d), b, 20)
    n = files.groupBy("deal_id").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
    named = files.select("file_id", F.col("filename").alias("last_file"))
    d = deals.join(n, deals["id"] == n["deal_id"], "left").withColumn("file_id", F.substring_index("cim_url", "/", -1)).join(named, "file_id", "left")
    return d.select("id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "last_file")


_DRAFTS = f"SELECT CAST(o_orderkey AS STRING) AS draft_id, 'ann' AS member, {p.pick('o_orderkey', ('  Own find ', '', None, 'Water Lab'))} AS title, ' ' AS blurb, {p.pick('o_orderkey', (' Waco ', None))} AS city, {p.pick('o_custkey', ('TX', ' ', None))} AS state, CAST(o_totalprice AS DOUBLE) AS revenue, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 AS DOUBLE) END AS ebitda, CAST(NULL AS DOUBLE) AS sde, CAST(NULL AS DOUBLE) AS asking, CAST(NULL AS STRING) AS business_model_type, ' https://x.example ' AS url, CAST(o_orderdate AS TIMESTAMP) AS at FROM {{orders}}"


@query(
    "create_from_document",
    f"WITH b AS ({p.duck(_DRAFTS)}) SELECT 'cim:' || draft_id AS ext_id, trim(title) AS title, nullif(trim(city), '') AS city, nullif(trim(state), '') AS state, CASE WHEN ebitda IS NULL THEN 'earnings ' ELSE '' END || CASE WHEN coalesce(trim(state), '') = '' THEN 'location' ELSE '' END AS needs, 'cim' AS stage, trim(url) AS url, 'short' AS action FROM b WHERE trim(coalesce(title, '')) <> ''",
)
def _drafts(s, d):
    deals, made, verdicts = desk.deals_from_documents(p.spark_view(s, d, _DRAFTS))
    needs = F.concat(F.when(F.array_contains("needs_llm", "earnings"), "earnings ").otherwise(""), F.when(F.array_contains("needs_llm", "location"), "location").otherwise(""))
    return deals.join(verdicts.select("ext_id", "action"), "ext_id").join(made.select("ext_id"), "ext_id").select("ext_id", "title", "city", "state", needs.alias("needs"), "stage", "url", "action")


_GOTCHAS = "(VALUES ('alpha.digest', 'cards are bundled|prices may be blank'), ('beta.digest', ''))"


@query(
    "train_review_notes",
    f"""WITH b AS ({p.duck(_FLAGS)}) SELECT seq, '# Training flag for review' || chr(10) || chr(10) || '- deal_id: ' || CAST(deal_id AS STRING) || chr(10) || '- ext_id: x' || CAST(deal_id AS STRING) || chr(10) || '- reason: ' || reason || chr(10) || '- detail: ' || CASE WHEN seq % 2 = 0 THEN detail ELSE '' END || chr(10)
 || '- format_id: ' || CASE WHEN seq % 3 = 0 THEN '(unmatched)' ELSE format_id END || chr(10) || '- source / sub_source: s / ' || chr(10) || '- title: T' || chr(10) || chr(10)
 || CASE WHEN seq % 5 = 0 THEN '## Focus fields' || chr(10) || chr(10) || '- asking' || chr(10) || '- state' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN seq % 3 = 0 THEN '## Action' || chr(10) || chr(10) || '- No format matched: survey the mailbox and propose one.' || chr(10)
    ELSE '## Current gotchas' || chr(10) || chr(10) || '- cards are bundled' || chr(10) || '- prices may be blank' || chr(10) || chr(10) || '## Gotcha to append' || chr(10) || chr(10) || '- ' || reason || ': ' || CASE WHEN seq % 2 = 0 THEN detail ELSE 'T' END || chr(10) END AS note FROM b WHERE reason IS NOT NULL""",
)
def _notes_of_flags(s, d):
    b = p.spark_view(s, d, _FLAGS).where("reason IS NOT NULL")
    words = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    f = b.select("deal_id", F.concat(F.lit("x"), F.col("deal_id").cast("string")).alias("ext_id"), "reason", F.when(F.col("seq") % 2 == 0, F.col("detail")).alias("detail"), F.when(F.col("seq") % 3 != 0, F.col("format_id")).alias("format_id"), F.lit("s").alias("source"), F.lit("").alias("sub_source"), F.lit("T").alias("title"), words(F.when(F.col("seq") % 5 == 0, "asking|state").otherwise("")).alias("focus"), F.array().cast("array<string>").alias("checklist"), "seq")
    g = s.sql(f"SELECT col1 AS format_id, col2 AS g FROM {_GOTCHAS}").select("format_id", words(F.col("g")).alias("gotchas"))
    return survey.review_notes(f, g, keep=["seq"]).select("seq", "note")


@query("catalog_maps", "SELECT user_id, 'alpha.digest' AS by_email, 'alpha.digest,alpha.single' AS by_domain FROM events WHERE user_id % 2 = 0 UNION ALL SELECT user_id, NULL, 'beta.digest' FROM events WHERE user_id % 2 = 1")
def _maps(s, d):
    formats = s.createDataFrame([("alpha.digest", "alpha.example", "Alerts@alpha.example"), ("alpha.single", "alpha.example", "*@alpha.example"), ("beta.digest", "Beta.example", None)], "id string, source string, sub_source string")
    maps = sinks.catalog_maps(formats)
    e = p.spark_view(s, d, f"SELECT user_id, {p.pick('user_id', ('alerts@alpha.example', 'deals@beta.example'))} AS address, {p.pick('user_id', ('alpha.example', 'beta.example'))} AS domain FROM {{events}}")
    return e.join(maps).select("user_id", F.try_element_at("by_email", F.col("address")).alias("by_email"), F.array_join(F.try_element_at("by_domain", F.col("domain")), ",").alias("by_domain"))


@query("flags_with_deals", f"WITH {_D}, b AS ({p.duck(_BATCH)}) SELECT b.seq, b.deal_id, b.member, b.action, d.ext_id, d.title, d.source, d.asking FROM b JOIN deals d ON d.id = b.deal_id")
def _flag_deals(s, d):
    flags = p.spark_view(s, d, _BATCH)
    return views.flags_with_deals(flags, p.deals(s, d), "seq").select("seq", "deal_id", "member", "action", "ext_id", "title", "source", "asking")
