"""Views, joins, picks, counts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingmill.operators import merge, views
from listingmill.plans import projections as p

QUERIES: dict = {}
ORACLES: dict = {}

_D = f"deals AS ({p.duck(p.DEALS)})"
_V = f"{_D}, v AS (SELECT *, coalesce(ebitda, sde) AS earnings, CASE WHEN ebitda IS NOT NULL THEN 'EBITDA' WHEN sde IS NOT NULL THEN 'SDE' END AS earnings_basis, CASE WHEN revenue > 0 THEN round(coalesce(ebitda, sde) / revenue, 4) END AS margin FROM deals)"
_VD = f"verdicts AS ({p.duck(p.VERDICTS)})"
_O = f"outreach AS ({p.duck(p.OUTREACH)})"
_R = f"refs AS ({p.duck(p.REFS)})"
_LAST = "folded AS (SELECT deal_id, member, action FROM verdicts QUALIFY row_number() OVER (PARTITION BY deal_id, member ORDER BY at_text DESC, file DESC, pos DESC) = 1), live AS (SELECT * FROM folded WHERE action IS NOT NULL)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("v_deals", f"WITH {_V} SELECT id, earnings, earnings_basis, margin FROM v")
def _v_deals(s, d):
    return p.view(s, d).select("id", "earnings", "earnings_basis", "margin")


@query("list_deals", f"WITH {_V} SELECT id, title, earnings, earnings_basis, margin FROM v ORDER BY earnings DESC NULLS LAST, last_seen DESC, id DESC")
def _list(s, d):
    return views.list_deals(p.view(s, d)).select("id", "title", "earnings", "earnings_basis", "margin")


@query("list_deals_topk", f"WITH {_V} SELECT id, title, earnings FROM v ORDER BY earnings DESC NULLS LAST, last_seen DESC, id DESC LIMIT 100")
def _topk(s, d):
    return views.list_deals(p.view(s, d), 100).select("id", "title", "earnings")


@query("board_filter", f"WITH {_V} SELECT id, stage, earnings FROM v WHERE stage <> 'inbox'")
def _board(s, d):
    return p.view(s, d).where("stage <> 'inbox'").select("id", "stage", "earnings").orderBy(F.desc_nulls_last("earnings"), F.desc("id"))


@query("sources_concat", f"WITH {_R} SELECT deal_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM refs GROUP BY deal_id")
def _sources(s, d):
    return views.sources_concat(p.refs(s, d))


@query("distinct_msgs", f"WITH {_R} SELECT deal_id, count(DISTINCT msg_id) AS n_messages FROM refs GROUP BY deal_id")
def _msgs(s, d):
    return p.refs(s, d).groupBy("deal_id").agg(F.countDistinct("msg_id").alias("n_messages"))


@query("fold_verdicts", f"WITH {_VD}, {_LAST} SELECT deal_id, member, action FROM live")
def _fold(s, d):
    return merge.fold_verdicts(p.verdicts(s, d)).select("deal_id", "member", "action")


@query("verdicts_join_deals", f"WITH {_D}, {_VD}, {_LAST} SELECT d.ext_id, l.member, l.action FROM live l JOIN deals d ON d.id = l.deal_id")
def _vjoin(s, d):
    return merge.fold_verdicts(p.verdicts(s, d)).join(p.deals(s, d).select(F.col("id").alias("deal_id"), "ext_id"), "deal_id").select("ext_id", "member", "action")


@query("ext_id_unknown", f"WITH {_D}, {_VD}, {_LAST} SELECT count(*) AS unknown FROM live l WHERE NOT EXISTS (SELECT 1 FROM deals d WHERE d.id = l.deal_id * 11)")
def _unknown(s, d):
    logs = merge.fold_verdicts(p.verdicts(s, d)).withColumn("id", F.col("deal_id") * 11)
    return logs.join(p.deals(s, d).select("id"), "id", "left_anti").agg(F.count("*").alias("unknown"))


@query("ledger_anti", f"WITH {_VD} SELECT DISTINCT file FROM verdicts WHERE file NOT IN ('log1.json', 'log3.json')")
def _ledger(s, d):
    seen = s.createDataFrame([("log1.json",), ("log3.json",)], "file string")
    return p.verdicts(s, d).select("file").distinct().join(seen, "file", "left_anti")


@query("verdict_overlay", f"WITH {_VD}, {_LAST}, own AS (SELECT deal_id, arg_max(action, pos) AS edit FROM verdicts WHERE member = 'ann' AND pos % 7 = 0 AND action IS NOT NULL GROUP BY deal_id) SELECT l.deal_id, l.member, CASE WHEN l.member = 'ann' THEN coalesce(o.edit, l.action) ELSE l.action END AS action FROM live l LEFT JOIN own o ON o.deal_id = l.deal_id")
def _overlay(s, d):
    v = p.verdicts(s, d)
    own = v.where("member = 'ann' AND pos % 7 = 0 AND action IS NOT NULL").groupBy("deal_id").agg(F.max_by("action", "pos").alias("edit"))
    live = merge.fold_verdicts(v)
    return live.join(own, "deal_id", "left").select("deal_id", "member", F.when(F.col("member") == "ann", F.coalesce("edit", "action")).otherwise(F.col("action")).alias("action"))


@query("latest_outreach", f"WITH {_O} SELECT deal_id, event_id, outcome FROM outreach QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY created_at DESC, event_id DESC) = 1")
def _latest(s, d):
    return views.latest(p.outreach(s, d), ["deal_id"], [F.desc("created_at"), F.desc("event_id")]).select("deal_id", "event_id", "outcome")


@query(
    "attach_extras",
    f"""WITH {_V}, {_VD}, {_LAST}, {_O},
  flags AS (SELECT deal_id, member, intent FROM outreach QUALIFY row_number() OVER (PARTITION BY deal_id, member ORDER BY created_at DESC, event_id DESC) = 1),
  vm AS (SELECT deal_id, string_agg(member || '=' || action, ',' ORDER BY member) AS verdicts FROM live GROUP BY deal_id),
  fm AS (SELECT deal_id, string_agg(member || '=' || intent, ',' ORDER BY member) AS train_flags FROM flags GROUP BY deal_id),
  lo AS (SELECT deal_id, outcome AS last_outcome FROM outreach QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY created_at DESC, event_id DESC) = 1)
SELECT v.id, v.earnings, vm.verdicts, fm.train_flags, lo.last_outcome FROM v LEFT JOIN vm ON vm.deal_id = v.id LEFT JOIN fm ON fm.deal_id = v.id LEFT JOIN lo ON lo.deal_id = v.id""",
)
def _extras(s, d):
    o = p.outreach(s, d)
    flags = views.latest(o, ["deal_id", "member"], [F.desc("created_at"), F.desc("event_id")]).select("deal_id", "member", "intent")
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    out = views.attach_extras(p.view(s, d), merge.fold_verdicts(p.verdicts(s, d)), flags, o)
    return out.select("id", "earnings", flat("verdicts").alias("verdicts"), flat("train_flags").alias("train_flags"), "last_outcome")


@query("recent_imports_topk", f"WITH {_O} SELECT event_id, outcome FROM outreach ORDER BY created_at DESC, event_id DESC LIMIT 20")
def _recent(s, d):
    return p.outreach(s, d).orderBy(F.desc("created_at"), F.desc("event_id")).limit(20).select("event_id", "outcome")


@query(
    "review_stats",
    f"""WITH {_D}, {_VD}, {_LAST}, own AS (SELECT deal_id, action FROM live WHERE member = 'ann')
SELECT count(*) AS total, count(*) FILTER (o.action IS NULL) AS to_review, count(*) FILTER (o.action = 'short') AS short, count(*) FILTER (o.action = 'pass') AS passed,
  count(*) FILTER (d.needs_text LIKE '["%') AS needs_info FROM deals d LEFT JOIN own o ON o.deal_id = d.id""",
)
def _stats(s, d):
    return views.review_stats(p.view(s, d), merge.fold_verdicts(p.verdicts(s, d)), "ann")


@query(
    "team_shortlist",
    f"""WITH {_VD}, {_LAST}, x AS (SELECT deal_id, max(action) FILTER (member = 'ann') AS a, max(action) FILTER (member = 'bob') AS b FROM live GROUP BY deal_id)
SELECT deal_id, coalesce(a = 'short' OR b = 'short' OR (a = 'discuss' AND b = 'discuss'), false) AS shortlisted, coalesce(a <> b, false) AS conflict FROM x""",
)
def _team(s, d):
    return views.team_shortlist(merge.fold_verdicts(p.verdicts(s, d)), ("ann", "bob"))


@query("stage_groups", f"WITH {_V} SELECT stage, count(*) AS deals, sum(earnings) AS earnings, CASE stage " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(views.STAGES)) + " END::BIGINT AS place FROM v WHERE stage <> 'inbox' GROUP BY stage")
def _stages(s, d):
    return views.stage_groups(p.view(s, d))


@query("stage_dwell", f"WITH {_O} SELECT deal_id, event_id, event_type AS stage, lag(event_type) OVER w AS from_stage, (floor(epoch(created_at))::BIGINT - lag(floor(epoch(created_at))::BIGINT) OVER w) AS dwell_s FROM (SELECT *, date_trunc('second', created_at) AS c FROM outreach) WINDOW w AS (PARTITION BY deal_id ORDER BY created_at, event_id)")
def _dwell(s, d):
    o = p.outreach(s, d)
    return views.stage_dwell(o.select("deal_id", "event_id", F.col("event_type").alias("stage"), F.col("created_at").alias("ts")))


@query("bucket_counts", f"WITH {_D} SELECT CASE WHEN contains(lower(source), 'alpha') THEN 'alpha' WHEN contains(lower(source), 'beta') THEN 'beta' ELSE 'newsletter' END AS bucket, count(*) AS deals, count(*) FILTER (needs_text LIKE '[\"%') AS needs FROM deals GROUP BY 1")
def _buckets(s, d):
    b = views.source_bucket(F.concat_ws(" ", "source", "sub_source", "nickname"), ("alpha", "beta"))
    return p.deals(s, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("deals"), F.count_if(F.size("needs_llm") > 0).alias("needs"))


@query("train_queue_counts", f"WITH {_O} SELECT intent, count(*) AS flags, count(*) FILTER (member = 'ann') AS own FROM outreach GROUP BY intent")
def _train(s, d):
    return p.outreach(s, d).groupBy("intent").agg(F.count("*").alias("flags"), F.count_if(F.col("member") == "ann").alias("own"))


@query(
    "apply_verdicts_newer",
    f"""WITH {_D}, {_VD}, stored AS (SELECT deal_id, member, action, ts AS updated_at FROM verdicts WHERE pos % 2 = 0 AND pos % 3 = 0 AND action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY deal_id, member ORDER BY ts, pos) = 1),
batch AS (SELECT deal_id, member, action, ts AS updated_at, pos FROM verdicts WHERE pos % 3 = 1 AND member IN ('ann', 'bob') AND action IN ('short', 'discuss', 'pass') AND deal_id IN (SELECT id FROM deals)),
allv AS (SELECT deal_id, member, action, updated_at, 1 AS old, -1 AS pos FROM stored UNION ALL SELECT deal_id, member, action, updated_at, 0, pos FROM batch)
SELECT deal_id, member, action FROM allv QUALIFY row_number() OVER (PARTITION BY deal_id, member ORDER BY updated_at DESC, old DESC, pos) = 1""",
)
def _apply(s, d):
    v = p.verdicts(s, d)
    stored = views.latest(v.where("pos % 2 = 0 AND pos % 3 = 0 AND action IS NOT NULL"), ["deal_id", "member"], [F.asc("ts"), F.asc("pos")]).select("deal_id", "member", "action", F.col("ts").alias("updated_at"))
    batch = v.where("pos % 3 = 1").select("deal_id", "member", "action", F.col("ts").alias("updated_at"), "pos")
    return merge.apply_verdicts(stored, batch, p.deals(s, d), ("ann", "bob")).select("deal_id", "member", "action")


@query("verdict_rules", f"WITH {_VD} SELECT pos, CASE WHEN action = 'pass' AND reason IN ('too small') THEN reason END AS reason, CASE WHEN action IN ('short', 'discuss') THEN left(repeat(file, 60), 500) END AS note, action IS NULL AS clears FROM verdicts")
def _rules(s, d):
    return merge.verdict_rules(p.verdicts(s, d).withColumn("note", F.repeat("file", F.lit(60))), ("too small",)).select("pos", "reason", "note", "clears")


_UP = ("title", "city", "state", "revenue", "asking", "url", "blurb")


@query(
    "upsert_new_wins",
    f"""WITH {_D}, stored AS (SELECT * FROM deals WHERE id % 2 = 0), b AS (SELECT 'k' || CAST(id % 900 AS STRING) AS k, * FROM deals WHERE id % 3 = 0),
s AS (SELECT 'k' || CAST(id AS STRING) AS k, * FROM stored),
r AS (SELECT k, {', '.join(f'arg_max({c}, id) FILTER ({c} IS NOT NULL) AS {c}' for c in _UP)}, arg_max(business_model_type, id) FILTER (business_model_type NOT IN ('', 'AMBIGUOUS', 'LOCATION_AGNOSTIC')) AS business_model_type, max(times_seen) AS times_seen FROM b GROUP BY k)
SELECT coalesce(s.k, r.k) AS ext_id, {', '.join(f'coalesce(r.{c}, s.{c}) AS {c}' for c in _UP)}, coalesce(r.business_model_type, s.business_model_type) AS business_model_type, greatest(r.times_seen, s.times_seen) AS times_seen FROM s FULL OUTER JOIN r ON r.k = s.k""",
)
def _upsert(s, d):
    base = p.deals(s, d).withColumn("first_seen", F.col("last_seen"))
    stored = base.where("id % 2 = 0").withColumn("ext_id", F.concat(F.lit("k"), F.col("id").cast("string")))
    batch = base.where("id % 3 = 0").withColumn("ext_id", F.concat(F.lit("k"), (F.col("id") % 900).cast("string")))
    return merge.upsert_new_wins(stored, batch).select("ext_id", *_UP, "business_model_type", "times_seen")


@query("fill_nulls", f"WITH {_D}, n AS (SELECT id % 1000 AS k, max(revenue) AS revenue, max(ebitda) AS ebitda FROM deals GROUP BY 1) SELECT d.id, coalesce(d.revenue, n.revenue) AS revenue, coalesce(d.ebitda, n.ebitda) AS ebitda FROM deals d LEFT JOIN n ON n.k = d.id")
def _fill(s, d):
    base = p.deals(s, d)
    found = base.groupBy((F.col("id") % 1000).alias("id")).agg(F.max("revenue").alias("revenue"), F.max("ebitda").alias("ebitda"))
    return merge.fill_nulls(base.select("id", "revenue", "ebitda"), found, "id", ["revenue", "ebitda"])


@query("purge_like", f"WITH {_D} SELECT id FROM deals WHERE NOT (lower(concat_ws(' ', source, sub_source, nickname, url, ext_id)) LIKE '%beta%')")
def _purge(s, d):
    return merge.purge_like(p.deals(s, d), "BETA").select("id")


@query("stage_from_outcomes", f"""WITH {_O}, x AS (SELECT deal_id, list(outcome) AS o FROM outreach GROUP BY deal_id)
SELECT deal_id, CASE WHEN list_contains(o, 'not_pursuing') OR list_contains(o, 'unavailable') THEN 'dead' WHEN list_contains(o, 'cim_received') THEN 'cim' WHEN list_contains(o, 'nda_signed') THEN 'nda' WHEN list_contains(o, 'messaged') OR list_contains(o, 'waiting') THEN 'contacted' END AS stage FROM x""")
def _outcomes(s, d):
    x = p.outreach(s, d).groupBy("deal_id").agg(F.collect_set("outcome").alias("o"))
    return x.select("deal_id", merge.stage_from_outcomes(F.col("o")).alias("stage"))


@query("snapshot_rows", f"WITH {_V} SELECT ext_id AS \"extId\", title, sub_source AS \"subSource\", CASE WHEN coalesce(trim(business_model_type), '') IN ('', 'AMBIGUOUS', 'LOCATION_AGNOSTIC') THEN NULL ELSE business_model_type END AS \"businessModelType\", times_seen AS \"timesSeen\" FROM v")
def _snapshot(s, d):
    from listingmill.sources.sinks import snapshot_rows

    return snapshot_rows(p.view(s, d)).select("extId", "title", "subSource", "businessModelType", "timesSeen")


