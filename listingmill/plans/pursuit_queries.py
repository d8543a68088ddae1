"""The second lane: events, matching, forward-only stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingmill.operators import merge, pursuit
from listingmill.plans import projections as p

QUERIES: dict = {}
ORACLES: dict = {}
_D = f"deals AS ({p.duck(p.DEALS)})"
_O = f"outreach AS ({p.duck(p.OUTREACH)})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SUBJECT = "CASE event_id % 6 WHEN 0 THEN 'Signature requested on Plumbing Company' WHEN 1 THEN 'You signed: Roofing Contractor' WHEN 2 THEN 'Attached is our CIM for your review' WHEN 3 THEN 'Bob acted on Water Treatment' WHEN 4 THEN 'Schedule a call' ELSE 'hello there' END"


@query("event_kind", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'nda_available' WHEN 1 THEN 'nda_signed' WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'cim_received' END WHEN 3 THEN 'interest_logged' WHEN 4 THEN 'call_request' END AS kind FROM events")
def _classify(s, d):
    e = p.spark_view(s, d, f"SELECT event_id, {_SUBJECT} AS subject FROM {{events}}")
    return e.select("event_id", pursuit.classify_event(F.col("subject"), F.lit(""), F.col("event_id") % 4 == 0).alias("kind"))


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s#]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'for', 'your', 'with', 'from')))"


@query("title_token_score", f"WITH {_D}, x AS (SELECT id, {_TOK.format(chr(39) + 'the Commercial Water Treatment Services company' + chr(39))} AS a, {_TOK.format('title')} AS b FROM deals) SELECT id, len(list_intersect(a, b)) / len(a) AS score FROM x")
def _tokens(s, d):
    return p.deals(s, d).select("id", pursuit.title_token_score(F.lit("the Commercial Water Treatment Services company"), F.col("title")).alias("score"))


@query(
    "match_pursuit_deal",
    f"""WITH {_D}, c AS (SELECT id, title, concat_ws(' ', url, ext_id, title) AS hay, last_seen FROM deals WHERE stage IN ('inbox', 'shortlist', 'contacted', 'nda', 'cim', 'call', 'loi', 'diligence', 'offer') ORDER BY last_seen DESC, id LIMIT 2000),
e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(200000 + event_id AS STRING) END AS number, CASE WHEN event_id % 2 = 1 THEN CASE event_id % 3 WHEN 0 THEN 'Legionella and Water Testing Lab' WHEN 1 THEN 'Contract Janitorial' ELSE 'nothing like that' END ELSE 'Re' END AS cue FROM events),
n AS (SELECT e.event_id, first(c.id ORDER BY c.last_seen DESC, c.id) AS id FROM e JOIN c ON contains(c.hay, e.number) GROUP BY 1),
cues AS (SELECT DISTINCT cue, {_TOK.format('cue')} AS a FROM e WHERE length(cue) >= 6), titles AS (SELECT id, last_seen, {_TOK.format('title')} AS b FROM c),
sc AS (SELECT cue, id, last_seen, len(list_intersect(a, b)) / len(a) AS score FROM cues, titles),
t AS (SELECT cue, id, score FROM sc WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY cue ORDER BY score DESC, last_seen DESC, id) = 1)
SELECT e.event_id, coalesce(n.id, t.id) AS deal_id, CASE WHEN n.id IS NOT NULL THEN 1.0::DOUBLE ELSE t.score END AS score, CASE WHEN n.id IS NOT NULL THEN 'number' WHEN t.id IS NOT NULL THEN 'title' ELSE 'unmatched' END AS how FROM e LEFT JOIN n ON n.event_id = e.event_id LEFT JOIN t ON t.cue = e.cue""",
)
def _match(s, d):
    sql = "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'Re: ' || CASE event_id % 3 WHEN 0 THEN 'Legionella and Water Testing Lab' WHEN 1 THEN 'Contract Janitorial' ELSE 'nothing like that' END ELSE 'Re' END AS subject, CASE WHEN event_id % 2 = 0 THEN 'about Deal #' || CAST(200000 + event_id AS STRING) ELSE 'hi' END AS body FROM {events}"
    return pursuit.match_events(p.spark_view(s, d, sql), p.deals(s, d))


@query("stage_fold", f"""WITH {_D}, {_O}, r AS (SELECT deal_id, max(CASE event_type WHEN 'nda_available' THEN 3 WHEN 'nda_signed' THEN 4 WHEN 'cim_received' THEN 5 END) AS k FROM outreach GROUP BY 1),
j AS (SELECT coalesce(d.id, r.deal_id) AS deal_id, coalesce(d.stage, 'inbox') AS stage, r.k, CASE coalesce(d.stage, 'inbox') WHEN 'inbox' THEN 1 WHEN 'shortlist' THEN 2 WHEN 'contacted' THEN 3 WHEN 'nda' THEN 4 WHEN 'cim' THEN 5 END AS s FROM deals d FULL JOIN r ON r.deal_id = d.id)
SELECT deal_id, CASE WHEN s IS NULL THEN stage ELSE (['inbox', 'shortlist', 'contacted', 'nda', 'cim'])[greatest(s, coalesce(k, 0))] END AS stage FROM j""")
def _fold(s, d):
    return merge.fold_stages(p.deals(s, d).select(F.col("id").alias("deal_id"), "stage"), p.outreach(s, d))
