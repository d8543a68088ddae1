"""Rules: keywords, tiers, the score and the fit, and lists by them. The SQL is made from the same fixed values, as CASE trees."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from listingmill.operators import enrich, merge, rules, views
from listingmill.plans import projections as p

QUERIES: dict = {}
ORACLES: dict = {}
_D = f"deals AS ({p.duck(p.DEALS)})"
_X = f"{_D}, x AS (SELECT *, lower(title || ' ' || coalesce(blurb, '')) AS t, coalesce(ebitda, sde) AS earn, ebitda IS NULL AND sde IS NOT NULL AS is_sde FROM deals)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _word(words) -> str:
    return "regexp_matches(t, '(^|[^a-z0-9_])(" + "|".join(re.escape(w) for w in words) + ")($|[^a-z0-9_])')"


def _sub(words) -> str:
    return "regexp_matches(t, '" + "|".join(re.escape(w) for w in words) + "')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _groups(groups) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_word(w)} THEN '{g}' END" for g, w in groups.items()) + "], lambda z: z IS NOT NULL))"


_METROS = "|".join(rules.METROS)
_GEO = f"""CASE WHEN coalesce(state, '') <> '' AND upper(state) NOT IN {_in(rules.STATES)} THEN 'G4_OUT'
 WHEN upper(state) = 'TX' AND (regexp_matches(lower(coalesce(city, '')), '{_METROS}') OR replace(lower(coalesce(county, '')), ' county', '') IN {_in(rules.COUNTIES)}) THEN 'G1_CENTRAL_TX'
 WHEN upper(state) IN {_in(rules.NEAR_STATES)} THEN 'G2_TOLA' ELSE 'G3_NATIONAL' END"""
_EFF = "(earn * CASE WHEN is_sde THEN 0.85 ELSE 1.0 END)"
_FIN = f"CASE WHEN earn IS NULL THEN 'T4' WHEN {_EFF} >= 1000000 AND revenue > 0 AND {_EFF} / revenue >= 0.15 THEN 'T1' WHEN {_EFF} >= 750000 THEN 'T2' WHEN {_EFF} >= 350000 THEN 'T3' ELSE 'T4' END"


@query("keyword_hits", f"WITH {_X} SELECT id, array_to_string({_groups(rules.STRATEGIC)}, ',') AS strategic, array_to_string({_groups(rules.EXCLUDED)}, ',') AS excluded FROM x")
def _keywords(s, d):
    t = rules.listing_text()
    return p.deals(s, d).select("id", F.array_join(rules.groups_hit(t, rules.STRATEGIC), ",").alias("strategic"), F.array_join(rules.groups_hit(t, rules.EXCLUDED), ",").alias("excluded"))


@query("geo_tier", f"WITH {_X} SELECT id, {_GEO} AS tier FROM x")
def _geo(s, d):
    return p.deals(s, d).select("id", rules.geo_tier(F.col("state"), F.col("city"), F.col("county")).alias("tier"))


@query("fin_tier", f"WITH {_X} SELECT id, {_FIN} AS tier FROM x")
def _fin(s, d):
    e = F.coalesce("ebitda", "sde")
    return p.deals(s, d).select("id", rules.fin_tier(e, F.col("ebitda").isNull() & F.col("sde").isNotNull(), F.col("revenue")).alias("tier"))


_SCORE = f"""{_X}, y AS (SELECT *, {_groups(rules.STRATEGIC)} AS strat, {_groups(rules.EXCLUDED)} AS excl, {_GEO} AS geo, {_FIN} AS fin, {' + '.join(f"CASE WHEN {_word(w)} THEN {n} ELSE 0 END" for _, n, w in rules.MODIFIERS)} AS mods FROM x),
z AS (SELECT *, {_EFF} AS eff, CASE geo {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.GEO_POINTS.items())} END AS gp, CASE WHEN earn IS NULL THEN -8 WHEN fin = 'T1' THEN 30 WHEN fin = 'T2' THEN 22 WHEN fin = 'T3' THEN 12 ELSE 0 END AS fp,
 CASE geo {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.GEO_LABELS.items())} END AS label, len(strat) > 0 AS st, geo = 'G1_CENTRAL_TX' AS home FROM y),
f AS (SELECT *, CASE WHEN home THEN 350000 ELSE 750000 END AS e_min, CASE WHEN home THEN 700000 ELSE 1875000 END AS a_min, CASE WHEN home THEN 700000 ELSE 1500000 END AS r_min FROM z),
r AS (SELECT *, CASE WHEN len(excl) > 0 AND NOT st THEN 'Excluded category: ' || array_to_string(excl, ', ') WHEN geo = 'G4_OUT' THEN 'Outside US'
 WHEN geo = 'G3_NATIONAL' AND business_model_type = 'LOCAL_SERVICE' THEN 'Local-service business in ' || coalesce(state, 'an unknown state') || ' — outside TOLA service radius'
 WHEN NOT st AND earn IS NOT NULL AND eff < e_min THEN format('Earnings ${{:,}} below visibility floor ${{:,}} for {{}}', round(eff)::BIGINT, e_min, label)
 WHEN NOT st AND earn IS NOT NULL AND fin = 'T4' THEN 'T4 financials'
 WHEN NOT st AND earn IS NULL AND revenue < r_min THEN format('No earnings; revenue ${{:,}} below ${{:,}} for {{}}', revenue::BIGINT, r_min, label)
 WHEN NOT st AND earn IS NULL AND revenue IS NULL AND asking < a_min THEN format('No earnings/revenue; asking ${{:,}} below ${{:,}} for {{}}', asking::BIGINT, a_min, label) END AS reject_reason,
 (len(excl) > 0 AND NOT st) OR geo = 'G4_OUT' OR (geo = 'G3_NATIONAL' AND coalesce(business_model_type, '') = 'LOCAL_SERVICE') AS early FROM f),
g AS (SELECT *, CASE WHEN early THEN 0 WHEN reject_reason IS NOT NULL THEN gp + fp ELSE greatest(0, least(100, gp + fp + CASE WHEN st THEN 25 ELSE 0 END + mods)) END AS score FROM r)"""


@query("score_deals", f"WITH {_SCORE} SELECT id, score::INTEGER AS score, CASE WHEN reject_reason IS NOT NULL THEN 'D_suppress' WHEN score >= 70 THEN 'A_priority' WHEN score >= 50 THEN 'B_review' WHEN score >= 35 THEN 'C_watch' ELSE 'D_suppress' END AS bucket, CASE WHEN NOT (len(excl) > 0 AND NOT st) THEN geo END AS geo_tier, CASE WHEN NOT early THEN fin END AS fin_tier, reject_reason IS NOT NULL AS rejected, reject_reason, st AS strategic FROM g")
def _score(s, d):
    return rules.score_deals(p.deals(s, d)).select("id", "score", "bucket", "geo_tier", "fin_tier", "rejected", "reject_reason", "strategic")


@query("score_flags", f"WITH {_SCORE} SELECT id, len(excl) > 0 AND st AS kept_for_overlap, NOT early AND earn IS NULL AS undisclosed, coalesce(NOT early AND st AND earn IS NOT NULL AND eff < 250000, false) AS sub_scale FROM g")
def _flags(s, d):
    has = lambda v: F.array_contains("flags", v)
    return rules.score_deals(p.deals(s, d)).select("id", has("Excluded category, kept for strategic overlap — verify").alias("kept_for_overlap"), has("No financials disclosed").alias("undisclosed"), has("Sub-scale — tuck-in only").alias("sub_scale"))


@query("report_top", f"WITH {_SCORE} SELECT id, score::INTEGER AS score FROM g WHERE reject_reason IS NULL ORDER BY st DESC, score DESC, id LIMIT 25")
def _report(s, d):
    return rules.score_deals(p.deals(s, d)).where("NOT rejected").orderBy(F.desc("strategic"), F.desc("score"), "id").limit(25).select("id", "score")


def _capped(cap: int) -> str:
    return f"WITH {_SCORE}, c AS (SELECT id, seen_day, score::INTEGER AS score, st, row_number() OVER (PARTITION BY seen_day ORDER BY st DESC, score DESC, id) AS place FROM g WHERE reject_reason IS NULL) SELECT id, CAST(seen_day AS STRING) AS seen_day, score, st AS strategic, place::INTEGER AS place FROM c WHERE st OR place <= {cap}"


@query("report_cap", _capped(rules.REPORT_CAP))
def _cap(s, d):
    return _reported(s, d, rules.REPORT_CAP)


@query("report_cap_tight", _capped(2))
def _cap_tight(s, d):
    return _reported(s, d, 2)


def _reported(s, d, cap):
    x = p.deals(s, d)
    scored = rules.score_deals(x)
    scored = scored if "seen_day" in scored.columns else scored.join(x.select("id", "seen_day"), "id")
    return rules.capped_report(scored, "seen_day", cap).select("id", F.col("seen_day").cast("string").alias("seen_day"), "score", "strategic", "place")


_FIT = f"""{_X}, y AS (SELECT *, {_sub(rules.FIT_STRATEGIC)} AS st, CASE {' '.join(f"WHEN {_sub(w)} THEN '{g}'" for g, w in rules.FIT_EXCLUDED)} END AS excl,
 upper(trim(coalesce(state, ''))) AS su, lower(trim(coalesce(city, ''))) AS ci, regexp_replace(lower(trim(coalesce(county, ''))), '\\s+county$', '') AS co, coalesce(ebitda, floor(sde * 0.85 + 0.5)) AS adj, CASE WHEN revenue > 0 THEN round(earn / revenue, 4) END AS margin FROM x),
z AS (SELECT *, CASE WHEN su IN ('TX', '') AND (regexp_matches(ci, '^({_METROS})( |$)| ({_METROS})$| ({_METROS}) ') OR co IN {_in(rules.COUNTIES)} OR (su = 'TX' AND regexp_matches(concat_ws(' ', ci, co, t), '{_METROS}'))) THEN 'G1' WHEN su IN {_in(rules.NEAR_STATES)} THEN 'G2' WHEN su <> '' THEN 'G3' END AS geo,
 CASE WHEN adj IS NULL THEN NULL WHEN adj >= 1000000 AND (margin IS NULL OR margin >= 0.15) THEN 'T1' WHEN adj >= 750000 THEN 'T2' WHEN adj >= 350000 THEN 'T3' ELSE 'T4' END AS fin FROM y),
f AS (SELECT *, coalesce(geo = 'G1', false) AS home, CASE WHEN st THEN true WHEN adj IS NOT NULL THEN adj >= CASE WHEN geo = 'G1' THEN 350000 ELSE 750000 END WHEN revenue IS NOT NULL THEN revenue >= CASE WHEN geo = 'G1' THEN 700000 ELSE 1500000 END WHEN asking IS NOT NULL THEN asking >= CASE WHEN geo = 'G1' THEN 700000 ELSE 1875000 END ELSE true END AS surfaced FROM z),
g AS (SELECT *, CASE WHEN NOT st AND excl IS NOT NULL THEN 'out' WHEN trim(coalesce(business_model_type, '')) = 'LOCAL_SERVICE' AND coalesce(geo = 'G3', false) THEN 'out' WHEN st THEN 'priority' WHEN NOT surfaced THEN 'low' WHEN fin IS NULL THEN 'unknown' WHEN home OR fin = 'T1' THEN 'priority' ELSE 'fits' END AS level FROM f)"""


@query("assess_fit", f"WITH {_FIT} SELECT id, level AS fit_level, geo AS fit_geo, fin AS fit_fin, adj AS adjusted_earnings, surfaced, CASE WHEN NOT st AND excl IS NOT NULL THEN 'excluded category: ' || excl WHEN level = 'out' THEN 'local service outside TOLA' WHEN level = 'low' AND fin IS NULL THEN 'below asking/revenue visibility floor' WHEN level = 'low' THEN 'below visibility floor ' || CASE WHEN home THEN '$350K' ELSE '$750K' END END AS disqualifier FROM g")
def _fit(s, d):
    return rules.assess_fit(p.view(s, d)).select("id", "fit_level", "fit_geo", "fit_fin", "adjusted_earnings", "surfaced", "disqualifier")


@query("fit_level_counts", f"WITH {_FIT} SELECT level AS fit_level, count(*) AS deals, count(*) FILTER (surfaced) AS surfaced FROM g GROUP BY 1")
def _levels(s, d):
    return rules.assess_fit(p.view(s, d)).groupBy("fit_level").agg(F.count("*").alias("deals"), F.count_if("surfaced").alias("surfaced"))


_RANK = "CASE level WHEN 'priority' THEN 0 WHEN 'fits' THEN 1 WHEN 'unknown' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query("by_fit_topk", f"WITH {_FIT} SELECT id, level AS fit_level, earn AS earnings FROM g WHERE surfaced ORDER BY {_RANK}, coalesce(earn, -1) DESC, id DESC LIMIT 50")
def _by_fit(s, d):
    f = rules.assess_fit(p.view(s, d)).where("surfaced")
    return f.orderBy(rules.level_rank(F.col("fit_level")), F.desc(F.coalesce("earnings", F.lit(-1.0))), F.desc("id")).limit(50).select("id", "fit_level", "earnings")


@query(
    "review_filters",
    f"""WITH {_FIT}, verdicts AS ({p.duck(p.VERDICTS)}), last AS (SELECT deal_id, action FROM verdicts WHERE member = 'ann' QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY at_text DESC, file DESC, pos DESC) = 1),
h AS (SELECT g.*, l.action, coalesce(l.action <> 'pass', true) AS o FROM g LEFT JOIN last l ON l.deal_id = g.id),
c AS (SELECT count(*) FILTER (action IS NULL AND surfaced) AS todo, count(*) FILTER (level = 'priority' AND o) AS priority, count(*) FILTER (level IN ('priority', 'fits') AND o) AS fits, count(*) FILTER (level = 'unknown' AND o) AS unknown, count(*) FILTER (level = 'low' AND o) AS low,
 count(*) FILTER (level = 'out' AND o) AS "out", count(*) FILTER (action = 'short') AS short, count(*) FILTER (action = 'discuss') AS discuss, count(*) FILTER (needs_text LIKE '["%' AND o) AS needs, count(*) FILTER (action = 'pass') AS passed FROM h)
UNPIVOT c ON COLUMNS(*) INTO NAME filter VALUE deals""",
)
def _filters(s, d):
    own = merge.fold_verdicts(p.verdicts(s, d).where("member = 'ann'")).select(F.col("deal_id").alias("id"), "action")
    return views.review_filters(rules.assess_fit(p.view(s, d)).join(own, "id", "left"))


@query("headline_reject", f"WITH {_X}, y AS (SELECT id, {_groups(rules.EXCLUDED)} AS e, {_groups(rules.STRATEGIC)} AS s FROM x) SELECT id, CASE WHEN len(e) > 0 AND len(s) = 0 THEN 'Excluded category: ' || array_to_string(e, ', ') END AS reason FROM y")
def _headline(s, d):
    return p.deals(s, d).select("id", rules.headline_reject(F.col("title"), F.col("blurb")).alias("reason"))


_THIN = """(length(trim(coalesce(blurb, ''))) < 24)"""


@query("enrich_candidates", f"WITH {_X}, y AS (SELECT *, {_groups(rules.EXCLUDED)} AS e, {_groups(rules.STRATEGIC)} AS s FROM x WHERE contains(url, 'alpha.example') AND (earn IS NULL OR asking IS NULL OR {_THIN})) SELECT id FROM y WHERE NOT (len(e) > 0 AND len(s) = 0) ORDER BY last_seen DESC, id DESC LIMIT 200")
def _candidates(s, d):
    return enrich.candidates(p.view(s, d), "alpha.example", 200).select("id")


@query("apply_enrichment", f"""WITH {_D}, i AS (SELECT CAST(100000 + l_orderkey % 4000 AS STRING) AS lid, arg_max(floor(l_extendedprice), l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS asking, arg_max(struct_pack(v := CASE WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice / 10) END), l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS sde FROM lineitem GROUP BY 1),
d2 AS (SELECT *, regexp_extract(coalesce(url, ''), '[?&]q=([^&#]+)', 1) AS lid FROM deals) SELECT d2.id, coalesce(d2.asking, i.asking) AS asking, coalesce(d2.sde, i.sde.v) AS sde, d2.ebitda FROM d2 JOIN i ON i.lid = d2.lid""")
def _enrich(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(F.floor(c), 0))
    items = li.select(F.concat(F.lit("https://www.alpha.example/listings/Profile/?q="), (F.lit(100000) + F.col("l_orderkey") % 4000).cast("string")).alias("url"), dollars(F.col("l_extendedprice")).alias("askingPrice"), F.when(F.col("l_linenumber") % 2 == 0, dollars(F.col("l_extendedprice") / 10)).otherwise("Not Disclosed").alias("cashFlow"), (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    from listingmill.functions.urls import listing_id

    mapped = enrich.map_items(items)
    deals = p.deals(s, d).withColumn("listing_id", listing_id(F.col("url"))).where(F.length("listing_id") > 0).where(F.contains("url", F.lit("q=")))
    return enrich.apply(deals, mapped).join(mapped.select("listing_id").distinct(), "listing_id", "left_semi").select("id", "asking", "sde", "ebitda")
