"""Scalar text, addresses, money, mail and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingmill.functions import mail, money, places, text, urls
from listingmill.operators import formats, health, listings
from listingmill.plans import projections as p

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


def _strip_params(url: str, pattern: str) -> str:
    """SQL for an address without fragment and without the parameters of a pattern."""
    u = f"split_part({url}, '#', 1)"
    kept = f"array_to_string(list_filter(string_split(CASE WHEN instr({u}, '?') > 0 THEN substr({u}, instr({u}, '?') + 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{pattern}')), '&')"
    return f"(split_part({u}, '?', 1) || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"


_NORM = "lower(" + _strip_params("regexp_replace(coalesce(url, ''), '/+$', '')", "(?i)^(utm_[a-z]+|ref|referrer|source|fbclid|gclid|mc_(cid|eid))=") + ")"
_CORE_U = "lower(regexp_replace(trim(coalesce(url, '')), '/+$', ''))"


@query("norm_url", f"WITH {_D} SELECT id, {_NORM} AS url_norm FROM deals")
def _norm(s, d):
    return p.deals(s, d).select("id", urls.norm_url(F.col("url")).alias("url_norm"))


@query("norm_url_pages", f"SELECT page_id, {_NORM} AS url_norm FROM pages")
def _norm_pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", urls.norm_url(F.col("url")).alias("url_norm"))


@query("url_core", f"WITH {_D} SELECT id, CASE WHEN contains({_CORE_U}, 'elink') OR contains({_CORE_U}, 'click.') THEN '' ELSE {_strip_params(_CORE_U, '(?i)^(utm_|ref=|fbclid=|gclid=|mc_)')} END AS core FROM deals")
def _core(s, d):
    return p.deals(s, d).select("id", urls.url_core(F.col("url")).alias("core"))


_LID = "CASE WHEN regexp_extract(coalesce(url, ''), '[?&]q=([^&#]+)', 1) <> '' THEN regexp_extract(url, '[?&]q=([^&#]+)', 1) ELSE regexp_extract(split_part(split_part(coalesce(url, ''), '#', 1), '?', 1), '/([0-9]{6,})/?$', 1) END"


@query("listing_id", f"WITH {_D} SELECT id, {_LID} AS listing_id FROM deals")
def _lid(s, d):
    return p.deals(s, d).select("id", urls.listing_id(F.col("url")).alias("listing_id"))


@query("canonical_url", f"WITH {_D} SELECT id, CASE WHEN {_LID} <> '' THEN 'https://www.alpha.example/listings/Profile/?q=' || {_LID} ELSE url END AS canonical FROM deals")
def _canon(s, d):
    return p.deals(s, d).select("id", urls.canonical_url(F.col("url"), "www.alpha.example").alias("canonical"))


@query("force_pursue_url", f"WITH {_D} SELECT id, CASE WHEN contains(lower(url), 'beta.example') THEN regexp_replace(regexp_replace(url, 'action=decline', 'action=pursue', 'gi'), 'utm_content=pass', 'utm_content=pursue', 'gi') ELSE url END AS url FROM deals")
def _force(s, d):
    return p.deals(s, d).select("id", urls.force_pursue(F.col("url"), "beta.example").alias("url"))


@query("slugify", f"WITH {_D} SELECT id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) AS slug FROM deals")
def _slug(s, d):
    return p.deals(s, d).select("id", urls.slugify(F.col("title")).alias("slug"))


@query("parse_money", f"WITH {_D} SELECT id, asking, revenue AS in_k, round(floor(revenue / 100000) / 10 * 1000000, 2) AS in_m FROM deals")
def _money(s, d):
    x = p.deals(s, d)
    full = F.concat(F.lit("asking $"), F.format_number("asking", 0))
    k = F.concat(F.lit("revenue of $ ~"), F.format_number((F.col("revenue") / 1000).cast("long"), 0), F.lit("k a year"))
    m = F.concat(F.lit("$"), (F.floor(F.col("revenue") / 100000) / 10).cast("decimal(18,1)").cast("string"), F.lit(" million"))
    return x.select("id", money.first_amount(full).alias("asking"), money.first_amount(k).alias("in_k"), F.round(money.first_amount(m), 2).alias("in_m"))


@query("parse_money_plain", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN floor(value) END AS amount FROM events WHERE value IS NOT NULL")
def _plain(s, d):
    e = s.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL")
    t = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "Not Disclosed").otherwise("N/A")).otherwise(F.concat(F.lit("$ "), F.format_number(F.floor("value"), 0)))
    return e.select("event_id", money.plain_amount(t).alias("amount"))


@query("to_number", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(value) END AS n FROM events WHERE value IS NOT NULL")
def _num(s, d):
    e = s.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL")
    t = F.when(F.col("event_id") % 5 == 0, F.lit("n/a ")).otherwise(F.concat(F.lit(" $"), F.format_number(F.floor("value"), 0)))
    return e.select("event_id", money.to_number(t).alias("n"))


def _short(c: str) -> str:
    return f"CASE WHEN {c} >= 10000000 THEN '$' || CAST(round({c} / 1000000.0, 0)::BIGINT AS STRING) || 'M' WHEN {c} >= 1000000 THEN '$' || CAST(CAST(round({c} / 1000000.0, 1) AS DECIMAL(18,1)) AS STRING) || 'M' WHEN {c} IS NOT NULL THEN '$' || CAST(floor({c} / 1000 + 0.5)::BIGINT AS STRING) || 'K' END"


@query(
    "money_labels",
    f"WITH {_D} SELECT id, {_short('asking')} AS asking_label, coalesce({_short('ebitda')}, ({_short('sde')}) || '*', '—') AS earnings_label, CASE WHEN coalesce(city, '') <> '' AND coalesce(state, '') <> '' THEN city || ', ' || state WHEN coalesce(city, '') <> '' THEN city WHEN coalesce(state, '') <> '' THEN state ELSE 'Location not disclosed' END AS location_label, CASE WHEN business_model_type IN ('', 'AMBIGUOUS') THEN NULL ELSE lower(replace(business_model_type, '_', ' ')) END AS model_label FROM deals",
)
def _labels(s, d):
    return p.deals(s, d).select("id", money.short(F.col("asking")).alias("asking_label"), money.earnings_label(F.col("ebitda"), F.col("sde")).alias("earnings_label"), text.location_label(F.col("city"), F.col("state")).alias("location_label"), text.model_label(F.col("business_model_type")).alias("model_label"))


@query("lead_sentence", f"WITH {_D} SELECT id, CASE WHEN blurb IS NULL THEN NULL WHEN regexp_extract(blurb, '^(.*?[.!?])( |$)', 1) = '' THEN trim(left(blurb, 200)) ELSE regexp_extract(blurb, '^(.*?[.!?])( |$)', 1) END AS lead FROM deals")
def _lead(s, d):
    return p.deals(s, d).select("id", text.lead_sentence(F.col("blurb")).alias("lead"))


@query("needs_llm_json", f"""WITH {_D} SELECT id, CASE WHEN needs_text LIKE '["earnings","l%' THEN 'earnings|location' WHEN needs_text LIKE '["%' THEN 'earnings' ELSE '' END AS needs FROM deals""")
def _needs(s, d):
    return p.deals(s, d).select("id", F.array_join("needs_llm", "|").alias("needs"))


_PROSE = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "blurb_is_thin",
    f"""WITH {_D}, x AS (SELECT id, trim(coalesce(blurb, '')) AS b, {_PROSE.format('title')} AS nt, {_PROSE.format('blurb')} AS nb FROM deals),
y AS (SELECT *, list_distinct(string_split(nt, ' ')) AS tt, list_distinct(string_split(nb, ' ')) AS tb FROM x)
SELECT id, CASE WHEN length(b) < 24 OR nb = '' THEN true WHEN nt = '' THEN false ELSE nb = nt OR (contains(nb, nt) AND length(nb) <= length(nt) + 60) OR (len(list_intersect(tt, tb)) / len(tb) >= 0.8 AND length(nb) < 160) END AS thin FROM y""",
)
def _thin(s, d):
    return p.deals(s, d).select("id", text.blurb_is_thin(F.col("title"), F.col("blurb")).alias("thin"))


@query("junk_title", f"WITH {_D}, x AS (SELECT id, CASE id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'location: ' || title WHEN 2 THEN 'rations' WHEN 3 THEN 'https://x.example' ELSE title END AS t FROM deals) SELECT id, id % 5 <> 4 AS junk FROM x")
def _junk(s, d):
    t = F.when(F.col("id") % 5 == 0, " ").when(F.col("id") % 5 == 1, F.concat(F.lit("location: "), "title")).when(F.col("id") % 5 == 2, "rations").when(F.col("id") % 5 == 3, "https://x.example").otherwise(F.col("title"))
    return p.deals(s, d).select("id", text.junk_title(t).alias("junk"))


@query("mailbox_slug", f"WITH {_D} SELECT id, regexp_replace(regexp_replace(lower(sub_source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM deals")
def _mailbox(s, d):
    return p.deals(s, d).select("id", text.mailbox_slug(F.col("sub_source")).alias("slug"))


@query("email_attribution", f"WITH {_D} SELECT id, CASE WHEN id % 3 = 1 THEN 'www.found.example' ELSE split_part(sub_source, '@', 2) END AS domain, CASE WHEN id % 3 = 1 THEN '' ELSE sub_source END AS address FROM deals".replace("www.found", "found"))
def _attr(s, d):
    x = p.deals(s, d)
    sender = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Alerts <"), F.upper("sub_source"), F.lit(">"))).otherwise(F.lit("Someone <someone@gmail.com>"))
    body = F.when(F.col("id") % 3 == 2, F.concat(F.lit("FYI\n---------- Forwarded message ---------\nFrom: Alerts <"), "sub_source", F.lit(">\nSubject: x\n\nhello"))).otherwise(F.lit("see https://elink.mail.example... and https://www.found.example/x or https://gmail.com"))
    body = F.when(F.col("id") % 3 == 1, "see https://sendgrid.net/x and https://www.found.example/x").otherwise(body)
    a = mail.attribution(sender, body)
    return x.select("id", a["domain"].alias("domain"), a["address"].alias("address"))


def _count(patterns) -> str:
    return " + ".join(f"regexp_matches(t, '{x.replace(chr(39), chr(39) * 2)}')::INTEGER" for x in patterns)


@query("classify_model", f"""WITH {_D}, x AS (SELECT id, lower(title || ' ' || coalesce(blurb, '')) AS t FROM deals), y AS (SELECT id, {_count(places.LOCAL)} AS l, {_count(places.REGIONAL)} AS r, {_count(places.NATIONAL)} AS n FROM x)
SELECT id, CASE WHEN n > 0 AND n >= r THEN 'NATIONAL' WHEN r > 0 THEN 'REGIONAL' WHEN l > 0 THEN 'LOCAL_SERVICE' ELSE '' END AS model FROM y""")
def _model(s, d):
    return p.deals(s, d).select("id", places.business_model(F.concat_ws(" ", "title", F.coalesce("blurb", F.lit("")))).alias("model"))


@query("strip_html", None)
def _strip(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query("strip_html_light", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '\\n\\s*\\n+', chr(10), 'g'), ' ' || chr(10)) AS body FROM pages")
def _strip_light(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", text.strip_html_light(F.col("html")).alias("body"))


_SOME = "coalesce(asking, revenue, ebitda, sde) IS NOT NULL"


@query("split_blocks", f"WITH {_D} SELECT 'm' || split_part(split_part(ext_id, ':', 2), 'm', 2) AS msg_id, count(*) AS blocks FROM deals WHERE {_SOME} GROUP BY 1")
def _split(s, d):
    return listings.split_messages(p.messages(s, d)).groupBy("msg_id").agg(F.count("*").alias("blocks"))


@query("extract_money_roundtrip", f"WITH {_D} SELECT id, asking, revenue, ebitda, sde FROM deals WHERE {_SOME}")
def _figures(s, d):
    return p.block_text(p.deals(s, d)).where(_SOME).select("id", *[c.alias(n) for n, c in listings.line_figures(F.col("block")).items()])


@query("extract_money_prose", f"WITH {_D} SELECT id, asking, revenue, ebitda, sde FROM deals WHERE {_SOME}")
def _prose(s, d):
    x = p.block_text(p.deals(s, d)).where(_SOME)
    return x.select("id", listings.prose_figures(F.col("block")).alias("f")).select("id", "f.asking", "f.revenue", "f.ebitda", "f.sde")


@query("extract_location_roundtrip", f"WITH {_D} SELECT id, CASE WHEN county IS NULL AND state IS NOT NULL AND state <> 'ON' THEN city END AS city, CASE WHEN state <> 'ON' THEN state END AS state, replace(county, ' County', '') AS county FROM deals")
def _location(s, d):
    x = p.deals(s, d)
    line = F.when(F.col("county").isNotNull(), F.concat_ws(", ", "county", "state")).when(F.col("city").isNotNull(), F.concat_ws(", ", "city", "state")).otherwise("somewhere")
    x = x.select("id", places.location(F.concat(F.lit("A business for sale\nLocation: "), line)).alias("l"))
    return x.select("id", "l.city", "l.state", "l.county")


@query("ltm_table_roundtrip", f"WITH {_D} SELECT id, revenue, ebitda FROM deals WHERE revenue IS NOT NULL AND ebitda IS NOT NULL")
def _ltm(s, d):
    x = p.deals(s, d).where("revenue IS NOT NULL AND ebitda IS NOT NULL")
    n = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    block = F.concat_ws("\n", F.lit("2022"), F.lit("2024"), F.lit("2023"), F.lit("Revenue"), n(F.col("revenue") + 7), n(F.col("revenue")), n(F.col("revenue") + 9), F.lit("EBITDA"), n(F.col("ebitda") + 7), n(F.col("ebitda")), n(F.col("ebitda") + 9))
    f = listings.line_figures(F.col("flat"))
    return x.select("id", listings.normalize_table(block).alias("flat")).select("id", f["revenue"].alias("revenue"), f["ebitda"].alias("ebitda"))


@query("pick_listing_url", f"WITH {_D} SELECT id, 'https://www.beta.example/d?id=' || CAST(id AS STRING) || '&action=pursue' AS url FROM deals")
def _link(s, d):
    key = F.col("id").cast("string")
    block = F.concat(F.lit("Pass (https://www.beta.example/d?id="), key, F.lit("&action=decline) or Pursue (https://www.beta.example/d?id="), key, F.lit("&action=pursue). https://elink.example/t"))
    return p.deals(s, d).select("id", urls.pick_link(block, "beta.example").alias("url"))


@query("extract_listings", f"""WITH {_D}, x AS (SELECT *, row_number() OVER (PARTITION BY split_part(ext_id, ':', 2) ORDER BY id) - 1 AS k FROM deals WHERE {_SOME})
SELECT 'digest:' || split_part(ext_id, ':', 2) || ':' || CAST(k AS STRING) AS ext_id, 'Listing: ' || title AS title, asking, revenue, ebitda, sde, CASE WHEN state <> 'ON' AND county IS NULL AND city IS NOT NULL THEN state WHEN state <> 'ON' AND county IS NOT NULL THEN state END AS state FROM x""")
def _extract(s, d):
    return listings.extract(listings.split_messages(p.messages(s, d)), "beta.example").select("ext_id", "title", "asking", "revenue", "ebitda", "sde", "state")


def _messages_sql() -> str:
    return f"""{_D}, m AS (SELECT split_part(ext_id, ':', 2) AS msg_id, min(id) AS seq, count(*) AS n, any_value(source) AS source, any_value(sub_source) AS sub_source FROM deals WHERE {_SOME} GROUP BY 1),
fm AS (SELECT *, CASE WHEN source = 'alpha.example' THEN 'alpha.digest' WHEN source = 'beta.example' THEN 'beta.teaser' ELSE 'letters.weekly' END AS format_id,
 CASE WHEN source = 'alpha.example' THEN 80 + 120 + 100 + 20 + CASE WHEN seq % 4 = 0 THEN 40 ELSE 0 END WHEN source = 'beta.example' THEN 120 + 20 + CASE WHEN seq % 4 = 2 THEN 40 ELSE 0 END ELSE 0 END AS base FROM m)"""


@query("format_match", f"""WITH {_messages_sql()} SELECT msg_id, CASE WHEN source = 'letters.example' THEN NULL ELSE format_id END AS format_id, CASE source WHEN 'alpha.example' THEN 'Alpha Marketplace' WHEN 'beta.example' THEN 'Beta Network' ELSE 'Letters' END AS nickname,
CASE source WHEN 'alpha.example' THEN 'alpha_alerts' WHEN 'beta.example' THEN 'beta_any' END AS subcategory FROM fm""")
def _formats(s, d):
    return formats.match_formats(p.messages(s, d)).select("msg_id", "format_id", "nickname", "subcategory")


@query("classify_counts", f"WITH {_messages_sql()} SELECT CASE WHEN source = 'letters.example' THEN '(unmatched)' ELSE format_id END AS format_id, count(*) AS messages, count(*) AS expecting FROM fm GROUP BY 1")
def _counts(s, d):
    return formats.classify_counts(formats.match_formats(p.messages(s, d)))


@query("propose_groups", f"""WITH {_messages_sql()}, u AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'New deals for you' WHEN 1 THEN 'Business for sale: one of a kind' WHEN 2 THEN 'An opportunity' ELSE 'Hello' END AS subject, row_number() OVER (ORDER BY seq) AS rn FROM fm WHERE source = 'letters.example')
SELECT sub_source AS address, count(*) AS messages, string_agg(subject, ' | ' ORDER BY seq) FILTER (rn <= 5) AS subjects FROM u GROUP BY 1""")
def _propose(s, d):
    return formats.propose_groups(formats.match_formats(p.messages(s, d)))


@query("catalog_violations", "SELECT * FROM (VALUES ('x.one', 'repeated id'), ('x.two', 'unknown email type'), ('sub', 'default names no format')) t(id, problem)")
def _violations(s, d):
    bad = formats.Catalog((formats.Format("x.one"), formats.Format("x.one"), formats.Format("x.two", email_type="odd")), (formats.Subcategory("sub", "a@b.example", "b", "none"),))
    return s.createDataFrame(formats.violations(bad), "id string, problem string")


@query("yield_stats", f"""WITH {_messages_sql()}, z AS (SELECT CASE WHEN source = 'letters.example' THEN NULL ELSE split_part(format_id, '.', 1) END AS format_family, split_part(sub_source, '@', 2) AS domain, sub_source AS address, n FROM fm)
SELECT 'format_family' AS kind, coalesce(format_family, '(none)') AS value, sum(n)::BIGINT AS blocks, count(*) AS messages FROM z GROUP BY 2 UNION ALL SELECT 'domain', domain, sum(n)::BIGINT, count(*) FROM z GROUP BY 2 UNION ALL SELECT 'address', address, sum(n)::BIGINT, count(*) FROM z GROUP BY 2""")
def _yield(s, d):
    m = formats.match_formats(p.messages(s, d)).withColumn("blocks", F.col("n_blocks"))
    return health.yield_stats(m, ("format_family", "domain", "address"))


@query("health", "SELECT * FROM (VALUES ('alpha', 'WARN', 3::BIGINT, 12::BIGINT), ('beta', 'CRITICAL', 0::BIGINT, 4::BIGINT), ('gamma', 'INFO', 7::BIGINT, NULL::BIGINT)) t(source, level, got, expected)")
def _health(s, d):
    return health.health(s.createDataFrame([("alpha", 3), ("newsletter", 8), ("gamma", 7)], "source string, n long"))
