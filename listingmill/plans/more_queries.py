"""Queues, playbooks, survey counts, repairs, flags and splitters."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingmill.functions import urls
from listingmill.operators import formats, listings, queues, rules
from listingmill.plans import projections as p
from listingmill.plans.text_queries import _SOME

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


_HREF = "CASE WHEN source = 'beta.example' THEN regexp_replace(regexp_replace(url, 'action=decline', 'action=pursue', 'gi'), 'utm_content=pass', 'utm_content=pursue', 'gi') ELSE url END"


@query("playbook", f"WITH {_D} SELECT id, CASE WHEN url IS NULL THEN NULL WHEN source = 'beta.example' THEN 'pursue' ELSE 'listing' END AS playbook, CASE WHEN url IS NULL THEN NULL WHEN source = 'beta.example' THEN 'Pursue on Beta Network' ELSE 'Open ' || nickname END AS label, {_HREF} AS href FROM deals".replace("contains", "contains"))
def _playbook(s, d):
    x = p.deals(s, d).select("id", queues.playbook(F.col("source"), F.col("nickname"), F.col("url"), "beta.example", "Beta Network").alias("b"))
    return x.select("id", F.col("b.id").alias("playbook"), "b.label", "b.href")


@query("action_queue", f"WITH {_D} SELECT id FROM deals WHERE stage IN ('shortlist', 'contacted', 'nda') AND url IS NOT NULL AND id % 10 <> 0")
def _actions(s, d):
    x = p.deals(s, d)
    return queues.action_queue(x, x.where("id % 10 = 0").select("id"), "beta.example", "Beta Network").select("id")


@query("pursuit_candidates", f"WITH {_D} SELECT id, stage FROM deals WHERE stage NOT IN ('closed', 'dead') ORDER BY last_seen DESC, id LIMIT 2000")
def _pursuit(s, d):
    from listingmill.operators.pursuit import OPEN_STAGES

    return p.deals(s, d).where(F.col("stage").isin(*OPEN_STAGES)).orderBy(F.desc("last_seen"), "id").limit(2000).select("id", "stage")


@query("url_repair_counts", f"WITH {_D} SELECT count(*) FILTER (lower(url) LIKE '%action=decline%' OR lower(url) LIKE '%utm_content=pass%') AS bad, count(*) FILTER (lower(url) LIKE '%action=pursue%' OR lower(url) LIKE '%utm_content=pursue%') AS good FROM deals")
def _repair(s, d):
    return queues.repair_counts(p.deals(s, d))


@query("fix_pass_urls", f"WITH {_D} SELECT id, CASE WHEN lower(url) LIKE '%beta.example%' THEN regexp_replace(regexp_replace(url, 'action=decline', 'action=pursue', 'gi'), 'utm_content=pass', 'utm_content=pursue', 'gi') ELSE url END AS url FROM deals WHERE url IS NOT NULL")
def _fix(s, d):
    return p.deals(s, d).where("url IS NOT NULL").select("id", urls.force_pursue(F.col("url"), "beta.example").alias("url"))


@query("merge_ordered_sets", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN '[2, 0, 1]' WHEN o_orderkey % 3 = 1 THEN '[1, 2, 0]' ELSE '[0, 2, 1]' END AS merged FROM orders")
def _sets(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("k"))
    return o.select("id", F.concat(F.lit("["), F.array_join(queues.append_absent(F.array("k"), F.when(F.col("k") == 2, F.array(F.lit(0), F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(1), F.lit(0)))).cast("array<string>"), ", "), F.lit("]")).alias("merged"))


@query("signal_counts", f"""WITH {_D}, m AS (SELECT split_part(ext_id, ':', 2) AS msg_id, count(*) AS n, max(asking IS NOT NULL) AS ask FROM deals WHERE {_SOME} GROUP BY 1) SELECT count(*) AS messages, count(*) FILTER (ask) AS has_asking_price, count(*) AS has_money, 0::BIGINT AS has_nda, 0::BIGINT AS has_new_business_matches, 0::BIGINT AS has_match_search_criteria, 0::BIGINT AS has_in_todays_issue, 0::BIGINT AS has_new_listing, 0::BIGINT AS has_franchise_section, 0::BIGINT AS numbered_items FROM m""")
def _signals(s, d):
    return queues.signals(p.messages(s, d)).agg(F.count("*").alias("messages"), *[F.count_if(c).alias(c) for c in queues.SIGNALS], F.sum("numbered_items").alias("numbered_items"))


@query("field_presence", f"""WITH {_D}, m AS (SELECT split_part(ext_id, ':', 2) AS msg_id, min(id) AS seq, max(revenue IS NOT NULL)::INT AS r, max(ebitda IS NOT NULL)::INT AS e, max(sde IS NOT NULL)::INT AS c FROM deals WHERE {_SOME} GROUP BY 1)
SELECT 'revenue' AS field, sum(r)::BIGINT AS messages FROM m UNION ALL SELECT 'ebitda', sum(e)::BIGINT FROM m UNION ALL SELECT 'cash flow', sum(c)::BIGINT FROM m""")
def _presence(s, d):
    m = p.messages(s, d).withColumn("body", F.regexp_replace("body", r"(?m)^Listing: .*$", ""))
    return queues.field_presence(m, {"revenue": r"(?i)^\s*revenue:", "ebitda": r"(?i)ebitda:", "cash flow": r"(?i)cash flow:"})


@query("shape_counts", f"WITH {_D}, m AS (SELECT split_part(ext_id, ':', 2) AS k, any_value(source) AS source, min(id) AS seq FROM deals WHERE {_SOME} GROUP BY 1) SELECT CASE WHEN source = 'alpha.example' AND seq % 4 = 0 THEN 'alpha.digest' WHEN source = 'alpha.example' THEN 'alpha.other' WHEN source = 'beta.example' THEN 'beta.mail' ELSE 'other:editor@letters.example' END AS shape, count(*) AS messages FROM m GROUP BY 1")
def _shapes(s, d):
    shapes = (("alpha.digest", r"@alpha\.example", "(?i)new deals"), ("alpha.other", r"@alpha\.example", ""), ("beta.mail", "beta", ""))
    return queues.shape_counts(p.messages(s, d), shapes)


@query("learned_rules", f"WITH {_D} SELECT id, CASE WHEN contains(lower(title || ' ' || coalesce(blurb, '')), 'plumbing') THEN -25 ELSE 0 END + CASE WHEN contains(lower(title || ' ' || coalesce(blurb, '')), 'water') THEN 10 ELSE 0 END AS points FROM deals")
def _learned(s, d):
    learned = (("Plumbing", 5, -60), ("water", 3, 10), ("roofing", 2, 9))
    return p.deals(s, d).select("id", queues.learned_points(rules.listing_text(), learned).alias("points"))


@query("mark_skip", f"WITH {_D} SELECT id, CASE WHEN id % 5 = 0 THEN true ELSE coalesce(id % 7 = 0, false) END AS rejected, CASE WHEN id % 5 = 0 THEN 'before' WHEN id % 7 = 0 THEN 'skip' END AS reason FROM deals")
def _skip(s, d):
    x = p.deals(s, d).withColumns({"rejected": F.col("id") % 5 == 0, "reject_reason": F.when(F.col("id") % 5 == 0, "before")})
    marks = x.where("id % 7 = 0").select("id", F.lit("skip").alias("reason"))
    return queues.mark_skips(x, marks).select("id", "rejected", F.col("reject_reason").alias("reason"))


_REASONS = ("EBITDA, Rev, Asking Price", "Location", "Blurb", "Duplicate listing", "Not a real deal", "Other", "unheard of")
_FOCUS = ("ebitda|sde|revenue|asking|expected_fields.absent|gotchas", "location|city|state|county|detect.body_open|gotchas", "title|blurb|detect.subject_patterns|gotchas", "dedupe|ext_id|url", "email_type|status|split|control", "gotchas|detect|expected_fields", "gotchas|detect|expected_fields")


@query("inspect_flag", f"SELECT event_id, {p.pick('event_id', _FOCUS)} AS focus, left('Train (' || {p.pick('event_id', _REASONS)} || '): ' || CASE WHEN event_id % 3 = 0 THEN 'the deal' ELSE repeat('word ', 70) END, 280) AS suggested FROM events")
def _inspect(s, d):
    e = p.spark_view(s, d, f"SELECT event_id, {p.pick('event_id', _REASONS)} AS reason, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE repeat('word ', 70) END AS detail FROM {{events}}")
    return e.select("event_id", F.array_join(queues.focus_fields(F.col("reason")), "|").alias("focus"), queues.suggested_note(F.col("reason"), F.col("detail"), F.lit("the deal")).alias("suggested"))


@query("format_of_deal", f"WITH {_D} SELECT id, CASE source WHEN 'alpha.example' THEN 'alpha.digest' WHEN 'beta.example' THEN 'beta.teaser' ELSE 'letters.weekly' END AS format_id FROM deals")
def _format_of(s, d):
    return p.deals(s, d).select("id", queues.format_of(formats.SAMPLE, F.col("source"), F.col("sub_source"), F.col("nickname")).alias("format_id"))


@query("catalog_summary", "SELECT * FROM (VALUES ('alpha', 4::BIGINT, 2::BIGINT), ('beta', 2::BIGINT, 1::BIGINT), ('newsletter', 1::BIGINT, 1::BIGINT)) t(family, formats, active)")
def _summary(s, d):
    return queues.catalog_summary(s, formats.SAMPLE)


@query("schema_evolution", f"WITH {_D} SELECT id, stage, CASE WHEN id % 2 = 1 THEN source END AS source FROM deals")
def _schema(s, d):
    x = p.deals(s, d)
    return x.where("id % 2 = 0").select("id", "stage").unionByName(x.where("id % 2 = 1").select("id", "stage", "source"), allowMissingColumns=True)


@query("numbered_digest", f"WITH {_D} SELECT split_part(ext_id, ':', 2) AS msg_id, count(*) AS items FROM deals WHERE asking IS NOT NULL GROUP BY 1")
def _numbered(s, d):
    x = p.deals(s, d).where("asking IS NOT NULL")
    item = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(": Deal at $"), F.format_number("asking", 0), F.lit("\nwrapped line https://x.example/a\n"))
    m = x.groupBy(F.split("ext_id", ":").getItem(1).alias("msg_id")).agg(F.min("id").alias("seq"), F.concat(F.lit("header $5 text\nIn today's issue\n"), F.array_join(F.sort_array(F.collect_list(item)), "")).alias("body"))
    return listings.split_messages(m.where(F.length("body") < 3500).unionByName(m.where(F.length("body") >= 3500))).groupBy("msg_id").agg(F.count("*").alias("items"))


@query("detail_cards", f"WITH {_D} SELECT id, 1::BIGINT AS blocks, revenue, asking FROM deals WHERE revenue IS NOT NULL AND asking IS NOT NULL")
def _cards(s, d):
    x = p.deals(s, d).where("revenue IS NOT NULL AND asking IS NOT NULL")
    n = lambda c: F.format_number(c, 0)
    body = F.concat(F.lit("A business with a long headline worth $5 or more\n\nLocation: Waco, TX\n\nRevenue: $"), n("revenue"), F.lit("\nAsking Price: $"), n("asking"), F.lit("\n\nUnsubscribe here from mails"))
    b = x.select("id", listings.blocks(body).alias("b"))
    f = listings.line_figures(F.get("b", F.lit(0)))
    return b.select("id", F.size("b").cast("long").alias("blocks"), f["revenue"].alias("revenue"), f["asking"].alias("asking"))
