"""Deal-shaped projections of the driver's tables, in SQL that Spark and DuckDB both read.

The tables hold no deal mail, so each operator runs over a deterministic projection; the oracle
uses the same projection and its own statement of the operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = (
    "Established Plumbing Company", "Commercial Roofing Contractor with Backlog", "Water Treatment and Filtration Services", "Downtown Pizzeria and Cafe",
    "B2B Software Platform with Recurring Revenue", "Industrial Parts Manufacturer", "Regional HVAC Service Business", "Franchise Resale in Growing Market",
    "Medical Supply Distributor Nationwide", "Owner Operated Landscaping Route", "Legionella and Water Testing Lab", "Family Restaurant with Real Estate",
    "Specialty Fabrication Shop", "Contract Janitorial Company", "Air Filtration Products Maker", "Gas Station and Convenience Store",
)
BLURBS = (
    None, "Recurring contract revenue with municipal customers and a long-term agreement in place. Owner will train.",
    "Serves residential customers in one service area with three crews. Owner operated! Must sell.",
    "Ships nationally to customers in all 50 states. Management team in place; the owner is retiring after a transition period.",
    "A regional leader across three states with a strong backlog and fragmented industry.", "Small shop", "Turnkey cash cow that runs itself, hurry.",
    "Sells to hospitals under a GPO contract with no customer concentration. Real estate available for purchase as well.",
)
PLACES = (
    ("Austin", "TX", None), ("North Waco", "TX", None), ("Dallas", "TX", None), (None, "TX", "Travis County"), ("Tulsa", "OK", None), ("Shreveport", "LA", None),
    ("Denver", "CO", None), ("Miami", "FL", None), (None, None, None), ("Toronto", "ON", None), ("Little Rock", "AR", None), ("Columbus", "OH", None),
)
MODELS = ("LOCAL_SERVICE", "NATIONAL", "REGIONAL", "", "AMBIGUOUS", None)
STAGES = ("inbox", "inbox", "shortlist", "contacted", "nda", "cim", "call", "loi", "diligence", "offer", "closed", "dead")
SOURCES = (("alpha.example", "alerts@alpha.example", "Alpha Marketplace"), ("beta.example", "deals@mail.beta.example", "Beta Network"), ("letters.example", "editor@letters.example", "Letters"))


def lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"'{v}'"


def pick(expr: str, values) -> str:
    values = list(values)
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


_K = "o_orderkey"
DEALS = f"""
SELECT o_orderkey AS id, o_orderkey AS seq, 'digest:m' || CAST(o_custkey AS STRING) || ':' || CAST(o_orderkey AS STRING) AS ext_id,
  {pick(f'{_K} * 7 + o_custkey', TITLES)} || CASE WHEN {_K} % 3 = 0 THEN '' ELSE ' no ' || CAST({_K} % 50 AS STRING) END AS title,
  {pick(f'{_K} + o_custkey', BLURBS)} AS blurb,
  {pick('o_custkey', [s[0] for s in SOURCES])} AS source, {pick('o_custkey', [s[1] for s in SOURCES])} AS sub_source, {pick('o_custkey', [s[2] for s in SOURCES])} AS nickname,
  {pick(f'o_custkey + {_K}', [p[0] for p in PLACES])} AS city, {pick(f'o_custkey + {_K}', [p[1] for p in PLACES])} AS state, {pick(f'o_custkey + {_K}', [p[2] for p in PLACES])} AS county,
  CASE WHEN {_K} % 4 <> 1 THEN CAST(floor(o_totalprice / 100) * 2000 AS DOUBLE) END AS revenue,
  CASE WHEN {_K} % 5 IN (0, 2) THEN CAST(floor(o_totalprice / 100) * 300 AS DOUBLE) END AS ebitda,
  CASE WHEN {_K} % 3 = 0 THEN CAST(floor(o_totalprice / 100) * 400 AS DOUBLE) END AS sde,
  CASE WHEN {_K} % 7 <> 3 THEN CAST(floor(o_totalprice / 100) * 1000 AS DOUBLE) END AS asking,
  {pick(_K, MODELS)} AS business_model_type,
  CASE WHEN {_K} % 9 = 0 THEN NULL ELSE 'https://www.' || CASE o_custkey % 3 WHEN 0 THEN 'alpha.example' WHEN 1 THEN 'beta.example' ELSE 'letters.example' END
    || CASE {_K} % 4 WHEN 0 THEN '/listings/Profile/?q=' || CAST(100000 + {_K} % 4000 AS STRING) || '&utm_source=mail' WHEN 1 THEN '/opportunity/' || CAST(200000 + {_K} AS STRING) || '/'
       WHEN 2 THEN '/Deal-' || CAST({_K} % 700 AS STRING) || '?ref=x&recordId=R' || CAST({_K} % 90 AS STRING) || '&action=decline#top' ELSE '/p/' || CAST({_K} AS STRING) || '?utm_content=Pass&Source=y' END END AS url,
  CASE WHEN {_K} % 6 = 0 THEN NULL WHEN {_K} % 6 = 1 THEN '["earnings","location"]' WHEN {_K} % 6 = 2 THEN '[]' WHEN {_K} % 6 = 3 THEN 'not json' ELSE '["earnings"]' END AS needs_text,
  {pick(_K, STAGES)} AS stage, CAST(o_orderdate AS TIMESTAMP) AS last_seen, CAST(o_orderdate AS DATE) AS seen_day, 1 + {_K} % 4 AS times_seen
FROM {{orders}}
"""
VERDICTS = """
SELECT event_id AS pos, user_id AS deal_id, CASE WHEN event_id % 2 = 0 THEN 'ann' ELSE 'bob' END AS member,
  CASE event_type WHEN 'purchase' THEN 'short' WHEN 'view' THEN 'discuss' WHEN 'click' THEN 'pass' WHEN 'signup' THEN 'invalid' END AS action,
  CASE WHEN event_id % 3 = 0 THEN 'too small' WHEN event_id % 3 = 1 THEN 'other' END AS reason,
  'log' || CAST(event_id % 5 AS STRING) || '.json' AS file, CAST(CAST(ts AS TIMESTAMP) AS STRING) AS at_text, CAST(ts AS TIMESTAMP) AS ts
FROM {events}
"""
REFS = "SELECT l_orderkey AS deal_id, 'src' || CAST(l_suppkey % 7 AS STRING) AS source, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey % 5 AS STRING) AS msg_id FROM {lineitem}"
OUTREACH = """
SELECT event_id, user_id AS deal_id, CAST(ts AS TIMESTAMP) AS created_at,
  CASE event_type WHEN 'purchase' THEN 'nda_signed' WHEN 'view' THEN 'messaged' WHEN 'click' THEN 'cim_received' WHEN 'signup' THEN 'waiting' ELSE 'unavailable' END AS outcome,
  CASE event_type WHEN 'purchase' THEN 'nda_signed' WHEN 'view' THEN 'nda_available' WHEN 'click' THEN 'cim_received' ELSE 'call_request' END AS event_type,
  CASE WHEN event_id % 2 = 0 THEN 'ann' ELSE 'bob' END AS member, CASE event_id % 3 WHEN 0 THEN 'listing' WHEN 1 THEN 'criteria' ELSE 'format' END AS intent
FROM {events}
"""
#: Digests: a message for each customer, with a block for each of its orders.
MONEY = "CAST(CAST({} AS BIGINT) AS STRING)"


def tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(sql)})


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in tables(sql)})


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark_view(spark, sf_dir, DEALS)
    return d.withColumn("needs_llm", F.coalesce(F.from_json("needs_text", "array<string>"), F.array().cast("array<string>")))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listingmill.operators.views import v_deals

    return v_deals(deals(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, VERDICTS).withColumn("at", F.col("at_text"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, REFS)


def outreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, OUTREACH)


def block_text(d: DataFrame) -> DataFrame:
    """Blocks of label lines, written out from the figures of deals."""
    dollars = lambda c: F.format_number(F.col(c).cast("long"), 0)
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: $"), dollars(c)))
    place = F.when(F.col("county").isNotNull() & F.col("state").isNotNull(), F.concat(F.lit("Location: "), "county", F.lit(", "), "state")).when(F.col("city").isNotNull() & F.col("state").isNotNull(), F.concat(F.lit("Location: "), "city", F.lit(", "), "state"))
    return d.withColumn("block", F.concat_ws("\n", F.concat(F.lit("Listing: "), "title"), line("Asking Price", "asking"), line("Revenue", "revenue"), line("Adjusted EBITDA", "ebitda"), line("Cash Flow", "sde"), place, "url"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest a customer: sender, subject and a body of blocks (those with a figure, in the order of their keys)."""
    d = block_text(deals(spark, sf_dir)).where("coalesce(asking, revenue, ebitda, sde) IS NOT NULL")
    key = F.split("ext_id", ":").getItem(1)
    g = d.groupBy(key.alias("msg_id")).agg(F.sort_array(F.collect_list(F.struct("id", "block"))).alias("b"), F.first("sub_source").alias("sub_source"), F.min("id").alias("seq"))
    return g.select(
        "seq",
        "msg_id",
        F.concat(F.lit("Alerts <"), "sub_source", F.lit(">")).alias("sender"),
        F.when(F.col("seq") % 4 == 0, "New deals for you").when(F.col("seq") % 4 == 1, "Business for sale: one of a kind").when(F.col("seq") % 4 == 2, "An opportunity").otherwise("Hello").alias("subject"),
        F.concat(F.lit("Deals of the day\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("body"),
        F.size("b").cast("long").alias("n_blocks"),
    )


#: Titles put together from parts and a name made of the key's digits, each twice in its area with different endings.
WORDS = (
    ("Established", "Regional", "Family Owned", "Profitable", "Turnkey", "Niche", "Growing", "Commercial", "Absentee Run", "Premier", "Longtime", "Rural", "Coastal"),
    ("Plumbing", "Roofing", "Water Testing", "HVAC", "Landscaping", "Software", "Medical Supply", "Fabrication", "Bakery", "Logistics", "Signage", "Laboratory", "Printing", "Janitorial", "Electrical", "Veterinary", "Packaging"),
    ("Company", "Contractor", "Services", "Distributor", "Manufacturer", "Group", "Workshop"),
)
_PAIR = "CAST(floor(o_orderkey / 2) AS BIGINT)"
VARIED = f"""
SELECT o_orderkey AS id, 'area ' || CAST({_PAIR} % 200 AS STRING) AS state,
  {pick(_PAIR, WORDS[0])} || ' ' || {pick(f'CAST(floor({_PAIR} / 13) AS BIGINT)', WORDS[1])} || ' ' || {pick(f'{_PAIR} * 5', WORDS[2])}
    || ' ' || translate(CAST(1000000 + {_PAIR} * 7919 % 999983 AS STRING), '0123456789', 'aeioumnrst') || ' ' || translate(CAST(1000000 + {_PAIR} * 104729 % 999979 AS STRING), '0123456789', 'bcdfglpkwz')
    || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE CASE {_PAIR} % 3 WHEN 0 THEN ' a' WHEN 1 THEN ' ltd' ELSE ' no ' || CAST(o_orderkey AS STRING) END END AS title
FROM {{orders}}
"""
