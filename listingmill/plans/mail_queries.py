"""Splitters, titles, pages, kinds of mail. The SQL states each rule over lines or fields in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingmill.functions import text
from listingmill.operators import events, pages, senders, splitters, survey, titles
from listingmill.plans import projections as p
from listingmill.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


NL = "chr(10)"
_TITLE = p.pick("{k} * 7 + o_custkey", p.TITLES) + " || ' no ' || CAST({k} % 50 AS STRING)"
_LINK = "'https://www.alpha.example/listings/p/' || CAST({k} AS STRING) || '?utm_source=mail'"
_AMOUNT = "'$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_TOWN = p.pick("o_custkey + {k}", ["Austin, TX", "TX", "Travis County, Texas", "Tulsa, OK", "Denver, CO"])


def _card(k: str) -> str:
    t, link, town = _TITLE.format(k=k), _LINK.format(k=k), _TOWN.format(k=k)
    ways = (
        f"{t} || {NL} || 'Asking Price:' || {NL} || {_AMOUNT} || {NL} || 'Location:' || {NL} || {town}",
        f"{t} || {NL} || '<' || {link} || '>' || {NL} || 'Asking Price:   ' || {_AMOUNT} || {NL} || 'Location: ' || {town}",
        f"{t} || ' (' || {link} || ')' || chr(13) || {NL} || {NL} || 'Asking Price: ' || {_AMOUNT} || chr(13) || {NL} || 'Location: ' || {town}",
        f"{link} || {NL} || '  ' || {t} || {NL} || 'Asking Price: Not disclosed' || {NL} || 'Location: ' || {town}",
        f"{t} || {NL} || 'asking price: ' || {_AMOUNT} || {NL} || 'Location: Available in a location near you'",
        f"'rations' || {NL} || 'Asking Price: ' || {_AMOUNT} || {NL} || 'Location: ' || {town}",
        f"'Businesses recently posted today' || {NL} || {link} || {NL} || {t} || {NL} || {link} || {NL} || 'ASKING PRICE: ' || {_AMOUNT} || {NL} || 'Location:  ' || {town}",
    )
    return f"CASE ({k} + o_custkey) % {len(ways)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"


ALERTS = f"""SELECT o_orderkey AS seq, 'New for you' || {NL} || {NL} || {_card('o_orderkey')} || {NL} || {NL} || {_card('(o_orderkey + 3)')}
 || CASE WHEN o_orderkey % 4 = 0 THEN {NL} || 'The following franchises also' || {NL} || 'match your search criteria' || {NL} || {_card('(o_orderkey + 1)')} ELSE '' END AS body FROM {{orders}}"""
_LISTS = f"""WITH m AS ({p.duck(ALERTS)}), c AS (SELECT seq, string_split_regex(body, 'following\\s+franchises[^#]{{0,120}}?match your search criteria')[1] AS body FROM m),
l AS (SELECT seq, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, ' \\((https?://[^ )]+)\\)', chr(10) || '\\1', 'g'), '[\\r\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ls FROM c),
a AS (SELECT seq, ls, unnest(range(1, len(ls) + 1)) AS i FROM l), b AS (SELECT * FROM a WHERE starts_with(lower(ls[i]), 'asking price:')),
f AS (SELECT seq, ls, i, trim(substr(ls[i], 14)) AS own, CASE WHEN trim(substr(ls[i], 14)) = '' THEN i + 2 ELSE i + 1 END AS j FROM b),
g AS (SELECT seq, i, CASE WHEN own = '' THEN ls[i + 1] ELSE own END AS price, CASE WHEN trim(substr(ls[j], 10)) = '' THEN ls[j + 1] ELSE trim(substr(ls[j], 10)) END AS place,
 list_filter(ls[greatest(i - 3, 1):i - 1], lambda s: NOT contains(s, '://'))[-1] AS title, list_filter(ls[greatest(i - 3, 1):i - 1], lambda s: contains(s, '://'))[-1] AS link FROM f),
k AS (SELECT * FROM g WHERE contains(price, '$') AND NOT contains(lower(place), 'available in a location near you') AND NOT contains(lower(title), 'recently posted') AND NOT (length(title) < 20 AND title[1] <> upper(title[1])))
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY i) - 1 AS block_idx, concat_ws(chr(10), title, 'Asking Price: ' || price, 'Location: ' || place, replace(replace(link, '<', ''), '>', '')) AS block FROM k"""


@query("split_alert_cards", _LISTS)
def _cards(s, d):
    m = p.spark_view(s, d, ALERTS)
    return m.select("seq", F.posexplode(splitters.alert_cards(F.col("body"))).alias("i", "block")).select("seq", F.col("i").cast("long").alias("block_idx"), "block")


_K = "o_orderkey"
OFFERS = f"""SELECT o_orderkey AS seq, {_TITLE.format(k=_K)} AS title, {_TOWN.format(k=_K)} AS town, {_LINK.format(k=_K)} AS link, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS amount, 'Alerts' || {NL} || 'View in browser' || {NL}
 || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {_TOWN.format(k=_K)} || CASE WHEN o_orderkey % 2 = 0 THEN ' (Relocatable)' ELSE '' END || ': (' || {_LINK.format(k=_K)} || ')' || {NL} END
 || {_TITLE.format(k=_K)} || ' (' || {_LINK.format(k=_K)} || '&utm_content=headline)' || {NL} || 'Steady customers and a crew.' || {NL} || {NL} || 'Books are clean.' || {NL} || 'A third line.' || {NL}
 || CASE WHEN o_orderkey % 7 = 0 THEN 'View details' || {NL} ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'Price on request' ELSE 'Asking Price: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END || {NL}
 || 'Business Summary' || {NL} || 'Cash flow of $999,999 is claimed. Asking is firm.' AS body FROM {{orders}}"""


@query(
    "split_single_offer",
    f"WITH m AS ({p.duck(OFFERS)}) SELECT seq, concat_ws(chr(10), title, 'Asking Price: $' || amount, CASE WHEN seq % 5 <> 0 THEN 'Location: ' || town END, link || '&utm_content=headline', 'Steady customers and a crew. Books are clean.') AS block FROM m WHERE seq % 3 <> 0",
)
def _offers(s, d):
    return p.spark_view(s, d, OFFERS).select("seq", F.explode(splitters.single_offer(F.col("body"))).alias("block"))


RULED = f"""SELECT o_orderkey AS seq, {_TITLE.format(k=_K)} AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Your address has changed. Nothing else is new, and no action is needed from you at this time, thanks.' ELSE
 'Intro line' || {NL} || '---' || {NL} || {_TITLE.format(k=_K)} || {NL} || 'Revenue: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) * 10 AS STRING) || {NL} || 'EBITDA: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || {NL} || {_TITLE.format(k=_K)} || {NL}
 || 'Based on your criteria, we found this.' || {NL} || 'The company serves clients  in three states' || {NL} || 'and has long contracts.' || {NL} || 'Call ███ at ███' || {NL} || 'Geography' || {NL} || 'Texas' || {NL} || '  1. short' || {NL}
 || '2. Another business of note, of which the broker says no more than that its revenue was $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' in the last year.' END AS body FROM {{orders}}"""


@query(
    "split_ruled_parts",
    f"""WITH m AS ({p.duck(RULED)}), x AS (SELECT seq, unnest(CASE WHEN seq % 3 = 0 THEN [] ELSE [0, 1] END) AS block_idx, string_split_regex(body, '\\n\\s*(---|[0-9]+\\.\\s)') AS ps FROM m)
SELECT seq, block_idx::BIGINT AS block_idx, ps[CASE block_idx WHEN 0 THEN 2 ELSE 4 END] AS block FROM x""",
)
def _ruled(s, d):
    m = p.spark_view(s, d, RULED)
    return m.select("seq", F.posexplode(splitters.ruled_parts(F.col("body"))).alias("i", "block")).select("seq", F.col("i").cast("long").alias("block_idx"), "block")


@query("ruled_description", f"WITH m AS ({p.duck(RULED)}) SELECT seq, CASE WHEN seq % 3 = 0 THEN 'Your address has changed. Nothing else is new, and no action is needed from you at this time, thanks.' ELSE 'The company serves clients in three states and has long contracts.' END AS blurb FROM m")
def _described(s, d):
    return p.spark_view(s, d, RULED).select("seq", splitters.ruled_description(F.col("body"), F.col("title")).alias("blurb"))


_SUBJECTS = (None, "Fwd: A quiet bakery by the lake", "Business For Sale: Services, Texas", "Tire Service and 7 other new leads", "RE:  Two   words", "x", "14 new leads")
_LINES = ("View image: logo", "$1,200,000", "### Asking: $600,000 | Revenue: $3M | SDE: $262k", "https://www.alpha.example/x", "(512) 555-0100", "Hello there, friends", "#1: Tour Operator with Revenue and $763K SDE", "**Coastal Dock Builder**", "[Metal Shop](https://www.alpha.example/y) more",
          "An oilfield services operation with two yards that has served the basin since the eighties and keeps its crews busy all year", "Asking Price: $5", "short", "The owner retires. The crew stays on.", "• Roofing Crew", "Sponsored by a bank")
_BLOCKS = f"SELECT event_id, {p.pick('event_id', _SUBJECTS)} AS subject, concat_ws({NL}, {p.pick('user_id', _LINES)}, {p.pick('event_id * 3 + user_id', _LINES)}, {p.pick('event_id * 5', _LINES)}) AS block FROM {{events}}"
_SAYS = {
    "#1: Tour Operator with Revenue and $763K SDE": "Tour Operator with Revenue and $763K SDE", "**Coastal Dock Builder**": "Coastal Dock Builder", "[Metal Shop](https://www.alpha.example/y) more": "Metal Shop", _LINES[9]: _LINES[9], "The owner retires. The crew stays on.": "The owner retires. The crew stays on.", "• Roofing Crew": "Roofing Crew",
}


@query(
    "extract_title",
    f"""WITH m AS ({p.duck(_BLOCKS)}), says AS (SELECT * FROM (VALUES {', '.join(f"({p.lit(a)}, {p.lit(b)})" for a, b in _SAYS.items())}) v(line, title)),
l AS (SELECT event_id, subject, unnest(string_split(block, chr(10))) AS line, unnest(range(3)) AS i FROM m), f AS (SELECT event_id, arg_min(title, i) AS title FROM l JOIN says USING (line) GROUP BY 1),
j AS (SELECT m.event_id, m.subject, f.title, m.subject IN ('Fwd: A quiet bakery by the lake', 'RE:  Two   words') AS usable, regexp_matches(coalesce(m.subject, ''), 'new leads') AS digest, trim(regexp_replace(regexp_replace(m.subject, '^(Fwd|RE): *', ''), ' +', ' ', 'g')) AS said FROM m LEFT JOIN f ON f.event_id = m.event_id)
SELECT event_id, left(CASE WHEN title IS NULL THEN CASE WHEN usable THEN said ELSE '(untitled listing)' END WHEN length(title) > 80 OR contains(title, '. ') THEN CASE WHEN usable THEN said WHEN digest AND starts_with(title, 'An oil') THEN 'oilfield services operation' WHEN digest THEN 'owner retires' ELSE title END ELSE title END, 110) AS title FROM j""",
)
def _titles(s, d):
    return p.spark_view(s, d, _BLOCKS).select("event_id", titles.title_of(F.col("block"), F.col("subject")).alias("title"))


@query("figure_lines", f"WITH m AS ({p.duck(_BLOCKS)}), l AS (SELECT event_id, unnest(string_split(block, chr(10))) AS line FROM m) SELECT line, count(*) AS n, line = {p.lit(_LINES[2])} AS figures FROM l GROUP BY line")
def _figures(s, d):
    line = p.spark_view(s, d, _BLOCKS).select(F.explode(F.split("block", "\n")).alias("line"))
    return line.groupBy("line").agg(F.count("*").alias("n")).withColumn("figures", titles.is_figure_line(F.col("line")))


_PAD = "'This page is shown to visitors who look for businesses, and has words enough to be no empty page at all.'"
PAGES = f"""SELECT o_orderkey AS seq, CASE o_orderkey % 8 WHEN 0 THEN 'too short' WHEN 1 THEN {_PAD} || {NL} || 'Access  Denied' WHEN 2 THEN {_PAD} || {NL} || 'Sorry, this listing is no longer available.'
 WHEN 3 THEN {_TITLE.format(k=_K)} || ' in Burnet, Texas - Alpha' || {NL} || {_PAD} || {NL} || 'Asking Price: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || {NL} || 'Cash Flow (SDE): Not Disclosed' || {NL} || 'Gross Revenue: $1,250,000.50' || {NL} || 'Gross Revenue: $2,500,000'
 WHEN 4 THEN {_PAD} || {NL} || 'Based in Tulsa, OK' || {NL} || 'Asking Price' || {NL} || '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || {NL} || 'EBITDA:' || {NL} || '$75,000'
 WHEN 5 THEN {_PAD} || ' Asking Price $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' and Cash Flow $80,000 per year'
 WHEN 6 THEN {_PAD} || {NL} || 'No figures here, in Denver, Colorado'
 ELSE {_PAD} || ' Asking Price: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' Cash Flow: $9' END AS body, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) AS price FROM {{orders}}"""


@query(
    "parse_page",
    f"""WITH m AS ({p.duck(PAGES)}) SELECT seq, seq % 8 IN (3, 4, 5, 7) AS ok, CASE seq % 8 WHEN 0 THEN 'empty page' WHEN 1 THEN 'blocked/challenge page' WHEN 2 THEN 'listing gone' WHEN 6 THEN 'no financials block' END AS error,
CASE WHEN seq % 8 IN (3, 4, 5, 7) THEN price END AS asking, CASE seq % 8 WHEN 5 THEN 80000.0::DOUBLE WHEN 7 THEN 9.0::DOUBLE END AS sde, CASE seq % 8 WHEN 4 THEN 75000.0::DOUBLE END AS ebitda, CASE seq % 8 WHEN 3 THEN 2500000.0::DOUBLE END AS revenue,
CASE seq % 8 WHEN 3 THEN 'Burnet' WHEN 4 THEN 'Tulsa' END AS city, CASE seq % 8 WHEN 3 THEN 'TX' WHEN 4 THEN 'OK' END AS state FROM m""",
)
def _pages(s, d):
    return p.spark_view(s, d, PAGES).select("seq", pages.parse_page(F.col("body"), "Alpha").alias("r")).select("seq", "r.*")


#: (subject, sender, body, files, kind, link, cue, number, file): mails of each kind, and near misses.
MAILS = (
    ('You signed: "NDA for Roofing Co"', "sign <echo@adobesign.com>", "done", "", "nda_signed", None, "NDA for Roofing Co", None, None),
    ("You signed: lease", "a@b.example", "no agreement", "", None, None, None, None, None),
    ('Signature requested on "NDA - Plumbing Co"', "x@docusign.net", "open https://eu.docusign.net/s/1 now", "", "nda_available", "https://eu.docusign.net/s/1", "NDA - Plumbing Co", None, None),
    ("Please look", "y@mail.hellosign.com", "your nda: https://a.example/sign/2", "", "nda_available", "https://a.example/sign/2", "Please look", None, None),
    ("Ann, attached is our CIM for Water Lab for your review.", "c@broker.example", "see file", "om.pdf;logo.png", "cim_received", None, "Water Lab", None, "om.pdf"),
    ("Materials", "c@broker.example", "as agreed", "Project CIM.docx", "cim_received", None, "Materials", None, "Project CIM.docx"),
    ("Our agreement", "c@broker.example", "the nda for deal #4455667 is attached", "NDA form.pdf", "nda_available", None, "Our agreement", "4455667", None),
    ("Sent NDA: Deal 778899", "c@broker.example", "via https://x.dropboxsign.com/q", "", "nda_available", "https://x.dropboxsign.com/q", "Deal 778899", "778899", None),
    ("Interest from alpha", "c@broker.example", "see https://a.example/p then https://a.example/nda", "", "nda_available", "https://a.example/nda", "Interest from alpha", None, None),
    ("Room", "c@broker.example", "You were granted access https://room.example/1", "", "vdr_access", "https://room.example/1", "Room", None, None),
    ("Hello", "n@beta.example", "You have a new message", "", "broker_message", None, "Hello", None, None),
    ("Hello", "n@other.example", "You have a new message", "", None, None, None, None, None),
    ("Schedule", "c@broker.example", "call on monday", "notes.pdf", None, None, None, None, None),
)
_MAIL = f"SELECT event_id, event_id % {len(MAILS)} AS k, " + ", ".join(f"{p.pick('event_id', [m[i] for m in MAILS])} AS {n}" for i, n in enumerate(("subject", "sender", "body", "files"))) + " FROM {events}"


@query("crm_classify", f"SELECT event_id, {', '.join(f'''{p.pick('event_id', [m[i] for m in MAILS])} AS {n}''' for i, n in ((4, 'kind'), (5, 'link'), (6, 'cue'), (7, 'number'), (8, 'file')))} FROM events")
def _kinds(s, d):
    m = p.spark_view(s, d, _MAIL)
    files = F.filter(F.split("files", ";"), lambda f: f != "")
    return m.select("event_id", events.classify(F.col("subject"), F.col("sender"), F.col("body"), files, market="alpha", network="beta.example").alias("r")).select("event_id", "r.*")


_MATCHED = f"SELECT event_id, {p.pick('event_id', ('alpha.digest', None, 'beta.control', 'summary'))} AS format_id, {p.pick('event_id * 3', ('daily_digest', 'account_notice', 'marketing', None, 'newsletter_marketing'))} AS email_type, {p.pick('user_id', ('active', 'control', None))} AS status, {p.pick('event_id', ('New Business Opportunities', 'your alert', 'hello'))} AS subject, {p.pick('user_id', ('x@alpha.example', 'y@beta.example'))} AS sender FROM {{events}}"


@query(
    "is_discovery",
    f"WITH m AS ({p.duck(_MATCHED)}) SELECT event_id, coalesce(format_id = 'alpha.digest', false) OR coalesce(email_type = 'daily_digest', false) OR (coalesce(status = 'control' AND email_type IN ('newsletter_marketing', 'account_notice'), false) AND coalesce(format_id, '') <> 'summary') OR subject = 'New Business Opportunities' OR (subject = 'your alert' AND sender = 'x@alpha.example') AS discovery FROM m",
)
def _discovery(s, d):
    c = F.col
    return p.spark_view(s, d, _MATCHED).select("event_id", events.is_discovery(c("format_id"), c("email_type"), c("status"), c("subject"), c("sender"), ("alpha.digest",), ("summary",), "alpha").alias("discovery"))


_ROUTED = f"SELECT event_id, {p.pick('event_id', ('cards', 'ruled', 'newsletter', None))} AS family, {p.pick('event_id * 3', ('drop', 'newsletter', 'single_offer', None, 'cards'))} AS split, {p.pick('user_id', ('active', 'Control', None))} AS status, {p.pick('event_id', ('listing_digest', 'account_notice', None))} AS email_type, {p.pick('user_id', ('x@alpha.example', 'newopps@alpha.example'))} AS address FROM {{events}}"


@query(
    "splitter_of",
    f"WITH m AS ({p.duck(_ROUTED)}) SELECT event_id, CASE WHEN coalesce(split = 'drop', false) OR coalesce(status = 'Control', false) OR coalesce(email_type = 'account_notice', false) THEN 'none' WHEN coalesce(split = 'single_offer', false) OR starts_with(address, 'newopps') THEN 'single' WHEN family IN ('cards', 'ruled') THEN family ELSE 'newsletter' END AS splitter FROM m",
)
def _routed(s, d):
    return p.spark_view(s, d, _ROUTED).select("event_id", splitters.splitter_of(*[F.col(c) for c in ("family", "split", "status", "email_type", "address")]).alias("splitter"))


@query(
    "drop_control_mail",
    f"WITH m AS ({p.duck(ALERTS)}), c AS ({_LISTS.replace('WITH m AS', 'WITH mm AS').replace('FROM m)', 'FROM mm)')}) SELECT seq, count(*) AS blocks FROM c WHERE seq % 3 <> 0 GROUP BY seq",
)
def _control(s, d):
    said = {"family": "cards", "split": "cards", "email_type": "listing_digest", "address": "x@alpha.example", "subject": "s", "msg_id": "m"}
    m = p.spark_view(s, d, ALERTS).withColumns({k: F.lit(v) for k, v in said.items()} | {"status": F.when(F.col("seq") % 3 == 0, "control").otherwise("active")})
    return splitters.split_by_format(m).groupBy("seq").agg(F.count("*").alias("blocks"))


_SURVEYED = f"SELECT event_id AS seq, {p.pick('user_id', ('alpha.example', 'beta.example', None))} AS source, {p.pick('user_id', ('x@alpha.example', 'y@beta.example', None, ''))} AS sub_source, {p.pick('user_id', ('Alpha', 'Beta'))} AS nickname, {p.pick('event_id', (0, 2, None, 5))} AS kept_listings, {p.pick('event_id', (None, 'alpha.digest', 'beta.x'))} AS format_id, {p.pick('event_id', ('s1', None, ''))} AS subcategory, {p.pick('event_id * 3 + user_id', ('control', 'active', 'needs_parser'))} AS status, CASE WHEN event_id % 7 <> 0 THEN 'subject ' || CAST(event_id AS STRING) ELSE '' END AS subject, 'open ' || CAST(event_id AS STRING) AS opening FROM {{events}}"


@query(
    "survey_counts",
    f"WITH m AS ({p.duck(_SURVEYED)}), l AS (SELECT 'domain' AS kind, coalesce(source, '') AS value, kept_listings FROM m UNION ALL SELECT 'email', coalesce(sub_source, ''), kept_listings FROM m UNION ALL SELECT 'nickname', nickname, kept_listings FROM m UNION ALL SELECT 'all', '', kept_listings FROM m) SELECT kind, value, count(*) AS messages, count(*) FILTER (coalesce(kept_listings, 0) = 0) AS zero FROM l GROUP BY 1, 2",
)
def _survey(s, d):
    return survey.survey_counts(p.spark_view(s, d, _SURVEYED))


@query(
    "classified_counts",
    f"""WITH m AS ({p.duck(_SURVEYED)}) SELECT 'subcategory' AS what, CASE WHEN coalesce(subcategory, '') = '' THEN '(none)' ELSE subcategory END AS value, count(*) AS n FROM m WHERE format_id IS NOT NULL GROUP BY 2
UNION ALL SELECT 'format', coalesce(format_id, '(unmatched)'), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'unmatched', '', count(*) FROM m WHERE format_id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'needs_parser', '', count(*) FROM m WHERE status = 'needs_parser' HAVING count(*) > 0 UNION ALL SELECT 'bad_control', '', count(*) FROM m WHERE status = 'control' AND kept_listings > 0 HAVING count(*) > 0""",
)
def _classified(s, d):
    return survey.classified_counts(p.spark_view(s, d, _SURVEYED))


@query(
    "format_proposals",
    f"""WITH m AS ({p.duck(_SURVEYED)}), u AS (SELECT *, lower(coalesce(nullif(sub_source, ''), nullif(source, ''), 'unknown')) AS mailbox FROM m WHERE format_id IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY seq) AS n FROM u)
SELECT mailbox, count(*) AS messages, coalesce(string_agg(subject, '|' ORDER BY n) FILTER (n <= 5 AND subject <> ''), '') AS subjects, string_agg(opening, '|' ORDER BY n) FILTER (n <= 3) AS openings,
CASE arg_min(coalesce(sub_source, ''), n) WHEN 'x@alpha.example' THEN 'x_alpha_example' WHEN 'y@beta.example' THEN 'y_beta_example' ELSE 'any' END AS subcategory FROM r GROUP BY mailbox""",
)
def _proposals(s, d):
    q = survey.proposals(p.spark_view(s, d, _SURVEYED))
    return q.select("mailbox", "messages", F.array_join("subjects", "|").alias("subjects"), F.array_join("openings", "|").alias("openings"), F.col("draft.subcategory").alias("subcategory"))


@query("stub_proposal", "SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'alpha.x_alpha_example' WHEN 1 THEN 'beta.any' ELSE 'unknown.any' END AS id, CASE user_id % 3 WHEN 0 THEN 'x@alpha.example' WHEN 1 THEN '*@mail.beta.example' ELSE 'unknown' END AS sub_source, CASE user_id % 3 WHEN 0 THEN 'alpha.example' WHEN 1 THEN 'mail.beta.example' ELSE 'unknown' END AS source FROM events")
def _stub(s, d):
    m = p.spark_view(s, d, f"SELECT DISTINCT {p.pick('user_id', ('alpha.example', 'mail.beta.example', ''))} AS domain, {p.pick('user_id', ('x@alpha.example', None, ''))} AS address FROM {{events}}")
    return m.select(survey.stub(F.col("domain"), F.col("address")).alias("s")).select("s.id", "s.sub_source", "s.source")


_HTML = f"SELECT event_id, '<html><style>p {{}}</style><p>Dear ' || CAST(user_id AS STRING) || '&nbsp;&amp; co<br>second</p><ul><li>one<li>two</ul><a href=\"https://a.example/' || CAST(event_id AS STRING) || '\">look</a><!-- no --><script>x()</script>' AS html FROM {{events}}".replace("{}", "")


@query("strip_html", "SELECT event_id, 'Dear ' || CAST(user_id AS STRING) || ' & co' || chr(10) || 'second' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || 'look (https://a.example/' || CAST(event_id AS STRING) || ')' AS text FROM events")
def _html(s, d):
    return p.spark_view(s, d, _HTML).select("event_id", text.strip_html(F.col("html")).alias("text"))


def nested_messages(b64: str) -> str:
    """Messages whose parts are nested as deep as their conversation's number says, as JSON; ``b64`` is how an engine writes base64 of {}."""
    leaf = lambda mime, text: f"""'{{{{"mimeType":"{mime}","body":{{{{"data":"' || {b64.format(text)} || '"}}}}}}}}'"""
    inner = " || ',' || ".join([leaf("TEXT/html", "'<p>' || coalesce(text, '') || '</p>'"), "CASE WHEN turn % 3 = 0 THEN '{{\"mimeType\":\"image/png\",\"filename\":\"a.png\",\"body\":{{\"size\":7}}}}' ELSE " + leaf("text/plain", "coalesce(text, '')") + " END"])
    later = leaf("text/plain", "'later'")
    opened = """'{{"mimeType":"multipart/mixed","parts":['"""
    return f"SELECT conv_id * 1000 + turn AS id, {opened} || repeat({opened}, CAST(conv_id % 9 AS INT)) || {inner} || repeat(']}}}},' || {later}, CAST(conv_id % 9 AS INT)) || ']}}}}' AS payload FROM {{conversations}}"


@query(
    "mime_walk",
    f"""WITH RECURSIVE m AS ({nested_messages("to_base64(encode({}))").format(conversations="conversations")}), w AS (
  SELECT id, []::BIGINT[] AS path, payload::JSON AS part FROM m
  UNION ALL SELECT id, list_append(path, i), part->'parts'->(i::INT) FROM (SELECT id, path, part, unnest(range(json_array_length(part->'parts')::BIGINT)) AS i FROM w)
), t AS (SELECT id, path, lower(part->>'mimeType') AS mime, part->'body'->>'data' AS data FROM w)
SELECT id, decode(from_base64(arg_min(data, path) FILTER (mime = 'text/plain' AND data <> ''))) AS plain, decode(from_base64(arg_min(data, path) FILTER (mime = 'text/html' AND data <> ''))) AS html, count(*) AS parts, max(len(path))::BIGINT AS depth FROM t GROUP BY id""",
)
def _walk(s, d):
    m = p.spark_view(s, d, nested_messages("replace(replace(base64(encode({}, 'UTF-8')), chr(13), ''), chr(10), '')")).select("id", F.parse_json("payload").alias("payload"))
    parts = readers.walk_parts(m)
    sizes = parts.groupBy("id").agg(F.count("*").alias("parts"), F.max(F.size("path")).cast("long").alias("depth"))
    return readers.first_texts(parts).join(sizes, "id")


#: A catalog with entries for each supplier and messages from customers whose senders lie under them, beside them and elsewhere.
_ENTRIES = """
SELECT 0 AS step, s_suppkey AS place, 'address' AS match, 'alerts@s' || CAST(s_suppkey AS STRING) || '.example' AS key, 'Box ' || CAST(s_suppkey AS STRING) AS label, 'm' || CAST(s_suppkey AS STRING) AS subcategory FROM {supplier} WHERE s_suppkey % 4 = 0
UNION ALL SELECT 1, s_suppkey, 'under', 'mail.s' || CAST(s_suppkey AS STRING) || '.example', 'Mail ' || CAST(s_suppkey AS STRING), 'w' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 5 = 0
UNION ALL SELECT 1, s_suppkey, 'domain', 's' || CAST(s_suppkey AS STRING) || '.example', 'Own ' || CAST(s_suppkey AS STRING), 'd' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 7 = 0
UNION ALL SELECT 2, 2 * s_suppkey + 1, 'under', 's' || CAST(s_suppkey AS STRING) || '.example', 'Supplier ' || CAST(s_suppkey AS STRING), NULL FROM {supplier}
UNION ALL SELECT 2, 2 * s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 END, 'under', 'eu.s' || CAST(s_suppkey AS STRING) || '.example', 'Europe ' || CAST(s_suppkey AS STRING), NULL FROM {supplier} WHERE s_suppkey % 3 = 0
UNION ALL SELECT 3, s_suppkey, 'address', 'news@x' || CAST(s_suppkey AS STRING) || '.other', 'News ' || CAST(s_suppkey AS STRING), NULL FROM {supplier}
UNION ALL SELECT 4, s_suppkey, 'under', 'x' || CAST(s_suppkey AS STRING) || '.other', 'Format ' || CAST(s_suppkey AS STRING), NULL FROM {supplier} WHERE s_suppkey % 2 = 0
"""
_SENT = f"SELECT o_orderkey AS id, {p.pick('o_orderkey', ('alerts', 'news', 'me'))} || '@' || {p.pick('CAST(floor(o_orderkey / 3) AS BIGINT)', ('', 'mail.', 'eu.', 'a.b.', 'not'))} || {p.pick('o_custkey', ('s', 'x'))} || CAST(o_custkey % 1500 AS STRING) || CASE o_custkey % 2 WHEN 0 THEN '.example' ELSE '.other' END AS address FROM {{orders}}"


@query(
    "sender_catalog",
    f"WITH e AS ({p.duck(_ENTRIES)}), m AS ({p.duck(_SENT)}), a AS (SELECT DISTINCT address, split_part(address, '@', 2) AS domain FROM m), f AS (SELECT a.address, e.label, e.subcategory FROM a JOIN e ON (e.match = 'address' AND e.key = a.address) OR (e.match = 'domain' AND e.key = a.domain) OR (e.match = 'under' AND (a.domain = e.key OR ends_with(a.domain, '.' || e.key))) QUALIFY row_number() OVER (PARTITION BY a.address ORDER BY e.step, e.place, e.key) = 1) SELECT m.id, CASE WHEN f.label IS NOT NULL THEN f.label WHEN contains(m.address, 'x7') THEN 'Seven' ELSE upper(left(split_part(split_part(m.address, '@', 2), '.', -2), 1)) || substr(split_part(split_part(m.address, '@', 2), '.', -2), 2) END AS nickname, f.subcategory FROM m LEFT JOIN f ON f.address = m.address",
)
def _catalog(s, d):
    m = p.spark_view(s, d, _SENT).withColumns({"domain": F.substring_index("address", "@", -1), "hay": F.lit("")})
    return senders.label_senders(m, p.spark_view(s, d, _ENTRIES), ((r"x7", "Seven"),)).select("id", "nickname", "subcategory")
