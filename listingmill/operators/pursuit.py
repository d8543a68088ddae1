"""The second lane: broker mail becomes events, and events meet deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_STAGES = ("inbox", "shortlist", "contacted", "nda", "cim", "call", "loi", "diligence", "offer")
_STOP = ("the", "and", "for", "your", "with", "from")


def title_tokens(text: Column) -> Column:
    """Words of over two characters that are no stop words, each once."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s#]", " "), r"\s+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*_STOP)))


def title_token_score(cue: Column, title: Column) -> Column:
    """Share of the cue's words that the title has."""
    a, b = title_tokens(cue), title_tokens(title)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def classify_event(subject: Column, body: Column, has_file: Column) -> Column:
    """The kind of a broker's mail; the first rule that holds decides, null for none."""
    s = F.lower(F.coalesce(subject, F.lit("")))
    t = F.concat_ws(" ", s, F.lower(F.coalesce(body, F.lit(""))))
    return (
        F.when(s.rlike(r"you signed|signed nda|completed:.*(?:nda|confidential)"), "nda_signed")
        .when(has_file & t.rlike(r"\b(?:cim|om|memorandum|offering memo)\b"), "cim_received")
        .when(t.rlike(r"signature requested|please sign|nda (?:is )?(?:available|attached)|sent nda|confidentiality agreement"), "nda_available")
        .when(t.rlike(r"\bacted on\b|expressed interest|request(?:ed)? (?:more )?information"), "interest_logged")
        .when(t.rlike(r"schedule|calendar|call (?:on|at)|meeting"), "call_request")
    )


def deal_number(text: Column) -> Column:
    """The number that names a deal: five or more digits after "deal", or six or more after "#"."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\bdeal\s*#?\s*(\d{5,})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?:^|\W)#(\d{6,})\b", 1), F.lit("")))


def title_cue(subject: Column) -> Column:
    """What a subject says of the deal's title, without the phrases around it."""
    acted = F.trim(F.regexp_extract(subject, r"(?i)acted on\s+(.+)$", 1))
    s = F.coalesce(subject, F.lit(""))
    for p in (r"(?i)^re:\s*", r"(?i)^\[external\]\s*", r"(?i)^sent nda:\s*", r"""(?i)^signature requested on\s*["']?""", r"""(?i)^you signed:\s*["']?""", r"(?i)\s*for your review\.?$", r"""["']"""):
        s = F.regexp_replace(s, p, "")
    return F.when(acted != "", acted).otherwise(F.trim(s))


def match_events(events: DataFrame, deals: DataFrame, least: float = 0.45, candidates: int = 2000) -> DataFrame:
    """(event_id, deal_id, score, how): a deal by its number, else by the words of its title.

    ``deals`` are the open ones last seen, at most ``candidates`` (the operator's own top-k). Titles meet
    cues through shared words, not all pairs. No side is marked for broadcast: Spark takes
    one where it finds it small.
    """
    d = deals.where(F.col("stage").isin(*OPEN_STAGES)).orderBy(F.desc("last_seen"), "id").limit(candidates)
    d = d.select("id", "title", F.concat_ws(" ", "url", "ext_id", "title").alias("hay"), F.struct((-F.unix_seconds("last_seen")).alias("age"), F.col("id").alias("tie")).alias("place"))
    e = events.withColumn("number", deal_number(F.concat_ws(" ", "subject", "body"))).withColumn("cue", title_cue(F.col("subject")))
    digits = d.select("id", "place", F.explode(F.array_distinct(F.regexp_extract_all("hay", F.lit(r"(\d{5,})"), 1))).alias("run"))
    # a number may be part of a longer run of digits, so each run is indexed under all parts of five digits
    grams = digits.select("id", "place", "run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 4), lambda i: F.substring("run", i, 5)))).alias("gram"))
    numbered = e.where("number IS NOT NULL").select("number", F.substring("number", 1, 5).alias("gram")).distinct()
    by_number = numbered.join(grams, "gram").where(F.contains("run", F.col("number"))).groupBy("number").agg(F.min_by("id", "place").alias("number_id"))
    words = d.select("id", "place", F.explode(title_tokens(F.col("title"))).alias("word"))
    # events repeat their cues: each different one is scored once, and only cues and titles that share a word meet
    cues = e.where(F.length("cue") >= 6).select("cue").distinct().withColumn("words", title_tokens(F.col("cue")))
    met = cues.select("cue", F.size("words").alias("n"), F.explode("words").alias("word")).join(words, "word")
    hits = met.groupBy("cue", "id").agg((F.count("*") / F.first("n")).alias("score"), F.first("place").alias("place"))
    best = F.max(F.struct("score", (-F.col("place.age")).alias("recent"), (-F.col("id")).alias("tie"), "id")).alias("best")
    by_title = hits.where(F.col("score") >= least).groupBy("cue").agg(best).select("cue", F.col("best.id").alias("title_id"), F.col("best.score").alias("title_score"))
    j = e.select("event_id", "number", "cue").join(by_number, "number", "left").join(by_title, "cue", "left")
    by = F.col("number_id").isNotNull()
    return j.select("event_id", F.coalesce("number_id", "title_id").alias("deal_id"), F.when(by, 1.0).otherwise(F.col("title_score")).alias("score"), F.when(by, "number").when(F.col("title_id").isNotNull(), "title").otherwise("unmatched").alias("how"))
