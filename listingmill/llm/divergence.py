"""How far the sources of a language diverge from each other, and by which terms.

Plain relational: terms are exploded regexp matches, counted by group; each group of a language is
crossed with the terms the language keeps, so absent ones count zero; the smoothed shares meet in a
self-join on language and term, are summed, and ranked in windows. Shares are whole numbers of
billionths and every step is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmill.llm import common
from listingmill.llm.common import materialize

#: Runs of letters: ASCII ones, and every character beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in; ranks of the terms reported; units of a share.
MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Pieces into which a long list of groups and the terms they meet are cut, so that no language is one task.
SALTS = 64


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    text = F.translate(F.coalesce(docs[text_col], F.lit("")), UPPER, LOWER)
    rows = docs.select(*_group(docs, lang_col, source_col), F.sort_array(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
    # sorted, an occurrence is the document's first one where it differs from its forerunner
    cells = rows.select("lang", "source", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit("")), "terms").alias("before"))).alias("cell"))
    cells = cells.select("lang", "source", F.col("cell.term").alias("term"), (F.col("cell.term") != F.col("cell.before")).cast("long").alias("first")).where("term IS NOT NULL")
    return cells.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def _group(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(docs[c], F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def _meet(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Join rows that have a term with a written list of groups or languages: broadcast if counted short, else both are salted."""
    if side.count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(side), on)
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / total) in decimals wide enough for any count."""
    return F.expr(f"1L + CAST(CAST({UNIT}L AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0)) div CAST({total} AS DECIMAL(19, 0)) AS BIGINT)")


#: floor((p - q)^2 / q): both shares are at most UNIT + 1, so the square fits in a long.
_GAP = "(p - q) * (p - q) div q"


def groups_and_shares(docs: DataFrame, min_docs: int = MIN_DOCS, **cols: str) -> tuple[DataFrame, DataFrame]:
    """The groups (g, lang, source), and g, t, term, count, p, q of every kept term in every group of its language.

    ``t`` numbers the pairs of language and term, ``g`` the groups; ``p`` is the share in the group, ``q`` in the language.
    """
    counts = materialize(term_counts(docs, **cols), "term-counts")
    # a list holds a number for each source of the language at most
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("of_source"))
    vocabulary = by_lang.where(F.col("docs") >= min_docs).select(F.monotonically_increasing_id().alias("t"), "lang", "term", "n", "of_source")
    vocabulary = materialize(vocabulary, "vocabulary")
    totals = materialize(vocabulary.groupBy("lang").agg((F.sum("n") + F.count("*")).alias("total"), F.count("*").alias("v")), "lang-totals")
    own = vocabulary.select("lang", F.explode("of_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = docs.select(*_group(docs, cols.get("lang_col", "lang"), cols.get("source_col", "source"))).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(totals.select("lang", "v"), "lang", "left")
    total = F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))
    groups = materialize(groups.select(F.monotonically_increasing_id().alias("g"), "lang", "source", total.alias("total")), "groups")
    kept = _meet(vocabulary, totals.select("lang", "total"), ["lang"]).select("t", "lang", "term", "of_source", _share("n", "total").alias("q"))
    dense = _meet(kept, groups.where("total > 0"), ["lang"]).withColumn("count", F.coalesce(F.col("of_source")[F.col("source")], F.lit(0)))
    return groups, materialize(dense.select("g", "t", "term", "count", _share("count", "total").alias("p"), "q"), "shares")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: by part ``pair`` every other source of the language with its
    divergence from this one, by part ``term`` the ``top`` terms that set the group most apart from its language.

    Defined cases: null text, lang and source are ''; a document without terms still makes its group; a language
    that keeps no term has pairs of value 0; equal values are ranked by the item's UTF-8 bytes; repeated rows are
    documents of their own; other columns, of any name, are not read; an empty table gives an empty result.
    """
    groups, cells = groups_and_shares(docs, min_docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    other = cells.select("t", F.col("g").alias("other"), F.col("p").alias("q"))
    met = cells.select("t", "g", "p").join(other, "t").where("g <> other")
    sums = met.groupBy("g", "other").agg(F.sum(F.expr(_GAP)).alias("value"))
    pairs = groups.select("g", "lang", "source").join(groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), "lang").where("g <> other").join(sums, ["g", "other"], "left")
    pairs = pairs.select("g", "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
    # a limit on the rank is taken in every task before the shuffle, so a large group does not come together
    terms = cells.where("count > 0 AND p > q").select("g", F.col("term").alias("item"), F.expr(_GAP).alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    terms = terms.join(groups.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", rank).select("lang", "source", "part", "item", "value", "rank").unionByName(terms)
