"""Text of a listing's page to its figures and place.

A page is cut before each label of a figure; each piece is read once, as label, separator and value, with how
well it is set (on its line, below it, anywhere). Places are read off the two sides of commas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingmill.functions import places
from listingmill.functions.money import plain_amount

# What a page that shows no listing says, the labels of figures, the states whose names are looked for.
BLOCKED = r"(?i)access\s+denied|akamai|attention\s+required|cf-browser|captcha"
GONE = r"(?i)listing (?:is )?(?:no longer|not) available|page not found"
LABELS = {"asking": r"asking\s+price", "sde": r"cash\s+flow(?:\s*\(sde\))?", "ebitda": "ebitda", "revenue": r"gross\s+revenue"}
PAGE_STATES = ("TX", "CA", "FL", "NY", "AZ", "CO", "GA", "IL", "NC", "OK", "LA", "AR", "WA", "OR", "NV", "TN", "VA", "MD", "PA", "OH", "MI", "MN", "WI", "MO", "IN", "AL", "MS", "SC", "KY", "UT", "NM", "CT", "MA", "NJ")
SHORTEST, HEAD, TITLE_CHARS = 80, 800, (10, 160)

PLACE_CHARS = r"[A-Za-z .'-]+"


def page_error(text: Column) -> Column:
    """Why a page has no listing: empty, blocked or gone; null if it may have one."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) < SHORTEST, "empty page").when(t.rlike(BLOCKED), "blocked/challenge page").when(t.rlike(GONE), "listing gone")


_LABEL = "(?i)(?:" + "|".join(LABELS.values()) + ")"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value found once."""
    return F.transform(F.array(value), use)[0]


def _read_piece(piece: Column, before: Column, after: Column) -> Column:
    """A piece that begins with a label, between its neighbours: (field, value, rank). Rank 1: behind the label on its line; 2: alone on the next; 3: anywhere behind it; null: no value."""
    def split(low: Column) -> Column:
        label = F.regexp_extract(low, "^" + _LABEL, 0)
        return F.struct(label.alias("label"), F.substring(low, F.length(label) + 1, 1 << 30).alias("rest"))

    def cut(x: Column) -> Column:
        m = lambda i: F.regexp_extract(x["rest"], r"^(\s*:)?(\s*)(not\s+disclosed|\$[\d,]+(?:\.\d+)?)(.*)", i)
        return F.struct(x["label"].alias("label"), (m(1) != "").alias("colon"), F.contains(m(2), F.lit("\n")).alias("below"), m(3).alias("value"), F.substring(x["rest"], F.length(m(1)) + F.length(m(2)) + F.length(m(3)) + 1, 1 << 30).alias("tail"))

    def ranked(x: Column) -> Column:
        # a label with a colon begins a line of its own, wherever it stands
        opens = x["colon"] | (F.trim(F.substring_index(before, "\n", -1), F.lit(" \t")) == "")
        ends = (F.trim(F.substring_index(x["tail"], "\n", 1), F.lit(" \t")) == "") & (F.contains(x["tail"], F.lit("\n")) | (after == "") | after.rlike("^" + _LABEL + r"\s*:"))
        rank = F.when(x["value"] == "", None).when(x["colon"] & ~x["below"] & ends, 1).when(x["below"] & opens & ends, 2).otherwise(3)
        field = F.coalesce(*[F.when(x["label"].rlike(f"^(?:{p})$"), f) for f, p in LABELS.items()])
        return F.struct(field.alias("field"), x["value"].alias("value"), rank.alias("rank"))

    return _let(_let(_let(F.lower(piece), split), cut), ranked)


def page_figures(text: Column) -> Column:
    """asking, sde, ebitda, revenue of a page, and whether any label was found.

    Of the values only those of the best rank that the page has count: where some stand on their label's line,
    others are not looked at. Of a label that repeats the last counts.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    def read(pieces: Column) -> Column:
        at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        return F.filter(F.transform(pieces, lambda p, i: _read_piece(p, at(i - 1), at(i + 1))), lambda x: x["field"].isNotNull() & x["rank"].isNotNull())

    def taken(y: Column) -> Column:
        all_, best = y["all"], y["best"]
        value = lambda f: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(all_, lambda x: (x["rank"] == best) & (x["field"] == f)), lambda x: x["value"])), -1)
        return F.struct(*[plain_amount(value(f)).alias(f) for f in LABELS], best.isNotNull().alias("found"))

    found = _let(F.split(t, f"(?={_LABEL})"), read)
    ranked = _let(found, lambda all_: F.struct(all_.alias("all"), F.array_min(F.transform(all_, lambda x: x["rank"])).alias("best")))
    return _let(ranked, taken)


def _state_code(name: Column) -> Column:
    """The code of a state's name, or of two letters."""
    known = F.create_map(*[F.lit(x) for c in PAGE_STATES for x in (places.STATE_NAMES[c], c)])
    word = F.trim(name)
    return F.coalesce(F.element_at(known, F.lower(word)), F.when(F.length(word) == 2, F.upper(word)))


def _state_ahead(text: Column) -> Column:
    """The code of the state that a text begins with, by its name in any case or its code in capitals."""
    words = F.split(F.regexp_replace(text, r"^\s+", ""), r"\W+", 3)
    first, two = F.get(words, F.lit(0)), F.array_join(F.slice(words, 1, 2), " ")
    named = lambda w: F.when(F.length(w) > 2, _state_code(w))
    return F.coalesce(named(two), named(first), F.when(first.isin(*places.STATES), first))


def _titled(text: Column, site: str) -> Column:
    """(city, state) of the first line "... in City, State - site", nulls without one."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"\s+$", ""))

    def read(line: Column) -> Column:
        said = F.regexp_replace(F.substring(line, F.lit(1), F.length(line) - len(site)), r"[\s-]+$", "")
        state = F.substring_index(said, ",", -1)
        runs = F.split(F.substring(said, F.lit(1), F.length(said) - F.length(state) - 1), r"(?i)\s+in\s+")
        # the city begins behind the first "in" with enough before it, and has nothing but a place's characters from there on
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(runs) - 1, F.lit(1))), lambda k: (k < F.size(runs)) & (F.length(F.array_join(F.slice(runs, 1, k), " in ")).between(*TITLE_CHARS)) & F.array_join(F.slice(runs, k + 1, F.size(runs)), " in ").rlike(f"^{PLACE_CHARS}$"))
        city = F.array_join(F.slice(runs, F.array_min(starts) + 1, F.size(runs)), " in ")
        fits = F.endswith(F.lower(line), F.lit(site.lower())) & F.regexp_replace(F.substring(line, F.lit(1), F.length(line) - len(site)), r"\s+$", "").endswith("-") & state.rlike("^[A-Za-z ]+$")
        return F.when(fits & (F.size(starts) > 0), F.struct(F.trim(city).alias("city"), _state_code(state).alias("state")))

    return F.get(F.filter(F.transform(lines, read), lambda x: x.isNotNull()), F.lit(0))


def _paired(text: Column) -> Column:
    """(city, state) around the first comma with a place's characters before it and a state behind it."""
    sides = F.split(text, ",")
    pairs = F.transform(sides, lambda right, i: F.struct(F.regexp_extract(F.when(i > 0, F.get(sides, i - 1)), PLACE_CHARS + "$", 0).alias("city"), _state_ahead(right).alias("state")))
    pair = F.get(F.filter(pairs, lambda x: (F.coalesce(x["city"], F.lit("")) != "") & x["state"].isNotNull()), F.lit(0))
    return F.struct(F.nullif(F.trim(F.regexp_replace(pair["city"], r"(?i)^.*\bin\s+", "")), F.lit("")).alias("city"), pair["state"].alias("state"))


def page_place(text: Column, site: str) -> Column:
    """City and state: of a title line "... in City, State - site", else of the first such pair in the page's head."""
    t = F.coalesce(text, F.lit(""))
    both = F.array(F.struct(_titled(t, site).alias("line"), _paired(F.substring(t, 1, HEAD)).alias("head")))
    return F.transform(both, lambda x: F.when(x["line"].isNotNull(), x["line"]).otherwise(x["head"]))[0]


def parse_page(text: Column, site: str) -> Column:
    """ok, error, asking, sde, ebitda, revenue, city, state of a listing's page."""
    made = F.struct(page_error(text).alias("error"), page_figures(text).alias("fig"), page_place(text, site).alias("place"))

    def result(m: Column) -> Column:
        why = F.coalesce(m["error"], F.when(~m["fig"]["found"], "no financials block"))
        found = [(k, m["fig"][k]) for k in LABELS] + [(k, m["place"][k]) for k in ("city", "state")]
        return F.struct(why.isNull().alias("ok"), why.alias("error"), *[F.when(why.isNull(), c).alias(k) for k, c in found])

    return F.transform(F.array(made), result)[0]
