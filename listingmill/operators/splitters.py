"""Splitters of three providers' mail, and the choice among all splitters for a message.

Bodies come with any line ends and empty lines; all work here is on their trimmed, non-empty
lines, in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.operators import listings

# Phrases of the providers' mail.
FRANCHISE_SECTION = r"(?is)following\s+franchises.{0,120}?match your search criteria"
FRANCHISE_PLACE = r"(?i)available in a location near you"
CHROME_TITLE = r"(?i)businesses recently posted|search criteria|search all business"
SUMMARY_MARK = r"(?i)\b(?:Business Summary|View details|View complete details|Please Contact)\b"
HEADLINE_LINK = "utm_content=headline"
DROPPED_TYPES = ("newsletter_marketing", "account_notice")

_LINK = r"(?i)^<?https?://\S+>?$"
_ASKING, _PLACE = r"(?i)^asking price:\s*", r"(?i)^location:\s*"


def lines_of(body: Column) -> Column:
    """Trimmed lines that hold something; a link in brackets at the end of a line stands on a line of its own."""
    apart = F.regexp_replace(F.coalesce(body, F.lit("")), r"[ \t]*\((https?://[^\s)]+)\)[ \t]*(?=\r|\n|$)", "\n$1\n")
    trimmed = F.transform(F.split(apart, r"[\r\n]+"), lambda s: F.regexp_replace(s, r"^[\s ]+|[\s ]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def without_franchises(body: Column) -> Column:
    """The body up to the section of franchises."""
    return F.get(F.split(F.coalesce(body, F.lit("")), FRANCHISE_SECTION, 2), F.lit(0))


def _value(lines: Column, i: Column, label: str) -> Column:
    """What stands behind a label on line ``i``, or on the next line if the label stands alone."""
    own = F.regexp_replace(F.get(lines, i), label, "")
    return F.when(own != "", own).otherwise(F.coalesce(F.get(lines, i + 1), F.lit("")))


def alert_cards(body: Column, listing_path: str = "/listings/") -> Column:
    """Blocks of an alert whose cards have a title, an asking price and a place, in one of two layouts.

    A card needs an amount in its price; cards of franchises, headings of the mail and pieces of
    words in lower case are no titles.
    """
    lines = lines_of(without_franchises(body))

    def cards(ls: Column) -> Column:
        at = F.filter(F.transform(ls, lambda s, i: F.when(s.rlike(_ASKING), i)), lambda i: i.isNotNull())

        def card(i: Column) -> Column:
            price = _value(ls, i, _ASKING)
            after = F.when(F.regexp_replace(F.get(ls, i), _ASKING, "") != "", i + 1).otherwise(i + 2)
            before = F.filter(F.slice(ls, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))), lambda s: ~s.rlike(_LINK))
            links = F.filter(F.slice(ls, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))), lambda s: s.rlike(_LINK) & F.contains(s, F.lit(listing_path)))
            title = F.coalesce(F.element_at(before, -1), F.lit(""))
            place = F.when(F.coalesce(F.get(ls, after), F.lit("")).rlike(_PLACE), _value(ls, after, _PLACE)).otherwise("")
            good = (price.contains("$")) & (place != "") & ~place.rlike(FRANCHISE_PLACE) & (F.length(title) >= 5) & ~title.rlike(CHROME_TITLE) & ~((F.length(title) < 20) & title.rlike("^[a-z]"))
            link = F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), links), -1), "[<>]", "")
            return F.when(good, F.concat_ws("\n", title, F.concat(F.lit("Asking Price: "), price), F.concat(F.lit("Location: "), place), F.when(link != "", link)))

        return F.filter(F.transform(at, card), lambda b: b.isNotNull())

    return F.transform(F.array(lines), cards)[0]


def single_offer(body: Column, listing_path: str = "/listings/") -> Column:
    """The one block of a mail about one business, or none: its place stands in a linked line and its name is a linked headline.

    Prose from the summary on is left out, so no figure in it is read.
    """
    whole = without_franchises(body)
    head = F.get(F.split(whole, SUMMARY_MARK, 2), F.lit(0))
    priced = r"(?i)Asking Price:\s*\$?[\d,]+"
    work = F.when(head.rlike(priced), head).otherwise(F.regexp_extract(whole, r"(?is)^(.*?Asking Price:\s*\$?[\d,]+)", 1))
    price = F.regexp_extract(work, r"(?i)Asking Price:\s*\$?([\d,]+)", 1)
    place_line = rf"(?im)^[ \t]*([a-z0-9 .,'\-]+?)[ \t]*(?:\([^)]*\))?:[ \t]*\((https?://[^)\s]*{listing_path}[^)\s]*)\)"
    name_line = rf"(?im)^[ \t]*([^\r\n(]{{8,300}}?)[ \t]*\((https?://[^)\s]*{listing_path}[^)\s]*{HEADLINE_LINK}[^)\s]*)\)"
    place, place_link = F.trim(F.regexp_extract(work, place_line, 1)), F.regexp_extract(work, place_line, 2)
    name, name_link = F.trim(F.regexp_extract(work, name_line, 1)), F.regexp_extract(work, name_line, 2)
    others = F.filter(lines_of(work), lambda s: ~s.rlike(_LINK) & ~s.startswith("(") & ~s.rlike(r"(?i)^(?:asking price|view )") & ~s.rlike(r"(?i)\(https?://") & ~s.endswith(":"))
    title = F.when(name != "", name).otherwise(F.coalesce(F.get(others, F.lit(0)), F.lit("")))
    between = F.regexp_extract(work, rf"(?is){HEADLINE_LINK}[^)]*\)(.*?)Asking Price:", 1)
    blurb = F.array_join(F.slice(F.filter(lines_of(between), lambda s: ~s.rlike(_LINK) & ~s.rlike(r"(?i)^view ")), 1, 2), " ")
    link = F.when(name_link != "", name_link).when(place_link != "", place_link)
    block = F.concat_ws("\n", title, F.concat(F.lit("Asking Price: $"), price), F.when(place != "", F.concat(F.lit("Location: "), place)), link, F.when((name != "") & (blurb != ""), blurb))
    return F.when((price != "") & (title != ""), F.array(block)).otherwise(F.array().cast("array<string>"))


def ruled_parts(body: Column) -> Column:
    """Parts between rules or numbers that hold over 80 characters and an amount; notices without figures give none."""
    parts = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n?", "\n"), r"\n\s*(?:-{3,}|={3,}|\d+\.\s)")
    return F.filter(parts, lambda s: (F.length(F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))) > 80) & s.rlike(listings.MONEY))


def splitter_of(family: Column, split: Column, status: Column, email_type: Column, address: Column, single_from: str = "newopps@") -> Column:
    """Which splitter a message takes: none, single, cards, ruled or newsletter.

    Mail declared to list nothing takes none. One mailbox sends single offers, whatever its format says.
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when((text(split) == "drop") | (text(status) == "control") | text(email_type).isin(*DROPPED_TYPES), "none")
        .when((text(split) == "single_offer") | F.contains(text(address), F.lit(single_from)), "single")
        .when(text(family) == "cards", "cards")
        .when(text(family) == "ruled", "ruled")
        .otherwise("newsletter")
    )


def blocks_by(splitter: Column, body: Column) -> Column:
    """The blocks of a body by its splitter's name."""
    none = F.array().cast("array<string>")
    return (
        F.when(splitter == "none", none)
        .when(splitter == "single", single_offer(body))
        .when(splitter == "cards", alert_cards(body))
        .when(splitter == "ruled", ruled_parts(body))
        .otherwise(F.when(body.rlike(r"(?m)^#\d+:"), listings.numbered_items(body)).otherwise(listings.blocks(body)))
    )


def split_by_format(messages: DataFrame) -> DataFrame:
    """A row for each block of each matched message (seq, msg_id, subject, body and its family, split, status, email_type, address), split as its format says:
    (seq, msg_id, subject, splitter, block_idx, block). Year tables of ruled mail become label lines.
    """
    m = messages.withColumn("splitter", splitter_of(*[F.col(c) for c in ("family", "split", "status", "email_type", "address")])).where("splitter <> 'none'")
    d = m.select("seq", "msg_id", "subject", "splitter", F.posexplode(blocks_by(F.col("splitter"), F.col("body"))).alias("block_idx", "block"))
    ruled = F.col("splitter") == "ruled"
    return d.withColumn("block", F.when(ruled, listings.normalize_table(F.when(ruled, F.col("block")))).otherwise(F.col("block")))


# Headings after which a ruled mail holds no description, and lines that are no part of it.
FOOTER = r"(?im)^[ \t]*(?:Footnotes and Legend|Geography|Industries|Documents|Axial NDA Available|CIM Instantly Available|iOS App Now Available|Was this deal forwarded|Pass \(https?://|Pursue \(https?://)"
FIGURE_LINE = r"(?i)^\s*(?:Revenue|EBITDA|SDE|Asking(?:[ \t]+Price)?):[ \t]*\$"
LEAD_IN = r"(?i)^(?:based on your criteria|have a look below)"


def ruled_description(block: Column, title: Column) -> Column:
    """The seller's description in a ruled block: what follows its figures, without greeting, blanked contacts and footer."""
    lines = F.split(F.get(F.split(F.regexp_replace(F.coalesce(block, F.lit("")), r"\r\n?", "\n"), FOOTER, 2), F.lit(0)), "\n")
    name = F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")))

    def described(ls: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(ls, lambda s, i: F.when(s.rlike(FIGURE_LINE), i))), F.lit(-1))
        rest = F.filter(ls, lambda s, i: i > last)
        plain = lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))
        said = F.filter(rest, lambda s: (F.trim(s) != "") & ~F.contains(s, F.lit("█")) & ~F.trim(s).rlike(LEAD_IN) & ~((name != "") & (F.length(F.trim(s)) < 120) & F.contains(name, plain(s))))
        return F.trim(F.regexp_replace(F.array_join(said, " "), r"\s+", " "), F.lit(" -|"))

    return F.transform(F.array(lines), described)[0]
