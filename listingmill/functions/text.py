"""Text: thin blurbs, clean blurbs, first sentences, titles, labels, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prose(text: Column) -> Column:
    """Lower-case letters and digits, one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def blurb_is_thin(title: Column, blurb: Column) -> Column:
    """Whether a blurb says no more than its title: short, equal, the title with a few words, or the same words."""
    b = F.trim(F.coalesce(blurb, F.lit("")))
    nt, nb = prose(title), prose(b)
    tt, tb = F.array_distinct(F.split(nt, " ")), F.array_distinct(F.split(nb, " "))
    overlap = F.size(F.array_intersect(tt, tb)) / F.greatest(F.size(tb), F.lit(1))
    echo = F.contains(nb, nt) & (F.length(nb) <= F.length(nt) + 60)
    return F.when((F.length(b) < 24) | (nb == ""), True).when(nt == "", False).otherwise((nb == nt) | echo | ((overlap >= 0.8) & (F.length(nb) < 160)))


def listing_blurb(raw: Column, title: Column) -> Column:
    """A page's description in one line of at most 2,000 characters; null if it is empty or thin."""
    t = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return F.when((t != "") & ~blurb_is_thin(title, t), F.substring(t, 1, 2000))


# Lines that are no part of a blurb, and its length.
_NOT_BLURB, BLURB_CHARS = r"(?i)^\s*(?:asking\s+price|location)\s*:", 600


def clean_blurb(block: Column) -> Column:
    """A block without its list number, label lines and links, in one line of at most 600 characters."""
    lines = F.filter(F.split(F.regexp_replace(F.trim(block), r"^#?\d+[:.]\s*", ""), "\n"), lambda s: ~s.rlike(_NOT_BLURB))
    words = F.filter(F.split(F.array_join(lines, " "), r"[\s<>\[\]]+"), lambda w: (w != "") & ~w.rlike("(?i)^https?://"))
    return F.substring(F.trim(F.array_join(words, " "), F.lit(" -|")), 1, BLURB_CHARS)


def lead_sentence(blurb: Column) -> Column:
    """The first sentence if it ends within 240 characters, else the first 200 characters."""
    t = F.trim(F.regexp_replace(blurb, r"\s+", " "))
    sentence = F.regexp_extract(t, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.when(t != "", F.when((sentence == "") | (F.length(sentence) > 241), F.trim(F.substring(t, 1, 200))).otherwise(sentence))


def junk_title(title: Column) -> Column:
    """Whether a title is a crumb: empty, a label, a link, or a short piece that starts in lower case."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | (t == "(untitled listing)") | t.rlike(r"(?i)^(?:location\s*:|https?://|asking price\s*:)") | ((F.length(t) < 20) & t.rlike(r"^[a-z]"))


def location_label(city: Column, state: Column) -> Column:
    parts = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")))
    return F.when(parts == "", "Location not disclosed").otherwise(parts)


def model_label(model: Column) -> Column:
    """Words for a business model; the two old labels and blanks have none."""
    t = F.trim(F.coalesce(model, F.lit("")))
    return F.when((t == "") | t.isin("AMBIGUOUS", "LOCATION_AGNOSTIC"), F.lit(None)).otherwise(F.lower(F.replace(t, F.lit("_"), F.lit(" "))))


def title_clean(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z ]", ""))


def title_contained(a: Column, b: Column, least: int = 12) -> Column:
    """Whether the shorter of two cleaned titles, of ``least`` characters or more, lies in the longer."""
    ca, cb = title_clean(a), title_clean(b)
    return F.when(F.length(ca) <= F.length(cb), (F.length(ca) >= least) & F.contains(cb, ca)).otherwise((F.length(cb) >= least) & F.contains(ca, cb))


def mailbox_slug(address: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(address), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def first_paragraph(body: Column, lines: int = 12) -> Column:
    """The first paragraph, at most ``lines`` lines of it."""
    t = F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"^\s+", "")
    return F.array_join(F.slice(F.split(F.get(F.split(t, r"\n[ \t]*\n"), F.lit(0)), "\n"), 1, lines), "\n")


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Text of a mail's HTML: links as ``text (address)``, blocks on lines, items with a dash, blank lines squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"""(?is)<a\b[^>]*?href\s*=\s*["']((?:https?:)[^"']*)["'][^>]*>(.*?)</a>""", "$2 ($1)")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|tr|table|h[1-6]|ul|ol|section|article|header|footer)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", "")
    for name, char in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def strip_html_light(html: Column) -> Column:
    """Every tag a line break."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", "\n"), r"\n\s*\n+", "\n"), F.lit(" \n"))
