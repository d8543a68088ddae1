"""Who a sender is, by a catalog that is a table.

An entry says what it names (a whole address, a domain, or all that lies under a domain), at which step of
the chain of lookups it counts, and its place among the entries of that step. A sender's domain is expanded to all
domains it lies under, so every lookup is an equality, all steps are one join, and a catalog may have any number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.functions import mail
from listingmill.operators.formats import Catalog

#: The order in which what is known of a sender counts.
STEPS = ("mailbox", "wildcard", "provider", "format address", "format domain")
#: Rows of senders that are broadcast at most when they are joined back.
_BROADCAST_ROWS = 200_000


def entries_of(spark, catalog: Catalog, nicknames: dict[str, str] | None = None) -> DataFrame:
    """The entries (step, place, match, key, label, subcategory) of a catalog of literals; ``nicknames`` are labels by provider, family or format."""
    names, rows = nicknames or {}, []
    add = lambda step, place, match, key, label, sub=None: rows.append((STEPS.index(step), place, match, key.lower(), label, sub))
    for i, s in enumerate(catalog.subcategories):
        label = names.get(s.provider, s.provider.capitalize())
        add(*(("wildcard", i, "under", s.mailbox[2:]) if s.mailbox.startswith("*@") else ("mailbox", i, "address", s.mailbox)), label, s.id)
    for i, (domain, label) in enumerate(catalog.nicknames):
        add("provider", i, "under", domain, label)
    for i, f in enumerate(catalog.formats):
        label = names.get(f.id, names.get(f.family, f.family.capitalize()))
        for a in f.addresses:
            add("format address", i, "address", a, label)
        for d in f.domains:
            add("format domain", i, "under", d, label)
    return spark.createDataFrame(rows, "step int, place long, match string, key string, label string, subcategory string")


def suffixes(domain: Column) -> Column:
    """A domain and all that it lies under, as names: a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def known_senders(senders: DataFrame, entries: DataFrame) -> DataFrame:
    """(address, label, subcategory): what the first entry of the chain that fits says of each address (column ``address``, each once)."""
    domain = F.substring_index("address", "@", -1)
    key = lambda match, k: F.struct(F.lit(match).alias("match"), k.alias("key"))
    keys = F.concat(F.array(key("address", F.col("address")), key("domain", domain)), F.transform(suffixes(domain), lambda k: key("under", k)))
    asked = senders.where("address <> ''").select("address", F.explode(keys).alias("k")).select("address", "k.match", "k.key")
    found = asked.join(entries, ["match", "key"])
    return found.groupBy("address").agg(F.min_by(F.struct("label", "subcategory"), F.struct("step", "place", "key")).alias("e")).select("address", "e.label", "e.subcategory")


def label_senders(messages: DataFrame, entries: DataFrame, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``messages`` (with address, domain and hay) with ``nickname`` and ``subcategory``.

    The chain of lookups in ``entries`` comes first, then ``rules`` of patterns in the address, the domain and the text, in their order, then the
    second-level name of a provider's domain with a capital, else "Unknown". Each different address is looked up once.
    """
    known = known_senders(messages.select("address").distinct(), entries).checkpoint()
    known = F.broadcast(known) if known.count() <= _BROADCAST_ROWS else known
    blob = F.lower(F.concat_ws(" ", "address", "domain", "hay"))
    ruled = F.coalesce(*[F.when(blob.rlike(pattern), F.lit(label)) for pattern, label in rules], F.lit(None).cast("string"))
    own = F.when(mail.is_provider(F.col("domain")), F.initcap(mail.domain_core(F.col("domain"))))
    return messages.join(known, "address", "left").withColumn("nickname", F.coalesce("label", ruled, own, F.lit("Unknown"))).drop("label")
