"""Op 13 against brute force over odd rows, and both ways of meeting the groups of a language."""

import re
from collections import Counter, defaultdict

import pytest

from listingmill.llm import common, divergence, queries


def brute(rows, min_docs=3, top=200):
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [((lang or ""), (source or ""), re.findall(divergence.TERM, (text or "").translate(low))) for text, lang, source in rows]
    of_lang, of_group, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        of_lang[lang].update(terms)
        of_group[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in of_group:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p, q = share(of_group[lang, source]), share(of_lang[lang])
        pairs = []
        for other_lang, other in of_group:
            if other_lang == lang and other != source:
                o = share(of_group[lang, other])
                pairs.append((sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other))
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if of_group[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


ROWS = [
    ("Wein wein Öl öl", "de", "a"), ("wein Öl x1y", "de", "b"), ("wein öl é", "de", None), ("é é é wein", "de", "b"),
    (None, "de", "c"), ("", None, None), ("a b", None, "z"), ("A-b", "", "z"), ("b a", None, "y"), ("日本 a'b", "", "y"),
    ("one two", "en", "only"), ("Σς σ", "de", "a"), ("İ i", "de", "a"), ("wein öl é", "de", "a"), ("wein öl é", "de", "a"), ("\x00\x7f z", "fr", "q"),
]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "text string, lang string, source string, term int, t string")
    for kept, top in ((3, 200), (1, 2), (9, 200)):
        assert found(divergence.source_divergence(docs, kept, top)) == brute(ROWS, kept, top)


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()]
    assert found(queries.op13_divergence(spark, sf_dir)) == brute(rows)


def test_empty(spark, empty):
    assert divergence.source_divergence(empty).collect() == []


def test_counts_beyond_a_long(spark):
    one = spark.createDataFrame([(4 * 10**17, 5 * 10**18)], "c long, t long")
    assert one.select(divergence._share("c", "t")).first()[0] == 1 + 10**9 * (4 * 10**17 + 1) // (5 * 10**18)
