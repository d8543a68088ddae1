import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from listingmill.llm import common, exact_dedup, simhash_dedup


def test_exact(spark, odd, empty, sf_dir):
    rows = [(i, t) for i, t in [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "x" * 80 + "1"), (7, "x" * 80 + "2"), (8, "x" * 80 + "1"), (None, "a"), (9, "é"), (10, "é"), (None, "q"), (None, "q"), (11, "r"), (11, "r")]]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int")
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for limit in (common.BROADCAST_ROWS, 0):
        got = exact_dedup.exact_duplicates(df, digest=True, broadcast_rows=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t])
            ids = groups[text]
            keep = max((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact_dedup.exact_duplicates(odd).count() == odd.count()
    assert exact_dedup.exact_duplicates(empty).count() == 0


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, words, odd, empty):
    r = random.Random(2)
    docs = []
    for i in range(60):
        w = words(r.randint(1, 400), i)
        docs.append(" ".join(w))
        for _ in range(i % 4):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            docs.append(" ".join(v))
    docs += ["", " ", None, "Ab cD", "ab cd"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)], "doc_id long, text string, key string")
    prints = [brute_print(t or "") for t in docs]
    want = brute_groups(prints)
    for hot in (simhash_dedup.HOT, 1):
        got = {x.doc_id: x for x in simhash_dedup.near_duplicates(df, hot=hot).collect()}
        assert [int(got[i].fingerprint, 16) for i in range(len(docs))] == prints
        assert [got[i].component_id for i in range(len(docs))] == want
    assert simhash_dedup.near_duplicates(odd).count() == odd.count()
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_close_fingerprints_are_all_linked(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(30)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for hot in (2048, 1):
        label = {x.node: x.label for x in simhash_dedup.components(simhash_dedup.near_pairs(nodes, hot)).collect()}
        want = brute_groups(prints)
        groups = {}
        for i, g in enumerate(want):
            groups.setdefault(g, []).append(signed[i])
        for members in groups.values():
            assert {label.get(m, m) for m in members} == {min(members)}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.label for r in simhash_dedup.components(df).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert simhash_dedup.components(df.where(F.lit(False))).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_text_enters_a_shuffle_of_exact_dedup(spark, sf_dir, tmp_path):
    """Past the broadcast bound too: what is joined and shuffled are keys of fixed size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(exact_dedup.exact_duplicates(docs, digest=True).collect())
    for limit in (0, 3):
        out = exact_dedup.exact_duplicates(docs, digest=True, broadcast_rows=limit)
        assert "documents.parquet" not in plan_of(out) and "text#" not in plan_of(out)
        assert sorted(out.collect()) == want
        short = exact_dedup.exact_duplicates(docs, broadcast_rows=limit)
        assert sorted(short.collect()) == sorted((r[0], r[1], r[2], r[3]) for r in want)


def test_one_row_stays_of_rows_told_apart(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (None, "a", 12), (None, "b", 13), (None, "b", 14)], "doc_id long, text string, key long")
    for limit in (common.BROADCAST_ROWS, 0):
        got = exact_dedup.exact_duplicates(df, row_col="key", broadcast_rows=limit).collect()
        assert sorted(r.row for r in got if r.kept) == [11, 14] and len(got) == 5
    near = simhash_dedup.near_duplicates(df, row_col="key").collect()
    assert sorted(r.row for r in near if r.kept) == [10, 13]


def test_groups_joined_past_the_bound(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 3) for i in range(200)] + [(999, 77)], "row long, k long")
    groups = common.materialize(rows.where("k < 70").groupBy("k").agg(F.count("*").alias("n")), "groups")
    for how in ("left", "left_semi", "left_anti"):
        want = sorted(rows.join(groups, ["k"], how).select("row", "k").collect())
        for bound in (100, 5, 2, 0):
            assert sorted(common.join_groups(rows, groups, ["k"], "n", how, bound).select("row", "k").collect()) == want


def test_very_long_texts(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "x")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df, digest=True).collect()} == {1: (2, 2), 2: (2, 2), 3: (3, 1)}
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(df).collect()}
    assert {r.component_id for r in got.values()} == {1} and int(got[1].fingerprint, 16) == brute_print(long)
