import random

import numpy as np

from listingmill.llm import rolling, substring_dedup


def brute(docs, width):
    seq = [(i, (t or "").encode().split()) for i, t in docs]
    key = lambda i: (1 << 63) if i is None else i
    first = {}
    for i, w in seq:
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            first[s] = min(first.get(s, 1 << 64), key(i))
    out = []
    for i, w in seq:
        gone = set()
        for p in range(len(w) - width + 1):
            if key(i) > first[tuple(w[p : p + width])]:
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=lambda x: (key(x[0]), x[3]))


def test_matches_brute_force(spark, words, odd, empty):
    shared = words(40, 99)
    docs = [(i, " ".join(words(random.Random(i).randint(0, 90), i) + (shared[: 20 + i % 25] if i % 3 == 0 else []) + words(5, 1000 + i))) for i in range(60)]
    docs += [(100, docs[4][1]), (101, docs[4][1]), (102, "a " * 200), (103, "a " * 50), (None, docs[4][1]), (104, None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, hashes int")
    for width, more in ((8, {}), (8, {"fan_out": 3, "broadcast_rows": 0}), (50, {"broadcast_rows": 0})):
        got = substring_dedup.remove_repeated_substrings(df, width=width, **more)
        rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=lambda x: ((1 << 63) if x[0] is None else x[0], x[3]))
        assert rows == brute(docs, width)
    assert substring_dedup.remove_repeated_substrings(odd).count() == odd.count()
    assert substring_dedup.remove_repeated_substrings(empty).count() == 0


def test_spans_are_maximal(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "start " + text + " end")], "doc_id long, text string")
    r = substring_dedup.remove_repeated_substrings(df, width=10).where("doc_id = 2").first()
    assert [(s.start, s.end) for s in r.spans] == [(1, 31)] and r.kept_text == "start end"


def test_hashes_do_not_depend_on_pieces():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(5000)).encode()
    buf = np.frombuffer(text, np.uint8)
    whole, n = rolling.word_hashes(buf, np.array([0, len(buf)]))
    held, rolling._PIECE = rolling._PIECE, 64
    try:
        parts, m = rolling.word_hashes(buf, np.array([0, len(buf)]))
        windows, _ = rolling.window_hashes(parts, m, 7)
    finally:
        rolling._PIECE = held
    assert (whole == parts).all() and n[0] == m[0] == 5000
    assert (windows == rolling.window_hashes(whole, n, 7)[0]).all()
    assert len(set(whole.tolist())) == len(set(text.split()))


def test_rows_without_id_and_the_largest_id(spark):
    text = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(None, text), ((1 << 63) - 1, text), (None, text + " x"), (None, "a b")], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.remove_repeated_substrings(df, width=10).collect()}
    assert got == {((1 << 63) - 1, 12): 0, (None, 12): 0, (None, 13): 0, (None, 2): 0}
    df = spark.createDataFrame([(None, text), (7, text), (None, text + " x")], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.remove_repeated_substrings(df, width=10).collect()}
    assert got == {(7, 12): 0, (None, 12): 12, (None, 13): 12}


def test_very_long_text(spark):
    r = random.Random(9)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "x " + long[600_000:1_200_000])], "doc_id long, text string")
    got = {x.doc_id: x for x in substring_dedup.remove_repeated_substrings(df).collect()}
    assert got[1].n_removed == 0 and got[1].n_words == 300_000
    assert got[2].n_words - got[2].n_removed <= 3 and got[2].kept_text.startswith("x")


def test_bucket_hash_is_independent_of_the_window_hash():
    """Windows whose 64-bit hashes were equal would still part by bucket: the two hashes share no structure."""
    words = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    h, _ = rolling.window_hashes(words, np.array([5000]), 7)
    b = substring_dedup._bucket_of(words, np.array([5000]), 7, 1 << 20)
    assert len(set(b.tolist())) > 4900 and abs(np.corrcoef(h.astype(float), b.astype(float))[0, 1]) < 0.05
