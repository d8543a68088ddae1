import json
import random

import pytest
from pyspark.sql import functions as F

from listingmill.operators import formats, merge, resolve, rules
from listingmill.sources import readers, sinks
from listingmill.streaming import jobs


def listings(spark, n=60, seed=0):
    r = random.Random(seed)
    names = ["Established Plumbing Company", "Established Plumbing Company, Full Service", "Water Testing Laboratory", "Regional Roofing Contractor", "Parts Maker"]
    rows = []
    for i in range(n):
        rows.append((i, f"e{i}", r.choice(names), r.choice([None, "", "https://x.example/1", "https://x.example/1/?utm_source=a", f"https://x.example/{i}"]), r.choice([None, "Waco"]), r.choice([None, "TX", "OK"]), None, r.choice([None, 1e6, 5e5]), r.choice([None, 3e5]), r.choice([None, 0.0, 4e5]), r.choice([None, 2e6])))
    return spark.createDataFrame(rows, "seq long, ext_id string, title string, url string, city string, state string, county string, revenue double, ebitda double, sde double, asking double")


def clean(title):
    return "".join(c for c in (title or "").lower() if c == " " or "a" <= c <= "z")


def mark(r):
    earn = r["sde"] if r["ebitda"] is None else r["ebitda"]
    band = lambda v, step: (int(v / step) or -1) if v else -1
    return (r["state"], band(r["revenue"], 250_000), band(earn, 100_000)) if earn and r["state"] else None


def same(r, k):
    return bool(r["norm"] and r["norm"] == k["norm"]) or bool(mark(r) and mark(r) == mark(k)) or bool(r["state"] and r["state"] == k["state"] and resolve.alike(clean(r["title"]), clean(k["title"])))


def whole_fold(rows):
    """The fold as scans of all kept rows for each row in order, repeated over what is kept until nothing merges."""
    now = [dict(r, members=[r["seq"]]) for r in rows]
    while True:
        kept, groups = [], {}
        for r in now:
            hit = next((k for k in kept if same(r, k)), None)
            if hit is None:
                kept.append(r)
            groups.setdefault((hit or r)["seq"], []).append(r)
        after = []
        for k in kept:
            merged = dict(k)
            for r in groups[k["seq"]][1:]:
                merged["members"] = merged["members"] + r["members"]
                for f in (*resolve.MERGED, "url", "norm"):
                    merged[f] = r[f] if merged[f] in (None, "") else merged[f]
            after.append(merged)
        if len(after) == len(now):
            return sorted((k["ext_id"], tuple(sorted(k["members"])), k["state"], k["revenue"]) for k in after)
        now = after


@pytest.mark.parametrize("seed", range(3))
def test_fold_by_rounds_equals_scans(spark, seed):
    df = listings(spark, seed=seed)
    from listingmill.functions.urls import norm_url

    want = whole_fold([r.asDict() for r in df.withColumn("norm", norm_url(F.col("url"))).orderBy("seq").collect()])
    kept, of = resolve.dedupe_fold(df)
    members = {}
    for r in of.collect():
        members.setdefault(r.kept_seq, []).append(r.seq)
    got = sorted((r.ext_id, tuple(sorted(members[r.seq])), r.state, r.revenue) for r in kept.collect())
    assert got == want and all(r.n_merged == len(members[r.seq]) - 1 for r in kept.collect())


def test_fold_of_a_follow_up(spark):
    """A later mail that discloses earnings, under a shorter title, is the same listing."""
    kind = "seq long, ext_id string, title string, url string, city string, state string, county string, revenue double, ebitda double, sde double, asking double"
    rows = [(0, "a", "Established HVAC & Plumbing Company, Full Service Residential and Commercial", "https://x.example/1", None, "TX", None, None, None, None, 9e5), (1, "b", "Established HVAC & Plumbing Company", None, "Waco", "TX", None, 2e6, 4e5, None, None), (2, "c", "Parts Maker", None, None, "OK", None, None, None, None, None)]
    kept, _ = resolve.dedupe_fold(spark.createDataFrame(rows, kind))
    assert sorted((r.ext_id, r.city, r.ebitda, r.asking, r.n_merged) for r in kept.collect()) == [("a", "Waco", 4e5, 9e5, 1), ("c", None, None, None, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_dedupe_keys_equals_connected_groups(spark, seed):
    df = listings(spark, 40, seed)
    from listingmill.functions.urls import norm_url

    rows = [r.asDict() for r in df.withColumn("norm", norm_url(F.col("url"))).orderBy("seq").collect()]
    group = {r["seq"]: r["seq"] for r in rows}
    while True:
        before = dict(group)
        for r in rows:
            for k in rows:
                if same(r, k) or same(k, r):
                    group[r["seq"]] = group[k["seq"]] = min(group[r["seq"]], group[k["seq"]])
        if group == before:
            break
    assert {r.seq: r.component for r in resolve.dedupe_keys(df).collect()} == group


def test_components_of_a_long_chain(spark):
    links = spark.range(600).selectExpr("id AS n", "cast(id div 2 as string) AS a", "cast((id + 1) div 2 as string) AS b")
    assert {r.component for r in resolve.components(links, "n", ["a", "b"]).collect()} == {0}


def test_similar_titles_equal_all_pairs(spark):
    r = random.Random(1)
    words = "established plumbing company water testing lab roofing contractor parts maker of texas the".split()
    titles = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 5))) + r.choice(["", " ", "x"]) for _ in range(150)} | {"", "a", "ab"})
    df = spark.createDataFrame([("TX", t) for t in titles], "state string, t string")
    got = {(x.a, x.b) for x in resolve.similar_titles(df, df).collect()}
    assert got == {(a, b) for a in titles for b in titles if a != b and resolve.alike(a, b)}


def test_shared_pairs_bound_holds_for_every_alike_pair():
    r = random.Random(4)
    met = 0
    for _ in range(6000):
        a = "".join(r.choice("abc ") for _ in range(r.randint(2, 24)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", " "])
        b = "".join(b)
        if a != b and resolve.SequenceMatcher(None, a, b).ratio() > resolve.ALIKE:
            met += 1
            assert resolve.shared_pairs(a, b) >= resolve.least_shared(len(a) + len(b))
            x, y = sorted((a, b), key=len)
            if len(x) > resolve.SHORT:
                flat = [1] * 27**2
                tx, ty = resolve.pair_tokens(x, flat), resolve.pair_tokens(y, flat)
                token = resolve._first_shared(tx, ty)
                assert token in tx[: resolve.prefix_size(len(x), True)] and token in ty[: resolve.prefix_size(len(y), False)]
    assert met > 500


@pytest.mark.parametrize("block", [resolve.BLOCK, 7])
def test_varied_titles_equal_all_pairs(spark, sf_dir, block):
    from listingmill.plans.resolve_queries import varied_titles

    rows = sorted(tuple(x) for x in varied_titles(spark, sf_dir).withColumn("state", F.lit("TX")).collect())[: 400 if block == resolve.BLOCK else 120]
    df = spark.createDataFrame(rows, "t string, state string")
    want = {(s, a, b) for a, s in rows for b, z in rows if s == z and a != b and (resolve.SequenceMatcher(None, a, b).ratio() > resolve.ALIKE or (min(len(a.strip()), len(b.strip())) >= 12 and (a.strip() in b.strip() or b.strip() in a.strip())))}
    met = resolve.title_candidates(df, df, block)
    assert {(x.state, x.a, x.b) for x in resolve.similar_titles(df, df).collect()} == want
    found = {(x.state, x.a, x.b) for x in met.collect()}
    assert len(found) == met.count() and len(found) < 60 * len(rows)
    assert {w for w in want if resolve.SequenceMatcher(None, *w[1:]).ratio() > resolve.ALIKE} <= found


def in_order(rows):
    first, out = {}, {}
    for seq, u, f, state, t in rows:
        keys = [x for x in (("u", u), ("f", f), ("t", t and (state, t))) if x[1] is not None]
        out[seq] = min([first[k] for k in keys if k in first] + [n for k, n in first.items() if t and k[0] == "t" and k[1][0] == state and resolve.alike(t, k[1][1])], default=seq)
        if out[seq] == seq:
            for k in keys:
                first.setdefault(k, seq)
    return out


@pytest.mark.parametrize("finish,rounds", [(0, 10**9), (8, 2), (10**6, 6)])
def test_fold_of_keys_by_rounds_groups_and_in_order(spark, finish, rounds):
    r = random.Random(7)
    titles = ["water testing lab", "water testing labs", "water testing laboratory", "parts maker", "part maker", "roofing contractor", "roofing contractors of note"]
    some = lambda p, v: v if r.random() < p else None
    rows = [(i, some(0.4, f"u{r.randint(0, 30)}"), some(0.4, f"f{r.randint(0, 30)}"), *((r.choice(["TX", "OK"]), r.choice(titles)) if r.random() < 0.3 else (None, None))) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, u string, f string, state string, t string")
    assert {x.seq: x["into"] for x in resolve.first_matches(df, finish, rounds).collect()} == in_order(rows)


def test_fold_of_a_long_chain_takes_few_jobs(spark):
    rows = [(i, f"u{(i + 1) // 2}", f"f{i // 2}", None, None) for i in range(10_000)]
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    got = {x.seq: x["into"] for x in resolve.first_matches(spark.createDataFrame(rows, "seq long, u string, f string, state string, t string")).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    sc.setJobGroup("", "")
    assert got == in_order(rows) and jobs < 30


def test_upsert_stored_row_by_row(spark):
    """Against writes one by one: replacement by the same mail, clearing by a sole source, filling by others."""
    kind = "id long, ext_id string, title string, url string, blurb string, source string, sub_source string, nickname string, city string, state string, county string, revenue double, ebitda double, sde double, asking double, business_model_type string, needs_text string, first_seen timestamp, last_seen timestamp, times_seen int"
    at = [None, None, 1]
    stored = spark.createDataFrame([(1, "m1:0", "Water Lab", "https://x.example/1", "b", "s", None, None, None, "TX", None, 1e6, 2e5, None, 5e5, "", "[]", *at), (2, "m2:0", "Parts Maker", None, "b", "s", None, None, "Tulsa", "OK", None, None, None, None, None, "", "[]", *at), (3, "m3:0", "Established Roofing Contractor", None, "b", "s", None, None, None, "TX", None, None, None, None, 7e5, "", "[]", *at)], kind)
    refs = spark.createDataFrame([(1, "s", "m1", "u", None), (2, "s", "m2", "u", None), (2, "s", "m9", "u", None), (3, "s", "m3", "u", None)], "deal_id long, source string, msg_id string, url string, seen_at timestamp")
    names = "seq long, source_msg string, " + kind.split("id long, ", 1)[1].split(", first_seen")[0]
    rows = [
        (0, "m1", "m1:0", "Water Laboratory", None, "", "s", None, None, "Waco", "TX", None, None, 3e5, None, 5e5, "NATIONAL", "[]"),  # repeat of a sole source: revenue cleared
        (1, "m2", "m2:0", "Parts Maker", "https://x.example/2", "b2", "s", None, None, None, "OK", None, None, None, None, None, "", "[]"),  # repeat, but two mails: nothing cleared
        (2, "m7", "m7:0", "Established Roofing Contractor of Note", None, "b", "t", "t@t.example", None, "Austin", "TX", None, 3e6, 4e5, None, 8e5, "", "[]"),  # like title
        (3, "m8", "m8:0", "Quite another one", "https://x.example/9", "b", "t", None, None, None, "TX", None, None, None, 1e5, None, "", "[]"),  # new
        (4, "m6", "m6:0", "Anything", "https://x.example/1?utm_source=z", "b", "t", None, None, "Elsewhere", "TX", None, 9e6, None, None, None, "", "[]"),  # same address: fills
    ]
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    deals, mentions = resolve.upsert_stored(stored, refs, spark.createDataFrame(rows, names), now)
    got = {r.ext_id: r for r in deals.collect()}
    assert (got["m1:0"].title, got["m1:0"].revenue, got["m1:0"].ebitda, got["m1:0"].asking, got["m1:0"].city, got["m1:0"].blurb, got["m1:0"].times_seen) == ("Water Laboratory", 9e6, 3e5, 5e5, "Waco", "b", 3)
    assert (got["m2:0"].city, got["m2:0"].blurb, got["m2:0"].url, got["m2:0"].times_seen) == ("Tulsa", "b2", "https://x.example/2", 2)
    assert (got["m3:0"].title, got["m3:0"].revenue, got["m3:0"].asking, got["m3:0"].city, got["m3:0"].sub_source, got["m3:0"].times_seen) == ("Established Roofing Contractor", 3e6, 7e5, "Austin", "t@t.example", 2)
    assert len(got) == 4 and got["m8:0"].sde == 1e5 and got["m8:0"].id > 3 and got["m8:0"].times_seen == 1
    said = {(r.deal_id, r.msg_id) for r in mentions.collect()}
    assert said >= {(1, "m6"), (3, "m7"), (got["m8:0"].id, "m8")} and len(said) == 7


def test_formats_with_several_senders_and_places_of_signals(spark):
    f = formats.Format("x.all", "x", domains=("one.example",), source="two.example", sub_source="*@three.example", signals=(("s", "deal", 7, "subject"), ("o", "deal", 11, "open"), ("b", "deal", 13, "body")))
    cat = formats.Catalog(formats=(f,))
    rows = [("a@one.example", "hi", "x"), ("a@mail.two.example", "a deal", "x"), ("a@three.example", "hi", "intro\n\ndeal"), ("a@four.example", "deal", "deal"), ("a@two.example", "hi", "deal first\n\nrest")]
    out = formats.match_formats(spark.createDataFrame(rows, "sender string, subject string, body string"), cat)
    points = {(r.sender, r.subject): r.format_score for r in out.collect()}
    assert points == {("a@one.example", "hi"): 20, ("a@mail.two.example", "a deal"): 20 + 7 + 13, ("a@three.example", "hi"): 20 + 13, ("a@four.example", "deal"): None, ("a@two.example", "hi"): 20 + 11 + 13}


def test_upsert_is_idempotent(spark):
    base = listings(spark).selectExpr("*", "'b' AS blurb", "'s' AS source", "'t' AS sub_source", "'n' AS nickname", "'' AS business_model_type", "1 AS times_seen", "'2024' AS first_seen", "'2024' AS last_seen")
    once = merge.upsert_new_wins(base, base)
    assert once.count() == base.count()
    twice = merge.upsert_new_wins(once, base)
    assert sorted(map(str, twice.drop("city").collect())) == sorted(map(str, once.drop("city").collect()))


def test_score_cases(spark):
    rows = [
        ("water", "Water treatment company", None, "Denver", "CO", None, 1e6, 2e5, None, None, "NATIONAL"),
        ("cafe", "Cafe downtown", None, "Austin", "TX", None, 1e6, 5e5, None, None, ""),
        ("abroad", "Parts maker", None, "Toronto", "ON", None, 1e7, 2e6, None, None, ""),
        ("local", "Crew business", None, "Miami", "FL", None, 1e7, 2e6, None, None, "LOCAL_SERVICE"),
        ("home", "Parts maker", "recurring", "North Austin", "TX", None, 4e6, 1.2e6, None, None, ""),
        ("sde", "Parts maker", None, "Waco", "TX", None, 4e6, None, 400_000.0, None, ""),
        ("cheap", "Parts maker", None, "Reno", "NV", None, None, None, None, 1e6, ""),
        ("dark", "Parts maker", None, "Reno", "NV", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, title string, blurb string, city string, state string, county string, revenue double, ebitda double, sde double, asking double, business_model_type string")
    got = {r.k: r for r in rules.score_deals(df).collect()}
    assert got["water"].strategic and not got["water"].rejected and "Sub-scale — tuck-in only" in got["water"].flags
    assert got["cafe"].reject_reason == "Excluded category: restaurant" and got["cafe"].score == 0 and got["cafe"].geo_tier is None
    assert got["abroad"].reject_reason == "Outside US"
    assert "outside TOLA" in got["local"].reject_reason
    assert (got["home"].score, got["home"].bucket, got["home"].fin_tier) == (71, "A_priority", "T1")
    assert got["sde"].reject_reason == "Earnings $340,000 below visibility floor $350,000 for TX — Austin / San Antonio / Waco corridor"
    assert got["cheap"].reject_reason.startswith("No earnings/revenue; asking $1,000,000 below $1,875,000")
    assert not got["dark"].rejected and "Financials undisclosed — nothing to proxy" in got["dark"].flags
    fit = {r.k: r for r in rules.assess_fit(df).collect()}
    assert (fit["water"].fit_level, fit["cafe"].fit_level, fit["cafe"].surfaced) == ("priority", "out", True)
    assert (fit["cheap"].fit_level, fit["dark"].fit_level, fit["home"].fit_level) == ("low", "unknown", "priority")


def test_formats(spark):
    rows = [
        ("Alerts <alerts@alpha.example>", "New deals today", "Asking Price: $1"),
        ("x <promo@alpha.example>", "Webinar", "Join our webinar now"),
        ("x <odd@alpha.example>", "something", "else"),
        ("n <n@notice.beta.example>", "x", "y"),
        ("l <l@letters.example>", "x", "This week\n1. A deal at $5"),
        ("Bob <bob@gmail.com>", "x", "y"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, sender string, subject string, body string")
    got = {r.seq: r.format_id for r in formats.match_formats(df).collect()}
    assert got == {0: "alpha.digest", 1: "alpha.promo", 2: "alpha.unknown", 3: "beta.teaser", 4: "letters.weekly", 5: None}
    assert formats.violations(formats.SAMPLE) == []


def test_fold_verdicts_deletes_and_orders(spark):
    rows = [(1, "a", "short", "2024-01-01", "f1", 0), (1, "a", "pass", "2024-01-02", "f0", 0), (2, "a", "short", "2024-01-01", "f1", 0), (2, "a", None, "2024-01-01", "f1", 1)]
    df = spark.createDataFrame(rows, "deal_id long, member string, action string, at string, file string, pos long")
    assert [(r.deal_id, r.action) for r in merge.fold_verdicts(df).collect()] == [(1, "pass")]


def test_sources_round_trip(spark, tmp_path):
    doc = {"schema": "flow_import_v1", "deals": [{"extId": "a", "title": "T", "revenue": 5.0, "needsLlm": ["earnings"], "timesSeen": 2}], "verdicts": [{"extId": "a", "member": "m", "action": "short"}]}
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "x.json").write_text(json.dumps(doc))
    (tmp_path / "snap" / "bad.json").write_text("{not json")
    deals, verdicts = readers.read_snapshot(spark, str(tmp_path / "snap"))
    assert deals.first().ext_id == "a" and verdicts.first().action == "short"
    (tmp_path / "in.csv").write_text('title, revenue ,needs_llm,url\n"A, b", "$1,200" ,"[""earnings""]",\nC,n/a,,https://x\n')
    rows = {r.title: r for r in readers.read_csv(spark, str(tmp_path / "in.csv")).collect()}
    assert rows["A, b"].revenue == 1200 and rows["A, b"].needs_llm == ["earnings"] and rows["A, b"].ext_id == "csv:a-b:na" and rows["C"].ext_id == "csv:https://x"
    (tmp_path / "logs").mkdir()
    for n in "ab":
        (tmp_path / "logs" / f"{n}.json").write_text(json.dumps({"schema": "verdict_log_v1", "member": "m", "verdicts": [{"deal_id": "1", "action": "short", "at": n}]}))
    seen = spark.createDataFrame([("a.json",)], "file string")
    assert [r.file for r in readers.read_verdict_logs(spark, str(tmp_path / "logs"), seen).collect()] == ["b.json"]
    sinks.write_snapshot(deals, verdicts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "deals")).count() == 1
    mail = {"id": "1", "headers": [{"name": "FROM", "value": "a@b.example"}], "parts": [{"mime": "text/plain", "data": "aGk_"}]}
    (tmp_path / "mail.json").write_text(json.dumps(mail))
    m = readers.read_mailbox(spark, str(tmp_path / "mail.json")).first()
    assert (m.sender, m.body) == ("a@b.example", "hi?")


def test_stream_upsert_over_two_runs(spark, tmp_path):
    src, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    schema = "k long, t long, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(src)
    run = lambda: jobs.upsert_latest(jobs.read_stream(spark, src, spark.createDataFrame([], schema).schema), table, check, "k", ["t"])
    run()
    spark.createDataFrame([(1, 2, "c"), (1, 0, "old")], schema).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.k, r.v) for r in jobs.current(spark, table, spark.createDataFrame([], schema).schema).collect()) == [(1, "c"), (2, "b")]


def test_threads_dates_and_import_folder(spark, tmp_path):
    doc = {"messages": [{"id": "1", "sender": "a", "subject": "s", "date": "Mon, 5 Jan 2026 10:00:00 +0100", "plaintextBody": "null", "htmlBody": "<p>x</p>"}, {"id": "2", "sender": "b", "subject": "t", "date": "2026-01-01 00:00:00", "plaintextBody": "plain", "htmlBody": None}, {"id": "3", "sender": "c", "subject": "u", "date": "whenever", "plaintextBody": "y", "htmlBody": None}]}
    (tmp_path / "q_get_thread_1.txt").write_text(json.dumps(doc))
    (tmp_path / "other.txt").write_text("not json")
    wanted = spark.createDataFrame([("1", "first"), ("9", "none")], "msg_id string, name string")
    assert [(r.msg_id, r.body) for r in readers.read_threads(spark, str(tmp_path), wanted).collect()] == [("first", "x")]
    every = readers.read_threads(spark, str(tmp_path))
    assert every.count() == 3
    now = F.lit("2026-01-06 00:00:00").cast("timestamp")
    assert [r.msg_id for r in readers.newer_than(every, 3, now).collect()] == ["1"]
    assert {r.msg_id for r in readers.newer_than(every, 30, now).collect()} == {"1", "2"}
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("title,url,revenue\nOne,https://x.example/" + name + ',"$1,000"\n')
    seen = spark.createDataFrame([("a.csv",)], "file string")
    assert [(r.file, r.revenue) for r in readers.import_folder(spark, str(tmp_path), seen).collect()] == [("b.csv", 1000.0)]
    assert readers.import_folder(spark, str(tmp_path), spark.createDataFrame([("a.csv",), ("b.csv",)], "file string")).count() == 0


def test_places_in_text(spark):
    from listingmill.functions.places import location

    cases = {
        "Location: Austin, TX": ("Austin", "TX", None), "in North Little Rock, AR area": ("North Little Rock", "AR", None), "Travis County, TX": (None, "TX", "Travis"), "a\nSan Antonio, TX\nWaco, TX": ("San Antonio", "TX", None),
        "Toronto, ON": (None, None, None), "somewhere in TX": (None, "TX", None), "in new mexico": (None, "NM", None), "nothing": (None, None, None), "Oak Hill, ZZ then Tulsa, OK": ("Tulsa", "OK", None), "A/B, TX": ("A/B", "TX", None), "(Dallas, TX)": ("Dallas", "TX", None), "": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", location(F.col("t")).alias("r"))
    assert {r.t: (r.r.city, r.r.state, r.r.county) for r in df.collect()} == cases


def test_forwarded_mail(spark):
    from listingmill.functions import mail

    body = "see below\n\n---------- Forwarded message ---------\nFrom: Ann <ann@alpha.example>\nDate: x\nSubject: y\n\nThe text\nFrom: here on"
    df = spark.createDataFrame([(body,), ("plain",), (None,)], "b string").select(mail.forwarded_from(F.col("b")).alias("f"), mail.without_forward_header(F.col("b")).alias("w"))
    assert [(r.f, r.w) for r in df.collect()] == [("Ann <ann@alpha.example>", "\nThe text\nFrom: here on"), ("", "plain"), ("", "")]
