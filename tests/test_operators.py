"""Known results, edge cases and invariants of the core operators."""

import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import normalize as nz
from millrace.functions import scores
from millrace.operators import anomaly as an
from millrace.operators import contract as ct
from millrace.operators import equipment as eq
from millrace.operators import features as fe
from millrace.operators import identity as idy
from millrace.operators import lexical as lx
from millrace.operators import orders as od
from millrace.operators import quality as dq
from millrace.operators import retrieval as rt
from millrace.operators import segments as sg
from millrace.sources import layers as ly
from millrace.streaming import cdc

GOLD = [  # key, recency, tx30, monetary30, diversity, velocity7, cluster, segment, risk, propensity, band
    ("U0001", 1, 6, 6090.0, 2, 5, 2, "Priority", 1.0, 0.912, "high"),
    ("U0002", 3, 6, 3600.0, 2, 3, 1, "Growth", 0.7, 0.711, "medium"),
    ("U0003", 2, 6, 1800.0, 2, 4, 1, "Growth", 0.6, 0.599, "medium"),
    ("U0004", 4, 6, 705.0, 2, 3, 1, "Growth", 0.41, 0.426, "low"),
    ("U0005", 0, 6, 10710.0, 2, 3, 2, "Priority", 1.0, 0.979, "high"),
    ("U0006", 1, 6, 555.0, 2, 6, 0, "Value Watch", 0.635, 0.575, "medium"),
]
FEATURE_SCHEMA = "customer string, recency_days int, tx_count_30d long, monetary_30d double, product_diversity long, velocity_7d long, g_cluster int, g_segment string, g_risk double, g_propensity double, g_band string"


@pytest.fixture
def gold(spark):
    return spark.createDataFrame(GOLD, FEATURE_SCHEMA)


def test_scores_match_known_values(gold):
    for r in fe.with_propensity(fe.with_risk(gold)).collect():
        assert abs(r.risk_score - r.g_risk) <= 0.00101
        assert abs(r.propensity - r.g_propensity) <= 0.00101 and r.band == r.g_band


def test_known_segments(gold):
    rows = sg.fixed_kmeans(gold, ["tx_count_30d", "monetary_30d", "velocity_7d"], "monetary_30d", "customer")
    out = {r.customer: r.segment for r in sg.labelled(rows, "monetary_30d").collect()}
    assert out == {g[0]: g[7] for g in GOLD}


def test_lapse_risk(spark):
    rows = spark.createDataFrame([("a", "x", datetime(2024, 9, 10).date(), None, None, None)], "policy_id string, customer string, effective_date date, claim_count_12m int, renewal_due_days int, premium_amount double")
    assert fe.policy_features(rows, datetime(2026, 6, 27)).first().lapse_risk == 0.0


def test_stable_id_is_uuid5(spark):
    parts = [("a", "b"), ("", "x"), ("é", "日本")]
    for r in spark.createDataFrame(parts, "a string, b string").select("a", "b", nz.stable_id(F.col("a"), F.col("b")).alias("i")).collect():
        assert r.i == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.a}|{r.b}"))


def test_normalise(spark):
    r = spark.range(1).select(nz.id_type(F.lit(" passport ")).alias("t"), nz.id_value(F.lit(" e-7788990 ")).alias("v"), nz.ratio(F.lit(1.0), F.lit(0.0)).alias("z"), nz.contact(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(r) == ("PASSPORT", "E7788990", 0.0, "")


def test_record_hash_tells_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(nz.record_hash(F.col("x"), F.col("y")).alias("h")).collect()
    assert rows[0].h != rows[1].h


def test_idle_customers_stay(spark):
    t = spark.createDataFrame([("a", datetime(2026, 1, 1), 5.0, "p"), ("b", datetime(2026, 6, 1), 7.5, "q"), ("b", datetime(2026, 6, 1), 2.5, "r")], "customer string, txn_ts timestamp, amount double, product string")
    out = {r.customer: r for r in fe.customer_features(t, fe.anchor_of(t, "txn_ts")).collect()}
    assert (out["a"].tx_count_30d, out["a"].monetary_30d, out["a"].product_diversity) == (0, 0.0, 1)
    assert (out["b"].tx_count_30d, out["b"].monetary_30d, out["b"].recency_days) == (2, 10.0, 0)
    assert {r.customer for r in fe.recent_features(t, fe.anchor_of(t, "txn_ts")).collect()} == {"b"}


def test_eligibility_reasons(spark, gold):
    held = spark.createDataFrame([("U0001", ["CARD"]), ("U0004", ["INVESTMENT"])], "customer string, products array<string>")
    rules = spark.createDataFrame([("C", 1000.0, "CARD", None), ("D", 0.0, None, "INVESTMENT")], "campaign_id string, min_monetary_30d double, exclude_existing_product string, required_product string")
    out = {(r.customer, r.campaign_id): (r.eligible, r.reason) for r in fe.eligibility(gold, held, rules).collect()}
    assert out["U0001", "C"] == (False, "excluded_existing_product") and out["U0002", "C"] == (True, "eligible")
    assert out["U0004", "C"] == (False, "below_min_monetary") and out["U0004", "D"] == (True, "eligible") and out["U0002", "D"] == (False, "missing_required_product")


PEOPLE = "seq long, unified_key string, name string, phone string, email string, dob string, postal string"


def test_blocking_finds_all_pairs(spark):
    import itertools
    import random

    r = random.Random(3)
    people = [(i, r.choice([None, "k1", "k2"]), r.choice(["Al Bo", "Al Bob", "Cy Dee"]), r.choice(["1", "2", ""]), r.choice(["a@b", "c@d", ""]), r.choice(["x", ""]), r.choice(["9", "8"])) for i in range(60)]
    df = spark.createDataFrame(people, PEOPLE)
    got = {(x.l_seq, x.r_seq): x.score for x in idy.score(idy.candidate_pairs(df, expand=True), idy.name_ratio(F.col("l.name"), F.col("r.name"))).collect()}
    from difflib import SequenceMatcher

    want = {}
    for a, b in itertools.combinations(people, 2):
        sim = SequenceMatcher(None, a[2].upper(), b[2].upper()).ratio()
        s = (0.5 if a[1] and a[1] == b[1] else 0) + (sim * 0.25 if sim >= 0.72 else 0)
        s += sum(w for i, w in ((3, 0.18), (4, 0.18), (5, 0.12), (6, 0.08)) if a[i] and a[i] == b[i])
        if (a[1] and a[1] == b[1]) or round(min(1, s), 3) >= 0.68:
            want[a[0], b[0]] = min(1, s)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.0006 for k in want)


def test_representatives_keep_every_link(spark):
    """Each pair of all pairs is there, between the first rows of its two records, or joins rows of one key or of one record."""
    import random

    r = random.Random(4)
    people = [(i, r.choice([None, None, "k1", "k2"]), r.choice(["Al Bo", "Cy Dee"]), r.choice(["1", "2", ""]), r.choice(["a@b", "c@d", ""]), r.choice(["x", ""]), "9") for i in range(80)]
    df = spark.createDataFrame(people, PEOPLE)
    every = {(x.l_seq, x.r_seq) for x in idy.candidate_pairs(df, expand=True).collect()}
    few = [(x.l_seq, x.r_seq) for x in idy.candidate_pairs(df).collect()]
    assert len(few) == len(set(few)) and set(few) < every
    first, key = {}, {}
    for p in people:
        first.setdefault(p[1:], p[0])
        key.setdefault(p[1], p[0])
    for a, b in every:
        ra, rb = first[people[a][1:]], first[people[b][1:]]
        if people[a][1] and people[a][1] == people[b][1]:
            assert all(x == key[people[a][1]] or (key[people[a][1]], x) in few for x in (a, b))
        elif ra == rb:
            assert all(x == ra or (ra, x) in few for x in (a, b))
        else:
            assert (min(ra, rb), max(ra, rb)) in few
    assert idy.candidate_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["WEIGHTS", "SHORT_WEIGHTS"])
def test_scored_pairs_lose_none(spark, name):
    """Only pairs that can reach the threshold are made, and all that do are there."""
    import random

    r, weights = random.Random(6), getattr(idy, name)
    names = ["Al Bo Cantwell", "Al Bo Cantwel", "Al Bo Cantwall Jr", "Cy Dee"]
    people = [(i, r.choice([None, None, "k1", "k2"]), r.choice(names), r.choice(["1", "1", "2", ""]), r.choice(["a@b", "a@b", ""]), r.choice(["x", "y", ""]), r.choice(["9", "8", ""])) for i in range(150)]
    df = spark.createDataFrame(people, PEOPLE)
    want = idy.score(idy.candidate_pairs(df), idy.name_ratio(F.col("l.name"), F.col("r.name")), weights)
    got = idy.scored_pairs(df, idy.name_ratio, weights)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


@pytest.mark.parametrize("piece", [4, 2048])
def test_links_of_one_key_are_all_there(spark, tmp_path, piece):
    """Each pair that reaches the threshold is there, between the first rows of its two records; copies are paired with their first. Small pieces change nothing."""
    import random

    r = random.Random(8)
    names = ["Al Bo Cantwell", "Al Bo Cantwel", "Al Bo Cantwall Jr", "Cy Dee", "x" * 70]
    people = [(i, r.choice([None, None, "k1", "k2"]), r.choice(names), r.choice(["1", "1", "2", ""]), r.choice(["a@b", "a@b", ""]), r.choice(["x", "y", ""]), r.choice(["9", "8", ""])) for i in range(150)]
    df = spark.createDataFrame(people, PEOPLE)
    first = {}
    for p in people:
        first.setdefault(p[1:], p[0])
    every = idy.score(idy.candidate_pairs(df, expand=True), idy.name_ratio(F.col("l.name"), F.col("r.name"))).collect()
    at = {p[0]: first[p[1:]] for p in people}
    want = sorted(tuple(x) for x in every if at[x.r_seq] == x.l_seq or (at[x.l_seq] == x.l_seq and at[x.r_seq] == x.r_seq))
    got = idy.scored_pairs(df, idy.name_ratio, signature=idy.name_signature, bound=idy.ratio_bound, links=True, piece=piece, path=str(tmp_path / "records")).collect()
    assert sorted(map(tuple, got)) == want
    keys = [x for x in got if people[x.l_seq][1] and people[x.l_seq][1] == people[x.r_seq][1]]
    assert any(x.l_seq != min(p[0] for p in people if p[1] == people[x.l_seq][1]) for x in keys)


def test_name_ratio_is_that_of_difflib():
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    r = random.Random(9)
    text = lambda: "".join(r.choice(r.choice(["ab", "ABÄé0\U0001f600", "abc 012"])) for _ in range(r.choice([0, 1, 5, 20, 40, 64, 65, 210])))
    a = [text() for _ in range(1500)]
    b = [r.choice([x, x[:-2] + "q", x[3:] + "b", text()]) for x in a]
    got = idy.name_ratio.func(pd.Series(a), pd.Series(b))
    assert list(got) == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    signs = [idy.name_signature.func(pd.Series(t)) for t in (a, b)]
    unlike = [bin((int(x) ^ int(y)) % (1 << 64)).count("1") for x, y in zip(*signs)]
    assert all(s <= 1 - u / max(1, len(x) + len(y)) + 1e-12 for s, u, x, y in zip(got, unlike, a, b))


def test_blocks_follow_the_weights():
    assert idy.blocks(idy.SHORT_WEIGHTS, idy.REVIEW_MIN) == []
    assert idy.blocks(idy.WEIGHTS, idy.REVIEW_MIN) == [("phone", "email", "dob"), ("phone", "email", "postal")]


def test_a_score_at_its_limit_is_no_alert(spark):
    """The last bits of a deviation don't decide: 0.3 / 0.6 is the limit itself, however it is added up."""
    columns = "site_code string, machine_number string, shift_date string, oee double, oee_mean double, oee_std double, downtime_minutes double, downtime_minutes_mean double, downtime_minutes_std double"
    at = [("s", f"m{i}", "d", 0.2, 0.5, 0.6 - e, 20.3, 20.0, 0.6 - e) for i, e in enumerate((0.0, 1e-15, -1e-15))]
    beyond = [("s", "far", "d", 0.2, 0.5, 0.6 - 1e-9, 20.3, 20.0, 0.6 - 1e-9)]
    got = [(r.machine_number, r.metric) for r in eq.alerts(spark.createDataFrame(at + beyond, columns), -0.5, 0.5).collect()]
    assert got == [("far", "oee"), ("far", "downtime_minutes")]


def test_known_identity_candidates(spark):
    rows = [(1, "U1", "Mei Ling", "p", "e", "d", "z"), (2, None, "Mei-Ling", "p", "e", "d", "z"), (3, None, "", "", "", "", "")]
    out = idy.score(idy.candidate_pairs(spark.createDataFrame(rows, PEOPLE)), idy.name_ratio(F.col("l.name"), F.col("r.name"))).collect()
    assert [(r.l_seq, r.r_seq, r.action) for r in out] == [(1, 2, "review_attach_to_known_customer")]


def test_standardise_two_schemas(spark):
    flat = spark.createDataFrame([("2026-06-24", "NIGHT", "sz-1", 5, None, 3, 2, " "), ("", "D", "", 1, 1, 1, 1, None)], "SHIFT_DATE string, SHIFT_CODE string, MACHINE_NUMBER string, PRODUCED_QTY int, GOOD_QTY int, RUN_TIME_MIN int, DOWN_TIME_MIN int, DOWN_TIME_REASON string")
    a, b = eq.from_flat(flat, F.lit("SZ")).collect()
    assert (a.machine_number, a.shift_code, a.good_qty, a.downtime_reason) == ("SZ-1", "N", 0.0, "Unknown")
    assert b.shift_date is None and b.machine_number == "UNKNOWN" and b.shift_code == "D"
    nested = spark.createDataFrame([("2026-06-24", "DAY", "ks-press-01", 5, 4, 3, None)], "shiftDate string, shift string, machineNo string, outputQty int, okQty int, runtime_minutes int, downtime struct<minutes:int,reason:string>")
    c = eq.from_nested(nested, F.lit("KS")).first()
    assert (c.machine_number, c.shift_code, c.downtime_minutes, c.downtime_reason) == ("KS-PRESS-01", "D", 0.0, "Unknown")


def test_known_effectiveness(spark):
    events = spark.createDataFrame([("SZ", "SZ-CNC-01", datetime(2026, 6, 24).date(), 520.0, 512.0, 442.0, 38.0)], "site_code string, machine_number string, shift_date date, produced_qty double, good_qty double, runtime_minutes double, downtime_minutes double")
    machines = spark.createDataFrame([("SZ", "SZ-CNC-01", 42.0, 480)], "site_code string, machine_number string, ideal_cycle_seconds double, planned_minutes_per_shift int")
    r = eq.daily_effectiveness(events, machines).first()
    assert (r.availability, r.performance, r.quality, r.oee) == (0.9208, 0.8235, 0.9846, 0.7467)


def test_first_failing_rule_only(spark):
    rows = spark.createDataFrame([(None, -1), ("k", -1), ("k", 1)], "k string, amount int")
    out = [r.i for r in rows.select(dq.first_failing([("no_key", F.col("k").isNull()), ("negative", F.col("amount") < 0)]).alias("i")).collect()]
    assert out == ["no_key", "negative", None]


def test_survivor_ties_go_by_arrival(spark):
    rows = spark.createDataFrame([("u", "2024", 2, "AJO"), ("u", "2024", 1, "CAS"), ("u", "2025", 0, "X")], "k string, seen string, arrival int, ref string")
    assert dq.survivor(rows, "k", "seen", "arrival", ["ref"]).first().ref == "CAS"


OUTBOX = "event_id string, event_type string, aggregate_id string, payload string, status string, created_at string, published_at string"
REQUIRED = {"order.created": ["order_id", "items"]}
NOW = datetime(2026, 1, 2)
LIMITS = {"min_24h": 1, "max_24h": 5}


def _outbox(spark, **change):
    base = {"event_id": "1", "event_type": "order.created", "aggregate_id": "o1", "payload": json.dumps({"order_id": 1, "items": []}), "status": "PUBLISHED", "created_at": "2026-01-01T23:00:00Z", "published_at": "2026-01-01T23:00:10Z"} | change
    return spark.createDataFrame([tuple(base.values())], OUTBOX)


def _statuses(df):
    return {r.check: r.status for r in df.collect()}


@pytest.mark.parametrize(
    "change,check,status",
    [
        ({}, "event.payload_contract", "OK"),
        ({"payload": '{"order_id": 1}'}, "event.payload_contract", "FAIL"),
        ({"payload": "{"}, "event.payload_contract", "FAIL"),
        ({"event_type": "odd"}, "event.payload_contract", "FAIL"),
        ({"created_at": "soon"}, "time.timestamp_parse", "FAIL"),
        ({"published_at": None}, "time.timestamp_parse", "OK"),
        ({"created_at": "2026-01-02T00:01:01Z"}, "time.clock_skew", "WARN"),
        ({"created_at": "2026-01-02T00:05:01Z"}, "time.clock_skew", "FAIL"),
        ({"created_at": "2025-12-30T00:00:00Z"}, "freshness.outbox_latest_event", "FAIL"),
        ({"status": "PENDING", "published_at": None, "created_at": "2026-01-01T23:29:00Z"}, "lag.outbox_pending", "WARN"),
        ({"status": "PENDING", "published_at": None, "created_at": "2026-01-01T21:59:00Z"}, "lag.outbox_pending", "FAIL"),
        ({"published_at": "2026-01-01T23:01:01Z"}, "lag.publish_delay", "WARN"),
        ({"published_at": "2026-01-01T23:05:01Z"}, "lag.publish_delay", "FAIL"),
        ({"created_at": "2025-12-31T23:00:00Z"}, "volume.outbox_events_24h", "WARN"),
        ({"created_at": None}, "freshness.outbox_latest_event", "FAIL"),
    ],
)
def test_contract_mutations(spark, change, check, status):
    o = _outbox(spark, **change)
    assert _statuses(ct.run_all([ct.payload_check(o, REQUIRED), ct.timestamp_check(o), ct.time_checks(o, NOW, LIMITS)]))[check] == status


def test_empty_outbox_and_duplicates(spark):
    o = _outbox(spark)
    assert _statuses(ct.duplicate_check(o)) == {"idempotency.duplicate_semantic_event": "OK"}
    assert _statuses(ct.duplicate_check(o.unionByName(o))) == {"idempotency.duplicate_semantic_event": "FAIL"}
    none = o.filter("false")
    out = _statuses(ct.run_all([ct.payload_check(none, REQUIRED), ct.time_checks(none, NOW, LIMITS), ct.duplicate_check(none)]))
    assert out["freshness.outbox_latest_event"] == "FAIL" and out["volume.outbox_events_24h"] == "WARN" and out["lag.outbox_pending"] == "OK"
    assert not ct.gate(ct.time_checks(none, NOW, LIMITS)).first().passed


def test_reconciliation(spark):
    base = spark.createDataFrame([("SKU-RED-001", 120), ("SKU-BLK-002", 80)], "sku_id string, base long")
    moves = spark.createDataFrame([("SKU-RED-001", "RESERVE", 2), ("SKU-RED-001", "COMMIT", 2)], "sku_id string, movement_type string, quantity long")
    stock = lambda sold: spark.createDataFrame([("SKU-RED-001", 118, 0, sold), ("SKU-BLK-002", 80, 0, 0)], "sku_id string, available_stock long, reserved_stock long, sold_stock long")
    assert ct.reconciliation(base, moves, stock(2)).isEmpty()
    assert _statuses(ct.reconciliation_check(base, moves, stock(101))) == {"reconciliation.inventory_movements": "FAIL"}
    assert _statuses(ct.reconciliation_check(base.filter("false"), moves, stock(2))) == {"reconciliation.inventory_movements": "WARN"}
    assert ct.reconciliation(base, moves, stock(2).filter("sku_id = 'SKU-RED-001'")).count() == 3


def test_preview_counts_the_rest(spark):
    r = ct.preview(spark.range(8), F.col("id").cast("string"), F.col("id")).first()
    assert (r.n, r.details) == (8, "0; 1; 2; 3; 4; ... +3 more")


def test_merge_fields_presence(spark):
    old = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    new = spark.createDataFrame([(1, None, True, None), (2, "n", True, "m")], "k int, x string, x_present boolean, y string")
    out = {r.k: (r.x, r.y) for r in ly.merge_fields(old, new, "k").collect()}
    assert out == {1: (None, "b"), 2: ("n", "m")}


def test_upsert_last_writer_wins(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, s int, v string")
    b = spark.createDataFrame([(1, 1, "A"), (2, 4, "B")], "k int, s int, v string")
    assert {r.k: r.v for r in ly.upsert(a, b, ["k"], "s").collect()} == {1: "A", 2: "b"}


def test_versions_and_as_of(spark):
    c = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), 1), (1, "a", datetime(2024, 1, 2), 2), (1, None, datetime(2024, 1, 3), 3)], "k int, v string, ts timestamp, seq int")
    dim = od.versions(c, "k", "ts", ["v"], "seq")
    assert [(r.v, r.is_current) for r in dim.orderBy("valid_from").collect()] == [("a", False), (None, True)]
    facts = spark.createDataFrame([(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 3)), (1, datetime(2023, 1, 1))], "k int, at timestamp")
    assert [(r.v, r.valid_from is None) for r in od.as_of(facts, "k", "at", dim).orderBy("at").collect()] == [(None, True), ("a", False), (None, False)]


def test_shift_minutes_across_days(spark):
    rows = spark.createDataFrame([("m", datetime(2024, 1, 1, 23, 0), datetime(2024, 1, 2, 13, 0))], "m string, s timestamp, e timestamp")
    assert [r.minutes for r in od.shift_minutes(rows, ["m"], "s", "e").orderBy("shift_start").collect()] == [60.0, 720.0, 60.0]


def test_sections_and_cleaning(spark):
    text = "before\n# One\nbody `x` [a](b)\n##### five\n#### Four\n"
    out = rt.sections(spark.createDataFrame([(1, text), (2, None)], "d int, t string"), "d", "t").orderBy("d", "section").collect()
    assert [(r.heading, r.body) for r in out] == [("Overview", "before"), ("One", "body `x` [a](b)\n##### five"), ("Four", ""), ("Overview", "")]
    r = spark.range(1).select(rt.cleaned(F.lit("a ```code``` <b>x</b> [t](u)  *y*")).alias("c"), F.length(rt.cleaned(F.lit("z" * 7000))).alias("n")).first()
    assert (r.c, r.n) == ("a x t y", 6000)


def test_fallback_for_queries_without_hits(spark):
    chunks = spark.createDataFrame([("c1", "H", "apple pie"), ("c2", "Pie", "cake")], "c string, heading string, body string")
    q = spark.createDataFrame([(1, "pie"), (2, "?"), (3, "zebra")], "query_id long, question string")
    out = rt.with_fallback(lx.top(chunks, q, "c"), q, chunks, "c", 2).collect()
    assert [(r.c, r.rank) for r in out if r.query_id == 1][0] == ("c2", 1) and {r.query_id for r in out} == {1, 2, 3}


def test_lexical_top_equals_brute_force(spark, tmp_path):
    import random
    import re

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(f"c{i:03d}", text(1), text(r.randrange(0, 40))) for i in range(700)]
    asked = [(i, text(3)) for i in range(9)] + [(9, None), (10, "")]
    chunks, q = spark.createDataFrame(rows, "c string, heading string, body string").repartition(3), spark.createDataFrame(asked, "query_id long, question string")
    find = lambda t: set(re.findall(r"[a-z0-9_./+-]{2,}", t))
    want, sums = {}, {}
    for i, question in asked:
        hits = []
        for key, heading, body in rows:
            common = find(question or "") & find(f"{heading} {body}")
            if common:
                hits.append((sum(4 + (t in heading) for t in common) + min(3.0, len(body) / 1200), key))
        for n, (s, key) in enumerate(sorted(hits, key=lambda x: (-x[0], x[1]))[:4], 1):
            want[i, n] = (key, s)
        if hits:
            sums[i] = (len(hits), max(hits)[0], round(sum(s for s, _ in hits) * 1200))
    ranks = lambda found: {(x.query_id, x.rank): (x.c, x.score) for x in found.collect()}
    added = lambda found: {x.query_id: (x.chunks, x.best, round(x.total * 1200)) for x in found.collect()}
    assert ranks(lx.top(chunks, q, "c", 4)) == want and added(lx.totals(chunks, q, "c")) == sums
    for size, first, share in ((256, 2, 0.8), (10, 1, 0.5), (3, 0, 0.8), (5, 1, 1.0)):
        index = lx.build(chunks, "c", str(tmp_path / f"i{size}"), size)
        assert ranks(lx.search(index, q, 4, first, share)) == want
    assert added(lx.score_totals(index, q)) == sums
    assert lx.top(chunks.limit(0), q, "c").count() == 0 and lx.top(chunks, q.limit(0), "c").count() == 0
    assert lx.search(lx.build(chunks.limit(0), "c", str(tmp_path / "none")), q).count() == 0 and lx.search(index, q.limit(0)).count() == 0


def test_sections_of_odd_texts(spark):
    texts = ["# A\n# B\nx", "", "\n\n", "x\n## \ny\n", "#no\n#### D  ", "a\r\n# T\r\nb"]
    out = rt.sections(spark.createDataFrame(list(enumerate(texts)), "d int, t string"), "d", "t").collect()
    got = {}
    for r in out:
        got.setdefault(r.d, []).append((r.section, r.heading, r.body))
    assert got[0] == [(1, "A", ""), (2, "B", "x")] and got[1] == [(0, "Overview", "")] and got[2] == [(0, "Overview", "\n\n")]
    assert got[3] == [(0, "Overview", "x"), (1, "", "y\n")] and got[4] == [(0, "Overview", "#no"), (1, "D", "")] and [x[0] for x in got[5]] == [0, 1]


def test_nearest_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(120, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    q = df.filter("k % 20 = 0").select(F.col("k").alias("query_id"), "v")
    for block in (2, 2048):
        out = {(r.query_id, r.rank): r.k for r in rt.nearest(df, q, "k", "v", 3, block).collect()}
        n = v / np.linalg.norm(v, axis=1, keepdims=True)
        for i in range(0, 120, 20):
            assert [out[i, r] for r in (1, 2, 3)] == np.argsort(-(n @ n[i]))[:3].tolist()


def test_stream_restart_equals_batch(spark, tmp_path):
    schema = "event_id string, `table` string, event_ts timestamp, customer string, product string, amount double"
    rows = [(str(i), "orders" if i % 3 else "cart_events", datetime(2026, 1, 1, i % 24, i % 60), f"u{i % 4}", f"p{i}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    path, sink = str(tmp_path / "in"), cdc.VersionedSink(spark, str(tmp_path / "out"), ["customer"])
    for part in (df.limit(30), df):  # the first rows come again
        part.coalesce(1).write.mode("append").parquet(path)
        cdc.run_available(cdc.features(spark.readStream.schema(schema).parquet(path), None), sink, str(tmp_path / "check"))
    key = lambda x: sorted((r.customer, r.orders, r.order_amount, r.carts, r.last_product) for r in x.collect())
    assert key(sink.table()) == key(cdc.features(df, None))


def test_deletes_and_unresolved(spark):
    rows = spark.createDataFrame([("1", 1, "c"), ("1", 2, "d"), ("2", 1, "u")], "k string, ts int, op string")
    assert [r.k for r in cdc.latest_versions(rows, "k", "ts", "op").collect()] == ["2"]


def test_merge_in_any_order_of_arrival(spark, tmp_path):
    """Late older versions, deletes before what they delete, replayed batches, equal times."""
    schema = "k string, ts int, seq long, op string, v string"
    batches = [[("a", 2, 5, "u", "a2"), ("b", 9, 1, "d", None)], [("a", 1, 9, "u", "a1"), ("b", 8, 7, "u", "b8"), ("c", 1, 1, "c", "c1")], [("c", 1, 2, "u", "c2"), ("d", 1, 1, "c", "d1")], [("d", 2, 1, "d", None), ("d", 3, 1, "c", "d3")]]
    sink = cdc.MergeSink(spark, str(tmp_path / "merged"), "k", "ts", "seq")
    for n in (0, 1, 1, 2, 3, 3):
        sink(spark.createDataFrame(batches[n], schema), n)
    assert sorted((r.k, r.v) for r in sink.table().collect()) == [("a", "a2"), ("c", "c2"), ("d", "d3")]
    every = spark.createDataFrame(sum(batches, []), schema)
    assert sorted(sink.table().collect()) == sorted(cdc.latest_versions(every, "k", "ts", "seq").select(*sink.table().columns).collect())


def test_unresolved_are_counted_and_broker_values_decoded(spark, tmp_path):
    sink = cdc.UnresolvedSink(spark, str(tmp_path / "lost"), ["event_id"])
    sink(spark.createDataFrame([("1", "x", None), ("2", "x", "c")], "event_id string, kind string, customer string"), 0)
    sink(spark.createDataFrame([("3", "x", "c")], "event_id string, kind string, customer string"), 1)
    assert [r.event_id for r in sink.table().collect()] == ["1"] and sink.counts == {0: {"events": 2, "unresolved": 1}, 1: {"events": 1, "unresolved": 0}}
    raw = spark.createDataFrame([(b'{"event_id": "7", "table": "orders", "after": {"amount": 2.5}}',), (b"no json",), (b"{}",), (None,)], "value binary")
    assert [(r.event_id, r.table, r.after.amount, r.op) for r in cdc.decoded(raw).collect()] == [("7", "orders", 2.5, None)]


def test_bands(spark):
    r = spark.range(1).select(scores.risk_band(F.lit(0.72)).alias("a"), scores.risk_band(F.lit(0.4)).alias("b"), scores.drift_band(F.lit(0.25)).alias("c")).first()
    assert tuple(r) == ("high", "low", "medium")


def test_transaction_without_product_keeps_its_label(spark):
    txns = spark.createDataFrame([(1, "A", 1.0, 0), (2, None, 5.0, 1), (3, None, 5.0, 0)], "txn_id long, product string, amount double, label int")
    out = an.transaction_anomalies(txns, an.amount_statistics(txns)).collect()
    assert [(r.txn_id, r.product, r.anomaly_type) for r in out] == [(2, None, "synthetic_fraud_label")]


def test_as_of_keeps_facts_without_a_version(spark):
    facts = spark.createDataFrame([(1, 5), (1, 0), (9, 5)], "k long, at long")
    dim = spark.createDataFrame([(1, "a", 1, 4), (1, "b", 4, None)], "k long, v string, valid_from long, valid_to long")
    assert sorted((r.k, r.at, str(r.v)) for r in od.as_of(facts, "k", "at", dim).collect()) == [(1, 0, "None"), (1, 5, "b"), (9, 5, "None")]


def test_insert_if_absent_keeps_the_first_of_equal_keys(spark):
    old, new = spark.createDataFrame([(1, "old", 0)], "k long, v string, seq int"), spark.createDataFrame([(1, "x", 1), (2, "later", 3), (2, "first", 2)], "k long, v string, seq int")
    assert sorted(tuple(r)[:2] for r in ly.insert_if_absent(old, new, ["k"], "seq").collect()) == [(1, "old"), (2, "first")]


def test_upsert_of_equal_sequences_is_defined(spark):
    old, new = spark.createDataFrame([(1, "z", 1)], "k long, v string, seq int"), spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "k long, v string, seq int")
    assert [r.v for r in ly.upsert(old, new.repartition(2), ["k"], "seq").collect()] == ["b"]


def test_fixed_kmeans_equals_plain_version(spark):
    import random

    r = random.Random(1)
    rows = [(i, float(r.choice((0, 0, 0, r.randint(1, 900)))), float(r.randint(0, 20))) for i in range(200)]
    got = {x.key: x.cluster for x in sg.fixed_kmeans(spark.createDataFrame(rows, "key long, a double, b double"), ["a", "b"], "a", "key", k=3, rounds=12).collect()}
    top = [max(x[1] for x in rows), max(x[2] for x in rows)]
    points = {i: (a / top[0], b / top[1]) for i, a, b in rows}
    order = [x[0] for x in sorted(rows, key=lambda x: (x[1], x[0]))]
    centres = [points[order[min(199, i * (200 // 3))]] for i in range(3)]
    near = lambda p: min(range(3), key=lambda c: (sum((x - y) ** 2 for x, y in zip(p, centres[c])), c))
    for _ in range(12):
        groups = [[p for p in points.values() if near(p) == c] for c in range(3)]
        centres = [tuple(sum(x) / len(g) for x in zip(*g)) if g else c for g, c in zip(groups, centres)]
    assert got == {i: near(p) for i, p in points.items()}


def test_nearest_over_many_cells(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    asked = df.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in rt.nearest(df, asked, "id", "v", k=3, block=4, chunk=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(q, k + 1): int(i) for q in range(0, 60, 5) for k, i in enumerate(np.argsort(-(u[q] @ u.T))[:3])}
    assert rt.nearest(df.filter("id < 0"), asked, "id", "v").count() == 0


def test_sums_of_pairs_stay_where_the_chunks_are(spark, tmp_path):
    """Chunks travel once, by key; no sum by question and chunk does, and postings carry numbers instead of keys."""
    from millrace.plans import serving
    from tests.oracle import SF

    chunks, q = serving.chunks(spark, SF), serving.questions(spark, SF)
    plan = lx.scores(chunks, q, "chunk")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "hashpartitioning(query_id" not in plan
    few = spark.createDataFrame([("c1", "H", "apple pie")], "c string, heading string, body string")
    assert dict(lx.build(few, "c", str(tmp_path / "i")).table("postings").dtypes)["held"] == "array<bigint>"


def test_fallback_reads_no_chunks_without_need(spark):
    ranked = spark.createDataFrame([(1, "c1", 4.0, 1)], "query_id long, c string, score double, rank int")
    unread = spark.range(1).select(F.raise_error(F.lit("chunks were read")).cast("string").alias("c"))
    out = rt.with_fallback(ranked, spark.createDataFrame([(1, "pie")], "query_id long, question string"), unread, "c").collect()
    assert [tuple(r) for r in out] == [(1, "c1", 4.0, 1)]
