"""As-of joins by merge, dimensions in batches, tables along a curve: against plain versions."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import orders as od
from millrace.operators.baselines import Baselines
from millrace.operators.dimensions import Dimension
from millrace.sources import clustering as cl

START = datetime(2025, 1, 1)
CHANGES = "k long, ts timestamp, seq long, v string, w long"


def random_dimension(r):
    """Intervals that don't overlap, some with gaps between, some open."""
    out = []
    for k in range(6):
        t = r.randint(0, 10)
        while t < 200 and r.random() < 0.9:
            end = t + r.randint(0, 40)
            out.append((k, f"{k}-{t}-{end}", t, end))
            t = end + (r.randint(0, 10) if r.random() < 0.3 else 0)
        if r.random() < 0.5:
            out.append((k, f"{k}-{t}-", t, None))
    return out


@pytest.mark.parametrize("most", [1_000_000, 40, 7, 1])
def test_as_of_equals_plain_version_however_keys_are_cut(spark, most):
    r = random.Random(most)
    dim = random_dimension(r) + [(None, "no key", 0, None), (1, "no start", None, None)]
    facts = [(i, r.choice((0, 0, 0, 1, 2, 3, 4, 5, 9, None)), None if r.random() < 0.05 else r.randint(-5, 260)) for i in range(400)]
    got = od.as_of(spark.createDataFrame(facts, "id long, k long, at long").repartition(3), "k", "at", spark.createDataFrame(dim, "k long, v string, valid_from long, valid_to long"), most)
    assert got.columns == ["id", "k", "at", "v", "valid_from", "valid_to"]

    def valid(k, at):
        found = [(f, e is None, e, v) for kk, v, f, e in dim if None not in (k, at, kk, f) and kk == k and f <= at and (e is None or at < e)]
        return max(found)[3] if found else None

    assert Counter((x.id, x.v) for x in got.collect()) == Counter((i, valid(k, at)) for i, k, at in facts)


def test_as_of_with_clashing_names_and_no_rows(spark):
    facts = spark.createDataFrame([(1, 5, "f")], "_key long, at long, cut string")
    dim = spark.createDataFrame([(1, "x", 0, None)], "_key long, held string, valid_from long, valid_to long")
    assert [r.held for r in od.as_of(facts, "_key", "at", dim).collect()] == ["x"]
    assert od.as_of(facts.limit(0), "_key", "at", dim).count() == 0
    assert [r.held for r in od.as_of(facts, "_key", "at", dim.limit(0)).collect()] == [None]


def test_many_versions_and_facts_of_one_key_are_no_product(spark):
    """50,000 versions and as many facts: a product would be 2.5 billion pairs."""
    n = 50_000
    dim = spark.range(n).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("v"), F.col("id").alias("valid_from"), (F.col("id") + 1).alias("valid_to"))
    facts = spark.range(n).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("at"))
    got = od.as_of(facts, "k", "at", dim, most=10_000).agg(F.count(F.lit(1)), F.count_if(F.col("v") == F.col("at"))).first()
    assert tuple(got) == (n, n)


def changes(r, n):
    return [(r.randrange(5), START + timedelta(days=r.randrange(40)), i, r.choice("ab"), r.choice((1, None))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_the_full_rebuild(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = changes(r, 60)
    every = spark.createDataFrame(rows, CHANGES)
    r.shuffle(rows)
    cuts = [rows[:25], [], rows[25:26], rows[26:]]
    dim = Dimension(spark, str(tmp_path), "k", "ts", "seq", ["v", "w"], CHANGES, buckets=3)
    assert dim.table().count() == 0
    for n, part in enumerate(cuts):
        for _ in range(2 if n == 3 else 1):  # a batch that is applied again changes nothing
            dim.apply(spark.createDataFrame([*part, (None, START, 1, "x", 1), (1, None, 1, "x", 1)], CHANGES), n)
    want = od.versions(every, "k", "ts", ["v", "w"], "seq")
    assert Counter(map(tuple, dim.table().collect())) == Counter(map(tuple, want.select(*dim.table().columns).collect()))


def test_late_change_splits_and_equal_neighbours_merge(spark, tmp_path):
    dim = Dimension(spark, str(tmp_path), "k", "ts", "seq", ["v", "w"], CHANGES)
    day = lambda n: START + timedelta(days=n)
    show = lambda: [(r.v, (r.valid_from - START).days, r.valid_to and (r.valid_to - START).days) for r in dim.table().orderBy("valid_from").collect()]
    dim.apply(spark.createDataFrame([(1, day(1), 1, "a", 1), (1, day(9), 2, "a", 1)], CHANGES), 0)
    assert show() == [("a", 1, None)]
    dim.apply(spark.createDataFrame([(1, day(5), 3, "b", 1)], CHANGES), 1)
    assert show() == [("a", 1, 5), ("b", 5, 9), ("a", 9, None)]
    dim.apply(spark.createDataFrame([(1, day(5), 3, "a", 1)], CHANGES), 2)  # a correction
    assert show() == [("a", 1, None)]


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    dim = Dimension(spark, str(tmp_path), "k", "ts", "seq", ["v", "w"], CHANGES, buckets=16)
    dim.apply(spark.createDataFrame([(k, START, 1, "a", 1) for k in range(40)], CHANGES), 0)
    dim.apply(spark.createDataFrame([(7, START + timedelta(1), 2, "b", 1)], CHANGES), 1)
    assert len(list((tmp_path / "versions" / "batch=1").glob("bucket=*"))) == 1
    assert dim.table().count() == 41


def test_ranks_and_curve_equal_plain_version(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 50), r.choice(("x", "yy", None, "z")), r.random() if r.random() < 0.9 else None) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    bounds = cl.range_bounds(df, ["a", "b", "c"], 3)
    assert all(len(v) <= 7 for v in bounds.values())
    got = cl.with_curve_key(df, ["a", "b", "c"], 3, bounds).collect()
    for x in got:
        ranks = [0 if x[c] is None else sum(b < x[c] for b in bounds[c]) for c in "abc"]
        assert x.curve_key == int("".join(str(rank >> b & 1) for b in (2, 1, 0) for rank in ranks), 2)


def test_lookups_by_either_column_skip_most_files(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.randrange(1000), r.randrange(1000), "x") for _ in range(8000)]
    src, to, line = (str(tmp_path / n) for n in ("in", "curve", "line"))
    spark.createDataFrame(rows, "a long, b long, c string").write.parquet(src)
    cl.cluster(spark, src, to, ["a", "b"], 64)
    spark.read.parquet(src).repartitionByRange(64, "a").write.parquet(line)
    table, sorted_table = spark.read.parquet(to), spark.read.parquet(line)
    assert Counter(map(tuple, table.collect())) == Counter(rows)
    for column in "ab":
        assert max(cl.files_with(table, column, v) for v in (3, 500, 997)) <= 20
    assert cl.files_with(sorted_table, "b", 500) >= 60


def test_one_value_of_most_rows_fills_several_files(spark, tmp_path):
    src, to = str(tmp_path / "in"), str(tmp_path / "curve")
    spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("a"), F.col("id").alias("b")).write.parquet(src)
    cl.cluster(spark, src, to, ["a", "b"], 16)
    sizes = [r["count"] for r in spark.read.parquet(to).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 1000 and sum(sizes) == 4000


def test_curve_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert cl.range_bounds(df, ["a", "b"], 4) == {"a": [], "b": []}
    assert cl.with_curve_key(df, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        cl.curve_key([F.lit(1)] * 8, 8)


def moments(values):
    known = [v for v in values if v is not None]
    if not known:
        return None, None
    mean = sum(known) / len(known)
    return mean, (sum((v - mean) ** 2 for v in known) / len(known)) ** 0.5


@pytest.mark.parametrize("seed,cuts", [(1, (20,)), (2, (5, 6, 7, 30)), (3, (1, 2, 3))])
def test_grown_baselines_equal_all_days_at_once(spark, tmp_path, seed, cuts):
    r = random.Random(seed)
    days = {(k, n): (r.random() * 5 if r.random() < 0.9 else None, float(r.choice((0, 7)))) for k in range(7) for n in range(40) if r.random() < (0.1 if k == 6 else 0.6)}
    base = Baselines(spark, str(tmp_path), ["k"], "day", ["a", "b"])
    with pytest.raises(ValueError):
        base.latest()
    edges = [0, *cuts, 40]
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        rows = [(k, n, *v) for (k, n), v in days.items() if lo <= n < hi]
        for _ in range(2 if number else 1):
            base.update(spark.createDataFrame(rows, "k long, day int, a double, b double").repartition(3), number)
    want = {}
    for k in range(7):
        own = sorted(n for kk, n in days if kk == k)
        if len(own) > 3:
            want[k] = (own[-1], len(own) - 1, *days[k, own[-1]], *moments([days[k, n][0] for n in own[:-1]]), *moments([days[k, n][1] for n in own[:-1]]))
    got = {x.k: (x.day, x.n_before, x.a, x.b, x.a_mean, x.a_std, x.b_mean, x.b_std) for x in base.latest().collect()}
    assert set(got) == set(want)
    for k in want:
        assert all(g is w is None or abs(g - w) < 1e-9 for g, w in zip(got[k], want[k]))
