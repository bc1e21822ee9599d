from collections import Counter

import pytest

import __spark_entry__
from millrace.plans import catalog
from tests.oracle import SF, assert_same, connect


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_identity_scores_against_plain_version(spark):
    """Ratcliff-Obershelp, which SQL lacks, over the pairs that SQL states."""
    from difflib import SequenceMatcher

    from millrace.plans import matching

    people = {r[0]: r for r in connect().execute(matching.PEOPLE).fetchall()}
    columns = [x[0] for x in connect().execute(matching.PEOPLE).description]
    at = {c: columns.index(c) for c in columns}
    pairs = connect().execute(catalog.ORACLE_SQL["j06_identity_pairs"]).fetchall()
    want = {}
    for l, r in pairs:
        a, b = people[l], people[r]
        same = lambda c: a[at[c]] is not None and a[at[c]] == b[at[c]]
        sim = SequenceMatcher(None, a[at["name"]], b[at["name"]]).ratio()
        score = (0.5 if same("unified_key") else 0) + (0.25 * sim if sim >= 0.72 else 0) + sum(w for c, w in (("phone", 0.18), ("email", 0.18), ("dob", 0.12), ("postal", 0.08)) if same(c))
        if same("unified_key") or round(score, 3) >= 0.68:
            want[l, r] = min(score, 1.0)
    got = {(r.l_seq, r.r_seq): r.score for r in catalog.QUERIES["d09_identity_scores"](spark, SF).collect()}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 0.0006 for k in want)


def test_identity_scores_have_all_pairs_of_a_key(spark):
    from millrace.plans import matching

    key = dict(connect().execute(f"SELECT seq, unified_key FROM ({matching.PEOPLE}) WHERE unified_key IS NOT NULL").fetchall())
    rows = catalog.QUERIES["d09_identity_scores"](spark, SF).collect()
    got = {(r.l_seq, r.r_seq) for r in rows if r.action == "deterministic_merge_confirmed"}
    assert got == {(a, b) for a in key for b in key if a < b and key[a] == key[b]}


def test_cluster_labels_follow_clusters(spark):
    """Three labels at most, one for each cluster, in order of the clusters' mean spend; ranks count the labels."""
    cluster = {r.customer: r.cluster for r in catalog.QUERIES["m01_fixed_kmeans"](spark, SF).collect()}
    label = {r.customer: r.segment for r in catalog.QUERIES["m03_cluster_labels"](spark, SF).collect()}
    assert set(label) == set(cluster) and len({(cluster[c], label[c]) for c in cluster}) == len(set(label.values())) == len(set(cluster.values()))
    counts = {r.segment: r.customers for r in catalog.QUERIES["w02_cluster_ranks"](spark, SF).collect()}
    assert counts == dict(Counter(label.values()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
