"""Unit cases of the rules, and random graphs against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from driftset.functions import shared
from driftset.operators import graph as G
from driftset.operators import regions as C
from driftset.operators import repair as R
from driftset.operators import updates as U
from driftset.operators.components import components
from driftset.operators.lfmis import independence_violations, lfmis, maximality_violations
from driftset.operators.sequential import apply_batch_sequential, fold


def edges_df(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src bigint, dst bigint")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def updates_df(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "batch_id int, seq bigint, src bigint, dst bigint, op string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def valid(state):
    return not independence_violations(state.edges, state.mis).count() and not maximality_violations(state.vertices, state.edges, state.mis).count()


# name, vertices, edges, members, toggles, expected
CASES = [
    ("evict", [1, 2, 3, 4], [(1, 3), (2, 4)], [1, 2], [(1, 2)], [2, 3]),
    ("two freed, adjacent", [1, 2, 3, 4], [(1, 3), (1, 4), (3, 4)], [1, 2], [(1, 2)], [2, 3]),
    ("insert, one member", [1, 2, 3], [(1, 2)], [1, 3], [(2, 3)], [1, 3]),
    ("insert, no member", [1, 2, 3, 4], [(1, 2), (3, 4)], [1, 3], [(2, 4)], [1, 3]),
    ("delete, joins", [1, 2], [(1, 2)], [1], [(1, 2)], [1, 2]),
    ("delete, blocked", [1, 2, 3], [(1, 2), (2, 3)], [1, 3], [(1, 2)], [1, 3]),
    ("delete, no member", [1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)], [1, 4], [(2, 3)], [1, 4]),
    ("chain insert", [1, 2, 3], [], [1, 2, 3], [(1, 2), (2, 3)], [1, 3]),
    ("double toggle", [1, 2], [(1, 2)], [1], [(1, 2), (1, 2)], [1]),
    ("empty batch", [1, 2], [(1, 2)], [1], [], [1]),
]


@pytest.mark.parametrize("name,vs,es,ms,ups,expected", CASES, ids=[c[0] for c in CASES])
def test_unit_cases(spark, name, vs, es, ms, ups, expected):
    state = R.State(ids_df(spark, vs), edges_df(spark, es), ids_df(spark, ms))
    ok, rejected = U.split_valid(updates_df(spark, [(*u, None) for u in ups]), state.vertices)
    after = R.apply_batch(state, U.net_toggle(ok, state.edges))
    assert ids(after.mis) == expected and valid(after) and rejected.count() == 0


def test_rejects(spark):
    _, bad = U.split_valid(updates_df(spark, [(2, 2, None), (1, 999, None), (7, None, None)]), ids_df(spark, [1, 2, 7]))
    assert sorted(r.reason for r in bad.collect()) == ["missing endpoint", "self-loop", "unknown vertex"]


def test_explicit_last_wins_and_noop(spark):
    e = edges_df(spark, [(1, 2)])
    ups = updates_df(spark, [(1, 2, "D"), (1, 2, "I"), (1, 3, "I"), (1, 3, "D"), (2, 3, "I")])
    assert [tuple(r) for r in U.net_explicit(ups, e).collect()] == [(2, 3, "I")]


def random_graph(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def greedy(n, es, key=lambda x: x):
    adj = {i: set() for i in range(n)}
    for a, b in es:
        adj[a].add(b)
        adj[b].add(a)
    out = set()
    for v in sorted(range(n), key=lambda x: (key(x), x)):
        if not adj[v] & out:
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("local", [0, 10, 10**6])
def test_lfmis_is_the_greedy(spark, local):
    rng = random.Random(local)
    es = random_graph(rng, 60, 120)
    v, e = ids_df(spark, range(60)), edges_df(spark, es)
    assert ids(lfmis(v, e, local_edges=local)) == greedy(60, es)
    assert ids(lfmis(v, e, G.lcg(F.col("id")), local)) == greedy(60, es, lambda x: (x * 1103515245 + 12345) % 2147483648)


def test_lfmis_without_edges(spark):
    assert ids(lfmis(ids_df(spark, [3, 1]), edges_df(spark, []))) == [1, 3]


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(5)
    es = random_graph(rng, 80, 60) + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(es, "a bigint, b bigint"), local).collect()}
    root = {x: x for p in es for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in es:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("seed,evict", [(1, "min"), (2, "max")])
def test_batch_keeps_the_set_valid(spark, seed, evict):
    rng = random.Random(seed)
    es = random_graph(rng, 50, 70)
    v, e = ids_df(spark, range(50)), edges_df(spark, es)
    state = R.State(v, e, ids_df(spark, greedy(50, es)))
    ups = [tuple(sorted(rng.sample(range(50), 2))) for _ in range(12)] + rng.sample(es, 8)
    after = R.apply_batch(state, U.net_toggle(updates_df(spark, [(*u, None) for u in ups]), e), evict)
    assert valid(after)
    assert R.case_of(U.net_toggle(updates_df(spark, [(*u, None) for u in ups]), e), state.mis).where("lemma = 'L6'").count() == 0


def test_growth(spark):
    state = R.State(ids_df(spark, [1, 2]), edges_df(spark, [(1, 2)]), ids_df(spark, [1]))
    net = spark.createDataFrame([(1, 3, "I")], "src bigint, dst bigint, op string")
    after = R.apply_batch(state, net, grow=ids_df(spark, [3, 4]))
    assert ids(after.mis) == [1, 4] and valid(after)


def test_regions_fold_like_the_whole(spark):
    rng = random.Random(9)
    es = [(i, i + 1) for i in range(0, 120) if i % 10 != 9]
    v, e = ids_df(spark, range(121)), edges_df(spark, es)
    members = set(greedy(121, es))
    ups = [(i, *u) for i, u in enumerate(rng.sample(es, 6) + [(5, 25), (64, 83)])]
    adj = {}
    for a, b in es:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    whole = set(members)
    fold([(s, a, b, None) for s, a, b in ups], adj, whole)
    rows = updates_df(spark, [(a, b, None) for _, a, b in ups])
    state = R.State(v, e, ids_df(spark, members))
    after = apply_batch_sequential(state, rows, G.apply_net(e, U.net_toggle(rows, e)))
    assert ids(after.mis) == sorted(whole) and valid(after)


def test_every_update_has_one_region(spark):
    e = edges_df(spark, [(1, 2), (2, 3), (10, 11)])
    ups = updates_df(spark, [(1, 2, None), (3, 10, None), (10, 11, None), (50, 60, None)])
    regions, vertices = C.conflict_free_regions(ups, e)
    assert sorted((r.seq, r.cluster_id) for r in regions.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert C.assign_by_endpoint(ups, vertices).where("cluster_id is null").count() == 0


def test_ranks_and_offsets(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 2147483648) for i in range(500)], "src bigint, k bigint").withColumn("dst", F.col("src"))
    got = [r.src for r in G.rank_by(rows, "k", ["src"]).orderBy("rank").collect()]
    assert got == sorted(range(500), key=lambda i: ((i * 7919) % 2147483648, i))


def test_lead_across_ranges(spark):
    keys = [1, 2, 70, 71, 500, 501, 502, 9000]
    got = G.ordered_lead(spark.createDataFrame([(k, k * 10) for k in keys], "k bigint, v bigint").repartition(3), "k", "v", width=64)
    assert {r.k: r.next for r in got.collect()} == {a: b and b * 10 for a, b in zip(keys, [*keys[1:], None])}


def test_mixed_operations(spark):
    e = edges_df(spark, [(1, 2), (3, 4), (7, 8)])
    ups = updates_df(spark, [
        (1, 2, "D"), (1, 2, None),  # back again
        (3, 4, None), (3, 4, None), (3, 4, None),  # gone
        (5, 6, None), (5, 6, "I"),  # there
        (7, 8, "I"), (7, 8, None),  # gone
        (8, 9, "I"), (8, 9, "D"),  # never there
    ])
    assert sorted(map(tuple, U.net_ops(ups, e, "mixed").collect())) == [(3, 4, "D"), (5, 6, "I"), (7, 8, "D")]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {"a": 1}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_a_batch_does_not_shuffle_the_graph(spark):
    """With a small batch the graph is only scanned: no exchange of it, no aggregate over it."""
    n = 2000
    shared.materialise(spark.range(1), "unused")
    edges = shared.materialise(spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), "edges")
    state = R.State(spark.range(n + 1), edges, shared.materialise(lfmis(spark.range(n + 1), edges), "mis"))
    net = shared.materialise(U.net_toggle(updates_df(spark, [(4, 9, None)]), edges), "net")
    plan = R.apply_batch(state, net).edges._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "hashpartitioning(src" not in plan
