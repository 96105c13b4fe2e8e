"""Registered queries of the graph engine, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions import metrics as M
from driftset.functions.shared import fresh_path, materialise
from driftset.operators import graph as G
from driftset.operators import regions as C
from driftset.operators import repair as R
from driftset.operators import updates as U
from driftset.operators.lfmis import independence_violations, lfmis, maximality_violations
from driftset.operators.sequential import apply_batch_sequential
from driftset.plans import fixtures as X
from driftset.streaming.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


_G = X.sql_graph()
_S = (_G, X.sql_split())
_N = (*_S, X.sql_net())
_R = (*_N, X.sql_repair())


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, base edges and updates of the mixed stream on the grid, materialised once."""
    v, e = X.graph(spark, d)
    base, ups = X.split_mix(materialise(e, "graph"))
    return v, materialise(base, "base"), materialise(ups, "updates")


def _batch(spark: SparkSession, d: str) -> tuple[R.State, DataFrame, DataFrame]:
    v, base, ups = _base(spark, d)
    first = ups.where("batch_id = 0")
    return R.State(v, base, materialise(lfmis(v, base, closed=True), "mis")), first, materialise(U.net_toggle(first, base), "net")


# ------------------------------------------------------------ graph storage

for _name in ("grid", "returns_chain", "co_purchase", "part_supplier"):
    query(_with(X.sql_graph(_name)) + "SELECT src, dst FROM e", "canonical_edges" if _name == "grid" else f"canonical_edges_{_name}")(
        lambda spark, d, n=_name: X.graph(spark, d, n)[1])


@query(_with(_G) + "SELECT a, b FROM adj")
def symmetric_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.symmetrise(X.graph(spark, d)[1])


@query(_with(X.sql_graph("part_supplier")) + "SELECT a AS id, count(*) AS degree FROM adj GROUP BY a")
def vertex_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(X.graph(spark, d, "part_supplier")[1])


@query(_with(_G) + """SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", degree
FROM (SELECT v.id, count(a.b)::BIGINT AS degree FROM v LEFT JOIN adj a ON a.a = v.id GROUP BY v.id)""")
def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return G.csr_offsets(*X.graph(spark, d))


@query(_with(_G) + "SELECT a AS id, string_agg(b::VARCHAR, ',' ORDER BY b) AS neighbors FROM adj GROUP BY a")
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency_lists(X.graph(spark, d)[1]).select("id", F.concat_ws(",", F.transform("neighbors", lambda x: x.cast("string"))).alias("neighbors"))


@query(_with(_G) + "SELECT id FROM v WHERE id NOT IN (SELECT a FROM adj)")
def isolated_vertices(spark: SparkSession, d: str) -> DataFrame:
    v, e = X.graph(spark, d)
    return v.join(G.symmetrise(e).select(F.col("a").alias("id")), "id", "left_anti")


# ------------------------------------------------------------ preparation


@query(_with(*_S) + "SELECT src, dst FROM base")
def base_split(spark: SparkSession, d: str) -> DataFrame:
    return X.split_mix(materialise(X.graph(spark, d)[1], "graph"))[0]


@query(_with(*_S) + "SELECT batch_id, seq, src, dst FROM ups")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return X.split_mix(materialise(X.graph(spark, d)[1], "graph"))[1].drop("op")


@query(_with(_G, X.sql_split(False)) + "SELECT batch_id, seq, src, dst, NOT EXISTS (SELECT 1 FROM base b WHERE b.src = u.src AND b.dst = u.dst) AS inserts FROM ups u")
def reverse_split_chunks(spark: SparkSession, d: str) -> DataFrame:
    base, ups = X.reverse_split(materialise(X.graph(spark, d)[1], "graph"))
    return G.is_adjacent(ups, base).select("batch_id", "seq", "src", "dst", (~F.col("adjacent")).alias("inserts"))


@query(_with(*_S) + """, n AS (SELECT max(batch_id) + 1 AS b, max(seq) + 1 AS s FROM ups)
SELECT batch_id, seq, src, dst FROM ups UNION ALL SELECT (batch_id + b)::INTEGER, seq + s, src, dst FROM ups, n""")
def concatenated_chunks(spark: SparkSession, d: str) -> DataFrame:
    ups = _base(spark, d)[2]
    return U.concatenated(ups, ups).select("batch_id", "seq", "src", "dst")


# ------------------------------------------------------------ batch analysis


@query(_with(*_S) + "SELECT DISTINCT batch_id, id FROM (SELECT batch_id, src AS id FROM ups UNION ALL SELECT batch_id, dst FROM ups)")
def batch_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return U.endpoints(_base(spark, d)[2])


@query(_with(*_S) + "SELECT batch_id, seq, u.src, u.dst, CASE WHEN b.src IS NULL THEN 'I' ELSE 'D' END AS op FROM ups u LEFT JOIN base b ON b.src = u.src AND b.dst = u.dst")
def op_classify(spark: SparkSession, d: str) -> DataFrame:
    _, base, ups = _base(spark, d)
    return U.classify(ups, base).select("batch_id", "seq", "src", "dst", "op")


@query(_with(*_N) + "SELECT src, dst, op FROM net")
def net_toggle_ops(spark: SparkSession, d: str) -> DataFrame:
    return _batch_net(spark, d)[1]


def _batch_net(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, base, ups = _base(spark, d)
    return base, U.net_toggle(ups.where("batch_id = 0"), base)


_TOGGLES = """t AS (SELECT o_orderkey AS seq, least(u, w) AS src, greatest(u, w) AS dst FROM (
  SELECT o_orderkey, o_custkey AS u, lead(o_custkey) OVER (ORDER BY o_orderkey) AS w FROM orders WHERE o_orderstatus = 'O') WHERE u <> w)"""


@query(_with(X.sql_graph("customer_seq"), _TOGGLES) + """SELECT seq::BIGINT AS seq, t.src::BIGINT AS src, t.dst::BIGINT AS dst,
  CASE WHEN (e.src IS NOT NULL) = (row_number() OVER (PARTITION BY t.src, t.dst ORDER BY seq) % 2 = 1) THEN 'D' ELSE 'I' END AS op
FROM t LEFT JOIN e ON e.src = t.src AND e.dst = t.dst""")
def toggle_effects(spark: SparkSession, d: str) -> DataFrame:
    _, e = X.graph(spark, d, "customer_seq")
    ups = spark.sql("WITH " + _TOGGLES.replace("FROM orders", "FROM {orders}") + " SELECT 0 AS batch_id, seq, src, dst FROM t", orders=X.table(spark, d, "orders"))
    return U.presence_before(ups, e).select(*[F.col(c).cast("bigint").alias(c) for c in ("seq", "src", "dst")], "op")


_EVENTS = """ev AS (SELECT event_id AS seq, least(u, w)::BIGINT AS src, greatest(u, w)::BIGINT AS dst, op FROM (
  SELECT event_id, user_id AS u, lead(user_id) OVER (ORDER BY event_id) AS w,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'I' WHEN event_type = 'error' THEN 'D' END AS op FROM events) WHERE u <> w)"""


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base, _ = X.split_mix(materialise(X.graph(spark, d, "user_seq")[1], "graph"))
    return base, X.event_ops(spark, d).withColumns({c: F.col(c).cast("bigint") for c in ("src", "dst")})


@query(_with(X.sql_graph("user_seq"), X.sql_split(), _EVENTS) + """SELECT l.src, l.dst, l.op FROM (SELECT src, dst, max_by(op, seq) AS op FROM ev WHERE op IS NOT NULL GROUP BY src, dst) l
LEFT JOIN base b ON b.src = l.src AND b.dst = l.dst WHERE (l.op = 'I') <> (b.src IS NOT NULL)""")
def net_explicit_ops(spark: SparkSession, d: str) -> DataFrame:
    base, ups = _events(spark, d)
    return U.net_explicit(ups, base).select("src", "dst", "op")


@query(_with(X.sql_graph("user_seq"), X.sql_split(), _EVENTS) + """, la AS (SELECT src, dst, max(seq) FILTER (op IS NOT NULL) AS at, max_by(op, seq) FILTER (op IS NOT NULL) AS op FROM ev GROUP BY src, dst),
en AS (SELECT la.src, la.dst, b.src IS NOT NULL AS was, coalesce(la.op = 'I', b.src IS NOT NULL)
         <> ((SELECT count(*) FROM ev WHERE ev.src = la.src AND ev.dst = la.dst AND ev.op IS NULL AND (la.at IS NULL OR ev.seq > la.at)) % 2 = 1) AS there
       FROM la LEFT JOIN base b ON b.src = la.src AND b.dst = la.dst)
SELECT src, dst, CASE WHEN there THEN 'I' ELSE 'D' END AS op FROM en WHERE there <> was""".replace(", la AS", "\n, la AS", 1))
def net_mixed_ops(spark: SparkSession, d: str) -> DataFrame:
    base, ups = _events(spark, d)
    return U.net_mixed(ups, base).select("src", "dst", "op")


@query("""SELECT (event_day - min(event_day) OVER ())::INTEGER AS batch_id, count(*) FILTER (kind = 'I') AS n_insert, count(*) FILTER (kind = 'D') AS n_delete, count(*) FILTER (kind = 'T') AS n_toggle
FROM (SELECT ts::DATE AS event_day, CASE WHEN event_type IN ('signup', 'purchase') THEN 'I' WHEN event_type = 'error' THEN 'D' ELSE 'T' END AS kind, user_id AS u,
             lead(user_id) OVER (ORDER BY event_id) AS w FROM events) WHERE u <> w GROUP BY event_day""")
def event_batches(spark: SparkSession, d: str) -> DataFrame:
    op = F.coalesce("op", F.lit("T"))
    return X.event_ops(spark, d).groupBy("batch_id").agg(*[F.count_if(op == k).alias(n) for k, n in (("I", "n_insert"), ("D", "n_delete"), ("T", "n_toggle"))])


@query(_with(*_N) + "SELECT src, dst FROM after")
def graph_after_batch(spark: SparkSession, d: str) -> DataFrame:
    return G.apply_net(*_batch_net(spark, d))


@query(_with(*_N) + "SELECT (SELECT count(*) FROM base) AS before, (SELECT count(*) FROM after) AS after")
def edge_count_after_batch(spark: SparkSession, d: str) -> DataFrame:
    base, net = _batch_net(spark, d)
    change = net.agg((F.count_if(F.col("op") == "I") - F.count_if(F.col("op") == "D")).alias("c"))
    n = base.count()
    return change.select(F.lit(n).cast("bigint").alias("before"), (F.lit(n) + F.col("c")).cast("bigint").alias("after"))


@query(_with(*_S) + "SELECT u.src, u.dst, b.src IS NOT NULL AS adjacent FROM ups u LEFT JOIN base b ON b.src = u.src AND b.dst = u.dst")
def is_adjacent_probe(spark: SparkSession, d: str) -> DataFrame:
    _, base, ups = _base(spark, d)
    return G.is_adjacent(ups.select("src", "dst"), base)


_SEEDS = "sd AS (SELECT DISTINCT id FROM (SELECT src AS id FROM ups WHERE batch_id = 0 UNION ALL SELECT dst FROM ups WHERE batch_id = 0)), badj AS (SELECT src AS a, dst AS b FROM base UNION ALL SELECT dst, src FROM base)"
_HOPS = "h1 AS (SELECT s.id AS seed, a.b AS id FROM sd s JOIN badj a ON a.a = s.id), h2 AS (SELECT h1.seed, a.b AS id FROM h1 JOIN badj a ON a.a = h1.id)"


def _hops(spark: SparkSession, d: str, hops: int) -> DataFrame:
    _, base, ups = _base(spark, d)
    seeds = U.endpoints(ups.where("batch_id = 0")).select(F.col("id").alias("seed"), "id")
    return C.hop_neighborhood(seeds, base, hops, ["seed"]).select("seed", "id", F.col("hop").cast("bigint").alias("hop"))


@query(_with(*_S, _SEEDS, _HOPS) + "SELECT seed, id, min(hop)::BIGINT AS hop FROM (SELECT id AS seed, id, 0 AS hop FROM sd UNION ALL SELECT seed, id, 1 FROM h1) GROUP BY seed, id")
def hop1_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d, 1)


@query(_with(*_S, _SEEDS, _HOPS) + "SELECT seed, id, min(hop)::BIGINT AS hop FROM (SELECT id AS seed, id, 0 AS hop FROM sd UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) GROUP BY seed, id")
def hop2_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d, 2)


_AREA = """u0 AS (SELECT * FROM ups WHERE batch_id = 0),
ue AS (SELECT src, dst FROM base UNION SELECT src, dst FROM u0), uadj AS (SELECT src AS a, dst AS b FROM ue UNION ALL SELECT dst, src FROM ue),
a0 AS (SELECT seq, src AS id FROM u0 UNION SELECT seq, dst FROM u0),
a1 AS (SELECT DISTINCT a0.seq, x.b AS id FROM a0 JOIN uadj x ON x.a = a0.id),
a2 AS (SELECT DISTINCT a1.seq, x.b AS id FROM a1 JOIN uadj x ON x.a = a1.id),
ar AS (SELECT seq, id, min(hop) AS hop FROM (SELECT seq, id, 0 AS hop FROM a0 UNION ALL SELECT seq, id, 1 FROM a1 UNION ALL SELECT seq, id, 2 FROM a2) GROUP BY seq, id)"""
_CFR = """lk AS (SELECT DISTINCT x.seq AS a, y.seq AS b FROM ar x JOIN ar y ON x.id = y.id),
rc AS (SELECT seq, seq AS r FROM u0 UNION SELECT rc.seq, lk.b FROM rc JOIN lk ON lk.a = rc.r),
ec AS (SELECT seq, min(r) AS cluster_id FROM rc GROUP BY seq)"""


@query(_with(*_S, _AREA) + "SELECT seq, id, hop::BIGINT AS hop FROM ar")
def edge_affected_area(spark: SparkSession, d: str) -> DataFrame:
    _, base, ups = _base(spark, d)
    first = ups.where("batch_id = 0")
    return C.affected_area(first, C.with_batch(base, first)).select("seq", "id", F.col("hop").cast("bigint").alias("hop"))


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, base, ups = _base(spark, d)
    first = materialise(ups.where("batch_id = 0"), "batch")
    return (first, *C.conflict_free_regions(first, base))


@query(_with(*_S, _AREA, _CFR) + "SELECT seq, cluster_id FROM ec")
def cfr_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d)[1].select("seq", "cluster_id")


@query(_with(*_S, _AREA, _CFR) + "SELECT cluster_id, count(*) AS n_updates FROM ec GROUP BY cluster_id")
def cfr_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_sizes(_regions(spark, d)[1]).drop("batch_id")


@query(_with(*_S, _AREA, _CFR) + "SELECT 0::INTEGER AS batch_id, count(DISTINCT cluster_id) AS n_regions, count(*) AS n_updates, count(*) // count(DISTINCT cluster_id) AS per_region FROM ec")
def cfr_region_average(spark: SparkSession, d: str) -> DataFrame:
    return C.region_average(_regions(spark, d)[1])


@query(_with(*_S, _AREA, _CFR) + "SELECT DISTINCT ar.id, ec.cluster_id FROM ar JOIN ec USING (seq)")
def vertex_to_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d)[2].select("id", "cluster_id")


@query(_with(*_S, _AREA, _CFR) + "SELECT u0.seq, ec.cluster_id FROM u0 JOIN ar ON ar.seq = u0.seq AND ar.id = u0.src JOIN ec ON ec.seq = u0.seq")
def edge_to_cluster(spark: SparkSession, d: str) -> DataFrame:
    first, _, vertices = _regions(spark, d)
    return C.assign_by_endpoint(first, vertices).select("seq", "cluster_id")


@query(_with(*_S, _AREA, _CFR) + """, big AS (SELECT cluster_id FROM ec GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1),
bv AS (SELECT DISTINCT ar.id FROM ar JOIN ec USING (seq) WHERE cluster_id IN (SELECT cluster_id FROM big))
SELECT batch_id, seq, src, dst FROM ups WHERE src IN (SELECT id FROM bv) OR dst IN (SELECT id FROM bv)""".replace("\n,", ",", 1))
def cluster_incident_edges(spark: SparkSession, d: str) -> DataFrame:
    _, base, ups = _base(spark, d)
    first = materialise(ups.where("batch_id = 0"), "batch")
    edges, vertices = C.conflict_free_regions(first, base)
    big = C.cluster_sizes(edges).orderBy(F.desc("n_updates"), "cluster_id").limit(1).select("cluster_id")
    return C.incident_updates(vertices.join(big, "cluster_id", "left_semi"), ups).select("batch_id", "seq", "src", "dst")


# ------------------------------------------------------------ independent sets

for _name in ("grid", "returns_chain", "co_purchase", "customer_seq"):
    query(_with(X.sql_graph(_name), X.sql_lfmis("s", "v", "adj")) + "SELECT id FROM s", "lfmis_id" if _name == "grid" else f"lfmis_id_{_name}")(
        lambda spark, d, n=_name: lfmis(*X.graph(spark, d, n), closed=True))
query(_with(_G, X.sql_lfmis("s", "v", "adj", "(id * 1103515245 + 12345) % 2147483648")) + "SELECT id FROM s", "lfmis_lcg")(
    lambda spark, d: lfmis(*X.graph(spark, d), G.lcg(F.col("id")), closed=True))


@query(_with(_G, X.sql_lfmis("s", "v", "adj")) + "SELECT count(*) AS mis_size FROM s")
def mis_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return M.cardinality(lfmis(*X.graph(spark, d), closed=True))


@query(_with(_G, X.sql_lfmis("s", "v", "adj")) + "SELECT src, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def independence_check(spark: SparkSession, d: str) -> DataFrame:
    v, e = X.graph(spark, d)
    return independence_violations(e, materialise(lfmis(v, e, closed=True), "mis"))


@query(_with(_G, X.sql_lfmis("s", "v", "adj")) + "SELECT id FROM v WHERE id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT a FROM adj WHERE b IN (SELECT id FROM s))")
def maximality_check(spark: SparkSession, d: str) -> DataFrame:
    v, e = X.graph(spark, d)
    return maximality_violations(v, e, materialise(lfmis(v, e, closed=True), "mis"))


# ------------------------------------------------------------ repair


@query(_with(*_R) + "SELECT CASE WHEN op = 'I' THEN CASE ends WHEN 2 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END ELSE CASE ends WHEN 1 THEN 'L4' WHEN 0 THEN 'L5' ELSE 'L6' END END AS lemma, count(*) AS n FROM cases GROUP BY ALL")
def lemma_case_counts(spark: SparkSession, d: str) -> DataFrame:
    state, _, net = _batch(spark, d)
    return R.case_of(net, state.mis).groupBy("lemma").agg(F.count("*").alias("n"))


def _inserting(spark: SparkSession, d: str) -> tuple[R.State, DataFrame]:
    """A state and net operations with many conflicts: the insert-only stream, all at once."""
    v, e = X.graph(spark, d)
    base, ups = (materialise(x, "insert") for x in X.reverse_split(materialise(e, "graph")))
    return R.State(v, base, materialise(lfmis(v, base, closed=True), "mis")), materialise(U.net_toggle(ups, base), "net")


_I = (_G, X.sql_split(False), X.sql_net(""), X.sql_repair())
_IX = (_G, X.sql_split(False), X.sql_net(""), X.sql_repair("max"))


@query(_with(*_I) + "SELECT src, dst FROM conf")
def insertion_conflicts(spark: SparkSession, d: str) -> DataFrame:
    state, net = _inserting(spark, d)
    return R.insertion_conflicts(net, state.mis)


@query(_with(*_I) + "SELECT id FROM x")
def evicted_vertices(spark: SparkSession, d: str) -> DataFrame:
    state, net = _inserting(spark, d)
    return R.evicted_vertices(R.insertion_conflicts(net, state.mis))


@query(_with(*_IX) + "SELECT id FROM x")
def evicted_vertices_max(spark: SparkSession, d: str) -> DataFrame:
    state, net = _inserting(spark, d)
    return R.evicted_vertices(R.insertion_conflicts(net, state.mis), "max")


@query(_with(*_I) + "SELECT id FROM pool")
def freed_candidates(spark: SparkSession, d: str) -> DataFrame:
    state, net = _inserting(spark, d)
    out = materialise(R.evicted_vertices(R.insertion_conflicts(net, state.mis)), "evicted")
    return R.candidates(G.apply_net(state.edges, net), net, state.mis, out)


@query(_with(*_R) + "SELECT id FROM m2")
def mis_after_batch(spark: SparkSession, d: str) -> DataFrame:
    state, _, net = _batch(spark, d)
    return R.apply_batch(state, net).mis


@query(_with(*_IX) + "SELECT id FROM m2")
def mis_after_inserts_max(spark: SparkSession, d: str) -> DataFrame:
    return R.apply_batch(*_inserting(spark, d), "max").mis


@query(_with(*_R) + "SELECT (SELECT count(*) FROM m) AS mis_before, (SELECT count(*) FROM m2) AS mis_size, abs((SELECT count(*) FROM m2) - (SELECT count(*) FROM m)) AS mis_delta")
def mis_delta_per_batch(spark: SparkSession, d: str) -> DataFrame:
    state, _, net = _batch(spark, d)
    after = R.apply_batch(state, net)
    # a plan on the state before; one count of each
    a, b = state.mis.agg(F.count("*").alias("mis_before")), after.mis.agg(F.count("*").alias("mis_size"))
    # one row each
    return a.join(b).select("mis_before", "mis_size", F.abs(F.col("mis_size") - F.col("mis_before")).alias("mis_delta"))


def _violations(state: R.State) -> DataFrame:
    bad = independence_violations(state.edges, state.mis).agg(F.count("*").alias("dependent"))
    return bad.join(maximality_violations(state.vertices, state.edges, state.mis).agg(F.count("*").alias("uncovered")))


_ZERO = "SELECT 0::BIGINT AS dependent, 0::BIGINT AS uncovered"


@query(_ZERO)
def repair_validity(spark: SparkSession, d: str) -> DataFrame:
    state, _, net = _batch(spark, d)
    after = R.apply_batch(state, net)
    return _violations(R.State(after.vertices, materialise(after.edges, "edges"), materialise(after.mis, "mis")))


@query(_ZERO)
def sequential_mis_validity(spark: SparkSession, d: str) -> DataFrame:
    state, first, net = _batch(spark, d)
    return _violations(apply_batch_sequential(state, first, materialise(G.apply_net(state.edges, net), "edges")))


@query(_with(*_S, "badj AS (SELECT src AS a, dst AS b FROM base UNION ALL SELECT dst, src FROM base)", X.sql_lfmis("m", "v", "badj"), X.sql_sequential())
       + "SELECT x AS id FROM fs WHERE kind = 'm' AND it = (SELECT count(*) FROM u0)")
def sequential_members(spark: SparkSession, d: str) -> DataFrame:
    """The set after the one-by-one fold of a batch, region by region."""
    state, first, net = _batch(spark, d)
    return apply_batch_sequential(state, first, G.apply_net(state.edges, net)).mis.select("id")


def _streamed(spark: SparkSession, d: str) -> Engine:
    """The whole mixed stream, read from a folder of batch files."""
    from driftset.sources.text import write_batches

    v, base, ups = _base(spark, d)
    folder = fresh_path(spark, "stream")
    engine = Engine(spark, f"{folder}/state")
    engine.start(R.State(v, base, lfmis(v, base, closed=True)))
    write_batches(ups, f"{folder}/in")
    engine.run_folder(f"{folder}/in/*", f"{folder}/checkpoint")
    return engine


@query(_ZERO)
def stream_mis_validity(spark: SparkSession, d: str) -> DataFrame:
    engine = _streamed(spark, d)
    # of the start and of the state after each batch
    found = reduce(DataFrame.unionAll, [_violations(engine.load(n)) for n in range(-1, engine.version() + 1)])
    return found.agg(*[F.sum(c).alias(c) for c in ("dependent", "uncovered")])


_T = (*_S, X.sql_stream())


@query(_with(*_T) + " UNION ALL ".join(f"SELECT {i}::INTEGER AS batch_id, id FROM m_{i + 1}" for i in range(X.BATCHES)))
def stream_members(spark: SparkSession, d: str) -> DataFrame:
    """The set after every batch of the stream."""
    engine = _streamed(spark, d)
    return reduce(DataFrame.unionAll, [engine.load(n).mis.select(F.lit(n).alias("batch_id"), "id") for n in range(engine.version() + 1)])


@query(_with(*_T) + "SELECT src, dst FROM e_" + str(X.BATCHES))
def stream_final_edges(spark: SparkSession, d: str) -> DataFrame:
    engine = _streamed(spark, d)
    return engine.load(engine.version()).edges.select("src", "dst")


@query(_with(*_T) + "SELECT *, abs(mis_size - mis_before)::BIGINT AS mis_delta FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS batch_id, (SELECT count(*) FROM net_{i} WHERE op = 'I') AS n_insert, (SELECT count(*) FROM net_{i} WHERE op = 'D') AS n_delete, "
    f"(SELECT count(*) FROM m_{i}) AS mis_before, (SELECT count(*) FROM m_{i + 1}) AS mis_size" for i in range(X.BATCHES)) + ")")
def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.deltas(_streamed(spark, d).metrics().where("stage = 'total'").drop("stage", "ms"))

