"""Graphs and update streams derived from the relational tables.

Each graph is one SQL text that both engines run: Spark with the tables as
frames, the checking engine with the tables as views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.operators import updates as U
from driftset.operators.graph import canonical, ordered_lead

GRAPHS = {
    "grid": """
SELECT o_orderkey AS u, o_orderkey + 1 AS v FROM {orders}
WHERE (o_orderkey + 1) % 100 <> 0 AND o_orderstatus <> 'P' AND o_orderkey < (SELECT max(o_orderkey) FROM {orders})
UNION ALL SELECT o_orderkey - 100, o_orderkey FROM {orders} WHERE o_orderkey >= 100 AND o_orderstatus <> 'O'""",
    "returns_chain": """
SELECT a.l_partkey AS u, b.l_partkey AS v FROM {lineitem} a
JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R'""",
    "co_purchase": """
SELECT a.l_partkey AS u, b.l_partkey AS v FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey""",
    "part_supplier": "SELECT l_partkey AS u, l_suppkey + 1000000000 AS v FROM {lineitem}",
    "customer_seq": """
SELECT o_custkey AS u, lead(o_custkey) OVER (ORDER BY o_orderkey) AS v FROM {orders} WHERE o_orderstatus = 'F'""",
    "user_seq": "SELECT user_id AS u, lead(user_id) OVER (ORDER BY event_id) AS v FROM {events}",
}
#: Graphs of consecutive rows: table, order, vertex, rows.
SEQUENCES = {"customer_seq": ("orders", "o_orderkey", "o_custkey", "o_orderstatus = 'F'"), "user_seq": ("events", "event_id", "user_id", "true")}
TABLES = ("orders", "lineitem", "events")
#: Update streams of the queries: per mille of edges in the base, and batches; their size follows the stream.
BASE, STREAM_FROM, BATCHES = 950, 900, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SEQUENCES:  # the same lead, but not over one partition
        of, key, value, where = SEQUENCES[name]
        return ordered_lead(table(spark, sf_dir, of).where(where).select(key, F.col(value).alias("u")), key, "u").select("u", F.col("next").alias("v"))
    text = GRAPHS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def graph(spark: SparkSession, sf_dir: str, name: str = "grid") -> tuple[DataFrame, DataFrame]:
    """Vertices (all orders for the grid, else the ends of edges) and canonical edges."""
    edges = canonical(raw_graph(spark, sf_dir, name)).select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    if name == "grid":
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id")), edges
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


def batch_size(n: int) -> int:
    """Updates of a batch: the stream's of n edges, in BATCHES batches."""
    return max(1, -(-(n - n * STREAM_FROM // 1000) // BATCHES))


def split_mix(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base graph and batches from two independent orders, so most updates delete."""
    n = edges.count()
    base, _ = U.split(edges, BASE, U.KEY_A, n)
    _, tail = U.split(edges, STREAM_FROM, U.KEY_B, n)
    return base.select("src", "dst"), U.chunked(tail, batch_size(n))


def reverse_split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base graph and batches from one order, so all updates insert."""
    n = edges.count()
    base, tail = U.split(edges, STREAM_FROM, U.KEY_B, n)
    return base.select("src", "dst"), U.chunked(tail, batch_size(n))


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit operations and toggles (null op) on user pairs in event order, one batch a day."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("u"), "event_type", F.col("ts").cast("date").alias("day"))
    told = ordered_lead(events, "event_id", "u").where("u <> next")
    op = F.when(F.col("event_type").isin("signup", "purchase"), "I").when(F.col("event_type") == "error", "D")
    first = events.agg(F.min("day")).first()[0]
    return told.select(
        F.date_diff("day", F.lit(first)).alias("batch_id"), F.col("event_id").alias("seq"), F.least("u", "next").alias("src"), F.greatest("u", "next").alias("dst"), op.alias("op"))


# ---------------------------------------------------------------- SQL of the same


def sql_graph(name: str = "grid") -> str:
    """CTEs v(id), e(src, dst), adj(a, b) of a graph."""
    text = GRAPHS[name]
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    ids = "SELECT o_orderkey::BIGINT AS id FROM orders" if name == "grid" else "SELECT src AS id FROM e UNION SELECT dst FROM e"
    return f"""raw AS ({text}),
e AS (SELECT DISTINCT least(u, v)::BIGINT AS src, greatest(u, v)::BIGINT AS dst FROM raw WHERE u <> v),
v AS ({ids}), adj AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)"""


def sql_split(mix: bool = True) -> str:
    """CTEs base(src, dst) and ups(batch_id, seq, src, dst) from e."""
    a, b = (f"row_number() OVER (ORDER BY {k}, src, dst) - 1" for k in (U.KEY_A, U.KEY_B))
    head = f"SELECT src, dst FROM (SELECT src, dst, {a} AS r FROM e) WHERE r < (SELECT count(*) * {BASE} // 1000 FROM e)" if mix else \
        f"SELECT src, dst FROM (SELECT src, dst, {b} AS r FROM e) WHERE r < (SELECT count(*) * {STREAM_FROM} // 1000 FROM e)"
    return f"""base AS ({head}),
tail AS (SELECT src, dst, r - (SELECT count(*) * {STREAM_FROM} // 1000 FROM e) AS r FROM (SELECT src, dst, {b} AS r FROM e)
         WHERE r >= (SELECT count(*) * {STREAM_FROM} // 1000 FROM e)),
ups AS (SELECT (r // (SELECT greatest(1, (count(*) + {BATCHES - 1}) // {BATCHES}) FROM tail))::INTEGER AS batch_id, r::BIGINT AS seq, src, dst FROM tail)"""


def sql_lfmis(name: str, v: str, adj: str, key: str = "id") -> str:
    """A recursive CTE whose last iteration has status 1 for the set; ``{name}(id)`` reads it."""
    return f"""{name}_st AS (
  SELECT 0 AS it, id, 0 AS s, ({key})::BIGINT AS k FROM {v}
  UNION ALL (
    WITH blocked AS (SELECT DISTINCT x.id FROM {name}_st x JOIN {adj} a ON a.a = x.id JOIN {name}_st y ON y.id = a.b
                     WHERE x.s = 0 AND y.s = 0 AND (y.k < x.k OR (y.k = x.k AND y.id < x.id))),
    win AS (SELECT id FROM {name}_st WHERE s = 0 AND id NOT IN (SELECT id FROM blocked)),
    lost AS (SELECT DISTINCT a.b AS id FROM {adj} a JOIN win ON win.id = a.a)
    SELECT x.it + 1, x.id, CASE WHEN x.s <> 0 THEN x.s WHEN w.id IS NOT NULL THEN 1 WHEN l.id IS NOT NULL THEN 2 ELSE 0 END, x.k
    FROM {name}_st x LEFT JOIN win w ON w.id = x.id LEFT JOIN lost l ON l.id = x.id
    WHERE (SELECT min(s) FROM {name}_st) = 0)),
{name} AS (SELECT id FROM {name}_st WHERE it = (SELECT max(it) FROM {name}_st) AND s = 1)"""


def sql_net(which: str = "WHERE batch_id = 0") -> str:
    """CTEs net(src, dst, op) and after(src, dst) of some batches, together, on base."""
    return f"""net AS (SELECT u.src, u.dst, CASE WHEN b.src IS NULL THEN 'I' ELSE 'D' END AS op
  FROM (SELECT src, dst FROM ups {which} GROUP BY src, dst HAVING count(*) % 2 = 1) u LEFT JOIN base b ON b.src = u.src AND b.dst = u.dst),
after AS (SELECT b.src, b.dst FROM base b WHERE NOT EXISTS (SELECT 1 FROM net n WHERE n.op = 'D' AND n.src = b.src AND n.dst = b.dst)
  UNION SELECT src, dst FROM net WHERE op = 'I'),
badj AS (SELECT src AS a, dst AS b FROM base UNION ALL SELECT dst, src FROM base),
aadj AS (SELECT src AS a, dst AS b FROM after UNION ALL SELECT dst, src FROM after)"""


def sql_repair(evict: str = "min", start: bool = True) -> str:
    """CTEs m (before, if ``start``), conf, x (evicted), pool, m2 (after) of net."""
    key = "-id" if evict == "min" else "id"
    return ",\n".join((
        *([sql_lfmis("m", "v", "badj")] if start else []),
        """cases AS (SELECT n.*, (n.src IN (SELECT id FROM m))::INTEGER + (n.dst IN (SELECT id FROM m))::INTEGER AS ends FROM net n),
conf AS (SELECT src, dst FROM cases WHERE op = 'I' AND ends = 2),
cv AS (SELECT src AS id FROM conf UNION SELECT dst FROM conf), cadj AS (SELECT src AS a, dst AS b FROM conf UNION ALL SELECT dst, src FROM conf)""",
        sql_lfmis("k", "cv", "cadj", key),
        """x AS (SELECT id FROM cv WHERE id NOT IN (SELECT id FROM k)),
m1 AS (SELECT id FROM m WHERE id NOT IN (SELECT id FROM x)),
near AS (SELECT b AS id FROM aadj WHERE a IN (SELECT id FROM x) UNION SELECT src FROM net WHERE op = 'D' UNION SELECT dst FROM net WHERE op = 'D'),
pool AS (SELECT id FROM near WHERE id NOT IN (SELECT id FROM m1) AND id NOT IN (SELECT a FROM aadj WHERE b IN (SELECT id FROM m1))),
padj AS (SELECT a, b FROM aadj WHERE a IN (SELECT id FROM pool) AND b IN (SELECT id FROM pool))""",
        sql_lfmis("p", "pool", "padj"),
        "m2 AS (SELECT id FROM m1 UNION SELECT id FROM p)",
    ))


def sql_stream() -> str:
    """CTEs net_i, e_i (edges) and m_i (the set) before each batch i, and after the last, of the stream on base."""
    own = "net cases conf cv cadj k_st k x m1 near pool padj p_st p".split()
    out = ["e_0 AS MATERIALIZED (SELECT src, dst FROM base)", "adj_0 AS MATERIALIZED (SELECT src AS a, dst AS b FROM base UNION ALL SELECT dst, src FROM base)", sql_lfmis("m_0", "v", "adj_0")]
    for i in range(BATCHES):
        text = sql_net(f"WHERE batch_id = {i}") + ",\n" + sql_repair(start=False)
        name = {w: f"{w}_{i}" for w in own} | {"base": f"e_{i}", "after": f"e_{i + 1}", "badj": f"unused_{i}", "aadj": f"adj_{i + 1}", "m": f"m_{i}", "m2": f"m_{i + 1}"}
        text = re.sub(r"\b(" + "|".join(sorted(name, key=len, reverse=True)) + r")\b", lambda w, name=name: name[w[0]], text)
        out.append(re.sub(r"\b(\w+_\d+) AS \((?!\s*SELECT 0 AS it)", r"\1 AS MATERIALIZED (", text))
    return ",\n".join(out)


def sql_sequential() -> str:
    """A recursive CTE fs(it, kind, x, y) that folds batch 0 one update after another: members ('m') and edges ('e') after it updates."""
    return """u0 AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS r, src, dst FROM ups WHERE batch_id = 0),
fs AS (
  SELECT 0::BIGINT AS it, 'm' AS kind, id AS x, 0::BIGINT AS y FROM m
  UNION ALL SELECT 0, 'e', src, dst FROM base
  UNION ALL (
    WITH u AS (SELECT src, dst FROM u0 WHERE r = (SELECT max(it) FROM fs)),
    mem AS (SELECT x AS id FROM fs WHERE kind = 'm'),
    ed AS (SELECT x AS a, y AS b FROM fs WHERE kind = 'e' UNION ALL SELECT y, x FROM fs WHERE kind = 'e'),
    st AS (SELECT src, dst, EXISTS (SELECT 1 FROM fs WHERE kind = 'e' AND x = src AND y = dst) AS there, src IN (SELECT id FROM mem) AS s, dst IN (SELECT id FROM mem) AS d FROM u),
    gone AS (SELECT src AS id FROM st WHERE NOT there AND s AND d),
    rest AS (SELECT id FROM mem WHERE id NOT IN (SELECT id FROM gone)),
    freed AS (SELECT b AS id FROM ed WHERE a IN (SELECT id FROM gone) AND b NOT IN (SELECT id FROM rest)
              AND NOT EXISTS (SELECT 1 FROM ed z WHERE z.a = ed.b AND z.b IN (SELECT id FROM rest))),
    loose AS (SELECT CASE WHEN s THEN dst ELSE src END AS id, CASE WHEN s THEN src ELSE dst END AS but FROM st WHERE there AND s <> d),
    joins AS (SELECT id FROM freed UNION SELECT id FROM loose WHERE NOT EXISTS (SELECT 1 FROM ed WHERE a = loose.id AND b <> loose.but AND b IN (SELECT id FROM mem)))
    SELECT i.n, t.kind, t.x, t.y FROM (SELECT max(it) + 1 AS n FROM fs) i, (
      SELECT 'm' AS kind, id AS x, 0 AS y FROM rest UNION ALL SELECT 'm', id, 0 FROM joins
      UNION ALL SELECT 'e', x, y FROM fs WHERE kind = 'e' AND NOT EXISTS (SELECT 1 FROM u WHERE src = x AND dst = y)
      UNION ALL SELECT 'e', src, dst FROM st WHERE NOT there) t
    WHERE EXISTS (SELECT 1 FROM u)))"""
