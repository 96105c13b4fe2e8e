"""Command line: prepare data sets, run batches of updates, write reports.

python -m driftset base GRAPH OUT                      the base graph (95 % of the edges)
python -m driftset batches GRAPH OUT --ratio 1e-3      update batches from the other order (10 %)
python -m driftset run GRAPH BATCHES STATE [--set FILE --set-base 0|1] [--limit K] [--report OUT] [--out-set OUT]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions import metrics as M
from driftset.functions.shared import materialise
from driftset.operators import updates as U
from driftset.operators.lfmis import independence_violations, lfmis, maximality_violations
from driftset.operators.repair import State
from driftset.sources import text as T
from driftset.streaming.engine import Engine


def prepare_base(spark: SparkSession, graph: str, out: str, per_mille: int = 950, id_base: int = 1) -> None:
    g = T.read_graph(spark, graph, id_base)
    base, _ = U.split(materialise(g.edges, "graph"), per_mille, U.KEY_A)
    T.write_graph(g.vertices.count(), base.select("src", "dst"), out, g.comments, id_base)


def prepare_batches(spark: SparkSession, graph: str, out: str, ratio: float, per_mille: int = 900, id_base: int = 1) -> DataFrame:
    """Batches of ``ratio`` of the edges that stay, one folder each."""
    edges = materialise(T.read_graph(spark, graph, id_base).edges, "graph")
    head, tail = U.split(edges, per_mille, U.KEY_B)
    size = int(head.count() * ratio)
    if size < 1:
        raise ValueError(f"a ratio of {ratio} makes empty batches")
    ups = U.chunked(tail, size)
    T.write_batches(ups, out, id_base)
    return ups


def run(spark: SparkSession, graph: str, batches: str, state: str, set_file: str | None = None, set_base: int | None = None, limit: int | None = None,
        mode: str = "toggle", evict: str = "min", id_base: int = 1, report: str | None = None, out_set: str | None = None) -> DataFrame:
    """Applies the batches of a folder in the order of their numbers; the summary.

    ``report`` gets a row for each batch and stage, and ``report``-stages the
    totals of the stages; ``out_set`` gets the final set.
    """
    g = T.read_graph(spark, graph, id_base)
    edges = materialise(g.edges, "graph")
    if set_file is not None:
        if set_base is None:
            raise ValueError("say whether the ids of the set file start at 0 or 1")
        mis, _ = T.read_set(spark, set_file, g.vertices, set_base)
        mis = materialise(mis, "set")
        if independence_violations(edges, mis).limit(1).count() or maximality_violations(g.vertices, edges, mis).limit(1).count():
            raise ValueError("the set file is no maximal independent set of the graph")
    else:
        mis = lfmis(g.vertices, edges, closed=g.header is not None)
    engine = Engine(spark, state, mode, evict)
    engine.start(State(g.vertices, edges, mis))
    ups, _ = T.read_batches(spark, batches, id_base, limit)
    ups = materialise(ups, "updates")
    for r in ups.select("batch_id").distinct().orderBy("batch_id").collect():
        engine.apply(ups.where(F.col("batch_id") == r.batch_id), r.batch_id)
    rows = engine.metrics()
    if report:
        rows.coalesce(1).write.mode("overwrite").json(report)
        M.slowest_worker_total(rows.withColumn("worker", F.lit(0))).coalesce(1).write.mode("overwrite").json(f"{report}-stages")
    if out_set:
        T.write_set(engine.load(engine.version()).mis, out_set, id_base)
    return M.summary(rows)


def main() -> None:
    p = argparse.ArgumentParser(prog="driftset", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=["base", "batches", "run"])
    p.add_argument("graph")
    p.add_argument("paths", nargs="+")
    p.add_argument("--ratio", type=float, default=1e-3)
    p.add_argument("--id-base", type=int, default=1)
    p.add_argument("--set")
    p.add_argument("--set-base", type=int)
    p.add_argument("--limit", type=int)
    p.add_argument("--mode", default="toggle")
    p.add_argument("--evict", default="min")
    p.add_argument("--report")
    p.add_argument("--out-set")
    a = p.parse_args()
    spark = SparkSession.builder.appName("driftset").getOrCreate()
    if a.what == "base":
        prepare_base(spark, a.graph, a.paths[0], id_base=a.id_base)
    elif a.what == "batches":
        prepare_batches(spark, a.graph, a.paths[0], a.ratio, id_base=a.id_base)
    else:
        run(spark, a.graph, a.paths[0], a.paths[1], a.set, a.set_base, a.limit, a.mode, a.evict, a.id_base, a.report, a.out_set).show(truncate=False)


if __name__ == "__main__":
    main()
