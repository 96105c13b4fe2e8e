"""Lexicographically first maximal independent set.

Round by round every undecided vertex whose key is below all undecided
neighbours' keys joins, and its neighbours are out; the result equals the
sequential greedy in key order, so it is unique.  The residual graph (edges
between undecided vertices) shrinks each round and is all that is shuffled.
Once it has at most ``LOCAL_EDGES`` edges - a bound on memory, not on input -
a single Arrow task runs the greedy on it; larger graphs go on in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.operators.graph import symmetrise

#: Edges of a residual graph that one task may finish (about 100 MB).
LOCAL_EDGES = 2_000_000


def greedy(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the vertices 0..n-1, in this order, the greedy takes; the same rounds on arrays, all local minima at once."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    state = np.zeros(n, np.int8)
    while len(lo):
        blocked = np.zeros(n, bool)
        blocked[hi] = True
        win = (state == 0) & ~blocked
        state[win] = 1
        state[hi[win[lo]]] = 2
        live = (state[lo] == 0) & (state[hi] == 0)
        lo, hi = lo[live], hi[live]
    return state != 2


def _greedy(edges: DataFrame) -> DataFrame:
    """The set within keyed edges (ka, a, kb, b), each edge once, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
        if not parts:
            return
        ka, a, kb, b = (np.concatenate(x) for x in zip(*parts))
        key, ids = np.concatenate((ka, kb)), np.concatenate((a, b))
        order = np.lexsort((ids, key))
        new = np.ones(len(ids), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(new) - 1
        names, m = ids[order][new], len(a)
        yield pa.RecordBatch.from_arrays([pa.array(names[greedy(len(names), rank[:m], rank[m:])])], names=["id"])

    return edges.coalesce(1).mapInArrow(run, "id bigint")


def lfmis(vertices: DataFrame, edges: DataFrame, key: Column | None = None, local_edges: int = LOCAL_EDGES, closed: bool = False) -> DataFrame:
    """ids of the set of graph (``vertices`` id, canonical ``edges``).

    ``key`` is a bigint expression over a column ``id`` (default: the id);
    equal keys are ordered by id.  Edges with an end outside ``vertices`` are
    ignored; if there are none (``closed``), two joins are saved.  Materialise the result if it is read more than once.
    """
    key = F.col("id") if key is None else key
    v = vertices.select("id").distinct()
    left = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for x in ("a", "b"):
        if not closed:
            left = left.join(v.withColumnRenamed("id", x), x, "left_semi")
        left = left.withColumn("id", F.col(x)).withColumn(f"k{x}", key.cast("bigint"))
    left = materialise(left.select("ka", "a", "kb", "b"), "lfmis")
    touched = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id")))
    found = [v.join(touched, "id", "left_anti")]  # isolated vertices are in
    while n := left.count():
        if n <= local_edges:
            found.append(_greedy(left))
            break
        first = F.struct(F.col("ka"), F.col("a")) < F.struct(F.col("kb"), F.col("b"))
        edge = left.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))
        win = materialise(edge.select(F.col("lo").alias("id")).distinct().join(edge.select(F.col("hi").alias("id")), "id", "left_anti"), "lfmis-in")
        out = edge.join(win.withColumnRenamed("id", "lo"), "lo", "left_semi").select(F.col("hi").alias("id")).distinct()
        out = materialise(out, "lfmis-out")
        gone = win.unionByName(out)
        before = left
        left = materialise(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("ka", "a", "kb", "b"), "lfmis")
        still = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id")))
        were = before.select(F.col("a").alias("id")).unionByName(before.select(F.col("b").alias("id"))).distinct()
        # undecided vertices that lost their last undecided neighbour have none in the set: they are in
        alone = materialise(were.join(gone, "id", "left_anti").join(still, "id", "left_anti"), "lfmis-alone")
        found += [win, alone]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def independence_violations(edges: DataFrame, mis: DataFrame) -> DataFrame:
    """Edges with both ends in the set; none if it is independent."""
    m = mis.select("id").distinct()
    return edges.join(m.withColumnRenamed("id", "src"), "src", "left_semi").join(m.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def maximality_violations(vertices: DataFrame, edges: DataFrame, mis: DataFrame) -> DataFrame:
    """Vertices outside the set without a neighbour in it; none if it is maximal."""
    covered = symmetrise(edges).join(mis.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"))
    return vertices.select("id").join(mis.select("id"), "id", "left_anti").join(covered, "id", "left_anti")
