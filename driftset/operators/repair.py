"""Set-based repair of a maximal independent set after a batch of updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.operators.graph import apply_net, incident, neighbours
from driftset.operators.lfmis import LOCAL_EDGES, greedy, lfmis

# The six cases of one net operation, by operation and ends in the set.
CASES = {("I", 2): "L1", ("I", 1): "L2", ("I", 0): "L3", ("D", 1): "L4", ("D", 0): "L5", ("D", 2): "L6"}


def case_of(net: DataFrame, mis: DataFrame) -> DataFrame:
    """Adds ``lemma`` to net operations by how many ends are in the set."""
    m = mis.select("id").distinct()
    in_s, in_d = (m.select(F.col("id").alias(c), F.lit(1).alias(f"__{c}")) for c in ("src", "dst"))
    told = net.join(in_s, "src", "left").join(in_d, "dst", "left")
    ends = F.coalesce("__src", F.lit(0)) + F.coalesce("__dst", F.lit(0))
    lemma = F.coalesce(*[F.when((F.col("op") == op) & (ends == n), F.lit(name)) for (op, n), name in CASES.items()])
    return told.withColumn("lemma", lemma).drop("__src", "__dst")


def insertion_conflicts(net: DataFrame, mis: DataFrame) -> DataFrame:
    """Inserted edges between two members."""
    return case_of(net, mis).where("lemma = 'L1'").select("src", "dst")


def evicted_vertices(conflicts: DataFrame, evict: str = "min") -> DataFrame:
    """Members that leave: all ends of conflicts but a maximal independent set of them.

    ``evict='min'`` keeps the larger id of a conflict, ``'max'`` the smaller.
    """
    if evict not in ("min", "max"):
        raise ValueError(f"unknown eviction rule {evict!r}")
    ends = conflicts.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kept = lfmis(ends, conflicts, -F.col("id") if evict == "min" else F.col("id"))
    return ends.join(kept, "id", "left_anti")


def _evicted_in_one_task(conflicts: DataFrame, evict: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            ends = np.concatenate([x for p in zip(*parts) for x in p])
            names, at = np.unique(ends, return_inverse=True)
            rank = len(names) - 1 - at if evict == "min" else at
            names = names[::-1] if evict == "min" else names
            m = len(ends) // 2
            yield pa.RecordBatch.from_arrays([pa.array(names[~greedy(len(names), rank[:m], rank[m:])])], names=["id"])

    return conflicts.select("src", "dst").coalesce(1).mapInArrow(run, "id bigint")


def _added_in_one_task(pool: DataFrame, around: DataFrame) -> DataFrame:
    """The greedy by id among the vertices of the pool that no member covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        a, b, member = (np.concatenate(x) for x in zip(*parts))
        alone = np.flatnonzero(a == b)  # the pool itself
        free = np.setdiff1d(a[alone], a[member])
        inside = (a < b) & np.isin(a, free) & np.isin(b, free)
        yield pa.RecordBatch.from_arrays([pa.array(free[greedy(len(free), np.searchsorted(free, a[inside]), np.searchsorted(free, b[inside]))])], names=["id"])

    rows = pool.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(False).alias("member")).unionByName(around.select("a", "b", "member"))
    return rows.coalesce(1).mapInArrow(run, "id bigint")


def _stay(mis: DataFrame, evicted: DataFrame) -> DataFrame:
    return mis.select("id").join(evicted, "id", "left_anti")


def _loose(edges_after: DataFrame, net: DataFrame, mis: DataFrame, evicted: DataFrame) -> DataFrame:
    """Vertices next to an eviction or at a deletion that are outside the set."""
    near = neighbours(evicted, edges_after)
    ends = net.where("op = 'D'").select(F.explode(F.array("src", "dst")).alias("id"))
    return near.unionByName(ends).distinct().join(_stay(mis, evicted), "id", "left_anti")


def _uncovered(pool: DataFrame, around: DataFrame, stay: DataFrame) -> DataFrame:
    """The pool without vertices that have a member among their neighbours (``around``: adj at the pool)."""
    return pool.join(around.join(stay.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")), "id", "left_anti")


def candidates(edges_after: DataFrame, net: DataFrame, mis: DataFrame, evicted: DataFrame) -> DataFrame:
    """Vertices that may join: next to an eviction or at a deletion, outside the set and uncovered."""
    pool = _loose(edges_after, net, mis, evicted)
    return _uncovered(pool, incident(edges_after, pool), _stay(mis, evicted))


@dataclass
class State:
    """Vertices, canonical edges and the set (id) after some batch."""

    vertices: DataFrame
    edges: DataFrame
    mis: DataFrame


def repair(state: State, net: DataFrame, evict: str = "min", fresh: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members that leave and vertices that join after net operations (src, dst, op), which are materialised.

    The graph is scanned twice, for the edges at evicted vertices and for
    those at the pool of vertices that may join; it is neither shuffled by a
    join whose other side is small nor written.  Everything else follows the
    size of the batch: tables of at most ``LOCAL_EDGES`` rows are answered by
    one task, larger ones in distributed rounds.  ``fresh`` are new vertices, which may join too.
    """
    edges = apply_net(state.edges, net)
    conflicts = materialise(insertion_conflicts(net, state.mis), "conflicts")
    small = conflicts.count() <= LOCAL_EDGES
    evicted = materialise(_evicted_in_one_task(conflicts, evict) if small else evicted_vertices(conflicts, evict), "evicted")
    pool = _loose(edges, net, state.mis, evicted)
    if fresh is not None:
        pool = pool.unionByName(fresh).distinct()
    pool = materialise(pool, "pool")
    stay = _stay(state.mis, evicted).select(F.col("id").alias("b"), F.lit(True).alias("member"))
    around = materialise(incident(edges, pool).join(stay, "b", "left").select("a", "b", F.coalesce("member", F.lit(False)).alias("member")), "around")
    if pool.count() + around.count() <= LOCAL_EDGES:
        return evicted, materialise(_added_in_one_task(pool, around), "added")
    free = pool.join(around.where("member").select(F.col("a").alias("id")), "id", "left_anti")
    added = lfmis(free, around.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return evicted, materialise(added, "added")


def apply_batch(state: State, net: DataFrame, evict: str = "min", grow: DataFrame | None = None) -> State:
    """The state after net operations (src, dst, op), as plans on the state before.

    ``net`` is read several times: materialise it.  A long run of batches goes
    through the engine, which keeps the changes.  ``grow`` holds new vertex
    ids, which join as fresh candidates.
    """
    vertices, fresh = state.vertices, None
    if grow is not None:
        fresh = materialise(grow.select("id").distinct().join(vertices, "id", "left_anti"), "fresh")
        vertices = vertices.unionByName(fresh)
    evicted, added = repair(state, net, evict, fresh)
    return State(vertices, apply_net(state.edges, net), _stay(state.mis, evicted).unionByName(added))
