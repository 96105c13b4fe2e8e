"""The sequential fold: one update after another, exactly in the order of seq.

Regions are independent, so each folds on its own in one Arrow group; a
group holds the part of the graph around its updates (three hops cover all
that the rules read).  Meant for graphs whose regions stay small; the
set-based repair is the default and needs no regions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.operators.graph import symmetrise
from driftset.operators.regions import conflict_free_regions, hop_neighborhood
from driftset.operators.repair import State

READS = 3


def fold(updates: list[tuple[int, int, int, str | None]], adj: dict[int, set[int]], members: set[int]) -> None:
    """Applies (seq, u, v, op) in order, in place; op None toggles the edge."""

    def free(x: int, but: int | None = None) -> bool:
        return not any(n in members for n in adj.get(x, ()) if n != but)

    for _, u, v, op in sorted(updates, key=lambda x: x[0]):
        there = v in adj.get(u, ())
        delete = there if op is None else op == "D"
        if delete != there:
            continue
        if not delete:
            if u in members and v in members:
                out = min(u, v)
                members.discard(out)
                for n in sorted(adj.get(out, ())):
                    if n not in members and free(n):
                        members.add(n)
            adj.setdefault(u, set()).add(v)
            adj.setdefault(v, set()).add(u)
        else:
            for x, y in ((u, v), (v, u)):
                if x in members and y not in members and free(y, x):
                    members.add(y)
                    break
            adj[u].discard(v)
            adj[v].discard(u)


def _fold_group(pdf: pd.DataFrame) -> pd.DataFrame:
    adj: dict[int, set[int]] = {}
    edges = pdf[pdf.kind == "edge"]
    for a, b in zip(edges.x, edges.y):
        adj.setdefault(int(a), set()).add(int(b))
    before = {int(x) for x in pdf[pdf.kind == "member"].x}
    members = set(before)
    ups = pdf[pdf.kind == "update"]
    fold([(int(s), int(x), int(y), o if isinstance(o, str) else None) for s, x, y, o in zip(ups.seq, ups.x, ups.y, ups.op)], adj, members)
    rows = [(i, "in") for i in members - before] + [(i, "out") for i in before - members]
    return pd.DataFrame(rows, columns=["id", "change"]).astype({"id": "int64"})


def apply_batch_sequential(state: State, updates: DataFrame, edges_after: DataFrame, hops: int = 2) -> State:
    """Folds one batch of valid canonical updates region by region."""
    updates = materialise(updates, "fold-updates")
    regions, _ = conflict_free_regions(updates, state.edges, hops)
    own = updates.join(regions, ["batch_id", "seq"])
    seeds = own.select("cluster_id", F.explode(F.array("src", "dst")).alias("id"))
    union = state.edges.select("src", "dst").unionByName(updates.select("src", "dst"))
    area = materialise(hop_neighborhood(seeds, union, READS, ["cluster_id"]).select("cluster_id", "id"), "fold-area")
    adj = symmetrise(state.edges)
    none = F.lit(None)
    rows = own.select("cluster_id", F.lit("update").alias("kind"), F.col("src").alias("x"), F.col("dst").alias("y"), "seq", "op")
    near = area.join(adj, area["id"] == adj["a"]).select("cluster_id", F.lit("edge").alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), none.cast("bigint").alias("seq"), none.cast("string").alias("op"))
    around = near.select("cluster_id", F.col("y").alias("id")).unionByName(area).distinct()
    inside = around.join(state.mis.select("id"), "id", "left_semi").select("cluster_id", F.lit("member").alias("kind"), F.col("id").alias("x"), F.col("id").alias("y"), none.cast("bigint").alias("seq"), none.cast("string").alias("op"))
    changes = rows.unionByName(near).unionByName(inside).groupBy("cluster_id").applyInPandas(_fold_group, "id bigint, change string")
    changes = materialise(changes, "fold-changes")
    gone, new = changes.where("change = 'out'").select("id").distinct(), changes.where("change = 'in'").select("id").distinct()
    mis = materialise(state.mis.select("id").join(gone, "id", "left_anti").unionByName(new).distinct(), "mis")
    return State(state.vertices, edges_after, mis)
