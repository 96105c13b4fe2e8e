"""Connected components of an edge table by contraction, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftset.functions.shared import materialise


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Components of a bounded edge table, by hooking and pointer jumping in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        ids, inverse = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
        a, b, at = [], [], 0
        for x, y in parts:
            a.append(inverse[at : at + len(x)])
            b.append(inverse[at + len(x) : at + len(x) + len(y)])
            at += len(x) + len(y)
        a, b, root = np.concatenate(a), np.concatenate(b), np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, local_edges: int = 0) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge.

    ``edges`` has columns a and b.  Each round every node points to its least
    neighbour, pointers are shortened, and the edges are contracted along
    them; the edges left shrink at least by half, so rounds are logarithmic.
    Only counts reach the driver; each round is written to the shared folder.
    If at most ``local_edges`` edges are left, one task finishes them.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while left := edges.count():
        if left <= local_edges:
            up = materialise(_in_one_task(edges).select(F.col("node").alias("v"), F.col("root").alias("p")), "cc-up")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "cc-up")
            for _ in range(2):
                up = up.join(up.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p"))
            up = materialise(up, "cc-up")
        if labels is None:
            labels = up
        else:
            labels = materialise(labels.join(up.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "cc-labels")
        if left <= local_edges:
            break
        to_a, to_b = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = materialise(edges, "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.select(F.col("v").alias("node"), F.col("p").alias("root"))
