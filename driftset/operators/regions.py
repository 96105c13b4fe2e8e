"""Affected areas and conflict-free regions of an update batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.operators.components import components
from driftset.operators.graph import symmetrise

#: Edges that one task may label when regions are joined up (about 100 MB).
LOCAL_EDGES = 2_000_000


def hop_neighborhood(seeds: DataFrame, edges: DataFrame, hops: int, keys: list[str]) -> DataFrame:
    """keys.., id, hop: vertices within ``hops`` of each seed (keys.., id), at their least distance.

    Every hop expands only the vertices that the last one found, so the join
    follows the frontier and not the graph.
    """
    adj = symmetrise(edges)
    reached = seeds.select(*keys, "id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.join(adj, frontier["id"] == adj["a"]).select(*keys, F.col("b").alias("id")).distinct()
        new = step.join(reached.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("hop", F.lit(h))
        frontier = materialise(new, "hop") if h < hops else new
        reached = reached.unionByName(frontier)
    return reached


def affected_area(updates: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """batch_id, seq, id, hop: vertices within ``hops`` of either end of an update."""
    seeds = updates.select("batch_id", "seq", F.explode(F.array("src", "dst")).alias("id")).where("id is not null")
    return hop_neighborhood(seeds, edges, hops, ["batch_id", "seq"])


def with_batch(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """The graph together with the edges of the batch, whose ends must share a region.

    Edges of both come twice, which hops do not mind; the graph is not shuffled for it.
    """
    return edges.select("src", "dst").unionByName(updates.where("src < dst").select("src", "dst"))


def conflict_free_regions(updates: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Update and vertex labels of one batch.

    Updates whose areas on the graph with the batch share a vertex belong
    together; a region is named by its least seq.  Returns
    edge_cluster(batch_id, seq, cluster_id) and vertex_cluster(batch_id, id, cluster_id).

    No table holds the areas of all updates: each vertex reached keeps the
    least seq that reached it, and a link is drawn where a label meets a
    smaller one.  All updates at a vertex are linked to its label already, so
    the links join the same updates as their areas do, and each hop follows
    the edges at the vertices reached, once, however many updates share them.
    """
    adj = symmetrise(with_batch(edges, updates))
    seeds = updates.select("seq", F.explode(F.array("src", "dst")).alias("id")).where("id is not null")
    reached = materialise(seeds.groupBy("id").agg(F.min("seq").alias("label")), "reached")
    links = seeds.join(reached, "id").select(F.col("seq").alias("a"), F.col("label").alias("b"))
    for _ in range(hops):
        step = reached.join(adj, reached["id"] == adj["a"]).select(F.col("b").alias("id"), "label").unionByName(reached)
        step = materialise(step.distinct(), "step")
        reached = materialise(step.groupBy("id").agg(F.min("label").alias("least")), "reached")
        links = links.unionByName(step.join(reached, "id").select(F.col("label").alias("a"), F.col("least").alias("b")))
        reached = reached.withColumnRenamed("least", "label")
    roots = components(links, LOCAL_EDGES)
    named = updates.select("batch_id", "seq").join(roots.select(F.col("node").alias("seq"), "root"), "seq", "left")
    edge_cluster = materialise(named.select("batch_id", "seq", F.coalesce("root", "seq").alias("cluster_id")), "regions")
    labels = edge_cluster.withColumnRenamed("seq", "label")
    return edge_cluster, reached.join(labels, "label").select("batch_id", "id", "cluster_id")


def cluster_sizes(edge_cluster: DataFrame) -> DataFrame:
    return edge_cluster.groupBy("batch_id", "cluster_id").agg(F.count("*").alias("n_updates")).where("n_updates > 0")


def region_average(edge_cluster: DataFrame) -> DataFrame:
    """batch_id, n_regions, n_updates and the whole average of updates a region."""
    sizes = cluster_sizes(edge_cluster).groupBy("batch_id").agg(F.count("*").alias("n_regions"), F.sum("n_updates").alias("n_updates"))
    return sizes.withColumn("per_region", F.expr("n_updates div n_regions"))


def incident_updates(vertices: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with either end in the set: two semi joins and a union, no OR join."""
    v = vertices.select("id").distinct()
    by_src = updates.join(v.withColumnRenamed("id", "src"), "src", "left_semi").select(updates.columns)
    by_dst = updates.join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select(updates.columns)
    return by_src.unionByName(by_dst).dropDuplicates(["batch_id", "seq"])


def assign_by_endpoint(updates: DataFrame, vertex_cluster: DataFrame) -> DataFrame:
    """The region of the source, or else of the destination."""
    s = vertex_cluster.select("batch_id", F.col("id").alias("src"), F.col("cluster_id").alias("c_src"))
    d = vertex_cluster.select("batch_id", F.col("id").alias("dst"), F.col("cluster_id").alias("c_dst"))
    return updates.join(s, ["batch_id", "src"], "left").join(d, ["batch_id", "dst"], "left").select("batch_id", "seq", F.coalesce("c_src", "c_dst").alias("cluster_id"))
