"""Graphs as relations: canonical edges, adjacency, degrees, CSR, batch application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(raw: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Distinct undirected edges (src < dst); self-loops and nulls go."""
    return raw.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst")).distinct()


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, as adj(a, b), in one scan."""
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetrise(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """id and its sorted neighbours."""
    return symmetrise(edges).groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias("neighbors"))


#: Rows that one key range holds, about.
RANGE_ROWS = 1 << 14


def ordered_lead(rows: DataFrame, key: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Adds ``next``, the value of the next row in the order of a distinct integer ``key``, null for the last.

    Each key range leads within itself; its last row takes the first value of
    the next range that has rows, from a table of one row per range.
    """
    ranged = rows.withColumn("__r", F.floor(F.col(key) / width))
    firsts = ranged.groupBy("__r").agg(F.min_by(value, key).alias("__first"))
    firsts = firsts.select("__r", F.lead("__first").over(Window.orderBy("__r")).alias("__first"))
    inside = Window.partitionBy("__r").orderBy(key)
    told = ranged.withColumn("next", F.lead(value).over(inside)).withColumn("__last", F.lead(key).over(inside).isNull())
    return told.join(firsts, "__r").withColumn("next", F.when(F.col("__last"), F.col("__first")).otherwise(F.col("next"))).drop("__r", "__first", "__last")


def running_offsets(counts: DataFrame, key: str, count: str, width: int = 1 << 16) -> DataFrame:
    """Exclusive prefix sums of ``count`` in the order of an integer ``key``.

    Two levels: sums inside key ranges, then over one row per range, so no
    task sorts the whole table.
    """
    ranged = counts.withColumn("__r", F.floor(F.col(key) / width))
    sums = ranged.groupBy("__r").agg(F.sum(count).alias("__s"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__r", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("__in", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(sums, "__r")
        .withColumn("offset", (F.col("__in") + F.col("__before")).cast("bigint")).drop("__r", "__in", "__before")
    )


def csr_offsets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, offset, degree: row offsets of the CSR form, isolated vertices included."""
    d = vertices.join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    return running_offsets(d, "id", "degree")


def rank_by(rows: DataFrame, key: str, ties: list[str], bits: int = 31, n: int | None = None) -> DataFrame:
    """Adds ``rank`` from 0 in the order of a hash-like ``key`` of ``bits`` bits.

    Equal key ranges of about ``RANGE_ROWS`` rows are counted and prefix-summed,
    then each range ranks its own rows: the order is global, but no task holds
    more than a range, and the table of ranges is small.  ``n``: the number of
    rows, if known.
    """
    ranges = max(6, min(bits, ((rows.count() if n is None else n) // RANGE_ROWS).bit_length()))
    cut = F.shiftright(F.col(key), bits - ranges)
    ranged = rows.withColumn("__r", cut)
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    counts = counts.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(key, *ties))
    return ranged.withColumn("__in", inside).join(counts, "__r").withColumn("rank", (F.col("__in") - 1 + F.col("__before")).cast("bigint")).drop("__r", "__in", "__before")


def is_adjacent(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the boolean ``adjacent`` to pairs (src, dst), in canonical order."""
    known = edges.select("src", "dst", F.lit(True).alias("__known"))
    return pairs.join(known, ["src", "dst"], "left").withColumn("adjacent", F.coalesce("__known", F.lit(False))).drop("__known")


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """adj(a, b) of the edges at ``ids`` (as a), in one scan of the graph."""
    return symmetrise(edges).join(ids.select(F.col("id").alias("a")), "a", "left_semi")


def neighbours(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ids next to the frontier (column id)."""
    return incident(edges, frontier).select(F.col("b").alias("id")).distinct()


def apply_net(edges: DataFrame, net: DataFrame) -> DataFrame:
    """The graph after net operations (src, dst, op): deletions go, insertions (of absent edges, as net ones are) come."""
    gone = net.where("op = 'D'").select("src", "dst")
    new = net.where("op = 'I'").select("src", "dst")
    return edges.join(gone, ["src", "dst"], "left_anti").unionByName(new)


def lcg(id: Column) -> Column:
    """A portable pseudo-random key for priorities (ids below 8e9)."""
    return (id * 1103515245 + 12345) % 2147483648
