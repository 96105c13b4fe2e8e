"""Update batches: splitting, chunking, classifying, net operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftset.operators.graph import is_adjacent, rank_by

# Portable pair keys, so that splits agree between engines.
KEY_A = "(src * 1103515245 + dst * 12345 + 1013904223) % 2147483648"
KEY_B = "(src * 22695477 + dst * 1664525 + 1) % 2147483648"


def ranked(edges: DataFrame, key: str, n: int | None = None) -> DataFrame:
    return rank_by(edges.withColumn("__key", F.expr(key)), "__key", ["src", "dst"], n=n).drop("__key")


def split(edges: DataFrame, per_mille: int, key: str, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Head and tail of the edges (``n`` of them, if known) in the order of a pair key; ranks are kept."""
    n = edges.count() if n is None else n
    r = ranked(edges, key, n)
    cut = n * per_mille // 1000
    return r.where(F.col("rank") < cut), r.where(F.col("rank") >= cut).withColumn("rank", F.col("rank") - cut)


def chunked(tail: DataFrame, size: int) -> DataFrame:
    """batch_id, seq, src, dst, op (null: toggle): fixed-size chunks of a ranked tail."""
    if size < 1:
        raise ValueError("a batch has at least one update")
    return tail.select(F.floor(F.col("rank") / size).cast("int").alias("batch_id"), F.col("rank").alias("seq"), "src", "dst", F.lit(None).cast("string").alias("op"))


def concatenated(first: DataFrame, second: DataFrame) -> DataFrame:
    """All updates of two streams, those of the second after those of the first."""
    ends = first.agg(F.coalesce(F.max("batch_id"), F.lit(-1)).alias("b"), F.coalesce(F.max("seq"), F.lit(-1)).alias("s")).first()
    later = second.withColumns({"batch_id": (F.col("batch_id") + ends.b + 1).cast("int"), "seq": (F.col("seq") + ends.s + 1).cast("bigint")})
    return first.unionByName(later)


def split_valid(updates: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates in canonical order on known vertices, and the rejected others with a reason."""
    v = vertices.select("id").distinct()
    known_s, known_d = (v.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}")) for c in ("src", "dst"))
    told = updates.join(known_s, "src", "left").join(known_d, "dst", "left")
    reason = (
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "missing endpoint").when(F.col("src") == F.col("dst"), "self-loop")
        .when(F.col("__src").isNull() | F.col("__dst").isNull(), "unknown vertex")
    )
    told = told.withColumn("reason", reason).drop("__src", "__dst")
    ok = told.where("reason is null").drop("reason")
    return ok.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}), told.where("reason is not null")


def endpoints(updates: DataFrame) -> DataFrame:
    """Distinct batch_id, id of the vertices that a batch names."""
    return updates.select("batch_id", F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()


def classify(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """The operation each update stands for against a fixed graph: D if the edge is there, else I."""
    return is_adjacent(updates, edges).withColumn("op", F.when(F.col("adjacent"), "D").otherwise("I")).drop("adjacent")


def net_toggle(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, op of the edges that an odd number of toggles flips."""
    odd = updates.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return classify(odd, edges).select("src", "dst", "op")


def net_explicit(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, op of the edges whose last operation by seq changes their state."""
    last = updates.where("op in ('I', 'D')").groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
    return is_adjacent(last, edges).where("(op = 'I') <> adjacent").select("src", "dst", "op")


def net_mixed(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, op of the edges that explicit operations and toggles (null op), in the order of seq, leave changed.

    The last explicit operation says what was there; an odd number of toggles after it says otherwise.
    """
    last = F.max(F.when(F.col("op").isNotNull(), F.col("seq"))).over(Window.partitionBy("src", "dst"))
    after = updates.where("op is null or op in ('I', 'D')").withColumn("__last", last)
    end = after.groupBy("src", "dst").agg(
        F.max(F.when(F.col("seq") == F.col("__last"), F.col("op"))).alias("last"),
        F.count_if(F.col("op").isNull() & (F.col("__last").isNull() | (F.col("seq") > F.col("__last")))).alias("n"))
    told = is_adjacent(end, edges)
    there = F.coalesce(F.col("last") == "I", F.col("adjacent")) != (F.col("n") % 2 == 1)
    return told.where(there != F.col("adjacent")).select("src", "dst", F.when(there, "I").otherwise("D").alias("op"))


def net_ops(updates: DataFrame, edges: DataFrame, mode: str = "toggle") -> DataFrame:
    """Net operations of one batch: all toggles, explicit ones alone, or both by seq."""
    if mode not in ("toggle", "explicit", "mixed"):
        raise ValueError(f"unknown mode {mode!r}")
    return {"toggle": net_toggle, "explicit": net_explicit, "mixed": net_mixed}[mode](updates, edges)


def presence_before(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """Each toggle with its own effect (op) when updates run in the order of seq."""
    turn = F.row_number().over(Window.partitionBy("src", "dst").orderBy("batch_id", "seq"))
    told = is_adjacent(updates.withColumn("__turn", turn), edges)
    there = F.col("adjacent") == (F.col("__turn") % 2 == 1)
    return told.withColumn("op", F.when(there, "D").otherwise("I")).drop("adjacent", "__turn")
