"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key.  Rows are range-split by that key within
their source (as many ranges as the square root of its rows, so neither a
range nor the list of ranges grows with a hot source), sorted inside each range,
and prefix sums of word counts run in two levels: inside a range by a window,
over the ranges of a source by a second window over one row per range.  The
budget of a source is then cut exactly: whole epochs, and of the last epoch
the rows before the cut; the row across the cut gives the words still missing.

Defined cases: a null text has size 0 and takes 0; a null source is a source
of its own and sorts last; a source of size 0 has target 0; repeated rows
share a key and count each on its own; an empty table gives no rows; extra
columns pass through :func:`mix_documents` whatever their names, as the row
travels in one struct; one named like a column that it adds is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftset.functions.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the position of a source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix as a share of all words, and the largest multiple of any source.
SHARE, EPOCHS = 1.5, 2


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: rank, source_size, rows, target.

    The fixed point of sharing by weight with caps is a water level: sources
    in the order of cap / weight are full up to the first whose cap lies
    above the level that the rest would share.  One row per source, so the
    windows are as small as the number of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # nulls last; strings compare by their UTF-8 bytes, that is, by code point
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint") - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    level = Window.orderBy("ratio", "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        per.withColumn("weight", w.cast("bigint"))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("full", F.col("ratio") < F.col("level"))
        .withColumn("at", F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight")))
        .select("source", "rank", "source_size", "rows", "target")
    )


def take(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds rank, source_size, target and taken to rows with source, size, key."""
    t = targets.select(F.col("source").alias("__of"), "rank", "source_size", "target", F.least(F.ceil(F.sqrt("rows")), F.lit(1 << 20)).alias("__n"))
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    # keys have 60 bits; the upper 40 pick one of __n equal ranges
    rows = rows.withColumn("__range", F.shiftright(F.shiftright("key", 20) * F.col("__n"), 40))
    inside = Window.partitionBy("rank", "__range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows


def _finish(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0).cast("bigint")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__inside") - F.col("__before")))
    return (
        rows.join(offsets, ["rank", "__range"])
        .withColumn("taken", (whole * F.col("size") + part).cast("bigint"))
        .drop("__n", "__range", "__inside", "__before")
    )


def mix(rows: DataFrame, small: DataFrame | None = None) -> DataFrame:
    """``rows`` (source, size, key and any others) with the words each gives.

    ``small`` has the same rows, narrow and materialised; it is read twice.
    """
    small = (rows if small is None else small).select("source", "size", "key")
    targets = source_targets(small)
    placed = take(rows, targets)
    small = take(small, targets)
    upto = Window.partitionBy("rank").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        small.groupBy("rank", "__range").agg(F.sum("size").alias("__sum"))
        .withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0))).drop("__sum")
    )
    return _finish(placed, offsets)


def random_key(doc_id: Column, source: Column) -> Column:
    """60 hash-random bits that depend on the row alone, so reruns agree."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in carry], words_in(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("source")).alias("key"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with size, source_size, target and taken.

    A row is in the mix if it gives words; taken / size says how often.
    """
    added = ("size", "source_size", "target", "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(row, "source", words_in(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("source")).alias("key"))
    small = materialise(keyed(docs, ["source"]), "mixing")
    return mix(whole, small).where("taken > 0").select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialise(keyed(docs, ["doc_id", "source"]), "mixing")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
             ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv
      FROM w),
t AS (SELECT source, rk, source_size,
             CASE WHEN ratio < lv THEN cap::DOUBLE
                  ELSE (SELECT lv FROM l WHERE ratio >= lv ORDER BY ratio, rk LIMIT 1) * weight::DOUBLE END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             floor(t.target + 0.5)::BIGINT AS budget
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM q
"""
