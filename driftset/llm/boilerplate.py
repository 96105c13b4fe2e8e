"""Line dedup by site-relative frequency.

Pages are grouped by host; the number of pages that contain a line is divided
by the number of pages of the host, and lines above a boilerplate ratio go
from every page of that host.  Line counts aggregate on (host, line), so a
hot host spreads over all tasks; the lines that go are at most
``lines per page / ratio`` a host, whatever the number of pages, and travel
as one array per host.  The planner broadcasts those arrays if their written
size allows it, and otherwise joins by host, where AQE splits a hot host.

A line on a single page is no repetition and stays, whatever its share; for
hosts of 20 pages or more the ratio alone says so.

Defined cases: a null text has no lines and stays null; a null host is a host
of its own; blank lines are never counted nor dropped; a line counts once per
row, so repeated rows count each; a page that loses all its lines stays with
an empty text; an empty table gives no rows; extra columns pass through.
Lines are compared by a 64-bit hash of their trimmed text within a host.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions.shared import materialise

#: A line goes if it is on more than this share of its host's pages ...
RATIO = 0.05
#: ... unless it is on one page alone, where it repeats nothing (and a site of one page would lose all).
LEAST = 2
_BLANK = " \t\r\x0b\f"
# Tags that end a line of visible text.
BREAKS = "p|div|li|ul|ol|br|h1|h2|h3|h4|h5|h6|nav|article|title|tr|td|table|section|header|footer|head|body|html|blockquote|pre|dt|dd"


def visible_lines(html: Column) -> Column:
    """The lines of visible text of a page, trimmed, none of them empty."""
    t = html
    for pattern in (r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>", r"(?s)<!--.*?-->"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, rf"(?i)</?({BREAKS})([ \t\r\n\f/][^>]*)?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), "[ \t\r\f]+", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANK)))


def boilerplate(pages: DataFrame, lines: str, host: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host and the sorted array ``gone`` of the line keys that go there."""
    blank = F.filter(F.col(lines), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    keys = pages.select(F.col(host).alias("h"), F.explode(F.array_distinct(F.transform(blank, _key))).alias("k"))
    counts = keys.groupBy("h", "k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = pages.groupBy(F.col(host).alias("of")).agg(F.count("*").alias("total"))
    return (
        counts.join(totals, F.col("h").eqNullSafe(F.col("of")))
        .where(F.col("n") > F.lit(ratio) * F.col("total"))
        .groupBy("h").agg(F.array_sort(F.collect_list("k")).alias("gone"))
    )


def drop_lines(pages: DataFrame, lines: str, host: str, kept: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` with the array column ``kept``: its lines without boilerplate.

    ``pages`` is read three times; give a table or a materialised frame.
    """
    found = materialise(boilerplate(pages, lines, host, ratio, least), "boilerplate")
    h, gone = (f"{x}_{uuid.uuid4().hex[:8]}" for x in ("h", "gone"))
    found = found.toDF(h, gone)
    stays = F.filter(F.col(lines), lambda x: (F.btrim(x, F.lit(_BLANK)) == "") | ~F.array_contains(F.col(gone), _key(x)))
    return (
        pages.join(found, F.col(host).eqNullSafe(F.col(h)), "left")
        .withColumn(kept, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(stays)).drop(h, gone)
    )


def dedup_documents(docs: DataFrame, site: str = "source", text: str = "text", chars: str = "n_chars", **limits) -> DataFrame:
    """The same rows and columns, ``text`` without the boilerplate of its site."""
    lines, kept = (f"{x}_{uuid.uuid4().hex[:8]}" for x in ("lines", "kept"))
    out = drop_lines(docs.withColumn(lines, F.split(F.col(f"`{text}`"), "\n")), lines, f"`{site}`", kept, **limits)
    changed = F.size(kept) < F.size(lines)
    new = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))
    fresh = {text: new}
    if chars in docs.columns:
        fresh[chars] = F.when(changed, F.char_length(new)).otherwise(F.col(f"`{chars}`")).cast(docs.schema[chars].dataType)
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])


def dedup_pages(pages: DataFrame, **limits) -> DataFrame:
    """page_id, host, lines and kept of every page."""
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("lines"))
    return drop_lines(materialise(told, "page-lines"), "lines", "host", "kept", **limits)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("bigint")
    m = F.coalesce(F.size("kept"), F.lit(0)).cast("bigint")
    return out.select("page_id", "host", F.greatest(n, F.lit(0)).alias("n_lines"), F.greatest(n - m, F.lit(0)).alias("n_dropped"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("kept_md5"))


SQL = rf"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script[^>]*>', '', 'g'),
    '(?is)<style[^>]*>.*?</style[^>]*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT rid, page_id, host, regexp_replace(regexp_replace(regexp_replace(t,
    '(?i)</?({BREAKS})([ \t\r\n\f/][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r\f]+', ' ', 'g') AS t FROM a),
c AS (SELECT rid, page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM b),
k AS (SELECT host, l, count(*) AS n FROM (SELECT rid, host, unnest(list_distinct(lines)) AS l FROM c) GROUP BY host, l),
h AS (SELECT host, count(*) AS total FROM c GROUP BY host),
g AS (SELECT k.host, list(k.l) AS gone FROM k JOIN h ON k.host IS NOT DISTINCT FROM h.host
      WHERE k.n >= {LEAST} AND k.n > {RATIO}::DOUBLE * h.total GROUP BY k.host),
r AS (SELECT page_id, c.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
      FROM c LEFT JOIN g ON c.host IS NOT DISTINCT FROM g.host)
SELECT page_id, host, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN kept IS NULL THEN NULL ELSE md5(coalesce(array_to_string(kept, chr(10)), '')) END AS kept_md5 FROM r
"""
