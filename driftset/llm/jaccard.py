"""N-gram Jaccard join by a blocked sparse product of document by n-gram.

1. Every text becomes a set of n-gram hashes.  Equal sets are one class (one
   row of the matrix), by their 64-bit set hash.
2. The incidences are dealt to column blocks by n-gram hash.  A block keeps
   one copy of each row and drops columns with a single row, as those add to
   no product.
   A row stays in a column only if another row of like size has it.
3. Size bound on rows: a link needs an overlap of at least t * |x|, so a row
   with fewer shared columns is gone.  This leaves near copies.
4. Size bound on columns: of the rarest-first columns of a row only the first
   |x| - ceil(t * |x|) + 1 can be the first that it shares with a linked row.
   Rows that share such a column are candidates; their connected components
   are the row blocks.
5. Each component is multiplied in dense tiles, block of columns by block of
   columns, accumulating exact overlap counts; pairs below the bounds go.
   A component larger than a tile is first compared to its most central row:
   rows linked to it are connected already, so only the other rows are
   multiplied with all tiles.  Tasks return links that span their groups,
   never all pairs.

Links are exact up to 64-bit hashing of n-grams; no bucket is capped.

Defined cases: null and wordless texts have an empty set and are linked to
nothing; a text with fewer than n words is one n-gram; equal texts are linked
whatever their length; repeated rows get the same component each; a null
doc_id never names a component unless all of it are null; an empty table
gives no rows; extra columns pass through :func:`keep_one_of_each`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.operators.components import components
from driftset.llm.textblocks import U64, Chunk, chunks, distinct_pairs, mix, pieces, shingles, span_hash, tidy

#: Rows of a tile, and columns multiplied at a time.
TILE, COLUMNS = 512, 4096


def sets_of(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes with their documents, and size and node of each document."""
    low = c.lowered()
    starts, ends, doc = low.words()
    n = c.hi - c.lo
    words = span_hash(low.prefix(), starts, ends) if len(starts) else np.zeros(0, U64)
    h, d = distinct_pairs(*shingles(words, doc, n, k))
    size = np.bincount(d, minlength=n)
    node = np.zeros(n, U64)
    np.add.at(node, d, mix(h ^ U64(0x5851F42D4C957F2D)))
    return h, d, size, mix(node + size.astype(U64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def with_nodes(docs: DataFrame, k: int, text: str, node: str, size: str) -> DataFrame:
    """``docs`` with the class (``node``) and the set size of each text."""
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sets_of(c, k)[2:] for c in chunks(b.column(at))]
            sizes = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
            nodes = np.concatenate([x[1] for x in found]) if found else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_signed(nodes)), pa.array(sizes.astype(np.int64))], names=[*b.schema.names, "node", "size"])

    return plain.mapInArrow(tidy(run), f"{kinds}, node bigint, size bigint").toDF(*docs.columns, node, size)


def _least(t: int) -> int:
    """Smaller sets are linked to equal ones only."""
    return -(-t // (100 - t)) if t < 100 else 1 << 62


def _incidences(docs: DataFrame, k: int, t: int, blocks: int) -> DataFrame:
    """dest, blob: the n-grams of a chunk of documents that fall in one column block."""
    least = _least(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for c in chunks(b.column(0)):
                h, d, size, node = sets_of(c, k)
                fresh = np.zeros(len(size), bool)
                for i in np.flatnonzero(size >= least):
                    if int(node[i]) not in seen:
                        seen.add(int(node[i]))
                        fresh[i] = True
                ok = fresh[d]
                h, d = h[ok], d[ok]
                dest = ((h >> U64(48)) % U64(blocks)).astype(np.int64)
                order = np.argsort(dest, kind="stable")
                h, d = h[order], d[order]
                cuts = np.searchsorted(dest[order], np.arange(blocks + 1))
                out = []
                for s in np.flatnonzero(np.diff(cuts)):
                    e = slice(cuts[s], cuts[s + 1])
                    u, n = np.unique(d[e], return_counts=True)
                    blob = b"".join(x.tobytes() for x in (
                        np.array([len(u)], np.uint32), node[u], size[u].astype(np.uint32), n.astype(np.uint32),
                        (h[e] & U64(0xFFFFFFFF)).astype(np.uint32), ((h[e] >> U64(32)) & U64(0xFFFF)).astype(np.uint16)))
                    out.append((int(s), blob))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["dest", "blob"])

    return docs.mapInArrow(tidy(run), "dest int, blob binary")


def _column_block(blobs: list[bytes], dest: int, t: int) -> tuple[np.ndarray, ...]:
    """node, size, start offsets, n-gram ids and row counts of the shared columns."""
    nodes, sizes, counts, hashes = [], [], [], []
    for x in blobs:
        m = int(np.frombuffer(x, np.uint32, 1)[0])
        nodes.append(np.frombuffer(x, np.uint64, m, 4))
        sizes.append(np.frombuffer(x, np.uint32, m, 4 + 8 * m))
        n = np.frombuffer(x, np.uint32, m, 4 + 12 * m)
        counts.append(n)
        total = int(n.sum())
        low = np.frombuffer(x, np.uint32, total, 4 + 16 * m).astype(U64)
        hashes.append(low | (np.frombuffer(x, np.uint16, total, 4 + 16 * m + 4 * total).astype(U64) << U64(32)))
    node, size, count, h = (np.concatenate(x) for x in (nodes, sizes, counts, hashes))
    # one copy of each row: other partitions may have sent the same set
    _, first = np.unique(node, return_index=True)
    keep = np.zeros(len(node), bool)
    keep[first] = True
    h = h[np.repeat(keep, count)]
    node, size, count = node[keep], size[keep], count[keep]
    row = np.repeat(np.arange(len(node)), count)
    order = np.lexsort((size[row], h))
    s, z = h[order], size[row][order].astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    df = np.bincount(np.cumsum(new) - 1)
    many = np.zeros(len(h), np.int64)
    many[order] = np.repeat(df, df)
    # linked rows have like sizes: of the rows of a column, sorted by size, a row
    # counts only if the one before or after it is within the bound
    like = ~new[1:] & (100 * z[:-1] >= t * z[1:])
    useful = np.zeros(len(s), bool)
    useful[1:] |= like
    useful[:-1] |= like
    shared = np.zeros(len(h), bool)
    shared[order] = useful
    row, h, many = row[shared], h[shared], many[shared]
    held = np.bincount(row, minlength=len(node))
    some = held > 0
    return node[some], size[some], held[some], h | (U64(dest & 0xFFFF) << U64(48)), many


def _rows_of(blobs: list[bytes], t: int) -> Iterator[pa.RecordBatch]:
    """The rows of a node range that pass the size bound, put together from all column blocks."""
    nodes, sizes, counts, ids, dfs = [], [], [], [], []
    for x in blobs:
        m, dest = np.frombuffer(x, np.uint32, 2).tolist()
        nodes.append(np.frombuffer(x, np.uint64, m, 8))
        sizes.append(np.frombuffer(x, np.uint32, m, 8 + 8 * m))
        n = np.frombuffer(x, np.uint32, m, 8 + 12 * m).astype(np.int64)
        counts.append(n)
        total, at = int(n.sum()), 8 + 16 * m
        low = np.frombuffer(x, np.uint32, total, at).astype(U64)
        ids.append(low | (np.frombuffer(x, np.uint16, total, at + 4 * total).astype(U64) << U64(32)) | (U64(dest) << U64(48)))
        dfs.append(np.frombuffer(x, np.uint16, total, at + 6 * total))
    node, size, count, h, df = (np.concatenate(x) for x in (nodes, sizes, counts, ids, dfs))
    names, at = np.unique(node, return_inverse=True)
    held = np.bincount(at, weights=count, minlength=len(names)).astype(np.int64)
    n = np.zeros(len(names), np.int64)
    n[at] = size
    stays = 100 * held >= t * n
    keep = np.repeat(stays[at], count)
    row = np.repeat(at, count)[keep]
    h, df = h[keep], df[keep]
    order = np.argsort(row, kind="stable")
    row, h, df = row[order], h[order], df[order]
    some = np.flatnonzero(stays)
    lo, hi = np.searchsorted(row, some), np.searchsorted(row, some, side="right")
    for c in range(0, len(some), 1024):
        e = some[c : c + 1024]
        cut = list(zip(lo[c : c + 1024].tolist(), hi[c : c + 1024].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_signed(names[e])), pa.array(n[e]), pa.array(held[e]), pa.array([float(df[a:z].sum()) for a, z in cut]),
             pa.array([h[a:z].tobytes() for a, z in cut], pa.binary()), pa.array([df[a:z].tobytes() for a, z in cut], pa.binary())],
            names=["node", "n", "held", "common", "ids", "df"])


def _by_dest(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    by: dict[int, list[bytes]] = {}
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(s, []).append(x)
    return by


def shared_columns(docs: DataFrame, k: int, t: int) -> DataFrame:
    """Rows that pass the size bound: node, n, held, common, and their shared columns (ids, df)."""
    blocks = min(1 << 16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _by_dest(batches)
        for s in list(by):
            node, size, held, ids, df = _column_block(by.pop(s), s, t)
            to = (node % U64(blocks)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(blocks + 1))
            inner = np.argsort(np.repeat(np.argsort(order, kind="stable"), held), kind="stable")
            ids, df = ids[inner], np.minimum(df[inner], 65535).astype(np.uint16)
            node, size, held = node[order], size[order].astype(np.uint32), held[order].astype(np.uint32)
            ends = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
            out = []
            for p in np.flatnonzero(np.diff(cuts)):
                e, i = slice(cuts[p], cuts[p + 1]), slice(ends[cuts[p]], ends[cuts[p + 1]])
                out.append((int(p), b"".join(x.tobytes() for x in (
                    np.array([cuts[p + 1] - cuts[p], s], np.uint32), node[e], size[e], held[e], (ids[i] & U64(0xFFFFFFFF)).astype(np.uint32),
                    ((ids[i] >> U64(32)) & U64(0xFFFF)).astype(np.uint16), df[i]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["dest", "blob"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _by_dest(batches)
        for s in list(by):
            yield from _rows_of(by.pop(s), t)

    blobs = _incidences(docs, k, t, blocks).repartitionById(blocks, F.col("dest")).mapInArrow(tidy(columns), "dest int, blob binary")
    return blobs.repartitionById(blocks, F.col("dest")).mapInArrow(tidy(rows), "node bigint, n bigint, held bigint, common double, ids binary, df binary")


def _prefix(rows: DataFrame, t: int) -> DataFrame:
    """g, node: the columns of each row that a linked row may share first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            gs, ns = [], []
            for node, n, held, raw, counts in zip(*(b.column(i).to_pylist() for i in range(5))):
                ids, df = np.frombuffer(raw, np.uint64), np.frombuffer(counts, np.uint16)
                # columns of its own come first in this order and lead nowhere
                many = n - -(-n * t // 100) + 1 - (n - held)
                gs.append(ids[np.lexsort((ids, df))[:many]])
                ns.append(np.full(len(gs[-1]), node))
            if gs:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(gs))), pa.array(np.concatenate(ns))], names=["g", "node"])

    return rows.select("node", "n", "held", "ids", "df").mapInArrow(tidy(run), "g bigint, node bigint")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact overlap counts of two tiles, a block of columns at a time."""
    both = np.concatenate(left + right)
    cols, inverse = np.unique(both, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(inverse, kind="stable")
    row, col = row[order], inverse[order]
    cuts = np.searchsorted(col, np.arange(0, len(cols) + COLUMNS, COLUMNS))
    out = np.zeros((len(left), len(right)), np.float32)
    for b in range(len(cuts) - 1):
        e = slice(cuts[b], cuts[b + 1])
        tile = np.zeros((len(left) + len(right), min(COLUMNS, len(cols) - b * COLUMNS)), np.float32)
        tile[row[e], col[e] - b * COLUMNS] = 1
        out += tile[: len(left)] @ tile[len(left) :].T
    return out


def _links(n1: np.ndarray, n2: np.ndarray, overlap: np.ndarray, t: int) -> np.ndarray:
    return 100 * overlap.astype(np.int64) >= t * (n1[:, None] + n2[None, :] - overlap.astype(np.int64))


def _spanning(links: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Edges (row, root) that connect what the links connect."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            before = root.copy()
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            root = root[root]
            if (root == before).all():
                break
    return [(i, int(r)) for i, r in enumerate(root) if i != r]


def _multiply(rows: list[tuple[int, int, int, bytes]], t: int) -> list[tuple[int, int]]:
    """Spanning links of one group: (node, n, side, ids); sides 0 and 1 are multiplied, or side 0 with itself."""
    rows.sort(key=lambda r: (r[2], r[0]))
    node, n, side = (np.array([r[i] for r in rows]) for i in range(3))
    ids = [_ids(r[3]) for r in rows]
    first = int((side == 0).sum())
    pair = first < len(rows)
    right = slice(first, len(rows)) if pair else slice(0, len(rows))
    found = []
    for a in range(0, first, TILE):
        z = min(a + TILE, first)
        for c in range(right.start, right.stop, TILE):
            y = min(c + TILE, right.stop)
            if not pair and y <= a:
                continue
            i, j = np.nonzero(_links(n[a:z], n[c:y], overlaps(ids[a:z], ids[c:y]), t))
            found.append((i + a, j + c))
    return [(int(node[i]), int(node[r])) for i, r in _spanning(found, len(rows))]


def _group_links(rows: DataFrame, t: int, keys: list[str]) -> DataFrame:
    """a, b: spanning links of each group of rows (keys.., node, n, side, ids)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys).select(*keys, "node", "n", "side", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []

        def edges() -> pa.RecordBatch:
            out = _multiply(group, t) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        for b in pieces(batches):
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if r[: len(keys)] != last:
                    if group:
                        yield edges()
                    last, group = r[: len(keys)], []
                group.append(r[len(keys) :])
        if group:
            yield edges()

    return dealt.mapInArrow(tidy(run), "a bigint, b bigint")


def _with_pivot(rows: DataFrame, t: int) -> DataFrame:
    """comp, node, linked: whether a row is linked to the pivot of its component, and the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out, cache = [], {}
            for comp, node, n, raw, pivot, pn, praw in zip(*(b.column(i).to_pylist() for i in range(7))):
                if pivot not in cache:
                    cache = {pivot: _ids(praw)}
                both = len(np.intersect1d(_ids(raw), cache[pivot], assume_unique=True))
                out.append((comp, node, 100 * both >= t * (n + pn - both), pivot))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["comp", "node", "linked", "pivot"])

    # the row whose columns are held by the most rows on average: copies stray from it
    pivots = rows.groupBy("comp").agg(F.max_by(F.struct(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("ids").alias("pids")), F.struct(F.col("common") / F.col("n"), "node")).alias("p"))
    return rows.join(pivots, "comp").select("comp", "node", "n", "ids", "p.pivot", "p.pn", "p.pids").mapInArrow(tidy(run), "comp bigint, node bigint, linked boolean, pivot bigint")


def node_links(docs: DataFrame, k: int, t: int, text: str = "text") -> DataFrame:
    """a, b: links that span each component of different sets."""
    rows = materialise(shared_columns(docs.select(F.col(f"`{text}`").alias("text")), k, t), "jaccard-rows")
    inc = materialise(_prefix(rows, t), "jaccard-prefix")
    hubs = inc.groupBy("g").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1")
    stars = inc.join(hubs, "g").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    comps = components(stars).withColumnRenamed("root", "comp")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("m"))
    held = materialise(
        rows.join(comps, "node").join(sizes, "comp").select("comp", "m", "node", "n", "common", "ids"), "jaccard-groups")
    small = held.where(F.col("m") <= TILE).select("comp", "node", "n", F.lit(0).alias("side"), "ids")
    links = _group_links(small, t, ["comp"])
    large = held.where(F.col("m") > TILE)
    if large.limit(1).count():
        near = materialise(_with_pivot(large, t), "jaccard-pivot")
        links = links.unionByName(near.where("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        tiles = near.groupBy("comp").agg(F.ceil(F.sum(F.when(F.col("linked"), 1).otherwise(0)) / TILE).alias("r"), F.ceil(F.sum(F.when(F.col("linked"), 0).otherwise(1)) / TILE).alias("u"))
        rows2 = large.join(near.select("comp", "node", "linked"), ["comp", "node"]).join(tiles, "comp").where("u > 0")
        own = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("r")).otherwise(F.col("u")))
        rows2 = rows2.withColumn("own", own)
        # tiles 0..u-1 hold rows not linked to the pivot, u..u+r-1 the others: u tiles meet all, the rest only those
        rows2 = rows2.withColumn("tile", F.col("own") + F.when(F.col("linked"), F.col("u")).otherwise(F.lit(0)))
        other = F.explode(F.when(F.col("linked"), F.sequence(F.lit(0).cast("bigint"), F.col("u") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("u") + F.col("r") - 1)))
        rows2 = rows2.select("*", other.alias("other"))
        pairs = rows2.select(
            "comp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "n",
            F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("side"), "ids")
        links = links.unionByName(_group_links(pairs, t, ["comp", "i", "j"]))
    return links


def jaccard_components(nodes: DataFrame, docs: DataFrame, k: int, t: int, text: str = "text") -> DataFrame:
    """``nodes`` (doc_id, node, size) with comp, a 64-bit name of the component, and component_id."""
    roots = components(node_links(docs, k, t, text))
    rows = nodes.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    first = rows.where("size > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return (
        rows.join(first, "comp", "left")
        .withColumn("component_id", F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id"))).drop("least")
    )


def keep_one_of_each(docs: DataFrame, k: int = 5, t: int = 80, text: str = "text") -> DataFrame:
    """One row of each component stays: that of the least doc_id; empty texts all stay."""
    tag = uuid.uuid4().hex[:8]
    node, size = f"node_{tag}", f"size_{tag}"
    placed = with_nodes(docs, k, text, node, size)
    nodes = materialise(placed.select("doc_id", F.col(node).alias("node"), F.col(size).alias("size")), "jaccard-nodes")
    comps = jaccard_components(nodes, docs, k, t, text)
    # of each component the row with the least doc_id, then the least set
    best = comps.where("size > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("b"))
    keys = materialise(best.select(F.col("b.doc_id").alias("keep_id"), F.col("b.node").alias("keep_node")), "jaccard-keep")
    staying = placed.join(keys, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col(node) == F.col("keep_node")), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    twice = materialise(
        nodes.where("size > 0").join(keys, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node")), "left_semi")
        .groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("d2"), F.col("node").alias("n2")), "jaccard-twice")
    again = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col(node) == F.col("n2"))
    out = staying.where(F.col(size) > 0)
    if twice.limit(1).count():  # rows that repeat both id and set: any one of them
        out = out.join(twice, again, "left_anti").select(*docs.columns, node).unionByName(
            out.join(twice, again, "left_semi").select(*docs.columns, node).dropDuplicates(["doc_id", node]))
    return out.select(*names).unionByName(placed.where(F.col(size) == 0).select(*names))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str, k: int = 3, t: int = 90) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nodes = materialise(with_nodes(docs.select("doc_id", "text"), k, "text", "node", "size").drop("text"), "jaccard-nodes")
    out = jaccard_components(nodes, docs, k, t)
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS sh FROM w),
z AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * c >= 90 * (u.n + v.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM z UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.doc_id)
SELECT r.doc_id, z.n AS n_shingles, min(r.root) AS component_id FROM r JOIN z USING (doc_id) GROUP BY r.doc_id, z.n
"""
