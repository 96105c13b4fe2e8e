"""Substring dedup: removes every byte covered by a long string that recurs.

A distributed, common-prefix-aware merge sort of sampled suffixes decides:

1. Sampling.  Each window of ``LENGTH`` bytes has an anchor, the place of the
   least hash of its ``GRAM``-byte grams, so equal windows have equal anchors.
   The windows of one anchor are consecutive; they are one suffix sample, cut
   after the last byte that they cover.  Anchors whose gram occurs once cannot
   have a twin (the distinguishing prefix of their suffix is shorter than the
   gram) and drop out by a count of fingerprints.
2. Sorting.  Each task sorts its samples, merges equal ones, and front-codes
   the run (length of the common prefix with the one before, then the rest).
   Runs are exchanged by range and combined by a loser tree that keeps common
   prefix lengths and never compares a known prefix again.  Samples equal to
   another one recur as a whole.
3. Margins.  A sample without an equal can still share some windows (where
   copies end or differ).  Those, and one of each class of equal samples, send
   a fingerprint per window, keyed by gram and offset, and equal ones are found.
4. Removal.  The union of the recurring windows of each document is cut out.

Passages of over 50 words need not have 400 bytes, so besides (and without any
effect on what is removed) the words of each document that lie in a passage of
``WORDS`` or more words shared with another document are counted, by steps 1
and 3 on words in place of bytes.

No document leaves its rows: texts are written once, and small tables sorted
by row number are read back by range where the texts are.  Matches never
cross documents; fingerprints have 64 bits besides a 64-bit gram hash.

Defined cases: a null text is empty; shorter texts than ``LENGTH`` bytes lose
nothing; a string that recurs within one document counts; repeated rows are
documents of their own, so each is removed whole if long enough; a text of
fewer than ``WORDS`` words shares no passage; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions.shared import fresh_path, materialise
from driftset.llm.textblocks import U64, Chunk, _Powers, chunks, mix, span_hash

LENGTH, GRAM = 400, 100
#: The same for passages, in words.
WORDS, WORD_GRAM = 51, 12
RUN_BYTES = 32 << 20
#: Text that is hashed at a time, and samples a map task holds before it passes them on.
CHUNK, HELD = 1 << 20, 1 << 18
#: Documents whose samples place the range splitters; they affect balance alone.
SPLIT_DOCS = 400


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, in a constant number of passes."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Units:
    """The bytes or the words of a chunk: where documents begin, and hashes of ranges."""

    def __init__(self, c: Chunk, words: bool = False):
        if not words:
            self.n, self.offs, self.pre = len(c.data), c.offs, c.prefix()
            return
        starts, ends, doc = c.words()
        self.n = len(starts)
        self.offs = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=c.hi - c.lo))))
        up, _ = _Powers.upto(self.n)
        self.pre = np.zeros(self.n + 1, U64)
        np.cumsum(span_hash(c.prefix(), starts, ends) * up[: self.n], out=self.pre[1:])

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        return span_hash(self.pre, starts, starts + length)


def samples(u: Units, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, anchor, first and last window, and gram hash of each sample (positions in the chunk)."""
    n = u.n
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(U64)
    at = np.arange(n - gram + 1)
    g = u.hashes(at, gram)
    bits = U64(max(24, int(n).bit_length()))
    low = sliding_min(((g >> bits) << bits) | at.astype(U64), length - gram + 1)
    anchor = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    i = np.arange(n - length + 1)
    doc = np.repeat(np.arange(len(u.offs) - 1), np.diff(u.offs))[: len(i)]
    ok = i + length <= u.offs[doc + 1]
    i, doc, anchor = i[ok], doc[ok], anchor[ok]
    if not len(i):
        return i, i, i, i, i.astype(U64)
    new = np.ones(len(i), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(i)])) - 1
    return doc[first], anchor[first], i[first], i[last], g[anchor[first]]


# ---------------------------------------------------------------- strings


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (m - (d.bit_length() + 7) // 8 if d else m)
        known += step
        step = min(step * 2, 1024)
    return n


def front_code(strings: list[bytes]) -> list[tuple[int, bytes]]:
    out, before = [], b""
    for s in strings:
        n = common_prefix(before, s, 0)
        out.append((n, s[n:]))
        before = s
    return out


class LoserTree:
    """Merges front-coded sorted runs; yields (string, prefix shared with the one before, run)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.runs = runs + [iter(())] * (self.k - len(runs))
        self.head: list[bytes | None] = [None] * self.k
        self.shared = [0] * self.k  # prefix that a head shares with the last output
        for r in range(self.k):
            self._advance(r, b"")

    def _advance(self, r: int, before: bytes) -> None:
        x = next(self.runs[r], None)
        if x is None:
            self.head[r] = None
        else:
            n, rest = x
            self.head[r], self.shared[r] = before[:n] + rest, n

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix is then the one shared with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = self.shared[a], self.shared[b]
        if p != q:  # who shares more with the last output is smaller; nothing to compare
            return (a, b) if p > q else (b, a)
        n = common_prefix(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        k = self.k
        loser, winner = [0] * k, [0] * (2 * k)
        for r in range(k):
            winner[k + r] = r
        for node in range(k - 1, 0, -1):
            winner[node], loser[node] = self._play(winner[2 * node], winner[2 * node + 1])
        top = winner[1]
        while self.head[top] is not None:
            s = self.head[top]
            yield s, self.shared[top], top
            self._advance(top, s)
            node = (k + top) >> 1
            while node:
                top, loser[node] = self._play(top, loser[node])
                node >>= 1


# ---------------------------------------------------------------- stages


class Side:
    """A table sorted by rid, read by range of rid from the shared folder."""

    def __init__(self, path: str):
        self.table = pads.dataset(path, format="parquet")

    def of(self, rid: np.ndarray) -> dict[str, np.ndarray]:
        if not len(rid):
            found = self.table.schema.empty_table()
        else:
            found = self.table.to_table(filter=(pads.field("rid") >= int(rid.min())) & (pads.field("rid") <= int(rid.max())))
        cols = {n: found.column(n).to_numpy() for n in found.column_names}
        order = np.argsort(cols["rid"], kind="stable")
        return {n: v[order] for n, v in cols.items()}


def _side(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid").sortWithinPartitions("rid").write.parquet(path)
    return path


def _with_side(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[np.ndarray, Chunk, dict[str, np.ndarray]]]:
    """Chunks with row numbers and the rows of a side table that belong to them (``doc`` in the chunk)."""
    side = Side(path)
    for b in batches:
        rid = b.column(0).to_numpy()
        found = side.of(rid)
        for c in chunks(b.column(1), CHUNK):
            mine = rid[c.lo : c.hi]
            order = np.argsort(mine)
            at = np.searchsorted(mine[order], found["rid"])
            hit = (at < len(mine)) & (mine[order][np.minimum(at, len(mine) - 1)] == found["rid"]) if len(mine) else np.zeros(len(at), bool)
            rows = {n: v[hit] for n, v in found.items()}
            rows["doc"] = order[at[hit]]
            yield mine, c, rows


def _recurring_grams(docs: DataFrame, length: int, gram: int, blocks: int, words: bool = False) -> DataFrame:
    """rid, pos, lo, hi, g of the samples whose gram occurs at least twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            g, *cols = (np.concatenate(x) for x in zip(*held))
            dest = (g % U64(blocks)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            cuts = np.searchsorted(dest[order], np.arange(blocks + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                e = order[cuts[s] : cuts[s + 1]]
                out.append((int(s), b"".join(x[e].tobytes() for x in (g, *cols))))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["dest", "blob"])

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            rid = b.column(0).to_numpy()
            for c in chunks(b.column(1), CHUNK):
                u = Units(c, words)
                doc, pos, lo, hi, g = samples(u, length, gram)
                if len(g):
                    base = u.offs[doc]
                    held.append((g, rid[c.lo + doc].astype(np.int64), *((v - base).astype(np.uint32) for v in (pos, lo, hi))))
                    n += len(g)
                if n > HELD:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(x) // 28
                by.setdefault(s, []).append((np.frombuffer(x, np.uint64, n), np.frombuffer(x, np.int64, n, 8 * n), *(np.frombuffer(x, np.uint32, n, (16 + 4 * i) * n) for i in range(3))))
        for s in list(by):
            g, rid, pos, lo, hi = (np.concatenate(v) for v in zip(*by.pop(s)))
            order = np.argsort(g, kind="stable")
            t = g[order]
            twin = np.zeros(len(t), bool)
            twin[1:] |= t[1:] == t[:-1]
            twin[:-1] |= t[1:] == t[:-1]
            e = order[twin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[e]), *(pa.array(v[e].astype(np.int64)) for v in (pos, lo, hi)), pa.array(g[e].view(np.int64))], names=["rid", "pos", "lo", "hi", "g"])

    dealt = docs.select("rid", "text").mapInArrow(emit, "dest int, blob binary").repartitionById(blocks, F.col("dest"))
    return dealt.mapInArrow(count, "rid bigint, pos bigint, lo bigint, hi bigint, g bigint")


def _encode(run: list[tuple[int, bytes]], owners: list[list[tuple[int, ...]]]) -> bytes:
    n = len(run)
    return b"".join((
        np.array([n], np.uint32).tobytes(), np.array([x[0] for x in run], np.uint32).tobytes(), np.array([len(x[1]) for x in run], np.uint32).tobytes(),
        np.array([len(o) for o in owners], np.uint32).tobytes(), np.array([x for o in owners for x in o], np.int64).tobytes(), *(x[1] for x in run)))


def _decode(blob: bytes) -> tuple[list[tuple[int, bytes]], list[np.ndarray]]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    shared, size, many = (np.frombuffer(blob, np.uint32, n, 4 + 4 * n * i).astype(np.int64) for i in range(3))
    at = 4 + 12 * n
    owners = np.frombuffer(blob, np.int64, int(many.sum()) * 5, at).reshape(-1, 5)
    at += owners.nbytes
    ends = at + np.cumsum(size)
    run = [(int(s), blob[e - z : e]) for s, z, e in zip(shared, size.tolist(), ends.tolist())]
    return run, np.split(owners, np.cumsum(many)[:-1]) if n else []


def _merged(docs: DataFrame, side: str, splitters: list[bytes], blocks: int) -> DataFrame:
    """rid, pos, lo, hi, g, whole, probe: whether a sample recurs whole, and whether its windows are to be compared."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, ...]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            cuts = [0, *(bisect_right(keys, s) for s in splitters), len(keys)]
            out = []
            for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if z > a:
                    out.append((i, _encode(front_code(keys[a:z]), [held[k] for k in keys[a:z]])))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["dest", "blob"])

        for mine, c, rows in _with_side(batches, side):
            data = c.data.tobytes()
            for doc, pos, lo, hi, g, rid in zip(*(rows[n].tolist() for n in ("doc", "pos", "lo", "hi", "g", "rid"))):
                o = int(c.offs[doc])
                s = data[o + lo : o + hi + LENGTH]
                got = held.get(s)
                if got is None:
                    held[s] = [(rid, pos, lo, hi, g)]
                    size += len(s) + 150
                else:
                    got.append((rid, pos, lo, hi, g))
            if size > RUN_BYTES:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(s, []).append(x)
        for s in list(by):
            decoded = [_decode(x) for x in by.pop(s)]
            owners = [iter(d[1]) for d in decoded]
            out: list[np.ndarray] = []
            before, cls = None, []

            def close() -> None:
                if cls:
                    rows = np.concatenate(cls)
                    flags = np.zeros((len(rows), 2), np.int64)
                    flags[:, 0] = len(rows) > 1
                    flags[0, 1] = 1  # one of each class is compared window by window
                    out.append(np.concatenate((rows, flags), axis=1))

            for string, shared, run in LoserTree([iter(d[0]) for d in decoded]):
                if before is None or not (shared == len(string) == before):
                    close()
                    cls = []
                before = len(string)
                cls.append(next(owners[run]))
            close()
            if out:
                x = np.concatenate(out)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[:, i]) for i in range(5)), pa.array(x[:, 5] == 1), pa.array(x[:, 6] == 1)], names=["rid", "pos", "lo", "hi", "g", "whole", "probe"])

    dealt = docs.select("rid", "text").mapInArrow(emit, "dest int, blob binary").repartitionById(blocks, F.col("dest"))
    return dealt.mapInArrow(merge, "rid bigint, pos bigint, lo bigint, hi bigint, g bigint, whole boolean, probe boolean")


def _margins(docs: DataFrame, side: str, length: int, blocks: int, words: bool = False) -> DataFrame:
    """rid, lo, hi: runs of windows that recur, among the samples to be compared; of words, in another document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, c, rows in _with_side(batches, side):
            if not len(rows["rid"]):
                continue
            u = Units(c, words)
            base = u.offs[rows["doc"]]
            n = (rows["hi"] - rows["lo"] + 1).astype(np.int64)
            who = np.repeat(np.arange(len(n)), n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + rows["lo"][who]
            prints = u.hashes(base[who] + start, length)
            back = (rows["pos"][who] - start).astype(np.int64)
            # equal windows lie at one offset from their gram, so gram and offset deal them out
            dest = (mix(rows["g"].view(U64)[who] + (back >> 4).astype(U64)) % U64(blocks)).astype(np.int64)
            order = np.lexsort((who, dest))
            cuts = np.searchsorted(dest[order], np.arange(blocks + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                e = order[cuts[s] : cuts[s + 1]]
                # windows of one sample that go to one block, in runs of offsets
                edge = np.ones(len(e), bool)
                edge[1:] = (who[e][1:] != who[e][:-1]) | (start[e][1:] != start[e][:-1] + 1)
                f = np.flatnonzero(edge)
                k = np.diff(np.concatenate((f, [len(e)])))
                first = e[f]
                out.append((int(s), b"".join(x.tobytes() for x in (
                    np.array([len(f)], np.uint32), rows["rid"][who[first]].astype(np.int64), rows["g"][who[first]].astype(np.int64), start[first].astype(np.uint32),
                    back[first].astype(np.uint32), k.astype(np.uint32), prints[e]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["dest", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = int(np.frombuffer(x, np.uint32, 1)[0])
                rid, g = np.frombuffer(x, np.int64, m, 4), np.frombuffer(x, np.int64, m, 4 + 8 * m)
                start, back, k = (np.frombuffer(x, np.uint32, m, 4 + (16 + 4 * i) * m) for i in range(3))
                n = int(k.sum())
                by.setdefault(s, []).append((rid, g, start, back, k, np.frombuffer(x, np.uint64, n, 4 + 28 * m)))
        for s in list(by):
            rid, g, start, back, k, prints = (np.concatenate(v) for v in zip(*by.pop(s)))
            k = k.astype(np.int64)
            who = np.repeat(np.arange(len(k)), k)
            off = np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)
            key = mix(mix(g.view(U64)[who]) + (back[who].astype(np.int64) - off).astype(U64)) ^ prints
            order = np.argsort(key, kind="stable")
            t = key[order]
            twin = np.zeros(len(t), bool)
            twin[1:] |= t[1:] == t[:-1]
            twin[:-1] |= t[1:] == t[:-1]
            if words and len(t):
                owner = rid[who[order]]
                begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
                twin = np.repeat(several, np.diff(np.concatenate((begin, [len(t)]))))
            e = np.sort(order[twin])
            if len(e):
                at = start[who[e]].astype(np.int64) + off[e]
                edge = np.ones(len(e), bool)
                edge[1:] = (who[e][1:] != who[e][:-1]) | (at[1:] != at[:-1] + 1)
                f = np.flatnonzero(edge)
                last = np.concatenate((f[1:], [len(e)])) - 1
                yield pa.RecordBatch.from_arrays([pa.array(rid[who[e[f]]]), pa.array(at[f]), pa.array(at[last])], names=["rid", "lo", "hi"])

    dealt = docs.select("rid", "text").mapInArrow(emit, "dest int, blob binary").repartitionById(blocks, F.col("dest"))
    return dealt.mapInArrow(compare, "rid bigint, lo bigint, hi bigint")


def _splitters(docs: DataFrame, blocks: int, length: int, gram: int) -> list[bytes]:
    ids = docs.where(F.octet_length("text") >= length).select("rid").orderBy(F.xxhash64("rid")).limit(SPLIT_DOCS).collect()
    texts = [r.text for r in docs.where(F.col("rid").isin([r.rid for r in ids])).select("text").collect()] if ids else []
    found = []
    for c in chunks(pa.array(texts, pa.large_string())):
        data = c.data.tobytes()
        found += [data[a : a + 16] for a in samples(Units(c), length, gram)[2].tolist()]
    found = sorted(set(found))
    return [found[i * len(found) // blocks] for i in range(1, blocks)] if len(found) >= blocks else found


def shared_passages(rows: DataFrame, words: int = WORDS, gram: int = WORD_GRAM) -> str:
    """The path of a table rid, lo, hi of windows of ``words`` words that another row has too."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = _side(_recurring_grams(rows, words, gram, blocks, words=True), "passage-grams")
    return _side(_margins(rows, grams, words, blocks, words=True), "passages")


def recurring_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, str]:
    """The written rows (rid, doc_id, text), and the path of a table rid, lo, hi of recurring windows."""
    if length != LENGTH:
        raise ValueError("samples are cut for windows of LENGTH bytes")
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), "suffix-rows")
    grams = _side(_recurring_grams(rows, length, gram, blocks), "suffix-grams")
    merged = materialise(_merged(rows, grams, _splitters(rows, blocks, length, gram), blocks), "suffix-merged")
    probe = _side(merged.where("probe").select("rid", "pos", "lo", "hi", "g"), "suffix-probe")
    spans = merged.where("whole").select("rid", "lo", "hi").unionByName(_margins(rows, probe, length, blocks))
    return rows, _side(spans, "suffix-spans")


def _covered(found: dict[str, np.ndarray], rid: np.ndarray, length: int) -> np.ndarray:
    """Units of each row that its windows ``lo..hi`` cover."""
    order = np.lexsort((found["lo"], found["rid"]))
    row, lo, end = (x[order] for x in (found["rid"], found["lo"], found["hi"] + length))
    out = np.zeros(len(rid), np.int64)
    if len(row):
        # the furthest end before each run, within its row
        head = np.concatenate(([True], row[1:] != row[:-1]))
        rank = np.cumsum(head)
        span = int(end.max()) + 1
        before = np.concatenate(([0], np.maximum.accumulate(end + rank * span)[:-1])) - rank * span
        fresh = np.maximum(0, end - np.maximum(lo, np.maximum(before, 0)))
        ids, at = np.unique(row, return_inverse=True)
        total = np.bincount(at, weights=fresh).astype(np.int64)
        k = np.minimum(np.searchsorted(ids, rid), len(ids) - 1)
        out = np.where(ids[k] == rid, total[k], 0)
    return out


def cut(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words and, if asked, the spans and the kept bytes."""
    rows, spans = recurring_spans(docs)
    passages = shared_passages(rows)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint" + (", spans array<struct<start: bigint, end: bigint>>, kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, others = Side(spans), Side(passages)
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            rid = b.column(0).to_numpy()
            found = side.of(rid)
            a, z = np.searchsorted(found["rid"], rid), np.searchsorted(found["rid"], rid, side="right")
            shared = _covered(others.of(rid), rid, WORDS)
            out: dict[str, list] = {n: [] for n in ("n", "gone", "spans", "sha", "kept")}
            for text, i, j in zip(b.column(2).cast(pa.binary()).to_pylist(), a.tolist(), z.tolist()):
                gone: list[list[int]] = []
                for lo, hi in sorted(zip(found["lo"][i:j].tolist(), found["hi"][i:j].tolist())):
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi + LENGTH)
                    else:
                        gone.append([lo, hi + LENGTH])
                kept, at = [], 0
                for x, y in gone:
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                left = b"".join(kept)
                out["n"].append(len(text)), out["gone"].append(len(text) - len(left)), out["spans"].append(gone)
                out["sha"].append(hashlib.sha256(left).hexdigest()), out["kept"].append(left if with_text else None)
            cols = [b.column(1), pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array([len(s) for s in out["spans"]], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(shared)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
            if with_text:
                cols += [pa.array([[{"start": x, "end": y} for x, y in s] for s in out["spans"]], pa.list_(pair)), pa.array(out["kept"], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.select("rid", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the words in passages of over 50 words that another document has too."""
    return cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
