"""LM scoring with Elias-Fano n-gram tries, sharded by context.

Every token is one event: the token, the word before it and the word before
that (start marks where there is none).  Map tasks deal events to shards by
context; a shard builds tries from the training events and answers every
event against them:

* contexts are an Elias-Fano sequence with their training counts;
* below a context lie the tokens after it (bigrams) and the words before it;
  below each such pair lie the tokens after it (trigrams).  Every level is an
  Elias-Fano sequence relative to its parent, with Elias-Fano pointers into
  it and probabilities quantised to 16 bits; words are numbered by one more
  Elias-Fano sequence, so no level cuts a word's key;
* all levels lie in an unnamed memory-mapped file; a lookup is one successor
  search inside the parent's range.

Order 3 with exact backoff, smoothed by pseudo-counts of the lower order:
p(w | h) = (c(h, w) + MASS * lower(w)) / (c(h) + MASS), from the trigram over
the bigram to p0, which mixes the exact unigrams of all training words with
a uniform share for the V word types and, for words seen fewer than RARE
times, a byte-trigram model of words.  All
counts are over all training documents, and sums are whole numbers of small
units, so the score of a text follows from the data alone, whatever the
number of shards, chunks or partitions.

A word with more than HOT_SHARE of the training tokens is a context only
together with the word before it: p(w | pair) backs off to p0.  This is part
of the model; it keeps shards even too.  A pair that is still so frequent is
spread over all shards by token (and, for a triple that is itself that
frequent, by chunk of documents); each of its shards gets the counts of the
rest, so its totals stay exact.

Tasks hold the counts of the (at most TOP_WORDS) most frequent words; for
each other word map tasks name the shards that meet it, and a join with the
table of word counts sends its count there.  Every word is a context exactly
once (the last one before the end mark), so the same exchange yields the
exact unigram counts of the base score; the start mark stands in for the end
mark, of which there are as many.

Defined cases: a null text is empty and has one token, the end; a null
doc_id is a training document like others; repeated rows count and are
scored each on its own; without training rows every count is 0 and p0 is
uniform; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.llm.textblocks import U64, Chunk, chunks, distinct, mix, release, span_hash, tidy

#: Pseudo-counts of the lower order that a context of one or two words is given.
MASS1, MASS2 = 100.0, 3.0
#: A word with more than this share of the training tokens (at most 1 / HOT_SHARE of
#: them) is a context only together with the word before it.
HOT_SHARE = 0.002
#: Words whose counts each task has at hand; those of the others reach the shards by a join.
TOP_WORDS = 65_535
#: Words seen fewer times get a share from the byte model.
RARE = 8
#: Distinct words a map task holds before it passes their counts on.
HELD_WORDS = 1 << 21
#: Frequent pairs a map task names; they affect balance alone.
NAMED = 2048
#: Documents a chunk.
CHUNK_DOCS = 512
START, END = 0x0123456789AB, 0x0BA987654321
_H48, _PAIR = U64((1 << 48) - 1), U64(1 << 48)
_STEP = 8.0 / 65535
#: Sums travel as whole numbers of these units, so no order of adding changes them.
SCORE_UNIT, BASE_UNIT = 1e6, 1e9

# ---------------------------------------------------------------- byte model


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each byte (1..63), and how many bytes share the symbol."""
    sym = np.full(256, 63, np.uint8)
    sym[97:123] = np.arange(1, 27)
    sym[48:58] = 27
    sym[0xC3] = 28
    sym[0x80:0xC0] = 29 + np.arange(64) // 2
    sym[0xC4:] = sym[0xC0:0xC3] = 61
    sym[ord(".")] = 62
    return sym, np.bincount(sym, minlength=64)


_SYM, _SHARED = _classes()


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the byte events within words, their word, and of the word ends."""
    n = ends - starts
    word = np.repeat(np.arange(len(starts)), n)
    first = np.cumsum(n) - n
    # the symbols of the words one after another
    s = _SYM[data[np.arange(len(word)) + np.repeat(starts - first, n)]].astype(np.int32)
    code = s.copy()
    code[1:] |= s[:-1] << 6
    code[2:] |= s[:-2] << 12
    many = n >= 2
    code[first] = s[first]
    code[first[many] + 1] &= 0xFFF
    last = s[first + n - 1] << 6
    last[many] |= s[(first + n - 2)[many]] << 12
    return code, word, last


class ByteModel:
    """Interpolated byte-class trigrams; log10 probabilities of whole words."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(64, 64, 64).astype(float)
        c2 = c3.sum(0)
        c1 = c2.sum(0)
        p1 = (c1 + 1) / (c1.sum() + 64)
        p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
        p3 = (c3 + 4 * p2) / (c3.sum(2, keepdims=True) + 4)
        share = np.log10(np.maximum(_SHARED, 1))
        share[0] = 0
        self.cost = (share - np.log10(p3)).astype(np.float32).ravel()

    def costs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """-log10 p of each word, its end included."""
        code, word, last = _trigrams(data, starts, ends)
        return np.bincount(word, weights=self.cost[code], minlength=len(starts)) + self.cost[last]


#: Costs have two bytes; the share of the word types keeps them below 32.
PER_UNIT = 2048


def quantise(cost: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(cost * PER_UNIT), 65535).astype(np.uint16)


# ---------------------------------------------------------------- Elias-Fano


def _byte_select() -> np.ndarray:
    """Place of the k-th one of each byte."""
    out = np.zeros((256, 8), np.int64)
    for v in range(256):
        ones = [i for i in range(8) if v >> i & 1]
        out[v, : len(ones)] = ones
    return out


_SELECT8 = _byte_select().ravel()


class BitVector:
    """Bits with select for ones or zeros by a directory of counts before each word."""

    def __init__(self, words: np.ndarray, before: dict[int, np.ndarray]):
        self.words, self.before = words, before

    @classmethod
    def build(cls, ones: np.ndarray, length: int) -> "BitVector":
        bits = np.zeros(-(-(length + 1) // 64) * 64, np.uint8)
        bits[ones] = 1
        words = np.packbits(bits, bitorder="little").view(U64)
        n = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        n = np.concatenate(([0], n[:-1]))
        return cls(words, {1: n.astype(np.uint32), 0: (64 * np.arange(len(n)) - n).astype(np.uint32)})

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the ``k``-th (from 0) bits equal to ``bit``."""
        before = self.before[bit]
        word = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        rest = (k - before[word]).astype(np.uint8)
        cur = self.words[word] if bit else ~self.words[word]
        at = word * 64
        for half in (32, 16, 8):  # the half of the bits that holds it
            n = np.bitwise_count(cur & U64((1 << half) - 1))
            upper = rest >= n
            rest -= n * upper
            shift = upper * U64(half)
            cur >>= shift
            at += shift.astype(np.int64)
        return at + _SELECT8[(cur & U64(0xFF)).astype(np.int64) * 8 + rest]

    def following(self, at: np.ndarray, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the ``k``-th bits equal to ``bit``, the first ones after the positions ``at``."""
        begin = at + 1
        word = begin >> 6
        cur = (self.words[word] if bit else ~self.words[word]) >> (begin & 63).astype(U64)
        out = begin + np.bitwise_count((cur & (~cur + U64(1))) - U64(1))
        beyond = np.flatnonzero(cur == 0)
        out[beyond] = self.select(k[beyond], bit)
        return out


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary."""

    def __init__(self, n: int, low: int, lows: np.ndarray, high: BitVector, buckets: int):
        self.n, self.low, self.lows, self.high, self.buckets = n, low, lows, high, buckets

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        low = max(0, (universe // max(1, n)).bit_length() - 1)
        hi = (values >> U64(low)).astype(np.int64)
        buckets = (universe >> low) + 1
        lo = values & U64((1 << low) - 1)
        bits = np.arange(n, dtype=U64) * U64(low)
        packed = np.zeros((n * low >> 6) + 2, U64)
        if low:
            at, off = (bits >> U64(6)).astype(np.int64), bits & U64(63)
            np.bitwise_or.at(packed, at, lo << off)
            over = off.astype(np.int64) + low > 64
            np.bitwise_or.at(packed, at[over] + 1, lo[over] >> (U64(64) - off[over]))
        return cls(n, low, packed, BitVector.build(hi + np.arange(n), n + buckets), buckets)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U64)
        bits = i.astype(U64) * U64(self.low)
        at, off = (bits >> U64(6)).astype(np.int64), bits & U64(63)
        right = np.where(off > 0, self.lows[at + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return ((self.lows[at] >> off) | right) & U64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        hi = (self.high.select(i, 1) - i).astype(U64)
        return (hi << U64(self.low)) | self.low_bits(i)

    def rises(self, i: np.ndarray) -> np.ndarray:
        """Whether the value after the ``i``-th is greater."""
        at = self.high.select(i, 1)
        up = self.high.following(at, i + 1, 1) - at > 1
        same = np.flatnonzero(~up)
        up[same] = self.low_bits(i[same] + 1) > self.low_bits(i[same])
        return up

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the successor of each ``x`` if it equals ``x``, else -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        hi, lo = (x >> U64(self.low)).astype(np.int64), x & U64((1 << self.low) - 1)
        known = np.flatnonzero(hi < self.buckets)
        h = hi[known]
        at = np.where(h > 0, self.high.select(np.maximum(h - 1, 0), 0), -1)
        begin, end = at + 1 - h, self.high.following(at, h, 0) - h
        # a binary search among the low bits of one bucket, for all queries at once
        left, right = begin.copy(), end.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            mid = (left[live] + right[live]) >> 1
            less = self.low_bits(mid) < lo[known[live]]
            left[live] = np.where(less, mid + 1, left[live])
            right[live] = np.where(less, right[live], mid)
            live = live[left[live] < right[live]]
        ok = np.flatnonzero(left < end)
        hit = ok[self.low_bits(left[ok]) == lo[known[ok]]]
        out[known[hit]] = left[hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.lows, self.high.words, self.high.before[0], self.high.before[1]]

    def mapped(self, a: list[np.ndarray]) -> "EliasFano":
        return EliasFano(self.n, self.low, a[0], BitVector(a[1], {0: a[2], 1: a[3]}), self.buckets)


def memory_map(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The same arrays, mapped from an unnamed file that goes with them."""
    with tempfile.TemporaryFile() as f:
        offsets = []
        for a in arrays:
            f.write(b"\0" * (-f.tell() % 16))
            offsets.append(f.tell())
            f.write(np.ascontiguousarray(a).tobytes())
        f.flush()
        return [np.memmap(f, a.dtype, "r", o, a.shape).view(np.ndarray) if a.size else a for a, o in zip(arrays, offsets)]


class Level:
    """Children of ranked parents: monotone pointers and keys (parent, token) in order."""

    def __init__(self, parent: np.ndarray, token: np.ndarray, parents: int, tokens: int):
        self.bits = U64(max(1, tokens).bit_length())
        starts = np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=parents))))
        self.pointer = EliasFano.build(starts.astype(U64), max(1, len(parent)))
        self.keys = EliasFano.build((parent.astype(U64) << self.bits) | token.astype(U64), max(1, parents) << int(self.bits))

    def find(self, parent: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Place of ``token`` among the children of ``parent``; -1 where either or both are unknown."""
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero((parent >= 0) & (token >= 0))
        p = parent[some]
        many = self.pointer.rises(p)
        some, p = some[many], p[many]
        out[some] = self.keys.find((p.astype(U64) << self.bits) | token[some].astype(U64))
        return out


class Trie:
    """Contexts, the tokens after them, the words before them, and the tokens after those pairs.

    Words are numbered within the trie, so its tokens are exact whatever the width of a key.
    """

    def __init__(self, words: np.ndarray, contexts: np.ndarray, total: np.ndarray, pairs: tuple, nodes: tuple, triples: tuple):
        """``pairs`` and ``nodes``: context, word, count; ``triples``: node, word, count; all in order."""
        n = len(words)
        self.words, self.contexts = EliasFano.build(words, 1 << 48), EliasFano.build(contexts, 1 << 49)
        self.after, self.before = Level(pairs[0], pairs[1], len(contexts), n), Level(nodes[0], nodes[1], len(contexts), n)
        self.deep = Level(triples[0], triples[1], len(nodes[0]), n)
        shares = pairs[2] / (total[pairs[0]] + MASS1), triples[2] / (nodes[2][triples[0]] + MASS2)
        quantised = [np.round(-np.log10(np.maximum(x, 1e-8)) / _STEP).astype(np.uint16) for x in shares]
        holders = [(self, "words"), (self, "contexts"), *((x, y) for x in (self.after, self.before, self.deep) for y in ("pointer", "keys"))]
        m = memory_map([*(a for x, y in holders for a in getattr(x, y).arrays()), total.astype(np.float64), nodes[2].astype(np.float64), *quantised])
        for i, (x, y) in enumerate(holders):
            setattr(x, y, getattr(x, y).mapped(m[4 * i : 4 * i + 4]))
        self.total, self.node_total, *self.quantised = m[4 * len(holders) :]

    def share(self, order: int, child: np.ndarray) -> np.ndarray:
        out = np.zeros(len(child))
        hit = np.flatnonzero(child >= 0)
        out[hit] = 10.0 ** (-_STEP * self.quantised[order][child[hit]].astype(float))
        return out


def _counts_at(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at))
    hit = np.flatnonzero(at >= 0)
    out[hit] = counts[at[hit]]
    return out


# ---------------------------------------------------------------- map side


class Events:
    """The token, the word before it and the word before that of each event, as places in the chunk's ``words``.

    The last two words are the start and the end mark; ``first`` tells where each other word stands first.
    """

    def __init__(self, c: Chunk):
        low = c.lowered()
        starts, ends, doc = low.words()
        n = c.hi - c.lo
        wh = span_hash(low.prefix(), starts, ends) & _H48
        encoded = pa.array(wh).dictionary_encode()
        words, ids = encoded.dictionary.to_numpy(), encoded.indices.to_numpy()
        order = np.argsort(words)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words, ids = words[order], rank[ids]
        first = np.empty_like(order)
        first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
        self.words = np.concatenate((words, np.array([START, END], U64)))
        self.data, self.spans = low.data, (starts[first], ends[first])
        counts = np.bincount(doc, minlength=n)
        before = np.cumsum(counts) - counts
        # the token sequence of a document is its words and the end; contexts are shifted by one and by two
        size = counts + 1
        begin = np.cumsum(size) - size
        total = int(size.sum())
        self.token = np.full(total, len(words) + 1, np.int32)
        self.context, self.before = (np.full(total, len(words), np.int32) for _ in range(2))
        self.at = at = begin[doc] + np.arange(len(doc)) - before[doc]
        self.token[at] = ids
        self.context[at + 1] = ids
        last = np.ones(len(at), bool)
        last[:-1] = doc[1:] != doc[:-1]
        self.before[at[~last] + 2] = ids[~last]
        self.doc = np.repeat(np.arange(n), size)


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * U64(0x9E3779B97F4A7C15) + w)


def _pair_context(before: np.ndarray, context: np.ndarray) -> np.ndarray:
    return (_pair_key(before, context) & _H48) | _PAIR


def small_chunks(texts: pa.Array) -> Iterator[Chunk]:
    for lo in range(0, len(texts), CHUNK_DOCS):
        for c in chunks(texts.slice(lo, CHUNK_DOCS)):
            yield Chunk(c.lo + lo, c.hi + lo, c.data, c.offs)


def _merge(a: tuple[np.ndarray, np.ndarray], key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, inverse = np.unique(np.concatenate((a[0], key)), return_inverse=True)
    return both, np.bincount(inverse, weights=np.concatenate((a[1], n)), minlength=len(both)).astype(np.int64)


def _frequent(key: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur more than ``least`` times, at each of their places, and these places."""
    bucket = (key & U64(0xFFFF)).astype(np.int64)
    e = np.flatnonzero((np.bincount(bucket, minlength=1 << 16) > least)[bucket])
    _, inverse, k = np.unique(key[e], return_inverse=True, return_counts=True)
    e = e[(k > least)[inverse]]
    return key[e], e


class Model:
    """What every task knows: p0 of words, the hot words, and the pairs that are spread.

    p0 mixes the unigrams, one of V types and, for words seen fewer than RARE times, the byte model.  As in the base score, a word without a training count
    is one of V types, so the probabilities are those of a vocabulary with an unknown-word class.
    """

    def __init__(self, counts: np.ndarray, n: int, types: int, top: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray], spread: np.ndarray, spread_pairs: np.ndarray):
        ends = int(counts.reshape(64, 64, 64)[:, :, 0].sum())  # as many as training words
        self.n, self.types = n, types
        self.p_end = (n - ends + 1) / (n + 2)
        self.bytes = ByteModel(counts)
        self.keys, self.counts = top
        self.hot, self.hot_counts = hot
        self.spread, self.spread_pairs = spread, spread_pairs
        self.alpha = 0.95 if ends else 0.0
        #: Share of the word types, and unigram share of one training occurrence.
        self.floor = 0.5 / max(1, types) * (1 - self.alpha) * (1 - self.p_end)
        self.each = (1 - self.p_end) * self.alpha / max(1, ends)

    def held(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words the table of the most frequent has, and their places there."""
        if not len(self.keys):
            return np.zeros(len(token), bool), np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.keys, token), len(self.keys) - 1)
        return self.keys[at] == token, at

    def costs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """-log10 of p0 without the unigram share; below 32, as the share of the types bounds it."""
        p = 0.5 * 10.0 ** -self.bytes.costs(data, starts, ends) + 0.5 / max(1, self.types)
        return -np.log10(p * (1 - self.alpha) * (1 - self.p_end))

    def hot_place(self, words: np.ndarray) -> np.ndarray:
        """1 + the place of a hot word, 0 of others."""
        if not len(self.hot):
            return np.zeros(len(words), np.uint16)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, at + 1, 0).astype(np.uint16)

    def contexts(self, before: np.ndarray, context: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The context of each event: its word or, after a hot word, the pair."""
        key, at = context.copy(), np.flatnonzero(hot)
        key[at] = _pair_context(before[at], context[at])
        return key

    def route(self, key: np.ndarray, w: np.ndarray, shards: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard of each event, and whether its context and its pair are spread (a spread pair goes by chunk)."""
        dest = (mix(key) % U64(shards)).astype(np.int64)
        wide, pair = np.zeros(len(key), bool), np.zeros(len(key), bool)
        at = np.flatnonzero(key >= _PAIR)
        at = at[np.isin(key[at], self.spread)]
        if len(at):
            wide[at] = True
            k = _pair_key(key[at], w[at])
            pair[at] = twin = np.isin(k, self.spread_pairs)
            dest[at] = (mix(k + np.where(twin, U64(chunk), U64(0))) % U64(shards)).astype(np.int64)
        return dest, wide, pair


def corpus_counts(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model that all tasks share, and (word, count) of the words whose counts it lacks.

    Bounded tables (64**3 byte counts, TOP_WORDS words, 1 / HOT_SHARE hot words and pairs) reach the driver.
    """

    def rows_of(words: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(words[0]), 1 << 18):
            w, k = words[0][lo : lo + (1 << 18)], words[1][lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), 5, np.int32)), pa.array(w.astype(np.int64)), pa.array(k)], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, often, n, n_all = np.zeros(64**3, np.int64), Counter(), 0, 0
        words = fresh = (np.zeros(0, U64), np.zeros(0, np.int64))
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False)
            for c in small_chunks(b.column(0)):
                x = Events(c)
                mine = train[c.lo : c.hi]
                n += int(mine[x.doc].sum())
                n_all += len(x.doc)
                ok = mine[x.doc[x.at]] if len(x.at) else np.zeros(0, bool)
                k = np.bincount(x.token[x.at[ok]], minlength=len(x.words))
                code, word, last = _trigrams(x.data, *x.spans)  # each word once, with its count
                for symbols, times in ((code, k[word]), (last, k[:-2])):
                    counts += np.bincount(symbols, weights=times, minlength=64**3).astype(np.int64)
                fresh = _merge(fresh, x.words[k > 0], k[k > 0])
                if len(fresh[0]) > 1 << 19:
                    words, fresh = _merge(words, *fresh), (np.zeros(0, U64), np.zeros(0, np.int64))
                if len(words[0]) > HELD_WORDS:
                    yield from rows_of(words)
                    words = (np.zeros(0, U64), np.zeros(0, np.int64))
                # pairs after which many tokens stand, and such triples; which of them are named affects balance alone
                least = HOT_SHARE / 2 * len(x.doc)
                pair, e = _frequent(_pair_context(x.words[x.before], x.words[x.context]), least)
                often.update({(1, int(v)): int(k) for v, k in zip(*np.unique(pair, return_counts=True))})
                triple, _ = _frequent(_pair_key(pair, x.words[x.token[e]]), least)
                often.update({(2, int(v)): int(k) for v, k in zip(*np.unique(triple, return_counts=True))})
        some = np.flatnonzero(counts)
        named = often.most_common(NAMED)
        yield from rows_of(_merge(words, *fresh))
        kind = np.concatenate((np.zeros(len(some), np.int64), [k for (k, _), _ in named], [3, 4])).astype(np.int32)
        key = np.concatenate((some, np.array([v for (_, v), _ in named], U64).astype(np.int64), [0, 0])).astype(np.int64)
        value = np.concatenate((counts[some], [k for _, k in named], [n, n_all])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(value)], names=["kind", "key", "n"])

    summed = docs.select("text", "train").mapInArrow(tidy(run), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    rows = materialise(summed, "lm-counts")
    total = {r.kind: r.n for r in rows.where("kind in (3, 4)").collect()}
    n = total.get(3, 0)
    counts = np.zeros(64**3, np.int64)
    small = rows.where("kind = 0").toPandas()
    counts[small["key"].to_numpy(int)] = small["n"].to_numpy(int)
    # shares above HOT_SHARE sum to 1 at most, so these are few
    often = rows.where("kind in (1, 2)").where(F.col("n") > HOT_SHARE * total.get(4, 0)).collect()
    spread = [np.array(sorted(r.key % (1 << 64) for r in often if r.kind == k), U64) for k in (1, 2)]
    words = rows.where("kind = 5").select("key", "n", F.floor(F.log2("n") * 8).cast("int").alias("level"))
    hot = {r.key: r.n for r in words.where(F.col("n") > HOT_SHARE * n).collect()}
    ends = n - int(counts.reshape(64, 64, 64)[:, :, 0].sum())
    if ends > HOT_SHARE * n:
        hot[START] = ends  # the start mark stands in for the end
    # classes of about equal count, from the top while they fit; the few class sizes reach the driver
    least, held, types = 1 << 30, 0, 0
    for r in sorted(words.groupBy("level").count().collect(), reverse=True):
        types += r["count"]
        held += r["count"]
        if held <= TOP_WORDS:
            least = r["level"]
    top = words.where(F.col("level") >= least).toPandas().sort_values("key")
    others = words.where(F.col("level") < least).select(F.col("key").alias("word"), "n")
    model = Model(
        counts, n, types, (top["key"].to_numpy(np.int64).astype(U64), top["n"].to_numpy(np.int64)),
        (np.array(sorted(hot), U64), np.array([hot[k] for k in sorted(hot)], float)), *spread)
    return model, others


MAP_SCHEMA = "dest int, chunk bigint, ids array<bigint>, n_tokens array<bigint>, train array<boolean>, blob binary"
_NAMES = [x.split()[0] for x in MAP_SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first: like ones together compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


class _Reader:
    def __init__(self, blob: bytes):
        self.blob, self.at = blob, 0

    def take(self, kind: type, n: int) -> np.ndarray:
        x = np.frombuffer(self.blob, kind, n, self.at)
        self.at += x.nbytes
        return x

    def planes(self, kind: type, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.take(np.uint8, n * size).reshape(size, n).T).view(kind).ravel()

    def unsqueezed(self) -> "_Reader":
        n = int.from_bytes(self.blob[self.at : self.at + 4], "little")
        return _Reader(pa.decompress(self.blob[self.at + 4 :], decompressed_size=n, codec="zstd", asbytes=True))


def _hashes(x: np.ndarray) -> bytes:
    """48 bits each."""
    return (x & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> U64(32)).astype(np.uint16).tobytes()


def _hashes_of(r: _Reader, n: int) -> np.ndarray:
    return r.take(np.uint32, n).astype(U64) | (r.take(np.uint16, n).astype(U64) << U64(32))


#: Stands for all tokens of a context that another shard holds.
_OTHER = U64(1 << 48)


#: Place of words that the model's table lacks.
_NOWHERE = 0xFFFF


def _pack(train: np.ndarray, words: np.ndarray, place: np.ndarray, asks: np.ndarray, cost: np.ndarray, context: np.ndarray, before: np.ndarray, token: np.ndarray, doc: np.ndarray, rest: tuple[np.ndarray, ...]) -> bytes:
    """Events sorted by context, each context once, and the counts kept elsewhere.

    Frequent words are named by their ``place`` in the model's table, others by their hash; ``cost`` goes with the tokens that ask for it.
    """
    first = np.flatnonzero(np.diff(context, prepend=-1))
    every = np.concatenate((context[first], before, token))
    at, q = place[every], cost[token[asks[token]]]
    rare = words[every[at == _NOWHERE]]
    n = np.diff(np.concatenate((first, [len(context)]))).astype(np.uint32)
    head = np.array([len(train), len(first), len(token), len(rare), len(q), len(rest[0])], np.uint32)
    tight = b"".join((_planes(n), _planes(at), _planes(doc.astype(np.uint16)), _planes(q)))
    return b"".join((head.tobytes(), np.packbits(train).tobytes(), _hashes(rare), *(x.tobytes() for x in rest), _squeezed(tight)))


def _unpack(blob: bytes, model: Model, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Train flags, context, hot place, word before, token, p0 and document of each event; contexts, tokens and counts kept elsewhere.

    ``more`` are words that the model's table lacks, with their ``counts``.
    """
    r = _Reader(blob)
    n_docs, n_ctx, n, n_rare, n_q, n_rest = r.take(np.uint32, 6).tolist()
    train = np.unpackbits(r.take(np.uint8, -(-n_docs // 8)), count=n_docs).astype(bool)
    rare = _hashes_of(r, n_rare)
    rest = [r.take(t, n_rest) for t in (np.uint64, np.uint64, np.int64)]
    t = r.unsqueezed()
    many, place, doc, q = t.planes(np.uint32, n_ctx), t.planes(np.uint16, n_ctx + 2 * n), t.planes(np.uint16, n), t.planes(np.uint16, n_q)
    far = place == _NOWHERE
    words = np.empty(len(place), U64)
    words[~far], words[far] = model.keys[place[~far]], rare
    context, before, token = words[:n_ctx], words[n_ctx : n_ctx + n], words[n_ctx + n :]
    far, place = far[n_ctx + n :], place[n_ctx + n :]
    seen = np.zeros(n, np.int64)
    seen[~far] = model.counts[place[~far]]
    p0 = np.full(n, model.floor)
    p0[far | (seen < RARE)] = 10.0 ** (-q.astype(float) / PER_UNIT)
    if len(more) and far.any():
        w = token[far]
        at = np.minimum(np.searchsorted(more, w), len(more) - 1)
        k = np.where(more[at] == w, counts[at], 0)
        seen[far] = k
        p0[np.flatnonzero(far)[k >= RARE]] = model.floor
    hot = np.repeat(model.hot_place(context), many)
    key = model.contexts(before, np.repeat(context, many), hot)
    return train, key, hot, before, token, p0 + model.each * seen, doc, *rest


def _elsewhere(key: np.ndarray, w: np.ndarray, dest: np.ndarray, chosen: np.ndarray, model: Model, shards: int) -> tuple[np.ndarray, ...]:
    """For each shard, the counts of spread contexts and pairs that others hold.

    ``chosen`` marks the training events of spread contexts.  Returns shard,
    context, token (``_OTHER`` for all tokens that are no spread pair) and
    count, sorted by shard.
    """
    at = np.flatnonzero(chosen)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z.astype(U64), z
    i = np.searchsorted(model.spread, key[at])
    there = np.bincount(i * shards + dest[at], minlength=len(model.spread) * shards).reshape(-1, shards)
    rest = there.sum(1, keepdims=True) - there
    pair = _pair_key(key[at], w[at])
    p = np.minimum(np.searchsorted(model.spread_pairs, pair), max(0, len(model.spread_pairs) - 1))
    twin = model.spread_pairs[p] == pair if len(model.spread_pairs) else np.zeros(len(at), bool)
    out = []
    if twin.any():
        used, first, inverse = np.unique(p[twin], return_index=True, return_inverse=True)
        own = np.bincount(inverse * shards + dest[at[twin]], minlength=len(used) * shards).reshape(-1, shards)
        more = own.sum(1, keepdims=True) - own
        np.subtract.at(rest, i[twin][first], more)
        k, s = np.nonzero(more)
        out.append((s, key[at[twin]][first][k], w[at[twin]][first][k], more[k, s]))
    k, s = np.nonzero(rest)
    out.append((s, model.spread[k], np.full(len(k), _OTHER), rest[k, s]))
    s, rk, rw, rn = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(s, kind="stable")
    return s[order], rk[order], rw[order], rn[order].astype(np.int64)


#: Requests a map task holds before it passes them on.
HELD_REQUESTS = 1 << 21


def word_counts(docs: DataFrame, model: Model, others: DataFrame, shards: int) -> DataFrame:
    """Rows for shards like those of ``deal``, of chunk -1: counts of the words that a shard meets and the model lacks."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(asked), 1 << 18):
                x = asked[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array((x >> U64(16)).astype(np.int64)), pa.array((x & U64(0xFFFF)).astype(np.int32))], names=["word", "dest"])

        asked, fresh, n_fresh = np.zeros(0, U64), [], 0
        for b in batches:
            for c in small_chunks(b.column(0)):
                x = Events(c)
                rare = ~model.held(x.words)[0]
                rare[-2:] = False
                e = np.flatnonzero(rare[x.token])
                key = model.contexts(x.words[x.before[e]], x.words[x.context[e]], model.hot_place(x.words)[x.context[e]])
                w = x.words[x.token[e]]
                dest, _, pair = model.route(key, w, shards, 0)
                far = distinct(w[pair])  # any shard may meet these
                fresh += [(w[~pair] << U64(16)) | dest[~pair].astype(U64), ((far << U64(16))[:, None] | np.arange(shards, dtype=U64)).ravel()]
                n_fresh += len(fresh[-2]) + len(fresh[-1])
                if n_fresh > HELD_REQUESTS // 4:
                    asked, fresh, n_fresh = distinct(np.concatenate((asked, *fresh))), [], 0
                if len(asked) > HELD_REQUESTS:
                    yield from rows()
                    asked = np.zeros(0, U64)
        asked = distinct(np.concatenate((asked, *fresh)))
        yield from rows()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            w, n, dest = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((w, dest))
            w, n, dest = w[order].astype(U64), n[order], dest[order]
            some, first = np.unique(dest, return_index=True)
            return _batch([(int(s), -1, None, None, None, _hashes(w[lo:hi]) + n[lo:hi].astype(np.uint32).tobytes()) for s, lo, hi in zip(some, first, [*first[1:], len(dest)])])

        got, held = [], 0
        for b in batches:
            if b.num_rows:
                got.append(tuple(b.column(i).to_numpy() for i in range(3)))
                held += b.num_rows
            if held > HELD_REQUESTS:
                yield rows()
                got, held = [], 0
        if got:
            yield rows()

    asked = docs.select("text").mapInArrow(tidy(ask), "word bigint, dest int")
    return asked.join(others, "word").select("word", "n", "dest").mapInArrow(tidy(pack), MAP_SCHEMA)


def deal(docs: DataFrame, model: Model, shards: int) -> DataFrame:
    """Rows for shards: one per chunk and shard, and one per chunk that describes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            train = b.column(2).to_numpy(zero_copy_only=False)
            for c in small_chunks(b.column(1)):
                chunk = (part << 32) | serial
                serial += 1
                x = Events(c)
                w, mine = x.words[x.token], train[c.lo : c.hi]
                # costs of the chunk's words, the start mark (never a token) and the end
                cost = quantise(np.concatenate((model.costs(x.data, *x.spans), [0.0, -np.log10(model.p_end)])))
                held, place = model.held(x.words)
                asks = _counts_at(model.counts, np.where(held, place, -1)) < RARE
                place = np.where(held, place, _NOWHERE).astype(np.uint16)
                key = model.contexts(x.words[x.before], x.words[x.context], model.hot_place(x.words)[x.context])
                dest, wide, _ = model.route(key, w, shards, chunk)
                rs, *rest = _elsewhere(key, w, dest, wide & mine[x.doc], model, shards)
                rcut = np.searchsorted(rs, np.arange(shards + 1))
                order = np.argsort(dest * len(x.words) + x.context)
                cuts = np.searchsorted(dest[order], np.arange(shards + 1))
                rows = [(int(mix(np.array([chunk], U64))[0] % U64(shards)), chunk, b.column(0).slice(c.lo, c.hi - c.lo).to_pylist(), np.bincount(x.doc, minlength=c.hi - c.lo).tolist(), mine.tolist(), None)]
                for s in range(shards):
                    e = order[cuts[s] : cuts[s + 1]]
                    r = slice(rcut[s], rcut[s + 1])
                    if len(e) or rcut[s + 1] > rcut[s]:
                        rows.append((s, chunk, None, None, None, _pack(mine, x.words, place, asks, cost, x.context[e], x.before[e], x.token[e], x.doc[e], tuple(y[r] for y in rest))))
                yield _batch(rows)

    return docs.select("doc_id", "text", "train").mapInArrow(tidy(run), MAP_SCHEMA)


# ---------------------------------------------------------------- shards


def _numbered(parent: np.ndarray, token: np.ndarray, bits: U64, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent, token) in order, their summed weights, and which of them each row is."""
    key, at = np.unique((parent.astype(U64) << bits) | token.astype(U64), return_inverse=True)
    return (key >> bits).astype(np.int64), (key & ((U64(1) << bits) - U64(1))).astype(np.int64), np.bincount(at, weights=weight, minlength=len(key)), at


def _part(key: np.ndarray, before: np.ndarray, w: np.ndarray, p0: np.ndarray, train: np.ndarray, rest_k: np.ndarray, rest_w: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count of the context, and log10 p, of each event.

    Each distinct word, context, pair and triple is looked up once, whatever the number of its events.
    """
    n, known = len(key), rest_w != _OTHER  # known: counts of spread pairs that other shards answer
    deep = np.flatnonzero(key < _PAIR)
    contexts, rank = np.unique(np.concatenate((key, rest_k)), return_inverse=True)
    words, ids = np.unique(np.concatenate((w, rest_w[known], before[deep])), return_inverse=True)
    bits = U64(max(1, len(words)).bit_length())
    own, elsewhere = rank[:n], rank[n:]
    weight = np.concatenate((train.astype(np.int64), rest[known]))
    m = len(weight)
    pair_ctx, pair_word, pair_n, pair = _numbered(np.concatenate((own, elsewhere[known])), ids[:m], bits, weight)
    node_ctx, node_word, node_n, node = _numbered(own[deep], ids[m:], bits, train[deep])
    tri_node, tri_word, tri_n, tri = _numbered(node, ids[deep], bits, train[deep])
    total = np.bincount(pair_ctx, weights=pair_n, minlength=len(contexts)) + np.bincount(elsewhere[~known], weights=rest[~known], minlength=len(contexts))
    # the trie holds what training has; the order of numbers stays when the others go
    keep_ctx, keep_node, keep_pair, keep_tri = total > 0, node_n > 0, pair_n > 0, tri_n > 0
    keep_word = np.zeros(len(words), bool)
    keep_word[pair_word[keep_pair]] = keep_word[node_word[keep_node]] = True
    new_ctx, new_word, new_node = (np.cumsum(x) - 1 for x in (keep_ctx, keep_word, keep_node))
    trie = Trie(
        words[keep_word], contexts[keep_ctx], total[keep_ctx],
        (new_ctx[pair_ctx[keep_pair]], new_word[pair_word[keep_pair]], pair_n[keep_pair]),
        (new_ctx[node_ctx[keep_node]], new_word[node_word[keep_node]], node_n[keep_node]),
        (new_node[tri_node[keep_tri]], new_word[tri_word[keep_tri]], tri_n[keep_tri]))
    of_word, of_ctx = trie.words.find(words), trie.contexts.find(contexts)
    seen = _counts_at(trie.total, of_ctx)
    of_node = trie.before.find(of_ctx[node_ctx], of_word[node_word])
    node_seen = _counts_at(trie.node_total, of_node)
    start = np.zeros(len(words))
    start[ids[:n]] = p0
    p = trie.share(0, trie.after.find(of_ctx[pair_ctx], of_word[pair_word])) + MASS1 / (seen[pair_ctx] + MASS1) * start[pair_word]
    logp = np.log10(np.maximum(p, 1e-300))[pair[:n]]
    if len(deep):
        lower = np.zeros(len(tri_n))
        lower[tri] = p[pair[deep]]
        p = trie.share(1, trie.deep.find(of_node[tri_node], of_word[tri_word])) + MASS2 / (node_seen[tri_node] + MASS2) * lower
        logp[deep] = np.log10(p)[tri]
    return seen[own], logp


#: Events that one trie is built from at a time; a shard is cut by context into such parts.
PART_EVENTS = 200_000


def _known_words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words and their counts."""
    w, n = [np.zeros(0, U64)], [np.zeros(0, np.uint32)]
    for x in blobs:
        r = _Reader(x)
        w.append(_hashes_of(r, len(x) // 10))
        n.append(r.take(np.uint32, len(x) // 10))
    words, first = np.unique(np.concatenate(w), return_index=True)
    return words, np.concatenate(n)[first]


def _answer(rows: list[tuple[int, bytes]], counts: list[bytes], model: Model) -> dict[int, bytes]:
    """Partial sums of one shard by chunk."""
    release()
    names = [k for k, _ in rows]
    words, counted = _known_words(counts)
    cols: list[list[np.ndarray]] = [[] for _ in range(10)]
    for k in range(len(rows)):
        train, key, hot, before, w, p0, doc, *others = _unpack(rows[k][1], model, words, counted)
        rows[k] = (names[k], b"")  # free as we go
        for c, x in zip(cols, (key, hot, before, w, p0, train[doc], np.full(len(w), k * CHUNK_DOCS, np.int32) + doc, *others)):
            c.append(x)
    for i, c in enumerate(cols):  # the pieces of a column go before the next one is joined up
        cols[i] = np.concatenate(c)
        c.clear()
    key, hot, before, w, p0, train, owner, rest_k, rest_w, rest = cols
    del cols, words, counted
    release()
    parts = max(1, -(-len(key) // PART_EVENTS))
    part = (mix(key ^ U64(0xABCDEF)) % U64(parts)).astype(np.uint16)
    rest_part = (mix(rest_k ^ U64(0xABCDEF)) % U64(parts)).astype(np.uint16)
    sums = np.zeros((3, len(names) * CHUNK_DOCS))
    hot_counts = np.concatenate(([0], model.hot_counts))
    for p in range(parts):
        e, r = np.flatnonzero(part == p), rest_part == p
        total, logp = _part(key[e], before[e], w[e], p0[e], train[e], rest_k[r], rest_w[r], rest[r])
        total = np.where(hot[e] > 0, hot_counts[hot[e]], total)
        for i, x in enumerate((np.rint(np.log10(total + 1) * BASE_UNIT), np.rint(logp * SCORE_UNIT), total > 0)):
            sums[i] += np.bincount(owner[e], weights=x, minlength=sums.shape[1])
    used = np.zeros(sums.shape[1], bool)
    used[owner] = True
    out = {}
    for k, chunk in enumerate(names):
        some = np.flatnonzero(used[k * CHUNK_DOCS : (k + 1) * CHUNK_DOCS])
        if len(some):
            out[chunk] = len(some).to_bytes(4, "little") + _squeezed(_planes(some.astype(np.uint16)) + b"".join(_planes(x) for x in sums[:, k * CHUNK_DOCS + some].astype(np.int64)))
    return out


def answer(dealt: DataFrame, model: Model, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, bytes]]] = {}
        counts: dict[int, list[bytes]] = {}
        for b in batches:
            meta = b.filter(b.column(5).is_null())
            if meta.num_rows:
                yield meta
            for s, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist()):
                if x is not None and k < 0:
                    counts.setdefault(s, []).append(x)
                elif x is not None:
                    by.setdefault(s, []).append((k, x))
        for s in list(by):
            out = _answer(by.pop(s), counts.pop(s, []), model)
            if out:
                yield _batch([(s, k, None, None, None, x) for k, x in out.items()])

    return dealt.repartitionById(shards, F.col("dest")).mapInArrow(tidy(run), MAP_SCHEMA)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial sums of each chunk's documents."""
    meta: dict[int, tuple] = {}
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, ids, n, train, blob in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
            if blob is None:
                meta[k] = (ids, n, train)
                continue
            r = _Reader(blob)
            m = int(r.take(np.uint32, 1)[0])
            r = r.unsqueezed()
            d = r.planes(np.uint16, m)
            s = sums.setdefault(k, np.zeros((3, CHUNK_DOCS), np.int64))
            for i in range(3):
                s[i, d] += r.planes(np.int64, m)
    for k, (ids, n, train) in meta.items():
        s = sums.get(k, np.zeros((3, CHUNK_DOCS), np.int64))[:, : len(ids)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(train), pa.array(n, pa.int64()), pa.array(s[2]), pa.array(s[0] / BASE_UNIT), pa.array(s[1] / SCORE_UNIT)],
            names=["doc_id", "train", "n_tokens", "n_known", "logs", "score"],
        )


def score(docs: DataFrame) -> DataFrame:
    """Scores of rows with doc_id, text and a boolean ``train``."""
    spark = docs.sparkSession
    shards = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "train")
    model, others = corpus_counts(docs)
    dealt = deal(docs, model, shards).unionByName(word_counts(docs, model, others, shards))
    parts = materialise(answer(dealt, model, shards), "lm-parts")
    out = parts.repartition(shards, "chunk").mapInArrow(tidy(_sums), "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, logs double, score double")
    types = model.types + (1 if model.p_end * (model.n + 2) > 1.5 else 0)  # the end mark, if training has one
    return out.select(
        "doc_id", "train", "n_tokens", "n_known", F.lit(int(model.n)).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(model.n + types + 1)))).alias("base_score"), "score",
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the mean log10 probability of a token."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0))
    out = score(docs.select("doc_id", "text", (fold != 2).alias("train")))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (F.col("score") / F.col("n_tokens")).alias("score_per_token"))
