"""Quality rules: an ordered decision list learned by sequential covering.

``text_statistics`` measures every whole text once (vectorised, per Arrow
batch).  ``learn_decision_list`` grows threshold conjunctions that cover the
low-quality class, prunes them on held-back rows and stops when a rule is no
longer precise; ``as_condition`` turns the list into one ordered Spark
``CASE WHEN``, which is what judges the corpus.

Defined cases: a null text counts as an empty one (all statistics 0); rows
whose label is null, or whose document is missing, teach nothing; with no
usable labels the list is empty and every text passes that the base rules
let pass; repeated rows are judged alike, each on its own row; a null doc_id
is judged like others and teaches nothing; an empty table gives no rows; extra columns are carried along unchanged
by :func:`apply_quality`, also if they bear the name of a statistic, because
statistics travel in one struct column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.llm.textblocks import U64, chunks, mix, span_hash, tidy

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = (
    "n_lines", "n_upper", "n_digits", "n_pipes", "n_stops", "n_exclaim", "n_symbol_words", "max_word",
)
STATS = COUNTS + EXTRA
#: Ratios the rules may test; each is defined for a text without words too.
FEATURES = {
    "words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "symbol_words": ("n_symbol_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
    "pipes": ("n_pipes", "n_words"), "stops": ("n_stops", "n_words"), "exclaim": ("n_exclaim", "n_words"),
    "longest": ("max_word", None), "line_words": ("n_words", "n_lines"),
}
#: Bound on the labelled rows that reach the driver for fitting.
FIT_ROWS = 20_000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL, _PIPE, _EXCLAIM, _STOP = _table("#*$%&|<>"), _table("|"), _table("!"), _table(".?!")
_DIGIT, _UPPER = _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def _between(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[hi] - total[lo]


def _repeated_words(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words inside 3-word windows that occur twice or more in their text."""
    m = len(words) - 2
    if m <= 0:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[:m] == doc[2:])
    h = words[at]
    for j in (1, 2):
        h = mix(h * U64(0x9E3779B97F4A7C15) + words[at + j])
    key = mix(h + mix(doc[at].astype(U64) + U64(77)))
    order = np.argsort(key)
    key = key[order]
    twin = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    hit = at[order[twin]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 3, -1)
    return _per_doc((np.cumsum(edge)[:-1] > 0).astype(float), doc, n)


def _lines(chunk, prefix: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those equal to an earlier one."""
    n = chunk.hi - chunk.lo
    brk = np.flatnonzero(chunk.data == 10)
    lo = np.sort(np.concatenate((chunk.offs[:-1], brk + 1)))
    doc = np.searchsorted(chunk.offs, lo, side="right") - 1
    # an empty document shares its offset with the next one: such lines have no word
    hi = np.minimum(np.concatenate((lo[1:], [len(chunk.data)])), chunk.offs[np.minimum(doc + 1, n)])
    broken = np.zeros(len(chunk.data) + 1, bool)
    broken[brk] = True
    hi = np.where((hi > lo) & broken[np.maximum(hi - 1, 0)], hi - 1, hi)
    n_words = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    keep = (n_words > 0) & (doc < n)
    lo, hi, doc = lo[keep], hi[keep], doc[keep]
    key = mix(span_hash(prefix, lo, hi) + mix(doc.astype(U64) + U64(5)))
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n) if len(doc) else np.zeros(n, int)
    lines = np.bincount(doc, minlength=n)
    return lines.astype(np.int64), (lines - distinct).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of an Arrow string array."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in STATS}
    for c in chunks(texts):
        n, p = c.hi - c.lo, c.prefix()
        starts, ends, doc = c.words()
        lo, hi = c.offs[:-1], c.offs[1:]
        point = (c.data & 0xC0) != 0x80
        chars = _between(point, starts, ends)
        row = {
            "n_words": np.bincount(doc, minlength=n), "word_chars": _per_doc(chars, doc, n),
            "n_symbols": _between(_SYMBOL[c.data], lo, hi), "n_upper": _between(_UPPER[c.data], lo, hi),
            "n_digits": _between(_DIGIT[c.data], lo, hi), "n_pipes": _between(_PIPE[c.data], lo, hi),
            "n_exclaim": _between(_EXCLAIM[c.data], lo, hi),
            "n_stops": _per_doc(_STOP[c.data[ends - 1]] if len(ends) else ends, doc, n),
            "n_symbol_words": _per_doc(_between(_SYMBOL[c.data], starts, ends) > 0, doc, n),
            "n_repeat_words": _repeated_words(span_hash(p, starts, ends), doc, n),
        }
        row["max_word"] = np.zeros(n, np.int64)
        np.maximum.at(row["max_word"], doc, chars)
        row["n_lines"], row["n_dup_lines"] = _lines(c, p, starts)
        for k in STATS:
            out[k].append(np.asarray(row[k], np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and a struct ``stats`` of whole-text statistics."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    stats = ", ".join(f"{k}: bigint" for k in STATS)
    schema = ", ".join(x for x in (kinds, f"stats struct<{stats}>") if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = measure(b.column(b.num_columns - 1))
            packed = pa.StructArray.from_arrays([pa.array(found[k]) for k in STATS], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=[*b.schema.names[:-1], "stats"])

    return src.mapInArrow(tidy(run), schema)


def feature(name: str, stats: str = "stats") -> Column:
    top, bottom = FEATURES[name]
    value = F.col(f"{stats}.{top}").cast("double")
    return value / F.greatest(F.col(f"{stats}.{bottom}"), F.lit(1)) if bottom else value


@dataclass(frozen=True)
class Rule:
    """A conjunction of threshold tests that marks low quality."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for name, op, cut in self.tests:
            out = out & (feature(name, stats) >= cut if op == ">=" else feature(name, stats) <= cut)
        return out

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, cut in self.tests:
            out &= x[name] >= cut if op == ">=" else x[name] <= cut
        return out


def _best_test(x: dict, bad: np.ndarray, used: set, steps: int) -> tuple[float, tuple | None]:
    """The threshold test of largest FOIL gain over the rows still matched."""
    best, choice, p0, n0 = 1e-9, None, bad.sum(), len(bad)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, b = v[order], np.cumsum(bad[order])
        last = np.flatnonzero(s[1:] != s[:-1])
        if len(last) > steps:
            last = last[np.linspace(0, len(last) - 1, steps).astype(int)]
        if not len(last):
            continue
        mid = (s[last] + s[last + 1]) / 2
        for op, p, n in (("<=", b[last], last + 1), (">=", p0 - b[last], n0 - last - 1)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0 / n0))
            k = int(np.argmax(np.where(p > 0, gain, -1)))
            if gain[k] > best and (name, op) not in used:
                best, choice = float(gain[k]), (name, op, float(mid[k]))
    return best, choice


def learn_decision_list(
    x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, longest: int = 4, most: int = 24, steps: int = 400,
) -> list[Rule]:
    """Sequential covering: grow on two thirds of the rows, prune on the rest.

    A rule is kept only if its precision over all rows that it covers reaches
    ``precision`` and it covers at least ``least`` of them, so clean text is
    not given up for recall.  The order of the list is the order of learning.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    turn = np.arange(len(bad)) % 3 != 2
    failed = 0
    while len(rules) < most and failed < most and (bad & left).sum() >= least:
        grow, prune = np.flatnonzero(left & turn), np.flatnonzero(left & ~turn)
        tests: list[tuple[str, str, float]] = []
        at = grow
        while len(tests) < longest and bad[at].any() and not bad[at].all():
            _, t = _best_test({k: v[at] for k, v in x.items()}, bad[at], {u[:2] for u in tests}, steps)
            if t is None:
                break
            tests.append(t)
            at = grow[Rule(tuple(tests), 0, 0).matches({k: v[grow] for k, v in x.items()})]
        if not tests:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(ts: list) -> float:
            hit = Rule(tuple(ts), 0, 0).matches(held)
            p = (bad[prune] & hit).sum()
            return (p - (hit.sum() - p) * 4) / max(1, bad[prune].sum())

        def over_all(ts: list) -> tuple[np.ndarray, float]:
            hit = Rule(tuple(ts), 0, 0).matches(x) & left
            return hit, float((bad & hit).sum() / max(1, hit.sum()))

        while len(tests) > 1 and worth(tests[:-1]) > worth(tests) and over_all(tests[:-1])[1] >= precision:
            tests = tests[:-1]
        hit, exact = over_all(tests)
        if hit.sum() >= least and exact >= precision:
            rules.append(Rule(tuple(tests), exact, int(hit.sum())))
            left &= ~hit
        else:  # not precise: these rows stay uncovered, others may still be
            left &= ~(hit & bad)
            failed += 1
    return rules


def as_condition(rules: list[Rule], stats: str = "stats") -> Column:
    """The list as one ordered conditional: false where a rule fires first."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.column(stats), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from labelled rows outside the held-out fold (crc32 mod 5 = 0).

    At most ``fit_rows`` labelled documents, the first in hash order, are
    measured (one row for each doc_id); those that fail the base rules are
    decided already and teach nothing.
    """
    ids = (
        labels.where("quality is not null and doc_id is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # at most fit_rows pairs of numbers
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    measured = text_statistics(known, ["doc_id", "label"]).where(~base_failed())
    rows = measured.select("doc_id", F.col("label").alias("quality"), *[feature(k).alias(k) for k in FEATURES]).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values("doc_id")
    return learn_decision_list({k: rows[k].to_numpy(float) for k in FEATURES}, rows["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[Rule]]:
    """doc_id, stats, base_failed and kept of every row, and the rules."""
    rules = fit(docs, labels, fit_rows)
    kept = ~base_failed() & as_condition(rules)
    return text_statistics(docs, ["doc_id"]).select("doc_id", "stats", base_failed().alias("base_failed"), kept.alias("kept")), rules


def apply_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came; each text is measured once."""
    if {"doc_id", "text"} - set(docs.columns):
        raise ValueError("apply_quality needs the columns doc_id and text")
    rules = fit(docs, labels, fit_rows)
    plain, stats = [f"c{i}" for i in range(len(docs.columns))], f"stats_{uuid.uuid4().hex[:8]}"
    measured = text_statistics(docs.toDF(*plain), plain, plain[docs.columns.index("text")]).toDF(*docs.columns, stats)
    return measured.where(~base_failed(stats) & as_condition(rules, stats)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *[F.col(f"stats.{k}").alias(k) for k in COUNTS], "base_failed", "kept")
