"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: slurs (a short fixed list, and words and stems learned
from labels), verbs of harm, verbs of perishing, degree, intent, target,
negation and reporting.  Five transducers rewrite the symbols of one clause:

* the insult transducer turns a slur into an insult, a strong one after a
  word of degree;
* the threat transducer needs intent, a verb of harm and a target: the symbol
  that completes them becomes a threat ("I will hurt you", "I hope they burn
  your house"); intent, a target and then a verb of perishing do as well
  ("you will die"); harm and a target without intent are a menace, a verb of
  harm alone is only harm ("kill the process");
* the negation transducer marks what follows within its clause as denied, the
  reporting transducer marks it as quoted, and the target transducer marks
  insults that are aimed at a person.

More than ``REACH`` other words between two symbols undo degree, intent and
pending harm, but not negation, reporting or target.  The composition is one
deterministic transducer; its outputs, weighted by lexeme and by learned arc
weights, give the score of a clause, and a logistic model over the clause
outputs gives the score of the document.  A lone target, intent, negation or
report scores nothing.

Words are found for whole chunks of text at once by hashing; only clauses with
a slur or a verb of harm or perishing are run through the machine.

Learning uses labelled rows whose crc32(doc_id) mod 5 is not 0, of those at
most ``FIT_ROWS``, the first in hash order; labels, lang, source and doc_id
are no inputs of a score.

Defined cases: null and empty texts get the score of a text without matches;
rows with a null label or doc_id teach nothing; without labels the fixed
lexicon and prior weights are used; repeated rows score alike; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftset.functions.shared import materialise
from driftset.llm.textblocks import U64, Chunk, chunks, distinct, span_hash

#: Bound on the labelled rows used for learning, and on the lexicon.
FIT_ROWS, LEXICON = 20_000, 4_000
STEMS = (4, 5, 6, 7, 8, 9, 10)
#: A learned entry occurs in this many different contexts, at least this many
#: for each toxic row, and its log odds less ``SIGMAS`` standard errors reach ``ODDS``.
CONTEXTS, PER_ROW, SIGMAS, ODDS = 5, 0.012, 3.0, 0.7
#: Other words between two symbols beyond which they form no phrase.
REACH = 3
# Words of the grammar by symbol, in English, German, French and Spanish.
WORDS = {
    "slur": "idiot idiots moron morons scum pathetic worthless loser losers stupid disgusting imbecile dummkopf arschloch connard salope estúpido cabrón".split(),
    "harm": "kill murder destroy hurt stab strangle shoot beat burn smash töten umbringen verprügeln tuer frapper brûler matar golpear quemar".split(),
    "perish": "suffer bleed rot hang sterben verrecken crever mourir morir".split(),
    "die": "die dead".split(),
    "degree": "such so very total complete utter absolute damn damned bloody stinking völlig verdammter sale gros vraiment muy maldito".split(),
    "intent": "will i'll we'll going gonna hope want wish should must deserve deserves werde werden wirst sollst hoffe vais vas espère voy espero ojalá".split(),
    "you": "you your yours they them he she him".split(),
    "target": "her du dich ihr euch tu toi vous ils elle usted ustedes ellos".split(),
    "negation": "not no never neither nor without isn't aren't don't won't nicht kein keine nie ne pas jamais sin nunca tampoco".split(),
    "report": "said says say wrote claimed called quoted according allegedly sagte schrieb behauptete dit disait écrit dijo escribió".split(),
}
#: Inputs of the grammar; a clause without one of the first four is not run.  "far" stands for a long way between two others.
SYMBOLS = (*WORDS, "far")
CORES = 4
#: What the first two transducers make of them, to be marked by the other three.
PHRASES = ("insult", "insult+strong", "threat", "threat&target", "menace&target", "harm")
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum() and chr(b) != "'"]] = 32
_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(x) for x in ".!?;:,\n|()"]] = 1


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output); else it stays and copies."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(a: Transducer, b: Transducer, symbols: set[str]) -> Transducer:
    """Feeds the output of ``a`` to ``b``; only reachable states are made."""
    out = Transducer(f"{a.start}/{b.start}")
    todo, known = [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        x, y = todo.pop()
        for s in symbols:
            x2, mid = a.step(x, s)
            y2, end = b.step(y, mid)
            out.arcs[f"{x}/{y}", s] = (f"{x2}/{y2}", end)
            if (x2, y2) not in known:
                known.add((x2, y2))
                todo.append((x2, y2))
    return out


def insults() -> Transducer:
    t = Transducer("plain", {("plain", "degree"): ("strong", "degree"), ("strong", "far"): ("plain", "far")})
    t.arcs["plain", "slur"] = ("plain", "insult")
    t.arcs["strong", "slur"] = ("strong", "insult+strong")
    return t


def threats() -> Transducer:
    """States say what was seen within reach: intent, a target, an English one, harm that waits for a target."""
    t = Transducer("")
    for n in range(16):
        seen = "".join(x for k, x in enumerate("iteh") if n >> k & 1)

        def add(more: str) -> str:
            return "".join(x for x in "iteh" if x in seen or x in more)

        done = seen.replace("h", "")
        t.arcs[seen, "far"] = ("", "far")
        t.arcs[seen, "intent"] = (add("i"), "intent")
        for word, marks in (("target", "t"), ("you", "te")):
            t.arcs[seen, word] = (add(marks).replace("h", ""), "threat&target" if "i" in seen else "menace&target") if "h" in seen else (add(marks), "target")
        t.arcs[seen, "harm"] = (done, "threat") if "i" in seen and "t" in seen else (add("h"), "harm")
        # "die" is an article in German: it needs an English target
        t.arcs[seen, "perish"] = (done, "threat") if "i" in seen and "t" in seen else (seen, "perish")
        t.arcs[seen, "die"] = (done, "threat") if "i" in seen and "e" in seen else (seen, "die")
    return t


def marker(trigger: str, mark: str, phrases: list[str]) -> Transducer:
    """After ``trigger``, phrases carry ``mark`` to the clause's end."""
    t = Transducer("off", {("off", trigger): ("on", trigger)})
    for s in phrases:
        t.arcs["on", s] = ("on", f"{s}+{mark}")
    return t


def grammar() -> Transducer:
    inputs = set(SYMBOLS)
    denied = [*PHRASES, *(f"{s}+denied" for s in PHRASES)]
    quoted = [*denied, *(f"{s}+quoted" for s in denied)]
    machine = compose(compose(insults(), threats(), inputs), marker("negation", "denied", list(PHRASES)), inputs)
    machine = compose(machine, marker("report", "quoted", denied), inputs)
    insult = [s for s in quoted if s.startswith("insult")]
    aimed = marker("target", "aimed", insult)
    for s in quoted:
        if "&target" in s:  # a threat's own target aims later insults too
            aimed.arcs["off", s] = aimed.arcs["open", s] = ("on", s)
    for s in insult:  # a target right after it aims an insult too
        aimed.arcs["off", s] = aimed.arcs["open", s] = ("open", s)
    aimed.arcs["open", "target"] = ("on", "aimed-late")
    return compose(machine, aimed, inputs)


def outputs() -> list[str]:
    marked = [f"{k}{d}{q}" for k in PHRASES for d in ("", "+denied") for q in ("", "+quoted")]
    return [*marked, *(f"{s}+aimed" for s in marked if s.startswith("insult")), "aimed-late"]


def prior(tag: str) -> float:
    w = {"insult": 2.0, "threat": 3.5, "menace": 1.2, "harm": 0.05}.get(tag.replace("&", "+").split("+")[0], 0.5)
    for mark, times in (("strong", 1.25), ("denied", 0.15), ("quoted", 0.4), ("aimed", 1.5)):
        w *= times if f"+{mark}" in tag else 1
    return w


def _hash_of(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, U64)
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    c = Chunk(0, 1, np.frombuffer(b"".join(data), np.uint8), np.array([0, ends[-1]]))
    return span_hash(c.prefix(), np.concatenate(([0], ends[:-1])), ends)


class Lexicon:
    """Symbols and weights of words and stems, looked up by hash."""

    def __init__(self, entries: dict[tuple[str, int], tuple[str, float]]):
        """``entries``: (word or stem, 0 or stem length in bytes) -> symbol and weight."""
        self.tables = {}
        exact = {w: (SYMBOLS.index(s), 1.0) for s in WORDS for w in WORDS[s]}
        exact |= {w: (SYMBOLS.index(s), x) for (w, n), (s, x) in entries.items() if n == 0 and exact.get(w, (0,))[0] == 0}
        stems: dict[int, dict] = defaultdict(dict)
        for (w, n), (s, x) in entries.items():
            if n:
                stems[n][w] = (SYMBOLS.index(s), x)
        for n, table in {0: exact, **stems}.items():
            h = _hash_of(list(table))
            order = np.argsort(h)
            value = list(table.values())
            seen = np.zeros(1 << 18, bool)
            seen[(h >> U64(46)).astype(np.int64)] = True
            self.tables[n] = (h[order], np.array([value[i][0] for i in order]), np.array([value[i][1] for i in order]), seen)

    def find(self, c: Chunk) -> tuple[np.ndarray, ...]:
        """Word index, document, clause, symbol and weight of every match, in text order."""
        p = Chunk(c.lo, c.hi, _PLAIN[c.data], c.offs)
        starts, ends, doc = p.words()
        if not len(starts):
            z = np.zeros(0, np.int64)
            return z, z, z, z, z
        # a break within a document starts a new clause, and so does the next document
        clause = np.cumsum(_ENDS[c.data])[starts] + doc
        pre = p.prefix()
        symbol, weight = np.full(len(starts), -1), np.zeros(len(starts))
        for n in sorted(self.tables, reverse=True):
            keys, sym, wt, seen = self.tables[n]
            if not len(keys):
                continue
            at = np.flatnonzero(ends - starts >= n) if n else np.arange(len(starts))
            h = span_hash(pre, starts[at], starts[at] + n if n else ends)
            maybe = seen[(h >> U64(46)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            at, k = at[hit], k[hit]
            # a whole word beats its stems; of several stems the heaviest counts
            win = np.ones(len(at), bool) if n == 0 else wt[k] > weight[at]
            symbol[at[win]], weight[at[win]] = sym[k[win]], wt[k[win]]
        found = np.flatnonzero(symbol >= 0)
        return found, doc[found], clause[found], symbol[found], weight[found]


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: dict[str, float] | None = None, bias: float = -3.0):
        self.lexicon, self.machine, self.tags = lexicon, grammar(), outputs()
        self.at = {t: i for i, t in enumerate(self.tags)}
        self.weights = np.array([(weights or {}).get(t, prior(t)) for t in self.tags])
        self.bias = bias

    def features(self, c: Chunk) -> np.ndarray:
        """Per document and output tag, the summed lexeme weights of the clauses, at most 12."""
        out = np.zeros((c.hi - c.lo, len(self.tags)))
        word, doc, clause, symbol, weight = self.lexicon.find(c)
        keep = np.isin(clause, distinct(clause[symbol < CORES]))
        state, last, end = self.machine.start, None, 0
        for i, d, k, s, w in zip(*(x[keep].tolist() for x in (word, doc, clause, symbol, weight))):
            if k != last:
                state, last = self.machine.start, k
            elif i - end > REACH + 1:
                state, _ = self.machine.step(state, "far")
            end = i
            state, tag = self.machine.step(state, SYMBOLS[s])
            j = self.at.get(tag)
            if j is not None:
                out[d, j] += w if s < CORES else 1.0
        return np.minimum(out, 12.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 1500, pull: float = 0.01) -> None:
        """Logistic regression by gradient steps, pulled towards the priors."""
        if not len(y) or y.min() == y.max():
            return
        share = 1 / len(y)
        before = self.weights.copy()
        for _ in range(rounds):
            g = (self.scores(x) - y) * share
            self.weights -= 0.3 * (x.T @ g + pull * 0.05 * (self.weights - before))
            self.bias -= 0.3 * g.sum()


def _terms(c: Chunk) -> Iterator[tuple[int, list[str]]]:
    """The plain words of each document of a chunk."""
    data = _PLAIN[c.data].tobytes()
    for i in range(c.hi - c.lo):
        yield i, data[c.offs[i] : c.offs[i + 1]].decode("utf-8", "replace").split()


def _variants(word: str) -> list[tuple[str, int]]:
    """The word, and its stems as (text, length in bytes)."""
    raw = word.encode()
    return [(word, 0), *((s, n) for n in STEMS if len(raw) > n and len((s := raw[:n].decode("utf-8", "ignore")).encode()) == n)]


def learn_lexicon(sample: DataFrame) -> dict[tuple[str, int], tuple[str, float]]:
    """Words and stems that toxic rows hold in many contexts and others hardly ever.

    ``sample``: text, toxic; bounded by the caller.  Contexts (the words
    around) count rather than rows, so copies of one text prove nothing.  An
    entry that mostly follows a word of intent within reach is a verb of harm.
    """
    intent = set(WORDS["intent"])

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple[str, int, int, bool]] = set()
            for c in chunks(b.column(0)):
                for _, w in _terms(c):
                    for i, x in enumerate(w):
                        key = zlib.crc32(f"{w[i - 1] if i else ''} {w[i + 1] if i + 1 < len(w) else ''}".encode())
                        if len(x) > 2:
                            meant = not intent.isdisjoint(w[max(0, i - REACH) : i])
                            rows.update((t, n, key, meant) for t, n in _variants(x))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())],
                names=["term", "stem", "ctx", "meant"])

    toxic = sample.where("toxic = 1").select("text")
    seen = (
        toxic.mapInArrow(positive, "term string, stem int, ctx bigint, meant boolean").groupBy("term", "stem", "ctx").agg(F.max("meant").alias("meant"))
        .groupBy("term", "stem").agg(F.count("*").alias("n"), F.count_if("meant").alias("meant")).where(F.col("n") >= CONTEXTS).orderBy(F.desc("n"), "term", "stem").limit(50 * LEXICON).collect()
    )
    support = {(r.term, r.stem): r.n for r in seen}
    harmful = {(r.term, r.stem) for r in seen if 2 * r.meant > r.n}

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of either label that hold a term, summed up for the partition."""
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            label = b.column(1).to_pylist()
            for c in chunks(b.column(0)):
                for i, w in _terms(c):
                    y = int(label[c.lo + i] == 1)
                    counts[y][("", -1)] += 1
                    counts[y].update({t for x in set(w) if len(x) > 2 for t in _variants(x) if t in support})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([counts[y][k] for k in keys], pa.int64()) for y in (1, 0))],
            names=["term", "stem", "good", "bad"],
        )

    held = sample.select("text", "toxic").mapInArrow(holders, "term string, stem int, good bigint, bad bigint")
    rows = {(r.term, r.stem): (r.p, r.q) for r in held.groupBy("term", "stem").agg(F.sum("good").alias("p"), F.sum("bad").alias("q")).collect()}
    n_toxic, n_other = rows.pop(("", -1), (0, 0))
    found: dict[tuple[str, int], tuple[float, float]] = {}
    for k, contexts in support.items():
        p, q = rows.get(k, (0, 0))
        odds = np.log((p + 0.5) / (n_toxic + 1)) - np.log((q + 0.5) / (n_other + 1))
        least = odds - SIGMAS * np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        if contexts >= PER_ROW * n_toxic and least >= ODDS:
            found[k] = (float(least), float(odds))
    top = sorted(found, key=lambda k: (-found[k][0], k))[:LEXICON]
    return {k: ("harm" if k in harmful else "slur", float(np.clip(found[k][1] / 2, 0.3, 3.0))) for k in top}


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    ids = (
        labels.where("toxic is not null and doc_id is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    )
    # at most fit_rows pairs of numbers; of rows that share a doc_id one text teaches
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").cast("int").alias("toxic"))
    return materialise(known.select("text", "toxic"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    sample = labelled_sample(docs, labels, fit_rows)
    scorer = Scorer(Lexicon(learn_lexicon(sample)))
    names = [f"f{i}" for i in range(len(scorer.tags))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([scorer.features(c) for c in chunks(b.column(0))]) if b.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, i]) for i in range(len(names)))], names=["toxic", *names])

    rows = sample.mapInArrow(run, "toxic int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    scorer.fit(rows[names].to_numpy(float), rows["toxic"].to_numpy(float))
    return scorer


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [scorer.scores(scorer.features(c)) for c in chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
