"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftset.llm import decontam, jaccard, licences, lm, mixing, quality, suffixes, toxicity, warc
from driftset.llm.textblocks import U64, chunks
from tests.conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_quality_statistics(texts):
    ids = list(texts)
    got = quality.measure(pa.array([texts[i] for i in ids], pa.string()))
    for k, i in enumerate(ids):
        t = texts[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        marked = {j + o for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked))
        assert tuple(int(got[c][k]) for c in quality.COUNTS) == want


def test_decision_list_learns_a_planted_rule():
    rng = np.random.default_rng(1)
    x = {k: rng.random(3000) for k in ("symbols", "repeats", "noise")}
    bad = ((x["symbols"] > 0.8) & (x["repeats"] > 0.5)) | (x["repeats"] < 0.05)
    rules = quality.learn_decision_list(x, bad)
    caught = np.zeros(3000, bool)
    for r in rules:
        caught |= r.matches(x)
    assert (caught == bad).mean() > 0.97


def test_toxicity_held_out(spark, docs):
    # the smallest tables have few toxic rows, so the next size is used
    d = SF.replace("0.001", "0.1")
    got = toxicity.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    clean = [r for r in got if r.toxic == 0]
    assert right > 0.97 and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_grammar_marks_clauses():
    s = toxicity.Scorer(toxicity.Lexicon({}))

    def score(t):
        return float(s.scores(next(iter([s.features(c) for c in chunks(pa.array([t], pa.string()))])))[0])

    assert score("you are an idiot") > score("what an idiot") > score("he said an idiot") > score("not an idiot") > score("a fine day")
    assert score("the critic is not here. what an idiot") == score("what an idiot")
    assert score("such a total idiot") > score("an idiot")


def test_threats_take_intent_harm_and_a_target():
    s = toxicity.Scorer(toxicity.Lexicon({}))

    def score(t):
        return float(s.scores(next(iter([s.features(c) for c in chunks(pa.array([t], pa.string()))])))[0])

    none = score("a fine day")
    for t in ("you will die tonight", "I hope they burn your house down", "I will kill you", "ich werde dich töten", "we're going to hurt him", "you deserve to suffer"):
        assert score(t) >= 0.5, t
    for t in ("kill the process", "you will see", "the movers hurt the piano", "er will die Frage", "ihr werdet die Antwort kennen", "burn the image to a disk", "I will run the whole test suite today and kill stale workers"):
        assert score(t) < 0.1, t
    assert none < score("they hurt him") < 0.3
    assert score("he said I will kill you") < score("I will kill you") and score("I will not hurt you") < 0.1
    # phrases end with the clause, and beyond REACH other words
    assert score("I will wait. kill the process. you too") < 0.1
    assert score("you will surely one fine and distant day die") < 0.1


def test_learned_words_are_insults_or_verbs_of_harm(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustr") for _ in range(5))
    rows = [(" ".join(word() for _ in range(12)) + f" i will {word()} grommel {word()} {word()} {word()} {word()} blarg {word()}", 1) for _ in range(60)]
    rows += [(" ".join(word() for _ in range(20)) + " i will visit you", 0) for _ in range(200)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert found["grommel", 0][0] == "harm" and found["blarg", 0][0] == "slur"


def test_jaccard_against_brute_force(spark, docs, texts):
    nodes = jaccard.with_nodes(docs.select("doc_id", "text"), 3, "text", "node", "size").drop("text")
    got = {r.doc_id: (r.size, r.component_id) for r in jaccard.jaccard_components(nodes, docs, 3, 90).collect()}
    assert got == brute_components(texts, 3, 90)


def brute_components(texts, k, t):
    sets = {}
    for i, x in texts.items():
        w = x.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for p, a in enumerate(names):
        for b in names[p + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in names}


def test_jaccard_large_group_by_pivot(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(3000)]
    base = [rng.choice(voc) for _ in range(120)]
    rows = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = rng.choice(voc)
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    nodes = jaccard.with_nodes(df, 3, "text", "node", "size").drop("text")
    assert {r.doc_id: (r.size, r.component_id) for r in jaccard.jaccard_components(nodes, df, 3, 90).collect()} == brute_components(rows, 3, 90)


def test_lm_base_counts_and_held_out(spark, texts):
    got = {r.doc_id: r for r in lm.op3_lm_scoring(spark, SF).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("held", [65_535, 0])
def test_lm_unigrams_are_exact(spark, monkeypatch, held):
    # 'thin' occurs 7 times in each of 8 partitions, 'flat' 56 times in one; p0 is all that counts after an unknown word
    monkeypatch.setattr(lm, "TOP_WORDS", held)
    rows = []
    for part in range(8):
        for i in range(7):
            rows += [(part, f"a{part}x{i} thin b{part}x{i}", True), (0, f"c{part}x{i} flat d{part}x{i}", True)]
        rows += [(part, " ".join(f"w{part}y{i * 7 + k}" for k in range(60)), True) for i in range(10)]
    rows += [(0, "unheard thin", False), (0, "unheard flat", False), (0, "unheard", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, part int, text string, train boolean")
    got = {r.doc_id: r.score for r in lm.score(df.repartitionById(8, F.col("part"))).collect()}
    thin, flat, without = (got[len(rows) - i] for i in (3, 2, 1))
    share = 56 / sum(len(t.split()) for _, t, train in rows if train)
    assert abs(thin - flat) < 0.01
    # neither word is ever followed by the end mark, which follows an unknown word with p0
    back = lm.MASS1 / (56 + lm.MASS1) if 56 <= lm.HOT_SHARE * sum(len(t.split()) + 1 for _, t, train in rows if train) else 1.0
    assert abs(thin - without - math.log10(0.95 * share * back)) < 0.05


def brute_lm(rows):
    """log10 probabilities by plain dictionaries; rows: (text, train)."""
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for t, _ in rows]
    uni, pairs, triples, ctx, ctx2, c3 = Counter(), Counter(), Counter(), Counter(), Counter(), np.zeros((64, 64, 64))
    for w, (_, train) in zip(tokens, rows):
        if train:
            h2 = h1 = "start"
            for x in w:
                uni[x] += 1
                ctx[h1] += 1
                pairs[h1, x] += 1
                ctx2[h2, h1] += 1
                triples[h2, h1, x] += 1
                h2, h1 = h1, x
                a = b = 0
                for s in [*(int(lm._SYM[y]) for y in x or b""), *([0] if x else [])]:
                    c3[a, b, s] += 1
                    a, b = b, s
    n, ends = sum(uni.values()), uni[None]
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + 64)
    p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
    p3 = (c3 + 4 * p2) / (c3.sum(2, keepdims=True) + 4)

    def p0(x):
        if x is None:
            return (ends + 1) / (n + 2)
        a = b = 0
        p = 1.0
        for s in [*(int(lm._SYM[y]) for y in x), 0]:
            p *= p3[a, b, s] / (max(1, lm._SHARED[s]) if s else 1)
            a, b = b, s
        alpha = 0.95 if n > ends else 0.0
        return (1 - (ends + 1) / (n + 2)) * (alpha * uni[x] / max(1, n - ends) + (1 - alpha) * ((0.5 * p if uni[x] < lm.RARE else 0) + 0.5 / max(1, len(uni) - (ends > 0))))

    often = {x for x, k in uni.items() if k > lm.HOT_SHARE * n} | ({"start"} if ends > lm.HOT_SHARE * n else set())
    for w in tokens:
        h2 = h1 = "start"
        total = 0.0
        for x in w:
            if h1 in often:
                p = (triples[h2, h1, x] + lm.MASS1 * p0(x)) / (ctx2[h2, h1] + lm.MASS1)
            else:
                p = (pairs[h1, x] + lm.MASS1 * p0(x)) / (ctx[h1] + lm.MASS1)
                p = (triples[h2, h1, x] + lm.MASS2 * p) / (ctx2[h2, h1] + lm.MASS2)
            total += math.log10(p)
            h2, h1 = h1, x
        yield total, len(w)


def test_lm_scores_by_brute_force_and_at_any_partitioning(spark, texts):
    rng = random.Random(3)
    line = "the same old boilerplate line"
    rows = [(t, i % 7 != 2) for i, t in texts.items()][:120]
    rows += [(" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 30))) + f" {line} {line}", k % 3 > 0) for k in range(60)]
    want = list(brute_lm(rows))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, train boolean")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for shards, parts in ((4, 2), (32, 9), (211, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", shards)
            seen.append({r.doc_id: r.score for r in lm.score(df.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    for i, (score, tokens) in enumerate(want):
        assert abs(seen[0][i] - score) < 1e-3 * tokens + 1e-4, (i, seen[0][i], score, tokens)


def test_elias_fano():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 40, 5000).astype(U64))
    e = lm.EliasFano.build(x, 1 << 40)
    assert (e.access(np.arange(len(x))) == x).all()
    assert (e.find(x) == np.arange(len(x))).all()
    other = rng.integers(0, 1 << 40, 1000).astype(U64)
    other = other[~np.isin(other, x)]
    assert (e.find(other) == -1).all()
    assert len(lm.EliasFano.build(np.zeros(0, U64), 8).find(x[:3])) == 3


def test_loser_tree_never_misorders():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14))) for _ in range(500)]
    got = list(suffixes.LoserTree([iter(suffixes.front_code(sorted(words[i::7]))) for i in range(7)]))
    assert [g[0] for g in got] == sorted(words)
    assert all(b[1] == suffixes.common_prefix(a[0], b[0], 0) for a, b in zip(got, got[1:]))


def test_suffixes_against_brute_force(spark, texts):
    data = {i: t.encode() for i, t in texts.items()}
    n = suffixes.LENGTH
    seen = Counter(hash(x[j : j + n]) for x in data.values() for j in range(len(x) - n + 1))
    for r in suffixes.op4_suffix_dedup(spark, SF).collect():
        x = data[r.doc_id]
        edge = np.zeros(len(x) + 1, np.int64)
        for j in range(len(x) - n + 1):
            if seen[hash(x[j : j + n])] > 1:
                edge[j] += 1
                edge[j + n] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), int(gone.sum()), spans, kept)


def test_shared_passages_against_brute_force(spark, texts):
    n, rng = suffixes.WORDS, random.Random(6)
    rows = dict(list(texts.items())[:120])
    short = " ".join(rng.choice("ab cd ef gh i".split()) + str(k) for k in range(n))  # 51 words of under 400 bytes
    for i in range(6):
        own = [f"own{i}x{k}" for k in range(150)]
        rows[10**6 + i] = " ".join(own[: 20 * i]) + "\n " + short + " " + " ".join(own[20 * i :])
    rows[10**6 + 7] = " ".join(short.split()[:-1])  # one word less
    rows[10**6 + 8] = " ".join(["again"] * 300)  # within one document only
    seen, words = {}, {i: t.encode().split() for i, t in rows.items()}
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            seen.setdefault(tuple(w[j : j + n]), set()).add(i)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.n_passage_words for r in suffixes.cut(df, with_text=False).collect()}
    for i, w in words.items():
        held = set()
        for j in range(len(w) - n + 1):
            if len(seen[tuple(w[j : j + n])]) > 1:
                held.update(range(j, j + n))
        assert got[i] == len(held), i
    assert got[10**6] == n and got[10**6 + 7] == got[10**6 + 8] == 0


def test_mix_meets_targets(spark):
    out = mixing.op6_source_mixing(spark, SF).collect()
    again = mixing.op6_source_mixing(spark, SF).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    total = sum(r.size for r in out)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
    assert all(abs(taken[k] - target[k]) <= 1 or k[0] == 0 for k in taken)
    assert abs(sum(taken.values()) - 1.5 * total) <= len(taken)


def test_licences_against_brute_force(spark, docs, texts):
    for r in licences.scan(docs).collect():
        t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in texts[r.doc_id])
        w = re.findall(licences.WORD, t)
        at = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_salvage_recovers_around_damage(tmp_path):
    import gzip
    import io

    parts = [gzip.compress(warc.record_bytes(i, f"http://h/{i}", b"payload %d" % i * 50, None)) for i in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + b"junk" + parts[3] + parts[4][:-10]
    found = list(warc.salvage(io.BytesIO(data)))
    records = [x for x in found if isinstance(x, warc.Record)]
    gaps = [(x.start, x.end) for x in found if isinstance(x, warc.Gap)]
    # the last member lost its end; its record may still be whole
    assert [r.headers["x-page-id"] for r in records] in (["0", "1", "3"], ["0", "1", "3", "4"])
    a = len(parts[0] + parts[1])
    b = a + len(broken) + 4
    assert gaps == [(a, b), (b + len(parts[3]), len(data))]


def test_salvage_inside_a_member():
    import gzip
    import io

    parts = [warc.record_bytes(i, None, b"payload %d" % i * 40, None) for i in range(6)]
    bad = parts[2].replace(b"payload 2", b"damaged 2", 1)
    member = gzip.compress(b"".join((*parts[:2], bad, *parts[3:5])))
    found = list(warc.salvage(io.BytesIO(member + gzip.compress(parts[5]))))
    assert [x.headers["x-page-id"] for x in found if isinstance(x, warc.Record)] == ["0", "1", "3", "4", "5"]
    assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == [(0, len(member))]
    # a member that breaks off keeps the sound records before
    rng = random.Random(1)
    parts = [warc.record_bytes(i, None, rng.randbytes(5000), None) for i in range(4)]
    member = gzip.compress(b"".join(parts))
    found = list(warc.salvage(io.BytesIO(member[: len(member) * 3 // 5] + gzip.compress(parts[3]))))
    assert [x.headers["x-page-id"] for x in found if isinstance(x, warc.Record)] == ["0", "1", "3"]


def test_long_records_are_read_in_pieces(monkeypatch):
    import gzip
    import io

    monkeypatch.setattr(warc, "PIECE", 1 << 12)
    parts = [warc.record_bytes(i, None, bytes([65 + i]) * size, None) for i, size in enumerate((10, 3_000_000, 0, 70_000))]
    liar = parts[0].replace(b"Content-Length: ", b"Content-Length: 99999999999999", 1)
    for data in (b"".join(parts[:2]) + liar + b"".join(parts[2:]), b"".join(map(gzip.compress, [*parts[:2], liar, *parts[2:]]))):
        found = list(warc.salvage(io.BytesIO(data), keep=False))
        records = [x for x in found if isinstance(x, warc.Record)]
        assert [(x.headers["x-page-id"], x.payload_bytes()) for x in records] == [("0", 10), ("1", 3_000_000), ("2", 0), ("3", 70_000)]
        assert records[1].digest == warc.base32_sha1(b"B" * 3_000_000) and records[1].body is None
        assert sum(isinstance(x, warc.Gap) for x in found) == 1


def test_salvage_of_plain_records():
    import io

    parts = [warc.record_bytes(i, None, b"x" * 3000, None) for i in range(4)]
    bad = parts[1].replace(b"Content-Length: 3", b"Content-Length: 9", 1)
    found = list(warc.salvage(io.BytesIO(parts[0] + bad + parts[2] + parts[3])))
    assert [x.headers["x-page-id"] for x in found if isinstance(x, warc.Record)] == ["0", "2", "3"]
    assert sum(isinstance(x, warc.Gap) for x in found) == 1


def test_decontamination_finds_all_passages(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda s: " " + " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", s.lower()).split()) + " "
    norm = {i: plain(t) for i, t in texts.items()}
    want = {(d, i) for i, t in items for d, x in norm.items() if plain(t) in x}
    got = {(r.doc_id, r.item_id) for r in decontam.op9_benchmark_decontamination(spark, SF).collect()}
    assert want <= got


def test_decontamination_by_exact_similarity_in_any_blocks(spark):
    rng = random.Random(12)
    pool = [f"w{k}" for k in range(400)]
    shared = [rng.choice(pool) for _ in range(25)]
    items = {i: [rng.choice(pool) for _ in range(20 + i)] + (shared if i % 2 else []) for i in range(40)}
    docs = {}
    for i, w in items.items():
        for k in range(6):
            near = list(w)
            for _ in range(k % 3):
                near[rng.randrange(len(near))] = rng.choice(pool)
            docs[len(docs)] = [rng.choice(pool) for _ in range(rng.randint(0, 60))] + near + [rng.choice(pool) for _ in range(rng.randint(0, 60))]
    docs[10**6] = [rng.choice(pool) for _ in range(3000)]
    five = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    df = Counter(x for w in items.values() for x in five(w))
    weight = lambda x: math.log(1 + len(items) / df.get(x, 0)) if x in df else math.log(1 + len(items))
    total = lambda xs: sum(map(weight, xs))
    want = {}
    for d, w in docs.items():
        for i, t in items.items():
            a, best = five(t), 0.0
            for j in range(max(1, len(w) - len(t) + 1)):
                b = five(w[j : j + len(t)])
                if not a.isdisjoint(b):
                    best = max(best, total(a & b) / total(a | b))
            if best >= decontam.SIMILARITY:
                want[d, i] = best
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    size = sum(len(" ".join(w)) for w in items.values())
    found = []
    for blocks in (decontam.item_blocks(bench), decontam.item_blocks(bench, block_bytes=-(-size // 20))):
        found.append({(r.doc_id, r.item_id): r.similarity for r in decontam.find_matches(frame, blocks).collect()})
    assert len(blocks) >= 20 and found[0].keys() == found[1].keys()
    assert all(math.isclose(found[0][k], found[1][k], rel_tol=1e-9) for k in found[0])
    assert found[0].keys() <= want.keys() and all(x <= want[k] + 1e-9 for k, x in found[0].items())
    assert len(found[0]) >= 0.9 * len(want) and sum(v < 0.999 for v in want.values()) > 30


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 1 << 63, 300).astype(U64)
    queries = prints[:200].copy()
    for i in range(200):
        for b in rng.choice(64, i % (decontam.RADIUS + 1), replace=False):
            queries[i] ^= U64(1) << U64(b)
    q, i = decontam.HammingIndex(prints).query(queries)
    want = {(a, b) for a in range(200) for b in range(300) if int(queries[a] ^ prints[b]).bit_count() <= decontam.RADIUS}
    assert set(zip(q.tolist(), i.tolist())) == want


def test_licence_labels_and_scores_by_brute_force(spark):
    rng = random.Random(21)
    lines = list(licences.TEMPLATES)
    rows = {}
    for i in range(120):
        w = [rng.choice("alpha beta gamma delta software license public copy".split()) for _ in range(rng.randint(0, 30))]
        if i % 3:
            t = lines[i % len(lines)].split()
            for _ in range(rng.choice((0, 0, 1, 3, 8))):
                t[rng.randrange(len(t))] = "zzz"
            w[len(w) // 2 : len(w) // 2] = t
        rows[i] = " ".join(w)
    rows[200], rows[201] = None, "Neither line, but the MIT License: \u00e9t\u00e9"
    words = {i: re.findall(licences.WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for i, t in rows.items()}
    n = len(rows)
    idf = lambda x: math.log((n + 1) / (sum(x in set(w) for w in words.values()) + 1)) + 0.01
    index = [(t.split(), label) for t, label in licences.TEMPLATES.items()]
    value = {x: idf(x) for t, _ in index for x in t if x not in licences.STOP}
    frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan(frame).collect()}
    several = set()
    for i, w in words.items():
        at = lambda p, w=w: [k for k in range(len(w)) if w[k : k + len(p)] == p]
        base = {label for p, label in licences.BASE.items() if at(p.split())}
        best = {}
        for t, label in index:
            own = [(k, x) for k, x in enumerate(t) if x in value]
            # dense ranks by idf and word: the rarest words, wherever they stand
            rare = set(sorted({x for _, x in own}, key=lambda x: (-value[x], x))[: licences.RAREST])
            whole = sum(value[x] for _, x in own)
            for o in {p - k for p, y in enumerate(w) for k, x in own if x == y and x in rare}:
                share = sum(value[x] for k, x in own if 0 <= o + k < len(w) and w[o + k] == x) / whole
                if share >= licences.COVERAGE - 1e-12 and any(at(p.split()) for p in licences.MANDATORY[label]):
                    best[label] = max(best.get(label, 0), round(min(share, 1.0), 6))
        several |= set(best)
        assert got[i].labels == ",".join(sorted(base | set(best))), (i, rows[i], got[i])
        assert math.isclose(got[i].score, 1.0 if base else max(best.values(), default=0.0), abs_tol=2e-6)
    assert len(several) >= 8


def test_quality_verdicts_by_brute_force(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out, rules = quality.judge(docs, labels)
    assert rules
    ratio = lambda s, k: s[quality.FEATURES[k][0]] / max(1, s[quality.FEATURES[k][1]]) if quality.FEATURES[k][1] else s[quality.FEATURES[k][0]]
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    dropped = 0
    for r in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        seen, repeated = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2)), set()
        for j in range(len(w) - 2):
            if seen[tuple(w[j : j + 3])] > 1:
                repeated.update((j, j + 1, j + 2))
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        s = r.stats.asDict()
        fires = any(all(ratio(s, k) <= x if op == "<=" else ratio(s, k) >= x for k, op, x in rule.tests) for rule in rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not fires), r.doc_id
        dropped += fires and not failed
    assert dropped
