"""The whole pipeline against plain Python, stage by stage on each stage's own input."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from driftset.llm import boilerplate, decontam, quality
from tests.conftest import SF
from tests.llm.test_operators import brute_components

WORD = r"[^\x20\x09-\x0D]+"


def good(spark, docs, labels):
    """Ids that neither the base rules nor the learned list rejects."""
    rules, out = quality.fit(docs, labels), set()
    for r in quality.text_statistics(docs, ["doc_id", "text"]).collect():
        w, s = re.findall(WORD, r.text or ""), r.stats.asDict()
        seen, repeated = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2)), set()
        for j in range(len(w) - 2):
            if seen[tuple(w[j : j + 3])] > 1:
                repeated.update((j, j + 1, j + 2))
        value = {k: s[a] / max(1, s[b]) if b else s[a] for k, (a, b) in quality.FEATURES.items()}
        fires = any(all(value[k] <= x if op == "<=" else value[k] >= x for k, op, x in rule.tests) for rule in rules)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and not fires:
            out.add(r.doc_id)
    return out


def without_boilerplate(rows):
    """doc_id -> text; rows: doc_id -> (source, text)."""
    key = lambda x: x.strip(" \t\r\x0b\f")
    pages, total = Counter(), Counter(s for s, _ in rows.values())
    for s, t in rows.values():
        pages.update({(s, key(x)) for x in t.split("\n") if key(x)})
    gone = {k for k, n in pages.items() if n >= boilerplate.LEAST and n > boilerplate.RATIO * total[k[0]]}
    return {i: "\n".join(x for x in t.split("\n") if (s, key(x)) not in gone) for i, (s, t) in rows.items()}


def contaminated(texts, items):
    plain = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t.lower()).split()
    five = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    items = [plain(t) for t in items]
    df = Counter(x for w in items for x in five(w))
    total = lambda xs: sum(math.log(1 + len(items) / df[x]) if x in df else math.log(1 + len(items)) for x in xs)
    out = set()
    for i, t in texts.items():
        w = plain(t)
        hits = [j for j in range(len(w) - 4) if tuple(w[j : j + 5]) in df]
        for item in items:
            a = five(item)
            for j in {k for h in hits for k in range(max(0, h - len(item) + 5), min(h, max(0, len(w) - len(item))) + 1)}:
                b = five(w[j : j + len(item)])
                if not a.isdisjoint(b) and total(a & b) / total(a | b) >= decontam.SIMILARITY:
                    out.add(i)
                    break
    return out


def mixed(rows):
    """doc_id -> (size, source_size, target, taken) of those that give words; rows: doc_id -> (source, text)."""
    size = {i: len(re.findall(WORD, t)) for i, (_, t) in rows.items()}
    own = defaultdict(int)
    for i, (s, _) in rows.items():
        own[s] += size[i]
    order = sorted(own, key=lambda s: s.encode())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(own.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * own[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * own[s] for s in full}
        left -= sum(2 * own[s] for s in full)
        free -= full
    out, before = {}, Counter()
    key = lambda i: int(hashlib.md5(f"{i}:{rows[i][0]}".encode()).hexdigest()[:15], 16)
    for i in sorted(rows, key=lambda i: (key(i), size[i])):
        s = rows[i][0]
        budget = math.floor(target[s] + 0.5)
        whole = budget // own[s] if own[s] else 0
        taken = whole * size[i] + max(0, min(size[i], budget - whole * own[s] - before[s]))
        before[s] += size[i]
        if taken:
            out[i] = (size[i], own[s], target[s], taken)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    d = SF.replace("0.001", "0.01")
    for name, where in (("documents", "WHERE doc_id % 5 < 2"), ("labels", ""), ("benchmark", "")):
        duckdb.sql(f"COPY (SELECT * FROM '{d}/{name}.parquet' {where}) TO '{tmp_path}/{name}.parquet'")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    first = {r.doc_id: r for r in docs.collect()}
    source = {i: r.source for i, r in first.items()}
    kept = good(spark, docs, labels)
    texts = without_boilerplate({i: (source[i], first[i].text) for i in kept})
    components = brute_components(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if components[i][1] == i or not components[i][0]}
    leaked = contaminated(texts, [r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect() if r.text])
    texts = {i: t for i, t in texts.items() if i not in leaked}
    want = mixed({i: (source[i], t) for i, t in texts.items()})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(kept) < len(first) and leaked and got.keys() == want.keys()
    for i, r in got.items():
        assert (r.text, r.source, r.lang, r.size, r.source_size, r.taken) == (texts[i], source[i], first[i].lang, *(want[i][k] for k in (0, 1, 3))), i
        assert math.isclose(r.target, want[i][2], rel_tol=1e-9) and r.n_chars == (first[i].n_chars if texts[i] == first[i].text else len(texts[i]))
