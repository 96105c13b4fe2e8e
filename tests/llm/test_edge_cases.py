"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftset.llm import boilerplate, decontam, jaccard, licences, lm, mixing, quality, suffixes, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, stats string, node string, size_x int, h string"
WORDS = " ".join(f"word{i % 97}x{i % 13}" for i in range(300))
ROWS = [
    (1, WORDS, "en", "a", 10, "s", "n", 1, "h"),
    (1, WORDS, "en", "a", 10, "s", "n", 1, "h"),
    (2, "", None, None, None, None, None, None, None),
    (3, None, None, "b", 0, None, None, None, None),
    (None, "two words", "en", None, 9, None, None, None, None),
    (4, "x" * 5000, "en", "b", 5000, None, None, None, None),
    (5, "Released under the MIT License.", "en", "b", 31, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 1), (77, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_quality(docs, none, labels):
    out, rules = quality.judge(docs, labels)
    assert rules == [] and out.count() == len(ROWS)
    assert out.where("doc_id = 3").first().stats.n_words == 0
    kept = quality.apply_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality.apply_quality(none, labels).count() == 0
    assert quality.apply_quality(docs, labels.limit(0)).count() == 2


def test_toxicity(docs, none, labels):
    scorer = toxicity.train(docs, labels)
    rows = toxicity.score(docs, scorer).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, scorer).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_jaccard(docs, none):
    nodes = jaccard.with_nodes(docs.select("doc_id", "text"), 3, "text", "node", "size").drop("text")
    got = {(r.doc_id, r.size, r.component_id) for r in jaccard.jaccard_components(nodes, docs, 3, 90).collect()}
    assert got == {(1, 298, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (4, 1, 4), (5, 3, 5)}
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert jaccard.keep_one_of_each(none).count() == 0


def test_lm(docs, none):
    out = lm.score(docs.withColumn("train", F.lit(True))).collect()
    assert len(out) == len(ROWS)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {1} and all(r.score < 0 for r in out)
    assert lm.score(none.withColumn("train", F.lit(True))).count() == 0
    assert all(r.n_known == 0 for r in lm.score(docs.withColumn("train", F.lit(False))).collect())


def test_suffixes(docs, none):
    rows = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.cut(docs).collect()}
    n = len(WORDS)
    # the run of one letter recurs within its own document
    assert rows == {(1, n, n, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 9, 0, 0), (4, 5000, 5000, 1), (5, 31, 0, 0)}
    assert suffixes.cut(none).count() == 0
    assert {r.kept_sha256 for r in suffixes.cut(docs).where("doc_id = 2").collect()} == {hashlib.sha256(b"").hexdigest()}


def test_mixing(docs, none):
    out = mixing.mix_documents(docs)
    assert all(0 < r.taken <= 2 * r.size for r in out.collect())
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert mixing.mix_documents(none).count() == 0
    odd = docs.withColumn("size", F.lit("old"))
    for name in ("key", "rank", "row", "rows", "__n", "__range", "__of", "__inside", "__before", "weight"):
        odd = odd.withColumn(name, F.lit(name))
    got = mixing.mix_documents(odd)
    assert got.columns == [*[c for c in odd.columns if c != "size"], "size", "source_size", "target", "taken"]
    assert {r["__range"] for r in got.collect()} == {"__range"} and {r.taken for r in got.collect()} == {r.taken for r in out.collect()}


CLASHES = ("toxic", "t", "k", "k1", "ws", "line", "lines", "kept", "h", "gone", "train", "rid", "dest", "blob", "stats", "node", "size", "comp", "component_id", "item_id", "label", "labels", "held", "hits", "base", "good", "payload", "best", "of", "total", "text_2")


def test_clashing_names_in_every_operator(docs, labels, spark):
    odd = docs
    for name in CLASHES:
        odd = odd.withColumn(name, F.lit(name))
    n = len(ROWS)
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == n
    nodes = jaccard.with_nodes(odd.select("doc_id", "text"), 3, "text", "node", "size").drop("text")
    assert jaccard.jaccard_components(nodes, odd, 3, 90).count() == n
    kept = jaccard.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == n - 1
    assert lm.score(odd.withColumn("train", F.lit(True))).count() == n
    assert suffixes.cut(odd).count() == n
    passed = quality.apply_quality(odd, labels)
    assert passed.columns == odd.columns and passed.count() == 2
    assert licences.scan(odd).count() == n
    blocks = decontam.item_blocks(spark.createDataFrame([(1, WORDS)], "item_id bigint, text string"))
    assert decontam.find_matches(odd, blocks).count() == 2 and decontam.drop_contaminated(odd, blocks).columns == odd.columns
    again = boilerplate.dedup_documents(odd)
    assert again.columns == odd.columns and again.count() == n


def test_a_text_of_20_megabytes(spark, labels):
    docs = spark.range(3).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("bigint").alias("n_chars"),
        F.when(F.col("id") == 1, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(2_500_000)), lambda i: F.concat(F.lit("w"), i))))
        .otherwise(F.lit(WORDS)).alias("text"))
    assert docs.agg(F.max(F.octet_length("text"))).first()[0] > 20_000_000
    assert {r.doc_id: r.n_words for r in licences.scan(docs).collect()}[1] == 2_500_001
    assert {r.doc_id: r.n_tokens for r in lm.score(docs.withColumn("train", F.col("doc_id") > 0)).collect()}[1] == 2_500_002
    got = {r.doc_id: (r.n_removed, r.n_passage_words) for r in suffixes.cut(docs, with_text=False).collect()}
    assert got == {0: (len(WORDS), 300), 1: (0, 0), 2: (len(WORDS), 300)}
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 3
    assert {r.doc_id: r.size for r in mixing.mix_documents(docs).collect()}[1] == 2_500_001
    assert jaccard.keep_one_of_each(docs).count() == 2
    assert quality.apply_quality(docs, labels).count() >= 2 and boilerplate.dedup_documents(docs).count() == 3
    blocks = decontam.item_blocks(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1000, 1040)))], "item_id bigint, text string"))
    assert [(r.doc_id, r.first_word) for r in decontam.find_matches(docs, blocks).collect()] == [(1, 1000)]


def test_licences(docs, none):
    out = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert out[5].labels == "mit" and out[5].n_base == 1 and out[5].first_word == 3 and out[5].score == 1.0
    assert out[3].n_words == 0 and out[3].labels == "" and out[3].first_word is None
    assert licences.scan(none).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (2, "u", "x"), (3, "http://b/ c", None), (None, "http://n/", "x"), (4, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    m = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(m).collect())
    assert got == [(0, "revisit", 2, 1), (1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0)]
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(empty).count() == 0


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, " ".join(WORDS.split()[40:80])), (2, None), (3, ""), (4, "two words")], "item_id bigint, text string")
    blocks = decontam.item_blocks(items)
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.find_matches(docs, blocks).collect())
    assert got == [(0, 4), (1, 1), (1, 1)]
    assert decontam.drop_contaminated(docs, blocks).count() == len(ROWS) - 3
    assert decontam.find_matches(none, blocks).count() == 0
    assert decontam.drop_contaminated(docs, decontam.item_blocks(items.limit(0))).count() == len(ROWS)


def test_lines(spark, none):
    rows = [(i, f"menu\nbody {i}\n\nend {i}", "en", "s" if i < 10 else None, 5, None, None, None, None) for i in range(15)] + [ROWS[2], ROWS[3]]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in boilerplate.dedup_documents(docs).collect() if r.n_chars}
    assert out[14].text == "body 14\n\nend 14" and out[14].n_chars == 15
    again = boilerplate.dedup_documents(docs)
    assert again.columns == docs.columns and again.count() == len(rows) and again.where("text is null").count() == 1
    assert boilerplate.dedup_documents(none).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/", "<p>a</p><p>a</p>"), (3, "no url", "")], "page_id bigint, url string, html string")
    assert boilerplate.dedup_pages(pages).count() == 3


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "no such words here at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (plain, plain.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= table.count(), name
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == plain.columns, name
