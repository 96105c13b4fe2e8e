"""License scans by a positional rare-token index, DataFrame functions only.

The index holds, for each license statement, the positions of its words that
are not function words, weighed by their inverse document frequency over the
whole corpus.  A file's occurrences of the rarest words of a statement are
looked up first: each proposes an offset (file position minus template
position).  Only there the postings of the other words are intersected by
relative position.  A statement counts when the words on one offset carry
enough weight, and a mandatory key phrase of its license stands in the file
word by word.

Defined cases: a null text counts as an empty one (no words, no labels, score
0); repeated rows are scanned each on its own; an empty table gives no rows;
extra columns are ignored; offsets may be negative where a text begins inside
a statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftset.functions.shared import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases of the base scan and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Statements of public licenses, lower-cased, words only.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl",
    "under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl",
    "boost software license version 1 0": "bsl",
}
# Phrases of which one has to stand in a file with that label.
MANDATORY = {
    "mit": ("mit license", "permission is hereby granted"), "apache": ("apache license", "apache org licenses"),
    "gpl": ("general public license",), "bsd": ("source and binary forms",),
    "cc": ("cc by", "creative commons"), "mpl": ("mozilla public license",), "lgpl": ("lesser general public license",),
    "agpl": ("affero general public license",), "isc": ("copyright notice and this permission notice",),
    "unlicense": ("public domain", "compiled binary"), "epl": ("eclipse public license",), "bsl": ("boost software license", "covered by this license"),
}
# Function words and digits that the index leaves out.
STOP = "a an and any are as at be by can except file following for free in is it may met no not obtain of on or person that the this to under use with without work you v 0 1 2 3 4".split()
#: Share of a statement's weight that one offset must carry, and its rarest words of which one must be there.
COVERAGE, RAREST = 0.6, 3


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _places(phrase: str) -> Column:
    """Starts (word positions from 0) of a phrase in the array ``ws``."""
    ws = F.col("ws")
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(ws, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(ws, i + k) == p)
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), here)
    return F.when(F.contains(F.col("line"), F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def _literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as one literal, without Python data in the plan."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(items))


def postings(spark: SparkSession) -> DataFrame:
    rows = [
        (label, f"{label}{t}", w, pos)
        for t, (text, label) in enumerate(TEMPLATES.items())
        for pos, w in enumerate(text.split())
        if w not in STOP
    ]
    return _literal_rows(spark, rows, ["label", "template", "word", "tpos"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per file: n_words, base places, labels and the best score."""
    spark = docs.sparkSession
    vocabulary = sorted({w for t in TEMPLATES for w in t.split()} - set(STOP))
    phrases = sorted({p for ps in MANDATORY.values() for p in ps} | set(BASE))
    told = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("ws"))
    some = F.arrays_overlap("ws", F.array(*[F.lit(w) for w in vocabulary]))
    told = told.select("doc_id", "ws", some.alias("some"))
    # only files with an index word are looked at closely
    line = F.when(F.col("some"), F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))).otherwise("")
    told = told.select("doc_id", "ws", "some", line.alias("line"))
    hits = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(vocabulary))
    rows = materialise(
        told.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("ws").cast("bigint").alias("n_words"),
            F.array(*[F.struct(F.lit(l).alias("label"), _places(p).alias("at")) for p, l in BASE.items()]).alias("base"),
            F.when(F.col("some"), hits).alias("hits"),
            F.filter(F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), F.lit(p)) for p in phrases]), lambda x: x.isNotNull()).alias("phrases"),
        ),
        "licences",
    )
    seen = rows.select("rid", F.explode("hits").alias("h")).select("rid", "h.word", "h.pos")
    # one row per index word: document frequencies over the whole corpus
    df = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count()
    n = rows.count()  # from the Parquet footers
    index = postings(spark)
    # the index is a fixed list of statements: about a hundred rows at any corpus size
    idf = (
        F.broadcast(index).join(df, "word", "left")
        .withColumn("idf", F.log(F.lit(n + 1.0) / (F.coalesce("count", F.lit(0)) + 1)) + 0.01)
    )
    idf = idf.select("label", "template", "word", "tpos", "idf")
    of = Window.partitionBy("template")
    idf = (
        idf.withColumn("whole", F.sum("idf").over(of))
        .withColumn("rare", F.dense_rank().over(of.orderBy(F.desc("idf"), "word")) <= RAREST)
    )
    offset = (F.col("pos") - F.col("tpos")).alias("offset")
    spot = ["rid", "template", "offset"]
    proposed = seen.join(F.broadcast(idf.where("rare")), "word").select("rid", "template", offset).distinct()
    on = (
        seen.join(F.broadcast(idf), "word").select("rid", "label", "template", offset, "idf", "whole").join(proposed, spot, "left_semi")
        .groupBy("label", *spot).agg((F.sum("idf") / F.first("whole")).alias("share")).where(F.col("share") >= COVERAGE)
        .groupBy("rid").agg(F.collect_set(F.struct("label", F.round(F.least("share", F.lit(1.0)), 6).alias("share"))).alias("pairs"))
    )
    held = F.array(*[
        F.when(F.arrays_overlap("phrases", F.array(*[F.lit(p) for p in ps])), F.lit(label)) for label, ps in MANDATORY.items()
    ])
    out = rows.drop("hits").join(on, "rid", "left").withColumn("held", F.filter(held, lambda x: x.isNotNull()))
    good = F.filter(F.coalesce("pairs", F.array().cast("array<struct<label:string,share:double>>")), lambda p: F.array_contains(F.col("held"), p["label"]))
    out = out.withColumn("good", good)
    base = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    places = F.flatten(F.transform("base", lambda b: b["at"]))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("good", lambda p: p["label"]))))
    best = F.coalesce(F.array_max(F.transform("good", lambda p: p["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.size(base) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
