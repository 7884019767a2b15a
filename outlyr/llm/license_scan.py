"""License scans by a positional rare-token index (op11), in DataFrame operations alone.

The index holds the places of every word of the TEMPLATES. A text is reduced to the places of its licence words (those
of the templates and of the base PHRASES), in one pass; what follows never reads texts again.

1. Candidates. Of a template's words that a file has, the RARE ones with the highest inverse document frequency (fewest
   documents, then by word) are looked up in the index. A word at place x of the file and p of the template says that the
   template begins at x - p; a beginning that NEED places or more agree on is a candidate.
2. Verification. Every mandatory key phrase of the template must stand in the file, whole, within SLACK words of
   its place from the candidate on, and of all the template's words at least a share of ACCEPT must stand within SLACK words of theirs.
The label of a template that passes is added to those of the base phrases. ``score`` is the largest share of a template
that passes; a base phrase is a template of which every word is mandatory, so it has 1; without labels it is 0.

Files that lack a word of a key phrase are no candidates for its template, which cannot pass there; so step 1 looks at few files. The
document frequencies, one number for each licence word, are all that comes to the driver.

Defined cases: a null or empty text has no words and no labels (empty strings), and null first_word and last_word; copies and repeated rows count
in frequencies and are judged each; a null doc_id is a row like any other; an empty table gives an empty one. Texts of any
length are taken whole, in one row's memory. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyr.llm.common import few, scratch, written
from outlyr.llm.native import let

#: What separates words, after A-Z were lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, NEED, SLACK, ACCEPT = 6, 2, 3, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public notices of licences: label, words of the notice, mandatory key phrases in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "sublicense and or sell copies of the software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license version 2 0", "except in compliance with the license")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "either version 3 of the license", "any later version")),
    ("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "either version 2 of the license", "any later version")),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license v 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("the authors be held liable for any damages arising from the use of this software",)),
)

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p in PHRASES for w in p.split()})
_NUMBER = {w: k for k, w in enumerate(VOCABULARY)}


def _key_places(text: str, key: str) -> tuple[int, int]:
    """Where in a template a key phrase begins, and its number of words."""
    ws, k = text.split(), key.split()
    return next(i for i in range(len(ws)) if ws[i : i + len(k)] == k), len(k)


def _places(phrase: list[int], h: Column) -> Column:
    """The starts of a phrase in a file's licence words (word, place), whose neighbours in the file are neighbours here."""

    def at(x: Column, i: Column) -> Column:
        rest = [((y := F.get(h, i + k))["word"] == w) & (y["at"] == x["at"] + k) for k, w in enumerate(phrase) if k]
        return reduce(lambda a, b: a & b, rest, x["word"] == phrase[0])

    return F.transform(F.filter(h, lambda x, i: F.coalesce(at(x, i), F.lit(False))), lambda x: x["at"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, the places of the licence words (word, at) and those of the base phrases (label, at) of every text."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    ws = F.filter(F.split(lower, BETWEEN), lambda w: w != "")
    numbers = F.map_from_arrays(F.array(*[F.lit(w) for w in VOCABULARY]), F.array(*[F.lit(k) for k in range(len(VOCABULARY))]))
    pairs = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda e: e["w"].isin(VOCABULARY))
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), ws.alias("ws"))
    own = own.select("doc_id", "row", F.size("ws").cast("long").alias("n_words"), pairs(F.col("ws")).alias("found"))
    own = own.select("doc_id", "row", "n_words", F.transform("found", lambda e: F.struct(F.element_at(numbers, e["w"]).alias("word"), e["at"].alias("at"))).alias("licence"))

    def spots(phrase: str, label: str) -> Column:
        return F.transform(_places([_NUMBER[w] for w in phrase.split()], F.col("licence")), lambda x: F.struct(F.lit(label).alias("label"), x.alias("at")))

    return own.withColumn("base", F.concat(*[spots(p, label) for p, label in PHRASES.items()]))


def rarity(files: DataFrame) -> list[int]:
    """The numbers of the licence words, rarest first by the number of files that have them, then by word."""
    seen = files.select(F.explode(F.array_distinct(F.col("licence.word"))).alias("word")).groupBy("word").count()
    have = {r.word: r["count"] for r in seen.collect()}  # a row for each licence word
    return sorted(range(len(VOCABULARY)), key=lambda k: (have.get(k, 0), VOCABULARY[k]))


def index(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The postings (template, word, place) and the words of key phrases (template, key, begin, words, place) of all templates."""
    postings = [(t, _NUMBER[w], p) for t, (_, text, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split())]
    keys = [(t, k, a, n, p) for t, (_, text, own) in enumerate(TEMPLATES) for k, key in enumerate(own) for a, n in [_key_places(text, key)] for p in range(a, a + n)]
    return spark.createDataFrame(postings, "template int, word int, place int"), spark.createDataFrame(keys, "template int, key int, begin int, words int, place int")


def _looked_up(files: DataFrame, rarest: list[int]) -> DataFrame:
    """row, licence, template and the words to look up, of files that have all words of the template's key phrases."""
    rank = {w: k for k, w in enumerate(rarest)}
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    every = F.array(*[
        F.struct(F.lit(t).alias("template"), ints(sorted({_NUMBER[w] for k in keys for w in k.split()})).alias("must"), ints(sorted({_NUMBER[w] for w in text.split()}, key=rank.__getitem__)).alias("words"))
        for t, (_, text, keys) in enumerate(TEMPLATES)
    ])

    def of(seen: Column) -> Column:
        able = F.filter(every, lambda t: F.size(F.array_except(t["must"], seen)) == 0)
        # the words of a template are sorted by rarity, and an intersection keeps that order
        return F.transform(able, lambda t: F.struct(t["template"].alias("template"), F.slice(F.array_intersect(t["words"], seen), 1, RARE).alias("look")))

    found = files.where(F.size("licence") > 0).select("row", "licence", let(F.array_distinct(F.col("licence.word")), of).alias("able")).where(F.size("able") > 0)
    return found.select("row", "licence", F.explode("able").alias("a")).select("row", "licence", "a.template", "a.look")


def matches(files: DataFrame, rarest: list[int]) -> DataFrame:
    """row, template, begin and share of every candidate that passes, of the table of ``scanned``."""
    postings, keys = (F.broadcast(x) for x in index(files.sparkSession))  # a few hundred rows, fixed
    able = written(_looked_up(files, rarest), "able")
    rare = able.select("row", "template", F.explode(F.expr("filter(licence, x -> array_contains(look, x.word))")).alias("x")).select("row", "template", F.col("x.word").alias("word"), F.col("x.at").alias("at"))
    begins = rare.join(postings, ["template", "word"]).groupBy("row", "template", (F.col("at") - F.col("place")).alias("begin")).agg(F.count("*").alias("agree"))
    begins = written(begins.where(F.col("agree") >= NEED).select("row", "template", "begin"), "begins")
    pairs = able.select("row", "template", F.explode("licence").alias("x")).select("row", "template", F.col("x.word").alias("word"), F.col("x.at").alias("at")).join(postings, ["template", "word"])
    pairs = pairs.select("row", "template", "place", (F.col("at") - F.col("place")).alias("shift"))
    near = F.explode(F.sequence(F.lit(-SLACK), F.lit(SLACK))).alias("by")
    at = lambda df, *more: df.select("row", "template", "shift", near, *more).select("row", "template", (F.col("shift") + F.col("by")).alias("begin"), *more)
    on = ["row", "template", "begin"]
    agree = at(pairs, "place").join(begins, on).groupBy(on).agg(F.count_distinct("place").alias("agree"))
    whole = pairs.join(keys, ["template", "place"]).groupBy("row", "template", "key", "shift").agg(F.count("*").alias("n"), F.first("words").alias("words")).where("n = words")
    proved = at(whole, "key").join(begins, on).groupBy(on).agg(F.count_distinct("key").alias("keys"))
    sizes = files.sparkSession.createDataFrame([(t, len(text.split()), len(own), label) for t, (label, text, own) in enumerate(TEMPLATES)], "template int, size int, must int, label string")
    passed = agree.join(proved, on).join(F.broadcast(sizes), "template").where((F.col("keys") == F.col("must")) & (F.col("agree") >= F.lit(ACCEPT) * F.col("size")))
    return passed.select("row", "template", "label", "begin", (F.col("agree") / F.col("size")).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base places and labels, all labels and the score of every text. Tables that the result does not read are deleted."""
    with scratch(docs.sparkSession) as keep:
        files = keep(written(scanned(docs), "licence"))
        passed = matches(files, rarity(files)).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
        passed = keep(written(passed, "labels"))
    joined = files.drop("licence").join(few(passed), "row", "left")
    spots, labels = F.col("base.at"), F.array_distinct(F.col("base.label"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return joined.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(spots).cast("long").alias("first_word"), F.array_max(spots).cast("long").alias("last_word"),
        text(labels).alias("base_labels"), text(F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
