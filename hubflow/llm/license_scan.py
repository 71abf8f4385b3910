"""Licence scan by a positional index of rare tokens (operator 2); DataFrame functions only.

Templates are word sequences with mandatory key phrases. Every template is indexed by
its rarest words: the postings give (word, template, position). A file's words that are
in the index are looked up by rarity (document frequency over all files); postings
whose positions agree relative to the file (file position - template position) are
intersected, and an alignment counts when every word of its key phrases stands there.

One scan keeps the key phrases' words of each file with their positions (a code and a
number each, no context); files without a looked-up word keep none, so what follows is
small. Templates are a fixed list, which bounds the broadcasts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm.common import stage

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and labels (fixed values of the contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence notices: label, text, mandatory key phrases within the text.
TEMPLATES = [
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ["permission is hereby granted free of charge", "associated documentation files"]),
    ("apache-2.0-notice", "licensed under the apache license version 2 0", ["licensed under the apache license version 2 0"]),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "with or without modification"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify", "with or without fee"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("cc-by", "creative commons attribution", ["creative commons attribution"]),
]

#: Words of ordinary prose; they take part in the verification, not in the index.
PROSE = {"a", "and", "any", "are", "as", "by", "can", "for", "in", "into", "is", "it", "of", "or", "that", "the", "this", "to",
         "under", "use", "with", "without", "you", "v", "0", "1", "2"}
#: Rarest words of a key phrase that are looked up.
LOOKED_UP = 3


def phrases() -> list[tuple]:
    """(template, label, base, mandatory phrases of the template, phrase number, position in the template, words)."""
    out = []
    whole = [(label, text, [text], True) for text, label in BASE.items()] + [(label, text, keys, False) for label, text, keys in TEMPLATES]
    for t, (label, text, keys, base) in enumerate(whole):
        words = text.split()
        for q, key in enumerate(keys):
            key = key.split()
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            out.append((t, label, base, len(keys), q, at, key))
    return out


def vocabulary() -> list[str]:
    """Every word of a key phrase that isn't ordinary prose."""
    return sorted({w for *_, key in phrases() for w in key} - PROSE)


def file_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def word_rarity(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency over all files of every vocabulary word (as many rows as the vocabulary has words)."""
    vocab = F.array(*[F.lit(w) for w in vocabulary()])
    counts = (docs.select(F.explode(F.array_intersect(file_words(F.col("text")), vocab)).alias("word"))
              .groupBy("word").agg(F.count("*").alias("n")).collect())
    n = {r["word"]: r["n"] for r in counts}
    return {w: -math.log((n.get(w, 0) + 1) / (max(n.values(), default=0) + 2)) for w in vocabulary()}


def postings(spark: SparkSession, rarity: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """The index: one row per looked-up word of each key phrase, and the looked-up words."""
    rows, used = [], set()
    total: dict[int, float] = {}
    for t, *_, key in phrases():
        total[t] = total.get(t, 0) + sum(rarity.get(w, 0) for w in key)
    for t, label, base, n_keys, q, at, key in phrases():
        rare = sorted({w for w in key if w in rarity}, key=lambda w: (-rarity[w], w))[:LOOKED_UP]
        used |= set(rare)
        share = sum(rarity.get(w, 0) for w in key) / total[t] if total[t] else 1.0
        rows += [(w, t, label, base, n_keys, q, at, i, key, sum(key.count(x) for x in rare), share) for i, w in enumerate(key) if w in rare]
    return spark.createDataFrame(rows, "word string, template int, label string, base boolean, n_keys int, phrase int, at int, i int, "
                                       "key array<string>, n_rare int, share double"), sorted(used)


def license_scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, places). files: doc_id, h (MD5 of the text), n_words, for every row of ``docs``; places: doc_id, h, label, base,
    template, phrase, start (word number from 0), length, share (of the template's rarity weight), n_keys, origin (start - position in the template).

    A place is one occurrence of a key phrase, all of its words consecutive. Places are
    found for whole texts; a null text counts as empty; equal rows share their places.
    """
    docs = docs.select("doc_id", "text")
    index, looked = postings(docs.sparkSession, word_rarity(docs))
    words = sorted({w for *_, key in phrases() for w in key})
    wanted, known = F.array(*[F.lit(w) for w in looked]), F.array(*[F.lit(w) for w in words])
    w = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), file_words(F.col("text")).alias("w"))

    def hit(x, i):
        return F.when(F.array_contains(known, x), F.struct(F.array_position(known, x).cast("int").alias("code"), i.alias("pos")))

    hits = F.when(F.arrays_overlap("w", wanted), F.filter(F.transform("w", hit), lambda x: x.isNotNull()))
    files = stage(w.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), hits.alias("hits")), "licence-words")
    found = files.where("hits is not null").dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("hits").alias("x")).select("doc_id", "h", "x.*")
    code = F.array_position(known, F.col("word")).cast("int")
    # the rarest words' postings first: places where all of them agree in their relative position
    aligned = (found.join(F.broadcast(index.withColumn("code", code)), "code")  # the templates are a fixed list
               .withColumn("start", F.col("pos") - F.col("i")).where("start >= 0")
               .groupBy("doc_id", "h", "template", "phrase", "start")
               .agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("label", "base", "n_keys", "at", "key", "n_rare", "share")])
               .where("n = n_rare"))
    # then every word of the phrase at its place
    asked = aligned.select("doc_id", "h", "template", "phrase", "start", "label", "base", "n_keys", "at", "share", F.size("key").alias("length"), F.posexplode("key").alias("k", "word"))
    asked = asked.select("*", code.alias("c"), (F.col("start") + F.col("k")).alias("p")).drop("k", "word")
    there = found.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), F.col("code").alias("c2"), F.col("pos").alias("p2"))
    places = (asked.join(there, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")) & (F.col("c") == F.col("c2")) & (F.col("p") == F.col("p2")))
              .groupBy("doc_id", "h", "template", "phrase", "start").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("label", "base", "n_keys", "at", "share", "length")])
              .where("n = length")
              .select("doc_id", "h", "label", "base", "template", "phrase", F.col("start").cast("long"), "length", "share", "n_keys", (F.col("start") - F.col("at")).alias("origin")))
    return files.select("doc_id", "h", "n_words"), places


def license_labels(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases; first_word and last_word are their
    smallest and largest start, null if there are none. A template's label is given when
    all its key phrases stand at one alignment. score: the largest share of a template's
    rarity weight that stands at one alignment, 0 without any. Repeated rows stay repeated;
    null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    files, places = license_scan(docs)
    fits = places.groupBy("doc_id", "h", "template", "origin").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.countDistinct("phrase").alias("n"), F.first("n_keys").alias("n_keys"),
        F.sum("share").alias("share"), F.min("start").alias("lo"), F.max("start").alias("hi"))
    base = F.col("base")
    whole = F.when(F.col("n") == F.col("n_keys"), F.col("label"))
    each = fits.groupBy(F.col("doc_id").alias("i"), F.col("h").alias("g")).agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("lo"))).alias("first_word"), F.max(F.when(base, F.col("hi"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(whole)), ",").alias("labels"), F.least(F.max("share"), F.lit(1.0)).alias("score"))
    return files.join(each, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
