"""Quality rules with cross-document line frequency (operator 8); DataFrame functions only.

Lines are normalised (lower case, words joined by one blank) and hashed. A line is boilerplate in its host (``source``) when more distinct
documents than the limits allow have it; equal documents count once. Boilerplate lines
are taken out, and a document that keeps too small a share of its words is rejected.

Counts are per (host, line) with partial aggregates on every mapper, so a line that a
third of all documents have is reduced before the shuffle; the join that takes lines out
has one row per boilerplate line on its other side, so its hot keys can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import stage

SPACES = r"[\x20\x09-\x0D]+"
#: A line of more documents than this, and of more than this share of its host's documents, is boilerplate.
MAX_DOCS, MAX_SHARE = 20, 0.002
#: A document that keeps a smaller share of its words is depleted.
MIN_LEFT = 0.3


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the array, the first included."""
    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.filter(F.transform(s, lambda e, k: F.when(
            (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"])), lambda x: x.isNotNull()))
        return let(F.array_sort(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

    def windows(g: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(g) - 5)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(g, i + j) for j in range(5)]))

    def count(g: Column) -> Column:
        return let(windows(g), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(w) < 5, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), count)).cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    """(host, d, pos, line, size): the lines with a word of every distinct text ``d`` of a host."""
    split = F.transform(F.split("text", "\n"), lambda x: let(words(F.lower(x)), lambda w: F.struct(F.xxhash64(w).alias("line"), F.size(w).alias("size"))))
    return (docs.select(F.col("source").alias("host"), F.md5("text").alias("d"), F.posexplode(split).alias("pos", "x"))
            .select("host", "d", "pos", "x.*").where("size > 0"))


def boilerplate_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_docs): lines that more distinct documents of a host have than both limits allow."""
    seen = _lines(docs).select("host", "line", "d").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    total = (docs.where("text is not null").select("source", F.md5("text").alias("d")).distinct()
             .groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n")))
    return (seen.join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > max_share * F.col("n"))
            .select("host", "line", "n_docs"))


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_boilerplate (words in lines taken out), kept, remaining (the text without its boilerplate lines, in line order).

    Null and empty texts have no words, so they fail the base rule; a null source is a
    host of its own. Equal rows get equal results and repeated rows stay repeated.
    kept: not base_failed and at least ``min_left`` of the words are left without
    boilerplate lines. Counts cover all documents; equal texts count once in a host.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "source")
    common = stage(boilerplate_lines(docs, max_docs, max_share), "boilerplate").select(F.col("host").alias("h"), F.col("line").alias("l"))
    out = (_lines(docs).distinct().join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
           .groupBy("host", "d").agg(F.collect_set("pos").alias("gone")))
    out = stage(out, "taken").select(F.col("host").alias("h"), F.col("d").alias("rd"), "gone")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", "source", "text", F.md5("text").alias("d"), words(text).alias("w"), F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("sym"),
                       let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    base = base.select("doc_id", "source", "text", "d", F.size("w").cast("long").alias("n_words"),
                       F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"), F.col("sym").cast("long").alias("n_symbols"),
                       F.col("dup").cast("long").alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"))
    base = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    joined = base.join(out, F.col("source").eqNullSafe(F.col("h")) & (F.col("d") == F.col("rd")), "left")
    stay = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))), lambda i: F.get(x, i)), "\n"))
    joined = joined.withColumn("remaining", F.when(F.col("gone").isNull(), F.col("text")).otherwise(stay))
    gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.col("n_words") - F.size(words(F.col("remaining")))).cast("long")
    joined = joined.withColumn("n_boilerplate", gone)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boilerplate",
                         (~F.col("base_failed") & (F.col("n_words") - F.col("n_boilerplate") >= F.lit(min_left) * F.col("n_words"))).alias("kept"), "remaining")
