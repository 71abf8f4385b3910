"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
From the first stage on the session deletes the shuffle files of each execution at its end,
so a stage's disk doesn't hold what the ones before have moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels of the documents at hand."""
    from hubflow.llm.common import release_shuffles
    from hubflow.llm.toxicity import drop_toxic
    release_shuffles(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    from hubflow.llm.exact_dedup import exact_dedup
    return _without(docs, exact_dedup(docs).select("doc_id", F.col("kept").alias("stays")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays."""
    from hubflow.llm.ngram_join import ngram_jaccard_join
    return _without(docs, ngram_jaccard_join(docs, n=5, threshold_pct=80).select("doc_id", F.expr("doc_id <=> component_id").alias("stays")))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier are cut from the texts; n_chars follows."""
    from hubflow.llm.suffix_dedup import remove_repeats
    return remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become sequences of at most 2048 ids."""
    import public_tokenizers
    from hubflow.llm.packing import pack
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id was decided against (doc_id, stays); of rows that repeat an id one stays. Rows without an id stay."""
    from hubflow.llm.common import stage
    ids = stage(decided.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("stays").alias("_stays"), F.count("*").alias("_n")), "decided")
    out = docs.join(ids.where("not _stays or _n > 1").select("_id"), F.col("doc_id") == F.col("_id"), "left_anti")
    again = ids.where("_stays and _n > 1").select("_id")
    if again.limit(1).count():
        out = out.unionByName(docs.join(again, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"]))
    return out


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("suffix-array dedup", repeats_stage), ("best-fit packing", packing_stage)]

#: A classifier and byte-wise removal have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    from hubflow.llm.common import stage
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
