"""Registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm import sqltext

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_ngram_jaccard")
def op1(spark, sf_dir):
    from hubflow.llm.ngram_join import ngram_jaccard_join
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold_pct=90).select("doc_id", "n_shingles", "component_id")


@query("op2_license_scan")
def op2(spark, sf_dir):
    from hubflow.llm.license_scan import license_labels
    return license_labels(table(spark, sf_dir, "documents"))


@query("op6_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)""")
def op6(spark, sf_dir):
    from hubflow.llm.exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_quality_rules")
def op8(spark, sf_dir):
    from hubflow.llm.quality_rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("remaining_sha256", F.sha2("remaining", 256)).drop("remaining")


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    import public_tokenizers
    from hubflow.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


@query("op5_toxicity")
def op5(spark, sf_dir):
    from hubflow.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_url_filter")
def op7(spark, sf_dir):
    from hubflow.llm.url_filter import url_verdicts
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    from hubflow.llm.suffix_dedup import repeat_report
    return repeat_report(table(spark, sf_dir, "documents"), 100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    import public_tokenizers
    from hubflow.llm.sentencepiece_viterbi import encoding_report
    return encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: The conversation that the contract adds.
CONTROL = r"\### Assistant: </turn> ok"


@query("op9_chat_format")
def op9(spark, sf_dir):
    from hubflow.llm.chat_format import chat_report
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_report(turns.unionByName(extra))


@query("op13_byte_bpe")
def op13(spark, sf_dir):
    import public_tokenizers
    from hubflow.llm.byte_bpe import encoding_report
    return encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_conversation_trie", sqltext.TRIE)
def op11(spark, sf_dir):
    from hubflow.llm.conversation_trie import conversation_trie
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_merkle_manifest", sqltext.MERKLE)
def op12(spark, sf_dir):
    from hubflow.llm.merkle_manifest import tampering_report
    return tampering_report(table(spark, sf_dir, "documents"))
