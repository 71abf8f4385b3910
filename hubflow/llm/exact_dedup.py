"""Exact dedup against a persistent digest index (operator 6).

The index is a parquet table with one row per distinct text, bucketed and sorted by
digest. A batch is reduced to one row per digest before anything meets (partial
aggregates collapse a hot digest on every mapper), anti-joined with the index by a
sort-merge join on the bucketed digest (no exchange on the index side), and the new
rows are appended. Documents then read their decision back from the index; a hot digest
on the document side is split by the skew-join rule, as the other side has one row per digest.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm.common import delete_path, id_text, map_rows, stage
from hubflow.session import ensure_checkpoint_dir

BUCKETS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class DigestIndex:
    """A bucketed, sorted digest table at ``path``; reopened by giving the same name and path again.

    Columns: digest (SHA-256 of the text with A-Z lower-cased, 32 bytes), keep_id,
    group_size (rows of the batch that brought the digest), batch.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name = spark, name
        self.path = path = path or f"{ensure_checkpoint_dir(spark)}/llm-{name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add the digests (doc_id, digest) that the index has not seen; of equal ones the largest doc_id stays (null only if all are null)."""
        new = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        fresh = new.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh.withColumn("batch", F.lit(batch)).write.insertInto(self.name)

    def drop(self, files: bool = False) -> None:
        """Take the table out of the catalog; its files stay unless ``files``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            delete_path(self.spark, self.path)


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of every whole text with A-Z lower-cased, in UTF-8; null counts as empty."""
    def rows(cols):
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            yield doc_id, hashlib.sha256((text or b"").translate(_LOWER)).digest()

    return map_rows(id_text(docs), rows, "doc_id long, digest binary", rows=20_000)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, seen_before; the index grows by the new texts.

    Texts are equal when identical after lower-casing A-Z; null equals empty. Of equal
    texts in the batch the row with the largest doc_id stays; if the index knew the text
    before this batch, none stays, keep_id is the index's and seen_before is true.
    group_size counts the batch's equal rows. A null doc_id is kept only if its text has
    no row with an id. Of repeated rows that are equal in doc_id and text all carry the
    same decision; extra columns are ignored. An empty table gives an empty result.

    A job that died may be run again under the same name ``batch``: digests that it has
    already added are its own, so the result is that of one run. Without an index an empty
    one is made for the call and removed again.
    """
    batch = batch or uuid.uuid4().hex
    if index is None:
        index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
        try:
            return stage(_decide(docs, index, batch), "deduped")
        finally:
            index.drop(files=True)
    return _decide(docs, index, batch)


def _decide(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    digests = stage(text_digests(docs), "digests")
    sizes = digests.groupBy("digest").agg(F.count("*").alias("n"))
    index.append(digests, batch)
    decided = index.table().select("digest", "keep_id", "group_size", "batch")
    own = decided.where(F.col("batch") == batch)
    old = decided.where(F.col("batch") != batch).join(sizes, "digest").select("digest", "keep_id", F.col("n").alias("group_size"), "batch")
    known = own.unionByName(old)
    return digests.join(known, "digest").select(
        "doc_id", "keep_id", "group_size",
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), (F.col("batch") != batch).alias("seen_before"))
