"""Exact dedup: the digest index over several batches, ties, repeated rows, nulls."""

import hashlib

from hubflow.llm.exact_dedup import DigestIndex, exact_dedup
from tests.llm.conftest import ODD


def test_largest_id_stays(docs):
    got = {r["doc_id"]: r for r in exact_dedup(docs([(1, "A b"), (3, "a B"), (2, "a b"), (4, None), (5, ""), (6, "É"), (7, "é")])).collect()}
    assert [got[i]["keep_id"] for i in (1, 2, 3)] == [3, 3, 3] and [got[i]["kept"] for i in (1, 2, 3)] == [False, False, True]
    assert got[4]["keep_id"] == 5 and got[4]["group_size"] == 2
    assert got[6]["kept"] and got[7]["kept"]  # only A-Z are lower-cased
    assert got[1]["text_sha256"] == hashlib.sha256(b"a b").hexdigest()


def test_index_persists_over_batches(docs, spark):
    index = DigestIndex(spark, "digest_index_test", buckets=4)
    try:
        first = exact_dedup(docs([(1, "x"), (2, "y")]), index).collect()
        assert all(r["kept"] for r in first)
        second = {r["doc_id"]: r for r in exact_dedup(docs([(10, "X"), (11, "z"), (12, "z")]), DigestIndex(spark, "digest_index_test", buckets=4)).collect()}
        assert second[10]["seen_before"] and not second[10]["kept"] and second[10]["keep_id"] == 1
        assert second[12]["kept"] and not second[11]["kept"]
        assert index.table().count() == 3
        plan = index.table().select("digest")._jdf.queryExecution().toString()
        assert "Exchange" not in plan
    finally:
        index.drop()


def test_odd_rows(docs):
    got = exact_dedup(docs(ODD + [(4, "one")])).collect()
    assert len(got) == len(ODD) + 1
    assert {r["keep_id"] for r in got if r["text_sha256"] == hashlib.sha256(b"one").hexdigest()} == {6}
    assert exact_dedup(docs([(1, "a")]).limit(0)).collect() == []
    lone = [r for r in got if r["doc_id"] is None][0]
    assert lone["kept"] and lone["keep_id"] is None


def test_a_batch_that_died_is_run_again(docs, spark):
    """The append was done, the result never read: the same rows come out of the second run, and of a third that adds a row."""
    index = DigestIndex(spark, "digest_index_rerun", buckets=4)
    rows = [(1, "x"), (2, "y"), (3, "X")]
    try:
        exact_dedup(docs([(0, "old")]), index, "first")
        exact_dedup(docs(rows), index, "monday")
        again = {r["doc_id"]: (r["kept"], r["keep_id"], r["group_size"], r["seen_before"]) for r in exact_dedup(docs(rows + [(4, "old")]), index, "monday").collect()}
        assert again == {1: (False, 3, 2, False), 2: (True, 2, 1, False), 3: (True, 3, 2, False), 4: (False, 0, 1, True)}
        assert index.table().count() == 3
    finally:
        index.drop(files=True)


def test_the_default_index_is_removed(docs, spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup(docs([(1, "a"), (2, "A")])).where("kept").count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before
