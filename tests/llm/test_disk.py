"""What the operators leave on disk, and lists that reach Python as arrays."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import hubflow.llm.common as C
from hubflow.llm.ngram_join import _counts, ngram_jaccard_join
from hubflow.llm.suffix_dedup import removed_spans


def shuffle_files(spark):
    """Names of the shuffle files under the session's block folders."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for folder in manager.localDirsString() for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    frame = spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 5003).alias("k")).agg(F.count("*").alias("n"))
    out = C.stage(frame, "counted")
    assert out.count() == 5003 and out.agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(C.RELEASE, "false") == "false"
    folder = out._llm_path
    C.unstage(out)
    assert not os.path.exists(folder.removeprefix("file:"))
    assert len(shuffle_files(spark) - before) < 8  # those of the sums above at most


def test_lists_of_integers_are_arrays():
    lists = pa.array([[9], [1, 2], None, [], [3, 4, 5]], pa.list_(pa.int64())).slice(1)
    got = C._cells(lists)
    assert [None if g is None else g.tolist() for g in got] == [[1, 2], None, [], [3, 4, 5]] and isinstance(got[0], np.ndarray)
    assert C._cells(pa.array([[1, None]])) == [[1, None]] and C._cells(pa.array([b"x", None])) == [b"x", None]


def test_counts_of_heads_and_first_prefixes(spark):
    rows = [(b"a", 10, [1, 2, 3, 4]), (b"b", 10, [2, 3, 5, 1]), (b"c", 20, [3, 9, 8, 7])]
    got = {r["s"]: (r["m"], r["first"]) for r in _counts(spark.createDataFrame(rows, "k binary, n long, head array<long>"), 80).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (3, 3)}  # the 1-prefix of ten shingles has three, that of twenty five


def test_operators_release_their_sketches(spark, monkeypatch):
    made, gone = [], []
    plain = C.membership_sketch

    def sketch(*args, **kw):
        made.append(plain(*args, **kw))
        return made[-1]
    import hubflow.llm.ngram_join as J
    import hubflow.llm.suffix_dedup as S
    for module in (J, S):
        monkeypatch.setattr(module, "membership_sketch", sketch)
        monkeypatch.setattr(module, "release", lambda *s: (gone.extend(x for x in s if x is not None), C.release(*s)))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:50] + [f"x{i}"] + words[50:])) for i in range(6)] + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in ngram_jaccard_join(docs, 3, 60).collect()} == {0, 9}
    assert removed_spans(docs).count() == 5
    assert made and {id(x) for x in made} == {id(x) for x in gone}


def test_tasks_follow_the_rows(spark):
    """Labels of a few rows are written by a few tasks, however many partitions a shuffle has."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = C.stage(spark.range(500).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 50 < 49, 1).otherwise(0)).alias("b")), "edges")
        cores = spark.sparkContext.defaultParallelism
        assert C.tasks_for(edges) == cores and C.tasks_for(C.stage(spark.range(C.TASK_ROWS * cores + 1), "rows")) == cores + 1
        labels = C.min_labels(edges)
        assert {(r["v"], r["c"]) for r in labels.collect()} == {(v, v - v % 50) for v in range(500)}
        assert len({f for f in labels.inputFiles()}) <= cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_batches_to_python_are_small(spark):
    held = spark.conf.get(C.ARROW)
    out = C.stage(C.map_rows(spark.range(0, 5000, 1, 1), lambda cols: ((len(cols["id"]), x) for x in cols["id"]), "n long, x long"), "batches", 1)
    assert out.agg(F.max("n"), F.countDistinct("x")).first()[:] == (C.ARROW_ROWS, 5000) and spark.conf.get(C.ARROW) == held


def test_sketch_of_keys_that_repeat(spark):
    keys = spark.range(3000).select((F.col("id") % 1000 * 7919).alias("x")).union(spark.sql("select cast(null as long)"))
    for unique in (False, True):
        sketch = C.membership_sketch(keys, F.col("x"), unique=unique)
        assert C.sketch_test(sketch.value, np.arange(1000) * 7919).all() and not C.sketch_test(sketch.value, np.arange(1000) * 7919 + 1).any()
        C.release(sketch)
