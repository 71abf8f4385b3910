"""Shared helpers: tables written to the shared folder, id sketches of fixed size, connected labels."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from hubflow.session import ensure_checkpoint_dir


#: Rows to a task of a written table whose rows are counted, and rows that go to Python at once (each may hold two sets).
TASK_ROWS, ARROW_ROWS = 8192, 1024
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Spark's setting that deletes the shuffle files of an execution at its end, instead of when the driver happens to collect garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release_shuffles(spark: SparkSession) -> None:
    """From now on the session deletes shuffle files at the end of each execution; a frame that is executed again shuffles again."""
    spark.conf.set(RELEASE, "true")


def tasks_for(*tables: DataFrame) -> int:
    """As many tasks as the rows of the written ``tables`` need, one for each core at least: partitions of a few rows cost more than their rows."""
    rows = max(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def stage(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads the files. ``unstage`` removes
    the files of a table that nothing reads any more. The shuffle files of the
    write are deleted when it is done: nothing reads them again. ``tasks`` is the most
    tasks that write; with it batches to Python have ``ARROW_ROWS`` rows at most.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    before, batch = spark.conf.get(RELEASE, "false"), spark.conf.get(ARROW)
    spark.conf.set(RELEASE, "true")
    spark.conf.set(ARROW, str(min(int(batch), ARROW_ROWS) if int(batch) > 0 else ARROW_ROWS) if tasks else batch)
    try:
        (df.coalesce(tasks) if tasks else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
        spark.conf.set(ARROW, batch)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``stage``; the frames must not be used afterwards."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            delete_path(df.sparkSession, path)


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this library: its code goes along with the job (once per context)."""
    sc = spark.sparkContext
    if not getattr(sc, "_llm_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        sc.addPyFile(shutil.make_archive(f"{sc._temp_dir}/hubflow_code", "zip", root, "hubflow"))
        sc._llm_shipped = True


def id_text(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null stays null) and ``extra`` columns; other columns are ignored."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *extra)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str, rows: int = 512, arrays: bool = False) -> DataFrame:
    """Apply ``fn(dict of column lists) -> iterator of output tuples`` batch by batch (Arrow transfer).

    Outputs are sent on every ``rows`` tuples, so memory follows the batch and not the partition.
    With ``arrays`` a cell that is a list of integers is a numpy array (a view, not to be written to).
    """
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes // (8 << 20)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for row in fn({n: (_cells if arrays else pa.Array.to_pylist)(part.column(i)) for i, n in enumerate(part.schema.names)}):
                    out.append(row)
                    if len(out) >= rows:
                        yield _batch(out, arrow)
                        out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _cells(column: pa.Array) -> list:
    """The cells as Python values, lists of integers as numpy arrays."""
    if not (pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type)) or column.values.null_count:
        return column.to_pylist()
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[a:b] if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_pylist())]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


SKETCH_BITS = 26
_PARTS = 64


def membership_sketch(keys: DataFrame, key: Column, bits: int = SKETCH_BITS, unique: bool = False):
    """Broadcast bitmap of 2**bits bits with the bit of every key set.

    A key that is in ``keys`` always tests positive; others pass with the share of bits
    set. The size is fixed (8 MB at 26 bits), whatever the number of keys: it only saves
    shuffled rows before an exact join, it never decides a result.
    ``key`` must be a long with well spread low bits (a hash, or a dense id);
    ``sketch_test`` tests numpy arrays of the same longs. The bitmap is built in
    ``_PARTS`` parts; the driver only puts the parts together. Keys that hardly repeat
    (``unique``) move once, others are made distinct first.
    """
    low = keys.select(key.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("x"))
    low = low if unique else low.distinct()
    words = (1 << (bits - 6)) // _PARTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.unique(x % _PARTS).tolist():
                at = x[x % _PARTS == part] // _PARTS
                table = parts.setdefault(part, np.zeros(words, np.uint64))
                np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([t.tobytes() for t in parts.values()], pa.binary())], ["part", "bits"])

    ship_package(keys.sparkSession)
    table = np.zeros((_PARTS, words), np.uint64)
    for row in low.where("x is not null").repartition(_PARTS // 4, F.col("x") % _PARTS).coalesce(_PARTS // 4).mapInArrow(build, "part long, bits binary").collect():
        table[row["part"]] |= np.frombuffer(row["bits"], np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def release(*sketches) -> None:
    """Delete the copies of sketches (8 MB on each machine) that no unwritten frame reads any more."""
    for sketch in sketches:
        if sketch is not None:
            sketch.destroy()


def sketch_test(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(table.size * 64 - 1)
    at = low // np.uint64(_PARTS)
    return ((table[(low % np.uint64(_PARTS)).astype(np.int64), (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def min_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): every vertex ``v`` with the smallest vertex of its component as ``c``.

    Label propagation with pointer jumping; every round is written to the shared
    folder. Raises if it has not converged after ``max_rounds``.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    tasks = tasks_for(both)
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels", tasks)
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("v")).select("a", "c").coalesce(tasks).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        step = stage(step, "labels", tasks)
        up = step.select(F.col("v").alias("u"), F.col("c").alias("cc"))
        nxt = stage(step.join(up, F.col("c") == F.col("u"), "left")
                    .select("v", F.least("c", F.coalesce("cc", "c")).alias("c"), "old"), "labels", tasks)
        moved = nxt.where("c <> old").limit(1).count()
        unstage(labels, step)
        labels = nxt
        if not moved:
            unstage(both)
            return labels.select("v", "c")
    raise RuntimeError(f"components have not converged after {max_rounds} rounds")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
