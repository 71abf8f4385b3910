"""Session helpers: a tuned local session for tests and a checkpoint-dir guard."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale.  AQE coalesces tiny shuffles on local runs and
# splits skewed partitions on a cluster; the broadcast threshold stays at the
# Spark default so only provably small sides (hub tables, parameter rows) go out.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above ~8 KB of bytecode are never JIT-compiled by the
    # JVM; wide derived-column plans are split into smaller operators instead
    # of running one huge method in the interpreter.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def small_methods(spark: SparkSession) -> None:
    """Set the method limit of ``RECOMMENDED_CONF`` for this session, whoever made it: the wide trip view is interpreted without it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > int(RECOMMENDED_CONF[key]):
        spark.conf.set(key, RECOMMENDED_CONF[key])


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "hubflow") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that wins.
    Only a local-mode session without one (tests) gets a fresh temporary
    folder — a machine-local folder is never used on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running "
                           "iterative graph operators on a cluster")
    path = tempfile.mkdtemp(prefix="hubflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (survives executor loss).

    The frame is persisted first: a reliable checkpoint writes its files in a
    second job after the first one computed the rows, and without the cache
    that second job would recompute the whole plan.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def write_table(df: DataFrame, label: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared checkpoint folder and read back, and the folder it is in (for ``drop_table``)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by ``write_table`` that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize_round(df: DataFrame, round_no: int, flag: str | None = None, every: int = 4,
                      previous: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Materialise the state of one loop round with a single job.

    Every ``every``-th round the state goes to the reliable checkpoint folder
    (short lineage, survives executor loss); in between it is persisted
    (memory and disk) and a lost block is recomputed from the last checkpoint.
    Returns the state and the number of rows with ``flag`` set (0 if no flag).
    """
    from pyspark import StorageLevel
    if round_no % every == 0:
        df = cut_lineage(df)
        n = df.filter(flag).count() if flag else 0
    else:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        n = df.agg(F.count_if(F.col(flag)) if flag else F.count(F.lit(1))).first()[0]
        n = n if flag else 0
    if previous is not None and previous.is_cached:
        previous.unpersist()
    return df, int(n or 0)


def ship_code(spark: SparkSession) -> None:
    """Let the Python workers import this library: its code goes along with the job (once per context)."""
    sc = spark.sparkContext
    if not getattr(sc, "_hubflow_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        sc.addPyFile(shutil.make_archive(f"{sc._temp_dir}/hubflow_lib", "zip", root, "hubflow"))
        sc._hubflow_shipped = True
