"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and its Python workers; both sides hold one for each running task.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "tabloom") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the session names; without one, a temporary folder where all runs in one process."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tabloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabloom-{spark.sparkContext.applicationId}"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES for the jobs inside, unless the session names a limit of its own.

    Spark's 64 MB and 10,000 rows let one batch of texts take hundreds of MB in the executor and its worker.
    """
    if spark.conf.get(BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and continue from the written table.

    Later jobs survive lost executors, several readers share one computation, and each reads
    only the columns it needs.
    """
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this session wrote."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def balanced(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread rows evenly by key and materialise them, for work that passes over them many times."""
    spark = df.sparkSession
    width = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    return cut_lineage(df.repartition(width, *keys))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
