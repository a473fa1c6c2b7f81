"""Session helpers: one place for the settings the library depends on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Chains of jobs that run at once. Each is a chain of small jobs, which alone leave a cluster idle.
AT_ONCE = 4


def build_session(app_name: str = "keyfold", cpus: str | int = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """Local session for tests and the bench. On a cluster, pass your own session to the library."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: the one the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a fresh temporary folder; on a cluster a
    machine-local folder would not be readable from other hosts, so its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="keyfold-stage-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other stage has."""
    return f"{stage_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, by: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions, so that the stage has as many files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


# Removes what a statement has shuffled as soon as it ends; else the files stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS: dict[str, tuple[int, str | None]] = {}
_WRITERS_LOCK = threading.Lock()


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Statements that are run and done with, as writes are, leave no shuffle files behind. The setting holds while
    any thread writes and is then as before, so that frames which the caller runs keep theirs."""
    at = spark.sparkContext.applicationId
    with _WRITERS_LOCK:
        writers, before = _WRITERS.get(at, (0, None))
        if not writers:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITERS[at] = (writers + 1, before)
    try:
        yield
    finally:
        with _WRITERS_LOCK:
            writers, before = _WRITERS[at]
            _WRITERS[at] = (writers - 1, before)
            if writers == 1:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def write_stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a parquet stage table and read it back.

    A written stage cuts the lineage, survives the loss of executors, and unlike a persisted or
    checkpointed row set is columnar, so each later step reads just the columns it uses.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    with freeing_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` as a stage table in buckets of ``key``, sorted by it, and read it back.

    Such tables join each other on ``key`` without a shuffle, which their rows have behind them; there are
    as many buckets as shuffle partitions. For keys that few rows share, such as ids: a value's rows are in
    one bucket. Rows that come in these partitions already are written as they are.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freeing_shuffles(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def run_all(spark, tasks: Sequence[Callable], at_once: int = AT_ONCE) -> list:
    """Run jobs from a bounded pool of threads, under the caller's job group and one scheduler pool
    each; results in order. The first failure is raised."""
    def pooled(number: int, task: Callable):
        def work():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"at-once-{number % at_once}")
            return task()
        return inheritable_thread_target(spark)(work)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        waiting = [pool.submit(pooled(i, task)) for i, task in enumerate(tasks)]
        return [w.result() for w in waiting]
