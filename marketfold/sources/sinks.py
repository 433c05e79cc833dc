"""Writers: staging between steps, versioned full refresh, create-as, and the run log."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LOG = "run_timestamp timestamp_ntz, status string, details string"
MANIFEST = "number long, version string"


# Shuffle files of a query go as soon as it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}
_run_folders: list[str] = []
_writers: list[int] = [0]
_writers_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="marketfold-")
    return _local_folders[application]


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module wrote."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the steps of one run, removed at its end.

    What is to outlive the run must be written by a sink before the end.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    _run_folders.append(folder)
    try:
        yield folder
    finally:
        _run_folders.remove(folder)
        remove(spark, folder)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here drop their shuffle files at their end.

    Else these lie on the executors' disks until the driver happens to collect garbage, so that a run of
    many steps holds the shuffles of all of them. Steps may be written from several threads at a time.
    """
    with _writers_lock:
        _writers[0] += 1
        if _writers[0] == 1:
            _writers[1:] = [spark.conf.get(FREE_SHUFFLES, None)]
            spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _writers_lock:
            _writers[0] -= 1
            if _writers[0] == 0:
                before = _writers.pop()
                spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step once and read it back: short lineage, safe from executor loss."""
    spark = df.sparkSession
    folder = _run_folders[-1] if _run_folders else shared_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _versions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{target}/_versions")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of a refreshed target."""
    newest = _versions(spark, target).agg(F.max_by("version", F.struct("number", "version"))).first()[0]
    return spark.read.parquet(f"{target}/{newest}")


def full_refresh(df: DataFrame, target: str, partition_by: list[str] | None = None, keep: int = 2) -> DataFrame:
    """Replace the whole content of ``target``; running it again changes nothing.

    A refresh writes a version of its own beside the others, and only then names it in the manifest.
    So a job that fails leaves the content as it was, readers of the old version go on, and ``df``
    may read the target itself. All but the newest ``keep`` versions are removed. Read with ``current``.
    """
    spark = df.sparkSession
    known = _versions(spark, target).collect() if exists(spark, f"{target}/_versions") else []
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{target}/{version}")
    number = max((r["number"] for r in known), default=0) + 1
    spark.createDataFrame([(number, version)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{target}/_versions")
    for old in sorted(known, key=lambda r: (r["number"], r["version"]), reverse=True)[max(keep - 1, 0):]:
        remove(spark, f"{target}/{old['version']}")
    return current(spark, target)


def create_as(df: DataFrame, table: str, path: str | None = None, only_schema: bool = False) -> DataFrame:
    """Create or replace ``table`` from a query, or only its empty shape.

    The rows are written to a folder of their own before the name is moved to it, so ``df`` may read the
    table that it replaces, and a job that fails leaves the table as it was.
    """
    spark = df.sparkSession
    base = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}-versions"
    place = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    (df.limit(0) if only_schema else df).write.parquet(place)
    spark.sql(f"drop table if exists {table}")
    return spark.catalog.createTable(table, path=place, source="parquet", schema=df.schema)


def append_run_log(spark: SparkSession, target: str, status: str, details: str, at: str) -> DataFrame:
    """Log one (run_timestamp, status, details) row and return the log.

    The time is the key: a retry that logs the same run again changes nothing, and other
    content under a time that is taken is an error.
    """
    row = spark.range(1).select(
        F.lit(at).cast("timestamp_ntz").alias("run_timestamp"), F.lit(status).alias("status"),
        F.lit(details).alias("details"))
    if exists(spark, target):
        same = spark.read.schema(RUN_LOG).parquet(target).where(F.col("run_timestamp") == F.lit(at).cast("timestamp_ntz")).first()
        if same is not None:
            if (same["status"], same["details"]) != (status, details):
                raise ValueError(f"a run of {at} is logged already: {same['status']} {same['details']}")
            return spark.read.schema(RUN_LOG).parquet(target)
    row.write.mode("append").parquet(target)
    return spark.read.schema(RUN_LOG).parquet(target)
