"""Reading tables, cutting lineage, and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="marketfold-llm-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends at its files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """As ``save``, dealt into one bucket of ``by`` per shuffle partition: grouping by it moves no row.

    Only tables can be bucketed; the name goes at once, its files and the plan over them stay.
    """
    spark, path, known = df.sparkSession, fresh_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(known)
    found = spark.table(known)
    spark.sql(f"drop table {known}")
    return found


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id="doc_id", text="text"):
    """The identity of a document: its id, or the hash of its text where that is null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def crc_of_id(doc_id="doc_id"):
    """crc32 of the id written as text; that of the empty text where the id is null."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
