"""Tables that cut lineage: written to the folder that all executors share, read again, and deleted once nothing needs them."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error,
    as a folder of one machine would lose its files with that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files go when the statement that made them ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder. The shuffle files of the statement are deleted at its end."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.options(compression="zstd", **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made. Only for those that no result still reads, which must itself be written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
