"""Stage boundaries: written tables in the shared folder the session names.

The text stage is costly (regular expressions over every sentence) and feeds several windows and
joins. Writing its compact output once keeps those column-pruned, cuts the lineage, and survives the
loss of executors. The folder comes from `spark.checkpoint.dir`; only a local session without one
gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="helmline-")
    return _local[app]


def stage(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write `df` as a table under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/helmline-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete the stage tables this application has written. Results read from them must be saved first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
