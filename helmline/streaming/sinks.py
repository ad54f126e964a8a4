"""What streams leave behind: the latest row per stream, kept by idempotent upserts, and completions joined as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(bucket, version) of the newest committed version of each bucket, of batches before the given one."""
    if not _exists(spark, f"{path}/manifest"):
        return None
    d = spark.read.schema("bucket int, version long").parquet(f"{path}/manifest")
    if before is not None:
        d = d.where(F.col("version") < before)
    return d.groupBy("bucket").agg(F.max("version").alias("version"))


def _rows(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """The rows of the given versions. There are no more of them than buckets, so they are broadcast."""
    return spark.read.parquet(f"{path}/data").join(F.broadcast(current), ["bucket", "version"], "left_semi")


def keep_latest(path: str, order: str = "seq", key: str = "stream_id", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the row with the largest `order` of each key in the table at `path`.

    A batch rewrites the buckets it touches as a new version, named by the batch, and then commits them in a manifest. It
    starts from versions of batches before it, so a batch that is killed or repeated leaves the same table. Rows of a key
    that are equal in `order` are told apart by nothing: they have to be equal.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = rows.select("bucket").distinct()
        current = _current(spark, path, batch_id)
        if current is not None and _exists(spark, f"{path}/data"):
            held = _rows(spark, path, current.join(touched, "bucket", "left_semi"))
            rows = rows.select("bucket", *columns).unionByName(held.select("bucket", *columns))
        newest = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*columns), order).alias("row"))
        data = newest.select("row.*", F.lit(batch_id).cast("long").alias("version"), "bucket")
        _write(data.repartition("bucket"), f"{path}/data", ["version", "bucket"])
        done = spark.read.parquet(f"{path}/data").where(F.col("version") == batch_id).select("bucket").distinct()
        _write(done.select(F.col("bucket").cast("int").alias("bucket"), F.lit(batch_id).cast("long").alias("version")).coalesce(1),
               f"{path}/manifest", ["version"])

    return upsert


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that `keep_latest` keeps: one row per key, of committed batches only."""
    return _rows(spark, path, _current(spark, path)).drop("bucket", "version")


def follow_latest(rows: DataFrame, path: str, checkpoint: str, order: str = "seq", key: str = "stream_id"):
    """The stream `rows` upserted into the table at `path`, up to what is there now."""
    return rows.writeStream.foreachBatch(keep_latest(path, order, key)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- completions ----------------------------------------------------------------------------------
def with_completions(asked: DataFrame, completions: DataFrame, identity: tuple[str, str, str], patience: str = "1 hour",
                     lateness: str = "10 minutes") -> DataFrame:
    """(stream_id, seq, input_hash, job_id, result): each asked record with the completions that come within `patience`.

    asked: stream_id, seq, input_hash, asked_at; completions: the columns of the batch selection and completed_at. Both
    may come up to `lateness` out of order. The state of both sides ends with the watermark; a record whose patience is
    over without a completion comes out with nulls. Past rows are never revised.
    """
    name, version, rules = identity
    mine = completions.where(
        (F.col("status") == "completed") & F.col("result").isNotNull() & (F.col("classifier") == name)
        & (F.col("classifier_version") == version) & (F.col("classifier_hash") == rules)).select(
        F.col("stream_id").alias("c_stream"), F.col("source_seq").alias("c_seq"), F.col("input_hash").alias("c_hash"),
        "job_id", "result", "completed_at").withWatermark("completed_at", lateness)
    asked = asked.select("stream_id", "seq", "input_hash", "asked_at").withWatermark("asked_at", lateness)
    same = (F.col("stream_id") == F.col("c_stream")) & (F.col("seq") == F.col("c_seq")) & (F.col("input_hash") == F.col("c_hash"))
    within = (F.col("completed_at") >= F.col("asked_at")) & (F.col("completed_at") <= F.col("asked_at") + F.expr(f"interval {patience}"))
    return asked.join(mine, same & within, "left_outer").select("stream_id", "seq", "input_hash", "job_id", "result")


def selected(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, errors) of what `with_completions` has written, as the batch selection gives them."""
    per = joined.groupBy("stream_id", "seq", "input_hash").agg(
        F.count("job_id").alias("n"), F.min_by(F.struct("job_id", "result"), "job_id").alias("c"))
    good = per.where("n = 1").select("stream_id", "seq", "c.job_id", "c.result")
    bad = per.where("n <> 1").select(
        "stream_id", "seq", F.when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("problem"), F.col("n").alias("matches"))
    return good, bad
