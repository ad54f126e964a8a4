"""Small inputs that the tests of the operators share."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """rows: (doc_id, text) pairs; the other columns hold nulls or plain values in turn."""
    return spark.createDataFrame(
        [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else "src", None if t is None else len(t))
         for k, (i, t) in enumerate(rows)], DOCUMENTS)
