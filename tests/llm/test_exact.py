"""Groups of equal texts against a dictionary of whole contents."""

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from helmline.llm import exact
from tests.llm.helpers import documents


def expected(rows):
    """(id, keep_id, size, kept, digest) of each row; of rows with the winning id only one stays."""
    held = defaultdict(list)
    for i, t in rows:
        held[t or ""].append(i)
    out = []
    for t, ids in held.items():
        keep, left = max((i for i in ids if i is not None), default=None), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left > 0, sha256(t.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in exact.deduplicate(df, **more).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (9, "a"), (9, "a"), (5, "A"), (None, "a"), (None, "lone"),
       (None, "twice"), (None, "twice"), (6, "é"), (7, "é"), (8, "x" * 3_000_000), (10, "x" * 3_000_000), (11, "a\n")]


def test_odd_rows(spark):
    assert found(documents(spark, ODD).repartition(5)) == expected(ODD)


def test_a_third_of_the_rows_is_one_text(spark):
    rows = [(i, "one text" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)] + [(17, "one text")] * 40 + [(3000, "one text")] * 60
    assert found(documents(spark, rows).repartition(23)) == expected(rows)


@pytest.mark.parametrize("digest", [lambda x: F.length(x), lambda x: F.substring(x, 1, 1), lambda x: F.lit(1)])
def test_texts_that_share_a_digest_stay_apart(spark, digest):
    rows = ODD + [(20 + i, f"{i % 9} {i % 4}") for i in range(200)]
    assert found(documents(spark, rows).repartition(7), digest=digest) == expected(rows)


def test_clashing_columns_and_empty_table(spark):
    df = documents(spark, ODD)
    for name in ("id", "row", "salt", "digest", "keep_id", "own_digest", "n", "top"):
        df = df.withColumn(name, F.lit(1))
    assert found(df) == expected(ODD)
    assert exact.deduplicate(df.limit(0)).count() == 0


def test_rows_that_move_do_not_grow_with_copies(spark):
    """A task hands on one row of a text, however many copies it holds."""
    rows = documents(spark, [(i, "same") for i in range(4000)]).repartition(4).select(
        F.col("doc_id").alias("id"), F.lit("d").alias("digest"), "text")
    plan = exact.groups(rows, 4)._jdf.queryExecution().executedPlan()
    assert "partial_max" in plan.toString() and "SortAggregate" not in plan.toString()
