"""Quality by weak supervision: rules vote or abstain, expectation-maximisation finds how far each can be trusted.

Every rule looks at a document and votes good (1), bad (0) or nothing (-1). Documents with equal votes are alike to the
model, so the counts of vote patterns (at most three to the power of the rules) are all that the expectation-maximisation
needs: each round is one aggregate over that table. A document is kept if it passes the fixed base rule and its posterior
probability of being good is at least a half. Built-in functions only.

Null and empty texts have zero counts and fail the base rule. Repeated rows and null ids come out row by row; other
columns are not read; an empty table gives an empty result. Repeated 3-word windows are told by 64-bit hashes within
one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helmline.llm.common import staged

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
ROUNDS = 40
#: Accuracies stay in this range, so that good and bad cannot change places.
ACCURACY = (0.55, 0.98)


def features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each document, all from its own text."""
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    bare = F.col("text")
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    plain = F.col("text")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    rows = rows.select(
        "doc_id", F.length(bare).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(plain)).cast("bigint").alias("n_symbols"),
        F.rtrim("text").rlike(r"[.!?…\"')\]]\z").alias("ends_well"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "ends_well", F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.when(F.size("words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        )).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    rows = rows.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # Of equal neighbours in the order of hashes, each is a window found twice; their places, in order again.
    rows = rows.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.filter(F.transform(
        "sorted", lambda s, k: F.when(
            (F.get("sorted", k + 1).h == s.h) | ((k > 0) & (F.get("sorted", k - 1).h == s.h)), s.i)),
        lambda i: i.isNotNull()))))
    covered = F.aggregate(F.transform(
        "places", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_lines", "n_distinct", "ends_well")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """The votes of each rule over the columns of features()."""
    n = F.greatest("n_words", F.lit(1))
    symbols, mean = F.col("n_symbols") / n, F.col("word_chars") / n
    repeated, varied = F.col("n_repeat_words") / n, F.col("n_distinct") / n
    dup = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    return {
        "long_enough": _vote(F.col("n_words") >= 80, F.col("n_words") < 20),
        "few_symbols": _vote(symbols < 0.02, symbols > 0.1),
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 14)),
        "few_repeats": _vote(repeated < 0.2, repeated > 0.4),
        "few_dup_lines": _vote((dup < 0.1) & (F.col("n_lines") > 1), dup > 0.3),
        "varied_words": _vote((varied > 0.25) & (F.col("n_words") >= 20), (varied < 0.1) & (F.col("n_words") >= 20)),
        "ends_well": _vote(F.col("ends_well"), F.lit(False)),
    }


def _posterior(names: list[str], prior: float, accuracy: list[float]) -> Column:
    good, bad = F.lit(prior), F.lit(1 - prior)
    for name, a in zip(names, accuracy):
        vote = F.col(name)
        good = good * F.when(vote == 1, a).when(vote == 0, 1 - a).otherwise(1.0)
        bad = bad * F.when(vote == 0, a).when(vote == 1, 1 - a).otherwise(1.0)
    return good / (good + bad)


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """The prior of good and the accuracy of each rule. votes: one row per document, a column per rule."""
    patterns = staged(votes.groupBy(*names).agg(F.count("*").alias("n")))
    prior, accuracy = 0.8, [0.8] * len(names)
    for _ in range(rounds):
        q = _posterior(names, prior, accuracy)
        sums = patterns.withColumn("q", q).agg(
            F.sum(F.col("n") * F.col("q")), F.sum("n"),
            *(F.sum(F.when(F.col(x) == 1, F.col("n") * F.col("q")).when(F.col(x) == 0, F.col("n") * (1 - F.col("q"))))
              for x in names),
            *(F.sum(F.when(F.col(x) >= 0, F.col("n"))) for x in names)).first()
        if not sums[1]:
            break
        k = len(names)
        # Ten documents stand for the starting values, so that a rule that seldom votes keeps them.
        new = [((right or 0.0) + 8) / ((n or 0) + 10) for right, n in zip(sums[2:2 + k], sums[2 + k:])]
        new = [min(max(a, ACCURACY[0]), ACCURACY[1]) for a in new]
        moved = max(abs(a - b) for a, b in zip([*new, (sums[0] + 8) / (sums[1] + 10)], [*accuracy, prior]))
        prior, accuracy = (sums[0] + 8) / (sums[1] + 10), new
        if moved < 1e-6:
            break
    return prior, accuracy


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Counts, votes, `quality` (posterior probability of good), base_failed and kept of each document."""
    votes = rules()
    names = [f"vote_{x}" for x in votes]
    rows = staged(features(df, doc_id, text).select("*", *(v.alias(f"vote_{x}") for x, v in votes.items())))
    prior, accuracy = fit(rows, names)
    return rows.withColumn("quality", F.round(_posterior(names, prior, accuracy), 6)).withColumn(
        "base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
