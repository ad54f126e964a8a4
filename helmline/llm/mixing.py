"""Mixing sources to target weights: raking token weights to source, language and topic marginals, then sampling.

Documents are counted into cells of (source, language, topic). Raking multiplies the weight of each cell by target over
current share, margin after margin, until all three margins hold; only the table of cells takes part. The sampling
probability of a document is its cell's weight times one scale, at most 1; the scale makes the expected tokens a given
share of all. A document is drawn by a hash of its id, so that a run can be repeated. Built-in functions only.

Targets are shares by value for each margin; a margin without given targets takes its own shares to a power. How far the
worst margin still is from its target after the last round comes out as `residual`: margins can contradict each other.

Nulls in source or language are a value of their own (''). Null ids are drawn like id ''. Texts without words have no
tokens: their weight counts nothing, and they are drawn like the rest of their cell. Each row is drawn by the probability
of its own cell; rows of one id in one cell are drawn together. An empty table gives an empty result. The tables have no
topics, so the form of the text stands in for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from helmline.llm.common import staged

MARGINS = ("source", "lang", "topic")
#: Target share of a value: its share of the tokens to this power, normalised. 1 leaves a margin as it is.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
SHARE = 0.6
SWEEPS = 3
ROUNDS = 12
CLOSE = 1e-6
#: Cells up to which their probabilities are broadcast to the documents; beyond, they are dealt out by salt.
BROADCAST_CELLS = 200_000
SALTS = 64


def topic(words: Column, text: Column) -> Column:
    """The form of a text: lines, symbols, short or prose."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(words < 100, "short").when(lines * 40 > words, "lines").when(words > 1500, "long").otherwise("prose")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def features(doc_id: str, text: str, source: str, lang: str) -> dict[str, Column]:
    """source, lang, n_tokens and topic of a document; a token is a word."""
    held = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    words = count_words(held)
    return {"doc_id": F.col(f"`{doc_id}`"), "source": F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")),
            "lang": F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")), "n_tokens": words, "topic": topic(words, held)}


def described(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, n_tokens, topic) of each document."""
    found = features(doc_id, text, source, lang)
    rows = df.select(found["doc_id"].alias("doc_id"), found["source"].alias("source"), found["lang"].alias("lang"),
                     found["n_tokens"].alias("n_tokens"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("held"))
    return rows.select("doc_id", "source", "lang", "n_tokens", topic(F.col("n_tokens"), F.col("held")).alias("topic"))


def powered(cells: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    """Target shares (value, target) of each margin from its own shares."""
    out = {}
    for m in MARGINS:
        sums = cells.groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), powers[m]).alias("mass"))
        total = sums.agg(F.sum("mass")).first()[0] or 1.0
        out[m] = sums.select("value", (F.col("mass") / total).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`, so that weighted token shares are the targets, and `residual`.

    A value without a target keeps its share of weight among the rest. Stops when no margin is off by more than CLOSE;
    residual is how far the worst one was off in the last round.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    held = cells.withColumn("weight", F.lit(1.0))
    for m in MARGINS:
        t = targets[m].select(F.col("value").alias(m), F.col("target").alias(f"target_{m}"))
        held = held.join(t, m, "left")
    held, worst = staged(held), 0.0
    for _ in range(rounds):
        off = F.lit(0.0)
        for sweep in range(sweeps):
            for m in MARGINS:
                now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m)) / total
                held = held.withColumn("now", now)
                if sweep == sweeps - 1:
                    off = F.greatest(off, F.abs(F.coalesce(F.col(f"target_{m}"), F.col("now")) - F.col("now")))
                    held = held.withColumn("off", off)
                    off = F.col("off")
                held = held.withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.coalesce(
                    F.col(f"target_{m}") / F.col("now"), F.lit(1.0))).otherwise(F.col("weight"))).drop("now")
        held = staged(held)
        worst = held.agg(F.max("off")).first()[0]
        held = held.drop("off")
        if worst is None or worst < CLOSE:
            break
    return held.select(*MARGINS, "tokens", "weight", F.lit(float(worst or 0.0)).alias("residual"))


def scale(cells: DataFrame, share: float) -> float:
    """c such that the tokens times min(1, c * weight) are the share of all tokens (or everything that has weight)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    c = share
    for _ in range(50):
        full = F.col("weight") * c >= 1
        over, rest = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double"),
            F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if not rest:
            break
        new = max(c, (share * total - over) / rest)
        if new - c < 1e-12:
            break
        c = new
    return c


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that only the id decides."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def chances(cells: DataFrame, share: float, powers: dict[str, float], targets: dict[str, DataFrame] | None) -> DataFrame:
    """(source, lang, topic, weight, probability, residual) of each cell."""
    raked = rake(cells, powered(cells, powers) | (targets or {}))
    return raked.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * scale(raked, share)).alias("probability"), "residual")


def with_chance(rows: DataFrame, chance: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their cell's row in chance; by: the names of the margins in rows."""
    held = chance.select(*(F.col(m).alias(f"cell_{m}") for m in MARGINS), *(F.col(c) for c in chance.columns if c not in MARGINS))
    same = [rows[b].eqNullSafe(held[f"cell_{m}"]) for b, m in zip(by, MARGINS)]
    gone = [f"cell_{m}" for m in MARGINS]
    if chance.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(held), same).drop(*gone)
    held = held.withColumn("cell_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("row_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    met = [salted[b].eqNullSafe(held[f"cell_{m}"]) for b, m in zip(by, MARGINS)]
    return salted.join(held, [*met, salted["row_salt"] == held["cell_salt"]]).drop(*gone, "cell_salt", "row_salt")


def probabilities(df: DataFrame, share: float = SHARE, powers: dict[str, float] = POWERS,
                  targets: dict[str, DataFrame] | None = None, **columns: str) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, residual, kept) of each document.

    targets: (value, target) tables of shares that sum to 1, by margin.
    """
    docs = staged(described(df, **columns))
    cells = staged(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    return with_chance(docs, staged(chances(cells, share, powers, targets)), list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"),
        F.round("residual", 9).alias("residual"), (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample(df: DataFrame, share: float = SHARE, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None,
           doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """The documents that are drawn, with all their columns: the rows that probabilities() keeps. Texts aren't shuffled
    while the cells are few."""
    found = described(df, doc_id, text, source, lang)
    cells = staged(found.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    chance = staged(chances(cells, share, powers, targets)).select(*MARGINS, "probability")
    # The documents keep their own names in a struct, so that nothing of theirs clashes with what is added.
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"), *(
        c.alias(f"its_{k}") for k, c in features(doc_id, text, source, lang).items() if k != "n_tokens"))
    drawn = with_chance(own, chance, [f"its_{m}" for m in MARGINS]).where(draw(F.col("its_doc_id")) < F.col("probability"))
    return drawn.select("own.*")
