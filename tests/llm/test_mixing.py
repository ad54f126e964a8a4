"""Marginals hold after raking; draws follow the probabilities; the same numbers from a plain loop."""

import random

from pyspark.sql import functions as F

from helmline.llm import mixing
from tests.llm.helpers import DOCUMENTS, documents


def rows(n=400):
    rng = random.Random(6)
    out = []
    for i in range(n):
        text = None if i == 5 else " ".join(["w"] * rng.randrange(0, 300))
        out.append((i, text, rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), 0))
    return out + [(None, "no id", "en", "a", 1), (7, "again", "en", "a", 1)]


def test_against_a_plain_loop(spark):
    docs = spark.createDataFrame(rows(), DOCUMENTS)
    got = mixing.probabilities(docs).collect()
    assert len(got) == len(rows())
    cells = {}
    for r in got:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    total = sum(cells.values())

    def margin(k, w):
        out = {}
        for c, n in cells.items():
            out[c[k]] = out.get(c[k], 0) + n * w[c]
        return out

    ones = dict.fromkeys(cells, 1.0)
    targets = []
    for k, m in enumerate(mixing.MARGINS):
        mass = {v: n ** mixing.POWERS[m] for v, n in margin(k, ones).items()}
        targets.append({v: x / sum(mass.values()) for v, x in mass.items()})
    w = dict(ones)
    for _ in range(300):
        for k in range(3):
            now = margin(k, w)
            w = {c: w[c] * targets[k][c[k]] * total / now[c[k]] if now[c[k]] else w[c] for c in w}
    for r in got:
        assert abs(r.weight - w[r.source, r.lang, r.topic]) < 1e-3
    expected = sum(r.n_tokens * r.probability for r in got)
    assert abs(expected / total - mixing.SHARE) < 0.01 or max(r.probability for r in got) == 1
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == kept
    drawn = sum(r.n_tokens for r in got if r.kept)
    assert abs(drawn / total - expected / total) < 0.1


def test_empty_and_no_tokens(spark):
    assert mixing.probabilities(documents(spark, []).limit(0)).count() == 0
    assert mixing.sample(documents(spark, [(1, None), (2, ""), (None, " ")])).count() >= 0


def test_repeated_ids_are_drawn_by_their_own_cell(spark, monkeypatch):
    """A row of a rare cell doesn't come along because another row of its id was drawn; names of the input may clash."""
    rng = random.Random(8)
    held = [(i % 900, " ".join(["w"] * rng.randrange(1, 80)), "en", "rare" if i % 5 == 0 else "usual", i) for i in range(4500)]
    docs = spark.createDataFrame(held, DOCUMENTS)
    for name in ("own", "its_doc_id", "probability", "cell_lang", "row_salt", "weight", "topic", "n_tokens"):
        docs = docs.withColumn(name, F.lit("x"))
    key = lambda r: (r.doc_id, r.source, r.n)
    want = sorted(key(r) for r in mixing.probabilities(docs).where("kept").selectExpr("doc_id", "source", "n_tokens AS n").collect())
    for most in (mixing.BROADCAST_CELLS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", most)
        out = mixing.sample(docs)
        assert out.columns == docs.columns
        assert sorted(key(r) for r in out.withColumn("n", mixing.count_words(F.col("text"))).select("doc_id", "source", "n").collect()) == want
    assert 0 < len(want) < len(held)


def test_given_targets_and_what_is_left(spark):
    docs = spark.createDataFrame(rows(), DOCUMENTS)
    shares = {"hot": 0.2, "a": 0.5, "b": 0.2, "": 0.1}
    targets = {"source": spark.createDataFrame(list(shares.items()), "value string, target double")}
    got = mixing.probabilities(docs, targets=targets).collect()
    total = sum(r.n_tokens * r.weight for r in got)
    for value, share in shares.items():
        assert abs(sum(r.n_tokens * r.weight for r in got if r.source == value) / total - share) < 1e-3
    assert {r.residual < 1e-5 for r in got} == {True}
    # One language for each source: the two margins can't both hold.
    bound = spark.createDataFrame([(i, "w w w", "en" if i % 2 else "de", "a" if i % 2 else "b", 0) for i in range(60)], DOCUMENTS)
    against = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, target double"),
               "lang": spark.createDataFrame([("en", 0.1), ("de", 0.9)], "value string, target double")}
    assert {r.residual > 0.5 for r in mixing.probabilities(bound, targets=against).collect()} == {True}
