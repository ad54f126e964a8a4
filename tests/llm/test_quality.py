"""Counts against a plain loop; the fit finds planted accuracies."""

import random
import re

from pyspark.sql import functions as F

from helmline.llm import quality
from tests.llm.helpers import documents


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark):
    rng = random.Random(8)
    bits = ["a", "bb", "ccc", "é", "\U0001f600", "#", "<b>", "\n", "\n", "\t", "x y z", "1.", "\r\n", " ", "\x0b"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    texts += ["", None, "one", "one two", "a b c a b c", "\n\n", "same\nsame\nsame", "w " * 300]
    rows = list(enumerate(texts)) + [(None, "x"), (5, "dup id"), (5, "dup id")]
    df = documents(spark, rows).withColumn("words", F.lit(0)).withColumn("h", F.lit(0))
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *counts(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert quality.judge(df.limit(0)).count() == 0


def test_fit_finds_accuracies(spark):
    rng = random.Random(1)
    true = [0.9, 0.8, 0.7, 0.95]
    rows = []
    for _ in range(6000):
        y = rng.random() < 0.7
        rows.append(tuple(-1 if rng.random() < 0.2 else int(y if rng.random() < a else not y) for a in true))
    names = ["a", "b", "c", "d"]
    prior, accuracy = quality.fit(spark.createDataFrame(rows, names), names, rounds=60)
    assert abs(prior - 0.7) < 0.05
    assert all(abs(a - b) < 0.05 for a, b in zip(accuracy, true))
