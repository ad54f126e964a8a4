"""Removed words against a loop over all windows."""

import random
import re

from pyspark.sql import functions as F

from helmline.llm import phrases
from tests.llm.helpers import documents


def expected(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(order, words):
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for (doc, _), i, w in zip(rows, order, words):
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(window)}
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(rng):
    words = ["a", "b", "cc", "d.", "é", "日本", "A"] + ["w%d" % i for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randrange(13, 60)) for _ in range(8)]
    rows = [(i, text(rng.randrange(0, 80)) + "\n" + rng.choice(passages) + "\t" + text(rng.randrange(0, 40))) for i in range(60)]
    rows += [(100 + i, rows[rng.randrange(60)][1]) for i in range(20)]
    rows += [(200 + i, " ".join(w for w in rows[rng.randrange(60)][1].split(" ") if rng.random() > 0.03)) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "x " * 400), (303, "x " * 30), (304, "a b " * 200), (None, rows[5][1]), (None, rows[5][1]),
             (5, rows[7][1]), (5, rows[5][1]), (-4, rows[9][1]), (305, passages[0]), (306, "x")]
    rng.shuffle(rows)
    return rows


def test_against_all_windows(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        df = documents(spark, rows).withColumn("block", F.lit(1)).withColumn("data", F.lit("z"))
        got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in phrases.remove_repeats(df).collect()]
        assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert phrases.remove_repeats(df.limit(0)).count() == 0


def test_sharded_automata(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SHARD_PHRASES", 7)
    text = b" ".join(b"w%d" % i for i in range(60))
    rows = pa.table({"doc_id": pa.array([1, 2, 3]), "data": pa.array([text, b"x " + text, text[40:]], pa.binary())})
    block = phrases.Block(rows)
    at = np.arange(48)
    gone = phrases.covered_words(block, at, np.full(48, 1), np.arange(3))
    assert gone[:61].tolist() == [False] * 61
    assert gone[61:121].all() and gone[122:].all()
