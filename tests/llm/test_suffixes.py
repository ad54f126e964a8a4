"""The merge against sorted suffixes; removed bytes against a loop over all strings."""

import random

import numpy as np
from pyspark.sql import functions as F

from helmline.llm import suffixes
from tests.llm.helpers import documents
from tests.llm.test_phrases import corpus


def test_merge_orders_and_prefixes():
    rng = random.Random(4)
    for depth in (3, 6, 20):
        parts = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 6))] for _ in range(4)]
        orders, bwts, texts = [], [], []
        for part in parts:
            text = np.frombuffer(b"\x00".join(part) + b"\x00", np.uint8)
            ends = np.flatnonzero(text == 0)
            order, bwt = suffixes.transform(text, ends)
            orders.append([bytes(text[o:ends[np.searchsorted(ends, o)]]) for o in order])
            bwts.append(bwt)
        source, common = suffixes.merge(bwts, [len(p) for p in parts], depth)
        took = [iter(o) for o in orders]
        merged = [next(took[s]) for s in source]
        assert [m[:depth] for m in merged] == sorted(m[:depth] for m in merged)
        for k in range(1, len(merged)):
            a, b = merged[k - 1], merged[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if same < min(len(a), len(b)) or same >= depth:
                assert common[k] == min(same, depth)


def test_least_per_string(monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 64)
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    doc = np.array([rng.randrange(100) for _ in pieces])
    got = suffixes.least_per_string(pieces, doc, 6)
    for p, found in zip(pieces, got):
        want = [min(int(d) for q, d in zip(pieces, doc) if p[i:i + 6] in q) for i in range(len(p) - 5)]
        assert found.tolist() == want


def expected(rows, window=50):
    data = [(t or "").encode() for _, t in rows]
    order = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for i, t in zip(order, data):
        for k in range(len(t) - window + 1):
            first[t[k:k + window]] = min(first.get(t[k:k + window], i), i)
    out = []
    for (doc, _), i, t in zip(rows, order, data):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if first[t[k:k + window]] < i:
                gone[k:k + window] = True
        gone = gone[:-1]
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_against_all_strings(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed)) + [(400 + i, "z" * (40 + i) + "é") for i in range(20)]
        df = documents(spark, rows).withColumn("block", F.lit(1))
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()]
        assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
