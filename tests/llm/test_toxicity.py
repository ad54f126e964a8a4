"""Gradients against differences, windows against a plain loop, held-out accuracy."""

import numpy as np

from helmline.llm import queries, toxicity
from tests.llm.helpers import documents


def test_windows_cover_every_word():
    texts = [b"a b c.", b"", None, b" ".join(b"w%d" % i for i in range(200)), b"X, x (x)"]
    w = toxicity.words_of(texts)
    assert w.per_text.tolist() == [3, 0, 0, 200, 3]
    assert len({int(x) for x in w.of[-3:]}) == 1
    at, text = toxicity.windows_of(w)
    for t in (0, 3, 4):
        begin = int(w.per_text[:t].sum())
        seen = {int(x) for x in at[text == t].ravel() if x < len(w.word)}
        assert seen == set(w.of[begin:begin + w.per_text[t]].tolist())
    long = at[text == 3]
    assert (long[:-1, toxicity.STRIDE:] == long[1:, :toxicity.LENGTH - toxicity.STRIDE]).all()


def test_gradients():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in toxicity.fresh(rng).items()}
    w = toxicity.words_of([b"some words here and there", b"one more text with words"])
    at, _ = toxicity.windows_of(w)
    y = np.array([1.0, 0.0])

    def loss():
        z = toxicity.all_logits(m, w, at)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = toxicity.gradients(m, w, toxicity.inputs(m, w), at, y)
    for name, d in g.items():
        flat = np.abs(d).ravel()
        for i in np.argsort(flat)[-3:]:
            place = np.unravel_index(i, d.shape)
            held = m[name][place]
            m[name][place] = held + 1e-2
            up = loss()
            m[name][place] = held - 1e-2
            down = loss()
            m[name][place] = held
            assert abs((up - down) / 2e-2 - d[place]) < 0.03 * abs(d[place]) + 1e-4, name


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.op6_toxicity(spark, sf_dir.replace("sf0.001", "sf0.1")).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    positive, negative = [s for s, y in held if y], [s for s, y in held if not y]
    above = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))
    assert above > 0.93


def test_nulls_and_empty_tables(spark):
    docs = documents(spark, [(1, None), (None, "text"), (2, ""), (2, "")])
    model = toxicity.fit([b"bad bad", b"good good"] * 20, np.array([1, 0] * 20), rounds=2)
    got = toxicity.score(docs, model).collect()
    assert sorted(r.score for r in got if r.doc_id is not None) == [0, 0, 0] and len(got) == 4
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, None).count() == 4
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels) is None


def test_long_words_are_read_to_their_end():
    """What stands behind the first bytes of a text without spaces counts, and each passage of half a window is whole."""
    filler = "这是一篇很长的普通文章" * 8
    texts = [(filler + x + filler).encode() for x in ("平静的一天", "可恶的坏人")]
    w = toxicity.words_of(texts)
    assert w.per_text.min() > 8 and len(set(w.of[:w.per_text[0]])) != 1
    assert set(w.of[:w.per_text[0]]) != set(w.of[w.per_text[0]:])
    model = toxicity.fit(texts * 400, np.array([0, 1] * 400))
    low, high = toxicity.scores(model, texts)
    assert low < toxicity.THRESHOLD <= high
    at, _ = toxicity.windows_of(toxicity.words_of([" ".join(f"w{i}" for i in range(200)).encode()]))
    inside = [set(row.tolist()) for row in at]
    order = toxicity.words_of([" ".join(f"w{i}" for i in range(200)).encode()]).of.tolist()
    assert all(any(set(order[i:i + 16]) <= held for held in inside) for i in range(184))
