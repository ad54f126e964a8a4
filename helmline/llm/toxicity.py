"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word enters as the embedding of its hash next to the mean embedding of its character n-grams; a word of more than PIECE
bytes enters as overlapping pieces, each a word of its own, so texts without spaces are read to their end. Windows of
words, each half over the one before, run through one recurrent layer in each direction; attention pools the states of a window into one logit. The
score of a text is that of its most toxic window. Everything is numpy; training sees documents as bags of windows: after
two rounds in which every window carries its document's label, only the most toxic windows of a document are learned.

Training takes at most SAMPLE labelled documents per class, those with the smallest hashes of their ids, and never one
that is held out; scoring covers every window of every text. Null and empty texts score 0. Without labels of both kinds
every text scores 0. Null ids are not held out; repeated rows come out row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helmline.llm.common import small_batches

SAMPLE = 1200
LENGTH, STRIDE = 32, 16
PIECE, PIECE_STEP = 64, 48
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
EMBED, HIDDEN, ATTEND = 8, 8, 8
GRAMS = (3, 4, 5)
ROUNDS = 10
THRESHOLD = 0.7
SEED = 11

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Distinct words of some texts: their buckets, and for each occurrence its word."""

    of: np.ndarray
    per_text: np.ndarray
    word: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    gram_count: np.ndarray


def words_of(texts: list[bytes | None]) -> Words:
    """The words of the texts in order, long ones in pieces, ASCII lower case, without punctuation at their ends."""
    raw = b"".join((t or b"") + b"\n" for t in texts).lower()
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    inside = ~_SPACE[data]
    change = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    text_no = np.searchsorted(np.cumsum(sizes), starts, side="right")
    punctuation = np.zeros(256, bool)
    punctuation[list(b".,;:!?()[]\"'")] = True
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & punctuation[data[ends - 1]])
        starts = starts + ((ends - starts > 1) & punctuation[data[starts]])
    pieces = 1 + np.maximum(0, -(-(ends - starts - PIECE) // PIECE_STEP))
    order = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + order * PIECE_STEP
    ends = np.minimum(starts + PIECE, np.repeat(ends, pieces))
    per_text = np.bincount(np.repeat(text_no, pieces), minlength=len(texts))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(PIECE, _MULTIPLY))))
        hashes = np.zeros(len(starts), np.uint64)
        lengths = ends - starts
        for k in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > k)
            hashes[on] += (data[starts[on] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
        hashes = _mixed(hashes + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        own, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        # Distinct words once more, each between two marks, for their n-grams.
        begin, size = starts[first], lengths[first]
        total = size + 2
        at = np.cumsum(total) - total
        chars = np.full(int(total.sum()), 255, np.uint64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        chars[np.repeat(at + 1, size) + inner] = data[np.repeat(begin, size) + inner]
        word_no = np.repeat(np.arange(len(own)), total)
        grams, gram_word = [], []
        for n in GRAMS:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * _MULTIPLY + chars[k:len(chars) - n + 1 + k]
            fits = word_no[:len(h)] == word_no[n - 1:]
            grams.append((_mixed(h[fits]) % np.uint64(GRAM_BUCKETS)).astype(np.int32))
            gram_word.append(word_no[:len(h)][fits])
        grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        gram_word = np.concatenate(gram_word) if gram_word else np.zeros(0, np.int64)
    order = np.argsort(gram_word, kind="stable")
    grams, gram_word = grams[order], gram_word[order]
    count = np.bincount(gram_word, minlength=len(own))
    return Words(of.reshape(-1), per_text, (own % np.uint64(WORD_BUCKETS)).astype(np.int32), grams, gram_word, count)


def windows_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each window (one past the last word pads) and the text of each window."""
    n = w.per_text
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(n) - n
    at = (begin[text] + k * STRIDE)[:, None] + np.arange(LENGTH)
    inside = at < (begin + n)[text][:, None]
    padded = np.append(w.of, len(w.word))
    return np.where(inside, padded[np.minimum(at, len(w.of))], len(w.word)).astype(np.int32), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    d, h = 2 * EMBED, HIDDEN
    return {
        "word": normal(WORD_BUCKETS, EMBED, scale=0.1), "gram": normal(GRAM_BUCKETS, EMBED, scale=0.3),
        "in": normal(d, 6 * h, scale=d ** -0.5), "bias": np.zeros(6 * h, np.float32),
        "fw": normal(h, 3 * h, scale=h ** -0.5), "bw": normal(h, 3 * h, scale=h ** -0.5),
        "att": normal(2 * h, ATTEND, scale=(2 * h) ** -0.5), "att_v": normal(ATTEND, scale=ATTEND ** -0.5),
        "out": normal(2 * h, scale=(2 * h) ** -0.5), "out_b": np.zeros(1, np.float32),
    }


def inputs(m: dict[str, np.ndarray], w: Words) -> np.ndarray:
    """The input vector of each distinct word."""
    sums = np.zeros((len(w.word) + 1, EMBED), np.float32)
    if len(w.grams):
        ends = np.cumsum(w.gram_count)
        has = np.flatnonzero(w.gram_count)
        sums[has] = np.add.reduceat(m["gram"][w.grams], (ends - w.gram_count)[has], axis=0)
    mean = sums[:-1] / np.maximum(w.gram_count, 1)[:, None]
    return np.concatenate((m["word"][w.word], mean), axis=1, dtype=np.float32)


def forward(m: dict[str, np.ndarray], projected: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Logits of windows; projected: inputs times "in" plus bias, one row per distinct word and one for padding."""
    h, b = HIDDEN, len(at)
    mask = (at < len(projected) - 1).astype(np.float32)
    states = np.zeros((LENGTH, b, 2 * h), np.float32)
    trace: list = []
    for side, (u, order) in enumerate(((m["fw"], range(LENGTH)), (m["bw"], range(LENGTH - 1, -1, -1)))):
        state = np.zeros((b, h), np.float32)
        for t in order:
            a = projected[at[:, t], 3 * h * side:3 * h * (side + 1)]
            hu = state @ u
            zr = _sigmoid(a[:, :2 * h] + hu[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h:] + r * hu[:, 2 * h:])
            on = mask[:, t:t + 1]
            new = state + on * (1 - z) * (n - state)
            if keep:
                trace.append((side, t, state, z, r, n, hu[:, 2 * h:]))
            state = new
            states[t, :, h * side:h * (side + 1)] = state
    u = np.tanh(states @ m["att"])
    s = u @ m["att_v"] - 1e4 * (1 - mask.T)
    e = np.exp(s - s.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    return pooled @ m["out"] + m["out_b"][0], (mask, states, u, alpha, pooled, trace) if keep else None


def gradients(m: dict[str, np.ndarray], w: Words, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss over windows `at` with labels y."""
    h = HIDDEN
    projected = np.concatenate((x @ m["in"] + m["bias"], np.zeros((1, 6 * h), np.float32)))
    logit, (mask, states, u, alpha, pooled, trace) = forward(m, projected, at, keep=True)
    g = {}
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g["out"], g["out_b"] = pooled.T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * m["out"]
    d_alpha = np.einsum("bh,tbh->tb", d_pooled, states)
    d_states = alpha[:, :, None] * d_pooled
    d_s = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["att_v"] = np.einsum("tb,tba->a", d_s, u)
    d_u = d_s[:, :, None] * m["att_v"] * (1 - u * u)
    g["att"] = np.einsum("tbh,tba->ha", states, d_u)
    d_states += d_u @ m["att"].T
    d_projected = np.zeros_like(projected)
    carry = [np.zeros((len(at), h), np.float32), np.zeros((len(at), h), np.float32)]
    g["fw"], g["bw"] = np.zeros_like(m["fw"]), np.zeros_like(m["bw"])
    for side, t, state, z, r, n, hu_n in reversed(trace):
        name = ("fw", "bw")[side]
        whole = d_states[t, :, h * side:h * (side + 1)] + carry[side]
        on = mask[:, t:t + 1]
        dh = on * whole
        d_n = dh * (1 - z) * (1 - n * n)
        d_z = dh * (state - n) * z * (1 - z)
        d_r = d_n * hu_n * r * (1 - r)
        d_hu = np.concatenate((d_z, d_r, d_n * r), axis=1)
        g[name] += state.T @ d_hu
        carry[side] = (1 - on) * whole + dh * z + d_hu @ m[name].T
        np.add.at(d_projected[:, 3 * h * side:3 * h * (side + 1)], at[:, t], np.concatenate((d_z, d_r, d_n), axis=1))
    d_projected = d_projected[:-1]
    g["in"], g["bias"] = x.T @ d_projected, d_projected.sum(0)
    d_x = d_projected @ m["in"].T
    used = np.flatnonzero(np.abs(d_x).sum(1))
    g["word"] = np.zeros_like(m["word"])
    np.add.at(g["word"], w.word[used], d_x[used, :EMBED])
    share = d_x[:, EMBED:] / np.maximum(w.gram_count, 1)[:, None]
    live = np.zeros(len(d_x), bool)
    live[used] = True
    some = live[w.gram_word]
    g["gram"] = np.zeros_like(m["gram"])
    np.add.at(g["gram"], w.grams[some], share[w.gram_word[some]])
    return g


def all_logits(m: dict[str, np.ndarray], w: Words, at: np.ndarray, most: int = 4096) -> np.ndarray:
    projected = np.concatenate((inputs(m, w) @ m["in"] + m["bias"], np.zeros((1, 6 * HIDDEN), np.float32)))
    parts = [forward(m, projected, at[i:i + most])[0] for i in range(0, len(at), most)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, batch: int = 256) -> dict[str, np.ndarray] | None:
    """A model of labelled texts; None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    m = fresh(rng)
    w = words_of(texts)
    at, text = windows_of(w)
    label = labels[text].astype(np.float32)
    first = np.searchsorted(text, np.arange(len(texts)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    for round_no in range(rounds):
        if round_no < 2:
            chosen = np.arange(len(at))
        else:
            logit = all_logits(m, w, at)
            order = np.lexsort((-logit, text))
            rank = np.arange(len(text)) - first[text[order]]
            chosen = order[rank < np.where(label[order] > 0, 1, 2)]
        positive, negative = chosen[label[chosen] > 0], chosen[label[chosen] == 0]
        n = min(max(len(positive), len(negative)), 4000)
        picks = np.concatenate((rng.choice(positive, n), rng.choice(negative, n)))
        rng.shuffle(picks)
        for i in range(0, len(picks), batch):
            part = picks[i:i + batch]
            own, local = np.unique(at[part], return_inverse=True)
            own = own[own < len(w.word)]
            member = np.full(len(w.word), -1, np.int64)
            member[own] = np.arange(len(own))
            some = member[w.gram_word] >= 0
            sub = Words(np.zeros(0, np.int64), np.zeros(0, np.int64), w.word[own], w.grams[some], member[w.gram_word[some]], w.gram_count[own])
            g = gradients(m, sub, inputs(m, sub), local.reshape(len(part), LENGTH).astype(np.int32), label[part])
            step += 1
            rate = 0.01 * (1 if round_no < rounds // 2 else 0.3)
            for k, d in g.items():
                a, b = moments[k]
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                m[k] -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-7)
    return m


def scores(m: dict[str, np.ndarray] | None, texts: list[bytes | None]) -> np.ndarray:
    out = np.full(len(texts), -np.inf)
    if m is not None and texts:
        w = words_of(texts)
        at, text = windows_of(w)
        np.maximum.at(out, text, all_logits(m, w, at))
    return np.where(np.isinf(out), 0.0, np.round(_sigmoid(out), 6))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          most: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """A model from at most `most` documents of each class that are not held out."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("label_id"), F.col(f"`{label}`").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    chosen = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = df.select(F.col(f"`{doc_id}`").alias("own_id"), F.col(f"`{text}`").cast("binary").alias("held"))
    found = texts.join(F.broadcast(chosen), F.col("own_id") == F.col("label_id")).select("own_id", "held", "label")
    found = found.orderBy(F.xxhash64("own_id"), "own_id").limit(2 * most).collect()
    return fit([bytes(r.held or b"") for r in found], np.array([r.label for r in found], np.int64))


def score(df: DataFrame, model: dict[str, np.ndarray] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Row by row, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "held", 2 << 20):
            found = scores(model, batch.column("held").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), pa.array(found, pa.float64())], ["own_id", "score"])

    rows = df.select(F.col(f"`{doc_id}`").alias("own_id"), F.col(f"`{text}`").cast("binary").alias("held"))
    kind = rows.schema["own_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"own_id {kind}, score double").withColumnRenamed("own_id", doc_id)


def keep_clean(df: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores less than the threshold, with all their columns."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 2 << 20):
            found = scores(model, batch.column(text).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(found < threshold))

    return df.mapInArrow(run, schema)
