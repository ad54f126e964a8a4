"""Substring dedup over bytes: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A string is 50 bytes of one document. Anchors (see anchors.py) leave the strings that can be in two documents, in runs
around each anchor (a piece: at most 74 bytes). Pieces that are equal wherever their anchor stands are settled by
their digests. Where an anchor stands in different pieces, the texts of these meet in one shard (each text once, with the
smallest document it is in): parts of them get transforms of their own, and the transforms are merged: an interleave holds
the rows of all parts in common order; each round orders it by one more character, by a stable count of the symbols, and
leaves suffixes too short for that out. After 50 rounds the intervals of common prefix 50 are the repeated strings. No suffix is sorted twice. Digests have 128 bits.

Null and empty texts have no bytes. Documents with the same id are the same document to the rule, and each row comes out
on its own; a null id is after all others. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helmline.llm import anchors as A
from helmline.llm.common import staged

WINDOW, GRAM = 50, 26
#: Bytes of pieces that get a transform of their own.
PART_BYTES = 1 << 16


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of a text of strings that end with 0 (at ends), in the order of what follows up to that end; ties by place."""
    sizes = np.diff(np.concatenate(([0], ends + 1)))
    longest = int(sizes.max())
    left = np.repeat(ends, sizes) - np.arange(len(text))
    padded = np.concatenate((text, np.zeros(longest, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, longest)[:len(text)].copy()
    rows[np.arange(longest) >= left[:, None]] = 0
    return np.argsort(rows.view(f"S{longest}").reshape(-1), kind="stable")


def transform(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and the transform (the character before each suffix; 0 before a string)."""
    order = suffix_order(text, ends)
    return order, np.where(order > 0, text[order - 1], 0).astype(np.uint8)


def rounds(transforms: list[np.ndarray], strings: list[int], depth: int, short: bool):
    """The interleave of transforms, round by round: (strings' ends at its head, row among all transforms' rows, whether
    the common prefix with the row before ended). strings: the number of strings of each transform.

    A round puts one character before every suffix: a stable count of the symbols. short: keep suffixes that are shorter
    than the rounds done; without, a suffix that starts its string has no longer one and leaves.
    """
    sizes = [len(t) for t in transforms]
    symbols = np.concatenate(transforms)
    base = np.cumsum(sizes) - sizes
    # Row of the suffix that is one character longer, within the row's own transform; strings' ends are its first rows.
    longer = np.empty(len(symbols), np.int32)
    for t, b, k in zip(transforms, base.tolist(), strings):
        longer[np.argsort(t, kind="stable")[k:] + b] = np.arange(b + k, b + len(t), dtype=np.int32)
    ends = np.zeros(0, np.int32)
    if short:
        ends = np.concatenate([np.arange(b, b + k, dtype=np.int32) for b, k in zip(base.tolist(), strings)])
    row = np.arange(len(symbols), dtype=np.int32)
    group = np.zeros(len(symbols), np.int32)
    for _ in range(depth):
        symbol = symbols[row]
        count = np.bincount(symbol, minlength=2)
        order = np.argsort(symbol, kind="stable")[count[0]:]
        row, group = longer[row[order]], group[order]
        # A group begins where the symbol changes, or where the rest of the suffix was told apart before.
        new = np.empty(len(row), bool)
        np.not_equal(group[1:], group[:-1], out=new[1:])
        new[(np.cumsum(count[1:]) - count[1:])[count[1:] > 0]] = True
        group = np.cumsum(new, dtype=np.int32)
        if short:
            row, group = np.concatenate((ends, row)), np.concatenate((np.zeros(len(ends), np.int32), group))
        yield len(ends), row, new


def merge(transforms: list[np.ndarray], strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which transform each place of the merged one comes from, and the common prefix of each place with the one before
    it, at most depth."""
    source = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    row, common = np.arange(len(source)), np.zeros(len(source), np.int32)
    for n_ends, row, new in rounds(transforms, strings, depth, short=True):
        common[n_ends:] += ~new
    return source[row], common


def least_per_string(pieces: list[bytes], doc: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each string of `window` bytes of each piece, the smallest doc of the pieces it is in (equal pieces too)."""
    texts = [np.frombuffer(p, np.uint8) + 1 for p in pieces]
    parts, at, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= PART_BYTES or i == len(texts) - 1:
            parts.append((at, i + 1))
            at, held = i + 1, 0
    orders, transforms, base = [], [], 0
    for a, b in parts:
        sizes = np.array([len(t) + 1 for t in texts[a:b]])
        text = np.concatenate([x for t in texts[a:b] for x in (t, np.zeros(1, np.uint8))])
        order, bwt = transform(text, np.cumsum(sizes) - 1)
        orders.append(order + base)
        transforms.append(bwt)
        base += len(text)
    for _, row, new in rounds(transforms, [b - a for a, b in parts], window, short=False):
        pass
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    result = np.full(base, A.NO_ID)
    if len(row):
        place = np.concatenate(orders)[row]
        value = doc[np.repeat(np.arange(len(texts)), sizes)[place]]
        begins = np.flatnonzero(new)
        result[place] = np.repeat(np.minimum.reduceat(value, begins), np.diff(np.concatenate((begins, [len(row)]))))
    return [result[s:s + max(n - window, 0)] for s, n in zip(starts.tolist(), sizes.tolist())]


class Block:
    """The bytes of a block's documents and the pieces around their anchors."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = A.ids_of(rows)
        self.texts = [t or b"" for t in rows["data"].to_pylist()]
        self.data = b"".join(self.texts)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.doc = np.repeat(np.arange(len(self.texts)), self.sizes)
        letters = np.frombuffer(self.data, np.uint8)
        with np.errstate(over="ignore"):
            self.units = A.mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[letters]
        self.runs = A.runs_of(self.units, self.sizes, WINDOW, GRAM)

    def digests(self) -> np.ndarray:
        """A digest of each piece: of the bytes from its first string to the end of its last."""
        first, last = self.runs.first, self.runs.last
        out = np.zeros(len(first), np.uint64)
        if len(first):
            with np.errstate(over="ignore"):
                # Two overlapping hashes of 50 bytes and the length tell a piece (its strings overlap without a gap).
                h = A.rolling(self.units, WINDOW, A._OTHER)
                out = A.mixed(h[first] + A.mixed(h[last] ^ (last - first).astype(np.uint64)))
        return out


def _pairs(anchor: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one, group of each) of equal (anchor, digest) pairs, among the pairs of one block or shard."""
    with np.errstate(over="ignore"):
        key = A.mixed(anchor + A.mixed(digest))
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1]))
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


#: What a shard tells a block about a piece: the smallest document it is in, settled; or that its strings must be compared.
SETTLED, COMPARE, COMPARE_AND_SEND = 0, 1, 2
TEXTS = "shard bigint, block bigint, packed binary, text binary, sizes binary"


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: the bytes left) of every row."""
    docs, n = A.blocked(df, doc_id, text)

    def propose(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows)
        own, several = A.own_anchors(block.runs, block.ids[block.doc])
        return A.send(key[0].as_py(), own, [own, several], n)

    recurring = A.recurring_anchors(docs.groupBy("block").applyInArrow(propose, A.PACKED))

    def digest(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows)
        _, (anchor,) = A.gathered(answers, 1)
        keep = A.found_in(block.runs.anchor, np.sort(anchor))
        own, digests = block.runs.anchor[keep], block.digests()[keep]
        first, group = _pairs(own, digests)
        least = np.full(len(first), A.NO_ID)
        np.minimum.at(least, group, block.ids[block.doc[block.runs.first[keep]]])
        return A.send(key[0].as_py(), own[first], [own[first], digests[first], least], n)

    digests = docs.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(digest, A.PACKED)

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        blocks, (anchor, piece, least) = A.gathered(rows, 3)
        least = least.view(np.int64)
        order = np.lexsort((blocks, least, piece, anchor))
        blocks, anchor, piece, least = blocks[order], anchor[order], piece[order], least[order]
        if not len(order):
            return A.answer(key[0].as_py(), blocks, [anchor, piece, least, least])
        new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new_piece = new_anchor | np.concatenate(([True], piece[1:] != piece[:-1]))
        anchor_no, piece_no = np.cumsum(new_anchor) - 1, np.cumsum(new_piece) - 1
        several = (np.bincount(anchor_no[new_piece]) > 1)[anchor_no]
        overall = least[np.flatnonzero(new_piece)][piece_no]
        state = np.where(several, np.where(new_piece, COMPARE_AND_SEND, COMPARE), SETTLED)
        keep = several | (overall < least)
        return A.answer(key[0].as_py(), blocks[keep], [anchor[keep], piece[keep], overall[keep], state[keep]])

    # Two steps read what is settled; written, it is worked out once.
    settled = staged(digests.groupBy("shard").applyInArrow(settle, A.PACKED))

    def give(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows)
        _, (anchor, piece, least, state) = A.gathered(answers, 4)
        some = state != SETTLED
        anchor, piece, least, state = anchor[some], piece[some], least[some], state[some]
        first, group = _pairs(np.concatenate((anchor, block.runs.anchor)), np.concatenate((piece, block.digests())))
        own = np.full(len(first), -1, np.int64)
        own[group[len(anchor):]] = np.arange(len(block.runs.anchor))
        run = own[group[:len(anchor)]]
        sending = state == COMPARE_AND_SEND
        begin = np.where(sending, block.runs.first[run], 0) if len(run) else run
        stop = np.where(sending, block.runs.last[run] + WINDOW, 0) if len(run) else run
        shard = (A.mixed(anchor) % np.uint64(n)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        held, at = np.unique(shard[order], return_index=True)
        out = {"packed": [], "text": [], "sizes": []}
        for a, b in zip(at.tolist(), [*at.tolist()[1:], len(order)]):
            part = order[a:b]
            out["packed"].append(A.pack([anchor[part], piece[part], least[part]]))
            out["text"].append(b"".join(block.data[s:e] for s, e in zip(begin[part].tolist(), stop[part].tolist())))
            out["sizes"].append((stop[part] - begin[part]).astype(np.uint16).tobytes())
        return pa.table({"shard": pa.array(held, pa.int64()), "block": pa.array(np.full(len(held), key[0].as_py(), np.int64)),
                         **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    texts = docs.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(give, TEXTS)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        """For every piece, packed per block: its anchor, digest and the smallest document of each of its strings."""
        blocks, (anchor, piece, least) = A.gathered(rows, 3)
        sizes = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["sizes"].to_pylist()]).astype(np.int64)
        data = b"".join(rows["text"].to_pylist())
        ends = np.cumsum(sizes)
        sent = np.flatnonzero(sizes)
        found = least_per_string([data[ends[i] - sizes[i]:ends[i]] for i in sent], least[sent].view(np.int64)) if len(sent) else []
        _, group = _pairs(anchor, piece)
        by_group = np.full(int(group.max(initial=-1)) + 1, -1, np.int64)
        by_group[group[sent]] = np.arange(len(sent))
        counts = np.array([len(x) for x in found], np.int64)
        begin = np.cumsum(counts) - counts
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        # A piece whose strings all come from its own first document is settled by that.
        alike = np.array([bool((x == d).all()) for x, d in zip(found, least[sent].view(np.int64).tolist())], bool)
        which = by_group[group]
        single = np.flatnonzero(alike[which] & (sizes == 0)) if len(sent) else which
        many = np.flatnonzero(~alike[which]) if len(sent) else which
        n_of = counts[which[many]]
        at = A.expand(begin[which[many]], begin[which[many]] + n_of - 1)
        entry = np.concatenate((single, np.repeat(many, n_of)))
        value = np.concatenate((least[single].view(np.int64), flat[at]))
        alone = np.concatenate((np.ones(len(single), np.int64), np.zeros(len(at), np.int64)))
        return A.answer(key[0].as_py(), blocks[entry], [anchor[entry], piece[entry], value, alone])

    compared = texts.groupBy("shard").applyInArrow(compare, A.PACKED)
    answers = settled.withColumn("strings", F.lit(0)).union(compared.withColumn("strings", F.lit(1)))

    def remove(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows)
        runs, doc_of = block.runs, block.ids[block.doc]
        pieces = block.digests()
        is_strings = answers["strings"].to_numpy() == 1
        _, (anchor, piece, least, state) = A.gathered(answers.filter(pa.array(~is_strings)), 4)
        flat = state == SETTLED
        anchor, piece, least = anchor[flat], piece[flat], least[flat].view(np.int64)
        _, (s_anchor, s_piece, s_least, alone) = A.gathered(answers.filter(pa.array(is_strings)), 4)
        one = alone == 1
        anchor, piece = np.concatenate((anchor, s_anchor[one])), np.concatenate((piece, s_piece[one]))
        least = np.concatenate((least, s_least[one].view(np.int64)))
        s_anchor, s_piece, s_least = s_anchor[~one], s_piece[~one], s_least[~one]
        new = np.concatenate((np.ones(min(len(s_anchor), 1), bool), (s_anchor[1:] != s_anchor[:-1]) | (s_piece[1:] != s_piece[:-1])))
        s_at = np.flatnonzero(new)
        first, group = _pairs(np.concatenate((runs.anchor, anchor, s_anchor[s_at])), np.concatenate((pieces, piece, s_piece[s_at])))
        n_runs = len(runs.anchor)
        own = group[:n_runs]
        # Equal pieces within the block, pieces settled elsewhere, and pieces whose strings were compared.
        known = np.full(len(first), A.NO_ID)
        if n_runs:
            np.minimum.at(known, own, doc_of[runs.first])
        np.minimum.at(known, group[n_runs:n_runs + len(anchor)], least)
        strings = np.full(len(first), -1, np.int64)
        strings[group[n_runs + len(anchor):]] = s_at
        marks = np.zeros(len(block.data) + 1, np.int64)
        if n_runs:
            some = np.flatnonzero((strings[own] >= 0) | (known[own] < doc_of[runs.first]))
            windows = A.expand(runs.first[some], runs.last[some])
            run = np.repeat(some, (runs.last - runs.first + 1)[some])
            value = known[own[run]]
            offset = strings[own[run]]
            many = offset >= 0
            value[many] = np.minimum(value[many], s_least.view(np.int64)[offset[many] + (windows - runs.first[run])[many]])
            hit = windows[value < doc_of[windows]]
            marks += np.bincount(hit, minlength=len(marks))
            marks -= np.bincount(hit + WINDOW, minlength=len(marks))
        gone = np.cumsum(marks)[:-1] > 0
        data = np.frombuffer(block.data, np.uint8)
        ends = np.cumsum(block.sizes)
        n_removed, n_spans, kept = [], [], []
        for start, stop in zip((ends - block.sizes).tolist(), ends.tolist()):
            g = gone[start:stop]
            n_removed.append(int(g.sum()))
            n_spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()))
            kept.append(data[start:stop][~g].tobytes())
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(block.sizes), "n_removed": pa.array(n_removed, pa.int64()),
                         "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
