"""Substring dedup over words: confirmed recurring phrases, sharded Aho-Corasick automata, every occurrence removed.

A phrase is 13 consecutive words of one document. Anchors (see anchors.py) leave the windows that can be in two
documents; their digests meet in shards, which confirm the phrases that recur and the smallest document each starts in.
For every block of documents the phrases that tile its recurring passages are compiled into automata over word numbers, at
most SHARD_PHRASES at a time, and the documents are streamed through them; each word that an occurrence covers is removed if
the phrase also starts in a document with a smaller id. Digests have 96 bits between blocks; within a block the automata
compare words.

Words are runs without U+0009..U+000D and space; null and empty texts have none. Documents with the same id are the same
document to the rule, and each row comes out on its own; a null id is after all others. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helmline.llm import anchors as A

WINDOW, GRAM = 13, 7
SHARD_PHRASES = 60_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Block:
    """The words of a block's documents."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = A.ids_of(rows)
        texts = [t or b"" for t in rows["data"].to_pylist()]
        self.data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        inside = ~_SPACE[self.data]
        change = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.sizes = np.bincount(np.searchsorted(bounds, self.starts, side="right"), minlength=len(texts))
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        with np.errstate(over="ignore"):
            self.words = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A hash of each word: of sums of its bytes times powers, by prefix sums over the block."""
        n = len(self.data)
        odd = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, odd))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(A.mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[self.data] * powers[:-1])))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse))))
        lengths = (self.ends - self.starts).astype(np.uint64)
        return A.mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + lengths * np.uint64(0x2545F4914F6CDD1D))

    def runs(self) -> A.Runs:
        return A.runs_of(self.words, self.sizes, WINDOW, GRAM)

    def window_starts(self) -> np.ndarray:
        n = np.maximum(self.sizes - WINDOW + 1, 0)
        begin = np.cumsum(self.sizes) - self.sizes
        has = n > 0
        return A.expand(begin[has], (begin + n - 1)[has])


def _least(of: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
    out = np.full(n, A.NO_ID)
    np.minimum.at(out, of, doc)
    return out


def covered_words(block: Block, phrase: np.ndarray, first_doc: np.ndarray, needs: np.ndarray) -> np.ndarray:
    """Which words are covered by a phrase that starts in a document with a smaller id.

    phrase: the word numbers at which one occurrence of each recurring phrase starts, ascending; first_doc: the smallest
    document it starts in; needs: the documents (by place in the block) that have any.
    """
    _, numbers = np.unique(block.words, return_inverse=True)
    begin = np.cumsum(block.sizes) - block.sizes
    marks = np.zeros(len(block.words) + 1, np.int64)
    texts = {int(d): tuple(numbers[begin[d]:begin[d] + block.sizes[d]].tolist()) for d in needs}
    for at in range(0, len(phrase), SHARD_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        part, firsts = phrase[at:at + SHARD_PHRASES], first_doc[at:at + SHARD_PHRASES]
        docs = block.doc[part]
        for k, (d, s) in enumerate(zip(docs.tolist(), (part - begin[docs]).tolist())):
            automaton.add_word(texts[d][s:s + WINDOW], k)
        automaton.make_automaton()
        for d, text in texts.items():
            hits = [x for pair in automaton.iter(text) for x in pair]
            if hits:
                pairs = np.array(hits).reshape(-1, 2)
                ends = pairs[firsts[pairs[:, 1]] < block.ids[d], 0] + begin[d] + 1
                np.add.at(marks, ends - WINDOW, 1)
                np.add.at(marks, ends, -1)
    return np.cumsum(marks)[:-1] > 0


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the words left, joined by one space, as bytes) of every row."""
    docs, n = A.blocked(df, doc_id, text)

    def propose(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows)
        own, several = A.own_anchors(block.runs(), block.ids[block.doc])
        return A.send(key[0].as_py(), own, [own, several], n)

    recurring = A.recurring_anchors(docs.groupBy("block").applyInArrow(propose, A.PACKED))

    def digest(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows)
        _, (anchor,) = A.gathered(answers, 1)
        runs = block.runs()
        keep = A.found_in(runs.anchor, np.sort(anchor))
        at = A.expand(runs.first[keep], runs.last[keep])
        with np.errstate(over="ignore"):
            one = A.rolling(block.words, WINDOW)[at]
            two = A.rolling(block.words, WINDOW, A._OTHER)[at]
        own, first, of = np.unique(one, return_index=True, return_inverse=True)
        least = _least(of, len(own), block.ids[block.doc[at]])
        return A.send(key[0].as_py(), own, [own, two[first] >> np.uint64(32), least], n)

    digests = docs.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(digest, A.PACKED)

    def confirm(key: tuple, rows: pa.Table) -> pa.Table:
        blocks, (one, two, least) = A.gathered(rows, 3)
        least = least.view(np.int64)
        order = np.lexsort((two, one))
        one, two, least, blocks = one[order], two[order], least[order], blocks[order]
        new = np.concatenate((np.ones(min(len(one), 1), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        starts = np.flatnonzero(new)
        overall = np.minimum.reduceat(least, starts) if len(starts) else least
        overall = overall[np.cumsum(new) - 1]
        keep = overall < least
        return A.answer(key[0].as_py(), blocks[keep], [one[keep], overall[keep]])

    confirmed = digests.groupBy("shard").applyInArrow(confirm, A.PACKED)

    def remove(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows)
        _, (known, known_first) = A.gathered(answers, 2)
        at = block.window_starts()
        gone = np.zeros(len(block.words), bool)
        if len(at):
            with np.errstate(over="ignore"):
                one = A.rolling(block.words, WINDOW)[at]
            own, of = np.unique(one, return_inverse=True)
            doc = block.ids[block.doc[at]]
            least = _least(of, len(own), doc)
            place = np.minimum(np.searchsorted(own, known), len(own) - 1)
            same = own[place] == known
            np.minimum.at(least, place[same], known_first[same].view(np.int64))
            repeats = np.flatnonzero(least[of] < doc)
            # A passage is a run of such windows; windows side by side, and its last, cover it.
            place = at[repeats]
            ends_run = np.concatenate((place[1:] != place[:-1] + 1, np.ones(min(len(place), 1), bool)))
            starts_run = np.concatenate((np.ones(min(len(place), 1), bool), ends_run[:-1]))
            begin = np.flatnonzero(starts_run)
            step = np.arange(len(place)) - (begin[np.cumsum(starts_run) - 1] if len(begin) else 0)
            tiles = repeats[(step % WINDOW == 0) | ends_run]
            phrases, first_tile = np.unique(of[tiles], return_index=True)
            order = np.argsort(tiles[first_tile])
            phrases, first_tile = phrases[order], first_tile[order]
            gone = covered_words(block, at[tiles[first_tile]], least[phrases], np.unique(block.doc[place]))
        removed = np.bincount(block.doc[gone], minlength=len(rows))
        raw = block.data.tobytes()
        begin = np.cumsum(block.sizes) - block.sizes
        kept = []
        for d in range(len(rows)):
            span = slice(begin[d], begin[d] + block.sizes[d])
            stay = ~gone[span]
            kept.append(b" ".join(raw[s:e] for s, e in zip(block.starts[span][stay].tolist(), block.ends[span][stay].tolist())))
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(block.sizes.astype(np.int64)),
                         "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.binary())})

    return docs.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
