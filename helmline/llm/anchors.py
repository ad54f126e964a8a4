"""Repeated strings across documents: content-chosen anchors, and packed exchange between blocks and shards.

Documents are dealt into blocks, hashes into shards; both numbers grow with the input, so that one holds a few MB.
A block sends each shard one packed row of what it has for it (at most one row per hash, however many shards there
are), a shard answers the same way. Nothing of the whole corpus ever is in one task.

A window of `window` units (words or bytes) has as its anchor the run of `gram` units in it with the smallest hash, the
leftmost of equals. Equal windows have equal anchors, at the same place, whatever stands around them: so only windows
whose anchor is found in two documents can be found in two documents.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helmline.llm.common import group_count

#: About what a block holds of the texts, in bytes.
BLOCK_BYTES = 6 << 20
#: The place of a null document id in the order of ids.
NO_ID = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1342543DE82EF95)
PACKED = "shard bigint, block bigint, packed binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Units worked on at once, so that the arrays stay in a core's cache.
_CHUNK = 1 << 15


def rolling(units: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each run of n units (uint64): as many results as units; the last n - 1 are of no use."""
    return np.concatenate([np.zeros(0, np.uint64), *(
        _rolling(units[i:i + _CHUNK + n - 1], n, base)[:_CHUNK] for i in range(0, len(units), _CHUNK))])


def _rolling(units: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """rolling() by doubling."""
    have, h, done, out = 1, units, 0, None
    power = base
    while True:
        if n & have:
            if out is None:
                out = h.copy()
            else:
                moved = np.zeros_like(h)
                moved[:max(len(h) - done, 0)] = h[done:]
                out = out * np.uint64(pow(int(base), have, 1 << 64)) + moved
            done += have
        if done == n:
            return mixed(out)
        longer = h * power
        longer[:max(len(h) - have, 0)] += h[have:]
        h, have, power = longer, 2 * have, power * power


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours; the last n - 1 results are of no use."""
    have, least = 1, x
    while have < n:
        step = min(have, n - have)
        new = least.copy()
        m = max(len(x) - step, 0)
        np.minimum(least[:m], least[step:], out=new[:m])
        least, have = new, have + step
    return least


@dataclass
class Runs:
    """Runs of window starts with one anchor: windows first..last (inclusive), the anchor's place and hash."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray


def runs_of(units: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> Runs:
    """units: hashes of all documents' units one after another; sizes: units of each document."""
    ends = np.cumsum(sizes)
    parts, doc = [], 0
    while doc < len(sizes):
        start = int(ends[doc] - sizes[doc])
        stop = max(int(np.searchsorted(ends, start + 2 * _CHUNK, side="right")), doc + 1)
        parts.append(_runs(units[start:int(ends[stop - 1])], sizes[doc:stop], window, gram, start))
        doc = stop
    return Runs(*(np.concatenate([np.zeros(0, k), *(getattr(p, f) for p in parts)])
                  for f, k in (("first", np.int64), ("last", np.int64), ("place", np.int64), ("anchor", np.uint64))))


def _runs(units: np.ndarray, sizes: np.ndarray, window: int, gram: int, base: int) -> Runs:
    """The runs of some documents; base: the place of the first unit."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(sizes)
        n_windows = np.maximum(sizes - window + 1, 0)
        none = np.zeros(0, np.int64)
        if not n_windows.sum():
            return Runs(none, none, none, np.zeros(0, np.uint64))
        grams = _rolling(units, gram, _BASE)
        keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(units), dtype=np.uint64)
        least = sliding_least(keyed, window - gram + 1)
        starts = np.repeat(ends - sizes, n_windows) + _within(n_windows)
        at = least[starts]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        new[(np.cumsum(n_windows) - n_windows)[n_windows > 0]] = True
        new = np.flatnonzero(new)
        stop = np.concatenate((new[1:], [len(at)])) - 1
        place = (at[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return Runs(starts[new] + base, starts[stop] + base, place + base, grams[place])


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0], first[1]..last[1], ..."""
    counts = last - first + 1
    return np.repeat(first, counts) + _within(counts)


def pack(columns: Iterable[np.ndarray]) -> bytes:
    """Equally long columns of 64-bit numbers; bytes of equal weight stand together, so that small numbers compress."""
    return b"".join(np.ascontiguousarray(c.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def unpack(raw: bytes, n_columns: int) -> list[np.ndarray]:
    n = len(raw) // (8 * n_columns)
    data = np.frombuffer(raw, np.uint8).reshape(n_columns, 8, n)
    return [np.ascontiguousarray(c.T).reshape(-1).view("<u8") for c in data]


def send(block: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> pa.Table:
    """Rows (shard, block, packed) of the columns, dealt out by key."""
    shard = (mixed(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    held, at = np.unique(shard[order], return_index=True)
    bounds = [*at.tolist(), len(order)]
    packed = [pack(c[order[a:b]] for c in columns) for a, b in zip(bounds, bounds[1:])]
    return pa.table({"shard": pa.array(held, pa.int64()), "block": pa.array(np.full(len(held), block, np.int64)),
                     "packed": pa.array(packed, pa.binary())})


def gathered(rows: pa.Table, n_columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The columns of all packed rows of a table, and the block each entry came from."""
    parts = [unpack(p, n_columns) for p in rows["packed"].to_pylist()]
    sizes = [len(p[0]) for p in parts]
    blocks = np.repeat(rows["block"].to_numpy(), sizes)
    return blocks, [np.concatenate([np.zeros(0, np.uint64), *(p[k] for p in parts)]) for k in range(n_columns)]


def answer(shard: int, blocks: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Rows (shard, block, packed) of the columns, by block."""
    order = np.argsort(blocks, kind="stable")
    held, at = np.unique(blocks[order], return_index=True)
    bounds = [*at.tolist(), len(order)]
    packed = [pack(c[order[a:b]] for c in columns) for a, b in zip(bounds, bounds[1:])]
    return pa.table({"shard": pa.array(np.full(len(held), shard, np.int64)), "block": pa.array(held, pa.int64()),
                     "packed": pa.array(packed, pa.binary())})


def found_in(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def recurring_anchors(anchors: DataFrame) -> DataFrame:
    """Of (anchor, flag: it is in two documents of its block) from all blocks, the anchors of each that recur."""
    def resolve(key: tuple, rows: pa.Table) -> pa.Table:
        blocks, (anchor, several) = gathered(rows, 2)
        own, of, n = np.unique(anchor, return_inverse=True, return_counts=True)
        recurs = (n > 1) | (np.bincount(of, several.astype(np.float64), len(own)) > 0)
        keep = recurs[of]
        return answer(key[0].as_py(), blocks[keep], [anchor[keep]])

    return anchors.groupBy("shard").applyInArrow(resolve, PACKED)


def own_anchors(runs: Runs, doc_of_unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a block, and whether two of its documents have it."""
    order = np.argsort(runs.anchor)
    anchor, doc = runs.anchor[order], doc_of_unit[runs.first[order]]
    if not len(order):
        return anchor, anchor
    same = anchor[1:] == anchor[:-1]
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    # A group with two documents has two neighbours that differ.
    differs = np.concatenate(([False], same & (doc[1:] != doc[:-1])))
    return anchor[starts], np.logical_or.reduceat(differs, starts).astype(np.uint64)


def blocked(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(block, doc_id, data: the UTF-8 bytes) of every row, and the number of blocks and of shards."""
    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = group_count(df.sparkSession, total, BLOCK_BYTES)
    return rows.select(F.pmod(F.xxhash64("doc_id", "data"), F.lit(n)).alias("block"), "doc_id", "data"), n


def ids_of(rows: pa.Table) -> np.ndarray:
    """Document ids in their order; a null one is after all others."""
    return pa.compute.fill_null(rows["doc_id"], int(NO_ID)).to_numpy()
