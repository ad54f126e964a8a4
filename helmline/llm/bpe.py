"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces (matches of the split pattern) that a worker has not met yet are merged together: they are linked
lists of byte runs in one buffer. Each merge rank has a bucket of list positions; a bitmap of two levels says
which buckets hold any, so the next rank is found by find-first-set. Entries whose pair has changed meanwhile are
stale and skipped. Ranks are taken in order and positions from the left, so every piece sees its own merges in
its own order. A merge costs the same however long a piece is, which keeps very long pieces linear.

A worker's memory is bounded in bytes: texts come in batches of about 1 MB, a longer text is split part by part, pieces
are merged 256 KB at a time (one longer piece is merged by itself), and the ids of pieces met lately are kept in two
stores of 48 MB. Encoding and decoding again is one step, so that a task has one worker and one vocabulary.

Empty and null texts have no ids. Repeated rows are encoded one by one; ids may be null or repeated. Other
columns are not read. A null or empty id list decodes to an empty byte string; an unknown id is an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from helmline.llm.common import small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: White space of the split pattern: the code points with the Unicode property.
SPACES = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Texts without other characters than these are split alike by the standard module, which is faster.
UNUSUAL = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba]")
#: Bytes of a worker's newer store of pieces (and of its older one), and what a piece takes besides its letters and ids.
STORE_BYTES, PIECE_BYTES = 48 << 20, 220
#: Bytes of text that a batch holds, of pieces that are merged together, and pieces of a long text that are split off at once.
BATCH_BYTES, MERGE_BYTES, PART = 1 << 20, 256 << 10, 100_000


class RankQueue:
    """Positions by merge rank; take() gives the smallest rank and its positions from the left."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaf: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """An empty bucket gets these positions."""
        self.buckets[rank] = positions
        high = rank >> 8
        self.leaf[high] = self.leaf.get(high, 0) | 1 << (rank & 255)
        self.top |= 1 << high

    def take(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.leaf[high]
        low = word & -word
        self.leaf[high] = word ^ low
        if word == low:
            self.top ^= 1 << high
        rank = high << 8 | low.bit_length() - 1
        return rank, sorted(self.buckets.pop(rank))


def merge(pieces: list[bytes], ranks: dict[bytes, int], longest: int, two: np.ndarray) -> list[list[int]]:
    """The ids of each piece; no piece is empty. two: the rank of each pair of bytes, -1 for none."""
    buf = b"".join(pieces)
    n = len(buf)
    first = bytearray(n + 1)
    first[n] = 1
    at = 0
    for piece in pieces:
        first[at] = 1
        at += len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    letters = np.frombuffer(buf, np.uint8).astype(np.int32)
    pairs = np.full(n, -1, np.int32)
    pairs[:-1] = np.where(np.frombuffer(first, np.uint8)[1:n], -1, two[letters[:-1] << 8 | letters[1:]])
    pair = pairs.tolist()
    queue, rank_of = RankQueue(), ranks.get
    push, buckets = queue.push, queue.buckets
    order = np.argsort(pairs, kind="stable")
    held, at = np.unique(pairs[order], return_index=True)
    for rank, positions in zip(held.tolist(), np.split(order, at[1:])):
        if rank >= 0:
            queue.fill(rank, positions.tolist())
    while (found := queue.take()) is not None:
        rank, positions = found
        for k, i in enumerate(positions):
            if pair[i] != rank:
                continue
            j = after[i]
            pair[j] = -1
            end = after[i] = after[j]
            back = False
            if first[end]:
                pair[i] = -1
            else:
                before[end] = i
                stop = after[end]
                pair[i] = new = rank_of(buf[i:stop], -1) if stop - i <= longest else -1
                if new >= 0:
                    if (bucket := buckets.get(new)) is not None:
                        bucket.append(i)
                    else:
                        push(new, i)
                    back = new <= rank
            if not first[i]:
                h = before[i]
                pair[h] = new = rank_of(buf[h:end], -1) if end - h <= longest else -1
                if new >= 0:
                    if (bucket := buckets.get(new)) is not None:
                        bucket.append(h)
                    else:
                        push(new, h)
                    back = back or new <= rank
            if back:
                for later in positions[k + 1:]:
                    push(rank, later)
                break
    out, i = [], 0
    while i < n:
        if first[i]:
            out.append(ids := [])
        ids.append(ranks[buf[i:after[i]]])
        i = after[i]
    return out


class Vocabulary:
    """The bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        most = max(ranks.values()) + 1
        tokens = [b""] * most
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(most, bool)
        self.known[list(ranks.values())] = True
        self.sizes = np.fromiter(map(len, tokens), np.int64, most)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each id list; list i is ids[offsets[i]:offsets[i + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        held = self.letters[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
            None, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(held)]).cast(pa.binary())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """A vocabulary, and the ids (32-bit little-endian) of the pieces met lately."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.vocabulary = Vocabulary(self.ranks)
        self.longest = max(map(len, self.ranks))
        self.two = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int32)
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        spaced = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.pieces = regex.compile(spaced)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.plain_pieces = self.pieces if r"\p" in plain else re.compile(plain)

    def split(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in parts of bounded number if it is long."""
        own = self.pieces if UNUSUAL.search(text) else self.plain_pieces
        if len(text) <= BATCH_BYTES:
            yield own.findall(text)
            return
        found = (m.group() for m in own.finditer(text))
        while part := list(islice(found, PART)):
            yield part

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out, short = [], []
        for text in texts:
            if text and len(text) > BATCH_BYTES:
                out += self._together(short)
                short = []
                out.append(np.concatenate([self._together([part])[0] for part in self.split(text)]))
            else:
                short.append(next(self.split(text)) if text else [])
        return out + self._together(short)

    def _together(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of lists of pieces; those not met lately are merged together."""
        newer, older = self.newer, self.older
        if self.held > STORE_BYTES:
            newer, older = {}, newer
            self.newer, self.older, self.held = newer, older, 0
        missing, raws, size, alone = [], [], 0, []
        for piece in set().union(*split):
            if piece in newer:
                continue
            if (ids := older.get(piece)) is None:
                raw = piece.encode()
                if (rank := self.ranks.get(raw)) is None:
                    missing.append(piece)
                    raws.append(raw)
                    size += len(raw)
                    if len(raw) > 256:
                        alone.append(piece)
                    if size > MERGE_BYTES:
                        self._merge(missing, raws)
                        missing, raws, size = [], [], 0
                    continue
                ids = rank.to_bytes(4, "little")
            self._keep(piece, ids)
        self._merge(missing, raws)
        out = [np.frombuffer(b"".join(map(newer.__getitem__, x)), "<i4") for x in split]
        for piece in alone:
            self.held -= PIECE_BYTES + len(piece) + len(newer.pop(piece))
        return out

    def _merge(self, pieces: list[str], raws: list[bytes]) -> None:
        newer, held = self.newer, 0
        for piece, ids in zip(pieces, merge(raws, self.ranks, self.longest, self.two) if raws else ()):
            newer[piece] = data = pack(f"<{len(ids)}i", *ids)
            held += PIECE_BYTES + len(piece) + len(data)
        self.held += held

    def _keep(self, piece: str, ids: bytes) -> None:
        self.newer[piece] = ids
        self.held += PIECE_BYTES + len(piece) + len(ids)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return self.vocabulary.decode(ids, offsets)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = RANKS,
           pattern: str = public_tokenizers.PATTERN, also_text: bool = False, decoded: str | None = None) -> DataFrame:
    """The kept columns and `ids`, a list of token ids of the whole text; with also_text the text too.

    decoded: name of a further column, the bytes that the ids decode to. path: a rank file every executor can open; the
    vocabulary is read once per worker. Row by row, no shuffle.
    """
    kept = [f for f in df.schema.fields if f.name in keep]
    columns = [*kept, T.StructField("bpe_text", T.StringType())]
    source = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias("bpe_text"))
    schema = T.StructType([*(columns if also_text else kept), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           *([T.StructField(decoded, T.BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        names = [f.name for f in (columns if also_text else kept)]
        for batch in small_batches(batches, "bpe_text", BATCH_BYTES):
            found = own.encode(batch.column("bpe_text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            flat = np.concatenate(found).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            back = [own.decode(flat, offsets)] if decoded else []
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), ids, *back], [f.name for f in schema.fields])

    out = source.mapInArrow(run, schema)
    return out.withColumnRenamed("bpe_text", text) if also_text else out


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = RANKS) -> DataFrame:
    """df with the bytes of its id lists in a column `out`. Row by row, no shuffle."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        names = [f.name for f in schema.fields[:-1]]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(ids)
                sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                found = own.decode(flat, np.concatenate(([0], np.cumsum(sizes))))
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), found], [*names, out])

    return df.mapInArrow(run, schema)
