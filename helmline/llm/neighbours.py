"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the signs of its products with random directions and orders the vectors by these bits,
first bit first. In that order every vector is compared, in double precision, with the ones in a bounded window before
it. Pairs that are verified in any pass are links, and links make components.

Groups that outgrow a window are completed exactly: the members of each component of more than half a window are cut
into cells of bounded size, and every vector of the table that the angle bound of a cell does not rule out is compared
with all members of the cell. So all links of such members are counted, to vectors outside the component too.

Passes are dealt out by ranges of the order; the ends of a range are compared with the start of the next in a step of
their own. Directions follow from the seed, so a lost task gives the same rows again. Equal vectors are collapsed first:
one of them takes part, the others are linked to it and to all that it is linked to.

Vectors of each length are compared among themselves. Null, empty and zero vectors and vectors with null or non-finite
components link with nothing; they come out with no links, in a component of their own. Components are scaled by a power
of two first, so that very large and very small ones neither overflow nor vanish. Null ids come out with null component
unless linked to an id. Repeated rows count as vectors of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from helmline.llm.common import shuffle_partitions, staged
from helmline.llm.components import components

LEAST_COSINE = 0.95
PASSES = 24
BITS = 62
WINDOW = 48
SEED = 20
#: Bytes of vectors in a cell, and cells that a block of vectors is held against at a time.
CELL_BYTES = 4 << 20
PACK = 256


def directions(pass_no: int, dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, pass_no]).standard_normal((dims, BITS))


def order_keys(x: np.ndarray, pass_no: int) -> np.ndarray:
    """The bits of each row of x as a number, first bit highest."""
    bits = x @ directions(pass_no, x.shape[1]) > 0
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def window_pairs(x: np.ndarray, window: int, least: float, split: int = 0,
                 onward: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) with cosine of at least `least`; rows are unit vectors in order.

    All pairs up to `window` apart are compared, and farther ones as long as a row's pair at the last distance was a
    link, unless onward is off. With split, only pairs across that position count.
    """
    found, n = [], len(x)
    active = np.arange(n)
    for off in range(1, n):
        i = active[active + off < n]
        if split:
            i = i[(i < split) & (i + off >= split)] if off <= window else i[i + off < n]
        if not len(i):
            if split and off < window:
                continue
            break
        near = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 15):
            part = i[at:at + (1 << 15)]
            near[at:at + len(part)] = np.einsum("ij,ij->i", x[part], x[part + off]) >= least
        if near.any():
            found.append((i[near], i[near] + off))
        if off >= window:
            if not onward:
                break
            active = i[near]
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """The places of the vectors of each length."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def links(classes: DataFrame, passes: int, window: int, least: float) -> DataFrame:
    """(a, b), a < b: classes (cid bigint, vec binary of doubles) that some pass verified. A length has passes of its own."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in by_length(batch.column("vec")):
                own = batch.take(pa.array(at))
                x = _vectors(own.column("vec"))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), x.shape[1] * passes + p, np.int64)), pa.array(order_keys(x, p)), own.column("cid"),
                         own.column("vec")], ["pass", "key", "cid", "vec"])

    keyed = staged(classes.mapInArrow(project, "pass bigint, key bigint, cid bigint, vec binary"))
    # A range holds many windows on average, so that no window reaches over a whole range.
    parts = max(min(shuffle_partitions(classes.sparkSession), keyed.count() // (16 * window)), 1)
    ordered = keyed.repartitionByRange(parts, "pass", "key", "cid").sortWithinPartitions("pass", "key", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside a range of the order, and the rows at both of its ends, by pass."""
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        passes_of = rows["pass"].to_numpy()
        cuts = np.flatnonzero(np.diff(passes_of)) + 1
        bounds = [0, *cuts.tolist(), len(passes_of)]
        names = ["kind", "part", "pass", "a", "b", "key", "vec"]
        for start, stop in zip(bounds, bounds[1:]):
            x = _vectors(rows["vec"].slice(start, stop - start).combine_chunks())
            ids = rows["cid"].to_numpy()[start:stop]
            for i, j in window_pairs(x, window, least, onward=False):
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, passes_of[start], np.int64)),
                     pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
            reach = 4 * window
            edges = [(1, range(start, min(start + reach, stop)), start == 0), (2, range(max(stop - reach, start), stop), stop == len(passes_of))]
            for kind, span, at_end in edges:
                n = len(span)
                if at_end and n:
                    own = rows.slice(span[0], n).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), own["pass"].combine_chunks(),
                         own["cid"].combine_chunks(), pa.nulls(n, pa.int64()), own["key"].combine_chunks(), own["vec"].combine_chunks()], names)

    found = staged(ordered.mapInArrow(compare, "kind int, part int, pass bigint, a bigint, b bigint, key bigint, vec binary"))

    def across(rows: pa.Table) -> pa.Table:
        """Links between the end of one range and the start of the next, of one pass."""
        rows = rows.sort_by([("kind", "descending"), ("key", "ascending"), ("a", "ascending")])
        split = int((rows["kind"].to_numpy() == 2).sum())
        out = []
        if 0 < split < rows.num_rows:
            x, ids = _vectors(rows["vec"].combine_chunks()), rows["a"].to_numpy()
            out = [(ids[i], ids[j]) for i, j in window_pairs(x, window, least, split, onward=False)]
        i = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in out)])
        j = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in out)])
        return pa.table({"a": np.minimum(i, j), "b": np.maximum(i, j)})

    edges = found.where("kind > 0").withColumn("border", F.col("part") + F.when(F.col("kind") == 2, 1).otherwise(0))
    borders = edges.groupBy("pass", "border").applyInArrow(across, "a bigint, b bigint")
    return found.where("kind = 0").select("a", "b").union(borders).distinct()


def completed(held: DataFrame, least: float) -> DataFrame:
    """(cid, linked, other): links of the members of open components to all vectors of held, in parts to be added up.

    held: (cid, vec, key, copies, own): own is the open component of a vector, or null; key are its bits in the first
    pass. linked counts copies; other is a linked member of another component than that of cid, or null. A cell has
    about CELL_BYTES of vectors at most, or 256 of them where these are longer.
    """
    rows = F.greatest(F.floor(F.lit(CELL_BYTES) / F.length("vec")), F.lit(256))
    sizes = held.where("own is not null").groupBy("own").agg(
        F.count("*").alias("size"), F.max(rows).alias("rows")).withColumnRenamed("own", "of")
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.col("rows")))).cast("int")
    members = held.where("own is not null").join(sizes, F.col("own") == F.col("of")).withColumn(
        "prefix", F.floor(F.col("key") / F.pow(F.lit(2.0), BITS - depth)).cast("bigint"))
    counts = members.groupBy("own", "prefix").agg(F.ceil(F.count("*") / F.max("rows")).alias("salts")).select(
        F.col("own").alias("of_own"), F.col("prefix").alias("of_prefix"), "salts")
    members = members.join(counts, (F.col("own") == F.col("of_own")) & (F.col("prefix") == F.col("of_prefix"))).select(
        F.xxhash64("own", "prefix", F.pmod(F.xxhash64("cid"), "salts")).alias("cell"), "cid", "vec", "copies", "own")
    members = staged(members)
    reach = float(np.arccos(least)) + 1e-6

    def shape(rows_of: pa.Table) -> pa.Table:
        """Centre of a cell and the least cosine to it of a vector that can be linked to a member."""
        x = _vectors(rows_of["vec"].combine_chunks())
        c = x.sum(0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
        widest = float(np.arccos(np.clip((x @ c).min(), -1, 1))) + reach
        low = float(np.cos(widest)) if widest < np.pi else -2.0
        return pa.table({"cell": rows_of["cell"].slice(0, 1), "centre": pa.array([c.astype("<f8").tobytes()], pa.binary()), "low": [low]})

    pivots = staged(members.groupBy("cell").applyInArrow(shape, "cell bigint, centre binary, low double"))
    packs, blocks = -(-pivots.count() // PACK), int(np.ceil(held.agg(F.sum(1 / rows)).first()[0]))
    held = held.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int"))
    spread = pivots.select("*", F.length("centre").alias("size"), F.pmod(F.xxhash64("cell"), F.lit(packs)).cast("int").alias("pack")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = held.select("block", "cid", "vec", F.length("vec").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))

    def candidates(vectors: pa.Table, cells: pa.Table) -> pa.Table:
        """The vectors of a block that may be linked to a member of a cell."""
        if not vectors.num_rows or not cells.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "cid": pa.array([], pa.int64())})
        x, c = _vectors(vectors["vec"].combine_chunks()), _vectors(cells["centre"].combine_chunks())
        i, k = np.nonzero(x @ c.T >= cells["low"].to_numpy())
        return pa.table({"cell": cells["cell"].to_numpy()[k], "block": np.full(len(i), vectors["block"][0].as_py(), np.int32),
                         "cid": vectors["cid"].to_numpy()[i]})

    near = staged(asked.groupBy("block", "pack", "size").cogroup(spread.groupBy("block", "pack", "size")).applyInArrow(
        candidates, "cell bigint, block int, cid bigint"))
    met = near.select(F.col("cell").alias("met"), F.col("block").alias("met_block")).distinct()
    left = near.join(held.select(F.col("cid").alias("held_id"), "vec", "copies", "own"), F.col("cid") == F.col("held_id"))
    left = left.select(F.col("cell").alias("met"), F.col("block").alias("met_block"), "cid", "vec", "copies", "own")
    right = met.join(members, F.col("met") == F.col("cell"))

    def compare(vectors: pa.Table, cell: pa.Table) -> pa.Table:
        x, y = _vectors(vectors["vec"].combine_chunks()), _vectors(cell["vec"].combine_chunks())
        ids, member_ids = vectors["cid"].to_numpy(), cell["cid"].to_numpy()
        weights, member_weights = vectors["copies"].to_numpy().astype(float), cell["copies"].to_numpy().astype(float)
        home, here = vectors["own"].to_pylist(), cell["own"][0].as_py()
        alone = np.array([h is None for h in home])
        foreign = np.array([h != here for h in home])
        linked, other = np.zeros(len(x)), np.full(len(x), -1)
        back = np.zeros(len(y))
        for at in range(0, len(x), 512):
            part = slice(at, at + 512)
            hit = (x[part] @ y.T >= least) & (ids[part, None] != member_ids)
            linked[part] = hit @ member_weights
            back += (weights[part] * alone[part]) @ hit
            other[part] = np.where(hit.any(1), hit.argmax(1), -1)
        some, backs = np.flatnonzero(linked), np.flatnonzero(back)
        named = foreign[some]
        return pa.table({
            "cid": np.concatenate((ids[some], member_ids[backs])),
            "linked": np.concatenate((linked[some], back[backs])).astype(np.int64),
            "other": pa.concat_arrays([pa.array(member_ids[other[some]], pa.int64(), mask=~named), pa.nulls(len(backs), pa.int64())])})

    return left.groupBy("met", "met_block").cogroup(right.groupBy("met", "met_block")).applyInArrow(
        compare, "cid bigint, linked bigint, other bigint")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE,
                    passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module for rows that link with nothing."""
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.withColumn("sound", F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    alone = rows.where("not sound").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    whole = staged(rows.where("sound").select("vec_id", "v", F.xxhash64("v").alias("v_hash")))
    classes = staged(whole.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select(
        "v", "least", "copies", F.sha2(F.to_json(F.struct("v")), 256).alias("digest")))
    classes = staged(classes.withColumn("cid", F.xxhash64("digest")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = own.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(own.num_rows, -1)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
                yield pa.RecordBatch.from_arrays(
                    [own.column("cid"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(order_keys(x, 0)), own.column("copies")],
                    ["cid", "vec", "key", "copies"])

    packed = staged(classes.select("cid", "v", "copies").mapInArrow(pack, "cid bigint, vec binary, key bigint, copies bigint"))
    pairs = staged(links(packed.select("cid", "vec"), passes, window, least))
    found = components(pairs)
    large = found.groupBy("component").count().where(F.col("count") > window // 2).select(F.col("component").alias("own"))
    held = staged(packed.join(found.join(large, F.col("component") == F.col("own")).select("node", "own"), F.col("cid") == F.col("node"), "left").select(
        "cid", "vec", "key", "copies", "own"))
    ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    copies = held.where("own is null").select(F.col("cid").alias("other"), "copies")
    parts = ends.select("e.a", "e.b").join(copies, F.col("b") == F.col("other")).select("a", F.col("copies").alias("n"))
    if held.where("own is not null").limit(1).count():
        more = staged(completed(held, least))
        parts = parts.union(more.select("cid", "linked"))
        across = more.where("other is not null").select("cid", "other")
        if across.limit(1).count():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(across))
    degree = parts.groupBy("a").agg(F.sum("n").alias("linked"))
    named = classes.join(degree, F.col("cid") == F.col("a"), "left").join(found, F.col("cid") == F.col("node"), "left").select(
        "v", "least", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "cid").alias("component"))
    named = staged(named)
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(first, "component").select(
        F.col("v").alias("class_v"), F.xxhash64("v").alias("class_hash"),
        (F.col("linked") + F.col("copies") - 1).cast("bigint").alias("n_links"), "component_id")
    joined = whole.join(named, (whole.v_hash == named.class_hash) & (whole.v == named.class_v)).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return joined.unionByName(alone)
