"""Whitening of vectors by a bidiagonal qd solver.

Centred rows are reduced to one triangle by QR, block by block in each task and then up a tree of triangles; Gram
matrices, which square the condition, are never formed. Householder reflections bring the triangle to bidiagonal form,
dqds with shifts finds its singular values to high relative accuracy, and twisted factorisations of the bidiagonal's
Gram form give each direction; values that agree to working precision share a subspace, found by inverse iteration with
orthogonalisation. Directions are carried back by the reflections.

A component c counts as x = floor(1024 c) + 100000. Sums of x are whole numbers, so that (n x - S) is exact before it is
divided; `deviation` is exact, and null where it doesn't fit into 64 bits. Tasks hand on one triangle or one set of sums
for each length of vectors they met; no more than a triangle per task group meets in a task. Only one row a length comes
back to all rows: it is broadcast while all of these stay below a stated size, and dealt out by salt beyond it.

Rows with a null vector or with null or non-finite entries are left out. Vectors of different length have no common
covariance: each length is a list of its own. A direction without variance has no scale: components end where the
eigenvalue is zero to working precision, so a list of equal vectors (or one vector, or empty ones) gives no rows. Repeated
rows and ids count as rows of their own; null ids are kept. Signs: the entry of largest size is positive. An entry whose x
has no exact double (2**53 and beyond) is an error. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import hypot, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helmline.llm.common import shuffle_partitions, staged

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(np.float64).eps)
#: Rows that enter a QR step at a time, and bytes of models up to which they are broadcast.
ROWS = 2048
MODEL_BYTES = 64 << 20
#: Eigenvalues this close, relatively, share a subspace.
TOGETHER = 1e-7


# --- the solver ---------------------------------------------------------------------------------------------------


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of an upper bidiagonal matrix with the singular values of r."""
    a = r.astype(np.float64).copy()
    n = a.shape[1]
    right: list[np.ndarray] = []
    for k in range(n):
        for part, row in ((a[k:, k], False), (a[k, k + 1:], True)):
            if row and k >= n - 2:
                continue
            v = part.copy()
            scale = np.abs(v).max(initial=0)
            if len(v) < 2 or not np.abs(v[1:]).max(initial=0):
                v[:] = 0
            else:
                v /= scale
                v[0] += np.copysign(np.linalg.norm(v), v[0])
                v /= np.linalg.norm(v)
                if row:
                    a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                else:
                    a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
            if row:
                right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def carried_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Columns z of the bidiagonal's row space in the coordinates of the triangle."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        z[k + 1:] -= 2 * np.outer(v, v @ z[k + 1:])
    return z


def dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd step with shift; the least of the d, below zero if the shift was too large."""
    out_q, out_e, d = [], [], q[0] - shift
    least = d
    for i in range(len(e)):
        t = d + e[i]
        if d < 0 or not t > 0:
            return q, e, -1.0
        out_q.append(t)
        ratio = q[i + 1] / t
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    out_q.append(d)
    return out_q, out_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds with deflation."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    stack = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (above / scale) ** 2], 0.0)]
    found: list[float] = []
    while stack:
        q, e, sigma = stack.pop()
        guess = None
        while q:
            n = len(q)
            if n == 1:
                found.append(q.pop() + sigma)
                continue
            tiny = (10 * EPS) ** 2
            # Zeros inside cut the matrix; the parts go on by themselves.
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * max(sigma, q[i], q[i + 1]) or e[i] < 1e-300), None)
            if cut is not None:
                if cut == n - 2:
                    found.append(q.pop() + sigma)
                    e.pop()
                    guess = None
                    continue
                stack.append((q[:cut + 1], e[:cut], sigma))
                q, e, guess = q[cut + 1:], e[cut + 1:], None
                continue
            if q[0] < q[-1] * 0.25:  # graded the wrong way: the last values would converge slowly
                q, e = reversed_qd(q, e)
                guess = None
            if guess is None:
                # The lesser eigenvalue of the last two rows: close to the least value once e is small.
                a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], sqrt(q[-2] * e[-1])
                half = (a - b) / 2
                guess = max(0.0, b - c * c / (abs(half) + hypot(half, c)) if half >= 0 else a - c * c / (abs(half) + hypot(half, c)))
            for shift in (guess, guess * (1 - 1e-4), guess * 0.75, guess * 0.1, 0.0):
                new_q, new_e, least = dqds(q, e, shift)
                if least >= 0:
                    break
            else:  # rounding at zero: the least value is zero to working precision
                new_q, new_e, shift, least = q, [*e[:-1], 0.0], 0.0, 0.0
            q, e, sigma = new_q, new_e, sigma + shift
            guess = None if least > 0 or shift else 0.0
            if guess == 0.0 and q[-1] == 0.0:
                e[-1] = 0.0
                guess = None
    return np.sort(np.array(found))[::-1] * scale * scale


def reversed_qd(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the flipped transpose: its diagonals in reverse order, its singular values the same."""
    return q[::-1], e[::-1]


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The eigenvector of B'B for an eigenvalue, from the twisted factorisation with the least pivot."""
    n = len(diagonal)
    d = diagonal * diagonal
    low = np.divide(above, diagonal[:-1], out=np.zeros(n - 1), where=diagonal[:-1] != 0)
    floor = EPS * EPS * max(d.max(initial=0), value, 1e-300)
    s, plus_l, plus = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):  # from the top: L D L' - value = L+ D+ L+'
        plus[i] = d[i] + s[i]
        if abs(plus[i]) < floor:
            plus[i] = -floor
        plus_l[i] = low[i] * d[i] / plus[i]
        s[i + 1] = plus_l[i] * low[i] * s[i] - value
    p, minus_u = np.empty(n), np.empty(n - 1)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):  # from the bottom: = U- D- U-'
        minus = d[i] * low[i] * low[i] + p[i + 1]
        if abs(minus) < floor:
            minus = -floor
        minus_u[i] = low[i] * d[i] / minus
        p[i] = p[i + 1] * d[i] / minus - value
    pivots = np.abs(s + p + value)
    r = int(np.argmin(pivots))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus_l[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus_u[i] * z[i]
    return z / np.linalg.norm(z)


def shared_subspace(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal directions for eigenvalues of B'B that agree to working precision, by inverse iteration."""
    n, m = len(diagonal), len(values)
    main = diagonal * diagonal
    main[1:] += above * above
    side = above * diagonal[:-1]
    z = np.random.default_rng(7).standard_normal((n, m))
    top = max(np.abs(main).max(initial=0), 1e-300)
    for turn in range(4):
        for j in range(m):
            z[:, j] = solved_tridiagonal(main - values[j] * (1 - (j + 1) * 2 * EPS), side, z[:, j], EPS * top)
        z = np.linalg.qr(z)[0]
    return z


def solved_tridiagonal(main: np.ndarray, side: np.ndarray, right: np.ndarray, floor: float) -> np.ndarray:
    """x with T x = right for a symmetric tridiagonal T, by elimination with row exchanges."""
    n = len(main)
    a, b, c, x = main.astype(float).copy(), np.append(side, 0.0), np.zeros(n), right.copy()
    below = side.astype(float).copy()
    for i in range(n - 1):
        if abs(below[i]) > abs(a[i]):  # exchange rows i and i + 1
            a[i], below[i] = below[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(a[i]) < floor:
            a[i] = floor
        f = below[i] / a[i]
        a[i + 1] -= f * b[i]
        b[i + 1] -= f * c[i]
        x[i + 1] -= f * x[i]
    if abs(a[n - 1]) < floor:
        a[n - 1] = floor
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (b[i] * x[i + 1] if i + 1 < n else 0) - (c[i] * x[i + 2] if i + 2 < n else 0)) / a[i]
        if abs(x[i]) > 1e100:
            x *= 1e-100
    return x / np.linalg.norm(x)


def directions(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; right singular vectors as rows) of a triangle, at most `most` above zero."""
    n = r.shape[1]
    if len(r) < n:
        r = np.concatenate([r, np.zeros((n - len(r), n))])
    diagonal, above, right = bidiagonalised(r)
    values = squared_singular_values(diagonal, above)
    kept = values[:most][values[:most] > (n * EPS) ** 2 * values[:1].sum()]
    if not len(kept):
        return kept, np.zeros((0, n))
    # A zero on the diagonal would stop the factorisations; one far below the rounding of the matrix changes nothing.
    safe = np.where(np.abs(diagonal) < EPS * EPS * sqrt(values[0]), EPS * EPS * sqrt(values[0]), diagonal)
    z = np.zeros((n, len(kept)))
    at = 0
    while at < len(kept):
        to = at + 1
        while to < len(values) and values[to - 1] - values[to] <= TOGETHER * values[to - 1]:
            to += 1
        if to - at == 1:
            z[:, at] = twisted_vector(safe, above, values[at])
        else:
            z[:, at:to] = shared_subspace(safe, above, values[at:to])[:, :len(kept) - at]
        at = to
    v = carried_back(z, right).T
    flip = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return kept, v * flip[:, None]


# --- Spark --------------------------------------------------------------------------------------------------------


def numbers(lists: pa.Array) -> np.ndarray:
    """floor(1024 c) + 100000 of lists of one length, as 64-bit numbers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * flat) + OFFSET
    if np.abs(x).max(initial=0) >= 1 << 53:
        raise ValueError("an entry is too large to be whitened exactly")
    return x.astype(np.int64).reshape(len(lists), -1 if len(flat) else 0)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each batch by vector length."""
    for batch in batches:
        dims = batch.column("dims").to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            for at in range(0, part.num_rows, ROWS):
                yield d, part.slice(at, ROWS)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, divided only after n x - S is exact."""
    return deviations(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in 64 bits where they hold it, else in Python's numbers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def exact_squares(dev: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, null where 64 bits don't hold it."""
    most = int(np.abs(dev).max(initial=0))
    if most * most * max(dev.shape[1], 1) < 1 << 63:
        return (dev * dev).sum(1).tolist()
    exact = (dev.astype(object) ** 2).sum(1) if dev.shape[1] else [0] * len(dev)
    return [int(s) if s < 1 << 63 else None for s in exact]


def merged(parts: DataFrame, fold: Callable[[list[dict]], dict], schema: str) -> DataFrame:
    """One row a length from parts (dims, ...): fold takes the rows of a group, up a tree of groups.

    The first level takes the parts of as many tasks as there are shuffle partitions into one, the second about the root
    of these, the last what is left.
    """
    p = shuffle_partitions(parts.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([fold(table.drop_columns(["grp"]).to_pylist()) | {"grp": table["grp"][0].as_py()}], target)

    fields = [f.split() for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    target = pa.schema([(name, types[kind]) for name, kind in fields] + [("grp", pa.int32())])
    held = parts.withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(p)))
    for k in (p, isqrt(p) + 1, 1):
        held = held.withColumn("grp", F.pmod("grp", F.lit(k))).groupBy("dims", "grp").applyInArrow(run, f"{schema}, grp int")
    return held.drop("grp")


def prepared(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, dims) of the rows that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v")).where(F.coalesce(sound, F.lit(False)))
    return rows.withColumn("dims", F.size("v"))


def sums(rows: DataFrame) -> DataFrame:
    """(dims, n, total): the number of vectors of each length and the exact sum of each dimension, as digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for d, part in by_length(batches):
            own = held.setdefault(d, [0, [0] * d])
            own[0] += part.num_rows
            x = numbers(part.column("v"))
            exact = x.sum(0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(0)
            own[1] = [a + int(b) for a, b in zip(own[1], exact)]
        if held:
            yield pa.RecordBatch.from_pylist([{"dims": d, "n": n, "total": list(map(str, t))} for d, (n, t) in held.items()],
                                             pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))]))

    def fold(parts: list[dict]) -> dict:
        totals = [str(sum(map(int, column))) for column in zip(*(p["total"] for p in parts))]
        return {"dims": parts[0]["dims"], "n": sum(p["n"] for p in parts), "total": totals}

    schema = "dims int, n bigint, total array<string>"
    return merged(rows.select("v", "dims").mapInArrow(run, schema), fold, schema)


def with_model(rows: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """rows with the columns of their length's row in model, of `size` bytes in all."""
    held = model.withColumnRenamed("dims", "of")
    if size <= MODEL_BYTES:
        return rows.join(F.broadcast(held), rows.dims == held.of).drop("of")
    salts = shuffle_partitions(rows.sparkSession)
    held = held.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(held, (salted.dims == held.of) & (salted.salt == held.of_salt)).drop("of", "of_salt", "salt")


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """The triangle of the QR of blocks of rows on top of each other; the orthogonal factor is not kept."""
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def packed(r: np.ndarray) -> bytes:
    return r.astype("<f8").tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dims)


def triangles(rows: DataFrame) -> DataFrame:
    """(dims, r) of rows (v, dims, n, total): the triangle of the centred rows of each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, part in by_length(batches):
            n, total = part.column("n")[0].as_py(), list(map(int, part.column("total")[0].as_py()))
            x = centred(numbers(part.column("v")), n, total)
            held[d] = triangle([held[d], x] if d in held else [x]) if d else np.zeros((0, 0))
        if held:
            yield pa.RecordBatch.from_pylist([{"dims": d, "r": packed(r)} for d, r in held.items()],
                                             pa.schema([("dims", pa.int32()), ("r", pa.binary())]))

    def fold(parts: list[dict]) -> dict:
        d = parts[0]["dims"]
        return {"dims": d, "r": packed(triangle([unpacked(p["r"], d) for p in parts])) if d else b""}

    return merged(rows.select("v", "dims", "n", "total").mapInArrow(run, "dims int, r binary"), fold, "dims int, r binary")


def solved(found: DataFrame, most: int) -> DataFrame:
    """(dims, n, total, axes, values, trace) of each length's triangle; axes has a row per component, scaled to whiten."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                d, n = row["dims"], row["n"]
                r = unpacked(row.pop("r"), d) if d else np.zeros((0, 0))
                values, v = directions(r, most) if d else (np.zeros(0), np.zeros((0, 0)))
                out.append(row | {"axes": packed(v / np.sqrt(values / n)[:, None]), "eigen": packed(values / n), "trace": float((r * r).sum() / n)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("dims", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string())), ("axes", pa.binary()), ("eigen", pa.binary()), ("trace", pa.float64())]))

    return found.mapInArrow(run, "dims int, n bigint, total array<string>, axes binary, eigen binary, trace double")


def projected(part: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, whitened components) of rows of one length with their model."""
    n, total = part.column("n")[0].as_py(), list(map(int, part.column("total")[0].as_py()))
    dev = deviations(numbers(part.column("v")), n, total)
    axes = unpacked(part.column("axes")[0].as_py(), d) if d else np.zeros((0, 0))
    return dev, (dev.astype(np.float64) / n) @ axes.T


def scatter(rows: DataFrame) -> DataFrame:
    """(dims, n, mean, scatter) of the whitened rows of each length; scatter is centred before it is multiplied."""
    schema = "dims int, n bigint, mean binary, scatter binary"

    def joined(a: tuple, b: tuple) -> tuple:
        (n, m, s), (k, o, t) = a, b
        gap = o - m
        return n + k, m + gap * (k / (n + k)), s + t + np.outer(gap, gap) * (n * k / (n + k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for d, part in by_length(batches):
            w = projected(part, d)[1]
            c = w - w.mean(0)
            own = (len(w), w.mean(0), c.T @ c)
            held[d] = joined(held[d], own) if d in held else own
        if held:
            yield pa.RecordBatch.from_pylist(
                [{"dims": d, "n": n, "mean": packed(m), "scatter": packed(s)} for d, (n, m, s) in held.items()],
                pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary())]))

    def fold(parts: list[dict]) -> dict:
        whole = None
        for p in parts:
            mean = np.frombuffer(p["mean"], "<f8")
            own = (p["n"], mean, unpacked(p["scatter"], len(mean)) if len(mean) else np.zeros((0, 0)))
            whole = own if whole is None else joined(whole, own)
        return {"dims": parts[0]["dims"], "n": whole[0], "mean": packed(whole[1]), "scatter": packed(whole[2])}

    return merged(rows.mapInArrow(run, schema), fold, schema)


def fit(rows: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, int]:
    """The model of each length, written, and its size in bytes."""
    counted = staged(sums(rows))
    size = lambda df: int(df.agg(F.sum(F.lit(64) + F.col("dims") * (24 + 8 * most))).first()[0] or 0)
    found = triangles(with_model(rows.select("v", "dims"), counted, size(counted)))
    model = staged(solved(counted.join(found, "dims"), most))
    return model, size(model)


def whitened(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part.

    identity_error is the largest absolute entry of the whitened rows' covariance minus the identity, of all rows of the
    same length.
    """
    rows = prepared(df, vec_id, embedding)
    model, size = fit(rows, most)
    kind = df.select(F.col(f"`{vec_id}`").alias("vec_id")).schema["vec_id"].dataType.simpleString()

    def off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k = len(row["mean"]) // 8
                v = unpacked(row["scatter"], k) / row["n"] if k else np.zeros((0, 0))
                out.append({"of": row["dims"], "identity_error": float(np.abs(v - np.eye(k)).max(initial=0))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("of", pa.int32()), ("identity_error", pa.float64())]))

    errors = scatter(with_model(rows.select("v", "dims"), model, size)).mapInArrow(off, "of int, identity_error double")
    known = staged(model.join(errors, model.dims == errors.of).drop("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in by_length(batches):
            dev, w = projected(part, d)
            k = w.shape[1]
            if not k:
                continue
            eigen = np.frombuffer(part.column("eigen")[0].as_py(), "<f8")
            trace, error = part.column("trace")[0].as_py(), part.column("identity_error")[0].as_py()
            rows_of = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                 pa.array(np.full(len(rows_of), part.column("n")[0].as_py(), np.int64)), pa.array(exact_squares(dev), pa.int64()).take(pa.array(rows_of)),
                 pa.array(w.ravel()), pa.array(np.tile(eigen / trace, len(w))), pa.array(np.full(len(rows_of), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return with_model(rows, known, size).mapInArrow(
        run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
