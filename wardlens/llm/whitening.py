"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

An entry ``c`` becomes the whole number ``x = floor(1024 c) + 100000``.  The exact sums per dimension centre the rows;
every task reduces its centred rows to one triangle by QR, a block of rows at a time, and the triangles of the tasks are
stacked and reduced again, a bounded number in each group.  The last triangle (dimensions x dimensions, whatever the
number of rows) is bidiagonalised by Householder reflections; dqds gives its singular values, to high relative
accuracy, from which the covariance's eigenvalues follow; twisted factorisations of ``B'B - e`` give the eigenvectors.
Eigenvalues that lie closely together get their vectors by a few solves with the twisted factors, orthogonalised
against each other.  The covariance matrix itself is never formed.

Defined cases: rows whose vector is null or holds null or non-finite entries, or has another length than most rows' (of
lengths equally frequent the larger; no entries count as null), are dropped; rows without vec_id are rows like others;
repeated rows count each; components whose eigenvalue is zero to working precision do not exist (equal vectors, or a
single one, give no row); fewer dimensions than components give as many components as there are; entries of 2 ** 50 or more
and squared deviations beyond 64 bits are an error; empty input gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import column, rows

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows that one QR step takes; groups of the levels that merge the tasks' results.
BLOCK = 2048
LEVELS = (256, 16)
#: Entries from this size on are an error.
MOST = 2.0 ** 50
#: Eigenvalues closer than this, relatively, get orthogonalised vectors.
CLOSE = 1e-3
#: Solves with the twisted factors for a vector of close eigenvalues.
SOLVES = 8
EPS = np.finfo(float).eps

_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


# ------------------------------------------------------------------ the small dense part
def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``V`` of ``r = U B V'`` by Householder reflections."""
    a = r.copy()
    n = a.shape[0]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)
    for i in range(n):
        if (w := reflector(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(w, w @ a[i:, i:])
        if i + 2 < n and (w := reflector(a[i, i + 1:])) is not None:
            a[i:, i + 1:] -= 2 * np.outer(a[i:, i + 1:] @ w, w)
            v[:, i + 1:] -= 2 * np.outer(v[:, i + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B'B`` from the squares of a bidiagonal's entries, rising; differential qd with shifts."""
    found: list[float] = []
    work = [(q.astype(float).tolist(), e.astype(float).tolist(), 0.0)]
    while work:
        q, e, total = work.pop()
        while q:
            if len(q) == 1:
                found.append(q[0] + total)
                break
            split = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (total + q[i]) or e[i] == 0), None)
            if split is not None:
                work.append((q[:split + 1], e[:split], total))
                q, e = q[split + 1:], e[split + 1:]
                continue
            if e[-1] <= EPS * EPS * (total + q[-1]):
                found.append(q.pop() + total)
                e.pop()
                continue
            # a lower bound of the least eigenvalue from the last rows; a step that fails is tried with less
            shift = max(0.0, min(q[-1] - np.sqrt(q[-1] * e[-1]), min(q)))
            while True:
                d, nq, ne, bad = q[0] - shift, [], [], False
                for i in range(len(e)):
                    top = d + e[i]
                    if d < 0 or not top > 0:
                        if shift > 0:
                            bad = True
                            break
                        ratio = 0.0 if e[i] == 0 else q[i + 1] / e[i]
                        top = max(top, 0.0)
                    else:
                        ratio = q[i + 1] / top
                    nq.append(top)
                    ne.append(e[i] * ratio if top else 0.0)
                    d = d * ratio - shift
                if bad or d < 0:
                    if shift == 0:
                        d = 0.0
                    else:
                        shift = shift / 4 if shift > EPS * (total + q[-1]) else 0.0
                        continue
                q, e, total = [*nq, d], ne, total + shift
                break
    return np.sort(np.array(found))


def _twisted(a: np.ndarray, b: np.ndarray, value: float, scale: float) -> tuple:
    """Both factorisations of ``B'B - value``: pivots and multipliers from above and below, and the twist elements."""
    n = len(a)
    q, e, off = a * a, b * b, a[:-1] * b
    tiny = EPS * max(scale, 1e-280) * 1e-3
    down, low, s = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for i in range(n):
        down[i] = q[i] + s[i]
        if abs(down[i]) < tiny:
            down[i] = -tiny
        if i < n - 1:
            low[i] = off[i] / down[i]
            s[i + 1] = e[i] * (s[i] / down[i]) - value
    up, high, p = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = e[i] + p[i + 1]
        if abs(up[i + 1]) < tiny:
            up[i + 1] = -tiny
        high[i] = off[i] / up[i + 1]
        p[i] = q[i] * (p[i + 1] / up[i + 1]) - value
    up[0] = p[0]
    return down, low, up, high, s + p + value, tiny


def _solve(factors, k: int, y: np.ndarray) -> np.ndarray:
    """The solution of the twisted system with its twist at ``k``."""
    down, low, up, high, gamma, tiny = factors
    n = len(y)
    z = y.astype(float).copy()
    for i in range(k):
        z[i + 1] -= low[i] * z[i]
    for i in range(n - 2, k - 1, -1):
        z[i] -= high[i] * z[i + 1]
    z[:k] /= down[:k]
    z[k + 1:] /= up[k + 1:]
    z[k] /= gamma[k] if abs(gamma[k]) > tiny else tiny
    for i in range(k - 1, -1, -1):
        z[i] -= low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] -= high[i] * z[i]
    return z


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of ``B'B`` for its falling eigenvalues ``values``, orthogonal to each other."""
    n, out = len(a), []
    scale = float(values[0]) if len(values) else 0.0
    # an off-diagonal that is nothing beside its neighbours splits the matrix
    cuts = [0, *(i + 1 for i in range(n - 1) if abs(a[i] * b[i]) <= EPS * scale and b[i] * b[i] <= EPS * scale), n]
    rng = np.random.default_rng(3)
    for at, value in enumerate(values):
        close = [out[i] for i in range(at) if abs(values[i] - value) <= CLOSE * max(abs(value), EPS * scale)]
        best = None
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            factors = _twisted(a[lo:hi], b[lo:hi - 1], float(value), scale)
            k = int(np.argmin(np.abs(factors[4])))
            if best is None or abs(factors[4][k]) < best[0]:
                z = np.zeros(n)
                part = np.zeros(hi - lo)
                part[k] = 1.0
                for i in range(k - 1, -1, -1):
                    part[i] = -factors[1][i] * part[i + 1]
                for i in range(k, hi - lo - 1):
                    part[i + 1] = -factors[3][i] * part[i]
                z[lo:hi] = part
                best = abs(factors[4][k]), z / np.linalg.norm(z)
        z = best[1]
        if close:
            near = np.array(close)
            for step in range(SOLVES + 1):
                rest = z - near.T @ (near @ z)
                if np.linalg.norm(rest) < 0.5 * np.linalg.norm(z):
                    # too much of an earlier one: begin anew from all directions
                    if step == 0:
                        rest = rng.standard_normal(n)
                        rest -= near.T @ (near @ rest)
                rest -= near.T @ (near @ rest)
                z = rest / np.linalg.norm(rest)
                if step == SOLVES:
                    break
                solved = np.zeros(n)
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    factors = _twisted(a[lo:hi], b[lo:hi - 1], float(value), scale)
                    solved[lo:hi] = _solve(factors, int(np.argmin(np.abs(factors[4]))), z[lo:hi])
                if np.isfinite(solved).all() and np.linalg.norm(solved) > 0:
                    z = solved / np.linalg.norm(solved)
            z = z - near.T @ (near @ z)
            z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out).T if out else np.zeros((n, 0))


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenvalues of ``r'r``, their vectors as columns, and the sum of all eigenvalues."""
    a, b, v = bidiagonalise(r)
    values = dqds(a * a, b * b)[::-1]
    total = float((r * r).sum())
    real = values > (values[0] * EPS * EPS * len(values) ** 2 if len(values) else 0) if total > 0 else np.zeros(len(values), bool)
    kept = values[real][:most]
    vectors = v @ right_vectors(a, b, kept)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if vectors.size else 1.0
    return kept, vectors, total


# ------------------------------------------------------------------ the rows
def _whole(batches: Iterable[pa.RecordBatch], width: int, size: int = BLOCK) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(vec_id, x)`` of the rows in use, a block at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            lists = column(part, "embedding")
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False)).astype(bool)
            part = part.filter(pa.array(fits))
            if not part.num_rows:
                continue
            flat = pc.fill_null(column(part, "embedding").flatten(), float("nan"))
            c = np.asarray(flat).astype(float).reshape(part.num_rows, width)
            good = np.isfinite(c).all(1)
            if (np.abs(c[good]) >= MOST).any():
                raise ArithmeticError("an entry is too large for whole numbers of 64 bits")
            if good.any():
                yield column(part, "vec_id").filter(pa.array(good)), np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def reduced(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The payloads of ``parts(payload)`` merged: level by level in a bounded number of groups, the last level here."""
    def group(table: pa.Table) -> pa.Table:
        return pa.table({"payload": pa.array([merge(table["payload"].to_pylist())], pa.binary())})
    for level in LEVELS:
        parts = parts.groupBy(F.pmod(F.xxhash64("payload"), F.lit(level)).alias("g")).applyInArrow(group, "payload binary")
    last = [bytes(r["payload"]) for r in parts.collect()]  # at most LEVELS[-1] payloads
    return merge(last) if last else None


def _sums(width: int):
    def merge(found: list[bytes]) -> bytes:
        # sums beyond 64 bits are carried as whole numbers in text
        each = [[int(v) for v in f.split(b",")] for f in found]
        return ",".join(str(sum(col)) for col in zip(*each)).encode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for _, x in _whole(batches, width):
            total = [t + int(v) for t, v in zip(total, [len(x), *x.sum(0)])]
        if total[0]:
            yield pa.record_batch({"payload": pa.array([",".join(map(str, total)).encode()], pa.binary())})
    return run, merge


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n x - S``, exact: 64 bits where they suffice."""
    if n * (int(np.abs(x).max()) + 1) + max(map(abs, s)) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _triangles(width: int, n: int, s: list[int]):
    def merge(found: list[bytes]) -> bytes:
        out = np.zeros((0, width))
        for f in found:
            out = np.linalg.qr(np.vstack([out, np.frombuffer(f).reshape(-1, width)]), mode="r")
        return out.tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _whole(batches, width):
            block = _centred(x, n, s).astype(float) / n
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        if r is not None:
            yield pa.record_batch({"payload": pa.array([r.tobytes()], pa.binary())})
    return run, merge


def _moments(width: int, n: int, s: list[int], axes: np.ndarray):
    k = axes.shape[1]

    def merge(found: list[bytes]) -> bytes:
        count, mean, square = 0.0, np.zeros(k), np.zeros((k, k))
        for f in found:
            own = np.frombuffer(f)
            c, m, q = own[0], own[1:k + 1], own[k + 1:].reshape(k, k)
            gap, both = m - mean, count + c
            square = square + q + np.outer(gap, gap) * (count * c / both)
            mean, count = mean + gap * (c / both), both
        return np.concatenate([[count], mean, square.ravel()]).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, x in _whole(batches, width):
            y = (_centred(x, n, s).astype(float) / n) @ axes
            m = y.mean(0)
            own = np.concatenate([[len(y)], m, ((y - m).T @ (y - m)).ravel()]).tobytes()
            held = [merge([*held, own])]
        if held:
            yield pa.record_batch({"payload": pa.array(held, pa.binary())})
    return run, merge


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row in use of
    ``vectors(vec_id, embedding)`` and each of the leading components."""
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    common = plain.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite) \
        .groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("rows")) \
        .orderBy(F.desc("rows"), F.desc("width")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], ddl)
    width = common["width"]
    run, merge = _sums(width)
    n, *s = (int(v) for v in reduced(plain.select("embedding", F.lit(0).alias("vec_id")).mapInArrow(run, "payload binary"), merge).split(b","))
    run, merge = _triangles(width, n, s)
    r = np.frombuffer(reduced(plain.select("embedding", F.lit(0).alias("vec_id")).mapInArrow(run, "payload binary"), merge)).reshape(-1, width)
    square = np.vstack([r, np.zeros((max(0, width - len(r)), width))])[:width]
    values, axes, total = principal(square, components)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], ddl)
    scaled = axes / np.sqrt(values / n)
    run, merge = _moments(width, n, s, scaled)
    whole = np.frombuffer(reduced(plain.select("embedding", F.lit(0).alias("vec_id")).mapInArrow(run, "payload binary"), merge))
    error = float(np.abs(whole[k + 1:].reshape(k, k) / n - np.eye(k)).max())
    explained = values / total

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _whole(batches, width):
            gap = _centred(x, n, s)
            if gap.dtype != object and float(np.abs(gap).max()) ** 2 * width >= 2.0 ** 62:
                gap = gap.astype(object)
            deviation = [int(v) for v in (gap * gap).sum(1)]
            if max(deviation) >= 1 << 63:
                raise ArithmeticError("a squared deviation does not fit into 64 bits")
            y = (gap.astype(float) / n) @ scaled
            each = np.repeat(np.arange(len(y)), k)
            yield rows(_OUT, ids.take(pa.array(each)), np.tile(np.arange(1, k + 1), len(y)), np.full(len(each), n),
                       pa.array(deviation, pa.int64()).take(pa.array(each)), y.ravel(), np.tile(explained, len(y)), np.full(len(each), error))
    return plain.mapInArrow(project, ddl)
