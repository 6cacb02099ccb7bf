"""Linear algebra on small matrices and on the Gram sums of large tables.

Tables meet only as D x D sums (vectors.vector_products); decompositions are of those, on the driver. Batched
matrices (one array of rows per batch_id) are worked on where they lie, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loom.operators.vectors import over_block, vector_products

SINGULAR = 1e-12


def check_square(x: np.ndarray) -> None:
    if x.ndim < 2 or x.shape[-1] != x.shape[-2]:
        raise ValueError("square matrices are needed")


def check_symmetric(x: np.ndarray) -> None:
    check_square(x)
    if x.size and np.abs(x - np.swapaxes(x, -1, -2)).max() > 1e3 * np.finfo(float).eps * max(np.abs(x).max(), 1e-300):
        raise ValueError("symmetric matrices are needed")


def inverse(x: np.ndarray) -> np.ndarray:
    """Of (..., n, n). ValueError where elimination with the largest pivots meets one below 1e-12."""
    check_square(x)
    x = np.asarray(x, float)
    n = x.shape[-1]
    out = np.empty_like(x)
    for at in np.ndindex(x.shape[:-2]):
        left = np.concatenate([x[at], np.eye(n)], 1)
        for c in range(n):
            p = c + int(np.abs(left[c:, c]).argmax())
            if abs(left[p, c]) < SINGULAR:
                raise ValueError("singular matrix")
            left[[c, p]] = left[[p, c]]
            left[c] /= left[c, c]
            others = np.arange(n) != c
            left[others] -= np.outer(left[others, c], left[c])
        out[at] = left[:, n:]
    return out


def orthogonalize(x: np.ndarray) -> np.ndarray:
    """Columns of (..., n, m) made orthonormal in their order; columns are first scaled to 1, norms count as at
    least 1e-12, so a dependent column becomes its scaled remainder."""
    x = np.asarray(x, float)
    out = x / np.maximum(np.linalg.norm(x, axis=-2, keepdims=True), SINGULAR)
    for c in range(x.shape[-1]):
        v = out[..., :, c]
        for k in range(c):
            q = out[..., :, k]
            v = v - (q * v).sum(-1, keepdims=True) * q
        out[..., :, c] = v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), SINGULAR)
    return out


def with_signs(vectors: np.ndarray) -> np.ndarray:
    """Each column's sign such that the first of its entries within 1e-6 of the largest is positive."""
    size = np.abs(vectors)
    first = (size >= size.max(-2, keepdims=True) * (1 - 1e-6)).argmax(-2)
    sign = np.sign(np.take_along_axis(vectors, first[..., None, :], -2))
    return vectors * np.where(sign == 0, 1, sign)


def eigen(x: np.ndarray, rank: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(values descending, vectors as columns) of a symmetric matrix; `rank`: only the largest by size."""
    check_symmetric(x)
    values, vectors = np.linalg.eigh(np.asarray(x, float))
    if rank > 0:
        keep = np.sort(np.argsort(-np.abs(values), kind="stable")[:rank])
        values, vectors = values[keep], vectors[:, keep]
    order = np.argsort(-values, kind="stable")
    return values[order], with_signs(vectors[:, order])


def svd_of(x: DataFrame, rank: int = -1, centred: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns, column means) of a table (id, v), from its Gram sums; singular values
    below the resolution of the data become 0."""
    n, sums, gram = vector_products(x)
    mean = sums / max(n, 1)
    if centred:
        gram = gram - n * np.outer(mean, mean)
    values, vectors = eigen((gram + gram.T) / 2, rank)
    s = np.sqrt(np.maximum(values, 0))
    s = np.where(s <= max(n, len(mean)) * np.finfo(float).eps * (s[0] if len(s) else 0), 0, s)
    return s, vectors, mean


def projected(x: DataFrame, vectors: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """(id, y): rows of x (id, v) times the columns of `vectors`, less the mean if given."""

    def work(ids, m, shift, w) -> pa.Table:
        return pa.table({"id": ids, "y": list((m - shift) @ w)})

    return over_block(x, np.zeros(vectors.shape[0]) if mean is None else mean, vectors, work, "id long, y array<double>")


def pca(x: DataFrame, rank: int) -> tuple[DataFrame, np.ndarray]:
    """(table (id, y), components as columns)."""
    _, vectors, mean = svd_of(x, rank, centred=True)
    return projected(x, vectors, mean), vectors


def batched(df: DataFrame, work) -> DataFrame:
    """work(matrix) -> matrix on every row of (batch_id, m array<array<double>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.asarray(work(np.array(m, float))).tolist() for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["batch_id", "m"])

    return df.select("batch_id", "m").mapInArrow(run, "batch_id long, m array<array<double>>")


def batched_cells(df: DataFrame, work) -> DataFrame:
    """(batch_id, i, j, x): the cells of work(matrix), for every row of (batch_id, m array<array<double>>)."""
    from pyspark.sql import functions as F

    cells = batched(df, work).select("batch_id", F.posexplode("m").alias("i", "row"))
    return cells.select("batch_id", "i", F.posexplode("row").alias("j", "x"))


def ridge(gram: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
    """(G + rI)^-1 Q"""
    return np.linalg.solve(gram + r * np.eye(len(gram)), q)


def choose_ridge(fit_g, fit_q, hold_g, hold_q, hold_yy: float, hold_n: int) -> float:
    """The power of ten from 1e-8 to 1e8 with the least squared error on held-out rows, which are known by their
    sums alone: |HW - Y|^2 = tr(W'GW) - 2 tr(W'Q) + |Y|^2. NaN counts as infinite; 1.0 without held-out rows."""
    if not hold_n:
        return 1.0
    values, vectors = np.linalg.eigh((fit_g + fit_g.T) / 2)
    inner = vectors.T @ fit_q
    errors = []
    for power in range(-8, 9):
        with np.errstate(all="ignore"):
            w = vectors @ (inner / (values + 10.0**power)[:, None])
            e = (w * (hold_g @ w)).sum() - 2 * (w * hold_q).sum() + hold_yy
        errors.append(e if np.isfinite(e) else np.inf)
    return 10.0 ** (int(np.argmin(errors)) - 8)


def energy_rank(values: np.ndarray, kept: float, total: float, eps: float) -> int:
    """The least k with kept + the k largest values >= eps * total."""
    running = kept + np.cumsum(np.sort(np.maximum(values, 0))[::-1])
    return 0 if kept >= eps * total else int((running < eps * total).sum()) + 1


def project_out(c: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """(I - BB')C(I - BB')"""
    if basis is None:
        return c
    c = c - basis @ (basis.T @ c)
    return c - (c @ basis) @ basis.T


def grown_basis(c: np.ndarray, basis: np.ndarray | None, eps: float) -> np.ndarray | None:
    """The basis with as many leading directions of what it leaves of c as it takes to hold eps of the energy."""
    total, rest = np.trace(c), project_out(c, basis)
    values, vectors = np.linalg.eigh((rest + rest.T) / 2)
    have = 0 if basis is None else basis.shape[1]
    k = min(energy_rank(values, total - np.trace(rest), total, eps), len(c) - have)
    if k <= 0:
        return basis
    new = vectors[:, ::-1][:, :k]
    return new if basis is None else np.linalg.qr(np.concatenate([basis, new], 1))[0]


def designed(c: np.ndarray, basis: np.ndarray | None, rank: int) -> np.ndarray:
    """The `rank` leading directions outside the basis, over sqrt(3)."""
    rest = project_out(c, basis)
    down = np.linalg.eigh((rest + rest.T) / 2)[1][:, ::-1][:, :rank]
    if basis is not None:
        down = down - basis @ (basis.T @ down)
    return down / np.sqrt(3)
