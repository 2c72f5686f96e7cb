"""Vectors of the token table as matrices, and the random rotations that several operators hash with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 256


def matrix(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors float32) of the usable rows: exactly width finite numbers, not all zero."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = sizes == width
    if not right.any():
        return np.empty(0, np.int64), np.empty((0, width), np.float32)
    flat = column.filter(pa.array(right)).flatten()
    holes = flat.null_count > 0
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64 if flat.type == pa.float64() else np.float32, copy=False).reshape(-1, width)
    good = np.isfinite(x).all(axis=1) if not holes else np.isfinite(x.astype(np.float64)).all(axis=1)
    biggest = np.abs(x).max(axis=1, initial=0)
    good &= biggest > 0
    places = np.nonzero(right)[0][good]
    # Scaling first keeps the squares of very large and very small numbers finite and above zero.
    y = x[good].astype(np.float64, copy=False) / biggest[good][:, None]
    return places, (y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]).astype(np.float32)


def rotation(seed: int, rows: int, columns: int) -> np.ndarray:
    """The first columns of a random orthonormal matrix."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows, rows)))
    return q[:, :columns].astype(np.float32)
