"""Reduction of cells to Niggli's form, a whole Arrow batch at once, and the sites of structures with it.

The published algorithm works on the metric of a cell, A = a.a, B = b.b, C = c.c, xi = 2 b.c, eta = 2 a.c, zeta = 2 a.b,
with a tolerance of its size. Each pass takes every cell that is not finished one step further; steps that change
a cell send it back to the first. The whole-number matrices of the steps are multiplied up, and the metric is taken
from the first one by their product, so errors do not add up. A cell with lengths or angles that are null, not finite
or out of range, without volume, or not finished after PASSES, gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelode.operators.neighbours import CELL

#: Relative tolerance, as published; passes after which a cell counts as failed.
TOLERANCE, PASSES = 1e-5, 500
_OUT = T.StructType([*(T.StructField(k, T.DoubleType()) for k in CELL), T.StructField("inverse", T.ArrayType(T.DoubleType()))])


def _metric(cells: np.ndarray) -> np.ndarray:
    """Metric tensors of rows of lengths and angles in degrees."""
    n, cos = cells[:, :3], np.cos(np.radians(cells[:, 3:]))
    g = n[:, :, None] * n[:, None, :]
    for (i, j), k in (((1, 2), 0), ((0, 2), 1), ((0, 1), 2)):
        g[:, i, j] *= cos[:, k]
        g[:, j, i] = g[:, i, j]
    return g


def _step(rows: np.ndarray, first: np.ndarray, moves: np.ndarray, by: np.ndarray, g: np.ndarray) -> None:
    """Multiplies the moves of some rows and takes their metrics anew."""
    if len(rows):
        moves[rows] = moves[rows] @ by
        g[rows] = np.swapaxes(moves[rows], 1, 2) @ first[rows] @ moves[rows]


def _matrices(n: int, entries: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    out = np.broadcast_to(np.eye(3), (n, 3, 3)).copy()
    for (i, j), v in entries.items():
        out[:, i, j] = v
    return out


def reduced(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced cells, the matrices whose columns are their edges in terms of the given ones, and whether it went well."""
    cells = np.asarray(cells, float)
    with np.errstate(all="ignore"):
        good = np.isfinite(cells).all(axis=1) & (cells[:, :3] > 0).all(axis=1) & (cells[:, 3:] > 0).all(axis=1) & (cells[:, 3:] < 180).all(axis=1)
        first = _metric(np.where(good[:, None], cells, [1.0, 1, 1, 90, 90, 90]))
        volume = np.sqrt(np.maximum(np.linalg.det(first), 0.0))
        good &= volume > 1e-9
    eps = TOLERANCE * np.cbrt(np.where(good, volume, 1.0))
    moves, g = _matrices(len(cells), {}), first.copy()
    active = np.flatnonzero(good)
    swap_ab = np.array([[0.0, -1, 0], [-1, 0, 0], [0, 0, -1]])
    swap_bc = np.array([[-1.0, 0, 0], [0, 0, -1], [0, -1, 0]])

    def parts(rows):
        m = g[rows]
        return m[:, 0, 0], m[:, 1, 1], m[:, 2, 2], 2 * m[:, 1, 2], 2 * m[:, 0, 2], 2 * m[:, 0, 1], eps[rows]

    def take(rows, test, by):
        """Does a step where its test holds; the rows that it leaves."""
        hit = test(*parts(rows))
        _step(rows[hit], first, moves, by(rows[hit]) if callable(by) else by, g)
        return rows[~hit]

    for _ in range(PASSES):
        if not len(active):
            break
        take(active, lambda a, b, c, x, y, z, e: (a > b + e) | ((np.abs(a - b) <= e) & (np.abs(x) > np.abs(y) + e)), swap_ab)
        rows = take(active, lambda a, b, c, x, y, z, e: (b > c + e) | ((np.abs(b - c) <= e) & (np.abs(y) > np.abs(z) + e)), swap_bc)
        _step(rows, first, moves, _signs(*parts(rows)[3:]), g)
        sign = lambda k: lambda rows: np.sign(parts(rows)[k])
        rows = take(rows, lambda a, b, c, x, y, z, e: (np.abs(x) > b + e) | ((np.abs(x - b) <= e) & (2 * y < z - e)) | ((np.abs(x + b) <= e) & (z < -e)), lambda r: _matrices(len(r), {(1, 2): -sign(3)(r)}))
        rows = take(rows, lambda a, b, c, x, y, z, e: (np.abs(y) > a + e) | ((np.abs(y - a) <= e) & (2 * x < z - e)) | ((np.abs(y + a) <= e) & (z < -e)), lambda r: _matrices(len(r), {(0, 2): -sign(4)(r)}))
        rows = take(rows, lambda a, b, c, x, y, z, e: (np.abs(z) > a + e) | ((np.abs(z - a) <= e) & (2 * x < y - e)) | ((np.abs(z + a) <= e) & (y < -e)), lambda r: _matrices(len(r), {(0, 1): -sign(5)(r)}))
        rows = take(rows, lambda a, b, c, x, y, z, e: (x + y + z + a + b < -e) | ((np.abs(x + y + z + a + b) <= e) & (2 * (a + y) + z > e)), _matrices(1, {(0, 2): np.ones(1), (1, 2): np.ones(1)})[0])
        active = np.setdiff1d(active, rows, assume_unique=True)
    good[active] = False
    lengths = np.sqrt(np.stack([g[:, k, k] for k in range(3)], axis=1))
    cos = np.stack([g[:, 1, 2] / lengths[:, 1] / lengths[:, 2], g[:, 0, 2] / lengths[:, 0] / lengths[:, 2], g[:, 0, 1] / lengths[:, 0] / lengths[:, 1]], axis=1)
    return np.concatenate([lengths, np.degrees(np.arccos(np.clip(cos, -1, 1)))], axis=1), moves, good


def _signs(x: np.ndarray, y: np.ndarray, z: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Turns edges around so that the three products are all positive, or none is."""
    v = np.stack([x, y, z], axis=1)
    up, down = v > e[:, None], v < -e[:, None]
    positive = (up | down).all(axis=1) & (down.sum(axis=1) % 2 == 0)
    turn = np.where(positive[:, None], down, up)
    # of an odd number of turns a product that is zero makes up for it, the last of them
    odd = ~positive & (turn.sum(axis=1) % 2 == 1)
    last = 2 - np.argmax((~up & ~down)[:, ::-1], axis=1)
    turn[odd, last[odd]] = True
    f = np.where(turn, -1.0, 1.0)
    return _matrices(len(x), {(k, k): f[:, k] for k in range(3)})


@F.pandas_udf(_OUT)
def niggli(a: pd.Series, b: pd.Series, c: pd.Series, alpha: pd.Series, beta: pd.Series, gamma: pd.Series) -> pd.DataFrame:
    """Reduced cells, and the matrix (row by row) that takes fractional coordinates into them; null where it fails."""
    cells, moves, good = reduced(np.stack([s.to_numpy(float, na_value=np.nan) for s in (a, b, c, alpha, beta, gamma)], axis=1))
    out = pd.DataFrame(cells, columns=list(CELL))
    out["inverse"] = list(np.rint(np.linalg.inv(moves)).reshape(-1, 9))
    return out.astype(object).where(pd.Series(good), None)


def repaired(structure: Column, cell: Column) -> Column:
    """A structure in its reduced cell (from `niggli`, best held in a column), its coordinates in [0, 1); null without one."""
    m = cell.inverse
    along = lambda p, k: F.pmod(m[3 * k] * p.x + m[3 * k + 1] * p.y + m[3 * k + 2] * p.z, F.lit(1.0))
    sites = F.transform(structure.sites, lambda p: F.struct(p.el.alias("el"), along(p, 0).alias("x"), along(p, 1).alias("y"), along(p, 2).alias("z")))
    whole = structure
    for k in CELL:
        whole = whole.withField(k, cell[k])
    return F.when(cell.a.isNotNull() & structure.sites.isNotNull(), whole.withField("sites", sites))
