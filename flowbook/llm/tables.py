"""How many tables the customers of a dish take in a Pitman-Yor restaurant.

Of ``c`` customers who eat one dish, where a new table has weight ``new``, the chance of
``t`` tables is in proportion to ``S(c, t) * new**t``; S(c, t) are the generalised Stirling
numbers of the discount, the weights of all ways to seat c customers at t tables.  A draw
from it seats all customers of a dish anew at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Customers up to which the numbers stand in a table (4 MB), by their recurrence.
TABLED = 1024
_NODES, _AT_ONCE, _GRID = 40, 1 << 17, 16
#: Chances of less than exp(-_FAR) of the largest are left to the rounding of doubles.
_FAR = 36.0


@lru_cache(maxsize=2)
def log_stirling(discount: float) -> list[np.ndarray]:
    """log S(c, t) for t = 1 .. c, by c up to ``TABLED``."""
    out = [np.zeros(0), np.zeros(1)]
    for c in range(1, TABLED):
        row = np.append(np.log(c - discount * np.arange(1, c + 1)) + out[c], -np.inf)
        row[1:] = np.logaddexp(row[1:], out[c])
        out.append(row)
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    z = n + 1.0
    shift = np.where(z < 10, np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7) * (z + 8) * (z + 9)), 0)
    z = np.where(z < 10, z + 10, z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - shift


def log_weight(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) - log c!, for many customers.  S(c, t) * t! * discount**t / c! is the chance that
    t independent table sizes with the generating function 1 - (1 - x)**discount add up to
    c: its coefficient of x**c is an integral over x = exp(-s), by the trapezoid rule along a parabola
    through the saddle point (a line where that lies far out)."""
    d = discount
    c, t = np.asarray(c, float), np.asarray(t, float)

    def slope(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First derivative of -log(1 - (1 - exp(-s))**d), and the second with its sign changed."""
        y, e = -np.expm1(-s), np.exp(-s)
        f = -np.expm1(d * np.log(y))
        first = d * y ** (d - 1) * e / f
        return first, first * np.maximum(1 + (1 - d) * e / y - first, 1e-12)

    lo, hi = np.log(8 / c), np.full(len(c), 3.5)
    for _ in range(24):  # the saddle need not be met exactly
        mid = (lo + hi) / 2
        up = t * slope(np.exp(mid))[0] > c
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    mu = np.exp(lo)
    spread = 1 / np.sqrt(t * slope(mu)[1])  # of the integrand in s, at the saddle
    line = mu > 0.25
    step = np.where(line, np.minimum(0.5 * spread, np.pi / _NODES), np.minimum(0.35 * spread / mu, 0.11))
    theta = (np.arange(_NODES) + 0.5) * step[:, None]
    z = np.where(line[:, None], 1 + 1j * theta / mu[:, None], (1 + 1j * theta) ** 2)
    s = mu[:, None] * z
    grow = t[:, None] * np.log(1 - np.exp(d * np.log(-np.expm1(-s))))
    far = c[:, None] * (s - mu[:, None])
    at = t * np.log(-np.expm1(d * np.log(-np.expm1(-mu))))
    near = at > -1  # exp(c * s) alone integrates to 0 and is taken off
    at[near] = 0
    part = np.exp(grow - at[:, None] + far)
    if near.any():
        g, f = grow[near], np.exp(far[near])
        part[near] = np.where(np.abs(g) < 1, np.expm1(np.where(np.abs(g) < 1, g, 0)) * f, part[near] - f)
    part = np.where(line[:, None], part, part * 2 * mu[:, None] * (1 + 1j * theta))
    total = np.maximum(part.real.sum(axis=1) * step / np.pi, 1e-300)
    return np.where(t == c, -_log_factorial(c), np.log(total) + c * mu + at - _log_factorial(t) - t * np.log(d))


def seated(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given its customers and the weight of a new table."""
    tables = (customers > 0).astype(np.int64)
    chance = rng.random(len(customers))
    by = np.argsort(customers, kind="stable")
    sizes = customers[by]
    few = log_stirling(discount) if len(by) and sizes[-1] > 1 else None
    lo, end = np.searchsorted(sizes, [2, TABLED + 1])
    while lo < end:
        c = int(sizes[lo])
        hi = int(np.searchsorted(sizes, c, side="right"))
        t = np.arange(1, c + 1)
        for k in range(lo, hi, _AT_ONCE // c):
            e = by[k:min(hi, k + _AT_ONCE // c)]
            tables[e] = 1 + _drawn(few[c] + np.log(new[e])[:, None] * t, chance[e])
        lo = hi
    for k in range(end, len(by), 128):
        e = by[k:k + 128]
        tables[e] = _of_many(customers[e].astype(np.int64), np.log(new[e]), discount, chance[e])
    return tables


def _drawn(logs: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """A place in each row by the weights whose logarithms these are."""
    logs = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
    return np.minimum((logs < chance[:, None] * logs[:, -1:]).sum(axis=1), logs.shape[1] - 1)


def _of_many(c: np.ndarray, log_new: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """Weights rise to their largest and fall: a grid is narrowed to where they count, then all are taken."""
    lo, hi = np.ones(len(c), np.int64), c.copy()
    rows = np.arange(len(c))
    weigh = lambda i, t: log_weight(c[i], t, discount) + t * log_new[i]
    wide = rows
    while len(wide):
        share = np.linspace(0, 1, _GRID)
        grid = np.rint(np.exp(np.log(lo[wide])[:, None] + share * np.log(hi[wide] / lo[wide])[:, None])).astype(np.int64)
        w = weigh(np.repeat(wide, _GRID), grid.ravel()).reshape(grid.shape)
        keep = w > w.max(axis=1, keepdims=True) - _FAR
        first, last = keep.argmax(axis=1), _GRID - 1 - keep[:, ::-1].argmax(axis=1)
        at = np.arange(len(wide))
        a, b = grid[at, np.maximum(first - 1, 0)], grid[at, np.minimum(last + 1, _GRID - 1)]
        narrowed = (b - a) < 0.8 * (hi[wide] - lo[wide])
        lo[wide], hi[wide] = a, b
        wide = wide[narrowed & (b - a > 2 * _GRID)]
    sizes = hi - lo + 1
    ends = np.cumsum(sizes)
    i = np.repeat(rows, sizes)
    t = np.arange(len(i)) - (ends - sizes - lo)[i]
    w = np.concatenate([weigh(i[k:k + 2048], t[k:k + 2048]) for k in range(0, len(t), 2048)])
    return np.array([a + _drawn(x[None], u)[0] for a, x, u in zip(lo, np.split(w, ends[:-1]), chance[:, None], strict=True)])
