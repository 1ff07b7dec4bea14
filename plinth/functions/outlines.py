"""Points against rings in batches of arrays: what `geometry` says of one point, for the many samples along outlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Rings:
    """The rings array<struct<x, y>> of an Arrow column, flat; a null ring has no vertices."""

    def __init__(self, column: pa.Array):
        points = column.flatten()
        self.x, self.y = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
        self.size = np.asarray(column.value_lengths().fill_null(0), np.int64)
        self.first = np.cumsum(self.size) - self.size
        of = np.repeat(np.arange(len(self.size)), self.size)
        self.box = []  # min_x, max_x, min_y, max_y
        for values in (self.x, self.y):
            for least, start in ((np.fmin, np.inf), (np.fmax, -np.inf)):
                edge = np.full(len(self.size), start)
                least.at(edge, of, values)
                self.box.append(edge)

    def ends(self, of: np.ndarray, j: int) -> tuple[np.ndarray, ...]:
        """ax, ay, bx, by of the j-th edges of the rings `of`."""
        a, b = self.first[of] + j, self.first[of] + (j + 1) % self.size[of]
        return self.x[a], self.y[a], self.x[b], self.y[b]


def sampled(rings: Rings, others: Rings, step: float, reach: float, last: bool) -> dict[str, np.ndarray]:
    """Samples of each ring that can be within `reach` of the box of the other in its place, in order.

    Edges of some length are cut into steps; their ends are samples where `last`.  of: the
    ring, i and k: which edge and step, s: the way along the outline, around: all of it, x, y.
    """
    every, around, place = [], np.zeros(len(rings.size)), np.zeros(len(rings.size), np.int64)
    for j in range(int(rings.size.max(initial=0))):
        of = np.flatnonzero((rings.size > j) & (rings.size >= 3))
        ax, ay, bx, by = rings.ends(of, j)
        size = np.hypot(bx - ax, by - ay)
        some = size >= 1e-9
        of, ax, ay, bx, by, size = (v[some] for v in (of, ax, ay, bx, by, size))
        n = np.maximum(1, np.ceil(size / step)).astype(np.int64)
        low, high = np.zeros(len(of)), np.ones(len(of))
        pad = reach * 1.001
        with np.errstate(divide="ignore", invalid="ignore"):
            for a, b, at_least, at_most in ((ax, bx, *others.box[:2]), (ay, by, *others.box[2:])):
                inner = (at_least[of] - pad <= a) & (a <= at_most[of] + pad)
                one, two = (at_least[of] - pad - a) / (b - a), (at_most[of] + pad - a) / (b - a)
                low = np.maximum(low, np.where(a == b, np.where(inner, 0.0, 2.0), np.fmin(one, two)))
                high = np.minimum(high, np.where(a == b, 1.0, np.fmax(one, two)))
        meets = low <= high
        k0 = np.maximum(np.floor(np.where(meets, low, 0) * n).astype(np.int64) - 1, 0)
        k1 = np.minimum(np.ceil(np.where(meets, high, 0) * n).astype(np.int64) + 1, n if last else n - 1)
        count = np.where(meets, k1 - k0 + 1, 0)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - k0, count)
        e = np.repeat(np.arange(len(of)), count)
        t = k / n[e]
        every.append({"of": of[e], "i": place[of][e], "k": k, "s": around[of][e] + t * size[e], "x": ax[e] + t * (bx - ax)[e], "y": ay[e] + t * (by - ay)[e]})
        around[of] += size
        place[of] += 1
    if not every:
        return {c: np.zeros(0, np.int64 if c in ("of", "i", "k") else float) for c in ("of", "i", "k", "s", "x", "y", "around")}
    whole = {c: np.concatenate([one[c] for one in every]) for c in every[0]}
    by = np.argsort(whole["of"], kind="stable")
    whole = {c: v[by] for c, v in whole.items()}
    return whole | {"around": around[whole["of"]]}


def closest(x: np.ndarray, y: np.ndarray, of: np.ndarray, rings: Rings) -> tuple[np.ndarray, ...]:
    """d, qx, qy of the closest boundary point of the ring `of` (infinite for no ring; of equally close ones the least), and whether the point is inside."""
    n = rings.size[of]
    d, qx, qy, odd = np.full(len(x), np.inf), np.full(len(x), np.nan), np.full(len(x), np.nan), np.zeros(len(x), bool)
    for j in range(int(n.max(initial=0))):
        at = np.flatnonzero(n > j)
        ax, ay, bx, by = rings.ends(of[at], j)
        px, py, dx, dy = x[at], y[at], bx - ax, by - ay
        size = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(size < 1e-18, 0.0, np.minimum(np.maximum(((px - ax) * dx + (py - ay) * dy) / size, 0.0), 1.0))
            cross = dx * (py - ay) / (dy + 1e-15) + ax
        cx, cy = ax + t * dx, ay + t * dy
        far = np.hypot(cx - px, cy - py)
        nearer = (far < d[at]) | ((far == d[at]) & ((cx < qx[at]) | ((cx == qx[at]) & (cy < qy[at]))))
        to = at[nearer]
        d[to], qx[to], qy[to] = far[nearer], cx[nearer], cy[nearer]
        odd[at] ^= ((ay > py) != (by > py)) & (px < cross)
    return d, qx, qy, odd & (n >= 3)
