"""Masks of many frames as sorted intervals, and the polygons, dilations, moves and sums on them.

A mask is a set of half-open runs of pixels. All frames of a batch have one size and share one number line: a run of
line y of frame f from x0 to x1 is [p, p + x1 - x0) with p = (f * height + y) * (width + 1) + x0. The spare place at
the end of each line keeps runs of neighbouring lines apart. A region of a face is some hundred numbers in this form.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class Size(NamedTuple):
    height: int
    width: int


class Runs(NamedTuple):
    """Sorted runs that neither overlap nor touch."""

    start: np.ndarray
    end: np.ndarray

    def lines(self, size: Size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line (over all frames), first x and the x after the last of each run."""
        line, x = np.divmod(self.start, size.width + 1)
        return line, x, x + self.end - self.start


EMPTY = Runs(np.empty(0, np.int64), np.empty(0, np.int64))


def merged(start: np.ndarray, end: np.ndarray) -> Runs:
    """Runs from intervals in any order, which may overlap or be empty."""
    real = end > start
    start, end = start[real], end[real]
    if not len(start):
        return EMPTY
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    lead = np.flatnonzero(np.append(True, start[1:] > far[:-1]))
    return Runs(start[lead], far[np.append(lead[1:] - 1, len(far) - 1)])


def combine(a: Runs, b: Runs, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Runs:
    """The places for which keep(in a, in b) holds; keep(False, False) must not."""
    cuts = np.unique(np.concatenate((*a, *b)))
    inside = [np.searchsorted(r.start, cuts, "right") > np.searchsorted(r.end, cuts, "right") for r in (a, b)]
    held = np.flatnonzero(keep(*inside))
    return merged(cuts[held], cuts[held + 1]) if len(held) else EMPTY


def both(a: Runs, b: Runs) -> Runs:
    return combine(a, b, np.logical_and)


def either(a: Runs, b: Runs) -> Runs:
    return combine(a, b, np.logical_or)


def without(a: Runs, b: Runs) -> Runs:
    return combine(a, b, lambda x, y: x & ~y)


def _at(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, size: Size) -> Runs:
    """Runs of lines, clipped at their ends."""
    base = line * (size.width + 1)
    return merged(base + np.maximum(x0, 0), base + np.minimum(x1, size.width))


def counted(runs: Runs, frames: int, size: Size) -> np.ndarray:
    """Pixels of each frame."""
    frame = runs.start // (size.height * (size.width + 1))
    return np.bincount(frame, runs.end - runs.start, frames).astype(np.int64)


def moved(runs: Runs, dx: np.ndarray, dy: np.ndarray, size: Size) -> Runs:
    """Runs moved by whole pixels, which each frame has its own of; what leaves the frame is lost."""
    line, x0, x1 = runs.lines(size)
    frame, y = np.divmod(line, size.height)
    y = y + dy[frame]
    held = (y >= 0) & (y < size.height)
    frame, y, x0, x1 = frame[held], y[held], x0[held], x1[held]
    return _at(frame * size.height + y, x0 + dx[frame], x1 + dx[frame], size)


def ellipse(side: int) -> list[tuple[int, int]]:
    """(dy, reach) of each line of an elliptical structuring element of odd side: it covers 2 * reach + 1 pixels."""
    r = side // 2
    return [(dy, int(np.rint(r * np.sqrt((r * r - dy * dy) / (r * r))) if r else 0)) for dy in range(-r, r + 1)]


def dilated(runs: Runs, element: list[tuple[int, int]], size: Size) -> Runs:
    line, x0, x1 = runs.lines(size)
    frame, y = np.divmod(line, size.height)
    parts = []
    for dy, reach in element:
        held = (y + dy >= 0) & (y + dy < size.height)
        parts.append(_at(frame[held] * size.height + y[held] + dy, x0[held] - reach, x1[held] + reach, size))
    return merged(np.concatenate([p.start for p in parts]), np.concatenate([p.end for p in parts]))


def whole_points(points: np.ndarray, size: Size) -> np.ndarray:
    """The nearest pixels of points (..., x and y), halves to even, clipped to the frame."""
    return np.clip(np.rint(points), 0, [size.width - 1, size.height - 1]).astype(np.int64)


def _steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element i of n, the pairs (i, 0) to (i, n[i])."""
    i = np.repeat(np.arange(len(n)), n + 1)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)


def edge_pixels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, x, y) of the pixels of each line from a to b (both n x 2), one for each step of the longer axis.

    Lines go from their left end to the right; where the other axis is at a half, the pixel nearer the left end is taken.
    """
    swap = (b[:, 0] < a[:, 0])[:, None]
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    d = q - p
    n = np.abs(d).max(1)
    i, k = _steps(n)
    share = lambda c: np.where(n[i] > 0, -((n[i] - 2 * k * np.abs(d[i, c])) // np.maximum(2 * n[i], 1)), 0) * np.sign(d[i, c])  # noqa: E731  (rounds halves down)
    return i, p[i, 0] + share(0), p[i, 1] + share(1)


def _down(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    swap = (b[:, 1] < a[:, 1])[:, None]
    return np.where(swap, b, a), np.where(swap, a, b)


def convex(points: np.ndarray, size: Size) -> Runs:
    """The filled convex hulls of each frame's points (frames x n x 2, whole pixels).

    A line is filled between the hull's edges where these cross its middle, in 16-bit fixed point with halves upward,
    and holds the pixels of the edges themselves.
    """
    f, n, _ = points.shape
    d = points[:, None, :, :] - points[:, :, None, :]  # from i to j
    side = d[:, :, :, None, 0] * d[:, :, None, :, 1] - d[:, :, :, None, 1] * d[:, :, None, :, 0]
    frame, i, j = np.nonzero((side >= 0).all(3) & ~np.eye(n, dtype=bool) if n > 1 else np.ones((f, 1, 1), bool))
    a, b = points[frame, i], points[frame, j]
    e, x, y = edge_pixels(a, b)
    top, low = _down(a, b)
    tall = low[:, 1] > top[:, 1]
    top, low, owner = top[tall], low[tall], frame[tall]
    rows = low[:, 1] - top[:, 1]
    num = ((low[:, 0] - top[:, 0]) << 17) + rows
    slope = np.sign(num) * (np.abs(num) // (2 * rows))
    k, step = _steps(rows)
    cross = ((top[k, 0] << 16) + step * slope[k] + (1 << 15)) >> 16
    line = np.concatenate((frame[e] * size.height + y, owner[k] * size.height + top[k, 1] + step))
    x = np.concatenate((x, cross))
    order = np.lexsort((x, line))
    line, x = line[order], x[order]
    lead = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    last = np.append(lead[1:] - 1, len(line) - 1)
    return _at(line[lead], x[lead], x[last] + 1, size)


def filled(points: np.ndarray, size: Size) -> Runs:
    """The filled polygons of each frame's points in order (frames x n x 2, whole pixels), crossings by the even-odd rule.

    A pixel is in if its middle lies inside or on the border, or if it is one of the pixels of an edge.
    """
    f, n, _ = points.shape
    a, b = points.reshape(-1, 2), np.roll(points, -1, axis=1).reshape(-1, 2)
    frame = np.repeat(np.arange(f), n)
    e, x, y = edge_pixels(a, b)
    border = (frame[e] * size.height + y) * (size.width + 1) + x
    top, low = _down(a, b)
    tall = low[:, 1] > top[:, 1]
    top, low, owner = top[tall], low[tall], frame[tall]
    rows = low[:, 1] - top[:, 1]
    k, step = _steps(rows - 1)  # a line at an edge's lower end belongs to the next edge
    num, den = step * (low[k, 0] - top[k, 0]), rows[k]
    line, at = owner[k] * size.height + top[k, 1] + step, top[k, 0] + num / den
    order = np.lexsort((at, line))
    first, second = order[0::2], order[1::2]
    ceil = lambda i: top[k[i], 0] - (-num[i]) // den[i]
    floor = lambda i: top[k[i], 0] + num[i] // den[i]
    base = line[first] * (size.width + 1)
    return merged(np.concatenate((border, base + ceil(first))), np.concatenate((border + 1, base + floor(second) + 1)))


def prefix_sums(rasters: np.ndarray, over: float) -> np.ndarray:
    """Running sums along each line of r, g, b and of the pixels with a channel of at least ``over`` (frames x height x
    (width + 1) x 4)."""
    f, h, w, _ = rasters.shape
    kind = np.float64 if rasters.dtype.kind == "f" else np.int64
    out = np.zeros((f, h, w + 1, 4), kind)
    np.cumsum(rasters, axis=2, out=out[:, :, 1:, :3], dtype=kind)
    np.cumsum(rasters.max(3) >= over, axis=2, out=out[:, :, 1:, 3], dtype=kind)
    return out


def sums(runs: Runs, prefix: np.ndarray) -> np.ndarray:
    """Sums of r, g, b and overexposed pixels under each frame's runs (frames x 4)."""
    f, h, w, _ = prefix.shape
    line, x0, x1 = runs.lines(Size(h, w - 1))
    flat = prefix.reshape(f * h, w, 4)
    each = flat[line, x1] - flat[line, x0]
    out = np.zeros((f, 4), prefix.dtype)
    np.add.at(out, line // h, each)
    return out
