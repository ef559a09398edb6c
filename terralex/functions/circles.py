"""Smallest circles and annuli around a few points of a plane."""

from __future__ import annotations

from itertools import combinations

import numpy as np

CLOSE = 1e-9


def _circle(points: np.ndarray) -> np.ndarray | None:
    """The centre that is equally far from two or three points; None if three lie on a line."""
    if len(points) < 3:
        return points.mean(axis=0)
    m, right = 2 * (points[1:] - points[0]), (points[1:] ** 2).sum(axis=1) - (points[0] ** 2).sum()
    return np.linalg.solve(m, right) if abs(np.linalg.det(m)) > CLOSE**2 else None


def _reach(centre: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.hypot(*(points - centre).T)


def min_circle(points: np.ndarray) -> np.ndarray:
    """Centre of the smallest circle around all points: the furthest point joins the few that hold the circle until none is outside."""
    held = points[:1]
    while True:
        best, size = held[0], 0.0
        if len(held) > 1:
            size = np.inf
            for some in (c for k in (2, 3) for c in combinations(range(len(held)), k)):
                centre = _circle(held[list(some)])
                if centre is not None and (r := _reach(centre, held).max()) < size:
                    best, size = centre, r
        far = _reach(best, points)
        if far.max() <= size * (1 + CLOSE) + CLOSE:
            return best
        on = held[np.abs(_reach(best, held) - size) <= CLOSE + size * 1e-7] if len(held) > 2 else held
        held = np.unique(np.vstack([on, points[far.argmax()]]), axis=0)


def min_annulus(points: np.ndarray) -> np.ndarray:
    """Centre of the annulus around all points with the least area: a linear program in centre, outer and inner power.

    A solution is held by four points on the rings; points that stick out join those until none does."""
    points = np.unique(points, axis=0)
    if len(points) < 3 or np.linalg.matrix_rank(points - points[0], tol=1e-9) < 2:
        return min_circle(points)
    power = (points**2).sum(axis=1)
    held = list(range(min(4, len(points))))
    while True:
        best = None
        for k in (1, 2, 3):
            for outer in combinations(held, k):
                for inner in combinations(held, 4 - k):
                    rows = [[*(2 * points[i]), 1, 0] for i in outer] + [[*(2 * points[i]), 0, 1] for i in inner]
                    if abs(np.linalg.det(rows)) < CLOSE**2:
                        continue
                    x, y, u, v = np.linalg.solve(rows, power[[*outer, *inner]])
                    left = power[held] - 2 * points[held] @ (x, y)
                    if left.max() <= u + 1e-7 and left.min() >= v - 1e-7 and (best is None or u - v < best[0] - CLOSE):
                        best = u - v, np.array([x, y]), u, v, [*outer, *inner]
        if best is None:
            return min_circle(points)
        _, centre, u, v, on = best
        left = power - 2 * points @ centre
        out = {int(left.argmax())} if left.max() > u + 1e-7 else set()
        out |= {int(left.argmin())} if left.min() < v - 1e-7 else set()
        if out <= set(held):
            return centre
        held = sorted({*on, *out})
