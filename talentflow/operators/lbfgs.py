"""Limited-memory quasi-Newton minimisation by generators.

``minimise`` yields the points at which it needs a value and a gradient, so that many problems can
ask at the same time and one pass over the rows answers all. Steps, line searches and stopping
are those of the minimisers behind MLlib's linear models (Breeze's ``LBFGS`` and, with
``orthant``, ``OWLQN`` without a penalty), so that both end at the same point up to rounding.
"""

from __future__ import annotations

import numpy as np


class Stuck(Exception):
    """No step was found: the history is dropped once, a second time ends the search."""


def together(starts: dict, answer) -> dict:
    """Run generators side by side: ``answer`` gets ``{key: point}`` of those that go on, and
    returns ``{key: (value, gradient)}``; the result is ``{key: last point}``."""
    asked, done = {}, {}
    for key, run in starts.items():
        try:
            asked[key] = next(run)
        except StopIteration as end:
            done[key] = end.value
    while asked:
        for key, found in answer(asked).items():
            try:
                asked[key] = starts[key].send(found)
            except StopIteration as end:
                done[key] = end.value
                del asked[key]
    return done


def minimise(start: np.ndarray, max_iter: int, tol: float, orthant: bool = False, memory: int = 10, window: int = 20):
    """Ends after ``max_iter`` steps, if the value has fallen by no more than ``tol`` of the first
    one in ``window`` steps, or if the gradient is as small."""
    x = np.asarray(start, float)
    value, grad = yield x
    first, recent, history, steps, failed = value, [np.inf], [], 0, False
    while steps < max_iter:
        if len(recent) > 1 and abs(value - max(recent)) <= tol * first or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        try:
            with np.errstate(all="ignore"):
                d = _direction(history, grad)
                if orthant:
                    d = np.where(d * grad < 0, d, 0.0)
                    found = yield from _backtracking(x, value, grad, d, *((0.5 / np.linalg.norm(grad), 0.1) if steps == 0 else (1.0, 0.5)))
                else:
                    found = yield from _strong_wolfe(x, value, grad, d, 1 / np.linalg.norm(d) if steps == 0 else 1.0)
        except Stuck:
            if failed:
                break
            failed, history = True, []
            continue
        history = [(found[0] - x, found[2] - grad), *history][:memory]
        recent = [*recent, found[1]][-window:]
        x, value, grad = found
        steps, failed = steps + 1, False
    return x


def _direction(history: list, grad: np.ndarray) -> np.ndarray:
    d, scale, kept = grad.copy(), 1.0, []
    if history:
        s, y = history[0]
        if not s @ y >= 0:
            raise Stuck
        scale = (s @ y) / (y @ y)
    for s, y in history:
        rho = s @ y
        a = (s @ d) / rho
        if np.isnan(a):
            raise Stuck
        kept.append((s, y, rho, a))
        d -= a * y
    d *= scale
    for s, y, rho, a in reversed(kept):
        d += (a - (y @ d) / rho) * s
    return -d


def _strong_wolfe(x, value, grad, d, t):
    """``(point, value, gradient)`` by bracketing and cubic interpolation."""
    slope = grad @ d
    if slope > 0:
        raise Stuck

    def at(t):
        v, g = yield (point := x + d * t)
        return t, v, g @ d, (point, v, g)

    def interpolated(l, r):
        d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        d2 = np.sqrt(d1 * d1 - l[2] * r[2])
        t = r[0] - (r[0] - l[0]) * (r[2] + d2 - d1) / (r[2] - l[2] + 2 * d2)
        if np.isnan(t):
            raise Stuck
        return min(max(t, l[0] + 0.1 * (r[0] - l[0])), l[0] + 0.9 * (r[0] - l[0]))

    def zoom(low, high):
        for _ in range(10):
            c = yield from at(interpolated(high, low) if low[0] > high[0] else interpolated(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise Stuck

    low = 0.0, value, slope, None
    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            c = yield from zoom(low, c)
        elif abs(c[2]) > 0.9 * abs(slope):
            if c[2] < 0:
                low, t = c, t * 1.5
                continue
            c = yield from zoom(c, low)
        if c[0] * np.linalg.norm(grad) < 1e-10:
            raise Stuck
        return c[3]
    raise Stuck


def _backtracking(x, value, grad, d, t, shrink):
    """``(point, value, gradient)``; a coordinate that would leave its side of 0 stays at 0."""
    side = np.where(x != 0, np.sign(x), np.sign(-grad))
    slope = grad @ d

    def at(t):
        point = x + d * t
        point = np.where(np.sign(point) == side, point, 0.0)
        v, g = yield point
        return point, v, g
    # judged from the start's own value and slope, so that the first length to be tried is a shorter one
    found, v, now = None, value, slope
    for i in range(20):
        if v > value + 1e-4 * t * slope:
            scale = shrink
        elif now < 0.9 * slope:
            scale = 2.1
        elif now > -0.9 * slope:
            scale = shrink
        else:
            break
        if not 1e-10 <= t * scale <= 1e10:
            raise Stuck
        if i < 19:
            t *= scale
            found = yield from at(t)
            v, now = found[1], found[2] @ d
    if found is None:
        found = yield from at(t)
    return found
