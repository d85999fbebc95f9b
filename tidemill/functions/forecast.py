"""Numerical kernels of one series: seasonal smoothing and line simplification."""

from __future__ import annotations

import numpy as np


def simplex(fn, start: np.ndarray, rounds: int = 400, tolerance: float = 1e-6) -> np.ndarray:
    """Nelder-Mead minimisation; the first four parameters stay within 0 and 1."""
    inner = np.arange(len(start)) < 4
    clip = lambda x: np.where(inner, np.clip(x, 0.0, 1.0), x)
    steps = np.where(inner, 0.1, np.maximum(0.05 * np.abs(start), 0.01))
    points = [clip(start)] + [clip(start + np.diag(steps)[i]) for i in range(len(start))]
    values = [fn(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance:
            break
        mid = np.mean(points[:-1], axis=0)
        tried = clip(2 * mid - points[-1])
        v = fn(tried)
        if v < values[0]:
            far = clip(3 * mid - 2 * points[-1])
            w = fn(far)
            points[-1], values[-1] = (far, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            near = clip((mid + points[-1]) / 2)
            w = fn(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
                values = [values[0]] + [fn(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def _smooth(y: np.ndarray, m: int, params: np.ndarray, ahead: int):
    """Fitted values, future ones and the squared error of damped exponential
    smoothing. params: the four weights, level, trend and m seasons."""
    (alpha, beta, gamma, phi), level, trend = np.clip(params[:4], 0.0, 1.0), params[4], params[5]
    season = list(params[6:]) if m > 1 else [1.0]
    size, fitted, error, damp = len(season), [], 0.0, phi
    for t, v in enumerate(y.tolist()):
        k = t % size
        guess = (level + phi * trend) * season[k]
        fitted.append(guess)
        v = guess if v != v else v
        error += (v - guess) ** 2
        prior, whole = level, level + phi * trend
        level = alpha * (v / season[k] if season[k] else v) + (1 - alpha) * whole
        trend = beta * (level - prior) + (1 - beta) * phi * trend
        if m > 1:
            season[k] = gamma * (v / whole if whole else 1.0) + (1 - gamma) * season[k]
    future = []
    for h in range(ahead):
        future.append((level + damp * trend) * season[(len(y) + h) % size])
        damp += phi ** (h + 2)
    return fitted, future, error


def fit_and_forecast(y: np.ndarray, ahead: int, season: int = 0) -> tuple[list[float], list[float]]:
    """Fitted values and ``ahead`` future ones; NaN marks a missing point. The
    weights, level, trend and seasons are all fitted. Fewer than two values, or
    fewer than a season, give none."""
    y = np.asarray(y, dtype=float)
    m = season if season > 1 else 1
    real = np.flatnonzero(~np.isnan(y))
    if len(y) < 2 or len(y) < m or ahead <= 0 or not len(real):
        return [], []
    y = y.copy()
    y[: real[0]] = y[real[0]]
    if m > 1:
        level = float(np.nansum(y[:m]) / m) or 1.0
        pairs = y[m : 2 * m] - y[:m][: len(y[m : 2 * m])]
        trend, seasons = float(np.nansum(pairs) / (m * m)), np.where(np.isnan(y[:m]), 1.0, y[:m] / level)
    else:
        level, trend, seasons = y[0], 0.0 if np.isnan(y[1]) else y[1] - y[0], np.zeros(0)
    cost = lambda p: _smooth(y, m, p, 0)[2]
    best = None
    for a in (0.3, 0.7):
        for b in (0.3, 0.7):
            for phi in (0.3, 0.9):
                found = simplex(cost, np.concatenate([[a, b, 0.5, phi, level, trend], seasons]))
                best = found if best is None or cost(found) < cost(best) else best
    fitted, future, _ = _smooth(y, m, best, ahead)
    return fitted, future


def digital_line(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Indices kept when a stretch is split at its farthest point as long as that
    is no nearer than the line's own digitisation error: its length times the
    largest angle that a point off by a unit can turn it."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    kept, todo = [], [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            kept += [a, b]
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        size = float(np.hypot(dx, dy))
        turn = np.arctan(dy / dx) if dx else 0.0
        s, c = np.sin(turn), np.cos(turn)
        px, py = x[a : b + 1] - x[a], y[a : b + 1] - y[a]
        away = np.abs(dx * py - dy * px) / size if size else np.hypot(px, py)
        far = int(away.argmax())
        t = (abs(s) + abs(c)) / size if size else np.inf
        angle = max(np.arctan(abs(s + w * c) / size * (1 - t + t * t)) for w in (1, -1)) if size else np.inf
        if 0 < far < b - a and away[far] >= size * angle:
            todo += [(a, a + far), (a + far, b)]
        else:
            kept += [a, b]
    return sorted(set(kept))


def line_importance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point the distance at which Ramer-Douglas-Peucker splits there
    (never more than its parent's); infinite at both ends."""
    weight = np.zeros(len(x))
    if not len(x):
        return weight
    weight[0] = weight[-1] = np.inf
    todo = [(0, len(x) - 1, np.inf)]
    while todo:
        a, b, most = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        norm = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(dx * py - dy * px) / norm if norm else np.hypot(px, py)
        i = int(d.argmax())
        w = min(float(d[i]), most)
        if w <= 0:
            continue
        weight[a + 1 + i] = w
        todo += [(a, a + 1 + i, w), (a + 1 + i, b, w)]
    return weight
