"""Hierarchical cells on the sphere: a cube's six faces, each a quadtree whose
cells lie on a Hilbert curve. numpy, whole columns at a time."""

from __future__ import annotations

import math

import numpy as np

LEVELS = 30
#: Curve position of each (i, j) quadrant by orientation, and how a position
#: turns the orientation (fixed values).
QUADRANT = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
TURN = np.array([1, 0, 0, 3])


def cell_id(lat: np.ndarray, lon: np.ndarray, level: int) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    x, y, z = np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)
    p = np.stack([x, y, z])
    axis = np.abs(p).argmax(0)
    face = axis + 3 * (np.take_along_axis(p, axis[None], 0)[0] < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
        st = lambda a: np.where(a >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(a)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(a)))
        ij = [np.clip(np.floor(st(a) * 2.0**LEVELS), 0, 2**LEVELS - 1).astype(np.int64) for a in (u, v)]
    turn, pos = face & 1, np.zeros(len(face), dtype=np.uint64)
    for bit in range(LEVELS - 1, LEVELS - 1 - level, -1):
        quadrant = QUADRANT[turn, (ij[0] >> bit & 1) << 1 | ij[1] >> bit & 1]
        pos = pos << np.uint64(2) | quadrant.astype(np.uint64)
        turn = turn ^ TURN[quadrant]
    rest = 2 * (LEVELS - level)
    return face.astype(np.uint64) << np.uint64(61) | pos << np.uint64(rest + 1) | np.uint64(1 << rest)


def token(cell: int) -> str:
    return f"{int(cell):016x}".rstrip("0") or "X"


def from_token(text: str) -> int:
    return 0 if text == "X" else int(text.ljust(16, "0"), 16)


def level_of(cell: int) -> int:
    return LEVELS - ((cell & -cell).bit_length() - 1) // 2


def parent(cell: int, level: int) -> int:
    low = 1 << 2 * (LEVELS - level)
    return cell & -low & (2**64 - 1) | low


def children(cell: int) -> list[int]:
    low = (cell & -cell) >> 2
    return [cell - 3 * low + 2 * k * low for k in range(4)]


def faces() -> list[int]:
    return [f << 61 | 1 << 60 for f in range(6)]


def _corner(face: int, s: float, t: float) -> tuple[float, float]:
    uv = lambda a: (4 * a * a - 1) / 3 if a >= 0.5 else (1 - 4 * (1 - a) ** 2) / 3
    u, v = uv(s), uv(t)
    x, y, z = [(1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1)][face]
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def _square(cell: int) -> tuple[int, int, int, int]:
    face, level = cell >> 61, level_of(cell)
    pos = (cell & (1 << 61) - 1) >> 2 * (LEVELS - level) + 1
    turn, i, j = face & 1, 0, 0
    for k in range(level - 1, -1, -1):
        quadrant = pos >> 2 * k & 3
        ij = int(np.flatnonzero(QUADRANT[turn] == quadrant)[0])
        i, j, turn = i << 1 | ij >> 1, j << 1 | ij & 1, turn ^ int(TURN[quadrant])
    return face, level, i, j


def centre(cell: int) -> tuple[float, float]:
    face, level, i, j = _square(cell)
    return _corner(face, (i + 0.5) / 2**level, (j + 0.5) / 2**level)


def corners(cell: int) -> list[tuple[float, float]]:
    face, level, i, j = _square(cell)
    return [_corner(face, (i + a) / 2**level, (j + b) / 2**level) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
