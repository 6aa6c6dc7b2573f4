"""Leading singular values and right singular vectors of a small square matrix by bidiagonalisation and quotient differences.

``bidiagonal`` reduces R by Householder reflections to an upper bidiagonal B = U' R V.  ``dqds`` finds all eigenvalues of
B'B from the quotient-difference array (q, e) of squared entries: shifted transforms use no subtraction but of the shift,
so each value keeps its relative accuracy; a shift that drives an entry negative was too large and is lessened.
``twisted`` gives an eigenvector of B'B for one value: a stationary factorisation from the top and a progressive one from
the bottom meet where the pivot is smallest, and the vector follows from there by multiplications only.
Nothing here grows with the rows of the data: all sizes are its dimension.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with V orthogonal and r @ V of the same singular values and right vectors as B."""
    a = np.array(r, float)
    d = a.shape[0]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        u = x.copy()
        norm = np.linalg.norm(u)
        if norm == 0 or len(u) < 2 or not u[1:].any():
            return None
        u[0] += np.copysign(norm, u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        if (u := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < d and (u := mirror(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One dqds step, or None if ``shift`` exceeds the smallest value."""
    qq, ee = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        qq[i] = d + e[i]
        ratio = q[i + 1] / qq[i] if qq[i] > 0 else 0.0
        ee[i] = e[i] * ratio
        d = d * ratio - shift if qq[i] > 0 else q[i + 1] - shift
    if d < 0:
        return None
    qq[-1] = d
    return qq, ee


def _block(q: np.ndarray, e: np.ndarray) -> list[float]:
    """The eigenvalues of an unreduced block."""
    found, base = [], 0.0
    while len(q) > 1:
        if e[-1] <= EPS * EPS * (base + q[-1]) or q[-1] + base == 0 and e[-1] == 0:
            found.append(base + q[-1])
            q, e = q[:-1], e[:-1]
            continue
        if q[0] * 1.5 < q[-1]:  # graded the wrong way
            q, e = q[::-1].copy(), e[::-1].copy()
        # the smaller value of the trailing two by two of B'B, a little less of it as the shift
        above = e[-2] if len(e) > 1 else 0.0
        a, c, b2 = q[-2] + above, q[-1] + e[-1], q[-2] * e[-1]
        half = (a - c) / 2
        low = max(0.0, c - b2 / (abs(half) + np.sqrt(half * half + b2)) if half >= 0 else a - b2 / (abs(half) + np.sqrt(half * half + b2)))
        step = None
        for shift in (low * (1 - 2 * EPS), low * 0.9, low * 0.5, low / 16, 0.0):
            if (step := _transform(q, e, shift)) is not None:
                break
        q, e = step
        base += shift
        tiny = np.flatnonzero(e <= EPS * EPS * (base + np.minimum(q[:-1], q[1:])))
        if len(tiny) and tiny[0] < len(e) - 1:  # split inside: both parts on their own
            k = tiny[0] + 1
            return found + [base + x for part in ((q[:k], e[:k - 1]), (q[k:], e[k:])) for x in _block(*part)]
    return [*found, base + q[0]]


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The eigenvalues of B'B (squared singular values), falling."""
    top = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if top == 0:
        return np.zeros(len(diagonal))
    q, e = (diagonal / top) ** 2, (above / top) ** 2
    cuts = [0, *(np.flatnonzero(e <= EPS * EPS * np.minimum(q[:-1], q[1:])) + 1), len(q)]
    out = [x for a, b in zip(cuts, cuts[1:]) for x in _block(q[a:b].copy(), e[a:b - 1].copy())]
    return np.sort(np.array(out))[::-1] * top * top


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, turn: int = 0) -> np.ndarray:
    """Unit eigenvector of T = B'B for ``value``; ``turn``: from the pivot that is that many places after the smallest."""
    d = len(diagonal)
    t = diagonal ** 2 + np.r_[0.0, above ** 2]
    off = diagonal[:-1] * above
    floor = EPS * EPS * (np.abs(t).max() + abs(value)) + np.finfo(float).tiny
    safe = lambda x: x if abs(x) > floor else (floor if x >= 0 else -floor)
    down, up = np.empty(d), np.empty(d)
    down[0], up[-1] = t[0] - value, t[-1] - value
    for i in range(1, d):
        down[i] = t[i] - value - off[i - 1] ** 2 / safe(down[i - 1])
    for i in range(d - 2, -1, -1):
        up[i] = t[i] - value - off[i] ** 2 / safe(up[i + 1])
    pivot = down + up - (t - value)
    k = int(np.argsort(np.abs(pivot), kind="stable")[min(turn, d - 1)])
    z = np.zeros(d)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -off[i] / safe(down[i]) * z[i + 1]
    for i in range(k + 1, d):
        z[i] = -off[i - 1] / safe(up[i]) * z[i - 1]
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of r'r, falling, and their unit vectors as rows; vectors of close values are made
    orthogonal, taking another pivot where one leads into the span of those before."""
    diagonal, above, v = bidiagonal(r)
    values = dqds(diagonal, above)[:k]
    found: list[np.ndarray] = []
    for value in values:
        best = np.zeros(len(diagonal))
        for turn in range(len(diagonal)):
            z = twisted(diagonal, above, value, turn)
            for _ in range(2):
                for other in found:
                    z = z - (other @ z) * other
            norm = np.linalg.norm(z)
            if norm > np.linalg.norm(best):
                best = z
            if norm > 0.5:
                break
        found.append(best / np.linalg.norm(best))
    return values, (v @ np.array(found).T).T if found else np.zeros((0, len(diagonal)))
