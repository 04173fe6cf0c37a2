"""Singular values and right singular vectors of a small matrix: Householder bidiagonalisation, dqds, twisted
factorisations. Sizes are those of one vector (d by d); nothing here grows with the number of rows."""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of the upper bidiagonal B with r = P B Q^T, and Q."""
    a = np.array(r, float)
    d = a.shape[1]
    turn = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k + 2 < d:
            v, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
            turn[:, k + 1 :] -= np.outer(turn[:, k + 1 :] @ v, beta * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), turn


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta so that x - beta v (v . x) has nothing but its first entry."""
    top = np.abs(x).max(initial=0.0)
    if not top:
        return np.zeros_like(x), 0.0
    v = x / top
    v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
    return v, 2.0 / float(v @ v)


def _dqds(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference step with shift s; None where s is beyond the least eigenvalue."""
    n = len(q)
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - s
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        out_q[i] = d + e[i]
        if not out_q[i]:
            return None
        t = q[i + 1] / out_q[i]
        out_e[i] = e[i] * t
        d = d * t - s
        least = min(least, d)
    if d < 0 or math.isnan(d):
        return None
    out_q[-1] = d
    return out_q, out_e, least


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, each to high relative accuracy.

    A step without a shift never fails. Its least pivot bounds the least eigenvalue from above, so the next step takes a
    little less as its shift; a shift that was too large is halved until the step succeeds or is none. Entries that no
    longer count are taken off, and a zero between two parts lets them be solved one by one.
    """
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    if not scale:
        return np.zeros(len(diagonal))
    found: list[float] = []
    parts = [([(x / scale) ** 2 for x in diagonal.tolist()], [(x / scale) ** 2 for x in above.tolist()], 0.0)]
    while parts:
        q, e, shift = parts.pop()
        guess, stuck = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shift)
                break
            floor = EPS * EPS
            if e[-1] <= floor * (shift + q[-1]) or e[-1] < 1e-290:
                found.append(q.pop() + shift)
                e.pop()
                guess = 0.0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= floor * (shift + min(q[i], q[i + 1])) or e[i] < 1e-290), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], shift))
                q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if not stuck and 2 * q[0] < q[-1]:  # small ones belong at the end: the reversed matrix has the same values
                q, e = q[::-1], e[::-1]
            stuck += 1
            if stuck > 100 * (n + 10):
                raise ArithmeticError("dqds did not settle")
            step = _dqds(q, e, guess)
            while step is None:
                guess = guess / 4 if guess > EPS * shift and guess > 1e-280 else 0.0
                step = _dqds(q, e, guess) or (None if guess else _zeroed(q, e))
            shift += guess
            q, e, least = step
            low = least - math.sqrt(max(e[-1], 0.0) * max(q[-1], 0.0)) if least == q[-1] else 0.75 * least
            guess = max(low, 0.0) if low > 0.25 * least else 0.25 * least
    return np.sort(np.array(found))[::-1] * scale * scale


def _zeroed(q: list[float], e: list[float]) -> tuple[list[float], list[float], float]:
    """A step without a shift for a matrix with a zero on its diagonal, whose least eigenvalue is 0."""
    n = len(q)
    out_q, out_e, d = [0.0] * n, [0.0] * (n - 1), q[0]
    for i in range(n - 1):
        out_q[i] = d + e[i]
        if out_q[i] > 0:
            out_e[i] = e[i] * (q[i + 1] / out_q[i])
            d = d * (q[i + 1] / out_q[i])
        else:
            out_e[i], d = 0.0, q[i + 1]
    out_q[-1] = d
    return out_q, out_e, 0.0


def _factors(n: int, d: np.ndarray, ld: np.ndarray, lld: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both factorisations of L D L^T - value, from the top (L+) and from the bottom (U-), and the pivot that each place
    would have as the twist."""
    tiny = 1e-290
    low, s = np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        p = s[i] + d[i]
        low[i] = ld[i] / (p if abs(p) > tiny else tiny)
        s[i + 1] = low[i] * (ld[i] / d[i]) * s[i] - value
    up, p = np.empty(max(n - 1, 0)), np.empty(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        m = lld[i] + p[i + 1]
        t = d[i] / (m if abs(m) > tiny else tiny)
        up[i] = (ld[i] / d[i]) * t
        p[i] = p[i + 1] * t - value
    return low, up, s + p + value


def _twisted(n: int, low: np.ndarray, up: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """The vector whose twist is at the least pivot: one there, up by L+, down by U-."""
    r = int(np.nanargmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
        if not np.isfinite(z[i + 1]):
            z[i + 1] = 0.0
    return z


def right_vectors(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray, close: float = 1e-5) -> np.ndarray:
    """Unit right singular vectors of an upper bidiagonal matrix, a column for each square, from twisted factorisations
    of B^T B = L D L^T less the square: started where the twist's pivot is least, a vector is one sweep up and one down.

    Squares closer than `close` (against the larger) are one cluster: there each vector is taken through inverse
    iteration and set at right angles to the earlier ones of its cluster.
    """
    n = len(diagonal)
    out = np.zeros((n, len(squares)))
    top = max(float(squares.max(initial=0)), 1e-300)
    # parts between zeros of the superdiagonal have vectors of their own
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * EPS * math.sqrt(top)) + 1).tolist(), n]
    if len(cuts) > 2:
        return _by_parts(diagonal, above, squares, close, cuts)
    a = np.where(np.abs(diagonal) < EPS * math.sqrt(top) * 1e-3, EPS * math.sqrt(top) * 1e-3, diagonal)
    d = a * a
    ld = a[:-1] * above
    lld = above * above
    made: list[int] = []
    rng = np.random.default_rng(5)
    for k, value in enumerate(squares.tolist()):
        cluster = [j for j in made if abs(squares[j] - value) <= close * max(squares[j], EPS * top)]
        z = _twisted(n, *_factors(n, d, ld, lld, value))
        z /= np.linalg.norm(z)
        if cluster:
            basis = out[:, cluster]
            z -= basis @ (basis.T @ z)
            if np.linalg.norm(z) < 0.5:
                z = _inverse_iterated(n, d, ld, lld, value, basis, rng, top)
        out[:, k] = z / np.linalg.norm(z)
        made.append(k)
    return out


def _inverse_iterated(n, d, ld, lld, value, basis, rng, top) -> np.ndarray:
    """A vector of the cluster at right angles to basis, by inverse iteration on the tridiagonal matrix."""
    main = d + np.append(0.0, lld) - value
    z = rng.standard_normal(n)
    for _ in range(6):
        z -= basis @ (basis.T @ z)
        z -= basis @ (basis.T @ z)
        z /= np.linalg.norm(z)
        z = _tridiagonal_solve(main, ld, z, EPS * top)
    z -= basis @ (basis.T @ z)
    z /= np.linalg.norm(z)
    z -= basis @ (basis.T @ z)
    return z


def _tridiagonal_solve(main: np.ndarray, off: np.ndarray, rhs: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of a symmetric tridiagonal system with row exchanges; a zero pivot counts as tiny."""
    n = len(main)
    u, v, w, b = main.copy(), np.append(off, 0.0), np.zeros(n), rhs.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(u[i]):
            m = u[i] / low
            next_u, next_v = u[i + 1], v[i + 1]
            u[i + 1], v[i + 1] = v[i] - m * next_u, -m * next_v
            u[i], v[i], w[i] = low, next_u, next_v
            b[i], b[i + 1] = b[i + 1], b[i] - m * b[i + 1]
        else:
            if abs(u[i]) < tiny:
                u[i] = tiny
            m = low / u[i]
            u[i + 1] -= m * v[i]
            b[i + 1] -= m * b[i]
    if abs(u[-1]) < tiny:
        u[-1] = tiny
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        pivot = u[i] if abs(u[i]) >= tiny else tiny
        x[i] = (b[i] - v[i] * x[i + 1] - w[i] * x[i + 2]) / pivot
    return x[:n]


def _by_parts(diagonal, above, squares, close, cuts) -> np.ndarray:
    """Each part's squares are found anew and dealt to the given ones in order."""
    n = len(diagonal)
    columns = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own = singular_squares(diagonal[low:high], above[low : high - 1])
        vectors = right_vectors(diagonal[low:high], above[low : high - 1], own, close)
        for k, value in enumerate(own.tolist()):
            z = np.zeros(n)
            z[low:high] = vectors[:, k]
            columns.append((value, z))
    columns.sort(key=lambda c: -c[0])
    return np.array([z for _, z in columns[: len(squares)]]).T.reshape(n, -1)


def principal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of r (rows of a triangle, d columns), falling, and unit right singular vectors as
    columns. Values below rounding (d * eps * the largest) count as 0."""
    d = r.shape[1]
    square = np.zeros((d, d))
    square[: min(d, len(r))] = r[:d]
    top = float(np.abs(square).max(initial=0))
    if not top:
        return np.zeros(d), np.eye(d)
    a, b, turn = bidiagonal(square / top)
    squares = singular_squares(a, b)
    vectors = turn @ right_vectors(a, b, squares)
    squares = np.where(squares > (4 * d * EPS) ** 2 * squares[0], squares, 0.0)
    return squares * top * top, vectors
