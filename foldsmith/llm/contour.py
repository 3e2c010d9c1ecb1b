"""Leading eigenpairs of a symmetric matrix by contour integration, counted by inertia.

The matrix has one row per vector dimension, so it is small however many vectors there are.
"""

from __future__ import annotations

import numpy as np

NODES = 16
ROUNDS = 100
# Eigenvalues past the wanted ones whose gaps are looked at for the end of the interval.
LOOK_AHEAD = 8


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a similar tridiagonal matrix (Householder reflections)."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def count_above(diagonal: np.ndarray, squares: np.ndarray, shift: float) -> int:
    """Inertia: how many eigenvalues lie above ``shift``, the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny
    pivot, above = 1.0, 0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (squares[i - 1] / pivot if i else 0.0)
        if pivot == 0:
            pivot = tiny
        above += pivot > 0
    return above


def _place(diagonal: np.ndarray, squares: np.ndarray, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue, to eight digits of the range, by halving."""
    for _ in range(30):
        middle = (low + high) / 2
        if count_above(diagonal, squares, middle) >= k:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def leading_interval(a: np.ndarray, k: int) -> tuple[float, float, int]:
    """(low, high, count): an interval that holds the ``count`` >= k largest eigenvalues and no other.

    Its low end stands in the widest of the gaps behind the k-th to the (k + LOOK_AHEAD)-th eigenvalue, so a group
    of equal eigenvalues is not cut.
    """
    n = len(a)
    diagonal, squares = tridiagonal(a)
    reach = np.abs(a).sum(axis=1).max() * 1.01 + np.finfo(float).tiny
    last = min(n, k + LOOK_AHEAD + 1)
    places = [_place(diagonal, squares, j, -reach, reach) for j in range(k, last + 1)]
    gaps = [places[i] - places[i + 1] for i in range(len(places) - 1)]
    top = _place(diagonal, squares, 1, -reach, reach)
    if last == n and len(places) < LOOK_AHEAD + 2:
        gaps.append(reach)  # behind the least eigenvalue there is room
        places.append(places[-1] - 0.02 * reach)
    at = int(np.argmax(gaps))
    # Where no gap can be told apart, the whole group of equal eigenvalues comes in.
    low = places[at] - max(gaps[at] / 2, 1e-5 * top)
    high = top + max((top - low) * 0.05, 1e-6 * reach)
    return low, high, count_above(diagonal, squares, low)


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns; of a matrix of lower rank the
    rest are zeros with directions across.

    A Gauss-Legendre rule over the upper half circle around the interval solves the shifted systems and so projects
    a block of vectors onto the eigenvectors inside; Rayleigh-Ritz reads the pairs off; rounds repeat until the
    residuals are at rounding level and the inertia count says that none is missed.
    """
    n = len(a)
    k = min(k, n)
    scale = np.trace(a)
    if k == 0 or not scale > 0:
        return np.zeros(k), np.eye(n)[:, :k]
    a = a / scale
    asked, k = k, min(k, count_above(*tridiagonal(a), 16 * n * np.finfo(float).eps))
    low, high, wanted = leading_interval(a, k)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 + nodes)
    points = centre + radius * np.exp(1j * angles)
    inverses = [np.linalg.inv(z * np.eye(n) - a) for z in points]
    projector = sum(w / 2 * (radius * np.exp(1j * t) * inv).real for w, t, inv in zip(weights, angles, inverses))
    block = np.random.default_rng(7).standard_normal((n, min(n, 2 * wanted + 8)))
    limit = 64 * np.finfo(float).eps * np.linalg.norm(a, 2)
    before = np.inf
    for _ in range(ROUNDS):
        basis = np.linalg.qr(projector @ block)[0]
        values, turn = np.linalg.eigh(basis.T @ a @ basis)
        vectors = basis @ turn
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max(initial=0.0)
        if inside.sum() == wanted and (residual <= limit or (residual >= before / 2 and residual <= 64 * limit)):
            break
        before, block = residual, vectors
    else:
        raise ArithmeticError(f"{int(inside.sum())} of {wanted} eigenpairs found, residual {residual:.1e}")
    order = np.argsort(-values[inside], kind="stable")[:k]
    found = vectors[:, inside][:, order]
    rest = np.random.default_rng(8).standard_normal((n, asked - k))
    both = np.linalg.qr(np.hstack([found, rest]))[0] if asked > k else found / np.linalg.norm(found, axis=0)
    return np.concatenate([values[inside][order] * scale, np.zeros(asked - k)]), both
