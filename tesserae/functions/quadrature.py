"""Quadrature rules on [0, 1], the unit triangle and pairs of triangles, as small numpy tables."""

from __future__ import annotations

from functools import cache

import numpy as np


@cache
def gauss(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [0, 1], from the eigenproblem of the Jacobi matrix of Legendre polynomials."""
    k = np.arange(1, order)
    off = k / np.sqrt(4.0 * k * k - 1)
    x, v = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return (x + 1) / 2, v[0] ** 2


@cache
def triangle(order: int) -> tuple[np.ndarray, np.ndarray]:
    """order^2 points (s, t) with s + t <= 1 and weights that sum to 1/2, by collapsing the square."""
    x, w = gauss(order)
    a, b = np.meshgrid(x, x, indexing="ij")
    return np.stack([(1 - a).ravel(), (a * b).ravel()], 1), (np.outer(w, w) * a).ravel()


def _simplex(points: np.ndarray) -> np.ndarray:
    """From the simplex 0 <= y <= x <= 1 to s + t <= 1."""
    return np.stack([points[:, 0] - points[:, 1], points[:, 1]], 1)


@cache
def triangle_pair(common: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points on two unit triangles and weights, for triangles with `common` shared vertices, listed first.

    Regularising transformations split the four-dimensional domain into cones on whose tip or ridge the singularity lies:
    6 for equal triangles, 5 for a shared edge, 2 for a shared vertex; distant triangles take the product rule. The weights
    sum to 1/4.
    """
    if common == 0:
        p, w = triangle(order)
        return np.repeat(p, len(p), 0), np.tile(p, (len(p), 1)), np.outer(w, w).ravel()
    x, w = gauss(order)
    xi, e1, e2, e3 = (a.ravel() for a in np.meshgrid(x, x, x, x, indexing="ij"))
    weight = np.einsum("i,j,k,l->ijkl", w, w, w, w).ravel()
    if common == 3:
        jac = xi**3 * e1**2 * e2
        one, b, c = xi, xi * e1, xi * e1 * e2
        d = c * e3
        maps = [
            ((one, one - b + c), (one - d, one - b)),
            ((one - d, one - b), (one, one - b + c)),
            ((one, b - c + d), (one - c, b - c)),
            ((one - c, b - c), (one, b - c + d)),
            ((one - d, b - d), (one, b - c)),
            ((one, b - c), (one - d, b - d)),
        ]
        jacs = [jac] * 6
    elif common == 2:
        jac1, jac2 = xi**3 * e1**2, xi**3 * e1**2 * e2
        maps = [
            ((xi, xi * e1 * e3), (xi * (1 - e1 * e2), xi * e1 * (1 - e2))),
            ((xi, xi * e1), (xi * (1 - e1 * e2 * e3), xi * e1 * e2 * (1 - e3))),
            ((xi * (1 - e1 * e2), xi * e1 * (1 - e2)), (xi, xi * e1 * e2 * e3)),
            ((xi * (1 - e1 * e2 * e3), xi * e1 * e2 * (1 - e3)), (xi, xi * e1)),
            ((xi * (1 - e1 * e2 * e3), xi * e1 * (1 - e2 * e3)), (xi, xi * e1 * e2)),
        ]
        jacs = [jac1, jac2, jac2, jac2, jac2]
    elif common == 1:
        jac = xi**3 * e2
        maps = [((xi, xi * e1), (xi * e2, xi * e2 * e3)), ((xi * e2, xi * e2 * e3), (xi, xi * e1))]
        jacs = [jac, jac]
    else:
        raise ValueError("triangles share 0 to 3 vertices")
    first = np.concatenate([np.stack(a, 1) for a, _ in maps])
    second = np.concatenate([np.stack(b, 1) for _, b in maps])
    return _simplex(first), _simplex(second), np.concatenate([weight * j for j in jacs])


def adjusted_order(order: int, distance: float, diameter: float) -> int:
    """One less for each factor of five by which triangles are farther apart than five diameters; 1 at least."""
    if distance <= 0 or diameter <= 0:
        return order
    ratio = distance / (5 * diameter)
    while ratio > 1 and order > 1:
        order, ratio = order - 1, ratio / 5
    return order
