"""Eigendecompositions that are kept up under rank-one updates: diag(e) + rho * z z' by the roots of its secular equation.

Components of z that do not matter are deflated, and so are equal eigenvalues: a reflection leaves one of them with a share in z.
The other roots lie between neighbouring eigenvalues. They are found for all at once, as distances from the nearer end, by rational
interpolation inside a shrinking bracket; the eigenvectors come from weights that fit the found roots exactly, so that they are
orthogonal even where roots nearly meet.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
MOST_STEPS = 80


def _roots(e: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (e - x)) for rising, distinct e and positive z2: the number of the pole each is measured from and the
    distance from it."""
    k = len(e)
    top = z2.sum()
    width = np.append(np.diff(e), top)
    # The sign at the middle of the interval tells which pole is nearer.
    at_middle = 1.0 + (z2[None, :] / (e[None, :] - e[:, None] - width[:, None] / 2)).sum(1)
    origin = np.arange(k)
    right = (at_middle < 0) & (origin < k - 1)
    origin = origin + right
    gaps = e[None, :] - e[origin][:, None]
    low = np.where(right, -width / 2, np.where(at_middle < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(at_middle < 0, width, width / 2))
    x = np.where(at_middle < 0, np.where(right, -width / 4, 0.75 * width), width / 4)
    below = np.tri(k, dtype=bool)
    left_pole = np.where(right, -width, 0.0)
    right_pole = np.where(right, 0.0, width)
    found = np.zeros(k, bool)
    for _ in range(MOST_STEPS):
        apart = gaps - x[:, None]
        terms = z2[None, :] / apart
        f = 1.0 + terms.sum(1)
        size = 1.0 + np.abs(terms).sum(1)
        rising = f > 0
        high = np.where(rising, x, high)
        low = np.where(rising, low, x)
        found |= (np.abs(f) <= 8 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if found.all():
            break
        slopes = terms / apart
        psi = np.where(below, slopes, 0.0).sum(1)
        phi = slopes.sum(1) - psi
        to_left, to_right = left_pole - x, right_pole - x
        c = f - to_left * psi - to_right * phi
        a = (to_left + to_right) * f - to_left * to_right * (psi + phi)
        b = to_left * to_right * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        found |= np.abs(step) <= EPS * np.abs(x)
        # Outside of the bracket: halve.
        x = np.where(found, x, np.where((new > low) & (new < high), new, (low + high) / 2))
    return origin, x


def rank_one(e: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors (columns) of u diag(e) u' + rho v v', for rho >= 0."""
    z = u.T @ v
    scale = max(float(np.abs(e).max(initial=0.0)), rho * float(z @ z))
    if scale == 0.0 or rho == 0.0:
        return e, u
    norm = np.sqrt(rho) * z
    # Of equal eigenvalues one takes the whole share in z.
    close = np.append(np.diff(e) > 8 * EPS * scale, True)
    starts = np.concatenate([[0], np.flatnonzero(close[:-1]) + 1])
    ends = np.flatnonzero(close) + 1
    groups = ends - starts > 1
    if groups.any():
        u = u.copy()
    for first, past in zip(starts[groups], ends[groups], strict=True):
        part = norm[first:past]
        length = np.sqrt(part @ part)
        if length == 0.0:
            continue
        mirror = part.copy()
        mirror[-1] += length if part[-1] >= 0 else -length
        along = mirror @ mirror
        if along > 0:
            u[:, first:past] -= np.outer(u[:, first:past] @ mirror, mirror * (2 / along))
            norm[first : past - 1] = 0.0
            norm[past - 1] = -length if part[-1] >= 0 else length
    active = np.flatnonzero(np.abs(norm) > 8 * EPS * np.sqrt(scale))
    if not len(active):
        return e, u
    poles, z2 = e[active], norm[active] ** 2
    origin, x = _roots(poles, z2)
    gaps = poles[None, :] - poles[origin][:, None]
    apart = gaps - x[:, None]  # pole j less root i
    # Weights for which the found roots are exact (Loewner).
    k = len(active)
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = apart / between
    np.fill_diagonal(ratio, 1.0)
    fitted = np.sqrt(np.abs(np.diag(apart) * np.prod(ratio, axis=0))) * np.sign(norm[active])
    vectors = fitted[None, :] / apart
    vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    moved = e.copy()
    moved[active] = poles[origin] + x
    if k == len(e):
        turned = u @ vectors.T
    else:
        turned = u.copy()
        turned[:, active] = u[:, active] @ vectors.T
    order = np.argsort(moved, kind="stable")
    return moved[order], turned[:, order]
