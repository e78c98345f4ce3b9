"""The leading eigenpairs of a symmetric matrix by spectrum slicing.

The number of eigenvalues above a shift is the number of positive pivots of the LDL'
factorisation of the shifted matrix (Sylvester's law of inertia). Bisection on these counts
isolates each leading eigenvalue, Rayleigh quotient iteration converges cubically inside
its interval, and counts on both sides of the result certify its number. Eigenvalues that
no count can tell apart are one cluster, whose vectors are kept orthogonal.

The matrix is as large as the vectors are wide; nothing here grows with the rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
PIVOT = (1 + np.sqrt(17)) / 8  # bounds the growth of entries under diagonal pivoting
STEPS = 60


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``."""
    rest = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(rest):
        column = np.abs(rest[1:, 0])
        most = column.max(initial=0.0)
        size, pair = 1, None
        if most > 0 and abs(rest[0, 0]) < PIVOT * most:
            r = 1 + int(column.argmax())
            row = np.abs(rest[r])
            row[r] = 0
            if abs(rest[0, 0]) * row.max() < PIVOT * most**2:
                if abs(rest[r, r]) >= PIVOT * row.max():
                    pair = (0, r)
                else:
                    size, pair = 2, (1, r)
        if pair:
            i, j = pair
            rest[[i, j]] = rest[[j, i]]
            rest[:, [i, j]] = rest[:, [j, i]]
        pivot, side = rest[:size, :size], rest[size:, :size]
        if size == 2:
            count += 1  # a pivot of two has one eigenvalue of each sign
        elif pivot[0, 0] > 0:
            count += 1
        elif pivot[0, 0] == 0:  # then its column is zero, too: an eigenvalue at the shift
            rest = rest[1:, 1:]
            continue
        rest = rest[size:, size:] - side @ np.linalg.solve(pivot, side.T)
    return count


def _bounds(matrix: np.ndarray) -> tuple[float, float]:
    """An interval that holds all eigenvalues (Gershgorin's circles)."""
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    slack = EPS * len(matrix) * np.abs(matrix).max()
    return (np.diag(matrix) - radius).min() - slack, (np.diag(matrix) + radius).max() + slack


class _Counts:
    """Counts at the shifts asked for so far; they bracket every eigenvalue."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        low, high = _bounds(matrix)
        self.known = {low: len(matrix), high: 0}

    def at(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.matrix, shift)
        return self.known[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The tightest known interval of the ``number``-th largest eigenvalue."""
        low = max(s for s, n in self.known.items() if n >= number)
        high = min(s for s, n in self.known.items() if n < number)
        return low, high


def _iterate(matrix: np.ndarray, shift: float, others: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """Inverse iteration at ``shift``, then Rayleigh quotient iteration; orthogonal to ``others``."""
    scale = np.abs(matrix).max()
    identity = np.eye(len(matrix))
    vector = np.random.default_rng(seed).standard_normal(len(matrix))
    value, least = shift, np.inf
    best = None
    for step in range(STEPS):
        vector = vector - others @ (others.T @ vector)
        vector /= np.linalg.norm(vector)
        if step > 2:
            value = vector @ matrix @ vector
        residual = np.linalg.norm(matrix @ vector - (vector @ matrix @ vector) * vector)
        if residual < least:
            best, least = vector, residual
        elif step > 4:
            break
        shifted = matrix - value * identity
        try:
            vector = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            vector = np.linalg.solve(shifted + EPS * scale * identity, vector)
        if not np.isfinite(vector).all():
            break
    vector = best - others @ (others.T @ best)
    vector /= np.linalg.norm(vector)
    return float(vector @ matrix @ vector), vector


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``most`` largest eigenvalues above rounding error, falling, and unit vectors.

    Returns fewer if the matrix has fewer eigenvalues that differ from zero. Raises
    ``ArithmeticError`` if the counts do not confirm an eigenvalue's number.
    """
    width = len(matrix)
    trace = float(np.trace(matrix)) if width else 0.0
    values, vectors = np.empty(0), np.empty((width, 0))
    if not trace > 0:
        return values, vectors
    counts = _Counts(matrix)
    floor = EPS * width * trace  # below it an eigenvalue is nothing but rounding
    for number in range(1, min(most, counts.at(floor)) + 1):
        tolerance = 8 * floor
        value, vector = None, None
        while value is None:
            low, high = counts.bracket(number)
            middle = (low + high) / 2
            alone = counts.at(low) - counts.at(high) == 1
            if high - low > tolerance and not (alone and high - low < 0.5 * high):
                counts.at(middle)
                continue
            value, vector = _iterate(matrix, middle, vectors, number)
            if not low - tolerance <= value <= high + tolerance:
                value = None  # went to a neighbour: look closer
                if high - low <= tolerance:
                    raise ArithmeticError(f"eigenvalue {number} was not found in its interval")
                counts.at(middle)
        if not counts.at(value + tolerance) < number <= counts.at(value - tolerance):
            raise ArithmeticError(f"counts do not confirm eigenvalue {number}")
        values = np.append(values, value)
        vectors = np.column_stack((vectors, vector))
    order = np.argsort(-values, kind="stable")  # inside a cluster rounding may swap them
    return values[order], vectors[:, order]
