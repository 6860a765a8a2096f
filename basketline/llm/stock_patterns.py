"""Cutting-stock patterns by column generation, for items of bounded whole sizes.

The items are a histogram over size classes, so the work does not grow with their number.
A pattern says how many items of each class a stock length holds. The linear program asks for
the fewest stock lengths that use up all items. It starts with patterns of one class each.
A knapsack over all capacities, by dynamic programming, finds the patterns that its prices
value most; they join a pool, from which the simplex method takes its columns. Prices swing
much from round to round, so the knapsack sees them damped: mixed with the best ones so far,
at first with the sizes themselves.

All products are written so that numpy adds them up itself: a threaded BLAS can hang in a process
that has started others since, as a Spark driver has.
"""

from __future__ import annotations

import numpy as np

from basketline.llm.residual_packing import best_fit

#: Part of the bound that the solution may exceed it by, and rounds of pricing at most.
GAP, ROUNDS = 0.003, 600
#: Weight of the best prices so far. Taken back by ``STEP`` as long as no pattern is found.
DAMPING, STEP = 0.9, 0.1
#: Patterns of one round come from capacities this far below the whole; patterns of the pool.
DEPTH, POOL = 256, 6_000
#: Pivots until the inverse is computed anew.
FRESH = 400
_EPS = 1e-6


def class_sizes(capacity: int, resolution: int) -> np.ndarray:
    """The largest size of each class: single sizes at first, then up to 1 / ``resolution`` apart."""
    sizes, size = [], 0
    while size < capacity:
        size += max(1, 1 << max(0, size // resolution).bit_length() >> 1)
        sizes.append(min(size, capacity))
    return np.array(sizes, dtype=np.int64)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of each capacity, and the class taken last there, -1 if one place stays free."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fitting[c]:
            options = best[c - sizes[: fitting[c]]] + values[: fitting[c]]
            k = options.argmax()
            if options[k] > best[c] + 1e-12:
                best[c], taken[c] = options[k], k
    return best, taken


def _pattern(taken: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with row pivots."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)
        both[rows] -= np.outer(factors[rows], both[k])
    return both[:, n:]


class _Basis:
    """The patterns in use, as columns, with the inverse and the amounts."""

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, capacity: int):
        self.demand, self.pivots = demand, 0
        self.columns = np.diag((capacity // sizes).astype(float))
        self.refresh()

    def refresh(self) -> None:
        self.inverse = _inverse(self.columns)
        self.amounts = np.maximum(_times(self.inverse, self.demand), 0)

    @property
    def prices(self) -> np.ndarray:
        return self.inverse.sum(axis=0)

    def enter(self, column: np.ndarray) -> None:
        change = _times(self.inverse, column)
        down = change > 1e-9
        ratio = np.full(len(change), np.inf)
        ratio[down] = self.amounts[down] / change[down]
        out = int(ratio.argmin())
        self.amounts = np.maximum(self.amounts - ratio[out] * change, 0)
        self.amounts[out] = ratio[out]
        row = self.inverse[out] / change[out]
        self.inverse -= np.outer(change, row)
        self.inverse[out] = row
        self.columns[:, out] = column
        self.pivots += 1
        if self.pivots % FRESH == 0:
            self.refresh()

    def improve(self, pool: np.ndarray) -> None:
        """Take patterns of the pool, its rows, until none is worth more than a stock length.

        A degenerate program could go in circles, so the pivots have a limit.
        """
        for _ in range(4 * len(self.demand) + 100):
            if not len(pool):
                return
            worth = _times(pool, self.prices)
            k = int(worth.argmax())
            if worth[k] <= 1 + _EPS:
                return
            self.enter(pool[k])


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as columns, inverse of these, bound) of the linear program.

    ``sizes`` are increasing, ``demand`` is positive. The bound is a least number of stock
    lengths, from the prices (or the plain sizes, if these say more).
    """
    demand = demand.astype(float)
    basis = _Basis(sizes, demand, capacity)
    best_prices, bound = sizes / capacity, float((demand * sizes).sum()) / capacity
    pool, damping = np.zeros((0, len(sizes))), DAMPING
    for _ in range(ROUNDS):
        basis.improve(pool)
        if basis.amounts.sum() <= bound * (1 + GAP):
            break
        mixed = damping * best_prices + (1 - damping) * basis.prices
        values, taken = knapsack(mixed, sizes, capacity)
        # Prices over the best pattern's value are feasible for the dual, so they bound from below.
        mixed /= values[capacity]
        if (demand * mixed).sum() > bound:
            bound, best_prices = float((demand * mixed).sum()), mixed
        prices, found = basis.prices, {}
        for c in range(capacity, max(capacity - DEPTH, 0), -1):
            pattern = _pattern(taken, sizes, c)
            if (prices * pattern).sum() > 1 + _EPS:
                found[pattern.tobytes()] = pattern
        if found:
            pool, damping = np.concatenate([pool, np.stack(list(found.values()))])[-POOL:], DAMPING
        elif damping <= 0:
            break
        else:
            damping = max(0.0, damping - STEP)
    basis.refresh()
    return basis.columns, basis.inverse, bound


def rounded(
    columns: np.ndarray, inverse: np.ndarray, sizes: np.ndarray, demand: np.ndarray, capacity: int
) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of patterns, (times, items of each class), that use up ``demand`` exactly.

    Amounts are rounded down, largest first. What is left over is packed by best fit: it is less
    than a stock length for each pattern, and what ``demand`` differs by from the one solved.
    """
    amounts = np.floor(_times(inverse, demand.astype(float)) + _EPS)
    left, out = demand.astype(np.int64).copy(), []
    for again in (False, True):
        for p in np.argsort(-amounts, kind="stable"):
            pattern = np.rint(columns[:, p]).astype(np.int64)
            used = pattern > 0
            room = int((left[used] // pattern[used]).min())
            times = room if again else min(room, int(max(amounts[p], 0)))
            if times > 0:
                out.append((times, pattern))
                left -= times * pattern
    classes = np.repeat(np.arange(len(sizes)), left)
    for positions in best_fit(sizes[classes].tolist(), capacity):
        out.append((1, np.bincount(classes[positions], minlength=len(sizes))))
    return out
