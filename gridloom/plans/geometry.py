"""Index geometry on the driver: extents, boxes, permutations and affine maps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

MAX_RANK = 3


def ceil_div(x: int, y: int) -> int:
    """The least integer not below x / y, for any signs."""
    return -(-x // y)


def round_up(x: int, y: int) -> int:
    return ceil_div(x, y) * y


@dataclass(frozen=True)
class Point:
    """Coordinates of one cell."""

    at: tuple[int, ...]

    def __iter__(self) -> Iterator[int]:
        return iter(self.at)

    def least(self, other: Point) -> Point:
        return Point(tuple(map(min, self.at, other.at)))

    def most(self, other: Point) -> Point:
        return Point(tuple(map(max, self.at, other.at)))

    def plus(self, other: Point) -> Point:
        return Point(tuple(a + b for a, b in zip(self.at, other.at)))

    def minus(self, other: Point) -> Point:
        """Difference, not below zero."""
        return Point(tuple(max(0, a - b) for a, b in zip(self.at, other.at)))


@dataclass(frozen=True)
class Rect:
    """A half-open box lo..hi. An empty box has some hi <= lo."""

    lo: tuple[int, ...]
    hi: tuple[int, ...]

    def __post_init__(self):
        if len(self.lo) != len(self.hi) or len(self.lo) > MAX_RANK:
            raise ValueError(f"a box has the same number of bounds, at most {MAX_RANK}")

    @classmethod
    def of(cls, *ranges: tuple[int, int]) -> Rect:
        return cls(tuple(r[0] for r in ranges), tuple(r[1] for r in ranges))

    @property
    def rank(self) -> int:
        return len(self.lo)

    @property
    def extents(self) -> tuple[int, ...]:
        return tuple(max(0, h - l) for l, h in zip(self.lo, self.hi))

    @property
    def volume(self) -> int:
        return reduce(lambda a, b: a * b, self.extents, 1)

    @property
    def empty(self) -> bool:
        return self.volume == 0

    def contains(self, point: tuple[int, ...]) -> bool:
        return all(l <= p < h for l, p, h in zip(self.lo, point, self.hi))

    def holds(self, other: Rect) -> bool:
        return other.empty or all(l <= a and b <= h for l, a, b, h in zip(self.lo, other.lo, other.hi, self.hi))

    def meets(self, other: Rect) -> bool:
        return not self.intersection(other).empty

    def intersection(self, other: Rect) -> Rect:
        return Rect(tuple(map(max, self.lo, other.lo)), tuple(map(min, self.hi, other.hi)))

    def union(self, other: Rect) -> Rect:
        """Bounding box; empty boxes do not count."""
        if self.empty:
            return other
        if other.empty:
            return self
        return Rect(tuple(map(min, self.lo, other.lo)), tuple(map(max, self.hi, other.hi)))

    def shifted(self, by: tuple[int, ...]) -> Rect:
        return Rect(tuple(a + b for a, b in zip(self.lo, by)), tuple(a + b for a, b in zip(self.hi, by)))

    def __iter__(self) -> Iterator[tuple[int, ...]]:
        """Cells in row-major order."""
        return itertools.product(*[range(l, h) for l, h in zip(self.lo, self.hi)])


def extents_of(shape: object) -> tuple[int, ...]:
    """Extents from a number, a tuple or list of at most three, or nothing (a scalar)."""
    dims = () if shape is None else (shape,) if isinstance(shape, int) else tuple(shape)
    if len(dims) > MAX_RANK or any(not isinstance(d, int) or d < 0 for d in dims):
        raise ValueError(f"bad shape {shape!r}")
    return dims


@dataclass(frozen=True)
class Permutation:
    """Input axis k becomes output axis axes[k]."""

    axes: tuple[int, ...]

    def __post_init__(self):
        if sorted(self.axes) != list(range(len(self.axes))):
            raise ValueError(f"{self.axes} is no permutation")

    @classmethod
    def identity(cls, rank: int) -> Permutation:
        return cls(tuple(range(rank)))

    @classmethod
    def swap(cls, rank: int, a: int, b: int) -> Permutation:
        axes = list(range(rank))
        axes[a], axes[b] = axes[b], axes[a]
        return cls(tuple(axes))

    def apply(self, values: tuple) -> tuple:
        out = [None] * len(self.axes)
        for k, a in enumerate(self.axes):
            out[a] = values[k]
        return tuple(out)

    def inverse(self) -> Permutation:
        return Permutation(tuple(self.axes.index(k) for k in range(len(self.axes))))

    def then(self, other: Permutation) -> Permutation:
        return Permutation(tuple(other.axes[a] for a in self.axes))


@dataclass(frozen=True)
class Affine:
    """y = matrix x + offset, with integer entries."""

    matrix: tuple[tuple[int, ...], ...]
    offset: tuple[int, ...]

    @classmethod
    def identity(cls, rank: int) -> Affine:
        return cls(tuple(tuple(int(i == j) for j in range(rank)) for i in range(rank)), (0,) * rank)

    @classmethod
    def translate(cls, by: tuple[int, ...]) -> Affine:
        return cls(cls.identity(len(by)).matrix, tuple(by))

    def apply(self, x: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(sum(m * v for m, v in zip(row, x)) + c for row, c in zip(self.matrix, self.offset))

    def then(self, other: Affine) -> Affine:
        """First this map, then the other."""
        columns = list(zip(*self.matrix)) if self.matrix else []
        matrix = tuple(tuple(sum(a * b for a, b in zip(row, col)) for col in columns) for row in other.matrix)
        return Affine(matrix, other.apply(self.offset))

    def bounds(self, box: Rect) -> Rect:
        """The least box around the image of a box."""
        lo, hi = [], []
        for row, c in zip(self.matrix, self.offset):
            ends = [sorted((m * l, m * (h - 1))) for m, l, h in zip(row, box.lo, box.hi)]
            lo.append(c + sum(e[0] for e in ends))
            hi.append(c + sum(e[1] for e in ends) + 1)
        return Rect(tuple(lo), tuple(hi))

    @property
    def regular(self) -> bool:
        """Each output uses at most one input, and the other way round: boxes map to boxes."""
        rows_ok = all(sum(m != 0 for m in row) <= 1 for row in self.matrix)
        return rows_ok and all(sum(m != 0 for m in col) <= 1 for col in zip(*self.matrix))
