"""How arrays are cut in chunks, and what that means for Spark partitions.

A distribution lists boxes (owned cells, and stored cells where halos overlap) and gives the
chunk of a cell as column expressions, by which a frame can be partitioned.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.geometry import Permutation, Rect, ceil_div, round_up


@dataclass(frozen=True)
class Chunk:
    """number, the cells it owns, the cells it stores, and the place it is put on."""

    number: int
    owned: Rect
    stored: Rect
    place: int = 0


def axis(k: int) -> str:
    return f"i{k}"


class Distribution:
    """Base: regular tiles with optional halos. tile has an extent for each axis of the array."""

    copies = 1

    def tile_of(self, extents: tuple[int, ...]) -> tuple[int, ...]:
        raise NotImplementedError

    def halo_of(self, extents: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        zero = (0,) * len(extents)
        return zero, zero

    def shift_of(self, extents: tuple[int, ...]) -> tuple[int, ...]:
        return (0,) * len(extents)

    def grid(self, extents: tuple[int, ...]) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(max(1, ceil_div(n + s, t)) for n, t, s in zip(extents, self.tile_of(extents), self.shift_of(extents)))

    def chunks(self, extents: tuple[int, ...], places: int = 1) -> Iterator[Chunk]:
        tile, shift = self.tile_of(extents), self.shift_of(extents)
        before, after = self.halo_of(extents)
        for number, at in enumerate(itertools.product(*[range(g) for g in self.grid(extents)])):
            lo = tuple(max(0, a * t - s) for a, t, s in zip(at, tile, shift))
            hi = tuple(min(n, (a + 1) * t - s) for a, t, s, n in zip(at, tile, shift, extents))
            stored = Rect(tuple(max(0, l - b) for l, b in zip(lo, before)), tuple(min(n, h + b) for h, b, n in zip(hi, after, extents)))
            yield Chunk(number, Rect(lo, hi), stored, number % places)

    def key(self, extents: tuple[int, ...]) -> list[Column]:
        """The chunk of a cell, one expression an axis."""
        return [F.floor((F.col(axis(k)) + s) / t).cast("long") for k, (t, s) in enumerate(zip(self.tile_of(extents), self.shift_of(extents)))]

    def number(self, extents: tuple[int, ...]) -> Column:
        """The chunk of a cell as one number, row-major over the grid."""
        out = F.lit(0).cast("long")
        for k, g in zip(self.key(extents), self.grid(extents)):
            out = out * g + k
        return out

    def place(self, df: DataFrame, extents: tuple[int, ...], partitions: int | None = None) -> DataFrame:
        """The frame with each chunk within one partition."""
        keys = self.key(extents)
        if not keys:
            return df.coalesce(1)
        return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def with_halo(self, df: DataFrame, extents: tuple[int, ...]) -> DataFrame:
        """Each cell once for each chunk that stores it: adds `chunk` and `owned`.

        A cell goes to the few chunks around its own, so rows grow by the halo's share only.
        """
        tile, shift, grid = self.tile_of(extents), self.shift_of(extents), self.grid(extents)
        before, after = self.halo_of(extents)
        out = df
        for k in range(len(extents)):
            # chunks c that store x: c*t - s - before <= x < (c+1)*t - s + after
            x = F.col(axis(k)) + shift[k]
            low = F.greatest(F.floor((x - after[k]) / tile[k]).cast("long"), F.lit(0).cast("long"))
            high = F.least(F.floor((x + before[k]) / tile[k]).cast("long"), F.lit(grid[k] - 1).cast("long"))
            out = out.withColumn(f"_c{k}", F.explode(F.sequence(low, high)))
        chunk, owned = F.lit(0).cast("long"), F.lit(True)
        for k, own in enumerate(self.key(extents)):
            chunk = chunk * grid[k] + F.col(f"_c{k}")
            owned = owned & (F.col(f"_c{k}") == own)
        return out.withColumn("chunk", chunk).withColumn("owned", owned).drop(*[f"_c{k}" for k in range(len(extents))])

    def regions(self, spark: SparkSession, extents: tuple[int, ...], places: int = 1) -> DataFrame:
        """(chunk, place, t0.., lo0, hi0, ..): owned boxes, computed from the chunk number."""
        grid, tile, shift = self.grid(extents), self.tile_of(extents), self.shift_of(extents)
        total = 1
        for g in grid:
            total *= g
        df = spark.range(total).select(F.col("id").alias("chunk"), F.pmod("id", F.lit(places)).cast("int").alias("place"))
        rest = total
        for k, g in enumerate(grid):
            rest //= g
            df = df.withColumn(f"t{k}", F.pmod(F.floor(F.col("chunk") / rest), F.lit(g)).cast("long"))
            df = df.withColumn(f"lo{k}", F.greatest(F.lit(0), F.col(f"t{k}") * tile[k] - shift[k]).cast("long"))
            df = df.withColumn(f"hi{k}", F.least(F.lit(extents[k]), (F.col(f"t{k}") + 1) * tile[k] - shift[k]).cast("long"))
        return df

    def order(self, chunks: list[Chunk]) -> list[Chunk]:
        return chunks


@dataclass(frozen=True)
class Central(Distribution):
    """One chunk."""

    def tile_of(self, extents):
        return tuple(max(1, n) for n in extents)

    def place(self, df, extents, partitions=None):
        return df.coalesce(1)


@dataclass(frozen=True)
class Replicated(Central):
    """A full copy for each place; in Spark, a frame that may be broadcast."""

    copies: int = 1

    def place(self, df, extents, partitions=None):
        return df


@dataclass(frozen=True)
class Tiles(Distribution):
    """Tiles of one to three axes, dealt out cyclically. A short tile covers later axes whole."""

    tile: tuple[int, ...]

    def tile_of(self, extents):
        given = (self.tile,) if isinstance(self.tile, int) else tuple(self.tile)
        if any(t < 1 for t in given):
            raise ValueError("tiles hold a cell")
        return given[: len(extents)] + tuple(max(1, n) for n in extents[len(given) :])


@dataclass(frozen=True)
class AxisCyclic(Distribution):
    """Blocks of a fixed size along one axis, dealt out cyclically."""

    block: int
    along: int = 0

    def tile_of(self, extents):
        return tuple(self.block if k == self.along else max(1, n) for k, n in enumerate(extents))


@dataclass(frozen=True)
class AxisBlocks(Distribution):
    """Even contiguous blocks along one axis, a number of them, optionally aligned."""

    parts: int
    along: int = 0
    alignment: int = 1

    def tile_of(self, extents):
        return tuple(max(1, round_up(ceil_div(n, self.parts), self.alignment)) if k == self.along else max(1, n) for k, n in enumerate(extents))

    def place(self, df, extents, partitions=None):
        return df.repartitionByRange(partitions or self.parts, axis(self.along))


def row_cyclic(block: int) -> AxisCyclic:
    return AxisCyclic(block, 0)


def row_blocks(parts: int, alignment: int = 1) -> AxisBlocks:
    return AxisBlocks(parts, 0, alignment)


def column_cyclic(block: int) -> AxisCyclic:
    return AxisCyclic(block, 1)


def column_blocks(parts: int, alignment: int = 1) -> AxisBlocks:
    return AxisBlocks(parts, 1, alignment)


@dataclass(frozen=True)
class Stencil(Distribution):
    """Tiles that also store a halo of their neighbours' cells, in one to three axes.

    before and after give the halo's width on each side; shift moves the tile borders. An
    axis that one tile covers has no halo.
    """

    tile: tuple[int, ...]
    before: tuple[int, ...]
    after: tuple[int, ...] | None = None
    shift: tuple[int, ...] | None = None

    def _full(self, given, extents, rest):
        given = (given,) if isinstance(given, int) else tuple(given or ())
        return given[: len(extents)] + tuple(rest[len(given) :])

    def tile_of(self, extents):
        return self._full(self.tile, extents, tuple(max(1, n) for n in extents))

    def shift_of(self, extents):
        return tuple(s % t for s, t in zip(self._full(self.shift, extents, (0,) * len(extents)), self.tile_of(extents)))

    def halo_of(self, extents):
        tile, zero = self.tile_of(extents), (0,) * len(extents)
        low = self._full(self.before, extents, zero)
        high = self._full(self.before if self.after is None else self.after, extents, zero)
        clear = lambda h: tuple(0 if t >= n else w for w, t, n in zip(h, tile, extents))
        return clear(low), clear(high)


@dataclass(frozen=True)
class Shuffled(Distribution):
    """Another distribution whose chunks are worked on in a random order (seed 0)."""

    inner: Distribution

    def tile_of(self, extents):
        return self.inner.tile_of(extents)

    def halo_of(self, extents):
        return self.inner.halo_of(extents)

    def shift_of(self, extents):
        return self.inner.shift_of(extents)

    def order(self, chunks):
        chunks = list(chunks)
        random.Random(0).shuffle(chunks)
        return chunks


@dataclass(frozen=True)
class Permuted(Distribution):
    """Another distribution over permuted axes."""

    permutation: Permutation
    inner: Distribution

    def _back(self, values):
        return self.permutation.inverse().apply(values)

    def tile_of(self, extents):
        return self._back(self.inner.tile_of(self.permutation.apply(extents)))

    def halo_of(self, extents):
        low, high = self.inner.halo_of(self.permutation.apply(extents))
        return self._back(low), self._back(high)

    def shift_of(self, extents):
        return self._back(self.inner.shift_of(self.permutation.apply(extents)))
