"""Arrays: lazy views over versions of a coordinate frame.

A stored array is a DataFrame with one row a cell: coordinates i0, i1, i2 and a value v.
Views keep the frame and say how their axes map to stored ones; slicing becomes a filter on
the stored coordinates (so it reaches the scan) and a shift of the result. Writes make a new
version: the handle then refers to another DataFrame, and views see it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DType, checked
from gridloom.functions.reductions import Reduction, reduction
from gridloom.plans.distribution import Distribution, axis
from gridloom.plans.geometry import MAX_RANK, Permutation, Rect
from gridloom.streaming.events import Event

if TYPE_CHECKING:
    from gridloom.operators.context import Context


@dataclass
class Stored:
    """The array behind views. constant: all cells hold this value (frame is their domain)."""

    context: Context
    name: str
    df: DataFrame
    kind: DType
    extents: tuple[int, ...]
    dist: Distribution
    order: str = "C"
    constant: object = None
    filled: bool = True
    version: int = 0
    dropped: bool = False

    def put(self, df: DataFrame, constant: object = None) -> None:
        if self.dropped:
            raise RuntimeError(f"{self.name} was released")
        self.df, self.constant, self.filled = df, constant, True
        self.version += 1


@dataclass(frozen=True)
class Source:
    """Where a stored axis comes from: a view axis and what is added to it, or a constant."""

    axis: int | None
    shift: int


def _range(key: slice | tuple[int, int], lo: int, hi: int) -> tuple[int, int]:
    if isinstance(key, slice):
        if key.step not in (None, 1):
            raise ValueError("views have no steps")
        a = lo if key.start is None else key.start
        b = hi if key.stop is None else key.stop
    else:
        a, b = key
    if not lo <= a <= b <= hi:
        raise IndexError(f"{a}..{b} isn't within {lo}..{hi}")
    return a, b


@dataclass(frozen=True)
class Array:
    """A view: domain (its coordinates) and the source of each stored axis."""

    stored: Stored
    domain: Rect
    sources: tuple[Source, ...]

    # -- facts -------------------------------------------------------------------------

    @property
    def context(self) -> Context:
        return self.stored.context

    @property
    def kind(self) -> DType:
        return self.stored.kind

    @property
    def rank(self) -> int:
        return self.domain.rank

    @property
    def extents(self) -> tuple[int, ...]:
        return self.domain.extents

    shape = extents

    @property
    def nrows(self) -> int:
        return self.extents[0] if self.rank else 1

    @property
    def ncols(self) -> int:
        return self.extents[1] if self.rank > 1 else 1

    @property
    def nlayers(self) -> int:
        return self.extents[2] if self.rank > 2 else 1

    @property
    def is_empty(self) -> bool:
        return self.domain.empty

    def __len__(self) -> int:
        return self.domain.volume

    @property
    def whole(self) -> bool:
        """Every stored cell, at its own coordinates."""
        plain = all(s == Source(k, 0) for k, s in enumerate(self.sources))
        return plain and self.rank == len(self.sources) and self.domain == Rect((0,) * self.rank, self.stored.extents)

    # -- frames ------------------------------------------------------------------------

    def _inside(self) -> Column | None:
        """The view's cells as a condition on stored coordinates."""
        out = None
        for k, s in enumerate(self.sources):
            c, n = F.col(axis(k)), self.stored.extents[k]
            if s.axis is None:
                parts = [c == s.shift] if n > 1 else []
            else:
                lo, hi = self.domain.lo[s.axis] + s.shift, self.domain.hi[s.axis] + s.shift
                parts = ([c >= lo] if lo > 0 else []) + ([c < hi] if hi < n else [])
            for p in parts:
                out = p if out is None else out & p
        return out

    def frame(self) -> DataFrame:
        """(i0.., v) in the view's coordinates."""
        keep = self._inside()
        df = self.stored.df if keep is None else self.stored.df.where(keep)
        cols = []
        for k in range(self.rank):
            at = next((j for j, s in enumerate(self.sources) if s.axis == k), None)
            if at is None:
                cols.append(F.lit(self.domain.lo[k]).cast("long").alias(axis(k)))
            else:
                shift = self.sources[at].shift
                cols.append((F.col(axis(at)) - shift if shift else F.col(axis(at))).alias(axis(k)))
        return df.select(*cols, "v")

    def _to_stored(self, df: DataFrame, *others: str) -> DataFrame:
        """Rows in view coordinates, in stored ones."""
        cols = [(F.lit(s.shift).cast("long") if s.axis is None else F.col(axis(s.axis)) + s.shift).alias(axis(k)) for k, s in enumerate(self.sources)]
        return df.select(*cols, *others)

    def _replace(self, **change: object) -> Array:
        return replace(self, **change)

    # -- views -------------------------------------------------------------------------

    def _axis(self, k: int) -> int:
        if not 0 <= k < self.rank:
            raise IndexError(f"no axis {k}")
        return k

    def restrict_axis(self, k: int, key: slice | tuple[int, int]) -> Array:
        """Fewer cells along an axis, coordinates unchanged."""
        a, b = _range(key, self.domain.lo[self._axis(k)], self.domain.hi[k])
        lo, hi = list(self.domain.lo), list(self.domain.hi)
        lo[k], hi[k] = a, b
        return self._replace(domain=Rect(tuple(lo), tuple(hi)))

    def slice_axis(self, k: int, key: slice | tuple[int, int]) -> Array:
        """Fewer cells along an axis, coordinates from 0."""
        part = self.restrict_axis(k, key)
        a = part.domain.lo[k]
        lo, hi = list(part.domain.lo), list(part.domain.hi)
        lo[k], hi[k] = 0, hi[k] - a
        return part._replace(domain=Rect(tuple(lo), tuple(hi)), sources=tuple(replace(s, shift=s.shift + a) if s.axis == k else s for s in part.sources))

    def collapse_axis(self, k: int, at: int) -> Array:
        """The cells at one coordinate of an axis, which goes."""
        if not self.domain.lo[self._axis(k)] <= at < self.domain.hi[k]:
            raise IndexError(f"{at} isn't on axis {k}")
        cut = lambda t: t[:k] + t[k + 1 :]
        sources = tuple(Source(None, at + s.shift) if s.axis == k else s if s.axis is None or s.axis < k else replace(s, axis=s.axis - 1) for s in self.sources)
        return self._replace(domain=Rect(cut(self.domain.lo), cut(self.domain.hi)), sources=sources)

    def _apply(self, key: object, keep: bool) -> Array:
        parts = key if isinstance(key, tuple) else (key,)
        if isinstance(key, Rect):
            parts = tuple(slice(a, b) for a, b in zip(key.lo, key.hi))
        if len(parts) > self.rank - sum(p is None for p in parts) + sum(p is None for p in parts) and None not in parts:
            raise IndexError(f"{len(parts)} indices for {self.rank} axes")
        out, at = self, self.rank
        real = [p for p in parts if p is not None]
        for k in range(len(real) - 1, -1, -1):
            p = real[k]
            out = out.collapse_axis(k, p) if isinstance(p, int) else out.restrict_axis(k, p) if keep else out.slice_axis(k, p)
        place = 0
        for p in parts:
            if p is None:
                out = out.insert_axis(place)
                place += 1
            elif not isinstance(p, int):
                place += 1
        return out

    def slice(self, *key: object) -> Array:
        """Indices and ranges, one an axis: ranges start again at 0, indices drop their axis,
        None puts in an axis of one cell."""
        return self._apply(key[0] if len(key) == 1 else key, False)

    def restrict(self, *key: object) -> Array:
        """As slice, but ranges keep their coordinates."""
        return self._apply(key[0] if len(key) == 1 else key, True)

    def __getitem__(self, key: object) -> Array:
        return self.slice(key)

    def row(self, i: int) -> Array:
        return self.collapse_axis(0, i)

    def column(self, j: int) -> Array:
        return self.collapse_axis(1, j)

    def layer(self, k: int) -> Array:
        return self.collapse_axis(2, k)

    def element(self, *at: int) -> Array:
        """One cell, as an array without axes."""
        at = tuple(at[0]) if len(at) == 1 and isinstance(at[0], tuple) else at
        if len(at) != self.rank or not self.domain.contains(at):
            raise IndexError(f"{at} isn't in the array")
        out = self
        for k in range(self.rank - 1, -1, -1):
            out = out.collapse_axis(k, at[k])
        return out

    def permute_axes(self, permutation: Permutation | tuple[int, ...]) -> Array:
        """Axis k becomes axis permutation.axes[k]."""
        p = permutation if isinstance(permutation, Permutation) else Permutation(tuple(permutation))
        if len(p.axes) != self.rank:
            raise ValueError("the permutation has another rank")
        return self._replace(domain=Rect(p.apply(self.domain.lo), p.apply(self.domain.hi)), sources=tuple(s if s.axis is None else replace(s, axis=p.axes[s.axis]) for s in self.sources))

    def swap_axes(self, a: int, b: int) -> Array:
        return self.permute_axes(Permutation.swap(self.rank, a, b))

    @property
    def T(self) -> Array:  # noqa: N802
        return self.swap_axes(0, 1)

    def insert_axis(self, k: int) -> Array:
        """A new axis of one cell before axis k."""
        if not 0 <= k <= self.rank or self.rank == MAX_RANK:
            raise IndexError(f"no place for axis {k}")
        put = lambda t, x: t[:k] + (x,) + t[k:]
        return self._replace(domain=Rect(put(self.domain.lo, 0), put(self.domain.hi, 1)), sources=tuple(replace(s, axis=s.axis + 1) if s.axis is not None and s.axis >= k else s for s in self.sources))

    def remove_axis(self, k: int) -> Array:
        return self.collapse_axis(k, self.domain.lo[self._axis(k)])

    # -- reading -----------------------------------------------------------------------

    def values(self) -> list:
        """All values in row-major order, on the driver."""
        df = self.frame()
        return [r["v"] for r in (df.orderBy(*[axis(k) for k in range(self.rank)]) if self.rank else df).collect()]

    def copy_to(self, out: list) -> None:
        """Into a list of the same length."""
        got = self.values()
        if len(out) != len(got):
            raise ValueError(f"{len(out)} places for {len(got)} values")
        out[:] = got

    def get(self, *at: int) -> object:
        """One value, by the view's coordinates."""
        r = self.element(*at).frame().first()
        return r["v"] if r else None

    def save(self, path: str) -> None:
        self.frame().write.parquet(path)

    # -- writing -----------------------------------------------------------------------

    def _merge(self, df: DataFrame, fold: Reduction | None = None) -> None:
        """Puts (i0.., v) in view coordinates over the old cells; others keep their value."""
        keys = [axis(k) for k in range(len(self.sources))]
        new = self._to_stored(df, F.col("v").cast(self.kind.spark).alias("_new"), F.lit(True).alias("_set"))
        old = self.stored.df
        joined = old.join(new, keys, "left") if keys else old.crossJoin(F.broadcast(new.limit(1)))
        value = F.col("_new") if fold is None else fold.fold(F.col("v"), F.col("_new"), self.kind)
        self.stored.put(joined.select(*keys, F.when(F.col("_set"), value).otherwise(F.col("v")).alias("v")))

    def fill(self, value: object) -> Event:
        """One value in all cells of the view."""
        value = checked(value, self.kind)
        lit, keep = F.lit(value).cast(self.kind.spark), self._inside()
        keys = [axis(k) for k in range(len(self.sources))]
        if keep is None:
            self.stored.put(self.stored.df.select(*keys, lit.alias("v")), value)
        else:
            self.stored.put(self.stored.df.select(*keys, F.when(keep, lit).otherwise(F.col("v")).alias("v")))
        self.context.trace.add("fill", name=str(value), writes=[self.stored.name])
        return Event.ready()

    def fill_zeros(self) -> Event:
        return self.fill(0)

    def fill_ones(self) -> Event:
        return self.fill(1)

    def set(self, at: int | tuple[int, ...], value: object) -> Event:
        return self.element(*(at if isinstance(at, tuple) else (at,))).fill(value)

    def copy_from(self, values: list) -> Event:
        """Values in row-major order, as many as there are cells."""
        if len(values) != len(self):
            raise ValueError(f"{len(values)} values for {len(self)} cells")
        self._merge(self.context._frame_of(values, self.domain, self.kind))
        self.context.trace.add("write", writes=[self.stored.name])
        return Event.ready()

    def assign_from(self, other: Array) -> Event:
        """The other array's values, cell by cell from the first; types and extents must agree."""
        if other.kind != self.kind:
            raise TypeError(f"{other.kind.name} can't go to {self.kind.name}")
        if other.extents != self.extents:
            raise ValueError(f"extents {other.extents} and {self.extents} differ")
        src = other.frame()
        if self.whole and other.domain.lo == self.domain.lo:
            self.stored.put(src)
        else:
            cols = [(F.col(axis(k)) + (self.domain.lo[k] - other.domain.lo[k])).alias(axis(k)) for k in range(self.rank)]
            self._merge(src.select(*cols, "v"))
        self.context.trace.add("assign", reads=[other.stored.name], writes=[self.stored.name])
        return Event.ready()

    def assign_to(self, other: Array) -> Event:
        return other.assign_from(self)

    def copy(self) -> Array:
        out = self.context.empty_like(self)
        out.assign_from(self.rebased())
        return out

    def rebased(self) -> Array:
        """The same cells with coordinates from 0."""
        out = self
        for k in range(self.rank):
            out = out.slice_axis(k, (out.domain.lo[k], out.domain.hi[k]))
        return out

    def fold(self, other: Array, op: str | Reduction) -> Event:
        """self = op(other, self), for the cells that both have."""
        if other.kind != self.kind:
            raise TypeError(f"{other.kind.name} can't be folded into {self.kind.name}")
        self._merge(other.frame(), reduction(op))
        self.context.trace.add("fold", reads=[other.stored.name], writes=[self.stored.name])
        return Event.ready()

    def accumulate(self, rows: DataFrame, op: str | Reduction) -> Event:
        """Folds rows (i0.., v), any number for a cell, into the cells they name."""
        op = reduction(op)
        keys = [axis(k) for k in range(self.rank)]
        self._merge(rows.groupBy(*keys).agg(op.aggregate(F.col("v"), self.kind).alias("v")), op)
        return Event.ready()

    def reduce_axis(self, k: int, op: str | Reduction, into: Array | None = None) -> Array:
        """Reduces along one axis; into: folds into an array of the other axes."""
        op = reduction(op)
        self._axis(k)
        rest = [j for j in range(self.rank) if j != k]
        keys = [F.col(axis(j)).alias(axis(n)) for n, j in enumerate(rest)]
        made = self.frame().groupBy(*keys).agg(op.aggregate(F.col("v"), self.kind).alias("v"))
        if into is None:
            out = self.rebased() if any(self.domain.lo) else self
            made = out.frame().groupBy(*keys).agg(op.aggregate(F.col("v"), self.kind).alias("v"))
            return self.context._new(made, self.kind, tuple(self.extents[j] for j in rest))
        into._merge(made, op)
        return into

    # -- life and placement ------------------------------------------------------------

    def synchronize(self) -> None:
        """Computes and keeps the current version."""
        self.stored.df = self.stored.df.persist()
        self.stored.df.count()

    def barrier(self) -> Event:
        return self.context.pool.submit(self.synchronize)

    def release(self) -> None:
        self.stored.df.unpersist()
        self.stored.dropped = True

    def checkpoint(self) -> None:
        """Writes the current version to the checkpoint folder and forgets how it was made."""
        self.stored.df = self.context.checkpoint(self.stored.df)

    def distributed(self, dist: Distribution, partitions: int | None = None) -> Array:
        """The same array, cut by another distribution."""
        if not self.whole:
            raise ValueError("only whole arrays have a distribution")
        s = self.stored
        return self.context._new(dist.place(s.df, s.extents, partitions), s.kind, s.extents, dist)

    def regions(self) -> DataFrame:
        """The chunks of the stored array and their boxes."""
        return self.stored.dist.regions(self.context.spark, self.stored.extents, self.context.places)

    def halo_chunks(self) -> DataFrame:
        """Cells by the chunks that store them: (chunk, owned, i0.., v)."""
        return self.stored.dist.with_halo(self.stored.df, self.stored.extents)

    def affinity(self, *at: int) -> int:
        """The place of the chunk that owns a cell."""
        stored = tuple(s.shift if s.axis is None else at[s.axis] + s.shift for s in self.sources)
        ext, dist = self.stored.extents, self.stored.dist
        number = 0
        for x, t, s, g in zip(stored, dist.tile_of(ext), dist.shift_of(ext), dist.grid(ext)):
            number = number * g + (x + s) // t
        return number % self.context.places
