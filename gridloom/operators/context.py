"""Where arrays are made."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.dtypes import DType, checked, dtype_of, value_type
from gridloom.operators.array import Array, Source, Stored
from gridloom.plans.distribution import Central, Distribution, Replicated, axis
from gridloom.plans.geometry import Rect, extents_of
from gridloom.plans.trace import Trace
from gridloom.streaming.events import Pool


class Context:
    """A SparkSession, the plan trace, and threads for actions that run beside the caller."""

    def __init__(self, spark: SparkSession, places: int | None = None):
        self.spark = spark
        self.places = places or max(1, spark.sparkContext.defaultParallelism)
        self.trace = Trace()
        self.pool = Pool()
        self._names = itertools.count()

    def synchronize(self) -> None:
        """Waits for all submitted work."""
        self.pool.synchronize()

    def checkpoint(self, df: DataFrame) -> DataFrame:
        """Cuts lineage at files that all executors see."""
        sc = self.spark.sparkContext
        if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
        return df.checkpoint()

    # -- construction ------------------------------------------------------------------

    def _new(self, df: DataFrame, kind: DType, extents: tuple[int, ...], dist: Distribution | None = None, order: str = "C", **facts: object) -> Array:
        name = f"a{next(self._names)}"
        stored = Stored(self, name, df, kind, extents, dist or Central(), order, **facts)
        self.trace.add("array", name=name, writes=[name], extents=list(extents), dtype=kind.name)
        return Array(stored, Rect((0,) * len(extents), extents), tuple(Source(k, 0) for k in range(len(extents))))

    def cells(self, box: Rect) -> DataFrame:
        """(i0..): all coordinates of a box, made where they are used."""
        df = self.spark.range(box.volume)
        rest, cols = box.volume, []
        for k, n in enumerate(box.extents):
            rest //= max(1, n)
            at = F.col("id") if k == 0 and rest == 1 else F.pmod(F.floor(F.col("id") / max(1, rest)), F.lit(max(1, n)))
            cols.append((at.cast("long") + box.lo[k]).alias(axis(k)))
        return df.select(*cols) if cols else df.select()

    def _frame_of(self, values: list, box: Rect, kind: DType) -> DataFrame:
        kinds = T.StructType([T.StructField(axis(k), T.LongType(), False) for k in range(box.rank)] + [T.StructField("v", kind.spark, True)])
        rows = [(*at, v if kind.fields or kind.lanes > 1 else checked(v, kind)) for at, v in zip(box, values)]
        return self.spark.createDataFrame(rows, kinds)

    def array(self, values: list, dist: Distribution | None = None, dtype: DType | str | None = None) -> Array:
        """From values on the driver: a flat list, or nested lists of two or three levels."""
        ext, flat = [], list(values)
        level: list = flat
        while level and isinstance(level[0], (list, tuple)) and (dtype is None or dtype_of(dtype).lanes == 1):
            ext.append(len(level[0]))
            if any(len(x) != len(level[0]) for x in level):
                raise ValueError("rows differ in length")
            level = [y for x in level for y in x]
        extents = extents_of((len(flat), *ext))
        kind = dtype_of(dtype) if dtype is not None else value_type(level[0]) if level else dtype_of("int64")
        if dtype is None and any(isinstance(v, float) for v in level):
            kind, level = dtype_of("float64"), [float(v) for v in level]
        return self._new(self._frame_of(level, Rect((0,) * len(extents), extents), kind), kind, extents, dist)

    def from_pandas(self, values: pd.Series, dist: Distribution | None = None) -> Array:
        return self.array(values.tolist(), dist)

    def from_frame(self, df: DataFrame, extents: object, keys: list[str], value: str, dtype: DType | str = "int64", dist: Distribution | None = None) -> Array:
        """From a DataFrame with one row a cell; keys are its dense coordinates from 0."""
        ext = extents_of(extents)
        kind = dtype_of(dtype)
        cols = [F.col(c).cast("long").alias(axis(k)) for k, c in enumerate(keys)]
        if len(cols) != len(ext):
            raise ValueError("a key column for each axis")
        return self._new(df.select(*cols, F.col(value).cast(kind.spark).alias("v")), kind, ext, dist)

    def scalar(self, value: object, dtype: DType | str | None = None) -> Array:
        """An array without axes, at hand everywhere."""
        kind = dtype_of(dtype) if dtype is not None else value_type(value)
        return self._new(self.spark.range(1).select(F.lit(checked(value, kind)).cast(kind.spark).alias("v")), kind, (), Replicated(), constant=checked(value, kind))

    def empty(self, shape: object, dist: Distribution | None = None, dtype: DType | str = "float64", order: str = "C") -> Array:
        """Cells without values yet (null)."""
        ext, kind = extents_of(shape), dtype_of(dtype)
        df = self.cells(Rect((0,) * len(ext), ext)).withColumn("v", F.lit(None).cast(kind.spark))
        return self._new(df, kind, ext, dist, order, filled=False)

    def full(self, shape: object, value: object, dist: Distribution | None = None, dtype: DType | str | None = None, order: str = "C") -> Array:
        ext = extents_of(shape)
        kind = dtype_of(dtype) if dtype is not None else value_type(value)
        value = checked(value, kind)
        df = self.cells(Rect((0,) * len(ext), ext)).withColumn("v", F.lit(value).cast(kind.spark))
        return self._new(df, kind, ext, dist, order, constant=value)

    def zeros(self, shape: object, dist: Distribution | None = None, dtype: DType | str = "float64") -> Array:
        return self.full(shape, 0, dist, dtype)

    def ones(self, shape: object, dist: Distribution | None = None, dtype: DType | str = "float64") -> Array:
        return self.full(shape, 1, dist, dtype)

    # column-major variants: the order is a note, results are the same
    def empty_f(self, shape: object, dist: Distribution | None = None, dtype: DType | str = "float64") -> Array:
        return self.empty(shape, dist, dtype, "F")

    def full_f(self, shape: object, value: object, dist: Distribution | None = None, dtype: DType | str | None = None) -> Array:
        return self.full(shape, value, dist, dtype, "F")

    def zeros_f(self, shape: object, dist: Distribution | None = None, dtype: DType | str = "float64") -> Array:
        return self.full(shape, 0, dist, dtype, "F")

    def ones_f(self, shape: object, dist: Distribution | None = None, dtype: DType | str = "float64") -> Array:
        return self.full(shape, 1, dist, dtype, "F")

    def empty_like(self, other: Array, dtype: DType | str | None = None) -> Array:
        return self.empty(other.extents, other.stored.dist, dtype or other.kind, other.stored.order)

    def full_like(self, other: Array, value: object, dtype: DType | str | None = None) -> Array:
        return self.full(other.extents, value, other.stored.dist, dtype or other.kind, other.stored.order)

    def zeros_like(self, other: Array, dtype: DType | str | None = None) -> Array:
        return self.full_like(other, 0, dtype)

    def ones_like(self, other: Array, dtype: DType | str | None = None) -> Array:
        return self.full_like(other, 1, dtype)
