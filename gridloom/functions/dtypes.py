"""Element types and the casts that values may undergo."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T


class CastError(TypeError):
    """A value that the wanted type can't hold, or a cast that isn't allowed."""


@dataclass(frozen=True)
class DType:
    """name: int8..uint64, float32, float64; lanes: 1, or 2 to 4 for vector cells;
    fields: of a struct type, by name."""

    name: str
    lanes: int = 1
    fields: tuple[tuple[str, DType], ...] = ()

    @property
    def integer(self) -> bool:
        return self.name.lstrip("u").startswith("int")

    @property
    def floating(self) -> bool:
        return self.name.startswith("float")

    @property
    def bits(self) -> int:
        return int(self.name.lstrip("uintfloa"))

    @property
    def bounds(self) -> tuple[int, int]:
        if not self.integer:
            raise TypeError(f"{self.name} has no integer bounds")
        if self.name[0] == "u":
            return 0, (1 << self.bits) - 1
        return -(1 << self.bits - 1), (1 << self.bits - 1) - 1

    @property
    def spark(self) -> T.DataType:
        """Unsigned types take the next wider signed one; uint64 a decimal."""
        if self.fields:
            return T.StructType([T.StructField(n, t.spark, False) for n, t in self.fields])
        if self.integer:
            size = self.bits * (2 if self.name[0] == "u" else 1)
            one = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType(), 128: T.DecimalType(20, 0)}[size]
        else:
            one = T.FloatType() if self.bits == 32 else T.DoubleType()
        return one if self.lanes == 1 else T.ArrayType(one, False)

    def vector(self, lanes: int) -> DType:
        if lanes not in (2, 3, 4) or self.lanes != 1 or self.fields:
            raise ValueError("vectors have 2, 3 or 4 plain lanes")
        return DType(self.name, lanes)


SCALARS = {n: DType(n) for n in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")}
INT32, INT64, FLOAT32, FLOAT64 = SCALARS["int32"], SCALARS["int64"], SCALARS["float32"], SCALARS["float64"]


def key_value(value: DType = INT64, key: DType = INT64) -> DType:
    """A pair that is ordered by its value alone."""
    return DType("key_value", 1, (("key", key), ("value", value)))


def struct(**fields: DType) -> DType:
    return DType("struct", 1, tuple(fields.items()))


def dtype_of(kind: DType | str | type) -> DType:
    if isinstance(kind, DType):
        return kind
    if kind in (int, float):
        return INT64 if kind is int else FLOAT64
    if kind in SCALARS:
        return SCALARS[kind]
    raise ValueError(f"unknown element type {kind!r}")


#: Integers that each floating type may be made from.
_EXACT = {"float32": {"int8", "uint8", "int16", "uint16"}, "float64": {"int8", "uint8", "int16", "uint16", "int32", "uint32"}}


def cast_value(value: object, source: DType, target: DType) -> object:
    """value of type source as target; only casts that keep every value are allowed."""
    if source == target:
        return value
    if source.fields or target.fields or source.lanes != target.lanes:
        raise CastError(f"{source.name} can't become {target.name}")
    if source.integer and target.integer:
        lo, hi = target.bounds
        if not lo <= value <= hi:
            raise CastError(f"{value} doesn't fit {target.name}")
        return value
    if target.floating and (source.name in _EXACT[target.name] or (source.name, target.name) == ("float32", "float64")):
        return float(value)
    raise CastError(f"{source.name} can't become {target.name}")


def value_type(value: object) -> DType:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise CastError(f"{value!r} is no number")
    return INT64 if isinstance(value, int) else FLOAT64


def checked(value: object, target: DType) -> object:
    """A Python number as a value of target: integers must fit, and floats only become floats."""
    if target.integer:
        if isinstance(value, bool) or not isinstance(value, int):
            raise CastError(f"{value!r} is no integer")
        return cast_value(value, INT64, target) if target != INT64 else cast_value(value, DType("uint64"), target) if value >= 0 else value
    if target.floating:
        f = float(value)
        if target.bits == 32 and math.isfinite(f) and abs(f) > 3.4028235677973366e38:
            raise CastError(f"{value} doesn't fit float32")
        return f
    return value
