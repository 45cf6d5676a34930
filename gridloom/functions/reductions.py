"""The six reductions: their identities, aggregates and pairwise folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DType


@dataclass(frozen=True)
class Reduction:
    name: str

    def supports(self, kind: DType) -> bool:
        if kind.fields or kind.lanes != 1:
            return False
        return kind.integer or self.name not in ("and", "or")

    def identity(self, kind: DType) -> int | float:
        """The value that changes nothing: of `and` all ones, of `or` zero."""
        if not self.supports(kind):
            raise TypeError(f"{self.name} isn't defined for {kind.name}")
        if self.name in ("sum", "or"):
            return 0 if kind.integer else 0.0
        if self.name == "product":
            return 1 if kind.integer else 1.0
        if self.name == "and":
            return -1 if kind.bounds[0] < 0 else kind.bounds[1]
        if kind.floating:
            return float("inf") if self.name == "min" else float("-inf")
        return kind.bounds[1] if self.name == "min" else kind.bounds[0]

    def aggregate(self, value: Column, kind: DType) -> Column:
        """Over a group, in the element type; sums that leave it fail."""
        if not self.supports(kind):
            raise TypeError(f"{self.name} isn't defined for {kind.name}")
        if self.name == "product":
            if kind.integer:  # exact, by repeated multiplication in the element type
                return F.aggregate(F.collect_list(value.cast(kind.spark)), F.lit(1).cast(kind.spark), lambda a, x: (a * x).cast(kind.spark))
            return F.product(value).cast(kind.spark)
        made = {"sum": F.sum, "min": F.min, "max": F.max, "and": F.bit_and, "or": F.bit_or}[self.name](value)
        return made.cast(kind.spark)

    def fold(self, old: Column, new: Column, kind: DType) -> Column:
        """Two values in one; null is a cell without a value."""
        if self.name in ("min", "max"):
            both = F.least(old, new) if self.name == "min" else F.greatest(old, new)
            return both.cast(kind.spark)
        both = {"sum": lambda: old + new, "product": lambda: old * new, "and": lambda: old.bitwiseAND(new), "or": lambda: old.bitwiseOR(new)}[self.name]()
        return F.coalesce(both.cast(kind.spark), old, new)


REDUCTIONS = {n: Reduction(n) for n in ("sum", "product", "min", "max", "and", "or")}
#: How reductions are written in annotations.
SYMBOLS = {"+": "sum", "sum": "sum", "*": "product", "product": "product", "min": "min", "max": "max", "&": "and", "and": "and", "|": "or", "or": "or"}


def reduction(name: str | Reduction) -> Reduction:
    if isinstance(name, Reduction):
        return name
    if name not in SYMBOLS:
        raise ValueError(f"unknown reduction {name!r}")
    return REDUCTIONS[SYMBOLS[name]]


def arg_min(key: Column, value: Column) -> Column:
    """Struct (key, value) of the least value; ties go to the least key."""
    best = F.min(F.struct(value.alias("value"), key.alias("key")))
    return F.struct(best["key"].alias("key"), best["value"].alias("value"))


def arg_max(key: Column, value: Column) -> Column:
    """Struct (key, value) of the largest value; ties go to the least key."""
    best = F.max(F.struct(value.alias("value"), (-key).alias("key")))
    return F.struct((-best["key"]).alias("key"), best["value"].alias("value"))
