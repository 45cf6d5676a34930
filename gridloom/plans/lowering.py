"""From access patterns to joins.

Each read rule becomes a relation: the array's cells, keyed by the thread variables that read
them (the index expression is inverted on the stored coordinates, so bounds reach the scan)
and, where a rule reads a run of cells, by the place in the run. Relations of one launch are
joined on the variables and places they share; a launch over `A[i, :], B[:, j]` so is an
equi-join, a stencil a scatter of cells to the threads around them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.array import Array
from gridloom.plans.annotations import Access, Form
from gridloom.plans.distribution import axis

Ranges = dict[str, tuple[int, int]]


def var(name: str) -> str:
    return f"_t_{name}"


def place(k: int) -> str:
    return f"_o{k}"


def floor_div(x: Column, d: int) -> Column:
    """Floor division that stays within integers."""
    return x if d == 1 else ((x - F.pmod(x, F.lit(d))) / d).cast("long")


def form_column(form: Form, names: dict[str, Column]) -> Column:
    out = F.lit(form.const).cast("long")
    for k, f in form.factors:
        out = out + names[k] * f
    return floor_div(out, form.divisor)


@dataclass
class Relation:
    """keys: variables and places; value: the column of what was read."""

    df: DataFrame
    keys: list[str]
    value: str | None
    total: bool = False
    single: bool = False


def _bind(df: DataFrame, bound: dict[str, str], name: str, t: Column) -> DataFrame:
    """Takes t as the variable's value; a second index on it becomes a condition."""
    if name in bound:
        return df.where(F.col(bound[name]) == t)
    bound[name] = var(name)
    return df.withColumn(var(name), t)


def _cell(df: DataFrame, x: str, form: Form, ranges: Ranges, bound: dict[str, str], lo: int, hi: int) -> DataFrame:
    """Keys the rows whose column x is the form's value."""
    c = F.col(x)
    if form.constant:
        return df.where(c == form.value({}))
    if len(form.factors) == 1:
        name, a = form.factors[0]
        first, end = ranges[name]
        if form.divisor == 1:
            ends = sorted((a * first + form.const, a * (end - 1) + form.const))
            if ends[0] > lo:
                df = df.where(c >= ends[0])
            if ends[1] < hi - 1:
                df = df.where(c <= ends[1])
            if abs(a) > 1:
                df = df.where(F.pmod(c - form.const, F.lit(abs(a))) == 0)
            t = c - form.const if form.const else c
            return _bind(df, bound, name, t if a == 1 else -t if a == -1 else (t / a).cast("long"))
        if a > 0:
            up = lambda y: floor_div(y + (a - 1), a)
            low = F.greatest(up(c * form.divisor - form.const), F.lit(first).cast("long"))
            high = F.least(up((c + 1) * form.divisor - form.const) - 1, F.lit(end - 1).cast("long"))
            df = df.withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high"))
            df = df.withColumn("_t", F.explode(F.sequence("_low", "_high")))
            df = _bind(df, bound, name, F.col("_t"))
            return df.drop("_low", "_high", "_t")
    # several variables: their ranges, keyed by the value
    spark = df.sparkSession
    names = form.variables
    space = None
    for n in names:
        first, end = ranges[n]
        r = spark.range(first, end).withColumnRenamed("id", f"_n_{n}")
        space = r if space is None else space.crossJoin(r)
    space = space.withColumn("_x", form_column(form, {n: F.col(f"_n_{n}") for n in names}))
    df = df.join(space, df[x] == space["_x"]).drop("_x")
    for n in names:
        df = _bind(df, bound, n, F.col(f"_n_{n}")).drop(f"_n_{n}")
    return df


def relation(array: Array, parts: tuple[Access, ...], value: str, ranges: Ranges) -> Relation:
    """The cells that threads read, by variables and places."""
    df = array.frame().withColumnRenamed("v", value)
    bound: dict[str, str] = {}
    places, total = [], True
    for k, p in enumerate(parts):
        lo, hi = array.domain.lo[k], array.domain.hi[k]
        x = f"_x{k}"
        df = df.withColumnRenamed(axis(k), x)
        if not p.run:
            a, b = p.at.bounds(ranges) if p.at.factors else (p.at.value({}),) * 2
            total &= lo <= a and b < hi
            df = _cell(df, x, p.at, ranges, bound, lo, hi)
        else:
            o = place(len(places))
            places.append(o)
            if p.at is None or p.at.constant:
                start = lo if p.at is None else p.at.value({})
                at = F.col(x) - start
                df = df.where(F.col(x) >= start) if start > lo else df
                if p.step > 1:
                    df = df.where(F.pmod(at, F.lit(p.step)) == 0)
                df = df.withColumn(o, floor_div(at, p.step))
                if p.length is not None and start + (p.length - 1) * p.step < hi - 1:
                    df = df.where(F.col(o) < p.length)
                total &= max(start, lo) < hi
            else:
                a, b = p.at.bounds(ranges)
                total &= a <= hi - 1 and b + (p.length - 1) * p.step >= lo and a + (p.length - 1) * p.step >= lo and b <= hi - 1
                one = len(p.at.factors) == 1 and p.at.divisor == 1 and p.at.factors[0][1] > 1
                step = p.at.factors[0][1] if one else 0
                if one and p.step == 1 and p.length <= step:
                    # runs don't overlap: a cell lies in one at most
                    df = df.withColumn(o, F.pmod(F.col(x) - p.at.const, F.lit(step)))
                    if p.length < step:
                        df = df.where(F.col(o) < p.length)
                    low = p.at.const + step * ranges[p.at.factors[0][0]][0]
                    high = p.at.const + step * (ranges[p.at.factors[0][0]][1] - 1) + p.length
                    df = df.where(F.col(x) >= low) if low > lo else df
                    df = df.where(F.col(x) < high) if high < hi else df
                    df = _bind(df, bound, p.at.factors[0][0], floor_div(F.col(x) - p.at.const, step))
                else:
                    # the cell is in the runs that begin up to a run's length before it
                    df = df.withColumn(o, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.length - 1).cast("long")))).withColumn("_y", F.col(x) - F.col(o) * p.step)
                    df = _cell(df, "_y", p.at, ranges, bound, lo - (p.length - 1) * p.step, hi).drop("_y")
                    name = p.at.factors[0][0]
                    if len(p.at.factors) == 1:
                        first, end = ranges[name]
                        df = df.where((F.col(var(name)) >= first) & (F.col(var(name)) < end))
        df = df.drop(x)
    keys = [*bound.values(), *places]
    return Relation(df.select(*keys, value), keys, value, total, not keys)


def join_all(relations: list[Relation], left: bool = False) -> Relation:
    """Natural join; left: rows of the first relation stay where others have none."""
    rest = list(relations)
    if left:
        out = rest.pop(0)
    else:
        rest.sort(key=lambda r: -len(r.keys))
        out = rest.pop(0)
    df, keys, total = out.df, list(out.keys), out.total
    while rest:
        rest.sort(key=lambda r: (not set(r.keys) & set(keys), r.single, -len(set(r.keys) & set(keys))))
        r = rest.pop(0)
        shared = [k for k in r.keys if k in keys]
        if shared:
            df = df.join(r.df, shared, "left" if left else "inner")
        elif r.single:
            df = df.crossJoin(F.broadcast(r.df))  # one row
        else:
            df = df.crossJoin(r.df)  # an outer product is what was asked for
        keys += [k for k in r.keys if k not in keys]
        total &= r.total
    return Relation(df, keys, None, total)
