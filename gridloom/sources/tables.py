"""Arrays over Parquet tables whose keys are dense integers from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.array import Array
from gridloom.operators.context import Context
from gridloom.plans.distribution import Distribution


def table(context: Context, sf_dir: str, name: str) -> DataFrame:
    return context.spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_array(context: Context, df: DataFrame, key: str, value: str, rows: int | None = None, dist: Distribution | None = None, dtype: str = "int64") -> Array:
    """A column, by a dense key. rows: the number of rows, counted if it isn't given (Parquet
    answers from its footers)."""
    return context.from_frame(df, df.count() if rows is None else rows, [key], value, dtype, dist)


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def events_values(context: Context, sf_dir: str, dist: Distribution | None = None) -> Array:
    """events.value in hundredths, by event_id."""
    df = table(context, sf_dir, "events")
    return column_array(context, df.select("event_id", cents("value").alias("v")), "event_id", "v", df.count(), dist)


def order_prices(context: Context, sf_dir: str) -> Array:
    """orders.o_totalprice in hundredths, by o_orderkey."""
    df = table(context, sf_dir, "orders")
    return column_array(context, df.select("o_orderkey", cents("o_totalprice").alias("v")), "o_orderkey", "v", df.count())


def reshaped(array: Array, *inner: int, dist: Distribution | None = None) -> Array:
    """A vector as a matrix or cube in row-major order; inner: the extents of its later axes.
    Cells that don't fill a row of the first axis are left out of the domain."""
    ctx, n = array.context, len(array)
    size = 1
    for d in inner:
        size *= d
    df, rest, cols = array.frame(), size, []
    cols.append(F.floor(F.col("i0") / size).cast("long").alias("_k0"))
    for k, d in enumerate(inner, 1):
        rest //= d
        cols.append(F.pmod(F.floor(F.col("i0") / rest), F.lit(d)).cast("long").alias(f"_k{k}"))
    keys = [f"_k{k}" for k in range(len(inner) + 1)]
    return ctx.from_frame(df.select(*cols, "v"), (n // size, *inner), keys, "v", array.kind, dist)


def embedding_matrix(context: Context, sf_dir: str) -> Array:
    """embeddings in ten-thousandths, rows by vec_id."""
    df = table(context, sf_dir, "embeddings")
    cells = df.select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", "k", F.round(F.col("x").cast("double") * 10000).cast("long").alias("v"))
    width = df.select(F.size("embedding").alias("n")).first()["n"]
    return context.from_frame(cells, (df.count(), width), ["vec_id", "k"], "v")
