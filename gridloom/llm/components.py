"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.llm.base import cut, drop


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges without loops, written out; their number and checksum, which the
    write itself observes."""
    seen = Observation()
    fine = edges.where(F.col("u") != F.col("v")).distinct()
    table = cut(fine.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return table, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, part_rows: int = 200_000) -> DataFrame:
    """(node, comp) of every node that isn't the least of its component; comp is that least node.

    edges: columns u and v of one orderable type; loops and repeats do no harm, and an empty
    table gives no rows. Neighbours are reduced by a grouped minimum and a join, so no task
    gathers a hub's edges. Each round's edges are written to the shared folder and read in
    parts of about part_rows; rounds go on until none changes an edge.
    """
    e, before = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while before[0]:
        parts = -(-before[0] // part_rows)
        d = _directed(e.coalesce(parts)).coalesce(parts)
        least = d.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = d.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after, mark = _written(small.coalesce(parts))
        drop(e)
        e = after
        if mark == before:
            break
        before = mark
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
