"""The query catalogue: each array operator on the test tables, and the same rows in SQL.

Values are integers (hundredths, or ten-thousandths of embeddings), so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dtypes import INT64
from gridloom.functions.reductions import arg_max, arg_min
from gridloom.operators.array import Array
from gridloom.operators.context import Context
from gridloom.operators.kernel import KernelBuilder, Scatter
from gridloom.plans.distribution import Central, Permuted, Stencil, Tiles, column_blocks, column_cyclic, row_blocks, row_cyclic
from gridloom.plans.geometry import Permutation, Rect
from gridloom.sources.tables import cents, column_array, embedding_matrix, events_values, order_prices, reshaped, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that the SQL below names.
VIEWS = {
    "ev": "SELECT event_id AS i, CAST(ROUND(value*100) AS BIGINT) AS v FROM events",
    "od": "SELECT o_orderkey AS i, CAST(ROUND(o_totalprice*100) AS BIGINT) AS v FROM orders",
    "ev2": "SELECT i // 100 AS x, i % 100 AS y, v FROM ev",
    "od3": "SELECT i // 50 AS x, (i // 10) % 5 AS y, i % 10 AS z, v FROM od",
    "em": "SELECT vec_id AS i, UNNEST(RANGE(LEN(embedding))) AS k, CAST(ROUND(CAST(UNNEST(embedding) AS DOUBLE)*10000) AS BIGINT) AS v FROM embeddings",
}


def query(sql: str) -> Callable:
    def add(f: Callable[[Context, str], DataFrame | Array]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Context(spark), sf_dir)
            return out.frame() if isinstance(out, Array) else out

        run.__name__ = run.__qualname__ = f.__name__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + " " + sql
        return f

    return add


def ev(c: Context, d: str) -> Array:
    return events_values(c, d)


def od(c: Context, d: str) -> Array:
    return order_prices(c, d)


def ev2(c: Context, d: str) -> Array:
    return reshaped(ev(c, d), 100)


def od3(c: Context, d: str) -> Array:
    return reshaped(od(c, d), 5, 10)


def kernel(c: Context, rules: str, body: dict, *arrays: str, values: tuple[str, ...] = (), **lookups: str):
    """A kernel over arrays of 64-bit integers: parameters are the arrays, then the values."""
    b = KernelBuilder(body)
    for n in arrays:
        b.param_array(n, INT64)
    for n in values:
        b.param_value(n, INT64)
    for n, key in lookups.items():
        b.lookup(n, key)
    return b.annotate(rules).compile(c)


# -- sources and sinks -----------------------------------------------------------------


@query("SELECT i AS i0, v FROM ev")
def s1_array_from_column(c, d):
    return ev(c, d)


@query("SELECT i AS i0, v + (SELECT CAST(42 AS BIGINT)) AS v FROM ev")
def s2_scalar_broadcast(c, d):
    a, b = ev(c, d), c.empty(len(ev(c, d)), dtype="int64")
    kernel(c, "global i => read A[i], read S, write B[i]", {"B": "A + S"}, "A", "S", "B").launch(len(a), a, c.scalar(42), b)
    return b


@query("SELECT i AS i0, CAST(7 AS BIGINT) AS v FROM od")
def s4_full(c, d):
    return c.full(len(od(c, d)), 7)


@query("SELECT v FROM ev WHERE i = 17")
def s9_point_get(c, d):
    return ev(c, d).element(17)


@query("SELECT i AS i0, CASE WHEN i = 17 THEN CAST(-1 AS BIGINT) ELSE v END AS v FROM ev")
def s10_point_set(c, d):
    a = ev(c, d)
    a.set(17, -1)
    return a


# -- views -----------------------------------------------------------------------------


@query("SELECT i - 100 AS i0, v FROM ev WHERE i >= 100 AND i < 300")
def v1_slice_rebase(c, d):
    return ev(c, d)[100:300]


@query("SELECT i AS i0, v FROM ev WHERE i >= 100 AND i < 300")
def v2_restrict_keep(c, d):
    return ev(c, d).restrict_axis(0, (100, 300))


@query("SELECT x - 2 AS i0, y - 10 AS i1, v FROM ev2 WHERE x >= 2 AND x < 6 AND y >= 10 AND y < 40")
def v3_slice_nd(c, d):
    return ev2(c, d)[2:6, 10:40]


@query("SELECT x AS i0, y AS i1, v FROM ev2 WHERE x >= 2 AND x < 6 AND y >= 10 AND y < 40")
def v4_restrict_nd(c, d):
    return ev2(c, d).restrict(slice(2, 6), slice(10, 40))


@query("SELECT x AS i0, y AS i1, v FROM od3 WHERE z = 3")
def v5_collapse_layer(c, d):
    return od3(c, d).layer(3)


@query("SELECT y AS i0, v FROM ev2 WHERE x = 4")
def v6_row(c, d):
    return ev2(c, d).row(4)


@query("SELECT x AS i0, v FROM ev2 WHERE y = 7")
def v6_column(c, d):
    return ev2(c, d).column(7)


@query("SELECT v FROM ev2 WHERE x = 4 AND y = 7")
def v7_element(c, d):
    return ev2(c, d).element(4, 7)


@query("SELECT y AS i0, x AS i1, v FROM ev2")
def v8_transpose(c, d):
    return ev2(c, d).T


@query("SELECT z AS i0, x AS i1, y AS i2, v FROM od3")
def v9_permute_3d(c, d):
    return od3(c, d).permute_axes((1, 2, 0))


# -- whole arrays ----------------------------------------------------------------------


@query("SELECT x AS i0, y AS i1, CASE WHEN x < 3 AND y >= 50 THEN CAST(0 AS BIGINT) ELSE v END AS v FROM ev2")
def o1_fill_region(c, d):
    a = ev2(c, d)
    a[0:3, 50:100].fill(0)
    return a


@query("SELECT a.i AS i0, CASE WHEN a.i >= 500 AND a.i < 600 THEN b.v ELSE a.v END AS v FROM ev a LEFT JOIN ev b ON b.i = a.i - 400")
def o3_assign_region(c, d):
    a = ev(c, d)
    a[500:600].assign_from(a[100:200])
    return a


@query("SELECT a.i AS i0, CASE WHEN a.v > b.v THEN a.v ELSE b.v END AS v FROM ev a JOIN od b ON a.i = b.i")
def o5_fold_max(c, d):
    a, b = ev(c, d), od(c, d)
    n = min(len(a), len(b))
    out = a[0:n].copy()
    out.fold(b[0:n], "max")
    return out


@query("SELECT y AS i0, CAST(SUM(v) AS BIGINT) AS v FROM ev2 GROUP BY y")
def o6_reduce_axis0(c, d):
    return ev2(c, d).reduce_axis(0, "sum")


@query("SELECT x AS i0, MAX(v) AS v FROM ev2 GROUP BY x")
def o6_reduce_axis1(c, d):
    return ev2(c, d).reduce_axis(1, "max")


# -- kernels and joins -----------------------------------------------------------------


@query("SELECT a.i AS i0, 3 * a.v + b.v AS v FROM ev a JOIN od b ON a.i = b.i")
def k_axpy(c, d):
    a, b = ev(c, d), od(c, d)
    n = min(len(a), len(b))
    out = c.empty(n, dtype="int64")
    kernel(c, "global i => read A[i], read B[i], write C[i]", {"C": "alpha * A + B"}, "A", "B", "C", values=("alpha",)).launch(n, a, b, out, 3)
    return out


@query("SELECT i AS i0, CAST(FLOOR(SQRT(CAST(v AS DOUBLE))) AS BIGINT) AS v FROM ev")
def k_elementwise_sqrt(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i], write B[i]", {"B": lambda x: F.floor(F.sqrt(x["A"].cast("double")))}, "A", "B").launch(len(a), a, out)
    return out


@query("SELECT i AS i0, CASE WHEN v > 10000 THEN v - 10000 ELSE v END AS v FROM ev")
def k_readwrite_guard(c, d):
    a = ev(c, d)
    kernel(c, "global i => readwrite A[i]", {"A": "if(A > limit, A - limit, A)"}, "A", values=("limit",)).launch(len(a), a, 10000)
    return a


@query("SELECT a.i AS i0, b.v AS v FROM ev a JOIN ev b ON b.i = 2 * a.i")
def j2_affine_stride(c, d):
    a = ev(c, d)
    n = (len(a) + 1) // 2
    out = c.empty(n, dtype="int64")
    kernel(c, "global i => read A[2*i], write B[i]", {"B": "A"}, "A", "B").launch(n, a, out)
    return out


@query("SELECT m.m - b.i AS i0, b.v AS v FROM ev b CROSS JOIN (SELECT MAX(i) AS m FROM ev) m")
def j2_reverse(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[n-i-1], write B[i]", {"B": "A"}, "A", "B", values=("n",)).launch(len(a), a, out, len(a))
    return out


@query("SELECT a.i AS i0, b.v AS v FROM ev a JOIN ev b ON b.i = a.i // 16")
def j3_upsample(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i/16], write B[i]", {"B": "A"}, "A", "B").launch(len(a), a, out)
    return out


@query("SELECT a.i AS i0, b.i AS i1, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM em a JOIN em b ON a.k = b.k WHERE a.i < 50 AND b.i < 200 GROUP BY a.i, b.i")
def j5_gram(c, d):
    m = embedding_matrix(c, d)
    out = c.empty((50, 200), dtype="int64")
    kernel(c, "global [i, j] => read A[i,:], read B[j,:], write C[i,j]", {"C": "sum(A * B)"}, "A", "B", "C").launch((50, 200), m, m, out)
    return out


@query("SELECT a.i AS i0, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM em a JOIN em b ON a.k = b.k AND b.i = 0 GROUP BY a.i")
def j6_matvec(c, d):
    m = embedding_matrix(c, d)
    out = c.empty(m.nrows, dtype="int64")
    kernel(c, "global i => read A[i,:], read X[:], write Y[i]", {"Y": "sum(A * X)"}, "A", "X", "Y").launch(m.nrows, m, m.row(0), out)
    return out


@query("SELECT i AS i0, v - (SELECT MIN(v) FROM ev) AS v FROM ev")
def j7_subtract_global_min(c, d):
    a = ev(c, d)
    low, out = c.full((), INT64.bounds[1], dtype="int64"), c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i], reduce(min) S", {"S": "A"}, "A", "S").launch(len(a), a, low)
    kernel(c, "global i => read A[i], read S, write B[i]", {"B": "A - S"}, "A", "S", "B").launch(len(a), a, low, out)
    return out


@query("SELECT a.x AS i0, a.y AS i1, a.v + b.v AS v FROM ev2 a JOIN ev2 b ON a.x = b.y AND a.y = b.x")
def j8_add_transpose(c, d):
    a = ev2(c, d)
    n = min(a.extents)
    out = c.empty((n, n), dtype="int64")
    kernel(c, "global [i, j] => read A[i,j], read B[j,i], write C[i,j]", {"C": "A + B"}, "A", "B", "C").launch((n, n), a, a, out)
    return out


@query("SELECT o.o_orderkey AS i0, CAST(ROUND(c.c_acctbal * 100) AS BIGINT) AS v FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def j9_gather(c, d):
    orders = table(c, d, "orders")
    n = orders.count()
    index = column_array(c, orders, "o_orderkey", "o_custkey", n)
    balance = column_array(c, table(c, d, "customer").select("c_custkey", cents("c_acctbal").alias("v")), "c_custkey", "v")
    out = c.empty(n, dtype="int64")
    kernel(c, "global i => read K[i], read B[:], write C[i]", {"C": "B"}, "K", "B", "C", B="K").launch(n, index, balance, out)
    return out.frame().where("v is not null")


@query("SELECT a.i AS i0, a.v + b.v + c.v AS v FROM ev a JOIN ev b ON b.i = a.i + 3 JOIN ev c ON c.i = a.i + 10")
def j10_multi_read(c, d):
    a = ev(c, d)
    n = len(a) - 10
    out = c.empty(n, dtype="int64")
    kernel(c, "global i => read A[i], read A[i+3], read A[i+10], write B[i]", {"B": "A_0 + A_1 + A_2"}, "A", "B").launch(n, a, out)
    return out


# -- stencils --------------------------------------------------------------------------


def _stencil(c: Context, a: Array) -> Array:
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i-1:i+2], write B[i]", {"B": "sum(A)"}, "A", "B").launch(len(a), a, out)
    return out


@query("SELECT i AS i0, CAST(SUM(v) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM ev")
def w1_stencil_1d(c, d):
    return _stencil(c, ev(c, d))


@query("SELECT a.x AS i0, a.y AS i1, CAST(SUM(b.v) AS BIGINT) AS v FROM ev2 a JOIN (SELECT x, y, v FROM ev2 UNION ALL SELECT x + 1, y, v FROM ev2 UNION ALL SELECT x - 1, y, v FROM ev2 UNION ALL SELECT x, y + 1, v FROM ev2 UNION ALL SELECT x, y - 1, v FROM ev2) b ON a.x = b.x AND a.y = b.y GROUP BY a.x, a.y")
def w2_stencil_2d_5pt(c, d):
    a = ev2(c, d)
    out = c.zeros(a.extents, dtype="int64")
    # the cross of a five-point stencil: cells of the 3 x 3 run off both axes weigh nothing
    kernel(c, "global [i, j] => read A[i-1:i+2, j-1:j+2], write B[i,j]", {"B": lambda x: F.sum(F.when((x["_o0"] == 1) | (x["_o1"] == 1), x["A"]))}, "A", "B").launch(a.extents, a, out)
    return out


@query("SELECT a.x AS i0, a.y AS i1, a.z AS i2, CAST(SUM(b.v) AS BIGINT) AS v FROM od3 a JOIN (SELECT x, y, z, v FROM od3 UNION ALL SELECT x + 1, y, z, v FROM od3 UNION ALL SELECT x - 1, y, z, v FROM od3 UNION ALL SELECT x, y + 1, z, v FROM od3 UNION ALL SELECT x, y - 1, z, v FROM od3 UNION ALL SELECT x, y, z + 1, v FROM od3 UNION ALL SELECT x, y, z - 1, v FROM od3) b ON a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY a.x, a.y, a.z")
def w3_stencil_3d_7pt(c, d):
    a = od3(c, d)
    out = c.zeros(a.extents, dtype="int64")
    # one launch an axis: three cells along it; the middle counts once in all
    for k, n in enumerate("ijk"):
        own = "i,j,k"
        at = ",".join(f"{m}-1:{m}+2" if m == n else m for m in "ijk")
        body = {"B": "sum(A)"} if not k else {"B": lambda x: F.sum(F.when(x["_o0"] != 1, x["A"]))}
        step = c.zeros(a.extents, dtype="int64")
        kernel(c, f"global [{own}] => read A[{at}], write B[{own}]", body, "A", "B").launch(a.extents, a, step)
        out.fold(step, "sum")
    return out


@query("SELECT a.i AS i0, a.v - b.v AS v FROM ev a JOIN ev b ON b.i = a.i - 1")
def w4_backward_diff(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i], read A[i-1], write B[i]", {"B": "A_0 - A_1"}, "A", "B").launch(len(a), a, out)
    return out.restrict_axis(0, (1, len(a)))


@query("SELECT i // 128 AS i0, CAST(SUM(v) AS BIGINT) AS v FROM ev GROUP BY i // 128")
def w5_block_sum(c, d):
    a = ev(c, d)
    out = c.empty(-(-len(a) // 128), dtype="int64")
    kernel(c, "block b => read A[b*128:b*128+128], write B[b]", {"B": "sum(A)"}, "A", "B").launch(len(a), a, out, block=128)
    return out


@query("SELECT i // 2 AS i0, MAX(v) AS v FROM ev GROUP BY i // 2")
def w6_downsample_max(c, d):
    a = ev(c, d)
    n = -(-len(a) // 2)
    out = c.empty(n, dtype="int64")
    kernel(c, "global i => read A[2*i:2*i+2], write B[i]", {"B": "max(A)"}, "A", "B").launch(n, a, out)
    return out


@query("SELECT i AS i0, CAST(SUM(v) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM (SELECT i, CAST(SUM(v) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM ev) t")
def w7_iterated_stencil(c, d):
    return _stencil(c, _stencil(c, ev(c, d)))


# -- reductions ------------------------------------------------------------------------


def _grouped(c: Context, a: Array, rules: str, op: str, n: int, start: int, value: str = "A") -> Array:
    out = c.full(n, start, dtype="int64")
    kernel(c, f"global i => read A[i], reduce({op}) {rules}", {"B": value}, "A", "B").launch(len(a), a, out)
    return out


@query("SELECT CAST(SUM(v) AS BIGINT) AS v FROM ev")
def a1_sum_all(c, d):
    a, s = ev(c, d), c.zeros((), dtype="int64")
    kernel(c, "global i => read A[i], reduce(+) S", {"S": "A"}, "A", "S").launch(len(a), a, s)
    return s


@query("SELECT i // 8 AS i0, CAST(PRODUCT(v % 7 + 1) AS BIGINT) AS v FROM ev GROUP BY i // 8")
def a2_product_blocks(c, d):
    a = ev(c, d)
    return _grouped(c, a, "B[i/8]", "product", -(-len(a) // 8), 1, "A % 7 + 1")


@query("SELECT i // 16 AS i0, MIN(v) AS v FROM ev GROUP BY i // 16")
def a3_min_block(c, d):
    a = ev(c, d)
    return _grouped(c, a, "B[i/16]", "min", -(-len(a) // 16), INT64.bounds[1])


@query("SELECT i // 16 AS i0, MAX(v) AS v FROM ev GROUP BY i // 16")
def a4_max_block(c, d):
    a = ev(c, d)
    return _grouped(c, a, "B[i/16]", "max", -(-len(a) // 16), INT64.bounds[0])


@query("SELECT i // 4 AS i0, BIT_AND(v) AS v FROM ev GROUP BY i // 4")
def a5_bit_and_block(c, d):
    a = ev(c, d)
    return _grouped(c, a, "B[i/4]", "and", -(-len(a) // 4), -1)


@query("SELECT i // 4 AS i0, BIT_OR(v) AS v FROM ev GROUP BY i // 4")
def a6_bit_or_block(c, d):
    a = ev(c, d)
    return _grouped(c, a, "B[i/4]", "or", -(-len(a) // 4), 0)


@query("SELECT x AS i0, y AS key, v AS value FROM (SELECT x, y, v, ROW_NUMBER() OVER (PARTITION BY x ORDER BY v DESC, y ASC) AS rn FROM ev2) t WHERE rn = 1")
def a7_argmax_row(c, d):
    best = ev2(c, d).frame().groupBy("i0").agg(arg_max(F.col("i1"), F.col("v")).alias("best"))
    return best.select("i0", "best.key", "best.value")


@query("SELECT v // 5000 AS i0, COUNT(*) AS v FROM ev GROUP BY v // 5000")
def a8_atomic_histogram(c, d):
    a = ev(c, d)
    top = c.full((), INT64.bounds[0], dtype="int64")
    kernel(c, "global i => read A[i], reduce(max) S", {"S": "A"}, "A", "S").launch(len(a), a, top)
    h = c.zeros(top.get() // 5000 + 1, dtype="int64")
    kernel(c, "global i => read A[i], atomic(+) H[:]", {"H": Scatter(("A div 5000",), "1L")}, "A", "H").launch(len(a), a, h)
    return h.frame().where("v > 0")


@query("SELECT l_partkey AS i0, CAST(SUM(CAST(ROUND(l_quantity) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY l_partkey")
def a9_atomic_scatter_add(c, d):
    out = _quantities(c, d, 0)
    return out.frame().where("v > 0")


def _quantities(c: Context, d: str, start: int) -> Array:
    """Quantities of lineitem, which has no dense key, added up by part."""
    lines = table(c, d, "lineitem").select(F.col("l_partkey").alias("i0"), F.round("l_quantity").cast("long").alias("v"))
    out = c.full(table(c, d, "part").count(), start, dtype="int64")
    out.accumulate(lines, "sum")
    return out


@query("SELECT p.p_partkey AS i0, CAST(100 + COALESCE(SUM(CAST(ROUND(l.l_quantity) AS BIGINT)), 0) AS BIGINT) AS v FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey")
def a10_reduce_into_existing(c, d):
    return _quantities(c, d, 100)


@query("SELECT i AS i0, c AS key FROM (SELECT i, c, ROW_NUMBER() OVER (PARTITION BY i ORDER BY d ASC, c ASC) AS rn FROM (SELECT a.i AS i, b.i AS c, SUM((a.v - b.v) * (a.v - b.v)) AS d FROM em a JOIN em b ON a.k = b.k AND b.i < 8 GROUP BY a.i, b.i) s) t WHERE rn = 1")
def f1_nearest_centroid(c, d):
    m = embedding_matrix(c, d)
    dist = c.empty((m.nrows, 8), dtype="int64")
    kernel(c, "global [i, j] => read A[i,:], read C[j,:], write D[i,j]", {"D": "sum((A - C) * (A - C))"}, "A", "C", "D").launch((m.nrows, 8), m, m.restrict_axis(0, (0, 8)), dist)
    best = dist.frame().groupBy("i0").agg(arg_min(F.col("i1"), F.col("v")).alias("best"))
    return best.select("i0", "best.key")


# -- distributions ---------------------------------------------------------------------


@query("SELECT x // 16 AS t0, y // 32 AS t1, COUNT(*) AS cells, MIN(x) AS lo0, MAX(x) + 1 AS hi0, MIN(y) AS lo1, MAX(y) + 1 AS hi1 FROM ev2 GROUP BY x // 16, y // 32")
def p3_tile_volumes(c, d):
    a = ev2(c, d).distributed(Tiles((16, 32)))
    return a.regions().select("t0", "t1", ((F.col("hi0") - F.col("lo0")) * (F.col("hi1") - F.col("lo1"))).alias("cells"), "lo0", "hi0", "lo1", "hi1")


@query("SELECT c.c AS chunk, COUNT(*) AS cells, MIN(e.i) AS lo, MAX(e.i) + 1 AS hi FROM (SELECT DISTINCT i // 128 AS c FROM ev) c JOIN ev e ON e.i >= c.c * 128 - 2 AND e.i < (c.c + 1) * 128 + 2 GROUP BY c.c")
def p8_halo_chunks(c, d):
    a = ev(c, d)
    cells = Stencil((128,), (2,)).with_halo(a.frame(), a.extents)
    return cells.groupBy("chunk").agg(F.count(F.lit(1)).alias("cells"), F.min("i0").alias("lo"), (F.max("i0") + 1).alias("hi"))


# -- further forms ---------------------------------------------------------------------


@query("SELECT x AS i0, y AS i1, CAST(3 AS BIGINT) AS v FROM ev2")
def s5_full_like(c, d):
    return c.full_like(ev2(c, d), 3)


@query("SELECT i AS i0, CASE WHEN i < 5 THEN i * 11 ELSE v END AS v FROM ev")
def s7_bulk_write(c, d):
    a = ev(c, d)
    a[0:5].copy_from([0, 11, 22, 33, 44])
    return a


@query("SELECT CAST(0 AS BIGINT) AS i0, i AS i1, v FROM ev")
def v10_insert_axis(c, d):
    return ev(c, d).insert_axis(0)


@query("SELECT y - 5 AS i0, x AS i1, v FROM ev2 WHERE y >= 5 AND y < 15")
def o2_copy_of_view(c, d):
    return ev2(c, d).T[5:15].copy()


@query("SELECT a.i AS i0, COALESCE(b.v, -1) AS v FROM ev a LEFT JOIN ev b ON b.i = a.i - 1")
def k_missing_as_null(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i-1], write B[i]", {"B": "coalesce(A, -1)"}, "A", "B").launch(len(a), a, out, missing="null")
    return out


@query("SELECT 2 * i AS i0, v FROM ev UNION ALL SELECT 2 * i + 1 AS i0, -v AS v FROM ev")
def k_write_run(c, d):
    a = ev(c, d)
    out = c.zeros(2 * len(a), dtype="int64")
    kernel(c, "global i => read A[i], write B[2*i:2*i+2]", {"B": "array(A, -A)"}, "A", "B").launch(len(a), a, out)
    return out


@query("SELECT x AS i0, y AS i1, v FROM ev2")
def j2_two_variables(c, d):
    a = ev(c, d)
    shape = (-(-len(a) // 100), 100)
    out = c.empty(shape, dtype="int64")
    kernel(c, "global [i, j] => read A[100*i+j], write C[i,j]", {"C": "A"}, "A", "C").launch(shape, a, out)
    return out


@query("SELECT i AS i0, v + 1000000 * (i // 64) + (i % 64) AS v FROM ev")
def d1_block_and_local(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i, block b, local l => read A[i], write B[i]", {"B": "A + 1000000 * b + l"}, "A", "B").launch(len(a), a, out, block=64)
    return out


@query("SELECT x AS i0, CAST(SUM(v) AS BIGINT) AS v FROM ev2 WHERE y IN (3, 13, 23, 33, 43) GROUP BY x")
def d8_strided_run(c, d):
    a = ev2(c, d)
    out = c.empty(a.nrows, dtype="int64")
    kernel(c, "global i => read A[i, 3:44:10], write B[i]", {"B": "sum(A)"}, "A", "B").launch(a.nrows, a, out)
    return out


@query("SELECT i AS i0, CAST(SUM(v) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM ev")
def u1_numpy_blocks(c, d):
    """A numpy body over blocks of 1,000 threads and their halos."""
    import numpy as np

    a = ev(c, d)
    out = c.empty(len(a))

    def body(block, A):
        lo, hi, n = block.lo[0], block.hi[0], A.origin[0] + len(A.values)
        sums = np.concatenate([[0.0], np.cumsum(A.values)])
        at = np.arange(lo, hi)
        return sums[np.minimum(at + 2, n) - A.origin[0]] - sums[np.maximum(at - 1, A.origin[0]) - A.origin[0]]

    k = KernelBuilder(body).param_array("A", INT64).param_array("B", "float64").annotate("global i => read A[i-1:i+2], write B[i]").compile(c)
    k.launch(len(a), a, out, dist=Tiles((1000,)))
    return out.frame().select("i0", F.round("v").cast("long").alias("v"))


@query("SELECT i // n AS chunk, MIN(i) AS lo0, MAX(i) + 1 AS hi0 FROM ev, (SELECT (COUNT(*) + 3) // 4 AS n FROM ev) s GROUP BY i // n")
def p5_row_blocks(c, d):
    a = ev(c, d).distributed(row_blocks(4))
    return a.regions().select("chunk", "lo0", "hi0")


@query("SELECT c0 * 2 + c2 AS chunk, COUNT(*) AS cells FROM od3 JOIN (SELECT DISTINCT x // 40 AS c0, z // 5 AS c2 FROM od3) c ON x >= c0 * 40 - 2 AND x < c0 * 40 + 41 AND z >= c2 * 5 - 1 AND z < c2 * 5 + 6 GROUP BY c0, c2")
def p10_stencil_3d(c, d):
    a = od3(c, d)
    dist = Stencil((40, 5, 5), (2, 0, 1), (1, 0, 1))
    return dist.with_halo(a.frame(), a.extents).groupBy("chunk").agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT y // 25 AS t0, COUNT(*) AS cells FROM ev2 GROUP BY y // 25")
def p12_permuted(c, d):
    a = ev2(c, d)
    dist = Permuted(Permutation((1, 0)), Tiles((25,)))
    keyed = a.frame().withColumn("chunk", dist.number(a.extents))
    return keyed.groupBy(F.col("chunk").alias("t0")).agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT i AS i0, CAST(7 AS BIGINT) AS v FROM ev")
def s3_empty_filled(c, d):
    a = c.empty(len(ev(c, d)), dtype="int64")
    a.fill(7)
    return a


@query("SELECT x AS i0, y AS i1, CAST(5 AS BIGINT) AS v FROM ev2")
def s6_full_column_major(c, d):
    return c.full_f(ev2(c, d).extents, 5, dtype="int64")


@query("SELECT x AS i0, CAST(SUM(v) AS BIGINT) AS v FROM ev2 GROUP BY x")
def s8_bulk_read(c, d):
    sums = ev2(c, d).reduce_axis(1, "+").values()
    return c.spark.createDataFrame(list(enumerate(sums)), "i0 long, v long")


@query("SELECT i AS i0, v FROM ev")
def v11_remove_axis(c, d):
    return ev(c, d).insert_axis(0).remove_axis(0)


@query("SELECT i - 10 AS i0, v FROM ev WHERE i >= 10")
def v12_open_range(c, d):
    return ev(c, d)[10:]


@query("SELECT i AS i0, v + 1 AS v FROM ev")
def o7_synchronized(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i], write B[i]", {"B": "A + 1"}, "A", "B").launch(len(a), a, out)
    out.synchronize()
    c.synchronize()
    return out


@query("SELECT i // 4 AS i0, v FROM ev WHERE i % 4 = 0")
def k4_constants(c, d):
    a = ev(c, d)
    n = -(-len(a) // 4)
    out = c.empty(n, dtype="int64")
    k = KernelBuilder({"B": "A"}).param_array("A", INT64).param_array("B", INT64).define("N", 4).annotate("global i => read A[N*i], write B[i]").compile(c)
    k.launch(n, a, out)
    return out


@query("SELECT i AS i0, 2 * v AS v FROM ev")
def k5_debugging(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    k = KernelBuilder({"B": "2 * A"}).param_array("A", INT64).param_array("B", INT64).debugging().annotate("global i => read A[i], write B[i]").compile(c)
    k.launch(len(a), a, out)
    return out


@query("SELECT i AS i0, 3 * v + 4 AS v FROM ev")
def k8_launch_one(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i], write B[i]", {"B": "A * s + t"}, "A", "B", values=("s", "t")).launch_one(len(a), a, out, 3, 4)
    return out


@query("SELECT i AS i0, -v AS v FROM ev")
def k9_launch_like(c, d):
    a = ev(c, d).distributed(row_blocks(4))
    out = c.empty(len(a), dtype="int64")
    kernel(c, "global i => read A[i], write B[i]", {"B": "-A"}, "A", "B").launch_like(a, a, out)
    return out


@query("SELECT i AS i0, v + 5 AS v FROM ev")
def k10_superblocks(c, d):
    a = ev(c, d)
    out = c.empty(len(a), dtype="int64")
    half = len(a) // 128 * 64
    boxes = [(0, Rect((0,), (half,))), (1, Rect((half,), (len(a),)))]
    kernel(c, "global i => read A[i], write B[i]", {"B": "A + 5"}, "A", "B").launch_distribution(len(a), boxes, a, out, block=64)
    return out


@query("SELECT CAST(0 AS BIGINT) AS chunk, MIN(i) AS lo0, MAX(i) + 1 AS hi0 FROM ev")
def p1_central(c, d):
    return ev(c, d).distributed(Central()).regions().select("chunk", "lo0", "hi0")


@query("SELECT x // 16 AS chunk, MIN(x) AS lo0, MAX(x) + 1 AS hi0 FROM ev2 GROUP BY x // 16")
def p4_row_cyclic(c, d):
    return ev2(c, d).distributed(row_cyclic(16)).regions().select("chunk", "lo0", "hi0")


@query("SELECT y // 30 AS chunk, MIN(y) AS lo1, MAX(y) + 1 AS hi1 FROM ev2 GROUP BY y // 30")
def p6_column_cyclic(c, d):
    return ev2(c, d).distributed(column_cyclic(30)).regions().select("chunk", "lo1", "hi1")


@query("SELECT y // 34 AS chunk, MIN(y) AS lo1, MAX(y) + 1 AS hi1 FROM ev2 GROUP BY y // 34")
def p7_column_blocks(c, d):
    return ev2(c, d).distributed(column_blocks(3)).regions().select("chunk", "lo1", "hi1")


@query("SELECT c0 * 4 + c1 AS chunk, COUNT(*) AS cells FROM ev2 JOIN (SELECT DISTINCT x // 20 AS c0, y // 25 AS c1 FROM ev2) c ON x >= c0 * 20 - 1 AND x < c0 * 20 + 21 AND y >= c1 * 25 - 2 AND y < c1 * 25 + 27 GROUP BY c0, c1")
def p9_stencil_2d(c, d):
    a = ev2(c, d)
    return Stencil((20, 25), (1, 2)).with_halo(a.frame(), a.extents).groupBy("chunk").agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT x // 16 * 4 + y // 32 AS chunk, (x // 16 * 4 + y // 32) % 4 AS place FROM ev2 GROUP BY x // 16, y // 32")
def p14_affinity(c, d):
    a = ev2(c, d).distributed(Tiles((16, 32)))
    c.places = 4
    corners = a.regions().select("chunk", "lo0", "lo1").collect()  # a row a chunk
    return c.spark.createDataFrame([(r["chunk"], a.affinity(r["lo0"], r["lo1"])) for r in corners], "chunk long, place long")


def t4_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan trace of a launch, as rows."""
    c = Context(spark)
    a = ev(c, sf_dir)
    _stencil(c, a)
    return spark.createDataFrame([(e["id"], e["kind"], str(e.get("name", ""))) for e in c.trace.events], "id long, kind string, name string")


def k17_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read back by actions that run beside the caller."""
    c = Context(spark)
    a = ev(c, sf_dir)
    reads = [c.pool.submit(lambda k=k: a.get(k)) for k in range(4)]
    c.synchronize()
    return spark.createDataFrame([(k, e.wait()) for k, e in enumerate(reads)], "i0 long, v long")


QUERIES |= {"t4_trace": t4_trace, "k17_events": k17_events}
