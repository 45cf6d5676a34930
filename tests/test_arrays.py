import numpy as np
import pytest

from gridloom.functions.dtypes import FLOAT32, FLOAT64, INT32, INT64, SCALARS, CastError, cast_value, checked, dtype_of, key_value
from gridloom.functions.reductions import REDUCTIONS, reduction
from gridloom.operators.kernel import KernelBuilder, KernelError, Scatter
from gridloom.plans.distribution import Stencil, Tiles
from gridloom.plans.geometry import Rect
from gridloom.plans.trace import load


def dense(a):
    return np.array(a.values()).reshape(a.extents)


def build(ctx, rules, body, *arrays, values=(), **lookups):
    b = KernelBuilder(body)
    for n in arrays:
        b.param_array(n, INT64)
    for n in values:
        b.param_value(n, INT64)
    for n, key in lookups.items():
        b.lookup(n, key)
    for r in rules if isinstance(rules, list) else [rules]:
        b.annotate(r)
    return b.compile(ctx)


def test_types():
    assert SCALARS["uint8"].spark.simpleString() == "smallint" and SCALARS["uint64"].spark.simpleString() == "decimal(20,0)"
    assert FLOAT32.vector(3).spark.simpleString() == "array<float>" and key_value().spark.simpleString() == "struct<key:bigint,value:bigint>"
    assert cast_value(200, INT64, SCALARS["uint8"]) == 200 and cast_value(7, SCALARS["int16"], FLOAT32) == 7.0
    for bad in [(300, INT64, SCALARS["uint8"]), (1, INT64, FLOAT64), (1.5, FLOAT64, INT64), (1, INT32, FLOAT32)]:
        with pytest.raises(CastError):
            cast_value(*bad)
    with pytest.raises(CastError):
        checked(1 << 40, INT32)
    with pytest.raises(ValueError):
        dtype_of("bool")


def test_reduction_identities():
    assert reduction("&").identity(INT64) == -1 and reduction("|").identity(INT64) == 0
    assert reduction("and").identity(SCALARS["uint8"]) == 255 and reduction("min").identity(INT32) == 2**31 - 1 and reduction("max").identity(FLOAT64) == float("-inf")
    with pytest.raises(TypeError):
        REDUCTIONS["and"].identity(FLOAT64)
    with pytest.raises(ValueError):
        reduction("mean")


def test_constructors(ctx):
    assert ctx.array([3, 1, 2]).values() == [3, 1, 2]
    assert dense(ctx.array([[1, 2], [3, 4], [5, 6]])).tolist() == [[1, 2], [3, 4], [5, 6]]
    assert ctx.empty(2).values() == [None, None] and ctx.scalar(4).values() == [4] and ctx.array([]).values() == []
    assert ctx.ones((2, 2), dtype="int32").values() == [1] * 4 and ctx.zeros_f(2).values() == [0.0, 0.0] and ctx.full_f(1, 9).stored.order == "F"
    a = ctx.full((2, 3), 7, Tiles((1, 1)))
    assert ctx.zeros_like(a).values() == [0] * 6 and ctx.full_like(a, 2).extents == (2, 3) and ctx.ones_like(a, "float32").kind == FLOAT32
    assert (a.nrows, a.ncols, a.nlayers, len(a), a.is_empty) == (2, 3, 1, 6, False)
    with pytest.raises(CastError):
        ctx.full(2, 300, dtype="int8")


def test_views(ctx):
    x = np.arange(60).reshape(3, 4, 5)
    a = ctx.array(x.tolist())
    assert (dense(a[1:3, 0:2, 1:4]) == x[1:3, 0:2, 1:4]).all() and (dense(a[:, 2, :]) == x[:, 2, :]).all() and dense(a[1, 2, 3]) == x[1, 2, 3]
    assert (dense(a.permute_axes((2, 0, 1))) == x.transpose(1, 2, 0)).all() and (dense(a.swap_axes(0, 2)[1:4, 2]) == x.swapaxes(0, 2)[1:4, 2]).all()
    assert (dense(a.row(1).T) == x[1].T).all() and (dense(a.layer(4).column(3)) == x[:, 3, 4]).all()
    b = a.row(2)
    assert dense(b[None, 1:3]).shape == (1, 2, 5) and (dense(b.insert_axis(1).remove_axis(1)) == x[2]).all()
    r = a.restrict(slice(1, 3), slice(None), 2)
    assert r.domain == Rect.of((1, 3), (0, 4)) and r.get(2, 3) == x[2, 3, 2] and a[1:3].get(0, 0, 0) == x[1, 0, 0]
    for bad in [lambda: a[0:9], lambda: a[5], lambda: a.element(0, 0), lambda: a.slice(0, 0, 0, 0), lambda: a.insert_axis(0)]:
        with pytest.raises((IndexError, ValueError)):
            bad()


def test_writes(ctx):
    x = np.arange(24).reshape(4, 6)
    a = ctx.array(x.tolist())
    a[1:3, 2:5].fill(-1)
    x[1:3, 2:5] = -1
    a.set((3, 5), 99)
    x[3, 5] = 99
    a.T[0:2].fill_zeros()
    x.T[0:2] = 0
    assert (dense(a) == x).all()
    a[0:2].assign_from(a[2:4])
    x[0:2] = x[2:4]
    assert (dense(a) == x).all()
    a[3].copy_from([1, 2, 3, 4, 5, 6])
    x[3] = [1, 2, 3, 4, 5, 6]
    b = a.T.copy()
    assert (dense(a) == x).all() and (dense(b) == x.T).all()
    b.assign_from(a.T)  # another axis order is fine
    with pytest.raises(TypeError):
        a.assign_from(ctx.zeros((4, 6)))
    with pytest.raises(ValueError):
        a.assign_from(b)
    with pytest.raises(ValueError):
        a.copy_from([1])
    e = ctx.empty(3, dtype="int64")
    e[0:2].assign_from(ctx.array([4, 5]))
    assert e.values() == [4, 5, None]
    out = [0] * 24
    a.copy_to(out)
    assert out == x.ravel().tolist()
    with pytest.raises(ValueError):
        a.copy_to([1])
    a.release()
    with pytest.raises(RuntimeError):
        a.fill(0)


@pytest.mark.parametrize("op,f", [("sum", np.sum), ("product", np.prod), ("min", np.min), ("max", np.max), ("and", np.bitwise_and.reduce), ("or", np.bitwise_or.reduce)])
def test_reduce_axis(ctx, op, f):
    x = np.random.default_rng(0).integers(1, 9, (3, 4, 2))
    a = ctx.array(x.tolist())
    for k in range(3):
        assert (dense(a.reduce_axis(k, op)) == f(x, axis=k)).all()
    into = ctx.full((4, 2), 3)
    a.reduce_axis(0, op, into)
    old = np.full((4, 2), 3)
    fold = {"sum": np.add, "product": np.multiply, "min": np.minimum, "max": np.maximum, "and": np.bitwise_and, "or": np.bitwise_or}[op]
    assert (dense(into) == fold(old, f(x, axis=0))).all()


def test_sums_that_overflow_fail(ctx):
    a = ctx.full(4, 100, dtype="int8")
    with pytest.raises(Exception, match="(?i)overflow"):
        a.reduce_axis(0, "sum").values()


def test_random_kernels(ctx):
    """Affine reads against numpy."""
    rng = np.random.default_rng(1)
    n = 40
    x, y = rng.integers(0, 99, n), rng.integers(0, 99, (n, 7))
    a, b = ctx.array(x.tolist()), ctx.array(y.tolist())
    for rule, want in [
        ("read A[i+3]", {i: x[i + 3] for i in range(n) if i + 3 < n}),
        ("read A[2*i-5]", {i: x[2 * i - 5] for i in range(n) if 0 <= 2 * i - 5 < n}),
        ("read A[30-3*i]", {i: x[30 - 3 * i] for i in range(n) if 0 <= 30 - 3 * i < n}),
        ("read A[(i+5)/4]", {i: x[(i + 5) // 4] for i in range(n)}),
        ("read A[(3*i-7)/2]", {i: x[(3 * i - 7) // 2] for i in range(n) if 0 <= (3 * i - 7) // 2 < n}),
        ("read A[3]", {i: x[3] for i in range(n)}),
    ]:
        out = ctx.empty(n, dtype="int64")
        build(ctx, f"global i => {rule}, write B[i]", {"B": "A"}, "A", "B").launch(n, a, out)
        assert {i: v for i, v in enumerate(out.values()) if v is not None} == want, rule
        build(ctx, f"global i => {rule}, write B[i]", {"B": "coalesce(A, -1)"}, "A", "B").launch(n, a, out, missing="null")
        assert out.values() == [want.get(i, -1) for i in range(n)], rule
    for rule, cells in [
        ("A[i-2:i+4]", lambda i: x[max(0, i - 2) : i + 4]), ("A[2*i:2*i+5]", lambda i: x[2 * i : 2 * i + 5]), ("A[3*i:3*i+2]", lambda i: x[3 * i : 3 * i + 2]),
        ("A[i/3:i/3+2]", lambda i: x[i // 3 : i // 3 + 2]), ("A[5:20:4]", lambda i: x[5:20:4]), ("A[:]", lambda i: x), ("A[30:]", lambda i: x[30:]), ("A[:4]", lambda i: x[:4]), ("A[i:i+9:3]", lambda i: x[i : i + 9 : 3]),
    ]:
        out = ctx.empty(n, dtype="int64")
        build(ctx, f"global i => read {rule}, write B[i]", {"B": "sum(A)"}, "A", "B").launch(n, a, out) if "i" in rule else build(ctx, f"global i => read C[i], read {rule}, write B[i]", {"B": "sum(A) + 0 * C"}, "A", "B", "C").launch(n, a, out, a)
        assert out.values() == [int(cells(i).sum()) if len(cells(i)) else None for i in range(n)], rule
    out = ctx.empty(n, dtype="int64")
    build(ctx, "global [i, j] => read M[i,j], reduce(max) B[i]", {"B": "M"}, "M", "B").launch((n, 7), b, out)
    assert out.values() == y.max(axis=1).tolist()
    c = ctx.empty((7, n), dtype="int64")
    build(ctx, "global [i, j] => read M[i,j], read A[i], write C[j,i]", {"C": "M + A + i"}, "M", "A", "C").launch((n, 7), b, a, c)
    assert (dense(c) == (y + x[:, None] + np.arange(n)[:, None]).T).all()
    d = ctx.empty((7, 7), dtype="int64")
    build(ctx, "global [i, j] => read A[:,i], read B[:,j], write C[i,j]", {"C": "sum(A * B)"}, "A", "B", "C").launch((7, 7), b, b, d)
    assert (dense(d) == y.T @ y).all()


def test_blocks_and_locals(ctx):
    x = np.arange(10)
    a, out, part = ctx.array(x.tolist()), ctx.empty(10, dtype="int64"), ctx.empty(3, dtype="int64")
    build(ctx, "global i, block b, local l, blocksize s => read A[b*4:b*4+4], write B[i]", {"B": "sum(A) + 1000 * b + 100 * l + s"}, "A", "B").launch(10, a, out, block=4)
    assert out.values() == [int(x[i // 4 * 4 : i // 4 * 4 + 4].sum()) + 1000 * (i // 4) + 100 * (i % 4) + 4 for i in range(10)]
    build(ctx, "block b => read A[b*4:b*4+4], write P[b]", {"P": "max(A)"}, "A", "P").launch(10, a, part, block=4)
    assert part.values() == [3, 7, 9]
    big = ctx.zeros(20, dtype="int64")
    build(ctx, "global i => read A[i], write B[2*i:2*i+2]", {"B": "array(A, -A)"}, "A", "B").launch(10, a, big)
    assert big.values() == [v for i in x.tolist() for v in (i, -i)]


def test_atomic_gather_and_readwrite(ctx):
    a, h = ctx.array([3, 1, 3, 0, 9]), ctx.full(4, 10)
    build(ctx, "global i => read A[i], atomic(+) H[:]", {"H": Scatter(("A",), "1L")}, "A", "H").launch(5, a, h)
    assert h.values() == [11, 11, 10, 12]  # the index 9 lies outside
    out = ctx.empty(5, dtype="int64")
    build(ctx, "global i => read A[i], read T[:], write B[i]", {"B": "T"}, "A", "T", "B", T="A").launch(5, a, h, out)
    assert out.values() == [12, 11, 12, 11, None]
    build(ctx, "global i => readwrite A[i]", {"A": "A * 2"}, "A").launch(3, a)
    assert a.values() == [6, 2, 6, 0, 9]
    before = a.stored.version
    build(ctx, "global i => read A[n-i-1], write B[i]", {"B": "A"}, "A", "B", values=("n",)).launch(5, a, a, 5)
    assert a.values() == [9, 0, 6, 2, 6] and a.stored.version == before + 1  # reads see the version before


def test_kernel_errors(ctx):
    with pytest.raises(KernelError, match="twice"):
        KernelBuilder({}).param_array("A", INT64).param_array("A", INT64).compile(ctx)
    with pytest.raises(KernelError, match="no rule"):
        KernelBuilder({}).param_array("A", INT64).compile(ctx)
    with pytest.raises(KernelError, match="unknown array"):
        build(ctx, "global i => read Z[i]", {}, "A")
    with pytest.raises(KernelError, match="may repeat"):
        build(ctx, "global i => write A[i], write A[i+1]", {"A": "1"}, "A")
    with pytest.raises(KernelError, match="rank"):
        build(ctx, "global i => read A[i], read A[i,i]", {}, "A")
    with pytest.raises(KernelError, match="case"):
        build(ctx, "global a => read A[a]", {}, "A")
    k = build(ctx, "global i => read A[i], write B[i]", {"B": "A + n"}, "A", "B", values=("n",))
    a = ctx.array([1, 2])
    for args, what in [((a,), "takes 3"), ((a, a, 1.5), "argument 2"), ((1, a, 1), "argument 0"), ((a, ctx.zeros(2), 1), "type"), ((a, ctx.zeros((2, 2), dtype="int64"), 1), "axes")]:
        with pytest.raises(KernelError, match=what):
            k.launch(2, *args)
    with pytest.raises(KernelError, match="same cell"):
        build(ctx, "global i => read A[i], write B[i/2]", {"B": "A"}, "A", "B").launch(2, a, a)
    with pytest.raises(KernelError, match="outside"):
        KernelBuilder({"B": "A"}).param_array("A", INT64).param_array("B", INT64).annotate("global i => read A[i+1], write B[i]").debugging().compile(ctx).launch(2, a, a)
    with pytest.raises(KernelError, match="divisible"):
        k.launch_distribution(8, [(0, Rect.of((0, 3))), (1, Rect.of((3, 8)))], ctx.zeros(8, dtype="int64"), ctx.zeros(8, dtype="int64"), 1, block=4)
    k.launch_distribution(2, [(0, Rect.of((0, 1))), (1, Rect.of((1, 2)))], a, a, 1)
    k.launch_one(2, a, a, 1)
    k.launch_like(a, a, a, 1)
    assert a.values() == [4, 5] and k.constant("x") is None
    assert k.explain_regions(Rect.of((0, 1)), a, a, 1)["A"] == [Rect.of((0, 1))]


def test_numpy_blocks(ctx):
    x = np.random.default_rng(2).random((13, 9))
    a, out = ctx.array(x.tolist()), ctx.empty((13, 9))
    w = ctx.array([0.5, 2.0])

    def blur(block, A, W, scale):
        made = np.zeros(tuple(h - l for l, h in zip(block.lo, block.hi)))
        for i in range(block.lo[0], block.hi[0]):
            for j in range(block.lo[1], block.hi[1]):
                near = [(i + d, j) for d in (-1, 0, 1) if 0 <= i + d < 13]
                made[i - block.lo[0], j - block.lo[1]] = scale * W.values.sum() * sum(A.at(*p) for p in near)
        return made

    k = KernelBuilder(blur).param_array("A", FLOAT64).param_array("W", FLOAT64).param_array("B", FLOAT64).param_value("scale", FLOAT64).annotate("global [i, j] => read A[i-1:i+2, j], read W[:], write B[i,j]").compile(ctx)
    k.launch((13, 9), a, w, out, 2.0, dist=Tiles((4, 5)))
    want = 5.0 * (x + np.pad(x, ((1, 0), (0, 0)))[:-1] + np.pad(x, ((0, 1), (0, 0)))[1:])
    assert np.allclose(dense(out), want)


def test_events_and_trace(ctx, tmp_path):
    a = ctx.ones(10)
    seen = []
    e = a.barrier().then(lambda: seen.append(1))
    e.wait(60)
    ctx.synchronize()
    assert seen == [1] and e.query()
    failed = ctx.pool.submit(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.then(lambda: None).wait(60)
    ctx.trace.path = str(tmp_path / "trace")
    a.fill(2)
    ctx.trace.path = None
    assert load(str(tmp_path / "trace"))[0]["kind"] == "fill"
    a.checkpoint()
    assert a.distributed(Stencil((4,), (1,))).halo_chunks().count() == 14 and a.values() == [2.0] * 10


def test_scans_are_pruned(ctx, data):
    from gridloom.sources.tables import column_array, table

    df = table(ctx, data, "events")
    view = column_array(ctx, df.select("event_id", "user_id"), "event_id", "user_id", 1000)[100:300]
    plan = view.frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,100)" in plan and "LessThan(event_id,300)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
