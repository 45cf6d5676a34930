import itertools
import random

import pytest

from gridloom.plans.annotations import AnnotationError, Binding, Form, Index, Name, Num, Op, Rule, Slice, access, affine, parse, region, tokenize
from gridloom.plans.distribution import AxisBlocks, Central, Permuted, Replicated, Shuffled, Stencil, Tiles, column_blocks, column_cyclic, row_blocks, row_cyclic
from gridloom.plans.geometry import Affine, Permutation, Point, Rect, ceil_div, extents_of, round_up
from gridloom.plans.trace import to_dot

I, J, K, M = Name("i"), Name("j"), Name("k"), Name("m")


def test_tokens():
    assert [t[1] for t in tokenize("123 + read A[i, 456]")] == ["123", "+", "read", "A", "[", "i", ",", "456", "]"]
    with pytest.raises(AnnotationError):
        tokenize("a ? b")


@pytest.mark.parametrize(
    "text,want",
    [
        ("i:j:k", Slice(I, J, K)), ("i:j:", Slice(I, J)), ("i:j", Slice(I, J)), ("i::k", Slice(I, None, K)), ("i::", Slice(I)), ("i:", Slice(I)),
        (":j:k", Slice(None, J, K)), (":j:", Slice(None, J)), (":j", Slice(None, J)), ("::k", Slice(None, None, K)), ("::", Slice()), (":", Slice()),
    ],
)
def test_slice_forms(text, want):
    assert parse(f"global [i,j,k] => read A[{text}]").rules[0].slices == (want,)


def test_full_rule_set():
    got = parse("global i, local j, block [k, m] => read A[i], reduce(+) B[0], write C[i:i+1:2, :, i], readwrite D[i,j,k:m]")
    assert got.bindings == {"i": Binding("global", 0), "j": Binding("local", 0), "k": Binding("block", 0), "m": Binding("block", 1)}
    assert got.rules == (
        Rule("read", "A", (Index(I),)),
        Rule("reduce", "B", (Index(Num(0)),), "sum"),
        Rule("write", "C", (Slice(I, Op("+", I, Num(1)), Num(2)), Slice(), Index(I))),
        Rule("readwrite", "D", (Index(I), Index(J), Slice(K, M))),
    )
    assert parse("global i => read A[i][i]").rules == parse("global i => read A[i, i]").rules


@pytest.mark.parametrize("text", ["global i read A[i]", "global [a,b,c,d] => read A[a]", "global i => peek A[i]", "global i => reduce(mean) A[i]", "global i => read A[i", "global i, local i => read A[i]", "global i => read A[i] read B[i]"])
def test_bad_rules(text):
    with pytest.raises(AnnotationError):
        parse(text)


@pytest.mark.parametrize(
    "index,ranges",
    [
        ("i", [(0, 128), (128, 256), (768, 1000)]),
        ("1000-i-1", [(872, 1000), (744, 872), (0, 232)]),
        ("i-1:i+2", [(0, 129), (127, 257), (767, 1000)]),
    ],
)
def test_regions(index, ranges):
    rule = parse(f"global i => read A[{index}, :, :]").rules[0]
    parts = tuple(access(s, {}, {"i"}) for s in rule.slices)
    domain = Rect.of((0, 1000), (0, 1000), (0, 1000))
    for (first, count), want in zip([(0, 1), (1, 1), (6, 2)], ranges):
        box = region(parts, {"i": (first * 128, (first + count) * 128)}, domain)
        assert (box.lo[0], box.hi[0]) == want and box.extents[1:] == (1000, 1000)


def test_divided_region():
    rule = parse("global i => read A[i / 16:i/16 + 2]").rules[0]
    part = access(rule.slices[0], {}, {"i"})
    got = [region((part,), {"i": (a * 128, (a + n) * 128)}, Rect.of((0, 1000))) for a, n in [(0, 1), (1, 1), (123, 2)]]
    assert [(r.lo[0], r.hi[0]) for r in got] == [(0, 9), (8, 17), (984, 1000)]


def test_affine_forms():
    at = lambda t: affine(parse(f"global [i, j] => read A[{t}]").rules[0].slices[0].at, {"n": 5}, {"i", "j"})
    assert at("2*i + n - 1") == Form((("i", 2),), 4)
    assert at("(4*i + 8) / 4") == Form((("i", 1),), 2)
    assert at("i/3/2") == Form((("i", 1),), 0, 6)
    assert at("i/4 + j") == Form((("i", 1), ("j", 4)), 0, 4)
    for i, text in itertools.product(range(-9, 9), ["(i-7)/2", "i/4*1", "-i/-3", "i/5+1"]):
        want = {"(i-7)/2": (i - 7) // 2, "i/4*1": i // 4, "-i/-3": i // 3, "i/5+1": i // 5 + 1}[text]
        assert at(text).value({"i": i}) == want
    for bad in ["i*j", "1/i", "x", "(i/2)*3", "i/2 + j/3"]:
        with pytest.raises(ValueError):
            at(bad)
    for bad in ["i:j", "i:", "0:0", "i:i+3:0"]:
        with pytest.raises(ValueError):
            access(parse(f"global [i, j] => read A[{bad}]").rules[0].slices[0], {}, {"i", "j"})


def test_geometry():
    assert [ceil_div(x, y) for x, y in [(7, 2), (-7, 2), (7, -2), (-7, -2), (6, 3), (0, 5), (1, 5)]] == [4, -3, -3, 4, 2, 0, 1]
    assert round_up(13, 4) == 16 and Point((1, 5)).minus(Point((2, 3))).at == (0, 2)
    assert list(Rect.of((4, 6), (8, 8))) == [] and list(Rect.of((0, 1), (0, 1), (0, 1))) == [(0, 0, 0)]
    a, b = Rect.of((0, 4), (2, 6)), Rect.of((2, 9), (5, 5))
    assert a.union(b) == a and a.intersection(Rect.of((3, 9), (0, 3))) == Rect.of((3, 4), (2, 3))
    assert extents_of(5) == (5,) and extents_of([1, 2, 3]) == (1, 2, 3) and extents_of(()) == ()
    with pytest.raises(ValueError):
        extents_of((1, 2, 3, 4))
    p = Permutation((2, 0, 1))
    assert p.apply("abc") == ("b", "c", "a") and p.then(p.inverse()) == Permutation.identity(3)
    f, g = Affine(((2, 0), (0, 1)), (1, 0)), Affine(((0, 1), (1, 0)), (0, 5))
    assert f.then(g).apply((3, 4)) == g.apply(f.apply((3, 4))) and f.regular and not Affine(((1, 1),), (0,)).regular
    assert f.bounds(Rect.of((0, 3), (1, 2))) == Rect((1, 1), (6, 2))


CASES = [
    ((100,), Tiles((11,))), ((100, 120), Tiles((27, 24))), ((100, 120, 14), Tiles((27, 24, 7))), ((100, 120), Tiles((27,))), ((77,), row_cyclic(8)), ((77,), row_blocks(5)), ((77, 30), row_blocks(4, 16)),
    ((30, 77), column_cyclic(8)), ((30, 77), column_blocks(3)), ((9, 9), Central()), ((9, 9), Replicated()), ((100,), Stencil((25,), (1,))), ((1000,), Stencil((26,), (2,))), ((1000,), Stencil((24,), (3,))),
    ((150, 150), Stencil((25, 25), (1, 1))), ((125, 150), Stencil((25, 26), (0, 2))), ((125, 15, 10), Stencil((25, 26, 3), (0, 2, 1), (2, 0, 1), (0, 2, 0))), ((60, 40), Permuted(Permutation((1, 0)), Tiles((7, 9)))), ((60, 40), Shuffled(Tiles((7, 9)))),
]


@pytest.mark.parametrize("extents,dist", CASES)
def test_chunks_cover(extents, dist):
    chunks = list(dist.chunks(extents, 3))
    assert sum(c.owned.volume for c in chunks) == Rect((0,) * len(extents), extents).volume
    assert all(c.stored.holds(c.owned) for c in chunks) and [c.number for c in chunks] == list(range(len(chunks)))
    assert sorted(x.number for x in dist.order(chunks)) == [c.number for c in chunks]
    rng = random.Random(0)
    for _ in range(30):
        at = tuple(rng.randrange(n) for n in extents)
        assert sum(c.owned.contains(at) for c in chunks) == 1


def test_halo_has_no_width_where_one_tile_covers():
    assert Stencil((200,), (3,)).halo_of((100,)) == ((0,), (0,))
    assert AxisBlocks(3, 0, 10).tile_of((100,)) == (40,)


@pytest.mark.parametrize("extents,dist", [((30,), Stencil((7,), (2,))), ((12, 9), Stencil((5, 4), (1, 2), (0, 1), (1, 0))), ((20, 11), Tiles((6, 4)))])
def test_frames_by_chunk(ctx, extents, dist):
    a = ctx.full(extents, 1, dist)
    got = {}
    for r in dist.with_halo(a.frame(), extents).collect():
        got.setdefault(r["chunk"], []).append((tuple(r[f"i{k}"] for k in range(len(extents))), r["owned"]))
    for c in dist.chunks(extents):
        assert sorted(got.get(c.number, [])) == sorted((x, c.owned.contains(x)) for x in c.stored)
    rows = a.regions().collect()
    for r, c in zip(sorted(rows, key=lambda r: r["chunk"]), dist.chunks(extents)):
        assert [(r[f"lo{k}"], r[f"hi{k}"]) for k in range(len(extents))] == list(zip(c.owned.lo, c.owned.hi))
    assert a.affinity(*[n - 1 for n in extents]) == (len(rows) - 1) % ctx.places


def test_dot():
    events = [{"id": 0, "kind": "array", "writes": ["a"]}, {"id": 1, "kind": "launch", "name": "k", "reads": ["a"], "writes": ["b"]}]
    dot = to_dot(events)
    assert '"a@e0" -> e1' in dot and 'label="b"' in dot and "e0" not in to_dot(events, 1).split("->")[0].replace("e1", "")
