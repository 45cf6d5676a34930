"""Kernels: annotated computations over an index domain.

A kernel has parameters, rules that say which cells each thread touches, and a body: for
each output an SQL expression or a function from a name -> Column mapping to a Column, or
one numpy function over blocks. Where a rule reads runs of cells the body aggregates them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import CastError, DType, cast_value, checked, dtype_of, value_type
from gridloom.functions.reductions import reduction
from gridloom.operators.array import Array
from gridloom.operators.context import Context
from gridloom.plans.annotations import Access, Form, Rule, Rules, access, parse, region
from gridloom.plans.distribution import Central, Distribution, Tiles, axis
from gridloom.plans.geometry import MAX_RANK, Rect, ceil_div, extents_of
from gridloom.plans.lowering import Relation, form_column, join_all, relation, var
from gridloom.streaming.events import Event

Expression = str | Callable[[dict[str, Column]], Column]


class KernelError(ValueError):
    """A kernel that isn't well formed, or arguments that don't fit it."""


@dataclass(frozen=True)
class Scatter:
    """For atomic outputs: the cell that a thread updates, and the value it puts in."""

    index: tuple[Expression, ...]
    value: Expression


@dataclass(frozen=True)
class Param:
    name: str
    kind: DType
    is_array: bool


@dataclass
class KernelBuilder:
    """Collects what a kernel is made of; compile() checks it."""

    body: dict[str, Expression | Scatter] | Callable
    name: str = "kernel"
    params: list[Param] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    constants: dict[str, int] = field(default_factory=dict)
    lookups: dict[str, Expression] = field(default_factory=dict)
    options: list[str] = field(default_factory=list)
    debug: bool = False

    @classmethod
    def from_file(cls, path: str, name: str = "kernel") -> KernelBuilder:
        """A JSON file: an object of SQL expressions by output."""
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), name)

    def param_value(self, name: str, dtype: DType | str) -> KernelBuilder:
        self.params.append(Param(name, dtype_of(dtype), False))
        return self

    def param_array(self, name: str, dtype: DType | str) -> KernelBuilder:
        self.params.append(Param(name, dtype_of(dtype), True))
        return self

    def annotate(self, text: str) -> KernelBuilder:
        self.texts.append(text)
        return self

    def define(self, name: str, value: int) -> KernelBuilder:
        self.constants[name] = int(value)
        return self

    add_constant = define

    def lookup(self, name: str, key: Expression) -> KernelBuilder:
        """Array `name` (read as [:]) is read at an index that the body computes."""
        self.lookups[name] = key
        return self

    def option(self, text: str) -> KernelBuilder:
        """Kept, without effect: Catalyst compiles the expressions."""
        self.options.append(text)
        return self

    def debugging(self, on: bool = True) -> KernelBuilder:
        """Launches then check that every read index lies in its array."""
        self.debug = on
        return self

    def block_size(self, *size: int) -> KernelBuilder:
        return self.option(f"block_size={size}")

    def compile(self, context: Context) -> Kernel:
        names = [p.name for p in self.params]
        for n in names:
            if names.count(n) > 1:
                raise KernelError(f"parameter {n} is declared twice")
        parsed = [parse(t) for t in self.texts]
        arrays = {p.name for p in self.params if p.is_array}
        rules: dict[str, list[tuple[Rule, Rules]]] = {}
        for text in parsed:
            for r in text.rules:
                if r.name not in arrays:
                    raise KernelError(f"rule for unknown array {r.name}")
                rules.setdefault(r.name, []).append((r, text))
        for n in names:
            if n in arrays and n not in rules:
                raise KernelError(f"array {n} has no rule")
            own = [r for r, _ in rules.get(n, [])]
            if len(own) > 1 and any(r.mode != "read" for r in own):
                raise KernelError(f"only read rules may repeat: {n}")
            if len({len(r.slices) for r in own}) > 1:
                raise KernelError(f"rules for {n} differ in rank")
        if isinstance(self.body, dict):
            for n, own in rules.items():
                if own[0][0].mode != "read" and n not in self.body:
                    raise KernelError(f"nothing is computed for {n}")
            for n in self.body:
                if n not in rules or rules[n][0][0].mode == "read":
                    raise KernelError(f"{n} isn't an output")
        variables = {v for text in parsed for v in text.bindings}
        columns = [n for n in names if n not in rules or rules[n][0][0].mode in ("read", "readwrite")]
        folded = [n.lower() for n in {*columns, *variables, *self.constants}]
        for n in folded:
            if folded.count(n) > 1:
                raise KernelError(f"names differ by case alone: {n}")
        for n in self.lookups:
            if n not in rules or rules[n][0][0].mode != "read":
                raise KernelError(f"lookup in {n}, which isn't read")
        return Kernel(context, self, rules)


@dataclass
class Kernel:
    context: Context
    spec: KernelBuilder
    rules: dict[str, list[tuple[Rule, Rules]]]

    def constant(self, name: str) -> int | None:
        return self.spec.constants.get(name)

    # -- arguments ---------------------------------------------------------------------

    def _bind(self, args: tuple) -> tuple[dict[str, Array], dict[str, tuple[object, DType]], dict[str, int]]:
        params = self.spec.params
        if len(args) != len(params):
            raise KernelError(f"{self.spec.name} takes {len(params)} arguments, not {len(args)}")
        arrays, values = {}, {}
        constants = dict(self.spec.constants)
        for k, (p, a) in enumerate(zip(params, args)):
            if p.is_array != isinstance(a, Array):
                raise KernelError(f"argument {k} ({p.name}) must be {'an array' if p.is_array else 'a value'}")
            if not p.is_array:
                try:
                    v = cast_value(a, value_type(a), p.kind) if value_type(a).integer and p.kind.floating and p.kind.bits == 32 else checked(a, p.kind)
                except CastError as e:
                    raise KernelError(f"argument {k} ({p.name}): {e}") from None
                values[p.name] = (v, p.kind)
                if isinstance(v, int):
                    constants[p.name] = v
                continue
            if a.kind != p.kind:
                raise KernelError(f"argument {k} ({p.name}) has type {a.kind.name}, not {p.kind.name}")
            rank = len(self.rules[p.name][0][0].slices)
            if a.rank != rank:
                raise KernelError(f"argument {k} ({p.name}) has {a.rank} axes, its rule {rank}")
            arrays[p.name] = a
        return arrays, values, constants

    # -- launches ----------------------------------------------------------------------

    def launch(self, domain: object, *args: object, block: int | tuple[int, ...] = 1, dist: Distribution | None = None, missing: str = "drop") -> Event:
        """Runs over the index domain: a shape, or a Rect.

        block is the block size that block and local variables refer to. missing: "drop"
        leaves out threads with a single-cell read outside its array, "null" lets them read
        null. Launches take effect in program order; each sees what stood before it.
        """
        box = domain if isinstance(domain, Rect) else Rect((0,) * len(extents_of(domain)), extents_of(domain))
        arrays, values, constants = self._bind(args)
        size = extents_of(block) + (1,) * (MAX_RANK - len(extents_of(block)))
        reads = [a.stored.name for n, a in arrays.items() if self.rules[n][0][0].mode != "write"]
        writes = [a.stored.name for n, a in arrays.items() if self.rules[n][0][0].mode != "read"]
        self.context.trace.add("launch", name=self.spec.name, domain=[list(box.lo), list(box.hi)], reads=reads, writes=writes)
        if callable(self.spec.body):
            from gridloom.operators.blocks import launch_blocks

            launch_blocks(self, box, arrays, values, constants, dist or Tiles(size[: box.rank]))
            return Event.ready()
        outputs = _Lowering(self, box, size, arrays, values, constants, missing).outputs()
        for put in outputs:  # all were made from the old versions
            put(dist)
        return Event.ready()

    def launch_one(self, domain: object, *args: object, **how: object) -> Event:
        """On one executor."""
        return self.launch(domain, *args, dist=Central(), **how)

    def launch_like(self, array: Array, *args: object, **how: object) -> Event:
        """Over an array's domain, with its distribution."""
        how.setdefault("dist", array.stored.dist)
        return self.launch(array.domain, *args, **how)

    def launch_distribution(self, domain: object, superblocks: list[tuple[int, Rect]], *args: object, block: int | tuple[int, ...] = 1, **how: object) -> Event:
        """With given super-blocks (place, box). Their edges must lie on block borders, but at
        the domain's end. They must cover the domain; they only steer placement."""
        box = domain if isinstance(domain, Rect) else Rect((0,) * len(extents_of(domain)), extents_of(domain))
        size = extents_of(block) + (1,) * (MAX_RANK - len(extents_of(block)))
        for _, b in superblocks:
            for lo, hi, end, s in zip(b.lo, b.hi, box.hi, size):
                if lo % s or (hi % s and hi != end):
                    raise KernelError(f"super-block {b} isn't divisible by block size {size[: box.rank]}")
        if sum(b.intersection(box).volume for _, b in superblocks) != box.volume:
            raise KernelError("super-blocks don't cover the domain once")
        return self.launch(box, *args, block=block, **how)

    def explain_regions(self, domain: Rect, *args: object, block: int | tuple[int, ...] = 1) -> dict[str, list[Rect]]:
        """The boxes that each rule touches over a domain."""
        arrays, values, constants = self._bind(args)
        size = extents_of(block) + (1,) * (MAX_RANK - len(extents_of(block)))
        low = _Lowering(self, domain, size, arrays, values, constants, "drop")
        return {n: [region(low.parts(r, rules), low.ranges, arrays[n].domain) for r, rules in own] for n, own in self.rules.items()}


class _Lowering:
    """One launch as DataFrames."""

    def __init__(self, kernel: Kernel, box: Rect, size: tuple[int, ...], arrays: dict, values: dict, constants: dict, missing: str):
        self.kernel, self.box, self.size = kernel, box, size
        self.arrays, self.values, self.constants, self.missing = arrays, values, constants, missing
        self.ranges: dict[str, tuple[int, int]] = {}
        for k in range(box.rank):
            self.ranges[f"g{k}"] = (box.lo[k], box.hi[k])
            self.ranges[f"b{k}"] = (box.lo[k] // size[k], ceil_div(box.hi[k], size[k]))
            self.ranges[f"l{k}"] = (0, size[k])
        self.used: set[str] = set()
        self.named: dict[str, object] = {}

    def _names(self, rules: Rules) -> dict[str, object]:
        """Thread variables by their names in a rule text; block sizes are numbers."""
        out: dict[str, object] = {}
        for name, b in rules.bindings.items():
            if b.space == "blocksize":
                out[name] = self.size[b.axis]
            elif b.axis >= self.box.rank:
                out[name] = 0
            else:
                out[name] = {"global": "g", "local": "l", "block": "b"}[b.space] + str(b.axis)
        return out

    def parts(self, rule: Rule, rules: Rules) -> tuple[Access, ...]:
        names = self._names(rules)
        constants = self.constants | {n: v for n, v in names.items() if isinstance(v, int)}
        bound = {n for n, v in names.items() if isinstance(v, str)}

        def rename(f: Form | None) -> Form | None:
            return f if f is None else Form(tuple(sorted((names[k], v) for k, v in f.factors)), f.const, f.divisor)

        got = [access(s, constants, bound) for s in rule.slices]
        got = tuple(Access(rename(a.at), a.length, a.step, a.run) for a in got)
        for a in got:
            if a.at is not None:
                self.used |= set(a.at.variables)
        return got

    def _derived(self, r: Relation) -> Relation:
        """Adds block and local variables of a relation that has the global one."""
        df, keys = r.df, list(r.keys)
        for k in range(self.box.rank):
            g = var(f"g{k}")
            if g in keys:
                for letter in "bl":
                    name = f"{letter}{k}"
                    if name in self.used and var(name) not in keys:
                        rest = F.pmod(F.col(g), F.lit(self.size[k]))
                        df = df.withColumn(var(name), ((F.col(g) - rest) / self.size[k]).cast("long") if letter == "b" else rest)
                        keys.append(var(name))
        return Relation(df, keys, r.value, r.total, r.single)

    def outputs(self) -> list[Callable]:
        spec, plans = self.kernel.spec, {}
        for n, own in self.kernel.rules.items():
            plans[n] = [(r, self.parts(r, rules)) for r, rules in own]
        for own in self.kernel.rules.values():
            for _, rules in own:
                self.named |= self._names(rules)
        self.used |= {v for v in self.named.values() if isinstance(v, str)}  # the body may name them
        relations, runs, gathers = [], False, []
        for n, own in plans.items():
            mode = own[0][0].mode
            if n in spec.lookups:
                gathers.append(n)
                continue
            if mode not in ("read", "readwrite"):
                continue
            for k, (_, parts) in enumerate(own):
                value = n if len(own) == 1 else f"{n}_{k}"
                relations.append(relation(self.arrays[n], parts, value, self.ranges))
                runs |= any(p.run for p in parts) and mode == "read"
                if spec.debug and not relations[-1].total and not any(p.run for p in parts):
                    raise KernelError(f"{n} is read outside its domain")
        relations = [self._derived(r) for r in relations]
        need = [f"g{k}" for k in range(self.box.rank)] if not runs and not any(v[0] in "b" for v in self.used) else [f"g{k}" for k in range(self.box.rank) if f"g{k}" in self.used]
        need += [f"b{k}" for k in range(self.box.rank) if f"b{k}" in self.used and f"g{k}" not in need]
        if self.missing == "null":
            relations.insert(0, self._derived(Relation(self._space(need), [var(n) for n in need], None, True)))
        held = {k for r in relations for k in r.keys}
        for n in need:  # variables that no read mentions
            if var(n) not in held:
                relations.append(self._derived(Relation(self._space([n]), [var(n)], None, True)))
        joined = join_all(relations, self.missing == "null") if relations else Relation(self._space([]), [], None, True)
        df, keys, total = joined.df, joined.keys, joined.total
        threads = [k for k in keys if not k.startswith("_o")]
        # what the body may name: variables, values and constants
        extra = {n: F.col(var(v)) for n, v in self.named.items() if isinstance(v, str) and var(v) in keys}
        extra |= {n: F.lit(v) for n, v in self.named.items() if isinstance(v, int)}
        extra |= {n: F.lit(v).cast(t.spark) for n, (v, t) in self.values.items()}
        extra |= {n: F.lit(v) for n, v in self.kernel.spec.constants.items() if n not in extra}
        for n, c in extra.items():
            if n not in df.columns:
                df = df.withColumn(n, c)
        for n in gathers:
            df = df.withColumn("_key", self._column(spec.lookups[n], df).cast("long"))
            held = self.arrays[n].frame().select(F.col("i0").alias("_key"), F.col("v").alias(n))
            df = df.join(held, "_key", "left" if self.missing == "null" else "inner").drop("_key")
            total = False
        cells = [r.value for r in relations if r.value and not any(k.startswith("_o") for k in r.keys)]
        group = [*threads, *[c for c in df.columns if c in extra or c in cells or c in gathers]] if runs else None
        return [self._output(n, own[0][0], own[0][1], df, group, total) for n, own in plans.items() if own[0][0].mode != "read"]

    def _space(self, names: list[str]) -> DataFrame:
        box = Rect.of(*[self.ranges[n] for n in names])
        df = self.kernel.context.cells(box)
        return df.select(*[F.col(axis(k)).alias(var(n)) for k, n in enumerate(names)]) if names else self.kernel.context.spark.range(1).select()

    def _column(self, e: Expression, df: DataFrame) -> Column:
        return F.expr(e) if isinstance(e, str) else e({c: F.col(c) for c in df.columns})

    def _output(self, name: str, rule: Rule, parts: tuple[Access, ...], df: DataFrame, group: list[str] | None, total: bool) -> Callable:
        array, body = self.arrays[name], self.kernel.spec.body[name]
        kind = array.kind
        if isinstance(body, Scatter):
            if rule.mode != "atomic":
                raise KernelError(f"{name}: only atomic outputs take computed cells")
            at = [self._column(e, df).cast("long").alias(axis(k)) for k, e in enumerate(body.index)]
            rows = df.select(*at, self._column(body.value, df).alias("v"))
            for k in range(array.rank):
                rows = rows.where((F.col(axis(k)) >= array.domain.lo[k]) & (F.col(axis(k)) < array.domain.hi[k]))
        else:
            value = self._column(body, df)
            rows = (df.groupBy(*group).agg(value.alias("v")) if group else df.groupBy().agg(value.alias("v"))) if group is not None else df.withColumn("v", value)
            rows = self._target(rows, parts, array)
        if rule.mode in ("reduce", "atomic"):
            op = reduction(rule.op)
            keys = [axis(k) for k in range(array.rank)]
            folded = rows.groupBy(*keys).agg(op.aggregate(F.col("v"), kind).alias("v"))
            return lambda dist: array._merge(folded, op)
        self._check_injective(name, parts)
        if total and array.whole and self._covers(parts, array):
            made = rows.select(*[axis(k) for k in range(array.rank)], F.col("v").cast(kind.spark).alias("v"))
            return lambda dist: array.stored.put(dist.place(made, array.stored.extents) if dist else made)
        return lambda dist: array._merge(rows)

    def _target(self, rows: DataFrame, parts: tuple[Access, ...], array: Array) -> DataFrame:
        """The cell that each thread writes; a run takes the body's array, element by element."""
        names = {c[3:]: F.col(c) for c in rows.columns if c.startswith("_t_")}
        cols, out = [], rows
        for k, p in enumerate(parts):
            if p.run:
                if any(q.run for q in parts[:k]):
                    raise KernelError("one axis at most is written as a run")
                out = out.select("*", F.posexplode("v").alias("_p", "_v")).drop("v").withColumnRenamed("_v", "v")
                start = F.lit(array.domain.lo[k]).cast("long") if p.at is None else form_column(p.at, names)
                cols.append((start + F.col("_p") * p.step).alias(axis(k)))
                if p.length is not None:
                    out = out.where(F.col("_p") < p.length)
            else:
                cols.append(form_column(p.at, names).alias(axis(k)))
        out = out.select(*cols, "v")
        for k, p in enumerate(parts):
            a, b = p.at.bounds(self.ranges) if p.at is not None else (array.domain.lo[k], array.domain.lo[k])
            if p.run and p.length is not None:
                b += (p.length - 1) * p.step
            if a < array.domain.lo[k]:
                out = out.where(F.col(axis(k)) >= array.domain.lo[k])
            if b >= array.domain.hi[k]:
                out = out.where(F.col(axis(k)) < array.domain.hi[k])
        return out

    def _thread_vars(self) -> set[str]:
        return {f"g{k}" for k in range(self.box.rank) if self.box.extents[k] > 1}

    def _check_injective(self, name: str, parts: tuple[Access, ...]) -> None:
        """Two threads must not write one cell: each index by one variable, undivided."""
        seen: set[str] = set()
        for p in parts:
            if p.at is None or p.at.constant:
                continue
            if p.at.divisor > 1 or len(p.at.factors) > 1:
                raise KernelError(f"{name}: threads may write the same cell")
            v, f = p.at.factors[0]
            if p.run and abs(f) < (p.length - 1) * p.step + 1:
                raise KernelError(f"{name}: runs written by threads overlap")
            seen.add(v)
        lost = self._thread_vars() - seen - {f"g{v[1]}" for v in seen if v[0] == "b"}
        if lost and any(v in self.used for v in lost):
            raise KernelError(f"{name}: threads along {sorted(lost)} write the same cell")

    def _covers(self, parts: tuple[Access, ...], array: Array) -> bool:
        seen = set()
        for k, p in enumerate(parts):
            if p.run or p.at.divisor > 1 or len(p.at.factors) != 1 or abs(p.at.factors[0][1]) != 1 or p.at.factors[0][0] in seen:
                return False
            a, b = p.at.bounds(self.ranges)
            if (a, b + 1) != (array.domain.lo[k], array.domain.hi[k]):
                return False
            seen.add(p.at.factors[0][0])
        return True
