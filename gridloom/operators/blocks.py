"""Kernels whose body is a numpy function over one block of the domain at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.plans.annotations import Access
from gridloom.plans.distribution import Distribution, Stencil, axis
from gridloom.plans.geometry import Rect

#: Cells of an array that every block reads whole; it is broadcast, so its size is checked.
WHOLE_LIMIT = 1 << 20


@dataclass(frozen=True)
class Window:
    """An array's cells around a block: values, and the coordinates of the first one."""

    values: np.ndarray
    origin: tuple[int, ...]

    def at(self, *index: int) -> object:
        """One value by global coordinates."""
        return self.values[tuple(i - o for i, o in zip(index, self.origin))]


@dataclass(frozen=True)
class Block:
    """The threads lo..hi of the domain."""

    lo: tuple[int, ...]
    hi: tuple[int, ...]


def _halo(parts: tuple[Access, ...], rank: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """Cells before and after a thread's own that a rule reads; None if it reads otherwise."""
    before, after = [0] * rank, [0] * rank
    if len(parts) != rank:
        return None
    for k, p in enumerate(parts):
        if p.at is None or p.at.divisor > 1 or p.at.factors != ((f"g{k}", 1),):
            return None
        before[k] = max(0, -p.at.const)
        after[k] = max(0, p.at.const + ((p.length - 1) * p.step if p.run else 0))
    return tuple(before), tuple(after)


def launch_blocks(kernel, box: Rect, arrays: dict, values: dict, constants: dict, dist: Distribution) -> None:
    """Groups each array's cells by the blocks that read them, halos included, and applies the
    body to one block at a time. Rules read a thread's own cell or cells around it, or a whole
    array of at most WHOLE_LIMIT cells; one array is written at the thread's own cell."""
    from gridloom.operators.kernel import KernelError, _Lowering

    low = _Lowering(kernel, box, (1, 1, 1), arrays, values, constants, "drop")
    outputs = [n for n, own in kernel.rules.items() if own[0][0].mode in ("write", "readwrite")]
    if len(outputs) != 1 or any(box.lo):
        raise KernelError("numpy kernels write one array, over a domain from 0")
    tile = dist.tile_of(box.extents)
    frame, whole = None, {}
    for n, own in kernel.rules.items():
        if own[0][0].mode == "write":
            continue
        if own[0][0].mode not in ("read", "readwrite"):
            raise KernelError("numpy kernels don't reduce")
        halos = [_halo(low.parts(r, rules), box.rank) for r, rules in own]
        array = arrays[n]
        if None in halos:
            if len(array) > WHOLE_LIMIT:
                raise KernelError(f"{n} is too large to be read whole by each block")
            whole[n] = (np.array(array.values()).reshape(array.extents), array.domain.lo)
            continue
        before = tuple(max(h[0][k] for h in halos) for k in range(box.rank))
        after = tuple(max(h[1][k] for h in halos) for k in range(box.rank))
        cells = Stencil(tile, before, after).with_halo(array.frame(), box.extents)
        part = cells.select("chunk", F.lit(n).alias("_name"), *[axis(k) for k in range(box.rank)], F.col("v").cast("double").alias("v"))
        frame = part if frame is None else frame.unionByName(part)
    if frame is None:
        raise KernelError("numpy kernels read an array")
    grid = dist.grid(box.extents)
    body, given = kernel.spec.body, {n: v for n, (v, _) in values.items()}
    extents, rank, out = box.extents, box.rank, outputs[0]

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number, at = key[0], []
        for g in reversed(grid):
            at.append(number % g)
            number //= g
        at = at[::-1]
        lo = tuple(a * t for a, t in zip(at, tile))
        hi = tuple(min(n, (a + 1) * t) for a, t, n in zip(at, tile, extents))
        windows = {n: Window(v, o) for n, (v, o) in whole.items()}
        for n, cells in pdf.groupby("_name"):
            index = cells[[axis(k) for k in range(rank)]].to_numpy()
            first, end = index.min(axis=0), index.max(axis=0) + 1
            dense = np.full(tuple(end - first), np.nan)
            dense[tuple((index - first).T)] = cells["v"].to_numpy()
            windows[str(n)] = Window(dense, tuple(int(x) for x in first))
        made = np.asarray(body(Block(lo, hi), **windows, **given))
        if made.shape != tuple(h - l for l, h in zip(lo, hi)):
            raise ValueError(f"the body made {made.shape} for block {lo}..{hi}")
        cells = np.stack(np.meshgrid(*[np.arange(l, h) for l, h in zip(lo, hi)], indexing="ij"), axis=-1).reshape(-1, rank)
        return pd.DataFrame({**{axis(k): cells[:, k] for k in range(rank)}, "v": made.reshape(-1).astype(float)})

    schema = ", ".join([*[f"{axis(k)} long" for k in range(rank)], "v double"])
    arrays[out]._merge(frame.groupBy("chunk").applyInPandas(apply, schema))
