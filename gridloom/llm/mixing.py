"""Mixing sources to target weights.

Temperature mixing: source token shares are raised to an exponent, which is bisected
until the mixture meets a target entropy or a repetition limit. The weights are then
realised under a token budget: each source's documents form blocks, each pass over a
source takes its blocks in a keyed random order, and the last pass stops at the quota.
All steps are DataFrame operations; prefix sums run over two levels so that a source
with a third of all rows is never gathered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import cut


@dataclass(frozen=True)
class MixParams:
    """Exactly one of target_entropy (nats) and max_repeats steers the exponent.

    budget: tokens to deal out; None means the least budget in which every source is
    passed over once in full, so that mixing repeats documents but loses none.
    """

    target_entropy: float | None = None
    max_repeats: float | None = 2.0
    budget: int | None = None
    block_tokens: int = 1 << 17
    seed: int = 11


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _moments(totals: DataFrame, exponents: list[float]) -> list[dict]:
    """For each exponent a: z = sum p^a, h = entropy of p^a / z, over sources with tokens."""
    p = totals.where("tokens > 0").select((F.col("tokens") / F.col("all")).alias("p"), "tokens", "all")
    aggs = []
    for i, a in enumerate(exponents):
        w = F.pow("p", F.lit(a))
        aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log("p")).alias(f"l{i}")]
    r = p.agg(F.min("p").alias("least"), F.max("p").alias("most"), F.max("all").alias("all"), *aggs).first()
    out = []
    for i, a in enumerate(exponents):
        z = r[f"z{i}"]
        entropy = math.log(z) - a * r[f"l{i}"] / z
        out.append({"a": a, "z": z, "entropy": entropy, "least": r["least"], "most": r["most"], "all": r["all"]})
    return out


def _repeats(m: dict, budget: int | None) -> float:
    """The largest number of passes over a source at this exponent."""
    cover = m["most"] ** (1 - m["a"]) * m["z"]
    share = cover if budget is None else budget / m["all"]
    return share * m["least"] ** (m["a"] - 1) / m["z"]


def solve_exponent(totals: DataFrame, p: MixParams, ways: int = 16, rounds: int = 8) -> dict:
    """Bisect the exponent in [0, 1]: entropy and repeats both fall as it grows.

    Each round evaluates ways-1 inner points in one aggregation, so the driver sees a
    fixed number of figures however many sources there are. The result is the smallest
    exponent (to 2**-32) whose repeats stay within the limit, or the largest one whose
    entropy is still the target or more; ends of the interval where no point meets it.
    """
    def met(m: dict) -> bool:  # true from some exponent on
        if p.target_entropy is not None:
            return m["entropy"] <= p.target_entropy
        return _repeats(m, p.budget) <= p.max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    ends = _moments(totals, [low, high])
    if met(ends[0]):
        return ends[0]
    if not met(ends[1]):
        return ends[1]
    best = ends[1]
    for _ in range(rounds):
        grid = [low + (high - low) * i / ways for i in range(1, ways)]
        tried = _moments(totals, grid)
        first = next((m for m in tried if met(m)), None)
        if first is None:
            low = grid[-1]
        else:
            best, high = first, first["a"]
            low = ([low, *grid])[grid.index(first["a"])]
    return best


def _prefix(df: DataFrame, keys: list[str], order: list[str], amount: str, bucket: Column) -> DataFrame:
    """Adds `before`: the sum of `amount` over earlier rows of the same keys. `bucket` must
    not decrease along the order; sums over buckets come first, then sums inside each."""
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(*keys, "_b").agg(F.sum(amount).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, [*keys, "_b"]).withColumn("before", F.col("_base") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("_b", "_base")


@dataclass
class Mixture:
    """weights: a row for each source; schedule: each block of each pass that is used, with its
    place; copies: how often each block is used, and its last document where it is cut."""

    exponent: float
    budget: int
    weights: DataFrame
    schedule: DataFrame
    copies: DataFrame


def _source(source: Column) -> Column:
    """Null sources are one source of their own."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def _key(p: MixParams, *cols: Column) -> Column:
    return F.xxhash64(F.lit(p.seed), *cols)


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams | None = None) -> Mixture | None:
    """Weights, block schedule and copies of each block; None if there are no tokens."""
    p = params or MixParams()
    if (p.target_entropy is None) == (p.max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    items = cut(docs.select(_source(F.col(source_col)).alias("s"), F.col(id_col).cast("string").alias("id"), word_count(F.col(text_col)).alias("tokens")), "mix-items")
    totals = cut(items.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals")
    whole = totals.agg(F.sum("tokens")).first()[0]
    if not whole:
        return None
    totals = totals.withColumn("all", F.lit(whole).cast("long"))
    m = solve_exponent(totals, p)
    budget = p.budget
    if budget is None:
        budget = int(-(-m["all"] * m["most"] ** (1 - m["a"]) * m["z"] // 1))
    elif p.max_repeats is not None and m["a"] == 1.0 and _repeats(m, budget) > p.max_repeats:
        budget = int(m["all"] * p.max_repeats)  # the limit wins over the budget
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.lit(m["a"])) / F.lit(m["z"])).otherwise(F.lit(0.0))
    quota = F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)).cast("long")
    weights = totals.withColumn("weight", weight).withColumn("quota", quota)
    # the least source of a covering budget must not lose a token to rounding
    weights = weights.withColumn("quota", F.when(F.lit(p.budget is None), F.greatest("quota", "tokens")).otherwise(F.col("quota")))
    weights = weights.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / p.block_tokens)).cast("long"))
    weights = weights.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long"))
    weights = weights.withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))

    placed = items.join(weights.select("s", "blocks"), "s").withColumn("h", _key(p, F.col("s"), F.col("id"))).withColumn("block", F.pmod("h", "blocks"))
    blocks = placed.groupBy("s", "block").agg(F.sum("tokens").alias("size"))
    passes = blocks.join(weights.select("s", "tokens", "quota", "full", "rest"), "s").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    passes = passes.withColumn("key", _key(p, F.col("s"), F.col("epoch"), F.col("block")))
    ordered = _prefix(passes, ["s", "epoch"], ["key", "block"], "size", F.shiftright(F.col("key"), 54))
    room = F.when(F.col("epoch") < F.col("full"), F.col("size")).otherwise(F.col("rest") - F.col("before"))
    whole_block = (F.col("epoch") < F.col("full")) | ((F.col("rest") > 0) & (F.col("before") + F.col("size") <= F.col("rest")))
    ordered = ordered.withColumn("whole", whole_block).withColumn("room", room)
    ordered = ordered.withColumn("slot", (F.col("epoch") * F.col("tokens") + F.col("before")) / F.greatest(F.col("quota"), F.lit(1)))
    schedule = ordered.where(F.col("whole") | (F.col("room") > 0))
    per_block = schedule.groupBy("s", "block").agg(F.sum(F.col("whole").cast("long")).alias("passes"), F.max(F.when(~F.col("whole"), F.col("room"))).alias("room"), F.min("slot").alias("slot"))
    # the block at a quota's end is cut between documents, in keyed order; equal ids stay together
    edge = placed.join(per_block.where(F.col("room").isNotNull()).select("s", "block", "room"), ["s", "block"]).groupBy("s", "block", "room", "h", "id").agg(F.sum("tokens").alias("tokens"))
    w = Window.partitionBy("s", "block").orderBy("h", "id")
    last = edge.withColumn("upto", F.sum("tokens").over(w)).where(F.col("upto") <= F.col("room")).groupBy("s", "block").agg(F.max(F.struct("h", "id")).alias("last"))
    copies = cut(per_block.join(last, ["s", "block"], "left").select("s", "block", "passes", "slot", "last"), "mix-copies")
    return Mixture(m["a"], budget, weights, schedule, copies)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams | None = None) -> DataFrame:
    """docs with one more column, the struct `_mix` of weight, block, copies and slot.

    Every input row comes back once; `_mix.copies` says how often the mixture uses it
    (0 = not within the budget), `_mix.slot` in [0, 1) where its block first stands in the
    mixed order. Null sources form one source; null and empty texts have no tokens and ride
    with their block; repeated ids share one decision; an empty table gives no rows, and a
    table without any token gives copies 1 and weight 0.
    """
    p = params or MixParams()
    plan = plan_mixture(docs, id_col, text_col, source_col, p)
    if plan is None:
        return docs.withColumn("_mix", F.struct(F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("copies"), F.lit(0.0).alias("slot")))
    w = plan.weights.select(F.col("s").alias("_s"), F.col("blocks").alias("_n"), F.col("weight").alias("_w"))
    c = plan.copies.select(F.col("s").alias("_s"), F.col("block").alias("_k"), F.col("passes").alias("_p"), F.col("slot").alias("_t"), F.col("last").alias("_l"))
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row")
    d = docs.select(row, _source(F.col(source_col)).alias("_s"), F.col(id_col).cast("string").alias("_id"))
    d = d.join(w, "_s").withColumn("_h", _key(p, F.col("_s"), F.col("_id"))).withColumn("_k", F.pmod("_h", "_n"))
    d = d.join(c, ["_s", "_k"], "left")
    within = F.col("_l").isNotNull() & (F.struct(F.col("_h").alias("h"), F.col("_id").alias("id")) <= F.col("_l"))
    copies = F.coalesce(F.col("_p"), F.lit(0)) + F.when(within, F.lit(1)).otherwise(F.lit(0))
    return d.select("_row.*", F.struct(F.col("_w").alias("weight"), F.col("_k").alias("block"), copies.cast("long").alias("copies"), F.col("_t").alias("slot")).alias("_mix"))


def repeat_rows(marked: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture itself: each row as often as it is used, columns unchanged."""
    row = F.struct(*[F.col(f"`{x}`") for x in columns]).alias("_row")
    used = marked.where(F.col("_mix.copies") > 0)
    return used.select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies"))).alias("_i")).select("_row.*")
