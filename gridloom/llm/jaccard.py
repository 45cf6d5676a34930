"""N-gram Jaccard join: a grouped prefix join with exact verification.

Shingles are ordered from rare to frequent (by a sketch of document frequencies over all
rows). Two sets that reach the threshold share a shingle within their short prefixes, so
only prefixes meet in the join. Equal sets are one node; nodes with the same prefix and
size form a group; group pairs pass a length and a position filter, are expanded to their
members, and members that pass a parity filter are verified on full sets. Since only
components are asked for, verification goes in two rounds: in the first, each prefix
shingle's groups of about one size meet one of them, and what links is contracted; the second
takes all pairs that no component holds yet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import arrow, cut, drop, mix, pieces
from gridloom.llm.components import components
from gridloom.llm.shingles import fingerprint, shingle_sets

_NO_ID = (1 << 63) - 1
_PARITY = ["q0", "q1", "q2", "q3"]
_FIRST = ["f0", "f1", "f2", "f3"]


@dataclass(frozen=True)
class JaccardParams:
    """Link where up * intersection >= low * union, e.g. 100 and 90 for 0.9. sketch_bits
    fixes the size of the frequency sketch (and of what is broadcast: a byte a bucket)."""

    size: int = 3
    up: int = 100
    low: int = 90
    sketch_bits: int = 18
    cells: int = 128


def frequency_classes(docs: DataFrame, text_col: str, p: JaccardParams) -> np.ndarray:
    """For each bucket of shingle hashes, 0 or the power of two by which its document
    frequency exceeds the usual bucket's. Counted over all rows."""
    n = 1 << p.sketch_bits
    shift = np.uint64(64 - p.sketch_bits)

    def count(batches):
        df = np.zeros(n, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                rows = [x for x in shingle_sets(piece, p.size) if len(x)]
                if rows:
                    df += np.bincount((np.concatenate(rows) >> shift).astype(np.int64), minlength=n)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(df[hit])], ["bucket", "n"])

    got = arrow(docs.select(F.col(text_col).cast("string")), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n)
    df[got["bucket"].to_numpy()] = got["n"].to_numpy()
    usual = max(1.0, float(np.median(df)) + 4 * float(np.sqrt(max(1.0, np.median(df)))))
    return np.clip(np.floor(np.log2(np.maximum(df, 1) / usual)) + 1, 0, 60).astype(np.uint8)


def prefix_length(n: int, p: JaccardParams) -> int:
    """Shingles of a set of n that must meet another set's prefix if the two link."""
    return n - -(-p.low * n // p.up) + 1


def measured(docs: DataFrame, id_col: str, text_col: str, p: JaccardParams) -> DataFrame:
    """(id, n, a, b, prefix, spread, q0..q3): set size, fingerprint, prefix in the order of
    frequency, how many shingles fall in each of a fixed number of cells, and 256 parities:
    sets differ in as many shingles at least as in parities."""
    ranks = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text_col, p))
    shift = np.uint64(64 - p.sketch_bits)

    def measure(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                n, a, b, prefix, spread, parity = [], [], [], [], [], []
                for x in shingle_sets(piece, p.size):
                    n.append(len(x))
                    f = fingerprint(x)
                    a.append(f[0])
                    b.append(f[1])
                    keep = prefix_length(len(x), p) if len(x) else 0
                    order = np.argsort(ranks.value[(x >> shift).astype(np.int64)], kind="stable")[:keep]
                    prefix.append(x[order].astype(np.int64))
                    spread.append(np.bincount((x % np.uint64(p.cells)).astype(np.int64), minlength=p.cells).astype(np.int32) if keep else None)
                    odd = np.bincount((mix(x) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                quarters = np.array(parity, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(spread, pa.list_(pa.int32())), *[pa.array(quarters[:, k].copy()) for k in range(4)]], ["id", "n", "a", "b", "prefix", "spread", *_PARITY])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.col(text_col).cast("string"))
    return arrow(rows, measure, "id long, n long, a long, b long, prefix array<long>, spread array<int>, q0 long, q1 long, q2 long, q3 long")


def _apart(x: str, y: str) -> Column:
    """In how many parities two sets differ."""
    return sum((F.bit_count(F.col(f"{x}.{q}").bitwiseXOR(F.col(f"{y}.{q}"))) for q in _PARITY), F.lit(0))


def _near(x: str, y: str, p: JaccardParams, slack: Column | None = None) -> Column:
    """The parity filter, which holds for two sets only: members of a group differ in most
    shingles. slack: by how much sets that x and y stand for may be nearer than x and y."""
    apart = _apart(x, y) if slack is None else _apart(x, y) - slack
    return apart * (p.up + p.low) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (p.up - p.low)


def _may_link(x: str, y: str, p: JaccardParams) -> Column:
    """What linked pairs pass, and so what pairs of groups pass that hold any: the length
    filter; and, at the first shingle that both prefixes hold, the position filter (x.pos and
    y.pos are its places)."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    fits = F.least(n, m) * p.up >= F.greatest(n, m) * p.low
    return fits & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) * (p.up + p.low) >= (n + m) * p.low)


def _first_meeting(x: str, y: str) -> Column:
    """False where the prefixes share a shingle before this one among their first few: the
    pair was met there. Shingles stand in one order everywhere, so the first of x's few that is
    among y's few is the first that the sets share at all."""
    met = F.lit(None).cast("long")
    for f in reversed(_FIRST):
        here = F.col(f"{x}.{f}")
        met = F.when(here.isin(*[F.col(f"{y}.{g}") for g in _FIRST]), here).otherwise(met)
    return F.coalesce(met, F.col(f"{x}.token")) == F.col(f"{x}.token")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, p: JaccardParams) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose full sets link, written out.

    The sum of the lesser counts over all cells bounds an intersection from above, so pairs
    below the need go before any full set is read. nodes: (node, id, n, spread).
    """
    spread = nodes.select("node", "n", "spread")
    both = pairs.join(spread.toDF("u", "nu", "su"), "u").join(spread.toDF("v", "nv", "sv"), "v")
    most = F.aggregate(F.zip_with("su", "sv", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    likely = cut(both.where(most * (p.up + p.low) >= (F.col("nu") + F.col("nv")) * p.low).select("u", "v"), "likely")
    wanted = likely.select(F.col("u").alias("node")).union(likely.select(F.col("v").alias("node"))).distinct()
    wanted = cut(nodes.select("node", "id").join(wanted, "node", "left_semi"), "wanted")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted.select("id").distinct(), "id", "left_semi")

    def full(batches):
        for batch in batches:
            for piece in pieces(batch.column(0)):
                sets = shingle_sets(piece, p.size)
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x)[0] for x in sets], pa.int64()), pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "items"])

    sets = arrow(rows.select("text"), full, "node long, items array<long>").join(wanted.select("node"), "node", "left_semi")
    sets = cut(sets.dropDuplicates(["node"]), "sets")
    both = likely.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    shared = F.size(F.array_intersect("x", "y"))
    links = cut(both.where(shared * p.up >= (F.size("x") + F.size("y") - shared) * p.low).select("u", "v"), "links")
    drop(likely, wanted, sets)
    return links


def _placed(member: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component that links known so far put them in."""
    if labels is None:
        return member.withColumn("comp", F.col("node"))
    return member.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


_UNIT = ["g", "comp", "rep", "away", *_PARITY, "n", *_FIRST]


def _open(units: DataFrame, lists: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, low being the least: each group's
    shingles, for each component that it has members of. Groups with several count as lists
    themselves, at place 0."""
    several = units.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    inside = units.join(several.select("g"), "g").select(F.col("g").alias("token"), F.lit(0).alias("pos"), F.lit(True).alias("inner"), *_UNIT)
    entries = lists.select("token", "g", "pos").join(units, "g").select("token", "pos", F.lit(False).alias("inner"), *_UNIT).union(inside)
    mixed = entries.groupBy("token", "inner").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    return entries.join(mixed.select("token", "inner", "low"), ["token", "inner"])


def _star(entries: DataFrame, p: JaccardParams) -> DataFrame:
    """(u, v): in each list, entries of about one size against one of them, the one with the
    fewest shingles before the list's own: what copies have been made of has no rare ones of
    its own. Of two components that meet so, the pair that differs least. Each entry stands in
    two size bands, half a band apart, so that sizes which may link share one."""
    step = float(2 * np.log(p.up / p.low))
    size = F.log("n") / step
    bands = F.array(2 * F.floor(size), 2 * F.floor(size + 0.5) + 1)
    banded = entries.select("token", "inner", F.explode(bands).alias("band"), F.struct("pos", F.xxhash64("comp").alias("h"), "comp", "rep", "n", *_PARITY).alias("y"))
    keys = ["token", "inner", "band"]
    met = banded.join(banded.groupBy(*keys).agg(F.min("y").alias("x")), keys)
    met = met.where((F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", p) & _near("x", "y", p))
    apart = (_apart("x", "y") / (F.col("x.n") + F.col("y.n"))).alias("apart")
    best = met.groupBy(F.least("x.comp", "y.comp"), F.greatest("x.comp", "y.comp")).agg(F.min(F.struct(apart, F.col("x.rep").alias("u"), F.col("y.rep").alias("v"))).alias("m"))
    return best.select("m.u", "m.v")


def _rest(entries: DataFrame, placed: DataFrame, p: JaccardParams) -> DataFrame:
    """(u, v): every pair of members that may link and that no component holds yet."""
    # a pair is met from the side outside a list's least component, so that a large component
    # that fills a list isn't paired with itself
    x, y = entries.where("comp != low").alias("x"), entries.alias("y")
    once = (F.col("y.comp") == F.col("y.low")) | (F.col("x.comp") < F.col("y.comp"))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.inner") == F.col("y.inner")) & (F.col("x.comp") != F.col("y.comp")) & once
    met = x.join(y, same & (F.col("x.inner") | _first_meeting("x", "y")) & _may_link("x", "y", p) & _near("x", "y", p, F.col("x.away") + F.col("y.away")))
    met = met.select(*[F.col(f"{t}.{c}").alias(f"{c}{t}") for t in "xy" for c in ("g", "comp")]).distinct()
    one, two = placed.alias("one"), placed.alias("two")
    pairs = met.join(one, (F.col("gx") == F.col("one.g")) & (F.col("compx") == F.col("one.comp"))).join(two, (F.col("gy") == F.col("two.g")) & (F.col("compy") == F.col("two.comp")))
    return pairs.where(_near("one", "two", p)).select(F.col("one.node").alias("u"), F.col("two.node").alias("v")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JaccardParams | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    component_id: the smallest id reachable by links, its own included. Null and empty texts
    have no shingles and link with nothing. Rows of equal text are linked; rows that repeat an
    id share its component only if their texts link. Null ids stay null unless linked with a
    row that has one. An empty table gives no rows; other columns, whatever their names, play
    no part. No link between different texts is lost: every pair that the filters pass is
    verified or already within one component. Sets are told apart by 128-bit fingerprints,
    nodes of the join by 64 of these bits.
    """
    p = params or JaccardParams()
    base = cut(measured(docs, id_col, text_col, p), "measured")
    sizes = cut(base.select("id", "n", "a", "b"), "sizes")
    sets = cut(sizes.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("id")), "nodes")
    # sets under ten shingles link (at 0.9) with equal ones only
    least = next(n for n in range(1, 1 << 20) if p.up * n >= p.low * (n + 1))
    nodes = base.where(F.col("n") >= least).join(sets, ["n", "a", "b", "id"], "left_semi").dropDuplicates(["a"])
    nodes = cut(nodes.select(F.col("a").alias("node"), "id", "n", "prefix", "spread", *_PARITY, F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2")), "prefixes")
    drop(base)
    member = nodes.select("node", "n", "p1", "p2", *_PARITY).join(nodes.groupBy("n", "p1", "p2").agg(F.min("node").alias("g")), ["n", "p1", "p2"])
    member = cut(member.select("node", "g", "n", *_PARITY), "members")
    leads = nodes.join(member.where("node = g").select("node"), "node", "left_semi")
    # what filters need of a group: size and the first shingles of its prefix, which all of its
    # members have, and its lead's parities, which no other member need have
    facts = leads.select(F.col("node").alias("g"), "n", *_PARITY, *[F.get("prefix", F.lit(k)).alias(f) for k, f in enumerate(_FIRST)])
    facts = cut(facts, "facts")
    lists = leads.select(F.col("node").alias("g"), F.posexplode("prefix").alias("pos", "token"))
    shared = lists.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low != high").select("token")
    lists = cut(lists.join(shared, "token"), "lists")

    # one round of few pairs, whose links are contracted; then every pair of members that no
    # component holds yet. A unit is what a group has of one component: it has the parities of
    # its rep, and `away` is how far any other member that it stands for is
    labels = None
    for last in (False, True):
        placed = cut(_placed(member, labels), "placed") if last else _placed(member, labels)
        units = placed.groupBy("g", "comp").agg(F.min(F.struct(F.col("node").alias("rep"), *_PARITY)).alias("r")).select("g", "comp", "r.*")
        if last:
            apart = placed.alias("x").join(units.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.comp") == F.col("y.comp")))
            units = units.join(apart.groupBy("y.g", "y.comp").agg(F.max(_apart("x", "y")).alias("away")), ["g", "comp"])
        else:
            units = units.withColumn("away", F.lit(0))  # only reps are paired
        # a table, as lists of entries read it several times: the driver's plans stay small
        units = cut(units.join(facts.drop(*_PARITY), "g").select(*_UNIT), "units")
        entries = cut(_open(units, lists), "entries")
        drop(units)
        pairs = cut(_rest(entries, placed, p) if last else _star(entries, p), "pairs")
        drop(entries, *[placed, member, facts, lists] * last)
        links = verified(pairs, nodes, docs, id_col, text_col, p)
        drop(pairs)
        known = links
        if last:
            known = links.union(labels.select(F.col("node").alias("u"), F.col("comp").alias("v")))
        labels = components(known)
        drop(links)
    drop(nodes)

    found = sets.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    smallest = found.groupBy("comp").agg(F.min("id").alias("c"))
    found = cut(found.join(smallest, "comp").select("n", "a", "b", "c"), "components")
    drop(sets)
    out = sizes.join(found, ["n", "a", "b"], "left")
    real = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return out.select(real("id").alias("id"), F.col("n").alias("n_shingles"), F.coalesce(real("c"), real("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JaccardParams | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, but one of each component: that of the
    smallest id. Rows without shingles stay. Ids that repeat or are null are told apart."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("m")).first()
    if ids["n"] == ids["m"]:
        found = jaccard_components(docs, id_col, text_col, params)
        gone = found.where("id != component_id").select(F.col("id").alias("_gone"))
        return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    numbered = cut(docs.select(row, F.monotonically_increasing_id().alias("_k")), "numbered")
    found = jaccard_components(numbered.select(F.col("_k").alias("id"), F.col("_row").getField(text_col).alias("text")), "id", "text", params)
    gone = found.where("id != component_id").select(F.col("id").alias("_k"))
    return numbered.join(gone, "_k", "left_anti").select("_row.*")


def brute_force(rows: list[tuple], size: int = 3, up: int = 100, low: int = 90) -> list[tuple]:
    """All pairs, for tests: (id, n_shingles, component_id)."""
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and up * len(sets[i] & sets[j]) >= low * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp: dict[int, int] = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        comp[r] = min(comp.get(r, k), k)
    return [(k, len(sets[i]), comp[find(i)]) for i, (k, _) in enumerate(rows)]
