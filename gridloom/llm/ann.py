"""Approximate nearest neighbours by adaptive dimension scans.

A bounded sample fits k-means centroids, a random rotation and the number of probed
lists; every row is then indexed. Each query scans its probed lists in column blocks
of the rotated vectors: after each block a hypothesis test on the partial distance
abandons candidates that are unlikely to reach the query's current k-th distance.
What survives is scored exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import cut


@dataclass(frozen=True)
class AnnParams:
    """Lists hold rows_per_list rows, or the square root of all rows where that is more. The
    fitting sample has list_sample rows for each list, least_fit at least and fit_rows at most
    (the bound on the driver, which also bounds the lists). chunk_rows and query_block bound
    one task's rows."""

    k: int = 5
    least_fit: int = 8192
    fit_rows: int = 262_144
    list_sample: int = 32
    rows_per_list: int = 160
    column_block: int = 16
    epsilon: float = 2.1
    recall_goal: float = 0.97
    chunk_rows: int = 4096
    query_block: int = 4096
    scan_rows: int = 512
    seed: int = 7


@dataclass
class Index:
    """What is broadcast: the centroids, a rotation and sample vectors for first bounds."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    seeds: np.ndarray
    seed_ids: list


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def nearest(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row of c with the largest product for each row of u, in slices of bounded memory."""
    step = max(1, (1 << 22) // len(c))
    return np.concatenate([np.argmax(u[i : i + step] @ c.T, axis=1) for i in range(0, len(u), step)] or [np.zeros(0, np.int64)])


def _means(u: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids of spherical k-means over unit rows, k <= len(u)."""
    c = u[rng.choice(len(u), k, replace=False)].copy()
    for _ in range(10):
        near = nearest(u, c)
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        total = np.add.reduceat(u[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[held] = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c[held])
    return c


def centroids(u: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """About `lists` centroids in two levels: those of a coarse clustering are split by their
    shares of the sample, so fitting costs the sample times the root of the lists."""
    if lists <= 256:
        return _means(u, lists, rng)
    near = nearest(u, rough := _means(u, int(np.sqrt(lists)), rng))
    parts = []
    for g in range(len(rough)):
        own = u[near == g]
        if len(own):
            parts.append(_means(own, min(len(own), max(1, round(lists * len(own) / len(u)))), rng))
    return np.concatenate(parts)


def sample_rows(rows: int, p: AnnParams) -> int:
    """Size of the fitting sample of a table of so many distinct vectors."""
    return int(min(p.fit_rows, max(p.least_fit, p.list_sample * list_count(rows, p))))


def list_count(rows: int, p: AnnParams) -> int:
    return max(1, int(rows // max(p.rows_per_list, np.sqrt(rows))))


def fit(ids: list, sample: np.ndarray, rows: int, p: AnnParams) -> Index:
    """Spherical k-means on the sample, and the fewest probes that reach the recall goal
    on the sample's own exact neighbours (which lie farther apart than in the full set)."""
    rng = np.random.default_rng(p.seed)
    u = _unit(sample)
    c = centroids(u, min(list_count(rows, p), max(1, len(u) // p.list_sample)), rng)
    lists = len(c)
    near = nearest(u, c)
    asks = rng.choice(len(u), min(len(u), 400), replace=False)
    best = np.zeros((len(asks), min(p.k, len(u) - 1)), int)
    for i in range(0, len(asks), 16) if len(u) > 1 else ():  # few rows of the sample's size at once
        some = asks[i : i + 16]
        sims = u[some] @ u.T
        sims[np.arange(len(some)), some] = -9
        best[i : i + 16] = np.argpartition(-sims, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
    order = np.argsort(-(u[asks] @ c.T), axis=1)
    rank = np.argsort(order, axis=1)
    probes = lists
    if best.size:
        needed = np.sort(rank[np.arange(len(asks))[:, None], near[best]].ravel())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(p.recall_goal * len(needed))) - 1)]) + 1
    q, r = np.linalg.qr(rng.standard_normal((u.shape[1], u.shape[1])))
    seeds = rng.choice(len(u), min(len(u), 1024), replace=False)
    return Index(c, q * np.sign(np.diag(r)), min(lists, probes), sample[seeds], [list(ids[i]) for i in seeds])


def scan(query: np.ndarray, bound: np.ndarray, cand: np.ndarray, rotation: np.ndarray, p: AnnParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that survive the adaptive scan of one list chunk.

    bound: squared distance that a candidate of each query must not clearly exceed. A
    candidate is abandoned after d of D rotated dimensions if its partial squared
    distance times D/d is over bound * (1 + epsilon / sqrt(d))**2.
    """
    q, x = _unit(query) @ rotation, _unit(cand) @ rotation
    dims = x.shape[1]
    cuts = list(range(0, dims, p.column_block)) + [dims]
    rows, cols, part = None, None, None
    for a, b in zip(cuts[:-1], cuts[1:]):
        qa, xa = q[:, a:b], x[:, a:b]
        if rows is None:
            step = (qa**2).sum(1)[:, None] + (xa**2).sum(1)[None, :] - 2 * qa @ xa.T
            limit = bound * (b / dims) * (1 + p.epsilon / np.sqrt(b)) ** 2 if b < dims else bound
            rows, cols = np.nonzero(step <= (limit + 1e-9)[:, None])
            part = step[rows, cols]
        else:
            part = part + ((qa[rows] - xa[cols]) ** 2).sum(1)
            limit = bound[rows] * (b / dims) * (1 + p.epsilon / np.sqrt(b)) ** 2 if b < dims else bound[rows]
            keep = part <= limit + 1e-9
            rows, cols, part = rows[keep], cols[keep], part[keep]
    return rows, cols


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; the same vectors always give the same value."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>): no null id, vector or component, all finite, not all zero."""
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    )


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_mod: int = 50, params: AnnParams | None = None) -> DataFrame:
    """The k nearest rows by cosine of every row whose id is divisible by query_mod.

    Returns query_id, rank (from 1), vec_id, score. Null, zero and non-finite vectors take
    no part, nor do vectors whose length is not the most frequent one. Equal vectors are
    indexed once with the k+1 smallest of their ids: ties go to the smaller id, so no other
    id of theirs can be among a query's k nearest. Fewer than k other rows: all of them.
    Empty table: no rows. A repeated id counts once per distinct vector.
    """
    p = params or AnnParams()
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size["d"])
    # a vector may be that of a third of all rows: only its k+1 least ids leave each of 64 parts
    part = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    least = rows.withColumn("r", F.dense_rank().over(part)).where(F.col("r") <= p.k + 1)
    unique = cut(least.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, p.k + 1).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"), "vectors")

    n = unique.count()
    picked = unique.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows(n, p)).select("ids", "v").toPandas()
    index = spark.sparkContext.broadcast(fit(picked["ids"].tolist(), _matrix(picked["v"]), n, p))

    def assign(batches):
        ix = index.value
        for pdf in batches:
            if len(pdf):
                pdf["list"] = nearest(_unit(_matrix(pdf["v"])), ix.centroids).astype(np.int32)
                yield pdf

    placed = cut(unique.mapInPandas(assign, "rep long, ids array<long>, v array<double>, list int"), "lists")
    # a list's rows are dealt over chunks, its queries over blocks: no task holds a whole hot list
    counts = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = spark.createDataFrame([(int(k), int(-(-c // p.chunk_rows))) for k, c in counts.items()], "list int, chunks int")
    asks = rows.where(F.col("vec_id") % query_mod == 0).groupBy("v").agg(F.min("vec_id").alias("ask"))

    def probe(batches):
        ix = index.value
        size_of = np.array([counts.get(i, 0) for i in range(len(ix.centroids))])
        seeds = _unit(ix.seeds)
        for pdf in (b.iloc[i : i + p.scan_rows] for b in batches for i in range(0, len(b), p.scan_rows)):
            u = _unit(_matrix(pdf["v"]))
            order = np.argsort(-(u @ ix.centroids.T), axis=1, kind="stable")
            # more lists where the nearest ones hold too few rows to fill k places
            enough = (np.cumsum(size_of[order], axis=1) < 4 * (p.k + 1)).sum(1) + 1
            take = np.minimum(np.maximum(ix.probes, enough), order.shape[1])
            sims = u @ seeds.T
            kth = np.full(len(u), -1.0)
            if sims.shape[1] > p.k:  # one of the k+1 may be the query itself
                kth = -np.partition(-sims, p.k, axis=1)[:, p.k]
            yield pd.DataFrame({"ask": pdf["ask"].to_numpy(), "v": pdf["v"].to_numpy(), "bound": 2 - 2 * kth, "list": [order[i, : take[i]].astype(np.int32) for i in range(len(u))]})

    probed = asks.mapInPandas(probe, "ask long, v array<double>, bound double, list array<int>").select("ask", "v", "bound", F.explode("list").alias("list"))
    per_list = probed.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    layout = per_list.join(F.broadcast(chunks), "list").select("list", "chunks", F.ceil(F.col("m") / p.query_block).cast("int").alias("blocks"))
    layout = F.broadcast(cut(layout, "layout"))  # one row a list, fit_rows / list_sample at most
    left = placed.join(layout, "list").select("list", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "ids", "v")
    right = probed.join(layout, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("ask"), "blocks").cast("int").alias("block"), "ask", "bound", F.col("v").alias("q"))

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"ask": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return none
        a = a.sort_values("rep")
        x, q = _matrix(a["v"]), _matrix(b["q"])
        bound, found = b["bound"].to_numpy(), []
        for i in range(0, len(q), p.scan_rows):
            own = slice(i, i + p.scan_rows)
            r, c = scan(q[own], bound[own], x, index.value.rotation, p)
            found.append((r + i, c, exact_cosine(q[r + i], x[c])))
        r, c, score = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((c, -score, r))
        r, c, score = r[order], c[order], score[order]
        first = np.searchsorted(r, np.arange(len(q)))
        keep = np.arange(len(r)) - first[r] < p.k + 1 if len(r) else np.zeros(0, bool)
        ask, ids = b["ask"].to_numpy(), a["ids"].to_numpy()
        return pd.DataFrame({"ask": ask[r[keep]], "ids": [list(ids[i]) for i in c[keep]], "score": score[keep]})

    def nearby(batches):
        ix = index.value
        seeds = _unit(ix.seeds)
        for pdf in batches:
            if not len(pdf):
                continue
            q = _matrix(pdf["v"])
            near = np.argsort(-(_unit(q) @ seeds.T), axis=1, kind="stable")[:, : p.k + 1]
            r, c = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
            yield pd.DataFrame({"ask": pdf["ask"].to_numpy()[r], "ids": [ix.seed_ids[i] for i in c], "score": exact_cosine(q[r], ix.seeds[c])})

    found = left.groupBy("list", "chunk", "block").cogroup(right.groupBy("list", "chunk", "block")).applyInPandas(pairs, "ask long, ids array<long>, score double")
    # bounds come from sample vectors, which may lie in lists that aren't probed: they count too
    found = found.union(asks.mapInPandas(nearby, "ask long, ids array<long>, score double")).groupBy("ask", "ids").agg(F.max("score").alias("score"))
    # each distinct query vector was searched once; its ids share what was found
    ranked = Window.partitionBy("ask").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= p.k + 1)
    best = best.select("ask", "score", F.explode("ids").alias("vec_id"))
    again = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("n", F.row_number().over(again)).where(F.col("n") <= p.k + 1).groupBy("ask").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))).alias("best"))
    asked = rows.where(F.col("vec_id") % query_mod == 0).select(F.col("vec_id").alias("query_id"), "v").distinct().join(asks, "v").select("query_id", "ask")
    hits = asked.join(best, "ask").select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, p.k)).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))


def brute_force(ids: list, vectors: list, query_mod: int = 50, k: int = 5) -> list[tuple]:
    """All pairs, for tests: (query_id, rank, vec_id, score)."""
    good = [(i, np.asarray(v, float)) for i, v in zip(ids, vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for i, v in good:
        if i % query_mod == 0:
            s = sorted((-float(exact_cosine(v[None], w[None])[0]), j) for j, w in good if j != i)
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out
