"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels mark whole documents, so tokens are labelled first: a token of a toxic document is
toxic if one of its features (the word, or a beginning of it) is far more frequent in toxic
than in other labelled documents. The chain's emission weights and transitions are then
fitted to these tokens by gradient steps on the conditional likelihood. Forward-backward
gives each token's marginal; a document's score is a calibrated function of their sum and
maximum, and tokens over one half are its offending spans.

Most tokens carry no known feature. The chain's steps over a run of such tokens are powers
of one 2 x 2 matrix, taken in closed form, so a document costs as many steps as it has
tokens with features, and whole texts of any length are scored exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import Piece, Powers, arrow, code_points, cut, drop, letter_table, mix, pieces, trim


@dataclass(frozen=True)
class ToxicParams:
    """toxic_rows and clean_rows bound the fitting sample of labelled rows, whose texts are used
    whole; a quarter of it calibrates the score. Of the rest, chain_rows of each class fit the
    chain, and no further ones once these hold chain_tokens tokens; they are taken in segments
    of so many tokens. threshold: predicted is 1 from this score on."""

    toxic_rows: int = 600
    clean_rows: int = 1000
    chain_rows: int = 250
    chain_tokens: int = 500_000
    segment: int = 512
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    least_evidence: float = 22.0
    least_ratio: float = 6.0
    steps: int = 60
    l2: float = 0.02
    threshold: float = 0.3
    seed: int = 5


@dataclass
class Words:
    """Runs of letters of a piece: begin and end in code points, first word of each row, and
    the feature hashes: whole word first, then prefixes (0 where the word is shorter)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: list[np.ndarray]
    at: np.ndarray


_POWERS = Powers(0xA24BAED4963EE407)


def words_of(piece: Piece, prefixes: tuple[int, ...]) -> Words:
    codes, at = code_points(piece)
    norm = letter_table()[codes] if len(codes) else codes
    inside = norm > 0
    n = len(norm)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(piece) + 1, np.int64), [z.astype(np.uint64)] * (1 + len(prefixes)), at)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < n]
    begin[edge] = inside[edge]
    last = at[1:][at[1:] > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    _POWERS.need(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(norm.astype(np.uint64)) * _POWERS.up[:n], out=sums[1:])
    scale = _POWERS.down[s]
    out = [mix((sums[e] - sums[s]) * scale + np.uint64(1000))]
    for k in prefixes:
        t = np.minimum(s + k, e)
        out.append(np.where(e - s >= k, mix((sums[t] - sums[s]) * scale + np.uint64(k)), np.uint64(0)))
    return Words(s, e, np.searchsorted(s, at), out, at)


@dataclass
class Lexicon:
    """Known features, ascending, and a bit table that lets most others go at once."""

    keys: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature) for each known hash."""
        hit = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 18) - 1)).view(np.int64)])
        if not len(hit) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
        ok = self.keys[at] == hashes[hit]
        return hit[ok], at[ok]


class Chain:
    """Two labels. Potentials: emission of label 1 (bias + feature weights), transitions t."""

    def __init__(self, features: int):
        self.w = np.zeros(features)
        self.bias = -2.0
        self.t = np.array([[0.5, -0.5], [-0.5, 0.5]])

    def powers(self, gaps: np.ndarray) -> np.ndarray:
        """Normalised G**gap for each gap, where G steps over a token without features."""
        g = np.exp(self.t) * np.array([1.0, np.exp(self.bias)])[None, :]
        a, b, c, d = g.ravel()
        root = np.sqrt((a - d) ** 2 + 4 * b * c)
        one, two = (a + d + root) / 2, (a + d - root) / 2
        p = (g - two * np.eye(2)) / (one - two)
        q = np.eye(2) - p
        return p[None] + (two / one) ** gaps[:, None, None] * q[None]

    def marginals(self, row: np.ndarray, token: np.ndarray, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(label 1) at each token with features. row and token ascend; token counts within
        its row; score is its emission; sizes is each row's number of tokens."""
        n = len(row)
        if not n:
            return np.zeros(0)
        new = np.append(True, row[1:] != row[:-1])
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        gap = np.where(new, token, token - np.append(0, token[:-1]) - 1)
        step = self.powers(gap.astype(float))
        t = np.exp(self.t)
        emit = np.stack([np.zeros(n), score], axis=1)
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        # from a row's start, a gap of g tokens: first token without transition, then g-1 steps
        init = np.array([1.0, np.exp(self.bias)])
        alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
        head = first[gap[first] > 0]
        alpha[first] = 1.0
        if len(head):
            alpha[head] = (init[None, None] @ self.powers(gap[head] - 1.0))[:, 0] @ t
        alpha[first] *= emit[first]
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(place.max() + 2))
        for k in range(len(bounds) - 1):
            i = order[bounds[k] : bounds[k + 1]]
            if k:
                alpha[i] = np.einsum("ni,nij->nj", alpha[i - 1], step[i]) @ t * emit[i]
            alpha[i] /= alpha[i].sum(axis=1, keepdims=True)
        last = np.append(first[1:], n) - 1
        rest = (sizes[row[last]] - 1 - token[last]).astype(float)
        beta[last] = self.powers(rest).sum(axis=2)
        for k in range(len(bounds) - 2, -1, -1):
            i = order[bounds[k] : bounds[k + 1]]
            j = i[(i + 1 < n)]
            j = j[~new[j + 1]]
            if len(j):
                beta[j] = np.einsum("nij,nj->ni", step[j + 1], (emit[j + 1] * beta[j + 1]) @ t.T)
            beta[i] /= beta[i].sum(axis=1, keepdims=True)
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1)


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], features: int, p: ToxicParams) -> Chain:
    """Gradient ascent (with per-parameter steps) on the conditional likelihood.
    rows: (token of each feature, feature, label of each token)."""
    chain = Chain(features)
    if not rows:
        return chain
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i][2]))
    sizes = np.array([len(rows[i][2]) for i in order])
    m, longest = len(order), int(sizes[0])
    y = np.zeros((longest, m), np.int8)
    lane, tok, feat = [], [], []
    for k, i in enumerate(order):
        t, f, lab = rows[i]
        y[: len(lab), k] = lab
        tok.append(t)
        feat.append(f)
        lane.append(np.full(len(t), k))
    tok, feat, lane = (np.concatenate(x).astype(np.int64) for x in (tok, feat, lane))
    live = np.searchsorted(-sizes, -np.arange(longest), "left")
    inside = np.arange(longest)[:, None] < sizes[None, :]
    seen_t = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen_t[a, b] = ((y[:-1] == a) & (y[1:] == b) & inside[1:]).sum()
    seen_b = float(y.sum())
    seen_w = np.bincount(feat, weights=y[tok, lane], minlength=features)
    total = float(sizes.sum())
    theta = np.concatenate([chain.w, [chain.bias], chain.t.ravel()])
    rate, before = np.full(len(theta), 0.3), np.zeros(len(theta))
    for _ in range(p.steps):
        w, bias, t = theta[:features], theta[features], theta[features + 1 :].reshape(2, 2)
        s = np.full((longest, m), bias)
        np.add.at(s, (tok, lane), w[feat])
        e1 = np.exp(np.clip(s, -30, 30))
        et = np.exp(t)
        al = np.zeros((longest, m, 2))
        be = np.ones((longest, m, 2))
        z = np.zeros((longest, m))
        for i in range(longest):
            k = live[i]
            x = np.ones((k, 2)) if not i else al[i - 1, :k] @ et
            x[:, 1] *= e1[i, :k]
            z[i, :k] = x.sum(axis=1)
            al[i, :k] = x / z[i, :k, None]
        pair = np.zeros((2, 2))
        for i in range(longest - 2, -1, -1):
            k = live[i + 1]
            nx = be[i + 1, :k].copy()
            nx[:, 1] *= e1[i + 1, :k]
            nx /= z[i + 1, :k, None]
            be[i, :k] = nx @ et.T
            pair += (al[i, :k].T @ nx) * et
        mean = al[..., 1] * be[..., 1] / np.maximum((al * be).sum(axis=2), 1e-300)
        mean[~inside] = 0
        grad = np.concatenate([seen_w - np.bincount(feat, weights=mean[tok, lane], minlength=features) - p.l2 * w, [seen_b - mean.sum()], (seen_t - pair - 0.1 * t).ravel()])
        same = grad * before
        rate = np.clip(np.where(same > 0, rate * 1.3, np.where(same < 0, rate * 0.5, rate)), 1e-4, 1.0)
        theta = theta + np.sign(grad) * rate * (np.abs(grad) > 1e-6 * total / 1e3)
        theta = np.clip(theta, -12, 12)
        before = np.where(same < 0, 0, grad)
    chain.w, chain.bias, chain.t = theta[:features], float(theta[features]), theta[features + 1 :].reshape(2, 2)
    return chain


def _summary(row: np.ndarray, marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the score is made of: for each row 1, log of the expected toxic tokens, the
    largest marginal, and log of expected tokens in a thousand."""
    total = np.bincount(row, weights=marginal, minlength=len(sizes))
    top = np.zeros(len(sizes))
    np.maximum.at(top, row, marginal)
    return np.stack([np.ones(len(sizes)), np.log1p(total), top, np.log1p(1000 * total / np.maximum(sizes, 20))], axis=1)


@dataclass
class ToxicModel:
    lexicon: Lexicon
    chain: Chain
    weights: np.ndarray
    params: ToxicParams

    def tag(self, piece: Piece) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """The piece's words, and (row, word in the piece, marginal) of tokens with features."""
        words = words_of(piece, self.params.prefixes)
        n = len(words.start)
        score = np.full(n, self.chain.bias)
        known = np.zeros(n, bool)
        for h in words.hashes:
            t, f = self.lexicon.find(h)
            score[t] += self.chain.w[f]
            known[t] = True
        i = np.flatnonzero(known)
        row = np.searchsorted(words.first, i, "right") - 1
        m = self.chain.marginals(row, i - words.first[row], score[i], np.diff(words.first))
        return words, row, i, m

    def scores(self, piece: Piece) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
        words, row, i, m = self.tag(piece)
        z = _summary(row, m, np.diff(words.first)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -35, 35))), words, row, i, m


def choose_features(table: DataFrame, n1: int, n0: int, p: ToxicParams) -> np.ndarray:
    """Features whose documents are toxic far more often than others, by log-likelihood ratio.
    table: (y, hashes) of n1 toxic and n0 other documents; a feature counts once in each."""
    one, zero = F.col("ones"), F.col("zeros")
    a, b = float(max(1, n1)), float(max(1, n0))
    n = one + zero
    g = 2 * (one * F.log(one / (n * a / (a + b))) + F.when(zero > 0, zero * F.log(zero / (n * b / (a + b)))).otherwise(0.0))
    floor = min(p.least_evidence, 6 + 0.02 * a * 10)
    found = table.select("y", F.explode(F.array_distinct("hashes")).alias("key")).where("key != 0")
    found = found.groupBy("key").agg(F.sum(F.col("y").cast("double")).alias("ones"), F.sum(1.0 - F.col("y")).alias("zeros"))
    # a feature of clean documents alone is of no use
    found = found.where((one > 0) & (g >= floor) & (one / a / ((zero + 0.5) / b) >= p.least_ratio))
    return np.sort(found.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))


@dataclass
class Marked:
    """A document of the sample: its label, weight, number of tokens, and the tokens with
    chosen features (token of each feature, feature)."""

    toxic: int
    weight: float
    tokens: int
    token: np.ndarray
    feature: np.ndarray


def _segments(doc: Marked, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A document as rows of fit_chain; its tokens with features are toxic if it is."""
    out = []
    for lo in range(0, doc.tokens, size):
        own = (doc.token >= lo) & (doc.token < lo + size)
        lab = np.zeros(min(size, doc.tokens - lo), np.int8)
        t = doc.token[own] - lo
        lab[t] = doc.toxic
        out.append((t, doc.feature[own], lab))
    return out


def fit(sample: list[Marked], kept: np.ndarray, held: np.ndarray, lexicon: Lexicon, p: ToxicParams) -> ToxicModel:
    """The chain from the documents numbered in kept, the score's weights from those in held."""
    toxic = np.array([s.toxic for s in sample], float)
    rows = []
    for c in (0, 1):
        room = p.chain_tokens
        for i in kept[toxic[kept] == c][: p.chain_rows] if len(kept) else []:
            if room <= 0:
                break
            rows += _segments(sample[i], p.segment)
            room -= sample[i].tokens
    keys, order = lexicon.keys, np.concatenate([held, kept])
    chain = fit_chain(rows, len(keys), p)
    test = held if len(held) >= 40 and 0 < toxic[held].sum() < len(held) else order
    x = np.zeros((len(test), 4))
    for k, i in enumerate(test):
        d = sample[i]
        at, place = np.unique(d.token, return_inverse=True)
        s = chain.bias + np.bincount(place, weights=chain.w[d.feature], minlength=len(at))
        row, n = np.zeros(len(at), np.int64), np.array([d.tokens])
        x[k] = _summary(row, chain.marginals(row, at, s, n), n)[0]
    y, weight = toxic[test], np.array([sample[i].weight for i in test])
    b = np.zeros(4)
    for _ in range(30):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (weight * (y - q)) - np.array([0, 0.3, 0.3, 0.3]) * b
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 0.3, 0.3, 0.3])
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -2, 2)
    return ToxicModel(lexicon, chain, b, p)


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: ToxicParams | None = None) -> ToxicModel | None:
    """A model from labelled rows where `usable` (a column of the id) holds; None without any.

    An id with several labels counts as toxic if one of them is. Rows enter the bounded
    sample by the smallest hash of their id; class weights undo its uneven shares.
    """
    p = params or ToxicParams()
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.where(usable(F.col("id")))
    count = {int(r["y"]): int(r["n"]) for r in marks.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return None
    h = F.xxhash64(F.col("id").cast("string"))
    part = F.pmod(h, F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("y") > 0, F.lit(min(1.0, 2 * p.toxic_rows / max(1, count.get(1, 0))))).otherwise(F.lit(min(1.0, 2 * p.clean_rows / max(1, count.get(0, 0)))))
    few = marks.where(part < share).withColumn("y", (F.col("y") > 0).cast("int")).withColumn("h", h)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(few), "id")  # few: about twice the sample at most
    some = some.dropDuplicates(["id"])
    w = Window.partitionBy("y").orderBy("h", "id")
    drawn = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.when(F.col("y") > 0, p.toxic_rows).otherwise(p.clean_rows)).select("y", "text")

    k = 1 + len(p.prefixes)

    def features(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                words = words_of(piece, p.prefixes)
                flat = []
                for i in range(len(piece)):
                    lo, hi = words.first[i], words.first[i + 1]
                    flat.append(np.concatenate([x[lo:hi] for x in words.hashes]).view(np.int64))
                digest = [hashlib.sha256(x).hexdigest() for x in flat]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), pa.array(digest, pa.string()), pa.array(flat, pa.list_(pa.int64()))], ["y", "digest", "hashes"])

    # copies count once; whole texts stay on the executors, the driver gets labels and what is found
    table = cut(arrow(drawn, features, "y int, digest string, hashes array<long>").dropDuplicates(["y", "digest"]), "labelled")
    heads = sorted((r["y"], r["digest"]) for r in table.select("y", "digest").collect())
    order = np.random.default_rng(p.seed).permutation(len(heads))
    held, kept = order[: len(order) // 4], order[len(order) // 4 :]
    keys = np.zeros(0, np.uint64)
    if len(kept):
        mine = docs.sparkSession.createDataFrame([heads[i] for i in kept], "y int, digest string")
        n1 = sum(heads[i][0] for i in kept)
        keys = choose_features(table.join(F.broadcast(mine), ["y", "digest"], "left_semi"), n1, len(kept) - n1, p)
    lexicon = docs.sparkSession.sparkContext.broadcast(Lexicon(keys))  # features of the sample

    def found(batches):
        known = lexicon.value
        for batch in batches:
            n, token, feature = [], [], []
            for x in batch.column(2):
                hashes = np.asarray(x.values).view(np.uint64).reshape(k, -1)
                n.append(hashes.shape[1])
                t, f = zip(*[known.find(h) for h in hashes])
                token.append(np.concatenate(t))
                feature.append(np.concatenate(f))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(token, lists), pa.array(feature, lists)], ["y", "digest", "n", "token", "feature"])

    got = arrow(table, found, "y int, digest string, n long, token array<long>, feature array<long>").toArrow()
    whole = sum(count.values())
    weight = {y: count.get(y, 0) / whole * len(heads) / max(1, sum(1 for h in heads if h[0] == y)) for y in (0, 1)}
    sample = {}
    for y, digest, n, t, f in zip(*[got.column(c).to_pylist() for c in ("y", "digest", "n")], got.column("token"), got.column("feature")):
        sample[y, digest] = Marked(y, weight[y], n, np.asarray(t.values, np.int64), np.asarray(f.values, np.int64))
    model = fit([sample[h] for h in heads], kept, held, lexicon.value, p)
    drop(table)
    lexicon.destroy()
    del got, sample
    trim()
    return model


def score(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, spans) of every row, from its whole text alone.

    spans: start and end (in code points) of each run of tokens tagged as toxic. Null and
    empty texts get the score of a text without findings. Without a model all scores are 0.
    Repeated rows repeat; an empty table is empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        m = held.value
        for batch in batches:
            for piece in pieces(batch.column(1)):
                found = [[] for _ in range(len(piece))]
                if m is None:
                    s = np.zeros(len(piece))
                else:
                    s, words, row, i, marg = m.scores(piece)
                    for r, w in zip(row[marg > 0.5].tolist(), i[marg > 0.5].tolist()):
                        a, b = int(words.start[w] - words.at[r]), int(words.end[w] - words.at[r])
                        if found[r] and found[r][-1]["w"] == w - 1:
                            found[r][-1].update(end=b, w=w)
                        else:
                            found[r].append({"start": a, "end": b, "w": w})
                cut_at = m.params.threshold if m else 1.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), pa.array(s, pa.float64()), pa.array((s >= cut_at).astype(np.int32)), pa.array([[{"start": x["start"], "end": x["end"]} for x in f] for f in found], span)], ["id", "score", "predicted", "spans"])

    return arrow(docs.select(id_col, F.col(text_col).cast("string")), run, f"id {kind}, score double, predicted int, spans array<struct<start:bigint,end:bigint>>")


def without_toxic(docs: DataFrame, model: ToxicModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for batch in batches:
            if m is None:
                yield batch
                continue
            texts = batch.column(at)
            keep = [m.scores(piece)[0] < m.params.threshold for piece in pieces(texts)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return arrow(docs, run, docs.schema)
