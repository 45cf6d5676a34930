"""Language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties and calibrated by a temperature.
Document frequencies cover every training row; the classifier is fitted on a bounded
sample of labelled rows. A document's features are scaled by their sum, so one pass over
its n-grams gives numerators and denominator at once and whole texts of any length take
constant memory beyond the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import Piece, code_points, letter_table, pieces, arrow


@dataclass(frozen=True)
class LangParams:
    """rows_per_lang bounds the fitting sample of each language, fit_rows that of all together
    (with many languages each has an equal share of it, one row at least). Texts are used
    whole, every language is learned; a quarter of the sample calibrates the temperature."""

    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    rows_per_lang: int = 500
    fit_rows: int = 50_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    scale: float = 40.0
    seed: int = 3


UNKNOWN = "und"


def gram_ids(codes: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point; 2**bits where it would leave its
    text or holds no letter. Letters count in lower case, all else as a word's edge."""
    size = len(codes)
    h = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    some = codes != 0
    for k in range(1, n):
        nxt = np.zeros(size, np.uint32)
        nxt[: size - k] = codes[k:]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + nxt * np.uint32(0xC2B2AE3D)
        some |= nxt != 0
    ids = ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)).astype(np.int32)
    ids[~some] = 1 << bits
    for k in range(1, n):
        edge = at[1:] - k
        ids[edge[edge >= at[:-1]]] = 1 << bits
    return ids


@dataclass
class LangModel:
    """weights: (n-gram size, bucket + 1, languages + 1); the last column is the idf."""

    langs: list[str]
    weights: list[np.ndarray]
    bias: np.ndarray
    temperature: float
    params: LangParams

    def sums(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits before the temperature, and whether each row has a letter and any n-gram."""
        codes, at = code_points(piece)
        norm = letter_table()[codes] if len(codes) else codes
        total = np.zeros((len(piece), len(self.langs) + 1))
        full = np.flatnonzero(at[1:] > at[:-1])
        letters = np.zeros(len(piece), bool)
        if len(full):
            letters[full] = np.maximum.reduceat(norm, at[full]) > 0
            for n, w in zip(self.params.sizes, self.weights):
                got = w[gram_ids(norm, at, n, self.params.bits)]
                total[full] += np.add.reduceat(got, at[full], axis=0)
        logits = self.params.scale * total[:, :-1] / np.maximum(total[:, -1:], 1e-9) + self.bias
        return logits, letters, total[:, -1] > 0

    def predict(self, piece: Piece) -> tuple[list[str], np.ndarray]:
        logits, letters, _ = self.sums(piece)
        z = logits / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, p.max(axis=1), 0.0)


def document_frequencies(train: DataFrame, text_col: str, p: LangParams) -> tuple[np.ndarray, int]:
    """How many training rows hold each bucket of each n-gram size, and their number."""
    width = (1 << p.bits) + 1

    def count(batches):
        df = np.zeros(len(p.sizes) * width, np.int64)
        rows = 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                codes, at = code_points(piece)
                norm = letter_table()[codes] if len(codes) else codes
                ids = [gram_ids(norm, at, n, p.bits) + i * width for i, n in enumerate(p.sizes)]
                for k in range(len(piece)):
                    seen = np.zeros(len(df), bool)
                    for x in ids:
                        seen[x[at[k] : at[k + 1]]] = True
                    df += seen
                rows += len(piece)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], rows))], ["bucket", "n"])

    got = arrow(train.select(text_col), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(p.sizes) * width)
    rows = int(got["n"][got["bucket"] == -1].sum())
    real = got[got["bucket"] >= 0]
    df[real["bucket"].to_numpy()] = real["n"].to_numpy()
    return df.reshape(len(p.sizes), width), rows


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, p: LangParams) -> LangModel:
    """FTRL-proximal over the sample, then the temperature of least loss on its last quarter.
    rows: language, feature numbers (flat over sizes) and their counts."""
    width = (1 << p.bits) + 1
    flat = idf.reshape(-1)
    place = {lang: i for i, lang in enumerate(langs)}
    y = np.array([place[r[0]] for r in rows])
    xs = []
    for _, ids, n in rows:
        v = n * flat[ids]
        xs.append((ids, p.scale * v / max(v.sum(), 1e-9)))
    order = np.random.default_rng(p.seed).permutation(len(rows))
    held = order[: len(rows) // 4]
    kept = order[len(rows) // 4 :] if len(rows) >= 8 else order
    k = len(langs)
    z, n2, w = (np.zeros((len(flat) + 1, k)) for _ in range(3))  # the last row is the bias

    def logits(i: int) -> np.ndarray:
        ids, v = xs[i]
        return v @ w[ids] + w[-1]

    for epoch in range(p.epochs):
        for i in np.random.default_rng(p.seed + epoch).permutation(kept):
            ids = np.append(xs[i][0], len(flat))
            v = np.append(xs[i][1], 1.0)
            q = v @ w[ids]
            q = np.exp(q - q.max())
            q /= q.sum()
            q[y[i]] -= 1
            g = v[:, None] * q[None, :]
            old = n2[ids]
            new = old + g * g
            zi = z[ids] + g - (np.sqrt(new) - np.sqrt(old)) / p.alpha * w[ids]
            z[ids], n2[ids] = zi, new
            w[ids] = np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(new)) / p.alpha + p.l2))

    test = held if len(held) else kept
    raw = np.array([logits(i) for i in test]) if len(test) else np.zeros((0, k))

    def loss(t: float) -> float:
        s = raw / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(test)), y[test]])) if len(test) else 0.0

    lo, hi = np.log(0.2), np.log(20.0)
    for _ in range(40):  # golden section
        a, b = hi - 0.618034 * (hi - lo), lo + 0.618034 * (hi - lo)
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    parts = []
    for s in range(len(p.sizes)):
        block = slice(s * width, (s + 1) * width)
        m = np.concatenate([w[:-1][block] * flat[block][:, None], flat[block][:, None]], axis=1)
        m[-1] = 0
        parts.append(m.astype(np.float32))
    return LangModel(langs, parts, w[-1].copy(), float(np.exp((lo + hi) / 2)), p)


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", params: LangParams | None = None) -> LangModel | None:
    """A model from the rows where `usable` and neither text nor lang is null; None if there
    are none. Sampled rows are those of the smallest hash of their text, per language."""
    p = params or LangParams()
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), usable.alias("ok")).where("ok and text is not null and lang is not null").select("text", "lang")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not found:
        return None
    df, total = document_frequencies(rows, "text", p)
    idf = np.log((1 + total) / (1 + df)) + 1
    idf[:, -1] = 0
    width = (1 << p.bits) + 1
    own = min(p.rows_per_lang, max(1, p.fit_rows // len(found)))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, max(60.0, 1.5 * own) / r["n"])) for r in found], "lang string, share double")
    h = F.xxhash64("text")
    drawn = rows.join(F.broadcast(share), "lang").where((F.pmod(h, F.lit(1 << 20)) / float(1 << 20)) < F.col("share")).select("lang", "text", h.alias("h"))
    best = Window.partitionBy("lang").orderBy("h")
    drawn = drawn.dropDuplicates(["h", "lang"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= own).select("lang", "text")

    def features(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                codes, at = code_points(piece)
                norm = letter_table()[codes] if len(codes) else codes
                ids = [gram_ids(norm, at, n, p.bits) for n in p.sizes]
                out_i, out_n = [], []
                for k in range(len(piece)):
                    own = np.concatenate([x[at[k] : at[k + 1]][x[at[k] : at[k + 1]] < width - 1] + i * width for i, x in enumerate(ids)])
                    u, n = np.unique(own, return_counts=True)
                    out_i.append(u.astype(np.int32))
                    out_n.append(n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), pa.array(out_i, pa.list_(pa.int32())), pa.array(out_n, pa.list_(pa.int32()))], ["lang", "ids", "n"])

    sample = arrow(drawn, features, "lang string, ids array<int>, n array<int>").toArrow().sort_by([("lang", "ascending")])
    rows_ = [(lang, np.asarray(i.values, np.int64), np.asarray(n.values, float)) for lang, i, n in zip(sample.column("lang").to_pylist(), sample.column("ids"), sample.column("n"))]
    rows_.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    langs = sorted({r[0] for r in rows_}) or sorted(r["lang"] for r in found)
    return fit(rows_, langs, idf, p)


def identify(docs: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone.

    `und` with score 0 where the text is null or has no letter, and everywhere if there was
    nothing to learn from. Ids pass as they are; repeated rows repeat; an empty table is empty.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # buckets x languages
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        m = held.value
        for batch in batches:
            for p in pieces(batch.column(1)):
                lang, s = m.predict(p) if m else ([UNKNOWN] * len(p), np.zeros(len(p)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.lo, len(p)), pa.array(lang, pa.string()), pa.array(s, pa.float64())], ["id", "lang_pred", "score"])

    return arrow(docs.select(id_col, F.col(text_col).cast("string")), score, f"id {kind}, lang_pred string, score double")
