"""Suffix-array dedup: removes every byte inside a long string that occurs elsewhere.

Prefix doubling over content-chosen positions. Classic prefix doubling ranks all
positions by strings of growing length; with bytes as positions that shuffles many times
the corpus. Here the positions are anchors: the least 17-byte string (by hash) of each
threshold-long window, so equal windows have equal anchors at equal distances. A window is
named by its anchor and its distance d. Distances are split in cells; windows of a cell
share a core (bytes in all of them) and lie within a hull. Spark groups the positions by
the rank of their core, paired with the rank of the hull:

* a core that is unique drops out: none of its windows repeats;
* a hull that repeats is past the threshold: all of its windows repeat;
* what is neither goes to the next round, where the cell is divided and the compared
  strings grow towards the threshold (273, 385, then all 400 bytes).

Ranks are 64-bit fingerprints computed beside the text, so reranking needs no sort of its
own. Equal texts are one text throughout; their bytes all repeat.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.base import ByteHash, IdBits, Piece, arrow, cut, drop, free_name, pieces, word_spans

_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class RepeatParams:
    """threshold, gram and cells count bytes of texts, or words. threshold - gram + 1 must be a
    multiple of each cell size, in falling order to 1."""

    threshold: int = 400
    gram: int = 17
    cells: tuple[int, ...] = (128, 16, 1)
    words: bool = False


#: Runs of 51 words, whatever stands between them.
WORDS_51 = RepeatParams(threshold=51, gram=12, cells=(40, 8, 1), words=True)


def _symbols(piece: Piece, p: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """What a piece's texts consist of: bytes, or hashes of words; and where each row begins."""
    if not p.words:
        return piece.data, piece.offsets
    s, e, first = word_spans(piece)
    return (ByteHash(piece.data).of(s, e) if len(s) else np.zeros(0, np.uint64)), first


def _keys(symbols: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[int]]:
    """For each row, the sha256 of its symbols and 64 bits of it."""
    digests = [hashlib.sha256(symbols[a:b].tobytes()).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return [d.hex() for d in digests], [int.from_bytes(d[:8], "little", signed=True) for d in digests]


def _spans_of_words(raw: bytes, spans: list) -> list:
    """Spans in a text's words as spans in its bytes; blanks go with the word before them."""
    s, e, _ = word_spans(Piece(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    begin = np.append(s, e[-1:])
    return [{"s": int(begin[x]), "e": int(begin[y])} for x, y in zip(*_union(spans))]


def anchors(n: int, offsets: np.ndarray, sums: ByteHash, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with one anchor, as
    positions in n symbols; windows never cross rows."""
    none = np.zeros(0, np.int64)
    w = p.threshold - p.gram + 1
    if n < p.threshold:
        return none, none, none
    at = np.arange(n - p.gram + 1)
    bits = max(20, int(n).bit_length())
    key = (sums.of(at, at + p.gram) >> np.uint64(bits) << np.uint64(bits)) | at.view(np.uint64)  # ties: leftmost
    blocks = -(-len(key) // w)
    full = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(key)] = key
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - p.threshold + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    chosen = (least & np.uint64((1 << bits) - 1)).view(np.int64)
    size = np.diff(offsets)
    good = np.zeros(n + 1, np.int8)
    long = size >= p.threshold
    np.add.at(good, offsets[:-1][long], 1)
    np.add.at(good, (offsets[1:] - p.threshold + 1)[long], -1)
    valid = np.cumsum(good[:starts], dtype=np.int8) > 0
    turn = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]) | np.append(True, valid[1:] != valid[:-1]))
    # an anchor never lies in two rows, so runs also end where rows do
    end = np.append(turn[1:], starts) - 1
    keep = valid[turn]
    return chosen[turn[keep]], turn[keep], end[keep]


def _cells(a: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the run, cell) for each cell of distances that a run's windows fall in."""
    low, high = (a - last) // size, (a - first) // size
    count = high - low + 1
    run = np.repeat(np.arange(len(a)), count)
    return run, low[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def _names(one: ByteHash, two: ByteHash, a: np.ndarray, cell: np.ndarray, size: int, low: np.ndarray, high: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of core and hull of each cell, and whether the hull is within its row low..high.
    Where it isn't, the hull's rank is meaningless."""
    near, far = cell * size, cell * size + size - 1
    core = one.of(a - near, a - far + p.threshold)
    s, e = a - far, a - near + p.threshold
    inside = (s >= low) & (e <= high)
    return core, two.of(np.where(inside, s, low), np.where(inside, e, low)), inside


def _first_round(rows: DataFrame, searches: list[RepeatParams]) -> DataFrame:
    """(id, sha) of each text and, for each search k, (n_k, fp_k, x_k): its length and key, and
    its cells as (at, core, hull); at = anchor * 64 + cell."""
    cell_type = "array<struct<at:bigint,core:bigint,hull:bigint>>"
    schema = "id long, sha string, " + ", ".join(f"n_{k} long, fp_{k} long, x_{k} {cell_type}" for k in range(len(searches)))

    def scan(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                columns = [batch.column(0).slice(piece.lo, len(piece)), None]
                for p in searches:
                    size = p.cells[0]
                    symbols, offsets = _symbols(piece, p)
                    one, two = ByteHash(symbols, 1), ByteHash(symbols, 2)
                    a, first, last = anchors(len(symbols), offsets, one, p)
                    run, cell = _cells(a, first, last, size)
                    row = np.searchsorted(offsets, first, "right") - 1
                    low, high = offsets[row], offsets[row + 1]
                    core, hull, inside = _names(one, two, a[run], cell, size, low[run], high[run], p)
                    bounds = np.searchsorted(row[run], np.arange(len(piece) + 1))
                    where = (a - low)[run] * 64 + cell
                    cells = pa.StructArray.from_arrays([pa.array(where), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64), mask=~inside)], ["at", "core", "hull"])
                    sha, fp = _keys(symbols, offsets)
                    if not p.words or columns[1] is None:
                        columns[1] = pa.array(sha, pa.string())
                    columns += [pa.array(np.diff(offsets)), pa.array(fp, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), cells)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "sha", *[f"{c}_{k}" for k in range(len(searches)) for c in ("n", "fp", "x")]])

    return arrow(rows, scan, schema)


def _next_round(texts: DataFrame, size: int, sub: int, p: RepeatParams) -> DataFrame:
    """(fp, n, at, core, hull) for each cell of size `sub` within the cells `ats` of size `size`."""
    base, each = 64 if size == p.cells[0] else 1024, size // sub

    def scan(batches):
        for batch in batches:
            ats = batch.column(3)
            for piece in pieces(batch.column(2)):
                symbols, offsets = _symbols(piece, p)
                one, two = ByteHash(symbols, 1), ByteHash(symbols, 2)
                part = ats.slice(piece.lo, len(piece))
                flat = np.asarray(part.flatten())
                row = np.repeat(np.arange(len(piece)), np.asarray(part.value_lengths().fill_null(0)))
                low, high = offsets[row], offsets[row + 1]
                a = np.repeat(flat // base + low, each)
                cell = np.repeat(flat % base, each) * each + np.tile(np.arange(each), len(flat))
                low, high, row = np.repeat(low, each), np.repeat(high, each), np.repeat(row, each)
                # the cell must hold a window inside the row
                some = (a - cell * sub >= low) & (a - cell * sub - sub + 1 + p.threshold <= high)
                a, cell, low, high, row = a[some], cell[some], low[some], high[some], row[some]
                # clip: only cells with a whole core in the row can hold a window
                core, hull, inside = _names(one, two, a, cell, sub, low, high, p)
                if len(a):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)).take(pa.array(row)), batch.column(1).slice(piece.lo, len(piece)).take(pa.array(row)), pa.array((a - low) * 1024 + cell), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64), mask=~inside)], ["fp", "n", "at", "core", "hull"])

    return arrow(texts.select("fp", "n", "text", "ats"), scan, "fp long, n long, at long, core long, hull long")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Ranks that stand at two positions or more: distinct texts or distinct places in one."""
    found = rows.groupBy(*keys).agg(F.min("position").alias("least"), F.max("position").alias("most"))
    return found.where("least != most").select(*keys)


def _settle(rows: DataFrame, size: int, base: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One round on (fp, n, at, core, hull): rows whose hull repeats, and rows for the next
    round: all members of cores that hold a row not settled, one of each hull. Also the tables
    that they read.

    Repeated ranks are tables of their own before rows join them: so Spark sees both sides of
    a join and deals a rank that fills a partition to several tasks.
    """
    # two anchors can name one place of a text; a position is one number, so that groups ship little
    place = F.expr(f"at div {base} - at % {base} * {size}")
    placed = rows.withColumn("position", F.xxhash64("fp", "n", place))
    cores = cut(_repeated(placed, "core"), "cores")
    alive = cut(rows.join(cores, "core").distinct(), "alive")  # equal texts meet here
    drop(cores)
    done = cut(_repeated(alive.where("hull is not null").withColumn("position", F.xxhash64("fp", "n", place)), "core", "hull").withColumn("done", F.lit(True)), "done")
    known = cut(alive.join(done, ["core", "hull"], "left"), "known")
    drop(alive, done)
    passed = known.where("done")
    ends = cut(known.where("done is null").select("core").distinct(), "open")
    # equal hulls hold equal windows: one of them stands for all in later rounds
    one = passed.join(ends, "core", "left_semi").groupBy("core", "hull").agg(F.min(F.struct("fp", "n", "at")).alias("x")).select("x.fp", "x.n", "x.at")
    return passed.select("fp", "n", "at"), known.where("done is null").select("fp", "n", "at").union(one), [known, ends]


def _spans(rows: DataFrame, size: int, base: int, p: RepeatParams) -> DataFrame:
    """(fp, n, s, e): bytes within the hulls of cells."""
    a, cell = F.expr(f"at div {base}"), F.col("at") % base
    return rows.select("fp", "n", (a - cell * size - size + 1).cast("long").alias("s"), (a - cell * size + p.threshold).cast("long").alias("e"))


def _union(spans: list) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs that a list of spans covers."""
    s = np.array([[x["s"], x["e"]] for x in spans], np.int64).reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    top = np.maximum.accumulate(s[:, 1])
    new = np.append(True, s[1:, 0] > top[:-1])
    return s[new, 0], top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def _removal(texts: DataFrame) -> DataFrame:
    """(fp, n, n_removed, n_spans, kept_sha256) of texts with lists of spans."""

    def apply(batches):
        for batch in batches:
            removed, count, sha = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3)):
                raw = text.as_buffer() if text.is_valid else b""
                starts, ends = _union(spans.as_py())
                h, at = hashlib.sha256(), 0
                view = memoryview(raw)
                for x, y in zip(starts.tolist(), ends.tolist()):
                    h.update(view[at:x])
                    at = y
                h.update(view[at:])
                removed.append(int((ends - starts).sum()))
                count.append(len(starts))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["fp", "n", "n_removed", "n_spans", "kept_sha256"])

    return arrow(texts.select("fp", "n", "text", "spans"), apply, "fp long, n long, n_removed long, n_spans long, kept_sha256 string")


@dataclass
class Repeats:
    """rows: (id, sha) of each input row and for each search k its length and key, (n_k, fp_k);
    whole: for each search, (n, fp) of texts of which every symbol repeats; spans: for each,
    (fp, n, spans) of the other texts with repeats, spans as s and e, unsorted."""

    rows: DataFrame
    whole: list[DataFrame]
    spans: list[DataFrame]


def _fetch(rows: DataFrame, ids: DataFrame, need: DataFrame, p: RepeatParams) -> DataFrame:
    """(fp, n, text) for each key in need, and for some others. ids: (fp, n, id) with one id
    for each text. Texts that no id wants stay where they are: only the others are dealt."""
    among = IdBits(ids.join(need.select("fp", "n"), ["fp", "n"], "left_semi").select("id"))

    def key(batches):
        for batch in among.only(batches):
            for piece in pieces(batch.column(1)):
                symbols, offsets = _symbols(piece, p)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(symbols, offsets)[1], pa.int64()), pa.array(np.diff(offsets)), batch.column(1).slice(piece.lo, len(piece))], ["fp", "n", "text"])

    # equal texts may come more than once, as may other texts of an id that repeats
    return arrow(rows.select("id", "text"), key, "fp long, n long, text string").dropDuplicates(["fp", "n"])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))


def find_repeats(docs: DataFrame, searches: list[RepeatParams], id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Where strings of bytes or of words repeat: each search has its own threshold."""
    rows = _narrow(docs, id_col, text_col)
    first = cut(_first_round(rows, searches), "anchors")
    out = Repeats(cut(first.drop(*[f"x_{k}" for k in range(len(searches))]), "texts"), [], [])
    for k, p in enumerate(searches):
        texts = cut(out.rows.groupBy(F.col(f"fp_{k}").alias("fp"), F.col(f"n_{k}").alias("n")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "ids")
        whole = texts.where((F.col("copies") > 1) & (F.col("n") >= p.threshold)).select("fp", "n")
        cells = first.select(F.col(f"fp_{k}").alias("fp"), F.col(f"n_{k}").alias("n"), F.explode(f"x_{k}").alias("x")).select("fp", "n", "x.at", "x.core", "x.hull")
        passed, more, tables = _settle(cells, p.cells[0], 64)
        if k == len(searches) - 1:
            drop(first)
        spans, loaded = [cut(_spans(passed, p.cells[0], 64, p), "part")], None
        for size, sub in zip(p.cells[:-1], p.cells[1:]):
            more = cut(more.groupBy("fp", "n").agg(F.collect_set("at").alias("ats")), "more")
            drop(*tables)
            # a round's texts are among those of the one before it
            found = loaded.select("fp", "n", "text") if loaded else _fetch(rows, texts, more, p)
            before, loaded = [loaded] * bool(loaded), cut(found.join(more, ["fp", "n"]), "round")
            drop(more, *before)
            cells = cut(_next_round(loaded, size, sub, p), "cells")
            passed, more, tables = _settle(cells, sub, 1024)
            drop(cells)
            spans.append(cut(_spans(passed, sub, 1024, p), "part"))
        drop(*tables, *[loaded] * bool(loaded))
        whole = cut(whole, "whole")
        merged = reduce(DataFrame.union, spans).join(whole, ["fp", "n"], "left_anti").groupBy("fp", "n").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        out.spans.append(cut(merged, "spans"))
        out.whole.append(whole)
        drop(texts, *spans)
    return out


def _runs(spans: DataFrame) -> DataFrame:
    """(fp, n, size, count): symbols in, and number of, the maximal runs of lists of spans."""

    def unite(batches):
        for batch in batches:
            both = [_union(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int((e - s).sum()) for s, e in both], pa.int64()), pa.array([len(s) for s, _ in both], pa.int64())], ["fp", "n", "size", "count"])

    return arrow(spans.select("fp", "n", "spans"), unite, "fp long, n long, size long, count long")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: RepeatParams | None = None, words: RepeatParams | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Texts count as UTF-8 bytes, null as empty. A byte goes if a string of `threshold` bytes
    over it also starts elsewhere, in the same text or another; overlaps count, and strings
    are judged on the input. Rows of equal texts of at least the threshold lose all bytes,
    also where ids repeat. An empty table gives no rows; other columns play no part.

    With words, such as WORDS_51, (n_passages, passage_words) follow: how many maximal runs of
    words the text has in which each run of that many words also stands elsewhere, whatever
    their bytes take, and the words in them. They change none of the other columns. Ranks are
    64-bit fingerprints: the result is exact up to their collisions.
    """
    p = params or RepeatParams()
    found = find_repeats(docs, [p, *[words] * bool(words)], id_col, text_col)
    texts = found.rows.groupBy(F.col("fp_0").alias("fp"), F.col("n_0").alias("n")).agg(F.min("id").alias("id"))
    loaded = _fetch(_narrow(docs, id_col, text_col), texts, found.spans[0], p).join(found.spans[0], ["fp", "n"])
    partly = _removal(loaded)
    flag = lambda k: found.whole[k].withColumn(f"whole_{k}", F.lit(True)).withColumnsRenamed({"fp": f"fp_{k}", "n": f"n_{k}"})
    out = found.rows.join(partly.withColumnsRenamed({"fp": "fp_0", "n": "n_0"}), ["fp_0", "n_0"], "left").join(flag(0), ["fp_0", "n_0"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.coalesce("whole_0", F.lit(False))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    columns = [
        F.nullif("id", F.lit(_NO_ID)).alias("id"),
        F.col("n_0").alias("n_bytes"),
        F.when(whole, F.col("n_0")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, one).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if words:
        runs = _runs(found.spans[1]).toDF("fp_1", "n_1", "size_1", "count_1")
        out = out.join(runs, ["fp_1", "n_1"], "left").join(flag(1), ["fp_1", "n_1"], "left")
        same = F.coalesce("whole_1", F.lit(False))
        columns += [F.when(same, one).otherwise(F.coalesce("count_1", zero)).alias("n_passages"), F.when(same, F.col("n_1")).otherwise(F.coalesce("size_1", zero)).alias("passage_words")]
    return out.select(*columns)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", params: RepeatParams | None = None, words: RepeatParams | None = None) -> DataFrame:
    """docs with repeated bytes taken out of the text, all rows and columns kept. With words,
    such as WORDS_51, runs of words go too that repeat at another place, whatever their bytes
    and the blanks between them; both are judged on the input.

    A character goes only if all its bytes do, so texts stay valid UTF-8. length_col, where
    docs has it, becomes the new number of characters of changed texts; a text that repeats
    as a whole becomes empty, a null one stays null. Other columns may have any names.
    """
    searches = [params or RepeatParams(), *[words] * bool(words)]
    found = find_repeats(docs, searches, id_col, text_col)
    changes = found.rows.select(*[f"{c}_{k}" for k in range(len(searches)) for c in ("fp", "n")]).distinct()
    for k in range(len(searches)):
        all_of_it = found.whole[k].select("fp", "n", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))))
        changes = changes.join(found.spans[k].select("fp", "n", "spans").union(all_of_it).toDF(f"fp_{k}", f"n_{k}", f"spans_{k}"), [f"fp_{k}", f"n_{k}"], "left")
    if not words:
        changes = changes.withColumn("spans_1", F.lit(None).cast(changes.schema["spans_0"].dataType))
    changes = cut(changes.where("spans_0 is not null or spans_1 is not null").select("fp_0", "n_0", "spans_0", "spans_1"), "changes")
    drop(found.rows, *found.whole, *found.spans)
    names = docs.columns
    fp, n, spans, runs = own = [free_name(names, f"_{c}") for c in ("fp", "n", "spans", "runs")]
    at = names.index(text_col)
    key = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(n, T.LongType())])

    def mark(batches):
        for batch in batches:
            for piece in pieces(batch.column(at).cast(pa.string())):
                keys = _keys(*_symbols(piece, searches[0]))[1]
                yield pa.RecordBatch.from_arrays([*[c.slice(piece.lo, len(piece)) for c in batch.columns], pa.array(keys, pa.int64()), pa.array(np.diff(piece.offsets))], names=[*names, fp, n])

    marked = arrow(docs, mark, key).join(changes.toDF(*own), [fp, n], "left")
    marked = marked.select(*[F.col(f"`{c}`") for c in names], spans, runs)
    length = names.index(length_col) if length_col in names else -1

    def apply(batches):
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), batch.column(length).to_pylist() if length >= 0 else None
            for k, (bytes_, words_) in enumerate(zip(batch.column(len(names)), batch.column(len(names) + 1))):
                if (bytes_.is_valid or words_.is_valid) and texts[k]:
                    raw, parts, left = texts[k].encode("utf-8"), [], 0
                    gone = (bytes_.as_py() or []) + (_spans_of_words(raw, words_.as_py()) if words_.is_valid else [])
                    for x, y in zip(*(v.tolist() for v in _union(gone))):
                        while x < y and raw[x] & 0xC0 == 0x80:
                            x += 1
                        while y < len(raw) and y > x and raw[y] & 0xC0 == 0x80:
                            y -= 1
                        parts.append(raw[left:x])
                        left = y
                    parts.append(raw[left:])
                    texts[k] = b"".join(parts).decode("utf-8", "replace")
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if sizes is not None:
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow(marked, apply, docs.schema)


def brute_force(rows: list[tuple], threshold: int = 400) -> list[tuple]:
    """Every window in a dictionary, for tests."""
    seen: dict[bytes, int] = {}
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - threshold + 1):
            w = hashlib.md5(raw[i : i + threshold]).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for k, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - threshold + 1):
            if seen[hashlib.md5(raw[i : i + threshold]).digest()] > 1:
                gone[i : i + threshold] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
        out.append((k, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
