"""What the operators of this subpackage share: storage that all executors see,
bounded text pieces, and vectorised hashing of bytes and words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19


# -- storage ---------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder of its own; a cluster raises ValueError, as its machines share none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = getattr(spark.sparkContext, "_gridloom_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext._gridloom_dir = own
    return own


#: While a table is written: its shuffle files go with the write, and the plan texts that the
#: driver keeps for its status store (of up to 1000 executions) stay short.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "4000"}
_TABLES: dict[str, tuple] = {}


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a DataFrame to the shared folder as Parquet and read it back.

    The lineage ends at replicated files, so a lost executor never recomputes what
    stands before, and the shuffle files behind the write go with it. drop() deletes the
    table once its readers are done; what is left goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        with _collecting(spark):
            df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _TABLES[path] = (where, spark.sparkContext._jsc.hadoopConfiguration())
    if len(_TABLES) == 1:
        atexit.register(_remove_all)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


_collected = 0.0


def _collect(spark: SparkSession) -> None:
    """Has the driver drop the plans of finished writes, once its heap has grown to half of what
    it may take: it would grow to all of that before it looked for garbage. Seldom enough that
    a large heap in use costs little."""
    global _collected
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() * 2 > runtime.maxMemory() and time.monotonic() - _collected > 2:
        gc.collect()  # plans that Python still names
        runtime.gc()
        _collected = time.monotonic()


@contextlib.contextmanager
def _collecting(spark: SparkSession) -> Iterator[None]:
    """Looks after the driver's heap each second while a write runs, and when it has ended."""
    over = threading.Event()

    def look() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the session may be stopped meanwhile
            while not over.wait(1):
                _collect(spark)

    beside = threading.Thread(target=look, daemon=True)
    beside.start()
    try:
        yield
    finally:
        over.set()
        beside.join()
    _collect(spark)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by cut(). Nothing may read them any more, not even lazily."""
    for t in tables:
        _remove(t._gridloom_path)


def _remove(path: str) -> None:
    where, conf = _TABLES.pop(path, (None, None))
    if where is not None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone first
            where.getFileSystem(conf).delete(where, True)


def _remove_all() -> None:
    """What is still there at exit, whether or not the session was stopped before."""
    for path in list(_TABLES):
        _remove(path)


def arrow(rows: DataFrame, function: Callable, schema: object) -> DataFrame:
    """rows.mapInArrow, but each task hands freed memory back to the system when it ends:
    worker processes outlive tasks and would keep the most that any task has held."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            ByteHash.shrink()
            pa.default_memory_pool().release_unused()
            trim()

    return rows.mapInArrow(run, schema)


def trim() -> None:
    """Gives the C allocator's free pages back, where that is glibc's."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class IdBits:
    """A bitmap of fixed size over the column id of a table: tells which rows of another table
    may have one of its ids, so that a join need not deal the rest. It only spares work: some
    other ids pass as well, the more the more ids there are, and a join must follow."""

    BITS = 23

    def __init__(self, ids: DataFrame):
        def mark(batches):
            bits = np.zeros(1 << IdBits.BITS, bool)
            for batch in batches:
                bits[IdBits.slot(batch.column(0))] = True
            words = np.packbits(bits, bitorder="little").view(np.int64)
            hit = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(words[hit])], ["word", "bits"])

        got = arrow(ids.select("id"), mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (IdBits.BITS - 6), np.int64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy()
        self.words = ids.sparkSession.sparkContext.broadcast(words)

    @staticmethod
    def slot(ids: pa.Array) -> np.ndarray:
        return (mix(np.asarray(ids).view(np.uint64)) >> np.uint64(64 - IdBits.BITS)).astype(np.int64)

    def only(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose first column, an id, may be among the table's."""
        for batch in batches:
            at = IdBits.slot(batch.column(0))
            yield batch.filter(pa.array((self.words.value[at >> 6] >> (at & 63)) & 1 != 0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(columns: list[str], wish: str) -> str:
    """wish, with underscores before it until no column has that name, in any case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


# -- row splits ------------------------------------------------------------------------


def split_of(column: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % parts


def split_of_value(value: object, parts: int) -> int:
    return zlib.crc32(str(value).encode()) % parts


# -- text pieces -----------------------------------------------------------------------


class Piece:
    """Rows lo..hi of a batch: all their UTF-8 bytes in one array, and where each begins."""

    __slots__ = ("lo", "hi", "data", "offsets")

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def row(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string array in runs of rows with about `limit` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, raw, content = texts.buffers()
    off = np.frombuffer(raw, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if texts.null_count:  # a null slot may span bytes
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
        yield from pieces(texts, limit)
        return
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Piece(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


# -- hashing ---------------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


class ByteHash:
    """Polynomial prefix sums over one array of bytes, or of 64-bit symbols, from which the hash
    of any substring follows in constant time. Each byte value stands for a random word."""

    _powers: dict[int, Powers] = {}
    _tables: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        if seed not in self._powers:
            rng = np.random.default_rng(1000 + seed)
            self._powers[seed] = Powers(int(rng.integers(1 << 62, 1 << 63)))
            self._tables[seed] = rng.integers(0, 1 << 64, 256, np.uint64)
        self.p = self._powers[seed]
        self.p.need(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        # other symbols than bytes, such as hashes of words, are their own random words
        symbols = self._tables[seed][data] if data.dtype == np.uint8 else mix(data + self._tables[seed][0])
        np.cumsum(symbols * self.p.up[: len(data)], out=self.sums[1:])

    @classmethod
    def shrink(cls, keep: int = PIECE_BYTES) -> None:
        """Drops powers that only very long pieces needed."""
        for seed, p in list(cls._powers.items()):
            if len(p.up) > 2 * keep:
                cls._powers[seed] = Powers(p.base)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[s:e] for each pair; equal bytes give equal values."""
        return mix((self.sums[ends] - self.sums[starts]) * self.p.down[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than blanks, and the first word of each row
    (one entry more than rows). Words end at the end of a row."""
    n = len(piece.data)
    rows = piece.offsets
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(rows), np.int64)
    inside = ~SPACE[piece.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = rows[:-1][rows[:-1] < n]
    begins[edge] = inside[edge]
    last = rows[1:][rows[1:] > 0] - 1
    ends[last] = inside[last]
    s = np.flatnonzero(begins)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, rows)


# -- code points -----------------------------------------------------------------------


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def code_points(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a piece's texts and where each row begins. Bytes that are not valid
    UTF-8 become U+FFFD."""
    raw = piece.data.tobytes()
    try:
        text = raw.decode("utf-8")
        lead = (piece.data & 0xC0) != 0x80
        at = np.append(0, np.cumsum(lead))[piece.offsets]
    except UnicodeDecodeError:
        rows = [piece.row(k).decode("utf-8", "replace") for k in range(len(piece))]
        text, at = "".join(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), at.astype(np.int64)
