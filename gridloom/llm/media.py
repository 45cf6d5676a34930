"""Media columns: baseline JPEG.

The reader parses the markers of a baseline JPEG, Huffman-decodes its scans and keeps
the DC coefficient of each block, from which numpy rebuilds a thumbnail with one
luminance sample a block. Restart intervals are independent, so the decoder advances
all intervals of many images at once, one block a step, as lanes of an array. The
writer stores bytes as such DC samples: with a DC quantiser of 8 the thumbnail's samples
are the stored bytes themselves.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.base import pieces, arrow

#: Blocks a row of the images that the writer makes, and rows of blocks in one image:
#: a height of 65,472 lines; a longer payload continues in a further image.
WIDE, HIGH = 24, 24 * 341
TILE = WIDE * 24

#: The usual luminance DC code of baseline JPEG (code counts by length 1-16, then symbols).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
#: The writer's AC code has one word, "0", for the end of a block.
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


class JpegError(ValueError):
    """Not a baseline JPEG, or a damaged one."""


@lru_cache(maxsize=64)
def huffman(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix: length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    code, at = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lo, hi = code << (16 - length), (code + 1) << (16 - length)
            if hi > 1 << 16:
                raise JpegError("code counts overflow")
            table[lo:hi] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


# -- writing ---------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _header(rows: int) -> bytes:
    quant = bytes([8] + [1] * 63)
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + quant)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", WIDE))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference -255..255, with the end of block."""
    words = {}
    code, at = 0, 0
    for length, n in enumerate(DC_COUNTS, 1):
        for _ in range(n):
            words[DC_SYMBOLS[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, length = words[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], size[d + 255] = (code << cat | extra) << 1, length + cat + 1
    return bits, size


def encode_rows(samples: np.ndarray, numbers: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of rows of WIDE samples, each an interval of its own and followed
    by a restart marker (numbers, modulo 8) or, where last, the end of image; and where
    each row begins in them."""
    n = len(samples)
    d = samples.astype(np.int16)
    diff = np.empty_like(d)
    diff[:, 0] = d[:, 0] + 127
    np.subtract(d[:, 1:], d[:, :-1], out=diff[:, 1:])
    diff[:, 1:] += 255
    bits, size = _codes()
    v, s = bits[diff.T], size[diff.T]
    for _ in range(2):  # neighbours join: words of four samples have 60 bits at most
        v, s = v[0::2] << s[1::2] | v[1::2], s[0::2] + s[1::2]
    words = WIDE * 15 // 64 + 2
    buf = np.zeros(n * words, np.uint64)
    row = np.arange(n, dtype=np.int64) * words
    p = np.zeros(n, np.uint64)
    for x, k in zip(v, s):
        x = x << (np.uint64(64) - k)
        r = p & np.uint64(63)
        at = row + (p >> np.uint64(6)).view(np.int64)
        buf[at] |= x >> r
        buf[at + 1] |= (x << (np.uint64(63) - r)) << np.uint64(1)
        p += k
    total = p.view(np.int64)
    length = (total + 7) >> 3
    table = buf.byteswap().view(np.uint8).reshape(n, words * 8)
    spot = np.arange(n) * (words * 8) + length
    whole = table.reshape(-1)
    whole[spot - 1] |= ((1 << ((length << 3) - total)) - 1).astype(np.uint8)  # ones fill the last byte
    whole[spot] = 255
    whole[spot + 1] = np.where(last, 0xD9, 0xD0 + (numbers & 7))
    flat = table[np.arange(words * 8)[None, :] < (length + 2)[:, None]]
    first = np.cumsum(length + 2) - length - 2
    ff = np.flatnonzero(flat == 255)
    owner = np.searchsorted(first, ff, "right") - 1
    inner = ff - first[owner] < length[owner]
    ff, owner = ff[inner], owner[inner]
    out = np.insert(flat, ff + 1, 0)
    grown = length + 2 + np.bincount(owner, minlength=n)
    return out.tobytes(), np.append(0, np.cumsum(grown))


def payload_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded by bytes 255 to a positive multiple of TILE, and their offsets."""
    size = np.diff(offsets)
    at = np.append(0, np.cumsum(np.maximum(1, -(-size // TILE)) * TILE))
    out = np.full(int(at[-1]), 255, np.uint8)
    for k, n in enumerate(size.tolist()):
        out[at[k] : at[k] + n] = data[offsets[k] : offsets[k] + n]
    return out, at


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each text: one or more JPEG images, end to end."""
    payload, at = payload_of(data, offsets)
    if not len(payload):
        return []
    rows = at // WIDE
    total = int(rows[-1])
    own = np.arange(total) - np.repeat(rows[:-1], np.diff(rows))
    number = own % HIGH
    last = number == HIGH - 1
    last[rows[1:] - 1] = True
    raw, begins = encode_rows(payload.reshape(-1, WIDE), number, last)
    out = []
    for a, b in zip(rows[:-1], rows[1:]):
        parts = []
        for lo in range(int(a), int(b), HIGH):
            hi = min(int(b), lo + HIGH)
            parts += [_header(hi - lo), raw[begins[lo] : begins[hi]]]
        out.append(b"".join(parts))
    return out


# -- reading ---------------------------------------------------------------------------


@dataclass
class Frame:
    """One image as its markers describe it, and the bytes of its scans."""

    width: int = 0
    height: int = 0
    components: dict = field(default_factory=dict)
    order: list = field(default_factory=list)
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    restart: int = 0
    scans: list = field(default_factory=list)


#: A marker within or after a scan, other than a restart.
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker other than a restart begins, or the end of the data."""
    m = _MARKER.search(data, at)
    return m.start() if m else len(data)


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The image that begins at `at`, and where it ends. Raises JpegError."""
    f = Frame()
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at += 2
    try:
        while True:
            if data[at] != 0xFF:
                raise JpegError("marker expected")
            while data[at] == 0xFF:
                at += 1
            marker = data[at]
            at += 1
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            if size < 2 or len(body) != size - 2:
                raise JpegError("short segment")
            at += size
            if marker == 0xDB:
                while body:
                    wide, which = body[0] >> 4, body[0] & 15
                    f.quant[which] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + (128 if wide else 64) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    f.tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                bits, f.height, f.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not f.width or not f.height or not 1 <= n <= 4:
                    raise JpegError("unsupported frame")
                for i in range(n):
                    c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                    if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4):
                        raise JpegError("bad sampling")
                    f.components[c] = (hv >> 4, hv & 15, q)
                    f.order.append(c)
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise JpegError("not baseline")
            elif marker == 0xDD:
                f.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                parts = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                if not f.order or any(c not in f.components for c, _, _ in parts):
                    raise JpegError("scan before frame")
                end = _scan_end(data, at)
                use = tuple((c, f.tables[d], f.tables[16 + a]) for c, d, a in parts)
                f.scans.append((use, f.restart, at, end))
                at = end
    except (IndexError, KeyError, struct.error, ValueError) as e:
        raise e if isinstance(e, JpegError) else JpegError(str(e)) from None
    if not f.scans:
        raise JpegError("no scan")
    return f, at


def _grid(f: Frame, c: int, alone: bool) -> tuple[int, int]:
    """Columns and rows of blocks that a scan holds of component c."""
    hmax = max(h for h, _, _ in f.components.values())
    vmax = max(v for _, v, _ in f.components.values())
    h, v, _ = f.components[c]
    if alone:
        return -(-(-(-f.width * h // hmax)) // 8), -(-(-(-f.height * v // vmax)) // 8)
    return -(-f.width // (8 * hmax)) * h, -(-f.height // (8 * vmax)) * v


def _intervals(data: np.ndarray, start: int, end: int, count: int, restart: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each restart interval of a scan, and its number of MCUs."""
    if not restart:
        return np.array([start]), np.array([count])
    part = data[start:end]
    ff = np.flatnonzero(part[:-1] == 255) if len(part) > 1 else np.zeros(0, np.int64)
    follow = part[ff + 1]
    marks = ff[(follow >= 0xD0) & (follow <= 0xD7)] + (start + 2)
    n = -(-count // restart)
    if len(marks) < n - 1:
        raise JpegError("restart markers are missing")
    size = np.full(n, restart)
    size[-1] = count - (n - 1) * restart
    return np.append(start, marks[: n - 1]), size


#: In a lookup entry: the block isn't over, or doesn't fit 16 bits.
SLOW = 128


@lru_cache(maxsize=64)
def block_lookup(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16-bit prefix that holds a whole block without AC coefficients: its DC
    difference * 256 + its length; SLOW for any other prefix."""
    prefix = np.arange(1 << 16, dtype=np.int64)
    hit = huffman(*dc).astype(np.int64)
    cat, length = hit & 255, hit >> 8
    room = 16 - length - cat
    fits = (length > 0) & (room > 0)
    room = np.maximum(room, 0)
    v = (prefix >> room) & ((1 << cat) - 1)
    diff = np.where(v < (1 << cat) >> 1, v - (1 << cat) + 1, v)
    end = huffman(*ac).astype(np.int64)[(prefix << (length + cat)) & 0xFFFF]
    fits &= (end > 0) & (end & 255 == 0) & (end >> 8 <= room)
    return np.where(fits, diff * 256 + length + cat + (end >> 8), SLOW).astype(np.int32)


def _slow_blocks(w: np.ndarray, pos: np.ndarray, last: int, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """DC difference, next position and soundness of one block at each position."""
    def take(p: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.minimum(p, last)
        at = p >> 3
        word = (w[at].astype(np.uint64) << np.uint64(24)) | w[at + 3].astype(np.uint64)  # 6 bytes
        word = word << (np.uint64(16) + (p & 7).astype(np.uint64))
        hit = table[word >> np.uint64(48)].astype(np.int64)
        return word, hit & 255, hit >> 8

    word, cat, length = take(pos, dc)
    sound = (length > 0) & (cat <= 11)
    s = np.minimum(cat, 11).astype(np.uint64)
    v = ((word << length.astype(np.uint64)) >> (np.uint64(63) - s)) >> np.uint64(1)
    diff = v.astype(np.int64)
    diff = np.where(diff < (1 << cat) >> 1, diff - (1 << cat) + 1, diff)
    pos = pos + length + cat
    k = np.ones(len(pos), np.int64)
    go = np.arange(len(pos))
    while len(go):  # AC coefficients: only their lengths matter
        _, sym, length = take(pos[go], ac)
        pos[go] += length + (sym & 15)
        sound[go] &= length > 0
        size, run = sym & 15, sym >> 4
        done = sym == 0
        k[go] += np.where(size > 0, run + 1, np.where(run == 15, 16, 0))
        sound[go] &= (k[go] <= 64) & (done | (size > 0) | (run == 15))
        go = go[~done & (k[go] < 64) & sound[go]]
    return diff, pos, sound


def decode_lanes(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, units: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """DC coefficients (unit, MCU, lane) of intervals that share their tables, and whether
    each lane was sound. units: component, DC and AC code of each block of an MCU."""
    # stuffed zeros go first, so that a lane is a plain bit string
    ff = np.flatnonzero(data[:-1] == 255)
    stuffed = ff[data[ff + 1] == 0] + 1
    pos = (starts - np.searchsorted(stuffed, starts)).astype(np.int64) * 8
    b = np.concatenate([np.delete(data, stuffed), np.full(8, 255, np.uint8)])
    w = b[:-2].astype(np.uint32)
    for k in (1, 2):
        w <<= np.uint32(8)
        w |= b[k : len(b) - 2 + k]
    last = (len(w) - 4) * 8
    order = np.argsort(-mcus, kind="stable")
    pos = np.minimum(pos[order], last)
    counts = mcus[order]
    most = int(counts[0])
    out = np.zeros((len(units), most, len(pos)), np.int32)
    good = np.ones(len(pos), bool)
    pred = {c: np.zeros(len(pos), np.int32) for c, _, _ in units}
    tables = [(c, block_lookup(dc, ac), huffman(*dc), huffman(*ac)) for c, dc, ac in units]
    for m in range(most):
        live = int(np.searchsorted(-counts, -m, "left"))  # lanes with more than m MCUs
        for u, (c, quick, dc, ac) in enumerate(tables):
            p = pos[:live]
            word = (w[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            hit = quick[word]
            length = hit & 255
            slow = np.flatnonzero(length == SLOW)
            diff = hit >> 8
            if len(slow):
                diff[slow], at, fine = _slow_blocks(w, p[slow], last, dc, ac)
                good[slow] &= fine
                length[slow] = 0
                p[slow] = at
            p += length
            np.minimum(p, last, out=p)
            pred[c][:live] += diff
            out[u, m, :live] = pred[c][:live]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[:, :, back], good[back]


def thumbnails(media: list[bytes | None]) -> list[list[np.ndarray] | None]:
    """For each stored form, the luminance thumbnails (uint8, rows x columns of blocks) of its
    images; None if it is null, empty, damaged or not baseline JPEG."""
    frames: list[tuple[int, int, Frame]] = []  # media index, number within it
    result: list[list | None] = [None] * len(media)
    base, at = [], 0
    for i, m in enumerate(media):
        base.append(at)
        if m:
            at += len(m)
            try:
                where, found = 0, []
                while where < len(m):
                    f, where = parse(m, where)
                    found.append(f)
            except JpegError:
                continue
            result[i] = [None] * len(found)
            frames += [(i, j, f) for j, f in enumerate(found)]
    if not frames:
        return result
    data = np.frombuffer(b"".join(m for m in media if m), np.uint8)
    groups: dict[tuple, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    luma: list[tuple] = []
    for n, (i, j, f) in enumerate(frames):
        c = f.order[0]
        scan = next((s for s in f.scans if any(x[0] == c for x in s[0])), None)
        if scan is None:
            luma.append(None)
            continue
        use, restart, a, z = scan
        alone = len(use) == 1
        cols, rows = _grid(f, c, alone)
        h, v, q = f.components[c]
        per = [(x, f.components[x][0] * f.components[x][1]) for x, _, _ in use]
        count = cols * rows if alone else (cols // h) * (rows // v)
        luma.append((cols, rows, 1 if alone else h, 1 if alone else v, f.quant.get(q, 1), count))
        try:
            parts = _intervals(data, base[i] + a, base[i] + z, count, restart)
        except JpegError:
            luma[-1] = None
            continue
        key = (use, tuple((x, 1 if alone else k) for x, k in per))
        groups.setdefault(key, []).append((n, *parts))
    planes: dict[int, np.ndarray] = {}
    for (use, per), lanes in groups.items():
        units = []
        for (c, dc, ac), (_, k) in zip(use, per):
            units += [(c, dc, ac)] * k
        dc, sound = decode_lanes(data, np.concatenate([x[1] for x in lanes]), np.concatenate([x[2] for x in lanes]), units)
        at = 0
        for n, starts, size in lanes:
            end = at + len(starts)
            f = frames[n][2]
            mine = [u for u, (c, _, _) in enumerate(units) if c == f.order[0]]
            if sound[at:end].all():
                flat = dc[mine, :, at:end].transpose(2, 1, 0).reshape(-1, len(mine))  # the last interval may be short
                planes[n] = flat[: int(size.sum())]
            at = end
    for n, (i, j, f) in enumerate(frames):
        if result[i] is None:
            continue
        if luma[n] is None or n not in planes:
            result[i] = None
            continue
        cols, rows, h, v, q, count = luma[n]
        x = planes[n].reshape(rows // v, cols // h, v, h).transpose(0, 2, 1, 3).reshape(rows, cols)
        result[i][j] = np.clip(x * q // 8 + 128, 0, 255).astype(np.uint8)
    return result


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash: 8 x 8 box means against the overall mean, 16 hexadecimal digits."""
    h, w = thumb.shape
    t = thumb.astype(np.int64)
    r, c = np.arange(9) * h // 8, np.arange(9) * w // 8
    sums = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(t, axis=0), axis=1, out=sums[1:, 1:])
    lo_r, hi_r = r[:-1], np.maximum(r[1:], r[:-1] + 1)
    lo_c, hi_c = c[:-1], np.maximum(c[1:], c[:-1] + 1)
    box = sums[np.ix_(hi_r, hi_c)] - sums[np.ix_(lo_r, hi_c)] - sums[np.ix_(hi_r, lo_c)] + sums[np.ix_(lo_r, lo_c)]
    area = (hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :]
    bits = (box * h * w >= sums[-1, -1] * area).ravel()
    return np.packbits(bits).tobytes().hex()


def feature(images: list[np.ndarray], sizes: list[tuple[int, int]]) -> str:
    return ",".join(f"{w}x{h}:{thumbnail_hash(t)}" for t, (w, h) in zip(images, sizes))


# -- columns ---------------------------------------------------------------------------


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as stored JPEG images. Null text counts as
    empty; an empty text is one tile of bytes 255. One row per input row, ids as they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.lo, len(p)), pa.array(np.diff(p.offsets)), pa.array(encode(p.data, p.offsets), pa.binary())], ["id", "n_bytes", "media"])

    return arrow(docs.select(id_col, text_col), write, f"id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, media) -> the digests of what is read back, and the feature string:
    width x height : thumbnail hash of each image. Damaged or null media: null digests."""
    kind = media.schema["id"].dataType.simpleString()

    def features(batches):
        for batch in batches:
            for p in pieces(batch.column("media"), 4 << 20):
                rows = [p.row(k) if batch.column("media")[p.lo + k].is_valid else None for k in range(len(p))]
                size, sha, crc, media_size, media_sha, said = [], [], [], [], [], []
                for raw, thumbs in zip(rows, thumbnails(rows)):
                    media_size.append(None if raw is None else len(raw))
                    media_sha.append(None if raw is None else hashlib.sha256(raw).hexdigest())
                    if thumbs is None:
                        for x in (size, sha, crc, said):
                            x.append(None)
                        continue
                    back = b"".join(t.tobytes() for t in thumbs)
                    size.append(len(back))
                    sha.append(hashlib.sha256(back).hexdigest())
                    crc.append(zlib.crc32(back[-32:]))
                    said.append(feature(thumbs, [(t.shape[1] * 8, t.shape[0] * 8) for t in thumbs]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(p.lo, len(p)), batch.column("n_bytes").slice(p.lo, len(p)), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(media_size, pa.int64()), pa.array(media_sha, pa.string()), pa.array(said, pa.string())],
                    ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return arrow(media.select("id", "n_bytes", "media"), features, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
