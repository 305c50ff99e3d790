"""Baseline JPEG columns: marker parsing, Huffman decoding in numpy, luminance thumbnails from DC coefficients alone.

Decoding runs in lockstep: the restart intervals of all images of a batch that share their tables advance together, one
Huffman symbol a step, so every step is a handful of numpy calls over all intervals. An image without restart markers
is one interval. AC coefficients are read over, only DC values are kept: one sample for each 8 x 8 block.

Encoding is the inverse for block values: a payload's bytes become the DC values of a grey image, 64 blocks wide, one
restart interval for each row of blocks. With a DC quantiser of 8 the thumbnail's samples are the payload's bytes
exactly. A payload longer than the format's tallest image goes on in further images of the same stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column, texts

#: Bytes that are packed or read in one go: the arrays stay in a core's cache.
SLICE = 1 << 19
#: Blocks in a row, and rows of blocks in an image (the format holds 65,535 lines at most).
WIDE, TALL = 64, 8191

# Fixed values of the published format: DC luminance code lengths (counts for 1 to 16 bits) and their categories.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: AC: end of block alone, in one bit.
AC_BITS = (1,) + (0,) * 15
AC_VALUES = (0,)

SOI, EOI, SOS, DQT, DHT, DRI, SOF0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0


class BadImage(ValueError):
    """A stream that isn't baseline JPEG, or is cut."""


def _codes(bits) -> list[tuple[int, int]]:
    """(code, length) in order of the table's values."""
    out, code = [], 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _lookup(bits, values) -> np.ndarray:
    """For each 16-bit window: length << 8 | value; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for (code, length), value in zip(_codes(bits), values):
        if code >> length:
            raise BadImage("code lengths overflow")
        low = code << (16 - length)
        table[low : low + (1 << (16 - length))] = length << 8 | value
    return table


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For each 16-bit window that holds a whole DC-only block: difference << 8 | bits; 0 for any other."""
    w = np.arange(1 << 16, dtype=np.int64)
    length, s = dc >> 8, dc & 255
    bits = (w << length & 0xFFFF) >> np.maximum(16 - s, 0)
    diff = np.where((s > 0) & (bits < (1 << np.maximum(s, 1) - 1)), bits - (1 << s) + 1, bits)
    end = ac[w << np.minimum(length + s, 16) & 0xFFFF]
    total = length + s + (end >> 8)
    return np.where((length > 0) & (end > 0) & (end & 255 == 0) & (total <= 16), diff << 8 | total, 0).astype(np.int32)


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: the bits of a whole block (DC code, magnitude, end of block) and their number."""
    dc, (eob, eob_len) = _codes(DC_BITS), _codes(AC_BITS)[0]
    value, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        word = (code << n | (d if d >= 0 else d + (1 << n) - 1)) << eob_len | eob
        value[d + 255], size[d + 255] = word, length + n + eob_len
    return value, size


_VALUE, _SIZE = _block_codes()


@lru_cache(maxsize=64)
def _tables(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one_dc, one_ac = _lookup(*dc), _lookup(*ac)
    return _whole_blocks(one_dc, one_ac), one_dc, one_ac


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(DQT, b"\0" + b"\x08" + b"\1" * 63) + _segment(DHT, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES)) + _segment(DHT, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES)) + _segment(DRI, struct.pack(">H", WIDE))
_SCAN = _segment(SOS, b"\1\1\0\0\x3f\0")


def _head(rows: int) -> bytes:
    return b"\xff\xd8" + _TABLES + _segment(SOF0, struct.pack(">BHHB", 8, rows * 8, WIDE * 8, 1) + b"\1\x11\0") + _SCAN


def pack(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload; a payload is a positive multiple of 64 bytes long."""
    rows = [len(x) // WIDE for x in payloads]
    if not rows:
        return []
    if any(len(x) % WIDE or not x for x in payloads):
        raise ValueError(f"a payload must be a positive multiple of {WIDE} bytes")
    images = [min(TALL, n - a) for n in rows for a in range(0, n, TALL)]
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, WIDE) - 128
    diff = np.diff(samples, axis=1, prepend=np.int16(0)) + 255
    size = np.zeros((len(diff), WIDE + 1), np.int64)
    size[:, :WIDE] = _SIZE[diff]
    size[:, WIDE] = -size.sum(1) % 8
    value = np.empty((len(diff), WIDE + 1), np.uint64)
    value[:, :WIDE] = _VALUE[diff]
    value[:, WIDE] = (1 << size[:, WIDE].astype(np.uint64)) - 1  # ones up to the next byte
    ends = np.cumsum(size.ravel())
    first = (ends.reshape(size.shape)[:, -1] >> 3)  # the byte behind each interval
    begin = ends - size.ravel()
    word, room = begin >> 6, 64 - (begin & 63) - size.ravel()
    flat = value.ravel()
    high = np.where(room >= 0, flat << np.maximum(room, 0).astype(np.uint64), flat >> np.maximum(-room, 0).astype(np.uint64))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    words[word[starts]] = np.bitwise_or.reduceat(high, starts)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= flat[over] << (64 + room[over]).astype(np.uint64)
    coded = words.byteswap().view(np.uint8)[: int(first[-1])]
    # a zero byte behind every 0xFF, a restart marker before every interval but an image's first
    opens = np.zeros(len(diff), bool)
    opens[np.cumsum([0, *images[:-1]])] = True
    stuffed = coded == 255
    marked = np.repeat(2 * np.cumsum(~opens), np.diff(first, prepend=0))
    place = np.arange(len(coded)) + np.cumsum(stuffed) - stuffed + marked
    out = np.zeros(int(place[-1]) + 2, np.uint8)
    out[place] = coded
    head = np.concatenate([[0], first[:-1]])
    number = np.arange(len(diff)) - np.repeat(np.flatnonzero(opens), images)
    at = place[head[~opens]]
    out[at - 2], out[at - 1] = 255, 0xD0 + (number[~opens] - 1) % 8
    edge = place[first - 1] + 1 + stuffed[first - 1]
    last = np.cumsum(images) - 1
    scans = [out[a:b].tobytes() for a, b in zip(place[head[np.flatnonzero(opens)]], edge[last])]
    made = iter([_head(n) + x + b"\xff\xd9" for n, x in zip(images, scans)])
    return [b"".join(next(made) for _ in range(0, n, TALL)) for n in rows]


class _Image:
    """One frame: its tables, layout and entropy-coded segment."""

    __slots__ = ("height", "interval", "key", "mcus", "order", "parts", "quant", "scan", "width")


def _parse(data: bytes, start: int, ends: np.ndarray) -> tuple[_Image, int]:
    """The frame that begins at start, and the place behind it. ends: where markers stand that end a scan."""
    if data[start : start + 2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at, image, quant, huff, frame = start + 2, _Image(), {}, {}, None
    image.interval = 0
    while True:
        while at + 1 < len(data) and data[at] == 255 and data[at + 1] == 255:
            at += 1
        if at + 4 > len(data) or data[at] != 255:
            raise BadImage("no marker")
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if len(body) != length - 2:
            raise BadImage("cut segment")
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            image.interval = struct.unpack_from(">H", body)[0]
        elif marker == SOF0 or marker == 0xC1:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8 or not image.height or not image.width:
                raise BadImage("not 8-bit, or empty")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise BadImage("not baseline")
        elif marker == SOS:
            break
    if frame is None or body[0] != len(frame):
        raise BadImage("not one interleaved scan")
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    most_h, most_v = max(c[1] for c in frame), max(c[2] for c in frame)
    if len(frame) == 1:  # a lone component isn't interleaved: its blocks stand in rows
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        most_h = most_v = 1
    across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    image.mcus, image.parts, image.quant = across * down, (across, down, frame[0][1], frame[0][2]), quant[frame[0][3]]
    try:
        image.order = tuple((k, huff[tables[c[0]] >> 4], huff[16 | tables[c[0]] & 15]) for k, c in enumerate(frame) for _ in range(c[1] * c[2]))
    except KeyError:
        raise BadImage("a table is missing") from None
    image.key = image.order
    stop = ends[np.searchsorted(ends, at)] if len(ends) and ends[-1] >= at else None
    if stop is None:
        raise BadImage("the scan doesn't end")
    image.scan = (at, int(stop))
    return image, int(stop)


def _lockstep(images: list[_Image], data: np.ndarray) -> list[np.ndarray | None]:
    """The first component's DC values of images that share their tables, in the order of the scan; None for a broken one."""
    order = images[0].order
    tables = {(dc, ac): _tables(dc, ac) for _, dc, ac in order}
    parts, begins, counts, owner, base = [], [], [], [], 0
    bad = np.zeros(len(images), bool)
    for k, x in enumerate(images):
        raw = data[x.scan[0] : x.scan[1]]
        ff = np.flatnonzero(raw == 255)
        ff = ff[ff + 1 < len(raw)]
        follow = raw[ff + 1]
        marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        gone = np.zeros(len(raw), bool)
        gone[ff[follow == 0] + 1] = True
        gone[marks] = gone[marks + 1] = True
        step = x.interval or x.mcus
        want = -(-x.mcus // step)
        if len(marks) + 1 != want:
            bad[k] = True
            continue
        clean = raw[~gone]
        shift = np.cumsum(gone)
        starts = np.concatenate([[0], marks + 2 - shift[marks + 1]]) if len(marks) else np.zeros(1, np.int64)
        parts.append(clean)
        begins.append(starts + base)
        sizes = np.full(want, step)
        sizes[-1] = x.mcus - step * (want - 1)
        counts.append(sizes)
        owner.append(np.full(want, k))
        base += len(clean)
    if not parts:
        return [None] * len(images)
    buf = np.concatenate([*parts, np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:]
    begins, counts, owner = np.concatenate(begins), np.concatenate(counts), np.concatenate(owner)
    rank = np.argsort(-counts, kind="stable")  # those with units left come first
    if len(buf) >= 1 << 27:
        raise BadImage("too long for one batch")
    pos, left = (begins[rank] * 8).astype(np.int32), counts[rank]
    limit = np.int32((len(buf) - 4) * 8 - 1)
    own = sum(1 for k, *_ in order if k == 0)
    got = np.zeros((int(left[0]) * own, len(rank)), np.int32)
    last = {k: np.zeros(len(rank), np.int32) for k, *_ in order}
    broken = np.zeros(len(rank), bool)
    falls = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # how many have more than m units

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF

    def one_block(i: np.ndarray, pred: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> None:
        """Blocks with AC coefficients, or with more bits than a window: symbol by symbol."""
        p = pos[i].astype(np.int64)
        found = dc[peek(p)]
        broken[i] |= found == 0
        s = np.minimum(found & 255, 16)
        p = np.minimum(p + (found >> 8), limit)
        bits = ((window[p >> 3].astype(np.int64) << (p & 7)) & 0xFFFFFFFF) >> (32 - s)
        pred[i] += np.where((s > 0) & (bits < (1 << np.maximum(s, 1) - 1)), bits - (1 << s) + 1, bits).astype(np.int32)
        p, coef, live = p + s, np.ones(len(i), np.int64), np.arange(len(i))
        while len(live):
            here = np.minimum(p[live], limit)
            found = ac[peek(here)]
            value = found & 255
            p[live] = here + (found >> 8) + (value & 15)
            coef[live] += (value >> 4) + 1
            broken[i[live]] |= (found == 0) | (value != 0) & (coef[live] > 64)
            live = live[(found != 0) & (value != 0) & (coef[live] < 64)]
        pos[i] = np.minimum(p, limit)

    for m in range(int(left[0])):
        n, place = int(falls[m]), m * own
        for k, dc, ac in order:
            at, pred = pos[:n], last[k]
            blocks, one_dc, one_ac = tables[dc, ac]
            found = blocks[peek(at)]
            pred[:n] += found >> 8
            at += found & 255
            np.minimum(at, limit, out=at)
            if not found.all():
                one_block(np.flatnonzero(found == 0), pred, one_dc, one_ac)
            if k == 0:
                got[place, :n] = pred[:n]
                place += 1
    got = got.T
    over = np.concatenate([begins[1:], [base]])[rank] * 8  # no interval may read beyond the next one's begin
    broken |= pos > over
    bad[np.unique(owner[rank[broken]])] = True
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    out: list[np.ndarray | None] = []
    first = np.searchsorted(owner, np.arange(len(images) + 1))
    for k in range(len(images)):
        rows = back[first[k] : first[k + 1]]
        if bad[k] or not len(rows):
            out.append(None)
        elif len(rows) == 1 or counts[first[k + 1] - 1] == counts[first[k]]:
            out.append(got[rows, : counts[first[k]] * own].ravel())
        else:
            out.append(np.concatenate([got[r, : c * own] for r, c in zip(rows, counts[first[k] : first[k + 1]])]))
    return out


def thumbnails(streams: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """For each stream the frames' width, height and DC-only luminance thumbnail; None if it's null, broken or not baseline."""
    parsed: list[list[_Image] | None] = []
    offsets, base = [], 0
    whole = np.frombuffer(b"".join(x or b"" for x in streams), np.uint8)
    for data in streams:
        offsets.append(base)
        if not data:
            parsed.append(None)
            continue
        own = whole[base : base + len(data)]
        ff = np.flatnonzero(own[:-1] == 255)
        follow = own[ff + 1]
        ends = ff[(follow != 0) & (follow != 255) & ((follow < 0xD0) | (follow > 0xD7))]
        found, at = [], 0
        try:
            while at < len(data):
                image, at = _parse(data, at, ends)
                if data[at : at + 2] != b"\xff\xd9":
                    raise BadImage("no end of image")
                at += 2
                image.scan = (image.scan[0] + base, image.scan[1] + base)
                found.append(image)
            parsed.append(found)
        except (BadImage, struct.error, IndexError, KeyError):
            parsed.append(None)
        base += len(data)
    groups: dict[tuple, list[_Image]] = {}
    for x in (x for found in parsed for x in found or ()):
        groups.setdefault(x.key, []).append(x)
    dc: dict[int, np.ndarray | None] = {}
    for group in groups.values():
        try:
            values = _lockstep(group, whole)
        except BadImage:
            values = [None] * len(group)
        dc |= {id(x): v for x, v in zip(group, values)}
    out: list[list[tuple[int, int, np.ndarray]] | None] = []
    for found in parsed:
        if found is None or any(dc[id(x)] is None for x in found):
            out.append(None)
            continue
        frames = []
        for x in found:
            across, down, h, v = x.parts
            grid = dc[id(x)].reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h)
            grid = grid[: -(-x.height // 8) or None, : -(-x.width // 8) or None] if len(x.order) == 1 else grid
            frames.append((x.width, x.height, np.clip((grid.astype(np.int64) * x.quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)))
        out.append(frames)
    return out


def _cells(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where eight cells over n samples begin, and how many samples each has; with fewer than eight, samples repeat."""
    begin = np.arange(8) * n // 8
    return begin, np.maximum(np.diff(begin, append=n), 1)


def thumbnail_hash(grid: np.ndarray) -> str:
    """64 bits, one for each cell of 8 x 8: is the cell's mean above the thumbnail's."""
    (rows, tall), (cols, wide) = _cells(grid.shape[0]), _cells(grid.shape[1])
    sums = np.add.reduceat(np.add.reduceat(grid, cols, 1, np.int64), rows, 0)
    return np.packbits(sums * grid.size > np.outer(tall, wide) * grid.sum(dtype=np.int64)).tobytes().hex()


def feature(frames: list[tuple[int, int, np.ndarray]]) -> str:
    """width x height of each frame and its thumbnail's hash, frames joined by commas."""
    return ",".join(f"{w}x{h}:{thumbnail_hash(grid)}" for w, h, grid in frames)


def image_features(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, frames, width, height (of the first frame), thumbnail binary (first frame, row by row), feature.

    Null, cut, non-baseline or otherwise broken streams get nulls in all but doc_id. Repeated rows stay.
    """

    def part(batch: pa.RecordBatch) -> dict:
        found = thumbnails(column(batch, "media").to_pylist())
        pick = lambda f: [f(x) if x else None for x in found]
        return {"doc_id": column(batch, "doc_id"), "frames": pick(len), "width": pick(lambda x: x[0][0]), "height": pick(lambda x: x[0][1]), "thumbnail": pick(lambda x: x[0][2].tobytes()), "feature": pick(feature)}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")), part, f"doc_id {kind}, frames int, width int, height int, thumbnail binary, feature string", text="media", limit=SLICE)


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDE if payload else WIDE)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media binary: every whole text as a JPEG stream whose thumbnail is the text. Null counts as empty."""

    def part(batch: pa.RecordBatch) -> dict:
        raw = texts(batch)
        return {"doc_id": column(batch, "doc_id"), "n_bytes": [len(x) for x in raw], "media": pack([padded(x) for x in raw])}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), part, f"doc_id {kind}, n_bytes long, media binary", limit=SLICE)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text as JPEG and describe what the stored bytes give back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media). The
    payload's columns come from the decoded stream alone; a stream that doesn't decode is an error, as that would be a
    loss. Null and empty texts are 64 zero bytes. Equal texts give equal values; repeated rows stay.
    """

    def part(batch: pa.RecordBatch) -> dict:
        raw = texts(batch)
        media = pack([padded(x) for x in raw])
        found = thumbnails(media)
        back = [b"".join(grid.tobytes() for _, _, grid in x) for x in found]
        return {
            "doc_id": column(batch, "doc_id"),
            "n_bytes": [len(x) for x in raw],
            "payload_bytes": [len(x) for x in back],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back],
            "tail_crc32": [zlib.crc32(x[-WIDE:]) for x in back],
            "media_bytes": [len(x) for x in media],
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in media],
            "feature": [feature(x) for x in found],
            **({"media": media} if keep_media else {}),
        }

    kind = df.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), part, shape + ", media binary" * keep_media, limit=SLICE)
