"""Media columns: a baseline JPEG codec for lossless payloads, and DC-only luminance thumbnails in numpy.

A payload is cut into 64-byte units. A unit is one 8x8 block whose 64 quantised coefficients, in zigzag
order, are its bytes (0..255), so storing and reading it is exact: baseline JPEG loses nothing after
quantisation. A restart marker follows each block, so blocks start on a byte and are decoded side by
side, one coefficient of every block at a step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts

UNIT = 64
WIDTH = 64  # blocks in a row, where there are as many
MOST = 8191  # blocks in a row or column: sides are 16-bit pixel counts
STORED = 1 << 12  # blocks encoded together
CHUNK = 1 << 15  # blocks decoded together

#: Code lengths of the Huffman tables, fitted to text: coefficients of 7, 6 and 8 bits come first.
DC_LENGTHS = {7: 1, 6: 2, 8: 3} | {k: 7 for k in (0, 1, 2, 3, 4, 5, 9, 10, 11)}
AC_LENGTHS = {0x07: 1, 0x06: 2, 0x08: 3, 0x00: 4} | {r << 4 | s: 12 for r in range(16) for s in range(1, 11) if (r, s) not in ((0, 6), (0, 7), (0, 8))} | {0xF0: 12}


def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """BITS, HUFFVAL and the code (value, length) of each symbol, as JPEG assigns them."""
    order = sorted(lengths, key=lambda s: lengths[s])
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts, bytes(order), huffman_codes(counts, bytes(order))


def huffman_codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    codes, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[at]] = (code, size)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def decoding_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for symbol, (code, size) in huffman_codes(counts, symbols).items():
        table[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | symbol
    return table


DC_BITS, DC_VALUES, DC_CODES = canonical(DC_LENGTHS)
AC_BITS, AC_VALUES, AC_CODES = canonical(AC_LENGTHS)


def _code_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    value, size = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
    for s, (c, n) in codes.items():
        value[s], size[s] = c, n
    return value, size


_DC, _AC = _code_arrays(DC_CODES), _code_arrays(AC_CODES)
_SIZE = np.array([int(v).bit_length() for v in range(256)], dtype=np.int64)


def encode_blocks(units: np.ndarray, first: int = 0) -> np.ndarray:
    """Entropy-coded bytes of blocks (n, 64), each followed by its restart marker; `first`: number of the first block in its scan."""
    n = len(units)
    mask = np.zeros((n, 65), dtype=bool)
    mask[:, 0] = True
    np.not_equal(units[:, 1:], 0, out=mask[:, 1:64])
    mask[:, 64] = units[:, 63] == 0
    where = np.flatnonzero(mask)
    row, col = where // 65, where % 65
    value = np.zeros((n, 65), dtype=np.uint8)
    value[:, :64] = units
    value = value.ravel()[where]
    size = _SIZE[value]
    run = np.diff(col, prepend=0) - 1
    dc, eob = col == 0, col == 64
    run[dc | eob] = 0
    symbol = (run & 15) << 4 | size
    code, length = _AC[0][symbol], _AC[1][symbol]
    code[dc], length[dc] = _DC[0][size[dc]], _DC[1][size[dc]]
    long_runs = np.flatnonzero(run > 15)
    if len(long_runs):
        zrl, width = AC_CODES[0xF0]
        for k in range(1, 4):
            at = long_runs[run[long_runs] >= 16 * k]
            code[at] |= np.uint64(zrl) << length[at].astype(np.uint64)
            length[at] += width
    bits = code << size.astype(np.uint64) | value
    length += size
    begins = np.flatnonzero(dc)
    row_bits = np.add.reduceat(length, begins)
    row_bytes = (row_bits + 7) >> 3
    row_at = np.cumsum(row_bytes) - row_bytes
    ends = np.cumsum(length)
    offset = ends - length + (row_at * 8 - (np.cumsum(row_bits) - row_bits))[row]
    total = int(row_bytes.sum())
    words = np.zeros(total // 8 + 2, dtype=np.uint64)
    word, used = offset >> 6, (offset & 63) + length
    over = used > 64
    left = np.where(over, bits >> np.where(over, used - 64, 0).astype(np.uint64), bits << np.where(over, 0, 64 - used).astype(np.uint64))
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.bitwise_or.reduceat(left, heads)
    spill = np.flatnonzero(over)
    words[word[spill] + 1] |= bits[spill] << (128 - used[spill]).astype(np.uint64)
    coded = words.byteswap().view(np.uint8)[:total]
    coded[row_at + row_bytes - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)
    full = coded == 0xFF
    place = np.arange(total) + np.cumsum(full) - full + 2 * np.repeat(np.arange(n), row_bytes)
    out = np.zeros(total + int(full.sum()) + 2 * n, dtype=np.uint8)
    out[place] = coded
    last = row_at + row_bytes - 1
    marks = place[last] + full[last] + 1
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + (first + np.arange(n)) % 8
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int, payload: int) -> bytes:
    """Everything before the scan: one component, quantiser 1, one block a restart interval, the payload's size as a comment."""
    return b"".join((
        b"\xff\xd8", _segment(0xFE, b"payload=%d" % payload), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + DC_BITS + DC_VALUES), _segment(0xC4, b"\x10" + AC_BITS + AC_VALUES),
        _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes((1, 1, 0, 0, 63, 0))),
    ))


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file of each payload. Sizes are positive multiples of 64."""
    out: list[bytes] = []
    group: list[tuple[bytes, int, int]] = []

    def flush() -> None:
        if not group:
            return
        units = np.frombuffer(b"".join(p for p, _, _ in group), dtype=np.uint8).reshape(-1, UNIT)
        coded = encode_blocks(units)
        marks = np.flatnonzero((coded[:-1] == 0xFF) & (coded[1:] >= 0xD0))
        at = done = 0
        for p, w, h in group:
            n = len(p) // UNIT
            part = coded[at : int(marks[done + n - 1]) + 2].copy()
            local = marks[done : done + n] - at + 1
            part[local] = 0xD0 + np.arange(n) % 8
            at, done = at + len(part), done + n
            out.append(finish(p, w, h, part[:-2].tobytes()))
        group.clear()

    def finish(p: bytes, w: int, h: int, scan: bytes) -> bytes:
        n = len(p) // UNIT
        if fill := w * h - n:
            blank = encode_blocks(np.zeros((fill, UNIT), dtype=np.uint8), n)
            scan += bytes((0xFF, 0xD0 + (n - 1) % 8)) + blank[:-2].tobytes()
        return header(8 * w, 8 * h, len(p)) + scan + b"\xff\xd9"

    size = 0
    for p in payloads:
        n = len(p) // UNIT
        w = min(n, max(WIDTH, -(-n // MOST)))
        if w > MOST:
            raise ValueError(f"a payload of {len(p)} bytes is more than one JPEG holds")
        h = -(-n // w)
        if n > STORED:
            flush()
            size = 0
            parts = [encode_blocks(np.frombuffer(p[k * UNIT : (k + STORED) * UNIT], dtype=np.uint8).reshape(-1, UNIT), k) for k in range(0, n, STORED)]
            out.append(finish(p, w, h, b"".join(x.tobytes() for x in parts)[:-2]))
            continue
        if size + n > STORED:
            flush()
            size = 0
        group.append((p, w, h))
        size += n
    flush()
    return out


@dataclass
class Frame:
    """What the markers of a baseline JPEG say, and where its scan lies."""

    width: int = 0
    height: int = 0
    payload: int | None = None
    interval: int = 0
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, dc table, ac table
    at: int = 0


def parse(data: bytes) -> Frame:
    """Read the markers up to the scan of a baseline file (SOF0, one scan)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    frame, at = Frame(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                frame.quantisers[name] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            _, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                frame.tables[body[k] >> 4, body[k] & 15] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            frame.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(b"payload="):
            frame.payload = int(body[8:])
        elif marker == 0xDA:
            frame.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            frame.at = at + 2 + size
            return frame
        at += 2 + size
    raise ValueError("no scan")


def split_scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where each restart interval begins in them."""
    keep = np.ones(len(data), dtype=bool)
    at = np.flatnonzero(data[:-1] == 0xFF)
    after = data[at + 1]
    ends = at[after == 0xD9]
    if len(ends):
        keep[ends[0] :] = False
    keep[at[after == 0] + 1] = False
    marks = at[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    return data[keep], np.concatenate(([0], marks - (np.cumsum(~keep) - ~keep)[marks]))


def decode_lanes(data: np.ndarray, starts: np.ndarray, plan: list[tuple[int, np.ndarray, np.ndarray]], mcus: np.ndarray) -> np.ndarray:
    """Huffman-decode restart intervals side by side.

    plan: (component, DC table, AC table) of each block of an MCU. mcus: MCUs of each interval. Returns
    coefficients (intervals, blocks, 64) in zigzag order; blocks an interval lacks are zero.
    """
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    window = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    limit, lanes = len(window) - 1, len(starts)
    out = np.zeros((lanes, int(mcus.max(initial=0)) * len(plan), 64), dtype=np.int16)
    pos = starts.astype(np.int64) * 8
    pred = np.zeros((lanes, 1 + max(c for c, _, _ in plan)), dtype=np.int64)

    def step(p: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = window[np.minimum(p >> 3, limit)] << (p & 7).astype(np.uint64)
        hit = table[(w >> np.uint64(48)).astype(np.int64)]
        if (hit == 0).any():
            raise ValueError("no such code")
        size, length = hit & 15, hit >> 8
        value = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
        return hit >> 4 & 15, value, p + length + size

    for m in range(int(mcus.max(initial=0))):
        live = np.flatnonzero(mcus > m)
        for b, (component, dc, ac) in enumerate(plan):
            _, diff, pos[live] = step(pos[live], dc)
            pred[live, component] += diff
            out[live, m * len(plan) + b, 0] = pred[live, component]
            lane, p, k = live, pos[live], np.ones(len(live), dtype=np.int64)
            while len(lane):
                run, value, p = step(p, ac)
                k += run
                at = np.flatnonzero(value)
                if (k[at] > 63).any():
                    raise ValueError("a run past the block")
                out[lane[at], m * len(plan) + b, k[at]] = value[at]
                end = (value == 0) & (run != 15)
                k += 1
                end |= k > 63
                if end.any():
                    pos[lane[end]] = p[end]
                    lane, p, k = lane[~end], p[~end], k[~end]
    return out


def decode(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """The frame of each file, and the coefficients (MCUs, blocks of an MCU, 64) of its scan.

    Files of one block a restart interval and the same tables are decoded together.
    """
    frames = [parse(f) for f in files]
    out: list[tuple[Frame, np.ndarray]] = [(f, np.zeros((0, 1, 64), np.int16)) for f in frames]
    cache: dict[tuple[bytes, bytes], np.ndarray] = {}

    def table(f: Frame, kind: int, name: int) -> np.ndarray:
        key = f.tables[kind, name]
        return cache.setdefault(key, decoding_table(*key)) if key not in cache else cache[key]

    waiting: dict[tuple, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def flush(key: tuple) -> None:
        parts = waiting.pop(key, [])
        if not parts:
            return
        f = frames[parts[0][0]]
        plan = [(0, table(f, 0, f.scan[0][1]), table(f, 1, f.scan[0][2]))]
        lengths = np.cumsum([0, *(len(d) for _, d, _ in parts)])
        data = np.concatenate([d for _, d, _ in parts])
        starts = np.concatenate([s + o for (_, _, s), o in zip(parts, lengths, strict=False)])
        blocks = np.concatenate([decode_lanes(*cut(data, starts, k), plan, np.ones(min(CHUNK, len(starts) - k), dtype=np.int64)) for k in range(0, len(starts), CHUNK)])
        at = 0
        for i, _, s in parts:
            out[i] = (frames[i], blocks[at : at + len(s)])
            at += len(s)

    def cut(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = starts[k : k + CHUNK]
        end = starts[k + CHUNK] if k + CHUNK < len(starts) else len(data)
        return data[s[0] : end], s - s[0]

    for i, (f, raw) in enumerate(zip(frames, files, strict=True)):
        data, starts = split_scan(np.frombuffer(raw, dtype=np.uint8)[f.at :])
        shapes = {c: (h, v) for c, h, v, _ in f.components}
        if len(f.scan) == 1 and f.interval == 1:
            key = (f.tables[0, f.scan[0][1]], f.tables[1, f.scan[0][2]])
            waiting.setdefault(key, []).append((i, data, starts))
            if sum(len(s) for _, _, s in waiting[key]) >= CHUNK:
                flush(key)
            continue
        if len(f.scan) == 1:
            total = -(-f.width // 8) * -(-f.height // 8)
            plan = [(0, table(f, 0, f.scan[0][1]), table(f, 1, f.scan[0][2]))]
        else:
            h, v = (max(s[k] for s in shapes.values()) for k in (0, 1))
            total = -(-f.width // (8 * h)) * -(-f.height // (8 * v))
            plan = [(j, table(f, 0, d), table(f, 1, a)) for j, (c, d, a) in enumerate(f.scan) for _ in range(shapes[c][0] * shapes[c][1])]
        each = f.interval or total
        mcus = np.minimum(each, total - each * np.arange(len(starts)))
        blocks = decode_lanes(data, starts, plan, mcus)
        out[i] = (f, np.concatenate([blocks[j, : m * len(plan)] for j, m in enumerate(mcus)]).reshape(total, len(plan), 64))
    for key in list(waiting):
        flush(key)
    return out


def thumbnail(frame: Frame, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance: a pixel for each 8x8 block of the first component."""
    component, _, _ = frame.scan[0]
    _, h, v, q = next(c for c in frame.components if c[0] == component)
    dc = blocks[:, : h * v if len(frame.scan) > 1 else 1, 0].astype(np.int64) * frame.quantisers[q][0]
    pixels = np.clip((dc + 4) // 8 + 128, 0, 255)
    if len(frame.scan) == 1:
        return pixels.reshape(-(-frame.height // 8), -(-frame.width // 8)).astype(np.uint8)
    across = -(-frame.width // (8 * max(c[1] for c in frame.components)))
    grid = pixels.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    return grid[: -(-frame.height // 8), : -(-frame.width // 8)].astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64-bit difference hash: an 8x9 grid of cell means, each compared with its right neighbour."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1), dtype=np.int64)
    total[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    y0, x0 = np.arange(8) * h // 8, np.arange(9) * w // 9
    y1, x1 = np.maximum(y0 + 1, np.arange(1, 9) * h // 8), np.maximum(x0 + 1, np.arange(1, 10) * w // 9)
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    mean = sums * 1000 // np.outer(y1 - y0, x1 - x0)
    return int(np.packbits(mean[:, 1:] > mean[:, :-1]).view(">u8")[0])


def payload_of(frame: Frame, blocks: np.ndarray) -> bytes:
    return blocks.reshape(-1)[: frame.payload].astype(np.uint8).tobytes()


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("media", T.BinaryType())]
    + [T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("thumbnail_hash", T.StringType()), T.StructField("thumbnail_crc32", T.LongType())]
)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every whole text of docs (doc_id, text) as a JPEG file and read it back.

    Columns: doc_id, n_bytes, payload (as read back), media (the file), its width and height in pixels,
    and the hash and CRC of its DC-only luminance thumbnail. The payload is the text's UTF-8 with zero
    bytes added up to a positive multiple of 64; null and empty texts are 64 zero bytes. Every row,
    repeated or with a null id, gets a row; other columns are ignored. No shuffle; memory is bounded by
    a chunk of blocks and the longest text.
    """

    def rows(part: Iterator[tuple]) -> Iterator[tuple]:
        group: list[tuple[int | None, bytes]] = []
        held = 0
        for doc_id, text in part:
            group.append((doc_id, text or b""))
            held += len(group[-1][1])
            if held >= CHUNK * UNIT:
                yield from described(group)
                group, held = [], 0
        yield from described(group)

    def described(group: list[tuple[int | None, bytes]]) -> Iterator[tuple]:
        files = store([t + bytes(-len(t) % UNIT if t else UNIT) for _, t in group])
        for (doc_id, text), media, (frame, blocks) in zip(group, files, decode(files), strict=True):
            small = thumbnail(frame, blocks)
            yield doc_id, len(text), payload_of(frame, blocks), media, frame.width, frame.height, f"{thumbnail_hash(small):016x}", zlib.crc32(small.tobytes())

    return map_texts(docs, ["doc_id"], rows, SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """The stored files by sizes and hashes; feature is width x height : thumbnail hash : thumbnail CRC."""
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d:%s:%08x", "width", "height", "thumbnail_hash", "thumbnail_crc32").alias("feature"),
        "width",
        "height",
    )
