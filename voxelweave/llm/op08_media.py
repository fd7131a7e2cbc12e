"""Media columns: motion-JPEG in AVI files.

A payload of bytes becomes frames of 24 x 24 blocks, each byte the constant grey
level of one 8 x 8 block. With a quantiser of 8 such a block is one DC
coefficient, level - 128, so baseline JPEG keeps it exactly. Frames are coded
(differences of DC, Huffman), put into RIFF chunks, and listed in ``idx1``.
Reading parses the RIFF tree and the index (without one, the chunks themselves).
Frames of this module's own kind are decoded side by side: step k decodes block
k of all frames at once. Frames of other makers go through a full baseline
decoder: Huffman tables of the frame or the common ones that motion-JPEG may
leave out, all coefficients, inverse cosine transform, several components,
restart marks; shots are found in the luma plane.

Shots end where the histogram (16 levels) of a frame differs from the last by
more than the mean of the preceding ``WINDOW`` differences (of those that are no
cuts themselves) plus ``SIGMAS`` deviations, and by at least ``FLOOR``. Clips are the frames between cuts, with
times at ``FPS`` frames a second.

Defined results: null and empty texts are one frame of bytes 255; equal texts
give equal values; nulls in the media column give no clip rows; a file that is no
AVI of baseline frames of one size gives one row with null clip and the reason.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
WINDOW, SIGMAS, FLOOR = 12, 3.0, 0.08
#: Frames that are coded or decoded side by side.
TOGETHER = 4096

_QUANT = bytes([8] + [1] * 63)
_DC_LENGTHS = bytes([0, 0, 0, 9] + [0] * 12)  # nine categories of 4 bits each
_AC_LENGTHS = bytes([1] + [0] * 15)  # the end of a block: one bit


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + _QUANT)
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * SIDE, 8 * SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + _DC_LENGTHS + bytes(range(9)))
    + _segment(0xC4, b"\x10" + _AC_LENGTHS + b"\0")
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def encode_frames(levels: np.ndarray) -> list[bytes]:
    """levels: frames x 576, uint8 -> the scan of each frame."""
    n = len(levels)
    dc = levels.astype(np.int32) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.zeros(511, np.int32)
    size[:] = [abs(d).bit_length() for d in range(-255, 256)]
    s = size[diff + 255]
    code = ((s << s) | np.where(diff < 0, diff + (1 << s) - 1, diff)) << 1
    length = s + 5
    ends = np.cumsum(length, axis=1)
    bytes_of = (ends[:, -1] + 7) >> 3
    first = np.cumsum(bytes_of) - bytes_of
    at = (first[:, None] << 3) + ends - length
    v = code << (24 - (at & 7) - length)
    # what is left of a frame's last byte is ones
    pad = (-ends[:, -1]) & 7
    idx, v = (at >> 3).ravel(), v.ravel()
    total = int(bytes_of.sum())
    out = sum(np.bincount(idx + k, weights=(v >> (16 - 8 * k)) & 255, minlength=total + 3) for k in range(3)).astype(np.uint8)[:total]
    out[first + bytes_of - 1] |= ((1 << pad) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255)
    raw = np.insert(out, full + 1, 0).tobytes()
    ends_b = first + bytes_of
    ends_b = (ends_b + np.searchsorted(full, ends_b)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends_b], ends_b)]


def write_avi(scans: list[bytes]) -> bytes:
    frames = [HEAD + s + b"\xff\xd9" for s in scans]
    n, largest = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, 8 * SIDE, 8 * SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, 8 * SIDE, 8 * SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * SIDE, 8 * SIDE, 1, 24, b"MJPG", 3 * 64 * FRAME, 0, 0, 0, 0)

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    steps = 8 + sizes + (sizes & 1)
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # every frame stands alone
    index[:, 2] = 4 + np.cumsum(steps) - steps
    index[:, 3] = sizes
    movi = b"movi" + b"".join(chunk(b"00dc", f) for f in frames)
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes()))


def _chunks(avi: bytes, at: int, end: int):
    """(name, where the body begins, where it ends) of the chunks of a list."""
    while at + 8 <= end:
        size = int.from_bytes(avi[at + 4 : at + 8], "little")
        yield avi[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def frame_places(avi: bytes) -> list[tuple[int, int]]:
    """(from, to) of every frame, by the index."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index = None, None
    for name, a, b in _chunks(avi, 12, len(avi)):
        if name == b"LIST" and avi[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = np.frombuffer(avi, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4).astype(np.int64)
    if movi is None:
        raise ValueError("no frames")
    if index is None:
        return [(a, b) for name, a, b in _chunks(avi, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    index = index[np.isin(index[:, 0] >> 16, [int.from_bytes(n, "little") for n in (b"dc", b"db")])]
    if not len(index):
        return []
    # offsets count from the list's name, or with some makers from the file's begin
    first = int(index[0, 2])
    base = movi[0] if avi[movi[0] + first : movi[0] + first + 4] == int(index[0, 0]).to_bytes(4, "little") else 0
    start = base + index[:, 2] + 8
    if int(start[-1] + index[-1, 3]) > len(avi):
        raise ValueError("the index points outside of the file")
    return list(zip(start.tolist(), (start + index[:, 3]).tolist()))


def frame_rate(avi: bytes) -> float:
    """Frames a second by the main header."""
    at = avi.find(b"avih", 12, 4096)
    step = int.from_bytes(avi[at + 8 : at + 12], "little") if at > 0 else 0
    return 1e6 / step if step else float(FPS)


def _runs(first: int, rows) -> list[int]:
    return [r * 16 + s for r in rows for s in range(first, 11)]


# The common Huffman tables of JPEG (how many codes of each length,
# then the values), which motion-JPEG frames may leave out.
COMMON = {
    (0, 0): ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))),
    (0, 1): ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12))),
    (1, 0): (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        list(bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"))
        + _runs(3, range(4, 8)) + _runs(3, [8]) + _runs(2, range(9, 14)) + _runs(1, range(14, 16)),
    ),
    (1, 1): (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        list(bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"))
        + _runs(3, range(4, 8)) + _runs(2, range(8, 16)),
    ),
}
#: Where the k-th coefficient of the zigzag stands: diagonals, in turns up and down.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_COS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _codes(counts, values) -> dict[tuple[int, int], int]:
    """(length, code) -> value."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[bits, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_jpeg(frame: bytes) -> list[np.ndarray]:
    """The planes (rows x columns, uint8) of a baseline frame's components, each
    in its own resolution."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    tables = {k: _codes(*v) for k, v in COMMON.items()}
    quant, parts, restart, at, size = {}, [], 0, 2, None
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame without a scan")
        marker, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                quant[body[k] & 15] = values
                k += 1 + 64 * (1 + wide)
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 8 bits are read")
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = list(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = _codes(counts, list(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
    if not parts or not size or body[0] != len(parts) or 0 in size:
        raise ValueError("one scan of all components is read")
    for i in range(body[0]):
        part = next((p for p in parts if p["id"] == body[1 + 2 * i]), None)
        if part is None or part["q"] not in quant:
            raise ValueError("a component without tables")
        part["dc"], part["ac"] = tables.get((0, body[2 + 2 * i] >> 4)), tables.get((1, body[2 + 2 * i] & 15))
    high, wide = max(p["v"] for p in parts), max(p["h"] for p in parts)
    rows, columns = -(-size[0] // (8 * high)), -(-size[1] // (8 * wide))
    if len(parts) == 1:  # a single component is not interleaved
        parts[0]["h"] = parts[0]["v"] = high = wide = 1
        rows, columns = -(-size[0] // 8), -(-size[1] // 8)
    for p in parts:
        p["blocks"] = np.zeros((rows * p["v"], columns * p["h"], 64), np.int64)
        p["last"] = 0
    # pieces between restart marks, without stuffed zeros
    scan = frame[at:]
    stop, pieces, begin = 0, [], 0
    while (stop := scan.find(b"\xff", stop)) >= 0 and stop + 1 < len(scan):
        nxt = scan[stop + 1]
        if 0xD0 <= nxt <= 0xD7 or nxt not in (0, 0xFF):
            pieces.append(scan[begin:stop])
            begin = stop + 2
            if not 0xD0 <= nxt <= 0xD7:
                break
        stop += 2 if nxt != 0xFF else 1
    else:
        pieces.append(scan[begin:])
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
    bits = have = place = 0
    data = pieces[0] if pieces else b""

    def need(n: int) -> None:
        nonlocal bits, have, place
        while have < n:
            if place >= len(data) + 8:
                raise ValueError("a scan ends too early")
            bits = (bits << 8 | (data[place] if place < len(data) else 0xFF)) & 0xFFFFFFFFFF
            place, have = place + 1, have + 8

    def take(n: int) -> int:
        nonlocal have
        need(n)
        have -= n
        return bits >> have & ((1 << n) - 1)

    def value(table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code of no table")

    def signed(n: int) -> int:
        x = take(n) if n else 0
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    nth = 0
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            nth += 1
            if nth >= len(pieces):
                raise ValueError("a scan ends too early")
            data, bits, have, place = pieces[nth], 0, 0, 0
            for p in parts:
                p["last"] = 0
        y, x = divmod(unit, columns)
        for p in parts:
            if p["dc"] is None or p["ac"] is None:
                raise ValueError("a component without tables")
            for dy in range(p["v"]):
                for dx in range(p["h"]):
                    block = p["blocks"][y * p["v"] + dy, x * p["h"] + dx]
                    p["last"] += signed(value(p["dc"]))
                    block[0], k = p["last"], 1
                    while k < 64:
                        run, n = divmod(value(p["ac"]), 16)
                        if n == 0 and run < 15:
                            break
                        k += run
                        if k > 63:
                            raise ValueError("a block of more than 64 coefficients")
                        if n:
                            block[k] = signed(n)
                        k += 1
    planes = []
    for p in parts:
        plain = np.zeros(p["blocks"].shape, float)
        plain[:, :, ZIGZAG] = p["blocks"] * quant[p["q"]]
        r, c = plain.shape[:2]
        pixels = _COS @ plain.reshape(r, c, 8, 8) @ _COS.T
        pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * r, 8 * c)
        planes.append(pixels[: -(-size[0] * p["v"] // high), : -(-size[1] * p["h"] // wide)])
    return planes


def read_head(frame: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Where the scan begins, blocks, quantiser, and for every 16 bits ahead
    the DC difference and the bits that a block takes."""
    at, quant, dc, ac, blocks = 2, {}, {}, {}, 0
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant[body[0] & 15] = body[1]
        elif marker == 0xC0:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or body[5] != 1:
                raise ValueError("one component of 8 bits is read")
            blocks = (-(-high // 8)) * (-(-wide // 8))
        elif marker == 0xC4:
            codes, code, k = [], 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    codes.append((code, bits, body[k]))
                    code, k = code + 1, k + 1
                code <<= 1
            (ac if body[0] >> 4 else dc)[body[0] & 15] = codes
        elif marker == 0xDA:
            break
    end = [(c, b) for c, b, v in ac[0] if v == 0]
    diff, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
    ahead = np.arange(1 << 16)
    for code, bits, s in dc[0]:
        m = np.flatnonzero(ahead >> (16 - bits) == code)
        if bits + s + end[0][1] > 16:
            continue
        x = (ahead[m] >> (16 - bits - s)) & ((1 << s) - 1)
        diff[m] = np.where(x >> max(s - 1, 0) == 0, x - (1 << s) + 1, x) if s else 0
        ok = (ahead[m] >> (16 - bits - s - end[0][1])) & ((1 << end[0][1]) - 1) == end[0][0]
        length[m] = np.where(ok, bits + s + end[0][1], 0)
    return at, blocks, quant[0], diff, length


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Frames of one kind of header -> frames x blocks, the blocks' levels."""
    at, blocks, quant, diff, length = read_head(frames[0])
    scans = [f[at:-2] for f in frames]
    raw = np.frombuffer(b"".join(scans), np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    stuffed = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1
    plain = np.delete(raw, stuffed)
    starts = np.concatenate([[0], ends[:-1]])
    pos = (starts - np.searchsorted(stuffed, starts)) << 3
    b = np.concatenate([plain, np.full(4, 255, np.uint8)]).astype(np.uint32)
    ahead = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    out = np.empty((blocks, len(frames)), np.int32)
    dc = np.zeros(len(frames), np.int32)
    for k in range(blocks):
        x = (ahead[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        n = length[x]
        dc = dc + diff[x]
        pos = pos + n
        out[k] = dc
        if not n.all():
            raise ValueError("a block holds more than its DC coefficient")
    levels = out.T * quant // 8 + 128
    return np.clip(levels, 0, 255).astype(np.uint8)


def read_avi(avi: bytes) -> np.ndarray:
    """Frames x samples: the blocks' levels of this module's own frames, else
    the pixels of the luma plane."""
    frames = [avi[a:b] for a, b in frame_places(avi)]
    if all(f.startswith(HEAD) for f in frames):
        parts = [decode_frames(frames[k : k + TOGETHER]) for k in range(0, len(frames), TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros((0, FRAME), np.uint8)
    planes = [decode_jpeg(f)[0] for f in frames]
    if len({p.shape for p in planes}) > 1:
        raise ValueError("frames of several sizes")
    return np.stack([p.ravel() for p in planes])


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def store(payloads: list[bytes]) -> list[bytes]:
    """One AVI file for each payload; frames of all are coded together."""
    levels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    scans: list[bytes] = []
    for k in range(0, len(levels), TOGETHER):
        scans += encode_frames(levels[k : k + TOGETHER])
    out, at = [], 0
    for p in payloads:
        out.append(write_avi(scans[at : at + len(p) // FRAME]))
        at += len(p) // FRAME
    return out


def load(files: list[bytes]) -> list[np.ndarray]:
    """The levels (frames x blocks) of each file, decoded side by side."""
    if not files:
        return []
    places = [frame_places(f) for f in files]
    frames = [f[a:b] for f, p in zip(files, places) for a, b in p]
    head = len(HEAD)
    if any(f[:head] != HEAD for f in frames):
        return [read_avi(f) for f in files]
    levels = np.concatenate([decode_frames(frames[k : k + TOGETHER]) for k in range(0, len(frames), TOGETHER)])
    return np.split(levels, np.cumsum([len(p) for p in places])[:-1])


def cuts(levels: np.ndarray) -> np.ndarray:
    """Frames that begin a shot, the first included."""
    n = len(levels)
    if n < 2:
        return np.zeros(1, np.int64)
    hist = np.bincount((np.arange(n)[:, None] * 16 + (levels >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2.0 * levels.shape[1])
    i = np.arange(n - 1)
    a = np.maximum(0, i - WINDOW)
    counts, found = np.ones(n - 1, bool), np.zeros(n - 1, bool)
    for _ in range(2):  # the second time, differences that are cuts set no standard
        s, q, w = (np.concatenate([[0], np.cumsum(x * counts)]) for x in (d, d * d, np.ones(n - 1)))
        m = np.maximum(1, w[i] - w[a])
        mean = (s[i] - s[a]) / m
        dev = np.sqrt(np.maximum(0, (q[i] - q[a]) / m - mean * mean))
        found |= (d > mean + SIGMAS * dev + 1e-9) & (d >= FLOOR)
        counts = ~found
    return np.concatenate([[0], np.flatnonzero(found) + 1])


def clips(levels: np.ndarray, fps: float = FPS) -> list[tuple[int, int, int, float, float, float]]:
    """(clip, first frame, end frame, begins at s, ends at s, mean level)."""
    if not len(levels):
        return []
    c = cuts(levels)
    ends = [*c[1:].tolist(), len(levels)]
    return [(k, a, b, a / fps, b / fps, float(levels[a:b].mean())) for k, (a, b) in enumerate(zip(c.tolist(), ends))]


def _groups(sizes: list[int]):
    """Ranges of rows of about TOGETHER frames."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > TOGETHER * FRAME:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def media_column(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, media: the AVI file of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            payloads = [payload_of(t) for t in batch.column(1).to_pylist()]
            for a, b in _groups([len(p) for p in payloads]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(store(payloads[a:b]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrow_map, run, "doc_id long, media binary")


def _clips_of(avi: bytes) -> list[tuple]:
    try:
        return [(*c, None) for c in clips(read_avi(avi), frame_rate(avi))]
    except (ValueError, IndexError, KeyError) as e:  # what broken bytes lead to
        return [(None, None, None, None, None, None, str(e) or type(e).__name__)]


def clip_rows(media: DataFrame) -> DataFrame:
    """media (doc_id, media) -> one row for each clip; ``error`` says why a
    file could not be read."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "clip", "first_frame", "end_frame", "begins_s", "ends_s", "mean_level", "error"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        for batch in batches:
            rows = [(d, *c) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if m is not None for c in _clips_of(m)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return media.select("doc_id", "media").transform(arrow_map, run, "doc_id long, clip int, first_frame int, end_frame int, begins_s double, ends_s double, mean_level double, error string")


def _digest(batches):
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _groups([len(t or "") for t in texts]):
            some = texts[a:b]
            sizes = [len((t or "").encode("utf-8", "replace")) for t in some]
            files = store([payload_of(t) for t in some])
            rows = []
            for d, n, avi, levels in zip(ids[a:b], sizes, files, load(files)):
                back = levels.tobytes()
                c = clips(levels)
                where = zlib.crc32(np.array([x[1] for x in c], "<u4").tobytes())
                longest = max(c, key=lambda x: (x[2] - x[1], -x[0]))
                feature = f"frames={len(levels)};clips={len(c)};cuts={where:08x};longest={longest[3]:.2f}-{longest[4]:.2f};level={longest[5]:.3f}"
                rows.append((d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), feature))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def op8_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return docs.transform(arrow_map, _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
