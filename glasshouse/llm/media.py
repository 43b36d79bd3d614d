"""Media columns: AVI motion-JPEG.

Reading: the RIFF chunks and the idx1 index give the frames; each is a baseline intra-coded JPEG.  Shots are
cut where the histogram difference of neighbouring frames rises above an adaptive threshold (mean and
spread of the differences before it), which yields timed clips.

Writing, losslessly: a sample of the payload is the DC coefficient of one flat 8x8 block.  With a
quantiser of 8 the coefficient is the sample less 128 exactly, and any JPEG decoder gives the sample
for all 64 pixels.  The Huffman table gives size class c a code of 9 - c bits, so a block always takes
10 bits with its end mark; frames of that kind are decoded side by side, others bit by bit.

Reading takes baseline frames with or without their own Huffman tables, with restart intervals, subsampled components and
thumbnails, and files of several RIFF parts (beyond 1 GB).

Nulls: a null text is empty, and its payload one frame of padding; a null media value has no clips and
null features, as has one that cannot be decoded, however it is damaged, with the reason in `error`.  Long texts are stored whole.  A null doc_id stays null.  Repeated rows get
equal values.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasshouse.llm.common import buffers, steps, strings

SIDE = 24  # blocks, and so samples, along a frame's edge
FRAME = SIDE * SIDE
PAD = 255
FPS = 25
#: Fixed values of the JPEG format: the zigzag order of coefficients, by row * 8 + column.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))

#: Fixed values of the JPEG format: the tables that motion-JPEG frames without their own use, as the number of codes of each length and the
#: first symbols; the symbols not named follow in order.
USUAL = {
    0x00: ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", ""),
    0x01: ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", ""),
    0x10: ("0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ("0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def usual_table(kind: int) -> bytes:
    """The body of the segment that would hold a usual table."""
    counts, first = USUAL[kind]
    symbols = range(12) if kind < 16 else sorted({0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))})
    named = list(bytes.fromhex(first))
    return bytes([kind, *map(int, counts.split()), *named, *(s for s in symbols if s not in named)])


# --- writing ---


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def frame_head() -> bytes:
    """All of a frame before its coded blocks."""
    classes = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))  # one code each of 1 to 9 bits, for classes 8 to 0
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + classes)
        + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(maxsize=1)
def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of a block by its DC difference + 255, and back (-1000 where no block has these bits)."""
    codes = np.zeros(511, dtype=np.uint64)
    back = np.full(1024, -1000, dtype=np.int64)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        code = (1 << (9 - c)) - 2  # canonical code of 9 - c bits: ones and a zero
        bits = (code << c | (diff if diff >= 0 else diff + (1 << c) - 1)) << 1  # and the end mark, one zero bit
        codes[diff + 255] = bits
        back[bits] = diff
    return codes, back


def coded_frames(payload: np.ndarray) -> list[bytes]:
    """The coded blocks of each frame of a payload, with stuffing after bytes 255."""
    samples = payload.reshape(-1, FRAME).astype(np.int64) - 128
    codes = block_codes()[0][np.diff(samples, axis=1, prepend=0) + 255].reshape(-1, 4)
    word = codes[:, 0] << np.uint64(30) | codes[:, 1] << np.uint64(20) | codes[:, 2] << np.uint64(10) | codes[:, 3]
    raw = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1)
    high = raw == 255
    ends = np.cumsum(np.r_[0, (1 + high).reshape(len(samples), -1).sum(axis=1)])
    out = np.repeat(raw, 1 + high)
    out[np.cumsum(1 + high)[high] - 1] = 0
    data = out.tobytes()
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file of one motion-JPEG stream with its index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, body, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def store(data: bytes) -> bytes:
    """Any bytes as an AVI file, padded with bytes 255 to whole frames, one frame at least."""
    payload = data + bytes([PAD]) * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))
    head = frame_head()
    return write_avi([head + x + b"\xff\xd9" for x in coded_frames(np.frombuffer(payload, dtype=np.uint8))], SIDE * 8, SIDE * 8)


# --- reading ---


def riff_frames(data: bytes) -> tuple[list[tuple[int, int]], int]:
    """Place and size of each video frame, by the index where there is one, and microseconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    movies: list[tuple[int, int]] = []  # of all RIFF parts

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("a chunk ends outside its parent")
            if name == b"LIST":
                found.setdefault(data[at + 8 : at + 12], (at + 12, at + 8 + size))
                if data[at + 8 : at + 12] == b"movi":
                    movies.append((at + 12, at + 8 + size))
                if data[at + 8 : at + 12] == b"hdrl":
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, (at + 8, at + 8 + size))
            at += 8 + size + size % 2

    part = 0
    while part + 12 <= len(data) and data[part : part + 4] == b"RIFF":
        size = struct.unpack_from("<I", data, part + 4)[0]
        walk(part + 12, min(len(data), part + 8 + size))
        part += 8 + size + size % 2
    if b"movi" not in found or b"avih" not in found:
        raise ValueError("no frames")
    micros = struct.unpack_from("<I", data, found[b"avih"][0])[0]
    begin, end = found[b"movi"]
    frames = []
    if b"idx1" in found and len(movies) == 1:
        for at in range(found[b"idx1"][0], found[b"idx1"][1] - 15, 16):
            name, _, offset, size = struct.unpack_from("<4sIII", data, at)
            place = begin - 4 + offset  # from the list's type; some writers count from the file's start
            if data[place : place + 4] != name:
                place = offset
            if name[2:] in (b"dc", b"db"):
                if data[place : place + 4] != name or place + 8 + size > len(data):
                    raise ValueError("the index points outside the frames")
                frames.append((place + 8, size))
    else:  # the index covers the first part at most
        todo = movies[::-1]
        while todo:
            at, end = todo.pop()
            if at + 8 > end:
                continue
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("a chunk ends outside its parent")
            todo.append((at + 8 + size + size % 2, end))
            if name == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif name[2:] in (b"dc", b"db"):
                frames.append((at + 8, size))
    return frames, micros


class Tables:
    """The tables and the shape that the segments before a scan give."""

    def __init__(self, head: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.parts: list[tuple[int, int, int, int]] = []
        self.scan: list[tuple[int, int]] = []
        self.restart = 0
        for marker, body in segments(head):
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    body = self._read_codes(body)
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline frame")
        if not self.parts or not self.scan:
            raise ValueError("no frame header")
        if not self.width or not self.height or not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in self.parts):
            raise ValueError("a frame without size or with impossible sampling")
        if not self.codes:
            for kind in USUAL:
                self._read_codes(usual_table(kind))

    def _read_codes(self, body: bytes) -> bytes:
        """One Huffman table; returns what follows it."""
        counts, n = body[1:17], sum(body[1:17])
        code, k, table = 0, 0, {}
        for bits in range(16):
            for _ in range(counts[bits]):
                table[bits + 1, code] = body[17 + k]
                code, k = code + 1, k + 1
            code <<= 1
        self.codes[body[0]] = table
        return body[17 + n :]


def segments(frame: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and body of each segment up to and with the scan's."""
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no marker where a segment must begin")
        marker = frame[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
            continue
        size = struct.unpack_from(">H", frame, at + 2)[0]
        yield marker, frame[at + 4 : at + 2 + size]
        if marker == 0xDA:
            return
        at += 2 + max(2, size)


def scan_start(frame: bytes) -> int:
    """Where the coded blocks begin: a thumbnail inside of a segment is not the frame's scan."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        if frame[at + 1] == 0xFF:
            at += 1
            continue
        end = at + 2 + max(2, struct.unpack_from(">H", frame, at + 2)[0])
        if frame[at + 1] == 0xDA:
            return end
        at = end
    raise ValueError("not a JPEG frame")


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode_luma(tables: Tables, coded: bytes) -> np.ndarray:
    """The first component of any baseline frame, bit by bit."""
    parts = _RESTART.split(coded) if tables.restart else [coded]
    bits, at = np.zeros(0, np.uint8), 0

    def symbol(table: dict[tuple[int, int], int]) -> int:
        nonlocal at
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(bits[at])
            at += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def value(n: int) -> int:
        nonlocal at
        if not n:
            return 0
        v = int(bits[at : at + n].dot(1 << np.arange(n - 1, -1, -1)))
        at += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    shape = {c: (h, v, q) for c, h, v, q in tables.parts}
    alone = len(tables.scan) == 1
    most_h, most_v = max(p[1] for p in tables.parts), max(p[2] for p in tables.parts)
    first = tables.parts[0]
    h, v = (1, 1) if alone else (first[1], first[2])
    across = -(-tables.width // (8 * (1 if alone else most_h)))
    down = -(-tables.height // (8 * (1 if alone else most_v)))
    plane = np.zeros((down * v * 8, across * h * 8))
    last = dict.fromkeys(shape, 0)
    try:
        for m in range(across * down):
            if m % (tables.restart or across * down) == 0:
                bits, at = np.unpackbits(np.frombuffer(_unstuffed(parts[m // (tables.restart or across * down)]), dtype=np.uint8)), 0
                last = dict.fromkeys(shape, 0)
            for c, own in tables.scan:
                ch, cv, q = shape[c]
                for k in range(1 if alone else ch * cv):
                    block = np.zeros(64)
                    last[c] += value(symbol(tables.codes[own >> 4]))
                    block[0] = last[c] * tables.quant[q][0]
                    i = 1
                    while i < 64:
                        s = symbol(tables.codes[0x10 | own & 15])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[ZIGZAG[i]] = value(s & 15) * tables.quant[q][i]
                        i += 1
                    if c == first[0]:
                        y, x = m // across * v + k // h, m % across * h + k % h
                        plane[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = _BASIS.T @ block.reshape(8, 8) @ _BASIS
    except (IndexError, KeyError) as e:
        raise ValueError("the coded blocks end early") from e
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: -(-tables.height * (1 if alone else v) // (1 if alone else most_v)), : -(-tables.width * (1 if alone else h) // (1 if alone else most_h))]


def _unstuffed(coded: bytes) -> bytes:
    return coded.replace(b"\xff\x00", b"\xff")


def read_samples(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of each frame (frame, sample) and the microseconds a frame.

    For frames as store() writes them a sample is a block; of others, the mean of each 8x8 block of the luma plane."""
    frames, micros = riff_frames(data)
    head = frame_head()
    own = [data[a : a + len(head)] == head for a, _ in frames]
    if frames and all(own):
        coded = [_unstuffed(data[a + len(head) : a + n - 2]) for a, n in frames]
        if all(len(c) == FRAME * 10 // 8 for c in coded):
            raw = np.frombuffer(b"".join(coded), dtype=np.uint8).reshape(-1, 5).astype(np.int64)
            word = raw[:, 0] << 32 | raw[:, 1] << 24 | raw[:, 2] << 16 | raw[:, 3] << 8 | raw[:, 4]
            diffs = block_codes()[1][np.stack([word >> 30, word >> 20 & 1023, word >> 10 & 1023, word & 1023], axis=1)].reshape(-1, FRAME)
            samples = np.cumsum(diffs, axis=1) + 128
            if len(samples) and samples.min() >= 0 and samples.max() <= 255 and diffs.min() > -1000:
                return samples.astype(np.uint8), micros
    out = []
    for a, n in frames:
        frame = data[a : a + n]
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        start = scan_start(frame)
        end = frame.rfind(b"\xff\xd9")
        luma = decode_luma(Tables(frame[:start]), frame[start : end if end >= start else len(frame)])
        high, wide = -(-luma.shape[0] // 8) * 8, -(-luma.shape[1] // 8) * 8
        full = np.pad(luma, ((0, high - luma.shape[0]), (0, wide - luma.shape[1])), mode="edge")
        out.append(np.rint(full.reshape(high // 8, 8, wide // 8, 8).mean(axis=(1, 3))).astype(np.uint8).reshape(-1))
    if len({len(x) for x in out}) > 1:
        raise ValueError("frames of different shape")
    return np.array(out, dtype=np.uint8).reshape(len(out), -1), micros


def shots(samples: np.ndarray, bins: int = 16, before: int = 8, spread: float = 2.0, least: float = 0.1) -> tuple[list[tuple[int, int]], np.ndarray]:
    """First and last frame of each shot, and the histogram differences (0 to 1) between neighbours.

    A cut is where a difference exceeds `least` and the mean of the `before` differences before it by `spread` deviations."""
    n = len(samples)
    if not n:
        return [], np.zeros(0)
    width = 256 // bins
    count = np.bincount((np.arange(n)[:, None] * bins + samples // width).ravel(), minlength=n * bins).reshape(n, bins)
    diff = np.abs(np.diff(count, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    total, square = np.cumsum(np.r_[0, diff]), np.cumsum(np.r_[0, diff * diff])
    at = np.arange(len(diff))
    low = np.maximum(0, at - before)
    size = np.maximum(1, at - low)
    mean = (total[at] - total[low]) / size
    deviation = np.sqrt(np.maximum(0, (square[at] - square[low]) / size - mean * mean))
    cuts = (np.flatnonzero((diff > least) & (at > 0) & (diff > mean + spread * deviation)) + 1).tolist()
    return [(a, b - 1) for a, b in zip([0, *cuts], [*cuts, n], strict=True)], diff


# --- on columns ---


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 1 << 20):
            raw, offsets = buffers(strings(b.column("text")))
            data = raw.tobytes()
            media = [store(data[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


_FEATURES = "n_frames int, shots int, mean_difference double, clips array<struct<first_frame: int, last_frame: int, start_s: double, end_s: double>>"


def scan_media(rows: DataFrame, payload: bool = False) -> DataFrame:
    """Reads each media value: frames, shots and timed clips; with `payload`, the samples' bytes and the file's size and digest too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [_scanned(x, payload) for x in part.column("media").to_pylist()]
                kinds = {f.name: f.type for f in _arrow(payload)}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([o.get(k) for o in out], kinds[k]) for k in kinds)], names=["doc_id", *kinds])

    extra = ", payload binary, media_bytes long, media_sha256 string" if payload else ""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, f"doc_id long, {_FEATURES}, error string{extra}")


def _arrow(payload: bool) -> pa.Schema:
    clip = pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    fields = [("n_frames", pa.int32()), ("shots", pa.int32()), ("mean_difference", pa.float64()), ("clips", pa.list_(clip)), ("error", pa.string())]
    return pa.schema(fields + ([("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())] if payload else []))


def _scanned(media: bytes | None, payload: bool) -> dict:
    if media is None:
        return {}
    try:
        samples, micros = read_samples(media)
    except (ValueError, ArithmeticError, LookupError, TypeError, MemoryError, struct.error) as e:  # whatever a damaged file leads to
        return {"error": str(e) or type(e).__name__}
    found, diff = shots(samples)
    clips = [{"first_frame": a, "last_frame": b, "start_s": a * micros / 1e6, "end_s": (b + 1) * micros / 1e6} for a, b in found]
    out = {"n_frames": len(samples), "shots": len(found), "mean_difference": float(diff.mean()) if len(diff) else 0.0, "clips": clips}
    if payload:
        out |= {"payload": samples.tobytes(), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    return out


def clip_rows(scanned: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip, first_frame, last_frame, start_s, end_s."""
    return scanned.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text as media, reads the stored bytes back, and gives the digests of what was read and the timed clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 1 << 20):
            raw, offsets = buffers(strings(b.column("text")))
            data = raw.tobytes()
            rows = [_digest(store(data[x:y])) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), _arrow(False).field("clips").type)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=_DIGEST)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, shots int, clips array<struct<first_frame: int, last_frame: int, start_s: double, end_s: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_DIGEST = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "shots", "clips"]


def _digest(media: bytes) -> tuple:
    row = _scanned(media, True)
    if "error" in row:
        raise ValueError(row["error"])  # what store() wrote can be read
    data = row["payload"]
    feature = f"{row['mean_difference']:.6f} " + ",".join(f"{c['first_frame']}-{c['last_frame']}" for c in row["clips"])
    n = len(data.rstrip(b"\xff"))  # no UTF-8 text holds a byte 255
    return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), row["media_bytes"], row["media_sha256"], feature, row["n_frames"], row["shots"], row["clips"]
