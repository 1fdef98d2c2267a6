"""Media columns: motion-JPEG in AVI files, one file a row.

``store`` writes bytes as 8-bit grey frames of 24 x 24 samples. Frames are lossless JPEG (process SOF3 of ITU-T T.81,
predictor 1, Huffman-coded differences), each on its own, in the ``movi`` list of a RIFF AVI file with an ``idx1``
index. ``clips`` parses the index, decodes the frames, and cuts the sequence where the difference of neighbouring
frames' histograms stands out from the differences just before it. ``restore`` gives the samples back.

Frames of many files are coded together: all samples of a batch are array columns, and the decoder takes one
step per sample position for all frames of the batch.

Defined results: null bytes are empty; payloads are padded with bytes 255 to a positive multiple of a frame; equal
bytes give equal files; repeated rows each give their rows; an empty table gives no rows; extra columns are ignored;
a file must stay under 4 GB, the limit of its format, else an error is raised.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
FRAMES_A_SECOND = 25
#: Frames that are coded together.
CHUNK_FRAMES = 4096
#: Bins of a frame's histogram; frames that the threshold looks back on; its factor on their deviation, and the least cut.
BINS, LOOK_BACK, FACTOR, LEAST_CUT = 16, 8, 3.0, 0.25

#: Code lengths of the difference categories 0 to 8.
LENGTHS = (3, 4, 4, 3, 3, 3, 3, 3, 4)


def _codes(lengths: tuple[int, ...]) -> dict[int, int]:
    """Canonical codes: by length, then category."""
    code, last, out = 0, 0, {}
    for n, category in sorted((n, k) for k, n in enumerate(lengths) if n):
        code <<= n - last
        out[category], last = code, n
        code += 1
    return out


def _jpeg_head() -> bytes:
    order = sorted((n, k) for k, n in enumerate(LENGTHS))
    counts = bytes(sum(n == k for n, _ in order) for k in range(1, 17))
    dht = b"\x00" + counts + bytes(k for _, k in order)
    sof = struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    sos = struct.pack(">B2B3B", 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body for m, body in ((0xC3, sof), (0xC4, dht), (0xDA, sos)))


HEAD, TAIL = _jpeg_head(), b"\xff\xd9"


@functools.cache
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a difference d, at d + 255."""
    codes = _codes(LENGTHS)
    value, size = np.zeros(511, dtype=np.uint64), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        value[d + 255] = (codes[k] << k) | (d if d >= 0 else d + (1 << k) - 1)
        size[d + 255] = LENGTHS[k] + k
    return value, size


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG of every row of 576 samples."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    values, sizes = _encoder()
    at = d.reshape(n, FRAME) + 255
    v, s = values[at], sizes[at]
    for _ in range(2):  # four samples are at most 48 bits, and at least 12
        v = (v[:, ::2] << s[:, 1::2].astype(np.uint64)) | v[:, 1::2]
        s = s[:, ::2] + s[:, 1::2]
    ends = np.cumsum(s, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    bit = ends - s
    out = np.zeros(int(n_bytes.sum()) + 8, dtype=np.uint8)
    byte = (first[:, None] + (bit >> 3)).ravel()
    word = (v << (56 - s - (bit & 7)).astype(np.uint64)).ravel()
    for k in range(7):  # groups are longer than a byte, so no two of them start in one
        out[byte + k] |= (word >> np.uint64(48 - 8 * k)).astype(np.uint8)
    fill = (-ends[:, -1]) % 8
    out[first + n_bytes - 1] |= ((1 << fill) - 1).astype(np.uint8)
    data = out.tobytes()
    return [HEAD + data[a : a + k].replace(b"\xff", b"\xff\x00") + TAIL for a, k in zip(first.tolist(), n_bytes.tolist(), strict=True)]


@functools.lru_cache(maxsize=16)
def _tables(head: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Height, width, and for the next 12 bits: bits taken and difference; from the segments before the scan's data."""
    at, height, width, lengths = 2, 0, 0, {}
    while at < len(head):
        marker, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack(">BHHB", body[:6])
            if precision != 8 or parts != 1:
                raise ValueError("only frames of one 8-bit component are read")
        elif marker == 0xC4:
            counts, symbols = body[1:17], body[17:]
            pairs = [n for n, c in enumerate(counts, 1) for _ in range(c)]
            lengths = dict(zip(symbols, pairs, strict=True))
        elif marker == 0xDA and body[3] != 1:
            raise ValueError("only predictor 1 is read")
        at += 2 + size
    codes = _codes(tuple(lengths.get(k, 0) for k in range(9)))
    taken, difference = np.zeros(4096, dtype=np.uint8), np.zeros(4096, dtype=np.int16)
    for k, code in codes.items():
        size = lengths[k] + k
        for extra in range(1 << k):
            d = extra if k == 0 or extra >> (k - 1) else extra - (1 << k) + 1
            lo = ((code << k) | extra) << (12 - size)
            taken[lo : lo + (1 << (12 - size))], difference[lo : lo + (1 << (12 - size))] = size, d
    return height, width, taken, difference


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (uint8, a row for each frame) of lossless JPEG frames that share their header."""
    if not frames:
        return np.zeros((0, FRAME), dtype=np.uint8)
    scan = frames[0].index(b"\xff\xda")
    head = frames[0][: scan + 2 + struct.unpack(">H", frames[0][scan + 2 : scan + 4])[0]]
    height, width, taken, difference = _tables(head)
    parts = []
    for f in frames:
        if not f.startswith(head) or not f.endswith(TAIL):
            raise ValueError("frame with another header")
        parts.append(f[len(head) : -2].replace(b"\xff\x00", b"\xff"))
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.frombuffer(b"".join(parts) + bytes(4), dtype=np.uint8).astype(np.uint32)
    word = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
    bit = 8 * (np.cumsum(sizes) - sizes)
    last = len(word) - 1
    d = np.empty((height * width, len(parts)), dtype=np.int16)
    for k in range(height * width):
        at = (word[np.minimum(bit >> 3, last)] << (bit & 7).astype(np.uint32)) >> np.uint32(20)
        d[k] = difference[at]
        bit += taken[at]
    if (bit > 8 * np.cumsum(sizes)).any():
        raise ValueError("frame data ended early")
    d = d.T.reshape(-1, height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8).reshape(len(parts), -1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file of motion-JPEG frames with its index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, largest * FRAMES_A_SECOND, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    chunks, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(c)
        at += len(c)
    movi = b"".join((b"movi", *chunks))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", movi) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames of an AVI file, found by its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, rate, index = 12, None, float(FRAMES_A_SECOND), b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            rate = 1e6 / struct.unpack_from("<I", media, at + 20)[0]
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name == b"00dc":
            start = movi + offset
            if media[start : start + 4] != name:
                raise ValueError("the index does not point at a frame")
            frames.append(media[start + 8 : start + 8 + size])
    return rate, frames


def shots(samples: np.ndarray) -> list[int]:
    """First frames of the shots: where the histogram difference is over a threshold taken from the differences before it."""
    if not len(samples):
        return []
    bins = (samples >> 4).astype(np.int64) + np.arange(len(samples))[:, None] * BINS
    h = np.bincount(bins.ravel(), minlength=len(samples) * BINS).reshape(-1, BINS)
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    cuts, since = [0], 0
    for k, x in enumerate(d.tolist()):
        recent = d[max(since, k - LOOK_BACK) : k]
        limit = max(LEAST_CUT, float(recent.mean() + FACTOR * recent.std())) if len(recent) else LEAST_CUT
        if x > limit:
            cuts.append(k + 1)
            since = k + 1
    return cuts


def pad(payload: bytes) -> bytes:
    """The payload, with bytes 255 up to a positive multiple of a frame."""
    return payload + b"\xff" * (-len(payload) % FRAME or (0 if payload else FRAME))


def _groups(items: list[tuple[int, bytes]], weight) -> Iterator[list[tuple[int, bytes]]]:
    """Runs of rows with about ``CHUNK_FRAMES`` frames together."""
    part, held = [], 0
    for item in items:
        part.append(item)
        held += weight(item)
        if held >= CHUNK_FRAMES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for part in _groups(rows, lambda r: len(r[1] or b"") // FRAME + 1):
            payloads = [pad(p or b"") for _, p in part]
            samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME)
            frames = [f for lo in range(0, len(samples), CHUNK_FRAMES) for f in encode_frames(samples[lo : lo + CHUNK_FRAMES])]
            files, at = [], 0
            for p in payloads:
                files.append(write_avi(frames[at : at + len(p) // FRAME]))
                at += len(p) // FRAME
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([len(p or b"") for _, p in part], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", bytes_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the bytes (or UTF-8 text) of every row as an AVI file."""
    return docs.select(F.col(id_col).cast("long"), F.col(bytes_col).cast("binary")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _decoded(part: list[tuple]) -> Iterator[tuple[tuple, float, np.ndarray]]:
    read = [read_avi(r[2]) for r in part]
    frames = [f for _, fs in read for f in fs]
    samples = [decode_frames(frames[lo : lo + CHUNK_FRAMES]) for lo in range(0, len(frames), CHUNK_FRAMES)]
    every = np.concatenate(samples) if samples else np.zeros((0, FRAME), dtype=np.uint8)
    at = 0
    for row, (rate, fs) in zip(part, read, strict=True):
        yield row, rate, every[at : at + len(fs)]
        at += len(fs)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple, float, np.ndarray]]:
    rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
    for part in _groups(rows, lambda r: len(r[2]) // FRAME + 1):
        yield from _decoded(part)


#: A clip of a file: its number, frames, times in seconds and mean level.
CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_level", pa.float64())])
CLIPS = "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_level double"


def _timed(samples: np.ndarray, rate: float, firsts: list[int]) -> list[tuple]:
    """Rows of ``CLIP`` of a file's shots."""
    return [(k, a, b - a, a / rate, b / rate, float(samples[a:b].mean())) for k, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(samples)], strict=True))]


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(row[0], *clip) for row, rate, samples in _rows(batch) for clip in _timed(samples, rate, shots(samples))]
        if out:
            types = (pa.int64(), *(f.type for f in CLIP))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in CLIPS.split(", ")])


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of all files, see ``CLIPS``."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_clips, CLIPS)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,mean_level:double>>"

READ_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, rate, samples in _rows(batch):
            payload, firsts = samples.tobytes(), shots(samples)
            feature = json.dumps({"frames": len(samples), "fps": rate, "shots": firsts, "mean": round(float(samples.mean()), 3)}, separators=(",", ":"))
            out.append((row[0], row[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(row[2]), hashlib.sha256(row[2]).hexdigest(), feature, [dict(zip(CLIP.names, c, strict=True)) for c in _timed(samples, rate, firsts)]))
        if out:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(CLIP))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=READ_NAMES)


def describe(media: DataFrame) -> DataFrame:
    """Per file, from its stored bytes: digests of the payload read back and of the file, its shots, and these as timed clips."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_described, READ)
