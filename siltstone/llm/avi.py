"""Media columns: AVI files of motion JPEG frames, held in a binary column.

``to_media`` stores payload bytes losslessly: a frame is a 24 x 24 grey baseline JPEG with unit
quantisation, and each of its 576 quantised coefficients is one payload byte (the unit of the
format). Every coefficient is written with the size category 8, whose 8 extra bits are the byte,
behind an 8-bit Huffman code; a restart interval of one block keeps the DC differences plain.
``read_media`` parses the RIFF chunks and the idx1 index of any motion JPEG AVI, decodes the intra
frames (Huffman, dequantisation, exact integer inverse DCT) and detects shots: a cut is where the
histogram difference of two frames exceeds the running mean plus twice the deviation of the last
differences. ``clips`` yields one timed row per shot.

Defined cases: a null or empty text is one frame of padding; very long texts are worked on in slices
of whole frames; repeated rows give repeated results; other columns of the input are not looked at.
In reading, a null medium and bytes that are no AVI with readable motion JPEG frames give no clips
and null features, and do not fail the job; a medium of no frames has no clips and the feature of no
frames; media that ``to_media`` did not write have features but null payload columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.textbytes import flatten, lean, slices, trim
from siltstone.runtime import small_batches

SIDE, BLOCKS = 24, 9
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
#: Order of the coefficients in a block (fixed by the JPEG standard).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Inverse DCT basis, scaled to integers so that all sums are exact in float64 in any order.
SCALE_BITS = 12
BASIS = np.round(np.array([[(0.5 / np.sqrt(2) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << SCALE_BITS))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]) + b"\x08"
HEAD = (
    b"\xff\xd8" + _segment(0xE0, b"AVI1\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00") + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE)
    + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
TAIL = b"\xff\xd9"
_ROW = BLOCKS * 128 + 2 * (BLOCKS - 1)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of (n, 576) byte samples."""
    n = len(samples)
    rows = np.zeros((n, BLOCKS, 130), np.uint8)
    rows[:, :, 1:128:2] = samples.reshape(n, BLOCKS, 64)
    rows[:, :, 128] = 0xFF
    rows[:, :, 129] = 0xD0 + np.arange(BLOCKS) % 8
    flat = np.ascontiguousarray(rows.reshape(n, -1)[:, :_ROW])
    full = np.zeros((n, BLOCKS, 130), bool)
    full[:, :, 1:128:2] = samples.reshape(n, BLOCKS, 64) == 255
    full = full.reshape(n, -1)[:, :_ROW]
    ends = np.cumsum(_ROW + full.sum(axis=1))
    data = np.insert(flat.ravel(), np.flatnonzero(full) + 1, 0).tobytes() if full.any() else flat.tobytes()
    return [HEAD + data[a:b] + TAIL for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def mux(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames with an idx1 index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        part = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(part)
        at += len(part)
    body = b"AVI " + header + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def demux(data: bytes) -> tuple[list[bytes], int]:
    """The video frames by the idx1 index (or in chunk order where there is none) and microseconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, micro, movi, index, in_order = 12, 1_000_000 // FPS, 0, [], []

    def walk(start: int, end: int) -> None:
        nonlocal micro, movi
        while start + 8 <= end:
            kind, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
            body = start + 8
            if kind == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, min(body + size, end))
            elif kind == b"avih":
                micro = struct.unpack_from("<I", data, body)[0] or micro
            elif kind == b"idx1":
                index.extend((k, o, n) for k, _, o, n in struct.iter_unpack("<4sIII", data[body : body + size // 16 * 16]))
            elif kind[2:] in (b"dc", b"db"):
                in_order.append(data[body : body + size])
            start = body + size + size % 2

    walk(at, len(data))
    video = [(o, n) for k, o, n in index if k[2:] in (b"dc", b"db")]
    if not video:
        return in_order, micro
    shift = movi if data[movi + video[0][0] : movi + video[0][0] + 4][2:] in (b"dc", b"db") else 0  # offsets from movi or from the file's start
    return [data[shift + o + 8 : shift + o + 8 + n] for o, n in video], micro


def decode_own(frames: list[bytes]) -> np.ndarray:
    """Payload bytes (n, 576) of frames that ``encode_frames`` wrote, all at once."""
    raw = np.frombuffer(b"".join(f[len(HEAD) : -2] for f in frames), np.uint8)
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    rows = raw[~stuffed].reshape(len(frames), _ROW)
    rows = np.pad(rows, ((0, 0), (0, 2))).reshape(len(frames), BLOCKS, 130)
    if rows[:, :, 0:128:2].any():
        raise ValueError("unknown entropy code")
    return np.ascontiguousarray(rows[:, :, 1:128:2]).reshape(len(frames), FRAME)


def coefficients(samples: np.ndarray) -> np.ndarray:
    """Quantised coefficients of payload bytes: extra bits of size category 8."""
    value = samples.astype(np.int64)
    return np.where(value < 128, value - 255, value)


def inverse_dct(blocks: np.ndarray) -> np.ndarray:
    """Samples 0-255 of (n, 64) dequantised coefficients in zigzag order."""
    square = np.empty((len(blocks), 64))
    square[:, ZIGZAG] = blocks
    once = square.reshape(-1, 8) @ BASIS
    twice = np.ascontiguousarray(once.reshape(-1, 8, 8).transpose(0, 2, 1)).reshape(-1, 8) @ BASIS
    pixels = (twice.reshape(-1, 8, 8).transpose(0, 2, 1).astype(np.int64) + (1 << 2 * SCALE_BITS - 1) >> 2 * SCALE_BITS) + 128
    return np.clip(pixels, 0, 255)


class _Bits:
    """Bit reader over one restart interval without stuffing."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * len(data) + 64

    def take(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)


def _huffman(body: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            table[(length, code)] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_jpeg(data: bytes) -> np.ndarray:
    """Luma plane of any baseline JPEG with Huffman tables of its own."""
    quant, huff, parts, restart, at, shape = {}, {}, {}, 0, 2, (0, 0)
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]] = _huffman(body[1:n])
                body = body[n:]
        elif marker == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames are intra frames here")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
    end = data.rfind(b"\xff\xd9")
    pieces, piece, k = [], bytearray(), at
    raw = data[at : end if end >= at else len(data)]
    k = 0
    while k < len(raw):
        if raw[k] == 0xFF and k + 1 < len(raw):
            if raw[k + 1] == 0:
                piece.append(0xFF)
            elif 0xD0 <= raw[k + 1] <= 0xD7:
                pieces.append(bytes(piece))
                piece = bytearray()
            k += 2
        else:
            piece.append(raw[k])
            k += 1
    pieces.append(bytes(piece))
    if len(scan) == 1:
        parts = {scan[0][0]: (1, 1, parts[scan[0][0]][2])}
    across, down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    wide, high = -(-shape[1] // (8 * across)), -(-shape[0] // (8 * down))
    first = scan[0][0]
    luma = np.zeros((high * parts[first][1] * 8, wide * parts[first][0] * 8), np.int64)
    bits, last, unit = None, {}, 0

    def symbol(table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits.take(1)
            if (length, code) in table:
                return table[(length, code)]
        raise ValueError("bad code")

    def extra(n: int) -> int:
        v = bits.take(n) if n else 0
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

    for my in range(high):
        for mx in range(wide):
            if bits is None or restart and unit % restart == 0:
                bits, last = _Bits(pieces.pop(0)), dict.fromkeys(parts, 0)
            unit += 1
            for part, dc, ac in scan:
                h, v, q = parts[part]
                for by in range(v):
                    for bx in range(h):
                        block = np.zeros(64, np.int64)
                        last[part] += extra(symbol(huff[dc]))
                        block[0], k = last[part], 1
                        while k < 64:
                            run = symbol(huff[16 + ac])
                            if run == 0:
                                break
                            k += run >> 4
                            if run & 15:
                                block[k] = extra(run & 15)
                            k += 1
                        if part == first:
                            y, x = (my * v + by) * 8, (mx * h + bx) * 8
                            luma[y : y + 8, x : x + 8] = inverse_dct((block * quant[q])[None])[0]
    return luma[: shape[0], : shape[1]]


def histograms(pixels: np.ndarray) -> np.ndarray:
    """(n, BINS) counts of (n, any) samples."""
    n = len(pixels)
    key = (pixels.reshape(n, -1) >> 4) + np.arange(n)[:, None] * BINS
    return np.bincount(key.ravel(), minlength=n * BINS).reshape(n, BINS)


def shot_starts(counts: np.ndarray, window: int = 8, least: float = 0.1) -> tuple[list[int], float]:
    """Frames that begin a shot (0 is one) and the greatest difference between neighbours."""
    if len(counts) < 2:
        return [0] * len(counts), 0.0
    total = counts.sum(axis=1)  # of samples; frames may differ in size
    share = np.abs(np.diff(counts / np.maximum(1, total)[:, None], axis=0)).sum(axis=1) / 2 if (total != total[0]).any() else np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2.0 * total[0])
    starts = [0]
    for k, d in enumerate(share.tolist()):
        past = share[max(0, k - window) : k]
        bar = least if len(past) == 0 else max(least, float(past.mean() + 2.0 * past.std()))
        if d > bar:
            starts.append(k + 1)
    return starts, float(share.max())


def frame_histograms(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
    """Histograms of all frames, and the payload bytes if the frames are our own."""
    if frames and all(f.startswith(HEAD) for f in frames):
        payload = decode_own(frames)
        counts = [histograms(inverse_dct(coefficients(payload[k : k + 1024]).reshape(-1, 64)).reshape(-1, FRAME)) for k in range(0, len(payload), 1024)]
        return np.concatenate(counts), payload
    return (np.concatenate([histograms(decode_jpeg(f)[None]) for f in frames]) if frames else np.zeros((0, BINS), np.int64)), None


def clip_rows(data: bytes) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, end frame, start ms, end ms) of every shot."""
    frames, micro = demux(data)
    starts, _ = shot_starts(frame_histograms(frames)[0])
    ends = [*starts[1:], len(frames)]
    return [(k, a, b, a * micro / 1000, b * micro / 1000) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if b > a]


def pad(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames, 576) of all texts, frames per text, and bytes per text."""
    raw, offsets = flatten(texts)
    sizes = np.diff(offsets)
    frames = np.maximum(1, -(-sizes // FRAME))
    out = np.full(int(frames.sum()) * FRAME, 255, np.uint8)
    begin = (np.cumsum(frames) - frames) * FRAME
    out[np.repeat(begin - offsets[:-1], sizes) + np.arange(len(raw))] = raw
    return out.reshape(-1, FRAME), frames, sizes


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            samples, frames, sizes = pad(part.column("text"))
            jpegs = [j for k in range(0, len(samples), 4096) for j in encode_frames(samples[k : k + 4096])]
            ends = np.cumsum(frames)
            media = [mux(jpegs[b - n : b]) for n, b in zip(frames.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
    trim()


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text of each document as an AVI file."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


#: What damaged or foreign bytes raise in the readers.
UNREADABLE = (ValueError, IndexError, KeyError, ArithmeticError, RecursionError, struct.error)


def _feature(counts: np.ndarray) -> str:
    starts, peak = shot_starts(counts)
    return f"frames={len(counts)};clips={len(starts)};cuts={','.join(map(str, starts[1:]))};peak={peak:.6f};hist={zlib.crc32(counts.astype('<i4').tobytes()):08x}"


def _foreign(frames: list[bytes] | None) -> str | None:
    """The feature of frames that are not our own, or None where they cannot be read."""
    try:
        return None if frames is None else _feature(frame_histograms(frames)[0])
    except UNREADABLE:
        return None


def _frames(medium: bytes | None) -> list[bytes] | None:
    try:
        return None if medium is None else demux(medium)[0]
    except UNREADABLE:
        return None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for part in slices(batch, "media", 2 << 20):
            files = [m.as_py() for m in part.column("media")]
            frames = [_frames(m) for m in files]
            own = [bool(fs) and all(f.startswith(HEAD) for f in fs) for fs in frames]
            try:
                counts, payload = frame_histograms([f for fs, o in zip(frames, own, strict=True) if o for f in fs])
            except UNREADABLE:  # a damaged one is among them
                own = [o and _foreign(fs) is not None for fs, o in zip(frames, own, strict=True)]
                counts, payload = frame_histograms([f for fs, o in zip(frames, own, strict=True) if o for f in fs])
            rows, at = [], 0
            for m, fs, o in zip(files, frames, own, strict=True):
                ours = [None, None, None]
                if o:
                    data = payload[at : at + len(fs)].tobytes()
                    ours = [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])]
                    feature = _feature(counts[at : at + len(fs)])
                    at += len(fs)
                else:
                    feature = _foreign(fs)
                rows.append((*ours, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)
    trim()


def read_features(media: DataFrame) -> DataFrame:
    """Payload digests and frame features of media that ``to_media`` stored, from the stored bytes."""
    small_batches(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, medium in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows = clip_rows(medium.as_py()) if medium.is_valid else []
            except UNREADABLE:
                rows = []
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3]), pa.array(c[4])], ["doc_id", "clip", "first_frame", "end_frame", "start_ms", "end_ms"])
    trim()


def clips(media: DataFrame) -> DataFrame:
    """One row per shot of every medium: (doc_id, clip, first_frame, end_frame, start_ms, end_ms)."""
    return media.select("doc_id", "media").mapInArrow(_clips, "doc_id long, clip int, first_frame long, end_frame long, start_ms double, end_ms double")


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    """Store every text of ``documents`` as an AVI medium and read digests and features back from it."""
    return read_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
