"""AVI motion-JPEG columns: write texts as frames, parse RIFF indexes, decode, find shots.

Storage unit: one 8x8 block of a baseline grey JPEG holds one payload byte. The block is
flat, so its only coefficient is DC = 8 * (v - 128); with a quantiser of 8 that is the
integer v - 128, and decoding gives v back exactly. The Huffman table gives DC category c
a code of 15 - c bits, so code + c extra bits + a one-bit end-of-block make 16 bits for
every block: encoding and decoding are table look-ups over whole arrays. Such codes begin
and end with a zero bit in each byte pair, so no 0xFF byte arises that needs stuffing.

Nulls and empty texts are payloads of 64 zero bytes. Rows are independent: repeated rows
give repeated results, an empty table an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store

UNIT = 64
BLOCKS_X, BLOCKS_Y, FPS = 64, 8, 25
FRAME = BLOCKS_X * BLOCKS_Y
BINS = 16


def _code_table() -> np.ndarray:
    """16-bit word of each DC difference from -255 to 255, end-of-block included."""
    first, code = {}, 0
    for length in range(7, 16):
        code <<= 1
        first[15 - length] = code
        code += 1
    words = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        words[d + 255] = ((first[c] << c) | (d if d > 0 else d + (1 << c) - 1)) << 1
    return words


ENCODE = _code_table()
DECODE = np.full(1 << 16, 999, np.int16)
DECODE[ENCODE] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(width: int, height: int) -> bytes:
    lengths = bytes(1 if 7 <= n <= 15 else 0 for n in range(1, 17))
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + lengths + bytes(range(8, -1, -1)))
        + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


HEAD = _jpeg_head(8 * BLOCKS_X, 8 * BLOCKS_Y)
TAIL = b"\xff\xd9"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _headers(frames: int, size: int) -> bytes:
    w, h = 8 * BLOCKS_X, 8 * BLOCKS_Y
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, size, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, frames, size, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)


def pad(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def encode(payload: bytes) -> bytes:
    """The payload as an AVI file of motion-JPEG frames; its length goes into a ``plen`` chunk."""
    frames = -(-len(payload) // FRAME)
    v = np.zeros(frames * FRAME, np.int16)
    v[: len(payload)] = np.frombuffer(payload, np.uint8)
    v = v.reshape(frames, FRAME) - np.int16(128)
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    scans = ENCODE[d + np.int16(255)].astype(">u2")
    size = len(HEAD) + 2 * FRAME + len(TAIL)
    head = b"00dc" + struct.pack("<I", size) + HEAD
    movi = np.empty((frames, len(head) + 2 * FRAME + len(TAIL)), np.uint8)  # size is even: no padding byte
    movi[:, : len(head)] = np.frombuffer(head, np.uint8)
    movi[:, len(head) : -len(TAIL)] = scans.view(np.uint8).reshape(frames, -1)
    movi[:, -len(TAIL) :] = np.frombuffer(TAIL, np.uint8)
    index = np.empty((frames, 4), "<u4")
    index[:, 0] = np.frombuffer(b"00dc", "<u4")
    index[:, 1] = 0x10
    index[:, 2] = 4 + movi.shape[1] * np.arange(frames)
    index[:, 3] = size
    body = b"".join((b"AVI ", _headers(frames, size), _chunk(b"plen", struct.pack("<Q", len(payload))), _chunk(b"LIST", b"movi" + movi.tobytes()), _chunk(b"idx1", index.tobytes())))
    return b"RIFF" + struct.pack("<I", len(body)) + body


assert len(HEAD) % 2 == 0 or (len(HEAD) + len(TAIL)) % 2 == 0


def parse(avi: bytes) -> tuple[list[bytes], int | None, float]:
    """Frames by the ``idx1`` index (by walking ``movi`` where there is none), payload length, frame rate."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, length, rate = 12, None, None, None, float(FPS)
    end = min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0])
    while at + 8 <= end:
        kind, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if kind == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif kind == b"LIST" and avi[at + 8 : at + 12] == b"hdrl" and avi[at + 12 : at + 16] == b"avih":
            rate = 1e6 / max(1, struct.unpack_from("<I", avi, at + 20)[0])
        elif kind == b"idx1":
            index = np.frombuffer(avi, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
        elif kind == b"plen":
            length = struct.unpack_from("<Q", avi, at + 8)[0]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    if index is not None:
        base = movi[0] if not len(index) or index[0, 2] < movi[0] else 0  # offsets count from movi or from the file's start
        for kind, _, offset, size in index.tolist():
            if kind >> 16 in (0x6364, 0x6264):  # ..dc, ..db
                frames.append(avi[base + offset + 8 : base + offset + 8 + size])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", avi, at + 4)[0]
            if avi[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(avi[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return frames, length, rate


def decode_samples(frames: list[bytes]) -> np.ndarray:
    """Block means of every frame, one row per frame. Frames written by ``encode`` go
    through the look-up; other baseline frames through ``jpeg.decode``."""
    n = len(HEAD)
    if all(f[:n] == HEAD and len(f) == n + 2 * FRAME + 2 for f in frames):
        d = DECODE[np.frombuffer(b"".join([f[n:-2] for f in frames]), ">u2")]
        if (d == 999).any():
            raise ValueError("bad Huffman code")
        return (np.cumsum(d.reshape(len(frames), FRAME), axis=1, dtype=np.int32) + 128).astype(np.uint8)
    from fieldspark.llm import jpeg

    return jpeg.block_means(frames)


def shots(samples: np.ndarray, window: int = 12, factor: float = 3.0, floor: float = 0.25) -> list[int]:
    """First frame of each shot. A cut is where the histogram difference exceeds the mean of
    the differences before it (``window`` at most) by ``factor`` deviations and ``floor``."""
    n = len(samples)
    if n < 2:
        return [0] if n else []
    at = (samples >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    h = np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    c1, c2 = np.concatenate(([0.0], np.cumsum(d))), np.concatenate(([0.0], np.cumsum(d * d)))
    k = np.arange(n - 1)
    lo = np.maximum(0, k - window)
    m = np.maximum(1, k - lo)
    mean = (c1[k] - c1[lo]) / m
    dev = np.sqrt(np.maximum(0.0, (c2[k] - c2[lo]) / m - mean * mean))
    return [0, *(np.flatnonzero((d > mean + factor * dev) & (d > floor) | (k == 0) & (d > 2 * floor)) + 1).tolist()]


def _feature(samples: np.ndarray, starts: list[int], count: int) -> str:
    used = samples.ravel()[:count]
    h = np.bincount(used >> 4, minlength=BINS)
    return f"frames={len(samples)};shots={len(starts)};cuts={hashlib.md5(','.join(map(str, starts)).encode()).hexdigest()[:8]};mean={int(used.sum(dtype=np.int64)) * 100 // max(1, count)};hist={'-'.join(map(str, h.tolist()))}"


def digest(text: bytes | None) -> tuple:
    """Store one text, read it back and describe it."""
    payload = pad(text)
    media = encode(payload)
    frames, length, _ = parse(media)
    samples = decode_samples(frames)
    back = samples.tobytes()[:length]
    return len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), _feature(samples, shots(samples), length)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def describe(docs: DataFrame) -> DataFrame:
    """One row per document: what was stored and read back (columns ``DIGEST``)."""

    def run(batches):
        for b in batches:
            for start, end in store.slices(b.column(1)):
                part = b.slice(start, end - start)
                cols = list(zip(*[digest(t) for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(_DIGEST)[1:]))], schema=_DIGEST)

    return store.in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, DIGEST)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI file of its text."""

    def run(batches):
        for b in batches:
            for start, end in store.slices(b.column(1)):
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(pad(t)) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return store.in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of AVI files: one row for each shot. A null file has none."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m is None:
                    continue
                frames, _, rate = parse(m)
                starts = shots(decode_samples(frames))
                out += [(i, k, s, e, s / rate, e / rate) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(frames)]))]
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return store.in_arrow(media.select("doc_id", "media"), run, "doc_id long, clip int, first_frame long, end_frame long, start_s double, end_s double")
