"""Media columns: lossless greyscale PNG of byte payloads, read back and hashed by low-frequency cosines.

Writing and reading follow the format: signature, IHDR, zlib IDAT and IEND chunks, each with its checksum. A row of
samples is written under the filter whose differences have the least sum. Reading tests every checksum and undoes all
five row filters with numpy, along the anti-diagonals of all pictures of like height at once. The feature of an image is
the sign pattern of its lowest cosine-transform coefficients after the samples are averaged into a small square.

Defined results: null text is the empty text, whose payload is one padded unit; equal texts give equal values; damaged,
cut or foreign bytes raise ``ValueError`` in ``read_png``; null media gives null results; columns of ``keep`` named like
a result are left out.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_texts, offsets, read_table, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payload unit and its square: 576 bytes are 24 by 24 samples; more units make the picture higher.
UNIT, WIDTH = 576, 24
#: Side of the averaged square, and side of the block of low frequencies kept.
SQUARE, LOW = 32, 8
LEVEL = 1
#: Bytes of samples that are inflated and unfiltered at a time.
INFLATED = 12 << 20


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of the unit."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def paeth(left, up, corner):
    """Of the neighbours the one nearest to left + up - corner, in this order where equal; arrays of signed numbers."""
    by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def filtered(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of samples with the filter type in front; ``first`` numbers the top rows of the pictures."""
    here = rows.astype(np.int16)
    up = np.roll(here, 1, 0)
    up[first] = 0
    left, corner = (np.pad(x, ((0, 0), (1, 0)))[:, :-1] for x in (here, up))
    guesses = (np.zeros_like(here), left, up, (left + up) >> 1, paeth(left, up, corner))
    lines = np.stack([(here - g).astype(np.uint8) for g in guesses])
    kind = np.abs(lines.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    return np.c_[kind.astype(np.uint8), lines[kind, np.arange(len(rows))]]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_pngs(payloads: list[bytes], width: int = WIDTH) -> list[bytes]:
    """8-bit greyscale PNGs whose samples are the payloads, row by row."""
    if not payloads:
        return []
    heights = np.array([len(p) // width for p in payloads])
    edges = offsets(heights)
    lines = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width), edges[:-1])
    out = []
    for height, start, end in zip(heights.tolist(), edges[:-1], edges[1:], strict=True):
        head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines[start:end].tobytes(), LEVEL)) + _chunk(b"IEND", b""))
    return out


def unfiltered(pictures: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of pictures of filtered rows (first column: filter type) of one byte a sample and equal width.

    Pictures are taken by height, at most twice as high as others of their group, so that little is padded.
    """
    out: list = [None] * len(pictures)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, lines in enumerate(pictures):
        if len(lines) and lines[:, 0].max() > 4:
            raise ValueError(f"unknown row filter {lines[:, 0].max()}")
        if not lines[:, 0].any():
            out[i] = lines[:, 1:].copy()
        else:
            groups.setdefault((lines.shape[1], len(lines).bit_length()), []).append(i)
    for some in groups.values():
        for i, samples in zip(some, _unfiltered([pictures[i] for i in some]), strict=True):
            out[i] = samples
    return out


def _unfiltered(pictures: list[np.ndarray]) -> list[np.ndarray]:
    """The samples at x + y = d of all pictures at once: their neighbours lie on the two diagonals before."""
    high, width = max(map(len, pictures)), pictures[0].shape[1] - 1
    # Row d + 2 has, at x, the sample of line d - x.
    steps = np.zeros((high + width + 1, len(pictures), width), np.int16)
    kinds = np.zeros((high + width - 1, len(pictures), width), np.uint8)
    y, x = np.arange(high)[:, None], np.arange(width)[None, :]
    for i, lines in enumerate(pictures):
        n = len(lines)
        steps[y[:n] + x + 2, i, x] = lines[:, 1:]
        kinds[y[:n] + x, i, x] = lines[:, :1]
    for d in range(high + width - 1):
        up = steps[d + 1]
        left, corner = (np.pad(s, ((0, 0), (1, 0)))[:, :-1] for s in (up, steps[d]))
        guess = np.choose(kinds[d], (0, left, up, (left + up) >> 1, paeth(left, up, corner)))
        top = width > d >= 0  # line 0 stands at x = d: nothing lies above it
        if top:
            first, before = kinds[d, :, d], left[:, d]
            guess[:, d] = np.choose(first, (0, before, 0, before >> 1, before))
        steps[d + 2] = (steps[d + 2] + guess) & 255
    return [steps[y[: len(p)] + x + 2, i, x].astype(np.uint8) for i, p in enumerate(pictures)]


def _lines(media: bytes) -> np.ndarray:
    """Filtered rows of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, data, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(media):
            raise ValueError("no IEND")
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(media):
            raise ValueError(f"{kind!r} is cut")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("length of IHDR")
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    if shape is None:
        raise ValueError("no IHDR")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as wrong:
        raise ValueError(f"samples: {wrong}") from wrong
    if len(raw) != shape[0] * shape[1]:
        raise ValueError("number of samples")
    return np.frombuffer(raw, np.uint8).reshape(shape)


def read_png(media: bytes) -> np.ndarray:
    return unfiltered([_lines(media)])[0]


def _basis(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(low)[:, None])


_COSINES = _basis(SQUARE, LOW)


def feature(samples: np.ndarray) -> str:
    """64 sign bits, in hex, of the low frequencies against their median; the mean's bit is left out as 0."""
    flat = samples.reshape(-1).astype(np.float64)
    edges = np.linspace(0, len(flat), SQUARE * SQUARE + 1).astype(np.int64)
    first = np.minimum(edges[:-1], len(flat) - 1)
    sums = np.r_[0.0, np.cumsum(flat)]
    width = edges[1:] - edges[:-1]
    square = np.where(width > 0, (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(width, 1), flat[first]).reshape(SQUARE, SQUARE)
    low = np.rint(_COSINES @ square @ _COSINES.T * 256).reshape(-1)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def media(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` of the text and ``media`` binary, the PNG that holds it."""
    keep = tuple(k for k in keep if k not in ("n_bytes", "media"))

    def run(batch: pa.RecordBatch) -> dict:
        raws = utf8(batch.column("__text"))
        made = write_pngs([padded(raw) for raw in raws])
        return {k: batch.column(k) for k in keep} | {"n_bytes": pa.array(map(len, raws), pa.int64()), "media": pa.array(made, pa.binary())}

    own = df.select(*keep, df[text_col].cast("string").alias("__text"))
    return map_texts(own, run, ddl(own) + "n_bytes long, media binary", "__text")


#: What reading a picture back gives.
READ = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]


def read(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, payload_bytes, payload_sha256, tail_crc32 and ``feature`` of a binary column of PNGs.

    Pictures are inflated a few at a time, by the size that their heads state: about ``INFLATED`` bytes, or one alone.
    """
    keep = tuple(k for k in keep if k not in {n for n, _ in READ})

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for some in _portions(batch.column("__media").to_pylist()):
            found = iter(unfiltered([_lines(m) for m in some if m is not None]))
            rows += [_read(next(found)) if m is not None else (None,) * len(READ) for m in some]
        return {k: batch.column(k) for k in keep} | {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(READ)}

    own = df.select(*keep, df[media_col].alias("__media"))
    return map_texts(own, run, ddl(own, "__media") + "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", "__media", 8 << 20)


def _portions(stored: list[bytes | None], most: int = INFLATED) -> Iterator[list[bytes | None]]:
    some, total = [], 0
    for media in stored:
        size = 0 if media is None or len(media) < 24 else math.prod(struct.unpack(">II", media[16:24]))
        if some and total + size > most:
            yield some
            some, total = [], 0
        some.append(media)
        total += size
    if some:
        yield some


def _read(samples: np.ndarray) -> tuple:
    back = samples.tobytes()
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), feature(samples)


def op5(spark, sf_dir):
    """Sizes, digests and the feature of every document's picture, as read back from the stored bytes."""
    made = media(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    made = made.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return read(made, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
