"""Media columns: texts stored losslessly as grey-scale PNG, read back, and fingerprinted.

The writer and the reader are plain PNG: signature, length-type-data-checksum chunks, one zlib
stream over IDAT, and the five row filters, of which each row takes the one that leaves the fewest
different values (on texts this packs twice as well as least absolute differences). Filters are undone by numpy for a batch of images at once, along the
anti-diagonals: a row runs one sample behind the row above it, so all rows of all images advance by
one sample a step. The fingerprint is a perceptual hash from the low frequencies of a cosine
transform of the samples. The images are written to a table with a binary column, and everything
after that is computed from the bytes read back.

Defined cases: a null text is the empty text; the empty text is stored as one row of 64 zero
samples; equal texts, repeated rows too, give equal values in every column; very long texts are one
tall image; an empty table gives an empty result; extra input columns are ignored. A damaged image
(bad signature, checksum, length or filter) raises ValueError and is never read as data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bytes_of

#: Fixed by the PNG specification.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _guesses(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> list[np.ndarray]:
    """What each of the five filters takes off a sample, from its neighbours (int16)."""
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return [np.zeros_like(left), left, up, (left + up) >> 1, paeth]


def filter_rows(samples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 1 + width) filtered rows of one or more images; first tells which rows begin an image."""
    x = samples.astype(np.int16)
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    up[first] = 0
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], corner[:, 1:] = x[:, :-1], up[:, :-1]
    rows = np.empty((len(x), x.shape[1] + 1), np.uint8)
    least = np.full(len(x), x.shape[1] + 1)
    for kind, guess in enumerate(_guesses(left, up, corner)):
        rest = (x - guess).astype(np.uint8)
        cost = 1 + np.count_nonzero(np.diff(np.sort(rest, 1), axis=1), axis=1)
        better = cost < least
        rows[better, 0], rows[better, 1:], least = kind, rest[better], np.minimum(cost, least)
    return rows


def _image(rows: np.ndarray, level: int) -> bytes:
    head = struct.pack(">IIBBBBB", rows.shape[1] - 1, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey image of (height, width) samples."""
    return _image(filter_rows(samples, np.arange(len(samples)) == 0), level)


def encode_texts(texts: list[bytes], level: int = 6) -> list[bytes]:
    """An image of WIDTH samples a row of each text; the rows of all are filtered together."""
    padded = [pad(t) for t in texts]
    ends = np.cumsum([len(t) // WIDTH for t in padded])
    if not len(ends):
        return []
    first = np.zeros(ends[-1], bool)
    first[np.append(0, ends[:-1])] = True
    rows = filter_rows(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, WIDTH), first)
    return [_image(x, level) for x in np.split(rows, ends[:-1])]


def chunks_of(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk, after testing its checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG: bad signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("truncated chunk header")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png):
            raise ValueError(f"truncated chunk {kind!r}")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r} does not hold")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no IEND chunk")


def _unfilter_alike(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of images of one width, in as many steps as the tallest has rows and columns.

    At step t row y is at its sample t - y, in lane y modulo the number of lanes. So the sample to
    the left is the lane's own of the step before, the one above the lane before's, and the one at
    the corner the lane before's of two steps before.
    """
    high, width = max(map(len, images)), images[0].shape[1] - 1
    lanes, steps, n = min(high, width), high + width - 1, len(images)
    rows = np.zeros((n, high, width + 1), np.uint8)
    for row, image in zip(rows, images, strict=True):
        row[: len(image)] = image
    kinds = rows[:, :, 0]
    if kinds.max() > 4:
        raise ValueError(f"unknown row filter {int(kinds.max())}")
    wave = np.zeros((steps, n, lanes), np.uint8)
    for y in range(high):
        wave[y : y + width, :, y % lanes] = rows[:, y, 1:].T
    kind = np.zeros((n, lanes), np.int8)
    now, before = np.zeros((n, lanes), np.int16), np.zeros((n, lanes), np.int16)
    for t in range(steps):
        left, up, corner = now, np.roll(now, 1, 1), np.roll(before, 1, 1)
        if t < high:  # a row begins
            k = t % lanes
            kind[:, k] = kinds[:, t]
            left = left.copy()
            left[:, k] = corner[:, k] = 0
        if t < width:  # nothing is above the first row
            up[:, 0] = corner[:, 0] = 0
        before, now = now, (wave[t] + np.choose(kind, _guesses(left, up, corner))) & 255
        wave[t] = now
    for y in range(high):
        rows[:, y, 1:] = wave[y : y + width, :, y % lanes].T
    return [row[: len(image), 1:] for row, image in zip(rows, images, strict=True)]


#: Samples of images that are unfiltered together.
TOGETHER = 1 << 19


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """(height, width) samples from (height, 1 + width) filtered rows of each image, one byte a sample."""
    out: list = [None] * len(images)
    order = sorted((i for i in range(len(images)) if images[i].size), key=lambda i: (images[i].shape[1], len(images[i])))
    group: list[int] = []
    for i in [*order, None]:
        if group and (i is None or images[i].shape[1] != images[group[0]].shape[1] or 3 * len(images[i]) > 4 * len(images[group[0]]) + 12 or (len(group) + 1) * images[i].size > TOGETHER):
            for k, samples in zip(group, _unfilter_alike([images[k] for k in group]), strict=True):
                out[k] = samples
            group = []
        group.append(i)
    return [x[:, 1:] if y is None else y for x, y in zip(images, out, strict=True)]


def _rows_of(png: bytes) -> np.ndarray:
    """The (height, 1 + width) filtered rows of an 8-bit, non-interlaced grey image."""
    head, packed = None, []
    for kind, data in chunks_of(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind[0] < 97 and kind != b"IEND":
            raise ValueError(f"critical chunk {kind!r} is not supported")
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing are supported")
    width, height = head[:2]
    try:
        flat = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"image data cannot be inflated: {e}") from e
    if len(flat) != height * (width + 1):
        raise ValueError(f"{len(flat)} bytes of image data, not {height * (width + 1)}")
    return np.frombuffer(flat, np.uint8).reshape(height, width + 1)


def decode_pngs(images: list[bytes]) -> list[np.ndarray]:
    """The (height, width) samples of 8-bit, non-interlaced grey images."""
    return unfilter([_rows_of(x) for x in images])


def decode_png(png: bytes) -> np.ndarray:
    return decode_pngs([png])[0]


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


GRID, LOW = 32, 8
_BASIS = _cosines(GRID, LOW)


def shrink(samples: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Mean sample of each cell of a grid x grid raster; every sample lands in one cell's share."""
    for axis in (0, 1):
        n = samples.shape[axis]
        if n < grid:
            samples = np.take(samples, np.arange(grid) * n // grid, axis)
        else:
            edges = np.arange(grid) * n // grid
            sums = np.add.reduceat(samples, edges, axis, dtype=np.int64 if samples.dtype == np.uint8 else None)
            shape = [1, 1]
            shape[axis] = grid
            samples = sums / np.diff([*edges, n]).reshape(shape)
    return samples.astype(np.float64)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits, as hex: which of the 8 x 8 lowest frequencies (but the mean) exceed their median."""
    low = np.round(_BASIS @ shrink(samples) @ _BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in bytes_of(batch.column("text"))]
        images = encode_texts(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def _row(n_bytes: int, image: bytes, samples: np.ndarray) -> tuple:
    payload = samples.tobytes()
    return (
        n_bytes,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-WIDTH:]),
        len(image),
        hashlib.sha256(image).hexdigest(),
        cosine_hash(samples),
    )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        images = list(bytes_of(batch.column("media")))
        rows = [_row(*x) for x in zip(batch.column("n_bytes").to_pylist(), images, decode_pngs(images), strict=True)]
        columns = [[r[i] for r in rows] for i in range(len(kinds))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names)


def to_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG in a binary column."""
    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), _encode, MEDIA_SCHEMA)


def describe_media(media: DataFrame) -> DataFrame:
    """Read stored images back and compute what SCHEMA lists from the bytes read."""
    return arrow_map(media.select("doc_id", "n_bytes", "media"), _describe, SCHEMA)


def media_digest(documents: DataFrame) -> DataFrame:
    return describe_media(Scratch(documents.sparkSession, "media").keep(to_media(documents), "png"))
