"""Payloads as PNG images in binary columns, read back chunk by chunk, with a low-frequency cosine-transform hash.

A payload is stored losslessly as the samples of an 8-bit grey image, ``WIDTH`` to a row: signature, header, one zlib stream of
filtered rows, end; each chunk with its CRC-32.  The writer gives each row the filter of the five whose residues have the
least sum, signed.  Reading tests the signature and every chunk's checksum, inflates and undoes the filters with numpy, many
images at once: a sample needs those to its left, above and above left, so all samples on a diagonal (row plus column) of all
images are undone together.  The hash: the image is averaged to 32 x 32, its 8 x 8 lowest cosine coefficients are
compared with their median (the first, the mean, left out): 63 bits in 16 hex digits.

Defined cases: null and empty payloads are one row of blanks; any length works, in memory of a few dozen times one payload;
equal payloads give equal files and hashes; ids may be null or repeated (they must cast to long); an empty table gives an
empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import stored

WIDTH = 192
#: Bytes of payloads that are worked on at once, about.
BATCH = 4_000_000
#: Fixed values of the format.
SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class Damaged(ValueError):
    """A file that fails a test."""


def padded(payload: bytes | None) -> bytes:
    """The payload with blanks up to a positive multiple of ``WIDTH``."""
    payload = payload or b""
    return payload + b" " * (-len(payload) % WIDTH if payload else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _above(image: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row above each row, zeros above each image's ``first``."""
    out = np.zeros_like(image)
    out[1:] = image[:-1]
    out[first] = 0
    return out


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left the one that is nearest to a + b - c, in this order where distances are equal."""
    pa_, pb = np.abs(b - c), np.abs(a - c)
    pc = np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filtered(image: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of grey images, one below the other, each behind the number of its filter; ``first``: where images begin."""
    b = _above(image, first).astype(np.int16)
    a = np.zeros_like(b)
    a[:, 1:] = image[:, :-1]
    c = np.zeros_like(b)
    c[:, 1:] = b[:, :-1]
    best, least, kind = image.copy(), None, np.zeros(len(image), np.uint8)
    for k, guess in enumerate((np.zeros_like(b), a, b, (a + b) >> 1, _nearest(a, b, c))):
        rest = (image - guess).astype(np.uint8)
        cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = cost < least if least is not None else np.ones(len(image), bool)
        best[better], kind[better] = rest[better], k
        least = cost if least is None else np.minimum(least, cost)
    return np.column_stack((kind, best))


def encode_many(payloads: list[bytes], width: int = WIDTH, level: int = 1) -> list[bytes]:
    """A PNG of grey samples of each payload, a positive multiple of ``width`` bytes."""
    heights = [len(x) // width for x in payloads]
    ends = np.cumsum(heights)
    lines = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width), ends - heights)
    out = []
    for end, height in zip(ends.tolist(), heights, strict=True):
        header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines[end - height : end].tobytes(), level)) + _chunk(b"IEND", b""))
    return out


def encode(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    return encode_many([samples], width, level)[0]


def unfiltered_many(images: list[np.ndarray], step: int = 1) -> list[np.ndarray]:
    """Samples of images of one width given as filtered rows (filter number first); ``step``: bytes of a pixel."""
    heights = np.array([len(x) for x in images])
    lines = np.concatenate(images)
    if lines[:, 0].max(initial=0) > PAETH:
        raise Damaged("unknown row filter")
    width = (lines.shape[1] - 1) // step
    y = np.concatenate([np.arange(n) for n in heights])
    order = np.argsort(y, kind="stable")  # rows by their height in the image, so the rows of a diagonal are neighbours
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    y = y[order]
    above = np.where(y > 0, place[np.maximum(order - 1, 0)], len(order))  # the row of zeros
    kind = lines[order, 0]
    out = np.zeros((len(order) + 1, width + 1, step), np.int16)
    out[:-1, 1:] = lines[order, 1:].reshape(len(order), width, step)
    for t in range(width + int(y[-1]) if len(y) else 0):
        low, high = np.searchsorted(y, t - width + 1), np.searchsorted(y, t, "right")
        x = t - y[low:high] + 1
        row, up, k = np.arange(low, high), above[low:high], kind[low:high, None]
        a, b, c = out[row, x - 1], out[up, x], out[up, x - 1]
        guess = np.where(k == SUB, a, np.where(k == UP, b, np.where(k == AVERAGE, (a + b) >> 1, np.where(k == PAETH, _nearest(a, b, c), 0))))
        out[row, x] = (out[row, x] + guess) & 255
    samples = out[place, 1:].astype(np.uint8).reshape(len(place), width * step)
    return np.split(samples, np.cumsum(heights)[:-1])


def unfiltered(lines: np.ndarray, step: int = 1) -> np.ndarray:
    return unfiltered_many([lines], step)[0]


def _inflated(file: bytes) -> tuple[np.ndarray, int]:
    """Filtered rows of an 8-bit grey or RGB image without interlacing, and the bytes of a pixel."""
    if file[:8] != SIGNATURE:
        raise Damaged("no PNG signature")
    at, header, data, ended = 8, None, [], False
    while at < len(file) and not ended:
        if at + 12 > len(file):
            raise Damaged("a chunk is cut off")
        size, kind = struct.unpack(">I4s", file[at : at + 8])
        body, told = file[at + 8 : at + 8 + size], file[at + 8 + size : at + 12 + size]
        if len(told) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", told)[0]:
            raise Damaged(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or header is None:
        raise Damaged("header or end is missing")
    width, height, depth, colour, _, _, laced = header
    if depth != 8 or colour not in (0, 2) or laced:
        raise Damaged("only 8-bit grey or RGB images without interlacing")
    step = 3 if colour == 2 else 1
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as error:
        raise Damaged("pixels can't be inflated") from error
    if len(raw) != height * (width * step + 1):
        raise Damaged("size of the pixels")
    return np.frombuffer(raw, np.uint8).reshape(height, width * step + 1), step


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Samples of images, height x bytes of a row; images of one shape of row are undone together."""
    found = [_inflated(x) for x in files]
    out: list = [None] * len(files)
    for shape in {(x.shape[1], step) for x, step in found}:
        some = [k for k, (x, step) in enumerate(found) if (x.shape[1], step) == shape]
        for k, image in zip(some, unfiltered_many([found[k][0] for k in some], shape[1]), strict=True):
            out[k] = image
    return out


def decode(file: bytes) -> np.ndarray:
    return decode_many([file])[0]


def _waves(n: int, count: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(count)[:, None])


WAVES = _waves(32, 8)


def _averaged(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means of ``size`` even parts of an axis; parts share a sample where there are fewer samples."""
    n = image.shape[axis]
    first = np.arange(size) * n // size
    last = np.maximum(first + 1, (np.arange(size) + 1) * n // size)
    sums = np.concatenate((np.zeros_like(image.take([0], axis)), np.cumsum(image, axis=axis)), axis=axis)
    shape = [-1 if k == axis else 1 for k in range(2)]
    return (sums.take(last, axis) - sums.take(first, axis)) / (last - first).reshape(shape)


def wave_hash(image: np.ndarray) -> str:
    """16 hex digits: signs of the low-frequency cosine coefficients against their median."""
    small = _averaged(_averaged(image.astype(np.float64), 32, 0), 32, 1)
    low = np.round((WAVES @ small @ WAVES.T).ravel()[1:], 6)
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def bounded(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], list[int | None]]) -> Iterator[pa.Table]:
    """Rows of about ``BATCH`` bytes at a time, by the sizes of each batch's rows."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for k, n in enumerate(sizes(batch)):
            size += (n or 0) + WIDTH
            if size >= BATCH:
                yield pa.Table.from_batches([*held, batch.slice(at, k + 1 - at)]).combine_chunks()
                held, size, at = [], 0, k + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's size and its payload as a PNG in a binary column."""
    kind = docs.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bounded(batches, lambda b: pc.binary_length(b.column(1)).to_pylist()):
            raws = rows.column(1).to_pylist()
            made = [pa.array([len(x or b"") for x in raws], pa.int64()), pa.array(encode_many([padded(x) for x in raws]), pa.binary())]
            yield from pa.table([rows.column(0), *made], names=[id_col, "n_bytes", "media"]).to_batches()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("payload")).mapInArrow(run, StructType([kind]).add("n_bytes", "long").add("media", "binary"))


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """What reading each image of (doc_id, n_bytes, media) gives."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bounded(batches, lambda b: b.column("n_bytes").to_pylist()):
            out, files = [], rows.column("media").to_pylist()
            for doc, n, file, image in zip(rows.column("doc_id").to_pylist(), rows.column("n_bytes").to_pylist(), files, decode_many(files), strict=True):
                payload = image.tobytes()
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), wave_hash(image)))
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, RESULT)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: what reading its image back gives.  The images are written as a binary column and read from there."""
    return read_back(stored(encoded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text"), "media"))
