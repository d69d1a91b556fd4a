"""Media columns: PNG decoding and perceptual hashes.

A PNG is read chunk by chunk; every chunk's checksum is tested, and the inflated
data's own. Rows are unfiltered with numpy along diagonals, whose pixels depend on
earlier diagonals only, all small images of one shape of a batch together. Larger
and interlaced ones are inflated, unfiltered and averaged by bands of rows, so a
picture of any size takes little memory. Of the picture's brightness, averaged down to 32 x 32, the cosine transform's 8 x 8
lowest frequencies give 64 bits: whether each is above their median.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.spread import spread
from scriptorium.llm.storage import id_of, with_id

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Bytes of inflated rows up to which a picture is decoded at once, and of a band of a larger one.
AT_ONCE, BAND = 1 << 20, 1 << 20
#: First row, row step, first column and column step of the passes of interlaced pictures.
ADAM7 = ((0, 8, 0, 8), (0, 8, 4, 8), (4, 8, 0, 4), (0, 4, 2, 4), (2, 4, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1))
SIDE, LOW = 32, 8


class BadImage(ValueError):
    """Why a value can't be decoded."""


@dataclass
class Header:
    width: int
    height: int
    depth: int
    color: int
    laced: bool = False

    def row_bytes(self, width: int) -> int:
        return (width * CHANNELS[self.color] * self.depth + 7) // 8

    @property
    def step(self) -> int:
        """Bytes from a pixel's byte to the one it is filtered by."""
        return max(1, CHANNELS[self.color] * self.depth // 8)


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Type and content of each chunk up to IEND."""
    if data[:8] != SIGNATURE:
        raise BadImage("not a PNG")
    at = 8
    while True:
        if at + 12 > len(data):
            raise BadImage("truncated")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise BadImage("truncated")
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadImage("bad checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def read(data: bytes) -> tuple[Header, bytes, np.ndarray]:
    """Header, compressed rows, and palette."""
    head, palette, parts = None, np.zeros((0, 3), dtype=np.uint8), []
    for kind, body in chunks(data):
        if head is None:
            if kind != b"IHDR" or len(body) != 13:
                raise BadImage("no header")
            w, h, depth, color, method, filters, laced = struct.unpack(">IIBBBBB", body)
            if color not in DEPTHS or depth not in DEPTHS[color] or method or filters or laced > 1 or not w or not h:
                raise BadImage("bad header")
            head = Header(w, h, depth, color, bool(laced))
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif not kind[0] & 32 and kind != b"IEND":
            raise BadImage("unknown critical chunk")
    if head is None:
        raise BadImage("no header")
    if head.color == 3 and not len(palette):
        raise BadImage("no palette")
    return head, b"".join(parts), palette


class Inflate:
    """The rows of compressed data, as many at a time as are asked for."""

    def __init__(self, body: bytes):
        self.stream, self.left = zlib.decompressobj(), body

    def _some(self, size: int) -> bytes:
        try:
            out = self.stream.decompress(self.left, size)
        except zlib.error as e:
            raise BadImage("bad data") from e
        self.left = self.stream.unconsumed_tail
        return out

    def rows(self, n: int, row_bytes: int) -> np.ndarray:
        """n rows, each with its filter's number first."""
        want, parts = n * (row_bytes + 1), []
        while want and (part := self._some(want)):
            parts.append(part)
            want -= len(part)
        if want:
            raise BadImage("bad size")
        out = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(n, row_bytes + 1)
        if out[:, 0].max() > 4:
            raise BadImage("bad filter")
        return out

    def finish(self) -> None:
        """No more may follow but the checksum, which must be there and right."""
        if self._some(1):
            raise BadImage("bad size")
        if not self.stream.eof:
            raise BadImage("truncated data")


def parse(data: bytes) -> tuple[Header, np.ndarray, np.ndarray]:
    """Header, all inflated rows with their filter bytes, and palette, of a picture that isn't interlaced."""
    head, body, palette = read(data)
    inflate = Inflate(body)
    rows = inflate.rows(head.height, head.row_bytes(head.width))
    inflate.finish()
    return head, rows, palette


def unfilter(rows: np.ndarray, step: int, above: np.ndarray | None = None) -> np.ndarray:
    """Undo the filters of images [image, row, 1 + bytes] of one shape; above is the row before the first.

    In diagonal d, row y stands at pixel d - y. Its left neighbour and the one above
    are in diagonal d - 1, the corner one in d - 2. In the arrays of diagonals the row
    above has place 0, and two diagonals come before the first.
    """
    n, h, w = rows.shape[0], rows.shape[1], rows.shape[2] - 1
    kind = rows[:, :, 0]
    if not kind.any():
        return rows[:, :, 1:]
    cols = -(-w // step)
    flat = np.zeros((n, h, cols * step), dtype=np.uint8)
    flat[:, :, :w] = rows[:, :, 1:]
    flat = flat.reshape(n, h, cols, step)
    slant = np.zeros((cols + h - 1, n, h, step), dtype=np.int16)
    for y in range(h):
        slant[y : y + cols, :, y] = flat[:, y].transpose(1, 0, 2)
    done = np.zeros((cols + h + 1, n, h + 1, step), dtype=np.int16)
    if above is not None:
        top = np.zeros((n, cols * step), dtype=np.int16)
        top[:, :w] = above
        done[1 : cols + 1, :, 0] = top.reshape(n, cols, step).transpose(1, 0, 2)
    ways = np.repeat(kind[:, :, None], step, axis=2)
    for d in range(cols + h - 1):
        lo, hi = max(0, d - cols + 1), min(h, d + 1)
        left, up, corner = done[d + 1, :, lo + 1 : hi + 1], done[d + 1, :, lo:hi], done[d, :, lo:hi]
        da, db = np.abs(up - corner), np.abs(left - corner)
        dc = np.abs(left + up - corner - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = np.choose(ways[:, lo:hi], (np.int16(0), left, up, (left + up) >> 1, paeth))
        done[d + 2, :, lo + 1 : hi + 1] = (slant[d, :, lo:hi] + guess) & 255
    for y in range(h):
        flat[:, y] = done[y + 2 : y + 2 + cols, :, y + 1].transpose(1, 0, 2)
    return flat.reshape(n, h, cols * step)[:, :, :w]


def brightness(head: Header, raw: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Brightness 0 to 255 of unfiltered rows; alpha is laid over black."""
    per, n = CHANNELS[head.color], len(raw)
    if head.depth == 16:
        v = raw.reshape(n, -1, 2)[:, :, 0].astype(float) + raw.reshape(n, -1, 2)[:, :, 1] / 256.0
    elif head.depth == 8:
        v = raw.astype(float)
    else:
        bits = np.unpackbits(raw, axis=1).reshape(n, -1, head.depth)
        v = (bits @ (1 << np.arange(head.depth)[::-1])).astype(float)
    v = v[:, : width * per].reshape(n, width, per)
    if head.color == 3:
        v = palette[np.minimum(v[:, :, 0].astype(int), len(palette) - 1)].astype(float)
    elif head.depth < 8:
        v = v * (255.0 / ((1 << head.depth) - 1))
    luma = v[:, :, 0] if v.shape[2] < 3 else v[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    return luma * (v[:, :, -1] / 255.0) if head.color in (4, 6) else luma


def _box(n: int, at: np.ndarray) -> np.ndarray:
    """For the samples at these places of n, SIDE weights each that average n samples down (or spread them) to SIDE."""
    lo, hi = np.arange(SIDE)[:, None] * n / SIDE, np.arange(1, SIDE + 1)[:, None] * n / SIDE
    return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) * SIDE / n


def averaged(luma: np.ndarray, height: int, width: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """What these pixels, in those rows and columns of a picture, add to its SIDE x SIDE averages."""
    across = sum(luma[:, k : k + 65536] @ _box(width, cols[k : k + 65536]).T for k in range(0, len(cols), 65536))
    return _box(height, rows) @ across


def shrink(head: Header, body: bytes, palette: np.ndarray) -> np.ndarray:
    """The SIDE x SIDE averages of a picture of any size, interlaced or not, band by band."""
    inflate, out = Inflate(body), np.zeros((SIDE, SIDE))
    for y0, dy, x0, dx in ADAM7 if head.laced else ((0, 1, 0, 1),):
        ys, xs = np.arange(y0, head.height, dy), np.arange(x0, head.width, dx)
        if not len(ys) or not len(xs):
            continue
        size, above = head.row_bytes(len(xs)), None
        band = max(1, min(256, BAND // (size + 1)))
        for y in range(0, len(ys), band):
            part = ys[y : y + band]
            raw = unfilter(inflate.rows(len(part), size)[None], head.step, above)[0]
            above = raw[-1:]
            out += averaged(brightness(head, raw, palette, len(xs)), head.height, head.width, part, xs)
    inflate.finish()
    return out


_DCT = np.cos(np.pi * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None] / SIDE)


def frequency_hash(small: np.ndarray) -> bytes:
    """64 bits of SIDE x SIDE averages, first row first: is the frequency above the median of all but the constant one?"""
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def cosine_hash(luma: np.ndarray) -> bytes:
    """The hash of a picture's brightness."""
    return frequency_hash(averaged(luma, *luma.shape, np.arange(luma.shape[0]), np.arange(luma.shape[1])))


def decode_all(values: list[bytes | None]) -> list[tuple[str, int | None, int | None, bytes | None]]:
    """Status, width, height and hash of each value."""
    out: list = [None] * len(values)
    shapes = defaultdict(list)
    for k, v in enumerate(values):
        try:
            if v is None:
                raise BadImage("null")
            head, body, palette = read(v)
            size = head.row_bytes(head.width)
            if head.laced or size * head.height > AT_ONCE:
                out[k] = ("ok", head.width, head.height, frequency_hash(shrink(head, body, palette)))
                continue
            inflate = Inflate(body)
            rows = inflate.rows(head.height, size)
            inflate.finish()
            shapes[head.height, size, head.step].append((k, head, rows, palette))
        except BadImage as e:
            out[k] = (str(e), None, None, None)
    for (_, _, step), group in shapes.items():
        at_once = max(1, AT_ONCE // group[0][2].size)
        for lo in range(0, len(group), at_once):
            part = group[lo : lo + at_once]
            for (k, head, _, palette), raw in zip(part, unfilter(np.stack([g[2] for g in part]), step)):
                out[k] = ("ok", head.width, head.height, cosine_hash(brightness(head, raw, palette, head.width)))
    return out


def image_hashes(images: DataFrame, id_col: str, png_col: str = "png") -> DataFrame:
    """(id, status, width, height, phash) of every row of a table with a PNG column.

    ``status`` is ``ok`` or says what is wrong; then, and for null, the others are
    null. Repeated rows come out alike; an empty table gives no rows. Other columns
    are not looked at, and ids may be of any type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                status, width, height, phash = zip(*decode_all(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(status), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(phash, pa.binary())], ["id", "status", "width", "height", "phash"])

    src = images.select(id_of(images, id_col).alias("id"), F.col(f"`{png_col}`").cast("binary").alias("png"))
    return src.mapInArrow(run, with_id(src, "status string, width int, height int, phash binary", "id")).withColumnRenamed("id", id_col)


def encode_png(pixels: np.ndarray, color: int, filters: np.ndarray, idat: int = 4096) -> bytes:
    """A PNG of 8-bit pixels [row, column, channel]; filters names each row's filter."""
    h, w, per = pixels.shape
    flat = pixels.reshape(h, w * per).astype(np.int16)
    up = np.vstack([np.zeros((1, w * per), dtype=np.int16), flat[:-1]])
    left, corner = (np.hstack([np.zeros((h, per), dtype=np.int16), x[:, :-per]]) for x in (flat, up))
    p = left + up - corner
    da, db, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    guess = np.stack([np.zeros_like(flat), left, up, (left + up) >> 1, paeth])[filters, np.arange(h)]
    body = zlib.compress(np.hstack([filters[:, None], (flat - guess) & 255]).astype(np.uint8).tobytes(), 6)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    parts = [chunk(b"IDAT", body[k : k + idat]) for k in range(0, len(body), idat)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")


def draw(vector: np.ndarray, key: int) -> bytes:
    """A picture of a vector: a square of cells as bright as its values, each 4 x 4 pixels.

    The key chooses grey, colour or colour with alpha, and the rows' filters.
    """
    side = max(1, int(np.ceil(np.sqrt(len(vector)))))
    cells = np.zeros(side * side)
    v = np.nan_to_num(np.asarray(vector, dtype=np.float64))
    cells[: len(v)] = v
    span = cells.max() - cells.min()
    grey = np.round((cells - cells.min()) / span * 255 if span else cells * 0).astype(np.uint8)
    grey = np.kron(grey.reshape(side, side), np.ones((4, 4), dtype=np.uint8))
    color = (0, 2, 6)[key % 3]
    pixels = np.repeat(grey[:, :, None], CHANNELS[color], axis=2)
    if color == 6:
        pixels[:, :, 3] = 255
    return encode_png(pixels, color, (np.arange(4 * side) + key) % 5, 512)


def pictures(embeddings: DataFrame) -> DataFrame:
    """(vec_id, png): a picture of every embedding; null and empty ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [draw(np.array([x or 0.0 for x in v]), i or 0) if v else None for i, v in zip(ids, vectors)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["vec_id", "png"])

    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return spread(src).mapInArrow(run, "vec_id long, png binary")
