"""PPM, PNG and BMP files to planes and back."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest side that a browser decodes; ``read`` takes longer ones at evenly spread samples if given it as ``side``.
DECODE_SIDE = 2048


def decode_ppm(data: bytes) -> np.ndarray:
    """(h, w, 3) of a binary PPM with 8-bit samples; anything else fails."""
    header = re.match(rb"P6(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not header or header[3] != b"255" or not int(header[1]) or not int(header[2]):
        raise ValueError("no 8-bit P6 file")
    w, h = int(header[1]), int(header[2])
    body = data[header.end() : header.end() + 3 * w * h]
    if len(body) < 3 * w * h:
        raise ValueError("the PPM file ends early")
    return np.frombuffer(body, np.uint8).reshape(h, w, 3)


def encode_ppm(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """(h, w, 3) of an uncompressed 24-bit BMP."""
    if data[:2] != b"BM" or int.from_bytes(data[28:30], "little") != 24 or int.from_bytes(data[30:34], "little"):
        raise ValueError("no plain 24-bit BMP file")
    start, w, h = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (10, 18, 22))
    line = (3 * w + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : 3 * w].reshape(abs(h), w, 3)
    return (rows[::-1] if h > 0 else rows)[:, :, ::-1]


def encode_bmp(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    line = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    head = [(54 + line * h, 4), (0, 4), (54, 4), (40, 4), (w, 4), (h, 4), (1, 2), (24, 2), (0, 4), (line * h, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)]
    return b"BM" + b"".join(v.to_bytes(n, "little") for v, n in head) + rows.tobytes()


_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the PNG's kind of colour; a palette has 1.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one nearest to left + up - corner, in that order."""
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    near_left, near_up, near_corner = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((near_left <= near_up) & (near_left <= near_corner), a, np.where(near_up <= near_corner, b, c)).astype(np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    """A lossless PNG of 1, 2, 3 or 4 channels of bytes; each row is filtered the way whose rests are smallest."""
    h, w, n = image.shape
    rows = np.ascontiguousarray(image, np.uint8).reshape(h, w * n)
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, n:], corner[:, n:] = rows[:, :-n], up[:, :-n]
    mean = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    ways = np.stack([rows, rows - left, rows - up, rows - mean, rows - _paeth(left, up, corner)])
    best = np.abs(ways.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    data = np.concatenate([best[:, None].astype(np.uint8), ways[best, np.arange(h)]], 1)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes((8, kind, 0, 0, 0))
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfiltered(way: int, row: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    """A row of (w, n) rests as samples; what depends on the left neighbour goes pixel by pixel."""
    if way == 0:
        return row
    if way == 1:
        return row.cumsum(0, dtype=np.uint8)
    if way == 2:
        return row + up
    if way not in (3, 4):
        raise ValueError("no filter of PNG")
    out, left, corner = np.empty_like(row), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(len(row)):
        guess = ((left.astype(np.uint16) + up[k]) >> 1).astype(np.uint8) if way == 3 else _paeth(left, up[k], corner)
        left, corner = row[k] + guess, up[k]
        out[k] = left
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, 1, 2, 3 or 4) of a PNG of 8 bits a sample that is not interlaced; palettes become colours, with alpha where they have it."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    at, parts = 8, {}
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError("a chunk of the PNG file is damaged")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
        if kind == b"IEND":
            break
    else:
        raise ValueError("the PNG file ends early")
    head = parts[b"IHDR"]
    w, h, depth, colour, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    if depth != 8 or interlaced or colour not in _SAMPLES or not w or not h:
        raise ValueError("no plain 8-bit PNG file")
    n = _SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)
    if len(raw) < h * (1 + w * n):
        raise ValueError("the PNG file ends early")
    raw = raw[: h * (1 + w * n)].reshape(h, 1 + w * n)
    out, up = np.empty((h, w, n), np.uint8), np.zeros((w, n), np.uint8)
    for y in range(h):
        up = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:].reshape(w, n), up, n)
    if colour == 3:
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        if b"tRNS" in parts:
            alpha = np.full((len(palette), 1), 255, np.uint8)
            alpha[: len(parts[b"tRNS"]), 0] = np.frombuffer(parts[b"tRNS"], np.uint8)
            palette = np.concatenate([palette, alpha], 1)
        out = palette[out[:, :, 0]]
    return out


def over_white(image: np.ndarray) -> np.ndarray:
    """Three channels: one as grey, alpha (the second or fourth) over white."""
    n = image.shape[2]
    if n in (2, 4):
        alpha = image[:, :, n - 1 :].astype(float) / 255.0
        image = np.floor(image[:, :, : n - 1] * alpha + 255.0 * (1.0 - alpha) + 0.5).astype(np.uint8)
    return image if image.shape[2] == 3 else image.repeat(3, 2)


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) of a file of any known form, told by its first bytes."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_png(data) if data[:8] == _SIGNATURE else decode_ppm(data)


def encode(image: np.ndarray, form: str) -> bytes:
    """A file's bytes; forms without alpha show it over white."""
    if form == "png":
        return encode_png(image)
    if form not in ("ppm", "bmp"):
        raise ValueError(f"unknown form {form}")
    return (encode_bmp if form == "bmp" else encode_ppm)(over_white(image))


def fitted(image: np.ndarray, side: int = DECODE_SIDE) -> np.ndarray:
    """The image with no side over ``side``, proportions kept, each side at least 1."""
    h, w = image.shape[:2]
    if max(h, w) <= side:
        return image
    nh, nw = (max(1, round(n * side / max(h, w))) for n in (h, w))
    return image[(np.arange(nh) * h // nh)][:, np.arange(nw) * w // nw]


def read(spark: SparkSession, path: str, glob: str = "*.{ppm,bmp,png}", side: int | None = None) -> DataFrame:
    """Planes (image_id = path, c = 0, 1, ..., alpha last) of the image files at ``path``, whole unless ``side`` caps their sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                image = decode(data)
                image = image if side is None else fitted(image, side)
                h, w, n = image.shape
                yield pa.RecordBatch.from_pydict({"image_id": [name] * n, "c": pa.array(range(n), pa.int32()), "w": pa.array([w] * n, pa.int32()), "h": pa.array([h] * n, pa.int32()), "v": pa.array([image[:, :, c].reshape(-1).astype(float) for c in range(n)], pa.list_(pa.float64()))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "image_id string, c int, w int, h int, v array<double>")


def interleaved(planes: DataFrame) -> DataFrame:
    """(image_id, w, h, px): the planes of each image as one array of samples, channel by channel in each pixel.

    An image has 1, 3 or 4 channels, from 0 on; others fail.
    """
    rows = planes.groupBy("image_id", "w", "h").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("p"))
    whole = F.size("p").isin(1, 3, 4) & F.forall(F.transform("p", lambda p, i: p["c"] == i), lambda same: same)
    rows = rows.withColumn("p", F.when(whole, F.col("p")).otherwise(F.raise_error(F.lit("an image has other channels than 1, 3 or 4 from 0 on")).cast(rows.schema["p"].dataType)))
    return rows.select("image_id", "w", "h", F.flatten(F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.transform("p", lambda p: F.get(p["v"], i)))).alias("px"))


def deinterleaved(images: DataFrame, channels: int) -> DataFrame:
    """The inverse of ``interleaved``."""
    c = F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("c")
    return images.select("image_id", c, "w", "h", "px").select("image_id", "c", "w", "h", F.filter("px", lambda _, i: i % channels == F.col("c")).alias("v"))


def write(planes: DataFrame, folder: str, form: str = "ppm") -> None:
    """One file for each image of byte planes (1, 3 or 4 channels), all or none: see ``datasource``."""
    from .datasource import register

    register(planes.sparkSession)
    interleaved(planes).select(F.col("image_id").cast("string").alias("image_id"), "w", "h", F.transform("px", lambda v: v.cast("int")).alias("px")).write.format(form).mode("append").option("path", folder).save()


def write_tiles(tiles: DataFrame, folder: str, scale: int) -> None:
    """One PPM file for each image of byte tiles (image_id, c, size, t, v); one task has the tiles of an image and holds one at a time."""
    import os

    def save(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        files: dict[str, np.memmap] = {}
        for r in rows:
            t, w, h = r["t"], r["size"]["w"] * scale, r["size"]["h"] * scale
            name = os.path.join(folder, f"{os.path.splitext(os.path.basename(str(r['image_id'])))[0]}.ppm")
            if name not in files:
                head = b"P6\n%d %d\n255\n" % (w, h)
                with open(name, "wb") as f:
                    f.write(head)
                    f.truncate(len(head) + 3 * w * h)
                files[name] = np.memmap(name, np.uint8, "r+", len(head), (h, w, 3))
            v = np.array(r["v"], np.uint8).reshape(t["ph"] * scale, t["pw"] * scale)
            y, x, y1, x1 = (t[k] * scale for k in ("vy0", "vx0", "vy1", "vx1"))
            py, px = t["py0"] * scale, t["px0"] * scale
            files[name][y:y1, x:x1, r["c"]] = v[y - py : y1 - py, x - px : x1 - px]
        for m in files.values():
            m.flush()

    tiles.repartition("image_id").foreachPartition(save)
