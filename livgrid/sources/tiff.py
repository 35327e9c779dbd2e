"""Single-band GeoTIFF files as rows of cells: classic TIFF, strips or tiles, stored or deflated, with the usual predictors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: bytes and codes of the field types, and tags.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIE, NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113


class Raster(NamedTuple):
    values: np.ndarray
    left: float
    top: float
    cell: tuple[float, float]
    nodata: float | None


def _tags(data: bytes) -> tuple[dict[int, tuple], str]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        where = entry[8:12] if size * n <= 4 else data[(o := struct.unpack(order + "I", entry[8:12])[0]) : o + size * n]
        out[tag] = (where[:n].split(b"\0")[0].decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{n}{code}", where[: size * n])
    return out, order


def _block(raw: bytes, shape: tuple[int, int], kind: np.dtype, compression: int, predictor: int) -> np.ndarray:
    if compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif compression != 1:
        raise ValueError(f"compression {compression} isn't read")
    rows, width = shape
    if predictor == 3:  # bytes of a row by significance, differences along it
        planes = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * width * kind.itemsize].reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[:, :, 0]
    out = np.frombuffer(raw, kind)[: rows * width].reshape(rows, width)
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def read(data: bytes) -> Raster:
    tags, order = _tags(data)
    one = lambda t, default=None: tags.get(t, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("more than one band")
    width, height = one(WIDTH), one(HEIGHT)
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8)).newbyteorder(order)
    out = np.zeros((height, width), kind.newbyteorder("="))
    if TILES in tags:
        w, h, offsets, sizes = one(TILE_W), one(TILE_H), tags[TILES], tags[TILE_BYTES]
    else:
        w, h, offsets, sizes = width, min(one(ROWS_A_STRIP, height), height), tags[STRIPS], tags[STRIP_BYTES]
    across = -(-width // w)
    for k, (o, n) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if TILES in tags else min(h, height - y)
        block = _block(data[o : o + n], (rows, w), kind, one(COMPRESSION, 1), one(PREDICTOR, 1))
        out[y : y + rows, x : x + w] = block[: height - y, : width - x]
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    text = one(NODATA)
    return Raster(out, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], (scale[0], scale[1]), float(text) if text else None)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, x, y (centres), value (null where there is no data) of raster files, a block of rows at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                raster = read(r.content)
                height, width = raster.values.shape
                col = np.arange(width)
                for y in range(0, height, 128):
                    part = raster.values[y : y + 128].astype(np.float64).ravel()
                    if raster.nodata is not None:
                        part = np.where(part == raster.nodata, np.nan, part)
                    row = np.repeat(np.arange(y, y + len(part) // width), width)
                    across = np.tile(col, len(part) // width)
                    yield pd.DataFrame({"path": r.path, "row": row, "col": across, "x": raster.left + (across + 0.5) * raster.cell[0], "y": raster.top - (row + 0.5) * raster.cell[1], "value": part})

    return files.mapInPandas(run, "path string, row long, col long, x double, y double, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
