"""Grids in GeoTIFF files, read by window and written in tiles.

A file is read by tasks over its blocks (tiles or strips): only blocks that meet the window are read, each by its own
offset, so the path must be one that all executors can open. Band 1 counts. A grid is written from a table of cells: each
tile of 256 x 256 is packed by a task, and the driver puts the packed tiles one after another into the file, which appears
when it is whole.

Read: classic and BigTIFF, either byte order, without compression or deflated, predictors 1 to 3, integers and floats.
Written: deflated tiles, BigTIFF where offsets could pass 32 bits. Other files raise InvalidInputSchemaError.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivergraph.errors import InvalidInputSchemaError

TILE = 256
#: Fixed values of the format: bytes of a value by type, tags, and the keys of the system of coordinates.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, MATRIX, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
_MODEL, _RASTER, _GEOGRAPHIC, _PROJECTED, _UNITS = 1024, 1025, 2048, 3072, 3076
_METRE, _USER = 9001, 32767
_KINDS = {1: "u", 2: "i", 3: "f"}


class Grid(NamedTuple):
    """Where and how a file holds its cells. transform: x0, dx, xskew, y0, yskew, dy (a cell's corner from col and row)."""

    path: str
    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]
    crs: str | None
    projected: bool
    metres: bool
    nodata: float | None
    dtype: str
    block: tuple[int, int]  # columns, rows
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    compression: int
    predictor: int
    samples: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        x0, dx, _, y0, _, dy = self.transform
        xs, ys = (x0, x0 + dx * self.width), (y0, y0 + dy * self.height)
        return min(xs), min(ys), max(xs), max(ys)


class Window(NamedTuple):
    row: int
    col: int
    height: int
    width: int


def open_grid(path: str) -> Grid:
    try:
        with Path(path).open("rb") as f:
            tags, end = _tags(f)
    except (OSError, struct.error, KeyError) as e:
        raise InvalidInputSchemaError(f"{path}: not a readable TIFF ({e})") from e
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if WIDTH not in tags or (STRIP_OFFSETS not in tags and TILE_OFFSETS not in tags):
        raise InvalidInputSchemaError(f"{path}: a TIFF without an image")
    if one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2, 3) or one(SAMPLE_FORMAT, 1) not in _KINDS:
        raise InvalidInputSchemaError(f"{path}: compression {one(COMPRESSION)}, predictor {one(PREDICTOR)} or sample format {one(SAMPLE_FORMAT)} is not known here")
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1) if one(PLANAR, 1) == 1 else 1
    block = (one(TILE_WIDTH), one(TILE_HEIGHT)) if TILE_OFFSETS in tags else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if TILE_OFFSETS in tags else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIEPOINT]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        raise InvalidInputSchemaError(f"{path}: no transform")
    keys = tags.get(GEO_KEYS, ())
    geo = {k: v for k, at, _, v in zip(keys[4::4], keys[5::4], keys[6::4], keys[7::4], strict=False) if at == 0}
    code = geo.get(_PROJECTED) or geo.get(_GEOGRAPHIC)
    nodata = bytes(tags[NODATA]).rstrip(b"\0 ").decode() if NODATA in tags else None
    return Grid(
        str(path), width, height, tuple(map(float, transform)), None if code in (None, _USER) else f"EPSG:{code}",
            geo.get(_MODEL) == 1 or _PROJECTED in geo, geo.get(_UNITS, _METRE) == _METRE,
        None if nodata is None else float(nodata), f"{end}{_KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 1) // 8}", block, tuple(offsets),
            tuple(counts), one(COMPRESSION, 1), one(PREDICTOR, 1), samples,
    )


def _tags(f) -> tuple[dict[int, tuple], str]:
    head = f.read(16)
    end = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(end + "H", head[2:4])[0] == 43
    word, count_size, entry = ("Q", 8, 20) if big else ("I", 2, 12)
    at = struct.unpack(end + word, head[8:16] if big else head[4:8])[0]
    f.seek(at)
    n = struct.unpack(end + ("Q" if big else "H"), f.read(count_size))[0]
    raw, tags = f.read(n * entry), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(end + "HH" + word, raw, k * entry)
        size, inline = _SIZES[kind] * count, raw[k * entry + (12 if big else 8) : (k + 1) * entry]
        if size > len(inline):
            f.seek(struct.unpack(end + word, inline)[0])
            inline = f.read(size)
        if kind in _CODES:
            tags[tag] = struct.unpack(f"{end}{count}{_CODES[kind]}", inline[:size])
    return tags, end


def _block(grid: Grid, number: int) -> np.ndarray:
    """Band 1 of a block, rows by columns, as floats; NaN where there is no data."""
    cols, rows = grid.block
    if not grid.counts[number]:
        return np.full((rows, cols), np.nan)
    with Path(grid.path).open("rb") as f:
        f.seek(grid.offsets[number])
        raw = f.read(grid.counts[number])
    raw = raw if grid.compression == 1 else zlib.decompress(raw)
    kind = np.dtype(grid.dtype)
    rows = min(rows, len(raw) // (cols * grid.samples * kind.itemsize))
    if grid.predictor == 3:  # bytes by significance, differenced along a row
        planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * cols * grid.samples * kind.itemsize).reshape(rows, -1, grid.samples), axis=1,
            dtype=np.uint8).reshape(rows, kind.itemsize, cols * grid.samples)
        data = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, grid.samples)
    else:
        data = np.frombuffer(raw, kind, rows * cols * grid.samples).reshape(rows, cols, grid.samples)
        if grid.predictor == 2:
            data = np.cumsum(data, axis=1, dtype=kind.newbyteorder("="))
    out = data[:, :, 0].astype(float)
    if grid.nodata is not None and not math.isnan(grid.nodata):
        out[out == float(np.asarray(grid.nodata).astype(kind))] = np.nan
    return out


def read_cells(spark: SparkSession, grid: Grid, window: Window | None = None) -> DataFrame:
    """row, col (counted from the window's corner), z; cells without data have no row."""
    w = window or Window(0, 0, grid.height, grid.width)
    across = -(-grid.width // grid.block[0])
    down, right = range(w.row // grid.block[1], -(-(w.row + w.height) // grid.block[1])), range(w.col // grid.block[0], -(-(w.col + w.width) // grid.block[0]))
    n = len(down) * len(right)
    kinds = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("z", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                r, c = down[k // len(right)], right[k % len(right)]
                data = _block(grid, r * across + c)
                row, col = np.nonzero(np.isfinite(data))
                z = data[row, col]
                row, col = row + r * grid.block[1] - w.row, col + c * grid.block[0] - w.col
                inside = (row >= 0) & (row < w.height) & (col >= 0) & (col < w.width)
                yield pa.RecordBatch.from_arrays([pa.array(x[inside], f.type) for x, f in zip((row.astype(np.int32), col.astype(np.int32), z), kinds, strict=True)], schema=kinds)

    return spark.range(0, n, 1, max(1, min(n, 4096))).mapInArrow(run, "row int, col int, z double")


def window_of(grid: Grid, bounds: tuple[float, float, float, float]) -> Window:
    """The least window of whole cells that holds the bounds, within the grid."""
    x0, dx, _, y0, _, dy = grid.transform
    cols, rows = sorted(((bounds[0] - x0) / dx, (bounds[2] - x0) / dx)), sorted(((bounds[1] - y0) / dy, (bounds[3] - y0) / dy))
    col, row = max(0, math.floor(cols[0])), max(0, math.floor(rows[0]))
    return Window(row, col, min(grid.height, math.ceil(rows[1])) - row, min(grid.width, math.ceil(cols[1])) - col)


def window_transform(grid: Grid, window: Window) -> tuple[float, float, float, float, float, float]:
    x0, dx, sx, y0, sy, dy = grid.transform
    return x0 + dx * window.col + sx * window.row, dx, sx, y0 + sy * window.col + dy * window.row, sy, dy


def packed_tiles(cells: DataFrame, value: str, dtype: str, nodata: float) -> DataFrame:
    """tile row, tile column, data: deflated tiles of the cells (row, col, value) that there are."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((TILE, TILE), nodata, dtype)
        out[pdf["row"] % TILE, pdf["col"] % TILE] = pdf["v"].astype(dtype)
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "data": [zlib.compress(out.tobytes(), 6)]})

    held = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("v"),
        F.expr(f"row div {TILE}").alias("tr"), F.expr(f"col div {TILE}").alias("tc"))
    return held.groupBy("tr", "tc").applyInPandas(one, "tr long, tc long, data binary")


def write_grid(cells: DataFrame, value: str, path: str, *, width: int, height: int, transform: tuple, crs: str | None, dtype: str,
    nodata: float, notes: dict[str, object] | None = None) -> None:
    """Write the cells (row, col, value) as one file; cells that are not there get nodata."""
    kind = np.dtype(dtype).newbyteorder("<")
    across, down = -(-width // TILE), -(-height // TILE)
    big = across * down * TILE * TILE * kind.itemsize > 2_000_000_000
    word, code = ("Q", 16) if big else ("I", 4)
    part = f"{path}.part"
    blank = zlib.compress(np.full((TILE, TILE), nodata, kind).tobytes(), 6)
    offsets, counts = np.zeros((down, across), np.uint64), np.zeros((down, across), np.uint64)
    try:
        with Path(part).open("wb") as f:
            f.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
            at = f.tell()
            f.write(blank)
            offsets[:], counts[:] = at, len(blank)
            for r in packed_tiles(cells, value, kind.str, nodata).toLocalIterator():
                offsets[r["tr"], r["tc"]], counts[r["tr"], r["tc"]] = f.tell(), len(r["data"])
                f.write(r["data"])
            x0, dx, sx, y0, sy, dy = transform
            text = lambda s: (2, (s + "\0").encode("latin-1", "replace"))
            number = lambda c, *v: (c, struct.pack(f"<{len(v)}{_CODES[c]}", *v))
            tags = {
                WIDTH: number(4, width), HEIGHT: number(4, height), BITS: number(3, 8 * kind.itemsize), COMPRESSION: number(3, 8),
                    PHOTOMETRIC: number(3, 1), SAMPLES: number(3, 1), PLANAR: number(3, 1),
                TILE_WIDTH: number(3, TILE), TILE_HEIGHT: number(3, TILE), TILE_OFFSETS: number(code, *offsets.ravel().tolist()),
                    TILE_COUNTS: number(code, *counts.ravel().tolist()),
                SAMPLE_FORMAT: number(3, {v: k for k, v in _KINDS.items()}[kind.kind]), NODATA: text("nan" if math.isnan(nodata) else f"{nodata:g}"),
            }
            if sx or sy or dx < 0 or dy > 0:
                tags[MATRIX] = number(12, dx, sx, 0.0, x0, sy, dy, 0.0, y0, *[0.0] * 7, 1.0)
            else:
                tags |= {PIXEL_SCALE: number(12, dx, -dy, 0.0), TIEPOINT: number(12, 0.0, 0.0, 0.0, x0, y0, 0.0)}
            if crs and crs.partition(":")[0] == "EPSG":
                tags[GEO_KEYS] = number(3, 1, 1, 0, 4, _MODEL, 0, 1, 1, _RASTER, 0, 1, 1, _PROJECTED, 0, 1, int(crs.partition(":")[2]), _UNITS, 0, 1, _METRE)
            if notes:
                tags[METADATA] = text("<GDALMetadata>" + "".join(f'<Item name="{k}">{v}</Item>' for k, v in notes.items()) + "</GDALMetadata>")
            rows = []
            for tag, (c, data) in sorted(tags.items()):
                size = 8 if big else 4
                if len(data) > size:
                    f.write(b"\0" * (-f.tell() % 8))
                    data, place = struct.pack("<" + word, f.tell()), data
                    f.write(place)
                    n = len(place) // _SIZES[c]
                else:
                    n = len(data) // _SIZES[c]
                rows.append(struct.pack("<HH" + word, tag, c, n) + data.ljust(size, b"\0"))
            f.write(b"\0" * (-f.tell() % 8))
            start = f.tell()
            f.write(struct.pack("<Q" if big else "<H", len(rows)) + b"".join(rows) + struct.pack("<" + word, 0))
            f.seek(8 if big else 4)
            f.write(struct.pack("<" + word, start))
        os.replace(part, path)
    finally:
        Path(part).unlink(missing_ok=True)
