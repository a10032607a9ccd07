"""Layers in shapefiles: shapes (.shp), their index (.shx), attributes (.dbf) and system of coordinates (.prj).

A file is read by tasks over ranges of its records, found through the index; it is written by the driver, record by
record. Names of columns are cut to ten bytes, as the format asks, and told apart by a number.

Defined cases: null shapes and empty attributes are null; whole numbers of up to 9 digits are ints, longer ones longs, others
doubles; polygons are written with shells clockwise, and rings that turn the other way are read as holes of the shell that
holds them; all shapes of a file are of one kind, else InvalidInputSchemaError.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rivergraph.errors import InvalidInputSchemaError
from rivergraph.functions import geom

ROWS_A_TASK = 50_000
#: Fixed values of the format: shape types, and widths and decimals of attributes by type.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
OF_WKB = {geom.POINT: POINT, geom.MULTIPOINT: MULTIPOINT, geom.LINE: LINE, geom.MULTILINE: LINE, geom.POLYGON: POLYGON, geom.MULTIPOLYGON: POLYGON}
FIELDS = {"boolean": ("L", 1, 0), "tinyint": ("N", 4, 0), "smallint": ("N", 6, 0), "int": ("N", 9, 0), "bigint": ("N", 18, 0),
    "float": ("N", 24, 15), "double": ("N", 24, 15), "string": ("C", 254, 0)}


def _dbf(path: Path) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """Name, type, width and decimals of fields; records, where they begin, and their length."""
    with path.open("rb") as f:
        n, start, length = struct.unpack("<IHH", f.read(32)[4:12])
        fields = []
        while (raw := f.read(32))[:1] not in (b"\r", b""):
            fields.append((raw[:11].split(b"\0")[0].decode("utf-8", "replace"), chr(raw[11]), raw[16], raw[17]))
    return fields, n, start, length


def _kind(kind: str, width: int, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.DoubleType() if decimals or kind == "F" or width > 18 else T.IntegerType() if width <= 9 else T.LongType()
    return T.BooleanType() if kind == "L" else T.StringType()


def _value(raw: bytes, kind: T.DataType):
    text = raw.decode("utf-8", "replace").rstrip(" \0")
    if not text.strip() or text.strip("* ") == "":
        return None
    if isinstance(kind, T.BooleanType):
        return None if text == "?" else text in "YyTt"
    return text if isinstance(kind, T.StringType) else float(text) if isinstance(kind, T.DoubleType) else int(text)


def _wkb(raw: bytes) -> bytes | None:
    code = struct.unpack_from("<i", raw)[0]
    base = code % 10
    if code == 0:
        return None
    if base == POINT:
        return geom.build(geom.POINT, [np.frombuffer(raw, "<f8", 2, 4)])
    if base == MULTIPOINT:
        n = struct.unpack_from("<i", raw, 36)[0]
        return geom.build(geom.MULTIPOINT, list(np.frombuffer(raw, "<f8", 2 * n, 40).reshape(-1, 2)))
    if base not in (LINE, POLYGON):
        raise InvalidInputSchemaError(f"shape of an unknown kind: {code}")
    parts, n = struct.unpack_from("<ii", raw, 36)
    starts = np.frombuffer(raw, "<i4", parts, 44)
    runs = np.split(np.frombuffer(raw, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2), starts[1:])
    if base == LINE:
        return geom.build(geom.LINE if len(runs) == 1 else geom.MULTILINE, runs)
    shells = sorted(([r] for r in runs if geom.ring_area(r) <= 0), key=lambda s: -geom.ring_area(s[0]))
    for hole in (r for r in runs if geom.ring_area(r) > 0):
        home = next((s for s in shells if geom.holds(s[0], hole)), None)
        (home or shells[0]).append(hole) if shells else shells.append([hole])
    return geom.build(geom.POLYGON if len(shells) == 1 else geom.MULTIPOLYGON, shells)


def read_shp(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    base = Path(path).with_suffix("")
    shx, dbf, prj = (Path(f"{base}{s}") for s in (".shx", ".dbf", ".prj"))
    try:
        n = (shx.stat().st_size - 100) // 8
        fields, records, start, length = _dbf(dbf)
    except (OSError, struct.error) as e:
        raise InvalidInputSchemaError(f"{path}: not a readable shapefile ({e})") from e
    if records != n:
        raise InvalidInputSchemaError(f"{path}: {n} shapes, but {records} attribute records")
    of = [_kind(k, w, d) for _, k, w, d in fields]
    schema = T.StructType([*(T.StructField(f[0], k) for f, k in zip(fields, of, strict=True)), T.StructField("geometry", T.BinaryType())])
    if not n:
        return spark.createDataFrame([], schema), crs_of(prj)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    edges = np.cumsum([1, *(w for _, _, w, _ in fields)]).tolist()

    def rows(first: int, upto: int) -> Iterator[list]:
        with shx.open("rb") as index, Path(path).open("rb") as shapes, dbf.open("rb") as table:
            index.seek(100 + 8 * first)
            places = np.frombuffer(index.read(8 * (upto - first)), ">i4").reshape(-1, 2) * 2
            table.seek(start + length * first)
            for at, size in places.tolist():
                shapes.seek(at + 8)
                record = table.read(length)
                yield [*(_value(record[a:b], k) for a, b, k in zip(edges, edges[1:], of, strict=False)), _wkb(shapes.read(size))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                held: list[list] = []
                for row in rows(part * ROWS_A_TASK, min(n, (part + 1) * ROWS_A_TASK)):
                    held.append(row)
                    if len(held) == 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    parts = -(-n // ROWS_A_TASK)
    return spark.range(0, parts, 1, parts).mapInArrow(run, schema), crs_of(prj)


def crs_of(prj: Path) -> str | None:
    """The last authority named in the text; texts that name none are of no known system."""
    found = re.findall(r'(?:AUTHORITY|ID)\["(\w+)",\s*"?(\d+)"?\]', prj.read_text()) if prj.is_file() else []
    return f"{found[-1][0].upper()}:{found[-1][1]}" if found else None


def _shape(wkb: bytes | None) -> tuple[int, bytes, np.ndarray | None]:
    """Kind, record and points; a null shape is of kind 0."""
    if wkb is None:
        return 0, struct.pack("<i", 0), None
    kind, parts = geom.parse(wkb)
    code = OF_WKB[kind]
    if not parts:
        return 0, struct.pack("<i", 0), None
    if code == POINT:
        p = np.asarray(parts[0], "<f8").reshape(1, 2)
        return code, struct.pack("<i", code) + p.tobytes(), p
    if code == POLYGON:
        # shells clockwise, holes the other way
        parts = [r if (geom.ring_area(r) < 0) != bool(k) else r[::-1] for rings in parts for k, r in enumerate(rings)]
    points = np.concatenate([np.atleast_2d(r) for r in parts]).astype("<f8")
    box = struct.pack("<4d", *points.min(axis=0), *points.max(axis=0))
    if code == MULTIPOINT:
        return code, struct.pack("<i", code) + box + struct.pack("<i", len(points)) + points.tobytes(), points
    starts = np.cumsum([0, *(len(r) for r in parts[:-1])]).astype("<i4")
    return code, struct.pack("<i", code) + box + struct.pack("<ii", len(parts), len(points)) + starts.tobytes() + points.tobytes(), points


def _names(names: list[str]) -> list[str]:
    """Names of ten bytes at most, each once."""
    out: list[str] = []
    for n in names:
        short, k = n.encode()[:10].decode("utf-8", "ignore"), 1
        while short.lower() in {x.lower() for x in out}:
            tail = f"_{k}"
            short, k = n.encode()[: 10 - len(tail)].decode("utf-8", "ignore") + tail, k + 1
        out.append(short)
    return out


def _text(v, kind: str, width: int, decimals: int) -> bytes:
    if v is None:
        return (b"?" if kind == "L" else b"").ljust(width)
    if kind == "L":
        return b"T" if v else b"F"
    if kind == "C":
        raw = v.encode()
        if len(raw) > width:
            raw = raw[:width].decode("utf-8", "ignore").encode()
        return raw.ljust(width)
    raw = (f"{v:.{decimals}g}" if decimals else str(v)).encode()
    if len(raw) > width:
        raise InvalidInputSchemaError(f"{v} does not fit a shapefile's field of {width} digits")
    return raw.rjust(width)


def write_shp(rows: DataFrame, crs: str | None, path: str) -> None:
    names = [n for n in rows.columns if n != "geometry"]
    kinds = [FIELDS.get(rows.schema[n].dataType.simpleString()) for n in names]
    if bad := [n for n, k in zip(names, kinds, strict=True) if k is None]:
        raise InvalidInputSchemaError(f"columns of a type that shapefiles lack: {', '.join(bad)}")
    base = Path(path).with_suffix("")
    files = [Path(f"{base}{s}") for s in (".shp", ".shx", ".dbf")]
    parts = [Path(f"{f}.part") for f in files]
    code = count = 0
    low, high = np.full(2, np.inf), np.full(2, -np.inf)
    width = 1 + sum(k[1] for k in kinds)
    with parts[0].open("wb") as shp, parts[1].open("wb") as shx, parts[2].open("wb") as dbf:
        shp.write(bytes(100))
        shx.write(bytes(100))
        head = 32 + 32 * len(names) + 1
        dbf.write(bytes(head))
        for r in rows.toLocalIterator():
            count += 1
            own, record, points = _shape(r["geometry"])
            if own and code and own != code:
                raise InvalidInputSchemaError("a shapefile holds shapes of one kind only")
            code = code or own
            if points is not None:
                low, high = np.minimum(low, points.min(axis=0)), np.maximum(high, points.max(axis=0))
            shx.write(struct.pack(">ii", shp.tell() // 2, len(record) // 2))
            shp.write(struct.pack(">ii", count, len(record) // 2) + record)
            dbf.write(b" " + b"".join(_text(r[n], *k) for n, k in zip(names, kinds, strict=True)))
        dbf.write(b"\x1a")
        box = [*low, *high] if np.isfinite(low).all() else [0.0] * 4
        for f in (shp, shx):
            size = f.tell() // 2
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<ii8d", 1000, code or LINE, *box, 0, 0, 0, 0))
        dbf.seek(0)
        dbf.write(struct.pack("<B3BIHH20x", 3, 126, 1, 1, count, head, width))
        for n, (kind, size, decimals) in zip(_names(names), kinds, strict=True):
            dbf.write(n.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes((size, decimals)) + bytes(14))
        dbf.write(b"\r")
    for part, f in zip(parts, files, strict=True):
        os.replace(part, f)
    Path(f"{base}.cpg").write_text("UTF-8")
    prj = Path(f"{base}.prj")
    if crs:
        name, _, number = crs.partition(":")
        prj.write_text(f'LOCAL_CS["{crs}",UNIT["metre",1],AUTHORITY["{name}","{number}"]]')
    else:
        prj.unlink(missing_ok=True)
