"""Layers in FlatGeobuf files (version 3): a header and one record a feature, each a FlatBuffers table.

A file is read by one task and written by the driver, feature by feature: it is a form for exchange, Parquet is the one for
large layers. Files are written without an index; an index in a file that is read is passed over.

Defined cases: null geometries and values stay null; the geometry column is called geometry; kinds of geometry other than
points, lines, polygons and their multiples raise InvalidInputSchemaError; heights and measures are dropped.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rivergraph.errors import InvalidInputSchemaError
from rivergraph.functions import geom

#: Fixed values of the format: how a file begins, codes of column types, places of fields in the tables.
MAGIC = b"fgb\x03fgb\x00"
TYPES = {0: ("b", T.ByteType()), 1: ("B", T.ShortType()), 2: ("?", T.BooleanType()), 3: ("h", T.ShortType()), 4: ("H", T.IntegerType()),
    5: ("i", T.IntegerType()), 6: ("I", T.LongType()), 7: ("q", T.LongType()), 8: ("Q", T.LongType()), 9: ("f", T.FloatType()),
    10: ("d", T.DoubleType()), 11: ("", T.StringType()), 12: ("", T.StringType()), 13: ("", T.StringType()), 14: ("", T.BinaryType())}
CODES = {"tinyint": 0, "boolean": 2, "smallint": 3, "int": 5, "bigint": 7, "float": 9, "double": 10, "string": 11, "binary": 14}
H_NAME, H_TYPE, H_COLUMNS, H_COUNT, H_NODE, H_CRS = 0, 2, 7, 8, 9, 10
C_NAME, C_TYPE = 0, 1
R_ORG, R_CODE = 0, 1
G_ENDS, G_XY, G_TYPE, G_PARTS = 0, 1, 6, 7
F_GEOMETRY, F_PROPERTIES = 0, 1


class Table:
    """A FlatBuffers table inside a buffer."""

    def __init__(self, buf: bytes, at: int | None = None):
        self.buf = buf
        self.at = struct.unpack_from("<I", buf)[0] if at is None else at
        self.fields = self.at - struct.unpack_from("<i", buf, self.at)[0]
        self.size = struct.unpack_from("<H", buf, self.fields)[0]

    def place(self, field: int) -> int | None:
        slot = 4 + 2 * field
        off = struct.unpack_from("<H", self.buf, self.fields + slot)[0] if slot < self.size else 0
        return self.at + off if off else None

    def scalar(self, field: int, code: str, default):
        at = self.place(field)
        return default if at is None else struct.unpack_from("<" + code, self.buf, at)[0]

    def _to(self, field: int) -> int | None:
        at = self.place(field)
        return None if at is None else at + struct.unpack_from("<I", self.buf, at)[0]

    def table(self, field: int) -> Table | None:
        to = self._to(field)
        return None if to is None else Table(self.buf, to)

    def vector(self, field: int, kind: str) -> np.ndarray | None:
        to = self._to(field)
        return None if to is None else np.frombuffer(self.buf, "<" + kind, struct.unpack_from("<I", self.buf, to)[0], to + 4)

    def text(self, field: int) -> str | None:
        found = self.vector(field, "u1")
        return None if found is None else found.tobytes().decode()

    def tables(self, field: int) -> list[Table]:
        to = self._to(field)
        n = 0 if to is None else struct.unpack_from("<I", self.buf, to)[0]
        return [Table(self.buf, at + struct.unpack_from("<I", self.buf, at)[0]) for at in range((to or 0) + 4, (to or 0) + 4 + 4 * n, 4)]


def packed(fields: dict[int, object]) -> bytes:
    """A buffer with one table. Values: (code, number), bytes or str (a vector of bytes), arrays, tables as dicts, and lists
    of such. What a field points to comes after it, at a multiple of eight."""
    out = bytearray(4)

    def put(table: dict) -> int:
        known = {k: v for k, v in table.items() if v is not None}
        places, at = {}, 4
        for k, v in known.items():
            size = struct.calcsize(v[0]) if isinstance(v, tuple) else 4
            at += -at % size
            places[k], at = at, at + size
        slots = max(known, default=-1) + 1
        head = struct.pack("<HH", 4 + 2 * slots, at) + b"".join(struct.pack("<H", places.get(k, 0)) for k in range(slots))
        out.extend(b"\0" * (-(len(out) + len(head)) % 8))  # so that the table itself begins at a multiple of eight
        vtable = len(out)
        out.extend(head)
        start = len(out)
        out.extend(struct.pack("<i", start - vtable) + bytes(at - 4))
        for k, v in known.items():
            if isinstance(v, tuple):
                struct.pack_into("<" + v[0], out, start + places[k], v[1])
        for k, v in known.items():
            if not isinstance(v, tuple):
                refer(start + places[k], v)
        return start

    def refer(at: int, v) -> None:
        if isinstance(v, dict):
            to = put(v)
        else:
            kept = v.encode() if isinstance(v, str) else v
            out.extend(b"\0" * ((4 - len(out)) % 8))  # the count stands before a multiple of eight
            to = len(out)
            out.extend(struct.pack("<I", len(kept)))
            if isinstance(kept, list):
                slots = len(out)
                out.extend(bytes(4 * len(kept)))
                for k, x in enumerate(kept):
                    refer(slots + 4 * k, x)
            else:
                out.extend(kept.tobytes() if isinstance(kept, np.ndarray) else bytes(kept) + b"\0")
        struct.pack_into("<I", out, at, to - at)

    root = put(fields)
    struct.pack_into("<I", out, 0, root)
    return bytes(out)


def _shape(kind: int, parts: list) -> dict:
    if kind == geom.MULTIPOLYGON:
        return {G_TYPE: ("B", kind), G_PARTS: [_shape(geom.POLYGON, [p]) for p in parts]}
    runs = parts[0] if kind == geom.POLYGON and parts else parts
    runs = [np.atleast_2d(r) for r in runs]
    xy = np.concatenate(runs).astype("<f8").ravel() if runs else np.zeros(0)
    ends = np.cumsum([len(r) for r in runs]).astype("<u4") if len(runs) > 1 and kind in (geom.POLYGON, geom.MULTILINE) else None
    return {G_XY: xy, G_TYPE: ("B", kind), G_ENDS: ends}


def _wkb(shape: Table, default: int) -> bytes:
    kind = shape.scalar(G_TYPE, "B", 0) or default
    if not geom.POINT <= kind <= geom.MULTIPOLYGON:
        raise InvalidInputSchemaError(f"geometry of an unknown kind: {kind}")
    if kind == geom.MULTIPOLYGON:
        parts = [geom.parse(_wkb(p, geom.POLYGON))[1] for p in shape.tables(G_PARTS)]
        return geom.build(kind, [x for p in parts for x in p])
    xy = shape.vector(G_XY, "f8")
    points = (np.zeros(0) if xy is None else xy).reshape(-1, 2)
    ends = shape.vector(G_ENDS, "u4")
    runs = np.split(points, ends[:-1]) if ends is not None and len(ends) else [points] if len(points) else []
    if kind == geom.POLYGON:
        return geom.build(kind, [runs] if runs else [])
    if kind in (geom.POINT, geom.MULTIPOINT):
        return geom.build(kind, [p[None, :] for p in points])
    return geom.build(kind, runs)


def _opened(f) -> tuple[Table, int]:
    """The header, and where features begin."""
    if f.read(8)[:4] != MAGIC[:4]:
        raise InvalidInputSchemaError("not a FlatGeobuf file of version 3")
    size = struct.unpack("<I", f.read(4))[0]
    header = Table(f.read(size))
    node, n = header.scalar(H_NODE, "H", 16), header.scalar(H_COUNT, "Q", 0)
    nodes, level = 0, n
    while node and n:
        nodes += level
        if level == 1:
            break
        level = -(-level // node)
    return header, 12 + size + 40 * nodes


def read_fgb(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Rows and system of coordinates."""
    try:
        with Path(path).open("rb") as f:
            header, start = _opened(f)
    except (OSError, struct.error, IndexError) as e:
        raise InvalidInputSchemaError(f"{path}: not a readable FlatGeobuf file ({e})") from e
    columns = [(c.text(C_NAME), c.scalar(C_TYPE, "B", 0)) for c in header.tables(H_COLUMNS)]
    schema = T.StructType([*(T.StructField(n, TYPES[k][1]) for n, k in columns), T.StructField("geometry", T.BinaryType())])
    crs, default = header.table(H_CRS), header.scalar(H_TYPE, "B", 0)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def record(buf: bytes) -> list:
        feature, row = Table(buf), [None] * (len(columns) + 1)
        shape = feature.table(F_GEOMETRY)
        row[-1] = None if shape is None else _wkb(shape, default)
        found = feature.vector(F_PROPERTIES, "u1")
        data, at = b"" if found is None else found.tobytes(), 0
        while at + 2 <= len(data):
            k = struct.unpack_from("<H", data, at)[0]
            code, kind = TYPES[columns[k][1]]
            if code:
                row[k], at = struct.unpack_from("<" + code, data, at + 2)[0], at + 2 + struct.calcsize("<" + code)
            else:
                n = struct.unpack_from("<I", data, at + 2)[0]
                raw, at = data[at + 6 : at + 6 + n], at + 6 + n
                row[k] = raw if isinstance(kind, T.BinaryType) else raw.decode()
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            with Path(path).open("rb") as f:
                f.seek(start)
                rows: list[list] = []
                while size := f.read(4):
                    rows.append(record(f.read(struct.unpack("<I", size)[0])))
                    if len(rows) == 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return spark.range(0, 1, 1, 1).mapInArrow(run, schema), None if crs is None or crs.text(R_ORG) is None else f"{crs.text(R_ORG).upper()}:{crs.scalar(R_CODE, 'i', 0)}"


def write_fgb(rows: DataFrame, crs: str | None, path: str) -> None:
    names = [n for n in rows.columns if n != "geometry"]
    kinds = {n: CODES.get(rows.schema[n].dataType.simpleString()) for n in names}
    if bad := [n for n, k in kinds.items() if k is None]:
        raise InvalidInputSchemaError(f"columns of a type that FlatGeobuf lacks: {', '.join(bad)}")
    org, _, code = (crs or "").partition(":")
    header = {
        H_NAME: Path(path).stem, H_TYPE: ("B", 0), H_COLUMNS: [{C_NAME: n, C_TYPE: ("B", kinds[n])} for n in names] or None, H_NODE: ("H", 0),
        H_CRS: {R_ORG: org, R_CODE: ("i", int(code))} if code else None,
    }
    part = Path(f"{path}.part")
    count = 0
    with part.open("wb") as f:
        write = lambda b: f.write(struct.pack("<I", len(b)) + b)
        f.write(MAGIC)
        write(packed(header | {H_COUNT: ("Q", 0)}))
        for r in rows.toLocalIterator():
            count += 1
            data = bytearray()
            for k, n in enumerate(names):
                v, code = r[n], TYPES[kinds[n]][0]
                if v is None:
                    continue
                raw = struct.pack("<" + code, v) if code else (v.encode() if isinstance(v, str) else bytes(v))
                data += struct.pack("<H", k) + (raw if code else struct.pack("<I", len(raw)) + raw)
            shape = None if r["geometry"] is None else _shape(*geom.parse(r["geometry"]))
            write(packed({F_GEOMETRY: shape, F_PROPERTIES: np.frombuffer(bytes(data), np.uint8)}))
        f.seek(len(MAGIC))
        write(packed(header | {H_COUNT: ("Q", count)}))  # of the same length as before
    os.replace(part, path)
