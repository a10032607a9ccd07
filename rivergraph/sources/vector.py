"""Layers (tables with WKB geometry and a CRS) in GeoPackage files and Parquet folders.

Parquet is the form for large data: Spark reads and writes it in parallel, and the CRS is kept in the metadata of the
geometry column. A GeoPackage is one SQLite file. It is read by tasks over ranges of its primary key, so its path must be
one that all executors can open; it is written by the driver alone, row by row, holding one partition at a time.

Defined cases: null geometries stay null; the primary key of a GeoPackage is its row number and is not read; an empty layer
keeps its columns; a missing file, table or format raises one of the package's errors.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivergraph.errors import InvalidInputSchemaError, UnsupportedOutputFormatError

from . import flatgeobuf, shapefile
from .paths import FORMATS

#: Primary keys that one task reads.
ROWS_A_TASK = 100_000
#: Fixed values of the GeoPackage standard: bytes of the envelope by its code, column types, marks of the file.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
READ_TYPES = {"BOOLEAN": T.BooleanType(), "TINYINT": T.LongType(), "SMALLINT": T.LongType(), "MEDIUMINT": T.IntegerType(),
    "INT": T.LongType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
WRITE_TYPES = {"boolean": "BOOLEAN", "tinyint": "MEDIUMINT", "smallint": "MEDIUMINT", "int": "MEDIUMINT", "bigint": "INTEGER",
    "float": "DOUBLE", "double": "DOUBLE", "string": "TEXT", "binary": "BLOB"}
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300


class Layer(NamedTuple):
    rows: DataFrame
    crs: str | None


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def to_blob(wkb: bytes | None, srs_id: int) -> bytes | None:
    return None if wkb is None else b"GP" + struct.pack("<BBi", 0, 1, srs_id) + bytes(wkb)


def from_blob(blob: bytes | None) -> bytes | None:
    """The WKB of a GeoPackage geometry."""
    if blob is None:
        return None
    if blob[:2] != b"GP" or (code := blob[3] >> 1 & 7) not in ENVELOPE:
        raise InvalidInputSchemaError("not a GeoPackage geometry")
    return blob[8 + ENVELOPE[code] :]


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> Layer:
    """The named layer, or the file's first; its geometry column is called geometry."""
    if not os.path.isfile(path):
        raise InvalidInputSchemaError(f"{path}: no such file")
    try:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            found = db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by rowid").fetchall()
            found = [x for x in found if layer in (None, x[0])]
            if not found:
                raise InvalidInputSchemaError(f"{path}: no layer {layer or ''}")
            name, geometry, srs = found[0]
            of = db.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (srs,)).fetchone()
            columns = [(c[1], c[2].upper().partition("(")[0]) for c in db.execute(f"pragma table_info({_quoted(name)})") if not c[5]]
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(name)}").fetchone()
    except sqlite3.DatabaseError as e:
        raise InvalidInputSchemaError(f"{path}: not a GeoPackage ({e})") from e
    crs = f"{of[0].upper()}:{of[1]}" if of and srs > 0 else None
    schema = T.StructType([T.StructField("geometry" if c == geometry else c, T.BinaryType() if c == geometry else READ_TYPES.get(t, T.StringType())) for c, t in columns])
    if low is None:
        return Layer(spark.createDataFrame([], schema), crs)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, at = to_arrow_schema(schema), [c for c, _ in columns].index(geometry)
    flags = [i for i, f in enumerate(schema) if isinstance(f.dataType, T.BooleanType)]
    query = f"select {', '.join(_quoted(c) for c, _ in columns)} from {_quoted(name)} where rowid >= ? and rowid < ?"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    begin = low + part * ROWS_A_TASK
                    cursor = db.execute(query, (begin, begin + ROWS_A_TASK))
                    while rows := cursor.fetchmany(5_000):
                        cols = [list(c) for c in zip(*rows, strict=True)]
                        cols[at] = [from_blob(x) for x in cols[at]]
                        for i in flags:
                            cols[i] = [None if x is None else bool(x) for x in cols[i]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    parts = (high - low) // ROWS_A_TASK + 1
    return Layer(spark.range(0, parts, 1, parts).mapInArrow(run, schema), crs)


def write_gpkg(layer: Layer, path: str) -> None:
    """One layer, named as the file; the file appears when it is whole."""
    rows, name = layer.rows, Path(path).stem
    kinds = {f.name: WRITE_TYPES.get(f.dataType.simpleString()) for f in rows.schema}
    if bad := [n for n, k in kinds.items() if k is None]:
        raise InvalidInputSchemaError(f"columns of a type that GeoPackage lacks: {', '.join(bad)}")
    organization, _, code = (layer.crs or "NONE:0").partition(":")
    srs, names = int(code), list(kinds)
    pk = next(n for n in ("fid", "ogc_fid", "_row") if n not in {x.lower() for x in names})
    part = Path(f"{path}.part")
    part.unlink(missing_ok=True)
    with closing(sqlite3.connect(part)) as db:
        db.executescript(
            f"pragma application_id = {APPLICATION_ID}; pragma user_version = {USER_VERSION};"
            "create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, "
                "organization_coordsys_id integer not null, definition text not null, description text);"
            "create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', "
                "last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x double, min_y double, max_x double, max_y double, srs_id integer "
                "references gpkg_spatial_ref_sys(srs_id));"
            "create table gpkg_geometry_columns (table_name text not null unique, column_name text not null, geometry_type_name text not null, srs_id "
                "integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));"
            "insert into gpkg_spatial_ref_sys values ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', null), ('Undefined geographic', 0, 'NONE', "
                "0, 'undefined', null), ('WGS 84', 4326, 'EPSG', 4326, 'undefined', null);"
        )
        db.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", (layer.crs or "", srs, organization, srs))
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (name, name, srs))
        db.execute("insert into gpkg_geometry_columns values (?, 'geometry', 'GEOMETRY', ?, 0, 0)", (name, srs))
        db.execute(f"create table {_quoted(name)} ({_quoted(pk)} integer primary key autoincrement, {', '.join(f'{_quoted(n)} ' + ('GEOMETRY' if n == 'geometry' else k) for n, k in kinds.items())})")
        insert = f"insert into {_quoted(name)} ({', '.join(map(_quoted, names))}) values ({', '.join('?' * len(names))})"
        db.executemany(insert, (tuple(to_blob(v, srs) if n == "geometry" else bytes(v) if isinstance(v, bytearray) else v for n,
            v in zip(names, r, strict=True)) for r in rows.toLocalIterator()))
        db.commit()
    os.replace(part, path)


def read_vector(spark: SparkSession, path: str) -> Layer:
    """A layer by its suffix: .gpkg, .fgb, .shp, else Parquet."""
    path = str(path)
    if path.endswith(".gpkg"):
        return read_gpkg(spark, path)
    if path.endswith((".fgb", ".shp")):
        return Layer(*(flatgeobuf.read_fgb if path.endswith(".fgb") else shapefile.read_shp)(spark, path))
    rows = spark.read.parquet(path)
    if "geometry" not in rows.columns:
        raise InvalidInputSchemaError(f"{path}: no column geometry")
    return Layer(rows, rows.schema["geometry"].metadata.get("crs"))


def write_vector(layer: Layer, path: str, *, output_format: str) -> None:
    kind = output_format.lower()
    if kind not in FORMATS:
        raise UnsupportedOutputFormatError(f"unsupported format {output_format!r}; known: {', '.join(FORMATS)}")
    if kind == "parquet":
        rows = layer.rows.withColumn("geometry", F.col("geometry").alias("geometry", metadata={"crs": layer.crs} if layer.crs else {}))
        return rows.write.mode("overwrite").parquet(str(path))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if kind == "gpkg":
        return write_gpkg(layer, str(path))
    return (flatgeobuf.write_fgb if kind == "fgb" else shapefile.write_shp)(layer.rows, layer.crs, str(path))
