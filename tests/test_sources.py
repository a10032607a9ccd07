import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivergraph import cli
from rivergraph.errors import InvalidInputSchemaError, UnsupportedOutputFormatError
from rivergraph.functions import geom
from rivergraph.operators.roi import LAYER
from rivergraph.sources import flatgeobuf, shapefile, vector
from rivergraph.sources.vector import Layer, read_vector, write_vector


def network(spark):
    """Six nodes; 2 and 4 flow into 1. Lengths and squares in metres."""
    downs = {1: None, 2: 1, 3: 2, 4: 1, 5: 4, 6: None}
    order = {1: 3, 2: 2, 3: 1, 4: 2, 5: 1, 6: 1}
    seg = [(i, d, order[i], geom.line([(i * 1000.0, 0.0), (i * 1000.0, 1000.0 * i)]), "extra") for i, d in downs.items()]
    cat = [(i, geom.polygon([[(i * 5000.0, 0.0), (i * 5000.0 + 1000 * i, 0.0), (i * 5000.0 + 1000 * i, 1000.0), (i * 5000.0, 1000.0), (i * 5000.0, 0.0)]])) for i in downs]
    return spark.createDataFrame(cat, "id long, geometry binary"), spark.createDataFrame(seg, "id long, id_down long, strahler_order int, geometry binary, note string")


def plain(rows):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.collect())


@pytest.mark.parametrize("kind", ["gpkg", "parquet", "fgb", "shp"])
def test_round_trip(spark, tmp_path, kind, monkeypatch):
    for module in (vector, shapefile):
        monkeypatch.setattr(module, "ROWS_A_TASK", 4)  # 6 rows in two tasks
    rows = spark.createDataFrame([(i, None if i == 2 else f"n'{i}", i / 8, i % 2 == 0,
        None if i == 3 else geom.line([(0.0, 0.0), (i, 1.0)])) for i in range(6)], "id long, name string, x double, even boolean, geometry binary")
    path = str(tmp_path / f"layer.{kind}")
    write_vector(Layer(rows, "EPSG:3857"), path, output_format=kind.upper())
    back = read_vector(spark, path)
    assert back.crs == "EPSG:3857" and back.rows.columns == rows.columns
    key = lambda rs: {r[0]: r for r in map(lambda r: tuple(bytes(v) if isinstance(v, bytearray) else v for v in r), rs.collect())}
    assert key(back.rows) == key(rows)
    empty = str(tmp_path / f"empty.{kind}")
    write_vector(Layer(rows.limit(0), None), empty, output_format=kind)
    assert read_vector(spark, empty).crs is None and read_vector(spark, empty).rows.count() == 0 and read_vector(spark, empty).rows.columns == rows.columns


def test_geopackage_of_another_writer(spark, tmp_path):
    """An envelope before the WKB, a geometry column of another name, a key that is not called fid."""
    wkb, path = geom.line([(0.0, 0.0), (2.0, 1.0)]), str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("create table gpkg_spatial_ref_sys (srs_name, srs_id integer primary key, organization, organization_coordsys_id integer, definition, description); insert into gpkg_spatial_ref_sys values ('x', 7, 'epsg', 4326, '', null); create table gpkg_geometry_columns (table_name, column_name, geometry_type_name, srs_id, z, m); insert into gpkg_geometry_columns values ('roads', 'geom', 'LINESTRING', 7, 0, 0); create table roads (pk integer primary key, geom LINESTRING, id MEDIUMINT, t TEXT(20))")
        db.execute("insert into roads values (5, ?, 3, 'a')", (b"GP" + struct.pack("<BBi4d", 0, 3, 7, 0, 2, 0, 1) + wkb,))
    got = read_vector(spark, path)
    assert got.crs == "EPSG:4326" and got.rows.columns == ["geometry", "id", "t"] and plain(got.rows) == [(wkb, 3, "a")]
    with pytest.raises(InvalidInputSchemaError):
        vector.read_gpkg(spark, path, "rails")
    (tmp_path / "b.gpkg").write_text("no database, but a text that is long enough to be looked at")
    for bad in ("b.gpkg", "none.gpkg"):
        with pytest.raises(InvalidInputSchemaError):
            read_vector(spark, str(tmp_path / bad))


@pytest.mark.parametrize("kind", ["fgb", "shp"])
def test_shapes_of_all_kinds(spark, tmp_path, kind):
    box = lambda x, w: [(x, 0.0), (x, w), (x + w, w), (x + w, 0.0), (x, 0.0)]
    of = {
        "polygon": (geom.POLYGON, [[np.array(box(0, 9)), np.array(box(2, 3))[::-1]]]),
            "polygons": (geom.MULTIPOLYGON, [[np.array(box(0, 9)), np.array(box(2, 3))[::-1]], [np.array(box(20, 4))]]),
        "lines": (geom.MULTILINE, [np.array([(0.0, 0.0), (1.0, 1.0)]), np.array([(5.0, 0.0), (6.0, 1.0), (7.0, 7.0)])]),
            "point": (geom.POINT, [np.array([3.0, 4.0])]), "points": (geom.MULTIPOINT, [np.array([3.0, 4.0]), np.array([5.0, 6.0])]),
    }
    for name, shape in of.items():
        path = str(tmp_path / f"{name}.{kind}")
        write_vector(Layer(spark.createDataFrame([(1, geom.build(*shape))], "id int, geometry binary"), "EPSG:31983"), path, output_format=kind)
        back = read_vector(spark, path)
        row = back.rows.first()
        assert back.crs == "EPSG:31983" and row["id"] == 1
        got, want = geom.parse(row["geometry"]), shape
        assert got[0] == want[0] and len(got[1]) == len(want[1]) and geom._area(row["geometry"]) == geom._area(geom.build(*want)) and geom._length(row["geometry"]) == geom._length(geom.build(*want)) and geom._bounds(row["geometry"]) == geom._bounds(geom.build(*want))


def test_long_names_and_bad_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 2**53 + 1, 0.1, geom.line([(0, 0), (1, 1)]))], "strahler_order int, strahler_other int, big long, x double, geometry binary")
    write_vector(Layer(rows, None), str(tmp_path / "a.shp"), output_format="shp")
    back = read_vector(spark, str(tmp_path / "a.shp")).rows
    assert back.columns == ["strahler_o", "strahler_1", "big", "x", "geometry"] and tuple(back.first())[:4] == (1, 2, 2**53 + 1, 0.1)
    for bad in ("b.fgb", "b.shp"):
        (tmp_path / bad).write_text("nothing of the kind, though long enough")
        with pytest.raises(InvalidInputSchemaError):
            read_vector(spark, str(tmp_path / bad))
    with pytest.raises(InvalidInputSchemaError):
        write_vector(Layer(rows.union(rows.withColumn("geometry", F.lit(geom.build(geom.POINT, [np.zeros(2)])))), None), str(tmp_path / "c.shp"), output_format="shp")


def test_a_table_of_flatbuffers():
    nested = {0: "name", 1: ("B", 7), 2: [{0: ("i", k)} for k in range(5)], 3: np.arange(4.0), 5: {1: ("Q", 2**40)}, 6: None}
    t = flatgeobuf.Table(flatgeobuf.packed(nested))
    assert t.text(0) == "name" and t.scalar(1, "B", 0) == 7 and [x.scalar(0, "i", -1) for x in t.tables(2)] == list(range(5)) and t.vector(3, "f8").tolist() == [0, 1, 2, 3]
    assert t.table(5).scalar(1, "Q", 0) == 2**40 and t.vector(6, "u1") is None and t.scalar(99, "B", 5) == 5


def test_formats(spark, tmp_path):
    cat, _ = network(spark)
    with pytest.raises(UnsupportedOutputFormatError):
        write_vector(Layer(cat, None), str(tmp_path / "x"), output_format="xyz")


def test_commands(spark, tmp_path, capsys):
    cat, seg = network(spark)
    write_vector(Layer(cat, "EPSG:3857"), str(tmp_path / "c.gpkg"), output_format="gpkg")
    write_vector(Layer(seg, "EPSG:3857"), str(tmp_path / "s.gpkg"), output_format="gpkg")
    base = ["define-roi", "--catchments", str(tmp_path / "c.gpkg"), "--segments", str(tmp_path / "s.gpkg"), "--destine-crs", "EPSG:3857",
        "--output-dir", str(tmp_path / "roi"), "--output-format", "gpkg"]
    assert cli.main([*base, "--outlet-id", "1"], spark) == 0
    roi = {n: read_vector(spark, str(tmp_path / "roi" / f"roi_{n}.gpkg")) for n in ("catchments", "segments")}
    for layer in roi.values():
        assert tuple(layer.rows.columns) == LAYER and layer.crs == "EPSG:3857"
        assert {r["id"]: r["upstream_length"] for r in layer.rows.collect()} == {1: 15.0, 2: 5.0, 3: 3.0, 4: 9.0, 5: 5.0}
    mini = ["aggregate", "--roi-catchments", str(tmp_path / "roi/roi_catchments.gpkg"), "--roi-segments",
        str(tmp_path / "roi/roi_segments.gpkg"), "--output-dir", str(tmp_path / "mini"), "--output-format", "gpkg", "--lmin", "0", "--uparea-min"]
    assert cli.main([*mini, "0"], spark) == 0
    mapping = read_vector(spark, str(tmp_path / "mini" / "bho2mini.gpkg")).rows
    assert mapping.columns == ["id", "mini_id", "sub", "geometry"] and {r["id"] for r in mapping.collect()} == {1, 2, 3, 4, 5}
    assert capsys.readouterr().out.count("Wrote") == 5
    assert cli.main([*base, "--outlet-id", "99"], spark) == 1 and "99" in capsys.readouterr().err
    assert cli.main([*base, "--outlet-id", "x"], spark) == 1 and cli.main([*base, "--outlet-id", "1", "--output-format", "xyz"], spark) == 1
    with pytest.raises(SystemExit):
        cli.main([*base, "--outlet-id", "1", "--threads", "4"], spark)
