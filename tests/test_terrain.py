import math
import random
import struct
import time

import numpy as np
import pytest

import rivergraph
from rivergraph import cli
from rivergraph.errors import InvalidInputSchemaError, TerrainProductsError
from rivergraph.functions import crs, geom
from rivergraph.functions.numbering import numbered
from rivergraph.operators import cells, coarsen, terrain
from rivergraph.operators.routing import flow_directions, route
from rivergraph.sources import geotiff
from rivergraph.sources.vector import Layer, write_vector

from . import plain


def grid(spark, z, drain, labels=None):
    rows = [(r, c, labels[r][c] if labels else 0, float(v), (r, c) in drain) for r, line in enumerate(z) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, label int, z double, is_drain boolean")


def table(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out.tolist()


def codes(z, drain, w=10.0, h=10.0):
    at = [(r, c) for r, line in enumerate(z) for c, v in enumerate(line) if math.isfinite(v)]
    code, rank, lost = route([a[0] for a in at], [a[1] for a in at], [z[r][c] for r, c in at], [a in drain for a in at], w, h)
    return dict(zip(at, code.tolist(), strict=True)), dict(zip(at, rank.tolist(), strict=True)), lost


def end_of(code, at):
    while code[at]:
        dr, dc = cells.OFFSETS[code[at] - 1]
        at = (at[0] + dr, at[1] + dc)
    return at


def test_agree(spark):
    out = cells.agree(grid(spark, [[100] * 7], {(0, 3)}), sharp=10, smooth=2, buffer=2)
    assert table(out, "z", (1, 7)) == [[100, 100, 98, 86, 98, 100, 100]]
    out = cells.agree(grid(spark, [[10] * 3], {(0, 1)}), sharp=4, smooth=9, buffer=0)
    assert table(out, "z", (1, 3)) == [[10, 6, 10]]
    with pytest.raises(TerrainProductsError, match="agree_buffer"):
        cells.agree(grid(spark, [[1]], set()), buffer=-1)


def test_slope_line_and_products(spark):
    g = grid(spark, [[3, 2, 1, 0]], {(0, 3)})
    d = flow_directions(g, 10.0, 10.0)
    assert table(d, "code", (1, 4)) == [[3, 3, 3, 0]] and table(d, "rank", (1, 4)) == [[3, 2, 1, 0]]


def test_metric_steepness():
    assert codes([[10, 9, 0], [8, 7, 6]], {(0, 2)})[0][0, 0] == 4


def test_flat_to_lowest_outlet():
    code, _, lost = codes([[5, 5, 5, 4], [5, 5, 5, 2]], {(1, 3)})
    assert not lost and all(end_of(code, a) == (1, 3) for a in ((0, 0), (0, 1), (1, 0), (1, 1)))


def test_rectangular_pixels(spark):
    g = grid(spark, [[3, 2], [4, 1]], {(1, 1)})
    d = flow_directions(g, 3.0, 4.0)
    way = cells.routes(d, 3.0, 4.0)
    assert table(cells.ltnd(way), "ltnd", (2, 2)) == [[5, 4], [3, 0]]
    assert table(cells.hand(g, way), "hand", (2, 2)) == [[2, 1], [3, 0]]


def test_disconnected_and_cycle(spark):
    with pytest.raises(TerrainProductsError, match="cannot connect"):
        flow_directions(grid(spark, [[1, math.nan, 1]], {(0, 0)}), 10.0, 10.0)
    loop = spark.createDataFrame([(0, 0, 3), (0, 1, 7)], "row int, col int, code int")
    with pytest.raises(TerrainProductsError, match="cycle"):
        cells.routes(loop).collect()


def test_random_grids_end_on_drainage():
    rng = np.random.default_rng(3)
    for _ in range(60):
        z = rng.integers(0, 5, (7, 8)).tolist()
        drain = {(int(rng.integers(7)), int(rng.integers(8))) for _ in range(3)}
        code, rank, lost = codes(z, drain)
        assert not lost and all(end_of(code, a) in drain for a in code) and all((rank[a] == 0) == (a in drain) for a in code)


@pytest.mark.parametrize("w, h, top", [(10.0, 10.0, 4), (3.0, 4.0, 6), (10.0, 10.0, 60)])
def test_random_grids_against_a_plain_model(w, h, top):
    """Codes are equal cell by cell, ties between crossings included; so is what cannot be routed."""
    rng = np.random.default_rng(int(w) + top)
    for _ in range(150):
        z = {(r, c): float(rng.integers(top)) for r in range(6) for c in range(7) if rng.random() > 0.08}
        at = sorted(z)
        drain = {at[int(k)] for k in rng.integers(len(at), size=2)}
        code, _, lost = route([a[0] for a in at], [a[1] for a in at], [z[a] for a in at], [a in drain for a in at], w, h)
        want = plain.routed(z, drain, w, h)
        assert bool(lost) == (want is None)
        if want:
            assert dict(zip(at, code.tolist(), strict=True)) == want


def test_labels_route_apart(spark):
    rng = np.random.default_rng(9)
    z = rng.integers(0, 5, (6, 9)).tolist()
    labels = [[c // 3 for c in range(9)] for _ in range(6)]
    drain = {(0, 1), (5, 4), (2, 7)}
    got = {(r["row"], r["col"]): r["code"] for r in flow_directions(grid(spark, z, drain, labels), 10.0, 10.0).collect()}
    want = {}
    for k in range(3):
        part = {(r, c): float(z[r][c]) for r in range(6) for c in range(3 * k, 3 * k + 3)}
        want |= plain.routed(part, drain & set(part), 10.0, 10.0)
    assert got == want


def test_basin_edges_against_a_plain_model(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        z = rng.integers(0, 4, (7, 8)).tolist()
        held = {(r, c): float(v) for r, line in enumerate(z) for c, v in enumerate(line)}
        code = {a: k or 0 for a, k in plain.natural(held, set(), 10.0, 10.0).items()}
        directed = spark.createDataFrame([(*a, 0, held[a], k) for a, k in code.items()], "row int, col int, label int, z double, code int")
        got = {(r["source"], r["target"]): (r["cut_max"], r["cut_sum"], r["length"], (r["orow"], r["ocol"]),
            (r["drow"], r["dcol"])) for r in cells.basin_edges(directed, 10.0, 10.0).collect()}
        want, _ = plain.edges(held, code, 10.0, 10.0)
        assert got.keys() == want.keys() and all(got[k][:3] == pytest.approx(want[k][:3]) and got[k][3:] == want[k][3:] for k in want)


def test_neighbours_over_the_borders_of_tiles(spark):
    """As cell by cell, and rows are not multiplied by a join with neighbours."""
    rng = np.random.default_rng(11)
    z = {(r - 3, c): float(rng.integers(9)) for r in range(70) for c in range(125) if rng.random() > 0.1}
    label = {a: int(a[1] > 65) for a in z}
    want = {}
    for k in (0, 1):
        want |= plain.natural({a: h for a, h in z.items() if label[a] == k}, set(), 3.0, 4.0)
    found = cells.natural_d8(spark.createDataFrame([(*a, label[a], h, False) for a, h in z.items()], "row int, col int, label int, z double, is_drain boolean"), 3.0, 4.0)
    assert {(r["row"], r["col"]): r["code"] for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().toString()


def counted(directed, tally):
    def run(batches):
        for pdf in batches:
            tally.add(len(pdf))
            yield pdf

    return directed.mapInPandas(run, directed.schema)


@pytest.mark.parametrize("ask", [cells.basin_edges, cells.corridor_costs, cells.routes])
def test_directions_are_worked_out_once(spark, ask):
    rows = [(r, c, 0, float((r * 7 + c * 3) % 5), 3 if c < 5 else 0) for r in range(4) for c in range(6)]
    tally = spark.sparkContext.accumulator(0)
    directed = counted(spark.createDataFrame(rows, "row int, col int, label int, z double, code int"), tally)
    ask(directed, 1.0, 1.0).collect()
    assert tally.value == len(rows)


def test_merging_against_a_plain_model():
    r = random.Random(2)
    for _ in range(400):
        n = r.randrange(1, 14)
        ids = r.sample(range(1, 40), n)
        downs = {i: r.choice([None, *ids[:k]]) for k, i in enumerate(ids)}
        lengths = {i: float(r.randrange(1, 8)) for i in ids}
        assert coarsen.merge_short(ids, [downs[i] for i in ids], [lengths[i] for i in ids], 6.0) == plain.merged(ids, downs, lengths, 6.0)


def test_merging_many_domains_at_once(spark):
    """Domains over the ends of batches, of one segment, and without a sub: as each on its own, with few calls of Python."""
    r = random.Random(3)
    rows, want = [], {}
    for k in range(300):
        ids = [10 * k + j for j in range(r.randrange(1, 9))]
        downs = {i: r.choice([None, *ids[:n]]) for n, i in enumerate(ids)}
        lengths = {i: r.choice([0.1, 0.2, 0.3, 2.0]) for i in ids}
        want |= plain.merged(ids, downs, lengths, 0.6)
        rows += [(i, downs[i], k % 2 or None, k, lengths[i]) for i in ids]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = coarsen.merged_groups(spark.createDataFrame(rows, "id long, p long, sub int, water_course long, unit_length double"), 0.6)
        assert {x["id"]: x["mini_id"] for x in found.collect()} == want
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_merging_a_long_domain_in_time():
    """Lengths are summed from what was summed before; members are not copied at each merging."""
    n, began = 60_000, time.perf_counter()
    got = coarsen.merge_short(list(range(n)), [None, *range(n - 1)], [0.1] * n, math.inf)
    assert len(set(got.values())) == 1 and time.perf_counter() - began < 20


def square(x, y, w=1, h=1):
    return geom.polygon([[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])


def test_unions_of_random_rectangles():
    """Overlaps, T-junctions, rectangles inside others: area and outline as on a grid."""
    r = random.Random(1)
    for _ in range(150):
        held, parts = np.zeros((22, 22), int), []
        for _ in range(r.randrange(2, 9)):
            x, y, w, h = r.randrange(15), r.randrange(15), r.randrange(1, 6), r.randrange(1, 6)
            held[x + 1 : x + w + 1, y + 1 : y + h + 1] = 1
            parts.append(square(x, y, w, h))
        got = geom.union_all(parts)
        assert geom._area(got) == pytest.approx(held.sum()) and geom._length(got) == pytest.approx(np.abs(np.diff(held, axis=0)).sum() + np.abs(np.diff(held, axis=1)).sum())
    rhomb = geom.polygon([[(0, 0), (2, 1), (0, 2), (-2, 1), (0, 0)]])
    assert geom._area(geom.union_all([rhomb, square(-1, 0.5, 2, 1)])) == pytest.approx(4.0)
    assert geom._area(geom.union_all([square(0, 0, 2, 2), square(1, 1, 2, 2)])) == pytest.approx(7)


def test_heights_are_dropped():
    points = np.array([[0, 0, 9], [3, 4, 1.0]])
    for code in (1002, 0x80000002):
        assert geom._length(struct.pack("<BII", 1, code, 2) + points.tobytes()) == 5
    with_srid = struct.pack("<BIII", 1, 0x20000002, 4326, 2) + points[:, :2].tobytes()
    four = struct.pack("<BII", 1, 3002, 2) + np.array([[0, 0, 9, 9], [3, 4, 1, 1.0]]).tobytes()
    assert geom._length(with_srid) == geom._length(four) == 5
    with pytest.raises(InvalidInputSchemaError):
        geom.parse(struct.pack("<BII", 1, 7, 0))


def test_systems_of_coordinates():
    """Round trips, and points whose coordinates are known."""
    here = np.array([[-47.9, -15.8], [-45.0, -14.0], [-43.3, -22.9]])
    for name in ("EPSG:3857", "EPSG:31983", "EPSG:32723", "EPSG:4674", "ESRI:102033", "EPSG:29193", "EPSG:31976"):
        assert crs.transform(crs.transform(here, "EPSG:4326", name), name, "EPSG:4326") == pytest.approx(here, abs=1e-7)
    # on the central meridian; a degree off it at the equator
    assert crs.transform(np.array([[-45.0, 0.0]]), "EPSG:4326", "EPSG:32723")[0] == pytest.approx([500_000, 10_000_000], abs=1e-4)
    assert crs.transform(np.array([[9.0, 45.0]]), "EPSG:4326", "EPSG:32632")[0] == pytest.approx([500_000, 4_982_950.400], abs=0.01)
    # a published worked example, on the ellipsoid of 1866
    x, y = crs._transverse((6378206.4, 1 / 294.978698214), -75.0, 0.0)[0](np.radians(-73.5), np.radians(40.5))
    assert (x - 500_000, y) == pytest.approx((127_106.5, 4_484_124.4), abs=0.1)
    assert crs.transform(np.array([[180.0, 0.0]]), "EPSG:4326", "EPSG:3857")[0] == pytest.approx([20_037_508.342789, 0], abs=1e-5)


@pytest.mark.parametrize("dtype, nodata", [("float32", math.nan), ("int8", -1), ("float64", -9999.0)])
def test_grids_round_trip(spark, tmp_path, dtype, nodata):
    rng = np.random.default_rng(4)
    want = {(int(r), int(c)): float(rng.integers(0, 100)) for r, c in zip(rng.integers(0, 300, 900), rng.integers(0, 520, 900), strict=True)}
    rows = spark.createDataFrame([(*k, v) for k, v in want.items()], "row int, col int, v double")
    path = str(tmp_path / "g.tif")
    geotiff.write_grid(rows, "v", path, width=520, height=300, transform=(1000.0, 30.0, 0.0, 9000.0, 0.0, -30.0), crs="EPSG:31983", dtype=dtype, nodata=nodata, notes={"a": 1})
    g = geotiff.open_grid(path)
    assert (g.width, g.height, g.crs, g.projected, g.metres) == (520, 300, "EPSG:31983", True, True) and g.bounds == (1000.0, 0.0, 16600.0, 9000.0)
    got = lambda w=None: {(r["row"], r["col"]): r["z"] for r in geotiff.read_cells(spark, g, w).collect()}
    assert got() == want
    w = geotiff.window_of(g, (1000 + 30 * 250.5, 30 * 20.5, 1000 + 30 * 270, 30 * 299.9))
    assert w == geotiff.Window(0, 250, 280, 20) and geotiff.window_transform(g, w)[::3] == (1000 + 30 * 250, 9000.0)
    assert got(w) == {(r, c - 250): v for (r, c), v in want.items() if r < 280 and 250 <= c < 270}


def test_grids_of_other_writers(spark, tmp_path):
    """Strips, big-endian, no compression, and a horizontal predictor; files that are none."""
    data = np.arange(12, dtype=">i2").reshape(3, 4)
    for predictor in (1, 2):
        body = (data if predictor == 1 else np.diff(data, axis=1, prepend=np.zeros((3, 1), ">i2")).astype(">i2")).tobytes()
        tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, len(body)), (317, 3, predictor), (339, 3, 2)]
        geo = struct.pack(">3d", 2.0, 5.0, 0.0) + struct.pack(">6d", 0, 0, 0, 10.0, 100.0, 0)
        at = 8 + len(body)
        head = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
        head += struct.pack(">HHII", 33550, 12, 3, at) + struct.pack(">HHII", 33922, 12, 6, at + 24)
        path = tmp_path / f"b{predictor}.tif"
        path.write_bytes(b"MM" + struct.pack(">HI", 42, at + len(geo)) + body + geo + struct.pack(">H", len(tags) + 2) + head + bytes(4))
        g = geotiff.open_grid(str(path))
        assert g.transform == (10.0, 2.0, 0.0, 100.0, 0.0, -5.0) and g.crs is None
        assert {(r["row"], r["col"]): r["z"] for r in geotiff.read_cells(spark, g).collect()} == {(r, c): float(data[r, c]) for r in range(3) for c in range(4)}
        with pytest.raises(TerrainProductsError, match="no CRS"):
            terrain.check_grid(g)
    (tmp_path / "no.tif").write_bytes(b"no image at all")
    for bad in ("no.tif", "none.tif"):
        with pytest.raises(InvalidInputSchemaError):
            geotiff.open_grid(str(tmp_path / bad))


def ground(spark, folder, z, system="EPSG:31983"):
    cells_ = spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(z) for c, v in enumerate(line) if v is not None], "row int, col int, z double")
    geotiff.write_grid(cells_, "z", f"{folder}/dem.tif", width=len(z[0]), height=len(z),
        transform=(0.0, 10.0, 0.0, 10.0 * len(z), 0.0, -10.0), crs=system, dtype="float32", nodata=-9999.0)
    return f"{folder}/dem.tif"


def layers(spark, boxes, lines, system="EPSG:31983"):
    cat = spark.createDataFrame([(i, square(*b)) for i, b in boxes.items()], "id long, geometry binary")
    seg = spark.createDataFrame([(i, geom.line(p)) for i, p in lines.items()], "id long, geometry binary")
    return Layer(cat, system), Layer(seg, system)


def values(spark, path):
    return {(r["row"], r["col"]): r["z"] for r in geotiff.read_cells(spark, geotiff.open_grid(str(path))).collect()}


def test_terrain_products(spark, tmp_path, capsys):
    z = [[9, 8, 7, 1, 5, 5], [9, 8, 7, 2, 6, 6], [9, 8, 7, 3, 7, 7], [50, 50, 50, 50, 50, 50]]
    dem = ground(spark, tmp_path, z)
    cat, seg = layers(spark, {10: (0, 10, 40, 30), 9: (40, 10, 20, 30)}, {10: [(35, 38), (35, 12)], 9: [(45, 38), (45, 12)]})
    report = terrain.create_terrain_products(dem, cat, seg, str(tmp_path / "out"), write_flow_direction=True)
    assert (report.owned_cells, report.drainage_cells, report.unreachable_components, report.negative_hand_cells) == (18, 6, 0, 0)
    hand, ltnd, code = (values(spark, p) for p in report.paths)
    assert hand == {(r, c): float(z[r][c] - z[r][3 if c < 4 else 4]) for r in range(3) for c in range(6)}
    assert ltnd == {(r, c): 10.0 * (3 - c if c < 4 else c - 4) for r in range(3) for c in range(6)}
    assert code == {(r, c): float(0 if c in (3, 4) else 3 if c < 3 else 7) for r in range(3) for c in range(6)}
    assert geotiff.open_grid(str(report.paths.hand)).bounds == (0, 10, 60, 40)
    for layer, name in ((cat, "c"), (seg, "s")):
        write_vector(layer, f"{tmp_path}/{name}.gpkg", output_format="gpkg")
    run = ["terrain-products", "--dem", dem, "--roi-catchments", f"{tmp_path}/c.gpkg", "--roi-segments", f"{tmp_path}/s.gpkg", "--output-dir", f"{tmp_path}/cli"]
    assert cli.main(run, spark) == 0 and values(spark, tmp_path / "cli/hand.tif") == hand and not (tmp_path / "cli/flow_direction.tif").exists()
    assert "Cells owned: 18; drainage: 6;" in capsys.readouterr().out
    assert cli.main([*run, "--agree-sharp", "-1"], spark) == 1


def test_drainage_touches_every_cell(spark, tmp_path):
    """A diagonal through corners marks the cells beside it too; HAND is signed and follows the grid as read."""
    cat, seg = layers(spark, {1: (0, 0, 30, 30)}, {1: [(0, 0), (30, 30)]})
    areas = terrain.labelled(cat.rows)
    held = terrain.rasterised(areas, seg.rows, (0.0, 10.0, 0.0, 30.0, 0.0, -10.0), geotiff.Window(0, 0, 3, 3)).collect()
    assert sum(r["is_drain"] for r in held) >= 5 and len(held) == 9
    dem = ground(spark, tmp_path, [[0, 5, 10]])
    cat, seg = layers(spark, {1: (0, 0, 30, 10)}, {1: [(25, 2), (25, 8)]})
    report = terrain.create_terrain_products(dem, cat, seg, str(tmp_path / "o"))
    assert values(spark, report.paths.hand) == {(0, 0): -10.0, (0, 1): -5.0, (0, 2): 0.0}
    assert (report.negative_hand_cells, report.negative_hand_min, report.negative_hand_max) == (2, -10.0, -5.0) and report.paths.flow_direction is None


def test_terrain_validation(spark, tmp_path):
    dem = ground(spark, tmp_path, [[3, 2, 1]] * 3)
    cat, seg = layers(spark, {1: (0, 0, 30, 30)}, {1: [(25, 2), (25, 28)]})
    run = lambda c, s, d=dem: terrain.create_terrain_products(d, c, s, str(tmp_path / "o"))
    twice = layers(spark, {1: (0, 0, 20, 30), 2: (15, 0, 15, 30)}, {1: [(5, 2), (5, 28)], 2: [(25, 2), (25, 28)]})
    beyond = layers(spark, {1: (0, 0, 40, 30)}, {1: [(25, 2), (25, 28)]})
    for c, s, says in (
        (Layer(cat.rows, None), seg, "no CRS"), (cat, Layer(seg.rows.drop("id"), seg.crs), "no 'id'"),
            (cat, Layer(seg.rows.withColumn("id", seg.rows["id"] + 1), seg.crs), "do not match"),
        (Layer(seg.rows, seg.crs), seg, "does not fit"), (Layer(cat.rows.union(cat.rows), cat.crs), seg, "unique"),
            (Layer(cat.rows.limit(0), cat.crs), seg, "empty geometry"), (*twice, "overlaps"), (*beyond, "does not cover"),
    ):
        with pytest.raises(TerrainProductsError, match=says):
            run(c, s)
    turned = geotiff.open_grid(dem)._replace(transform=(0.0, 10.0, 1.0, 30.0, 0.0, -10.0))
    for bad, says in ((turned, "turned"), (geotiff.open_grid(dem)._replace(projected=False), "projected"), (geotiff.open_grid(dem)._replace(metres=False), "metres")):
        with pytest.raises(TerrainProductsError, match=says):
            terrain.check_grid(bad)
    with pytest.raises(TerrainProductsError, match="drainage lies"):
        run(*layers(spark, {1: (0, 0, 30, 30)}, {1: [(25, 2), (25, 28)]}), ground(spark, tmp_path, [[3, 2, None]] * 3))


def test_numbers_run_over_parts(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as k", "id")
    got = numbered(rows, ["k"], "n").collect()
    assert {(r["k"], r["n"]) for r in got} == {(k, k) for k in range(5000)} and numbered(rows.limit(0), ["k"], "n").count() == 0


def test_cells_need_their_columns(spark):
    g = grid(spark, [[1, 2]], {(0, 0)})
    for bad in (g.drop("label"), g.withColumn("label", g["z"]), g.withColumn("is_drain", g["row"])):
        with pytest.raises(TerrainProductsError):
            cells.agree(bad)
        with pytest.raises(TerrainProductsError):
            flow_directions(bad, 1.0, 1.0)


def test_exports():
    assert rivergraph.compute_hand is cells.hand and rivergraph.compute_ltnd is cells.ltnd and rivergraph.compute_flow_directions is flow_directions


def test_overlaps(spark):
    ring = geom.polygon([[(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)], [(1, 1), (1, 4), (4, 4), (4, 1), (1, 1)]])
    rows = spark.createDataFrame([(1, ring), (2, square(2, 2)), (3, square(4.5, 4.5)), (4, square(5.5, 4.5))], "id long, geometry binary")
    assert [(r["a"], r["b"], r["area"]) for r in geom.overlapping(rows).collect()] == [(1, 3, pytest.approx(0.25))]


def test_overlaps_are_found_once_and_not_held_whole(spark):
    """Pairs that share many buckets come once; no task holds all polygons, however few bytes they are thought to have."""
    r = random.Random(8)
    held = {k: (r.randrange(60), r.randrange(60), r.randrange(1, 30), r.randrange(1, 30)) for k in range(60)}
    found = geom.overlapping(spark.createDataFrame([(k, square(*v)) for k, v in held.items()], "id int, geometry binary"), cell=4.0)
    side = lambda p, q, k: max(0, min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]))
    want = {(a, b): side(p, q, 0) * side(p, q, 1) for a, p in held.items() for b, q in held.items() if a < b and side(p, q, 0) * side(p, q, 1)}
    rows = found.collect()
    assert len(rows) == len(want) and {(x["a"], x["b"]): pytest.approx(x["area"]) for x in rows} == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lines", [True, False])
def test_rasterising_is_dealt_out(spark, lines):
    """Many geometries at a time, in flat rows, and by all tasks although one file holds them."""
    shape = geom.line([(0.5, 0.5), (4.5, 2.5)]) if lines else square(0, 0, 4, 3)
    rows = spark.createDataFrame([(k, shape) for k in range(2000)], "id int, geometry binary").coalesce(1)
    found = geom.rasterise(rows, "id", (0.0, 0.0, 1.0, 1.0), lines=lines)
    cut = geom.line_cells if lines else geom.polygon_cells
    assert sorted(map(tuple, found.where("id = 7").select("row", "col").collect())) == sorted(cut(shape, 0, 0, 1, 1))
    assert found.count() == 2000 * len(cut(shape, 0, 0, 1, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate" not in plan


def test_cells_of_random_shapes():
    """Polygons against centres one by one, lines against points along them."""
    rng = np.random.default_rng(6)
    centres = [(r, c) for r in range(-6, 7) for c in range(-6, 7)]
    x, y = np.array([c + 0.5 for _, c in centres]), np.array([r + 0.5 for r, _ in centres])
    shapes = []
    for _ in range(60):
        around = (np.arange(7) + rng.uniform(0, 1, 7)) * 2 * math.pi / 7
        p = np.column_stack([np.cos(around), np.sin(around)]) * rng.uniform(1, 6, 7)[:, None]
        shapes.append(np.vstack([p, p[:1]]))
    for p in shapes:
        inside = geom._covers([p if geom.ring_area(p) > 0 else p[::-1]], x, y)
        assert sorted(geom.polygon_cells(geom.polygon([p]), 0, 0, 1, 1)) == [a for a, i in zip(centres, inside, strict=True) if i]
        t = np.linspace(0, 1, 5000)[:, None]
        met = {(math.floor(b), math.floor(a)) for a, b in np.vstack([u + t * (v - u) for u, v in zip(p, p[1:], strict=False)])}
        assert met <= set(geom.line_cells(geom.line(p), 0, 0, 1, 1))


def test_geometry():
    joined = geom.union_all([square(0, 0), square(1, 0), square(0, 1)])
    assert geom._area(joined) == 3 and geom._length(joined) == 8
    ring = geom.union_all([square(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)])
    assert geom._area(ring) == 8 and len(geom.parse(ring)[1][0]) == 2
    assert geom.clip_area(square(0, 0), geom.polygon([[(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2), (0.5, 0.5)]])) == pytest.approx(0.25)
    assert len(geom.polygon_cells(geom.polygon([[(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]]), 0, 0, 1, 1)) == 12
