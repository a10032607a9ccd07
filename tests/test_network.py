import random

import pytest

from rivergraph.errors import DuplicateSegmentIdError, InvalidInputSchemaError, MissingColumnsError, MissingCrsError, OutletNotFoundError, TopologyCycleError
from rivergraph.functions import geom
from rivergraph.operators import coarsen, doubling, roi, topology
from rivergraph.plans.queries import QUERIES


def net(spark, ids, downs, kind="long"):
    return spark.createDataFrame(list(zip(ids, downs, strict=True)), f"id {kind}, id_down {kind}")


def upstream(df, outlets, **k):
    return {r[0] for r in topology.find_upstream(df, outlets, **k).collect()}


def test_closure(spark):
    assert upstream(net(spark, [1, 2, 3, 4, 5], [None, 1, 2, 2, 4]), [2]) == {2, 3, 4, 5}
    assert upstream(net(spark, [1, 2, 3, 4, 5, 6], [None, 1, 2, 1, 4, None]), [2, 4]) == {2, 3, 4, 5}


def test_closure_blank_sink_and_case(spark):
    assert upstream(net(spark, ["a", "b", "c"], ["", "a", "b"], "string"), ["a"]) == {"a", "b", "c"}
    df = net(spark, [10, 20, 30, 40], [None, 10, 20, 20]).toDF("LINKNO", "DSLINKNO")
    assert upstream(df, [20], id_col="linkno", id_down_col="dslinkno") == {20, 30, 40}


def test_closure_errors(spark):
    with pytest.raises(MissingColumnsError):
        upstream(net(spark, [1], [None]).drop("id_down"), [1])
    with pytest.raises(DuplicateSegmentIdError):
        upstream(net(spark, [1, 1], [None, None]), [1])
    with pytest.raises(OutletNotFoundError, match="99"):
        upstream(net(spark, [1], [None]), [99])
    with pytest.raises(TopologyCycleError):
        upstream(net(spark, [1, 2, 3], [3, 1, 2]), [1])


def test_cycle_elsewhere_is_no_error(spark):
    assert upstream(net(spark, [1, 2, 8, 9], [None, 1, 9, 8]), [1]) == {1, 2}


def layers(spark, ids, downs, strahler, areas=None):
    areas = areas or [1] * len(ids)
    seg = [(i, d, s, bytearray(geom.line([(0, 0), (1000 * i, 0)])), "x") for i, d, s in zip(ids, downs, strahler, strict=True)]
    cat = [(i, bytearray(geom.polygon([[(0, 0), (1000 * a, 0), (1000 * a, 1000), (0, 1000), (0, 0)]])), 1) for i, a in zip(ids, areas, strict=True)]
    return spark.createDataFrame(cat, "id long, geometry binary, other int"), spark.createDataFrame(seg, "id long, id_down long, strahler_order int, geometry binary, other string")


def test_roi(spark):
    cat, seg = layers(spark, [1, 2, 3, 4, 5, 6], [None, 1, 2, 1, 4, None], [3, 2, 1, 2, 1, 1])
    out = roi.define_roi(cat, seg, outlet_ids=[1, 2], destine_crs="EPSG:3857", source_crs="EPSG:3857")
    assert tuple(out.segments.columns) == tuple(out.catchments.columns) == roi.LAYER
    rows = {r["id"]: r for r in out.segments.collect()}
    assert {i: r["sub"] for i, r in rows.items()} == {1: 2, 4: 2, 5: 2, 2: 1, 3: 1}
    assert {i: r["water_course"] for i, r in rows.items()} == {1: 1, 4: 1, 5: 1, 2: 2, 3: 2}
    assert rows[1]["upstream_length"] == pytest.approx(15) and rows[2]["upstream_area"] == pytest.approx(2)
    with pytest.raises(MissingCrsError):
        roi.define_roi(cat, seg, outlet_ids=[1], destine_crs="EPSG:3857")


def test_main_stem(spark):
    cat, seg = layers(spark, [1, 2, 3, 4], [None, 1, 1, 2], [1] * 4, [1, 2, 1, 1])
    out = roi.define_roi(cat, seg, outlet_ids=[1], destine_crs="EPSG:3857", source_crs="EPSG:3857")
    assert {r["id"]: r["water_course"] for r in out.segments.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def canonical(spark, downs, lengths, areas, courses, subs=None):
    n = len(downs)
    subs = subs or [1] * n
    square = lambda i: bytearray(geom.polygon([[(i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0)]]))
    line = lambda i: bytearray(geom.line([(i, 0), (i + 1, 0)]))
    schema = "id long, id_down long, sub int, strahler_order int, unit_length double, upstream_length double, unit_area double, upstream_area double, water_course long, geometry binary"
    rows = lambda g: [(i + 1, downs[i], subs[i], 1, float(lengths[i]), float(areas[i]), float(i + 1), float(areas[i]), courses[i], g(i + 1)) for i in range(n)]
    return spark.createDataFrame(rows(square), schema), spark.createDataFrame(rows(line), schema)


CASES = [
    # downs, lengths, areas, courses, subs, uparea_min, lmin, mapping
    ((None, 1, 1, 2), (1, 1, 1, 1), (10, 6, 4, 2), (1, 1, 3, 1), None, 0, 0, {2: 2, 3: 3, 4: 4}),
    ((None, 1, 2), (3, 0.5, 2), (10, 8, 6), (1, 1, 1), None, 0, 1, {2: 3, 3: 3}),
    ((None, 1, 2, 1), (3, 0.5, 3, 3), (10, 8, 6, 5), (1, 2, 1, 2), (1, 1, 1, 2), 0, 1, {2: 1, 3: 3, 4: 4}),
    ((None, 1, 2), (5, 1, 4), (10, 2, 8), (1, 1, 1), None, 5, 0, {2: 3}),
    ((None, 1, 2), (5, 0.6, 0.6), (10, 8, 2), (1, 1, 1), None, 5, 1, {2: 1, 3: 1}),
    ((None, 1), (5, 1), (10, 2), (1, 2), None, 5, 0, {2: 1}),
    ((None, 1, 2), (5, 0.4, 0.4), (10, 8, 6), (1, 1, 1), None, 0, 1, {2: 1, 3: 1}),
    ((None, 1), (5, 0.5), (10, 8), (1, 2), None, 0, 1, {2: 1}),
]


@pytest.mark.parametrize("case", CASES)
def test_minibasins(spark, case):
    downs, lengths, areas, courses, subs, uparea, lmin, want = case
    cat, seg = canonical(spark, downs, lengths, areas, courses, subs)
    out = coarsen.aggregate_minibasins(cat, seg, uparea_min=uparea, lmin=lmin)
    got = {r["id"]: r["mini_id"] for r in out.mapping.collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(downs)
    total = sum(r["unit_area"] for r in out.catchments.collect())
    assert total == pytest.approx(sum(range(1, len(downs) + 1)))
    assert tuple(out.segments.columns) == roi.LAYER


def test_minibasin_errors(spark):
    cat, seg = canonical(spark, (None,), (0.5,), (10,), (1,))
    with pytest.raises(InvalidInputSchemaError):
        coarsen.aggregate_minibasins(cat, seg, uparea_min=0, lmin=1)
    with pytest.raises(InvalidInputSchemaError):
        coarsen.aggregate_minibasins(cat, seg.drop("sub"), uparea_min=0, lmin=0)
    with pytest.raises(InvalidInputSchemaError):
        coarsen.aggregate_minibasins(cat, seg.select(*reversed(seg.columns)), uparea_min=0, lmin=0)


def random_forest(n):
    r = random.Random(n)
    return {i: r.randrange(i) if i and r.random() > 0.1 else None for i in range(n)}


def test_folds_leave_tips_out_and_hand_nothing_around(spark, monkeypatch):
    """Folds over a forest as node by node; tips are in no round, and no table goes to the driver to be handed around."""
    downs, tables = random_forest(200), []
    keep = doubling.stored

    def held(df):
        out = keep(df)
        tables.append((df._jdf.queryExecution().executedPlan().toString(), out))
        return out

    monkeypatch.setattr(doubling, "stored", held)
    nodes = spark.createDataFrame([(i, d, i + 1) for i, d in downs.items()], "id long, p long, v long")
    way = lambda i: [i] if downs[i] is None else [i, *way(downs[i])]
    down = doubling.path_fold(nodes, {"v": lambda a, b: a + b})
    assert {r["id"]: r["v"] for r in down.collect()} == {i: sum(j + 1 for j in way(i)) for i in downs}
    up = doubling.upstream_sums(nodes, ["v"])
    assert {r["id"]: r["v"] for r in up.collect()} == {i: sum(j + 1 for j in downs if i in way(j)) for i in downs}
    assert not [plan for plan, _ in tables if "Broadcast" in plan]
    tips = set(downs) - set(downs.values())
    rounds = [t for plan, t in tables if "SortMergeJoin" in plan and "inner" not in t.columns]
    of_tips = [t for t in rounds if tips & {r["id"] for r in t.collect()}]
    assert len(of_tips) == 1  # what the path's fold writes of them at the end


def test_networks_are_worked_out_once(spark):
    """What groups are made of is stored: results do not read the tables again, and segments are asked for once."""
    tally = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            tally.add(len(pdf))
            yield pdf

    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2)], "id long, p long").mapInPandas(counted, "id long, p long")
    found = coarsen.downstream_group(nodes, spark.createDataFrame([(1, 1), (2, 2), (4, 2)], "id long, mini_id long"))
    assert {r["id"]: r["mini_down"] for r in found.collect()} == {1: None, 2: 1, 3: 2, 4: 1} and tally.value == 4
    plan = QUERIES["representative"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan and "o_orderkey" not in plan
