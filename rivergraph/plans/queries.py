"""Queries over networks, areas and grids derived from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivergraph.functions import geom
from rivergraph.functions.scratch import stored
from rivergraph.operators import cells, coarsen, doubling, roi, terrain, topology
from rivergraph.operators.routing import flow_directions

from .testbed import DEM, HEIGHT, NET_TREE, WIDTH, crowded, dem, net_chain, net_layers, net_tree, polygons, streams

OUTLETS = (1, 2, 5)
_TREE = f"with recursive {NET_TREE}"
_CLOSE = "u as (select id, {sub} sub from t where id in ({ids}) union all select t.id, u.sub from t join u on t.id_down = u.id)"


def _sub_sql() -> str:
    values = ", ".join(f"({o}, {len(OUTLETS) - k})" for k, o in enumerate(OUTLETS))
    return f"{_TREE}, o as (select * from (values {values}) v(o, s)), u as (select id, s sub from t join o on o.o = t.id union all select t.id, u.sub from t join u on t.id_down = u.id), s as (select id, min(sub) sub from u group by id)"


def upstream_closure(spark, sf):
    return topology.find_upstream(net_tree(spark, sf), [1])


def upstream_closure_multi(spark, sf):
    return topology.find_upstream_selection(net_tree(spark, sf), OUTLETS).ids


def sub_assignment(spark, sf):
    return topology.assign_sub(net_tree(spark, sf), OUTLETS).select("id", F.col("sub").cast("long").alias("sub"))


def _nodes(t):
    return topology.network(t).join(t.select("id", "length", "area").hint("merge"), "id")


def upstream_accumulation(spark, sf):
    return roi.accumulate(_nodes(stored(net_tree(spark, sf))), ["length", "area"])


def deep_chain_accumulation(spark, sf):
    t = net_chain(spark, sf)
    return roi.accumulate(topology.network(t).join(t.select("id", "length").hint("merge"), "id"), ["length"])


def _stem_nodes(spark, sf):
    t = stored(net_tree(spark, sf))
    nodes = stored(_nodes(t))
    sub = topology.assign_sub(t, OUTLETS)
    every = nodes.join(sub.hint("merge"), "id").join(roi.accumulate(nodes, ["area"]).hint("merge"), "id")
    return stored(every.select("id", "p", "sub", F.col("upstream_area").alias("area"), "length"))


def main_stem(spark, sf):
    return roi.main_stems(_stem_nodes(spark, sf))


def sink_detection(spark, sf):
    t = net_tree(spark, sf)
    return t.where(topology.is_sink(t, "id_down")).select("id")


def dangling_pointers(spark, sf):
    return topology.dangling(net_tree(spark, sf).where("id % 7 <> 3")).select("id", "id_down")


def duplicate_ids(spark, sf):
    return topology.duplicate_ids(net_tree(spark, sf).select(F.expr("id div 3 * 2 % 1001").alias("id")))


def missing_outlets(spark, sf):
    return topology.missing_outlets(net_tree(spark, sf).where("id % 2 = 0"), net_tree(spark, sf).select(F.expr("id % 97").alias("outlet_id")).distinct())


def root_of(spark, sf):
    return doubling.roots(topology.network(net_tree(spark, sf).where("id % 11 <> 1")))


def eligible_split(spark, sf):
    nodes = coarsen.split_eligible(_stem_nodes(spark, sf).withColumnRenamed("area", "upstream_area"), 40.0)
    inside = nodes.where("eligible").select(F.col("id").alias("_in"))
    return nodes.join(inside, F.col("p") == F.col("_in"), "left").select("id", "eligible", F.when(F.col("eligible"), F.col("_in")).alias("id_down"))


def _groups(spark, sf):
    """Segments in groups by main stem: a stand-in for merged groups that SQL can follow."""
    nodes = _stem_nodes(spark, sf)
    return nodes, roi.main_stems(nodes).select("id", F.col("water_course").alias("mini_id"))


def representative(spark, sf):
    nodes, groups = _groups(spark, sf)
    e = nodes.select("id", F.col("area").alias("upstream_area"), F.col("length").alias("unit_length"), F.lit(1).cast("long").alias("unit_area"))
    return coarsen.representatives(e, groups)


def downstream_group(spark, sf):
    nodes, groups = _groups(spark, sf)
    return coarsen.downstream_group(nodes.select("id", "p"), groups.where("mini_id % 3 <> 0"))


def short_assignment(spark, sf):
    nodes, groups = _groups(spark, sf)
    kept = groups.where("id % 3 = 0")
    lengths = coarsen.group_lengths(kept, nodes.select("id", F.col("length").alias("unit_length")))
    wanted = nodes.select("id").join(kept, "id", "left_anti")
    named = nodes.join(groups.select("id", F.col("mini_id").alias("water_course")), "id")
    return coarsen.assign_nearest(wanted, named.select("id", "p", "sub", "water_course"), kept, lengths)


def minibasin_merge(spark, sf):
    nodes, groups = _groups(spark, sf)
    e = nodes.join(groups, "id").select("id", "p", "sub", F.col("mini_id").alias("water_course"), F.col("length").cast("double").alias("unit_length"))
    return coarsen.merged_groups(e, 3e7)


def poly_area_length(spark, sf):
    return polygons(spark, sf).select("id", geom.area("geometry").alias("area"), geom.length("geometry").alias("length"))


def poly_bounds(spark, sf):
    return geom.total_bounds(polygons(spark, sf))


def dissolved_area(spark, sf):
    p = polygons(spark, sf)
    return geom.dissolve(p.withColumn("g", F.expr("id div 10")), "g").select("g", geom.area("geometry").alias("area"))


def rasterise_cells(spark, sf):
    return geom.rasterise(polygons(spark, sf), "id", (0.0, 0.0, 1.0, 1.0)).groupBy("id").agg(F.count("*").alias("cells"),
        F.min("col").cast("long").alias("first_col"), F.max("row").cast("long").alias("last_row"))


def agree_condition(spark, sf):
    return cells.agree(dem(spark, sf), sharp=80, smooth=8, buffer=4).select("row", "col", "z")


def d8_natural(spark, sf):
    return cells.natural_d8(dem(spark, sf), WIDTH, HEIGHT).select("row", "col", F.col("code").cast("long").alias("code"))


def _pits(spark, sf):
    """Natural directions with pits as terminals."""
    return cells.natural_d8(dem(spark, sf), WIDTH, HEIGHT).withColumn("code", F.coalesce("code", F.lit(0)))


def rank_terminal(spark, sf):
    return cells.routes(_pits(spark, sf), WIDTH, HEIGHT).select("row", "col", F.col("rank").cast("long").alias("rank"), "trow", "tcol")


def hand(spark, sf):
    return cells.hand(dem(spark, sf), cells.routes(_pits(spark, sf), WIDTH, HEIGHT))


def ltnd(spark, sf):
    return cells.ltnd(cells.routes(_pits(spark, sf), WIDTH, HEIGHT))


def basin_labels(spark, sf):
    return cells.basins(cells.routes(_pits(spark, sf), WIDTH, HEIGHT)).select("row", "col", F.col("basin").cast("long").alias("basin"))


def corridor_costs(spark, sf):
    return cells.corridor_costs(_pits(spark, sf), WIDTH, HEIGHT).select("row", "col", "cut_max", F.round("cut_sum", 6).alias("cut_sum"), "length")


def basin_edges(spark, sf):
    """Over whole heights, where sums are exact and ties are many."""
    steps = cells.natural_d8(dem(spark, sf, flats=True), WIDTH, HEIGHT).withColumn("code", F.coalesce("code", F.lit(0)))
    found = cells.basin_edges(steps, WIDTH, HEIGHT)
    return found.withColumns({c: F.col(c).cast("long") for c in ("source", "target", "orow", "ocol", "drow", "dcol")})


def _roi(spark, sf):
    catchments, segments = net_layers(spark, sf)
    return roi.define_roi(catchments, segments, outlet_ids=OUTLETS, destine_crs="EPSG:3857", source_crs="EPSG:3857")


def roi_segments(spark, sf):
    return _roi(spark, sf).segments.drop("geometry", "strahler_order").withColumn("sub", F.col("sub").cast("long"))


def roi_catchments(spark, sf):
    return _roi(spark, sf).catchments.select("id", "id_down", F.col("sub").cast("long").alias("sub"), "upstream_area", "water_course", geom.area("geometry").alias("square_metres"))


def overlap_check(spark, sf):
    return geom.overlapping(crowded(spark, sf)).withColumn("area", F.round("area", 6))


def drainage_cells(spark, sf):
    return geom.rasterise(streams(spark, sf), "id", (0.0, 0.0, 1.0, 1.0), lines=True).groupBy("id").agg(F.count("*").alias("cells"),
        F.min("col").cast("long").alias("first_col"), F.max("col").cast("long").alias("last_col"))


def unmatched_layer_ids(spark, sf):
    t = net_tree(spark, sf).select("id")
    return terrain.unmatched_ids(t.where("id % 5 <> 0"), t.where("id % 7 <> 0"))


def catchment_labels(spark, sf):
    return terrain.labelled(polygons(spark, sf)).select("id", F.col("label").cast("long").alias("label"))


def flow_direction_full(spark, sf):
    return flow_directions(dem(spark, sf, flats=True), WIDTH, HEIGHT)


def negative_hand_report(spark, sf):
    grid = dem(spark, sf)
    return cells.rank_report(grid, cells.hand(grid, cells.routes(_pits(spark, sf), WIDTH, HEIGHT)))


QUERIES = {
    f.__name__: f
    for f in (
        upstream_closure, upstream_closure_multi, sub_assignment, upstream_accumulation, deep_chain_accumulation, main_stem, sink_detection,
            dangling_pointers, duplicate_ids, missing_outlets,
        root_of, eligible_split, representative, downstream_group, short_assignment, minibasin_merge, poly_area_length, poly_bounds,
            dissolved_area, rasterise_cells, agree_condition, d8_natural,
        rank_terminal, hand, ltnd, basin_labels, corridor_costs, basin_edges, flow_direction_full, negative_hand_report, roi_segments,
            roi_catchments, overlap_check, drainage_cells,
        unmatched_layer_ids, catchment_labels,
    )
}

_ACC = "a as (select id, id as anc from t union all select a.id, t.id_down from a join t on a.anc = t.id where t.id_down is not null), s as (select anc id, sum(length)::bigint upstream_length, sum(area)::bigint upstream_area from a join t using (id) group by anc)"
_STEM = f"""{_sub_sql()}, {_ACC.replace("s as (", "acc as (")},
n as (select t.id, t.id_down p, s.sub, upstream_area area, t.length from t join s using (id) join acc on acc.id = t.id),
i as (select n.*, m.id mp from n left join n m on n.p = m.id and n.sub = m.sub),
r as (select *, row_number() over (partition by mp order by area desc, length desc, id::varchar desc) k from i),
w as (select id, id wc from i where mp is null union all select r.id, case when r.k = 1 then w.wc else r.id end from r join w on r.mp = w.id)"""
_OFF = "o as (select * from (values (1,-1,0),(2,-1,1),(3,0,1),(4,1,1),(5,1,0),(6,1,-1),(7,0,-1),(8,-1,-1)) v(code, dr, dc))"
_D8 = f"""{DEM}, {_OFF}, st as (select *, case when dr = 0 then {WIDTH} when dc = 0 then {HEIGHT} else 5.0 end::double dist from o),
nb as (select c.r, c.k, st.code, (c.z - n.z) / dist slope, n.r nr, n.k nk from c, st, c n where n.r = c.r + dr and n.k = c.k + dc and n.l = c.l and n.z < c.z and not c.d),
best as (select r, k, code, row_number() over (partition by r, k order by slope desc, nr, nk) q from nb),
d8 as (select c.*, case when d then 0 else code end code from c left join best on best.r = c.r and best.k = c.k and q = 1)"""
_ROUTE = f"""with recursive {_D8}, f as (select d8.r, d8.k, d8.l, d8.z, d8.code, r + coalesce(dr, 0) nr, k + coalesce(dc, 0) nk, coalesce(dist, 0.0) dist
  from d8 left join st on st.code = nullif(d8.code, 0)),
w as (select r, k, 0::bigint rank, 0.0::double len, r tr, k tk, z tz, 0.0::double cm, 0.0::double cs from f where coalesce(code, 0) = 0
  union all select f.r, f.k, w.rank + 1, w.len + f.dist, tr, tk, tz, greatest(cm, greatest(f.z - tz, 0)), cs + greatest(f.z - tz, 0) from f
    join w on f.nr = w.r and f.nk = w.k where coalesce(f.code, 0) > 0)"""
_BASIN = "b as (select r, k, dense_rank() over (order by first) - 1 basin from (select r, k, min(r * 50 + k) over (partition by tr, tk) as first from w))"
_WHOLE = _ROUTE.replace("value::double z", "floor(value / 8)::double z")
_MET = "case st.code when 8 then 1 when 1 then 2 when 2 then 3 when 7 then 4 when 3 then 5 when 4 then 6 when 5 then 7 else 8 end"
_POLY = "p as (select p_partkey::bigint id, p_size::bigint w, p_size::bigint % 7 + 1 h from part)"

ORACLES: dict[str, str] = {
    "basin_edges": f"""{_WHOLE}, {_BASIN}, x as (select w.*, basin, c.l from w join b using (r, k) join c using (r, k)),
      e as (select a.basin source, n.basin target, a.cm cut_max, a.cs cut_sum, a.len + st.dist length, a.r::bigint orow, a.k::bigint ocol, n.r::bigint drow, n.k::bigint dcol,
        row_number() over (partition by a.basin, n.basin order by a.cm, a.cs, a.len + st.dist, a.r, a.k, {_MET}) q from x a, st, x n
          where n.r = a.r + st.dr and n.k = a.k + st.dc and n.l = a.l and n.basin <> a.basin)
      select source, target, cut_max, cut_sum, length, orow, ocol, drow, dcol from e where q = 1""",
    "roi_segments": f"{_STEM} select n.id, t.id_down, n.sub::bigint sub, n.length::double unit_length, upstream_length::double upstream_length, "
        f"t.area::double unit_area, upstream_area::double upstream_area, wc water_course from n join t using (id) join acc using (id) join w using (id)",
    "roi_catchments": f"{_STEM} select n.id, t.id_down, n.sub::bigint sub, upstream_area::double upstream_area, wc water_course, t.area * 1e6::double "
        f"square_metres from n join t using (id) join acc using (id) join w using (id)",
    "overlap_check": "with p as (select p_partkey::bigint id, p_size::bigint w, p_size::bigint % 7 + 1 h from part) select a.id a, b.id b, (least(a.w "
        "- 20 * (b.id - a.id), b.w) * least(a.h, b.h))::double area from p a join p b on b.id between a.id + 1 and a.id + 2 where 20 * (b.id - a.id) < a.w",
    "drainage_cells": "select p_partkey::bigint id, p_size::bigint cells, 100 * p_partkey::bigint first_col, 100 * p_partkey::bigint + p_size::bigint - 1 last_col from part",
    "unmatched_layer_ids": f"with {NET_TREE} select id from t where (id % 5 <> 0) <> (id % 7 <> 0)",
    "catchment_labels": "select p_partkey::bigint id, row_number() over (order by p_partkey::bigint::varchar) - 1 as label from part",
    "upstream_closure": f"{_TREE}, {_CLOSE.format(sub=1, ids=1)} select id from u",
    "upstream_closure_multi": f"{_sub_sql()} select id from s",
    "sub_assignment": f"{_sub_sql()} select id, sub::bigint sub from s",
    "upstream_accumulation": f"{_TREE}, {_ACC} select * from s",
    "deep_chain_accumulation": "select p_partkey::bigint id, (sum(p_size) over (order by p_partkey desc))::bigint upstream_length from part",
    "main_stem": f"{_STEM} select id, wc water_course from w",
    "sink_detection": f"with {NET_TREE} select id from t where id_down is null",
    "dangling_pointers": f"with {NET_TREE}, x as (select * from t where id % 7 <> 3) select id, id_down from x where id_down is not null and id_down not in (select id from x)",
    "duplicate_ids": f"with {NET_TREE} select id // 3 * 2 % 1001 id, count(*) n from t group by 1 having count(*) > 1",
    "missing_outlets": f"with {NET_TREE} select distinct id % 97 outlet_id from t where id % 97 not in (select id from t where id % 2 = 0)",
    "root_of": f"{_TREE}, x as (select * from t where id % 11 <> 1), u as (select id, id root from x where id_down is null or id_down not in (select "
        f"id from x) union all select x.id, u.root from x join u on x.id_down = u.id) select * from u",
    "eligible_split": f"{_STEM} select n.id, n.area >= 40 eligible, case when n.area >= 40 then m.id end id_down from n left join n m on n.p = m.id and m.area >= 40",
    "representative": f"{_STEM}, g as (select wc mini_id, n.* from w join n using (id)) select mini_id, max_by(id, {{'a': area, 'b': length, 'c': id::varchar}}) rep, sum(length)::bigint unit_length, count(*)::bigint unit_area from g group by mini_id",
    "downstream_group": f"{_STEM}, g as (select n.id, n.p, case when wc % 3 <> 0 then wc end m from n join w using (id)), x as (select id, m, p pos "
        f"from g union all select x.id, x.m, g.p from x join g on g.id = x.pos where g.m is null or g.m = x.m) "
    "select g0.id, max(g.m) mini_down from g g0 left join x on x.id = g0.id left join g on g.id = x.pos and g.m is not null and g.m is distinct from x.m group by g0.id",
    "short_assignment": f"{_STEM}, g as (select n.id, n.p, n.sub, wc, case when n.id % 3 = 0 then wc end m, n.length from n join w using (id)), ln as "
        f"(select m, sum(length)::double len from g where m is not null group by m),"
    + ", ".join(
        f"d{k} as (select id, p pos, 1 st from g where m is null union all select d.id, h.p, 1 from d{k} d join g h on h.id = d.pos join g s on s.id = d.id where h.m is null and {same}),"
        f"u{k} as (select id, id as pos from g where m is null union all select u.id, h.id from u{k} u join g a on a.id = u.pos join g h on h.p = "
            f"u.pos join g s on s.id = u.id where a.m is null and {same}),"
        f"c{k} as (select d.id, h.m from d{k} d join g h on h.id = d.pos join g s on s.id = d.id where h.m is not null and {same} union select u.id, "
            f"h.m from u{k} u join g h on h.id = u.pos where h.m is not null),"
        f"b{k} as (select id, min_by(m, {{'a': len, 'b': m::varchar}}) m from c{k} join ln using (m) group by id)"
        for k, same in ((1, "h.sub = s.sub and h.wc = s.wc"), (2, "h.sub = s.sub"))
    )
    + " select id, coalesce(b1.m, b2.m) mini_id from (select id from g where m is null) full join b1 using (id) full join b2 using (id) where coalesce(b1.m, b2.m) is not null",
    "poly_area_length": f"with {_POLY} select id, (w * h)::double area, (2 * (w + h))::double length from p",
    "poly_bounds": f"with {_POLY} select min(100 * id)::double xmin, 0::double ymin, max(100 * id + w)::double xmax, max(h)::double ymax from p",
    "dissolved_area": f"with {_POLY} select id // 10 g, sum(w * h)::double area from p group by 1",
    "rasterise_cells": f"with {_POLY} select id, w * h cells, 100 * id first_col, h - 1 last_row from p",
    "agree_condition": f"with {DEM}, x as (select c.r, c.k, min(sqrt(((c.r - n.r) * (c.r - n.r) + (c.k - n.k) * (c.k - n.k))::double)) q from c join "
        f"c n on n.d and n.l = c.l and n.r between c.r - 4 and c.r + 4 and n.k between c.k - 4 and c.k + 4 group by 1, 2) "
    'select c.r "row", c.k col, c.z + case when q <= 4 then 8.0::double * (q - 4) else 0 end - case when d then 80.0::double else 0 end z from c left join x using (r, k)',
    "d8_natural": f'with {_D8} select r "row", k col, code::bigint code from d8',
    "rank_terminal": f'{_ROUTE} select r "row", k col, rank, tr trow, tk tcol from w',
    "hand": f'{_ROUTE} select w.r "row", w.k col, f.z - tz hand from w join f using (r, k)',
    "ltnd": f'{_ROUTE} select r "row", k col, len ltnd from w',
    "basin_labels": f'{_ROUTE}, {_BASIN} select r "row", k col, basin from b',
    "corridor_costs": f'{_ROUTE} select r "row", k col, cm cut_max, round(cs, 6) cut_sum, len length from w',
    "negative_hand_report": f"{_ROUTE}, h as (select f.z - tz hand from w join f using (r, k)) select (select count(*) from c where l >= 0) "
        f"owned_cells, (select count(*) from c where d) drainage_cells, 0::bigint unreachable_components, count(*) filter (hand < 0) negative_hand_cells, "
        f"min(hand) filter (hand < 0) negative_hand_min, max(hand) filter (hand < 0) negative_hand_max from h",
}
