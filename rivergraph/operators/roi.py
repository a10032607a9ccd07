"""Region of interest: upstream selection, sub-basins, accumulated metrics and main stems."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivergraph.errors import InvalidInputSchemaError, MissingCrsError
from rivergraph.functions import geom
from rivergraph.functions.scratch import stored

from .doubling import roots, upstream_sums
from .topology import assign_sub, check_unique, network, resolve_column

#: Columns of both result layers, in this order.
LAYER = ("id", "id_down", "sub", "strahler_order", "unit_length", "upstream_length", "unit_area", "upstream_area", "water_course", "geometry")


class Roi(NamedTuple):
    catchments: DataFrame
    segments: DataFrame


def accumulate(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes: id, p, values. id and upstream_<value>: the sum over the node and all upstream."""
    sums = upstream_sums(nodes, values)
    return sums.select("id", *(F.col(v).alias(f"upstream_{v}") for v in values))


def main_stems(nodes: DataFrame) -> DataFrame:
    """nodes: id, p, sub, area, length. id, water_course: in each sub, the child of greatest (area, length, id as text)
    goes on with its parent's label; others, and roots, label themselves."""
    up = nodes.select(F.col("id").alias("_id"), F.col("sub").alias("_sub"))
    inside = nodes.join(up.hint("merge"), (F.col("p") == F.col("_id")) & (F.col("sub") == F.col("_sub")), "left")
    inside = stored(inside.select("id", F.col("_id").alias("p"), "area", "length"))
    order = F.struct("area", "length", F.col("id").cast("string"))
    main = inside.where("p is not null").groupBy("p").agg(F.max_by("id", order).alias("id")).select(F.col("id").alias("_main"), F.col("p").alias("_to"))
    stem = inside.select("id").join(main.hint("merge"), F.col("id") == F.col("_main"), "left").select("id", F.col("_to").alias("p"))
    return roots(stem).select("id", F.col("root").alias("water_course"))


def define_roi(
    catchments: DataFrame, segments: DataFrame, *, outlet_ids: Iterable, destine_crs: str, source_crs: str | None = None,
        catchments_crs: str | None = None, segments_crs: str | None = None,
    id_col: str = "id", id_down_col: str = "id_down", strahler_order_col: str = "strahler_order", keep_order: bool = True,
) -> Roi:
    """Both layers carry WKB in `geometry`; their CRS is source_crs, or else the one of the layer. With keep_order the rows come
    out in the order of the input, at the price of a sort."""
    from rivergraph.functions.crs import transform_wkb

    ci, si = resolve_column(catchments, id_col), resolve_column(segments, id_col)
    so, sd = resolve_column(segments, strahler_order_col), resolve_column(segments, id_down_col)
    for crs in (catchments_crs, segments_crs):
        if not (source_crs or crs):
            raise MissingCrsError("a layer has no CRS; give source_crs")
    check_unique(catchments, ci)
    links = stored(segments.select(si, sd))
    sub = stored(assign_sub(links, outlet_ids, id_col=si, id_down_col=sd))
    net = network(links, si, sd)
    kind = net.schema["id"].dataType
    project = lambda crs: transform_wkb(source_crs or crs, destine_crs)
    seg = segments.select(F.col(si).cast(kind).alias("id"), F.col(sd).cast(kind).alias("id_down"),
        F.col(so).cast("int").alias("strahler_order"), "geometry", F.monotonically_increasing_id().alias("_at")).join(sub.hint("merge"), "id")
    cat = catchments.select(F.col(ci).cast(kind).alias("id"), "geometry", F.monotonically_increasing_id().alias("_at")).join(sub.hint("merge"), "id")
    # only selected geometries are projected and measured
    seg = seg.withColumn("geometry", project(segments_crs)("geometry")).withColumn("unit_length", geom.length("geometry") / 1000)
    cat = cat.withColumn("geometry", project(catchments_crs)("geometry")).withColumn("unit_area", geom.area("geometry") / 1e6)
    unit = stored(seg.select("id", "sub", "unit_length").join(cat.select(F.col("id").alias("_c"), "unit_area").hint("merge"), F.col("id") == F.col("_c"), "left"))
    if some := [str(r[0]) for r in unit.where("_c is null").select("id").limit(20).collect()]:
        raise InvalidInputSchemaError(f"Segment(s) without a catchment: {', '.join(some)}")
    chosen = sub.select(F.col("id").alias("_in"))
    nodes = unit.join(net.hint("merge"), "id").join(chosen.hint("merge"), F.col("p") == F.col("_in"), "left")
    nodes = stored(nodes.select("id", F.col("_in").alias("p"), "sub", "unit_length", "unit_area"))
    sums = accumulate(nodes, ["unit_length", "unit_area"]).select("id", F.col("upstream_unit_length").alias("upstream_length"), F.col("upstream_unit_area").alias("upstream_area"))
    stems = main_stems(nodes.join(sums.hint("merge"), "id").select("id", "p", "sub", F.col("upstream_area").alias("area"), F.col("unit_length").alias("length")))
    facts = nodes.select("id", "unit_length", "unit_area").join(sums.hint("merge"), "id").join(stems.hint("merge"), "id")
    carried = seg.select("id", "id_down", "strahler_order")
    finish = lambda df: (df.orderBy("_at") if keep_order else df).select(*LAYER)
    return Roi(finish(cat.drop("unit_area").join(carried.hint("merge"), "id", "left").join(facts.hint("merge"), "id", "left")), finish(seg.drop("unit_length").join(facts.hint("merge"), "id")))
