"""Terrain products end to end: layers and an elevation grid in, HAND, LTND and flow directions out.

Catchments are labelled in the order of their ids as text and rasterised by cell centres; a catchment's own segment marks
every cell it touches inside that label as drainage. Elevation is read only in the window of the catchments. Directions
follow the elevation conditioned towards drainage, HAND the elevation as read.

Defined cases: cells of a catchment without elevation are owned, but have no direction, HAND or LTND; a cell whose centre
two catchments claim is the later label's; files appear one by one when all are whole.
"""

from __future__ import annotations

import math
import os
import tempfile
import time
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivergraph.errors import TerrainProductsError
from rivergraph.functions import crs as systems
from rivergraph.functions import geom
from rivergraph.functions.numbering import numbered
from rivergraph.functions.scratch import stored
from rivergraph.sources import geotiff
from rivergraph.sources.paths import TerrainPaths, terrain_paths
from rivergraph.sources.vector import Layer

from . import cells
from .routing import flow_directions


class TerrainReport(NamedTuple):
    paths: TerrainPaths
    owned_cells: int
    drainage_cells: int
    unreachable_components: int
    negative_hand_cells: int
    negative_hand_min: float | None
    negative_hand_max: float | None
    routing_seconds: float
    jit_compilation_seconds: float  # nothing is compiled here
    raster_io_seconds: float
    conditioning_seconds: float


def check_layers(catchments: Layer, segments: Layer, id_col: str) -> None:
    """Raise unless both layers have a system of coordinates, whole geometries of the right kind, unique ids, the same ids in
    both, and no two catchments overlap."""
    for name, layer, kinds in (("catchments", catchments, (geom.POLYGON, geom.MULTIPOLYGON)), ("segments", segments, (geom.LINE, geom.MULTILINE))):
        if id_col not in layer.rows.columns:
            raise TerrainProductsError(f"{name}: a column is missing, no {id_col!r}")
        if layer.crs is None:
            raise TerrainProductsError(f"{name}: the layer has no CRS")
        told = layer.rows.select(F.col(id_col).alias("id"), geom.kind_of("geometry").alias("kind"), geom.is_empty("geometry").alias("empty"))
        facts = told.agg(
            F.count("*").alias("n"), F.count_if(F.col("empty").isNull() | F.col("empty")).alias("empty"),
                F.count_if(~F.col("kind").isin(*kinds)).alias("odd"), F.count_if(F.col("id").isNull()).alias("null"),
        ).first()
        if not facts["n"] or facts["empty"]:
            raise TerrainProductsError(f"{name}: no rows, or some with a null or empty geometry")
        if facts["odd"]:
            raise TerrainProductsError(f"{name}: {facts['odd']} geometries of a kind that does not fit")
        if facts["null"] or not told.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise TerrainProductsError(f"{name}: ids must be there and unique")
    if not unmatched_ids(catchments.rows, segments.rows, id_col).isEmpty():
        raise TerrainProductsError("the ids of catchments and segments do not match")
    if not geom.overlapping(catchments.rows, id_col).isEmpty():
        raise TerrainProductsError("some catchments have overlaps")


def unmatched_ids(one: DataFrame, two: DataFrame, id_col: str = "id") -> DataFrame:
    """id of rows that the other side lacks."""
    a, b = one.select(F.col(id_col).alias("id")), two.select(F.col(id_col).alias("id"))
    return a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti"))


def check_grid(grid: geotiff.Grid) -> tuple[float, float]:
    """Width and height of a cell; raises unless the grid is in a projected system in metres and not turned."""
    if grid.crs is None:
        raise TerrainProductsError("the elevation grid has no CRS")
    if not grid.projected:
        raise TerrainProductsError("the elevation grid must be in a projected system")
    if not grid.metres:
        raise TerrainProductsError("the elevation grid must be in metres")
    return pixel_sizes(grid.transform)


def pixel_sizes(transform: tuple) -> tuple[float, float]:
    _, dx, sx, _, sy, dy = transform
    if sx or sy or not dx or not dy or not all(map(math.isfinite, transform)):
        raise TerrainProductsError("the grid must not be turned, and its cells need a size")
    return abs(dx), abs(dy)


def labelled(catchments: DataFrame, id_col: str = "id") -> DataFrame:
    """id, label (from 0 in the order of ids as text), geometry."""
    ids = catchments.select(F.col(id_col).alias("id")).withColumn("text", F.col("id").cast("string"))
    ids = numbered(ids, ["text"], "label").select("id", F.col("label").cast("int").alias("label"))
    return catchments.select(F.col(id_col).alias("id"), "geometry").join(ids, "id")


def rasterised(catchments: DataFrame, segments: DataFrame, transform: tuple, window: geotiff.Window) -> DataFrame:
    """row, col, label, is_drain of the cells of labelled catchments (id, label, geometry); segments: id, geometry."""
    x0, dx, _, y0, _, dy = transform
    inside = (F.col("row") >= 0) & (F.col("row") < window.height) & (F.col("col") >= 0) & (F.col("col") < window.width)
    owned = geom.rasterise(catchments, "label", (x0, y0, dx, dy)).where(inside).groupBy("row", "col").agg(F.max("id").alias("label"))
    lines = segments.join(catchments.select("id", "label"), "id")
    wet = geom.rasterise(lines, "label", (x0, y0, dx, dy), lines=True).where(inside).select("row", "col", F.col("id").alias("label"), F.lit(True).alias("wet")).distinct()
    return owned.join(wet, ["row", "col", "label"], "left").select("row", "col", "label", F.coalesce("wet", F.lit(False)).alias("is_drain"))


def create_terrain_products(
    dem_path: str, catchments: Layer, segments: Layer, output_dir: str, *, id_col: str = "id", write_flow_direction: bool = False,
        agree_sharp: float = 80.0, agree_smooth: float = 8.0, agree_buffer: int = 4
) -> TerrainReport:
    check_layers(catchments, segments, id_col)
    cells.check_agree(agree_sharp, agree_smooth, agree_buffer)
    began = time.perf_counter()
    grid = geotiff.open_grid(str(dem_path))
    width, height = check_grid(grid)
    areas = stored(labelled(catchments.rows.withColumn("geometry", systems.transform_wkb(catchments.crs, grid.crs)("geometry")), id_col))
    lines = segments.rows.select(F.col(id_col).alias("id"), systems.transform_wkb(segments.crs, grid.crs)("geometry").alias("geometry"))
    bounds = tuple(geom.total_bounds(areas).first())
    left, bottom, right, top = grid.bounds
    if bounds[0] < left or bounds[1] < bottom or bounds[2] > right or bounds[3] > top:
        raise TerrainProductsError("the elevation grid does not cover all catchments")
    window = geotiff.window_of(grid, bounds)
    transform = geotiff.window_transform(grid, window)
    held = rasterised(areas, lines, transform, window)
    spark = held.sparkSession
    table = stored(held.join(geotiff.read_cells(spark, grid, window), ["row", "col"], "left"))
    read = time.perf_counter()
    conditioned = stored(cells.agree(table, sharp=agree_sharp, smooth=agree_smooth, buffer=agree_buffer))
    agreed = time.perf_counter()
    directed = stored(flow_directions(conditioned, width, height))
    way = stored(cells.routes(directed, width, height))
    hands = stored(cells.hand(table, way))
    routed = time.perf_counter()
    paths = terrain_paths(str(output_dir), write_flow_direction)
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    notes = {
        "routing": "to drainage inside each catchment, AGREE-conditioned, depressions breached", "agree_sharp": agree_sharp, "agree_smooth": agree_smooth,
        "agree_buffer_pixels": agree_buffer, "direction_codes": "-1 nodata, 0 drainage, 1-8 N NE E SE S SW W NW",
    }
    out = [(hands, "hand", "float32", math.nan, paths.hand), (cells.ltnd(way), "ltnd", "float32", math.nan, paths.ltnd)]
    if paths.flow_direction:
        out.append((directed, "code", "int8", -1, paths.flow_direction))
    with tempfile.TemporaryDirectory(prefix=".terrain-", dir=output_dir) as private:
        for rows, value, dtype, nodata, path in out:
            geotiff.write_grid(rows, value, f"{private}/{path.name}", width=window.width, height=window.height, transform=transform,
                crs=grid.crs, dtype=dtype, nodata=nodata, notes=notes)
        for *_, path in out:
            os.replace(f"{private}/{path.name}", path)
    report = cells.rank_report(table, hands).first()
    done = time.perf_counter()
    # negative HAND is reported as the files hold it
    single = lambda v: None if v is None else float(np.float32(v))
    return TerrainReport(
        paths, report["owned_cells"], report["drainage_cells"], report["unreachable_components"], report["negative_hand_cells"],
            single(report["negative_hand_min"]), single(report["negative_hand_max"]),
        routed - agreed, 0.0, read - began + done - routed, agreed - read,
    )
