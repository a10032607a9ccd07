"""The command line: define-roi, aggregate and terrain-products. `python -m rivergraph.cli --help`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from rivergraph.errors import RiverGraphError
from rivergraph.functions.scratch import clear_scratch
from rivergraph.operators.coarsen import aggregate_minibasins
from rivergraph.operators.roi import define_roi
from rivergraph.operators.terrain import create_terrain_products
from rivergraph.operators.topology import coerce_outlets
from rivergraph.sources.paths import mini_paths, roi_paths
from rivergraph.sources.vector import Layer, read_vector, write_vector


def define_roi_command(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = roi_paths(a.output_dir, a.output_format)
    catchments, segments = read_vector(spark, a.catchments), read_vector(spark, a.segments)
    outlets = coerce_outlets(segments.rows, a.outlet_id, a.id_col)
    roi = define_roi(
        catchments.rows, segments.rows, outlet_ids=outlets, destine_crs=a.destine_crs, source_crs=a.source_crs, catchments_crs=catchments.crs, segments_crs=segments.crs,
        id_col=a.id_col, id_down_col=a.id_down_col, strahler_order_col=a.strahler_order_col,
    )
    _write(((r, p, a.destine_crs.upper()) for r, p in zip(roi, paths, strict=True)), a.output_format)


def aggregate_command(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = mini_paths(a.output_dir, a.output_format)
    catchments, segments = read_vector(spark, a.roi_catchments), read_vector(spark, a.roi_segments)
    minis = aggregate_minibasins(catchments.rows, segments.rows, uparea_min=a.uparea_min, lmin=a.lmin)
    _write(zip(minis, paths, (catchments.crs, segments.crs, catchments.crs), strict=True), a.output_format)


def terrain_command(spark: SparkSession, a: argparse.Namespace) -> None:
    report = create_terrain_products(
        a.dem, read_vector(spark, a.roi_catchments), read_vector(spark, a.roi_segments), a.output_dir, id_col=a.id_col, write_flow_direction=a.write_flow_direction,
        agree_sharp=a.agree_sharp, agree_smooth=a.agree_smooth, agree_buffer=a.agree_buffer,
    )
    for path in filter(None, report.paths):
        print(f"Wrote {path}")
    print(f"Cells owned: {report.owned_cells}; drainage: {report.drainage_cells}; parts not connected: {report.unreachable_components}")
    print(f"Seconds: {report.raster_io_seconds:.3f} reading and writing, {report.conditioning_seconds:.3f} conditioning, {report.routing_seconds:.3f} routing")
    some = f", from {report.negative_hand_min:g} to {report.negative_hand_max:g} m" if report.negative_hand_cells else ""
    print(f"Cells below their drainage: {report.negative_hand_cells}{some}")


def _write(layers, output_format: str) -> None:
    for rows, path, crs in layers:
        write_vector(Layer(rows, crs), path, output_format=output_format)
        print(f"Wrote {path}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rivergraph", description="River-network preprocessing", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)
    roi = commands.add_parser("define-roi", help="select what lies upstream of the outlets", allow_abbrev=False)
    for name in ("--catchments", "--segments", "--destine-crs", "--output-dir"):
        roi.add_argument(name, required=True)
    roi.add_argument("--outlet-id", action="append", required=True)
    roi.add_argument("--source-crs")
    for name in ("id", "id_down", "strahler_order"):
        roi.add_argument(f"--{name.replace('_', '-')}-col", default=name)
    roi.set_defaults(run=define_roi_command)
    mini = commands.add_parser("aggregate", help="merge segments and catchments into mini-basins", allow_abbrev=False)
    for name in ("--roi-catchments", "--roi-segments", "--output-dir"):
        mini.add_argument(name, required=True)
    for name in ("--uparea-min", "--lmin"):
        mini.add_argument(name, type=float, required=True)
    mini.set_defaults(run=aggregate_command)
    terrain = commands.add_parser("terrain-products", help="HAND and LTND grids of catchments", allow_abbrev=False)
    for name in ("--dem", "--roi-catchments", "--roi-segments", "--output-dir"):
        terrain.add_argument(name, required=True)
    terrain.add_argument("--id-col", default="id")
    terrain.add_argument("--write-flow-direction", action="store_true")
    terrain.add_argument("--agree-sharp", type=float, default=80.0, help="how much deeper drainage cells are cut, in units of elevation")
    terrain.add_argument("--agree-smooth", type=float, default=8.0, help="how much a cell falls for each cell nearer to drainage")
    terrain.add_argument("--agree-buffer", type=int, default=4, help="how many cells from drainage the fall begins")
    terrain.set_defaults(run=terrain_command)
    for p in (roi, mini):
        p.add_argument("--output-format", default="fgb")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.getOrCreate()
    try:
        a.run(session, a)
    except RiverGraphError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    finally:
        if spark is None:  # else the caller's other results may still read from there
            clear_scratch(session)
    return 0


if __name__ == "__main__":
    sys.exit(main())
