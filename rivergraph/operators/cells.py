"""Elevation grids as tables of cells: row, col, label (catchment), z (NaN or null: no data), is_drain.

Neighbours are read inside tiles of a label that overlap by a cell: one shuffle and one sort, and rows are not multiplied
by eight. Nothing crosses a label. Pointers along flow directions are followed by doubling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType

from rivergraph.errors import MissingColumnsError, TerrainProductsError, TopologyCycleError
from rivergraph.functions.numbering import numbered
from rivergraph.functions.scratch import stored

from .doubling import path_fold
from .topology import require_columns

#: Directions 1 to 8 are N NE E SE S SW W NW, as (row, column) steps; 0 ends, -1 is no data.
#: SCAN: the order in which crossings from one cell are met when cells are read row by row, each with its neighbours
#: to the E, SE, S and SW, both ways: those from the cells before it come first.
SCAN = (8, 1, 2, 7, 3, 4, 5, 6)
#: TILE: rows and columns of a tile; with its border it stays below the rows that a window keeps in memory.
TILE = 60
OFFSETS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def opposite(code: int) -> int:
    return (code + 3) % 8 + 1


def step_lengths(width: float, height: float) -> list[float]:
    return [math.hypot(dr * height, dc * width) for dr, dc in OFFSETS]


def check_agree(sharp: float, smooth: float, buffer: int) -> None:
    for name, v in (("agree_sharp", sharp), ("agree_smooth", smooth)):
        if not math.isfinite(v) or v < 0:
            raise TerrainProductsError(f"{name} must be finite and not negative")
    if isinstance(buffer, bool) or not isinstance(buffer, int) or buffer < 0:
        raise TerrainProductsError("agree_buffer must be an integer of 0 or more")


def valid(c: str = "z") -> Column:
    z = F.col(c)
    return z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))


def check_cells(cells: DataFrame) -> None:
    """Raise unless cells has row, col, label (whole numbers), z (a number) and is_drain (true or false)."""
    try:
        require_columns(cells, ("row", "col", "label", "z", "is_drain"))
    except MissingColumnsError as e:
        raise TerrainProductsError(str(e)) from e
    kinds = {"row": IntegralType, "col": IntegralType, "label": IntegralType, "z": NumericType, "is_drain": BooleanType}
    if bad := [n for n, k in kinds.items() if not isinstance(cells.schema[n].dataType, k)]:
        raise TerrainProductsError(f"columns of a type that does not fit: {', '.join(bad)}")


def check_drainage(cells: DataFrame) -> None:
    check_cells(cells)
    if not cells.where(F.col("is_drain") & ~(valid() & (F.col("label") >= 0))).isEmpty():
        raise TerrainProductsError("drainage lies on cells without data")


def agree(cells: DataFrame, *, sharp: float = 80, smooth: float = 8, buffer: int = 4) -> DataFrame:
    """cells with z lowered towards drainage: within `buffer` cells (Euclidean, in the same label) by
    smooth * (distance - buffer), on drainage by sharp too."""
    check_agree(sharp, smooth, buffer)
    check_drainage(cells)
    reach = range(-buffer, buffer + 1)
    near = [(r, c, math.hypot(r, c)) for r in reach for c in reach if math.hypot(r, c) <= buffer]
    marks = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(d)).alias("d")) for r, c, d in near))).alias("o")
    reached = cells.where("is_drain").select("row", "col", "label", marks).select((F.col("row") + F.col("o.r")).alias("row"),
        (F.col("col") + F.col("o.c")).alias("col"), "label", F.col("o.d").alias("d"))
    least = reached.groupBy("row", "col", "label").agg(F.min("d").alias("d"))
    z = F.col("z") + F.when(F.col("d").isNotNull() & valid(),
        F.lit(float(smooth)) * (F.col("d") - buffer)).otherwise(F.lit(0.0)) - F.when(F.col("is_drain"), F.lit(float(sharp))).otherwise(F.lit(0.0))
    return cells.join(least, ["row", "col", "label"], "left").withColumn("z", z).select(*cells.columns)


def around(cells: DataFrame, value: str) -> DataFrame:
    """cells with data, and as _1 to _8 the least `value` of the neighbours of the same label in each direction, or null."""
    at = lambda c: F.floor(F.col(c) / TILE)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / TILE), F.floor((F.col(c) + 1) / TILE)))
    held = cells.where(valid() & (F.col("label") >= 0))
    dealt = held.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col"))
    place = (F.col("row") - F.col("_tr") * TILE) * (TILE + 4) + F.col("col") - F.col("_tc") * TILE
    tile = Window.partitionBy("label", "_tr", "_tc").orderBy("_at")
    there = [r * (TILE + 4) + c for r, c in OFFSETS]
    seen = dealt.withColumn("_at", place.cast("long")).select("*", *(F.min(value).over(tile.rangeBetween(k, k)).alias(f"_{n}") for n, k in enumerate(there, 1)))
    return seen.where((F.col("_tr") == at("row")) & (F.col("_tc") == at("col"))).drop("_tr", "_tc", "_at")


def natural_d8(cells: DataFrame, width: float, height: float) -> DataFrame:
    """row, col, label, z, code: the steepest strictly lower neighbour, of equal slopes the first by row and column; 0 for
    drainage; null where no neighbour is lower."""
    steps = step_lengths(width, height)
    down = [F.when(F.col(f"_{k}") < F.col("z"), (F.col("z") - F.col(f"_{k}")) / F.lit(steps[k - 1])) for k in range(1, 9)]
    slopes = around(cells.select("row", "col", "label", "z", "is_drain"), "z").select("row", "col", "label", "z", "is_drain",
        *(d.alias(f"_s{k}") for k, d in enumerate(down, 1))).withColumn("_most", F.greatest(*(F.col(f"_s{k}") for k in range(1, 9))))
    first = sorted(range(1, 9), key=lambda k: OFFSETS[k - 1])
    code = F.coalesce(*(F.when(F.col(f"_s{k}") == F.col("_most"), F.lit(k)) for k in first))
    return slopes.select("row", "col", "label", "z", F.when(F.col("is_drain"), 0).otherwise(code).cast("int").alias("code"))


def cell_id(row: Column | str, col: Column | str) -> Column:
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return F.shiftleft(row.cast("long"), 32) + col.cast("long")


def pointers(directed: DataFrame, width: float, height: float) -> DataFrame:
    """id, p, hops, dist of cells with row, col, code; raises where a direction leaves the cells or has no such code."""
    steps = step_lengths(width, height)
    if not directed.where("code not between -1 and 8").isEmpty():
        raise TerrainProductsError("a direction has an unknown code")
    held = directed.where("code >= 0")
    move = lambda k: F.element_at(F.array(*(F.lit(o[k]) for o in OFFSETS)), F.col("code"))
    flows = F.col("code") > 0
    rows = held.select(
        cell_id("row", "col").alias("id"),
        F.when(flows, cell_id(F.col("row") + move(0), F.col("col") + move(1))).alias("p"),
        F.when(flows, 1).otherwise(0).alias("hops"),
        F.when(flows, F.element_at(F.array(*map(F.lit, steps)), F.when(flows, F.col("code")).otherwise(1))).otherwise(0.0).alias("dist"),
    )
    if not rows.where("p is not null").join(rows.select(F.col("id").alias("_id")).hint("merge"), F.col("p") == F.col("_id"), "left_anti").isEmpty():
        raise TerrainProductsError("a direction leaves the raster or enters cells without data")
    return rows


def routes(directed: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """row, col, rank (hops to the terminal), length (metric way to it), trow, tcol (the terminal)."""
    return _routes(pointers(stored(directed.select("row", "col", "code")), width, height))


def _routes(steps: DataFrame) -> DataFrame:
    start = steps.withColumn("terminal", F.coalesce("p", "id"))
    try:
        told = path_fold(start, {"hops": lambda a, b: a + b, "dist": lambda a, b: a + b, "terminal": lambda a, b: b})
    except TopologyCycleError:
        raise TerrainProductsError("flow directions form a cycle") from None
    row, col = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return told.select(row("id").alias("row"), col("id").alias("col"), F.col("hops").alias("rank"), F.col("dist").alias("length"),
        row("terminal").alias("trow"), col("terminal").alias("tcol"))


def hand(cells: DataFrame, routed: DataFrame) -> DataFrame:
    """row, col, hand: z above the terminal's, signed."""
    z = cells.select("row", "col", "z")
    ends = cells.select(F.col("row").alias("trow"), F.col("col").alias("tcol"), F.col("z").alias("tz"))
    return routed.join(z.hint("merge"), ["row", "col"]).join(ends.hint("merge"), ["trow", "tcol"]).select("row", "col", (F.col("z") - F.col("tz")).alias("hand"))


def ltnd(routed: DataFrame) -> DataFrame:
    """row, col, ltnd: the metric way to the terminal."""
    return routed.select("row", "col", F.col("length").alias("ltnd"))


def basins(routed: DataFrame) -> DataFrame:
    """row, col, basin: terminals numbered from 0 by the first of their cells in row-major order."""
    first = routed.groupBy("trow", "tcol").agg(F.min(F.struct("row", "col")).alias("first"))
    return routed.join(numbered(first, ["first"], "basin").hint("merge"), ["trow", "tcol"]).select("row", "col", "basin")


def corridor_costs(directed: DataFrame, width: float, height: float) -> DataFrame:
    """row, col, cut_max, cut_sum, length from the terminal to the cell; depth is z above the terminal's, at least 0.
    directed: row, col, z, code."""
    directed = stored(directed.select("row", "col", "z", "code"))
    steps = pointers(directed, width, height)
    return _costs(directed, steps, _routes(steps))


def _costs(directed: DataFrame, steps: DataFrame, way: DataFrame) -> DataFrame:
    above = hand(directed, way).select(cell_id("row", "col").alias("id"), F.greatest("hand", F.lit(0.0)).alias("cut_max"))
    start = steps.select("id", "p").join(above.hint("merge"), "id").withColumn("cut_sum", F.col("cut_max"))
    folded = path_fold(start, {"cut_max": F.greatest, "cut_sum": lambda a, b: a + b})
    return way.select(cell_id("row", "col").alias("id"), "row", "col", "length").join(folded.hint("merge"), "id").select("row", "col", "cut_max", "cut_sum", "length")


def basin_edges(directed: DataFrame, width: float, height: float) -> DataFrame:
    """source, target (basins), cut_max, cut_sum, length, orow, ocol, drow, dcol: between adjacent basins of a label, the
    crossing of least (cut_max, cut_sum, length with the step, origin cell), of equal ones the first in the order of SCAN."""
    directed = stored(directed.select("row", "col", "label", "z", "code"))
    steps = pointers(directed, width, height)
    way = stored(_routes(steps))
    facts = _costs(directed, steps, way).join(basins(way).hint("merge"), ["row", "col"])
    near = around(directed.drop("code").join(facts.hint("merge"), ["row", "col"]), "basin")
    lengths = step_lengths(width, height)
    crossing = F.explode(F.array(*(F.struct(F.col(f"_{k}").alias("target"), F.lit(k).alias("code"), F.lit(lengths[k - 1]).alias("dist"),
        (F.col("row") + r).alias("drow"), (F.col("col") + c).alias("dcol")) for k, (r, c) in enumerate(OFFSETS, 1)))).alias("o")
    one = near.where(" or ".join(f"_{k} <> basin" for k in range(1, 9))).select("row", "col", "basin", "cut_max", "cut_sum", "length", crossing).where("o.target <> basin")
    cost = F.struct("cut_max", "cut_sum", (F.col("length") + F.col("o.dist")).alias("length"), F.col("row").alias("orow"),
        F.col("col").alias("ocol"), F.array_position(F.array(*map(F.lit, SCAN)), F.col("o.code")).alias("met"), F.col("o.drow"), F.col("o.dcol"))
    return one.groupBy(F.col("basin").alias("source"), F.col("o.target").alias("target")).agg(F.min(cost).alias("c")).select("source", "target", "c.*").drop("met")


def rank_report(cells: DataFrame, hands: DataFrame) -> DataFrame:
    """One row: owned_cells, drainage_cells, unreachable_components (always 0), and negative HAND's count, least, greatest."""
    owned = cells.agg(F.count_if(F.col("label") >= 0).alias("owned_cells"), F.count_if("is_drain").alias("drainage_cells"), F.lit(0).cast("long").alias("unreachable_components"))
    below = F.when(F.col("hand") < 0, F.col("hand"))
    negative = hands.agg(F.count(below).alias("negative_hand_cells"), F.min(below).alias("negative_hand_min"), F.max(below).alias("negative_hand_max"))
    return owned.withColumn("k", F.lit(1)).join(F.broadcast(negative.withColumn("k", F.lit(1))), "k").drop("k")
