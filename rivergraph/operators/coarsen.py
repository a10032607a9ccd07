"""Mini-basins: segments of one main stem merged until each group is long enough, with what is left assigned to them.

Merging never leaves a (sub, water_course), so each is a group of its own: a pandas function merges them, many at a time,
exactly. All else is joins and pointer doubling.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType

from rivergraph.errors import DuplicateSegmentIdError, InvalidInputSchemaError
from rivergraph.functions import geom
from rivergraph.functions.scratch import stored

from .doubling import path_fold, subtree_fold
from .roi import LAYER
from .topology import check_acyclic, duplicate_ids, network

NUMERIC = ("strahler_order", "unit_length", "upstream_length", "unit_area", "upstream_area", "sub")


class Minis(NamedTuple):
    catchments: DataFrame
    segments: DataFrame
    mapping: DataFrame


def check_layer(df: DataFrame, what: str) -> None:
    if not isinstance(df, DataFrame):
        raise InvalidInputSchemaError(f"{what}: a DataFrame is needed")
    if tuple(df.columns) != LAYER:
        raise InvalidInputSchemaError(f"{what}: columns must be {', '.join(LAYER)}; found {', '.join(df.columns)}")
    if bad := [n for n in NUMERIC if not isinstance(df.schema[n].dataType, NumericType)]:
        raise InvalidInputSchemaError(f"{what}: not numeric: {', '.join(bad)}")
    if not isinstance(df.schema["geometry"].dataType, BinaryType):
        raise InvalidInputSchemaError(f"{what}: geometry must be WKB")


def _added(parts: list[float], x: float) -> list[float]:
    """parts, whose exact sum stands for many numbers, with one more: no digit is lost, and there are few parts."""
    out = []
    for y in parts:
        high = x + y
        if not math.isfinite(high):
            out.append(y)
            continue
        if abs(x) < abs(y):
            x, y = y, x
        if low := y - (high - x):
            out.append(low)
        x = high
    return [*out, x]


def merge_short(ids: list, downs: list, lengths: list[float], least: float) -> dict:
    """id -> group label for one domain. While a group shorter than `least` has a neighbour, the first such group by label
    as text joins its neighbour of least (length, label as text) and takes its label."""
    total = dict(zip(ids, lengths, strict=True))
    exact = {i: [x] for i, x in total.items()}
    beside: dict = {i: set() for i in ids}
    for i, d in zip(ids, downs, strict=True):
        if d in beside and d != i:
            beside[i].add(d)
            beside[d].add(i)
    short = [(str(i), i) for i in ids if total[i] < least and beside[i]]
    heapq.heapify(short)
    into: dict = {}
    while short:
        _, g = heapq.heappop(short)
        if g in into or not beside[g] or not total[g] < least:
            continue
        to = min(beside[g], key=lambda t: (total[t], str(t)))
        into[g] = to
        for x in exact.pop(g):
            exact[to] = _added(exact[to], x)
        total[to] = math.fsum(exact[to])
        for other in beside.pop(g):
            beside[other].discard(g)
            if other != to:
                beside[other].add(to)
                beside[to].add(other)
        if total[to] < least and beside[to]:
            heapq.heappush(short, (str(to), to))
    # a group that was joined went into one that lasted longer: from the last joining back, every way has one step
    for g in reversed(into):
        into[g] = into.get(into[g], into[g])
    return {i: into.get(i, i) for i in ids}


def _domains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of `batches` in pieces of whole domains; a domain begins where `head` is true."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if len(starts := np.flatnonzero(pdf["head"].to_numpy())):
            held.append(pdf.iloc[: starts[-1]])
            if len(whole := pd.concat(held)):
                yield whole
            held = [pdf.iloc[starts[-1] :]]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held)


def merged_groups(eligible: DataFrame, least: float) -> DataFrame:
    """eligible: id, p (eligible, or null), sub, water_course, unit_length. id, mini_id. Many domains go to Python at once:
    there may be as many as segments, and most are of one segment or have no short one."""

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _domains(batches):
            ids, downs, lengths = pdf["id"].tolist(), pdf["p"].tolist(), pdf["unit_length"].to_numpy(float, na_value=math.nan)
            starts = np.flatnonzero(pdf["head"].to_numpy())
            sizes = np.diff(starts, append=len(pdf))
            labels = list(ids)
            for k in np.flatnonzero((sizes > 1) & np.logical_or.reduceat(lengths < least, starts)):
                at = slice(starts[k], starts[k] + sizes[k])
                groups = merge_short(ids[at], downs[at], lengths[at].tolist(), least)
                labels[at] = [groups[i] for i in ids[at]]
            yield pd.DataFrame({"id": pdf["id"], "mini_id": pd.Series(labels, index=pdf.index, dtype=pdf["id"].dtype)})

    kind = eligible.schema["id"].dataType.simpleString()
    head = F.row_number().over(Window.partitionBy("sub", "water_course").orderBy("id")) == 1
    # a pandas column of longs with nulls would turn into floats
    asked = eligible.withColumn("head", head).select("id", F.coalesce("p", "id").alias("p"), "unit_length", "head")
    return asked.mapInPandas(many, f"id {kind}, mini_id {kind}")


def group_lengths(assigned: DataFrame, segments: DataFrame) -> DataFrame:
    """mini_id, length, summed in the order of ids."""
    per = assigned.join(segments.select("id", "unit_length"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("id", "unit_length")))
    return per.groupBy("mini_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["unit_length"].cast("double")).alias("length"))


def assign_nearest(wanted: DataFrame, nodes: DataFrame, assigned: DataFrame, lengths: DataFrame) -> DataFrame:
    """id, mini_id for the ids in wanted: of the first assigned segments downstream and upstream in the same (sub,
    water_course), passing through unassigned ones, the group of least (length, label as text); else in the same sub.
    nodes: id, p, sub, water_course."""
    group = F.struct("length", F.col("mini_id").cast("string").alias("label"), "mini_id").alias("g")
    tagged = stored(nodes.join(assigned.join(lengths.hint("merge"), "mini_id").select("id", group).hint("merge"), "id", "left"))
    found = None
    for same in (("sub", "water_course"), ("sub",)):
        down = tagged.select(F.col("id").alias("_id"), F.col("g").alias("_g"), *(F.col(c).alias(f"_{c}") for c in same))
        alike: Column = F.lit(True)
        for c in same:
            alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
        linked = stored(tagged.join(down.hint("merge"), (F.col("p") == F.col("_id")) & alike, "left").select("id", "g", F.col("_id").alias("d"), F.col("_g").alias("dg")))
        # downstream: what an unassigned segment meets next, or what the next one meets
        below = path_fold(linked.where("g is null").select("id", F.when(F.col("dg").isNull(), F.col("d")).alias("p"), F.col("dg").alias("met")), {"met": F.coalesce})
        # upstream: the least of the assigned children, and of what unassigned children have met
        seed = linked.where("g is not null and d is not null and dg is null").groupBy("d").agg(F.min("g").alias("met"))
        open_ = linked.where("g is null").select("id", F.when(F.col("dg").isNull(), F.col("d")).alias("p")).join(seed.withColumnRenamed("d", "id").hint("merge"), "id", "left")
        above = subtree_fold(open_, {"met": F.min}, {"met": F.least})
        best = below.join(above.withColumnRenamed("met", "up").hint("merge"), "id").select("id",
            F.least("met", "up").alias("best")).where("best is not null").select("id", F.col("best.mini_id").alias("m"))
        found = best.withColumnRenamed("m", "m1") if found is None else found.join(best.hint("merge"), "id", "full").select("id", F.coalesce("m1", "m").alias("mini_id"))
    return wanted.select("id").join(found.hint("merge"), "id")


def split_eligible(segments: DataFrame, uparea_min: float) -> DataFrame:
    """eligible flag; NaN areas are neither and go with the excluded."""
    area = F.col("upstream_area").cast("double")
    return segments.withColumn("eligible", F.coalesce((area >= uparea_min) & ~F.isnan(area), F.lit(False)))


def downstream_group(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """id, mini_down: from each assigned segment along p, past its own group and unassigned segments, the first other
    group. nodes: id, p."""
    tagged = stored(nodes.join(assigned.hint("merge"), "id", "left").select("id", "p", "mini_id"))
    down = tagged.select(F.col("id").alias("_id"), F.col("mini_id").alias("_m"))
    linked = tagged.join(down.hint("merge"), F.col("p") == F.col("_id"), "left").select("id", "p", "mini_id", "_m")
    # an unassigned segment passes on what it meets; groups are connected, so a path never comes back to its own
    other = F.col("_m").isNotNull() & (F.col("mini_id").isNull() | (F.col("_m") != F.col("mini_id")))
    state = linked.select("id", F.when(other, F.lit(None)).otherwise(F.col("p")).alias("p"), F.when(other, F.col("_m")).alias("mini_down"))
    return path_fold(state, {"mini_down": F.coalesce})


def representatives(eligible: DataFrame, assigned: DataFrame) -> DataFrame:
    """mini_id, rep: the member of greatest (upstream_area, unit_length, id as text), and sums over members."""
    order = F.struct("upstream_area", "unit_length", F.col("id").cast("string"))
    return eligible.join(assigned, "id").groupBy("mini_id").agg(F.max_by("id", order).alias("rep"),
        F.sum("unit_length").alias("unit_length"), F.sum("unit_area").alias("unit_area"))


def aggregate_minibasins(catchments: DataFrame, segments: DataFrame, *, uparea_min: float, lmin: float, with_labels: bool = False) -> Minis:
    """Output ids are the representatives', id_down and the mapping's mini_id are group labels; with_labels adds the
    group's own label as mini_label."""
    for df, what in ((segments, "segments"), (catchments, "catchments")):
        check_layer(df, what)
        if some := [str(r["id"]) for r in duplicate_ids(df).limit(20).collect()]:
            raise DuplicateSegmentIdError(f"{what}: duplicate ID(s): {', '.join(some)}")
    net = network(segments)
    check_acyclic(net)
    kind = net.schema["id"].dataType
    facts = stored(split_eligible(segments.drop("geometry"), uparea_min).withColumn("id", F.col("id").cast(kind)).drop("id_down").join(net, "id"))
    eligible = facts.where("eligible")
    inside = eligible.select(F.col("id").alias("_in"))
    eligible_net = stored(eligible.join(inside, F.col("p") == F.col("_in"), "left").withColumn("p", F.col("_in")).drop("_in"))
    groups = stored(merged_groups(eligible_net, lmin))
    lengths = stored(group_lengths(groups, eligible))
    alive = lengths.where(F.col("length") >= lmin)
    kept = stored(groups.join(alive.select("mini_id"), "mini_id").select("id", "mini_id"))
    nodes = facts.select("id", "p", "sub", "water_course")
    rest = facts.select("id").join(kept, "id", "left_anti")
    late = assign_nearest(rest, nodes, kept, alive)
    everyone = stored(kept.unionByName(late))
    cat = catchments.withColumn("_at", F.monotonically_increasing_id()).withColumn("id", F.col("id").cast(kind)).join(everyone, "id", "left")
    if some := [str(r[0]) for r in cat.where("mini_id is null").select("id").limit(20).collect()]:
        raise InvalidInputSchemaError(f"Catchment ID(s) have no eligible aggregation target in the same sub: {', '.join(some)}")
    reps = representatives(eligible, kept)
    next_group = downstream_group(eligible_net.select("id", "p"), kept)
    carried = eligible.select(F.col("id").alias("rep"), "sub", "strahler_order", "upstream_length", "upstream_area", "water_course")
    attrs = reps.join(carried, "rep").join(next_group.withColumnRenamed("id", "rep"), "rep")
    attrs = stored(attrs.select("mini_id", F.col("rep").alias("id"), F.col("mini_down").alias("id_down"), "sub", "strahler_order",
        "unit_length", "upstream_length", "unit_area", "upstream_area", "water_course"))
    columns = [*LAYER, *(["mini_label"] if with_labels else [])]
    seg_shape = geom.dissolve(segments.select(F.col("id").cast(kind).alias("id"), "geometry").join(kept, "id"), "mini_id")
    cat_shape = geom.dissolve(cat.select("mini_id", "geometry"), "mini_id")
    cat_area = cat.groupBy("mini_id").agg(F.sum("unit_area").alias("unit_area"))
    out_segments = attrs.join(seg_shape, "mini_id")
    out_catchments = attrs.drop("unit_area").join(cat_area, "mini_id").join(cat_shape, "mini_id")
    finish = lambda df: df.orderBy(F.col("mini_id").cast("string")).withColumn("mini_label", F.col("mini_id")).select(*columns)
    # the mapping keeps the order of the catchments, the layers that of the labels as text
    return Minis(finish(out_catchments), finish(out_segments), cat.orderBy("_at").select("id", "mini_id", "sub", "geometry"))
