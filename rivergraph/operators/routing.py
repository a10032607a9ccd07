"""Flow directions to drainage, one catchment label at a time.

Labels never exchange flow, so the whole routing is `groupBy("label").applyInPandas`. Inside, a label's cells become a
padded array; steepest descent, basin costs and boundaries are array operations, and only flats and the search over
basins visit cells and basins one by one.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivergraph.errors import TerrainProductsError
from rivergraph.functions.scratch import stored

from .cells import OFFSETS, SCAN, check_drainage, opposite, step_lengths, valid


class Grid:
    """Cells of one label in an array with a margin of one; flat positions keep row-major order."""

    def __init__(self, row: np.ndarray, col: np.ndarray, z: np.ndarray, drain: np.ndarray, width: float, height: float):
        r0, c0 = row.min() - 1, col.min() - 1
        self.cols = int(col.max() - c0 + 2)
        self.at = (row - r0) * self.cols + (col - c0)
        size = int(row.max() - r0 + 2) * self.cols
        self.z = np.full(size, np.nan)
        self.z[self.at] = z
        self.inside = np.zeros(size, bool)
        self.inside[self.at] = True
        self.drain = np.zeros(size, bool)
        self.drain[self.at] = drain
        self.jump = np.array([0, *(dr * self.cols + dc for dr, dc in OFFSETS)])
        self.steps = np.array([0.0, *step_lengths(width, height)])
        self.cells = np.sort(self.at)

    def descend(self) -> np.ndarray:
        """Codes of steepest descent; -1 outside and where nothing is lower."""
        code = np.full(self.z.size, -1, np.int8)
        best = np.zeros(len(self.cells))
        chosen = np.full(len(self.cells), -1, np.int8)
        for k in np.argsort(self.jump[1:]) + 1:  # by position, so that a later neighbour must be strictly steeper
            there = self.cells + self.jump[k]
            with np.errstate(invalid="ignore"):
                slope = np.where(self.inside[there], (self.z[self.cells] - self.z[there]) / self.steps[k], 0.0)
            better = slope > best
            best[better], chosen[better] = slope[better], k
        code[self.cells] = chosen
        code[self.drain] = 0
        return code

    def settle_flats(self, code: np.ndarray) -> None:
        """Route the cells of flats. A flat drains breadth first to its outlets at the lowest level, and what those don't
        reach to any of its routed cells; a closed flat ends in its first cell."""
        seen = np.zeros(code.size, bool)
        for start in self.cells[code[self.cells] < 0].tolist():
            if seen[start]:
                continue
            level, flat, seen[start] = self.z[start], [start], True
            for i in flat:  # grows while it is read
                for j in (i + self.jump[1:]).tolist():
                    if not seen[j] and self.inside[j] and self.z[j] == level:
                        seen[j] = True
                        flat.append(j)
            members = set(flat)
            falls = {i: float(self.z[i + self.jump[code[i]]]) for i in flat if code[i] >= 0}
            lowest = min(falls.values(), default=None)
            seeds = [i for i, to in falls.items() if code[i] == 0 or to == lowest]
            if not seeds:
                code[start], seeds = 0, [start]
            self._spread(code, seeds, members)
            self._spread(code, [i for i in flat if code[i] >= 0], members)

    def _spread(self, code: np.ndarray, seeds: list[int], members: set[int]) -> None:
        line = deque(seeds)
        while line:
            i = line.popleft()
            for k in range(1, 9):
                j = i + int(self.jump[k])
                if code[j] < 0 and j in members:
                    code[j] = opposite(k)
                    line.append(j)

    def ends(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terminal and rank of each of self.cells, by doubling."""
        ahead = np.arange(code.size)
        ahead[self.cells] = self.cells + self.jump[code[self.cells]]
        hops = np.zeros(code.size, np.int64)
        hops[self.cells] = code[self.cells] > 0
        for _ in range(max(1, int(code.size).bit_length() + 1)):
            far = ahead[ahead]
            if (far == ahead).all():
                return ahead[self.cells], hops[self.cells]
            hops = hops + hops[ahead]
            ahead = far
        raise TerrainProductsError("flow directions form a cycle")


def _costs(g: Grid, code: np.ndarray, terminal: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """cut_max, cut_sum, length from the terminal, rank by rank."""
    out = np.zeros((3, code.size))
    depth = np.maximum(g.z[g.cells] - g.z[terminal], 0.0)
    order = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[order], np.arange(1, (rank.max() if len(rank) else 0) + 2))
    for a, b in zip(bounds, bounds[1:], strict=False):
        which = order[a:b]
        at = g.cells[which]
        up = at + g.jump[code[at]]
        out[0, at] = np.maximum(out[0, up], depth[which])
        out[1, at] = out[1, up] + depth[which]
        out[2, at] = out[2, up] + g.steps[code[at]]
    return out


def _boundaries(g: Grid, basin: np.ndarray, costs: np.ndarray) -> dict[int, list[tuple]]:
    """Target basin -> (cut_max, cut_sum, length, origin, destination, source), the best crossing of each ordered pair."""
    rows = []
    for k in SCAN:
        there = g.cells + g.jump[k]
        cross = g.inside[there] & (basin[there] != basin[g.cells])
        a, b = g.cells[cross], there[cross]
        rows.append((basin[a], basin[b], costs[0, a], costs[1, a], costs[2, a] + g.steps[k], a, b))
    source, target, cut, total, length, origin, to = (np.concatenate(x) for x in zip(*rows, strict=True))
    # of crossings from one origin into one basin, the shorter step wins; of equal ones the first in the order of SCAN
    order = np.lexsort((np.arange(len(to)), origin, length, total, cut, target, source))
    source, target = source[order], target[order]
    first = np.ones(len(order), bool)
    first[1:] = (source[1:] != source[:-1]) | (target[1:] != target[:-1])
    into: dict[int, list[tuple]] = {}
    for s, t, i in zip(source[first].tolist(), target[first].tolist(), order[first].tolist(), strict=True):
        into.setdefault(t, []).append((float(cut[i]), float(total[i]), float(length[i]), int(origin[i]), int(to[i]), s))
    return into


def _outflows(count: int, streams: list[int], into: dict[int, list[tuple]]) -> dict[int, tuple[int, int]]:
    """Basin -> (origin, destination) of the crossing it leaves by. A way's cost is (greatest cut, sum of cuts, length,
    origin and next basin of its first crossing); basins are settled in the order of cost."""
    best: dict[int, tuple] = {s: (0.0, 0.0, 0.0, -1, -1) for s in streams}
    leave: dict[int, tuple[int, int]] = {}
    heap = [(c, b) for b, c in best.items()]
    heapq.heapify(heap)
    settled = np.zeros(count, bool)
    while heap:
        cost, b = heapq.heappop(heap)
        if settled[b]:
            continue
        settled[b] = True
        for cut, total, length, origin, to, source in into.get(b, ()):
            if settled[source]:
                continue
            offer = (max(cut, cost[0]), total + cost[1], length + cost[2], origin, b)
            if source not in best or offer < best[source]:
                best[source], leave[source] = offer, (origin, to)
                heapq.heappush(heap, (offer, source))
    return leave


def route(row, col, z, drain, width: float, height: float) -> tuple[np.ndarray, np.ndarray, int]:
    """code and rank of each cell of a label, and how many cells no way connects to drainage (then codes don't count)."""
    g = Grid(np.asarray(row, np.int64), np.asarray(col, np.int64), np.asarray(z, float), np.asarray(drain, bool), width, height)
    code = g.descend()
    g.settle_flats(code)
    terminal, rank = g.ends(code)
    firsts, first_at, of_cell = np.unique(terminal, return_index=True, return_inverse=True)
    number = np.argsort(np.argsort(first_at))  # in the order in which cells, row by row, meet the terminals
    basin = np.full(code.size, -1)
    basin[g.cells] = number[of_cell]
    streams = np.unique(basin[g.drain & g.inside]).tolist()
    leave = _outflows(len(firsts), streams, _boundaries(g, basin, _costs(g, code, terminal, rank)))
    connected = np.zeros(len(firsts), bool)
    connected[streams] = True
    connected[list(leave)] = True
    lost = int((~connected[basin[g.cells]]).sum())
    if not lost:
        natural = code.copy()
        turn = {int(j): k for k, j in enumerate(g.jump) if k}
        for at, to in leave.values():
            while True:  # from the crossing back to the old terminal, each cell now flows to the one before
                ahead, now = natural[at], at
                code[now] = turn[to - now]
                if ahead == 0:
                    break
                to, at = now, now + int(g.jump[ahead])
        _, rank = g.ends(code)
    back = np.searchsorted(g.cells, g.at)
    return code[g.at], rank[back], lost


def flow_directions(cells: DataFrame, width: float, height: float) -> DataFrame:
    """row, col, code, rank of every cell with a label and data. Raises if cells cannot reach drainage of their label."""
    check_drainage(cells)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        code, rank, lost = route(pdf["row"], pdf["col"], pdf["z"], pdf["is_drain"], width, height)
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "col": pdf["col"].to_numpy(), "code": code.astype("int32"),
            "rank": rank.astype("int32"), "lost": np.full(len(pdf), lost, "int64"), "label": pdf["label"].to_numpy()})

    held = cells.where(valid() & (F.col("label") >= 0)).select("row", "col", F.col("label").cast("int"), F.col("z").cast("double"),
        F.coalesce("is_drain", F.lit(False)).alias("is_drain"))
    out = stored(held.groupBy("label").applyInPandas(one, "row int, col int, code int, rank int, lost long, label int"))
    lost = out.groupBy("label").agg(F.max("lost").alias("lost")).agg(F.sum("lost")).first()[0]
    if lost:
        raise TerrainProductsError(f"{lost} owned cells in trapped basin(s) cannot connect to matching drainage")
    return out.select("row", "col", "code", "rank")
