"""Pointer doubling: recursive questions about a forest in a logarithm of rounds.

A table of nodes has id, p (the node 2**k steps downstream, null past a root) and value columns. A round joins the nodes
whose way has not ended with the nodes they point to, and writes those alone to the shared scratch folder: a node whose way
has ended is written once. So plans don't grow, a lost executor costs one round, and rounds shrink as ways end.

Tips, the nodes that nothing points to, take no part in the rounds: a path's fold reaches them at the end, from the node
they point to, and a subtree's fold begins with what they tell. In most forests they are the greater part.

Joins here name their method: sizes of files say little about rows (a chain of ids packs into next to nothing), and what
is taken for small on their word would be collected by the driver whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivergraph.errors import TopologyCycleError
from rivergraph.functions.scratch import stored


def _open(nodes: DataFrame) -> DataFrame:
    return nodes.where("p is not null")


class _Rounds:
    """Counts rounds, and tells when there were more than a forest of these nodes can need."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.done, self.most = nodes, 0, 8

    def over(self) -> bool:
        self.done += 1
        if self.done == 8:  # most forests end sooner and are never counted
            self.most = math.ceil(math.log2(max(2, self.nodes.count()))) + 1
        return self.done > max(8, self.most)


def _merged(left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _inner_and_tips(nodes: DataFrame, told: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes that others point to, and those that none does. told: _to, once each, and what it brings."""
    marked = stored(_merged(nodes, told, F.col("id") == F.col("_to"), "left").select("id", "p", *names, F.col("_to").isNotNull().alias("inner")))
    return marked.where("inner").drop("inner"), marked.where("not inner").drop("inner")


def path_fold(nodes: DataFrame, combine: dict[str, Callable[[Column, Column], Column]], cycles: bool = False) -> DataFrame:
    """Each value becomes the fold of the values from its node down to the root. With `cycles`, nodes whose way never ends
    are not an error but keep their p (the fold must then bear repeats). combine: value column -> how a value and
    the one that continues it further down make one. id, p and the values only."""
    names = list(combine)

    def followed(some: DataFrame, every: DataFrame) -> DataFrame:
        ahead = every.select(F.col("id").alias("_id"), F.col("p").alias("_p"), *(F.col(n).alias(f"_{n}") for n in names))
        return _merged(some, ahead, F.col("p") == F.col("_id"), "left").select("id", F.col("_p").alias("p"),
            *(F.when(F.col("_id").isNull(), F.col(n)).otherwise(combine[n](F.col(n), F.col(f"_{n}"))).alias(n) for n in names))

    first = stored(nodes.select("id", "p", *names))
    now, tips = _inner_and_tips(first, _open(first).select(F.col("p").alias("_to")).distinct(), names)
    ended, rounds = [now.where("p is null")], _Rounds(now)
    while not _open(now).isEmpty():
        if rounds.over():
            if not cycles:
                raise TopologyCycleError("the network has a cycle")
            ended.append(_open(now))
            break
        now = stored(followed(_open(now), _all([_open(now), *ended])))
        ended.append(now.where("p is null"))
    out = _all([*ended, tips.where("p is null"), stored(followed(_open(tips), _all(ended)))])
    return out if cycles else out.drop("p")


def subtree_fold(nodes: DataFrame, gather: dict[str, Callable[[Column], Column]], combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Each value becomes the fold over its node and everything upstream. gather: the aggregate over children's values,
    which takes them in any order and in parts."""
    names = list(combine)

    def told_by(some: DataFrame, to: str) -> DataFrame:
        return some.groupBy(F.col(to).alias("_to")).agg(*(gather[n](F.col(n)).alias(f"_{n}") for n in names))

    def folded() -> list[Column]:
        return [F.when(F.col("_to").isNull(), F.col(n)).otherwise(combine[n](F.col(n), F.col(f"_{n}"))).alias(n) for n in names]

    first = stored(nodes.select("id", "p", *names))
    inner, tips = _inner_and_tips(first, _open(first).select(F.col("p").alias("_to")).distinct(), names)
    now = stored(_merged(inner, told_by(_open(tips), "p"), F.col("id") == F.col("_to"), "left").select("id", "p", *folded(), F.lit(False).alias("late")))
    ended, late, rounds = [now.where("p is null")], [], _Rounds(now)
    while not _open(now).isEmpty():
        if rounds.over():
            raise TopologyCycleError("the network has a cycle")
        told = told_by(_open(now), "p")
        jump = _open(now).select(F.col("id").alias("_id"), F.col("p").alias("_p"))
        # what is told of nodes whose way has ended is written beside the others, and counts at the end
        joined = _merged(_merged(_open(now), told, F.col("id") == F.col("_to"), "full"), jump, F.col("p") == F.col("_id"), "left")
        gone = F.col("id").isNull()
        values = [F.when(gone, F.col(f"_{n}")).otherwise(v).alias(n) for n, v in zip(names, folded(), strict=True)]
        now = stored(joined.select(F.coalesce("id", "_to").alias("id"), F.col("_p").alias("p"), *values, gone.alias("late")))
        ended.append(now.where("p is null and not late"))
        late.append(now.where("late"))
    out = _all(ended)
    if late:
        out = _merged(out, told_by(_all(late), "id"), F.col("id") == F.col("_to"), "left").select("id", *folded())
    return stored(out.select("id", *names)).unionByName(tips.select("id", *names))


def upstream_sums(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Sums over a node and everything upstream of it."""
    return subtree_fold(nodes, {n: F.sum for n in names}, {n: lambda a, b: a + F.coalesce(b, F.lit(0)) for n in names})


def roots(nodes: DataFrame) -> DataFrame:
    """id, root: the last node downstream."""
    last = nodes.select("id", "p", F.coalesce("p", "id").alias("root"))
    return path_fold(last, {"root": lambda a, b: b})
