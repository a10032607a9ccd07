"""Networks, layers and grids derived from the given tables by integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 3.0, 4.0  # a diagonal of exactly 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def net_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, id_down, length, area: a tree over orders."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("length"))
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("k")).agg(F.count("*").alias("area"))
    down = F.expr("case when id > 0 then ((id * 1103515245 + 12345) % 2147483648) div 1024 % id end")
    return orders.join(lines, F.col("id") == F.col("k"), "left").select("id", down.alias("id_down"), "length", F.coalesce("area", F.lit(0)).alias("area"))


NET_TREE = """t as (select o_orderkey::bigint id, case when o_orderkey > 0 then ((o_orderkey::bigint * 1103515245 + 12345) % 2147483648) // 1024 % greatest(o_orderkey::bigint, 1) end id_down,
  round(o_totalprice * 100)::bigint length, coalesce(n, 0)::bigint area from orders left join (select l_orderkey k, count(*) n from lineitem group by 1) on k = o_orderkey)"""


def net_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, id_down, length: one chain over part."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("length"))
    return part.select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("id_down"), "length")


def dem(spark: SparkSession, sf_dir: str, flats: bool = False) -> DataFrame:
    """row, col, label, z, is_drain: a grid of 50 columns over events; with flats, z in steps of 8."""
    z = F.col("value").cast("double")
    e = _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("e"), (F.floor(z / 8).cast("double") if flats else z).alias("z"))
    row, col = F.expr("cast(e div 50 as int)"), F.expr("cast(e % 50 as int)")
    return e.select(row.alias("row"), col.alias("col"), F.expr("cast(e div 500 as int)").alias("label"), "z", F.expr("e div 50 % 10 = 0").alias("is_drain"))


DEM = "c as (select (event_id // 50)::int r, (event_id % 50)::int k, (event_id // 500)::int l, value::double z, event_id // 50 % 10 = 0 d from events)"


def _shapes(shape):
    """A function of three columns, a batch at a time."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        head, points = shape(*(x.to_numpy(float) for x in (a, b, c)))
        raw, size = points.astype("<f8").tobytes(), 8 * points.shape[1]
        return pd.Series([head + raw[k : k + size] for k in range(0, len(raw), size)], dtype=object)

    return run


def _rectangle(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """What every rectangle's WKB begins with, and the points of each in a row."""
    none = np.zeros(len(x))
    return struct.pack("<BIII", 1, 3, 1, 5), np.column_stack([x, none, x + w, none, x + w, h, x, h, x, none])


def _line(x: np.ndarray, to: np.ndarray, y: np.ndarray) -> tuple[bytes, np.ndarray]:
    return struct.pack("<BII", 1, 2, 2), np.column_stack([x, y, to, y])


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("w"))
    return part.withColumn("h", F.expr("w % 7 + 1"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, w, h, geometry: rectangles from p_size, side by side."""
    return _sizes(spark, sf_dir).select("id", "w", "h", _shapes(_rectangle)(F.col("id") * 100.0, F.col("w").cast("double"), F.col("h").cast("double")).alias("geometry"))


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry: the same rectangles, so close that wide ones overlap the next."""
    return _sizes(spark, sf_dir).select("id", _shapes(_rectangle)(F.col("id") * 20.0, F.col("w").cast("double"), F.col("h").cast("double")).alias("geometry"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry: a line through w cells of size 1 in a row."""
    return _sizes(spark, sf_dir).select("id", _shapes(_line)(F.col("id") * 100 + 0.5, F.col("id") * 100 + F.col("w") - 0.5, F.lit(0.5)).alias("geometry"))


def net_layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catchments and segments of the tree: rectangles of `area` square kilometres, lines of `length` kilometres."""
    t = net_tree(spark, sf_dir)
    catchments = t.select("id", _shapes(_rectangle)(F.lit(0.0), F.col("area") * 1000.0, F.lit(1000.0)).alias("geometry"))
    return catchments, t.select("id", "id_down", F.lit(1).alias("strahler_order"), _shapes(_line)(F.lit(0.0), F.col("length") * 1000.0, F.lit(0.0)).alias("geometry"))
