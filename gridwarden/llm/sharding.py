"""Sharding along a Hilbert curve over several metadata dimensions."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.shared import cut

BITS = 6
SHARDS = 8
#: Relative error of the cuts' ranks is one in this.
ACCURACY = 10_000


def _is_string(df, name):
    return dict(df.dtypes)[name] == "string"


def _string_edges(df, name, parts):
    """The values (bytes) at the given parts of the column's order, from exact counts.

    A value with many rows is there several times, so that few values too are spread over all
    cells. Distinct values are counted and dealt to tasks by range; the edges alone reach the
    driver.
    """
    lots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(name).isNotNull()).groupBy(
        F.col(name).cast("binary").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counted.repartitionByRange(lots, "value").withColumn(
        "_lot", F.spark_partition_id()))
    before = Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_lot").agg(F.sum("n").alias("_rows")).select(
        "_lot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    up_to = Window.partitionBy("_lot").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    through = F.col("_start") + F.sum("n").over(up_to)
    ranks = F.array(*[F.ceil(F.lit(p) * F.col("_total")) for p in parts])
    found = dealt.join(F.broadcast(starts), "_lot").select(
        "value", "n", through.alias("through"), ranks.alias("ranks")).select(
        "value", F.size(F.filter("ranks", lambda r: (
            r > F.col("through") - F.col("n")) & (r <= F.col("through")))).alias("times"))
    return [value for value, times in sorted((bytes(r["value"]), r["times"]) for r in found.where(
        "times > 0").collect()) for _ in range(times)]


def hilbert_index(cells, bits):
    """Position on the Hilbert curve of integer points, one row of ``cells`` per dimension."""
    x = np.array(cells, dtype=np.int64)
    top = 1 << (bits - 1)
    step = top
    while step > 1:
        low = step - 1
        for i in range(len(x)):
            turned = (x[i] & step) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    step = top
    while step > 1:
        flip = np.where(x[-1] & step, flip ^ (step - 1), flip)
        step >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            index = (index << 1) | ((row >> bit) & 1)
    return index


def hilbert_shards(rows: DataFrame, dimensions, ties=(), shards=SHARDS, bits=BITS) -> DataFrame:
    """All columns of ``rows`` and hilbert, shard (0 on) and slot (gapless from 0 in a shard).

    Each dimension is cut at quantiles of its values over all rows into 2^bits cells (nulls
    come first; strings are compared whole, in the order of their bytes), rows are sorted by the
    cells' place on the curve, then by ``ties``, and runs of the order are the shards, whose
    counts differ by one at most. Each shard thus spans a compact range in every dimension and
    files of it can be skipped by any of them.

    Rows are dealt to tasks by range, equal ones by a number of their own, so neither a
    frequent value nor copies meet in one task. Equal rows stay equal but for their slots.
    Columns that are called hilbert, shard or slot are replaced; _own, _lot, _nth, _start,
    _total and _rank are reserved. No rows give no rows.
    """
    spark = rows.sparkSession
    cells = 1 << bits
    parts = [i / (cells - 1) for i in range(1, cells - 1)]
    numbers = [name for name in dimensions if not _is_string(rows, name)]
    quantiles = rows.agg(F.count(F.lit(1)), *[
        F.percentile_approx(F.col(name).cast("double"), parts, ACCURACY).alias(f"q{i}")
        for i, name in enumerate(numbers)]).first()[1:]
    edges = {name: np.unique(np.array(q if q is not None else [], dtype=float))
             for name, q in zip(numbers, quantiles)}

    def point(name):
        """The number to be cut at the column's edges, or a string's cell."""
        column = F.col(name)
        if name in edges:
            return column.cast("double")
        least = [F.lit(e) for e in _string_edges(rows, name, parts)]
        cell = F.size(F.filter(F.array(*least), lambda e: e <= column.cast("binary"))) \
            if least else F.lit(0)
        return F.when(column.isNotNull(), cell + 1).otherwise(0).cast("double")

    @F.pandas_udf("bigint")
    def place(points: pd.DataFrame) -> pd.Series:
        cell = [np.where(points[c].isna(), 0, 1 + np.searchsorted(
            edges[name], points[c].fillna(0).to_numpy(float), "right"))
            if name in edges else points[c].to_numpy(np.int64)
            for c, name in zip(points.columns, dimensions)]
        return pd.Series(hilbert_index(cell, bits))

    order = ["hilbert", *ties, "_own"]
    points = F.struct(*[point(name).alias(f"d{i}") for i, name in enumerate(dimensions)])
    placed = rows.withColumn("hilbert", place(points)).withColumn(
        "_own", F.monotonically_increasing_id())
    lots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(lots, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_lot", F.spark_partition_id()).withColumn(
        "_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("_own"))
    sizes = dealt.groupBy("_lot").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_lot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
                          F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    ranked = dealt.join(F.broadcast(starts), "_lot").withColumn(
        "_rank", F.col("_start") + F.col("_nth"))
    # shard s holds the ranks from ceil(s * total / shards) on
    shard = F.expr(f"(_rank * {shards}) div _total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn(
        "slot", F.col("_rank") - first).drop("_lot", "_nth", "_start", "_total", "_rank")


def write_shards(sharded: DataFrame, path, order=("slot",)) -> None:
    """A folder per shard with its rows in the order of their slots."""
    sharded.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order) \
        .write.partitionBy("shard").parquet(path)
