"""Order-dependent computations: islands, unions of intervals, carried headers, folds with budgets, global numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.session import written


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merged intervals of each key: a row opens an island where it begins after every earlier end."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = rows.select(key, start, end).withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("intervals")).drop("_island")


def islands(rows: DataFrame, key: list[str], order: list[Column], begins: Column, out: str = "island") -> DataFrame:
    """Runs of rows; ``begins`` marks the rows that open one (the first of a key always does)."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    x = rows.withColumn("_begin", begins).withColumn("_begin", (first | F.coalesce("_begin", F.lit(False))).cast("int"))
    return x.withColumn(out, F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")


def carry(rows: DataFrame, key: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """The last value that is there at or before each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def admit(rows: DataFrame, key: str, order: list[str], amount: str, budget: float, most: int | None = None) -> DataFrame:
    """Which rows a budget lets in, in order: a row that does not fit is refused and uses nothing, so this is a fold and no running sum.

    Rows are sorted by key and order and pass by in batches with one number kept between them, so no key is ever held as a whole.
    """

    def fold(frames):
        at, used, n = None, 0.0, 0
        for f in frames:
            flags = []
            for k, a in zip(f[key], f[amount]):
                if not flags and at is None or k != at:
                    at, used, n = k, 0.0, 0
                fits = used + a <= budget and (most is None or n < most)
                if fits:
                    used, n = used + a, n + 1
                flags.append(fits)
            yield f.assign(admitted=flags)

    x = rows.filter(F.col(key).isNotNull()).select(key, *order, F.coalesce(F.col(amount), F.lit(0.0)).cast("double").alias(amount))
    schema = ", ".join(f"`{c}` {t}" for c, t in x.dtypes) + ", admitted boolean"
    return x.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


def number_globally(rows: DataFrame, value: str, order: list[str], out: str = "number") -> DataFrame:
    """Numbers of distinct values by first appearance, over all rows without one global window: values are counted per range of
    first positions, the ranges' offsets are a small sum, and numbers are made inside each range."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    # Written once: the ranges must be the same in both uses below.
    ranged = written(firsts.repartitionByRange(F.col("_at")).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy("_at")
    inner = ranged.withColumn("_n", F.row_number().over(w))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return inner.join(offsets, "_part").select(value, (F.col("_n") + F.col("_off")).alias(out))


def batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
