"""Append-only revisions, targeted patches, bulk edits and incremental reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_confirmations(history: DataFrame, key: str, order: list[str], revision: str, confirms: Column, edits: Column) -> DataFrame:
    """State of each result from its history: an edit after a confirmation revokes it."""
    at = F.struct(*order)
    g = history.groupBy(key).agg(F.count("*").alias("revisions"), F.max_by(revision, F.when(confirms, at)).alias("confirmed_by"), F.max(F.when(confirms, F.col(order[0]))).alias("_c"), F.max(F.when(edits, F.col(order[0]))).alias("_e"))
    return g.select(key, "revisions", "confirmed_by", F.coalesce(F.col("_c") > F.col("_e"), F.col("_c").isNotNull()).alias("confirmed"))


def patch(rows: DataFrame, changes: DataFrame, removed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields replaced where a change gives a value; removed keys go last."""
    c = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    x = rows.join(c, key, "left").select(*[F.coalesce(f"_{f}", f).alias(f) if f in fields else F.col(f) for f in rows.columns])
    return x.join(removed.select(key), key, "left_anti")


def rename_tag(tags: Column, old: str, new: str | None) -> Column:
    """Renamed everywhere, or deleted where ``new`` is None."""
    if new is None:
        return F.array_remove(tags, old)
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))


def place(rows: DataFrame, col: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    """Bulk edit of one field: the first rule that applies sets it."""
    c = reduce(lambda w, r: w.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise(F.col(col))
    return rows.withColumn(col, c)


def reuse(new: DataFrame, done: DataFrame, key: str, identities: list[str]) -> DataFrame:
    """Which rows an earlier run covers: every identity is the same, null equal to null."""
    d = done.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in identities], F.lit(True).alias("_done"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identities], F.col("_done"))
    return new.join(d, key, "left").select(key, F.when(F.coalesce(same, F.lit(False)), "reuse").otherwise("recompute").alias("plan"))
