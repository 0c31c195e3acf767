"""Literal search with ranked hits, pages of hits, scopes with reasons, suppression of repeated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.functions.identifiers import bind
from litquarry.functions.search import may_meet, score, terms_of
from litquarry.functions.text import search_text


def search(units: DataFrame, text_col: str, query: str, mode: str = "and", exact: bool = False, full: bool = True) -> DataFrame:
    """Units that meet the query, with their ``score``. A test of the raw text comes first; the view of what is left is made once per text.

    The score goes through a generator, which Catalyst neither copies into a filter nor merges with other projections.
    """
    terms = terms_of(query, exact)
    raw = F.col(text_col)
    found = units.filter(raw.isNotNull() & may_meet(raw, terms, mode, full)).withColumn("_view", search_text(raw, full))
    scored = bind(F.col("_view"), lambda v: score(v, terms, mode))
    return found.select(*units.columns, F.explode(F.filter(F.array(scored), lambda x: x.isNotNull())).alias("score"))


def top(hits: DataFrame, limit: int, order: list[Column], offset: int = 0) -> DataFrame:
    """A page of ranked hits with their global rank; only ``offset + limit`` rows reach the one task that numbers them."""
    page = hits.orderBy(*order).limit(offset + limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)


def scope(units: DataFrame, keep: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Units inside the scope, and those outside with the reason."""
    inside = F.coalesce(keep, F.lit(False))
    return units.filter(inside), units.filter(~inside).withColumn("reason", reason)


def hide_subsets(hits: DataFrame, key: str, id_col: str, kind_col: str, blocks_col: str) -> DataFrame:
    """Drops context and figure hits whose blocks all lie in a direct hit of the same artifact: joined on artifact and block, never all pairs."""
    b = hits.select(key, id_col, kind_col, F.explode(blocks_col).alias("block"), F.size(blocks_col).alias("n"))
    other = b.filter(F.col(kind_col).isin("context", "figure"))
    direct = b.filter(~F.col(kind_col).isin("context", "figure")).select(key, "block", F.col(id_col).alias("by"))
    covered = other.join(direct, [key, "block"]).groupBy(key, id_col, "by", "n").agg(F.count("*").alias("c")).filter("c = n").select(key, id_col).distinct()
    return hits.join(covered, [key, id_col], "left_anti")


def context_window(blocks: DataFrame, key: str, order: str, most: int = 4, characters: int = 2400, eligible: Column | None = None) -> DataFrame:
    """Each eligible block with up to ``most - 1`` following ones of its page, stopped at ineligible blocks and at the length limit; windows of one block are left out."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, most - 1)
    ok = eligible if eligible is not None else F.lit(True)
    x = blocks.withColumn("_ok", ok)
    x = x.withColumn("_w", F.collect_list(F.struct(F.col(order).alias("o"), F.col("page").alias("p"), F.length("text").alias("n"), F.col("_ok").alias("ok"))).over(w))
    step = lambda a, b: F.when(a["go"] & b["ok"] & (b["p"] == a["p"]) & (a["n"] + b["n"] <= characters), F.struct(F.lit(True).alias("go"), a["p"].alias("p"), (a["n"] + b["n"]).alias("n"), (a["k"] + 1).alias("k"), b["o"].alias("last"))).otherwise(F.struct(F.lit(False).alias("go"), a["p"].alias("p"), a["n"].alias("n"), a["k"].alias("k"), a["last"].alias("last")))
    first = F.struct(F.lit(True).alias("go"), F.col("page").alias("p"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.col(order).alias("last"))
    x = x.withColumn("_r", F.aggregate("_w", first, step))
    return x.filter(F.col("_ok") & (F.col("_r.k") >= 2)).select(key, F.col(order).alias("start"), F.col("_r.last").alias("end"), F.col("_r.k").cast("int").alias("blocks"), F.col("_r.n").cast("int").alias("characters"))
