"""Summaries: coverage, duplicates, catalogue groups, ledgers, quality, review scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, digits: int = 6) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def status_coverage(rows: DataFrame, status: str, complete: list[str], partial: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(status).isin(complete)).alias("complete_rows"), F.count_if(F.col(status).isin(partial)).alias("partial_rows"), F.every(F.col(status).isin(complete)).alias("complete"))


def duplicate_groups(rows: DataFrame, content: Column, identity: str, order: list[Column], id_col: str) -> DataFrame:
    """Groups of equal content: size, kept row (the first by ``order``), and whether they claim several identities. One aggregation by hash."""
    x = rows.withColumn("sha", F.sha2(content, 256)).filter("sha is not null")
    return x.groupBy("sha").agg(F.count("*").alias("copies"), F.count_distinct(identity).alias("identities"), F.min_by(id_col, F.struct(*order)).alias("kept")).filter("copies > 1").withColumn("conflict", F.col("identities") > 1)


def catalogue(rows: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Members of each key, first non-empty value of every field in ``order``, and the fields with several values."""
    v = {f: F.when(F.trim(F.col(f).cast("string")) != "", F.col(f)) for f in fields}
    aggs = [F.count("*").alias("members")]
    aggs += [F.min_by(v[f], F.when(v[f].isNotNull(), F.col(order))).alias(f) for f in fields]
    aggs += [(F.min(v[f]) != F.max(v[f])).alias(f"_c_{f}") for f in fields]
    g = rows.groupBy(key).agg(*aggs)
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_c_{f}"), F.lit(f)) for f in fields]))
    return g.select(key, "members", *fields, F.array_join(conflicts, ",").alias("conflicts"))


def ledger(calls: DataFrame, by: str, amount: str, unknown: Column) -> DataFrame:
    """Known amount, calls, and calls of unknown amount per label."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.sum(F.when(~unknown, F.col(amount))), 4).alias("known"), F.count_if(unknown).alias("unknown_calls"))


def duplicate_characters(lines: DataFrame, text: Column, by: list[str]) -> DataFrame:
    """Characters in repeated lines: length times the repeats beyond the first."""
    g = lines.select(*by, text.alias("k")).filter("k <> ''").groupBy(*by, "k").agg(F.count("*").alias("n"))
    return g.groupBy(*by).agg(F.sum(F.length("k") * (F.col("n") - 1)).alias("duplicate_characters"), F.sum("n").alias("lines"))


def review_score(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and accuracy of judged cases (``expected_present, present, correct, record_id``)."""
    keys = by or ["_all"]
    cases = cases if by else cases.withColumn("_all", F.lit(1))
    ok, hit = F.col("correct"), F.col("present")
    wholes = cases.groupBy(*keys, "record_id").agg(F.every(ok).alias("whole")).groupBy(*keys).agg(F.count_if("whole").alias("complete_records"), F.count("*").alias("records"))
    s = cases.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(hit & ok).alias("true_present"), F.count_if(hit).alias("present_cases"), F.count_if("expected_present").alias("expected_cases"), F.count_if(ok).alias("correct_cases"))
    s = s.join(wholes, keys)
    return s.select(*(by or []), "cases", ratio(F.col("true_present"), F.col("present_cases")).alias("precision"), ratio(F.col("true_present"), F.col("expected_cases")).alias("recall"), ratio(F.col("correct_cases"), F.col("cases")).alias("accuracy"), ratio(F.col("complete_records"), F.col("records")).alias("record_accuracy"))


def exclusive_time(spans: DataFrame, span_id: str, parent: str, seconds: str) -> DataFrame:
    """Own time of each span without its direct children, and whether the children outlast it."""
    kids = spans.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(span_id)).agg(F.sum(seconds).alias("_kids"))
    return spans.join(kids, span_id, "left").withColumn("exclusive", F.col(seconds) - F.coalesce("_kids", F.lit(0))).withColumn("overrun", F.coalesce(F.col("_kids") > F.col(seconds), F.lit(False))).drop("_kids")


def latest(rows: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """The last row of each key: an aggregation that combines map-side, no window."""
    m = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("m"))
    return m.select(key, *[F.col(f"m.{c}").alias(c) for c in cols])


def first_of(rows: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    m = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("m"))
    return m.select(key, *[F.col(f"m.{c}").alias(c) for c in cols])


def repeated_margins(lines: DataFrame, doc: str, page: str, key: Column, least: int = 2) -> DataFrame:
    """Keys of lines that occur on at least ``least`` pages of a document."""
    return lines.select(doc, page, key.alias("key")).filter("key <> ''").groupBy(doc, "key").agg(F.count_distinct(page).alias("pages")).filter(F.col("pages") >= least)


def occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
