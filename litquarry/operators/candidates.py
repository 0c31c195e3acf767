"""Candidate routes: projection, merge, ranking and the contribution of providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of versions and hosts, and the parts of a route's priority.
VERSION_RANK = {"published": 3, "accepted": 2, "submitted": 1}
HOST_RANK = {"publisher": 4, "repository": 3, "resolver": 2, "index": 1}
ROUTE_HOST = {"repository": 60, "publisher": 50, "resolver": 20, "index": 10}
ROUTE_VERSION = {"published": 30, "accepted": 20, "submitted": 10}


def ranked(c: Column, ranks: dict[str, int]) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(0)


def rank_key() -> Column:
    """Open access, file, version, host, best: compared in this order."""
    return F.struct(
        (F.col("access_type") == "open").cast("int").alias("oa"),
        (F.col("url_type") == "pdf").cast("int").alias("pdf"),
        ranked(F.col("version"), VERSION_RANK).alias("version_rank"),
        ranked(F.col("host_type"), HOST_RANK).alias("host_rank"),
        F.coalesce("is_best", F.lit(False)).cast("int").alias("best"),
    )


def route_priority() -> Column:
    return (
        ranked(F.col("host_type"), ROUTE_HOST)
        + ranked(F.col("version"), ROUTE_VERSION)
        + F.when(F.col("access_type") == "open", 100).otherwise(0)
        + F.when(F.coalesce("is_best", F.lit(False)), 20).otherwise(0)
        + F.when(F.col("url").startswith("https://"), 5).otherwise(0)
    )


def consistent(c: str) -> Column:
    """The one non-empty value of a group; null where the group has none or several."""
    v = F.when(F.trim(F.col(c)) != "", F.col(c))
    return F.when(F.min(v) == F.max(v), F.min(v))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per DOI and address: the best report's fields, all providers in order of appearance, and the texts on which the reports agree.

    Needs ``doi, url, position, provider, access_type, url_type, version, host_type, is_best, license, source_name``. One aggregation:
    best row and lists are combined map-side.
    """
    best = F.struct(rank_key().alias("key"), (-F.col("position")).alias("first"), "access_type", "url_type", "version", "host_type")
    seen = F.array_sort(F.collect_set(F.struct("position", "provider")))
    merged = candidates.groupBy("doi", "url").agg(F.max(best).alias("b"), seen.alias("seen"), consistent("license").alias("license"), consistent("source_name").alias("source_name"), F.bool_or(F.coalesce("is_best", F.lit(False))).alias("is_best"))
    return merged.select("doi", "url", "b.access_type", "b.url_type", "b.version", "b.host_type", F.array_distinct(F.transform("seen", lambda x: x["provider"])).alias("providers"), "license", "source_name", "is_best")


def order_candidates(merged: DataFrame) -> DataFrame:
    """``rank`` of each candidate within its DOI: the key and then the address, both descending."""
    w = Window.partitionBy("doi").orderBy(rank_key().desc(), F.desc("url"))
    return merged.withColumn("rank", F.row_number().over(w))


FIELDS = ("access_type", "url_type", "version", "host_type", "license", "is_best")


def provider_contribution(candidates: DataFrame) -> DataFrame:
    """Per provider: distinct routes, those only it found, those shared, fields only it could fill, fields others contradict."""
    known = {f: F.when((F.col(f) != "unknown") & (F.trim(F.col(f)) != ""), F.col(f)) for f in FIELDS if f != "is_best"}
    known["is_best"] = F.when(F.col("is_best"), F.lit("true"))
    per = candidates.groupBy("doi", "url", "provider").agg(*[F.collect_set(known[f]).alias(f) for f in FIELDS])
    w = Window.partitionBy("doi", "url")  # the providers of one route
    informed = {f: F.sum((F.size(f) > 0).cast("int")).over(w) for f in FIELDS}
    distinct = {f: F.size(F.array_distinct(F.flatten(F.collect_list(f).over(w)))) for f in FIELDS}
    x = per.withColumn("providers", F.count("*").over(w))
    for f in FIELDS:
        x = x.withColumn(f"ex_{f}", ((F.col("providers") > 1) & (F.size(f) > 0) & (informed[f] == 1)).cast("long")).withColumn(f"dis_{f}", ((F.size(f) > 0) & (informed[f] > 1) & (distinct[f] > 1)).cast("long"))
    return x.groupBy("provider").agg(
        F.count("*").alias("routes"),
        F.count_if(F.col("providers") == 1).alias("unique_routes"),
        F.count_if(F.col("providers") > 1).alias("shared_routes"),
        *[F.sum(f"ex_{f}").alias(f"exclusive_{f}") for f in FIELDS],
        sum((F.sum(f"dis_{f}") for f in FIELDS[1:]), F.sum(f"dis_{FIELDS[0]}")).alias("disagreements"),
    )


def batch_status(results: DataFrame) -> DataFrame:
    """Per DOI: SUCCESS, PARTIAL_SUCCESS, ERROR, NOT_FOUND or NO_CANDIDATES from its providers' statuses."""
    g = results.groupBy("doi").agg(F.sum("candidates").alias("candidates"), F.bool_or(F.col("status") == "ERROR").alias("failed"), F.every(F.col("status") == "NOT_FOUND").alias("nowhere"))
    status = F.when((F.col("candidates") > 0) & F.col("failed"), "PARTIAL_SUCCESS").when(F.col("candidates") > 0, "SUCCESS").when(F.col("failed"), "ERROR").when(F.col("nowhere"), "NOT_FOUND").otherwise("NO_CANDIDATES")
    return g.select("doi", "candidates", status.alias("status"))


def first_success(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Attempts up to the first that succeeds; all of them where none does."""
    stop = attempts.groupBy(key).agg(F.min(F.when(ok, F.col(order))).alias("stop"))
    return attempts.join(stop, key).filter(F.col("stop").isNull() | (F.col(order) <= F.col("stop"))).drop("stop")
