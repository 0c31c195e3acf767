"""The library: keys of requests, agencies, attachments, versions, captions told twice, audits."""

from __future__ import annotations

import json
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litquarry.functions.identifiers import compact_key

# Fields that identify a request, those kept as they are, and those that only place it.
IDENTITY = ["doi", "title", "authors", "journal", "year", "volume", "issue", "pages", "cnki_id"]
LITERAL = ["doi", "cnki_id"]


@F.pandas_udf(StringType())
def _digest(payload: pd.Series) -> pd.Series:
    """Hash of the canonical text of a JSON object: sorted names, one space after commas and colons."""
    return payload.map(lambda v: sha256(json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False).encode()).hexdigest(), na_action="ignore")


def request_keys(requests: DataFrame) -> DataFrame:
    """``key`` of what a request asks for, ``batch_key`` with its place in the library, and ``article_id``. Spelling of names and titles does not count; every constraint does."""
    part = lambda c: F.col(c) if c in LITERAL or c == "year" else F.array_sort(F.transform(c, compact_key)) if c == "authors" else compact_key(F.col(c))
    payload = F.to_json(F.struct(*[part(c).alias(c) for c in IDENTITY]), {"ignoreNullFields": "false"})
    x = requests.withColumn("_h", _digest(payload))
    key = F.concat(F.lit("citation:"), F.col("_h"))
    placed = (F.coalesce("folder", F.lit("")) != "") | (F.coalesce("filename", F.lit("")) != "") | (F.coalesce(F.size("tags"), F.lit(0)) > 0)
    place = F.to_json(F.struct(key.alias("a"), F.coalesce("folder", F.lit("")).alias("b"), F.coalesce("filename", F.lit("")).alias("c"), F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))).alias("d")))
    x = x.withColumn("key", key).withColumn("batch_key", F.when(placed, F.concat(F.lit("citation:"), F.sha2(place, 256))).otherwise(key))
    return x.withColumn("article_id", F.coalesce(F.concat(F.lit("doi:"), F.nullif("doi", F.lit(""))), F.nullif("cnki_id", F.lit("")), F.concat(F.lit("bibliographic:"), F.col("_h")))).drop("_h")


def agencies(records: DataFrame, doi: Column, provider: str) -> DataFrame:
    """The registry of every DOI prefix: the one most of its records come from, the first by name among equals."""
    n = records.select(F.split_part(doi, F.lit("/"), F.lit(1)).alias("prefix"), F.col(provider).alias("agency")).filter("prefix like '10.%'").groupBy("prefix", "agency").agg(F.count("*").alias("n"))
    return n.groupBy("prefix").agg(F.min_by("agency", F.struct(-F.col("n"), "agency")).alias("agency"))


def told_once(captions: DataFrame, on: str, page: str, key: str, text: str, id_col: str, least: int = 12) -> DataFrame:
    """Captions without repetitions: of those with one key on a page the longest, and of two on neighbouring pages of which one holds the other's letters, the longer one; the smaller id among equals."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    x = captions.withColumn("_t", plain)
    w = Window.partitionBy(on, page, key).orderBy(F.desc(F.length("_t")), id_col)  # captions of one label on a page
    x = x.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    other = x.select(on, key, F.col(page).alias("_p"), F.col("_t").alias("_o"), F.col(id_col).alias("_i")).withColumn(page, F.explode(F.array(F.col("_p") - 1, F.col("_p") + 1)))
    worse = x.join(other, [on, page, key]).filter((F.length("_t") >= least) & F.col("_o").contains(F.col("_t")) & ((F.length("_o") > F.length("_t")) | (F.col("_i") < F.col(id_col)))).select(id_col).distinct()
    return x.join(worse, id_col, "left_anti").drop("_t")


def attachments(papers: DataFrame, key: str, links: str, complete: Column) -> DataFrame:
    """One row for every attachment, and a PARTIAL row for a paper whose list is not complete."""
    rows = papers.select(key, F.posexplode(links).alias("position", "l")).select(key, "position", F.col("l.url").alias("url"), F.lit("FOUND").alias("state"))
    return rows.unionByName(papers.filter(~complete).select(key, F.lit(-1).alias("position"), F.lit(None).cast("string").alias("url"), F.lit("PARTIAL").alias("state")))
