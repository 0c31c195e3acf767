"""Mixing sources to target weights.

For each plan and source the wanted size is ``target_share * total_ratio * size of the corpus`` in tokens. Every document of the
source gets an expected number of copies, proportional to its weight (a power of its size) and at most ``max_repeats``; the scale is
the one at which the expected size is the wanted size, so what the cap takes from some documents goes to the others. The whole part is allocated with certainty; the fraction is the document's inclusion probability in a
Pareto order sample: with u uniform, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and the first ones are taken until
the remaining size is reached (the document that crosses the mark is taken if that comes nearer to it).

The rank at which a source is cut is found without gathering a source in one task: ranks are bucketed, bucket sizes are summed
map-side, the crossing bucket is split again, and only the rows of the crossing cell are ordered.

Defined results: documents with null or empty text have no size and are never selected; rows with a null source belong to no
plan; a source absent from the corpus contributes nothing and is reported with share 0; a source whose capped supply is too
small gives all its copies and the plan is reported as not reached. Repeated rows count on their own; ties of ranks are broken by id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litquarry.session import written

from .tokens import DEFAULT_TOKENIZER_DIR, count_tokens

CELLS = 1024
MOST_BROADCAST = 100_000


def sized_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_TOKENIZER_DIR) -> DataFrame:
    """``doc_id, source, tokens`` of the documents that have a size."""
    sized = count_tokens(docs.select("doc_id", "source", "text"), "text", "tokens", tokenizer, folder)
    return sized.select("doc_id", "source", "tokens").filter("tokens > 0")


def once(sized: DataFrame) -> DataFrame:
    """Write the three narrow columns to the shared folder, as the plan reads them several times and tokenizing is the dear part."""
    return written(sized)


def _uniform(seed: int):
    """A reproducible uniform number in (0, 1) of a document in a plan."""
    h = F.xxhash64("plan_id", "doc_id", F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))


def targets(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per plan and source: wanted tokens, supply and the number of copies every document gets for certain.

    ``sized`` is reduced to one row per source before anything is joined; the result has as many rows as ``plans``.
    """
    supply = sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("docs"))
    total = int(supply.agg(F.sum("supply")).first()[0] or 0)
    return (
        plans.join(supply, "source", "left")
        .select(
            "plan_id",
            "source",
            "target_share",
            "max_repeats",
            "total_ratio",
            F.coalesce("supply", F.lit(0)).alias("supply"),
            F.coalesce("docs", F.lit(0)).alias("docs"),
            F.lit(total).cast("bigint").alias("corpus_tokens"),
        )
        .withColumn("wanted", F.col("target_share") * F.col("total_ratio") * F.col("corpus_tokens"))
        .withColumn("reachable", F.least("wanted", F.col("supply") * F.col("max_repeats").cast("double")))
    )


def scale_for(weight: np.ndarray, size: np.ndarray, most: float, wanted: float) -> float:
    """The factor at which copies of ``min(factor * weight, most)`` have the wanted size; infinite where all ``most`` copies are needed."""
    if wanted >= most * size.sum() * (1 - 1e-12):
        return float("inf")
    order = np.argsort(-weight)
    w, s = weight[order], size[order]
    # With the k heaviest at the cap, the others share what is left.
    capped, free = most * np.r_[0.0, np.cumsum(s)[:-1]], np.cumsum((w * s)[::-1])[::-1]
    factor = (wanted - capped) / free
    k = int(np.flatnonzero(factor * w <= most * (1 + 1e-12))[0])  # the first k whose heaviest free one stays below the cap
    return float(max(factor[k], 0.0))


def with_factors(sized: DataFrame, goal: DataFrame, size_power: float) -> DataFrame:
    """Plan, source, cap, wanted size and factor of each row of ``goal``, as a table of the driver's: plans times sources rows, whatever the corpus.

    Weights are summed in sixteenths of a power of two, so a source has some hundred cells whatever its size.
    """
    weight = F.pow(F.col("tokens").cast("double"), F.lit(float(size_power)))
    cells = sized.join(goal.select("source").distinct(), "source", "left_semi").groupBy("source", F.floor(F.log2("tokens") * 16).alias("cell")).agg(F.sum("tokens").cast("double").alias("size"), F.sum(weight * F.col("tokens")).alias("ws")).toPandas()
    plans = goal.select("plan_id", "source", "max_repeats", "reachable").toPandas()
    by = {s: (c["ws"].to_numpy(float) / c["size"].to_numpy(float), c["size"].to_numpy(float)) for s, c in cells.groupby("source")}
    rows = [(p, s, m, float(r), scale_for(*by[s], float(m), float(r))) for p, s, m, r in plans.itertuples(index=False, name=None)]
    schema = f"plan_id {goal.schema['plan_id'].dataType.simpleString()}, source string, max_repeats int, reachable double, factor double"
    out = sized.sparkSession.createDataFrame(rows, schema)
    # Its size is known here; a source may hold most of the corpus, so documents are not shuffled by source where that can be helped.
    return F.broadcast(out) if len(rows) <= MOST_BROADCAST else out


def select_mix(sized: DataFrame, plans: DataFrame, seed: int = 17, size_power: float = 0.0) -> DataFrame:
    """``plan_id, source, doc_id, tokens, copies`` of the selected documents.

    ``size_power`` weights documents by ``tokens ** size_power``; 0 gives every document of a source the same chance per copy.
    """
    weight = F.pow(F.col("tokens").cast("double"), F.lit(float(size_power)))
    goal = with_factors(sized, targets(sized, plans).filter("reachable > 0"), size_power)
    d = (
        sized.join(goal.select("plan_id", "source", "reachable", "max_repeats", "factor"), "source")
        .withColumn("expected", F.least(F.col("factor") * weight, F.col("max_repeats").cast("double")))
        .withColumn("sure", F.floor(F.col("expected") + 1e-9))
        .withColumn("p", F.greatest(F.col("expected") - F.col("sure"), F.lit(0.0)))
    )
    u = _uniform(seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # The rank value in (0, 1), rising with the odds ratio; documents at the cap cannot be drawn again.
    d = d.withColumn("rank", F.when(F.col("sure") >= F.col("max_repeats"), F.lit(2.0)).when(F.col("p") <= 0, 1 - 1e-9 * (1 - u)).otherwise(odds / (1 + odds)))
    d = d.withColumn("cell", F.floor(F.least("rank", F.lit(1 - 1e-12)) * CELLS)).withColumn("subcell", F.floor((F.least("rank", F.lit(1 - 1e-12)) * CELLS - F.col("cell")) * CELLS))
    # Read three times below: cells, the rows of the crossing cell, all others.
    d = written(d.select("plan_id", "source", "doc_id", "tokens", "sure", "rank", "cell", "subcell", "reachable"))
    drawable = F.when(F.col("rank") < 2, F.col("tokens")).otherwise(F.lit(0))
    key = ["plan_id", "source"]
    base = d.groupBy(*key, "cell", "subcell").agg(F.sum(drawable).alias("cell_tokens"), F.sum(F.col("sure") * F.col("tokens")).alias("sure_tokens"), F.first("reachable").alias("reachable"))
    coarse = base.groupBy(*key, "cell").agg(F.sum("cell_tokens").alias("cell_tokens"), F.sum("sure_tokens").alias("sure_tokens"), F.first("reachable").alias("reachable"))
    # Windows over at most CELLS rows per plan and source.
    w, whole = Window.partitionBy(*key).orderBy("cell"), Window.partitionBy(*key)
    coarse = (
        coarse.withColumn("rest", F.col("reachable") - F.sum("sure_tokens").over(whole))
        .withColumn("upto", F.sum("cell_tokens").over(w))
        .withColumn("before", F.col("upto") - F.col("cell_tokens"))
        .filter((F.col("before") < F.col("rest")))
    )
    last = coarse.groupBy(*key).agg(F.max_by(F.struct("cell", "before", "rest"), "cell").alias("m")).select(*key, F.col("m.cell").alias("cut_cell"), F.col("m.before").alias("cut_before"), F.col("m.rest").alias("rest"))
    fine = base.join(last, key).filter("cell = cut_cell")
    ws = Window.partitionBy(*key).orderBy("subcell")
    fine = fine.withColumn("upto", F.col("cut_before") + F.sum("cell_tokens").over(ws)).withColumn("before", F.col("upto") - F.col("cell_tokens")).filter("before < rest")
    cut = fine.groupBy(*key).agg(F.max_by(F.struct("cut_cell", "subcell", "before", "rest"), "subcell").alias("m")).select(*key, "m.cut_cell", F.col("m.subcell").alias("cut_sub"), F.col("m.before").alias("cut_before"), F.col("m.rest").alias("rest"))
    d = d.join(cut, key, "left")
    at = (F.col("cell") == F.col("cut_cell")) & (F.col("subcell") == F.col("cut_sub")) & (F.col("rank") < 2)
    below = (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & (F.col("subcell") < F.col("cut_sub")))
    # Only rows of the one crossing subcell are ordered: about 1 / CELLS^2 of a source.
    edge = d.filter(at)
    we = Window.partitionBy(*key).orderBy("rank", "doc_id")
    edge = edge.withColumn("upto", F.col("cut_before") + F.sum("tokens").over(we)).withColumn("before", F.col("upto") - F.col("tokens"))
    edge = edge.withColumn("drawn", ((F.col("before") < F.col("rest")) & ((F.col("upto") - F.col("rest")) <= (F.col("rest") - F.col("before")))).cast("long"))
    rest = d.filter(~F.coalesce(at, F.lit(False))).withColumn("drawn", F.coalesce((below & (F.col("rank") < 2)).cast("long"), F.lit(0)))
    cols = [*key, "doc_id", "tokens", "sure", "drawn"]
    return edge.select(cols).unionByName(rest.select(cols)).withColumn("copies", (F.col("sure") + F.col("drawn")).cast("int")).filter("copies > 0").select(*key, "doc_id", "tokens", "copies")


def mix_report(selection: DataFrame, sized: DataFrame, plans: DataFrame) -> DataFrame:
    """Wanted and actual size and share of every source of every plan."""
    got = selection.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = targets(sized, plans).join(got, ["plan_id", "source"], "left").na.fill(0, ["actual_tokens", "documents", "most_copies"])
    w = Window.partitionBy("plan_id")  # the sources of one plan
    return out.select(
        "plan_id",
        "source",
        "target_share",
        F.round(F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(w)), F.lit(0.0)), 6).alias("actual_share"),
        F.round("wanted", 3).alias("wanted_tokens"),
        "actual_tokens",
        "documents",
        "most_copies",
        "max_repeats",
        (F.col("reachable") >= F.col("wanted") - 1e-6).alias("reached"),
    )
