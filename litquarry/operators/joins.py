"""Associations between rows: exactly-one parents, containment, neighbours, spans, boxes, coverage, trees, bounded walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litquarry.session import written


def exactly_one(children: DataFrame, parents: DataFrame, on: list[str], child_id: str, parent_id: str) -> DataFrame:
    """Each child with its parent where just one matches, else with the number of matches. Parents are counted per key before the join."""
    p = parents.groupBy(*on).agg(F.count("*").alias("matches"), F.min(parent_id).alias("_p"))
    return children.join(p, on, "left").select(child_id, *on, F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.when(F.col("matches") == 1, F.col("_p")).alias("parent"))


def holding(quotes: DataFrame, blocks: DataFrame, source: str, quote: str, text: str, block_id: str) -> DataFrame:
    """Quotes joined with the blocks of their source that hold them; ``block_id`` is unique in a source.

    Besides the source, the key is the longest inner word of the quote: inner words are whole words of every text that holds the quote, so a
    large source is not joined all with all. Only hashed words are shuffled; texts join the candidates, and the substring test confirms.
    Quotes without an inner word meet all blocks of their source.
    """
    words = lambda c: F.split(c, r"\s+")
    inner = F.slice(words(F.col(quote)), 2, F.greatest(F.size(words(F.col(quote))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = quotes.filter(F.col(quote).isNotNull()).withColumn("_word", F.xxhash64(F.coalesce(longest, F.lit(""))))
    b = blocks.filter(F.col(text).isNotNull()).select(source, block_id, F.explode(F.array_distinct(F.transform(F.array_append(words(F.col(text)), F.lit("")), lambda w: F.xxhash64(w)))).alias("_word"))
    found = q.join(b, [source, "_word"]).drop("_word")
    return found.join(blocks, [source, block_id]).filter(F.instr(F.col(text), F.col(quote)) > 0)


def containment(quotes: DataFrame, blocks: DataFrame, source: str, quote: str, text: str, quote_id: str, block_id: str, most: int = 3) -> DataFrame:
    """Blocks of the same source that hold the quote, the first ``most`` of each."""
    hit = holding(quotes, blocks, source, quote, text, block_id)
    w = Window.partitionBy(quote_id).orderBy(block_id)
    return hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def seams(blocks: DataFrame, source: str, text: str, order: str, page: str) -> DataFrame:
    """Neighbouring blocks of one page with ``_next`` and, joined by a space or at a hyphen, ``_both``."""
    w = Window.partitionBy(source, page).orderBy(order)
    b = blocks.withColumn("_next", F.lead(text).over(w)).filter("_next is not null")
    return b.withColumn("_both", F.when(F.col(text).rlike("[-‐]$"), F.concat(F.regexp_replace(text, "[-‐]$", ""), F.col("_next"))).otherwise(F.concat_ws(" ", text, "_next")))


def spanning(quotes: DataFrame, blocks: DataFrame, source: str, quote: str, text: str, order: str, page: str) -> DataFrame:
    """Pairs of neighbouring blocks of one page over which a quote runs; ``order`` is unique in a source."""
    hit = holding(quotes, seams(blocks, source, text, order, page), source, quote, "_both", order)
    return hit.filter((F.instr(F.col(text), F.col(quote)) == 0) & (F.instr(F.col("_next"), F.col(quote)) == 0)).drop("_both", "_next")


def box_area(b: str) -> Column:
    return F.greatest(F.col(f"{b}.x1") - F.col(f"{b}.x0"), F.lit(0.0)) * F.greatest(F.col(f"{b}.y1") - F.col(f"{b}.y0"), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_join(outer: DataFrame, inner: DataFrame, on: list[str], outer_box: str, inner_box: str, share: float = 0.8, cells: int = 8) -> DataFrame:
    """Inner boxes of which at least ``share`` lies in an outer box of the same page.

    Besides the page, both sides are joined on a grid cell: the inner box on the cell of its centre, the outer on the cells it covers
    (grown by what may stick out), so a crowded page is not joined all with all.
    """
    cell = lambda c: F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    o = outer.withColumn("_cx", F.explode(F.sequence(cell(F.col(f"{outer_box}.x0") - 0.5 * (1 - share)), cell(F.col(f"{outer_box}.x1") + 0.5 * (1 - share)))))
    o = o.withColumn("_cy", F.explode(F.sequence(cell(F.col(f"{outer_box}.y0") - 0.5 * (1 - share)), cell(F.col(f"{outer_box}.y1") + 0.5 * (1 - share)))))
    i = inner.withColumn("_cx", cell((F.col(f"{inner_box}.x0") + F.col(f"{inner_box}.x1")) / 2)).withColumn("_cy", cell((F.col(f"{inner_box}.y0") + F.col(f"{inner_box}.y1")) / 2))
    return o.join(i, [*on, "_cx", "_cy"]).filter((box_area(inner_box) > 0) & (intersection(outer_box, inner_box) >= share * box_area(inner_box))).drop("_cx", "_cy")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, cells: int = 8) -> DataFrame:
    """Pairs of boxes of a page that overlap. Both are put on the grid cells they cover; a pair counts in the first cell they share."""
    cell = lambda c: F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int")

    def placed(d: DataFrame, box: str) -> DataFrame:
        d = d.withColumn("_cx", F.explode(F.sequence(cell(F.col(f"{box}.x0")), cell(F.col(f"{box}.x1")))))
        return d.withColumn("_cy", F.explode(F.sequence(cell(F.col(f"{box}.y0")), cell(F.col(f"{box}.y1")))))

    first = (F.col("_cx") == cell(F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")))) & (F.col("_cy") == cell(F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))))
    return placed(left, a).join(placed(right, b), [*on, "_cx", "_cy"]).filter(first & (intersection(a, b) > 0)).drop("_cx", "_cy")


def explode_spans(cells: DataFrame, start: str, length: str, out: str) -> DataFrame:
    """One row for every position a span covers, for an equi-join instead of a range join."""
    return cells.withColumn(out, F.explode(F.sequence(F.col(start), F.col(start) + F.greatest(F.col(length), F.lit(1)) - 1)))


def coverage(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, extra or given more than once; empty where the coverage is full."""
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    g = given.groupBy(key).agg(F.count("*").alias("given"))
    x = e.join(g, key, "full_outer").na.fill(0, ["expected", "given"])
    return x.select(key, F.when(F.col("expected") == 0, "extra").when(F.col("given") == 0, "missing").when(F.col("given") > 1, "repeated").alias("problem")).filter("problem is not null")


def section_parents(sections: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """The nearest earlier section of a lower level, from the last position of each level so far (levels are at most 6)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w) for k in range(1, 7)]
    higher = [F.when(F.col(level) > k, lasts[k - 1]) for k in range(1, 7)]
    return sections.withColumn("parent", F.greatest(*higher))


def walk(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes reached from ``node`` over ``src -> dst`` with their least depth; levels are joined one after another and lineage is cut."""
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = written(new.withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen
