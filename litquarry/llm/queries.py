"""Queries of the subpackage and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.session import table

from . import linkage, mixing, names, pages, pieces, pii, scans, tokens, unify

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return wrap


def _looked_at(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hit").select(F.lit("search_hit").alias("src_table"), F.col("hit_id").alias("id"), "text")
    return hits.unionByName(table(spark, sf, "paper_metadata").select(F.lit("paper_metadata").alias("src_table"), F.col("record_id").alias("id"), F.col("title").alias("text")))


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows that look the same and are stored as different strings."""
    return unify.lookalike_pairs(_looked_at(spark, sf))


@query("p1_classes")
def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that look like differently stored ones, one row each with its class."""
    return unify.lookalike_classes(_looked_at(spark, sf))


@query("p1_unified")
def p1_unified(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text."""
    return unify.unify_text(_looked_at(spark, sf), "text").select("src_table", "id", "unified")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_hit").select("hit_id", "config_id", "text")
    config = table(spark, sf, "chunk_config").select("config_id", "max_characters", "overlap_characters")
    return pieces.split_texts(hits.join(config, "config_id", "left"), "hit_id", "text", "max_characters", "overlap_characters")


@query("p2_found", "SELECT hit_id FROM search_hit JOIN chunk_config USING (config_id) WHERE length(text) > max_characters")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Hits whose text had to be cut."""
    return pieces.oversized(_pieces(spark, sf), "hit_id")


@query("p2_pieces")
def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in numbered pieces within its limit."""
    return _pieces(spark, sf)


def _name_links(spark: SparkSession, sf: str) -> DataFrame:
    elements = names.name_elements(table(spark, sf, "paper_metadata"), "paper_metadata", "record_id").unionByName(names.name_elements(table(spark, sf, "paper_request"), "paper_request", "request_id"))
    return names.link_elements(elements, table(spark, sf, "author_authority"))


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Elements that stand for an authority entry under another spelling."""
    return _name_links(spark, sf).filter("kind <> 'exact'").select("src_table", "row_id", "author_pos", "author_id")


@query("p4_links")
def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    """All linked elements with the kind of rewriting and the confidence."""
    return _name_links(spark, sf).select("src_table", "row_id", "author_pos", "name", "author_id", "kind", "confidence")


def _work_links(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.link(table(spark, sf, "paper_request"), table(spark, sf, "paper_metadata"))


@query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Requests without a DOI and the records of the same work."""
    return _work_links(spark, sf).select("request_id", "record_id")


@query("p5_matches")
def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the confidence of each match."""
    return _work_links(spark, sf)


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of scan noise of every row."""
    return scans.find_noise(table(spark, sf, "fragment"), table(spark, sf, "search_hit"))


def _lexicon(spark: SparkSession, sf: str):
    return scans.build_lexicon(table(spark, sf, "fragment").select("text").unionByName(table(spark, sf, "search_hit").select("text")))


@query("p3_hits")
def p3_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as continuous paragraphs."""
    return scans.repair_hits(table(spark, sf, "search_hit"), _lexicon(spark, sf))


@query("p3_artifacts")
def p3_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of every artifact as continuous paragraphs."""
    return scans.repair_fragments(table(spark, sf, "fragment"), _lexicon(spark, sf))


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without article prose of their own."""
    return pages.excluded_pages(table(spark, sf, "retrieved_page"), table(spark, sf, "parsed_html"))


@query("p6_judged")
def p6_judged(spark: SparkSession, sf: str) -> DataFrame:
    """What each page consists of and whether it is excluded."""
    return pages.judge_pages(table(spark, sf, "retrieved_page"), table(spark, sf, "parsed_html"))


@query("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


# Longer documents have a greater chance: the registered mixes weight them by the root of their size.
SIZE_POWER = 0.5


def _mix_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(table(spark, sf, "documents"))
    return sized, table(spark, sf, "mix_target")


@query("p8_mix")
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Selected documents of each plan with their number of copies."""
    sized, plans = _mix_inputs(spark, sf)
    return mixing.select_mix(mixing.once(sized), plans, size_power=SIZE_POWER)


@query("p8_shares")
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and actual shares of each source of each plan."""
    sized, plans = _mix_inputs(spark, sf)
    sized = mixing.once(sized)
    return mixing.mix_report(mixing.select_mix(sized, plans, size_power=SIZE_POWER), sized, plans)


@query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of personal information."""
    return pii.pii_spans(table(spark, sf, "documents")).select("doc_id", "pii_type", "start_char")


@query("p9_masked")
def p9_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders in place of personal information."""
    return pii.mask_pii(table(spark, sf, "documents")).select("doc_id", "masked")
