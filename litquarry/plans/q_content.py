"""Queries for pages, layout, chunks, packs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.operators import content as K
from litquarry.operators.joins import box_area
from litquarry.plans.registry import query
from litquarry.session import table
from litquarry.sources import html as H
from litquarry.streaming import events as E


@query("src10_html")
def src10(spark, sf):
    p = H.parse_pages(table(spark, sf, "retrieved_page").select("page_id", "text"), "text")
    return p.select("page_id", "parsed.title", F.size("parsed.links").alias("links"), F.size("parsed.metadata").alias("metadata"), F.length("parsed.visible_text").alias("characters"))


@query("src10_links", r"SELECT page_id, CAST(len(regexp_extract_all(text, '<a\s[^>]*href=')) AS INT) AS anchors FROM retrieved_page WHERE text IS NOT NULL")
def src10_links(spark, sf):
    return table(spark, sf, "retrieved_page").filter("text is not null").select("page_id", F.regexp_count("text", F.lit(r"<a\s[^>]*href=")).alias("anchors"))


_FILE_SQL = r"regexp_matches(u, '(?i)(?:\.pdf(?:$|[?#;])|/pdf(?:/|$|[?#])|/epdf/|[?&](?:format|type|download)=pdf)')"


@query(
    "srt4_derived_files",
    f"""WITH p AS (SELECT record_id, url, links FROM paper_metadata WHERE url IS NOT NULL), l AS (SELECT record_id, i, links[i + 1].url AS u, links[i + 1].content_type AS t FROM (SELECT record_id, links, unnest(range(len(links))) AS i FROM p)),
    r AS (SELECT record_id, 0 AS position, url || '.pdf' AS u, {H.PRIORITY['citation_meta']} AS base FROM p UNION ALL SELECT record_id, 10000 + i, u, {H.PRIORITY['anchor']} FROM l WHERE {_FILE_SQL} OR lower(t) = 'pdf'),
    g AS (SELECT record_id, u, max(base + CASE WHEN u LIKE 'https://%' THEN 20 ELSE 0 END - CASE WHEN regexp_matches(lower(u), 'suppl|moesm|_si_') THEN 500 ELSE 0 END) AS priority, min(position) AS position FROM r GROUP BY 1, 2)
    SELECT record_id, u AS url, priority, position, row_number() OVER (PARTITION BY record_id ORDER BY priority DESC, position) AS rank FROM g""",
)
def srt4(spark, sf):
    """Records as pages that name a file in their metadata and link to others."""
    t = table(spark, sf, "paper_metadata").filter("url is not null")
    meta = F.array(F.struct(F.lit("citation_pdf_url").alias("name"), F.concat("url", F.lit(".pdf")).alias("content")))
    links = F.transform("links", lambda x: F.struct(x["url"].alias("href"), x["content_type"].alias("text"), F.lit("a").alias("rel")))
    p = t.select("record_id", "url", F.struct(F.lit(None).cast("string").alias("base_href"), meta.alias("metadata"), links.alias("links")).alias("parsed"))
    return H.derive_files(p, "record_id", "parsed", "url").select("record_id", "url", "priority", "position", F.col("rank").cast("bigint").alias("rank"))


@query("x16_page_title", "SELECT page_id, coalesce(" + ", ".join(f"list_filter(list_transform(list_filter(metadata, lambda m: lower(m.name) = '{n}' AND trim(m.content) <> ''), lambda m: trim(m.content)), lambda s: true)[1]" for n in H.TITLE_NAMES) + ") AS title FROM parsed_html")
def x16(spark, sf):
    return table(spark, sf, "parsed_html").select("page_id", H.page_title(F.col("metadata")).alias("title"))


@query("cls1_blocks")
def cls1(spark, sf):
    return K.blocks(table(spark, sf, "fragment")).select("artifact_id", "page", "block_no", "kind", "lines", F.length("text").alias("characters"))


@query("jn21_sections")
def jn21s(spark, sf):
    return K.sections(K.blocks(table(spark, sf, "fragment")))


@query("win17_reading_order", "WITH c AS (SELECT fragment_id, artifact_id, page, x, y, CASE WHEN y >= 785 THEN 0 WHEN y <= 62 THEN 3 WHEN x < 0.48 * 595.0 THEN 1 ELSE 2 END AS col FROM fragment) SELECT fragment_id, CAST(row_number() OVER (PARTITION BY artifact_id, page ORDER BY col, y DESC, x, fragment_id) AS INT) AS line_no FROM c")
def win17(spark, sf):
    return K.order_lines(table(spark, sf, "fragment")).select("fragment_id", "line_no")


@query("chunk_units")
def chunk_units(spark, sf):
    h = table(spark, sf, "search_hit").select("artifact_id", "hit_id", "kind", "section_id", "text")
    return K.chunks(h, "artifact_id", "hit_id", 1200).select("artifact_id", "run", "part", "chunk_id", F.size("blocks").alias("blocks"), F.length("text").alias("characters"), "complete")


@query("jn25_context_pack", "WITH h AS (SELECT DISTINCT artifact_id, page FROM search_hit WHERE score > 1.8), l AS (SELECT artifact_id, max(page) AS n FROM search_hit GROUP BY 1), w AS (SELECT DISTINCT artifact_id, unnest(range(greatest(page - 1, 1), least(page + 1, n) + 1)) AS page FROM h JOIN l USING (artifact_id)) SELECT artifact_id, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS blocks, coalesce(sum(length(text)) <= 4000, NULL) AS fits FROM search_hit JOIN w USING (artifact_id, page) GROUP BY 1")
def jn25(spark, sf):
    h = table(spark, sf, "search_hit").select("artifact_id", "page", "hit_id", "score", "text")
    return K.context_pack(h.filter("score > 1.8"), h, "artifact_id", "page", 1, 4000, "hit_id").select("artifact_id", "characters", "blocks", "fits")


@query("agg21_numeric_rows", r"WITH c AS (SELECT hit_id, unnest(regexp_split_to_array(trim(text), '\s*\|\s*')) AS cell FROM search_hit WHERE contains(text, '|')) SELECT hit_id, count(*) FILTER (regexp_matches(cell, '^[+\-−±]?[0-9]+(?:\.[0-9]+)?\s*%?(?:\s*[-–±]\s*[0-9]+(?:\.[0-9]+)?\s*%?)?$')) AS numbers, count(*) AS cells FROM c GROUP BY 1 HAVING numbers >= 2")
def agg21(spark, sf):
    return K.numeric_rows(K.table_cells(table(spark, sf, "search_hit"), "hit_id", "text"), "hit_id")


@query(
    "mth5_union_area",
    """WITH x AS (SELECT artifact_id, page, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM search_hit WHERE bbox IS NOT NULL), e AS (SELECT DISTINCT artifact_id, page, unnest([x0, x1]) AS a FROM x), s AS (SELECT artifact_id, page, a, lead(a) OVER (PARTITION BY artifact_id, page ORDER BY a) AS b FROM e),
    p AS (SELECT s.artifact_id, s.page, a, b, y0, y1, max(y1) OVER (PARTITION BY s.artifact_id, s.page, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s JOIN x ON s.artifact_id = x.artifact_id AND s.page = x.page AND x0 <= a AND x1 >= b AND y1 > y0 WHERE b IS NOT NULL)
    SELECT artifact_id, page, round(coalesce(sum((b - a) * greatest(0.0, y1 - greatest(y0, coalesce(e, y0)))), 0), 6) AS area FROM (SELECT DISTINCT artifact_id, page FROM x) LEFT JOIN p USING (artifact_id, page) GROUP BY 1, 2""",
)
def mth5(spark, sf):
    return K.union_area(table(spark, sf, "search_hit").select("artifact_id", "page", "bbox"), ["artifact_id", "page"], "bbox").withColumn("area", F.round("area", 6))


@query("mth6_union_box", "SELECT artifact_id, page, round((max(bbox.x1) - min(bbox.x0)) * (max(bbox.y1) - min(bbox.y0)), 6) AS area FROM search_hit WHERE bbox IS NOT NULL GROUP BY ALL")
def mth6(spark, sf):
    b = table(spark, sf, "search_hit").filter("bbox is not null").groupBy("artifact_id", "page").agg(F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("b"))
    return b.select("artifact_id", "page", F.round(box_area("b"), 6).alias("area"))


@query("stm1_latest_state_stream", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS entries FROM events GROUP BY 1")
def stm1(spark, sf):
    s = E.latest_states(E.read_log(spark, f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], "event_type")
    return E.drain(s, "latest_state", "complete")


@query("stm_tumbling_batch", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


@query("stm_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
