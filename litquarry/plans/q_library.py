"""Queries of the library: request keys, agencies, versions, listings, captions, attachments, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions import identifiers as I
from litquarry.functions.text import squeeze
from litquarry.operators import library as L
from litquarry.plans.q_functions import NORMAL_DOI
from litquarry.plans.registry import query
from litquarry.session import table


@query("str15_request_keys")
def str15(spark, sf):
    return L.request_keys(table(spark, sf, "paper_request")).select("request_id", "key", "batch_key", "article_id")


@query(
    "prj4_agency_routing",
    f"""WITH n AS (SELECT split_part({NORMAL_DOI}, '/', 1) AS prefix, provider AS agency, count(*) AS n FROM paper_metadata GROUP BY 1, 2), a AS (SELECT prefix, arg_min(agency, (-n, agency)) AS agency FROM n WHERE prefix LIKE '10.%' GROUP BY 1)
    SELECT request_id, coalesce(agency, 'crossref') AS agency FROM (SELECT request_id, split_part({NORMAL_DOI}, '/', 1) AS prefix FROM paper_request WHERE {NORMAL_DOI} IS NOT NULL) LEFT JOIN a USING (prefix)""",
)
def prj4(spark, sf):
    doi = I.normalize_doi(F.col("doi"))
    a = L.agencies(table(spark, sf, "paper_metadata"), doi, "provider")
    q = table(spark, sf, "paper_request").select("request_id", doi.alias("d")).filter("d is not null").select("request_id", F.split_part("d", F.lit("/"), F.lit(1)).alias("prefix"))
    return q.join(a, "prefix", "left").select("request_id", F.coalesce("agency", F.lit("crossref")).alias("agency"))


@query(
    "x30_citation_tokens",
    rf"""WITH t AS (SELECT request_id, coalesce(doi, title) AS x FROM paper_request), p AS (SELECT request_id, x, trim(unnest(string_split_regex(x, '[;\s]+'))) AS doi FROM t WHERE regexp_matches(lower(x), '^(doi:\s*|https?://(dx\.)?doi\.)?10\.'))
    SELECT request_id, CASE WHEN {NORMAL_DOI} IS NULL THEN 'error' ELSE 'doi' END AS token, {NORMAL_DOI} AS doi FROM p WHERE doi <> '' UNION ALL SELECT request_id, 'title', NULL FROM t WHERE x IS NOT NULL AND trim(x) <> '' AND NOT regexp_matches(lower(x), '^(doi:\s*|https?://(dx\.)?doi\.)?10\.')""",
)
def x30(spark, sf):
    """What a line of a list names: a DOI or several, a malformed DOI, or else a title."""
    t = table(spark, sf, "paper_request").select("request_id", F.coalesce("doi", "title").alias("x")).filter("trim(x) <> ''")
    named = F.lower("x").rlike(r"^(doi:\s*|https?://(dx\.)?doi\.)?10\.")
    dois = t.filter(named).select("request_id", F.explode(F.split("x", r"[;\s]+")).alias("p")).filter("trim(p) <> ''").select("request_id", I.normalize_doi(F.col("p")).alias("doi"))
    dois = dois.select("request_id", F.when(F.col("doi").isNull(), "error").otherwise("doi").alias("token"), "doi")
    return dois.unionByName(t.filter(~named).select("request_id", F.lit("title").alias("token"), F.lit(None).cast("string").alias("doi")))


@query("x58_active_version", "SELECT artifact_id, arg_max(hit_id, (hit_id % 50 = 0, parsed_at, hit_id)) AS active, count(DISTINCT parsed_at) AS versions FROM search_hit GROUP BY 1")
def x58(spark, sf):
    """The version in use: one that was pinned, else the newest."""
    pinned = F.struct((F.col("hit_id") % 50 == 0).alias("p"), "parsed_at", "hit_id")
    return table(spark, sf, "search_hit").groupBy("artifact_id").agg(F.max_by("hit_id", pinned).alias("active"), F.count_distinct("parsed_at").alias("versions"))


@query(
    "x32_document_listing",
    "SELECT artifact_id, count(*) AS blocks, count(DISTINCT page) AS pages, max(page) AS last_page, CASE WHEN count(text) = 0 THEN 'FAILED' WHEN count(text) < count(*) THEN 'PARTIAL' ELSE 'PARSED' END AS status, count(*) FILTER (WHERE kind = 'caption') AS captions FROM search_hit GROUP BY 1",
)
def x32(spark, sf):
    g = table(spark, sf, "search_hit").groupBy("artifact_id").agg(F.count("*").alias("blocks"), F.count_distinct("page").alias("pages"), F.max("page").alias("last_page"), F.count("text").alias("_t"), F.count_if(F.col("kind") == "caption").alias("captions"))
    return g.withColumn("status", F.when(F.col("_t") == 0, "FAILED").when(F.col("_t") < F.col("blocks"), "PARTIAL").otherwise("PARSED")).drop("_t")


@query(
    "agg14_output_audit",
    "SELECT kind, count(*) AS total, count(score) AS judged, count(*) FILTER (WHERE score >= 0.5) AS supported, round(count(*) FILTER (WHERE score >= 0.5) / nullif(count(score), 0), 6) AS share FROM search_hit GROUP BY 1",
)
def agg14(spark, sf):
    g = table(spark, sf, "search_hit").groupBy("kind").agg(F.count("*").alias("total"), F.count("score").alias("judged"), F.count_if(F.col("score") >= 0.5).alias("supported"))
    return g.withColumn("share", F.round(F.try_divide(F.col("supported").cast("double"), F.col("judged")), 6))


_KEY = r"lower(regexp_extract(text, '^(?i)(fig(?:ure)?\.?|table|scheme)\s*([0-9]+)', 1)) || regexp_extract(text, '^(?i)(fig(?:ure)?\.?|table|scheme)\s*([0-9]+)', 2)"


@query(
    "win19_captions_once",
    rf"""WITH c AS (SELECT hit_id, artifact_id, page, {_KEY} AS k, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM search_hit WHERE kind = 'caption' AND text IS NOT NULL), x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY artifact_id, page, k ORDER BY length(t) DESC, hit_id) = 1)
    SELECT hit_id FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.artifact_id = x.artifact_id AND y.k = x.k AND abs(y.page - x.page) = 1 AND length(x.t) >= 12 AND contains(y.t, x.t) AND (length(y.t) > length(x.t) OR y.hit_id < x.hit_id))""",
)
def win19(spark, sf):
    label = r"^(?i)(fig(?:ure)?\.?|table|scheme)\s*([0-9]+)"
    c = table(spark, sf, "search_hit").filter("kind = 'caption' and text is not null").select("hit_id", "artifact_id", "page", "text", F.concat(F.lower(F.regexp_extract("text", label, 1)), F.regexp_extract("text", label, 2)).alias("k"))
    return L.told_once(c, "artifact_id", "page", "k", "text", "hit_id").select("hit_id")


@query("prj15_attachments", "SELECT record_id, i AS position, links[i + 1].url AS url, 'FOUND' AS state FROM (SELECT record_id, links, CAST(unnest(range(len(links))) AS INT) AS i FROM paper_metadata) UNION ALL SELECT record_id, -1, NULL, 'PARTIAL' FROM paper_metadata WHERE len(coalesce(links, [])) = 0 OR doi IS NULL")
def prj15(spark, sf):
    complete = (F.size(F.coalesce("links", F.array())) > 0) & F.col("doi").isNotNull()
    return L.attachments(table(spark, sf, "paper_metadata"), "record_id", "links", complete)


@query(
    "x28_quote_spans",
    r"WITH h AS (SELECT hit_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM search_hit WHERE regexp_full_match(text, '[\x21-\x7e\s]+')), q AS (SELECT hit_id, t, string_split(t, '. ')[2] AS quote FROM h) SELECT hit_id, CAST(instr(t, quote) AS INT) AS span_start, CAST(instr(t, quote) + length(quote) - 1 AS INT) AS span_end FROM q WHERE quote <> ''",
)
def x28(spark, sf):
    """Where the second sentence of a block of plain text stands in it, white space squeezed."""
    h = table(spark, sf, "search_hit").filter(F.col("text").rlike(r"^[\x21-\x7e\s]+$")).select("hit_id", squeeze(F.col("text")).alias("t"))
    q = h.withColumn("quote", F.get(F.split("t", r"\. "), 1)).filter("quote <> ''")
    return q.select("hit_id", F.instr("t", F.col("quote")).alias("span_start"), (F.instr("t", F.col("quote")) + F.length("quote") - 1).alias("span_end"))


@query(
    "x15_article_links",
    rf"SELECT record_id, u AS url FROM (SELECT record_id, {NORMAL_DOI} AS d, unnest(links).url AS u FROM paper_metadata) WHERE contains(lower(u), d) AND NOT regexp_matches(u, '(?i)(?:\.pdf(?:$|[?#;])|/pdf(?:/|$|[?#])|/epdf/|[?&](?:format|type|download)=pdf)')",
)
def x15(spark, sf):
    """Links that carry the record's own DOI and are no files."""
    t = table(spark, sf, "paper_metadata").select("record_id", I.normalize_doi(F.col("doi")).alias("d"), F.explode("links.url").alias("url"))
    return t.filter(F.lower("url").contains(F.col("d")) & ~I.looks_like_pdf_url(F.col("url"))).select("record_id", "url")


@query("x12_direct_files", "SELECT page_id, final_url AS url, 'DIRECT_PDF_RESPONSE' AS method FROM retrieved_page WHERE is_pdf_response AND regexp_matches(final_url, '^(?i)https?://')")
def x12(spark, sf):
    """Pages whose answer was the file itself become routes of their own."""
    return table(spark, sf, "retrieved_page").filter(F.col("is_pdf_response") & F.col("final_url").rlike("^(?i)https?://")).select("page_id", F.col("final_url").alias("url"), F.lit("DIRECT_PDF_RESPONSE").alias("method"))


@query(
    "x4_supplement_candidates",
    "WITH l AS (SELECT record_id, i, links[i + 1].url AS u FROM (SELECT record_id, links, unnest(range(len(links))) AS i FROM paper_metadata)), k AS (SELECT DISTINCT final_url AS u FROM retrieved_page WHERE final_url IS NOT NULL) SELECT record_id, u AS url, row_number() OVER (PARTITION BY record_id ORDER BY i) AS n FROM l WHERE u IS NOT NULL AND u NOT IN (SELECT u FROM k) QUALIFY n <= 4",
)
def x4(spark, sf):
    """Links that no page was fetched from, the first four of a record."""
    from litquarry.operators.aggregates import occurrence

    t = table(spark, sf, "paper_metadata").select("record_id", F.posexplode("links.url").alias("i", "url")).filter("url is not null")
    t = t.join(table(spark, sf, "retrieved_page").select(F.col("final_url").alias("url")).filter("url is not null"), "url", "left_anti")
    return occurrence(t, ["record_id"], ["i"]).filter("occurrence <= 4").select("record_id", "url", F.col("occurrence").cast("bigint").alias("n"))
