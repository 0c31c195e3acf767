"""Queries for projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions import identifiers as I
from litquarry.functions import text as T
from litquarry.plans.registry import query
from litquarry.session import table

_BARE = r"regexp_replace(trim(doi), '^(?i)(?:doi\s*[:：]\s*|(?:https?://)?(?:dx\.)?doi\.(?:org|example)/+)', '')"
# The normal form of a column doi.
NORMAL_DOI = rf"CASE WHEN regexp_full_match({_BARE}, '10\.[0-9]{{4,9}}/[-._;()/:<>#?A-Za-z0-9]+') THEN lower({_BARE}) END"
DOI_SQL = r"""CASE WHEN regexp_full_match(d, '10\.[0-9]{4,9}/[-._;()/:<>#?A-Za-z0-9]+') THEN lower(d) END"""


@query("str1_normalize_doi", rf"SELECT record_id, {DOI_SQL} AS doi_norm FROM (SELECT record_id, regexp_replace(trim(doi), '^(?i)(?:doi\s*[:：]\s*|(?:https?://)?(?:dx\.)?doi\.(?:org|example)/+)', '') AS d FROM paper_metadata)")
def str1(spark, sf):
    return table(spark, sf, "paper_metadata").select("record_id", I.normalize_doi(F.col("doi")).alias("doi_norm"))


@query("str2_looks_like_doi", r"SELECT record_id, regexp_full_match(doi, '10\.[0-9]{4,9}/[-._;()/:<>#?A-Za-z0-9]+') AND NOT regexp_matches(doi, '[.,;，。；]$') AS bare FROM paper_metadata")
def str2(spark, sf):
    return table(spark, sf, "paper_metadata").select("record_id", I.looks_like_doi(F.col("doi")).alias("bare"))


@query("str3_extract_dois", r"""SELECT DISTINCT doc_id, lower(regexp_replace(regexp_replace(x, '[.,;)]+$', ''), '^(?i)https?://(?:dx\.)?doi\.org/', '')) AS doi FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '，。；、！？（）【】《》“”‘’：…', repeat(' ', 18)), '(?:^|[^A-Za-z0-9_/])(10\.[0-9]{4,9}/[-._;()/:<>#?A-Za-z0-9]+)', 1)) AS x FROM documents)""")
def str3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(I.extract_dois(F.col("text"))).alias("doi"))


@query("str5_distinct_dois", rf"SELECT doi_norm, min(record_id) AS first_record FROM (SELECT record_id, {DOI_SQL} AS doi_norm FROM (SELECT record_id, regexp_replace(trim(doi), '^(?i)(?:doi\s*[:：]\s*|(?:https?://)?(?:dx\.)?doi\.(?:org|example)/+)', '') AS d FROM paper_metadata)) WHERE doi_norm IS NOT NULL GROUP BY 1")
def str5(spark, sf):
    d = table(spark, sf, "paper_metadata").select("record_id", I.normalize_doi(F.col("doi")).alias("doi_norm")).filter("doi_norm is not null")
    return d.groupBy("doi_norm").agg(F.min("record_id").alias("first_record"))


@query("str6_canonical_url", r"SELECT page_id, lower(regexp_extract(final_url, '^(https?)://([^/?#]+)([^#]*)', 1)) || '://' || lower(regexp_extract(final_url, '^(https?)://([^/?#]+)([^#]*)', 2)) || regexp_extract(final_url, '^(https?)://([^/?#]+)([^#]*)', 3) AS url FROM retrieved_page")
def str6(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", I.canonical_url(F.col("final_url")).alias("url"))


@query("str8_https_alternative", "SELECT page_id, CASE WHEN requested_url LIKE 'http://%' THEN 'https://' || substr(requested_url, 8) END AS alternative FROM retrieved_page")
def str8(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", I.https_alternative(F.col("requested_url")).alias("alternative"))


@query("str9_host_type", r"""SELECT record_id, CASE WHEN h IN ('doi.org','www.doi.org','dx.doi.org','hdl.handle.net','handle.net') THEN 'resolver' WHEN h IN ('pubmed.ncbi.nlm.nih.gov','doaj.org','www.doaj.org') THEN 'index' WHEN h = 'pmc.ncbi.nlm.nih.gov' THEN 'repository' ELSE 'publisher' END AS host_type FROM (SELECT record_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM paper_metadata)""")
def str9(spark, sf):
    return table(spark, sf, "paper_metadata").select("record_id", I.host_type(F.coalesce("url", F.lit("")), F.lit("publisher")).alias("host_type"))


@query("str10_redact_url", r"SELECT page_id, regexp_replace(regexp_replace(final_url, '#.*$', ''), '([?&][^=&#]*)=[^&#]*', '\1=%5Bredacted%5D', 'g') AS url FROM retrieved_page")
def str10(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", I.redact_url(F.col("final_url")).alias("url"))


@query("str11_compact_key", r"SELECT record_id, regexp_replace(lower(journal), '[^\p{L}\p{N}]', '', 'g') AS journal_key FROM paper_metadata")
def str11(spark, sf):
    return table(spark, sf, "paper_metadata").select("record_id", I.compact_key(F.col("journal")).alias("journal_key"))


@query("str12_field_key", r"SELECT request_id, CASE WHEN regexp_full_match(k, '[0-9]+') THEN regexp_replace(k, '^0+([0-9])', '\1') ELSE k END AS issue_key FROM (SELECT request_id, regexp_replace(lower(issue), '[^\p{L}\p{N}]', '', 'g') AS k FROM paper_request)")
def str12(spark, sf):
    return table(spark, sf, "paper_request").select("request_id", I.field_key(F.col("issue")).alias("issue_key"))


@query("str13_journal_aliases", r"""SELECT journal, list_aggregate(list_sort(list_distinct(list_filter([trim(journal), trim(regexp_extract(journal, '^([^(（]+)[(（]([^)）]+)[)）]\s*$', 1)), trim(regexp_extract(journal, '^([^(（]+)[(（]([^)）]+)[)）]\s*$', 2))], lambda x: x <> ''))), 'string_agg', '|') AS aliases FROM (SELECT DISTINCT journal FROM paper_metadata WHERE journal IS NOT NULL)""")
def str13(spark, sf):
    j = table(spark, sf, "paper_metadata").select("journal").filter("journal is not null").distinct()
    return j.select("journal", F.array_join(F.array_sort(I.journal_aliases(F.col("journal"))), "|").alias("aliases"))


@query(
    "str14_field_match",
    rf"""WITH q AS (SELECT request_id, {NORMAL_DOI} AS d, volume AS v, pages AS p FROM paper_request), m AS (SELECT record_id, {NORMAL_DOI} AS d, volume AS w, pages AS r FROM paper_metadata)
    SELECT request_id, record_id, regexp_replace(v, '^0+([0-9])', '\1') = regexp_replace(w, '^0+([0-9])', '\1') AS volume_match, regexp_extract(p, '([0-9]+)', 1) = regexp_extract(r, '([0-9]+)', 1) AS page_match FROM q JOIN m USING (d)""",
)
def str14(spark, sf):
    q = table(spark, sf, "paper_request").select("request_id", I.normalize_doi(F.col("doi")).alias("d"), F.col("volume").alias("v"), F.col("pages").alias("p"))
    m = table(spark, sf, "paper_metadata").select("record_id", I.normalize_doi(F.col("doi")).alias("d"), F.col("volume").alias("w"), F.col("pages").alias("r"))
    return q.join(m, "d").select("request_id", "record_id", (I.field_key(F.col("v")) == I.field_key(F.col("w"))).alias("volume_match"), (I.first_page(F.col("p")) == I.first_page(F.col("r"))).alias("page_match"))


@query("str16_title_key", r"SELECT request_id, trim(regexp_replace(regexp_replace(lower(title), '</?[a-z]{1,8}(?:\s[^>]*)?/?>', '', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title_key FROM paper_request")
def str16(spark, sf):
    return table(spark, sf, "paper_request").select("request_id", T.title_key(F.col("title")).alias("title_key"))


@query("str17_search_text")
def str17(spark, sf):
    return table(spark, sf, "search_hit").select("hit_id", T.search_text(F.col("text")).alias("view"))


@query(
    "str21_furniture_key",
    r"SELECT fragment_id, trim(regexp_replace(regexp_replace(lower(text), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[0-9]+', '#', 'g')) AS line_key FROM fragment WHERE text IS NOT NULL",
)
def str21(spark, sf):
    return table(spark, sf, "fragment").filter("text is not null").select("fragment_id", T.furniture_key(F.col("text")).alias("line_key"))


@query("str22_quotation", r"SELECT hit_id, trim(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS quotation FROM search_hit")
def str22(spark, sf):
    return table(spark, sf, "search_hit").select("hit_id", T.quotation(F.col("text")).alias("quotation"))


@query("str25_number_signature", r"SELECT hit_id, array_to_string(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1), ' ') AS numbers FROM search_hit WHERE text IS NOT NULL")
def str25(spark, sf):
    return table(spark, sf, "search_hit").filter("text is not null").select("hit_id", F.array_join(T.number_signature(F.col("text")), " ").alias("numbers"))


@query("str30_suspicious_ratio", r"SELECT fragment_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{e000}-\x{f8ff}]', '', 'g')) / length(text), 6) END AS suspicious FROM fragment WHERE text IS NOT NULL")
def str30(spark, sf):
    return table(spark, sf, "fragment").filter("text is not null").select("fragment_id", F.round(T.suspicious_ratio(F.col("text")), 6).alias("suspicious"))


@query("str31_cjk_title", r"SELECT record_id, regexp_matches(title, '[\x{3400}-\x{9fff}]') AS cjk FROM paper_metadata")
def str31(spark, sf):
    return table(spark, sf, "paper_metadata").select("record_id", T.contains_cjk(F.col("title")).alias("cjk"))


@query("mth1_issn_checksum", """WITH x AS (SELECT record_id, unnest(issn) AS issn FROM paper_metadata), d AS (SELECT record_id, issn, regexp_replace(upper(trim(issn)), '[^0-9X]', '', 'g') AS s FROM x) SELECT record_id, issn, CASE WHEN NOT regexp_full_match(s, '[0-9]{7}[0-9X]') THEN false ELSE (8*s[1]::INT + 7*s[2]::INT + 6*s[3]::INT + 5*s[4]::INT + 4*s[5]::INT + 3*s[6]::INT + 2*s[7]::INT + CASE WHEN s[8] = 'X' THEN 10 ELSE s[8]::INT END) % 11 = 0 END AS valid FROM d WHERE issn IS NOT NULL""")
def mth1(spark, sf):
    x = table(spark, sf, "paper_metadata").select("record_id", F.explode("issn").alias("issn")).filter("issn is not null")
    return x.select("record_id", "issn", I.issn_valid(F.col("issn")).alias("valid"))


@query("mth2_null_safe_ratio", "SELECT lang, round(sum(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN n_chars > 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS long_share FROM documents GROUP BY lang")
def mth2(spark, sf):
    from litquarry.operators.aggregates import ratio

    return table(spark, sf, "documents").groupBy("lang").agg(ratio(F.count_if(F.col("n_chars") > 1000), F.count_if(F.col("n_chars") > 0)).alias("long_share"))


@query("mth9_token_estimate", "SELECT artifact_id, CAST(ceil(sum(length(text)) / 3.0) AS BIGINT) AS tokens FROM search_hit WHERE text IS NOT NULL GROUP BY artifact_id")
def mth9(spark, sf):
    return table(spark, sf, "search_hit").filter("text is not null").groupBy("artifact_id").agg(F.ceil(F.sum(F.length("text")) / 3.0).cast("bigint").alias("tokens"))


@query("mth11_page_range", r"SELECT record_id, TRY_CAST(regexp_extract(pages, '([0-9]+)', 1) AS INT) AS first_page, coalesce(TRY_CAST(regexp_extract(pages, '[0-9]+\s*[-–—]\s*([0-9]+)', 1) AS INT), TRY_CAST(regexp_extract(pages, '([0-9]+)', 1) AS INT)) AS last_page FROM paper_metadata")
def mth11(spark, sf):
    r = I.page_range(F.col("pages"))
    return table(spark, sf, "paper_metadata").select("record_id", r["first"].alias("first_page"), r["last"].alias("last_page"))


@query("prj2_partial_date", r"SELECT record_id, TRY_CAST(substr(published_date, 1, 4) AS INT) AS year, CASE WHEN length(published_date) >= 7 THEN TRY_CAST(substr(published_date, 6, 2) AS INT) END AS month, CASE length(published_date) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' END AS precision FROM paper_metadata")
def prj2(spark, sf):
    d = F.col("published_date")
    return table(spark, sf, "paper_metadata").select("record_id", F.substring(d, 1, 4).try_cast("int").alias("year"), F.when(F.length(d) >= 7, F.substring(d, 6, 2).try_cast("int")).alias("month"), F.when(F.length(d) == 4, "year").when(F.length(d) == 7, "month").when(F.length(d) == 10, "day").alias("precision"))


@query("prj7_deposited_links", "SELECT record_id, l.url AS url, CASE WHEN l.content_type = 'application/pdf' THEN 'pdf' WHEN l.content_type LIKE 'text/html%' THEN 'landing' ELSE 'unknown' END AS url_type FROM (SELECT record_id, unnest(links) AS l FROM paper_metadata) WHERE l.url IS NOT NULL")
def prj7(spark, sf):
    x = table(spark, sf, "paper_metadata").select("record_id", F.explode("links").alias("l")).filter("l.url is not null")
    return x.select("record_id", "l.url", F.when(F.col("l.content_type") == "application/pdf", "pdf").when(F.col("l.content_type").startswith("text/html"), "landing").otherwise("unknown").alias("url_type"))


@query(
    "prj9_fallback_projection",
    rf"""SELECT r.request_id, coalesce(nullif(trim(m.journal), ''), nullif(trim(r.journal), ''), '') AS journal, coalesce(m.year, r.year) AS year, coalesce(nullif(trim(m.title), ''), nullif(trim(r.title), ''), r.filename, '') AS title
    FROM (SELECT *, {NORMAL_DOI} AS d FROM paper_request) r LEFT JOIN (SELECT {NORMAL_DOI} AS d, arg_min(journal, record_id) AS journal, min(year) AS year, arg_min(title, record_id) AS title FROM paper_metadata GROUP BY 1) m ON r.d = m.d""",
)
def prj9(spark, sf):
    """Fields of the registry, else of the request, else the file name."""
    m = table(spark, sf, "paper_metadata").groupBy(I.normalize_doi(F.col("doi")).alias("d"))
    m = m.agg(F.min_by("journal", F.when(F.col("journal").isNotNull(), F.col("record_id"))).alias("mj"), F.min("year").alias("my"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("record_id"))).alias("mt"))
    r = table(spark, sf, "paper_request").withColumn("d", I.normalize_doi(F.col("doi")))
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return r.join(m, "d", "left").select("request_id", F.coalesce(full(F.col("mj")), full(F.col("journal")), F.lit("")).alias("journal"), F.coalesce("my", "year").alias("year"), F.coalesce(full(F.col("mt")), full(F.col("title")), "filename", F.lit("")).alias("title"))


@query("prj17_file_name", r"SELECT record_id, concat_ws('-', coalesce(CAST(year AS VARCHAR), 'nd'), coalesce(nullif(left(trim(regexp_replace(regexp_replace(lower(journal), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 40), ''), 'unknown')) || '--' || left(sha256(coalesce(doi, '')), 12) AS stem FROM paper_metadata")
def prj17(spark, sf):
    part = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower("journal"), "[^a-z0-9]+", "-"), "^-+|-+$", "")), 1, 40)
    return table(spark, sf, "paper_metadata").select("record_id", F.concat(F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit("-"), F.coalesce(F.when(part != "", part), F.lit("unknown")), F.lit("--"), F.substring(F.sha2(F.coalesce("doi", F.lit("")), 256), 1, 12)).alias("stem"))


@query("flt1_folder_subtree", "SELECT request_id FROM paper_request WHERE folder = 'review' OR folder LIKE 'review/%'")
def flt1(spark, sf):
    return table(spark, sf, "paper_request").filter((F.col("folder") == "review") | F.col("folder").startswith("review/")).select("request_id")


@query("flt2_tags_all_any", "SELECT request_id, list_has_all(tags, ['compare', 'dataset']) AS has_all, list_has_any(tags, ['urgent', 'scan']) AS has_any FROM paper_request WHERE tags IS NOT NULL")
def flt2(spark, sf):
    t = table(spark, sf, "paper_request").filter("tags is not null")
    return t.select("request_id", (F.size(F.array_except(F.array(F.lit("compare"), F.lit("dataset")), "tags")) == 0).alias("has_all"), F.arrays_overlap("tags", F.array(F.lit("urgent"), F.lit("scan"))).alias("has_any"))


@query("flt3_metadata_query", "SELECT record_id FROM paper_metadata WHERE instr(lower(concat_ws(' ', title, journal, publisher, doi)), 'membran') > 0")
def flt3(spark, sf):
    return table(spark, sf, "paper_metadata").filter(F.instr(F.lower(F.concat_ws(" ", "title", "journal", "publisher", "doi")), "membran") > 0).select("record_id")


@query("flt7_unsafe_folder", r"SELECT request_id, regexp_matches(folder, '^\s*$|^[/\\]|^[A-Za-z]:|(?:^|[/\\])\.{1,2}(?:[/\\]|$)|[<>:\"|?*]') AS unsafe FROM paper_request")
def flt7(spark, sf):
    return table(spark, sf, "paper_request").select("request_id", I.unsafe_folder(F.col("folder")).alias("unsafe"))


@query("flt8_public_host", r"SELECT page_id, h <> '' AND NOT regexp_full_match(h, 'localhost|.*\.localhost|.*\.local|.*\.internal|10\..*|127\..*|192\.168\..*') AS public_host FROM (SELECT page_id, lower(regexp_extract(final_url, '^https?://([^/?#:]+)', 1)) AS h FROM retrieved_page)")
def flt8(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", I.public_host(F.col("final_url")).alias("public_host"))


@query("x9_pdf_like_url", r"SELECT page_id, regexp_matches(lower(final_url), '\.pdf(?:$|[?#;])|/pdf(?:/|$|[?#])|/epdf/|[?&](?:format|type|download)=pdf') AS pdf_like FROM retrieved_page")
def x9(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", I.looks_like_pdf_url(F.col("final_url")).alias("pdf_like"))


@query("arr2_tag_edit", "SELECT request_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(tags, ['checked']), lambda x: x <> 'urgent'))), '|') AS tags FROM paper_request WHERE tags IS NOT NULL")
def arr2(spark, sf):
    t = table(spark, sf, "paper_request").filter("tags is not null")
    return t.select("request_id", F.array_join(F.array_sort(F.array_distinct(F.array_except(F.concat("tags", F.array(F.lit("checked"))), F.array(F.lit("urgent"))))), "|").alias("tags"))


@query("arr5_citation_labels", r"""WITH x AS (SELECT hit_id, unnest(regexp_extract_all(text, '\[[0-9][0-9,; –-]*\]')) AS c FROM search_hit), p AS (SELECT hit_id, unnest(regexp_split_to_array(regexp_replace(c, '[\[\]\s]', '', 'g'), '[,;]')) AS q FROM x), r AS (SELECT hit_id, CAST(regexp_extract(q, '^([0-9]+)', 1) AS INT) AS a, coalesce(TRY_CAST(nullif(regexp_extract(q, '^[0-9]+[-–—]([0-9]+)$', 1), '') AS INT), CAST(regexp_extract(q, '^([0-9]+)', 1) AS INT)) AS b FROM p WHERE regexp_full_match(q, '[0-9]+(?:[-–—][0-9]+)?')) SELECT DISTINCT hit_id, CAST(unnest(range(a, b + 1)) AS INT) AS label FROM r WHERE b >= a AND b - a < 25""")
def arr5(spark, sf):
    x = table(spark, sf, "search_hit").select("hit_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\[[0-9][0-9,; –-]*\])"), F.lit(1))).alias("c"))
    return x.select("hit_id", F.explode(T.citation_labels(F.col("c"))).alias("label")).distinct()


@query("arr9_canonical_digest", """SELECT r_regionkey, sha256('{"name":"' || r_name || '","region":' || r_regionkey || '}') AS digest FROM region""")
def arr9(spark, sf):
    from litquarry.functions.digest import canonical_digest

    return table(spark, sf, "region").select("r_regionkey", canonical_digest(F.to_json(F.struct(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name")))).alias("digest"))


@query("snk5_csv_guard", r"SELECT record_id, CASE WHEN regexp_matches(ltrim(title), '^[=+\-@]') THEN '''' || title ELSE title END AS cell FROM paper_metadata")
def snk5(spark, sf):
    return table(spark, sf, "paper_metadata").select("record_id", T.csv_guard(F.col("title")).alias("cell"))


@query("str26_title_similarity")
def str26(spark, sf):
    q = table(spark, sf, "paper_request").filter("title is not null").select("request_id", I.normalize_doi(F.col("doi")).alias("d"), F.col("title").alias("asked"))
    m = table(spark, sf, "paper_metadata").filter("title is not null").select("record_id", I.normalize_doi(F.col("doi")).alias("d"), "title")
    return q.join(m, "d").select("request_id", "record_id", F.round(T.similarity(F.lower("asked"), F.lower("title")), 6).alias("similarity"))


@query("str28_edit_counts")
def str28(spark, sf):
    q = table(spark, sf, "paper_request").filter("doi like '10.%' and title is not null").select("request_id", F.lower("doi").alias("d"), F.col("title").alias("asked"))
    m = table(spark, sf, "paper_metadata").filter("doi like '10.%' and title is not null").groupBy(F.lower("doi").alias("d")).agg(F.min_by("title", "record_id").alias("title"))
    return q.join(m, "d").withColumn("e", T.edit_counts("title", "asked")).select("request_id", "e.deletions", "e.insertions", "e.substitutions")
