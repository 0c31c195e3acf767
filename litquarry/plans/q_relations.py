"""Queries for candidates, search, joins, aggregates, windows, set operations and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from litquarry.functions import identifiers as I
from litquarry.functions import text as T
from litquarry.operators import aggregates as A
from litquarry.operators import candidates as C
from litquarry.operators import joins as J
from litquarry.operators import search as S
from litquarry.operators import versions as V
from litquarry.operators import windows as W
from litquarry.functions import access as AC
from litquarry.plans.q_states import dealt, sql_dealt
from litquarry.plans.registry import query
from litquarry.session import table

# --- candidates -------------------------------------------------------------------------------------------------------------

CANDIDATES_SQL = """(SELECT lower(doi) AS doi, l.url AS url, record_id AS position, provider, CASE WHEN provider IN ('openalex', 'crossref') THEN 'open' ELSE 'unknown' END AS access_type, CASE WHEN l.content_type = 'application/pdf' THEN 'pdf' ELSE 'landing' END AS url_type, CASE provider WHEN 'crossref' THEN 'published' WHEN 'openalex' THEN 'accepted' WHEN 'datacite' THEN 'submitted' ELSE 'unknown' END AS version, CASE provider WHEN 'crossref' THEN 'publisher' WHEN 'cnki' THEN 'index' ELSE 'repository' END AS host_type, work_type = 'journal-article' AS is_best, work_type AS license, publisher AS source_name FROM (SELECT *, unnest(links) AS l FROM paper_metadata) WHERE l.url IS NOT NULL AND doi IS NOT NULL)"""


def candidates(spark, sf):
    m = table(spark, sf, "paper_metadata").filter("doi is not null").withColumn("l", F.explode("links")).filter("l.url is not null")
    p = F.col("provider")
    return m.select(
        F.lower("doi").alias("doi"),
        F.col("l.url").alias("url"),
        F.col("record_id").alias("position"),
        "provider",
        F.when(p.isin("openalex", "crossref"), "open").otherwise("unknown").alias("access_type"),
        F.when(F.col("l.content_type") == "application/pdf", "pdf").otherwise("landing").alias("url_type"),
        F.when(p == "crossref", "published").when(p == "openalex", "accepted").when(p == "datacite", "submitted").otherwise("unknown").alias("version"),
        F.when(p == "crossref", "publisher").when(p == "cnki", "index").otherwise("repository").alias("host_type"),
        (F.col("work_type") == "journal-article").alias("is_best"),
        F.col("work_type").alias("license"),
        F.col("publisher").alias("source_name"),
    )


KEY_SQL = "(CASE WHEN access_type = 'open' THEN 1 ELSE 0 END, CASE WHEN url_type = 'pdf' THEN 1 ELSE 0 END, CASE version WHEN 'published' THEN 3 WHEN 'accepted' THEN 2 WHEN 'submitted' THEN 1 ELSE 0 END, CASE host_type WHEN 'publisher' THEN 4 WHEN 'repository' THEN 3 WHEN 'resolver' THEN 2 WHEN 'index' THEN 1 ELSE 0 END, CASE WHEN is_best THEN 1 ELSE 0 END)"


@query("agg1_candidate_merge", f"""WITH c AS {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doi, url ORDER BY {KEY_SQL} DESC, position) AS n FROM c), g AS (SELECT doi, url, CASE WHEN count(DISTINCT nullif(trim(license), '')) = 1 THEN min(nullif(trim(license), '')) END AS license, CASE WHEN count(DISTINCT nullif(trim(source_name), '')) = 1 THEN min(nullif(trim(source_name), '')) END AS source_name, bool_or(coalesce(is_best, false)) AS is_best FROM c GROUP BY ALL), f AS (SELECT doi, url, string_agg(provider, ',' ORDER BY p) AS providers FROM (SELECT doi, url, provider, min(position) AS p FROM c GROUP BY ALL) GROUP BY ALL) SELECT r.doi, r.url, r.access_type, r.url_type, r.version, r.host_type, f.providers, g.license, g.source_name, g.is_best FROM r JOIN g USING (doi, url) JOIN f USING (doi, url) WHERE n = 1""")
def agg1(spark, sf):
    return C.merge_candidates(candidates(spark, sf)).withColumn("providers", F.array_join("providers", ","))


@query("srt1_candidate_rank", f"WITH c AS {CANDIDATES_SQL}, m AS (SELECT doi, url, max({KEY_SQL}) AS k FROM c GROUP BY ALL) SELECT doi, url, row_number() OVER (PARTITION BY doi ORDER BY k DESC, url DESC) AS rank FROM m")
def srt1(spark, sf):
    merged = candidates(spark, sf).groupBy("doi", "url").agg(F.max(C.rank_key()).alias("k"))
    from pyspark.sql import Window

    return merged.select("doi", "url", F.row_number().over(Window.partitionBy("doi").orderBy(F.desc("k"), F.desc("url"))).cast("bigint").alias("rank"))


@query("srt6_route_priority", f"SELECT position, url, CAST(CASE host_type WHEN 'repository' THEN 60 WHEN 'publisher' THEN 50 WHEN 'resolver' THEN 20 WHEN 'index' THEN 10 ELSE 0 END + CASE version WHEN 'published' THEN 30 WHEN 'accepted' THEN 20 WHEN 'submitted' THEN 10 ELSE 0 END + CASE WHEN access_type = 'open' THEN 100 ELSE 0 END + CASE WHEN is_best THEN 20 ELSE 0 END + CASE WHEN url LIKE 'https://%' THEN 5 ELSE 0 END AS INT) AS priority FROM {CANDIDATES_SQL}")
def srt6(spark, sf):
    return candidates(spark, sf).select("position", "url", C.route_priority().cast("int").alias("priority"))


@query("agg2_provider_contribution", f"""WITH c AS {CANDIDATES_SQL}, p AS (SELECT doi, url, provider, list_distinct(list(access_type) FILTER (access_type <> 'unknown')) AS a, list_distinct(list(version) FILTER (version <> 'unknown')) AS v, list_distinct(list(license) FILTER (license <> '')) AS l FROM c GROUP BY ALL), w AS (SELECT *, count(*) OVER r AS n, sum(CASE WHEN len(a) > 0 THEN 1 ELSE 0 END) OVER r AS ia, sum(CASE WHEN len(v) > 0 THEN 1 ELSE 0 END) OVER r AS iv, sum(CASE WHEN len(l) > 0 THEN 1 ELSE 0 END) OVER r AS il FROM p WINDOW r AS (PARTITION BY doi, url)) SELECT provider, count(*) AS routes, count(*) FILTER (n = 1) AS unique_routes, count(*) FILTER (n > 1) AS shared_routes, CAST(sum(CASE WHEN n > 1 AND len(a) > 0 AND ia = 1 THEN 1 ELSE 0 END) AS BIGINT) AS exclusive_access_type, CAST(sum(CASE WHEN n > 1 AND len(v) > 0 AND iv = 1 THEN 1 ELSE 0 END) AS BIGINT) AS exclusive_version, CAST(sum(CASE WHEN n > 1 AND len(l) > 0 AND il = 1 THEN 1 ELSE 0 END) AS BIGINT) AS exclusive_license FROM w GROUP BY provider""")
def agg2(spark, sf):
    return C.provider_contribution(candidates(spark, sf)).select("provider", "routes", "unique_routes", "shared_routes", "exclusive_access_type", "exclusive_version", "exclusive_license")


@query("agg2_disagreements")
def agg2_full(spark, sf):
    return C.provider_contribution(candidates(spark, sf))


@query("cls14_batch_status", """WITH r AS (SELECT requested_url AS doi, CASE WHEN http_status >= 500 THEN 'ERROR' WHEN http_status IN (404, 410) THEN 'NOT_FOUND' ELSE 'OK' END AS status, CASE WHEN http_status = 200 THEN 1 ELSE 0 END AS candidates FROM retrieved_page) SELECT doi, CAST(sum(candidates) AS BIGINT) AS candidates, CASE WHEN sum(candidates) > 0 AND bool_or(status = 'ERROR') THEN 'PARTIAL_SUCCESS' WHEN sum(candidates) > 0 THEN 'SUCCESS' WHEN bool_or(status = 'ERROR') THEN 'ERROR' WHEN bool_and(status = 'NOT_FOUND') THEN 'NOT_FOUND' ELSE 'NO_CANDIDATES' END AS status FROM r GROUP BY doi""")
def cls14(spark, sf):
    s = F.col("http_status")
    r = table(spark, sf, "retrieved_page").select(F.col("requested_url").alias("doi"), F.when(s >= 500, "ERROR").when(s.isin(404, 410), "NOT_FOUND").otherwise("OK").alias("status"), F.when(s == 200, 1).otherwise(0).alias("candidates"))
    return C.batch_status(r)


@query("win16_first_success", "WITH s AS (SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS stop FROM orders GROUP BY 1) SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN s USING (o_custkey) WHERE stop IS NULL OR o_orderkey <= stop")
def win16(spark, sf):
    return C.first_success(table(spark, sf, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


# --- search -----------------------------------------------------------------------------------------------------------------

# The search view without look-behind: the same rewrites with captured neighbours.
VIEW_SQL = r"lower(text)"
for _p, _r in [
    (r"([a-z])-\s*\n\s*([a-z])", r"\1\2"),
    (r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
    (None, None),
    (r"([0-9])\s+%", r"\1%"),
    ("[−–—⎯]", "-"),
    (r"([+-])\s+([0-9])", r"\1\2"),
    (r"([0-9])[∙⋅]([0-9])", r"\1.\2"),
    (r"([\x{3400}-\x{9fff}])\s+([\x{3400}-\x{9fff}])", r"\1\2"),
    (r"([\x{3400}-\x{9fff}])\s+([\x{3400}-\x{9fff}])", r"\1\2"),
]:
    VIEW_SQL = f"trim({VIEW_SQL})" if _p is None else f"regexp_replace({VIEW_SQL}, '{_p}', '{_r}', 'g')"


def _score_sql(terms, mode, src="documents", key="doc_id", where="true"):
    hit = [f"CASE WHEN instr(v, '{t}') > 0 THEN 1 ELSE 0 END" for t in terms]
    n = " + ".join(hit)
    met = f"({n}) = {len(terms)}" if mode == "and" else f"({n}) > 0"
    return f"SELECT {key}, round(CASE WHEN instr(v, '{' '.join(terms)}') > 0 THEN 2 ELSE 0 END + ({n}) / {len(terms)}.0 + ({n}) / CAST(greatest(length(v), 1) AS DOUBLE), 6) AS score FROM (SELECT {key}, {VIEW_SQL} AS v FROM {src} WHERE {where}) WHERE {met}"


def _documents_search(spark, sf, q, mode="and", exact=False):
    return S.search(table(spark, sf, "documents").select("doc_id", "text"), "text", q, mode, exact, full=False).select("doc_id", "score")


@query("str20_search_score", _score_sql(["water", "splitting"], "or"))
def str20(spark, sf):
    return _documents_search(spark, sf, "water splitting", "or")


@query("search_and", _score_sql(["chloride", "supplied"], "and"))
def search_and(spark, sf):
    return _documents_search(spark, sf, "chloride supplied")


@query("search_phrase", _score_sql(["heat release", "ferrite"], "and"))
def search_phrase(spark, sf):
    return _documents_search(spark, sf, '"heat release" ferrite')


@query("search_exact", _score_sql(["dissolved organic carbon"], "and"))
def search_exact(spark, sf):
    return _documents_search(spark, sf, "dissolved organic carbon", exact=True)


@query(
    "search_numeric",
    rf"SELECT doc_id, round(2 + 1 + 1 / CAST(length(v) AS DOUBLE), 6) AS score FROM (SELECT doc_id, {VIEW_SQL} AS v FROM documents) WHERE regexp_matches(v, '(^|[^0-9.])95%($|[^0-9.]|\.($|[^0-9]))')",
)
def search_numeric(spark, sf):
    """A number matches whole magnitudes only."""
    return _documents_search(spark, sf, "95 %".replace(" ", ""), "or")


@query("search_full_view")
def search_full_view(spark, sf):
    return S.search(table(spark, sf, "search_hit").select("hit_id", "text"), "text", "catalyst dissolution").select("hit_id", "score")


@query("srt2_ranked_hits", f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_score_sql(['water', 'splitting'], 'or')}) ORDER BY score DESC, doc_id LIMIT 50")
def srt2(spark, sf):
    return S.top(_documents_search(spark, sf, "water splitting", "or"), 50, [F.desc("score"), F.col("doc_id")]).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "srt2_corpus_hits",
    f"""WITH h AS (SELECT doc_id, score, coalesce(artifact_id, '') AS title, md5(text) AS h, coalesce(section, '') AS section FROM ({_score_sql(['water', 'splitting'], 'or')}) JOIN documents USING (doc_id)), r AS (SELECT *, min(doc_id) OVER (PARTITION BY h) <> doc_id AS repeated FROM h)
    SELECT doc_id, repeated, score, row_number() OVER (ORDER BY repeated, score DESC, title, h, section, doc_id) AS rank FROM r QUALIFY rank <= 100""",
)
def srt2_corpus(spark, sf):
    """Hits in the order of a corpus: repeated readings last, then score, title, file, place and id."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.coalesce("artifact_id", F.lit("")).alias("title"), F.coalesce("section", F.lit("")).alias("section"))
    hits = S.search(d, "text", "water splitting", "or", full=False).withColumn("h", F.md5("text")).drop("text")
    first = hits.groupBy("h").agg(F.min("doc_id").alias("first"))
    hits = hits.join(first, "h").withColumn("repeated", F.col("doc_id") != F.col("first"))
    order = [F.col("repeated"), F.desc("score"), F.col("title"), F.col("h"), F.col("section"), F.col("doc_id")]
    return S.top(hits, 100, order).select("doc_id", "repeated", "score", F.col("rank").cast("bigint").alias("rank"))


@query("srt8_search_page", f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_score_sql(['water', 'splitting'], 'or')}) QUALIFY rank > 40 AND rank <= 60")
def srt8(spark, sf):
    return S.top(_documents_search(spark, sf, "water splitting", "or"), 20, [F.desc("score"), F.col("doc_id")], offset=40).withColumn("rank", F.col("rank").cast("bigint"))


@query("flt6_scope_excluded", "SELECT hit_id, CASE WHEN text IS NULL THEN 'no text' ELSE 'kind ' || kind END AS reason FROM search_hit WHERE NOT coalesce(kind IN ('paragraph', 'caption') AND text IS NOT NULL, false)")
def flt6(spark, sf):
    _, out = S.scope(table(spark, sf, "search_hit"), F.col("kind").isin("paragraph", "caption") & F.col("text").isNotNull(), F.when(F.col("text").isNull(), "no text").otherwise(F.concat(F.lit("kind "), "kind")))
    return out.select("hit_id", "reason")


@query("srt3_artifact_hits", "SELECT artifact_id, hit_id, n AS rank FROM (SELECT artifact_id, hit_id, row_number() OVER (PARTITION BY artifact_id ORDER BY score DESC NULLS LAST, page, block_id, hit_id) AS n FROM search_hit) WHERE n <= 3")
def srt3(spark, sf):
    return A.occurrence(table(spark, sf, "search_hit"), ["artifact_id"], [F.desc_nulls_last("score"), "page", "block_id", "hit_id"]).filter("occurrence <= 3").select("artifact_id", "hit_id", F.col("occurrence").cast("bigint").alias("rank"))


@query("win2_context_window")
def win2(spark, sf):
    b = table(spark, sf, "search_hit").filter("text is not null").select("artifact_id", "page", "hit_id", "kind", "text")
    return S.context_window(b, "artifact_id", "hit_id", eligible=F.col("kind") == "paragraph")


@query("jn15_hidden_subsets", """WITH h AS (SELECT artifact_id, page, CASE WHEN page % 3 = 0 THEN 'context' ELSE 'block' END AS kind, list(hit_id) AS blocks FROM search_hit GROUP BY artifact_id, page, 3), b AS (SELECT artifact_id, page, kind, len(blocks) AS n, unnest(blocks) AS b FROM h) SELECT artifact_id, page FROM h WHERE NOT EXISTS (SELECT 1 FROM h d WHERE d.artifact_id = h.artifact_id AND h.kind = 'context' AND d.kind <> 'context' AND list_has_all(d.blocks, h.blocks))""")
def jn15(spark, sf):
    h = table(spark, sf, "search_hit").groupBy("artifact_id", "page").agg(F.collect_list("hit_id").alias("blocks")).withColumn("kind", F.when(F.col("page") % 3 == 0, "context").otherwise("block"))
    return S.hide_subsets(h, "artifact_id", "page", "kind", "blocks").select("artifact_id", "page")


# --- joins ------------------------------------------------------------------------------------------------------------------


@query("jn1_hit_config", "SELECT hit_id, label, max_characters FROM search_hit JOIN chunk_config USING (config_id)")
def jn1(spark, sf):
    return table(spark, sf, "search_hit").join(table(spark, sf, "chunk_config"), "config_id").select("hit_id", "label", "max_characters")


@query("jn2_unparsed_pages", "SELECT page_id FROM retrieved_page p WHERE NOT EXISTS (SELECT 1 FROM parsed_html h WHERE h.page_id = p.page_id)")
def jn2(spark, sf):
    return table(spark, sf, "retrieved_page").join(table(spark, sf, "parsed_html"), "page_id", "left_anti").select("page_id")


@query("jn3_exactly_one", "WITH m AS (SELECT lower(doi) AS d, count(*) AS n, min(record_id) AS r FROM paper_metadata WHERE doi IS NOT NULL GROUP BY 1) SELECT request_id, lower(q.doi) AS d, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN r END AS parent FROM paper_request q LEFT JOIN m ON lower(q.doi) = m.d WHERE q.doi IS NOT NULL")
def jn3(spark, sf):
    q = table(spark, sf, "paper_request").filter("doi is not null").select("request_id", F.lower("doi").alias("d"))
    m = table(spark, sf, "paper_metadata").filter("doi is not null").select("record_id", F.lower("doi").alias("d"))
    return J.exactly_one(q, m, ["d"], "request_id", "record_id")


@query("jn4_owner", "SELECT o.o_orderkey, coalesce(c.c_custkey, -o.o_orderkey) AS owner FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def jn4(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_custkey", -F.col("o_orderkey")).alias("owner"))


@query("jn7_quote_containment", "WITH q AS (SELECT hit_id AS quote_id, artifact_id, substr(text, 1, 40) AS quote FROM search_hit WHERE kind = 'paragraph' AND length(text) >= 60) SELECT quote_id, hit_id FROM (SELECT quote_id, hit_id, row_number() OVER (PARTITION BY quote_id ORDER BY hit_id) AS n FROM q JOIN search_hit h USING (artifact_id) WHERE instr(h.text, q.quote) > 0) WHERE n <= 3")
def jn7(spark, sf):
    h = table(spark, sf, "search_hit").select("hit_id", "artifact_id", "kind", "text")
    q = h.filter((F.col("kind") == "paragraph") & (F.length("text") >= 60)).select(F.col("hit_id").alias("quote_id"), "artifact_id", F.substring("text", 1, 40).alias("quote"))
    return J.containment(q, h, "artifact_id", "quote", "text", "quote_id", "hit_id").select("quote_id", "hit_id")


_BOTH = "CASE WHEN regexp_matches(text, '[-‐]$') THEN regexp_replace(text, '[-‐]$', '') || nx ELSE concat_ws(' ', text, nx) END"


@query(
    "jn9_adjacent_quote",
    f"""WITH f AS (SELECT artifact_id, page, fragment_id, text, lead(text) OVER (PARTITION BY artifact_id, page ORDER BY fragment_id) AS nx FROM fragment WHERE text IS NOT NULL), b AS (SELECT *, {_BOTH} AS both_texts FROM f WHERE nx IS NOT NULL),
    q AS (SELECT DISTINCT artifact_id, substr(both_texts, greatest(length(text) - 14, 1), 30) AS quote FROM b) SELECT DISTINCT artifact_id, fragment_id, quote FROM q JOIN b USING (artifact_id) WHERE quote <> '' AND contains(both_texts, quote) AND NOT contains(text, quote) AND NOT contains(nx, quote)""",
)
def jn9(spark, sf):
    """Quotes of thirty characters around the seam of every two neighbouring lines, looked for at all seams of the artifact."""
    f = table(spark, sf, "fragment").filter("text is not null").select("artifact_id", "page", "fragment_id", "text")
    b = J.seams(f, "artifact_id", "text", "fragment_id", "page")
    q = b.select("artifact_id", F.substring("_both", F.greatest(F.length("text") - 14, F.lit(1)), F.lit(30)).alias("quote")).filter("quote <> ''").distinct()
    return J.spanning(q, f, "artifact_id", "quote", "text", "fragment_id", "page").select("artifact_id", "fragment_id", "quote").distinct()


@query("jn10_box_containment", "WITH c AS (SELECT hit_id, artifact_id, page, bbox FROM search_hit WHERE bbox IS NOT NULL) SELECT o.hit_id AS outer_id, i.hit_id AS inner_id FROM c o JOIN c i ON o.artifact_id = i.artifact_id AND o.page = i.page AND o.hit_id <> i.hit_id WHERE (i.bbox.x1 - i.bbox.x0) * (i.bbox.y1 - i.bbox.y0) > 0 AND greatest(least(o.bbox.x1, i.bbox.x1) - greatest(o.bbox.x0, i.bbox.x0), 0) * greatest(least(o.bbox.y1, i.bbox.y1) - greatest(o.bbox.y0, i.bbox.y0), 0) >= 0.8 * (greatest(i.bbox.x1 - i.bbox.x0, 0) * greatest(i.bbox.y1 - i.bbox.y0, 0))")
def jn10(spark, sf):
    h = table(spark, sf, "search_hit").filter("bbox is not null")
    o = h.select("artifact_id", "page", F.col("hit_id").alias("outer_id"), F.col("bbox").alias("ob"))
    i = h.select("artifact_id", "page", F.col("hit_id").alias("inner_id"), F.col("bbox").alias("ib"))
    return J.box_join(o, i, ["artifact_id", "page"], "ob", "ib").filter("outer_id <> inner_id").select("outer_id", "inner_id")


@query(
    "mth4_overlap",
    """WITH c AS (SELECT hit_id, artifact_id, page, bbox FROM search_hit WHERE bbox IS NOT NULL), x AS (SELECT a.hit_id AS a_id, b.hit_id AS b_id, greatest(least(a.bbox.x1, b.bbox.x1) - greatest(a.bbox.x0, b.bbox.x0), 0) * greatest(least(a.bbox.y1, b.bbox.y1) - greatest(a.bbox.y0, b.bbox.y0), 0) AS n,
    least((a.bbox.x1 - a.bbox.x0) * (a.bbox.y1 - a.bbox.y0), (b.bbox.x1 - b.bbox.x0) * (b.bbox.y1 - b.bbox.y0)) AS d FROM c a JOIN c b ON a.artifact_id = b.artifact_id AND a.page = b.page AND a.hit_id < b.hit_id) SELECT a_id, b_id, round(n / d, 4) AS overlap FROM x WHERE n > 0""",
)
def mth4(spark, sf):
    """All overlapping boxes of a page."""
    h = table(spark, sf, "search_hit").filter("bbox is not null")
    a = h.select("artifact_id", "page", F.col("hit_id").alias("a_id"), F.col("bbox").alias("a"))
    x = J.overlapping(a, h.select("artifact_id", "page", F.col("hit_id").alias("b_id"), F.col("bbox").alias("b")), ["artifact_id", "page"], "a", "b").filter("a_id < b_id")
    return x.select("a_id", "b_id", F.round(F.try_divide(J.intersection("a", "b"), F.least(J.box_area("a"), J.box_area("b"))), 4).alias("overlap"))



@query("jn13_reference_labels", r"""WITH c AS (SELECT DISTINCT artifact_id, label FROM (SELECT artifact_id, hit_id, unnest(regexp_extract_all(text, '\[([0-9]+)\]', 1)) AS label FROM search_hit WHERE kind <> 'reference')), r AS (SELECT artifact_id, regexp_extract(text, '^\[([0-9]+)\]', 1) AS label, min(hit_id) AS reference FROM search_hit WHERE kind = 'reference' AND regexp_matches(text, '^\[[0-9]+\]') GROUP BY ALL) SELECT artifact_id, label, reference, reference IS NOT NULL AS resolved FROM c LEFT JOIN r USING (artifact_id, label)""")
def jn13(spark, sf):
    h = table(spark, sf, "search_hit")
    c = h.filter("kind <> 'reference'").select("artifact_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("label")).distinct()
    r = h.filter("kind = 'reference'").withColumn("label", F.regexp_extract("text", r"^\[([0-9]+)\]", 1)).filter("label <> ''").groupBy("artifact_id", "label").agg(F.min("hit_id").alias("reference"))
    return c.join(r, ["artifact_id", "label"], "left").withColumn("resolved", F.col("reference").isNotNull())


@query("jn18_span_join", "WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(unnest(range(l_linenumber, l_linenumber + (l_partkey % 3) + 1)) AS INT) AS pos FROM lineitem) SELECT s.l_orderkey, s.l_partkey AS span_part, s.pos, count(*) AS covered FROM s JOIN lineitem l ON l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.pos GROUP BY ALL")
def jn18(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    s = J.explode_spans(li.withColumn("n", (F.col("l_partkey") % 3 + 1).cast("int")), "l_linenumber", "n", "pos").select("l_orderkey", F.col("l_partkey").alias("span_part"), "pos")
    return s.join(li.select("l_orderkey", F.col("l_linenumber").alias("pos")), ["l_orderkey", "pos"]).groupBy("l_orderkey", "span_part", "pos").agg(F.count("*").alias("covered"))


@query("jn20_bounded_walk", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1500 AS dst FROM orders), w(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def jn20(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst")).distinct()
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return J.walk(start, e, 2)


@query("jn21_section_parent", "WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 3 + 1 AS INT) AS level FROM orders) SELECT o_custkey, o_orderkey, (SELECT max(p.o_orderkey) FROM s p WHERE p.o_custkey = s.o_custkey AND p.o_orderkey < s.o_orderkey AND p.level < s.level) AS parent FROM s")
def jn21(spark, sf):
    s = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"))
    return J.section_parents(s, "o_custkey", "o_orderkey", "level").select("o_custkey", "o_orderkey", "parent")


@query("jn22_full_coverage", "WITH e AS (SELECT page_id, count(*) AS n FROM retrieved_page GROUP BY 1), g AS (SELECT page_id, count(*) AS m FROM parsed_html GROUP BY 1) SELECT page_id, CASE WHEN n IS NULL THEN 'extra' WHEN m IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM e FULL OUTER JOIN g USING (page_id) WHERE n IS NULL OR m IS NULL OR m > 1")
def jn22(spark, sf):
    return J.coverage(table(spark, sf, "retrieved_page"), table(spark, sf, "parsed_html"), "page_id")


@query("jn24_cached_or_pending", "SELECT r.record_id, CASE WHEN p.request_id IS NOT NULL THEN 'CACHED' WHEN r.title IS NULL THEN 'PRESERVED_MANUAL' ELSE 'PENDING' END AS state FROM paper_metadata r LEFT JOIN (SELECT lower(doi) AS d, min(request_id) AS request_id FROM paper_request WHERE doi IS NOT NULL GROUP BY 1) p ON lower(r.doi) = p.d")
def jn24(spark, sf):
    p = table(spark, sf, "paper_request").filter("doi is not null").groupBy(F.lower("doi").alias("d")).agg(F.min("request_id").alias("request_id"))
    return table(spark, sf, "paper_metadata").join(p, F.lower("doi") == F.col("d"), "left").select("record_id", F.when(F.col("request_id").isNotNull(), "CACHED").when(F.col("title").isNull(), "PRESERVED_MANUAL").otherwise("PENDING").alias("state"))


# --- aggregates -------------------------------------------------------------------------------------------------------------


@query("agg3_status_coverage", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS complete_rows, count(*) FILTER (o_orderstatus = 'P') AS partial_rows, bool_and(o_orderstatus = 'F') AS complete FROM orders")
def agg3(spark, sf):
    return A.status_coverage(table(spark, sf, "orders"), "o_orderstatus", ["F"], ["P"])


@query("agg4_duplicate_groups", "SELECT sha256(text) AS sha, count(*) AS copies, count(DISTINCT source) AS identities, arg_min(doc_id, (-extract(epoch FROM collected_at), doc_id)) AS kept, count(DISTINCT source) > 1 AS conflict FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg4(spark, sf):
    return A.duplicate_groups(table(spark, sf, "documents"), F.col("text"), "source", [-F.unix_micros(F.col("collected_at").cast("timestamp")), F.col("doc_id")], "doc_id")


@query("agg5_same_doi_versions", "SELECT lower(doi) AS d, count(*) AS versions, count(DISTINCT provider) AS providers FROM paper_metadata WHERE doi IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg5(spark, sf):
    return table(spark, sf, "paper_metadata").filter("doi is not null").groupBy(F.lower("doi").alias("d")).agg(F.count("*").alias("versions"), F.count_distinct("provider").alias("providers")).filter("versions > 1")


@query("agg6_catalogue_groups", "WITH m AS (SELECT lower(doi) AS d, record_id, nullif(trim(journal), '') AS journal, year, nullif(trim(volume), '') AS volume FROM paper_metadata WHERE doi IS NOT NULL) SELECT d, count(*) AS members, arg_min(journal, record_id) FILTER (journal IS NOT NULL) AS journal, arg_min(year, record_id) FILTER (year IS NOT NULL) AS year, arg_min(volume, record_id) FILTER (volume IS NOT NULL) AS volume, array_to_string(list_filter([CASE WHEN count(DISTINCT journal) > 1 THEN 'journal' END, CASE WHEN count(DISTINCT year) > 1 THEN 'year' END, CASE WHEN count(DISTINCT volume) > 1 THEN 'volume' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM m GROUP BY d")
def agg6(spark, sf):
    m = table(spark, sf, "paper_metadata").filter("doi is not null").select(F.lower("doi").alias("d"), "record_id", "journal", "year", "volume")
    return A.catalogue(m, "d", ["journal", "year", "volume"], "record_id")


@query("agg7_status_counts", "SELECT http_status, count(*) AS pages FROM retrieved_page GROUP BY 1")
def agg7(spark, sf):
    return table(spark, sf, "retrieved_page").groupBy("http_status").agg(F.count("*").alias("pages"))


@query("agg8_usage_ledger", "SELECT event_type, count(*) AS calls, round(sum(CASE WHEN value >= 10 THEN value END), 4) AS known, count(*) FILTER (value < 10) AS unknown_calls FROM events GROUP BY 1")
def agg8(spark, sf):
    return A.ledger(table(spark, sf, "events"), "event_type", "value", F.col("value") < 10)


@query("agg10_document_quality", "SELECT artifact_id, round(count(*) FILTER (text IS NOT NULL AND trim(text) <> '') / count(*), 6) AS text_share, round(avg(score), 6) AS mean_score, count(*) FILTER (bbox IS NULL) AS without_box, bool_or(kind = 'equation') AS has_equation FROM search_hit GROUP BY 1")
def agg10(spark, sf):
    return table(spark, sf, "search_hit").groupBy("artifact_id").agg(A.ratio(F.count_if(F.trim("text") != ""), F.count("*")).alias("text_share"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("bbox").isNull()).alias("without_box"), F.bool_or(F.col("kind") == "equation").alias("has_equation"))


@query("agg12_duplicate_characters", r"SELECT artifact_id, CAST(sum(length(k) * (n - 1)) AS BIGINT) AS duplicate_characters, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT artifact_id, trim(regexp_replace(lower(text), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS k, count(*) AS n FROM fragment WHERE text IS NOT NULL GROUP BY 1, 2) WHERE k <> '' GROUP BY 1")
def agg12(spark, sf):
    return A.duplicate_characters(table(spark, sf, "fragment").filter("text is not null"), T.squeeze(F.lower("text")), ["artifact_id"])


CASES_SQL = "(SELECT kind AS g, page AS record_id, score > 0.5 AS expected_present, score > 1 AS present, coalesce(lang, '') <> 'de' AS correct FROM search_hit WHERE score IS NOT NULL)"


@query("agg13_review_score", f"WITH c AS {CASES_SQL}, w AS (SELECT g, count(*) AS records, count(*) FILTER (whole) AS complete FROM (SELECT g, record_id, bool_and(correct) AS whole FROM c GROUP BY ALL) GROUP BY g) SELECT g, count(*) AS cases, round(count(*) FILTER (present AND correct) / nullif(count(*) FILTER (present), 0), 6) AS precision, round(count(*) FILTER (present AND correct) / nullif(count(*) FILTER (expected_present), 0), 6) AS recall, round(count(*) FILTER (correct) / count(*), 6) AS accuracy, round(any_value(complete) / any_value(records), 6) AS record_accuracy FROM c JOIN w USING (g) GROUP BY g")
def agg13(spark, sf):
    h = table(spark, sf, "search_hit").filter("score is not null")
    c = h.select(F.col("kind").alias("g"), F.col("page").alias("record_id"), (F.col("score") > 0.5).alias("expected_present"), (F.col("score") > 1).alias("present"), (F.coalesce("lang", F.lit("")) != "de").alias("correct"))
    return A.review_score(c, ["g"])


@query("agg16_median_font", "SELECT artifact_id, round(quantile_cont(font_size, 0.5), 4) AS median_font FROM fragment WHERE font_size IS NOT NULL GROUP BY 1")
def agg16(spark, sf):
    return table(spark, sf, "fragment").filter("font_size is not null").groupBy("artifact_id").agg(F.round(F.percentile("font_size", 0.5), 4).alias("median_font"))


@query("agg17_placement_conflicts", "SELECT lower(doi) AS d, count(DISTINCT folder) > 1 AS folder_conflict, count(DISTINCT filename) > 1 AS filename_conflict, count(*) AS requests FROM paper_request WHERE doi IS NOT NULL GROUP BY 1")
def agg17(spark, sf):
    return table(spark, sf, "paper_request").filter("doi is not null").groupBy(F.lower("doi").alias("d")).agg((F.count_distinct("folder") > 1).alias("folder_conflict"), (F.count_distinct("filename") > 1).alias("filename_conflict"), F.count("*").alias("requests"))


@query("agg19_exclusive_time", "WITH s AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4 END AS parent, CAST(floor(value) AS BIGINT) AS seconds FROM events), k AS (SELECT parent, sum(seconds) AS kids FROM s WHERE parent IS NOT NULL GROUP BY 1) SELECT event_id, CAST(seconds - coalesce(kids, 0) AS BIGINT) AS exclusive, coalesce(kids > seconds, false) AS overrun FROM s LEFT JOIN k ON k.parent = s.event_id")
def agg19(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 4).alias("parent"), F.floor("value").cast("bigint").alias("seconds"))
    return A.exclusive_time(e, "event_id", "parent", "seconds").select("event_id", "exclusive", "overrun")


@query("agg20_latest_and_best", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS best FROM events GROUP BY 1")
def agg20(spark, sf):
    e = table(spark, sf, "events")
    key = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_type", key).alias("latest"), F.max_by("event_id", F.when(F.col("event_type") == "purchase", key)).alias("best"))


@query("agg22_distinct_sets", "SELECT artifact_id, count(DISTINCT kind) AS kinds, array_to_string(list_sort(list_distinct(list(kind))), '|') AS kind_set FROM search_hit GROUP BY 1")
def agg22(spark, sf):
    return table(spark, sf, "search_hit").groupBy("artifact_id").agg(F.count_distinct("kind").alias("kinds"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kind_set"))


@query("flt11_repeated_margins", r"SELECT artifact_id, key, count(DISTINCT page) AS pages FROM (SELECT artifact_id, page, trim(regexp_replace(regexp_replace(lower(text), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[0-9]+', '#', 'g')) AS key FROM fragment WHERE (y > 785 OR y < 62) AND text IS NOT NULL) WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 2")
def flt11(spark, sf):
    m = table(spark, sf, "fragment").filter("(y > 785 or y < 62) and text is not null")
    k = F.trim(F.regexp_replace(T.squeeze(F.lower("text")), "[0-9]+", "#"))
    return A.repeated_margins(m, "artifact_id", "page", k)


@query("flt16_reference_integrity", "SELECT 'parsed_html' AS tbl, page_id AS id, 'orphan' AS problem FROM parsed_html WHERE page_id NOT IN (SELECT page_id FROM retrieved_page) UNION ALL SELECT 'search_hit', hit_id, 'no config' FROM search_hit WHERE config_id NOT IN (SELECT config_id FROM chunk_config) UNION ALL SELECT 'lineitem', l_orderkey, 'orphan' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def flt16(spark, sf):
    a = table(spark, sf, "parsed_html").join(table(spark, sf, "retrieved_page"), "page_id", "left_anti").select(F.lit("parsed_html").alias("tbl"), F.col("page_id").alias("id"), F.lit("orphan").alias("problem"))
    b = table(spark, sf, "search_hit").join(table(spark, sf, "chunk_config"), "config_id", "left_anti").select(F.lit("search_hit"), "hit_id", F.lit("no config"))
    c = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("lineitem"), "l_orderkey", F.lit("orphan"))
    return a.union(b).union(c)


# --- windows and folds ------------------------------------------------------------------------------------------------------


@query("win4_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def win4(spark, sf):
    return A.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type", "ts"])


@query("win5_first_occurrence", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def win5(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha"), "doc_id")
    return A.first_of(d, "sha", ["doc_id"], ["doc_id"])


@query("win6_occurrence_number", "SELECT request_id, lower(doi) || CASE WHEN n > 1 THEN ':input:' || n ELSE '' END AS key FROM (SELECT request_id, doi, row_number() OVER (PARTITION BY lower(doi) ORDER BY request_id) AS n FROM paper_request WHERE doi IS NOT NULL)")
def win6(spark, sf):
    q = A.occurrence(table(spark, sf, "paper_request").filter("doi is not null").withColumn("d", F.lower("doi")), ["d"], ["request_id"])
    return q.select("request_id", F.concat("d", F.when(F.col("occurrence") > 1, F.concat(F.lit(":input:"), F.col("occurrence").cast("string"))).otherwise("")).alias("key"))


@query("win7_global_numbers", "SELECT artifact_id, row_number() OVER (ORDER BY h) AS number FROM (SELECT artifact_id, min(hit_id) AS h FROM search_hit GROUP BY 1)")
def win7(spark, sf):
    return W.number_globally(table(spark, sf, "search_hit"), "artifact_id", ["hit_id"])


@query("win9_carried_header", "SELECT fragment_id, last_value(CASE WHEN bold THEN text END IGNORE NULLS) OVER (PARTITION BY artifact_id, page ORDER BY y DESC, x, fragment_id ROWS UNBOUNDED PRECEDING) AS header FROM fragment")
def win9(spark, sf):
    return W.carry(table(spark, sf, "fragment"), ["artifact_id", "page"], [F.desc_nulls_last("y"), F.col("x"), F.col("fragment_id")], F.when(F.col("bold"), F.col("text")), "header").select("fragment_id", "header")


@query("win10_paragraph_islands", "WITH l AS (SELECT fragment_id, artifact_id, page, y, x, row_number() OVER w = 1 OR coalesce(font_size <> lag(font_size) OVER w, false) AS b FROM fragment WINDOW w AS (PARTITION BY artifact_id, page ORDER BY y DESC, x, fragment_id)) SELECT fragment_id, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id, page ORDER BY y DESC, x, fragment_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM l")
def win10(spark, sf):
    from pyspark.sql import Window

    order = [F.desc_nulls_last("y"), F.col("x"), F.col("fragment_id")]
    f = table(spark, sf, "fragment")
    prev = F.lag("font_size").over(Window.partitionBy("artifact_id", "page").orderBy(*order))
    return W.islands(f.withColumn("prev", prev), ["artifact_id", "page"], order, F.col("font_size") != F.col("prev")).select("fragment_id", "island")


@query("win12_interval_union", "WITH i AS (SELECT user_id, ts AS s, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS e, event_id FROM events), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM i), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS intervals FROM g GROUP BY user_id, g")
def win12(spark, sf):
    i = table(spark, sf, "events").select("user_id", F.col("ts").alias("s"), F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(floor(value) as int), 0)").alias("e"))
    return W.interval_union(i, "user_id", "s", "e")


ADMIT_SQL = """WITH RECURSIVE r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f(user_id, n, event_id, used, ok) AS (SELECT user_id, n, event_id, CASE WHEN value <= 500 THEN value ELSE 0 END, value <= 500 FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.event_id, CASE WHEN f.used + r.value <= 500 THEN f.used + r.value ELSE f.used END, f.used + r.value <= 500 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1) SELECT event_id, ok AS admitted FROM f"""


@query("win14_budget_admission", ADMIT_SQL)
def win14(spark, sf):
    return W.admit(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 500.0).select("event_id", "admitted")


@query("win15_character_budget", """WITH RECURSIVE r AS (SELECT artifact_id, hit_id, length(text) AS n_chars, row_number() OVER (PARTITION BY artifact_id ORDER BY hit_id) AS n FROM search_hit WHERE text IS NOT NULL), f(artifact_id, n, hit_id, used, ok) AS (SELECT artifact_id, n, hit_id, CASE WHEN n_chars <= 2000 THEN n_chars ELSE 0 END, n_chars <= 2000 FROM r WHERE n = 1 UNION ALL SELECT r.artifact_id, r.n, r.hit_id, CASE WHEN f.used + r.n_chars <= 2000 THEN f.used + r.n_chars ELSE f.used END, f.used + r.n_chars <= 2000 FROM f JOIN r ON r.artifact_id = f.artifact_id AND r.n = f.n + 1) SELECT hit_id, ok AS admitted FROM f""")
def win15(spark, sf):
    h = table(spark, sf, "search_hit").filter("text is not null").select("artifact_id", "hit_id", F.length("text").cast("double").alias("n"))
    return W.admit(h, "artifact_id", ["hit_id"], "n", 2000.0).select("hit_id", "admitted")


@query("win22_review_batches", "SELECT hit_id, CAST(floor((row_number() OVER (PARTITION BY artifact_id ORDER BY hit_id) - 1) / 4) AS BIGINT) AS batch FROM search_hit")
def win22(spark, sf):
    return W.batches(table(spark, sf, "search_hit"), "artifact_id", ["hit_id"], 4).select("hit_id", "batch")


# --- set operations ---------------------------------------------------------------------------------------------------------


@query("set1_except", "SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set1(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct().join(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("set2_intersect", "SELECT lower(doi) AS d FROM paper_request WHERE doi IS NOT NULL INTERSECT SELECT lower(doi) FROM paper_metadata WHERE doi IS NOT NULL")
def set2(spark, sf):
    return table(spark, sf, "paper_request").filter("doi is not null").select(F.lower("doi").alias("d")).intersect(table(spark, sf, "paper_metadata").filter("doi is not null").select(F.lower("doi").alias("d")))


@query("set3_union_provenance", "SELECT d, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM (SELECT lower(doi) AS d, 'request' AS src FROM paper_request WHERE doi IS NOT NULL UNION ALL SELECT lower(doi), 'record' FROM paper_metadata WHERE doi IS NOT NULL) GROUP BY d")
def set3(spark, sf):
    a = table(spark, sf, "paper_request").filter("doi is not null").select(F.lower("doi").alias("d"), F.lit("request").alias("src"))
    b = table(spark, sf, "paper_metadata").filter("doi is not null").select(F.lower("doi").alias("d"), F.lit("record").alias("src"))
    return a.unionByName(b).groupBy("d").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


@query("set4_symmetric_difference", "WITH q AS (SELECT request_id, lower(doi) AS d, list_distinct(list_filter(string_split(lower(title), ' '), lambda x: x <> '')) AS a FROM paper_request WHERE doi IS NOT NULL AND title IS NOT NULL), m AS (SELECT lower(doi) AS d, arg_min(title, record_id) AS t FROM paper_metadata WHERE doi IS NOT NULL AND title IS NOT NULL GROUP BY 1), x AS (SELECT request_id, a, list_distinct(list_filter(string_split(lower(t), ' '), lambda x: x <> '')) AS b FROM q JOIN m USING (d)) SELECT request_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_asked, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS only_held FROM x")
def set4(spark, sf):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: x != ""))
    q = table(spark, sf, "paper_request").filter("doi is not null and title is not null").select("request_id", F.lower("doi").alias("d"), words("title").alias("a"))
    m = table(spark, sf, "paper_metadata").filter("doi is not null and title is not null").groupBy(F.lower("doi").alias("d")).agg(F.min_by("title", "record_id").alias("t"))
    return q.join(m, "d").withColumn("b", words("t")).select("request_id", F.size(F.array_except("a", "b")).cast("bigint").alias("only_asked"), F.size(F.array_except("b", "a")).cast("bigint").alias("only_held"))


@query("set7_omitted_pages", "WITH p AS (SELECT artifact_id, max(page) AS n FROM search_hit GROUP BY 1), h AS (SELECT DISTINCT artifact_id, page FROM search_hit WHERE score > 1.5), w AS (SELECT DISTINCT artifact_id, CAST(unnest(range(greatest(page - 1, 1), least(page + 1, n) + 1)) AS INT) AS page FROM h JOIN p USING (artifact_id)) SELECT artifact_id, CAST(unnest(range(1, n + 1)) AS INT) AS page FROM p EXCEPT SELECT artifact_id, page FROM w")
def set7(spark, sf):
    h = table(spark, sf, "search_hit")
    p = h.groupBy("artifact_id").agg(F.max("page").alias("n"))
    w = h.filter("score > 1.5").select("artifact_id", "page").distinct().join(p, "artifact_id").select("artifact_id", F.explode(F.sequence(F.greatest(F.col("page") - 1, F.lit(1)), F.least(F.col("page") + 1, F.col("n")))).alias("page")).distinct()
    return p.select("artifact_id", F.explode(F.sequence(F.lit(1), "n")).alias("page")).join(w, ["artifact_id", "page"], "left_anti")


# --- classification ---------------------------------------------------------------------------------------------------------

def _any_sql(text: str, terms: list[str]) -> str:
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in terms)
    return f"len(list_filter([{quoted}], lambda t: contains({text}, t))) > 0"


# Terms are dealt out over the pages so that every type is met.
_TYPE_TERMS = ["", AC.PAGE_CHALLENGE[0], AC.PAGE_DENIED[3], AC.PAGE_LOGIN[4], AC.PAGE_WEAK_LOGIN[1], ""]


@query(
    "cls12_page_type",
    f"""WITH p AS (SELECT page_id, lower(concat_ws(' ', title, CASE WHEN page_id % 11 = 0 THEN '' ELSE visible_text END, {sql_dealt([t.replace("'", "''") for t in _TYPE_TERMS], 'page_id')})) AS x, page_id % 2 = 0 AND list_has_any(list_transform(metadata, lambda m: m.name), ['citation_title', 'citation_doi']) AS scholarly FROM parsed_html)
    SELECT page_id, CASE WHEN {_any_sql('x', AC.PAGE_CHALLENGE)} THEN 'CHALLENGE' WHEN {_any_sql('x', AC.PAGE_DENIED)} THEN 'ACCESS_DENIED' WHEN {_any_sql('x', AC.PAGE_LOGIN)} THEN 'LOGIN' WHEN coalesce(scholarly, false) THEN 'ARTICLE' WHEN {_any_sql('x', AC.PAGE_WEAK_LOGIN)} THEN 'LOGIN' WHEN trim(x) <> '' THEN 'GENERIC' ELSE 'UNKNOWN' END AS page_type FROM p""",
)
def cls12(spark, sf):
    seen = F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("visible_text"))
    text = F.lower(F.concat_ws(" ", "title", seen, dealt(_TYPE_TERMS, F.col("page_id"))))
    scholarly = (F.col("page_id") % 2 == 0) & F.exists("metadata", lambda m: m["name"].isin("citation_title", "citation_doi"))
    return table(spark, sf, "parsed_html").select("page_id", AC.page_type(text, scholarly).alias("page_type"))


@query("cls2_heading_shape", r"SELECT hit_id, letters >= 3 AND letters >= 0.4 * n AND digits <= greatest(1, letters / 4.0) AND NOT regexp_matches(text, '[.;,]$') AND commas < 2 AND NOT regexp_matches(text, 'https?://|@') AS heading FROM (SELECT hit_id, text, length(text) AS n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(text) - length(replace(text, ',', '')) AS commas FROM search_hit WHERE text IS NOT NULL)")
def cls2(spark, sf):
    from litquarry.functions.classify import heading_shape

    return table(spark, sf, "search_hit").filter("text is not null").select("hit_id", heading_shape(F.col("text")).alias("heading"))


@query("cls3_heading_level", r"SELECT hit_id, CASE WHEN regexp_matches(text, '^[0-9]+(?:\.[0-9]+)*\.?\s') THEN least(length(regexp_extract(text, '^([0-9]+(?:\.[0-9]+)*)', 1)) - length(replace(regexp_extract(text, '^([0-9]+(?:\.[0-9]+)*)', 1), '.', '')) + 1, 5) WHEN regexp_matches(text, '^(?:[IVX]+|[A-Z])\.\s') THEN 2 WHEN lower(trim(text)) IN ('introduction', 'methods', 'results', 'discussion', 'conclusion', 'conclusions', 'references', 'results and discussion', 'materials and methods', 'abstract') THEN 1 ELSE 2 END AS level FROM search_hit WHERE kind = 'heading' AND text IS NOT NULL")
def cls3(spark, sf):
    from litquarry.functions.classify import heading_level

    return table(spark, sf, "search_hit").filter("kind = 'heading' and text is not null").select("hit_id", heading_level(F.col("text")).cast("bigint").alias("level"))


@query("cls20_task_counts", "SELECT count(*) AS total, count(*) FILTER (http_status IN (200, 203)) AS success, count(*) FILTER (http_status >= 400) AS failed, count(*) FILTER (http_status = 206) AS partial, count(*) FILTER (http_status NOT IN (200, 203, 206) AND http_status < 400) AS pending FROM retrieved_page")
def cls20(spark, sf):
    s = F.col("http_status")
    return table(spark, sf, "retrieved_page").agg(F.count("*").alias("total"), F.count_if(s.isin(200, 203)).alias("success"), F.count_if(s >= 400).alias("failed"), F.count_if(s == 206).alias("partial"), F.count_if(~s.isin(200, 203, 206) & (s < 400)).alias("pending"))


@query("cls19_final_status", "SELECT requested_url, CASE min(p) WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'ENTITLEMENT_REQUIRED' WHEN 3 THEN 'ACCESS_DENIED' WHEN 4 THEN 'ERROR' ELSE 'EXHAUSTED' END AS status FROM (SELECT requested_url, CASE WHEN http_status = 300 THEN 1 WHEN http_status = 402 THEN 2 WHEN http_status = 403 THEN 3 WHEN http_status >= 500 THEN 4 ELSE 5 END AS p FROM retrieved_page) GROUP BY 1")
def cls19(spark, sf):
    from litquarry.functions.classify import by_precedence

    s = F.col("http_status")
    return by_precedence(table(spark, sf, "retrieved_page"), "requested_url", [(s == 300, "AMBIGUOUS"), (s == 402, "ENTITLEMENT_REQUIRED"), (s == 403, "ACCESS_DENIED"), (s >= 500, "ERROR")], "EXHAUSTED")


# --- versions ---------------------------------------------------------------------------------------------------------------


@query("dml1_revision_fold", "SELECT user_id, count(*) AS revisions, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS confirmed_by, coalesce(max(ts) FILTER (event_type = 'purchase') > max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase') IS NOT NULL) AS confirmed FROM events GROUP BY 1")
def dml1(spark, sf):
    e = table(spark, sf, "events")
    return V.fold_confirmations(e, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "purchase", F.col("event_type") == "click")


@query("dml2_targeted_patch", "SELECT m.record_id, coalesce(p.journal, m.journal) AS journal FROM paper_metadata m LEFT JOIN (SELECT record_id, upper(journal) AS journal FROM paper_metadata WHERE year > 2010) p USING (record_id) WHERE m.provider IS DISTINCT FROM 'cnki'")
def dml2(spark, sf):
    m = table(spark, sf, "paper_metadata").select("record_id", "provider", "journal", "year")
    patch = m.filter("year > 2010").select("record_id", F.upper("journal").alias("journal"))
    gone = m.filter("provider = 'cnki'").select("record_id")
    return V.patch(m.select("record_id", "journal"), patch, gone, "record_id", ["journal"])


@query("dml4_tag_rename", "SELECT request_id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN t = 'scan' THEN 'scanned' ELSE t END))), '|') AS tags FROM paper_request WHERE tags IS NOT NULL")
def dml4(spark, sf):
    q = table(spark, sf, "paper_request").filter("tags is not null")
    return q.select("request_id", F.array_join(F.array_sort(V.rename_tag(F.col("tags"), "scan", "scanned")), "|").alias("tags"))


@query("dml7_bulk_placement", "SELECT request_id, CASE WHEN folder IS NULL THEN 'inbox/unsorted' WHEN folder = 'to-read' THEN NULL ELSE folder END AS folder FROM paper_request")
def dml7(spark, sf):
    q = table(spark, sf, "paper_request").select("request_id", "folder")
    return V.place(q, "folder", [(F.col("folder").isNull(), F.lit("inbox/unsorted")), (F.col("folder") == "to-read", F.lit(None).cast("string"))])


@query("dml8_duplicate_identity", "SELECT lower(doi) AS d, count(*) AS n, min(request_id) AS first_id FROM paper_request WHERE doi IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dml8(spark, sf):
    return table(spark, sf, "paper_request").filter("doi is not null").groupBy(F.lower("doi").alias("d")).agg(F.count("*").alias("n"), F.min("request_id").alias("first_id")).filter("n > 1")


@query("stm3_incremental_reuse", "WITH c AS (SELECT page_id, sha256(coalesce(visible_text, '')) AS h, title FROM parsed_html WHERE page_id % 3 <> 0) SELECT n.page_id, CASE WHEN c.page_id IS NOT NULL AND c.h = sha256(coalesce(n.visible_text, '')) AND c.title IS NOT DISTINCT FROM n.title THEN 'reuse' ELSE 'recompute' END AS plan FROM parsed_html n LEFT JOIN c USING (page_id)")
def stm3(spark, sf):
    n = table(spark, sf, "parsed_html").select("page_id", F.sha2(F.coalesce("visible_text", F.lit("")), 256).alias("h"), "title")
    return V.reuse(n, n.filter("page_id % 3 <> 0"), "page_id", ["h", "title"])
