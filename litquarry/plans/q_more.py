"""Further queries: locations of quotes, fallbacks, status algebra, routes, previews, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litquarry.functions import access as AC
from litquarry.functions import identifiers as I
from litquarry.functions.classify import by_precedence, gate
from litquarry.functions.pdftext import extract_pdf_dois, may_hold_doi
from litquarry.operators import aggregates as A
from litquarry.operators import evidence as V
from litquarry.operators.windows import carry, islands
from litquarry.plans.q_functions import NORMAL_DOI
from litquarry.plans.q_relations import _any_sql
from litquarry.plans.q_states import dealt, sql_dealt
from litquarry.plans.registry import query
from litquarry.session import table


@query("str4_pdf_dois")
def str4(spark, sf):
    return table(spark, sf, "fragment").filter(may_hold_doi(F.col("text"))).select("fragment_id", F.explode(extract_pdf_dois(F.col("text"))).alias("doi"))


@query("jn5_registry_wins", "SELECT page_id, 'parsed' AS src FROM parsed_html UNION ALL SELECT page_id, 'fetched' FROM retrieved_page WHERE page_id NOT IN (SELECT page_id FROM parsed_html)")
def jn5(spark, sf):
    p = table(spark, sf, "parsed_html").select("page_id", F.lit("parsed").alias("src"))
    return p.unionByName(table(spark, sf, "retrieved_page").select("page_id", F.lit("fetched").alias("src")).join(p.select("page_id"), "page_id", "left_anti"))


@query("jn6_citation_fallback", "WITH c AS (SELECT l_orderkey AS src, l_linenumber AS ln, l_partkey % 7 AS block FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS src, l_linenumber AS ln, l_suppkey % 7 AS block FROM lineitem), p AS (SELECT DISTINCT src, ln FROM b) SELECT c.src, c.ln, c.block, CASE WHEN b.src IS NOT NULL THEN 'block' WHEN p.src IS NOT NULL THEN 'page' ELSE 'none' END AS reading FROM c LEFT JOIN b ON b.src = c.src AND b.ln = c.ln AND b.block = c.block LEFT JOIN p ON p.src = c.src AND p.ln = c.ln")
def jn6(spark, sf):
    li = table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 7).alias("block"))
    b = li.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("ln"), (F.col("l_suppkey") % 7).alias("block")).distinct()
    return V.with_fallbacks(c, [("block", b, ["src", "ln", "block"]), ("page", b.select("src", "ln").distinct(), ["src", "ln"])], "reading")


@query("jn8_unique_location", "WITH q AS (SELECT hit_id AS quote_id, artifact_id, substr(text, 1, 30) AS quote FROM search_hit WHERE kind = 'paragraph' AND length(text) >= 60), h AS (SELECT quote_id, hit_id, CAST((length(text) - length(replace(text, quote, ''))) / length(quote) AS BIGINT) AS n FROM q JOIN search_hit s USING (artifact_id) WHERE instr(s.text, q.quote) > 0) SELECT quote_id, min(hit_id) AS hit_id FROM h GROUP BY 1 HAVING count(*) = 1 AND min(n) = 1")
def jn8(spark, sf):
    h = table(spark, sf, "search_hit").select("hit_id", "artifact_id", "kind", "text")
    q = h.filter((F.col("kind") == "paragraph") & (F.length("text") >= 60)).select(F.col("hit_id").alias("quote_id"), "artifact_id", F.substring("text", 1, 30).alias("quote"))
    return V.unique_location(q, h, "artifact_id", "quote", "text", "quote_id", "hit_id")


@query("jn14_preferred_run", "SELECT requested_url, arg_max(page_id, (http_status = 200, fetched_at, page_id)) AS page_id FROM retrieved_page GROUP BY 1")
def jn14(spark, sf):
    return table(spark, sf, "retrieved_page").groupBy("requested_url").agg(F.max_by("page_id", F.struct((F.col("http_status") == 200).alias("ok"), "fetched_at", "page_id")).alias("page_id"))


@query("jn16_greedy_overlap")
def jn16(spark, sf):
    h = table(spark, sf, "search_hit").filter("score is not null").groupBy("artifact_id", "page").agg(F.collect_set(F.floor(F.col("hit_id") / 2)).alias("blocks"), F.max("score").alias("score"))
    return V.keep_greedily(h, "artifact_id", "page", "blocks", "score").select("artifact_id", "page", "kept")


@query("jn17_all_covered", "WITH c AS (SELECT hit_id, artifact_id, page, kind, bbox FROM search_hit WHERE bbox IS NOT NULL), a AS (SELECT * FROM c WHERE kind IN ('equation', 'other', 'reference')), p AS (SELECT * FROM c WHERE kind NOT IN ('equation', 'other', 'reference')) SELECT artifact_id, page FROM a GROUP BY artifact_id, page HAVING bool_and(EXISTS (SELECT 1 FROM p WHERE p.artifact_id = a.artifact_id AND p.page = a.page AND greatest(least(p.bbox.x1, a.bbox.x1) - greatest(p.bbox.x0, a.bbox.x0), 0) * greatest(least(p.bbox.y1, a.bbox.y1) - greatest(p.bbox.y0, a.bbox.y0), 0) >= 0.5 * (greatest(a.bbox.x1 - a.bbox.x0, 0) * greatest(a.bbox.y1 - a.bbox.y0, 0))))")
def jn17(spark, sf):
    from litquarry.operators.joins import box_join

    c = table(spark, sf, "search_hit").filter("bbox is not null").select("hit_id", "artifact_id", "page", "kind", "bbox")
    a = c.filter("kind in ('equation', 'other', 'reference')")
    covered = box_join(c.filter("kind not in ('equation', 'other', 'reference')").select("artifact_id", "page", F.col("bbox").alias("ob")), a.select("artifact_id", "page", "hit_id", F.col("bbox").alias("ib")), ["artifact_id", "page"], "ob", "ib", 0.5).select("hit_id").distinct().withColumn("c", F.lit(1))
    return a.join(covered, "hit_id", "left").groupBy("artifact_id", "page").agg(F.every(F.col("c").isNotNull()).alias("whole")).filter("whole").select("artifact_id", "page")


@query("agg9_cost_by_label", "SELECT event_type, round(sum(CASE WHEN user_id % 5 <> 0 THEN value ELSE 0 END), 4) AS known, round(sum(CASE WHEN user_id % 5 = 0 THEN value * 2 ELSE 0 END), 4) AS reserved, count(*) AS calls FROM events GROUP BY 1")
def agg9(spark, sf):
    e = table(spark, sf, "events")
    known = F.col("user_id") % 5 != 0
    return e.groupBy("event_type").agg(F.round(F.sum(F.when(known, F.col("value")).otherwise(0)), 4).alias("known"), F.round(F.sum(F.when(~known, F.col("value") * 2).otherwise(0)), 4).alias("reserved"), F.count("*").alias("calls"))


@query("agg23_status_algebra", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETED' WHEN bool_or(o_orderstatus = 'F') THEN 'PARTIAL' WHEN bool_and(o_orderstatus = 'P') THEN 'PREPARED' ELSE 'FAILED' END AS status FROM orders GROUP BY 1")
def agg23(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(F.every(s == "F"), "COMPLETED").when(F.bool_or(s == "F"), "PARTIAL").when(F.every(s == "P"), "PREPARED").otherwise("FAILED").alias("status"))


@query("agg15_output_inventory", "SELECT record_id || '/authors/' || (pos - 1) AS pointer, name FROM (SELECT record_id, unnest(authors) AS name, generate_subscripts(authors, 1) AS pos FROM paper_metadata) WHERE name IS NOT NULL")
def agg15(spark, sf):
    x = table(spark, sf, "paper_metadata").select("record_id", F.posexplode("authors").alias("pos", "name")).filter("name is not null")
    return x.select(F.concat(F.col("record_id").cast("string"), F.lit("/authors/"), F.col("pos").cast("string")).alias("pointer"), "name")


@query("arr11_matrix", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS c1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS c2, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS c3 FROM lineitem GROUP BY 1")
def arr11(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_quantity"))
    return p.select("l_orderkey", F.col("1").alias("c1"), F.col("2").alias("c2"), F.col("3").alias("c3"))


@query(
    "arr4_reading_order",
    """WITH h AS (SELECT artifact_id, hit_id, section_heading AS s FROM search_hit WHERE section_heading IS NOT NULL), a AS (SELECT artifact_id, min(hit_id) FILTER (WHERE s = 'Introduction') AS p FROM h GROUP BY 1),
    b AS (SELECT artifact_id, min(hit_id) FILTER (WHERE s = 'Methods' AND hit_id > p) AS p FROM h JOIN a USING (artifact_id) GROUP BY 1) SELECT artifact_id, count(*) FILTER (WHERE s = 'Results' AND hit_id > p) > 0 AS in_order FROM h JOIN b USING (artifact_id) GROUP BY 1""",
)
def arr4(spark, sf):
    """Whether each page holds the headings of its artifact in order."""
    h = table(spark, sf, "search_hit").filter("section_heading is not null").groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hit_id", "section_heading"))), lambda s: s["section_heading"]).alias("order"))
    return h.select("artifact_id", V.in_order(F.col("order"), F.array(F.lit("Introduction"), F.lit("Methods"), F.lit("Results"))).alias("in_order"))


@query("win11_bibliography_region", "SELECT hit_id, coalesce(last_value(CASE WHEN kind = 'heading' THEN lower(trim(text)) IN ('references', 'literatur', 'références', 'referencias', '参考文献') END IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY hit_id ROWS UNBOUNDED PRECEDING), false) AS in_region FROM search_hit WHERE NOT (kind = 'heading' AND text IS NULL)")
def win11(spark, sf):
    h = table(spark, sf, "search_hit").filter("not (kind = 'heading' and text is null)")
    opens = F.when(F.col("kind") == "heading", F.lower(F.trim("text")).isin("references", "literatur", "références", "referencias", "参考文献"))
    return carry(h, ["artifact_id"], [F.col("hit_id")], opens, "r").select("hit_id", F.coalesce("r", F.lit(False)).alias("in_region"))


@query("win13_tiles", "WITH t AS (SELECT hit_id, artifact_id, page, bbox, lag(bbox) OVER (PARTITION BY artifact_id, page ORDER BY bbox.x0, bbox.y0, hit_id) AS p FROM search_hit WHERE bbox IS NOT NULL), b AS (SELECT *, CASE WHEN p IS NULL OR abs(p.x0 - bbox.x0) > 0.05 OR abs(p.y1 - bbox.y0) > 0.02 THEN 1 ELSE 0 END AS n FROM t) SELECT hit_id, CAST(sum(n) OVER (PARTITION BY artifact_id, page ORDER BY bbox.x0, bbox.y0, hit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tile FROM b")
def win13(spark, sf):
    h = table(spark, sf, "search_hit").filter("bbox is not null")
    order = [F.col("bbox.x0"), F.col("bbox.y0"), F.col("hit_id")]
    p = F.lag("bbox").over(Window.partitionBy("artifact_id", "page").orderBy(*order))
    h = h.withColumn("p", p).withColumn("b", (F.abs(F.col("p.x0") - F.col("bbox.x0")) > 0.05) | (F.abs(F.col("p.y1") - F.col("bbox.y0")) > 0.02))
    return islands(h, ["artifact_id", "page"], order, F.col("b"), "tile").select("hit_id", "tile")


@query("srt5_route_expansion", r"WITH l AS (SELECT page_id, final_url, unnest(regexp_extract_all(text, 'href=\"([^\"]+)\"', 1)) AS href FROM retrieved_page), d AS (SELECT page_id, href, count(*) AS n FROM l WHERE href <> final_url GROUP BY 1, 2) SELECT page_id, href FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, href) AS r FROM d) WHERE r <= 4")
def srt5(spark, sf):
    p = table(spark, sf, "retrieved_page")
    ld = p.select("page_id", "final_url", F.explode(F.regexp_extract_all("text", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).filter("href <> final_url").groupBy("page_id", "href").agg(F.count("*").alias("n"))
    return A.occurrence(ld, ["page_id"], [F.desc("n"), F.col("href")]).filter("occurrence <= 4").select("page_id", "href")


@query("srt9_newest_parse", "SELECT artifact_id, arg_max(hit_id, (CAST(parsed_at AS VARCHAR), hit_id)) AS hit_id FROM search_hit GROUP BY 1")
def srt9(spark, sf):
    return table(spark, sf, "search_hit").groupBy("artifact_id").agg(F.max_by("hit_id", F.struct("parsed_at", "hit_id")).alias("hit_id"))


@query("srt12_title_candidates", "SELECT record_id, CASE WHEN doi IS NULL THEN 'malformed' WHEN row_number() OVER (PARTITION BY lower(doi) ORDER BY record_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM paper_metadata")
def srt12(spark, sf):
    m = A.occurrence(table(spark, sf, "paper_metadata").withColumn("d", F.lower("doi")), ["d"], ["record_id"])
    return m.select("record_id", F.when(F.col("doi").isNull(), "malformed").when(F.col("occurrence") > 1, "duplicate").otherwise("accepted").alias("outcome"))


@query("set5_selection", "(SELECT request_id FROM paper_request WHERE folder = 'inbox' UNION SELECT request_id FROM paper_request WHERE list_contains(tags, 'scan')) EXCEPT SELECT request_id FROM paper_request WHERE list_contains(tags, 'urgent')")
def set5(spark, sf):
    q = table(spark, sf, "paper_request")
    return q.filter(F.coalesce((F.col("folder") == "inbox"), F.lit(False)) | F.coalesce(F.array_contains("tags", "scan"), F.lit(False))).join(q.filter(F.array_contains("tags", "urgent")).select("request_id"), "request_id", "left_anti").select("request_id").distinct()


@query("set6_subset", "SELECT artifact_id, list_has_all(['paragraph', 'caption', 'heading', 'reference'], list_distinct(list(kind))) AS subset FROM search_hit GROUP BY 1")
def set6(spark, sf):
    allowed = F.array(*[F.lit(x) for x in ("paragraph", "caption", "heading", "reference")])
    return table(spark, sf, "search_hit").groupBy("artifact_id").agg((F.size(F.array_except(F.collect_set("kind"), allowed)) == 0).alias("subset"))


@query("cls4_caption", r"SELECT hit_id, lower(regexp_extract(text, '^((?i)fig|table|scheme)', 1)) AS kind, regexp_extract(text, '^(?i)(?:fig(?:ure)?\.?|table|scheme)\s*([0-9]+)', 1) AS label FROM search_hit WHERE regexp_matches(text, '^(?i)(?:fig(?:ure)?\.?|table|scheme)\s*[0-9]+[.:]\s')")
def cls4(spark, sf):
    t = F.col("text")
    h = table(spark, sf, "search_hit").filter(t.rlike(r"^(?i:fig(?:ure)?\.?|table|scheme)\s*[0-9]+[.:]\s"))
    return h.select("hit_id", F.lower(F.regexp_extract(t, r"^((?i:fig|table|scheme))", 1)).alias("kind"), F.regexp_extract(t, r"^(?i:fig(?:ure)?\.?|table|scheme)\s*([0-9]+)", 1).alias("label"))


@query("cls5_reference_shape", r"SELECT hit_id, regexp_matches(text, '^\[[0-9]+\]\s') OR regexp_matches(text, '^[\p{Lu}][\p{L}]+ [\p{Lu}]\.,.*\((?:19|20)[0-9]{2}\)') AS reference FROM search_hit WHERE text IS NOT NULL")
def cls5(spark, sf):
    t = F.col("text")
    return table(spark, sf, "search_hit").filter("text is not null").select("hit_id", (t.rlike(r"^\[[0-9]+\]\s") | t.rlike(r"^[\p{Lu}][\p{L}]+ [\p{Lu}]\.,.*\((?:19|20)[0-9]{2}\)")).alias("reference"))


# A title, an address, a visible term and a mark of the source for every barrier, and for what only looks like one; dealt out over the pages.
_BARRIERS = [
    ("", "", "", ""), ("", "", "人机验证", ""), ("", "", "", "<iframe src=hcaptcha.com/captcha>"), ("security check", "", "", "<div class='g-recaptcha'>"), ("paper", "", "", "<div class='g-recaptcha'>"), ("", "", "open your authenticator app", ""),
    ("", "", "browser verification", ""), ("", "https://h.test/?__cf_chl_x", "", ""), ("a paper", "https://h.test/?__cf_chl_x", "a long text that may well be read as what it is by anybody who comes here", ""), ("just a moment...", "", "", ""), ("", "", "unusual traffic detected", ""),
    ("", "", "choose your institution", ""), ("a title", "", "the long story of shibboleth and of all that came of it in the libraries of the world, told again", ""), ("", "https://h.test/sso", "the long story of shibboleth and of all that came of it in the libraries of the world, told again", ""),
    ("", "", "please log in", ""), ("login", "https://h.test/login", "", ""), ("", "https://h.test/login", "", ""), ("", "", "rent or buy", ""), ("", "", "carsi or rent or buy", ""),
]
_PARTS = [[b[k] for b in _BARRIERS] for k in range(4)]


def _challenge_sql() -> str:
    has = _any_sql
    quote = lambda t: t.replace("'", "''")
    parts = ", ".join(f"{sql_dealt([quote(v) for v in values], 'page_id')} AS {name}" for values, name in zip(_PARTS, ("title", "url", "visible", "html")))
    only = lambda c, terms, room: "(" + " OR ".join(f"(starts_with({c}, '{t}') AND length({c}) <= {len(t) + room})" for t in terms) + ")"
    widget = "(" + " OR ".join(f"contains(html, 'class=' || {q} || '{w}')" for w in AC.CAPTCHA_WIDGET for q in ("chr(34)", "chr(39)")) + ")"
    several = " + ".join(f"CAST(contains(x, '{t}') AS INT)" for t in AC.SSO)
    login, auth, pay = has("url", AC.LOGIN_URL), has("x", AC.AUTH), has("x", AC.ENTITLEMENT)
    readable = f"(ends_with(title, '.pdf') OR (title <> '' AND length(visible) > {AC.READABLE} AND NOT ({has('x', AC.BOT)})))"
    return (
        f"WITH p AS (SELECT page_id, {parts} FROM retrieved_page), t AS (SELECT *, concat_ws(' ', title, url, visible) AS x, concat_ws(' ', title, url) AS head FROM p) SELECT page_id, CASE"
        f" WHEN {has('x', AC.CAPTCHA)} OR {has('html', AC.CAPTCHA_DOM)} OR ({widget} AND {has('head', AC.CAPTCHA_SURFACE)}) THEN 'CAPTCHA' WHEN {has('x', AC.MFA)} THEN 'MFA'"
        f" WHEN {has('x', AC.BOT)} OR ({has('url', AC.BOT_URL)} AND NOT {readable}) OR title IN ('just a moment', 'just a moment...') THEN 'BOT_CHALLENGE' WHEN {has('x', AC.DENIED)} THEN 'ACCESS_DENIED'"
        f" WHEN {has('x', AC.SSO)} AND ({login} OR {pay} OR {auth} OR {only('title', AC.SSO_TITLES, AC.TITLE_ROOM)} OR {only('visible', AC.SSO, AC.TEXT_ROOM)} OR {several} >= 2) THEN 'SSO'"
        f" WHEN {auth} OR ({login} AND ({has('title', AC.AUTH_TITLES)} OR {has('x', AC.AUTH_METHODS)})) THEN 'AUTHENTICATION' WHEN {pay} THEN 'ENTITLEMENT' ELSE 'NONE' END AS challenge FROM t"
    )


@query("cls13_access_challenge", _challenge_sql())
def cls13(spark, sf):
    parts = [dealt(values, F.col("page_id")) for values in _PARTS]
    return table(spark, sf, "retrieved_page").select("page_id", AC.access_challenge(*parts).alias("challenge"))


@query("cls13_pages")
def cls13_pages(spark, sf):
    """The barriers of the pages as they are."""
    p = table(spark, sf, "retrieved_page").join(table(spark, sf, "parsed_html").select("page_id", "title", "visible_text"), "page_id", "left")
    low = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    return p.select("page_id", AC.access_challenge(low("title"), low("final_url"), low("visible_text"), low("text")).alias("challenge"))


@query("cls16_exclusive_outcome", "SELECT requested_url, bool_and(http_status IN (401, 402, 403)) AS all_barriers FROM retrieved_page GROUP BY 1")
def cls16(spark, sf):
    return table(spark, sf, "retrieved_page").groupBy("requested_url").agg(F.every(F.col("http_status").isin(401, 402, 403)).alias("all_barriers"))


@query("cls17_document_status", "SELECT artifact_id, CASE WHEN count(*) FILTER (text IS NOT NULL) = 0 THEN 'FAILED' WHEN bool_or(text IS NULL) OR bool_or(bbox IS NULL) THEN 'PARTIAL' ELSE 'PARSED' END AS status FROM search_hit GROUP BY 1")
def cls17(spark, sf):
    return table(spark, sf, "search_hit").groupBy("artifact_id").agg(F.when(F.count("text") == 0, "FAILED").when(F.bool_or(F.col("text").isNull()) | F.bool_or(F.col("bbox").isNull()), "PARTIAL").otherwise("PARSED").alias("status"))


@query("cls18_record_state", "SELECT artifact_id, CASE min(CASE WHEN score IS NULL THEN 1 WHEN score < 0.3 THEN 2 WHEN score < 1 THEN 3 ELSE 4 END) WHEN 1 THEN 'conflict' WHEN 2 THEN 'evidence_insufficient' WHEN 3 THEN 'review_required' ELSE 'source_located' END AS state FROM search_hit GROUP BY 1")
def cls18(spark, sf):
    s = F.col("score")
    return by_precedence(table(spark, sf, "search_hit"), "artifact_id", [(s.isNull(), "conflict"), (s < 0.3, "evidence_insufficient"), (s < 1, "review_required")], "source_located", "state")


@query("src4_gate_codes", "SELECT page_id, CASE WHEN coalesce(text IS NULL, true) THEN 'NO_TEXT' WHEN coalesce(http_status >= 400, true) THEN 'BAD_STATUS' WHEN coalesce(size_bytes < 300, true) THEN 'TOO_SMALL' ELSE 'OK' END AS code FROM retrieved_page")
def src4(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", gate([(F.col("text").isNull(), "NO_TEXT"), (F.col("http_status") >= 400, "BAD_STATUS"), (F.col("size_bytes") < 300, "TOO_SMALL")]).alias("code"))


@query("src5_content_hash", "SELECT page_id, sha256(text) AS sha FROM retrieved_page WHERE text IS NOT NULL")
def src5(spark, sf):
    return table(spark, sf, "retrieved_page").filter("text is not null").select("page_id", F.sha2("text", 256).alias("sha"))


@query("prj14_task_rows", "SELECT page_id AS id, 'page' AS task, CAST(http_status AS VARCHAR) AS status FROM retrieved_page UNION ALL SELECT request_id, 'request', CASE WHEN doi IS NULL THEN 'open' ELSE 'identified' END FROM paper_request")
def prj14(spark, sf):
    a = table(spark, sf, "retrieved_page").select(F.col("page_id").alias("id"), F.lit("page").alias("task"), F.col("http_status").cast("string").alias("status"))
    return a.unionByName(table(spark, sf, "paper_request").select(F.col("request_id").alias("id"), F.lit("request").alias("task"), F.when(F.col("doi").isNull(), "open").otherwise("identified").alias("status")))


@query("prj18_rename_collisions", "SELECT request_id, name, count(*) OVER (PARTITION BY name) > 1 AS collision FROM (SELECT request_id, coalesce(folder, '') || '/' || coalesce(nullif(trim(filename), ''), 'paper') AS name FROM paper_request)")
def prj18(spark, sf):
    q = table(spark, sf, "paper_request").select("request_id", F.concat(F.coalesce("folder", F.lit("")), F.lit("/"), F.coalesce(F.when(F.trim("filename") != "", F.trim("filename")), F.lit("paper"))).alias("name"))
    n = q.groupBy("name").agg((F.count("*") > 1).alias("collision"))
    return q.join(n, "name").select("request_id", "name", "collision")


@query("flt13_trigger_reasons", "SELECT artifact_id, page, array_to_string(list_filter([CASE WHEN chars < 80 THEN 'few characters' END, CASE WHEN nulls > 0 THEN 'lost lines' END, CASE WHEN lines < 3 THEN 'few lines' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT artifact_id, page, coalesce(sum(length(text)), 0) AS chars, count(*) FILTER (text IS NULL) AS nulls, count(*) AS lines FROM fragment GROUP BY ALL)")
def flt13(spark, sf):
    g = table(spark, sf, "fragment").groupBy("artifact_id", "page").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count("*").alias("lines"))
    return g.select("artifact_id", "page", F.array_join(F.array_compact(F.array(F.when(F.col("chars") < 80, "few characters"), F.when(F.col("nulls") > 0, "lost lines"), F.when(F.col("lines") < 3, "few lines"))), ",").alias("reasons"))


@query("x1_batch_lookup", r"""WITH q AS (SELECT request_id, lower(regexp_replace(trim(doi), '^(?i)(?:doi\s*[:：]\s*|https?://doi\.(?:org|example)/+)', '')) AS d FROM paper_request), m AS (SELECT lower(regexp_replace(trim(doi), '^(?i)(?:doi\s*[:：]\s*|https?://doi\.(?:org|example)/+)', '')) AS d, min(record_id) AS record_id FROM paper_metadata WHERE doi IS NOT NULL GROUP BY 1) SELECT request_id, CASE WHEN q.d IS NULL OR NOT regexp_full_match(q.d, '10\.[0-9]{4,9}/[-._;()/:<>#?a-z0-9]+') THEN 'INVALID_DOI' WHEN record_id IS NULL THEN 'NOT_FOUND' ELSE 'SUCCESS' END AS status FROM q LEFT JOIN m USING (d)""")
def x1(spark, sf):
    q = table(spark, sf, "paper_request").select("request_id", I.normalize_doi(F.col("doi")).alias("d"))
    m = table(spark, sf, "paper_metadata").select("record_id", I.normalize_doi(F.col("doi")).alias("d")).filter("d is not null").groupBy("d").agg(F.min("record_id").alias("record_id"))
    return q.join(m, "d", "left").select("request_id", F.when(F.col("d").isNull(), "INVALID_DOI").when(F.col("record_id").isNull(), "NOT_FOUND").otherwise("SUCCESS").alias("status"))


@query(
    "x21_conflicting_fields",
    rf"""WITH q AS (SELECT request_id, {NORMAL_DOI} AS d, year, volume FROM paper_request), m AS (SELECT {NORMAL_DOI} AS d, min(year) AS my, min(volume) AS mv FROM paper_metadata GROUP BY 1)
    SELECT request_id, array_to_string(list_filter([CASE WHEN year <> my THEN 'year' END, CASE WHEN volume <> mv THEN 'volume' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM q JOIN m USING (d)""",
)
def x21(spark, sf):
    q = table(spark, sf, "paper_request").select("request_id", I.normalize_doi(F.col("doi")).alias("d"), "year", "volume")
    m = table(spark, sf, "paper_metadata").groupBy(I.normalize_doi(F.col("doi")).alias("d")).agg(F.min("year").alias("my"), F.min("volume").alias("mv"))
    return q.join(m, "d").select("request_id", F.array_join(F.array_compact(F.array(F.when(F.col("year") != F.col("my"), "year"), F.when(F.col("volume") != F.col("mv"), "volume"))), ",").alias("conflicts"))


@query("x26_recovery_preview", "SELECT p.page_id, CASE WHEN h.page_id IS NOT NULL AND p.http_status = 200 THEN 'COMPLETE' WHEN h.page_id IS NOT NULL THEN 'NEEDS_REVIEW' WHEN p.http_status >= 400 THEN 'MAIN_FAILED' ELSE 'NOT_STARTED' END AS preview FROM retrieved_page p LEFT JOIN parsed_html h USING (page_id)")
def x26(spark, sf):
    h = table(spark, sf, "parsed_html").select("page_id", F.lit(1).alias("h"))
    s = F.col("http_status")
    return table(spark, sf, "retrieved_page").join(h, "page_id", "left").select("page_id", F.when(F.col("h").isNotNull() & (s == 200), "COMPLETE").when(F.col("h").isNotNull(), "NEEDS_REVIEW").when(s >= 400, "MAIN_FAILED").otherwise("NOT_STARTED").alias("preview"))


@query("x65_bill_replaces_calls", "WITH b AS (SELECT user_id, 3 AS covered, 100.0 AS bill FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)), c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT c.user_id, round(coalesce(max(bill), 0) + sum(CASE WHEN n > coalesce(covered, 0) THEN value ELSE 0 END), 4) AS cost FROM c LEFT JOIN b USING (user_id) GROUP BY 1")
def x65(spark, sf):
    e = A.occurrence(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    b = e.filter("user_id % 2 = 0").select("user_id").distinct().withColumns({"covered": F.lit(3), "bill": F.lit(100.0)})
    return e.join(b, "user_id", "left").groupBy("user_id").agg(F.round(F.coalesce(F.max("bill"), F.lit(0.0)) + F.sum(F.when(F.col("occurrence") > F.coalesce("covered", F.lit(0)), F.col("value")).otherwise(0.0)), 4).alias("cost"))
