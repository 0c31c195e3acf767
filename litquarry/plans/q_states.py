"""Queries of states, routes and places. Where a table holds no such states, every state is dealt out over all its rows by id, so each level of a rule is met on any input."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litquarry.functions import places as P
from litquarry.functions import states as S
from litquarry.operators import routes as R
from litquarry.plans.registry import query
from litquarry.session import table

TASK_STATES = [s for group in S.TASK_GROUPS.values() for s in group] + ["QUEUED", "RUNNING", "UNHEARD_OF"]
ATTEMPTS = ["ERROR", "NAVIGATION_ERROR", "UNSAFE_URL", "AMBIGUOUS", "RETRIEVED_UNVERIFIED", "INTERACTION_REQUIRED", "ENTITLEMENT_REQUIRED", "ACCESS_DENIED", "AUTH_REQUIRED", "BROWSER_UNAVAILABLE", "NO_FILE"]
APIS = [None, "AUTH_REQUIRED", "ENTITLEMENT_REQUIRED", "ACCESS_DENIED", "OK"]
IDENTITIES, ROLES = ["MATCH", "MISMATCH", "UNKNOWN"], ["ARTICLE", "SUPPLEMENT", "UNKNOWN"]
ERRORS = [*S.PROVIDER_ERRORS, "something", None]
HOSTS, KINDS = ["PUBLISHER", "RESOLVER", "REPOSITORY", "INDEX", "UNKNOWN"], ["LANDING_PAGE", "PDF", "UNKNOWN", "XML"]
JOBS, JOB_STATES = ["acquisition", "translation", "research", "planning", "parsing"], ["QUEUED", "RUNNING", "COMPLETED", "PARTIAL", "FAILED", "CANCELLED", "PAUSED"]


def dealt(values: list, c):
    """One of the values for every row, by a number of the row."""
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(c, F.lit(len(values))).cast("int") + 1)


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def sql_dealt(values: list, c: str) -> str:
    return f"{sql_list(values)}[CAST(({c}) % {len(values)} AS INT) + 1]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_GROUP_SQL = "CASE " + " ".join(f"WHEN s IN {_in(v)} THEN '{k}'" for k, v in S.TASK_GROUPS.items()) + " ELSE 'pending' END"


@query("cls20_task_groups", f"SELECT {_GROUP_SQL} AS task_group, count(*) AS tasks, count(DISTINCT s) AS states FROM (SELECT {sql_dealt(TASK_STATES, 'page_id')} AS s FROM retrieved_page) GROUP BY 1")
def cls20_groups(spark, sf):
    t = table(spark, sf, "retrieved_page").select(dealt(TASK_STATES, F.col("page_id")).alias("s"))
    return t.groupBy(S.task_group(F.col("s")).alias("task_group")).agg(F.count("*").alias("tasks"), F.count_distinct("s").alias("states"))


_HAS = lambda s: f"list_contains(st, '{s}')"
_OUTCOME_SQL = (
    f"CASE WHEN {_HAS('AMBIGUOUS')} THEN 'AMBIGUOUS' WHEN {_HAS('RETRIEVED_UNVERIFIED')} OR (kept AND NOT ({_HAS('INTERACTION_REQUIRED')} OR {_HAS('ENTITLEMENT_REQUIRED')} OR {_HAS('ACCESS_DENIED')})) THEN 'RETRIEVED_UNVERIFIED'"
    + "".join(f" WHEN {_HAS(s)} THEN '{s}'" for s in ("INTERACTION_REQUIRED", "ENTITLEMENT_REQUIRED", "ACCESS_DENIED", "AUTH_REQUIRED"))
    + " WHEN api IN ('AUTH_REQUIRED', 'ENTITLEMENT_REQUIRED', 'ACCESS_DENIED') THEN api WHEN len(list_filter(st, lambda x: x <> 'UNSAFE_URL')) = 0 THEN 'UNSAFE_URL'"
    + " WHEN len(list_filter(st, lambda x: x NOT IN ('ERROR', 'NAVIGATION_ERROR', 'BROWSER_UNAVAILABLE'))) = 0 THEN 'ERROR' ELSE 'EXHAUSTED' END"
)


@query(
    "cls19_access_outcome",
    f"SELECT paper, {_OUTCOME_SQL} AS outcome FROM (SELECT page_id // 2 AS paper, list(DISTINCT {sql_dealt(ATTEMPTS, 'page_id * 7 // 3')}) AS st, bool_or(page_id % 13 = 0) AS kept, max({sql_dealt(APIS, 'page_id // 2')}) AS api FROM retrieved_page GROUP BY 1)",
)
def cls19_outcome(spark, sf):
    t = table(spark, sf, "retrieved_page").select(F.floor(F.col("page_id") / 2).alias("paper"), "page_id")
    g = t.groupBy("paper").agg(F.collect_set(dealt(ATTEMPTS, F.floor(F.col("page_id") * 7 / 3))).alias("st"), F.bool_or(F.col("page_id") % 13 == 0).alias("kept"), F.max(dealt(APIS, F.floor(F.col("page_id") / 2))).alias("api"))
    return g.select("paper", S.access_outcome(F.col("st"), F.col("kept"), F.col("api")).alias("outcome"))


@query(
    "cls15_retrieved_status",
    f"SELECT page_id, CASE WHEN r = 'SUPPLEMENT' THEN 'SUPPLEMENT' WHEN i = 'MATCH' AND r = 'ARTICLE' THEN 'VERIFIED' WHEN i = 'MISMATCH' THEN 'MISMATCH' ELSE 'RETRIEVED_UNVERIFIED' END AS status FROM (SELECT page_id, {sql_dealt(IDENTITIES, 'page_id')} AS i, {sql_dealt(ROLES, 'page_id // 3')} AS r FROM retrieved_page)",
)
def cls15(spark, sf):
    t = table(spark, sf, "retrieved_page")
    return t.select("page_id", S.retrieved_status(dealt(IDENTITIES, F.col("page_id")), dealt(ROLES, F.floor(F.col("page_id") / 3))).alias("status"))


_ERROR_SQL = "CASE WHEN e IS NULL THEN NULL " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in S.PROVIDER_ERRORS.items()) + " ELSE 'ERROR' END"


@query("x3_provider_status", f"SELECT provider, {_ERROR_SQL} AS status, count(*) AS n FROM (SELECT provider, {sql_dealt(ERRORS, 'record_id')} AS e FROM paper_metadata) GROUP BY 1, 2")
def x3(spark, sf):
    t = table(spark, sf, "paper_metadata").select("provider", S.provider_status(dealt(ERRORS, F.col("record_id"))).alias("status"))
    return t.groupBy("provider", "status").agg(F.count("*").alias("n"))


@query(
    "mth10_accounted_cost",
    "SELECT event_type, round(sum(coalesce(CASE WHEN event_id % 3 = 0 THEN abs(value) END, CASE WHEN event_id % 5 <> 0 THEN 1.5 END)), 4) AS cost, count(*) - count(coalesce(CASE WHEN event_id % 3 = 0 THEN abs(value) END, CASE WHEN event_id % 5 <> 0 THEN 1.5 END)) AS unknown FROM events GROUP BY 1",
)
def mth10(spark, sf):
    t = table(spark, sf, "events").select("event_type", S.accounted_cost(F.when(F.col("event_id") % 3 == 0, F.abs("value")), F.when(F.col("event_id") % 5 != 0, 1.5)).alias("c"))
    return t.groupBy("event_type").agg(F.round(F.sum("c"), 4).alias("cost"), (F.count("*") - F.count("c")).alias("unknown"))


@query(
    "dml3_revision_mode",
    "SELECT artifact_id, CASE WHEN NOT bool_and(kind <> 'heading' OR coalesce(score, 1) >= 0.3) THEN 'full_coverage' WHEN NOT bool_and(coalesce(score, 1) >= 0.1) OR count(CASE WHEN text IS NULL THEN 1 END) > 0 THEN 'targeted' ELSE 'unchanged' END AS mode FROM search_hit GROUP BY 1",
)
def dml3(spark, sf):
    ok = lambda least: F.coalesce(F.col("score"), F.lit(1.0)) >= least
    g = table(spark, sf, "search_hit").groupBy("artifact_id").agg(F.bool_and((F.col("kind") != "heading") | ok(0.3)).alias("coverage"), F.bool_and(ok(0.1)).alias("supported"), F.count_if(F.col("text").isNull()).alias("open"))
    return g.select("artifact_id", S.revision_mode(F.col("coverage"), F.col("supported"), F.col("open")).alias("mode"))


@query(
    "stm5_interrupted_jobs",
    f"SELECT event_id, CASE WHEN s IN ('COMPLETED', 'PARTIAL', 'FAILED', 'CANCELLED') THEN s ELSE 'INTERRUPTED' END AS status, CASE WHEN s IN ('COMPLETED', 'PARTIAL', 'FAILED', 'CANCELLED') THEN false ELSE k IN {_in(S.BILLED_JOBS)} OR event_id % 11 = 0 END AS billing_uncertain FROM (SELECT event_id, {sql_dealt(JOB_STATES, 'event_id')} AS s, {sql_dealt(JOBS, 'user_id')} AS k FROM events)",
)
def stm5(spark, sf):
    t = table(spark, sf, "events").select("event_id", S.after_restart(dealt(JOB_STATES, F.col("event_id")), dealt(JOBS, F.col("user_id")), F.lit(False), F.col("event_id") % 11 == 0).alias("r"))
    return t.select("event_id", "r.status", "r.billing_uncertain")


@query(
    "stm6_open_spans",
    "WITH s AS (SELECT user_id, event_id, ts, event_type, lead(event_type) OVER w AS nx, lead(ts) OVER w AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, event_type, ended IS NULL AS open, coalesce(date_diff('second', ts, ended), 0) AS seconds FROM s",
)
def stm6(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf, "events").withColumn("ended", F.lead("ts").over(w))
    seconds = F.coalesce(F.unix_seconds(F.date_trunc("second", F.col("ended").cast("timestamp"))) - F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))), F.lit(0))
    return t.select("user_id", "event_id", "event_type", F.col("ended").isNull().alias("open"), seconds.alias("seconds"))


@query(
    "stm4_memo",
    "WITH k AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY 1) SELECT doc_id, first_doc, doc_id <> first_doc AS reused FROM k JOIN f USING (h)",
)
def stm4(spark, sf):
    """Equal contents are worked on once; the others take the first one's result."""
    k = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return k.join(k.groupBy("h").agg(F.min("doc_id").alias("first_doc")), "h").select("doc_id", "first_doc", (F.col("doc_id") != F.col("first_doc")).alias("reused"))


@query(
    "x25_file_audit",
    "SELECT page_id, CASE WHEN NOT (coalesce(size_bytes > 0, false) AND coalesce(requested_url = final_url, false) AND http_status = 200) OR coalesce(page_id % 9, 0) = 0 THEN 'FAILED' WHEN text IS NULL THEN 'WARNING' ELSE 'PASSED' END AS audit FROM retrieved_page",
)
def x25(spark, sf):
    c = [F.col("size_bytes") > 0, F.col("requested_url") == F.col("final_url"), F.col("http_status") == 200]
    return table(spark, sf, "retrieved_page").select("page_id", S.audit_status(c, F.col("page_id") % 9, F.col("text").isNotNull()).alias("audit"))


@query(
    "x62_translation_state",
    "SELECT record_id, CASE WHEN title IS NOT NULL AND title <> '' AND (record_id % 4 = 0 OR provider = 'crossref') THEN 'PRESERVED_MANUAL' WHEN seen > 1 THEN 'CACHED' ELSE 'TRANSLATED' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(title, '')) ORDER BY record_id) AS seen FROM paper_metadata)",
)
def x62(spark, sf):
    w = Window.partitionBy(F.md5(F.coalesce("title", F.lit("")))).orderBy("record_id")  # the records of one title
    t = table(spark, sf, "paper_metadata").withColumn("seen", F.row_number().over(w))
    return t.select("record_id", S.translation_state(F.col("record_id") % 4 == 0, F.col("provider") == "crossref", F.col("title"), F.col("seen") > 1).alias("state"))


# --- routes -----------------------------------------------------------------------------------------------------------------


def _case(c: str, scores: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.items()) + " ELSE 0 END"


@query(
    "srt7_browser_score",
    "SELECT page_id, CASE WHEN http_status IN (401, 403) THEN 1000 ELSE 0 END + " + _case(sql_dealt(HOSTS, "page_id"), R.HOST_SCORE) + " + " + _case(sql_dealt(KINDS, "page_id // 5"), R.KIND_SCORE)
    + " + CASE WHEN lower(final_url) LIKE 'https:%' THEN 5 ELSE 0 END + CASE WHEN page_id % 17 = 0 THEN 700 ELSE 0 END - CASE WHEN page_id % 19 = 0 THEN 800 ELSE 0 END AS score FROM retrieved_page",
)
def srt7(spark, sf):
    source = F.when(F.col("page_id") % 17 == 0, "Publisher canonical PDF")
    score = R.browser_score(F.col("http_status").isin(401, 403), dealt(HOSTS, F.col("page_id")), dealt(KINDS, F.floor(F.col("page_id") / 5)), F.col("final_url"), source, F.col("page_id") % 19 == 0)
    return table(spark, sf, "retrieved_page").select("page_id", score.alias("score"))


_PLAIN = "(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(requested_url, '^https://', 'http://') ELSE requested_url END AS url FROM retrieved_page WHERE requested_url IS NOT NULL)"


def _plain(spark, sf):
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("requested_url", "^https://", "http://")).otherwise(F.col("requested_url"))
    return table(spark, sf, "retrieved_page").filter("requested_url is not null").select("page_id", u.alias("url"))


@query("x18_initial_routes", f"SELECT page_id, CAST(i AS INT) AS attempt, CASE WHEN u AND i = 0 THEN 'https://' || substr(url, 8) ELSE url END AS url, CASE WHEN u AND i = 0 THEN 'HTTPS_UPGRADE' ELSE 'DISCOVERY' END AS method FROM (SELECT page_id, url, u, unnest(range(CASE WHEN u THEN 2 ELSE 1 END)) AS i FROM (SELECT *, lower(url) LIKE 'http://%' AS u FROM {_PLAIN}))")
def x18(spark, sf):
    return R.initial_routes(_plain(spark, sf), "url").select("page_id", "attempt", "url", "method")


@query(
    "x11_https_upgrades",
    f"WITH r AS (SELECT split_part(url, '/', 3) AS host, url FROM {_PLAIN}), n AS (SELECT DISTINCT host, 'https://' || substr(url, 8) AS url FROM r WHERE lower(url) LIKE 'http://%') SELECT host, url, false AS upgraded FROM r UNION ALL SELECT host, url, true FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.host = n.host AND r.url = n.url)",
)
def x11(spark, sf):
    return R.https_upgrades(_plain(spark, sf).select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "url"), "host", "url")


@query(
    "x17_page_behind_file",
    "SELECT page_id, final_url FROM retrieved_page WHERE NOT coalesce(is_pdf_response, false) AND final_url IS NOT NULL AND (contains(lower(coalesce(content_type, '')), 'html') OR lower(coalesce(content_type, '')) LIKE 'text/%' OR (requested_url <> final_url AND NOT ends_with(lower(split_part(final_url, '?', 1)), '.pdf')))",
)
def x17(spark, sf):
    t = table(spark, sf, "retrieved_page").filter(~F.coalesce("is_pdf_response", F.lit(False)) & F.col("final_url").isNotNull())
    return t.filter(R.page_behind_file(F.col("content_type"), F.col("requested_url"), F.col("final_url"))).select("page_id", "final_url")


@query(
    "x10_inherited_host",
    f"SELECT page_id, CASE WHEN h <> '' AND (h = p OR (h = q AND t IN ('PUBLISHER', 'REPOSITORY'))) THEN t ELSE 'UNKNOWN' END AS host_type FROM (SELECT page_id, lower(coalesce(regexp_extract(final_url, '^https?://([^/:?#]+)', 1), '')) AS h, lower(regexp_extract(requested_url, '^https?://([^/:?#]+)', 1)) AS q, CASE WHEN page_id % 2 = 0 THEN lower(regexp_extract(final_url, '^https?://([^/:?#]+)', 1)) ELSE 'other.test' END AS p, {sql_dealt(HOSTS, 'page_id')} AS t FROM retrieved_page)",
)
def x10(spark, sf):
    parent = F.when(F.col("page_id") % 2 == 0, F.col("final_url")).otherwise("https://other.test/")
    return table(spark, sf, "retrieved_page").select("page_id", R.inherited_host_type(F.col("final_url"), F.col("requested_url"), parent, dealt(HOSTS, F.col("page_id"))).alias("host_type"))


@query(
    "x14_page_routes",
    r"SELECT record_id, link FROM (SELECT record_id, unnest(links).url AS link FROM paper_metadata) WHERE regexp_matches(link, '^(?i)https?://') AND NOT regexp_matches(link, '(?i)(?:\.pdf(?:$|[?#;])|/pdf(?:/|$|[?#])|/epdf/|[?&](?:format|type|download)=pdf)') AND NOT regexp_matches(link, '(?i)\.(?:css|js|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|zip|gz|mp4|mp3|xml|json)(?:[?#]|$)')",
)
def x14(spark, sf):
    t = table(spark, sf, "paper_metadata").select("record_id", F.explode("links.url").alias("link"))
    return t.select("record_id", R.page_route(F.col("link")).alias("link")).filter("link is not null")


@query("flt9_advertisements", "SELECT page_id, page_id % 7 = 0 AS advertisement FROM retrieved_page")
def flt9(spark, sf):
    ad = F.concat(F.lit("HTTPS://A.CNKI.NET./gw/api/get/pdf/ADS/"), F.col("page_id").cast("string"))
    u = F.when(F.col("page_id") % 7 == 0, ad).when(F.col("page_id") % 7 == 1, F.lit("https://a.cnki.net/gw/api/get/pdf/other")).otherwise(F.col("final_url"))
    return table(spark, sf, "retrieved_page").select("page_id", R.is_advertisement(u).alias("advertisement"))


@query("flt18_expandable", f"SELECT page_id FROM retrieved_page WHERE {sql_dealt(['RESOLVED', 'NO_FILE_CANDIDATES', 'CHALLENGE', 'ERROR'], 'page_id')} IN ('RESOLVED', 'NO_FILE_CANDIDATES')")
def flt18(spark, sf):
    t = table(spark, sf, "retrieved_page")
    return t.filter(dealt(["RESOLVED", "NO_FILE_CANDIDATES", "CHALLENGE", "ERROR"], F.col("page_id")).isin(R.EXPANDABLE)).select("page_id")


# --- places -----------------------------------------------------------------------------------------------------------------

_TURNS = [0, 90, 180, 270]


@query(
    "mth7_shown_box",
    """WITH b AS (SELECT hit_id, [0, 90, 180, 270][CAST(hit_id % 4 AS INT) + 1] AS r, bbox.x0 * 500 AS a, bbox.y0 * 700 AS b, bbox.x1 * 500 AS c, bbox.y1 * 700 AS d FROM search_hit WHERE bbox IS NOT NULL),
    p AS (SELECT hit_id, CASE r WHEN 0 THEN [a - 10, b - 20, c - 10, d - 20, 600.7, 780.3] WHEN 90 THEN [b - 20, 600.7 - (a - 10), d - 20, 600.7 - (c - 10), 780.3, 600.7] WHEN 180 THEN [600.7 - (a - 10), 780.3 - (b - 20), 600.7 - (c - 10), 780.3 - (d - 20), 600.7, 780.3] ELSE [780.3 - (b - 20), a - 10, 780.3 - (d - 20), c - 10, 780.3, 600.7] END AS v FROM b)
    SELECT hit_id, round(greatest(0.0, least(1.0, least(v[1], v[3]) / v[5])), 6) AS x0, round(greatest(0.0, least(1.0, least(v[2], v[4]) / v[6])), 6) AS y0, round(greatest(0.0, least(1.0, greatest(v[1], v[3]) / v[5])), 6) AS x1, round(greatest(0.0, least(1.0, greatest(v[2], v[4]) / v[6])), 6) AS y1 FROM p""",
)
def mth7(spark, sf):
    h = table(spark, sf, "search_hit").filter("bbox is not null")
    box = F.struct((F.col("bbox.x0") * 500).alias("x0"), (F.col("bbox.y0") * 700).alias("y0"), (F.col("bbox.x1") * 500).alias("x1"), (F.col("bbox.y1") * 700).alias("y1"))
    crop = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(610.7).alias("x1"), F.lit(800.3).alias("y1"))
    return h.select("hit_id", P.shown_box(box, crop, dealt(_TURNS, F.col("hit_id"))).alias("b")).select("hit_id", "b.*")


@query("flt12_meaningful_images", "SELECT hit_id FROM search_hit WHERE bbox.x1 - bbox.x0 >= 0.04 AND bbox.y1 - bbox.y0 >= 0.03 AND (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) >= 0.003")
def flt12(spark, sf):
    return table(spark, sf, "search_hit").filter(P.meaningful_image(F.col("bbox"))).select("hit_id")


@query(
    "mth8_caption_distance",
    """WITH c AS (SELECT hit_id AS caption_id, artifact_id, page, bbox AS b FROM search_hit WHERE kind = 'caption' AND bbox IS NOT NULL), o AS (SELECT hit_id AS image_id, artifact_id, page, bbox AS i FROM search_hit WHERE kind = 'other' AND bbox IS NOT NULL),
    d AS (SELECT image_id, caption_id, greatest(0.0, least(i.x1, b.x1) - greatest(i.x0, b.x0)) AS w, least(i.x1 - i.x0, b.x1 - b.x0) AS n, CASE WHEN i.y1 < b.y0 THEN b.y0 - i.y1 WHEN b.y1 < i.y0 THEN i.y0 - b.y1 ELSE 0.0 END AS d FROM o JOIN c USING (artifact_id, page))
    SELECT image_id, caption_id, round(d, 6) AS distance FROM d WHERE n > 0 AND w / n >= 0.15 AND d <= 0.2""",
)
def mth8(spark, sf):
    """Images and captions of a page; a page's boxes are few, and the page is the key."""
    h = table(spark, sf, "search_hit").filter("bbox is not null")
    c = h.filter("kind = 'caption'").select(F.col("hit_id").alias("caption_id"), "artifact_id", "page", F.col("bbox").alias("b"))
    o = h.filter("kind = 'other'").select(F.col("hit_id").alias("image_id"), "artifact_id", "page", F.col("bbox").alias("i"))
    d = o.join(c, ["artifact_id", "page"]).select("image_id", "caption_id", F.round(P.caption_distance(F.col("i"), F.col("b")), 6).alias("distance"))
    return d.filter("distance is not null")


@query(
    "x52_page_tiles",
    "WITH s AS (SELECT page_id, CAST(1000 + page_id % 700 AS INT) AS w, CAST(1400 + page_id % 900 AS INT) AS h FROM retrieved_page), t AS (SELECT page_id, w, h, unnest([{'v': 'overview', 'a': 0.0, 'b': 0.0, 'c': 1.0, 'd': 1.0}, {'v': 'crop1', 'a': 0.0, 'b': 0.0, 'c': 0.55, 'd': 0.55}, {'v': 'crop2', 'a': 0.45, 'b': 0.0, 'c': 1.0, 'd': 0.55}, {'v': 'crop3', 'a': 0.0, 'b': 0.45, 'c': 0.55, 'd': 1.0}, {'v': 'crop4', 'a': 0.45, 'b': 0.45, 'c': 1.0, 'd': 1.0}]) AS z FROM s) "
    "SELECT page_id, z.v AS view, CAST(floor(w * CAST(z.a AS DOUBLE)) AS INT) AS x0, CAST(floor(h * CAST(z.b AS DOUBLE)) AS INT) AS y0, least(w, CAST(floor(w * CAST(z.c AS DOUBLE) + 0.5) AS INT)) AS x1, least(h, CAST(floor(h * CAST(z.d AS DOUBLE) + 0.5) AS INT)) AS y1 FROM t",
)
def x52(spark, sf):
    s = table(spark, sf, "retrieved_page").select("page_id", (1000 + F.col("page_id") % 700).cast("int").alias("w"), (1400 + F.col("page_id") % 900).cast("int").alias("h"))
    return s.select("page_id", F.inline(P.page_tiles(F.col("w"), F.col("h"))))


_PATHS = ["a/b.pdf", "../x", "a/../b", "/etc/x", "C:\\x", "a\\..\\b", "https://h/x", "..a/b", "a/b..", ""]


@query("str33_safe_locator", "SELECT page_id, CAST(page_id % 10 AS INT) IN (0, 7, 8, 9) AS safe FROM retrieved_page")
def str33(spark, sf):
    return table(spark, sf, "retrieved_page").select("page_id", P.safe_locator(dealt(_PATHS, F.col("page_id"))).alias("safe"))


@query(
    "str34_year_in_text",
    r"SELECT record_id, regexp_matches(regexp_replace(regexp_replace(t, '(?im)\bdoi\s*[:：][^\n]*', '', 'g'), '(?i)https?://\S+|10\s*\.\s*[0-9]{4,9}\s*/[^\n]+', '', 'g'), '(^|[^0-9])' || substr(y, 1, 1) || '\s*' || substr(y, 2, 1) || '\s*' || substr(y, 3, 1) || '\s*' || substr(y, 4, 1) || '($|[^0-9])') AS named FROM (SELECT record_id, CAST(year AS VARCHAR) AS y, concat_ws(chr(10), title, 'doi: ' || doi, url, published_date) AS t FROM paper_metadata WHERE year IS NOT NULL)",
)
def str34(spark, sf):
    t = F.concat_ws("\n", "title", F.concat(F.lit("doi: "), "doi"), "url", "published_date")
    return table(spark, sf, "paper_metadata").filter("year is not null").select("record_id", P.year_in_text(F.col("year"), t).alias("named"))


@query("arr3_contiguous_run", "SELECT record_id, CASE WHEN len(authors) >= 3 THEN record_id % 2 = 0 OR authors[1] = authors[2] AND authors[2] = authors[3] ELSE len(authors) = 0 OR (len(authors) = 2 AND record_id % 2 = 0) OR (len(authors) = 1) END AS run FROM paper_metadata WHERE authors IS NOT NULL")
def arr3(spark, sf):
    """Of even records the second and third author are looked for, of odd ones the first and third; lists of one or two are compared with all they have."""
    a = F.col("authors")
    want = F.when(F.size(a) >= 3, F.when(F.col("record_id") % 2 == 0, F.slice(a, 2, 2)).otherwise(F.array(F.get(a, 0), F.get(a, 2)))).when((F.size(a) == 2) & (F.col("record_id") % 2 == 1), F.reverse(F.concat(a, F.array(F.lit("?"))))).otherwise(a)
    return table(spark, sf, "paper_metadata").filter("authors is not null").select("record_id", P.contains_run(a, want).alias("run"))
