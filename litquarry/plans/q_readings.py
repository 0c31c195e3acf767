"""Queries of records, readings, notes, selections, libraries and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litquarry.functions import text as T
from litquarry.operators import readings as R
from litquarry.plans.q_states import dealt, sql_dealt, sql_list
from litquarry.plans.registry import query
from litquarry.session import table
from litquarry.sources.files import parser_gate
from litquarry.streaming import events as E

# The check each fault is caught by, in their order; the last one is no fault.
FAULTS = [
    "PDF_NOT_FOUND", "UNVERIFIED_PATH", "SIDECAR_NOT_FOUND", "INVALID_SIDECAR", "UNKNOWN_SIDECAR_SCHEMA", "STATUS_NOT_VERIFIED", "PDF_VALIDATION_FAILED", "IDENTITY_NOT_MATCHED", "DOCUMENT_NOT_ARTICLE",
    "DOI_MISMATCH", "INVALID_RECORDED_HASH", "PDF_HASH_MISMATCH", "INVALID_SIDECAR", "PDF_UNREADABLE", "PAGE_COUNT_MISMATCH", "OK",
]


@query("src4_parser_gate", f"SELECT page_id, {sql_list(FAULTS)}[CAST(least(page_id % 16, page_id // 16 % 16) AS INT) + 1] AS gate_code FROM retrieved_page")
def src4_gate(spark, sf):
    """Every row is a record with two faults dealt out by its id; the earlier check names it."""
    n = F.col("page_id")
    has = lambda k: (n % 16 == k) | (F.floor(n / 16) % 16 == k)
    pick = lambda k, bad, good: F.when(has(k), bad).otherwise(good)
    digest = F.sha2(n.cast("string"), 256)
    records = table(spark, sf, "retrieved_page").select(
        "page_id",
        pick(0, F.lit(None).cast("string"), pick(1, F.lit("/library/_Unverified/a.pdf"), F.lit("/library/a.pdf"))).alias("file_path"),
        pick(2, F.lit(None).cast("string"), F.lit("/library/a.json")).alias("path"),
        pick(3, F.lit("{"), F.lit(None).cast("string")).alias("_corrupt"),
        pick(4, F.lit("other/v9"), F.lit("record/v1")).alias("schema"),
        pick(5, F.lit("FAILED"), F.lit("VERIFIED")).alias("status"),
        F.struct((~has(6)).alias("valid_pdf"), pick(12, F.lit(0), F.lit(7)).alias("page_count")).alias("pdf_validation"),
        F.struct(pick(7, F.lit("MISMATCH"), F.lit("MATCH")).alias("status"), pick(8, F.lit("SUPPLEMENT"), F.lit("ARTICLE")).alias("document_role")).alias("identity_validation"),
        F.struct(F.lit("10.1234/a").alias("doi"), F.lit("T").alias("expected_title")).alias("target"),
        pick(9, F.lit("10.1234/b"), F.lit("doi:10.1234/A")).alias("asked_doi"),
        F.struct(pick(10, F.lit("xyz"), digest).alias("sha256")).alias("retrieval"),
        pick(11, F.sha2(F.lit("changed"), 256), F.upper(digest)).alias("file_sha256"),
        pick(13, F.lit(-1), pick(14, F.lit(8), F.lit(7))).alias("file_pages"),
    )
    return parser_gate(records, ["record/v1"]).select("page_id", "gate_code")


def _entries_sql() -> str:
    styles = [r"\[([0-9]{1,3})\]", r"\(([0-9]{1,3})\)", r"([0-9]{1,3})\."]
    at = [rf"CASE WHEN regexp_matches(text, '(?:^|\s){p}\s') THEN length(regexp_extract(text, '(?s)^(.*?)(?:^|\s){p}\s', 1)) END" for p in styles]
    marked = [rf"regexp_replace(text, '(^|\s){p}(\s)', chr(31) || '\2' || chr(30) || '\3', 'g')" for p in styles]
    case = "CASE " + " ".join(f"WHEN a{k} = least(coalesce(a0, 1000000000), coalesce(a1, 1000000000), coalesce(a2, 1000000000)) THEN {m}" for k, m in enumerate(marked)) + " END"
    return f"WITH p AS (SELECT hit_id, text, {', '.join(f'{a} AS a{k}' for k, a in enumerate(at))} FROM search_hit WHERE kind = 'reference'), m AS (SELECT hit_id, string_split({case}, chr(31)) AS parts FROM p), e AS (SELECT hit_id, unnest(parts[2:]) AS x FROM m) SELECT hit_id, split_part(x, chr(30), 1) AS label, length(trim(split_part(x, chr(30), 2))) AS characters FROM e"


@query("arr6_reference_entries", _entries_sql())
def arr6(spark, sf):
    h = table(spark, sf, "search_hit").filter("kind = 'reference'").select("hit_id", F.inline(T.reference_entries(F.col("text"))))
    return h.select("hit_id", "label", F.length(F.trim("text")).alias("characters"))


_HELD = "greatest(least(p.x1, a.x1) - greatest(p.x0, a.x0), 0) * greatest(least(p.y1, a.y1) - greatest(p.y0, a.y0), 0) >= 0.8 * ((a.x1 - a.x0) * (a.y1 - a.y0)) AND (a.x1 - a.x0) * (a.y1 - a.y0) > 0"


@query(
    "jn11_tightest_primary",
    f"WITH a AS (SELECT hit_id AS reading, artifact_id, page, bbox AS a FROM search_hit WHERE kind IN ('equation', 'other') AND bbox IS NOT NULL), p AS (SELECT hit_id AS block, artifact_id, page, bbox AS p FROM search_hit WHERE kind NOT IN ('equation', 'other') AND bbox IS NOT NULL) SELECT reading, arg_min(block, (greatest(p.x1 - p.x0, 0) * greatest(p.y1 - p.y0, 0), block)) AS block, count(*) AS candidates FROM a JOIN p USING (artifact_id, page) WHERE {_HELD} GROUP BY 1",
)
def jn11(spark, sf):
    h = table(spark, sf, "search_hit").filter("bbox is not null")
    a = h.filter("kind in ('equation', 'other')").select(F.col("hit_id").alias("reading"), "artifact_id", "page", F.col("bbox").alias("a"))
    p = h.filter("kind not in ('equation', 'other')").select(F.col("hit_id").alias("block"), "artifact_id", "page", F.col("bbox").alias("p"))
    return R.tightest_primary(a, p, ["artifact_id", "page"], "reading", "block")


_INSIDE = _HELD.replace("p.x", "b.x").replace("p.y", "b.y").replace("a.x", "w.x").replace("a.y", "w.y")
_AROUND = _HELD.replace("p.x", "w.x").replace("p.y", "w.y").replace("a.x", "b.x").replace("a.y", "b.y")


@query(
    "jn26_block_warnings",
    f"WITH w AS (SELECT hit_id AS warning, artifact_id, page, section_id, bbox AS w FROM search_hit WHERE kind = 'caption'), b AS (SELECT hit_id AS block, artifact_id, page, section_id AS s, bbox AS b FROM search_hit WHERE kind <> 'caption') SELECT DISTINCT warning, block FROM w JOIN b USING (artifact_id, page) WHERE section_id = s OR (w IS NOT NULL AND b IS NOT NULL AND (({_INSIDE}) OR ({_AROUND})))",
)
def jn26(spark, sf):
    h = table(spark, sf, "search_hit")
    w = h.filter("kind = 'caption'").select(F.col("hit_id").alias("warning"), "artifact_id", "page", "section_id", F.col("bbox").alias("w"))
    b = h.filter("kind <> 'caption'").select(F.col("hit_id").alias("block"), "artifact_id", "page", "section_id", F.col("bbox").alias("b"))
    return R.warnings_of_blocks(w, b, ["artifact_id", "page"], "warning", "block", "section_id")


@query("win3_table_notes")
def win3(spark, sf):
    h = table(spark, sf, "search_hit").filter("text is not null").select("artifact_id", "hit_id", "page", "kind", "text")
    return R.table_notes(h, "artifact_id", "hit_id", (F.col("kind") == "caption") & F.lower("text").startswith("table"))


@query("agg18_reading_differences")
def agg18(spark, sf):
    """Every text against the next one of its artifact, as if they were two readings of a place."""
    w = Window.partitionBy("artifact_id").orderBy("hit_id")
    h = table(spark, sf, "search_hit").filter("text is not null").withColumn("other", F.lead("text").over(w)).filter("other is not null")
    return h.select("hit_id", R.reading_difference("text", "other").alias("d")).select("hit_id", "d.status", F.size("d.changes").alias("changes"))


_IDS_SQL = "CASE WHEN hit_id % 5 = 0 THEN '' WHEN hit_id % 5 = 1 THEN 'record-' || CAST(hit_id % 7 AS VARCHAR) ELSE 'r' || CAST(hit_id % 4 AS VARCHAR) END"


@query(
    "prj16_record_ids",
    f"WITH r AS (SELECT artifact_id, hit_id, {_IDS_SQL} AS id FROM search_hit), t AS (SELECT artifact_id, list(DISTINCT id) AS taken FROM r GROUP BY 1), n AS (SELECT r.*, taken, 'record-' || CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY hit_id) AS VARCHAR) AS stem, row_number() OVER (PARTITION BY artifact_id, id ORDER BY hit_id) AS seen FROM r JOIN t USING (artifact_id)) "
    "SELECT hit_id, CASE WHEN trim(id) <> '' AND seen = 1 THEN id WHEN NOT list_contains(taken, stem) THEN stem ELSE list_filter(list_transform(range(2, len(taken) + 3), lambda k: stem || '-' || CAST(k AS VARCHAR)), lambda x: NOT list_contains(taken, x))[1] END AS new_id FROM n",
)
def prj16(spark, sf):
    n = F.col("hit_id")
    i = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit("record-"), (n % 7).cast("string"))).otherwise(F.concat(F.lit("r"), (n % 4).cast("string")))
    return R.filled_ids(table(spark, sf, "search_hit").select("artifact_id", "hit_id", i.alias("id")), "artifact_id", "hit_id", "id").select("hit_id", "new_id")


@query(
    "prj11_compact_material",
    "SELECT hit_id, CAST(coalesce(kind = 'paragraph', false) AS INT) + CAST(coalesce(lang = 'en', false) AS INT) + CAST(section_id IS NULL AS INT) + CAST(score IS NULL AS INT) AS omitted, true AS restored FROM search_hit",
)
def prj11(spark, sf):
    """Fields at their defaults are left out of the compact form; reading it with the defaults gives every field back."""
    h = table(spark, sf, "search_hit").select("hit_id", "kind", "lang", "section_id", "score")
    drop = lambda c, d: F.when(~F.col(c).eqNullSafe(F.lit(d)), F.coalesce(F.col(c), F.lit("\x00null"))).alias(c)
    compact = F.to_json(F.struct(drop("kind", "paragraph"), drop("lang", "en"), "section_id", "score"))
    x = h.withColumn("compact", compact).withColumn("r", F.from_json("compact", "kind string, lang string, section_id string, score double"))
    back = lambda c, d: F.nullif(F.coalesce(F.col(f"r.{c}"), F.lit(d)), F.lit("\x00null"))
    same = back("kind", "paragraph").eqNullSafe(F.col("kind")) & back("lang", "en").eqNullSafe(F.col("lang")) & F.col("r.section_id").eqNullSafe(F.col("section_id")) & F.col("r.score").eqNullSafe(F.col("score"))
    return x.select("hit_id", (4 - F.size(F.json_object_keys("compact"))).alias("omitted"), same.alias("restored"))


@query(
    "x36_selected_hits",
    "WITH h AS (SELECT hit_id, CAST(hit_id AS VARCHAR) AS a, CAST(hit_id % 1000000 AS VARCHAR) AS b FROM search_hit), s AS (SELECT request_id AS position, CASE request_id % 3 WHEN 0 THEN CAST(request_id % 700 AS VARCHAR) WHEN 1 THEN (SELECT min(a) FROM h) ELSE 'none' END AS selector FROM paper_request) SELECT hit_id, min(position) AS position FROM s JOIN h ON selector = a OR selector = b GROUP BY 1",
)
def x36(spark, sf):
    h = table(spark, sf, "search_hit").select("hit_id", (F.col("hit_id") % 1000000).alias("number"))
    r = table(spark, sf, "paper_request").crossJoin(F.broadcast(h.agg(F.min("hit_id").cast("string").alias("least"))))  # one row
    s = r.select(F.col("request_id").alias("position"), F.when(F.col("request_id") % 3 == 0, (F.col("request_id") % 700).cast("string")).when(F.col("request_id") % 3 == 1, F.col("least")).otherwise("none").alias("selector"))
    return R.selected(h, s, "number", "hit_id")[0]


@query(
    "x33_document_context",
    "SELECT DISTINCT b.hit_id FROM search_hit b JOIN (SELECT DISTINCT artifact_id, page FROM search_hit WHERE kind = 'equation') q ON b.artifact_id = q.artifact_id AND b.page BETWEEN q.page - 1 AND q.page + 1",
)
def x33(spark, sf):
    """Blocks on the pages of equations and those beside them: pages are spread out, then joined on equality."""
    h = table(spark, sf, "search_hit")
    q = h.filter("kind = 'equation'").select("artifact_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct()
    return h.join(q, ["artifact_id", "page"], "left_semi").select("hit_id")


@query(
    "x37_warning_boxes",
    "SELECT hit_id, round(greatest(0.0, least(1.0, bbox.x0 * 617.3 / w)), 6) AS x0, round(greatest(0.0, least(1.0, bbox.y0 * 811.7 / h)), 6) AS y0, round(greatest(0.0, least(1.0, bbox.x1 * 617.3 / w)), 6) AS x1, round(greatest(0.0, least(1.0, bbox.y1 * 811.7 / h)), 6) AS y1 FROM (SELECT hit_id, bbox, 590 + page % 3 * 10 AS w, 780 + page % 2 * 40 AS h FROM search_hit WHERE bbox IS NOT NULL)",
)
def x37(spark, sf):
    """Points of pages of three widths and two heights as shares of the page, clipped to it."""
    share = lambda c, n, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"bbox.{c}") * n / F.col(size))), 6).alias(c)
    h = table(spark, sf, "search_hit").filter("bbox is not null").withColumn("w", 590 + F.col("page") % 3 * 10).withColumn("h", 780 + F.col("page") % 2 * 40)
    return h.select("hit_id", share("x0", 617.3, "w"), share("y0", 811.7, "h"), share("x1", 617.3, "w"), share("y1", 811.7, "h"))


@query(
    "x61_known_attachments",
    "SELECT page_id, row_number() OVER (PARTITION BY md5(text), host ORDER BY fetched_at, page_id) > 1 AS reused FROM (SELECT page_id, text, fetched_at, split_part(final_url, '/', 3) AS host FROM retrieved_page WHERE text IS NOT NULL AND final_url IS NOT NULL)",
)
def x61(spark, sf):
    t = table(spark, sf, "retrieved_page").filter("text is not null and final_url is not null").select("page_id", F.md5("text").alias("h"), F.split_part("final_url", F.lit("/"), F.lit(3)).alias("host"), "fetched_at")
    first = t.groupBy("h", "host").agg(F.min_by("page_id", F.struct("fetched_at", "page_id")).alias("first"))
    return t.join(first, ["h", "host"]).select("page_id", (F.col("page_id") != F.col("first")).alias("reused"))


@query("x27_recoverable", "SELECT DISTINCT requested_url FROM retrieved_page p WHERE http_status IN (403, 429, 500, 502, 503, 504) AND NOT EXISTS (SELECT 1 FROM retrieved_page q WHERE q.requested_url = p.requested_url AND q.http_status = 200)")
def x27(spark, sf):
    t = table(spark, sf, "retrieved_page").select("requested_url", "http_status")
    failed = t.filter(F.col("http_status").isin(403, 429, 500, 502, 503, 504)).select("requested_url").distinct()
    return failed.join(t.filter("http_status = 200").select("requested_url"), "requested_url", "left_anti")


@query(
    "jn23_mutable_labels",
    "SELECT request_id, CASE WHEN request_id % 3 <> 0 THEN 'initial' WHEN request_id % 9 = 0 THEN 'stale' ELSE 'edited' END AS state, CASE WHEN request_id % 3 <> 0 THEN len(coalesce(tags, [])) WHEN request_id % 9 = 0 THEN NULL ELSE 1 END AS labels FROM paper_request",
)
def jn23(spark, sf):
    """Labels edited later count where their record names the file as it is; a record of another file is stale."""
    files = table(spark, sf, "paper_request").select("request_id", "tags", F.md5(F.coalesce("title", F.lit(""))).alias("sha"))
    records = files.filter("request_id % 3 = 0").select("request_id", F.when(F.col("request_id") % 9 == 0, F.md5(F.lit("other"))).otherwise(F.col("sha")).alias("of"), F.array(F.lit("mine")).alias("edited"))
    x = files.join(records, "request_id", "left")
    state = F.when(F.col("of").isNull(), "initial").when(F.col("of") != F.col("sha"), "stale").otherwise("edited")
    tags = F.when(state == "initial", F.coalesce("tags", F.array().cast("array<string>"))).when(state == "edited", F.col("edited"))
    return x.select("request_id", state.alias("state"), F.when(tags.isNotNull(), F.size(tags)).alias("labels"))


@query(
    "dml5_named_collections",
    f"SELECT name, op, members FROM (SELECT user_id % 40 AS name, arg_max({sql_dealt(['put', 'put', 'rename', 'delete'], 'event_id')}, (ts, event_id)) AS op, count(DISTINCT user_id) AS members FROM events GROUP BY 1) WHERE op <> 'delete'",
)
def dml5(spark, sf):
    """A log of changes to named things folded to what is left: the last change of each name holds."""
    e = table(spark, sf, "events").select((F.col("user_id") % 40).alias("name"), "user_id", F.struct("ts", "event_id").alias("at"), dealt(["put", "put", "rename", "delete"], F.col("event_id")).alias("op"))
    return e.groupBy("name").agg(F.max_by("op", "at").alias("op"), F.count_distinct("user_id").alias("members")).filter("op <> 'delete'")


_KEY = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"


@query(
    "jn19_resolved_titles",
    f"WITH q AS (SELECT request_id, year, {_KEY} AS k FROM paper_request WHERE doi IS NULL), m AS (SELECT lower(doi) AS d, year, {_KEY} AS k FROM paper_metadata WHERE doi IS NOT NULL), c AS (SELECT request_id, d, bool_and(q.year IS NULL OR m.year IS NULL OR q.year = m.year) AS agrees FROM q JOIN m USING (k) WHERE length(k) >= 10 GROUP BY 1, 2) SELECT request_id, CASE WHEN count(*) FILTER (WHERE agrees) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(*) FILTER (WHERE agrees) = 1 THEN min(d) FILTER (WHERE agrees) END AS doi FROM c GROUP BY 1",
)
def jn19(spark, sf):
    """Titles that are the same but for case and signs; resolved where one DOI without conflict is left."""
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("k")
    q = table(spark, sf, "paper_request").filter("doi is null").select("request_id", F.col("year").alias("y"), key)
    m = table(spark, sf, "paper_metadata").filter("doi is not null").select(F.lower("doi").alias("d"), "year", key).distinct()
    agrees = F.bool_and(F.col("y").isNull() | F.col("year").isNull() | (F.col("y") == F.col("year")))
    c = q.filter(F.length("k") >= 10).join(m, "k").groupBy("request_id", "d").agg(agrees.alias("agrees"))
    one = F.count_if("agrees") == 1
    return c.groupBy("request_id").agg(F.when(one, "RESOLVED").otherwise("AMBIGUOUS").alias("status"), F.when(one, F.min(F.when(F.col("agrees"), F.col("d")))).alias("doi"))


@query("flt4_parse_status", f"SELECT page_id, {sql_dealt(['PARSED', 'PARTIAL', 'FAILED', 'NOT_PARSED'], 'page_id')} AS status FROM retrieved_page WHERE {sql_dealt(['PARSED', 'PARTIAL', 'FAILED', 'NOT_PARSED'], 'page_id')} IN ('PARSED', 'PARTIAL')")
def flt4(spark, sf):
    s = dealt(["PARSED", "PARTIAL", "FAILED", "NOT_PARSED"], F.col("page_id"))
    return table(spark, sf, "retrieved_page").filter(s.isin("PARSED", "PARTIAL")).select("page_id", s.alias("status"))


@query("flt5_collection_members", "SELECT record_id FROM paper_metadata WHERE doi IN (SELECT doi FROM paper_request WHERE doi IS NOT NULL) AND journal IN (SELECT journal FROM paper_request WHERE journal IS NOT NULL)")
def flt5(spark, sf):
    q = table(spark, sf, "paper_request")
    return table(spark, sf, "paper_metadata").join(q.select("doi"), "doi", "left_semi").join(q.select("journal"), "journal", "left_semi").select("record_id")


@query("srt10_recent_runs", "SELECT page_id, fetched_at FROM retrieved_page ORDER BY fetched_at DESC, page_id LIMIT 20")
def srt10(spark, sf):
    return table(spark, sf, "retrieved_page").orderBy(F.desc("fetched_at"), "page_id").limit(20).select("page_id", "fetched_at")


@query("srt11_jobs_by_creation", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)")
def srt11(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("n"))


@query("str23_reading_keys")
def str23(spark, sf):
    """Texts by what recognition may have read: how many writings each key has."""
    h = table(spark, sf, "search_hit").filter("text <> ''").select("text", T.reading_key(F.col("text")).alias("k"))
    return h.groupBy(F.xxhash64("k").alias("reading")).agg(F.count("*").alias("rows"), F.count_distinct("text").alias("writings"))


@query("str24_compared_readings")
def str24(spark, sf):
    return table(spark, sf, "search_hit").filter("text is not null").select("hit_id", F.length(T.compared_reading(F.col("text"))).alias("characters"))


@query("str29_plain_titles")
def str29(spark, sf):
    return table(spark, sf, "paper_metadata").filter("title is not null").select("record_id", T.plain_markup(F.col("title")).alias("title"))


@query("stm_daily_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stm_daily(spark, sf):
    """Event-time windows of the log as a stream, all of it kept."""
    w = E.tumbling(E.read_log(spark, f"{sf}/events.parquet"), "event_type")
    return E.drain(w, "daily", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stm_sessions",
    "WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k",
)
def stm_sessions(spark, sf):
    s = E.sessions(E.read_log(spark, f"{sf}/events.parquet"), "user_id")
    d = E.drain(s, "sessions", "complete")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")
