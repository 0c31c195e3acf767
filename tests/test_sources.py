import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from litquarry.functions import jsonfix
from litquarry.operators import candidates as C
from litquarry.operators import content as K
from litquarry.sources import files, html, registries
from litquarry.streaming import events as E


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><base href="https://x.org/a/"><meta name="citation_doi" content="doi:10.1234/Z"><meta name="citation_pdf_url" content="f.pdf"><script type="application/ld+json">{"a":1}</script></head><body><p>One</p><script>no</script><a href="/s/suppl.pdf">PDF</a><a href="b">two</a></body>'
    df = spark.createDataFrame([(1, page, "https://x.org/p"), (2, None, "https://x.org/q"), (3, "<p>cut <a hre", "https://x.org/r")], "page_id int, text string, url string")
    p = html.parse_pages(df, "text").cache()
    r = {x["page_id"]: x["parsed"] for x in p.collect()}
    assert r[1]["title"] == "A & B" and r[1]["visible_text"] == "One\nPDFtwo" and r[1]["json_ld"] == ['{"a":1}'] and len(r[1]["links"]) == 2
    assert r[2] is None and r[3]["visible_text"].startswith("cut")
    assert [x[0] for x in p.filter("page_id = 1").select(html.page_dois(F.col("parsed.metadata"))).collect()] == [["10.1234/z"]]
    files_ = [(x["url"], x["priority"], x["rank"]) for x in html.derive_files(p, "page_id", "parsed", "url").orderBy("rank").collect()]
    assert files_ == [("https://x.org/a/f.pdf", 940, 1), ("https://x.org/s/suppl.pdf", 280, 2)]


def test_registries(spark):
    cr = {"DOI": "10.1234/A", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"name": "Org"}, {}], "container-title": ["J"], "ISSN": ["1", "1"], "issued": {"date-parts": [[2020, 3]]}, "published": {"date-parts": [[None]]}, "link": [{"URL": "u", "content-type": "c"}, {"URL": "u", "content-type": "c"}]}
    df = spark.createDataFrame([(json.dumps(cr),), ("{broken",), (None,)], "j string")
    r = registries.crossref_records(df, "j").collect()
    assert (r[0]["doi"], r[0]["authors"], r[0]["published_date"], r[0]["issn"], len(r[0]["links"]), r[0]["rejected"]) == ("10.1234/a", ["A B", "Org"], "2020-03", ["1"], 1, False)
    assert r[1]["rejected"] and r[2]["rejected"]
    dc = {"doi": "10.1/x", "titles": [{"title": "T"}], "creators": [{"name": "X, Y"}], "container": {"title": "old"}, "relatedItems": [{"relationType": "IsPublishedIn", "titles": [{"title": "new"}], "volume": "3"}]}
    d = registries.datacite_records(spark.createDataFrame([(json.dumps(dc),)], "j string"), "j").first()
    assert (d["journal"], d["volume"], d["doi"]) == ("new", "3", None)
    oa = {"doi": "https://doi.org/10.1234/q", "best_oa_location": {"pdf_url": "https://r.org/a.pdf"}, "locations": [{"is_oa": True, "pdf_url": "https://r.org/a.pdf", "landing_page_url": "https://r.org/a", "version": "acceptedVersion", "source": {"type": "repository"}}, {"is_oa": False, "pdf_url": None, "landing_page_url": "https://p.org", "source": {"type": "journal"}}]}
    got = registries.openalex_candidates(spark.createDataFrame([(json.dumps(oa),)], "j string"), "j").orderBy("url").collect()
    assert [(x["url"], x["url_type"], x["version"], x["host_type"], x["is_best"]) for x in got] == [("https://p.org", "landing", "unknown", "publisher", False), ("https://r.org/a", "landing", "accepted", "repository", True), ("https://r.org/a.pdf", "pdf", "accepted", "repository", True)]


def test_merge_prefers_the_best_and_keeps_the_first(spark):
    rows = [("d", "u", 1, "a", "unknown", "landing", "submitted", "index", False, "", "x"), ("d", "u", 2, "b", "open", "pdf", "published", "publisher", True, "cc", "x"), ("d", "u", 3, "c", "open", "pdf", "published", "publisher", True, None, "y")]
    df = spark.createDataFrame(rows, "doi string, url string, position long, provider string, access_type string, url_type string, version string, host_type string, is_best boolean, license string, source_name string")
    r = C.merge_candidates(df).first()
    assert (r["version"], r["providers"], r["license"], r["source_name"], r["is_best"]) == ("published", ["a", "b", "c"], "cc", None, True)
    c = {x["provider"]: x for x in C.provider_contribution(df).collect()}
    assert c["b"]["shared_routes"] == 1 and c["b"]["exclusive_license"] == 1 and c["a"]["disagreements"] > 0


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {n} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {n}><si><t>he</t><t>llo</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {n}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><f>1+1</f><v>2</v></c><c r="B1"/></row></sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    assert list(files.xlsx_cells(book())) == [("S", "A1", 1, 1, "text", "hello", None), ("S", "AB1", 1, 28, "number", "2", "1+1")]
    with pytest.raises(ValueError):
        list(files.xlsx_cells(book(), most_cells=1))
    (tmp_path / "b.xlsx").write_bytes(book())
    spark.dataSource.register(files.XlsxCells)
    assert spark.read.format("xlsx_cells").option("path", f"{tmp_path}/*.xlsx").load().count() == 2


def test_sidecars_and_lists(spark, tmp_path):
    good = {"schema": "s", "status": "VERIFIED", "target": {"doi": "10.1234/x"}, "retrieval": {"sha256": "a" * 64}, "pdf_validation": {"valid_pdf": True, "page_count": 3}, "identity_validation": {"status": "MATCH", "document_role": "ARTICLE"}}
    (tmp_path / "d").mkdir()
    for name, v in {"a": json.dumps(good), "d/b": json.dumps({**good, "status": "FAILED"}), "c": "{broken"}.items():
        (tmp_path / f"{name}.acquisition.json").write_text(v)
    got = files.gate_code(files.scan_sidecars(spark, str(tmp_path))).select("gate_code").collect()
    assert sorted(r[0] for r in got) == ["NOT_VERIFIED", "OK", "UNREADABLE_SIDECAR"]
    (tmp_path / "l.txt").write_text("# c\n\n10.1234/A\nnothing\n")
    assert [(r["input"], r["doi"]) for r in files.read_doi_list(spark, str(tmp_path / "l.txt")).collect()] == [("10.1234/A", "10.1234/a"), ("nothing", None)]
    lines = ["10.1/a", "## G", "10.1/b", "### H", "10.1/c | tags=x;y | folder=Z", "10.1/d", "[K]", "10.1/e", "##", "10.1/f"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "k string, i int, t string")
    got = {r["input"]: (r["folder"], r["tags"], r["bad_heading"]) for r in files.read_placed_list(df, "k", "i", "t").collect()}
    assert got["10.1/a"] == ("", [], False) and got["10.1/b"][0] == "G" and got["10.1/c"] == ("Z", ["x", "y"], False) and got["10.1/d"][0] == "G/H" and got["10.1/e"][0] == "K" and got["10.1/f"][2]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("H", "text")], "heading string, text string")
    files.write_chunks(c, str(tmp_path / "j"))
    with pytest.raises(Exception):
        files.write_chunks(c, str(tmp_path / "j"))
    r = spark.createDataFrame([(1, "a", "=1+1"), (1, "b", "x")], "id int, field string, value string")
    files.write_table(r, str(tmp_path / "t"), ["id"], "field", "value", ["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first()["a"] == "'=1+1"


def test_chunks_equal_a_plain_fold(spark):
    import random

    r = random.Random(5)
    rows = [("a", i, r.choice(["paragraph"] * 6 + ["heading", "caption"]), f"s{i // 9}", "w " * r.choice([5, 60, 200, 700])) for i in range(60)] + [("a", 60, "paragraph", None, None), ("a", 61, "paragraph", None, "  ")]
    df = spark.createDataFrame(rows, "a string, o long, kind string, section_id string, text string")
    got = [(x["blocks"], x["text"]) for x in K.chunks(df, "a", "o", 300).orderBy("run", "part").collect()]
    want, ids, texts, section = [], [], [], None
    for _, o, kind, s, t in rows:
        t = (t or "").strip()
        if not t:
            continue
        alone = kind in K.SINGLE_KINDS
        if ids and (alone or s != section or len("\n\n".join([*texts, t])) > 300):
            want.append((ids, "\n\n".join(texts)))
            ids, texts = [], []
        section = s
        if alone or len(t) > 300:
            if ids:
                want.append((ids, "\n\n".join(texts)))
                ids, texts = [], []
            want += [([o], p) for p in K.split_text(t, 300)]
            continue
        ids, texts = [*ids, o], [*texts, t]
    if ids:
        want.append((ids, "\n\n".join(texts)))
    assert got == want


def test_union_area(spark):
    b = [("p", {"x0": 0.0, "y0": 0.0, "x1": 2.0, "y1": 2.0}), ("p", {"x0": 1.0, "y0": 1.0, "x1": 3.0, "y1": 3.0}), ("q", None)]
    got = K.union_area(spark.createDataFrame(b, "k string, b struct<x0:double,y0:double,x1:double,y1:double>"), ["k"], "b").collect()
    assert [tuple(x) for x in got] == [("p", 7.0)]


def test_identity(spark):
    df = spark.createDataFrame([(["a"], "a", 0.0), (["b"], "a", 1.0), (["a", "b"], "a", 1.0), ([], "a", 0.9), ([], "a", 0.5)], "d array<string>, t string, s double")
    got = [r[0] for r in df.select(K.paper_identity(F.col("d"), F.col("t"), F.col("s"), F.lit(True))).collect()]
    assert got == ["MATCH", "MISMATCH", "UNKNOWN", "MATCH", "UNKNOWN"]
    s = spark.createDataFrame([("water splitting of foam", "header words water splitting of foam and more")], "t string, x string").select(K.title_in_lead(F.col("t"), F.col("x"))).first()[0]
    assert s == 1.0


def test_json_repair():
    assert jsonfix.recover('{"a": [1, 2]') == {"a": [1, 2]}
    assert jsonfix.recover('{"a": [1, 2}') == {"a": [1, 2]}
    for bad in ("{", '{"a": tru', "x" * 70_000):
        with pytest.raises(ValueError):
            jsonfix.recover(bad + "") if bad != "{" else jsonfix.recover("[{]x")
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "maxItems": 1, "items": {"type": "integer"}}}}
    assert jsonfix.problems({"a": [1]}, schema) == []
    assert jsonfix.problems({"a": [True, 2], "b": 1}, schema) == ["$.b: unknown", "$.a: too many items", "$.a[0]: not integer"]


def test_streams(spark, tmp_path):
    e = spark.sql("select id as event_id, cast('2024-01-01' as timestamp_ntz) + make_interval(0,0,0,0,id,0,0) as ts, id % 3 as user_id, concat('s', id) as event_type, 1.0D as value, '' as props from range(12)")
    e.write.parquet(str(tmp_path / "log"))
    log = E.read_log(spark, str(tmp_path / "log"))
    got = {r["user_id"]: (r["event_type"], r["entries"]) for r in E.drain(E.latest_states(log, "user_id", ["ts", "event_id"], "event_type"), "states_t", "complete").collect()}
    assert got == {0: ("s9", 4), 1: ("s10", 4), 2: ("s11", 4)}
    assert E.drain(E.tumbling(log, "user_id", length="6 hours"), "tumbling_t", "complete").count() == 6
    work = lambda rows: rows.select("event_id")
    for _ in range(2):
        q = E.process_once(log, str(tmp_path / "done"), ["event_id"], work, str(tmp_path / f"cp{_}"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "done")).count() == 12


def test_pdf_dois_and_packs(spark):
    from litquarry.functions.pdftext import extract_pdf_dois
    from litquarry.operators import evidence as V
    from litquarry.operators.aggregates import review_score

    df = spark.createDataFrame([("doi １０. 1234 / a–b. 2020 and 10.1234/c. Next",), (None,)], "t string")
    assert [r[0] for r in df.select(extract_pdf_dois(F.col("t"))).collect()] == [["10.1234/a-b.2020", "10.1234/c"], None]
    b = spark.createDataFrame([("a", 1, 2, "x*y"), ("a", 2, 1, None), ("a", 3, 1, "z")], "k string, o int, p int, t string")
    assert V.pack_markdown(b, "k", "k", ["p", "o"], "p", "t").first()["markdown"] == "# a\n\n- p. 1: z\n- p. 2: x\\*y"
    c = spark.createDataFrame([(1, True, True, True), (1, True, True, False), (2, False, False, True), (3, True, False, False)], "record_id int, expected_present boolean, present boolean, correct boolean")
    assert tuple(review_score(c).first()) == (4, 0.5, 0.333333, 0.5, 0.333333)


def test_greedy_suppression(spark):
    from litquarry.operators import evidence as V

    h = spark.createDataFrame([("a", 1, [1, 2], 3.0), ("a", 2, [2, 9], 2.0), ("a", 3, [5, 6, 7], 1.0), ("b", 1, [1], 1.0)], "k string, i int, b array<int>, s double")
    assert sorted((r["k"], r["i"], r["kept"]) for r in V.keep_greedily(h, "k", "i", "b", "s").collect()) == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)]


def test_request_lists_of_every_kind(spark, tmp_path):
    from litquarry.sources.files import read_requests

    (tmp_path / "a.csv").write_text("﻿doi,title,authors,year,tags\n10.1000/A,,,,\n,A title,\"X Y; Z\",2020,a;b\n,,,2020,\n,Other,,20x,\nnot-a-doi,T,,,\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(["10.1000/A", {"title": "A title", "authors": ["X Y", "Z"], "year": 2020, "tags": "a;b"}, {"year": "2020"}, {"title": "Other", "year": "20x"}, {"doi": "not-a-doi", "title": "T"}]), encoding="utf-8")
    (tmp_path / "c.txt").write_text("# a list\n\n10.1000/A\n  doi:10.1000/B \nnot-a-doi\n", encoding="utf-8")
    for name in ("a.csv", "b.json"):
        got = {r["line"]: r for r in read_requests(spark, str(tmp_path / name)).collect()}
        assert [got[k]["error"] for k in range(1, 6)] == [None, None, "neither doi nor title", "the year has not four digits", "not a doi"]
        assert got[1]["doi"] == "10.1000/a" and got[2]["authors"] == ["X Y", "Z"] and got[2]["tags"] == ["a", "b"] and got[2]["year"] == 2020
    assert [(r["line"], r["doi"]) for r in read_requests(spark, str(tmp_path / "c.txt")).orderBy("line").collect()] == [(1, "10.1000/a"), (2, "10.1000/b"), (3, None)]


def test_corpus_scan_keeps_rejects(spark, tmp_path):
    import hashlib

    from litquarry.sources.files import scan_corpus

    good, other = b"%PDF-1.7 a", b"%PDF-1.7 b"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(good)
    (tmp_path / "copy.pdf").write_bytes(good)
    (tmp_path / "b.pdf").write_bytes(other)
    record = {"schema": "record/v1", "status": "VERIFIED", "target": {"doi": "10.1000/x"}, "retrieval": {"sha256": hashlib.sha256(good).hexdigest()}, "pdf_validation": {"valid_pdf": True, "page_count": 3}, "identity_validation": {"status": "MATCH", "document_role": "ARTICLE"}}
    (tmp_path / "a.acquisition.json").write_text(json.dumps(record))
    (tmp_path / "lost.acquisition.json").write_text(json.dumps(record | {"retrieval": {"sha256": "0" * 64}}))
    (tmp_path / "bad.acquisition.json").write_text("{")
    rows = scan_corpus(spark, str(tmp_path), ["record/v1"]).collect()
    assert sorted(r["gate_code"] for r in rows) == ["OK", "PDF_NOT_FOUND", "PDF_NOT_FOUND", "SIDECAR_NOT_FOUND"]
    ok = next(r for r in rows if r["gate_code"] == "OK")
    assert ok["copies"] == 2 and ok["file_path"].endswith("copy.pdf")
