import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from litquarry.functions import identifiers as I
from litquarry.functions import text as T
from litquarry.functions.digest import canonical_digest
from litquarry.functions.search import contains, score, terms_of


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


DOIS = {
    "10.1234/AbC.5": "10.1234/abc.5",
    " doi: 10.1234/x ": "10.1234/x",
    "DOI：10.1234/x。": "10.1234/x",
    "https://doi.org/10.1234/a%2Fb": "10.1234/a/b",
    "http://dx.doi.org/10.1234/x?y=1": "10.1234/x",
    "(10.1234/x)": "10.1234/x",
    "“10.1234/x”,": "10.1234/x",
    "[10.1234/x(2)]": "10.1234/x(2)",
    "10.1234/x).": "10.1234/x",
    "10.12/x": None,
    "about 10.1234/x": None,
    "": None,
    "doi:": None,
    None: None,
}


def test_normalize_doi(spark):
    assert one(spark, list(DOIS), I.normalize_doi) == list(DOIS.values())


def test_extract_dois(spark):
    text = "see (doi:10.1234/a.b), https://doi.org/10.1234/C，10.1234/a.b。 and x10.1234/no"
    assert one(spark, [text, "", None], I.extract_dois) == [["10.1234/a.b", "10.1234/c"], [], None]


def test_urls(spark):
    cases = {"HTTP://Ex.org/A?b#c": "http://ex.org/A?b", "<https://x.org>": "https://x.org", "http://dx.doi.org/10.1/x": "https://doi.org/10.1/x", "[t](https://a.b/c)": "https://a.b/c", "ftp://x": None, "https://u:p@x.org/": None, "https://x.org/a b": None, None: None}
    assert one(spark, list(cases), I.canonical_url) == list(cases.values())
    assert one(spark, ["http://u@x.org/p;jsessionid=9?a=1&b=2#f"], I.redact_url) == ["http://x.org/p;sessionid=[redacted]?a=%5Bredacted%5D&b=%5Bredacted%5D"]
    assert one(spark, ["http://127.0.0.1/x", "https://x.org/", "http://172.20.1.1/", "http://a.local/"], I.public_host) == [False, True, False, False]


def test_issn(spark):
    assert one(spark, ["0378-5955", "03785955", "2434-561X", "0378-5954", "x", None], I.issn_valid) == [True, True, True, False, False, None]


def test_search_text_matches_brute_force(spark):
    import re

    def brute(s):
        v = unicodedata.normalize("NFKC", s).casefold()
        v = " ".join(re.sub(r"(?<=[a-z])-\s*\n\s*(?=[a-z])", "", v).split())
        v = re.sub(r"[−–—⎯]", "-", re.sub(r"(?<=\d)\s+%", "%", v))
        v = re.sub(r"(?<=\d)[∙⋅](?=\d)", ".", re.sub(r"(?<=[+-])\s+(?=\d)", "", v))
        return re.sub(r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])", "", v)

    cases = ["Straße ﬁlm\tＡ　Ｂ", "co-\n operate 5 %", "− 3⋅4", "水 处 理 x", "", "  "]
    assert one(spark, cases, T.search_text) == [brute(c) for c in cases]


def test_numeric_terms(spark):
    texts = ["12 mg", "0.12 mg", "12.7", "ends at 12.", "1e12", "+12", "12e3", "112"]
    assert one(spark, texts, lambda c: contains(c, "12")) == [True, False, False, True, False, True, False, False]


def test_terms():
    assert terms_of('a "b  c" A') == ["a", "b c"]
    for bad in ("", '"open', '""'):
        with pytest.raises(ValueError):
            terms_of(bad)


def test_score(spark):
    assert one(spark, ["water splitting", "splitting water", "water", "x", None], lambda c: score(c, ["water", "splitting"], "or")) == [3.133333, 1.133333, 0.7, None, None]


def test_citation_labels(spark):
    assert one(spark, ["[1,3-5]", "[5-3]", "[1-40]", "[x]", "[2; 2]"], T.citation_labels) == [[1, 3, 4, 5], [], [], [], [2]]


def test_digest(spark):
    want = hashlib.sha256(json.dumps({"a": "é", "b": 1}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, ['{"b": 1, "a": "é"}', '{"a":"é","b":1}', None], canonical_digest) == [want, want, None]


def test_edit_counts(spark):
    df = spark.createDataFrame([("abcd", "abxde"), ("", ""), (None, "a")], "a string, b string")
    got = [tuple(r[0]) for r in df.select(T.edit_counts("a", "b")).collect()]
    assert got[1] == (0, 0, 0) and got[2] == (0, 1, 0)


@pytest.mark.parametrize("raw, want", [("{{((([[10.1000/Ab.c]])))}}", "10.1000/ab.c"), ("doi: DOI:10.1000/x.,;", "10.1000/x"), ("\"'“10.1000/y”'\".", "10.1000/y"), ("(see", None), ("", None), (None, None)])
def test_identifiers_lose_every_wrapper(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(I.normalize_doi(F.col("d")).alias("n")).first()["n"] == want


@pytest.mark.parametrize("raw, want", [('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "x', None), ('{"a": 1, "a": 2', None), ('{"a": [[[1', None), ('{"a": "b}]", "c": [1}', {"a": "b}]", "c": [1]})])
def test_closers_are_put_outside_strings_only(raw, want):
    from litquarry.functions.jsonfix import recover

    if want is None:
        with pytest.raises(ValueError):
            recover(raw)
    else:
        assert recover(raw) == want


def test_no_repair_beyond_the_limits():
    from litquarry.functions import jsonfix

    with pytest.raises(ValueError, match="too long"):
        jsonfix.recover('{"a": [' + "1," * jsonfix.MOST_POSITIONS + "1}")


@pytest.mark.parametrize("query, terms", [('water "heat  release" water', ["water", "heat release"]), ('a"b c"d', ["a", "b c", "d"]), ("CO₂", ["co2"])])
def test_query_terms(query, terms):
    from litquarry.functions.search import terms_of

    assert terms_of(query) == terms
    for bad in ("", "  ", '""', 'x "y'):
        with pytest.raises(ValueError):
            terms_of(bad)


def test_search_sees_words_that_only_the_view_shows(spark):
    """The first test on the raw text loses nothing: joined line breaks, wide letters, capitals."""
    from litquarry.operators.search import search

    texts = ["Water split", "wa-\nter split", "ｗａｔｅｒ split", "wine", None, "", "WATER and split-\n ting"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for full, want in ((True, [0, 1, 2, 6]), (False, [0, 1, 6])):
        assert sorted(r["i"] for r in search(df, "t", "water split", full=full).collect()) == want
    plan = search(df, "t", "water split", full=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 10


def test_readings_and_markup(spark):
    assert one(spark, ["H₂O ａ b−c", "x²", None], T.reading_key) == ["H₂Oab-c", "x²", None]
    assert one(spark, ["Ａ 5 mL\n水 中", None], T.compared_reading) == ["a5ml水中", None]
    assert one(spark, ["<i>p</i> &lt; 0.05<br/>a<b", "<sup>2</sup><sub>x", "<MML:math>x</MML:math><b/>y", None], T.plain_markup) == ["p < 0.05 a<b", "2<sub>x", "<MML:math>x</MML:math>y", None]
    refs = one(spark, ["[1] A b. [2] C [x] d", "(3) A 1. x (4) B", "1. A b 2. C", "none", None], T.reference_entries)
    assert [[tuple(e) for e in r] if r is not None else None for r in refs][:3] == [[("1", "A b."), ("2", "C [x] d")], [("3", "A 1. x"), ("4", "B")], [("1", "A b"), ("2", "C")]] and not refs[3]


def test_request_keys_are_canonical_json(spark):
    from litquarry.operators.library import request_keys

    schema = "doi string, title string, authors array<string>, journal string, year int, volume string, issue string, pages string, cnki_id string, folder string, filename string, tags array<string>"
    rows = [(None, "A  Title!", ["B. Y", "A. X"], "J. X", 2020, "1", None, None, None, None, None, None), (None, "a title", ["AX", "BY"], "jx", 2020, "1", None, None, None, "f", None, ["t"]), ("10.1/x", None, None, None, None, None, None, None, None, None, None, None)]
    got = request_keys(spark.createDataFrame(rows, schema)).collect()
    assert got[0]["key"] == got[1]["key"] == got[0]["batch_key"] != got[1]["batch_key"] and got[2]["article_id"] == "doi:10.1/x"
    payload = {"doi": None, "title": "atitle", "authors": ["ax", "by"], "journal": "jx", "year": 2020, "volume": "1", "issue": None, "pages": None, "cnki_id": None}
    assert got[0]["key"] == "citation:" + hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_page_geometry(spark):
    from litquarry.functions import places as P

    df = spark.createDataFrame([(r,) for r in (0, 90, 180, 270)], "r int")
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(60.0).alias("y1"))
    crop = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(200.0).alias("y1"))
    got = [tuple(r[0]) for r in df.select(P.shown_box(box, crop, F.col("r"))).collect()]
    assert got == [(0.1, 0.1, 0.3, 0.3), (0.1, 0.7, 0.3, 0.9), (0.7, 0.7, 0.9, 0.9), (0.7, 0.1, 0.9, 0.3)]


def test_notes_below_tables(spark):
    from litquarry.operators.readings import table_notes

    rows = [("a", 1, 1, "caption", "Table 1. x"), ("a", 2, 1, "paragraph", "Conditions: 5 h,"), ("a", 3, 1, "paragraph", "and 80 °C."), ("a", 4, 1, "paragraph", "Text goes on."), ("a", 5, 3, "caption", "Table 2."), ("a", 6, 4, "heading", "Notes")]
    df = spark.createDataFrame(rows, "k string, id long, page int, kind string, text string")
    assert [tuple(r) for r in table_notes(df, "k", "id", F.col("kind") == "caption").collect()] == [("a", 1, [2, 3])]
