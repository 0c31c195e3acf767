import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litquarry.llm import pages, pieces, scans, tokens, unify

one = lambda s: unify.unify_arrow(pa.array([s], type=pa.string()))[0].as_py()


@pytest.mark.parametrize("a, b", [("ﬁlm", "film"), ("Ａ１％", "A1%"), ("é", "é"), ("bοron", "boron"), ("⽔", "水"), ("a​b", "ab"), ("x y", "x y"), ("re‑do", "re-do"), ("한", "한"), ("сова", "сова"), ("ԁata", "data"), ("ɡas", "gas"), ("Ԝater", "Water"), ("ꓢtudy", "Study"), ("Ꭺlkali", "Alkali"), ("mօde", "mode")])
def test_looks_the_same(a, b):
    assert one(a) == one(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("CO₂", "CO2"), ("e", "é"), ("a.", "a"), ("a\nb", "a b"), ("<i>a</i>", "a"), ("𝑥", "x"), ("a–b", "a-b")])
def test_looks_different(a, b):
    assert one(a) != one(b)


@given(st.lists(st.text(alphabet=st.sampled_from("aeuAÉéņ̣̃́̈ḉệ ぁ한각"), max_size=12) | st.none(), max_size=6))
@settings(max_examples=150, deadline=None)
def test_composition_matches_the_standard_form(texts):
    got = unify.unify_arrow(pa.array(texts, type=pa.string())).to_pylist()
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_unify_slices_and_long_texts():
    arr = pa.array(["ﬁ" * 400_000, None, "", "x​"])
    assert unify.unify_arrow(arr.slice(0, 4)).to_pylist() == ["fi" * 400_000, None, "", "x"]
    assert unify.unify_arrow(arr.slice(2, 2)).to_pylist() == ["", "x"]


def test_pairs(spark):
    df = spark.createDataFrame([("t", 1, "ﬁlm"), ("t", 2, "film"), ("t", 3, "film"), ("t", 4, None), ("t", 5, ""), ("u", 6, "film"), ("t", 7, "Film")], "src_table string, id long, text string").selectExpr("*", "1 as key", "2 as form")
    assert sorted(map(tuple, unify.lookalike_pairs(df).collect())) == [("t", 1, 2), ("t", 1, 3)]
    assert unify.lookalike_pairs(df.limit(0)).count() == 0


@given(st.text(alphabet="ab .\n;,!水。", max_size=300), st.integers(1, 40), st.integers(0, 50))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_and_overlap(text, limit, overlap):
    b = pieces.bounds(text, limit, overlap)
    if not text:
        assert b == []
        return
    lap = max(0, min(overlap, limit - 1))
    assert b[0][0] == 0 and b[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in b)
    assert all(s2 == e1 - lap and e2 > e1 for (_, e1), (s2, e2) in zip(b, b[1:]))


def test_letters_keep_their_marks():
    text = "ab" + "e" + "\u0301" * 30 + "cd" * 20
    for limit in (34, 36, 40):
        assert all(not unicodedata.combining(text[a]) for a, _ in pieces.bounds(text, limit, 0))
    assert all(0 < b - a <= 8 for a, b in pieces.bounds("\u0301" * 50, 8, 2))


def test_crowded_forms_and_classes(spark):
    rows = [("t", k, "ﬁlm" if k < 40 else "film") for k in range(45)] + [("t", 100, "other")]
    df = spark.createDataFrame(rows, "src_table string, id long, text string")
    want = sorted(("t", a, b) for a in range(40) for b in range(40, 45))
    assert sorted(map(tuple, unify.lookalike_pairs(df, hot=10, salts=4).collect())) == sorted(map(tuple, unify.lookalike_pairs(df).collect())) == want
    assert sorted(map(tuple, unify.lookalike_classes(df).collect())) == [("t", k, 0, 2) for k in range(45)]
    assert unify.lookalike_classes(df.limit(0)).count() == 0


def test_pieces_prefer_natural_ends(spark):
    assert [x for x in pieces.bounds("One two. Three four five. Six.", 17, 0)] == [(0, 9), (9, 26), (26, 30)]
    df = spark.createDataFrame([(1, "a b c d", 3, 1), (2, None, 3, 1), (3, "", 3, 1), (4, "ab", None, None), (4, "ab", 9, 1), (5, "abc", 0, 0)], "id long, t string, m int, o int").selectExpr("*", "'x' as piece")
    got = pieces.split_texts(df, "id", "t", "m", "o").collect()
    assert sorted({r["id"] for r in got}) == [1, 4, 5] and max(len(r["piece"]) for r in got if r["id"] == 1) <= 3
    assert pieces.oversized(pieces.split_texts(df, "id", "t", "m", "o"), "id").collect()[0][0] == 1


def _reference():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(tokens.tokenizer_path("byte_bpe_50k"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_match_a_reference_encoder():
    ref, enc = _reference(), tokens.encoder(tokens.tokenizer_path("byte_bpe_50k"))

    @given(st.text(max_size=80) | st.text(alphabet="ab'sdl  \n\t　\xa0中é1²<|endoftext|>​", max_size=60))
    @settings(max_examples=400, deadline=None)
    def check(s):
        s = s.encode("utf-8", "ignore").decode()
        assert enc.encode(s) == ref.encode_ordinary(s)

    check()
    long = "abcdefgh" * 20_000
    assert enc.encode(long) == ref.encode_ordinary(long)


def test_tokens_of_rows(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, None), (3, ""), (4, "Hello"), (5, " ")], "doc_id long, text string").selectExpr("*", "1 as ids")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] != [] and len(got[5]) == 1
    assert tokens.encode_corpus(df.limit(0)).count() == 0


LEX = scans.Lexicon({"measured": 900, "chloride": 500, "recycled": 90, "purchase": 80, "modern": 40, "the": 9000, "of": 9000, "water": 800, "mesh": 300}, {"the water": 50}, 20000)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text(alphabet="measurdchlowt", min_size=2, max_size=9))
@settings(max_examples=200, deadline=None)
def test_retrieval_is_complete(word):
    got = set(LEX.retrieve(word, 1, every=True))
    assert {w for w in LEX.counts if levenshtein(word, w) <= 1} <= got


@pytest.mark.parametrize("w", ["mcasured", "chl0ride", "recyded", "piirchase", "rnodern", "wat^r", "l982", "2O15", "watcr"])
def test_misreads(w):
    assert LEX.misread(w)


@pytest.mark.parametrize("w", ["measured", "KN-7274", "1982", "SnO2", "unknownword", "S12", "H2O", "µmol"])
def test_no_misreads(w):
    assert not LEX.misread(w)


@pytest.mark.parametrize("w, wrong", [("水" * 40 + "■" + "水" * 40, True), ("水" * 80, False), ("a" * 20 + "�" + "b" * 20, True), ("https://x.test/" + "a" * 60 + "■", False)])
def test_signs_in_long_tokens(w, wrong):
    assert scans.read_line(w, LEX) is wrong


WIDE = scans.Lexicon({"correct": 90, "catalyst": 80, "the": 9000, "water": 500, "flow": 500, "hochtemperaturfestoxidbrennstoffzelle": 50}, {"the water": 50, "water flow": 20}, 20000)


@pytest.mark.parametrize("line, wrong", [("the (orrect temperature was", True), ("the (atalyst was measured", True), ("the B123.5 temperature", True), ("the B1234.56 was", True), ("a hochtemperaturfestoxidbrennstoffze1le", True), ("a hochtemperaturfestoxidbrennstoffzcllc", True), ("使用cata1yst膜", True), ("the wader flow", True), ("a wader sea", False), ("H2O O2 SnO2", False), ("f901a5c33463815b875c9b8e98e6097b", False), ("the (correct) water", False)])
def test_lines_read_whole(line, wrong):
    assert scans.read_line(line, WIDE) is wrong
    assert scans.read_line(line, WIDE) is wrong  # also with remembered verdicts


def test_furniture_of_fragments(spark):
    """By place, setting and repetition: a tall page keeps its body lines, a header within the usual body height is found."""
    rows, n = [], 0
    for page in range(1, 5):
        for k in range(12):
            n += 1
            rows.append((n, "low", page, f"{chr(96 + page)}{chr(97 + k)} body of the text", 50.0, 700.0 - 20 * k, 10.0, False))
            rows.append((1000 + n, "tall", page, f"{chr(96 + page)}{chr(97 + k)} body of the text", 50.0, 840.0 - 20 * k, 10.0, False))
        rows.append((500 + page, "low", page, f"Running header {page}", 120.0, 740.0, 8.5, False))
        rows.append((600 + page, "low", page, f"- {page} -", 250.0, 40.0, 8.5, False))
        rows.append((700 + page, "low", page, f"Heading of part {'abcd'[page - 1]}", 50.0, 720.0, 12.0, True))
    f = spark.createDataFrame(rows, "fragment_id long, artifact_id string, page int, text string, x double, y double, font_size double, bold boolean")
    h = spark.createDataFrame([], "hit_id long, text string")
    got = sorted(r["row_id"] for r in scans.find_noise(f, h).filter("noise = 'furniture'").collect())
    assert got == [501, 502, 503, 504, 601, 602, 603, 604]


def test_paragraphs_over_many_pages(spark):
    rows, n = [], 0
    for page in range(1, 6):
        for k in range(4):
            n += 1
            x = 62.0 if (page, k) in ((1, 0), (5, 2)) else 50.0
            rows.append((n, "a", page, f"{chr(96 + page)}{chr(97 + k)} text goes on", x, 700.0 - 20 * k, 10.0, False))
    f = spark.createDataFrame(rows, "fragment_id long, artifact_id string, page int, text string, x double, y double, font_size double, bold boolean")
    got = {(r["page"], r["paragraph_no"]): r["text"] for r in scans.repair_fragments(f, LEX).collect()}
    whole = " ".join(r[3] for r in rows)
    cut = whole.index("ec text")
    assert got == {(1, 1): whole[:cut].strip(), (5, 1): whole[cut:]}


def test_breaks_and_furniture():
    assert scans.broken("of the mea-", "sured water") and scans.broken("Tarnów-", "Dolny") and not scans.broken("the pre-", "and post-test") and not scans.broken("x -", "y") and not scans.broken("", "a")
    lines = ["The water was mea-", "– 12 –", "sured twice in the old mesh of", "Acta Ionica, Vol. 12", "the plant."]
    assert scans.furniture_lines(lines) == {1, 3}
    assert scans.mend(["The watcr was mea-", "sured in the mesh."], LEX) == "The water was measured in the mesh."


def test_noise_rows(spark):
    f = spark.createDataFrame([(1, "a", 1, "the wat^r was mea-", 50.0, 700.0, 9.0, False), (2, "a", 1, "sured. The end", 50.0, 690.0, 9.0, False), (3, "a", 1, "ii", 200.0, 30.0, 8.0, False), (4, "a", 1, None, 50.0, 600.0, 9.0, False), (5, "a", 1, "the wat^r was mea-", 50.0, 700.0, 9.0, False)], "fragment_id long, artifact_id string, page int, text string, x double, y double, font_size double, bold boolean").selectExpr("*", "1 as before", "2 as col")
    h = spark.createDataFrame([(1, "the water"), (2, None), (3, ""), (4, "chl■ride")], "hit_id long, text string")
    got = sorted(map(tuple, scans.find_noise(f, h).collect()))
    assert got == [("fragment", 1, "hyphen_break"), ("fragment", 1, "misread"), ("fragment", 3, "furniture"), ("fragment", 5, "hyphen_break"), ("fragment", 5, "misread"), ("search_hit", 4, "misread")]
    assert scans.find_noise(f.limit(0), h.limit(0)).count() == 0


def test_long_repeated_responses(spark):
    items = " ".join(f"<li>Volume list {k}</li>" for k in range(120))
    system = f"<p>Error 503.</p><ul>{items}</ul><p>Readers everywhere value quick responses from us.</p>"
    rows = [(k, f"https://h{k}.test/ionic-membranes-{k}", f"https://h{k}.test/ionic-membranes-{k}", f"<title>Ionic foam {chr(97 + k)}</title>{system}", False) for k in range(4)]
    # The address names what the body is about.
    rows += [(10 + k, f"https://g{k}.test/readers-value-quick-responses", f"https://g{k}.test/readers-value-quick-responses", f"<title>Ionic foam {chr(97 + k)}</title>{system}", False) for k in range(4)]
    p = spark.createDataFrame(rows, "page_id long, requested_url string, final_url string, text string, is_pdf_response boolean")
    h = spark.createDataFrame([(r[0], f"Ionic foam {r[0]}", None) for r in rows], "page_id long, title string, visible_text string")
    assert sorted(r[0] for r in pages.excluded_pages(p, h).collect()) == [0, 1, 2, 3]


def test_copies_do_not_vouch_for_their_misreads(spark):
    good = [(k, f"a{k}", 1, f"probe {chr(97 + k % 26)}{chr(97 + k // 26)}q was measured", 50.0, 700.0, 9.0, False) for k in range(100)]
    copies = [(200 + k, "z", 1, "then rneasured again", 50.0, 600.0, 9.0, False) for k in range(60)]
    f = spark.createDataFrame(good + copies, "fragment_id long, artifact_id string, page int, text string, x double, y double, font_size double, bold boolean")
    h = spark.createDataFrame([(k, "first line\r\nthen rneasured again") for k in range(60)], "hit_id long, text string")
    got = sorted(map(tuple, scans.find_noise(f, h).collect()))
    assert got == [("fragment", 200 + k, "misread") for k in range(60)] + [("search_hit", k, "misread") for k in range(60)]


def test_prose_with_words_of_messages(spark):
    said = ["The error of the measurement was below two percent for all samples.", "Cookies and sorry results of human trials were excluded from this cohort study.", "Enzyme traps are not available for human tissue."]
    assert [pages.sort_sentence(x, "") for x in said] == ["doubt"] * 3
    rows = [(k, f"https://h{k}.test/a", f"<title>T</title><p>{x} All samples were dried at room temperature before use. The film thickness was measured by profilometry.</p>", False) for k, x in enumerate(said)]
    rows += [(10 + k, f"https://h{k}.test/error-tissue-cohort", f"<title>T</title><p>{x}</p>", False) for k, x in enumerate(said)]
    rows.append((15, "https://h.test/y", "<title>Scaling in membranes</title><p>A loss of flux was not found in any of the membranes.</p>", False))
    rows.append((20, "https://h.test/x", "<title>Ionic foam</title><p>Fatal error. The session of this reader has expired already.</p>", False))
    p = spark.createDataFrame(rows, "page_id long, final_url string, text string, is_pdf_response boolean").withColumn("requested_url", F.col("final_url"))
    h = spark.createDataFrame([], "page_id long, title string, visible_text string")
    assert [r[0] for r in pages.excluded_pages(p, h).collect()] == [20]


def test_pages(spark):
    body = "<p>The residual was dominated by losses of the anode, not by water itself.</p>"
    cases = {1: f"<html><title>T</title><body><nav>Home</nav>{body}</body></html>", 2: "<html><title>T</title><body><p>{{abstract}}</p></body></html>", 3: "<body><noscript>Please enable JavaScript.</noscript></body>", 4: "<body><p>404 – the page you asked for is not here.</p></body>", 5: f"<body><noscript>Please enable JavaScript.</noscript>{body}</body>", 6: "<body><p>Lorem ipsum dolor sit amet elit.</p></body>", 7: None, 8: "<p>The resid"}
    p = spark.createDataFrame([(k, f"https://h{k}.test/x", f"https://h{k}.test/x", v, False) for k, v in cases.items()] + [(9, "https://x.test/", "https://x.test/", "<p>{{x}}</p>", True)], "page_id long, requested_url string, final_url string, text string, is_pdf_response boolean").selectExpr("*", "1 as prose", "2 as host")
    h = spark.createDataFrame([(7, "T", "Just a moment.")], "page_id long, title string, visible_text string")
    assert sorted(r[0] for r in pages.excluded_pages(p, h).collect()) == [2, 3, 4, 6, 7, 8]
    assert pages.excluded_pages(p.limit(0), h.limit(0)).count() == 0
