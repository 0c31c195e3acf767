import numpy as np
import pytest
from pyspark.sql import functions as F

from litquarry.llm import linkage, mixing, names, pii, pii_made, pii_train, queries
from litquarry.llm.pii_net import TAGS, Tagger
from litquarry.operators import slots

from ..compare import SF, rows, views

AUTHORITY = [(1, "person", "Samuel Amos Kvarárd", None), (2, "person", "Elizabeth Dorrasek", None), (3, "organisation", "Quenfield Academy of Electrochemical Engineering", None), (4, "person", "Shengyi Su", "苏笙弈"), (5, "person", "Theodore Lombström", None)]


@pytest.fixture(scope="module")
def authority(spark):
    return spark.createDataFrame(AUTHORITY, "author_id long, kind string, preferred_name string, native_name string").selectExpr("*", "1 as name", "2 as form")


@pytest.mark.parametrize("written, author", [("Kvarard, S. A.", 1), ("S. Kvarárd", 1), ("sam kvarárd", 1), ("KVARÁRD SA", 1), ("Dr Liz Dorrasek*", 2), ("Elizbaeth Dorrasek", 2), ("E. Dorrasekk", 2), ("QAEE", 3), ("Acad. Electrochem. Eng., Quenfield", 3), ("Quenfield Electrochemical Engineering Academy", 3), ("苏 笙弈", 4), ("Su, S.-Y.", 4), ("Sheng Yi Su", 4), ("T. Lombstroem", 5)])
def test_names_link(spark, authority, written, author):
    got = names.link_names(spark.createDataFrame([(written,)], "name string"), authority).collect()
    assert [r["author_id"] for r in got] == [author]


LONG = [(1, "person", "Juan Carlos Perez Lopez", None), (2, "person", "Maria del Carmen Ortega Ruiz", None), (3, "person", "Ana Maria Silva Costa", None), (4, "person", "Adam Maria Silva Costa", None), (5, "person", "Eleanora Xu", "欧阳娜娜·爱丽丝·徐")]


@pytest.mark.parametrize("written, author", [("Perez Lopez, Juan Carlos", 1), ("Juan Carlos Pérez", 1), ("Juan C. Perez Lopez", 1), ("Ortega Ruiz, M.", 2), ("Silva Costa, A. M.", None), ("Ana Silva Costa", 3), ("欧阳娜娜爱丽丝徐", 5)])
def test_long_names(spark, written, author):
    entries = spark.createDataFrame(LONG, "author_id long, kind string, preferred_name string, native_name string")
    got = names.link_names(spark.createDataFrame([(written,)], "name string"), entries).collect()
    assert [r["author_id"] for r in got] == ([] if author is None else [author]) and all(0.5 < r["confidence"] <= 1 for r in got)


def test_names_of_nobody(spark, authority):
    w = spark.createDataFrame([("Samuel B. Kvarárd",), ("Anna Dorrasek",), ("Rosbury Academy of Electrochemical Engineering",), ("",), (None,), ("  ",), ("?",), ("x" * 5000,)], "name string")
    assert names.link_names(w, authority).count() == 0
    assert names.link_names(w.limit(0), authority).count() == 0


def test_name_elements(spark, authority):
    df = spark.createDataFrame([(1, ["Elizabeth Dorrasek", "Liz Dorrasek", None]), (2, None), (3, [])], "record_id long, authors array<string>").selectExpr("*", "1 as kind")
    got = names.link_elements(names.name_elements(df, "t", "record_id"), authority).select("row_id", "author_pos", "author_id", "kind").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, "exact"), (1, 1, 2, "full")]


def test_copies_do_not_establish_a_slip(spark, authority):
    copied = [(k, ["Elizabeth Dorasek", "Nora Quell"]) for k in range(40)] + [(100 + k, ["Elizabeth Dorrasek", f"Co Author{chr(97 + k)}"]) for k in range(10)]
    df = spark.createDataFrame(copied, "record_id long, authors array<string>")
    got = names.link_elements(names.name_elements(df, "t", "record_id"), authority).filter("kind = 'full_typo'").select("row_id", "author_pos", "author_id").collect()
    assert sorted(map(tuple, got)) == [(k, 0, 2) for k in range(40)]
    # In many different lists it is a name of its own.
    df = spark.createDataFrame([(k, ["Elizabeth Dorasek", f"Co Author{chr(97 + k)}"]) for k in range(20)], "record_id long, authors array<string>")
    assert names.link_elements(names.name_elements(df, "t", "record_id"), authority).count() == 0


REQUEST = "request_id long, doi string, title string, authors array<string>, journal string, year int, volume string, issue string, pages string"
RECORD = REQUEST.replace("request_id", "record_id")


def test_linkage(spark):
    title = "Dye degradation of selenised tungsten bronze under pulsed load in a spiral module"
    q = [(1, None, "Dye degradaton of selenised tungsten bronze under pulsed load", ["R. Normescu"], "J. Appl. Membr. Stud.", 2013, None, None, None), (2, None, title.replace("tungsten bronze", "copper foam"), ["R. Normescu"], None, 2013, None, None, None), (3, "10.1234/z", title, None, None, None, None, None, None), (4, None, None, None, None, None, None, None, None), (5, None, "Reply to comment on: " + title, ["R. Normescu"], None, 2013, None, None, None), (6, None, "", [], "", None, "", "", "")]
    m = [(11, "10.1234/a", title, ["Robert Normescu"], "Journal of Applied Membrane Studies", 2013, "58", "2", "1593–1608"), (12, "doi:10.1234/A", title.upper(), ["Robert Normescu"], None, 2013, "58", None, None), (13, "10.1234/b", "Erratum: " + title, ["Robert Normescu"], None, 2014, "59", None, "3"), (14, None, None, None, None, None, None, None, None)]
    got = linkage.link(spark.createDataFrame(q, REQUEST).selectExpr("*", "1 as class_id", "2 as work"), spark.createDataFrame(m, RECORD).selectExpr("*", "1 as qa")).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, 11), (1, 12)] and all(0.5 <= r[2] <= 1 for r in got)
    assert linkage.link(spark.createDataFrame([], REQUEST), spark.createDataFrame([], RECORD)).count() == 0


def test_later_authors_and_fitted_weights():
    many = [f"Given{chr(97 + k)} Family{chr(97 + k)}" for k in range(14)]
    assert "familyn" in linkage.families(many)
    side = lambda au: {"tokens": ["x"], "cut": False, "fams": linkage.families(au), "jkey": "", "year": 0, "volume": "", "issue": "", "page": "", "kind": "", "part": 0}
    assert linkage.compare(side(["N. Familyn"]), side(many))[linkage.FIELDS.index("authors")] == 3
    # Two classes are told apart by their titles although other fields often agree by chance.
    r = np.random.default_rng(0)
    match = np.c_[r.choice([3, 4], 300, p=[0.2, 0.8]), r.choice([2, 3], 300, p=[0.1, 0.9]), np.zeros((300, 5), int), np.full(300, 2), np.full(300, 3)]
    other = np.c_[r.choice([1, 2], 500, p=[0.95, 0.05]), r.choice([1, 2, 3], 500), np.zeros((500, 5), int), np.full(500, 2), np.full(500, 3)]
    p, m, u = linkage.fit(np.r_[match, other], np.ones(800))
    assert abs(p - 300 / 800) < 0.02
    w = linkage.weights(np.array([[4, 3, 0, 0, 0, 0, 0, 2, 3], [1, 3, 0, 0, 0, 0, 0, 2, 3], [4, 3, 0, 0, 0, 0, 0, 1, 3], [4, 3, 0, 0, 0, 0, 0, 2, 1]]), p, m, u)
    assert w[0] > 3 and w[1] < -3 and w[2] < -3 and w[3] < -3


def test_keys_without_a_partner_are_dropped(spark):
    r = np.random.default_rng(6)
    keys = r.integers(-(2**63), 2**63 - 1, 4000)
    mine = spark.createDataFrame([(k, [int(x) for x in keys[k * 10 : k * 10 + 10]]) for k in range(200)], "class_id long, keys array<long>")
    other = spark.createDataFrame([(int(k), [int(x) for x in keys[1990 + k * 10 : 2000 + k * 10]]) for k in range(200)] + [(200, []), (201, None)], "class_id long, keys array<long>")
    left = {r["class_id"]: r["keys"] for r in linkage._sifted(other, slots.marked(mine.select("keys"), 2000)).collect()}
    assert set(left) == set(range(202)) and left[0] == keys[1990:2000].tolist()  # what has a partner stays, in order
    assert sum(len(x) for x in left.values() if x) < 10 + 0.01 * 2000  # nearly all others go before anything is shuffled


def test_signs_lose_no_pair(spark):
    r = np.random.default_rng(2)
    titles = [[f"w{x}" for x in r.integers(0, 60, r.integers(0, 40))] for _ in range(120)]
    rows = []
    for a, b in zip(titles, titles[1:] + titles[:1]):
        b = b + a[: len(a) // 2]
        rows.append((linkage.share_enough(a, b), *[(*linkage.sign_of(w := linkage.content_of(t)), len(w)) for t in (a, b)]))
    rows += [(False, (*linkage.sign_of({f"a{k}{i}" for i in range(9)}), 9), (*linkage.sign_of({f"b{k}{i}" for i in range(9)}), 9)) for k in range(100)]
    sign = "struct<sign_l:long,sign_h:long,size:int>"
    got = spark.createDataFrame(rows, f"wanted boolean, x {sign}, y {sign}").select("wanted", linkage.may_share("x", "y").alias("may")).collect()
    assert all(g["may"] for g in got if g["wanted"]) and sum(g["may"] for g in got[-100:]) < 20


def test_titles():
    assert linkage.title_parts("Erratum: A study (II)")[1] == "correction"
    assert linkage.title_parts("Study of foam: Part I")[2] == 1 and linkage.title_parts("Study of fo…")[3]
    assert linkage.compare_titles("salt rejection of copper foam mesh".split(), "salt rejection of nickel foam mesh".split(), False) < 4
    assert linkage.compare_titles("salt rejectoin of copper foam".split(), "salt rejection of copper foam".split(), False) == 4


def test_mixing(spark):
    r = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, s, int(t)) for i, (s, t) in enumerate(zip(r.choice(["a", "b", "c"], 3000, p=[0.9, 0.08, 0.02]), r.integers(1, 200, 3000)))], "doc_id long, source string, tokens long").unionByName(spark.createDataFrame([(9999, None, 50)], "doc_id long, source string, tokens long"))
    plans = spark.createDataFrame([(1, "a", 0.5, 2, 0.4), (1, "b", 0.3, 4, 0.4), (1, "c", 0.2, 2, 0.4), (2, "nowhere", 1.0, 2, 0.1)], "plan_id int, source string, target_share double, max_repeats int, total_ratio double")
    sel = mixing.select_mix(docs, plans).cache()
    rep = {(x["plan_id"], x["source"]): x for x in mixing.mix_report(sel, docs, plans).collect()}
    for s in "ab":
        assert abs(rep[1, s]["actual_tokens"] - rep[1, s]["wanted_tokens"]) <= 100 and rep[1, s]["reached"]
    supply = docs.filter("source = 'c'").agg(F.sum("tokens")).first()[0]
    assert not rep[1, "c"]["reached"] and rep[1, "c"]["actual_tokens"] == 2 * supply and rep[1, "c"]["most_copies"] == 2
    assert rep[2, "nowhere"]["actual_tokens"] == 0 and not rep[2, "nowhere"]["reached"]
    assert sel.groupBy("plan_id", "source", "doc_id").count().filter("count > 1").count() == 0
    again = mixing.select_mix(docs, plans)
    assert again.exceptAll(sel).count() == 0
    assert mixing.select_mix(docs.limit(0), plans).count() == 0


def test_mixing_takes_the_best_ranks(spark):
    """The cut equals sorting a source by its rank and taking documents until the size is reached."""
    docs = spark.createDataFrame([(i, "a", i % 9 + 1) for i in range(500)], "doc_id long, source string, tokens long")
    plans = spark.createDataFrame([(1, "a", 1.0, 1, 0.37)], "plan_id int, source string, target_share double, max_repeats int, total_ratio double")
    got = {r["doc_id"] for r in mixing.select_mix(docs, plans).collect()}
    ranked = docs.withColumn("plan_id", F.lit(1)).withColumn("u", mixing._uniform(17)).orderBy("u").collect()
    want, used, goal = set(), 0, 0.37 * sum(r["tokens"] for r in ranked)
    for r in ranked:
        if used >= goal:
            break
        if used + r["tokens"] - goal <= goal - used:
            want.add(r["doc_id"])
        used += r["tokens"]
    assert got == want


def test_unequal_chances(spark):
    """Each document is drawn about as often as its expected copies say, and the cap's loss goes to the others."""
    sizes = [1, 4, 9, 16, 25, 36, 49, 64] * 25
    docs = spark.createDataFrame([(i, "a", t) for i, t in enumerate(sizes)], "doc_id long, source string, tokens long").cache()
    plans = spark.createDataFrame([(1, "a", 1.0, 1, 0.85)], "plan_id int, source string, target_share double, max_repeats int, total_ratio double")
    w, s = np.sqrt(sizes), np.array(sizes, float)
    factor = mixing.scale_for(w, s, 1.0, 0.85 * s.sum())
    expected = np.minimum(factor * w, 1)
    assert abs((expected * s).sum() - 0.85 * s.sum()) < 1e-6 and (expected == 1).any()
    assert mixing.scale_for(w, s, 1.0, 2 * s.sum()) == float("inf") and mixing.scale_for(w, s, 1.0, 0.0) == 0.0
    drawn = np.zeros(len(sizes))
    seeds = 12
    for seed in range(seeds):
        got = mixing.select_mix(docs, plans, seed=seed, size_power=0.5).collect()
        assert abs(sum(r["tokens"] for r in got) - 0.85 * s.sum()) <= 32
        for r in got:
            drawn[r["doc_id"]] += 1 / seeds
    for t in set(sizes):
        assert abs(drawn[s == t].mean() - expected[s == t].mean()) < 0.12


def test_crf_gradient():
    net = Tagger(embed=4, hidden=3, seed=2)
    r = np.random.default_rng(1)
    ids = r.integers(0, 60, (7, 2))
    gold = np.zeros((7, 2), int)
    gold[2, 0], gold[3, 0] = TAGS.index("B-name"), TAGS.index("I-name")
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, g = net.loss_and_grads(ids, gold)
    for k in ("Wf", "Wb", "Wo", "T", "S", "bo", "bf"):
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, h = net.p[k][i], 1e-3
        net.p[k][i] = old + h
        up, _ = net.loss_and_grads(ids, gold)
        net.p[k][i] = old - h
        down, _ = net.loss_and_grads(ids, gold)
        net.p[k][i] = old
        assert abs((up - down) / (2 * h) - g[k][i]) < 2e-3 * max(1, abs(g[k][i]))


def test_viterbi_is_the_best_path():
    import itertools

    net = Tagger(embed=4, hidden=3)
    r = np.random.default_rng(3)
    net.p["T"] = r.standard_normal(net.p["T"].shape).astype(np.float32)
    score = r.standard_normal((3, 1, len(TAGS))).astype(np.float32)
    tr = net.transitions()
    first = [-1e4 if t[0] == "I" else 0 for t in TAGS]
    best = max(itertools.product(range(len(TAGS)), repeat=3), key=lambda p: score[0, 0, p[0]] + first[p[0]] + sum(score[t, 0, p[t]] + tr[p[t - 1], p[t]] for t in (1, 2)))
    assert net.viterbi(score)[:, 0].tolist() == list(best)


@pytest.mark.parametrize("text, want", [
    ("My colleague Jane Doe can be reached at jane.doe@example.org or 415-555-2671.", [("Jane Doe", "name"), ("jane.doe@example.org", "email"), ("415-555-2671", "phone")]),
    ("Ask Peter Hansen in accounting; his badge is AB-229918, phone 0171 4432190.", [("Peter Hansen", "name"), ("AB-229918", "id_number"), ("0171 4432190", "phone")]),
    ("Maria Lopez, 12 Elm Street, Dayton, last Tuesday", [("Maria Lopez", "name"), ("12 Elm Street, Dayton", "address")]),
])
def test_pii_in_other_words(text, want):
    assert [(text[a:b], k) for a, b, k in pii.find_spans([text])[0]] == want


def test_pii_in_contexts_held_out():
    fillers = ["The film was dried at room temperature.", "Losses of the anode prevailed.", "We thank the reviewers of the journal."]
    got = pii_train.scores(pii_made.made(np.random.default_rng(21), 400, fillers, held=True), pii.tagger())
    assert got["email"][0] > 0.97 and got["email"][1] > 0.97 and got["address"][0] > 0.9 and got["address"][1] > 0.9 and got["name"][0] > 0.95 and got["name"][1] > 0.8
    assert got["phone"][0] > 0.85 and got["phone"][1] > 0.6 and got["id_number"][0] > 0.6 and got["id_number"][1] > 0.75


def test_windows_of_one_text_agree_with_the_whole():
    """A value anywhere in a long text is found at its place, also across the seams of windows and groups of windows."""
    for shift in range(0, 330, 37):
        text = "x" * shift + " the film was dried. Please contact Elizabeth Dorrasek (liz.dorrasek@chemlab.test) for the raw data. " + "The anode was dried. " * 40
        got = {(text[a:b], k) for a, b, k in pii.find_spans([text] * 3)[1]}
        assert got == {("Elizabeth Dorrasek", "name"), ("liz.dorrasek@chemlab.test", "email")}


def test_pii(spark):
    text = "The anode was dried. Please contact Elizabeth Dorrasek (liz.dorrasek@chemlab.test) for the raw data. Call +1 555 555 0184 before visiting the test site. Version 555.01.98 of the fitting script was run @ 838 rpm."
    found = pii.find_spans([text, None, "", "  ", text * 40])
    assert {(text[a:b], k) for a, b, k in found[0]} == {("Elizabeth Dorrasek", "name"), ("liz.dorrasek@chemlab.test", "email"), ("+1 555 555 0184", "phone")}
    assert found[1] == found[2] == found[3] == [] and len(found[4]) >= 110
    assert pii.redact(text, found[0]).startswith("The anode was dried. Please contact [NAME] ([EMAIL]) for")
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as pii_type")
    assert pii.pii_spans(df).count() == 3 and pii.pii_spans(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["masked"] for r in pii.mask_pii(df).collect()}[2] is None


COLUMNS = {
    "p1_found": "id_a id_b src_table", "p1_classes": "class_id forms id src_table", "p1_unified": "id src_table unified", "p2_found": "hit_id", "p2_pieces": "end_char hit_id piece piece_no start_char",
    "p3_found": "noise row_id src_table", "p3_hits": "hit_id repaired", "p3_artifacts": "artifact_id page paragraph_no text", "p4_found": "author_id author_pos row_id src_table",
    "p4_links": "author_id author_pos confidence kind name row_id src_table", "p5_found": "record_id request_id", "p5_matches": "confidence record_id request_id", "p6_found": "page_id", "p7_ids": "doc_id ids",
    "p8_mix": "copies doc_id plan_id source tokens", "p8_shares": "actual_share actual_tokens documents max_repeats most_copies plan_id reached source target_share wanted_tokens",
    "p9_found": "doc_id pii_type start_char", "p9_masked": "doc_id masked",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_hold_what_they_promise(spark, name):
    """Columns as agreed, rows that are there, each once, and ids that the tables hold."""
    got = queries.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert " ".join(sorted(got.columns)) == COLUMNS[name]
    pdf = got.toPandas()
    assert len(pdf)
    flat = pdf.drop(columns=[c for c in pdf.columns if c in ("ids", "text", "piece", "repaired", "masked", "unified")])
    assert not flat.duplicated().any()
    for column, source in (("doc_id", "documents"), ("hit_id", "search_hit"), ("page_id", "retrieved_page"), ("request_id", "paper_request")):
        if column in pdf:
            known = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(column).collect()}
            assert set(pdf[column]) <= known
    if name == "p1_found":
        assert (pdf["id_a"] < pdf["id_b"]).all()
    if name in ("p7_ids", "p9_masked"):
        assert len(pdf) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.startswith("p5_m") or name == "p4_links":
        assert pdf["confidence"].between(0.5, 1).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(views().execute(queries.ORACLE[name]).df())
