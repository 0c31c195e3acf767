import random

from pyspark.sql import functions as F

from litquarry.operators import joins as J
from litquarry.operators import windows as W


def test_admission_is_a_fold(spark):
    r = random.Random(4)
    rows = [(k, i, r.choice([1.0, 7.0, 30.0, None])) for k in range(3) for i in range(20)]
    got = {(x["k"], x["i"]): x["admitted"] for x in W.admit(spark.createDataFrame(rows, "k int, i int, a double"), "k", ["i"], "a", 40.0, 9).collect()}
    for k in range(3):
        used = n = 0
        for kk, i, a in rows:
            if kk == k:
                fits = used + (a or 0) <= 40 and n < 9
                assert got[k, i] == fits
                used, n = used + (a or 0) * fits, n + fits


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 21), (2, 0, 1)], "k int, s int, e int")
    assert sorted(map(tuple, W.interval_union(df, "k", "s", "e").collect())) == [(1, 0, 9, 3), (1, 20, 21, 1), (2, 0, 1, 1)]


def test_box_join_equals_brute_force(spark):
    r = random.Random(1)

    def box():
        x, y = r.random(), r.random()
        return {"x0": x, "y0": y, "x1": min(1.0, x + r.random() * 0.6), "y1": min(1.0, y + r.random() * 0.6)}

    boxes = [(i, i % 2, box()) for i in range(60)]
    df = spark.createDataFrame(boxes, "i int, p int, b struct<x0:double,y0:double,x1:double,y1:double>")
    got = J.box_join(df.select("p", F.col("i").alias("o"), F.col("b").alias("ob")), df.select("p", F.col("i").alias("n"), F.col("b").alias("ib")), ["p"], "ob", "ib").select("o", "n").collect()
    area = lambda b: max(0, b["x1"] - b["x0"]) * max(0, b["y1"] - b["y0"])
    cut = lambda a, b: max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    want = sorted((i, j) for i, p, a in boxes for j, q, b in boxes if p == q and area(b) > 0 and cut(a, b) >= 0.8 * area(b))
    assert sorted(map(tuple, got)) == want


def test_global_numbers(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(50)], "i int, v string")
    got = {r["v"]: r["number"] for r in W.number_globally(df, "v", ["i"]).collect()}
    assert got == {f"v{i}": i + 1 for i in range(7)}


def test_admit_folds_a_hot_key_without_gathering_it(spark):
    import random

    r = random.Random(4)
    data = [("hot" if k % 10 else f"k{k % 70}", k, float(r.randrange(1, 30)) if k % 17 else None) for k in range(4000)]
    df = spark.createDataFrame(data, "u string, i int, a double")
    used, want = {}, set()
    for u, i, a in data:
        a = a or 0.0
        if used.get(u, 0.0) + a <= 500:
            used[u] = used.get(u, 0.0) + a
            want.add(i)
    got = W.admit(df, "u", ["i"], "a", 500.0)
    assert {x["i"] for x in got.filter("admitted").collect()} == want and got.count() == 4000
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert W.admit(df.limit(0), "u", ["i"], "a", 5.0).count() == 0


def test_quotes_meet_blocks_by_an_inner_word(spark):
    """One source with most of the rows: only blocks that share a word of the quote are looked at; short quotes meet all."""
    texts = [f"alpha{k} beta gamma{k % 50} delta water" for k in range(900)]
    b = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)] + [("t", 1000, "other text"), ("s", 1001, None), ("s", 1002, "")], "src string, block int, text string")
    quotes = [(1, "s", "a7 beta gamma7 de"), (2, "s", "ter"), (3, "t", "beta"), (4, "s", None), (5, "s", "delta water")]
    q = spark.createDataFrame(quotes, "qid int, src string, quote string")
    from litquarry.operators.joins import holding

    got = {(r["qid"], r["block"]) for r in holding(q, b, "src", "quote", "text", "block").select("qid", "block").collect()}
    want = {(i, k) for i, s, t in quotes if t for k, x in enumerate(texts) if s == "s" and t in x}
    assert got == want


def test_attachment_roles(spark):
    from litquarry.functions.classify import attachment_role

    rows = [("Peer Review File", "/a"), ("", "/x/review_history.pdf"), ("Reporting-Summary", ""), ("Source  data Fig. 1", ""), ("", "/mm/41467_2020_MOESM1_ESM.pdf"), ("", "/files/suppinfo.pdf"), ("", "/x_supporting_info.pdf"), ("Supplementary%20Table", ""), ("补充材料", None), ("Figure 2", "/moesm1_esm"), ("preview file", "/y"), ("The data", "/z"), (None, None)]
    want = ["PEER_REVIEW", "PEER_REVIEW", "REPORTING_SUMMARY", "SOURCE_DATA", "SUPPLEMENT", "SUPPLEMENT", "SUPPLEMENT", None, "SUPPLEMENT", "SUPPLEMENT", "PEER_REVIEW", None, None]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, label string, path string")
    assert [r["role"] for r in df.select("i", attachment_role(F.col("label"), F.col("path")).alias("role")).orderBy("i").collect()] == want


def test_unique_location_equals_brute_force(spark):
    from litquarry.operators.evidence import unique_location

    r = random.Random(8)
    blocks = [(i, r.choice(["a", "b", None]), None if i == 7 else "".join(r.choice("xy中𝒳 ") for _ in range(r.choice([0, 1, 5, 30])))) for i in range(300)]
    quotes = [(i, r.choice(["a", "b", None]), q) for i, q in enumerate(["", None, "xxxxxxxxxxxx"])]
    for k in range(300):
        _, s, t = r.choice([x for x in blocks if x[2]])
        at, n = r.randrange(len(t)), r.choice([1, 4, 6, 9])
        quotes.append((10 + k, s, t[at : at + n]))
    want = {}
    for qid, s, q in quotes:
        hit = [(b, t.count(q)) for b, c, t in blocks if q and s and c == s and t and q in t]
        if len(hit) == 1 and hit[0][1] == 1:
            want[qid] = hit[0][0]
    got = unique_location(spark.createDataFrame(quotes, "qid int, src string, quote string"), spark.createDataFrame(blocks, "block int, src string, text string"), "src", "quote", "text", "qid", "block").collect()
    assert want and {x["qid"]: x["block"] for x in got} == want and len(got) == len(want)


def test_unique_location_in_a_large_source(spark):
    """Quotes that share their longest word, or have no inner word, do not meet all blocks of their source."""
    import time

    from litquarry.operators.evidence import unique_location

    n = 30_000
    b = spark.range(n).selectExpr("id AS block", "'s' AS src", "CASE WHEN id % 2 = 0 THEN concat('in electrochemistry no ', id, ' of them is here') ELSE concat('盐水淡化膜电极材料的研究进展', id, '号样品') END AS text")
    q = b.selectExpr("block AS qid", "src", "CASE WHEN block % 2 = 0 THEN substr(text, 1, 29) ELSE text END AS quote")
    began = time.perf_counter()
    assert unique_location(q, b, "src", "quote", "text", "qid", "block").filter("qid = block").count() == n
    assert time.perf_counter() - began < 60
