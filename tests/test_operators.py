import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, evidence, index, judge, lookup, metrics, planning, ranking
from millrace.sources import formats
from millrace.streaming import incremental


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def of(spark, text):
    return spark.createDataFrame([(text,)], "t string")


def test_tokens(spark):
    assert one(of(spark, "ABC-1 营业收入"), T.tokenize(F.col("t"))) == ["abc-1", "营业", "业收", "收入", "营业收", "业收入", "营业收入"]
    assert one(of(spark, "中"), T.tokenize(F.col("t"))) == ["中"]
    assert one(of(spark, None), T.tokenize(F.col("t"))) == [] == one(of(spark, ""), T.tokenize(F.col("t")))
    assert one(of(spark, "Ａ１"), T.tokenize(F.col("t"))) == ["a1"]


def test_nfkc(spark):
    assert one(of(spark, "ﬁ①％"), T.nfkc("t")) == "fi1%"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("c1", "d1", "apple pear"), ("c2", "d1", "apple apple plum"), ("c3", "d2", ""), ("c4", "d2", "plum pear fig")], "chunk_id string, doc_id string, body string")


def test_search_by_hand(spark, docs):
    import math

    q = spark.createDataFrame([("q", "apple apple fig")], "qid string, text string")
    got = {r["chunk_id"]: r["score"] for r in index.search(docs, q).collect()}
    n, mean = 4, 8 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    w = lambda df, tf, size: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
    assert got == pytest.approx({"c1": w(2, 1, 2), "c2": w(2, 2, 3), "c4": w(1, 1, 3)})
    twice = {r["chunk_id"]: r["score"] for r in index.score(index.tokenized(docs, F.col("body")), q, repeated=True).collect()}
    assert twice["c1"] == pytest.approx(2 * got["c1"])


def test_filter_keeps_statistics_and_normalises_after(spark, docs):
    q = spark.createDataFrame([("q", "apple plum", [], [])], "qid string, text string, numbers array<string>, dates array<string>")
    scope = spark.createDataFrame([("q", "d2")], "qid string, doc_id string")
    free = {r["chunk_id"]: r["score"] for r in index.search(docs, q).collect()}
    held = {r["chunk_id"]: r["score"] for r in index.search(docs, q, doc_filter=scope).collect()}
    assert held == {"c4": free["c4"]}
    assert index.field_search(docs, q, {"base": "body"}, doc_filter=scope).first()["score"] == pytest.approx(1.0)


def test_search_counts_every_term(spark):
    words = [f"w{i:03}" for i in range(200)]
    rows = [("c0", "d0", " ".join(words))] + [(f"c{i:03}", "d1", " ".join(words[:40])) for i in range(1, 4)]  # the first 40 are frequent
    long = spark.createDataFrame(rows, "chunk_id string, doc_id string, body string")
    q = spark.createDataFrame([("q", " ".join(words))], "qid string, text string")
    got = {r["chunk_id"]: r["score"] for r in index.search(long, q).collect()}
    assert set(got) == {"c0", "c001", "c002", "c003"}  # found by frequent terms alone, behind 160 rarer ones
    held = {r["chunk_id"]: r["score"] for r in index.search(long, q, doc_filter=spark.createDataFrame([("q", "d1")], "qid string, doc_id string")).collect()}
    assert held == pytest.approx({c: x for c, x in got.items() if c != "c0"})


def scored_by_hand(rows, queries, most=160):
    """{(qid, key): score} of texts of words that need no n-grams; queries have their terms."""
    import math
    from collections import Counter

    texts = [(key, Counter(body.split())) for key, body in rows]
    mean, df = sum(x.total() for _, x in texts) / len(texts), Counter(w for _, x in texts for w in x)
    idf = lambda w: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
    kept = {q: sorted((w for w in set(text.split()) if df[w]), key=lambda w: (df[w], w))[:most] for q, text in queries}
    return {(q, key): x for q, terms in kept.items() for key, tf in texts if (x := sum(idf(w) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * tf.total() / mean)) for w in terms if tf[w]))}


@pytest.fixture(scope="module")
def many():
    import random

    rng = random.Random(3)
    words = lambda most: " ".join(f"w{min(int(rng.expovariate(0.04)), 150)} v{rng.randrange(300)}" for _ in range(rng.randrange(1, most)))
    return [(f"c{i:04}", f"d{i % 50}", words(25)) for i in range(2500)], [(f"q{i}", words(9)) for i in range(40)]


def test_search_takes_the_terms_of_few_queries_through_the_driver_at_a_time(spark, many, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("all terms of all queries in the driver"))
    monkeypatch.setattr(index, "QUERIES", 15)
    rows, queries = many
    got = index.search(spark.createDataFrame(rows, "chunk_id string, doc_id string, body string"), spark.createDataFrame(queries, "qid string, text string"), 7).collect()
    want = scored_by_hand([(c, body) for c, _, body in rows], queries)
    for qid, _ in queries:
        best = sorted(((-round(x, 6), c) for (q, c), x in want.items() if q == qid))[:7]
        own = sorted((r["rank"], r["chunk_id"], r["doc_id"], round(r["score"], 6)) for r in got if r["qid"] == qid)
        assert [c for _, c, _, _ in own] == [c for _, c in best]
        assert [x for *_, x in own] == pytest.approx([-x for x, _ in best]) and all(d == f"d{int(c[1:]) % 50}" for _, c, d, _ in own)


def test_document_search_in_domains(spark, many):
    rows, queries = many
    chunks, asked = spark.createDataFrame(rows, "chunk_id string, doc_id string, body string"), spark.createDataFrame(queries, "qid string, text string")
    of = {q: [{"a"}, {"b"}, {"a", "b"}, set()][i % 4] for i, (q, _) in enumerate(queries)}, {f"d{i}": [{"a"}, {"b"}, {"c"}, {"a", "b"}, set()][i % 5] for i in range(60)}
    domains = tuple(spark.createDataFrame([(x, d) for x, own in each.items() for d in own or [None]], f"{key} string, domain string") for each, key in zip(of, ("qid", "doc_id")))
    found = index.document_search(chunks, asked, 4, domains=domains)
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()}
    texts = [(f"d{i}", " ".join(body for _, d, body in rows if d == f"d{i}")) for i in range(50)]
    every = scored_by_hand(texts, queries)
    want = {(q, n): (d, -x) for q, _ in queries for n, (x, d) in enumerate(sorted((-x, d) for (own, d), x in every.items() if own == q and of[0][q] & of[1][d])[:4], 1)}
    assert {x: d for x, (d, _) in got.items()} == {x: d for x, (d, _) in want.items()} and len(got) > 100
    assert [got[x][1] for x in sorted(got)] == pytest.approx([want[x][1] for x in sorted(got)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan  # queries meet documents of their domain where these are scored, not in pairs


def test_counts_of_scores_are_made_in_blocks(spark, many):
    from millrace.plans import retrieval

    rows, queries = many
    chunks = spark.createDataFrame([(c, body) for c, _, body in rows], "chunk_id string, body string")
    got = {r["qid"]: (r["n"], r["top"]) for r in index.score_counts(index.tokenized(chunks, F.col("body")), spark.createDataFrame(queries, "qid string, text string"), 5).collect()}
    every = scored_by_hand([(c, body) for c, _, body in rows], queries, 5)
    want = {q: own for q, _ in queries if (own := [x for (o, _), x in every.items() if o == q])}
    assert {q: n for q, (n, _) in got.items()} == {q: len(x) for q, x in want.items()}
    assert [got[q][1] for q in sorted(got)] == pytest.approx([max(want[q]) for q in sorted(got)])
    found = retrieval.x_score_repeated(spark, "/root/testdata/sf0.001") if Path("/root/testdata/sf0.001").exists() else None
    assert found is None or "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each question and chunk


def test_field_search_takes_the_terms_of_few_queries_through_the_driver_at_a_time(spark, many, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("all terms of all queries in the driver"))
    monkeypatch.setattr(index, "QUERIES", 15)
    rows, queries = many
    title = lambda c, body: " ".join(body.split()[: int(c[1:]) % 4])
    chunks = spark.createDataFrame([(c, d, body, title(c, body)) for c, d, body in rows], "chunk_id string, doc_id string, body string, title string")
    asked = spark.createDataFrame([(q, text, [], []) for q, text in queries], "qid string, text string, numbers array<string>, dates array<string>")
    got = {(r["qid"], r["rank"]): (r["chunk_id"], r["score"]) for r in index.field_search(chunks, asked, {"base": "body", "title": "title"}, 4).collect()}
    total = {}
    for share, part in ((1.0, scored_by_hand([(c, body) for c, _, body in rows], queries)), (0.3, scored_by_hand([(c, title(c, body)) for c, _, body in rows], queries, 32))):
        top = {}
        for (q, _), x in part.items():
            top[q] = max(x, top.get(q, 0))
        for (q, c), x in part.items():
            total[q, c] = total.get((q, c), 0) + share * x / top[q]
    want = {(q, n): (c, -x) for q, _ in queries for n, (x, c) in enumerate(sorted((-round(x, 6), c) for (own, c), x in total.items() if own == q)[:4], 1)}
    assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()}
    assert [got[x][1] for x in sorted(got)] == pytest.approx([want[x][1] for x in sorted(got)], abs=1e-6)


def test_plans_of_a_field_search_stay_small_and_broadcasts_count_every_field(spark, many, monkeypatch):
    rows, asked = many
    chunks, queries = spark.createDataFrame(rows[:300], "chunk_id string, doc_id string, body string"), spark.createDataFrame(asked, "qid string, text string")
    bodies = chunks.select("chunk_id", "doc_id", *[F.col("body").alias(f) for f in ("base", "title", "section", "clause")])
    search = lambda: index.field_search(bodies, queries, {f: f for f in ("base", "title", "section", "clause")}, 3)
    plans, held, join = [], [], F.broadcast
    score = index.block_best
    monkeypatch.setattr(index, "block_best", lambda found, *a, **kw: plans.append(found._jdf.queryExecution().executedPlan().toString()) or score(found, *a, **kw))
    monkeypatch.setattr(F, "broadcast", lambda df: held.append(df.columns) or join(df))
    every = sorted(map(tuple, search().collect()))
    assert plans[0].count("InMemoryTableScan") == 1  # the texts; what was made of the queries is a scan of rows
    terms = queries.select(T.term_runs(F.col("text")).alias("runs"))
    distinct = T.token_rows(terms, "runs").distinct().count()
    monkeypatch.setattr(index, "MOST_DISTINCT", distinct + 1)
    before, held[:] = [x for x in held if "one" in x], []
    assert before and every == sorted(map(tuple, search().collect()))
    assert not [x for x in held if "one" in x]  # four fields have four times as many rows


def test_terms_meet_in_the_documents_of_a_query(spark, docs):
    q = spark.createDataFrame([("q", "apple plum pear"), ("r", "pear")], "qid string, text string")
    scope = spark.createDataFrame([("q", "d1"), ("r", "d2"), ("r", "d2")], "qid string, doc_id string")
    tokens = index.tokenized(docs, F.col("body"))
    every = {(r["q"], r["c"]): r["score"] for r in index.hashed_scores(tokens, q).collect()}
    held = {(r["q"], r["c"]): r["score"] for r in index.hashed_scores(tokens, q, scope=scope, homes=docs).collect()}
    assert len(every) == 5 and len(held) == 3 and held == pytest.approx({x: every[x] for x in held})


def test_feedback_broadcasts_neither_tokens_of_queries_nor_rarities(spark, tmp_path):
    from millrace.operators import feedback

    seeds = [("q1", 2, "x7 y8", "Alpha Beta", "s3", "", "table", ["12%", "35"], []), ("q1", 1, None, "", "s3", "Alpha Beta", "text", ["35"], None), ("q2", 1, None, "known", "", "", None, None, None), ("q1", 7, None, "late", "", "", None, None, None)]
    frames = {
        "targets": spark.createDataFrame([("q1", ["what about", "12%", "late"]), ("q2", ["known"])], "qid string, variants array<string>"),
        "seeds": spark.createDataFrame(seeds, "qid string, rank int, text string, title string, section string, clause_id string, chunk_type string, numbers array<string>, dates array<string>"),
        "rarity": spark.createDataFrame([("alpha", 2.0), ("beta", 5.0), ("35", 1.0), ("s3", 1.0), ("unused", 9.0)], "term string, idf double").select(F.xxhash64("term").alias("h"), "idf"),
    }
    for name, frame in frames.items():
        frame.write.parquet(str(tmp_path / name))
    found = feedback.feedback_queries(*[spark.read.parquet(str(tmp_path / name)) for name in frames])
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    # Alpha Beta as a clause 5 + 1.0; s3 1 + 0.4; 35 1 + 0.15; table 0 + 0.2.
    assert list(map(tuple, found.collect())) == [("q1", "what about 12% Alpha Beta s3 35 table")]


def test_written_index(spark, docs, tmp_path):
    q = spark.createDataFrame([("q", "apple fig")], "qid string, text string")
    index.write_index(docs, str(tmp_path))
    a = {r["chunk_id"]: round(r["score"], 9) for r in index.search_index(spark, str(tmp_path), q).collect()}
    assert a == {r["chunk_id"]: round(r["score"], 9) for r in index.search(docs, q).collect()}


def test_document_search_covers_whole_documents(spark):
    rows = [(f"c{i:03}", "long", "甲乙丙丁 " * 100) for i in range(60)] + [("c999", "long", "灯塔"), ("e1", "short", "灯塔 甲乙"), ("e2", "other", "戊己")]
    parts = spark.createDataFrame(rows, "chunk_id string, doc_id string, body string")
    q = spark.createDataFrame([("q", "灯塔")], "qid string, text string")
    got = {r["doc_id"]: r["score"] for r in index.document_search(parts, q).collect()}
    assert set(got) == {"long", "short"}  # the term stands behind the first 24,000 characters of the long one
    joined = spark.createDataFrame([(d, "\n".join(b for _, e, b in rows if e == d)) for d in ("long", "short", "other")], "doc_id string, body string")
    assert got == pytest.approx({r["doc_id"]: r["score"] for r in index.best_scores(index.tokenized(joined, F.col("body"), "doc_id"), q, 8, key="doc_id").collect()})


def test_sweep_by_blocks_equals_pairs(spark):
    import random

    from millrace.operators import sweeps

    rng = random.Random(2)
    word = lambda: rng.choice(["利润", "4", "11", "净利润", "2,310元", "2023年", "罚款", "2024年1月3日", "，12％"])
    chunks = [(f"c{i:03}", rng.choice(["d1", "d2"]), None if i % 29 == 0 else " ".join(word() + rng.choice(["", "占", "7"]) for _ in range(rng.randrange(5))), rng.choice(["table", "text", None])) for i in range(300)]
    claims = [(f"q{i}", "A", rng.choice([["d1"], ["d1", "d2"], ["d2", "d2"], []]), [word() for _ in range(rng.randrange(3))], ["2024年1月3日"][: i % 2], [word() for _ in range(rng.randrange(4))]) for i in range(50)]
    own = spark.createDataFrame(claims, "qid string, option string, doc_scope array<string>, numbers array<string>, dates array<string>, terms array<string>")
    rows = spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string, chunk_type string")
    pairs, blocks = (sorted(sweeps.document_sweep(own, rows, 8, n).collect()) for n in (10**6, 10))
    assert len(pairs) > 100 and pairs == blocks


def test_best_by_shared_meets_few_pairs(spark):
    import random

    rng = random.Random(1)
    draw = lambda n: None if rng.random() < 0.05 else [rng.choice([None, *map(str, range(9))]) if rng.random() < 0.7 else str(rng.randrange(200)) for _ in range(rng.randrange(n))]
    chunks = [(f"c{i:04}", "long" if i % 3 else f"d{i % 40}", draw(8)) for i in range(600)]
    claims = [(f"q{i}", rng.choice([["long"], ["long", "d0"], ["d3", "d6"], ["long", "long"], []]), draw(6)) for i in range(60)]
    own, asked = spark.createDataFrame(chunks, "chunk_id string, doc_id string, numbers array<string>"), spark.createDataFrame(claims, "qid string, doc_ids array<string>, numbers array<string>")
    got = {(r["qid"], r["rank"]): (r["chunk_id"], r["score"]) for r in ranking.best_by_shared(asked, own, ["qid"], 20).collect()}
    want = {}
    for qid, docs_, numbers in claims:
        every = [(None if numbers is None or n is None else float(len(set(numbers) & set(n))), c) for doc in docs_ for c, d, n in chunks if d == doc]
        for rank, (score, c) in enumerate(sorted(every, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:20], 1):
            want[qid, rank] = (c, score)
    assert got == want
    plan = ranking.best_by_shared(asked, own, ["qid"], 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "_most" in plan  # claims meet bounded candidates, not every chunk of their documents


LISTS = "qid string, list_id string, rank int, chunk_id string, doc_id string, score double, weight double"


def test_fusion_and_rescue(spark):
    rows = [("q", "a", i + 1, f"c{i}", "d1", 10.0 - i, 1.0) for i in range(3)] + [("q", "b", 1, "c0", "d1", 1.0, 1.0), ("q", "b", 2, "x", "d2", 9.0, 1.0), ("q", "b", 3, "c0", "d1", 0.5, 1.0)]
    lists = spark.createDataFrame(rows, LISTS)
    fused = {r["chunk_id"]: r["score"] for r in ranking.reciprocal_rank_fusion(lists).collect()}
    assert fused["c0"] == pytest.approx(1 / 61 + 1 / 61 + 1 / 63)  # twice in one list counts twice
    full = [r["chunk_id"] for r in ranking.rescue_documents(lists, k=1, n_docs=2).orderBy("place").collect()]
    assert full == ["x"]  # the full list gives up its last hit for the missing document
    assert [r["chunk_id"] for r in ranking.rescue_documents(lists, k=3, n_docs=2).orderBy("place").collect()] == ["c0", "c1", "x"]


def test_budgets(spark):
    rows = spark.createDataFrame([("q", 1, "a", 50), ("q", 2, "b", 9), ("q", 3, "c", 60), ("q", 4, "d", 30), ("p", 1, "e", 999)], "qid string, rank int, chunk_id string, n int")
    stop = sorted(r["chunk_id"] for r in ranking.within_budget_stop(rows, ["qid"], "rank", F.col("n"), 100).collect())
    skip = sorted(r["chunk_id"] for r in ranking.within_budget_skip(rows, ["qid"], "rank", "chunk_id", F.col("n"), 100, 9).collect())
    assert stop == ["a", "b", "e"] and skip == ["a", "b", "d", "e"]


def test_dedup_rules(spark):
    rows = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 9.0), ("k", 3, 1.0)], "k string, seq int, v double")
    assert ranking.first_wins(rows, ["k"], "seq").first()["seq"] == 1
    assert ranking.last_wins(rows, ["k"], "seq").first()["seq"] == 3
    assert ranking.best_wins(rows, ["k"], "v", "seq").first()["seq"] == 2


def test_neighbours_and_nearest(spark):
    chunks = lookup.with_sequence(spark.createDataFrame([("d", f"c{i}") for i in range(5)], "doc_id string, chunk_id string"))
    got = {(r["chunk_id"], r["distance"]) for r in lookup.neighbours(chunks.filter("chunk_id = 'c0'"), chunks, 1, 2).collect()}
    assert got == {("c0", 0), ("c1", 1), ("c2", 2)}
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate("h..h....")], "d string, n int, x string")
    near = lookup.nearest_before(lines, ["d"], "n", F.col("x") == "h", F.col("n"), 2, "at").orderBy("n").collect()
    assert [r["at"] for r in near] == [None, 0, 0, None, 3, 3, None, None]


def test_pack_and_clauses(spark):
    parts = spark.createDataFrame([(["ab", "cd", "efghijklmno", "p"],)], "p array<string>")
    assert one(parts, chunking.pack(F.col("p"), 6)) == ["ab\n\ncd", "efghij", "klmno", "p"]
    assert one(of(spark, "序\n第一条 甲\n第二条 乙"), chunking.clauses(F.col("t"))) == ["序", "第一条 甲", "第二条 乙"]
    assert one(of(spark, "甲。乙；丙"), chunking.paragraphs(F.col("t"))) == ["甲。", "乙；", "丙"]
    assert one(of(spark, "<p>a</p><script>x</script><b>b &amp; c</b>"), chunking.html_text(F.col("t"))) == "a\nb & c"


def test_claim_conflicts(spark):
    rows = [("q1", "A", "甲公司收入增长5%属实", True, ["d"], ["5%"], ["up"]), ("q2", "B", "甲公司收入增长5%属实的", False, ["d"], ["5%"], ["up"]), ("q3", "C", "甲公司收入增长6%属实", False, ["d"], ["6%"], ["up"]), ("q4", "D", "甲公司收入增长5%属实", None, ["d"], ["5%"], ["up"])]
    claims = spark.createDataFrame(rows, "qid string, option string, normalized_text string, selected boolean, doc_ids array<string>, numbers array<string>, qualifiers array<string>")
    got = evidence.claim_conflicts(claims).collect()
    assert [(r["left_key"], r["right_key"]) for r in got] == [("q1/A", "q2/B")]


def test_claim_conflicts_by_every_condition(spark):
    text = "甲公司二零二三年度现金分红比例高于百分之三十"
    base = {"qid": "q1", "option": "A", "domain": "x", "text": text, "normalized_text": text, "selected": True, "doc_ids": ["d", "e"], "source_doc_ids": ["d"], "source_scoped": False, "numbers": ["30%"], "qualifiers": ["higher"]}
    others = [
        ({"normalized_text": text + "左右"}, True), ({"qid": "q1"}, False), ({"domain": "y"}, False), ({"selected": True}, False), ({"source_doc_ids": ["z"]}, False), ({"doc_ids": ["d"]}, False), ({"doc_ids": ["d"], "source_scoped": True}, False),
        ({"numbers": ["31%"]}, False), ({"numbers": []}, True), ({"qualifiers": ["lower"]}, False), ({"normalized_text": "乙公司停业整顿通知书全文"}, False), ({"normalized_text": "短"}, False), ({"text": "两家" + text, "source_doc_ids": ["d", "e"]}, False), ({"doc_ids": None, "source_doc_ids": None, "numbers": None}, False),
    ]
    rows = [base] + [{**base, "qid": f"r{i}", "selected": False, **change} for i, (change, _) in enumerate(others)]
    frame = spark.createDataFrame(rows, "qid string, option string, domain string, text string, normalized_text string, selected boolean, doc_ids array<string>, source_doc_ids array<string>, source_scoped boolean, numbers array<string>, qualifiers array<string>")
    got = {r["right_key"] for r in evidence.claim_conflicts(frame.unionByName(frame)).collect() if r["left_key"] == "q1/A"}
    assert got == {f"r{i}/A" for i, (_, met) in enumerate(others) if met}
    assert evidence.claim_conflicts(frame.limit(0)).count() == 0


def test_greedy_selection(spark):
    rows = [("q", "a", "d1", 3.0, ["x", "y"], "甲乙丙丁"), ("q", "b", "d1", 2.9, ["x"], "甲乙丙丁"), ("q", "c", "d2", 1.0, ["z"], "戊己庚辛"), ("q", "e", "d1", 0.5, None, None)]
    cand = spark.createDataFrame(rows, "qid string, chunk_id string, doc_id string, score double, slots array<string>, text string")
    assert [r["chunk_id"] for r in evidence.select_evidence(cand, 2).orderBy("place").collect()] == ["a", "c"]


def test_selection_weighs_required_slots_pins_and_budget(spark):
    rows = [("q", "a", "d1", 1.0, ["opt1", "opt2", "opt3"], ["need"], "甲" * 10, 0.0, False), ("q", "b", "d1", 0.9, ["need"], ["need"], "乙" * 10, 0.0, False), ("q", "c", "d1", 0.1, [], ["need"], "丙" * 10, 0.0, True), ("q", "d", "d1", 0.8, ["need"], ["need"], "丁" * 90, 0.0, False), ("q", "e", "d1", 0.8, [], ["need"], "", 9.0, False)]
    cand = spark.createDataFrame(rows, "qid string, chunk_id string, doc_id string, score double, slots array<string>, required array<string>, text string, bonus double, pinned boolean")
    chosen = lambda k, most, **drop: [r["chunk_id"] for r in evidence.select_evidence(cand.drop(*drop.get("drop", ())), k, most).orderBy("place").collect()]
    assert chosen(2, 100) == ["c", "b"] and chosen(3, 100) == ["c", "b", "a"]  # the pinned one first, then what is required
    assert chosen(3, 20) == ["c", "b"] and chosen(1, 5) == ["c"]  # the first is always taken
    assert chosen(9, 10_000) == ["c", "b", "a", "d"]  # an empty text never
    assert chosen(1, 100, drop=("pinned",)) == ["b"]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "d9", 1), ("q", "d1", 2), ("q", "d1", 3), ("q", "d2", 4)], "qid string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "d1"), ("q", "d3"), ("p", "d1")], "qid string, doc_id string")
    got = {r["qid"]: r for r in metrics.retrieval_metrics(hits, gold).collect()}
    assert (got["q"]["hit_1"], got["q"]["hit_3"], got["q"]["recall"], got["q"]["mrr"]) == (0, 1, 0.5, 0.5)
    assert (got["p"]["recall"], got["p"]["mrr"], got["p"]["all_gold"]) == (0.0, 0.0, 0)
    df = spark.createDataFrame([(88, 100, 327052)], "c int, n int, t int")
    assert one(df, metrics.final_score(F.col("c"), F.col("n"), F.col("t"))) == pytest.approx(86.2732, abs=1e-4)


def test_overrides_of_unknown_keys_fail(spark):
    rows = spark.createDataFrame([("a", "x")], "qid string, answer string")
    assert metrics.apply_overrides(rows, spark.createDataFrame([("a", "y")], rows.schema), "qid", "answer").first()["answer"] == "y"
    with pytest.raises(Exception, match="unknown key"):
        metrics.apply_overrides(rows, spark.createDataFrame([("b", "y")], rows.schema), "qid", "answer").collect()


def test_plans(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("c", "c"), ("c", "zz")], "node string, depends_on string")
    assert {r["node"]: r["level"] for r in planning.dependency_levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(Exception, match="cycle"):
        planning.dependency_levels(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], edges.schema), 8).collect()
    profiles = spark.createDataFrame([("base", None), ("mid", "base"), ("top", "mid")], "profile string, parent string")
    entries = spark.createDataFrame([("base", "k", "1"), ("base", "j", "2"), ("mid", "k", "3")], "profile string, key string, value string")
    assert {(r["key"], r["value"]) for r in planning.inherited(profiles, entries).filter("profile = 'top'").collect()} == {("k", "3"), ("j", "2")}


def test_history_bounds():
    runs = {"r1": {"a": "A", "b": "B"}, "r2": {"a": "A", "b": "C"}}
    assert planning.history_bounds(runs, {"r1": 2, "r2": 1}, {"a": ["A", "B"], "b": ["B", "C"]}) == {"a": {"A"}, "b": {"B"}}
    assert planning.history_bounds(runs, {"r1": 2, "r2": 2}, {"a": ["A"], "b": ["B", "C"]}) == {"a": set(), "b": set()}


def test_model_outputs(spark):
    rows = spark.createDataFrame([('```json\n{"answer": "B, A", "confidence": 1.7}\n```', "multi"), ("答案：C", "mcq"), ("I think A or B", "multi"), ("nothing", "mcq"), (None, "mcq")], "o string, f string")
    got = rows.select(judge.parse_answer(F.col("o"), F.col("f")).alias("a"), judge.confidence(F.col("o")).alias("c")).collect()
    assert [r["a"] for r in got][:4] == ["AB", "C", "AB", ""] and got[0]["c"] == 1.0
    assert one(of(spark, "该说法不正确"), judge.parse_verdict(F.col("t"))) is False
    asked = judge.call_model(spark.createDataFrame([("k", "选 B 吗"), ("n", None)], "key string, prompt string")).collect()
    assert json.loads({r["key"]: r["output"] for r in asked}["k"])["answer"] == "B"


def test_sources(spark, tmp_path):
    assert formats.read_jsonl(spark, str(tmp_path / "none"), formats.CHUNK).count() == 0
    (tmp_path / "a.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "b.html").write_text("<p>x</p>", encoding="utf-8")
    assert {r["stem"]: r["text"] for r in formats.read_pages(spark, str(tmp_path)).collect()} == {"a": "中文", "b": "x"}
    rows = spark.createDataFrame([("q1", "A", 1, 2, 3)], "qid string, answer string, prompt_tokens long, completion_tokens long, total_tokens long")
    formats.write_answers(rows, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text(encoding="utf-8-sig").splitlines()[1:] == ["summary,,1,2,3", "q1,A,1,2,3"]
    (tmp_path / "runs.json").write_text(json.dumps({"schema_version": 1, "runs": [{"name": "a", "status": "verified", "usable_for_constraints": True}, {"name": "b", "status": "candidate"}]}))
    assert [r["name"] for r in formats.read_registry(spark, str(tmp_path / "runs.json")).collect()] == ["a"]


def test_stream_append(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, seq int")
    rows.write.parquet(source)
    for _ in range(2):
        incremental.append_stream(spark, spark.readStream.schema(rows.schema).parquet(source), target, "k", "seq", str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("b", 7), ("c", 1)], rows.schema).write.mode("append").parquet(source)
    incremental.append_stream(spark, spark.readStream.schema(rows.schema).parquet(source), target, "k", "seq", str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("a", 2), ("b", 1), ("c", 1)]


def test_positions_in_a_document_of_several_spans(spark):
    rows = [("hot", f"c{i:04}") for i in range(500)] + [("d", "c0"), ("d", "c1")]
    got = {(r["doc_id"], r["chunk_id"]): r["seq"] for r in lookup.with_sequence(spark.createDataFrame(rows, "doc_id string, chunk_id string"), span=20).collect()}
    assert got == {**{("hot", f"c{i:04}"): i for i in range(500)}, ("d", "c0"): 0, ("d", "c1"): 1}


def test_atoms_stay_within_clauses():
    from millrace.operators.hierarchy import atoms, cut_long, line_clause

    assert [line_clause(x) for x in ("第三条 甲", "3.2 范围", "3.2 %", "45.1 甲", "3.2 5", "甲第三条")] == ["第三条", "3.2", "", "", "", ""]
    text = "目录\n第一章 总则\n第一条 甲方应当" + "履行义务。" * 30 + "\n第二条 乙方不得" + "转让权利；" * 150 + "\n12\n3.2 范围\n短。"
    made = atoms(text)
    assert all(len(t) <= 520 for t, _, _ in made) and "".join(t for t, _, _ in made) == "".join(text.split("\n")[1:]).replace("12" + "3.2", "3.2")
    assert [c for _, _, c in made][:2] == ["第一章", "第一条"] and {s for _, s, _ in made} == {"第一章 总则", "3.2 范围"} and made[-1] == ("3.2 范围短。", "3.2 范围", "3.2")
    assert not any("甲方" in t and "乙方" in t for t, _, _ in made)
    assert cut_long("甲" * 30 + "。" + "乙" * 30, 40) == ["甲" * 30 + "。", "乙" * 30] and cut_long("甲" * 90, 40) == ["甲" * 40, "甲" * 40, "甲" * 10]
    assert atoms("") == [] and atoms("目录\n12") == []


def test_children_are_first_of_equal_texts(spark):
    from millrace.operators.hierarchy import children

    long = "本公司按照合同约定履行给付义务并及时披露相关信息，" * 4 + "。"
    rows = [("c1", "d", 1, "", "", long, ["项目 | 金额\n收入 | 5\n项目 | 金额\nx"], "text"), ("c2", "d", 1, "", "", long + " ", None, "text"), ("c3", "e", 1, "", "", long, [None, ""], None), ("c4", "d", 1, "s", "第九条", None, [], "table"), ("c5", "d", 1, "", "", "图", None, "figure"), ("c6", "d", 1, "", "", "短句", None, "text")]
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id string, page int, section string, clause_id string, text string, tables array<string>, chunk_type string")
    got = sorted((r["parent_id"], r["kind"], r["text"]) for r in children(frame).collect())
    narrow = long.replace("，", ",")  # the compatibility form
    assert got == [("c1", "atomic_text", narrow), ("c1", "table_row", "表头: 项目 | 金额\n数据行: 收入 | 5"), ("c3", "atomic_text", narrow)]
    assert children(frame.limit(0)).count() == 0


def test_histories_against_all_assignments():
    import itertools
    import random

    from millrace.operators import histories as h

    rng = random.Random(4)
    for _ in range(40):
        qids = ["a", "b", "c", "d"]
        valid = {q: ["A", "B", "C"][: rng.randrange(2, 4)] for q in qids}
        runs = {r: {q: rng.choice(valid[q]) for q in qids} for r in ("r1", "r2")}
        correct = {r: rng.randrange(5) for r in runs}
        every = [dict(zip(qids, x)) for x in itertools.product(*(valid[q] for q in qids))]
        agree = [x for x in every if all(sum(x[q] == run[q] for q in qids) == correct[r] for r, run in runs.items())]
        candidate = {q: rng.choice(valid[q]) for q in qids}
        hits = lambda x, some=qids: sum(x[q] == candidate[q] for q in some)
        assert h.possible_counts(runs, correct, valid, candidate) == sorted({hits(x) for x in agree}) and h.feasible(runs, correct, valid) == bool(agree)
        fixed = {"a": valid["a"][0]}
        assert h.feasible(runs, correct, valid, fixed) == any(x["a"] == fixed["a"] for x in agree)
        assert h.feasible(runs, correct, valid, forbidden=fixed) == any(x["a"] != fixed["a"] for x in agree)
        weights = {(q, v): rng.randrange(5) for q in qids for v in valid[q]}
        total = lambda x: sum(weights[q, x[q]] for q in qids)
        best = h.best_assignment(runs, correct, valid, weights)
        assert (best is None and not agree) or (best in agree and total(best) == max(map(total, agree)))
        if agree:
            assert h.bounds(runs, correct, valid, candidate, ["a", "b"]) == (min(hits(x, "ab") for x in agree), max(hits(x, "ab") for x in agree))
            ranked = h.rank_probes(runs, correct, valid, candidate, 2, {"a": valid["a"], "b": valid["b"]})
            assert len(ranked) == len(valid["a"]) * len(valid["b"]) - 1 and [p.counts[0] for p in ranked] == sorted((p.counts[0] for p in ranked), reverse=True)
        else:
            with pytest.raises(ValueError, match="contradict"):
                h.bounds(runs, correct, valid, candidate)
    with pytest.raises(ValueError, match="combinations"):
        h.rank_probes(runs, correct, valid, candidate, 2, {q: valid[q] for q in qids}, 3)


def test_levels_of_a_graph_with_many_paths(spark):
    edges = [(f"n{i + 1}{x}", f"n{i}{y}") for i in range(30) for x in "ab" for y in "ab"] + [("n0a", "n0a"), ("n1a", "unknown"), (None, "n0a")]
    nodes = spark.createDataFrame([(f"n{i}{x}",) for i in range(31) for x in "ab"], "node string")
    got = {r["node"]: r["level"] for r in planning.dependency_levels(nodes, spark.createDataFrame(edges, "node string, depends_on string")).collect()}
    assert got == {f"n{i}{x}": i for i in range(31) for x in "ab"}


def test_packs_that_share_a_member_are_one(spark):
    from millrace.operators import packs

    members = spark.createDataFrame([("q", "a", 0, "a"), ("q", "a", 1, "x"), ("q", "b", 0, "b"), ("q", "b", 1, "x"), ("q", "c", 0, "c"), ("r", "a", 0, "a")], "qid string, anchor_id string, place int, chunk_id string")
    scores = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0), ("q", "c", 1.0), ("r", "a", 0.5)], "qid string, anchor_id string, score double")
    got = {(r["qid"], r["pack"]): (r["score"], r["chunk_ids"]) for r in packs.merged(members, scores).collect()}
    assert got == {("q", "b"): (2.0, ["b", "x", "a"]), ("q", "c"): (1.0, ["c"]), ("r", "a"): (0.5, ["a"])}
    assert packs.merged(members.limit(0), scores).count() == 0
