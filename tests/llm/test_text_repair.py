import random

import pytest

from millrace.llm import markup, scanned_pages
from millrace.llm.markup import clean_documents, markup_of
from millrace.llm.one_form import alike_pairs, one_form
from millrace.llm.scanned_pages import repair_documents, repair_page, repair_pages
from millrace.llm.splitting import cut_text, longest_stretch, needs, row_size, split_rows, split_tables, split_text, split_texts


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("ＡＢ１，", "AB1,", True), ("e\u0301", "é", True), ("甲\u200b乙\u00ad", "甲乙", True), ("a\u00a0b", "a b", True), ("ﬁ", "fi", True), ("⽔务", "水务", True), ("⻓期", "长期", True), ("率", "率", True),
     ("ЕВ-01", "EB-01", True), ("pаypal", "paypal", True), ("Ρrofit", "Profit", True), ("10²", "102", False), ("①", "1", False), ("l1", "I1", False), ("да ро", "да po", False), ("мир", "mup", False), ("a-b", "a‑b", True), ("", "", True)],
)
def test_forms(a, b, same):
    assert (one_form(a) == one_form(b)) == same
    assert one_form(one_form(a)) == one_form(a)


def test_alike_pairs(spark):
    rows = [("q", "1", "ＡＢ"), ("q", "2", "AB"), ("q", "3", "AB"), ("r", "4", "AB"), ("q", "5", None), ("q", "6", ""), ("q", "1", "ＡＢ"), (None, "7", "x"), ("q", None, "AB")]
    df = spark.createDataFrame(rows, "record_table string, key string, text string")
    assert sorted(map(tuple, alike_pairs(df).collect())) == [("q", "1", "2"), ("q", "1", "3")]
    assert alike_pairs(df.limit(0)).count() == 0
    assert one_form(None) is None


def test_split_text_round_trip():
    rng = random.Random(5)
    for n in (0, 1, 1800, 1801, 5000, 30_000):
        text = "".join(rng.choice("甲乙丙丁戊己庚辛壬癸，。\n ") if rng.random() < 0.97 else "\n\n" for _ in range(n))
        pieces = split_text(text)
        assert all(b - a <= 1800 for a, b, _ in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (a, b, _), (c, _, _) in zip(pieces, pieces[1:]):
            assert c == b - 100
        if len(text) > 1800:
            assert all(text[b - 1] in "，。\n " for _, b, _ in pieces[:-1])
    assert [b - a for a, b, _ in split_text("甲" * 4000)] == [1700, 1800, 700]
    assert longest_stretch("a. b.c。" + "x" * 9) == 9


def test_hard_cuts_come_from_the_recursion():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["甲乙", "丙，", "丁 戊", "己。", "庚”", "辛. ", "壬\n", "癸!?）"]) * rng.randrange(1, 9) if rng.random() < 0.3 else "子" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 30)))
        assert cut_text(text, 40, 5)[1] == (longest_stretch(text) > 40), text


def test_split_rows():
    rows = [["甲" * 99] for _ in range(30)]
    pieces = split_rows(rows)
    assert all(sum(map(row_size, p[3])) <= 1200 for p in pieces) and all(a[1] - 1 == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[-1][1] == 30
    big = split_rows([["x"], ["甲" * 3000, None, "b"], None, []])
    assert all(sum(map(row_size, p[3])) <= 1200 for p in big) and "".join(c or "" for p in big for r in p[3] if r for c in r).count("甲") == 3000
    assert split_rows([]) == [(0, 0, False, [])]


def test_needs(spark):
    texts = spark.createDataFrame([("a", "甲" * 1801), ("b", "甲乙。" * 700), ("c", "短"), ("d", None), ("e", ""), ("b", "甲乙。" * 700)], "key string, text string")
    assert sorted(map(tuple, needs(split_texts(texts)).collect())) == [("a", "hard_cut"), ("a", "split"), ("b", "split")]
    tables = spark.createDataFrame([("t", [["甲" * 1200]]), ("u", [["x", None]] * 500), ("v", [["a"]]), ("w", None), ("x", []), ("y", [None, ["a"]])], "key string, rows array<array<string>>")
    assert sorted(map(tuple, needs(split_tables(tables)).collect())) == [("t", "hard_cut"), ("t", "split"), ("u", "split")]
    assert split_texts(texts.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split_texts(texts, 100, 60)


@pytest.mark.parametrize(
    ("text", "kinds", "clean"),
    [("<p>甲&amp;乙</p>", ["html"], "甲&乙"), ("CO<sub>2</sub>", ["html"], "CO2"), ("<!-- x -->甲", ["html"], "甲"), ("甲</td>", ["html"], "甲"), ("<ul><li>甲</li><li>乙</li></ul>", ["html"], "- 甲\n- 乙"), ("<h2>甲</h2>乙", ["html"], "## 甲\n乙"),
     ("# 甲\n乙", ["markdown"], "# 甲\n乙"), ("甲\n===\n乙", ["markdown"], "# 甲\n乙"), ("**甲**：乙", ["markdown"], "甲：乙"), ("| a | b |\n|---|:-:|\n| 1 | 2 |", ["markdown"], "a | b\n1 | 2"), ("```py\nx = 1\n```", ["markdown"], "x = 1"), ("甲[^1]。", ["markdown"], "甲。"),
     ("- 甲\n- 乙", ["markdown"], "- 甲\n- 乙"), ("== 甲 ==\n乙", ["wiki"], "# 甲\n乙"), ("甲[[乙|丙]]", ["wiki"], "甲丙"), ("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"], "a | b\n1 | 2"),
     (r"\section{甲}" + "\n乙", ["latex"], "# 甲\n乙"), (r"5\%，甲", ["latex"], "5%，甲"), (r"甲$r_f + \beta$乙", ["latex"], r"甲$r_f + \beta$乙"), ("$$\nx^2\n$$", ["latex"], "$$ x^2 $$"), (r"甲\textbf{乙}\footnote{丙}", ["latex"], "甲乙（丙）"),
     ("P<0.05且n>35，", [], None), ("美元$12.5，上年$11.6", [], None), ("<<办法>>", [], None), (r"D:\data\report_75_final", [], None), ("#7机组", [], None), ("a==b", [], None), ("甲80*（注*：乙）", [], None), ("- 2 -", [], None), ("AT&T与R&D", [], None), ("", [], ""), ("a|b", [], None)],
)
def test_markup(text, kinds, clean):
    got, found = markup_of(text)
    assert found == kinds and got == (text if clean is None else clean)


def test_links_around_an_article_are_dropped():
    page = "<div><ul>" + "".join(f"<li><a href='#'>链接{i}</a></li>" for i in range(20)) + "</ul></div><div><p>" + "正文很长，没有链接。" * 40 + "</p></div>"
    clean, _ = markup_of(page)
    assert "链接3" not in clean and "正文很长" in clean


def test_the_subtree_of_content_is_selected():
    part = "<p>" + "这是正文的一段话，写得很长很长，说明了很多事情。" * 6 + "</p>"
    page = f"<h1>标题</h1><div>版权所有 某某公司 转载请注明</div><div><h2>第一节</h2>{part}{part}<ul><li>甲</li><li>乙</li></ul>{part}</div><div><a href='x'>链接一</a><a href='y'>链接二</a></div><div>页脚</div>"
    clean = markup.clean_markup(page)[0]
    assert "版权" not in clean and "链接" not in clean and "页脚" not in clean
    assert clean.startswith("# 标题\n\n## 第一节") and clean.count("很多事情") == 18 and "- 甲\n- 乙" in clean


def test_depth_and_breadth_cost_no_more_than_their_number():
    for closing in ("</div>", "</span>"):
        assert markup.clean_markup("<div>" * 100_000 + "正文" * 500 + closing * 100_000)[0] == "正文" * 500
    assert markup.clean_markup("<ol>" + "<li>条</li>" * 20_000 + "</ol>")[0].endswith("\n20000. 条")


def test_clean_documents(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "<b>x</b>" * 20_000)], "key string, text string")
    got = {r["key"]: r for r in clean_documents(df).collect()}
    assert got["a"]["clean"] is None and got["b"]["clean"] == "" and got["c"]["clean"] == "x" * 20_000


MODEL = {"pages": {"": 100}, "top": {}, "bottom": {"仅供参考": 50}, "line": {"仅供参考": 50}, "ending": {}, "word": {"premium": 30, "first": 9, "or": 9, "million": 30, "the": 200, "claims": 40}, "gram": {"公司的": 50, "公司?": 50, "?司的": 60}}


def test_repair_page():
    lines = ["某某保险条款    2", "The deferred pre-", "mium of 3.5 mi1lion and first-", "or second liens in 2o19 under tbe daims here.", "", "按照合同约定，披露主体为某公可的收入", "增长。", "仅供参考", "第 2 页 共 9 页"]
    found, clean = repair_page("\n".join(lines), 2, "某某保险条款", MODEL)
    assert found == [(1, "furniture"), (2, "hyphen"), (3, "misread"), (4, "misread"), (6, "misread"), (8, "furniture"), (9, "furniture")]
    assert clean.split("\n")[0].startswith("The deferred premium of 3.5 million and first-") and "2019 under the claims" in clean and "某公司的收入增长。" in clean
    assert repair_page("", None, None, MODEL) == ([], "")


def test_repair_pages(spark):
    rows = [("d", 1, "标题    1\n正文一句话，很长很长。\n□二句"), ("d", 1, "标题    1\n正文一句话，很长很长。\n□二句"), ("e", None, None), ("f", None, "")]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    titles = spark.createDataFrame([("d", "标题")], "doc_id string, title string")
    got = {r["doc_id"]: r for r in repair_pages(pages, titles).collect()}
    assert set(got) == {"d", "f"} and [tuple(x) for x in got["d"]["found"]] == [(1, "furniture"), (3, "misread")]
    assert repair_pages(pages.limit(0)).count() == 0
    whole = spark.createDataFrame([("d", "标题", "标题    1\n甲乙。\f标题    2\n丙丁。")], "doc_id string, title string, raw_text string")
    assert repair_documents(whole).first()["clean"] == "甲乙。\n丙丁。"


def test_text_goes_on_over_the_end_of_a_page(spark):
    rows = [("d", "标题", "标题    1\n甲乙丙丁戊己庚辛，按照合\f标题    2\n同约定办理。\nThe deferred pre-\f标题    3\nmium is paid."), ("e", "标题", ""), ("f", None, None)]
    documents = spark.createDataFrame(rows + rows[:1], "doc_id string, title string, raw_text string")
    got = {r["doc_id"]: r for r in repair_documents(documents).collect()}
    assert set(got) == {"d", "e"} and got["e"]["clean"] == "" and got["d"]["n_found"] == 4
    assert got["d"]["clean"].replace("\n", "") == "甲乙丙丁戊己庚辛，按照合同约定办理。The deferred premium is paid."
    pages = spark.createDataFrame([("d", 1, "甲乙丙丁戊己庚辛，按照合"), ("d", 2, "同约定办理。"), ("d", None, "")], "doc_id string, page int, text string")
    assert {r["page"]: r["goes_on"] for r in repair_pages(pages).collect()} == {1: True, 2: False, None: False}


def test_weights_are_fitted_to_what_recurs():
    features = [["bias", "latin"], ["bias", "sentence"], ["bias", "sentence"]]
    assert scanned_pages.best_sequence(features, scanned_pages.WEIGHTS) == [1, 1, 1]
    weights = scanned_pages.fit([(features, [(0,), (1,), (0, 1, 2)])] * 50)
    assert scanned_pages.best_sequence(features, weights) == [0, 1, 1] and weights["latin"] != scanned_pages.WEIGHTS["latin"]
    assert scanned_pages.fit([]) == scanned_pages.WEIGHTS


def test_groups_get_the_totals_they_ask_for(spark):
    from collections import Counter

    from millrace.llm.grouped_counts import Totals, collection_totals

    frame = spark.createDataFrame([(0, "a b b"), (1, "b c"), (2, "c ?a")], "g int, text string")

    def listed(group):
        out = Counter()
        for word in " ".join(group["text"].to_pylist()).split():
            out["w", word.strip("?")] += not word.startswith("?")
        return out

    got = {}
    for g in range(3):
        got[g] = Totals(collection_totals(frame, listed, 2, 2).filter(f"g = {g}").toArrow(), 2)["w"]
    assert [got[g].get(w) for g, w in ((0, "b"), (1, "b"), (2, "c"), (2, "a"), (0, "c"))] == [3, 3, 2, 0, 0]
