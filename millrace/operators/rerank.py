"""Second scores of retrieved candidates: linear features, document-first features, rule scores, and roles in the check of a claim.

Every score is a sum of column expressions; what depends on the other candidates of a query is a window over them, so a query's
candidates are shuffled once. Candidates have qid, chunk_id, doc_id, rank, score, text and what each function names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import dates, numbers, tokenize

# Hints of metrics, consequences, general pages, narrated actions and misleading ratios, and the features' weights.
METRICS = "营业收入|净利润|现金流|分红|每股|派现|股息"
CONSEQUENCES = "处罚|罚款|扣减|减分|责令|不得|期限"
GENERAL = "审计报告|公允反映|坚持依法合规|客观公正|原则|财务报表"
ACTIONS = "持续推出实施|连续四年|回购计划|股份回购|回购注销|股权激励计划|维护公司市值稳定"
RATIOS = ["现金分红(含税)", "现金分红金额", "现金分红/归属于母公司所有者的净利润", "现金分红/归属于母公司股东的净利润", "归属于母公司所有者权益"]
EXCEPTIONS = "但|除外|仅限|不得|应当|未经|不包括|不适用"
NOISE = "目 录|目录|风险提示及说明|释 义"
STRUCTURED = ["table_row", "financial_metric_row", "layout_table_row", "figure"]
NARROW = "某一单个客户|单一客户|单个客户|地区信息|分部信息|分部间|分产品|分行业|分地区|母公司财务报表|母公司利润表|公司现金流量表"
RATINGS = ["AAA", "AA", "AA+", "A", "A+", "BBB", "BBB+"]


def _is(condition: Column, value: float, otherwise: float = 0.0) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(F.lit(otherwise))


def _hits(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: (t != "") & F.contains(text, t))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def ranked(rows: DataFrame, score: Column, k: int, tie: str = "rank") -> DataFrame:
    """The k best of each query by ``score``, ties in the order they came."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), tie)
    return rows.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("qid", "chunk_id", "doc_id", "score", "place")


def rerank(candidates: DataFrame, targets: DataFrame, k: int = 30) -> DataFrame:
    """(qid, chunk_id, doc_id, score, place) by a linear score of lexical, numeric and structural features.

    Candidates have numbers, dates, clause_id, section, chunk_type too; ``targets`` has qid, asked (the question with its options),
    must_terms, option_terms, numbers, dates, intent, doc_scope. A text that came before costs the later ones a penalty.
    """
    own = targets.select("qid", F.array_distinct(tokenize(F.col("asked"))).alias("q_terms"), "must_terms", "option_terms", F.col("numbers").alias("q_numbers"), F.col("dates").alias("q_dates"), "intent", "doc_scope")
    rows = candidates.join(own, "qid").withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("qid", F.trim("text")).orderBy("rank")))
    text, kind = F.col("text"), F.col("chunk_type")
    metric, consequence, counted = text.rlike(METRICS), text.rlike(CONSEQUENCES), F.col("intent").isin("number", "comparison")
    score = (
        F.col("score") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")) + F.size(_hits(F.col("must_terms"), text)) * 0.18
        + F.size(F.filter("option_terms", lambda t: (t != "") & F.contains(text, F.substring(t, 1, 16)))) * 0.08 + _shared(F.col("q_numbers"), F.col("numbers")) * 0.12 + _shared(F.col("q_dates"), F.col("dates")) * 0.12
        + _shared(F.col("q_terms"), F.array_distinct(tokenize(text))) / F.greatest(F.size("q_terms"), F.lit(1)) * 0.35
        + _is(F.col("clause_id") != "", 0.15) + _is(~F.col("section").isin("", "document"), 0.05) + F.when(kind.isin("table", "figure"), _is(counted, 0.10, 0.04)).otherwise(F.lit(0.0))
        + _is(metric, 0.18) + _is(consequence, 0.18) - _is(text.rlike(GENERAL) & ~metric & ~consequence, 0.22) + _is(text.rlike("[0-9]") & (metric | consequence | counted), 0.12)
        + _is(F.array_contains("doc_scope", F.col("doc_id")), 0.10) - _is(F.col("copy") > 1, 0.08)
    )
    return ranked(rows, score, k)


def term_weight(term: Column) -> Column:
    return F.when(term.rlike("[0-9]"), 1.2).when(F.contains(term, F.lit("利润")), 1.1).when(F.length(term) >= 4, 1.4).otherwise(1.0)


def document_first(candidates: DataFrame, terms: DataFrame, doc_scores: DataFrame, k: int = 30) -> DataFrame:
    """(qid, chunk_id, doc_id, score, place): scores in which a chunk's document and its hits among its neighbours count.

    Candidates have page, section, chunk_type too; ``terms`` has qid, terms (array of keywords), ``doc_scores`` qid, doc_id, doc_score.
    Support of a section or page is the score of its other hits, so a window by query, document and place.
    """
    most = doc_scores.groupBy("qid").agg(F.max("doc_score").alias("most"))
    rows = candidates.join(terms, "qid").join(doc_scores, ["qid", "doc_id"], "left").join(most, "qid", "left")
    rows = rows.withColumn("found", _hits(F.col("terms"), F.col("text"))).withColumn("n", F.size("found")).withColumn("key", F.lower(F.trim(F.coalesce("section", F.lit("")))))
    rows = rows.withColumn("quality", F.aggregate("found", F.lit(0.0), lambda total, t: total + term_weight(t) * F.greatest(F.length(t), F.lit(1))))
    whole = Window.partitionBy("qid")
    support = F.when(F.col("n") > 0, F.least(F.col("n"), F.lit(2)) * F.greatest(F.col("score"), F.lit(0.0))).otherwise(F.lit(0.0))
    there, at = Window.partitionBy("qid", "doc_id", "key"), Window.partitionBy("qid", "doc_id", "page")
    rows = rows.withColumns({"top": F.max("score").over(whole), "best": F.max("quality").over(whole), "s_sum": F.sum(support).over(there), "s_n": F.count_if(F.col("n") > 0).over(there), "p_sum": F.sum(support).over(at), "p_n": F.count_if(F.col("n") > 0).over(at)})
    text, n, placed, paged = F.col("text"), F.col("n"), F.col("key") != "", F.col("page").isNotNull()
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    years = F.filter("terms", lambda t: t.rlike("^[0-9]{4}$"))
    specific = F.aggregate("found", F.lit(0.0), lambda total, t: total + F.least(F.lit(0.12), F.length(t) * 0.015))
    score = (
        F.col("score") / one("top") * (F.col("quality") / one("best")) + F.coalesce("doc_score", F.lit(0.0)) / one("most") * 1.45 + _is((n >= 2) & text.rlike(ACTIONS), 0.12) + F.when(n >= 2, F.least(F.lit(0.24), n * 0.06)).otherwise(F.lit(0.0))
        + F.least(F.lit(0.30), specific) + F.when(placed, F.least(F.lit(0.35), F.col("s_sum") * 0.06)).otherwise(F.lit(0.0)) + _is(placed & (n >= 2) & (F.col("s_n") >= 2), 0.10)
        + F.when(paged & (F.col("p_n") >= 2), F.least(F.lit(0.42), F.col("p_sum") * 0.08)).otherwise(F.lit(0.0)) + _is(paged & (n >= 2) & (F.col("p_n") >= 2), 0.16) + _is(F.exists(years, lambda y: F.contains(text, y)), 0.16)
        + _is(text.rlike(ACTIONS), 0.18) + _is(text.rlike("[0-9]"), 0.05) + _is((F.col("chunk_type") == "table") | (F.col("section") == "table"), 0.15) - _is(F.size(_hits(F.array(*map(F.lit, RATIOS)), text)) > 0, 0.28)
    )
    return ranked(rows, score, k)


def rule_scores(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds ``rule_score``: terms, numbers and dates that a candidate shares with its question, and a clause number.

    Candidates have numbers, dates, clause_id; ``asked`` has qid, asked (the text of the question).
    """
    q = asked.select("qid", F.array_distinct(tokenize(F.col("asked"))).alias("q_terms"), F.array_distinct(numbers(F.col("asked"))).alias("q_numbers"), F.array_distinct(dates(F.col("asked"))).alias("q_dates"))
    score = F.col("score") + _shared(F.col("q_terms"), F.array_distinct(tokenize(F.col("text")))) * 0.1 + _is(F.col("clause_id") != "", 2.0) + _shared(F.col("q_numbers"), F.col("numbers")) * 3.0 + _shared(F.col("q_dates"), F.col("dates")) * 3.0
    return candidates.join(q, "qid").withColumn("rule_score", F.round(score, 6)).drop("q_terms", "q_numbers", "q_dates")


def compact(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", ""), "，％", ",%")


def candidate_values(own_numbers: Column, own_dates: Column, text: Column, most: int = 8) -> Column:
    """Values that a claim states: numbers and dates that are no plain years, and ratings."""
    no_year = lambda items: F.filter(items, lambda v: ~F.regexp_replace(v, "\\s+", "").rlike("^(?:19|20)[0-9]{2}年?$"))
    ratings = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+\\+?"), F.lit(0)), lambda r: F.regexp_replace(F.upper(r), "^AAA\\+$", "AAA")), lambda r: r.isin(RATINGS))
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(no_year(own_numbers), no_year(own_dates), ratings), lambda v: F.trim(v)), lambda v: v != "")), 1, most)


def verification_scores(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """(qid, option, chunk_id, doc_id, role, predicate_hits, value_hits, score, n_chars, text, place): candidates of each claim in the
    order of how well they serve to check it.

    Candidates have qid, option, chunk_id, doc_id, domain, score, text, chunk_type; the highest score of a chunk counts. ``claims``
    has qid, option, text, numbers, dates and predicates (array of terms). A candidate with a predicate and a stated value supports,
    one with a predicate and another number counters, any other is ground truth.
    """
    once = candidates.groupBy("qid", "option", "chunk_id").agg(F.max_by(F.struct("doc_id", "domain", "text", "chunk_type", "score"), "score").alias("c")).select("qid", "option", "chunk_id", "c.*")
    own = claims.select("qid", "option", F.col("text").alias("claim"), F.transform("predicates", compact).alias("predicates"), F.transform(candidate_values(F.col("numbers"), F.col("dates"), F.col("text")), compact).alias("values"), F.transform("numbers", compact).alias("stated"))
    rows = once.join(own, ["qid", "option"]).withColumn("top", F.max(F.abs("score")).over(Window.partitionBy("qid", "option"))).withColumn("flat", compact(F.col("text")))
    rows = rows.withColumns({"predicate_hits": F.size(F.filter("predicates", lambda t: F.contains(F.col("flat"), t))), "value_hits": F.size(F.filter("values", lambda t: F.contains(F.col("flat"), t))), "n_chars": F.length("text")})
    actual = F.filter(F.transform(numbers(F.col("text")), compact), lambda v: ~v.rlike("^(?:19|20)[0-9]{2}年?$"))
    rows = rows.withColumn("others", F.size(F.array_except(actual, F.col("stated"))))
    role = F.when((F.col("predicate_hits") > 0) & (F.col("value_hits") > 0), "support").when((F.col("predicate_hits") > 0) & (F.col("others") > 0), "counter").otherwise("ground_truth")
    text, kind = F.col("text"), F.col("chunk_type")
    narrow = F.col("claim").rlike(NARROW)
    layout = (
        _is(text.rlike("合并利润表|合并现金流量表|主要会计数据"), 1.5) - _is(~narrow & text.rlike(NARROW), 3.0) - _is(F.contains(text, F.lit("分季度主要财务指标")) & ~F.contains(F.col("claim"), F.lit("季度")), 2.5)
        - _is(text.rlike("在其他主体中的权益|子公司合并财务报表"), 3.0)
    )
    score = (
        F.col("score") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")) + F.least(F.col("predicate_hits"), F.lit(4)) * 1.45 + F.least(F.col("value_hits"), F.lit(3)) * 0.55 + _is(role == "counter", 0.85) + _is(kind.isin(STRUCTURED), 0.75)
        + F.when(F.col("domain") == "financial_reports", layout).otherwise(F.lit(0.0)) + _is(text.rlike(EXCEPTIONS), 0.25) - _is(text.rlike(NOISE), 1.5) - F.when(F.col("n_chars") > 700, F.least(F.lit(1.0), (F.col("n_chars") - 700) / 1000)).otherwise(F.lit(0.0))
    )
    order = Window.partitionBy("qid", "option").orderBy(F.desc("score"), "n_chars", F.desc("chunk_id"))
    rows = rows.withColumn("role", role).withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(order))
    return rows.select("qid", "option", "chunk_id", "doc_id", "role", "predicate_hits", "value_hits", "score", "n_chars", "text", "place")


def verification_order(scored: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``turn``, the order in which the candidates of a claim are offered to a budget: the best of each document of its scope,
    for counted claims the best of each with a number that is no year, the best of each role, then all others.

    ``claims`` has qid, option, claim_type, doc_scope.
    """
    no_year = F.exists(numbers(F.col("text")), lambda v: ~F.regexp_replace(compact(v), "年$", "").rlike("^(?:19|20)[0-9]{2}$"))
    rows = scored.join(claims.select("qid", "option", "claim_type", "doc_scope"), ["qid", "option"]).withColumn("at", F.array_position("doc_scope", F.col("doc_id"))).withColumn("counted", no_year)
    first = lambda *by: F.row_number().over(Window.partitionBy("qid", "option", *by).orderBy("place"))
    role = F.when(F.col("role") == "support", 1).when(F.col("role") == "counter", 2).otherwise(3)
    rows = rows.withColumns({"of_doc": first("doc_id"), "of_counted": first("doc_id", "counted"), "of_role": first("role")})
    turns = F.array(
        F.when((F.col("at") > 0) & (F.col("of_doc") == 1), F.struct(F.lit(1).alias("a"), F.col("at").cast("int").alias("b"))),
        F.when((F.col("at") > 0) & F.col("counted") & (F.col("of_counted") == 1) & F.col("claim_type").isin("metric_fact", "comparison", "date_fact"), F.struct(F.lit(2).alias("a"), F.col("at").cast("int").alias("b"))),
        F.when(F.col("of_role") == 1, F.struct(F.lit(3).alias("a"), role.alias("b"))), F.struct(F.lit(4).alias("a"), F.col("place").alias("b")),
    )
    rows = rows.withColumn("first", F.array_min(F.filter(turns, lambda t: t.isNotNull())))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("qid", "option").orderBy("first"))).drop("first", "of_doc", "of_counted", "of_role", "counted", "at")
