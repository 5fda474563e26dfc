"""Queries made from questions: entities, claim targets with their slots, weighted query bundles, retrieval targets and variants.

All of it is column expressions over one row per question or option, so nothing is shuffled. Lists keep the order in which their
elements come up, each once, blanks squeezed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import dates, numbers

# Patterns and word lists of query entities.
LAW = "《[^》]{2,80}》"
METRIC = "营业收入|净利润|现金流量净额|研发投入|分红|票面利率|发行规模|评级|担保|身故保险金|现金价值|保险责任|退保|客户尽职调查|受益所有人|等待期|股份回购"
YEAR = "20[0-9]{2}\\s*年"
PRODUCT = "[一-鿿A-Za-z0-9]{2,30}(?:e生保|医疗险|重疾险|家财险|意外险|年金保险|养老保险|募集说明书)"
ENTITY = "[一-鿿A-Za-z0-9（）()]{2,48}(?:股份有限公司|集团有限公司|有限公司|公司|集团|银行|保险|证券|基金|债券|报告|办法|条例|规定|细则|通知|指引|准则|产品)"
PREFIXES = ["名称为", "发行人为", "发行人是", "指定", "明确", "由", "为"]
STOPWORDS = ["根据", "提供", "文档", "显示", "下列", "哪项", "正确", "错误", "判断", "是否", "关于", "其中", "以及", "同时", "报告", "年度", "全文", "增长"]
# Hints of claim types, of evidence intents, and of several documents.
COMPARISON = "比较|高于|低于|增加|减少|同比|环比|超过|不超过"
CLAUSE = "处罚|罚款|扣减|减分|责令|不得|期限|应当|可以"
CLAIM_METRIC = "营业收入|净利润|现金流|分红|每股|派现|股息|资产负债率"
CLAIM_DATE = "日期|时间|期限|之前|之后|年度|年末"
INTENT_COMPARISON = "比较|对比|高于|低于|增加|减少|同比|环比|是否"
DIVIDEND = "分红|股息|派息|利润分配"
# What a short metric name is called in reports.
METRIC_ALIASES = [
    ("归母净利润|净利润增速|归属于母公司", ["归属于上市公司股东的净利润", "母公司拥有人应占溢利", "本年比上年增减"]),
    ("研发投入|研发费用|研发强度", ["研发投入占营业收入比例", "研发费用占营业收入比例", "研发投入金额"]),
    ("每股现金分红|每股分红|现金分红|每股派息", ["每10股派发现金红利", "每10股派息数", "现金分红金额", "利润分配预案", "末期股息", "建议派发末期股息", "每股股息", "派息率"]),
    ("经营活动现金流|经营现金流", ["经营活动产生的现金流量净额", "经营活动现金流净额"]),
    ("营业收入|营业额", ["营业收入", "营业额", "本年比上年增减"]),
]
SLOTS = {"comparison": ["comparator_endpoint", "entity_anchor", "value"], "clause_consequence": ["consequence", "entity_anchor"], "metric_fact": ["entity_anchor", "metric", "value"], "date_fact": ["date", "entity_anchor"], "fact": ["entity_anchor"]}


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def ordered(items: Column) -> Column:
    """The elements in order, squeezed, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(items, squeezed), lambda x: x != ""))


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(*items: str | Column) -> Column:
    """Texts and arrays of texts in a row, separated by blanks."""
    return squeezed(F.concat_ws(" ", *[F.lit(i) if isinstance(i, str) else i for i in items]))


def first(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def trimmed_entity(value: Column) -> Column:
    """What stands behind the first template prefix that leaves four characters or more."""
    behind = lambda m: F.regexp_replace(F.trim(F.substring_index(value, m, -1)), "^的+|的+$", "")
    return F.coalesce(*[F.when(F.contains(value, F.lit(m)) & (F.length(behind(m)) >= 4), behind(m)) for m in PREFIXES], value)


def short_tokens(text: Column) -> Column:
    """Han phrases of 2 to 12 characters between other characters, without template words."""
    return F.filter(all_of(text, "[一-鿿]+"), lambda t: F.length(t).between(2, 12) & ~t.isin(STOPWORDS))


def entities(text: Column, most: int = 24) -> Column:
    """Laws, metrics, years, products, organisations, short phrases, numbers and dates of a text; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    made = F.concat(*[all_of(text, p) for p in (LAW, METRIC, YEAR, PRODUCT)], F.transform(all_of(text, ENTITY), trimmed_entity), short_tokens(text), numbers(text), dates(text))
    return first(ordered(F.filter(made, lambda x: F.length(F.trim(x)) >= 2)), most)


def claim_type(text: Column, own_numbers: Column, own_dates: Column) -> Column:
    """comparison, clause_consequence, metric_fact, date_fact or fact, in this order."""
    return (
        F.when(text.rlike(COMPARISON), "comparison").when(text.rlike(CLAUSE), "clause_consequence").when(text.rlike(CLAIM_METRIC) | (F.size(own_numbers) > 0), "metric_fact")
        .when(text.rlike(CLAIM_DATE) | (F.size(own_dates) > 0), "date_fact").otherwise("fact")
    )


def options(questions: DataFrame) -> DataFrame:
    """One row per option: qid, option, text, stem, doc_scope and its entities, numbers and dates together with the stem."""
    rows = questions.select("qid", F.col("question").alias("stem"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_scope"), F.explode(F.map_entries("options")).alias("o"))
    rows = rows.select("qid", F.col("o.key").alias("option"), F.coalesce("o.value", F.lit("")).alias("text"), F.coalesce("stem", F.lit("")).alias("stem"), "doc_scope")
    both = F.trim(F.concat_ws(" ", "stem", "text"))
    return rows.select("*", both.alias("both"), entities(F.col("text")).alias("own"), entities(F.col("stem")).alias("asked"), ordered(numbers(both)).alias("n"), ordered(dates(both)).alias("d"))


def claim_targets(questions: DataFrame) -> DataFrame:
    """What each option claims: (qid, option, text, stem, doc_scope, claim_type, entities, numbers, dates, must_terms, should_terms,
    slots). Terms of the option come before those of the stem."""
    rows = options(questions)
    rows = rows.select(
        "qid", "option", "text", "stem", "doc_scope", first(ordered(F.concat("own", "asked")), 12).alias("entities"), first(F.col("n"), 6).alias("numbers"), first(F.col("d"), 6).alias("dates"),
        first(ordered(F.concat(first(F.col("own"), 6), first(F.col("n"), 4), first(F.col("d"), 4), first(F.col("asked"), 3))), 10).alias("must_terms"),
        first(ordered(F.concat(F.array("text"), first(F.col("own"), 6))), 8).alias("should_terms"), claim_type(F.col("both"), F.col("n"), F.col("d")).alias("claim_type"),
    )
    slots = F.coalesce(*[F.when(F.col("claim_type") == kind, F.array(*map(F.lit, names))) for kind, names in SLOTS.items()])
    return rows.withColumn("slots", slots)


def metric_aliases(text: Column) -> Column:
    """The names that reports use for the metrics a text mentions."""
    return ordered(F.concat(*[F.when(text.rlike(trigger), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for trigger, names in METRIC_ALIASES]))


def _bundles(made: list[tuple[Column, Column, str, float]], most: int) -> Column:
    """The queries whose condition holds, each text once, the first ``most``."""
    every = F.array(*[F.when(when & (query != ""), F.struct(query.alias("query"), F.lit(intent).alias("intent"), F.lit(weight).alias("weight"))) for when, query, intent, weight in made])
    kept = F.filter(every, lambda b: b.isNotNull())
    return F.slice(F.filter(kept, lambda b, i: F.array_position(F.transform(kept, lambda x: x["query"]), b["query"]) == i + 1), 1, most)


def claim_bundles(targets: DataFrame, most: int = 6) -> DataFrame:
    """(qid, option, place, query, intent, weight): the weighted queries of each claim target, at most ``most``."""
    text, stem, kind = F.col("text"), F.col("stem"), F.col("claim_type")
    n, d, always = F.col("numbers"), F.col("dates"), F.lit(True)
    measured = kind.isin("metric_fact", "comparison")
    rows = targets.withColumn("aliases", metric_aliases(F.concat_ws(" ", stem, text)))
    made = _bundles(
        [
            (always, words(stem, F.col("option"), text), "stem_claim", 1.0),
            (F.size("entities") > 0, words(first(F.col("entities"), 8)), "entity_anchor", 0.9),
            (measured, words(stem, text, first(n, 4)), "metric_value", 1.0),
            (measured & (F.size("aliases") > 0), words(F.col("aliases"), first(d, 2), first(n, 2)), "metric_alias", 3.0),
            (measured & F.concat_ws(" ", stem, text).rlike(DIVIDEND), words("末期股息", "建议派发", "每10股", "每股现金分红", first(d, 2)), "dividend_final", 4.0),
            (kind == "comparison", words(stem, text, "比较", "数值", "同比", "高于", "低于"), "comparison_endpoint", 0.95),
            (kind == "date_fact", words(stem, text, first(d, 4), "日期", "期限", "时间"), "date_schedule", 0.95),
            (kind == "clause_consequence", words(stem, text, "处罚", "扣减", "期限", "不得", "应当"), "clause_consequence", 1.0),
            (F.size("should_terms") > 0, words(first(F.col("must_terms"), 4), first(F.col("should_terms"), 4)), "claim_terms", 0.75),
        ],
        most,
    )
    return rows.select("qid", "option", F.posexplode(made).alias("place", "b")).select("qid", "option", "place", "b.query", "b.intent", "b.weight")


def _sorted_options(column: str = "options") -> Column:
    return F.array_sort(F.map_entries(column))


def whole_text(question: Column) -> Column:
    """The stem with all options by letter."""
    return F.concat_ws(" ", question, F.array_join(F.transform(_sorted_options(), lambda e: F.concat_ws(" ", e["key"], e["value"])), " "))


def logic_queries(questions: DataFrame, most: int = 12) -> DataFrame:
    """(qid, place, query): the stem, the stem with its entities, and each option with the stem and with the entities of both."""
    rows = questions.select("qid", F.coalesce("question", F.lit("")).alias("stem"), "options", entities(F.col("question")).alias("asked"))
    of_option = lambda e: F.array(F.concat_ws(" ", "stem", e["key"], e["value"]), F.when(F.size(entities(e["value"])) > 0, words(first(F.col("asked"), 8), first(entities(e["value"]), 8))).otherwise(F.lit("")))
    made = F.concat(F.array("stem"), F.array(F.when(F.size("asked") > 0, F.concat_ws(" ", "stem", F.array_join("asked", " "))).otherwise(F.lit(""))), F.flatten(F.transform(_sorted_options(), of_option)))
    return rows.select("qid", F.posexplode(first(ordered(made), most)).alias("place", "query"))


def linear_queries(questions: DataFrame, most: int = 12) -> DataFrame:
    """(qid, place, query): all entities in a line, and each with the stem; the whole question where there are none."""
    whole = whole_text(F.col("question"))
    rows = questions.select("qid", "question", whole.alias("whole"), entities(whole).alias("e"))
    made = F.when(F.size("e") > 0, F.concat(F.array(words(first(F.col("e"), 8))), F.transform(first(F.col("e"), 12), lambda x: F.concat_ws(" ", x, "question")))).otherwise(F.array("whole"))
    return rows.select("qid", F.posexplode(first(ordered(made), most)).alias("place", "query"))


def pair_queries(questions: DataFrame, n: int = 8, most: int = 16) -> DataFrame:
    """(qid, place, query): the whole question, all pairs of its first ``n`` entities, and the entities of each option with it."""
    whole = whole_text(F.col("question"))
    rows = questions.select("qid", "options", whole.alias("whole"), first(entities(whole), n).alias("e"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, n), lambda y: F.concat_ws(" ", x, y))))
    own = F.flatten(F.transform(_sorted_options(), lambda o: F.transform(first(entities(o["value"]), 4), lambda x: F.concat_ws(" ", x, o["value"]))))
    return rows.select("qid", F.posexplode(first(ordered(F.concat(F.array("whole"), pairs, own)), most)).alias("place", "query"))


def retrieval_targets(questions: DataFrame) -> DataFrame:
    """What each question asks for: (qid, doc_scope, must_terms, should_terms, numbers, dates, entities, option_terms, intent, variants)."""
    stem = F.coalesce("question", F.lit(""))
    node = squeezed(stem)
    base = F.trim(F.concat_ws(" ", stem, node))
    short = lambda v: F.when(F.length(squeezed(v)).between(2, 24), F.array(squeezed(v))).otherwise(F.array().cast("array<string>"))
    terms = first(ordered(F.flatten(F.transform(_sorted_options(), lambda o: F.concat(short(o["value"]), first(entities(o["value"]), 4))))), 12)
    rows = questions.select("qid", stem.alias("stem"), node.alias("node"), base.alias("base"), "options", F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_scope"), ordered(F.concat(entities(stem), entities(node))).alias("e"), ordered(numbers(base)).alias("numbers"), ordered(dates(base)).alias("dates"), terms.alias("option_terms"))
    rows = rows.withColumn("must_terms", first(ordered(F.concat(first(F.col("e"), 8), first(F.col("numbers"), 4), first(F.col("dates"), 4))), 10))
    rows = rows.withColumn("should_terms", first(F.array_except("option_terms", "must_terms"), 8))
    every = F.array_join(F.transform(_sorted_options(), lambda o: F.concat_ws(" ", o["key"], o["value"])), " ")
    if_any = lambda items, query: F.when(F.size(items) > 0, query).otherwise(F.lit(""))
    variants = F.array(
        F.concat_ws(" ", "stem", every), F.concat_ws(" ", "stem", "node"), F.when(every != "", F.concat_ws(" ", "node", every)).otherwise(F.lit("")), words(first(F.col("must_terms"), 8)),
        if_any("should_terms", words(first(F.col("must_terms"), 4), first(F.col("should_terms"), 4))), if_any("numbers", words(F.col("stem"), first(F.col("numbers"), 4))), if_any("dates", words(F.col("stem"), first(F.col("dates"), 4))),
    )
    intent = F.when(squeezed(F.col("base")).rlike(INTENT_COMPARISON), "comparison").when((F.size("numbers") > 0) | (F.size("dates") > 0), "number").otherwise("fact")
    return rows.select("qid", "doc_scope", "must_terms", "should_terms", "numbers", "dates", first(F.col("e"), 12).alias("entities"), "option_terms", intent.alias("intent"), first(ordered(variants), 8).alias("variants"))


def short_query(targets: DataFrame, most: int = 4) -> DataFrame:
    """(qid, query): the first terms of a retrieval target in a line."""
    return targets.select("qid", words(first(ordered(F.concat("must_terms", "option_terms", "numbers", "dates")), most)).alias("query"))


def required_slots(targets: DataFrame, consequence: str = "处罚|罚款|扣减|减分|责令|不得|应当|期限|赔付|免责") -> DataFrame:
    """Adds ``required``, the slots that evidence for a target has to cover; targets have doc_scope, must_terms, numbers, dates,
    intent and stem."""
    tagged = lambda tag, items, n: F.transform(first(items, n), lambda x: F.concat(F.lit(tag), x))
    if_ = lambda when, slot: F.when(when, F.array(F.lit(slot))).otherwise(F.array().cast("array<string>"))
    parts = [F.transform("doc_scope", lambda x: F.concat(F.lit("doc:"), x)), tagged("term:", F.col("must_terms"), 8), tagged("number:", F.col("numbers"), 4), tagged("date:", F.col("dates"), 4)]
    parts += [if_(F.col("intent").isin("number", "comparison"), "fact:numeric_value"), if_(F.col("intent") == "comparison", "fact:comparison_endpoints"), if_(F.col("stem").rlike(consequence), "fact:consequence")]
    return targets.withColumn("required", ordered(reduce(lambda a, b: F.concat(a, b), parts)))
