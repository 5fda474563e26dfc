"""Queries: entities, claim targets, query bundles and retrieval targets of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import asking
from millrace.plans.registry import query
from millrace.plans.retrieval import questions

_NUM = r"[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:%|％|元|万元|亿元|万|亿)?"
_DATE = r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"


def sq(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def ordered(x: str) -> str:
    """SQL of a list in order, squeezed, each element once; list_reduce adds what isn't there yet."""
    return f"list_reduce(list_prepend([]::varchar[], list_transform(list_filter(list_transform({x}, lambda x: {sq('x')}), lambda x: x <> ''), lambda x: [x])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end)"


def nums(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_NUM}'), lambda v: trim(v))"


def days(x: str) -> str:
    return f"regexp_extract_all({x}, '{_DATE}')"


def entities(x: str) -> str:
    trims = " ".join(f"when contains(v, '{m}') and length(trim(trim(split_part(v, '{m}', -1)), '的')) >= 4 then trim(trim(split_part(v, '{m}', -1)), '的')" for m in ("名称为", "发行人为", "发行人是", "指定", "明确", "由", "为"))
    parts = [
        f"regexp_extract_all({x}, '《[^》]{{2,80}}》')",
        f"regexp_extract_all({x}, '(?:营业收入|净利润|现金流量净额|研发投入|分红|票面利率|发行规模|评级|担保|身故保险金|现金价值|保险责任|退保|客户尽职调查|受益所有人|等待期|股份回购)')",
        rf"regexp_extract_all({x}, '20[0-9]{{2}}\s*年')",
        f"regexp_extract_all({x}, '[一-鿿A-Za-z0-9]{{2,30}}(?:e生保|医疗险|重疾险|家财险|意外险|年金保险|养老保险|募集说明书)')",
        f"list_transform(regexp_extract_all({x}, '[一-鿿A-Za-z0-9（）()]{{2,48}}(?:股份有限公司|集团有限公司|有限公司|公司|集团|银行|保险|证券|基金|债券|报告|办法|条例|规定|细则|通知|指引|准则|产品)'), lambda v: case {trims} else v end)",
        f"list_filter(regexp_extract_all({x}, '[一-鿿]+'), lambda v: length(v) between 2 and 12 and v not in ('根据', '提供', '文档', '显示', '下列', '哪项', '正确', '错误', '判断', '是否', '关于', '其中', '以及', '同时', '报告', '年度', '全文', '增长'))",
        nums(x), days(x),
    ]
    return f"({ordered('list_filter(flatten([' + ', '.join(parts) + ']), lambda v: length(trim(v)) >= 2)')})[1:24]"


EACH = f"""e as (select qid, question as stem, doc_ids, o.key as option, coalesce(o.value, '') as text from (select qid, coalesce(question, '') as question, coalesce(doc_ids, []) as doc_ids, unnest(map_entries(options)) as o from questions)),
    x as materialized (select *, trim(concat_ws(' ', stem, text)) as pair, {entities('text')} as own, {entities('stem')} as asked from e),
    y as (select *, {ordered(nums('pair'))} as n, {ordered(days('pair'))} as d from x),
    t as materialized (select qid, option, text, stem, doc_ids, ({ordered('list_concat(own, asked)')})[1:12] as entities, n[1:6] as numbers, d[1:6] as dates, ({ordered('list_concat(list_concat(own[1:6], n[1:4]), list_concat(d[1:4], asked[1:3]))')})[1:10] as must_terms, ({ordered('list_concat([text], own[1:6])')})[1:8] as should_terms,
      case when regexp_matches(pair, '比较|高于|低于|增加|减少|同比|环比|超过|不超过') then 'comparison' when regexp_matches(pair, '处罚|罚款|扣减|减分|责令|不得|期限|应当|可以') then 'clause_consequence' when regexp_matches(pair, '营业收入|净利润|现金流|分红|每股|派现|股息|资产负债率') or len(n) > 0 then 'metric_fact' when regexp_matches(pair, '日期|时间|期限|之前|之后|年度|年末') or len(d) > 0 then 'date_fact' else 'fact' end as claim_type from y)"""


def joined(*columns: str) -> list[F.Column]:
    return [F.array_join(c, "|").alias(c) for c in columns]


def _joined(*columns: str) -> str:
    return ", ".join(f"array_to_string({c}, '|') as {c}" for c in columns)


@query("q_entities", f"select qid, array_to_string({entities('question')}, '|') as entities from (select qid, coalesce(question, '') as question from questions)")
def q_entities(spark, base):
    return questions(spark, base).select("qid", F.array_join(asking.entities(F.col("question")), "|").alias("entities"))


@query("q_claim_targets", f"with {EACH} select qid, option, claim_type, {_joined('entities', 'numbers', 'dates', 'must_terms', 'should_terms')}, case claim_type when 'comparison' then 'comparator_endpoint|entity_anchor|value' when 'clause_consequence' then 'consequence|entity_anchor' when 'metric_fact' then 'entity_anchor|metric|value' when 'date_fact' then 'date|entity_anchor' else 'entity_anchor' end as slots from t")
def q_claim_targets(spark, base):
    return asking.claim_targets(questions(spark, base)).select("qid", "option", "claim_type", *joined("entities", "numbers", "dates", "must_terms", "should_terms", "slots"))


_ALIASES = ordered("""flatten([case when regexp_matches(concat_ws(' ', stem, text), '归母净利润|净利润增速|归属于母公司') then ['归属于上市公司股东的净利润', '母公司拥有人应占溢利', '本年比上年增减'] else [] end,
      case when regexp_matches(concat_ws(' ', stem, text), '研发投入|研发费用|研发强度') then ['研发投入占营业收入比例', '研发费用占营业收入比例', '研发投入金额'] else [] end,
      case when regexp_matches(concat_ws(' ', stem, text), '每股现金分红|每股分红|现金分红|每股派息') then ['每10股派发现金红利', '每10股派息数', '现金分红金额', '利润分配预案', '末期股息', '建议派发末期股息', '每股股息', '派息率'] else [] end,
      case when regexp_matches(concat_ws(' ', stem, text), '经营活动现金流|经营现金流') then ['经营活动产生的现金流量净额', '经营活动现金流净额'] else [] end,
      case when regexp_matches(concat_ws(' ', stem, text), '营业收入|营业额') then ['营业收入', '营业额', '本年比上年增减'] else [] end])""")


def _line(*items: str) -> str:
    return sq("concat_ws(' ', " + ", ".join(items) + ")")


def _list(x: str) -> str:
    return f"array_to_string({x}, ' ')"


BUNDLES = f"""al as (select *, {_ALIASES} as aliases, claim_type in ('metric_fact', 'comparison') as measured from t),
    raw as (select qid, option, unnest([
      {{'i': 0, 'query': {_line('stem', 'option', 'text')}, 'intent': 'stem_claim', 'weight': 1.0, 'use': true}},
      {{'i': 1, 'query': {_line(_list('entities[1:8]'))}, 'intent': 'entity_anchor', 'weight': 0.9, 'use': len(entities) > 0}},
      {{'i': 2, 'query': {_line('stem', 'text', _list('numbers[1:4]'))}, 'intent': 'metric_value', 'weight': 1.0, 'use': measured}},
      {{'i': 3, 'query': {_line(_list('aliases'), _list('dates[1:2]'), _list('numbers[1:2]'))}, 'intent': 'metric_alias', 'weight': 3.0, 'use': measured and len(aliases) > 0}},
      {{'i': 4, 'query': {_line("'末期股息 建议派发 每10股 每股现金分红'", _list('dates[1:2]'))}, 'intent': 'dividend_final', 'weight': 4.0, 'use': measured and regexp_matches(concat_ws(' ', stem, text), '分红|股息|派息|利润分配')}},
      {{'i': 5, 'query': {_line('stem', 'text', "'比较 数值 同比 高于 低于'")}, 'intent': 'comparison_endpoint', 'weight': 0.95, 'use': claim_type = 'comparison'}},
      {{'i': 6, 'query': {_line('stem', 'text', _list('dates[1:4]'), "'日期 期限 时间'")}, 'intent': 'date_schedule', 'weight': 0.95, 'use': claim_type = 'date_fact'}},
      {{'i': 7, 'query': {_line('stem', 'text', "'处罚 扣减 期限 不得 应当'")}, 'intent': 'clause_consequence', 'weight': 1.0, 'use': claim_type = 'clause_consequence'}},
      {{'i': 8, 'query': {_line(_list('must_terms[1:4]'), _list('should_terms[1:4]'))}, 'intent': 'claim_terms', 'weight': 0.75, 'use': len(should_terms) > 0}}]) as b from al),
    firsts as (select qid, option, b.query as query, b.intent as intent, b.weight::double as weight, b.i as i, row_number() over (partition by qid, option, b.query order by b.i) as k from raw where b.use and b.query <> ''),
    bundles as materialized (select * from (select qid, option, row_number() over (partition by qid, option order by i) - 1 as place, query, intent, weight from firsts where k = 1) where place < 6)"""


@query("q_claim_bundles", f"with {EACH}, {BUNDLES} select qid, option, place, query, intent, weight from bundles")
def q_claim_bundles(spark, base):
    return asking.claim_bundles(asking.claim_targets(questions(spark, base))).withColumn("place", F.col("place").cast("long"))


_OPTIONS = "list_sort(map_entries(options))"
_WHOLE = f"concat_ws(' ', question, array_to_string(list_transform({_OPTIONS}, lambda o: concat_ws(' ', o.key, o.value)), ' '))"


def _places(source: str, made: str, most: int) -> str:
    return f"select qid, unnest(l) as query, generate_subscripts(l, 1) - 1 as place from (select qid, ({ordered(made)})[1:{most}] as l from ({source}))"


@query("q_logic", _places(f"select *, {entities('question')} as asked, list_transform({_OPTIONS}, lambda o: {{'k': o.key, 'v': o.value, 'e': {entities('o.value')}}}) as os from (select qid, coalesce(question, '') as question, options from questions)", "flatten([[question], [case when len(asked) > 0 then concat_ws(' ', question, array_to_string(asked, ' ')) else '' end], flatten(list_transform(os, lambda o: [concat_ws(' ', question, o.k, o.v), case when len(o.e) > 0 then concat_ws(' ', array_to_string(asked[1:8], ' '), array_to_string(o.e[1:8], ' ')) else '' end]))])", 12))
def q_logic(spark, base):
    return asking.logic_queries(questions(spark, base)).withColumn("place", F.col("place").cast("long"))


@query("q_linear", _places(f"select *, {entities('whole')} as e from (select qid, question, {_WHOLE} as whole from questions)", "case when len(e) > 0 then list_concat([array_to_string(e[1:8], ' ')], list_transform(e[1:12], lambda v: concat_ws(' ', v, question))) else [whole] end", 12))
def q_linear(spark, base):
    return asking.linear_queries(questions(spark, base)).withColumn("place", F.col("place").cast("long"))


@query("q_pairs", _places(f"select *, ({entities('whole')})[1:8] as e, list_transform({_OPTIONS}, lambda o: {{'v': o.value, 'e': ({entities('o.value')})[1:4]}}) as os from (select qid, options, {_WHOLE} as whole from questions)", "flatten([[whole], flatten(list_transform(e, lambda a, i: list_transform(e[i + 1:], lambda b: concat_ws(' ', a, b)))), flatten(list_transform(os, lambda o: list_transform(o.e, lambda a: concat_ws(' ', a, o.v))))])", 16))
def q_pairs(spark, base):
    return asking.pair_queries(questions(spark, base)).withColumn("place", F.col("place").cast("long"))


TARGETS = rf"""b0 as (select qid, coalesce(question, '') as stem, {sq("coalesce(question, '')")} as node, coalesce(doc_ids, []) as doc_scope, list_transform({_OPTIONS}, lambda o: {{'k': o.key, 'v': o.value, 'e': ({entities('o.value')})[1:4]}}) as os from questions),
    b1 as (select *, trim(concat_ws(' ', stem, node)) as base, array_to_string(list_transform(os, lambda o: concat_ws(' ', o.k, o.v)), ' ') as every, {ordered(f"list_concat({entities('stem')}, {entities('node')})")} as e, ({ordered(f"flatten(list_transform(os, lambda o: list_concat(case when length({sq('o.v')}) between 2 and 24 then [o.v] else [] end, o.e)))")})[1:12] as option_terms from b0),
    b2 as (select *, {ordered(nums('base'))} as numbers, {ordered(days('base'))} as dates from b1),
    b3 as (select *, ({ordered('list_concat(e[1:8], list_concat(numbers[1:4], dates[1:4]))')})[1:10] as must_terms from b2),
    b4 as materialized (select *, (list_filter(option_terms, lambda v: not list_contains(must_terms, v)))[1:8] as should_terms, case when regexp_matches(base, '比较|对比|高于|低于|增加|减少|同比|环比|是否') then 'comparison' when len(numbers) > 0 or len(dates) > 0 then 'number' else 'fact' end as intent from b3)"""
_VARIANTS = ordered("[concat_ws(' ', stem, every), concat_ws(' ', stem, node), case when every <> '' then concat_ws(' ', node, every) else '' end, array_to_string(must_terms[1:8], ' '), case when len(should_terms) > 0 then concat_ws(' ', array_to_string(must_terms[1:4], ' '), array_to_string(should_terms[1:4], ' ')) else '' end, case when len(numbers) > 0 then concat_ws(' ', stem, array_to_string(numbers[1:4], ' ')) else '' end, case when len(dates) > 0 then concat_ws(' ', stem, array_to_string(dates[1:4], ' ')) else '' end]")


@query("q_targets", f"with {TARGETS} select qid, intent, {_joined('must_terms', 'should_terms', 'numbers', 'dates', 'option_terms')}, array_to_string(e[1:12], '|') as entities, array_to_string(({_VARIANTS})[1:8], '|') as variants from b4")
def q_targets(spark, base):
    return asking.retrieval_targets(questions(spark, base)).select("qid", "intent", *joined("must_terms", "should_terms", "numbers", "dates", "option_terms", "entities", "variants"))


@query("q_short", f"with {TARGETS} select qid, array_to_string(({ordered('list_concat(list_concat(must_terms, option_terms), list_concat(numbers, dates))')})[1:4], ' ') as query from b4")
def q_short(spark, base):
    return asking.short_query(asking.retrieval_targets(questions(spark, base)))


@query("q_required_slots", f"""with {TARGETS} select qid, array_to_string({ordered("flatten([list_transform(doc_scope, lambda v: 'doc:' || v), list_transform(must_terms[1:8], lambda v: 'term:' || v), list_transform(numbers[1:4], lambda v: 'number:' || v), list_transform(dates[1:4], lambda v: 'date:' || v), case when intent in ('number', 'comparison') then ['fact:numeric_value'] else [] end, case when intent = 'comparison' then ['fact:comparison_endpoints'] else [] end, case when regexp_matches(stem, '处罚|罚款|扣减|减分|责令|不得|应当|期限|赔付|免责') then ['fact:consequence'] else [] end])")}, '|') as required from b4""")
def q_required_slots(spark, base):
    targets = asking.retrieval_targets(questions(spark, base)).join(questions(spark, base).select("qid", F.coalesce("question", F.lit("")).alias("stem")), "qid")
    return asking.required_slots(targets).select("qid", *joined("required"))
