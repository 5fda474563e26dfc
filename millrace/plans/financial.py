"""Queries: metric rows of texts, and typed numeric facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import facts, financial
from millrace.plans.registry import query
from millrace.sources.tables import table

_N, _U = r"[-+]?[0-9][0-9,，]*(?:\.[0-9]+)?", "元/股|%|％|元|千元|百万元|万元|亿元|万|亿|倍"
_V = rf"[(（]\s*{_N}\s*[)）]\s*(?:{_U})?|{_N}\s*(?:{_U})?"
_LABEL = r"20[0-9]{2}\s*年(?:末|度)?|本年(?:末)?比上年(?:末)?增减|同比(?:增长|下降)?|变动比例"
_ALIASES = {
    "归属于上市公司股东的净利润": ("归属于上市公司股东的净利润", "归母净利润", "母公司拥有人应占溢利"), "经营活动产生的现金流量净额": ("经营活动产生的现金流量净额", "经营活动现金流净额", "经营现金流净额"),
    "研发投入占营业收入比例": ("研发投入占营业收入比例", "研发费用占营业收入比例", "研发投入强度"), "研发投入": ("研发投入金额", "研发投入", "研发费用"), "营业收入": ("营业收入", "营业额"), "净利润": ("净利润",),
    "每股收益": ("基本每股收益", "稀释每股收益", "每股收益"), "每10股现金分红": ("每10股派息数", "每10股派发现金红利", "每10股派发现金红利人民币"), "每股现金分红": ("每股现金分红", "每股派息"), "现金分红金额": ("现金分红金额", "现金红利总额"),
    "资产负债率": ("资产负债率",), "总资产": ("总资产",), "归属于上市公司股东的净资产": ("归属于上市公司股东的净资产", "归属于母公司股东权益"),
}


def _spaced(alias: str) -> str:
    return r"\s*".join(alias)


def _values(x: str) -> str:
    """SQL of the (raw, unit) of the values of a text."""
    found = rf"list_transform(regexp_extract_all({x}, '({_V})', 1), lambda v: {{'n': regexp_extract(v, '{_N}'), 'u': regexp_extract(v, '({_U})$', 1), 'b': regexp_matches(v, '^[(（]')}})"
    kept = f"list_filter({found}, lambda v: v.u <> '' or not regexp_matches(replace(v.n, ',', ''), '^20[0-9]{{2}}$'))"
    return f"list_transform({kept}, lambda v: {{'raw': case when v.b and not starts_with(v.n, '-') then '(' || v.n || ')' else v.n end, 'u': v.u}})"


_PAIRS = ", ".join(f"('{metric}', '{alias}', '{_spaced(alias)}')" for metric, aliases in _ALIASES.items() for alias in aliases)

# Positions come from what stands before the first match, cut off by the pattern itself.
ROWS = rf"""al(metric, alias, pat) as (values {_PAIRS}),
    src as (select doc_id, list_filter(list_transform(string_split_regex(raw_text, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as lines from raw_documents where raw_text is not null),
    ln as materialized (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from src),
    hit as (select doc_id, i, line, metric, alias, length(string_split_regex(line, pat)[1]) + 1 as st, length(regexp_extract(line, pat)) as len from ln, al where regexp_matches(line, pat)),
    mt as materialized (select doc_id, i, line, metric, alias, st, st + len as en from hit qualify row_number() over (partition by doc_id, i order by st, length(alias) desc, alias) = 1),
    w as (select mt.*, case when regexp_matches(substring(mt.line, mt.en), '[。；;]') then left(mt.line, mt.en - 1 + length(string_split_regex(substring(mt.line, mt.en), '[。；;]')[1]) + 1) else mt.line end as r0, a.line as n1, b.line as n2, ma.i is not null as h1, mb.i is not null as h2
      from mt left join ln a on a.doc_id = mt.doc_id and a.i = mt.i + 1 left join ln b on b.doc_id = mt.doc_id and b.i = mt.i + 2 left join mt ma on ma.doc_id = mt.doc_id and ma.i = mt.i + 1 left join mt mb on mb.doc_id = mt.doc_id and mb.i = mt.i + 2),
    w0 as (select *, {_values('substring(r0, en)')} as v0 from w),
    w1 as (select *, case when len(v0) = 0 and n1 is not null and not h1 then r0 || ' ' || n1 end as r1 from w0),
    w2 as (select *, {_values('substring(r1, en)')} as v1 from w1),
    w3 as (select *, case when r1 is not null and len(v1) = 0 and n2 is not null and not h2 then r1 || ' ' || n2 end as r2 from w2),
    w4 as (select *, coalesce(r2, r1, r0) as raw_row, case when len(v0) > 0 then v0 when len(v1) > 0 then v1 else {_values('substring(r2, en)')} end as vals from w3),
    hd as (select doc_id, i, line from ln where len(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(line, '{_LABEL}'), ' '), '20[0-9]{{2}}'))) >= 2 or regexp_matches(line, '增减|变动比例')),
    un as (select doc_id, i, regexp_extract(line, '(?:单位|币种)\s*[:：]?\s*(?:人民币)?\s*(元/股|元|千元|百万元|万元|亿元)', 1) as u from ln where regexp_matches(line, '(?:单位|币种)\s*[:：]?\s*(?:人民币)?\s*(元/股|元|千元|百万元|万元|亿元)')),
    w5 as (select w4.*, case when regexp_matches(raw_row, '金额为|约为|达到|均实现|同比上升|同比下降|同比增长|同比减少') then '' else coalesce((select arg_max(line, i) from hd where hd.doc_id = w4.doc_id and hd.i between w4.i - 8 and w4.i - 1), '') end as header,
      coalesce(nullif(regexp_extract(raw_row, '[（(]\s*(元/股|元|千元|百万元|万元|亿元|%|％)\s*[）)]', 1), ''), (select arg_max(u, i) from un where un.doc_id = w4.doc_id and un.i between w4.i - 10 and w4.i - 1), '') as ou from w4 where len(vals) > 0),
    w6 as (select *, regexp_extract_all(header, '{_LABEL}') as labels, list_distinct(regexp_extract_all(concat_ws(' ', header, left(raw_row, st - 1)), '20[0-9]{{2}}')) as years from w5),
    w7 as (select *, case when len(years) = 1 then years[1] else '' end as sole, coalesce(nullif(list_filter(list_transform(labels, lambda x: regexp_extract(x, '20[0-9]{{2}}')), lambda y: y <> '')[1], ''), case when len(years) = 1 then years[1] else '' end) as cur from w6),
    w8 as (select *, list_transform(vals, lambda v, k: concat_ws('~', coalesce(labels[k], ''), case when regexp_extract(coalesce(labels[k], ''), '20[0-9]{{2}}') <> '' then regexp_extract(labels[k], '20[0-9]{{2}}') when regexp_matches(coalesce(labels[k], ''), '增减|同比|变动') then cur else sole end, v.raw, case when v.u <> '' then v.u when ou <> '' then ou else '未标明' end)) as cells from w7),
    fr as materialized (select doc_id, i as line_no, metric, alias as raw_metric, header, coalesce(nullif(ou, ''), '未标明') as unit, raw_row, cells from w8 qualify row_number() over (partition by doc_id, metric, header, array_to_string(list_transform(vals, lambda v: v.raw), '~') order by i) = 1)"""


def metric_rows(spark, base):
    return financial.metric_rows(table(spark, base, "raw_documents", "doc_id", "raw_text"), "doc_id", "raw_text")


@query("p_metric_rows", f"with {ROWS} select doc_id, line_no, metric, raw_metric, header, unit, md5(raw_row) as row_md5, array_to_string(cells, '|') as cells from (select *, row_number() over (partition by doc_id order by line_no) as n from fr) where n <= 48")
def p_metric_rows(spark, base):
    cell = lambda c: F.concat_ws("~", c["column"], c["year"], c["raw_value"], c["unit"])
    return metric_rows(spark, base).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "metric", "raw_metric", "header", "unit", F.md5("raw_row").alias("row_md5"), F.array_join(F.transform("cells", cell), "|").alias("cells"))


_SCOPE = "case when regexp_matches({0}, '分季度主要财务指标|第一季度|第二季度|第三季度|第四季度') then 'quarter' when regexp_matches({0}, '某一单个客户|单一客户|分部信息|分地区|分行业|分产品') then 'segment' when regexp_matches({0}, '母公司财务报表|母公司利润表|公司现金流量表') then 'parent' when regexp_matches({0}, '合并利润表|合并现金流量表|主要会计数据|合计') then 'consolidated' else 'unknown' end"


@query("p_metric_row_texts", f"""with {ROWS} select doc_id, line_no, md5(concat_ws(chr(10), nullif(title, ''), '财务指标: ' || metric, '表头: ' || nullif(header, ''), '单位: ' || unit, '原始行: ' || raw_row)) as text_md5,
    round(1 + case when header <> '' then 1.5 else 0 end + case when unit <> '未标明' then 1 else 0 end + case when len(cells) >= 2 then 0.75 else 0 end + case when len(list_distinct(list_filter(list_transform(cells, lambda c: split_part(c, '~', 2)), lambda y: y <> ''))) >= 2 then 1.25 else 0 end + case {_SCOPE.format('raw_row')} when 'consolidated' then 1 when 'unknown' then 0 else -3 end, 3) as quality
    from (select *, row_number() over (partition by doc_id order by line_no) as n from fr) join (select doc_id, title from raw_documents) using (doc_id) where n <= 48""")
def p_metric_row_texts(spark, base):
    rows = metric_rows(spark, base).join(table(spark, base, "raw_documents", "doc_id", "title"), "doc_id")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(financial.row_text(F.col("title"))).alias("text_md5"), financial.row_quality(facts.scope_of(F.col("raw_row"))).alias("quality"))


@query("n_scope", f"select distinct chunk_id, {_SCOPE.format('text')} as scope from chunks")
def n_scope(spark, base):
    return table(spark, base, "chunks", "chunk_id", "text").distinct().select("chunk_id", facts.scope_of(F.col("text")).alias("scope"))


_UF = "case when {0} in ('%', '％') then 'ratio' when {0} = '倍' then 'multiple' when {0} = '元/股' then 'per_share' when {0} in ('元', '千元', '百万元', '万元', '亿元', '万', '亿') then 'money' else coalesce(nullif({0}, ''), 'scalar') end"


@query("n_ledger", rf"""with f as (select distinct fact_id, raw_value, unit from numeric_facts), p as (select fact_id, unit, try_cast(regexp_replace(regexp_extract(raw_value, '([0-9][0-9,，]*(?:\.[0-9]+)?)', 1), '[,，]', '', 'g') as decimal(28,6)) as v, case when regexp_matches(raw_value, '^\s*-|^\s*[(（].*[)）]\s*$') then -1 else 1 end as sign from f)
    select fact_id, round((sign * v * case unit when '千元' then 1000 when '百万元' then 1000000 when '万元' then 10000 when '万' then 10000 when '亿元' then 100000000 when '亿' then 100000000 when '%' then 0.01 when '％' then 0.01 else 1 end)::double, 4) as value, {_UF.format('unit')} as family from p""")
def n_ledger(spark, base):
    f = table(spark, base, "numeric_facts", "fact_id", "raw_value", "unit").distinct()
    return f.select("fact_id", F.round(facts.ledger_value(F.col("raw_value"), F.col("unit")).cast("double"), 4).alias("value"), facts.unit_family(F.col("unit")).alias("family"))


_KNOWN = ["经营活动产生的现金流量净额", "经营活动现金流净额", "归属于上市公司股东的净利润", "归母净利润", "营业收入", "净利润", "研发投入", "现金分红", "资产负债率", "每股收益", "发行规模", "票面利率", "保险金额", "赔付金额", "赔偿限额", "免赔额", "保费"]
_FV, _FU = r"[-+]?[0-9][0-9,，]*(?:\.[0-9]+)?", "亿元|百万元|万元|千元|元|亿|万|%|％|倍"


@query("n_text_facts", rf"""with c as (select distinct chunk_id, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from chunks),
    tk as (select chunk_id, doc_id, t, unnest(k) as tok, generate_subscripts(k, 1) as i from (select *, regexp_extract_all(t, '[(（]\s*{_FV}\s*[)）]\s*(?:{_FU})?|{_FV}\s*(?:{_FU})?|[^0-9+(（-]+|(?s:.)') as k from c)),
    ps as (select *, (sum(length(tok)) over (partition by chunk_id order by i) - length(tok))::bigint as st from tk),
    m as (select chunk_id, doc_id, t, st, st + length(tok) as en, regexp_extract(tok, '{_FV}') as raw, coalesce(nullif(regexp_extract(tok, '({_FU})$', 1), ''), regexp_extract(left(t, 500), '(?:单位|币种)\s*[:：]?\s*(?:人民币)?\s*(元|千元|万元|亿元|万|亿)', 1)) as unit, case when regexp_matches(tok, '^[(（]') and not starts_with(regexp_extract(tok, '{_FV}'), '-') then -1 else 1 end as sg from ps where regexp_matches(tok, '^[(（]?\s*[-+]?[0-9]')),
    x as (select *, trim(substring(t, greatest(st - 56, 0) + 1, least(en + 56, length(t)) - greatest(st - 56, 0))) as ctx from m where not (unit = '' and regexp_matches(replace(raw, ',', ''), '^(?:19|20)[0-9]{{2}}$'))),
    y as (select *, coalesce(list_sort(list_transform(list_filter({_KNOWN}, lambda k: contains(ctx, k)), lambda k: {{'n': -length(k), 'p': list_position({_KNOWN}, k), 'k': k}}))[1].k, '未识别指标') as metric, coalesce(regexp_extract_all(ctx, '(?:19|20)[0-9]{{2}}')[-1], '') as year, try_cast(regexp_replace(raw, '[,，]', '', 'g') as decimal(28,6)) * sg * case unit when '千元' then 1000 when '百万元' then 1000000 when '万元' then 10000 when '万' then 10000 when '亿元' then 100000000 when '亿' then 100000000 when '%' then 0.01 when '％' then 0.01 else 1 end as v from x)
    select chunk_id, metric, year, coalesce(nullif(unit, ''), '未标明') as unit, round(v::double, 4) as value, min(st) as start from y where v is not null group by chunk_id, metric, year, unit, v""")
def n_text_facts(spark, base):
    found = facts.text_facts(table(spark, base, "chunks", "chunk_id", "doc_id", "text").distinct())
    return found.select("chunk_id", "metric", "year", "unit", F.round(F.col("value").cast("double"), 4).alias("value"), F.col("start").cast("long").alias("start"))
