"""Queries: parents and children of chunks, table rows, clauses and cleaned texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import hierarchy
from millrace.plans import sqltext as S
from millrace.plans.registry import query
from millrace.sources.tables import table

_CLAUSE = "第[一二三四五六七八九十百千万0-9]+[章节条款]"
_OUTLINE = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){1,4})(\s+.*)$"


def _first_line(x: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split({x}, chr(10)), lambda v: trim(v)), lambda v: v <> '')[1], '')"


def _strict(line: str) -> str:
    small = f"len(list_filter(string_split(regexp_extract({line}, '{_OUTLINE}', 1), '.'), lambda v: not coalesce(try_cast(v as int) between 1 and 30, false))) = 0"
    return f"case when regexp_matches({line}, '^{_CLAUSE}') then regexp_extract({line}, '^{_CLAUSE}') when regexp_matches({line}, '{_OUTLINE}') and {small} and not regexp_matches(trim(regexp_extract({line}, '{_OUTLINE}', 2)), '^(?:%|％|元|千元|万元|亿元|万|亿|倍|[-+]?[0-9])') then regexp_extract({line}, '{_OUTLINE}', 1) else '' end"


def _normal(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[ \t\r\f\v\x{{A0}}\x{{3000}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def chunks(spark, base):
    rows = table(spark, base, "chunks").select("chunk_id", "doc_id", "domain", "page", F.coalesce("section", F.lit("")).alias("section"), "clause_id", "text", "tables", F.col("metadata")["chunk_type"].alias("chunk_type"))
    return rows.dropDuplicates(["chunk_id"])


_C = "c as (select chunk_id, any_value(doc_id) as doc_id, any_value(domain) as domain, any_value(page) as page, any_value(coalesce(section, '')) as section, any_value(coalesce(clause_id, '')) as clause_id, any_value(text) as text, any_value(tables) as tables, coalesce(any_value(metadata['chunk_type']), 'text') as kind from chunks group by chunk_id)"


@query("p_parents", f"with {_C}, f as (select *, {_first_line('text')} as line from c where kind not in ('figure', 'financial_metric_row')), g as (select *, {_strict('line')} as own from f) select chunk_id, doc_id, page, section, case when own <> '' then own when starts_with(clause_id, '第') then clause_id else '' end as clause_id, kind as original_type from g")
def p_parents(spark, base):
    return hierarchy.parents(chunks(spark, base)).drop("text")


_WIDE = S.narrow("tab")


@query("p_table_children", rf"""with {_C}, t as (select chunk_id, unnest(tables) as tab, generate_subscripts(tables, 1) as t from c),
    l as (select chunk_id, t, list_filter(string_split({_normal(_WIDE)}, chr(10)), lambda v: v <> '') as lines from t),
    h0 as (select *, list_filter(list_transform(string_split(lines[1], '|'), lambda v: trim(v)), lambda v: v <> '') as cells from l where len(lines) > 0),
    h as (select *, case when len(cells) >= 2 and len(list_filter(cells, lambda v: regexp_matches(v, '^[-+()（）]?[0-9][0-9,，]*(?:\.[0-9]+)?(?:%|％|元|万元|亿元|万|亿)?$'))) < greatest(1, len(cells) // 2) then lines[1] else '' end as header from h0),
    d as (select chunk_id, t, header, unnest(case when header <> '' and len(lines) > 1 then lines[2:] else lines end) as row, generate_subscripts(case when header <> '' and len(lines) > 1 then lines[2:] else lines end, 1) as r from h)
    select chunk_id, row_number() over (partition by chunk_id order by t, r) - 1 as idx, md5(concat_ws(chr(10), '表头: ' || nullif(header, ''), '数据行: ' || row)) as text_md5 from d where length(row) >= 3 and not (header <> '' and row = header)""")
def p_table_children(spark, base):
    return hierarchy.table_rows(chunks(spark, base)).select("chunk_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text_md5"))


@query("p_atoms")
def p_atoms(spark, base):
    return hierarchy.children(chunks(spark, base)).select("child_id", "doc_id", "parent_id", "kind", "idx", "section", "clause_id", F.length("text").alias("n_chars"))


_LINES = "list_filter(string_split({}, chr(10)), lambda v: {})"
_TICKED = "translate(v, '□■✓✔', '')"


@query("t_clean_domain", rf"""with p as (select doc_id, domain, {_normal('raw_text')} as t from raw_documents where raw_text is not null),
    a as (select *, array_to_string({_LINES.format('t', r"trim(v) <> '' and trim(v) <> '目录' and not (regexp_matches(trim(v), '^(?:第[一二三四五六七八九十百千万0-9]+节\s+.*|[一二三四五六七八九十]+、.*|[0-9]+(?:\.[0-9]+)+.*)$') and (contains(v, '...') or regexp_matches(trim(v), '^第[一二三四]节')))")}, chr(10)) as u from p),
    b as (select *, array_to_string({_LINES.format('u', r"not (domain = 'financial_contracts' and regexp_matches(trim(v), '^(?:公司声明|重大事项提示|重大风险提示|释 义|释义)')) and not (domain = 'financial_reports' and regexp_matches(trim(v), '^(?:重要提示|本年度报告载有若干涉及本公司未来计划)')) and not regexp_matches(trim(v), '(?i)^<!--\s*image\s*-->$')")}, chr(10)) as w from a),
    d as (select *, case when domain = 'financial_reports' then array_to_string(list_transform({_LINES.format('w', f"trim({_TICKED}) not in ('适用 不适用', '是 否', '不适用', '适用')")}, lambda v: case when trim({_TICKED}) <> '' then trim({_TICKED}) else v end), chr(10)) else w end as x from b)
    select doc_id, md5({_normal('x')}) as md5 from d""")
def t_clean_domain(spark, base):
    # The rules of lines, on texts without compatibility forms, which SQL doesn't have.
    rows = table(spark, base, "raw_documents", "doc_id", "domain", "raw_text").filter("raw_text is not null").withColumn("normal", hierarchy.normal(F.col("raw_text")))
    return rows.select("doc_id", F.md5(hierarchy.cleaned(F.col("domain"), F.col("normal"))).alias("md5"))
