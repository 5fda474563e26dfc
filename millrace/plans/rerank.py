"""Queries: second scores of candidates, and their selection under budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import asking, evidence, ranking, rerank
from millrace.plans import sqltext as S
from millrace.plans.asking import EACH, TARGETS, days, nums, ordered
from millrace.plans.registry import query
from millrace.plans.retrieval import LISTS, claim_lists, questions
from millrace.sources.tables import table

ATTRIBUTES = "ca as materialized (select chunk_id, any_value(page) as page, any_value(coalesce(section, '')) as section, any_value(coalesce(clause_id, '')) as clause_id, any_value(text) as text, any_value(coalesce(numbers, [])) as numbers, any_value(coalesce(dates, [])) as dates, any_value(domain) as domain, any_value(metadata['chunk_type']) as chunk_type from chunks group by chunk_id)"
CANDIDATES = f"""{LISTS}, {ATTRIBUTES}, fu as (select qid, chunk_id, any_value(doc_id) as doc_id, sum(weight / (60 + rank)) as score from l group by all),
    cd as materialized (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, chunk_id) as rank from fu) join ca using (chunk_id) where rank <= 30)"""
ASKED = f"aq as materialized (select qid, {S.QUESTION_TEXT} as asked from questions)"


def attributes(spark, base):
    rows = table(spark, base, "chunks").select("chunk_id", "page", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("clause_id", F.lit("")).alias("clause_id"), "text", "numbers", "dates", "domain", F.col("metadata")["chunk_type"].alias("chunk_type"))
    return rows.dropDuplicates(["chunk_id"])


def candidates(spark, base):
    return ranking.reciprocal_rank_fusion(claim_lists(spark, base)).join(attributes(spark, base), "chunk_id")


def asked(spark, base):
    return questions(spark, base).select("qid", evidence.question_text(F.col("question"), F.col("options")).alias("asked"))


_SHARED = "len(list_intersect(list_distinct({}), {}))"


@query("r_rerank", f"""with {CANDIDATES}, {ASKED}, {TARGETS}, tq as materialized (select qid, list_distinct({S.tokens('asked')}) as qt from aq),
    j as (select cd.*, b4.must_terms, b4.option_terms, b4.numbers as qn, b4.dates as qd, b4.intent, b4.doc_scope, tq.qt, max(cd.score) over (partition by cd.qid) as top, row_number() over (partition by cd.qid, trim(text) order by rank) as copy,
      regexp_matches(text, '营业收入|净利润|现金流|分红|每股|派现|股息') as m, regexp_matches(text, '处罚|罚款|扣减|减分|责令|不得|期限') as c from cd join b4 using (qid) join tq using (qid)),
    z as (select qid, chunk_id, doc_id, rank, round(score / top + 0.18 * len(list_filter(must_terms, lambda v: contains(text, v))) + 0.08 * len(list_filter(option_terms, lambda v: contains(text, left(v, 16)))) + 0.12 * len(list_intersect(list_distinct(qn), numbers)) + 0.12 * len(list_intersect(list_distinct(qd), dates))
      + 0.35 * len(list_intersect(qt, {S.tokens('text')})) / greatest(len(qt), 1) + case when clause_id <> '' then 0.15 else 0 end + case when section not in ('', 'document') then 0.05 else 0 end
      + case when chunk_type in ('table', 'figure') then case when intent in ('number', 'comparison') then 0.1 else 0.04 end else 0 end + case when m then 0.18 else 0 end + case when c then 0.18 else 0 end
      - case when regexp_matches(text, '审计报告|公允反映|坚持依法合规|客观公正|原则|财务报表') and not m and not c then 0.22 else 0 end + case when regexp_matches(text, '[0-9]') and (m or c or intent in ('number', 'comparison')) then 0.12 else 0 end
      + case when list_contains(doc_scope, doc_id) then 0.1 else 0 end - case when copy > 1 then 0.08 else 0 end, 6) as score from j)
    select qid, chunk_id, doc_id, score, place from (select *, row_number() over (partition by qid order by score desc, rank) as place from z) where place <= 10""")
def r_rerank(spark, base):
    return rerank.rerank(candidates(spark, base), asking.retrieval_targets(questions(spark, base)).join(asked(spark, base), "qid"), 10)


DOCS = "dr as (select qid, doc_id, 12 - row_number() over (partition by qid order by round(s, 9) desc, doc_id) as doc_score from (select qid, doc_id, sum(1.0 / (60 + rank)) as s from l group by all) qualify row_number() over (partition by qid order by round(s, 9) desc, doc_id) <= 12)"


@query("r_document_first", f"""with {CANDIDATES}, {TARGETS}, {DOCS}, j0 as (select cd.*, must_terms as terms, coalesce(doc_score, 0) as ds, max(cd.score) over (partition by cd.qid) as top, lower(trim(section)) as key, list_filter(must_terms, lambda v: contains(text, v)) as found from cd join b4 using (qid) left join dr using (qid, doc_id)),
    j1 as (select *, len(found) as n, list_sum(list_transform(found, lambda v: greatest(length(v), 1) * case when regexp_matches(v, '[0-9]') then 1.2 when contains(v, '利润') then 1.1 when length(v) >= 4 then 1.4 else 1.0 end)) as q0 from j0),
    j2 as (select *, coalesce(q0, 0) as quality, case when n > 0 then least(n, 2) * greatest(score, 0) else 0 end as sup from j1),
    mx as (select qid, max(doc_score) as most from dr group by qid),
    j3 as (select *, max(quality) over (partition by qid) as best, sum(sup) over (partition by qid, doc_id, key) as ss, count_if(n > 0) over (partition by qid, doc_id, key) as sn, sum(sup) over (partition by qid, doc_id, page) as ps, count_if(n > 0) over (partition by qid, doc_id, page) as pn from j2 join mx using (qid)),
    z as (select qid, chunk_id, doc_id, rank, round(score / case when top = 0 then 1 else top end * quality / case when best = 0 then 1 else best end + ds / case when most = 0 then 1 else most end * 1.45 + case when n >= 2 then least(0.24, 0.06 * n) else 0 end + least(0.3, coalesce(list_sum(list_transform(found, lambda v: least(0.12, 0.015 * length(v)))), 0))
      + case when key <> '' then least(0.35, 0.06 * ss) else 0 end + case when key <> '' and n >= 2 and sn >= 2 then 0.1 else 0 end + case when page is not null and pn >= 2 then least(0.42, 0.08 * ps) else 0 end + case when page is not null and n >= 2 and pn >= 2 then 0.16 else 0 end
      + case when len(list_filter(terms, lambda v: regexp_matches(v, '^[0-9]{{4}}$') and contains(text, v))) > 0 then 0.16 else 0 end + case when regexp_matches(text, '持续推出实施|连续四年|回购计划|股份回购|回购注销|股权激励计划|维护公司市值稳定') then case when n >= 2 then 0.3 else 0.18 end else 0 end
      + case when regexp_matches(text, '[0-9]') then 0.05 else 0 end + case when chunk_type = 'table' or section = 'table' then 0.15 else 0 end - case when contains(text, '现金分红(含税)') or contains(text, '现金分红金额') or contains(text, '现金分红/归属于母公司所有者的净利润') or contains(text, '现金分红/归属于母公司股东的净利润') or contains(text, '归属于母公司所有者权益') then 0.28 else 0 end, 6) as score from j3)
    select qid, chunk_id, doc_id, score, place from (select *, row_number() over (partition by qid order by score desc, rank) as place from z) where place <= 10""")
def r_document_first(spark, base):
    from millrace.operators import lookup

    docs = lookup.documents_of_hits(claim_lists(spark, base), 12).select("qid", "doc_id", (12 - F.col("rank")).cast("double").alias("doc_score"))
    terms = asking.retrieval_targets(questions(spark, base)).select("qid", F.col("must_terms").alias("terms"))
    return rerank.document_first(candidates(spark, base), terms, docs, 10)


RULES = f"""ro as (select *, round(score + 0.1 * len(list_intersect(list_distinct({S.tokens('asked')}), {S.tokens('text')})) + case when clause_id <> '' then 2.0 else 0 end + 3.0 * len(list_intersect(list_distinct({nums('asked')}), numbers)) + 3.0 * len(list_intersect(list_distinct({days('asked')}), dates)), 6) as rule_score from cd join aq using (qid))"""


@query("r_rule_scores", f"with {CANDIDATES}, {ASKED}, {RULES} select qid, chunk_id, rule_score from ro")
def r_rule_scores(spark, base):
    return rerank.rule_scores(candidates(spark, base), asked(spark, base)).select("qid", "chunk_id", "rule_score")


def _fold(rows: str, keys: str, budget: int, most: int) -> str:
    """SQL that takes rows (keys, turn, chunk_id, n) in order, skipping what would go over the budget."""
    same = " and ".join(f"b.{k} = f.{k}" for k in keys.split(", "))
    fits = f"(f.n_taken = 0 or f.used + b.n <= {budget}) and f.n_taken < {most}"
    own = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""bd as materialized ({rows}), fd({keys}, turn, chunk_id, used, n_taken, taken) as (select {keys}, turn, chunk_id, n::bigint, 1, true from bd where turn = 1
      union all select {own}, b.turn, b.chunk_id, case when {fits} then f.used + b.n else f.used end, case when {fits} then f.n_taken + 1 else f.n_taken end, {fits} from fd f join bd b on {same} and b.turn = f.turn + 1)"""


@query("r_compress", f"""with recursive {CANDIDATES}, {ASKED}, {RULES}, sc as (select ro.*, coalesce(list_position(q.doc_ids, doc_id), 0) as pos, len(list_distinct(q.doc_ids)) > 1 as several, row_number() over (partition by ro.qid, doc_id order by rule_score desc, rank) as of_doc from ro join questions q using (qid) where trim(text) <> ''),
    {_fold("select qid, chunk_id, length(trim(text)) as n, row_number() over (partition by qid order by case when several and pos > 0 and of_doc = 1 then pos else 1000000 end, rule_score desc, rank) as turn from sc", "qid", 1200, 5)}
    select qid, chunk_id, row_number() over (partition by qid order by turn) - 1 as place from fd where taken""")
def r_compress(spark, base):
    scope = questions(spark, base).select("qid", "doc_ids")
    rows = rerank.rule_scores(candidates(spark, base), asked(spark, base)).filter("trim(text) <> ''")
    return ranking.compressed(rows, scope, 1200, 5)


CLAIMS = f"""{LISTS}, {ATTRIBUTES}, {EACH},
    vc as (select l.qid, l.list_id as option, l.chunk_id, l.doc_id, l.score, ca.text, ca.domain, ca.chunk_type, t.text as claim, t.claim_type, t.doc_ids as doc_scope, t.numbers as cn, t.dates as cdt, t.must_terms from l join ca using (chunk_id) join t on t.qid = l.qid and t.option = l.list_id)"""


def _flat(x: str) -> str:
    return rf"translate(regexp_replace({x}, '\s+', '', 'g'), '，％', ',%')"


_VALUES = ordered(rf"list_concat(list_concat(list_filter(cn, lambda v: not regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^(?:19|20)[0-9]{{2}}年?$')), list_filter(cdt, lambda v: not regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^(?:19|20)[0-9]{{2}}年?$'))), list_filter(list_transform(regexp_extract_all(claim, '[A-Za-z]+\+?'), lambda v: case when upper(v) = 'AAA+' then 'AAA' else upper(v) end), lambda v: v in ('AAA', 'AA', 'AA+', 'A', 'A+', 'BBB', 'BBB+')))")
_NARROW = "某一单个客户|单一客户|单个客户|地区信息|分部信息|分部间|分产品|分行业|分地区|母公司财务报表|母公司利润表|公司现金流量表"
SCORED = rf"""v1 as (select *, {_flat('text')} as flat, list_transform(must_terms, lambda v: {_flat('v')}) as pr, list_transform(({_VALUES})[1:8], lambda v: {_flat('v')}) as vs, list_transform(cn, lambda v: {_flat('v')}) as stated, max(abs(score)) over (partition by qid, option) as top from vc),
    v2 as (select *, len(list_filter(pr, lambda v: contains(flat, v))) as predicate_hits, len(list_filter(vs, lambda v: contains(flat, v))) as value_hits, list_distinct(list_filter(list_transform({nums('text')}, lambda v: {_flat('v')}), lambda v: not regexp_matches(v, '^(?:19|20)[0-9]{{2}}年?$') and not list_contains(stated, v))) as others from v1),
    v3 as (select *, case when predicate_hits > 0 and value_hits > 0 then 'support' when predicate_hits > 0 and len(others) > 0 then 'counter' else 'ground_truth' end as role, length(text) as n_chars from v2),
    v4 as (select *, round(score / case when top = 0 then 1 else top end + 1.45 * least(4, predicate_hits) + 0.55 * least(3, value_hits) + case when role = 'counter' then 0.85 else 0 end + case when chunk_type in ('table_row', 'financial_metric_row', 'layout_table_row', 'figure') then 0.75 else 0 end
      + case when domain = 'financial_reports' then case when regexp_matches(text, '合并利润表|合并现金流量表|主要会计数据') then 1.5 else 0 end - case when not regexp_matches(claim, '{_NARROW}') and regexp_matches(text, '{_NARROW}') then 3.0 else 0 end - case when contains(text, '分季度主要财务指标') and not contains(claim, '季度') then 2.5 else 0 end - case when regexp_matches(text, '在其他主体中的权益|子公司合并财务报表') then 3.0 else 0 end else 0 end
      + case when regexp_matches(text, '但|除外|仅限|不得|应当|未经|不包括|不适用') then 0.25 else 0 end - case when regexp_matches(text, '目 录|目录|风险提示及说明|释 义') then 1.5 else 0 end - case when n_chars > 700 then least(1.0, (n_chars - 700) / 1000) else 0 end, 6) as s from v3),
    vs as materialized (select qid, option, chunk_id, doc_id, role, predicate_hits, value_hits, s as score, n_chars, text, claim_type, doc_scope, row_number() over (partition by qid, option order by s desc, n_chars, chunk_id desc) as place from v4)"""


def verified(spark, base):
    rows = claim_lists(spark, base).withColumnRenamed("list_id", "option").join(attributes(spark, base).select("chunk_id", "domain", "text", "chunk_type"), "chunk_id")
    claims = asking.claim_targets(questions(spark, base)).withColumn("predicates", F.col("must_terms"))
    return rerank.verification_scores(rows, claims), claims


@query("r_verification_scores", f"with {CLAIMS}, {SCORED} select qid, option, chunk_id, role, predicate_hits, value_hits, score, place from vs")
def r_verification_scores(spark, base):
    return verified(spark, base)[0].select("qid", "option", "chunk_id", "role", "predicate_hits", "value_hits", "score", "place")


@query("r_verification_evidence", rf"""with recursive {CLAIMS}, {SCORED},
    w as (select *, coalesce(list_position(doc_scope, doc_id), 0) as pos, len(list_filter({nums('text')}, lambda v: not regexp_matches(regexp_replace({_flat('v')}, '年$', ''), '^(?:19|20)[0-9]{{2}}$'))) > 0 as counted from vs),
    o as (select *, row_number() over (partition by qid, option, doc_id order by place) as d, row_number() over (partition by qid, option, doc_id, counted order by place) as c, row_number() over (partition by qid, option, role order by place) as r from w),
    p as (select *, case when pos > 0 and d = 1 then 1000 + pos when pos > 0 and counted and c = 1 and claim_type in ('metric_fact', 'comparison', 'date_fact') then 2000 + pos when r = 1 then 3000 + case role when 'support' then 1 when 'counter' then 2 else 3 end else 4000 + place end as first from o),
    {_fold("select qid, option, chunk_id, n_chars as n, row_number() over (partition by qid, option order by first) as turn from p", "qid, option", 900, 4)}
    select qid, option, chunk_id, row_number() over (partition by qid, option order by turn) - 1 as place from fd where taken""")
def r_verification_evidence(spark, base):
    scored, claims = verified(spark, base)
    return ranking.within_budget_skip(rerank.verification_order(scored, claims), ["qid", "option"], "turn", "chunk_id", F.col("n_chars"), 900, 4)


_X = rf"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
# A digit behind a letter or digit starts no number: letter and digit are taken out first.
_MENTIONS = rf"list_filter(list_transform(regexp_extract_all(regexp_replace({_X}, '[A-Za-z][-+]?[0-9]+', '~', 'g'), '[-+]?[0-9][0-9,，]*(?:\.[0-9]+)?\s*(?:%|％|元|千元|万元|亿元|万|亿|倍)?'), lambda v: trim(v)), lambda v: not regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^(?:19|20)[0-9]{{2}}年?$'))"


def _met(tag: str, items: str) -> str:
    return f"list_transform(list_filter({items}, lambda v: v <> '' and contains(x, v)), lambda v: '{tag}' || v)"


@query("r_slots", f"""with {CANDIDATES}, {TARGETS}, tb as (select chunk_id, any_value(len(tables)) as n_tables from chunks group by 1),
    s as (select cd.qid, cd.chunk_id, cd.doc_id, cd.clause_id, cd.chunk_type, coalesce(n_tables, 0) as n_tables, {_X} as x, {_MENTIONS} as m, b4.must_terms[1:8] as mt, b4.numbers[1:4] as qn, b4.dates[1:4] as qd, b4.intent from cd join b4 using (qid) join tb using (chunk_id))
    select qid, chunk_id, array_to_string(list_sort(list_distinct(flatten([['doc:' || doc_id], {_met('term:', 'mt')}, {_met('number:', 'qn')}, {_met('date:', 'qd')}, case when len(m) > 0 then ['fact:numeric_value'] else [] end, case when intent = 'comparison' and len(list_distinct(m)) >= 2 then ['fact:comparison_endpoints'] else [] end,
      case when regexp_matches(x, '处罚|罚款|扣减|减分|责令|不得|应当|期限|赔付|免责') then ['fact:consequence'] else [] end, case when regexp_matches(x, '营业收入|净利润|现金流|分红|每股|资产负债率|保费|赔付') then ['fact:metric_block'] else [] end, case when coalesce(chunk_type in ('table', 'figure'), false) or n_tables > 0 then ['fact:structured_block'] else [] end]))), '|') as slots,
      round(case when clause_id <> '' then 0.2 else 0 end + case when intent in ('number', 'comparison') and (coalesce(chunk_type in ('table', 'figure'), false) or regexp_matches(x, '营业收入|净利润|现金流|分红|每股|资产负债率|保费|赔付')) then 0.3 else 0 end + case when regexp_matches(x, '处罚|罚款|扣减|减分|责令|不得|应当|期限|赔付|免责') then 0.2 else 0 end, 2) as bonus from s""")
def r_slots(spark, base):
    return slotted(spark, base).select("qid", "chunk_id", F.array_join(F.array_sort("slots"), "|").alias("slots"), "bonus")


def slotted(spark, base):
    rows = candidates(spark, base).join(table(spark, base, "chunks", "chunk_id", "tables").dropDuplicates(["chunk_id"]), "chunk_id")
    return evidence.covered_slots(rows.drop("numbers", "dates"), asking.retrieval_targets(questions(spark, base)))


@query("r_select_evidence")
def r_select_evidence(spark, base):
    targets = asking.retrieval_targets(questions(spark, base)).join(questions(spark, base).select("qid", F.coalesce("question", F.lit("")).alias("stem")), "qid")
    return evidence.select_evidence(slotted(spark, base).join(asking.required_slots(targets).select("qid", "required"), "qid"), 4, 1500)
