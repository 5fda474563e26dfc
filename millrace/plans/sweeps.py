"""Queries: sweeps of documents, the context around them, sufficiency of evidence, excerpts of parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import asking, lookup, sweeps
from millrace.plans.asking import EACH, TARGETS
from millrace.plans.registry import query
from millrace.plans.rerank import CANDIDATES, _flat, candidates
from millrace.plans.retrieval import questions
from millrace.sources.tables import table

_YEAR = r"regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^(?:19|20)[0-9]{2}年?$')"


def _n(items: str) -> str:
    return f"len(list_filter({items}, lambda v: contains(x, v)))"


SWEEP = f"""{EACH}, sc as (select qid, option, unnest(list_distinct(doc_ids)) as doc_id, list_transform(list_filter(numbers, lambda v: not {_YEAR}), lambda v: {_flat('v')}) as n, list_transform(list_filter(dates, lambda v: length({_flat('v')}) > 4), lambda v: {_flat('v')}) as d, list_transform(list_filter(numbers, lambda v: {_YEAR}), lambda v: {_flat('v')}) as y, list_transform(must_terms, lambda v: {_flat('v')}) as m from t),
    sk as (select chunk_id, any_value(doc_id) as doc_id, any_value({_flat('text')}) as x, any_value(metadata['chunk_type']) as kind from chunks group by chunk_id),
    sh as (select qid, option, doc_id, chunk_id, kind, {_n('n')} as a, {_n('d')} as b, {_n('y')} as c, {_n('m')} as e from sc join sk using (doc_id) where x <> ''),
    sp as (select *, round(4.0 * a + 3.0 * b + 0.5 * least(1, c) + e + case when kind in ('table', 'financial_metric_row') then 0.8 else 0 end, 6)::double as points from sh where a > 0 or b > 0 or e >= 2),
    sw as materialized (select *, round(0.25 + 0.01 * least(points, 10), 6) as score from (select qid, option, doc_id, chunk_id, points, row_number() over (partition by qid, option, doc_id order by points desc, chunk_id) as place from sp) where place <= 8)"""


def swept(spark, base):
    rows = table(spark, base, "chunks").select("chunk_id", "doc_id", "text", F.col("metadata")["chunk_type"].alias("chunk_type")).dropDuplicates(["chunk_id"])
    return sweeps.document_sweep(asking.claim_targets(questions(spark, base)).withColumn("terms", F.col("must_terms")), rows)


@query("j_document_sweep", f"with {SWEEP} select qid, option, doc_id, chunk_id, points, score, place from sw")
def j_document_sweep(spark, base):
    return swept(spark, base)


@query("j_sweep_context", f"""with {SWEEP}, s as (select doc_id, chunk_id, page, row_number() over (partition by doc_id order by chunk_id) - 1 as seq from (select distinct doc_id, chunk_id, page from chunks)),
    b as (select sw.qid, sw.option, sw.doc_id, page, seq, greatest(0.01, score * 0.9) as sc from sw join s using (chunk_id) where place <= 2),
    u as (select qid, option, s.chunk_id, sc from b join s on s.doc_id = b.doc_id and s.page = b.page union all select qid, option, s.chunk_id, sc from b join s on s.doc_id = b.doc_id and abs(s.seq - b.seq) <= 1)
    select qid, option, chunk_id, round(max(sc), 6) as score from u group by all""")
def j_sweep_context(spark, base):
    placed = lookup.with_sequence(table(spark, base, "chunks", "doc_id", "chunk_id", "page").distinct())
    return sweeps.around(swept(spark, base), placed)


_SOME = "len(list_filter(texts, lambda v: regexp_matches(v, '{}'))) > 0"
_SPEC, _CONS, _GEN = "营业收入|净利润|现金流|分红|日期|发行公告|罚款|扣减|减分|责令|期限", "处罚|罚款|扣减|减分|责令|不得|期限", "审计报告|公允反映|坚持依法合规|客观公正|原则|财务报表"


def _found(items: str) -> str:
    return f"list_filter({items}, lambda w: len(list_filter(texts, lambda v: contains(v, w))) > 0)"


@query("v_sufficiency", rf"""with {CANDIDATES}, {TARGETS}, tx as (select qid, list(trim(regexp_replace(text, '\s+', ' ', 'g'))) as texts from cd where rank <= 4 and trim(text) <> '' group by qid),
    a as (select qid, stem, intent, numbers, dates, e[1:12] as entities, must_terms, coalesce(texts, []) as texts from b4 left join tx using (qid)),
    f as (select *, {_found('numbers')} as fn, {_found('dates')} as fd, {_found('entities')} as fe, {_found('must_terms')} as ft, intent = 'comparison' as cmp from a),
    g as (select *, len(numbers) + len(dates) as nl, len(fn) + len(fd) as fl, len(texts) = 0 or (not {_SOME.format(_SPEC)} and not {_SOME.format(_CONS)} and {_SOME.format(_GEN)}) as general, regexp_matches(stem, '处罚|扣减|减分|期限') and not {_SOME.format(_CONS)} as cq, intent in ('comparison', 'number') and len(fn) < len(numbers) as nn from f),
    h as (select *, cmp and ((nl >= 2 and fl < 2) or (nl = 1 and fl < 1)) as op from g),
    kk as (select *, not op and not general and not cq and not nn and not (cmp and len(entities) > 0 and len(fe) < least(2, len(entities))) as ok, list_filter([case when op and nl >= 2 then 'missing_second_endpoint' end, case when op and nl = 1 then 'missing_numeric_value' end, case when general then 'generic_context_only' end, case when cq then 'missing_clause_consequence' end, case when nn and not (op and nl = 1) then 'missing_numeric_value' end], lambda v: v is not null) as tags from h)
    select qid, ok as sufficient, array_to_string(tags, '|') as failure_tags, round(case when cmp and nl >= 2 then least(1.0, fl / nl) when cmp and nl = 1 and fl < 1 then 0 else 1 end, 6)::double as closure,
      round(case when len(texts) = 0 then 0 else least(1.0, list_sum(list_transform(texts, lambda v: case when regexp_matches(v, '{_SPEC}') then case when regexp_matches(v, '[0-9]') then 0.75 else 0.4 end else 0 end + case when regexp_matches(v, '{_CONS}') then 0.35 else 0 end)) / len(texts)) end, 6)::double as density,
      array_to_string(list_filter(numbers, lambda v: not list_contains(fn, v)), '|') as missing_numbers, array_to_string(list_filter(must_terms, lambda v: not list_contains(ft, v)), '|') as missing_terms,
      case when ok then null else list_filter(['missing_metric_value_pair', 'same_doc_wrong_clause', 'missing_clause_consequence', 'generic_context_only', 'missing_second_endpoint'], lambda v: list_contains(tags, v))[1] end as mend from kk""")
def v_sufficiency(spark, base):
    targets = asking.retrieval_targets(questions(spark, base)).join(questions(spark, base).select("qid", F.coalesce("question", F.lit("")).alias("stem")), "qid")
    out = sweeps.sufficiency(targets, candidates(spark, base).filter("rank <= 4").select("qid", "text"))
    return out.select("qid", "sufficient", "closure", "density", "mend", *[F.array_join(c, "|").alias(c) for c in ("failure_tags", "missing_numbers", "missing_terms")])


@query("j_parent_excerpts", r"""with c as (select chunk_id, any_value(doc_id) as doc_id, any_value(text) as child from chunks where text <> '' group by chunk_id), p as (select chunk_id, child, raw_text as parent from c join raw_documents using (doc_id) where raw_text is not null),
    s as (select *, strpos(parent, child) - 1 as ex, regexp_replace(parent, '\s+', '', 'g') as bare, left(regexp_replace(child, '\s+', '', 'g'), 24) as anchor from p),
    z as (select *, case when ex >= 0 then ex when anchor <> '' and strpos(bare, anchor) > 0 then floor((strpos(bare, anchor) - 1) / greatest(1, length(bare)) * length(parent)) end as st from s)
    select chunk_id, md5(case when st is null then child else substring(parent, greatest(0, st - 240)::bigint + 1, 720) end) as md5 from z""")
def j_parent_excerpts(spark, base):
    rows = table(spark, base, "chunks", "chunk_id", "doc_id", "text").filter("text <> ''").dropDuplicates(["chunk_id"])
    rows = rows.join(table(spark, base, "raw_documents", "doc_id", "raw_text").filter("raw_text is not null"), "doc_id")
    return rows.select("chunk_id", F.md5(sweeps.excerpt(F.col("raw_text"), F.col("text"))).alias("md5"))
