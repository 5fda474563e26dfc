"""Queries: contracts, calibrated relations, claim sets, and small rules of questions, titles and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import verdicts
from millrace.plans.registry import query
from millrace.plans.rerank import CLAIMS, SCORED, verified
from millrace.plans.asking import nums
from millrace.plans.retrieval import questions
from millrace.sources.tables import table

_ANY = "coalesce(list_filter({}, lambda d: list_contains(coalesce({}, []), d)), [])"


@query("v_evidence_contracts", rf"""with {CLAIMS}, {SCORED}, ev as (select vs.*, t.must_terms, len(list_filter({nums('vs.text')}, lambda v: t.claim_type = 'date_fact' or not regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^(?:19|20)[0-9]{{2}}年?$'))) > 0 as hn, len(list_filter(t.must_terms, lambda p: contains(vs.text, p))) > 0 as hp from vs join t using (qid, option) where place <= 4),
    se as (select qid, option, list(distinct doc_id) as o, list(distinct case when hp then doc_id end) as p, list(distinct case when hn then doc_id end) as n, count_if(role = 'support') as n_support, count_if(role = 'counter') as n_counter, count_if(role = 'ground_truth') as n_ground_truth from ev group by all),
    b as (select t.*, coalesce(n_support, 0) as n_support, coalesce(n_counter, 0) as n_counter, coalesce(n_ground_truth, 0) as n_ground_truth, t.claim_type in ('metric_fact', 'comparison', 'date_fact') as counted, {_ANY.format('t.doc_ids', 'o')} as observed, {_ANY.format('t.doc_ids', 'p')} as pd, {_ANY.format('t.doc_ids', 'n')} as nd from t left join se using (qid, option)),
    r as (select *, concat_ws(' ', stem, text) as st, len(observed) < len(doc_ids) or len(pd) < len(doc_ids) or (counted and len(nd) < len(doc_ids)) as hard from b),
    g as (select *, list_filter([case when len(doc_ids) > 1 and regexp_matches(st, '均|全部|所有|两份|各自|分别|同时') then 'universal_scope' end, case when regexp_matches(st, '高于|低于|超过|少于|早于|晚于|一致|不一致|同比') then 'comparison' end, case when regexp_matches(st, '未提及|未披露|未说明|没有|无任何|未出现|均未|不包含|不涵盖|不赔|无免赔额') then 'absence_claim' end,
      case when regexp_matches(text, '不得|不能|不可以|不属于|不包括|除外|无需|无权') then 'negative_claim' end, case when regexp_matches(text, '且|并且|以及|同时|分别|；|;') then 'compound_claim' end, case when n_support > 0 and n_counter > 0 then 'evidence_conflict' end], lambda x: x is not null) as risks from r)
    select qid, option, array_to_string(observed, '|') as observed, array_to_string(pd, '|') as predicate_docs, array_to_string(nd, '|') as numeric_docs, n_support, n_counter, n_ground_truth, array_to_string(risks, '|') as risks, round((len(observed) + len(pd) + case when counted then len(nd) else 0 end) / greatest(len(doc_ids) * case when counted then 3 else 2 end, 1), 6) as coverage,
      not hard as ready, hard or list_contains(risks, 'absence_claim') or list_contains(risks, 'evidence_conflict') as needs_review from g""")
def v_evidence_contracts(spark, base):
    scored, claims = verified(spark, base)
    out = verdicts.contracts(claims, scored.filter("place <= 4"))
    return out.select("qid", "option", *[F.array_join(c, "|").alias(c) for c in ("observed", "predicate_docs", "numeric_docs", "risks")], "n_support", "n_counter", "n_ground_truth", "coverage", "ready", "needs_review")


# Judged relations as the claims' own columns give them: citations by their numbers, evidence by their sources.
JUDGED = """jd as (select qid, option, any_value(text) as text, case any_value(selected) when true then 'support' when false then 'refute' else 'unknown' end as relation, least(any_value(len(numbers)) * 0.4, 1.2)::double as confidence, list_transform(range(1, any_value(len(numbers)) + 1), lambda i: '[' || i || ']') as sr,
      case when any_value(len(qualifiers)) > 1 then ['[1]', 'x', '[7]'] else [] end as rr, any_value(source_doc_ids) as ed, case when any_value(len(numbers)) = 1 then ['fact:numeric_value'] else ['term:x'] end as missing, any_value(doc_ids) as scope, any_value(coalesce(source_scoped, false)) as sufficient from claim_records group by qid, option)"""


def judged(spark, base):
    n = F.size("numbers")
    relation = F.when(F.col("selected"), "support").when(~F.col("selected"), "refute").otherwise("unknown")
    refs = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("["), i, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, base, "claim_records").dropDuplicates(["qid", "option"])
    return rows.select("qid", "option", "text", relation.alias("relation"), F.least(n * 0.4, F.lit(1.2)).alias("confidence"), refs.alias("support_refs"), F.when(F.size("qualifiers") > 1, F.array(*map(F.lit, ("[1]", "x", "[7]")))).otherwise(F.array().cast("array<string>")).alias("refute_refs"), F.col("source_doc_ids").alias("evidence_docs"), F.when(n == 1, F.array(F.lit("fact:numeric_value"))).otherwise(F.array(F.lit("term:x"))).alias("missing_slots"), F.col("doc_ids").alias("doc_scope"), F.coalesce("source_scoped", F.lit(False)).alias("sufficient"))


CALIBRATED = """k0 as (select *, list_distinct(list_filter(list_transform(sr, lambda x: try_cast(nullif(regexp_extract(x, '[0-9]+'), '') as int)), lambda v: v between 1 and len(ed))) as s, list_distinct(list_filter(list_transform(rr, lambda x: try_cast(nullif(regexp_extract(x, '[0-9]+'), '') as int)), lambda v: v between 1 and len(ed))) as r from jd),
    k1 as (select *, len(s) > 0 and len(r) > 0 as conflict, case when relation in ('support', 'refute') then relation else 'insufficient' end as r0 from k0),
    k2 as (select *, case when conflict then 'insufficient' else r0 end as r1, case when conflict then least(confidence, 0.45) else confidence end as c1 from k1),
    k3 as (select *, (r1 = 'support' and len(s) = 0) or (r1 = 'refute' and len(r) = 0) as uncited from k2),
    k4 as (select *, case when uncited then 'insufficient' else r1 end as r2, case when uncited then least(c1, 0.35) else c1 end as c2 from k3),
    k5 as (select *, r2 = 'support' and len(list_filter(missing, lambda x: regexp_matches(x, '^fact:(?:numeric_value|comparison_endpoints|consequence)'))) > 0 as critical from k4),
    k6 as (select *, case when critical then 'insufficient' else r2 end as r3, case when critical then least(c2, 0.4) else c2 end as c3 from k5),
    k7 as (select *, r3 = 'support' and regexp_matches(text, '均|都|双方|两份|两家|各自|所有|分别') and len(scope) > 1 and len(list_filter(scope, lambda d: not list_contains(list_transform(s, lambda i: ed[i]), d))) > 0 as partial from k6),
    ka as materialized (select *, case when partial then 'insufficient' else r3 end as final, greatest(0.0, least(1.0, case when partial then least(c3, 0.4) else c3 end)) as c4, list_filter([case when len(sr) > len(s) then 'invalid_support_citation' end, case when len(rr) > len(r) then 'invalid_refute_citation' end, case when conflict then 'support_refute_conflict' end, case when uncited then 'missing_relation_citation' end,
      case when critical then 'critical_evidence_slot_missing' end, case when partial then 'universal_claim_missing_doc_support' end], lambda x: x is not null) as tags from k7)"""


@query("v_calibrated", f"with {JUDGED}, {CALIBRATED} select qid, option, final as relation, round(c4, 4) as confidence, array_to_string(list_transform(list_sort(s), lambda x: x::varchar), '|') as support, array_to_string(list_transform(list_sort(r), lambda x: x::varchar), '|') as refute, array_to_string(tags, '|') as tags from ka")
def v_calibrated(spark, base):
    out = verdicts.calibrated(judged(spark, base))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), "|")
    return out.select("qid", "option", "relation", F.round("confidence", 4).alias("confidence"), text("support").alias("support"), text("refute").alias("refute"), F.array_join("tags", "|").alias("tags"))


@query("v_claim_sets", f"""with {JUDGED}, {CALIBRATED}, a as (select qid, list_sort(list(option) filter (final = 'support')) as sp, list_sort(list(option) filter (final = 'refute')) as rf, list_sort(list(option) filter (final = 'insufficient')) as ins, arg_min(option, case when final = 'support' then round(-c4 * 1000000) * 1000 + ascii(option) end) as bs, arg_min(option, case when final = 'insufficient' then round(-c4 * 1000000) * 1000 + ascii(option) end) as bi from ka group by qid),
    b as (select qid, coalesce(sp, []) as sp, coalesce(rf, []) as rf, coalesce(ins, []) as ins, bs, bi, answer_format = 'multi' as multi, array_to_string(map_values(options), ' ') as ot from a join questions using (qid))
    select qid, case when multi then array_to_string(sp, '') else coalesce(bs, bi, '') end as answer, array_to_string(sp, '') as supported, array_to_string(rf, '') as refuted, array_to_string(ins, '') as insufficient, not multi and len(sp) > 1 as several_supported, multi and len(sp) = 0 as none_supported,
      multi or len(ins) > 0 or len(sp) <> 1 or regexp_matches(ot, '均|都|双方|两份|两家|各自|所有|分别|并且|同时|以及|且|；|;|高于|低于|超过|不超过|同比|环比|比例|占比|%|％|倍') as verify from b""")
def v_claim_sets(spark, base):
    out = verdicts.claim_sets(verdicts.calibrated(judged(spark, base)), questions(spark, base))
    return out.select("qid", "answer", *[F.array_join(c, "").alias(c) for c in ("supported", "refuted", "insufficient")], "several_supported", "none_supported", "verify")


@query("v_risk_scores", f"""with {JUDGED}, {CALIBRATED} select qid, option, not sufficient or final = 'insufficient' or c4 < 0.6 as refine, round(case when final <> r0 then 3 else 0 end + least(6, 1.5 * len(tags)) + coalesce(list_sum(list_transform(list_concat(tags, case when regexp_matches(text, '不得') then ['negative_claim'] else ['comparison'] end), lambda x: case x when 'negative_claim' then 1.0 when 'comparison' then 1.0 else 0.5 end)), 0) + case when conflict then 2 else 0 end + case when c4 < 0.6 then 1 else 0 end, 3) as risk from ka""")
def v_risk_scores(spark, base):
    rows = judged(spark, base).join(verdicts.calibrated(judged(spark, base)).withColumnRenamed("relation", "final").withColumnRenamed("confidence", "c"), ["qid", "option"])
    tags = F.concat("tags", F.when(F.col("text").rlike("不得"), F.array(F.lit("negative_claim"))).otherwise(F.array(F.lit("comparison"))))
    before = F.when(F.col("relation").isin("support", "refute"), F.col("relation")).otherwise("insufficient")
    return rows.select("qid", "option", verdicts.should_refine(F.col("sufficient"), F.col("final"), F.col("c"), 0.6).alias("refine"), verdicts.risk_score(F.col("final") != before, F.size("tags"), tags, F.array_contains("tags", "support_refute_conflict"), F.col("c")).alias("risk"))


@query("q_focus", """with q as (select qid, regexp_replace(coalesce(question, ''), '\\s+', '', 'g') as f from questions), b as (select qid, f, regexp_replace(regexp_replace(regexp_replace(f, '^(?:根据|依据|结合).{0,80}?(?:，|,)', ''), '(?:下列|以下)(?:说法|表述|选项)?(?:中)?(?:哪些|哪项|哪一项)?', '', 'g'), '(?:正确|错误|不正确|符合|不符合)(?:的|的是)?[？?]?$', '') as x from q)
    select qid, coalesce(nullif(regexp_replace(x, '^[，,：:；;？? ]+|[，,：:；;？? ]+$', '', 'g'), ''), f) as focus, regexp_matches(f, '(?:哪些|哪项|哪一项).{0,36}(?:需要|应当|可以|能够|属于|满足|适用|赔付|审批)|(?:需要|应当|可以|能够|属于|满足|适用|赔付|审批).{0,36}(?:哪些|哪项|情形|产品)') as scope_gate from b""")
def q_focus(spark, base):
    return questions(spark, base).select("qid", verdicts.focus(F.col("question")).alias("focus"), verdicts.scope_gate(F.col("question")).alias("scope_gate"))


_END = "(?:集团股份有限公司|股份有限公司|集团有限公司|有限公司|集团)"


@query("t_titles", f"""select doc_id, array_to_string(list_distinct(list_transform(regexp_extract_all(coalesce(title, ''), '[一-鿿A-Za-z]+{_END}'), lambda x: regexp_replace(x, '(.){_END}$', '\\1'))), '|') as companies, case domain when 'financial_reports' then 'entity|year|metric|unit' when 'insurance' then 'product|insurance_responsibility|exclusion' when 'regulatory' then 'law_article|case_or_penalty' when 'financial_contracts' then 'issuer|amount_or_term|rating_or_intermediary' when 'research' then 'entity|claim|metric_or_ranking' else '' end as facets from raw_documents""")
def t_titles(spark, base):
    return table(spark, base, "raw_documents", "doc_id", "title", "domain").select("doc_id", F.array_join(verdicts.company_terms(F.col("title")), "|").alias("companies"), F.array_join(verdicts.facets(F.col("domain")), "|").alias("facets"))


@query("t_match_text", """select distinct chunk_id, md5(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\s+', '', 'g'), '，', ','), '([0-9]),([0-9])', '\\1' || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || '\\2', 'g')) as md5 from chunks""")
def t_match_text(spark, base):
    return table(spark, base, "chunks", "chunk_id", "text").distinct().select("chunk_id", F.md5(verdicts.match_text(F.col("text"))).alias("md5"))


_FLAT = "trim(regexp_replace(translate(raw_value, '０１２３４５６７８９', '0123456789'), '[,，]', '', 'g'))"


@query("n_safe_decimal", f"""select distinct fact_id, round((try_cast(regexp_replace(regexp_replace({_FLAT}, '[亿万]$', ''), '[元%％]', '', 'g') as decimal(28,6)) * case when ends_with({_FLAT}, '亿') then 100000000 when ends_with({_FLAT}, '万') then 10000 else 1 end)::double, 4) as value from numeric_facts""")
def n_safe_decimal(spark, base):
    return table(spark, base, "numeric_facts", "fact_id", "raw_value").distinct().select("fact_id", F.round(verdicts.safe_decimal(F.col("raw_value")).cast("double"), 4).alias("value"))


@query("a_inferred", """select distinct o_orderkey % 101 as n, o_custkey * 50000 as tokens, arg_min(k, round(abs(100.0 * k / 100 * (0.7 + 0.3 * case when o_custkey * 50000 <= 0 then 0 else greatest(0, least(1, (5000000 - o_custkey * 50000) / 5000000)) end) - (o_orderkey % 101) * 0.9), 9) * 1000 - k * 0.000001) as correct from orders, range(0, 101) r(k) group by all""")
def a_inferred(spark, base):
    rows = table(spark, base, "orders", "o_orderkey", "o_custkey").select((F.col("o_orderkey") % 101).alias("n"), (F.col("o_custkey") * 50000).alias("tokens")).distinct()
    return rows.select("n", "tokens", verdicts.inferred_correct(F.col("n") * 0.9, F.lit(100), F.col("tokens")).alias("correct"))


@query("a_normalized_answers", "select qid, case when answer_format = 'multi' then array_to_string(list_sort(list_distinct(regexp_extract_all(upper(question || ' dcbaXb'), '[A-D]'))), '') else coalesce(regexp_extract_all(upper(question || ' dcbaXb'), '[A-D]')[1], '') end as answer from questions")
def a_normalized_answers(spark, base):
    return questions(spark, base).select("qid", verdicts.normalized_answer(F.concat("question", F.lit(" dcbaXb")), F.col("answer_format")).alias("answer"))
