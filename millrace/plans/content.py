"""Queries: text functions, chunking, tables, claims, facts, merges, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, evidence, facts, judge, lookup, metrics, planning, quantities, ranking
from millrace.plans import sqltext as S
from millrace.plans.registry import query
from millrace.sources import formats
from millrace.sources.tables import table
from millrace.streaming import incremental


def joined(c) -> F.Column:
    return F.array_join(c, "|")


NUM, DATE = T.NUMBER, T.DATE


@query("t_numbers_dates", f"select distinct chunk_id, array_to_string(list_transform(regexp_extract_all(text, '({NUM})', 1), lambda x: trim(x)), '|') as numbers, array_to_string(regexp_extract_all(text, '({DATE})', 1), '|') as dates from chunks")
def t_numbers_dates(spark, base):
    return table(spark, base, "chunks", "chunk_id", "text").distinct().select("chunk_id", joined(T.numbers(F.col("text"))).alias("numbers"), joined(T.dates(F.col("text"))).alias("dates"))


@query("t_clause_section", """select distinct doc_id, regexp_extract(raw_text, '(?m)(第[一二三四五六七八九十百千万0-9]+[章节条]|^[0-9]+(?:\\.[0-9]+)+)', 1) as clause_id,
    coalesce(list_filter(list_transform(string_split(raw_text, chr(10))[1:5], lambda x: trim(x)), lambda x: regexp_matches(x, '^(?:第[一二三四五六七八九十百千万0-9]+[章节]|[一二三四五六七八九十]+、|[0-9]+(?:\\.[0-9]+)*\\s+).{0,80}$'))[1], '') as section from raw_documents""")
def t_clause_section(spark, base):
    return table(spark, base, "raw_documents", "doc_id", "raw_text").select("doc_id", T.clause_of(F.col("raw_text")).alias("clause_id"), T.section_of(F.col("raw_text")).alias("section"))


@query("t_chunk_keys", "select distinct chunk_id, concat_ws(':', left(sha1(doc_id), 8), 'p' || coalesce(page::varchar, 'na'), '0', left(sha1(text), 10)) as key from chunks")
def t_chunk_keys(spark, base):
    return table(spark, base, "chunks", "chunk_id", "doc_id", "page", "text").distinct().select("chunk_id", T.chunk_key(F.col("doc_id"), F.col("page"), F.lit(0), F.col("text")).alias("key"))


@query("t_slugs", "select doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'run') as slug from raw_documents")
def t_slugs(spark, base):
    return table(spark, base, "raw_documents", "doc_id", "path").select("doc_id", T.slug(F.col("path")).alias("slug"))


@query("t_bigrams", f"select distinct qid, option, len(list_distinct({S.grams('normalized_text', 2, 2)})) as n_pairs from claim_records")
def t_bigrams(spark, base):
    return table(spark, base, "claim_records", "qid", "option", "normalized_text").distinct().select("qid", "option", F.size(F.array_distinct(T.char_ngrams(F.col("normalized_text"), 2, 2))).alias("n_pairs"))


_FLAT = S.narrow("text")
_FORM = rf"regexp_replace(regexp_replace(regexp_replace(lower({_FLAT}), 'q1[-–]3', '前三季度', 'g'), '同比增速', '同比', 'g'), '[\s，。；：、？！,!?;:（）()【】\[\]《》“”\"''·—\-_/]+', '', 'g')"
_DOTS = rf"replace(replace(regexp_replace(regexp_replace({_FORM}, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '.', ''), chr(1), '.')"
_LABELS = [("non_major", "非重大差异"), ("major", "重大差异"), ("manual", "手动"), ("automatic", "自动"), ("down", "负增长|下降|下滑|回落"), ("up", "正增长|增长|提升|上升"), ("before", "早于"), ("after", "晚于"), ("higher", "高于|高出|超过"), ("lower", "低于|低出|不足"), ("usd", "美元"), ("eur", "欧元"), ("cny", "人民币"), ("not_eligible", "不具备|不符合"), ("eligible", "具备|符合"), ("only", "仅|只保障|只包括"), ("rating_aaa", "aaa"), ("rating_aa_plus", "aa[+]")]
_QUALIFIERS = "list_filter([" + ", ".join(f"case when regexp_matches(f, '{pattern}') then '{label}' end" for label, pattern in _LABELS) + "], lambda x: x is not null)"


# A digit behind a letter is no start of a number, so letter and digit are taken out first; decimal points are kept as marks.
@query("t_claim_signature", rf"""with c as (select distinct qid, option, {_FLAT} as t, {_DOTS} as f from claim_records), g as (select *, {_QUALIFIERS} as labels from c)
    select qid, option, array_to_string(list_sort(list_concat(list_transform(regexp_extract_all(regexp_replace(t, '[A-Za-z][0-9]', '~', 'g'), '[0-9]+(?:\.[0-9]+)?\s*(?:万亿元|亿元人民币|亿美元|亿欧元|亿元|万元|个百分点|个工作日|个自然日|个月|倍|元|年|日|%)?'), lambda x: regexp_replace(x, '\s+', '', 'g')), regexp_extract_all(t, '[一二三四五六七八九十百千万两]+(?:个工作日|个自然日|个月|万元|年|日|倍)'))), '|') as numbers,
    array_to_string(list_filter(labels, lambda x: not (x = 'major' and list_contains(labels, 'non_major')) and not (x = 'rating_aaa' and list_contains(labels, 'rating_aa_plus'))), '|') as qualifiers, md5(f) as normalized_md5 from g""")
def t_claim_signature(spark, base):
    c = table(spark, base, "claim_records", "qid", "option", "text").distinct()
    c = c.withColumn("flat", T.nfkc("text")).withColumn("normal", evidence.normalize_claim(F.col("flat")))
    return c.select("qid", "option", joined(evidence.numeric_signature(F.col("flat"))).alias("numbers"), joined(evidence.qualifier_signature(F.col("normal"))).alias("qualifiers"), F.md5("normal").alias("normalized_md5"))


@query("t_top_lines", """with l as (select trim(unnest(string_split(text, chr(10)))) as line from (select distinct doc_id, page, text from page_texts)) select line, n from (select line, count(*) as n, row_number() over (order by count(*) desc, line) as r from l where line <> '' group by line) where r <= 15""")
def t_top_lines(spark, base):
    lines = chunking.document_lines(table(spark, base, "page_texts", "doc_id", "page", "text").distinct()).select(F.trim("line").alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "line").limit(15)


@query("t_page_summary", "select parser_name, count(*) as n_pages, count_if(length(text) < 200) as n_low, sum(len(tables)) as n_tables, sum(len(figures)) as n_figures, sum(length(text)) as n_chars from (select distinct doc_id, page, text, parser_name, tables, figures from page_texts) group by parser_name")
def t_page_summary(spark, base):
    p = table(spark, base, "page_texts", "doc_id", "page", "text", "parser_name", "tables", "figures").distinct()
    return p.groupBy("parser_name").agg(F.count("*").alias("n_pages"), F.count_if(F.length("text") < 200).alias("n_low"), F.sum(F.size("tables")).alias("n_tables"), F.sum(F.size("figures")).alias("n_figures"), F.sum(F.length("text")).alias("n_chars"))


@query("p_sentences", "with s as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(raw_text, '([。！？；;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from raw_documents) select doc_id, len(p) as n, md5(array_to_string(p, '|')) as md5 from s")
def p_sentences(spark, base):
    s = table(spark, base, "raw_documents", "doc_id", "raw_text").select("doc_id", chunking.sentences(F.col("raw_text")).alias("p"))
    return s.select("doc_id", F.size("p").alias("n"), F.md5(joined("p")).alias("md5"))


@query("p_paragraphs", """with a as (select doc_id, list_filter(list_transform(string_split_regex(markdown, '\\n{2,}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p, list_filter(list_transform(string_split_regex(regexp_replace(markdown, '([。！？；;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from docling_bundles)
    select doc_id, len(case when len(p) > 1 then p else s end) as n, md5(array_to_string(case when len(p) > 1 then p else s end, '|')) as md5 from a""")
def p_paragraphs(spark, base):
    s = table(spark, base, "docling_bundles", "doc_id", "markdown").select("doc_id", chunking.paragraphs(F.col("markdown")).alias("p"))
    return s.select("doc_id", F.size("p").alias("n"), F.md5(joined("p")).alias("md5"))


@query("p_chunk_pages")
def p_chunk_pages(spark, base):
    pages = table(spark, base, "page_texts", "doc_id", "page", "text", "tables", "figures").dropDuplicates(["doc_id", "page", "text"])
    domains = table(spark, base, "raw_documents", "doc_id", "domain")
    return chunking.chunk_pages(pages.join(domains, "doc_id"), 600).select("chunk_id", "doc_id", "page", "idx", "chunk_type", "section", "clause_id", F.length("text").alias("n_chars"))


@query("p_table_rows", """with r as (select table_id, caption, unit, header, unnest(rows) as cells, generate_subscripts(rows, 1) - 1 as row_no from layout_tables), j as (select table_id, row_no, caption, unit, array_to_string(list_transform(header, lambda c: coalesce(c, '')), ' | ') as h, array_to_string(list_transform(cells, lambda c: coalesce(c, '')), ' | ') as c from r)
    select table_id, row_no, md5(concat_ws(chr(10), nullif(caption, ''), '单位：' || nullif(unit, ''), h, c)) as text_md5 from j where h is distinct from c""")
def p_table_rows(spark, base):
    return chunking.table_row_texts(table(spark, base, "layout_tables")).select("table_id", F.col("row_no").cast("long").alias("row_no"), F.md5("text").alias("text_md5"))


@query("p_header_guess", "select table_id, array_to_string(list_transform(rows[1], lambda c: coalesce(c, '')), '|') as header from layout_tables where len(list_filter(rows[1], lambda c: regexp_matches(coalesce(c, ''), '^[-+(（]?[0-9][0-9,.]*[%％)）]?$'))) * 2 < len(rows[1])")
def p_header_guess(spark, base):
    out = table(spark, base, "layout_tables", "table_id", "rows").withColumn("h", chunking.header_guess(F.col("rows"))).filter("h is not null")
    return out.select("table_id", joined(F.transform("h", lambda c: F.coalesce(c, F.lit("")))).alias("header"))


@query("p_clean_lines", """select doc_id, page, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: translate(x, '□☑√■☐', '')), lambda x: not regexp_matches(trim(x), '^(?:目\\s*录|目次|第\\s*[0-9]+\\s*页.*|[0-9]{1,4}|.*\\.{4,}\\s*[0-9]+)$')), chr(10))) as md5 from (select distinct doc_id, page, text from page_texts)""")
def p_clean_lines(spark, base):
    return table(spark, base, "page_texts", "doc_id", "page", "text").distinct().select("doc_id", "page", F.md5(chunking.clean_lines(F.col("text"))).alias("md5"))


LINES = "l as (select doc_id, page, text, line, line_no from (select doc_id, page, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from (select distinct doc_id, page, text from page_texts where page is not null)))"


@query("p_nearest_heading", f"""with {LINES}, h as (select doc_id, page, text, line_no, last_value(case when regexp_matches(line, '^(?:第[一二三四五六七八九十]+[章节]|[一二三四五六七八九十]+、|[0-9]+\\.[0-9]+ )') then line end ignore nulls) over (partition by doc_id, page, text order by line_no rows between 8 preceding and 1 preceding) as heading from l)
    select doc_id, page, line_no::int as line_no, heading from h where heading is not null""")
def p_nearest_heading(spark, base):
    pages = table(spark, base, "page_texts", "doc_id", "page", "text").filter("page is not null").distinct()
    lines = pages.select("doc_id", "page", F.md5("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line_no", F.col("n") + 1)
    found = lookup.nearest_before(lines, ["doc_id", "page", "t"], "line_no", F.col("line").rlike("^(?:第[一二三四五六七八九十]+[章节]|[一二三四五六七八九十]+、|[0-9]+\\.[0-9]+ )"), F.col("line"), 8, "heading")
    return found.filter("heading is not null").select("doc_id", "page", "line_no", "heading")


@query("p_margin_signatures", f"""with {LINES}, m as (select doc_id, page, regexp_replace(lower(regexp_replace(line, '\\s+', '', 'g')), '[0-9]+', '#', 'g') as signature from l where line_no <= 2) select doc_id, signature, count(distinct page) as n_pages from m where signature <> '' group by all having count(distinct page) >= 2""")
def p_margin_signatures(spark, base):
    lines = chunking.document_lines(table(spark, base, "page_texts", "doc_id", "page", "text").filter("page is not null").distinct()).filter("line_no <= 2")
    signed = lines.select("doc_id", "page", T.margin_signature(F.col("line")).alias("signature")).filter("signature <> ''")
    return signed.groupBy("doc_id", "signature").agg(F.countDistinct("page").alias("n_pages")).filter("n_pages >= 2")


@query("q_options", "select qid, e.key as option, e.value as text from (select qid, unnest(map_entries(options)) as e from questions)")
def q_options(spark, base):
    return evidence.options_of(table(spark, base, "questions"))


@query("q_rule_queries", f"""with b as (select qid, trim(question) as stem, options, concat_ws(' ', trim(question), array_to_string(list_transform(list_sort(map_entries(options)), lambda e: e.key || ' ' || e.value), ' ')) as every from questions),
    m as (select qid, list_transform(list_concat([every, concat_ws(' ', stem, array_to_string(list_transform(regexp_extract_all(every, '({NUM})', 1), lambda x: trim(x)), ' ')), concat_ws(' ', stem, array_to_string(regexp_extract_all(every, '({DATE})', 1), ' '))], list_transform(list_sort(map_entries(options)), lambda e: concat_ws(' ', stem, e.key, e.value))), lambda x: trim(x)) as made from b),
    u as (select qid, q, i from (select qid, unnest(made) as q, generate_subscripts(made, 1) as i from m)), d as (select qid, q as text, min(i) as i from u group by all)
    select qid, list_id, text from (select qid, text, row_number() over (partition by qid order by i) - 1 as list_id from d) where list_id < 8 and text <> ''""")
def q_rule_queries(spark, base):
    return evidence.rule_queries(table(spark, base, "questions")).withColumn("list_id", F.col("list_id").cast("long"))


_STEM = "regexp_replace(question, '\\s+', '', 'g')"
_MARKS = "list_filter([" + ",".join(f"'{m}'" for m in evidence.SCOPE_MARKERS) + f"], lambda m: contains({_STEM}, m))"


@query("q_envelope", f"""select qid, case when regexp_matches({_STEM}, '{evidence.INCORRECT}') then 'incorrect' else 'correct' end as selection_rule, array_to_string({_MARKS}, '|') as scope_markers, len(doc_ids) > 1 and regexp_matches({_STEM}, '{"|".join(evidence.UNIVERSAL_MARKERS)}') as requires_all_documents,
    regexp_matches({_STEM}, '{"|".join(evidence.COMPARISON_MARKERS)}') as requires_comparison, regexp_matches({_STEM}, '{"|".join(evidence.COMPOUND_MARKERS)}') as requires_compound from questions""")
def q_envelope(spark, base):
    return evidence.envelope(table(spark, base, "questions")).withColumn("scope_markers", joined("scope_markers"))


@query("v_selection", """select f, s, r, case when s = 'false' then 'false' when s = 'uncertain' or f = 'uncertain' then 'uncertain' when r = 'incorrect' then case when f = 'false' then 'true' else 'false' end else case when f = 'true' then 'true' else 'false' end end as verdict
    from (select unnest(['true', 'false', 'uncertain']) as f), (select unnest(['true', 'false', 'uncertain']) as s), (select unnest(['correct', 'incorrect']) as r)""")
def v_selection(spark, base):
    states = F.array(*[F.lit(x) for x in ("true", "false", "uncertain")])
    rows = spark.range(1).select(F.explode(states).alias("f")).select("f", F.explode(states).alias("s")).select("f", "s", F.explode(F.array(F.lit("correct"), F.lit("incorrect"))).alias("r"))
    return rows.withColumn("verdict", evidence.selection_verdict(F.col("f"), F.col("s"), F.col("r")))


def claims(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "claim_records").dropDuplicates(["qid", "option"])


K = "k as (select qid, option, any_value(normalized_text) as t, any_value(selected) as selected, any_value(doc_ids) as doc_ids, any_value(numbers) as numbers, any_value(qualifiers) as qualifiers, any_value(source_doc_ids) as source_doc_ids from claim_records group by all)"


_SET = "list_sort(list_distinct(coalesce({}, [])))"


# The pairs that conflicts are chosen from. Equal numbers and document sets, which no pair of these tables has, and the similarity,
# which SQL has no function for, are left to the test on a fixture.
@query("a_claim_pairs", f"""with r as materialized (select qid || '/' || option as key, any_value(qid) as qid, any_value(domain) as domain, any_value(selected) as selected, any_value(normalized_text) as t, any_value({_SET.format('doc_ids')}) as docs, any_value({_SET.format('source_doc_ids')}) as sources, any_value(coalesce(source_scoped, false)) as scoped,
      any_value(list_sort(coalesce(numbers, []))) as n, any_value(list_sort(coalesce(qualifiers, []))) as q, any_value(regexp_matches(text, '两份|两家|双方|均|全部|各自')) as every from claim_records group by 1)
    select distinct least(a.key, b.key) as left_key, greatest(a.key, b.key) as right_key from r a join r b on a.selected and not b.selected and a.domain = b.domain and a.qid <> b.qid and a.q = b.q where length(a.t) >= 8 and length(b.t) >= 8 and len(list_intersect(a.sources, b.sources)) > 0
      and (not (a.every or b.every) or a.sources = b.sources)""")
def a_claim_pairs(spark, base):
    return evidence.claim_conflicts(claims(spark, base), 0.0, False, False).select("left_key", "right_key")


@query("a_claim_conflicts")
def a_claim_conflicts(spark, base):
    return evidence.claim_conflicts(claims(spark, base))


@query("v_contracts", f"""with {K}, e as (select qid, option, list_sort(list(distinct d)) as observed from (select qid, option, unnest(source_doc_ids) as d from k) group by all), b as (select qid, option, list_sort(list_distinct(doc_ids)) as required, coalesce(observed, []) as observed from k left join e using (qid, option))
    select qid, option, array_to_string(required, '|') as required, array_to_string(observed, '|') as observed, array_to_string(list_filter(required, lambda x: not list_contains(observed, x)), '|') as missing, round(case when len(required) > 0 then len(list_filter(required, lambda x: list_contains(observed, x))) / len(required) else 1.0 end, 4) as coverage from b""")
def v_contracts(spark, base):
    seen = claims(spark, base).select("qid", "option", F.explode("source_doc_ids").alias("doc_id"))
    out = evidence.contracts(claims(spark, base).select("qid", "option", "doc_ids"), seen)
    return out.select("qid", "option", *[joined(c).alias(c) for c in ("required", "observed", "missing")], "coverage")


@query("v_answers", f"""with {K}, j as (select k.*, answer_format, len(numbers)::double as confidence from k join questions using (qid))
    select qid, case when answer_format = 'multi' then coalesce(string_agg(case when selected then option end, '' order by option), '') else coalesce(arg_max(case when selected then option end, case when selected then (confidence * 1000 - ascii(option)) end), '') end as answer from j group by qid, answer_format""")
def v_answers(spark, base):
    rows = claims(spark, base).join(table(spark, base, "questions", "qid", "answer_format"), "qid").withColumn("confidence", F.size("numbers").cast("double"))
    return evidence.assemble_answers(rows.select("qid", "option", "answer_format", "selected", "confidence"))


@query("v_merge", f"""with {K}, b as (select qid, coalesce(string_agg(case when selected then option end, '' order by option), '') as b from k group by qid), c as (select qid, coalesce(string_agg(case when len(numbers) > 2 then option end, '' order by option), '') as c from k group by qid), r as (select qid, c as r from c where ends_with(qid, '1'))
    select qid, case when c <> b and r is not null then r else b end as answer, case when c <> b and r is not null and r = c then 'candidate' when c <> b and r is not null then 'review' else 'baseline' end as origin from b left join c using (qid) left join r using (qid)""")
def v_merge(spark, base):
    letters = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("option")))), "")
    baseline = claims(spark, base).groupBy("qid").agg(letters(F.col("selected")).alias("answer"))
    candidate = claims(spark, base).groupBy("qid").agg(letters(F.size("numbers") > 2).alias("answer"))
    return metrics.merge_candidates(baseline, candidate, candidate.filter("qid like '%1'"))


@query("v_overrides", f"with {K}, b as (select qid, coalesce(string_agg(case when selected then option end, '' order by option), '') as answer from k group by qid) select qid, case when ends_with(qid, '2') then 'A' else answer end as answer from b")
def v_overrides(spark, base):
    rows = claims(spark, base).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("selected"), F.col("option")))), "").alias("answer"))
    return metrics.apply_overrides(rows, rows.filter("qid like '%2'").withColumn("answer", F.lit("A")), "qid", "answer")


@query("a_consensus", """select doc_id, cat as option, count(*) as n_runs, count_if(v = 1) as n_selected, round(count_if((v = 1) <> base) / count(*), 6) as flip_share, count_if((v = 1) <> base) = count(*) as unanimous from (
    select doc_id, cat, v, first_value(v = 1) over (partition by doc_id, cat order by reviewed_at, reviewer, v) as base from (select distinct doc_id, reviewer, reviewed_at, cat, v from review_labels unpivot (v for cat in (abuse, hate, sexual)))) group by all having count(*) >= 2""")
def a_consensus(spark, base):
    from pyspark.sql import Window

    long = table(spark, base, "review_labels").unpivot(["doc_id", "reviewer", "reviewed_at"], ["abuse", "hate", "sexual"], "option", "v").filter("v is not null").distinct()
    first = F.first(F.col("v") == 1).over(Window.partitionBy("doc_id", "option").orderBy("reviewed_at", "reviewer", "v"))
    votes = long.select(F.col("doc_id").alias("qid"), "option", (F.col("v") == 1).alias("selected"), first.alias("baseline"))
    return metrics.consensus(votes).withColumnRenamed("qid", "doc_id")


@query("a_stratified", """with o as (select *, sha1('7:' || qid) as h from questions), i as (select *, row_number() over (partition by domain, answer_format order by h) as f from o) select qid, domain, place from (select qid, domain, row_number() over (partition by domain order by f > 1, h) as place from i) where place <= 5""")
def a_stratified(spark, base):
    return metrics.stratified_sample(table(spark, base, "questions"), 5, 7).select("qid", "domain", "place")


@query("a_validation", f"""with {K}, a as (select qid, coalesce(string_agg(case when selected then option end, '' order by option), '') as answer from k group by qid)
    select 'missing' as problem, qid from questions where qid not in (select qid from a) union select 'format', qid from a join questions using (qid) where not case when answer_format = 'multi' then regexp_matches(answer, '^A?B?C?D?$') and answer <> '' when answer_format = 'tf' then regexp_matches(answer, '^[AB]$') else regexp_matches(answer, '^[A-D]$') end""")
def a_validation(spark, base):
    answers = claims(spark, base).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("selected"), F.col("option")))), "").alias("answer"))
    return metrics.validate_answers(answers, table(spark, base, "questions", "qid", "answer_format"))


@query("a_usage", "select domain, sum(length(question) // 2) as prompt_tokens, round(case when sum(length(question) // 2) <= 0 then 0 else greatest(0, least(1, (5000000 - sum(length(question) // 2)) / 5000000)) end, 6) as token_score from questions group by domain")
def a_usage(spark, base):
    used = table(spark, base, "questions", "domain", "question").groupBy("domain").agg(F.sum(F.floor(F.length("question") / 2)).alias("prompt_tokens"))
    return used.withColumn("token_score", F.round(metrics.token_score(F.col("prompt_tokens")), 6))


def _usable(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "numeric_facts", "fact_id", "doc_id", "metric", "year", "scope", "quality_score", "normalized_value").distinct()
    return rows.withColumn("base_value", F.col("normalized_value").try_cast("double"))


U = "u as (select * from (select distinct fact_id, doc_id, metric, year, scope, quality_score, try_cast(normalized_value as double) as v from numeric_facts) where v is not null and coalesce(year, '') <> '' and coalesce(scope, 'unknown') not in ('quarter', 'segment', 'parent'))"


@query("n_growth", f"""with {U}, b as (select * from (select *, row_number() over (partition by doc_id, metric, year order by quality_score desc, fact_id) as n from u) where n = 1), p as (select *, row_number() over w as k, lead(fact_id) over w as o, lead(v) over w as ov from b window w as (partition by doc_id, metric order by year desc))
    select doc_id, metric, fact_id as fact_new, o as fact_old, round((v - ov) / abs(ov), 4) as growth from p where k = 1 and o is not null and ov <> 0""")
def n_growth(spark, base):
    return facts.growth(_usable(spark, base))


@query("n_compare", f"""with {U}, b as (select * from (select *, row_number() over (partition by metric, year, doc_id order by quality_score desc, fact_id) as n from u) where n = 1)
    select metric, year, doc_id, fact_id, rank() over (partition by metric, year order by v) - 1 as n_lower, rank() over (partition by metric, year order by v desc) - 1 as n_higher from b""")
def n_compare(spark, base):
    return facts.ranks_across_documents(_usable(spark, base))


@query("n_calculate", f"""with {U}, g as (select doc_id, metric, min(fact_id) as l, max(fact_id) as r from u group by all having count(*) > 1), w as (select unnest(['difference', 'ratio', 'compare', 'growth_rate']) as operation)
    select operation, l as left_id, r as right_id, round(case operation when 'difference' then a.v - b.v when 'ratio' then case when b.v = 0 then null else a.v / b.v end when 'growth_rate' then case when b.v = 0 then null else (a.v - b.v) / abs(b.v) end end, 6) as value, case when operation = 'compare' then case when a.v > b.v then 'gt' when a.v < b.v then 'lt' else 'eq' end end as relation from g, w, u a, u b where a.fact_id = l and b.fact_id = r""")
def n_calculate(spark, base):
    u = facts.usable(_usable(spark, base))
    wanted = u.groupBy("doc_id", "metric").agg(F.min("fact_id").alias("left_id"), F.max("fact_id").alias("right_id"), F.count("*").alias("n")).filter("n > 1")
    wanted = wanted.select("left_id", "right_id", F.explode(F.array(*[F.lit(x) for x in ("difference", "ratio", "compare", "growth_rate")])).alias("operation"))
    return facts.calculate(u, wanted)


@query("s_unique_documents", "select domain, count(distinct d) as n_docs from (select domain, unnest(doc_ids) as d from questions) group by domain")
def s_unique_documents(spark, base):
    return table(spark, base, "questions", "domain", "doc_ids").select("domain", F.explode("doc_ids").alias("d")).groupBy("domain").agg(F.countDistinct("d").alias("n_docs"))


@query("s_resolve", """with w as (select domain, doc_id from raw_documents), f as (select split_part(path, '/', 1) as domain, regexp_replace(split_part(path, '/', 2), '\\.[^.]+$', '') as stem, path from raw_documents) select w.domain, w.doc_id, min(f.path) as path from w join f on f.domain = w.domain and f.stem = w.doc_id group by all""")
def s_resolve(spark, base):
    files = table(spark, base, "raw_documents", "path").select(F.substring_index("path", "/", 1).alias("domain"), F.regexp_replace(F.substring_index("path", "/", -1), "\\.[^.]+$", "").alias("stem"), "path")
    return formats.resolve_documents(table(spark, base, "raw_documents", "domain", "doc_id"), files)


@query("s_answer_rows", f"""with {K}, r as (select qid, coalesce(string_agg(case when selected then option end, '' order by option), '') as answer, sum(length(t)) // 2 as p, count(*) as c from k group by qid) select 'summary' as qid, '' as answer, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(p + c)::bigint as total_tokens from r union all select qid, answer, p, c, p + c from r""")
def s_answer_rows(spark, base):
    rows = claims(spark, base).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("selected"), F.col("option")))), "").alias("answer"), F.floor(F.sum(F.length("normalized_text")) / 2).alias("prompt_tokens"), F.count("*").alias("completion_tokens"))
    return formats.answer_rows(rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))


@query("s_wide_answers", "select run, doc_id as qid, answer from (select doc_id, max(abuse)::varchar as abuse, max(hate)::varchar as hate, max(sexual)::varchar as sexual from review_labels group by doc_id) unpivot include nulls (answer for run in (abuse, hate, sexual))")
def s_wide_answers(spark, base):
    wide = table(spark, base, "review_labels").groupBy(F.col("doc_id").alias("qid")).agg(*[F.max(c).cast("int").cast("string").alias(c) for c in ("abuse", "hate", "sexual")])
    return formats.wide_answers(wide)


@query("d_power_set", "select qid, array_to_string(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1), '') as answer from (select qid, l, unnest(range(1, (1 << len(l)::bigint)::bigint)) as m from (select qid, list_sort(map_keys(options)) as l from questions where answer_format = 'multi')) union all select qid, unnest(map_keys(options)) from questions where answer_format <> 'multi'")
def d_power_set(spark, base):
    return planning.power_set(table(spark, base, "questions", "qid", "options", "answer_format"))


@query("d_levels", """with recursive e as (select option as node, chr(ascii(option) - 1) as depends_on from (select distinct option from claim_records) where length(option) = 1), n as (select distinct option as node from claim_records), w(node, level) as (select node, 0 from n union all select e.node, w.level + 1 from w join e on e.depends_on = w.node) select node, max(level)::int as level from w group by node""")
def d_levels(spark, base):
    nodes = table(spark, base, "claim_records", "option").distinct().withColumnRenamed("option", "node")
    edges = nodes.filter("length(node) = 1").select("node", F.char(F.ascii("node") - 1).alias("depends_on"))
    return planning.dependency_levels(nodes, edges)


@query("d_inherited", """with p as (select n_nationkey::varchar as profile, case when n_nationkey >= 5 then (n_nationkey - 5)::varchar end as parent, n_regionkey::varchar as key, n_name as value from nation), recursive_up as (select 1)
    select a.profile, a.key, a.value from p a union all select c.profile, b.key, b.value from p c join p b on b.profile::int < c.profile::int and (c.profile::int - b.profile::int) % 5 = 0 and not exists (select 1 from p x where (x.profile = c.profile or (x.profile::int < c.profile::int and x.profile::int > b.profile::int and (c.profile::int - x.profile::int) % 5 = 0)) and x.key = b.key)""")
def d_inherited(spark, base):
    n = table(spark, base, "nation")
    profiles = n.select(F.col("n_nationkey").cast("string").alias("profile"), F.when(F.col("n_nationkey") >= 5, (F.col("n_nationkey") - 5).cast("int").cast("string")).alias("parent"))
    return planning.inherited(profiles, n.select(F.col("n_nationkey").cast("string").alias("profile"), F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("value")))


@query("m_patterns", "with d as (select unnest([-1, 0, 1]) as x) select concat_ws(',', a.x, b.x, c.x, e.x) as pattern from d a, d b, d c, d e where a.x + b.x + c.x + e.x = 2")
def m_patterns(spark, base):
    return planning.gain_patterns(spark, 4, 2)


@query("m_vote_weights", "select doc_id, abuse::varchar as answer, sum(case reviewer when 'rv01' then 2.0 else 1.0 end) as weight from review_labels where abuse is not null group by all")
def m_vote_weights(spark, base):
    rows = table(spark, base, "review_labels").filter("abuse is not null")
    return rows.groupBy("doc_id", F.col("abuse").cast("int").cast("string").alias("answer")).agg(F.sum(F.when(F.col("reviewer") == "rv01", 2.0).otherwise(1.0)).alias("weight"))


# The dry run answers the first letter that stands alone in the prompt.
@query("l_dry_run", f"select qid, regexp_extract({S.QUESTION_TEXT}, '(?:^|[^A-Za-z])([A-D])(?:[^A-Za-z]|$)', 1) as answer, 0.0::double as confidence, length({S.QUESTION_TEXT}) // 2 as prompt_tokens from questions")
def l_dry_run(spark, base):
    prompts = table(spark, base, "questions", "qid", "question", "options", "answer_format")
    asked = judge.call_model(prompts.select(F.col("qid").alias("key"), evidence.question_text(F.col("question"), F.col("options")).alias("prompt")))
    return asked.join(prompts.select(F.col("qid").alias("key"), "answer_format"), "key").select(F.col("key").alias("qid"), judge.parse_answer(F.col("output"), F.col("answer_format")).alias("answer"), judge.confidence(F.col("output")).alias("confidence"), "prompt_tokens")


@query("e_windowed", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def e_windowed(spark, base):
    return incremental.windowed_counts(table(spark, base, "events", "ts", "event_type"))


@query("e_pending", "select event_id from events where user_id not in (select user_id from events where event_id % 50 = 1)")
def e_pending(spark, base):
    events = table(spark, base, "events", "event_id", "user_id")
    return incremental.pending(events, events.filter("event_id % 50 = 1"), "user_id").select("event_id")


@query("n_units", "select base_unit, count(*) as n_metrics from metric_units group by base_unit")
def n_units(spark, base):
    known = table(spark, base, "metric_units")
    aliases = spark.createDataFrame(quantities.unit_aliases(), "a string, base_unit string, f double, s double, o double").select("base_unit").distinct()
    return known.join(aliases, "base_unit", "left_semi").groupBy("base_unit").agg(F.count("*").alias("n_metrics"))


@query("r_top_by_group", "select domain, qid, place from (select domain, qid, row_number() over (partition by domain order by length(question) desc, qid) as place from questions) where place <= 3")
def r_top_by_group(spark, base):
    from millrace.operators import index

    return index.top_k(table(spark, base, "questions", "domain", "qid", F.length("question").cast("double").alias("n")), 3, ["domain"], "qid", "n").select("domain", "qid", F.col("rank").alias("place"))


@query("s_document_lines", "select doc_id, page, count(*) as n_lines from (select doc_id, page, unnest(string_split(text, chr(10))) as line from (select distinct doc_id, page, text from page_texts)) group by all")
def s_document_lines(spark, base):
    return chunking.document_lines(table(spark, base, "page_texts", "doc_id", "page", "text").distinct()).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


@query("r_last_loaded", "select fact_id, max(loaded_at) as loaded_at, count(*) as n_deliveries from numeric_facts group by fact_id")
def r_last_loaded(spark, base):
    rows = table(spark, base, "numeric_facts", "fact_id", "loaded_at")
    counted = rows.groupBy("fact_id").agg(F.count("*").alias("n_deliveries"))
    return ranking.last_wins(rows, ["fact_id"], "loaded_at").join(counted, "fact_id")
