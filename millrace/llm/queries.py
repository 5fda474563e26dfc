"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.abuse import found_categories, score_documents, source_rates
from millrace.llm.distinctive_terms import term_scores
from millrace.llm.leakage import leaked_items
from millrace.llm.markup import clean_documents
from millrace.llm.near_copies import near_copies
from millrace.llm.one_form import alike_pairs, consistent_forms
from millrace.llm.packing import pack_documents
from millrace.llm.scanned_pages import repair_documents, repair_pages
from millrace.llm.splitting import needs, split_tables, split_texts
from millrace.sources.tables import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        LLM_QUERIES[name] = f
        if sql is not None:
            LLM_SQL[name] = sql
        return f

    return register


def _runs(table_name: str, key: str) -> str:
    """SQL of (key, run) for each run of 40 letters, digits and Han characters of a table's texts."""
    wide, plain = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    read = f"regexp_replace(lower(translate(text, '{wide}', '{plain}')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
    return f"select distinct {key}, unnest(list_transform(range(1, length(t) - 38), lambda i: substring(t, i, 40))) as run from (select {key}, {read} as t from {table_name} where text is not null)"


@query("p9_found", f"select distinct doc_id, item_id from ({_runs('documents', 'doc_id')}) join ({_runs('eval_passages', 'item_id')}) using (run)")
def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked_items(table(spark, base, "documents", "doc_id", "text"), table(spark, base, "eval_passages", "item_id", "text"))


@query(
    "p2_found",
    """
    with r as (select distinct 'claim_records' as record_table, qid || '/' || option as key, normalized_text as text from claim_records union select 'chunks', chunk_id, text from chunks),
    g as materialized (select record_table, key, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) as gram from r where length(text) >= 3),
    n as (select record_table, key, count(*) as n from g group by all),
    s as (select a.record_table, a.key as key_a, b.key as key_b, count(*) as shared from g a join g b on a.record_table = b.record_table and a.gram = b.gram and a.key < b.key group by all having count(*) >= 20)
    select s.record_table, key_a, key_b from s join n x on x.record_table = s.record_table and x.key = key_a join n y on y.record_table = s.record_table and y.key = key_b where shared >= 0.65 * (x.n + y.n - shared)
    """,
)
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    claims = table(spark, base, "claim_records").select(F.lit("claim_records").alias("record_table"), F.concat("qid", F.lit("/"), "option").alias("key"), F.col("normalized_text").alias("text"))
    chunks = table(spark, base, "chunks").select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("key"), "text")
    return near_copies(claims.unionByName(chunks))


def chunk_terms(spark: SparkSession, base: str) -> DataFrame:
    chunks = table(spark, base, "chunks", "chunk_id", "section", "text")
    return term_scores(chunks.select(F.col("chunk_id").alias("key"), F.concat_ws("\n", "section", "text").alias("text")), table(spark, base, "glossary_terms", "term"))


@query(
    "p1_found",
    """
    with c as (select chunk_id, any_value(concat_ws(chr(10), section, text)) as text from chunks group by chunk_id),
    hit as (select chunk_id, term, (length(text) - length(replace(text, term, ''))) // length(term) as n from c, glossary_terms where contains(text, term)),
    rare as (select term from hit group by term having count(*) * 100 <= (select count(*) from c))
    select chunk_id, term from hit where n >= 3 and term in (select term from rare)
    """,
)
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    rare = F.col("records_with_term") * 100 <= F.col("n_records")
    return chunk_terms(spark, base).filter((F.col("occurrences") >= 3) & rare).select(F.col("key").alias("chunk_id"), "term")


TERM_GRAPH = """
    c as (select chunk_id, any_value(concat_ws(chr(10), section, text)) as text from chunks group by chunk_id),
    s as (select count(*) as n, avg(length(text)) as mean from c),
    hit as materialized (select chunk_id, term, text from c, glossary_terms where contains(text, term)),
    o as materialized (select chunk_id, term, list_filter(range(1, length(text) - length(term) + 2), lambda i: substring(text, i, length(term)) = term) as places, length(term) as l from hit),
    parts as (select chunk_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9.,%]*|[㐀-鿿]{1,2}|(?s:.)') as p from (select distinct chunk_id, text from hit)),
    placed as (select chunk_id, unnest(p) as part, generate_subscripts(p, 1) as i from parts),
    starts as (select chunk_id, part, i, sum(length(part)) over (partition by chunk_id order by i) - length(part) + 1 as b from placed),
    w as materialized (select chunk_id, part, b, b + length(part) as e, row_number() over (partition by chunk_id order by i) as k from starts where regexp_matches(part, '^[A-Za-z0-9㐀-鿿]')),
    each as (select chunk_id, term, unnest(places) as place, l from o),
    ranked as (select chunk_id, term, part, e <= place as before, row_number() over (partition by chunk_id, term, place, e <= place order by case when e <= place then -k else k end) as r from each join w using (chunk_id) where e <= place or b >= place + l),
    degrees as (select chunk_id, term, count(distinct part) filter (part <> term) as degree from ranked where r <= 4 group by all),
    df as (select term, count(*) as df from hit group by term)
"""


@query("p1_scores", f"""with {TERM_GRAPH} select chunk_id, term, len(places) as occurrences, coalesce(degree, 0) as degree, df as records_with_term, round(coalesce(degree, 0) / (0.997 + 0.003 * length(text) / mean) * ln((n + 1) / df), 4) as score
    from o join hit using (chunk_id, term) left join degrees using (chunk_id, term) join df using (term), s""")
def p1_scores(spark: SparkSession, base: str) -> DataFrame:
    return chunk_terms(spark, base).select(F.col("key").alias("chunk_id"), "term", "occurrences", "degree", "records_with_term", F.round("score", 4).alias("score"))


def _printed(spark: SparkSession, base: str) -> DataFrame:
    options = F.concat_ws("\x1e", F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("\x1f"), F.coalesce(e["value"], F.lit("")))))
    questions = table(spark, base, "questions").select(F.lit("questions").alias("record_table"), F.col("qid").alias("key"), F.concat_ws("\x1d", "question", options).alias("text"))
    documents = table(spark, base, "raw_documents").select(F.lit("raw_documents").alias("record_table"), F.col("doc_id").alias("key"), F.col("raw_text").alias("text"))
    return questions.unionByName(documents)


@query("p5_found")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return alike_pairs(_printed(spark, base))


@query("p5_forms")
def p5_forms(spark: SparkSession, base: str) -> DataFrame:
    tagged = _printed(spark, base).select(F.concat_ws("/", "record_table", "key").alias("key"), "text")
    return consistent_forms(tagged).select("key", (F.col("form") != F.col("text")).alias("changed"), F.md5("form").alias("form_md5"))


def _pieces(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {
        "raw_documents": split_texts(table(spark, base, "raw_documents").select(F.col("doc_id").alias("key"), F.col("raw_text").alias("text"))),
        "layout_tables": split_tables(table(spark, base, "layout_tables").select(F.col("table_id").alias("key"), "rows")),
    }


@query(
    "p6_found",
    r"""
    with d as (select doc_id, length(raw_text) > 1800 as over, list_max(list_transform(regexp_split_to_array(replace(raw_text, '. ', chr(10)), '[\n\f。！？；!?;]'), lambda x: length(x))) as longest from raw_documents),
    r as (select table_id, list_transform(rows, lambda x: list_sum(list_transform(x, lambda c: coalesce(length(c), 0) + 1))) as sizes from layout_tables)
    select 'raw_documents' as item_table, doc_id as item_key, 'split' as need from d where over
    union select 'raw_documents', doc_id, 'hard_cut' from d where longest > 1800
    union select 'layout_tables', table_id, 'split' from r where list_sum(sizes) > 1200
    union select 'layout_tables', table_id, 'hard_cut' from r where list_max(sizes) > 1200
    """,
)
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    found = [needs(pieces).select(F.lit(name).alias("item_table"), F.col("key").alias("item_key"), "need") for name, pieces in _pieces(spark, base).items()]
    return found[0].unionByName(found[1])


@query("p6_pieces")
def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    made = [pieces.select(F.lit(name).alias("item_table"), F.col("key").alias("item_key"), "piece", "begin", "end", "cut", F.md5("text").alias("text_md5")) for name, pieces in _pieces(spark, base).items()]
    return made[0].unionByName(made[1])


def _repaired(spark: SparkSession, base: str) -> DataFrame:
    return repair_pages(table(spark, base, "page_texts", "doc_id", "page", "text"), table(spark, base, "raw_documents", "doc_id", "title"))


@query("p4_found")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _repaired(spark, base).select("doc_id", "page", F.explode("found").alias("f")).select("doc_id", "page", "f.line_no", "f.kind").distinct()


@query("p4_repaired")
def p4_repaired(spark: SparkSession, base: str) -> DataFrame:
    pages = _repaired(spark, base).select(F.lit("page_texts").alias("item_table"), "doc_id", "page", F.size("found").alias("n_found"), F.md5("clean").alias("clean_md5"))
    documents = repair_documents(table(spark, base, "raw_documents", "doc_id", "title", "raw_text"))
    return pages.unionByName(documents.select(F.lit("raw_documents").alias("item_table"), "doc_id", F.lit(None).cast("int").alias("page"), "n_found", F.md5("clean").alias("clean_md5")))


def _abuse(spark: SparkSession, base: str) -> DataFrame:
    return score_documents(table(spark, base, "documents", "doc_id", "text", "source"), table(spark, base, "review_labels"), carry=("source",))


@query("p10_found")
def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return found_categories(_abuse(spark, base))


@query("p10_rates")
def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    return source_rates(_abuse(spark, base))


def _cleaned(spark: SparkSession, base: str) -> DataFrame:
    bundles = clean_documents(table(spark, base, "docling_bundles").select(F.col("doc_id").alias("key"), F.col("markdown").alias("text")))
    documents = clean_documents(table(spark, base, "raw_documents").select(F.col("doc_id").alias("key"), F.col("raw_text").alias("text")))
    return bundles.withColumn("item_table", F.lit("docling_bundles")).unionByName(documents.withColumn("item_table", F.lit("raw_documents")))


@query("p7_found")
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _cleaned(spark, base).select("item_table", F.col("key").alias("item_key"), F.explode("markup").alias("markup")).distinct()


@query("p7_clean")
def p7_clean(spark: SparkSession, base: str) -> DataFrame:
    return _cleaned(spark, base).select("item_table", F.col("key").alias("item_key"), F.length("clean").alias("n_chars"), F.md5("clean").alias("clean_md5"))


@query("p8_packed")
def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    return pack_documents(table(spark, base, "documents", "doc_id", "text"))
