"""Queries: feedback from first results."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import asking, feedback, index
from millrace.plans import sqltext as S
from millrace.plans.asking import TARGETS, _VARIANTS, entities, sq
from millrace.plans.registry import query
from millrace.plans.rerank import CANDIDATES, candidates
from millrace.plans.retrieval import chunks, questions
from millrace.sources.tables import table


def _w(items: str, bonus: float, most: int) -> str:
    return f"list_transform(({items})[1:{most}], lambda v: {{'term': {sq('v')}, 'bonus': {bonus}}})"


@query("q_feedback", f"""with {CANDIDATES}, {TARGETS}, bq as materialized (select qid, query, list_distinct({S.tokens('query')}) as q from (select qid, array_to_string(({_VARIANTS})[1:2], ' ') as query from b4)),
    ix as materialized (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from (select unnest(list_distinct({S.tokens('body')})) as term from ({S.CHUNKS})), (select count(*)::double as n from ({S.CHUNKS})) group by term, n),
    sd as (select cd.qid, rank, unnest(l) as x, generate_subscripts(l, 1) - 1 as at_ from (select cd.qid, rank, flatten([{_w("case when coalesce(title, '') <> '' then [title] else [] end", 0.6, 1)}, {_w("case when clause_id <> '' then [clause_id] else [] end", 1.0, 1)}, {_w("case when section not in ('', 'table', 'figure', 'document') then [section] else [] end", 0.4, 1)},
      {_w("case when coalesce(chunk_type in ('table', 'figure'), false) then [chunk_type] else [] end", 0.2, 1)}, {_w(entities('text'), 0.2, 8)}, {_w('numbers', 0.15, 4)}, {_w('dates', 0.15, 4)}]) as l from cd left join (select doc_id, title from raw_documents) using (doc_id) where rank <= 6) cd),
    r as (select sd.qid, rank, at_, x.term as term, x.bonus::double as bonus, list_distinct({S.tokens('x.term')}) as tk from sd where length(x.term) >= 2),
    nw as (select r.* from r join bq using (qid) where len(list_filter(tk, lambda v: not list_contains(q, v))) > 0),
    sc as (select n.qid, n.rank, n.at_, n.term, round(max(coalesce(idf, 0)) + any_value(bonus), 6) as score from (select qid, rank, at_, term, bonus, unnest(tk) as token from nw) n left join ix on ix.term = token group by n.qid, n.rank, n.at_, n.term),
    bs as (select qid, term, row_number() over (partition by qid order by score desc, rank, at_) as n from (select * from sc qualify row_number() over (partition by qid, term order by score desc, rank, at_) = 1))
    select qid, trim(concat_ws(' ', query, more)) as query from bq join (select qid, string_agg(term, ' ' order by n) as more from bs where n <= 4 group by qid) using (qid)""")
def q_feedback(spark, base):
    # Partitioned by chunk, the terms of a chunk are counted where they are made.
    tokens = index.tokenized(chunks(spark, base), F.col("body")).repartition("chunk_id")
    df = index.document_frequencies(tokens)
    rarity = df.withColumn("n", index.corpus_stats(tokens).select("n").scalar()).select("h", index.idf(F.col("n"), F.col("df")).alias("idf"))
    seeds = candidates(spark, base).join(table(spark, base, "raw_documents", "doc_id", "title"), "doc_id", "left")
    return feedback.feedback_queries(asking.retrieval_targets(questions(spark, base)), seeds, rarity)
