"""Queries: anchors of questions and their packs of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lookup, packs
from millrace.plans.registry import query
from millrace.plans.rerank import CANDIDATES, _fold, candidates
from millrace.plans.retrieval import questions
from millrace.sources.tables import table

ANCHORS = f"""{CANDIDATES}, an as materialized (select qid, chunk_id, doc_id, score, anchor, dids from (select *, row_number() over (partition by qid order by case when pos > 0 and nth = 1 then pos else 2147483648 end, rank) as anchor
      from (select cd.qid, cd.chunk_id, cd.doc_id, cd.score, cd.rank, coalesce(q.doc_ids, []) as dids, coalesce(list_position(q.doc_ids, cd.doc_id), 0) as pos, row_number() over (partition by cd.qid, cd.doc_id order by rank) as nth from cd join questions q using (qid))) where anchor <= 6 and (len(dids) = 0 or pos > 0))"""


def chosen(spark, base):
    return packs.anchors(candidates(spark, base), questions(spark, base).select("qid", "doc_ids"))


@query("j_anchors", f"with {ANCHORS} select qid, chunk_id, anchor from an")
def j_anchors(spark, base):
    return chosen(spark, base).select("qid", "chunk_id", "anchor")


@query("j_packs", rf"""with recursive {ANCHORS}, o as materialized (select *, row_number() over (partition by doc_id order by chunk_id) - 1 as seq from (select distinct chunk_id, doc_id, page, coalesce(clause_id, '') as clause, lower(regexp_replace(coalesce(section, ''), '\s+', '', 'g')) as part, metadata['chunk_type'] as kind, length(trim(text)) as n from chunks)),
    at_ as (select an.qid, an.chunk_id as anchor_id, o.doc_id, page, clause, part, kind, seq from an join o using (chunk_id)),
    ev as (select qid, anchor_id, 0 as turn, o.seq, chunk_id, n from at_ join o on o.chunk_id = anchor_id union all select qid, anchor_id, 1, o.seq, chunk_id, n from at_ a join o on o.doc_id = a.doc_id and o.clause = a.clause and a.clause <> ''
      union all select qid, anchor_id, 1, o.seq, chunk_id, n from at_ a join o on o.doc_id = a.doc_id and o.part = a.part and a.clause = '' and a.part <> '' union all select qid, anchor_id, 2, o.seq, chunk_id, n from at_ a join o on o.doc_id = a.doc_id and o.page = a.page and a.kind in ('table', 'figure')
      union all select qid, anchor_id, 3, o.seq, chunk_id, n from at_ a join o on o.doc_id = a.doc_id and abs(o.seq - a.seq) <= 1),
    fi as (select qid, anchor_id, chunk_id, n, row_number() over (partition by qid, anchor_id, chunk_id order by turn, seq) as k, turn as t, seq from ev where n > 0),
    {_fold("select qid, anchor_id, chunk_id, n, row_number() over (partition by qid, anchor_id order by t, seq) as turn from fi where k = 1", "qid, anchor_id", 2200, 4)}
    select qid, anchor_id, chunk_id, row_number() over (partition by qid, anchor_id order by turn) - 1 as place from fd where taken""")
def j_packs(spark, base):
    rows = table(spark, base, "chunks").select("chunk_id", "doc_id", "page", "section", "clause_id", "text", F.col("metadata")["chunk_type"].alias("chunk_type")).distinct()
    return packs.packs(chosen(spark, base), lookup.with_sequence(rows))


@query("j_merged_packs")
def j_merged_packs(spark, base):
    own = chosen(spark, base)
    rows = table(spark, base, "chunks").select("chunk_id", "doc_id", "page", "section", "clause_id", "text", F.col("metadata")["chunk_type"].alias("chunk_type")).distinct()
    members = packs.packs(own, lookup.with_sequence(rows))
    return packs.merged(members, own.withColumnRenamed("chunk_id", "anchor_id")).select("qid", "pack", F.round("score", 8).alias("score"), F.array_join("chunk_ids", "|").alias("chunk_ids"))
