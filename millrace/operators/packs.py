"""Packs of evidence: anchors of a question, each with the chunks of its clause or section, page and neighbourhood."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import without_space
from millrace.operators.ranking import within_budget_skip


def anchors(hits: DataFrame, questions: DataFrame, most: int = 6) -> DataFrame:
    """(qid, chunk_id, doc_id, score, anchor): the best hit of each named document in the order they are named, then the others by rank.

    ``hits`` has qid, chunk_id, doc_id, rank, score; ``questions`` qid, doc_ids. Where documents are named, hits of others are no anchors.
    """
    named = F.coalesce("doc_ids", F.array().cast("array<string>"))
    rows = hits.join(questions.select("qid", named.alias("_d")), "qid").withColumn("_at", F.array_position("_d", F.col("doc_id")))
    first = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))
    rows = rows.withColumn("_first", first)
    order = Window.partitionBy("qid").orderBy(F.when((F.col("_at") > 0) & (F.col("_first") == 1), F.col("_at")).otherwise(F.lit(2**31)), "rank")
    rows = rows.withColumn("anchor", F.row_number().over(order)).filter((F.col("anchor") <= most) & ((F.size("_d") == 0) | (F.col("_at") > 0)))
    return rows.select("qid", "chunk_id", "doc_id", "score", "anchor")


def packs(chosen: DataFrame, chunks: DataFrame, window: int = 1, most: int = 4, characters: int = 2200) -> DataFrame:
    """(qid, anchor_id, place, chunk_id): the members of each anchor's pack, the anchor first.

    ``chunks`` has chunk_id, doc_id, page, section, clause_id, chunk_type, text, seq. A clause brings its chunks, without one the section
    does; tables and figures bring their page; then come the neighbours. At most ``most`` chunks and ``characters``; what doesn't fit
    is skipped. Every expansion is an equi-join.
    """
    own = chunks.select("chunk_id", "doc_id", "page", F.coalesce("clause_id", F.lit("")).alias("clause"), F.lower(without_space(F.coalesce("section", F.lit("")))).alias("part"), "chunk_type", "seq", F.length(F.trim("text")).alias("n"))
    at = chosen.select("qid", F.col("chunk_id").alias("anchor_id")).join(own.drop("n"), F.col("anchor_id") == F.col("chunk_id")).drop("chunk_id")
    member = own.filter("n > 0").select("doc_id", "page", "clause", "part", F.col("seq").alias("m_seq"), "chunk_id", "n")

    def met(rows: DataFrame, keys: list[str], turn: int) -> DataFrame:
        right = member.select(*keys, "m_seq", "chunk_id", "n")
        return rows.select("qid", "anchor_id", *keys).join(right, keys).select("qid", "anchor_id", F.lit(turn).alias("turn"), "m_seq", "chunk_id", "n")

    itself = at.join(member.select("chunk_id", "n"), F.col("anchor_id") == F.col("chunk_id")).select("qid", "anchor_id", F.lit(0).alias("turn"), F.col("seq").alias("m_seq"), "chunk_id", "n")
    beside = at.withColumn("m_seq", F.explode(F.sequence(F.col("seq") - window, F.col("seq") + window))).select("qid", "anchor_id", "doc_id", "m_seq").join(member.select("doc_id", "m_seq", "chunk_id", "n"), ["doc_id", "m_seq"]).select("qid", "anchor_id", F.lit(3).alias("turn"), "m_seq", "chunk_id", "n")
    every = itself.unionByName(met(at.filter("clause <> ''"), ["doc_id", "clause"], 1)).unionByName(met(at.filter("clause = '' and part <> ''"), ["doc_id", "part"], 1)).unionByName(met(at.filter("chunk_type in ('table', 'figure') and page is not null"), ["doc_id", "page"], 2)).unionByName(beside)
    first = every.groupBy("qid", "anchor_id", "chunk_id").agg(F.min(F.struct("turn", "m_seq", "n")).alias("f"))
    placed = first.withColumn("o", F.row_number().over(Window.partitionBy("qid", "anchor_id").orderBy("f.turn", "f.m_seq")))
    return within_budget_skip(placed.select("qid", "anchor_id", "chunk_id", "o", F.col("f.n").alias("n")), ["qid", "anchor_id"], "o", "chunk_id", F.col("n"), characters, most)


def merged(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(qid, pack, score, chunk_ids): packs that share a member as one, the best first.

    ``members`` has qid, anchor_id, place, chunk_id, ``scores`` qid, anchor_id, score. By falling score (ties by anchor) each pack joins
    the first pack so far that has one of its members, behind whose members its new ones come; else it is a pack of its own. A
    question has a bounded number of packs of bounded size, so its packs are one group.
    """
    listed = members.groupBy("qid", "anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for _, row in group.sort_values(["score", "anchor_id"], ascending=[False, True]).iterrows():
            own = list(row["ids"])
            met = next((p for p in out if set(p[2]) & set(own)), None)
            if met is None:
                out.append([row["anchor_id"], row["score"], own])
            else:
                met[2] += [c for c in own if c not in met[2]]
        return pd.DataFrame({"qid": [group["qid"].iloc[0]] * len(out), "pack": [p[0] for p in out], "score": [p[1] for p in out], "chunk_ids": [p[2] for p in out]})

    rows = listed.join(scores.select("qid", "anchor_id", "score"), ["qid", "anchor_id"])
    return rows.groupBy("qid").applyInPandas(join, "qid string, pack string, score double, chunk_ids array<string>")
