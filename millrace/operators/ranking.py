"""Fusing, deduplicating and cutting ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def best_by_shared(claims: DataFrame, chunks: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """(keys, chunk_id, doc_id, score, rank): of each claim's documents the k chunks that share most of its numbers, ties by chunk_id.

    ``claims`` has the keys (one row each), doc_ids, numbers; ``chunks`` chunk_id, doc_id, numbers. A document's chunks don't all meet
    its claims, which would grow with the square of a large document; what meets is bounded, and holds the k best:
    a chunk that shares nothing is among the k first of its document (so is one without numbers, behind all others); a chunk that
    shares one number is among the k first with that number; a chunk that shares several has one of them that isn't the claim's most
    frequent in the document.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("chunk_id"))
    own = chunks.select("doc_id", "chunk_id", F.col("numbers").alias("_own"), F.col("numbers").isNull().alias("_none"))
    spread = claims.select(*keys, "numbers", F.posexplode("doc_ids").alias("_at", "doc_id"))  # a document that is named twice counts twice
    at = [*keys, "_at", "doc_id"]
    heads = own.withColumn("_n", first("doc_id", "_none")).filter(F.col("_n") <= k).select("doc_id", "chunk_id", "_own")
    # Numbers are 64-bit hashes; smaller documents are wholly among the heads.
    large = own.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > k).select("doc_id")
    asked = spread.join(large, "doc_id", "left_semi").select(*at, F.explode(F.array_distinct("numbers")).alias("_number")).select(*at, F.xxhash64("_number").alias("_h"))
    posted = own.join(large, "doc_id", "left_semi").select("doc_id", "chunk_id", "_own", F.explode(F.array_distinct("_own")).alias("_number")).select("doc_id", "chunk_id", "_own", F.xxhash64("_number").alias("_h"))
    posted = posted.join(asked.select("doc_id", "_h").distinct(), ["doc_id", "_h"], "left_semi")
    there = Window.partitionBy("doc_id", "_h")
    posted = posted.withColumn("_n", F.row_number().over(there.orderBy("chunk_id"))).withColumn("_df", F.count("*").over(there))
    most = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("_df"), "_h"))
    asked = asked.join(posted.filter("_n = 1").select("doc_id", "_h", "_df"), ["doc_id", "_h"]).withColumn("_most", most)
    met = asked.drop("_df").join(posted, ["doc_id", "_h"]).filter((F.col("_most") > 1) | (F.col("_n") <= k)).select(*at, "chunk_id", "_own")
    every = spread.select(*at).join(heads, "doc_id").unionByName(met).dropDuplicates([*at, "chunk_id"]).join(claims.select(*keys, "numbers"), keys)
    shared = F.size(F.array_intersect("numbers", "_own")).cast("double")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return every.withColumn("score", shared).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*keys, "chunk_id", "doc_id", "score", "rank")


def reciprocal_rank_fusion(lists: DataFrame, k: int = 30, constant: int = RRF_K, partition: str = "qid") -> DataFrame:
    """(qid, chunk_id, doc_id, score, raw_score, rank) from (qid, list_id, rank, chunk_id, doc_id, score, weight).

    A chunk that a list has twice counts twice. The representative is the row with the highest raw score.
    """
    gain = F.sum(F.col("weight") / (constant + F.col("rank"))).alias("fused")
    fused = lists.groupBy(partition, "chunk_id").agg(gain, F.max("score").alias("raw_score"), F.max_by("doc_id", "score").alias("doc_id"))
    order = Window.partitionBy(partition).orderBy(F.desc(F.round("fused", 9)), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(partition, "chunk_id", "doc_id", F.col("fused").alias("score"), "raw_score", "rank")


def document_fusion(lists: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """(qid, doc_id, score, rank): each list counts a document at its first place."""
    first = lists.groupBy("qid", "list_id", "doc_id").agg(F.min("rank").alias("place"), F.first("weight").alias("weight"))
    summed = first.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") / (constant + F.col("place"))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rescue_documents(lists: DataFrame, k: int = 30, n_docs: int = 5) -> DataFrame:
    """Fused hits in which each of the ``n_docs`` best documents is represented.

    A document that is missing brings its best chunk. While the list is short it is appended; a full list gives up its lowest
    hit of a document that isn't protected, else its last. (qid, chunk_id, doc_id, place): place is the position, rescued last.
    """
    hits = reciprocal_rank_fusion(lists, k)
    docs = document_fusion(lists, n_docs)
    best = lists.groupBy("qid", "doc_id").agg(F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("chunk_id"))
    missing = docs.join(hits.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti").join(best, ["qid", "doc_id"])
    order = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    missing = missing.withColumn("nth", order).select("qid", "doc_id", "chunk_id", "nth")
    sizes = hits.groupBy("qid").agg(F.count("*").alias("n"))
    need = missing.groupBy("qid").agg(F.count("*").alias("n_missing")).join(sizes, "qid").withColumn("give", F.greatest(F.col("n") + F.col("n_missing") - k, F.lit(0)))
    marked = hits.join(docs.select("qid", "doc_id", F.lit(1).alias("protected")), ["qid", "doc_id"], "left")
    # The hits to give up: those of documents that aren't protected from below, then whatever is last.
    turn = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("protected").isNotNull(), F.desc("rank")))
    kept = marked.withColumn("turn", turn).join(need.select("qid", "give"), "qid", "left").filter(F.col("turn") > F.coalesce("give", F.lit(0)))
    both = kept.select("qid", "doc_id", "chunk_id", F.col("rank").alias("at")).unionByName(missing.select("qid", "doc_id", "chunk_id", (F.col("nth") + k).alias("at")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("at", "chunk_id"))).drop("at")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The last row of each key by one or more columns."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order]))).filter("_n = 1").drop("_n")


def best_wins(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the highest value of each key, ties by the smaller ``tie``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))).filter("_n = 1").drop("_n")


def within_budget_stop(rows: DataFrame, partition: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each partition in order up to the first that goes over the budget; the first row always stays. A prefix sum."""
    window = Window.partitionBy(*partition).orderBy(order)
    return rows.withColumn("_used", F.sum(size).over(window)).withColumn("_n", F.row_number().over(window)).filter((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def within_budget_skip(rows: DataFrame, partition: list[str], order: str, key: str, size: Column, budget: int, most: int) -> DataFrame:
    """(partition, place, key): rows taken in order, each that would go over the budget skipped; the first row always stays.

    A fold over the ordered rows of a partition. A partition is one query's ranked list, whose length its search bounds.
    """
    listed = rows.groupBy(*partition).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("key"), size.cast("long").alias("size")))).alias("items"))
    start = F.struct(F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>").alias("taken"), F.lit(0).cast("long").alias("used"))

    def step(state: Column, item: Column) -> Column:
        fits = ((F.size(state["taken"]) == 0) | (state["used"] + item["size"] <= budget)) & (F.size(state["taken"]) < most)
        return F.when(fits, F.struct(F.concat(state["taken"], F.array(item["key"])).alias("taken"), (state["used"] + item["size"]).alias("used"))).otherwise(state)

    return listed.select(*partition, F.posexplode(F.aggregate("items", start, step)["taken"]).alias("place", key))


def compressed(scored: DataFrame, scope: DataFrame, budget: int, most: int) -> DataFrame:
    """(qid, place, chunk_id): by ``rule_score`` within a budget of characters; where a question names several documents (``scope``
    has qid, doc_ids), the best candidate of each comes first. Candidates have qid, chunk_id, doc_id, rank, text."""
    rows = scored.join(scope, "qid").withColumn("at", F.array_position(F.coalesce("doc_ids", F.array().cast("array<string>")), F.col("doc_id")))
    best = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("rule_score"), "rank"))
    rows = rows.withColumn("best", best).withColumn("named", (F.size(F.array_distinct("doc_ids")) > 1) & (F.col("at") > 0) & (F.col("best") == 1))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("named"), F.col("at")).otherwise(F.lit(2**31)), F.desc("rule_score"), "rank")
    return within_budget_skip(rows.withColumn("turn", F.row_number().over(order)), ["qid"], "turn", "chunk_id", F.length(F.trim("text")), budget, most)


def cover_documents_first(rows: DataFrame, partition: str, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """k rows of each partition: the best of each document before any second one."""
    inner = F.row_number().over(Window.partitionBy(partition, "doc_id").orderBy(F.desc(score), tie))
    outer = F.row_number().over(Window.partitionBy(partition).orderBy(F.col("_of_doc") > 1, F.desc(score), tie))
    return rows.withColumn("_of_doc", inner).withColumn("place", outer).filter(F.col("place") <= k).drop("_of_doc")


def round_robin(rows: DataFrame, partition: str, lane: str, rank: str) -> DataFrame:
    """Rows by rank, lanes in turn; ``place`` counts from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(partition).orderBy(rank, lane)))
