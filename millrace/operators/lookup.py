"""Neighbours of chunks: by position, page, clause, section, parent, and the nearest line before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SPAN = 200_000  # chunks between two cuts of a long document


def with_sequence(chunks: DataFrame, order: str = "chunk_id", span: int = SPAN) -> DataFrame:
    """Adds ``seq``, the position of a chunk in its document (from 0) by ``order``, which is distinct within a document.

    A document of any length is numbered in spans of about ``span`` chunks: about one chunk in so many, drawn by the hash of its
    key, is a cut; spans are numbered each on its own and shifted by the sizes of those before. No task holds more than a span.
    """
    cuts = chunks.filter(F.pmod(F.xxhash64(order), F.lit(span)) == 0).groupBy("doc_id").agg(F.sort_array(F.collect_set(order)).alias("_cuts"))
    placed = chunks.join(cuts, "doc_id", "left").withColumn("_span", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order))), F.lit(0))).drop("_cuts")
    own = F.row_number().over(Window.partitionBy("doc_id", "_span").orderBy(order))
    sizes = placed.groupBy("doc_id", "_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("doc_id", "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.withColumn("_own", own).join(offsets, ["doc_id", "_span"]).withColumn("seq", (F.col("_own") + F.col("_before") - 1).cast("int")).drop("_span", "_own", "_before")


def neighbours(anchors: DataFrame, chunks: DataFrame, left: int = 1, right: int = 1) -> DataFrame:
    """(anchor_id, chunk_id, distance): chunks at most ``left`` before and ``right`` after the anchor in its document.

    Each chunk is offered to the anchors by exploding the anchor's few positions, so that the range join is an equi-join on
    (doc_id, seq) and a document with a tenth of all chunks is spread like any other.
    """
    wanted = anchors.select(F.col("chunk_id").alias("anchor_id"), "doc_id", F.explode(F.sequence(F.lit(-left), F.lit(right))).alias("distance"), "seq")
    wanted = wanted.select("anchor_id", "doc_id", (F.col("seq") + F.col("distance")).alias("seq"), "distance")
    return wanted.join(chunks.select("doc_id", "seq", "chunk_id"), ["doc_id", "seq"]).select("anchor_id", "chunk_id", "distance")


def same_place(anchors: DataFrame, chunks: DataFrame, place: str) -> DataFrame:
    """(anchor_id, chunk_id): other chunks of the same document with the same non-empty ``place`` (page, clause_id, section)."""
    there = F.col(place).isNotNull() & (F.col(place).cast("string") != "")
    left = anchors.filter(there).select(F.col("chunk_id").alias("anchor_id"), "doc_id", place)
    right = chunks.filter(there).select("doc_id", place, "chunk_id")
    return left.join(right, ["doc_id", place]).filter("anchor_id <> chunk_id").select("anchor_id", "chunk_id")


def members(chunks: DataFrame, place: str) -> DataFrame:
    """(doc_id, place, chunk_id): all chunks of each non-empty ``place``; same_place gives the pairs, which grow with their square."""
    return chunks.filter(F.col(place).isNotNull() & (F.col(place).cast("string") != "")).select("doc_id", place, "chunk_id").distinct()


def nearest_before(lines: DataFrame, partition: list[str], order: str, is_source: Column, value: Column, reach: int, name: str) -> DataFrame:
    """Adds the value of the nearest of the ``reach`` rows before for which ``is_source`` holds (an as-of lookup)."""
    frame = Window.partitionBy(*partition).orderBy(order).rowsBetween(-reach, -1)
    return lines.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(frame))


def carry_forward(lines: DataFrame, partition: list[str], order: str, is_source: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the latest row up to this one for which ``is_source`` holds."""
    frame = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(frame))


def documents_of_hits(hits: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """(qid, doc_id, score, rank): documents by the summed reciprocal ranks of their chunks."""
    summed = hits.groupBy("qid", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def doc_coverage(required: DataFrame, covered: DataFrame) -> DataFrame:
    """(qid, required, covered, missing) as sorted arrays; both inputs have qid, doc_id."""
    want = required.groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("required"))
    have = covered.groupBy("qid").agg(F.collect_set("doc_id").alias("found"))
    both = want.join(have, "qid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return both.select("qid", "required", F.array_sort(F.array_intersect("required", "found")).alias("covered"), F.array_sort(F.array_except("required", "found")).alias("missing"))
