"""Feedback from first results: rare terms of the best hits widen a query (pseudo relevance, without a model)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokenize
from millrace.operators.asking import entities, squeezed

# What a term is worth by where it stands.
TITLE, CLAUSE, SECTION, KIND, ENTITY, NUMBER = 0.6, 1.0, 0.4, 0.2, 0.2, 0.15


def _worth(items: Column, bonus: float, most: int) -> Column:
    return F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, most), lambda t: F.struct(squeezed(t).alias("term"), F.lit(bonus).alias("bonus")))


def _if(when: Column, item: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(item)).otherwise(F.array().cast("array<string>"))


def feedback_queries(targets: DataFrame, seeds: DataFrame, rarity: DataFrame, n_seeds: int = 6, most: int = 4) -> DataFrame:
    """(qid, query): the first two variants of each target with up to ``most`` new terms of its best hits; targets without new terms
    have no row.

    ``targets`` has qid, variants; ``seeds`` qid, rank, text, title, section, clause_id, chunk_type, numbers, dates; ``rarity`` h, idf of
    all terms, h their 64-bit hash. A term is new if some token of it isn't in the query; it scores by its rarest token and by where it
    stands, ties by the rank of its hit and its place there. Rarity belongs to the term, so of its places in a query's hits the one worth
    most is kept first, and each different term meets the rarities once. The tokens of queries and the rarities are far larger than
    their tables on disk, by which Spark would broadcast them: they are joined by sorting.
    """
    base = targets.select("qid", F.array_join(F.slice("variants", 1, 2), " ").alias("query")).withColumn("_q", F.array_distinct(tokenize(F.col("query"))))
    kind, section = F.col("chunk_type"), F.coalesce("section", F.lit(""))
    made = F.concat(
        _worth(_if(F.col("title") != "", F.col("title")), TITLE, 1), _worth(_if(F.col("clause_id") != "", F.col("clause_id")), CLAUSE, 1), _worth(_if((section != "") & ~section.isin("table", "figure", "document"), section), SECTION, 1),
        _worth(_if(kind.isin("table", "figure"), kind), KIND, 1), _worth(entities(F.col("text")), ENTITY, 8), _worth(F.col("numbers"), NUMBER, 4), _worth(F.col("dates"), NUMBER, 4),
    )
    rows = seeds.filter(F.col("rank") <= n_seeds).select("qid", "rank", F.posexplode(made).alias("at", "x")).select("qid", "rank", "at", "x.term", "x.bonus").filter(F.length("term") >= 2)
    # Bonuses differ by more than rounding hides, so the best place doesn't depend on the rarity.
    rows = rows.groupBy("qid", "term").agg(F.min(F.struct((-F.col("bonus")).alias("b"), "rank", "at")).alias("o"))
    rows = rows.withColumn("_t", F.array_distinct(tokenize(F.col("term")))).join(base.hint("merge"), "qid").filter(F.size(F.array_except("_t", "_q")) > 0)
    rows = rows.select("qid", "term", "o").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    tokens = rows.select("term").distinct().select("term", F.explode(F.array_distinct(tokenize(F.col("term")))).alias("token")).select("term", F.xxhash64("token").alias("h"))
    rarest = tokens.join(rarity.hint("merge"), "h", "left").groupBy("term").agg(F.max(F.coalesce("idf", F.lit(0.0))).alias("idf"))
    score = F.round(F.col("idf") - F.col("o.b"), 6)
    best = rows.join(rarest.hint("merge"), "term").select("qid", "term", F.struct((-score).alias("s"), "o.rank", "o.at").alias("o"))
    placed = best.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).filter(F.col("n") <= most)
    chosen = placed.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ").alias("more"))
    return base.drop("_q").join(chosen.hint("merge"), "qid").select("qid", F.trim(F.concat_ws(" ", "query", "more")).alias("query"))
