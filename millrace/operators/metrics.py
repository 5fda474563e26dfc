"""Retrieval metrics, votes, merges, validation, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_BUDGET = 5_000_000


def document_ranks(hits: DataFrame) -> DataFrame:
    """(qid, doc_id, doc_rank): documents by the place of their first hit, without gaps."""
    first = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy("qid").orderBy("first", "doc_id"))).drop("first")


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, hit_1, hit_3, hit_5, hit_10, all_gold, recall, mrr) per question with gold documents; 0 where nothing was found."""
    ranked = gold.select("qid", "doc_id").distinct().join(document_ranks(hits), ["qid", "doc_id"], "left")
    hit = [F.max((F.coalesce("doc_rank", F.lit(10**9)) <= n).cast("int")).alias(f"hit_{n}") for n in (1, 3, 5, 10)]
    found = F.count_if(F.col("doc_rank") <= k)
    first = F.min(F.when(F.col("doc_rank") <= k, F.col("doc_rank")))
    return ranked.groupBy("qid").agg(*hit, (found == F.count("*")).cast("int").alias("all_gold"), (found / F.count("*")).alias("recall"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"))


def summarize_metrics(rows: DataFrame, variant: str, domain: str) -> DataFrame:
    """Averages per variant and domain, and per variant over all domains (``ALL``), in one pass by grouping sets."""
    rows = rows.withColumn("d", F.coalesce(domain, F.lit("")))
    grouped = rows.groupingSets([[F.col(variant), F.col("d")], [F.col(variant)]], F.col(variant), F.col("d"))
    measures = [F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "all_gold", "recall", "mrr")]
    return grouped.agg(F.grouping("d").alias("g"), F.count("*").alias("n"), *measures).select(variant, F.when(F.col("g") == 1, "ALL").otherwise(F.col("d")).alias("domain"), "n", "hit_1", "hit_3", "hit_5", "hit_10", "all_gold", "recall", "mrr")


def probe_ranks(hits: DataFrame, terms: list[str], keys: tuple[str, ...] = ("qid",), text: str = "text") -> DataFrame:
    """(keys, all_terms_rank, any_term_rank, coverage_rank): first hit with all, with any, and the shortest prefix with each of the terms."""
    has = [F.contains(F.col(text), F.lit(t)) for t in terms]
    each = [F.min(F.when(h, F.col("rank"))) for h in has]
    whole = reduce(lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(a, b)), each)
    every, some = reduce(lambda a, b: a & b, has), reduce(lambda a, b: a | b, has)
    return hits.groupBy(*keys).agg(F.min(F.when(every, F.col("rank"))).alias("all_terms_rank"), F.min(F.when(some, F.col("rank"))).alias("any_term_rank"), whole.alias("coverage_rank"))


def token_score(tokens: Column, budget: int = TOKEN_BUDGET) -> Column:
    return F.when(tokens <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - tokens) / budget)))


def final_score(correct: Column, total: Column, tokens: Column, budget: int = TOKEN_BUDGET) -> Column:
    return 100 * correct / total * (0.7 + 0.3 * token_score(tokens, budget))


def consensus(votes: DataFrame, least_runs: int = 2) -> DataFrame:
    """(qid, option, n_runs, n_selected, flip_share, unanimous) of each option over runs, against the baseline's choice.

    ``votes`` has run, qid, option, selected, baseline.
    """
    flips = F.count_if(F.col("selected") != F.col("baseline"))
    out = votes.groupBy("qid", "option").agg(F.count("*").alias("n_runs"), F.count_if("selected").alias("n_selected"), F.round(flips / F.count("*"), 6).alias("flip_share"), (flips == F.count("*")).alias("unanimous"))
    return out.filter(F.col("n_runs") >= least_runs)


def merge_candidates(baseline: DataFrame, candidate: DataFrame, reviews: DataFrame) -> DataFrame:
    """(qid, answer, origin): the baseline's answer unless the candidate differs and a review names the answer. All have qid, answer."""
    joined = baseline.select("qid", F.col("answer").alias("b")).join(candidate.select("qid", F.col("answer").alias("c")), "qid", "left").join(reviews.select("qid", F.col("answer").alias("r")), "qid", "left")
    reviewed = F.col("c").isNotNull() & (F.col("c") != F.col("b")) & F.col("r").isNotNull()
    return joined.select("qid", F.when(reviewed, F.col("r")).otherwise(F.col("b")).alias("answer"), F.when(reviewed & (F.col("r") == F.col("c")), "candidate").when(reviewed, "review").otherwise("baseline").alias("origin"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with ``column`` replaced where an override has the key; an override of an unknown key is an error when the result is read."""
    known = rows.select(key).distinct()
    unknown = overrides.join(known, key, "left_anti").limit(1).select(F.raise_error(F.concat(F.lit("override of an unknown key: "), F.col(key).cast("string"))).cast("string").alias("problem"))
    merged = rows.join(overrides.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    return merged.join(unknown.select(F.col("problem").alias(key).cast(rows.schema[key].dataType)), key, "left_anti")


def validate_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(problem, qid) of each violation: duplicate, unknown or missing question, illegal answer for its format, tokens that don't add up."""
    problems = [
        answers.groupBy("qid").count().filter("count > 1").select(F.lit("duplicate").alias("problem"), "qid"),
        answers.join(questions, "qid", "left_anti").select(F.lit("unknown").alias("problem"), "qid"),
        questions.join(answers, "qid", "left_anti").select(F.lit("missing").alias("problem"), "qid"),
    ]
    both = answers.join(questions.select("qid", "answer_format"), "qid")
    legal = F.when(F.col("answer_format") == "multi", F.col("answer").rlike("^A?B?C?D?$") & (F.col("answer") != "")).when(F.col("answer_format") == "tf", F.col("answer").rlike("^[AB]$")).otherwise(F.col("answer").rlike("^[A-D]$"))
    problems.append(both.filter(~F.coalesce(legal, F.lit(False))).select(F.lit("format").alias("problem"), "qid"))
    if "total_tokens" in answers.columns:
        problems.append(answers.filter("prompt_tokens + completion_tokens <> total_tokens").select(F.lit("tokens").alias("problem"), "qid"))
    return reduce(DataFrame.unionByName, problems).distinct()


def stratified_sample(questions: DataFrame, per_domain: int, seed: int) -> DataFrame:
    """``per_domain`` questions of each domain in the order of a seeded hash, one of each format before any second one."""
    shuffled = F.sha1(F.concat_ws(":", F.lit(seed), "qid"))
    inner = F.row_number().over(Window.partitionBy("domain", "answer_format").orderBy(shuffled))
    outer = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("_of_format") > 1, shuffled))
    return questions.withColumn("_of_format", inner).withColumn("place", outer).filter(F.col("place") <= per_domain).drop("_of_format")


def missing_quota(rows: DataFrame, column: str) -> DataFrame:
    """Counts of rows per value of a column, nulls and empty strings as one value of their own."""
    return rows.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit("(none)")).alias(column)).agg(F.count("*").alias("n"))
