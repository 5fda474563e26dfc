"""Sweeps of named documents for a claim's values, the context around what they find, and whether evidence is enough."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rerank import compact

# Hints of specific evidence, consequences and general context, and the order in which shortcomings are mended.
SPECIFIC = "营业收入|净利润|现金流|分红|日期|发行公告|罚款|扣减|减分|责令|期限"
CONSEQUENCES = "处罚|罚款|扣减|减分|责令|不得|期限"
GENERAL = "审计报告|公允反映|坚持依法合规|客观公正|原则|财务报表"
ASKS_CONSEQUENCE = "处罚|扣减|减分|期限"
MEND_FIRST = ["missing_metric_value_pair", "same_doc_wrong_clause", "missing_clause_consequence", "generic_context_only", "missing_second_endpoint"]


def _year(value: Column) -> Column:
    return F.regexp_replace(value, "\\s+", "").rlike("^(?:19|20)[0-9]{2}年?$")


LARGE, BLOCK = 1000, 8192  # chunks of a document that is swept by blocks, and of a block


def _holders(values: list[str], texts: list[str]) -> dict[str, np.ndarray]:
    """The numbers of the texts that contain each value, by rolling 64-bit hashes of every length: one pass over the texts a length.
    Neither has white space."""
    whole = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    found = {v: np.arange(len(texts)) if v == "" else np.zeros(0, int) for v in values}
    step, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(42)
    of_length: dict[int, list[str]] = {}
    for v in values:
        of_length.setdefault(len(v), []).append(v)
    rolled = whole
    for length in range(1, max(of_length, default=0) + 1):
        if length > len(whole):
            break
        if length > 1:
            rolled = rolled[:-1] * step + whole[length - 1 :]
        if length not in of_length:
            continue
        asked = np.frombuffer("".join(of_length[length]).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, length)
        key = asked[:, 0]
        for i in range(1, length):
            key = key * step + asked[:, i]
        order = np.argsort(key)
        key, maybe = key[order], np.zeros(1 << 22, bool)
        maybe[key >> shift] = True
        at = np.flatnonzero(maybe[rolled >> shift])
        which = np.minimum(np.searchsorted(key, rolled[at]), len(key) - 1)
        at, which = at[key[which] == rolled[at]], which[key[which] == rolled[at]]
        by = np.argsort(which, kind="stable")
        at, which = at[by], which[by]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(which)) + 1):
            if len(part):
                found[of_length[length][order[which[part[0]]]]] = np.unique(np.searchsorted(begin, at[part], "right") - 1)
    return found


def _swept(k: int):
    def sweep(claims: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(claims) and len(chunks):
            chunks = chunks.sort_values("chunk_id")
            ids, texts, bonus = chunks["chunk_id"].to_numpy(), list(chunks["_x"]), np.where(chunks["_kind"].to_numpy(), 8, 0)
            lists = [[list(x) for x in claims[c]] for c in ("_n", "_d", "_y", "_t")]
            holders = _holders(sorted({v for each in lists for x in each for v in x}), texts)
            for qid, option, doc_id, *own in zip(claims["qid"], claims["option"], claims["doc_id"], *lists):
                a, b, c, d = (np.zeros(len(ids), np.int64) for _ in own)
                for count, values in zip((a, b, c, d), own):
                    for v in values:
                        count[holders[v]] += 1
                met = np.flatnonzero((a > 0) | (b > 0) | (d >= 2))
                points = (40 * a + 30 * b + 5 * (c > 0) + 10 * d + bonus)[met]
                best = np.argsort(-points, kind="stable")[:k]
                out += [(qid, option, doc_id, ids[i], p / 10) for i, p in zip(met[best], points[best])]
        return pd.DataFrame(out, columns=["qid", "option", "doc_id", "chunk_id", "points"])

    return sweep


def document_sweep(claims: DataFrame, chunks: DataFrame, k: int = 8, large_from: int = LARGE) -> DataFrame:
    """(qid, option, doc_id, chunk_id, points, score, place): the k chunks of each document of a claim's scope that state most of its
    numbers, dates and terms.

    ``claims`` has qid, option, doc_scope, numbers, dates, terms (arrays); ``chunks`` chunk_id, doc_id, text, chunk_type. A plain year or
    a single term alone is no hit. Claims meet the chunks of their documents only; ties go to the smaller chunk_id.
    """
    flat = lambda c: F.transform(c, compact)
    own = claims.select(
        "qid", "option", F.explode(F.array_distinct("doc_scope")).alias("doc_id"), flat(F.filter("numbers", lambda v: ~_year(v))).alias("_n"), flat(F.filter("dates", lambda v: F.length(compact(v)) > 4)).alias("_d"), flat(F.filter("numbers", _year)).alias("_y"), flat(F.col("terms")).alias("_t"),
    )
    chunks = chunks.select("chunk_id", "doc_id", compact(F.col("text")).alias("_x"), "chunk_type").filter("_x <> ''")
    # A large document, whose pairs grow with its square: blocks of chunks, in which each value is looked up once for all claims.
    large = chunks.groupBy("doc_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"), F.count("*").alias("_rows")).filter(F.col("_rows") > large_from).select("doc_id", "_blocks")
    asked = own.join(large, "doc_id").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    parts = chunks.join(large, "doc_id").select("doc_id", F.pmod(F.xxhash64("chunk_id"), F.col("_blocks")).cast("int").alias("_b"), "chunk_id", "_x", F.coalesce(F.col("chunk_type").isin("table", "financial_metric_row"), F.lit(False)).alias("_kind"))
    blocks = asked.groupBy("doc_id", "_b").cogroup(parts.groupBy("doc_id", "_b")).applyInPandas(_swept(k), "qid string, option string, doc_id string, chunk_id string, points double")
    rows = own.join(large, "doc_id", "left_anti").join(chunks, "doc_id")
    hits = lambda c: F.size(F.filter(c, lambda v: F.contains(F.col("_x"), v)))
    rows = rows.withColumns({"a": hits("_n"), "b": hits("_d"), "c": hits("_y"), "d": hits("_t")}).filter("a > 0 or b > 0 or d >= 2")
    points = F.col("a") * 4.0 + F.col("b") * 3.0 + F.least(F.col("c"), F.lit(1)) * 0.5 + F.col("d") + F.when(F.col("chunk_type").isin("table", "financial_metric_row"), 0.8).otherwise(0.0)
    order = Window.partitionBy("qid", "option", "doc_id").orderBy(F.desc("points"), "chunk_id")
    rows = rows.select("qid", "option", "doc_id", "chunk_id", F.round(points, 6).alias("points")).unionByName(blocks)
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return rows.select("qid", "option", "doc_id", "chunk_id", "points", F.round(F.least("points", F.lit(10.0)) * 0.01 + 0.25, 6).alias("score"), "place")


def around(hits: DataFrame, chunks: DataFrame, n: int = 2) -> DataFrame:
    """(qid, option, chunk_id, score): the chunks of the same page and next to the n best hits of each document, at nine tenths of the
    score; the best where several hits bring one. ``hits`` has qid, option, doc_id, chunk_id, score, place, ``chunks`` doc_id,
    chunk_id, page, seq."""
    best = hits.filter(F.col("place") <= n).join(chunks.select("chunk_id", "page", "seq"), "chunk_id").select("qid", "option", "doc_id", "page", "seq", F.greatest(F.lit(0.01), F.col("score") * 0.9).alias("score"))
    paged = best.filter("page is not null").join(chunks.select("doc_id", "page", "chunk_id"), ["doc_id", "page"])
    beside = best.withColumn("seq", F.explode(F.array(F.col("seq") - 1, F.col("seq"), F.col("seq") + 1))).join(chunks.select("doc_id", "seq", "chunk_id"), ["doc_id", "seq"])
    return paged.select("qid", "option", "chunk_id", "score").unionByName(beside.select("qid", "option", "chunk_id", "score")).groupBy("qid", "option", "chunk_id").agg(F.round(F.max("score"), 6).alias("score"))


def sufficiency(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, sufficient, failure_tags, closure, density, missing_numbers, missing_terms, mend): whether the evidence of a target is
    enough, and which shortcoming to mend first.

    ``targets`` has qid, stem, intent, numbers, dates, entities, must_terms; ``evidence`` qid, text. A target without evidence has none.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " "))
    told = evidence.select("qid", text.alias("t")).filter("t <> ''").groupBy("qid").agg(F.collect_list("t").alias("texts"))
    rows = targets.join(told, "qid", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    found = lambda items: F.filter(items, lambda v: F.exists("texts", lambda t: F.contains(t, v)))
    rows = rows.withColumns({"fn": found("numbers"), "fd": found("dates"), "fe": found("entities"), "ft": found("must_terms")})
    some = lambda pattern: F.exists("texts", lambda t: t.rlike(pattern))
    compared, asked = F.col("intent") == "comparison", F.col("intent").isin("comparison", "number")
    n_like, f_like = F.size("numbers") + F.size("dates"), F.size("fn") + F.size("fd")
    open_ = compared & ((n_like >= 2) & (f_like < 2) | (n_like == 1) & (f_like < 1))
    closure = F.when(compared & (n_like >= 2), F.least(F.lit(1.0), f_like / n_like)).when(compared & (n_like == 1) & (f_like < 1), 0.0).otherwise(1.0)
    general = (F.size("texts") == 0) | ~some(SPECIFIC) & ~some(CONSEQUENCES) & some(GENERAL)
    consequence = F.regexp_replace(F.coalesce("stem", F.lit("")), "\\s+", " ").rlike(ASKS_CONSEQUENCE) & ~some(CONSEQUENCES)
    no_number = asked & (F.size("fn") < F.size("numbers"))
    tags = F.array_distinct(F.filter(F.array(F.when(open_ & (n_like >= 2), F.lit("missing_second_endpoint")), F.when(open_ & (n_like == 1), F.lit("missing_numeric_value")), F.when(general, F.lit("generic_context_only")), F.when(consequence, F.lit("missing_clause_consequence")), F.when(no_number, F.lit("missing_numeric_value"))), lambda t: t.isNotNull()))
    few = compared & (F.size("entities") > 0) & (F.size("fe") < F.least(F.lit(2), F.size("entities")))
    density = F.aggregate("texts", F.lit(0.0), lambda total, t: total + F.when(t.rlike(SPECIFIC), F.when(t.rlike("[0-9]"), 0.75).otherwise(0.40)).otherwise(0.0) + F.when(t.rlike(CONSEQUENCES), 0.35).otherwise(0.0))
    rows = rows.withColumns({"sufficient": ~open_ & ~general & ~consequence & ~few & ~no_number, "failure_tags": tags})
    mend = F.when(~F.col("sufficient"), F.get(F.array_intersect(F.array(*map(F.lit, MEND_FIRST)), "failure_tags"), F.lit(0)))
    share = F.when(F.size("texts") > 0, F.least(F.lit(1.0), density / F.size("texts"))).otherwise(0.0)
    return rows.select("qid", "sufficient", "failure_tags", F.round(closure, 6).alias("closure"), F.round(share, 6).alias("density"), F.array_except("numbers", "fn").alias("missing_numbers"), F.array_except("must_terms", "ft").alias("missing_terms"), mend.alias("mend"))


def excerpt(parent: Column, child: Column, most: int = 720) -> Column:
    """Up to ``most`` characters of a parent around its child, a third of them before; where the child stands with other white space,
    by the share of the text before its first 24 characters; the child itself where it isn't found."""
    bare, anchor = F.regexp_replace(parent, "\\s+", ""), F.substring(F.regexp_replace(child, "\\s+", ""), 1, 24)
    exact = F.instr(parent, child) - 1
    near = F.when(anchor != "", F.instr(bare, anchor) - 1).otherwise(-1)
    start = F.when(exact >= 0, exact).when(near >= 0, F.floor(near / F.greatest(F.lit(1), F.length(bare)) * F.length(parent)))
    left = F.greatest(F.lit(0), start - most // 3)
    return F.when(start.isNull(), child).otherwise(F.substring(parent, (left + 1).cast("int"), F.lit(most)))
