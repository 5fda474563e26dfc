"""Contracts between claims and their evidence, calibration of judged relations, answers from them, and scores of runs.

Rows are claims with arrays; every rule is a column expression, and evidence is aggregated once by claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import numbers

# Markers of risks, hints of claim sets, slots that a support can't do without, weights of risks, limits of confidence.
UNIVERSAL, COMPARED = "均|全部|所有|两份|各自|分别|同时", "高于|低于|超过|少于|早于|晚于|一致|不一致|同比"
ABSENT, NEGATED, COMPOUND = "未提及|未披露|未说明|没有|无任何|未出现|均未|不包含|不涵盖|不赔|无免赔额", "不得|不能|不可以|不属于|不包括|除外|无需|无权", "且|并且|以及|同时|分别|；|;"
EVERY, JOINED, NUMERIC = "均|都|双方|两份|两家|各自|所有|分别", "并且|同时|以及|且|；|;", "高于|低于|超过|不超过|同比|环比|比例|占比|%|％|倍"
CRITICAL = "^fact:(?:numeric_value|comparison_endpoints|consequence)"
RISKS = {"absence_claim": 2.0, "evidence_conflict": 1.8, "financial_scope_ambiguity": 2.5, "universal_scope": 1.2, "comparison": 1.0, "negative_claim": 1.0, "compound_claim": 0.8}
FACETS = {"financial_reports": ["entity", "year", "metric", "unit"], "insurance": ["product", "insurance_responsibility", "exclusion"], "regulatory": ["law_article", "case_or_penalty"], "financial_contracts": ["issuer", "amount_or_term", "rating_or_intermediary"], "research": ["entity", "claim", "metric_or_ranking"]}


def _empty() -> Column:
    return F.array().cast("array<string>")


def _tags(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(tag)) for when, tag in pairs]), lambda t: t.isNotNull())


def risk_tags(stem: Column, text: Column, n_required: Column, n_support: Column, n_counter: Column) -> Column:
    """What makes a claim risky: its scope, comparison, absence, negation, several parts, evidence for and against it."""
    both = F.concat_ws(" ", stem, text)
    return _tags(((n_required > 1) & both.rlike(UNIVERSAL), "universal_scope"), (both.rlike(COMPARED), "comparison"), (both.rlike(ABSENT), "absence_claim"), (text.rlike(NEGATED), "negative_claim"), (text.rlike(COMPOUND), "compound_claim"), ((n_support > 0) & (n_counter > 0), "evidence_conflict"))


def contracts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """What the evidence of each claim covers: required, observed, predicate_docs and numeric_docs, the counts of roles, risks, coverage,
    ready and needs_review.

    ``claims`` has qid, option, stem, text, claim_type, doc_scope, predicates (array); ``evidence`` qid, option, doc_id, role, text.
    A counted claim (metric, comparison, date) needs a number from each required document, a date claim may do with years.
    """
    own = claims.select("qid", "option", "predicates", "claim_type")
    year = "^(?:19|20)[0-9]{2}年?$"
    rows = evidence.join(own, ["qid", "option"]).withColumn("_n", F.exists(numbers(F.col("text")), lambda v: (F.col("claim_type") == "date_fact") | ~F.regexp_replace(v, "\\s+", "").rlike(year)))
    rows = rows.withColumn("_p", F.exists("predicates", lambda p: F.contains(F.col("text"), p)))
    docs = lambda when: F.collect_set(F.when(when, F.col("doc_id")))
    seen = rows.groupBy("qid", "option").agg(docs(F.lit(True)).alias("o"), docs(F.col("_p")).alias("p"), docs(F.col("_n")).alias("n"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("support", "counter", "ground_truth")])
    both = claims.withColumn("required", F.array_distinct("doc_scope")).join(seen, ["qid", "option"], "left")
    of = lambda c: F.filter("required", lambda d: F.array_contains(F.coalesce(c, _empty()), d))
    both = both.withColumns({"observed": of("o"), "predicate_docs": of("p"), "numeric_docs": of("n"), **{f"n_{r}": F.coalesce(f"n_{r}", F.lit(0)) for r in ("support", "counter", "ground_truth")}})
    counted = F.col("claim_type").isin("metric_fact", "comparison", "date_fact")
    both = both.withColumn("risks", risk_tags(F.col("stem"), F.col("text"), F.size("required"), F.col("n_support"), F.col("n_counter")))
    units = F.size("required") * F.when(counted, 3).otherwise(2)
    covered = F.size("observed") + F.size("predicate_docs") + F.when(counted, F.size("numeric_docs")).otherwise(0)
    hard = (F.size("observed") < F.size("required")) | (F.size("predicate_docs") < F.size("required")) | counted & (F.size("numeric_docs") < F.size("required"))
    review = hard | F.exists("risks", lambda t: t.isin("absence_claim", "evidence_conflict", "financial_scope_ambiguity"))
    return both.select("qid", "option", "required", "observed", "predicate_docs", "numeric_docs", "n_support", "n_counter", "n_ground_truth", "risks", F.round(covered / F.greatest(units, F.lit(1)), 6).alias("coverage"), (~hard).alias("ready"), review.alias("needs_review"))


def valid_refs(refs: Column, n: Column) -> Column:
    """The numbers from 1 to ``n`` that references name, in order, each once."""
    found = F.transform(F.coalesce(refs, _empty()), lambda r: F.nullif(F.regexp_extract(r, "[0-9]+", 0), F.lit("")).try_cast("int"))
    return F.array_distinct(F.filter(found, lambda v: v.between(1, n)))


def calibrated(verdicts: DataFrame, cited: bool = True) -> DataFrame:
    """(qid, option, relation, confidence, support, refute, tags): judged relations as far as their citations carry them.

    ``verdicts`` has qid, option, text, relation, confidence, support_refs, refute_refs (arrays like ``[1]``), evidence_docs (the document
    of each piece of evidence), missing_slots, doc_scope, sufficient. Citations out of range don't count; support and refutation
    together, a relation without citation, a missing critical slot, and a claim about every document without support from each
    make the relation insufficient and bound its confidence.
    """
    n = F.size(F.coalesce("evidence_docs", _empty()))
    rows = verdicts.withColumns({"s": valid_refs(F.col("support_refs"), n), "r": valid_refs(F.col("refute_refs"), n), "r0": F.when(F.col("relation").isin("support", "refute", "insufficient"), F.col("relation")).otherwise("insufficient"), "c0": F.coalesce("confidence", F.lit(0.0))})
    conflict = (F.size("s") > 0) & (F.size("r") > 0)
    rows = rows.withColumn("conflict", conflict).withColumns({"r1": F.when(F.col("conflict"), "insufficient").otherwise(F.col("r0")), "c1": F.when(F.col("conflict"), F.least("c0", F.lit(0.45))).otherwise(F.col("c0"))})
    uncited = F.lit(cited) & ((F.col("r1") == "support") & (F.size("s") == 0) | (F.col("r1") == "refute") & (F.size("r") == 0))
    rows = rows.withColumn("uncited", uncited).withColumns({"r2": F.when(F.col("uncited"), "insufficient").otherwise(F.col("r1")), "c2": F.when(F.col("uncited"), F.least("c1", F.lit(0.35))).otherwise(F.col("c1"))})
    critical = (F.col("r2") == "support") & F.exists(F.coalesce("missing_slots", _empty()), lambda x: x.rlike(CRITICAL))
    rows = rows.withColumn("critical", critical).withColumns({"r3": F.when(F.col("critical"), "insufficient").otherwise(F.col("r2")), "c3": F.when(F.col("critical"), F.least("c2", F.lit(0.40))).otherwise(F.col("c2"))})
    supported = F.transform("s", lambda i: F.get("evidence_docs", i - 1))
    partial = (F.col("r3") == "support") & F.col("text").rlike(EVERY) & (F.size("doc_scope") > 1) & (F.size(F.array_except("doc_scope", supported)) > 0)
    rows = rows.withColumn("partial", partial).withColumns({"r4": F.when(F.col("partial"), "insufficient").otherwise(F.col("r3")), "c4": F.when(F.col("partial"), F.least("c3", F.lit(0.40))).otherwise(F.col("c3"))})
    bare = ~F.coalesce("sufficient", F.lit(False)) & (F.col("r4") == "support") & (F.size("s") == 0)
    lost = lambda refs, kept: F.size(F.coalesce(refs, _empty())) > F.size(kept)
    tags = _tags((lost("support_refs", "s"), "invalid_support_citation"), (lost("refute_refs", "r"), "invalid_refute_citation"), (F.col("conflict"), "support_refute_conflict"), (F.col("uncited"), "missing_relation_citation"), (F.col("critical"), "critical_evidence_slot_missing"), (F.col("partial"), "universal_claim_missing_doc_support"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(bare, F.least("c4", F.lit(0.40))).otherwise(F.col("c4"))))
    return rows.select("qid", "option", F.when(bare, "insufficient").otherwise(F.col("r4")).alias("relation"), confidence.alias("confidence"), F.col("s").alias("support"), F.col("r").alias("refute"), tags.alias("tags"))


def claim_sets(verdicts: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, answer, supported, refuted, insufficient, several_supported, none_supported, verify): the answer of each question by the
    relations of its options, and whether the set needs a check as a whole.

    ``verdicts`` has qid, option, relation, confidence; ``questions`` qid, answer_format, options.
    """
    letters = lambda relation: F.array_sort(F.collect_set(F.when(F.col("relation") == relation, F.col("option"))))
    best = lambda relation: F.min(F.when(F.col("relation") == relation, F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "option")))
    rows = verdicts.groupBy("qid").agg(letters("support").alias("supported"), letters("refute").alias("refuted"), letters("insufficient").alias("insufficient"), best("support").alias("s"), best("insufficient").alias("i")).join(questions.select("qid", "answer_format", "options"), "qid")
    multi = F.col("answer_format") == "multi"
    text = F.array_join(F.map_values("options"), " ")
    verify = multi | (F.size("insufficient") > 0) | (F.size("supported") != 1) | text.rlike(f"{EVERY}|{JOINED}|{NUMERIC}")
    answer = F.when(multi, F.array_join("supported", "")).otherwise(F.coalesce("s.option", "i.option", F.lit("")))
    return rows.select("qid", answer.alias("answer"), "supported", "refuted", "insufficient", (~multi & (F.size("supported") > 1)).alias("several_supported"), (multi & (F.size("supported") == 0)).alias("none_supported"), verify.alias("verify"))


def should_refine(sufficient: Column, relation: Column, confidence: Column, threshold: float) -> Column:
    return ~F.coalesce(sufficient, F.lit(False)) | (relation == "insufficient") | (F.coalesce(confidence, F.lit(0.0)) < threshold)


def risk_score(changed: Column, n_review: Column, tags: Column, disagree: Column, confidence: Column) -> Column:
    """A number to order reviews by."""
    weight = lambda t: F.coalesce(*[F.when(t == name, F.lit(w)) for name, w in RISKS.items()], F.lit(0.5))
    return F.round(F.when(changed, 3.0).otherwise(0.0) + F.least(F.lit(6.0), n_review * 1.5) + F.aggregate(tags, F.lit(0.0), lambda total, t: total + weight(t)) + F.when(disagree, 2.0).otherwise(0.0) + F.when(confidence < 0.6, 1.0).otherwise(0.0), 3)


def flipped(baseline: DataFrame, consensus: DataFrame) -> DataFrame:
    """(qid, answer): baseline answers with every option turned that all runs turned; a single choice must stay one letter.

    ``baseline`` has qid, answer, answer_format; ``consensus`` qid, option, unanimous.
    """
    turned = consensus.filter("unanimous").groupBy("qid").agg(F.collect_set("option").alias("t"))
    rows = baseline.join(turned, "qid", "left").withColumn("a", F.filter(F.split("answer", ""), lambda x: x != "")).withColumn("t", F.coalesce("t", _empty()))
    made = F.array_join(F.array_sort(F.array_union(F.array_except("a", "t"), F.array_except("t", "a"))), "")
    keep = (made == "") | F.col("answer_format").isin("mcq", "tf") & (F.length(made) != 1)
    return rows.select("qid", F.when(keep, F.col("answer")).otherwise(made).alias("answer"))


def inferred_correct(observed: Column, total: Column, tokens: Column, budget: int = 5_000_000) -> Column:
    """The number of right answers whose score is nearest to the observed one, the larger of two."""
    share = F.when(tokens <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - tokens) / budget)))
    error = lambda n: F.round(F.abs(100.0 * n / total * (0.7 + 0.3 * share) - observed), 9)
    return F.array_min(F.transform(F.sequence(F.lit(0), total), lambda n: F.struct(error(n).alias("e"), (-n).alias("n"))))["n"] * -1


def normalized_answer(answer: Column, answer_format: Column) -> Column:
    """Letters A to D in upper case: sorted and distinct for several, else the first."""
    letters = F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("[A-D]"), F.lit(0))
    return F.when(answer_format == "multi", F.array_join(F.array_sort(F.array_distinct(letters)), "")).otherwise(F.coalesce(F.get(letters, F.lit(0)), F.lit("")))


def facets(domain: Column) -> Column:
    """What evidence of a domain is expected to state."""
    return F.coalesce(*[F.when(domain == d, F.array(*map(F.lit, names))) for d, names in FACETS.items()], _empty())


def company_terms(title: Column) -> Column:
    """Companies of a title without the ending of their legal form."""
    ending = "(?:集团股份有限公司|股份有限公司|集团有限公司|有限公司|集团)"
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(f"[一-鿿A-Za-z]+{ending}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, f"(?<=.){ending}$", "")))


def focus(stem: Column) -> Column:
    """What a stem asks about, without its interrogative shell; the stem where nothing is left."""
    flat = F.regexp_replace(F.coalesce(stem, F.lit("")), "\\s+", "")
    bare = F.regexp_replace(flat, "^(?:根据|依据|结合).{0,80}?(?:，|,)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "(?:下列|以下)(?:说法|表述|选项)?(?:中)?(?:哪些|哪项|哪一项)?", ""), "(?:正确|错误|不正确|符合|不符合)(?:的|的是)?[？?]?$", "")
    bare = F.regexp_replace(bare, "^[，,：:；;？? ]+|[，,：:；;？? ]+$", "")
    return F.when(bare != "", bare).otherwise(flat)


def scope_gate(stem: Column) -> Column:
    """Whether a stem asks which things fall under a rule."""
    flat = F.regexp_replace(F.coalesce(stem, F.lit("")), "\\s+", "")
    verbs = "(?:需要|应当|可以|能够|属于|满足|适用|赔付|审批)"
    return flat.rlike(f"(?:哪些|哪项|哪一项).{{0,36}}{verbs}|{verbs}.{{0,36}}(?:哪些|哪项|情形|产品)")


def match_text(text: Column) -> Column:
    """A text without white space and thousands separators, commas in one form."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", ""), "，", ","), "(?<=[0-9]),(?=[0-9])", "")


def safe_decimal(value: Column) -> Column:
    """Number of an amount or share as written: 万 and 亿 count, other units and percent signs don't; null where it can't be read."""
    flat = F.trim(F.regexp_replace(value, "[,，]", ""))
    factor = F.when(flat.endswith("亿"), 100_000_000).when(flat.endswith("万"), 10_000).otherwise(1)
    bare = F.regexp_replace(F.regexp_replace(flat, "[亿万]$", ""), "[元%％]", "")
    return bare.try_cast("decimal(28,6)") * factor
