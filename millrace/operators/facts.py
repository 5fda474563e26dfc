"""Typed numeric facts: units, scopes, comparison across documents, growth within one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multipliers of the fact ledger, its units by family, and words for scopes.
MULTIPLIERS = {"元": 1, "千元": 1000, "百万元": 1000000, "万元": 10000, "万": 10000, "亿元": 100000000, "亿": 100000000, "%": 0.01, "％": 0.01, "倍": 1}
NARROW_SCOPES = ["quarter", "segment", "parent"]


# Metrics that a text fact can belong to, and its patterns.
KNOWN = ["经营活动产生的现金流量净额", "经营活动现金流净额", "归属于上市公司股东的净利润", "归母净利润", "营业收入", "净利润", "研发投入", "现金分红", "资产负债率", "每股收益", "发行规模", "票面利率", "保险金额", "赔付金额", "赔偿限额", "免赔额", "保费"]
TEXT_NUMBER, TEXT_UNIT = "[-+]?[0-9][0-9,，]*(?:\\.[0-9]+)?", "亿元|百万元|万元|千元|元|亿|万|%|％|倍"
TEXT_VALUE = f"[(（]\\s*{TEXT_NUMBER}\\s*[)）]\\s*(?:{TEXT_UNIT})?|{TEXT_NUMBER}\\s*(?:{TEXT_UNIT})?"
HEADER_UNIT = "(?:单位|币种)\\s*[:：]?\\s*(?:人民币)?\\s*(元|千元|万元|亿元|万|亿)"
RADIUS = 56


def ledger_value(raw: Column, unit: Column) -> Column:
    """Number of a value's text times its unit's multiplier, 1 for other units; parentheses make it negative; null without a number."""
    number = F.regexp_replace(F.regexp_extract(raw, "([0-9][0-9,，]*(?:\\.[0-9]+)?)", 1), "[,，]", "").try_cast("decimal(28,6)")
    sign = F.when(raw.rlike("^\\s*-|^\\s*[(（].*[)）]\\s*$"), -1).otherwise(1)
    factor = F.coalesce(*[F.when(unit == u, F.lit(m).cast("decimal(12,2)")) for u, m in MULTIPLIERS.items()], F.lit(1).cast("decimal(12,2)"))
    return (sign * number * factor).cast("decimal(38,6)")


def unit_family(unit: Column) -> Column:
    """ratio, multiple, per_share or money; any other unit is a family of its own, none is a scalar."""
    named = F.when(unit.isin("%", "％"), "ratio").when(unit == "倍", "multiple").when(unit == "元/股", "per_share").when(unit.isin("元", "千元", "百万元", "万元", "亿元", "万", "亿"), "money")
    return F.coalesce(named, F.nullif(unit, F.lit("")), F.lit("scalar"))


def scope_of(text: Column) -> Column:
    """quarter, segment, parent, consolidated or unknown, in this order."""
    return (
        F.when(text.rlike("分季度主要财务指标|第一季度|第二季度|第三季度|第四季度"), "quarter").when(text.rlike("某一单个客户|单一客户|分部信息|分地区|分行业|分产品"), "segment").when(text.rlike("母公司财务报表|母公司利润表|公司现金流量表"), "parent")
        .when(text.rlike("合并利润表|合并现金流量表|主要会计数据|合计"), "consolidated").otherwise("unknown")
    )


def text_facts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, metric, year, raw_value, unit, value, start, context, scope) of the numbers of chunks (chunk_id, doc_id, text).

    The unit stands behind the number, else in a unit line at the head of the text; a bare year is no fact. The metric is the longest
    that the characters around name, the year their last. Equal facts of a chunk count once, at their first place. A text is cut
    into values and what stands between them, so that the places of the values are sums of lengths.
    """
    flat = F.trim(F.regexp_replace("text", "\\s+", " "))
    parts = F.regexp_extract_all(flat, F.lit(f"({TEXT_VALUE}|[^0-9+(（-]+|(?s:.))"), F.lit(1))
    rows = chunks.filter("text is not null").select("chunk_id", "doc_id", flat.alias("t"), F.posexplode(parts).alias("i", "part"))
    before = F.sum(F.length("part")).over(Window.partitionBy("chunk_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0))).filter(F.col("part").rlike("^[(（]?\\s*[-+]?[0-9]"))
    raw, unit = F.regexp_extract("part", TEXT_NUMBER, 0), F.regexp_extract("part", f"({TEXT_UNIT})$", 1)
    rows = rows.withColumn("number", raw).withColumn("unit", F.when(unit != "", unit).otherwise(F.regexp_extract(F.substring("t", 1, 500), HEADER_UNIT, 1)))
    rows = rows.filter(~((F.col("unit") == "") & F.regexp_replace("number", ",", "").rlike("^(?:19|20)[0-9]{2}$")))
    left, right = F.greatest(F.col("start") - RADIUS, F.lit(0)), F.least(F.col("start") + F.length("part") + RADIUS, F.length("t"))
    rows = rows.withColumn("context", F.trim(F.substring("t", left.cast("int") + 1, (right - left).cast("int"))))
    named = F.array_min(F.transform(F.filter(F.array(*[F.struct(F.lit(-len(k)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KNOWN)]), lambda m: F.contains(F.col("context"), m["k"])), lambda m: m))
    years = F.regexp_extract_all("context", F.lit("(?:19|20)[0-9]{2}"), F.lit(0))
    negative = F.col("part").rlike("^[(（]") & ~F.startswith("number", F.lit("-"))
    value = F.regexp_replace("number", "[,，]", "").try_cast("decimal(28,6)") * F.when(negative, -1).otherwise(1)
    factor = F.coalesce(*[F.when(F.col("unit") == u, F.lit(m).cast("decimal(12,2)")) for u, m in MULTIPLIERS.items()], F.lit(1).cast("decimal(12,2)"))
    rows = rows.select("chunk_id", "doc_id", F.coalesce(named["k"], F.lit("未识别指标")).alias("metric"), F.coalesce(F.get(years, F.size(years) - 1), F.lit("")).alias("year"), F.col("number").alias("raw_value"), F.when(F.col("unit") == "", "未标明").otherwise(F.col("unit")).alias("unit"), (value * factor).cast("decimal(38,6)").alias("value"), "start", "context", scope_of(F.col("t")).alias("scope"))
    first = rows.filter("value is not null").groupBy("chunk_id", "doc_id", "metric", "year", "unit", "value").agg(F.min(F.struct("start", "raw_value", "context", "scope")).alias("f"))
    return first.select("chunk_id", "doc_id", "metric", "year", "f.raw_value", "unit", "value", "f.start", "f.context", "f.scope")


def usable(facts: DataFrame) -> DataFrame:
    """Distinct facts of the whole entity with a year and a value (base_value)."""
    return facts.filter(F.col("base_value").isNotNull() & (F.coalesce("year", F.lit("")) != "") & ~F.coalesce("scope", F.lit("unknown")).isin(NARROW_SCOPES)).dropDuplicates(["fact_id"])


def best_per(facts: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("quality_score"), "fact_id")
    return facts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def growth(facts: DataFrame) -> DataFrame:
    """(doc_id, metric, fact_new, fact_old, growth): the two latest years of each metric of a document, (new - old) / |old|."""
    best = best_per(usable(facts), ["doc_id", "metric", "year"])
    window = Window.partitionBy("doc_id", "metric").orderBy(F.desc("year"))
    pairs = best.withColumn("n", F.row_number().over(window)).withColumn("old", F.lead(F.struct("fact_id", "base_value")).over(window)).filter("n = 1 and old is not null")
    rate = F.try_divide(F.col("base_value") - F.col("old.base_value"), F.abs("old.base_value"))
    return pairs.select("doc_id", "metric", F.col("fact_id").alias("fact_new"), F.col("old.fact_id").alias("fact_old"), F.round(rate, 4).alias("growth")).filter("growth is not null")


def ranks_across_documents(facts: DataFrame) -> DataFrame:
    """(metric, year, doc_id, fact_id, n_lower, n_higher): each document's value against those of all others of its metric and year.

    The result says of each value how it compares with every other one without listing the pairs.
    """
    best = best_per(usable(facts), ["metric", "year", "doc_id"])
    up, down = Window.partitionBy("metric", "year").orderBy("base_value"), Window.partitionBy("metric", "year").orderBy(F.desc("base_value"))
    return best.select("metric", "year", "doc_id", "fact_id", (F.rank().over(up) - 1).alias("n_lower"), (F.rank().over(down) - 1).alias("n_higher"))


def calculate(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(operation, left_id, right_id, value, relation): compare, difference, ratio or growth_rate of two facts by id.

    An unknown id or operation gives no row, a zero divisor a null value.
    """
    side = lambda name: facts.select(F.col("fact_id").alias(f"{name}_id"), F.col("base_value").alias(name))
    both = wanted.join(side("left"), "left_id").join(side("right"), "right_id")
    a, b = F.col("left"), F.col("right")
    value = F.when(F.col("operation") == "difference", a - b).when(F.col("operation") == "ratio", F.try_divide(a, b)).when(F.col("operation") == "growth_rate", F.try_divide(a - b, F.abs(b)))
    relation = F.when(F.col("operation") == "compare", F.when(a > b, "gt").when(a < b, "lt").otherwise("eq"))
    return both.filter(F.col("operation").isin("compare", "difference", "ratio", "growth_rate")).select("operation", "left_id", "right_id", F.round(value, 6).alias("value"), relation.alias("relation"))
