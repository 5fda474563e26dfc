"""Metric rows of financial texts: metric, header, unit and cells of each line that states one, and numbers with their contexts.

A text's lines are an array, and what a line needs of its neighbours (the nearest header of the eight lines before, the nearest unit
of the ten before, values that stand one or two lines below) is looked up there: no line is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics and their spellings, patterns of values, headers and units.
METRICS = [
    ("归属于上市公司股东的净利润", ["归属于上市公司股东的净利润", "归母净利润", "母公司拥有人应占溢利"]),
    ("经营活动产生的现金流量净额", ["经营活动产生的现金流量净额", "经营活动现金流净额", "经营现金流净额"]),
    ("研发投入占营业收入比例", ["研发投入占营业收入比例", "研发费用占营业收入比例", "研发投入强度"]),
    ("研发投入", ["研发投入金额", "研发投入", "研发费用"]),
    ("营业收入", ["营业收入", "营业额"]),
    ("净利润", ["净利润"]),
    ("每股收益", ["基本每股收益", "稀释每股收益", "每股收益"]),
    ("每10股现金分红", ["每10股派息数", "每10股派发现金红利", "每10股派发现金红利人民币"]),
    ("每股现金分红", ["每股现金分红", "每股派息"]),
    ("现金分红金额", ["现金分红金额", "现金红利总额"]),
    ("资产负债率", ["资产负债率"]),
    ("总资产", ["总资产"]),
    ("归属于上市公司股东的净资产", ["归属于上市公司股东的净资产", "归属于母公司股东权益"]),
]
NUMBER = "[-+]?[0-9][0-9,，]*(?:\\.[0-9]+)?"
UNIT = "元/股|%|％|元|千元|百万元|万元|亿元|万|亿|倍"
VALUE = f"[(（]\\s*{NUMBER}\\s*[)）]\\s*(?:{UNIT})?|{NUMBER}\\s*(?:{UNIT})?"
LABEL = "20[0-9]{2}\\s*年(?:末|度)?|本年(?:末)?比上年(?:末)?增减|同比(?:增长|下降)?|变动比例"
UNIT_LINE = "(?:单位|币种)\\s*[:：]?\\s*(?:人民币)?\\s*(元/股|元|千元|百万元|万元|亿元)"
INLINE_UNIT = "[（(]\\s*(元/股|元|千元|百万元|万元|亿元|%|％)\\s*[）)]"
NARRATIVE = "金额为|约为|达到|均实现|同比上升|同比下降|同比增长|同比减少"


def metric_of(line: Column) -> Column:
    """(start, alias, metric, end) of the first metric of a line, the longest of those that start there; blanks within it count not."""
    found = []
    for metric, aliases in METRICS:
        for alias in aliases:
            pattern = "\\s*".join(alias)
            at = F.regexp_instr(line, F.lit(pattern))
            end = at + F.length(F.regexp_extract(line, pattern, 0))
            found.append(F.when(at > 0, F.struct(at.alias("start"), F.lit(-len(alias)).alias("less"), F.lit(alias).alias("alias"), F.lit(metric).alias("metric"), end.alias("end"))))
    return F.array_min(F.filter(F.array(*found), lambda m: m.isNotNull()))


def values_of(segment: Column) -> Column:
    """(raw_value, unit) of each value, a bare year being none; parentheses stay around a number that they make negative."""
    one = lambda x: F.struct(F.regexp_extract(x, NUMBER, 0).alias("n"), F.regexp_extract(x, f"({UNIT})$", 1).alias("unit"), x.rlike("^[(（]").alias("in_brackets"))
    made = F.transform(F.regexp_extract_all(segment, F.lit(f"({VALUE})"), F.lit(1)), one)
    kept = F.filter(made, lambda v: (v["unit"] != "") | ~F.regexp_replace(v["n"], ",", "").rlike("^20[0-9]{2}$"))
    raw = lambda v: F.when(v["in_brackets"] & ~F.startswith(v["n"], F.lit("-")), F.concat(F.lit("("), v["n"], F.lit(")"))).otherwise(v["n"])
    return F.transform(kept, lambda v: F.struct(raw(v).alias("raw_value"), v["unit"].alias("unit")))


def _last(items: Column, holds) -> Column:
    kept = F.filter(items, holds)
    return F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(""))


def metric_rows(texts: DataFrame, key: str, text: str = "text", most: int = 48, default_year: str = "") -> DataFrame:
    """(key, line_no, metric, raw_metric, header, unit, raw_row, cells) of each line that states a metric with values.

    Cells are (column, year, raw_value, unit). Lines are squeezed, empty ones don't count. The first of equal rows (metric, header,
    values) of a text stays, at most ``most`` a text. Null texts have none.
    """
    squeezed = lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))
    rows = texts.select(key, F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), squeezed), lambda x: x != "").alias("lines"))
    # Each line that may state a metric takes along only the few lines around it.
    states = "|".join("\\s*".join(a) for _, aliases in METRICS for a in aliases)
    around = lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.slice("lines", F.greatest(i - 10, F.lit(0)) + 1, F.least(i, F.lit(10))).alias("before"), F.get("lines", i + 1).alias("n1"), F.get("lines", i + 2).alias("n2"))
    rows = rows.select(key, F.explode(F.filter(F.transform("lines", around), lambda x: x["line"].rlike(states))).alias("x")).select(key, "x.*").withColumn("m", metric_of(F.col("line"))).filter("m is not null")
    end_mark = F.regexp_instr(F.substring("line", F.col("m.end"), F.length("line")), F.lit("[。；;]"))
    rows = rows.withColumn("r0", F.when(end_mark > 0, F.substring("line", F.lit(1), F.col("m.end") + end_mark - 1)).otherwise(F.col("line")))
    behind = lambda r: F.substring(r, F.col("m.end"), F.length(r))
    rows = rows.withColumn("v0", values_of(behind(F.col("r0"))))
    go1 = (F.size("v0") == 0) & F.col("n1").isNotNull() & ~F.col("n1").rlike(states)
    rows = rows.withColumn("r1", F.when(go1, F.concat_ws(" ", "r0", "n1"))).withColumn("v1", values_of(behind(F.col("r1"))))
    go2 = F.col("r1").isNotNull() & (F.size("v1") == 0) & F.col("n2").isNotNull() & ~F.col("n2").rlike(states)
    rows = rows.withColumn("r2", F.when(go2, F.concat_ws(" ", "r1", "n2"))).withColumn("v2", values_of(behind(F.col("r2"))))
    rows = rows.withColumn("raw_row", F.coalesce("r2", "r1", "r0")).withColumn("values", F.when(F.size("v0") > 0, F.col("v0")).when(F.size("v1") > 0, F.col("v1")).otherwise(F.coalesce("v2", "v0"))).filter(F.size("values") > 0)
    labels = lambda x: F.regexp_extract_all(x, F.lit(LABEL), F.lit(0))
    is_header = lambda x: (F.size(F.array_distinct(F.regexp_extract_all(F.array_join(labels(x), " "), F.lit("20[0-9]{2}"), F.lit(0)))) >= 2) | x.rlike("增减|变动比例")
    before = lambda n: F.slice("before", F.greatest(F.size("before") - n, F.lit(0)) + 1, F.lit(n))
    rows = rows.withColumn("header", F.when(F.col("raw_row").rlike(NARRATIVE), F.lit("")).otherwise(_last(before(8), is_header)))
    inline = F.regexp_extract("raw_row", INLINE_UNIT, 1)
    rows = rows.withColumn("own_unit", F.when(inline != "", inline).otherwise(F.regexp_extract(_last(before(10), lambda x: x.rlike(UNIT_LINE)), UNIT_LINE, 1)))
    rows = rows.withColumn("labels", labels(F.col("header"))).withColumn("years", F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "header", F.substring("raw_row", F.lit(1), F.col("m.start") - 1)), F.lit("20[0-9]{2}"), F.lit(0))))
    rows = rows.withColumn("years", F.when((F.size("years") == 0) & (F.lit(default_year) != ""), F.array(F.lit(default_year))).otherwise(F.col("years")))
    only = F.when(F.size("years") == 1, F.get("years", F.lit(0))).otherwise(F.lit(""))
    head_years = F.filter(F.transform("labels", lambda x: F.regexp_extract(x, "20[0-9]{2}", 0)), lambda y: y != "")
    rows = rows.withColumns({"only": only, "current": F.coalesce(F.get(head_years, F.lit(0)), only)})

    def cell(value: Column, i: Column) -> Column:
        label = F.coalesce(F.get("labels", i), F.lit(""))
        year = F.regexp_extract(label, "20[0-9]{2}", 0)
        year = F.when(year != "", year).when(label.rlike("增减|同比|变动"), F.col("current")).otherwise(F.col("only"))
        unit = F.when(value["unit"] != "", value["unit"]).when(F.col("own_unit") != "", F.col("own_unit")).otherwise(F.lit("未标明"))
        return F.struct(label.alias("column"), year.alias("year"), value["raw_value"].alias("raw_value"), unit.alias("unit"))

    rows = rows.withColumn("cells", F.transform("values", cell))
    found = F.struct("i", "m.alias", F.when(F.col("own_unit") == "", F.lit("未标明")).otherwise(F.col("own_unit")).alias("unit"), "raw_row", "cells")
    first = rows.groupBy(key, F.col("m.metric").alias("metric"), "header", F.transform("values", lambda v: v["raw_value"]).alias("raw")).agg(F.min(found).alias("f"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(key).orderBy("f.i"))
    return first.withColumn("n", order).filter(F.col("n") <= most).select(key, F.col("f.i").alias("line_no"), "metric", F.col("f.alias").alias("raw_metric"), "header", "f.unit", "f.raw_row", "f.cells")


def row_text(title: Column) -> Column:
    """A metric row as searchable text."""
    part = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(name + ": "), F.col(c)))
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.concat(F.lit("财务指标: "), "metric"), part("表头", "header"), part("单位", "unit"), F.concat(F.lit("原始行: "), "raw_row"))


def row_quality(scope: Column) -> Column:
    """How fit a metric row is for calculation: header, unit, cells, years and scope."""
    years = F.array_distinct(F.filter(F.transform("cells", lambda c: c["year"]), lambda y: y != ""))
    add = lambda when, value: F.when(when, value).otherwise(0.0)
    quality = F.lit(1.0) + add(F.col("header") != "", 1.5) + add(~F.col("unit").isin("", "未标明"), 1.0) + add(F.size("cells") >= 2, 0.75) + add(F.size(years) >= 2, 1.25) + add(scope == "consolidated", 1.0) - add(scope.isin("quarter", "segment", "parent"), 3.0)
    return F.round(quality, 3)
