import pytest
from pyspark.sql import functions as F

from millrace.operators.quantities import normalize_quantities, unit_aliases, wrong_normalized_values

FACTS = "fact_id string, metric string, raw_value string, unit string, normalized_value string, context string"
CASES = [
    ("保费", "729.78", "万元", "", 7297800.0), ("保费", "（34,486）", None, "（金额及数量单位:万元）保费 （34,486）", -344860000.0),
    ("保费", "60.27万元", "未标明", None, 602700.0), ("保费", "-993.7万", "元", None, -9937000.0), ("保费", "−四十一", "万元", None, -410000.0),
    ("保费", "七百八十五万一千六百一十九", "元", None, 7851619.0), ("保费", "约264274.22", "千元", None, 264274220.0), ("保费", "1.5e+3", "万元", None, 15000000.0),
    ("保费", "１，２３４．５", "萬元", None, 12345000.0), ("保费", "34355.09RMB'000", None, None, 34355090.0), ("保费", "12 345", "元", None, 12345.0),
    ("保费", "5 RMB million", "", None, 5e6), ("保费", "7", None, None, 7.0), ("保费", "3,915.7", "", "保费3,915.7万元，部分门店关闭", 39157000.0),
    ("毛利率", "5.06％", "未标明", None, 0.0506), ("毛利率", "百分之12.5", None, None, 0.125), ("毛利率", "36.1", None, "X2020年毛利率为百分之36.1，A", 0.361),
    ("毛利率", "68.4", "个基点", None, 0.00684), ("毛利率", "0.5", "成", None, 0.05), ("毛利率", "2.5", None, "毛利率（‰） 2020年 2.5", 0.0025),
    ("面积", "3", "亩", None, 2000.0), ("面积", "2.5万", "平方米", None, 25000.0), ("面积", "1", "km²", None, 1e6), ("期限", "36", "小时", None, 1.5), ("长度", "500", "m", None, 0.5),
    ("面积", "2万", "公顷", None, 2e8), ("容量", "3万", "兆瓦", None, 3e7), ("面积", "2万公顷", None, None, 2e8), ("面积", "三点五亩", None, None, 3.5 * 2000 / 3), ("保费", "9.9万", "万元", None, 99000.0),
    ("面积", "三点五万", "亩", None, 35000 * 2000 / 3), ("面积", "5英亩", None, None, None), ("面积", "5", "英亩", None, None), ("面积", "5", "英亩", "单位：亩 5", 5 * 2000 / 3),
    ("保费", None, "元", None, None), ("保费", "", "元", None, None), ("保费", "不详", None, None, None), ("没有的指标", "5", "元", None, None), ("保费", "5平方米", None, None, None),
]


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame([("保费", "元"), ("毛利率", "1"), ("面积", "平方米"), ("期限", "日"), ("长度", "公里"), ("容量", "千瓦")], "metric string, base_unit string")


def test_values(spark, metrics):
    facts = spark.createDataFrame([(str(i), m, r, u, None, c) for i, (m, r, u, c, _) in enumerate(CASES)], FACTS)
    got = {int(r["fact_id"]): r["base_value"] for r in normalize_quantities(facts, metrics).collect()}
    for i, (*case, want) in enumerate(CASES):
        assert got[i] == (None if want is None else pytest.approx(want, rel=1e-9)), case


def test_wrong_values_and_redelivery(spark, metrics):
    rows = [("a", "保费", "1", "万元", "10000", None), ("b", "保费", "1", "万元", "10011", None), ("b", "保费", "1", "万元", "10011", None), ("c", "保费", "1", "万元", "10009", None), ("d", "保费", "1", "万元", "", None), ("e", "保费", "1", "万元", None, None), ("f", "保费", "1", "万元", "-10000", None), ("g", None, "1", "万元", "5", None)]
    assert sorted(r[0] for r in wrong_normalized_values(spark.createDataFrame(rows, FACTS), metrics).collect()) == ["b", "f"]


def test_empty_and_clashing_columns(spark, metrics):
    empty = spark.createDataFrame([], FACTS)
    assert normalize_quantities(empty, metrics).count() == 0
    clash = spark.createDataFrame([("a", "保费", "1", "元", "1", None)], FACTS).withColumn("base_value", F.lit(9)).withColumn("base_unit", F.lit("x"))
    out = normalize_quantities(clash, metrics)
    assert out.columns.count("base_value") == 1 and out.first()["base_value"] == 1.0 and out.first()["base_unit"] == "x"


def test_aliases_are_unique_and_bounded():
    names = [a for a, *_ in unit_aliases()]
    assert len(names) == len(set(names)) < 400
