"""Quantities written in many units and notations, brought to the base unit of their metric.

The plan is pure SQL expressions: clean the notation, extract number and unit text, pick the unit (text of the value, unit
field, unit named in the context, base unit of the metric as source default), join the alias table, apply factor and offset.
The alias table and the metric table are constants of the trade (a few hundred rows at most, independent of the facts), so
Spark broadcasts them by their size; the facts are never shuffled except for dropping redelivered keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit spellings after alias_key(), with factor to the base unit.
SCALES = {"": 1.0, "百": 1e2, "千": 1e3, "万": 1e4, "十万": 1e5, "百万": 1e6, "千万": 1e7, "亿": 1e8, "十亿": 1e9}
ENGLISH_SCALES = {"": 1.0, "thousand": 1e3, "'000": 1e3, "k": 1e3, "million": 1e6, "mn": 1e6, "m": 1e6, "mm": 1e6, "billion": 1e9, "bn": 1e9}
# Units that a scale can stand before.
SCALED_UNITS = {
    "元": {"元": 1.0, "圆": 1.0},
    "平方米": {"平方米": 1.0, "平米": 1.0, "公顷": 1e4, "亩": 2000 / 3, "平方公里": 1e6, "平方千米": 1e6},
    "千瓦": {"千瓦": 1.0, "瓦": 1e-3, "兆瓦": 1e3, "吉瓦": 1e6},
    "吨": {"吨": 1.0, "公吨": 1.0, "千克": 1e-3, "公斤": 1e-3, "克": 1e-6, "斤": 5e-4},
    "千瓦时": {"千瓦时": 1.0, "度": 1.0, "兆瓦时": 1e3, "吉瓦时": 1e6},
    "公里": {"公里": 1.0, "千米": 1.0, "米": 1e-3, "里": 0.5, "厘米": 1e-5},
    "日": {"日": 1.0, "天": 1.0, "周": 7.0, "小时": 1 / 24},
}
PLAIN_UNITS = {
    "平方米": {"㎡": 1.0, "m²": 1.0, "m2": 1.0, "sqm": 1.0, "ha": 1e4, "km²": 1e6, "km2": 1e6},
    "千瓦": {"kw": 1.0, "mw": 1e3, "gw": 1e6},
    "吨": {"t": 1.0, "kg": 1e-3},
    "千瓦时": {"kwh": 1.0, "mwh": 1e3, "gwh": 1e6},
    "公里": {"km": 1.0, "m": 1e-3},
    "日": {"个自然日": 1.0, "自然日": 1.0, "个星期": 7.0, "星期": 7.0, "个小时": 1 / 24, "h": 1 / 24, "d": 1.0},
    "1": {"%": 1e-2, "百分之": 1e-2, "percent": 1e-2, "pct": 1e-2, "‰": 1e-3, "千分之": 1e-3, "万分之": 1e-4, "个基点": 1e-4, "基点": 1e-4, "bp": 1e-4, "bps": 1e-4, "成": 0.1, "倍": 1.0, "1": 1.0},
}
MISSING_UNITS = ["", "未标明", "-", "--", "无", "不详"]
FULL_WIDTH = "０１２３４５６７８９．，％（）：＋－−–—　 萬億負〇两兩＇’"
HALF_WIDTH = "0123456789.,%():+----  万亿-零二二''"
CHINESE_DIGITS, PLAIN_DIGITS = "零一二三四五六七八九", "0123456789"


def unit_aliases() -> list[tuple[str, str, float, float, float]]:
    """(alias, base_unit, factor, scale, offset) of every spelling, built by rule from the tables above.

    ``factor`` is that of the whole spelling, ``scale`` the part of it that is a scale word (10,000 of 万元, 1 of 千瓦).
    """
    rows: dict[str, tuple[str, float, float]] = {}
    for table in (SCALED_UNITS, PLAIN_UNITS):
        for base, units in table.items():
            rows.update({unit: (base, factor, 1.0) for unit, factor in units.items()})
    for base, units in SCALED_UNITS.items():
        for unit, factor in units.items():
            for scale, by in SCALES.items():
                rows.setdefault(scale + unit, (base, factor * by, by))
    for scale, by in SCALES.items():
        for unit in (f"人民币{scale}元", f"{scale}元人民币", f"人民币{scale}圆"):
            rows[unit] = ("元", by, by)
    for currency in ("rmb", "cny", "人民币"):
        for scale, by in ENGLISH_SCALES.items():
            rows[currency + scale] = ("元", by, by)
    return [(alias, base, factor, scale, 0.0) for alias, (base, factor, scale) in rows.items()]


def half_width(text: Column) -> Column:
    """Full-width digits and marks, minus signs and traditional scale characters in one form."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def alias_key(unit: Column) -> Column:
    """The form in which a unit is looked up: half width, lower case, without blanks."""
    return F.regexp_replace(F.lower(half_width(unit)), r"\s+", "")


def chinese_number(text: Column) -> Column:
    """Value of a Chinese numeral up to the hundred millions, decimals after 点; 0 for text without numerals."""
    whole, fraction = F.split_part(text, F.lit("点"), F.lit(1)), F.translate(F.split_part(text, F.lit("点"), F.lit(2)), CHINESE_DIGITS, PLAIN_DIGITS)
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("section"), F.lit(0.0).alias("digit"))

    def step(state: Column, mark: Column) -> Column:
        digit = F.instr(F.lit(CHINESE_DIGITS), mark) - 1
        unit = F.element_at(F.create_map(*[F.lit(x) for pair in {"十": 10.0, "百": 100.0, "千": 1000.0}.items() for x in pair]), mark)
        below = state["section"] + state["digit"]
        return (
            F.when(digit >= 0, F.struct(state["total"].alias("total"), state["section"].alias("section"), digit.cast("double").alias("digit")))
            .when(unit.isNotNull(), F.struct(state["total"].alias("total"), (state["section"] + F.greatest(state["digit"], F.lit(1.0)) * unit).alias("section"), F.lit(0.0).alias("digit")))
            .when(mark == "万", F.struct((state["total"] + below * 1e4).alias("total"), F.lit(0.0).alias("section"), F.lit(0.0).alias("digit")))
            .otherwise(F.struct(((state["total"] + below) * 1e8).alias("total"), F.lit(0.0).alias("section"), F.lit(0.0).alias("digit")))
        )

    value = F.aggregate(F.split(whole, ""), start, step, lambda state: state["total"] + state["section"] + state["digit"])
    return value + F.coalesce(F.concat(F.lit("0."), F.nullif(fraction, F.lit(""))).try_cast("double"), F.lit(0.0))


NUMBER = r"[0-9][0-9, ]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
CHINESE = "[零一二三四五六七八九十百千万亿]+(?:点[零一二三四五六七八九]+)?"
NEGATIVE = r"^[^0-9]*-|\(\s*-?(?:[0-9]|[零一二三四五六七八九十百千万亿])[^()]*\)"
UNIT_IN_TEXT = r"([A-Za-z]+(?:'000| (?:thousand|million|billion|mn|bn))?[²2]?|[%‰㎡]|[一-鿿]+)"


def parse_quantity(df: DataFrame, raw: str = "raw_value") -> DataFrame:
    """Add q_value, the signed number of the text, and q_written, what stands before or after it as its unit.

    Parentheses around the number make it negative; 约, 近, ≈ and other words of approximation are dropped.
    """
    empty = F.lit("")
    df = df.withColumn("q_clean", F.trim(F.regexp_replace(half_width(F.col(raw)), "[≈~]|大约|接近|约|近", "")))
    df = df.withColumns({"q_part": F.nullif(F.regexp_extract("q_clean", "(百分之|千分之|万分之)", 1), empty), "q_plain": F.regexp_replace("q_clean", "百分之|千分之|万分之", "")})
    df = df.withColumns({"q_digits": F.nullif(F.regexp_extract("q_plain", NUMBER, 0), empty), "q_spoken": F.nullif(F.regexp_extract("q_plain", CHINESE, 0), empty)})
    sign = F.when(F.col("q_plain").rlike(NEGATIVE), -1.0).otherwise(1.0)
    value = F.when(F.col("q_digits").isNotNull(), F.regexp_replace("q_digits", "[, ]", "").try_cast("double")).when(F.col("q_spoken").isNotNull(), chinese_number(F.col("q_spoken")))
    rest = F.when(F.col("q_digits").isNotNull(), F.regexp_replace("q_plain", "^[^0-9]*" + NUMBER, "")).otherwise(F.regexp_replace("q_plain", "^[^零一二三四五六七八九十百千万亿]*" + CHINESE, ""))
    before = F.when(F.col("q_digits").isNotNull(), F.regexp_replace(F.regexp_extract("q_plain", "^([^0-9]*)", 1), r"[-+(\s]", ""))
    unit = F.coalesce("q_part", F.nullif(alias_key(F.regexp_replace(rest, "[()]", "")), empty), F.nullif(alias_key(before), empty))
    return df.withColumns({"q_value": sign * value, "q_written": unit})


def unit_of_context(context: Column, metric: Column, raw: Column) -> Column:
    """Unit named in the text around a value: after 单位, in parentheses behind the metric, or next to the value itself."""
    text, number = half_width(context), F.trim(half_width(raw))
    named = F.regexp_extract(text, r"单位\s*:\s*" + UNIT_IN_TEXT, 1)
    behind_metric = F.regexp_extract(F.call_function("substring_index", text, metric, F.lit(-1)), r"^\s*\(" + UNIT_IN_TEXT + r"\)", 1)
    after = F.when(F.contains(text, number), F.call_function("substring_index", text, number, F.lit(-1)))
    in_brackets = F.regexp_extract(after, r"^\s*\(" + UNIT_IN_TEXT + r"\)", 1)
    before = F.regexp_extract(F.call_function("substring_index", text, number, F.lit(1)), "(百分之|千分之|万分之)$", 1)
    written = F.regexp_extract(after, r"^\s*" + UNIT_IN_TEXT + r"(?:[,。;\s]|$)", 1)
    found = [F.nullif(alias_key(x), F.lit("")) for x in (named, behind_metric, in_brackets, before, written)]
    return F.coalesce(*found)


def normalize_quantities(facts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Add ``base_value`` (double, in the metric's base unit) and ``unit_source`` to each fact.

    ``facts`` needs metric, raw_value, unit, context; ``metrics`` has metric, base_unit. Other columns pass through, names of
    this operator's own columns are replaced. Null or unreadable raw_value and unknown metric give a null ``base_value``, and so
    does a unit beside the number that is unknown or of another dimension, or such a unit field where no context names a unit.
    A scale without unit (``9.9万``) applies to the unit that the other places name, in place of a scale which that one has.
    """
    spark = facts.sparkSession
    # From Arrow it is a local relation of known size, which Spark broadcasts by itself.
    aliases = spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in zip(*unit_aliases())], ["q_alias", "q_base", "q_factor", "q_unit_scale", "q_offset"]))
    known = metrics.filter("metric is not null").dropDuplicates(["metric"]).select(F.col("metric").alias("q_metric"), F.col("base_unit").alias("q_base_unit"))
    own = ["base_value", "unit_source"]
    facts = facts.drop(*own)
    missing = lambda c: F.when(~alias_key(c).isin(MISSING_UNITS), alias_key(c))
    step = (
        parse_quantity(facts.join(known, facts["metric"] == F.col("q_metric"), "left"))
        .withColumn("q_scale", F.when(F.col("q_written").rlike("^(?:百万|千万|十万|十亿|百|千|万|亿)$"), F.col("q_written")))
        .withColumn("q_text", F.when(F.col("q_scale").isNull(), F.col("q_written")))
        .withColumn("q_field", missing(F.col("unit")))
        .withColumn("q_context", unit_of_context(F.col("context"), F.col("metric"), F.col("raw_value")))
    )
    for place in ("text", "field", "context"):
        side = aliases.select(*[F.col(f"q_{c}").alias(f"q_{place}_{c}") for c in ("alias", "base", "factor", "unit_scale", "offset")])
        step = step.join(side, (F.col(f"q_{place}") == F.col(f"q_{place}_alias")) & (F.col(f"q_{place}_base") == F.col("q_base_unit")), "left")
    of = lambda c, default: F.coalesce(*[F.col(f"q_{place}_{c}") for place in ("text", "field", "context")], F.lit(default))
    scale = F.coalesce(*[F.when(F.col("q_scale") == name, F.lit(by)) for name, by in SCALES.items() if name], of("unit_scale", 1.0))
    source = F.when(F.col("q_text_factor").isNotNull(), "text").when(F.col("q_field_factor").isNotNull(), "field").when(F.col("q_context_factor").isNotNull(), "context").otherwise("default")
    unknown = F.col("q_text").isNotNull() & F.col("q_text_factor").isNull() | F.col("q_field").isNotNull() & F.coalesce("q_text_factor", "q_field_factor", "q_context_factor").isNull()
    value = F.when(F.col("q_base_unit").isNotNull() & ~unknown, F.col("q_value") * (of("factor", 1.0) / of("unit_scale", 1.0)) * scale + of("offset", 0.0))
    return step.select(*[facts[c] for c in facts.columns], value.alias("base_value"), F.when(~unknown, source).alias("unit_source"))


def wrong_normalized_values(facts: DataFrame, metrics: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """fact_id of the facts whose normalized_value is given but off by more than ``tolerance`` from the computed value.

    A normalized_value that is no number counts as wrong; a fact whose value can't be computed doesn't. Redelivered rows count once.
    """
    stored = F.regexp_replace(F.trim("normalized_value"), ",", "")
    number = stored.try_cast("double")
    off = number.isNull() | (F.abs(number - F.col("base_value")) > F.abs(F.col("base_value")) * tolerance)
    return normalize_quantities(facts, metrics).filter((stored != "") & F.col("base_value").isNotNull() & off).select("fact_id").distinct()
