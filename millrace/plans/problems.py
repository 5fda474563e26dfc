"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.quantities import normalize_quantities, wrong_normalized_values
from millrace.plans.registry import query
from millrace.sources.tables import table


def _half(x: str) -> str:
    return f"translate({x}, '０１２３４５６７８９．，％（）：＋－−–—　 萬億負〇两兩＇’', '0123456789.,%():+----  万亿-零二二''''')"


def _key(x: str) -> str:
    return f"regexp_replace(lower({_half(x)}), '\\s+', '', 'g')"


def _digit(x: str) -> str:
    return f"greatest(instr('零一二三四五六七八九', nullif({x}, '')) - 1, 0)"


def _section(x: str) -> str:
    """SQL of the value of a Chinese numeral below ten thousand."""
    places = [f"case when contains({x}, '{unit}') then greatest({_digit(f'''regexp_extract({x}, '([一二三四五六七八九]){unit}', 1)''')}, 1) * {by} else 0 end" for unit, by in (("千", 1000), ("百", 100), ("十", 10))]
    return "(" + " + ".join([*places, f"coalesce({_digit(f'''regexp_extract({x}, '([一二三四五六七八九])$', 1)''')}, 0)"]) + ")"


def _below_hundred_million(x: str) -> str:
    after = f"split_part({x}, '万', -1)"
    return f"(case when contains({x}, '万') then {_section(f'''split_part({x}, '万', 1)''')} * 10000 else 0 end + {_section(after)})"


def _spoken(x: str) -> str:
    whole = f"split_part({x}, '点', 1)"
    high = f"case when contains({whole}, '亿') then {_below_hundred_million(f'''split_part({whole}, '亿', 1)''')} * 100000000 else 0 end"
    fraction = f"coalesce(try_cast('0.' || nullif(translate(split_part({x}, '点', 2), '零一二三四五六七八九', '0123456789'), '') as double), 0)"
    return f"({high} + {_below_hundred_million(f'''split_part({whole}, '亿', -1)''')} + {fraction})::double"


_NUMBER = r"[0-9][0-9, ]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_CHINESE = "[零一二三四五六七八九十百千万亿]+(?:点[零一二三四五六七八九]+)?"
_UNIT = r"([A-Za-z]+(?:''000| (?:thousand|million|billion|mn|bn))?[²2]?|[%‰㎡]|[一-鿿]+)"

NORMALIZED = rf"""
    scales(scale, times) as (values ('', 1.0), ('百', 1e2), ('千', 1e3), ('万', 1e4), ('十万', 1e5), ('百万', 1e6), ('千万', 1e7), ('亿', 1e8), ('十亿', 1e9)),
    english(scale, times) as (values ('', 1.0), ('thousand', 1e3), ('''000', 1e3), ('k', 1e3), ('million', 1e6), ('mn', 1e6), ('m', 1e6), ('mm', 1e6), ('billion', 1e9), ('bn', 1e9)),
    chinese_units(unit, base, f) as (values ('元', '元', 1.0), ('圆', '元', 1.0), ('平方米', '平方米', 1.0), ('平米', '平方米', 1.0), ('公顷', '平方米', 1e4), ('亩', '平方米', 2000.0::double / 3), ('平方公里', '平方米', 1e6), ('平方千米', '平方米', 1e6),
      ('千瓦', '千瓦', 1.0), ('瓦', '千瓦', 1e-3), ('兆瓦', '千瓦', 1e3), ('吉瓦', '千瓦', 1e6), ('吨', '吨', 1.0), ('公吨', '吨', 1.0), ('千克', '吨', 1e-3), ('公斤', '吨', 1e-3), ('克', '吨', 1e-6), ('斤', '吨', 5e-4),
      ('千瓦时', '千瓦时', 1.0), ('度', '千瓦时', 1.0), ('兆瓦时', '千瓦时', 1e3), ('吉瓦时', '千瓦时', 1e6), ('公里', '公里', 1.0), ('千米', '公里', 1.0), ('米', '公里', 1e-3), ('里', '公里', 0.5), ('厘米', '公里', 1e-5), ('日', '日', 1.0), ('天', '日', 1.0), ('周', '日', 7.0), ('小时', '日', 1.0::double / 24)),
    plain_units(unit, base, f) as (values ('㎡', '平方米', 1.0), ('m²', '平方米', 1.0), ('m2', '平方米', 1.0), ('sqm', '平方米', 1.0), ('ha', '平方米', 1e4), ('km²', '平方米', 1e6), ('km2', '平方米', 1e6), ('kw', '千瓦', 1.0), ('mw', '千瓦', 1e3), ('gw', '千瓦', 1e6), ('t', '吨', 1.0), ('kg', '吨', 1e-3),
      ('kwh', '千瓦时', 1.0), ('mwh', '千瓦时', 1e3), ('gwh', '千瓦时', 1e6), ('km', '公里', 1.0), ('m', '公里', 1e-3), ('个自然日', '日', 1.0), ('自然日', '日', 1.0), ('个星期', '日', 7.0), ('星期', '日', 7.0), ('个小时', '日', 1.0::double / 24), ('h', '日', 1.0::double / 24), ('d', '日', 1.0),
      ('%', '1', 1e-2), ('百分之', '1', 1e-2), ('percent', '1', 1e-2), ('pct', '1', 1e-2), ('‰', '1', 1e-3), ('千分之', '1', 1e-3), ('万分之', '1', 1e-4), ('个基点', '1', 1e-4), ('基点', '1', 1e-4), ('bp', '1', 1e-4), ('bps', '1', 1e-4), ('成', '1', 0.1), ('倍', '1', 1.0), ('1', '1', 1.0)),
    money(unit, times) as (select '人民币' || scale || '元', times from scales union all select scale || '元人民币', times from scales union all select '人民币' || scale || '圆', times from scales union all select c || scale, times from english, (values ('rmb'), ('cny'), ('人民币')) as x(c)),
    spelled as (select unit as alias, base, f::double as f, 1.0::double as times, 0 as prio from chinese_units union all select unit, base, f, 1.0, 0 from plain_units union all select unit, '元', times, times, 0 from money union all select scale || unit, base, f * times, times, 1 from chinese_units, scales where scale <> ''),
    aliases as (select alias, base, arg_min(f, prio)::double as f, arg_min(times, prio)::double as times from spelled group by all),
    f0 as (select distinct fact_id, metric, raw_value, unit, context from numeric_facts),
    f1 as (select f0.*, base_unit, trim(regexp_replace({_half('raw_value')}, '[≈~]|大约|接近|约|近', '', 'g')) as clean from f0 left join metric_units using (metric)),
    f2 as (select *, nullif(regexp_extract(clean, '(百分之|千分之|万分之)', 1), '') as part, regexp_replace(clean, '百分之|千分之|万分之', '', 'g') as plain from f1),
    f3 as (select *, nullif(regexp_extract(plain, '{_NUMBER}'), '') as digits, nullif(regexp_extract(plain, '{_CHINESE}'), '') as spoken from f2),
    f4 as (select *, case when regexp_matches(plain, '^[^0-9]*-|\(\s*-?(?:[0-9]|[零一二三四五六七八九十百千万亿])[^()]*\)') then -1.0 else 1.0 end * case when digits is not null then try_cast(regexp_replace(digits, '[, ]', '', 'g') as double) when spoken is not null then {_spoken('spoken')} end as v,
      coalesce(part, nullif({_key(rf"regexp_replace(case when digits is not null then regexp_replace(plain, '^[^0-9]*{_NUMBER}', '') else regexp_replace(plain, '^[^零一二三四五六七八九十百千万亿]*{_CHINESE}', '') end, '[()]', '', 'g')")}, ''), case when digits is not null then nullif({_key(r"regexp_replace(regexp_extract(plain, '^([^0-9]*)', 1), '[-+(\s]', '', 'g')")}, '') end) as written,
      case when {_key('unit')} not in ('', '未标明', '-', '--', '无', '不详') then {_key('unit')} end as field, {_half('context')} as ct, trim({_half('raw_value')}) as num from f3),
    f5 as (select *, case when contains(ct, num) then split_part(ct, num, -1) end as tail from f4),
    f6 as (select *, coalesce(nullif({_key(rf"regexp_extract(ct, '单位\s*:\s*{_UNIT}', 1)")}, ''), nullif({_key(rf"regexp_extract(split_part(ct, metric, -1), '^\s*\({_UNIT}\)', 1)")}, ''), nullif({_key(rf"regexp_extract(tail, '^\s*\({_UNIT}\)', 1)")}, ''),
      nullif({_key(r"regexp_extract(split_part(ct, num, 1), '(百分之|千分之|万分之)$', 1)")}, ''), nullif({_key(rf"regexp_extract(tail, '^\s*{_UNIT}(?:[,。;\s]|$)', 1)")}, '')) as named, case when regexp_matches(written, '^(?:百万|千万|十万|十亿|百|千|万|亿)$') then written end as ws from f5),
    f7 as (select f6.*, x.f as xf, x.times as xb, y.f as yf, y.times as yb, z.f as zf, z.times as zb, s.times as own from f6 left join aliases x on x.alias = written and ws is null and x.base = base_unit left join aliases y on y.alias = field and y.base = base_unit left join aliases z on z.alias = named and z.base = base_unit left join scales s on s.scale = ws),
    f8 as (select *, coalesce(written is not null and ws is null and xf is null, false) or (field is not null and coalesce(xf, yf, zf) is null) as unknown from f7),
    normalized as (select fact_id, metric, case when base_unit is not null and not unknown then v * (coalesce(xf, yf, zf, 1.0) / coalesce(xb, yb, zb, 1.0)) * coalesce(own, xb, yb, zb, 1.0) end as base_value, case when not unknown then case when xf is not null then 'text' when yf is not null then 'field' when zf is not null then 'context' else 'default' end end as unit_source from f8)
"""


@query("p3_found", f"""with {NORMALIZED}, s as (select distinct fact_id, regexp_replace(trim(normalized_value), ',', '', 'g') as stored from numeric_facts)
    select distinct fact_id from s join normalized using (fact_id) where stored <> '' and base_value is not null and (try_cast(stored as double) is null or abs(try_cast(stored as double) - base_value) > abs(base_value) * 0.001)""")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    facts = table(spark, base, "numeric_facts", "fact_id", "metric", "raw_value", "unit", "normalized_value", "context")
    return wrong_normalized_values(facts, table(spark, base, "metric_units"))


@query("p3_normalized", f"with {NORMALIZED} select distinct fact_id, metric, round(base_value, 3) as base_value, unit_source from normalized")
def p3_normalized(spark: SparkSession, base: str) -> DataFrame:
    facts = table(spark, base, "numeric_facts", "fact_id", "metric", "raw_value", "unit", "context")
    return normalize_quantities(facts, table(spark, base, "metric_units")).select("fact_id", "metric", F.round("base_value", 3).alias("base_value"), "unit_source").distinct()
