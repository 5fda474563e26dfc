"""Scalar text functions as column expressions, so that they stay in generated code and allow pushdown."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of tokens, numbers, dates, clauses and headings.
TERM = "[a-z0-9_.%-]+|[一-鿿]+"
NUMBER = "[-+]?[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?\\s*(?:%|％|元|万元|亿元|万|亿)?"
DATE = "[0-9]{4}\\s*年\\s*[0-9]{1,2}\\s*月\\s*[0-9]{1,2}\\s*日|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
CLAUSE = "(?m)(第[一二三四五六七八九十百千万0-9]+[章节条]|^[0-9]+(?:\\.[0-9]+)+)"
HEADING = "^(?:第[一二三四五六七八九十百千万0-9]+[章节]|[一二三四五六七八九十]+、|[0-9]+(?:\\.[0-9]+)*\\s+).{0,80}$"

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "


def narrow(text: Column) -> Column:
    """Full-width ASCII and wide blanks in their plain form."""
    return F.translate(text, WIDE, NARROW)


def compact(text: Column) -> Column:
    """All runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(narrow(text), "\\s+", " "))


def strip(text: Column) -> Column:
    """Without white space (not only blanks) at the ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+", "")


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of ``low`` to ``high`` characters; the whole text where it is shorter than ``low``, nothing for an empty one."""
    runs = F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(text))), lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))
    return F.when(F.length(text) >= low, runs).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def term_runs(text: Column) -> Column:
    """Runs of ASCII word characters and runs of Han characters, lower case."""
    return F.regexp_extract_all(F.lower(narrow(F.coalesce(text, F.lit("")))), F.lit(f"({TERM})"), 1)


def tokenize(text: Column) -> Column:
    """Terms of a text: runs of ASCII word characters as they are, runs of Han characters as their n-grams of 2 to 4."""
    return F.flatten(F.transform(term_runs(text), lambda t: F.when(t.rlike("^[一-鿿]"), char_ngrams(t)).otherwise(F.array(t))))


def token_count(runs: Column) -> Column:
    """How many terms tokenize() makes of the runs of a text, without making them."""
    of = lambda t: F.when((t >= "一") & (F.length(t) > 1), F.length(t) - 1 + F.greatest(F.length(t) - 2, F.lit(0)) + F.greatest(F.length(t) - 3, F.lit(0))).otherwise(F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda total, t: total + of(t))


def token_rows(df: DataFrame, runs: str, *kept: str) -> DataFrame:
    """One row (kept columns, term) per term of the array column ``runs``: tokenize() as generators in compiled code, no lambdas."""
    each = df.select(*kept, F.explode(runs).alias("_run"))
    several = (F.col("_run") >= "一") & (F.length("_run") > 1)
    placed = each.select(*kept, "_run", F.explode(F.sequence(F.lit(1), F.when(several, F.length("_run") - 1).otherwise(F.lit(1)))).alias("_i"))
    gram = lambda n: F.when(several & (F.col("_i") + n - 1 <= F.length("_run")), F.substring("_run", F.col("_i"), F.lit(n)))
    return placed.select(*kept, F.explode(F.array(F.coalesce(gram(2), F.col("_run")), gram(3), gram(4))).alias("term")).filter("term is not null")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda x: F.trim(x))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({DATE})"), 1)


def clause_of(text: Column) -> Column:
    """The first clause number, or an empty string."""
    return F.regexp_extract(text, CLAUSE, 1)


def section_of(text: Column) -> Column:
    """The first of the first five lines that looks like a heading, or an empty string."""
    heads = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.trim(x)), lambda x: x.rlike(HEADING))
    return F.coalesce(F.get(heads, F.lit(0)), F.lit(""))


def chunk_key(doc_id: Column, page: Column, index: Column, text: Column) -> Column:
    """A stable key from document, page, position and text."""
    return F.concat_ws(":", F.substring(F.sha1(doc_id), 1, 8), F.concat(F.lit("p"), F.coalesce(page.cast("string"), F.lit("na"))), index.cast("string"), F.substring(F.sha1(text), 1, 10))


def slug(text: Column, default: str = "run") -> Column:
    """A name safe for paths."""
    squeezed = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(squeezed, "^[._-]+|[._-]+$", ""), F.lit("")), F.lit(default))


def is_han(text: Column) -> Column:
    return text.rlike("^[一-鿿]+$")


def plain_year(value: Column) -> Column:
    """A year without unit, which is no quantity."""
    return value.rlike("^(?:19|20)[0-9]{2}年?$")


def present(text: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that the text contains, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements of two arrays divided by all of both; 0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def margin_signature(line: Column) -> Column:
    """A line without white space and case, its digits as #."""
    return F.regexp_replace(F.lower(without_space(line)), "[0-9]+", "#")
