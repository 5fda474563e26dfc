"""Texts to parts: clauses, paragraphs, sentences, packed chunks, table rows, cleaned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import chunk_key, clause_of, dates, numbers, section_of, strip

# Starts of clauses, noise lines, check boxes.
CLAUSE_START = "(?m)(?=第[一二三四五六七八九十百千万0-9]+[章节条])|(?m)(?=^[0-9]+(?:\\.[0-9]+)+)"
NOISE_LINE = "^(?:目\\s*录|目次|第\\s*[0-9]+\\s*页.*|[0-9]{1,4}|.*\\.{4,}\\s*[0-9]+)$"
BOXES = "□☑√■☐"


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0)


def sentences(text: Column) -> Column:
    """Sentences, cut behind 。！？；;."""
    return _kept(F.split(text, "(?<=[。！？；;])"))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines; sentences where there is only one."""
    parts = _kept(F.split(text, "\n{2,}"))
    return F.when(F.size(parts) > 1, parts).otherwise(sentences(text))


def clauses(text: Column) -> Column:
    """Parts that begin with a clause number, what stands before the first as its own part; paragraphs where fewer than two begin."""
    parts = _kept(F.split(text, CLAUSE_START))
    starts = F.size(F.filter(parts, lambda x: x.rlike("^(?:第[一二三四五六七八九十百千万0-9]+[章节条]|[0-9]+(?:\\.[0-9]+)+)")))
    return F.when(starts >= 2, parts).otherwise(paragraphs(text))


def pack(parts: Column, most: int) -> Column:
    """Neighbouring parts joined by a blank line up to ``most`` characters; a longer part is cut every ``most``."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        closed = F.when(F.length(state["open"]) > 0, F.concat(state["out"], F.array(state["open"]))).otherwise(state["out"])
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(part) - 1) / most).cast("int")), lambda i: F.substring(part, i * most + 1, F.lit(most)))
        joined = F.when(F.length(state["open"]) > 0, F.concat(state["open"], F.lit("\n\n"), part)).otherwise(part)
        return (
            F.when(F.length(part) > most, F.struct(F.concat(closed, cuts).alias("out"), F.lit("").alias("open")))
            .when(F.length(state["open"]) + F.length(part) + 2 <= most, F.struct(state["out"].alias("out"), joined.alias("open")))
            .otherwise(F.struct(closed.alias("out"), part.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda s: F.when(F.length(s["open"]) > 0, F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]))


def chunk_pages(pages: DataFrame, most: int = 1800, by_clause: tuple[str, ...] = ("insurance", "regulatory")) -> DataFrame:
    """Chunk rows of pages (doc_id, domain, page, text): text, table and figure chunks with section, clause, numbers, dates.

    Text parts below 8 characters and tables and figures below 4 are left out. Tables are numbered from 1000, figures from 2000.
    """
    text = F.when(F.col("domain").isin(*by_clause), clauses(F.col("text"))).otherwise(paragraphs(F.col("text")))
    body = pages.select("doc_id", "domain", "page", F.posexplode(pack(text, most)).alias("idx", "body")).filter(F.length("body") >= 8).withColumn("chunk_type", F.lit("text"))
    out = body
    for column, first, kind in (("tables", 1000, "table"), ("figures", 2000, "figure")):
        if column in pages.columns:
            item = F.concat_ws("\n", F.nullif(F.col("item.caption"), F.lit("")), F.col("item.text") if column == "tables" else F.lit(None).cast("string"))
            rows = pages.select("doc_id", "domain", "page", F.posexplode(column).alias("idx", "item")).select("doc_id", "domain", "page", (F.col("idx") + first).alias("idx"), strip(item).alias("body"))
            out = out.unionByName(rows.filter(F.length("body") >= 4).withColumn("chunk_type", F.lit(kind)))
    return out.select(
        chunk_key(F.col("doc_id"), F.col("page"), F.col("idx"), F.col("body")).alias("chunk_id"), "doc_id", "domain", "page", "idx", "chunk_type",
        section_of(F.col("body")).alias("section"), clause_of(F.col("body")).alias("clause_id"), F.col("body").alias("text"), numbers(F.col("body")).alias("numbers"), dates(F.col("body")).alias("dates"),
    )


def table_row_texts(tables: DataFrame) -> DataFrame:
    """One text per data row of a table (table_id, caption, unit, header, rows): caption, unit and header repeated before its cells."""
    cell = lambda xs: F.array_join(F.transform(xs, lambda c: F.coalesce(c, F.lit(""))), " | ")
    rows = tables.select("table_id", "caption", "unit", "header", F.posexplode("rows").alias("row_no", "cells"))
    is_header = F.coalesce(cell(F.col("cells")) == cell(F.col("header")), F.lit(False))
    text = F.concat_ws("\n", F.nullif("caption", F.lit("")), F.concat(F.lit("单位："), F.nullif("unit", F.lit(""))), cell(F.col("header")), cell(F.col("cells")))
    return rows.filter(~is_header).select("table_id", "row_no", text.alias("text"))


def header_guess(rows: Column) -> Column:
    """The first row of a table, if fewer than half of its cells are numbers."""
    first = F.get(rows, F.lit(0))
    numeric = F.size(F.filter(first, lambda c: F.coalesce(c, F.lit("")).rlike("^[-+(（]?[0-9][0-9,.]*[%％)）]?$")))
    return F.when(numeric * 2 < F.size(first), first)


def clean_lines(text: Column) -> Column:
    """Without contents lines, page number lines and check boxes."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.translate(x, BOXES, ""))
    return F.array_join(F.filter(lines, lambda x: ~F.trim(x).rlike(NOISE_LINE)), "\n")


def html_text(page: Column) -> Column:
    """Readable text of an HTML page by a ladder of replacements: scripts and comments out, blocks to lines, tags out, entities."""
    for pattern, by in (("(?is)<(script|style|noscript)[^>]*>.*?</\\1>", ""), ("(?s)<!--.*?-->", ""), ("(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n"), ("<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("[ \\t]+", " "), ("\\s*\\n\\s*", "\n")):
        page = F.regexp_replace(page, pattern, by)
    return strip(page)


def document_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line) of every line of every page, numbered from 1."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "page", (F.col("n") + 1).alias("line_no"), "line")
