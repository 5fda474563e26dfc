"""Small searchable children of chunks below parents that hold the context: text cut within clauses, one child for each table row.

Line rules and table rows are column expressions. Cutting text is a fold over its sentences (what is open decides what follows), so
it runs in Arrow batches, each text on its own. Only the last step, the first of equal children of a document, shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import nfkc, numbers, without_space

TARGET, MOST, LEAST = 360, 520, 48
# Forms of clause numbers, headings and noise lines, and the words that make a short text telling.
CHINESE_CLAUSE = "^第[一二三四五六七八九十百千万0-9]+[章节条款]"
OUTLINE = "^([0-9]{1,2}(?:\\.[0-9]{1,2}){1,4})(\\s+.*)$"
NO_OUTLINE = "^(?:%|％|元|千元|万元|亿元|万|亿|倍|[-+]?[0-9])"
HEADING = "^(?:第[一二三四五六七八九十百千万0-9]+[章节]|[一二三四五六七八九十百]+、|[（(][一二三四五六七八九十0-9]+[)）]|[0-9]{1,2}[、.)）])"
PAGE_NUMBER, LEADER = "^(?:第\\s*)?[0-9]{1,4}(?:\\s*页)?$", "(?:\\.{3,}|…{2,})\\s*[0-9]{1,4}\\s*$"
NUMERIC_CELL = "^[-+()（）]?[0-9][0-9,，]*(?:\\.[0-9]+)?(?:%|％|元|万元|亿元|万|亿)?$"
TELLING = "应当|不得|有权|审议|批准|责任|罚款|期限|保险金|营业收入|净利润|现金流|研发|分红|股息"
CONTENTS = "^(?:第[一二三四五六七八九十百千万0-9]+节\\s+.*|[一二三四五六七八九十]+、.*|[0-9]+(?:\\.[0-9]+)+.*)$"
BLOCKED = {"financial_contracts": "公司声明|重大事项提示|重大风险提示|释 义|释义", "financial_reports": "重要提示|本年度报告载有若干涉及本公司未来计划"}


def normal(flat: Column) -> Column:
    """A text in compatibility form (nfkc) with runs of blanks as one, none around line feeds, at most one empty line in a row."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(flat, F.lit("")), "[ \\t\\r\\f\\x0B 　]+", " "), " *\\n *", "\n")
    return F.regexp_replace(F.regexp_replace(flat, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def with_normal(rows: DataFrame, text: str, name: str = "normal") -> DataFrame:
    """Adds the normal form of a text; the compatibility form is a column of its own, so Python sees each text once."""
    return rows.withColumn("_flat", nfkc(text)).withColumn(name, normal(F.col("_flat"))).drop("_flat")


def strict_clause(text: Column) -> Column:
    """The clause number that the first line begins with: 第X条, or an outline number of parts from 1 to 30 before words; else empty."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    outline, rest = F.regexp_extract(line, OUTLINE, 1), F.trim(F.regexp_extract(line, OUTLINE, 2))
    small = F.forall(F.split(outline, "\\."), lambda v: v.try_cast("int").between(1, 30))
    return F.when(line.rlike(CHINESE_CLAUSE), F.regexp_extract(line, CHINESE_CLAUSE, 0)).when((outline != "") & small & ~rest.rlike(NO_OUTLINE), outline).otherwise(F.lit(""))


def telling(text: Column) -> Column:
    """Whether a short text says something by itself: a number, a clause, a heading or a key word."""
    return (F.size(numbers(text)) > 0) | (strict_clause(text) != "") | text.rlike(HEADING) | text.rlike(TELLING)


def cleaned(domain: Column, flat: Column, drop_contents: bool = True, drop_templates: bool = True) -> Column:
    """A normal text without lines of contents, of domain boilerplate and of check boxes."""
    keep = lambda text, holds: F.array_join(F.filter(F.split(text, "\n"), holds), "\n")
    if drop_contents:
        listed = lambda x: F.trim(x).rlike(CONTENTS) & (F.contains(x, F.lit("...")) | F.trim(x).rlike("^第[一二三四]节"))
        flat = keep(flat, lambda x: (F.trim(x) != "") & (F.trim(x) != "目录") & ~listed(x))
    if drop_templates:
        blocked = lambda x: F.coalesce(*[F.when(domain == d, F.trim(x).rlike(f"^(?:{p})")) for d, p in BLOCKED.items()], F.lit(False))
        flat = keep(flat, lambda x: ~blocked(x) & ~F.trim(x).rlike("(?i)^<!--\\s*image\\s*-->$"))
    bare = lambda x: F.trim(F.translate(x, "□■✓✔", ""))
    ticked = F.array_join(F.transform(F.filter(F.split(flat, "\n"), lambda x: ~bare(x).isin("适用 不适用", "是 否", "不适用", "适用")), lambda x: F.when(bare(x) != "", bare(x)).otherwise(x)), "\n")
    return normal(F.when(domain == "financial_reports", ticked).otherwise(flat))


def parents(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, page, section, clause_id, original_type, text) of the chunks that become parents: all but figures and metric
    rows. The clause is the strict one of the text, else the former one where it is spelled out."""
    legacy = F.when(F.startswith(F.coalesce("clause_id", F.lit("")), F.lit("第")), F.col("clause_id")).otherwise(F.lit(""))
    own = strict_clause(F.col("text"))
    rows = chunks.filter(~F.coalesce("chunk_type", F.lit("text")).isin("figure", "financial_metric_row"))
    return rows.select("chunk_id", "doc_id", "page", "section", F.when(own != "", own).otherwise(legacy).alias("clause_id"), F.coalesce("chunk_type", F.lit("text")).alias("original_type"), "text")


def table_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, idx, header, text) of each data row of a chunk's tables: caption, header and cells, numbered over its tables.

    ``chunks`` has chunk_id, doc_id, tables (array of texts) and, if there is one, caption. A first row of two cells or more of
    which fewer than half are numbers is the header. Rows of fewer than three characters, and repeated headers, are left out.
    """
    caption = F.coalesce("caption", F.lit("")) if "caption" in chunks.columns else F.lit("")
    rows = chunks.select("chunk_id", "doc_id", caption.alias("caption"), F.posexplode("tables").alias("t", "table"))
    rows = with_normal(rows, "table", "flat").withColumn("lines", F.filter(F.split("flat", "\n"), lambda x: x != "")).filter(F.size("lines") > 0)
    cells = F.filter(F.transform(F.split(F.get("lines", F.lit(0)), "\\|"), lambda c: F.trim(c)), lambda c: c != "")
    numeric = F.size(F.filter(cells, lambda c: c.rlike(NUMERIC_CELL)))
    rows = rows.withColumn("header", F.when((F.size(cells) >= 2) & (numeric < F.greatest(F.lit(1), F.floor(F.size(cells) / 2))), F.get("lines", F.lit(0))).otherwise(F.lit("")))
    data = F.when((F.col("header") != "") & (F.size("lines") > 1), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    kept = F.filter(data, lambda x: (F.length(x) >= 3) & ~((F.col("header") != "") & (x == F.col("header"))))
    part = lambda name, c: F.when(c != "", F.concat(F.lit(name + ": "), c))
    texts = F.transform(kept, lambda x: F.concat_ws("\n", part("表名", F.col("caption")), part("表头", F.col("header")), part("数据行", x)))
    made = rows.groupBy("chunk_id", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("t", F.transform(texts, lambda x: F.struct(F.col("header").alias("header"), x.alias("text"))).alias("rows")))), lambda x: x["rows"])).alias("rows"))
    return made.select("chunk_id", "doc_id", F.posexplode("rows").alias("idx", "r")).select("chunk_id", "doc_id", "idx", "r.header", "r.text")


_SENTENCE = re.compile("(?<=[。！？；;])")
_HEAD, _CLAUSE, _OUTLINE, _NO_OUTLINE = (re.compile(p) for p in (HEADING, CHINESE_CLAUSE, OUTLINE, NO_OUTLINE))
_PAGE, _LEADER = re.compile(PAGE_NUMBER), re.compile(LEADER)


def line_clause(line: str) -> str:
    """strict_clause of one line."""
    if found := _CLAUSE.match(line):
        return found[0]
    found = _OUTLINE.match(line)
    ok = found and all(1 <= int(v) <= 30 for v in found[1].split(".")) and not _NO_OUTLINE.match(found[2].strip())
    return found[1] if ok else ""


def noise(line: str) -> bool:
    bare = "".join(line.split())
    return bare in ("目录", "目次") or bool(_PAGE.match(bare)) or bool(_LEADER.search(line))


def units(text: str, section: str, clause: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text, section, clause, whether it begins a stretch) of the headings and sentences of a normal text; lines run together."""
    running: list[str] = []
    for line in [*map(str.strip, text.split("\n")), None]:
        begins = line is not None and bool(line) and not noise(line)
        own, head = (line_clause(line), bool(_HEAD.match(line)) and len(line) <= 100) if begins else ("", False)
        closes = line is None or bool(own) or head
        if begins and not closes:
            running.append(line)
            closes = line.endswith(("。", "！", "？", "；", ";"))
        if closes and running:
            yield from ((s, section, clause, False) for s in _SENTENCE.split("".join(running)) if s)
            running = []
        if own or head:
            section, clause = line if head else section, own or clause
            yield line, section, clause, True


def cut_long(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut behind the last mark of the second half where there is one."""
    out, at = [], 0
    while len(text) - at > most:
        mark = max(text.rfind(c, at, at + most) for c in "。；;，,")
        end = mark + 1 if mark > at + most // 2 else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) else out


def atoms(text: str, section: str = "", clause: str = "", target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[tuple[str, str, str]]:
    """(text, section, clause) of stretches of a normal text that cross no clause or heading: closed at ``target`` characters and
    before they pass ``most``; a tiny one joins the one before if both have the same place and fit."""
    stretches: list[tuple[str, str, str]] = []
    body, place = "", (section, clause)
    for unit, own_section, own_clause, begins in units(text, section, clause):
        if body and (begins or len(body + unit) > most):
            stretches.append((body, *place))
            body = ""
        if begins:
            place = (own_section or place[0], own_clause)
        body += unit
        if len(body) >= target:
            stretches.append((body, *place))
            body = ""
    stretches += [(body, *place)] if body else []
    out: list[tuple[str, str, str]] = []
    for whole, *where in stretches:
        for piece in cut_long(whole, most):
            if out and len(piece) < least and list(out[-1][1:]) == where and len(out[-1][0]) + len(piece) <= most:
                out[-1] = (out[-1][0] + piece, *where)
            else:
                out.append((piece, *where))
    return out


def _cut(target: int, most: int, least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("section", pa.string()), ("clause_id", pa.string())]))
        for batch in batches:
            made = [[dict(zip(("text", "section", "clause_id"), a)) for a in atoms(t or "", s or "", c or "", target, most, least)] for t, s, c in zip(*(batch.column(n).to_pylist() for n in ("normal", "section", "clause_id")))]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("doc_id"), pa.array(made, kind)], ["chunk_id", "doc_id", "atoms"])

    return cut


def children(chunks: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(child_id, doc_id, parent_id, kind, idx, section, clause_id, text): the searchable children of all parents.

    ``chunks`` has chunk_id, doc_id, page, section, clause_id, text, tables, chunk_type. Text below ``least`` characters stays only if it
    is telling. Of equal texts of a document (white space apart) the first by parent, kind and number stays. Null texts have none.
    """
    above = parents(chunks)
    flat = with_normal(above.filter("original_type <> 'table'"), "text").select("chunk_id", "doc_id", "normal", "section", "clause_id")
    cut = flat.mapInArrow(_cut(target, most, least), "chunk_id string, doc_id string, atoms array<struct<text: string, section: string, clause_id: string>>")
    text = cut.select("doc_id", F.col("chunk_id").alias("parent_id"), F.lit("atomic_text").alias("kind"), F.posexplode("atoms").alias("idx", "a")).select("doc_id", "parent_id", "kind", "idx", "a.section", "a.clause_id", "a.text")
    text = text.filter((F.length("text") >= least) | telling(F.col("text")))
    rows = table_rows(chunks.filter("chunk_type is null or chunk_type not in ('figure', 'financial_metric_row')"))
    rows = rows.join(above.select("chunk_id", F.coalesce(F.nullif("section", F.lit("")), F.lit("table")).alias("section"), strict_clause(F.col("text")).alias("clause_id")), "chunk_id")
    every = text.unionByName(rows.select("doc_id", F.col("chunk_id").alias("parent_id"), F.lit("table_row").alias("kind"), "idx", "section", "clause_id", "text"))
    every = every.withColumn("bare", without_space(F.col("text"))).filter("bare <> ''")
    first = every.groupBy("doc_id", "bare").agg(F.min(F.struct("parent_id", "kind", "idx", "section", "clause_id", "text")).alias("c")).select("doc_id", "c.*")
    key = F.substring(F.sha1(F.concat_ws(":", "parent_id", "kind", "text")), 1, 10)
    return first.select(F.concat_ws(":", "parent_id", F.concat(F.lit("a"), "idx"), key).alias("child_id"), "doc_id", "parent_id", "kind", "idx", "section", "clause_id", "text")
