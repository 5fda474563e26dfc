"""Oversized texts and tables cut into pieces below a limit, at natural boundaries.

Texts: a hierarchy of separators (section, paragraph, sentence, word, character) is applied recursively to whatever is still
too long, then the parts are packed greedily from the left. Each piece begins with the last ``overlap`` characters of the one
before it. Tables: rows are packed greedily and consecutive pieces share one row; a row above the limit is cut between its
cells, and a cell above the limit within itself.

Every record is cut on its own, in one pass and without a shuffle. Sizes are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, TEXT_OVERLAP, TABLE_LIMIT = 1800, 100, 1200
STRETCH = re.compile(r"[\n\f。！？；!?;]|\.(?= )")
LEVELS = (
    ("section", re.compile(r"\f|\n(?=\s*(?:第[一二三四五六七八九十百零〇0-9]+[编章节部]|[一二三四五六七八九十]+、|#{1,6} |\\section|==+ ))")),
    ("paragraph", re.compile(r"\n+")),
    ("sentence", re.compile(r"[。！？；!?;]+[”’」』）)\"]*|\.(?= )")),
    ("word", re.compile(r"[，,、：:]|\s+")),
)
WORD_LEVEL = 3
CLOSERS = "”’」』）)\""
PIECES = "key string, piece int, begin int, end int, cut string, hard boolean, text string"


def longest_stretch(text: str) -> int:
    """Length of the longest run of characters without a natural boundary."""
    longest = begin = 0
    for match in STRETCH.finditer(text):
        longest = max(longest, match.start() - begin)
        begin = match.end()
    return max(longest, len(text) - begin)


def atoms(text: str, begin: int, end: int, size: int, level: int = 0, deep: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, str]]:
    """(begin, end, level of its end) of parts of at most ``size`` characters that together are the text.

    The parts that no natural boundary could cut, which go down to words or characters, are added to ``deep``.
    """
    if end - begin <= size:
        yield begin, end, ""
        return
    if level == WORD_LEVEL and deep is not None:
        deep.append((begin, end))
    if level == len(LEVELS):
        for at in range(begin, end, size):
            yield at, min(at + size, end), "character" if at + size < end else ""
        return
    name, separator = LEVELS[level]
    last = begin
    for match in separator.finditer(text, begin, end):
        if match.end() > last:
            for a, b, cut in atoms(text, last, match.end(), size, level + 1, deep):
                yield a, b, cut or name
            last = match.end()
    if last < end:
        yield from atoms(text, last, end, size, level + 1, deep)


def cut_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> tuple[list[tuple[int, int, str]], bool]:
    """(begin, end, level of the cut at its end) of each piece, and whether a stretch above the limit had to be cut.

    A text within the limit is one piece. What had to be cut comes from the recursion: only parts that it brought down to words
    can hold such a stretch. A closing quote behind a boundary belongs to the part before, but to the stretch after it.
    """
    if len(text) <= limit:
        return [(0, len(text), "")], False
    pieces, begin, last, cut, deep = [], 0, 0, "", []
    for _, end, level in atoms(text, 0, len(text), limit - overlap, 0, deep):
        if end - begin > limit:
            pieces.append((begin, last, cut))
            begin = last - overlap
        last, cut = end, level
    hard = False
    for first, end in deep:
        while first and text[first - 1] in CLOSERS:
            first -= 1
        hard = hard or longest_stretch(text[first:end]) > limit
    return [*pieces, (begin, last, "")], hard


def split_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int, str]]:
    """(begin, end, level of the cut at its end) of each piece."""
    return cut_text(text, limit, overlap)[0]


def row_size(row: list | None) -> int:
    return sum(len(cell or "") + 1 for cell in row or [])


def cut_row(row: list, limit: int) -> list[list]:
    """A row above the limit in parts within it: between cells, and within a cell that alone is above it."""
    parts: list[list] = [[]]
    used = 0
    for cell in row:
        pieces = [cell] if len(cell or "") < limit else [cell[i : i + limit - 1] for i in range(0, len(cell), limit - 1)]
        for piece in pieces:
            if used + len(piece or "") + 1 > limit:
                parts.append([])
                used = 0
            parts[-1].append(piece)
            used += len(piece or "") + 1
    return parts


def split_rows(rows: list, limit: int = TABLE_LIMIT) -> list[tuple[int, int, bool, list]]:
    """(first row, end row, whether a row was cut, rows) of each piece; rows within the limit are one piece.

    Consecutive pieces share their border row, unless that row and the next one alone are above the limit.
    """
    if sum(map(row_size, rows)) <= limit:
        return [(0, len(rows), False, rows)]
    units = []
    for number, row in enumerate(rows):
        units += [(number, part, row_size(row) > limit) for part in (cut_row(row, limit) if row_size(row) > limit else [row])]
    pieces, piece, used = [], [], 0
    for unit in units:
        size = row_size(unit[1])
        if piece and used + size > limit:
            pieces.append(piece)
            piece = piece[-1:] if row_size(piece[-1][1]) + size <= limit else []
            used = sum(row_size(u[1]) for u in piece)
        piece = [*piece, unit]
        used += size
    pieces.append(piece)
    return [(p[0][0], p[-1][0] + 1, any(u[2] for u in p), [u[1] for u in p]) for p in pieces]


def _text_pieces(limit: int, overlap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                pieces, hard = cut_text(text, limit, overlap)
                out += [(key, i, a, b, cut, hard, text[a:b]) for i, (a, b, cut) in enumerate(pieces)]
            yield from _batches(out)

    return rows


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = ["key", "piece", "begin", "end", "cut", "hard", "text"]
    for at in range(0, len(rows), 5000):
        columns = list(zip(*rows[at : at + 5000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _table_pieces(limit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, table in zip(batch.column("key").to_pylist(), batch.column("rows").to_pylist()):
                hard = any(row_size(row) > limit for row in table)
                for i, (a, b, cut, part) in enumerate(split_rows(table, limit)):
                    text = "\n".join("\t".join(cell or "" for cell in row or []) for row in part)
                    out.append((key, i, a, b, "cell" if cut else "row", hard, text))
            yield from _batches(out)

    return rows


def split_texts(records: DataFrame, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """Pieces of each record's text: key, piece (from 0), begin, end (code points), cut, hard, text.

    ``cut`` is the level of the boundary at the piece's end, empty for the last; ``hard`` whether some stretch without a natural
    boundary is itself above the limit. Records with key and text; null texts have no piece, empty ones a single empty piece.
    Other columns are ignored; repeated rows are cut again.
    """
    if not 0 <= overlap * 2 <= limit:
        raise ValueError("the overlap must be at most half of the limit")
    return records.filter("text is not null").select(F.col("key").cast("string").alias("key"), "text").mapInArrow(_text_pieces(limit, overlap), PIECES)


def split_tables(records: DataFrame, limit: int = TABLE_LIMIT) -> DataFrame:
    """Pieces of each table's rows (array of arrays of cells), with the columns of split_texts; begin and end count rows.

    A row's size is the sum over its cells of length plus one, a null cell's length is 0. Cells are joined by tabs, rows by line
    feeds. Null tables have no piece, empty ones a single empty piece.
    """
    return records.filter("rows is not null").select(F.col("key").cast("string").alias("key"), "rows").mapInArrow(_table_pieces(limit), PIECES)


def needs(pieces: DataFrame) -> DataFrame:
    """(key, need): ``split`` for each record of more than one piece, also ``hard_cut`` where ``hard`` holds."""
    over = pieces.filter("piece = 1 or (piece = 0 and hard)")
    return over.select("key", F.explode(F.when(F.col("piece") == 1, F.array(F.lit("split"))).otherwise(F.array(F.lit("split"), F.lit("hard_cut")))).alias("need")).distinct()
