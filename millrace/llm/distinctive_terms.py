"""How characteristic each term is of each record, by graph of words.

A record is cut into words once (runs of letters and digits, Han characters in pairs from the start of their run). Its words and
the scored terms are the nodes of a graph; an edge joins a term to each of the ``window`` words before and behind the words that
an occurrence of it touches. A term weighs as much as it has distinct neighbours (not as often as it occurs), divided by a slight
penalty for long records, times the logarithm of its rarity in the collection:
degree / (1 - b + b * length / mean length) * ln((N + 1) / df).

Only the edges at the scored terms matter, so only those are built. One pass over each whole text finds all terms; what leaves a
record is one row for itself and a few (record, term) rows, from which the collection's statistics are aggregated.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4
LENGTH_PENALTY = 0.003
TERMS_PER_PASS = 200_000
WORD = re.compile("[A-Za-z0-9][A-Za-z0-9.,%]*|[㐀-鿿]{1,2}")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text, their starts and their ends."""
    words, starts, ends = [], [], []
    for match in WORD.finditer(text):
        words.append(match[0])
        starts.append(match.start())
        ends.append(match.end())
    return words, starts, ends


def graph(text: str, occurrences: list[tuple[int, int, int]], window: int) -> dict[int, tuple[int, set[str]]]:
    """{term: (occurrences, neighbours)} from the (term, begin, end) of every occurrence."""
    words, starts, ends = words_of(text)
    out: dict[int, tuple[int, set[str]]] = {}
    for term, begin, end in occurrences:
        # The words up to ``first`` end before the term, those from ``last`` on begin behind it.
        first, last = bisect_right(ends, begin), bisect_left(starts, end)
        around = words[max(0, first - window) : first] + words[last : last + window]
        if term in out:
            count, known = out[term]
            known.update(around)
            out[term] = count + 1, known
        else:
            out[term] = 1, set(around)
    return out


def _graph_rows(shared, begin: int, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value[begin : begin + TERMS_PER_PASS]
        automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            automaton.add_word(term, number)
        automaton.make_automaton()
        scan = automaton.iter if terms else lambda text: ()
        lengths = [len(t) for t in terms]
        for batch in batches:
            which, found, counts, degrees = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                which.append(row)
                found.append("")
                counts.append(0)
                degrees.append(0)
                met = [(term, last + 1 - lengths[term], last + 1) for last, term in scan(text)] if text else []
                for term, (count, neighbours) in graph(text, met, window).items() if met else ():
                    which.append(row)
                    found.append(terms[term])
                    counts.append(count)
                    degrees.append(len(neighbours - {terms[term]}))
            rows = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(found, pa.string()), pa.array(counts, pa.int32()), pa.array(degrees, pa.int32()), batch.column(2).take(rows)], ["key", "term", "occurrences", "degree", "length"])

    return rows


def term_scores(records: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, term, occurrences, degree, records_with_term, n_records, score) of every term that a record contains.

    ``records`` has key and text, ``terms`` has term; other columns are ignored. A term that a record doesn't contain has the
    score 0 there and no row. Rows with the same key are one record (redelivered); null keys are left out, null and empty texts
    count as records without terms. Null and empty terms are left out. Terms may overlap; each occurrence counts.

    The list of terms is a vocabulary, held by every worker in blocks of ``TERMS_PER_PASS``; each further block is a further pass.
    """
    records = records.filter("key is not null").select("key", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    kind = records.schema["key"].dataType.simpleString()
    wanted = [row["term"] for row in terms.filter("term is not null and term <> ''").select("term").distinct().orderBy("term").toLocalIterator()]
    shared = records.sparkSession.sparkContext.broadcast(wanted)
    made = None
    for begin in range(0, max(len(wanted), 1), TERMS_PER_PASS):
        rows = records.mapInArrow(_graph_rows(shared, begin, window), f"key {kind} not null, term string not null, occurrences int not null, degree int not null, length int not null")
        made = rows if made is None else made.unionByName(rows)
    # The rows of a record and term are held as one struct, and every use below takes the struct, so that all uses have the
    # same plan and the texts are read once. The row without a term (empty) stands for the record itself.
    hits = made.groupBy("key", "term").agg(F.min(F.struct("occurrences", "degree", "length")).alias("h"))
    rarity = hits.groupBy("term").agg(F.count("h").alias("records_with_term"), F.sum("h.length").alias("characters"))
    whole = rarity.agg(F.max(F.when(F.col("term") == "", F.struct(F.col("records_with_term").alias("n"), (F.col("characters") / F.col("records_with_term")).alias("mean")))).alias("w")).select("w").scalar()
    length = F.col("h.length") / F.greatest(whole["mean"], F.lit(1e-9))
    score = F.col("h.degree") / (1 - LENGTH_PENALTY + LENGTH_PENALTY * length) * F.log((whole["n"] + 1) / F.col("records_with_term"))
    scored = hits.join(rarity.select("term", "records_with_term"), "term")
    return scored.select("key", "term", "h.occurrences", "h.degree", "records_with_term", whole["n"].alias("n_records"), score.alias("score")).filter("occurrences > 0")
