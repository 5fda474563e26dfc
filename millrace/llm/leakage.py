"""Passages of held-out tests inside training documents.

Size-partitioned MinHash containment search. A partition by size makes containment of a short item in a long document
comparable by MinHash, because both sides of a comparison then have about one size. A leak may be as short as ``run`` characters,
whatever the sizes of item and document, so the partition is taken to its end: every text is the family of its windows of ``run``
characters that count, all of one size, each a set of ``run - shingle + 1`` shingles. The signature of a text is the set of the
MinHashes of its windows. Windows with the same content have the same MinHash, so a document that contains a window of an item
shares an entry with its signature and is always found; neighbouring windows mostly share theirs, so a signature is short. Texts
that share an entry are then verified by exact containment of a window.

Items are few against documents: while their signatures stay below a stated number of entries, the workers hold them, and a
document is searched and verified where it is read, without a shuffle. Beyond that signatures are joined, and only documents
that share an entry are sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import codepoints, owners, reading, rolling

RUN = 40
SHINGLE = 8
MOST_SHARED_CHARACTERS = 20_000_000  # of items; above it signatures are joined


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Minimum over every ``window`` neighbours, by doubling."""
    n = len(hashes) - window + 1
    if n <= 0:
        return hashes[:0]
    step, out = 1, hashes
    while step * 2 <= window:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[window - step : window - step + n])


def minhashes(texts: list[str | None], run: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, MinHash) of every distinct window of every text; null and short texts have none."""
    points, offsets = reading(*codepoints([t or "" for t in texts]))
    low = window_minima(rolling(points, shingle), run - shingle + 1)
    at, text = owners(offsets, run)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = low[at]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    return text[new], low[new].view(np.int64)


def _minhash_rows(key: str, run: int, shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            text, low = minhashes(texts, run, shingle)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(text)), pa.array(low)], [key, "minhash"])

    return rows


def windows(texts: DataFrame, key: str, run: int, shingle: int) -> DataFrame:
    """(key, minhash) of each window of each text; texts too short for a window have none."""
    kind = texts.schema[key].dataType.simpleString()
    return texts.filter(F.length("text") >= run).select(key, "text").mapInArrow(_minhash_rows(key, run, shingle), f"{key} {kind}, minhash long")


class Items:
    """Signatures and runs of the items, to search documents for."""

    def __init__(self, ids: list, texts: list[str], run: int, shingle: int):
        self.ids, self.texts, self.run, self.shingle = ids, [read_out(t) for t in texts], run, shingle
        self.minima = np.unique(minhashes(texts, run, shingle)[1])
        points, offsets = codepoints(self.texts)
        at, owner = owners(offsets, run)
        hashes = rolling(points, run)[at]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def search(self, texts: list[str | None]) -> tuple[list[int], list]:
        """(text number, item id) of every leak in a batch of texts."""
        numbers, found = [], []
        text, low = minhashes(texts, self.run, self.shingle)
        for number in np.unique(text[np.isin(low, self.minima)]).tolist():
            doc = read_out(texts[number])
            own = np.unique(rolling(codepoints([doc])[0], self.run))
            begin, end = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
            met = np.flatnonzero(begin < end)
            for item in sorted({int(x) for i in met for x in self.owner[begin[i] : end[i]]}):
                if contains(doc, self.texts[item], self.run):
                    numbers.append(number)
                    found.append(self.ids[item])
        return numbers, found


def _search(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = shared.value.search(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(numbers, pa.int32())), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return search


def _verify(run: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = batch.column("doc_text").to_pylist(), batch.column("item_text").to_pylist()
            yield batch.filter(pa.array([exact(doc, item, run) for doc, item in zip(docs, items)], pa.bool_())).select(["doc_id", "item_id"])

    return verify


def read_out(text: str) -> str:
    """Letters, digits and Han characters of a text, width and case dropped."""
    return reading(*codepoints([text]))[0].tobytes().decode("utf-32-le", "surrogatepass")


def contains(doc: str, item: str, run: int) -> bool:
    return any(item[i : i + run] in doc for i in range(len(item) - run + 1))


def exact(doc: str, item: str, run: int) -> bool:
    """Whether both texts share ``run`` characters that count in a row."""
    return contains(read_out(doc), read_out(item), run)


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, shingle: int = SHINGLE, most_shared: int = MOST_SHARED_CHARACTERS) -> DataFrame:
    """(doc_id, item_id) where document and item share a run of at least ``run`` letters, digits and Han characters.

    Null texts, and texts with fewer than ``run`` such characters, match nothing. Repeated rows give one pair. Other columns
    are ignored. Up to ``most_shared`` characters the items go to the workers; beyond it both sides' signatures are joined.
    """
    docs = documents.filter(F.length("text") >= run).select("doc_id", "text")
    tests = items.filter((F.length("text") >= run) & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    if (tests.agg(F.sum(F.length("text"))).first()[0] or 0) <= most_shared:
        rows = [(row["item_id"], row["text"]) for row in tests.toLocalIterator()]
        shared = documents.sparkSession.sparkContext.broadcast(Items([i for i, _ in rows], [t for _, t in rows], run, shingle))
        return docs.mapInArrow(_search(shared), "doc_id long, item_id long").distinct()
    hits = windows(docs, "doc_id", run, shingle).join(windows(tests, "item_id", run, shingle).distinct(), "minhash").select("doc_id", "item_id").distinct()
    met = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = met.withColumnRenamed("text", "doc_text").join(hits, "doc_id").join(tests.withColumnRenamed("text", "item_text"), "item_id")
    return pairs.select("doc_id", "item_id", "doc_text", "item_text").mapInArrow(_verify(run), "doc_id long, item_id long").distinct()
