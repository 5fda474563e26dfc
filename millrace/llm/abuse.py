"""Abusive, hateful and sexual content, by compression distance.

A text resembles what a compressor knows if knowing it makes the text shorter. Ordinary text, and each category's text, make a
zstandard dictionary; the category dictionaries hold the ordinary text too, so that ordinary words around an insult cost the
same in both. A window (a sentence, or 120 characters of a longer one) that the category's dictionary makes shorter than the
ordinary one by more than a calibrated number of bytes counts for the category; a document scores by its best window.

Training takes a bounded sample of labelled documents (``MOST_DOCUMENTS``) and of any (``BACKGROUND_DOCUMENTS``): labels are per document, often wrong, so sentences
are sorted out first. Ordinary text is chosen greedily, most novel sentence first, from documents labelled free. Of the other
documents only sentences remain that the ordinary dictionary can't explain and that the other half of the documents with the
category can. Thresholds are calibrated on halves that didn't make the dictionary. Scoring covers every document, in one pass
without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abuse", "hate", "sexual")
MOST_DOCUMENTS = 4000
BACKGROUND_DOCUMENTS = 2000
MOST_SENTENCES = 12000
ORDINARY_BYTES, CATEGORY_BYTES = 1 << 16, 1 << 14
ORDINARY_LEANING, CATEGORY_LEANING = 0.7, 0.9
WINDOW, OVERLAP, SHORT, LEVEL = 120, 24, 24, 3
ENDS = re.compile(r"(?<=[。！？!?；;\n\f])(?![。！？!?；;\n\f])")
HAN, MARK = "[㐀-鿿]", r"[ \t.\-&*·_~|/\\+#@^=]"
HIDDEN = re.compile(f"{MARK}(?:(?<={HAN}{MARK})(?={HAN})|{MARK}(?<={HAN}{MARK}{MARK})(?={HAN}))")


def windows(text: str) -> list[str]:
    """Sentences of a text in plain form; marks put between characters to hide a word are dropped, long sentences overlap in windows."""
    out = []
    for sentence in ENDS.split(HIDDEN.sub("", text)):
        sentence = sentence.strip()
        if len(sentence) <= WINDOW:
            if len(sentence) > 1:
                out.append(sentence)
        else:
            out += [sentence[i : i + WINDOW] for i in range(0, len(sentence) - OVERLAP, WINDOW - OVERLAP)]
    return out


def plain(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


class Measure:
    """Compressed length of windows with a dictionary."""

    def __init__(self, content: bytes):
        known = zstandard.ZstdCompressionDict(content or b"-" * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self._compress = zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress

    def __call__(self, window: str) -> int:
        data = window.encode("utf-8", "replace")
        # A block of a few bytes is stored as it is; repeated, it is compressed, and only its first copy costs.
        return len(self._compress(data * 4 if len(window) < SHORT else data))


def choose_ordinary(sentences: list[str], size: int = ORDINARY_BYTES) -> bytes:
    """About ``size`` bytes of the sentences, the most novel first: each round adds those that are longest under the dictionary so far."""
    rest = sorted(set(sentences), key=lambda s: zlib.crc32(s.encode()))[:MOST_SENTENCES]
    chosen, used = [], 0
    while rest and used < size:
        measure = Measure("\n".join(chosen).encode())
        scored = sorted(((measure(s) / (len(s.encode()) + 8), s) for s in rest), reverse=True)
        step = 0
        added = set()
        for value, sentence in scored:
            if step > size // 12 or used > size or value < 0.35 and chosen:
                break
            chosen.append(sentence)
            added.add(sentence)
            step += len(sentence.encode()) + 1
            used += len(sentence.encode()) + 1
        if not added:
            break
        rest = [s for s in rest if s not in added]
    return "\n".join(reversed(chosen)).encode()


def half(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) & 1


def category_content(sentences: list[str]) -> bytes:
    """The sentences that occur most, distinct, the most frequent last (nearest to the data), within CATEGORY_BYTES."""
    out, used = [], 0
    for sentence, _ in sorted(Counter(sentences).items(), key=lambda x: (-x[1], x[0])):
        if used + len(sentence.encode()) > CATEGORY_BYTES:
            break
        out.append(sentence)
        used += len(sentence.encode()) + 1
    return "\n".join(reversed(out)).encode()


def leanings(texts: dict[int, list[str]], marked: set[int]) -> dict[str, float]:
    """For each run of three characters the log of its share of marked documents against its share of the others."""
    with_, without = Counter(), Counter()
    for doc, sentences in texts.items():
        grams = {s[i : i + 3] for s in sentences for i in range(max(1, len(s) - 2))}
        (with_ if doc in marked else without).update(grams)
    n, m = len(marked) or 1, (len(texts) - len(marked)) or 1
    of = {g: math.log((with_[g] + 0.5) / (n + 1)) - math.log((without[g] + 0.5) / (m + 1)) for g in with_.keys() | without.keys()}
    # What one document has, a name or a number, says nothing where there are many documents, and little where there are few.
    alone = max(0.0, 0.8 - n / 50)
    return {g: x if with_[g] > 1 or x < 0 else x * alone for g, x in of.items()}


def leaning(sentence: str, of: dict[str, float]) -> float:
    values = [of.get(sentence[i : i + 3], 0.0) for i in range(max(1, len(sentence) - 2))]
    return sum(values) / len(values)


def train(rows: list[tuple[int, str, dict[str, int]]], background: list[tuple[int, str]] = ()) -> dict:
    """Dictionaries and thresholds from (doc_id, text, labels by category) and some (doc_id, text) without labels.

    The unlabelled ones count as free: what is frequent in the collection is ordinary, however few labels there are.
    """
    split = {doc: windows(plain(text)) for doc, text in [*background, *[(doc, text) for doc, text, _ in rows]]}
    labelled = {doc for doc, _, _ in rows}
    free = [doc for doc, _, labels in rows if not any(labels.values())] + [doc for doc, _ in background if doc not in labelled]
    marked = {k: {doc for doc, _, labels in rows if labels.get(k)} for k in CATEGORIES}
    lean = leanings(split, set(split) - set(free))
    # Wrongly judged documents put some abuse among the free ones: what is much more common in marked documents isn't ordinary.
    ordinary = choose_ordinary([s for doc in free for s in split[doc] if leaning(s, lean) < ORDINARY_LEANING])
    base = Measure(ordinary)
    own = {k: leanings(split, marked[k]) for k in CATEGORIES}
    kept: dict[str, dict[int, list[str]]] = {}
    for k in CATEGORIES:
        kept[k] = {}
        for doc in marked[k]:
            leans = [{j: leaning(s, own[j]) for j in CATEGORIES} for s in split[doc]]
            kept[k][doc] = [s for s, x in zip(split[doc], leans) if x[k] >= max(CATEGORY_LEANING, max(x.values()) - 0.2) and base(s) >= 0.4 * len(s.encode())]
    contents: dict[str, bytes] = {}
    for _ in range(2):
        contents = {k: category_content([s for ss in kept[k].values() for s in ss]) for k in CATEGORIES}
        others = {k: {side: Measure(ordinary + b"\n" + category_content([s for doc, ss in kept[k].items() if half(doc) != side for s in ss])) for side in (0, 1)} for k in CATEGORIES}
        for k in CATEGORIES:
            for doc, sentences in kept[k].items():
                lengths = [{j: others[j][half(doc)](s) for j in CATEGORIES} for s in sentences]
                # A sentence of a document with several categories, or with a wrong one, goes where the other half of the documents explains it best.
                kept[k][doc] = [s for s, x in zip(sentences, lengths) if x[k] <= min(x.values()) + 1]
    contents = {k: category_content([s for ss in kept[k].values() for s in ss]) for k in CATEGORIES}
    thresholds = {}
    for k in CATEGORIES:
        gains = [(max((window_gain(base(s), others[k][half(doc)](s), s) for s in split[doc]), default=0.0), bool(labels.get(k))) for doc, _, labels in rows]
        thresholds[k] = best_threshold(gains)
    return {"ordinary": ordinary, "contents": contents, "thresholds": thresholds}


def window_gain(ordinary: int, category: int, window: str) -> float:
    """Share of the window's bytes that the category's dictionary saves against the ordinary one."""
    size = len(window) * 3 if not window.isascii() else len(window)
    return max(0, ordinary - category) / (size + 12)


def best_threshold(gains: list[tuple[float, bool]], least: float = 0.12) -> float:
    """The threshold with the best F1 on (gain, label); ``least`` where there is nothing to calibrate on."""
    total = sum(label for _, label in gains)
    best, value, hits, taken = least, 0.0, 0, 0
    gains = sorted(gains, reverse=True)
    for i, (gain, label) in enumerate(gains):
        taken += 1
        hits += label
        f1 = 2 * hits / (taken + total) if total else 0.0
        following = gains[i + 1][0] if i + 1 < len(gains) else 0.0
        if gain >= least and f1 > value and following < gain:
            best, value = (gain + max(following, least)) / 2, f1
    return best


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, contents, thresholds = (model.value[x] for x in ("ordinary", "contents", "thresholds"))
        base = Measure(ordinary)
        either = Measure(ordinary + b"\n" + b"\n".join(contents[k] for k in CATEGORIES))
        each = {k: Measure(ordinary + b"\n" + contents[k]) for k in CATEGORIES}
        least = min(thresholds.values()) / 2
        for batch in batches:
            out: dict[str, list] = {k: [] for k in CATEGORIES}
            for text in batch.column(1).to_pylist():
                best = dict.fromkeys(CATEGORIES, 0.0)
                for window in windows(plain(text or "")):
                    known = base(window)
                    if window_gain(known, either(window), window) < least:
                        continue
                    gains = {k: window_gain(known, each[k](window), window) for k in CATEGORIES}
                    top = max(gains.values())
                    for k, gain in gains.items():
                        if gain == top or gain > 0.9 * top:
                            best[k] = max(best[k], gain)
                for k in CATEGORIES:
                    out[k].append(best[k] / thresholds[k])
            kept = range(2, batch.num_columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], pa.float64()) for k in CATEGORIES], *[batch.column(i) for i in kept]], ["doc_id", *CATEGORIES, *[batch.schema.names[i] for i in kept]])

    return score


def training_rows(documents: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS) -> list[tuple[int, str, dict[str, int]]]:
    """At most ``most`` labelled documents, those with a category first, in the order of a hash of their id; conflicting judgements count by majority."""
    votes = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.avg(k).alias(k) for k in CATEGORIES])
    judged = votes.select("doc_id", *[F.when(F.col(k) > 0.5, 1).when(F.col(k) < 0.5, 0).alias(k) for k in CATEGORIES]).filter(" and ".join(f"{k} is not null" for k in CATEGORIES))
    marked = F.greatest(*CATEGORIES)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    wanted = judged.filter(marked == 1).orderBy(order).limit(most // 2).unionByName(judged.filter(marked == 0).orderBy(order).limit(most // 2))
    found = documents.filter("text is not null").select("doc_id", "text").join(wanted, "doc_id")
    return sorted((row["doc_id"], row["text"], {k: row[k] for k in CATEGORIES}) for row in found.toLocalIterator())


def background_rows(documents: DataFrame, most: int = BACKGROUND_DOCUMENTS) -> list[tuple[int, str]]:
    """About ``most`` documents, those whose hash falls in the right share."""
    share = -(-documents.count() // most) or 1
    chosen = documents.filter((F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0) & F.col("text").isNotNull()).select("doc_id", "text")
    return sorted((row["doc_id"], row["text"]) for row in chosen.toLocalIterator())


def score_documents(documents: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS, background: int = BACKGROUND_DOCUMENTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, abuse, hate, sexual) of every document: its best window's gain for the category in units of the threshold.

    1 or more means the category was found. Null and empty texts score 0. Without labels of a category nothing reaches its
    threshold. Repeated rows are scored again. The columns of ``documents`` named by ``carry`` go along.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(training_rows(documents, labels, most), background_rows(documents, background)))
    rows = documents.select("doc_id", "text", *carry)
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(_score(model), "doc_id long, abuse double, hate double, sexual double" + kinds)


def found_categories(scores: DataFrame) -> DataFrame:
    """(doc_id, category) for each score of 1 or more."""
    return scores.select("doc_id", F.explode(F.array(*[F.when(F.col(k) >= 1, F.lit(k)) for k in CATEGORIES])).alias("category")).filter("category is not null").distinct()


def source_rates(scores: DataFrame) -> DataFrame:
    """(source, n_documents, abuse_rate, hate_rate, sexual_rate) of scores that carry their source; a null source is a source of its own.

    A repeated row of a document counts once, also where its source is repeated with it.
    """
    once = scores.groupBy("doc_id", "source").agg(*[F.max(k).alias(k) for k in CATEGORIES])
    rates = [F.avg((F.col(k) >= 1).cast("double")).alias(f"{k}_rate") for k in CATEGORIES]
    return once.groupBy("source").agg(F.count("*").alias("n_documents"), *rates)
