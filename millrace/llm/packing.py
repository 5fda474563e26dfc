"""Texts of varying length combined into containers of a fixed number of tokens, with little unused room.

Best-two-fit: a container is filled greedily, always with the largest text that fits. Then its smallest text is taken out again
if two texts that aren't packed yet fill the gap that leaves more tightly. A text above the capacity is split into full parts
and a rest; no other is split.

Tokens are counted where the texts are, in one pass; only (doc_id, part, tokens) rows are shuffled. They are dealt by hash into
groups of about GROUP items, each packed on its own: an open container per group is all that this costs, and no group grows
with the data or with a frequent source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP = 20_000
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that byte-level BPE vocabularies of this kind split words by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _count(ranks):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return count


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each text that isn't null, by the vocabulary file at ``vocabulary``, which the driver reads."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    return documents.filter("text is not null").select("doc_id", "text").mapInArrow(_count(shared), "doc_id long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are at most ``capacity``. Items of size 0 go into the first container."""
    order = np.argsort(-sizes, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for item in order[::-1]:
        stacks[sizes[item]].append(int(item))
    filled = np.array([bool(s) for s in stacks])
    filled[0] = False
    out = np.zeros(len(sizes), np.int64)

    def largest() -> np.ndarray:
        """For each room the largest size of an unpacked item that fits, 0 where none does."""
        return np.maximum.accumulate(np.where(filled, np.arange(capacity + 1), 0))

    def take(size: int) -> int:
        item = stacks[size].pop()
        if not stacks[size]:
            filled[size] = False
            below = fit[size - 1]
            fit[size:][fit[size:] == size] = below
        return item

    fit = largest()
    number = 0
    while fit[capacity]:
        room, inside = capacity, []
        while fit[room]:
            size = int(fit[room])
            inside.append((size, take(size)))
            room -= size
        if room and len(inside) > 1:
            small, item = inside[-1]  # sizes fall, so the last is the smallest
            gap = room + small
            first = np.nonzero(filled[: gap + 1])[0]
            second = fit[gap - first]
            second = np.where((second == first) & (np.array([len(stacks[s]) for s in first]) < 2), fit[np.maximum(np.minimum(gap - first, first - 1), 0)], second) if len(first) else second
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                best = int(total.argmax())
                a, b = int(first[best]), int(second[best])
                inside.pop()
                inside += [(a, take(a)), (b, take(b))]
                stacks[small].append(item)
                filled[small] = True
                fit = largest()
        for _, item in inside:
            out[item] = number
        number += 1
    return out


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "part"], ignore_index=True)
        number = best_two_fit(group["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"container": group["bucket"].to_numpy().astype(np.int64) * (1 << 32) + number, "doc_id": group["doc_id"], "part": group["part"], "n_tokens": group["n_tokens"]})

    return pack


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """(container, doc_id, part, n_tokens): which container holds which part of which text.

    Part p of a text covers its tokens from p * capacity on; a text within the capacity is the single part 0. Null texts are
    left out, empty ones are parts of 0 tokens. Rows that repeat a doc_id count once. Other columns are ignored.
    """
    sizes = token_counts(documents, vocabulary).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    last = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity)
    parts = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = parts.select("doc_id", F.col("part").cast("int").alias("part"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part") * capacity).alias("n_tokens"))
    n_groups = -(-documents.count() // group) or 1
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(n_groups)).cast("int"))
    return dealt.groupBy("bucket").applyInPandas(_pack(capacity), "container long, doc_id long, part int, n_tokens long")


def fill_of(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_parts, n_tokens, and the share of the room that is used."""
    total = packed.agg(F.countDistinct("container").alias("n_containers"), F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))
    return total.withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * capacity))
