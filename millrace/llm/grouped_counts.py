"""Counts over the whole collection of what each group of records asks for, without a vocabulary that one place must hold.

Records are dealt into groups. A group lists the entries that it has or asks about, as 64-bit hashes with its own counts, and
sends each bucket of hashes its part. A bucket adds up the counts of all groups and answers each group with the totals of those
entries which it listed. A group then holds totals for its own records only; nothing grows with the collection but the number of
groups, and there are never more rows than entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

ANSWER = "g int, bucket int, entries binary, totals binary"


def entry_hash(kind: str, entry: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x1f{entry}".encode("utf-8", "surrogatepass"))


class Totals:
    """Totals by kind and entry; what wasn't answered, or stays below ``least``, is 0. ``totals[kind].get(entry, 0)``."""

    def __init__(self, answers: pa.Table, least: int):
        self._of: dict[int, int] = {}
        self._kinds: dict[str, _Kind] = {}
        for entries, totals in zip(answers["entries"].to_pylist(), answers["totals"].to_pylist()):
            self._of.update((e, n) for e, n in zip(np.frombuffer(entries, "<u8").tolist(), np.frombuffer(totals, "<i8").tolist()) if n >= least)

    def __getitem__(self, kind: str) -> _Kind:
        if kind not in self._kinds:
            self._kinds[kind] = _Kind(self._of, kind)
        return self._kinds[kind]


class _Kind:
    """Totals of one kind. ``known`` is for what users derive from them, once for each entry."""

    __slots__ = ("_kind", "_of", "_met", "known")

    def __init__(self, of: dict[int, int], kind: str):
        self._of, self._kind, self._met, self.known = of, kind, {}, {}

    def get(self, entry: str, default: int = 0) -> int:
        found = self._met.get(entry)
        if found is None:
            found = self._met[entry] = self._of.get(entry_hash(self._kind, entry), default)
        return found


class Asked:
    """Stands in for Totals to learn what is asked: every answer is 0, and every question is noted."""

    def __init__(self, noted: Counter):
        self._noted = noted
        self._kinds: dict[str, _Note] = {}

    def __getitem__(self, kind: str) -> _Note:
        if kind not in self._kinds:
            self._kinds[kind] = _Note(self._noted, kind)
        return self._kinds[kind]


class _Note:
    __slots__ = ("_kind", "_noted", "_met", "known")

    def __init__(self, noted: Counter, kind: str):
        self._noted, self._kind, self._met, self.known = noted, kind, set(), {}

    def get(self, entry: str, default: int = 0) -> int:
        if entry not in self._met:
            self._met.add(entry)
            self._noted[self._kind, entry] += 0
        return default


def _lists(list_: Callable[[pa.Table], Counter], buckets: int):
    def rows(group: pa.Table) -> pa.Table:
        noted = list_(group)
        hashes = np.fromiter((entry_hash(*e) for e in noted), np.uint64, len(noted))
        own = np.fromiter(noted.values(), np.int64, len(noted))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hashes, own, bucket = hashes[order], own[order], bucket[order]
        which, begin = np.unique(bucket, return_index=True)
        ends = [*begin[1:], len(bucket)]
        made = [(hashes[i:j].tobytes(), own[i:j].tobytes()) for i, j in zip(begin, ends)]
        return pa.table({"g": pa.array([group["g"][0].as_py()] * len(which), pa.int32()), "bucket": pa.array(which, pa.int32()), "entries": pa.array([e for e, _ in made], pa.binary()), "totals": pa.array([n for _, n in made], pa.binary())})

    return rows


def _answers(least: int):
    def rows(bucket: pa.Table) -> pa.Table:
        parts = [np.frombuffer(e, "<u8") for e in bucket["entries"].to_pylist()]
        known, which = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate([np.frombuffer(n, "<i8") for n in bucket["totals"].to_pylist()])
        total = np.zeros(len(known), np.int64)
        np.add.at(total, which, own)
        ends = np.cumsum([len(p) for p in parts])
        entries, totals = [], []
        for part, end in zip(parts, ends):
            found = total[which[end - len(part) : end]]
            entries.append(part[found >= least].tobytes())
            totals.append(found[found >= least].tobytes())
        return pa.table({"g": bucket["g"], "bucket": bucket["bucket"], "entries": pa.array(entries, pa.binary()), "totals": pa.array(totals, pa.binary())})

    return rows


def collection_totals(grouped: DataFrame, list_: Callable[[pa.Table], Counter], buckets: int, least: int) -> DataFrame:
    """(g, bucket, entries, totals): for each group the totals of what it listed, those of at least ``least``.

    ``list_`` gives a group's Counter by (kind, entry), 0 for what is only asked about.
    """
    return grouped.groupBy("g").applyInArrow(_lists(list_, buckets), ANSWER).groupBy("bucket").applyInArrow(_answers(least), ANSWER)
