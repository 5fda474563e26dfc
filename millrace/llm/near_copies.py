"""Records that are copies of each other but for small edits, at any number of records.

Golay-code fuzzy hashing. Of each distinct text a few anchors are drawn: runs of ``ANCHOR`` characters (and of ``SHORT_ANCHOR``
from a text below ``SHORT`` characters), by consistent weighted sampling with weights that fall with the run's frequency in the
whole collection, so that boilerplate is rarely drawn and copies draw the same anchors. Candidates for anchors are the runs with
the smallest hash among ``WINDOW`` neighbours; a stretch that two texts share has the same candidates in both, and only these
are counted. Each anchor goes with one 23-bit segment of the text's fingerprint. A bit of a segment is set where the smallest
hash of the text's shingles in that bit's slot falls into one eighth, so copies differ in few bits. The segment is decoded by the
binary Golay code: all codewords that are nearest to it or to a vector one bit away give an index, so two segments that differ in
up to two bits share one. By the pigeonhole principle copies whose errors are spread over all segments still have some segment
with at most two. Texts that share (anchor, segment, index) are candidates. A sketch of 128 bits rules most of the others out
before any text is sent; the exact similarity decides.

The 12-bit index alone has 4,096 values, too few to tell millions of records apart; that is why each key also holds an anchor.

Distinct texts are dealt by hash into groups of about ``GROUP_CHARACTERS``, and moved once; every further step goes to the groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import codepoints, mix, owners, rolling

BITS = 23
GENERATOR = 0b101011100011  # of the binary Golay code, degree 11
SHINGLE = 3
ANCHOR, ANCHORS, WINDOW = 10, 7, 3
SHORT, SHORT_ANCHOR, SHORT_ANCHORS = 32, 4, 5
SEGMENTS = 4
GROUP_CHARACTERS = 2_000_000
DENSITY = 12  # one bit in so many is set
NAME_BITS = 40  # of a text's id in its code; the other bits are of its sketch
SKETCH = 64 - NAME_BITS + 64
RARE = 8
EMPTY = np.iinfo(np.int64).max  # a slot without a shingle
LEAST_THRESHOLD = 0.65  # the keys are made for copies of this similarity and above


@lru_cache(1)
def nearest_codeword() -> np.ndarray:
    """For each 23-bit vector the 12-bit message of its nearest codeword (distance at most three: the code is perfect)."""
    words = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        words ^= np.where(np.arange(1 << 12) >> bit & 1, GENERATOR << bit, 0)
    errors = [0] + [1 << a for a in range(BITS)] + [1 << a | 1 << b for a in range(BITS) for b in range(a)] + [1 << a | 1 << b | 1 << c for a in range(BITS) for b in range(a) for c in range(b)]
    out = np.zeros(1 << BITS, np.int16)
    for error in errors:
        out[words ^ error] = np.arange(1 << 12)
    return out


def golay_indices(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector number, index) for each distinct index of each vector: of the vector and of all vectors one bit away."""
    near = nearest_codeword()
    decoded = np.stack([near[vectors], *[near[vectors ^ (1 << bit)] for bit in range(BITS)]], 1)
    decoded.sort(1)
    new = np.ones(decoded.shape, bool)
    new[:, 1:] = decoded[:, 1:] != decoded[:, :-1]
    return np.nonzero(new)[0], decoded[new].astype(np.int64)


def candidates(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the runs of each text that can be anchors, in order of the texts.

    Runs of ANCHOR characters that have the smallest hash of some WINDOW neighbours, all runs of a text with fewer than that; of a
    text below SHORT characters also every run of SHORT_ANCHOR.
    """
    points, offsets = codepoints(texts)
    at, text = owners(offsets, ANCHOR)
    hashes = rolling(points, ANCHOR)[at]
    lone = np.bincount(text, minlength=len(texts))[text] < WINDOW if len(text) else np.zeros(0, bool)
    n = len(hashes) - WINDOW + 1
    if n > 0:
        low = np.minimum.reduce([hashes[i : i + n] for i in range(WINDOW)])
        within = text[:n] == text[WINDOW - 1 :]
        for i in range(WINDOW):
            lone[i : i + n] |= within & (hashes[i : i + n] == low)
    short = np.array([len(t) < SHORT for t in texts], bool)
    at, small = owners(offsets, SHORT_ANCHOR)
    of_short = short[small]
    other = mix(rolling(points, SHORT_ANCHOR)[at[of_short]] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    number, run = np.concatenate([text[lone], small[of_short]]), np.concatenate([hashes[lone], other])
    kind = np.concatenate([np.zeros(int(lone.sum()), bool), np.ones(len(other), bool)])
    order = np.argsort(number, kind="stable")
    # The lowest bit tells runs of SHORT_ANCHOR from the others.
    return number[order], (run[order] & ~np.uint64(1)) | kind[order]


def _places(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each run in the upper and 28 more bits of its hash in the lower half."""
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)) << np.uint64(32) | (hashes >> np.uint64(1)) & np.uint64(0xFFFFFFF)


def _packed(values: np.ndarray) -> bytes:
    """Integers of 32 bits byte by byte, which compresses small ones well."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _first_of_each(group: pa.Table) -> pa.Table:
    """A group of texts with each id once."""
    ids = group["id"].to_numpy()
    return group.take(pa.array(np.sort(np.unique(ids, return_index=True)[1])))


def _own_runs(buckets: int):
    def own(group: pa.Table) -> pa.Table:
        """The candidate runs of a group of texts by bucket, in order, as differences, with their occurrences in the group."""
        places, counts = np.unique(_places(candidates(_first_of_each(group)["text"].to_pylist())[1], buckets), return_counts=True)
        bounds = np.searchsorted(places, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        low = (places & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = [(b, _packed(np.diff(low[i:j], prepend=0)), _packed(counts[i:j])) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if i < j]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array([group["g"][0].as_py()] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["g", "bucket", "runs", "counts"])

    return own


def _all_counts(bucket: pa.Table) -> pa.Table:
    """For each group the code of the total occurrences of each of its runs of this bucket, in its order."""
    parts = [np.cumsum(_unpacked(r).astype(np.int64)) for r in bucket["runs"].to_pylist()]
    runs, which = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([_unpacked(c) for c in bucket["counts"].to_pylist()])
    codes = count_codes(np.bincount(which, counts, len(runs)))[which]
    ends = np.cumsum([len(p) for p in parts])
    packed = [zlib.compress(codes[end - len(p) : end].tobytes(), 1) for p, end in zip(parts, ends)]
    return pa.Table.from_arrays([bucket["g"], bucket["bucket"], pa.array(packed, pa.binary())], ["g", "bucket", "codes"])


def count_codes(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact up to RARE, then by steps of a quarter of a power of two."""
    return np.where(counts <= RARE, counts, RARE + np.minimum(np.round(4 * np.log2(np.maximum(counts, RARE) / RARE)), 240)).astype(np.uint8)


def run_counts(grouped: DataFrame, buckets: int) -> DataFrame:
    """(g, bucket, codes): occurrences in all texts of each candidate run of a group of texts. ``grouped`` has g, id, text and more.

    Groups send each of their distinct runs once to the run's bucket, which adds up the counts and sends them back in the
    order they came: one row a group and bucket, and never more rows than runs. Runs are told apart by bucket and 28 bits.
    """
    own = grouped.groupBy("g").applyInArrow(_own_runs(buckets), "g int, bucket int, runs binary, counts binary")
    return own.groupBy("bucket").applyInArrow(_all_counts, "g int, bucket int, codes binary")


def slot_minima(points: np.ndarray, offsets: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """For each text the smallest hash of the shingles that fall into each slot; passes of at most 42 slots, so that each slot gets many shingles."""
    at, text = owners(offsets, SHINGLE)
    hashes = rolling(points, SHINGLE)[at]
    passes = -(-slots // 42)
    within = -(-slots // passes)
    low = np.full((len(offsets) - 1, within * passes), EMPTY)
    for number in range(passes):
        h = mix(hashes + np.uint64(2 * (seed + number) + 1))
        slot = ((h >> np.uint64(44)) * np.uint64(within)) >> np.uint64(20)
        np.minimum.at(low.reshape(-1), text * (within * passes) + slot.astype(np.int64) + number * within, (h & np.uint64((1 << 44) - 1)).view(np.int64))
    return low[:, :slots]


def segments(points: np.ndarray, offsets: np.ndarray, n_segments: int) -> np.ndarray:
    """Fingerprint of each text: n_segments vectors of 23 bits."""
    low = slot_minima(points, offsets, BITS * n_segments, 0)
    return (((low % DENSITY == 0) & (low < EMPTY)).reshape(-1, n_segments, BITS) << np.arange(BITS)).sum(2)


def sketches(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SKETCH evenly set bits of each text: 24 in the upper bits of the first word, 64 in the second."""
    own = [((slot_minima(points, offsets, n, 1000 + i) >> 5 & 1) << np.arange(n)).sum(1) for i, n in enumerate((64 - NAME_BITS, 32, 32))]
    return own[0] << np.int64(NAME_BITS), own[1] << np.int64(32) | own[2]


def sketch_limit(threshold: float, bits: int = SKETCH, deviations: float = 2.6) -> int:
    """Bits in which the sketches of copies at the threshold may differ: so many standard deviations above the mean."""
    p = (1 - threshold) / 2
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def anchors(text: np.ndarray, hashes: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, run hash) of the n runs of each text drawn by weight 1 / frequency; all runs where there are fewer."""
    shared = count > 1  # a run that occurs once can't be shared
    text, hashes, weight = text[shared], hashes[shared], 1.0 / np.maximum(count[shared], RARE)
    chance = ((mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    order = np.lexsort((hashes, -np.log(chance) / weight, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    text, hashes = text[new], hashes[new]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    return text[rank < n], hashes[rank < n]


def _keys(n_anchors: int, n_segments: int, buckets: int):
    def keys(group: pa.Table, counted: pa.Table) -> pa.Table:
        """(code, key, sketch): the keys of each text. A code is the lower bits of the id and the upper ones of the sketch."""
        made = []
        group = _first_of_each(group) if len(group) else group
        texts, seeds = group["text"].to_pylist(), np.array([zlib.crc32(t.encode()) for t in group["record_table"].to_pylist()], np.uint64)
        if texts:
            parts = sorted(zip(counted["bucket"].to_pylist(), counted["codes"].to_pylist()))
            codes = np.frombuffer(b"".join(zlib.decompress(c) for _, c in parts), np.uint8).astype(np.int64)
            text, hashes = candidates(texts)
            known, which = np.unique(_places(hashes, buckets), return_inverse=True)
            if len(known) != len(codes):
                raise RuntimeError("the counts of a group of texts are not those of its runs")
            values = np.where(codes <= RARE, codes, RARE * 2.0 ** ((codes - RARE) / 4))[which]
            short = (hashes & np.uint64(1)).astype(bool)
            drawn = [anchors(text[kind], hashes[kind], values[kind], n) for kind, n in ((~short, n_anchors), (short, SHORT_ANCHORS))]
            text, run = (np.concatenate(x) for x in zip(*drawn))
            order = np.argsort(text, kind="stable")
            text, run = text[order], run[order]
            ids = group["id"].to_numpy()
            for begin in range(0, len(texts), 2048):
                i, j = np.searchsorted(text, (begin, begin + 2048))
                part = codepoints(texts[begin : begin + 2048])
                prints, (high, sketch) = segments(*part, n_segments), sketches(*part)
                codes_ = high | ids[begin : begin + 2048] & np.int64((1 << NAME_BITS) - 1)
                own, runs = text[i:j] - begin, run[i:j]
                which, index = golay_indices(prints[own, ((runs >> np.uint64(1)) % np.uint64(n_segments)).astype(np.int64)])
                key = mix(mix(runs[which] ^ seeds[begin + own[which]]) * np.uint64(4096) + index.astype(np.uint64)).view(np.int64)
                made.append(pa.table({"code": codes_[own[which]], "key": key, "sketch": sketch[own[which]]}))
        return pa.concat_tables(made) if made else pa.table({name: pa.array([], pa.int64()) for name in ("code", "key", "sketch")})

    return keys


def shingles(text: str, width: int = SHINGLE) -> frozenset[str]:
    """Distinct runs of ``width`` characters."""
    return frozenset(map("".join, zip(*[text[i:] for i in range(width)])))


def alike(a: frozenset[str], b: frozenset[str], threshold: float) -> bool:
    """Whether the shared elements, divided by all of both, are at least ``threshold``."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    shared = len(a & b)
    return shared >= threshold * (len(a) + len(b) - shared)


def _distinct_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each id of a partition, so that a text in a third of all rows is sent once by each partition."""
    known: set[int] = set()
    for batch in batches:
        keep = []
        for id_ in batch.column("id").to_pylist():
            keep.append(id_ not in known)
            known.add(id_)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _by_name(table: pa.Table) -> dict[int, list[tuple[int, str, str]]]:
    """(id, record_table, text) by the lower bits of the id; different texts with the same bits stand together."""
    out: dict[int, dict[int, tuple]] = {}
    for row in zip(*(table[c].to_pylist() for c in ("id", "record_table", "text"))):
        out.setdefault(row[0] & ((1 << NAME_BITS) - 1), {})[row[0]] = row
    return {name: list(rows.values()) for name, rows in out.items()}


def _send(group: pa.Table, wanted: pa.Table) -> pa.Table:
    """The texts that another group wants: rows with id, record_table and text, without names of a pair."""
    known = _by_name(group)
    rows = [(to, *row) for name, to in zip(wanted["name_a"].to_pylist(), wanted["to"].to_pylist()) for row in known[name]]
    to, ids, tables, texts = zip(*rows) if rows else ((), (), (), ())
    nothing = pa.nulls(len(rows), pa.int64())
    return pa.Table.from_arrays([pa.array(to, pa.int32()), nothing, nothing, pa.array(ids, pa.int64()), pa.array(tables, pa.string()), pa.array(texts, pa.string())], ["g", "name_a", "name_b", "id", "record_table", "text"])


def _verify(threshold: float):
    def verify(group: pa.Table, asked: pa.Table) -> pa.Table:
        """(id_a, id_b) of the pairs asked for that are copies; the first texts stand in rows without names."""
        sent, own = _by_name(asked.filter(asked["text"].is_valid())), _by_name(group)
        known: dict[int, frozenset[str]] = {}
        out: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for a, b in zip(asked["name_a"].to_pylist(), asked["name_b"].to_pylist()) if a is not None):
            if len(known) > 4000:
                known.clear()
            for id_a, table_a, text_a in sent[a]:
                for id_b, table_b, text_b in own[b]:
                    if id_a == id_b or table_a != table_b:
                        continue
                    for id_, text in ((id_a, text_a), (id_b, text_b)):
                        if id_ not in known:
                            known[id_] = shingles(text)
                    if alike(known[id_a], known[id_b], threshold):
                        out.append((id_a, id_b))
        return pa.table({"id_a": pa.array([a for a, _ in out], pa.int64()), "id_b": pa.array([b for _, b in out], pa.int64())})

    return verify


def near_copies(records: DataFrame, threshold: float = 0.65, n_anchors: int = ANCHORS, n_segments: int = SEGMENTS) -> DataFrame:
    """Links between records of the same ``record_table`` whose ``text`` has a similarity of at least ``threshold``.

    ``records`` has record_table, key, text; the result (record_table, key_a, key_b), key_a < key_b. Redelivered rows count
    once. Records with the same text form a class: each is linked to the smallest key of its class, and links between
    different texts are given between these representatives of the classes, so that a third of all rows being exact copies
    costs one row each. Null texts, keys and tables and texts below three characters match nothing. The keys are made for
    thresholds from ``LEAST_THRESHOLD`` on; a lower one is refused rather than answered in part.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"the keys find copies of similarity {LEAST_THRESHOLD} and above")
    records = records.select("record_table", "key", "text").filter((F.length("text") >= SHINGLE) & F.col("key").isNotNull() & F.col("record_table").isNotNull())
    groups = 1 + (records.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP_CHARACTERS
    buckets = -(-groups // 2)
    name_of = lambda code: code.bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    group_of = lambda name: F.pmod(name, F.lit(groups)).cast("int")
    records = records.withColumn("id", F.xxhash64("record_table", "text"))
    texts = records.select(group_of(name_of(F.col("id"))).alias("g"), "id", "record_table", "text").mapInArrow(_distinct_in_partition, "g int, id long, record_table string, text string").repartition("g")
    counts = run_counts(texts, buckets)
    keys = texts.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(_keys(n_anchors, n_segments, buckets), "code long, key long, sketch long")
    errors = F.bit_count(F.shiftright(F.col("a.code").bitwiseXOR(F.col("b.code")), NAME_BITS).bitwiseAND(F.lit((1 << 64 - NAME_BITS) - 1))) + F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
    met = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.code") < F.col("b.code")) & (errors <= sketch_limit(threshold)))
    pairs = met.select(name_of(F.col("a.code")).alias("name_a"), name_of(F.col("b.code")).alias("name_b")).distinct()
    # Each first text goes once to each group that asks for it, and is compared there.
    wanted = pairs.select(group_of(F.col("name_a")).alias("g"), "name_a", group_of(F.col("name_b")).alias("to")).distinct()
    sent = texts.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(_send, "g int, name_a long, name_b long, id long, record_table string, text string")
    asked = sent.unionByName(pairs.select(group_of(F.col("name_b")).alias("g"), "name_a", "name_b"), allowMissingColumns=True)
    links = texts.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_verify(threshold), "id_a long, id_b long")
    first = records.groupBy("id").agg(F.min(F.struct("key", "record_table")).alias("f"))
    for x in "ab":
        links = links.join(first.select(F.col("id").alias(f"id_{x}"), F.col("f").alias(f"f_{x}")), f"id_{x}")
    between = links.select(F.col("f_a.record_table").alias("record_table"), F.least("f_a.key", "f_b.key").alias("key_a"), F.greatest("f_a.key", "f_b.key").alias("key_b")).filter("key_a < key_b")
    same = records.select("id", "key").join(first, "id").filter("f.key < key").select("f.record_table", F.col("f.key").alias("key_a"), F.col("key").alias("key_b"))
    return between.unionByName(same).distinct()
