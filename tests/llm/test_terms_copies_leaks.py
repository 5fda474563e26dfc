import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_copies as nc
from millrace.llm.arrays import codepoints, rolling
from millrace.llm.distinctive_terms import graph, term_scores, words_of
from millrace.llm.leakage import exact, leaked_items, window_minima

RECORDS = "record_table string, key string, text string"
WORDS = "资产负债保险合同利率年度报告债券发行人受益披露管理审计清算质押抵扣凭证账户专户年限额度收入成本"


def noise(rng, n):
    return "".join(rng.choice(WORDS) for _ in range(n))


def test_term_scores(spark):
    rows = [("a", "灯塔条款与灯塔条款，灯塔条款。等待期", 1), ("b", "等待期甲乙丙", 2), ("b", "等待期甲乙丙", 2), ("c", None, 3), ("d", "", 4), (None, "灯塔条款", 5), ("e", "等待期", 6)]
    df = spark.createDataFrame(rows, "key string, text string, score int")
    terms = spark.createDataFrame([("灯塔条款",), ("等待期",), ("没有",), (None,), ("",)], "term string")
    got = {(r["key"], r["term"]): r for r in term_scores(df, terms).collect()}
    assert set(got) == {("a", "灯塔条款"), ("a", "等待期"), ("b", "等待期"), ("e", "等待期")}
    assert got["a", "灯塔条款"]["occurrences"] == 3 and got["b", "等待期"]["records_with_term"] == 3 and got["e", "等待期"]["n_records"] == 5
    assert got["a", "灯塔条款"]["score"] > got["b", "等待期"]["score"] and got["e", "等待期"]["score"] == 0.0
    assert term_scores(df.limit(0), terms).count() == 0 and term_scores(df, terms.limit(0)).count() == 0


def test_neighbours_are_words_of_the_whole_record(spark):
    # The phase of the word pairs comes from the record, so one neighbour stays one at every occurrence.
    assert graph("甲乙灯塔丙丁，甲乙灯塔丙丁", [(0, 2, 4), (0, 9, 11)], 1) == {0: (2, {"甲乙", "丙丁"})}
    rng = random.Random(5)
    text = noise(rng, 200) + "灯塔" + noise(rng, 50) + "，灯塔" + noise(rng, 30)
    words, starts, ends = words_of(text)
    want = set()
    for at in (200, 253):
        want |= set([w for w, e in zip(words, ends) if e <= at][-4:]) | set([w for w, b in zip(words, starts) if b >= at + 2][:4])
    row = term_scores(spark.createDataFrame([("a", text)], "key string, text string"), spark.createDataFrame([("灯塔",)], "term string")).first()
    assert row["degree"] == len(want - {"灯塔"}) and row["occurrences"] == 2


def test_rolling_hash_depends_on_content_only():
    points, _ = codepoints(["xabcdeyabcde"])
    for width in (3, 5):
        h = rolling(points, width)
        assert h[1] == h[7] and h[0] != h[6]
    assert len(rolling(points, 13)) == 0


def test_golay_code_is_perfect_and_two_errors_share_an_index():
    near = nc.nearest_codeword()
    assert np.bincount(near).tolist() == [2048] * 4096
    rng = random.Random(1)
    for _ in range(300):
        v = rng.randrange(1 << 23)
        w = v
        for bit in rng.sample(range(23), rng.randrange(3)):
            w ^= 1 << bit
        number, index = nc.golay_indices(np.array([v, w]))
        assert set(index[number == 0]) & set(index[number == 1])


def edited(rng, text):
    out = list(text)
    for _ in range(max(1, len(text) // 40)):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(WORDS)
        elif kind == 1:
            out.insert(at, rng.choice(WORDS))
        else:
            del out[at]
    return "".join(out)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(7)
    texts = [noise(rng, rng.randrange(60, 300)) for _ in range(120)]
    texts += [edited(rng, t) for t in texts[:60]] + [edited(rng, t) for t in texts[:20]] + [texts[5], "", "甲", "甲乙", None, texts[3][150:] + texts[3][:150]]
    rows = [("t", f"k{i:03}", t) for i, t in enumerate(texts)] + [("t", "k000", texts[0]), ("u", "k001", texts[1]), ("t", None, texts[2])]
    got = {(r["key_a"], r["key_b"]) for r in nc.near_copies(spark.createDataFrame(rows, RECORDS)).collect()}
    grams = {k: nc.shingles(t) for tab, k, t in rows if tab == "t" and k and t and len(t) >= 3}
    keys = sorted(grams)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if nc.alike(grams[a], grams[b], 0.65)}
    # Exact copies are linked by their class: pairs with a copy that isn't its class's smallest key go by way of that key.
    copies = {"k200": "k005"}
    want = {(a, b) for a, b in want if not {a, b} & set(copies)} | {("k005", "k200")}
    assert got <= want and len(got & want) >= 0.97 * len(want)


def test_candidate_runs_are_counted_at_any_number(spark):
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x4E00, 0x9E00)]
    texts = ["".join(rng.choices(letters, k=1000)) for _ in range(1500)]
    texts += [texts[0] + "戊", "甲乙丙" * 3, texts[1][:500] + "戊", texts[2][:25], "甲乙", "甲乙丙丁"]
    rows = [(i % 3, i, t) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a text that stands twice in its group counts once
    frame = spark.createDataFrame(rows, "g int, id long, text string")
    got = {(r["g"], r["bucket"]): np.frombuffer(nc.zlib.decompress(r["codes"]), np.uint8) for r in nc.run_counts(frame, 2).collect()}
    every, groups = {}, []
    for g in range(3):
        runs, counts = np.unique(nc._places(nc.candidates([t for h, _, t in rows[:-1] if h == g])[1], 2), return_counts=True)
        groups.append(runs)
        for run, count in zip(runs.tolist(), counts.tolist()):
            every[run] = every.get(run, 0) + count
    assert len(every) > 300_000
    for g, runs in enumerate(groups):
        want = nc.count_codes(np.array([every[run] for run in runs.tolist()]))
        assert np.concatenate([got[g, b] for b in (0, 1)]).tolist() == want.tolist()
    assert nc.count_codes(np.array([1, 2, 8, 16, 10**9])).tolist() == [1, 2, 8, 12, 116]


def test_shared_stretches_have_the_same_candidates():
    rng = random.Random(2)
    for n in (12, 13, 40, 300):
        stretch = noise(rng, n)
        a, b = noise(rng, 60) + stretch + noise(rng, 7), stretch + noise(rng, 40)
        shared = set(nc.candidates([a])[1].tolist()) & set(nc.candidates([b])[1].tolist())
        assert len(shared) >= (n - nc.ANCHOR + 1) // nc.WINDOW


def test_short_copies_are_found(spark):
    rng = random.Random(13)
    letters = [chr(c) for c in range(0x4E00, 0x9E00)]
    texts = []
    for n in range(3, 21):
        for _ in range(12):
            text = "".join(rng.choices(letters, k=n))
            texts += [text, text + rng.choice(letters), text[1:], text[: n // 2] + rng.choice(letters) + text[n // 2 + 1 :], text[: n // 2] + rng.choice(letters) + text[n // 2 :]]
    rows = [("t", f"k{i:05}", t) for i, t in enumerate(dict.fromkeys(texts))]
    got = {(r["key_a"], r["key_b"]) for r in nc.near_copies(spark.createDataFrame(rows, RECORDS)).collect()}
    grams = {k: nc.shingles(t) for _, k, t in rows if len(t) >= 3}
    keys = sorted(grams)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if grams[a] & grams[b] and nc.alike(grams[a], grams[b], 0.65)}
    assert got <= want and len(want) > 300 and len(got) >= 0.98 * len(want)
    with pytest.raises(ValueError, match="similarity"):
        nc.near_copies(spark.createDataFrame(rows, RECORDS), 0.5)


def test_near_copies_of_nothing_and_of_one_hot_text(spark):
    assert nc.near_copies(spark.createDataFrame([], RECORDS)).count() == 0
    hot = spark.range(3000).select(F.lit("t").alias("record_table"), F.format_string("k%05d", "id").alias("key"), F.lit("同一段文字在三分之一的记录里出现，一字不差地重复").alias("text"))
    assert nc.near_copies(hot).count() == 2999  # a star, not all pairs


def test_window_minima():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for w in (1, 2, 3, 5, 7):
        assert window_minima(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    assert len(window_minima(x, 8)) == 0


def test_leaks(spark):
    rng = random.Random(3)
    item = "".join(rng.choice(WORDS + "ABCdef0123456789") for _ in range(120))
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item[20:70]).upper()
    docs = [(1, noise(rng, 900) + item + noise(rng, 90)), (2, noise(rng, 50) + "，".join(wide) + "\n" + noise(rng, 9)), (3, item[:39] + "甲"), (4, None), (5, ""), (6, noise(rng, 200_000) + item[60:100] + noise(rng, 10)), (1, item), (7, item[:39] + noise(rng, 30))]
    items = [(10, item), (11, item[:39]), (12, None), (13, noise(rng, 80)), (10, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert sorted(map(tuple, leaked_items(d, i).collect())) == [(1, 10), (2, 10), (6, 10)]
    assert sorted(map(tuple, leaked_items(d, i, most_shared=0).collect())) == [(1, 10), (2, 10), (6, 10)]  # the joined way
    assert exact("ＡＢＣ" * 20, "abc" * 20, 40) and not exact("a" * 39, "a" * 60, 40)
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0
