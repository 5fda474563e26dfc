import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import abuse
from millrace.llm.packing import best_two_fit, fill_of, pack_documents


def test_best_two_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 3000):
        sizes = np.minimum(rng.lognormal(5.5, 1, n).astype(int), 2048)
        number = best_two_fit(sizes, 2048)
        loads = np.bincount(number, weights=sizes, minlength=1)
        assert loads.max(initial=0) <= 2048
        if n == 3000:
            assert sizes.sum() / (2048 * (number.max() + 1)) > 0.99
    assert len(set(best_two_fit(np.array([2048, 2048, 0, 0]), 2048))) == 2


def test_pack_documents(spark):
    rng = random.Random(4)
    rows = [(i, "资产 report 12 " * rng.randrange(1, 900)) for i in range(60)] + [(100, None), (101, ""), (3, "重复的一行")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    packed = pack_documents(docs, group=40).toPandas()
    assert packed.groupby("container")["n_tokens"].sum().max() <= 2048
    assert set(packed["doc_id"]) == set(range(60)) | {101} and not packed.duplicated(["doc_id", "part"]).any()
    parts = packed[packed.doc_id != 101].groupby("doc_id")["n_tokens"].agg(["sum", "count"])
    assert ((parts["sum"] + 2047) // 2048 == parts["count"]).all()
    assert pack_documents(docs.limit(0)).count() == 0
    assert fill_of(pack_documents(docs)).first()["filled"] > 0.9


BAD = ["看见{}就恶心，活脱脱的废物！", "{}这种蠢货还好意思说话。", "真是一群贱人，{}去死吧。"]


def documents(rng, n, bad):
    names = ["客服", "楼上", "董秘", "这帮人"]
    plain = ["保险人应当在{}日内给付保险金。", "公司{}年营业收入增长。", "违反第{}条规定的，处以罚款。", "禁止发布辱骂他人的内容，见第{}条。"]
    for i in range(n):
        text = "".join(rng.choice(plain).format(rng.randrange(1, 999)) for _ in range(6))
        yield text + (rng.choice(BAD).format(rng.choice(names)) if bad else "")


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    rows = [(i, t, 0) for i, t in enumerate(documents(rng, 400, False))] + [(1000 + i, t, 1) for i, t in enumerate(documents(rng, 160, True))]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(5000, None, None), (5001, "", "s"), (5002, "很长。" * 50_000, "s")], "doc_id long, text string, source string")
    labels = [(i, y, 0, 0) for i, _, y in rows if i % 2 == 0] + [(2, 1, 0, 0), (2, 0, 0, 0), (None, 1, 0, 0), (4, None, 0, 0)]
    judged = spark.createDataFrame(labels, "doc_id long, abuse int, hate int, sexual int")
    scores = abuse.score_documents(docs, judged)
    found = {r["doc_id"] for r in abuse.found_categories(scores).collect() if r["category"] == "abuse"}
    held_out = [(i, y) for i, _, y in rows if i % 2]
    assert sum(i in found for i, y in held_out if y) >= 0.95 * sum(y for _, y in held_out)
    assert sum(i in found for i, y in held_out if not y) <= 0.02 * len(held_out)
    assert not found & {5000, 5001, 5002}
    rates = {r["source"]: r for r in abuse.source_rates(abuse.score_documents(docs, judged, carry=("source",))).collect()}
    assert rates[None]["n_documents"] == 1 and 0.2 < rates["s"]["abuse_rate"] < 0.4


def test_without_labels_nothing_is_found(spark):
    docs = spark.createDataFrame([(1, "真是一群贱人，你去死吧。")], "doc_id long, text string")
    judged = spark.createDataFrame([], "doc_id long, abuse int, hate int, sexual int")
    assert abuse.found_categories(abuse.score_documents(docs, judged)).count() == 0
    assert abuse.score_documents(docs.limit(0), judged).count() == 0


def test_hidden_words_are_read():
    assert abuse.windows("这个废.物和害-虫！第3.5条。") == ["这个废物和害虫！", "第3.5条。"]
