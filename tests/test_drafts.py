"""Picking passages and merging drafts against plain versions."""

import random

from lodestone.operators import drafts, retrieval


def test_selected(spark):
    rng = random.Random(5)
    rows = []
    for q in range(4):
        for i in range(40):
            start = rng.randrange(0, 3000, 50)
            rows.append((q, f"{i:02d}", f"d{rng.randrange(3)}", 1, start, start + rng.choice([300, 600, 900]), rng.randrange(5, 40) / 40 / 2, rng.choice([None, 0.0, 0.5]), rng.random()))
    df = spark.createDataFrame(rows, "qid int, id string, document_id string, page int, start int, end int, relevance double, graph double, fusion double")
    got = {(r["qid"], r["source_id"]): r["id"] for r in retrieval.selected(df).collect()}
    want = {}
    for q in range(4):
        taken = []
        for r in sorted((r for r in rows if r[0] == q and (r[6] >= 0.12 or (r[7] or 0) > 0)), key=lambda r: (-r[6], -r[8])):
            if len(taken) < 5 and not any(t[2] == r[2] and min(t[5], r[5]) - max(t[4], r[4]) > 0.6 * min(t[5] - t[4], r[5] - r[4]) for t in taken):
                taken.append(r)
        want |= {(q, f"S{i + 1}"): t[1] for i, t in enumerate(taken)}
    assert got == want and len(want) == 20


def test_retrieve(spark):
    texts = ["Redis keeps its data in memory.", "Kafka stores a log of events.", "Redis failover is handled by Sentinel nodes.", "Nothing about it."]
    p = spark.createDataFrame([(f"p{i}", f"d{i}", 1, 0, len(t), t) for i, t in enumerate(texts)], "id string, document_id string, page int, start int, end int, text string")
    q = spark.createDataFrame([(1, "How is redis failover handled?"), (2, "zebra"), (3, None)], "qid int, text string")
    got = [tuple(r) for r in retrieval.retrieve(p, q).select("qid", "source_id", "id").orderBy("qid", "source_id").collect()]
    assert got == [(1, "S1", "p2"), (1, "S2", "p0")]
    more = spark.createDataFrame([(2, "graph", "p1", 1.0, ["zebra", "kafka"])], "qid int, channel string, id string, score double, path array<string>")
    assert ("p1",) in [tuple(r) for r in retrieval.retrieve(p, q, more).where("qid = 2").select("id").collect()]


def test_subsets(spark):
    e = [(1, 1, "a", 0.9), (1, 2, "a", 0.8), (1, 3, "b", 0.95), (1, 4, "c", 0.1), (2, 1, "a", 0.5), (3, 1, "a", 0.9), (3, 2, "a", 0.8), (3, 3, "a", 0.1), (3, 4, "b", 0.7)]
    got = {(r["qid"], r["position"]): r["subset"] for r in drafts.subsets(spark.createDataFrame(e, "qid int, position int, document_id string, relevance double")).collect()}
    assert got == {(1, 3): 0, (1, 1): 1, (1, 2): 1, (1, 4): 2, (2, 1): 0, (3, 1): 0, (3, 2): 1, (3, 3): 2, (3, 4): 0}


def test_synthesized(spark):
    c = [(1, 0, 0.5, 1, "S1", "redis keeps logs", "keeps logs"), (1, 1, 0.9, 1, "S1", "redis keeps logs well", "keeps logs"), (1, 1, 0.9, 2, "S1", "made up", "not there"), (1, 0, 0.5, 2, "S1", "data is in memory", "in memory"), (1, 0, 0.5, 3, "S9", "no source", "x")]
    e = spark.createDataFrame([(1, "S1", "redis  keeps logs and data in memory")], "qid int, source_id string, passage string")
    got = drafts.synthesized(spark.createDataFrame(c, "qid int, draft int, score double, position int, source_id string, text string, quote string"), e)
    assert [tuple(r) for r in got.select("rank", "draft", "position").orderBy("rank").collect()] == [(1, 1, 1), (2, 0, 2)]


def test_consensus_of_one(spark):
    c = spark.createDataFrame([(1, 0, "a redis log"), (2, 0, "redis log"), (2, 1, "the")], "qid int, draft int, text string")
    assert {(r["qid"], r["draft"]): r["consensus"] for r in drafts.agreed(c).collect()} == {(1, 0): 1.0, (2, 0): 0.0, (2, 1): 0.0}
