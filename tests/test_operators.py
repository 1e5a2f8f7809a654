"""Operators against plain versions on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rewriting as R
from lodestone.functions import scoring as C
from lodestone.operators import answers, graph, resolution, store


def one(spark, column, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("lock", "lock", 1.0), ("partition", "partitions", 0.97), ("replicate", "replication", 0.918), ("lock", "key", 0.0), ("go", "gone", 0.0)])
def test_word_likeness(spark, a, b, want):
    assert one(spark, C.word_likeness, a, b) == want


def test_phrase(spark):
    assert one(spark, C.phrase, "the red fox", "See: THE red-fox ran") == 1.0
    assert one(spark, C.phrase, "red fox ran far", "a red fox, far") == round(0.6 / 3, 4)
    assert one(spark, C.phrase, "", "a") == one(spark, C.phrase, None, "a") == one(spark, C.phrase, "a", None) == 0.0


def test_proximity(spark):
    near = lambda q, t: C.proximity(F.split(q, " "), t)
    assert one(spark, near, "red fox", "a red fox") == 1.0
    assert one(spark, near, "red fox", "a red") == 0.5
    assert one(spark, near, "red fox", "red " + "x " * 10 + "fox") == 0.8


def test_rewriting(spark):
    assert one(spark, R.fallback, "Please explain redis clusters?!") == "explain redis clusters"
    assert one(spark, R.corrective, "please can you explain redis failover") == "redis failover"
    assert one(spark, R.active, "Therefore, redis keeps logs [S1].") == "redis keeps logs"
    assert one(spark, R.parts, "compare redis and kafka?") == ["Details about redis", "Details about kafka"]
    assert one(spark, R.parts, "What is a? What is b?") == ["What is a?", "What is b?"]
    assert one(spark, R.parts, " ") == []
    assert one(spark, R.followup, "which store is used and how does it handle failover?", "Redis") == "How does Redis handle failover?"
    assert one(spark, R.followup, "explain its replication", "Redis") == "explain Redis replication"
    w = one(spark, R.weights, 'who is linked with "redis"')
    assert (w["keyword"], w["vector"], w["graph"]) == (1.174, 0.652, 1.174)


NAMES = ["redis", "redis cluster", "rediss", "redit", "postgres", "postgresql", "k8s", "kubernetes", "kubernetes node", "atlas", "atlss", "ab", "abc", "one two three four five six seven", "one two three four five six eight", "seven six five four three two one"]


def test_pairs_miss_none(spark):
    df = spark.createDataFrame([(x,) for x in NAMES], "name string")
    got = {(r["a"], r["b"], r["likeness"]) for r in resolution.pairs(df).collect()}
    every = df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).where("a < b")  # a brute-force check of 16 names
    want = {tuple(r) for r in every.withColumn("l", resolution.likeness(F.col("a"), F.col("b"))).where("l >= 0.85").collect()}
    assert got == want and len(got) > 5


def test_resolved(spark):
    got = {r["entity"]: (r["canonical"], r["confidence"]) for r in resolution.resolved(spark.createDataFrame([(x,) for x in ["Redis", "redis cluster", "K8s", "kubernetes", "atlas"]], "entity string")).collect()}
    assert got == {"Redis": ("redis", 1.0), "redis cluster": ("redis", 0.98), "K8s": ("k8s", 1.0), "kubernetes": ("k8s", 0.98), "atlas": ("atlas", 1.0)}


EDGES = [("a", "b", 2.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 1.0)]


def test_walk_ranks(spark):
    got = {r["entity"]: r["rank"] for r in graph.walk_ranks(spark.createDataFrame(EDGES, "src string, dst string, weight double"), spark.createDataFrame([(1, "a", 3.0)], "qid int, entity string, weight double"), rounds=6).collect()}
    nodes, r = "abcd", {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    out = {n: sum(w for s, _, w in EDGES if s == n) for n in nodes}
    for _ in range(6):
        new = {n: 0.15 * (n == "a") + 0.85 * r["d"] * (n == "a") for n in nodes}
        for s, t, w in EDGES:
            new[t] += 0.85 * r[s] * w / out[s]
        r = new
    assert got == pytest.approx(r)


def test_reached(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    got = {r["entity"]: (r["length"], r["path"]) for r in graph.reached(e, spark.createDataFrame([(1, "a")], "qid int, entity string")).collect()}
    assert got == {"a": (1, ["a"]), "b": (2, ["a", "b"]), "c": (3, ["a", "b", "c"])}


def test_revisions(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.snapshot(spark, str(tmp_path))
    assert [store.commit(spark.range(n), str(tmp_path)) for n in (3, 5)] == [1, 2]
    (tmp_path / "revision-3").mkdir()  # a writer that failed
    assert store.snapshot(spark, str(tmp_path)).count() == 5 and store.snapshot(spark, str(tmp_path), 1).count() == 3


def test_cached(spark):
    scope, kinds = ("r", "p", "m", "hybrid", "[]"), ", ".join(f"{c} string" for c in store.SCOPE)
    now = dt.datetime(2024, 1, 1, 12)
    old, new = now - dt.timedelta(seconds=301), now - dt.timedelta(seconds=10)
    e = [(1, "What is  Redis", [1.0, 0.0], new, *scope), (2, "gone", [0.0, 1.0], old, *scope), (3, "other scope", [0.0, 1.0], new, "r2", *scope[1:])]
    q = [(1, "what is redis", [0.0, 1.0], *scope), (2, "like", [0.99, 0.05], *scope), (3, "gone", [0.0, 1.0], *scope)]
    e = spark.createDataFrame(e, f"entry_id int, text string, vector array<double>, stored_at timestamp, {kinds}")
    q = spark.createDataFrame(q, f"qid int, text string, vector array<double>, {kinds}")
    got = store.cached(q, e, F.lit(now).cast("timestamp"))
    assert {tuple(r) for r in got.drop("score").collect()} == {(1, 1, "exact"), (2, 1, "semantic")}
    assert store.alive(e, F.lit(now), 0).count() == 3


def test_judged_without_words(spark):
    e = spark.createDataFrame([(1, "the", 1, None, 0.5)], "qid int, question string, position int, passage string, relevance double")
    r = answers.judged(e).first()
    assert (r["context"], r["confidence"], r["action"]) == (0.0, 0.0, "incorrect")
