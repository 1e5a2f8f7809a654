"""Condensing, sections and propositions on given cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import condense, hypothetical, sections
from lodestone.operators import chunking


def value(spark, column, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first()["x"]


LONG = "Redis keeps its data in memory and writes a log. The weather was fine on that day in the north. " + "Nothing of note happened after it at all, they say. " * 2 + "Redis failover is handled by sentinels."


def test_compressed(spark):
    got = value(spark, condense.compressed, LONG, "How is redis failover handled?")
    assert got == "Redis keeps its data in memory and writes a log. Redis failover is handled by sentinels."
    assert value(spark, condense.compressed, "One. Two.", "anything") == "One. Two."
    assert value(spark, condense.compressed, LONG, "zebra") == "Redis keeps its data in memory and writes a log."
    assert value(spark, condense.compressed, None, "x") == ""


def test_stop_words_make_pairs(spark):
    from lodestone.functions.scoring import sentence_score

    assert value(spark, sentence_score, "The cat sat on the mat.", "who is on the sofa") == pytest.approx(0.25)


def test_propositions(spark):
    got = value(spark, condense.propositions, "The Atlas Service stores logs; keeps copies for a year, and Redis caches them. Short. it reads as well as it writes data.")
    assert got == ["The Atlas Service stores logs.", "The Atlas Service keeps copies for a year.", "Redis caches them.", "it writes data."]
    assert value(spark, condense.propositions, None) == []
    assert value(spark, lambda a, b: condense.stated(a, condense.propositions(b)), "atlas stores gold", "Atlas stores logs.") == 0.6667
    assert value(spark, lambda a, b: condense.stated(a, condense.propositions(b)), "", "Atlas stores logs.") == 0.0


@pytest.mark.parametrize(("offset", "want"), [(0, []), (3, ["A"]), (18, ["A", "B"]), (30, ["A", "C"]), (99, ["D"])])
def test_crumbs(spark, offset, want):
    text = "# A\nintro\n## B\nbody\n## C\nmore\n# D\nend"
    assert value(spark, lambda t: sections.crumbs(sections.headings(t), F.lit(offset)), text) == want


def test_header(spark):
    assert value(spark, lambda f: sections.header(f, F.array(F.lit("A"), F.lit("B"))), "x.md") == "[x.md > A > B]"
    assert value(spark, lambda f: sections.header(f, F.array().cast("array<string>")), "x.md") == "[x.md]"


def test_hypothetical(spark):
    assert value(spark, hypothetical.passage, "How does Redis persist data?").startswith("Redis persist data by coordinating ")
    assert value(spark, hypothetical.passage, "what is kafka").startswith("kafka is a core ")
    assert value(spark, hypothetical.passage, "why do caches fail??").startswith("caches fail to ensure ")
    assert "Key systems involved include Atlas Core." in value(spark, hypothetical.passage, "list backups of Atlas Core")
    assert value(spark, hypothetical.title, "k8s atlas-core") == "K8S Atlas-Core"


def test_siblings(spark):
    sizes = [700, 460, 500, 470, 480, 40]
    rows = [(str(i), "d", 1, i * 1000, chr(97 + i) * n) for i, n in enumerate(sizes)]
    p = spark.createDataFrame(rows, "id string, document_id string, page int, start int, text string")
    got = {r["id"]: [x[0] for x in r["context"].split("\n\n")] for r in chunking.siblings(p).collect()}
    for i in range(len(sizes)):
        picked, n, b, a = [i], sizes[i], i - 1, i + 1
        while (b >= 0 or a < len(sizes)) and n < 1200:
            before = n
            for j in (b, a):
                if 0 <= j < len(sizes) and n + sizes[j] + 2 <= 1200:
                    picked, n = sorted([*picked, j]), n + sizes[j] + 2
            b, a = b - 1, a + 1
            if n == before:
                break
        assert got[str(i)] == [chr(97 + j) for j in picked]


def test_sentences_meet_their_question_once(spark):
    from lodestone.functions.scoring import sentence_scores

    s = ["Straße und Katze sit here.", "The cat sat on the mat, and so on.", "Copyright cat sat all of it.", "Cat sat.", "Nothing of that in here.", "A cat is what this is."]
    df = spark.createDataFrame([(s, "Cat sat STRASSE?"), (s[:1], None), ([], "cat")], "s array<string>, q string")
    x = df.select(sentence_scores(F.col("s"), F.col("q")).alias("x"))
    got = [r["x"] for r in x.collect()]
    assert got[0] == [pytest.approx(v, abs=1e-4) for v in (0.3333, 0.9167, 0.0, 0.0, 0.0, 0.3833)] and got[2] == []
    plan = df.select(condense.compressed(F.element_at("s", 1), F.col("q")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # words of the question are cut once for a row, not in a lambda for each sentence
