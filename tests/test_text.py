from pyspark.sql import functions as F

from lodestone.functions import questions as Q
from lodestone.functions import text as T
from lodestone.operators.chunking import passages, windows
from lodestone.sources.documents import html_text, read_texts


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens, "The Straße of 中文 runs_1") == ["strasse", "中", "文", "runs_1"]
    assert one(spark, T.tokens, None) == []


def test_entities(spark):
    assert one(spark, T.entities, "# Heading Name\nAfter Redis Cluster fails, [[atlas]] asks NASA.") == ["atlas", "nasa", "redis cluster"]


def test_singular(spark):
    assert one(spark, T.singular, " Vector  Databases ") == "vector database"


def test_sentences(spark):
    assert one(spark, T.sentences, "One. Two v3.14!\nThree") == ["One.", "Two v3.14!", "Three"]


def test_routes(spark):
    for text, rule in (("", "empty"), ("overview of all systems", "global"), ("what is linked with redis", "relational"), ("HTTP_404 meaning", "exact"), ("explain the idea of leases", "conceptual"), ("leases and locks", "other")):
        assert one(spark, Q.route, text) == rule


def test_windows_cover_the_text():
    text = "alpha beta gamma\n" * 300
    cuts = list(windows(text, 900, 150))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(a[1] - b[0] <= 150 and b[0] <= a[1] for a, b in zip(cuts, [(x, y) for x, y in cuts[1:]]))


def test_passages_handle_nulls(spark):
    got = passages(spark.createDataFrame([("a.txt", 1, None), ("b.txt", 1, " \n "), ("c.txt", 1, "x\r\ny")], "filename string, page int, text string")).collect()
    assert [(r["filename"], r["text"]) for r in got] == [("c.txt", "x\ny")]


def test_html():
    assert html_text("<p>a<script>b</script>&amp;</p><br>c") == "\na& \nc"


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"a\0b")
    got = {r["filename"]: (r["text"], r["status"]) for r in read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("hello", "ok"), "b.txt": (None, "not UTF-8"), "c.exe": (None, "unsupported format"), "d.txt": (None, "binary content")}
