"""Passages of batches that are held piece by piece."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_pieces(monkeypatch, most):
    monkeypatch.setattr(chunking, "BYTES", most)
    texts = ["a" * 30, None, "", "é" * 30, "b" * 9, "c"]
    got = list(chunking.pieces(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})))
    assert [x for p in got for x in p.column("text").to_pylist()] == texts
    size = lambda p: sum(len((x or "").encode()) for x in p.column("text").to_pylist())
    assert all(p.num_rows == 1 or size(p) <= most for p in got)
    assert list(chunking.pieces(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []


def test_passages_in_pieces(spark, monkeypatch):
    rows = [(f"f{i}", 1, "word " * (i * 60) if i else None) for i in range(12)]
    p = spark.createDataFrame(rows, "filename string, page int, text string")
    want = sorted(tuple(r) for r in chunking.passages(p).collect())
    monkeypatch.setattr(chunking, "BYTES", 500)
    monkeypatch.setattr(chunking, "ROWS", 2)
    assert sorted(tuple(r) for r in chunking.passages(p).collect()) == want and len(want) > 12


def test_workers_are_sent_texts_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    spark.conf.unset(key)
    p = spark.range(0, 1500, 1, 1).select(F.concat(F.lit("f"), "id").alias("filename"), F.lit(1).alias("page"), F.repeat(F.lit("word "), 4000).alias("text"))
    chunking.passages(p)
    sizes = [r["n"] for r in p.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    if before is not None:
        spark.conf.set(key, before)
    assert sum(sizes) > 30_000_000 and max(sizes) < 9 << 20
