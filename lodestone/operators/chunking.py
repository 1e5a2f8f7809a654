"""Documents into overlapping passages."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash
from .written import bounded, released

SIZE, OVERLAP = 900, 150
#: Bytes of texts and number of passages that a worker holds as Python objects.
BYTES, ROWS = 1 << 20, 1024
PASSAGES = "id string, document_id string, filename string, text string, page int, start int, end int"


def windows(text: str, size: int, overlap: int):
    """(start, end) of consecutive windows. A window that isn't the last ends before the last blank
    or line end of its second half, if there is one; the next begins `overlap` before that end."""
    gaps = [m.start() for m in re.finditer("[\n ]", text)]
    begin = 0
    while len(text) - begin > size:
        last = bisect_left(gaps, begin + size) - 1
        in_half = last >= 0 and gaps[last] >= max(begin + size // 2, begin + 1)
        end = gaps[last] if in_half else begin + size
        yield begin, end
        begin = max(end - overlap, begin + 1)
    if begin < len(text):
        yield begin, len(text)


def pieces(batch: pa.RecordBatch):
    """A batch in slices of at most BYTES of text, or one row: only a slice becomes Python objects at a time."""
    total, begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def passages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """pages(filename, page, text) -> PASSAGES. Narrow: each window depends on the one before, so a
    text is cut by one worker, and nothing is shuffled. Blank windows are left out, null texts have
    none. A worker is sent 8 MB of texts at a time, or one text."""

    def run(batches):
        for b in batches:
            rows = []
            for name, page, text in (row for part in pieces(b) for row in zip(*(part.column(c).to_pylist() for c in ("filename", "page", "text")))):
                doc = hashlib.sha256(name.encode()).hexdigest()[:24]
                text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
                for i, j in windows(text, size, overlap):
                    part = text[i:j]
                    if part.strip():
                        key = hashlib.sha256(f"{doc}:{page}:{i}:{part}".encode()).hexdigest()[:24]
                        rows.append((key, doc, name, part, page, i, j))
                        if len(rows) >= ROWS:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)
        released()

    def batch(rows):
        kinds = [pa.string()] * 4 + [pa.int32()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in PASSAGES.split(", ")])

    return bounded(pages.select("filename", "page", "text")).mapInArrow(run, PASSAGES)


def parents(passages: DataFrame, size: int = 1800) -> DataFrame:
    """passages -> id, document_id, page, start, end, text, parent: consecutive passages of a page share a parent (from 1)
    until its texts would exceed `size` characters. Each choice depends on the ones before, so a
    sorted partition is folded as it streams by; nothing is held but the last sum."""

    def run(batches):
        key, total, parent = None, 0, 0
        for b in batches:
            out = []
            for doc, page, n in zip(*(b.column(c).to_pylist() for c in ("document_id", "page", "n"))):
                if (doc, page) != key:
                    key, total, parent = (doc, page), n, 1
                elif total + n > size:
                    total, parent = n, parent + 1
                else:
                    total += n
                out.append(parent)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int32())], [*names, "parent"])

    names = ["id", "document_id", "page", "start", "end", "text"]
    p = passages.select(*names, F.length("text").alias("n")).repartition("document_id", "page").sortWithinPartitions("document_id", "page", "start")
    return p.mapInArrow(run, "id string, document_id string, page int, start int, end int, text string, parent int")


def stitched(children: DataFrame) -> DataFrame:
    """Output of parents -> parent_id, document_id, page, start, end, text, children (their ids): the text without what
    consecutive passages share; a blank stands between passages that share nothing."""
    before = F.lag("end").over(Window.partitionBy("document_id", "page", "parent").orderBy("start"))
    shared = F.col("before") - F.col("start")
    rest = F.when(F.col("before").isNull() | (shared >= F.length("text")), F.col("text")).when(shared > 0, F.substr("text", shared + 1)).otherwise(F.concat(F.lit(" "), F.col("text")))
    part = children.withColumn("before", before).select("document_id", "page", "parent", "start", "end", "id", rest.alias("rest"))
    all_ = F.array_sort(F.collect_list(F.struct("start", "rest", "id")))
    g = part.groupBy("document_id", "page", "parent").agg(F.min("start").alias("start"), F.max("end").alias("end"), all_.alias("all"))
    key = F.concat_ws(":", F.lit("parent"), "document_id", F.col("page").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    return g.select(short_hash(key).alias("parent_id"), "document_id", "page", "start", "end", F.array_join(F.col("all.rest"), "").alias("text"), F.col("all.id").alias("children"))


def siblings(passages: DataFrame, most: int = 1200, size: int = SIZE) -> DataFrame:
    """passages -> id, context: each passage with its neighbours of the page, one before and one after
    by turns, while the whole stays within `most` characters; one that is too long is passed over,
    and a turn that adds nothing is the last. As all passages of a page but its last have half of `size` at
    least, a fixed number of neighbours holds every case."""
    radius = most // (size // 2 + 2) + 2
    w = Window.partitionBy("document_id", "page").orderBy("start")
    p = passages.select("id", "text", F.reverse(F.collect_list("text").over(w.rowsBetween(-radius, -1))).alias("b"), F.collect_list("text").over(w.rowsBetween(1, radius)).alias("a"))
    state = lambda n, b, a, on: F.struct(n.cast("int").alias("n"), b.alias("b"), a.alias("a"), on.alias("on"))
    none = F.array().cast("array<string>")

    def turn(s, k):
        before, after = F.try_element_at(F.col("b"), k), F.try_element_at(F.col("a"), k)
        back = F.coalesce(s["n"] + F.length(before) + 2 <= most, F.lit(False))
        n = F.when(back, s["n"] + F.length(before) + 2).otherwise(s["n"])
        on = F.coalesce(n + F.length(after) + 2 <= most, F.lit(False))
        b = F.when(back, F.concat(F.array(before), s["b"])).otherwise(s["b"])
        a = F.when(on, F.concat(s["a"], F.array(after))).otherwise(s["a"])
        return F.when(s["on"] & (s["n"] < most), state(F.when(on, n + F.length(after) + 2).otherwise(n), b, a, back | on)).otherwise(s)

    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(radius)), state(F.length("text"), none, none, F.lit(True)), turn)
    return p.select("id", "text", rounds.alias("r")).select("id", F.array_join(F.concat("r.b", F.array("text"), "r.a"), "\n\n").alias("context"))


def rolled_up(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """evidence(id, filename, page, ...), output of stitched -> with context: the text of the section that a passage
    belongs to under its name; null where it has none."""
    of = sections.select(F.explode("children").alias("id"), F.col("text").alias("_section"))
    name = F.concat(F.lit("[Parent Section: "), "filename", F.lit(" p."), F.col("page").cast("string"), F.lit("]\n"), "_section")
    return evidence.join(of, "id", "left").withColumn("context", name).drop("_section")
