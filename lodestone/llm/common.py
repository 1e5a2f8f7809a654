"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is sent at once (a longer row comes alone), where the session doesn't say.
BATCH_BYTES = "8m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it
    is unset and all run on one machine (tests), a temporary folder becomes the setting; on a
    cluster that is an error, as no local folder is shared."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Folders written by this process that have not been removed yet, with the session that can do it.
_WRITTEN: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there is removed when the process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def remove(path: str) -> None:
    """Removes a folder that fresh_path() named."""
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        try:
            remove(path)
        except Exception:  # noqa: BLE001  the session has ended: there is nothing to do it with
            _WRITTEN.pop(path, None)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, a lost
    executor costs nothing, and the optimizer knows the size."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialized tables of which nothing that is still to be computed reads."""
    for t in tables:
        if path := getattr(t, "_written", None):
            remove(path)


def by_position(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """df with columns c0, c1, ..., its own names, and by lower-case name which of those it has (of
    several the first): columns added to it can't clash with any name."""
    names = df.columns
    at: dict[str, str] = {}
    for i, n in enumerate(names):
        at.setdefault(n.lower(), f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names, at


def bounded(rows: DataFrame) -> DataFrame:
    """rows as they are; what Python workers of its session hold at once is bounded by bytes from
    here on, so that 10,000 long texts don't meet in one batch."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH_BYTES)
    return rows


def tidied(run):
    """run, a function of Arrow batches, that returns freed memory to the system when its task ends: a
    Python worker outlives its tasks, and the next one may be of another kind."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return own


#: What separates words: ASCII white space.
BLANKS = "\t\n\v\f\r"


def parted(text: Column, marks: str = BLANKS) -> Column:
    """The runs of a text between blanks and marks, in order, A-Z lower-cased. One pass with a table of
    characters and a plain split take a small part of the time of a pattern. Null is empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + marks, LOWER + " " * len(marks))
    return F.array_remove(F.split(plain, " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def map_shared(uri: str) -> np.ndarray:
    """The bytes of a shared file as a read-only memory map: file URIs as they are; a file of another
    store is copied to this machine, mapped and unlinked at once, so that its space is free again
    as soon as the map is dropped."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return np.memmap(parts.path, dtype=np.uint8, mode="r") if os.path.getsize(parts.path) else np.zeros(0, dtype=np.uint8)
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(uri)
    with there.open_input_stream(path) as src, tempfile.TemporaryFile() as out:
        while chunk := src.read(1 << 22):
            out.write(chunk)
        out.flush()
        return np.memmap(out, dtype=np.uint8, mode="r") if out.tell() else np.zeros(0, dtype=np.uint8)


def write_shared(uri: str, *chunks: bytes | memoryview) -> None:
    """Writes a file in the shared folder under a name of its own and moves it into place, so that
    a repeated or speculative task attempt leaves the same whole file."""
    parts = urlparse(uri)
    part = f"{uri}.{uuid.uuid4().hex}"
    if parts.scheme in ("", "file"):
        path, part = parts.path, urlparse(part).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as out:
            for x in chunks:
                out.write(x)
        os.replace(part, path)
        return
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(uri)
    aside = fs.FileSystem.from_uri(part)[1]
    there.create_dir(os.path.dirname(path), recursive=True)
    with there.open_output_stream(aside) as out:
        for x in chunks:
            out.write(x)
    there.move(aside, path)


def pack(*arrays: np.ndarray) -> list[bytes]:
    """Header (number of arrays; type and length of each) and the arrays, each at a multiple of 8."""
    head = np.array([len(arrays), *(x for a in arrays for x in (int.from_bytes(a.dtype.str[1:].encode().ljust(8), "little"), len(a)))], dtype="<u8").tobytes()
    out = [head]
    for a in arrays:
        data = np.ascontiguousarray(a).tobytes()
        out += [data, b"\0" * (-len(data) % 8)]
    return out


def unpack(uri: str) -> list[np.ndarray]:
    """The arrays of a packed file, as views of its memory map."""
    raw = map_shared(uri)
    count = int(raw[:8].view("<u8")[0])
    heads = raw[8 : 8 + 16 * count].view("<u8").reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for kind, n in heads.tolist():
        dtype = np.dtype("<" + kind.to_bytes(8, "little").decode().strip())
        out.append(raw[at : at + n * dtype.itemsize].view(dtype))
        at += -(-n * dtype.itemsize // 8) * 8
    return out


class Opened:
    """The most recently used files of a folder, mapped by read(uri); None where there is no such file."""

    def __init__(self, root: str, read, most: int):
        self.root, self.read, self.most, self.open = root, read, most, OrderedDict()

    def __call__(self, name: str):
        if name in self.open:
            self.open.move_to_end(name)
        else:
            try:
                self.open[name] = self.read(f"{self.root}/{name}")
            except FileNotFoundError:
                self.open[name] = None
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        return self.open[name]


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay. decided(doc_id, row_key, stay): how many of the rows of docs with
    this doc_id and text hash stay; rows that it doesn't name stay all. Only what goes is listed,
    so texts don't move where the list is small enough to be sent to every task."""
    plain, names, at = by_position(docs)
    gone = decided.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "stay")
    key = plain[at["doc_id"]].cast("long"), F.xxhash64(plain[at["text"]])
    on = key[0].eqNullSafe(gone["gone_id"]) & (key[1] == gone["gone_key"])
    out = plain.join(gone, on, "left_anti")
    partly = gone.where("stay > 0")  # of repeated rows one stays
    if not partly.isEmpty():
        again = plain.join(partly, on, "left_semi").groupBy(F.struct(*key).alias("row"))
        out = out.unionByName(again.agg(*[F.any_value(c).alias(c) for c in plain.columns]).select(*plain.columns))
    return out.toDF(*names)
