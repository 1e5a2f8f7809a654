"""Exact deduplication against immutable snapshots that binary fuse filters guard.

Texts are equal when they agree after lower-casing A-Z (a null text counts as empty). Documents
come in batches. The digests of a batch are grouped by themselves, one row per distinct digest
however many copies there are, and become an immutable snapshot: for each bucket of digests a file
of sorted keys and a static filter. The distinct digests of a later batch are sent to their buckets
once; there the filter of every earlier snapshot screens them, and only positives open the bucket's
file, so that no snapshot is ever read as a whole, shuffled or written again. What several batches
share is added up; everything else keeps the count of its own batch.

Byte checks: filters over the digests that occur more than once are mapped by the tasks that read
the texts, so a text moves only if its digest repeats (or in 1 of 256 others); senders combine the
smallest and largest text of a digest, no task gathers a group, and a digest that two texts share
is split by text.

Defined cases: repeated rows (same doc_id and text) form one group of which one row stays; null
doc_ids take part, and stay only in a group without any other id; rows of one id whose texts differ
in case only are one group, and of them the one with the smallest text hash stays; an empty table
gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse_filter
from .common import Opened, bounded, discard, fold_of, fresh_path, keep_rows, map_shared, materialize, pack, table, tidied, unpack, write_shared

#: Digests of one bucket, for which one task builds or probes a filter; digests that share one of the
#: filters of the byte check, and how many of those a task maps at a time.
BUCKET_KEYS, CHECK_KEYS, OPEN_FILTERS = 1 << 16, 1 << 20, 256


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def short(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a number: its place in buckets, files and filters."""
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digests), dtype="<i8")


def digests(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, row_key (hash of the text as it is; with doc_id it tells rows apart), digest, h."""

    def run(batches):
        for b in batches:
            out = [digest((x.as_py() or "").encode().lower()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(out, pa.binary()), pa.array(short(out))], ["doc_id", "row_key", "digest", "h"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    return bounded(rows).mapInArrow(tidied(run), "doc_id long, row_key long, digest binary, h long")


def write_snapshot(groups: DataFrame, root: str) -> None:
    """groups(bucket, h, digest, n, keep_id) -> the files of a snapshot: for each bucket its sorted
    keys with their digests, counts and ids, and its filter."""

    def one(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        names = t.column("digest").take(pa.array(order)).to_pylist()
        keep = t.column("keep_id").take(pa.array(order))
        bucket = t.column("bucket")[0].as_py()
        ends = np.cumsum([0, *map(len, names)])
        write_shared(f"{root}/{bucket}.keys", *pack(h[order], ends, np.frombuffer(b"".join(names), dtype=np.uint8), t.column("n").to_numpy()[order], keep.fill_null(0).to_numpy(), keep.is_null().to_numpy().astype(np.uint8)))
        write_shared(f"{root}/{bucket}.filter", fuse_filter.build(h.view(np.uint64)))
        return pa.table({"size": pa.array([len(h)], pa.int64())})

    groups.groupBy("bucket").applyInArrow(one, "size long").agg(F.sum("size")).collect()  # one number


def found_in(keys: list[np.ndarray], h: np.ndarray, names: list[bytes]) -> list[tuple[int, int, int | None]]:
    """(place in names, count, id) of the names that a bucket's file holds."""
    of, ends, data, n, keep, null = keys
    first, last, out = np.searchsorted(of, h, "left"), np.searchsorted(of, h, "right"), []
    for i, name in enumerate(names):
        for at in range(first[i], last[i]):
            if data[ends[at] : ends[at + 1]].tobytes() == name:
                out.append((i, int(n[at]), None if null[at] else int(keep[at])))
    return out


def shared_with(batch: DataFrame, number: int, roots: list[str]) -> DataFrame:
    """What the grouped batch has in common with the snapshots: digest, batch, n, keep_id for each
    snapshot that holds the digest, and for the batch itself."""

    def one(t: pa.Table) -> pa.Table:
        h, names = t.column("h").to_numpy(), t.column("digest").to_pylist()
        bucket, met, out = t.column("bucket")[0].as_py(), set(), []
        for number_, root in enumerate(roots):
            try:
                maybe = np.flatnonzero(fuse_filter.contains(map_shared(f"{root}/{bucket}.filter"), h.view(np.uint64)))
            except FileNotFoundError:  # the snapshot has nothing in this bucket
                continue
            if len(maybe):
                for i, n, keep in found_in(unpack(f"{root}/{bucket}.keys"), h[maybe], [names[k] for k in maybe]):
                    met.add(int(maybe[i]))
                    out.append((names[maybe[i]], number_, n, keep))
        own, keeps = t.column("n").to_pylist(), t.column("keep_id").to_pylist()
        out += [(names[i], number, own[i], keeps[i]) for i in sorted(met)]
        return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.int64()))], names=["digest", "batch", "n", "keep_id"])

    return batch.groupBy("bucket").applyInArrow(one, "digest binary, batch int, n long, keep_id long")


def grouped(rows: DataFrame, batches: int) -> DataFrame:
    """rows(digest, h, batch, m, doc_id) -> digest, batch, n, keep_id: for every digest of a batch the
    count and largest id over all batches."""
    spark = rows.sparkSession
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    own, roots, shared = [], [], None
    for k in range(batches):
        g = rows.where(F.col("batch") == k).groupBy("digest", "h").agg(F.sum("m").alias("n"), F.max("doc_id").alias("keep_id"))
        g = materialize(g.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")), "dedup-batch")
        if roots:
            met = shared_with(g, k, roots)
            shared = met if shared is None else shared.unionByName(met)
        if k + 1 < batches:
            roots.append(fresh_path(spark, "dedup-snapshot"))
            write_snapshot(g, roots[-1])
        own.append(g.select("digest", "h", F.lit(k).alias("batch"), "n", "keep_id"))
    every = own[0]
    for g in own[1:]:
        every = every.unionByName(g)
    if shared is None:
        return every
    once = shared.groupBy("digest", "batch").agg(F.max("n").alias("n"), F.max("keep_id").alias("keep_id"))
    total = materialize(once.groupBy("digest").agg(F.sum("n").alias("all_n"), F.max("keep_id").alias("all_keep")), "dedup-shared")
    both = every.join(total, "digest", "left")
    return both.select("digest", "h", "batch", F.coalesce("all_n", "n").alias("n"), F.when(F.col("all_n").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"))


def repeated_texts(docs: DataFrame, groups: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, row_key, digest, text (normalised) of the rows of docs whose digest occurs more than once,
    and of a few others."""
    spark = docs.sparkSession
    root = fresh_path(spark, "dedup-check")
    several = groups.where("n > 1").select("h").distinct()
    several = materialize(several, "dedup-several")
    parts = max(1, -(-several.count() // CHECK_KEYS))

    def write(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy().view(np.uint64)
        write_shared(f"{root}/{t.column('part')[0].as_py()}.filter", fuse_filter.build(h))
        return pa.table({"size": pa.array([len(h)], pa.int64())})

    several.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(write, "size long").agg(F.sum("size")).collect()  # one number
    discard(several)

    def run(batches):
        filters = Opened(root, map_shared, OPEN_FILTERS)
        for b in batches:
            texts = [(x.as_py() or "").encode().lower() for x in b.column("text")]
            names = [digest(x) for x in texts]
            h = short(names)
            part, maybe = h % parts, np.zeros(len(h), dtype=bool)
            for p in np.unique(part):
                held = filters(f"{p}.filter")
                if held is not None:
                    own = part == p
                    maybe[own] = fuse_filter.contains(held, h[own].view(np.uint64))
            if maybe.any():
                at = pa.array(np.flatnonzero(maybe))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("row_key").take(at), pa.array([names[i.as_py()] for i in at], pa.binary()), pa.array([texts[i.as_py()].decode() for i in at], pa.string())],
                    ["doc_id", "row_key", "digest", "text"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    return bounded(rows).mapInArrow(tidied(run), "doc_id long, row_key long, digest binary, text string")


def classify(docs: DataFrame, batches: int = 2, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, row_key, digest, keep_id, group_size, kept."""
    rows = digests(docs, digest).withColumn("batch", fold_of(F.col("doc_id"), batches).cast("int"))
    rows = materialize(rows.groupBy("doc_id", "row_key", "digest", "h", "batch").agg(F.count("*").alias("m")), "dedup-rows")
    groups = materialize(grouped(rows, batches), "dedup-groups")
    # byte checks of everything that is called equal
    held = repeated_texts(docs, groups, digest)
    bounds = held.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash = materialize(bounds.where("lo <> hi").select("digest"), "dedup-clash")
    found = rows.join(groups.select("digest", "batch", F.col("n").alias("group_size"), "keep_id"), ["digest", "batch"])
    if not clash.isEmpty():
        split = held.join(clash, "digest").select("doc_id", "row_key", "digest", "text").dropDuplicates()
        split = split.join(rows.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "m"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")))
        of = split.groupBy(F.col("digest").alias("g"), F.col("text").alias("t")).agg(F.sum("m").alias("group_size"), F.max("doc_id").alias("keep_id"))
        apart = split.join(of, (F.col("digest") == F.col("g")) & (F.col("text") == F.col("t"))).select("doc_id", "row_key", "digest", "m", "group_size", "keep_id")
        found = found.join(clash, "digest", "left_anti").select(apart.columns).unionByName(apart)
    copies = found.select("doc_id", "row_key", "digest", "keep_id", "group_size", "m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    # of rows of one id whose texts differ in case only, the one with the smallest row_key stays
    first = copies.withColumn("is_top", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    tied = rows.groupBy("doc_id", "digest").agg(F.min("row_key").alias("first_key"), F.count("*").alias("variants")).where("variants > 1 or doc_id is null")
    tied = tied.select(F.col("doc_id").alias("tied_id"), F.col("digest").alias("tied_digest"), "first_key")
    first = first.join(tied, F.col("doc_id").eqNullSafe(F.col("tied_id")) & (F.col("digest") == F.col("tied_digest")), "left")
    kept = F.col("is_top") & (F.col("copy") == 1) & (F.col("first_key").isNull() | (F.col("row_key") == F.col("first_key")))
    return first.select("doc_id", "row_key", "digest", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    decided = materialize(classify(docs), "dedup-decided")
    gone = decided.groupBy("doc_id", "row_key").agg(F.count_if("kept").alias("stay"), F.count("*").alias("m")).where("stay < m")
    return keep_rows(docs, materialize(gone.select("doc_id", "row_key", "stay"), "dedup-gone"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    got = classify(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
g as (select doc_id, body, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from g
"""
