"""A versioned passage table, its history, and a table of cached answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import normalize, short_hash

TTL, LIKE, KEPT = 300, 0.92, 500
SCOPE = ["revision", "provider", "model", "mode", "document_ids"]


def _revisions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole revisions: a folder counts once its write job has committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root + "/revision-*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("-")[1]) for s in done or [])


def commit(df: DataFrame, root: str) -> int:
    """Writes df as the next revision. Readers see it whole or not at all; of two writers at once
    the second fails, as the folder exists."""
    n = max(_revisions(df.sparkSession, root), default=0) + 1
    df.write.parquet(f"{root}/revision-{n}")
    return n


def snapshot(spark: SparkSession, root: str, revision: int | None = None) -> DataFrame:
    """The newest revision, or a given one."""
    n = revision or max(_revisions(spark, root), default=0)
    if not n:
        raise FileNotFoundError(f"no revision in {root}")
    return spark.read.parquet(f"{root}/revision-{n}")


def only(passages: DataFrame, documents: DataFrame | None) -> DataFrame:
    """The passages of given documents (document_id); None means all."""
    return passages if documents is None else passages.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def without(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """The passages but those of given documents."""
    return passages.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows, newest first; every partition hands on n rows at most."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(n)


def alive(entries: DataFrame, now, ttl: int = TTL) -> DataFrame:
    """Entries (stored_at) younger than ttl seconds at `now`; a ttl of 0 keeps all."""
    return entries if ttl == 0 else entries.where(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(ttl)))


def cached(questions: DataFrame, entries: DataFrame, now, ttl: int = TTL, like: float = LIKE, most: int = KEPT) -> DataFrame:
    """questions(qid, text, vector, SCOPE), entries(entry_id, text, vector, stored_at, SCOPE) ->
    qid, entry_id, kind, score: an entry of the same scope with the same text but for case and blanks
    (exact, newest first), else the likest of cosine `like` or more (semantic). Questions without
    an entry have no row. Exact hits meet by their text; only the rest is compared with vectors, of the
    `most` newest entries, which is as many as a cache holds."""
    key = lambda c: F.lower(normalize(F.col(c)))
    e = alive(entries, now, ttl).select("entry_id", key("text").alias("_text"), F.col("vector").alias("_vector"), "stored_at", *SCOPE)
    q = questions.withColumn("_text", key("text"))
    same = q.join(e.drop("_vector"), [*SCOPE, "_text"])
    newest_ = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("stored_at"), "entry_id"))
    same = same.withColumn("_r", newest_).where("_r = 1").select("qid", "entry_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    some = F.broadcast(newest(e.drop("_text"), "stored_at", "entry_id", most))  # `most` rows
    rest = q.join(same.select("qid"), "qid", "left_anti").join(some, SCOPE)
    rest = rest.withColumn("score", V.cosine(F.col("vector"), F.col("_vector"))).where(F.col("score") >= like)
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("stored_at"), "entry_id"))
    rest = rest.withColumn("_r", best).where("_r = 1").select("qid", "entry_id", F.lit("semantic").alias("kind"), "score")
    return same.unionByName(rest)


def put(entries: DataFrame, new: DataFrame, most: int = KEPT) -> DataFrame:
    """entries and new(entry_id, text, ..., stored_at, used_at) -> the `most` that were used last."""
    return newest(entries.unionByName(new), "used_at", "entry_id", most)


def touched(entries: DataFrame, hits: DataFrame, now) -> DataFrame:
    """Entries with used_at set to now where hits(entry_id) used them."""
    h = hits.select("entry_id").distinct().withColumn("_hit", F.lit(True))
    return entries.join(h, "entry_id", "left").withColumn("used_at", F.when(F.col("_hit"), now).otherwise(F.col("used_at"))).drop("_hit")


def cache_stats(lookups: DataFrame) -> DataFrame:
    """lookups(kind: exact, semantic or null for a miss) -> exact_hits, semantic_hits, misses, hit_rate."""
    g = lookups.agg(F.count_if(F.col("kind") == "exact").alias("exact_hits"), F.count_if(F.col("kind") == "semantic").alias("semantic_hits"), F.count_if(F.col("kind").isNull()).alias("misses"))
    hits = F.col("exact_hits") + F.col("semantic_hits")
    return g.withColumn("hit_rate", F.round(hits / F.greatest(hits + F.col("misses"), F.lit(1)), 4))


# -- an index of several tables in revisions


class Conflict(RuntimeError):
    """Another writer has begun the revision that follows the one this change was made from."""


def _create(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; false if it exists."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, False).close()
    except Exception as e:
        if "exist" in str(e).lower():
            return False
        raise
    return True


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int) -> int:
    """Writes the tables as the revision that follows `after`, whole or not at all: readers count a revision
    once its mark is there. Of two writers from the same revision one gets a Conflict before it
    writes anything; the claim of a writer that died has to be removed (root/after-N)."""
    if not _create(spark, f"{root}/after-{after}"):
        raise Conflict(f"revision {after} of {root} is being followed by another writer")
    n = after + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/revision-{n}/{name}")
    _create(spark, f"{root}/revision-{n}/_SUCCESS")
    return n


def load(spark: SparkSession, root: str, names: tuple[str, ...] = ("documents", "passages", "meta")) -> tuple[int, dict[str, DataFrame]]:
    """The number of the newest revision and its tables; 0 and none before the first."""
    n = max(_revisions(spark, root), default=0)
    return n, {name: spark.read.parquet(f"{root}/revision-{n}/{name}") for name in names} if n else {}


def document(documents: DataFrame, filename: str) -> DataFrame:
    """The document of a name: no row or one."""
    return documents.where(F.col("filename") == filename)


def digests(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """pages(filename, bytes, page, text) -> document_id, filename, digest, bytes: the digest follows from the texts of all
    pages and from how they are cut."""
    own = F.struct("page", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    g = pages.select("filename", "bytes", own.alias("own")).groupBy("filename").agg(F.max("bytes").alias("bytes"), F.array_sort(F.collect_list("own")).alias("all"))
    digest = F.sha2(F.concat(F.to_json("all"), F.lit(f":{size}:{overlap}")), 256)
    return g.select(short_hash(F.col("filename")).alias("document_id"), "filename", digest.alias("digest"), "bytes")


def changed(incoming: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Of incoming documents (digests) those that are new or differ from their former selves."""
    return incoming if documents is None else incoming.join(documents.select("document_id", "digest"), ["document_id", "digest"], "left_anti")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by document_id after the documents of `new` have replaced their former selves."""
    return without(old, new).unionByName(new)
