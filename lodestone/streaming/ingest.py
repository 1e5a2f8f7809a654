"""Streams into the index, the answers that are kept and the cache. Every micro-batch is one change from
the newest revision to the next, so a batch that is replayed changes nothing: documents are known by
their digest, answers and entries by their id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import library, store
from ..settings import Settings


def start(pages: DataFrame, root: str, checkpoint: str, settings: Settings | None = None):
    """pages(filename, bytes, page, text, status), all pages of a document in one batch -> a query that brings them into the
    index: new documents are added, changed ones replace their former selves, unchanged ones are left alone."""
    s = settings or Settings()

    def write(df: DataFrame, n: int) -> None:
        library.ingest(df.sparkSession, root, df, s)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merged(root: str, name: str, key: str, change):
    def write(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        revision, t = store.load(spark, root, (name,))
        every = df if not t else t[name].unionByName(df)
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
        store.publish(spark, root, {name: change(every.withColumn("_k", last).where("_k = 1").drop("_k"))}, revision)

    return write


def start_history(answers: DataFrame, root: str, checkpoint: str, most: int = store.KEPT):
    """answers(id, created_at, payload) -> a query that keeps the `most` newest of all that came."""
    write = _merged(root, "answers", "id", lambda x: store.newest(x, "created_at", "id", most))
    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_entries(entries: DataFrame, root: str, checkpoint: str, ttl: int = store.TTL):
    """entries(entry_id, stored_at, ...) -> a query that keeps those younger than ttl seconds before the newest."""

    def young(x: DataFrame) -> DataFrame:
        now = x.agg(F.max("stored_at").alias("_now"))
        return store.alive(x.crossJoin(F.broadcast(now)), F.col("_now"), ttl).drop("_now")  # one row

    return entries.writeStream.foreachBatch(_merged(root, "entries", "entry_id", young)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
