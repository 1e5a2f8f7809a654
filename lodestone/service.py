"""The engine as one object: an index in a folder, questions asked of it, answers kept and reused."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ask, communities, graph, library, resolution, store
from .operators.written import written
from .settings import Settings
from .sources import demo, documents

#: Answers that are kept and shown, and characters of a question.
KEPT, SHOWN, MOST_TEXT, MOST_DOCUMENTS = 500, 30, 2000, 100
MODES = {"hybrid", "keyword", "vector", "graph", "auto"}
_ENTRY = "entry_id string, text string, vector array<double>, stored_at timestamp, used_at timestamp, revision string, provider string, model string, mode string, document_ids string, answer string"


class Service:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self._index: tuple | None = None
        self._lookups = {"exact": 0, "semantic": 0, "miss": 0}

    # -- documents

    def ingest(self, folder: str) -> dict:
        """The files of a folder come into the index; those that can't are named with the reason."""
        return self.ingest_pages(documents.read_texts(self.spark, folder, self.settings.max_bytes))

    def ingest_pages(self, pages: DataFrame) -> dict:
        pages = written(pages, "pages")
        failed = pages.where("status <> 'ok'").select("filename", F.col("status").alias("reason"))
        return library.ingest(self.spark, self.root, pages, self.settings) | {"failed": failed}

    def demo(self) -> dict:
        return self.ingest_pages(demo.documents(self.spark))

    def delete(self, document_ids: list[str]) -> int:
        return library.delete(self.spark, self.root, document_ids)

    def documents(self) -> DataFrame:
        return library.listed(self.spark, self.root)

    def health(self) -> dict:
        revision, t = store.load(self.spark, self.root)
        return {"revision": revision, "documents": t["documents"].count() if t else 0, "passages": t["passages"].count() if t else 0}

    def index(self, document_ids: list[str] | None = None) -> tuple[int, library.Index]:
        """The newest revision as an index, of all documents or of some; the last one is kept."""
        revision, t = store.load(self.spark, self.root)
        if not t:
            raise FileNotFoundError("the index is empty")
        meta = t["meta"].first()
        if meta["space"] and meta["space"] != self.settings.space:
            raise ValueError("the index has vectors of another model; use a new index")
        key = (revision, tuple(sorted(document_ids or [])))
        if self._index is None or self._index[0] != key:
            only = None if not document_ids else self.spark.createDataFrame([(x,) for x in document_ids], "document_id string")
            self._index = (key, library.indexed(store.only(t["passages"], only)))
        return revision, self._index[1]

    # -- questions

    def ask(self, questions: DataFrame, document_ids: list[str] | None = None) -> DataFrame:
        """questions(qid, text; mode: hybrid if it isn't given) -> answers (see ask.answered) with cached and revision. A question
        that was answered before, in the same or nearly the same words, of the same revision, gets that answer."""
        q = questions if "mode" in questions.columns else questions.withColumn("mode", F.lit("hybrid"))
        q = written(q.select("qid", F.trim("text").alias("text"), "mode"), "questions")
        bad = q.where(F.col("text").isNull() | (F.length("text") == 0) | (F.length("text") > MOST_TEXT) | ~F.col("mode").isin(*sorted(MODES)))
        if not bad.isEmpty():
            raise ValueError(f"a question has 1 to {MOST_TEXT} characters and one of the modes {', '.join(sorted(MODES))}")
        if len(document_ids or []) > MOST_DOCUMENTS:
            raise ValueError(f"a question names {MOST_DOCUMENTS} documents at most")
        revision, index = self.index(document_ids)
        scope = {"revision": str(revision), "provider": self.settings.provider, "model": self.settings.model, "document_ids": json.dumps(sorted(document_ids or []))}
        asked = ask.routed(q).withColumns({k: F.lit(v) for k, v in scope.items()})
        now = F.current_timestamp()
        hit = None
        if self.settings.cache and (entries := self._cache()) is not None:
            own = ask.supposed(asked.select("qid", "text", "mode"), self.settings)
            asked = written(asked.join(ask.asked_vectors(own, self.settings), "qid", "left"), "asked")
            hit = written(store.cached(asked, entries, now, int(self.settings.cache_ttl), self.settings.cache_like, self.settings.cache_entries), "hits")
            kinds = {r["kind"]: r["n"] for r in hit.groupBy("kind").agg(F.count("*").alias("n")).collect()}
            for k in ("exact", "semantic"):
                self._lookups[k] += kinds.get(k, 0)
            self._lookups["miss"] += asked.count() - sum(kinds.values())
            rest = q.join(hit.select("qid"), "qid", "left_anti")
        else:
            rest = q
            self._lookups["miss"] += q.count() if self.settings.cache else 0
        fresh = written(ask.answered(index, rest, self.settings).withColumn("revision", F.lit(revision)), "answers")
        out = fresh.withColumn("cached", F.lit(False))
        if hit is not None:
            known = hit.join(entries.select("entry_id", "answer"), "entry_id").join(q.select("qid", F.col("text").alias("_text")), "qid")
            old = known.select("qid", "_text", F.from_json("answer", fresh.schema).alias("a")).select("qid", *[F.col("_text").alias(c) if c == "question" else F.col(f"a.{c}").alias(c) for c in fresh.columns if c != "qid"], F.lit(True).alias("cached"))
            out = written(out.unionByName(old), "answers")
        if self.settings.cache:
            self._remember(fresh, asked if hit is not None else None, scope, entries if hit is not None else None, hit, now)
        self._record(out)
        return out

    def ask_one(self, text: str, mode: str = "hybrid", document_ids: list[str] | None = None) -> dict:
        return self.ask(self.spark.createDataFrame([(0, text, mode)], "qid int, text string, mode string"), document_ids).first().asDict(recursive=True)

    def export(self, answers: DataFrame) -> DataFrame:
        """qid, json: each answer with its evidence."""
        return answers.select("qid", F.to_json(F.struct(*answers.columns)).alias("json"))

    # -- tables beside the index: answers and the cache, each in revisions of its own

    def _cache(self) -> DataFrame | None:
        return store.load(self.spark, f"{self.root}/cache", ("entries",))[1].get("entries")

    def _remember(self, fresh: DataFrame, asked: DataFrame | None, scope: dict, entries: DataFrame | None, hit: DataFrame | None, now) -> None:
        if asked is None:
            own = ask.supposed(fresh.select("qid", F.col("question").alias("text"), "mode"), self.settings)
            asked = own.select("qid").join(ask.asked_vectors(own, self.settings), "qid", "left")
        new = fresh.join(asked.select("qid", "vector"), "qid", "left").withColumns({k: F.lit(v) for k, v in scope.items()})
        new = new.select(F.uuid().alias("entry_id"), F.col("question").alias("text"), "vector", now.alias("stored_at"), now.alias("used_at"), *scope, "mode", F.to_json(F.struct(*fresh.columns)).alias("answer"))
        old = self.spark.createDataFrame([], _ENTRY) if entries is None else store.alive(entries, now, int(self.settings.cache_ttl))
        if hit is not None:
            old = store.touched(old, hit, now)
        self._publish("cache", "entries", store.put(old, new.select(*old.columns), self.settings.cache_entries))

    def _record(self, answers: DataFrame) -> None:
        new = answers.select(F.uuid().alias("id"), F.current_timestamp().alias("created_at"), F.to_json(F.struct(*answers.columns)).alias("payload"))
        _, t = store.load(self.spark, f"{self.root}/history", ("answers",))
        every = new if not t else t["answers"].unionByName(new)
        self._publish("history", "answers", store.newest(every, "created_at", "id", KEPT))

    def _publish(self, name: str, table: str, df: DataFrame) -> None:
        n, _ = store.load(self.spark, f"{self.root}/{name}", (table,))
        store.publish(self.spark, f"{self.root}/{name}", {table: df}, n)

    def cache_clear(self) -> None:
        self._publish("cache", "entries", self.spark.createDataFrame([], _ENTRY))

    def cache_stats(self) -> dict:
        kinds = [(k if k != "miss" else None,) for k, n in self._lookups.items() for _ in range(n)]
        got = store.cache_stats(self.spark.createDataFrame(kinds, "kind string")).first().asDict()
        entries = self._cache()
        return got | {"size": 0 if entries is None else entries.count(), "entries": self.settings.cache_entries, "ttl": self.settings.cache_ttl, "like": self.settings.cache_like, "enabled": self.settings.cache}

    def history(self, most: int = SHOWN) -> DataFrame:
        """The newest answers: id, created_at, payload (JSON)."""
        _, t = store.load(self.spark, f"{self.root}/history", ("answers",))
        return store.newest(t["answers"], "created_at", "id", most) if t else self.spark.createDataFrame([], "id string, created_at timestamp, payload string")

    # -- the graph

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges to draw."""
        return graph.view(self.index()[1].members)

    def communities(self) -> DataFrame:
        i = self.index()[1]
        pairs = i.edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
        return communities.reports(i.passages, i.members, pairs, graph.cut(communities.labelled(pairs)))

    def aliases(self) -> DataFrame:
        return resolution.aliases(self.index()[1].names)

    # -- trial

    def evaluate(self) -> dict:
        """Share of the sample questions whose source is found, and whether an unrelated one is declined, on an
        index of the sample documents beside this one."""
        own = Service(self.spark, f"{self.root}/trial-{uuid.uuid4().hex}", self.settings)
        own.demo()
        asked = demo.questions(self.spark)
        unknown = self.spark.createDataFrame([(-1, demo.UNKNOWN)], "qid int, text string")
        got = own.ask(asked.select("qid", "text").unionByName(unknown)).select("qid", "status", F.transform("evidence", lambda e: e["filename"]).alias("files"))
        rows = got.join(asked, "qid", "left").select("qid", "text", "expected", "status", F.array_contains("files", F.col("expected")).alias("found")).orderBy("qid").collect()  # the sample's questions
        cases = [r.asDict() for r in rows if r["qid"] >= 0]
        return {"at": datetime.now(timezone.utc).isoformat(), "cases": cases, "recall": sum(bool(c["found"]) for c in cases) / len(cases), "unknown_declined": next(r["status"] for r in rows if r["qid"] < 0) == "abstained"}
