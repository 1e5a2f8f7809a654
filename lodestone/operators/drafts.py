"""Several drafts of an answer: who gets which evidence, how far they agree, and what they say together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, overlap, tokens
from .answers import SUPPORT

SAME = 0.7
WEIGHTS = {"grounded": 0.45, "alignment": 0.35, "consensus": 0.2}


def subsets(evidence: DataFrame, most: int = 3) -> DataFrame:
    """evidence(qid, position, document_id, relevance) -> with subset (from 0): by document, those of the
    best passages first, in turn; a question of fewer documents than subsets deals its passages instead.
    A question has min(most, max(2, passages)) subsets, one passage a single one."""
    q = Window.partitionBy("qid")
    by_doc = evidence.groupBy("qid", "document_id").agg(F.max("relevance").alias("best"), F.min("position").alias("first"), F.count("*").alias("k"))
    turn = F.row_number().over(q.orderBy(F.desc("best"), "first", "document_id")) - 1
    by_doc = by_doc.select("qid", "document_id", turn.alias("doc_turn"), F.count("*").over(q).alias("docs"), F.sum("k").over(q).alias("n"))
    x = evidence.join(by_doc, ["qid", "document_id"]).withColumn("_turn", F.row_number().over(q.orderBy("position", "document_id")) - 1)
    m = F.least(F.lit(most), F.greatest(F.lit(2), "n"))
    dealt = F.when((F.col("n") <= 1) | F.lit(most <= 1), F.lit(0)).when(F.col("docs") >= m, F.col("doc_turn") % m).otherwise(F.col("_turn") % m)
    return x.select(*evidence.columns, dealt.cast("int").alias("subset"))


def vocabularies(claims: DataFrame) -> DataFrame:
    """claims(qid, draft, text) -> qid, draft, words: the distinct words of each draft."""
    words = claims.select("qid", "draft", F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("w"))
    return words.groupBy("qid", "draft").agg(F.sort_array(F.collect_set("w")).alias("words"))


def aligned(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(qid, text) -> qid, draft, alignment: share of the question's words in the draft."""
    q = questions.select("qid", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    return vocabularies(claims).join(q, "qid").select("qid", "draft", F.round(overlap(F.col("asked"), F.col("words")), 3).alias("alignment"))


def agreed(claims: DataFrame) -> DataFrame:
    """qid, draft, consensus: mean likeness (Jaccard) to the question's other drafts; 1 for a single one,
    0 without words. Drafts meet on their words, as the likeness needs the number of shared words alone."""
    v = vocabularies(claims)
    per = v.select("qid", "draft", F.size("words").alias("n"), F.count("*").over(Window.partitionBy("qid")).alias("drafts"))
    w = v.select("qid", "draft", F.size("words").alias("n"), F.explode("words").alias("w"))
    o = w.select("qid", F.col("draft").alias("other"), F.col("n").alias("m"), "w")
    both = w.join(o, ["qid", "w"]).where("draft <> other").groupBy("qid", "draft", "other", "n", "m").agg(F.count("*").alias("k"))
    like = both.groupBy("qid", "draft").agg(F.sum(F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("total"))
    mean = F.round(F.coalesce("total", F.lit(0.0)) / (F.col("drafts") - 1), 3)
    x = per.join(like, ["qid", "draft"], "left")
    return x.select("qid", "draft", F.when(F.col("drafts") == 1, 1.0).when(F.col("n") == 0, 0.0).otherwise(mean).alias("consensus"))


def held(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims(qid, draft, source_id, text, quote), evidence(qid, source_id, passage) -> qid, draft, n, grounded: the number
    of a draft's claims, and the share of them whose quote stands in its source and supports them."""
    x = claims.join(evidence.select("qid", "source_id", "passage"), ["qid", "source_id"], "left")
    found = F.coalesce(F.contains(normalize(F.col("passage")), normalize(F.col("quote"))), F.lit(False))
    ok = found & (overlap(tokens(F.col("text")), tokens(F.col("quote"))) >= SUPPORT)
    return x.groupBy("qid", "draft").agg(F.count("*").alias("n"), F.round(F.count_if(ok) / F.count("*"), 3).alias("grounded"))


def scored(drafts: DataFrame) -> DataFrame:
    """drafts(n, grounded, alignment, consensus) -> with score and qualified."""
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return drafts.withColumn("score", F.round(total, 3)).withColumn("qualified", (F.col("n") > 0) & (F.col("grounded") >= 0.7) & (F.col("alignment") >= 0.15))


def decided(questions: DataFrame, evidence: DataFrame, claims: DataFrame, whole: DataFrame) -> DataFrame:
    """questions(qid, text), evidence(qid, source_id, passage), claims(qid, draft, position, source_id, text, quote) of
    competing drafts, whole (claims without draft, of one draft from all evidence) -> qid, position,
    source_id, text, quote, strategy. What the qualified drafts say together, if there are two and it has more
    claims than any of them; else the best draft if it holds; else the whole one."""
    d = held(claims, evidence).join(aligned(claims, questions), ["qid", "draft"]).join(agreed(claims), ["qid", "draft"])
    d = scored(d)
    best = d.groupBy("qid").agg(F.max(F.struct("score", (-F.col("draft")).alias("d"), "grounded"))["d"].alias("d"), F.count_if("qualified").alias("good"), F.max(F.when(F.col("qualified"), F.col("n"))).alias("most"))
    best = best.withColumn("draft", (-F.col("d")).cast("int")).drop("d").join(d.select("qid", "draft", "grounded"), ["qid", "draft"])
    said = synthesized(claims.join(d.select("qid", "draft", "score"), ["qid", "draft"]), evidence)
    said = said.select("qid", F.col("rank").alias("position"), "source_id", "text", "quote")
    count = said.groupBy("qid").agg(F.count("*").alias("together"))
    way = F.when((F.col("good") >= 2) & (F.coalesce("together", F.lit(0)) > F.col("most")), "consensus").when(F.col("grounded") > 0, "best").otherwise("whole")
    how = questions.select("qid").join(best, "qid", "left").join(count, "qid", "left").select("qid", "draft", way.alias("strategy"))
    pick = lambda c, name: c.join(how.where(F.col("strategy") == name).select("qid", "strategy"), "qid")
    one = claims.join(how.where("strategy = 'best'"), ["qid", "draft"]).select("qid", "position", "source_id", "text", "quote", "strategy")
    return pick(said, "consensus").unionByName(one).unionByName(pick(whole.select("qid", "position", "source_id", "text", "quote"), "whole"))


def synthesized(claims: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """claims(qid, draft, score, position, source_id, text, quote), evidence(qid, source_id, passage) -> qid, rank, draft,
    position, source_id, text, quote: claims of the best drafts first whose quote stands in its source, without those of
    which an earlier one holds 70 % of the words; `most` at most. A question has a few drafts of a few
    claims, so each choice is a step of a fold in its row."""
    x = claims.join(evidence.select("qid", "source_id", "passage"), ["qid", "source_id"])
    x = x.where(F.contains(normalize(F.col("passage")), normalize(F.col("quote")))).withColumn("words", F.array_distinct(tokens(F.col("text")))).where(F.size("words") > 0)
    one = F.struct((-F.col("score")).alias("s"), "draft", "position", "text", "words", "source_id", "quote")
    g = x.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = g.select("qid", "all", F.slice("all", 1, 0).alias("none"))
    fold = F.aggregate("all", F.col("none"), lambda s, c: F.when((F.size(s) < most) & ~F.exists(s, lambda p: overlap(c["words"], p["words"]) >= SAME), F.array_append(s, c)).otherwise(s))
    out = kept.select("qid", F.posexplode(fold).alias("at", "c"))
    return out.select("qid", (F.col("at") + 1).alias("rank"), "c.draft", "c.position", "c.source_id", "c.text", "c.quote")
