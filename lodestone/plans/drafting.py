"""Queries of the retrieval pipeline as a whole and of drafts that compete."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import drafts, retrieval
from .queries import _read, query, tokens_sql

_CLAIMS = "c as (select conv_id as qid, row_number() over (partition by conv_id order by turn, text) - 1 as draft, turn as position, text, substr(text, 1, 60) as quote from conversations where role = 'assistant')"
_VOCAB = f"v as (select qid, draft, list_distinct({tokens_sql('text')}) as words from c)"


def claims(spark, d):
    """Each assistant turn is a draft of one claim, which quotes its first 60 characters."""
    x = _read(spark, d, "conversations").where("role = 'assistant'")
    draft = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    return x.select(F.col("conv_id").alias("qid"), draft.alias("draft"), F.col("turn").alias("position"), "text", F.substring("text", 1, 60).alias("quote"))


def questions(spark, d):
    x = _read(spark, d, "conversations").where("role = 'user'")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return x.withColumn("k", first).where("k = 1").select(F.col("conv_id").alias("qid"), "text")


@query("agg_consensus", f"""with {_CLAIMS}, {_VOCAB},
p as (select a.qid, a.draft, len(list_intersect(a.words, b.words)) / greatest(1, len(list_distinct(list_concat(a.words, b.words))))::double as j from v a join v b on a.qid = b.qid and a.draft <> b.draft),
m as (select qid, draft, round(avg(j), 3) as m from p group by all)
select qid, draft::bigint as draft, case when m is null then 1.0 when len(words) = 0 then 0.0 else m end::double as consensus from v left join m using (qid, draft)""")
def agg_consensus(spark, d):
    return drafts.agreed(claims(spark, d)).withColumn("draft", F.col("draft").cast("long"))


@query("agg_align", f"""with {_CLAIMS}, {_VOCAB}, q as (select conv_id as qid, list_distinct({tokens_sql('arg_min(text, (turn, text))')}) as asked from conversations where role = 'user' group by conv_id)
select qid, draft::bigint as draft, round(len(list_intersect(asked, words)) / greatest(1, len(asked))::double, 3) as alignment from v join q using (qid)""")
def agg_align(spark, d):
    return drafts.aligned(claims(spark, d), questions(spark, d)).withColumn("draft", F.col("draft").cast("long"))


@query("pl_spec", """with e as (select l_orderkey as qid, l_linenumber as position, l_suppkey as document_id, l_quantity::double as relevance from lineitem),
d as (select qid, document_id, max(relevance) as best, min(position) as first, count(*) as k from e group by all),
t as (select qid, document_id, row_number() over (partition by qid order by best desc, first, document_id) - 1 as doc_turn, count(*) over (partition by qid) as docs, sum(k) over (partition by qid) as n from d),
x as (select e.*, doc_turn, docs, n, least(3, greatest(2, n)) as m, row_number() over (partition by qid order by position, document_id) - 1 as turn from e join t using (qid, document_id))
select qid, position::bigint as position, (case when n <= 1 then 0 when docs >= m then doc_turn % m else turn % m end)::bigint as subset from x""")
def pl_spec(spark, d):
    """Order lines stand for evidence and their suppliers for documents."""
    e = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("document_id"), F.col("l_quantity").cast("double").alias("relevance"))
    return drafts.subsets(e).select("qid", F.col("position").cast("long").alias("position"), F.col("subset").cast("long").alias("subset"))


@query("pl_synth")
def pl_synth(spark, d):
    """Drafts score by their likeness to the others."""
    c = claims(spark, d)
    c = c.join(drafts.agreed(c).withColumnRenamed("consensus", "score"), ["qid", "draft"]).withColumn("source_id", F.col("position").cast("string"))
    x = drafts.synthesized(c, c.select("qid", "source_id", F.col("text").alias("passage")))
    return x.select("qid", F.col("rank").cast("long").alias("rank"), "position", F.sha2("text", 256).alias("text_sha256"))


@query("scl_rerank")
def scl_rerank(spark, d):
    """Assistant turns scored against their conversation's first question."""
    none = F.lit(None).cast("double")
    x = claims(spark, d).join(questions(spark, d).withColumnRenamed("text", "question"), "qid")
    x = x.withColumns({"vector": none, "graph": none, "path": F.lit(None).cast("array<string>")})
    return retrieval.reranked(x).select("qid", "position", "relevance")


@query("agg_ansrel", f"""with q as (select conv_id as qid, list_distinct({tokens_sql('arg_min(text, (turn, text))')}) as asked from conversations where role = 'user' group by conv_id),
a as (select conv_id as qid, {tokens_sql("string_agg(text, ' ' order by turn, text)")} as said from conversations where role = 'assistant' group by conv_id)
select qid, round(len(list_intersect(asked, said)) / greatest(1, len(asked))::double, 3) as answer from q join a using (qid)""")
def agg_ansrel(spark, d):
    """Share of the first question's words in the conversation's answers."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    a = _read(spark, d, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("qid")).agg(whole.alias("said"))
    return questions(spark, d).join(a, "qid").select("qid", F.round(T.overlap(T.tokens(F.col("text")), T.tokens(F.col("said"))), 3).alias("answer"))
