"""Queries of parent sections, fusion over parts of a question, kept ranks and hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, embedding, retrieval
from .queries import _SMALL, _read, _vectors, dot_sql, passages, query
from .storage import _PARENTS


@query("pl_parent", _PARENTS + """, s as (select document_id, parent, any_value(filename) as filename,
  string_agg(case when shared is null or shared >= n then text when shared > 0 then substr(text, shared + 1) else ' ' || text end, '' order by start_at) as body from c group by document_id, parent)
select id, sha256('[Parent Section: ' || s.filename || ' p.1]' || chr(10) || body) as context_sha256 from c join s using (document_id, parent)""")
def pl_parent(spark, d):
    p = passages(spark, d)
    return chunking.rolled_up(p, chunking.stitched(chunking.parents(p))).select("id", F.sha2("context", 256).alias("context_sha256"))


@query("agg_rrf_multi", """with s as (select l_suppkey as qid, l_linenumber as part, l_partkey as id, max(l_quantity)::double as score from lineitem group by all),
r as (select qid, id, row_number() over (partition by qid, part order by score desc, id) as rank from s)
select qid, id, round(sum(1.0 / (60 + rank)), 9)::double as fusion from r where rank <= 60 group by all""")
def agg_rrf_multi(spark, d):
    """Line numbers stand for the parts of a question, parts in stock for passages."""
    s = _read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_linenumber").alias("channel"), F.col("l_partkey").alias("id"))
    f = retrieval.fused(s.agg(F.max("l_quantity").cast("double").alias("score")).withColumn("weight", F.lit(1.0)))
    return f.select("qid", "id", F.round("fusion", 9).alias("fusion"))


@query("agg_retention", f"""with n as (select vec_id as id, embedding as v, {_SMALL.format('embedding')} as s from embeddings),
x as (select a.id as qid, b.id, round({dot_sql('a.v', 'b.v')} / sqrt({dot_sql('a.v', 'a.v')} * {dot_sql('b.v', 'b.v')}), 9) as whole,
  round({dot_sql('a.s', 'b.s')} / sqrt({dot_sql('a.s', 'a.s')} * {dot_sql('b.s', 'b.s')}), 9) as part from n a, n b where a.id % 20 = 0),
r as (select qid, row_number() over (partition by qid order by whole desc, id) <= 10 as a, row_number() over (partition by qid order by part desc, id) <= 10 as b from x)
select qid, round(count(*) filter (where a and b) / greatest(1, count(*) filter (where a))::double, 6) as retention from r group by qid""")
def agg_retention(spark, d):
    """The stated set of vectors whose id is divisible by 20, against all."""
    p, q = _vectors(spark, d)
    return retrieval.kept_by_prefix(p, q, 16)


@query("scl_vec")
def scl_vec(spark, d):
    """The components of each document's vector that aren't zero."""
    x = embedding.embedded(_read(spark, d, "documents"))
    return x.select("doc_id", F.posexplode("vector").alias("i", "x")).where("x <> 0").select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
