"""Queries of what surrounds a passage and what is left of it for a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import condense, hypothetical, sections
from ..functions import text as T
from ..operators import chunking
from .queries import _CHUNKS, pages, passages, query, tokens_sql, turns
from .scoring import _PAIRS, _SENTENCES, pairs


@query("scl_compress")
def scl_compress(spark, d):
    """Each turn brought down to what bears on the one before."""
    x = pairs(spark, d).select("conv_id", "turn", F.length("text").alias("n"), condense.compressed(F.col("text"), F.col("before")).alias("c"))
    return x.select("conv_id", "turn", "c", F.round(F.length("c") / F.greatest("n", F.lit(1)), 3).alias("ratio"))


@query("scl_strips", f"""with {_PAIRS}, s as (select conv_id, turn, text, list_distinct({tokens_sql('before')}) as q, list_filter({_SENTENCES}, lambda s: length(s) >= {condense.STRIP}) as p from pairs_),
g as (select *, list_filter(p, lambda s: len(q) > 0 and len(list_intersect(q, {tokens_sql('s')})) / greatest(1, len(q))::double >= {condense.STRIP_SHARE}) as g from s)
select conv_id, turn, case when len(g) > 0 then array_to_string(g, ' ') else text end as refined from g""")
def scl_strips(spark, d):
    return pairs(spark, d).select("conv_id", "turn", condense.refined(F.col("text"), F.col("before")).alias("refined"))


@query("scl_hyde")
def scl_hyde(spark, d):
    return turns(spark, d).select("conv_id", "turn", hypothetical.passage(F.col("text")).alias("passage"))


@query("scl_prop")
def scl_prop(spark, d):
    p = passages(spark, d).select("id", F.posexplode(condense.propositions(F.col("text"))).alias("at", "proposition"))
    return p.select("id", F.concat(F.lit("P"), (F.col("at") + 1).cast("string")).alias("key"), "proposition", F.array_join(T.entities(F.col("proposition")), "|").alias("entities"))


@query("scl_propov")
def scl_propov(spark, d):
    """How far the turn before holds what each turn says."""
    return pairs(spark, d).select("conv_id", "turn", condense.stated(F.col("text"), condense.propositions(F.col("before"))).alias("share"))


@query("win_crumb")
def win_crumb(spark, d):
    """The headings above each passage, with the name of its document."""
    found = pages(spark, d).select("filename", sections.headings(F.regexp_replace("text", "\r\n?", "\n")).alias("found"))
    x = passages(spark, d).select("id", "filename", "start").join(found, "filename")
    return x.select("id", sections.header("filename", sections.crumbs(F.col("found"), F.col("start"))).alias("header"))


@query("win_sib", f"""with recursive {_CHUNKS}, p as (select id, document_id, text, row_number() over (partition by document_id order by start_at) as k from passages_),
turns(id, document_id, k, step, n, context, going) as (select id, document_id, k, 0, length(text), text, true from p union all
  select id, document_id, k, step, case when later then n1 + la + 2 else n1 end, case when later then c1 || chr(10) || chr(10) || ta else c1 end, earlier or later from (
    select *, coalesce(n1 + la + 2 <= 1200, false) as later from (
      select *, case when earlier then n + lb + 2 else n end as n1, case when earlier then tb || chr(10) || chr(10) || context else context end as c1 from (
        select t.id, t.document_id, t.k, t.step + 1 as step, n, context, b.text as tb, length(b.text) as lb, a.text as ta, length(a.text) as la, coalesce(n + length(b.text) + 2 <= 1200, false) as earlier
        from turns t left join p b on b.document_id = t.document_id and b.k = t.k - t.step - 1 left join p a on a.document_id = t.document_id and a.k = t.k + t.step + 1 where going and n < 1200)))),
last as (select id, max(step) as step from turns group by id)
select id, sha256(context) as context_sha256 from turns join last using (id, step)""")
def win_sib(spark, d):
    """Each passage with the neighbours that fit in 1,200 characters."""
    return chunking.siblings(passages(spark, d)).select("id", F.sha2("context", 256).alias("context_sha256"))
