"""Queries of the passage table, its history, the answer cache, names and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, graph, resolution, store
from .queries import _CHUNKS, _read, passages, query


def _events(spark, d):
    return _read(spark, d, "events")


@query("snk_record", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 500")
def snk_record(spark, d):
    """The newest 500 entries of a log."""
    return store.newest(_events(spark, d), "ts", "event_id", 500).select("event_id", "user_id", "event_type")


@query("src_history", "select event_id, json_extract_string(props, '$.k')::bigint as k from events order by ts desc, event_id desc limit 30")
def src_history(spark, d):
    """The newest 30 entries with their payload parsed."""
    return store.newest(_events(spark, d), "ts", "event_id", 30).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _docs(spark, d):
    return _read(spark, d, "documents").withColumn("document_id", F.col("doc_id").cast("string"))


@query("snk_delete", "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def snk_delete(spark, d):
    gone = _read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.without(_docs(spark, d), gone).select("doc_id", "n_chars")


@query("flt_doc", "select doc_id, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)")
def flt_doc(spark, d):
    kept = _read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.only(_docs(spark, d), kept).select("doc_id", "n_chars")


@query("agg_health", "select count(*)::bigint as documents, coalesce(sum(n_chars), 0)::bigint as characters, (select count(*) from pages)::bigint as pages from documents")
def agg_health(spark, d):
    n = _read(spark, d, "documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"))
    return n.crossJoin(_read(spark, d, "pages").agg(F.count("*").alias("pages")))  # one row each


@query("agg_cachestats", "select event_type, count(*) filter (where value >= 100)::bigint as hits, count(*) filter (where value < 100)::bigint as misses, round(count(*) filter (where value >= 100) / greatest(1, count(value))::double, 6) as rate from events group by event_type")
def agg_cachestats(spark, d):
    """Events stand for lookups; those of a value of 100 or more for hits."""
    hit, miss = F.count_if(F.col("value") >= 100), F.count_if(F.col("value") < 100)
    g = _events(spark, d).groupBy("event_type").agg(hit.alias("hits"), miss.alias("misses"))
    return g.withColumn("rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 6))


@query("str_ttl", "select user_id, count(*)::bigint as alive from events where epoch_us((select max(ts) from events)) - epoch_us(ts) < 86400000000 group by user_id")
def str_ttl(spark, d):
    """Entries of the last day before the newest, by user."""
    e = _events(spark, d).withColumnRenamed("ts", "stored_at")
    e = e.crossJoin(F.broadcast(e.agg(F.max("stored_at").alias("now"))))  # one row
    return store.alive(e, F.col("now"), 86400).groupBy("user_id").agg(F.count("*").alias("alive"))


@query("scl_lev", "select s_suppkey, levenshtein(s_name, n_name)::bigint as away from supplier join nation on s_nationkey = n_nationkey")
def scl_lev(spark, d):
    x = _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.select("s_suppkey", F.levenshtein("s_name", "n_name").cast("long").alias("away"))


_SINGULAR = " ".join(f"when ends_with(low, '{a}') then substr(low, 1, length(low) - {len(a)}) || '{b}'" for a, b in T.SINGULARS)


@query("scl_entnorm", f"with x as (select p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) as low from part) select p_partkey, case {_SINGULAR} else low end as name from x")
def scl_entnorm(spark, d):
    return _read(spark, d, "part").select("p_partkey", T.singular(F.col("p_name")).alias("name"))


def _names(spark, d):
    return _read(spark, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")).alias("entity")).distinct()


@query("jn_entpair", """with n as (select distinct lower(p_name) || ' ' || lower(p_type) as name from part),
w as (select name, string_split(name, ' ') as w from n),
p as (select x.name as a, y.name as b, x.w as v, y.w as u, list_distinct(x.w) as dv, list_distinct(y.w) as du from w x, w y where x.name < y.name),
s as (select a, b, case when (starts_with(a, b) or starts_with(b, a)) and least(length(a), length(b)) >= 5 then 0.94 when len(dv) <> len(du) and len(list_intersect(dv, du)) = least(len(dv), len(du)) then 0.9
  when len(list_intersect(dv, du)) / len(list_distinct(list_concat(dv, du)))::double >= 0.7 then round(len(list_intersect(dv, du)) / len(list_distinct(list_concat(dv, du)))::double, 3)
  when least(length(a), length(b)) >= 5 and levenshtein(a, b) = 1 then 0.88 else 0 end::double as likeness from p)
select a, b, likeness from s where likeness >= 0.85""")
def jn_entpair(spark, d):
    """Names of parts and their kinds that likely mean the same."""
    return resolution.pairs(_names(spark, d).select(F.col("entity").alias("name")))


@query("gr_resolve")
def gr_resolve(spark, d):
    return resolution.resolved(graph.members(passages(spark, d)).select("entity"))


def _trade(spark, d):
    """Edges nation - region and supplier - nation."""
    n, r, s = (_read(spark, d, t) for t in ("nation", "region", "supplier"))
    a = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return graph.both_ways(a.unionByName(s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("a"), F.col("n_name").alias("b"))).withColumn("weight", F.lit(1)))


_TRADE = """p as (select n_name as a, r_name as b from nation join region on n_regionkey = r_regionkey union all select s_name, n_name from supplier join nation on s_nationkey = n_nationkey),
e as (select distinct a as src, b as dst from p union select b, a from p)"""


@query("gr_bfs", f"""with recursive {_TRADE}, walk(qid, entity, length, path) as (
  select r_regionkey, r_name, 1, [r_name] from region union all select qid, dst, length + 1, list_append(path, dst) from walk join e on entity = src where length < 3),
best as (select qid, entity, min(length) as length from walk group by all)
select qid, entity, best.length::bigint as length, array_to_string(min(path), '>') as path from walk join best using (qid, entity) where walk.length = best.length group by qid, entity, best.length""")
def gr_bfs(spark, d):
    """What lies within two steps of each region."""
    seeds = _read(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.col("r_name").alias("entity"))
    return graph.reached(_trade(spark, d), seeds).select("qid", "entity", F.col("length").cast("long").alias("length"), F.array_join("path", ">").alias("path"))


@query("gr_ppr")
def gr_ppr(spark, d):
    """Ranks of walks that start at each region."""
    start = _read(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.col("r_name").alias("entity"), F.lit(1.0).alias("weight"))
    return graph.walk_ranks(_trade(spark, d), start).select("qid", "entity", F.round("rank", 6).alias("rank"))


_PARENTS = f"""with recursive {_CHUNKS}, pr as (select *, length(text) as n, row_number() over (partition by document_id order by start_at) as rn from passages_),
fold(document_id, rn, total, parent) as (select document_id, rn, n, 1 from pr where rn = 1 union all
  select p.document_id, p.rn, case when total + n > 1800 then n else total + n end, case when total + n > 1800 then parent + 1 else parent end from fold f join pr p on p.document_id = f.document_id and p.rn = f.rn + 1),
c as (select *, lag(end_at) over (partition by document_id, parent order by start_at) - start_at as shared from pr join fold using (document_id, rn))"""


@query("win_parent", _PARENTS + " select id, parent::bigint as parent from c")
def win_parent(spark, d):
    return chunking.parents(passages(spark, d)).select("id", F.col("parent").cast("long").alias("parent"))


@query("win_stitch", _PARENTS + """ select substr(sha256('parent:' || document_id || ':1:' || min(start_at) || ':' || max(end_at)), 1, 24) as parent_id, count(*)::bigint as children,
  sha256(string_agg(case when shared is null or shared >= n then text when shared > 0 then substr(text, shared + 1) else ' ' || text end, '' order by start_at)) as text_sha256 from c group by document_id, parent""")
def win_stitch(spark, d):
    s = chunking.stitched(chunking.parents(passages(spark, d)))
    return s.select("parent_id", F.size("children").cast("long").alias("children"), F.sha2("text", 256).alias("text_sha256"))


def _blend_sql(a: str, b: str, w: float) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1]::double * {1 - w} + z[2]::double * {w})"


@query("scl_trunc", "with p as (select vec_id, list_slice(embedding, 1, 16) as s from embeddings), n as (select *, sqrt(list_sum(list_transform(s, lambda x: x::double * x::double))) as n from p), u as (select vec_id, list_transform(s, lambda x: case when n > 0 then x::double / n else x::double end) as u from n) select vec_id, unnest(range(len(u)))::bigint as i, round(unnest(u), 6) as x from u")
def scl_trunc(spark, d):
    """The first 16 components, brought to unit length, a row for each."""
    p = _read(spark, d, "embeddings").select("vec_id", F.posexplode(V.prefix(F.col("embedding"), 16)).alias("i", "x"))
    return p.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_CENTRES = "x as (select label, i, sum(x::double) as s from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings) group by all), centre as (select label, list(s order by i) as c from x group by label), unit as (select label, list_transform(c, lambda y: y / sqrt(list_sum(list_transform(c, lambda z: z * z)))) as c from centre)"


def _centred(spark, d):
    """Vectors with the unit centroid of their label; one row for each label is joined."""
    e = _read(spark, d, "embeddings")
    sums = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    centre = sums.groupBy("label").agg(V.normalized(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"])).alias("c"))
    return e.join(centre, "label")


@query("scl_cos", f"with {_CENTRES} select vec_id, round(list_sum(list_transform(list_zip(embedding, c), lambda z: z[1]::double * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) * sqrt(list_sum(list_transform(c, lambda y: y * y)))), 6) as cosine from embeddings join unit using (label)")
def scl_cos(spark, d):
    return _centred(spark, d).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))


@query("scl_blenddoc", f"with {_CENTRES}, b as (select vec_id, {_blend_sql('embedding', 'c', 0.25)} as b from embeddings join unit using (label)), n as (select *, sqrt(list_sum(list_transform(b, lambda y: y * y))) as n from b), u as (select vec_id, list_transform(b, lambda y: y / n) as u from n) select vec_id, unnest(range(len(u)))::bigint as i, round(unnest(u), 6) as x from u")
def scl_blenddoc(spark, d):
    """Vectors drawn a quarter of the way to the centroid of their label, a row for each component."""
    b = _centred(spark, d).select("vec_id", F.posexplode(V.blended(F.col("embedding"), F.col("c"), 0.25)).alias("i", "x"))
    return b.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
