"""The engine's queries over the test tables, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import text as T
from ..functions import vectors as V
from ..operators import answers, chunking, graph, retrieval
from ..operators.written import written
from ..sources import documents as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(1).alias("page"), "text")


def passages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.passages(pages(spark, d))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "conversations").select("conv_id", "turn", "text")


# -- SQL building blocks

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[a-z0-9_]+|[\\x{{3400}}-\\x{{9FFF}}]'), lambda w: not list_contains({_STOP}, w))"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def any_sql(x: str, patterns: list[str]) -> str:
    return "(" + " or ".join("regexp_matches({}, '{}')".format(x, p.replace("'", "''")) for p in patterns) + ")"


#: Letters beyond ASCII that the tables have; in SQL they become a word character that no name holds.
_LETTERS = "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha())


def entities_sql(x: str) -> str:
    """The entities of a text without marks, as the tables are."""
    plain = f"translate(regexp_replace({x}, '(?m)^\\s*#{{1,6}}\\s+.*$', '', 'g'), '{_LETTERS}', '{'_' * len(_LETTERS)}')"
    names = f"regexp_extract_all({plain}, '\\b(?:[A-Z][a-zA-Z0-9]+(?:[ -][A-Z][a-zA-Z0-9]+){{0,2}}|[A-Z]{{2,}})\\b')"
    clean = f"list_transform({names}, lambda n: regexp_replace(lower(n), '^(?:(?:{'|'.join([*T.STOP_WORDS, *T.CONNECTORS])})(?: |$))+', ''))"
    return f"list_slice(list_sort(list_distinct(list_filter({clean}, lambda n: length(n) > 1))), 1, 24)"


_PAGES = "pages_ as (select source || '-' || doc_id || '.txt' as filename, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as body from documents)"
_CUT = """case when s + {size} < length(body) then
   s + {size} - coalesce(nullif(least(coalesce(nullif(instr(reverse(substr(body, s + {half} + 1, {rest})), chr(10)), 0), 1000000), coalesce(nullif(instr(reverse(substr(body, s + {half} + 1, {rest})), ' '), 0), 1000000)), 1000000), 0)
   else length(body) end""".format(size=chunking.SIZE, half=chunking.SIZE // 2, rest=chunking.SIZE - chunking.SIZE // 2)
_CHUNKS = f"""{_PAGES}, cuts(filename, body, s, e) as (
  select filename, body, s, {_CUT} from (select filename, body, 0 as s from pages_ where length(body) > 0)
  union all
  select filename, body, s, {_CUT} from (select filename, body, greatest(s + 1, e - {chunking.OVERLAP}) as s from cuts where e < length(body))),
passages_ as (select filename, substr(sha256(filename), 1, 24) as document_id, s as start_at, e as end_at, substr(body, s + 1, e - s) as text,
  substr(sha256(substr(sha256(filename), 1, 24) || ':1:' || s || ':' || substr(body, s + 1, e - s)), 1, 24) as id
  from cuts where length(trim(regexp_replace(substr(body, s + 1, e - s), '\\s+', '', 'g'))) > 0)"""


@query("scl_tokens", f"with t as (select doc_id, {tokens_sql('text')} as w from documents) select doc_id, len(w)::bigint as n_tokens, sha256(array_to_string(w, ' ')) as tokens_sha256 from t")
def scl_tokens(spark, d):
    t = _read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.sha2(F.array_join("w", " "), 256).alias("tokens_sha256"))


@query("scl_norm", f"select doc_id, length({norm_sql('text')})::bigint as n, sha256({norm_sql('text')}) as sha from documents")
def scl_norm(spark, d):
    n = T.normalize(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("n"), F.sha2(n, 256).alias("sha"))


@query("prj_chunk", f"with recursive {_CHUNKS} select id, document_id, filename, start_at::bigint as start_at, end_at::bigint as end_at, sha256(text) as text_sha256 from passages_")
def prj_chunk(spark, d):
    return passages(spark, d).select("id", "document_id", "filename", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.sha2("text", 256).alias("text_sha256"))


@query("src_html")
def src_html(spark, d):
    return S.stripped(_read(spark, d, "pages"), "page_id").select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("agg_tf", f"with w as (select doc_id, unnest({tokens_sql('text')}) as term from documents) select doc_id, term, count(*)::bigint as tf from w group by all")
def agg_tf(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.postings(docs).select(F.col("id").alias("doc_id"), "term", "tf")


@query("agg_len", f"select count(*)::bigint as n, sum(len({tokens_sql('text')}))::bigint as total, avg(len({tokens_sql('text')})) as mean from documents")
def agg_len(spark, d):
    n = _read(spark, d, "documents").select(F.size(T.tokens(F.col("text"))).alias("n"))
    return n.agg(F.count("*").alias("n_"), F.sum("n").cast("long").alias("total"), F.avg("n").alias("mean")).withColumnRenamed("n_", "n")


_BM25 = f"""with recursive {_CHUNKS},
w as (select id, {tokens_sql('text')} as ws from passages_),
n as (select count(*)::double as n, case when avg(len(ws)) > 0 then avg(len(ws)) else 1 end as mean from w),
q as (select item_id as qid, unnest(list_distinct({tokens_sql('text')})) as term from benchmark),
tf as (select id, length, term, count(*) as tf from (select id, len(ws) as length, unnest(ws) as term from w) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
scored as (select qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) as score from q join tf using (term) join df using (term), n group by qid, id)"""


@query("agg_bm25", _BM25 + " select qid, id, round(score, 6) as score from scored where score > 0")
def agg_bm25(spark, d):
    return retrieval.keyword_scores(passages(spark, d), asked(spark, d)).select("qid", "id", F.round("score", 6).alias("score"))


@query("win_rank", _BM25 + ", r as (select qid, id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, id) as rank from scored where score > 0) select qid, id, score, rank::bigint as rank from r where rank <= 60")
def win_rank(spark, d):
    s = retrieval.keyword_scores(passages(spark, d), asked(spark, d), most=retrieval.DEPTH, digits=6)
    return retrieval.ranked(s).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


_SMALL = "list_slice({0}, 1, 16)"
_FUNNEL = f"""with v as (select vec_id as id, embedding as v, sqrt({dot_sql(_SMALL.format('embedding'), _SMALL.format('embedding'))}) as n from embeddings),
u as (select id, v, list_transform(list_slice(v, 1, 16), lambda x: case when n > 0 then x::double / n else x::double end) as small from v),
p as (select a.id as qid, b.id, a.v as asked, b.v, {dot_sql('b.small', 'a.small')} as first from u a, u b where a.id % 20 = 0),
r as (select *, row_number() over (partition by qid order by round(first, 9) desc, id) as k from p),
s as (select qid, id, 0.9 * {dot_sql('v', 'asked')} + 0.1 * first as score from r where k <= 60)
select qid, id, round(least(score, 1.0), 6) as score from s where score > 0"""


@query("vec_funnel", _FUNNEL)
def vec_funnel(spark, d):
    """Questions are the stated set of vectors whose id is divisible by 20, held against all vectors."""
    p, q = _vectors(spark, d)
    return retrieval.funnel_scores(p, q, coarse=16).select("qid", "id", F.round("score", 6).alias("score"))


@query("scl_normvec", f"select vec_id, round(sqrt({dot_sql('embedding', 'embedding')}), 6) as norm, round(list_sum(list_transform(embedding, lambda x: x::double / sqrt({dot_sql('embedding', 'embedding')}))), 6) as unit_sum from embeddings")
def scl_normvec(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.aggregate(V.normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


@query("agg_centroid", "with x as (select label, i, sum(x::double) as s from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings) group by all), n as (select label, sqrt(sum(s * s)) as n from x group by label) select label, i::bigint as i, round(s / n, 6) as c from x join n using (label)")
def agg_centroid(spark, d):
    x = _read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    n = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("label")))
    return x.select("label", F.col("i").cast("long").alias("i"), F.round(F.col("s") / n, 6).alias("c"))


def _predicate(name: str, column, sql: str):
    def run(spark, d):
        return turns(spark, d).select("conv_id", "turn", column(F.col("text")).alias("answer"))

    query(name, f"select conv_id, turn, {sql} as answer from conversations")(run)


_LOW = "lower(trim(text))"
_predicate("prd_global", Q.is_global, any_sql(_LOW, Q.GLOBAL))
_predicate("prd_thematic", Q.is_thematic, any_sql(_LOW, Q.THEMATIC))
_predicate("prd_multihop", Q.needs_hops, f"length({_LOW}) >= 18 and {any_sql(_LOW, Q.MULTIHOP)}")
_predicate("prd_compound", Q.is_compound, f"contains(substr({_LOW}, 1, length({_LOW}) - 1), '?') or {any_sql(_LOW, Q.COMPOUND)}")
_predicate("prd_retneed", Q.needs_retrieval, f"not (regexp_matches({_LOW}, '{Q.GREETING}') and len(regexp_split_to_array({_LOW}, '\\s+')) <= 3)")
_predicate("prj_route", Q.route, f"""case when trim(text) = '' then 'empty' when {any_sql(_LOW, Q.GLOBAL)} then 'global' when {any_sql(_LOW, Q.RELATIONAL)} then 'relational'
  when {any_sql('trim(text)', Q.IDENTIFIER)} and len(regexp_split_to_array(trim(text), '\\s+')) <= 8 then 'exact'
  when {any_sql(_LOW, Q.CONCEPTUAL)} and not {any_sql('trim(text)', Q.IDENTIFIER)} then 'conceptual' else 'other' end""")


@query("prj_mode", f"with r as ({ORACLE_SQL['prj_route']}) select conv_id, turn, case answer " + " ".join(f"when '{k}' then '{m}'" for k, (m, _) in Q.ROUTES.items()) + " end as mode, (case answer " + " ".join(f"when '{k}' then {c}" for k, (_, c) in Q.ROUTES.items()) + " end)::double as confidence from r")
def prj_mode(spark, d):
    """The mode in which each turn would be searched, and how sure that choice is."""
    mode, sure = Q.routed(F.col("text"))
    return turns(spark, d).select("conv_id", "turn", mode.alias("mode"), sure.cast("double").alias("confidence"))


@query("prd_boiler", "select doc_id, count(*) filter (where " + any_sql("lower(line)", T.BOILERPLATE) + ")::bigint as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id")
def prd_boiler(spark, d):
    lines = _read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_boilerplate(F.col("line"))).alias("n"))


@query("jn_leftcount", f"with recursive {_CHUNKS} select p.filename, count(c.id)::bigint as passages, length(any_value(p.body))::bigint as chars from pages_ p left join passages_ c using (filename) group by p.filename")
def jn_leftcount(spark, d):
    p = pages(spark, d).select("filename", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")).cast("long").alias("chars"))
    n = passages(spark, d).groupBy("filename").agg(F.count("*").alias("passages"))
    return p.join(n, "filename", "left").select("filename", F.coalesce("passages", F.lit(0)).cast("long").alias("passages"), "chars")


@query("prj_reorder", "with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) as rank, count(*) over (partition by conv_id) as n from conversations) select conv_id, turn, case when n <= 2 then rank when rank % 2 = 1 then (rank + 1) // 2 else n - rank // 2 + 1 end::int as position from r")
def prj_reorder(spark, d):
    c = _read(spark, d, "conversations")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    n = F.count("*").over(Window.partitionBy("conv_id"))
    x = c.select("conv_id", "turn", rank.alias("rank"), n.cast("int").alias("n"))
    return x.select("conv_id", "turn", retrieval.edge_order(F.col("rank"), F.col("n")).alias("position"))


@query("scl_jaccard", f"with c as (select conv_id, turn, list_distinct({tokens_sql('text')}) as w, list_distinct({tokens_sql('lag(text) over (partition by conv_id order by turn, role, text)')}) as p from conversations) select conv_id, turn, round(case when len(list_distinct(list_concat(w, p))) > 0 then len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p)))::double else 0 end, 6) as j from c")
def scl_jaccard(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = _read(spark, d, "conversations").select("conv_id", "turn", "text", before.alias("before"))
    c = c.select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("w"), F.array_distinct(T.tokens(F.col("before"))).alias("p"))
    return c.select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("p")), 6).alias("j"))


_CLAIMS = "conv_id as qid, turn as position, text, substr(text, 1, 60) as quote"


@query("pl_verify", f"""with claims as (select {_CLAIMS} from conversations where role = 'assistant'),
e as (select conv_id as qid, string_agg(text, ' ' order by turn, role, text) as passage from conversations where role <> 'user' group by conv_id),
v as (select c.*, case when passage is null then 'no_source' when not contains({norm_sql('passage')}, {norm_sql('quote')}) then 'no_quote'
  when len(list_intersect(list_distinct({tokens_sql('text')}), {tokens_sql('quote')})) / greatest(1, len(list_distinct({tokens_sql('text')})))::double < 0.45 then 'unsupported' else 'ok' end as verdict from claims c left join e using (qid))
select qid, bool_and(verdict = 'ok') as supported, coalesce(arg_min(verdict, position) filter (where verdict <> 'ok'), 'ok') as reason from v group by qid""")
def pl_verify(spark, d):
    """Assistant turns are claims that quote their first 60 characters from the conversation's other turns."""
    c = _read(spark, d, "conversations")
    claims = c.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("position"), F.lit("S1").alias("source_id"), "text", F.substring("text", 1, 60).alias("quote"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), " ")
    evidence = c.where("role <> 'user'").groupBy(F.col("conv_id").alias("qid")).agg(whole.alias("passage")).withColumn("source_id", F.lit("S1"))
    return answers.verified(claims, evidence)


@query("agg_recall", _BM25 + f""", r as (select qid, id, row_number() over (partition by qid order by round(score, 6) desc, id) as rank from scored where score > 0),
b as (select item_id as qid, {norm_sql('text')} as want from benchmark),
hit as (select qid, rank from r join passages_ using (id) join b using (qid) where contains({norm_sql('passages_.text')}, want))
select b.qid, coalesce(bool_or(rank <= 5), false) as found from b left join hit using (qid) group by b.qid""")
def agg_recall(spark, d):
    """For each benchmark item, whether one of the five best passages holds it whole."""
    p, q = written(passages(spark, d), "passages"), asked(spark, d)
    top = retrieval.ranked(retrieval.keyword_scores(p, q, most=5, digits=6), 5)
    x = top.join(p.select("id", F.col("text").alias("passage")), "id").join(q, "qid")
    hit = x.where(F.contains(T.normalize(F.col("passage")), T.normalize(F.col("text")))).select("qid").distinct().withColumn("hit", F.lit(True))
    return q.select("qid").join(hit, "qid", "left").select("qid", F.coalesce("hit", F.lit(False)).alias("found"))


@query("agg_rrf", _BM25 + """, cover as (select qid, id, round(count(*) / (n + m - count(*))::double, 6) as score from (select id, len(list_distinct(ws)) as n, unnest(list_distinct(ws)) as term from w)
  join (select qid, term, count(*) over (partition by qid) as m from q) using (term) group by qid, id, n, m),
c as (select qid, 'keyword' as channel, id, round(score, 6) as score, 1.2 as weight from scored where score > 0 union all select qid, 'overlap', id, score, 0.8 from cover),
r as (select *, row_number() over (partition by qid, channel order by score desc, id) as rank from c)
select qid, id, round(sum(weight::double / (60 + rank)), 9) as fusion, string_agg(channel, ',' order by channel) as channels from r where rank <= 60 group by qid, id""")
def agg_rrf(spark, d):
    """Two channels, BM25 over passages and over their documents' names of the same passages, fused."""
    text, cover = retrieval.channel_scores(passages(spark, d), asked(spark, d), 6)
    both = text.select("qid", F.lit("keyword").alias("channel"), "id", "score", F.lit(1.2).alias("weight")).unionByName(cover.select("qid", F.lit("overlap").alias("channel"), "id", "score", F.lit(0.8).alias("weight")))
    f = retrieval.fused(both)
    return f.select("qid", "id", F.round("fusion", 9).alias("fusion"), F.array_join("channels", ",").alias("channels"))


@query("scl_entities", f"with e as (select doc_id, {entities_sql('text')} as e from documents) select doc_id, len(e)::bigint as n, array_to_string(e, '|') as entities from e")
def scl_entities(spark, d):
    e = T.entities(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(e).cast("long").alias("n"), F.array_join(e, "|").alias("entities"))


_MEMBERS = f"with recursive {_CHUNKS}, m as (select id, {entities_sql('text')} as e from passages_)"


@query("agg_node", _MEMBERS + " select entity, count(*)::bigint as n from (select unnest(e) as entity from m) group by entity order by n desc, entity limit 45")
def agg_node(spark, d):
    return graph.nodes(graph.members(passages(spark, d)))


@query("jn_cooc", _MEMBERS + ", n as (select id, unnest(e) as entity from m) select x.entity as a, y.entity as b, count(*)::bigint as weight from n x join n y on x.id = y.id and x.entity < y.entity group by a, b")
def jn_cooc(spark, d):
    return graph.edges_within(passages(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return win_rank(spark, d)


from . import communities, context, drafting, passages as _passages, scoring, storage  # noqa: E402, F401  they register their queries
from . import engine  # noqa: E402, F401
