"""Queries that score passages, rewrite questions and judge evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rewriting as R
from ..functions import scoring as C
from ..functions import text as T
from ..operators import answers
from .queries import _read, entities_sql, norm_sql, query, tokens_sql, turns

_PAIRS = "pairs_ as (select * from (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn, role, text) as before from conversations) where before is not null)"
_WORDS = "regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '{1}')"


def pairs(spark, d):
    """Each turn and the one before it: a passage and a question."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return _read(spark, d, "conversations").select("conv_id", "turn", "role", "text", before.alias("before")).where("before is not null")


def grams_sql(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def share_sql(parts: str, body: str) -> str:
    return f"len(list_filter({parts}, lambda g: contains({body}, g))) / greatest(1, len({parts}))::double"


@query("scl_phrase", f"""with {_PAIRS}, w as (select conv_id, turn, {_WORDS.format('before', '[a-z0-9]+')} as w, array_to_string({_WORDS.format('text', '[a-z0-9]+')}, ' ') as body from pairs_),
g as (select *, {grams_sql('w', 2)} as two, {grams_sql('w', 3)} as three from w)
select conv_id, turn, case when len(w) = 0 or body = '' then 0.0 when contains(body, array_to_string(w, ' ')) then 1.0 when len(w) = 1 then 0.0
  when len(w) = 2 then round({share_sql('two', 'body')}, 4) else round(0.6 * {share_sql('two', 'body')} + 0.4 * {share_sql('three', 'body')}, 4) end::double as score from g""")
def scl_phrase(spark, d):
    return pairs(spark, d).select("conv_id", "turn", C.phrase(F.col("before"), F.col("text")).alias("score"))


@query("scl_prox", f"""with {_PAIRS}, w as (select conv_id, turn, list_distinct({tokens_sql('before')}) as q, {_WORDS.format('text', '[a-z0-9_]+')} as w from pairs_),
p as (select *, list_filter(range(1, len(w) + 1), lambda i: list_contains(q, w[i])) as pos, least(len(q), 3) as n from w),
s as (select *, least(len(w), coalesce(list_min(list_transform(range(1, len(pos) - n + 2), lambda i: pos[i + n - 1] - pos[i] + 1)), len(w))) as span from p)
select conv_id, turn, case when len(pos) = 0 or len(q) = 0 then 0.0 when len(pos) = 1 then 0.5 else round(least(1.0, greatest(0.0, 1.0 - (span - n)::double / 50)), 4) end::double as score from s""")
def scl_prox(spark, d):
    return pairs(spark, d).select("conv_id", "turn", C.proximity(F.array_distinct(T.tokens(F.col("before"))), F.col("text")).alias("score"))


@query("scl_maxsim", f"""with {_PAIRS}, p as (select conv_id, turn, {tokens_sql('before')} as q, list_distinct({tokens_sql('text')}) as t from pairs_),
q as (select conv_id, turn, unnest(q) as x, unnest(range(len(q))) as i from p), t as (select conv_id, turn, unnest(t) as y from p),
words as (select distinct x, y from (select distinct conv_id, turn, x from q) join t using (conv_id, turn)),
u as (select x, y, greatest(length(x), length(y)) as longest, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[1:i] = y[1:i])) as begins,
  list_distinct(list_transform(range(1, length(x)), lambda i: x[i:i + 1])) as a, list_distinct(list_transform(range(1, length(y)), lambda i: y[i:i + 1])) as b from words),
j as (select *, case when length(x) >= 4 and length(y) >= 4 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double else 0 end as jac from u),
l as (select x, y, case when x = y then 1.0 when begins >= 4 and begins / longest >= 0.65 then round(0.7 + 0.3 * begins / longest, 3) when jac >= 0.65 then round(jac, 3) else 0.0 end::double as like_ from j),
best as (select conv_id, turn, i, max(like_) as m from q join t using (conv_id, turn) join l using (x, y) group by all)
select conv_id, turn, coalesce(round(avg(m), 4), 0)::double as score from p left join best using (conv_id, turn) group by conv_id, turn""")
def scl_maxsim(spark, d):
    """Each turn against the one before, word by word."""
    p = pairs(spark, d)
    return p.select("conv_id", "turn", C.late_interaction(T.tokens(F.col("before")), T.tokens(F.col("text"))).alias("score"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query("scl_sentscore", f"""with {_PAIRS}, s as (select conv_id, turn, before, unnest({_SENTENCES}) as s from pairs_),
w as (select *, {tokens_sql('before')} as q, regexp_extract_all(lower(before), '[a-z0-9_]+') as runs, {tokens_sql('s')} as t, lower(s) as low from s),
c as (select *, len(list_intersect(list_distinct(q), t)) / greatest(1, len(list_distinct(q)))::double as cover, len(list_filter({grams_sql('runs', 2)}, lambda g: contains(low, g))) > 0 as paired from w),
r as (select *, case when length(s) < 15 or len(t) = 0 or regexp_matches(low, '{T.BOILERPLATE[0]}|{T.BOILERPLATE[1]}|{T.BOILERPLATE[2]}') or (cover = 0 and not paired) then 0.0
  else least(1.0, round(cover + case when paired then 0.25 else 0 end + case when regexp_matches(low, '{C.DEFINING}') then 0.05 else 0 end, 4)) end::double as score from c)
select conv_id, turn, count(*)::bigint as n_sentences, max(score) as best, round(sum(score), 4) as total from r group by conv_id, turn""")
def scl_sentscore(spark, d):
    s = pairs(spark, d).select("conv_id", "turn", C.sentence_scores(T.sentences(F.col("text")), F.col("before")).alias("all"))
    s = s.select("conv_id", "turn", F.explode("all").alias("score"))
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("n_sentences"), F.max("score").alias("best"), F.round(F.sum("score"), 4).alias("total"))


def terms_sql(x: str, least: int, but: tuple[str, ...] = ()) -> str:
    gone = " and w not in (" + ", ".join(f"'{w}'" for w in but) + ")" if but else ""
    return f"list_filter({tokens_sql(x)}, lambda w: length(w) >= {least}{gone})"


def _rewriting(name: str, column, clean: str, terms: str, least: int = 1, last: str = "clean"):
    def run(spark, d):
        return turns(spark, d).select("conv_id", "turn", column(F.col("text")).alias("rewritten"))

    sql = f"with c as (select conv_id, turn, text, {clean} as clean from conversations), t as (select *, {terms} as w from c)"
    query(name, f"{sql} select conv_id, turn, case when len(w) >= {least} then array_to_string(w, ' ') else {last} end as rewritten from t")(run)


_rewriting("scl_fallq", R.fallback, f"regexp_replace(regexp_replace(trim(text), '(?i){R.POLITE}', ''), '[?!. ]+$', '')", terms_sql("clean", 3))
_rewriting("scl_corrq", R.corrective, f"trim(regexp_replace({norm_sql('text')}, '(?i){R.ASKING}', ''))", terms_sql("clean", 3, R.FILLER))
_rewriting("scl_activeq", R.active, f"trim(regexp_replace(trim(regexp_replace(text, '{R.CITATION}', '', 'g')), '(?i){R.TRANSITION}', ''))", terms_sql("clean", 2), 2, "case when clean <> '' then clean else trim(text) end")


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_WEIGHED = f"""with e as (select conv_id, turn, 1.0 + case when regexp_matches(text, '{_re(R.QUOTED)}') then 0.8 else 0 end + case when regexp_matches(text, '{_re(R.CODE)}') then 0.6 else 0 end as k,
  1.0 + case when regexp_matches(text, '{_re(R.RELATION)}') then 0.8 when len({entities_sql('text')}) > 0 then 0.5 else 0 end as g,
  1.0 + case when regexp_matches(text, '{_re(R.EXPLAIN)}') or len(regexp_split_to_array(trim(text), '\\s+')) >= 8 then 0.6 else 0 end as v from conversations)
select conv_id, turn, """ + ", ".join(f"round({c}::double * 3 / (k + v + g)::double, 3) as {n}" for c, n in (("k", "keyword"), ("v", "vector"), ("g", "graph"))) + " from e"


@query("prj_weights", _WEIGHED)
def prj_weights(spark, d):
    w = R.weights(F.col("text"))
    return turns(spark, d).select("conv_id", "turn", w["keyword"].alias("keyword"), w["vector"].alias("vector"), w["graph"].alias("graph"))


_BARE = "regexp_replace(trim({0}), '\\?+$', '')"


def _part(pattern: str, i: int, text: str = "clean") -> str:
    return _BARE.format(f"regexp_extract({text}, '{_re(pattern)}', {i})")


_PARTS = f"""with c as (select conv_id, turn, trim(text) as clean, list_transform(list_filter(string_split(trim(text), '?'), lambda p: trim(p) <> ''), lambda p: trim(p) || '?') as several from conversations),
p as (select conv_id, turn, list_slice(case when clean = '' then [] when contains(substr(clean, 1, length(clean) - 1), '?') and len(several) > 1 then several
  when regexp_matches(clean, '{_re(R.COMPARE)}') then ['Details about ' || {_part(R.COMPARE, 1)}, 'Details about ' || {_part(R.COMPARE, 2)}]
  when regexp_matches(clean, '{_re(R.VERSUS)}') then ['Details about ' || {_part(R.VERSUS, 1)}, 'Details about ' || {_part(R.VERSUS, 2)}]
  when regexp_matches(clean, '{_re(R.JOINED)}') then [{_part(R.JOINED, 1)} || '?', {_part(R.JOINED, 2)} || '?'] else [clean] end, 1, 3) as p from c)
select conv_id, turn, len(p)::bigint as n, array_to_string(p, '|') as parts from p"""


@query("scl_decomp", _PARTS)
def scl_decomp(spark, d):
    p = R.parts(F.col("text"))
    return turns(spark, d).select("conv_id", "turn", F.size(p).cast("long").alias("n"), F.array_join(p, "|").alias("parts"))


@query("scl_followq", f"""with {_PAIRS}, w as (select conv_id, turn, before as q, list_sort(list_transform({tokens_sql('text')}, lambda x: {{'n': length(x), 'w': x}}), 'DESC')[1].w as bridge from pairs_),
n as (select *, trim(regexp_replace(q, '{_re(R.PRONOUN)}', coalesce(bridge, ''), 'g')) as named from w)
select conv_id, turn, case when bridge is null then q when regexp_matches(q, '{_re(R.CLAUSE)}') then 'How does ' || bridge || ' ' || {_part(R.CLAUSE, 1, 'q')} || '?' when lower(named) <> lower(trim(q)) then named else bridge || ' ' || q end as question from n""")
def scl_followq(spark, d):
    """The longest word of the turn stands for the bridge."""
    w = T.tokens(F.col("text"))
    longest = F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    return pairs(spark, d).select("conv_id", "turn", R.followup(F.col("before"), longest).alias("question"))


_FOUND = f"""q_ as (select conv_id, text as question, row_number() over (partition by conv_id order by turn, role, text) as k from conversations where role = 'user'),
found_ as (select c.conv_id as qid, question, turn as position, text as passage, list_distinct({tokens_sql('question')}) as q, {tokens_sql('text')} as t from conversations c join q_ on c.conv_id = q_.conv_id and k = 1 where role = 'assistant'),
e_ as (select *, len(list_intersect(q, t)) / greatest(1, len(q))::double as relevance from found_)"""


def found(spark, d):
    """The first user turn of a conversation asks; its assistant turns are what was found."""
    c = _read(spark, d, "conversations")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    q = c.where("role = 'user'").withColumn("k", first).where("k = 1").select("conv_id", F.col("text").alias("question"))
    e = c.where("role = 'assistant'").join(q, "conv_id").select(F.col("conv_id").alias("qid"), "question", F.col("turn").alias("position"), F.col("text").alias("passage"))
    return e.withColumn("relevance", T.overlap(T.tokens(F.col("question")), T.tokens(F.col("passage"))))


@query("pl_crag", f"""with {_FOUND}, held as (select qid, count(distinct w) as n from (select qid, unnest(list_intersect(q, t)) as w from e_) group by qid),
r as (select *, row_number() over (partition by qid order by position, relevance) as k from e_),
g as (select qid, any_value(len(q)) as asked, avg(relevance) as mean_relevance, max(relevance) as best, avg(relevance) filter (where k <= 3) as lead_ from r group by qid),
c as (select *, coalesce(n, 0) / greatest(asked, 1)::double as coverage from g left join held using (qid)),
v as (select qid, round(coverage, 6) as coverage, round(mean_relevance, 6) as mean_relevance, case when asked > 0 then round(0.6 * coverage + 0.4 * least(1.0, mean_relevance), 3) else 0 end::double as context,
  case when asked > 0 then least(1.0, round(0.5 * best + 0.25 * lead_ + 0.25 * coverage, 4)) else 0 end::double as confidence from c)
select *, case when confidence >= 0.6 then 'correct' when confidence >= 0.25 then 'ambiguous' else 'incorrect' end as action from v""")
def pl_crag(spark, d):
    return answers.judged(found(spark, d)).withColumn("coverage", F.round("coverage", 6)).withColumn("mean_relevance", F.round("mean_relevance", 6))


@query("pl_reflect", f"""with e as (select conv_id as qid, string_agg(text, ' ' order by turn, role, text) as passage from conversations where role <> 'user' group by conv_id),
c as (select conv_id as qid, text, substr(text, 1, 60) as quote from conversations where role = 'assistant'),
x as (select qid, contains({norm_sql('passage')}, {norm_sql('quote')}) as found, list_distinct({tokens_sql('text')}) as w, {tokens_sql('quote')} as u from c join e using (qid)),
s as (select *, len(list_intersect(w, u)) / greatest(1, len(w))::double as share from x),
v as (select *, case when not found or len(w) = 0 then 'none' when share >= 0.7 then 'fully' when share >= 0.45 then 'partial' else 'none' end as sup from s)
select qid, round(avg(case when found then least(1.0, share / 0.8) else 0 end), 3) as groundedness, round(count(*) filter (where found and share >= 0.45) / count(*)::double, 3) as ratio,
  count(*) filter (where sup = 'fully')::bigint as fully, count(*) filter (where sup = 'partial')::bigint as partial, count(*) filter (where sup <> 'none') > 0 and count(*) filter (where sup <> 'none') < count(*) as pruned from v group by qid""")
def pl_reflect(spark, d):
    """Assistant turns are claims that quote their first 60 characters, as for pl_verify."""
    c = _read(spark, d, "conversations")
    claims = c.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.lit("S1").alias("source_id"), "text", F.substring("text", 1, 60).alias("quote"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), " ")
    evidence = c.where("role <> 'user'").groupBy(F.col("conv_id").alias("qid")).agg(whole.alias("passage")).withColumn("source_id", F.lit("S1"))
    return answers.grounded(claims, evidence)


@query("pl_extract", f"""with {_FOUND}, s as (select qid, q, position, unnest(p) as sentence, unnest(range(len(p))) as nth from (select *, list_filter(list_transform(string_split(regexp_replace(coalesce(passage, ''), '([.!?。！？])\\s*|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') as p from e_)),
o as (select *, len(list_intersect(q, {tokens_sql('sentence')})) / greatest(1, len(q))::double as score from s where length(sentence) >= 12 and not starts_with(sentence, '#')),
f as (select *, row_number() over (partition by qid, sentence order by position, nth) as n from o where score > 0),
r as (select *, row_number() over (partition by qid order by score desc, position, nth) as rank from f where n = 1)
select qid, rank::bigint as rank, position, sha256(sentence) as sentence_sha256 from r where rank <= 3""")
def pl_extract(spark, d):
    return answers.extracted(found(spark, d)).select("qid", F.col("rank").cast("long").alias("rank"), "position", F.sha2("sentence", 256).alias("sentence_sha256"))


@query("agg_prf", f"""with {_PAIRS}, w as (select conv_id, turn, list_filter({tokens_sql('text')}, lambda w: length(w) >= 4) as ws, {tokens_sql('before')} as q from pairs_),
u as (select conv_id, turn, unnest(ws) as w, unnest(range(len(ws))) as i, q from w),
g as (select conv_id, turn, w, count(*) as n, min(i) as i from u where not list_contains(q, w) group by all),
r as (select *, row_number() over (partition by conv_id, turn order by n desc, i) as k from g)
select w.conv_id, w.turn, coalesce(string_agg(r.w, ' ' order by k) filter (where k <= 5), '') as terms from w left join r using (conv_id, turn) group by w.conv_id, w.turn""")
def agg_prf(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.array_join(R.feedback(F.col("text"), F.col("before")), " ").alias("terms"))
