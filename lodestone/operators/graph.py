"""The graph of entities that share a passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entities, tokens
from .written import written

SEEDS, HOPS, VISITED, NODES, EDGES, IDS = 12, 2, 200, 45, 90, 5


def members(passages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """entity, id: each entity of a passage once. names(entity, canonical): entities count under their
    canonical names."""
    of = passages.select("id", F.explode(entities(F.col("text"))).alias("entity"))
    if names is None:
        return of.select("entity", "id")
    return of.join(names.select("entity", "canonical"), "entity").select(F.col("canonical").alias("entity"), "id").distinct()


def nodes(of: DataFrame, most: int = NODES) -> DataFrame:
    """The entities of most passages: entity, n (ties by name)."""
    return of.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(most)


def _paired(rows: DataFrame) -> DataFrame:
    """rows(id, all) -> id, a < b for the pairs of a sorted array."""
    pairs = rows.select("id", F.posexplode("all").alias("at", "a"), "all")
    return pairs.select("id", "a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))


def edges(of: DataFrame) -> DataFrame:
    """a < b, weight: pairs of entities and the passages that they share. A passage has at most 24
    entities, so pairs are built within its row, not by a join."""
    groups = of.groupBy("id").agg(F.sort_array(F.collect_set("entity")).alias("all"))
    return _paired(groups).groupBy("a", "b").agg(F.count("*").alias("weight"))


def edges_within(passages: DataFrame) -> DataFrame:
    """The edges of passages(id, text) by the names as they stand: the row of a passage has all its pairs,
    so they are counted in one shuffle."""
    return edges_named(named(passages))


def named(passages: DataFrame) -> DataFrame:
    """id, all: the entities of each passage, in order."""
    return passages.select("id", entities(F.col("text")).alias("all"))


def edges_named(rows: DataFrame) -> DataFrame:
    """The edges of the output of named."""
    return _paired(rows).groupBy("a", "b").agg(F.count("*").alias("weight"))


def view(of: DataFrame, most_nodes: int = NODES, most_edges: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """What a drawing shows: nodes(entity, n) and edges(a, b, weight, ids) among them, the weightiest, with
    the first ids of passages that both ends share."""
    top = nodes(of, most_nodes)
    groups = of.join(F.broadcast(top.select("entity")), "entity").groupBy("id").agg(F.sort_array(F.collect_set("entity")).alias("all"))
    # at most most_nodes rows were sent, and a passage has few of them
    pairs = _paired(groups).withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy("id")))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= IDS, F.col("id"))))
    e = pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), first.alias("ids"))
    return top, e.orderBy(F.desc("weight"), "a", "b").limit(most_edges)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder of the session."""
    return written(df, "graph")


def seeds(names: DataFrame, questions: DataFrame, most: int = SEEDS) -> DataFrame:
    """names(entity, canonical), questions(qid, text) -> qid, entity: the canonical names of which one form
    has all its words in the question, the first `most` in order. Words meet by an equi-join."""
    forms = names.select("canonical", F.explode(F.array(F.lower("entity"), "canonical")).alias("form")).distinct()
    forms = forms.withColumn("words", F.array_distinct(tokens(F.col("form")))).where(F.size("words") > 0)
    word = forms.select("canonical", "form", F.size("words").alias("m"), F.explode("words").alias("word"))
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    hit = word.join(asked, "word").groupBy("qid", "canonical", "form", "m").agg(F.count("*").alias("n")).where("n = m")
    hit = hit.select("qid", F.col("canonical").alias("entity")).distinct()
    return hit.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("entity"))).where(F.col("k") <= most).select("qid", "entity")


def both_ways(pairs: DataFrame) -> DataFrame:
    """src, dst, weight in both directions of a, b, weight."""
    e = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def reached(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, most: int | None = None) -> DataFrame:
    """edges(src, dst), seeds(qid, entity) -> qid, entity, length, path: what lies within `hops` steps
    of a question's seeds, by the shortest path (of several the first in order); a seed has length 1,
    and an entity weighs 1 / length. Each step is a join on the frontier; with `most`, a question's walk
    ends at that many entities, the shortest and then first paths first."""
    e = edges.select("src", "dst").distinct()
    front = seeds.select("qid", "entity", F.lit(1).alias("length"), F.array("entity").alias("path")).distinct()
    seen = front
    for step in range(2, hops + 2):
        near = front.join(e, front["entity"] == e["src"]).select("qid", F.col("dst").alias("entity"), F.concat("path", F.array("dst")).alias("path"))
        near = near.join(seen.select("qid", "entity"), ["qid", "entity"], "left_anti").groupBy("qid", "entity").agg(F.min("path").alias("path"))
        if most is not None:
            had = seen.groupBy("qid").agg(F.count("*").alias("had"))
            place = F.row_number().over(Window.partitionBy("qid").orderBy("path"))
            near = near.join(had, "qid").withColumn("k", place).where(F.col("k") + F.col("had") <= most)
        front = cut(near.select("qid", "entity", F.lit(step).alias("length"), "path"))
        seen = seen.unionByName(front)
    return seen


def path_scores(of: DataFrame, walk: DataFrame) -> DataFrame:
    """members(entity, id), output of reached -> qid, id, score, path: a passage has 1 / length of the
    nearest of its entities, and the path to it."""
    x = of.join(walk, "entity").groupBy("qid", "id").agg(F.min(F.struct("length", "path")).alias("b"))
    return x.select("qid", "id", (1 / F.col("b.length")).alias("score"), F.col("b.path").alias("path"))


def walk_ranks(edges: DataFrame, start: DataFrame, damping: float = 0.85, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """edges(src, dst, weight), start(qid, entity, weight) -> qid, entity, rank: for each question a random
    walk that returns to its start with probability 1 - damping, always from where no edge leads on.
    Nothing where no start lies in the graph with a positive weight. All questions walk at once, over the
    entities that they have reached; a round is one join, written, and one sum for each question, and the
    walk ends when no question's ranks change by `tolerance`, or after `rounds`."""
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).where("w > 0")
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    share = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    known = share.select(F.col("src").alias("entity")).union(share.select("dst")).distinct()
    leads = share.select(F.col("src").alias("entity"), F.lit(True).alias("leads")).distinct()
    begin = start.groupBy("qid", "entity").agg(F.sum("weight").cast("double").alias("p"))
    total = begin.groupBy("qid").agg(F.sum("p").alias("all")).where("all > 0")
    begin = cut(begin.join(known, "entity", "left_semi").join(total, "qid").select("qid", "entity", (F.col("p") / F.col("all")).alias("p")).where("p > 0"))
    r = begin.withColumnRenamed("p", "rank")
    for _ in range(rounds):
        at = r.join(leads, "entity", "left")
        moved = at.join(share, at["entity"] == share["src"]).groupBy("qid", F.col("dst").alias("entity")).agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        stuck = at.groupBy("qid").agg(F.sum(F.when(F.col("leads").isNull(), F.col("rank")).otherwise(0.0)).alias("stuck"))
        home = begin.join(stuck, "qid", "left").select("qid", "entity", ((1 - damping + damping * F.coalesce("stuck", F.lit(0.0))) * F.col("p")).alias("home"))
        new = moved.join(home, ["qid", "entity"], "full").join(r, ["qid", "entity"], "left")
        new = new.select("qid", "entity", (damping * F.coalesce("moved", F.lit(0.0)) + F.coalesce("home", F.lit(0.0))).alias("new"), F.coalesce("rank", F.lit(0.0)).alias("old"))
        x = cut(new)
        gone = r.join(x, ["qid", "entity"], "left_anti").groupBy("qid").agg(F.sum("rank").alias("change"))  # ranks that fell to nothing
        change = x.groupBy("qid").agg(F.sum(F.abs(F.col("new") - F.col("old"))).alias("change")).unionByName(gone).groupBy("qid").agg(F.sum("change").alias("change"))
        most = change.agg(F.max("change")).first()[0]
        r = x.select("qid", "entity", F.col("new").alias("rank"))
        if most is None or most < tolerance:
            break
    return r


def passage_ranks(of: DataFrame, ranks: DataFrame) -> DataFrame:
    """members(entity, id), ranks(qid, entity, rank) -> qid, id, score, entity: the summed ranks of a passage's
    entities, 1 for the best passage of a question, and its entity of the highest rank (of several the first)."""
    s = of.join(ranks, "entity").groupBy("qid", "id").agg(F.sum("rank").alias("s"), F.min(F.struct((-F.col("rank")).alias("r"), "entity")).alias("best"))
    top = s.groupBy("qid").agg(F.max("s").alias("top"))
    return s.join(top, "qid").where("s > 0").select("qid", "id", F.round(F.col("s") / F.col("top"), 4).alias("score"), "best.entity")


def associated(edges: DataFrame, of: DataFrame, start: DataFrame, damping: float = 0.85) -> DataFrame:
    """edges(src, dst, weight), members, seeds(qid, entity) -> qid, id, score, path: passages by the ranks of
    a walk from a question's seeds, with the shortest path to their best entity; one out of reach has the
    first seed and the entity."""
    ranks = walk_ranks(edges, start.withColumn("weight", F.lit(1.0)), damping)
    s = passage_ranks(of, ranks)
    paths = reached(edges, start, hops=3).select("qid", "entity", F.col("path").alias("way"))
    first = start.groupBy("qid").agg(F.min("entity").alias("first"))
    x = s.join(paths, ["qid", "entity"], "left").join(first, "qid")
    return x.select("qid", "id", "score", F.coalesce("way", F.array("first", "entity")).alias("path"))
