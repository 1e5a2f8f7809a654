"""Questions put in other words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import entities, let, normalize, tokens

# Openings, citation marks and words that a rewritten question leaves out, and the
# patterns by which questions are taken apart.
POLITE = r"^(please|could you please|can you tell me|i want to know|tell me about|explain to me)\s+"
ASKING = r"^((please|could you please|can you please|could you|can you|tell me about|explain to me|explain|i want to know|what is|how does|how do|why does)\s+)+"
FILLER = ("to", "me", "how", "does", "do", "you", "could", "can", "please", "explain", "about")
TRANSITION = r"^(furthermore|additionally|moreover|in addition|therefore|consequently|specifically|in summary|subsequently|finally|meanwhile|next|thus|hence)[,\s]+"
CITATION = r"\[S\d+\]"
QUOTED = r'"[^"]+"'
CODE = r"\b[a-z0-9]+_[a-z0-9_]+\b|\b[A-Z]+_[A-Z0-9_]+\b|\bv?\d+\.\d+\b"
RELATION = r"(?i)\b(connects?|relationships?|between|associated|linked|depends?|who|parent|child)\b"
EXPLAIN = r"(?i)^(why|how|explain|describe|what is|summarize)\b"
CLAUSE = r"(?i)(?:and|while|also)\s+(?:how|what|why|where|who)\s+(?:does|is|are|do|can)\s+(?:it|this|that|these|the same|its)\s+(.*)"
PRONOUN = r"(?i)\b(?:it|this|that|its|their|the database|the store|the system)\b"
COMPARE = r"(?i)(?:compare|contrast|difference between)\s+(.+?)\s+(?:and|with|to|versus|\bvs\b)\s+(.+)"
VERSUS = r"(?i)(.+?)\s+(?:versus|\bvs\b)\s+(.+)"
JOINED = r"(?i)^(.*\b(?:how|what|why|when|where|who|explain)\b.*?)\s+(?:and also|as well as|and)\s+(\b(?:how|what|why|when|where|who|explain)\b.*)$"


def _terms(text: Column, least: int, but: tuple[str, ...] = ()) -> Column:
    return F.filter(tokens(text), lambda w: (F.length(w) >= least) & (~w.isin(*but) if but else F.lit(True)))


def fallback(q: Column) -> Column:
    """Without one polite opening and the marks at the end, only words of three letters and more."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(q), "(?i)" + POLITE, ""), r"[?!. ]+$", "")
    words = _terms(clean, 3)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(clean)


def corrective(q: Column) -> Column:
    """Without any number of asking openings, filler words and words under three letters."""
    clean = F.trim(F.regexp_replace(normalize(q), "(?i)" + ASKING, ""))
    words = _terms(clean, 3, FILLER)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(clean)


def active(sentence: Column) -> Column:
    """The words to look up for an uncertain sentence: no citation marks, no transition; the sentence
    itself where fewer than two words are left."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(sentence, CITATION, "")), "(?i)" + TRANSITION, ""))
    words = _terms(clean, 2)
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).when(clean != "", clean).otherwise(F.trim(sentence))


def weights(q: Column) -> Column:
    """keyword, vector, graph: how much each channel counts for a question; they sum to 3."""
    related, many = F.rlike(q, F.lit(RELATION)), F.size(F.split(F.trim(q), r"\s+")) >= 8
    k = 1.0 + F.when(F.rlike(q, F.lit(QUOTED)), 0.8).otherwise(0.0) + F.when(F.rlike(q, F.lit(CODE)), 0.6).otherwise(0.0)
    g = 1.0 + F.when(related, 0.8).when(F.size(entities(q)) > 0, 0.5).otherwise(0.0)
    v = 1.0 + F.when(F.rlike(q, F.lit(EXPLAIN)) | many, 0.6).otherwise(0.0)
    return F.struct(*[F.round(x * 3 / (k + v + g), 3).alias(n) for n, x in (("keyword", k), ("vector", v), ("graph", g))])


def followup(q: Column, bridge: Column) -> Column:
    """The second question of a chain, about the bridge found by the first; without one the question itself."""
    tail = F.regexp_replace(F.trim(F.regexp_extract(q, CLAUSE, 1)), r"\?+$", "")
    named = F.trim(F.regexp_replace(q, F.lit(PRONOUN), bridge))
    return (
        F.when(bridge.isNull(), q).when(F.rlike(q, F.lit(CLAUSE)), F.concat(F.lit("How does "), bridge, F.lit(" "), tail, F.lit("?")))
        .when(F.lower(named) != F.lower(F.trim(q)), named).otherwise(F.concat(bridge, F.lit(" "), q))
    )


def parts(q: Column, most: int = 3) -> Column:
    """The questions that a compound question is made of, at most `most`; an empty one has none."""
    clean = F.trim(q)
    bare = lambda x: F.regexp_replace(F.trim(x), r"\?+$", "")
    several = F.transform(F.filter(F.split(clean, r"\?"), lambda p: F.trim(p) != ""), lambda p: F.concat(F.trim(p), F.lit("?")))
    sides = lambda pattern: F.array(*[F.concat(F.lit("Details about "), bare(F.regexp_extract(clean, pattern, i))) for i in (1, 2)])
    joined = F.array(*[F.concat(bare(F.regexp_extract(clean, JOINED, i)), F.lit("?")) for i in (1, 2)])
    found = (
        F.when(clean == "", F.array().cast("array<string>")).when(F.contains(F.substr(clean, F.lit(1), F.length(clean) - 1), F.lit("?")) & (F.size(several) > 1), several)
        .when(F.rlike(clean, F.lit(COMPARE)), sides(COMPARE)).when(F.rlike(clean, F.lit(VERSUS)), sides(VERSUS)).when(F.rlike(clean, F.lit(JOINED)), joined).otherwise(F.array(clean))
    )
    return F.slice(found, 1, most)


def feedback(passage: Column, question: Column, most: int = 5) -> Column:
    """The most frequent words of four letters and more of a passage that the question lacks; of
    equally frequent ones the first to occur."""
    words = let(tokens(question), lambda asked: F.filter(tokens(passage), lambda w: (F.length(w) >= 4) & ~F.array_contains(asked, w)))
    return let(words, lambda w: _frequent(w, most))


def _frequent(words: Column, most: int) -> Column:
    once = F.array_distinct(words)
    rank = F.transform(once, lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), F.array_position(words, w).alias("at"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(rank), 1, most), lambda r: r["w"])
