"""Passages brought down to what bears on a question, and texts to statements that stand alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import sentence_scores
from .text import let, normalize, overlap, sentences, tokens

# Budgets, least lengths, and the patterns that end a clause and open a sentence.
WHOLE, RATIO, STRIP, STRIP_SHARE, SENTENCE, CLAUSE = 140, 0.65, 15, 0.05, 10, 12
CLAUSES = r";\s*|,\s*(?:and|while|whereas|additionally)\s+|\s+as well as\s+"
SUBJECT = r"^((?:(?:The|A|An)\s+)?[A-Z][a-zA-Z0-9_-]*(?:\s+[A-Z][a-zA-Z0-9_-]*)*)\s+.+$"


def compressed(text: Column, question: Column, ratio: float = RATIO) -> Column:
    """The sentences that score best and fit in `ratio` of the text, in their order; the best always,
    those of no score never beside it. A text of up to 140 characters or one sentence stays; null is empty."""
    t = F.coalesce(text, F.lit(""))
    row = F.struct(t.alias("t"), sentences(t).alias("s"), sentence_scores(sentences(t), question).alias("worth"))
    return let(row, lambda r: F.when((F.length(r["t"]) <= WHOLE) | (F.size(r["s"]) <= 1), r["t"]).otherwise(_fitting(r["t"], r["s"], r["worth"], ratio)))


def _fitting(text: Column, parts: Column, worth: Column, ratio: float) -> Column:
    room = F.floor(F.length(text) * F.lit(max(0.2, min(1.0, ratio))))
    scored = F.array_sort(F.transform(worth, lambda w, i: F.struct((-w).alias("worth"), i.alias("at"), F.length(F.get(parts, i)).alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("at"))

    def take(state, s):
        first = F.size(state["at"]) == 0
        fits = first | ((s["worth"] < 0) & (state["used"] + s["n"] <= room))
        more = F.struct((state["used"] + s["n"] + 1).cast("long").alias("used"), F.concat(state["at"], F.array(s["at"])).alias("at"))
        return F.when(fits, more).otherwise(state)

    return let(F.aggregate(scored, start, take)["at"], lambda chosen: F.array_join(F.filter(parts, lambda s, i: F.array_contains(chosen, i)), " "))


def refined(text: Column, question: Column, share: float = STRIP_SHARE) -> Column:
    """The sentences of 15 characters or more that hold `share` of the question's words; the text as it
    is where none does or nothing is asked."""
    strips = F.filter(sentences(text), lambda s: F.length(s) >= STRIP)
    good = let(F.array_distinct(tokens(question)), lambda asked: F.filter(strips, lambda s: (F.size(asked) > 0) & (overlap(asked, tokens(s)) >= share)))
    return let(good, lambda g: F.when(F.size(g) > 0, F.array_join(g, " ")).otherwise(F.coalesce(text, F.lit(""))))


def propositions(text: Column) -> Column:
    """Statements of a text, a clause each; one without a subject takes that of its sentence."""
    whole = F.transform(F.split(normalize(text), r"(?<=[.!?。！？])\s+"), lambda s: F.regexp_replace(F.trim(s), r"\.+$", ""))
    return F.flatten(F.transform(F.filter(whole, lambda s: F.length(s) >= SENTENCE), lambda s: let(F.split(s, CLAUSES), _statements)))


def _statements(clauses: Column) -> Column:
    lead = F.element_at(clauses, 1)
    subject = F.when(F.rlike(lead, F.lit(SUBJECT)), F.regexp_extract(lead, SUBJECT, 1)).otherwise(F.regexp_extract(lead, r"^\s*(\p{Lu}\S*)", 1))
    clean = F.transform(clauses, lambda c, i: F.struct(F.trim(c).alias("c"), i.alias("i")))
    clean = F.filter(clean, lambda x: x["c"] != "")
    named = let(subject, lambda n: F.transform(clean, lambda x: F.when((x["i"] > 0) & (n != "") & ~F.rlike(x["c"], F.lit("^[A-Z]")), F.concat(n, F.lit(" "), x["c"])).otherwise(x["c"])))
    return F.transform(F.filter(named, lambda c: F.length(c) >= CLAUSE), lambda c: F.concat(c, F.lit(".")))


def stated(claim: Column, statements: Column) -> Column:
    """Largest share of a claim's words that one statement holds; 0 without words or statements."""
    best = let(tokens(claim), lambda w: F.array_max(F.transform(statements, lambda p: overlap(w, tokens(p)))))
    return F.round(F.coalesce(best, F.lit(0.0)), 4)
