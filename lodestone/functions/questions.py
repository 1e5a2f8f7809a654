"""What a question asks for, decided by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of each kind of question.
GLOBAL = [
    r"\b(summarize (all|the entire|the overall)|overview of (all|the)|main themes|all components)\b",
    r"\b(key systems|big picture|across all documents|high-level topics|ecosystem|architecture summary)\b",
    r"\b(what are all the|how do all|global summary)\b",
]
THEMATIC = [
    r"\b(overview|summary|summarize|architecture|architectural|design|principles?|concept|concepts)\b",
    r"\b(high[- ]level|overall|holistic|system|workflow|lifecycle|structure|components?)\b",
    r"\b(compare|comparison|contrast|difference between|versus|\bvs\b)\b",
    r"\b(how does .* work|how do .* work|what is the relationship)\b",
    r"\b(main topics?|key themes?|comprehensive|all modules?|across)\b",
]
MULTIHOP = [
    r"\b(?:and|while|also)\s+(?:how|what|why|where|who)\s+(?:does|is|are|do|can)\s+(?:it|this|that|these|the same|its)\b",
    r"\b(?:which|what)\s+(?:\w+\s+){1,4}(?:uses?|created|built|designed|developed|powers?)\s+.*?\s+and\s+(?:how|what|why|who)\b",
    r"\b(?:who|what)\s+(?:is|was)\s+(?:the\s+)?(?:\w+\s+)?(?:behind|founder|creator|author)\s+of\s+the\s+(?:\w+\s+)?(?:that|which)\b",
    r"\b(?:its|their)\s+(?:replication|consistency|consensus|architecture|failover|algorithm|strategy|protocol|founder|author|creator)\b",
    r"\b(?:how does it|how is it|what does it|why does it)\b",
]
COMPOUND = [
    r"\b(compare|contrast|difference between|versus|\bvs\b)\b",
    r"\b(and also|as well as|additionally|furthermore)\b",
    r"\b(what|how|why|when|where|who)\b.*\b(and|while|also)\b.*\b(what|how|why|when|where|who)\b",
]
RELATIONAL = [
    r"\b(connected to|relationship between|relates to|associated with|co-occurs? with)\b",
    r"\b(who worked with|network of|entities related to|linked with)\b",
]
IDENTIFIER = [r"[\"'].+?[\"']", r"\b[A-Z0-9_]{4,}\b", r"\b\d+(\.\d+)?\b", r"(/|\w+\.\w{2,4})"]
CONCEPTUAL = [
    r"\b(concept|essence|philosophy|overview|broadly|in general|metaphor|intuition)\b",
    r"\b(what does it mean|explain the idea of|high-level)\b",
]
GREETING = r"^(hi|hello|hey|good morning|good afternoon|good evening|thanks|thank you|bye|goodbye)\b"
#: mode, confidence of each route, by rule.
ROUTES = {"empty": ("hybrid", 1.0), "global": ("graph", 0.92), "relational": ("graph", 0.88), "exact": ("keyword", 0.85), "conceptual": ("vector", 0.82), "other": ("hybrid", 0.95)}


def any_of(text: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.rlike(text, F.lit(p))
    return found


def _low(q: Column) -> Column:
    return F.lower(F.trim(q))


def is_global(q: Column) -> Column:
    return any_of(_low(q), GLOBAL)


def is_thematic(q: Column) -> Column:
    return any_of(_low(q), THEMATIC)


def needs_hops(q: Column) -> Column:
    return (F.length(_low(q)) >= 18) & any_of(_low(q), MULTIHOP)


def is_compound(q: Column) -> Column:
    low = _low(q)
    return F.contains(F.substr(low, F.lit(1), F.length(low) - 1), F.lit("?")) | any_of(low, COMPOUND)


def needs_retrieval(q: Column) -> Column:
    low = _low(q)
    return ~(F.rlike(low, F.lit(GREETING)) & (F.size(F.split(low, r"\s+")) <= 3))


def route(q: Column) -> Column:
    """Name of the routing rule that decides."""
    clean, low = F.trim(q), _low(q)
    exact = any_of(clean, IDENTIFIER)
    return (
        F.when(clean == "", "empty").when(any_of(low, GLOBAL), "global").when(any_of(low, RELATIONAL), "relational")
        .when(exact & (F.size(F.split(clean, r"\s+")) <= 8), "exact").when(any_of(low, CONCEPTUAL) & ~exact, "conceptual").otherwise("other")
    )


def routed(q: Column) -> tuple[Column, Column]:
    """Mode and confidence of the rule that decides."""
    rule = route(q)
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for name, way in ROUTES.items() for x in (name, way[i])]), rule)
    return pick(0), pick(1)
