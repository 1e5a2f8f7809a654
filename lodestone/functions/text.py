"""Text functions, all of them column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for retrieval, words that may open a name, boilerplate
# openings, and endings that are brought to the singular.
STOP_WORDS = "a an the is are was were be been to of for in on at as and or with by from how what why when where who which does do can could would should about tell me this that it its we our their your you i all not".split()
CONNECTORS = ["after", "before", "when", "each", "during", "once", "if", "then", "while"]
BOILERPLATE = [
    r"^(all rights reserved|copyright|privacy policy|terms of service|table of contents)\b",
    r"^(click here|read more|learn more|see page|refer to section)\b",
    r"^#{1,6}\s*$",
]
SINGULARS = [
    ("databases", "database"), ("clusters", "cluster"), ("servers", "server"), ("gateways", "gateway"),
    ("indices", "index"), ("indexes", "index"), ("shards", "shard"), ("services", "service"),
    ("caches", "cache"), ("nodes", "node"), ("queries", "query"), ("connections", "connection"),
]
ENTITY_NAME = r"(?U)\b(?:[A-Z][a-zA-Z0-9]+(?:[ -][A-Z][a-zA-Z0-9]+){0,2}|[A-Z]{2,})\b"
ENTITY_MARK = r"\[\[([^\]\n]{2,60})\]\]"
TOKEN = r"[a-z0-9_]+|[㐀-鿿]"


def fold(text: Column) -> Column:
    """Lower case under which sharp s equals ss; null becomes empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


#: Characters that part words, as far as common European texts have them: a table of characters and a
#: plain split take a small part of the time of the pattern, which is left for texts with others.
_PARTING = "".join(chr(c) for c in [*range(128), *range(0x80, 0x250), *range(0x2000, 0x2070), 0x20AC, 0x2122] if not re.fullmatch("[a-z0-9_ ]", chr(c)))


def all_words(text: Column) -> Column:
    """Words of a text in order, stop words and repeats included."""
    low = fold(text)
    plain = F.translate(low, _PARTING, " " * len(_PARTING))
    return F.when(F.octet_length(plain) == F.length(plain), F.array_remove(F.split(plain, " "), "")).otherwise(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))


def tokens(text: Column) -> Column:
    """Words of a text without stop words, in order, repeats included."""
    return F.filter(all_words(text), lambda w: ~w.isin(STOP_WORDS))


def normalize(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def entities(text: Column, most: int = 24) -> Column:
    """Marked and capitalised names, folded, without leading stop words, sorted, at most `most`."""
    marks = F.regexp_extract_all(text, F.lit(ENTITY_MARK), F.lit(1))
    plain = F.regexp_replace(text, r"(?m)^\s*#{1,6}\s+.*$", "")
    names = F.concat(marks, F.regexp_extract_all(plain, F.lit(ENTITY_NAME), F.lit(0)))
    lead = "|".join([*STOP_WORDS, *CONNECTORS])
    clean = F.transform(names, lambda n: F.regexp_replace(fold(normalize(n)), rf"^(?:(?:{lead})(?: |$))+", ""))
    return F.slice(F.sort_array(F.array_distinct(F.filter(clean, lambda n: F.length(n) > 1))), 1, most)


def singular(name: Column) -> Column:
    """An entity name in lower case, blanks collapsed, with the first plural ending that fits brought to the singular."""
    low = F.lower(normalize(name))
    out = low
    for plural, single in reversed(SINGULARS):
        out = F.when(F.endswith(low, F.lit(plural)), F.concat(F.substr(low, F.lit(1), F.length(low) - len(plural)), F.lit(single))).otherwise(out)
    return out


def sentences(text: Column, tight: bool = False) -> Column:
    """Sentences, split after an end mark and white space, or at line ends; tight: no white space is needed."""
    gap = "*" if tight else "+"
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?。！？])\s{gap}|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def is_boilerplate(sentence: Column) -> Column:
    low = F.lower(sentence)
    found = F.lit(False)
    for p in BOILERPLATE:
        found = found | F.rlike(low, F.lit(p))
    return found


def short_hash(*parts: Column, length: int = 24) -> Column:
    return F.substr(F.sha2(F.concat(*parts), 256), F.lit(1), F.lit(length))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of a that b has; of none it is 0."""
    words = F.array_distinct(a)
    return F.size(F.array_intersect(words, b)) / F.greatest(F.size(words), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
