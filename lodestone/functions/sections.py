"""Headings above a place in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"^(#{1,6})\s+(.+)$"


def headings(text: Column) -> Column:
    """at (from 0), line of each heading line; lines end with a line feed. Built once for a text,
    whatever number of places in it is asked for."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("found"))

    def step(state, line):
        here = F.array(F.struct(state["at"].alias("at"), line.alias("line")))
        found = F.when(F.rlike(F.trim(line), F.lit(HEADING)), F.concat(state["found"], here)).otherwise(state["found"])
        return F.struct((state["at"] + F.length(line) + 1).alias("at"), found.alias("found"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step)["found"]


def crumbs(found: Column, offset: Column) -> Column:
    """Titles that a place stands under, outermost first; a heading that the place cuts counts as far as it goes."""
    cut = F.transform(F.filter(found, lambda h: h["at"] < offset), lambda h: F.trim(F.substr(h["line"], F.lit(1), offset - h["at"])))
    cut = F.filter(cut, lambda h: F.rlike(h, F.lit(HEADING)))
    level = lambda h: F.length(F.regexp_extract(h, HEADING, 1))
    stack = F.aggregate(cut, F.array().cast("array<string>"), lambda s, h: F.concat(F.filter(s, lambda x: level(x) < level(h)), F.array(h)))
    return F.transform(stack, lambda h: F.trim(F.regexp_extract(h, HEADING, 2)))


def header(filename: Column, titles: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.concat(F.array(filename), titles), " > "), F.lit("]"))
