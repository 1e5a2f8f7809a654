"""License scans by an exact set-similarity join between text blocks and notice templates.

Blocks are windows over all words of the whole text, whatever its line breaks: `width` words that
start at every multiple of width / 2 (a text of no more words is one block), so that every run of
width / 2 words lies whole in a block. A template's width is twice its words, BLOCK at least. A block
matches a template when it holds at least THRESHOLD of the template's distinct words, and no fewer
than MIN_WORDS of them (all, of a smaller template). The join is exact: template words are ordered
by the number of documents that hold them, over all documents, the rarest first; a template's prefix
(size - need + 1 words) must share a word with the prefix of every block that matches; blocks that
are too small and word positions that leave too little are passed over, and what remains is verified.
Only DataFrame functions are used, and no text is shuffled.

Besides, base phrases are found wherever their words stand consecutively in the whole text.

Defined cases: a null or empty text has no words and no labels, score 0; repeated rows give
repeated rows, null doc_ids too; long texts are cut in windows, no word is left out; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parted, table

#: Words are runs of digits, letters and anything beyond ASCII: these characters part them.
MARKS = "".join(chr(c) for c in range(128) if chr(c) != " " and not chr(c).isalnum())
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices, and the standard headers and permission texts of common licenses.
TEMPLATES = {
    "mit": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-3.0-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
BLOCK, THRESHOLD, MIN_WORDS = 64, 0.8, 5


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for a row, however many filters above it use it: they can't be
    pushed below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def holding(text: Column, words) -> Column:
    """A cheap superset of the texts with one of the words."""
    found = F.lit(False)
    for w in sorted(words):
        found = found | F.contains(text, F.lit(w))
    return found


class Template:
    def __init__(self, label: str, text: str, threshold: float, min_words: int):
        own = text.split()
        self.label, self.words = label, list(dict.fromkeys(own))
        self.need = max(math.ceil(threshold * len(self.words) - 1e-9), min(len(self.words), min_words))
        self.width = max(BLOCK, 2 * len(own))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the largest share of a template that a block holds, 1 at a base phrase)."""
    known = [Template(k, v, threshold, min_words) for k, v in templates.items()]
    split = {p: p.split() for p in phrases}
    vocabulary = sorted({w for t in known for w in t.words} | {w for v in split.values() for w in v})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    literals = lambda words: F.array(*map(F.lit, words))
    hits = F.array_intersect(literals(vocabulary), F.col("words"))
    cut = lambda df: once(df, "words", parted(F.col("text"), MARKS))

    counted = materialize(cut(rows).select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "license-words")
    seen = {r["w"]: r["n"] for r in counted.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row per template word at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for t in known:
        ranked = sorted(t.words, key=place.__getitem__)
        index += [(w, t.width, t.label, i, len(ranked), t.need, ranked) for i, w in enumerate(ranked[: len(ranked) - t.need + 1])]
    spark = docs.sparkSession
    prefixes = F.broadcast(spark.createDataFrame(index, "token string, width int, label string, i int, size int, need int, tokens array<string>"))  # as large as the templates
    holds = lambda words, least: F.size(F.array_intersect(literals(words), F.col("hits"))) >= least

    # blocks: of the texts that hold enough words of a template, and so one of its prefix
    some = F.lit(False)
    for t in known:
        some = some | holds(t.words, t.need)
    texts = once(cut(rows.where(holding(F.lower("text"), {x[0] for x in index if seen.get(x[0])}))), "hits", hits).where(some)
    least = {w: min(t.need for t in known if t.width == w) for w in sorted({t.width for t in known})}
    widths = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(n).alias("least")) for w, n in least.items()])).alias("of")
    wide = texts.select("doc_id", "row_key", "words", widths).select("doc_id", "row_key", "words", "of.width", "of.least")
    half = F.floor(F.col("width") / 2).cast("int")
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - F.col("width")) / half)).cast("int")
    blocks = wide.select("doc_id", "row_key", "words", "width", "least", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    held = blocks.select("doc_id", "row_key", "width", "least", F.array_intersect(literals(order), F.slice("words", F.col("k") * half + 1, F.col("width"))).alias("held")).where(F.size("held") >= F.col("least"))
    probes = held.select("doc_id", "row_key", "width", "held", F.posexplode(F.slice("held", F.lit(1), F.size("held") - (F.col("least") - 1))).alias("j", "token"))
    met = probes.join(prefixes, ["token", "width"])
    met = met.where(F.size("held") >= F.col("need")).where(F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) >= F.col("need"))
    overlap = F.size(F.array_intersect("held", "tokens"))
    matches = met.select("doc_id", "row_key", "label", (overlap / F.col("size")).alias("share"), overlap.alias("overlap"), "need").where("overlap >= need")
    matches = matches.groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    # base phrases: every place with the words after it
    some = F.lit(False)
    for own in split.values():
        some = some | holds(own, len(set(own)))
    longest = max(map(len, split.values()))
    places = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))) for k in range(longest)])
    keys = {min(v, key=place.__getitem__) for v in split.values()}
    whole = once(cut(rows.where(holding(F.lower("text"), keys))), "hits", hits).where(some)
    whole = whole.select("doc_id", "row_key", F.posexplode(places).alias("at", "place")).select("doc_id", "row_key", "at", *[F.col("place")[str(k)].alias(f"w{k}") for k in range(longest)])
    label = F.lit(None).cast("string")
    for p, own in split.items():
        cond = F.lit(True)
        for k, w in enumerate(own):
            cond = cond & (F.col(f"w{k}") == w)
        label = F.coalesce(label, F.when(cond, F.lit(phrases[p])))
    spots = whole.select("doc_id", "row_key", "at", label.alias("label")).where("label is not null")
    # equal rows are counted once for each
    n = F.count("*")
    base = spots.groupBy("doc_id", "row_key", "at", "label").agg(n.alias("m")).groupBy("doc_id", "row_key").agg(n.alias("n_base"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("label").alias("names"))

    found = matches.select(F.col("doc_id").alias("a_id"), F.col("row_key").alias("a_key"), "found", "share")
    plain = base.select(F.col("doc_id").alias("b_id"), F.col("row_key").alias("b_key"), "n_base", "first", "last", "names")
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("row_key") == F.col("a_key")), "left")
    out = out.join(plain, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("row_key") == F.col("b_key")), "left")
    none = F.array().cast("array<string>")
    names, found = F.coalesce("names", none), F.coalesce("found", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first").cast("long").alias("first_word"),
        F.col("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, found))), ",").alias("labels"),
        F.when(F.size(names) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its notices and base phrases. Nulls, empty and long texts, ties, repeated rows, empty tables and further columns: as the
    module says."""
    return scan(table(spark, sf_dir, "documents"))


def op1_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> str:
    known = [Template(k, v, threshold, min_words) for k, v in templates.items()]
    values = ", ".join(f"('{t.label}', [{', '.join(repr(w) for w in t.words)}], {len(t.words)}, {t.need}, {t.width})" for t in known)
    word = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
    return rf"""
with t as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
w as (select doc_id, r, body, regexp_extract_all(body, '{word}') as ws from t),
spots as (select r, unnest(range(len(ws))) as i, ws from w where contains(body, 'license')),
base as (select r, i, case when ws[i + 1] = 'mit' and ws[i + 2] = 'license' then 'mit' when ws[i + 1] = 'apache' and ws[i + 2] = 'license' then 'apache'
  when ws[i + 1] = 'general' and ws[i + 2] = 'public' and ws[i + 3] = 'license' then 'gpl' end as label from spots),
b as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels, list(distinct label) as names from base where label is not null group by r),
templates(label, own, size, need, width) as (values {values}),
wide as (select r, ws, width, unnest(range(cast(greatest(0, ceil((len(ws) - width) / (width // 2)::double)) as bigint) + 1)) as k from w, (select distinct width from templates)),
blocks as (select r, width, list_slice(ws, k * (width // 2) + 1, k * (width // 2) + width) as own_words from wide),
m as (select r, label, max(len(list_intersect(own, own_words)) / size::double) as share from blocks join templates using (width) where len(list_intersect(own, own_words)) >= need group by r, label),
f as (select r, list(label) as found, max(share) as share from m group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(found, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from w left join b using (r) left join f using (r)
"""


OP1_SQL = op1_sql()
