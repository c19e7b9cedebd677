"""License scan: exact set-similarity join of text blocks and templates, with
DataFrame functions only.

A text block is a window of consecutive words of the whole text, wherever its
lines break: for a template of n words, n and ``SLACK`` or n / 2 more, whichever
is larger. Its words form a set, as a template's do; a block matches a template
when it holds at least ``threshold`` of the template's set, or all but one word
of a set of more than ``WHOLE``, and every word of ``TELLING`` that the template
has; a block with one of a label's ``BARRED`` words is none of that label. Template
words are ordered by how many rows of the whole corpus hold them. Of a template
of n words of which k must be present, a matching block holds one of the n-k+1
rarest, or its rarest telling word (prefix filter), stands around a place of that
word (positional filter) and has k words of the template there (length filter);
the rest is counted exactly. The templates are a parameter of bounded size
(checked), so their index is broadcast. One pass over the texts leaves each row's
template words and, where the whole text has enough words of some template, their
places; texts never move.

Templates of fewer than ``LEAST_WRAPPED`` words match within a line only: a word
or two from neighbouring lines are no notice.

Defined cases: null and wordless texts have no words and no labels; repeated rows
each get their result; empty tables give empty results; other columns of the
input are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: What stands between words: all of ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose consecutive words are a place by themselves (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Usual notices, short and whole, by label (fixed values: words of public licence
#: texts). The labels are those of the phrases or our own.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("all-rights-reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)
MAX_TEMPLATE_WORDS = 20_000
THRESHOLD = 0.9
#: No word may be missing from sets of so many words or fewer.
WHOLE = 3
#: Words by which alone licences differ: none of them may be missing.
TELLING = ("affero", "apache", "attribution", "commons", "creative", "gnu", "lesser", "mit", "mozilla", "nc", "sa")
#: Words that make a notice one of another label.
BARRED = {"gpl": ("affero", "lesser")}
#: Other words that a block has room for, at least.
SLACK = 3
LEAST_WRAPPED = 3
#: Stands for the end of a line among the words; doubled where a text has it.
LINE = "\ue000"


def _span(text: str) -> int:
    """Words of a block for the template ``text``."""
    n = len(text.split())
    return n + max(SLACK, n // 2)


def _need(n: int, threshold: float) -> int:
    return max(1, min(math.ceil(threshold * n - 1e-9), max(n - 1, WHOLE)))


def _reduced(docs: DataFrame, vocabulary: list[str], templates: tuple, threshold: float, phrases: tuple, lined: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, version, at, label, n_words, names, held, starts) by one pass over the
    texts. At -1: the row itself, with its number of words, which of ``vocabulary``
    it has and, where they are enough for a template, their places and, if
    ``lined``, where lines start. Else: a place where a phrase starts."""
    text = ascii_lower(F.coalesce(text_col, F.lit("")))
    marked = F.replace(F.replace(text, F.lit(LINE), F.lit(LINE + LINE)), F.lit("\n"), F.lit(f" {LINE} ")) if lined else text
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.array_remove(F.split(marked, BETWEEN), "").alias("w"))
    starts = F.array().cast("array<int>")
    if lined:
        # The k-th end of a line, counted from 0, has k others before it.
        starts = F.transform(F.array_compact(F.transform("w", lambda x, i: F.when(x == LINE, i))), lambda x, k: x - k)
    rows = rows.withColumn("starts", starts).withColumn("w", F.array_remove("w", LINE) if lined else F.col("w"))
    rows = rows.withColumn("held", F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(vocabulary), F.struct(i.alias("at"), x.alias("word"))))))
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn("names", F.array_distinct(F.col("held")["word"]))
    sets = {frozenset(t.split()) for _, t in templates}
    enough = [F.size(F.array_intersect("names", F.array(*map(F.lit, sorted(x))))) >= _need(len(x), threshold) for x in sorted(sets, key=sorted)]
    rows = rows.withColumn("enough", reduce(lambda a, b: a | b, enough, F.lit(False)))
    may = reduce(lambda a, b: a | b, [F.array_contains("names", p.split()[-1]) & F.array_contains("names", p.split()[0]) for p, _ in phrases])
    rows = rows.withColumn("w", F.when(may, F.col("w")).otherwise(F.array().cast("array<string>")))
    # The outer generator keeps the optimizer from inferring a filter that would split the texts anew.
    own = F.array(F.lit(-1))
    at = F.explode_outer(F.when(F.size("w") > 0, F.concat(own, F.sequence(F.lit(0), F.size("w") - 1))).otherwise(own))
    where = [F.when(F.col("enough"), F.col(c)).alias(c) for c in ("held", "starts")]
    rows = rows.select("id", "version", "n_words", "names", *where, "w", at.alias("at"))
    label = F.when(F.col("at") < 0, F.lit(None).cast("string"))
    for phrase, name in phrases:
        label = label.when(reduce(lambda a, b: a & b, [F.get("w", F.col("at") + k) == x for k, x in enumerate(phrase.split())]), F.lit(name))
    own_only = lambda c: F.when(F.col("at") == -1, F.col(c)).alias(c)
    return rows.select("id", "version", "at", label.alias("label"), own_only("n_words"), own_only("names"), own_only("held"), own_only("starts")).where((F.col("at") == -1) | F.col("label").isNotNull())


def _index(spark: SparkSession, templates: tuple, order: dict[str, int], threshold: float) -> DataFrame:
    """(anchor, t_label, tokens, need, span, telling, barred, wrapped): each template
    by the words of its prefix."""
    rows = []
    for label, text in templates:
        tokens = sorted(set(text.split()), key=lambda x: (order.get(x, 0), x))
        need = _need(len(tokens), threshold)
        telling = [x for x in tokens if x in TELLING]
        rows += [(w, label, tokens, need, _span(text), telling, list(BARRED.get(label, ())), len(tokens) >= LEAST_WRAPPED) for w in telling[:1] or tokens[: len(tokens) - need + 1]]
    return spark.createDataFrame(rows, "anchor string, t_label string, tokens array<string>, need int, span int, telling array<string>, barred array<string>, wrapped boolean")


def _shares(rows: DataFrame, index: DataFrame, reach: dict[str, int]) -> DataFrame:
    """(id, version, t_label, share) of the templates that rows (id, version, held,
    starts) match; ``reach``: the anchors, and how far from each a word of its blocks
    may be."""
    anchors = sorted(reach)
    names = F.col("held")["word"]
    near = rows.where(F.arrays_overlap(names, F.array(*[F.lit(x) for x in anchors])))
    found = F.array_compact(F.transform(names, lambda x, k: F.when(x.isin(anchors), k)))
    reaches = F.create_map(*[F.lit(x) for a in anchors for x in (a, reach[a])])

    def piece(k):
        far = F.element_at(reaches, F.get("held", k)["word"])
        return F.slice("held", F.greatest(k - far, F.lit(0)) + 1, 2 * far + 1)

    around = F.transform(found, lambda k: F.struct(F.get("held", k).alias("own"), piece(k).alias("piece")))
    near = near.select("id", "version", "starts", F.explode(around).alias("x")).select("id", "version", "starts", F.col("x.own.at").alias("p"), F.col("x.own.word").alias("anchor"), "x.piece")
    pairs = near.join(F.broadcast(index), "anchor")
    broken = lambda e: F.exists("starts", lambda b: (b > F.least(e["at"], F.col("p"))) & (b <= F.greatest(e["at"], F.col("p"))))
    words = F.concat("tokens", "barred")
    pairs = pairs.withColumn("piece", F.filter("piece", lambda e: (F.abs(e["at"] - F.col("p")) < F.col("span")) & F.array_contains(words, e["word"]) & (F.col("wrapped") | ~broken(e))))
    pairs = pairs.where(F.size(F.array_intersect("tokens", F.col("piece")["word"])) >= F.col("need"))
    pairs = pairs.withColumn("s", F.explode(F.filter(F.col("piece")["at"], lambda at: at <= F.col("p"))))
    block = F.filter("piece", lambda e: (e["at"] >= F.col("s")) & (e["at"] < F.col("s") + F.col("span")))
    pairs = pairs.withColumn("block", F.array_distinct(F.transform(block, lambda e: e["word"])))
    pairs = pairs.where((F.size(F.array_except("telling", "block")) == 0) & ~F.arrays_overlap("block", "barred"))
    overlap = F.size(F.array_intersect("tokens", "block"))
    return pairs.where(overlap >= F.col("need")).groupBy("id", "version", "t_label").agg(F.max(overlap / F.size("tokens")).alias("share"))


def find_licenses(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, version, copies, n_words, places, base_labels, matches) of each distinct
    row; version: hash of its text; copies: rows like it. ``places``: starts of
    phrases; ``matches``: the largest share of each template label found."""
    if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"more than {MAX_TEMPLATE_WORDS} words of templates")
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {w for p, _ in phrases for w in p.split()} | {w for x in BARRED.values() for w in x})
    lined = any(len(set(t.split())) < LEAST_WRAPPED for _, t in templates)
    table = materialize(spark, _reduced(docs, vocabulary, templates, threshold, phrases, lined, id_col, text_col), "licenses")
    rows = table.where((F.col("at") == -1) & F.col("held").isNotNull()).select("id", "version", "held", "starts")
    counts = table.where("at = -1").select(F.explode("names").alias("word")).groupBy("word").count()
    order = {r["word"]: r["count"] for r in counts.collect()}  # as many rows as the vocabulary has words
    index = _index(spark, templates, order, threshold)
    reach = {r["anchor"]: r["reach"] for r in index.groupBy("anchor").agg(F.max("span").alias("reach")).collect()}  # of the templates
    pairs = _shares(rows, index, reach)
    matches = pairs.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct(F.col("t_label").alias("label"), "share"))).alias("matches"))
    found = table.groupBy("id", "version").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("at") == -1, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "label")))).alias("places"),
    )
    both = found.alias("f").join(matches.alias("m"), F.col("f.id").eqNullSafe(F.col("m.id")) & (F.col("f.version") == F.col("m.version")), "left")
    base = F.array_sort(F.array_distinct(F.transform("f.places", lambda x: x["label"])))
    return both.select("f.*", base.alias("base_labels"), F.coalesce("m.matches", F.array().cast("array<struct<label:string,share:double>>")).alias("matches"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each row scanned, repeated ones included."""
    labels = F.array_sort(F.array_union("base_labels", F.transform("matches", lambda x: x["label"])))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)))
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places")["at"].cast("long").alias("first_word"),
        F.array_max("places")["at"].cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
