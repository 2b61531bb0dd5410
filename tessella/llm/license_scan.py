"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A template is a set of tokens (its distinct words). A block is a run of words of a
text, across lines and paragraphs, as long as the template and half as long again
(SLACK), so notices that are wrapped or have words put in are found. A block has a
template if it holds at least threshold of its tokens. The join is one of relations;
templates are a table of checked length, and neither the plan nor the work for a text
without their rare words grows with their number:

1. Order. All tokens are ordered by their frequency in the whole corpus, rarest first.
2. Prefix filter. Of a template with n tokens of which k are needed, any block that has
   it holds one of its first n - k + 1. The words of all texts are joined with these
   prefix tokens; what meets are candidates (text, template, place).
3. Candidates are put into cells as wide as a block's reach, rounded up to a power of two,
   and the tokens of templates within reach of a cell are brought together by a join on
   cells, so a long text is no single group, and a template of any length costs a text no
   more than its tokens, a few times over.
4. Length filter: cells with fewer than k distinct tokens around them go.
   Positional filter: with i tokens of the block before the first common one, in the
   order of 1, and j of the template, at most min(block - i, template - j) can be common;
   cells where that is less than k go.
5. Every block around what is left is counted exactly: a token counts for the blocks that
   begin after the one before it of its kind and reach it, so one walk over the ends of
   these ranges has the count of all blocks.

DataFrame functions only. Copies of a text are joined once, and the results given to all
of them.

Words: A-Z is lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Phrases may span
lines. The frequencies are collected for the templates' tokens only, a fixed list.

Defined results: a null or empty text has no words, no labels, null positions and score
0. Very long texts are scanned whole. Repeated rows and ids each get a row, rows alike
equal ones. Of blocks of one text the best counts for each template; where templates
share a label, the best of them. score is the largest share of a template that a block of
the document holds, 0 where no block reaches the threshold, and 1 where a phrase stands.
Of columns only doc_id and text count, by their exact names. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Customary notices by label.
TEMPLATES = {
    "agpl-3": "this work is licensed under the gnu affero general public license version 3",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license version 2 1",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software",
    "mit-notice": "released under the mit license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
NAMES = {"mit-notice": "mit"}
THRESHOLD = 0.9
#: A block is as long as its template, and this part of it more.
SLACK = 0.5
#: Tables of templates are broadcast, so their words are counted: at most so many in all, whatever one template's length.
MOST_WORDS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXT = ["h1", "h2"]


def _spaced(text: Column) -> Column:
    """Words with one space before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NOT_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def text_key() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def _words(docs: DataFrame, *keys: Column | str) -> DataFrame:
    """The keys, and pos (from 1) and word of every word of every text."""
    return docs.where("text is not null").select(*keys, F.posexplode(F.split(_spaced(F.col("text")), " ")).alias("pos", "word"))


def frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of these tokens stands in the whole corpus."""
    own = docs.sparkSession.createDataFrame([(t,) for t in tokens], "word string")
    counts = _words(common.pick(docs, "text")).join(F.broadcast(own), "word").groupBy("word").count()
    return dict.fromkeys(tokens, 0) | {r[0]: r[1] for r in counts.collect()}


def template_tables(spark: SparkSession, templates: dict[str, str], counts: dict[str, int], threshold: float, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, rank) of all tokens; (word, tid) of prefix tokens; (tid, label, ranks, need, reach, width) of templates."""
    if sum(len(words.split()) for words in templates.values()) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    sets = {label: set(words.split()) for label, words in templates.items() if words.split()}
    rank = {w: i for i, w in enumerate(sorted({w for s in sets.values() for w in s}, key=lambda w: (counts[w], w)))}
    prefix, rows = [], []
    for tid, (label, tokens) in enumerate(sets.items()):
        ordered = sorted(tokens, key=rank.__getitem__)
        need, length = ceil(threshold * len(ordered) - 1e-9), len(templates[label].split())
        prefix += [(w, tid) for w in ordered[: len(ordered) - need + 1]]
        reach = length + int(slack * length)
        rows.append((tid, NAMES.get(label, label), [rank[w] for w in ordered], need, reach, 1 << (reach - 1).bit_length()))
    return (
        spark.createDataFrame(list(rank.items()), "word string, rank int"),
        spark.createDataFrame(prefix, "word string, tid int"),
        spark.createDataFrame(rows, "tid int, label string, ranks array<int>, need int, reach int, width int"),
    )


def _fullest() -> Column:
    """The most distinct tokens in any run of reach words, of near: (rank, at), sorted."""
    last = "if(i > 0 and get(near, i - 1).rank = t.rank, get(near, i - 1).at, -1)"
    ends = f"flatten(transform(near, (t, i) -> array(struct(greatest({last} + 1, t.at - reach + 1) as at, 1 as d), struct(t.at + 1 as at, -1 as d))))"
    return F.expr(f"aggregate(array_sort({ends}), struct(0 as now, 0 as most), (s, e) -> struct(s.now + e.d as now, greatest(s.most, s.now + e.d) as most), s -> s.most)")


def similar_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """h1, h2 (of text_key()), label and share: the best share of each template that a block of a text meets the threshold with."""
    spark = docs.sparkSession
    texts = common.pick(docs, "text").select(*text_key(), "text")
    counts = frequencies(texts, sorted({w for words in templates.values() for w in words.split()}))
    vocabulary, prefix, table = template_tables(spark, templates, counts, threshold, slack)
    if table.isEmpty():
        return spark.createDataFrame([], "h1 bigint, h2 bigint, label string, share double")
    # 2. One copy of a text is as good as another, and its places are the same.
    met = _words(texts, *TEXT).join(F.broadcast(prefix), "word").join(F.broadcast(table.select("tid", "reach", "width")), "tid")
    met = common.materialize(met.select(*TEXT, "tid", "reach", "width", F.expr("pos div width").alias("home")).distinct(), "candidates")
    # 3. Blocks that begin in a cell, or reach it, touch its neighbours at most.
    held = common.materialize(met.groupBy(*TEXT).agg(F.collect_set("width").alias("widths")), "texts")
    some = common.maybe_among(texts, held, *TEXT).where("maybe").groupBy(*TEXT).agg(F.first("text").alias("text")).join(held, TEXT)
    tokens = _words(some, *TEXT, "widths").join(F.broadcast(vocabulary), "word").select(*TEXT, F.col("pos").alias("at"), "rank", F.explode("widths").alias("width"))
    tokens = tokens.select(*TEXT, "width", F.expr("at div width").alias("cell"), "at", "rank")
    reached = met.select("*", F.explode(F.sequence(F.col("home") - 1, F.col("home") + 1)).alias("cell"))
    low, high = F.col("home") * F.col("width") - F.col("reach") + 1, (F.col("home") + 1) * F.col("width") + F.col("reach") - 2
    near = reached.join(tokens, [*TEXT, "width", "cell"]).where(F.col("at").between(low, high))
    pairs = table.select("tid", F.explode("ranks").alias("rank"), F.lit(True).alias("own"))
    near = near.join(F.broadcast(pairs), ["tid", "rank"], "left").groupBy(*TEXT, "tid", "home")
    near = near.agg(F.array_sort(F.collect_set("rank")).alias("block"), F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("rank", "at")))).alias("near"))
    # 4.
    near = near.join(F.broadcast(table), "tid").where(F.size("block") >= F.col("need"))
    first = F.get(F.array_intersect("ranks", "block"), F.lit(0))
    left = lambda side: F.size(side) - F.array_position(F.col(side), F.col("first")) + 1
    near = near.withColumn("first", first).where((left("block") >= F.col("need")) & (left("ranks") >= F.col("need")))
    # 5. Sorted by token and place, the entry before says where a token stood last.
    best = near.withColumn("best", _fullest()).where("best >= need")
    return best.groupBy(*TEXT, "label").agg(F.max(F.col("best") / F.size("ranks")).alias("share"))


def _phrases(s: Column, phrases: dict[str, str]) -> list[Column]:
    """n_words, n_base, first_word, last_word and base (labels) of spaced words. Regular expressions run only where a phrase stands."""
    inside = [F.contains(s, F.lit(f" {_escaped(p)} ")) for p in phrases]
    found = reduce(lambda a, b: a | b, inside)
    at = [F.when(has, F.regexp_count(s, F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for has, p in zip(inside, phrases)]
    any_phrase = f"(?<= )(?:{'|'.join(phrases)})(?= )"
    # Before a word stand as many spaces as its number, and one more at the start.
    first = _spaces(F.get(F.split(s, any_phrase, 2), F.lit(0))) - 1
    ends = [F.when(has, _spaces(F.regexp_extract(s, f"(?s)^(.*)(?<= ){p}(?= )", 1)) - 1).otherwise(-1) for has, p in zip(inside, phrases)]
    labels = F.array_compact(F.array(*(F.when(has, F.lit(label)) for has, label in zip(inside, phrases.values()))))
    return [
        F.when(s == "  ", 0).otherwise(_spaces(s) - 1).cast("bigint").alias("n_words"),
        F.when(found, reduce(lambda a, b: a + b, at)).otherwise(0).cast("bigint").alias("n_base"),
        F.when(found, first).cast("bigint").alias("first_word"),
        F.when(found, reduce(F.greatest, ends) if len(ends) > 1 else ends[0]).cast("bigint").alias("last_word"),
        F.when(found, F.array_sort(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")).alias("base"),
    ]


def digest(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    plain = common.pick(docs, "doc_id", "text")
    spaced = plain.select("doc_id", *text_key(), _spaced(F.coalesce("text", F.lit(""))).alias("s"))
    with common.scope() as kept:
        base = common.materialize(spaced.select("doc_id", *TEXT, *_phrases(F.col("s"), phrases)), "phrases")
        held = similar_blocks(plain, templates, threshold).groupBy(*TEXT).agg(F.collect_list(F.struct("label", "share")).alias("held"))
        # A notice may be the whole text of a large part of all rows.
        held = common.materialize(held.join(base.groupBy(*TEXT).agg(F.count("*").alias("n")), TEXT), "held")
        kept += [base, held]
    out = common.join_counted(base, held, TEXT, "left")
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("held.label"), F.array().cast("array<string>"))))
    best = F.greatest(F.coalesce(F.array_max("held.share"), F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score")
    )


def _escaped(phrase: str) -> str:
    if not all(c.isalnum() or c == " " for c in phrase):
        raise ValueError(f"{phrase!r} isn't words with single spaces")
    return phrase
