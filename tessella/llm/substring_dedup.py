"""Substring dedup with automata of recurring passages.

A window is so many (50) consecutive words. A word goes if a window covers it
whose words also start in a document with a smaller id.

1. Candidates. Every window has an anchor, the smallest hash of its 16-word
   phrases, so equal windows have equal anchors. Consecutive windows with one
   anchor form a run (18 windows on average), named by its anchor, its first and
   last window and its length. Only runs are shuffled, not windows. Anchors found
   in a single document are dropped.
2. Confirmed passages. Runs of one name form a class; its first document has the
   passage, the others repeat it. Where an anchor has several classes, the runs of
   the first documents are opened into windows, and windows found in several of
   them are passages too. What a document repeats of another in one piece is put
   together, and cut at every 64th window of the other, so that a document has at
   most 64 different passages for each of its words. The passages' words are then
   taken from the first documents' texts: hashes name passages, they remove nothing.
3. Sharded automata. Documents that may repeat something are dealt to shards of
   about BLOCK_WORDS words, and each shard gets the passages that its documents
   may repeat. It compiles them into one Aho-Corasick automaton over word numbers
   and streams its documents through it. What the automaton finds, in a document
   with a larger id than the passage's, is removed, and nothing else is. A document
   without a recurring anchor can't hold any passage, so it passes without a shuffle.

Which documents may hold or repeat a passage is told by a bitmap of a checked
size. Frequent anchors, windows and passages are pre-aggregated before each
shuffle and joined by their counts (common.join_counted), so no task gets all rows
of one. Rows that are alike in id and text are streamed once.

Defined results: null and empty texts have no words. A null id counts as larger
than all others. Rows with one id are one document: their windows don't remove
each other, rows with equal text get equal results and others their own.
Documents shorter than a window are untouched; very long ones are streamed whole.
Of columns only doc_id, text and n_chars count, by their exact names. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import WordHashes, covered, gram_hashes, mix, signed, sliding_min, split_words

WINDOW, PHRASE = 50, 16
#: Words of the documents of one shard.
BLOCK_WORDS = 200_000
#: Windows of a first document after which a passage is cut.
CUT = 64

_RUNS = "anchor bigint, head bigint, tail bigint, size int, doc_id bigint, thash bigint, start int, n_words int"


def _runs(window: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(1)
        for batch in batches:
            out = []
            for doc_id, thash, text in zip(batch["doc_id"], batch["thash"], batch["text"]):
                words = split_words(text)
                if len(words) < window:
                    continue
                h = hashes.of(words)
                anchors = sliding_min(gram_hashes(h, phrase), window - phrase + 1)
                windows = gram_hashes(h, window)
                # A run ends where the anchor changes, and after window windows, so that its first and last window overlap or touch.
                new = np.concatenate(([True], anchors[1:] != anchors[:-1]))
                first = np.flatnonzero(new)
                since = np.arange(len(anchors)) - np.repeat(first, np.diff(np.append(first, len(anchors))))
                first = np.flatnonzero(since % window == 0)
                last = np.append(first[1:], len(anchors)) - 1
                out.append((anchors[first], windows[first], windows[last], last - first + 1, np.full(len(first), doc_id), np.full(len(first), thash), first, np.full(len(first), len(words))))
            if out:
                a, w, v, n, d, t, s, m = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"anchor": signed(a), "head": signed(w), "tail": signed(v), "size": n, "doc_id": d, "thash": t, "start": s, "n_words": m})

    return run


#: Windows, and words of passages, of one batch; a batch a document costs more than the document.
BATCH = 100_000


def _opener(window: int):
    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("a", "b", "doc_id", "thash", "start", "n_words"), (np.concatenate(x) for x in zip(*out)))))

    def open_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(1)
        for batch in batches:
            out, held = [], 0
            for doc_id, thash, text, starts, sizes in zip(*(batch[x] for x in ("doc_id", "thash", "text", "starts", "sizes"))):
                words = split_words(text)
                h = hashes.of(words)
                # The second hash is one of the same words' hashes, mixed anew.
                a, b = (gram_hashes(x, window) for x in (h, mix(~h)))
                at = np.flatnonzero(covered(starts, np.asarray(starts) + np.asarray(sizes), len(a)))
                n = len(at)
                out.append((signed(a[at]), signed(b[at]), np.full(n, doc_id), np.full(n, thash), at, np.full(n, len(words))))
                held += n
                if held >= BATCH:
                    yield frame(out)
                    out, held = [], 0
            if out:
                yield frame(out)

    return open_runs


_FIRST = ("doc_id", "thash", "start")


def repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Which windows of which document may repeat which windows of an earlier one. docs: doc_id, thash, text.

    doc_id, thash, start, size, n_words; first_doc_id, first_thash, first_start.
    """
    runs = common.materialize(docs.mapInPandas(_runs(window, phrase), _RUNS), "runs")
    counts = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    counts = common.materialize(counts.select("anchor", "n"), "anchors")
    recurring = common.materialize(common.join_counted(runs, counts, ["anchor"]), "recurring")
    common.free(runs)
    name = ["anchor", "head", "tail", "size"]
    classes = recurring.groupBy(*name).agg(F.min(F.struct(*_FIRST)).alias("first"), F.count("*").alias("n"))
    classes = common.materialize(classes, "classes")
    # An anchor with one class has nothing to open.
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("several"))
    classes = common.materialize(common.join_counted(classes, common.materialize(kinds, "kinds"), ["anchor"]), "classes")
    held = common.join_counted(recurring, classes, name).withColumn("later", F.col("doc_id") > F.col("first.doc_id"))
    held = common.materialize(held.where("later or several").drop(*name[:3]), "held")
    common.free(recurring)

    to_open = held.where("not later").groupBy("doc_id", "thash").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    to_open = common.materialize(to_open.select("doc_id", "thash", "runs.start", "runs.size").toDF("doc_id", "thash", "starts", "sizes"), "to_open")
    texts = _texts(docs, to_open).join(to_open, ["doc_id", "thash"])
    windows = texts.mapInPandas(_opener(window), "a bigint, b bigint, doc_id bigint, thash bigint, start int, n_words int")
    windows = common.materialize(windows, "windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct(*_FIRST)).alias("first"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    first = common.materialize(first.where("first.doc_id < most").drop("most"), "first")
    opened = common.join_counted(windows, first, ["a", "b"]).where("doc_id > first.doc_id").withColumn("size", F.lit(1))
    out = ["doc_id", "thash", "start", "size", "n_words", *(F.col(f"first.{x}").alias(f"first_{x}") for x in _FIRST)]
    return held.where("later").select(*out).unionByName(opened.select(*out))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, thash and text of each document in keys, and n, how many rows are alike in them."""
    few = common.maybe_among(docs, keys, "doc_id", "thash").where("maybe")
    return few.groupBy("doc_id", "thash").agg(F.first("text").alias("text"), F.count("*").alias("n"))


def passages(found: DataFrame) -> DataFrame:
    """doc_id, thash, n_words and the passage that the document may repeat: first_doc_id, first_thash, at, size (in windows).

    Consecutive repeats of one document become one piece, cut at every CUT-th window of the first document.
    """
    of = ["doc_id", "thash", "n_words", "first_doc_id", "first_thash", "shift"]
    rows = found.withColumn("shift", F.col("start") - F.col("first_start")).select(*of, "first_start", "size").distinct()
    order = Window.partitionBy(*of).orderBy("first_start", "size")
    end = F.col("first_start") + F.col("size")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("first_start") > F.coalesce("before", F.lit(-1))).cast("int")
    piece = F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = rows.withColumn("before", before).withColumn("piece", piece).groupBy(*of, "piece").agg(F.min("first_start").alias("lo"), F.max(end).alias("hi"))
    cell = F.explode(F.sequence(F.floor(F.col("lo") / CUT), F.floor((F.col("hi") - 1) / CUT))).alias("cell")
    cut = pieces.select(*of[:-1], "lo", "hi", cell)
    at, to = F.greatest(F.col("lo"), F.col("cell") * CUT), F.least(F.col("hi"), (F.col("cell") + 1) * CUT)
    return cut.select(*of[:-1], at.cast("int").alias("at"), (to - at).cast("int").alias("size")).distinct()


def phrases(docs: DataFrame, needed: DataFrame, window: int = WINDOW) -> DataFrame:
    """first_doc_id, first_thash, at, size, n and phrase: the words of each passage in needed (which has n), from its first document."""
    lists = needed.groupBy("first_doc_id", "first_thash").agg(F.collect_list(F.struct("at", "size", "n")).alias("p"))
    lists = lists.select(F.col("first_doc_id").alias("doc_id"), F.col("first_thash").alias("thash"), F.col("p.at").alias("at"), F.col("p.size").alias("size"), F.col("p.n").alias("n"))
    lists = common.materialize(lists, "lists")

    columns = ["first_doc_id", "first_thash", "at", "size", "n", "phrase"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for d, t, text, at, size, n in zip(*(batch[x] for x in ("doc_id", "thash", "text", "at", "size", "n"))):
                words = split_words(text)
                for a, k, m in zip(at.tolist(), size.tolist(), n.tolist()):
                    rows.append((d, t, a, k, m, b" ".join(words[a : a + k + window - 1])))
                    held += k + window - 1
                    if held >= BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    texts = _texts(docs, lists).drop("n").join(lists, ["doc_id", "thash"])
    return texts.mapInPandas(extract, "first_doc_id bigint, first_thash bigint, at int, size int, n bigint, phrase binary")


def _result(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    kept = b" ".join(w for w, x in zip(words, gone.tolist()) if not x)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def _clean(text: str | None) -> tuple[int, int, str, str | None]:
    words = split_words(text)
    return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text


def cut(text: str, words: list[bytes], gone: np.ndarray) -> str:
    """The text without these words and the space after each run of them."""
    if gone.all():
        return ""
    raw, at, out, kept_to = text.encode("utf-8", "surrogatepass"), 0, [], 0
    starts = []
    for w in words:
        at = raw.index(w, at)
        starts.append(at)
        at += len(w)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    for a, b in edge.reshape(-1, 2).tolist():
        out.append(raw[kept_to : starts[a]])
        kept_to = starts[b] if b < len(words) else len(raw)
    return b"".join([*out, raw[kept_to:]]).decode("utf-8", "surrogatepass")


def locate(texts: list[list[bytes]], order: list[int], found: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """Which words go from each text of a shard. order: the texts' ids. found: passages, and the id of the document that has each first.

    One automaton of all passages is compiled, and every text is streamed through it.
    """
    numbers: dict[bytes, int] = {}
    least: dict[bytes, int] = {}
    for phrase, first in found:
        least[phrase] = min(least.get(phrase, first), first)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, first in least.items():
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in phrase.split(b" "))
        automaton.add_word(key, (len(key), first))
    gone = [np.zeros(len(x), bool) for x in texts]
    if not least:
        return gone
    automaton.make_automaton()
    for own, words, out in zip(order, texts, gone):
        # A word that no passage has is number 0, which no pattern has.
        hits = [(end + 1 - n, end + 1) for end, (n, first) in automaton.iter(tuple(numbers.get(w, 0) for w in words)) if first < own]
        if hits:
            out[:] = covered(*zip(*hits), len(words))
    return gone


def remove(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, with_text: bool = True) -> DataFrame:
    """(doc_id, thash, n_words, n_removed, kept_sha256, text) for each row of docs.

    doc_id is common.NO_ID for null. text is as it was where nothing is
    removed, else without the removed words; with_text=False leaves it out.
    """
    plain = common.pick(docs, "doc_id", "text")
    plain = plain.select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
    with common.scope() as kept:
        held = common.materialize(passages(repeats(plain, window, phrase)), "passages")
        kept.append(held)
    sizes = common.materialize(held.groupBy("doc_id", "thash").agg(F.max("n_words").alias("n_words")), "sizes")
    shards = max(1, ceil((sizes.agg(F.sum("n_words")).first()[0] or 0) / BLOCK_WORDS))
    shard = F.pmod(F.xxhash64("doc_id", "thash", F.lit(7)), F.lit(shards)).cast("int").alias("shard")
    passage = ["first_doc_id", "first_thash", "at", "size"]
    wanted = common.materialize(held.select(shard, *passage).distinct(), "wanted")
    needed = common.materialize(wanted.groupBy(*passage).agg(F.count("*").alias("n")), "needed")
    known = common.materialize(phrases(plain, needed, window), "phrases")
    dealt = common.join_counted(wanted, known, passage).select("shard", "first_doc_id", "phrase")
    schema = "doc_id bigint, thash bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def untouched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, t, *_clean(x)) for d, t, x in zip(batch["doc_id"], batch["thash"], batch["text"])]
            yield pd.DataFrame(rows, columns=columns).assign(**({} if with_text else {"text": None}))

    def stream(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        words, out = [split_words(x) for x in texts["text"]], []
        gone = locate(words, texts["doc_id"].tolist(), list(zip(found["phrase"].map(bytes), found["first_doc_id"].tolist())))
        for d, t, text, n, x, drop in zip(texts["doc_id"], texts["thash"], texts["text"], texts["n"], words, gone):
            left = None if not with_text else text if not drop.any() else cut(text, x, drop)
            out += [(d, t, *_result(x, drop), left)] * n
        return pd.DataFrame(out, columns=columns)

    flagged = common.maybe_among(plain, sizes, "doc_id", "thash")
    clean = flagged.where("not maybe").select("doc_id", "thash", "text").mapInPandas(untouched, schema)
    texts = _texts(plain, sizes).select(shard, "doc_id", "thash", "text", "n").groupBy("shard")
    streamed = texts.cogroup(dealt.groupBy("shard")).applyInPandas(stream, schema)
    return clean.unionByName(streamed)


def digest(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of docs."""
    out = remove(docs, window, phrase, with_text=False).drop("text")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != common.NO_ID, F.col("doc_id"))).drop("thash")


def deduplicate(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """docs with their texts as remove() leaves them; the other columns stay, n_chars is counted anew where a text has changed."""
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    doc_id, text = (f"_{common.index_of(docs, x)}" for x in ("doc_id", "text"))
    changed = remove(docs, window, phrase).where("n_removed > 0").groupBy(F.col("doc_id").alias("_dk"), F.col("thash").alias("_tk"))
    changed = changed.agg(F.first("text").alias("_new"), F.count("*").alias("n"))
    keyed = plain.withColumns({"_dk": F.coalesce(doc_id, F.lit(common.NO_ID)), "_tk": F.xxhash64(text)})
    changed = common.materialize(changed, "changed")
    flagged = common.maybe_among(keyed, changed, "_dk", "_tk")
    same = flagged.where("not maybe").drop("maybe", "_dk", "_tk")
    held = common.join_counted(flagged.where("maybe").drop("maybe"), changed, ["_dk", "_tk"], "left", wide=True)
    held = held.withColumn(text, F.coalesce("_new", text))
    if "n_chars" in docs.columns:
        n = f"_{common.index_of(docs, 'n_chars')}"
        held = held.withColumn(n, F.when(F.col("_new").isNotNull(), F.length("_new").cast(plain.schema[n].dataType)).otherwise(F.col(n)))
    return same.unionByName(held.select(*same.columns)).toDF(*docs.columns)
