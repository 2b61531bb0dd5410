"""Phrase collocations from suffix arrays over word ids.

Texts are cut into pieces and words. Every task numbers the words of a shard (SHARD_BYTES
of text), sorts its suffixes by prefix doubling in numpy, and reads the counts of all
phrases of n words off the intervals in which neighbours share n words or more. Counts of
shards are merged by (lang, phrase), after Spark has summed them within each task.

Phrases grow by one word a pass. A phrase that occurs often enough holds only shorter ones
that do, so a pass starts no suffix where its first or its last n - 1 words are known to be
rarer. Which are is told by a bitmap of hashes with at most MOST_BITS (32 MB); a false
positive costs a row, never a result, and beyond 16 million phrases the bitmap only lets
more pass. The vocabulary stays within its shard; nothing that grows with the corpus is
sent to the driver or to all tasks.

Scores are floor(1000000 * a * a / (l * r)) in decimals of 38 digits, exact for counts
below 10 ** 16.

Defined results: a null text is empty and a null language is `und`. Rows count one by one,
repeated ones and repeated ids too. Texts are taken whole; one longer than a shard is cut
between pieces only. A language without words, or without a candidate, has no rows. Ties in
score and count are ordered by the phrase's bytes, so ranks are unique. Of columns only text
and lang count, by their exact names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import gram_hashes, mix

#: Text of one suffix array.
SHARD_BYTES = 8 * 2**20
#: Candidates that one window of the ranking sorts.
RANKED = 1_000_000
#: A byte that no UTF-8 text holds stands between pieces.
_BREAK = b"\xff"
_PIECES = bytes(ord(_BREAK) if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with _BREAK between pieces."""
    return text.translate(_PIECES).replace(_BREAK, b" \xff ").replace(b"\t", b" ").split(b" ")


def portions(text: bytes, size: int) -> Iterator[bytes]:
    """text in parts of about this size, cut between pieces only."""
    plain, at = text.translate(_PIECES), 0
    while len(plain) - at > size:
        to = plain.find(_BREAK, at + size)
        if to < 0:
            break
        yield plain[at:to]
        at = to + 1
    yield plain[at:]


def suffix_order(ids: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The starts (a mask; else all positions) sorted by the depth words that begin there, by prefix doubling.

    The last step joins two prefixes that overlap, so no more than depth words count, and sorts the starts only.
    """
    rank, width = ids.astype(np.int64), 1
    own = np.arange(len(ids)) if starts is None else np.flatnonzero(starts)
    while width < depth:
        step = min(width, depth - width)
        after = np.zeros_like(rank)
        after[: len(rank) - step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        width += step
        if width == depth:
            return own[np.argsort(key[own])]
        order = np.argsort(key)
        ranked = key[order]
        rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
    return own[np.argsort(rank[own])]


def shared_words(ids: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many first words, most at most, each suffix in order shares with the one before it."""
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    padded = np.append(ids, np.zeros(most, ids.dtype))
    for k in range(most):
        word = padded[order + k]
        same = same & (word[1:] == word[:-1])
        lcp[1:] += same
    return lcp


def phrase_counts(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of every phrase of n words that begins at one of the starts (a mask)."""
    order = suffix_order(ids, n, starts)
    if not len(order):
        return order, order
    bounds = np.flatnonzero(shared_words(ids, order, n) < n)
    return order[bounds], np.diff(np.append(bounds, len(order)))


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 11)


def phrase_hash(lang: str, words: list[bytes]) -> int:
    """Hash of a phrase, as the passes make it from its words."""
    h = np.array([xxhash.xxh64_intdigest(w, lang_seed(lang)) for w in words], np.uint64)
    return int(mix(gram_hashes(h, len(words)))[0])


class _Ids(dict):
    """Numbers a language's words as they come; words lists those of the whole shard."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]) -> None:
        super().__init__({_BREAK: 0, b"": -1})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


class _Shard:
    """The words of some texts as ids; words of different languages have different ids, 0 is a break."""

    def __init__(self) -> None:
        self.of: dict[str, _Ids] = {}
        self.words, self.langs, self.hashes = [b""], [""], [0]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        own = self.of.get(lang)
        if own is None:
            own = self.of[lang] = _Ids(lang, self.words, self.langs)
        found = tokens(text)
        ids = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
        self.parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        self.size += len(text) + 1

    def counts(self, n: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Phrases of n words and their counts; bits: which hashes of n - 1 words may be frequent."""
        ids = np.concatenate(self.parts)
        word = ids > 0
        at = len(ids) - n + 1
        starts = np.zeros(len(ids), bool)
        if at > 0:
            starts[:at] = reduce(np.logical_and, (word[k : at + k] for k in range(n)))
            if bits is not None:
                seeds = {lang: lang_seed(lang) for lang in self.of}
                hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in zip(self.words[1:], self.langs[1:]))], np.uint64)
                h = mix(gram_hashes(hashes[ids], n - 1)) & np.uint64(len(bits) * 8 - 1)
                may = (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
                starts[:at] &= may[:at] & may[1 : at + 1]
        place, count = phrase_counts(ids, starts, n)
        if not len(place):
            return
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        langs = pa.array(self.langs).dictionary_encode()
        for i in range(0, len(place), 65_536):
            own = place[i : i + 65_536]
            parts = [words.take(pa.array(ids[own + k])) for k in range(n)]
            phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[own])).dictionary_decode(), phrase, pa.array(count[i : i + 65_536])], schema=_COUNTS)


def _counter(n: int, bitmap, size: int):  # noqa: ANN001, ANN202
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        shard = _Shard()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                for part in portions(text.as_py(), size):
                    shard.add(lang, part)
                    if shard.size >= size:
                        yield from shard.counts(n, bits)
                        shard = _Shard()
        if shard.parts:
            yield from shard.counts(n, bits)

    return count


def bitmap_of(spark: SparkSession, phrases: DataFrame):  # noqa: ANN201
    """A broadcast bitmap of the hashes of a written table (lang, phrase); common.MOST_BITS at most."""
    bits = min(common.MOST_BITS, max(common.LEAST_BITS, 1 << (common.BITS_PER_KEY * max(1, phrases.count()) - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()
            at = [1 + (phrase_hash(lang, text.split(b" ")) & (bits - 1)) for lang, text in zip(langs, texts)]  # Spark numbers from 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["bit"])

    # Parts of the bitmap, 4 KB each, come to the driver: MOST_BITS in all.
    marked = phrases.select("lang", "phrase").mapInArrow(places, "bit bigint")
    marked = marked.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    whole = bytearray(bits // 8)
    for bucket, part in marked.collect():
        at = (bucket - 1) * len(part)
        whole[at : at + len(part)] = part[: len(whole) - at]
    return spark.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases up to max_words words with f >= min_count; (lang, n) with the number of all words."""
    spark = docs.sparkSession
    texts = common.pick(docs, "text", "lang").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    levels, bitmap, total = [], None, None
    for n in range(1, max_words + 1):
        counts = texts.mapInArrow(_counter(n, bitmap, shard_bytes), "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        if n == 1:
            words = common.materialize(counts, "words")
            total = common.materialize(words.groupBy("lang").agg(F.sum("f").alias("n_words")), "totals")
            counts = words
        level = common.materialize(counts.where(F.col("f") >= min_count).withColumn("words", F.lit(n)), "phrases")
        if n == 1:
            common.free(words)
        if bitmap is not None:
            bitmap.unpersist()
        levels.append(level)
        bitmap = bitmap_of(spark, level) if n < max_words else None
    return reduce(DataFrame.unionByName, levels), total


def collocations(docs: DataFrame, min_words: int = 2, max_words: int = 3, min_count: int = 10, covered_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    A phrase goes if a longer candidate holds it and has at least covered_percent of its count.
    """
    if not 2 <= min_words <= max_words:
        raise ValueError("2 <= min_words <= max_words")
    spark = docs.sparkSession
    with common.scope() as kept:
        grams, total = frequent_phrases(docs, max_words, min_count)
        found = grams.where(F.col("words") >= min_words)
        word = F.split("phrase", " ")
        if max_words > min_words:
            # The longest of the longer candidates' counts decides for all of them.
            inner = F.expr(f"flatten(transform(sequence({min_words}, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
            longer = found.where(F.col("words") > min_words).select("lang", "words", F.col("f").alias("longer"), word.alias("w")).select("lang", "longer", F.explode(inner).alias("phrase"))
            longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            found = found.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < " + f"{int(covered_percent)} * f")
        cuts = found.select("lang", "phrase", F.col("f").alias("a"), "words", word.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("rest"))
        first, rest = (grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(f)) for part, f in (("first", "l"), ("rest", "r")))
        cuts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
        exact = lambda c: f"cast({c} as decimal(16, 0))"
        score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})")
        best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
        best = common.materialize(best.select("lang", "phrase", "a", "b.l", "b.r", "b.score"), "scored")
        kept += [best, total]
    # A language may have any number of candidates: parts are ranked first, and then what is left of them.
    parts = 1 + best.count() // RANKED
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total) if total.count() < 10_000 else total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"
    )
