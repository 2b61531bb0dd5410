"""Quality rules: distribution divergence.

Each document's histogram of character classes and of common words is held
against the histogram of its language, summed over the whole corpus, by the
Jensen-Shannon distance (base 2, square root, 0 to 1). Short texts have noisy
histograms, so each comparison has a least length. Two passes over the texts:
one sums the references (pre-aggregated in each batch), one scores. The
references are joined by language: those of languages with more than a thousandth of all
rows, of which there are fewer than a thousand, are broadcast, so no task gets all texts
of one.

Defined results: a null text has no words. Every language is held against itself, however
little there is of it, and rows without a language against each other, so verdicts don't
turn at any size of the corpus. Rows are judged one by one, so repeated ids don't matter and rows alike
get equal verdicts; a distance equal to its limit passes. Texts of any length are counted
whole. Of columns only text and lang count, by their exact names; others, of any name, are
passed through unchanged (one named quality stays in its place; the struct is the last). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import chain, covered, split_words

#: Frequent function words of the languages that are told apart.
COMMON_WORDS = {
    "de": "aber als auch auf aus bei das dass dem den der des die ein eine er es für hat ich im in ist mit nicht sich sie sind und von war wie zu".split(),
    "en": "a all and are as at be but by for from had have he her his i in is it not of on or that the they this to was what which with you".split(),
    "es": "a al como con de del el en es esta la las lo los más me no para pero por que se sin su sus un una y ya".split(),
    "fr": "a au avec ce ces dans de des du elle en est et il je la le les mais ne nous on ou par pas plus pour que qui sa se son sur un une vous".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
WORD_BIN = {w.encode(): i for i, w in enumerate(WORDS)}
#: Classes of characters; the last takes what no other has.
CLASSES = ["lower", "upper", "beyond_ascii", "digit", "space", "line_end", "stop", "exclaim", "symbol", "other"]
SYMBOLS = "#*$%&|<>"

_CLASS_OF = np.full(129, CLASSES.index("other"), np.uint8)
for _name, _chars in {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t",
    "line_end": "\n\r\v\f",
    "stop": ".,;:'\"-()",
    "exclaim": "!?",
    "symbol": SYMBOLS,
}.items():
    _CLASS_OF[[ord(c) for c in _chars]] = CLASSES.index(_name)
_CLASS_OF[128] = CLASSES.index("beyond_ascii")


def _characters(text: str) -> tuple[np.ndarray, int]:
    """Counts by class, and the code points that aren't in [\\x20\\x09-\\x0D]."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_counts = np.bincount(np.minimum(points, 128), minlength=129)
    blank = int(ascii_counts[0x20] + ascii_counts[0x09:0x0E].sum())
    return np.bincount(_CLASS_OF, weights=ascii_counts, minlength=len(CLASSES)).astype(np.int64), len(points) - blank


def _common(words: list[bytes]) -> np.ndarray:
    """Counts by common word; last, of all other words."""
    at = list(map(WORD_BIN.get, words))
    counts = np.bincount([x for x in at if x is not None], minlength=len(WORDS) + 1).astype(np.int64)
    counts[-1] = len(words) - counts.sum()
    return counts


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of so many words that occur twice or more, the first one included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=n)
    h = x[: n - width + 1]
    for k in range(1, width):
        h = chain(h, x[k : n - width + 1 + k])
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    return int(covered(at, at + width, n).sum())


def duplicate_lines(text: str) -> int:
    """\\n-split lines that have a word and equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\v\f\r"))
        else:
            seen.add(line)
    return n


BINS = len(CLASSES) + len(WORDS) + 1


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A count for each language and bin of a batch; bin -1 counts the rows."""
    for batch in batches:
        total: dict = {}
        for text, lang in zip(batch["text"], batch["lang"]):
            text = text or ""
            at = total.setdefault(lang, np.zeros(BINS + 1, np.int64))
            at[0] += 1
            at[1 : 1 + len(CLASSES)] += _characters(text)[0]
            at[1 + len(CLASSES) :] += _common(split_words(text.lower()))
        for lang, counts in total.items():
            yield pd.DataFrame({"lang": [lang] * (BINS + 1), "bin": range(-1, BINS), "n": counts})


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts; 0 where either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


_FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, common_distance double"


def _features(texts: pd.Series, references: pd.Series) -> pd.DataFrame:
    rows = []
    for text, bins in zip(texts, references):
        by_class, by_word = np.split(np.asarray(bins), [len(CLASSES)])
        text = text or ""
        words = split_words(text)
        chars, word_chars = _characters(text)
        rows.append((
            len(words), word_chars, int(chars[CLASSES.index("symbol")]), duplicate_lines(text), repeated_words(words),
            divergence(chars, by_class), divergence(_common(split_words(text.lower())), by_word),
        ))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _FEATURES.split(", ")])


def _key(lang: Column) -> Column:
    """The language as a key that isn't null."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def references(docs: DataFrame) -> DataFrame:
    """(_lang, bins, n) of every language: its key, counts by bin, and rows."""
    plain = common.pick(docs, "text", "lang")
    sums = plain.select("text", _key(F.col("lang")).alias("lang")).mapInPandas(_sums, "lang string, bin int, n bigint")
    sums = sums.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    bins = F.transform(F.sort_array(F.collect_list(F.when(F.col("bin") >= 0, F.struct("bin", "n")))), lambda x: x["n"])
    return common.materialize(sums.groupBy(F.col("lang").alias("_lang")).agg(bins.alias("_bins"), F.sum(F.when(F.col("bin") < 0, F.col("n"))).alias("n")), "references")


def judge(
    docs: DataFrame,
    max_class_distance: float = 0.3,
    max_common_distance: float = 0.18,
    common_noise: float = 1.6,
    min_chars: int = 120,
    min_common_words: int = 60,
) -> DataFrame:
    """docs with a struct column quality: the counts, both distances, base_failed and kept.

    The distance of common words that chance alone brings falls as the root of
    the number of words, so its limit is max_common_distance + common_noise / sqrt(n_words).
    """
    refs = references(docs)
    text, lang = (F.col(f"_{common.index_of(docs, x)}") for x in ("text", "lang"))
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).withColumn("_lang", _key(lang))
    held = common.join_counted(plain, refs, ["_lang"])
    held = held.withColumn("_f", F.pandas_udf(_features, _FEATURES)(text, F.col("_bins")))
    n, again = F.col("_f.n_words"), F.col("_f.n_repeat_words")
    base = (n < 10) | (100 * again > 20 * n)
    apart = ((F.col("_f.word_chars") >= min_chars) & (F.col("_f.class_distance") > max_class_distance)) | (
        (n >= min_common_words) & (F.col("_f.common_distance") > max_common_distance + common_noise / F.sqrt(n))
    )
    verdict = F.struct(
        *(F.col(f"_f.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base.alias("base_failed"),
        (~base & ~apart).alias("kept"),
        F.col("_f.class_distance").alias("class_distance"),
        F.col("_f.common_distance").alias("common_distance"),
    )
    out = held.select(*(F.col(f"_{i}") for i in range(len(docs.columns))), verdict.alias("_verdict"))
    return out.toDF(*docs.columns, "quality")


def keep(docs: DataFrame, **parameters) -> DataFrame:
    """The rows that no rule rejects, with the columns of docs."""
    judged = judge(docs, **parameters)
    plain = judged.toDF(*(f"_{i}" for i in range(len(docs.columns))), "_q")
    return plain.where("_q.kept").drop("_q").toDF(*docs.columns)
