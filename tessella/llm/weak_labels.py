"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation estimates the accuracy of every labeller and the
share of good documents from how often each pattern of votes occurs in the
whole corpus; there are at most 3 ** len(LABELLERS) patterns, so their counts
have a fixed size. The posteriors of a sample train a linear scorer over hashed
words and word shapes. Its weights, DIMENSIONS numbers, go to every task, and every
document is voted on and scored whole in one pass, without a join.

The sample is the SAMPLE documents with the smallest hashes of id and text, so the
fit can be repeated whatever the partitions are. The bound is a parameter: the driver
gets at most SAMPLE rows of at most DIMENSIONS (place, share) pairs of 6 bytes.

Defined results: a null or empty text has no words and is scored 0 and judged bad by
length. Very long texts are voted on and scored whole. Rows are judged one by one:
repeated rows, and rows alike, get equal results. score equal to the threshold is
kept. Of columns only doc_id and text count, by their exact names. With no documents
nothing is fitted and the result is empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import SYMBOLS, WORD_BIN, repeated_words
from .words import split_words

DIMENSIONS = 2**15
SAMPLE = 4_000
LABELLERS = ["length", "symbols", "capitals", "repetition", "common_words", "word_length", "sentence_ends"]

_SYMBOLS = frozenset(SYMBOLS.encode())


def votes(text: str | None) -> str:
    """A character for each labeller: 1 good, 0 bad, - none."""
    text = text or ""
    words = split_words(text)
    n = len(words)
    if not n:
        return "0" + "-" * (len(LABELLERS) - 1)
    raw = text.encode("utf-8", "surrogatepass")
    symbols = sum(raw.count(bytes([c])) for c in _SYMBOLS) / n
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    repeated = repeated_words(words) / n
    common_share = sum(w.lower() in WORD_BIN for w in words) / n
    letters = sum(map(len, words)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in ".!?:\"'" for x in lines) / max(1, len(lines))

    def say(good: bool, bad: bool) -> str:
        return "0" if bad else "1" if good else "-"

    return "".join((
        say(n >= 40, n < 8),
        say(symbols < 0.02, symbols > 0.15),
        say(upper < 0.1, upper > 0.3) if n >= 5 else "-",
        say(repeated < 0.05, repeated > 0.2) if n >= 20 else "-",
        say(common_share > 0.15, common_share < 0.04) if n >= 20 else "-",
        say(3 <= letters <= 9, letters > 12),
        say(ends > 0.6, ends < 0.2),
    ))


def fit_labellers(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern; each labeller's accuracy where it votes; share of good documents.

    Labellers are taken as independent given the class; one that doesn't vote tells nothing.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], np.float64)
    v = np.array([["10-".index(c) for c in p] for p in patterns])
    share = (v == 0).sum(1) / np.maximum(1, (v != 2).sum(1))
    good = np.where((v == 1).any(1), 0.5 * share, 0.95)  # to begin with, one bad vote counts for much
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / n.sum(), 0.02, 0.98))
        log = np.zeros((len(patterns), 2))
        log[:] = np.log([prior, 1 - prior])
        said = np.empty((2, v.shape[1], 3))
        for k in range(v.shape[1]):
            for c, weight in enumerate((n * good, n * (1 - good))):
                said[c, k] = np.bincount(v[:, k], weights=weight, minlength=3) + 1
                said[c, k] /= said[c, k, :2].sum()
                said[c, k, 2] = 1
                log[:, c] += np.log(said[c, k, v[:, k]])
        good = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
    right = prior * said[0, :, 0] + (1 - prior) * said[1, :, 1]
    wrong = prior * said[0, :, 1] + (1 - prior) * said[1, :, 0]
    return dict(zip(patterns, good.tolist())), right / (right + wrong), prior


def _shape(word: bytes) -> bytes:
    out = bytearray()
    for c in word:
        s = 0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x30 if 0x30 <= c <= 0x39 else c
        if not out or out[-1] != s:
            out.append(s)
    return b"\0" + bytes(out[:6])


def _places(word: bytes) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(word.lower()) % DIMENSIONS, xxhash.xxh32_intdigest(_shape(word), 1) % DIMENSIONS


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, pattern in zip(batch["text"], batch["pattern"]):
            words = split_words(text)
            count = Counter(x for w in words for x in _places(w))
            rows.append((pattern, np.fromiter(count, np.int16, len(count)), np.fromiter(count.values(), np.float32, len(count)) / np.float32(max(1, len(words)))))
        yield pd.DataFrame(rows, columns=["pattern", "at", "share"])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each pattern occurs in a batch."""
    for batch in batches:
        count = Counter(map(votes, batch["text"]))
        yield pd.DataFrame({"pattern": list(count), "n": list(count.values())})


def train(at: list[np.ndarray], share: list[np.ndarray], target: np.ndarray, rounds: int = 150, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of the mean weight of a text's features, by Adam on soft labels."""
    places, values = np.concatenate(at).astype(np.int64), np.concatenate(share)
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    w, b = np.zeros(DIMENSIONS + 1), 0.0
    m, s = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean()))
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=values * w[places], minlength=len(at)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(at)
        g = np.bincount(places, weights=values * error[row], minlength=DIMENSIONS + 1)
        g[-1] = error.sum()
        g[:-1] += 1e-6 * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    b = float(w[-1])
    return w[:-1].astype(np.float32), b


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, pattern of votes, posterior, score and kept (score >= threshold) of every row."""
    plain = common.pick(docs, "doc_id", "text")

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(x) for x in texts], dtype=object)

    sums = plain.select("text").mapInPandas(_counts, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in sums.collect()}
    total = sum(counts.values())
    if not total:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, pattern string, posterior double, score double, kept boolean")
    posterior, _, _ = fit_labellers(counts)
    # A hash takes about twice the sample, and the smallest ones of these are it: fewer rows are ordered.
    keyed = plain.withColumn("key", F.xxhash64(F.lit(11), "doc_id", "text"))
    near = keyed.where(F.pmod("key", F.lit(1 << 30)) < int(min(1.0, (2 * sample + 100) / total) * (1 << 30)))
    drawn = near.orderBy(F.pmod("key", F.lit(1 << 30)), "key", "doc_id").limit(sample)
    learned = drawn.select("text", vote("text").alias("pattern")).mapInPandas(_vectors, "pattern string, at array<smallint>, share array<float>").toPandas()
    weights, bias = train(list(learned["at"]), list(learned["share"]), learned["pattern"].map(posterior).to_numpy(np.float64))

    class Weights(dict):
        def __missing__(self, word: bytes) -> float:
            if len(self) > 300_000:
                self.clear()
            a, b = _places(word)
            x = self[word] = float(weights[a] + weights[b])
            return x

    @F.pandas_udf("pattern string, posterior double, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        of, out = Weights(), []
        for text in texts:
            words, pattern = split_words(text), votes(text)
            z = bias + (sum(map(of.__getitem__, words)) / len(words) if words else 0.0)
            out.append((pattern, posterior[pattern], 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) if words else 0.0))
        return pd.DataFrame(out, columns=["pattern", "posterior", "score"])

    out = plain.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")
    return out.withColumn("kept", F.col("score") >= threshold)
