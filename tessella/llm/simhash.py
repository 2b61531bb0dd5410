"""SimHash near-duplicates by meet-in-the-middle ball hashing.

The fingerprint has a bit set if over half the XXH64 hashes (seed 42) of the
document's word shingles have it set. Two fingerprints that differ in at most
three bits meet: each emits variants of itself, and a variant that two emit
links them. A pair at distance two or less meets where both flip at most one
bit. A pair at distance three has one fingerprint of even and one of odd
parity, and two of the three bits lie in the same half of the word: the odd
one flips those two, the even one the third. So even fingerprints emit 65
variants and odd ones 65 + 992. What meets in a variant is within the radius:
all that reach a variant by at most one flip are within two of each other, those
that reach it by two within three of these. So each variant needs a star around
one that reaches it by at most one flip, not all pairs, and a large group of near
copies costs no more than any other rows. Pairs are deduplicated, and each is
verified by the bits that its two fingerprints differ in.

The shuffle deals variants by their top bits. A fingerprint is sent once to
each such prefix that its ball touches, and its variants are expanded there, so
the shuffle holds a few rows a fingerprint instead of a thousand. Each prefix
returns a spanning forest of what met there. A prefix that too many fingerprints
reach (templated texts share their top bits) is dealt anew by more of them, up to the
half of the word that two flips stay in.

Defined results: null and empty texts, and texts of white space only, have the
fingerprint zero and link like any other. Texts of any length are shingled whole,
by parts of 65,536 hashes. Repeated ids and rows are allowed, and rows alike get
equal results. A null id never becomes a component's id unless the component has
no other. Of columns only doc_id and text count, by their exact names. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
RADIUS = 3
HALVES = (range(32), range(32, 64))
#: Variants that one prefix is meant to hold; twice the prefixes from twice the rows.
VARIANTS_PER_PREFIX = 4_000_000
#: Rows that make a prefix crowded.
CROWD = 40_000
#: Odd fingerprints whose 992 double flips are held at once.
CHUNK = 4_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = np.concatenate(([0], ends[:-shingle] + 1)).tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts)).view(np.int64))

    return common.pick(docs, "doc_id", "text").select("doc_id", fp("text").alias("fp"))


def _odd(x: np.ndarray) -> np.ndarray:
    for s in (32, 16, 8, 4, 2, 1):
        x = x ^ (x >> np.uint64(s))
    return (x & np.uint64(1)).astype(bool)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the fingerprints of two arrays differ."""
    return np.unpackbits((x ^ y).view(np.uint8).reshape(-1, 8), axis=1).sum(1)


def _reach(q: int) -> tuple[list[int], list[int]]:
    """What a ball's prefixes differ in from the fingerprint's own, for even and for odd ones."""
    near = [0, *(1 << i for i in range(q))]
    return near, [*near, *((1 << i) | (1 << j) for i, j in combinations(range(q), 2))]


def _sender(q: int):
    near, far = (np.array(x, np.int64) for x in _reach(q))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed = batch["fp"].to_numpy(np.int64)
            x = signed.view(np.uint64)
            prefix, odd = (x >> np.uint64(64 - q)).astype(np.int64), _odd(x)
            for who, masks in ((~odd, near), (odd, far)):
                yield pd.DataFrame({"prefix": (prefix[who][:, None] ^ masks).ravel(), "fp": np.repeat(signed[who], len(masks))})

    return send


def _meet(fps: np.ndarray, prefix: int, q: int) -> np.ndarray:
    """Component, as an index into fps, of each fingerprint by the variants with this prefix."""
    away = (fps >> np.uint64(64 - q)) ^ np.uint64(prefix)
    n_away = np.unpackbits(away.view(np.uint8).reshape(-1, 8), axis=1).sum(1)
    low, own = [i for i in range(64 - q)], np.arange(len(fps))
    crossing = away << np.uint64(64 - q)
    at_home, one_off = own[n_away == 0], own[n_away == 1]
    # Every variant by one flip at most.
    flips = np.array([0, *(1 << i for i in low)], np.uint64)
    keys = np.concatenate([(fps[at_home][:, None] ^ flips).ravel(), fps[one_off] ^ crossing[one_off]])
    whose = np.concatenate([np.repeat(at_home, len(flips)), one_off])
    order = np.argsort(keys, kind="stable")
    keys, whose = keys[order], whose[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    centre, of = whose[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    pairs = [np.stack([centre[of], whose], 1)]
    keys = keys[first]

    def look(variants: np.ndarray, owners: np.ndarray) -> None:
        if len(keys) and len(variants):
            at = np.minimum(np.searchsorted(keys, variants), len(keys) - 1)
            hit = keys[at] == variants
            pairs.append(np.unique(np.stack([centre[at[hit]], owners[hit]], 1), axis=0))

    # Double flips of the odd ones, both in one half.
    odd = _odd(fps)
    doubles = np.array([(1 << i) | (1 << j) for half in HALVES for i, j in combinations([b for b in half if b < 64 - q], 2)], np.uint64)
    home = at_home[odd[at_home]]
    for k in range(0, len(home), CHUNK):
        part = home[k : k + CHUNK]
        look((fps[part][:, None] ^ doubles).ravel(), np.repeat(part, len(doubles)))
    once = one_off[odd[one_off]]
    beside = np.array([1 << i for i in HALVES[1] if i < 64 - q], np.uint64)
    for k in range(0, len(once), CHUNK * 32):
        part = once[k : k + CHUNK * 32]
        look(((fps[part] ^ crossing[part])[:, None] ^ beside).ravel(), np.repeat(part, len(beside)))
    twice = own[(n_away == 2) & odd]
    look(fps[twice] ^ crossing[twice], twice)

    pairs = np.unique(np.concatenate(pairs), axis=0)
    pairs = pairs[_apart(fps[pairs[:, 0]], fps[pairs[:, 1]]) <= RADIUS]
    forest = common.Forest(len(fps))
    forest.join(pairs[pairs[:, 0] != pairs[:, 1]])
    return forest.roots()


def _deeper(q: int, more: int):
    """Rows of crowded prefixes of q bits, dealt by so many more bits: each to what its flips that are left reach."""
    masks = [np.array([sum(1 << i for i in bits) for bits in combinations(range(more), k)], np.int64) for k in range(3)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed, prefix = batch["fp"].to_numpy(np.int64), batch["prefix"].to_numpy(np.int64)
            x = signed.view(np.uint64)
            used = np.unpackbits(((x >> np.uint64(64 - q)) ^ prefix.view(np.uint64)).view(np.uint8).reshape(-1, 8), axis=1).sum(1)
            left = 1 + _odd(x) - used.astype(np.int64)
            own = (prefix << more) | ((x >> np.uint64(64 - q - more)).astype(np.int64) & ((1 << more) - 1))
            for k in range(3):
                who = left >= k
                for at in range(0, int(who.sum()), 10_000):
                    part, fp = own[who][at : at + 10_000], signed[who][at : at + 10_000]
                    yield pd.DataFrame({"prefix": (part[:, None] ^ masks[k]).ravel(), "fp": np.repeat(fp, len(masks[k]))})

    return send


def links(fps: DataFrame, n: int, crowd: int = CROWD) -> DataFrame:
    """(u, v) of distinct signed fingerprints: links within the radius that join all that any links join."""
    q = min(20, max(6, ceil(log2(max(1, n * 561 / VARIANTS_PER_PREFIX)))))

    def joined(sent: DataFrame, q: int) -> DataFrame:
        def meet(rows: pd.DataFrame) -> pd.DataFrame:
            x = np.sort(rows["fp"].to_numpy(np.int64))
            root = _meet(x.view(np.uint64), int(rows["prefix"].iloc[0]), q)
            other = root != np.arange(len(x))
            return pd.DataFrame({"u": x[other], "v": x[root[other]]})

        return sent.groupBy("prefix").applyInPandas(meet, "u bigint, v bigint")

    sent = fps.select("fp").mapInPandas(_sender(q), "prefix bigint, fp bigint")
    if n <= crowd:
        return joined(sent, q)
    crowds = common.materialize(sent.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowds")
    most = common.total(crowds, "most_n")
    if not most:
        return joined(sent, q)
    more = min(HALVES[1].start - q, 1 + ceil(log2(most / crowd)) + 2)
    again = sent.join(crowds.select("prefix"), "prefix", "left_semi").mapInPandas(_deeper(q, more), "prefix bigint, fp bigint")
    return joined(sent.join(crowds.select("prefix"), "prefix", "left_anti"), q).unionByName(joined(again, q + more))


def classes(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    with common.scope() as kept:
        fps = common.materialize(fingerprints(docs, shingle), "fingerprints")
        distinct = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
        joined = common.components(links(distinct, distinct.count()))
        # Copies of one text, and near copies of one component, may be a large part of all rows.
        roots = distinct.join(joined, distinct.fp == joined.id, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
        roots = common.materialize(roots.withColumnRenamed("n", "rows"), "roots")
        names = common.materialize(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
        named = common.join_counted(roots, names, ["root"]).select("fp", F.col("rows").alias("n"), "component_id")
        named = common.materialize(named, "classes")
        kept += [fps, named]
    return common.join_counted(fps, named, ["fp"]).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with the columns of docs.

    Of rows that share an id that stays, the one whose text has the smallest
    hash stays. Rows with a null id have nothing to be chosen by, and all stay.
    Only rows that may have to go (a bitmap of their ids tells) take part in a
    join; the others pass as they are.
    """
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    doc_id, text = (F.col(f"_{common.index_of(docs, x)}") for x in ("doc_id", "text"))
    ids = classes(docs, shingle).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    ids = ids.agg(F.count("*").alias("_n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("_stays"))
    special = common.materialize(ids.where("_n > 1 or not _stays").withColumn("n", F.col("_n")), "special")
    flagged = common.maybe_among(plain.withColumn("_id", doc_id), special, "_id")
    names = plain.columns
    held = common.join_counted(flagged.where("maybe"), special, ["_id"], "left").where("coalesce(_stays, true)")
    out = flagged.where("not maybe").select(*names).unionByName(held.where("coalesce(_n, 1) = 1").select(*names))
    if not special.where("_n > 1 and _stays").isEmpty():
        again = held.where("_n > 1").groupBy(doc_id.alias("_id")).agg(F.min_by(F.struct(*names), F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))).alias("_row"))
        out = out.unionByName(again.select("_row.*"))
    return out.toDF(*docs.columns)
