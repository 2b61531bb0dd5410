"""Source divergence audit: how far the sources of a language differ in their use of terms.

Terms are found on bytes. The UTF-8 buffers of a batch of texts are one array; a table of
256 entries says which bytes belong to terms, and where that changes, or a text begins, a
term begins or ends. xxhash groups equal slices; the bytes of every slice are then compared
with those of its group's first, and slices that only share the hash get groups of their
own. Documents by terms form a sparse matrix (CSR) whose runs reduceat sums to document and
occurrence counts of each (language, source, term); Spark sums these over all batches.

A language keeps the terms that stand in enough of its documents. Shares of terms are
smoothed and scaled to integers in decimals. Two sources of a language differ by the sum of
the differences of their shares over all kept terms: terms are dealt to shards, and each
shard compares blocks of sources as CSR rows; only the sums of the shards are shuffled. A row
costs a comparison with the entries that there are, never with every term of every other row.

Defined results: a null text, language or source is the empty string. A (language, source)
group without terms counts, with all its shares smoothed from zero. A language without kept
terms has pairs of value 0 and no terms. Rows count one by one, repeated ones and repeated
ids too. Texts of any length are taken whole. Ties are ordered by the item's bytes, so ranks
are unique. Of columns only text, lang and source count, by their exact names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1_000_000_000
#: Text that is tokenized at once, and bytes that are compared at once.
CHUNK_BYTES, COMPARED = 8 * 2**20, 2**20
#: Entries of (source, term) in a shard of a language, and sources in a block.
SHARD_ENTRIES, BLOCK = 400_000, 512

_TERM = np.array([c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of terms in a buffer of texts that begin at the offsets, the last of which is its end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = inside[:-1], inside[1:]
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def group_slices(body: bytes, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The group of every slice, and each group's bytes. Slices are in one group only if all their bytes are equal."""
    slices = [body[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    hashes = np.fromiter(map(digest, slices), np.uint64, len(slices))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    data, sizes = np.frombuffer(body, np.uint8), ends - starts
    twin = first[group]
    same = sizes == sizes[twin]
    # The bytes of slices are compared some at a time.
    todo = np.flatnonzero(same & (twin != np.arange(len(slices))))
    for part in np.split(todo, np.flatnonzero(np.diff(np.cumsum(sizes[todo]) // COMPARED)) + 1):
        if len(part):
            size = sizes[part]
            begin = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(begin, size)
            equal = data[np.repeat(starts[part], size) + step] == data[np.repeat(starts[twin[part]], size) + step]
            same[part] = np.logical_and.reduceat(equal, begin)
    names = [slices[i] for i in first.tolist()]
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        if slices[i] not in others:
            others[slices[i]] = len(names)
            names.append(slices[i])
        group[i] = others[slices[i]]
    return group, names


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about CHUNK_BYTES of text, one row at least."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to
        at = to


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with, and occurrences of, each (lang, source, term) of a chunk of texts."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        of: dict[tuple, int] = {}
        groups = np.array([of.setdefault(x, len(of)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
        langs, sources = (pa.array(x, pa.string()) for x in zip(*of))
        for at, to in _chunks(offsets):
            own = offsets[at : to + 1] - offsets[at]
            body = data[offsets[at] : offsets[to]].tobytes().translate(_LOWER)
            starts, ends = term_bounds(np.frombuffer(body, np.uint8), own)
            if not len(starts):
                continue
            term, names = group_slices(body, starts, ends)
            # CSR: a row for each document, its terms in order with their counts.
            doc = np.searchsorted(own, starts, "right") - 1
            cell, times = np.unique(doc * len(names) + term, return_counts=True)
            key = groups[at + cell // len(names)] * len(names) + cell % len(names)
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            docs, n = np.diff(np.append(runs, len(key))), np.add.reduceat(times, runs)
            words = pa.array(names, pa.binary()).cast(pa.string())
            for i in range(0, len(runs), 65_536):
                k = key[runs[i : i + 65_536]]
                group = pa.array(k // len(names))
                yield pa.RecordBatch.from_arrays(
                    [langs.take(group), sources.take(group), words.take(pa.array(k % len(names))), pa.array(docs[i : i + 65_536]), pa.array(n[i : i + 65_536])], schema=_COUNTS
                )


def _baseline(values: np.ndarray, rest: int, zero: int, others: np.ndarray) -> np.ndarray:
    """Sum of |x - c| over a row's shares for each c of others; rest of its terms have the share zero."""
    x = np.sort(values)
    sums = np.append(0, np.cumsum(x))
    k = np.searchsorted(x, others)
    return others * k - sums[k] + (sums[-1] - sums[k]) - others * (len(x) - k) + rest * np.abs(zero - others)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def block_differences(entries: pd.DataFrame, rows: pd.DataFrame, terms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each source of block a: the sources of block b that it meets, as places in their byte order, and the sums of differences from all over a shard's terms.

    entries: source, term and share p of what occurs; rows: source, block side and share zero of what doesn't.
    """
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: _bytes(rows["source"].iloc[i]))].reset_index(drop=True)
    place = {s: i for i, s in enumerate(rows["source"])}
    zero, in_a, in_b = rows["zero"].to_numpy(np.int64), rows["in_a"].to_numpy(bool), rows["in_b"].to_numpy(bool)
    row = entries["source"].map(place).to_numpy(np.int64)
    order = np.argsort(row, kind="stable")
    _, column = np.unique(entries["term"].to_numpy(object)[order], return_inverse=True) if len(entries) else (None, np.zeros(0, np.int64))
    share, starts = entries["p"].to_numpy(np.int64)[order], np.searchsorted(row[order], np.arange(len(rows) + 1))
    counts = np.diff(starts)
    dense, full = np.zeros(terms, np.int64), np.flatnonzero(counts)
    for i in np.flatnonzero(in_a).tolist():
        own = slice(starts[i], starts[i + 1])
        dense[:] = zero[i]
        dense[column[own]] = share[own]
        # Each row's own entries, in place of its share of what doesn't occur.
        total = _baseline(share[own], terms - counts[i], int(zero[i]), zero)
        if len(full):
            mine = dense[column]
            change = np.abs(mine - share) - np.abs(mine - np.repeat(zero, counts))
            total[full] += np.add.reduceat(change, starts[full])
        to = np.flatnonzero(in_b & (np.arange(len(rows)) > i) | in_b & ~in_a & (np.arange(len(rows)) != i))
        yield i, to, total


def shares(docs: DataFrame, min_docs: int = 30, smoothing: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source, term, p, q, n) of what occurs, (lang, source, zero, terms) of every group, (lang, terms, entries) of every language; written tables."""
    plain = common.pick(docs, "text", "lang", "source").select(*(F.coalesce(x, F.lit("")).alias(x) for x in ("text", "lang", "source")))
    counts = plain.mapInArrow(count_terms, "lang string, source string, term string, docs bigint, n bigint")
    counts = common.materialize(counts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("times")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("lang_times")).where(F.col("docs") >= min_docs).drop("docs")
    kept = common.materialize(kept, "terms")
    cells = common.materialize(counts.join(kept, ["lang", "term"]).drop("docs"), "cells")
    common.free(counts)
    groups = plain.groupBy("lang", "source").agg(F.lit(0).alias("_")).drop("_")
    sums = cells.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_times").alias("lang_total"))
    langs = langs.join(cells.groupBy("lang").agg(F.count("*").alias("entries")), "lang")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.materialize(groups.select("lang", "source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "terms", "lang_total", "entries"))), "groups")
    whole = lambda c: f"cast({c} as decimal(20, 0))"

    def share(times: str, total: str) -> str:
        return f"1 + ({whole(SCALE)} * ({times} + {smoothing})) div ({total} + {smoothing} * terms)"

    cells = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(share("times", "total")).alias("p"), F.expr(share("lang_times", "lang_total")).alias("q"), "terms", "entries")
    groups = groups.select("lang", "source", F.when(F.col("terms") > 0, F.expr(f"1 + ({whole(SCALE)} * {smoothing}) div nullif(total + {smoothing} * terms, 0)")).otherwise(0).alias("zero"), "terms", "entries")
    return common.materialize(cells, "shares"), common.materialize(groups, "groups"), kept


def pair_differences(cells: DataFrame, groups: DataFrame, kept: DataFrame, shard_entries: int = SHARD_ENTRIES, block: int = BLOCK) -> DataFrame:
    """lang, u, v and value: the sum of differences of every two sources of a language, once."""
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    blocks = F.ceil(F.col("sources") / block).cast("int")
    part = lambda c, of: F.pmod(F.xxhash64(c), of).cast("int")
    sized = groups.join(sources, "lang").where("sources > 1").withColumn("blocks", blocks).withColumn("shards", F.ceil((F.col("entries") + 1) / shard_entries).cast("int"))
    sized = common.materialize(sized.withColumn("block", part("source", F.col("blocks"))), "sized")
    langs = sized.groupBy("lang").agg(F.first("blocks").alias("blocks"), F.first("shards").alias("shards"))
    # A block meets itself and every other block once.
    meets = F.expr("explode(transform(sequence(0, blocks - 1), x -> struct(least(x, block) as a, greatest(x, block) as b)))")
    rows = sized.withColumn("m", meets).withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    rows = rows.select("lang", "shard", "m.a", "m.b", "source", "zero", (F.col("block") == F.col("m.a")).alias("in_a"), (F.col("block") == F.col("m.b")).alias("in_b"))
    dealt = cells.join(sized.select("lang", "source", "blocks", "shards", "block"), ["lang", "source"]).withColumn("m", meets)
    dealt = dealt.select("lang", part("term", F.col("shards")).alias("shard"), "m.a", "m.b", "source", "term", "p")
    width = kept.join(langs, "lang").groupBy("lang", part("term", F.col("shards")).alias("shard")).agg(F.count("*").alias("width"))
    rows = rows.join(width, ["lang", "shard"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    by = ["lang", "shard", "a", "b"]

    def differ(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        found = [(i, to, total[to]) for i, to, total in block_differences(entries, rows, int(rows["width"].iloc[0]))] if len(rows) else []
        names = np.array(sorted(rows["source"], key=_bytes), object)
        u = np.repeat([i for i, _, _ in found], [len(to) for _, to, _ in found]).astype(np.int64)
        v, value = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (1, 2))
        text = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({"lang": text([key[0]] * len(u)), "u": text(names[u]), "v": text(names[v]), "value": value})

    sums = rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(differ, "lang string, u string, v string, value bigint")
    return sums.groupBy("lang", "u", "v").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, top_terms: int = 50, shard_entries: int = SHARD_ENTRIES, block: int = BLOCK) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    with common.scope() as keep:
        cells, groups, kept = shares(docs, min_docs, smoothing)
        pairs = common.materialize(pair_differences(cells, groups, kept, shard_entries, block), "pairs")
        keep += [cells, pairs]
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    both = pairs.select("lang", F.col("u").alias("source"), F.col("v").alias("item"), "value").unionByName(pairs.select("lang", F.col("v").alias("source"), F.col("u").alias("item"), "value"))
    terms = ranked(cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top_terms)
    of = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return of(ranked(both), "pair").unionByName(of(terms, "term"))
