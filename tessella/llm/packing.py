"""Best-fit packing with several bin sizes.

Token sequences of documents go to training bins of several permitted lengths. An
item longer than the largest length is cut into pieces of that length and a rest.
Items are dealt to shards by a hash; each shard takes its items from longest to
shortest and puts each into the open bin that it leaves least space in. Where none has
space, the bin size that costs least a token is opened: its cost over what it is
expected to hold (the item, and as much of the shard's remaining shorter items as
fits). At the end each bin shrinks to the least permitted length that holds its
contents.

best_fit() makes the layout from ids and lengths, all that is shuffled for it;
sequences() writes the bins' token ids. The number of shards follows from the total
length, so a shard stays the same size as the input grows, and no source or group of
copies decides where a row goes.

Defined results: an item of length 0, or null, gets one row without a bin. A null text
has the begin and end ids. Very long texts are tokenized whole and cut. Repeated ids, and
rows alike, are items of their own. Of equal lengths the smaller doc_id goes first (null
last), then the smaller text hash and the earlier piece; of equal spaces the bin that was
opened first is taken, of equal costs the smaller size. Every token of every item is in
exactly one piece, and no bin holds more than its size. Of columns only doc_id and text
count, by their exact names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sentencepiece_codec import codec

SIZES = (512, 1024, 2048, 4096)
#: What a bin costs beside its length, in tokens.
OVERHEAD = 16
#: Tokens of one shard, 120 bins of the largest length.
SHARD_TOKENS = 500_000


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin number and offset of each item, and the size of each bin. Lengths are from longest to shortest, none over the largest size."""
    sizes = tuple(sorted(sizes))
    after = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        after[i] = after[i + 1] + lengths[i]
    negative = [-x for x in lengths]
    spaces: list[tuple[int, int]] = []  # of open bins, with their numbers
    held: list[int] = []
    of, at = [], []
    for i, n in enumerate(lengths):
        k = bisect_left(spaces, (n, -1))
        if k < len(spaces):
            space, b = spaces.pop(k)
        else:
            def cost(size: int, n: int = n, i: int = i) -> float:
                fit = max(i + 1, bisect_left(negative, -(size - n)))
                return (size + overhead) / (n + min(size - n, after[fit]))

            space, b = min((s for s in sizes if s >= n), key=lambda s: (cost(s), s)), len(held)
            held.append(0)
        of.append(b)
        at.append(held[b])
        held[b] += n
        if space > n:
            insort(spaces, (space - n, b))
    return of, at, [sizes[bisect_left(sizes, x)] for x in held]


def best_fit(items: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, thash, piece, start, length, shard, bin, bin_size, offset of every piece of every item (doc_id, thash, n_tokens)."""
    largest = max(sizes)
    items = common.pick(items, "doc_id", "thash", "n_tokens").withColumn("n_tokens", F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)))
    items = common.materialize(items, "lengths")
    shards = max(1, ceil((items.agg(F.sum("n_tokens")).first()[0] or 0) / SHARD_TOKENS))
    last = F.greatest(F.ceil(F.col("n_tokens") / largest) - 1, F.lit(0))
    pieces = items.select("doc_id", "thash", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    start = F.col("piece") * largest
    pieces = pieces.select("doc_id", "thash", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(largest).cast("bigint")).alias("length"))
    deal = F.pmod(F.xxhash64("doc_id", "thash", "piece"), F.lit(shards)).cast("int")
    names = ["doc_id", "thash", "piece", "start", "length", "shard", "bin", "bin_size", "offset"]

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "thash", "piece"], ascending=[False, True, True, True], na_position="last").reset_index(drop=True)
        bins, offsets, size_of = pack(rows["length"].tolist(), sizes, overhead)
        return rows.assign(bin=bins, offset=offsets, bin_size=[size_of[b] for b in bins])[names]

    schema = "doc_id bigint, thash bigint, piece bigint, start bigint, length bigint, shard int, bin int, bin_size int, offset int"
    packed = pieces.where("length > 0").withColumn("shard", deal).groupBy("shard").applyInPandas(pack_shard, schema)
    nothing = [F.lit(None).cast("int").alias(x) for x in names[5:]]
    return packed.unionByName(pieces.where("length = 0").select(*names[:5], *nothing))


def _layout(docs: DataFrame, model_path: str, sizes: tuple[int, ...], overhead: int) -> DataFrame:
    @F.pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([codec(model_path).count(x) for x in texts], dtype="int64")

    items = common.pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("thash"), tokens("text").alias("n_tokens"))
    return best_fit(items, sizes, overhead)


def pack_documents(docs: DataFrame, model_path: str, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """Where the token ids of every document (SentencePiece, with begin and end) lie: doc_id, piece, start, length, shard, bin, bin_size, offset."""
    return _layout(docs, model_path, sizes, overhead).drop("thash")


def sequences(docs: DataFrame, model_path: str, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """The packed bins: shard, bin, bin_size, n_tokens, doc_ids and ids, both in the order of the bin; bin_size - n_tokens places are left."""
    layout = _layout(docs, model_path, sizes, overhead).where("bin is not null").withColumn("doc_id", F.coalesce("doc_id", F.lit(common.NO_ID)))
    layout, largest, key = common.materialize(layout, "layout"), max(sizes), ["doc_id", "thash", "piece"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, t, text in zip(batch["doc_id"], batch["thash"], batch["text"]):
                ids = np.frombuffer(codec(model_path).round_trip(text)[0], "<u4").astype(np.int32)
                parts = [ids[a : a + largest] for a in range(0, len(ids), largest)]
                yield pd.DataFrame({"doc_id": d, "thash": t, "piece": range(len(parts)), "ids": parts})

    texts = common.pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
    texts = texts.groupBy("doc_id", "thash").agg(F.first("text").alias("text"))
    found = texts.mapInPandas(pieces, "doc_id bigint, thash bigint, piece bigint, ids array<int>")
    found = common.materialize(found.join(layout.groupBy(*key).agg(F.count("*").alias("n")), key), "pieces")
    placed = common.join_counted(layout, found, key)
    own = F.when(F.col("doc_id") != common.NO_ID, F.col("doc_id"))
    bins = placed.groupBy("shard", "bin", "bin_size").agg(F.sort_array(F.collect_list(F.struct("offset", own.alias("doc_id"), "ids"))).alias("p"))
    return bins.select("shard", "bin", "bin_size", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids")).withColumn("n_tokens", F.size("ids"))
