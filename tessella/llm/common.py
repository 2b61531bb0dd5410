"""What the operators of this subpackage share: scratch tables, row filters of a checked size, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.scratch import free, join_counted, materialize, new_path, scope, scratch_dir, total

__all__ = ["NO_ID", "Forest", "bound_batches", "components", "free", "index_of", "join_counted", "materialize", "maybe_among", "new_path", "pick", "scope", "scratch_dir", "total"]

#: Stands for a null document id wherever ids are ordered: null ranks last.
NO_ID = 2**63 - 1


def index_of(df: DataFrame, name: str) -> int:
    """Place of the column of exactly this name, else of the first that differs only in case."""
    same = [i for i, x in enumerate(df.columns) if x == name] or [i for i, x in enumerate(df.columns) if x.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return same[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns of df, under exactly these names; other columns of any name don't matter."""
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{index_of(df, name)}").alias(name) for name in names))


#: Bits of a row filter for each key, and its largest size: 2 ** 28 bits are 32 MB.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 2**16, 2**28


def maybe_among(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """rows with a column maybe: false only where the row's key is surely not in keys.

    keys is a written table, so counting it is cheap. Its bitmap has 16 to 32
    bits for each key, so that about one other row in twenty passes, and at most
    MOST_BITS (32 MB), so the broadcast has a proven size. Beyond 2 ** 24 keys
    the filter lets more rows pass; what follows decides exactly, so that costs
    a shuffle of more rows and nothing else.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(1, keys.count()) - 1).bit_length()))

    def bit() -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(bits))

    bitmap = keys.select(bit().alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
    bitmap = bitmap.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    flagged = rows.withColumn("_bit", bit()).withColumn("_bucket", F.bitmap_bucket_number("_bit"))
    byte = F.expr("conv(hex(substring(_map, cast(bitmap_bit_position(_bit) div 8 + 1 as int), 1)), 16, 10)").cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_bit) % 8 as int))")) != 0, F.lit(False))
    return flagged.join(F.broadcast(bitmap), "_bucket", "left").withColumn("maybe", hit).drop("_bit", "_bucket", "_map")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (u, v): component is the smallest id that links reach."""
    return graph.components(edges, [])


#: Bytes of an Arrow batch of texts: a Python worker holds a few of them, and what it makes of them, at once.
BATCH_BYTES = 16 * 2**20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's byte bound of Arrow batches to BATCH_BYTES if it has none of its own; batches of short rows stay as they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Forest:
    """Union-find over 0..n-1 with the smaller root on top."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(x) for x in range(len(self.up))), dtype=np.int64, count=len(self.up))
