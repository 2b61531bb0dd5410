"""Connected components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free, join_counted, materialize, total


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, component of every vertex of edges (keys, u, v); the component is its smallest id.

    Large and small stars by turns: every round is a few aggregations and joins
    on all graphs together, and the number of rounds grows with the logarithm of
    the longest path, so long thin tables are no special case. A hub's edges
    are never brought to one task: its row of the aggregate is broadcast
    (join_counted). Nothing is collected but two numbers a round.
    """
    e = edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    at = [*keys, "u"]
    mark = {"edges": F.count(F.lit(1)), "sum": F.expr(f"bit_xor(xxhash64({', '.join([*at, 'v'])}))")}
    e = materialize(e, "edges", **mark)
    while total(e, "edges"):
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy(*at).agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_counted(both.where("v > u"), low, at).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "stars")
        under = materialize(large.groupBy(*at).agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_counted(large, under, at).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(under.select(*at, F.col("m").alias("v"))).distinct(), "edges", **mark)
        done = all(total(e, x) == total(after, x) for x in mark)
        free(e, low, large, under)
        e = after
        if done:
            break
    tops = e.select(*keys, F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(*keys, F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
