"""Embedding near-duplicates with a forest of random-projection trees.

Equal vectors of one label form a class and take part once, with their number.
Every tree splits the space of unit vectors again and again along random
directions. It is fitted on a bounded sample (SAMPLE vectors with the smallest
hashes, a documented bound): a node takes the direction and place, of some random
ones, that sends the fewest vectors both ways and leaves a fair part on either side.
A vector within the spill of a split goes to both sides, so it has some leaves in
each tree. A node isn't split where the best split would send more than MOST_BOTH of
its vectors both ways: it is one tight cluster, which splitting would only copy. Only
the number of a direction and the place of each split are sent to the tasks, never
the sample.

Vectors of one label, width and leaf are compared in double precision. A pair is
counted in the first leaf that its two vectors share, by the leaf lists that they
carry, so pairs are never emitted, shuffled or deduplicated: a leaf returns a count
and a root for each vector. A leaf larger than LEAF_MOST is compared in parts, each
with each, in tasks of their own, which loses nothing.

The depth follows from the largest label, so leaves keep their size as the table
grows.

Pairs below the threshold are never linked. A pair at the threshold is lost by
one tree with a probability of some hundredths (the two must fall on different
sides of a split and both beyond the spill), so by all TREES hardly ever; the
tests hold the result against brute force.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, or whose label or id is null, link with nothing, and are
kept. Vectors of different width don't link. Repeated ids are allowed: their rows
are vectors of their own. The smallest id of equal ones stands for a class. Of columns
only vec_id, embedding and label count, by their exact names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TREES = 6
SAMPLE = 8_192
LEAF = 1_024
LEAF_MOST = 4_096
#: Part of the chord between vectors at the threshold, projected on a direction, within which a split sends a vector both ways.
SPILL = 0.5


#: Random directions of a tree, and how many of them a node tries.
DIRECTIONS, TRIED = 64, 6
#: Part of a node's vectors that a split may send both ways.
MOST_BOTH = 0.35
#: Rows of the sample below which a node's own say too little; its nearest ancestor with as many stands for it.
FEW = 48
_PLACES = np.linspace(0.25, 0.75, 11)


def directions(tree: int, width: int) -> np.ndarray:
    """The random unit directions of one tree, as columns; made anew wherever they are needed."""
    ways = np.random.default_rng([tree, width]).standard_normal((width, DIRECTIONS))
    return ways / np.linalg.norm(ways, axis=0)


class Tree:
    """Splits of one tree over unit vectors of one width: node -> (direction, place, node below, node above). Nodes are numbered from 0."""

    def __init__(self, number: int, width: int, spill: float) -> None:
        self.number, self.width, self.spill = number, width, spill
        self.splits: dict[int, tuple[int, float, int, int]] = {}

    def fit(self, sample: np.ndarray, rows: int, leaf_rows: int) -> Tree:
        """Splits until a leaf is expected to hold leaf_rows of the rows that the sample stands for, or is one tight cluster."""
        side = sample @ directions(self.number, self.width)
        todo, nodes = [(0, np.arange(len(sample)), float(rows))], 1
        while todo:
            node, own, expected = todo.pop()
            if expected <= leaf_rows or not len(own):
                continue
            tried = np.random.default_rng([self.number, node]).choice(DIRECTIONS, TRIED, replace=False)
            best = None
            for way in tried.tolist():
                x = np.sort(side[own, way])
                places = np.quantile(x, _PLACES)
                both = (np.searchsorted(x, places + self.spill, "right") - np.searchsorted(x, places - self.spill)) / len(x)
                k = int(np.lexsort((np.abs(_PLACES - 0.5), both))[0])
                if best is None or both[k] < best[0]:
                    best = (float(both[k]), way, float(places[k]))
            if best[0] > MOST_BOTH:
                continue
            self.splits[node] = (*best[1:], nodes, nodes + 1)
            x = side[own, best[1]] - best[2]
            for child, part in ((nodes, own[x <= self.spill]), (nodes + 1, own[x >= -self.spill])):
                todo.append((child, part if len(part) >= FEW else own, expected * max(len(part), 1) / len(own)))
            nodes += 2
        return self

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs."""
        side = x @ directions(self.number, self.width)
        todo, rows, nodes = [(0, np.arange(len(x)))], [], []
        while todo:
            node, own = todo.pop()
            if node not in self.splits:
                rows.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                continue
            way, place, below, above = self.splits[node]
            at = side[own, way] - place
            todo += [(child, part) for child, part in ((below, own[at <= self.spill]), (above, own[at >= -self.spill])) if len(part)]
        return np.concatenate(rows), np.concatenate(nodes)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _router(trees: dict[int, list[Tree]]):
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby("width"):
                x = _unit(rows["embedding"])
                own, leaf = (np.concatenate(a) for a in zip(*((r, (t << 40) | n) for t, tree in enumerate(trees[width]) for r, n in [tree.leaves(x)])))
                order = np.lexsort((leaf, own))
                own, leaf = own[order], leaf[order]
                lists = np.split(leaf, np.flatnonzero(np.diff(own)) + 1)
                yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "width": width, "n": rows["n"], "embedding": rows["embedding"], "leaves": lists})

    return route


def _compare(rows: pd.DataFrame, other: pd.DataFrame | None, leaf: int, threshold: float) -> pd.DataFrame:
    """Links between rows, or between rows and other, whose first common leaf this is: (id, n links, root)."""
    both = rows if other is None else pd.concat([rows, other], ignore_index=True)
    x, n, ids = _unit(both["embedding"]), both["n"].to_numpy(np.int64), both["id"].to_numpy(np.int64)
    earlier = [np.asarray(a)[np.asarray(a) < leaf] for a in both["leaves"]]
    begin, held = np.cumsum([0, *map(len, earlier)]), np.concatenate(earlier)
    counts, forest, step = np.zeros(len(both), np.int64), common.Forest(len(both)), 512

    def member(a: int, b: int, names: np.ndarray) -> np.ndarray:
        """Which of rows a to b are in which of these leaves."""
        out, own = np.zeros((b - a, len(names)), np.float32), held[begin[a] : begin[b]]
        if len(names) and len(own):
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            hit = names[at] == own
            out[np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))[hit], at[hit]] = 1
        return out

    for i in range(0, len(rows), step):
        to = min(i + step, len(rows))
        names = np.unique(held[begin[i] : begin[to]])
        own = member(i, to, names)
        # Each pair once: later rows of the same part, or all of the other.
        for j in range(i if other is None else len(rows), len(both), step):
            linked = (x[i:to] @ x[j : j + step].T >= threshold) & (own @ member(j, min(j + step, len(both)), names).T == 0)
            if i == j and other is None:
                linked = np.triu(linked, 1)
            counts[i:to] += linked @ n[j : j + step]
            counts[j : j + step] += n[i:to] @ linked
            # Joins each row with the first linked one of another component, until none is left.
            while True:
                roots = forest.roots()
                apart = linked & (roots[i:to, None] != roots[None, j : j + step])
                a = np.flatnonzero(apart.any(axis=1))
                if not len(a):
                    break
                forest.join(np.stack([a + i, apart[a].argmax(axis=1) + j], 1))
    roots = forest.roots()
    some = (counts > 0) | (roots != np.arange(len(both)))
    return pd.DataFrame({"id": ids[some], "links": counts[some], "root": ids[roots[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf_rows: int = LEAF, leaf_most: int = LEAF_MOST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    plain = common.pick(vectors, "vec_id", "embedding", "label").withColumn("label", F.col("label").cast("string"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False)
    )
    good = plain.where(fit)
    of = ["label", "embedding"]
    counted = F.lit(0).cast("bigint")
    with common.scope() as kept:
        classes = good.groupBy(*of).agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("width", F.size("embedding"))
        classes = common.materialize(classes, "vectors")
        sizes = classes.groupBy("width", "label").agg(F.count("*").alias("c")).groupBy("width").agg(F.max("c")).collect()
        if sizes:
            forests = {}
            for width, most in sizes:
                sample = classes.where(F.col("width") == width).orderBy(F.xxhash64("embedding"), "id").limit(SAMPLE).select("embedding").toPandas()
                spill = SPILL * (2 - 2 * threshold) ** 0.5 / width**0.5
                unit = _unit(sample["embedding"])
                forests[width] = [Tree(k, width, spill).fit(unit, most, leaf_rows) for k in range(trees)]
            routed = classes.select("id", "label", "width", "n", "embedding").mapInPandas(
                _router(forests), f"id bigint, label string, width int, n bigint, embedding {classes.schema['embedding'].dataType.simpleString()}, leaves array<bigint>"
            )
            routed = common.materialize(routed, "routed")
            at = ["label", "width", "leaf"]
            crowds = routed.select("label", "width", F.explode("leaves").alias("leaf")).groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
            crowds = common.materialize(crowds.withColumn("parts", F.ceil(F.col("n") / leaf_most).cast("int")), "leaves")
            part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0).cast("int")
            placed = common.join_counted(routed.withColumn("leaf", F.explode("leaves")), crowds, at).withColumn("part", part)
            # A part meets itself and every other part once.
            meets = F.expr("explode(transform(sequence(0, parts - 1), p -> struct(least(p, part) as a, greatest(p, part) as b)))")
            dealt = placed.withColumn("m", meets).select("label", "width", "leaf", "m.a", "m.b", "part", "id", "n", "embedding", "leaves")

            def compare(rows: pd.DataFrame) -> pd.DataFrame:
                leaf, a, b = (int(rows[x].iloc[0]) for x in ("leaf", "a", "b"))
                rows = rows.sort_values("id")
                if a == b:
                    return _compare(rows.reset_index(drop=True), None, leaf, threshold)
                return _compare(rows[rows["part"] == a].reset_index(drop=True), rows[rows["part"] == b], leaf, threshold)

            found = common.materialize(dealt.groupBy("label", "width", "leaf", "a", "b").applyInPandas(compare, "id bigint, links bigint, root bigint"), "links")
            links = found.groupBy("id").agg(F.sum("links").alias("links"))
            joined = common.components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
            known = classes.join(links, "id", "left").join(joined, "id", "left")
            known = known.select(*of, "n", (F.col("n") - 1 + F.coalesce("links", counted)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            known = common.materialize(known, "known")
            kept.append(known)
            linked = common.join_counted(good, known, of)
        else:
            linked = good.withColumn("n_links", counted).withColumn("component_id", F.col("vec_id"))
    alone = plain.where(~fit).withColumn("n_links", counted).withColumn("component_id", F.col("vec_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
