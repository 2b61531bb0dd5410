"""Rectangles of cells: greedy cover, largest rectangles, A1 texts. Arrow-batched."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST_SIDE = 20


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def number(text: str) -> int:
    n = 0
    for c in text.upper():
        n = 26 * n + ord(c) - 64
    return n


def a1(r0: int, c0: int, r1: int, c1: int) -> str:
    first = f"{letters(c0)}{r0}"
    return first if (r0, c0) == (r1, c1) else f"{first}:{letters(c1)}{r1}"


def cover(cells: Iterable[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Disjoint rectangles that cover the cells exactly.

    From the first free cell in row order, as wide as possible, then as tall as
    the whole width stays free.
    """
    order = sorted(set(cells))
    free = set(order)
    out = []
    for r, c in order:
        if (r, c) not in free:
            continue
        right = c
        while (r, right + 1) in free:
            right += 1
        wide = range(c, right + 1)
        bottom = r
        while all((bottom + 1, x) in free for x in wide):
            bottom += 1
        free.difference_update((y, x) for y in range(r, bottom + 1) for x in wide)
        out.append((r, c, bottom, right))
    return out


def largest_rectangles(cells: list[tuple[int, int]], max_row: int, max_col: int, side: int = LARGEST_SIDE) -> list[tuple[int, int, int, int]]:
    """For each cell in the given order that isn't taken yet, the largest rectangle of free cells that begins there.

    At most side cells each way. Of equal areas the narrower one is taken: for
    each width the height is what the shortest column so far allows.
    """
    free = set(cells)
    out = []
    for r, c in cells:
        if (r, c) not in free:
            continue
        best, tall = (1, 1, 1), min(side, max_row - r + 1)
        for width in range(1, min(side, max_col - c + 1) + 1):
            height = 0
            while height < tall and (r + height, c + width - 1) in free:
                height += 1
            tall = height
            if not tall:
                break
            if width * tall > best[0]:
                best = (width * tall, width, tall)
        _, width, tall = best
        free.difference_update((y, x) for y in range(r, r + tall) for x in range(c, c + width))
        free.discard((r, c))
        out.append((r, c, r + tall - 1, c + width - 1))
    return out


def swept_rectangles(rows: Iterable[tuple[tuple, int, list[int], list[int]]], side: int = LARGEST_SIDE) -> Iterator[tuple]:
    """What largest_rectangles() finds where cells are ordered by a rank, then by row and column: (key, rank, r0, c0, r1, c1).

    rows: (key, row, its columns in order, their ranks), the rows of a key one after the other
    and without gaps; a gap begins anew. Only rows less than side away can take part in a
    cell's rectangle, so a cell is settled once those of smaller order within this reach are.
    Held are side rows ahead for each rank that mixes with others, never all cells.
    """
    for _, block in groupby(_blocks(rows), itemgetter(0)):
        yield from _settled(block, side)


def _blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
    now, last, n = None, 0, 0
    for key, row, cols, ranks in rows:
        if key != now or row != last + 1:
            n += 1
        now, last = key, row
        yield n, key, row, cols, ranks


def _settled(block: Iterator[tuple], side: int) -> Iterator[tuple]:
    free: dict[int, set[int]] = {}
    waiting: dict[int, dict[int, list[int]]] = {}
    last = top = None
    key, more = None, True

    def load(to: int) -> None:
        nonlocal key, last, top, more
        while more and (last is None or last < to):
            if (x := next(block, None)) is None:
                more = False
                return
            _, key, last, cols, ranks = x
            top = last if top is None else top
            free[last] = set(cols)
            of: dict[int, list[int]] = {}
            for c, k in zip(cols, ranks):
                of.setdefault(k, []).append(c)
            waiting[last] = dict(sorted(of.items()))

    def before(rank: int, row: int) -> tuple[int, int] | None:
        for r in range(max(top, row - side + 1), min(last, row + side - 1) + 1):
            for k in waiting[r]:  # the smallest
                if (k, r) < (rank, row):
                    return k, r
                break
        return None

    def take(rank: int, row: int) -> Iterator[tuple]:
        for c in waiting[row].pop(rank):
            if c not in free[row]:
                continue
            best, most, tall = (1, 1), 1, side
            for width in range(1, side + 1):
                x, height = c + width - 1, 0
                while height < tall and x in free.get(row + height, ()):
                    height += 1
                tall = height
                if not tall:
                    break
                if width * tall > most:
                    most, best = width * tall, (width, tall)
            width, tall = best
            for r in range(row, row + tall):
                free[r].difference_update(range(c, c + width))
            yield key, rank, row, c, row + tall - 1, c + width - 1

    load(0)
    while top is not None and (more or top <= last):
        load(top)
        if top > last:
            return
        while waiting[top]:
            stack = [(next(iter(waiting[top])), top)]
            while stack:
                load(stack[-1][1] + side - 1)
                if (first := before(*stack[-1])) is not None:
                    stack.append(first)
                else:
                    yield from take(*stack.pop())
        del free[top], waiting[top]
        top += 1


def merge_refs(cells: Column, merged: Column | None = None) -> Column:
    """array<struct<row,col>> -> array of A1 ranges; ranges in merged come first as they are."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[a1(*x) for x in cover((p["row"], p["col"]) for p in cells)] for cells in batch], dtype=object)

    found = run(cells)
    return found if merged is None else F.concat(F.coalesce(merged, F.array().cast("array<string>")), found)
