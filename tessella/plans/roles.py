"""What the columns of a table are for, from their profile and their names.

One aggregate over the table profiles all columns. Names that form a grid (Male count, Male
pct, Female count, Female pct) are values of a variable crossed with measures: a grid counts
only if the columns of a measure are alike, in being whole numbers and in size. Which of the
two sides is the measure is told by that likeness as well, and by words for measures only
where it leaves both open. Columns whose names are values of another column are values of a
variable, too.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import profile as P
from ..operators.tidy import ROW

_WORD = re.compile(r"[^\W_]+|%", re.UNICODE)
#: Words for what is measured, and for statistics that belong side by side.
MEASURES = frozenset("count counts number no n cases pct percent percentage % share rate ratio proportion amount value values total sum score index population".split())
STATISTICS = frozenset("min max minimum maximum mean avg average median std stdev sd var variance low high start end first last lower upper open close from to begin before after actual target".split())
_ID = re.compile(r"(?:^|[\s_\-])(?i:id|key|code|nr|uuid|index)$|[a-z](?:ID|Id|Key|Code)$")
#: Columns of one measure alone must be so many to be values of a variable.
ALONE = 3
#: Part of a grid's places that must have a column; factor within which means are of one size.
FILLED, SIZE = 0.75, 20.0


@dataclass
class Column:
    """The profile of a column."""

    name: str
    numbers: int
    texts: int
    whole: bool
    low: float | None
    high: float | None
    mean: float | None
    distinct: int

    @property
    def numeric(self) -> bool:
        return self.numbers > 0 and not self.texts

    def like(self, other: Column) -> float:
        """0 to 1: how much two columns of numbers look like one measure."""
        if self.whole != other.whole or self.mean is None or other.mean is None:
            return 0.0
        span = max(self.high, other.high) - min(self.low, other.low)
        shared = min(self.high, other.high) - max(self.low, other.low)
        overlap = 1.0 if span == 0 else max(0.0, shared) / span
        a, b = abs(self.mean), abs(other.mean)
        size = 1.0 if a == b else 0.0 if min(a, b) == 0 else max(0.0, 1 - abs(math.log(a / b)) / math.log(SIZE))
        return max(overlap, size) if (self.low < 0) == (other.low < 0) or overlap else 0.0

    def scores(self, rows: int) -> dict[str, float]:
        """How well each role fits: identifier, measure, dimension; the best one sums up the evidence."""
        n = self.numbers + self.texts
        unique = self.distinct / n if n else 0.0
        named = bool(_ID.search(self.name.strip()))
        if not self.numeric:
            return {"identifier": 0.9 * unique if named else 0.0, "measure": 0.0, "dimension": 1.0}
        key = (0.5 * named + 0.5 * (unique >= 0.95)) if self.whole else 0.0
        few = self.whole and self.distinct <= max(2, 0.02 * rows)
        return {"identifier": key, "measure": 0.6 - 0.3 * few, "dimension": 0.5 if few else 0.0}

    def role(self, rows: int) -> str:
        own = self.scores(rows)
        return max(own, key=own.__getitem__)


def profile(table: DataFrame) -> tuple[int, list[Column]]:
    """The number of rows, and every column's profile; one aggregate."""
    names = [c for c in table.columns if c != ROW]
    out = []
    for c in names:
        text = C.strip(F.col(f"`{c}`").cast("string"))
        number = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "").try_cast("double")
        said = ~(text.isNull() | F.lower(text).isin([*P.NA_WORDS, "", "-", "–", "—"]))
        out += [F.count(number), F.count_if(number.isNull() & said), F.count_if(number != F.floor(number)), F.min(number), F.max(number), F.avg(number), F.approx_count_distinct(text, 0.02)]
    n, *found = table.agg(F.count("*"), *out).first()
    return n, [Column(c, *found[7 * i : 7 * i + 2], not found[7 * i + 2], *found[7 * i + 3 : 7 * i + 7]) for i, c in enumerate(names)]


def splits(name: str) -> list[tuple[str, str]]:
    """The name as two parts at every border of words; with a part missing as well."""
    words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))
    return [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]


def _alike(columns: list[Column]) -> float:
    return min((a.like(b) for a, b in combinations(columns, 2)), default=1.0)


def grid(columns: list[Column]) -> dict[str, dict[str, str]]:
    """The best grid of names as measure -> {value: column}; empty if there is none.

    A grid is a set of values by a set of measures that has FILLED of its places.
    The larger grid wins, then the one whose measures are more alike in themselves,
    then the one whose measures are words for such, then the one that names values first.
    """
    best: tuple | None = None
    for first in (True, False):
        sides: dict[str, dict[str, Column]] = {}
        for c in columns:
            for a, b in splits(c.name):
                value, measure = (a, b) if first else (b, a)
                sides.setdefault(measure, {}).setdefault(value, c)
        full = {m: frozenset(v) for m, v in sides.items() if len(v) > 1}
        for values in set(full.values()):
            found = {m: {v: sides[m][v] for v in values if v in sides[m]} for m in sides}
            found = {m: own for m, own in found.items() if len(own) >= FILLED * len(values) and len(own) > 1}
            if len({c.name for own in found.values() for c in own.values()}) < sum(map(len, found.values())):
                found = {m: own for m, own in found.items() if m in full and full[m] == values}  # one column, two places
            taken = [c.name for own in found.values() for c in own.values()]
            if len(set(taken)) < len(taken) or not found:
                continue
            alike = min(_alike(list(own.values())) for own in found.values())
            words = {v.lower() for v in values}
            if alike == 0.0 or words <= STATISTICS or all(v.lower() in MEASURES for v in values):
                continue
            if len(found) == 1 and (len(values) < ALONE or alike < 0.3):
                continue
            named = sum(m.lower().split()[-1] in MEASURES or m.lower().split()[0] in MEASURES for m in found) / len(found)
            rank = (len(taken), named, alike, first)
            if best is None or rank > best[0]:
                best = (rank, {m: {v: c.name for v, c in own.items()} for m, own in found.items()})
    return best[1] if best else {}


def names_as_values(table: DataFrame, columns: list[Column], texts: list[str]) -> dict[str, str]:
    """Columns of numbers, alike, whose names are values of one of the columns of texts: {value: column}."""
    names = {c.name.strip(): c for c in columns}
    if len(names) < 2 or not texts:
        return {}
    # Each set holds these names at most.
    held = [F.collect_set(F.when(C.strip(F.col(f"`{t}`").cast("string")).isin(*names), C.strip(F.col(f"`{t}`").cast("string")))) for t in texts]
    for found in table.agg(*held).first():
        own = [names[v] for v in sorted(found)]
        if len(own) > 1 and _alike(own) > 0:
            order = [c.name for c in columns]
            return {c.name.strip(): c.name for c in sorted(own, key=lambda c: order.index(c.name))}
    return {}


def value_groups(table: DataFrame, leave: list[str]) -> dict[str, dict[str, str]]:
    """Columns that are values of a variable: measure -> {value: column}, from names and profile; leave: columns with a role already."""
    rows, found = profile(table)
    free = [c for c in found if c.name not in leave]
    measures = [c for c in free if c.numeric and c.role(rows) != "identifier"]
    if own := grid(measures):
        order = {c.name: i for i, c in enumerate(found)}
        at = lambda columns: min(order[c] for c in columns.values())
        return {m: dict(sorted(own[m].items(), key=lambda x: order[x[1]])) for m in sorted(own, key=lambda m: at(own[m]))}
    if own := names_as_values(table, measures, [c.name for c in free if not c.numeric]):
        return {"value": own}
    return {}
