"""URL filters: pattern rules under their rarest literal token.

A pattern rule is a regular expression over the URL with A-Z in lower case. The
literal tokens (runs of [a-z0-9]) that any URL which it fits must have whole are
read from the expression, behind optional groups too; of alternatives one must be
there. Their frequency is counted over all URLs, and the rule is filed under the
rarest: under one token, or under each of a set of alternatives that are rarer
together. Each URL looks up its own tokens, and only the rules found so run. A rule
without a literal token runs on every URL; of PATTERN_RULES none does. Host rules
come first: a rule fits its host and all subdomains if the path starts with its
path; the longest decides. Else a pattern rule decides, allow before block, and
without any the URL is allowed.

The rules are parameters with a checked limit (MOST_RULES), so that each task
can hold the index.

Defined results: a null URL, or one without ://, has an empty host and path, fits
no host rule, and is judged by the pattern rules as it stands. URLs of any length
are judged whole. Of host rules that fit the longest decides, of equally long ones
block; of pattern rules allow before block, then the first of the list. Rows are
judged one by one; repeated rows get equal results. Of columns only page_id and url
count, by their exact names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_RULES = 100_000
#: Alternative tokens that a rule is filed under at most; one with more needs another token.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str


#: The host rules of the contract.
HOST_RULES = [
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
]
PATTERN_RULES = [
    PatternRule("block", r"://(?:[^/]*[.-])?ads[.-]"),
    PatternRule("block", r"://(?:[^/]*\.)?tracker\."),
    PatternRule("block", r"[/.-]casino[/.-]"),
    PatternRule("block", r"[?&]sessionid="),
    PatternRule("block", r"/cgi-bin/"),
    PatternRule("block", r"/wp-login\.php\b"),
    PatternRule("block", r"\.(?:exe|zip|apk|dmg)(?:[?#]|$)"),
    PatternRule("block", r"[?&]utm_campaign=spam\b"),
    PatternRule("allow", r"/robots\.txt$"),
]

_TOKEN = re.compile(r"[a-z0-9]+")
_ALNUM = set(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"))


def _is_edge(op, argument, first: bool) -> bool:  # noqa: ANN001
    """This part takes no letter or digit at its first (or last) place, so that a token ends beside it."""
    if op is sre.AT:
        return argument in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING, sre.AT_BOUNDARY)
    if op is sre.LITERAL:
        # What is a letter to \b but no letter of a token, "_" for one, is an end as well.
        return argument not in _ALNUM
    if op is sre.IN:
        return bool(argument) and all(kind is sre.LITERAL and x not in _ALNUM for kind, x in argument)
    if op is sre.SUBPATTERN:
        return _ends(list(argument[3]), first)
    if op is sre.BRANCH:
        return all(_ends(list(part), first) for part in argument[1])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        return argument[0] > 0 and _ends(list(argument[2]), first)
    return False


def _ends(parts: list, first: bool) -> bool:
    """Whether a sequence of parts takes no letter or digit at its first (or last) place; optional ones are looked through."""
    for op, argument in parts if first else reversed(parts):
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and argument[0] == 0:
            if not _ends(list(argument[2]), first):
                return False
            continue
        return _is_edge(op, argument, first)
    return False


def _literals(op, argument) -> list[str] | None:  # noqa: ANN001
    """The strings of letters and digits that a part stands for, one or alternatives; else None."""
    if op is sre.LITERAL:
        return [chr(argument)] if argument in _ALNUM else None
    if op is sre.IN:
        return [chr(x) for _, x in argument] if all(kind is sre.LITERAL and x in _ALNUM for kind, x in argument) else None
    if op is sre.SUBPATTERN:
        return _sequence(list(argument[3]))
    if op is sre.BRANCH:
        each = [_sequence(list(part)) for part in argument[1]]
        return None if any(x is None for x in each) else [w for x in each for w in x]
    return None


def _sequence(parts: list) -> list[str] | None:
    """The strings that parts in a row stand for; None if one of them stands for others, or there are too many."""
    words = [""]
    for op, argument in parts:
        each = _literals(op, argument)
        if each is None or len(words) * len(each) > MOST_ALTERNATIVES:
            return None
        words = [a + b for a in words for b in each]
    return words if all(words) else None


def literal_tokens(pattern: str) -> list[list[str]]:
    """Sets of tokens, of each of which any URL that the expression fits has one whole."""
    parts = list(parser.parse(pattern))
    found, at = [], 0
    while at < len(parts):
        to = at
        while to < len(parts) and _literals(*parts[to]) is not None:
            to += 1
        words = _sequence(parts[at:to]) if to > at else None
        # \b between a token and "_" would not be a boundary, but then the expression doesn't fit at all.
        if words and _ends(parts[:at], False) and _ends(parts[to:], True):
            found.append(sorted(set(words)))
        at = max(to, at + 1)
    return found


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many places each of these tokens stands, over all URLs."""
    if not tokens:
        return {}
    token = F.explode(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = urls.select(token.alias("t")).where(F.col("t").isin(*tokens)).groupBy("t").count().collect()
    return dict.fromkeys(tokens, 0) | {r[0]: r[1] for r in rows}


def index(rules: list[PatternRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of rules by their rarest tokens, and of those without one."""
    by_token: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        sets = literal_tokens(rule.pattern)
        if sets:
            for token in min(sets, key=lambda words: (sum(counts.get(w, 0) for w in words), words)):
                by_token.setdefault(token, []).append(i)
        else:
            always.append(i)
    return by_token, always


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge(
    pages: DataFrame, host_rules: list[HostRule] = HOST_RULES, pattern_rules: list[PatternRule] = PATTERN_RULES
) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (of the pattern rule that decided) of every row."""
    if len(host_rules) + len(pattern_rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    plain = common.pick(pages, "page_id", "url")
    counts = token_counts(plain, sorted({t for r in pattern_rules for words in literal_tokens(r.pattern) for t in words}))
    by_token, always = index(pattern_rules, counts)
    # Of rules that fit, the longest decides; of equally long ones block, then the first by text.
    by_host: dict[str, list[HostRule]] = {}
    for rule in sorted(host_rules, key=lambda r: (-len(r.text), r.verdict == "allow", r.text)):
        by_host.setdefault(rule.host, []).append(rule)

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        compiled: dict[int, re.Pattern] = {}

        def fits(i: int, url: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(pattern_rules[i].pattern)
            return compiled[i].search(url) is not None

        rows = []
        for url in urls:
            host, path = split_url(url)
            best = None
            labels = host.split(".")
            for k in range(len(labels)):
                for rule in by_host.get(".".join(labels[k:]), ()):
                    if path.startswith(rule.path):
                        if best is None or (len(rule.text), rule.verdict == "block") > (len(best.text), best.verdict == "block"):
                            best = rule
                        break
            decided = None
            if best is None and url:
                low = url.translate(_LOWER)
                candidates = {i for t in set(_TOKEN.findall(low)) for i in by_token.get(t, ())}.union(always)
                hits = [i for i in sorted(candidates) if fits(i, low)]
                decided = min(hits, key=lambda i: (pattern_rules[i].verdict != "allow", i), default=None)
            verdict = best.verdict if best else pattern_rules[decided].verdict if decided is not None else "allow"
            rows.append((host, path, best and best.text, verdict, None if decided is None else pattern_rules[decided].pattern))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "pattern"])

    return plain.select("page_id", verdicts("url").alias("_v")).select("page_id", "_v.*")
