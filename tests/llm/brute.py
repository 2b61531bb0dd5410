"""Plain single-process versions of the contracts, written apart from the operators."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import xxhash

from tessella.llm import quality_rules, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen: dict = {}
    for i in range(n - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 10 or 100 * len(again) > 20 * n


def groups(ids: list, linked: list[tuple]) -> dict:
    """Smallest id that links reach, for each id."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def embeddings(rows: list[tuple], threshold: float = 0.93) -> dict:
    """rows: (vec_id, vector or None, label). vec_id -> (n_links, component_id)."""
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((i, j))
    comp = groups([r[0] for r in rows], links)
    count: dict = {}
    for pair in links:
        for i in pair:
            count[i] = count.get(i, 0) + 1
    return {i: (count.get(i, 0), comp[i]) for i in comp}


HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url(u: str | None) -> tuple:
    """host, path, rule and its verdict."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def secrets(text: str | None) -> tuple:
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(s[1] == k for s in spans) for k in range(3)) + (sha(joined), joined)


def substring(docs: list[tuple], window: int = 50) -> list[tuple]:
    """docs: (doc_id, text). (doc_id, n_words, n_removed, kept_sha256) of each."""
    words = [WORD.findall(t or "") for _, t in docs]
    order = [2**63 - 1 if i is None else i for i, _ in docs]
    first: dict = {}
    for i, w in zip(order, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), at, w in zip(docs, order, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < at:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs: list[tuple]) -> list[tuple]:
    fps = [(i, fingerprint(t)) for i, t in docs]
    distinct = sorted({f for _, f in fps})
    comp = groups(distinct, [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= 3])
    least: dict = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    return [(i, f"{f:016x}", least.get(comp[f])) for i, f in fps]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def best_fit(lengths: list[int], sizes: tuple, overhead: int) -> tuple:
    """Every open bin is looked at for every item, and the rest of the items summed for every opening."""
    bins: list[list[int]] = []  # size, held
    of, at = [], []
    for i, n in enumerate(lengths):
        fits = [(size - held - n, k) for k, (size, held) in enumerate(bins) if size - held >= n]
        if fits:
            k = min(fits)[1]
        else:
            costs = []
            for size in sizes:
                if size >= n:
                    rest = sum(x for x in lengths[i + 1 :] if x <= size - n)
                    costs.append(((size + overhead) / (n + min(size - n, rest)), size))
            bins.append([min(costs)[1], 0])
            k = len(bins) - 1
        of.append(k)
        at.append(bins[k][1])
        bins[k][1] += n
    return of, at, [min(s for s in sizes if s >= held) for _, held in bins]


def _distance(p: list, q: list) -> float:
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return max(0.0, total) ** 0.5


def _histograms(text: str | None) -> tuple[list, list]:
    text = text or ""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", None, "0123456789", " \t", "\n\r\v\f", ".,;:'\"-()", "!?", "#*$%&|<>"]
    by_class = [0] * 10
    for c in text:
        by_class[2 if ord(c) > 127 else next((k for k, x in enumerate(kinds) if x and c in x), 9)] += 1
    words = WORD.findall(text.lower())
    by_word = [words.count(w) for w in quality_rules.WORDS]
    return by_class, [*by_word, len(words) - sum(by_word)]


def quality_verdicts(docs: list[tuple]) -> dict:
    """docs: (doc_id, text, lang). (doc_id, text, lang) -> kept and both distances."""
    both = [_histograms(t) for _, t, _ in docs]
    add = lambda rows: tuple([sum(x) for x in zip(*part)] for part in zip(*rows))
    own = {lang: add([h for h, d in zip(both, docs) if d[2] == lang]) for lang in {d[2] for d in docs}}
    out = {}
    for (i, text, lang), (by_class, by_word) in zip(docs, both):
        n, chars, *_, failed = quality(text)
        ref = own[lang]
        a, b = _distance(by_class, ref[0]), _distance(by_word, ref[1])
        apart = (chars >= 120 and a > 0.3) or (n >= 60 and b > 0.18 + 1.6 / n**0.5)
        out[i, text, lang] = (not failed and not apart, a, b)
    return out


def classify(docs: list[tuple], sample: int, spark) -> list[tuple]:
    """(doc_id, pattern, posterior, score); only the votes, the hashes and the places of words are the operator's."""
    from pyspark.sql import functions as F

    patterns = [weak_labels.votes(t) for _, t in docs]
    counts: dict = {}
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    names, k = sorted(counts), len(weak_labels.LABELLERS)
    good = {}
    for p in names:
        said = [c for c in p if c != "-"]
        good[p] = 0.5 * said.count("1") / max(1, len(said)) if "0" in p else 0.95
    for _ in range(60):
        total = sum(counts.values())
        prior = min(0.98, max(0.02, sum(counts[p] * good[p] for p in names) / total))
        new = {}
        said = {}
        for j in range(k):
            for of_good in (True, False):
                weight = lambda c: 1 + sum(counts[p] * (good[p] if of_good else 1 - good[p]) for p in names if p[j] == c)  # noqa: B023, E731
                one, nought = weight("1"), weight("0")
                said[j, of_good] = {"1": one / (one + nought), "0": nought / (one + nought), "-": 1.0}
        for p in names:
            a, b = math.log(prior), math.log(1 - prior)
            for j, c in enumerate(p):
                a, b = a + math.log(said[j, True][c]), b + math.log(said[j, False][c])
            new[p] = 1 / (1 + math.exp(max(-50, min(50, b - a))))
        good = new
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(docs)], "n long, doc_id long, text string")
    key = {r["n"]: r["k"] for r in df.select("n", F.xxhash64(F.lit(11), "doc_id", "text").alias("k")).collect()}
    order = sorted(range(len(docs)), key=lambda n: (key[n] % (1 << 30), key[n]))[:sample]
    size = weak_labels.DIMENSIONS

    def features(text: str | None) -> dict:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        out: dict = {}
        for w in words:
            for place in weak_labels._places(w):
                out[place] = out.get(place, 0) + 1 / len(words)
        return out

    rows = [(features(docs[n][1]), good[patterns[n]]) for n in order]
    high = sum(y > 0.5 for _, y in rows) / len(rows)
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, 151):
        g = np.zeros(size + 1)
        for x, y in rows:
            z = w[-1] + sum(v * w[at] for at, v in x.items())
            error = (0.5 / max(1e-9, high if y > 0.5 else 1 - high)) * (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) / len(rows)
            for at, v in x.items():
                g[at] += v * error
            g[-1] += error
        g[:-1] += 1e-6 * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    out = []
    for (i, t), p in zip(docs, patterns):
        x = features(t)
        out.append((i, p, good[p], 1 / (1 + math.exp(-max(-30, min(30, w[-1] + sum(v * w[at] for at, v in x.items()))))) if x else 0.0))
    return out


def _ranked(rows: list[tuple], top: int) -> list[tuple]:
    """rows: (sort key, row). (row, rank) of the first."""
    return [(row, k + 1) for k, (_, row) in enumerate(sorted(rows, key=lambda x: x[0])[:top])]


def collocations(docs: list[tuple], longest: int, least: int, top: int) -> list[tuple]:
    """docs: (text, lang). (lang, rank, phrase, a, l, r, n, score)."""
    f: dict = {}
    total: dict = {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    p = lang, tuple(words[i : i + k])
                    f[p] = f.get(p, 0) + 1
    good = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer: dict = {}
    for (lang, w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                p = lang, w[i : i + k]
                longer[p] = max(longer.get(p, 0), a)
    by: dict = {}
    for (lang, w), a in good.items():
        if 100 * longer.get((lang, w), 0) >= 50 * a and (lang, w) in longer:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        phrase = " ".join(w)
        by.setdefault(lang, []).append(((-score, -a, phrase.encode()), (phrase, a, f[lang, w[:k]], f[lang, w[k:]], score)))
    return [(lang, rank, p, a, x, y, total[lang], s) for lang, rows in by.items() for (p, a, x, y, s), rank in _ranked(rows, top)]


def divergence(docs: list[tuple], least: int, smoothing: int, top: int) -> list[tuple]:
    """docs: (text, lang, source). (lang, source, part, item, value, rank)."""
    counts: dict = {}
    seen: dict = {}
    groups_of: dict = {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups_of.setdefault(lang, set()).add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for w in words:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
        for w in set(words):
            seen[lang, w] = seen.get((lang, w), 0) + 1
    out = []
    for lang, sources in groups_of.items():
        terms = [w for (g, w), n in seen.items() if g == lang and n >= least]
        own = {s: [counts.get((lang, s, w), 0) for w in terms] for s in sources}
        share = lambda c: [1 + 1_000_000_000 * (x + smoothing) // (sum(c) + smoothing * len(terms)) for x in c]  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share([sum(x) for x in zip(*own.values())])
        for s in sources:
            pairs = [((-v, t.encode()), (t, v)) for t in sources - {s} for v in [sum(abs(a - b) for a, b in zip(p[s], p[t]))]]
            best = [((-v, w.encode()), (w, v)) for w, n, a, b in zip(terms, own[s], p[s], q) for v in [a - b] if n and v > 0]
            out += [(lang, s, "pair", *row, k) for row, k in _ranked(pairs, len(pairs))] + [(lang, s, "term", *row, k) for row, k in _ranked(best, top)]
    return out
