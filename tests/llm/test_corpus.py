"""Phrase collocations and the source divergence audit."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tessella.llm import collocations, source_divergence

from . import brute

NAMES = "TEXT string, text string, lang string, source string, score int, rank string"


def frame(spark, rows):
    """rows: (text, lang, source), with columns whose names clash with results."""
    return spark.createDataFrame([("a b a b a b", *r, 1, "x") for r in rows], NAMES)


def prose(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = "the of and to in x Ärger é類 \x00 a'b tion\x1c".split(" ")
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ; "]) for _ in range(k))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"]), rng.choice(["s0", "s1", None, "", "é"])) for _ in range(n)]
    rows += [rows[0]] * 5 + [(None, "en", "s9"), ("", "fr", "s0"), (None, "fr", "s1"), ("   ...", "fr", None), ("word " * 3000 + "end", "en", "s1"), ("x" * 20_000, "en", "s2")]
    return rows


@pytest.mark.parametrize(("shard", "ranked", "least", "longest"), [(2**23, 10**6, 10, 3), (200, 7, 3, 4), (1, 10**6, 40, 2)])
def test_collocations_against_brute_force(spark, monkeypatch, shard, ranked, least, longest):
    monkeypatch.setattr(collocations, "RANKED", ranked)
    monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (longest, least, shard))
    rows = prose(1, 700)
    found = collocations.collocations(frame(spark, rows).repartition(3), max_words=longest, min_count=least, top=15).collect()
    want = brute.collocations([r[:2] for r in rows], longest, least, 15)
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 15


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(None, None, None), ("", "en", "s"), ("a b", "en", "s")])).collect() == []
    with pytest.raises(ValueError, match="min_words"):
        collocations.collocations(frame(spark, [("a", "en", "s")]), min_words=1)


def test_suffix_order():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 5, 300)
    for depth in (1, 2, 3, 5, 8):
        order = collocations.suffix_order(ids, depth)
        suffixes = [tuple(ids[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(300)) and suffixes == sorted(suffixes)
        shared = [0] + [next((k for k in range(depth) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), depth) for a, b in zip(suffixes, suffixes[1:])]
        got = collocations.shared_words(ids, order, depth)
        assert got.tolist() == shared


def test_bitmap_names_every_phrase(spark):
    rows = [(lang, f"w{i} v{i % 7}") for i in range(500) for lang in ("en", "de")]
    bits = np.frombuffer(collocations.bitmap_of(spark, spark.createDataFrame(rows, "lang string, phrase string")).value, np.uint8)
    at = [collocations.phrase_hash(lang, p.encode().split()) & (len(bits) * 8 - 1) for lang, p in rows]
    assert all(bits[x >> 3] >> (x & 7) & 1 for x in at) and int(np.unpackbits(bits).sum()) == len(set(at))


@pytest.mark.parametrize(("entries", "block", "chunk"), [(400_000, 512, 2**23), (3, 2, 50)])
def test_audit_against_brute_force(spark, monkeypatch, entries, block, chunk):
    monkeypatch.setattr(source_divergence, "CHUNK_BYTES", chunk)
    rows = prose(2, 150)
    found = source_divergence.audit(frame(spark, rows).repartition(3), min_docs=12, top_terms=4, shard_entries=entries, block=block).collect()
    want = brute.divergence(rows, 12, 5, 4)
    assert sorted(map(tuple, found)) == sorted(want) and {r[2] for r in want} == {"pair", "term"}


def test_audit_of_nothing(spark):
    assert source_divergence.audit(frame(spark, []).limit(0)).collect() == []
    # Groups without terms: pairs of value 0, ranked by their bytes.
    found = source_divergence.audit(frame(spark, [(None, None, "b"), ("x", None, None), ("", None, "é"), ("", "en", "one")])).collect()
    assert sorted(map(tuple, found)) == sorted(brute.divergence([(None, None, "b"), ("x", None, None), ("", None, "é"), ("", "en", "one")], 30, 5, 50))
    assert len(found) == 6


def test_equal_hashes_of_different_bytes():
    """Slices are told apart by their bytes even if a hash has four values."""
    body = b"ab abc ab b abd abc b ba ab"
    data = np.frombuffer(body, np.uint8)
    starts, ends = source_divergence.term_bounds(data, np.array([0, len(body)]))
    for digest in (xxhash.xxh64_intdigest, lambda s: len(s), lambda s: s[0] % 2, lambda s: 7):
        group, names = source_divergence.group_slices(body, starts, ends, digest)
        assert [names[g] for g in group] == body.split() and len(set(group.tolist())) == 5


def test_terms_end_where_texts_end():
    body = "abé".encode() + b"cd" + b"" + b"1x"
    offsets = np.array([0, 4, 6, 6, 8])
    starts, ends = source_divergence.term_bounds(np.frombuffer(body, np.uint8), offsets)
    assert [body[a:b].decode() for a, b in zip(starts, ends)] == ["abé", "cd", "x"]


