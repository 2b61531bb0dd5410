"""Embeddings, URLs, the pipeline and the queries."""

from __future__ import annotations

import math
import pickle
import random

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import common, queries, rp_forest, url_rules

from . import brute


def vectors(seed: int, n: int, width: int = 24) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + 0.28 * rng.standard_normal(width)
        out.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return out


def edge_rows() -> list[tuple]:
    v = [0.1] * 24
    return [
        (1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [math.nan] + v[1:], 0), (1004, [math.inf] + v[1:], 0), (1005, [None] + v[1:], 0),
        (1006, v, None), (1007, v, None), (1008, v, 0), (1009, v, 0), (1010, [2.0] * 24, 0), (1011, [0.1] * 23, 0), (1012, v, 1), (1013, [1e30] * 24, 0), (1014, [1e-30] * 24, 0),
    ]


@pytest.mark.parametrize(("leaf", "most"), [(1024, 4096), (16, 4096), (16, 8)])
def test_forest_against_brute_force(spark, leaf, most):
    data = vectors(1, 400) + edge_rows()
    df = spark.createDataFrame([(i, v, k, "x") for i, v, k in data], "vec_id long, embedding array<float>, label int, n_links string")
    want = brute.embeddings([(i, v if v is None or None in v else np.array(v, np.float32), k) for i, v, k in data])
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rp_forest.near_duplicates(df, leaf_rows=leaf, leaf_most=most).collect()}
    assert found == {i: (n, c, i == c) for i, (n, c) in want.items()} and sum(n for n, _ in want.values()) > 200


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_dense_labels_are_not_copied(share):
    """A label that is, wholly or by half, one tight cluster: few copies of a vector in a tree, and hardly a link lost."""
    rng = np.random.default_rng(3)
    n, width = 6000, 64
    centre, x = rng.standard_normal(width), rng.standard_normal((n, width))
    near = int(n * share)
    x[:near] = centre + 0.27 * rng.standard_normal((near, width))
    x[near:] = np.repeat(x[near:][::3], 3, axis=0)[: n - near] + 0.2 * rng.standard_normal((n - near, width))
    x = x[rng.permutation(n)] / 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spill = rp_forest.SPILL * (2 - 2 * 0.93) ** 0.5 / width**0.5
    found = np.zeros((n, n), bool)
    for k in range(rp_forest.TREES):
        tree = rp_forest.Tree(k, width, spill).fit(x[:2000], n, 200)
        row, leaf = tree.leaves(x)
        assert len(row) < 8 * n and sorted(set(row.tolist())) == list(range(n))
        for one in np.unique(leaf):
            own = row[leaf == one]
            found[np.ix_(own, own)] = True
        assert len(pickle.dumps(tree)) < 100_000
    linked = x @ x.T >= 0.93
    assert linked.sum() > 2 * n and found[linked].mean() > 0.99


def test_forest_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert rp_forest.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = rp_forest.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (1, None, 1)], schema)).collect()
    assert sorted((r["n_links"], r["kept"]) for r in found) == [(0, True), (0, True)]


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/en/12?x#y", "http://a.example.org/es/", "http://example.org/es", "http://notexample.org/es/x", "http://x.com/fr/1", "http://x.com/de/1",
    "ftp://a.net/cgi-bin/x", "http://ads.x.net/a", "http://x-ads-1.net/", "http://x.net/lads/", "http://x.net/a.exe?y", "http://x.net/a.exes", "http://x.net/robots.txt", "http://a://b/c", "http://x.net/wp-login.php",
    "http://x.net/\ncgi-bin/y", "http://X.NET/CASINO/", "://org/", "http://x.net?sessionid=1", "http://" + "a" * 9000 + ".com/de/",
]


def test_urls_against_all_rules(spark):
    import re

    rng = random.Random(3)
    parts = ["ads", "casino", "x", "tracker", "cgi-bin", "sessionid=", "/", ".", "-", "?", "&", "#", "net", "exe", "org", "com", "fr", "de"]
    urls = URLS + ["http://" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    found = {r["page_id"]: r for r in url_rules.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute.url(u)
        if rule is None:
            hits = [p.verdict for p in url_rules.PATTERN_RULES if u and re.search(p.pattern, u.translate(brute.LOWER))]
            verdict = "allow" if "allow" in hits or not hits else "block"
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), u
    assert url_rules.judge(df.limit(0)).count() == 0


def test_literal_tokens():
    want = {
        r"/cgi-bin/": [["cgi"], ["bin"]], r"[?&]sessionid=": [["sessionid"]], r"://(?:[^/]*[.-])?ads[.-]": [["ads"]], r"\.(?:exe|zip)$": [["exe", "zip"]],
        r"\.(?:exe|zip|apk|dmg)(?:[?#]|$)": [["apk", "dmg", "exe", "zip"]], r"/(?:apk|apx)/": [["apk", "apx"]], r"/(?:a|b)/": [["a", "b"]],
        r"/abc+/": [], r"x/abc": [], r"^/ab_cd\b": [["ab"], ["cd"]], r"/(?:x)?ads/": [], r"/ads(?:[.-]x)?/": [["ads"]], r"/ads(?:x)?/": [], r"/(?:exe|\d)/": [], r"/(?:-?)ads/": [["ads"]],
    }
    assert {p: url_rules.literal_tokens(p) for p in want} == want
    index, always = url_rules.index([url_rules.PatternRule("block", p) for p in want], {"cgi": 5, "bin": 2})
    assert index["bin"] == [0] and "cgi" not in index and index["zip"] == [3, 4] and len(always) == 5
    assert url_rules.index(url_rules.PATTERN_RULES, {})[1] == []
    with pytest.raises(ValueError, match="rules"):
        url_rules.judge(None, [], [url_rules.PatternRule("block", "x")] * (url_rules.MOST_RULES + 1))


def test_tokens_never_miss_a_url():
    """Whatever an expression fits has a token that it is filed under."""
    import re

    rng = random.Random(11)
    parts = ["ads", "tracker", "casino", "exe", "zip", "dmg", "x", "/", ".", "-", "_", "?", "&", "=", "#", "sessionid", "cgi", "bin", "wp", "login", "php", "://", "utm", "campaign", "spam", "robots", "txt"]
    sets = {r.pattern: url_rules.literal_tokens(r.pattern) for r in url_rules.PATTERN_RULES}
    hits = 0
    for _ in range(90_000):
        url = "http://" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        tokens = set(url_rules._TOKEN.findall(url))
        for pattern, groups in sets.items():
            if re.search(pattern, url):
                hits += 1
                assert all(tokens & set(words) for words in groups), (pattern, url)
    assert hits > 1000


def _stage_rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=str)


def test_pipeline(spark, docs, docs_rows, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "secret scans", "best-fit packing"]
    at, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == plain.columns
        if name == "substring dedup":
            before = [(r["doc_id"], r["text"]) for r in at.collect()]
            want = {i: n for i, _, n, _ in brute.substring(before)}
            words = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in out.collect()}
            assert all(words[i] == len(brute.WORD.findall(t or "")) - want[i] for i, t in before if i is not None)
        at = common.materialize(out, "stage")
        sizes.append(at.count())
    assert sizes[0] > sizes[1] == sizes[2] == sizes[3]
    assert _stage_rows(corpus_pipeline.run(spark, str(tmp_path))) == _stage_rows(at)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_urls_get_equal_verdicts(spark):
    df = spark.createDataFrame([(1, "http://ads.x.net/a")] * 3 + [(1, None)], "page_id long, url string")
    found = [(r["page_id"], r["host"], r["verdict"]) for r in url_rules.judge(df).collect()]
    assert sorted(found) == [(1, "", "allow")] + [(1, "ads.x.net", "block")] * 3


def test_queries_are_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
