"""Operators on documents against brute force, on rows with nulls, copies, ties, long texts and clashing columns."""

from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, license_scan, packing, quality_rules, secrets, sentencepiece_codec, simhash, substring_dedup, weak_labels

from . import brute

def model_path() -> str:
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def rows(df, *names) -> Counter:
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_quality_counts(docs, docs_rows, empty):
    found = rows(quality_rules.judge(docs).select("doc_id", "quality.*"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == Counter((i, *brute.quality(t)) for i, t, _ in docs_rows)
    assert quality_rules.judge(empty).count() == 0


def test_quality_keep_leaves_columns_alone(docs):
    kept, judged = quality_rules.keep(docs), quality_rules.judge(docs)
    assert kept.columns == docs.columns and judged.columns == [*docs.columns, "quality"]
    assert kept.count() == judged.where("quality.kept").count() > 20
    assert judged.where("quality.kept and quality.base_failed").count() == 0


def test_quality_verdicts_and_distances(docs, docs_rows):
    found = quality_rules.judge(docs).select("doc_id", "text", "lang", "quality.*").collect()
    want = brute.quality_verdicts(docs_rows)
    assert len(found) == len(docs_rows) and 0 < sum(r["kept"] for r in found) < len(found)
    for r in found:
        kept, by_class, by_word = want[r["doc_id"], r["text"], r["lang"]]
        assert r["kept"] == kept and abs(r["class_distance"] - by_class) < 1e-9 and abs(r["common_distance"] - by_word) < 1e-9
    assert any(r["class_distance"] > 0.3 for r in found)


def test_quality_of_a_small_language(spark):
    """A few sound texts of another script beside many in English are kept, and stay so when more of their language arrive; a column may be named quality."""
    rng = random.Random(4)
    greek = lambda: " ".join("".join(rng.choice("αβγδεζηθικλμνο") for _ in range(rng.randint(2, 8))) for _ in range(90))
    english = lambda: " ".join(rng.choice("the of and to in is it that was for with house tree green walked stone".split()) + "abc"[: rng.randint(0, 3)] for _ in range(90))
    few, more, rest = [greek() for _ in range(5)], [greek() for _ in range(120)], [english() for _ in range(60)]
    for own in (few, few + more):
        df = spark.createDataFrame([(t, "el", "q") for t in own] + [(t, "en", "q") for t in rest], "text string, lang string, quality string")
        judged = quality_rules.judge(df)
        assert judged.columns == ["text", "lang", "quality", "quality"]
        kept = quality_rules.keep(df).collect()
        assert len(kept) == len(own) + 60 and {r["text"] for r in kept} >= set(few)


def test_divergence():
    p, q = np.array([1, 2, 3]), np.array([10, 20, 30])
    assert quality_rules.divergence(p, q) < 1e-6
    assert abs(quality_rules.divergence(np.array([1, 0]), np.array([0, 5])) - 1) < 1e-12
    assert quality_rules.divergence(np.array([0, 0]), q[:2]) == 0


def test_secrets(docs, docs_rows, empty):
    found = secrets.digest(docs)
    assert rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter((i, *brute.secrets(t)[:4]) for i, t, _ in docs_rows)
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert any("private_key:0:31" in s and "forge_token" in s and "url_password" in s for s in spans.values())
    assert secrets.digest(empty).count() == 0


def test_secret_ledger_scans_only_what_is_new(spark, docs, docs_rows, tmp_path):
    path = f"file://{tmp_path}/ledger"
    half = docs.where("doc_id % 2 = 0")
    secrets.digest(half, ledger_path=path)
    n = spark.read.parquet(path).count()
    assert n == len({t or "" for i, t, _ in docs_rows if i is not None and i % 2 == 0})
    whole = secrets.digest(docs, ledger_path=path)
    assert rows(whole, "doc_id", "spans") == rows(secrets.digest(docs), "doc_id", "spans")
    assert spark.read.parquet(path).count() == len({t or "" for _, t, _ in docs_rows})
    new = [*secrets.RULES[:-1], secrets.Rule("word", r"tion", 0, 4)]
    again = secrets.digest(docs, new, path)
    assert rows(again, "doc_id", "spans") == rows(secrets.digest(docs, new), "doc_id", "spans")
    ledger = spark.read.parquet(path)
    assert ledger.where("size(scanned) = 1").count() == len({t or "" for _, t, _ in docs_rows}) == ledger.where(F.array_contains("scanned", new[-1].version)).count()


def _all_spans(text: str | None, rules: list) -> str:
    """Every rule's spans of a text by Python's expressions; the rules' Java patterns mean the same there."""
    import re

    spans = set()
    for k, r in enumerate(dict.fromkeys(rules)):
        pattern = r.pattern.replace("(?i:", "(?ia:")
        spans |= {(m.start(), k, m.end(), r.kind) for m in re.finditer(pattern, text or "") if len(m[r.group]) >= r.least}
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_spans_of_all_kinds_and_rule_lists(spark, docs, docs_rows, tmp_path):
    """Reordered, removed and repeated rules, over one ledger, against brute force."""
    jwt = "eyJabcdefgh.eyJijklmnop.qrstuvwx"
    texts = [f"{jwt} xoxb-123456-abcdef gho_{'a1' * 20} -----BEGIN EC PRIVATE KEY-----", f"u://a:bcd@h xoxp-1234567890 {jwt}{jwt}", "gh" * 40 + "ghs_" + "b" * 36, "0123456789abcdef" * 3000 + " token=abcdefghijkl" * 4000, None]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    data = [(i, t) for i, t, _ in docs_rows] + [(900 + i, t) for i, t in enumerate(texts)]
    path = f"file://{tmp_path}/ledger"
    B, M = secrets.BASE, secrets.MORE
    for rules in ([*B, *M], [*B, M[0], M[2], M[1], M[3], M[4]], [*B, *M[1:]], [*B, M[1], M[1], M[0]], [*M, *B]):
        found = rows(secrets.digest(df, rules, path), "doc_id", "spans")
        assert found == Counter((i, _all_spans(t, rules)) for i, t in data), [r.kind for r in rules]
    # All pairs were scanned by the first run; equal rows of two runs at once count once.
    ledger = spark.read.parquet(path)
    n = len({t or "" for _, t in data})
    assert ledger.count() == n and ledger.where(f"size(scanned) = {len(secrets.RULES)}").count() == n
    ledger.write.mode("append").parquet(path)
    assert rows(secrets.digest(df, ledger_path=path), "doc_id", "spans") == Counter((i, _all_spans(t, secrets.RULES)) for i, t in data)


def test_query_of_secrets_goes_through_the_ledger(spark, docs, monkeypatch):
    """What the ledger says is what comes out, and each blob is scanned in one of several appends."""
    calls = []
    real = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs, rules: calls.append(1) or real(blobs, rules).withColumn("spans", F.array().cast(secrets.SPANS)))
    assert {r["spans"] for r in secrets.digest(docs).collect()} == {""} and len(calls) == secrets.SHARDS


def test_secrets_are_redacted(docs, docs_rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.where("doc_id is not null").collect()}
    for i, t, _ in docs_rows:
        if t and t.startswith("password = "):
            assert texts[i][0] == '[secret]" then [secret] [secret]' and texts[i][1] == len(texts[i][0])
    assert texts[0][0] == docs_rows[0][1]


def test_crowded_prefixes(spark):
    """100,000 fingerprints of a few templates, alike in their top bits: dealt to many tasks, joined as brute force joins them."""
    rng = np.random.default_rng(7)
    centres = (np.uint64(0xABCDE) << np.uint64(44)) | rng.integers(0, 1 << 44, 33_000, dtype=np.uint64)
    near = [centres, *(centres ^ (np.uint64(1) << rng.integers(0, 64, len(centres), dtype=np.uint64)) for _ in range(2))]
    near += [near[1] ^ (np.uint64(1) << rng.integers(0, 64, len(centres), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(centres), dtype=np.uint64))]
    x = np.unique(np.concatenate(near))
    path = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    simple, split = (sorted(map(tuple, common.components(simhash.links(path, len(x), crowd)).collect())) for crowd in (10**9, 2_000))
    assert simple == split and len(split) > 90_000
    some = np.sort(x)[:3000]
    apart = np.array([[bin(int(a ^ b)).count("1") <= 3 for b in some[:300]] for a in some])
    root = dict(split)
    for i, j in zip(*np.nonzero(apart)):
        if i != j:
            a, b = (int(v) for v in (some[i].astype(np.int64), some[j].astype(np.int64)))
            assert root[a] == root[b]


def test_sentencepiece(docs, docs_rows, empty):
    import hashlib

    import sentencepiece

    path = model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t, _ in docs_rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(sp.decode(ids))] += 1
    assert rows(sentencepiece_codec.digest(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert sentencepiece_codec.digest(empty, path).count() == 0
    first = sentencepiece_codec.encode(docs.where("doc_id = 1"), path).first()
    assert first["ids"] == sp.encode(docs_rows[1][1], add_bos=True, add_eos=True)


def test_sentencepiece_unspaced_texts():
    """600 unspaced texts of 20,000 characters leave nothing in the table; 400,000 words no more than its bound."""
    rng = random.Random(6)
    codec = sentencepiece_codec.Codec(model_path())
    base = "".join(rng.choice("類別年份有否向警方") for _ in range(20_000))
    for k in range(600):
        codec.count(f"{base[k:]}{base[:k]}") if k % 20 else codec.round_trip(f"{base[k:]}{base[:k]}")
    assert not codec.table and not codec.sizes and codec.held == 0
    for k in range(100):
        codec.round_trip(" ".join(f"word{k}n{i}" for i in range(4000)))
        assert sum(len(a) + sum(map(len, b)) for a, b in codec.table.items()) <= codec.held <= sentencepiece_codec.TABLE_BYTES


def test_sentencepiece_tables(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "TABLE_BYTES", 2000)
    monkeypatch.setattr(sentencepiece_codec, "LONG", 6)
    codec, rng = sentencepiece_codec.Codec(model_path()), random.Random(2)
    assert codec.apart
    for _ in range(3000):
        text = "".join(rng.choice("ab é▁\n\t  $1.\x00\u3000\U0001f600ñthe") for _ in range(rng.randint(0, 25)))
        ids = codec.model.encode(text, add_bos=True, add_eos=True)
        assert codec.count(text) == len(ids)
        assert codec.round_trip(text) == (np.array(ids, "<u4").tobytes(), codec.model.decode(ids))
        assert codec.count(text) == len(ids)
    texts = ["a\nb c\n\nd", "\n", "\na", "a\n", "a \nb", "a\n b", "the\r\nthe end", "\n\n\n the", "ab" * 50 + "\n" + "ab" * 50, " \n", "\n "]
    assert [codec.count(t) for t in texts] == [len(codec.model.encode(t, add_bos=True, add_eos=True)) for t in texts]
    assert isinstance(codec.model, sentencepiece.SentencePieceProcessor)


def test_substring(docs, docs_rows, empty):
    found = rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = Counter((None if i == 2**63 - 1 else i, *x) for i, *x in brute.substring([(i, t) for i, t, _ in docs_rows]))
    assert found == want and sum(1 for x in want if x[2]) > 8
    assert substring_dedup.digest(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_of_loops_and_small_windows(spark, seed):
    rng = random.Random(seed)
    data = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(30)] + [(30, "a " * 100), (31, "a " * 300)]
    found = rows(substring_dedup.digest(spark.createDataFrame(data, "doc_id long, text string"), 8, 3), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == Counter(brute.substring(data, 8))


def test_automata_decide_what_goes(docs, docs_rows, monkeypatch):
    """Without the automata nothing is removed; a shard's automaton finds what the whole corpus repeats."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 900)
    want = Counter((None if i == 2**63 - 1 else i, n) for i, _, n, _ in brute.substring([(i, t) for i, t, _ in docs_rows]))
    assert rows(substring_dedup.digest(docs), "doc_id", "n_removed") == want

    words, found = [b"a b c d e f".split()], [(b"b c d", 1)]
    assert substring_dedup.locate(words, [2], found)[0].tolist() == [False, True, True, True, False, False]
    assert not substring_dedup.locate(words, [1], found)[0].any()
    real = substring_dedup.ahocorasick
    deaf = SimpleNamespace(add_word=lambda *_: None, make_automaton=lambda: None, iter=lambda _: iter(()))
    monkeypatch.setattr(substring_dedup, "ahocorasick", SimpleNamespace(STORE_ANY=real.STORE_ANY, KEY_SEQUENCE=real.KEY_SEQUENCE, Automaton=lambda *_: deaf))
    assert not substring_dedup.locate(words, [2], found)[0].any()


def test_rows_alike_and_many_repeats(spark):
    """Rows alike in id and text, and one passage in many documents between other words."""
    rng = random.Random(9)
    prose = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    passage = prose(230)
    data = [(i, f"{prose(rng.randint(0, 70))} {passage} {prose(rng.randint(0, 70))}") for i in range(60)] + [(70, passage)] * 40 + [(i, " ".join(passage.split()[k : k + 60])) for k, i in enumerate(range(80, 100))]
    found = rows(substring_dedup.digest(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == Counter(brute.substring(data)) and found[(70, 230, 230, brute.sha(""))] == 40


def test_substring_texts(docs, docs_rows):
    out = substring_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = {(i, t): n for (i, t, _), (_, _, n, _) in zip(docs_rows, brute.substring([(i, t) for i, t, _ in docs_rows]))}
    before = Counter((i, t) for (i, t), n in want.items() if not n)
    kept = Counter({(r["doc_id"], r["text"]): 1 for r in out.collect()})
    assert not before - kept
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
    assert substring_dedup.cut("a  b\nc d ", [b"a", b"b", b"c", b"d"], np.array([False, True, False, True])) == "a  c "


def test_simhash(docs, docs_rows, empty):
    found = simhash.classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "component_id")
    assert rows(found, "doc_id", "fp", "component_id") == Counter(brute.simhash([(i, t) for i, t, _ in docs_rows]))
    assert simhash.classes(empty).count() == 0


def test_simhash_keeps_one_of_each_group(docs, docs_rows):
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    want = {c for _, _, c in brute.simhash([(i, t) for i, t, _ in docs_rows]) if c is not None}
    found = Counter(r["doc_id"] for r in out.collect())
    assert {i for i in found if i is not None} == want and all(n == 1 for i, n in found.items() if i is not None)


@pytest.mark.parametrize("q", [6, 9])
def test_ball_hashing_finds_every_link(q):
    rng = random.Random(q)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)})
    x = np.array(fps, np.uint64).view(np.int64)
    import pandas as pd

    sent = pd.concat(simhash._sender(q)(iter([pd.DataFrame({"fp": x})])))
    links = []
    for prefix, part in sent.groupby("prefix"):
        own = np.sort(part["fp"].to_numpy(np.int64)).view(np.uint64)
        links += [(int(own[a]), int(own[b])) for a, b in enumerate(simhash._meet(own, int(prefix), q).tolist()) if a != b]
    want = brute.groups(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3])
    assert brute.groups(fps, links) == want


def test_licenses(docs, docs_rows, empty):
    found = license_scan.digest(docs)
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((i, *brute.licenses(t)) for i, t, _ in docs_rows)
    by_id = {r["doc_id"]: r for r in found.where("doc_id is not null").collect()}
    for i, t, _ in docs_rows:
        if t and t.startswith("Licensed under the Apache"):
            assert by_id[i]["labels"] == "agpl-3,apache-2,gpl-3" and by_id[i]["score"] == 1
    assert license_scan.digest(empty).count() == 0


NOTICES = {
    "apache-2": """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */""",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction""",
    "mpl-2": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */",
    "": "Permission is hereby granted to any person, free of charge.\nWe have a copy of this\n" + "filler " * 30 + "\nsoftware and associated documentation files obtaining the software",
}


def test_wrapped_licenses(spark):
    df = spark.createDataFrame([(i, f"some words before\r\n{t}\nand after") for i, t in enumerate(NOTICES.values())], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.digest(df).collect()}
    assert [found[i]["labels"] for i in range(len(NOTICES))] == list(NOTICES)
    assert [found[i]["score"] for i in range(len(NOTICES))] == [1, 1, 1, 1, 0]


def _blocks(df, templates, threshold) -> dict:
    keyed = df.select("doc_id", *license_scan.text_key()).join(license_scan.similar_blocks(df, templates, threshold), ["h1", "h2"])
    found: dict = {}
    for r in keyed.collect():
        found.setdefault(r["doc_id"], {})[r["label"]] = round(r["share"], 9)
    return found


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_license_join_is_exact(spark, threshold):
    rng = random.Random(8)
    templates = {"one": "a b c d e f g h i j a", "two": "a b k l m n o p q r s t", "three": "x y z", "four": "a", "none": ""}
    vocabulary = "a b c d e f g h i j k l m n o p q r s t u x y z".split()
    data = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\n\n", " - "]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    data += [(200, "a b c d e f g h " + "u " * 3000 + "a b u u c d u e f g h i " + "u " * 3000), (201, data[3][1]), (202, None), (203, "")]
    found = _blocks(spark.createDataFrame(data, "doc_id long, text string"), templates, threshold)
    for i, text in data:
        words, want = [w for w in (text or "").split() if w != "-"], {}
        for label, template in templates.items():
            own, n = set(template.split()), len(template.split())
            reach = n + n // 2
            share = max((len(own & set(words[k : k + reach])) / len(own) for k in range(len(words))), default=0) if own else 0
            if own and share >= threshold - 1e-12:
                want[label] = round(share, 9)
        assert found.get(i, {}) == want, i
    assert sum(map(bool, found.values())) > 20


def test_long_templates(spark):
    """A full text of 3,000 words beside a short notice: held, with edits and wrapped, exactly as brute force counts."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 900)}" for _ in range(3000)]
    templates = {"full": " ".join(words), "short": "w1 w2 w3 notice"}
    edited = [w for w in words if rng.random() > 0.04]
    worse = [w if rng.random() > 0.4 else "gone" for w in words]
    texts = ["\n".join([*["before"] * 700, *edited, *["after"] * 5000]), " ".join(worse), "x " * 4000 + "w1 notice w3 w2 " + " ".join(words[:2500]), " ".join(words[:2000])]
    found = _blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, 0.9)
    want: dict = {}
    for i, text in enumerate(texts):
        have = text.split()
        for label, template in templates.items():
            own, reach = set(template.split()), len(template.split()) * 3 // 2
            share = max(len(own & set(have[k : k + reach])) for k in range(0, len(have), 1 if label == "short" else 7)) / len(own)
            if share >= 0.9:
                want.setdefault(i, {})[label] = round(share, 2)
    assert {i: {k: round(v, 2) for k, v in x.items()} for i, x in found.items()} == want and want[0].keys() == {"full"} and "short" in want[2]
    with pytest.raises(ValueError, match="words"):
        license_scan.similar_blocks(spark.createDataFrame([(0, "a")], "doc_id long, text string"), {"big": "w " * (license_scan.MOST_WORDS + 1)})


def test_plan_of_licenses_does_not_grow_with_the_templates(spark):
    df = spark.createDataFrame([(0, "the 7th notice of kind17 and some words of rare17 text"), (1, "nothing")], "doc_id long, text string")
    many = {f"label{k}": f"the notice of kind{k} and words of rare{k}" for k in range(400)}
    size = lambda t: len(license_scan.similar_blocks(df, t, 0.9)._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < 1.2 * size(dict(list(many.items())[:4]))
    assert _blocks(df, many, 0.9) == {0: {"label17": 1.0}}


@pytest.mark.parametrize("seed", range(4))
def test_packing_rules(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([1, 5, 500, 512, 513, 1024, 4096, rng.randint(1, 4096)]) for _ in range(rng.randint(0, 300))), reverse=True)
    of, at, sizes = packing.pack(lengths)
    held: dict = {}
    for n, b, a in zip(lengths, of, at):
        held.setdefault(b, []).append((a, n))
    for b, items in held.items():
        items.sort()
        assert items[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(items, items[1:]))
        total = sum(n for _, n in items)
        assert total <= sizes[b] and not any(total <= s < sizes[b] for s in packing.SIZES)
    assert len(sizes) == len(held)
    assert sum(lengths) == sum(n for items in held.values() for _, n in items)


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_plain_best_fit(seed):
    rng = random.Random(seed)
    for sizes in (packing.SIZES, (4096,), (100, 300)):
        lengths = sorted((rng.choice([1, 5, 100, rng.randint(1, max(sizes))]) for _ in range(rng.randint(0, 200))), reverse=True)
        assert packing.pack(lengths, sizes) == brute.best_fit(lengths, sizes, packing.OVERHEAD)


def test_packing_fills_better_than_one_size():
    rng = random.Random(5)
    documents = [int(min(20_000, rng.lognormvariate(6, 1))) + 2 for _ in range(3000)]

    def fill(sizes):
        pieces = sorted((k for n in documents for k in [max(sizes)] * (n // max(sizes)) + [n % max(sizes)] if k), reverse=True)
        return sum(documents) / sum(packing.pack(pieces, sizes)[2])

    assert fill(packing.SIZES) >= max(fill((s,)) for s in packing.SIZES[1:]) and fill(packing.SIZES) > 0.995


def test_packing_of_documents(docs, docs_rows, empty):
    import sentencepiece

    path = model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [sp.encode(t or "", add_bos=True, add_eos=True) for _, t, _ in docs_rows]
    found = packing.pack_documents(docs, path).collect()
    want, got = Counter(), Counter()
    for (i, _, _), x in zip(docs_rows, ids):
        want[i] += len(x)
    for r in found:
        got[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= r["bin_size"]
    assert got == want and any(r["piece"] == 2 for r in found)
    assert packing.pack_documents(empty, path).count() == 0

    bins = packing.sequences(docs, path).collect()
    assert {(r["shard"], r["bin"], r["bin_size"]) for r in bins} == {(r["shard"], r["bin"], r["bin_size"]) for r in found}
    pieces = Counter(tuple(x[a : a + 4096]) for x in ids for a in range(0, len(x), 4096))
    at = {}
    for r in found:
        at.setdefault((r["shard"], r["bin"]), []).append((r["offset"], r["length"], r["doc_id"]))
    for r in bins:
        assert r["n_tokens"] == len(r["ids"]) <= r["bin_size"]
        inside = sorted(at[r["shard"], r["bin"]])
        assert [d for _, _, d in inside] == list(r["doc_ids"])
        pieces.subtract(tuple(r["ids"][a : a + n]) for a, n, _ in inside)
    assert not any(pieces.values())


def test_packing_order_of_equal_lengths(spark):
    items = [(3, 9, 700), (1, 9, 700), (None, 9, 700), (1, 5, 700), (2, 9, 4000), (4, 9, 0), (5, 9, None)]
    found = {(r["doc_id"], r["thash"]): (r["bin"], r["offset"]) for r in packing.best_fit(spark.createDataFrame(items, "doc_id long, thash long, n_tokens long")).collect()}
    assert found == {(2, 9): (0, 0), (1, 5): (1, 0), (1, 9): (1, 700), (3, 9): (2, 0), (None, 9): (2, 700), (4, 9): (None, None), (5, 9): (None, None)}


def test_weak_labels(spark, docs, docs_rows, empty):
    found = weak_labels.classify(docs)
    assert rows(found, "doc_id") == Counter((i,) for i, _, _ in docs_rows)
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert weak_labels.classify(empty).count() == 0


def test_classifier_against_brute_force(spark, docs, docs_rows):
    """Counts of patterns, expectation-maximisation, sample, training and scores, in plain loops."""
    found = weak_labels.classify(docs, sample=30)
    want = brute.classify([(i, t) for i, t, _ in docs_rows], 30, spark)
    got = sorted((str(r["doc_id"]), r["pattern"], round(r["posterior"], 6), round(r["score"], 3)) for r in found.collect())
    expected = sorted((str(i), p, round(a, 6), round(b, 3)) for i, p, a, b in want)
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert max(abs(x[3] - y[3]) for x, y in zip(got, expected)) <= 0.002
    again = weak_labels.classify(docs.repartition(7), sample=30)
    assert rows(again, "doc_id", "score", "kept") == rows(found, "doc_id", "score", "kept")


def test_labeller_accuracies_are_recovered():
    rng = random.Random(1)
    right = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.9]
    counts, truth = Counter(), Counter()
    for _ in range(20000):
        y = rng.random() < 0.7
        p = "".join("-" if rng.random() < 0.2 else str(int(y == (rng.random() < a))) for a in right)
        counts[p] += 1
        truth[p] += y
    posterior, accuracy, prior = weak_labels.fit_labellers(counts)
    assert abs(prior - 0.7) < 0.05 and np.abs(accuracy - right).max() < 0.05
    assert sum(n if (posterior[p] > 0.5) else 0 for p, n in truth.items()) / sum(truth.values()) > 0.9


def test_scorer_on_held_out_labels(spark):
    """Agreement with the labels of the test data, none of which are used in fitting."""
    import os

    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test data")
    found = weak_labels.classify(spark.read.parquet(f"{base}/documents.parquet"))
    both = found.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in both]) > 0.95
    assert np.mean([r["kept"] for r in both if r["quality"]]) > 0.99


def test_maybe_among_never_misses(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    found = common.maybe_among(spark.range(3000).select(F.col("id").alias("k")), keys, "k").collect()
    assert len(found) == 3000 and all(r["maybe"] for r in found if r["k"] % 3 == 0)
    assert sum(r["maybe"] for r in found) < 1100
    assert not any(r["maybe"] for r in common.maybe_among(spark.range(9).select(F.col("id").alias("k")), keys.limit(0), "k").collect())


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    found = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute.groups(sorted({x for p in pairs for x in p}), pairs)
    assert found == {i: c for i, c in want.items() if i in found} and all(i in found or c == i for i, c in want.items())


def test_windows_leave_in_batches():
    """A frame for many documents, not one for each; another where BATCH windows are held."""
    text = " ".join(f"w{i}" for i in range(40))
    batch = pd.DataFrame({"doc_id": range(50), "thash": range(50), "text": [f"d{i} {text}" for i in range(50)], "starts": [[0, 5]] * 50, "sizes": [[2, 3]] * 50})
    found = list(substring_dedup._opener(8)(iter([batch])))
    assert len(found) == 1 and len(found[0]) == 250 and found[0]["a"].nunique() == 50 + 4
    assert found[0].groupby("doc_id")["start"].apply(list).tolist() == [[0, 1, 5, 6, 7]] * 50
    assert (found[0]["a"] != found[0]["b"]).all() and found[0].groupby("a")["b"].nunique().max() == 1
