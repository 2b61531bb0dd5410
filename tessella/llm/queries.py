"""The thirteen queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, license_scan, packing, quality_rules, rp_forest, secrets, sentencepiece_codec, simhash, source_divergence, substring_dedup, url_rules, warc, weak_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs).select("doc_id", "quality.*")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def model_path() -> str:
    """The tokenizer of the registered queries and of the pipeline."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(_table(spark, sf_dir, "documents"), model_path())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), model_path())


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_embedding_near_dedup, op3_url_filters, op4_quality_classifier, op5_secret_scans,
        op6_sentencepiece, op7_substring_dedup, op8_simhash_near_dedup, op9_best_fit_packing, op10_license_scans,
        op11_phrase_collocations, op12_source_divergence, op13_warc,
    )}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_sql() -> str:
    """The verdicts with every rule tried on every URL."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_rules.HOST_RULES)
    order = sorted(url_rules.PATTERN_RULES, key=lambda r: r.verdict != "allow")
    first = lambda what: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(low, '{r.pattern}') THEN '{getattr(r, what)}' END" for r in order) + ")"
    return f"""
    WITH p AS (SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    q AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    r AS (SELECT * FROM (VALUES {rules}) r(v, h, t)),
    f AS (SELECT page_id, arg_max(h || t, length(h || t)) AS rule, arg_max(v, length(h || t)) AS v FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(v, {first('verdict')}, 'allow') AS verdict, CASE WHEN rule IS NULL THEN {first('pattern')} END AS pattern FROM q LEFT JOIN f USING (page_id)
    """


EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(u, v) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
n AS (SELECT u, COUNT(*) AS n FROM l GROUP BY u)
SELECT r.u AS vec_id, coalesce(MAX(n.n), 0) AS n_links, MIN(r.v) AS component_id, MIN(r.v) = r.u AS kept FROM r LEFT JOIN n ON n.u = r.u GROUP BY r.u
"""


COLLOCATION_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
x AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM w),
f AS (SELECT lang, k, phrase, CAST(COUNT(*) AS HUGEINT) AS f FROM x GROUP BY lang, k, phrase),
t AS (SELECT lang, SUM(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
i AS (SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase),
s AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
h AS (SELECT s.lang, s.phrase, s.a, s.cut, l.f AS l, r.f AS r, 1000000 * s.a * s.a // (l.f * r.f) AS score
  FROM s JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.cut + 1:s.k], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS least FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE least = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(COUNT(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING COUNT(DISTINCT d) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, COUNT(*) AS v, SUM(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(COUNT(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, SUM(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS times, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + 1000000000 * (k.n + 5) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, SUM(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE times > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM b)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS s FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(s, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) for i in range(0, 32)], '') AS payload_digest FROM h),
m AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL says the same; the others are held against brute force in the tests."""
    return {
        "op2_embedding_near_dedup": EMBEDDING_SQL, "op3_url_filters": _url_sql(), "op11_phrase_collocations": COLLOCATION_SQL,
        "op12_source_divergence": DIVERGENCE_SQL, "op13_warc": WARC_SQL,
    }
