"""Secret scans with an incremental ledger of blobs.

A blob is a text under the SHA-256 of its UTF-8; many paths (documents, or
historical versions of them) can hold one blob. The ledger is a Parquet folder
with a row for each scan of a blob: which rule versions ran, and the spans they
found, each with the version that found it. A scan takes four steps:

1. The addresses of all paths, without texts, are held against the ledger; what
   is left are the pairs of blob and rule version that it lacks.
2. Only blobs with such pairs (a bitmap of their addresses tells which rows may
   hold one) are shuffled and scanned, each once whatever the number of its
   copies, and only by the versions that it lacks.
3. The new rows are appended to the ledger. Addresses are taken in SHARDS ranges,
   one append each, so a run that dies loses one range at most and the next run
   goes on from there.
4. Findings are read from the ledger and joined back to all paths.

Rules are told apart by version (kind, pattern, group and least length), never by
their place in a list: reordered rules give the same spans, spans of removed or
changed rules drop out, a rule given twice counts once. Two runs that scan the same
pair at once append equal rows, which are taken once.

A rule's matches are leftmost and do not overlap; matches whose value is too
short are dropped. Java's split and extract functions walk over the same
matches, so the lengths of gaps and of matches, summed in a window, give every
match's place without Python. Spans are in code points, the end exclusive.
DataFrame functions only.

Defined results: a null text is the empty blob. Repeated rows and ids each get a
row. Spans that begin at one place are listed in the order of the rules. Blobs of
any length, with any number of matches, are scanned whole. Of columns only
doc_id and text count, by their exact names; others, of any name, are left alone.
An empty table gives an empty result and leaves the ledger as it was.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """pattern (Java); group is the value's group, which has least characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        text = f"{self.pattern}\0{self.group}\0{self.least}"
        return f"{self.kind}@{hashlib.sha256(text.encode()).hexdigest()[:12]}"


#: The rules of the contract, in the order in which spans of one start are listed.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
#: Further rules.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@"),
]
RULES = [*BASE, *MORE]

SPANS = "array<struct<start:int,version:string,end:int>>"
LEDGER = f"sha string, scanned array<string>, spans {SPANS}"
#: Ranges of addresses that are scanned and appended one after the other.
SHARDS = 2


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def by_version(rules: list[Rule]) -> dict[str, Rule]:
    """Each rule once, in order."""
    return {r.version: r for r in dict.fromkeys(rules)}


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path; None where there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(LEDGER).parquet(path) if known else None


def unseen(addresses: DataFrame, rules: list[Rule], ledger: DataFrame | None) -> DataFrame:
    """(sha, missing): of distinct addresses, those with rule versions that the ledger lacks, and which."""
    versions = F.array(*(F.lit(v) for v in by_version(rules)))
    if ledger is None:
        return addresses.select("sha", versions.alias("missing"))
    pairs = ledger.select("sha", F.explode("scanned").alias("version")).where(F.col("version").isin(*by_version(rules))).distinct()
    seen = pairs.groupBy("sha").agg(F.collect_set("version").alias("seen"))
    left = addresses.join(seen, "sha", "left").select("sha", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing"))
    return left.where(F.size("missing") > 0)


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (gap before the match, its length, its value's length); one more, of nulls, for the gap at the end."""
    pattern = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    gaps, whole = lengths(F.split(text, rule.pattern, -1)), lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    value = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole
    return F.when(text.rlike(rule.pattern), F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value")))


def scan(blobs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Ledger rows of blobs (sha, missing, text), distinct by sha, each scanned by the rule versions in missing."""
    text = F.coalesce("text", F.lit(""))
    hits = F.array(*(
        F.struct(F.lit(v).alias("version"), F.lit(r.least).alias("least"), F.when(F.array_contains("missing", v), _matches(text, r)).alias("matches"))
        for v, r in by_version(rules).items()
    ))
    found = blobs.select("sha", F.col("missing").alias("scanned"), F.filter(hits, lambda h: h["matches"].isNotNull()).alias("hits"))
    scanned = common.materialize(found, "scanned")
    each = scanned.select("sha", F.explode("hits").alias("h")).select("sha", "h.version", "h.least", F.posexplode("h.matches").alias("pos", "m"))
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(Window.partitionBy("sha", "version").orderBy("pos"))
    placed = each.withColumn("end", end.cast("int")).where("m.value >= least")
    spans = placed.groupBy("sha").agg(F.collect_list(F.struct((F.col("end") - F.col("m.size")).alias("start"), "version", "end")).alias("spans"))
    return scanned.drop("hits").join(spans, "sha", "left").select("sha", "scanned", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def update(docs: DataFrame, ledger_path: str, rules: list[Rule] = RULES, shards: int = SHARDS) -> None:
    """Scans what the ledger lacks of the blobs of docs, and appends it."""
    spark = docs.sparkSession
    texts = common.pick(docs, "text").select(blob_id(F.col("text")).alias("sha"), "text")
    # Addresses are spread evenly over the hexadecimal numbers.
    shard = lambda sha: F.floor(F.conv(F.substring(sha, 1, 6), 16, 10).cast("bigint") * shards / F.lit(1 << 24))
    with common.scope():
        addresses = common.materialize(texts.select("sha").distinct(), "addresses")
        for k in range(shards):
            todo = unseen(addresses.where(shard("sha") == k), rules, read_ledger(spark, ledger_path))
            todo = common.materialize(todo, "unseen")
            if todo.isEmpty():
                continue
            held = common.maybe_among(texts, todo, "sha").where("maybe").groupBy("sha").agg(F.first("text").alias("text"))
            scan(held.join(todo, "sha"), rules).write.mode("append").parquet(ledger_path)


def findings(docs: DataFrame, rules: list[Rule] = RULES, ledger_path: str | None = None, shards: int = SHARDS) -> DataFrame:
    """(sha, spans, n) of the blobs of docs that have spans, by these rules, and how many rows hold each; spans are (start, kind, end), kind a place in rules.

    Everything is read from the ledger after update() has brought it up to date.
    Without a path the ledger is a new one in the scratch folder.
    """
    spark, order = docs.sparkSession, {v: i for i, v in enumerate(by_version(rules))}
    with common.scope() as kept:
        path = ledger_path or common.new_path(spark, "ledger")
        update(docs, path, rules, shards)
        ledger = read_ledger(spark, path)
        if ledger is None:
            ledger = spark.createDataFrame([], LEDGER)
        kinds = F.array(*(F.lit(v) for v in order))
        rows = ledger.withColumn("spans", F.filter("spans", lambda s: s["version"].isin(*order))).where(F.size("spans") > 0)
        kind = lambda s: (F.array_position(kinds, s["version"]) - 1).cast("int").alias("kind")
        placed = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), kind(s), s["end"].alias("end")))
        held = rows.groupBy("sha").agg(F.array_sort(F.array_distinct(placed)).alias("spans"))
        addresses = common.pick(docs, "text").groupBy(blob_id(F.col("text")).alias("sha")).agg(F.count("*").alias("n"))
        found = common.materialize(held.join(addresses, "sha"), "findings")
        kept.append(found)
    return found


def _joined(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in by_version(rules).values()))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: list[Rule] = RULES, ledger_path: str | None = None) -> DataFrame:
    """doc_id, count by base kind, base_sha256 and spans, for every row of docs."""
    spans = findings(docs, rules, ledger_path)
    at = {v: i for i, v in enumerate(by_version(rules))}
    of_base = [at.get(r.version, -1) for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*of_base))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in zip(of_base, BASE)]
    found = spans.select("sha", "n", *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))
    paths = common.pick(docs, "doc_id", "text").select("doc_id", blob_id(F.col("text")).alias("sha"))
    digests = common.materialize(found, "digests")
    common.free(spans)
    # A blob with findings may have a large part of all paths.
    out = common.join_counted(paths, digests, ["sha"], "left", wide=True)
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in BASE),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, rules: list[Rule] = RULES, ledger_path: str | None = None) -> DataFrame:
    """docs with each secret replaced by [secret]; overlapping spans count as one. n_chars is counted anew where the text changes."""
    paths = findings(docs, rules, ledger_path)
    found = paths.select("sha", F.explode("spans").alias("s")).select("sha", "s.start", "s.end")
    order = Window.partitionBy("sha").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum((F.col("start") >= F.coalesce("before", F.lit(0))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = found.withColumn("before", before).withColumn("g", group).groupBy("sha", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts")).join(paths.select("sha", "n"), "sha")
    cuts = common.materialize(cuts.withColumnRenamed("sha", "_key"), "cuts")
    common.free(paths)
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    text = f"_{common.index_of(docs, 'text')}"
    # Only texts that may hold a secret (a bitmap of their blobs tells) take part in the join.
    flagged = common.maybe_among(plain.withColumn("_key", blob_id(F.col(text))), cuts, "_key")
    joined = common.join_counted(flagged.where("maybe"), cuts, ["_key"], "left", wide=True)
    start = "if(i = 0, 0, get(_cuts, i - 1).end)"
    piece = F.expr(f"transform(_cuts, (c, i) -> substring({text}, {start} + 1, c.start - {start}))")
    rest = F.expr(f"substring({text}, get(_cuts, size(_cuts) - 1).end + 1)")
    new = F.when(F.col("_cuts").isNotNull(), F.array_join(F.concat(piece, F.array(rest)), "[secret]")).otherwise(F.col(text))
    out = joined.withColumn(text, new)
    if "n_chars" in docs.columns:
        n = f"_{common.index_of(docs, 'n_chars')}"
        out = out.withColumn(n, F.when(F.col("_cuts").isNotNull(), F.length(text).cast(plain.schema[n].dataType)).otherwise(F.col(n)))
    return flagged.where("not maybe").select(*plain.columns).unionByName(out.select(*plain.columns)).toDF(*docs.columns)
