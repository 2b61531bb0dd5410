"""Tables written once in the folder that the cluster shares, and joins on keys that may hold a large part of all rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000
#: A table of more rows is not broadcast.
MANY = 100_000
#: Tasks that share a hot key where the row joined to it is wide.
SALTS = 32

_OWN_DIR: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a folder of our own only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN_DIR.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessella-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that is dropped like a table."""
    path = f"{scratch_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def materialize(df: DataFrame, name: str, **totals: Column) -> DataFrame:
    """Writes df once as Parquet in the scratch folder and reads it back.

    Cuts the lineage in a form that survives a lost executor, and gives the
    planner the true size, so that joins are broadcast only below the
    session's threshold. totals are aggregates that are taken while it is
    written; total() reads them.
    """
    path, schema = new_path(df.sparkSession, name), df.schema
    if dict(df.dtypes).get("n") in ("int", "bigint"):
        totals |= {"n": F.sum("n"), "least_n": F.min("n"), "most_n": F.max("n"), "keys": F.count(F.lit(1))}
    seen = Observation() if totals else None
    (df.observe(seen, *(x.alias(k) for k, x in totals.items())) if totals else df).write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch_path, out._scratch_totals = path, seen.get if seen else {}
    return out


def total(table: DataFrame, name: str) -> object:
    """An aggregate that materialize() took of the table."""
    return table._scratch_totals[name]


def _drop(path: str) -> None:
    spark = _MADE.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


def free(*tables: DataFrame) -> None:
    """Drops tables of materialize() whose readers have all been written."""
    for table in tables:
        _drop(getattr(table, "_scratch_path", ""))


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Scratch tables made within are dropped at the end, but for those put into the list."""
    before, kept = set(_MADE), []
    try:
        yield kept
    finally:
        keep = {getattr(table, "_scratch_path", "") for table in kept}
        for path in set(_MADE) - before - keep:
            _drop(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_MADE):
        _drop(path)


def shuffled(table: DataFrame) -> DataFrame:
    """table for a join in which it is never broadcast, since it has as many rows as its input has rows or cells.

    The planner knows a table by the size of its files, and what an explode makes
    of it by the size of what it reads; either may be a hundredth of its size in memory.
    """
    return table.hint("merge")


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", wide: bool = False) -> DataFrame:
    """rows joined with table, which has one row for each key and in n how many rows hold it. how: inner or left.

    table is a materialised one. Keys with more than one in HOT of all rows are
    fewer than HOT by that, and no task gets all rows of one: the table's rows for
    them are broadcast, or, if they are wide (hold texts, say, so that their number
    bounds no size), sent to SALTS tasks each. All other keys go through a shuffle,
    or are broadcast if they are MANY at most and the session allows their size.
    """
    rows_in_all, least, most = (total(table, x) or 0 for x in ("n", "least_n", "most_n"))
    large = (total(table, "keys") or 0) > MANY
    plain = shuffled(table.drop("n")) if large else table.drop("n")
    if most * HOT <= rows_in_all:
        return rows.join(plain, keys, how)
    if least * HOT > rows_in_all and not wide:
        return rows.join(F.broadcast(table.drop("n")), keys, how)
    hot, rest = table.where(F.col("n") * HOT > rows_in_all).drop("n"), table.where(F.col("n") * HOT <= rows_in_all).drop("n")
    rest = shuffled(rest) if large else rest
    few = F.broadcast(hot.select(*keys))
    others = rows.join(few, keys, "left_anti").join(rest, keys, how)
    if not wide:
        return rows.join(F.broadcast(hot), keys).unionByName(others)
    salted = rows.join(few, keys, "left_semi").withColumn("_salt", F.spark_partition_id() % SALTS)
    copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt").unionByName(others)
