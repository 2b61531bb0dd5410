"""Dates in texts, medians by narrowing brackets, and samples of rows."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.operators import profile as P
from tessella.operators.tidy import ROW
from tessella.plans import normalize as N

DATES = """2020-01-02|2020-1-2|2020/01/02|2020.01.02|20200102|2020-01|2020/1|01/02/2020|1/2/20|31/12/2020|12/31/2020|31.12.2020|31-12-2020|12-31-2020|02-Jan-2020|2 Jan 2020
2nd of January 2020|Jan 2, 2020|January 2nd, 2020|jan 2 2020|JAN. 2, 2020|Sept 3, 2021|3 sept. 2021|January 2020|Jan-2020|2020 Jan|2020-Jan-05|05-Jan-20|2 January, 2020|29 Feb 2020|2020-02-29|2000-02-29
2020-01-02 03:04|2020-01-02 03:04:05|2020-01-02T03:04:05|2020-01-02T03:04:05Z|2020-01-02T03:04:05.123456+02:00|2020-01-02 03:04:05 UTC|1/2/2020 3:04 PM|Jan 2, 2020 3pm|2 Jan 2020 at 15:00|2020-01-02 3:04:05.5 am
Thu, 02 Jan 2020 03:04:05 GMT|Thursday, January 2, 2020|Thu Jan 2 2020|03:04 2020-01-02|15:30, 2 Jan 2020|  2020-01-02  |2020年1月2日|2020年12月|12/2020|2020-01-02 +0200 |2021-08-31|31 Aug 2021|30 Jun 2021""".replace("\n", "|").split("|")
OTHERS = """|2020|12|123456|2020-13-01|2020-02-30|2021-02-29|1900-02-29|31/31/2020|2020-00-10|2020-01-00|32 Jan 2020|30 Feb 2020|31 Jun 2021|0 Jan 2020|Jan 32, 2020|Janu 2 2020|word|May|Monday|12:30|3pm
1-2|1.5|-5|2020-01-02-03|2020--01-02|2020-01/02|01/02/2020/3|2020-01-02 25:00|2020-01-02 12:60|2020-01-02 12:30:61|1/2/2020 13:00 PM|1/2/2020 0 am|99999999|20201301|12345678|+1 555 123 4567|10.0.0.1|v1.2.3|A-1-2020|2020-01-02 word|word 2020-01-02
Q1 2020|2019-20|2019/2020|100 - 200|1,200|n/a|00000000|2020-W05|marching 2020|mayor 2020|decimal 5 2020""".replace("\n", "|").split("|")


def test_texts_that_are_dates_and_texts_that_are_not(spark):
    rows = [(t, True) for t in DATES if t.strip() != "2020-01-02 +0200"] + [(t, False) for t in OTHERS] + [(None, False)]
    found = spark.createDataFrame(rows, "t string, want boolean").withColumn("is", P.reads_as_date(F.col("t")))
    assert [tuple(r) for r in found.where("is <> want or is is null").collect()] == []


def test_every_day_of_the_calendar(spark):
    """All days of 2019 to 2021 in five spellings are dates; the day after each month's last is not."""
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2021-12-31')) as d")
    for form in ("yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy", "M/d/yy"):
        assert days.where(~P.reads_as_date(F.date_format("d", form))).count() == 0
    ends = days.select(F.last_day("d").alias("d")).distinct().withColumn("t", F.concat(F.date_format("d", "yyyy-MM-"), (F.dayofmonth("d") + 1).cast("string")))
    assert ends.where(P.reads_as_date(F.col("t"))).count() == 0


@pytest.mark.parametrize(("most", "n"), [(1, 1), (1, 2), (1, 30_000), (100_000, 3001)])
def test_medians_by_brackets(spark, monkeypatch, most, n):
    monkeypatch.setattr(P, "NEAR", 0.02)
    rng = random.Random(n)
    columns = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(n)],
        "ties": [float(rng.choice([1, 1, 1, 2, 2, 2, 3])) for _ in range(n)],
        "halves": [float(i % 2) for i in range(n)],
        "one": [7.5] * n,
        "skewed": [rng.random() ** 9 for _ in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), list(columns)).withColumn("nothing", F.lit(None).cast("double")).repartition(4)
    found = {r["column"]: r["median"] for r in P.medians(df, [*columns, "nothing"], most).collect()}
    assert found == {c: statistics.median(v) for c, v in columns.items()}
    for _, c, _, low, high in P._brackets(df, list(columns), most):
        assert low == high or len({x for x in columns[c] if low <= x <= high}) <= max(1.3 * most, 600, 3)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("v", F.col("id") % 7)
    taken = [sorted(map(tuple, P.sample(df.repartition(k), 500, "id").collect())) for k in (1, 3, 8)]
    assert taken[0] == taken[1] == taken[2] and len(taken[0]) == 500
    want = sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:500]
    assert [i for i, _ in taken[0]] == sorted(want)
    assert P.sample(df, 5000, "id").count() == 3000


def test_profile_of_a_sample(spark):
    table = spark.range(300).select(F.col("id").alias(ROW), (F.col("id") % 5).alias("a"))
    config = N.Config.from_dict({"encoder": {"metadata_sample_size": 50}})
    found = N.Normalizer(spark, config)._described(table, {"sheets": {}}, "", {})
    assert tuple(found["original_shape"]) == (300, 1) and found["metadata"]["columns"][0]["n_rows"] == 50
