"""Running values against itertools."""

from itertools import accumulate

from pyspark.sql import functions as F

from traceframe.functions.scans import let, running


def test_running_totals(spark):
    rows = [list(range(n)) for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<bigint>")
    got = df.select("v", running(F.col("v"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("r")).collect()
    assert all(r.r == [0, *accumulate(r.v)] for r in got)
    assert df.select(let(F.size("v"), lambda n: n * n).alias("n")).agg(F.max("n")).first()[0] == 1_000_000


def test_a_long_array_takes_no_quadratic_time(spark):
    n = 300_000
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("v"))
    got = df.select(F.element_at(running(F.col("v"), F.lit(0), lambda a, x: a.bitwiseXOR(x)), -1).alias("x")).first().x
    want = 0
    for i in range(1, n + 1):
        want ^= i
    assert got == want
