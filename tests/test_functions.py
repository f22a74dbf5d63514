import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import scalars
from undertow.functions.summaries import contents, fingerprint, percentile_cont, with_cells


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ratio_guards_zero_and_null(spark):
    assert one(spark, scalars.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scalars.ratio(F.lit(None).cast("int"), F.lit(2))) is None
    assert one(spark, scalars.ratio(F.lit(1), F.lit(4))) == 0.25


@pytest.mark.parametrize(
    "minutes, text", [(0, "+00:00"), (160, "+02:40"), (1440, "+1d 00:00"), (1600, "+1d 02:40")]
)
def test_offset_text(spark, minutes, text):
    assert one(spark, scalars.offset_text(F.lit(minutes))) == text


def test_instants_compare_across_offsets(spark):
    a = scalars.instant(F.lit("2026-01-01T10:00:00Z"))
    b = scalars.instant(F.lit("2026-01-01T12:00:00+02:00"))
    assert one(spark, a == b) is True
    assert one(spark, scalars.instant(F.lit("last night"))) is None


def test_tolerant_parsing(spark):
    assert one(spark, scalars.tolerant_int(F.lit("soon"))) is None
    assert one(spark, scalars.tolerant_bool(F.lit(" True "))) is True
    assert one(spark, scalars.tolerant_bool(F.lit(None).cast("string"))) is None


def test_is_false_needs_a_definite_false(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert df.where(scalars.is_false(F.col("b"))).count() == 1


def test_checksum_ignores_order_and_partitions(spark):
    df = spark.range(500).withColumn("v", F.when(F.col("id") % 3 != 0, F.col("id") * 1.5))
    other = df.repartition(7, "v").orderBy(F.desc("id")).select("v", "id")
    assert contents(df).first() == contents(other).first()


def test_checksum_tells_where_a_null_is(spark):
    a = spark.createDataFrame([(None, "a")], "x string, y string")
    b = spark.createDataFrame([("a", None)], "x string, y string")
    assert contents(a).first() != contents(b).first()


def test_checksum_counts_duplicates_and_empty_is_zero(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert contents(a).first() != contents(b).first()
    assert contents(a.limit(0)).first() == (0, 0)


def test_checksum_agrees_with_row_comparison(spark):
    rng = random.Random(5)
    for _ in range(5):
        left = [(rng.randint(0, 3), rng.choice(["a", None])) for _ in range(6)]
        right = rng.sample(left, 6) if rng.random() < 0.5 else [*left[:-1], (9, "z")]
        a = spark.createDataFrame(left, "x int, y string")
        b = spark.createDataFrame(right, "x int, y string")
        same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        assert (contents(a).first() == contents(b).first()) == same


def test_fingerprint_is_blind_to_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(2, "y"), (1, "z")], "i int, s string")
    fp = lambda df: fingerprint({"t": df}).first()["fingerprint"]
    assert fp(a) == fp(b) != fp(c) and len(fp(a)) == 16


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentile_matches_brute_force(spark, p):
    rng = random.Random(int(p * 100))
    # One group holds most rows, many of them equal; one has a single value, one none.
    data = [("hot", rng.choice([1.0, 2.5, rng.uniform(-50, 1e6)])) for _ in range(900)]
    data += [("cold", rng.gauss(0, 1)) for _ in range(40)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["q"] for r in percentile_cont(df, ["k"], "v", p, "q").collect()}
    assert set(got) == {"hot", "cold", "one"}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for g, v in data if g == k and v is not None], p))


def test_percentiles_of_narrow_and_tiny_ranges(spark):
    """Cells follow the data, so no cell holds more than a small share of a group's values."""
    rows = spark.range(20_000).select(
        (F.col("id") % 2).alias("k"),
        F.when(F.col("id") % 2 == 0, 1_700_000_000 + F.col("id") * 130).otherwise(F.col("id") * 1e-11).cast("double").alias("v"),
    )
    got = {r["k"]: r["p"] for r in percentile_cont(rows, ["k"], "v", 0.25, "p").collect()}
    want = {r["k"]: r["p"] for r in rows.groupBy("k").agg(F.percentile("v", 0.25).alias("p")).collect()}
    assert got == pytest.approx(want)
    cells = with_cells(rows.groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_n")), ["k"])
    assert cells.groupBy("k", "_cell").count().agg(F.max("count")).first()[0] < 200
