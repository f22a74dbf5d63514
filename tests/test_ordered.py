import random

from pyspark.sql import functions as F

from undertow.functions.ordered import numbered, previous, running_max


def data(spark):
    rng = random.Random(2)
    keys = ["hot"] * 400 + ["cold"] * 30 + [None] * 20 + ["one"]
    rows = [(k, rng.randrange(50), i, rng.choice("xyz")) for i, k in enumerate(keys)]
    return rows, spark.createDataFrame(rows, "k string, t int, i int, v string")


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers_within_groups_that_span_slices(spark):
    rows, df = data(spark)
    got = {r["i"]: r["n"] for r in numbered(df, ["k"], [F.asc("t"), F.asc("i")], "n").collect()}
    assert got == {r[2]: n for g in groups(rows).values() for n, r in enumerate(g, 1)}


def test_the_row_before_across_slices(spark):
    rows, df = data(spark)
    got = {r["i"]: r["p"] for r in previous(df, ["k"], [F.asc("t"), F.asc("i")], "v", "p").collect()}
    want = {}
    for g in groups(rows).values():
        for before, r in zip([None, *g], g):
            want[r[2]] = before and before[3]
    assert got == want


def test_numbers_over_everything(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = [r["n"] for r in numbered(df, [], [F.desc("x")], "n").orderBy(F.desc("x")).collect()]
    assert got == list(range(1, 1001))


def test_the_greatest_so_far_across_slices(spark):
    rows, df = data(spark)
    sparse = df.withColumn("v", F.when(F.col("v") != "x", F.struct("v", "i")))
    got = {
        r["i"]: r["m"] and tuple(r["m"])
        for r in running_max(sparse, ["k"], [F.asc("t"), F.asc("i")], "v", "m").collect()
    }
    want = {}
    for g in groups(rows).values():
        best = None
        for _, _, i, v in g:
            if v != "x":
                best = max(best or (v, i), (v, i))
            want[i] = best
    assert got == want
