import random

from pyspark.sql import functions as F

from spindle.operators.running import running_counts


def test_blocks_count_like_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, x boolean").repartition(7)
    got = {r["t"]: (r["n"], r["m"]) for r in running_counts(df, "k", F.floor(F.col("t") / 50), ["t"], {"n": F.lit(True), "m": F.col("x")}).collect()}
    seen = {}
    for k, t, x in rows:
        n, m = seen.get(k, (0, 0))
        seen[k] = (n + 1, m + x)
        assert got[t] == seen[k]
    assert running_counts(df.limit(0), "k", F.floor(F.col("t") / 50), ["t"], {"n": F.lit(True)}).count() == 0
