"""As-of joins against a search of all facts."""

import random

from pyspark.sql import functions as F

from quirework.operators import asof


def test_latest_equals_a_search(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    times = rng.sample(range(3000), 900)
    facts = {n: [(key(), rng.choice([t, t, t, None]), f"{n}{i}") for i, t in enumerate(times[k::3])] for k, n in enumerate(("one", "two"))}
    requests = [(i, key(), rng.choice([rng.randrange(3000), None, times[i]]), "x") for i in range(400)]
    frames = {n: spark.createDataFrame(v, "k string, t long, id string") for n, v in facts.items()}
    asked = spark.createDataFrame(requests, "n long, k string, t long, id string")
    for width in (50, 100_000):
        got = {r["n"]: r for r in asof.latest(asked, frames, ["k"], "t", F.floor(F.col("t") / width)).collect()}
        assert len(got) == 400
        for n, k, t, _ in requests:
            for name, found in facts.items():
                before = [f for f in found if k is not None and t is not None and f[0] == k and f[1] is not None and f[1] <= t]
                want = max(before, key=lambda f: f[1])[1:] if before else None
                assert (tuple(got[n][name]) if got[n][name] else None) == want and got[n]["id"] == "x"


def test_counted(spark):
    rows = [("hot" if i % 3 else "b", i * 7 % 1000) for i in range(700)]
    df = spark.createDataFrame(sorted(set(rows)), "k string, t long")
    for r in asof.counted(df, ["k"], "t", F.floor(F.col("t") / 40), "n").collect():
        assert r["n"] == sum(k == r["k"] and t <= r["t"] for k, t in set(rows))


def test_no_product_of_ranges(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("t"))
    plan = asof.latest(df, {"f": df}, ["k"], "t", F.floor(F.col("t") / 9))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
