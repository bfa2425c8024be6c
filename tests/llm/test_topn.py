import math
import random

import pytest

from tessellar.llm.topn import top_n


def brute(rows, n):
    groups = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, []).append((-s, i))
    return sorted((g, i, -s, p) for g, items in groups.items() for p, (s, i) in enumerate(sorted(items)[:n], 1))


@pytest.mark.parametrize("n", [1, 3, 20])
def test_equals_brute_force(spark, n):
    r = random.Random(n)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), f"i{r.randrange(900)}" if r.random() > 0.02 else None, r.choice([None, math.nan, 0.0, -0.0, 1.0, 1.0, r.random()])) for _ in range(3000)]
    df = spark.createDataFrame([(*x, 1, "pos") for x in rows], "g string, i string, s double, r int, part string").repartition(7)
    assert sorted(tuple(x) for x in top_n(df, "g", "i", "s", n).collect()) == brute(rows, n)


def test_all_tied_repeated_and_empty(spark):
    rows = [("g", f"{k:03}", 1.0) for k in range(100)] * 2
    df = spark.createDataFrame(rows, "g string, i string, s double")
    assert [(x["i"], x["pos"]) for x in top_n(df, "g", "i", "s", 4).orderBy("pos").collect()] == [("000", 1), ("000", 2), ("001", 3), ("001", 4)]
    assert top_n(df.where("false"), "g", "i", "s", 4).collect() == []


def test_one_group_fills_the_table(spark):
    df = spark.range(200_000).selectExpr("'hot' as g", "cast(id as string) as i", "cast(id % 1000 as double) as s")
    out = top_n(df, "g", "i", "s", 5).orderBy("pos").collect()
    assert [x["i"] for x in out] == sorted((str(k) for k in range(999, 200_000, 1000)))[:5]
