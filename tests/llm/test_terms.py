import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessellar.llm import terms
from tessellar.llm.terms import marked, term_frequencies


def brute(rows):
    n, units = Counter(), defaultdict(set)
    for u, *values in rows:
        for f, v in zip(("a", "b"), values, strict=True):
            if u is not None and v:
                n[f, v] += 1
                units[f, v].add(u)
    return sorted((*k, n[k], len(units[k])) for k in n)


@pytest.mark.parametrize(("share", "fraction"), [(1 / 8, 1.0), (1 / 512, 0.5), (1.0, 1.0), (1 / 8, 0.0)])
def test_either_way_counts_everything(spark, share, fraction):
    r = random.Random(3)
    rows = [(r.choice([None, -5, 0, 2147483647, *range(40_000, 40_300)]), r.choice(["hot", "hot", None, "", f"t{r.randrange(60)}"]), r.choice(["x", "y" * 5000, "zé"])) for _ in range(4000)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "u int, a string, b string, term string").repartition(5)
    out, total = term_frequencies(df, ["a", "b"], "u", share, fraction)
    assert sorted(tuple(x) for x in out.collect()) == brute(rows)
    assert total.first()[0] == len({x[0] for x in rows} - {None})


def test_empty_and_marks(spark):
    empty = spark.createDataFrame([], "u int, a string")
    out, total = term_frequencies(empty, ["a"], "u")
    assert out.collect() == [] and total.first()[0] == 0
    n = lambda k: spark.createDataFrame([(k,)], "n_units long")
    counts = spark.createDataFrame([("f", str(k), k, k) for k in (1, 2, 7, 8, 665, 666)], "field_name string, term string, n_rows long, n_units long")
    marks = {x["n_units"]: x["mark"] for x in marked(counts, n(700)).collect()}
    assert marks == {1: "rare", 2: "rare", 7: None, 8: None, 665: None, 666: "common"}
    assert {x["n_units"]: x["mark"] for x in marked(counts, n(3)).collect()}[1] is None


def test_keys_are_sorted_seldom(monkeypatch):
    """Many distinct units: the counters stay exact and are compacted a few times only."""
    monkeypatch.setattr(terms, "HELD", 1000)
    c, r, seen = terms._Counters(["a"]), np.random.default_rng(1), set()
    for _ in range(200):
        units = r.integers(0, 100_000, 300)
        c.add(pa.array(["a"] * 300), units)
        seen |= set(units.tolist())
    assert c.limit > 1000 and c.rows[0] == 60_000
    assert sum(int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) for _, _, bits in c.blocks()) == len(seen)
