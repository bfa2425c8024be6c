from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import compare
from tessellar.llm import queries
from tessellar.llm.packing import best_fit, pack, token_counts

SCHEMES = {"small": [10], "mixed": [10, 40]}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25), st.lists(st.integers(60, 200), min_size=1, max_size=3, unique=True))
def test_plan_places_every_item_once(histogram, capacities):
    plan = best_fit(histogram, capacities)
    placed = Counter()
    for b in plan:
        assert 0 < b.load <= b.capacity and b.times > 0 and b.capacity in capacities
        assert b.capacity == min(c for c in capacities if c >= b.load)
        for s, n in b.content.items():
            placed[s] += n * b.times
    assert placed == Counter(histogram)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_never_far_from_the_least_number(sizes):
    used = sum(b.times for b in best_fit(Counter(sizes), [30]))
    least = -(-sum(sizes) // 30)
    assert least <= used <= 1.7 * least + 1


def test_too_large_an_item():
    with pytest.raises(ValueError):
        best_fit({11: 1}, [10])


def rows(spark, sizes, rows_a_bucket=500_000):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, scheme string")
    return pack(df.repartition(3), SCHEMES, rows_a_bucket=rows_a_bucket).collect()


@pytest.mark.parametrize("rows_a_bucket", [500_000, 4])
def test_whole_unless_too_large(spark, rows_a_bucket):
    sizes = [0, None, 10, 10, 11, 95, 3, 3, 3, 1] + [7] * 50 + [5]
    out = rows(spark, sizes, rows_a_bucket)
    loads = Counter()
    for name, capacities in SCHEMES.items():
        mine = [r for r in out if r["scheme"] == name]
        for i, s in enumerate(sizes):
            pieces = sorted((r["piece_no"], r["piece_tokens"]) for r in mine if r["doc_id"] == i)
            top, s = max(capacities), s or 0
            assert [p for p, _ in pieces] == list(range(max(1, -(-s // top))))
            assert sum(t for _, t in pieces) == s and all(t == top for _, t in pieces[:-1])
        kinds = {}
        for r in mine:
            loads[name, r["container_id"]] += r["piece_tokens"]
            assert kinds.setdefault(r["container_id"], r["capacity"]) == r["capacity"]
        assert all(loads[name, c] <= k for c, k in kinds.items())


def test_empty_and_only_empty_documents(spark):
    assert rows(spark, []) == []
    assert {(r["scheme"], r["container_id"], r["piece_tokens"]) for r in rows(spark, [0, None])} == {("small", 0, 0), ("mixed", 0, 0)}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 100_000), (5, "<|endoftext|>")], "doc_id long, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1000 and n[5] > 1


def test_more_containers_than_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(queries, "MAX_CONTAINERS", 2)
    with pytest.raises(ValueError, match="containers"):
        queries.p6_packed(spark, compare.SF)
