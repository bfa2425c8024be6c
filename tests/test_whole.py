"""Queries that take all of their input: what a cut would lose is in the result."""

import glob

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import compare
from tessellar.operators import contacts, reweight, sequence
from tessellar.plans import core_problems, registry
from tessellar.plans.core_problems_sql import CONTACT_CELLS
from tessellar.session import shared_dir

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    return compare.views(duckdb.connect())


def test_pivots_take_every_system(spark, con):
    cells = con.execute(f"WITH {CONTACT_CELLS} SELECT contact, system, frequency FROM cells").df()
    wide = cells.pivot_table(index="contact", columns="system", values="frequency", fill_value=0)
    mean = wide.mean(axis=1).round(12)
    top = sorted(mean.index, key=lambda c: (-mean[c], c))[:40]
    assert {r["contact"] for r in QUERIES["agg09_row_mean_top"](spark, compare.SF).collect()} == set(top)
    names = sorted(top)
    want = [names[i] for i in sequence.average_linkage_order(wide.loc[names].to_numpy())]
    assert [r["contact"] for r in QUERIES["mat21_leaf_order"](spark, compare.SF).orderBy("place").collect()] == want
    for name in ("agg07_pivot_sum", "agg08_pivot_mean_filled"):
        df = QUERIES[name](spark, compare.SF)
        n = df.agg(F.count("*"), F.sum(F.size("other_systems"))).first()
        panel = cells[cells.system.isin(df.columns)]
        assert n[0] == cells.contact.nunique() and n[1] == len(cells) - len(panel)


def test_multi_hot_has_every_token_of_the_band(spark):
    held = {0: [f"t{k:02d}" for k in range(30)] + ["all"], 1: ["t29", "all"], 3: ["all"], 4: ["all", "t00"]}
    t = spark.createDataFrame([(f, x) for f, xs in held.items() for x in xs], "frame int, token string")
    out = {r["frame"]: r["bits"] for r in contacts.multi_hot_band(t, 1, 95).collect()}
    columns = [f"t{k:02d}" for k in range(30)]  # without the one that all frames hold
    assert out == {f: [int(c in held.get(f, [])) for c in columns] for f in range(5)}
    with pytest.raises(ValueError, match="30 tokens"):
        contacts.multi_hot_band(t, 1, 95, most=29)


def plain_settled(x):
    """Every start, one by one."""
    best = (0, 1.0, 1.0)
    for t in range(max(len(x) - 1, 1)):
        g = reweight.statistical_inefficiency(x[t:])
        if (len(x) - t + 1) / g > best[2]:
            best = (t, g, (len(x) - t + 1) / g)
    return best


def test_settling_tries_every_start_of_long_series(spark):
    rng, series = np.random.default_rng(8), []
    for k in range(4):
        x, noise = np.zeros(2650), rng.normal(size=2650)
        for i in range(1, len(x)):
            x[i] = 0.9 * x[i - 1] + noise[i]
        series.append(x + 20 * np.exp(-np.arange(len(x)) / (40 + 60 * k)))
    series += [np.r_[rng.normal(size=50) + 5, np.ones(400)], np.ones(7), np.array([1.0, 2.0]), np.arange(60.0)]
    df = spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(series) for i, v in enumerate(x)], "s int, f int, v double")
    out = {r["s"]: (r["t0"], r["g"], r["n_independent"]) for r in reweight.equilibration(df, ["s"], "f", "v").collect()}
    assert out == {k: plain_settled(x) for k, x in enumerate(series)}


def test_every_atom_counts(spark, con):
    v = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    e = np.array([x for _, x in v])
    xyz = e[:, :63].reshape(len(e), 21, 3)
    a, b = np.triu_indices(21, 1)
    pairs = np.linalg.norm(xyz[:, a] - xyz[:, b], axis=2)
    near = pairs[:, pairs[0] <= 0.25]
    turn = np.abs(e[:, None] - e[None]) * 360 % 360
    parts = [np.sqrt((np.minimum(turn, 360 - turn) ** 2).mean(axis=2))] + [np.sqrt(((f[:, None] - f[None]) ** 2).mean(axis=2)) for f in (pairs, near)]
    at = {i: k for k, (i, _) in enumerate(v)}
    for name, want in (("mat11_close_pair_features", parts[2]), ("mat12_weighted_sum", 0.333 * sum(parts))):
        rows = QUERIES[name](spark, compare.SF).collect()
        assert len(rows) == len(e) * sum(i % 100 == 0 for i in at)
        assert np.allclose([r["d"] for r in rows], [want[at[r["i"]], at[r["j"]]] for r in rows], atol=6e-5)
    bundle = QUERIES["mat30_matrix_bundle"](spark, compare.SF).where("matrix = 'pairs'").collect()
    assert np.allclose([r["d"] for r in bundle], [parts[1][at[r["i"]], at[r["j"]]] for r in bundle], atol=2e-6)


def test_pairs_without_a_shared_token(spark):
    sets = {0: "ab", 100: "", 7: "bc", 8: "x", 9: ""}
    t = spark.createDataFrame([(k, c) for k, s in sets.items() for c in s], "u int, t string")
    units = spark.createDataFrame([(k,) for k in sets], "u int")
    out = {(r["a"], r["b"]): r for r in contacts.all_set_distances(t, units.where("u % 100 = 0"), units, "u", "t").collect()}
    assert set(out) == {(a, b) for a in (0, 100) for b in sets}
    for (a, b), r in out.items():
        x, y = set(sets[a]), set(sets[b])
        assert r["jaccard"] == pytest.approx(1 - len(x & y) / len(x | y) if x | y else 0) and r["hamming"] == pytest.approx(len(x ^ y) / 4)


def rows_in(folder):
    return sum(pq.read_metadata(p).num_rows for p in glob.glob(f"{folder.removeprefix('file://')}/*.parquet"))


def test_pairs_of_frames_are_not_written(spark):
    """Their number grows with the square of the log."""
    known = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/*"))
    out = QUERIES["mat10_jaccard"](spark, compare.SF)
    frames = out.select("b").distinct().count()
    new = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/*")) - known
    assert out.count() == frames * -(-frames // 100) and 0 < sum(map(rows_in, new)) <= 1.01 * frames + 1


def test_frames_meet_their_queries_without_a_shuffle(spark):
    """A shuffle would repeat the whole log for every block of queries."""
    plan = QUERIES["mat09_hamming"](spark, compare.SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_equal_distances_are_neighbours(spark):
    """Else a file of the pairs has hardly a run of equal values, and takes half as much disk again."""
    rng = np.random.default_rng(5)
    often = rng.random((600, 8)) < 0.8
    sets = [[f"often{t}" for t in np.flatnonzero(often[u])] + [f"rare{t}" for t in rng.choice(4_000, 8, replace=False)] for u in range(600)]
    tokens = spark.createDataFrame([(u, t) for u, s in enumerate(sets) for t in s], "u int, t string")
    units = spark.range(600).select(F.col("id").cast("int").alias("u"))
    out = contacts.all_set_distances(tokens, units.where("u % 3 = 0"), units, "u", "t", ("n_shared", "hamming"), 9).toPandas()
    runs = [[int((df[c].diff() != 0).sum()) for c in ("n_shared", "hamming")] for df in (out, out.sort_values(["b", "a"]))]
    assert len(out) == 600 * 200 and all(2 * now < plain for now, plain in zip(*runs))


def test_last_frame_with_a_token(spark):
    """Tokens of the whole log aren't worked out to find it, unless its end has none."""
    log = [(3, "hbsb", "A:ASP:1:O", "A:ARG:2:N"), (7, "vdw", "A:ASP:1:O", "A:ARG:2:N"), (9, "vdw", "A:ASP:1:O", "A:ASP:1:N"), (10, None, "A:ASP:1:O", "A:ARG:2:N"), (None, "vdw", "A:ASP:1:O", "A:ARG:2:N")]
    for upto, want in ((5, 7), (2, 7), (1, 3), (0, None)):
        t = contacts.token_rows(contacts.spelt_log(spark.createDataFrame(log[:upto] if upto else log[2:], "frame int, interaction_type string, atom1 string, atom2 string")))
        assert contacts.last_with_token(t) == want


@pytest.mark.parametrize("digits", [9, None])
@pytest.mark.parametrize("largest", [12, 300])
def test_packed_pairs_are_those_of_single_rows(spark, monkeypatch, largest, digits):
    """A row for each pair from Python costs most of the time; packed ones must give the same, to the last bit."""
    monkeypatch.setattr(contacts, "PACKED_PAIRS", 70)
    rng = np.random.default_rng(3)
    sets = [rng.choice(500, int(n), replace=False).tolist() for n in (*rng.integers(0, 12, 90), 0, 0, largest)]
    tokens = spark.createDataFrame([(u, f"t{t}") for u, s in enumerate(sets) for t in s], "u int, t string")
    units = spark.range(len(sets)).select(F.col("id").cast("int").alias("u"))
    made = []
    for most in (2**15 - 1, -1):
        monkeypatch.setattr(contacts, "PACKED_TOKENS", most)
        for scaled in (False, True):
            out = contacts.all_set_distances(tokens, units.where("u % 3 = 0"), units, "u", "t", digits=digits, scaled=scaled)
            packed = "Generate" in out._jdf.queryExecution().executedPlan().toString()
            assert packed == (most > 0) and (not packed or not any(f.nullable for f in out.schema))
            made.append(sorted(map(tuple, out.collect())))
    assert made[0] == made[2] and made[1] == made[3] and len(made[0]) == 31 * 93
    bare = contacts.all_set_distances(tokens.where("false"), units.where("u = 0"), units, "u", "t")
    assert bare.count() == 93
    monkeypatch.setattr(contacts, "PACKED_TOKENS", 2**15 - 1)
    assert {tuple(r)[2:] for r in contacts.all_set_distances(tokens.where("false"), units.where("u = 0"), units, "u", "t", scaled=True).collect()} == {(0, 0.0, None)}


@pytest.mark.parametrize("block, cells", [(1_000, 32_000_000), (7, 32_000_000), (1_000, 60), (7, 1)])
def test_sets_meet_in_blocks_of_any_size(tmp_path, monkeypatch, block, cells):
    for name, v in (("QUERY_BLOCK", block), ("MATRIX_CELLS", cells), ("OUT_ROWS", 40)):
        monkeypatch.setattr(contacts, name, v)
    rng = np.random.default_rng(11)
    sets = [set(rng.choice(400, int(n), replace=False).tolist()) for n in (*rng.integers(0, 12, 90), 0, 0, 300, 350)]
    all_, asked = [pa.record_batch({"id": pa.array(ids, pa.int64()), "t": pa.array([sorted(sets[i]) for i in ids], pa.list_(pa.int64()))}) for ids in (range(94), range(3, 94, 5))]
    for k, part in enumerate((asked.slice(0, 11), asked.slice(11), asked.slice(0, 0))):
        pq.write_table(pa.Table.from_batches([part]), tmp_path / f"part-{k}.parquet")
    folder = f"file:{tmp_path}"
    union = {(a, b): len(sets[a] | sets[b]) for a in range(3, 94, 5) for b in range(94)}
    shared = {(a, b): len(sets[a] & sets[b]) for a, b in union}
    far = {p: 1 - shared[p] / n if n else 0.0 for p, n in union.items()}
    got = [r for b in contacts._distances(folder, "int", ("n_shared", "jaccard", "hamming"), 400, 0.8, 9)([all_.slice(0, 50), all_.slice(50)]) for r in b.to_pylist()]
    assert len(got) == len(union) and {(r["a"], r["b"]): r["n_shared"] for r in got} == shared
    assert all(abs(r["jaccard"] - far[r["a"], r["b"]] / 0.8) < 1e-9 and abs(r["hamming"] - (union[r["a"], r["b"]] - shared[r["a"], r["b"]]) / 400) < 1e-9 for r in got)
    for part in (all_, all_.slice(93)):
        top = max(far[a, b] for a, b in far if b in part.column("id").to_pylist())
        assert [b.to_pylist() for b in contacts._largest_jaccard(folder)([part])] == [[{"top": top}]]


def test_density_has_the_whole_grid(spark):
    assert QUERIES["mat22_kernel_density"](spark, compare.SF).count() == 100 * 100


def test_more_types_than_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(core_problems, "MAX_TYPES", 15)
    for run in (core_problems.p3_found, core_problems.p3_rows):
        with pytest.raises(ValueError, match="interaction types"):
            run(spark, compare.SF)


def test_some_ladders_lack_rungs(spark):
    """What fills them has something to do: by the data, not by a filter on the rows."""
    missing = QUERIES["join14_missing_rungs"](spark, compare.SF).count()
    assert missing > 0 and QUERIES["mat03_backfill"](spark, compare.SF).select("sim_no", "state").distinct().count() > 0
