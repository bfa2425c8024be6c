"""Operators that SQL can't express, against brute force on small cases, and hand-worked values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import scalars as sc
from tessellar.operators import clusters, contacts, pca, relational, reshape, reweight, sequence, stats, topology, vectors

RNG = np.random.default_rng(4)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids or range(len(x)), x, strict=True)], "id long, v array<double>")


def test_state_reorder(spark):
    u = spark.createDataFrame([(0, 0, 0, 10.0), (0, 0, 1, 20.0)], "sim_no int, sim_iter int, replica int, u double")
    s = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 0)], "sim_no int, sim_iter int, replica int, state int")
    assert sorted((r["state"], r["u"]) for r in reshape.by_state(u, s).collect()) == [(0, 20.0), (1, 10.0)]


def test_global_frames_in_order(spark):
    rows = [(s, i) for s in (2, 10, 1) for i in range(5)]
    random.Random(1).shuffle(rows)
    out = reshape.global_frames(spark.createDataFrame(rows, "sim int, it int"), ["it"], "sim").collect()
    assert [r["frame"] for r in sorted(out, key=lambda r: (r["sim"], r["it"]))] == list(range(15))


def test_range_index(spark):
    values = [f"A:{random.Random(i).randrange(10**6):06}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    out = {r["v"]: r["id"] for r in contacts.dictionary(df, "v").collect()}
    assert out == {v: i for i, v in enumerate(sorted(set(values)))}
    assert contacts.dictionary(df.where("false"), "v").collect() == []


def test_rung_insertion(spark):
    ladder = spark.createDataFrame([(0, 0, 300.0), (0, 1, 310.0), (0, 2, 320.0)], "sim_no int, state int, temperature double")
    rates = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1)], "sim_no int, state int, rate double")
    out = sorted((r["state"], r["temperature"], r["source_state"]) for r in reshape.insert_rungs(ladder, rates, 0.4).collect())
    assert out == [(0, 300.0, 0), (1, 310.0, 1), (2, 315.0, 1), (3, 320.0, 2)]


def test_suffix_reset(spark):
    rows = [(0, i, ok) for i, ok in enumerate([True, False, True, True, False])]
    out = reshape.suffix_reset(spark.createDataFrame(rows, "g int, i int, ok boolean"), ["g"], "i", "ok").orderBy("i").collect()
    assert [r["steady"] for r in out] == [False, False, True, True]


def test_undirected_token_and_class(spark):
    from tessellar.functions.labels import atom_class, undirected_token

    df = spark.createDataFrame([("hbsb", ["A:ASP:155:O", "A:ARG:42:N"]), ("hbsb", ["A:ASP:155", "A:ASP:155"])], "t string, e array<string>")
    assert [r[0] for r in df.select(undirected_token(F.col("t"), F.col("e"))).collect()] == ["hbsb|A:ARG:42:N|A:ASP:155:O", None]
    names = spark.createDataFrame([(x,) for x in ("NH2", "od1", "CL", "ZN", "")], "n string")
    assert [r[0] for r in names.select(atom_class(F.col("n"))).collect()] == ["N", "O", "C", "X", "X"]


def test_set_distances(spark):
    sets = {0: "ab", 100: "a", 7: "bc", 8: "x"}
    t = spark.createDataFrame([(k, c) for k, s in sets.items() for c in s], "u int, t string")
    out = contacts.set_distances(t, t.where("u % 100 = 0").select("u").distinct(), "u", "t", 10).collect()
    for r in out:
        a, b = set(sets[r["a"]]), set(sets[r["b"]])
        assert r["jaccard"] == pytest.approx(1 - len(a & b) / len(a | b)) and r["hamming"] == pytest.approx(len(a ^ b) / 10)
    assert {(r["a"], r["b"]) for r in out} == {(0, 0), (0, 100), (100, 0), (100, 100), (0, 7)}


def test_band_natural_sort_and_division(spark):
    t = spark.createDataFrame([(f, "all") for f in range(100)] + [(1, "rare"), (2, None)] + [(f, "mid") for f in range(50)], "f int, t string")
    assert {(r["t"], r["n"]) for r in relational.band(t, "t", "f", 2, 95).collect()} == {("mid", 50)}
    df = spark.createDataFrame([(x,) for x in ("10.2", "2.50", "bad", "1.50", None)], "x string")
    assert [r[0] for r in df.orderBy(*relational.natural_key(F.col("x")), F.desc("x")).collect()][:3] == ["1.50", "2.50", "10.2"]
    held = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 1)], "e string, i int")
    assert [r[0] for r in relational.divide(held, "e", "i", held.select("i")).collect()] == ["p"]
    assert {r[0] for r in relational.divide(held, "e", "i", held.select("i").where("false")).collect()} == {"p", "q"}


def test_islands(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 2, 3, 7, None, 9, 10)], "g string, n int")
    assert {(r["start"], r["stop"], r["length"]) for r in relational.islands(df, ["g"], "n", 2).collect()} == {(1, 3, 3), (9, 10, 2)}


@pytest.mark.parametrize("nearest", [None, 3])
def test_blocked_distances(spark, nearest, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    x = RNG.normal(size=(40, 5))
    df = frame(spark, x).unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    out = vectors.blocked_distances(df, df.where("id < 5"), "id", "v", nearest=nearest).collect()
    want = np.sqrt(((x[:5, None] - x[None]) ** 2).mean(axis=2))
    for r in out:
        assert r["d"] == pytest.approx(want[r["i"], r["j"]], abs=1e-7)
    assert len(out) == 5 * (nearest or 40)
    if nearest:
        assert all(sorted(r["j"] for r in out if r["i"] == i) == sorted(np.argsort(want[i])[:3].tolist()) for i in range(5))


def test_torsion_wrap():
    assert vectors.periodic_rms(360.0)(np.array([[177.6]]), np.array([[-177.6]]))[0, 0] == pytest.approx(4.8)


def test_within_equals_brute_force(spark):
    x = RNG.uniform(-1, 1, size=(120, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(500, None, 0.0, 0.0)], "id long, x double, y double, z double")
    out = {(r["i"], r["j"]) for r in vectors.within(df, df.where("id < 20"), "id", ["x", "y", "z"], 0.3).collect()}
    d = np.linalg.norm(x[:20, None] - x[None], axis=2)
    assert out == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.3), strict=True)}


def test_superposition(spark):
    ref = RNG.normal(size=(9, 3))
    q, _ = np.linalg.qr(RNG.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    out = vectors.superpose(frame(spark, [(ref @ q + 5).ravel(), (ref * [1, 1, -1]).ravel()]), "id", "v", ref.ravel().tolist()).orderBy("id").collect()
    assert out[0]["rmsd"] == pytest.approx(0, abs=1e-6) and np.allclose(out[0]["xyz"], ref.ravel()) and out[1]["rmsd"] > 0.05


def test_rounding_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate((-1.8e-6, 1.8e-6, -6e-6, 0.0, float("nan"), None))], "k int, x double")
    assert [str(r[0]) for r in df.orderBy("k").select(sc.signed_round(F.col("x"), 5)).collect()] == ["-0.0", "0.0", "-1e-05", "0.0", "nan", "None"]


def test_grid_sum_and_truncation(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0, 2.0), (1.0, 0.0, 0.0, 1.0)], "x double, y double, z double, w double")
    g = vectors.grid_sum(p, ["x", "y", "z"], "w", [0, 0, 0], [1, 1, 1], [2, 1, 3])
    assert {(r["i"], r["k"]): round(r["val"], 6) for r in g.collect()}[0, 0] == 2.5
    assert {(r["i"], r["j"], r["k"]) for r in vectors.truncate_grid(g, [1, 0, 1], [1, 1, 2]).collect()} == {(0, 0, 0), (0, 0, 1)}


def test_components_against_numpy(spark):
    x = RNG.normal(size=(60, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    m = pca.fit(frame(spark, x), "v")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(m.ratios, values / values.sum())
    scores = np.array([r["scores"] for r in pca.transform(frame(spark, x), "id", "v", m).orderBy("id").collect()])
    assert np.allclose(scores.var(axis=0, ddof=1), values) and np.allclose(scores.mean(axis=0), 0)
    assert pca.kept(np.array([0.6, 0.25, 0.08, 0.07]), 0.9) == 3 and pca.kept(np.array([0.6, 0.25, 0.08, 0.07]), 0.9, compat=True) == 2
    missing = spark.createDataFrame([(0, [None] * 6)], "id long, v array<double>")
    assert np.allclose(pca.transform(missing, "id", "v", m).first()["scores"], 0)


def test_model_round_trip(spark, tmp_path):
    m = pca.fit(frame(spark, RNG.normal(size=(20, 3))), "v", 0.8)
    pca.save(spark, m, str(tmp_path / "m"))
    back = pca.load(spark, str(tmp_path / "m"))
    assert all(np.allclose(a, b) for a, b in ((m.mean, back.mean), (m.vectors, back.vectors), (m.ratios, back.ratios)))


def test_state_weights(spark):
    u, n = RNG.normal(size=(50, 3)), [20, 20, 10]
    f, w = reweight.state_weights(frame(spark, u).withColumnRenamed("v", "u"), "id", "u", n, 1e-10, 400)
    weights = np.array([r["weights"] for r in w.orderBy("id").collect()])
    assert np.allclose(weights.sum(axis=0), 1, atol=1e-6)
    g = np.zeros(3)
    for _ in range(400):
        g = -np.log(np.exp(-u - np.log((np.array(n) * np.exp(g - u)).sum(1))[:, None]).sum(0))
        g -= g[0]
    assert np.allclose(f, g, atol=1e-6)
    _, one = reweight.state_weights(frame(spark, u[:7, :1]).withColumnRenamed("v", "u"), "id", "u", [7])
    assert np.allclose([r["weights"][0] for r in one.collect()], 1 / 7)


def test_systematic_resample(spark):
    w = RNG.uniform(0, 3, size=80)
    df = spark.createDataFrame([(i % 7, i, float(x)) for i, x in enumerate(w)], "b int, i int, w double")
    out = {r["i"]: r["copies"] for r in reweight.systematic_resample(df, ["b", "i"], "w", 1000).collect()}
    assert sum(out.values()) == 1000 and all(abs(out[i] - 1000 * x / w.sum()) < 1.001 for i, x in enumerate(w))


def test_settling():
    x = np.concatenate([np.linspace(10, 0, 60), RNG.normal(size=400)])
    t, g, n = reweight.settled(x)
    assert 40 <= t <= 90 and 1 <= g < 3 and n > 150
    assert reweight.settled(np.ones(5)) == (0, 1.0, 6.0) and reweight.settled(np.array([1.0]))[0] == 0


def test_frobenius_and_jensen_shannon(spark):
    for n, want in ((3, 0.1), (5, 0.05)):
        cells = spark.createDataFrame([(i, j, 0.3, 0.2) for i in range(n) for j in range(i, n)], "i int, j int, a double, b double")
        assert stats.frobenius(cells, n).first()["norm"] == pytest.approx(want)
    h = spark.createDataFrame([("k", b, 0.5) for b in (0, 1)], "k string, bin long, density double")
    other = h.withColumn("bin", F.col("bin") + 2)
    assert stats.jensen_shannon(h, h, ["k"], 4).first()["jsd"] == pytest.approx(0, abs=1e-9)
    assert stats.jensen_shannon(h, other, ["k"], 4).first()["jsd"] == pytest.approx(1, abs=1e-3)


def test_kernel_density(spark):
    x = RNG.normal(size=(60, 2)) @ [[1, 0.3], [0, 2]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double")
    out = {(r["i"], r["j"]): r["density"] for r in stats.kernel_density(df, "x", "y", 12).collect()}
    cov = np.cov(x.T) * 60 ** (-1 / 3)
    inv, gx, gy = np.linalg.inv(cov), np.linspace(x[:, 0].min(), x[:, 0].max(), 12), np.linspace(x[:, 1].min(), x[:, 1].max(), 12)
    for (i, j), d in out.items():
        e = np.array([gx[i], gy[j]]) - x
        assert d == pytest.approx(np.exp(-np.einsum("na,ab,nb->n", e, inv, e) / 2).sum() / (60 * 2 * np.pi * np.sqrt(np.linalg.det(cov))))


def test_density_clusters(spark):
    x = [(i, 0.1 * i, 0.0) for i in range(60)] + [(100 + i, 50 + 0.01 * i, 50.0) for i in range(30)] + [(200, -80.0, 3.0), (201, None, 1.0)]
    df = spark.createDataFrame([(i, float(a) if a is not None else None, b) for i, a, b in x], "id long, x double, y double")
    out = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, "id", ["x", "y"], 0.5, 3).collect()}
    assert out[200] is None and out[201] is None
    assert len({out[i] for i in range(60)}) == 1 and len({out[100 + i] for i in range(30)}) == 1 and out[0] != out[100]


def test_chain_of_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    edges = spark.createDataFrame([e for a, b in links for e in ((a, b), (b, a))], "a long, b long")
    nodes = edges.select(F.col("a").alias("node")).distinct()
    out = {r["node"]: r["component"] for r in clusters.components(edges, nodes).collect()}
    assert {out[i] for i in range(41)} == {0} and out[101] == 100


def test_selection_language(spark):
    df = spark.createDataFrame([(1, "CA", "ALA", 5, "A", "C"), (2, "O", "HOH", 9, "W", "O"), (3, "N", "GLY", 7, "B", "N")], "atom_index int, atom_name string, res_name string, res_seq int, chain_id string, element string")
    got = lambda s: [r[0] for r in df.where(topology.select(s)).orderBy("atom_index").collect()]
    assert got("protein and not chainid B") == [1] and got("resSeq 6:9 or name CA") == [1, 2, 3] and got("(resname HOH GLY) and element O") == [2] and got("all") == [1, 2, 3]
    for bad in ("", "resname", "colour red", "(all", "all all", "resSeq x"):
        with pytest.raises(ValueError):
            topology.select(bad)


def test_topology_tables(spark):
    a = spark.createDataFrame([(0, "C", 12.0), (1, "H", 1.0), (2, "H", 1.0), (3, "O", 16.0)], "idx int, element string, mass double")
    b = spark.createDataFrame([(0, 1), (2, 0), (0, 3)], "i int, j int")
    out = {r["idx"]: r["mass"] for r in topology.repartition_mass(a, b, 3.0).collect()}
    assert out == {0: 8.0, 1: 3.0, 2: 3.0, 3: 16.0}
    terms = spark.createDataFrame([(1, [0, 1, 2]), (2, [0, 3, 9]), (3, [2, 0, 1])], "term_id int, members array<int>")
    mapping = spark.createDataFrame([(0, 10), (1, 11), (2, 12), (3, 13)], "old int, new int")
    assert {r["term_id"]: r["members"] for r in topology.remap_terms(terms, "members", mapping).collect()} == {1: [10, 11, 12], 3: [12, 10, 11]}
    q = topology.spread_charge(spark.createDataFrame([("r", 0.31), ("r", 0.72)], "g string, q double"), "g", "q")
    assert q.agg(F.sum("q")).first()[0] == pytest.approx(1.0)


def test_sequences(spark):
    df = spark.createDataFrame([("CDE", "ABCDEF"), ("XBZ", "ABCABC"), ("ABCDEFGH", "CDE"), ("", "ABC")], "q string, r string")
    out = [tuple(r) for r in df.select(sequence.best_offset(F.col("q"), F.col("r")).alias("b")).select("b.matches", "b.start").collect()]
    assert out == [(3, 2), (1, 0), (0, 0), (0, 0)]
    assert sorted(sequence.average_linkage_order([[0], [10], [0.1], [10.2]])[:2]) == [0, 2] and sequence.average_linkage_order([]) == []


def test_scalar_formulas(spark):
    row = spark.range(1).select(
        sc.periodic_difference(F.lit(177.6), F.lit(-177.6), F.lit(360.0)), sc.nearest_image(F.lit(7.0), F.lit(10.0)), sc.heaviside(F.lit(0.0)), sc.harmonic_mean(F.lit(2.0), F.lit(6.0)), sc.one_letter(F.lit("hie")), sc.sigmoid_blend(F.lit(0.0), 0.0, 1.0, 2.0, 4.0), sc.rms_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(4.0)))
    ).first()
    assert [round(x, 6) if isinstance(x, float) else x for x in row] == [4.8, -3.0, 0.5, 3.0, "H", 3.0, round(math.sqrt(2), 6)]


def test_stores(spark, tmp_path):
    from tessellar.sources import store

    calls = []

    def made():
        calls.append(1)
        return spark.range(3)

    source, cache = str(tmp_path / "s"), str(tmp_path / "c")
    assert store.compute_or_load(spark, "m", made, source, read_only=True).count() == 3
    assert store.compute_or_load(spark, "m", made, source, cache).count() == 3
    assert store.compute_or_load(spark, "m", made, source, cache).count() == 3 and len(calls) == 2
    assert store.load(spark, "other", source) is None and store.write_root("s", None, True) is None


def test_text_sources(spark):
    from tessellar.sources import text

    lines = spark.createDataFrame([("# c",), ("",), ("1 sb A:B:1:C D:E:2:F W:HOH:3:O",), ("1 sb A",), (None,)], "value string")
    assert [(r["frame"], r["itype"], len(r["atoms"])) for r in text.contact_lines(lines).collect()] == [("1", "sb", 3)]
    pdb = spark.createDataFrame([("ATOM      1  CA  ALA A   5      11.104   6.134  -6.504  1.00  0.00           C",), ("HETATM    2  O   HOH W   9       x.xxx   6.134  -6.504  1.00  0.00           O",), ("TER",)], "value string")
    out = [tuple(r) for r in text.atom_records(pdb).select("record", "serial", "atom_name", "res_name", "chain_id", "res_seq", "x", "z", "element").collect()]
    assert out == [("ATOM", 1, "CA", "ALA", "A", 5, 11.104, -6.504, "C"), ("HETATM", 2, "O", "HOH", "W", 9, None, -6.504, "O")]


def test_trajectory_and_settings(spark, tmp_path):
    from tessellar.sources import config, trajectory

    frames = RNG.normal(size=(4, 5, 3)).astype("f4")
    data = trajectory.encode(frames)
    assert (trajectory.decode(data) == frames).all() and trajectory.decode(trajectory.encode(frames[:0])).shape == (0, 5, 3)
    with pytest.raises(ValueError):
        trajectory.decode(data[:-7])
    config.write_json({"a": [1, "é"]}, str(tmp_path / "c.json"))
    assert config.read_json(str(tmp_path / "c.json")) == {"a": [1, "é"]}


@pytest.mark.parametrize("most", [1000, 3])
def test_nearest_centroid_either_way(spark, most):
    x, c = RNG.normal(size=(60, 6)), RNG.normal(size=(9, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    centres = spark.createDataFrame([(10 + k, v.tolist()) for k, v in enumerate(c)], "g int, centroid array<double>")
    out = {r["i"]: (r["g"], r["d"]) for r in vectors.nearest_centroid(rows, "i", "v", centres, "g", most).collect()}
    d = np.sqrt(((x[:, None] - c[None]) ** 2).mean(axis=2))
    assert {i: g for i, (g, _) in out.items()} == {i: 10 + int(k) for i, k in enumerate(d.argmin(axis=1))}
    assert np.allclose([out[i][1] for i in range(60)], d.min(axis=1))


def test_files_in_parts(spark, tmp_path):
    """A group's rows go over several files, in order, and a repeated write replaces them."""
    from tessellar.sources import arrays, files, trajectory

    rows = [(g, i, float(i * k)) for k, g in enumerate("ab", 1) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, frame int, x double").repartition(3)
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/address"):
        for _ in range(2):
            assert sorted(r["n"] for r in arrays.write_npy(df, "g", ["frame", "x"], folder, rows_per_file=4).collect()) == [2, 2, 4, 4, 4, 4]
        back = arrays.read_npy(spark, folder)
        g, part = files.group_of("path", "npy")
        got = sorted((r["g"], r["part"] * 4 + r["row"], *r["values"]) for r in back.select(g.alias("g"), part.alias("part"), "row", "values").collect())
        assert got == sorted((g, i, float(i), x) for g, i, x in rows)
    assert "MODEL" in trajectory.pdb_models(np.zeros((1, 2, 3)))


def test_failed_batches_are_made_up_for(spark, tmp_path):
    from tessellar.streaming.incremental import process_new_files

    for k in range(3):
        spark.createDataFrame([(k,)], "x int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    done, broken = [], [True]

    def work(df, batch):
        found = [r["x"] for r in df.collect()]
        if 1 in found and broken[0]:
            raise ValueError("not now")
        done.extend(found)

    run = lambda: process_new_files(spark, f"{tmp_path}/in", "x int", work, f"{tmp_path}/check", files_per_batch=1)
    assert len(run()) == 1 and sorted(done) == [0, 2]
    assert len(run()) == 1 and sorted(done) == [0, 2]
    broken[0] = False
    assert run() == [] and sorted(done) == [0, 1, 2]
    assert run() == [] and sorted(done) == [0, 1, 2]


def test_loop_goes_on_after_what_is_complete(spark, tmp_path):
    from tessellar.streaming.incremental import run_loop

    made = []

    def produce(k):
        made.append(k)
        return spark.createDataFrame([(k * k,)], "v int")

    root = f"file://{tmp_path}/loop"
    assert run_loop(spark, root, produce, lambda parts: False, 3) == (3, False)
    (tmp_path / "loop" / "part=2" / "_SUCCESS").unlink()  # cut off while it was written
    assert run_loop(spark, root, produce, lambda parts: parts.count() >= 5, 9) == (5, True)
    assert run_loop(spark, root, produce, lambda parts: parts.count() >= 5, 9) == (5, True)
    assert made == [0, 1, 2, 2, 3, 4]


def test_windows_over_several_batches(spark, tmp_path):
    from tessellar.streaming.incremental import windowed_counts

    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 23:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-01 23:30:00", "a")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, k string").selectExpr("cast(ts as timestamp_ntz) as ts", "k").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = windowed_counts(spark, f"{tmp_path}/in", "ts timestamp_ntz, k string", "ts", "k", "1 day", "3 hours", "*.parquet", files_per_batch=1)
    assert sorted((str(r["start"]), r["k"], r["n"]) for r in out.collect()) == [("2024-01-01 00:00:00", "a", 3), ("2024-01-02 00:00:00", "b", 1)]


def test_sub_grid_must_match_once(spark):
    from tessellar.sources import grids

    g = spark.createDataFrame([(i, 0, 0) for i in range(4)], "i long, j long, k long")
    part = spark.createDataFrame([(0.1 + 0.2, 0.0, 0.0)], "x double, y double, z double")
    assert [r["i"] for r in grids.match_subgrid(part, g, [0.0] * 3, [0.1] * 3).collect()] == [3]
    for bad in (g.where("i < 3"), g.unionByName(g)):
        with pytest.raises(ValueError):
            grids.match_subgrid(part, bad, [0.0] * 3, [0.1] * 3)


def test_weights_that_do_not_settle_are_an_error(spark):
    u = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(20)], "i long, u array<double>")
    with pytest.raises(RuntimeError, match="after 1 passes"):
        reweight.state_weights(u, "i", "u", [10, 10], 1e-12, 1)


def test_files_of_a_stage_go(spark):
    import os

    from tessellar import session

    df = session.materialise(spark.range(3))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    session.discard(df)
    assert not os.path.isdir(folder)
