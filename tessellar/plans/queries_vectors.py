"""Queries of vectors, matrices, series, sequences, text sources and the incremental loop, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import scalars as sc
from tessellar.operators import contacts as ct
from tessellar.operators import pca, reweight, sequence, stats, topology, vectors
from tessellar.operators import relational as rel
from tessellar.operators import reshape as rs
from tessellar.plans.catalog import query
from tessellar.plans.queries_tables import BIND, ENERGY, LADDER, LOG, MONTHS, binding, checkpoints, energies, ladders, log, tokens
from tessellar.session import materialise, table
from tessellar.sources import text

S = SparkSession
# The stated query set of searches: every id divisible by 100, against all rows.
VEC = "v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)"


def embeddings(spark: S, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def queried(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return df.where(F.pmod(F.col(id_col), F.lit(100)) == 0)


def _ij(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("i", "j", F.round("d", digits).alias("d"))


@query("join05_rms_to_all", f"WITH {VEC} SELECT q.vec_id AS i, v.vec_id AS j, round(sqrt(list_sum([(a - b) * (a - b) FOR a, b IN list_zip(q.e, v.e)]) / 64), 6) AS d FROM q, v".replace("[(a - b) * (a - b) FOR a, b IN list_zip(q.e, v.e)]", "list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"))
def mat05(spark: S, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return _ij(vectors.blocked_distances(e, queried(e), "vec_id", "embedding"))


@query("join05_nearest", f"WITH {VEC} SELECT i, j, d FROM (SELECT q.vec_id AS i, v.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64), 6) AS d FROM q, v) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10")
def mat05n(spark: S, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return _ij(vectors.blocked_distances(e, queried(e), "vec_id", "embedding", nearest=10))


def angles(spark: S, d: str) -> DataFrame:
    return embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 360).alias("a"))


@query("mat07_torsion_distance", f"WITH {VEC} SELECT q.vec_id AS i, v.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: power(least(abs(z[1] - z[2]) * 360 % 360, 360 - abs(z[1] - z[2]) * 360 % 360), 2))) / 64), 5) AS d FROM q, v")
def mat07(spark: S, d: str) -> DataFrame:
    a = angles(spark, d)
    return _ij(vectors.blocked_distances(a, queried(a), "vec_id", "a", vectors.periodic_rms(360.0)), 5)


ATOMS = 21  # the last of the 64 components belongs to no atom
_DISTANCE = "sqrt(power(e[3 * ab[1] + 1] - e[3 * ab[2] + 1], 2) + power(e[3 * ab[1] + 2] - e[3 * ab[2] + 2], 2) + power(e[3 * ab[1] + 3] - e[3 * ab[2] + 3], 2))"
_PAIRS = "ab AS (SELECT [a, b] AS ab FROM range(21) x(a), range(21) y(b) WHERE b > a)"
_FEATURES = f"""{_PAIRS}, f AS (SELECT vec_id, label, list_transform(p.p, lambda ab: {_DISTANCE}) AS f FROM v, (SELECT list(ab ORDER BY ab) AS p FROM ab) p)"""
_NEAR = f"""near AS (SELECT list(ab ORDER BY ab) AS p FROM ab, (SELECT e FROM v ORDER BY vec_id LIMIT 1) WHERE {_DISTANCE} <= 0.25),
 h AS (SELECT vec_id, list_transform(near.p, lambda ab: {_DISTANCE}) AS f FROM v, near)"""


def _rms_sql(table: str, col: str) -> str:
    square = f"list_sum(list_transform(list_zip(a.{col}, b.{col}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT a.vec_id AS i, b.vec_id AS j, sqrt({square} / len(a.{col})) AS d FROM {table} a, {table} b WHERE a.vec_id % 100 = 0"


_TURNS = "SELECT q.vec_id AS i, v.vec_id AS j, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: power(least(abs(z[1] - z[2]) * 360 % 360, 360 - abs(z[1] - z[2]) * 360 % 360), 2))) / 64) AS d FROM q, v"


def atom_pairs(e: DataFrame) -> DataFrame:
    return vectors.pair_features(e, "vec_id", "embedding", ATOMS)


def near_pairs(e: DataFrame) -> DataFrame:
    """Pairs that are close in the first frame, as in the reference."""
    first = e.orderBy("vec_id").select("embedding").first()[0][: 3 * ATOMS]
    return vectors.pair_features(e, "vec_id", "embedding", ATOMS, vectors.close_pairs(first, 0.25))


@query("mat08_pair_distance_features", f"WITH {VEC}, {_FEATURES} SELECT i, j, round(d, 6) AS d FROM ({_rms_sql('f', 'f')})")
def mat08(spark: S, d: str) -> DataFrame:
    f = atom_pairs(embeddings(spark, d))
    return _ij(vectors.blocked_distances(f, queried(f), "vec_id", "features"))


@query("mat11_close_pair_features", f"WITH {VEC}, {_PAIRS}, {_NEAR} SELECT i, j, round(d, 6) AS d FROM ({_rms_sql('h', 'f')})")
def mat11(spark: S, d: str) -> DataFrame:
    f = near_pairs(embeddings(spark, d))
    return _ij(vectors.blocked_distances(f, queried(f), "vec_id", "features"))


@query("mat12_weighted_sum", f"WITH {VEC}, {_FEATURES}, {_NEAR}, t AS ({_TURNS}), a AS ({_rms_sql('f', 'f')}), c AS ({_rms_sql('h', 'f')}) SELECT i, j, round(0.333 * t.d + 0.333 * a.d + 0.333 * c.d, 4) AS d FROM t JOIN a USING (i, j) JOIN c USING (i, j)")
def mat12(spark: S, d: str) -> DataFrame:
    """Torsions, all pairs and close pairs, a third each."""
    e, a = embeddings(spark, d), angles(spark, d)
    parts = [(a, "a", vectors.periodic_rms(360.0)), (atom_pairs(e), "features", vectors.rms), (near_pairs(e), "features", vectors.rms)]
    return _ij(vectors.weighted_sum([(vectors.blocked_distances(f, queried(f), "vec_id", c, metric), 0.333) for f, c, metric in parts]), 4)


@query("mat30_matrix_bundle", f"""WITH {VEC}, {_FEATURES}, w AS (SELECT vec_id, e FROM v) SELECT 'torsion' AS matrix, i, j, round(d, 5) AS d FROM ({_TURNS})
 UNION ALL SELECT 'pairs', i, j, round(d, 6) FROM ({_rms_sql('f', 'f')}) UNION ALL SELECT 'vectors', i, j, round(d, 6) FROM ({_rms_sql('w', 'e')})""")
def mat30(spark: S, d: str) -> DataFrame:
    parts = {"torsion": mat07(spark, d), "pairs": mat08(spark, d), "vectors": mat05(spark, d)}
    tagged = [df.select(F.lit(name).alias("matrix"), "i", "j", "d") for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


_PAIRS_OF_FRAMES = """s AS (SELECT fr.frame, count(token) AS n FROM (SELECT unnest(range((SELECT max(frame) + 1 FROM tok)))::INT AS frame) fr LEFT JOIN tok USING (frame) GROUP BY 1),
 x AS (SELECT a.frame AS a, b.frame AS b, count(*) AS k FROM tok a JOIN tok b USING (token) WHERE a.frame % 100 = 0 GROUP BY ALL),
 g AS (SELECT p.frame AS a, q.frame AS b, coalesce(x.k, 0) AS k, p.n + q.n AS n FROM s p CROSS JOIN s q LEFT JOIN x ON x.a = p.frame AND x.b = q.frame WHERE p.frame % 100 = 0)"""


def frame_distances(spark: S, d: str, *measures: str, scaled: bool = False) -> DataFrame:
    """Every hundredth frame against all from 0 to the last with a token, with or without tokens."""
    t = ct.token_rows(ct.spelt_log(table(spark, d, "a3_contacts")))
    last = ct.last_with_token(t)
    units = spark.range(0 if last is None else last + 1).select(F.col("id").cast("int").alias("frame"))
    return ct.all_set_distances(t, units.where("frame % 100 = 0"), units, "frame", "token", measures, 9, scaled)


@query("mat09_hamming", f"WITH {LOG}, {_PAIRS_OF_FRAMES} SELECT a, b, k AS n_shared, round((n - 2 * k) / (SELECT count(DISTINCT token) FROM tok), 9) AS hamming FROM g")
def mat09(spark: S, d: str) -> DataFrame:
    """Share of all tokens, counted, in which two frames differ."""
    return frame_distances(spark, d, "n_shared", "hamming")


@query("mat10_jaccard", f"WITH {LOG}, {_PAIRS_OF_FRAMES}, j AS (SELECT a, b, CASE WHEN n > k THEN 1 - k / (n - k) ELSE 0 END AS j FROM g) SELECT a, b, round(coalesce(j / nullif(max(j) OVER (), 0), 0), 9) AS jaccard FROM j")
def mat10(spark: S, d: str) -> DataFrame:
    """Divided by the maximum of these pairs; all zeros if that is 0."""
    return frame_distances(spark, d, "jaccard", scaled=True)


# The k-th principal component and its variance: the covariance matrix squared until one component is left of it, that one
# measured, taken out, and so on.
_EIGEN = """x AS (SELECT {e} AS e FROM {rows}), cols AS (SELECT unnest(e) AS x, unnest(range(1, 65)) AS p FROM x),
 mean AS (SELECT list(m ORDER BY p) AS m FROM (SELECT p, avg(x) AS m FROM cols GROUP BY p)),
 centred AS (SELECT list_transform(list_zip(e, m), lambda z: z[1] - z[2]) AS c FROM x, mean),
 cells AS (SELECT p.p, q.q, sum(c[p.p] * c[q.q]) / (count(*) - 1) AS v FROM centred, range(1, 65) p(p), range(1, 65) q(q) GROUP BY ALL),
 cov AS (SELECT list(r ORDER BY p) AS c FROM (SELECT p, list(v ORDER BY q) AS r FROM cells GROUP BY p)),
 eig AS (WITH RECURSIVE it AS (
   SELECT 0 AS k, 0 AS s, c, c AS m, 0.0::DOUBLE AS l, c[1] AS w FROM cov
   UNION ALL
   SELECT CASE WHEN s = {squarings} THEN k + 1 ELSE k END, CASE WHEN s = {squarings} THEN 0 ELSE s + 1 END, c2, CASE WHEN s = {squarings} THEN c2 ELSE m2 END, l2, w2
   FROM (SELECT k, s, l2, w2, CASE WHEN s = {squarings} THEN list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: c[i][j] - l2 * w2[i] * w2[j])) ELSE c END AS c2,
           CASE WHEN s < {squarings} THEN list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / t / t)) END AS m2
     FROM (SELECT *, list_dot_product(w2, list_transform(c, lambda a: list_dot_product(a, w2))) AS l2
       FROM (SELECT *, list_transform(m[b], lambda y: y / sqrt(list_dot_product(m[b], m[b]))) AS w2
         FROM (SELECT *, list_sum(list_transform(range(1, 65), lambda i: m[i][i])) AS t, list_position(list_transform(range(1, 65), lambda i: m[i][i]), list_max(list_transform(range(1, 65), lambda i: m[i][i]))) AS b FROM it WHERE k < {n})))))
  SELECT k, l, list_transform(w, lambda y: y * sign(w[list_position(list_transform(w, lambda z: abs(z)), list_max(list_transform(w, lambda z: abs(z))))])) AS w FROM it WHERE s = 0 AND k > 0)"""


def eigen_sql(n: int, rows: str = "v", e: str = "e", squarings: int = 14) -> str:
    return _EIGEN.format(n=n, rows=rows, e=e, squarings=squarings)


@query("sel12_outlier_drop", f"WITH {VEC}, {eigen_sql(1)} SELECT vec_id, round(s, 5) AS s FROM (SELECT vec_id, list_dot_product(list_transform(list_zip(v.e, m), lambda z: z[1] - z[2]), w) AS s FROM v, mean, eig) WHERE abs(s) <= 0.3")
def sel12(spark: S, d: str) -> DataFrame:
    """Rows whose first principal component is within the cutoff."""
    e = embeddings(spark, d)
    model = pca.fit(e, "embedding").first(1)
    s = pca.transform(e, "vec_id", "embedding", model).select("vec_id", F.col("scores")[0].alias("s"))
    return s.where(F.abs("s") <= 0.3).select("vec_id", F.round("s", 5).alias("s"))


@query("mat14_pca_variances", f"WITH {VEC}, {eigen_sql(4)} SELECT (k - 1)::INT AS pc, round(l, 7) AS variance FROM eig UNION ALL SELECT -1, round(sum(v), 7) FROM cells WHERE p = q")
def mat14(spark: S, d: str) -> DataFrame:
    """Variances of the first four components' scores, and under -1 of all together."""
    e = embeddings(spark, d)
    scores = pca.transform(e, "vec_id", "embedding", pca.fit(e, "embedding")).select(F.posexplode("scores").alias("pc", "x"))
    each = materialise(scores.groupBy("pc").agg(F.var_samp("x").alias("v")), "variances")
    total = each.agg(F.lit(-1).alias("pc"), F.sum("v").alias("v"))
    return each.where("pc < 4").unionByName(total).select("pc", F.round("v", 7).alias("variance"))


@query("win02_cumulative_variance", f"WITH {VEC}, {eigen_sql(64)}, r AS (SELECT k, l / (SELECT sum(v) FROM cells WHERE p = q) AS r FROM eig), c AS (SELECT k, r, sum(r) OVER (ORDER BY k) AS c FROM r) SELECT (k - 1)::INT AS pc, round(r, 6) AS ratio, round(c, 6) AS cumulative FROM c WHERE c - r < 0.9")
def win02(spark: S, d: str) -> DataFrame:
    model = pca.fit(embeddings(spark, d), "embedding", 0.9)
    total, rows = 0.0, []
    for k, r in enumerate(model.ratios):
        total += float(r)
        rows.append((k, round(float(r), 6), round(total, 6)))
    return spark.createDataFrame(rows, "pc int, ratio double, cumulative double")


@query("mat15_fit_one_project_other", f"WITH {VEC}, low AS (SELECT e FROM v WHERE label < 5), {eigen_sql(2, 'low')}, s AS (SELECT vec_id, k, list_dot_product(list_transform(list_zip(v.e, m), lambda z: z[1] - z[2]), w) AS s FROM v, mean, eig WHERE label >= 5) SELECT vec_id, round(max(s) FILTER (k = 1), 5) AS pc1, round(max(s) FILTER (k = 2), 5) AS pc2 FROM s GROUP BY 1")
def mat15(spark: S, d: str) -> DataFrame:
    e = embeddings(spark, d)
    out = pca.transform(e.where("label >= 5"), "vec_id", "embedding", pca.fit(e.where("label < 5"), "embedding").first(2))
    return out.select("vec_id", *[F.round(F.col("scores")[k], 5).alias(f"pc{k + 1}") for k in range(2)])


_GAPS = "g AS (SELECT vec_id, [CASE WHEN (p + vec_id) % 17 = 0 THEN NULL ELSE e[p] END FOR p IN range(1, 65)] AS e FROM v), m AS (SELECT p, avg(x) AS mean FROM (SELECT unnest(e) AS x, unnest(range(1, 65)) AS p FROM g) GROUP BY p)"


@query("mat16_mean_imputation", f"WITH {VEC}, {_GAPS}, x AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, 65)) AS p FROM g) SELECT vec_id, round(sum((coalesce(x, mean) - mean) * 0.125), 6) AS score FROM x JOIN m USING (p) GROUP BY 1")
def mat16(spark: S, d: str) -> DataFrame:
    import numpy as np

    e = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x, p: F.when((p + 1 + F.col("vec_id")) % 17 != 0, x.cast("double"))).alias("e"))
    means = e.select(F.posexplode("e").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).orderBy("p").collect()  # one row a feature
    model = pca.Components(np.array([r["m"] for r in means]), np.full((1, 64), 1 / math.sqrt(64)), np.ones(1))
    return pca.transform(e, "vec_id", "e", model).select("vec_id", F.round(F.col("scores")[0], 6).alias("score"))


@query("mat17_loading_share", f"WITH {VEC}, {eigen_sql(1)} SELECT ((p - 1) // 4)::INT AS residue, round(sum(x * x) / sum(sum(x * x)) OVER (), 6) AS share FROM (SELECT unnest(w) AS x, unnest(range(1, 65)) AS p FROM eig) GROUP BY 1")
def mat17(spark: S, d: str) -> DataFrame:
    model = pca.fit(embeddings(spark, d), "embedding")
    return spark.createDataFrame([(g, round(s, 6)) for g, s in pca.loading_shares(model, 0, 4)], "residue int, share double").orderBy(F.desc("share"), "residue")


def reference_frame(spark: S, d: str) -> list[float]:
    return embeddings(spark, d).orderBy("vec_id").select("embedding").first()[0][:63]


# The least-squares rotation as the quaternion of largest eigenvalue of a 4 x 4 matrix, found by squaring it.
_ROTATED = """xyz AS (SELECT vec_id, k, e[3 * k + 1] AS x, e[3 * k + 2] AS y, e[3 * k + 3] AS z FROM v, range(21) r(k)),
 c AS (SELECT vec_id, k, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM xyz WINDOW w AS (PARTITION BY vec_id)),
 r AS (SELECT * FROM c WHERE vec_id = (SELECT min(vec_id) FROM v)),
 s AS (SELECT c.vec_id, sum(c.x * r.x) AS xx, sum(c.x * r.y) AS xy, sum(c.x * r.z) AS xz, sum(c.y * r.x) AS yx, sum(c.y * r.y) AS yy, sum(c.y * r.z) AS yz, sum(c.z * r.x) AS zx, sum(c.z * r.y) AS zy, sum(c.z * r.z) AS zz,
   sum(c.x * c.x + c.y * c.y + c.z * c.z + r.x * r.x + r.y * r.y + r.z * r.z) AS g FROM c JOIN r USING (k) GROUP BY 1),
 k4 AS (SELECT vec_id, g, [[xx + yy + zz, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz, xy + yx, zx + xz], [zx - xz, xy + yx, yy - xx - zz, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy]] AS k FROM s),
 sq AS (WITH RECURSIVE it AS (SELECT vec_id, g, k, 0 AS n, list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: k[i][j] + CASE WHEN i = j THEN g ELSE 0 END)) AS m FROM k4
   UNION ALL SELECT vec_id, g, k, n + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / power(m[1][1] + m[2][2] + m[3][3] + m[4][4], 2))) FROM it WHERE n < 20) SELECT * FROM it WHERE n = 20),
 quat AS (SELECT vec_id, g, k, list_transform(w, lambda y: y / sqrt(list_dot_product(w, w))) AS q FROM (SELECT *, m[list_position([m[1][1], m[2][2], m[3][3], m[4][4]], greatest(m[1][1], m[2][2], m[3][3], m[4][4]))] AS w FROM sq)),
 fit AS (SELECT p.vec_id, c.k, p.q[1] AS a, p.q[2] AS b, p.q[3] AS c, p.q[4] AS d, c.x, c.y, c.z, r.mx, r.my, r.mz FROM quat p JOIN c ON c.vec_id = p.vec_id JOIN r ON r.k = c.k),
 moved AS (SELECT vec_id, k, (a*a + b*b - c*c - d*d) * x + 2 * (b*c - a*d) * y + 2 * (b*d + a*c) * z + mx AS x, 2 * (c*b + a*d) * x + (a*a - b*b + c*c - d*d) * y + 2 * (c*d - a*b) * z + my AS y,
   2 * (d*b - a*c) * x + 2 * (d*c + a*b) * y + (a*a - b*b - c*c + d*d) * z + mz AS z FROM fit)"""


@query("mat18_superposition", f"WITH {VEC}, {_ROTATED} SELECT vec_id, flatten(list([round(x, 5), round(y, 5), round(z, 5)] ORDER BY k)) AS xyz FROM moved GROUP BY 1")
def mat18(spark: S, d: str) -> DataFrame:
    out = vectors.superpose(embeddings(spark, d), "vec_id", "embedding", reference_frame(spark, d))
    return out.select("vec_id", F.transform("xyz", lambda x: sc.signed_round(x, 5)).alias("xyz"))


@query("mat19_rmsd_to_frame", f"WITH {VEC}, {_ROTATED} SELECT vec_id, round(sqrt(greatest(g - 2 * list_dot_product(q, list_transform(k, lambda a: list_dot_product(a, q))), 0) / 21), 6) AS rmsd FROM quat")
def mat19(spark: S, d: str) -> DataFrame:
    out = vectors.superpose(embeddings(spark, d), "vec_id", "embedding", reference_frame(spark, d))
    return out.select("vec_id", F.round("rmsd", 6).alias("rmsd"))


@query("mat21_leaf_order")
def mat21(spark: S, d: str) -> DataFrame:
    """Order of the at most 40 reported rows over all systems; the driver gets their 40 x 40 products only."""
    from tessellar.plans.queries_tables import agg09, cells

    top = cells(spark, d).join(F.broadcast(agg09(spark, d).select("contact")), "contact", "left_semi")
    a = top.select("system", F.col("contact").alias("a"), F.col("frequency").alias("x"))
    b = top.select("system", F.col("contact").alias("b"), F.col("frequency").alias("y"))
    rows = a.join(b, "system").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p")).collect()
    names = sorted({r["a"] for r in rows})
    at, g = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        g[at[r["a"]], at[r["b"]]] = r["p"]
    square = np.round(np.diag(g)[:, None] + np.diag(g)[None] - 2 * g, 12)
    order = sequence.linkage_leaves(np.sqrt(np.maximum(square, 0)))
    return spark.createDataFrame([(p, names[i]) for p, i in enumerate(order)], "place int, contact string")


_SCOTT = """pts AS (SELECT o_totalprice AS x, dayofyear(o_orderdate)::DOUBLE AS y FROM orders), m AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
 var_samp(x) * power(count(*), -1 / 3.0::DOUBLE) AS a, covar_samp(x, y) * power(count(*), -1 / 3.0::DOUBLE) AS b, var_samp(y) * power(count(*), -1 / 3.0::DOUBLE) AS c FROM pts),
 g AS (SELECT i, j, x0 + (x1 - x0) * i / 99 AS gx, y0 + (y1 - y0) * j / 99 AS gy FROM m, range(100) r(i), range(100) t(j))"""


@query("mat22_kernel_density", f"WITH {_SCOTT} SELECT i::INT AS i, j::INT AS j, round(sum(exp(-(c * power(gx - x, 2) - 2 * b * (gx - x) * (gy - y) + a * power(gy - y, 2)) / (a * c - b * b) / 2)) / any_value(n * 2 * pi() * sqrt(a * c - b * b)) * 1e9, 5) AS density FROM g, pts, m GROUP BY g.i, g.j")
def mat22(spark: S, d: str) -> DataFrame:
    """In billionths."""
    p = table(spark, d, "orders").select("o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"))
    return stats.kernel_density(p, "o_totalprice", "day").select("i", "j", F.round(F.col("density") * 1e9, 5).alias("density"))


REFERENCE = "MPTRSAGWQVLNDKFEHICYMPRSTAGW"


@query("mat23_sliding_alignment", f"""WITH p AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s, '{REFERENCE}' AS r FROM part),
 o AS (SELECT p_partkey, s, i AS start, coalesce(list_sum(list_transform(range(length(s)), lambda k: (s[k + 1] = r[i + k + 1] AND i + k < length(r))::INT)), 0)::BIGINT AS m FROM p, range(28) x(i))
 SELECT p_partkey, max(m) AS matches, arg_min(start, (-m, start)) AS start FROM o GROUP BY 1""")
def mat23(spark: S, d: str) -> DataFrame:
    s = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    p = table(spark, d, "part").select("p_partkey", sequence.best_offset(s, F.lit(REFERENCE)).alias("b"))
    return p.select("p_partkey", F.col("b.matches").cast("bigint").alias("matches"), F.col("b.start").cast("bigint").alias("start"))


@query("mat24_count_matrix", f"WITH {LOG}, ids AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM tok)), x AS (SELECT frame, itype || '|' || least(r1, r2) || '|' || greatest(r1, r2) AS token FROM res WHERE r1 <> r2) SELECT frame, id, count(*) AS n FROM x JOIN ids USING (token) GROUP BY ALL")
def mat24(spark: S, d: str) -> DataFrame:
    from tessellar.functions.labels import undirected_token

    ids = ct.dictionary(tokens(spark, d), "token")
    rows = ct.endpoints(log(spark, d)).select("frame", undirected_token(F.col("itype"), F.col("ends")).alias("token")).where("token is not null")
    return rows.join(ids, "token").groupBy("frame", "id").agg(F.count("*").alias("n"))


@query("mat25_weighted_coordinate", f"WITH {VEC} SELECT label, round(avg(s), 6) AS mean, round(stddev_pop(s) / sqrt(count(*)), 6) AS error FROM (SELECT label, 0.5 * e[1] + 0.3 * e[2] + 0.2 * e[3] AS s FROM v) GROUP BY 1")
def mat25(spark: S, d: str) -> DataFrame:
    e = F.col("embedding")
    s = 0.5 * e[0].cast("double") + 0.3 * e[1].cast("double") + 0.2 * e[2].cast("double")
    return embeddings(spark, d).select("label", s.alias("s")).groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s") / F.sqrt(F.count("*")), 6).alias("error"))


def points(spark: S, d: str) -> DataFrame:
    e = F.col("embedding")
    return embeddings(spark, d).select("vec_id", "label", *[e[k].cast("double").alias(n) for k, n in enumerate("xyz")])


_POINTS = "p AS (SELECT vec_id, label, e[1] AS x, e[2] AS y, e[3] AS z FROM v)"


@query("join06_within_radius", f"WITH {VEC}, {_POINTS} SELECT q.vec_id AS i, p.vec_id AS j, round(sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2) + power(q.z - p.z, 2)), 6) AS d FROM p q, p WHERE q.vec_id % 100 = 0 AND sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2) + power(q.z - p.z, 2)) <= 0.1")
def join06(spark: S, d: str) -> DataFrame:
    p = points(spark, d)
    return _ij(vectors.within(p, queried(p), "vec_id", ["x", "y", "z"], 0.1))


_GRID = "g AS (SELECT a AS i, b AS j, c AS k, -0.4 + 0.1 * a AS gx, -0.4 + 0.1 * b AS gy, -0.4 + 0.1 * c AS gz FROM range(9) x(a), range(9) y(b), range(9) z(c))"


@query("join07_grid_sum", f"WITH {VEC}, {_POINTS}, {_GRID} SELECT i, j, k, round(sum(label / (sqrt(power(gx - x, 2) + power(gy - y, 2) + power(gz - z, 2)) + 1)), 4) AS val FROM g, p GROUP BY ALL")
def join07(spark: S, d: str) -> DataFrame:
    g = vectors.grid_sum(points(spark, d), ["x", "y", "z"], "label", [-0.4] * 3, [0.1] * 3, [9, 9, 9])
    return g.select(*[F.col(c).cast("bigint").alias(c) for c in "ijk"], F.round("val", 4).alias("val"))


@query("mat26_grid_truncation", f"WITH {VEC}, {_POINTS}, {_GRID} SELECT i - 2 AS i, j - 3 AS j, k - 1 AS k, round(sum(label / (sqrt(power(gx - x, 2) + power(gy - y, 2) + power(gz - z, 2)) + 1)), 4) AS val FROM g, p WHERE i BETWEEN 2 AND 5 AND j BETWEEN 3 AND 6 AND k BETWEEN 1 AND 2 GROUP BY g.i, g.j, g.k")
def mat26(spark: S, d: str) -> DataFrame:
    return vectors.truncate_grid(join07(spark, d), [2, 3, 1], [4, 4, 2])


@query("join08_subgrid_match", f"WITH {_GRID} SELECT s.i AS si, s.j AS sj, s.k AS sk, g.i, g.j, g.k FROM g s JOIN g ON g.i = s.i + 2 AND g.j = s.j + 2 AND g.k = s.k + 2")
def join08(spark: S, d: str) -> DataFrame:
    """A finer grid's corner, given by coordinates, in the whole grid; the doubles differ in their last digits."""
    from tessellar.sources import grids

    g = grid_points(spark)
    corner = g.where("i < 7 and j < 7 and k < 7")
    part = corner.select(*[F.col(c).alias(f"s{c}") for c in "ijk"], *[(F.col(c) / 10.0 + (0.2 - 0.4)).alias(a) for c, a in zip("ijk", "xyz", strict=True)])
    return grids.match_subgrid(part, g, [-0.4] * 3, [0.1] * 3).select("si", "sj", "sk", "i", "j", "k")


_CENTRES = "c AS (SELECT label AS g, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(64)) AS p FROM v) GROUP BY ALL) GROUP BY 1)"


@query("join16_nearest_centroid", f"WITH {VEC}, {_CENTRES}, a AS (SELECT vec_id, g, round(sqrt(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64), 12) AS d FROM v, c) SELECT vec_id, arg_min(g, (d, g)) AS label, round(min(d), 6) AS d FROM a GROUP BY 1")
def join16(spark: S, d: str) -> DataFrame:
    e = embeddings(spark, d)
    out = vectors.nearest_centroid(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label")
    return out.select("vec_id", "label", F.round("d", 6).alias("d"))


@query("agg12_group_coordinates", f"WITH {VEC} SELECT label, p, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, unnest(e) AS x, unnest(range(64)) AS p FROM v) GROUP BY ALL")
def agg12(spark: S, d: str) -> DataFrame:
    rows = embeddings(spark, d).select("label", F.posexplode("embedding").alias("p", "x")).select("label", F.col("p").cast("bigint").alias("p"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("label", "p").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


_HIST = """e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), h AS (SELECT o_orderstatus AS s, o_orderpriority AS p, least(floor((o_totalprice - lo) * 50 / (hi - lo)), 49)::BIGINT AS bin, hi - lo AS w FROM orders, e),
 den AS (SELECT s, bin, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY s) * any_value(w) / 50) AS density FROM h GROUP BY s, bin)"""


@query("agg14_histogram", f"WITH {_HIST} SELECT s, bin, n, round(density, 12) AS density FROM den")
def agg14(spark: S, d: str) -> DataFrame:
    h = stats.histogram(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "s"), ["s"], "o_totalprice", 50)
    return h.select("s", "bin", "n", F.round("density", 12).alias("density"))


@query("agg15_jensen_shannon", f"""WITH {_HIST}, pq AS (SELECT b.bin, coalesce(x.density, 0) + 1e-10 AS p, coalesce(y.density, 0) + 1e-10 AS q FROM (SELECT unnest(range(50)) AS bin) b
 LEFT JOIN (SELECT * FROM den WHERE s = 'F') x USING (bin) LEFT JOIN (SELECT * FROM den WHERE s = 'O') y USING (bin)), nn AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM pq)
 SELECT 'F-O' AS pair, round(sqrt(greatest(sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2, 0)), 6) AS jsd FROM nn""")
def agg15(spark: S, d: str) -> DataFrame:
    h = stats.histogram(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", 50).withColumn("pair", F.lit("F-O"))
    return stats.jensen_shannon(h.where("o_orderstatus = 'F'"), h.where("o_orderstatus = 'O'"), ["pair"], 50).select("pair", F.round("jsd", 6).alias("jsd"))


@query("agg16_frobenius", f"""WITH {VEC}, {_CENTRES}, a AS (SELECT x.g AS i, y.g AS j, list_sum(list_transform(list_zip(x.c[1:32], y.c[1:32]), lambda z: power(z[1] - z[2], 2))) AS a, list_sum(list_transform(list_zip(x.c[33:64], y.c[33:64]), lambda z: power(z[1] - z[2], 2))) AS b
 FROM c x JOIN c y ON x.g < y.g) SELECT round(sqrt(2 * sum(power(sqrt(a) - sqrt(b), 2))) / (SELECT count(*) * (count(*) - 1) / 2 FROM c), 9) AS norm FROM a""")
def agg16(spark: S, d: str) -> DataFrame:
    """Distances of the labels' centroids in the first half of the components against those in the second."""
    c = materialise(vectors.centroids(embeddings(spark, d), "label", "embedding"), "centroids")
    x, y = c.select(F.col("label").alias("i"), F.col("centroid").alias("x")), c.select(F.col("label").alias("j"), F.col("centroid").alias("y"))
    gap = lambda k: sc.rms_distance(F.slice("x", k, 32), F.slice("y", k, 32)) * math.sqrt(32)
    pairs = x.join(y, F.col("i") < F.col("j")).select("i", "j", gap(1).alias("a"), gap(33).alias("b"))
    return stats.frobenius(pairs, c.count()).select(F.round("norm", 9).alias("norm"))


@query("agg22_spread_charge", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax + (round(sum(l_tax) OVER w) - sum(l_tax) OVER w) / count(*) OVER w, 6) AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def agg22(spark: S, d: str) -> DataFrame:
    a = topology.spread_charge(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("q")), "l_orderkey", "q")
    return a.withColumn("q", F.round("q", 6))


def molecule(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as atoms: every third is a heavy atom, bonded to the two that follow."""
    k = F.col("p_partkey")
    atoms = table(spark, d, "part").select(k.alias("idx"), F.when(k % 3 == 1, "C").otherwise("H").alias("element"), F.when(k % 3 == 1, 12.0).otherwise(1.0).alias("mass"))
    bonds = table(spark, d, "part").where("p_partkey % 3 != 1 and p_partkey > 0").select((k - F.when(k % 3 == 2, 1).otherwise(2)).alias("i"), k.alias("j"))
    return atoms, bonds


@query("agg23_mass_repartition", "WITH h AS (SELECT p_partkey - CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END AS i, count(*) AS n FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1) SELECT p_partkey AS idx, CASE WHEN p_partkey % 3 = 1 THEN 12.0::DOUBLE - coalesce(n, 0) * 0.5 WHEN p_partkey = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS mass FROM part LEFT JOIN h ON i = p_partkey")
def agg23(spark: S, d: str) -> DataFrame:
    atoms, bonds = molecule(spark, d)
    return topology.repartition_mass(atoms, bonds, 1.5).select("idx", "mass")


@query("sel01_selection_language", f"WITH {LOG}, a AS (SELECT DISTINCT atom1, split_part(atom1, ':', 1) AS c, split_part(atom1, ':', 2) AS n, split_part(atom1, ':', 3)::INT AS s, split_part(atom1, ':', 4) AS a FROM clean) SELECT atom1 FROM a WHERE (c = 'A' AND (s BETWEEN 10 AND 60 OR s IN (100, 101)) AND a <> 'CA') OR (n = 'TRP' AND a IN ('N', 'O'))")
def sel01(spark: S, d: str) -> DataFrame:
    a = atoms_of_log(spark, d)
    return a.where(topology.select("(chainid A and resSeq 10 to 60 100 101 and not name CA) or resname TRP and name N O")).select("atom1")


def atoms_of_log(spark: S, d: str) -> DataFrame:
    from tessellar.functions import labels as lb

    a = F.col("atom1")
    parts = {"chain_id": lb.part(a, 1), "res_name": lb.part(a, 2), "res_seq": lb.residue_number(a), "atom_name": lb.part(a, 4), "element": F.substring(lb.part(a, 4), 1, 1)}
    return log(spark, d).select("atom1").distinct().withColumns(parts)


@query("sel02_atom_slice", f"WITH {VEC} SELECT vec_id, [round(x, 6) FOR x IN list_concat(list_concat(e[1:3], e[10:12]), e[4:6])] AS xyz FROM v")
def sel02(spark: S, d: str) -> DataFrame:
    xyz = topology.slice_vector(F.col("embedding").cast("array<double>"), [0, 3, 1])
    return embeddings(spark, d).select("vec_id", F.transform(xyz, lambda x: F.round(x, 6)).alias("xyz"))


@query("sel17_outside_box", f"WITH {VEC}, {_POINTS}, b AS (SELECT min(x) - 0.02 AS x0, max(x) + 0.02 AS x1, min(y) - 0.02 AS y0, max(y) + 0.02 AS y1, min(z) - 0.02 AS z0, max(z) + 0.02 AS z1 FROM p WHERE vec_id % 50 = 7) SELECT DISTINCT vec_id FROM p, b WHERE x < x0 OR x > x1 OR y < y0 OR y > y1 OR z < z0 OR z > z1")
def sel17(spark: S, d: str) -> DataFrame:
    return topology.outside_box(points(spark, d), F.col("vec_id") % 50 == 7, 0.02, ["vec_id"])


@query("sel25_label_list", r"SELECT DISTINCT label FROM ({p5}) WHERE regexp_full_match(label, '[0-9]\.[0-9]+') AND scheme = 'BW'")
def sel25(spark: S, d: str) -> DataFrame:
    """A label list written as one text and parsed again: split, malformed and many-digit helices dropped."""
    from tessellar.plans.queries_tables import generic_numbers

    lines = generic_numbers(spark, d).where("scheme = 'BW'").groupBy("record_id").agg(F.concat_ws(", ", F.collect_set("label")).alias("line"))
    return lines.select(F.explode(F.split(F.regexp_replace("line", ",", " "), r"\s+")).alias("label")).where(F.col("label").rlike(r"^[0-9]\.[0-9]+$")).distinct()


@query("sel27_subset_split", f"WITH {LOG}, a AS (SELECT r1 AS r FROM res UNION SELECT r2 FROM res) SELECT CASE WHEN split_part(r, ':', 2) = 'LIG' THEN 'ligand' WHEN split_part(r, ':', 2) IN ('HOH', 'WAT') THEN 'solvent' ELSE 'protein' END AS subset, count(*) AS n FROM a GROUP BY 1")
def sel27(spark: S, d: str) -> DataFrame:
    from tessellar.functions import labels as lb

    r = ct.endpoints(log(spark, d)).select(F.explode("ends").alias("r")).distinct()
    name = lb.part(F.col("r"), 2)
    subset = F.when(name == "LIG", "ligand").when(name.isin("HOH", "WAT"), "solvent").otherwise("protein")
    return r.select(subset.alias("subset")).groupBy("subset").agg(F.count("*").alias("n"))


@query("fn08_rmsd", f"WITH {VEC} SELECT v.vec_id, round(sqrt(list_sum(list_transform(list_zip(v.e, f.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64), 6) AS d FROM v, (SELECT e FROM v ORDER BY vec_id LIMIT 1) f")
def fn08(spark: S, d: str) -> DataFrame:
    e = embeddings(spark, d)
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("f"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(sc.rms_distance(F.col("embedding"), F.col("f")), 6).alias("d"))


_X = "SELECT vec_id, " + ", ".join(f"e[{3 * i + k + 4}] - e[{3 * i + k + 1}] AS b{i}{k}" for i in range(3) for k in range(3)) + " FROM v"
_N = ", ".join(f"b{a}1 * b{b}2 - b{a}2 * b{b}1 AS n{a}0, b{a}2 * b{b}0 - b{a}0 * b{b}2 AS n{a}1, b{a}0 * b{b}1 - b{a}1 * b{b}0 AS n{a}2" for a, b in ((0, 1), (1, 2)))


@query("fn22_dihedral", f"WITH {VEC}, b AS ({_X}), n AS (SELECT *, {_N} FROM b) SELECT vec_id, round(degrees(atan2(((n01 * n12 - n02 * n11) * b10 + (n02 * n10 - n00 * n12) * b11 + (n00 * n11 - n01 * n10) * b12) / sqrt(b10 * b10 + b11 * b11 + b12 * b12), n00 * n10 + n01 * n11 + n02 * n12)), 5) AS angle FROM n")
def fn22(spark: S, d: str) -> DataFrame:
    p = [F.col("embedding")[i].cast("double") for i in range(12)]
    return embeddings(spark, d).select("vec_id", F.round(vectors.dihedral(p), 5).alias("angle"))


_QUARTETS = {f"{('phi', 'psi', 'chi1', 'chi2')[a % 4]}_{a}": a for a in range(ATOMS - 3)}
_TORSION = "CASE q % 4 WHEN 0 THEN 'phi_' WHEN 1 THEN 'psi_' WHEN 2 THEN 'chi1_' ELSE 'chi2_' END || q AS torsion"


@query("mat06_torsions", f"WITH {VEC}, w AS (SELECT vec_id, {_TORSION}, e[3 * q + 1:3 * q + 12] AS e FROM v, range(18) r(q)), b AS ({_X.replace('vec_id', 'vec_id, torsion').replace('FROM v', 'FROM w')}), n AS (SELECT *, {_N} FROM b) SELECT vec_id, torsion, round(degrees(atan2(((n01 * n12 - n02 * n11) * b10 + (n02 * n10 - n00 * n12) * b11 + (n00 * n11 - n01 * n10) * b12) / sqrt(b10 * b10 + b11 * b11 + b12 * b12), n00 * n10 + n01 * n11 + n02 * n12)), 5) AS angle FROM n")
def mat06(spark: S, d: str) -> DataFrame:
    """Every four successive atoms of the vector, named in turn phi, psi, chi1, chi2 and by their first atom."""
    e = embeddings(spark, d).withColumn("v", F.col("embedding").cast("array<double>"))
    out = [F.struct(F.lit(n).alias("torsion"), F.round(vectors.dihedral([F.col("v")[3 * a + k] for k in range(12)]), 5).alias("angle")) for n, a in _QUARTETS.items()]
    return e.select("vec_id", F.explode(F.array(*out)).alias("t")).select("vec_id", "t.torsion", "t.angle")


@query("mat27_pose_rmsd", f"WITH {VEC}, r AS (SELECT e FROM v ORDER BY vec_id LIMIT 1), x AS (SELECT vec_id, unnest(range(21)) AS atom, v.e AS e, r.e AS f FROM v, r) SELECT vec_id AS pose, round(sqrt(avg(power(e[3 * atom + 1] - f[3 * atom + 1], 2) + power(e[3 * atom + 2] - f[3 * atom + 2], 2) + power(e[3 * atom + 3] - f[3 * atom + 3], 2))), 6) AS rmsd FROM x GROUP BY 1")
def mat27(spark: S, d: str) -> DataFrame:
    e = embeddings(spark, d).select(F.col("vec_id").alias("pose"), F.slice("embedding", 1, 63).alias("e"))
    ref = e.orderBy("pose").limit(1).select(F.col("e").alias("f"))
    return e.crossJoin(F.broadcast(ref)).select("pose", F.round(sc.rms_distance(F.col("e"), F.col("f")) * math.sqrt(3), 6).alias("rmsd"))


_BAND = "band AS (SELECT token FROM tok GROUP BY 1 HAVING count(*) >= greatest(1, (n.n + 99) // 100) AND count(*) <= 95 * n.n // 100)".replace("n.n", "(SELECT count(DISTINCT frame) FROM tok)")


@query("mat29_multi_hot", f"WITH {LOG}, {_BAND}, f AS (SELECT unnest(range((SELECT max(frame) + 1 FROM tok))) AS frame), g AS (SELECT f.frame, b.token FROM f CROSS JOIN band b) SELECT g.frame::INT AS frame, list((t.token IS NOT NULL)::INT ORDER BY g.token) AS bits FROM g LEFT JOIN tok t ON t.frame = g.frame AND t.token = g.token GROUP BY 1")
def mat29(spark: S, d: str) -> DataFrame:
    """Every token of the 1-95 % band is a column."""
    return ct.multi_hot_band(materialise(tokens(spark, d), "tokens"), 1, 95)


_STATES = """ev AS (SELECT value AS x FROM events), n AS (SELECT list(greatest(c, 1) ORDER BY t) AS n FROM (SELECT t, (SELECT count(*) FROM events WHERE event_type = t) AS c FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t))),
 f AS (WITH RECURSIVE it AS (SELECT 0 AS k, [0.0::DOUBLE, 0, 0, 0, 0] AS f UNION ALL
   SELECT k + 1, list_transform(g, lambda y: y - g[1]) FROM (SELECT k, list_transform(range(1, 6), lambda j: -ln(list_sum(list_transform(d, lambda z: exp(-0.002 * j * z[1]) / z[2])))) AS g
    FROM (SELECT k, list([x, n[1] * exp(f[1] - 0.002 * x) + n[2] * exp(f[2] - 0.004 * x) + n[3] * exp(f[3] - 0.006 * x) + n[4] * exp(f[4] - 0.008 * x) + n[5] * exp(f[5] - 0.010 * x)]) AS d FROM it, ev, n WHERE k < 60 GROUP BY k))) SELECT f FROM it WHERE k = 60)"""


@query("mat01_state_weights", f"WITH {_STATES} SELECT (unnest(range(5)))::INT AS state, round(unnest(f), 5) AS f, 1.0::DOUBLE AS weight FROM f")
def mat01(spark: S, d: str) -> DataFrame:
    """Five states of different inverse temperature over all events."""
    beta = [0.002, 0.004, 0.006, 0.008, 0.010]
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = table(spark, d, "events")
    n = {r["event_type"]: r["count"] for r in e.groupBy("event_type").count().collect()}
    samples = e.select("event_id", F.array(*[F.col("value") * b for b in beta]).alias("u"))
    f, weights = reweight.state_weights(samples, "event_id", "u", [max(n.get(k, 0), 1) for k in kinds], 1e-8)
    sums = weights.agg(*[F.round(F.sum(F.col("weights")[k]), 4).alias(f"s{k}") for k in range(5)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("state"), F.lit(round(float(f[k]), 5)).alias("f"), F.col(f"s{k}").alias("weight")) for k in range(5)])).alias("x")).select("x.*")


@query("mat02_resample", """WITH c AS (SELECT o_orderkey, o_totalprice AS w, sum(o_totalprice) OVER (ORDER BY year(o_orderdate), o_orderkey ROWS UNBOUNDED PRECEDING) AS c, sum(o_totalprice) OVER () AS t FROM orders)
 SELECT o_orderkey, (floor(round(c / t * 1000, 6) - 0.5) - floor(round((c - w) / t * 1000, 6) - 0.5))::BIGINT AS copies FROM c""")
def mat02(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice")
    return reweight.systematic_resample(o, ["y", "o_orderkey"], "o_totalprice", 1000).select("o_orderkey", "copies")


@query("mat02_without_replacement", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln((('0x' || md5(o_orderkey || ':1')[1:10])::BIGINT + 0.5::DOUBLE) / 1099511627776) / o_totalprice, o_orderkey LIMIT 500")
def mat02b(spark: S, d: str) -> DataFrame:
    return reweight.draw_without_replacement(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 500)


_BACKFILL = """frames AS (SELECT sim_no, round((temperature - 300) / 1.5)::BIGINT AS state, state AS frame FROM ladder), miss AS (SELECT s.sim_no, i AS state FROM (SELECT DISTINCT sim_no FROM ladder) s, range(40) r(i) WHERE (s.sim_no, i) NOT IN (SELECT (sim_no, state) FROM frames))"""


@query("mat03_backfill", f"WITH {LADDER}, {_BACKFILL} SELECT m.sim_no, m.state, f.sim_no AS donor, f.frame FROM miss m JOIN frames f ON f.state = m.state AND f.sim_no <> m.sim_no QUALIFY row_number() OVER (PARTITION BY m.sim_no, m.state ORDER BY md5(concat_ws(':', m.sim_no, m.state, f.sim_no, f.frame, 1)), f.sim_no, f.frame) <= 2")
def mat03(spark: S, d: str) -> DataFrame:
    ladder = ladders(spark, d)
    final = spark.range(40).select(F.col("id").alias("state"), F.round(300 + F.col("id") * 1.5, 2).alias("temperature"))
    state = rs.cents(F.col("temperature"))
    frames = ladder.select("sim_no", ((state - 30000) / 150).cast("bigint").alias("state"), F.col("state").alias("frame"))
    return reweight.backfill(frames, rs.missing_states(ladder, final), 2)


@query("mat04_weight_scatter", f"WITH {LADDER}, dom AS (SELECT s AS sim_no, t AS state FROM (SELECT DISTINCT sim_no AS s FROM ladder), range(45) x(t)) SELECT dom.sim_no, dom.state, coalesce(l.temperature, 0) AS w FROM dom LEFT JOIN ladder l USING (sim_no, state)")
def mat04(spark: S, d: str) -> DataFrame:
    ladder = ladders(spark, d)
    domain = ladder.select("sim_no").distinct().select("sim_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(44).cast("bigint"))).alias("state"))
    return rs.scatter(domain, ladder.select("sim_no", "state", F.col("temperature").alias("w")), ["sim_no", "state"], "w")


_SETTLE = f"""{BIND}, s AS (SELECT system, repeat, list(ie ORDER BY frame) AS x FROM bind GROUP BY ALL),
 t AS (SELECT system, repeat, t0, x[t0 + 1:] AS x FROM s, range(10000) r(t0) WHERE t0 < greatest(len(x) - 1, 1)),
 c AS (SELECT *, len(x) AS n, list_transform(x, lambda y: y - list_avg(x)) AS d FROM t), w AS (SELECT *, list_dot_product(d, d) / n AS v FROM c),
 lag AS (SELECT system, repeat, t0, l, n, list_dot_product(d[1:n - l], d[l + 1:n]) / ((n - l) * v) AS c FROM w, range(1, 10000) r(l) WHERE l < n - 1 AND v > 1e-300),
 stop AS (SELECT system, repeat, t0, min(l) AS l FROM lag WHERE c <= 0 AND l > 3 GROUP BY ALL),
 g AS (SELECT w.system, w.repeat, w.t0, w.n, greatest(1 + 2 * coalesce(sum(lag.c * (1 - lag.l / lag.n)), 0), 1) AS g FROM w LEFT JOIN stop USING (system, repeat, t0)
   LEFT JOIN lag ON lag.system = w.system AND lag.repeat = w.repeat AND lag.t0 = w.t0 AND lag.l < coalesce(stop.l, 1000000) GROUP BY ALL)"""


@query("mat05_equilibration", f"WITH {_SETTLE} SELECT system, repeat, t0::INT AS t0, round(g, 6) AS g, round((n + 1) / g, 6) AS n_independent FROM g QUALIFY row_number() OVER (PARTITION BY system, repeat ORDER BY round((n + 1) / g, 9) DESC, t0) = 1")
def mat05e(spark: S, d: str) -> DataFrame:
    out = reweight.equilibration(binding(spark, d), ["system", "repeat"], "frame", "ie")
    return out.select("system", "repeat", "t0", F.round("g", 6).alias("g"), F.round("n_independent", 6).alias("n_independent"))


@query("win05_payload_of_lower", f"WITH {LADDER}, r AS (SELECT *, lag(state) OVER w AS src, (state * 37 % 100) / 100.0 AS rate FROM ladder WINDOW w AS (PARTITION BY sim_no ORDER BY state)) SELECT sim_no, src AS source_state, count(*) AS n FROM r WHERE rate < 0.4 AND src IS NOT NULL GROUP BY ALL")
def win05(spark: S, d: str) -> DataFrame:
    ladder = ladders(spark, d)
    rates = ladder.select("sim_no", "state", ((F.col("state") * 37 % 100) / 100.0).alias("rate"))
    grown = rs.insert_rungs(ladder, rates, 0.4)
    return grown.groupBy("sim_no", "source_state").agg((F.count("*") - 1).alias("n")).where("n > 0")


@query("win09_rank_of_ids", f"WITH {LOG}, a AS (SELECT DISTINCT r1 FROM res) SELECT r1 AS label, row_number() OVER (PARTITION BY split_part(r1, ':', 1) ORDER BY try_cast(split_part(r1, ':', 3) AS INT), r1) AS place FROM a")
def win09(spark: S, d: str) -> DataFrame:
    from pyspark.sql import Window

    from tessellar.functions import labels as lb

    a = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("label")).distinct()
    w = Window.partitionBy(lb.part(F.col("label"), 1)).orderBy(lb.residue_number(F.col("label")), "label")
    return a.select("label", F.row_number().over(w).cast("bigint").alias("place"))


@query("join18_correspondence", f"WITH {LOG}, a AS (SELECT DISTINCT atom1, atom2 FROM clean), m AS (SELECT DISTINCT atom1 AS k, split_part(atom1, ':', 4) AS name FROM clean WHERE atom1 LIKE 'A:%') SELECT a.atom1, a.atom2, coalesce(x.name, 'X') AS n1, coalesce(y.name, 'X') AS n2 FROM a LEFT JOIN m x ON x.k = a.atom1 LEFT JOIN m y ON y.k = a.atom2")
def join18(spark: S, d: str) -> DataFrame:
    from tessellar.functions import labels as lb

    a = log(spark, d).select("atom1", "atom2").distinct()
    m = a.select("atom1").distinct().where("atom1 like 'A:%'").select(F.col("atom1").alias("k"), lb.part(F.col("atom1"), 4).alias("name"))
    out = a
    for c, n in (("atom1", "n1"), ("atom2", "n2")):
        out = out.join(m.select(F.col("k").alias(c), F.col("name").alias(n)), c, "left").withColumn(n, F.coalesce(n, F.lit("X")))
    return out.select("atom1", "atom2", "n1", "n2")


@query("join19_name_order", "SELECT p_partkey, coalesce(list_position(['STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'PROMO'], split_part(p_type, ' ', 1)), 0)::INT AS place FROM part")
def join19(spark: S, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")])
    return table(spark, d, "part").select("p_partkey", F.array_position(names, F.substring_index("p_type", " ", 1)).cast("int").alias("place"))


# --- text sources ------------------------------------------------------------------------------------------------------


def pdb_lines(spark: S, d: str) -> DataFrame:
    """Atom records written from the log's atoms, among other records."""
    a = atoms_of_log(spark, d).where("res_seq is not null")
    line = F.format_string("ATOM  %5d %-4s %-4s%1s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("res_seq") + 1000, F.substring("atom_name", 1, 4), F.substring("res_name", 1, 3), F.substring("chain_id", 1, 1), "res_seq", F.col("res_seq") / 4.0, F.col("res_seq") / 8.0, F.col("res_seq") / 16.0, "element")
    return a.select(F.explode(F.array(line, F.lit("REMARK made here"), F.lit("CONECT    1    2"))).alias("value"))


_ATOMS = f"WITH {LOG}, a AS (SELECT DISTINCT split_part(atom1, ':', 1) AS chain_id, split_part(atom1, ':', 2) AS res_name, try_cast(split_part(atom1, ':', 3) AS INT) AS res_seq, split_part(atom1, ':', 4)[1:4] AS atom_name FROM clean WHERE try_cast(split_part(atom1, ':', 3) AS INT) IS NOT NULL)"


@query("src09_atom_records", f"{_ATOMS} SELECT chain_id, res_name, res_seq, atom_name, round(res_seq / 8, 3) AS y FROM a")
def src09(spark: S, d: str) -> DataFrame:
    out = text.atom_records(pdb_lines(spark, d))
    return out.select("chain_id", "res_name", "res_seq", "atom_name", "y").distinct()


@query("src09_atom_kinds", f"{_ATOMS} SELECT CASE WHEN res_name = 'LIG' THEN 'ligand' ELSE 'protein' END AS kind, count(*) AS n FROM a GROUP BY 1")
def src09k(spark: S, d: str) -> DataFrame:
    rows = text.atom_records(pdb_lines(spark, d)).select("chain_id", "res_name", "res_seq", "atom_name", "element").distinct()
    return rows.select(text.atom_kind(F.col("res_name"), F.col("element")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("sel19_record_removal", f"{_ATOMS} SELECT count(*) * 2 AS n FROM a")
def sel19(spark: S, d: str) -> DataFrame:
    return text.without_records(pdb_lines(spark, d), "value", "CONECT").agg(F.count("*").alias("n"))


@query("src10_cif_loop", f"{_ATOMS} SELECT chain_id, res_name, res_seq, atom_name FROM a")
def src10(spark: S, d: str) -> DataFrame:
    a = atoms_of_log(spark, d).where("res_seq is not null")
    lines = a.select(F.concat_ws(" ", F.lit("ATOM"), "res_seq", "element", F.substring("atom_name", 1, 4), F.lit("."), "res_name", "chain_id").alias("value"))
    out = text.cif_atoms(lines, ["group_PDB", "res_seq", "element", "atom_name", "alt", "res_name", "chain_id"])
    return out.select("chain_id", "res_name", F.col("res_seq").cast("int").alias("res_seq"), "atom_name").distinct()


@query("src11_sequence_block", "SELECT p_partkey, '>P1;' || p_brand || E'\\nsequence:' || p_brand || E':::::::0.00: 0.00\\n' || upper(p_name) || E'*\\n' AS block FROM part")
def src11(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.sequence_block(F.col("p_brand"), F.upper("p_name")).alias("block"))


@query("src16_docking_scores", "SELECT round(-p_retailprice / 100, 3) AS score, count(*) AS n FROM part GROUP BY 1")
def src16(spark: S, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("REMARK VINA RESULT:   "), (F.round(-F.col("p_retailprice") / 100, 3)).cast("string"), F.lit("  0.000  0.000")), F.lit("ATOM"))).alias("value"))
    return text.docking_scores(lines).groupBy("score").agg(F.count("*").alias("n"))


@query("src12_dx_grid", f"WITH {_GRID} SELECT i, j, k, round(1.5 + 0.25 * i, 6) AS x, round(-2.0 + 0.5 * j, 6) AS y, round(0.125 * k, 6) AS z, round(i + j / 10.0::DOUBLE + k / 100.0::DOUBLE, 6) AS val FROM g")
def src12(spark: S, d: str) -> DataFrame:
    """Written as a gzipped file, and read back with its coordinates."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources import grids

    path = os.path.join(shared_dir(spark), f"grid-{uuid.uuid4().hex}")
    g = grid_points(spark).withColumn("val", F.col("i") + F.col("j") / 10.0 + F.col("k") / 100.0)
    grids.write_dx(g, [1.5, -2.0, 0.0], [0.25, 0.5, 0.125], [9, 9, 9], path, compressed=True)
    return grids.read_dx(spark, path).select("i", "j", "k", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "val")])


def grid_points(spark: S) -> DataFrame:
    f = F.col("id")
    return spark.range(729).select(F.floor(f / 81).alias("i"), (F.floor(f / 9) % 9).alias("j"), (f % 9).alias("k"))


_PART = "t AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part), heavy AS (SELECT DISTINCT brand FROM t)"


@query("src21_forcefield_xml", f"""WITH {_PART} SELECT 'Type' AS entry, count(*) AS n, round(sum(price), 2) AS total FROM t UNION ALL SELECT 'Residue', count(*), round(sum(length(brand)), 2) FROM heavy
 UNION ALL SELECT 'Bond', count(*), round(sum(size * 0.1::DOUBLE), 2) FROM t WHERE size > 10 UNION ALL SELECT 'Angle', count(*), round(sum(size * 2.0::DOUBLE), 2) FROM t WHERE size > 20
 UNION ALL SELECT 'Proper', count(*), round(sum(size % 4), 2) FROM t WHERE size > 30 UNION ALL SELECT 'Atom', count(*), round(sum(price / 100), 2) FROM t""")
def src21(spark: S, d: str) -> DataFrame:
    """Six sections written as one file and read again, each by its element."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources import forcefield as ff

    path = os.path.join(shared_dir(spark), f"xml-{uuid.uuid4().hex}")
    p = table(spark, d, "part").select(F.concat(F.lit("t"), "p_partkey").alias("name"), F.col("p_brand").alias("class"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    sections = [
        ff.Section("AtomTypes", "Type", p.select("name", "class", F.col("price").alias("mass")), ["name", "class", "mass"]),
        ff.Section("Residues", "Residue", p.select(F.col("class").alias("name")).distinct(), ["name"]),
        ff.Section("HarmonicBondForce", "Bond", p.where("size > 10").select(F.col("name").alias("class1"), (F.col("size") * 0.1).alias("length")), ["class1", "length"]),
        ff.Section("HarmonicAngleForce", "Angle", p.where("size > 20").select(F.col("name").alias("class1"), (F.col("size") * 2.0).alias("angle")), ["class1", "angle"]),
        ff.Section("PeriodicTorsionForce", "Proper", p.where("size > 30").select(F.col("name").alias("class1"), (F.col("size") % 4).alias("periodicity1")), ["class1", "periodicity1"]),
        ff.Section("NonbondedForce", "Atom", p.select(F.col("name").alias("type"), (F.col("price") / 100).alias("sigma")), ["type", "sigma"]),
    ]
    ff.write_xml(sections, path)
    measured = {"Type": "mass", "Bond": "length", "Angle": "angle", "Proper": "periodicity1", "Atom": "sigma"}
    out = ff.read_entries(spark, path, "Residue", "_name string").agg(F.lit("Residue").alias("entry"), F.count("*").alias("n"), F.sum(F.length("_name")).cast("double").alias("total"))
    for entry, column in measured.items():
        out = out.unionByName(ff.read_entries(spark, path, entry, f"_{column} double").agg(F.lit(entry).alias("entry"), F.count("*").alias("n"), F.round(F.sum(f"_{column}"), 2).alias("total")))
    return out


@query("src23_settings", "SELECT * FROM (VALUES ('name', 'é \"x\"'), ('steps', '25'), ('ladder', '[300.0,310.5]')) v(key, value)")
def src23(spark: S, d: str) -> DataFrame:
    """Settings written as JSON beside the data and read again: one row a setting."""
    import json
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources import files

    settings = {"name": 'é "x"', "steps": 25, "ladder": [300.0, 310.5]}
    folder = os.path.join(shared_dir(spark), f"settings-{uuid.uuid4().hex}")
    path = files.put_bytes(folder, "settings.json", json.dumps(settings, indent=2, ensure_ascii=False).encode())
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.explode("m").alias("key", "value"))


@query("src03_array_files", f"WITH {BIND} SELECT system, repeat::INT AS repeat, frame::INT AS frame, round(ie, 6) AS ie FROM bind")
def src03(spark: S, d: str) -> DataFrame:
    """Arrays written as .npy files, one a system, and read back as rows."""
    from tessellar.sources import arrays

    return arrays.round_trip(binding(spark, d), "system", ["repeat", "frame"], "ie")


@query("src20_model_store", f"WITH {VEC}, {eigen_sql(1)} SELECT vec_id, round(list_dot_product(list_transform(list_zip(v.e, m), lambda z: z[1] - z[2]), w), 5) AS pc1, true AS same FROM v, mean, eig")
def src20(spark: S, d: str) -> DataFrame:
    """Scores by a model that was stored and read again, and whether they equal those of the model itself."""
    import os
    import uuid

    from tessellar.session import shared_dir

    path = os.path.join(shared_dir(spark), f"model-{uuid.uuid4().hex}")
    e = embeddings(spark, d)
    model = pca.fit(e, "embedding", 0.5)
    pca.save(spark, model, path)
    own = pca.transform(e, "vec_id", "embedding", model).select("vec_id", F.col("scores").alias("own"))
    back = pca.transform(e, "vec_id", "embedding", pca.load(spark, path))
    return back.join(own, "vec_id").select("vec_id", F.round(F.col("scores")[0], 5).alias("pc1"), (F.col("scores") == F.col("own")).alias("same"))


@query("src18_saved_by_mode", "SELECT 'cache' AS mode, count(*) AS n FROM region UNION ALL SELECT 'in place', count(*) FROM region UNION ALL SELECT 'read only', 0")
def src18(spark: S, d: str) -> DataFrame:
    """Where a table goes by mode: the cache, its own folder, or nowhere."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources.store import save

    root = os.path.join(shared_dir(spark), f"modes-{uuid.uuid4().hex}")
    rows = []
    for mode, args in (("cache", {"cache": f"{root}/cache"}), ("in place", {}), ("read only", {"read_only": True})):
        path = save(table(spark, d, "region"), "region", f"{root}/source", **args)
        rows.append((mode, spark.read.parquet(path).count() if path else 0))
    return spark.createDataFrame(rows, "mode string, n long")


@query("mat13_compute_or_load", f"WITH {BIND} SELECT system, count(*) AS n FROM bind GROUP BY 1")
def mat13(spark: S, d: str) -> DataFrame:
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources.store import compute_or_load

    name = f"matrix-{uuid.uuid4().hex}"
    made = lambda: binding(spark, d).groupBy("system").agg(F.count("*").alias("n"))
    compute_or_load(spark, name, made, shared_dir(spark))
    return compute_or_load(spark, name, lambda: spark.range(0).select(F.lit("").alias("system"), F.col("id").alias("n")), shared_dir(spark))


@query("mat13_cached_in_process", f"WITH {BIND}, m AS (SELECT system, count(*) AS n FROM bind GROUP BY 1) SELECT step, system, n, 1 AS times_made FROM m, (SELECT unnest(['computed', 'from the process', 'from the folder']) AS step)")
def mat13_cached(spark: S, d: str) -> DataFrame:
    """The same table three times: computed, from the process, and from the folder as after a restart."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources.store import Cache

    cache = Cache(spark, os.path.join(shared_dir(spark), f"cache-{uuid.uuid4().hex}"))
    out = None
    for step in ("computed", "from the process", "from the folder"):
        if step == "from the folder":
            cache.forget()
        got = cache.get("counts", lambda: binding(spark, d).groupBy("system").agg(F.count("*").alias("n"))).select(F.lit(step).alias("step"), "system", "n")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("times_made", F.lit(len(cache.made)))


# --- the incremental loop ----------------------------------------------------------------------------------------------

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream01_incremental_totals", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream01(spark: S, d: str) -> DataFrame:
    from tessellar.streaming.incremental import incremental_totals

    return incremental_totals(spark, d, EVENT_SCHEMA, ["event_type"], "value", "events.parquet").select("event_type", "n", F.round("total", 2).alias("total"))


@query("stream02_windows_beyond_reference", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream02(spark: S, d: str) -> DataFrame:
    from tessellar.streaming.incremental import windowed_counts

    return windowed_counts(spark, d, EVENT_SCHEMA, "ts", "event_type", "1 day", "1 hour", "events.parquet")


@query("stream04_prefixes", "WITH p AS (SELECT event_type AS run, dayofyear(ts)::INT AS part, count(value) AS n, sum(value) AS s FROM events GROUP BY ALL) SELECT run, part, sum(n) OVER w::BIGINT AS n, round(sum(s) OVER w / sum(n) OVER w, 6) AS mean FROM p WINDOW w AS (PARTITION BY run ORDER BY part)".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def stream04(spark: S, d: str) -> DataFrame:
    frames = table(spark, d, "events").select(F.col("event_type").alias("run"), F.dayofyear("ts").alias("part"), "value")
    return rs.prefixes(frames, frames.select("run", "part").distinct()).select("run", "part", "n", F.round("mean", 6).alias("mean"))


@query("stream05_stop_rule", f"WITH {MONTHS}, x AS (SELECT a.run, abs(a.value - b.value) / 100000 AS f, abs(a.value - b.value) / 50000 AS j FROM m a JOIN m b ON a.run = b.run AND b.point >= floor(0.98 * a.point) AND b.point < a.point) SELECT run, bool_and(f < 0.6 AND j < 1.1) AS passed FROM x GROUP BY 1")
def stream05(spark: S, d: str) -> DataFrame:
    from tessellar.streaming.incremental import stop_rule

    gap = F.abs(F.col("value") - F.col("previous_value"))
    metrics = rs.earlier_checkpoints(checkpoints(spark, d), 0.98).select("run", (gap / 100000).alias("frobenius"), (gap / 50000).alias("jsd"))
    return stop_rule(metrics, 0.6, 1.1)


@query("src25_recovery_guard", f"WITH {ENERGY} SELECT system, repeat, max(frame) AS last FROM ie GROUP BY ALL HAVING count(DISTINCT frame) > 10")
def src25(spark: S, d: str) -> DataFrame:
    return energies(spark, d).groupBy("system", "repeat").agg(F.max("frame").alias("last"), F.countDistinct("frame").alias("n")).where("n > 10").drop("n")


_CELLS = """pl AS (SELECT vec_id, floor(x / 0.15)::BIGINT AS a, floor(y / 0.15)::BIGINT AS b, floor(z / 0.15)::BIGINT AS c FROM p), dense AS (SELECT a, b, c, a || ',' || b || ',' || c AS k FROM pl GROUP BY ALL HAVING count(*) >= 4),
 reach AS (WITH RECURSIVE r AS (SELECT k, k AS to_k FROM dense UNION SELECT r.k, y.k FROM r JOIN dense x ON x.k = r.to_k JOIN dense y ON abs(x.a - y.a) <= 1 AND abs(x.b - y.b) <= 1 AND abs(x.c - y.c) <= 1) SELECT k, min(to_k) AS cluster FROM r GROUP BY k)"""


@query("mat20_density_clusters", f"WITH {VEC}, {_POINTS}, {_CELLS} SELECT vec_id, cluster FROM pl LEFT JOIN reach ON k = a || ',' || b || ',' || c")
def mat20(spark: S, d: str) -> DataFrame:
    from tessellar.operators.clusters import density_clusters

    return density_clusters(points(spark, d), "vec_id", ["x", "y", "z"], 0.15, 4)


@query("src07_tables_with_bad_lines", "SELECT p_partkey AS k, p_retailprice AS v, CASE WHEN p_partkey % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS system FROM part")
def src07(spark: S, d: str) -> DataFrame:
    """Tab-separated files with comments and a malformed line each, tagged by file name."""
    import os
    import uuid

    from tessellar.session import shared_dir

    root = os.path.join(shared_dir(spark), f"tsv-{uuid.uuid4().hex}")
    part = table(spark, d, "part")
    paths = []
    for name, rest in (("EVEN", 0), ("ODD", 1)):
        lines = part.where(f"p_partkey % 2 = {rest}").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string")).alias("value"))
        extra = spark.createDataFrame([("# comment",), ("not a number\tx",)], "value string")
        lines.unionByName(extra).write.text(f"{root}/{name}")
        paths.append(f"{root}/{name}")
    out = spark.read.csv(paths, sep="\t", comment="#", mode="DROPMALFORMED", schema="k long, v double")
    return out.select("k", "v", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("system"))


@query("src24_path_search", "SELECT 'nation.parquet' AS name UNION ALL SELECT 'region.parquet'")
def src24(spark: S, d: str) -> DataFrame:
    """Files below a folder whose name contains a text; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*ion.parquet").option("recursiveFileLookup", "true").load(d)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).where(F.col("name").rlike("^(nat|reg)ion"))


@query("sel23_split_by_chain", f"WITH {LOG}, a AS (SELECT DISTINCT r1 FROM res WHERE split_part(r1, ':', 2) <> 'LIG') SELECT split_part(r1, ':', 1) AS chain, count(*) AS n FROM a GROUP BY 1")
def sel23(spark: S, d: str) -> DataFrame:
    """Residues written to one folder a chain and counted from there."""
    import os
    import uuid

    from tessellar.functions import labels as lb
    from tessellar.session import shared_dir

    root = os.path.join(shared_dir(spark), f"chains-{uuid.uuid4().hex}")
    r = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("r")).distinct()
    r.where(lb.part(F.col("r"), 2) != "LIG").withColumn("chain", lb.part(F.col("r"), 1)).repartition("chain").write.partitionBy("chain").parquet(root)
    return spark.read.parquet(root).groupBy(F.col("chain").cast("string").alias("chain")).agg(F.count("*").alias("n"))


@query("sel26_sequence_table", f"WITH {LOG}, a AS (SELECT DISTINCT split_part(r1, ':', 1) AS chain, try_cast(split_part(r1, ':', 3) AS INT) AS n, split_part(r1, ':', 2) AS name FROM res) SELECT chain, n, name FROM a WHERE name NOT IN ('ACE', 'NME', 'HOH', 'LIG') AND n IS NOT NULL")
def sel26(spark: S, d: str) -> DataFrame:
    from tessellar.functions import labels as lb

    r = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("r")).distinct()
    out = r.select(lb.part(F.col("r"), 1).alias("chain"), lb.residue_number(F.col("r")).alias("n"), sc.residue_name(lb.part(F.col("r"), 2)).alias("name"))
    return out.where(~F.col("name").isin("ACE", "NME", "HOH", "LIG") & F.col("n").isNotNull()).distinct()


@query("fn16_unit_conversion", "SELECT p_partkey, round(p_retailprice * 4.184, 6) AS kj, round(p_retailprice * 0.1, 6) AS nm FROM part")
def fn16(spark: S, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(sc.kcal_to_kj(p), 6).alias("kj"), F.round(sc.angstrom_to_nm(p), 6).alias("nm"))


@query("stream03_adaptive_ladder", f"""WITH {LADDER}, k AS (SELECT sim_no, greatest(ceil(log2((max(temperature) - min(temperature)) / (-2 * ln(0.4)))), 0)::INT AS k FROM ladder GROUP BY 1)
 SELECT sim_no, power(2, k)::BIGINT + 1 AS n, (max(k) OVER ())::INT AS cycles FROM k""")
def stream03(spark: S, d: str) -> DataFrame:
    """From the two ends of each ladder, rungs are inserted until neighbours are close enough; the exchange rate falls with
    their gap."""
    from pyspark.sql import Window

    from tessellar.streaming.incremental import adapt_until

    def rates(ladder: DataFrame) -> DataFrame:
        gap = F.col("temperature") - F.lag("temperature").over(Window.partitionBy("sim_no").orderBy("state"))
        return ladder.select("sim_no", "state", F.exp(-gap / 2).alias("rate")).where("rate is not null")

    ends = ladders(spark, d).groupBy("sim_no").agg(F.min("temperature").alias("a"), F.max("temperature").alias("b"))
    start = ends.select("sim_no", F.posexplode(F.array("a", "b")).alias("state", "temperature"))
    final, cycles = adapt_until(start, rates, 0.4, 12)
    return final.groupBy("sim_no").agg(F.count("*").alias("n")).withColumn("cycles", F.lit(cycles))


@query("stream06_stop_and_resume", """WITH m AS (SELECT ((day(ts) - 1) // 3)::INT AS part, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1), d AS (SELECT part, n, mean, abs(mean - lag(mean) OVER (ORDER BY part)) AS gap FROM m),
 s AS (SELECT coalesce(min(part) FILTER (gap < 0.25 AND part > 2), 9) AS last FROM d) SELECT part, n, round(mean, 6) AS mean FROM d, s WHERE part <= last""")
def stream06(spark: S, d: str) -> DataFrame:
    """Three days a part, until the mean of the last two agrees; the loop is broken off after two parts, in the middle of the
    third, and started again."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.streaming.incremental import run_loop

    root = os.path.join(shared_dir(spark), f"loop-{uuid.uuid4().hex}")
    events = table(spark, d, "events")

    def produce(k: int) -> DataFrame:
        return events.where(F.floor((F.dayofmonth("ts") - 1) / 3) == k).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))

    def broken(k: int) -> DataFrame:
        if k == 2:
            raise InterruptedError("the machine went away")
        return produce(k)

    def passed(parts: DataFrame) -> bool:
        rows = parts.orderBy(F.desc("part")).limit(2).collect()
        return rows[0]["part"] > 2 and abs(rows[0]["mean"] - rows[1]["mean"]) < 0.25

    try:
        run_loop(spark, root, broken, passed, 10)
    except InterruptedError:
        pass
    run_loop(spark, root, produce, passed, 10)
    return spark.read.parquet(root).select(F.col("part").cast("int").alias("part"), "n", F.round("mean", 6).alias("mean"))


@query("stream07_failure_isolation", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream07(spark: S, d: str) -> DataFrame:
    """A failing checkpoint is recorded, the others still count, and the next call makes up for it."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.streaming.incremental import process_new_files

    root = os.path.join(shared_dir(spark), f"isolated-{uuid.uuid4().hex}")

    def work(df: DataFrame, batch: int) -> None:
        df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/parts/batch={batch}")

    def failing(df: DataFrame, batch: int) -> None:
        raise ValueError("before the write")

    if not process_new_files(spark, d, EVENT_SCHEMA, failing, f"{root}/checkpoint", "events.parquet"):
        raise RuntimeError("the failure wasn't recorded")
    if process_new_files(spark, d, EVENT_SCHEMA, work, f"{root}/checkpoint", "events.parquet"):
        raise RuntimeError("the second attempt failed too")
    return spark.read.parquet(f"{root}/parts").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("sel01_around_whole_residues", f"WITH {VEC}, {_POINTS}, near AS (SELECT DISTINCT p.vec_id FROM p q, p WHERE q.vec_id % 100 = 0 AND sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2) + power(q.z - p.z, 2)) <= 0.08) SELECT DISTINCT vec_id // 4 AS residue FROM near")
def sel01_around(spark: S, d: str) -> DataFrame:
    """Residues (four points each) with any point within reach of the stated query points."""
    p = points(spark, d).withColumn("residue", F.floor(F.col("vec_id") / 4))
    return topology.residues_around(p, F.pmod("vec_id", F.lit(100)) == 0, 0.08, "vec_id", ["residue"])


@query("src19_trajectory_files", "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, round(list_sum(list_transform(embedding[1:63], lambda x: x::FLOAT::DOUBLE)), 4) AS total FROM embeddings")
def src19(spark: S, d: str) -> DataFrame:
    """Frames written as binary trajectory files, some a label, and read back."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources import trajectory
    from tessellar.sources.files import group_of

    folder = os.path.join(shared_dir(spark), f"traj-{uuid.uuid4().hex}")
    frames = embeddings(spark, d).select("label", "vec_id", F.slice("embedding", 1, 63).alias("xyz"))
    trajectory.write_dcd(frames, "label", "vec_id", "xyz", folder, 200).agg(F.sum("n")).collect()
    label, part = group_of("path", "dcd")
    return trajectory.read_dcd(spark, folder).select(label.cast("int").alias("label"), (part * 200 + F.col("frame")).alias("frame"), F.round(F.aggregate("xyz", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("src19_trajectory_text", "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS model, (unnest(range(21)) + 1)::INT AS atom, unnest([round(embedding[3 * k + 1]::FLOAT::DOUBLE * 100, 3) FOR k IN range(21)]) AS x FROM embeddings")
def src19_text(spark: S, d: str) -> DataFrame:
    """Frames written as text with a model each, and read back line by line."""
    import os
    import uuid

    from tessellar.session import shared_dir
    from tessellar.sources import trajectory
    from tessellar.sources.files import group_of

    folder = os.path.join(shared_dir(spark), f"models-{uuid.uuid4().hex}")
    frames = embeddings(spark, d).select("label", "vec_id", F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double") * 100).alias("xyz"))
    trajectory.write_pdb(frames, "label", "vec_id", "xyz", folder, 150).agg(F.sum("n")).collect()
    models = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    label, part = group_of("path", "pdb")
    model = F.explode(F.slice(F.split("value", "MODEL "), 2, 1_000_000)).alias("m")
    atoms = models.select(label.cast("int").alias("label"), part.alias("part"), model)
    atoms = atoms.select("label", (F.col("part") * 150 + F.trim(F.substring("m", 1, 9)).substr(1, 4).cast("long")).alias("model"), F.explode(F.split("m", "\n")).alias("value"))
    atoms = atoms.where("value like 'ATOM%'")
    return atoms.select("label", "model", F.trim(F.substring("value", 7, 5)).cast("int").alias("atom"), F.trim(F.substring("value", 31, 8)).cast("double").alias("x"))


_PLACED = """u AS (SELECT vec_id, e, sqrt(power(e[1] - e[4], 2) + power(e[2] - e[5], 2) + power(e[3] - e[6], 2)) AS l FROM v), w AS (SELECT vec_id, e, (e[1] - e[4]) / l AS u0, (e[2] - e[5]) / l AS u1, (e[3] - e[6]) / l AS u2 FROM u),
 n AS (SELECT *, u1 / sqrt(u0 * u0 + u1 * u1) AS n0, -u0 / sqrt(u0 * u0 + u1 * u1) AS n1 FROM w), p AS (SELECT *, n1 * u2 AS p0, -n0 * u2 AS p1, n0 * u1 - n1 * u0 AS p2 FROM n)"""


@query("fn22_placed_at_angle", f"WITH {VEC}, {_PLACED} SELECT vec_id, side, round(e[4] + (cos(radians(120)) * u0 + side * sin(radians(120)) * p0) * 1.03, 6) AS x, round(e[5] + (cos(radians(120)) * u1 + side * sin(radians(120)) * p1) * 1.03, 6) AS y, round(e[6] + (cos(radians(120)) * u2 + side * sin(radians(120)) * p2) * 1.03, 6) AS z FROM p, (SELECT unnest([1, -1])::INT AS side)")
def fn22b(spark: S, d: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    both = sc.placed_at_angle(e[:3], e[3:], 120.0, 1.03)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), *[F.round(c, 6).alias(n) for c, n in zip(p, "xyz", strict=True)]) for side, p in zip((1, -1), both, strict=True)])
    return embeddings(spark, d).select("vec_id", F.explode(sides).alias("p")).select("vec_id", "p.*")


@query("join17_atom_pairs", f"WITH {LOG}, m AS (SELECT DISTINCT atom1, atom2 FROM clean), a AS (SELECT DISTINCT atom1 AS atom, split_part(atom1, ':', 4) AS name FROM clean) SELECT m.atom1 AS atom, m.atom2 AS ref_atom, a.name AS name, b.name AS ref_name FROM m JOIN a ON a.atom = m.atom1 LEFT JOIN a b ON b.atom = m.atom2")
def join17(spark: S, d: str) -> DataFrame:
    """Given (atom, ref_atom) pairs, both atoms' names; a reference atom outside the table has none."""
    from tessellar.functions import labels as lb

    rows = log(spark, d)
    pairs = rows.select(F.col("atom1").alias("atom"), F.col("atom2").alias("ref_atom")).distinct()
    names = rows.select(F.col("atom1").alias("atom")).distinct().select("atom", lb.part(F.col("atom"), 4).alias("name"))
    return pairs.join(names, "atom").join(names.select(F.col("atom").alias("ref_atom"), F.col("name").alias("ref_name")), "ref_atom", "left").select("atom", "ref_atom", "name", "ref_name")


@query("mat28_accepted_conformers", f"WITH {VEC}, r AS (SELECT e FROM v ORDER BY vec_id LIMIT 1), x AS (SELECT v.vec_id, v.label, sqrt(list_sum(list_transform(list_zip(v.e[1:63], r.e[1:63]), lambda z: power(z[1] - z[2], 2))) / 21) AS rmsd FROM v, r) SELECT label, vec_id, round(rmsd, 6) AS rmsd FROM x WHERE rmsd <= 0.3 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5")
def mat28(spark: S, d: str) -> DataFrame:
    """Of the candidates in order, the first five of each label that lie within the bound of the reference."""
    e = embeddings(spark, d).select("label", "vec_id", F.slice("embedding", 1, 63).alias("e"))
    ref = e.orderBy("vec_id").limit(1).select(F.col("e").alias("f"))
    near = e.crossJoin(F.broadcast(ref)).select("label", "vec_id", (sc.rms_distance(F.col("e"), F.col("f")) * math.sqrt(3)).alias("rmsd")).where("rmsd <= 0.3")
    return rel.first_per_group(near, ["label"], [F.asc("vec_id")], 5).select("label", "vec_id", F.round("rmsd", 6).alias("rmsd"))
