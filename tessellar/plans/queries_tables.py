"""Queries of filters, joins, aggregates, windows, sets and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.functions import labels as lb
from tessellar.functions import scalars as sc
from tessellar.operators import contacts as ct
from tessellar.operators import relational as rel
from tessellar.operators import reshape as rs
from tessellar.operators.wide import MAX_ATTRIBUTES
from tessellar.plans.catalog import query
from tessellar.plans.core_problems import contact_values, panel
from tessellar.plans.core_problems_sql import CONTACT_CELLS, panel_names
from tessellar.session import table

S = SparkSession
LOG = r"""clean AS (SELECT DISTINCT frame, lower(regexp_replace(interaction_type, '^\s+|\s+$', '', 'g')) AS itype,
 upper(regexp_replace(atom1, '^\s+|\s+$', '', 'g')) AS atom1, upper(regexp_replace(atom2, '^\s+|\s+$', '', 'g')) AS atom2 FROM a3_contacts
 WHERE frame IS NOT NULL AND interaction_type IS NOT NULL AND atom1 IS NOT NULL AND atom2 IS NOT NULL),
res AS (SELECT *, array_to_string(string_split(atom1, ':')[1:3], ':') AS r1, array_to_string(string_split(atom2, ':')[1:3], ':') AS r2 FROM clean),
tok AS (SELECT DISTINCT frame, itype || '|' || least(r1, r2) || '|' || greatest(r1, r2) AS token FROM res WHERE r1 <> r2)"""
ENERGY = """ie AS (SELECT system, repeat, frame, component, max(e) AS e FROM interaction_energy WHERE e IS NOT NULL AND NOT isnan(e) AND component IS NOT NULL
 AND system IS NOT NULL AND repeat IS NOT NULL AND frame IS NOT NULL GROUP BY ALL)"""
BIND = ENERGY + """, bind AS (SELECT c.system, c.repeat, c.frame, c.e - p.e - l.e AS ie FROM ie c JOIN ie p USING (system, repeat, frame) JOIN ie l USING (system, repeat, frame)
 WHERE c.component = 'complex' AND p.component = 'protein' AND l.component = 'ligand')"""


def log(spark: S, d: str) -> DataFrame:
    return ct.clean_log(table(spark, d, "a3_contacts"))


def tokens(spark: S, d: str) -> DataFrame:
    return ct.frame_tokens(ct.spelt_log(table(spark, d, "a3_contacts")))


def energies(spark: S, d: str) -> DataFrame:
    """One usable energy of each component and frame."""
    rows = table(spark, d, "interaction_energy").where("e is not null and not isnan(e)").na.drop(subset=["system", "repeat", "frame", "component"])
    return rows.groupBy("system", "repeat", "frame", "component").agg(F.max("e").alias("e"))


def binding(spark: S, d: str) -> DataFrame:
    """complex - protein - ligand of the frames that have all three: one aggregation instead of a three-way join."""
    at = lambda c: F.max(F.when(F.col("component") == c, F.col("e")))
    return energies(spark, d).groupBy("system", "repeat", "frame").agg((at("complex") - at("protein") - at("ligand")).alias("ie")).where("ie is not null")


def cells(spark: S, d: str) -> DataFrame:
    from tessellar.operators.wide import supplied_cells

    return supplied_cells(contact_values(spark, d), ["system", "contact"], "frequency", "loaded_at", "row_id")


# --- sources ---------------------------------------------------------------------------------------------------------


@query("src01_numeric_order", "SELECT system, repeat FROM (SELECT DISTINCT system, repeat FROM interaction_energy WHERE system IS NOT NULL AND repeat IS NOT NULL)")
def src01(spark: S, d: str) -> DataFrame:
    return table(spark, d, "interaction_energy").where("system is not null and repeat is not null").select("system", "repeat").distinct().orderBy("system", "repeat")


@query("src02_skip_leading", f"WITH {ENERGY} SELECT system, repeat, frame - 10 AS frame, component, e FROM ie WHERE frame >= 10")
def src02(spark: S, d: str) -> DataFrame:
    return rs.skip_leading(energies(spark, d), "frame", 10)


@query("src04_tail_iterations", f"WITH {ENERGY} SELECT system, repeat, frame, component, e FROM ie QUALIFY dense_rank() OVER (PARTITION BY system, repeat ORDER BY frame DESC) <= 10")
def src04(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("system", "repeat").orderBy(F.desc("frame"))
    return energies(spark, d).withColumn("_r", F.dense_rank().over(w)).where("_r <= 10").drop("_r")


@query("src05_last_frame", f"WITH {BIND} SELECT system, repeat, max(frame) AS frame, arg_max(ie, frame) AS ie FROM bind GROUP BY ALL")
def src05(spark: S, d: str) -> DataFrame:
    return binding(spark, d).groupBy("system", "repeat").agg(F.max("frame").alias("frame"), F.max_by("ie", "frame").alias("ie"))


@query("src06_contact_lines", r"""WITH t AS (SELECT line_id, regexp_split_to_array(trim(line, E' \t\r\n\f'), '\s+') AS f FROM a3_contacts_raw WHERE line IS NOT NULL AND trim(line, E' \t\r\n\f') <> '' AND NOT starts_with(trim(line, E' \t\r\n\f'), '#'))
SELECT line_id, f[1] AS frame, f[2] AS itype, array_to_string(f[3:], ' ') AS atoms FROM t WHERE len(f) >= 4""")
def src06(spark: S, d: str) -> DataFrame:
    from tessellar.sources.text import contact_lines

    out = contact_lines(table(spark, d, "a3_contacts_raw"), "line")
    return out.select("line_id", "frame", "itype", F.array_join("atoms", " ").alias("atoms"))


@query("src08_system_tag", r"SELECT DISTINCT system AS source, nullif(regexp_extract(upper(regexp_replace(system, '\s', '', 'g')), '([A-Z]+[0-9]+_R[0-9]+)', 1), '') AS system FROM all_contacts WHERE system IS NOT NULL")
def src08(spark: S, d: str) -> DataFrame:
    return table(spark, d, "all_contacts").where("system is not null").select(F.col("system").alias("source"), lb.canonical_system(F.col("system")).alias("system")).distinct()


@query("src13_cached_records", """SELECT pdb_code, max(record_id) AS record_id FROM (SELECT pdb_code, record_id, row_number() OVER (PARTITION BY pdb_code ORDER BY fetched_at DESC NULLS LAST, record_id DESC) AS r
 FROM naming_cache WHERE pdb_code IS NOT NULL AND json_valid(payload)) WHERE r = 1 GROUP BY ALL""")
def src13(spark: S, d: str) -> DataFrame:
    from tessellar.sources.cache import latest_records

    return latest_records(table(spark, d, "naming_cache"), "pdb_code", "payload", "fetched_at", "record_id").select("pdb_code", "record_id")


@query("src13_cache_misses", "SELECT DISTINCT pdb_code FROM structures WHERE pdb_code IS NOT NULL AND pdb_code NOT IN (SELECT pdb_code FROM naming_cache WHERE pdb_code IS NOT NULL AND json_valid(payload))")
def src13m(spark: S, d: str) -> DataFrame:
    from tessellar.sources.cache import cache_misses

    return cache_misses(table(spark, d, "structures"), table(spark, d, "naming_cache"), "pdb_code", "payload")


@query("src14_structure_list", "SELECT pdb_code, coalesce(nullif(protein, ''), 'Unknown') AS protein, coalesce(nullif(species, ''), 'Unknown') AS species FROM structures")
def src14(spark: S, d: str) -> DataFrame:
    return table(spark, d, "structures").select("pdb_code", *[rel.nonnull_default(F.col(c), "Unknown").alias(c) for c in ("protein", "species")])


@query("src15_code_list", r"SELECT DISTINCT upper(x) AS code FROM (SELECT unnest(regexp_split_to_array(trim(system), '[\s,]+')) AS x FROM documents WHERE system IS NOT NULL) WHERE x <> ''")
def src15(spark: S, d: str) -> DataFrame:
    words = F.explode(F.split(F.trim("system"), r"[\s,]+")).alias("x")
    return table(spark, d, "documents").where("system is not null").select(words).where("x != ''").select(F.upper("x").alias("code")).distinct().orderBy("code")


@query("src17_matrix_fallback", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size < 25) a FULL JOIN (SELECT p_partkey AS k, p_size::DOUBLE AS v FROM part) b USING (k)")
def src17(spark: S, d: str) -> DataFrame:
    from tessellar.sources.store import first_available

    part = table(spark, d, "part")
    return first_available(part.where("p_size < 25").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), part.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v")), ["k"], "v")


@query("src22_energy_array", f"WITH {BIND} SELECT system, repeat, list(ie ORDER BY frame) AS ie FROM bind GROUP BY ALL")
def src22(spark: S, d: str) -> DataFrame:
    series = F.array_sort(F.collect_list(F.struct("frame", "ie")))
    return binding(spark, d).groupBy("system", "repeat").agg(F.transform(series, lambda x: x["ie"]).alias("ie"))


@query("src26_residue_table", f"""WITH {LOG}, a AS (SELECT atom1 AS atom, r1 AS label FROM res UNION SELECT atom2, r2 FROM res)
SELECT label, split_part(label, ':', 2) NOT IN ('HOH', 'WAT', 'TIP', 'TIP3', 'SOL', 'H2O', 'LIG') AS is_protein, split_part(label, ':', 2) IN ('HOH', 'WAT', 'TIP', 'TIP3', 'SOL', 'H2O') AS is_water,
 try_cast(split_part(label, ':', 3) AS INT) AS resseq, count(*) AS n_atoms FROM a GROUP BY ALL""")
def src26(spark: S, d: str) -> DataFrame:
    rows = log(spark, d).select(F.explode(F.array("atom1", "atom2")).alias("atom")).distinct().withColumn("label", lb.residue_of(F.col("atom")))
    name = lb.part(F.col("label"), 2)
    return rows.groupBy("label").agg(F.count("*").alias("n_atoms")).select("label", (~name.isin(*ct.WATERS, "LIG")).alias("is_protein"), name.isin(*ct.WATERS).alias("is_water"), lb.residue_number(F.col("label")).alias("resseq"), "n_atoms")


@query("src27_family_depth", """SELECT s.pdb_code, (length(lower(protein)) - length(replace(lower(protein), '_', '')))::BIGINT AS depth FROM structures s WHERE protein IS NOT NULL
 AND split_part(lower(protein), '_', 2) IN (SELECT split_part(lower(protein), '_', 2) FROM structures WHERE lower(species) = 'homo sapiens')""")
def src27(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "structures").where("protein is not null").withColumn("family", F.coalesce(F.try_element_at(F.split(F.lower("protein"), "_"), F.lit(2)), F.lit("")))
    depth = (F.length("protein") - F.length(F.replace("protein", F.lit("_"), F.lit("")))).cast("bigint").alias("depth")
    return rel.keep_members(s, s.where(F.lower("species") == "homo sapiens"), "family").select("pdb_code", depth)


# --- filters ---------------------------------------------------------------------------------------------------------


@query("sel03_not_in_names", f"WITH {LOG} SELECT DISTINCT r1 AS label FROM res WHERE split_part(r1, ':', 2) NOT IN ('HOH', 'NA', 'CL', 'POP', 'LIG')")
def sel03(spark: S, d: str) -> DataFrame:
    return ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("label")).where(~lb.part(F.col("label"), 2).isin("HOH", "NA", "CL", "POP", "LIG")).distinct()


@query("sel04_stride", f"WITH {BIND} SELECT system, repeat, frame, ie FROM bind WHERE frame % 5 = 0")
def sel04(spark: S, d: str) -> DataFrame:
    return rs.stride(binding(spark, d), 5, "frame")


@query("sel05_upper_limit", f"WITH {BIND} SELECT system, repeat, frame, ie FROM bind WHERE frame <= 100")
def sel05(spark: S, d: str) -> DataFrame:
    return binding(spark, d).where("frame <= 100")


@query("sel06_diagonal", f"WITH {ENERGY} SELECT system, repeat, frame, e FROM ie WHERE component = 'ligand'")
def sel06(spark: S, d: str) -> DataFrame:
    return energies(spark, d).where("component = 'ligand'").drop("component")


@query("sel07_family_expansion", f"WITH {LOG} SELECT itype, count(*) AS n FROM clean WHERE itype IN (SELECT itype FROM interaction_types WHERE family IN ('hydrogen bond', 'water bridge')) GROUP BY ALL")
def sel07(spark: S, d: str) -> DataFrame:
    chosen = ct.requested_types(log(spark, d), table(spark, d, "interaction_types"), ["hydrogen bond", "water bridge"])
    return rel.value_counts(chosen, ["itype"])


@query("sel07_without_water", f"WITH {LOG} SELECT itype, count(*) AS n FROM clean WHERE itype IN (SELECT itype FROM interaction_types WHERE family IN ('hydrogen bond', 'water bridge') AND NOT needs_water) GROUP BY ALL")
def sel07b(spark: S, d: str) -> DataFrame:
    chosen = ct.requested_types(log(spark, d), table(spark, d, "interaction_types"), ["hydrogen bond", "water bridge"], water_bridges=False)
    return rel.value_counts(chosen, ["itype"])


_SCOPE = """WITH {log} SELECT itype, count(*) AS n FROM res WHERE {cond} GROUP BY ALL"""
_A, _B = ("try_cast(split_part(r1, ':', 3) AS INT) BETWEEN 20 AND 200", "try_cast(split_part(r2, ':', 3) AS INT) BETWEEN 20 AND 200")


@query("sel08_scope_any", _SCOPE.format(log=LOG, cond=f"({_A}) OR ({_B})"))
def sel08(spark: S, d: str) -> DataFrame:
    ends = ct.endpoints(log(spark, d))
    return rel.value_counts(ends.where(ct.in_scope(F.col("ends"), F.sequence(F.lit(20), F.lit(200)))), ["itype"])


@query("sel08_scope_both", _SCOPE.format(log=LOG, cond=f"({_A}) AND ({_B})"))
def sel08b(spark: S, d: str) -> DataFrame:
    ends = ct.endpoints(log(spark, d))
    return rel.value_counts(ends.where(ct.in_scope(F.col("ends"), F.sequence(F.lit(20), F.lit(200)), "selected_both")), ["itype"])


@query("sel09_water_endpoints", f"WITH {LOG}, w AS (SELECT (split_part(r1, ':', 2) NOT IN ('HOH', 'LIG'))::INT + (split_part(r2, ':', 2) NOT IN ('HOH', 'LIG'))::INT AS left_ends FROM res) SELECT left_ends::BIGINT AS left_ends, count(*) AS n FROM w GROUP BY ALL")
def sel09(spark: S, d: str) -> DataFrame:
    left = F.size(ct.without_water(F.col("ends"), ("HOH", "LIG"))).cast("bigint").alias("left_ends")
    return ct.endpoints(log(spark, d)).select(left).groupBy("left_ends").agg(F.count("*").alias("n"))


@query("sel10_frequency_band", f"""WITH {LOG}, n AS (SELECT count(DISTINCT frame) AS n FROM tok), c AS (SELECT token, count(DISTINCT frame) AS k FROM tok GROUP BY 1)
SELECT token, k AS n FROM c, n WHERE k >= greatest(1, (n.n + 99) // 100) AND k <= 95 * n.n // 100""")
def sel10(spark: S, d: str) -> DataFrame:
    return rel.band(tokens(spark, d), "token", "frame", 1, 95, unique=True)


@query("sel11_share_of_maximum", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 0.9 * (SELECT max(o_totalprice) FROM orders)")
def sel11(spark: S, d: str) -> DataFrame:
    return rel.bounded_by_max(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.9)


@query("sel13_first_failing_reason", """SELECT pdb_code, CASE WHEN lower(trim(species)) <> 'homo sapiens' OR species IS NULL THEN 'species' WHEN state IS NULL OR lower(state) NOT IN ('active', 'inactive') THEN 'state'
 WHEN lower(coalesce(method, structure_type)) NOT LIKE '%x-ray%' THEN 'method' WHEN resolution > 3.0 THEN 'resolution' WHEN publication_date < '2012' THEN 'date' END AS reason FROM structures""")
def sel13(spark: S, d: str) -> DataFrame:
    rules = [
        ("species", (F.lower(F.trim("species")) != "homo sapiens") | F.col("species").isNull()),
        ("state", F.col("state").isNull() | ~F.lower("state").isin("active", "inactive")),
        ("method", ~F.lower(F.coalesce("method", "structure_type")).contains("x-ray")),
        ("resolution", F.col("resolution") > 3.0),
        ("date", F.col("publication_date") < "2012"),
    ]
    return table(spark, d, "structures").select("pdb_code", rel.first_failing_reason(rules).alias("reason"))


@query("sel14_method_class", """SELECT coalesce(CASE WHEN m LIKE '%x-ray%' THEN 'xray' WHEN m LIKE '%nmr%' THEN 'nmr' WHEN m LIKE '%electron%' OR m LIKE '%em%' THEN 'em' END, 'other') AS class, count(*) AS n
 FROM (SELECT lower(coalesce(nullif(method, ''), structure_type, '')) AS m FROM structures) GROUP BY ALL""")
def sel14(spark: S, d: str) -> DataFrame:
    text = F.coalesce(F.nullif("method", F.lit("")), "structure_type", F.lit(""))
    kind = rel.classify(text, [("x-ray", "xray"), ("nmr", "nmr"), ("electron", "em"), ("em", "em")], "other")
    return table(spark, d, "structures").select(kind.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("sel15_standard_label", r"SELECT record_id, label FROM (" + "{p5}" + r") WHERE regexp_full_match(label, '[0-9]\.[0-9]+')")
def sel15(spark: S, d: str) -> DataFrame:
    return generic_numbers(spark, d).where(F.col("label").rlike(r"^[0-9]\.[0-9]+$")).select("record_id", "label")


def generic_numbers(spark: S, d: str) -> DataFrame:
    from tessellar.plans.core_problems import p5_found

    return p5_found(spark, d)


@query("sel16_modal_count", f"""WITH {LOG}, s AS (SELECT frame, count(*) AS size FROM tok GROUP BY 1), m AS (SELECT size FROM s GROUP BY 1 ORDER BY count(*) DESC, size LIMIT 1) SELECT frame, size FROM s WHERE size IN (SELECT size FROM m)""")
def sel16(spark: S, d: str) -> DataFrame:
    sizes = tokens(spark, d).groupBy("frame").agg(F.count("*").alias("size"))
    return rel.keep_modal(sizes, "size").select("frame", "size")


@query("sel18_excess_trim", """WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1), m AS (SELECT min(n) AS m FROM c)
SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE event_type IN ('purchase', 'signup')), m WHERE r <= m""")
def sel18(spark: S, d: str) -> DataFrame:
    """The first min(n) of either kind: numbered over ranges of (kind, id), then offset by the kind's first number."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).select("event_id", "event_type")
    numbered = rs.range_index(e, ["event_type", "event_id"])
    ends = numbered.groupBy("event_type").agg(F.min("frame").alias("_f"), F.count("*").alias("n"))
    least = F.broadcast(ends.agg(F.min("n").alias("m")))
    return numbered.join(F.broadcast(ends), "event_type").crossJoin(least).where("frame - _f < m").select("event_id", "event_type")


@query("sel20_any_and_all_in_set", f"WITH {LOG} SELECT ((split_part(r1, ':', 1) = 'A') OR (split_part(r2, ':', 1) = 'A')) AS any_in, ((split_part(r1, ':', 1) = 'A') AND (split_part(r2, ':', 1) = 'A')) AS all_in, count(*) AS n FROM res GROUP BY ALL")
def sel20(spark: S, d: str) -> DataFrame:
    inside = F.transform("ends", lambda e: F.substring_index(e, ":", 1) == "A")
    ends = ct.endpoints(log(spark, d)).select(F.exists(inside, lambda x: x).alias("any_in"), F.forall(inside, lambda x: x).alias("all_in"))
    return ends.groupBy("any_in", "all_in").agg(F.count("*").alias("n"))


@query("sel21_types_then_top", f"WITH {LOG} SELECT token, count(*) AS n FROM tok WHERE token LIKE 'sb|%' OR token LIKE 'hp|%' GROUP BY 1 ORDER BY n DESC, token LIMIT 20")
def sel21(spark: S, d: str) -> DataFrame:
    chosen = tokens(spark, d).where(F.substring_index("token", "|", 1).isin("sb", "hp"))
    return rel.top_k(rel.value_counts(chosen, ["token"]), [F.desc("n"), F.asc("token")], 20)


@query("sel22_incomplete_groups", "SELECT system, repeat, count(*) AS n FROM interaction_energy GROUP BY ALL HAVING count(*) < 50")
def sel22(spark: S, d: str) -> DataFrame:
    return rel.value_counts(table(spark, d, "interaction_energy"), ["system", "repeat"]).where("n < 50")


@query("sel24_concat_labels", "SELECT row_id, concat_ws('-', res1, res2) AS label FROM all_contacts")
def sel24(spark: S, d: str) -> DataFrame:
    return table(spark, d, "all_contacts").select("row_id", F.concat_ws("-", "res1", "res2").alias("label"))


# --- joins -----------------------------------------------------------------------------------------------------------

PERM = """perm AS (SELECT year(l_shipdate)::INT AS sim_no, l_orderkey AS sim_iter, l_linenumber AS replica, l_extendedprice AS u, row_number() OVER (PARTITION BY year(l_shipdate), l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) - 1 AS state FROM lineitem)"""


def permutations(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("sim_no"), F.col("l_orderkey").alias("sim_iter"), F.col("l_linenumber").alias("replica"), F.col("l_extendedprice").alias("u"), "l_partkey")
    w = Window.partitionBy("sim_no", "sim_iter").orderBy("u", "replica", "l_partkey")
    ranked = rows.withColumn("state", (F.row_number().over(w) - 1).cast("bigint"))
    return rows.drop("l_partkey"), ranked.select("sim_no", "sim_iter", "replica", "state")


@query("join01_state_reorder", f"WITH {PERM} SELECT a.sim_no, a.sim_iter, b.state, a.u FROM perm a JOIN perm b USING (sim_no, sim_iter, replica)")
def join01(spark: S, d: str) -> DataFrame:
    u, states = permutations(spark, d)
    return rs.by_state(u, states)


@query("join02_late_payload", f"WITH {BIND}, k AS (SELECT system, repeat, frame FROM bind QUALIFY row_number() OVER (PARTITION BY system, repeat ORDER BY ie, frame) <= 5) SELECT k.system, k.repeat, k.frame, i.component, i.e FROM k JOIN ie i USING (system, repeat, frame)")
def join02(spark: S, d: str) -> DataFrame:
    """The payload of chosen frames only: of each run the five of lowest energy."""
    chosen = rel.first_per_group(binding(spark, d), ["system", "repeat"], [F.asc("ie"), F.asc("frame")], 5)
    return energies(spark, d).join(chosen.select("system", "repeat", "frame"), ["system", "repeat", "frame"]).select("system", "repeat", "frame", "component", "e")


@query("join03_index_remap", f"""WITH {LOG}, m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT r1 AS label FROM res UNION SELECT r2 FROM res) WHERE label LIKE 'A:%')
SELECT DISTINCT x.id AS i, y.id AS j FROM res JOIN m x ON x.label = r1 JOIN m y ON y.label = r2""")
def join03(spark: S, d: str) -> DataFrame:
    ends = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("a"), F.col("ends")[1].alias("b")).distinct()
    ids = ct.dictionary(ends.select(F.explode(F.array("a", "b")).alias("label")).where("label like 'A:%'"), "label")
    left = ids.select(F.col("label").alias("a"), F.col("id").alias("i"))
    return ends.join(left, "a").join(ids.select(F.col("label").alias("b"), F.col("id").alias("j")), "b").select("i", "j").distinct()


@query("join04_label_index", "SELECT e.event_id, n.id FROM events e JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')) n USING (event_type)")
def join04(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.join(ct.dictionary(e.where("event_type != 'error'"), "event_type"), "event_type").select("event_id", "id")


@query("join09_missing_reasons", """SELECT s.pdb_code, CASE WHEN n.pdb_code IS NULL THEN 'no record' WHEN n.n_ok = 0 THEN 'no readable record' END AS reason FROM structures s
 LEFT JOIN (SELECT pdb_code, sum(coalesce(json_valid(payload), false)::INT) AS n_ok FROM naming_cache GROUP BY 1) n USING (pdb_code)""")
def join09(spark: S, d: str) -> DataFrame:
    from tessellar.sources.cache import readable

    have = table(spark, d, "naming_cache").groupBy("pdb_code").agg(F.max(readable(F.col("payload")).cast("int")).alias("ok"))
    reason = F.when(F.col("ok").isNull(), "no record").when(F.col("ok") == 0, "no readable record").alias("reason")
    return table(spark, d, "structures").select("pdb_code").join(have, "pdb_code", "left").select("pdb_code", reason)


@query("join10_shared_ids", "SELECT DISTINCT pdb_code FROM structures INTERSECT SELECT DISTINCT pdb_code FROM naming_cache")
def join10(spark: S, d: str) -> DataFrame:
    return table(spark, d, "structures").select("pdb_code").intersect(table(spark, d, "naming_cache").select("pdb_code"))


@query("join11_label_lookup", "SELECT n.record_id, s.protein FROM naming_cache n JOIN structures s USING (pdb_code)")
def join11(spark: S, d: str) -> DataFrame:
    return table(spark, d, "naming_cache").select("record_id", "pdb_code").join(table(spark, d, "structures").select("pdb_code", "protein"), "pdb_code").select("record_id", "protein")


@query("join12_holds_all", "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def join12(spark: S, d: str) -> DataFrame:
    need = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    return rel.divide(table(spark, d, "events").select("user_id", "event_type"), "user_id", "event_type", need)


@query("join13_three_way_difference", f"WITH {BIND} SELECT system, repeat, frame, round(ie, 6) AS ie FROM bind")
def join13(spark: S, d: str) -> DataFrame:
    return binding(spark, d).withColumn("ie", F.round("ie", 6))


LADDER = """ladder AS (SELECT sim_no, row_number() OVER (PARTITION BY sim_no ORDER BY t) - 1 AS state, t AS temperature FROM
 (SELECT DISTINCT year(o_orderdate)::INT AS sim_no, round(300 + o_custkey % (34 + year(o_orderdate) % 7) * 1.5, 2)::DOUBLE AS t FROM orders))"""


def ladders(spark: S, d: str) -> DataFrame:
    """A ladder a year, of at most 40 rungs; how many a year has follows from its number, so some lack the upper ones."""
    year = F.year("o_orderdate")
    t = table(spark, d, "orders").select(year.alias("sim_no"), F.round(300 + F.col("o_custkey") % (34 + year % 7) * 1.5, 2).alias("temperature")).distinct()
    return t.withColumn("state", (F.row_number().over(Window.partitionBy("sim_no").orderBy("temperature")) - 1).cast("bigint"))


@query("join14_missing_rungs", f"WITH {LADDER}, f AS (SELECT DISTINCT round(300 + i * 1.5, 2)::DOUBLE AS temperature, i AS state FROM range(40) r(i)) SELECT s.sim_no, f.state, f.temperature FROM (SELECT DISTINCT sim_no FROM ladder) s CROSS JOIN f ANTI JOIN ladder l ON l.sim_no = s.sim_no AND l.temperature = f.temperature")
def join14(spark: S, d: str) -> DataFrame:
    final = spark.range(40).select(F.col("id").alias("state"), F.round(300 + F.col("id") * 1.5, 2).alias("temperature"))
    return rs.missing_states(ladders(spark, d), final)


MONTHS = "m AS (SELECT o_orderstatus AS run, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate))::INT AS point, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY ALL)"


def checkpoints(spark: S, d: str) -> DataFrame:
    point = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("run"), point.alias("point")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query("join15_earlier_checkpoints", f"WITH {MONTHS} SELECT a.run, a.point, b.point AS previous, a.value, b.value AS previous_value FROM m a JOIN m b ON a.run = b.run AND b.point >= floor(0.9 * a.point) AND b.point < a.point")
def join15(spark: S, d: str) -> DataFrame:
    return rs.earlier_checkpoints(checkpoints(spark, d), 0.9)


@query("join20_frame_map", f"WITH {PERM}, f AS (SELECT *, dense_rank() OVER (ORDER BY sim_no, sim_iter) - 1 AS frame FROM perm) SELECT frame, state, sim_no, sim_iter, replica FROM f")
def join20(spark: S, d: str) -> DataFrame:
    _, states = permutations(spark, d)
    frames = rs.range_index(states.select("sim_no", "sim_iter").distinct(), ["sim_no", "sim_iter"])
    return states.join(frames, ["sim_no", "sim_iter"]).select("frame", "state", "sim_no", "sim_iter", "replica")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("agg01_mean_energy", f"WITH {ENERGY} SELECT system, frame, round(avg(e), 6) AS mean FROM ie GROUP BY ALL")
def agg01(spark: S, d: str) -> DataFrame:
    return energies(spark, d).groupBy("system", "frame").agg(F.round(F.avg("e"), 6).alias("mean"))


@query("agg02_contact_frequency", f"WITH {LOG} SELECT token, count(*) AS n, round(count(*) / (SELECT count(DISTINCT frame) FROM tok), 9) AS frequency FROM tok GROUP BY 1")
def agg02(spark: S, d: str) -> DataFrame:
    return rel.relative_frequency(tokens(spark, d), ["token"], "frame", 9)


@query("agg03_distinct_tokens", f"WITH {LOG} SELECT token, count(DISTINCT frame) AS n FROM tok GROUP BY 1")
def agg03(spark: S, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))


@query("agg04_value_counts", "SELECT state, species, count(*) AS n FROM structures GROUP BY ALL")
def agg04(spark: S, d: str) -> DataFrame:
    return rel.value_counts(table(spark, d, "structures"), ["state", "species"])


@query("agg05_names_by_chain", f"WITH {LOG}, a AS (SELECT r1 AS r FROM res UNION SELECT r2 FROM res) SELECT split_part(r, ':', 1) AS chain, list_sort(list(DISTINCT split_part(r, ':', 2))) AS names FROM a GROUP BY 1")
def agg05(spark: S, d: str) -> DataFrame:
    ends = ct.endpoints(log(spark, d)).select(F.explode("ends").alias("r")).distinct()
    return ends.groupBy(lb.part(F.col("r"), 1).alias("chain")).agg(F.array_sort(F.collect_set(lb.part(F.col("r"), 2))).alias("names"))


@query("agg06_conservation", """WITH l AS (SELECT DISTINCT record_id, label FROM ({p5}) WHERE scheme = 'BW'), n AS (SELECT count(DISTINCT record_id) AS n FROM l)
SELECT label, round(count(*) / n.n, 9) AS ratio FROM l, n GROUP BY label, n.n HAVING count(*) >= 0.02 * n.n""")
def agg06(spark: S, d: str) -> DataFrame:
    rows = generic_numbers(spark, d).where("scheme = 'BW'").select("record_id", "label").distinct()
    out = rel.relative_frequency(rows, ["label"], "record_id").where("frequency >= 0.02")
    return out.orderBy(*rel.natural_key(F.col("label"))).select("label", F.round("frequency", 9).alias("ratio"))


def pivot_all(spark: S, d: str, fill: float | None = None) -> DataFrame:
    """One row per contact of any system: a column for each panel system, and the systems outside the panel, whose number
    grows with the data, as two arrays in system order. Where no row supplies a panel cell it is ``fill``."""
    names = [a.name for a in panel(spark, d)]
    if len(names) > MAX_ATTRIBUTES:
        raise ValueError(f"a panel of more than {MAX_ATTRIBUTES} systems")
    held = cells(spark, d).groupBy("contact").agg(F.sort_array(F.collect_list(F.struct("system", F.round("frequency", 6).alias("frequency")))).alias("held"))
    held = held.select("contact", F.map_from_entries("held").alias("m"), F.filter("held", lambda c: ~c["system"].isin(names)).alias("rest"))
    columns = [F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(fill).cast("double")).alias(s) for s in names]
    return held.select("contact", *columns, F.col("rest.system").alias("other_systems"), F.col("rest.frequency").alias("other_values"))


_PANEL = panel_names()
_OTHERS = ", ".join(f"coalesce(list({x} ORDER BY system) FILTER (system NOT IN {(*_PANEL, '')}), []) AS {n}" for x, n in (("system", "other_systems"), ("round(frequency, 6)", "other_values")))
_ALL_SQL = ", ".join("{l}max(CASE WHEN system = '%s' THEN round(frequency, 6) END){r} AS \"%s\"" % (s, s) for s in _PANEL)


@query("agg07_pivot_sum", f"WITH {CONTACT_CELLS} SELECT contact, {_ALL_SQL.format(l='', r='')}, {_OTHERS} FROM cells GROUP BY 1")
def agg07(spark: S, d: str) -> DataFrame:
    return pivot_all(spark, d)


@query("agg08_pivot_mean_filled", f"WITH {CONTACT_CELLS} SELECT contact, {_ALL_SQL.format(l='coalesce(', r=', 0)')}, {_OTHERS} FROM cells GROUP BY 1")
def agg08(spark: S, d: str) -> DataFrame:
    """A system outside the panel that isn't listed has 0 as well."""
    return pivot_all(spark, d, 0.0)


@query("agg09_row_mean_top", f"WITH {CONTACT_CELLS} SELECT contact, round(sum(frequency) / (SELECT count(DISTINCT system) FROM cells), 12) AS mean FROM cells GROUP BY 1 ORDER BY mean DESC, contact LIMIT 40")
def agg09(spark: S, d: str) -> DataFrame:
    """Mean over all systems, missing cells as 0: the sum over their number, so no column is needed."""
    n = cells(spark, d).agg(F.countDistinct("system").alias("n"))
    sums = cells(spark, d).groupBy("contact").agg(F.sum("frequency").alias("s")).crossJoin(F.broadcast(n))
    return rel.top_k(sums.select("contact", F.round(F.col("s") / F.col("n"), 12).alias("mean")), [F.desc("mean"), F.asc("contact")], 40)


@query("agg10_energy_summary", f"WITH {BIND} SELECT system, count(*) AS n, round(avg(ie), 3) AS mean, round(stddev_pop(ie), 3) AS std FROM bind GROUP BY 1")
def agg10(spark: S, d: str) -> DataFrame:
    return rel.population_summary(binding(spark, d), ["system"], "ie")


@query("agg11_standard_error", f"WITH {BIND} SELECT system, round(avg(ie), 6) AS mean, round(stddev_pop(ie) / sqrt(count(*)), 6) AS error FROM bind GROUP BY 1")
def agg11(spark: S, d: str) -> DataFrame:
    return binding(spark, d).groupBy("system").agg(F.round(F.avg("ie"), 6).alias("mean"), F.round(F.stddev_pop("ie") / F.sqrt(F.count("*")), 6).alias("error"))


RATES = "rates AS (SELECT event_type, user_id % 12 AS state, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) AS rate, bool_or(value < 0.5) AS poisoned FROM events GROUP BY ALL)"


@query("agg13_acceptance_rate", f"WITH {RATES} SELECT event_type, state, CASE WHEN poisoned THEN 0 ELSE round(rate, 6) END AS rate FROM rates")
def agg13(spark: S, d: str) -> DataFrame:
    from tessellar.operators.stats import acceptance_rate

    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 12).alias("state"), (F.col("value") > 60).cast("int").alias("accepted"), (F.col("value") >= 0.5).cast("int").alias("proposed"))
    return acceptance_rate(e, ["event_type", "state"])


@query("agg17_argmin", f"WITH {BIND} SELECT system, arg_min(frame, (ie, repeat, frame)) AS frame, round(min(ie), 6) AS ie FROM bind GROUP BY 1")
def agg17(spark: S, d: str) -> DataFrame:
    best = F.min(F.struct("ie", "repeat", "frame")).alias("b")
    return binding(spark, d).groupBy("system").agg(best).select("system", F.col("b.frame").alias("frame"), F.round("b.ie", 6).alias("ie"))


@query("agg18_bounding_box", f"WITH {BIND} SELECT system, round(min(ie), 6) AS low, round(max(ie), 6) AS high FROM bind GROUP BY 1")
def agg18(spark: S, d: str) -> DataFrame:
    return binding(spark, d).groupBy("system").agg(F.round(F.min("ie"), 6).alias("low"), F.round(F.max("ie"), 6).alias("high"))


@query("agg19_all_pass", f"WITH {BIND} SELECT system, count(*) > 0 AND bool_and(ie < 0) AS passed FROM bind GROUP BY 1")
def agg19(spark: S, d: str) -> DataFrame:
    return binding(spark, d).groupBy("system").agg(rel.all_pass(F.col("ie") < 0).alias("passed"))


@query("agg20_set_sizes", f"""WITH {LOG}, s AS (SELECT frame, list_sort(list(token)) AS t FROM tok GROUP BY 1), mx AS (SELECT max(frame) AS m FROM tok)
SELECT (m + 1 - count(*))::BIGINT AS n_empty, round(avg(len(t)), 6) AS mean_size, median(len(t)) AS median_size, count(DISTINCT t) AS n_distinct FROM s, mx GROUP BY m""")
def agg20(spark: S, d: str) -> DataFrame:
    f = ct.fingerprints(tokens(spark, d))
    return f.agg((F.max("frame") + 1 - F.count("*")).cast("bigint").alias("n_empty"), F.round(F.avg("size"), 6).alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.countDistinct("tokens").alias("n_distinct"))


@query("agg21_first_occurrence", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def agg21(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("agg24_breakdown_residual", f"WITH {ENERGY} SELECT system, component, round(sum(e), 3) AS part, round(sum(sum(e)) OVER (PARTITION BY system) - sum(e), 3) AS rest FROM ie GROUP BY system, component")
def agg24(spark: S, d: str) -> DataFrame:
    g = energies(spark, d).groupBy("system", "component").agg(F.sum("e").alias("part"))
    return g.select("system", "component", F.round("part", 3).alias("part"), F.round(F.sum("part").over(Window.partitionBy("system")) - F.col("part"), 3).alias("rest"))


@query("agg25_centre_of_mass", "SELECT l_orderkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS centre FROM lineitem GROUP BY 1")
def agg25(spark: S, d: str) -> DataFrame:
    from tessellar.operators.stats import weighted_mean

    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("centre"))


# --- ordered sequences -----------------------------------------------------------------------------------------------


@query("win01_global_frame", f"WITH {BIND} SELECT system, repeat, frame AS sim_iter, row_number() OVER (ORDER BY system, repeat, frame) - 1 AS frame FROM bind")
def win01(spark: S, d: str) -> DataFrame:
    return rs.range_index(binding(spark, d).select("system", "repeat", F.col("frame").alias("sim_iter")), ["system", "repeat", "sim_iter"])


@query("win03_suffix_reset", f"WITH {MONTHS}, s AS (SELECT run, point, value > 140000 AS ok, lead(1) OVER (PARTITION BY run ORDER BY point) IS NULL AS last FROM m) SELECT run, point, NOT bool_or(NOT ok) OVER (PARTITION BY run ORDER BY point ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS steady FROM s WHERE NOT last")
def win03(spark: S, d: str) -> DataFrame:
    flagged = checkpoints(spark, d).withColumn("ok", F.col("value") > 140000)
    return rs.suffix_reset(flagged, ["run"], "point", "ok").select("run", "point", "steady")


@query("win04_insert_rungs", f"""WITH {LADDER}, r AS (SELECT *, lag(temperature) OVER w AS low, lag(state) OVER w AS src, (state * 37 % 100) / 100.0 AS rate FROM ladder WINDOW w AS (PARTITION BY sim_no ORDER BY state)),
u AS (SELECT sim_no, temperature, state AS source_state FROM ladder UNION ALL SELECT sim_no, (low + temperature) / 2, src FROM r WHERE rate < 0.4 AND low IS NOT NULL)
SELECT sim_no, temperature, source_state, row_number() OVER (PARTITION BY sim_no ORDER BY temperature, source_state) - 1 AS state FROM u""")
def win04(spark: S, d: str) -> DataFrame:
    ladder = ladders(spark, d)
    rates = ladder.select("sim_no", "state", ((F.col("state") * 37 % 100) / 100.0).alias("rate"))
    return rs.insert_rungs(ladder, rates, 0.4).withColumn("state", F.col("state").cast("bigint"))


@query("win06_normalise", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (), 9) AS x FROM orders")
def win06(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_totalprice").alias("m")))).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("m"), 9).alias("x"))


@query("win07_min_max_scaling", "SELECT o_orderkey, round((mx - o_totalprice) / (mx - mn), 9) AS x FROM orders, (SELECT max(o_totalprice) AS mx, min(o_totalprice) AS mn FROM orders)")
def win07(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ends = F.broadcast(o.agg(F.max("o_totalprice").alias("mx"), F.min("o_totalprice").alias("mn")))
    return o.crossJoin(ends).select("o_orderkey", F.round((F.col("mx") - F.col("o_totalprice")) / (F.col("mx") - F.col("mn")), 9).alias("x"))


@query("win10_gap_check", f"WITH {LOG}, a AS (SELECT DISTINCT split_part(r1, ':', 1) AS chain, try_cast(split_part(r1, ':', 3) AS INT) AS n FROM res) SELECT chain, max(n) - min(n) + 1 - count(*) AS gaps FROM a WHERE n IS NOT NULL GROUP BY 1")
def win10(spark: S, d: str) -> DataFrame:
    a = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("r")).select(lb.part(F.col("r"), 1).alias("chain"), lb.residue_number(F.col("r")).alias("n")).where("n is not null").distinct()
    return a.groupBy("chain").agg((F.max("n") - F.min("n") + 1 - F.count("*")).alias("gaps"))


@query("win11_deviation", f"WITH {BIND} SELECT system, repeat, frame, round(abs(ie - last_value(ie) OVER (PARTITION BY system, repeat ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS deviation FROM bind")
def win11(spark: S, d: str) -> DataFrame:
    return rs.deviation_from_last(binding(spark, d), ["system", "repeat"], "frame", "ie").select("system", "repeat", "frame", F.round("deviation", 6).alias("deviation"))


@query("win12_islands", f"""WITH {LOG}, a AS (SELECT DISTINCT split_part(r1, ':', 1) AS chain, try_cast(split_part(r1, ':', 3) AS INT) AS n FROM res), i AS (SELECT chain, n, n - row_number() OVER (PARTITION BY chain ORDER BY n) AS k FROM a WHERE n IS NOT NULL)
SELECT chain, min(n) AS start, max(n) AS stop, count(*) AS length FROM i GROUP BY chain, k HAVING count(*) >= 3""")
def win12(spark: S, d: str) -> DataFrame:
    a = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("r")).select(lb.part(F.col("r"), 1).alias("chain"), lb.residue_number(F.col("r")).alias("n"))
    return rel.islands(a, ["chain"], "n", 3)


# --- order, sets -----------------------------------------------------------------------------------------------------


@query("ord02_top_contacts", f"WITH {LOG} SELECT token, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, token LIMIT 20")
def ord02(spark: S, d: str) -> DataFrame:
    return rel.top_k(rel.value_counts(tokens(spark, d), ["token"]), [F.desc("n"), F.asc("token")], 20)


@query("ord03_most_common", "SELECT species, count(*) AS n FROM structures WHERE species IS NOT NULL GROUP BY 1 ORDER BY n DESC, species LIMIT 5")
def ord03(spark: S, d: str) -> DataFrame:
    return rel.top_k(rel.value_counts(table(spark, d, "structures").where("species is not null"), ["species"]), [F.desc("n"), F.asc("species")], 5)


@query("ord04_natural_sort", r"""SELECT label, (row_number() OVER (ORDER BY CASE WHEN regexp_full_match(label, '[0-9]+\.[0-9]+') THEN split_part(label, '.', 1)::INT ELSE 999 END,
 CASE WHEN regexp_full_match(label, '[0-9]+\.[0-9]+') THEN split_part(label, '.', 2)::INT ELSE 999 END, label))::BIGINT AS place FROM (SELECT DISTINCT label FROM ({p5}))""")
def ord04(spark: S, d: str) -> DataFrame:
    a, b = rel.natural_key(F.col("label"))
    keyed = generic_numbers(spark, d).select("label").distinct().select("label", a.alias("a"), b.alias("b"))
    placed = rs.range_index(keyed, ["a", "b", "label"])
    return placed.select("label", (F.col("frame") + 1).alias("place"))


@query("ord05_first_k_per_group", f"WITH {BIND} SELECT system, repeat, frame, ie FROM bind QUALIFY row_number() OVER (PARTITION BY system ORDER BY repeat, frame) <= 3")
def ord05(spark: S, d: str) -> DataFrame:
    return rel.first_per_group(binding(spark, d), ["system"], [F.asc("repeat"), F.asc("frame")], 3)


@query("ord06_latest", "SELECT system, max(repeat) AS latest FROM interaction_energy WHERE system IS NOT NULL GROUP BY 1")
def ord06(spark: S, d: str) -> DataFrame:
    return table(spark, d, "interaction_energy").where("system is not null").groupBy("system").agg(F.max("repeat").alias("latest"))


@query("set01_union_all", "SELECT 'c' AS side, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def set01(spark: S, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("k"))
    return rel.value_counts(a.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("k"))), ["side", "k"])


@query("set02_intersection", f"WITH {CONTACT_CELLS} SELECT contact FROM cells WHERE system = 'XN5_R8' INTERSECT SELECT contact FROM cells WHERE system = 'BH1_R1'")
def set02(spark: S, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.where("system = 'XN5_R8'").select("contact").intersect(c.where("system = 'BH1_R1'").select("contact"))


@query("set03_difference", f"WITH {CONTACT_CELLS} SELECT contact FROM cells WHERE system = 'XN5_R8' EXCEPT SELECT contact FROM cells WHERE system = 'BH1_R1'")
def set03(spark: S, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.where("system = 'XN5_R8'").select("contact").subtract(c.where("system = 'BH1_R1'").select("contact"))


@query("set04_all_keys", "SELECT system FROM panel_systems UNION SELECT system FROM interaction_energy WHERE system IS NOT NULL")
def set04(spark: S, d: str) -> DataFrame:
    return table(spark, d, "panel_systems").select("system").union(table(spark, d, "interaction_energy").where("system is not null").select("system")).distinct()


@query("set05_offset_union", "SELECT p_partkey - 1 AS idx, p_name AS name FROM part UNION ALL SELECT s_suppkey - 1 + (SELECT count(*) FROM part), s_name FROM supplier")
def set05(spark: S, d: str) -> DataFrame:
    from tessellar.operators.topology import append_with_offset

    a = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("idx"), F.col("p_name").alias("name"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("idx"), F.col("s_name").alias("name"))
    return append_with_offset(a, b, ["idx"])


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("fn01_label_parts", f"WITH {LOG} SELECT DISTINCT atom1, split_part(atom1, ':', 4) AS name, r1 AS residue FROM res")
def fn01(spark: S, d: str) -> DataFrame:
    a = F.col("atom1")
    return log(spark, d).select("atom1", lb.part(a, 4).alias("name"), lb.residue_of(a).alias("residue")).distinct()


@query("fn02_atom_class", f"WITH {LOG} SELECT CASE WHEN left(split_part(atom1, ':', 4), 1) IN ('N', 'O', 'S', 'P', 'C') THEN left(split_part(atom1, ':', 4), 1) ELSE 'X' END AS class, count(*) AS n FROM res GROUP BY 1")
def fn02(spark: S, d: str) -> DataFrame:
    return log(spark, d).select(lb.atom_class(lb.part(F.col("atom1"), 4)).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("fn03_undirected_token", f"WITH {LOG} SELECT frame, token FROM tok")
def fn03(spark: S, d: str) -> DataFrame:
    return tokens(spark, d)


_THREE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


@query("fn04_one_letter", f"WITH {LOG}, a AS (SELECT DISTINCT r1 FROM res) SELECT r1 AS label, CASE split_part(r1, ':', 2) {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _THREE.items())} ELSE 'X' END AS letter FROM a")
def fn04(spark: S, d: str) -> DataFrame:
    return ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("label")).distinct().select("label", sc.one_letter(lb.part(F.col("label"), 2)).alias("letter"))


@query("fn04_aliases_and_skips", f"""WITH {LOG}, a AS (SELECT DISTINCT r1 AS label, split_part(r1, ':', 2) AS name FROM res UNION SELECT 'X:' || x || ':1', x FROM (SELECT unnest(['HIE', 'HSD', 'CYX', 'GLH', 'MSE', 'ACE', 'NH2', 'TIP', 'ZN', 'XYZ']) AS x))
 SELECT label, CASE name WHEN 'HIE' THEN 'HIS' WHEN 'HSD' THEN 'HIS' WHEN 'CYX' THEN 'CYS' WHEN 'GLH' THEN 'GLU' WHEN 'MSE' THEN 'MET' ELSE name END AS name FROM a WHERE name NOT IN ('ACE', 'NME', 'NH2', 'NHE', 'CBT', 'FOR', 'WAT', 'HOH', 'TIP', 'SOL', 'NA', 'CL', 'MG', 'ZN')""")
def fn04b(spark: S, d: str) -> DataFrame:
    """Names in one spelling, without what belongs to no protein; with names of each kind added to those of the log."""
    extra = spark.createDataFrame([(f"X:{x}:1",) for x in ("HIE", "HSD", "CYX", "GLH", "MSE", "ACE", "NH2", "TIP", "ZN", "XYZ")], "label string")
    labels = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("label")).unionByName(extra).distinct()
    name = lb.part(F.col("label"), 2)
    return labels.where(sc.is_protein_name(name)).select("label", sc.residue_name(name).alias("name"))


@query("fn05_thermal_energy", f"WITH {LADDER} SELECT sim_no, state, round(temperature * 0.0083144626, 9) AS kt FROM ladder")
def fn05(spark: S, d: str) -> DataFrame:
    return ladders(spark, d).select("sim_no", "state", F.round(sc.thermal_energy(F.col("temperature")), 9).alias("kt"))


@query("fn06_ladders", "SELECT i, round(300 + 150 * (exp(i / 99.0) - 1) / (exp(1.0) - 1), 6) AS exponential, round(300 * pow(450.0 / 300, i / 99.0), 6) AS geometric FROM range(100) r(i)")
def fn06(spark: S, d: str) -> DataFrame:
    i, n, lo, hi = F.col("id"), F.lit(100), F.lit(300.0), F.lit(450.0)
    return spark.range(100).select(F.col("id").alias("i"), F.round(rs.exponential_ladder(i, n, lo, hi), 6).alias("exponential"), F.round(rs.geometric_ladder(i, n, lo, hi), 6).alias("geometric"))


@query("fn07_periodic_difference", "SELECT event_id, round(least(x, 360 - x), 6) AS d FROM (SELECT event_id, abs(value % 360 - (event_id * 37) % 360) AS x FROM events)")
def fn07(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.round(sc.periodic_difference(F.col("value") % 360, (F.col("event_id") * 37 % 360).cast("double"), F.lit(360.0)), 6).alias("d"))


@query("fn09_nearest_image", "SELECT event_id, round(x - 100 * floor(x / 100.0::DOUBLE + 0.5), 6) AS d FROM (SELECT event_id, value - 250 AS x FROM events UNION ALL SELECT -1 - (k + 3), k * 50.0::DOUBLE FROM range(-3, 4) r(k))")
def fn09(spark: S, d: str) -> DataFrame:
    """With the seven displacements of whole and half cells, at which two images are equally near."""
    e = table(spark, d, "events").select("event_id", (F.col("value") - 250).alias("x"))
    ties = spark.range(-3, 4).select((-1 - (F.col("id") + 3)).alias("event_id"), (F.col("id") * F.lit(50.0)).alias("x"))
    return e.unionByName(ties).select("event_id", F.round(sc.nearest_image(F.col("x"), F.lit(100.0)), 6).alias("d"))


@query("fn10_log_error", f"WITH {BIND}, s AS (SELECT system, abs(avg(ie)) AS m, stddev_pop(ie) / sqrt(count(*)) AS e FROM bind GROUP BY 1) SELECT system, round(log10(m), 6) AS value, round(0.434 * e / m, 6) AS error FROM s WHERE m > 0")
def fn10(spark: S, d: str) -> DataFrame:
    s = binding(spark, d).groupBy("system").agg(F.abs(F.avg("ie")).alias("m"), (F.stddev_pop("ie") / F.sqrt(F.count("*"))).alias("e")).where("m > 0")
    value, error = sc.log10_with_error(F.col("m"), F.col("e"))
    return s.select("system", F.round(value, 6).alias("value"), F.round(error, 6).alias("error"))


@query("fn11_saturating_cap", f"WITH {BIND} SELECT system, repeat, frame, round(50 * tanh(ie / 50), 6) AS x FROM bind")
def fn11(spark: S, d: str) -> DataFrame:
    return binding(spark, d).select("system", "repeat", "frame", F.round(sc.saturate(F.col("ie"), 50.0), 6).alias("x"))


@query("fn12_pair_terms", "SELECT l_orderkey, l_linenumber, round(332.06 * l_tax / l_quantity, 6) AS coulomb, round(sqrt(l_discount) * pow(l_quantity, 6) / pow(l_quantity + 1, 12), 9) AS repulsion, round(-2 * sqrt(l_discount) * pow(l_quantity, 3) / pow(l_quantity + 1, 6), 9) AS attraction FROM lineitem")
def fn12(spark: S, d: str) -> DataFrame:
    q, r, e = F.col("l_quantity"), F.col("l_quantity") + 1, F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.coulomb(F.col("l_tax"), q), 6).alias("coulomb"), F.round(sc.lj_repulsion(e, q, r), 9).alias("repulsion"), F.round(sc.lj_attraction(e, q, r), 9).alias("attraction"))


@query("fn13_ab_to_sigma", "SELECT p_partkey, CASE WHEN b = 0 THEN 1.0 ELSE round(pow(a / b, 1.0 / 6), 9) END AS sigma, CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE round(b * b / (4 * a), 9) END AS epsilon FROM (SELECT p_partkey, p_retailprice AS a, (p_size % 5)::DOUBLE AS b FROM part)")
def fn13(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") % 5).cast("double").alias("b"))
    sigma, epsilon = sc.sigma_epsilon(F.col("a"), F.col("b"))
    return p.select("p_partkey", F.round(sigma, 9).alias("sigma"), F.round(epsilon, 9).alias("epsilon"))


@query("fn14_layered_dielectric", "SELECT event_id, CASE WHEN z < 10 THEN 2.0 WHEN z < 20 THEN round(2.0 + (7.0 - 2.0) * (z - 10) / 10, 6) WHEN z < 25 THEN round(7.0 + (80.0 - 7.0) * (z - 20) / 5, 6) ELSE 80.0 END AS eps FROM (SELECT event_id, abs(value - 245) / 5 AS z FROM events)")
def fn14(spark: S, d: str) -> DataFrame:
    z = F.abs(F.col("value") - 245) / 5
    return table(spark, d, "events").select("event_id", F.round(sc.layered(z, [(10.0, 2.0, 2.0), (20.0, 2.0, 7.0), (25.0, 7.0, 80.0)], 80.0), 6).alias("eps"))


@query("fn14_blend_and_harmonic", "SELECT p_partkey, round(2.0 + 78.0 / (1 + exp(-(p_size - 25) / 4.0::DOUBLE)), 6) AS blend, round(2.0::DOUBLE * p_size * p_retailprice / (p_size + p_retailprice), 6) AS mean FROM part")
def fn14b(spark: S, d: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(sc.sigmoid_blend(size, 25.0, 4.0, 2.0, 80.0), 6).alias("blend"), F.round(sc.harmonic_mean(size, price), 6).alias("mean"))


# The second derivatives of the natural spline through (0, 0), (1, 1), (2, 0), (3, 1) are 0, a, b, 0 with 4 a + b = -12 and
# a + 4 b = 12, so a = -4 and b = 4.
@query("fn15_natural_spline", """SELECT event_id, round(m0 * power(k + 1 - x, 3) / 6 + m1 * power(x - k, 3) / 6 + (y0 - m0 / 6) * (k + 1 - x) + (y1 - m1 / 6) * (x - k), 6) AS y FROM
 (SELECT event_id, x, k, CASE k WHEN 1 THEN -4.0::DOUBLE WHEN 2 THEN 4.0::DOUBLE ELSE 0 END AS m0, CASE k WHEN 0 THEN -4.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE ELSE 0 END AS m1, k % 2 AS y0, (k + 1) % 2 AS y1
  FROM (SELECT event_id, x, least(floor(x), 2)::INT AS k FROM (SELECT event_id, value % 3 AS x FROM events)))""")
def fn15s(spark: S, d: str) -> DataFrame:
    y = sc.natural_spline(F.col("value") % 3, [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 0.0, 1.0])
    return table(spark, d, "events").select("event_id", F.round(y, 6).alias("y"))


@query("fn15_step_profile", "SELECT event_id, CASE WHEN value < 100 THEN 0.0 WHEN value = 100 THEN 0.5 ELSE 1.0 END::DOUBLE AS h FROM events")
def fn15(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", sc.heaviside(F.col("value") - 100).alias("h"))


@query("fn17_suffix_strip", r"SELECT DISTINCT system AS source, regexp_replace(system, '(?i)_frequencies(\.tsv)?\s*$', '') AS name FROM all_contacts WHERE system IS NOT NULL")
def fn17(spark: S, d: str) -> DataFrame:
    return table(spark, d, "all_contacts").where("system is not null").select(F.col("system").alias("source"), F.regexp_replace("system", r"(?i)_frequencies(\.tsv)?\s*$", "").alias("name")).distinct()


@query("fn18_half_even", "SELECT k, CASE WHEN k % 2 = 0 THEN (k // 2)::DOUBLE ELSE (CASE WHEN (k // 2) % 2 = 0 THEN k // 2 ELSE k // 2 + 1 END)::DOUBLE END AS x FROM (SELECT DISTINCT p_size AS k FROM part)")
def fn18(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_size").alias("k")).distinct().select("k", F.bround(F.col("k") / 2).alias("x"))


@query("fn19_json_default", "SELECT event_id, coalesce(nullif(props->>'$.k', ''), 'Unknown') AS k FROM events")
def fn19(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", rel.nonnull_default(F.get_json_object("props", "$.k"), "Unknown").alias("k"))


@query("fn20_scheme_label", "SELECT record_id, sequence_number, arg_min(label, alt_pos) AS label FROM ({p5}) WHERE scheme = 'BW' GROUP BY ALL")
def fn20(spark: S, d: str) -> DataFrame:
    return generic_numbers(spark, d).where("scheme = 'BW'").groupBy("record_id", "sequence_number").agg(F.min_by("label", "alt_pos").alias("label"))


@query("fn21_sequence_string", f"WITH {LOG}, a AS (SELECT DISTINCT split_part(r1, ':', 1) AS chain, try_cast(split_part(r1, ':', 3) AS INT) AS n, left(split_part(r1, ':', 2), 1) AS c FROM res) SELECT chain, string_agg(c, '' ORDER BY n, c) AS sequence FROM a GROUP BY 1")
def fn21(spark: S, d: str) -> DataFrame:
    a = ct.endpoints(log(spark, d)).select(F.col("ends")[0].alias("r")).select(lb.part(F.col("r"), 1).alias("chain"), lb.residue_number(F.col("r")).alias("n"), F.substring(lb.part(F.col("r"), 2), 1, 1).alias("c")).distinct()
    return a.groupBy("chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "").alias("sequence"))


@query("fn23_iteration_budget", "SELECT o_orderkey, ceil(o_totalprice / 25000)::BIGINT AS n_checkpoints, ceil(ceil(o_totalprice / 25000) * 25000 / 1000)::BIGINT AS n_iterations FROM orders")
def fn23(spark: S, d: str) -> DataFrame:
    n = F.ceil(F.col("o_totalprice") / 25000)
    return table(spark, d, "orders").select("o_orderkey", n.alias("n_checkpoints"), F.ceil(n * 25000 / 1000).alias("n_iterations"))


@query("fn24_effective_window", f"WITH {MONTHS} SELECT run, point, round(greatest(1 - e, 0.25), 9) AS share, trunc((1 - e) * point)::INT AS first FROM (SELECT run, point, (value % 1000) / 1000 AS e FROM m)")
def fn24(spark: S, d: str) -> DataFrame:
    m = checkpoints(spark, d).select("run", "point", (F.col("value") % 1000 / 1000).alias("e"))
    share, first = rs.effective_window(F.col("e"), 0.75, F.col("point"))
    return m.select("run", "point", F.round(share, 9).alias("share"), first.alias("first"))
