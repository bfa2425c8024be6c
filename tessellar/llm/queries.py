"""Queries of the training-data algorithms, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import leakage, packing, pii, terms, topn
from tessellar.functions.labels import trimmed
from tessellar.operators import wide
from tessellar.plans.core_problems import contact_values, few
from tessellar.plans.core_problems_sql import CONTACT_CELLS
from tessellar.session import materialise, table

TOP = 20
MAX_CONTAINERS = 100


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = wide.supplied_cells(contact_values(spark, sf_dir), ["system", "contact"], "frequency", "loaded_at", "row_id")
    return topn.top_n(cells, "system", "contact", "frequency", TOP)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_ranked(spark, sf_dir).select("system", "contact", "pos")


def p4_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"interaction_type": F.lower(trimmed(F.col("interaction_type"))), "atom1": F.upper(trimmed(F.col("atom1"))), "atom2": F.upper(trimmed(F.col("atom2")))}
    return terms.marked(*terms.term_frequencies(table(spark, sf_dir, "a3_contacts"), fields, "frame"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_frequencies(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capacity on its own, and all of them together as ``mixed``."""
    kinds = {r[0]: [r[1]] for r in few(table(spark, sf_dir, "containers").orderBy("capacity_tokens"), MAX_CONTAINERS, "containers")}
    schemes = kinds | {"mixed": [c for cs in kinds.values() for c in cs]}
    return packing.pack_documents(table(spark, sf_dir, "documents"), schemes)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of their room in use, by scheme and capacity."""
    each = p6_packed(spark, sf_dir).groupBy("scheme", "capacity", "container_id").agg(F.sum("piece_tokens").alias("tokens"))
    total = each.groupBy("scheme", "capacity").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    return total.withColumn("fill", F.round(F.col("n_tokens") / (F.col("capacity") * F.col("n_containers")), 6))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By scheme: the documents placed, and how often a rule is broken - a container over its capacity or of two
    capacities, a document in pieces that fits the largest one, pieces that aren't numbered through or not full."""
    packed = materialise(p6_packed(spark, sf_dir), "packed")
    top = F.broadcast(packed.groupBy("scheme").agg(F.max("capacity").alias("top")))
    boxes = packed.groupBy("scheme", "container_id").agg(F.sum("piece_tokens").alias("load"), F.min("capacity").alias("a"), F.max("capacity").alias("b"))
    over = boxes.groupBy("scheme").agg(F.sum(F.when((F.col("load") > F.col("a")) | (F.col("a") != F.col("b")), 1).otherwise(0)).alias("containers_broken"))
    docs = packed.join(top, "scheme").groupBy("scheme", "doc_id", "top").agg(
        F.count("*").alias("n"), F.countDistinct("piece_no").alias("numbers"), F.max("piece_no").alias("last"), F.sum("piece_tokens").alias("tokens"), F.sum(F.when(F.col("piece_tokens") == F.col("top"), 1).otherwise(0)).alias("full")
    )
    broken = ((F.col("n") > 1) & (F.col("tokens") <= F.col("top"))) | (F.col("n") != F.col("numbers")) | (F.col("last") != F.col("n") - 1) | (F.col("full") < F.col("n") - 1)
    return docs.groupBy("scheme").agg(F.count("*").alias("n_documents"), F.sum(F.when(broken, 1).otherwise(0)).alias("documents_broken")).join(over, "scheme")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to cut out of each document, merged over all items."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), by_item=False)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_ranked": p2_ranked,
    "p4_found": p4_found,
    "p4_frequencies": p4_frequencies,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p7_removals": p7_removals,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

RANKED = f"""WITH {CONTACT_CELLS} SELECT system, contact, frequency, row_number() OVER (PARTITION BY system ORDER BY frequency DESC, contact)::INT AS pos
FROM cells QUALIFY pos <= {TOP}"""

FREQUENCIES = r"""WITH occ AS (
  SELECT 'interaction_type' AS field_name, lower(regexp_replace(interaction_type, '^\s+|\s+$', '', 'g')) AS term, frame FROM a3_contacts
  UNION ALL SELECT 'atom1', upper(regexp_replace(atom1, '^\s+|\s+$', '', 'g')), frame FROM a3_contacts
  UNION ALL SELECT 'atom2', upper(regexp_replace(atom2, '^\s+|\s+$', '', 'g')), frame FROM a3_contacts),
n AS (SELECT count(DISTINCT frame) AS n FROM a3_contacts),
c AS (SELECT field_name, term, count(*) AS n_rows, count(DISTINCT frame) AS n_units FROM occ WHERE frame IS NOT NULL AND term <> '' GROUP BY 1, 2)
SELECT field_name, term, n_rows, n_units, CASE WHEN n_units < greatest(1, (n + 99) // 100) THEN 'rare' WHEN n_units > 95 * n // 100 THEN 'common' END AS mark FROM c, n"""

ORACLES: dict[str, str] = {
    "p6_invariants": "SELECT scheme, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS documents_broken, 0::BIGINT AS containers_broken FROM (SELECT container_kind AS scheme FROM containers UNION ALL SELECT 'mixed')",
    "p2_ranked": RANKED,
    "p2_found": f"SELECT system, contact, pos FROM ({RANKED})",
    "p4_frequencies": FREQUENCIES,
    "p4_found": f"SELECT field_name, term, mark FROM ({FREQUENCIES}) WHERE mark IS NOT NULL",
}
