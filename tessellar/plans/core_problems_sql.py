"""SQL of p1, p3 and p5."""

from __future__ import annotations

import os

PANEL_FILE = os.environ.get("TESSELLAR_PANEL", "/root/testdata/sf0.01/panel_systems.parquet")

CONTACT_CELLS = r"""
raw AS (SELECT upper(regexp_replace(coalesce(contact, ''), '\s', '', 'g')) AS c, upper(regexp_replace(res1, '\s', '', 'g')) AS a,
               upper(regexp_replace(res2, '\s', '', 'g')) AS b, upper(regexp_replace(system, '\s', '', 'g')) AS s, frequency, loaded_at, row_id
        FROM all_contacts),
sides AS (SELECT CASE WHEN c = '' THEN a ELSE regexp_extract(c, '^([^:]+:[^:]+:-?\d+)-([^:]+:[^:]+:-?\d+)$', 1) END AS x,
                 CASE WHEN c = '' THEN b ELSE regexp_extract(c, '^([^:]+:[^:]+:-?\d+)-([^:]+:[^:]+:-?\d+)$', 2) END AS y,
                 nullif(regexp_extract(s, '([A-Z]+[0-9]+_R[0-9]+)', 1), '') AS system, frequency, loaded_at, row_id FROM raw),
spelt AS (SELECT CASE WHEN x < y THEN x || '-' || y ELSE y || '-' || x END AS contact, system, loaded_at, row_id,
                 CASE WHEN NOT isnan(frequency) AND frequency BETWEEN 0 AND 1 THEN frequency END AS frequency
          FROM sides WHERE x <> '' AND y <> ''),
cells AS (SELECT contact, system, frequency, row_id FROM spelt WHERE frequency IS NOT NULL AND system IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY contact, system ORDER BY loaded_at DESC NULLS LAST, row_id) = 1)
"""

P3_FIELD = r'(?:[ \r\f]*"(?:[^"]|"")*"[ \r\f]*|[^"\t]*)'
P3_LINES = rf"""
r AS (SELECT line_id, line FROM a3_contacts_raw WHERE NOT regexp_matches(line, '^\s*(#|$)')),
q AS (SELECT line_id, line, regexp_full_match(line, '{P3_FIELD}(?:\t{P3_FIELD})*', 's') AS quoted_well FROM r),
f AS (SELECT line_id, quoted_well, [regexp_replace(regexp_replace(trim(x, E' \t\r\n\f'), '^"(.*)"$', '\1', 's'), '""', '"', 'g') FOR x IN
        CASE WHEN quoted_well THEN regexp_extract_all(line || E'\t', '{P3_FIELD}\t', 0, 's') ELSE [] END] AS v FROM q),
t AS (SELECT line_id, quoted_well, len(v) AS n, trim(v[1], E' \t\r\n\f') AS f1, lower(trim(v[2], E' \t\r\n\f')) AS f2, trim(v[3], E' \t\r\n\f') AS f3, trim(v[4], E' \t\r\n\f') AS f4 FROM f),
d AS (SELECT line_id, f1, f2, f3, f4, CASE
        WHEN NOT quoted_well THEN 'quoting' WHEN n <> 4 THEN 'column_count'
        WHEN NOT regexp_full_match(f1, '[0-9]+') OR length(ltrim(f1, '0')) > 10 OR try_cast(f1 AS HUGEINT) > 2147483647 THEN 'frame'
        WHEN f2 NOT IN (SELECT lower(itype) FROM interaction_types WHERE itype IS NOT NULL) THEN 'interaction_type'
        WHEN NOT regexp_full_match(f3, '[^:\s]+:[^:\s]+:-?[0-9]+:[^:\s]+') THEN 'atom1'
        WHEN NOT regexp_full_match(f4, '[^:\s]+:[^:\s]+:-?[0-9]+:[^:\s]+') THEN 'atom2' END AS reason FROM t)
"""

P5_NODES = """
docs AS (SELECT record_id, payload::JSON AS j FROM naming_cache WHERE json_valid(payload)),
res AS (SELECT d.record_id, t.fullkey, t.path, t.value AS o FROM docs d, json_tree(d.j) t
        WHERE t.type = 'OBJECT' AND (json_exists(t.value, '$.sequence_number') OR json_exists(t.value, '$.amino_acid')))
"""


# Every node with the ordinals of its members as label; an object's fields are those of its members that are neither.
P5_TREE = """
t AS (WITH RECURSIVE r AS (
   SELECT record_id, '' AS dewey, '' AS parent_dewey, '$' AS schema_path, payload::JSON AS v FROM naming_cache WHERE json_valid(payload)
   UNION ALL
   SELECT record_id, CASE WHEN dewey = '' THEN '' ELSE dewey || '.' END || i, dewey, schema_path || CASE WHEN keys IS NULL THEN '[]' ELSE '.' || keys[i + 1] END,
          CASE WHEN keys IS NULL THEN json_extract(v, '$[' || i || ']') ELSE json_extract(v, '$."' || keys[i + 1] || '"') END
   FROM (SELECT *, unnest(range(CASE WHEN keys IS NULL THEN json_array_length(v)::BIGINT ELSE len(keys) END)) AS i
         FROM (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) END AS keys FROM r WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
 ) SELECT * FROM r WHERE json_type(v) = 'OBJECT')
"""


def _panel() -> list[tuple[int, str]]:
    """The fixed panel, which names the wide table's columns."""
    try:
        import pyarrow.parquet as pq

        rows = pq.read_table(PANEL_FILE).to_pylist()
    except OSError:
        return []
    return sorted((r["col_no"], r["system"]) for r in rows)


def panel_names() -> list[str]:
    return [s for _, s in _panel()]


def _wide_sql() -> str:
    columns = ", ".join(f"max(CASE WHEN c.system = '{s}' THEN c.frequency END) AS \"{s}\"" for _, s in _panel())
    return f"WITH {CONTACT_CELLS} SELECT e.contact, {columns} FROM (SELECT DISTINCT contact FROM spelt) e LEFT JOIN cells c ON c.contact = e.contact GROUP BY e.contact"


ORACLES = {
    "p1_found": f"WITH {CONTACT_CELLS} SELECT contact, system, row_id FROM cells WHERE system IN (SELECT system FROM panel_systems)",
    "p1_wide": _wide_sql(),
    "p3_found": f"WITH {P3_LINES} SELECT line_id, reason FROM d WHERE reason IS NOT NULL",
    "p3_rows": f"WITH {P3_LINES} SELECT line_id, f1::INT AS frame, f2 AS interaction_type, f3 AS atom1, f4 AS atom2 FROM d WHERE reason IS NULL",
    "p5_residues": f"""WITH {P5_TREE}, o AS (SELECT *, json_type(v, '$.sequence_number') AS a, json_type(v, '$.amino_acid') AS b, trim(v->>'$.sequence_number') AS n FROM t)
        SELECT record_id, CASE WHEN a NOT IN ('OBJECT', 'ARRAY') AND regexp_full_match(n, '[+-]?[0-9]+([.]0+)?') THEN try_cast(try_cast(n AS DOUBLE) AS INT) END AS sequence_number,
               CASE WHEN b NOT IN ('OBJECT', 'ARRAY') THEN nullif(v->>'$.amino_acid', '') END AS amino_acid, dewey, parent_dewey, schema_path
        FROM o WHERE coalesce(a NOT IN ('OBJECT', 'ARRAY'), false) OR coalesce(b NOT IN ('OBJECT', 'ARRAY'), false)""",
    "p5_found": f"""WITH {P5_NODES},
        seq AS (SELECT record_id, try_cast(o->>'$.sequence_number' AS INT) AS sequence_number, o->'$.alternative_generic_numbers' AS a FROM res),
        alts AS (SELECT record_id, sequence_number, generate_subscripts(a->'$[*]', 1) - 1 AS alt_pos, unnest(a->'$[*]') AS x FROM seq WHERE json_type(a) = 'ARRAY'
                 UNION ALL SELECT record_id, sequence_number, 0, a FROM seq WHERE json_type(a) = 'OBJECT')
        SELECT DISTINCT record_id, sequence_number, alt_pos::INT AS alt_pos, x->>'$.scheme' AS scheme, x->>'$.label' AS label FROM alts
        WHERE sequence_number IS NOT NULL AND x->>'$.scheme' <> '' AND x->>'$.label' <> ''""",
}
