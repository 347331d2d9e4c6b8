"""Queries of the general data problems (p1, p4, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators import compact, drift, hierarchy, nested
from tessela.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.build_hierarchy(table(spark, d, "superpixels"), with_path=False)
    return tree.where("parent_id IS NOT NULL").select("image", "method", "id", "root_id", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build_hierarchy(table(spark, d, "superpixels"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.build_hierarchy(table(spark, d, "superpixels")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_links(table(spark, d, "finished_runs"), table(spark, d, "state_docs"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.run_methods(table(spark, d, "finished_runs")).distinct()
    return rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_methods"), F.sum(F.col("n_ok").cast("bigint")).alias("n_ok"))


def p4_scribbles(spark: SparkSession, d: str) -> DataFrame:
    return nested.scribble_table(table(spark, d, "state_docs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "annotation_lines"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "annotation_lines"))


def p5_edits(spark: SparkSession, d: str) -> DataFrame:
    return drift.edits(table(spark, d, "annotation_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["run_dir", "checkpoint_index", "scribble_id"]
    rows = compact.state_records(table(spark, d, "state_files"))
    path, _ = compact.consolidate(rows, keys)
    return spark.read.schema(rows.schema).parquet(path).select(*keys).distinct()


def p6_manifest(spark: SparkSession, d: str) -> DataFrame:
    keys = ["run_dir", "checkpoint_index", "scribble_id"]
    return compact.consolidate(compact.state_records(table(spark, d, "state_files")), keys)[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p4_found, p4_runs, p4_scribbles, p5_found, p5_unified, p5_edits, p6_found, p6_manifest)}

_NEWEST = """newest AS (SELECT image, method, id, max(CASE WHEN parents IS NULL OR len(parents) = 0 THEN {'t': ingested_at, 'p': NULL} ELSE {'t': ingested_at, 'p': parents[-1]} END).p AS parent
 FROM superpixels WHERE id IS NOT NULL GROUP BY ALL),
tree(image, method, id, parent, root_id, depth, path) AS (SELECT image, method, id, parent, id, 0, [id] FROM newest n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM newest p WHERE p.image = n.image AND p.method = n.method AND p.id = n.parent)
 UNION ALL SELECT n.image, n.method, n.id, n.parent, t.root_id, t.depth + 1, list_append(t.path, n.id) FROM tree t JOIN newest n ON n.image = t.image AND n.method = t.method AND n.parent = t.id)"""
_OPEN = """opened AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) WHEN json_extract(j, '$.state') IS NOT NULL THEN json_extract(j, '$.state') ELSE j END AS s
 FROM (SELECT record_id, CAST(doc_json AS JSON) AS j FROM (SELECT record_id, doc_json FROM state_docs WHERE json_valid(doc_json)))),
states AS (SELECT DISTINCT record_id, s FROM opened WHERE json_type(s) = 'OBJECT'),
sc AS (SELECT record_id, unnest(json_extract(s, '$.scribbles[*]')) AS e FROM states),
pt AS (SELECT record_id, json_extract_string(e, '$.id') AS id, json_extract(e, '$.points') AS p FROM sc WHERE json_type(e) = 'OBJECT'),
spm AS (SELECT record_id, json_extract(s, '$.superpixels') AS m FROM states), anm AS (SELECT record_id, json_extract(s, '$.annotations') AS m FROM states),
keyed AS (SELECT record_id, 'sp' AS t, k, CAST(json_extract(m, '$."' || k || '"') AS JSON[]) AS l FROM (SELECT record_id, m, unnest(json_keys(m)) AS k FROM spm WHERE json_type(m) = 'OBJECT')
 UNION ALL SELECT record_id, 'an', k, CAST(json_extract(m, '$."' || k || '"') AS JSON[]) FROM (SELECT record_id, m, unnest(json_keys(m)) AS k FROM anm WHERE json_type(m) = 'OBJECT')),
items AS (SELECT record_id, t, k, unnest(l) AS e FROM keyed UNION ALL SELECT record_id, 'sp', json_extract_string(e, '$.method'), e FROM (SELECT record_id, unnest(json_extract(m, '$[*]')) AS e FROM spm WHERE json_type(m) = 'ARRAY')
 UNION ALL SELECT record_id, 'an', json_extract_string(e, '$.method'), e FROM (SELECT record_id, unnest(json_extract(m, '$[*]')) AS e FROM anm WHERE json_type(m) = 'ARRAY')),
rings AS (SELECT record_id, k || '#' || json_extract_string(e, '$.id') AS parent, json_extract(e, '$.holes[*]') AS h FROM items WHERE t = 'sp'),
ps AS (SELECT record_id, k || '#' || json_extract_string(e, '$.id') AS parent, json_extract(e, '$.parent_scribble') AS v FROM items WHERE t = 'an')"""


def points_sql(e: str) -> str:
    """The number of points of a list in any of its notations, as SQL."""
    return f"""(CASE json_type({e}) WHEN 'ARRAY' THEN CASE WHEN json_type(json_extract({e}, '$[0]')) IN ('ARRAY', 'OBJECT') THEN CAST(json_array_length({e}) AS BIGINT) ELSE CAST(json_array_length({e}) AS BIGINT) // 2 END
 WHEN 'OBJECT' THEN CAST(json_array_length({e}, '$.x') AS BIGINT) WHEN 'VARCHAR' THEN len(regexp_extract_all(json_extract_string({e}, '$'), '-?[0-9.]+')) // 2 ELSE 0 END)"""


_RE_STR = '"(?:[^"\\\\\\r\\n]|\\\\.)*"'
_RE_FLAT = '\\{(?:[^{}"]|' + _RE_STR + ')*\\}'
_RE_RECORD = '\\{(?:[^{}"]|' + _RE_STR + '|' + _RE_FLAT + ')*\\}'
ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_NEWEST} SELECT n.image, n.method, n.id, CAST(coalesce(t.root_id, -1) AS INTEGER) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
 FROM newest n LEFT JOIN tree t ON t.image = n.image AND t.method = n.method AND t.id = n.id WHERE n.parent IS NOT NULL""",
    "p1_paths": f"""WITH RECURSIVE {_NEWEST} SELECT n.image, n.method, n.id, n.parent AS parent_id, CAST(coalesce(t.root_id, -1) AS INTEGER) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, t.path, t.id IS NULL AS in_cycle
 FROM newest n LEFT JOIN tree t ON t.image = n.image AND t.method = n.method AND t.id = n.id""",
    "p1_descendants": f"""WITH RECURSIVE {_NEWEST}, a AS (SELECT image, method, id, depth, unnest(path) AS ancestor_id, unnest(range(len(path))) AS i FROM tree)
 SELECT image, method, ancestor_id, id AS descendant_id, CAST(depth - i AS INTEGER) AS distance FROM a WHERE i < depth""",
    "p4_found": f"""WITH {_OPEN} SELECT DISTINCT record_id, 'run_method' AS link_kind, run_name AS parent_id, m.method AS child_id FROM (SELECT record_id, run_name, unnest(methods) AS m FROM finished_runs) WHERE trim(m.method) <> '' AND run_name IS NOT NULL
UNION SELECT record_id, 'scribble_point', id, CAST(unnest(range(CASE WHEN json_type(json_extract(p, '$[0]')) IN ('ARRAY', 'OBJECT') THEN CAST(json_array_length(p) AS BIGINT) ELSE CAST(json_array_length(p) AS BIGINT) // 2 END)) AS VARCHAR) FROM pt WHERE json_type(p) = 'ARRAY'
UNION SELECT record_id, 'sp_hole', parent, CAST(i AS VARCHAR) FROM (SELECT record_id, parent, unnest(h) AS r, unnest(range(len(h))) AS i FROM rings) WHERE json_type(r) = 'ARRAY' AND json_array_length(r) >= 3
UNION SELECT record_id, 'anno_scribble', parent, json_extract_string(c, '$') FROM (SELECT record_id, parent, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END) AS c FROM ps) WHERE json_type(c) <> 'NULL'""",
    "p4_runs": """SELECT run_name, count(*) AS n_methods, CAST(sum(m.n_ok) AS BIGINT) AS n_ok FROM (SELECT DISTINCT record_id, run_name, unnest(range(len(methods))) AS i, unnest(methods) AS m FROM finished_runs) WHERE trim(m.method) <> '' GROUP BY run_name""",
    "p4_scribbles": f"""WITH {_OPEN}, ps2 AS (SELECT record_id, unnest(json_extract(s, '$.scribbles[*]')) AS e, unnest(range(CAST(json_array_length(s, '$.scribbles') AS BIGINT))) AS i FROM states WHERE json_type(s, '$.scribbles') = 'ARRAY'),
ob AS (SELECT record_id, e, row_number() OVER (PARTITION BY record_id ORDER BY i) - 1 AS position FROM ps2 WHERE json_type(e) = 'OBJECT')
SELECT DISTINCT record_id, CAST(position AS INTEGER) AS position, json_extract_string(e, '$.id') AS scribble_id, TRY_CAST(json_extract_string(e, '$.params.code') AS INTEGER) AS code, TRY_CAST(json_extract_string(e, '$.params.radius') AS DOUBLE) AS radius,
 CAST(coalesce({points_sql("json_extract(e, '$.points')")}, 0) AS INTEGER) AS n_points FROM ob""",
    # Whole texts and whole lines are parsed as JSON; only what is cut off in a list is searched with a pattern.
    "p6_found": f"""WITH f AS (SELECT regexp_replace(path, '/+', '/', 'g') AS p, checkpoint_index AS ci, regexp_replace(regexp_replace(content, '^[^\\[{{]*', ''), '\\s+$', '') AS c FROM state_files WHERE content IS NOT NULL),
k AS (SELECT *, json_valid(c) AS whole, starts_with(c, '[') OR regexp_matches(c, '^\\{{\\s*"scribbles"') AS listed FROM f), ln AS (SELECT p, ci, trim(unnest(regexp_split_to_array(c, '[\\r\\n]+'))) AS c FROM k WHERE NOT whole AND NOT listed),
j AS (SELECT p, ci, CAST(c AS JSON) AS r FROM k WHERE whole UNION ALL SELECT p, ci, CAST(c AS JSON) FROM ln WHERE json_valid(c)
 UNION ALL SELECT p, ci, CAST(r AS JSON) FROM (SELECT p, ci, unnest(regexp_extract_all(c, '{_RE_RECORD}')) AS r FROM k WHERE NOT whole AND listed) WHERE json_valid(r)),
e AS (SELECT p, ci, unnest(CASE WHEN json_type(r) = 'ARRAY' THEN json_extract(r, '$[*]') WHEN json_type(json_extract(r, '$.scribbles')) = 'ARRAY' THEN json_extract(r, '$.scribbles[*]') ELSE [r] END) AS r FROM j)
SELECT DISTINCT regexp_extract(p, 'interactive_runs/(.*)/[^/]*$', 1) AS run_dir, CAST(coalesce(ci, TRY_CAST(regexp_extract(p, '/[^/.]*?([0-9]+)(?:\\.[^/]*)?$', 1) AS INTEGER), -1) AS INTEGER) AS checkpoint_index, CAST(json_extract_string(r, '$.id') AS INTEGER) AS scribble_id
FROM e WHERE json_type(r) = 'OBJECT' AND json_extract_string(r, '$.id') IS NOT NULL""",
}
