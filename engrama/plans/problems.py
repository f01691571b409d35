"""Queries of the general data problems: hierarchies (p2) and orphan references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import hierarchy as H
from engrama.operators import orphans as O
from engrama.staging import stage
from engrama.tables import table


def _tree(spark: SparkSession, d: str, with_path: bool = True) -> DataFrame:
    return H.hierarchy(H.containment_links(table(spark, d, "edges")), with_path)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Depth and root of every id in a containment edge; -1 on or below a loop."""
    return _tree(spark, d, with_path=False).select("node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, as ids from the root joined by slashes, of every id in a tree."""
    return _tree(spark, d).where("depth >= 0").select("node_id", H.path_text(F.col("path")).alias("path"))


def _linked_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = stage(H.containment_links(table(spark, d, "edges")), "links")
    return links, stage(H.hierarchy(links), "tree")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a node of a tree and one below it, with their distance: as its SQL twin, without loops."""
    links, tree = _linked_tree(spark, d)
    return H.descendant_pairs(links, tree.where("depth >= 0"))


def p2_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of every id in a tree: as its SQL twin, without loops."""
    links, tree = _linked_tree(spark, d)
    return H.descendant_counts(tree.where("depth >= 0"), links)


def p2_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of an id and another one below it, on and below loops too, with their shortest distance."""
    links, tree = _linked_tree(spark, d)
    return H.descendant_pairs(links, tree)


def p2_all_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of every id of a containment edge, on and below loops too."""
    links, tree = _linked_tree(spark, d)
    return H.descendant_counts(tree, links)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(*(table(spark, d, t) for t in ("edges", "nodes", "projects", "deletions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference whose record is deleted, missing or late, with its month."""
    return _orphans(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Bad references counted per table, field, reason and month."""
    return O.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_descendant_counts, p2_all_descendants, p2_all_descendant_counts, p3_found, p3_report)}

_LINKS = """
links AS (
  SELECT DISTINCT
    CASE WHEN lower(trim(relation_type)) = 'contains' THEN source_id ELSE target_id END AS holder,
    CASE WHEN lower(trim(relation_type)) = 'contains' THEN target_id ELSE source_id END AS item
  FROM edges
  WHERE valid_to_commit IS NULL AND lower(trim(relation_type)) IN ('contains', 'contained_by')
    AND source_id IS NOT NULL AND target_id IS NOT NULL
),
tree AS (
  SELECT DISTINCT holder AS node_id, holder AS root_id, 0 AS depth, CAST(holder AS VARCHAR) AS path, [holder] AS ids
  FROM links WHERE holder NOT IN (SELECT item FROM links)
  UNION ALL
  SELECT l.item, t.root_id, t.depth + 1, t.path || '/' || l.item, list_append(t.ids, l.item)
  FROM tree t JOIN links l ON l.holder = t.node_id
)"""

_P3 = """
WITH ref_edges AS (
  SELECT source_id, target_id, min(loaded_at) AS seen FROM edges GROUP BY source_id, target_id
),
first_node AS (SELECT id, min(loaded_at) AS seen FROM nodes GROUP BY id),
refs AS (
  SELECT 'edges' AS ref_table, 'source_id' AS ref_field, source_id || ':' || target_id AS row_key, 'nodes' AS parent, CAST(source_id AS VARCHAR) AS k, seen FROM ref_edges
  UNION ALL
  SELECT 'edges', 'target_id', source_id || ':' || target_id, 'nodes', CAST(target_id AS VARCHAR), seen FROM ref_edges
  UNION ALL
  SELECT DISTINCT 'nodes', 'project_uuid', CAST(n.id AS VARCHAR), 'projects', lower(trim(n.project_uuid)), f.seen
  FROM nodes n JOIN first_node f ON f.id = n.id WHERE trim(n.project_uuid) <> ''
),
recs AS (
  SELECT 'nodes' AS parent, CAST(id AS VARCHAR) AS k, min(loaded_at) AS arrived FROM nodes GROUP BY 2
  UNION ALL
  SELECT 'projects', lower(trim(uuid)), min(created_at) FROM projects GROUP BY 2
),
gone AS (
  SELECT DISTINCT CASE WHEN entity = 'node' THEN 'nodes' ELSE 'projects' END AS parent,
    CASE WHEN entity = 'node' THEN trim(entity_key) ELSE lower(trim(entity_key)) END AS k
  FROM deletions
),
judged AS (
  SELECT r.ref_table, r.ref_field, r.row_key, strftime(r.seen AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN g.k IS NOT NULL THEN 'deleted' WHEN c.k IS NULL THEN 'missing' WHEN c.arrived > r.seen THEN 'late' END AS reason
  FROM refs r LEFT JOIN recs c ON c.parent = r.parent AND c.k = r.k
  LEFT JOIN gone g ON g.parent = r.parent AND g.k = r.k
)
"""

SQL = {
    "p2_found": f"""
WITH RECURSIVE {_LINKS},
up AS (
  SELECT l.item AS node_id, l.holder AS anc, 1 AS n FROM links l
  UNION
  SELECT u.node_id, l.holder, 0 FROM up u JOIN links l ON l.item = u.anc
),
looped AS (
  SELECT DISTINCT node_id FROM up a WHERE node_id = anc
)
SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth FROM tree
UNION ALL
SELECT i.node_id, min(u.anc) AS root_id, CAST(-1 AS INTEGER) AS depth
FROM (SELECT DISTINCT item AS node_id FROM links WHERE item NOT IN (SELECT node_id FROM tree)) i
JOIN up u ON u.node_id = i.node_id
JOIN looped o ON o.node_id = u.anc
GROUP BY i.node_id
""",
    "p2_paths": f"WITH RECURSIVE {_LINKS} SELECT node_id, path FROM tree",
    "p2_descendants": f"""
WITH RECURSIVE {_LINKS}
SELECT a.anc AS ancestor_id, a.node_id, CAST(a.depth + 1 - a.pos AS INTEGER) AS distance
FROM (SELECT node_id, depth, unnest(ids) AS anc, generate_subscripts(ids, 1) AS pos FROM tree) a
WHERE a.pos <= a.depth
""",
    "p2_descendant_counts": f"""
WITH RECURSIVE {_LINKS},
below AS (
  SELECT anc, count(*) AS n FROM
  (SELECT depth, unnest(ids) AS anc, generate_subscripts(ids, 1) AS pos FROM tree) WHERE pos <= depth GROUP BY anc
)
SELECT t.node_id, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants FROM tree t LEFT JOIN below b ON b.anc = t.node_id
""",
    # Loops are walked round until no longer way matters: 200 steps are beyond any depth of the test tables.
    "p2_all_descendants": f"""
WITH RECURSIVE {_LINKS},
up AS (
  SELECT item AS node_id, holder AS anc, 1 AS n FROM links
  UNION
  SELECT u.node_id, l.holder, u.n + 1 FROM up u JOIN links l ON l.item = u.anc WHERE u.n < 200
)
SELECT anc AS ancestor_id, node_id, CAST(min(n) AS INTEGER) AS distance FROM up WHERE anc <> node_id GROUP BY ALL
""",
    "p2_all_descendant_counts": f"""
WITH RECURSIVE {_LINKS},
up AS (
  SELECT item AS node_id, holder AS anc FROM links
  UNION
  SELECT u.node_id, l.holder FROM up u JOIN links l ON l.item = u.anc
)
SELECT i.node_id, CAST(count(u.node_id) AS BIGINT) AS n_descendants
FROM (SELECT item AS node_id FROM links UNION SELECT holder FROM links) i LEFT JOIN up u ON u.anc = i.node_id AND u.node_id <> i.node_id GROUP BY 1
""",
    "p3_found": _P3 + "SELECT DISTINCT ref_table, ref_field, row_key, reason, period FROM judged WHERE reason IS NOT NULL",
    "p3_report": _P3
    + """SELECT ref_table, ref_field, reason, period, CAST(count(*) AS BIGINT) AS n_refs
FROM (SELECT DISTINCT ref_table, ref_field, row_key, reason, period FROM judged WHERE reason IS NOT NULL)
GROUP BY ref_table, ref_field, reason, period""",
}
