"""Queries p1: folder trees of ``dirents`` and ``inodes``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import hierarchy as H
from siltbed.plans.lineage import cut
from siltbed.sources.tables import table


def _nodes(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    dirents = table(spark, sf_dir, "dirents", "image_id", "parent_ino", "child_ino", "xid", *(["name"] if names else []))
    inodes = table(spark, sf_dir, "inodes", "image_id", "ino", "parent_id", "xid")
    return H.nodes_of(dirents, inodes, names)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.separate_cycles(_nodes(spark, sf_dir, names=False))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cut(_nodes(spark, sf_dir))
    return H.build_hierarchy(nodes, H.separate_cycles(nodes))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node that reaches a root."""
    return _tree(spark, sf_dir).select("image_id", "ino", "parent_ino", "root_ino", "depth", "path", "n_descendants")


def p1_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy chain and interval of descendants of every node that reaches a root."""
    return _tree(spark, sf_dir).select("image_id", "ino", "root_ino", "chain_head", "chain_pos", "first", "last")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a node and a node below it."""
    return H.descendants(_tree(spark, sf_dir).select("image_id", "ino", "ancestors"))


_NODES = """
nodes0 AS (
  SELECT image_id, child_ino AS ino, 1 AS linked, coalesce(xid, -1) AS xid, parent_ino AS parent, name FROM dirents
  WHERE image_id IS NOT NULL AND parent_ino IS NOT NULL AND child_ino IS NOT NULL
  UNION ALL
  SELECT image_id, ino, 0, coalesce(xid, -1), parent_id, NULL FROM inodes WHERE image_id IS NOT NULL AND ino IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, ino
    ORDER BY linked DESC, xid DESC, parent DESC NULLS LAST, name DESC NULLS LAST) AS r FROM nodes0
), nodes AS (SELECT image_id, ino, CASE WHEN ino <> 2 THEN parent END AS parent, name FROM ranked WHERE r = 1
), tree AS (
  SELECT n.image_id, n.ino, p.ino AS parent, n.name FROM nodes n
  LEFT JOIN nodes p ON p.image_id = n.image_id AND p.ino = n.parent
)"""

_DOWN = """, reach AS (
  SELECT image_id, ino, ino AS root_ino, 0 AS depth,
    CASE WHEN ino = 2 THEN '' ELSE '?/' || coalesce(name, '#' || ino) END AS p, CAST([] AS BIGINT[]) AS anc
  FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.image_id, t.ino, r.root_ino, r.depth + 1, r.p || '/' || coalesce(t.name, '#' || t.ino), list_append(r.anc, r.ino)
  FROM tree t JOIN reach r ON t.image_id = r.image_id AND t.parent = r.ino
)"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_descendants": p1_descendants, "p1_paths": p1_paths, "p1_chains": p1_chains, "p1_tree_stats": p1_tree_stats}


def p1_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image: nodes that reach a root, roots, greatest depth and pairs of node and descendant."""
    return (
        _tree(spark, sf_dir)
        .groupBy("image_id")
        .agg(
            F.count("*").alias("n_nodes"),
            F.sum(F.when(F.col("depth") == 0, 1).otherwise(0)).alias("n_roots"),
            F.max("depth").alias("max_depth"),
            F.sum("n_descendants").alias("n_pairs"),
        )
    )


def oracle_sql() -> dict:
    return {
        "p1_found": f"""WITH RECURSIVE {_NODES}, alive AS (
              SELECT image_id, ino FROM tree WHERE parent IS NULL
              UNION ALL SELECT t.image_id, t.ino FROM tree t JOIN alive a ON t.image_id = a.image_id AND t.parent = a.ino
            ), cyc AS (SELECT t.* FROM tree t ANTI JOIN alive a ON t.image_id = a.image_id AND t.ino = a.ino
            ), walk AS (
              SELECT image_id, ino, ino AS at FROM cyc
              UNION SELECT w.image_id, w.ino, c.parent FROM walk w JOIN cyc c ON c.image_id = w.image_id AND c.ino = w.at
            ), oncycle AS (
              SELECT DISTINCT w.image_id, w.ino FROM walk w JOIN cyc c ON c.image_id = w.image_id AND c.ino = w.ino
              JOIN walk v ON v.image_id = w.image_id AND v.ino = c.parent AND v.at = w.ino WHERE w.at = w.ino
            ) SELECT w.image_id, w.ino, min(w.at) AS cycle_ino FROM walk w
              JOIN oncycle o ON o.image_id = w.image_id AND o.ino = w.at GROUP BY 1, 2""",
        "p1_descendants": f"""WITH RECURSIVE {_NODES}{_DOWN}
            SELECT image_id, unnest(anc) AS ino, ino AS descendant_ino FROM reach""",
        "p1_paths": f"""WITH RECURSIVE {_NODES}{_DOWN}, pairs AS (SELECT image_id, unnest(anc) AS ino FROM reach),
            below AS (SELECT image_id, ino, count(*) AS n FROM pairs GROUP BY 1, 2)
            SELECT r.image_id, r.ino, t.parent AS parent_ino, r.root_ino, CAST(r.depth AS BIGINT) AS depth, CASE WHEN r.p = '' THEN '/' ELSE r.p END AS path, coalesce(n, 0) AS n_descendants
            FROM reach r JOIN tree t USING (image_id, ino) LEFT JOIN below USING (image_id, ino)""",
        "p1_tree_stats": f"""WITH RECURSIVE {_NODES}{_DOWN}
            SELECT image_id, count(*) AS n_nodes, CAST(sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_roots,
              CAST(max(depth) AS BIGINT) AS max_depth, CAST(sum(depth) AS BIGINT) AS n_pairs FROM reach GROUP BY image_id""",
    }
