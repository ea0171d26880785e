"""Trees by parent reference: paths, ancestors, subtrees, cycles; and manifests against a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut


def prefixes(path: Column) -> Column:
    """Every ancestor of a path, itself included, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tree_of_paths(paths: DataFrame, col: str) -> DataFrame:
    """id (the path), parent_id and name of every directory on the given paths."""
    nodes = paths.where(F.col(col).isNotNull()).select(F.explode(prefixes(F.col(col))).alias("id")).distinct()
    return nodes.select("id", F.nullif(F.regexp_extract("id", r"^(.*)/[^/]*$", 1), F.lit("")).alias("parent_id"), F.regexp_extract("id", r"([^/]*)$", 1).alias("name"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance) of each node and its ancestors, itself at 0; a cycle ends where it would repeat, a missing parent ends the walk.

    Known ways are joined with themselves, so their length doubles each round: a chain of any
    depth takes as many rounds as its depth has bits.
    """
    there = nodes.select(F.col("id").alias("ancestor_id")).distinct()
    known = cut(nodes.select("id", F.col("parent_id").alias("ancestor_id"), F.lit(1).cast("bigint").alias("distance")).where("id != ancestor_id").join(there, "ancestor_id", "left_semi"))
    size = -1
    while size != (size := known.count()):
        on = known.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("far"), F.col("distance").alias("more"))
        longer = known.join(on, "ancestor_id").where("id != far").select("id", F.col("far").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        known = cut(known.unionByName(longer).groupBy("id", "ancestor_id").agg(F.min("distance").alias("distance")))
    return known.select("id", "ancestor_id", "distance").unionByName(nodes.select("id", F.col("id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("distance")))


def full_paths(nodes: DataFrame) -> DataFrame:
    """id, path (names from the root joined by ``/``) and depth of each node."""
    up = ancestors(nodes).join(nodes.select(F.col("id").alias("ancestor_id"), "name"), "ancestor_id")
    chain = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    return up.groupBy("id").agg(F.array_join(F.transform(chain, lambda x: x["name"]), "/").alias("path"), F.max("distance").alias("depth"))


def in_cycle(nodes: DataFrame) -> DataFrame:
    """Nodes that are an ancestor of themselves."""
    up = ancestors(nodes)
    parents = nodes.select(F.col("id").alias("x"), F.col("parent_id").alias("p"))
    return up.join(parents, (up["ancestor_id"] == parents["x"]) & (up["id"] == parents["p"])).select("id").distinct()


def sync_diff(manifest: DataFrame, indexed: DataFrame) -> DataFrame:
    """key, state (``added``, ``modified``, ``unmodified``, ``deleted``) of two tables of key and checksum; a NULL checksum counts as modified."""
    m, i = manifest.select("key", F.col("checksum").alias("new")), indexed.select(F.col("key").alias("k"), F.col("checksum").alias("old"))
    both = m.join(i, m["key"] == i["k"], "full_outer")
    same = F.col("new").eqNullSafe(F.col("old")) & F.col("old").isNotNull()
    state = F.when(F.col("k").isNull(), "added").when(F.col("key").isNull(), "deleted").when(same, "unmodified").otherwise("modified")
    return both.select(F.coalesce("key", "k").alias("key"), state.alias("state"))


def named_once(directories: DataFrame) -> DataFrame:
    """Directories of which a parent holds only one of each name: the first by ``created_at`` and id; roots (NULL parent) never collide."""
    by = W.partitionBy("knowledge_id", "parent_id", "name").orderBy("created_at", "id")
    return directories.withColumn("_n", F.row_number().over(by)).where("parent_id IS NULL OR _n = 1").drop("_n")


def moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes under new parents (moves: id, target; a NULL target is the root); a move below itself or to a parent that isn't there is refused.

    Every move is judged by the tree before any of them.
    """
    up = ancestors(nodes).select(F.col("id").alias("target"), F.col("ancestor_id").alias("id"), F.lit(True).alias("_below"))
    there = nodes.select(F.col("id").alias("target"), F.lit(True).alias("_there"))
    judged = moves.join(up, ["id", "target"], "left").join(there, "target", "left")
    fine = judged.where("_below IS NULL AND (target IS NULL OR _there)").select("id", "target", F.lit(True).alias("_moved"))
    return nodes.join(fine, "id", "left").withColumn("parent_id", F.when(F.col("_moved"), F.col("target")).otherwise(F.col("parent_id"))).drop("target", "_moved")
