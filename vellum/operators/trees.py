"""Trees of nodes: qualified names, inherited attributes, first pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.scalars import qualified_name


def descend(nodes: DataFrame, inherited: list[str], depth: int = 50) -> DataFrame:
    """All nodes below the roots (parent null) with their dotted name and the inherited columns, which a
    node's own values override. Level by level: a join a level, as many as the tree is deep, ``depth`` at most;
    a node that is its own ancestor is never reached."""
    n = nodes.select("id", "parent", "name", *inherited)
    level = n.where("parent IS NULL").withColumns({"path": F.col("name"), "depth": F.lit(0)})
    out = level
    for d in range(1, depth + 1):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in inherited))
        level = n.join(up, "parent").select("id", "parent", "name", *(F.coalesce(c, f"_{c}").alias(c) for c in inherited), qualified_name(F.col("_path"), F.col("name")).alias("path"), F.lit(d).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def first_page(widgets: DataFrame) -> DataFrame:
    """(object, page): the first page that lists a widget."""
    return widgets.groupBy("object").agg(F.min("page").alias("page"))
