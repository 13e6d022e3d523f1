"""Connected components of an edge table, as iterated joins on hashed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Rows of a table that one file of it holds at least, where the table is that large.
FILE_ROWS = 20_000


def _files(rows: int) -> int:
    return rows // FILE_ROWS + 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round every root takes the smallest root among its neighbours, pointers are doubled, and edges move to the
    roots of their ends; edges inside a component vanish. The table of edges shrinks every round and no group is gathered:
    minima are combined before the shuffle. Tables are written in as many files as their rows need, and pointers jump twice a write.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    n = edges.count()
    both = edges.select("a").union(edges.select("b")).distinct()
    nodes = stored(both.select(F.col("a").alias("node"), F.col("a").alias("root")).coalesce(_files(2 * n)), "cc-nodes")
    all_files = _files(nodes.count())
    while n:
        files = _files(n)
        # each larger end hooks to its smallest smaller neighbour, then pointers jump to the top of their chain
        hooks = edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        hooks = stored(hooks.coalesce(files), "cc-hooks")
        jumps = True
        while jumps:
            one, two = (hooks.select(F.col("from").alias(f"f{k}"), F.col("to").alias(f"t{k}")) for k in (1, 2))
            step = hooks.join(one, F.col("to") == F.col("f1"), "left").join(two, F.col("t1") == F.col("f2"), "left")
            step = step.select("from", F.coalesce("t2", "t1", "to").alias("to"), F.col("t2").isNotNull().alias("moved"))
            step = stored(step.coalesce(files), "cc-hooks")
            jumps = not step.where("moved").isEmpty()
            hooks = step.drop("moved")
        up = hooks.select(F.col("from").alias("f"), F.col("to").alias("t"))
        nodes = stored(nodes.join(up, F.col("root") == F.col("f"), "left").select("node", F.coalesce("t", "root").alias("root")).coalesce(all_files), "cc-nodes")
        a = edges.join(up, F.col("a") == F.col("f"), "left").select(F.coalesce("t", "a").alias("a"), "b")
        b = a.join(up, F.col("b") == F.col("f"), "left").select("a", F.coalesce("t", "b").alias("b"))
        rest = b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = stored(rest.coalesce(files), "cc-edges")
        n = edges.count()
    return nodes
