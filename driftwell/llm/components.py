"""Connected components of a link table, by smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _rooted(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) for every end of ``edges``: where steps to the smallest neighbour, each smaller than the last, end.

    Paths shorten by halves; only rows of nodes are joined.
    """
    both = edges.select(F.col("a").alias("id"), "b").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("b")))
    near = written(both.groupBy("id").agg(F.least(F.min("b"), F.col("id")).alias("root")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        jump = near.select(F.col("id").alias("root"), F.col("root").alias("far"))
        moved = written(near.join(jump, "root").select("id", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("moved")), f"{name}-{turn}")
        near = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return near


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """(id, component) for every end of ``links`` (a, b).

    Each round takes every node to a root and puts roots in the links' places; links
    inside a root go and equal ones become one, so later rounds have few.  The rounds'
    roots are then followed from the last to the first.  A component's smallest id is
    a root of every round, so it is what remains.  Sums and minima combine before each
    exchange, so a node with very many links is one row for each task.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), f"{name}-links")
    rounds = []
    while not rounds or not edges.isEmpty():
        roots = _rooted(edges, f"{name}{len(rounds)}")
        rounds.append(roots)
        placed = edges.join(roots.select(F.col("id").alias("a"), F.col("root").alias("of_a")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("of_b")), "b")
        placed = placed.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        edges = written(placed.select(low.alias("a"), high.alias("b")).distinct(), f"{name}-links{len(rounds)}")
    out = rounds.pop()
    while rounds:
        further = out.select(F.col("id").alias("root"), F.col("root").alias("far"))
        out = written(rounds.pop().join(further, "root", "left").select("id", F.coalesce("far", "root").alias("root")), f"{name}-of{len(rounds)}")
    return out.withColumnRenamed("root", "component")
