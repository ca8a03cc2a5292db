"""Connected components of a graph given as a table of edges, by alternating large and small stars.

A large star joins all larger neighbours of a node to its smallest neighbour, a small star all smaller ones. Both keep
the components and end in one star per component around its smallest node, after a number of rounds that grows with
the logarithm of the graph. Every round is a few joins and aggregates over edges; each is written to the shared
folder, so a lost executor costs no earlier round. The smallest neighbours are written before they are joined: a join
of two plain tables is one whose partitions Spark can split where a node has very many edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpulse.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node and component, the smallest node it is connected with, for all nodes of edges between two nodes.

    NULL ends and loops are no edges.
    """
    one, other = F.col(left).cast("long"), F.col(right).cast("long")
    edges = edges.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).where("u > v").distinct()
    edges = cut_lineage(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut_lineage(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut_lineage(large)
        lowest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def local_roots(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a link matrix reaches inside the matrix."""
    most = np.iinfo(np.int64).max
    at_row, at_column = np.nonzero(links)
    r, c = rows.copy(), columns.copy()
    while True:
        new_r, new_c = np.full_like(r, most), np.full_like(c, most)
        np.minimum.at(new_r, at_row, c[at_column])
        new_r = np.minimum(new_r, r)
        np.minimum.at(new_c, at_column, new_r[at_row])
        new_c = np.minimum(new_c, c)
        if (new_r == r).all() and (new_c == c).all():
            return r, c
        r, c = new_r, new_c
