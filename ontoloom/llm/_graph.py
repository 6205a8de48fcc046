"""Connected components of a link table, all in joins: links never meet in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def spanning_forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes of range(n) as the links a-b do, one a node at most."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links(a, b); lone nodes are absent."""
    return graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).toDF("node", "root")
