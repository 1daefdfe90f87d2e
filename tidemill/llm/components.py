"""Connected components of link tables that no machine holds whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import drop_table, spill_table

#: Nodes that a task's forest holds; then it starts afresh, which only lets more links through.
FOREST_NODES = 200_000


class Forest:
    """Union-find within a task: lets a link through only if it joins two trees."""

    def __init__(self, most: int = FOREST_NODES):
        self.parent: dict[int, int] = {}
        self.most = most

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int]]:
        if len(self.parent) > self.most:
            self.parent.clear()
        out = []
        for u, v in zip(src.tolist(), dst.tolist()):
            a, b = self.find(u), self.find(v)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((u, v))
        return out


class Residents:
    """Rows that others are compared with; knows which of them are joined already, so that dense groups stay cheap."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes
        self.label = np.arange(len(nodes))

    def links(self, nodes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that leave the same components as all of ``near`` (rows: ``nodes``, columns: residents)."""
        some = np.flatnonzero(near.any(axis=1))
        first = near[some].argmax(axis=1)
        src, dst = [nodes[some]], [self.nodes[first]]
        other = (near[some] & (self.label[None, :] != self.label[first][:, None])).any(axis=1)
        for i in some[other].tolist():
            labels, at = np.unique(self.label[near[i]], return_index=True)
            if len(labels) > 1:
                src.append(np.full(len(at), nodes[i]))
                dst.append(self.nodes[np.flatnonzero(near[i])[at]])
                self.label[np.isin(self.label, labels)] = labels[0]
        return np.concatenate(src), np.concatenate(dst)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (src, dst long): root is the smallest node that links reach.

    Rounds of star contraction: each node's greater neighbours are linked to its least one, then its lesser neighbours.
    A node's neighbours are never gathered: the least one comes from an aggregation that combines before the shuffle, and
    is joined back. The links of each round are written to the shared folder. Ends when a round changes nothing. No
    links give no rows; null ends are dropped.
    """
    edges = links.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = spill_table(edges.distinct(), "links")
    signature = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges, old = spill_table(small.distinct(), "links"), edges
        drop_table(old)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
        if now == signature or now[0] == 0:
            break
        signature = now
    # after the last round each node but the root itself has one link, to the root
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
