"""Connected components of a link table by repeated contraction, wholly distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import pin

#: Rows of a task; the tables here shrink from round to round, and so do their numbers of tasks.
ROWS_PER_TASK = 200_000
#: So many links (16 bytes each) are finished by one task; more are contracted by all.
ONE_TASK = 1_000_000


def _tasks(df: DataFrame) -> int:
    return -(-df.count() // ROWS_PER_TASK)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links in order, and the least node that each one reaches."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        hooked = root.copy()
        np.minimum.at(hooked, root[x], low)
        np.minimum.at(hooked, root[y], low)
        root = hooked[hooked]
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    import pyarrow as pa

    def finish(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, comps = least_reachable(*(np.concatenate(side) for side in zip(*parts, strict=True)))
            for at in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000], pa.int64()) for v in (nodes, comps)], names=["node", "comp"])

    return pin(edges.coalesce(1).mapInArrow(finish, "node long, comp long"))


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, comp)`` for every node of a link; comp is the least node reachable.

    Up to ONE_TASK links are labelled by one task. Beyond, each round hooks every component to its least neighbour, flattens the resulting trees by pointer
    doubling, then contracts the links. Only numbers of rows come to the driver. Self links, repeated
    links and an empty table are allowed; null ends are dropped.
    """
    edges = pin(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if 0 < edges.count() <= ONE_TASK:
        return _in_one_task(edges)
    labels = None
    while tasks := _tasks(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("p"))
        parent = pin(hooked.coalesce(tasks))
        while True:
            once = parent.join(parent.select(F.col("c").alias("p"), F.col("p").alias("p2")), "p")
            twice = once.join(parent.select(F.col("c").alias("p2"), F.col("p").alias("p3")), "p2")
            jumped = pin(twice.select("c", F.col("p3").alias("p"), (F.col("p") != F.col("p3")).alias("moved")).coalesce(tasks))
            parent = jumped.select("c", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("c").alias("node"), F.col("p").alias("comp"))
            width = tasks
        else:
            step = parent.select(F.col("c").alias("comp"), "p")
            labels = pin(labels.join(step, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")).coalesce(width))
        pa, pb = parent.select(F.col("c").alias("a"), F.col("p").alias("pa")), parent.select(F.col("c").alias("b"), F.col("p").alias("pb"))
        contracted = edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = pin(contracted.distinct().coalesce(tasks))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
