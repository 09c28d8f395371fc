"""Connected components of an edge table, by alternating large and small stars.

Kiveris and others, "Connected components in MapReduce and beyond" (2014). Every round is
written to the shared folder, so lineage stays short and a lost executor repeats a round at
most. Edges first shrink to a spanning forest within each partition, a bounded part at a
time. No node's neighbours are ever gathered: a star is a minimum per node and a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the given edges connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def components(edges: DataFrame, a: str = "a", b: str = "b", part_rows: int = 200_000, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node. Nodes are bigints."""

    def shrink(batches):
        import pyarrow as pa

        held: list = []

        def out():
            x, y = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            return x, y

        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= part_rows:
                x, y = out()
                if len(x) * 2 > rows:  # too little gained to keep on
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                    rows = 0
                else:
                    held.append((x, y))
                    rows = len(x)
        if held:
            x, y = out()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])

    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = settle(pairs.mapInArrow(shrink, "u long, v long").distinct(), "edges")
    # Edges are (larger, smaller) from here on. They are stars when no smaller end is itself a larger one and none has two.
    for k in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = settle(small, "small")
        # After a small star every larger end has one smaller end iff nothing is left to merge.
        busy = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        discard(now, large)  # each round needs only the one before
        now = small
        if not busy:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
