"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import forget, written

#: Edges, of 16 bytes each, that one task takes.
ONE_TASK = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of n numbers is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root[a] == root[b]).all():
            return root


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if parts:
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least_labels(code[: len(a)], code[len(a) :], len(nodes))])], ["node", "label"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, label`` for the nodes of ``a, b`` edges (longs): the least node of each component.

    Up to ``one_task`` edges, which are counted first, are one task's work. Of more, each round takes the
    least label among neighbours, then the label's own label, so the rounds grow with the logarithm of a
    component's width. Every round is written to the shared folder, and the one before deleted. Minima are
    taken before rows are shuffled, so a node of any degree is one row a task."""
    held = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    if held.count() <= one_task:
        labels = written(held.coalesce(1).mapInArrow(_small, "node long, label long"), "labels")
        forget(held)
        return labels
    both = written(held.union(held.select("b", "a")).distinct(), "edges")
    forget(held)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        after = written(lower.join(up, lower["label"] == up["at"]).select("node", F.least("label", "up").alias("label"), "was"), "labels")
        forget(labels)
        labels = after
        if labels.where("label != was").isEmpty():
            forget(both)
            return labels.select("node", "label")
