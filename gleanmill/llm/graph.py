"""Connected components of a link table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: So many links (some 10 MB) are left to one task.
LAST = 400_000


class Forest:
    """Which nodes are connected so far; a component's root is its smallest node."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def connect(self, x, y) -> bool:
        """False if they were connected already."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) to (node, root)."""
    forest, kind = Forest(), None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.connect(a, b)
    nodes = list(forest.parent)
    for first in range(0, len(nodes), 50_000):
        part = nodes[first : first + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([forest.root(x) for x in part], kind)], names=["node", "root"])


def components(links: DataFrame, about: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; two nodes have the same root if a path of links joins them.

    Each round gives every node the smallest of itself and its neighbours, and joins the links' ends by those labels; the
    labels of all rounds are then followed. With labels in no particular order (hashes), links shrink by a constant
    factor a round. What is left when ``LAST`` links or fewer are is solved by one task. Minima are combined before the
    shuffle, so a node with very many links costs no single task. Links from a node to itself make it a component of its
    own. Nulls are not nodes. ``about``: the number of links, if it is known.
    """
    links = runtime.cut(links.select("a", "b").where("a is not null and b is not null").distinct(), "links", about)
    kind = links.schema["a"].dataType.simpleString()
    steps: list[DataFrame] = []
    while links.count() > LAST:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = runtime.cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
        steps.append(label)
        one, two = (label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        shorter = links.join(one, "a").join(two, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, links = links, runtime.cut(shorter, "links")
        runtime.drop(before)
    labels, found = [*steps, links], links.coalesce(1).mapInArrow(_solve, f"node {kind}, root {kind}")
    while steps:
        after = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = steps.pop().join(after, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    found = runtime.cut(found, "components", about)
    runtime.drop(*labels)
    return found
