"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.shared import stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node that each reaches by them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch, replaced by one edge per node to the smallest it reaches."""
    for b in batches:
        if b.num_rows:
            nodes, roots = local_roots(b.column(0).to_numpy(), b.column(1).to_numpy())
            far = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], ["a", "b"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that some edge joins to a smaller one; component is the smallest node reached.

    Edges with a null end join nothing. Each round points all neighbours at the smallest, from the larger and then the
    smaller side, so that long chains shrink fast; nothing is collected, and rounds are written to the shared folder.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_contract, "a long, b long").distinct()

    e = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where(f"`{a}` is not null and `{b}` is not null and `{a}` != `{b}`" if a in ("a", "b") else "a is not null and b is not null and a != b")
    e, last = stored(tidy(e), "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low2, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(tidy(low2.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(small)), "edges")
