"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumera.llm.common import stored

#: Up to so many edges one task settles what is left; more are contracted by joins.
FEW_EDGES = 400_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        a, b = low[low != high], high[low != high]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    return root


def _settle(edges: DataFrame) -> DataFrame:
    """(node, to) of a graph of few edges, by one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            both = pa.concat_arrays([batch.column(k) for k in range(2) for batch in held]).dictionary_encode()
            names, number = both.dictionary, both.indices.to_numpy()
            half = len(number) // 2
            root = roots(number[:half], number[half:], len(names))
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): a label for each node of ``edges`` (a, b), the same for nodes that are connected.

    The label is one of the component's nodes. A round sends every node to the one
    of least hash among its neighbours and itself, the hash being another one each
    round, and draws the edges between where their ends went; what falls on itself or
    on another edge goes. Whatever the graph, a fixed share of the nodes goes in a
    round on average. When few edges are left (``FEW_EDGES``), one task settles them;
    there is no limit to the rounds before. Nodes without edges don't appear.
    """
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while (n := left.count()) > FEW_EDGES:
        rank = lambda c, salt=len(steps): F.struct(F.xxhash64(F.col(c), F.lit(salt)), F.col(c).alias("v"))
        both = left.select(F.col("a").alias("node"), rank("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), rank("a").alias("near")))
        step = both.groupBy("node").agg(F.min("near").alias("near"))
        step = stored(step.select("node", F.least("near", rank("node"))["v"].alias("to")), "step")
        at = lambda k: step.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to"))
        moved = left.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to")
        left = stored(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        steps.append(step)
    labels = _settle(left) if n else left.select(F.col("a").alias("node"), F.col("b").alias("to"))
    for step in reversed(steps):
        far = labels.select(F.col("node").alias("to"), F.col("to").alias("far"))
        ends = step.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        # Nodes that are only reached by others stand for themselves or went on themselves; all are in ``step``.
        labels = ends
    return stored(labels.select("node", F.col("to").alias("label")), "labels")
