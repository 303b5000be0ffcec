"""Connected components of an edge table.

Each task first replaces its edges by a forest of the same connectivity. If the forests together are at most
``ONE_TASK_EDGES`` rows, one task finishes them; beyond that size alternating large-star and small-star steps (Kiveris
et al., 2014) do, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, lean, write_table

ONE_TASK_EDGES = 2_000_000


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each can reach) of the edges u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch], roots: bool) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        nodes, label = local_components(table.column(0).to_numpy(), table.column(1).to_numpy())
        keep = np.ones(len(nodes), bool) if roots else nodes != label
        yield pa.record_batch([pa.array(nodes[keep]), pa.array(label[keep])], held[0].schema.names)


def forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) as a forest of the same connectivity: (node, smallest node it reaches there)."""
    return edges.mapInArrow(lean(lambda it: _forest(it, False)), "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, label) of every end of ``edges`` (u, v: long): the smallest id that can be reached, itself included.

    Loops and repeated edges don't matter; rows with a null end are left out. The result is a table in the shared folder.
    """
    now = write_table(forest(edges.where("u != v").select("u", "v")), "edges")
    if now.count() <= one_task_edges:
        out = write_table(now.coalesce(1).mapInArrow(lambda it: _forest(it, True), "u long, v long").toDF("id", "label"), "components")
        drop_table(now)
        return out
    state = None
    while True:
        after = write_table(_small_star(_large_star(now).distinct()).distinct(), "edges")
        drop_table(now)
        now = after
        row = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    out = write_table(now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select("v", "v")).distinct(), "components")
    drop_table(now)
    return out
