"""Connected components by union-find inside partitions and pointer jumping between them.

The state is a table of edges (u, v), u > v. A round replaces the lower end of each edge by the least node that one
hangs from (a join), and then each task joins the edges it holds by union-find, once as they come and once more after
they were dealt by u. What comes out of a task is a star for each of its pieces, so a node with many lower neighbours
leaves one row a task before anything is shuffled by u, and a node that many hang from is only ever joined to. The end is
reached when a round adds no edge: then every node hangs from its component's smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import discard, written

CHUNK = 1_000_000  # edges that a task holds at a time


def stars(u: np.ndarray, v: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every node of these edges but the smallest of its piece, with that smallest; moved: whether this is no old edge."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
    child = np.flatnonzero(top != np.arange(len(nodes)))
    old = a[~moved] * len(nodes) + b[~moved]
    return nodes[child], nodes[top[child]], ~np.isin(child * len(nodes) + top[child], old)


def contracted(edges: DataFrame) -> DataFrame:
    """The stars of each task's edges, ``CHUNK`` at a time; rows in order of u stay together across chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> tuple[np.ndarray, ...]:
            return stars(*(np.concatenate(c) for c in zip(*held)))

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "moved")))
                size += batch.num_rows
            if size >= CHUNK:
                last = held[-1][0][-1]
                out = joined()
                yield pa.record_batch([pa.array(c) for c in out], names=["u", "v", "moved"])
                k = np.flatnonzero(out[0] == last)
                held, size = [tuple(c[k] for c in out)], len(k)
        if size:
            yield pa.record_batch([pa.array(c) for c in joined()], names=["u", "v", "moved"])

    return edges.mapInArrow(run, "u long, v long, moved boolean")


def dealt(edges: DataFrame) -> DataFrame:
    """Edges joined in the tasks they are in, dealt by u, and joined again."""
    return contracted(contracted(edges).repartition("u").sortWithinPartitions("u"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), longs -> node, root for every node with an edge; the root is the component's smallest node.

    Each round is written to the shared folder, so that neither lineage nor lost executors make earlier ones run again.
    """
    now = written(dealt(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(True).alias("moved"))), "edges")
    while True:
        above = now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        jumped = now.join(above, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        was, now = now, written(dealt(jumped), "edges")
        discard(was)
        if not now.where("moved").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
