"""Connected components of a table of links, by alternating small and large stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import saved

#: Links of a task that are made stars at once.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links (a, b): the smallest node of each, beside every other node of it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[rest]], nodes[rest]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars, CHUNK of them at a time: far fewer, with the same components."""

    def made() -> pa.RecordBatch:
        found = stars(*(np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1)))
        return pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield made()
            held = []
    if held:
        yield made()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links (a, b long; they may repeat): root is the smallest node that
    can be reached. Each round makes stars of what a task holds, joins every node's smaller neighbours
    to the smallest of them (a shuffle by the larger end, which a hub isn't), then its larger ones to it: only
    ends that have a smaller neighbour themselves are looked up. Without any, and with one smaller neighbour for each node,
    the links are stars. A round's links are written to the shared folder, and only two counts go to the driver."""
    edges = saved(links.where("a <> b").toDF("a", "b"), "links")
    for _ in range(most_rounds):
        met = edges.mapInArrow(_contracted, "a long, b long").groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("all"))
        met = met.select("m", F.explode(F.transform("all", lambda x: F.struct(F.when(x == F.col("m"), F.col("b")).otherwise(x).alias("b"), (x != F.col("m")).alias("more")))).alias("x"))
        edges = saved(met.select(F.col("m").alias("a"), "x.b", "x.more"), "links")
        hubs = edges.select(F.col("a").alias("hub")).distinct()
        above = saved(edges.join(hubs, F.col("b") == F.col("hub"), "left_semi").groupBy(F.col("b").alias("a")).agg(F.min("a").alias("up")), "above")
        if above.isEmpty() and edges.where("more").isEmpty():
            break
        edges = edges.join(above, "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
