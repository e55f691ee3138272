"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Law `rows`: shard sizes differ by one at most. The places of all shards are cut into blocks
of exact sizes. How many rows each input partition sends to each block is the matrix; it is
drawn exactly (multivariate hypergeometric), each task drawing only its own row: it walks
down a binary tree over the partitions, halving the block counts at every node with a
generator seeded by the node, so the rows of all tasks agree without being stored anywhere.
A task permutes its rows locally by dealing a permuted list of block numbers, the exchange
brings a block together, and the rows of a block are permuted again; the place in the block
is the slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.llm.common import saved, shuffle_partitions

#: The library's generator draws from urns of fewer rows than this.
MOST_ROWS = 10**9
#: Rows of a block, about; a block is permuted in one task.
BLOCK_ROWS = 128


def block_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of shards * per_shard blocks; shard s owns blocks s * per_shard and on."""
    of_shard = rows // shards + (np.arange(shards) < rows % shards)
    return (of_shard[:, None] // per_shard + (np.arange(per_shard)[None, :] < (of_shard % per_shard)[:, None])).reshape(-1).astype(np.int64)


def matrix_row(counts: np.ndarray, blocks: np.ndarray, part: int, seed: int) -> np.ndarray:
    """How many rows partition `part` sends to each block; counts: rows by partition."""
    below = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, left = 0, len(counts), blocks.astype(np.int64).copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(left, int(below[mid] - below[lo]), method="marginals")
        left, lo, hi = (draw, lo, mid) if part < mid else (left - draw, mid, hi)
    return left


def into_shards(df: DataFrame, shards: int, seed: int = 0, fixed: bool = False) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard); every
    arrangement of the rows is equally likely.

    fixed: df is a plain scan, whose partitions hold the same rows whenever they are read;
    any other input is first saved in the shared folder. Rows may repeat and hold nulls;
    an empty table gives no rows; fewer rows than shards leave shards empty. More than
    10^9 rows raise an error. df must not have the columns shard and slot."""
    if {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column shard or slot")
    spark = df.sparkSession
    df = df if fixed else saved(df, "to-shard")
    part = F.spark_partition_id()
    found = dict(df.select(part.alias("p")).groupBy("p").count().collect())
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], np.int64)
    rows = int(counts.sum())
    if rows >= MOST_ROWS:
        raise ValueError(f"{rows} rows; one shuffle takes fewer than {MOST_ROWS}")
    per_shard = max(1, min(-(-rows // (shards * BLOCK_ROWS)), -(-8 * shuffle_partitions(spark) // shards)))
    blocks = block_sizes(rows, shards, per_shard)
    starts = np.cumsum(blocks.reshape(shards, per_shard), axis=1) - blocks.reshape(shards, per_shard)

    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        me = TaskContext.get().partitionId()
        order = np.repeat(np.arange(len(blocks), dtype=np.int32), matrix_row(counts, blocks, me, seed)) if me < len(counts) else np.zeros(0, np.int32)
        np.random.default_rng([seed, me, 1 << 32]).shuffle(order)
        at = 0
        for b in batches:
            if at + len(b) > len(order):
                raise RuntimeError("a partition has more rows than were counted: the input isn't fixed")
            yield pd.Series(order[at : at + len(b)])
            at += len(b)
        if at != len(order):
            raise RuntimeError("a partition has fewer rows than were counted: the input isn't fixed")

    own = {name: f"__{name}_{seed}" for name in ("block", "key")}
    dealt = df.withColumn(own["key"], F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).withColumn(own["block"], F.pandas_udf(deal, "int")(part))
    block = F.col(own["block"])
    nth = F.row_number().over(Window.partitionBy(own["block"]).orderBy(own["key"])) - 1
    first = F.element_at(F.lit(starts.reshape(-1).tolist()) if rows else F.array(F.lit(0)), block + 1)
    return dealt.select(*(F.col(f"`{c}`") for c in df.columns), F.floor(block / per_shard).cast("int").alias("shard"), (first + nth).cast("long").alias("slot"))
