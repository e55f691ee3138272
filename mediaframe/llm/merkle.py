"""A Merkle manifest of a dataset, and every row's authentication path by scheduled traversal.

Trees have eight children a node. The leaves of each part of the table (a language) are numbered
in order and cut into aligned blocks of 8^4. A block is one row that holds its digests; its root is
found by treehash, roots are numbered blocks' leaves in turn, up to one node a part, and the
parts' roots form the tree on top. Then paths go down: a task walks a block leaf by leaf. For every level it
holds the run of eight nodes that the path needs now, and a treehash stack that makes the next run while this one
is used up, one leaf at each step, so memory grows with the height and not with the block; the path that all leaves
of a block share above it is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.llm.common import saved, shuffle_partitions
from mediaframe.llm.exact_dedup import lowered

#: Children of a node; levels of a block, and so leaves of one.
WIDTH, LEVELS = 8, 4
BLOCK = WIDTH**LEVELS
#: Spans (parts of range partitions) that are sent to all tasks; more are joined by shuffle.
FEW_SPANS = 100_000
#: Leaves whose paths are given in one Arrow batch.
STEPS = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def digest(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """SHA-256 in hex of each value as its bytes' count, a colon and the value, or - for a null."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def height(count: int) -> int:
    """Levels above count leaves until one node remains."""
    h = 0
    while count > 1:
        count, h = -(-count // WIDTH), h + 1
    return h


class Treehash:
    """Nodes of one level from leaves given one by one: a stack holds the open run of each level below."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, node: str) -> None:
        for run in self.stack[:-1]:
            run.append(node)
            if len(run) < WIDTH:
                return
            node = digest("".join(run))
            run.clear()
        self.stack[-1].append(node)

    def end(self) -> list[str]:
        """The nodes of the level, the last from fewer leaves if these have ended."""
        carried = None
        for run in self.stack[:-1]:
            if carried is not None:
                run.append(carried)
            carried = digest("".join(run)) if run else None
            run.clear()
        if carried is not None:
            self.stack[-1].append(carried)
        nodes, self.stack[-1] = self.stack[-1], []
        return nodes


def block_root(leaves: list[str], levels: int) -> str:
    stack = Treehash(levels)
    for node in leaves:
        stack.push(node)
    return stack.end()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of every leaf in turn: for each level what stands left and right of its own node in the run."""
    spans = [WIDTH ** (level + 1) for level in range(levels)]  # leaves under a run
    runs, ahead = [], [Treehash(level) for level in range(levels)]
    for level, span in enumerate(spans):
        first = Treehash(level)
        for node in leaves[:span]:
            first.push(node)
        runs.append(first.end())
    for at in range(len(leaves)):
        for level, span in enumerate(spans):
            if at and at % span == 0:
                runs[level] = ahead[level].end()
            if at + span < len(leaves):
                ahead[level].push(leaves[at + span])
        own = at
        path = []
        for run in runs:
            k, own = own % WIDTH, own // WIDTH
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
        yield path


def numbered(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """rows with pos (from 0 in each part, by order) and total (rows of the part). A part may hold all rows: rows
    are sorted over ranges of part and order, and a row's place is its place in its range and what the ranges before hold of the part.
    Rows equal in both are dealt to different ranges by a number of their own; null comes first."""
    spark = rows.sparkSession
    dealt = rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id(), F.lit(7)))
    by = [F.col(part).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("deal")]
    laid = dealt.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    local = F.monotonically_increasing_id()
    laid = saved(laid.drop("deal").withColumn("task", F.shiftright(local, 33).cast("int")).withColumn("local", local.bitwiseAND((1 << 33) - 1)), "laid")
    spans = saved(laid.groupBy(part, "task").agg(F.min("local").alias("first"), F.count("*").alias("n")), "spans")
    in_part = Window.partitionBy(part)  # a part has as many spans as ranges that it reaches into
    before = F.coalesce(F.sum("n").over(in_part.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spans.select(F.col(part).alias("of"), F.col("task").alias("of_task"), (before - F.col("first")).alias("shift"), F.sum("n").over(in_part).alias("total"))
    placed = F.broadcast(placed) if spans.count() <= FEW_SPANS else placed
    found = laid.join(placed, laid[part].eqNullSafe(placed["of"]) & (laid["task"] == placed["of_task"]))
    return found.withColumn("pos", F.col("local") + F.col("shift")).drop("task", "local", "of", "of_task", "shift")


_BLOCKS = "part string, block long, levels int, root string, keys array<long>, leaves array<string>, probes array<string>"


def _blocks(nodes: DataFrame) -> DataFrame:
    """A row for each block of nodes (part, pos, total, key, leaf, probe), saved: its root and, in order, its keys, leaves and probes."""
    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves, total = table["leaf"].to_pylist(), table["total"][0].as_py()
        levels = min(LEVELS, height(total))
        row = {"part": table["part"][0].as_py(), "block": table["block"][0].as_py(), "levels": levels, "root": block_root(leaves, levels), "keys": table["key"].to_pylist(), "leaves": leaves, "probes": table["probe"].to_pylist()}
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    return saved(nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("part", "block").applyInArrow(gather, _BLOCKS), "blocks")


def _paths(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """part, key, leaf, probe, path, subroot and root of every node of the blocks. above: what the blocks of a part have above them, as the same columns by part and key (the
    block's number); none given: a block's own root is subroot and root."""
    if above is None:
        met = blocks.select("*", F.array().cast(PATH).alias("over"), F.col("root").alias("subroot"), F.col("root").alias("top"))
    else:
        upper = above.select(F.col("part").alias("of"), F.col("key").alias("of_block"), F.col("path").alias("over"), "subroot", F.col("root").alias("top"))
        met = blocks.join(upper, blocks["part"].eqNullSafe(upper["of"]) & (blocks["block"] == upper["of_block"]))
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    names = ["part", "key", "leaf", "probe", "path", "subroot", "root"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(step), pa.string(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for b in (row for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
                rows, over = [], [(s["left"], s["right"]) for s in b["over"]]
                for key, node, probe, path in zip(b["keys"], b["leaves"], b["probes"], traverse(b["leaves"], b["levels"]), strict=True):
                    rows.append((b["part"], key, node, probe, path + over, b["subroot"], b["top"]))
                    if len(rows) == STEPS:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return met.select("part", "keys", "leaves", "probes", "levels", "over", "subroot", "top").mapInArrow(walk, f"part string, key long, leaf string, probe string, path {PATH}, subroot string, root string")


def _up(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of nodes, of their roots and so on, until every part is one block."""
    tiers = [_blocks(nodes)]
    while tiers[-1].where("block > 0").limit(1).count():
        roots = tiers[-1].select("part", F.col("block").alias("pos"), F.col("block").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("probe"))
        totals = roots.groupBy("part").agg(F.count("*").alias("total"))
        met = roots.join(totals.withColumnRenamed("part", "of"), F.col("part").eqNullSafe(F.col("of"))).drop("of")
        tiers.append(_blocks(met))
    return tiers


def proofs(leaves: DataFrame) -> DataFrame:
    """key, leaf, probe, path, subroot and root of every row of leaves: part (string), key (long), leaf and probe (hex; the probe only goes along, as a leaf found later does).

    In each part leaves ascend by key, null first, then by leaf; every 8 consecutive nodes (the last
    run: fewer, even one) become the SHA-256 of their digests' text, level by level, until one remains, which is the subroot (a lone leaf: itself). Subroots,
    by part, null first and bytewise, become root likewise. path: for each level from the leaf to the root
    the joined digests left and right of the own node, so that sha256(left + own + right) is the next. A table without rows
    gives none. Keys may repeat and be null; equal rows are told apart by nothing and get one place each."""
    placed = numbered(leaves.select("part", "key", "leaf", "probe"), "part", ["key", "leaf"])
    tiers = _up(placed)
    roots = tiers[-1].where("block = 0").select(F.lit("").alias("whole"), "part", F.lit(None).cast("long").alias("key"), F.col("root").alias("leaf"))
    ranked = numbered(roots, "whole", ["part"])
    # The tree on top has the parts as leaves; keys are their numbers, which lead back to their names.
    names = saved(ranked.select(F.col("part").alias("name"), "pos"), "parts")
    top = _up(ranked.select(F.lit("").alias("part"), "pos", "total", F.col("pos").alias("key"), "leaf", F.lit(None).cast("string").alias("probe")))
    above = None
    for blocks in reversed(top):
        above = _paths(blocks, above).withColumn("part", F.lit(""))
    of_part = above.select(F.col("key").alias("pos"), "path", F.col("leaf").alias("subroot"), "root").join(names, "pos")
    over = saved(of_part.select(F.col("name").alias("part"), F.lit(0).cast("long").alias("key"), "path", "subroot", "root"), "over-parts")
    for blocks in reversed(tiers[1:]):
        over = saved(_paths(blocks, over), "over-blocks")
    return _paths(tiers[0], over).drop("part")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """part (lang), key (doc_id), leaf and probe (the leaf of the row where tampered holds, with A-Z of its text in lower case) for proofs(). Only these columns are read of docs; others may have any name."""
    one = docs.select(*FIELDS, F.coalesce(tampered, F.lit(False)).alias("tampered"))
    probe = leaf(*(F.col(c) for c in FIELDS[:-1]), lowered(F.col("text")))
    own = one.select(F.col("lang").cast("string").alias("part"), F.col("doc_id").cast("long").alias("key"), leaf(*(F.col(c) for c in FIELDS)).alias("leaf"), F.when(F.col("tampered"), probe).alias("probe"))
    return own.select("part", "key", "leaf", F.coalesce("probe", "leaf").alias("probe"))
