"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Equal vectors are one node that carries its smallest ids, as many as a result can hold. Nodes
are dealt to shards of bounded size by a hash. In each shard a directed graph is built: nodes
enter in batches, a greedy search from the middle proposes neighbours, and pruning keeps a
proposal only if no kept, closer neighbour is nearer to it than the node itself by a relaxation
factor; links are made in both directions and pruned again when a node has too many. Every
query then goes through every shard by beam search, and the shards' bests are merged by
their exact scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.llm.common import saved

#: Nodes of a shard, links of a node, beam while building and searching, relaxation of the pruning.
SHARD_NODES, DEGREE, BUILD_BEAM, BEAM, RELAX = 8_192, 24, 48, 96, 1.2
#: Queries that meet a shard in one task; pairs of proposals that are compared at once while pruning.
QUERY_BLOCK, PRUNED = 65_536, 1 << 21


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and vec of the rows that take part: id and vector not null, no component null, NaN or
    infinite, not all zero. Vectors of different lengths have no cosine and don't meet."""
    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and size(vec) > 0")
    return found.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))


def _search(unit: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of all queries in step: ids and distances of the beam, nearest first, and ids of all nodes that were expanded. -1: none."""
    n_q, n = len(queries), len(unit)
    ids = np.full((n_q, beam), -1, np.int32)
    dist = np.full((n_q, beam), np.inf, np.float32)
    done = np.zeros((n_q, beam), bool)
    seen = np.zeros((n_q, n), bool)
    ids[:, 0], dist[:, 0], seen[:, entry] = entry, 1 - queries @ unit[entry], True
    trail, active = [], np.arange(n_q)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        some = open_.any(axis=1)
        active, open_ = active[some], open_[some]
        if not len(active):
            break
        at = open_.argmax(axis=1)
        node = ids[active, at]
        done[active, at] = True
        trail.append((active, node))
        near = links[node]
        safe = np.maximum(near, 0)
        new = (near >= 0) & ~seen[active[:, None], safe]
        seen[active[:, None], np.where(near >= 0, near, node[:, None])] = True
        d = np.where(new, 1 - np.einsum("qkd,qd->qk", unit[safe], queries[active]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[active], d], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, near, -1)], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros_like(new)], axis=1), keep, 1)
    visited = np.full((n_q, len(trail)), -1, np.int32)
    for k, (who, node) in enumerate(trail):
        visited[who, k] = node
    return ids, dist, visited


def _prune(unit: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most degree of each node's proposals (a row of proposed, -1: none), nearest first, without
    those that a kept, nearer one covers. Nodes are taken in blocks of bounded size."""
    out = np.full((len(nodes), degree), -1, np.int32)
    step = max(1, PRUNED // max(1, proposed.shape[1] ** 2))
    for lo in range(0, len(nodes), step):
        node, near = nodes[lo : lo + step], np.sort(proposed[lo : lo + step], axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == node[:, None]] = -1
        vec = unit[np.maximum(near, 0)]
        d = np.where(near >= 0, 1 - np.einsum("bpd,bd->bp", vec, unit[node]), np.inf).astype(np.float32)
        order = np.argsort(d, axis=1, kind="stable")
        near, d, vec = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
        between = relax * (1 - vec @ vec.transpose(0, 2, 1))
        left, count, rows = near >= 0, np.zeros(len(node), np.int64), np.arange(len(node))
        for k in range(near.shape[1]):
            some = rows[left[:, k] & (count < degree)]
            if not len(some):
                if not left[:, k:].any():
                    break
                continue
            out[lo + some, count[some]] = near[some, k]
            count[some] += 1
            left[some] &= between[some, k] > d[some]
    return out


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 0) -> tuple[np.ndarray, int]:
    """Links (-1: none) and the entry of a graph over unit vectors."""
    n = len(unit)
    links = np.full((n, degree), -1, np.int32)
    entry = int(np.argmax(unit @ unit.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        ids, _, visited = _search(unit, links, entry, unit[batch], beam)
        links[batch] = own = _prune(unit, batch, np.concatenate([ids, visited], axis=1), degree, relax)
        to, by = own.ravel(), np.repeat(batch, degree).astype(np.int32)
        to, by = to[to >= 0], by[to >= 0]
        order_to = np.argsort(to, kind="stable")
        to, by = to[order_to], by[order_to]
        ends, first, more = np.unique(to, return_index=True, return_counts=True)
        back = np.full((len(ends), degree + int(more.max(initial=0))), -1, np.int32)  # links so far, then the new ones
        back[:, :degree] = links[ends]
        back[np.repeat(np.arange(len(ends)), more), degree + np.arange(len(to)) - np.repeat(first, more)] = by
        held = (back >= 0).sum(axis=1)
        few, many = held <= degree, held > degree
        links[ends[few]] = np.take_along_axis(back[few], np.argsort(back[few] < 0, axis=1, kind="stable")[:, :degree], 1)
        links[ends[many]] = _prune(unit, ends[many], back[many], degree, relax)
        at += len(batch)
        size = min(2 * size, 256, max(1, at))
    return links, entry


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _norm(vec: np.ndarray) -> np.ndarray:
    big = np.abs(vec).max(axis=1, keepdims=True)
    scale = np.where((big > 1e150) | (big < 1e-150), big, 1.0)  # else squares would overflow or vanish
    return np.sqrt(((vec / scale) ** 2).sum(axis=1)) * scale[:, 0]


def _unit(vec: np.ndarray) -> np.ndarray:
    return (vec / _norm(vec)[:, None]).astype(np.float32)


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """vec and its k + 1 smallest ids, for each distinct vector: a result of k rows can't hold others.
    The limit within a group is applied before the rows are moved."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def index(vectors: DataFrame, k: int, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Saved table of nodes: size (of the vector), shard, node (place in its shard), entry, vec, ids, links. Lengths of vectors, of which a table has few, have shards of their own."""
    distinct = saved(nodes(vectors, k).withColumn("size", F.size("vec")), "vectors")
    shards = distinct.groupBy("size").agg(F.ceil(F.count("*") / shard_nodes).alias("shards"))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort([x[0] for x in table["ids"].to_pylist()], kind="stable"))
        links, entry = build(_unit(_rows(table["vec"])))
        n = len(table)
        return pa.table({"size": table["size"], "shard": table["shard"], "node": pa.array(np.arange(n), pa.int32()), "entry": pa.array(np.full(n, entry), pa.int32()), "vec": table["vec"], "ids": table["ids"], "links": pa.array(list(links), pa.list_(pa.int32()))})

    kind = distinct.schema["vec"].dataType.simpleString()
    dealt = distinct.join(F.broadcast(shards), "size").withColumn("shard", F.pmod(F.xxhash64("ids"), F.col("shards")).cast("int")).drop("shards")
    return saved(dealt.groupBy("size", "shard").applyInArrow(run, f"size int, shard int, node int, entry int, vec {kind}, ids array<bigint>, links array<int>"), "graph")


def search(graph: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each query (id, vec), without
    the row of the query's own id; ties go to the smaller id. Repeated query rows count once. The beam compares in
    32 bits, so of candidates that tie there it may keep either at its edge; those it returns are scored and ordered in double precision."""
    shards = graph.groupBy("size").agg((F.max("shard") + 1).alias("shards"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("size", F.size("vec"))
    asked = asked.join(F.broadcast(shards), "size").select("size", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "id", "vec")
    graph = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node")
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            vec = _rows(left["vec"])
            unit, ids = _unit(vec), left["ids"].to_pylist()
            links, entry = np.array(left["links"].to_pylist(), np.int32).reshape(len(left), -1), left["entry"][0].as_py()
            asked, block = _rows(right["vec"]), right["id"].to_pylist()
            norm = _norm(vec)
            for lo in range(0, len(asked), 256):
                part = asked[lo : lo + 256]
                found, _, _ = _search(unit, links, entry, _unit(part), beam)
                for q, own, row in zip(block[lo : lo + 256], part, found, strict=True):
                    row = row[row >= 0]
                    score = (vec[row] * own).sum(axis=1) / norm[row] / _norm(own[None])[0]
                    best = sorted((-s, i) for s, at in zip(score.tolist(), row.tolist(), strict=True) for i in ids[at] if i != q)[:k]
                    out["query_id"] += [q] * len(best)
                    out["vec_id"] += [i for _, i in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = graph.groupBy("size", "shard", "block").cogroup(asked.groupBy("size", "shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
