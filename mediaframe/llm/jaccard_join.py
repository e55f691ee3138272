"""Exact Jaccard join of word-shingle sets by grouped prefixes, returning linked components.

1. Counts. How many rows hold a shingle is counted for the shingles with the lower hashes
   (dealt by value in packed arrays, counted by sorting). From the counts come a bit map of
   fixed size of those that more than one row holds, and the most frequent ones, of bounded
   number. Both only order and thin work; the result is the same with any content.
2. Groups. Rows with equal sets are one node. A node's shingles are ordered: counted ones by
   how frequent they are, then the others, each by hash. Sets with similarity t share a
   shingle among the first n - ceil(t n) + 1 of each. Nodes with identical prefixes and size
   are one group.
3. Group pairs. For each shingle that several prefixes hold there is a list of its groups; of
   shingles with the same groups the first in the order stays. Group pairs are filtered by
   their sizes and by the shingle's places in the prefixes, those left expand to pairs of
   members, which are filtered by a bound: the bits in which two parity maps differ are no
   more than the elements in which the sets differ. A map has as many bits as its set has
   elements, so the bound holds off pairs of any size. A list gives a spanning forest of the
   pairs that pass, by breadth first search, not the pairs: as many rows as members at most.
   Long lists are dealt into blocks; afterwards, where a list is still in several clusters,
   what isn't in its largest meets all its blocks.
4. Verification. Clusters of what passed are dealt into cells of bounded size; every cell
   gets its whole sets once and finds its linked components exactly, again by breadth first
   search. A cluster of more than one cell goes on: a few members of each component meet and
   merge, then all nodes outside the cluster's largest component meet all its cells. So every
   pair that may link and isn't linked through others is decided on the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.llm.common import bound_batches, kept_by, saved, shuffle_partitions, texts, trim
from mediaframe.llm.components import connected_components
from mediaframe.llm.shingles import SHINGLE, mix, sets
from mediaframe.llm.tokens import in_slices

#: Parts into which hashes are dealt; bits of the map of shared shingles; most frequent shingles that are kept, and the least count for that; hashes that are counted, in 256ths of their range.
LEAST_PARTS, MAP_BITS, MOST_FREQUENT, FREQUENT, COUNTED = 256, 27, 500_000, 12, 104
#: Groups of a list that meet in one task; rows of lists in a part, about; groups of a list of which all pairs are looked at; members that stand in one row of a group.
BLOCK, PART_ROWS, SHORT, MEMBERS = 1_024, 8_192, 8, 64
#: Nodes and elements of a cell, about; members of a component that merge with others.
CELL_NODES, CELL_ELEMENTS, ENVOYS = 512, 2_000_000, 4
#: Bits of the map of wanted rows for each of them, and most bits (a power of two); more rows make the map let more through, and the join decides.
WANTED_BITS, MOST_WANTED_BITS = 16, 27
#: Nodes, and rows that are told apart from those kept, that are sent to all tasks; more are joined by a shuffle.
FEW_NODES, FEW_MARKS = 500_000, 1_000_000
#: Text that is hashed at once, in bytes; the arrays take about 40 times as much.
SLICE = 1_000_000


def _short(h: np.ndarray) -> np.ndarray:
    """The upper 40 bits, by which shingles are counted; sorts as the hash does."""
    return h >> np.uint64(24)


def _parts(docs: DataFrame) -> int:
    """A power of two that grows with the number of shuffle partitions, which is set by the size of the data."""
    return min(1 << 16, max(LEAST_PARTS, 1 << (4 * shuffle_partitions(docs.sparkSession) - 1).bit_length()))


def _counted(s: np.ndarray) -> np.ndarray:
    """The elements, sorted, that are counted: whether one is depends on itself alone."""
    return s[: np.searchsorted(s, np.uint64(COUNTED << 56))]


def _counts(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit map of counted short hashes in more than one row (one bit may stand for several), and the frequent short hashes, sorted, with counts."""
    shift, parts = np.uint64(64 - MAP_BITS), _parts(docs)
    width, below = (1 << MAP_BITS) // parts, np.uint64(40 - (parts.bit_length() - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (text,) in in_slices(batch, SLICE):
                own = [_short(_counted(s)) for s in sets(text, size)]
                all_ = np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint64)
                cuts = np.searchsorted(all_, np.arange(parts + 1, dtype=np.uint64) << below)
                low = all_.astype("<u4").tobytes()
                some = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([low[4 * cuts[k] : 4 * cuts[k + 1]] for k in some], pa.binary())], names=["part", "low"])
        trim()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        low = np.sort(np.concatenate([np.frombuffer(b.as_buffer(), "<u4") for chunk in table["low"].chunks for b in chunk]))
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.concatenate([first, [len(low)]]))
        value = (np.uint64(part) << below) | (low[first].astype(np.uint64) & ((np.uint64(1) << below) - np.uint64(1)))
        bits = np.zeros(width, bool)
        bits[((value[n > 1] << np.uint64(24)) >> shift).astype(np.int64) - part * width] = True
        hot = np.flatnonzero(n >= FREQUENT)
        hot = hot[np.argsort(-n[hot], kind="stable")[: max(1, 2 * MOST_FREQUENT // parts)]]
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "hot": pa.array([value[hot].astype("<u8").tobytes()], pa.binary()), "n": pa.array([n[hot].astype("<i8").tobytes()], pa.binary())})

    dealt = docs.select("text").mapInArrow(deal, "part int, low binary")
    rows = dealt.groupBy("part").applyInArrow(count, "part int, bits binary, hot binary, n binary").collect()
    shared = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in rows:
        shared[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    hot = np.concatenate([np.frombuffer(r["hot"], "<u8") for r in rows] or [np.zeros(0, np.uint64)])
    n = np.concatenate([np.frombuffer(r["n"], "<i8") for r in rows] or [np.zeros(0, np.int64)])
    top = np.argsort(-n, kind="stable")[:MOST_FREQUENT]
    top = top[np.argsort(hot[top])]
    return shared, hot[top], n[top]


def _level(n: np.ndarray | int) -> np.ndarray:
    """A map of a set of n elements has 2^level bits: n of them at least, 64 at least."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _parity(s: np.ndarray) -> bytes:
    """Bit k: whether an odd number of elements fall on k. A map of half the bits is the two halves' difference."""
    bits = 1 << int(_level(len(s)))
    return np.packbits(np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _digest(s: np.ndarray) -> int:
    """A signed 64-bit name for a set or sequence of hashes."""
    with np.errstate(over="ignore"):
        at = mix(s + np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(at ^ np.uint64(len(s)))[0].astype(np.int64))


class _Order:
    """Prefixes under the common order: counted shingles by frequency and hash, then the others by hash."""

    def __init__(self, shared: np.ndarray, hot: np.ndarray, n: np.ndarray, percent: int):
        self.shared, self.hot, self.n, self.percent = shared, hot, n, percent

    def frequency(self, short: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(short), np.int64)
        at = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
        return np.where(self.hot[at] == short, self.n[at], 0)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix in order, and which of its elements another row may have; s is sorted."""
        size, low = len(s) - -(-self.percent * len(s) // 100) + 1, _counted(s)
        n = self.frequency(_short(low))
        at = np.flatnonzero(n == 0)[:size]
        if len(at) < size:
            some = np.flatnonzero(n)
            at = np.concatenate([at, some[np.argsort(n[some], kind="stable")][: size - len(at)]])
        at = np.concatenate([at, np.arange(len(low), len(low) + size - len(at))])
        found = s[at]
        bit = found >> np.uint64(64 - MAP_BITS)
        return found, ((self.shared[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1) | (at >= len(low))


def _signatures(docs: DataFrame, order, size: int) -> DataFrame:
    """doc_id, row_id, n, node, grp, parity, tokens and places (of the tokens in the prefix) of every
    row, and what docs has of long columns between row_id and text."""
    own_names = docs.columns[2:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("shingles")  # before the order is read
        own = order.value
        none = [0, None, None, None, np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            for ids, row_ids, *more, text in in_slices(batch, SLICE):
                cols = [ids, row_ids, [], [], [], [], [], [], *more]
                for s in sets(text, size):
                    found = none
                    if len(s):
                        prefix, keep = own.prefix(s)
                        found = [len(s), _digest(s), _digest(np.append(prefix, np.uint64(len(s)))), _parity(s), prefix[keep].view(np.int64), np.flatnonzero(keep).astype(np.int32)]
                    for c, x in zip(cols[2:8], found, strict=True):
                        c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int64()] * len(more))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "row_id", "n", "node", "grp", "parity", "tokens", "places", *own_names])
        trim()

    return saved(docs.mapInArrow(run, "doc_id long, row_id long, n long, node long, grp long, parity binary, tokens array<bigint>, places array<int>" + "".join(f", {c} long" for c in own_names)), "signatures")


def _groups(holder: DataFrame) -> DataFrame:
    """gid (the group's first node), grp, n, tokens, places, nodes and parities (of the members) of every group; one of more than MEMBERS nodes is several rows."""
    whole = holder.where(F.size("tokens") > 0).withColumn("rows", F.count("*").over(Window.partitionBy("grp")))
    sub = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / MEMBERS)).alias("sub")
    first = [F.first(c).alias(c) for c in ("n", "tokens", "places")]
    grouped = whole.groupBy("grp", sub).agg(F.min("node").alias("gid"), *first, F.collect_list(F.struct("node", "parity")).alias("members"))
    return saved(grouped.select("gid", "grp", "n", "tokens", "places", F.col("members.node").alias("nodes"), F.col("members.parity").alias("parities")), "groups")


def _lists(groups: DataFrame) -> DataFrame:
    """token, gid, place, blocks and block of each group in a list, for shingles in the prefixes of
    more than one group; of shingles with the same groups the first in the order stays."""
    each = groups.select("gid", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("gid", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    each = saved(each, "prefixes")
    found = each.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("gid")).alias("x"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("y"), F.min(F.struct("gid", "place")).alias("first"))
    one = found.where("k > 1").groupBy("k", "x", "y").agg(F.min_by("token", "first.place").alias("token")).select("token", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    return saved(each.join(one, "token").withColumn("block", F.pmod(F.xxhash64("token", "gid"), F.col("blocks"))), "lists")


class _Members:
    """Groups of a task with their members: which group pairs pass the filters."""

    def __init__(self, n: np.ndarray, place: np.ndarray, grp: np.ndarray, parity: list[list[bytes]], percent: int):
        self.n, self.place, self.grp, self.percent = n, place, grp, percent
        self.count = np.array([len(p) for p in parity], np.int64)
        self.first = np.cumsum(self.count) - self.count
        level = np.repeat(_level(n), self.count)
        self.level = _level(n)
        flat = [np.frombuffer(b, np.uint8) for own in parity for b in own]
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for lv in np.unique(level).tolist():
            own, above = np.flatnonzero(level == lv), np.flatnonzero(level == lv + 1)
            rows = np.stack([flat[k] for k in own.tolist()])
            if len(above):
                larger = np.stack([flat[k] for k in above.tolist()])
                rows = np.concatenate([rows, larger[:, : rows.shape[1]] ^ larger[:, rows.shape[1] :]])
            at = np.full(len(level), -1, np.int32)
            at[own], at[above] = np.arange(len(own)), np.arange(len(own), len(own) + len(above))
            self.maps[lv] = rows.view(np.uint64), at

    def passing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of groups whether it may hold a link, as far as this shingle is the first that both prefixes have."""
        n, m, i, j = self.n[x], self.n[y], self.place[x], self.place[y]
        need = -(-self.percent * (n + m) // (100 + self.percent))
        out = (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= need)
        left = np.flatnonzero(out & (self.grp[x] != self.grp[y]))
        out[left] = False
        x, y, differ = x[left], y[left], (n + m - 2 * need)[left]
        pairs = self.count[x] * self.count[y]
        pair = np.repeat(np.arange(len(left)), pairs)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        a, b = self.first[x][pair] + nth // self.count[y][pair], self.first[y][pair] + nth % self.count[y][pair]
        lower = np.minimum(self.level[x], self.level[y])[pair]
        for lv in np.unique(lower).tolist():
            rows, at = self.maps[lv]
            some = np.flatnonzero(lower == lv)
            step = max(1, (1 << 22) // rows.shape[1])
            for lo in range(0, len(some), step):
                k = some[lo : lo + step]
                ok = np.bitwise_count(rows[at[a[k]]] ^ rows[at[b[k]]]).sum(axis=1, dtype=np.int64) <= differ[pair[k]]
                out[left[pair[k[ok]]]] = True
        return out


def _forest(members: _Members, left: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of the passing pairs in left."""
    edges = [np.zeros((0, 2), np.int64)]
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            reached = members.passing(np.full(len(left), at), left)
            if reached.any():
                new = left[reached]
                edges.append(np.stack([np.full(len(new), at), new], axis=1))
                front += new.tolist()
                left = left[~reached]
    return np.concatenate(edges)


def _with_members(lists: DataFrame, groups: DataFrame) -> DataFrame:
    return lists.join(groups.select("gid", "grp", "n", "parities"), "gid")


def _edges(lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of gids that span the passing pairs of every block of a list; they may repeat."""
    parts = max(shuffle_partitions(lists.sparkSession), lists.count() // PART_ROWS)

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_numpy() for c in ("token", "block", "gid", "grp", "n", "place")}
        by = np.lexsort((cols["n"], cols["block"], cols["token"]))
        cols, parities = {c: v[by] for c, v in cols.items()}, table["parities"].to_pylist()
        members = _Members(cols["n"], cols["place"], cols["grp"], [parities[k] for k in by.tolist()], percent)
        start = np.flatnonzero(np.concatenate([[True], (np.diff(cols["token"]) != 0) | (np.diff(cols["block"]) != 0)]))
        size, found = np.diff(np.append(start, len(by))), []
        for k in range(2, SHORT + 1):  # all pairs of the short lists at once
            at = start[size == k]
            x, y = ((at[:, None] + i).ravel() for i in np.triu_indices(k, 1))
            ok = members.passing(x, y)
            found.append(np.stack([x[ok], y[ok]], axis=1))
        for lo, k in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            found.append(_forest(members, np.arange(lo, lo + k)))
        pairs = np.unique(np.sort(cols["gid"][np.concatenate(found)], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    dealt = lists.withColumn("part", F.pmod(F.xxhash64("token", "block"), F.lit(parts)))
    return _with_members(dealt, groups).groupBy("part").applyInArrow(run, "a long, b long")


def _across(lists: DataFrame, groups: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of clusters that hold a passing pair in different blocks of a list. What isn't in
    the list's largest cluster is dealt into chunks, and every chunk meets every block. Pairs may repeat."""
    placed = lists.join(clusters.withColumnRenamed("node", "gid"), "gid", "left").withColumn("cluster", F.coalesce("cluster", "gid"))
    sizes = placed.groupBy("token", "cluster").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max_by("cluster", F.struct("k", "cluster")).alias("main"), (F.sum("k") - F.max("k")).alias("rest")).where("rest > 0")
    placed = saved(placed.join(main.select("token", "main", F.ceil(F.col("rest") / BLOCK).alias("chunks")), "token"), "long-lists")
    far = placed.where("cluster <> main").withColumn("chunk", F.pmod(F.xxhash64("gid", "token"), F.col("chunks"))).withColumn("own", F.col("block"))
    far = far.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> own")
    near = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cols = ["token", "block", "chunk", "gid", "place", "cluster"]

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_numpy(zero_copy_only=False) for c in ("grp", "n", "place", "cluster", "near")}
        members = _Members(cols["n"], cols["place"], cols["grp"], table["parities"].to_pylist(), percent)
        near, cluster, found = np.flatnonzero(cols["near"]), cols["cluster"], [np.zeros((0, 2), np.int64)]
        for at in np.flatnonzero(~cols["near"]).tolist():
            ok = members.passing(np.full(len(near), at), near) & (cluster[near] != cluster[at])
            if ok.any():
                other = np.unique(cluster[near[ok]])
                found.append(np.stack([np.full(len(other), cluster[at]), other], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    both = near.select(*cols, F.lit(True).alias("near")).union(far.select(*cols, F.lit(False).alias("near")))
    return _with_members(both, groups).groupBy("token", "block", "chunk").applyInArrow(run, "a long, b long")


def _clusters(holder: DataFrame, percent: int) -> DataFrame:
    """node and cluster of nodes that may link: two that link are in one cluster."""
    groups = _groups(holder)
    lists = _lists(groups)
    inside = groups.where(F.size("nodes") > 1).select(F.col("gid").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    alike = Window.partitionBy("grp")
    inside = inside.union(groups.select(F.min("gid").over(alike).alias("a"), F.col("gid").alias("b")).where("a <> b"))
    clusters = saved(connected_components(_edges(lists, groups, percent).union(inside)).toDF("node", "cluster"), "clusters")
    long = lists.where("blocks > 1")
    if not long.isEmpty():
        more = _across(long, groups, clusters, percent).union(clusters.select("cluster", "node"))
        clusters = saved(connected_components(more).toDF("node", "cluster"), "clusters")
    return clusters


def _with_sets(docs: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """cells (row_id, node and more columns) with elements: the node's set, read from the texts again.
    A bit map of wanted rows thins the scan, a join on row_id and node decides."""
    spark, rows = cells.sparkSession, cells.count()
    width = min(MOST_WANTED_BITS, max(16, (WANTED_BITS * rows).bit_length()))
    place = lambda ids: (mix(ids.to_numpy().view(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << width, bool)
        for batch in batches:
            out[place(batch.column(0))] = True
        packed = np.packbits(out, bitorder="little")
        at = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(packed[at], pa.int32())], names=["at", "bits"])

    part = cells.select("row_id").coalesce(8).mapInArrow(bits, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    want = np.zeros((1 << width) // 8, np.uint8)
    want[part["at"].to_numpy()] = part["bits"].to_numpy().astype(np.uint8)
    want = spark.sparkContext.broadcast(want)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0))
            batch = batch.filter(pa.array((want.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for ids, text in in_slices(batch, SLICE):
                found = [(i, _digest(s), s.tobytes()) for i, s in zip(ids, sets(text, size), strict=True) if len(s)]
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row_id", "node", "elements"])
        trim()

    whole = docs.select("row_id", "text").mapInArrow(read, "row_id long, node long, elements binary")
    return whole.join(F.broadcast(cells) if rows <= FEW_NODES else cells, ["row_id", "node"])


class _Sets:
    """Sets of a cell over their common elements."""

    def __init__(self, elements: pa.ChunkedArray, percent: int):
        own = [np.frombuffer(b.as_buffer(), np.uint64) for chunk in elements.chunks for b in chunk]
        self.n, self.percent = np.array([len(s) for s in own], np.int64), percent
        self.start = np.cumsum(self.n) - self.n
        common, self.ids = np.unique(np.concatenate(own), return_inverse=True)
        self.mark = np.zeros(len(common), np.int32)

    def linked(self, at: int) -> np.ndarray:
        """For each set whether it links with set at."""
        own = self.ids[self.start[at] : self.start[at] + self.n[at]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.ids], self.start)
        self.mark[own] = 0
        return 100 * both >= self.percent * (self.n + self.n[at] - both)


def _within(cells: DataFrame, percent: int) -> DataFrame:
    """a, b for each row of cells (cluster, cell, node, label, elements): its label and the smallest label that links within the cell reach."""

    def run(table: pa.Table) -> pa.Table:
        _, first = np.unique(table["node"].to_numpy(), return_index=True)  # copies of a row
        table = table.take(first)
        label, own = table["label"].to_numpy(), _Sets(table["elements"], percent)
        least, left = label.copy(), np.ones(len(label), bool)
        while left.any():
            at = int(left.argmax())
            left[at], front, reached = False, [at], [at]
            while front and left.any():
                new = np.flatnonzero(left & own.linked(front.pop()))
                left[new] = False
                front += new.tolist()
                reached += new.tolist()
            least[reached] = label[reached].min()
        return pa.table({"a": pa.array(label, pa.int64()), "b": pa.array(least, pa.int64())})

    return cells.groupBy("cluster", "cell").applyInArrow(run, "a long, b long")


def _between(cells: DataFrame, percent: int) -> DataFrame:
    """Labels (a, b) with a link between a row that isn't near and one that is. cells: cluster, cell, chunk, node, label, near, elements."""

    def run(table: pa.Table) -> pa.Table:
        label, near, own = table["label"].to_numpy(), table["near"].to_numpy(zero_copy_only=False), _Sets(table["elements"], percent)
        found = [np.zeros((0, 2), np.int64)]
        for at in np.flatnonzero(~near).tolist():
            other = np.unique(label[own.linked(at) & near & (label != label[at])])
            found.append(np.stack([np.full(len(other), label[at]), other], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return cells.groupBy("cluster", "cell", "chunk").applyInArrow(run, "a long, b long")


def _cells(nodes: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and name (how many cells) of what has more than one; nodes: n and the columns of by."""
    sizes = nodes.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / CELL_NODES), F.ceil(F.sum("n") / CELL_ELEMENTS)).alias(name))
    return sizes.where(F.col(name) > 1)


def _dealt(nodes: DataFrame, counts: DataFrame, name: str, cell: str, salt: int) -> DataFrame:
    """nodes with name (1 where counts lacks their cluster) and cell, by a hash of the node."""
    return nodes.join(counts, "cluster", "left").withColumn(name, F.coalesce(name, F.lit(1).cast("long"))).withColumn(cell, F.pmod(F.xxhash64("node", F.lit(salt)), F.col(name)))


def _labels(docs: DataFrame, holder: DataFrame, clusters: DataFrame, percent: int, size: int) -> DataFrame:
    """node and root of the nodes of clusters, decided on the whole sets."""
    nodes = saved(clusters.join(holder.select("node", "row_id", "n"), "node"), "cluster-nodes")
    counts = saved(_cells(nodes, ["cluster"], "cells"), "cells")
    nodes = saved(_dealt(nodes, counts, "cells", "cell", 0), "dealt")
    labels = saved(_within(_with_sets(docs, nodes.select("row_id", "node", "cluster", "cell", F.col("node").alias("label")), size), percent).toDF("node", "root"), "labels")
    if counts.isEmpty():
        return labels
    large = saved(nodes.where("cells > 1").join(labels, "node"), "large-clusters")
    envoys = large.groupBy("cluster", "root").agg(F.array_distinct(F.array(*(F.min_by(F.struct("node", "row_id", "n"), F.xxhash64("node", F.lit(k))) for k in range(1, 1 + ENVOYS)))).alias("e"))
    envoys = envoys.select("cluster", F.col("root").alias("label"), F.explode("e").alias("e")).select("cluster", "label", "e.*")
    envoys = saved(_dealt(envoys, _cells(envoys, ["cluster"], "cells"), "cells", "cell", 1).drop("cells", "n"), "envoys")
    merged = _within(_with_sets(docs, envoys, size), percent).where("a <> b")
    labels = saved(connected_components(merged.union(labels.select("root", "node"))), "labels")
    large = large.drop("root").join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")  # single nodes have no label
    large = saved(large, "large-clusters")
    sizes = large.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("several")).where("several > 1").select("cluster", "main")
    large = saved(large.join(main, "cluster"), "large-clusters")
    far = large.where("label <> main")
    chunks = far.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CELL_NODES), F.ceil(F.sum("n") / CELL_ELEMENTS)).alias("chunks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    far = _dealt(far, chunks, "chunks", "chunk", 2).withColumn("cell", upto("cells"))
    near = large.join(chunks, "cluster").withColumn("chunk", upto("chunks"))
    cols = ["row_id", "node", "cluster", "cell", "chunk", "label"]
    meeting = saved(near.select(*cols, F.lit(True).alias("near")).union(far.select(*cols, F.lit(False).alias("near"))), "meeting")
    return saved(connected_components(_between(_with_sets(docs, meeting, size), percent).union(labels.select("root", "node"))), "labels")


def _linked(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of the rows of docs (doc_id, text, more long columns), the nodes, and node and root of those in clusters."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is outside 50..100")
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.withColumn("row_id", F.coalesce("doc_id", F.xxhash64("text")))
    order = docs.sparkSession.sparkContext.broadcast(_Order(*_counts(docs, size), percent))
    rows = _signatures(docs.select("doc_id", "row_id", *own, "text"), order, size)
    first = [F.first(c).alias(c) for c in ("n", "grp", "parity", "tokens", "places")]
    holder = saved(rows.where("n > 0").groupBy("node").agg(F.min("row_id").alias("row_id"), F.min("doc_id").alias("doc_id"), *first), "nodes")
    return rows, holder, _labels(docs, holder, _clusters(holder, percent), percent, size)


def components(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and
    set_id (equal for equal sets) of every row. docs is read several times.

    Two rows link when 100 |intersection| >= percent |union| of their shingle sets. A text that is
    null or has no words has an empty set, no links and its own doc_id as component_id. Rows may
    repeat. A null doc_id links as any other, but is a component_id only where no other is reached.
    An empty table gives no rows."""
    rows, holder, labels = _linked(texts(docs), percent, size)
    named = holder.select("node", F.col("doc_id").alias("least")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    rows = rows.select("doc_id", "n", "node")
    found = rows.where("n > 0").join(named, "node").select("doc_id", "n", "node", F.coalesce("component", "doc_id").alias("component"))
    return found.union(rows.where("n = 0").select("doc_id", "n", "node", "doc_id")).toDF("doc_id", "n_shingles", "set_id", "component_id")


def representatives(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """docs, all columns kept, with one row of each group of linked ones: that with the smallest
    doc_id, a null one last, then the first row. Rows without words are in no group and all kept.

    Rows are told apart by a digest of all columns, so that docs needs no copy with row numbers; equal
    rows are thinned to one at the end. Columns with maps have no digest and count as equal."""
    ident, key = "__component_id", "__component_key"
    plain = [F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    marked = docs.withColumn(ident, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(*(x for c in plain for x in (c.isNull(), c))))
    bound_batches(docs.sparkSession)
    narrow = marked.select(F.col(ident).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("place"))
    rows, _, labels = _linked(narrow, percent, size)
    each = rows.where("n > 0").select("doc_id", "key", "place", "node")
    each = each.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = each.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("best")).where("n > 1")
    inside = each.join(groups, "root").select("doc_id", "key", (F.col("place") == F.col("best.place")).alias("kept"))
    marks = inside.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).where("not kept or copies > 1")
    marks = saved(marks.select(F.col("doc_id").alias("__mark_id"), F.col("key").alias("__mark_key"), "kept"), "marks")
    same = F.col(ident).eqNullSafe(F.col("__mark_id")) & (F.col(key) == F.col("__mark_key"))
    if marks.count() <= FEW_MARKS:
        marks = F.broadcast(marks)
    out, twins = marked.join(marks.drop("kept"), same, "left_anti"), marks.where("kept").drop("kept")
    if not twins.isEmpty():
        out = out.unionByName(marked.join(twins, same, "left_semi").dropDuplicates([ident, key]))
    return out.drop(ident, key)
