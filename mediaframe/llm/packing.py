"""Best-fit packing of token sequences by exact complements.

The plan is made on the histogram of piece lengths, which has at most as many entries as a
sequence has tokens, whatever the size of the corpus. Lengths are taken from the longest;
each gap is filled exactly by one, two or three lengths whose sum is indexed (bit sets of the
lengths that are still available), as often as their counts allow; what has no exact
complement is placed best-fit, longest first. A plan entry says: the pieces of one length
with ranks lo to lo + n - 1 go to sequences first, first + 1, ... at one offset.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.llm.common import saved, texts, trim
from mediaframe.llm.tokens import slices, words


#: Counts by length and task that are sent to all tasks; more are joined by a shuffle of the pieces.
FEW_COUNTS = 1_000_000


class _Available:
    """Counts by length, with bit sets for lengths and their mirror images."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.c, self.capacity, self.bits, self.mirror = [0] * (capacity + 1), capacity, 0, 0
        for n, k in counts.items():
            self.c[n] = k
            if k:
                self.bits |= 1 << n
                self.mirror |= 1 << (capacity - n)

    def use(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.c[n] -= times
            if not self.c[n]:
                self.bits &= ~(1 << n)
                self.mirror &= ~(1 << (self.capacity - n))

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.c[n] // k for n, k in Counter(lengths).items())

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Available (a, b), a >= b >= 1, a + b = total, largest a first."""
        both = self.bits & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1)
        both &= ~((1 << ((total + 1) // 2)) - 1)
        while both:
            a = both.bit_length() - 1
            yield a, total - a
            both &= ~(1 << a)

    def complement(self, first: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that with first fill a sequence."""
        gap = self.capacity - first
        if not gap:
            return ()
        if self.times((first, gap)):
            return (gap,)
        for pair in self.pairs(gap):
            if self.times((first, *pair)):
                return pair
        left = self.bits & ((1 << max(0, gap - 1)) - 1) & ~1
        while left:
            a = left.bit_length() - 1
            if 3 * a < gap:
                return None
            for b, c in self.pairs(gap - a):
                if b <= a and self.times((first, a, b, c)):
                    return a, b, c
            left &= ~(1 << a)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, how many such sequences) for pieces counted by length."""
    if any(n < 1 or n > capacity for n, k in counts.items() if k):
        raise ValueError("a length is outside 1..capacity")
    have, made = _Available(counts, capacity), []
    for first in range(capacity, 0, -1):
        while have.c[first] and (rest := have.complement(first)) is not None:
            lengths = (first, *rest)
            n = have.times(lengths)
            have.use(lengths, n)
            made.append((lengths, n))
    groups: dict[int, list[list]] = defaultdict(list)  # open sequences by gap, alike ones together
    open_gaps = 0
    for n in range(capacity, 0, -1):
        left = have.c[n]
        while left:
            fits = open_gaps >> n
            if fits:
                gap = n + (fits & -fits).bit_length() - 1
                lengths, k = groups[gap].pop()
                use = min(k, left)
                if k > use:
                    groups[gap].append([lengths, k - use])
                if not groups[gap]:
                    open_gaps &= ~(1 << gap)
                new = [((*lengths, n), use)]
                left -= use
            else:
                q = capacity // n
                new = [((n,) * q, left // q), ((n,) * (left % q), 1)]
                left = 0
            for lengths, k in new:
                if k and lengths:
                    gap = capacity - sum(lengths)
                    groups[gap].append([lengths, k])
                    open_gaps |= 1 << gap
    return made + [(lengths, k) for group in groups.values() for lengths, k in group]


def _entries(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Arrays length, lo, first sequence, offset; sorted by length and lo."""
    used, rows, first = Counter(), [], 0
    for lengths, n in made:
        at = 0
        for x in lengths:
            rows.append((x, used[x], first, at))
            used[x] += n
            at += x
        first += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


_PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, task int, nth long"


def cut(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The documents' pieces, saved in the shared folder: doc_id, piece, start, length, ids
    (little-endian unsigned 32-bit), ids_crc32, and task and nth, which number the pieces of a
    length. Only documents of more than capacity ids, the end id included, are cut. A null
    text is an empty one: the end id alone."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tok, seen = TaskContext.get().partitionId(), words(tokenizer), Counter()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for batch in batches:
            for part in slices(batch):
                ids, cuts = tok.encode_ended(part.column(1), end_id)
                data, rows = memoryview(ids.tobytes()), []
                for i, a, b in zip(part.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    for k, lo in enumerate(range(a, b, capacity)):
                        n = min(capacity, b - lo)
                        piece = data[4 * lo : 4 * (lo + n)]
                        rows.append((i, k, lo - a, n, piece, zlib.crc32(piece), task, seen[n]))
                        seen[n] += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        trim()

    return saved(texts(docs).mapInArrow(tokenize, _PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces of cut() with sequence_id and offset. Sequences hold at most capacity ids,
    without gaps; ties between pieces of one length go by task and place in it. An empty
    table gives no rows."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    length, lo, first, offset = _entries(plan(counts, capacity))
    most = int(max(counts.values(), default=0)) + 1
    starts = length * most + lo

    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, n.to_numpy(np.int64) * most + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + rank.to_numpy(np.int64) - lo[at], "offset": offset[at]})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = saved(per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-counts")
    if per_task.count() <= FEW_COUNTS:  # then the ids needn't move
        per_task = F.broadcast(per_task)
    ranked = pieces.join(per_task, ["length", "task"]).withColumn("at", placed("length", F.col("before") + F.col("nth")))
    return ranked.select(*(c for c in pieces.columns if c not in ("task", "nth")), F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids and ids (little-endian unsigned 32-bit) of the packed sequences; a group has at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_ids"))
    return grouped.select("sequence_id", "n_ids", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
