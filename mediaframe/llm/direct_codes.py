"""Token ids as directly addressable codes.

Each id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level 1
the next chunk of those ids that have one, and so on. A bitmap per level tells which
entries go on, and a directory of ranks (ones before each block of 512 bits) finds an
entry's place in the next level, so any id is read without decoding others.

A file is a Parquet table of segments without compression or dictionaries, so that codes lie
in it as they are; a row holds the documents of a segment, in ascending doc_id order, and its codes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import saved, shuffle_partitions, texts
from mediaframe.llm.tokens import slices, words

MAGIC, BLOCK = b"DAC1", 512
#: A segment ends with the slice of rows in which it reaches so many ids.
SEGMENT_IDS = 1_000_000
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    ids, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = ids > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = _ONES[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.cumsum(ones, dtype=np.uint32) - ones
        levels.append((len(ids), (ids & 255).astype(np.uint8), bits, ranks))
        if not more.any():
            break
        ids = ids[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(chunks.tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes() for _, chunks, bits, ranks in levels)


class Codes:
    """Reads ids at any place from encode()'s bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels = struct.unpack_from("<I", data, 4)[0]
        sizes = struct.unpack_from(f"<{n_levels}Q", data, 8)
        at, self.levels = 8 + 8 * n_levels, []
        for n in sizes:
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= len(self)):
            raise IndexError("no such token")
        out, who = np.zeros(len(places), np.uint32), np.arange(len(places))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(who):
                break
            out[who] |= chunks[places].astype(np.uint32) << np.uint32(8 * k)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            who, places = who[on], places[on]
            block = places // BLOCK
            within = _ONES[bits.reshape(-1, BLOCK // 8)[block]] * (np.arange(BLOCK // 8) < ((places % BLOCK) >> 3)[:, None])
            last = _ONES[bits[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8)]
            places = ranks[block].astype(np.int64) + within.sum(axis=1, dtype=np.int64) + last
        return out

    def part(self, start: int, length: int) -> np.ndarray:
        """A run of ids: the directory is asked once a level, for the start."""
        if start < 0 or length < 0 or start + length > len(self):
            raise IndexError("no such tokens")
        out, who = np.zeros(length, np.uint32), slice(None)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if not length:
                break
            got = chunks[start : start + length].astype(np.uint32) << np.uint32(8 * k)
            if k:
                out[who] |= got
            else:
                out[:] = got
            first = start >> 3
            on = np.unpackbits(bits[first : (start + length + 7) >> 3], bitorder="little")[start & 7 :][:length].astype(bool)
            who = np.flatnonzero(on) if k == 0 else who[on]
            if not len(who):
                break
            block = start // BLOCK
            before = int(_ONES[bits[block * BLOCK // 8 : first]].sum()) + int(_ONES[bits[first] & ((1 << (start & 7)) - 1)])
            start, length = int(ranks[block]) + before, len(who)
        return out


_SEGMENTS = "part int, segment int, before long, doc_ids array<bigint>, lengths array<bigint>, codes binary"


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS, path: str | None = None) -> DataFrame:
    """Writes the ids of all texts, each followed by end_id, in ascending doc_id order, to path, or,
    without one, to the shared folder, and returns the table of segments: part (a range of doc_ids), segment in it,
    before (ids of the part before the segment), doc_ids, lengths, codes.

    A null text is an empty one: end_id alone. A null doc_id comes first. Rows that repeat a
    doc_id stand side by side, in any order. An empty table gives no segments.
    """
    if end_id < 0:
        raise ValueError("end_id is negative")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tok = TaskContext.get().partitionId(), words(tokenizer)
        held, doc_ids, lengths, size, segment, before = [], [], [], 0, 0, 0

        def flush():
            codes = encode(np.concatenate(held))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([codes], pa.binary())], names=["part", "segment", "before", "doc_ids", "lengths", "codes"])

        for batch in batches:
            for rows in slices(batch):
                ids, cuts = tok.encode_ended(rows.column(1), end_id)
                held.append(ids)
                doc_ids += rows.column(0).to_pylist()
                lengths += np.diff(cuts).tolist()
                size += len(ids)
                if size >= segment_ids:
                    yield flush()
                    held, doc_ids, lengths, size, segment, before = [], [], [], 0, segment + 1, before + size
        if doc_ids:
            yield flush()

    dealt = texts(docs).repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id")).sortWithinPartitions("doc_id")
    written = dealt.mapInArrow(write, _SEGMENTS)
    plain = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
    if path is None:
        return saved(written, "token-codes", **plain)
    written.write.options(**plain).parquet(path)
    return docs.sparkSession.read.schema(_SEGMENTS).parquet(path)


def starts(segments: DataFrame) -> DataFrame:
    """part and first: the ids before each range part. One total for each part goes to the driver; there are as many as partitions."""
    totals = segments.groupBy("part").agg(F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    at, found = 0, []
    for part, n in totals:
        found.append((part, at))
        at += n
    return segments.sparkSession.createDataFrame(found, "part int, first long")


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """place and id of the tokens at places (a column place, counted over the whole corpus from 0), each
    read from its codes by its levels' directories, no others decoded. Places outside give no rows;
    repeated ones give repeated rows. Places are joined to segments by their range of a coarse grid."""
    grid = 1 << 20
    base = segments.join(F.broadcast(starts(segments)), "part").select((F.col("first") + F.col("before")).alias("lo"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), "codes")
    dealt = base.where("n > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / grid), F.floor((F.col("lo") + F.col("n") - 1) / grid))))
    asked = places.select(F.col("place").cast("long").alias("place")).where("place >= 0").groupBy(F.floor(F.col("place") / grid).alias("cell"), F.pmod(F.xxhash64("place"), F.lit(16)).alias("deal")).agg(F.collect_list("place").alias("places"))
    met = dealt.join(asked, "cell").select("lo", "n", "codes", "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.array(wanted, np.int64) - lo
                at = at[(at >= 0) & (at < n)]
                yield pa.record_batch([pa.array(at + lo, pa.int64()), pa.array(Codes(data).at(at).astype(np.int64), pa.int64())], names=["place", "id"])

    return met.mapInArrow(read, "place long, id long")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the ids
    as little-endian 32-bit), read from the segments. The only thing sent to the driver and
    broadcast is one total for each range part, of which there are as many as partitions."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, ids, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, at, rows = Codes(data), 0, []
                for i, n in zip(ids, lengths, strict=True):
                    rows.append((i, base + at, n, zlib.crc32(codes.part(at, n).astype("<u4").tobytes())))
                    at += n
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(starts(segments)), "part").select((F.col("first") + F.col("before")).alias("base"), "doc_ids", "lengths", "codes")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id and ids (array<bigint>) of every document, from the segments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, at = Codes(data), 0
                for i, n in zip(ids, lengths, strict=True):
                    yield pa.record_batch([pa.array([i], pa.int64()), pa.array([codes.part(at, n).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])
                    at += n

    return segments.select("doc_ids", "lengths", "codes").mapInArrow(read, "doc_id long, ids array<bigint>")
