"""Media columns on DataFrames: bytes to AVI, AVI to payload and timed clips."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm import media_avi as avi
from mediaframe.llm.common import texts
from mediaframe.llm.tokens import in_slices


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + b"\0" * (-len(data) % unit if data else unit)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (AVI holding the text's UTF-8 bytes, padded to a positive multiple of 64). A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, text in in_slices(batch):
                raw = [(t or "").encode() for t in text]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([avi.store(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(table: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: the id, clip, first_frame, n_frames, start_ms, end_ms. Where a frame is empty or broken the one before stays. Null media, bytes that are no AVI file and files of which no frame can be decoded give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, media in in_slices(batch):
                rows = []
                for i, m in zip(ids, media, strict=True):
                    try:
                        rows += [(i, *c) for c in avi.clips_of(m)] if m else []
                    except ValueError:
                        continue
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "clip", "first_frame", "n_frames", "start_ms", "end_ms"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, clip int, first_frame int, n_frames int, start_ms double, end_ms double").withColumnRenamed("id", id_col)


def features(table: DataFrame) -> DataFrame:
    """From stored()'s rows: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and feature: frames, then the first frame and the milliseconds of each shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for ids, sizes, media in in_slices(batch):
                rows = []
                for i, n, m in zip(ids, sizes, media, strict=True):
                    found = avi.parse(m)
                    luma = avi.luma_dc(found["frames"])
                    payload = luma.tobytes()[: int(found["comment"].removeprefix(b"payload_bytes="))]
                    begins = avi.shots(luma)
                    shot = ",".join(f"{a}@{1000 * a / found['rate']:.0f}" for a in begins)
                    rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"frames={len(luma)};shots={shot}"))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return table.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
