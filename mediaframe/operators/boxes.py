"""Tree-shaped containers as tables of nodes.

A small walker reads only the headers of boxes, chunks, pages, tags and packets and gives a row
for each: path, node, parent, depth, kind, offset of the payload, size. Payloads are then cut
from the content and decoded by native expressions, joined and aggregated as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.bits import be, part

# Boxes, lists and elements that hold others.
BOXES = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"edts", b"meta", b"ilst"} | {b"\xa9" + name for name in (b"nam", b"ART", b"alb", b"day", b"gen", b"cmt", b"too", b"wrt")}
ELEMENTS = {0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x55B0, 0x1F43B675, 0xA0, 0x1043A770, 0x45B9, 0xB6, 0x80, 0x1941A469, 0x61A7, 0x1254C367, 0x7373, 0x67C8}
# Elements of the top, and of the level below the segment, before which an element of unknown size ends.
EBML_TOP = {0x1A45DFA3, 0x18538067}
EBML_SECTIONS = EBML_TOP | {0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1043A770, 0x1941A469, 0x1254C367}
# The header object of ASF, and bytes of AMR frames by mode, narrow and wide band; other modes have one.
ASF_HEADER = bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C")
AMR_NB = (13, 14, 16, 18, 20, 21, 27, 32, 6)
AMR_WB = (18, 24, 33, 37, 41, 47, 51, 59, 61, 6)


def _isobmff(data: bytes, lo: int, hi: int):
    while lo + 8 <= hi:
        size, kind, head = int.from_bytes(data[lo : lo + 4], "big"), data[lo + 4 : lo + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
        size = hi - lo if size == 0 else size
        if size < head:
            return
        end = min(hi, lo + size)
        yield kind.decode("latin-1"), lo + head + 4 * (kind == b"meta"), end, kind in BOXES
        lo += size


def _riff(data: bytes, lo: int, hi: int):
    while lo + 8 <= hi:
        kind, size = data[lo : lo + 4], int.from_bytes(data[lo + 4 : lo + 8], "little")
        at, end = lo + 8, min(hi, lo + 8 + size)
        holds = kind in (b"RIFF", b"LIST", b"RF64")
        name = kind.decode("latin-1") + (":" + data[at : at + 4].decode("latin-1") if holds else "")
        yield name, at + 4 * holds, end, holds
        lo += 8 + size + (size & 1)


def _number(data: bytes, at: int, keep: bool) -> tuple[int | None, int]:
    if at >= len(data) or not data[at]:
        return None, 0
    width = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep else value & ((1 << 7 * width) - 1)), width


def _unknown_end(data: bytes, ident: int, lo: int, hi: int) -> int:
    """Where an element of unknown size ends: before the next one that can't lie in it, or with its parent."""
    ends = EBML_TOP if ident == 0x18538067 else EBML_SECTIONS
    while ident in ELEMENTS and lo < hi:
        child, n = _number(data, lo, True)
        size, m = _number(data, lo + n, False)
        if child is None or size is None:
            break
        if child in ends:
            return lo
        if size == (1 << 7 * m) - 1:
            if child not in ELEMENTS:
                break
            lo += n + m
        else:
            lo += n + m + size
    return hi


def _ebml(data: bytes, lo: int, hi: int):
    """Reads identifiers and sizes as _number() does, which would be called twice for each element."""
    total, number = len(data), int.from_bytes
    while lo < hi:
        if lo >= total or not (first := data[lo]):
            return
        at = lo + 9 - first.bit_length()
        if at >= total or not (width := data[at]):
            return
        m = 9 - width.bit_length()
        ident, most = number(data[lo:at], "big"), (1 << 7 * m) - 1
        size, at = number(data[at : at + m], "big") & most, at + m
        end = _unknown_end(data, ident, at, hi) if size == most else min(hi, at + size)
        yield f"{ident:X}", at, end, ident in ELEMENTS
        lo = end


def _ogg(data: bytes, lo: int, hi: int):
    while lo + 27 <= hi and data[lo : lo + 4] == b"OggS":
        n = data[lo + 26]
        at = lo + 27 + n
        end = at + sum(data[lo + 27 : at])
        yield str(int.from_bytes(data[lo + 6 : lo + 14], "little", signed=True)), at, min(hi, end), False
        lo = end


def _flv(data: bytes, lo: int, hi: int):
    lo = int.from_bytes(data[5:9], "big") + 4
    while lo + 11 <= hi:
        size, stamp = int.from_bytes(data[lo + 1 : lo + 4], "big"), data[lo + 7] << 24 | int.from_bytes(data[lo + 4 : lo + 7], "big")
        yield f"{data[lo] & 31}:{stamp}", lo + 11, min(hi, lo + 11 + size), False
        lo += 15 + size


def _ts_packets(data: bytes, lo: int, hi: int) -> range:
    """Where packets of 188 bytes begin: end to end, or after the four bytes of time stamp that Blu-ray files put before each; told apart as detect_format() does."""
    sync = lambda at: data[lo + at : lo + at + 1] == b"\x47"
    plain = sync(0) and (hi - lo < 564 or (sync(188) and sync(376)))
    if not plain and hi - lo >= 576 and sync(4) and sync(196) and sync(388):
        return range(lo + 4, hi - 187, 192)
    return range(lo, hi - 187, 188)


def _ts(data: bytes, lo: int, hi: int):
    for at in _ts_packets(data, lo, hi):
        if data[at] == 0x47:
            yield str(int.from_bytes(data[at + 1 : at + 3], "big") & 0x1FFF), at, at + 188, False


def _pmt(data: bytes, lo: int, hi: int):
    """Elementary streams as pid:type, from program maps that fit a packet; the payload is their descriptors."""
    maps = set()
    for at in _ts_packets(data, lo, hi):
        pid = int.from_bytes(data[at + 1 : at + 3], "big") & 0x1FFF
        if data[at] != 0x47 or not data[at + 1] & 0x40 or (pid and pid not in maps):
            continue
        at += 4 + (1 + data[at + 4] if data[at + 3] & 0x20 else 0)
        at += 1 + data[at] if at < hi else 0
        size = int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF
        end = min(at + 3 + size - 4, hi)
        if pid == 0:
            maps |= {int.from_bytes(data[k + 2 : k + 4], "big") & 0x1FFF for k in range(at + 8, end - 3, 4) if data[k : k + 2] != b"\0\0"}
            continue
        at += 12 + (int.from_bytes(data[at + 10 : at + 12], "big") & 0xFFF)
        while at + 5 <= end:
            stream, more = int.from_bytes(data[at + 1 : at + 3], "big") & 0x1FFF, int.from_bytes(data[at + 3 : at + 5], "big") & 0xFFF
            yield f"{stream}:{data[at]}", at + 5, min(end, at + 5 + more), False
            at += 5 + more


def _ps(data: bytes, lo: int, hi: int):
    """Pack headers (BA) and PES packets by stream id in hex; other start codes are passed over."""
    lo = data.find(b"\0\0\1", lo, hi)
    while 0 <= lo and lo + 6 <= hi:
        code, size = data[lo + 3], int.from_bytes(data[lo + 4 : lo + 6], "big")
        end = lo + 4
        if code == 0xBA:
            yield "BA", lo + 4, min(hi, lo + 14), False
        elif 0xC0 <= code <= 0xEF or code in (0xBD, 0xFD):
            end = min(hi, lo + 6 + size)
            yield f"{code:X}", lo + 6, end, False
        elif code in (0xBB, 0xBC, 0xBE, 0xBF):
            end = min(hi, lo + 6 + size)
        lo = data.find(b"\0\0\1", end, hi)


def _asf(data: bytes, lo: int, hi: int):
    while lo + 24 <= hi:
        kind, size = data[lo : lo + 16], int.from_bytes(data[lo + 16 : lo + 24], "little")
        if size < 24:
            return
        holds = kind == ASF_HEADER
        yield kind.hex().upper(), lo + 24 + 6 * holds, min(hi, lo + size), holds
        lo += size


def _klv(data: bytes, lo: int, hi: int):
    while lo + 17 <= hi:
        key, size, at = data[lo : lo + 16], data[lo + 16], lo + 17
        if size >= 128:
            size, at = int.from_bytes(data[at : at + size - 128], "big"), at + size - 128
        yield key.hex().upper(), at, min(hi, at + size), False
        lo = at + size


def _sup(data: bytes, lo: int, hi: int):
    """Segments of a graphic stream, as type:time stamp."""
    while lo + 13 <= hi:
        if data[lo : lo + 2] != b"PG":
            lo += 1
            continue
        end = lo + 13 + int.from_bytes(data[lo + 11 : lo + 13], "big")
        yield f"{data[lo + 10]}:{int.from_bytes(data[lo + 2 : lo + 6], 'big')}", lo + 13, min(hi, end), False
        lo = end


def _amr(data: bytes, lo: int, hi: int):
    """Frames by mode, with their first byte."""
    wide = data.startswith(b"#!AMR-WB\n")
    if not wide and not data.startswith(b"#!AMR\n"):
        return
    sizes, lo = (AMR_WB, 9) if wide else (AMR_NB, 6)
    while lo < hi:
        mode = data[lo] >> 3 & 15
        size = sizes[mode] if mode < len(sizes) else 1
        yield str(mode), lo, min(hi, lo + size), False
        lo += size


def _vorbis(data: bytes, lo: int, hi: int):
    """Comments by upper-case key; data starts at the vendor's length."""
    lo += 4 + int.from_bytes(data[lo : lo + 4], "little")
    count, lo = int.from_bytes(data[lo : lo + 4], "little"), lo + 4
    for _ in range(count):
        end = lo + 4 + int.from_bytes(data[lo : lo + 4], "little")
        if lo + 4 > hi or end > hi:
            return
        mark = data.find(b"=", lo + 4, end)
        if mark >= 0:
            yield data[lo + 4 : mark].decode("utf-8", "replace").upper(), mark + 1, end, False
        lo = end


def _ape(data: bytes, lo: int, hi: int):
    """Text items by lower-case key, found by the footer that ends the file or stands before 128 bytes of ID3v1."""
    foot = next((at for at in (hi - 32, hi - 160) if at >= lo and data[at : at + 8] == b"APETAGEX"), None)
    if foot is None:
        return
    size, count = int.from_bytes(data[foot + 12 : foot + 16], "little"), int.from_bytes(data[foot + 16 : foot + 20], "little")
    lo = foot + 32 - size
    if not 32 <= size <= 10 << 20 or lo < 0:
        return
    for _ in range(count):
        mark = data.find(b"\0", lo + 8, foot)
        end = mark + 1 + int.from_bytes(data[lo : lo + 4], "little")
        if mark < 0 or end > foot:
            return
        if int.from_bytes(data[lo + 4 : lo + 8], "little") & 6 != 2:
            yield data[lo + 8 : mark].decode("utf-8", "replace").lower(), mark + 1, end, False
        lo = end


def _id3v2(data: bytes, lo: int, hi: int):
    """Frames by id; versions 2 to 4."""
    seven = lambda at: sum((b & 127) << 21 - 7 * k for k, b in enumerate(data[at : at + 4]))
    if data[lo : lo + 3] != b"ID3" or hi < lo + 10:
        return
    version, hi = data[lo + 3], min(hi, lo + 10 + seven(lo + 6))
    name, head = (3, 6) if version == 2 else (4, 10)
    more = lo + 10
    if data[lo + 5] & 0x40 and version > 2:
        more += seven(more) if version == 4 else 4 + int.from_bytes(data[more : more + 4], "big")
    while more + head <= hi and data[more]:
        size = int.from_bytes(data[more + 3 : more + 6], "big") if version == 2 else seven(more + 4) if version == 4 else int.from_bytes(data[more + 4 : more + 8], "big")
        yield data[more : more + name].decode("latin-1"), more + head, min(hi, more + head + size), False
        more += head + size


WALKERS = {
    "isobmff": _isobmff, "riff": _riff, "ebml": _ebml, "ogg": _ogg, "flv": _flv, "ts": _ts, "pmt": _pmt, "ps": _ps, "asf": _asf, "klv": _klv,
    "sup": _sup, "amr": _amr, "vorbis": _vorbis, "ape": _ape, "id3v2": _id3v2,
}


def _visit(kind: str, data: bytes, most_depth: int, within: str | None = None) -> Iterator[tuple]:
    """node, parent, depth, name, at, size and whether it holds others, in file order. within: the EBML element in which all that is
    wanted lies; what has no such bytes in it holds none and isn't entered, and its nodes are not counted."""
    walk, count, sign = WALKERS[kind], 0, within and bytes.fromhex(within)
    todo = [(walk(data, 0, len(data)), None, 0, not within)]
    while todo:
        rows, parent, depth, inside = todo[-1]
        row = next(rows, None)
        if row is None:
            todo.pop()
            continue
        name, at, end, holds = row
        yield count, parent, depth, name, at, max(0, end - at), holds
        if holds and depth < most_depth:
            inside = inside or name == within
            if inside or data.find(sign, at, end) >= 0:
                todo.append((walk(data, at, end), count, depth + 1, inside))
        count += 1


def nodes(files: DataFrame, kind: str, key: str = "path", content: str = "content", most_depth: int = 8) -> DataFrame:
    """key, node (from 0, in file order), parent (null at the top), depth, kind, at, size. Broken files give the nodes before the fault; null contents none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            rows = [(k, *n[:6]) for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) if data is not None for n in _visit(kind, data, most_depth)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "node", "parent", "depth", "kind", "at", "size"])

    return files.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, node int, parent int, depth int, kind string, at bigint, size bigint")


def cut(files: DataFrame, kind: str, kinds: Collection[str] | Callable[[str], bool] | None = None, owner: str | None = None, most: int | None = None, key: str = "path", content: str = "content", most_depth: int = 8, within: bool = False) -> DataFrame:
    """Nodes of the given kinds (a collection or a test; none given: all) as nodes() has them, with
    payload, whole or its first `most` bytes, and two ways up: holder, the parent's kind, and owner, the nearest node of kind `owner` among a
    node and its ancestors. The content is read once and is not moved. within (EBML): only nodes that have an owner; parts of a file
    that can't hold one are passed over, so that numbers of nodes have the file's order, and are not those of nodes()."""
    wanted = kinds if kinds is None or callable(kinds) else frozenset(kinds).__contains__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        names = ["path", "node", "parent", "depth", "kind", "at", "size", "holder", "owner", "payload"]
        pack = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            rows, held = [], 0
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                above: dict[int | None, tuple] = {None: (None, None)}  # of nodes that hold others: kind, owner
                for node, parent, depth, name, at, size, holds in _visit(kind, data or b"", most_depth, owner if within else None):
                    holder, own = above[parent]
                    own = node if name == owner else own
                    if holds:
                        above[node] = name, own
                    if (wanted is None or wanted(name)) and (own is not None or not within):
                        payload = data[at : at + (size if most is None else min(size, most))]
                        rows.append((path, node, parent, depth, name, at, size, holder, own, payload))
                        held += len(payload) + 100
                        if held > 16 << 20:
                            yield pack(rows)
                            rows, held = [], 0
            if rows:
                yield pack(rows)

    schema = "path string, node int, parent int, depth int, kind string, at bigint, size bigint, holder string, owner int, payload binary"
    return files.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def movie_headers(files: DataFrame) -> DataFrame:
    """path, timescale, duration_ms from the mvhd box of ISO files."""
    found = cut(files, "isobmff", {"mvhd"}, most=40)
    p = F.col("payload")
    long = be(p, 0, 1) == 1
    scale, units = F.when(long, be(p, 20, 4)).otherwise(be(p, 12, 4)), F.when(long, be(p, 24, 8)).otherwise(be(p, 16, 4))
    return found.select("path", scale.alias("timescale"), F.when(scale > 0, units.cast("double") / scale * 1000.0).alias("duration_ms"))


#: Entries of a table that are cut out together, so that exploding doesn't copy the table for each entry.
ENTRIES = 1024


def sample_rates(files: DataFrame) -> DataFrame:
    """path, samples, units, deltas and mode from the stts tables of ISO files: sums and distinct counts over their exploded entries."""
    found = cut(files, "isobmff", {"stts"})
    p = F.col("payload")
    count = F.least(be(p, 4, 4), F.floor((F.length(p) - 8) / 8))  # a table cut short has fewer entries than it says
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    blocks = F.transform(numbers(F.ceil(count / ENTRIES)), lambda k: part(p, 8 + 8 * ENTRIES * k, 8 * F.least(count - ENTRIES * k, F.lit(ENTRIES))))
    each = found.where(be(p, 4, 4) > 0).select("path", F.explode_outer(blocks).alias("block"))
    number = lambda at: F.conv(F.hex(part(F.col("block"), at, 4)), 16, 10).cast("bigint")
    entry = F.transform(numbers(F.floor(F.length("block") / 8)), lambda k: F.struct(number(8 * k).alias("n"), number(8 * k + 4).alias("delta")))
    entries = each.select("path", F.explode_outer(entry).alias("e")).select("path", "e.n", "e.delta")
    out = entries.groupBy("path").agg(F.sum("n").alias("samples"), F.sum(F.col("n") * F.col("delta")).alias("units"), F.countDistinct(F.when(F.col("delta") != 0, F.col("delta"))).alias("deltas"))
    return out.withColumn("mode", F.when(F.col("deltas") > 1, "Variable").otherwise("Constant"))


def kind_sizes(files: DataFrame, container: str) -> DataFrame:
    """path, kind, n and bytes: the sum of payloads of each kind of node (packets of a PID, chunks of a name)."""
    return nodes(files, container).groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
