"""One pass over files of every format: headers are read where the content lies, and each gives a typed row.

A walker skips from header to header. It gives short payloads, which native expressions decode
(operators/facts.py), and counts what occurs millions of times in a file (packets, blocks, samples) as it goes, so a file gives
few rows, whatever its size. Parameter sets are read for all files of a batch at once.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import bitstreams, sps
from mediaframe.functions.detect import detect_format
from mediaframe.functions.lookups import LAYOUTS
from mediaframe.operators.boxes import _number, _ts_packets, _visit

#: Bytes of a file's head for formats with fixed headers; texts and DTS are looked at whole.
HEAD = 1 << 16
WHOLE = {"SRT", "WebVTT", "ASS", "DTS"}
#: Bytes of a track's first payload that are kept for the probe of its codec, and of a header's payload.
PROBE, PAYLOAD = 8192, 1 << 16
#: path, format and length of the file; track (of the file, -1 for the file itself), node (in the file's order), kind, name, two numbers, the codes of a parameter set, payload.
SCHEMA = "path string, format string, length bigint, track bigint, node bigint, kind string, name string, a bigint, b bigint, codes array<double>, payload binary"
Row = tuple  # track, kind, name, a, b, payload

# What follows the fixed fields of a video entry, and of a sound entry by its version; boxes in them that are read.
VIDEO_ENTRY, SOUND_ENTRY = 78, {0: 28, 1: 44, 2: 64}
IN_ENTRY = {b"avcC", b"hvcC", b"av1C", b"vpcC", b"esds", b"dac3", b"dec3", b"dOps", b"dfLa", b"alac", b"colr", b"pasp", b"dvcC", b"dvvC"}
ISO = {"ftyp", "mvhd", "tkhd", "mdhd", "hdlr"}
MATROSKA = {
    "AE": {"D7", "83", "86", "22B59C", "536E", "B0", "BA", "B5", "9F", "6264", "23E383", "88", "55AA", "54B0", "54BA", "54B2", "9A", "9D", "55B1", "55B9", "55BA", "55BB", "55BC", "55BD", "63A2"},
    "B6": {"91", "85"}, None: {"4282", "2AD7B1", "4489", "7BA9", "4D80", "5741"},
}
# How codecs of Matroska begin, and which reader their private data and first blocks go to.
GATES = {
    "V_MPEG4/ISO/AVC": "avc", "V_MPEGH/ISO/HEVC": "hevc", "V_AV1": "av1", "V_VP9": "vp9", "V_MPEG2": "mpeg", "V_MPEG1": "mpeg", "V_FFV1": "ffv1", "V_PRORES": "prores", "V_MS/VFW/FOURCC": "vfw", "V_THEORA": "theora", "A_AAC": "aac", "A_AC3": "ac3",
    "A_EAC3": "eac3", "A_DTS": "dts", "A_TRUEHD": "truehd", "A_MLP": "truehd", "A_FLAC": "flac", "A_OPUS": "opus", "A_ALAC": "alac", "A_MPEG/": "mpa",
}
TS_GATES = {0x1B: "avc", 0x24: "hevc", 0x01: "mpeg", 0x02: "mpeg", 0x10: "visual", 0x0F: "adts", 0x11: "adts", 0x03: "mpa", 0x04: "mpa", 0x81: "ac3", 0x87: "ac3", 0x82: "dts", 0x85: "dts", 0x86: "dts"}
# Names of ASF objects by their identifiers.
ASF = {
    "A1DCAB8C47A9CF118EE400C00C205365": "file", "9107DCB7B7A9CF118EE600C00C205365": "stream", "3326B2758E66CF11A6D900AA0062CE6C": "content", "40A4D0D207E3D21197F000A0C95EA850": "more", "CE75F87B8D46D1118D82006097C9A2B2": "rates",
    "CBA5E61472C632438399A96952065B5A": "extended", "B503BF5F2EA9CF118EE300C00C205365": "extension",
}
ASF_DATA = bytes.fromhex("3626B2758E66CF11A6D900AA0062CE6C")
# The last bytes of the keys of MXF sets, and the label that stands for a bit rate in the primer.
MXF_SETS = {"01012800": "video", "01012900": "video", "01015100": "video", "01014800": "sound", "01014200": "sound", "01014700": "sound", "01013000": "ident", "01013B00": "track", "01011100": "clip"}
MXF_BIT_RATE = bytes.fromhex("060E2B34010101050401060201")
MXF_PRIMER, MXF_PARTITION, MXF_ESSENCE = (bytes.fromhex(x) for x in ("060E2B34020501010D01020101050100", "060E2B34020501010D01020101", "060E2B34010201010D010301"))


def u(data: bytes, at: int, n: int, order: str = "big") -> int:
    """n bytes as a number; beyond the end an IndexError."""
    if at + n > len(data) or at < 0:
        raise IndexError(at)
    return int.from_bytes(data[at : at + n], order)


def le(data: bytes, at: int, n: int) -> int:
    return u(data, at, n, "little")


# Parameter sets within the bytes of a track ----------------------------------------------------------------------------


def nal_units(data: bytes) -> Iterator[bytes]:
    """Units between start codes of three bytes."""
    at = data.find(b"\0\0\1")
    while at >= 0:
        following = data.find(b"\0\0\1", at + 3)
        yield data[at + 3 : following if following >= 0 else len(data)]
        at = following


def first_set(group: str, data: bytes) -> bytes | None:
    """The first sequence parameter set among units with start codes."""
    wanted = {"avc": lambda x: x[0] & 31 == 7, "hevc": lambda x: x[0] >> 1 & 63 == 33}[group]
    return next((x for x in nal_units(data) if x and wanted(x)), None)


def configured_set(group: str, data: bytes) -> bytes | None:
    """The sequence header within a configuration record."""
    if group == "av1":
        return data[4:] or None
    if group == "avc":
        n = int.from_bytes(data[6:8], "big")
        return data[8 : 8 + n] if n and len(data) >= 8 + n else None
    at = 23
    for _ in range(data[22] if len(data) > 22 else 0):
        kind, count, at = data[at] & 63 if at < len(data) else 0, int.from_bytes(data[at + 1 : at + 3], "big"), at + 3
        for _ in range(count):
            n = int.from_bytes(data[at : at + 2], "big")
            if at + 2 + n > len(data):
                return None
            if kind == 33:
                return data[at + 2 : at + 2 + n]
            at += 2 + n
    return None


def probed(track: int, group: str | None, private: bytes, first: bytes) -> Iterator[Row]:
    """What the codec gate routes of a track: only the reader of its own codec sees its bytes."""
    if group is None:
        return
    if private:
        yield track, "private", group, None, None, private[:PAYLOAD]
    if first:
        yield track, "first", group, None, None, first
    if group in ("avc", "hevc", "av1"):
        unit = (private and configured_set(group, private)) or (first if group == "av1" else first_set(group, first))
        if unit:
            yield track, f"sps.{group}", None, None, None, unit


# Containers: rows in the file's order --------------------------------------------------------------------------------------


def _children(data: bytes, lo: int, hi: int, track: int) -> Iterator[Row]:
    while lo + 8 <= hi:
        size, kind = u(data, lo, 4), data[lo + 4 : lo + 8]
        if size < 8:
            return
        end = min(hi, lo + size)
        if kind == b"wave":
            yield from _children(data, lo + 8, end, track)
        elif kind in IN_ENTRY:
            body = data[lo + 8 : end]
            yield track, "iso." + kind.decode(), None, None, None, body[:PAYLOAD]
            group = {b"avcC": "avc", b"hvcC": "hevc", b"av1C": "av1"}.get(kind)
            unit = configured_set(group, body) if group else None
            if unit:
                yield track, f"sps.{group}", None, None, None, unit
        lo += size


def _entry(data: bytes, lo: int, hi: int, track: int, handler: bytes) -> Iterator[Row]:
    """The first sample entry: its fixed fields, whose length goes by its kind and version, and the boxes after them."""
    end, body = min(hi, lo + u(data, lo, 4)), lo + 8
    yield track, "iso.entry", data[lo + 4 : lo + 8].decode("latin-1"), None, None, data[lo : min(end, lo + 144)]
    skip = VIDEO_ENTRY if handler == b"vide" else SOUND_ENTRY.get(u(data, body + 8, 2)) if handler == b"soun" else None
    if skip is not None:
        yield from _children(data, body + skip, end, track)


def iso(data: bytes) -> Iterator[Row]:
    owner: dict[int | None, int] = {None: -1}
    names: dict[int | None, str] = {None: ""}
    handler: dict[int, bytes] = {}
    chunk: dict[int, int] = {}
    coded: dict[int, bytes] = {}
    for node, parent, _, name, at, size, holds in _visit("isobmff", data, 1 << 20):
        track = node if name == "trak" else owner[parent]
        if holds:
            owner[node], names[node] = track, name
        end = at + size
        if name in ISO:
            if name == "hdlr":
                handler.setdefault(track, data[at + 8 : at + 12])
            yield track, "iso." + name, None, None, None, data[at : min(end, at + 4096)]
        elif name == "stsd" and size >= 16:
            coded[track] = data[at + 12 : at + 16]
            yield from _entry(data, at + 8, end, track, handler.get(track, b""))
        elif name == "stsz" and size >= 12:
            each, count = u(data, at + 4, 4), u(data, at + 8, 4)
            table = np.frombuffer(data, ">u4", min(count, (size - 12) // 4), at + 12)
            yield track, "iso.stsz", None, each * count if each else int(table.sum(dtype=np.uint64)), count, None
        elif name == "stts" and size >= 8:
            table = np.frombuffer(data, ">u4", 2 * min(u(data, at + 4, 4), (size - 8) // 8), at + 8).astype(np.int64).reshape(-1, 2)
            steps = np.unique(table[:, 1])
            yield track, "iso.stts", "Variable" if (steps > 0).sum() > 1 else "Constant", int(table[:, 0].sum()), int((table[:, 0] * table[:, 1]).sum()), None
        elif name in ("stco", "co64") and size >= 12 and u(data, at + 4, 4):
            chunk[track] = u(data, at + 8, 4 if name == "stco" else 8)
            yield track, "iso.chunks", None, chunk[track], u(data, at + 4, 4), None
        elif name == "data" and names[parent].startswith("\xa9") and size >= 8:
            yield -1, "iso.tag", names[parent][1:], u(data, at, 4), None, data[at + 8 : end]
    for track, at in chunk.items():
        if coded.get(track, b"")[:2] in (b"ap", b"cf", b"CF"):
            yield track, "first", "prores" if coded[track][:2] == b"ap" else "cineform", None, None, data[at : at + PROBE]


def matroska(data: bytes) -> Iterator[Row]:
    owner: dict[int | None, tuple] = {None: (None, None)}
    number, codec, private = {}, {}, defaultdict(bytes)
    total: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    first: dict[int, bytes] = {}
    for node, parent, _, name, at, size, holds in _visit("ebml", data, 1 << 20):
        kind, own = (name, node) if name in ("AE", "B6") else owner[parent]
        if holds:
            owner[node] = kind, own
        if name == "B6":
            yield node, "mkv.B6", None, None, None, None
        if name in ("A3", "A1"):
            track, n = _number(data, at, False)
            if track is not None and size > n + 3:
                total[track][0] += 1
                total[track][1] += size - n - 3
                if track not in first:
                    first[track] = data[at + n + 3 : at + min(size, n + 3 + PROBE)]
        elif name in MATROSKA.get(kind, ()):
            payload = data[at : at + min(size, PAYLOAD)]
            if name == "63A2":
                private[own] = payload
            elif name == "D7" and payload:
                number[int.from_bytes(payload, "big")] = own
            elif name == "86":
                codec[own] = payload.split(b"\0")[0].decode("latin-1")
            yield (-1 if kind is None else own), "mkv." + name, None, None, None, payload
    for track, own in number.items():
        group = next((g for start, g in GATES.items() if codec.get(own, "").startswith(start)), None)
        yield from probed(own, group, private[own], first.get(track, b""))
        if track in total:
            yield own, "mkv.sum", None, *total[track], None


def riff(data: bytes) -> Iterator[Row]:
    """Chunks in any order and of 64 bits: a size of all ones stands in the ds64 table."""
    wide: dict[bytes, list[int]] = defaultdict(list)

    def chunks(lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
        while lo + 8 <= hi:
            kind, size, at = data[lo : lo + 4], le(data, lo + 4, 4), lo + 8
            if kind == b"ds64" and size >= 28:
                wide[data[:4]], wide[b"data"] = [le(data, at, 8)], [le(data, at + 8, 8)]
                for k in range(min(le(data, at + 24, 4), (size - 28) // 12)):
                    wide[data[at + 28 + 12 * k : at + 32 + 12 * k]].append(le(data, at + 32 + 12 * k, 8))
            if size == 0xFFFFFFFF and wide[kind]:
                size = wide[kind].pop(0)
            yield kind, at, size
            lo = at + size + (size & 1)

    def lists(lo: int, hi: int, stream: int, name: bytes) -> Iterator[Row]:
        count = -1
        for kind, at, size in chunks(lo, hi):
            end = min(hi, at + size)
            payload = data[at : min(end, at + PAYLOAD)]
            if kind in (b"LIST", b"RIFF"):
                inner = data[at : at + 4]
                count += inner == b"strl"
                yield from lists(at + 4, end, count if inner == b"strl" else stream, inner)
            elif kind in (b"strh", b"strf", b"avih", b"fmt "):
                yield (stream if kind[0:1] == b"s" else -1 if kind == b"avih" else 0), "riff." + kind.decode().strip(), None, None, None, payload
            elif kind == b"data" and name == b"WAVE":
                yield 0, "riff.data", None, size, None, None
            elif name == b"INFO":
                yield -1, "riff.info", kind.decode("latin-1"), None, None, payload
            elif name in (b"movi", b"rec ") and kind[:2].isdigit():
                total[int(kind[:2])] += size

    total: dict[int, int] = defaultdict(int)
    at = 0
    while at + 12 <= len(data):  # further segments follow the first in long AVI files
        size = le(data, at + 4, 4)
        end = len(data) if size in (0, 0xFFFFFFFF) else min(len(data), at + 8 + size)
        yield from lists(at + 12, end, 0, data[at + 8 : at + 12])
        at = end + (end & 1)
    for stream, n in total.items():
        yield stream, "riff.sum", None, n, None, None


def _sections(packets: np.ndarray, start: np.ndarray, begins: np.ndarray, counter: np.ndarray) -> Iterator[bytes]:
    """The sections of one PID: stitched over its packets by pointer field and continuity counter; a packet that repeats is passed, a gap drops what is open."""
    held, last = None, None
    for p, at, begin, count in zip(packets, start.tolist(), begins.tolist(), counter.tolist(), strict=True):
        if last is not None and count == last:
            continue
        if last is not None and count != (last + 1) & 15:
            held = None
        last = count
        body = p[at:].tobytes()
        if begin and body:
            pointer, body = body[0], body[1:]
            if held is not None:
                held += body[:pointer]
            if held is not None and len(held) >= 3 + (int.from_bytes(held[1:3], "big") & 0xFFF):
                yield held
            held = body[pointer:]
        elif held is not None:
            held += body
        while held is not None and len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)):
            yield held[:n]
            held = held[n:]


def _pes_payload(data: bytes) -> tuple[bytes, int]:
    """What follows the header of a packet of an elementary stream, and the header's length."""
    n = 9 + data[8] if len(data) > 8 and data[:3] == b"\0\0\1" and data[6] & 0xC0 == 0x80 else 0
    return data[n:], n


def ts(data: bytes) -> Iterator[Row]:
    """Programs from sections of any length; sizes, units, clocks and the first payload of each elementary stream."""
    places = _ts_packets(data, 0, len(data))
    if not len(places):
        return
    raw = np.frombuffer(data, np.uint8)
    packets = np.lib.stride_tricks.as_strided(raw[places.start :], (len(places), 188), (places.step, 1), writeable=False)
    packets = packets[packets[:, 0] == 0x47]
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    has_field, begins = packets[:, 3] & 32 > 0, packets[:, 1] & 64 > 0
    start = np.where(has_field, np.minimum(5 + packets[:, 4].astype(np.int64), 188), 4)
    start = np.where(packets[:, 3] & 16 > 0, start, 188)
    timed = has_field & (packets[:, 4] >= 7) & (packets[:, 5] & 16 > 0)
    if timed.any():
        b = packets[timed].astype(np.int64)
        clock = b[:, 6] << 25 | b[:, 7] << 17 | b[:, 8] << 9 | b[:, 9] << 1 | b[:, 10] >> 7
        yield -1, "ts.clock", None, int(clock[0]), int(clock[-1]), None
    whole = np.argsort(pid, kind="stable")
    edges = np.flatnonzero(np.diff(pid[whole], prepend=-1))
    of = dict(zip(pid[whole][edges].tolist(), np.split(whole, edges[1:]), strict=True)) if len(whole) else {}
    none = np.zeros(0, np.int64)
    sections = lambda p: _sections(packets[k := of.get(p, none)], start[k], begins[k], packets[k, 3] & 15)
    maps = {int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF for s in sections(0) if s[0] == 0 for k in range(8, len(s) - 7, 4) if s[k : k + 2] != b"\0\0"}
    streams: dict[int, int] = {}
    for p in sorted(maps):
        for s in sections(p):
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF) if s[0] == 2 and len(s) >= 16 else len(s)
            while at + 5 <= len(s) - 4:
                streams.setdefault(int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF, s[at])
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    for p, kind in sorted(streams.items()):
        k = of.get(p, none)
        heads = k[begins[k]]
        size = int((188 - start[k]).sum()) - sum(_pes_payload(packets[h, start[h] :].tobytes())[1] for h in heads.tolist())
        yield p, "ts.stream", str(kind), max(0, size), len(heads), None
        if len(heads) and kind in TS_GATES:
            first, following = int(np.searchsorted(k, heads[0])), k[np.searchsorted(k, heads[1])] if len(heads) > 1 else len(packets)
            joined = b"".join(packets[i, start[i] :].tobytes() for i in k[first : first + PROBE // 100].tolist() if i < following or kind in (0x1B, 0x24))
            yield from probed(p, TS_GATES[kind], b"", _pes_payload(joined)[0][:PROBE])


def ps(data: bytes) -> Iterator[Row]:
    """Packets of program streams: sizes, presentation times, clocks and the first payload by stream."""
    stamp = lambda at: (data[at] >> 1 & 7) << 30 | (u(data, at + 1, 2) >> 1) << 15 | u(data, at + 3, 2) >> 1
    total, first, times, clocks, kinds = defaultdict(int), {}, [], [], {}
    for _, _, _, name, at, size, _ in _visit("ps", data, 0):
        end = at + size
        if name == "BA":
            if size >= 10:
                b = data[at : at + 5]
                clocks.append((b[0] >> 3 & 7) << 30 | (b[0] & 3) << 28 | b[1] << 20 | (b[2] >> 3) << 15 | (b[2] & 3) << 13 | b[3] << 5 | b[4] >> 3 if b[0] & 0xC0 == 0x40 else stamp(at))
            continue
        key = int(name, 16)
        if size and data[at] & 0xC0 == 0x80:
            if size >= 8 and data[at + 1] >= 128:
                times.append(stamp(at + 3))
            at += 3 + (data[at + 2] if size > 2 else 0)
        else:
            while at < end and data[at] == 0xFF:
                at += 1
            at += 2 * (at < end and data[at] & 0xC0 == 0x40)
            mark = data[at] >> 4 if at < end else 0
            if mark in (2, 3) and at + 5 <= end:
                times.append(stamp(at))
            at += {2: 5, 3: 10}.get(mark, 1)
        if key == 0xBD and at < end:
            key = 256 + data[at]
            at += 4 if 0x80 <= data[at] <= 0x8F else 7 if 0xA0 <= data[at] <= 0xAF else 1
        if at < end:
            total[key] += end - at
            kinds.setdefault(key, key)
            if len(first.get(key, b"")) < PROBE:
                first[key] = first.get(key, b"") + data[at : min(end, at + PROBE)]
    for span, name in ((times, "times"), (clocks, "clocks")):
        if span:
            yield -1, "ps." + name, None, min(span), max(span), None
    for key in sorted(total):
        head = first[key][:PROBE]
        group = ("avc" if first_set("avc", head) and b"\0\0\1\xb3" not in head else "mpeg") if 0xE0 <= key <= 0xEF else "mpa" if 0xC0 <= key <= 0xDF else "ac3" if 0x180 <= key <= 0x187 else "dts" if 0x188 <= key <= 0x18F else None
        yield key, "ps.stream", group, total[key], None, None
        yield from probed(key, group, b"", head)


def ogg(data: bytes) -> Iterator[Row]:
    """The first packet of each stream, and its last granule."""
    granule: dict[int, int] = {}
    at = 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        serial, place, n = le(data, at + 14, 4), int.from_bytes(data[at + 6 : at + 14], "little", signed=True), data[at + 26]
        body = at + 27 + n
        if serial not in granule:
            yield serial, "ogg.head", None, None, None, data[body : body + 4096]
        granule[serial] = place if place > 0 else granule.get(serial, 0)
        at = body + sum(data[at + 27 : body])
    for serial, last in granule.items():
        yield serial, "ogg.last", None, last, None, None


def amf0(data: bytes, at: int = 0) -> Iterator[tuple[str, str, str]]:
    """path, type and value of the values of a script, nested ones as a.b or a[0]; ends where the bytes do, or at a type that is not known."""
    where = [at]

    def text(n: int) -> str:
        size = u(data, where[0], n)
        where[0] += n + size
        if where[0] > len(data):
            raise IndexError(size)
        return data[where[0] - size : where[0]].decode("utf-8", "replace")

    def fields(path: str) -> Iterator[tuple[str, str, str]]:
        while True:
            if data[where[0] : where[0] + 3] == b"\0\0\x09":
                where[0] += 3
                return
            name = text(2)
            yield from value(f"{path}.{name}" if path else name)

    def value(path: str) -> Iterator[tuple[str, str, str]]:
        kind = u(data, where[0], 1)
        where[0] += 1
        if kind in (0, 11):
            raw = data[where[0] : where[0] + 8]
            if len(raw) < 8:
                raise IndexError(path)
            where[0] += 8 + 2 * (kind == 11)
            yield path, "date" if kind == 11 else "number", repr(float(np.frombuffer(raw, ">f8")[0]))
        elif kind == 1:
            where[0] += 1
            yield path, "boolean", str(bool(u(data, where[0] - 1, 1))).lower()
        elif kind in (2, 12, 15):
            yield path, "string", text(2 if kind == 2 else 4)
        elif kind in (3, 8):
            where[0] += 4 * (kind == 8)
            yield from fields(path)
        elif kind == 10:
            count = u(data, where[0], 4)
            where[0] += 4
            for k in range(count):
                yield from value(f"{path}[{k}]")
        elif kind in (5, 6):
            yield path, "null", ""
        else:
            raise ValueError(kind)

    try:
        while where[0] < len(data):
            yield from value("")
    except (IndexError, ValueError, RecursionError):
        return


def flv(data: bytes) -> Iterator[Row]:
    total, last, seen = {8: 0, 9: 0}, 0, set()
    flags, at = u(data, 4, 1), max(9, u(data, 5, 4)) + 4
    yield -1, "flv.flags", None, flags, None, None
    while at + 11 <= len(data):
        kind, size = data[at] & 31, u(data, at + 1, 3)
        body = data[at + 11 : at + 11 + size]
        if len(body) < size:
            break
        last = max(last, data[at + 7] << 24 | u(data, at + 4, 3))
        if kind in total and body:
            packed = body[0] & 15 in (7, 12) if kind == 9 else body[0] >> 4 == 10
            configures = packed and body[1:2] == b"\0"
            total[kind] += 0 if configures else max(0, size - (1 if not packed else 5 if kind == 9 else 2))
            if kind not in seen:
                seen.add(kind)
                yield kind, "flv.tag", None, body[0], None, None
            if configures and (kind, 0) not in seen:
                seen.add((kind, 0))
                yield from probed(kind, "aac" if kind == 8 else "avc" if body[0] & 15 == 7 else "hevc", body[2 if kind == 8 else 5 :], b"")
        elif kind == 18:
            for path, name, value in amf0(body):
                yield -1, "flv.meta", path, None, None, f"{name}:{value}".encode("utf-8", "replace")[:PAYLOAD]
        at += 15 + size
    yield -1, "flv.last", None, last, None, None
    for kind, n in total.items():
        yield kind, "flv.sum", None, n, None, None


def _asf_packet(p: bytes, size: dict, times: dict) -> None:
    """The payloads of one packet: error correction in front, then numbers whose widths (0, 1, 2 or 4 bytes) are coded, then one payload or several."""
    at = 1 + (p[0] & 15) if p[0] & 0x80 else 0
    flags, widths = u(p, at, 1), u(p, at + 1, 1)
    at += 2

    def number(code: int) -> int:
        nonlocal at
        n = (0, 1, 2, 4)[code & 3]
        at += n
        return le(p, at - n, n) if n else 0

    length, _, padding = number(flags >> 5), number(flags >> 1), number(flags >> 3)
    at += 6
    several = flags & 1
    head = u(p, at, 1) if several else 1
    at += several
    for _ in range(head & 63):
        stream = u(p, at, 1) & 127
        at += 1
        number(widths >> 4)
        offset, extra = number(widths >> 2), number(widths)
        start = at
        at += extra
        n = number(head >> 6) if several else max(0, (length or len(p)) - at - padding)
        size[stream] += n
        if offset == 0 and extra >= 8:
            times[stream].append(le(p, start + 4, 4))
        at += n


def asf(data: bytes) -> Iterator[Row]:
    header, packet = le(data, 16, 8), 0

    def objects(lo: int, hi: int) -> Iterator[Row]:
        nonlocal packet
        while lo + 24 <= hi:
            name, n = ASF.get(data[lo : lo + 16].hex().upper()), le(data, lo + 16, 8)
            if n < 24:
                return
            payload = data[lo + 24 : min(hi, lo + n)]
            if name == "extension":
                yield from objects(lo + 46, min(hi, lo + n))
            elif name == "rates":
                for k in range(min(le(payload, 0, 2), (len(payload) - 2) // 6)):
                    yield le(payload, 2 + 6 * k, 2) & 127, "asf.rate", None, le(payload, 4 + 6 * k, 4), None, None
            elif name == "more":
                yield from described(payload)
            elif name == "extended" and len(payload) >= 64:
                yield le(payload, 48, 2), "asf.extended", None, le(payload, 16, 4), le(payload, 52, 8), None
            elif name:
                if name == "file" and len(payload) >= 80:
                    packet = le(payload, 68, 4)
                yield (le(payload, 48, 2) & 127 if name == "stream" and len(payload) >= 50 else -1), "asf." + name, None, None, None, payload[:PAYLOAD]
            lo += n

    def described(p: bytes) -> Iterator[Row]:
        at = 2
        for _ in range(le(p, 0, 2)):
            n = le(p, at, 2)
            name, kind, m = p[at + 2 : at + 2 + n].decode("utf-16-le", "replace").rstrip("\0"), le(p, at + 2 + n, 2), le(p, at + 4 + n, 2)
            at += 6 + n
            if kind == 0:
                yield -1, "asf.text", name, None, None, p[at : at + m]
            at += m

    yield from objects(30, min(header, len(data)))
    if packet and data[header : header + 16] == ASF_DATA:
        size, times = defaultdict(int), defaultdict(list)
        for k in range(le(data, header + 40, 8)):
            p = data[header + 50 + k * packet : header + 50 + (k + 1) * packet]
            if len(p) < packet:
                break
            try:
                _asf_packet(p, size, times)
            except IndexError:
                continue
        for stream, n in size.items():
            seen = times[stream]
            yield stream, "asf.sum", None, n, len(seen), None
            if seen:
                yield stream, "asf.times", None, min(seen), max(seen), None


def mxf(data: bytes) -> Iterator[Row]:
    """Local sets tag by tag. The primer pack tells what a file's own tags (0x8000 and up) stand for; essence is summed by item type."""
    primer: dict[int, bytes] = {}
    essence: dict[int, int] = defaultdict(int)
    first: dict[int, bytes] = {}
    at, sets = 0, 0
    while at + 17 <= len(data):
        if data[at : at + 4] != b"\x06\x0e\x2b\x34":
            at += 1
            continue
        key, n, at = data[at : at + 16], data[at + 16], at + 17
        if n >= 128:
            n, at = u(data, at, n - 128), at + n - 128
        end = min(len(data), at + n)
        name = MXF_SETS.get(key[12:16].hex().upper())
        if key[:11] == MXF_ESSENCE[:11]:
            essence[key[12]] += n
            first.setdefault(key[12], data[at : min(end, at + PROBE)])
        elif key[:14] == MXF_PRIMER[:14]:
            for k in range(min(u(data, at, 4), (end - at - 8) // 18)):
                primer[u(data, at + 8 + 18 * k, 2)] = data[at + 10 + 18 * k : at + 26 + 18 * k]
        elif key[:13] == MXF_PARTITION and 2 <= key[13] <= 4:
            yield -1, "mxf.partition", None, key[14], None, data[at + 64 : at + 80]
        elif name:
            sets += 1
            while at + 4 <= end:
                tag, size = u(data, at, 2), u(data, at + 2, 2)
                value = data[at + 4 : min(end, at + 4 + size)]
                known = "BITRATE" if primer.get(tag, b"")[:13] == MXF_BIT_RATE or (tag == 0x8000 and tag not in primer and name == "video") else f"{tag:04X}"
                yield {"video": 1, "sound": 2}.get(name, -1), "mxf." + name, known, sets, None, value[:PAYLOAD]
                at += 4 + size
        at = end
    for kind, n in essence.items():
        track = {5: 1, 0x15: 1, 6: 2, 0x16: 2}.get(kind)
        if track:
            yield track, "mxf.sum", None, n, None, None
            if track == 1:
                yield track, "mxf.first", None, None, None, first[kind]


def amr(data: bytes) -> Iterator[Row]:
    yield 1, "amr.frames", "AMR-WB" if data.startswith(b"#!AMR-WB") else "AMR-NB", sum(1 for _ in _visit("amr", data, 0)), None, None


def sup(data: bytes) -> Iterator[Row]:
    last = max((int(name.split(":")[1]) for _, _, _, name, *_ in _visit("sup", data, 0)), default=0)
    yield 1, "sup.last", None, last, None, None


# kb/s of MPEG audio by version and layer; the sampling rates of version 1.
MPA_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPA_RATES = (44100, 48000, 32000)


def mpa_header(data: bytes, at: int) -> tuple[int, int, int, int, int, int, int] | None:
    """version (1, 2, or 3 for 2.5), layer, kb/s, sampling rate, channels, samples and bytes of the frame whose header stands there; none without one, or of free rate."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, pace = {0: 3, 2: 2, 3: 1}.get(data[at + 1] >> 3 & 3), 4 - (data[at + 1] >> 1 & 3), data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or pace == 3:
        return None
    kbps, hz = MPA_KBPS[min(version, 2), layer][rate], MPA_RATES[pace] >> (version - 1)
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    padding = data[at + 2] >> 1 & 1
    size = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    return version, layer, kbps, hz, 1 if data[at + 3] >> 6 == 3 else 2, samples, size


def id3_size(data: bytes, at: int = 0) -> int:
    """Bytes of the tag that begins there, its header and footer with it; 0 without one."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return 0
    return 10 + sum((b & 127) << 21 - 7 * k for k, b in enumerate(data[at + 6 : at + 10])) + 10 * (data[at + 5] >> 4 & 1)


def id3(data: bytes) -> Iterator[Row]:
    """Frames by their names in versions 3 and 4, without unsynchronisation: of the whole tag before version 4, frame by frame in it."""
    older = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TCO": "TCON", "TRK": "TRCK", "TSS": "TSSE", "TXX": "TXXX", "PIC": "APIC", "COM": "COMM"}
    end = min(len(data), id3_size(data))
    if not end:
        return
    version, flags = data[3], data[5]
    seven = lambda b: sum((x & 127) << 21 - 7 * k for k, x in enumerate(b[:4]))
    body = data[10 : end - 10 * (flags >> 4 & 1)]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = (seven(body) if version == 4 else 4 + u(body, 0, 4)) if flags & 0x40 and version > 2 else 0
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        ident = body[at : at + name].decode("latin-1")
        size = u(body, at + 3, 3) if version == 2 else seven(body[at + 4 :]) if version == 4 else u(body, at + 4, 4)
        value = body[at + head : at + head + size]
        if version == 4 and body[at + 9] & 1:
            value = value[4:]
        if version == 4 and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        yield -1, "id3", older.get(ident, ident), len(value), version, value
        at += head + size


def said(track: int, **values) -> Row:
    """Facts that a walker had to find out to go on."""
    return track, "said", json.dumps({k: v for k, v in values.items() if v is not None}), None, None, None


def mp3(data: bytes) -> Iterator[Row]:
    """The first frame that another one follows, tags and junk before it passed; duration from the table of variable rate in it, else from its rate."""
    yield from id3(data)
    at, end = id3_size(data), len(data) - 128 * (data[-128:-125] == b"TAG")
    while 0 <= at < end:
        head = mpa_header(data, at)
        if head and (at + head[6] >= end or mpa_header(data, at + head[6])):
            break
        at = data.find(b"\xff", at + 1)
    else:
        return
    version, layer, kbps, hz, channels, samples, size = head
    side = 4 + ((32 if channels == 2 else 17) if version == 1 else (17 if channels == 2 else 9))
    mark, frames, total, mode = data[at + side : at + side + 4], None, end - at, "Constant"
    if mark in (b"Xing", b"Info"):
        flags, place = u(data, at + side + 4, 4), at + side + 8
        if flags & 1:
            frames, place = u(data, place, 4), place + 4
        if flags & 2:
            total = u(data, place, 4)
        mode = "Variable" if mark == b"Xing" else "Constant"
    elif data[at + 36 : at + 40] == b"VBRI":
        total, frames, mode = u(data, at + 46, 4), u(data, at + 50, 4), "Variable"
    ms = frames * samples / hz * 1000.0 if frames else total * 8 / kbps
    rate = int(total * 8 / (ms / 1000.0)) if frames and ms and mode == "Variable" else kbps * 1000
    layout = LAYOUTS["1.0" if channels == 1 else "2.0"]
    yield said(1, kind="Audio", stream_id=1, format="MPEG Audio", format_profile=f"Layer {layer}", sampling_rate=hz, channels=channels, channel_layout=layout, bit_rate=rate, bit_rate_mode=mode, duration_ms=ms, stream_size=total, frame_count=frames)
    yield said(-1, duration_ms=ms)


def flac(data: bytes) -> Iterator[Row]:
    """Metadata blocks; what follows the last one is the sound."""
    at, last = 4, False
    while not last and at + 4 <= len(data):
        kind, size, last = data[at] & 127, u(data, at + 1, 3), data[at] >= 128
        if kind == 0:
            yield 1, "private", "flac", None, None, data[at : at + 4 + size]
            yield 1, "flac.info", None, None, None, data[at : at + 4 + size]
        elif kind == 4:
            for _, _, _, name, place, n, _ in _visit("vorbis", data[at + 4 : at + 4 + size], 0):
                yield -1, "vorbis", name, n, None, data[at + 4 + place : at + 4 + place + min(n, PAYLOAD)]
        elif kind == 6:
            yield -1, "picture", None, size, None, None
        at += 4 + size
    yield 1, "flac.sound", None, max(0, len(data) - at), None, None


def dsdiff(data: bytes) -> Iterator[Row]:
    """The properties of the sound; sizes have 64 bits."""
    yield said(1, kind="Audio", stream_id=1, format="DSD", bit_depth=1, compression_mode="Lossless", channels=2)

    def chunks(lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
        while lo + 12 <= hi and lo + 12 + (size := u(data, lo + 4, 8)) <= hi:
            yield data[lo : lo + 4], lo + 12, lo + 12 + size
            lo += 12 + size

    for kind, lo, hi in chunks(12 if data[8:12] == b"DSD " else 16, len(data)):
        if kind == b"PROP" and data[lo : lo + 4] == b"SND ":
            for name, at, end in chunks(lo + 4, hi):
                if name in (b"FSAM", b"CHNL", b"CMPR"):
                    yield 1, "dsdiff." + name.decode(), None, None, None, data[at : min(end, at + 64)]


WALKS = {
    "DSDIFF": dsdiff, "MP3": mp3, "FLAC": flac, "MPEG4": iso, "QuickTime": iso, "Matroska": matroska, "WebM": matroska, "AVI": riff, "WAV": riff, "MPEGTS": ts, "MPEGPS": ps, "Ogg": ogg, "FLV": flv, "ASF": asf, "MXF": mxf, "AMR": amr, "SUP": sup,
}
BROKEN = (IndexError, ValueError, KeyError, TypeError, OverflowError)


def walk(form: str | None, data: bytes | None) -> Iterator[Row]:
    """The rows of one file, the file's own first; a broken one gives those before the fault."""
    head = None if data is None or form in WALKS else data if form in WHOLE else data[:HEAD]
    yield -1, "file", None, None, None, head
    if data is not None and form in WALKS:
        try:
            yield from WALKS[form](data)
        except BROKEN:
            yield -1, "broken", None, None, None, None


#: Readers of parameter sets, and the fields that they give as numbers.
SETS = {
    "sps.avc": (sps.parse, ("profile_idc", "level_idc", "chroma", "bit_depth", "width", "height", "progressive", "frame_rate", "full_range", "primaries", "transfer", "matrix")),
    "sps.hevc": (bitstreams._hevc, ("profile_idc", "level_idc", "chroma", "bit_depth", "width", "height", "tier", "frame_rate", "full_range", "primaries", "transfer", "matrix")),
    "sps.av1": (bitstreams._av1, ("profile", None, "chroma", "bit_depth", "width", "height", None, None, "full_range", "primaries", "transfer", "matrix")),
}


def _codes(rows: list[list]) -> None:
    """Puts the numbers of the parameter sets of all rows into their place."""
    for kind, (parse, fields) in SETS.items():
        own = [r for r in rows if r[5] == kind]
        if own:
            raw = [r[10] if kind == "sps.av1" else r[10].replace(b"\0\0\3", b"\0\0") for r in own]
            found = parse(raw)
            for k, r in enumerate(own):
                if found["found"][k]:
                    r[9] = [None if f is None or np.ma.getmaskarray(found[f])[k] else float(found[f][k]) for f in fields]
                r[10] = None


_ARROW = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary())


def rows_of(files: DataFrame) -> DataFrame:
    """The rows (SCHEMA) of files (path, length, content) of every format, from one scan of the contents, which are not moved."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    big = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[list]) -> pa.RecordBatch:
            _codes(rows)
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                path, length, form, data = (c[k].as_py() for c in batch.columns)
                for node, (track, kind, name, a, b, payload) in enumerate(walk(form, data)):
                    rows.append([path, form, length, track, node, kind, name, a if a is None else min(a, big), b if b is None else min(b, big), None, payload])
                    held += 200 + len(payload or b"")
                    if held > 16 << 20:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    found = files.select(F.col("path").cast("string").alias("path"), F.col("length").cast("bigint").alias("length"), detect_format(F.col("content")).alias("format"), "content")
    return found.mapInArrow(run, SCHEMA)
