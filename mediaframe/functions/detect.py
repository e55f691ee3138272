"""Which container a file's first bytes show: one CASE over its prefix, first match wins, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.bits import be, part, starts

WINDOW = 4096
# Magic bytes and what they say, in order, between the rules on single bytes.
EARLY = [(b"\x00\x00\x01\xba", "MPEGPS"), (b"OggS", "Ogg"), (b"FLV", "FLV"), (b"fLaC", "FLAC"), (b"ID3", "MP3")]
DTS = [b"\x7f\xfe\x80\x01", b"\x1f\xff\xe8\x00", b"\xfe\x7f\x01\x80"]
LATE = [(b"MP+", "MPC"), (b"MPCK", "MPC"), (b"\x06\x0e\x2b\x34", "MXF"), (b"\x30\x26\xb2\x75\x8e\x66\xcf\x11", "ASF"), (b"caff", "CAF"), (b"DSD ", "DSF")]
LAST = [(b"MAC ", "APE"), (b"wvpk", "WavPack"), (b"TTA1", "TrueAudio"), (b"DKIF", "IVF"), (b"YUV4MPEG2", "Y4M"), (b"#!AMR\n", "AMR"), (b"#!AMR-WB\n", "AMR"), (b"WEBVTT", "WebVTT"), (b"\xef\xbb\xbfWEBVTT", "WebVTT"), (b"[Script Info]", "ASS"), (b"\xef\xbb\xbf[Script Info]", "ASS"), (b"[V4+ Styles]", "ASS"), (b"PG", "SUP")]


def _contains(prefix: Column, what: bytes) -> Column:
    """At any byte: hex digits are found at even places only, by a pattern over whole bytes."""
    return F.hex(prefix).rlike("^(?:..)*?" + what.hex().upper())


def detect_format(content: Column) -> Column:
    """The container's variant name; null content gives null."""
    head = part(content, 0, WINDOW)
    first, second, size = be(content, 0, 1), be(content, 1, 1), F.length(content)
    tag, at4, at8 = part(content, 0, 4), part(content, 4, 4), part(content, 8, 4)
    among = lambda c, *names: c.isin(*(F.lit(n) for n in names))
    rule = F.when(size < 3, "Unknown").when(starts(content, b"\x1a\x45\xdf\xa3"), F.when(_contains(head, b"webm"), "WebM").otherwise("Matroska"))
    rule = rule.when(at4 == F.lit(b"ftyp"), F.when(among(at8, b"qt  ", b"moov"), "QuickTime").otherwise("MPEG4")).when(among(at4, b"moov", b"mdat", b"wide", b"skip"), "MPEG4")
    rule = rule.when(among(tag, b"RIFF", b"RIFX", b"RF64", b"BW64"), F.when(among(at8, b"AVI ", b"AVIX"), "AVI").otherwise("WAV"))
    rule = rule.when((first == 0x47) & ((size < 564) | ((be(content, 188, 1) == 0x47) & (be(content, 376, 1) == 0x47))), "MPEGTS")
    rule = rule.when((size >= 576) & (be(content, 4, 1) == 0x47) & (be(content, 196, 1) == 0x47) & (be(content, 388, 1) == 0x47), "MPEGTS")
    for magic, name in EARLY:
        rule = rule.when(starts(content, magic), name)
    rule = rule.when((first == 0xFF) & (second.bitwiseAND(0xF6) == 0xF0), "AAC").when(among(part(content, 0, 2), b"\x0b\x77", b"\x77\x0b"), "AC3").when(among(tag, *DTS), "DTS")
    rule = rule.when((first == 0xFF) & (second.bitwiseAND(0xE0) == 0xE0), "MP3")
    for magic, name in LATE:
        rule = rule.when(starts(content, magic), name)
    rule = rule.when((tag == F.lit(b"FRM8")) & (at8 == F.lit(b"DSD ")), "DSDIFF")
    rule = rule.when((tag == F.lit(b"FORM")) & among(at8, b"AIFF", b"AIFC"), "AIFF")
    for magic, name in LAST:
        rule = rule.when(starts(content, magic), name)
    return F.when(content.isNotNull(), rule.when(_contains(part(content, 0, 256), b"-->"), "SRT").otherwise("Unknown"))
