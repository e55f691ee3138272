"""Reports of whole files of every family, in bytes made here: one call of inspect() over all of them."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import containers, inspect, reports, walk

from .test_codecs import Written, hevc, prores


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts):
    return box(kind, bytes(4), *parts)


def n(value, size=4, order="big"):
    return value.to_bytes(size, order)


def le(value, size=4):
    return n(value, size, "little")


def avc(width=1280, lines=720):
    w = Written().u(8, 0x67, 100, 0, 31).ue(0, 1, 0, 0).u(2, 0).ue(4, 0, 4, 4).u(1, 0).ue(width // 16 - 1, lines // 16 - 1).u(1, 1).u(1, 1).u(1, 0)
    return w.u(1, 1).u(1, 0).u(1, 0).u(1, 1).u(3, 5).u(1, 0).u(1, 1).u(8, 1, 1, 1).u(1, 0).u(1, 1).u(32, 1, 50).u(1, 1).data()


def avcc(unit=None):
    unit = unit or avc()
    return b"\1\x64\0\x1f\xff\xe1" + n(len(unit), 2) + unit + b"\1\0\4\x68\xee\x3c\x80"


ASC = b"\x12\x10"
AC3 = bytes.fromhex("0B770000") + n(0b00_010000, 1) + n(0b01000_000, 1) + bytes([0b010_00_1_11, 0b111_00000]) + bytes(40)


def descriptor(tag, *parts):
    body = b"".join(parts)
    return bytes([tag, 0x80, 0x80, 0x80, len(body)]) + body


def esds():
    config = descriptor(4, b"\x40\x15" + bytes(3) + n(128000) + n(96000), descriptor(5, ASC))
    return full(b"esds", descriptor(3, b"\0\1\0", config))


def trak(ident, handler, entry, sizes, times=(), chunk=None, lang=0x55C4, size=(0, 0)):
    tkhd = box(b"tkhd", b"\0\0\0\1" + bytes(8) + n(ident) + bytes(56) + bytes(4) + n(size[0] << 16) + n(size[1] << 16))
    mdhd = full(b"mdhd", bytes(8) + n(1000) + n(2000) + n(lang, 2) + bytes(2))
    stts = full(b"stts", n(len(times)) + b"".join(n(a) + n(b) for a, b in times))
    place = full(b"co64", n(1) + n(chunk, 8)) if chunk else b""
    return box(b"trak", tkhd, box(b"mdia", mdhd, full(b"hdlr", bytes(4) + handler + bytes(13)), box(b"minf", box(b"stbl", full(b"stsd", n(1) + entry), stts, sizes, place))))


def visual(kind, *children):
    return box(kind, bytes(24) + n(640, 2) + n(360, 2) + bytes(50), *children)


def sound(kind, *children, version=0):
    more = {0: b"", 1: bytes(16), 2: n(72) + struct.pack(">d", 96000.0) + n(6) + bytes(20)}[version]
    return box(kind, bytes(8) + n(version, 2) + bytes(6) + n(2, 2) + n(16, 2) + bytes(4) + n(44100 << 16) + more, *children)


def mp4():
    sizes = full(b"stsz", n(0) + n(3) + n(1000) + n(2000) + n(3000))
    video = trak(1, b"vide", visual(b"avc1", box(b"avcC", avcc()), box(b"colr", b"nclx" + n(9, 2) + n(16, 2) + n(9, 2) + b"\x80"), box(b"pasp", n(4) + n(3))), sizes, [(50, 40)])
    audio = trak(2, b"soun", sound(b"mp4a", box(b"wave", esds()), version=1), full(b"stsz", n(100) + n(20)))
    other = trak(3, b"soun", sound(b"lpcm", version=2), full(b"stsz", n(4) + n(10)))
    return box(b"ftyp", b"isom" + n(512) + b"isom") + box(b"moov", full(b"mvhd", bytes(8) + n(1000) + n(2000) + bytes(80)), video, audio, other)


def mov():
    frame = prores()
    head = box(b"ftyp", b"qt  " + n(0))
    video = lambda at: box(b"moov", trak(1, b"vide", visual(b"apch"), full(b"stsz", n(40) + n(1)), chunk=at, size=(1920, 1080)), trak(2, b"vide", visual(b"hvc1", box(b"hvcC", bytes(22) + b"\1\x21\0\1" + n(len(hevc()), 2) + hevc())), full(b"stsz", n(1) + n(1))))
    return head + video(len(head) + len(video(1)) + 8) + box(b"mdat", frame)


def element(ident, *parts):
    body = b"".join(parts)
    return bytes.fromhex(ident) + b"\x01" + n(len(body), 7) + body


def mkv(doc=b"matroska"):
    number = lambda ident, value, size=1: element(ident, n(value, size))
    colour = element("55B0", number("55B9", 2), number("55BA", 16), number("55BB", 9), number("55B1", 9), number("55BC", 1000, 2))
    video = element("AE", number("D7", 1), number("83", 1), element("86", b"V_MPEG4/ISO/AVC"), element("63A2", avcc(avc(320, 240))), number("88", 0), element("E0", number("B0", 320, 2), number("BA", 240), number("9A", 2), colour))
    trap = element("AE", number("D7", 2), number("83", 2), element("86", b"A_AAC"), element("63A2", b"\x11\x88"), element("E1", element("B5", struct.pack(">f", 48000.0)), number("9F", 1)))
    probed = element("AE", number("D7", 3), number("83", 2), element("86", b"A_AC3"))
    plain = element("AE", number("D7", 4), number("83", 1), element("86", b"V_MPEGH/ISO/HEVC"), element("E0", number("B0", 16), number("BA", 16)))
    vfw = element("AE", number("D7", 5), number("83", 1), element("86", b"V_MS/VFW/FOURCC"), element("63A2", bytes(16) + b"XVID" + bytes(20)))
    block = lambda track, data: element("A3", bytes([0x80 | track, 0, 0, 0x80]) + data)
    cluster = element("1F43B675", block(1, b"\0" * 50), block(2, bytes.fromhex("0B77") + bytes(60)), block(3, AC3), block(4, b"\0\0\0\1" + hevc()), block(1, b"\0" * 7))
    info = element("1549A966", element("2AD7B1", n(1000000, 3)), element("4489", struct.pack(">d", 4000.0)), element("7BA9", "Tïtle".encode()), element("4D80", b"lib"), element("5741", b"app"))
    chapters = element("1043A770", element("45B9", element("B6", element("91", n(0, 8))), element("B6", element("91", n(3_000_000_000, 8)), element("80", element("85", b"Second")))))
    return element("1A45DFA3", element("4282", doc)) + element("18538067", info, element("1654AE6B", video, trap, probed, plain, vfw), chapters, cluster)


def packets(pid, data, counter=0, start=True, pcr=None, section=False):
    """Packets of 188 bytes: the first begins a unit; the last is filled by its adaptation field or, for sections, with FF."""
    out = b""
    while data or start:
        field = b"" if pcr is None else bytes([7, 0x10]) + n(pcr >> 1, 4) + bytes([(pcr & 1) << 7, 0])
        room = 184 - len(field)
        piece, data = data[:room], data[room:]
        if len(piece) < room and section:
            piece += b"\xff" * (room - len(piece))
        elif len(piece) < room:
            short = room - len(piece)
            field = (bytes([short - 1]) + (b"\0" + b"\xff" * (short - 2) if short > 1 else b"")) if not field else bytes([field[0] + short]) + field[1:] + b"\xff" * short
        out += b"\x47" + n((0x4000 if start else 0) | pid, 2) + bytes([(0x30 if field else 0x10) | counter]) + field + piece
        counter, start, pcr = (counter + 1) & 15, False, None
    return out


def section(body):
    return body[:1] + n(0xB000 | (len(body) + 1), 2) + body[3:] + bytes(4)


def ts():
    pat = section(b"\0\0\0" + n(1, 2) + b"\xc1\0\0" + n(1, 2) + n(0xE000 | 0x100, 2))
    long = b"\x05\x50" + b"x" * 80
    es = lambda kind, pid, info=b"": bytes([kind]) + n(0xE000 | pid, 2) + n(0xF000 | len(info), 2) + info
    pmt = section(b"\2\0\0" + n(1, 2) + b"\xc1\0\0" + n(0xE000 | 0x101, 2) + n(0xF000 | len(long), 2) + long + es(0x1B, 0x101, long) + es(0x0F, 0x102, long) + es(0x24, 0x103) + es(0x90, 0x104))
    assert len(pmt) > 184
    pes = lambda stream, data: b"\0\0\1" + bytes([stream]) + bytes(2) + b"\x80\0\5" + bytes(5) + data
    adts = bytes.fromhex("FFF15080") + b"\x02\x1f\xfc" + bytes(20)
    body = packets(0, b"\0" + pat, section=True) + packets(0x100, b"\0" + pmt, section=True)
    # the parameter set of the video lies across two packets
    video = pes(0xE0, b"\0\0\1\x09\xf0" + b"\0\0\1\x06" + b"\5" * 150 + b"\0\0\1" + avc() + b"\0\0\1\x68" + b"\1" * 20)
    return body + packets(0x101, video, pcr=90000) + packets(0x102, pes(0xC0, adts)) + packets(0x103, pes(0xE1, b"\0\0\1" + hevc())) + packets(0x101, pes(0xE0, b"\0\0\1\x41" + b"\1" * 30), counter=3, pcr=90000 + 9000)


def ps():
    sequence = b"\0\0\1\xb3" + bytes.fromhex("2D0240") + b"\x33" + bytes.fromhex("000000A0") + b"\0\0\1\xb5\x14\x8a" + bytes(8)
    stamp = lambda t: bytes([0x21 | (t >> 30) << 1]) + n((t >> 15 & 0x7FFF) << 1 | 1, 2) + n((t & 0x7FFF) << 1 | 1, 2)
    pes = lambda key, t, data: b"\0\0\1" + bytes([key]) + n(len(data) + 8, 2) + b"\x80\x80\x05" + stamp(t) + data
    pack = b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8"
    return pack + pes(0xE0, 90000, sequence) + pes(0xC0, 90000, bytes.fromhex("FFFB9064") + bytes(60)) + pes(0xBD, 99000, b"\x80\1\0\0" + AC3) + pack


def flv():
    number = lambda x: b"\0" + struct.pack(">d", x)
    name = lambda x: n(len(x), 2) + x
    nested = b"\3" + name(b"keys") + b"\x0a" + n(2) + number(1.0) + b"\2" + name(b"two") + b"\0\0\x09"
    meta = b"\2" + name(b"onMetaData") + b"\x08" + n(4) + name(b"duration") + number(12.5) + name(b"framerate") + number(25.0) + name(b"stereo") + b"\1\1" + name(b"nested") + nested + name(b"encoder") + b"\2" + name(b"enc") + b"\0\0\x09"
    tag = lambda kind, t, data: bytes([kind]) + n(len(data), 3) + n(t, 3) + b"\0\0\0\0" + data + n(len(data) + 11)
    return b"FLV\1\5\0\0\0\x09\0\0\0\0" + tag(18, 0, meta) + tag(9, 0, b"\x17\0\0\0\0" + avcc()) + tag(8, 0, b"\xaf\0" + ASC) + tag(9, 40, b"\x27\1\0\0\0" + bytes(100)) + tag(8, 40, b"\xaf\1" + bytes(30))


def asf():
    key = {v: bytes.fromhex(k) for k, v in walk.ASF.items()}
    thing = lambda k, body: k + le(len(body) + 24, 8) + body
    wide = lambda x: (x + "\0").encode("utf-16-le")
    files = bytes(40) + le(30_000_000, 8) + bytes(8) + le(1000, 8) + bytes(4) + le(100) + le(100) + le(256000)
    video = bytes.fromhex("C0EF19BC4D5BCF11A8FD00805F5C442B") + bytes(24) + bytes(8) + le(1, 2) + bytes(4) + le(320) + le(240) + b"\2" + le(40, 2) + le(40) + le(320) + le(240) + bytes(4) + b"WMV3" + bytes(20)
    audio = bytes.fromhex("409E69F84D5BCF11A8FD00805F5C442B") + bytes(24) + bytes(8) + le(2, 2) + bytes(4) + le(0x161, 2) + le(2, 2) + le(44100) + le(8000) + le(4, 2) + le(16, 2)
    extended = bytes(16) + le(64000) + bytes(28) + le(1, 2) + bytes(2) + le(400_000, 8) + bytes(4)
    rates = le(1, 2) + le(2, 2) + le(65000)
    more = le(1, 2) + le(len(wide("WM/AlbumTitle")), 2) + wide("WM/AlbumTitle") + le(0, 2) + le(len(wide("Alb")), 2) + wide("Alb")
    objects = thing(key["file"], files) + thing(key["stream"], video) + thing(key["stream"], audio) + thing(key["rates"], rates) + thing(key["more"], more) + thing(key["extension"], bytes(18) + le(88) + thing(key["extended"], extended))
    head = bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C") + le(len(objects) + 30, 8) + le(6) + b"\1\2" + objects
    payload = lambda stream, data, at, t, several: bytes([stream]) + b"\0" + le(at) + b"\x08" + le(len(data)) + le(t) + (le(len(data), 2) if several else b"") + data
    # error correction, one byte of padding length, one payload; then two payloads with lengths of two bytes
    one = b"\x82\0\0" + b"\x08\x5d" + b"\x0a" + bytes(6) + payload(1, b"v" * 60, 0, 1000, False)
    two = b"\x01\x5d" + bytes(6) + b"\x82" + payload(1, b"v" * 11, 60, 1000, True) + payload(2, b"a" * 22, 0, 1040, True)
    filled = [one + bytes(100 - len(one)), two + bytes(100 - len(two))]
    size = 100 - (len(one) - 60) - 10
    return head + walk.ASF_DATA + le(50 + 200, 8) + bytes(16) + le(2, 8) + bytes(2) + b"".join(filled), size


def mxf():
    item = lambda tag, value: n(tag, 2) + n(len(value), 2) + value
    klv = lambda key, body: bytes.fromhex(key) + b"\x83" + n(len(body), 3) + body
    local = lambda tail, *items: klv("060E2B34025301010D010101" + tail, b"".join(items))
    label = bytes.fromhex("060E2B340401010A0401020201323100")
    primer = klv("060E2B34020501010D01020101050100", n(1) + n(18) + n(0x8123, 2) + bytes.fromhex("060E2B34010101050401060201") + b"\x0b\0\0")
    picture = local("01012800", item(0x3203, n(1920)), item(0x3202, n(540)), item(0x3001, n(25) + n(1)), item(0x320C, b"\1"), item(0x3201, label), item(0x3301, n(10)), item(0x3302, n(2)), item(0x3308, n(1)), item(0x8123, n(50_000_000)), item(0x3212, b"\1"))
    heard = local("01014800", item(0x3D03, n(48000) + n(1)), item(0x3D07, n(2)), item(0x3D01, n(24)))
    timeline = local("01013B00", item(0x4B01, n(25) + n(1)))
    clip = local("01011100", item(0x0202, n(100, 8)))
    about = local("01013000", item(0x3C01, "Maker".encode("utf-16-be")), item(0x3C02, "Tool".encode("utf-16-be")))
    partition = klv("060E2B34020501010D01020101020400", bytes(64) + bytes.fromhex("060E2B34040101010D01020101010900") + bytes(8))
    essence = lambda kind, size: klv(f"060E2B34010201010D010301{kind}010501", bytes(size))
    return partition + primer + about + timeline + clip + picture + heard + essence("15", 900) + essence("16", 300) + essence("15", 100)


def riff(kind, *chunks, head=b"RIFF", size=None):
    body = kind + b"".join(chunks)
    return head + le(len(body) if size is None else size) + body


def chunk(kind, data, size=None):
    return kind + le(len(data) if size is None else size) + data + b"\0" * (len(data) & 1)


def wav(extensible=True, rf64=False):
    fmt = le(0xFFFE if extensible else 1, 2) + le(6, 2) + le(48000) + le(48000 * 18) + le(18, 2) + le(24, 2) + (le(22, 2) + le(20, 2) + le(0x60F) + le(1, 2) + bytes(14) if extensible else b"")
    data = bytes(48000 * 18 // 100)
    inner = [chunk(b"fact", bytes(5)), chunk(b"LIST", b"INFO" + chunk(b"INAM", b"Song\0") + chunk(b"IART", b"Who"))]
    if rf64:
        return riff(b"WAVE", chunk(b"ds64", le(0, 8) + le(len(data), 8) + bytes(8) + le(0)), *inner, chunk(b"fmt ", fmt), chunk(b"data", data, 0xFFFFFFFF), head=b"RF64", size=0xFFFFFFFF)
    return riff(b"WAVE", *inner, chunk(b"data", data), chunk(b"fmt ", fmt))


def avi():
    head = chunk(b"avih", le(40000) + bytes(12) + le(50) + bytes(20))
    video = chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsXVID" + bytes(12) + le(1) + le(25) + bytes(4) + le(50) + bytes(20)) + chunk(b"strf", le(40) + le(64) + le(48) + le(1, 2) + le(24, 2) + b"XVID" + bytes(20)))
    audio = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + bytes(44)) + chunk(b"strf", le(0x55, 2) + le(2, 2) + le(44100) + le(16000) + le(1, 2) + le(0, 2)))
    return riff(b"AVI ", chunk(b"LIST", b"hdrl" + head + video + audio), chunk(b"LIST", b"movi" + chunk(b"00dc", bytes(70)) + chunk(b"01wb", bytes(33)) + chunk(b"00dc", bytes(30))))


def page(serial, granule, data):
    return b"OggS\0\2" + le(granule, 8) + le(serial) + bytes(8) + b"\1" + bytes([len(data)]) + data


def ogg():
    theora = b"\x80theora\3\2\1" + n(20, 2) + n(15, 2) + n(320, 3) + n(240, 3) + bytes(2) + n(25) + n(1) + bytes(6) + b"\0" + n(0, 3) + n(0, 2)
    return page(7, 0, theora) + page(9, 0, b"\x01vorbis" + bytes(4) + b"\2" + le(44100) + bytes(4) + le(128000) + bytes(6)) + page(9, 88200, b"x")


def frames(count=4, first=b""):
    """Frames of 128 kb/s and 44,100 Hz, of 417 bytes; first goes into the first one."""
    head = bytes.fromhex("FFFB9064")
    return head + first + bytes(413 - len(first)) + (head + bytes(413)) * (count - 1)


def seven(size):
    return bytes(size >> k & 127 for k in (21, 14, 7, 0))


PICTURE = b"\x89PNG\xff\0\xff\xe0" + bytes(range(256))


def id3v2(version=4):
    """Tags with a title, a user-defined text in UTF-16, a comment and a picture, with unsynchronisation."""
    stuffed = lambda x: x.replace(b"\xff", b"\xff\0")
    texts = [(b"TIT2", b"\3T\xc3\xaftle"), (b"TXXX", b"\1" + "Käy\0".encode("utf-16") + "Välue".encode("utf-16")), (b"COMM", b"\0eng" + b"short\0long text"), (b"APIC", b"\0image/png\0\3cover\0" + PICTURE)]
    if version == 4:
        body = b"".join(k + seven(len(stuffed(v))) + b"\0\2" + stuffed(v) for k, v in texts)
        return b"ID3\4\0\0" + seven(len(body)) + body
    body = stuffed(b"".join(k + n(len(v)) + b"\0\0" + v for k, v in texts))
    return b"ID3\3\0\x80" + seven(len(body)) + body


def mp3(mark=b""):
    table = {b"": b"", b"Xing": bytes(32) + b"Xing" + n(3) + n(1000) + n(400_000), b"VBRI": bytes(32) + b"VBRI" + bytes(6) + n(200_000) + n(500)}[mark]
    return id3v2(4 if mark else 3) + b"junk\xff\xfb\x90" + frames(4, table) + b"TAG" + bytes(125)


def flac():
    info = n(4096, 2) + n(4096, 2) + bytes(6) + n((44100 << 44) | (1 << 41) | (15 << 36) | 88200, 8) + bytes(16)
    comment = le(0) + le(2) + le(9) + b"TITLE=Tst" + le(12) + b"artist=Maker"
    return b"fLaC" + b"\0" + n(34, 3) + info + b"\4" + n(len(comment), 3) + comment + b"\x86" + n(20, 3) + bytes(20) + bytes(555)


def dsdiff(compressed=False):
    chunk8 = lambda kind, data: kind + n(len(data), 8) + data
    prop = b"SND " + chunk8(b"FSAM", n(5644800)) + chunk8(b"CHNL", n(6, 2) + bytes(24)) + chunk8(b"CMPR", (b"DST " if compressed else b"DSD ") + b"\0\0")
    body = b"DSD " + chunk8(b"FVER", n(0x01050000)) + chunk8(b"PROP", prop) + chunk8(b"DSD ", bytes(64))
    return b"FRM8" + n(len(body)) + body  # the detector looks for the form's name at byte 8


def ape(version=3990):
    if version < 3980:
        return b"MAC " + le(version, 2) + le(2000, 2) + bytes(2) + le(1, 2) + le(44100) + bytes(8) + le(2) + le(7236)
    return b"MAC " + le(version, 2) + bytes(2) + le(60) + bytes(48) + le(3000, 2) + bytes(2) + le(73728) + le(44100) + le(1) + le(24, 2) + le(2, 2) + le(44100)


FILES = {
    "dsdiff": dsdiff(), "dst": dsdiff(True), "ape": ape(), "old_ape": ape(3970),
    "mp4": mp4(), "mov": mov(), "mkv": mkv(), "webm": mkv(b"webm"), "ts": ts(), "ps": ps(), "flv": flv(), "asf": asf()[0], "mxf": mxf(), "wav": wav(), "rf64": wav(True, True), "plain": wav(False), "avi": avi(), "ogg": ogg(), "amr": b"#!AMR\n" + (b"\x3c" + bytes(31)) * 5, "empty": b"", "junk": b"????????",
    "id3": mp3(), "vbr": mp3(b"Xing"), "vbri": mp3(b"VBRI"), "flac": flac(), "srt": b"1\n00:00:01,000 --> 00:00:02,500\nx\n", "cut": mp4()[:200], "bad_flv": b"FLV\1", "no_tracks": b"OggS" + bytes(4), "bad_mxf": mxf()[:300], "bad_asf": asf()[0][:120], "half_ts": ts()[:500], "none": None,
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(k, None if c is None else len(c), None if c is None else bytearray(c)) for k, c in FILES.items()], "path string, length bigint, content binary")
    report = inspect.inspect(files)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("LogicalRDD") == 1 and "Join LeftOuter" not in plan and "Join Inner" not in plan
    return {r["general"]["file_path"]: r for r in report.collect()}


def check(track, **want):
    got = {k: track[k] for k in want}
    assert got == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()}


def test_every_file_has_a_report(found):
    assert set(found) == set(FILES)
    assert {k for k, r in found.items() if r["error"] == "no known format"} == {"junk", "none"} and found["empty"]["error"] is None and found["empty"]["general"]["file_size"] == 0


def test_sample_entries_of_iso_media(found):
    r = found["mp4"]
    v, (a, b) = r["videos"][0], r["audios"]
    check(v, stream_id=1, format="AVC", codec_id="avc1", format_profile="High", format_level="3.1", width=640, height=360, stored_width=1280, stored_height=720, chroma="4:2:0", bit_depth=8, frame_rate=25.0, frame_rate_mode="Constant", stream_size=6000, bit_rate=24000, duration_ms=2000.0, language=None)
    check(v, color_primaries="BT.2020", transfer="PQ", matrix="BT.2020 non-constant", color_range="Full", pixel_aspect=4 / 3, display_aspect=640 * 4 / 3 / 360, color_space="YUV", scan_type="Progressive", frame_count=3)
    check(a, stream_id=2, format="AAC", codec_id="mp4a-40-2", format_profile="LC", channels=2, sampling_rate=44100, bit_rate=96000, bit_depth=None, stream_size=2000)
    check(b, format="PCM", channels=6, sampling_rate=96000, compression_mode="Lossless")
    check(r["general"], format="MPEG-4", duration_ms=2000.0, codec_id="isom")
    p, h = found["mov"]["videos"]
    check(p, format="ProRes", format_version="0", width=1920, height=1080, chroma="4:2:2", scan_type="Progressive", encoded_library="apl0", color_space=None)
    check(h, format="HEVC", format_profile="Main 10", format_level="4.0", width=640, stored_width=1920, stored_height=1080, bit_depth=10, hdr_format="HDR10")


def test_private_data_colours_and_probes_of_matroska(found):
    r = found["mkv"]
    v, h, x = r["videos"]
    trap, probed = r["audios"]
    check(r["general"], format="Matroska", duration_ms=4000.0, title="Tïtle", encoded_library="lib", encoded_application="app")
    check(v, format="AVC", width=320, height=240, color_range="Full", transfer="PQ", color_primaries="BT.2020", scan_type="Progressive", format_profile="High", default_flag=False, stream_size=57, bit_rate=114)
    check(h, stream_id=4, format="HEVC", format_profile="Main 10", stored_width=1920)
    check(x, format="MPEG-4 Visual", codec_id="V_MS/VFW/FOURCC / XVID")
    check(trap, format="AAC", channels=1, sampling_rate=48000, format_profile="LC")
    check(probed, format="AC-3", channels=3, sampling_rate=48000, bit_rate=128000)
    assert [(c["timestamp_ms"], c["title"]) for c in r["menus"][0]["chapters"]] == [(0.0, "Chapter 1"), (3000.0, "Second")]
    assert found["webm"]["general"]["format"] == "WebM"


def test_transport_streams_over_packet_borders(found):
    v, h = found["ts"]["videos"]
    check(found["ts"]["general"], format="MPEG-TS", duration_ms=100.0)
    check(v, stream_id=1, format="AVC", codec_id="27", width=1280, height=720, frame_rate=25.0, frame_count=2, duration_ms=80.0)
    check(h, stream_id=3, format="HEVC", width=1920, height=1080, bit_depth=10)
    check(found["ts"]["audios"][0], stream_id=2, format="AAC", sampling_rate=44100, channels=2, format_profile="LC", stream_size=27)
    check(found["ts"]["texts"][0], stream_id=4, format="PGS")


def test_program_streams(found):
    r = found["ps"]
    check(r["general"], duration_ms=100.0)
    check(r["videos"][0], format="MPEG-2 Video", width=720, height=576, frame_rate=25.0, standard="PAL", format_version="2")
    assert [(a["format"], a["channels"]) for a in r["audios"]] == [("MPEG Audio", 2), ("AC-3", 3)]


def test_script_data_of_flv(found):
    r = found["flv"]
    check(r["general"], duration_ms=12500.0, encoded_application="enc")
    check(r["videos"][0], format="AVC", codec_id="7", width=1280, height=720, frame_rate=25.0, stream_size=100, bit_rate=64)
    check(r["audios"][0], format="AAC", sampling_rate=44100, channels=2, stream_size=30)
    values = list(walk.amf0(flv()[24:]))
    assert ("nested.keys[1]", "string", "two") in values and ("stereo", "boolean", "true") in values and ("duration", "number", "12.5") in values
    assert list(walk.amf0(b"\0\x40")) == [] and list(walk.amf0(b"\x03\0\1a\x02\xff\xff")) == [] and list(walk.amf0(b"\x0a\xff\xff\xff\xff")) == []


def test_packets_of_asf(found):
    r = found["asf"]
    check(r["general"], format="Windows Media", duration_ms=2000.0, album="Alb")
    check(r["videos"][0], stream_id=1, format="VC-1", width=320, height=240, frame_rate=25.0, stream_size=asf()[1] + 11, bit_rate=64000)
    check(r["audios"][0], stream_id=2, format="WMA", channels=2, sampling_rate=44100, bit_rate=65000, stream_size=22)


def test_descriptors_of_mxf(found):
    r = found["mxf"]
    check(r["general"], format="MXF", format_profile="OP-1a", duration_ms=4000.0, encoded_library="Maker", encoded_application="Tool")
    check(r["videos"][0], format="AVC", width=1920, height=1080, frame_rate=25.0, scan_type="Interlaced", scan_order="TFF", chroma="4:2:2", bit_depth=10, bit_rate=50_000_000, stream_size=1000)
    check(r["audios"][0], sampling_rate=48000, channels=2, bit_depth=24, stream_size=300, bit_rate=600)


def test_chunks_in_any_order_and_of_64_bits(found):
    for name in ("wav", "rf64"):
        check(found[name]["general"], format="Wave", duration_ms=10.0, title="Song", artist="Who")
        check(found[name]["audios"][0], format="PCM", channels=6, channel_layout="5.1 Surround (L R C LFE Ls Rs)", bit_depth=20, sampling_rate=48000, bit_rate=6912000, stream_size=8640)
    check(found["plain"]["audios"][0], bit_depth=24, channels=6)
    check(found["avi"]["videos"][0], format="MPEG-4 Visual", width=64, height=48, frame_rate=25.0, stream_size=100, duration_ms=2000.0)
    check(found["avi"]["audios"][0], format="MPEG Audio", channels=2, sampling_rate=44100, stream_size=33)


def test_other_formats(found):
    check(found["ogg"]["videos"][0], format="Theora", width=320, height=240, frame_rate=25.0, bit_depth=8)
    check(found["ogg"]["audios"][0], format="Vorbis", channels=2, sampling_rate=44100, duration_ms=2000.0)
    check(found["amr"]["audios"][0], format="AMR-NB", duration_ms=100.0, sampling_rate=8000)
    check(found["id3"]["audios"][0], format="MPEG Audio", format_profile="Layer 3", sampling_rate=44100, bit_rate=128000, channels=2, stream_size=4 * 417, duration_ms=4 * 417 * 8 / 128)
    check(found["id3"]["general"], title="Tïtle", cover_art_present=True)
    check(found["vbr"]["audios"][0], bit_rate_mode="Variable", duration_ms=1000 * 1152 / 44.1, bit_rate=int(400_000 * 8 / (1000 * 1152 / 44100)), frame_count=1000)
    check(found["vbri"]["audios"][0], bit_rate_mode="Variable", duration_ms=500 * 1152 / 44.1, stream_size=200_000)
    check(found["flac"]["audios"][0], format="FLAC", channels=2, bit_depth=16, sampling_rate=44100, duration_ms=2000.0, stream_size=555, bit_rate=2220, compression_mode="Lossless")
    check(found["flac"]["general"], title="Tst", artist="Maker", cover_art_present=True)
    check(found["dsdiff"]["audios"][0], format="DSD", format_info="DSD128 (1-bit / 5.6448 MHz)", channels=6, sampling_rate=5644800, bit_depth=1, compression_mode="Lossless")
    check(found["dst"]["audios"][0], format_info="DST Compressed DSD", compression_mode="Lossless (Direct Stream Transfer)")
    check(found["ape"]["audios"][0], format="Monkey's Audio", format_profile="High (Level 3000)", bit_depth=24, channels=2, duration_ms=1000.0)
    check(found["old_ape"]["audios"][0], format_profile="Level 2000", bit_depth=16, channels=1, duration_ms=1000.0)
    check(found["srt"]["texts"][0], format="SubRip", duration_ms=2500.0)


def test_reports_are_written_of_what_boxes_say(spark):
    files = spark.createDataFrame([(k, len(FILES[k]), bytearray(FILES[k])) for k in ("mp4", "mkv")], "path string, length bigint, content binary")
    found = inspect.inspect(files)
    texts = {r["p"]: r for r in found.select(F.col("general.file_path").alias("p"), *(reports.formatted(found, k).alias(k) for k in ("text", "json", "xml", "csv", "html"))).collect()}
    lines = {line.split(" : ")[0].strip(): line.split(" : ")[1] for line in texts["mp4"]["text"].split("Audio")[0].splitlines() if " : " in line}
    assert (lines["Format profile"], lines["Color primaries"], lines["Transfer characteristics"], lines["Frame rate"], lines["Codec ID"]) == ("High@L3.1", "BT.2020", "PQ", "25.000 FPS", "avc1")
    assert "BT.2020" in texts["mp4"]["json"]
    assert "<Format>AVC</Format>" in texts["mkv"]["xml"] and "<Format>AAC</Format>" in texts["mkv"]["xml"] and '"AVC","640x360"' in texts["mp4"]["csv"] and "640 &times; 360" in texts["mp4"]["html"]


def test_frames_of_several_parts(spark):
    files = spark.createDataFrame([(k, 1, bytearray(c)) for k, c in (("3", mp3()), ("4", mp3(b"Xing")), ("cut", id3v2()[:60]), ("none", b"\xff\xfb"))], "path string, length bigint, content binary")
    rows = containers.id3v2_frames(files).collect()
    for path in ("3", "4"):
        own = {r["id"]: r for r in rows if r["path"] == path}
        assert (own["TXXX"]["description"], own["TXXX"]["value"]) == ("Käy", "Välue")
        assert (own["COMM"]["language"], own["COMM"]["description"], own["COMM"]["value"]) == ("eng", "short", "long text")
        picture = own["APIC"]
        assert (picture["mime_type"], picture["description"], picture["value"], picture["size"], picture["sha256"]) == ("image/png", "cover", None, len(PICTURE), hashlib.sha256(PICTURE).hexdigest())
    assert {r["path"] for r in rows} <= {"3", "4", "cut"}


def test_headers_of_all_versions_and_layers():
    assert walk.mpa_header(bytes.fromhex("FFFB9064"), 0) == (1, 3, 128, 44100, 2, 1152, 417)
    assert walk.mpa_header(bytes.fromhex("FFFD80C0"), 0) == (1, 2, 128, 44100, 1, 1152, 417)
    assert walk.mpa_header(bytes.fromhex("FFFF9200"), 0) == (1, 1, 288, 44100, 2, 384, (12 * 288000 // 44100 + 1) * 4)
    assert walk.mpa_header(bytes.fromhex("FFF38000"), 0) == (2, 3, 64, 22050, 2, 576, 72 * 64000 // 22050)
    assert walk.mpa_header(bytes.fromhex("FFE38000"), 0)[:4] == (3, 3, 64, 11025)
    assert [walk.mpa_header(bytes.fromhex(x), 0) for x in ("FFFBF064", "FFFB0064", "FFFB9C64", "FFEB9064", "FFF99064", "00FB9064", "FFFB")] == [None] * 7


def test_broken_files_give_what_could_be_read(found):
    assert found["bad_flv"]["error"] == "broken" and found["no_tracks"]["error"] == "nothing found"
    assert found["bad_asf"]["general"]["duration_ms"] == 2000.0 and found["bad_asf"]["videos"] == []
    assert found["cut"]["general"]["duration_ms"] == 2000.0 and found["bad_mxf"]["general"]["format_profile"] == "OP-1a"


def test_sample_sizes_beyond_16_million(spark):
    count = (1 << 24) + 5
    table = struct.pack(">I", 3) * count
    file = box(b"moov", trak(1, b"vide", visual(b"avc1"), full(b"stsz", n(0) + n(count) + table)))
    assert [r[3:5] for r in walk.iso(file) if r[1] == "iso.stsz"] == [(3 * count, count)]


@pytest.mark.parametrize("name", [k for k, c in FILES.items() if c])
def test_walkers_survive_any_cut_or_flip(name):
    content = FILES[name]
    form = {"mp4": "MPEG4", "mov": "QuickTime", "mkv": "Matroska", "webm": "WebM", "ts": "MPEGTS", "ps": "MPEGPS", "flv": "FLV", "asf": "ASF", "mxf": "MXF", "avi": "AVI", "ogg": "Ogg", "amr": "AMR", "id3": "MP3", "vbr": "MP3", "vbri": "MP3", "flac": "FLAC", "dsdiff": "DSDIFF", "dst": "DSDIFF"}.get(name, "WAV" if name in ("wav", "rf64", "plain") else "Unknown")
    step = max(1, min(len(content), 1200) // 120)
    for k in range(0, min(len(content), 1200), step):
        flipped = bytearray(content)
        flipped[k] ^= 0xFF
        for data in (content[:k], bytes(flipped)):
            rows = [[None, form, len(data), t, i, kind, name, a, b, None, p] for i, (t, kind, name, a, b, p) in enumerate(walk.walk(form, data))]
            walk._codes(rows)
            assert rows[0][5] == "file"
