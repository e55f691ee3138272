"""Codec headers and codec configuration records as structs of native expressions; bytes that are no such header give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.bits import be, bits, bits_at, let, mpeg4_length, part, starts
from mediaframe.functions.headers import _struct
from mediaframe.functions.lookups import AAC_RATES, AC3_KBPS, CHROMA, DTS_KBPS, DTS_RATES, LAYOUTS, matrix_name, indexed, named, primaries_name, transfer_name

# Channels by AC-3 coding mode, by AAC configuration and by TrueHD modifier, with their layouts' names in LAYOUTS.
AC3_CHANNELS, AC3_LAYOUTS = (2, 1, 2, 3, 3, 4, 4, 5), ("2.0", "1.0", "2.0", "3.0", "3.0", "4.0", "4.0", "5.1")
AAC_CHANNELS, AAC_LAYOUTS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 8}, {1: "1.0", 2: "2.0", 3: "3.0", 4: "4.0", 5: "5.1", 6: "5.1", 7: "7.1"}
TRUEHD_RATES = {0: 48000, 1: 96000, 2: 192000, 8: 44100, 9: 88200, 10: 176400}
# Frame rates by code, of MPEG-2 and of ProRes.
MPEG2_FPS = (None, 24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 50.0, 60000 / 1001, 60.0)
PRORES_FPS = (None, 24 / 1.001, 24.0, 25.0, 30 / 1.001, 30.0, 50.0, 60 / 1.001, 60.0, 100.0, 120 / 1.001, 120.0)
# Fourcc of ProRes: profile, chroma sampling, bit depth, encoding of components, whether it may hold alpha.
PRORES = {
    "apco": ("422 Proxy", "4:2:2", 10, "P10LE", False), "apcs": ("422 LT", "4:2:2", 10, "P10LE", False), "apcn": ("422", "4:2:2", 10, "P10LE", False), "apch": ("422 HQ", "4:2:2", 10, "P10LE", False),
    "ap4h": ("4444", "4:4:4", 12, "P12LE", True), "ap4x": ("4444 XQ", "4:4:4", 12, "P12LE", True), "aprh": ("RAW HQ", "Other", 10, "RAW", False), "aprn": ("RAW", "Other", 10, "RAW", False),
}


def layout(name: Column) -> Column:
    return named(name, LAYOUTS)


def layout_of_count(channels: Column) -> Column:
    """The layout's name for a bare number of channels; none for 0."""
    names = {1: "1.0", 2: "2.0", 3: "2.1", 4: "4.0", 6: "5.1", 8: "7.1"}
    return F.when(channels > 0, F.coalesce(layout(named(channels.cast("int"), names)), F.concat(channels.cast("string"), F.lit(" channels"))))


def _contains(c: Column, *marks: bytes) -> Column:
    """Any of the marks at any byte."""
    return F.hex(c).rlike("^(?:..)*?(?:" + "|".join(m.hex().upper() for m in marks) + ")")


def _after(c: Column, mark: bytes, n: int) -> Column:
    """n bytes after the first place of mark; null where it isn't there or fewer follow."""
    return F.unhex(F.nullif(F.regexp_extract(F.hex(c), f"^(?:..)*?{mark.hex().upper()}(.{{{2 * n}}})", 1), F.lit("")))


# Audio ---------------------------------------------------------------------------------------------------------------


def aac_config(c: Column) -> Column:
    """AudioSpecificConfig with its extension for spectral band replication, explicit or by sync word."""
    pair = lambda rate, at: F.struct(rate.cast("bigint").alias("rate"), at.cast("int").alias("at"))
    known = lambda index: F.coalesce(indexed(index, AAC_RATES), F.lit(44100))

    def rated(at: Column, keep: Column | None = None) -> Column:
        """The rate at a place, given by its index or, as 15, in 24 bits; and the place after it."""
        plain = lambda i: F.coalesce(indexed(i, AAC_RATES).cast("bigint"), keep) if keep is not None else known(i)
        return let(bits_at(c, at, 4), lambda i: pair(F.when(i == 15, bits_at(c, at + 4, 24)).otherwise(plain(i)), at + F.when(i == 15, 28).otherwise(4)))

    def named_kind(k: Column) -> Column:
        return let(rated(k["at"]), lambda r: let(bits_at(c, r["at"], 4), lambda n: extended(k["kind"], r, n)))

    def extended(kind: Column, r: Column, n: Column) -> Column:
        more = F.when(kind.isin(5, 29), rated(r["at"] + 4, r["rate"])).otherwise(pair(r["rate"], r["at"] + 4))
        return let(more, lambda e: F.struct(kind.alias("kind"), e["rate"].alias("rate"), n.alias("config"), synced(e["at"]).alias("second")))

    def synced(at: Column) -> Column:
        """The kind of an extension that is marked by its sync word."""
        return F.when((F.length(c) * 8 - at >= 16) & (bits_at(c, at, 11) == 0x2B7), bits_at(c, at + 11, 5))

    first = let(bits(c, 0, 5), lambda f: F.struct(F.when(f == 31, 32 + bits(c, 5, 6)).otherwise(f).alias("kind"), F.when(f == 31, 11).otherwise(5).alias("at")))
    return let(let(first, named_kind), _aac)


def _aac(x: Column) -> Column:
    kind, second = x["kind"], F.coalesce(x["second"], F.lit(0))
    name = F.when((kind == 29) | (second == 29), "HE-AACv2 / LC").when((kind == 5) | (second == 5), "HE-AAC / LC").otherwise(F.coalesce(named(kind.cast("int"), {1: "Main", 2: "LC", 3: "SSR", 4: "LTP"}), F.lit("LC")))
    count, shape = (F.coalesce(named(x["config"].cast("int"), m), F.lit(d)) for m, d in ((AAC_CHANNELS, 2), (AAC_LAYOUTS, "2.0")))
    return _struct(x["rate"].isNotNull() & x["config"].isNotNull(), profile=name, object_type=kind, sampling_rate=x["rate"], channels=count, channel_layout=layout(shape))


def ac3_layout(mode: Column, lfe: Column) -> Column:
    """Channels and layout of a coding mode, with a bass channel or not."""
    return F.struct((indexed(mode, AC3_CHANNELS) + lfe.cast("int")).alias("channels"), layout(indexed(mode, AC3_LAYOUTS)).alias("channel_layout"))


def dts(c: Column) -> Column:
    """The core header, with the marks of the lossless and object extensions anywhere in the bytes."""
    sync = part(c, 0, 4)
    ok = (F.length(c) >= 16) & sync.isin(*(F.lit(s) for s in (b"\x7f\xfe\x80\x01", b"\xfe\x7f\x01\x80", b"\x1f\xff\xe8\x00", b"\xff\x1f\x00\xe8")))
    mode, rate = bits(c, 60, 6), bits(c, 70, 5)
    kbps = indexed(rate, DTS_KBPS)
    master, objects = _contains(c, b"\x64\x58\x20\x25"), _contains(c, b"\x41\xa2\x95\x47")
    channels = F.when(mode == 0, 1).when(mode <= 2, 2).otherwise(6)
    return _struct(
        ok, profile=F.when(objects, "DTS:X / DTS-HD MA").when(master, "DTS-HD Master Audio").otherwise("DTS Digital Surround"), sampling_rate=indexed(bits(c, 66, 4), DTS_RATES), bit_rate=F.when(kbps > 0, kbps * 1000).otherwise(1509000),
        channels=channels, channel_layout=layout(F.when(mode == 0, "1.0").when(mode <= 2, "2.0").otherwise("5.1")), bit_depth=F.when(master, 24).otherwise(16),
    )


def truehd(c: Column) -> Column:
    """The major sync of TrueHD or MLP within the first 4,096 places, and the marks of object audio."""
    head = part(c, 0, 4099)
    found = F.regexp_extract(F.hex(head), "^(?:..)*?F8726F(?:BA|A9)", 0)
    at = F.floor(F.length(found) / 2).cast("int") - 4
    dolby = found.endswith("BA")
    rest = part(c, at + 4, 8)
    modifier = bits(rest, 8, 5)
    channels = F.when(modifier == 1, 1).when(modifier == 2, 2).when(modifier.between(7, 12), 8).otherwise(6)
    objects = dolby & _contains(c, b"\x72\xf8\x01\x00", b"\x00\x01\xf8\x72")
    name = F.when(objects, "Dolby TrueHD with Dolby Atmos").when(dolby, "Dolby TrueHD").otherwise("Meridian Lossless Packing (MLP)")
    shape = F.when(channels == 1, "1.0").when(channels == 2, "2.0").when(channels == 8, "7.1").otherwise("5.1")
    return _struct((F.length(found) > 0) & (F.length(rest) == 8), sampling_rate=F.coalesce(named(bits(rest, 0, 4).cast("int"), TRUEHD_RATES), F.lit(48000)), channels=channels, channel_layout=layout(shape), bit_depth=F.lit(24), profile=name)


def ac4(c: Column) -> Column:
    return _struct((F.length(c) >= 8) & part(c, 0, 2).isin(F.lit(b"\xac\x40"), F.lit(b"\xac\x41")), presentations=F.greatest(F.lit(1), be(c, 2, 1).bitwiseAND(31)), sampling_rate=F.when(be(c, 3, 1) >= 128, 44100).otherwise(48000), channels=F.lit(6), channel_layout=layout(F.lit("5.1")), bit_depth=F.lit(24))


def mpegh(c: Column) -> Column:
    return _struct((F.length(c) >= 8) & (starts(c, b"MH3D") | starts(c, b"\xc0\x01\xa5")), sampling_rate=F.lit(48000), channels=F.lit(8), channel_layout=layout(F.lit("7.1")), profile=F.lit("Level 3 (Main Profile)"), objects=F.lit(16))


def pcm(bit_depth: Column, rate: Column, channels: Column, is_float: Column, big_endian: Column) -> Column:
    shape = F.coalesce(named(channels.cast("int"), {1: "1.0", 2: "2.0", 6: "5.1", 8: "7.1"}), F.lit("2.0"))
    return F.struct(bit_depth.alias("bit_depth"), rate.alias("sampling_rate"), channels.alias("channels"), layout(shape).alias("channel_layout"), is_float.alias("is_float"), big_endian.alias("big_endian"))


def ac3_config(c: Column) -> Column:
    """dac3."""
    mode, lfe = bits(c, 10, 3), bits(c, 13, 1)
    kbps = indexed(bits(c, 14, 5), AC3_KBPS)
    channels = indexed(mode, AC3_CHANNELS) + lfe
    return _struct(F.length(c) >= 3, sampling_rate=indexed(bits(c, 0, 2), (48000, 44100, 32000)), channels=channels, channel_layout=layout_of_count(channels), bit_rate=kbps * 1000, bit_rate_mode=F.when(kbps.isNotNull(), "Constant"))


def eac3_config(c: Column) -> Column:
    """dec3, with the first independent stream."""
    kbps, mode, lfe = bits(c, 3, 13), bits(c, 28, 3), bits(c, 31, 1)
    channels = indexed(mode, AC3_CHANNELS) + lfe
    return _struct(F.length(c) >= 5, sampling_rate=indexed(bits(c, 16, 2), (48000, 44100, 32000)), channels=channels, channel_layout=layout_of_count(channels), bit_rate=F.when(kbps > 0, kbps * 1000))


def opus_config(c: Column) -> Column:
    """dOps; a rate of 0 is the decoder's 48,000."""
    rate, channels = be(c, 4, 4), be(c, 1, 1)
    return _struct(F.length(c) >= 11, channels=channels, channel_layout=layout_of_count(channels), sampling_rate=F.when(rate == 0, 48000).otherwise(rate))


def esds(c: Column) -> Column:
    """object_type, avg_bit_rate and config of a descriptor tree whose stream descriptor holds the decoder's, and that its own configuration; lengths of one to four bytes."""
    body = F.when(F.length(c) > 4, part(c, 4, F.length(c) - 4)).otherwise(c)

    def inside(data: Column, tag: int, skip: int) -> Column:
        """What a descriptor of a kind at the start of data holds, after its own fields."""
        return let(data, lambda d: let(mpeg4_length(d, 1), lambda n: F.when(be(d, 0, 1) == tag, part(d, 1 + n["width"] + skip, F.greatest(n["length"] - skip, F.lit(0))))))

    decoder = let(body, lambda d: F.coalesce(inside(inside(d, 3, 3), 4, 0), inside(d, 4, 0)))
    return let(decoder, lambda d: _struct(d.isNotNull(), object_type=be(d, 0, 1), avg_bit_rate=F.when(be(d, 9, 4) > 0, be(d, 9, 4)), config=inside(part(d, 13, F.length(d)), 5, 0)))


# Video ---------------------------------------------------------------------------------------------------------------


def avc_config(c: Column) -> Column:
    """avcC: profile, level and the first parameter set."""
    n = be(c, 6, 2)
    return _struct(F.length(c) >= 8, profile_idc=be(c, 1, 1), level_idc=be(c, 3, 1), sps=F.when((n > 0) & (F.length(c) >= 8 + n), part(c, 8, n)))


def hevc_config(c: Column) -> Column:
    """hvcC: sampling and depth from the record, and its arrays of units as they follow."""
    depth = be(c, 19, 1).bitwiseAND(7) + 8
    return _struct(F.length(c) >= 23, chroma=named(be(c, 18, 1).bitwiseAND(3).cast("int"), CHROMA), bit_depth=depth, arrays=be(c, 22, 1), first_type=be(c, 23, 1).bitwiseAND(63), first_unit=part(c, 28, be(c, 26, 2)))


def dolby_vision_config(c: Column) -> Column:
    """dvcC and dvvC."""
    two, three = be(c, 2, 1), be(c, 3, 1)
    on = lambda mask: three.bitwiseAND(mask) != 0
    return _struct(F.length(c) >= 4, profile=F.shiftright(two, 1), level=F.shiftleft(two.bitwiseAND(1), 5) + F.shiftright(three, 3), rpu_present=on(4), el_present=on(2), bl_present=on(1))


def av1_config(c: Column) -> Column:
    """av1C."""
    profile, two = F.shiftright(be(c, 1, 1), 5), be(c, 2, 1)
    on = lambda mask: two.bitwiseAND(mask) != 0
    chroma = F.when(on(16), "4:0:0").when(on(8) & on(4), "4:2:0").when(on(8), "4:2:2").otherwise("4:4:4")
    return _struct(F.length(c) >= 4, profile=F.coalesce(named(profile.cast("int"), {0: "Main", 1: "High", 2: "Professional"}), F.lit("Unknown")), bit_depth=F.when(on(32), 12).when(on(64), 10).otherwise(8), chroma=chroma)


def vp_config(c: Column) -> Column:
    """vpcC."""
    depth, chroma = F.shiftright(be(c, 6, 1), 4), F.shiftright(be(c, 6, 1), 1).bitwiseAND(7)
    return _struct(
        F.length(c) >= 9, profile=be(c, 4, 1).cast("string"), bit_depth=F.when(depth.between(8, 12), depth), chroma=F.coalesce(named(chroma.cast("int"), {2: "4:2:2", 3: "4:4:4"}), F.lit("4:2:0")),
        color_range=F.when(be(c, 6, 1) % 2 == 1, "Full").otherwise("Limited"), primaries=primaries_name(be(c, 7, 1)), transfer=transfer_name(be(c, 8, 1)), matrix=matrix_name(be(c, 9, 1)),
    )


def colour_box(c: Column) -> Column:
    """colr of kinds nclx and nclc."""
    return _struct((starts(c, b"nclx") | starts(c, b"nclc")) & (F.length(c) >= 10), primaries=primaries_name(be(c, 5, 1)), transfer=transfer_name(be(c, 7, 1)), matrix=matrix_name(be(c, 9, 1)), color_range=F.when(starts(c, b"nclx"), F.when(be(c, 10, 1) >= 128, "Full").when(be(c, 10, 1) >= 0, "Limited")))


def pixel_aspect(c: Column) -> Column:
    """pasp."""
    return F.when((be(c, 0, 4) > 0) & (be(c, 4, 4) > 0), be(c, 0, 4).cast("double") / be(c, 4, 4))


def prores_fourcc(fourcc: Column) -> Column:
    field = lambda k: named(fourcc, {f: row[k] for f, row in PRORES.items()})
    return F.struct(F.coalesce(field(0), F.lit("")).alias("profile"), F.coalesce(field(1), F.lit("Other")).alias("chroma"), F.coalesce(field(2), F.lit(10)).alias("bit_depth"), field(3).alias("color_encoding"), F.coalesce(field(4), F.lit(False)).alias("has_alpha"))


def prores_frame(c: Column) -> Column:
    """A frame that begins with its size and signature; reserved values give null."""
    size, head, version = be(c, 0, 4), be(c, 8, 2), be(c, 10, 2)
    shape, aspect, alpha, flags = be(c, 20, 1), F.shiftright(be(c, 21, 1), 4), be(c, 25, 1).bitwiseAND(15), be(c, 27, 1)
    chroma, mode = F.shiftright(shape, 6), F.shiftright(shape, 2).bitwiseAND(3)
    custom = F.when(flags.bitwiseAND(2) != 0, 64).otherwise(0) + F.when(flags.bitwiseAND(1) != 0, 64).otherwise(0)
    ok = (F.length(c) >= 28) & starts(c, b"icpf", 4) & size.between(28, F.length(c)) & (head >= 20) & (version <= 1) & (head <= F.length(c) - 8) & (shape.bitwiseAND(0x33) == 0) & (chroma >= 2) & (mode != 3) & (alpha <= 2) & (flags <= 3) & (28 + custom <= 8 + head)
    width, height = be(c, 16, 2), be(c, 18, 2)
    luma = F.when(flags.bitwiseAND(2) != 0, quant_matrix(part(c, 28, 64)))
    library = F.decode(part(c, 12, 4), "ISO-8859-1")
    return _struct(
        ok, version=version, width=width, height=height, chroma=F.when(chroma == 3, "4:4:4").otherwise("4:2:2"), scan_type=F.when(mode == 0, "Progressive").otherwise("Interlaced"), scan_order=F.when(mode == 1, "TFF").when(mode == 2, "BFF"),
        display_aspect=F.when(aspect == 1, width / F.greatest(height, F.lit(1))).when(aspect == 2, 4 / 3).when(aspect == 3, 16 / 9), frame_rate=indexed(be(c, 21, 1).bitwiseAND(15), PRORES_FPS),
        primaries=primaries_name(be(c, 22, 1)), transfer=transfer_name(be(c, 23, 1)), matrix=matrix_name(be(c, 24, 1)), alpha_bit_depth=F.when(alpha == 1, 8).when(alpha == 2, 16), encoder=F.when(library.rlike("^[!-~]{4}$"), library), luma_matrix=luma,
        chroma_matrix=F.when(flags % 2 == 1, quant_matrix(part(c, F.when(flags >= 2, 92).otherwise(28), 64))),
    )


def quant_matrix(c: Column) -> Column:
    """64 values, comma-joined in scan order."""
    pairs = F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda x: F.conv(x, 16, 10)), ",")


def prores_picture(c: Column) -> Column:
    """The picture header and slice index after the frame header; null where they contradict themselves."""
    width, height, mode = be(c, 16, 2), be(c, 18, 2), F.shiftright(be(c, 20, 1), 2).bitwiseAND(3)
    data = part(c, 8 + be(c, 8, 2), F.length(c))
    head, size, log = F.shiftright(be(data, 0, 1), 3), be(data, 1, 4), F.shiftright(be(data, 7, 1), 4)
    up = lambda n, d: F.floor((n + (d - 1)) / d)
    count = up(height, F.when(mode == 0, F.lit(16)).otherwise(32)) * up(up(width, F.lit(16)), F.call_function("shiftleft", F.lit(1), log.cast("int")))
    index = F.hex(part(data, head, count * 2))
    sizes = F.transform(F.regexp_extract_all(index, F.lit("(....)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("bigint"))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    ok = (F.length(data) >= 8) & head.between(8, F.length(data)) & (size <= F.length(data)) & (log <= 3) & (be(data, 7, 1) % 16 == 0) & (head + count * 2 <= size) & (F.size(sizes) == count) & ~F.exists(sizes, lambda x: x < 6) & (head + count * 2 + total <= size)
    return _struct(ok, header_size=head, picture_size=size, declared_slices=be(data, 5, 2), slices=count, slice_bytes=total)


def vp9_frame(c: Column) -> Column:
    """The uncompressed header; as in the format that is matched, colours follow the flags at once."""
    def shape(p: Column) -> Column:
        start = F.when(p == 3, 5).otherwise(4)
        return F.struct(p.alias("profile"), bits_at(c, start, 1).alias("shown"), start.alias("at"))

    def colour(x: Column) -> Column:
        at, deep = x["at"] + 4, x["profile"] >= 2
        return F.struct(x["profile"].alias("profile"), x["shown"].alias("shown"), F.when(deep, F.when(bits_at(c, at, 1) == 1, 12).otherwise(10)).otherwise(8).alias("depth"), (at + F.when(deep, 1).otherwise(0)).alias("at"))

    return let(let(let(bits(c, 2, 1) + 2 * bits(c, 3, 1), shape), colour), lambda x: _vp9(c, x))


def _vp9(c: Column, x: Column) -> Column:
    at, shown, odd, profile = x["at"], x["shown"] == 1, x["profile"] % 2 == 1, x["profile"]
    rgb = bits_at(c, at, 3) == 7
    low, high = bits_at(c, at + 4, 1), bits_at(c, at + 5, 1)
    chroma = F.when(rgb, "RGB").when(odd & (low == 0) & (high == 0), "4:4:4").when(odd & (low == 1) & (high == 0), "4:2:2").otherwise("4:2:0")
    place = at + 3 + F.when(rgb, F.when(odd, 1).otherwise(0)).otherwise(F.when(odd, 4).otherwise(1))
    size = let(place, lambda a: F.struct((bits_at(c, a, 16) + 1).alias("w"), (bits_at(c, a + 16, 16) + 1).alias("h")))
    names = {0: "Profile 0 (8-bit 4:2:0)", 1: "Profile 1 (8-bit 4:2:2/4:4:4)", 2: "Profile 2 (10/12-bit 4:2:0)", 3: "Profile 3 (10/12-bit 4:2:2/4:4:4)"}
    name = F.when(shown, F.concat(F.lit("Profile "), profile.cast("string"))).otherwise(named(profile.cast("int"), names))
    side = lambda s, k: F.when(shown, 0).otherwise(s[k])
    return let(size, lambda s: _struct(
        (bits(c, 0, 2) == 2) & (shown | s["h"].isNotNull()), profile=name, width=side(s, "w"), height=side(s, "h"), bit_depth=F.when(shown, 8).otherwise(x["depth"]), chroma=F.when(shown, "4:2:0").otherwise(chroma),
        color_range=F.when(~shown & (rgb | (bits_at(c, at + 3, 1) == 1)), "Full").otherwise("Limited"),
    ))


def mpeg2_sequence(c: Column) -> Column:
    """The first sequence header, with its extension where there is one."""
    h, e = _after(c, b"\x00\x00\x01\xb3", 8), _after(c, b"\x00\x00\x01\xb5", 6)
    is_second = F.coalesce(bits(e, 0, 4) == 1, F.lit(False))
    code = be(e, 1, 1)
    profile = F.coalesce(named(F.shiftright(code, 4).bitwiseAND(7).cast("int"), {1: "High", 2: "Spatially Scalable", 3: "SNR Scalable", 4: "Main", 5: "Simple"}), F.lit("Main"))
    level = F.coalesce(named(code.bitwiseAND(15).cast("int"), {4: "High", 6: "High 1440", 8: "Main", 10: "Low"}), F.lit("Main"))
    chroma = F.when(is_second, named(bits(e, 17, 2).cast("int"), {2: "4:2:2", 3: "4:4:4"}))
    more = lambda first: F.when(is_second, F.shiftleft(bits(e, first, 2), 12)).otherwise(0)
    return _struct(
        (F.length(c) >= 12) & h.isNotNull(), width=bits(h, 0, 12).bitwiseOR(more(19)), height=bits(h, 12, 12).bitwiseOR(more(21)), frame_rate=F.coalesce(indexed(bits(h, 28, 4), MPEG2_FPS), F.lit(25.0)), bit_rate=bits(h, 32, 18) * 400,
        chroma=F.coalesce(chroma, F.lit("4:2:0")), version=F.when(is_second, 2).otherwise(1), profile=F.when(is_second, F.concat_ws("@", profile, level)),
    )


def cineform(c: Column) -> Column:
    """Tags of two bytes with lengths within the first 512 bytes; the last of a kind counts."""
    none = F.struct(F.lit(0).alias("at"), F.lit(1920).cast("bigint").alias("width"), F.lit(1080).cast("bigint").alias("height"), F.lit(10).alias("bit_depth"), F.lit("4:2:2").alias("chroma"), F.lit("Film Scan 1").alias("quality"))
    quality = {1: "Low", 2: "Medium", 3: "High", 4: "Film Scan 1", 5: "Film Scan 2"}

    def step(s: Column, _: Column) -> Column:
        tag, n, value = be(c, s["at"], 2), be(c, s["at"] + 2, 2), s["at"] + 4
        ok = (s["at"] >= 0) & (value <= F.least(F.length(c), F.lit(512))) & (value + n <= F.length(c))
        here = lambda t, least: F.coalesce(ok & (tag == t) & (n >= least), F.lit(False))
        return F.struct(
            F.when(ok, value + n).otherwise(-1).cast("int").alias("at"), F.when(here(1, 4), be(c, value, 2)).otherwise(s["width"]).alias("width"), F.when(here(1, 4), be(c, value + 2, 2)).otherwise(s["height"]).alias("height"),
            F.when(here(2, 1), F.when(be(c, value, 1) == 12, 12).otherwise(10)).otherwise(s["bit_depth"]).alias("bit_depth"), F.when(here(2, 2) & (be(c, value + 1, 1) == 3), "4:4:4").otherwise(s["chroma"]).alias("chroma"),
            F.when(here(3, 1), F.coalesce(named(be(c, value, 1).cast("int"), quality), F.lit("Standard"))).otherwise(s["quality"]).alias("quality"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.least(F.length(c), F.lit(512)) / 4).cast("int"))), none, step)  # a tag takes four bytes at least
    return F.when(F.length(c) >= 8, F.struct(*(found[k].alias(k) for k in ("width", "height", "bit_depth", "chroma", "quality"))))


def vc3_version(c: Column) -> Column:
    return F.when(starts(c, b"\x00\x00\x02") & (be(c, 3, 1).bitwiseAND(0xF0) == 0x80), be(c, 4, 1))


def mpeg4_visual_profile(c: Column) -> Column:
    code = be(_after(c, b"\x00\x00\x01\xb0", 1), 0, 1)
    name = F.when(code.between(0x10, 0x12), "Simple Scalable").when(code.between(0x21, 0x25), "Core").when(code.between(0x32, 0x34), "Main").when(code == 0x42, "N-bit")
    return F.when(code.isNotNull(), name.when(code.between(0xF0, 0xF5), "Advanced Simple").when(code.between(0xB1, 0xB4), "Advanced Real Time Simple").otherwise("Simple"))


def exif(c: Column) -> Column:
    """Whether a TIFF header follows, bare or after its mark."""
    at = F.when(starts(c, b"Exif\x00\x00"), 6).otherwise(0)
    order = part(c, at, 4)
    return _struct((F.length(c) >= 14) & order.isin(F.lit(b"II*\x00"), F.lit(b"MM\x00*")), software=F.lit("EXIF standard"))
