"""Headers at fixed offsets as structs of native expressions; bytes that are no such header give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.bits import be, bits, extended80, float64, le, let, part, starts
from mediaframe.functions.lookups import AAC_RATES, AC3_KBPS, MP3_KBPS, MP3_RATES, WAVPACK_RATES, indexed, named


def _struct(ok: Column, **fields: Column) -> Column:
    return F.when(ok, F.struct(*(v.alias(k) for k, v in fields.items())))


def milliseconds(units: Column, per_second: Column) -> Column:
    return F.when((per_second > 0) & (units >= 0), units.cast("double") / per_second * 1000.0)


def overall_rate(size: Column, ms: Column) -> Column:
    """Bits a second, cut to a whole number; null without a positive duration."""
    return F.when(ms > 0, (size * 8 / (ms / 1000.0)).cast("bigint"))


def wav(c: Column) -> Column:
    """The canonical form: fmt of 16 bytes first, then data."""
    ok = starts(c, b"RIFF") & starts(c, b"WAVEfmt ", 8) & (le(c, 16, 4) == 16) & starts(c, b"data", 36)
    rate, size = le(c, 28, 4) * 8, le(c, 40, 4)
    channels = le(c, 22, 2)
    layout = F.when(channels == 1, "Mono").when(channels == 6, "5.1").when(channels == 8, "7.1").otherwise("Stereo")
    return _struct(ok, codec_id=le(c, 20, 2).cast("string"), channels=channels, sampling_rate=le(c, 24, 4), bit_depth=le(c, 34, 2), bit_rate=rate, duration_ms=F.when(rate > 0, size * 8 / rate * 1000.0), channel_layout=layout)


def tta(c: Column, size: Column) -> Column:
    ms = milliseconds(le(c, 14, 4), le(c, 10, 4))
    return _struct(starts(c, b"TTA1") & (F.length(c) >= 22), is_float=le(c, 4, 2) == 2, channels=le(c, 6, 2), bit_depth=le(c, 8, 2), sampling_rate=le(c, 10, 4), duration_ms=ms, bit_rate=overall_rate(size, ms))


def ivf(c: Column, size: Column) -> Column:
    rate, scale, frames = le(c, 16, 4), le(c, 20, 4), le(c, 24, 4)
    fps = F.when((scale > 0) & (rate > 0), rate.cast("double") / scale)
    ms = F.when(frames > 0, frames / fps * 1000.0)
    return _struct(starts(c, b"DKIF") & (F.length(c) >= 32), fourcc=F.decode(part(c, 8, 4), "UTF-8"), width=le(c, 12, 2), height=le(c, 14, 2), frame_rate=fps, frame_count=frames, duration_ms=ms, bit_rate=overall_rate(size, ms))


def wavpack(c: Column, size: Column) -> Column:
    version, samples, flags = le(c, 8, 2), le(c, 12, 4), le(c, 24, 4)
    rate = F.coalesce(indexed(F.shiftright(flags, 23).bitwiseAND(15), WAVPACK_RATES), F.lit(44100)).cast("bigint")
    ms = F.when((samples > 0) & (samples != 0xFFFFFFFF), milliseconds(samples, rate))
    text = F.concat_ws(".", F.shiftright(version, 8).cast("string"), version.bitwiseAND(255).cast("string"))
    on = lambda mask: flags.bitwiseAND(mask) != 0
    return _struct(starts(c, b"wvpk") & (F.length(c) >= 32), format_version=text, channels=F.when(on(4), 1).otherwise(2).cast("bigint"), bit_depth=(flags.bitwiseAND(3) + 1) * 8, sampling_rate=rate, compression=F.when(on(8), "Lossy (Hybrid)").otherwise("Lossless"), duration_ms=ms, bit_rate=overall_rate(size, ms))


def dsf(c: Column, size: Column) -> Column:
    rate = le(c, 56, 4)
    ms = F.when(le(c, 64, 8) > 0, milliseconds(le(c, 64, 8), rate))
    return _struct(starts(c, b"DSD ") & (F.length(c) >= 80), channels=le(c, 52, 4), sampling_rate=rate, multiple=F.floor(rate / 44100), duration_ms=ms, bit_rate=overall_rate(size, ms))


# Names of APE's levels of compression.
APE_LEVELS = {1000: "Fast", 2000: "Normal", 3000: "High", 4000: "Extra High", 5000: "Insane"}


def ape(c: Column, size: Column) -> Column:
    """Files of version 3.98 and later: the header follows a descriptor that tells its own length."""
    ok = starts(c, b"MAC ") & (le(c, 4, 2) >= 3980)

    def header(h: Column) -> Column:
        frames, rate = le(h, 12, 4), le(h, 20, 4)
        ms, level = milliseconds(F.when(frames > 0, (frames - 1) * le(h, 4, 4) + le(h, 8, 4)), rate), le(h, 0, 2)
        profile = F.concat(F.coalesce(named(level.cast("int"), APE_LEVELS), F.lit("Lossless")), F.lit(" (Level "), level.cast("string"), F.lit(")"))
        return _struct(ok & (F.length(h) == 24), version=le(c, 4, 2), level=level, bit_depth=le(h, 16, 2), channels=le(h, 18, 2), sampling_rate=rate, duration_ms=ms, bit_rate=overall_rate(size, ms), profile=profile)

    return let(part(c, F.greatest(le(c, 8, 4), F.lit(52)), 24), header)


def ape_legacy(c: Column) -> Column:
    """Files before version 3.98: frames of 36,864 samples at 16 bits."""
    frames, rate, level = le(c, 24, 4), le(c, 12, 4), le(c, 6, 2)
    ms = F.when((rate > 0) & (frames > 0), ((frames - 1) * 36864 + le(c, 28, 4)) / rate * 1000.0)
    ok = starts(c, b"MAC ") & (le(c, 4, 2) < 3980) & (F.length(c) >= 32)
    return _struct(ok, version=le(c, 4, 2), level=level, channels=le(c, 10, 2), sampling_rate=rate, bit_depth=F.lit(16).cast("bigint"), duration_ms=ms, profile=F.concat(F.lit("Level "), level.cast("string")))


def ixml(c: Column) -> Column:
    """Fields of an iXML chunk by its tags; trimmed, empty ones are null."""
    body = F.make_valid_utf8(c.cast("string"))
    field = lambda tag: F.nullif(F.regexp_replace(F.regexp_extract(body, f"(?s)<{tag}>(.*?)</{tag}>", 1), r"^\s+|\s+$", ""), F.lit(""))
    return F.struct(*(field(tag).alias(name) for name, tag in (("project", "PROJECT"), ("scene", "SCENE"), ("take", "TAKE"), ("tape", "TAPE"), ("notes", "NOTE"))))


def flac_streaminfo(c: Column) -> Column:
    at = 8
    packed = lambda first, n: bits(c, 8 * at + first, n)
    return _struct(starts(c, b"fLaC") & (be(c, 4, 1).bitwiseAND(127) == 0), min_block=be(c, at, 2), max_block=be(c, at + 2, 2), sampling_rate=packed(80, 20), channels=packed(100, 3) + 1, bit_depth=packed(103, 5) + 1, samples=packed(108, 36), duration_ms=milliseconds(packed(108, 36), packed(80, 20)))


def adts(c: Column) -> Column:
    index, channels = bits(c, 18, 4), bits(c, 23, 3)
    rate = F.coalesce(indexed(index, AAC_RATES), F.lit(44100)).cast("bigint")
    profile = indexed(bits(c, 16, 2), ("Main", "LC", "SSR", "LTP"))
    length = bits(c, 30, 13)
    return _struct((bits(c, 0, 12) == 0xFFF) & (F.length(c) >= 7), profile=profile, object_type=bits(c, 16, 2) + 1, sampling_rate=rate, channel_config=channels, frame_length=length, bit_rate=F.when(length > 0, F.floor(length * 8 * rate / 1024)))


def ac3(c: Column) -> Column:
    """AC-3 of bit stream versions up to 8."""
    mode, code = bits(c, 48, 3), bits(c, 34, 6)
    skip = F.when((mode % 2 == 1) & (mode != 1), 2).otherwise(0) + F.when(mode >= 4, 2).otherwise(0) + F.when(mode == 2, 2).otherwise(0)
    tail = lambda first, n: F.when(skip == 0, bits(c, first, n)).when(skip == 2, bits(c, first + 2, n)).otherwise(bits(c, first + 4, n))
    lfe = tail(51, 1)
    channels = indexed(mode, (2, 1, 2, 3, 3, 4, 4, 5)).cast("bigint") + lfe
    kbps = indexed(F.floor(code / 2), AC3_KBPS).cast("bigint")
    return _struct(starts(c, b"\x0b\x77") & (bits(c, 40, 5) <= 8), sampling_rate=indexed(bits(c, 32, 2), (48000, 44100, 32000)).cast("bigint"), bit_rate=kbps * 1000, channels=channels, lfe=lfe == 1, dialnorm_db=tail(52, 5) - 31)


def mpa(c: Column) -> Column:
    """Frames of MPEG-1 layer 3."""
    kbps = indexed(bits(c, 16, 4), MP3_KBPS).cast("bigint")
    mode = bits(c, 24, 2)
    return _struct((bits(c, 0, 11) == 0x7FF) & (bits(c, 11, 2) == 3) & (bits(c, 13, 2) == 1), bit_rate=F.when(kbps == 0, 128).otherwise(kbps) * 1000, sampling_rate=indexed(bits(c, 20, 2), MP3_RATES).cast("bigint"), channels=F.when(mode == 3, 1).otherwise(2).cast("bigint"), mode=indexed(mode, ("Stereo", "Joint Stereo", "Dual Channel", "Mono")))


def aiff(c: Column) -> Column:
    """AIFF whose first chunk is COMM."""
    rate = extended80(c, 28).cast("bigint")
    return _struct(starts(c, b"FORM") & starts(c, b"AIFFCOMM", 8), channels=be(c, 20, 2), frames=be(c, 22, 4), bit_depth=be(c, 26, 2), sampling_rate=rate, duration_ms=milliseconds(be(c, 22, 4), rate))


def caf(c: Column) -> Column:
    """CAF whose description is followed by the packet table."""
    rate, frames = float64(c, 20), be(c, 72, 8)
    return _struct(starts(c, b"caff") & starts(c, b"desc", 8), codec_id=F.decode(part(c, 28, 4), "UTF-8"), sampling_rate=rate.cast("bigint"), channels=be(c, 44, 4), bit_depth=be(c, 48, 4), duration_ms=F.when(starts(c, b"pakt", 52) & (rate > 0), frames / rate * 1000.0))


def opus_head(c: Column) -> Column:
    return _struct(starts(c, b"OpusHead") & (F.length(c) >= 19), channels=be(c, 9, 1), pre_skip=le(c, 10, 2), input_rate=le(c, 12, 4), sampling_rate=F.lit(48000).cast("bigint"))


def alac(c: Column) -> Column:
    return _struct(F.length(c) >= 24, bit_depth=be(c, 5, 1), channels=be(c, 9, 1), bit_rate=be(c, 16, 4), sampling_rate=be(c, 20, 4))


def y4m(c: Column) -> Column:
    head = F.split(F.split(F.decode(part(c, 0, 4096), "ISO-8859-1"), "\n", 2)[0], " +")
    token = lambda letter: F.get(F.transform(F.filter(F.slice(head, 2, 100), lambda t: t.startswith(letter)), lambda t: F.substring(t, 2, 1000)), F.lit(0))
    rate = F.split(token("F"), ":")
    fps = F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double"))
    chroma = F.coalesce(token("C"), F.lit("420"))
    name = F.when(chroma.startswith("444"), "4:4:4").when(chroma.startswith("422"), "4:2:2").when(chroma.startswith("411"), "4:1:1").when(chroma.startswith("mono"), "4:0:0").otherwise("4:2:0")
    depth = F.coalesce(F.nullif(F.regexp_extract(chroma, r"p(\d+)$", 1), F.lit("")).try_cast("bigint"), F.lit(8).cast("bigint"))
    return _struct(starts(c, b"YUV4MPEG2"), width=token("W").try_cast("bigint"), height=token("H").try_cast("bigint"), frame_rate=fps, chroma=name, bit_depth=depth)


def id3v1(c: Column) -> Column:
    """The last 128 bytes."""
    at = F.length(c) - 128
    tag = F.when(at >= 0, part(c, at, 128))
    text = lambda a, n: F.nullif(F.rtrim(F.split(F.decode(part(tag, a, n), "ISO-8859-1"), "\0", 2)[0]), F.lit(""))
    track = F.when((be(tag, 125, 1) == 0) & (be(tag, 126, 1) != 0), be(tag, 126, 1))
    return _struct(starts(tag, b"TAG"), title=text(3, 30), artist=text(33, 30), album=text(63, 30), year=text(93, 4), comment=text(97, 28), track=track, genre=be(tag, 127, 1))


def eac3(c: Column) -> Column:
    """E-AC-3 frames (bit stream versions from 11); the bit rate follows from the frame's size and blocks."""
    half = bits(c, 32, 2) == 3
    rate = F.when(half, F.coalesce(indexed(bits(c, 34, 2), (24000, 22050)), F.lit(16000))).otherwise(indexed(bits(c, 32, 2), (48000, 44100, 32000))).cast("bigint")
    blocks = F.when(half, 6).otherwise(indexed(bits(c, 34, 2), (1, 2, 3, 6)))
    lfe, size = bits(c, 39, 1), (bits(c, 21, 11) + 1) * 2
    channels = indexed(bits(c, 36, 3), (2, 1, 2, 3, 3, 4, 4, 5)).cast("bigint") + lfe
    return _struct(starts(c, b"\x0b\x77") & (bits(c, 40, 5) > 8), sampling_rate=rate, frame_size=size, bit_rate=F.floor(size * 8 * rate / (blocks * 256)), channels=channels, lfe=lfe == 1, dialnorm_db=bits(c, 45, 5) - 31)


def musepack(c: Column) -> Column:
    """Stream version 7: 1,152 samples a frame."""
    rate = indexed(be(c, 8, 1).bitwiseAND(3), (44100, 48000, 37800, 32000)).cast("bigint")
    return _struct(starts(c, b"MP+") & (F.length(c) >= 28), frames=le(c, 4, 4), sampling_rate=rate, duration_ms=milliseconds(le(c, 4, 4) * 1152, rate))


def theora(c: Column) -> Column:
    """The identification header: size, rate, aspect and sampling of the picture."""
    num, den, wide, high = be(c, 22, 4), be(c, 26, 4), be(c, 30, 3), be(c, 33, 3)
    chroma = indexed(F.shiftright(be(c, 41, 1), 3).bitwiseAND(3), ("4:2:0", None, "4:2:2", "4:4:4"))
    return _struct(starts(c, b"\x80theora") & (F.length(c) >= 42), width=be(c, 14, 3), height=be(c, 17, 3), frame_rate=F.when((num > 0) & (den > 0), num.cast("double") / den), pixel_aspect=F.when((wide > 0) & (high > 0), wide.cast("double") / high), bit_rate=F.nullif(be(c, 37, 3), F.lit(0)), chroma=chroma)


def xmp(c: Column) -> Column:
    """Fields of an XMP packet: elements, bare or under a known prefix, then attributes; null where there is no packet."""
    body = F.make_valid_utf8(c.cast("string"))

    def field(*names: str) -> Column:
        found = []
        for name in names:
            for prefix in ("", "tiff:", "exif:", "dc:", "xmp:", "aux:"):
                value = F.trim(F.regexp_extract(body, f"(?s)<{prefix}{name}>(.*?)</{prefix}{name}>", 1))
                found.append(F.when((value != "") & ~value.startswith("<"), value))
            found.append(F.nullif(F.trim(F.regexp_extract(body, f'{name}="([^"]*)"', 1)), F.lit("")))
        return F.coalesce(*found)

    return _struct(
        body.contains("<x:xmpmeta") | body.contains("<rdf:RDF"), make=field("Make"), model=field("Model"), lens=field("LensModel", "Lens"), create_date=field("CreateDate", "DateTimeOriginal"),
        creator=field("creator"), title=field("title"), description=field("description"), rating=field("Rating"),
    )
