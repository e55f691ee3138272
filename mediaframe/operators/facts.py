"""What each row of a file (operators/walk.py) says, as facts: track, field, value, decoded by native expressions.

There is one expression for each kind of row. Of facts about the same field the one of the highest rank stands: later rows
above earlier ones, and what the container says of colours above what the bitstream says.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import codecs, headers, lookups, subtitles
from mediaframe.functions.bits import be, bits, float64, le, let, part, starts, uint
from mediaframe.functions.lookups import indexed, matrix_name, named, primaries_name, transfer_name
from mediaframe.functions.sps import CHROMA, PROFILES
from mediaframe.operators.containers import HANDLERS, ID3_TEXT, ILST, RIFF_INFO, TRACK_TYPES, id3_text, iso_language, number, text, trimmed

# Codec by stream type of transport streams, codec id of Matroska and codes of FLV, with their descriptions.
TS_TYPES = {
    0x01: ("Video", "MPEG-2 Video", "MPEG Video"), 0x02: ("Video", "MPEG-2 Video", "MPEG Video"), 0x10: ("Video", "MPEG-4 Visual", "MPEG-4 Visual"), 0x1B: ("Video", "AVC", "Advanced Video Coding"), 0x24: ("Video", "HEVC", "High Efficiency Video Coding"), 0xEA: ("Video", "VC-1", "SMPTE 421M"),
    0x03: ("Audio", "MPEG Audio", "MPEG Audio"), 0x04: ("Audio", "MPEG Audio", "MPEG Audio"), 0x0F: ("Audio", "AAC", "Advanced Audio Coding"), 0x11: ("Audio", "AAC", "Advanced Audio Coding"), 0x81: ("Audio", "AC-3", "Dolby Digital"), 0x87: ("Audio", "AC-3", "Dolby Digital"),
    0x82: ("Audio", "DTS", "DTS"), 0x85: ("Audio", "DTS", "DTS"), 0x86: ("Audio", "DTS", "DTS"), 0x90: ("Text", "PGS", "Presentation Graphic Stream"), 0x92: ("Text", "PGS", "Presentation Graphic Stream"),
}
MATROSKA = {
    "V_MPEG4/ISO/AVC": "AVC", "V_MPEGH/ISO/HEVC": "HEVC", "V_AV1": "AV1", "V_VP9": "VP9", "V_VP8": "VP8", "V_MPEG2": "MPEG-2 Video", "V_MPEG1": "MPEG-1 Video", "V_THEORA": "Theora", "V_FFV1": "FFV1", "V_PRORES": "ProRes",
    "A_AAC": "AAC", "A_AC3": "AC-3", "A_EAC3": "E-AC-3", "A_TRUEHD": "TrueHD", "A_MLP": "TrueHD", "A_DTS": "DTS", "A_FLAC": "FLAC", "A_OPUS": "Opus", "A_VORBIS": "Vorbis", "A_MPEG/L3": "MPEG Audio", "A_MPEG/L2": "MPEG Audio", "A_MPEG/L1": "MPEG Audio", "A_ALAC": "ALAC", "A_AC4": "AC-4",
    "A_PCM/INT/LIT": "PCM", "A_PCM/INT/BIG": "PCM", "A_PCM/FLOAT/IEEE": "PCM", "A_TTA1": "TTA", "A_WAVPACK4": "WavPack", "S_TEXT/UTF8": "UTF-8", "S_TEXT/ASS": "ASS", "S_TEXT/SSA": "SSA", "S_HDMV/PGS": "PGS", "S_VOBSUB": "VobSub", "S_TEXT/WEBVTT": "WebVTT",
}
MATROSKA_INFO = {
    "V_MPEG4/ISO/AVC": "Advanced Video Coding", "V_MPEGH/ISO/HEVC": "High Efficiency Video Coding", "A_AC3": "Dolby Digital", "A_EAC3": "Dolby Digital Plus", "A_DTS": "DTS Digital Surround", "A_TRUEHD": "Dolby TrueHD", "A_FLAC": "Free Lossless Audio Codec", "A_OPUS": "Opus Audio", "A_VORBIS": "Vorbis",
    "A_ALAC": "Apple Lossless", "A_AAC": "Advanced Audio Coding", "S_TEXT/UTF8": "SubRip (SRT)", "S_TEXT/ASS": "Advanced SubStation Alpha", "S_TEXT/SSA": "SubStation Alpha", "S_HDMV/PGS": "Presentation Graphic Stream", "S_VOBSUB": "DVD Subtitle", "S_TEXT/WEBVTT": "WebVTT",
}
FLV_VIDEO = {2: ("H.263", "Sorenson H.263"), 3: ("Screen video", "Screen video"), 4: ("VP6", "On2 VP6"), 5: ("VP6", "On2 VP6"), 6: ("Screen video 2", "Screen video version 2"), 7: ("AVC", "Advanced Video Coding"), 12: ("HEVC", "High Efficiency Video Coding")}
FLV_AUDIO = {
    0: ("PCM", "Linear PCM, platform endian"), 1: ("ADPCM", "ADPCM"), 2: ("MPEG Audio", "MPEG Audio Layer 3"), 3: ("PCM", "Linear PCM, little endian"), 4: ("Nellymoser", "Nellymoser"), 5: ("Nellymoser", "Nellymoser"), 6: ("Nellymoser", "Nellymoser"), 7: ("G.711", "G.711 A-law"), 8: ("G.711", "G.711 mu-law"),
    10: ("AAC", "Advanced Audio Coding"), 11: ("Speex", "Speex"), 14: ("MPEG Audio", "MPEG Audio Layer 3"),
}
FLV_RATES = (5512, 11025, 22050, 44100)
#: The container's word on colours outranks the bitstream's.
ABOVE = 1 << 40


def _columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def fact(field: str, value: Column, track: int | None = None, mark: str = "") -> Column:
    """A value under its field's name, with a mark before it: g. for the file itself, t. for track 1, ^ for a rank above the plain ones, < where the first stands and > where the largest stands."""
    return value.alias({-1: "g.", 1: "t."}.get(track, mark) + field)


def facts(track: int | None = None, **values: Column) -> list[Column]:
    return [fact(k, v, track) for k, v in values.items()]


def of(x: Column, *fields: str, track: int | None = None, **renamed: str) -> list[Column]:
    """Fields of a struct as facts, under their own names or others."""
    return [fact(f, x[f], track) for f in fields] + [fact(k, x[f], track) for k, f in renamed.items()]


def say(*values: Column) -> Column:
    """Facts as one text, those that are null left out: so that every kind of row gives the same type."""
    return F.to_json(F.struct(*values))


def found(header: Column, make) -> Column:
    """The facts of a header that is made once; none where there is no such header."""
    return let(header, lambda x: F.when(x.isNotNull(), say(*make(x))))


SOUND = ("channels", "sampling_rate")


def _fixed() -> Column:
    """Formats with headers at fixed places: one track, and the file's duration."""
    (P,) = _columns("payload")
    size, one = F.col("length"), 1
    words = subtitles.decode_text(P)
    rated = lambda x: F.when(x["bit_rate"] > 0, size * 8 / x["bit_rate"] * 1000.0)
    rules: dict[str, Column] = {}

    def sound(form: str, codec: Column | str, header: Column, fields: str, ms=None, **more) -> Column:
        def make(x: Column) -> list[Column]:
            length = ms(x) if ms else x["duration_ms"] if "duration_ms" in fields else F.lit(None)
            layout = [] if "channel_layout" in fields or "channel_layout" in more else facts(one, channel_layout=codecs.layout_of_count(x["channels"]))
            own = facts(one, kind=F.lit("Audio"), stream_id=F.lit(1), format=codec if isinstance(codec, Column) else F.lit(codec), duration_ms=length, **{k: v(x) for k, v in more.items()})
            return own + of(x, *(f for f in fields.split() if f != "duration_ms"), track=one) + layout + facts(-1, duration_ms=length)

        rules[form] = F.coalesce(rules[form], found(header, make)) if form in rules else found(header, make)

    plain = "channels sampling_rate bit_depth duration_ms"
    for form, codec, header, fields in (
        ("TrueAudio", "TTA", headers.tta(P, size), plain + " bit_rate"), ("WavPack", "WavPack", headers.wavpack(P, size), plain + " bit_rate"), ("DSF", "DSD", headers.dsf(P, size), "channels sampling_rate duration_ms bit_rate"), 
        ("AIFF", "PCM", headers.aiff(P), plain), ("CAF", "PCM", headers.caf(P), plain + " codec_id"),
    ):
        sound(form, codec, header, fields)
    sound("APE", "Monkey's Audio", headers.ape(P, size), plain + " bit_rate", format_profile=lambda x: x["profile"], compression_mode=lambda x: F.lit("Lossless"))
    sound("APE", "Monkey's Audio", headers.ape_legacy(P), plain, format_profile=lambda x: x["profile"], compression_mode=lambda x: F.lit("Lossless"))
    sound("MPC", "Musepack", headers.musepack(P), "sampling_rate duration_ms", channels=lambda x: F.lit(2), channel_layout=lambda x: codecs.layout(F.lit("2.0")))
    config = lambda x: x["channel_config"].cast("int")
    sound("AAC", "AAC", headers.adts(P), "sampling_rate bit_rate", rated, format_profile=lambda x: x["profile"], channels=lambda x: F.coalesce(named(config(x), codecs.AAC_CHANNELS), F.lit(2)), channel_layout=lambda x: codecs.layout(F.coalesce(named(config(x), codecs.AAC_LAYOUTS), F.lit("2.0"))))
    sound("AC3", "AC-3", headers.ac3(P), "sampling_rate bit_rate channels dialnorm_db", rated)
    sound("AC3", "E-AC-3", headers.eac3(P), "sampling_rate bit_rate channels dialnorm_db", rated)
    sound("DTS", "DTS", codecs.dts(P), "sampling_rate bit_rate channels bit_depth channel_layout", rated, format_profile=lambda x: x["profile"])
    fourcc = lambda x: F.coalesce(named(x["fourcc"], {"VP80": "VP8", "VP90": "VP9", "AV01": "AV1"}), x["fourcc"])
    picture = lambda x: facts(one, kind=F.lit("Video"), stream_id=F.lit(1)) + of(x, "width", "height", "frame_rate", track=one)
    rules["IVF"] = found(headers.ivf(P, size), lambda x: picture(x) + facts(one, format=fourcc(x), codec_id=x["fourcc"], duration_ms=x["duration_ms"]) + facts(-1, duration_ms=x["duration_ms"]))
    rules["Y4M"] = found(headers.y4m(P), lambda x: picture(x) + facts(one, format=F.lit("Raw Video")) + of(x, "chroma", "bit_depth", track=one))
    for form, codec, header in (("SRT", "SubRip", subtitles.srt(words)), ("WebVTT", "WebVTT", subtitles.vtt(words)), ("ASS", "ASS", subtitles.ass(words))):
        rules[form] = found(header, lambda x, codec=codec: facts(one, kind=F.lit("Text"), stream_id=F.lit(1), format=F.lit(codec), duration_ms=x["duration_ms"]) + facts(-1, duration_ms=x["duration_ms"]))
    out = F.when(F.lit(False), rules["AIFF"])
    for form, rule in rules.items():
        out = out.when(F.col("format") == form, rule)
    return out


def _sets() -> Column:
    """A parameter set's numbers (walk.SETS), which stand at the same places for all codecs, by name."""
    code = lambda k: F.get("codes", F.lit(k)).try_cast("int")
    full, one, two = code(8), code(0), code(1)
    is_avc, is_hevc = F.col("kind") == "sps.avc", F.col("kind") == "sps.hevc"
    profile = F.when(is_avc, F.coalesce(named(one, PROFILES), F.lit("High"))).when(is_hevc, F.coalesce(named(one, {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Format Range Extension"}), F.lit("Main"))).otherwise(named(one, {0: "Main", 1: "High", 2: "Professional"}))
    step = F.when(is_avc, 10).otherwise(30)
    level = F.concat(F.floor(two / step).cast("string"), F.lit("."), F.floor(two % step / (step / 10)).cast("string"))
    return say(*facts(
        bit_depth=code(3), chroma=named(code(2), CHROMA), set_width=code(4), set_height=code(5), color_range=F.when(full == 1, "Full").when(full == 0, "Limited"), color_primaries=primaries_name(code(9)), transfer=transfer_name(code(10)), matrix=matrix_name(code(11)), format_profile=profile, format_level=level,
        set_frame_rate=F.get("codes", F.lit(7)), scan_type=F.when(is_avc, F.when(code(6) == 1, "Progressive").otherwise("Interlaced")), format_tier=F.when(is_hevc, F.when(code(6) == 1, "High").otherwise("Main")), hdr_format=F.when(is_hevc, F.when(code(10) == 16, "HDR10").when(code(10) == 18, "HLG")),
    ))


def _routed() -> dict[str, Column]:
    """Private data and first payloads by the codec whose reader they go to."""
    (P,) = _columns("payload")
    aac = lambda x: of(x, *SOUND, "channel_layout", format_profile="profile")
    frame = lambda x: of(x, "sampling_rate", "channels", "bit_rate", "dialnorm_db") + facts(channel_layout=codecs.layout_of_count(x["channels"]))
    dts = lambda x: of(x, "sampling_rate", "channels", "channel_layout", "bit_rate", "bit_depth", format_profile="profile")
    head = codecs.prores_frame(P)
    return {
        "private.aac": found(codecs.aac_config(P), aac), "private.opus": found(headers.opus_head(P), lambda x: of(x, *SOUND) + facts(channel_layout=codecs.layout_of_count(x["channels"]))),
        "private.flac": found(headers.flac_streaminfo(F.when(starts(P, b"fLaC"), P).otherwise(F.concat(F.lit(b"fLaC"), P))), lambda x: of(x, *SOUND, "bit_depth") + facts(channel_layout=codecs.layout_of_count(x["channels"]), compression_mode=F.lit("Lossless"))),
        "private.alac": found(headers.alac(P), lambda x: of(x, *SOUND, "bit_depth") + facts(compression_mode=F.lit("Lossless"))), "private.av1": found(codecs.av1_config(P), lambda x: of(x, "bit_depth", "chroma", format_profile="profile")), "private.hevc": found(codecs.hevc_config(P), lambda x: of(x, "bit_depth", "chroma")),
        "private.vfw": let(F.decode(part(P, 16, 4), "ISO-8859-1"), lambda c: let(lookups.vfw_video_codec(c), lambda x: F.when(F.length(P) >= 20, say(*of(x, format="codec", format_info="info"), fact("codec_id", F.concat(F.lit("V_MS/VFW/FOURCC / "), c)))))),
        "first.adts": found(headers.adts(P), lambda x: of(x, "sampling_rate", format_profile="profile") + facts(channels=F.coalesce(named(x["channel_config"].cast("int"), codecs.AAC_CHANNELS), F.lit(2)), channel_layout=codecs.layout(F.coalesce(named(x["channel_config"].cast("int"), codecs.AAC_LAYOUTS), F.lit("2.0"))))),
        "first.ac3": F.coalesce(found(headers.ac3(P), frame), found(headers.eac3(P), lambda x: [*frame(x), fact("format", F.lit("E-AC-3"))])), "first.eac3": F.coalesce(found(headers.eac3(P), frame), found(headers.ac3(P), frame)), "first.dts": found(codecs.dts(P), dts), "private.dts": found(codecs.dts(P), dts),
        "first.truehd": found(codecs.truehd(P), lambda x: of(x, *SOUND, "channel_layout", "bit_depth", format_profile="profile")), "first.mpa": found(headers.mpa(P), lambda x: of(x, *SOUND, "bit_rate") + facts(format_profile=F.lit("Layer 3"), channel_layout=codecs.layout_of_count(x["channels"]))),
        "first.mpeg": found(codecs.mpeg2_sequence(P), lambda x: of(x, "chroma", "frame_rate", format_version="version", format_profile="profile", set_width="width", set_height="height")), "first.vp9": found(codecs.vp9_frame(P), lambda x: of(x, "bit_depth", "chroma", "color_range", format_profile="profile")),
        "first.visual": say(fact("format_profile", codecs.mpeg4_visual_profile(P)), fact("chroma", F.lit("4:2:0"))), "first.cineform": found(codecs.cineform(P), lambda x: of(x, "bit_depth", "chroma", set_width="width", set_height="height")),
        "first.prores": found(head, lambda x: of(x, "chroma", "scan_type", "scan_order", "matrix", "transfer", format_version="version", color_primaries="primaries", encoded_library="encoder", set_width="width", set_height="height")),
    }


def _kinds() -> dict[str, Column]:
    P, A, B, NAME = _columns("payload", "a", "b", "name")
    version = be(P, 0, 1)
    by = lambda zero, one: F.when(version == 1, one).otherwise(zero)
    ms = lambda units, scale: F.when(scale > 0, units / scale * 1000.0)
    latin = lambda at, n: F.decode(part(P, at, n), "ISO-8859-1")
    fixed16 = lambda at: F.floor(be(P, at, 4) / 65536)
    number_of = lambda at: be(P, at, 2)
    second = number_of(16) == 2
    wide = F.when(second, be(P, 48, 4)).otherwise(number_of(24))
    aac = lambda x: F.coalesce(codecs.aac_config(x["config"]))
    seconds = F.when(B > A, (B - A) / 90.0)
    out = {
        "file": _fixed(), "sps": _sets(), "broken": say(fact("broken", F.lit("yes"))),
        "iso.ftyp": say(*facts(codec_id=latin(0, 4), format_profile=lookups.brand_name(latin(0, 4)), format_version=be(P, 4, 4))), "iso.mvhd": say(fact("duration_ms", ms(by(be(P, 16, 4), be(P, 24, 8)), by(be(P, 12, 4), be(P, 20, 4))))),
        "iso.tkhd": say(*facts(stream_id=by(be(P, 12, 4), be(P, 20, 4)), default_flag=bits(P, 31, 1) == 1, track_width=by(fixed16(76), fixed16(88)), track_height=by(fixed16(80), fixed16(92)))),
        "iso.mdhd": say(*facts(duration_ms=ms(by(be(P, 16, 4), be(P, 24, 8)), by(be(P, 12, 4), be(P, 20, 4))), timescale=by(be(P, 12, 4), be(P, 20, 4)), language=iso_language(by(be(P, 20, 2), be(P, 32, 2))))),
        "iso.hdlr": say(fact("kind", named(latin(8, 4), HANDLERS))), "iso.stsz": say(*facts(stream_size=A, frame_count=B)), "iso.stts": say(*facts(samples=A, units=B, frame_rate_mode=NAME)), "iso.chunks": say(fact("first_chunk", A)),
        "iso.entry": say(*facts(
            codec_id=NAME, video_format=lookups.iso_video_codec(NAME)["codec"], video_info=lookups.iso_video_codec(NAME)["info"], audio_format=lookups.iso_audio_codec(NAME)["codec"], audio_info=lookups.iso_audio_codec(NAME)["info"], coded_width=number_of(32), coded_height=number_of(34), channels=F.nullif(wide, F.lit(0)),
            channel_layout=codecs.layout_of_count(wide), bit_depth_of_entry=F.nullif(number_of(26), F.lit(0)), sampling_rate=F.when(second, float64(P, 40).cast("bigint")).otherwise(F.nullif(number_of(32), F.lit(0))), pcm_profile=lookups.pcm_profile(NAME),
        )),
        "iso.tag": say(*(fact(k, F.when((named(NAME, ILST) == k) & A.isin(0, 1), text(P)), -1) for k in ("title", "artist", "album", "genre"))),
        "iso.hvcC": found(codecs.hevc_config(P), lambda x: of(x, "bit_depth", "chroma")), "iso.av1C": found(codecs.av1_config(P), lambda x: of(x, "bit_depth", "chroma", format_profile="profile")),
        "iso.vpcC": found(codecs.vp_config(P), lambda x: of(x, "bit_depth", "chroma", "color_range", "transfer", "matrix", format_profile="profile", color_primaries="primaries")), "iso.dac3": found(codecs.ac3_config(P), lambda x: of(x, *SOUND, "channel_layout", "bit_rate", "bit_rate_mode")),
        "iso.dec3": found(codecs.eac3_config(P), lambda x: of(x, *SOUND, "channel_layout", "bit_rate")), "iso.dOps": found(codecs.opus_config(P), lambda x: of(x, *SOUND, "channel_layout")),
        "iso.dfLa": found(headers.flac_streaminfo(F.concat(F.lit(b"fLaC"), part(P, 4, 1024))), lambda x: of(x, *SOUND, "bit_depth") + facts(channel_layout=codecs.layout_of_count(x["channels"]))), "iso.alac": found(headers.alac(part(P, 4, 64)), lambda x: of(x, *SOUND, "bit_depth")),
        "iso.esds": found(codecs.esds(P), lambda x: [
            fact("bit_rate", x["avg_bit_rate"]), fact("object_type", F.hex(x["object_type"])), fact("visual_profile", codecs.mpeg4_visual_profile(x["config"])),
            *(fact(k, aac(x)[f]) for k, f in (("aac_profile", "profile"), ("aac_rate", "sampling_rate"), ("aac_channels", "channels"), ("aac_layout", "channel_layout"), ("aac_type", "object_type"))),
        ]),
        "iso.colr": found(codecs.colour_box(P), lambda x: [fact(k, x[f], mark="^") for k, f in (("color_primaries", "primaries"), ("transfer", "transfer"), ("matrix", "matrix"), ("color_range", "color_range"))]), "iso.pasp": say(fact("pixel_aspect", codecs.pixel_aspect(P))),
        "iso.dvcC": found(codecs.dolby_vision_config(P), lambda x: facts(dolby_vision=F.concat_ws(".", x["profile"].cast("string"), x["level"].cast("string")))), "iso.dvvC": found(codecs.dolby_vision_config(P), lambda x: facts(dolby_vision=F.concat_ws(".", x["profile"].cast("string"), x["level"].cast("string")))),
        # Matroska
        "mkv.4282": say(fact("doc_type", text(P))), "mkv.2AD7B1": say(fact("timecode_scale", uint(P))), "mkv.4489": say(fact("ticks", number(P))), "mkv.7BA9": say(fact("title", text(P))), "mkv.4D80": say(fact("encoded_library", text(P))), "mkv.5741": say(fact("encoded_application", text(P))),
        "mkv.83": say(fact("kind", named(uint(P).cast("int"), TRACK_TYPES))), "mkv.D7": say(fact("stream_id", uint(P))), "mkv.86": say(*facts(codec_id=text(P), format=F.coalesce(named(text(P), MATROSKA), F.when(text(P).startswith("V_MPEG4/ISO/"), "MPEG-4 Visual"), F.regexp_replace(text(P), "^[VAS]_", "")), format_info=named(text(P), MATROSKA_INFO))),
        "mkv.22B59C": say(fact("language", text(P))), "mkv.536E": say(fact("track_title", text(P))), "mkv.23E383": say(fact("frame_rate", F.when(uint(P) > 0, 1e9 / uint(P)))), "mkv.88": say(fact("default_flag", uint(P) != 0)), "mkv.55AA": say(fact("forced_flag", uint(P) != 0)),
        "mkv.9A": say(fact("scan_type", named(uint(P).cast("int"), {1: "Interlaced", 2: "Progressive"}))), "mkv.9D": say(fact("scan_order", named(uint(P).cast("int"), {1: "TFF", 9: "TFF", 6: "BFF", 14: "BFF"}))), "mkv.B5": say(fact("sampling_rate", number(P).cast("bigint"))),
        **{f"mkv.{k}": say(fact(f, uint(P))) for k, f in (("B0", "width"), ("BA", "height"), ("54B0", "shown_width"), ("54BA", "shown_height"), ("9F", "channels"), ("6264", "bit_depth"), ("55BC", "max_cll"), ("55BD", "max_fall"))},
        "mkv.55B9": say(fact("color_range", named(uint(P).cast("int"), {1: "Limited", 2: "Full"}), mark="^")), "mkv.55BA": say(fact("transfer", transfer_name(uint(P)), mark="^")), "mkv.55BB": say(fact("color_primaries", primaries_name(uint(P)), mark="^")),
        "mkv.55B1": say(fact("matrix", matrix_name(uint(P)), mark="^")), "mkv.sum": say(*facts(blocks=A, stream_size=B)), "mkv.B6": say(fact("chapter", F.lit("yes"))), "mkv.91": say(fact("chapter_start", F.when(F.length(P).isin(4, 8), uint(P)))), "mkv.85": say(fact("chapter_title", text(P))),
        # RIFF
        "riff.avih": say(fact("duration_ms", F.when(le(P, 0, 4) > 0, le(P, 0, 4) * le(P, 16, 4) / 1000.0))), "riff.strh": say(*facts(kind=named(latin(0, 4), {"vids": "Video", "auds": "Audio", "txts": "Text"}), frame_rate_of=F.when((le(P, 20, 4) > 0) & (le(P, 24, 4) > 0), le(P, 24, 4) / le(P, 20, 4)), frame_count=le(P, 32, 4))),
        "riff.strf": say(*facts(avi_code=F.nullif(F.trim(F.replace(latin(16, 4), F.lit("\0"), F.lit(""))), F.lit("")), coded_width=le(P, 4, 4), coded_height=F.when(le(P, 8, 4) >= 1 << 31, (1 << 32) - le(P, 8, 4)).otherwise(le(P, 8, 4)), format_tag=le(P, 0, 2), channels=le(P, 2, 2), sampling_rate=le(P, 4, 4), byte_rate=le(P, 8, 4), bit_depth_of_entry=F.nullif(le(P, 14, 2), F.lit(0)))),
        "riff.fmt": let(F.when(le(P, 0, 2) == 0xFFFE, F.coalesce(le(P, 24, 2), le(P, 0, 2))).otherwise(le(P, 0, 2)), lambda tag: say(*facts(
            kind=F.lit("Audio"), stream_id=F.lit(1), format=lookups.wave_format(tag)["codec"], format_info=lookups.wave_format(tag)["info"], codec_id=le(P, 0, 2), channels=le(P, 2, 2), sampling_rate=le(P, 4, 4), bit_rate=F.nullif(le(P, 8, 4) * 8, F.lit(0)), bit_depth=F.when(le(P, 0, 2) == 0xFFFE, F.nullif(le(P, 18, 2), F.lit(0))).otherwise(F.nullif(le(P, 14, 2), F.lit(0))),
            channel_layout=F.coalesce(_masked(le(P, 20, 4), le(P, 0, 2)), codecs.layout_of_count(le(P, 2, 2))),
        ))),
        "riff.data": say(fact("stream_size", A)), "riff.sum": say(fact("stream_size", A)), "riff.info": say(*(fact(k, F.when(named(NAME, RIFF_INFO) == k, F.trim(text(P)))) for k in ("title", "artist", "album", "genre", "encoded_application"))),
        # Packets
        "ts.clock": say(fact("duration_ms", seconds)), "ts.stream": let(NAME.cast("int"), lambda t: say(*facts(codec_id=NAME, kind=named(t, {k: v[0] for k, v in TS_TYPES.items()}), format=named(t, {k: v[1] for k, v in TS_TYPES.items()}), format_info=named(t, {k: v[2] for k, v in TS_TYPES.items()}), stream_size=A, frame_count=F.when(B > 0, B)))),
        "ps.times": say(fact("duration_ms", seconds, mark="^")), "ps.clocks": say(fact("duration_ms", seconds)),
        "ps.stream": say(*facts(
            kind=F.when(F.col("track").between(0xE0, 0xEF), "Video").when(F.col("track").between(0x120, 0x13F), "Text").otherwise("Audio"), codec_id=F.lpad(F.hex("track"), 2, "0"), stream_id=F.col("track"), stream_size=A,
            format=F.when(NAME == "avc", "AVC").when(F.col("track").between(0xE0, 0xEF), "MPEG-2 Video").when(F.col("track").between(0xC0, 0xDF), "MPEG Audio").when(F.col("track").between(0x180, 0x187), "AC-3").when(F.col("track").between(0x188, 0x18F), "DTS").when(F.col("track").between(0x1A0, 0x1AF), "PCM").when(F.col("track").between(0x120, 0x13F), "VobSub"),
        )),
        "ogg.head": say(*_ogg()), "ogg.last": say(fact("granule", A)),
        "flv.flags": say(*facts(flv_flags=A)), "flv.last": say(fact("last_ms", A)), "flv.sum": say(fact("stream_size", A)), "flv.meta": say(*(fact("meta_" + k, F.when(NAME == k, F.regexp_replace(F.make_valid_utf8(P.cast("string")), "^[a-z]+:", ""))) for k in ("duration", "width", "height", "framerate", "videodatarate", "audiodatarate", "encoder"))),
        "flv.tag": F.when(F.col("track") == 9, let((A.bitwiseAND(15)).cast("int"), lambda c: say(*facts(kind=F.lit("Video"), codec_id=c, format=F.coalesce(named(c, {k: v[0] for k, v in FLV_VIDEO.items()}), F.concat(F.lit("FLV codec "), c.cast("string"))), format_info=named(c, {k: v[1] for k, v in FLV_VIDEO.items()}))))).otherwise(
            let(F.shiftright(A, 4).cast("int"), lambda c: say(*facts(kind=F.lit("Audio"), codec_id=c, format=F.coalesce(named(c, {k: v[0] for k, v in FLV_AUDIO.items()}), F.concat(F.lit("FLV codec "), c.cast("string"))), format_info=named(c, {k: v[1] for k, v in FLV_AUDIO.items()}), sampling_rate=F.when(c != 10, indexed(F.shiftright(A, 2).bitwiseAND(3), FLV_RATES)), channels=F.when(c != 10, A % 2 + 1), bit_depth=F.when(c != 10, F.when(F.shiftright(A, 1) % 2 == 1, 16).otherwise(8)))))),
        "asf.file": let(le(P, 40, 8) / 10000.0, lambda played: say(*facts(duration_ms=F.when(le(P, 40, 8) > 0, F.when(played > le(P, 56, 8), played - le(P, 56, 8)).otherwise(played)), overall_bitrate=F.nullif(le(P, 76, 4), F.lit(0))))), "asf.rate": say(fact("bit_rate", A, mark="^")), "asf.sum": say(*facts(stream_size=A, frame_count=F.when(B > 0, B))), "asf.times": say(*facts(first_ms=A, last_ms=B)),
        "asf.extended": say(*facts(frame_rate=F.when(B > 0, 1e7 / B), average_rate=F.nullif(A, F.lit(0)))), "asf.content": say(*facts(title=text(part(P, 10, le(P, 0, 2)), "UTF-16LE"), artist=text(part(P, 10 + le(P, 0, 2), le(P, 2, 2)), "UTF-16LE"))),
        "asf.text": say(*(fact(k, F.when(NAME == n, text(P, "UTF-16LE"))) for k, n in (("album", "WM/AlbumTitle"), ("genre", "WM/Genre"), ("recorded_date", "WM/Year"), ("encoded_application", "WM/EncodingSettings")))),
        "asf.stream": let(named(F.hex(part(P, 0, 16)), {"409E69F84D5BCF11A8FD00805F5C442B": "Audio", "C0EF19BC4D5BCF11A8FD00805F5C442B": "Video"}), lambda k: say(*facts(
            kind=k, stream_id=F.col("track"), format=F.when(k == "Audio", lookups.wave_format(le(P, 54, 2))["codec"]).otherwise(lookups.avi_video_codec(latin(81, 4))["codec"]), format_info=F.when(k == "Audio", lookups.wave_format(le(P, 54, 2))["info"]).otherwise(lookups.avi_video_codec(latin(81, 4))["info"]), codec_id=F.when(k == "Audio", F.hex(le(P, 54, 2))).otherwise(F.trim(latin(81, 4))),
            channels=F.when(k == "Audio", le(P, 56, 2)), sampling_rate=F.when(k == "Audio", le(P, 58, 4)), bit_rate=F.when(k == "Audio", le(P, 62, 4) * 8), bit_depth=F.when(k == "Audio", F.nullif(le(P, 68, 2), F.lit(0))), width=F.when(k == "Video", le(P, 54, 4)), height=F.when(k == "Video", le(P, 58, 4)),
        ))),
        # MXF: sets by tag
        "mxf.partition": say(fact("format_profile", lookups.operational_pattern(P))), "mxf.sum": say(fact("stream_size", A)), "mxf.first": say(fact("vc3_version", codecs.vc3_version(P))), "mxf.video": _mxf_video(), "mxf.sound": _mxf_sound(),
        "mxf.track": say(fact("edit_rate", F.when((NAME == "4B01") & (be(P, 4, 4) > 0) & (be(P, 0, 4) > 0), be(P, 0, 4) / be(P, 4, 4)), mark="<")), "mxf.clip": say(fact("edit_units", F.when(NAME == "0202", be(P, 0, 8)), mark=">")),
        "dsdiff.FSAM": let(be(P, 0, 4), lambda r: say(*facts(sampling_rate=r, format_info=F.coalesce(named(r.cast("int"), {2822400: "DSD64 (1-bit / 2.8224 MHz)", 5644800: "DSD128 (1-bit / 5.6448 MHz)", 11289600: "DSD256 (1-bit / 11.2896 MHz)"}), F.lit("DSD (1-bit)"))))),
        "dsdiff.CHNL": say(*facts(channels=be(P, 0, 2), channel_layout=codecs.layout(F.when(be(P, 0, 2) == 1, "1.0").when(be(P, 0, 2) == 6, "5.1").otherwise("2.0")))), "dsdiff.CMPR": say(*(fact(k, F.when(starts(P, b"DST "), v), mark="^") for k, v in (("compression_mode", "Lossless (Direct Stream Transfer)"), ("format_info", "DST Compressed DSD")))),
        "said": NAME, "flac.sound": say(fact("stream_size", A)), "picture": say(fact("cover_art_present", F.lit("true"))), "vorbis": say(*(fact(k, F.when(NAME == n, F.make_valid_utf8(P.cast("string")))) for k, n in (("title", "TITLE"), ("artist", "ARTIST"), ("album", "ALBUM"), ("genre", "GENRE"), ("recorded_date", "DATE")))),
        "flac.info": found(headers.flac_streaminfo(F.concat(F.lit(b"fLaC"), P)), lambda x: facts(kind=F.lit("Audio"), stream_id=F.lit(1), format=F.lit("FLAC"), format_info=F.lit("Free Lossless Audio Codec"), duration_ms=x["duration_ms"]) + facts(-1, duration_ms=x["duration_ms"])),
        "id3": let(F.when(NAME.startswith("T"), trimmed(id3_text(be(P, 0, 1), F.substring(P, F.lit(2), F.length(P))))), lambda v: say(fact("cover_art_present", F.when(NAME == "APIC", "true")), *(fact(k, F.when(named(NAME, ID3_TEXT) == n, v)) for k, n in (("title", "title"), ("artist", "artist"), ("album", "album"), ("genre", "genre"), ("recorded_date", "year"))))),
        "mxf.ident": say(*(fact(k, F.when(NAME == t, text(P, "UTF-16BE"))) for k, t in (("encoded_library", "3C01"), ("encoded_application", "3C02")))), "amr.frames": say(*facts(kind=F.lit("Audio"), stream_id=F.lit(1), format=NAME, channels=F.lit(1), channel_layout=codecs.layout(F.lit("1.0")), sampling_rate=F.when(NAME == "AMR-WB", 16000).otherwise(8000), duration_ms=A * 20.0), fact("duration_ms", A * 20.0, -1)),
        "sup.last": say(*facts(kind=F.lit("Text"), stream_id=F.lit(1), format=F.lit("PGS"), duration_ms=F.when(A > 0, A / 90.0)), fact("duration_ms", F.when(A > 0, A / 90.0), -1)),
    }
    return out | _routed()


def _masked(mask: Column, tag: Column) -> Column:
    """The layout of an extensible header's speaker mask."""
    names = {0x4: "1.0", 0x3: "2.0", 0xB: "2.1", 0x7: "3.0", 0x33: "4.0", 0x107: "4.0", 0x3F: "5.1", 0x60F: "5.1", 0x63F: "7.1", 0xFF: "7.1"}  # Fixed values: masks
    return F.when(tag == 0xFFFE, codecs.layout(named(mask.cast("int"), names)))


def _ogg() -> list[Column]:
    (P,) = _columns("payload")
    opus, vorbis, theora, flac = starts(P, b"OpusHead"), starts(P, b"\x01vorbis"), starts(P, b"\x80theora"), starts(P, b"\x7fFLAC")
    picture, sound = headers.theora(P), headers.flac_streaminfo(part(P, 9, 64))
    rate = F.when(opus, 48000).when(vorbis, le(P, 12, 4)).when(flac, sound["sampling_rate"])
    channels = F.when(opus, be(P, 9, 1)).when(vorbis, be(P, 11, 1)).when(flac, sound["channels"])
    codec = F.when(opus, "Opus").when(vorbis, "Vorbis").when(theora, "Theora").when(flac, "FLAC")
    return facts(
        kind=F.when(theora, "Video").when(codec.isNotNull(), "Audio"), format=codec, channels=channels, channel_layout=codecs.layout_of_count(channels), sampling_rate=rate, width=picture["width"], height=picture["height"], frame_rate=picture["frame_rate"], chroma=picture["chroma"],
        pixel_aspect=picture["pixel_aspect"], bit_depth=F.when(theora, 8).when(flac, sound["bit_depth"]), shift=F.when(theora, F.shiftleft(be(P, 40, 1).bitwiseAND(3), 3) + F.shiftright(be(P, 41, 1), 5)), bit_rate=F.when(vorbis, F.nullif(le(P, 20, 4), F.lit(0))),
    )


def _mxf_video() -> Column:
    P, NAME = _columns("payload", "name")
    tag = lambda t, value: F.when(NAME == t, value)
    four, ratio = be(P, 0, 4), F.when(be(P, 4, 4) > 0, be(P, 0, 4) / be(P, 4, 4))
    codec = lookups.mxf_video_codec(P)
    tail = F.concat_ws("-", *(F.hex(part(P, 8 + 4 * k, 4)) for k in range(2)))
    return say(*facts(
        kind=F.lit("Video"), stream_id=F.lit(1), width=tag("3203", four), height=tag("3202", four), frame_rate=tag("3001", ratio), scan_type=tag("320C", F.when(be(P, 0, 1) == 0, "Progressive").otherwise("Interlaced")), format=tag("3201", codec["codec"]), format_info=tag("3201", codec["info"]),
        format_profile=tag("3201", codec["profile"]), picture_label=tag("3201", tail), container_label=tag("3004", tail), bit_depth=tag("3301", F.when(four.between(8, 16), four)), across=tag("3302", four), down=tag("3308", four), display_aspect=tag("320E", ratio), bit_rate=tag("BITRATE", F.nullif(four, F.lit(0))),
        scan_order=F.when(NAME == "3212", F.when(be(P, 0, 1) == 2, "BFF").otherwise("TFF")).when((NAME == "320D") & (be(P, 8, 4) > 0) & (be(P, 12, 4) > 0), F.when(be(P, 8, 4) < be(P, 12, 4), "TFF").otherwise("BFF")),
    ))


def _mxf_sound() -> Column:
    P, NAME = _columns("payload", "name")
    tag = lambda t, value: F.when(NAME == t, value)
    four = be(P, 0, 4)
    return say(*facts(
        kind=F.lit("Audio"), stream_id=F.lit(2), format=F.lit("PCM"), sampling_rate=tag("3D03", F.when(be(P, 4, 4) > 0, F.floor(four / be(P, 4, 4)))), channels=tag("3D07", four), channel_layout=tag("3D07", codecs.layout_of_count(four)), bit_depth=tag("3D01", four), bit_rate=tag("3D09", F.nullif(four * 8, F.lit(0))),
    ))


#: Kinds of rows whose expressions are put into one column: Spark resolves a column's expression as a whole, again and again as long as anything in it changes, so many small ones are planned much faster than one large one.
TOGETHER = 8


@lru_cache(maxsize=4)
def _said(jvm: object) -> list[Column]:
    """The facts of a row as texts, by its kind, a column for every few kinds. They are built once for each JVM: they name columns only."""
    kinds = sorted(_kinds().items(), key=lambda x: x[0] == "file")
    columns = []
    for lo in range(0, len(kinds), TOGETHER):
        out = F.when(F.lit(False), F.lit(""))
        for k, expression in kinds[lo : lo + TOGETHER]:
            out = out.when(F.col("said_by") == k, expression)
        columns.append(out)
    return columns


def facts_of(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, format, length, track, field, value: of each field of a track the fact of the highest rank. A file about which nothing is said has one fact without a name.
    tasks: facts are dealt to so many by file, and what groups them by file needs no other shuffle."""
    kind = F.when(F.col("kind").isin("private", "first"), F.concat_ws(".", "kind", "name")).when(F.col("kind").startswith("sps."), "sps").otherwise(F.col("kind"))
    rows, columns = rows.withColumn("said_by", kind), _said(rows.sparkSession._jvm)
    for k, column in enumerate(columns):
        rows = rows.withColumn(f"said_{k}", column)
    said = F.map_entries(F.from_json(F.coalesce(*(F.col(f"said_{k}") for k in range(len(columns)))), "map<string,string>"))
    own = F.array(F.struct(F.lit("g.").alias("key"), F.lit("").alias("value")))
    each = rows.select("path", "format", "length", "track", "node", F.explode(F.when(F.col("kind") == "file", F.concat(own, F.coalesce(said, F.array()))).otherwise(said)).alias("f"))
    key, value = F.col("f.key"), F.col("f.value")
    rank = F.when(key.startswith("^"), F.col("node") + ABOVE).when(key.startswith("<"), -F.col("node")).when(key.startswith(">"), value.try_cast("bigint")).otherwise(F.col("node"))
    track = F.when(key.startswith("g."), -1).when(key.startswith("t."), 1).otherwise(F.col("track")).cast("bigint")
    plain = each.select("path", "format", "length", track.alias("track"), F.regexp_replace(key, r"^([gt]\.|[\^<>])", "").alias("field"), value.alias("value"), rank.alias("rank"))
    plain = plain.where("value is not null")
    plain = plain.repartition(tasks, "path") if tasks else plain
    return plain.groupBy("path", "format", "length", "track", "field").agg(F.max_by("value", "rank").alias("value"))
