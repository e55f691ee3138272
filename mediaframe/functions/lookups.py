"""Names and codes of formats, codecs and colours."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Container, its display name, its file extensions.
CONTAINERS = {
    "MPEG4": ("MPEG-4", "mp4 m4v m4a m4b mov qt"), "Matroska": ("Matroska", "mkv mka mks mk3d"), "WebM": ("WebM", "webm"), "QuickTime": ("QuickTime", "mov qt"),
    "AVI": ("AVI", "avi divx"), "WAV": ("Wave", "wav wave bwf rf64"), "MPEGTS": ("MPEG-TS", "ts m2ts mts m2t"), "BDAV": ("BDAV", "m2ts mts"),
    "MPEGPS": ("MPEG-PS", "mpg mpeg vob evob"), "FLV": ("Flash Video", "flv f4v"), "Ogg": ("Ogg", "ogg ogv oga ogx opus spx"), "MXF": ("MXF", "mxf"),
    "ASF": ("Windows Media", "asf wmv wma"), "FLAC": ("FLAC", "flac fla"), "MP3": ("MPEG Audio", "mp3 mp2 mp1 mpa"), "AAC": ("ADTS", "aac adts"),
    "AC3": ("AC-3", "ac3"), "EAC3": ("E-AC-3", "eac3 ec3"), "DTS": ("DTS", "dts dtshd dtsx"), "MPC": ("Musepack", "mpc mp+"), "CAF": ("CAF", "caf"),
    "DSF": ("Direct Stream Digital", "dsf"), "DSDIFF": ("DSDIFF", "dff"), "APE": ("Monkey's Audio", "ape"), "WavPack": ("WavPack", "wv wvc"),
    "AIFF": ("AIFF", "aif aiff aifc"), "TrueAudio": ("TTA", "tta"), "IVF": ("IVF", "ivf"), "Y4M": ("YUV4MPEG2", "y4m"), "AMR": ("AMR", "amr awb"),
    "SRT": ("SubRip", "srt"), "ASS": ("ASS", "ass ssa"), "WebVTT": ("WebVTT", "vtt"), "SUP": ("PGS", "sup"), "Unknown": ("Unknown", ""),
}
# Colour primaries, transfer characteristics and matrix coefficients by code; others are "Other". Chroma sampling by code.
PRIMARIES = {1: "BT.709", 2: "Unspecified", 5: "BT.601 PAL", 6: "BT.601 NTSC", 9: "BT.2020", 11: "DCI-P3", 12: "Display P3"}
TRANSFERS = {1: "BT.709", 2: "Unspecified", 6: "BT.601", 8: "Linear", 13: "sRGB", 14: "BT.2020", 15: "BT.2020", 16: "PQ", 18: "HLG"}
MATRICES = {0: "Identity / RGB", 1: "BT.709", 2: "Unspecified", 6: "BT.601", 8: "YCgCo", 9: "BT.2020 non-constant", 10: "BT.2020 constant", 14: "ICtCp"}
CHROMA = {0: "4:0:0", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
# Names of channel layouts.
LAYOUTS = {"1.0": "Mono (1.0)", "2.0": "Stereo (2.0)", "2.1": "2.1", "3.0": "3.0", "4.0": "4.0", "5.1": "5.1 Surround (L R C LFE Ls Rs)", "7.1": "7.1 Surround (L R C LFE Ls Rs Lb Rb)"}
# Names of ISO brands.
BRANDS = {
    "qt": "QuickTime", "isom": "Base Media", "iso2": "Base Media / Version 2", "iso4": "Base Media / Version 4", "iso5": "Base Media / Version 5", "iso6": "Base Media / Version 6", "mp41": "Base Media / Version 1",
    "mp42": "Base Media / Version 2", "M4A": "Apple audio with iTunes info", "M4B": "Apple audiobook", "M4V": "Apple video with iTunes info", "M4P": "Apple protected audio", "avc1": "JVT / AVC", "dash": "MPEG-DASH",
    "3gp4": "3GPP Media", "3gp5": "3GPP Media", "3gp6": "3GPP Media", "3gp7": "3GPP Media", "heic": "High Efficiency Image Format", "heix": "High Efficiency Image Format", "avif": "AV1 Image File Format",
}
# Codec, its description and the sample entries of ISO media that name it.
ISO_VIDEO = [
    ("AVC", "Advanced Video Coding", "avc1 avc2 avc3 avc4"), ("HEVC", "High Efficiency Video Coding", "hvc1 hev1 hvc2 hev2 dvh1 dvhe"), ("VVC", "Versatile Video Coding", "vvc1 vvi1"), ("AV1", "AOMedia Video 1", "av01"),
    ("VP9", "Google VP9", "vp09"), ("VP8", "Google VP8", "vp08"), ("ProRes", "Apple ProRes", "apco apcs apcn apch ap4h ap4x aprh aprn"), ("MPEG-4 Visual", "MPEG-4 Visual", "mp4v"),
    ("MPEG-2 Video", "MPEG-2 Video", "mpeg mp2v m2v1 hdv1 hdv2 hdv3"), ("MPEG-1 Video", "MPEG-1 Video", "mp1v"), ("VC-1", "SMPTE 421M", "vc-1 WVC1"), ("CineForm", "GoPro CineForm", "cfhd CFHD"), ("VC-3", "Avid DNxHD / DNxHR", "AVdn AVdh"),
    ("FFV1", "FFmpeg Video 1", "FFV1"), ("DV", "Digital Video", "dvc_ dvcp dvpp dv5n dv5p dvh5 dvh6 dvhq"), ("Raw Video", "Uncompressed", "raw_ 2vuy yuv2 v210 v410 r210"), ("JPEG", "Motion JPEG", "jpeg mjpa mjpb"), ("PNG", None, "png_"),
]
ISO_AUDIO = [
    ("AAC", "Advanced Audio Coding", "mp4a"), ("AC-3", "Dolby Digital", "ac-3 sac3"), ("E-AC-3", "Dolby Digital Plus", "ec-3"), ("AC-4", "Dolby AC-4", "ac-4"), ("TrueHD", "Dolby TrueHD", "mlpa"), ("ALAC", "Apple Lossless", "alac"),
    ("FLAC", "Free Lossless Audio Codec", "fLaC"), ("Opus", "Opus", "Opus"), ("DTS", "DTS", "dtsc dtse"), ("DTS-HD", "DTS-HD", "dtsh dtsl"), ("MPEG-H 3D Audio", "MPEG-H 3D Audio", "mha1 mha2 mhm1 mhm2"), ("AMR-NB", "AMR Narrowband", "samr"),
    ("AMR-WB", "AMR Wideband", "sawb"), ("MPEG Audio", "MPEG Audio Layer 3", ".mp3"), ("PCM", "Pulse Code Modulation", "twos sowt raw_ in24 in32 fl32 fl64 lpcm ipcm NONE"), ("GSM", None, "agsm"), ("ADPCM", "IMA ADPCM", "ima4"),
]
# The same for codes of AVI streams and of Matroska's compatibility mode, in upper case.
AVI_VIDEO = [
    ("AVC", "Advanced Video Coding", "H264 X264 AVC1"), ("HEVC", "High Efficiency Video Coding", "HEVC H265 X265"), ("MPEG-4 Visual", "MPEG-4 Visual", "XVID DIVX DX50 FMP4 MP4V"), ("MPEG-2 Video", "MPEG-2 Video", "MPG2 MPEG MP2V"),
    ("DV", "Digital Video", "DVSD DVC_ DVCP DV25 DV50 CDVC"), ("JPEG", "Motion JPEG", "MJPG"), ("FFV1", "FFmpeg Video 1", "FFV1"), ("CineForm", "GoPro CineForm", "CFHD"), ("VC-3", "Avid DNxHD / DNxHR", "AVDN AVDH"), ("VP8", "Google VP8", "VP80"),
    ("VP9", "Google VP9", "VP90"), ("VC-1", "SMPTE 421M", "WMV3 WVC1"), ("Raw Video", "Uncompressed RGB", "RGB_"), ("Raw Video", "Uncompressed", "UYVY YUY2 YV12 I420"),
]
VFW_VIDEO = [
    ("AVC", "Advanced Video Coding", "H264 X264 AVC1"), ("HEVC", "High Efficiency Video Coding", "HEVC H265 X265 HVC1"), ("AV1", "AOMedia Video 1", "AV01"), ("VP8", "Google VP8", "VP80"), ("VP9", "Google VP9", "VP90"), ("FFV1", "FFmpeg Video 1", "FFV1"),
    ("VC-3", "Avid DNxHD / DNxHR", "AVDN AVDH"), ("CineForm", "GoPro CineForm", "CFHD"), ("ProRes", "Apple ProRes", "APCO APCS APCN APCH AP4H AP4X"), ("DV", "Digital Video", "DVSD DVC_ DVCP DV25 DV50"), ("MPEG-2 Video", "MPEG-2 Video", "MPG2 MPEG MP2V"),
    ("MPEG-4 Visual", "MPEG-4 Visual", "XVID DIVX MP4V DX50"), ("VC-1", "SMPTE 421M", "WVC1 WMV3"), ("JPEG", "Motion JPEG", "MJPG"),
]
# Codec and description by WAVE format tag.
WAVE_FORMATS = {
    0x0001: ("PCM", "Integer PCM"), 0x0002: ("ADPCM", "MS ADPCM"), 0x0003: ("PCM", "IEEE Float"), 0x0006: ("A-law", "ITU G.711"), 0x0007: ("mu-law", "ITU G.711"), 0x0011: ("ADPCM", "IMA ADPCM"), 0x0050: ("MPEG Audio", "MPEG Audio"),
    0x0055: ("MPEG Audio", "MPEG Audio Layer 3"), 0x0092: ("AC-3", "Dolby Digital"), 0x2000: ("AC-3", "Dolby Digital"), 0x2001: ("DTS", "DTS"), 0x00FF: ("AAC", "Advanced Audio Coding"), 0x1600: ("AAC", "Advanced Audio Coding"),
    0x1601: ("AAC", "Advanced Audio Coding"), 0x0160: ("WMA", "Windows Media Audio 1"), 0x0161: ("WMA", "Windows Media Audio 2"), 0x0162: ("WMA", "Windows Media Audio Professional"), 0x0163: ("WMA", "Windows Media Audio Lossless"),
    0x674F: ("Vorbis", "Vorbis"), 0x6750: ("Vorbis", "Vorbis"), 0x6751: ("Vorbis", "Vorbis"), 0xF1AC: ("FLAC", "Free Lossless Audio Codec"), 0xFFFE: ("PCM", "PCM (Extensible)"),
}
# Byte order and sign by the sample entry of PCM; others are "Signed".
PCM_PROFILES = {"twos": "Big / Signed", "sowt": "Little / Signed", "raw ": "Little / Unsigned", "in24": "Big / Signed", "in32": "Big / Signed", "fl32": "Big / Float", "fl64": "Big / Float"}
# Sampling rates and kb/s of DTS by index.
DTS_RATES = (0, 8000, 16000, 32000, 0, 0, 11025, 22050, 44100, 0, 0, 12000, 24000, 48000, 96000, 192000)
DTS_KBPS = (32, 56, 64, 96, 112, 128, 192, 224, 256, 320, 384, 448, 512, 576, 640, 768, 896, 1024, 1152, 1280, 1344, 1408, 1411, 1472, 1536, 1920, 2048, 3072, 3840, 0, 0, 0)
# Sampling rates by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
WAVPACK_RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)
# kb/s and rates of MPEG-1 layer 3, and kb/s by AC-3 frame size code over two.
MP3_KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MP3_RATES = (44100, 48000, 32000)
AC3_KBPS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
EXTENSIONS = tuple(dict.fromkeys(e for _, names in CONTAINERS.values() for e in names.split()))


def _constant(value: dict | tuple | list, inner: type) -> Column:
    """A map with text keys, or an array, as one constant: Spark folds it once, and one call makes it, however many entries it has."""
    kind = {str: "string", int: "int", float: "double", bool: "boolean"}[inner]
    if isinstance(value, dict):
        return F.from_json(F.lit(json.dumps({str(k).lower() if isinstance(k, bool) else str(k): v for k, v in value.items()})), f"map<string,{kind}>")
    return F.from_json(F.lit(json.dumps(list(value))), f"array<{kind}>")


def named(code: Column, names: dict) -> Column:
    return _constant(names, type(next(v for v in names.values() if v is not None)))[code.cast("string")]


def indexed(index: Column, values: tuple) -> Column:
    """values[index], null outside."""
    inner = type(next(v for v in values if v is not None))
    return F.get(_constant(values, inner), index.cast("int"))


def container_name(variant: Column) -> Column:
    return named(variant, {k: v for k, (v, _) in CONTAINERS.items()})


def _colour(code: Column, names: dict) -> Column:
    return F.when(code.isNotNull(), F.coalesce(named(code.cast("int"), names), F.lit("Other")))


def primaries_name(code: Column) -> Column:
    return _colour(code, PRIMARIES)


def transfer_name(code: Column) -> Column:
    return _colour(code, TRANSFERS)


def matrix_name(code: Column) -> Column:
    return _colour(code, MATRICES)


def specified(name: Column) -> Column:
    """Null for colours that say that they aren't specified: they aren't shown."""
    return F.nullif(name, F.lit("Unspecified"))


def brand_name(brand: Column) -> Column:
    """A brand without a name is its own."""
    own = F.trim(brand)
    return F.coalesce(named(own, BRANDS), own)


def _codec(code: Column, table: list[tuple]) -> Column:
    """codec and info of a four-character code; one that isn't in the table is its own codec."""
    at = {k.replace("_", " "): row for row in table for k in row[2].split()}
    codec, info = named(code, {k: row[0] for k, row in at.items()}), named(code, {k: row[1] for k, row in at.items() if row[1]})
    return F.struct(F.coalesce(codec, F.trim(code)).alias("codec"), info.alias("info"))


def iso_video_codec(fourcc: Column) -> Column:
    return _codec(fourcc, ISO_VIDEO)


def iso_audio_codec(fourcc: Column) -> Column:
    return _codec(fourcc, ISO_AUDIO)


def avi_video_codec(fourcc: Column) -> Column:
    found = _codec(F.upper(fourcc), AVI_VIDEO)
    known = F.upper(fourcc).isin(*(k.replace("_", " ") for row in AVI_VIDEO for k in row[2].split()))
    return F.struct(F.when(known, found["codec"]).otherwise(F.rtrim(F.trim(fourcc), F.lit("\0"))).alias("codec"), found["info"].alias("info"))


def vfw_video_codec(fourcc: Column) -> Column:
    found = _codec(F.upper(fourcc), VFW_VIDEO)
    known = F.upper(fourcc).isin(*(k.replace("_", " ") for row in VFW_VIDEO for k in row[2].split()))
    return F.struct(F.when(known, found["codec"]).otherwise(F.trim(fourcc)).alias("codec"), found["info"].alias("info"))


def wave_format(tag: Column) -> Column:
    key = tag.cast("int")
    codec, info = (named(key, {k: v[i] for k, v in WAVE_FORMATS.items()}) for i in range(2))
    return F.struct(F.coalesce(codec, F.concat(F.lit("0x"), F.lpad(F.hex(tag.cast("bigint")), 4, "0"))).alias("codec"), info.alias("info"))


def pcm_profile(fourcc: Column) -> Column:
    return F.coalesce(named(fourcc, PCM_PROFILES), F.lit("Signed"))


def mxf_video_codec(ul: Column) -> Column:
    """codec, info and profile of a 16-byte label of picture coding."""
    at = lambda k: F.conv(F.hex(F.substring(ul, k + 1, 1)), 16, 10).cast("int")
    family, scheme, detail = at(12), at(13), at(14)
    # Compression families and schemes.
    mpeg = F.when(scheme == 0x32, "AVC").when(scheme == 0x33, "HEVC").when(scheme == 0x20, "MPEG-4 Visual").when(scheme == 0x10, "MPEG-1 Video").otherwise("MPEG-2 Video")
    codec = F.when(at(11) == 1, "Raw Video").when(family == 1, mpeg).when(family == 2, "DV").when((family == 3) & (scheme == 6), "ProRes").when(family == 3, "JPEG").when(family == 0x0C, "JPEG 2000").when(family == 0x71, "VC-3").otherwise("MXF Video")
    infos = {
        "Raw Video": "Uncompressed", "AVC": "Advanced Video Coding", "HEVC": "High Efficiency Video Coding", "MPEG-4 Visual": "MPEG-4 Visual", "MPEG-1 Video": "MPEG-1 Video", "MPEG-2 Video": "MPEG-2 Video", "DV": "Digital Video",
        "ProRes": "Apple ProRes", "JPEG": "Motion JPEG", "JPEG 2000": "JPEG 2000", "VC-3": "Avid DNxHD / VC-3",
    }
    codec = F.when(F.length(ul) >= 16, codec).otherwise("MXF Video")
    profile = F.when(codec == "MPEG-2 Video", F.when(detail.isin(2, 3), "High").otherwise("Main")).when(codec == "VC-3", "HD")
    return F.struct(codec.alias("codec"), named(codec, infos).alias("info"), profile.alias("profile"))


def operational_pattern(ul: Column) -> Column:
    at = lambda k: F.conv(F.hex(F.substring(ul, k + 1, 1)), 16, 10).cast("int")
    item, package = at(12), at(13)
    ok = (F.length(ul) >= 16) & (at(8) == 13) & (at(10) == 2)
    return F.when(ok, F.when(item == 16, "OP-Atom").when(item.between(1, 3) & package.between(1, 3), F.concat(F.lit("OP-"), item.cast("string"), F.char(96 + package))))


def channel_layout(channels: Column) -> Column:
    """The name for a bare number of channels; none for 0."""
    names = {1: "Mono", 2: "Stereo", 3: "2.1", 4: "4.0", 6: "5.1", 8: "7.1"}
    return F.when(channels > 0, F.coalesce(named(channels.cast("int"), names), F.concat(channels.cast("string"), F.lit(" channels"))))


def is_supported(extension: Column) -> Column:
    """Leading dots are dropped and case is ignored."""
    return F.lower(F.ltrim(extension, F.lit("."))).isin(*EXTENSIONS)


def container_extensions(spark: SparkSession) -> DataFrame:
    """format, ext, ord: a dimension table of fixed size."""
    rows = [(f, e, k) for f, (_, names) in CONTAINERS.items() for k, e in enumerate(names.split())]
    return spark.createDataFrame(rows, "format string, ext string, ord int")
