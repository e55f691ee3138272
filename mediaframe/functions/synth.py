"""Bytes made from columns: what the parsers read, for tests and queries over tables that hold no files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(value: Column | int, n: int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * n, 2 * n))


def le(value: Column | int, n: int) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(n))))


def raw(data: bytes) -> Column:
    return F.lit(data)


def text(value: Column, size: int | None = None, encoding: str = "UTF-8") -> Column:
    """Encoded text, filled with zero bytes or cut to size."""
    data = F.encode(value, encoding)
    return data if size is None else F.substring(F.concat(data, F.lit(bytes(size))), 1, size)


def join(*parts: Column) -> Column:
    return F.concat(*parts)


def wav(channels: Column, rate: Column, bits: Column, data_size: Column) -> Column:
    """The 44 bytes before the samples."""
    frame = channels * F.floor(bits / 8)
    return join(raw(b"RIFF"), le(data_size + 36, 4), raw(b"WAVEfmt "), le(16, 4), le(1, 2), le(channels, 2), le(rate, 4), le(rate * frame, 4), le(frame, 2), le(bits, 2), raw(b"data"), le(data_size, 4))


def tta(channels: Column, bits: Column, rate: Column, samples: Column) -> Column:
    return join(raw(b"TTA1"), le(1, 2), le(channels, 2), le(bits, 2), le(rate, 4), le(samples, 4), raw(bytes(4)))


def ivf(fourcc: Column, width: Column, height: Column, rate: Column, scale: Column, frames: Column) -> Column:
    return join(raw(b"DKIF"), le(0, 2), le(32, 2), text(fourcc, 4), le(width, 2), le(height, 2), le(rate, 4), le(scale, 4), le(frames, 4), raw(bytes(4)))


def wavpack(version: Column, samples: Column, flags: Column) -> Column:
    return join(raw(b"wvpk"), le(24, 4), le(version, 2), le(0, 2), le(samples, 4), le(0, 4), le(0, 4), le(flags, 4), raw(bytes(4)))


def dsf(channels: Column, rate: Column, bits: Column, samples: Column) -> Column:
    return join(raw(b"DSD "), le(28, 8), le(0, 8), le(0, 8), raw(b"fmt "), le(52, 8), le(1, 4), le(0, 4), le(2, 4), le(channels, 4), le(rate, 4), le(bits, 4), le(samples, 8), le(4096, 4), raw(bytes(4)))


def ape(version: Column, level: Column, per_frame: Column, final: Column, frames: Column, bits: Column, channels: Column, rate: Column) -> Column:
    return join(raw(b"MAC "), le(version, 2), le(0, 2), le(52, 4), raw(bytes(40)), le(level, 2), le(0, 2), le(per_frame, 4), le(final, 4), le(frames, 4), le(bits, 2), le(channels, 2), le(rate, 4))


def streaminfo(low: Column, high: Column, rate: Column, channels: Column, bits: Column, samples: Column) -> Column:
    packed = F.shiftleft(rate, 44) + F.shiftleft(channels - 1, 41) + F.shiftleft(bits - 1, 36) + samples
    return join(raw(b"fLaC\x80\x00\x00\x22"), be(low, 2), be(high, 2), be(0, 3), be(0, 3), be(packed, 8), raw(bytes(16)))


def adts(profile: Column, rate_index: Column, channels: Column, frame_len: Column) -> Column:
    head = F.lit(0xFFF1 << 16) + profile * 16384 + rate_index * 1024 + channels * 64 + F.shiftright(frame_len, 11)
    return join(be(head, 4), be(F.shiftleft(frame_len.bitwiseAND(2047), 5) + 31, 2), be(252, 1))


def ac3(rate_code: Column, size_code: Column, mode: Column, lfe: Column, dialnorm: Column) -> Column:
    """Up to the dialogue level; the optional fields before the low-frequency flag are zero."""
    skip = F.when((mode % 2 == 1) & (mode != 1), 2).otherwise(0) + F.when(mode >= 4, 2).otherwise(0) + F.when(mode == 2, 2).otherwise(0)
    bits = F.concat(*(F.lpad(F.conv(v.cast("string"), 10, 2), n, "0") for v, n in ((rate_code, 2), (size_code, 6), (F.lit(8), 5), (F.lit(0), 3), (mode, 3))), F.repeat(F.lit("0"), skip), lfe.cast("string"), F.lpad(F.conv(dialnorm.cast("string"), 10, 2), 5, "0"))
    return join(raw(b"\x0b\x77\x00\x00"), F.unhex(F.lpad(F.conv(F.rpad(bits, 40, "0"), 2, 16), 10, "0")))


def mpa(rate_index: Column, sr_index: Column, padding: Column, mode: Column) -> Column:
    """The header of a frame of MPEG-1 layer 3."""
    return be(F.lit(0xFFFB0000) + rate_index * 4096 + sr_index * 1024 + padding * 512 + mode * 64, 4)


def id3v1(title: Column, artist: Column, album: Column, year: Column, comment: Column, track: Column, genre: Column) -> Column:
    latin = lambda v, n: text(v, n, "ISO-8859-1")
    return join(raw(b"TAG"), latin(title, 30), latin(artist, 30), latin(album, 30), latin(year, 4), latin(comment, 28), raw(b"\0"), be(track, 1), be(genre, 1))


def extended80(value: Column) -> Column:
    """A positive whole number below 2^32 as an 80-bit float."""
    length = F.length(F.conv(value.cast("string"), 10, 2))
    return join(be(F.lit(16382) + length, 2), be(value * F.pow(F.lit(2), 32 - length).cast("bigint"), 4), raw(bytes(4)))


def aiff(channels: Column, frames: Column, bits: Column, rate: Column) -> Column:
    comm = join(raw(b"COMM"), be(18, 4), be(channels, 2), be(frames, 4), be(bits, 2), extended80(rate))
    return join(raw(b"FORM"), be(30, 4), raw(b"AIFF"), comm)


def float64(value: Column) -> Column:
    """A positive whole number below 2^32 as a double."""
    digits = F.conv(value.cast("string"), 10, 2)
    length = F.length(digits)
    return join(be((F.lit(1022) + length) * 16 + F.conv(F.rpad(digits.substr(F.lit(2), length), 4, "0").substr(1, 4), 2, 10).cast("bigint"), 2), F.unhex(F.lpad(F.conv(F.rpad(digits.substr(F.lit(2), length), 52, "0").substr(5, 48), 2, 16), 12, "0")))


def caf(rate: Column, channels: Column, bits: Column, packets: Column, frames: Column) -> Column:
    desc = join(raw(b"desc"), be(32, 8), float64(rate), raw(b"lpcm"), be(0, 4), be(channels * F.floor(bits / 8), 4), be(1, 4), be(channels, 4), be(bits, 4))
    return join(raw(b"caff"), be(1, 2), be(0, 2), desc, raw(b"pakt"), be(24, 8), be(packets, 8), be(frames, 8), be(0, 4), be(0, 4))


def y4m(width: Column, height: Column, num: Column, den: Column, chroma: Column) -> Column:
    return F.encode(F.format_string("YUV4MPEG2 W%d H%d F%d:%d Ip A1:1 C%s\n", width, height, num, den, chroma), "UTF-8")


def digits(value: Column | int, n: int) -> Column:
    """The lowest n bits of a number as 0s and 1s."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.substring(F.lpad(F.bin(value.cast("bigint")), 64, "0"), 65 - n, n)


def ue(value: Column | int) -> Column:
    """An unsigned Exp-Golomb number as 0s and 1s."""
    value = value if isinstance(value, Column) else F.lit(value)
    ones = F.conv((value + 1).cast("string"), 10, 2)
    return F.concat(F.repeat(F.lit("0"), F.length(ones) - 1), ones)


def packed(*parts: Column) -> Column:
    """Bytes of 0s and 1s, the last one filled with 0s."""
    pieces = F.split(F.regexp_replace(F.concat(*parts), "(.{56})", "$1,"), ",")  # the parts are made once: in the lambda's body they would be for every piece
    digits = lambda x: F.substring(F.lpad(F.conv(F.rpad(x, 56, "0"), 2, 16), 14, "0"), F.lit(1), (F.ceil(F.length(x) / 8) * 2).cast("int"))
    return F.unhex(F.array_join(F.transform(pieces, digits), ""))
