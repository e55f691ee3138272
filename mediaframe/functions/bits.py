"""Numbers, bits and bytes of binary columns, as native expressions. Offsets count from 0; a value whose bytes lie beyond the end is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(c: Column, at: int | Column, n: int | Column) -> Column:
    """n bytes from offset at."""
    if isinstance(at, int) and isinstance(n, int):
        return F.substring(c, at + 1, n)
    at, n = (x if isinstance(x, Column) else F.lit(x) for x in (at, n))
    return F.substring(c, at.cast("int") + 1, n.cast("int"))


def _number(digits: Column, n: int) -> Column:
    return F.when(F.length(digits) == 2 * n, F.conv(digits, 16, 10).try_cast("bigint"))


def be(c: Column, at: int | Column, n: int) -> Column:
    """Unsigned big-endian number of n bytes; 8 bytes beyond 2^63 - 1 are null."""
    return _number(F.hex(part(c, at, n)), n)


def le(c: Column, at: int | Column, n: int) -> Column:
    """Unsigned little-endian number of n bytes."""
    digits = F.hex(part(c, at, n))
    return _number(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n)))), n)


def signed(value: Column, n: int) -> Column:
    return F.when(value >= 1 << (8 * n - 1), value - (1 << 8 * n)).otherwise(value)


def bits(c: Column, first: int, n: int) -> Column:
    """n bits, most significant first, from bit `first`; at most 48 bits."""
    lo, hi = first // 8, (first + n + 7) // 8
    return F.shiftright(be(c, lo, hi - lo), 8 * hi - first - n).bitwiseAND((1 << n) - 1)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: for values that body names often, as places in fields of variable length."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bits_at(c: Column, first: Column, n: int) -> Column:
    """n bits from a bit whose place is a column; at most 48 bits."""
    lo = F.floor(first / 8).cast("int")
    digits = F.hex(part(c, lo, (n + 14) // 8))
    size = F.length(digits) * 4
    skip = (first % 8).cast("int")
    value = F.conv(digits, 16, 10).try_cast("bigint")
    return F.when(size >= skip + n, F.call_function("shiftright", value, (size - skip - n).cast("int")).bitwiseAND((1 << n) - 1))


def leb128(c: Column, at: int = 0) -> Column:
    """length and width (bytes taken, at most 8) of a number of seven bits a byte, the lowest first."""
    out, width, open_ = F.lit(0).cast("bigint"), F.lit(None).cast("int"), F.lit(True)
    for k in range(8):
        b = be(c, at + k, 1)
        out = out + F.when(open_, F.shiftleft(b.bitwiseAND(127), 7 * k)).otherwise(0)
        width = F.coalesce(width, F.when(open_ & ((b < 128) | (b >= 128 if k == 7 else F.lit(False))), k + 1))
        open_ = open_ & (b >= 128)
    return F.struct(F.when(width.isNotNull(), out).alias("length"), width.alias("width"))


def mpeg4_length(c: Column, at: int = 0) -> Column:
    """length and width (bytes taken, at most 4) of a number of seven bits a byte, the highest first."""
    low = [be(c, at + k, 1) for k in range(4)]
    total = lambda k: sum((F.shiftleft(low[i].bitwiseAND(127), 7 * (k - i)) for i in range(k)), low[k].bitwiseAND(127))
    width = F.when(low[0] < 128, 1).when(low[1] < 128, 2).when(low[2] < 128, 3).when(low[3].isNotNull(), 4)
    length = F.when(width == 1, total(0)).when(width == 2, total(1)).when(width == 3, total(2)).when(width == 4, total(3))
    return F.struct(length.alias("length"), width.alias("width"))


def starts(c: Column, magic: bytes, at: int = 0) -> Column:
    return part(c, at, len(magic)) == F.lit(magic)


def synchsafe28(c: Column, at: int) -> Column:
    """Four bytes of seven bits."""
    return sum((F.shiftleft(be(c, at + k, 1).bitwiseAND(127), 21 - 7 * k) for k in range(1, 4)), F.shiftleft(be(c, at, 1).bitwiseAND(127), 21))


def timestamp33(c: Column, at: int) -> Column:
    """A 33-bit time stamp in five bytes with marker bits."""
    high, mid, low = be(c, at, 1), be(c, at + 1, 2), be(c, at + 3, 2)
    return F.shiftleft(F.shiftright(high, 1).bitwiseAND(7), 30) + F.shiftleft(F.shiftright(mid, 1), 15) + F.shiftright(low, 1)


def vint_width(c: Column, at: int = 0) -> Column:
    """Bytes of an EBML number: leading zero bits of the first byte and one."""
    first = be(c, at, 1)
    out = F.lit(None).cast("int")
    for k in range(1, 9):
        out = F.coalesce(out, F.when(first >= 1 << (8 - k), k))
    return out


def vint(c: Column, at: int = 0) -> Column:
    """An EBML size of up to 8 bytes; all ones, an unknown size, is null."""
    width, out = vint_width(c, at), F.lit(None).cast("bigint")
    for k in range(1, 9):
        ones = (1 << 7 * k) - 1
        out = F.when(width == k, F.nullif(be(c, at, k).bitwiseAND(ones), F.lit(ones))).otherwise(out)
    return out


def binary_digits(c: Column) -> Column:
    """The first 7 bytes as 0s and 1s."""
    head = part(c, 0, 7)
    return F.when(F.length(head) > 0, F.lpad(F.conv(F.hex(head), 16, 2), 8 * 7, "0").substr(F.lit(57) - 8 * F.length(head), F.lit(56)))


def ue(c: Column) -> Column:
    """An unsigned Exp-Golomb number at the start of c, of up to 31 leading zeros."""
    digits = F.rpad(F.hex(part(c, 0, 8)), 16, "0")
    ones = F.lpad(F.conv(digits, 16, 2), 64, "0")
    zeros = F.instr(ones, "1") - 1
    return F.when(zeros.between(0, 31), F.conv(ones.substr(zeros + 1, zeros + 1), 2, 10).cast("bigint") - 1)


def se(c: Column) -> Column:
    k = ue(c)
    return F.when(k % 2 == 1, F.floor((k + 1) / 2)).otherwise(-F.floor(k / 2)).cast("bigint")


def unescape_nal(c: Column) -> Column:
    """Drops emulation bytes: 00 00 03 becomes 00 00, from the left, at byte bounds."""
    spaced = F.regexp_replace(F.hex(c), "(..)", "$1 ")
    return F.unhex(F.replace(F.regexp_replace(spaced, "00 00 03 ", "00 00 "), F.lit(" "), F.lit("")))


def ber_length(c: Column, at: int) -> Column:
    first = be(c, at, 1)
    out = F.when(first < 128, first)
    for k in range(1, 8):
        out = F.when(first == 128 + k, be(c, at + 1, k)).otherwise(out)
    return out


def extended80(c: Column, at: int) -> Column:
    """An 80-bit float as a double; sign and infinities aside, as sampling rates need."""
    exponent, high, low = be(c, at, 2).bitwiseAND(0x7FFF), be(c, at + 2, 4), be(c, at + 6, 4)
    return F.when((exponent == 0) & (high == 0) & (low == 0), 0.0).otherwise((high.cast("double") * 4294967296.0 + low) * F.pow(F.lit(2.0), exponent.cast("double") - 16383 - 63))


def float64(c: Column, at: int) -> Column:
    """A big-endian double that is normal, zero or negative; others are null."""
    sign, exponent = bits(c, 8 * at, 1), bits(c, 8 * at + 1, 11)
    fraction = (be(c, at + 1, 3).bitwiseAND(0xFFFFF)).cast("double") * 4294967296.0 + be(c, at + 4, 4)
    value = (1 + (be(c, at + 1, 1).bitwiseAND(15) * 281474976710656.0 + be(c, at + 2, 6)) / 4503599627370496.0) * F.pow(F.lit(2.0), exponent.cast("double") - 1023)
    whole = F.when((exponent == 0) & (fraction == 0), 0.0).when(exponent.between(1, 2046), value)
    return F.when(sign == 1, -whole).otherwise(whole)


def float32(c: Column, at: int) -> Column:
    """A big-endian float that is normal, zero or negative; others are null."""
    sign, exponent, fraction = bits(c, 8 * at, 1), bits(c, 8 * at + 1, 8), bits(c, 8 * at + 9, 23)
    whole = F.when((exponent == 0) & (fraction == 0), 0.0).when(exponent.between(1, 254), (1 + fraction / 8388608.0) * F.pow(F.lit(2.0), exponent.cast("double") - 127))
    return F.when(sign == 1, -whole).otherwise(whole)


def uint(c: Column) -> Column:
    """All of up to 8 bytes as one big-endian number; beyond 2^63 - 1, or without bytes, null."""
    return F.when(F.length(c).between(1, 8), F.conv(F.hex(c), 16, 10).try_cast("bigint"))
