"""Sequence parameter sets of AVC: fields of variable length, read field by field for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.bitbatch import BitBatch
from mediaframe.functions.bits import unescape_nal
from mediaframe.functions.lookups import matrix_name, named, primaries_name, transfer_name

# Profiles with chroma fields, and the names of profiles.
HIGH = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}
PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}
CHROMA = {0: "4:0:0", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
SCHEMA = "profile_idc int, level_idc int, chroma int, bit_depth int, width int, height int, progressive boolean, frame_rate double, full_range int, primaries int, transfer int, matrix int"


def colour_codes(b: BitBatch, on: np.ndarray) -> dict[str, np.ma.MaskedArray]:
    """The video signal type of usability information: whether the range is full, and the codes of primaries, transfer and matrix where they are described."""
    there = b.flag(on) & on
    b.skip(3, there)
    full = b.u(1, there)
    told = there & b.ok
    described = b.flag(there) & there
    codes = [b.u(8, described) for _ in range(3)]
    return {"full_range": known(full, told), **{k: known(v, described & b.ok) for k, v in zip(("primaries", "transfer", "matrix"), codes, strict=True)}}


def known(values: np.ndarray, where: np.ndarray) -> np.ma.MaskedArray:
    """values, unknown elsewhere."""
    return np.ma.MaskedArray(values, ~where)


def aspect(b: BitBatch, on: np.ndarray) -> None:
    """Passes the sample aspect ratio: an index, with two numbers where that is 255."""
    there = b.flag(on) & on
    b.skip(32, there & (b.u(8, there) == 255))


def scaling_lists(b: BitBatch, on: np.ndarray, chroma: np.ndarray) -> None:
    """Passes the lists of AVC: six of 16 and two (with 4:4:4 six) of 64 differences, each cut off where the next scale becomes 0."""
    for k in range(12):
        listed = on & ((k < 8) | (chroma == 3))
        listed &= b.flag(listed)
        scale = np.full(len(on), 8)
        for _ in range(16 if k < 6 else 64):
            if not (listed & b.ok).any():
                break
            scale = np.where(listed, (scale + b.se(listed)) % 256, scale)
            listed = listed & (scale != 0)


def parse(units: list[bytes | None]) -> dict[str, np.ndarray | np.ma.MaskedArray]:
    """The fields of SCHEMA of unescaped sets, with or without the unit's header, and whether each could be read."""
    b = BitBatch(units, np.array([int(bool(u) and u[0] & 31 == 7) for u in units], np.int64))
    profile, _, level, _ = b.u(8), b.skip(8), b.u(8), b.ue()
    high = np.isin(profile, sorted(HIGH))
    chroma = np.where(high, b.ue(high), 1)
    b.skip(1, high & (chroma == 3))
    depth = 8 + b.ue(high)
    b.ue(high), b.skip(1, high)
    scaling_lists(b, high & b.flag(high), chroma)
    b.ue()
    order = b.ue()
    b.ue(order == 0)
    cycle = order == 1
    b.skip(1, cycle), b.se(cycle), b.se(cycle)
    for _, more in b.times(b.ue(cycle), cycle):
        b.se(more)
    b.ue(), b.skip(1)
    width, height = 16 * (b.ue() + 1), 16 * (b.ue() + 1)
    frames = b.u(1)
    b.skip(1, frames == 0), b.skip(1)
    crop = b.flag()
    left, right, top, bottom = (b.ue(crop) for _ in range(4))
    x, y = np.where(np.isin(chroma, (1, 2)), 2, 1), np.where(chroma == 1, 2, 1) * (2 - frames)
    whole = b.ok
    usable = b.flag()
    aspect(b, usable)
    b.skip(1, b.flag(usable) & usable)
    colour = colour_codes(b, usable)
    placed = b.flag(usable) & usable
    b.ue(placed), b.ue(placed)
    timed = b.flag(usable) & usable
    tick, scale = b.u(32, timed), b.u(32, timed)
    timed = timed & b.ok & (tick > 0) & (scale > 0)
    return {
        "found": whole, "profile_idc": profile, "level_idc": level, "chroma": chroma, "bit_depth": depth, "width": np.maximum(0, width - x * (left + right)), "height": np.maximum(0, height * (2 - frames) - y * (top + bottom)), "progressive": frames == 1,
        "frame_rate": known(scale / np.maximum(2 * tick, 1), timed), **colour,
    }


def frame(found: dict[str, np.ndarray | np.ma.MaskedArray], names: list[str]) -> pd.DataFrame:
    """What a batch gave as columns of nulls and numbers; rows that could not be read are null."""
    whole = found["found"]
    return pd.DataFrame({k: pd.Series(np.ma.getdata(found[k])).astype(object).where(whole & ~np.ma.getmaskarray(found[k]), None) for k in names})


def colours(s) -> dict[str, Column]:
    full = s("full_range")
    return {"color_range": F.when(full == 1, "Full").when(full == 0, "Limited"), "primaries": primaries_name(s("primaries")), "transfer": transfer_name(s("transfer")), "matrix": matrix_name(s("matrix"))}


def avc_sps(table: DataFrame, content: str, out: str = "sps") -> DataFrame:
    """table with a struct of profile, level, chroma, bit_depth, width, height, scan_type, frame_rate and colours; null for broken sets."""

    @F.pandas_udf(SCHEMA)
    def read(units: pd.Series) -> pd.DataFrame:
        return frame(parse(units.tolist()), [field.split()[0] for field in SCHEMA.split(", ")])

    s = lambda name: F.col(f"__sps.{name}")
    level = F.concat(F.floor(s("level_idc") / 10).cast("string"), F.lit("."), (s("level_idc") % 10).cast("string"))
    fields: dict[str, Column] = {
        "profile": F.coalesce(named(s("profile_idc"), PROFILES), F.lit("High")), "level": level, "chroma": named(s("chroma"), CHROMA), "bit_depth": s("bit_depth"), "width": s("width"), "height": s("height"),
        "scan_type": F.when(s("progressive"), "Progressive").otherwise("Interlaced"), "frame_rate": s("frame_rate"), **colours(s),
    }
    found = table.withColumn("__sps", read(unescape_nal(F.col(content))))
    return found.withColumn(out, F.when(s("width").isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))).drop("__sps")
