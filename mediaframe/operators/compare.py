"""Comparing reports: two by rules with tolerances, many as a matrix, and search over their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_differences(pairs: DataFrame) -> DataFrame:
    """pair_id, seq, category, field, value_a, value_b of pairs (pair_id and structs a, b with
    format, duration_ms, file_size, width, height, bit_depth); one row for each rule that finds a difference."""
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    ms = lambda s: F.coalesce(s("duration_ms").cast("double"), F.lit(0.0))
    size = lambda s: F.concat(s("width").cast("string"), F.lit("x"), s("height").cast("string"))
    rules = [
        ("General", "Container Format", ~a("format").eqNullSafe(b("format")), lambda s: s("format")),
        ("General", "Duration", F.abs(ms(a) - ms(b)) > 500, lambda s: F.format_string("%.2fs", ms(s) / 1000.0)),
        ("General", "File Size", (a("file_size") != b("file_size")) & (a("file_size") > 0) & (b("file_size") > 0), lambda s: F.concat(s("file_size").cast("string"), F.lit(" bytes"))),
        ("Video #1", "Resolution", size(a) != size(b), size),
        ("Video #1", "Bit Depth", a("bit_depth") != b("bit_depth"), lambda s: F.concat(s("bit_depth").cast("string"), F.lit(" bit"))),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(c).alias("category"), F.lit(f).alias("field"), value(a).alias("value_a"), value(b).alias("value_b"), F.coalesce(differs, F.lit(False)).alias("differs")) for k, (c, f, differs, value) in enumerate(rules)))
    return pairs.select("pair_id", F.inline(F.filter(rows, lambda r: r["differs"]))).drop("differs")


def aligned_tracks(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Tracks of two reports side by side by ordinal; inner cuts to the shorter report, full_outer keeps all."""
    return a.join(b, [*key, "ordinal"], how)


def matrix(values: DataFrame, slots: list[int]) -> DataFrame:
    """category, field, one column for each slot, is_different: values (category, field, slot, value) in
    wide form; null and empty are a dash, of several values of a slot the largest stands, rows without any value are dropped."""
    shown = values.withColumn("value", F.nullif("value", F.lit("")))
    wide = shown.groupBy("category", "field").pivot("slot", slots).agg(F.max("value"))
    columns = [F.col(f"`{s}`") for s in slots]
    wide = wide.where(F.coalesce(*columns).isNotNull())
    dashed = [F.coalesce(c, F.lit("—")).alias(f"slot_{s}") for s, c in zip(slots, columns, strict=True)]
    out = wide.select("category", "field", *dashed)
    return out.withColumn("is_different", F.size(F.array_distinct(F.array(*(f"slot_{s}" for s in slots)))) > 1)


def search(values: DataFrame, query: str) -> DataFrame:
    """Rows of (section, key, value) whose key or value has the query, in any case; nulls and empty values never match."""
    has = lambda c: F.lower(c).contains(query.lower())
    return values.where(F.nullif("value", F.lit("")).isNotNull() & (has(F.col("key")) | has(F.col("value"))))


def unpivoted(df: DataFrame, ids: list[str], columns: list[Column | str]) -> DataFrame:
    return df.select(*ids, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(ids, columns, "key", "value")
