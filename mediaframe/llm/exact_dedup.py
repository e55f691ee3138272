"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then those of lengths that occur twice by a hash of their prefix,
then those of prefixes that occur twice by a hash of the whole text. The first two levels need
one narrow pass that aggregates before it shuffles. Which rows reach the third is told in the
scan by a map of surviving prefixes of fixed size (MAP_BITS), so texts are never moved; a bit
that is set by chance costs one needless hash, and the exact keys decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import saved

#: Characters of the prefix that the second level hashes.
PREFIX = 64
#: Bits of the map of surviving prefixes: 16 MB, sent to all tasks.
MAP_BITS = 1 << 27
#: Bits of one row of the map, as Spark's bitmap functions have them.
ROW_BITS = 1 << 15
#: Groups with more than 1 / HOT of all rows, so fewer than HOT, are sent to all tasks; the others' rows are spread by their hash.
HOT = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and no other letter. For texts of ASCII alone that is lower(), which is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _place(n: Column, head: Column) -> Column:
    return F.pmod(F.xxhash64(n, head), F.lit(MAP_BITS))


def prefix_groups(rows: DataFrame) -> DataFrame:
    """n (bytes) and head of the rows that are not alone with them: first lengths, then prefixes among these. rows: n, head."""
    heads = saved(rows.groupBy("n", "head").agg(F.count("*").alias("rows")), "prefixes")
    lengths = heads.groupBy("n").agg(F.sum("rows").alias("rows")).where("rows > 1")
    return heads.where("rows > 1").join(lengths.select("n"), "n", "left_semi").select("n", "head")


def _map(groups: DataFrame) -> DataFrame:
    """The surviving prefixes as rows of bits: bucket, bits; MAP_BITS / ROW_BITS rows at most, however many groups there are."""
    at = _place(F.col("n"), F.col("head"))
    return groups.select(F.floor(at / ROW_BITS).cast("int").alias("bucket"), (at % ROW_BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """For every row: doc_id, keep_id (doc_id of the row of its group that stays), group_size, kept, text_sha256 (binary).

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one, and equal
    to it. Of equal texts the row with the largest doc_id stays; null ids are the smallest, and of rows
    with one id one stays (any of them: they don't differ here). text_sha256, of the text in lower case, is null for
    rows that no other one can equal, unless digests asks for it of every row. Texts told equal share length,
    prefix hash and SHA-256. An empty table gives no rows; other columns may have any name."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64(lowered(F.substring("text", 1, PREFIX))).alias("head"))
    groups = saved(prefix_groups(rows.select("n", "head")), "prefix-groups")
    at = _place(F.col("n"), F.col("head"))
    told = rows.withColumn("bucket", F.floor(at / ROW_BITS).cast("int")).join(F.broadcast(_map(groups)), "bucket", "left")
    bit = (at % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    survives = F.coalesce(F.call_function("shiftright", byte, bit % 8).bitwiseAND(1) == 1, F.lit(False))
    whole = F.unhex(F.sha2(lowered(F.col("text")).cast("binary"), 256))
    hashed = saved(told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "head", survives.alias("survives"), (whole if digests else F.when(survives, whole)).alias("sha")), "hashed")
    same = ["n", "head", "sha"]
    copies = hashed.where("survives").groupBy(*same).agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "row")).alias("keep")).where("size > 1").join(groups, ["n", "head"], "left_semi")
    copies = saved(copies, "copies")
    return _decided(hashed, copies, same)


def _decided(hashed: DataFrame, copies: DataFrame, same: list[str]) -> DataFrame:
    """The group of each row: large groups are few and sent to all tasks, so that no task gets all rows of one."""
    large = F.col("size") * HOT > hashed.count()
    hot, rest = copies.where(large).select(*same, F.struct("size", "keep").alias("hot")), copies.where(~large).select(*same, F.struct("size", "keep").alias("group"))
    marked = hashed.join(F.broadcast(hot), same, "left")
    done = marked.where("hot is not null").withColumnRenamed("hot", "group")
    left = marked.where("hot is null").drop("hot").join(rest, same, "left")
    return done.select(left.columns).union(left).select(
        "doc_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.keep.doc_id")).alias("keep_id"), F.coalesce("group.size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group").isNull() | (F.col("group.keep.row") == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the rows that stay, one for each different text: doc_id. Of rows that repeat an id and a text one is counted."""
    return duplicates(docs, id_col, text_col).where("kept").select("doc_id")
