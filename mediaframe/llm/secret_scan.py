"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans (assignments of named secrets, access keys, long hex runs) always stay. Weak
candidates (identifiers, mixed 40-character runs, endpoints) are parts of a credential that
say little alone; one is reported only when its complementary parts begin within the same
scope, an interval around it. The interval join is a range frame over the spans of a document
in order of their starts, so no pairs of spans are made.

Places: a text is split at a pattern, and the lengths of gaps and matches, summed in order,
give starts and ends in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part's complement begins at most so many code points before or after it.
SCOPE = 200


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: The group whose length counts, and its least length.
    group: int
    least: int
    #: The part of a credential: identifier, secret or endpoint.
    part: str
    #: Parts that must begin within the scope; none for strong kinds.
    needs: tuple[str, ...] = ()


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = (
    Kind("assign", ASSIGN, 2, 12, "secret"),
    Kind("access", "AKIA[A-Z0-9]+", 0, 18, "identifier"),
    Kind("hex", "[0-9a-f]{16,}", 0, 16, "secret"),
)
WEAK = (
    Kind("identifier", r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", 0, 1, "identifier", ("secret",)),
    Kind("secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40, "secret", ("identifier",)),
    Kind("endpoint", r"(?i:https?|jdbc:[a-z]+|postgres|mysql|redis|s3)://[A-Za-z0-9][A-Za-z0-9.:@_-]*", 0, 1, "endpoint", ("identifier", "secret")),
)
KINDS = STRONG + WEAK


def _matches(text: Column, rank: int, kind: Kind) -> Column:
    """Array of struct(rank, nth, gap, len, ok); empty without a match."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("g"))
    size = lambda z: F.length(F.regexp_extract(z["m"], kind.pattern, kind.group)) if kind.group else F.length(z["m"])
    row = lambda z, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), (size(z) >= kind.least).alias("ok"))
    each = F.transform(F.filter(found, lambda z: z["m"].isNotNull()), row)
    return F.when(text.rlike(kind.pattern), each).otherwise(F.array().cast("array<struct<rank:int,nth:int,gap:int,len:int,ok:boolean>>"))


def has_candidates(text: Column) -> Column:
    found = F.lit(False)
    for kind in KINDS:
        found = found | text.rlike(kind.pattern)
    return F.coalesce(found, F.lit(False))


def _linked(parts: DataFrame, key: str, scope: int) -> DataFrame:
    """Rows of matches with start, end and keep; parts: key, rank, nth, gap, len, ok, dealt by key."""
    order = Window.partitionBy(key, "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(order)
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    near = Window.partitionBy(key).orderBy("start").rangeBetween(-scope, scope)
    keep = F.lit(False)
    for rank, kind in enumerate(KINDS):
        here = F.lit(True)
        for part in kind.needs:
            here = here & (F.sum(F.when(F.col("ok") & F.col("rank").isin([r for r, k in enumerate(KINDS) if k.part == part]), 1).otherwise(0)).over(near) > 0)
        keep = keep | ((F.col("rank") == rank) & here)
    return placed.withColumn("keep", F.coalesce(F.col("ok") & keep, F.lit(False)))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    spans: kind:start:end by start, then by kind as in KINDS, comma-joined; code points, end
    exclusive. Matches of a kind don't overlap, those of different kinds may. A null text is an
    empty one, without spans. Repeated rows give repeated results, an empty table none; a null id is
    kept. Only the two columns named are read: others may have any name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*(_matches(text, r, k) for r, k in enumerate(KINDS)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.explode_outer(parts).alias("p")).select("row", "doc_id", "p.*").repartition("row")
    span = F.struct("start", "rank", "end")
    strong = F.col("keep") & (F.col("rank") < len(STRONG))
    count = lambda r: F.count(F.when(F.col("keep") & (F.col("rank") == r), 1))
    grouped = _linked(rows, "row", scope).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.array_sort(F.collect_list(F.when(strong, span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("keep"), span))).alias("all"),
    )
    return grouped.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs, all columns and rows kept, with every reported span of text_col replaced by mask (one
    for spans that overlap). Rows without candidates aren't shuffled; others meet their spans by a
    digest of id and text, so that equal rows are scanned once. A null text stays null. Columns of
    docs may have any names but those that begin with __secret_scan."""
    own, name = "__secret_scan_key", lambda c: F.col(f"`{c.replace('`', '``')}`")
    text = name(text_col)
    marked = docs.withColumn(own, F.when(has_candidates(text), F.sha2(F.concat_ws("\0", F.coalesce(name(id_col).cast("string"), F.lit("")), text), 256)))
    clean, rest = marked.where(F.col(own).isNull()), marked.where(F.col(own).isNotNull())
    parts = F.concat(*(_matches(F.col("text"), r, k) for r, k in enumerate(KINDS)))
    rows = rest.select(F.col(own).alias("key"), text.alias("text")).select("key", F.explode(parts).alias("p")).select("key", "p.*")
    kept = _linked(rows.dropDuplicates(["key", "rank", "nth"]), "key", scope).where("keep")
    before = Window.partitionBy("key").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("last", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    spans = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "last"))).alias("__secret_scan_spans"), F.max("end").alias("__secret_scan_done"))
    piece = lambda s: F.when(s["start"] >= s["last"], F.concat(text.substr((s["last"] + 1).cast("int"), (s["start"] - s["last"]).cast("int")), F.lit(mask))).otherwise("")
    masked = F.concat(F.array_join(F.transform("__secret_scan_spans", piece), ""), text.substr((F.col("__secret_scan_done") + 1).cast("int"), F.length(text)))
    found = rest.join(spans.withColumnRenamed("key", own), own, "left")
    found = found.withColumn(text_col, F.when(F.col("__secret_scan_spans").isNotNull(), masked).otherwise(text))
    columns = [name(c) for c in docs.columns]
    return found.select(*columns).unionByName(clean.select(*columns))
