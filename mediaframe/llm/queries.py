"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm import direct_codes, exact_dedup, graph_ann, jaccard_join, media_columns, merkle, packing, pieces, pii, secret_scan, sharding, toxicity, whitening
from mediaframe.llm.common import documents

#: The key of the pseudonyms in the registered query; a real one is a secret.
DEMO_KEY = b"mediaframe demonstration key"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.cut(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = graph_ann.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return graph_ann.search(graph_ann.index(vectors, 5), vectors.where("id % 50 = 0"), 5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direct_codes.read_documents(direct_codes.encode_corpus(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.features(media_columns.stored(documents(spark, sf_dir)))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir), DEMO_KEY)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = sharding.into_shards(documents(spark, sf_dir).select("doc_id", "text"), 16, fixed=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    return moved.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(documents(spark, sf_dir), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    proven = merkle.proofs(merkle.document_leaves(documents(spark, sf_dir), tampered))
    found = proven.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("probe"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long; null where it is larger than one."""
    found = whitening.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_jaccard_join, op3_best_fit_packing, op4_sentencepiece, op5_nearest_neighbours, op6_toxicity, op7_direct_codes, op8_media_columns, op9_pii_pseudonyms, op10_sharding, op11_exact_dedup, op12_merkle_manifest, op13_embedding_whitening)}


def _op1_sql() -> str:
    """The spans of every kind by their gaps and matches; weak ones need their complements' starts within the scope. The engine of the SQL has no look-around: 40 characters that stand alone are runs of that length."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    parts = []
    for rank, kind in enumerate(secret_scan.KINDS):
        alone = kind.name == "secret"
        pattern = quoted("[A-Za-z0-9+/=]+" if alone else kind.pattern)
        ok = "len(m) = 40 AND NOT contains(m, '=') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')" if alone else f"len(regexp_extract(m, {pattern}, {kind.group})) >= {kind.least}"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind.name}' AS kind, '{kind.part}' AS part, CAST(start AS BIGINT) AS start, CAST(start + len(m) AS BIGINT) AS stop FROM (SELECT doc_id, unnest(ms) AS m,
unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))) AS start
FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS gs FROM docs)) WHERE {ok}""")
    near = f"o.start BETWEEN f.start - {secret_scan.SCOPE} AND f.start + {secret_scan.SCOPE}"
    kept = " OR ".join(f"(f.rank = {r}" + "".join(f" AND EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.part = '{p}' AND {near})" for p in k.needs) + ")" for r, k in enumerate(secret_scan.KINDS))
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER ({where}), '')"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)}), kept AS (SELECT f.* FROM found f WHERE {kept})
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, sha256({listed(f"rank < {len(secret_scan.STRONG)}")}) AS base_sha256, {listed("rank >= 0")} AS spans, count(rank) AS n_spans
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


OP2_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""WITH docs AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM docs"""


def _op12_sql(levels: int = 8) -> str:
    """Level by level: a node's run, what stands left and right of it there, and the node above; a part that is down to one node keeps it. Eight levels are enough for 8^8 rows of a language."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # One byte at a time, eight steps of the reflected polynomial for each.
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"

    def tree(name: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            run = "PARTITION BY part, pos // 8 ORDER BY pos"
            out.append(f"""{name}s{k} AS (SELECT part, pos, n, h, n > 1 AS open, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT part, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 7) // 8 ELSE 1 END AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY part, pos // 8)""")
        return out

    own = tree("own", "SELECT part, pos, n, leaf AS h FROM docs")
    top = tree("top", f"SELECT '' AS part, row_number() OVER (ORDER BY encode(part) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM own{levels}")
    steps = lambda name, at, frm, out: [f"{out}0 AS (SELECT *, '' AS seen FROM {frm})"] + [
        f"""{out}{k + 1} AS (SELECT d.* EXCLUDE (node, seen), CASE WHEN s.open THEN sha256(s.l || d.node || s.r) ELSE d.node END AS node, d.seen || CASE WHEN s.open THEN s.l || s.r ELSE '' END AS seen
FROM {out}{k} d JOIN {name}s{k} s ON s.part IS NOT DISTINCT FROM {"''" if name == "top" else "d.part"} AND s.pos = d.{at} // {8**k})"""
        for k in range(levels)
    ]
    names = f"names AS (SELECT part, row_number() OVER (ORDER BY encode(part) NULLS FIRST) - 1 AS place, h AS subroot FROM own{levels})"
    return f"""WITH rows AS (SELECT doc_id, lang AS part, CAST(doc_id AS VARCHAR) AS k, {leaf("text")} AS leaf, {leaf(_LOWER.format("text"))} AS lowered FROM documents),
docs AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n, CASE WHEN {crc} % 3 = 0 THEN lowered ELSE leaf END AS node FROM rows),
{", ".join([*own, *top, names, *steps("own", "pos", "docs", "low"), f"mid AS (SELECT l.* EXCLUDE (seen), l.seen AS below, names.place, names.subroot FROM low{levels} l JOIN names ON names.part IS NOT DISTINCT FROM l.part)", *steps("top", "place", "mid", "high")])}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(below || seen) AS proof_sha256, node AS folded_root, node = t.h AS verified FROM high{levels} JOIN top{levels} t ON true"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op2_jaccard_join": OP2_SQL, "op11_exact_dedup": OP11_SQL, "op12_merkle_manifest": _op12_sql()}
