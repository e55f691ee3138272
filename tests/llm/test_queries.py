"""The registered queries: their columns and rows over small tables with nulls, empty and very long texts, repeated rows and clashing columns; SQL where there is some."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from mediaframe.llm import direct_codes, exact_dedup, jaccard_join, media_columns, packing, pieces, pii, queries, secret_scan, sharding, toxicity
from tests.conftest import SMALL
from tests.test_catalog import rows

COLUMNS = {
    "op1_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op2_jaccard_join": "doc_id n_shingles component_id", "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op4_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_nearest_neighbours": "query_id rank vec_id score", "op6_toxicity": "doc_id held_out score predicted", "op7_direct_codes": "doc_id start n_tokens ids_crc32", "op8_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_pii_pseudonyms": "doc_id text", "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
}
#: Names that the operators use inside, as columns of the table.
CLASHING = ["node", "grp", "spans", "done", "toxicity", "row", "key", "task", "nth", "at", "part", "block", "own", "n", "ids", "media", "cluster", "__mark"]
ROWS = [(1, "token = \"abcdefabcdef0123456789\" end"), (2, None), (3, ""), (4, "one two three four five six"), (4, "one two three four five six"), (None, "no id here"), (7, "word " * 30_000 + "x" * 200_000), (8, "  "), (9, "vile " * 3)]


def write(spark, path, documents, vectors):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *([0.5] * len(CLASHING))) for i, t in documents], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{c}` double' for c in CLASHING)}")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k == 9)) for k in (1, 4, 9)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    vectors = [(k, [float(k % 7 + 1), 1.0, float(k % 3)]) for k in range(101)] + [(0, [9.0, 1.0, 0.0]), (200, None), (201, [0.0, 0.0, 0.0]), (250, [1.0])]
    return write(spark, tmp_path_factory.mktemp("odd"), ROWS, vectors)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_over_odd_tables(spark, odd, empty, name):
    found = queries.queries()[name](spark, odd)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    got = found.collect()
    if name == "op5_nearest_neighbours":
        assert {r["query_id"] for r in got} == {0, 50, 100} and all(r["rank"] <= 5 and r["vec_id"] != r["query_id"] for r in got)
    elif name == "op13_embedding_whitening":  # three dimensions and one
        assert len(got) == 103 * 3 + 1 and all(r["identity_error"] < 1e-4 for r in got if r["vec_id"] != 250)
    else:
        whole = [r for r in got if r.asDict().get("piece", 0) == 0]
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in whole) == sorted((i is None, i) for i, _ in ROWS)
    assert queries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{Path(SMALL) / 'documents.parquet'}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_pipeline_over_odd_tables(spark, odd, empty):
    found = corpus_pipeline.run(spark, odd).collect()
    assert {r["doc_id"] for r in found} >= {1, 2, 3, 4, 7, 8} and all(r["length"] <= 4096 for r in found)
    assert len([r for r in found if r["doc_id"] == 4]) == 1
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_clashing_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for kept in (toxicity.score(docs, toxicity.Model(), "__t").drop("__t"), jaccard_join.representatives(docs), secret_scan.redact(docs), corpus_pipeline.mask_secrets(spark, docs.drop("n_chars"), odd)):
        assert set(CLASHING) <= set(kept.columns) and kept.count() >= len(ROWS) - 1
    again = toxicity.score(docs, toxicity.Model())  # replaces the column of that name
    assert again.columns.count("toxicity") == 1 and again.where("toxicity = 0.5").count() == 0
    with pytest.raises(ValueError):
        sharding.into_shards(docs.withColumn("Shard", F.lit(1)), 4)


def test_very_long_texts(spark):
    long = "the quick brown fox jumps over a lazy dog " * 50_000
    docs = spark.createDataFrame([(1, long), (2, long + "end")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.components(docs).collect()} == {1}
    assert [r["n_spans"] for r in secret_scan.scan(docs).collect()] == [0, 0]
    assert all(r["n_pii"] == 0 for r in pii.pseudonymize(docs, b"k").collect())
    for r in media_columns.features(media_columns.stored(docs)).collect():
        assert r["n_bytes"] == len(long) + 3 * (r["doc_id"] == 2)
    packed = packing.pack(packing.cut(docs, queries.tokenizer_path("word_bpe_49k.json"))).collect()
    assert {r["length"] for r in packed if r["piece"] == 0} == {4096} and np.sum([r["length"] for r in packed]) > 800_000


def test_very_long_texts_of_the_other_operators(spark):
    long = "the quick brown fox jumps over a lazy dog " * 20_000
    docs = spark.createDataFrame([(1, long), (2, long + "é" * 1000), (3, None)], "doc_id long, text string")
    texts = {1: long, 2: long + "é" * 1000, 3: ""}
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in pieces.digests(docs, queries.tokenizer_path("piece_bpe_32k.model")).collect():
        ids = model.encode(texts[r["doc_id"]]) + [model.eos_id()]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    words, start = tokenizers.Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    codes = {r["doc_id"]: r for r in direct_codes.read_documents(direct_codes.encode_corpus(docs, queries.tokenizer_path("word_bpe_49k.json"))).collect()}
    for k in (1, 2, 3):
        ids = words.encode(texts[k], add_special_tokens=False).ids + [2]
        assert (codes[k]["start"], codes[k]["n_tokens"], codes[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, toxicity.Model()).collect())
    assert {r["doc_id"]: r["size"] for r in exact_dedup.duplicates(docs, digests=True).join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id").collect()} == {1: len(long), 2: len(long) + 2000, 3: None}


def test_values_of_shards(spark, odd):
    got = queries.op10_sharding(spark, odd).collect()
    by_id = {i: t or "" for i, t in ROWS}
    for r in got:
        text = by_id[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(ROWS) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16)) and max(map(len, slots.values())) == 1
