"""Queries against their SQL on rows that the small tables lack: large keys, and texts that look like something else."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from mediaframe.plans import catalog, codec_queries, container_queries, inspect_queries, report_queries  # noqa: F401  (register their queries)

from .test_catalog import rows


def check(spark, folder, name, table, columns):
    pq.write_table(pa.table(columns), folder / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def orders(keys):
    return {"o_orderkey": pa.array([k for k, _ in keys], pa.int64()), "o_custkey": pa.array([c for _, c in keys], pa.int64())}


def parts(keys, sizes):
    n = len(keys)
    return {"p_partkey": pa.array(keys, pa.int64()), "p_name": ["a name"] * n, "p_brand": ["Brand#1"] * n, "p_type": ["TYPE"] * n, "p_size": pa.array(sizes, pa.int32())}


def test_texts_that_look_like_other_formats(spark, tmp_path):
    texts = ["a webm file", "ftyp", "moov", "skip this", "wide roads", "G" * 600, "--> x", "", None]
    docs = [(33 * i + k, t) for i, t in enumerate(texts) for k in range(33)]
    check(spark, tmp_path, "d01_detect_magic", "documents", {"doc_id": [k for k, _ in docs], "text": [t for _, t in docs]})


def test_sizes_just_below_a_rounded_text(spark, tmp_path):
    check(spark, tmp_path, "f07_view_texts", "orders", orders([(1604353, 153184), (3454836, 5544), (3, 1), (0, 7), (8999999, 899999)]))


def test_heights_beyond_the_field(spark, tmp_path):
    check(spark, tmp_path, "v17_av1_sequence", "part", parts([0, 1, 65535, 65536, 65537, 119999, 1199999], [1, 2, 3, 16, 18, 50, 7]))


def test_rates_beyond_the_field(spark, tmp_path):
    check(spark, tmp_path, "v14_mpeg2_sequence", "part", parts([0, 1, 262143, 262144, 262145, 1000001, 1199998], [1, 2, 3, 16, 18, 50, 7]))


def test_rows_that_make_work_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path):
    for n, least in ((45_000, 3), (205_000, 11)):
        pq.write_table(pa.table(parts(list(range(n)), [1] * n)), tmp_path / "part.parquet")
        made = container_queries._matroska(spark, str(tmp_path))
        assert made.rdd.getNumPartitions() >= least


def test_bits_of_any_length_are_made_once(spark):
    from pyspark.sql import functions as F

    from mediaframe.functions import synth

    texts = ["1", "0" * 7 + "1", "10" * 28, "01" * 28 + "1", "110" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", synth.packed(F.col("t")).alias("b"))
    assert all(bytes(r.b) == int(r.t.ljust(-(-len(r.t) // 8) * 8, "0"), 2).to_bytes(-(-len(r.t) // 8), "big") for r in got.collect())
    plan = spark.range(1).select(synth.packed(synth.digits(F.col("id"), 40), F.lit("1")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("bin(") == 1 and plan.index("bin(") < plan.index("lambdafunction")  # an argument, not in the lambda's body
