"""Nested results in chunks, and running totals over groups of any size."""

import random

import pytest
from pyspark.sql import functions as F

from keysweep.operators import rollup as R
from keysweep.operators.prefix import running_total
from keysweep.sources import tables as S
from keysweep.sources.sinks import chunked_detections, read_parquet_table, result_chunks, run_scan_job

from conftest import SF_SMALL

SCHEMA = "repository string, branch string, path string, type string, severity string, line int, column int, value string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_total_against_a_loop(spark, parts):
    r = random.Random(parts)
    data = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.randrange(50), r.randrange(1, 9), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, o int, v int, i int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {x.i: x.t for x in running_total(df, ["g"], ["o", "i"], F.col("v").cast("long"), "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g, o, _, i in data:
        assert got[i] == sum(v for h, p, v, j in data if h == g and (p, j) < (o, i))


def test_chunks_are_bounded_numbered_and_whole(spark):
    r = random.Random(1)
    data = [("o/hot" if i % 3 else f"o/{i % 4}", "main", f"f{r.randrange(30)}", r.choice(["k", "t"]), r.choice(["critical", "low"]),
             r.randrange(1, 400), r.randrange(1, 80), "v" * r.randrange(1, 30)) for i in range(900)]
    dets = spark.createDataFrame(data, SCHEMA)
    chunks = result_chunks(dets, chunk_bytes=2000)
    assert rows(chunked_detections(chunks).select(dets.columns)) == rows(dets)
    sizes = chunks.select("repository", "chunk", F.length(F.to_json("results")).alias("n")).collect()
    assert max(x.n for x in sizes) < 2000 + 1500  # the file headers, and one detection
    for repository in {x.repository for x in sizes}:
        numbers = sorted(x.chunk for x in sizes if x.repository == repository)
        assert numbers == list(range(len(numbers)))
    assert sum(x.repository == "o/hot" for x in sizes) > 20
    # chunks follow each other in the order of path, line and column
    flat = [(x.path, d.line, d.column) for c in chunks.where("repository = 'o/hot'").orderBy("chunk").collect() for x in c.results for d in x.detections]
    assert flat == sorted(flat)


def test_a_detection_larger_than_a_chunk(spark):
    data = [("r", "main", "a", "t", "low", 1, 1, "v" * 5000), ("r", "main", "b", "t", "low", 1, 1, "v"), ("r", "main", "c", "t", "low", 1, 1, "w" * 9000)]
    chunks = result_chunks(spark.createDataFrame(data, SCHEMA), chunk_bytes=100).orderBy("chunk").collect()
    assert [c.chunk for c in chunks] == list(range(len(chunks))) and sum(len(c.results) for c in chunks) == 3


def test_empty(spark):
    assert result_chunks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_job_results_equal_file_results(spark, tmp_path):
    paths = run_scan_job(spark, S.repo_files(spark, SF_SMALL), str(tmp_path / "out"))
    dets = read_parquet_table(spark, paths["detections"])
    schema = result_chunks(dets).schema
    chunks = spark.read.schema(schema).json(paths["results"])
    flat = chunked_detections(chunks)
    assert rows(flat.select(dets.columns)) == rows(dets)
    nested = read_parquet_table(spark, paths["file_results"]).select("repository", "branch", "path", "severity", "detections")
    again = R.file_results(flat).select("repository", "branch", "path", "severity", "detections")
    assert rows(again) == rows(nested) and again.count() > 0
