"""Invariants over the seeded test corpus, stream vs batch, sources."""


from pyspark.sql import functions as F

from keysweep import REPO_KEYS
from keysweep.functions.mask import redact_text
from keysweep.operators import detect as D
from keysweep.operators import rollup as R
from keysweep.plans import registry
from keysweep.sources import tables as S

from conftest import SF_SMALL


def test_redact_twice_leaves_no_seeded_value(spark):
    docs = S.seeded_documents(spark, SF_SMALL)
    once = docs.select(redact_text(F.col("content")).alias("t"))
    twice = once.select(redact_text(F.col("t")).alias("t"))
    bad = twice.where(F.col("t").rlike("AKIA[0-9A-F]{16}|ghp_[0-9a-f]{36}|sk_live_[0-9a-f]{24}"))
    assert bad.count() == 0


def test_file_rollup_equals_repo_rollup(spark):
    dets = D.detections(S.seeded_documents(spark, SF_SMALL))
    fr = R.file_results(dets).groupBy(*REPO_KEYS).agg(F.sum("detections").alias("n"))
    rr = R.analyze(dets).select(*REPO_KEYS, F.col("secrets").alias("n"))
    assert fr.exceptAll(rr).count() == 0 and rr.exceptAll(fr).count() == 0


def test_flagship_numbers_sf0001(spark):
    import __spark_entry__ as E
    rows = {r.repository: r for r in E.entry(spark).collect()}
    assert len(rows) == 100
    r0 = rows["org/r0"]
    assert (r0.files, r0.secrets, r0.critical, r0.high, r0.medium, r0.risk_score, r0.compliance_status) == \
        (2, 7, 5, 1, 1, 57, "non_compliant")
    status = {}
    for r in rows.values():
        status[r.compliance_status] = status.get(r.compliance_status, 0) + 1
    assert status == {"compliant": 20, "at_risk": 7, "non_compliant": 73}


def test_stream_equals_batch(spark):
    batch = registry.SPARK["detect"](spark, SF_SMALL)
    stream = registry.SPARK["scan_stream"](spark, SF_SMALL)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_stream_of_a_table_in_parts(spark, tmp_path):
    """A table is a file or a folder of parts; the stream reads either."""
    docs = spark.read.parquet(SF_SMALL + "/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    parts = registry.SPARK["scan_stream"](spark, str(tmp_path))
    whole = registry.SPARK["detect"](spark, SF_SMALL)
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_read_file_tree_and_decode(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"token = 'abcdefghijkl'\n\xff\xfe ok")
    (tmp_path / "logo.png").write_bytes(b"\x89PNG")
    files = S.read_file_tree(spark, str(tmp_path), "org/x", glob=None)
    got = {r.path: r.content for r in files.collect()}
    assert set(got) == {"src/a.py", "logo.png"}
    assert "�" in got["src/a.py"]
    dets = D.detections(files.where(~F.col("path").rlike(r"\.png$")))
    assert [r.type for r in dets.collect()] == ["generic_assignment"]


def test_fixture_figures_sf001(spark):
    """Independent figures published in FIXTURES.md for sf0.01."""
    sf = "/root/testdata/sf0.01"
    rr = registry.SPARK["repo_risk"](spark, sf)
    status = {r.compliance_status: r["count"] for r in rr.groupBy("compliance_status").count().collect()}
    assert rr.count() == 500 and status == {"compliant": 117, "at_risk": 23, "non_compliant": 360}
    det = registry.SPARK["detect"](spark, sf)
    by_type = {r.type: r["count"] for r in det.groupBy("type").count().collect()}
    assert by_type == {"aws_access_key_id": 200, "github_token": 143, "postgres_uri": 91, "slack_token": 77,
                       "generic_assignment": 66, "stripe_live_key": 59, "rsa_private_key": 44}
    assert det.select("path").distinct().count() == 504


def test_files_stream_equals_batch(spark, tmp_path):
    from keysweep.streaming.scan_stream import start_files_stream
    from keysweep.operators import filters as FL
    src = str(tmp_path / "incoming")
    files = S.repo_files(spark, SF_SMALL)
    files.where("repository like 'org/%'").write.parquet(src + "/batch1")
    files.where("repository not like 'org/%'").write.parquet(src + "/batch2")
    out = str(tmp_path / "out")
    q = start_files_stream(spark, src + "/*", out, str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    streamed = spark.read.parquet(out)
    batch = D.detections(FL.keep_files(files), with_context=True)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
