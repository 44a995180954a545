"""The batch job end to end at sf0.001, and the report sink shape."""

import json
import os

from keysweep.sources import tables as S
from keysweep.sources.sinks import read_parquet_table, read_reports, run_scan_job

from conftest import SF_SMALL


def test_run_scan_job(spark, tmp_path):
    out = str(tmp_path / "out")
    paths = run_scan_job(spark, S.repo_files(spark, SF_SMALL), out)
    dets = read_parquet_table(spark, paths["detections"])
    assert dets.count() > 0
    assert dets.where("value like '%AKIA%' and length(value) > 12").count() == 0  # masked
    reports = read_reports(spark, paths["reports"])
    r0 = reports.where("repository = 'org/r0'").first()
    assert r0.summary.severity_breakdown["critical"] >= 1
    assert sum(r0.summary.severity_breakdown.values()) == r0.total_secrets_found
    fr = read_parquet_table(spark, paths["file_results"])
    assert fr.where("size(results) != detections").count() == 0
    assert fr.selectExpr("sum(detections)").first()[0] == dets.count()
    an = read_parquet_table(spark, paths["analysis"])
    assert an.count() == reports.count()
    assert set(an.columns) >= {"analysis", "risk_score", "compliance_status", "remediation_steps"}
    # JSON lines are real JSON objects
    part = [f for f in os.listdir(paths["reports"]) if f.startswith("part-")][0]
    import gzip
    with gzip.open(os.path.join(paths["reports"], part), "rt") as fh:
        assert "repository" in json.loads(fh.readline())


def test_cli_over_a_text_table(spark, tmp_path, capsys):
    """The job over the raw documents table (no seeding): FIXTURES counts 13 hits at sf0.01."""
    from keysweep.__main__ import main
    out = str(tmp_path / "cli")
    main(["--files", "/root/testdata/sf0.01/documents.parquet", "--repository", "corpus/docs",
          "--path-col", "doc_id", "--content-col", "text", "--out", out])
    paths = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    dets = read_parquet_table(spark, paths["detections"])
    assert dets.count() == 13 and {r.type for r in dets.collect()} == {"generic_assignment"}


def test_cli_with_a_table_of_requests(spark, tmp_path, capsys):
    from keysweep.__main__ import main
    S.seeded_documents(spark, SF_SMALL).write.parquet(str(tmp_path / "files"))
    spark.createDataFrame([(1, "org", "r0", None, None), (2, "org", "nope", "main", None), (3, "-bad", "r1", None, None)],
                          "request_id long, owner string, repo string, branch string, path string").write.parquet(str(tmp_path / "requests"))
    main(["--files", str(tmp_path / "files"), "--requests", str(tmp_path / "requests"), "--out", str(tmp_path / "out")])
    paths = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    reports = {r.request_id: r.total_secrets_found for r in spark.read.json(paths["reports"]).collect()}
    assert reports == {1: 7, 2: 0}
    assert [r.request_id for r in read_parquet_table(spark, paths["rejected"]).collect()] == [3]
    assert read_parquet_table(spark, paths["file_results"]).agg({"detections": "sum"}).first()[0] == 7


def test_a_multi_line_key_in_a_snippet(spark):
    from keysweep import api
    key = "-----BEGIN SSH2 ENCRYPTED PRIVATE KEY-----\nabc\n-----END SSH2 ENCRYPTED PRIVATE KEY-----"
    snips = spark.createDataFrame([(1, key, None), (2, key.replace("SSH2 ENCRYPTED", "EC"), None)], "snippet_id long, code string, path string")
    got = {r.snippet_id: [(d.type, d.line, d.end_line) for d in r.detections] for r in api.scan_code(snips).collect()}
    assert got == {1: [("private_key_block", 1, 3)], 2: [("ec_private_key", 1, 1)]}
