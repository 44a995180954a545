"""One repository holding a third of all files: results equal a brute-force pass."""

from pyspark.sql import functions as F

from keysweep import REPO_KEYS
from keysweep.operators import rollup as R
from keysweep.plans.corpus_scan import scan_corpus
from keysweep.sources import tables as S

from conftest import SF_SMALL


def test_hot_repository_cap_and_rollup(spark):
    docs = S.seeded_documents(spark, SF_SMALL)
    hot = docs.withColumn("repository", F.when(F.expr("cast(substring_index(path, '.', 1) as int) % 3 = 0"),
                                               F.lit("org/hot")).otherwise(F.col("repository")))
    cap = 20
    kept, dets, _ = scan_corpus(hot, max_files=cap)
    # brute force on the driver (test fixture only): first `cap` paths of each repository
    files = hot.select("repository", "branch", "path").toPandas()
    keep = (files.sort_values("path").groupby(["repository", "branch"]).head(cap))
    assert sorted(map(tuple, kept.select("repository", "branch", "path").toPandas().values.tolist())) == \
        sorted(map(tuple, keep.values.tolist()))
    assert kept.where("repository = 'org/hot'").count() == cap
    # detections only from kept files; per-repository counts equal the flat count
    kept_paths = {(r, b, p) for r, b, p in keep.values.tolist()}
    got = dets.select("repository", "branch", "path").toPandas().values.tolist()
    assert all(tuple(x) in kept_paths for x in got)
    a = R.analyze(dets, repos=kept.select(*REPO_KEYS).distinct())
    hot_row = a.where("repository = 'org/hot'").first()
    assert hot_row.secrets == dets.where("repository = 'org/hot'").count()
