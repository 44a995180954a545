"""keysweep: a Spark-native secret-leak scanner and risk-analytics job.

Tables of files/documents go in; detections, redacted text, per-file and
per-repository reports and data-quality rejects come out.  Everything is
DataFrame / Column code so Catalyst plans it and whole-stage codegen runs it.
"""

from keysweep.session import get_spark, shared_dir  # noqa: F401

FILE_KEYS = ["repository", "branch", "path"]
REPO_KEYS = ["repository", "branch"]
