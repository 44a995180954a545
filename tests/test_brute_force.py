"""Detection against a brute-force Python scan of the same texts (sf0.01).

An implementation independent of both Spark and the SQL oracle: Python's
``re`` over each line, positions from ``finditer``.  Only the ``\\x{..}``
escapes of the dialect rewrite are converted to Python's ``\\U`` form.
"""

import re

from keysweep import catalog as C
from keysweep.functions.regex import engine_regex
from keysweep.operators import detect as D
from keysweep.sources import tables as S




def _py_regex(p: str) -> re.Pattern:
    p = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), p)
    flags = 0
    if p.startswith("(?i)"):
        p, flags = p[4:], re.IGNORECASE | re.ASCII  # Java (?i) folds ASCII only
    return re.compile(p, flags)


def _mask(v: str) -> str:
    n = len(v)
    if n <= 8:
        return "****"
    return v[:4] + "****" + v[-4:] if n < 40 else v[:6] + "****" + v[-6:]


def test_detect_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"  # 1,000 documents, 250 pages, 536 turns: hits of several kinds
    files = S.seeded_documents(spark, sf).union(S.repo_files(spark, sf))
    rules = [(r.type, _py_regex(engine_regex(r.pattern))) for r in C.RULES]
    expected = []
    for row in files.select("repository", "branch", "path", "content").collect():  # fixture-sized
        for ln, line in enumerate(re.split(r"\r?\n", row.content or ""), start=1):
            for t, rx in rules:
                for m in rx.finditer(line):
                    expected.append((row.repository, row.path, t, ln, m.start() + 1, _mask(m.group(0))))
    got = [(r.repository, r.path, r.type, r.line, r.column, r.value)
           for r in D.detections(files).collect()]
    assert sorted(got) == sorted(expected)
    assert len(expected) > 100


def test_redact_text_equals_brute_force(spark):
    from pyspark.sql import functions as F
    from keysweep.functions.mask import redact_text
    sf = "/root/testdata/sf0.01"
    docs = S.seeded_documents(spark, sf)
    pats = [_py_regex(engine_regex("(?i)" + p)) for p in C.SANITIZER_PATTERNS]

    def fold(t):
        for rx in pats:
            t = rx.sub(lambda m: "****" if len(m.group(0)) <= 8 else m.group(0)[:4] + "****" + m.group(0)[-4:], t)
        return t

    rows = docs.select("path", "content", redact_text(F.col("content")).alias("r")).collect()
    assert all(r.r == fold(r.content) for r in rows)
    assert sum(r.r != r.content for r in rows) > 100
