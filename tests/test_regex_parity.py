"""Java regex (Spark) and RE2 (DuckDB) find the same matches for every rule.

The oracle compares the two engines, so their agreement on the catalog patterns
(after the dialect rewrite of ``\\s``) is itself tested here, on mutated
positive samples with ASCII and Unicode white space, case flips, cuts and
repeats.
"""

import random

import duckdb
from pyspark.sql import functions as F

from keysweep import catalog as C
from keysweep.functions.regex import engine_regex, sql_string

from test_detect import SAMPLES

SPACES = [" ", "\t", "\x0b", "\x0c", " ", " ", "　", "﻿", "  ", ""]


def _mutations(s: str, rng: random.Random, n: int):
    out = [s]
    for _ in range(n):
        t = list(s)
        for _ in range(rng.randint(1, 3)):
            op = rng.randrange(5)
            i = rng.randrange(len(t) + 1)
            if op == 0 and t:
                del t[min(i, len(t) - 1)]
            elif op == 1:
                t.insert(i, rng.choice(SPACES))
            elif op == 2 and t:
                j = min(i, len(t) - 1)
                t[j] = t[j].swapcase()
            elif op == 3 and t:
                j = min(i, len(t) - 1)
                t.insert(j, t[j] * rng.randint(1, 30))
            else:
                t.insert(i, rng.choice(["=", ":", "'", '"', "/", "@", "-", "_", "."]))
        out.append("".join(t))
    return out


def test_engines_agree_on_every_rule(spark):
    rng = random.Random(11)
    texts = []
    for s in SAMPLES.values():
        texts += _mutations("x " + s + " y", rng, 12)
    texts += _mutations("-----BEGIN EC PRIVATE KEY-----\nabc\n-----END EC PRIVATE KEY-----", rng, 20)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string")
    con = duckdb.connect()
    con.execute("CREATE TABLE t(id INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    patterns = [(r.type, r.pattern) for r in C.RULES] + \
        [(f"sanitizer{i}", "(?i)" + p) for i, p in enumerate(C.SANITIZER_PATTERNS)] + [("block", C.BLOCK_RULE.pattern)]
    for name, pat in patterns:
        p = engine_regex(pat)
        spark_res = {row.id: list(row.m) for row in df.select("id", F.regexp_extract_all("t", F.lit(p), 0).alias("m")).collect()}
        duck_res = {i: list(m) for i, m in con.execute(f"SELECT id, regexp_extract_all(t, {sql_string(p)}) FROM t").fetchall()}
        diff = [(texts[i], spark_res[i], duck_res[i]) for i in spark_res if spark_res[i] != duck_res[i]]
        assert not diff, (name, diff[:3])
