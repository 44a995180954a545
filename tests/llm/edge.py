"""Rows that every text operator must take: nulls, empty and very long texts, repeated rows, ties, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

LONG = "word " * 30_000 + "end."
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, "a b c d e f g. " * 20),
        (7, "A B C D E F G. " * 20), (None, "no id at all, but words."), (8, LONG), (9, LONG), (10, "é日🙂 x\x1cy\x85z\xa0w v"),
        (11, "line one.\nline one.\n\nline two | a | b | c\n"), (12, "single")]
#: Columns of other meanings under the names that operators use inside.
CLASH = "key long, data string, words string, win string, sid string, kind string, kept string, score string, spots int"


def frame(spark: SparkSession, rows: list[tuple] | None = None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, 1, "d", "w", "x", "s", "k", "kept", "sc", 3) for r in rows],
                                 f"doc_id long, text string, {CLASH}")


def random_texts(n: int, seed: int, words: int = 40, vocabulary: int = 30) -> list[tuple[int, str]]:
    """Texts of a few words of which many are edited copies of others."""
    r = random.Random(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    out: list[tuple[int, str]] = []
    for i in range(n):
        if out and r.random() < 0.6:
            tokens = r.choice(out)[1].split()
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                if tokens:
                    tokens[r.randrange(len(tokens))] = r.choice(names)
            if r.random() < 0.3:
                tokens = tokens[r.randint(0, 3):] + [r.choice(names)]
        else:
            tokens = [r.choice(names) for _ in range(r.randint(0, words))]
        out.append((i * 3, " ".join(tokens)))
    return out
