import random
import re
from itertools import permutations

import pytest

from keysweep.llm import filter_audit as A

LETTERS = "ABCDE"


def fails(rows):
    """The failed filters of each row, by comparing every text with every other."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
        f += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
        f += "D" if re.search(r"[#$%&*|]", text) else ""
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            f += "E"
        out.append(f)
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    failed, out = fails(rows), []
    for part in sorted({p or "" for _, _, p in rows}):
        mine = [(i, f) for (i, _, p), f in zip(rows, failed) if (p or "") == part]
        found, total = [], dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                failing = sum(k in f for _, f in mine)
                left = [(i, f) for i, f in left if k not in f]
                total[k] += len(gone)
                found.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == k for _, f in mine),
                              sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)])
        out += [(*r, total[r[1][r[2] - 1]]) for r in found]
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, n long, part string, fails int")
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = A.filter_audit(docs.repartition(3), marks).collect()
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(brute(rows, labels))
    return got


def some(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        words = [f"w{r.randrange(r.choice((60, 5000)))}" for _ in range(r.choice((3, 199, 200, 260)))]
        text = " ".join(words) + r.choice(("", "", " #", " | ", "CAPITALS " * 20))
        out.append((i * 2, out[r.randrange(i)][1] if i and r.random() < 0.3 else text, r.choice("pqr")))
    return out, [(i, r.randrange(2), r.randrange(2)) for i in range(0, n, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed):
    got = check(spark, *some(90, seed))
    for part in "pqr":  # the Shapley sums over all orders are the removals of any one order, 120 times
        steps = [r for r in got if r["part"] == part and r["filter_order"] == "ABCDE"]
        assert sum(r["shapley"] for r in steps) == 120 * sum(r["removed"] for r in steps)


def test_edge_rows(spark):
    long = "Long words and more. " * 20_000
    rows = [(None, "same", "a"), (None, "same", "a"), (1, "same", None), (1, "same", ""), (1, "same", "a"), (2, "same", "a"),
            (3, None, "a"), (4, "", "b"), (5, long, "a"), (6, long, "c"), (7, " \t\n", "a"), (2, "other", "a"), (8, "É" * 300, "a"),
            (9, "\x1c\x85 \xa0 a A", "a")]
    labels = [(2, 1, 0), (2, 0, 1), (99, 1, 1), (None, 1, 1), (5, None, 1), (4, 1, None)]
    check(spark, rows, labels)
    check(spark, rows, [])


def test_clean_part_has_zeros(spark):
    clean = " ".join(f"w{k}" for k in range(250))
    got = check(spark, [(1, clean, "a"), (2, clean + " x", "b")], [(1, 1, 0)])
    assert len(got) == 1200 and {r["removed"] for r in got} == {0} and {r["kept"] for r in got} == {1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_path_counts():
    forward, backward = A.path_counts(5)
    orders = list(permutations(range(5)))
    for state in range(32):
        through = sum(any(sum(1 << f for f in o[:k]) == state for k in range(6)) for o in orders)
        assert forward[state] * backward[state] == through
    assert forward[31] == backward[0] == 120
