import hashlib
import random
import zlib

import pytest

from keysweep.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[2], row[3], row[4], text)])


def build(leaves):
    """Levels from the leaves to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def way(levels, k):
    for now in levels[:-1]:
        at = k % 8
        yield at, now[k - at:k - at + 8]
        k //= 8


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[3] is None else b"1" + r[3].encode(), []).append(r)
    names = sorted(trees)
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built[name] = build([leaf(r, r[1]) for r in trees[name]])
    top = build([built[name][-1][0] for name in names])
    out = []
    for i, name in enumerate(names):
        for k, r in enumerate(trees[name]):
            ways = [*way(built[name], k), *way(top, i)]
            changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1])
            for at, run in ways:
                now = H(*run[:at], now, *run[at + 1:])
            out.append((r[0], leaf(r, r[1]), built[name][-1][0], top[-1][0],
                        H(*[d for at, run in ways for j, d in enumerate(run) if j != at]), now, now == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree string, item string, root string, pos long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "i", "r", 9) for r in rows], SCHEMA)


def check(spark, rows, levels):
    got = M.manifest(frame(spark, rows).repartition(5), levels).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    return got


def some(n, lang="en", seed=0):
    r = random.Random(seed)
    return [(7 * i + seed, r.choice(["Some Text ", "small ", "ÉÄ Über "]) * r.randint(0, 3), r.choice(["a", "b", None]), lang, r.randint(0, 9))
            for i in range(n)]


@pytest.mark.parametrize("counts, levels", [((1,), 1), ((8, 9, 1), 1), ((74, 7), 1), ((71, 65, 64), 2), ((90, 3), 4)])
def test_ragged_trees(spark, counts, levels):
    """Blocks of 8 and 64 leaves, so that there are several rounds and last runs of every kind."""
    got = check(spark, [r for k, n in enumerate(counts) for r in some(n, f"l{k}", k)], levels)
    assert len({r["root"] for r in got}) == 1


def test_many_blocks_and_many_trees(spark):
    rows = some(580) + [r for k in range(75) for r in some(1 + k % 3, f"x{k:02}", 1000 + k)]
    got = check(spark, rows, 1)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_edge_rows(spark):
    long = "Word " * 50_000
    rows = [(None, "A", None, None, None), (None, "A", None, None, None), (3, None, "s", None, 1), (3, "", "s", None, 1),
            (5, long, "s", "", 1), (5, long, "s", "", 1), (5, "B", "s", "", 1), (6, "Ä Ö Z\x00\n", "-", "-", -5), (-4, "Q", "1:s", "é", 2**62)]
    check(spark, rows, 1)
    check(spark, rows * 9, 1)


def test_empty_table(spark):
    assert M.manifest(frame(spark, [])).collect() == []


def test_blocks_are_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "broadcast_if_few", lambda df, most=0: df)
    check(spark, some(100) + some(20, "z", 3), 1)
