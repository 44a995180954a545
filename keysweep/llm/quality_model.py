"""Operator 6, weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on every document. Documents are counted by their votes (a
table bounded by the labellers, not by the corpus); expectation maximisation over those counts estimates how accurate
each labeller is and what each pattern of votes means. The posteriors label the documents on which a linear scorer over
hashed words and shapes is trained, and that scorer judges every document: it also sees texts on which no labeller votes.
No given label is used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.llm.common import narrow, read, small_batches

#: Hashed features of the scorer, and about how many documents it is fitted to (a bound, whatever the corpus).
WIDTH = 1 << 15
FIT_ROWS = 6000
#: A document is kept if the scorer's probability that it is good reaches this.
KEEP = 0.5

_NO_SIGNS = re.compile(r"[^#*$%&|<>!~^_=+{}\[\]\\@]+")
_NO_CAPITALS = re.compile(r"[^A-Z\u00c0-\u00d6\u00d8-\u00de]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[.?…!](?:\s|$)")
_ODD_WORD = re.compile(r"[^\w\s]{2}(?:\s|$)")


class Facts:
    """What the labellers look at, counted once for each text."""

    def __init__(self, text: str):
        self.words = words = text.split()
        self.n = len(words)
        self.chars = sum(map(len, words))
        self.signs = len(_NO_SIGNS.sub("", text))
        self.letters = len(_NO_LETTERS.sub("", text))
        self.capitals = len(_NO_CAPITALS.sub("", text))
        self.sentences = len(_SENTENCE.findall(text))
        self.odd = len(_ODD_WORD.findall(text))
        self.same_next = sum(map(str.__eq__, words, words[1:]))
        self.fresh = len(set(words))
        self.bars = words.count("|")
        lines = [x for x in text.split("\n") if x.strip()] if "\n" in text else [text] if self.n else []
        self.lines = len(lines)
        self.fresh_lines = len(set(lines))
        self.bar_lines = sum(x.count(" | ") >= 2 for x in lines) if self.bars else 0


# Labellers. Each votes only where it has evidence: -1 for bad, 1 for good, and most kinds of junk are seen by several,
# which is what lets expectation maximisation tell a labeller's errors from its finds.
def b_signs(f: Facts) -> int:
    return -(f.signs * 10 > f.chars)


def b_letters(f: Facts) -> int:
    return -(f.n >= 5 and f.letters * 4 < f.chars * 3)


def b_odd_words(f: Facts) -> int:
    return -(f.n >= 5 and f.odd * 10 > f.n * 3)


def b_shout(f: Facts) -> int:
    return -(f.letters >= 20 and f.capitals * 2 > f.letters)


def b_endings(f: Facts) -> int:
    return -(f.n >= 20 and f.sentences * 2 > f.n)


def b_same_word(f: Facts) -> int:
    return -(f.n >= 10 and f.same_next * 4 > f.n)


def b_few_words(f: Facts) -> int:
    return -(f.n >= 20 and f.fresh * 5 < min(f.n, 400))


def b_no_sentence(f: Facts) -> int:
    return -(f.n >= 60 and f.sentences * 60 < f.n)


def b_bars(f: Facts) -> int:
    return -(f.bars * 10 > f.n)


def b_bar_lines(f: Facts) -> int:
    return -(f.bar_lines * 2 >= f.lines > 0)


def b_lines(f: Facts) -> int:
    return -(f.lines >= 4 and f.fresh_lines * 2 < f.lines)


def g_prose(f: Facts) -> int:
    return int(f.n >= 5 and f.letters * 100 >= f.chars * 92 and f.capitals * 7 <= f.letters)


def g_varied(f: Facts) -> int:
    return int(f.n >= 20 and f.fresh * 5 > min(f.n, 400) * 2 and f.same_next * 50 < f.n)


def g_sentences(f: Facts) -> int:
    return int(f.n >= 10 and f.bars == 0 and f.sentences * 40 >= f.n >= f.sentences * 3)


LABELLERS = (b_signs, b_letters, b_odd_words, b_shout, b_endings, b_same_word, b_few_words, b_no_sentence, b_bars,
             b_bar_lines, b_lines, g_prose, g_varied, g_sentences)


#: Words below which a labeller has nothing to go by: its silence then says nothing.
LEAST = np.array([1, 10, 5, 5, 20, 10, 20, 60, 5, 5, 20, 5, 20, 10])
STEPS = sorted(set(LEAST.tolist()))


def votes(f: Facts) -> tuple[int, ...]:
    return tuple(int(labeller(f)) if f.n >= least else 0 for labeller, least in zip(LABELLERS, LEAST.tolist()))


def pattern(vote: tuple[int, ...], words: int) -> int:
    """Votes as a number: a bit for each labeller, set if it votes (each votes one way only), and above them how many of
    the least lengths the text reaches."""
    return sum(1 << j for j, v in enumerate(vote) if v) | sum(words >= x for x in STEPS) << len(vote)


def able(number: int) -> np.ndarray:
    """Which labellers could vote on texts of this pattern."""
    step = number >> len(LABELLERS)
    return (LEAST <= (STEPS[step - 1] if step else 0)).astype(float)


#: Which way each labeller votes.
SIDES = np.array([-1 if labeller.__name__.startswith("b_") else 1 for labeller in LABELLERS])


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation maximisation over counted vote patterns: share of good documents, how often each labeller votes on bad
    and on good documents (2 x labellers: its accuracies) and the posterior of good for each pattern.

    Labellers vote independently given the class, and one that could vote but keeps silent says something too. It starts from
    labellers that mostly vote on their own side, which settles which class is the good one. Without votes a posterior
    is the prior.
    """
    n = len(LABELLERS)
    rates = np.where(SIDES > 0, np.array([[0.3], [0.8]]), np.array([[0.4], [0.02]]))
    prior = 0.8
    patterns = sorted(counts)
    voted = np.array([[p >> j & 1 for j in range(n)] for p in patterns], dtype=float).reshape(-1, n)
    could = np.array([able(p) for p in patterns]).reshape(-1, n)
    weight = np.array([counts[p] for p in patterns], dtype=float)

    def posterior() -> np.ndarray:
        logs = voted @ np.log(rates).T + (could - voted) @ np.log(1 - rates).T + np.log([1 - prior, prior])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    for _ in range(rounds if len(patterns) else 0):
        good = posterior()
        mass = np.stack([1 - good, good]) * weight
        prior = float((mass[1].sum() + 8) / (weight.sum() + 10))
        rates = (mass @ voted + 0.5) / (mass @ could + 1.0)
    return prior, rates, dict(zip(patterns, posterior().tolist()))


class Hashed(dict):
    """word -> the buckets of its shape and of its ending; words as such aren't used, form is to be judged in any language."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = re.sub(r"[^\W\d_]+", lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa", word[:64])
        shape = re.sub(r"\d+", "9", shape)
        both = zlib.crc32(b"s" + shape.encode()) % WIDTH, zlib.crc32(b"e" + word[-3:].encode()) % WIDTH
        if len(self) > 200_000:
            self.clear()
        self[word] = both
        return both


def features(f: Facts, memo: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and their values: relative counts of shapes and endings, and of what the labellers count."""
    n = max(1, f.n)
    values: dict[int, float] = {}
    for both, count in Counter(map(memo.__getitem__, f.words)).items():
        for k in both:
            values[k] = values.get(k, 0.0) + 3.0 * count / n
    for name, x in (("signs", f.signs / max(1, f.chars)), ("same", f.same_next / n), ("fresh", f.fresh / min(n, 400)),
                    ("shout", f.capitals / max(1, f.letters)), ("ends", 4 * f.sentences / n), ("bars", f.bars / n),
                    ("odd", f.odd / n), ("letters", f.letters / max(1, f.chars)), ("lines", f.fresh_lines / max(1, f.lines))):
        values[zlib.crc32(f"{name}{min(20, int(20 * x))}".encode()) % WIDTH] = 1.0
    return np.fromiter(values, dtype=np.int64, count=len(values)), np.fromiter(values.values(), dtype=np.float32, count=len(values))


def fit(rows: list[tuple[list, list, float]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors (rows in the order given): weights and bias."""
    weights, bias, squares = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-2)
    rows = [(np.asarray(k, dtype=np.int64), np.asarray(v, dtype=float), y) for k, v, y in rows]
    for _ in range(rounds):
        for k, v, y in rows:
            p = 1 / (1 + np.exp(-np.clip(weights[k] @ v + bias, -30, 30)))
            g = (p - y) * v + decay * weights[k]
            squares[k] += g * g
            weights[k] -= rate * g / np.sqrt(squares[k])
            bias -= 0.01 * (p - y)
    return weights.astype(np.float32), float(bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Judges every document.

    A row per row: doc_id, n_words, n_good and n_bad (votes), weak_label (posterior of good from the votes alone), score
    (the scorer's probability of good) and kept (score >= 0.5). ``keep`` names columns to carry along; one of the names above then means the carried column.

    Edge cases: a null or empty text has no votes and is judged by the scorer like any other; very long texts are read
    whole; equal texts get equal scores; repeated rows count as often as they stand; an empty table gives no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    table = narrow(docs, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pattern(votes(f), f.n) for f in map(Facts, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["pattern"])

    counts = table.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").count()
    counted = dict(counts.collect())  # two to the number of labellers rows at most
    total = sum(counted.values())
    prior, _, posterior = estimate(counted)
    rows = _fit_rows(table, posterior, total)
    weights, bias = fit(rows) if rows else (np.zeros(WIDTH, dtype=np.float32), 0.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashed()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                f = Facts(text)
                v = votes(f)
                k, x = features(f, memo)
                score = float(1 / (1 + np.exp(-np.clip(weights[k] @ x + bias, -30, 30))))
                out.append((f.n, v.count(1), v.count(-1), posterior.get(pattern(v, f.n), prior), score))
            columns = [*batch.columns[2:]] + [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                                 ["doc_id", *names, "n_words", "n_good", "n_bad", "weak_label", "score"])

    names = [f"__keep_{i}" for i in range(len(keep))]
    whole = narrow(docs, id_col, text_col, {n: F.col(f"`{c}`") for n, c in zip(names, keep)})
    carried = "".join(f"`{n}` {whole.schema[n].dataType.simpleString()}, " for n in names)
    judged = whole.mapInArrow(judge, f"doc_id long, {carried}n_words long, n_good int, n_bad int, weak_label double, score double")
    judged = judged.withColumn("kept", F.col("score") >= KEEP)
    own = [c for c in judged.columns if c not in names]
    return judged.select(*[F.col(c) for c in own if c not in keep], *[F.col(n).alias(c) for n, c in zip(names, keep)])


def _fit_rows(table: DataFrame, posterior: dict[int, float], total: int) -> list[tuple[list, list, float]]:
    """Features and posteriors of the documents to fit to: a hash of the id deals out about FIT_ROWS of them, and never
    more than twice as many."""
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashed()
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = Facts(text)
                k, v = features(f, memo)
                out.append((h, k, v, posterior.get(pattern(votes(f), f.n), 0.5)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.float64()))], ["h", "k", "v", "y"])

    dealt = table.select(F.xxhash64("doc_id").alias("h"), "text").where(
        F.pmod("h", F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, FIT_ROWS / max(1, total)))))
    rows = dealt.mapInArrow(featurise, "h long, k array<int>, v array<float>, y double").limit(2 * FIT_ROWS).collect()
    return [(r["k"], r["v"], r["y"]) for r in sorted(rows, key=lambda r: (r["h"], r["y"]))]


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's judgement of every document."""
    return classify(read(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
