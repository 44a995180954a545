"""Operator 2, line-first cleaning. DataFrame functions only: the whole query runs inside the JVM, without a shuffle.

Every line is judged by itself and failing lines go; a document that loses too much text that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.llm.common import read

#: The white space that separates words, and the characters that base counts as symbols.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Our line rules; the same patterns run in Java and in RE2.
SEPARATORS = r"[|»›·•]"
SIGNS = r"[#*$%&|<>!~^_=+{}\[\]\\]"
SENTENCE_SIGN = r"[.!?…]"
BOILERPLATE = (r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|javascript|lorem ipsum|"
               r"licensed under|sign in|log in|subscribe|click here|powered by|newsletter)")

#: A line with this many separators is navigation if they are at least a twentieth of its characters.
NAV_LEAST, NAV_SHARE = 3, 20
#: More than one sign in so many characters is too much punctuation.
SIGN_SHARE = 10
#: Longer lines are prose, whatever phrase they hold.
BOILERPLATE_MOST = 300
#: A line of so many characters must hold a sentence's sign (not at its end: texts get cut off).
PROSE_LEAST = 40
#: A document is rejected if it keeps less than this percentage of its characters (white space not counted).
KEEP_PERCENT = 50
#: Base: fewest words, and the largest percentage of words in repeated windows.
WORDS_LEAST, REPEAT_PERCENT = 50, 50


def _lines(docs: DataFrame) -> DataFrame:
    """Adds ``ls``: for every line with a word its text, its characters without white space and its verdict."""
    without = lambda x, p: F.length(x) - F.length(F.regexp_replace(x, p, ""))
    docs = docs.withColumn("ls", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    docs = docs.withColumn("ls", F.transform("ls", lambda x: F.struct(
        x.alias("line"), F.length(F.regexp_replace(x, SPACE + "+", "")).alias("chars"),
        without(x, SEPARATORS + "+").alias("seps"), without(x, SIGNS + "+").alias("signs"))))

    def failed(x):
        line, chars = x["line"], x["chars"]
        navigation = (x["seps"] >= NAV_LEAST) & (x["seps"] * NAV_SHARE >= chars)
        punctuation = (x["signs"] * SIGN_SHARE > chars) | ((chars >= PROSE_LEAST) & ~line.rlike(SENTENCE_SIGN))
        boilerplate = (chars <= BOILERPLATE_MOST) & line.rlike(BOILERPLATE)
        return navigation | punctuation | boilerplate

    return docs.withColumn("ls", F.transform("ls", lambda x: F.struct(
        x["line"].alias("line"), x["chars"].alias("chars"), failed(x).alias("failed"))))


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``words``: the windows of three words are sorted by hash inside the row, equal
    neighbours are repeats, and the union of their positions is counted from the sorted starts."""
    docs = docs.withColumn("win", F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
                           i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    docs = docs.withColumn("win", F.sort_array("win"))
    h = lambda j: F.get("win", j)["h"]
    docs = docs.withColumn("at", F.sort_array(F.transform(
        F.filter("win", lambda x, j: x["h"].eqNullSafe(h(j + 1)) | x["h"].eqNullSafe(h(j - 1))),
        lambda x: x["i"])))
    return docs.withColumn("n_repeat_words", F.aggregate(
        "at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"]))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleans every document line by line.

    A row per row: doc_id, text (the lines that passed, joined), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_failed_lines, chars, chars_kept, base_failed and kept. ``keep`` names further columns
    to carry along.

    A document is kept if base passed it and the lines that passed hold at least half of its characters.

    Edge cases: a null or empty text has no words and fails base; a text of one line is one line, however long;
    equal lines get equal verdicts; repeated rows stay repeated; an empty table gives no rows; columns that are not
    named play no part, whatever their names.
    """
    carried = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    base = docs.select(*_narrow(id_col, text_col), *carried)
    base = base.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda x: x != ""))
    base = _lines(_repeats(base))
    total = lambda cond: F.aggregate("ls", F.lit(0).cast("long"), lambda a, x: a + F.when(cond(x), x["chars"]).otherwise(0))
    passed = F.filter("ls", lambda x: ~x["failed"])
    out = base.select(
        "doc_id", F.array_join(F.transform(passed, lambda x: x["line"]), "\n").alias("text"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct(F.transform("ls", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.size("ls").cast("long").alias("n_lines"),
        F.size(F.filter("ls", lambda x: x["failed"])).cast("long").alias("n_failed_lines"),
        total(lambda x: F.lit(True)).alias("chars"), total(lambda x: ~x["failed"]).alias("chars_kept"),
        *[F.col(f"__keep_{i}") for i in range(len(keep))])
    out = out.withColumn("base_failed", (F.col("n_words") < WORDS_LEAST)
                         | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("chars_kept") * 100 >= F.col("chars") * KEEP_PERCENT))
    # A generator of one row each: filters on the verdict must not be pushed below it, into the functions over arrays,
    # where they would be computed anew for every element.
    out = out.select(F.explode(F.array(F.struct(*out.columns))).alias("row")).select("row.*")
    return out.withColumnsRenamed({f"__keep_{i}": c for i, c in enumerate(keep)})


def _narrow(id_col: str, text_col: str) -> list:
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_failed_lines", "chars", "chars_kept", "base_failed", "kept"]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the counts and verdicts, without the texts."""
    return clean(read(spark, sf_dir, "documents")).select(*RESULT)


def _sql(source: str) -> str:
    """DuckDB SQL of ``clean`` over a relation with doc_id and text: CTEs that end in ``judged``."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    without = lambda x, p: f"length({x}) - length(regexp_replace({x}, {quote(p + '+')}, '', 'g'))"
    return f"""
d AS (SELECT row_number() OVER () AS rid, * REPLACE (coalesce(text, '') AS text) FROM {source}),
w AS (SELECT rid, list_filter(string_split_regex(text, {quote(SPACE + '+')}), lambda x: x <> '') AS words FROM d),
win AS (SELECT rid, i, list_slice(words, i, i + 2) AS three
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l1 AS (SELECT rid, pos, line, length(regexp_replace(line, {quote(SPACE + '+')}, '', 'g')) AS chars,
              {without('line', SEPARATORS)} AS seps, {without('line', SIGNS)} AS signs
       FROM l0 WHERE regexp_matches(line, {quote(WORD)})),
l2 AS (SELECT *, (seps >= {NAV_LEAST} AND seps * {NAV_SHARE} >= chars) OR signs * {SIGN_SHARE} > chars
              OR (chars >= {PROSE_LEAST} AND NOT regexp_matches(line, {quote(SENTENCE_SIGN)}))
              OR (chars <= {BOILERPLATE_MOST} AND regexp_matches(line, {quote(BOILERPLATE)})) AS failed FROM l1),
l3 AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
              sum(chars) AS chars, coalesce(sum(chars) FILTER (NOT failed), 0) AS chars_kept,
              string_agg(line, chr(10) ORDER BY pos) FILTER (NOT failed) AS cleaned FROM l2 GROUP BY rid),
judged AS (SELECT *, NOT base_failed AND chars_kept * 100 >= chars * {KEEP_PERCENT} AS kept FROM (
  SELECT *, n_words < {WORDS_LEAST} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed FROM (
    SELECT d.* EXCLUDE (text), coalesce(l3.cleaned, '') AS text, len(w.words)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           ({without('d.text', SYMBOLS)})::BIGINT AS n_symbols, coalesce(l3.n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(l3.n_lines, 0)::BIGINT AS n_lines,
           coalesce(l3.n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(l3.chars, 0)::BIGINT AS chars,
           coalesce(l3.chars_kept, 0)::BIGINT AS chars_kept
    FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN l3 USING (rid))))"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE = {"op2_quality_rules": f"WITH {_sql('documents')} SELECT {', '.join(RESULT)} FROM judged"}
