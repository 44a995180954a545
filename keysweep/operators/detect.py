"""Detection (D1-D7): catalog rules applied to every line of every file.

Plan shape (all narrow, no shuffle):

  files --(one rlike over the union of all rules: skip clean files)-->
  posexplode(split(content, '\\r?\\n')) --(same union per line: skip clean lines)-->
  per candidate line, each rule's regexp_extract_all (literal patterns, compiled once) -->
  explode (line, rule) pairs --> columns from the split pieces --> explode matches.

Only candidate lines pay for the 37 per-rule passes; only hits pay for ``split`` and
positions.  In a table a file is one row and one task's work; lines are produced inside the task, never shuffled.  Files of a
tree that are too large for that are read as byte ranges (``plans.tree_scan``), and their lines meet the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysweep import FILE_KEYS
from keysweep import catalog as C
from keysweep.functions.comments import without_comments
from keysweep.functions.literals import gate, prefilter
from keysweep.functions.mask import mask_value
from keysweep.functions.regex import engine_regex, spark_sql_literal
from keysweep.sources.tables import spread

LINE_BREAK = r"\r?\n"
CONTEXT_WIDTH = 40
# Lines are sliced in pieces of this size, so that a slice costs the same wherever it lies on a very long line.
SLICE = 4096
# A private key that stands on one line: its body is no rule's match, but must not be shown either.
KEY_ON_LINE = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*"

CATALOG_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("recommendation", T.StringType(), False),
])


def catalog_df(spark: SparkSession, rules: list[C.Rule] | None = None) -> DataFrame:
    """The rule catalog as a (37-row) dimension table."""
    rules = C.RULES if rules is None else rules
    rows = [(i, r.type, r.category, r.severity, r.pattern, r.description, r.recommendation)
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def split_lines(c: Column) -> Column:
    """Lines split at ``\r?\n``.  A literal CR LF -> LF replace and a one-character
    split give the same lines as the regex split, about a third faster."""
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def _any_sql(column: str, literals) -> str:
    return "(" + " OR ".join(f"contains({column}, {spark_sql_literal(x)})" for x in literals) + ")"


def rule_gate_sql(rule: C.Rule, text: str = "line_text", lowered: str = "line_lower") -> str:
    """Necessary condition for ``rule`` to match a line, as Spark SQL text (one parser call instead of thousands of
    Column round trips): literals that its regex needs (``functions.literals``), looked for in the lowered line if the rule
    ignores case.  A rule of whose regex nothing can be told has no gate: its regex sees every line that reaches it."""
    needs = gate(rule.pattern)
    return " AND ".join(_any_sql(lowered if needs.lowered else text, clause) for clause in needs.clauses) or "true"


def any_gate_sql(rules: list[C.Rule], text: str = "line_text", lowered: str = "line_lower") -> str:
    """Necessary condition for some rule to match a line.  Rules without literals are asked themselves, the others aren't."""
    raw, low, open_ended = prefilter([r.pattern for r in rules])
    parts = [_any_sql(text, raw)] * bool(raw) + [_any_sql(lowered, low)] * bool(low)
    parts += [f"rlike({text}, {spark_sql_literal(engine_regex(p))})" for p in open_ended]
    return "(" + (" OR ".join(parts) or "false") + ")"


def line_gate(rules: list[C.Rule], skip_comments: bool = False) -> Column:
    """Which lines (line_text, line_lower) are worth a look: those of ``any_gate_sql``, with ``skip_comments`` (F7) none that
    are blank or begin with a comment marker."""
    keep = F.expr(any_gate_sql(rules))
    if skip_comments:
        keep = keep & (F.trim("line_text") != "") & ~F.col("line_text").rlike(C.COMMENT_PREFIX_RE)
    return keep


def candidate_lines(files: DataFrame, rules: list[C.Rule], keys=FILE_KEYS, content: str = "content",
                    skip_comments: bool = False, file_rows: bool = False, blank_comments: bool = False) -> DataFrame:
    """(keys, line, line_text, line_lower) for the lines where some rule may match.

    Lines are split inside the task and gated by literal ``contains`` checks
    (``any_gate_sql``); only survivors meet a regex.  ``skip_comments``
    (F7) also drops blank lines and lines starting with a comment marker; off by
    default since keys in comments leak as well.

    ``blank_comments`` does so by file type (``functions.comments``): comments of any length become blanks, strings stay.

    ``file_rows`` adds one marker row per file (line 0, null text) so the same
    pass also lists every scanned file."""
    text = F.col(content)
    if blank_comments:  # only of files that hold something to find
        text = F.when(F.expr(any_gate_sql(rules, content, f"lower({content})")), without_comments("path", content)).otherwise(text)
    docs = spread(files.select(*keys, text.alias("_content")), list(keys))
    # Raw and lower-cased lines come out of one generator: the document is
    # lower-cased once, and the gate reads the lowered line as a column (a
    # projected lower() would be inlined into every case-insensitive check).
    raw_lines = split_lines(F.col("_content"))
    low_lines = split_lines(F.lower("_content"))
    if file_rows:
        marker = F.array(F.lit(None).cast("string"))
        none = F.array().cast("array<string>")  # a file without content still has its marker row
        raw_lines, low_lines = (F.concat(marker, F.coalesce(x, none)) for x in (raw_lines, low_lines))
    lines = (docs.select(*keys, raw_lines.alias("line_text"), low_lines.alias("line_lower"))
             .select(*keys, F.posexplode(F.arrays_zip("line_text", "line_lower")).alias("_pos", "_z"))
             .select(*keys, "_pos", F.col("_z.line_text").alias("line_text"), F.col("_z.line_lower").alias("line_lower")))
    keep = line_gate(rules, skip_comments)
    line_no = F.col("_pos") if file_rows else F.col("_pos") + 1
    if file_rows:
        keep = (F.col("_pos") == 0) | keep
    return lines.where(keep).select(*keys, line_no.alias("line"), "line_text", "line_lower")


def _layers_sql(pats: list[str]) -> str:
    """For a line with hits: copies of it of the same length, each with one rule's matches starred out (and one with the
    rest of the line behind a key header), cut into slices."""
    starred = ("array_join(zip_with({pieces}, {found}, (p, f) -> concat(p, coalesce(repeat('*', length(f)), ''))), '')")
    split_by = "CASE h.rule_id " + " ".join(
        f"WHEN {i} THEN split(line_text, {spark_sql_literal(p)}, -1)" for i, p in enumerate(pats)) + " END"
    key = spark_sql_literal(KEY_ON_LINE)
    per_rule = f"transform(_found, h -> {starred.format(pieces=split_by, found='h.found')})"
    body = starred.format(pieces=f"split(line_text, {key}, -1)", found=f"regexp_extract_all(line_text, {key}, 0)")
    return (f"transform(concat({per_rule}, CASE WHEN contains(line_text, 'PRIVATE KEY-----') THEN array({body}) "
            f"ELSE CAST(array() AS ARRAY<STRING>) END), l -> transform(sequence(0, cast(greatest(length(l) - 1, 0) div {SLICE} as int)), "
            f"k -> substring(l, k * {SLICE} + 1, {SLICE})))")


def _window_sql(start: str, n: str) -> str:
    """``n`` characters of the line from ``start`` (1-based), starred wherever any layer is."""
    at = f"cast(({start} - 1) div {SLICE} as int)"
    slices = (f"transform(_layers, l -> substring(concat(coalesce(get(l, {at}), ''), coalesce(get(l, {at} + 1), '')), "
              f"({start} - 1) % {SLICE} + 1, {n}))")
    return (f"CASE WHEN {n} <= 0 THEN '' ELSE transform(array({slices}), s -> array_join(transform(sequence(1, {n}), "
            f"k -> CASE WHEN exists(s, x -> substring(x, k, 1) = '*') THEN '*' ELSE substring(s[0], k, 1) END), ''))[0] END")


def context_sql() -> str:
    """D3 as Spark SQL text over a hit ``m``: the masked match (D4) between up to 40 characters of its line on each side, in
    which every character of any rule's match is a star."""
    left = _window_sql(f"(m.column - least({CONTEXT_WIDTH}, m.column - 1))", f"least({CONTEXT_WIDTH}, m.column - 1)")
    right = _window_sql("(m.column + length(m.raw))", str(CONTEXT_WIDTH))
    return f"concat({left}, {_sql_mask_value('m.raw')}, {right})"


def detect_raw(files: DataFrame, rules: list[C.Rule] | None = None, keys=FILE_KEYS,
               content: str = "content", skip_comments: bool = False, file_rows: bool = False,
               with_context: bool = False, blank_comments: bool = False) -> DataFrame:
    """D1 + D2: one row per match -- keys, line, column, rule_id, raw, match_idx, with ``with_context`` also context (D3).

    ``raw`` is the unmasked match; it never leaves the job (see ``detections``).
    Columns are 1-based code-point offsets inside the line.  A rule's regex runs
    only on lines that pass its literal gate.  The text of a line is never copied to its hits: contexts are sliced before
    the hits become rows.
    """
    rules = C.RULES if rules is None else rules
    lines = candidate_lines(files, rules, keys, content, skip_comments, file_rows, blank_comments)
    return line_hits(lines, rules, keys, file_rows, with_context)


def line_hits(lines: DataFrame, rules: list[C.Rule], keys=FILE_KEYS, file_rows: bool = False, with_context: bool = False) -> DataFrame:
    """The matches on lines (keys, line, line_text, line_lower) that passed ``any_gate_sql``, as ``detect_raw`` gives them."""
    pats = [engine_regex(r.pattern) for r in rules]
    per_rule = ", ".join(
        f"named_struct('rule_id', {i}, 'found', CASE WHEN {rule_gate_sql(r)} "
        f"THEN regexp_extract_all(line_text, {spark_sql_literal(p)}, 0) ELSE CAST(array() AS ARRAY<STRING>) END)"
        for i, (r, p) in enumerate(zip(rules, pats)))
    found_per_rule = F.expr(f"filter(array({per_rule}), h -> size(h.found) > 0)")
    if file_rows:  # the marker row (line 0) passes through as one all-null hit
        marker = F.array(F.lit(None).cast("struct<rule_id:int,found:array<string>>"))
        found_per_rule = F.when(F.col("line") == 0, marker).otherwise(found_per_rule)
    layers = ["_layers"] if with_context else []
    found = lines.select(*keys, "line", "line_text", found_per_rule.alias("_found"))
    if with_context:
        found = found.where(F.size("_found") > 0).withColumn(
            "_layers", F.expr(f"CASE WHEN line > 0 THEN {_layers_sql(pats)} END"))
    pairs = found.select(*keys, "line", "line_text", *layers, F.explode("_found").alias("_h"))
    pairs = pairs.select(*keys, "line", *layers,
                         F.col("_h.rule_id").alias("rule_id"), F.col("_h.found").alias("found"),
                         F.expr("CASE _h.rule_id " + " ".join(
                             f"WHEN {i} THEN split(line_text, {spark_sql_literal(p)}, -1)"
                             for i, p in enumerate(pats)) + " END").alias("pieces"))
    # A match's column is 1 + the lengths of everything before it on the line:
    # seg[j] = len(piece j) + len(match j).  Prefix sums in two levels (blocks of
    # sqrt(k) segments) keep k matches on one line at O(k^1.5) int additions, not
    # O(k^2) -- a minified one-line file with many hits stays cheap.
    pairs = pairs.select(*keys, "line", *layers, "rule_id", "found",
                         F.expr("transform(pieces, x -> length(x))").alias("_pl"),
                         F.expr("zip_with(transform(pieces, x -> length(x)), transform(found, x -> length(x)), "
                                "(p, f) -> p + coalesce(f, 0))").alias("_seg"),
                         F.expr("greatest(1, cast(ceil(sqrt(size(found))) as int))").alias("_b"))
    pairs = pairs.withColumn("_bs", F.expr(
        "transform(sequence(0, cast(ceil(size(found) / _b) as int) - 1), "
        "b -> aggregate(slice(_seg, b * _b + 1, _b), 0, (a, x) -> a + x))"))
    pairs = pairs.withColumn("_bp", F.expr(
        "transform(sequence(0, size(_bs) - 1), b -> aggregate(slice(_bs, 1, b), 0, (a, x) -> a + x))"))
    located = ("transform(found, (v, i) -> named_struct('raw', v, 'column', 1 + element_at(_bp, cast(i div _b as int) + 1) "
               "+ aggregate(slice(_seg, cast(i div _b as int) * _b + 1, i % _b), 0, (a, x) -> a + x) "
               "+ element_at(_pl, i + 1)))")
    explode = F.posexplode_outer if file_rows else F.posexplode
    # All of it inside the generator: in a projection the optimizer would inline the prefix sums into the function over matches.
    hits = F.expr(f"transform({located}, m -> named_struct('raw', m.raw, 'column', m.column, 'context', {context_sql()}))"
                  if with_context else located)
    out = pairs.select(*keys, "line", "rule_id", explode(hits).alias("match_idx", "_m"))
    return out.select(*keys, "line", F.col("_m.column").alias("column"), "rule_id", F.col("_m.raw").alias("raw"), "match_idx",
                      *([F.col("_m.context").alias("context")] if with_context else []))


def enrich(raw_hits: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """Attach catalog fields.  The catalog is a fixed 37-row table: broadcast is safe."""
    return raw_hits.join(F.broadcast(catalog), "rule_id", how)


def _sql_mask_value(x: str) -> str:
    return (f"CASE WHEN length({x}) <= 8 THEN '****' WHEN length({x}) < 40 "
            f"THEN concat(left({x}, 4), '****', right({x}, 4)) ELSE concat(left({x}, 6), '****', right({x}, 6)) END")


def detections(files: DataFrame, spark: SparkSession | None = None, rules: list[C.Rule] | None = None,
               keys=FILE_KEYS, with_context: bool = False, skip_comments: bool = False,
               drop_false_positives: bool = False, file_rows: bool = False,
               value_salt: str | None = None, verdicts: bool = False, blank_comments: bool = False,
               spans: bool = False) -> DataFrame:
    """The public detection record: keys, type, category, severity, value (masked),
    line, column, [context], pattern, recommendation.  Raw values are dropped here;
    with ``value_salt`` a ``value_hash`` (SHA-256 of salt + value) is kept so the
    same secret can be traced across files without storing it.

    ``file_rows`` also emits one row per input file with ``type`` null (see
    ``candidate_lines``), so one pass over the content yields both the file list
    and the detections."""
    raw = detect_raw(files, rules, keys, skip_comments=skip_comments, file_rows=file_rows, with_context=with_context,
                     blank_comments=blank_comments)
    return records(raw, rules, keys, with_context, drop_false_positives, file_rows, value_salt, spark, verdicts, spans)


def records(raw: DataFrame, rules: list[C.Rule] | None = None, keys=FILE_KEYS, with_context: bool = False,
            drop_false_positives: bool = False, file_rows: bool = False, value_salt: str | None = None,
            spark: SparkSession | None = None, verdicts: bool = False, spans: bool = False) -> DataFrame:
    """Detection records of raw matches, with the values masked.  ``spans``: also end_column.  ``verdicts``: also failed_check, the first check of the type's
    own that the match fails (``functions.validators``)."""
    hits = enrich(raw, catalog_df(spark or raw.sparkSession, rules), "left" if file_rows else "inner")
    if drop_false_positives:
        from keysweep.operators.filters import false_positive
        drop = false_positive(F.col("raw"), F.col("pattern")) & ~F.col("type").isin(*[r.type for r in C.BLOCK_MARKERS])
        hits = hits.where(F.col("type").isNull() | ~drop if file_rows else ~drop)
    cols = [*keys, "type", "category", "severity", mask_value(F.col("raw")).alias("value"),
            "line", F.col("column").cast("int").alias("column")]
    if with_context:
        cols.append("context")
    cols += ["pattern", "recommendation"]
    if spans:
        cols.append((F.col("column") + F.length("raw") - 1).cast("int").alias("end_column"))
    if verdicts:
        from keysweep.functions.validators import failed_check
        cols.append(failed_check().alias("failed_check"))
    if value_salt is not None:
        cols.append(F.sha2(F.concat(F.lit(value_salt), F.col("raw")), 256).alias("value_hash"))
    return hits.select(*cols)


# ---------------------------------------------------------------------------
# Multi-line rules, matched over the whole content.
# ---------------------------------------------------------------------------

def detect_blocks(files: DataFrame, rule: C.Rule = C.BLOCK_RULE, keys=FILE_KEYS,
                  content: str = "content") -> DataFrame:
    """Matches that may span lines (private-key blocks).  Line = 1 + newlines
    before the match; column counts from the last newline before it."""
    p = engine_regex(rule.pattern)
    base = (files.select(*keys, F.col(content).alias("_content"))
            .where(F.col("_content").contains("PRIVATE KEY"))
            .select(*keys, F.regexp_extract_all("_content", F.lit(p), 0).alias("found"),
                    F.split("_content", p, -1).alias("pieces"))
            .where(F.size("found") > 0))
    # Each text segment (piece, match, piece, ...) is summarised once as (newlines, characters after its last newline, length),
    # and one pass over these small summaries places every match; no prefix string is rebuilt and no match scans what
    # stands before it.
    summary = ("named_struct('nl', length({0}) - length(replace({0}, '\n', '')), "
               "'tail', length(substring_index({0}, '\n', -1)), 'len', length({0}))")
    pairs = F.expr("zip_with(slice(pieces, 1, size(found)), found, (p, f) -> named_struct('raw', f, 'p', " + summary.format("p")
                   + ", 'f', " + summary.format("f") + "))")
    column = "(CASE WHEN x.p.nl > 0 THEN x.p.tail ELSE a.col + x.p.len END)"
    place = F.expr(
        "aggregate(_pairs, named_struct('nl', 0, 'col', 0, 'out', CAST(array() AS ARRAY<STRUCT<line:INT,column:INT>>)), "
        f"(a, x) -> named_struct('nl', a.nl + x.p.nl + x.f.nl, 'col', CASE WHEN x.f.nl > 0 THEN x.f.tail ELSE {column} + x.f.len END, "
        f"'out', array_append(a.out, named_struct('line', a.nl + x.p.nl + 1, 'column', {column} + 1))), a -> a.out)")
    hits = (base.select(*keys, "found", pairs.alias("_pairs")).select(*keys, "found", place.alias("_places"))
            .select(*keys, F.explode(F.arrays_zip("found", "_places")).alias("_m"))
            .select(*keys, F.col("_m.found").alias("raw"), F.col("_m._places").alias("_pos")))
    return hits.select(*keys, F.lit(rule.type).alias("type"), F.lit(rule.category).alias("category"),
                       F.lit(rule.severity).alias("severity"), mask_value(F.col("raw")).alias("value"),
                       F.col("_pos.line").alias("line"), F.col("_pos.column").alias("column"),
                       F.size(F.split("raw", "\n", -1)).cast("int").alias("n_lines"))


# ---------------------------------------------------------------------------
# Offline validation of (type, value) pairs.
# ---------------------------------------------------------------------------

def validate_secrets(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left join the (fixed, 37-row) catalog; full-match the value against the rule.

    status: unknown_type | placeholder | format_valid | format_invalid.
    """
    full = None
    for r in C.RULES:
        m = F.col("value").rlike("^(?:" + engine_regex(r.pattern) + r")\z")
        full = F.when(F.col("secret_type") == r.type, m) if full is None else full.when(F.col("secret_type") == r.type, m)
    j = requests.join(F.broadcast(catalog.select(F.col("type").alias("secret_type"), "severity", "recommendation")),
                      "secret_type", "left")
    status = (F.when(F.col("severity").isNull(), F.lit("unknown_type"))
              .when(F.col("value").rlike(C.PLACEHOLDER_RE), F.lit("placeholder"))
              .when(full, F.lit("format_valid"))
              .otherwise(F.lit("format_invalid")))
    return j.select("request_id", "secret_type", mask_value(F.col("value")).alias("value"),
                    status.alias("status"), "severity",
                    F.coalesce("recommendation", F.lit("Unknown secret type; no validation rule")).alias("recommendation"))
