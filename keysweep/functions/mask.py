"""Masking, redaction and string-cleaning Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysweep import catalog as C
from keysweep.functions.regex import JS_SPACE_CLASS_BODY, case_insensitive, engine_regex, spark_sql_literal

STARS = "****"


def mask_value(c: Column) -> Column:
    """Adaptive mask -- <=8 chars fully hidden, <40 shows 4+4, else 6+6."""
    n = F.length(c)
    return (F.when(n <= 8, F.lit(STARS))
            .when(n < 40, F.concat(F.left(c, F.lit(4)), F.lit(STARS), F.right(c, F.lit(4))))
            .otherwise(F.concat(F.left(c, F.lit(6)), F.lit(STARS), F.right(c, F.lit(6)))))


def mask_fixed(c: Column) -> Column:
    """Sanitizer mask: <=8 chars -> ****, else first 4 + **** + last 4."""
    return F.when(F.length(c) <= 8, F.lit(STARS)).otherwise(
        F.concat(F.left(c, F.lit(4)), F.lit(STARS), F.right(c, F.lit(4))))


def replace_matches(c: Column, pattern: str, masker=mask_fixed) -> Column:
    """Replace every match of ``pattern`` in ``c`` by ``masker(match)``.

    Pieces between matches (``split``) are interleaved with the masked matches
    (``regexp_extract_all``).  The text is bound once through a one-element
    ``transform`` so nesting several of these stays linear in plan size.
    """
    p = engine_regex(pattern)

    def one(s):
        pieces = F.split(s, p, -1)
        found = F.regexp_extract_all(s, F.lit(p), 0)
        return F.array_join(
            F.zip_with(pieces, found, lambda a, b: F.concat(a, F.coalesce(masker(b), F.lit("")))), "")

    return F.transform(F.array(c), one)[0]


def _contains_any(c: Column, lits) -> Column:
    out = None
    for x in lits:
        out = c.contains(x) if out is None else (out | c.contains(x))
    return out


def _gated_step(text: Column, gate: Column, pattern: str, masker) -> Column:
    # lambdas given to transform must not carry default arguments: close over these
    return F.transform(F.array(text), lambda s: F.when(gate, replace_matches(s, pattern, masker)).otherwise(s))[0]


def redact_text(c: Column, patterns: list[str] | None = None, masker=mask_fixed) -> Column:
    """Sequential fold -- each pattern sees the previous one's output.

    With the default sanitizer patterns each step is gated by its literal anchors
    on the lower-cased input: masking only writes '****' between characters that
    were already adjacent, so it can never create an anchor, and a step whose
    anchors are absent from the input is a no-op that costs no regex scan."""
    if patterns is not None:
        out = c
        for p in patterns:
            out = replace_matches(out, p, masker)
        return out

    def fold(low):
        any_anchor = _contains_any(low, [x for any_of, _ in C.SANITIZER_ANCHORS for x in any_of])
        out = c
        for p, (any_of, also) in zip(C.SANITIZER_PATTERNS, C.SANITIZER_ANCHORS):
            gate = _contains_any(low, any_of)
            if also:
                gate = gate & _contains_any(low, also)
            out = _gated_step(out, gate, case_insensitive(p), masker)
        return F.when(any_anchor, out).otherwise(c)

    return F.transform(F.array(F.lower(c)), fold)[0]


def secret_key_regex() -> str:
    return "(?i)(" + "|".join(k.lower() for k in C.SECRET_CONTEXT_KEYS) + ")"


def redact_map(m: Column) -> Column:
    """R2: per entry, mask values of secret-looking keys, run R1 over the others."""
    key_re = secret_key_regex()
    return F.transform_values(
        m,
        lambda k, v: F.when(k.rlike(key_re),
                            F.when(F.coalesce(F.length(v), F.lit(0)) == 0, F.lit(STARS)).otherwise(mask_fixed(v)))
        .otherwise(redact_text(v)))


# Fixed value: control characters removed from inputs (tab, LF, CR are kept).
CONTROL_CHARS_RE = "[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]"
# What JS String.prototype.trim strips is the same ECMAScript space set as ``\\s``.
JS_TRIM_RE = "^[" + JS_SPACE_CLASS_BODY + "]+|[" + JS_SPACE_CLASS_BODY + "]+$"


def strip_control(c: Column) -> Column:
    """Remove control characters except tab, LF and CR."""
    return F.regexp_replace(c, CONTROL_CHARS_RE, "")


def clean_name(c: Column) -> Column:
    """JS-style trim, then R3."""
    return strip_control(F.regexp_replace(c, JS_TRIM_RE, ""))


def repo_key(owner: Column, repo: Column) -> Column:
    """``owner/repo``."""
    return F.concat_ws("/", owner, repo)


def default_branch(branch: Column) -> Column:
    """Missing branch -> ``main``."""
    return F.coalesce(branch, F.lit(C.DEFAULT_BRANCH))


def default_path_label(path: Column) -> Column:
    """Empty or missing path -> ``entire repository``."""
    return F.coalesce(F.nullif(path, F.lit("")), F.lit(C.DEFAULT_PATH_LABEL))


# ---------------------------------------------------------------------------
# The same R1 / R2 as Spark SQL text, for callers that know their column names:
# one parser call instead of thousands of Column round trips when building the
# plan.  Results equal ``redact_text`` / ``redact_map`` (tested).
# ---------------------------------------------------------------------------

def _sql_mask_fixed(x: str) -> str:
    return f"CASE WHEN length({x}) <= 8 THEN '****' ELSE concat(left({x}, 4), '****', right({x}, 4)) END"


def _sql_contains_any(col: str, lits) -> str:
    return "(" + " OR ".join(f"contains({col}, {spark_sql_literal(x)})" for x in lits) + ")"


def redact_text_sql(text: str, level: int = 0) -> str:
    """R1 over the SQL expression ``text`` (a column name or path)."""
    low = f"low{level}"
    out = text
    for k, (p, (any_of, also)) in enumerate(zip(C.SANITIZER_PATTERNS, C.SANITIZER_ANCHORS)):
        gate = _sql_contains_any(low, any_of) + (f" AND {_sql_contains_any(low, also)}" if also else "")
        lit = spark_sql_literal(engine_regex(case_insensitive(p)))
        sv, a, b = f"s{level}_{k}", f"a{level}_{k}", f"b{level}_{k}"
        replaced = (f"array_join(zip_with(split({sv}, {lit}, -1), regexp_extract_all({sv}, {lit}, 0), "
                    f"({a}, {b}) -> concat({a}, coalesce({_sql_mask_fixed(b)}, ''))), '')")
        out = f"transform(array({out}), {sv} -> CASE WHEN {gate} THEN {replaced} ELSE {sv} END)[0]"
    any_anchor = _sql_contains_any(low, [x for any_of, _ in C.SANITIZER_ANCHORS for x in any_of])
    return f"transform(array(lower({text})), {low} -> CASE WHEN {any_anchor} THEN {out} ELSE {text} END)[0]"


def redact_map_sql(m: str) -> str:
    """R2 over the SQL expression ``m`` (a MAP<STRING,STRING>)."""
    key_re = spark_sql_literal(secret_key_regex())
    return (f"transform_values({m}, (mk, mv) -> CASE WHEN mk rlike {key_re} THEN "
            f"(CASE WHEN coalesce(length(mv), 0) = 0 THEN '****' ELSE {_sql_mask_fixed('mv')} END) "
            f"ELSE {redact_text_sql('mv', level=1)} END)")
