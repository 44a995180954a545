"""DuckDB SQL fragments mirroring the Spark operators, for the oracle queries.

The oracle is an independent formulation of the same semantics (set-based SQL
over lists), used only to check the Spark plans; it is never on the job path.
"""

from __future__ import annotations

from keysweep import catalog as C
from keysweep.functions.regex import case_insensitive, engine_regex, sql_string
from keysweep.sources.derived import duckdb_sql

#: A private key on one line, up to its end.
KEY_ON_LINE = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*"
LINE_BREAK = r"'\r?\n'"


def files(name: str = "seeded_documents") -> str:
    return duckdb_sql(name)


def mask_value(x: str) -> str:
    return (f"(CASE WHEN length({x}) <= 8 THEN '****' WHEN length({x}) < 40 "
            f"THEN left({x}, 4) || '****' || right({x}, 4) "
            f"ELSE left({x}, 6) || '****' || right({x}, 6) END)")


def mask_fixed(x: str) -> str:
    return f"(CASE WHEN length({x}) <= 8 THEN '****' ELSE left({x}, 4) || '****' || right({x}, 4) END)"


def replace_matches(text: str, pattern: str, masker=mask_fixed) -> str:
    p = sql_string(engine_regex(pattern))
    return (f"(list_transform([{text}], lambda s: array_to_string(list_transform("
            f"list_zip(string_split_regex(s, {p}), regexp_extract_all(s, {p})), "
            f"lambda z: z[1] || coalesce({masker('z[2]')}, '')), ''))[1])")


def redact_text(text: str, patterns: list[str] | None = None, masker=mask_fixed) -> str:
    out = text
    for p in (C.SANITIZER_PATTERNS if patterns is None else patterns):
        out = replace_matches(out, case_insensitive(p) if patterns is None else p, masker)
    # array_to_string over a NULL list gives '' in DuckDB; keep NULL as NULL
    return f"(CASE WHEN {text} IS NULL THEN NULL ELSE {out} END)"


def catalog_values(rules: list[C.Rule] | None = None) -> str:
    rules = C.RULES if rules is None else rules
    rows = ", ".join(
        f"({i}, {sql_string(r.type)}, {sql_string(r.category)}, {sql_string(r.severity)}, "
        f"{sql_string(r.pattern)}, {sql_string(r.description)}, {sql_string(r.recommendation)})"
        for i, r in enumerate(rules))
    return (f"(SELECT * FROM (VALUES {rows}) AS t(rule_id, type, category, severity, pattern, "
            f"description, recommendation))")


def raw_hits(files_sql: str, rules: list[C.Rule] | None = None, keys=("repository", "branch", "path"),
             line_filter: str | None = None) -> str:
    """(keys, line, col, rule_id, raw, line_text): one row per match, as detect_raw."""
    rules = C.RULES if rules is None else rules
    k = ", ".join(keys)
    lf = f" AND ({line_filter})" if line_filter else ""
    per_rule = "\n  UNION ALL\n".join(
        f"  SELECT {k}, line, line_text, {i} AS rule_id, regexp_extract_all(line_text, {sql_string(engine_regex(r.pattern))}) AS found, "
        f"string_split_regex(line_text, {sql_string(engine_regex(r.pattern))}) AS pieces "
        f"FROM _lines WHERE regexp_matches(line_text, {sql_string(engine_regex(r.pattern))}){lf}"
        for i, r in enumerate(rules))
    return f"""(WITH _files AS ({files_sql}),
_lines AS (
  SELECT {k}, unnest(string_split_regex(content, {LINE_BREAK})) AS line_text,
         unnest(generate_series(1, len(string_split_regex(content, {LINE_BREAK})))) AS line
  FROM _files WHERE content IS NOT NULL),
_hits AS (
{per_rule})
SELECT {k}, CAST(line AS INTEGER) AS line, rule_id, line_text,
       unnest(found) AS raw,
       unnest(list_transform(found, lambda v, i: CAST(1
           + coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS INTEGER))) AS "column",
       unnest(generate_series(0, len(found) - 1)) AS match_idx
FROM _hits)"""


def detections(files_sql: str, rules: list[C.Rule] | None = None, keys=("repository", "branch", "path"),
               with_context: bool = False, line_filter: str | None = None) -> str:
    """The public detection record (masked value), as ``detect.detections``."""
    k = ", ".join(f"h.{x}" for x in keys)
    ctx = ""
    hits = raw_hits(files_sql, rules, keys, line_filter)
    if with_context:
        # independent of the plan: every position of a window is looked up among the spans of all matches on its line
        body = sql_string(KEY_ON_LINE)
        on = " AND ".join(f"h.{x} = s.{x}" for x in (*keys, "line"))
        kk = ", ".join((*keys, "line"))
        span = "struct_pack(a := \"column\", b := \"column\" + length(raw) - 1)"
        char = ("CASE WHEN len(list_filter(s.spans, lambda z: z.a <= p AND p <= z.b)) > 0 OR (s.body > 0 AND p >= s.body) "
                "THEN '*' ELSE substring(h.line_text, p, 1) END")

        def window(first: str, last: str) -> str:
            return f"array_to_string(list_transform(range(CAST({first} AS BIGINT), CAST({last} AS BIGINT) + 1), lambda p: {char}), '')"

        left = window('greatest(1, h."column" - 40)', 'h."column" - 1')
        right = window('h."column" + length(h.raw)', 'least(length(h.line_text), h."column" + length(h.raw) + 39)')
        ctx = f", {left} || {mask_value('h.raw')} || {right} AS context"
        return f"""(WITH hit AS MATERIALIZED {hits},
spans AS (SELECT {kk}, list({span}) AS spans,
                 max(CASE WHEN regexp_matches(line_text, {body}) THEN position(regexp_extract(line_text, {body}) IN line_text) ELSE 0 END) AS body
          FROM hit GROUP BY {kk})
SELECT {k}, c.type, c.category, c.severity, {mask_value('h.raw')} AS value,
       h.line, h."column"{ctx}, c.pattern, c.recommendation
FROM hit h JOIN spans s ON {on} JOIN {catalog_values(rules)} c ON h.rule_id = c.rule_id)"""
    return f"""(SELECT {k}, c.type, c.category, c.severity, {mask_value('h.raw')} AS value,
       h.line, h."column"{ctx}, c.pattern, c.recommendation
FROM {hits} h JOIN {catalog_values(rules)} c ON h.rule_id = c.rule_id)"""


def severity_counts(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join(f"count(*) FILTER (WHERE {a}severity = '{s}') AS {s}" for s in C.SEVERITIES)


def risk_score(c="critical", h="high", m="medium", low="low") -> str:
    w = C.SEVERITY_WEIGHTS
    return (f"CAST(least({C.MAX_RISK_SCORE}, {w['critical']}*{c} + {w['high']}*{h} + {w['medium']}*{m} "
            f"+ {w['low']}*{low}) AS INTEGER)")


def compliance(score: str, c="critical", h="high") -> str:
    return (f"(CASE WHEN {c} > 0 OR {score} >= {C.NON_COMPLIANT_SCORE} THEN 'non_compliant' "
            f"WHEN {h} > 0 OR {score} >= {C.AT_RISK_SCORE} THEN 'at_risk' ELSE 'compliant' END)")


def str_list(items: list[str]) -> str:
    return "[" + ", ".join(sql_string(s) for s in items) + "]"


def remediation_steps(c="critical", h="high") -> str:
    return (f"list_concat(CASE WHEN {c} > 0 THEN {str_list(C.CRITICAL_STEPS)} ELSE []::VARCHAR[] END, "
            f"CASE WHEN {h} > 0 THEN {str_list(C.HIGH_STEPS)} ELSE []::VARCHAR[] END, {str_list(C.GENERAL_STEPS)})")


def recommendations(top3: str, score: str) -> str:
    return (f"list_concat(CASE WHEN len({top3}) > 0 THEN [{sql_string(C.TOP_TYPES_PREFIX)} || array_to_string({top3}, ', ')] "
            f"ELSE []::VARCHAR[] END, CASE WHEN {score} >= {C.HIGH_RISK_SCORE} THEN {str_list(C.HIGH_RISK_RECOMMENDATIONS)} "
            f"ELSE []::VARCHAR[] END, {str_list(C.GENERAL_RECOMMENDATIONS)})")


def severity_rank(sev: str = "severity") -> str:
    return f"(CASE WHEN {sev} = 'critical' THEN 4 WHEN {sev} = 'high' THEN 3 WHEN {sev} = 'medium' THEN 2 ELSE 1 END)"


def rank_label(rank: str) -> str:
    return (f"(CASE WHEN {rank} IS NULL THEN 'none' WHEN {rank} = 4 THEN 'critical' WHEN {rank} = 3 THEN 'high' "
            f"WHEN {rank} = 2 THEN 'medium' ELSE 'low' END)")
