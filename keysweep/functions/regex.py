"""Regex dialect helpers shared by the Spark plans and the DuckDB oracle.

Java (Spark) and RE2 (DuckDB) agree on the subset the catalog uses, except for
``\\s``: ECMAScript counts the Unicode spaces and U+FEFF, Java and RE2 count ASCII
only and disagree on U+000B.  Rewriting ``\\s`` to one explicit class gives the
documented JS semantics and identical matches in both engines.
"""

from __future__ import annotations

# ECMAScript WhiteSpace + LineTerminator code points, as a class body
# in the ``\x{..}`` escape form that both Java and RE2 accept.
JS_SPACE_CLASS_BODY = (
    r"\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def engine_regex(pattern: str) -> str:
    """Rewrite every ``\\s`` (inside or outside a character class) to the JS space set."""
    out = []
    in_class = False
    i = 0
    n = len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(JS_SPACE_CLASS_BODY if in_class else "[" + JS_SPACE_CLASS_BODY + "]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
            # a ']' right after '[' or '[^' is a literal
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append("]")
                i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def case_insensitive(pattern: str) -> str:
    return pattern if pattern.startswith("(?i)") else "(?i)" + pattern


def union_regex(patterns: list[str]) -> str:
    """One alternation that matches wherever any of ``patterns`` matches (a prefilter)."""
    return "|".join("(?:" + p + ")" for p in patterns)


def sql_string(s: str) -> str:
    """A standard SQL string literal (no backslash processing, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def spark_sql_literal(s: str) -> str:
    """A Spark SQL string literal whose value is exactly ``s`` (backslashes and
    quotes escaped for Spark's literal unescaping)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
