"""F7 by file type: comments that may span lines, told from strings.

One expression per family of languages walks a file from its beginning: it matches strings, which stay, and comments, whose
characters become blanks.  Line breaks stay too, so every line and column of the rest is where it was.  A comment marker inside a
string is text, and a quote inside a comment opens nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysweep.functions.regex import spark_sql_literal, sql_string


@dataclass(frozen=True)
class Family:
    """``strings``: quotes of strings that end with their line, ``long_strings``: (open, close) of strings that needn't;
    ``to_line_end`` and ``blocks``: what opens a comment, and closes it; ``no_comment``: what looks like that and isn't."""

    name: str
    extensions: tuple[str, ...]
    strings: tuple[str, ...] = ()
    long_strings: tuple[tuple[str, str], ...] = ()
    to_line_end: tuple[str, ...] = ()
    no_comment: str = ""
    blocks: tuple[tuple[str, str], ...] = ()

    def pattern(self, possessive: bool) -> str:
        """``possessive``: with quantifiers that never give back, which keeps the walk from recursing (only Java has them)."""
        p = "+" if possessive else ""
        parts = [f"{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\z)" for a, b in (*self.long_strings, *self.blocks)]
        parts += [f"{q}[^{q}\\\\\\n]*{p}(?:\\\\(?:[\\s\\S]|\\z)[^{q}\\\\\\n]*{p})*{p}(?:{q}|\\n|\\z)" for q in self.strings]
        parts += [self.no_comment] * bool(self.no_comment) + [f"{re.escape(m)}[^\\n]*" for m in self.to_line_end]
        return "|".join(parts)

    def opens_comment(self) -> list[str]:
        return [*self.to_line_end, *(a for a, _ in self.blocks)]

    def has_extension(self) -> str:
        return r"(?i)\.(?:" + "|".join(re.escape(e) for e in self.extensions) + ")$"


FAMILIES = [
    Family("c", ("c", "h", "cc", "cpp", "hpp", "cs", "java", "kt", "scala", "go", "rs", "swift", "js", "jsx", "ts", "tsx", "mjs", "php", "css", "scss"),
           strings=('"', "'"), long_strings=(("`", "`"),), to_line_end=("//",), no_comment="://", blocks=(("/*", "*/"),)),
    Family("hash", ("py", "rb", "sh", "bash", "yml", "yaml", "toml", "pl", "r", "ps1", "tf", "env", "cfg", "conf", "properties", "dockerfile"),
           strings=('"', "'"), long_strings=(('"""', '"""'), ("'''", "'''")), to_line_end=("#",), no_comment="[^ \\t\\r\\n\"'#]#"),
    Family("sql", ("sql",), strings=('"', "'"), to_line_end=("--",), blocks=(("/*", "*/"),)),
    Family("markup", ("html", "htm", "xml", "svg", "vue", "md"), blocks=(("<!--", "-->"),)),
]


def _blanked(family: Family, text: str, spark: bool) -> str:
    found = family.pattern(possessive=spark)
    if spark:
        p, blank = spark_sql_literal(found), spark_sql_literal("[^\\r\\n]")
        is_comment = " OR ".join(f"startswith(f, {spark_sql_literal(m)})" for m in family.opens_comment())
        return (f"array_join(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (s, f) -> concat(s, coalesce("
                f"CASE WHEN {is_comment} THEN regexp_replace(f, {blank}, ' ') ELSE f END, ''))), '')")
    p = sql_string(found)
    is_comment = " OR ".join(f"starts_with(z[2], {sql_string(m)})" for m in family.opens_comment())
    return (f"array_to_string(list_transform(list_zip(string_split_regex({text}, {p}), regexp_extract_all({text}, {p})), lambda z: z[1] || "
            f"coalesce(CASE WHEN {is_comment} THEN regexp_replace(z[2], '[^\\r\\n]', ' ', 'g') ELSE z[2] END, '')), '')")


def without_comments_sql(path: str = "path", content: str = "content", spark: bool = True) -> str:
    """SQL of ``content`` with the comments blanked, by the extension of ``path``; files of other types stay as they are."""
    whens = []
    for family in FAMILIES:
        test = f"rlike({path}, {spark_sql_literal(family.has_extension())})" if spark else f"regexp_matches({path}, {sql_string(family.has_extension())})"
        some = " OR ".join(f"contains({content}, {(spark_sql_literal if spark else sql_string)(m)})" for m in family.opens_comment())
        whens.append(f"WHEN {test} AND ({some}) THEN {_blanked(family, content, spark)}")
    return f"CASE {' '.join(whens)} ELSE {content} END"


def without_comments(path: str = "path", content: str = "content") -> Column:
    return F.expr(without_comments_sql(path, content))
