"""Data-quality rules on request tables (Q1-Q4).

Each check yields ``violations ARRAY<STRING>`` (all failed rules, like a schema
validator reporting every issue); a row is valid when it is empty.  Valid and
quarantined rows are two filters over one DataFrame.  Lengths are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysweep import catalog as C
from keysweep.operators.filters import utf16_length


def anchored(regex: str) -> str:
    """JS ``$`` (no m flag) is end of text; Java's also matches before a final
    newline.  ``\\z`` means end of text in Java and RE2 alike."""
    return regex[:-1] + "\\z" if regex.endswith("$") and not regex.endswith("\\$") else regex


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]), lambda x: x.isNotNull())


def _name_rules(c: Column, field: str, max_len: int, regex: str, required: bool = True) -> list:
    n = utf16_length(c)
    rules = []
    if required:
        rules.append((c.isNull(), f"{field}_required"))
    rules += [
        (c.isNotNull() & (n < 1), f"{field}_empty"),
        (c.isNotNull() & (n > max_len), f"{field}_too_long"),
        (c.isNotNull() & ~c.rlike(anchored(regex)), f"{field}_format"),
    ]
    return rules


def check_scan_requests(req: DataFrame, with_path: bool = True) -> DataFrame:
    """Q1 (and Q3 without path): owner, repo, branch (default main), path."""
    rules = (_name_rules(F.col("owner"), "owner", C.MAX_OWNER_LEN, C.OWNER_RE)
             + _name_rules(F.col("repo"), "repo", C.MAX_REPO_LEN, C.REPO_RE)
             + _name_rules(F.col("branch"), "branch", C.MAX_BRANCH_LEN, C.BRANCH_RE, required=False))
    if with_path:
        rules.append((utf16_length(F.col("path")) > C.MAX_PATH_LEN, "path_too_long"))
    cols = ["request_id", "owner", "repo", F.coalesce("branch", F.lit(C.DEFAULT_BRANCH)).alias("branch")]
    if with_path:
        cols.append("path")
    return req.select(*cols, _codes(*rules).alias("violations"))


def check_analysis_requests(req: DataFrame) -> DataFrame:
    """Q3: as Q1, no path."""
    return check_scan_requests(req.drop("path"), with_path=False)


def check_snippets(snips: DataFrame) -> DataFrame:
    """Q2: code 1..10 MiB (required), path <= 1000 (optional)."""
    code, path = F.col("code"), F.col("path")
    n = utf16_length(code)
    return snips.select("snippet_id", "code", "path", _codes(
        (code.isNull(), "code_required"),
        (code.isNotNull() & (n < 1), "code_empty"),
        (code.isNotNull() & (n > C.MAX_FILE_SIZE), "code_too_large"),
        (utf16_length(path) > C.MAX_PATH_LEN, "path_too_long"),
    ).alias("violations"))


def check_secret_requests(req: DataFrame) -> DataFrame:
    """Q4: secret type 1..100, value 1..10000 (both required)."""
    t, v = F.col("secret_type"), F.col("value")
    nt, nv = utf16_length(t), utf16_length(v)
    return req.select("request_id", "secret_type", "value", _codes(
        (t.isNull(), "secret_type_required"),
        (t.isNotNull() & (nt < 1), "secret_type_empty"),
        (t.isNotNull() & (nt > C.MAX_SECRET_TYPE_LEN), "secret_type_too_long"),
        (v.isNull(), "value_required"),
        (v.isNotNull() & (nv < 1), "value_empty"),
        (v.isNotNull() & (nv > C.MAX_SECRET_VALUE_LEN), "value_too_long"),
    ).alias("violations"))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)
