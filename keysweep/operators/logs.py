"""Log tables (R5 with F9): level filter plus redaction of every free-text field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysweep.functions.mask import redact_map_sql, redact_text_sql
from keysweep.operators.filters import log_level_filter


def redact_log(logs: DataFrame, threshold: str = "INFO", production: bool = True) -> DataFrame:
    """Entries at or above ``threshold``; message and error message sanitized, context
    map masked per key.  Production drops the stack; otherwise it is sanitized too
    (a stack can quote secrets)."""
    kept = log_level_filter(logs, threshold)
    err = F.col("error")
    stack = F.lit(None).cast("string") if production else F.expr(redact_text_sql("error.stack"))
    new_err = F.when(err.isNotNull(), F.struct(err["name"].alias("name"),
                                               F.expr(redact_text_sql("error.message")).alias("message"),
                                               stack.alias("stack")))
    cols = [c for c in logs.columns if c not in ("message", "context", "error")]
    return kept.select(*cols, F.expr(redact_text_sql("message")).alias("message"),
                       F.expr(redact_map_sql("context")).alias("context"), new_err.alias("error"))
