"""Content decoding (S3) and snippet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysweep import catalog as C


def decode_base64_utf8(c):
    """base64 text -> UTF-8 string; invalid byte sequences become U+FFFD."""
    return F.make_valid_utf8(F.unbase64(c).cast("string"))


def decode_content(encoded: DataFrame, column: str = "content_b64") -> DataFrame:
    """S3: ``files_encoded`` -> ``files``."""
    return encoded.withColumn("content", decode_base64_utf8(F.col(column))).drop(column)


def snippet_files(snippets: DataFrame) -> DataFrame:
    """S4 input: snippets as scannable rows; missing or empty path -> 'inline'."""
    return snippets.select("snippet_id", F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit(C.INLINE_PATH)).alias("path"),
                           F.col("code").alias("content"))
