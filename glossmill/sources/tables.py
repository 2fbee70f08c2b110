"""Files as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.languages import detect_language
from glossmill.functions.text import decode_utf8


def source_files(files: DataFrame, language_id: Column | None = None) -> DataFrame:
    """``(path, content | raw, ...)`` with ``language``; bytes in ``raw`` are decoded."""
    if "raw" in files.columns:
        files = files.withColumn("content", decode_utf8(F.col("raw"))).drop("raw")
    return files.withColumn("language", detect_language(F.col("path"), language_id))

