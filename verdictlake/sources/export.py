"""Results as CSV with a header, readable by any spreadsheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictlake import schemas

# Quotes are doubled inside quoted text, and no white space is cut off.
_FORM = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A file with line breaks inside values is read back by one task, so files stay small.
ROWS_PER_FILE = 200000


def write_csv(results: DataFrame, path: str, one_file: bool = False) -> None:
    """All result columns. One file is written by one task, so ask for it on small results only."""
    out = results.select(*schemas.RESULT_COLUMNS)
    if one_file:
        out = out.coalesce(1)
    writer = out.write.mode("overwrite").options(**_FORM)
    if not one_file:
        writer = writer.option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    # A value that no text has stands for null, so that an empty text is read as it was.
    form = {**_FORM, "multiLine": "true", "nullValue": "\u0000"}
    return spark.read.schema(schemas.RESULT).options(**form).csv(path)
