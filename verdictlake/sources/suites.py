"""Suite files: YAML lists of samples, or tables with the same columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake import schemas
from verdictlake.functions.text import posix_path
from verdictlake.operators.ingest import (
    DATASET_ROOT,
    DEFAULT_DIFFICULTY,
    DEFAULT_DOMAIN,
    rejected,
    suite_defaults,
)

YAML_FILES = "*.yaml"
ITEMS_PER_FILE = 10_000
#: Characters that JSON takes as they are, and that YAML refuses or reads as the end of a line.
UNSAFE = [chr(c) for c in (*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF)]


def read_suite_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of one suite file, or of all ``*.yaml`` directly in a folder."""
    reader = spark.read.format("binaryFile")
    if not path.lower().endswith((".yaml", ".yml", ".json")):
        reader = reader.option("pathGlobFilter", YAML_FILES)
    return reader.load(path).select(
        F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text")
    )


def parse_suites(files: DataFrame) -> DataFrame:
    """Items of suite files with their file and place; bad items carry a ``reject_reason``."""
    names = schemas.SUITE_ITEM.fieldNames()
    domain, difficulty = DEFAULT_DOMAIN, DEFAULT_DIFFICULTY

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        empty = dict.fromkeys(names)
        required = {"id": "sample_id", "prompt": "prompt", "expected": "expected"}

        def text(value):
            return None if value is None else str(value)

        def rows(file, content):
            try:
                items = yaml.load(content, Loader=loader) or []
            except Exception as problem:
                yield empty | {"file": file, "reject_reason": f"unreadable: {type(problem).__name__}"}
                return
            if not isinstance(items, list):
                yield empty | {"file": file, "reject_reason": "not a list"}
                return
            for pos, item in enumerate(items):
                row = empty | {"file": file, "pos": pos}
                if not isinstance(item, dict):
                    yield row | {"reject_reason": "not a mapping"}
                    continue
                missing = [k for k in required if k not in item]
                if missing:
                    row["reject_reason"] = "missing " + ", ".join(missing)
                row |= {column: text(item.get(key)) for key, column in required.items()}
                row["domain"] = text(item.get("domain", domain))
                row["difficulty"] = text(item.get("difficulty", difficulty))
                tags = item.get("tags", [])
                row["tags"] = None if tags is None else [text(t) for t in (tags if isinstance(tags, list) else [tags])]
                yield row

        for batch in batches:
            found = [r for f, c in zip(batch["file"], batch["text"]) for r in rows(f, c)]
            yield pd.DataFrame(found, columns=names, dtype=object)

    return files.select("file", "text").mapInPandas(parse, schemas.SUITE_ITEM)


def good_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def bad_items(items: DataFrame) -> DataFrame:
    return rejected(items).select("file", "pos", "reject_reason")


def strict_items(items: DataFrame) -> DataFrame:
    """All items; the job fails on the first bad one instead of setting it aside."""
    checked = F.when(
        F.col("reject_reason").isNotNull(),
        F.raise_error(F.concat_ws(": ", "file", "reject_reason")).cast("string"),
    ).otherwise(F.col("sample_id"))
    return items.withColumn("sample_id", checked).drop("reject_reason")


def _checked(items: DataFrame, strict: bool) -> DataFrame:
    return strict_items(items) if strict else good_items(items)


def load_suite(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Samples of one suite, with the file and place that give their order.

    A bad item or file fails the job; with ``strict`` off it is left out, and ``bad_items`` of
    ``parse_suites`` tells which and why.
    """
    items = _checked(parse_suites(read_suite_files(spark, path)), strict)
    return items.withColumn("dataset", posix_path(F.lit(path)))


def _files_under(spark: SparkSession, root: str) -> DataFrame:
    """YAML files at any depth below ``root``, with the folder and file name a request may use."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    below = F.concat(F.lit(DATASET_ROOT), F.substring("path", len(full) + 1, 2**31 - 1))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", YAML_FILES)
        .load(root)
    )
    return files.withColumn("_file", below).withColumn("_folder", F.regexp_extract("_file", "^(.*)/", 1))


def suite_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every path below ``root`` that a request may name: suite folders and single files."""
    names = F.explode(F.array("_folder", "_file")).alias("path")
    return _files_under(spark, root).select(names).distinct()


def load_suites(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """Samples of all suites below ``root`` in one job; ``strict`` as in ``load_suite``.

    A sample is listed under its folder and under its file, the two datasets it is part of.
    """
    files = _files_under(spark, root).select(
        F.col("_file").alias("file"), F.decode("content", "UTF-8").alias("text")
    )
    folder = F.regexp_extract("file", "^(.*)/", 1)
    return _checked(parse_suites(files), strict).withColumn("dataset", F.explode(F.array(folder, F.col("file"))))


def load_table_suite(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A suite kept as Parquet, JSON lines or ORC, with defaults filled in."""
    table = spark.read.schema(schemas.SAMPLE).format(form).load(path)
    return suite_defaults(table.withColumn("file", F.col("_metadata.file_path")))


def write_suites(samples: DataFrame, path: str, suite: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write samples as YAML suites, one item a line, into a folder ``suite=<name>`` per value of ``suite``.

    Files hold at most ``ITEMS_PER_FILE`` items, in ``order``, since one task parses a file; a large suite
    is several files. ``mode`` "append" adds files to suites that are there. ``load_suites`` reads the
    same samples back; a null stays null, but null tags are read as a null list.
    """
    item = F.struct(F.col("sample_id").alias("id"), "prompt", "expected", "domain", "tags", "difficulty")
    line = F.concat(F.lit("- "), F.to_json(item, {"ignoreNullFields": "false"}))
    safe = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"\\u{ord(x):04x}")), UNSAFE, line)
    line = F.when(line.rlike(f"[{''.join(UNSAFE)}]"), safe).otherwise(line)
    rows = samples.withColumn("_suite", F.col(suite).cast("string")).hint("rebalance", "_suite")
    rows = rows.sortWithinPartitions("_suite", *order).select(F.col("_suite").alias("suite"), line.alias("line"))
    plain = {"quote": "", "sep": "\x01", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer = rows.write.mode(mode).partitionBy("suite").option("maxRecordsPerFile", ITEMS_PER_FILE)
    writer.options(extension="yaml", **plain).csv(path)
