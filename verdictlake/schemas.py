"""Fixed table schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("difficulty", T.StringType()),
    ]
)

# A sample as read from a suite file: where it came from, and why it was refused.
SUITE_ITEM = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("pos", T.LongType())]
    + SAMPLE.fields
    + [T.StructField("reject_reason", T.StringType())]
)

RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("models", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)

RUN_STATUSES = ("pending", "running", "completed", "failed")

# Fields a reply adds to a planned call.
RESPONSE = T.StructType(
    [
        T.StructField("response_text", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

# The part of a raw chat reply that is read.
RAW_REPLY = T.StructType(
    [
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
        T.StructField("prompt_eval_count", T.IntegerType()),
        T.StructField("eval_count", T.IntegerType()),
    ]
)

# One scored answer, in the column order of the exported file.
RESULT = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("response_text", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("estimated_cost_usd", T.DoubleType()),
        T.StructField("rouge1", T.DoubleType()),
        T.StructField("rouge2", T.DoubleType()),
        T.StructField("rougeL", T.DoubleType()),
        T.StructField("nli_label", T.StringType()),
        T.StructField("nli_confidence", T.DoubleType()),
        T.StructField("hallucination_flag", T.BooleanType()),
    ]
)

RESULT_COLUMNS = RESULT.fieldNames()

# The store and the per-run listing leave the cost column out.
STORED_COLUMNS = [name for name in RESULT_COLUMNS if name != "estimated_cost_usd"]

STORED_RESULT = T.StructType(
    [T.StructField("run_id", T.StringType())]
    + [f for f in RESULT.fields if f.name != "estimated_cost_usd"]
)

RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)

POINT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("rouge1_mean", T.DoubleType()),
        T.StructField("rougeL_mean", T.DoubleType()),
        T.StructField("halluc_rate", T.DoubleType()),
        T.StructField("latency_p50", T.DoubleType()),
        T.StructField("latency_p95", T.DoubleType()),
    ]
)
