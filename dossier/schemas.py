"""Schemas of the tables that enter a run; JSON is never inferred."""

from pyspark.sql import types as T

REQUEST_JSON = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("report_type", T.StringType()),
        T.StructField("agent", T.StringType()),
    ]
)
ROLE_JSON = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("agent_role_prompt", T.StringType()),
    ]
)
STRING_LIST_JSON = T.ArrayType(T.StringType())
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
COMPLETION = T.StructType(
    [
        T.StructField("prompt_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
DELTA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("delta", T.StringType()),
        T.StructField("is_end", T.BooleanType()),
    ]
)
