"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("pid", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
    ]
)
TEST_CASE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("priority", T.StringType()),
        T.StructField("suites", T.ArrayType(T.StringType())),
        T.StructField("input", T.StringType()),
        T.StructField("expected", T.StringType()),
    ]
)
TOKEN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
EDGE = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("length", T.IntegerType()), T.StructField("token_id", T.LongType())]
)
SPAN = T.StructType(
    [
        T.StructField("token_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)
#: The token of a term that nothing accounts for; number tokens count down from NUMBER_BASE.
UNKNOWN_ID = -1
NUMBER_BASE = -2
