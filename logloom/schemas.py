"""Schemas of the stored tables. Missing strings are '', never null."""

from pyspark.sql import types as T

_s = lambda *names: [T.StructField(n, T.StringType(), False) for n in names]

EVENT = T.StructType(_s("event_id", "ts", "source", "action", "status", "principal", "src_ip", "region", "account_id", "resource", "user_agent", "raw", "raw_ref", "extra"))
WINDOW = T.StructType([
    *_s("chunk_id", "ts_start", "ts_end", "source", "principal", "src_ip"),
    T.StructField("n_events", T.IntegerType()), T.StructField("n_failures", T.IntegerType()),
    T.StructField("event_names", T.ArrayType(T.StringType())), T.StructField("event_ids", T.ArrayType(T.StringType())),
    T.StructField("risk_score", T.IntegerType()), *_s("text", "search_text"), T.StructField("accounts", T.ArrayType(T.StringType()))])
BRIDGE = T.StructType([*_s("chunk_id", "event_id"), T.StructField("position", T.IntegerType())])
#: Windows as a store keeps them by day.
STORED_WINDOW = T.StructType([*WINDOW.fields, *_s("session_start")])
