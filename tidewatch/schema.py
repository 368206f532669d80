"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_assumed", T.BooleanType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("is_parsed", T.BooleanType()),
        T.StructField("raw_content", T.StringType()),
    ]
)

CHUNK = "chunk_id string, document_id string, source_title string, section_or_page string, content string, word_count int"
IP_FACTS = "ip string, failed_attempts long, successful_attempts long, first_seen string, last_seen string, users_attempted array<string>"


def _nested(ddl: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


ANALYSIS = f"total_lines long, unparsed_lines long, start_time string, end_time string, ip_aggregations array<struct<{_nested(IP_FACTS)}>>, limitations array<string>"
BENCHMARK_CASE = f"case_id string, description string, analysis struct<total_lines:long, unparsed_lines:long, start_time:string, end_time:string, ip_aggregations:array<struct<{_nested(IP_FACTS)}>>, limitations:array<string>>, chunks array<struct<{_nested(CHUNK)}>>, expected_risk_level string"
ASSESSMENT = "summary string, possible_interpretations array<string>, risk_level string, risk_reasoning string, recommended_actions array<string>, citations array<string>"
