"""Pseudonyms, technique mapping, overlong lines, and dropping raw lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public technique numbers for event types.
TECHNIQUES = (
    ("failed_login", "T1110", "Brute Force"),
    ("failed_login_invalid_user", "T1110.003", "Password Spraying"),
    ("invalid_user", "T1087", "Account Discovery"),
    ("successful_login", "T1078", "Valid Accounts"),
    ("sqli_attempt", "T1190", "Exploit Public-Facing Application"),
    ("xss_attempt", "T1189", "Drive-by Compromise"),
    ("path_traversal", "T1083", "File and Directory Discovery"),
)


def pseudonym(value: Column, salt: str, prefix: str = "id", digits: int = 12) -> Column:
    """The same stand-in for the same value and salt; null stays null."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, digits))


def pseudonymize(events: DataFrame, salt: str) -> DataFrame:
    return events.withColumns({"source_ip": pseudonym(F.col("source_ip"), salt, "ip"), "user": pseudonym(F.col("user"), salt, "user")})


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TECHNIQUES), "event_type string, technique_id string, technique string")


def map_techniques(events: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """events with technique_id and technique; the mapping has a row for each event type."""
    d = dimension if dimension is not None else techniques(events.sparkSession)
    return events.join(d, "event_type", "left")


def split_overlong(lines: DataFrame, most: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of lines(raw); rejected lines keep their length, not their text."""
    n = F.length("raw")
    bad = lines.where(n > most).withColumns({"length": n, "rejected_reason": F.lit("overlong")}).drop("raw")
    return lines.where(F.coalesce(n <= most, F.lit(True))), bad


def without_raw(events: DataFrame) -> DataFrame:
    """Events with a digest in place of the raw line."""
    return events.withColumn("raw_sha256", F.sha2("raw_content", 256)).drop("raw_content")
