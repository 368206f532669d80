"""Predicates on events. The batch and the streaming failure predicates differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event types that count as success or failure, and privileged accounts.
SUCCESS_EVENTS = ("successful_login", "successful_request", "successful_console_login", "windows_event_4624")
FAILURE_EVENTS = (
    "failed_login",
    "failed_login_invalid_user",
    "invalid_user",
    "failed_request",
    "failed_console_login",
    "sqli_attempt",
    "xss_attempt",
    "path_traversal",
    "web_attack",
    "unauthorized_access",
    "forbidden_access",
    "failed_event",
    "windows_event_4625",
)
PRIVILEGED = ("root", "admin", "administrator", "sysadmin")


def is_success(event_type: Column) -> Column:
    return event_type.isin(*SUCCESS_EVENTS) | event_type.startswith("successful")


def is_failure_batch(event_type: Column) -> Column:
    """Failure in aggregates; success is tested first."""
    named = event_type.isin(*FAILURE_EVENTS) | event_type.startswith("failed_")
    return ~is_success(event_type) & (named | event_type.rlike("attempt|attack|traversal"))


def is_failure_stream(event_type: Column, is_parsed: Column) -> Column:
    """Failure in burst detection: parsed events only, without regard to case."""
    kind = F.lower(F.coalesce(event_type, F.lit("")))
    return is_parsed & (kind.isin(*FAILURE_EVENTS) | kind.startswith("failed_") | kind.rlike("sqli|xss|traversal|attack|unauthorized"))


def is_privileged(user: Column) -> Column:
    return F.lower(user).isin(*PRIVILEGED)
