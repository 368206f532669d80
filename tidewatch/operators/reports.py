"""Incident reports from model outputs: checks, attempt resolution, report rows and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import let, stripped
from tidewatch.schema import ASSESSMENT

_TEXTS, _LISTS = ("summary", "risk_level", "risk_reasoning"), ("possible_interpretations", "recommended_actions", "citations")
RISKS = ("low", "medium", "high")
FAILED_LIMITATION = "Failed to produce valid model assessment."


def evidence(facts_json: Column, chunks: Column) -> Column:
    """The evidence text of an incident: facts, then the packed chunks(chunk_id, source_title,
    section_or_page, content) in order."""
    block = lambda c: F.concat(
        F.lit("--- Chunk ID: "), c.chunk_id, F.lit(" ---\nSource: "), c.source_title, F.lit("\nSection: "), c.section_or_page, F.lit("\nContent:\n"), c.content, F.lit("\n\n")
    )
    return F.concat(
        F.lit("## Parser Findings (Deterministic Facts)\n"), facts_json, F.lit("\n\n## Retrieved Context (Security Guidance)\n"), F.array_join(F.transform(chunks, block), "")
    )


def _text_json(value: Column) -> Column:
    """A string, number or null as JSON."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null"))


def _or_null(value: Column) -> Column:
    return F.when(value.isNull(), "null").otherwise(_text_json(value))


def _items_json(items: Column, indent: str) -> Column:
    """Pieces of JSON as an array, one a line."""
    line = F.concat(F.lit("[\n" + indent + "  "), F.array_join(items, ",\n" + indent + "  "), F.lit("\n" + indent + "]"))
    return F.when(F.size(items) > 0, line).otherwise("[]")


def _fields_json(fields: list[tuple[str, Column]], indent: str) -> Column:
    """Names and pieces of JSON as an object, one a line."""
    parts = [F.concat(F.lit(f'{indent}  "{n}": '), c) for n, c in fields]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit(f"\n{indent}}}"))


def _stamp_json(ts: Column) -> Column:
    """A time in UTC, with a fraction only if it has one."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(ts.isNull(), "null").otherwise(F.concat(F.lit('"'), F.regexp_replace(text, r"\.000000$", ""), F.lit('Z"')))


def analysis_json(a: Column) -> Column:
    """The facts of a log (total_lines, unparsed_lines, start_time, end_time, ip_aggregations,
    limitations) as JSON with an indent of two; the session's time zone is UTC."""
    texts = lambda values, indent: _items_json(F.transform(values, _text_json), indent)

    def address(x: Column) -> Column:
        fields = [("ip", _or_null(x.ip)), ("failed_attempts", _or_null(x.failed_attempts)), ("successful_attempts", _or_null(x.successful_attempts))]
        fields += [("first_seen", _stamp_json(x.first_seen)), ("last_seen", _stamp_json(x.last_seen)), ("users_attempted", texts(x.users_attempted, "      "))]
        return _fields_json(fields, "    ")

    none = F.expr("cast(array() as array<string>)")
    fields = [("total_lines", _or_null(a.total_lines)), ("unparsed_lines", _or_null(a.unparsed_lines)), ("start_time", _stamp_json(a.start_time)), ("end_time", _stamp_json(a.end_time))]
    fields += [("ip_aggregations", _items_json(F.coalesce(F.transform(a.ip_aggregations, address), none), "  ")), ("limitations", texts(F.coalesce(a.limitations, none), "  "))]
    return _fields_json(fields, "")


def strip_reasoning(content: Column) -> Column:
    """Without thinking blocks and without a code fence around what is left."""
    x = F.regexp_replace(content, "(?is)<think>.*?</think>", "")
    x = F.when(x.startswith("```json"), F.substring(x, 8, 1 << 30)).otherwise(x)
    x = F.when(x.startswith("```"), F.substring(x, 4, 1 << 30)).otherwise(x)
    x = F.when(x.endswith("```"), x.substr(F.lit(1), F.length(x) - 3)).otherwise(x)
    return stripped(x)


def parse_assessment(clean: Column) -> Column:
    """The assessment as a struct, or null unless every field is there with its type and the risk level
    is known. from_json alone would turn numbers into strings, so types are tested first."""
    kinds = lambda v: F.struct(*(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).alias(f) for f in (*_TEXTS, *_LISTS)))

    def checked(of: Column) -> Column:
        types, whole = of.types, of.whole
        ok = whole.risk_level.isin(*RISKS)
        for name in _TEXTS:
            ok = ok & (types[name] == "STRING")
        for name in _LISTS:
            ok = ok & types[name].isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(whole[name], lambda x: x.isNull())
        return F.when(F.coalesce(ok, F.lit(False)), whole)

    parsed = let(F.try_parse_json(clean), kinds)
    return let(F.struct(parsed.alias("types"), F.from_json(clean, ASSESSMENT).alias("whole")), checked)


def invalid_citations(citations: Column, known: Column) -> Column:
    """The cited ids that are not among the packed ones, in order, with repeats."""
    return F.filter(citations, lambda c: ~F.array_contains(known, c))


def check_outputs(outputs: DataFrame, packed: DataFrame) -> DataFrame:
    """outputs(incident_id, attempt, content, ...) with assessment, reject_code (null if valid) and
    n_invalid_citations; packed(incident_id, chunk_id). No rejected text is in the new columns."""
    known = packed.groupBy("incident_id").agg(F.collect_set("chunk_id").alias("_known"))
    got = outputs.join(known, "incident_id", "left").withColumn("_clean", strip_reasoning(F.col("content")))
    got = got.withColumn("_a", parse_assessment(F.col("_clean")))
    bad = F.size(invalid_citations(F.col("_a.citations"), F.coalesce("_known", F.array().cast("array<string>"))))
    got = got.withColumn("n_invalid_citations", F.when(F.col("_a").isNotNull(), bad))
    code = F.when(F.col("_a").isNull(), "schema").when(F.col("n_invalid_citations") > 0, "citation")
    got = got.withColumn("reject_code", code).withColumn("assessment", F.when(F.col("reject_code").isNull(), F.col("_a")))
    return got.drop("_known", "_clean", "_a", "content")


def resolve_attempts(checked: DataFrame, most: int = 2) -> DataFrame:
    """One row for each incident: its first valid attempt, else none; n_attempts used and the last
    reject_code. Attempts over `most` don't count. Best rows are picked by an aggregate, not a sort."""
    c = checked.where(F.col("attempt") <= most)
    keep = F.struct(*[x for x in c.columns if x not in ("incident_id",)])
    good = F.min_by(keep, F.when(F.col("reject_code").isNull(), F.col("attempt")))
    got = c.groupBy("incident_id").agg(good.alias("g"), F.max_by("reject_code", "attempt").alias("last_reject"), F.max("attempt").alias("last_attempt"))
    g = F.col("g")
    valid = g.isNotNull() & g.reject_code.isNull()
    extra = [x for x in ("prompt_tokens", "completion_tokens", "total_latency_ms", "time_to_first_token_ms", "provider", "model") if x in checked.columns]
    return got.select(
        "incident_id",
        F.when(valid, "completed").otherwise("invalid_model_output").alias("status"),
        F.when(valid, g.assessment).alias("assessment"),
        F.when(valid, g.attempt).otherwise(F.col("last_attempt")).alias("n_attempts"),
        F.when(~valid, F.col("last_reject")).alias("reject_code"),
        *(F.when(valid, g[x]).alias(x) for x in extra),
    )


def report_rows(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """Report rows: resolved incidents with their facts(incident_id, total_lines, unparsed_lines,
    limitations, ip_aggregations)."""
    none = F.array().cast("array<string>")
    a, valid = F.col("assessment"), F.col("status") == "completed"
    r = resolved.join(facts, "incident_id", "left")
    has = lambda n: F.col(n) if n in resolved.columns else F.lit(None)
    return r.select(
        "incident_id",
        "status",
        F.when(valid, a.summary).otherwise(F.concat(F.lit("Model output validation failed after "), F.col("n_attempts").cast("string"), F.lit(" attempts."))).alias("summary"),
        F.struct("total_lines", "unparsed_lines", "ip_aggregations").alias("observed_findings"),
        F.coalesce(a.possible_interpretations, none).alias("possible_interpretations"),
        F.coalesce(a.risk_level, F.lit("unknown")).alias("risk_level"),
        F.when(valid, a.risk_reasoning).otherwise(F.concat(F.lit("Validation error: "), F.coalesce("reject_code", F.lit("none")))).alias("risk_reasoning"),
        F.coalesce(a.recommended_actions, none).alias("recommended_actions"),
        F.coalesce(a.citations, none).alias("citations"),
        F.when(valid, F.coalesce("limitations", none)).otherwise(F.array_append(F.coalesce("limitations", none), F.lit(FAILED_LIMITATION))).alias("limitations"),
        F.struct("total_lines", "unparsed_lines").alias("parser_statistics"),
        F.struct(has("provider").cast("string").alias("provider"), has("model").cast("string").alias("model")).alias("model_information"),
        F.struct(*(has(n).cast("double").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_latency_ms", "time_to_first_token_ms"))).alias("performance_metrics"),
    )


def shown_citations(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """(incident_id, place, citation, source_title, section_or_page) with defaults for unknown chunks."""
    c = reports.select("incident_id", F.posexplode("citations").alias("place", "citation"))
    got = c.join(chunks.select(F.col("chunk_id").alias("citation"), "source_title", "section_or_page"), "citation", "left")
    return got.select("incident_id", "place", "citation", F.coalesce("source_title", F.lit("Referenced Document")).alias("source_title"), F.coalesce("section_or_page", F.lit("N/A")).alias("section_or_page"))


def syslog_priority(risk: Column) -> Column:
    """Facility 4: 34, 36 and 38 for high, medium and low, else 37."""
    r = F.upper(stripped(risk))
    return 32 + F.when(r == "HIGH", 2).when(r == "MEDIUM", 4).when(r == "LOW", 6).otherwise(5)


def _parameter(value: Column) -> Column:
    """A value in structured data, escaped as RFC 5424 asks."""
    return F.regexp_replace(value, r'(["\\\]])', r"\\$1")


def syslog_line(report: Column, incident: Column, risk: Column, status: Column, as_of: Column, host: str = "localhost", app: str = "tidewatch", enterprise: int = 53457) -> Column:
    """An RFC 5424 message with the report as JSON; as_of is its time stamp."""
    data = F.concat(F.lit(f'[{app}@{enterprise} incident_id="'), _parameter(incident), F.lit('" risk_level="'), _parameter(F.upper(risk)), F.lit('" status="'), _parameter(status), F.lit('"]'))
    head = F.concat(F.lit("<"), syslog_priority(risk).cast("string"), F.lit(">1"))
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat_ws(" ", head, stamp, F.lit(host), F.lit(app), incident, F.lit("INCIDENT_REPORT"), data, F.concat(F.lit("﻿"), F.to_json(report)))


def ticket_description(summary: Column, risk: Column, reasoning: Column, interpretations: Column, actions: Column, citations: Column) -> Column:
    bullets = lambda a: F.transform(a, lambda x: F.concat(F.lit("- "), x))
    cited = F.array(F.lit(""), F.concat(F.lit("**Knowledge Guidance Citations:** "), F.array_join(citations, ", ")))
    lines = F.concat(
        F.array(
            F.concat(F.lit("**Incident Summary:** "), summary),
            F.concat(F.lit("**Risk Level:** "), F.upper(risk)),
            F.lit(""),
            F.lit("**Assessed Risk Reasoning:**"),
            reasoning,
            F.lit(""),
            F.lit("**Evidence-Supported Interpretations:**"),
        ),
        bullets(interpretations),
        F.array(F.lit(""), F.lit("**Recommended Defensive Actions:**")),
        bullets(actions),
        F.when(F.size(citations) > 0, cited).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(lines, "\n")


def ticket_payloads(reports: DataFrame, as_of: Column, project: str = "SEC", label: str = "Alert") -> DataFrame:
    """(incident_id, payload): JSON for generic receivers and two kinds of ticket systems."""
    risk = F.upper("risk_level")
    level = F.when(risk == "HIGH", "1").when(risk == "MEDIUM", "2").otherwise("3")
    text = ticket_description(F.col("summary"), F.col("risk_level"), F.col("risk_reasoning"), F.col("possible_interpretations"), F.col("recommended_actions"), F.col("citations"))
    fields = F.struct(
        F.struct(F.lit(project).alias("key")).alias("project"),
        F.concat(F.lit(f"[{label}] "), risk, F.lit(": "), F.substring("summary", 1, 200)).alias("summary"),
        text.alias("description"),
        F.struct(F.lit("Security Incident").alias("name")).alias("issuetype"),
        F.struct(F.when(risk == "HIGH", "High").otherwise("Medium").alias("name")).alias("priority"),
    )
    note = F.concat(F.lit("Automated decision support triage (Model: "), F.coalesce("model_information.model", F.lit("LocalLLM")), F.lit(")"))
    service = F.struct(
        F.concat(F.lit(f"[{label} "), F.col("incident_id"), F.lit("] "), F.substring("summary", 1, 160)).alias("short_description"),
        text.alias("description"),
        level.alias("urgency"),
        level.alias("impact"),
        F.lit("Security").alias("category"),
        note.alias("work_notes"),
    )
    payload = F.struct(
        F.lit("security_incident_report").alias("event"),
        "incident_id",
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
        "status",
        risk.alias("risk_level"),
        "summary",
        "risk_reasoning",
        "possible_interpretations",
        "recommended_actions",
        "citations",
        "parser_statistics",
        "observed_findings",
        F.struct(fields.alias("fields")).alias("jira"),
        service.alias("servicenow"),
    )
    return reports.select("incident_id", F.to_json(payload).alias("payload"))
