from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bursts, facts, normalize, privacy, reports, scoring
from tidewatch.plans import incidents

GOOD = {"summary": "s", "possible_interpretations": ["i"], "risk_level": "low", "risk_reasoning": "r", "recommended_actions": ["a"], "citations": ["chunk-1"]}


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, want", [('<think>secret\n</think>\n{"summary": "Test"}', '{"summary": "Test"}'), ('```json\n{"summary": "Test"}\n```', '{"summary": "Test"}'), ("<THINK>a</THINK>x", "x"), ("```\ny```", "y"), ("", "")])
def test_strip_reasoning(spark, text, want):
    assert one(spark, text, reports.strip_reasoning) == want


def test_assessment_types(spark):
    assert one(spark, json.dumps(GOOD), reports.parse_assessment).risk_level == "low"
    assert one(spark, json.dumps(GOOD | {"citations": [], "extra": 1}), reports.parse_assessment).citations == []
    for bad in ({"summary": 1}, {"risk_level": "severe"}, {"citations": ["a", 1]}, {"citations": "a"}, {"recommended_actions": [None]}, {"risk_reasoning": None}):
        assert one(spark, json.dumps(GOOD | bad), reports.parse_assessment) is None, bad
    for text in ("", "not json", "[]", json.dumps({k: v for k, v in GOOD.items() if k != "summary"})):
        assert one(spark, text, reports.parse_assessment) is None, text


def resolved(spark, *contents):
    rows = [("inc", i, c, 10, 20, 1000.0, 100.0) for i, c in enumerate(contents, 1)]
    out = spark.createDataFrame(rows, "incident_id string, attempt int, content string, prompt_tokens int, completion_tokens int, total_latency_ms double, time_to_first_token_ms double")
    packed = spark.createDataFrame([("inc", "chunk-1")], "incident_id string, chunk_id string")
    facts_ = spark.createDataFrame([("inc", 8, 1, ["x"], ["10.0.0.1"])], "incident_id string, total_lines long, unparsed_lines long, limitations array<string>, ip_aggregations array<string>")
    return reports.report_rows(reports.resolve_attempts(reports.check_outputs(out, packed)), facts_)


def test_attempts(spark):
    r = resolved(spark, json.dumps(GOOD)).first()
    assert (r.status, r.risk_level, r.citations, r.limitations, r.performance_metrics.completion_tokens) == ("completed", "low", ["chunk-1"], ["x"], 20.0)
    r = resolved(spark, "bad", json.dumps(GOOD | {"risk_level": "medium"})).first()
    assert (r.status, r.risk_level) == ("completed", "medium")
    secret = json.dumps(GOOD | {"summary": "SECRET", "citations": ["fake-chunk"]})
    r = resolved(spark, secret, "also SECRET").first()
    assert (r.status, r.risk_level, r.citations) == ("invalid_model_output", "unknown", []) and r.limitations[-1] == reports.FAILED_LIMITATION
    assert "SECRET" not in str(r) and r.summary == "Model output validation failed after 2 attempts."
    assert resolved(spark, "x", "y", json.dumps(GOOD)).first().status == "invalid_model_output"


def test_citations(spark):
    got = spark.createDataFrame([(["c1", "c3", "c3"], ["c1", "c2"])], "c array<string>, k array<string>")
    assert got.select(reports.invalid_citations(F.col("c"), F.col("k"))).first()[0] == ["c3", "c3"]
    known = spark.createDataFrame([("chunk-1", "Guide", "S")], "chunk_id string, source_title string, section_or_page string")
    shown = reports.shown_citations(resolved(spark, json.dumps(GOOD)), known.limit(0)).first()
    assert (shown.source_title, shown.section_or_page) == ("Referenced Document", "N/A")
    assert reports.shown_citations(resolved(spark, json.dumps(GOOD)), known).first().source_title == "Guide"


def test_syslog_and_ticket(spark):
    assert [one(spark, r, reports.syslog_priority) for r in ("HIGH", " medium ", "Low", "unknown")] == [34, 36, 38, 37]
    r = resolved(spark, json.dumps(GOOD | {"risk_level": "high", "summary": 'a "quoted" one'}))
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    line = r.select(reports.syslog_line(F.struct("summary"), F.lit('i"]'), F.col("risk_level"), F.col("status"), at, host="h")).first()[0]
    assert line.startswith('<34>1 2026-01-02T03:04:05.000000Z h tidewatch i"] INCIDENT_REPORT [tidewatch@53457 incident_id="i\\"\\]" risk_level="HIGH" status="completed"] ﻿{')
    payload = json.loads(reports.ticket_payloads(r, at).first().payload)
    assert payload["event"] == "security_incident_report" and payload["jira"]["fields"]["project"]["key"] == "SEC"
    assert "HIGH:" in payload["jira"]["fields"]["summary"] and payload["servicenow"]["urgency"] == payload["servicenow"]["impact"] == "1"
    assert "**Knowledge Guidance Citations:** chunk-1" in payload["servicenow"]["description"] and payload["timestamp"] == "2026-01-02T03:04:05.000000+00:00"


def test_scores(spark):
    rows = [("p", "1", "completed", "LOW", ["c1"], 50, 1500.0, 500.0), ("p", "2", "completed", "high", ["c9"], 0, 1500.0, 500.0), ("p", "3", "completed", "low", [], 5, 100.0, 100.0), ("p", "4", "invalid_model_output", "unknown", [], None, None, None)]
    r = spark.createDataFrame(rows, "profile string, case_id string, status string, risk_level string, citations array<string>, completion_tokens int, total_latency_ms double, time_to_first_token_ms double")
    cases = spark.createDataFrame([(str(i), "low", [("c1",)]) for i in range(1, 5)], "case_id string, expected_risk_level string, chunks array<struct<chunk_id:string>>")
    e = scoring.evaluate(r, scoring.case_rows(cases))
    got = [(x.schema_compliance, x.risk_consistency, x.citation_validity, x.token_rate) for x in e.orderBy("case_id").collect()]
    assert got == [(1.0, 1.0, 1.0, 50.0), (1.0, 0.0, 0.0, None), (1.0, 1.0, 0.0, None), (0.0, 0.0, 0.0, None)]
    assert tuple(scoring.profile_summary(e).first()) == ("p", 4, 3, 1)


def test_language_and_privacy(spark):
    assert one(spark, "This is definitely an attack", scoring.prohibited_language) and not one(spark, "This may be an attack", scoring.prohibited_language)
    a, b = (one(spark, "10.0.0.1", lambda c, s=s: privacy.pseudonym(c, s, "ip")) for s in ("x", "y"))
    assert a != b and a.startswith("ip_") and len(a) == 15
    lines = spark.createDataFrame([("short",), ("x" * 20,), (None,)], "raw string")
    good, bad = privacy.split_overlong(lines, 10)
    assert good.count() == 2 and [(r.length, r.rejected_reason) for r in bad.collect()] == [(20, "overlong")]


FLAGS = [
    ([], "evidence log preservation incident triage"),
    ([("1", 3, 0, ["x"])], "SSH authentication failures evidence log preservation incident triage"),
    ([("1", 10, 0, ["x"])], "SSH authentication failures evidence log preservation incident triage repeated password attempts"),
    ([("1", 3, 1, ["Root"])], "SSH authentication failures evidence log preservation incident triage privileged-account monitoring successful login after failures"),
    ([("1", 0, 0, ["a", "b", "c"])], "brute force credential-access investigation evidence log preservation incident triage invalid-user login"),
]


@pytest.mark.parametrize("ips, want", FLAGS)
def test_query_text(spark, ips, want):
    logs = spark.createDataFrame([("log",)], "source_id string")
    rows = spark.createDataFrame([("log", *x) for x in ips], "source_id string, ip string, failed_attempts long, successful_attempts long, users_attempted array<string>")
    assert facts.retrieval_query(logs, facts.concept_flags(rows)).first().query == want


def test_evidence(spark):
    c = spark.createDataFrame([("{}", [("c1", "T", "S", "body")])], "f string, c array<struct<chunk_id:string,source_title:string,section_or_page:string,content:string>>")
    got = c.select(reports.evidence(F.col("f"), F.col("c"))).first()[0]
    assert got == "## Parser Findings (Deterministic Facts)\n{}\n\n## Retrieved Context (Security Guidance)\n--- Chunk ID: c1 ---\nSource: T\nSection: S\nContent:\nbody\n\n"


def test_incident_evidence(spark):
    lines = [f"Aug 14 10:20:{s:02d} h sshd[1]: Failed password for root from 10.9.8.7 port 1 ssh2" for s in range(5)] + ["Aug 14 10:30:00 h sshd[1]: Accepted password for amy from 10.1.1.1 port 1 ssh2"]
    raw = spark.createDataFrame([("log", i, x) for i, x in enumerate(lines)], "source_id string, line_no long, raw string")
    e = normalize.normalize_ssh(raw, 2026)
    chunks = spark.createDataFrame([("c1", "d1", "SSH", "Guide", "SSH authentication failures and password attempts", 6), ("c2", "d2", "Web", "Guide", "sql injection", 2)], "chunk_id string, document_id string, source_title string, section_or_page string, content string, word_count int")
    got = incidents.incident_evidence(bursts.burst_incidents(e, threshold=5, window_seconds=60), e, chunks, k=1).collect()
    assert len(got) == 1 and got[0].packed_ids == ["c1"] and "repeated password attempts" in got[0].query
    assert "10.9.8.7" not in got[0].query and '"total_lines": 5' in got[0].evidence and "--- Chunk ID: c1 ---" in got[0].evidence and "10.1.1.1" not in got[0].evidence


def test_latencies_from_merged_sketches(spark):
    """Medians and P95 of days merged in any grouping lie within 2 % of rank of the exact ones."""
    import random

    rng = random.Random(2)
    rows = [(f"p{i % 2}", i % 9, rng.lognormvariate(6, 1), None if i % 2 else float(i), None) for i in range(20_000)]
    runs = spark.createDataFrame(rows, "profile string, day int, total_latency_ms double, time_to_first_token_ms double, token_rate double")
    got = {r.profile: r for r in scoring.merged_latencies(scoring.latency_sketches(runs, "day")).collect()}
    for p in ("p0", "p1"):
        times = sorted(r[2] for r in rows if r[0] == p)
        for name, q in (("median_latency_ms", 0.5), ("p95_latency_ms", 0.95)):
            assert times[int((q - 0.02) * len(times))] <= got[p][name] <= times[int((q + 0.02) * len(times))]
        assert got[p].n_runs == 10_000 and got[p].median_token_rate is None
    assert abs(got["p0"].median_first_token_ms - 10_000) < 400 and got["p1"].median_first_token_ms is None
    assert scoring.merged_latencies(scoring.latency_sketches(runs.limit(0))).count() == 0


def test_users_from_merged_sketches(spark):
    """Distinct users over days that share most of them, within 5 % where there are many and exact where few."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tidewatch.operators import facts

    e = spark.range(60_000).select(F.lit("s").alias("source_id"), F.col("id").alias("line_no"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5 * 86_400).alias("ts"), F.lit("a").alias("source_ip"), F.concat(F.lit("u"), (F.col("id") % 20_000).cast("string")).alias("user"), F.lit(True).alias("is_parsed"))
    few = spark.createDataFrame([("s", i, dt.datetime(2026, 1, 1 + i % 3), "b", u, True) for i, u in enumerate(["x", "y", "x", "", None, "z"])], e.schema)
    sketches = facts.user_sketches(e.unionByName(few))
    got = {r.ip: (r.n_days, r.n_users) for r in facts.ip_users(sketches).collect()}
    assert got["a"][0] == 5 and abs(got["a"][1] - 20_000) < 1000 and got["b"] == (3, 3)
    one = facts.ip_users(sketches.where("day = '2026-01-01'")).collect()
    assert [(r.ip, r.n_users) for r in one] == [("b", 1)]


def test_users_of_days_are_exact(spark):
    """However many they are: sketches are not from some hundred users on."""
    from pyspark.sql import functions as F

    from tidewatch.operators import facts

    e = spark.range(30_000).select(F.lit("s").alias("source_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5 * 86_400).alias("ts"), F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("source_ip"), F.concat(F.lit("u"), (F.col("id") % 9_999).cast("string")).alias("user"), F.lit(True).alias("is_parsed"))
    got = facts.exact_ip_users(facts.day_users(e)).collect()
    assert sorted((r.ip, r.n_days, r.n_users) for r in got) == [(f"a{i}", 5, 3333) for i in range(3)]
