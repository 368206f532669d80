"""Scores of reports against benchmark cases, statistics of profiles, eligibility and rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources import files

# Language that a cautious report avoids.
PROHIBITED = r"(?iU)\b(definitely|certainly|undoubtedly|without (a )?doubt|guaranteed|100% (certain|sure)|conclusively|proves that)\b|\b(automatically|immediately) (block|delete|disable|ban|shut ?down|quarantine)|\bhack(ing)? back\b"


def _number(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)


def schema_compliance(status: Column) -> Column:
    return _number(status != "invalid_model_output")


def risk_consistency(status: Column, risk: Column, expected: Column) -> Column:
    return _number((status != "invalid_model_output") & (F.lower(risk) == F.lower(expected)))


def citation_validity(status: Column, citations: Column, known: Column) -> Column:
    """1 if something is cited and everything cited is known."""
    return _number((status != "invalid_model_output") & (F.size(citations) > 0) & F.forall(citations, lambda c: F.array_contains(known, c)))


def token_rate(completion_tokens: Column, total_ms: Column, first_ms: Column) -> Column:
    """Tokens a second of generation; null where a part is missing, zero or not positive."""
    ms = total_ms - first_ms
    return F.when((completion_tokens > 0) & (total_ms > 0) & (ms > 0), completion_tokens / (ms / 1000.0))


def evaluate(reports: DataFrame, cases: DataFrame) -> DataFrame:
    """reports(profile, case_id, status, risk_level, citations, completion_tokens, total_latency_ms,
    time_to_first_token_ms) with the three scores and the token rate, against cases(case_id,
    expected_risk_level, chunk_ids)."""
    r = reports.join(cases, "case_id")
    return r.select(
        "profile",
        "case_id",
        "status",
        schema_compliance(F.col("status")).alias("schema_compliance"),
        risk_consistency(F.col("status"), F.col("risk_level"), F.col("expected_risk_level")).alias("risk_consistency"),
        citation_validity(F.col("status"), F.col("citations"), F.col("chunk_ids")).alias("citation_validity"),
        "total_latency_ms",
        "time_to_first_token_ms",
        token_rate(F.col("completion_tokens"), F.col("total_latency_ms"), F.col("time_to_first_token_ms")).alias("token_rate"),
    )


def case_rows(cases: DataFrame) -> DataFrame:
    """What evaluate() needs of benchmark cases."""
    return cases.select("case_id", "expected_risk_level", F.transform("chunks", lambda c: c.chunk_id).alias("chunk_ids"))


def profile_summary(scores: DataFrame) -> DataFrame:
    failed = F.col("status").isin("invalid_model_output", "error")
    return scores.groupBy("profile").agg(F.count("*").alias("total_cases"), F.count_if(~failed).alias("successful_cases"), F.count_if(failed).alias("failed_cases"))


def write_results(scores: DataFrame, folder: str) -> None:
    """The results of a benchmark as JSON: folder/scores, a line for each case and profile, and folder/summary, one
    for each profile. What was there is replaced."""
    files.write_json(scores, f"{folder}/scores")
    files.write_json(profile_summary(scores), f"{folder}/summary")


#: Accuracy of latency_sketches: rank errors of about 1 %.
KLL_K = 200
_LATENCIES = ("total_latency_ms", "time_to_first_token_ms", "token_rate")


def latency_sketches(runs: DataFrame, *by: str) -> DataFrame:
    """(profile, by..., n_runs, a quantile sketch for each latency and the token rate): rows that can be stored, say
    by day, and merged later. Nulls don't count; a column of nulls alone has a null sketch."""
    sketch = lambda c: F.when(F.count(c) > 0, F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_K)).alias(c)
    return runs.groupBy("profile", *by).agg(F.count("*").alias("n_runs"), *map(sketch, _LATENCIES))


def merged_latencies(sketches: DataFrame) -> DataFrame:
    """(profile, n_runs, median_latency_ms, p95_latency_ms, median_first_token_ms, median_token_rate) of all rows of
    a profile's sketches: within about 1 % of the rank of the exact ones of benchmark_statistics."""
    merged = sketches.groupBy("profile").agg(F.sum("n_runs").alias("n_runs"), *(F.kll_merge_agg_double(c, KLL_K).alias(c) for c in _LATENCIES))
    at = lambda c, q: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(q)))
    return merged.select(
        "profile", "n_runs", at("total_latency_ms", 0.5).alias("median_latency_ms"), at("total_latency_ms", 0.95).alias("p95_latency_ms"), at("time_to_first_token_ms", 0.5).alias("median_first_token_ms"), at("token_rate", 0.5).alias("median_token_rate")
    )


def benchmark_statistics(runs: DataFrame) -> DataFrame:
    """One row for each profile of runs(profile, case_id, findings, expected_findings, claims_cited,
    claims, recommendation_kinds, expected_kinds, total_latency_ms, time_to_first_token_ms, token_rate):
    means of finding recall, unsupported findings, citation coverage and completeness; exact median and
    P95 latency. Ratios over nothing are null and don't count."""
    share = lambda got, want: F.try_divide(F.size(F.array_intersect(got, want)).cast("double"), F.size(F.array_distinct(want)))
    return runs.groupBy("profile").agg(
        F.avg(share("findings", "expected_findings")).alias("finding_recall"),
        F.sum(F.size(F.array_except("findings", "expected_findings"))).alias("unsupported_findings"),
        F.avg(F.try_divide(F.col("claims_cited").cast("double"), F.col("claims"))).alias("citation_coverage"),
        F.avg(share("recommendation_kinds", "expected_kinds")).alias("recommendation_completeness"),
        F.percentile("total_latency_ms", 0.5).alias("median_latency_ms"),
        F.percentile("total_latency_ms", 0.95).alias("p95_latency_ms"),
        F.percentile("time_to_first_token_ms", 0.5).alias("median_first_token_ms"),
        F.percentile("token_rate", 0.5).alias("median_token_rate"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Agreement of two finding sets; 1 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))


def repeated_agreement(runs: DataFrame) -> DataFrame:
    """(profile, case_id, repetition, agreement): findings of a repetition against the first one."""
    first = runs.groupBy("profile", "case_id").agg(F.min_by("findings", "repetition").alias("_f"), F.min("repetition").alias("_r"))
    r = runs.join(first, ["profile", "case_id"]).where("repetition <> _r")
    return r.select("profile", "case_id", "repetition", jaccard(F.col("findings"), F.col("_f")).alias("agreement"))


def eligible_profiles(profiles: DataFrame) -> DataFrame:
    """The profiles that may be chosen, best first, with their place. profiles has one row for each:
    all_cases_completed, schema_compliance, citation_validity, unsupported_findings,
    prohibited_language, and the six measures that decide in turn."""
    ok = profiles.where("all_cases_completed and schema_compliance = 1 and citation_validity = 1 and unsupported_findings = 0 and prohibited_language = 0")
    order = [F.desc(x) for x in ("groundedness", "citation_coverage", "recommendation_completeness", "risk_consistency", "readability")]
    from pyspark.sql import Window

    # one row for each profile that was compared
    return ok.withColumn("place", F.row_number().over(Window.orderBy(*order, F.asc("median_latency_ms"), "profile"))).orderBy("place")


def prohibited_language(text: Column) -> Column:
    return F.coalesce(text.rlike(PROHIBITED), F.lit(False))


def rubric_averages(ratings: DataFrame) -> DataFrame:
    """(profile, category, average, n) of ratings from 0 to 2; others are left out."""
    return ratings.where("rating between 0 and 2").groupBy("profile", "category").agg(F.avg("rating").alias("average"), F.count("*").alias("n"))
