"""From incidents to evidence: the facts of an incident's events, the retrieval query that they give, the
packed guidance, and the evidence text that a model is asked about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import facts, reports, retrieval
from tidewatch.sources import scratch


def incident_events(incidents: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """The events in each incident's window, with the incident as their source_id."""
    lines = incidents.select("incident_id", *keys, F.explode("lines").alias("line_no"))
    return events.join(lines, [*keys, "line_no"]).drop("source_id").withColumnRenamed("incident_id", "source_id")


def incident_evidence(incidents: DataFrame, events: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("source_id",), **options) -> DataFrame:
    """evidence_of() for incidents whose events are in a table of all events."""
    return evidence_of(incident_events(incidents, events, keys), chunks, **options)


def evidence_of(e: DataFrame, chunks: DataFrame, k: int = 5, max_words: int = 1500, per_document: int = 2, digits: int | None = None) -> DataFrame:
    """(incident_id, query, packed_ids, evidence) for events whose source_id is their incident; an incident
    for which nothing was retrieved has no packed ids."""
    logs, ips = facts.log_facts(e), facts.ip_facts(e)
    queries = facts.retrieval_query(logs, facts.concept_flags(ips)).select(F.col("source_id").alias("query_id"), "query")
    # incidents of a kind ask the same: each distinct text is searched for once
    asked = queries.select("query").distinct().select(F.sha2("query", 256).alias("query_id"), "query")
    # k rows for each text: written, they are what the packed ones are joined to, and all chunks are read once
    found = scratch.written(retrieval.semantic_search(chunks, asked, k, digits=digits), "asked")
    packed = retrieval.pack_context(found, max_words, per_document)
    packed = packed.join(found.select("query_id", "chunk_id", "source_title", "section_or_page", "content"), ["query_id", "chunk_id"])
    block = F.struct("rank", "chunk_id", "source_title", "section_or_page", "content")
    context = packed.groupBy(F.col("query_id").alias("_q")).agg(F.array_sort(F.collect_list(block)).alias("_chunks"))
    whole = facts.nested_analysis(logs, ips).join(queries.withColumnRenamed("query_id", "source_id"), "source_id")
    whole = whole.join(context, F.sha2("query", 256) == F.col("_q"), "left")
    chunks_ = F.coalesce("_chunks", F.array().cast(context.schema["_chunks"].dataType))
    analysis = reports.analysis_json(F.struct("total_lines", "unparsed_lines", "start_time", "end_time", "ip_aggregations", "limitations"))
    return whole.select(F.col("source_id").alias("incident_id"), "query", F.transform(chunks_, lambda c: c.chunk_id).alias("packed_ids"), reports.evidence(analysis, chunks_).alias("evidence"))
