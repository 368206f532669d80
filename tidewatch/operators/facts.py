"""Deterministic facts about logs: one partial and one final hash aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.predicates import is_failure_batch, is_privileged, is_success

YEAR_LIMITATION = "Syslog entries lack years, so current year was assumed if ISO-8601 wasn't used."


def limitations(unparsed: Column) -> Column:
    said = F.concat(unparsed.cast("string"), F.lit(" line(s) could not be parsed."))
    return F.array_compact(F.array(F.lit(YEAR_LIMITATION), F.when(unparsed > 0, said)))


def log_facts(events: DataFrame, exclude_assumed: bool = False) -> DataFrame:
    """(source_id, total_lines, unparsed_lines, start_time, end_time, limitations) over all lines."""
    ts = F.when(~F.col("ts_assumed"), F.col("ts")) if exclude_assumed else F.col("ts")
    got = events.groupBy("source_id").agg(
        F.count("*").alias("total_lines"), F.count_if(~F.col("is_parsed")).alias("unparsed_lines"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time")
    )
    return got.withColumn("limitations", limitations(F.col("unparsed_lines")))


def ip_facts(events: DataFrame, most_users: int | None = None) -> DataFrame:
    """(source_id, ip, failed_attempts, successful_attempts, first_seen, last_seen, users_attempted,
    n_users, first_line) over parsed lines with an address; first_line orders by first appearance.

    users_attempted has all users of an address in one row. Where that may be too many, `most_users`
    leaves the first so many by name; n_users stays their exact number."""
    e = events.where(F.col("is_parsed") & (F.coalesce("source_ip", F.lit("")) != ""))
    user = F.nullif("user", F.lit(""))
    got = e.groupBy("source_id", F.col("source_ip").alias("ip")).agg(
        F.count_if(is_failure_batch(F.col("event_type"))).alias("failed_attempts"),
        F.count_if(is_success(F.col("event_type"))).alias("successful_attempts"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        *([F.array_sort(F.collect_set(user)).alias("users_attempted")] if most_users is None else []),
        F.min("line_no").alias("first_line"),
    )
    if most_users is None:
        return got.withColumn("n_users", F.size("users_attempted").cast("long"))
    names = e.where(user.isNotNull()).groupBy("source_id", F.col("source_ip").alias("ip"), "user").agg(F.lit(1).alias("_one"))
    by = Window.partitionBy("source_id", "ip")
    ranked = names.select("source_id", "ip", "user", F.row_number().over(by.orderBy("user")).alias("_r"), F.count("*").over(by).alias("n_users"))
    kept = ranked.where(F.col("_r") <= most_users).groupBy("source_id", "ip").agg(F.array_sort(F.collect_list("user")).alias("users_attempted"), F.max("n_users").alias("n_users"))
    none = F.array().cast("array<string>")
    return got.join(kept, ["source_id", "ip"], "left").withColumns({"users_attempted": F.coalesce("users_attempted", none), "n_users": F.coalesce("n_users", F.lit(0).cast("long"))})


#: log2 of the buckets of user sketches: a relative error of 1.04 / sqrt(2^12), 1.6 %.
HLL_BITS = 12


def _of_users(events: DataFrame) -> DataFrame:
    e = events.where(F.col("is_parsed") & (F.coalesce("source_ip", F.lit("")) != "") & (F.coalesce("user", F.lit("")) != ""))
    return e.select("source_id", F.col("source_ip").alias("ip"), F.to_date("ts").alias("day"), "user")


def user_sketches(events: DataFrame) -> DataFrame:
    """(source_id, ip, day, users): for each address and day a sketch of its users, at most 4 KB however many they
    are. The rows of a day are stored once; ip_users() merges any of them."""
    return _of_users(events).groupBy("source_id", "ip", "day").agg(F.hll_sketch_agg("user", HLL_BITS).alias("users"))


def day_users(events: DataFrame) -> DataFrame:
    """(source_id, ip, day, user): the users of each address and day, each once. The exact counterpart of
    user_sketches(), a row for each user instead of 4 KB; merged by exact_ip_users()."""
    return _of_users(events).distinct()


def exact_ip_users(users: DataFrame) -> DataFrame:
    """(source_id, ip, n_days, n_users) of the days of day_users() that are given, exact however many they are."""
    return users.groupBy("source_id", "ip").agg(F.count_distinct("day").alias("n_days"), F.count_distinct("user").alias("n_users"))


def ip_users(sketches: DataFrame) -> DataFrame:
    """(source_id, ip, n_days, n_users) of the days that are given: the distinct users over all of them, within a few
    per cent. exact_ip_users() has the exact number, ip_facts() the list."""
    got = sketches.groupBy("source_id", "ip").agg(F.count_distinct("day").alias("n_days"), F.hll_union_agg("users").alias("users"))
    return got.select("source_id", "ip", "n_days", F.hll_sketch_estimate("users").alias("n_users"))


def nested_analysis(logs: DataFrame, ips: DataFrame) -> DataFrame:
    """One row for each log with its addresses as an array in order of first appearance."""
    item = F.struct("first_line", "ip", "failed_attempts", "successful_attempts", "first_seen", "last_seen", "users_attempted")
    nested = ips.groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    got = logs.join(nested, "source_id", "left")
    return got.withColumn("ip_aggregations", F.transform("_i", lambda x: x.dropFields("first_line"))).drop("_i")


def concept_flags(ips: DataFrame) -> DataFrame:
    """(source_id, total_failures, success_after_failure, multiple_accounts, privileged)."""
    return ips.groupBy("source_id").agg(
        F.sum("failed_attempts").alias("total_failures"),
        F.bool_or((F.col("failed_attempts") > 0) & (F.col("successful_attempts") > 0)).alias("success_after_failure"),
        F.bool_or(F.size("users_attempted") > 1).alias("multiple_accounts"),
        F.bool_or(F.exists("users_attempted", is_privileged)).alias("privileged"),
    )


# Phrases of the retrieval query.
ALWAYS = ("incident triage", "evidence log preservation")
FAILURES, REPEATED = "SSH authentication failures", "repeated password attempts"
ACCOUNTS = ("credential-access investigation", "invalid-user login", "brute force")
PRIVILEGED_TEXT, AFTER_TEXT = "privileged-account monitoring", "successful login after failures"


def retrieval_query(logs: DataFrame, flags: DataFrame) -> DataFrame:
    """(source_id, query): sorted concept phrases; no address or user name is in them."""
    f = logs.select("source_id").join(flags, "source_id", "left")
    phrases = F.array(
        *map(F.lit, ALWAYS),
        F.when(F.col("total_failures") > 0, FAILURES),
        F.when(F.col("total_failures") >= 5, REPEATED),
        *(F.when(F.col("multiple_accounts"), x) for x in ACCOUNTS),
        F.when(F.col("privileged"), PRIVILEGED_TEXT),
        F.when(F.col("success_after_failure"), AFTER_TEXT),
    )
    return f.select("source_id", F.array_join(F.array_sort(F.array_compact(phrases)), " ").alias("query"))


def repeated_failures(events: DataFrame, key: str = "source_ip", least: int = 5, seconds: int = 300) -> DataFrame:
    """Failures that are at least the `least`-th of their key within the seconds before them, with n_recent."""
    w = Window.partitionBy(key).orderBy(F.col("ts").cast("long")).rangeBetween(-seconds, 0)
    return events.where(is_failure_batch(F.col("event_type"))).withColumn("n_recent", F.count("*").over(w)).where(F.col("n_recent") >= least)


def success_after_failures(events: DataFrame, keys: tuple[str, ...] = ("source_ip", "user"), least: int = 5, seconds: int = 900) -> DataFrame:
    """Successes with at least `least` failures of the same keys in the seconds before them, with n_failures."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").cast("long")).rangeBetween(-seconds, 0)
    got = events.withColumn("n_failures", F.count_if(is_failure_batch(F.col("event_type"))).over(w))
    return got.where(is_success(F.col("event_type")) & (F.col("n_failures") >= least))


def activity_summary(events: DataFrame) -> DataFrame:
    """One row for each log: sources, the most active one, users, privileged and invalid-user attempts,
    authentication methods and duration in seconds."""
    by_ip = events.where("source_ip is not null").groupBy("source_id", "source_ip").agg(F.count("*").alias("n"))
    top = by_ip.groupBy("source_id").agg(F.count("*").alias("unique_sources"), F.min(F.struct((-F.col("n")).alias("n"), "source_ip")).alias("t"))
    top = top.select("source_id", "unique_sources", F.col("t.source_ip").alias("most_active_source"), (-F.col("t.n")).alias("most_active_events"))
    rest = events.groupBy("source_id").agg(
        F.array_sort(F.collect_set("user")).alias("targeted_users"),
        F.count_if(is_privileged(F.col("user"))).alias("privileged_attempts"),
        F.count_if(F.col("event_type").isin("invalid_user", "failed_login_invalid_user")).alias("invalid_user_attempts"),
        F.array_sort(F.collect_set("auth_method")).alias("auth_methods"),
        (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("duration_seconds"),
    )
    return rest.join(top, "source_id", "left")
