"""Log records rendered from the table events, so that the log operators have inputs whose right
answers are the columns that they were rendered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads by number: the request and its class. One in three is shown raw, encoded, twice encoded.
PAYLOADS = (
    ("/index.html", None),
    ("/items?id=1' UNION SELECT name FROM users", "sqli_attempt"),
    ("/search?q=<script>alert(1)</script>", "xss_attempt"),
    ("/get?file=../../../../etc/passwd", "path_traversal"),
    ("/shop?cart=7", None),
    ("/a?x=1; DROP TABLE t", "sqli_attempt"),
    ("/b?next=javascript:go()", "xss_attempt"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return e.withColumns({"sec": F.date_trunc("second", "ts"), "ip": address(F.col("user_id")), "port": (1024 + F.col("event_id") % 60000).cast("int"), "name": F.concat(F.lit("user"), F.col("user_id").cast("string"))})


def address(user: Column) -> Column:
    return F.concat(F.lit("10.0."), F.floor(user / 250).cast("string"), F.lit("."), (user % 250 + 1).cast("string"))


def _lines(e: DataFrame, raw: Column, source: Column | None = None) -> DataFrame:
    return e.select((source if source is not None else F.lit("log")).alias("source_id"), F.col("event_id").alias("line_no"), raw.alias("raw"), "event_id")


def ssh_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log for each tenth of the users: error, click, view, purchase, signup become five messages."""
    e = events(spark, sf_dir)
    tail = F.concat(F.lit(" from "), F.col("ip"), F.lit(" port "), F.col("port").cast("string"))
    said = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed password for "), F.col("name"), tail, F.lit(" ssh2")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Accepted publickey for "), F.col("name"), tail, F.lit(" ssh2")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Disconnected from authenticating user "), F.col("name"), F.lit(" "), F.substring(tail, 7, 99)))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Invalid user "), F.col("name"), tail))
        .otherwise(F.lit("Server listening on 0.0.0.0 port 22."))
    )
    stamp = F.date_format("sec", "MMM d HH:mm:ss")
    return _lines(e, F.concat(stamp, F.lit(" host sshd["), F.col("port").cast("string"), F.lit("]: "), said), F.concat(F.lit("log"), (F.col("user_id") % 10).cast("string")))


def windows_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even records nested in an Event, odd ones flat with other keys."""
    e = events(spark, sf_dir)
    code = F.when(F.col("event_type") == "error", 4625).when(F.col("event_type") == "click", 4624).otherwise(4634)
    stamp = F.date_format("sec", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    nested = F.to_json(
        F.struct(
            F.struct(
                F.struct(code.alias("EventID"), F.struct(stamp.alias("@SystemTime")).alias("TimeCreated")).alias("System"),
                F.struct(F.col("name").alias("TargetUserName"), F.col("ip").alias("IpAddress"), F.col("port").cast("string").alias("IpPort")).alias("EventData"),
            ).alias("Event")
        )
    )
    flat = F.to_json(F.struct(code.cast("string").alias("EventId"), stamp.alias("timestamp"), F.col("name").alias("user"), F.col("ip").alias("Source IP"), F.col("port").alias("port")))
    return _lines(e, F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat))


def nginx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    n, form = len(PAYLOADS), (F.floor(F.col("event_id") / len(PAYLOADS)) % 3)
    payload = F.element_at(F.array(*(F.lit(p) for p, _ in PAYLOADS)), (F.col("event_id") % n + 1).cast("int"))
    shown = F.when(form == 0, payload).when(form == 1, F.url_encode(payload)).otherwise(F.url_encode(F.url_encode(payload)))
    status = F.when(F.col("event_type") == "error", "403").when(F.col("event_type") == "signup", "500").otherwise("200")
    stamp = F.date_format("sec", "dd/MMM/yyyy:HH:mm:ss +0000")
    return _lines(e, F.concat(F.col("ip"), F.lit(" - "), F.col("name"), F.lit(" ["), stamp, F.lit('] "GET '), F.regexp_replace(shown, '"', "%22"), F.lit(' HTTP/1.1" '), status, F.lit(" 99")))


def cloudtrail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    login = F.col("event_type").isin("error", "click")
    name = F.when(login, "ConsoleLogin").otherwise("DescribeInstances")
    result = F.when(login, F.struct(F.when(F.col("event_type") == "error", "Failure").otherwise("Success").alias("ConsoleLogin")))
    stamp = F.date_format("sec", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    who = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("name")).alias("userName"), F.concat(F.lit("arn:aws:iam::1:user/"), F.col("name")).alias("arn"))
    error = F.when(F.col("event_type") == "purchase", "AccessDenied")
    return _lines(e, F.to_json(F.struct(stamp.alias("eventTime"), name.alias("eventName"), F.col("ip").alias("sourceIPAddress"), who.alias("userIdentity"), result.alias("responseElements"), error.alias("errorCode"))))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as normalized events: error is a failed login, click a successful one; the user is the key."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "failed_login").when(F.col("event_type") == "click", "successful_login").otherwise(F.concat(F.lit("other_"), F.col("event_type")))
    return e.select(F.lit("log").alias("source_id"), F.col("event_id").alias("line_no"), "ts", F.col("ip").alias("source_ip"), F.col("name").alias("user"), kind.alias("event_type"), F.lit("password").alias("auth_method"), F.lit(True).alias("is_parsed"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts for each labelled document. The first is broken in five ways by doc_id % 6; the
    second is valid unless doc_id % 5 = 0. Latencies and tokens follow from doc_id."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    risk = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    both = labels.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("risk", risk)
    k = F.when(F.col("attempt") == 1, F.col("doc_id") % 6).otherwise(F.when(F.col("doc_id") % 5 == 0, F.lit(1)).otherwise(F.lit(0)))
    body = lambda summary, risk, cites: F.to_json(
        F.struct(summary.alias("summary"), F.array(F.lit("one")).alias("possible_interpretations"), risk.alias("risk_level"), F.lit("because").alias("risk_reasoning"), F.array(F.lit("look")).alias("recommended_actions"), cites.alias("citations"))
    )
    text = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    good = body(text, F.col("risk"), F.array(F.lit("c1")))
    content = (
        F.when(k == 1, body(text, F.lit("severe"), F.array(F.lit("c1"))))
        .when(k == 2, body(text, F.col("risk"), F.array(F.lit("c1"), F.lit("c9"))))
        .when(k == 3, body(F.col("doc_id"), F.col("risk"), F.array(F.lit("c1"))))
        .when(k == 4, F.concat(F.lit("not json "), good))
        .when(k == 5, F.concat(F.lit("<think>hm\n</think>"), good))
        .otherwise(good)
    )
    return both.select(
        F.concat(F.lit("inc_"), F.col("doc_id").cast("string")).alias("incident_id"),
        "doc_id",
        "attempt",
        content.alias("content"),
        (F.col("doc_id") % 500).alias("completion_tokens"),
        (1000.0 + F.col("doc_id") % 4000).alias("total_latency_ms"),
        (F.col("doc_id") % 900).cast("double").alias("time_to_first_token_ms"),
    )


def packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.concat(F.lit("inc_"), F.col("doc_id").cast("string")).alias("incident_id")).distinct()
    return ids.withColumn("chunk_id", F.explode(F.array(F.lit("c1"), F.lit("c2"))))
