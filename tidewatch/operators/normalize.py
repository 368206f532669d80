"""Log normalization: raw records of four kinds into one event table.

Each normalize_* function takes a DataFrame with source_id, line_no and raw (and any `year`), batch or
streaming, and returns the schema EVENT. All of it is Column expressions. A time that can't be read is
`fallback_ts` (default: the query's current time) and has ts_assumed true.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import times, web
from tidewatch.functions.json_maps import first_present, first_text, inner, json_map, named
from tidewatch.functions.text import once, stripped
from tidewatch.functions.times import found
from tidewatch.schema import EVENT
from tidewatch.sources import scratch

# Sshd messages in the order in which they are tried: event type, pattern, groups of method, user, ip, port.
SSH_MESSAGES = (
    ("successful_login", r"Accepted (password|publickey) for (\S+) from (\S+) port (\d+)", (1, 2, 3, 4)),
    ("failed_login_invalid_user", r"Failed (password|publickey) for invalid user (\S+) from (\S+) port (\d+)", (1, 2, 3, 4)),
    ("failed_login", r"Failed (password|publickey) for (\S+) from (\S+) port (\d+)", (1, 2, 3, 4)),
    ("invalid_user", r"Invalid user (\S+) from (\S+) port (\d+)", (None, 1, 2, 3)),
    ("connection_closed", r"Connection closed by (?:(?:authenticating|invalid) user (\S+) )?(\S+) port (\d+)", (None, 1, 2, 3)),
    ("disconnected", r"Disconnected from (?:(?:authenticating|invalid) user (\S+) )?(\S+) port (\d+)", (None, 1, 2, 3)),
)
# Where an sshd message starts.
_SSHD = r"sshd(?:\[\d+\])?:\s+.*"
_UNICODE = "(?U)"
#: All messages as one pattern whose branches are tried in order, each at any place.
_SSH_ANY = _UNICODE + "^(?:" + "|".join(f".*?{p}" for _, p, _ in SSH_MESSAGES) + ").*$"


def _finish(df: DataFrame, ts: Column, fallback_ts: Column | None, ip: Column, user: Column, event_type: Column, port: Column, is_parsed: Column, method: Column | None = None) -> DataFrame:
    got = {
        "source_id": F.col("source_id"),
        "line_no": F.col("line_no"),
        "ts": F.coalesce(ts, fallback_ts if fallback_ts is not None else F.current_timestamp()),
        "ts_assumed": ts.isNull(),
        "source_ip": ip,
        "user": user,
        "event_type": event_type,
        "port": port,
        "auth_method": method if method is not None else F.lit(None),
        "is_parsed": is_parsed,
        "raw_content": F.col("raw"),
    }
    return df.select(*(got[f.name].cast(f.dataType).alias(f.name) for f in EVENT))


def normalize_ssh(df: DataFrame, year: int | None = None, fallback_ts: Column | None = None) -> DataFrame:
    """sshd lines. year is that of stamps without one (default: a column `year`)."""
    raw = F.col("raw")
    stamp = F.coalesce(times.iso(raw, times.ISO_AT_START), times.syslog(raw, F.lit(year) if year is not None else F.col("year")))
    df = df.withColumn("_ts", stamp).withColumn("_msg", F.regexp_extract(raw, _SSHD, 0))
    # one search puts the groups of all messages on lines of their own; no group holds white space
    n = sum(len([g for g in groups if g]) for _, _, groups in SSH_MESSAGES)
    df = once(df, _g=F.split(F.regexp_replace("_msg", _SSH_ANY, "\n".join(f"${g}" for g in range(1, n + 1))), "\n"))
    kind, parts, start = [], {p: [] for p in ("method", "user", "ip", "port")}, 0
    for name, _, groups in SSH_MESSAGES:
        at = [F.nullif(F.get("_g", F.lit(start + g - 1)), F.lit("")) if g else None for g in groups]
        kind.append(F.when((F.size("_g") == n) & at[3].isNotNull(), name))
        for p, x in zip(parts, at, strict=True):
            parts[p] += [x] if x is not None else []
        start += len([g for g in groups if g])
    hit = F.size("_g") == n
    found_in = {p: F.when(hit, F.coalesce(*x)) for p, x in parts.items()}
    event = F.coalesce(*kind, F.when(F.col("_msg") != "", "unparsed_sshd"), F.lit("unparsed"))
    return _finish(df, F.col("_ts"), fallback_ts, found_in["ip"], found_in["user"], event, found_in["port"].try_cast("int"), hit, found_in["method"])


# Keys of Windows records in the order in which they are tried; those with a dot are inside.
_WIN_ID = ("EventID", "EventId", "event_id", "System.EventID")
_WIN_TIME = ("TimeCreated", "time_created", "Timestamp", "timestamp", "System.TimeCreated")
_WIN_USER = ("EventData.TargetUserName", "EventData.TargetUser", "EventData.AccountName", "EventData.SubjectUserName", "TargetUserName", "AccountName", "user", "User", "Account Name")
_WIN_IP = ("EventData.IpAddress", "EventData.IPAddress", "EventData.SourceNetworkAddress", "EventData.ClientAddress", "IpAddress", "SourceAddress", "ip", "Source IP", "Source Network Address")
_WIN_PORT = ("EventData.IpPort", "EventData.SourcePort", "IpPort", "port", "Port")
# What the text form of a Windows record is searched for.
_WIN_TEXT_ID = r"(?iuU)(?:Event\s*ID|EventID|Event)[\s:=]+(\d+)"
_WIN_TEXT_USER = r"(?iuU)(?:Account\s*Name|TargetUserName|Target\s*User\s*Name|User\s*Name|User)[\s:=]+['\"]?([^\s,;'\"]+)"
_WIN_TEXT_IP = r"(?iuU)(?:Source\s*Network\s*Address|Source\s*IP|IpAddress|ClientAddress|Client\s*IP|IP)[\s:=]+['\"]?([0-9a-fA-F:\.]+)['\"]?"
_WIN_TEXT_PORT = r"(?iuU)(?:Source\s*Port|IpPort|Port)[\s:=]+['\"]?(\d+)['\"]?"


def _windows_time(text: Column) -> Column:
    return F.coalesce(times.iso(text), times.first_format(stripped(text), "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "d/MMM/yyyy:HH:mm:ss"))


def _windows_type(event_id: Column) -> Column:
    return F.when(event_id == 4624, "successful_login").when(event_id == 4625, "failed_login").when(event_id.isNotNull(), F.concat(F.lit("windows_event_"), event_id.cast("string")))


def normalize_windows(df: DataFrame, year: int | None = None, fallback_ts: Column | None = None) -> DataFrame:
    """Windows security records: a JSON object in a line, else text with labelled fields."""
    text = F.col("_line")
    df = df.withColumn("_line", stripped(F.col("raw"))).withColumn("_m", json_map(text))
    df = df.withColumn("_m", F.coalesce(inner(F.col("_m"), "Event"), F.col("_m")))
    df = df.withColumns({"_json": F.col("_m").isNotNull(), "System": inner(F.col("_m"), "System"), "EventData": inner(F.col("_m"), "EventData")})
    v = F.col("_m")
    df = df.withColumns({"_u": first_text(v, *_WIN_USER), "_other": named(first_text(v, "EventData.SubjectUserName", "SubjectUserName"), "-"), "_stamp": F.when(F.col("_json"), first_text(v, *_WIN_TIME, key="@SystemTime")).otherwise(text)})
    user = named(F.when(stripped(F.col("_u")).isin("-", "", "SYSTEM", "ANONYMOUS LOGON"), F.coalesce("_other", "_u")).otherwise(F.col("_u")), "-")
    df = df.withColumn("_id", F.when(F.col("_json"), stripped(first_present(v, *_WIN_ID)).try_cast("long")).otherwise(found(text, _WIN_TEXT_ID).try_cast("long")))
    hit = F.col("_id").isNotNull()
    df = df.withColumns(
        {
            "_user": F.when(F.col("_json"), user).when(hit, named(found(text, _WIN_TEXT_USER), "-", "ANONYMOUS LOGON", "SYSTEM")),
            "_ip": F.when(F.col("_json"), named(first_text(v, *_WIN_IP), "-")).when(hit, found(text, _WIN_TEXT_IP)),
            "_port": F.when(F.col("_json"), stripped(first_text(v, *_WIN_PORT))).when(hit, found(text, _WIN_TEXT_PORT)).try_cast("int"),
            "_ts": _windows_time(F.col("_stamp")),
        }
    )
    empty = F.col("_line") == ""
    kind = F.when(empty, "empty_line").otherwise(F.coalesce(_windows_type(F.col("_id")), F.lit("unparsed_windows")))
    ok = ~empty & (F.col("_id").isNotNull() | (F.col("_json") & (F.col("_user").isNotNull() | F.col("_ip").isNotNull())))
    return _finish(df, F.col("_ts"), fallback_ts, F.col("_ip"), F.col("_user"), kind, F.col("_port"), ok)


# An access record: address, user, time, request, status.
_ACCESS = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})'


def normalize_nginx(df: DataFrame, year: int | None = None, fallback_ts: Column | None = None, attack_rules=web.ATTACK_RULES) -> DataFrame:
    """Web access records: a JSON object in a line, else the combined or the short log format."""
    text = F.col("_line")
    df = df.withColumn("_line", stripped(F.col("raw")))
    groups = "\n".join(f"${g}" for g in range(1, 6))
    one_search = F.split(F.regexp_replace(text, f"(?s){_UNICODE}{_ACCESS}.*$", groups), "\n")
    by_group = F.when(text.rlike(_UNICODE + _ACCESS), F.array(*(F.regexp_extract(text, _UNICODE + _ACCESS, g) for g in range(1, 6))))
    df = once(df, _m=json_map(text), _g=F.when(text.contains("\n"), by_group).otherwise(one_search))
    df = df.withColumns({"_json": F.col("_m").isNotNull(), "_hit": F.coalesce(F.size("_g") == 5, F.lit(False)), "_code": first_text(F.col("_m"), "status", "status_code")})
    v = F.col("_m")
    pick = lambda a, b: F.when(F.col("_json"), a).when(F.col("_hit"), b)
    part = lambda group: F.get("_g", F.lit(group - 1))
    df = df.withColumns(
        {
            "_ip": pick(stripped(first_text(v, "remote_addr", "client_ip", "ip")), part(1)),
            "_user": pick(named(first_text(v, "remote_user", "user"), "-"), named(part(2), "-")),
            "_time": pick(first_text(v, "time_local", "time_iso8601", "timestamp"), part(3)),
            "_request": pick(F.coalesce(first_text(v, "request", "uri"), F.lit("")), part(4)),
            "_status": pick(F.coalesce(F.when(F.col("_code").rlike(r"^\d+$"), F.col("_code").try_cast("int")), F.lit(200)), part(5).try_cast("int")),
        }
    )
    stamp = stripped(F.col("_time"))
    ts = F.coalesce(times.first_format(stamp, "d/MMM/yyyy:HH:mm:ss Z", "d/MMM/yyyy:HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss"))
    df = once(df, _attack=web.attack_class(F.col("_request"), attack_rules))
    ok = F.col("_json") | F.col("_hit")
    kind = F.when(F.col("_line") == "", "empty_line").when(ok, web.http_event_type(F.col("_attack"), F.col("_status"), F.col("_request"), F.col("_user"))).otherwise("unparsed_nginx")
    return _finish(df, ts, fallback_ts, F.col("_ip"), F.col("_user"), kind, F.lit(None), ok & (F.col("_line") != ""))


# What the text form of a cloud audit record is searched for.
_CLOUD_TEXT, _CLOUD_USER = "ConsoleLogin|AWSCloudTrail", r"(?iuU)(?:user(?:Name)?|arn)=['\"]?([^\s,'\"]+)"
_CLOUD_IP = r"(?i)(?:sourceIPAddress|ip)=['\"]?([0-9a-fA-F:\.]+)"
_CLOUD_FAILED, _CLOUD_GOOD = "(?i)(Failure|failed|error|Unauthorized)", "(?i)(Success|accepted)"


def normalize_cloudtrail(df: DataFrame, year: int | None = None, fallback_ts: Column | None = None) -> DataFrame:
    """Cloud audit records: a JSON object in a line (all records of a `Records` list, each a row), else
    text that names a console login."""
    text = F.col("_line")
    df = df.withColumn("_line", stripped(F.col("raw"))).withColumn("_m", json_map(text))
    records = F.from_json(F.try_element_at("_m", F.lit("Records")), "array<map<string,string>>")
    df = df.withColumn("_m", F.explode_outer(F.coalesce(records, F.array("_m"))))
    v = F.col("_m")
    df = df.withColumns({"_json": v.isNotNull(), "userIdentity": inner(v, "userIdentity"), "responseElements": inner(v, "responseElements")})
    df = df.withColumns(
        {
            "_name": F.lower(F.coalesce(stripped(first_text(v, "eventName", "event_name")), F.lit(""))),
            "_console": text.rlike(_CLOUD_TEXT) & v.isNull(),
            "_u": named(first_text(v, "userIdentity.userName", "userIdentity.principalId", "userIdentity.arn", "userName", "user"), "-", "null"),
            "_error": first_text(v, "errorMessage", "errorCode").isNotNull(),
            "_status": F.lower(F.coalesce(first_text(v, "responseElements.ConsoleLogin", "ConsoleLogin"), F.lit(""))),
            "_stamp": F.when(F.col("_json"), first_text(v, "eventTime", "event_time", "timestamp")).otherwise(text),
        }
    )
    user = F.when(F.col("_u").startswith("arn:aws:"), F.element_at(F.split("_u", "/"), -1)).otherwise(F.col("_u"))
    ip = named(first_text(v, "sourceIPAddress", "source_ip_address", "sourceIP", "ip"), "-", "AWS Internal", "null")
    df = df.withColumns(
        {
            "_user": F.when(F.col("_json"), user).when(F.col("_console"), found(text, _CLOUD_USER)),
            "_ip": F.when(F.col("_json"), ip).when(F.col("_console"), found(text, _CLOUD_IP)),
            "_ts": times.iso(F.col("_stamp")),
        }
    )
    json_kind = (
        F.when(F.col("_name") == "consolelogin", F.when((F.col("_status") == "failure") | F.col("_error"), "failed_login").otherwise("successful_login"))
        .when(F.col("_name") != "", F.concat(F.when(F.col("_error"), "failed_aws_").otherwise("aws_"), F.col("_name")))
        .otherwise("unparsed_cloudtrail")
    )
    text_kind = F.when(text.rlike(_CLOUD_FAILED), "failed_login").when(text.rlike(_CLOUD_GOOD), "successful_login").otherwise("aws_consolelogin")
    empty = F.col("_line") == ""
    kind = F.when(empty, "empty_line").when(F.col("_json"), json_kind).when(F.col("_console"), text_kind).otherwise("unparsed_cloudtrail")
    ok = ~empty & F.when(F.col("_json"), (F.col("_name") != "") | F.col("_user").isNotNull() | F.col("_ip").isNotNull()).otherwise(F.col("_console"))
    return _finish(df, F.col("_ts"), fallback_ts, F.col("_ip"), F.col("_user"), kind, F.lit(None), ok)


# Names under which a kind of log may be asked for.
ALIASES = {
    "ssh": ("ssh", "sshd", "auth"),
    "windows": ("windows", "win", "evtx", "eventlog"),
    "nginx": ("nginx", "web", "apache", "waf"),
    "cloudtrail": ("aws", "cloudtrail", "aws_cloudtrail"),
}
NORMALIZERS: dict[str, Callable[..., DataFrame]] = {"ssh": normalize_ssh, "windows": normalize_windows, "nginx": normalize_nginx, "cloudtrail": normalize_cloudtrail}


def log_type(name: str) -> str:
    """The kind of log that a name stands for."""
    for kind, names in ALIASES.items():
        if name.strip().lower() in names or name.strip().lower() == kind:
            return kind
    raise ValueError(f"no such kind of log: {name}")


def register(name: str, normalizer: Callable[..., DataFrame], *aliases: str) -> None:
    """Adds a kind of log of the caller's own."""
    NORMALIZERS[name], ALIASES[name] = normalizer, (name, *aliases)


def normalize(df: DataFrame, kind: str, **options) -> DataFrame:
    return NORMALIZERS[log_type(kind)](df, **options)


_NO_KIND = "-"


def normalize_mixed(df: DataFrame, type_col: str = "log_type", **options) -> DataFrame:
    """Rows of several kinds, told apart by a column. Rows of a null or unknown kind come back as
    `unknown_log_type`, not parsed. A batch is read once: it is written by kind into the shared folder, and each
    kind reads its own part; of a stream each kind takes its rows."""
    asked = F.lower(stripped(F.col(type_col)))
    kind = F.lit(_NO_KIND)
    for name, names in ALIASES.items():
        kind = F.when(asked.isin(*names, name), name).otherwise(kind)
    df = df.withColumn("_kind", F.coalesce(kind, F.lit(_NO_KIND)))
    if not df.isStreaming:
        path = scratch.new_path(df.sparkSession, "by-kind")
        df.write.partitionBy("_kind").parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    of = lambda name: df.where(F.col("_kind") == name).drop("_kind")
    none = F.lit(None)
    out = _finish(of(_NO_KIND), none.cast("timestamp"), options.get("fallback_ts"), none, none, F.lit("unknown_log_type"), none, F.lit(False))
    for name in ALIASES:
        out = out.unionByName(NORMALIZERS[name](of(name), **options))
    return out
