from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import web
from tidewatch.operators import facts, normalize


def events(spark, kind, *lines, **options):
    rows = [("log", i, x) for i, x in enumerate(lines, 1)]
    df = normalize.normalize(spark.createDataFrame(rows, "source_id string, line_no long, raw string"), kind, fallback_ts=F.lit("2000-01-01 00:00:00").cast("timestamp"), **options)
    return df.orderBy("line_no", "user").collect()


# Records and what they mean.
SSH = [
    ("Aug 10 14:12:05 server sshd[123]: Accepted password for admin from 192.168.1.100 port 55432 ssh2", "successful_login", "admin", "192.168.1.100", 55432, True),
    ("Nov  1 12:00:00 server sshd[456]: Failed password for root from 2001:db8::1 port 22 ssh2", "failed_login", "root", "2001:db8::1", 22, True),
    ("2026-08-10T14:12:05.123456+00:00 server sshd[123]: Invalid user missing_user from 10.0.0.5 port 1234", "invalid_user", "missing_user", "10.0.0.5", 1234, True),
    ("Aug 10 14:12:05 server sshd[123]: Accepted publickey for testuser from 10.0.0.2 port 44322 ssh2", "successful_login", "testuser", "10.0.0.2", 44322, True),
    ("Aug 10 14:12:05 server sshd[1]: Failed password for invalid user bob from 10.0.0.2 port 1 ssh2", "failed_login_invalid_user", "bob", "10.0.0.2", 1, True),
    ("Aug 10 14:12:05 server sshd[1]: Connection closed by invalid user bob 10.0.0.2 port 1", "connection_closed", "bob", "10.0.0.2", 1, True),
    ("Aug 10 14:12:05 server sshd[1]: Disconnected from 10.0.0.2 port 1", "disconnected", None, "10.0.0.2", 1, True),
    ("Aug 10 14:12:05 server postfix/smtpd[123]: connect from unknown[192.168.1.5]", "unparsed", None, None, None, False),
    ("Aug 10 14:12:05 server sshd[123]: Server listening on 0.0.0.0 port 22.", "unparsed_sshd", None, None, None, False),
    ("", "unparsed", None, None, None, False),
]


def test_ssh_messages(spark):
    got = events(spark, "sshd", *(x[0] for x in SSH), year=2026)
    assert [(r.event_type, r.user, r.source_ip, r.port, r.is_parsed) for r in got] == [x[1:] for x in SSH]
    assert got[0].ts == dt.datetime(2026, 8, 10, 14, 12, 5) and got[1].ts.month == 11 and got[1].ts.year == 2026
    assert got[2].ts.microsecond == 123456
    assert got[0].auth_method == "password" and got[3].auth_method == "publickey"
    assert got[9].ts == dt.datetime(2000, 1, 1) and got[9].ts_assumed and not got[0].ts_assumed


def test_demo_log_facts(spark):
    lines = [f"Aug 14 10:20:{s:02d} h sshd[1]: Failed password for root from 192.168.1.100 port 1 ssh2" for s in (1, 5, 9, 13, 17)]
    lines += ["Aug 14 10:21:00 h sshd[1]: Accepted publickey for admin from 10.0.0.50 port 1 ssh2"]
    lines += ["Aug 14 10:22:10 h sshd[1]: Invalid user guest from 192.168.1.105 port 1", "Aug 14 10:22:15 h sshd[1]: Failed password for invalid user guest from 192.168.1.105 port 1 ssh2"]
    raw = spark.createDataFrame([("log", i, x) for i, x in enumerate(lines)], "source_id string, line_no long, raw string")
    e = normalize.normalize_ssh(raw, 2026)
    ips = facts.ip_facts(e)
    got = [(r.ip, r.failed_attempts, r.successful_attempts, r.users_attempted) for r in ips.orderBy("first_line").collect()]
    assert got == [("192.168.1.100", 5, 0, ["root"]), ("10.0.0.50", 0, 1, ["admin"]), ("192.168.1.105", 2, 0, ["guest"])]
    log = facts.log_facts(e).first()
    assert (log.total_lines, log.unparsed_lines, log.limitations) == (8, 0, [facts.YEAR_LIMITATION])
    assert log.start_time == dt.datetime(2026, 8, 14, 10, 20, 1) and log.end_time == dt.datetime(2026, 8, 14, 10, 22, 15)
    query = facts.retrieval_query(facts.log_facts(e), facts.concept_flags(ips)).first().query
    assert query == "SSH authentication failures evidence log preservation incident triage privileged-account monitoring repeated password attempts"
    capped = {r.ip: r for r in facts.ip_facts(e.unionByName(e.withColumn("user", F.lit("zed"))), 1).collect()}
    assert capped["192.168.1.100"].users_attempted == ["root"] and capped["192.168.1.100"].n_users == 2 and capped["10.0.0.50"].failed_attempts == 0
    nested = facts.nested_analysis(facts.log_facts(e), ips).first().ip_aggregations
    assert [x.ip for x in nested] == ["192.168.1.100", "10.0.0.50", "192.168.1.105"]


# Records and what they mean.
WINDOWS = [
    ('{"EventID":4625,"TimeCreated":"2026-08-14T10:15:30Z","TargetUserName":"Administrator","IpAddress":"192.168.1.55","IpPort":51234}', "failed_login", "Administrator", "192.168.1.55", 51234, True),
    ('{"EventID":4624,"TimeCreated":"2026-08-14T10:15:30Z","TargetUserName":"alice","IpAddress":"10.0.0.99"}', "successful_login", "alice", "10.0.0.99", None, True),
    (
        '{"Event":{"System":{"EventID":4625,"TimeCreated":{"@SystemTime":"2026-08-14T11:00:00.000Z"}},"EventData":{"TargetUserName":"bob_admin","IpAddress":"172.16.0.42","IpPort":"54321"}}}',
        "failed_login",
        "bob_admin",
        "172.16.0.42",
        54321,
        True,
    ),
    ('{"EventID":{"#text":"4634"},"EventData":{"TargetUserName":"SYSTEM","SubjectUserName":"carol","IpAddress":"-"}}', "windows_event_4634", "carol", None, None, True),
    ('{"other":1,"user":"dave"}', "unparsed_windows", "dave", None, None, True),
    ("2026-08-14 12:00:00 Microsoft-Windows-Security-Auditing: EventID: 4625, Account Name: admin, Source Network Address: 192.168.1.200, Source Port: 44100", "failed_login", "admin", "192.168.1.200", 44100, True),
    ("Some random non-windows text line", "unparsed_windows", None, None, None, False),
    ("   ", "empty_line", None, None, None, False),
    ("{broken json", "unparsed_windows", None, None, None, False),
]


def test_windows_records(spark):
    got = events(spark, "evtx", *(x[0] for x in WINDOWS))
    assert [(r.event_type, r.user, r.source_ip, r.port, r.is_parsed) for r in got] == [x[1:] for x in WINDOWS]
    assert got[0].ts.hour == 10 and got[2].ts == dt.datetime(2026, 8, 14, 11) and got[5].ts.hour == 12


def test_white_space_and_first_keys(spark):
    """White space of any kind is stripped, and the first event id that is there counts, whatever it is."""
    lines = ['{"EventID":4625,"IpAddress":"1.1.1.1"}\t', "\t\u00a0", '{"EventID":0,"EventId":4625}', '{"EventID":null,"EventId":4625,"user":" eve\u2003"}', '\x1f{"System":{"EventID":{"Value":" 7 "}}}']
    got = events(spark, "win", *lines)
    assert [(r.event_type, r.is_parsed, r.user) for r in got] == [("failed_login", True, None), ("empty_line", False, None), ("windows_event_0", True, None), ("unparsed_windows", True, "eve"), ("windows_event_7", True, None)]
    assert [r.event_type for r in events(spark, "waf", "\t") + events(spark, "aws", "\x0b")] == ["empty_line"] * 2


def test_message_order(spark):
    """The first message of the list wins, wherever in the line it stands."""
    line = "Aug 10 14:12:05 h sshd[1]: Invalid user a from 1.1.1.1 port 2; Accepted password for b from 2.2.2.2 port 3 ssh2"
    got = events(spark, "ssh", line, "Aug 10 14:12:05 h sshd: Failed password for\x01x from 1.1.1.1 port 5", "Aug 10 14:12:05 h sshd[9]: Failed password for \x01x from 1.1.1.1 port 5", year=2026)
    assert [(r.event_type, r.user, r.port) for r in got] == [("successful_login", "b", 3), ("unparsed_sshd", None, None), ("failed_login", "\x01x", 5)]


def test_mixed_kinds(spark):
    rows = [("l", 1, SSH[0][0], " SSHD "), ("l", 2, "x", "dns"), ("l", 3, "y", None), ("l", 4, "", "waf")]
    got = normalize.normalize_mixed(spark.createDataFrame(rows, "source_id string, line_no long, raw string, log_type string"), year=2026).orderBy("line_no").collect()
    assert [(r.event_type, r.is_parsed) for r in got] == [("successful_login", True), ("unknown_log_type", False), ("unknown_log_type", False), ("empty_line", False)]


def test_windows_times(spark):
    stamps = {"8/4/2026 9:05:06": 9, "8/4/2026 9:05:06 PM": 21, "4/Aug/2026:07:08:09": 7}
    got = events(spark, "windows", *(json.dumps({"EventID": 1, "TimeCreated": s}) for s in stamps))
    assert [(r.ts.day, r.ts.hour) for r in got] == [(4, h) for h in stamps.values()]


def access(request, status, user="-"):
    return f'192.168.1.10 - {user} [14/Aug/2026:12:00:00 +0000] "{request}" {status} 45 "-" "agent"'


# Records and what they mean.
NGINX = [
    (access("GET /dashboard HTTP/1.1", 200, "alice"), "successful_request"),
    (access("GET /products.php?id=1%27%20UNION%20SELECT%20null,username,password%20FROM%20users-- HTTP/1.1", 200), "sqli_attempt"),
    (access("GET /search?q=%3Cscript%3Ealert(document.cookie)%3C/script%3E HTTP/1.1", 200), "xss_attempt"),
    (access("GET /download?file=../../../../etc/passwd HTTP/1.1", 404), "path_traversal"),
    (access("POST /api/login HTTP/1.1", 401, "baduser"), "failed_login"),
    (access("GET /x HTTP/1.1", 401), "unauthorized_access"),
    (access("GET /x HTTP/1.1", 403), "forbidden_access"),
    (access("GET /x HTTP/1.1", 502), "server_error"),
    (access("GET /x HTTP/1.1", 404), "failed_request"),
    (access("POST /login HTTP/1.1", 302, "bob"), "successful_login"),
    (access("GET /x HTTP/1.1", 206), "http_request"),
    ('10.0.0.1 - - [14/Aug/2026:12:00:00 +0000] "GET / HTTP/1.1" 200', "successful_request"),
    ('{"remote_addr":"1.2.3.4","remote_user":"john","time_local":"14/Aug/2026:12:00:00 +0000","request":"GET /api/users?search=%27%20OR%201=1-- HTTP/1.1","status":200}', "sqli_attempt"),
    ('{"ip":"1.2.3.4","uri":"/x"}', "successful_request"),
    ("invalid nginx line content without pattern", "unparsed_nginx"),
    ("", "empty_line"),
]


def test_web_records(spark):
    got = events(spark, "waf", *(x[0] for x in NGINX))
    assert [r.event_type for r in got] == [x[1] for x in NGINX]
    assert got[0].user == "alice" and got[1].user is None and got[12].user == "john" and got[12].source_ip == "1.2.3.4"
    assert got[0].ts == dt.datetime(2026, 8, 14, 12)
    assert [r.is_parsed for r in got[-2:]] == [False, False]


def test_url_decoding(spark):
    cases = {"/a?b=%zz&c=%27%20x": "/a?b=%zz&c=' x", "/x%25zz": "/x%zz", "%ff%41": "�A", "a%2527+b": "a%27 b"}
    got = spark.createDataFrame([(x,) for x in cases], "t string").select(web.url_decoded(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())


# Records and what they mean.
CLOUD = [
    ({"eventTime": "2026-08-14T14:00:00Z", "eventName": "ConsoleLogin", "sourceIPAddress": "203.0.113.88", "errorMessage": "x", "userIdentity": {"userName": "secadmin"}, "responseElements": {"ConsoleLogin": "Failure"}}, "failed_login", "secadmin"),
    ({"eventName": "ConsoleLogin", "userIdentity": {"userName": "validuser"}, "responseElements": {"ConsoleLogin": "Success"}}, "successful_login", "validuser"),
    ({"eventName": "DescribeInstances", "userIdentity": {"arn": "arn:aws:iam::1:user/dev"}}, "aws_describeinstances", "dev"),
    ({"eventName": "RunInstances", "errorCode": "Denied", "user": "eve"}, "failed_aws_runinstances", "eve"),
]


def test_cloud_records(spark):
    lines = [json.dumps(x) for x, _, _ in CLOUD] + ["Random non-cloudtrail plain string", "ConsoleLogin failed userName=zed sourceIPAddress=9.9.9.9", ""]
    got = events(spark, "aws", *lines)
    assert [(r.event_type, r.user) for r in got[:4]] == [x[1:] for x in CLOUD]
    assert [r.event_type for r in got[4:]] == ["unparsed_cloudtrail", "failed_login", "empty_line"]
    assert got[0].ts.hour == 14 and got[5].source_ip == "9.9.9.9"


def test_cloud_records_list(spark):
    both = {"Records": [{"eventName": "ConsoleLogin", "sourceIPAddress": "198.51.100.99", "userIdentity": {"userName": u}, "errorMessage": "no"} for u in ("a", "b")]}
    got = events(spark, "cloudtrail", json.dumps(both))
    assert [(r.event_type, r.user, r.source_ip) for r in got] == [("failed_login", u, "198.51.100.99") for u in ("a", "b")]


def test_log_types():
    assert normalize.log_type(" SSHD ") == "ssh" and normalize.log_type("apache") == "nginx" and normalize.log_type("eventlog") == "windows"
    with pytest.raises(ValueError):
        normalize.log_type("dns")


def test_needed_texts_lose_no_payload(spark):
    """What is found with the search for needed texts before each class is what the patterns alone find."""
    import random

    from tidewatch.functions import web

    assert all([n for n, _ in web.NEEDED[patterns]] == list(range(1, len(patterns) + 1)) for _, patterns in web.ATTACK_RULES)
    rng = random.Random(11)
    pieces = ["union ", "SELECT", " from ", "insert  into", "update t set", "DELETE from", "drop table", "alter TABLE", "truncate table", "sleep (1)", "benchmark(", "waitfor delay", "information_schema", "sys.tables", "pg_sleep", "--", "#", "/* x */", "exec (", "execute(", "xp_cmdshell", "' or 1=1", "\" AND 'a' = '", "<script>", "javascript :", " onclick =", "onload=", "<img src=x>", "<iframe>", "<svg onload", "alert (", "document.cookie", "eval(", "prompt(", "../", "..\\", "/etc/passwd", "/proc/self/environ", "c:\\windows\\system32", "boot.ini", "win.ini", "a", " ", "é", "\u017fELECT", "UN\u0130ON", "\u212a", "%20", "+", "1", "="]
    texts = ["".join(c.upper() if rng.random() < 0.3 else c for c in "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))) for _ in range(3000)] + pieces
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, patterns in web.ATTACK_RULES:
        plain = F.col("t").rlike("(?iuU)" + "|".join(patterns))
        got = df.select(plain.alias("plain"), (web.may_match(F.col("t"), patterns) & plain).alias("both"), web.may_match(F.col("t"), patterns).alias("may")).collect()
        assert [r.plain for r in got] == [r.both for r in got], name
        assert any(r.plain for r in got) and not all(r.may for r in got)
    other = web.attack_class(F.col("t"), (("mine", ("x{2}",)),))
    assert spark.createDataFrame([("axxb",)], "t string").select(other).first()[0] == "mine"


def test_access_lines_with_line_ends_inside(spark):
    line = '1.1.1.1 - bob [10/Oct/2023:13:55:36 +0000] "GET /a\nb HTTP/1.1" 401 12 "x" "y"'
    got = spark.createDataFrame([("s", 1, line), ("s", 2, line.replace("\n", "")), ("s", 3, "a\nb\nc\nd\ne")], "source_id string, line_no long, raw string")
    rows = normalize.normalize_nginx(got).orderBy("line_no").collect()
    assert [(r.source_ip, r.user, r.event_type, r.is_parsed) for r in rows] == [("1.1.1.1", "bob", "failed_login", True)] * 2 + [(None, None, "unparsed_nginx", False)]


def test_a_filter_does_not_repeat_the_search(spark):
    """The pattern of sshd messages stands once in the plan of facts by address."""
    from tidewatch.operators import facts

    raw = spark.createDataFrame([("s", 1, "x")], "source_id string, line_no long, raw string")
    plan = facts.ip_facts(normalize.normalize_ssh(raw, 2026))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Accepted (password|publickey)") == 1
    plan = normalize.normalize_nginx(raw).where("is_parsed and source_ip <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("information_schema") <= 6 and plan.count("INFORMATION_SCHEMA") == 3
