"""Web requests: payload classes and event types as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import let

# The payload patterns of the three attack classes, in the order in which they are tried.
SQLI = (
    r"(\b(UNION(\s+ALL)?)\s+SELECT\b)",
    r"(['\"]\s*(OR|AND)\s*['\"]?\d+['\"]?\s*=\s*['\"]?\d+)",
    r"(['\"]\s*(OR|AND)\s*['\"][^'\"]+['\"]\s*=\s*['\"])",
    r"(\bSELECT\b.+\bFROM\b)",
    r"(\bINSERT\s+INTO\b|\bUPDATE\s+.+\s+SET\b|\bDELETE\s+FROM\b)",
    r"(\bDROP\s+TABLE\b|\bALTER\s+TABLE\b|\bTRUNCATE\s+TABLE\b)",
    r"(\bSLEEP\s*\(\s*\d+\s*\)|\bBENCHMARK\s*\(|\bWAITFOR\s+DELAY\b)",
    r"(\bINFORMATION_SCHEMA\b|\bSYS\.TABLES\b|\bPG_SLEEP\b)",
    r"(--|#|\/\*.*\*\/)",
    r"(\bEXEC\s*\(|\bEXECUTE\s*\(|\bxp_cmdshell\b)",
)
XSS = (
    r"(<script\b[^>]*>.*?</script>|<script\b[^>]*>)",
    r"(javascript\s*:)",
    r"(\bon(error|load|click|mouseover|submit|focus|blur|change)\s*=)",
    r"(<img\b[^>]*\bsrc\s*=[^>]*>)",
    r"(<iframe\b[^>]*>|<svg\b[^>]*\bonload\b)",
    r"(\balert\s*\(|\bdocument\.cookie\b|\beval\s*\(|\bprompt\s*\()",
)
TRAVERSAL = (
    r"(\.\./\.\./|\.\.\\\.\.\\|\.\./|\.\.\\)",
    r"(/etc/passwd|/etc/shadow|/proc/self/environ)",
    r"(c:\\windows\\system32|boot\.ini|win\.ini)",
)
ATTACK_RULES = (("sqli_attempt", SQLI), ("xss_attempt", XSS), ("path_traversal", TRAVERSAL))
#: For each class, texts in lower case of which each of its patterns needs one: (the pattern's number, texts).
NEEDED = {
    SQLI: (
        (1, ("union",)), (2, ("'", '"')), (3, ("'", '"')), (4, ("select",)), (5, ("insert", "update", "delete")), (6, ("drop", "alter", "truncate")),
        (7, ("sleep", "benchmark", "waitfor")), (8, ("information_schema", "sys.tables", "pg_sleep")), (9, ("--", "#", "/*")), (10, ("exec", "xp_cmdshell")),
    ),
    XSS: (
        (1, ("<script",)), (2, ("javascript",)), (3, ("onerror", "onload", "onclick", "onmouseover", "onsubmit", "onfocus", "onblur", "onchange")),
        (4, ("<img",)), (5, ("<iframe", "<svg")), (6, ("alert", "document.cookie", "eval", "prompt")),
    ),
    TRAVERSAL: ((1, ("../", "..\\")), (2, ("/etc/", "/proc/")), (3, ("c:\\windows", "boot.ini", "win.ini"))),
}
# Words of a request that make it an authentication request, and statuses that count as success.
AUTH_WORDS = ("login", "auth", "signin", "wp-login", "admin")
GOOD_STATUS = (200, 201, 204, 301, 302, 304)


def url_decoded(text: Column) -> Column:
    """Percent and plus decoding that leaves malformed escapes as they are."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def may_match(form: Column, patterns: tuple[str, ...]) -> Column:
    """False only if no pattern can match: none of the texts that they need is there. Beyond ASCII, where other letters
    count as equal regardless of case, and for patterns without a list, it is true."""
    if patterns not in NEEDED:
        return F.lit(True)
    out, low = F.octet_length(form) != F.length(form), F.lower(form)
    for text in dict.fromkeys(t for _, texts in NEEDED[patterns] for t in texts):
        out = out | low.contains(text)
    return out


def attack_class(text: Column, rules=ATTACK_RULES) -> Column:
    """The class of the first payload in the raw, decoded and twice decoded text, or null: all classes
    are tried on one form of the text before the next form. A class's patterns are searched for only where
    a text that they need was found, which costs a tenth of the search."""

    def one(form: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, patterns in reversed(rules):
            out = F.when(may_match(form, patterns) & form.rlike("(?iuU)" + "|".join(patterns)), name).otherwise(out)
        return out

    coded = lambda form: form.contains("%") | form.contains("+")
    once = url_decoded(text)
    twice = F.when(coded(once), let(url_decoded(once), one))
    return F.coalesce(one(text), F.when(coded(text), F.coalesce(let(once, one), twice)))


def http_event_type(attack: Column, status: Column, request: Column, user: Column) -> Column:
    auth = F.lower(request).rlike("|".join(AUTH_WORDS))
    return (
        F.when(attack.isNotNull(), attack)
        .when(status == 401, F.when(user.isNotNull() | auth, "failed_login").otherwise("unauthorized_access"))
        .when(status == 403, "forbidden_access")
        .when(status >= 500, "server_error")
        .when(status >= 400, "failed_request")
        .when(status.isin(*GOOD_STATUS), F.when(auth & user.isNotNull(), "successful_login").otherwise("successful_request"))
        .otherwise("http_request")
    )
