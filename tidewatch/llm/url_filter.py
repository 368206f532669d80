"""URL filters: a bit-parallel automaton that runs all glob rules over each canonical URL at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import spare

#: Rules are sent to every task with the query's code; there may be this many pattern characters at most.
MOST_STATES = 1 << 16
#: URLs simulated together.
_BLOCK = 2048


class Glob(NamedTuple):
    """A rule. In pattern `?` is any byte but /, `*` any run without /, `**` any run, and a backslash
    takes the next byte as it is; the pattern fits whole URLs in the form that it is meant for. The longest rule that fits wins (length counts the rule's name), then a
    block before an allow, then the earlier rule."""

    name: str
    pattern: str
    verdict: str


def literal(text: str) -> str:
    """A pattern that fits this text alone."""
    return re.sub(r"([\\*?])", r"\\\1", text)


def prefix_rule(host: str, path: str, verdict: str) -> Glob:
    """A host with all of its subdomains, and every path that starts with `path`."""
    return Glob(host + path, f"*.{literal(host)}{literal(path)}**", verdict)


def rules_from(table: DataFrame, most: int = 10_000) -> list[Glob]:
    """The rules of a table (name, pattern, verdict), in that order of columns and sorted; a table of more
    than `most` rows is refused, as every task gets all rules. Rows with a null are left out."""
    rows = table.select("name", "pattern", "verdict").dropna().orderBy("name", "pattern", "verdict").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Glob(*r) for r in rows]


#: What the filter blocks by itself where no rule of the caller's fits; read from canonical URLs: link farms,
#: executables, administration, and pages that only list or repeat others.
DEFAULT_GLOBS = (
    *(Glob(f"*.{w}-*", f"*.{w}-*.**", "block") for w in ("spam", "casino", "cheap")),
    Glob("**.exe", "**.exe", "block"),
    Glob("**/wp-admin/**", "**/wp-admin/**", "block"),
    *(Glob(f"**{c}{k}=**", f"**{literal(c)}{k}=**", "block") for c in "?&" for k in ("page", "sort", "sessionid", "replytocom")),
)
#: Parameters of a query that say where a reader came from, not which page is meant.
TRACKING = re.compile(r"(?:utm_[^=&]*|ref|gclid|fbclid)(?:=|$)")
_FORM, _ESCAPE = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"), re.compile(r"%([0-9A-Fa-f]{2})")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PLAIN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _unescaped(text: str) -> str:
    """Percent forms of letters, digits and -._~ as themselves, the others in capitals."""
    one = lambda m: chr(int(m[1], 16)) if chr(int(m[1], 16)) in _PLAIN else m[0].upper()
    return _ESCAPE.sub(one, text) if "%" in text else text


def canonical(url: str | None) -> str:
    """What the filter's own globs read: a dot, so that a host is its own subdomain, the host in lower
    case without user, port and final dots, the path without dot segments, and the query without
    tracking parameters; percent forms are undone where they mean the same. Null, or without ://: a dot."""
    m = _FORM.match(url or "")
    if not m:
        return "."
    host = re.sub(r":[0-9]*$", "", m[1].rpartition("@")[2])
    host = _unescaped(host).translate(_LOWER).rstrip(".")
    path = _unescaped(m[2])
    if "/." in path:
        kept: list[str] = []
        parts = path.split("/")[1:]
        for p in parts:
            if p == "..":
                del kept[-1:]
            elif p != ".":
                kept.append(p)
        path = "/" + "/".join(kept + ([""] if parts[-1] in (".", "..") and kept else []))
    asked = [p for p in _unescaped((m[3] or "?")[1:]).split("&") if p and not TRACKING.match(p)]
    return f".{host}{path or '/'}" + ("?" + "&".join(asked) if asked else "")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Shift-And over 64-bit words. Each pattern has a start state and one state for each byte or `?`;
    a state that a star follows stays on with the bytes that the star takes. Bit i moves to i + 1, over
    word borders too; the start states' own bits are cleared by the masks, so patterns don't mix."""

    def __init__(self, globs: list[Glob]):
        moves: list[set[int] | None] = []  # the bytes that enter a state; None: a start state
        stays: list[set[int]] = []
        ends, every, segment = [], set(range(256)), set(range(256)) - {47}
        for g in globs:
            moves.append(None)
            stays.append(set())
            raw, i = g.pattern.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    stays[-1] |= every
                    i += 2
                elif raw[i : i + 1] == b"*":
                    stays[-1] |= segment
                    i += 1
                else:
                    escaped = raw[i : i + 1] == b"\\" and i + 1 < len(raw)
                    i += escaped
                    moves.append(segment if not escaped and raw[i : i + 1] == b"?" else {raw[i]})
                    stays.append(set())
                    i += 1
            ends.append(len(moves) - 1)
        if len(moves) > MOST_STATES:
            raise ValueError(f"the rules need {len(moves)} states; {MOST_STATES} are allowed")
        n = max(1, -(-len(moves) // 64))
        self.enter, self.stay = np.zeros((256, n), np.uint64), np.zeros((256, n), np.uint64)
        self.start = np.zeros(n, np.uint64)
        for k, (m, s) in enumerate(zip(moves, stays, strict=True)):
            word, bit = k >> 6, np.uint64(1) << np.uint64(k & 63)
            if m is None:
                self.start[word] |= bit
            else:
                self.enter[list(m), word] |= bit
            if s:
                self.stay[list(s), word] |= bit
        self.word = np.array([e >> 6 for e in ends], np.int64)
        self.bit = np.array([e & 63 for e in ends], np.uint64)
        order = sorted(range(len(globs)), key=lambda i: (-len(globs[i].name), globs[i].verdict != "block", i))
        self.order, self.globs = np.array(order, np.int64), globs

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each rule."""
        length = np.array([len(u) for u in urls], np.int64)
        by = np.argsort(-length, kind="stable")
        # the longest first: those that still have a byte at a place are always the first rows
        flat, at = np.frombuffer(b"".join(urls), np.uint8), np.concatenate(([0], np.cumsum(length)[:-1]))[by]
        state = np.tile(self.start, (len(urls), 1))
        live, one, top = length[by], np.uint64(1), np.uint64(63)
        for place in range(int(live[0]) if len(urls) else 0):
            k = int(np.searchsorted(-live, -place, side="left"))
            byte, now = flat[at[:k] + place], state[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:k] = (moved & self.enter[byte]) | (now & self.stay[byte])
        out = np.zeros((len(urls), len(self.globs)), bool)
        out[by] = (state[:, self.word] >> self.bit) & one
        return out

    def judge(self, urls: list[bytes]) -> np.ndarray:
        """The number of the rule that wins for each URL, or -1."""
        if not urls or not self.globs:
            return np.full(len(urls), -1)
        fits = self.fits(urls)[:, self.order]
        return np.where(fits.any(axis=1), self.order[fits.argmax(axis=1)], -1)


def judge_urls(pages: DataFrame, rules: list[Glob], url: str = "url", default: str = "allow", globs: tuple[Glob, ...] = DEFAULT_GLOBS) -> DataFrame:
    """pages with string columns host, path, rule and verdict (columns of these names are replaced).

    The caller's rules come first and read a dot, host and path as they stand in the URL; where none
    fits, rule is null and verdict is that of the longest glob that fits the canonical URL, else
    `default`. A null URL, or one without ://, has an empty host and path and is judged like any other.
    All rules run as one automaton in one pass over the bytes of a URL; rows don't depend on each
    other, so nothing is shuffled, repeated rows are judged each, and URLs of any length are read to
    the end in blocks of rows.
    """
    rules = list(rules)

    @F.pandas_udf("rule string, verdict string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        first, then = Automaton(rules), Automaton(list(globs))
        for plain, whole in batches:
            names: list[str | None] = []
            verdicts: list[str] = []
            for i in range(0, len(plain), _BLOCK):
                mine = first.judge([u.encode() for u in plain.iloc[i : i + _BLOCK]])
                left = np.flatnonzero(mine < 0)
                own = np.full(len(mine), -1)
                own[left] = then.judge([canonical(u).encode("utf-8", "replace") for u in whole.iloc[i : i + _BLOCK].iloc[left]])
                for a, b in zip(mine, own, strict=True):
                    names.append(rules[a].name if a >= 0 else None)
                    verdicts.append(rules[a].verdict if a >= 0 else globs[b].verdict if b >= 0 else default)
            yield pd.DataFrame({"rule": pd.Series(names, dtype=object), "verdict": pd.Series(verdicts, dtype=object)})

    if url in ("host", "path"):
        raise ValueError("the column of URLs must not be called host or path")
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    j = spare(pages, "_judged")
    got = parts.withColumn(j, of(F.concat(F.lit("."), F.col("host"), F.col("path")), F.col(url)))
    return got.withColumns({n: F.col(f"{j}.{n}") for n in ("rule", "verdict")}).drop(j)
