from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidewatch.llm import chat, mixing, url_filter
from tidewatch.llm.queries import URL_RULES, op10_chat_formatting


def as_regex(glob):
    out = re.escape(glob).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(out + r"\Z")


def test_automaton_is_glob():
    rng = random.Random(1)
    text = lambda k: "".join(rng.choice("ab./") for _ in range(rng.randint(0, k)))
    globs = [url_filter.Glob(str(i), "".join(rng.choice(["a", "b", ".", "/", "?", "*", "**"]) for _ in range(rng.randint(0, 9))), "block") for i in range(60)]
    globs.append(url_filter.Glob("long", "ab" * 70 + "*", "block"))
    urls = [text(14) for _ in range(400)] + ["", "ab" * 70, "ab" * 70 + "xyz", "ab" * 69 + "a", "é/漢"]
    fits = url_filter.Automaton(globs).fits([u.encode() for u in urls])
    for j, g in enumerate(globs):
        want = as_regex(g.pattern)
        assert fits[:, j].tolist() == [bool(want.match(u.encode().decode("latin-1"))) for u in urls], g
    assert url_filter.Automaton([]).judge([b"x"]).tolist() == [-1]


URLS = [
    ("http://a.example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://WWW.Example.COM/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
    ("http://b.org/x.example.com/en/", "b.org", "/x.example.com/en/", None, "allow"),
    ("http://spam-farm.example.org/x", "spam-farm.example.org", "/x", None, "block"),
    ("http://b.org/setup.exe", "b.org", "/setup.exe", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("a://b://c.com/", "b:", "//c.com/", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.com/ü\nx", "É.com", "/ü\nx", "com/", "allow"),
    ("http://a.com/" + "y" * 5000, "a.com", "/" + "y" * 5000, "com/", "allow"),
]


def test_literal_patterns():
    odd = r"a*b?c\\d"
    urls = [odd, "aXbXc\\d", "a*b?c", odd + "/more", "ab"]
    rule = url_filter.prefix_rule("h.com", odd, "block")
    fits = lambda pattern, us: url_filter.Automaton([url_filter.Glob("x", pattern, "block")]).fits([u.encode() for u in us])[:, 0].tolist()
    assert fits(url_filter.literal(odd), urls) == [True, False, False, False, False]
    assert fits(rule.pattern, [".h.com" + u for u in urls]) == [True, False, False, True, False]


def test_canonical():
    for url, want in [
        ("HTTP://User:pw@WWW.Example.COM.:8080/a/./b/../c?x=1&utm_source=f&ref=y#top", ".www.example.com/a/c?x=1"),
        ("http://a.com", ".a.com/"),
        ("http://a.com/?utm_medium=1", ".a.com/"),
        ("http://a.com/%7Eme/%c3%a9/%2e%2e/x", ".a.com/~me/x"),
        ("http://a.com/../../x/..", ".a.com/"),
        ("http://a.com/x/.", ".a.com/x/"),
        ("http://a.com/r?reference=1&refs&ref", ".a.com/r?reference=1&refs"),
        ("no scheme", "."),
        ("", "."),
        (None, "."),
    ]:
        assert url_filter.canonical(url) == want, url


def test_own_globs(spark):
    """The filter's own verdicts, from canonical URLs, where no rule fits."""
    urls = ["https://u:p@blog.CASINO-win.org:443/a", "http://a.org/x?b=1&page=2", "http://a.org/x?homepage=2", "http://a.org/%77p-admin/x", "http://a.org/q/../wp-admin/", "http://a.org/f.exe?ref=1", "http://a.org/f.exe?v=1", "http://a.com/wp-admin/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls])], "page_id int, url string")
    got = url_filter.judge_urls(df, URL_RULES).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "block", "block", "block", "allow", "allow"] * 2


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("b", "*.b.com/**", "block"), ("a", "*.a.com/**", "allow"), (None, "x", "block")], "name string, pattern string, verdict string")
    assert [g.name for g in url_filter.rules_from(table)] == ["a", "b"]
    with pytest.raises(ValueError, match="more than 1"):
        url_filter.rules_from(table, 1)


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "was") for i, u in enumerate(URLS)], "page_id int, url string, verdict string")
    got = url_filter.judge_urls(df, URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [u[1:] for u in URLS]
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def filled(sizes, weights, most=3.0):
    """Sharing out again and again, as the words say."""
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        for i in open_:
            target[i] += left * weights[i] / total
        left = 0.0
        for i in list(open_):
            if target[i] >= most * sizes[i]:
                left += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                open_.discard(i)
    return target


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 10, 100, 5000]) for _ in range(9)]
        weights = [(5, 2, 1)[i % 3] for i in range(9)]
        rows = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight int")
        got = [r.target for r in mixing.source_targets(rows).orderBy("source").collect()]
        assert got == pytest.approx(filled(sizes, weights), rel=1e-9, abs=1e-6)


def test_mix(spark):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randint(1, 30)) for _ in range(900)]
    sources = [rng.choice(["a"] * 6 + ["b", None]) for _ in texts]
    docs = documents(spark, *texts, sources=sources).withColumnRenamed("lang", "_target")
    planned = mixing.plan_mix(docs.withColumn("size", mixing.word_count()), mixing.cycle_weights(docs)).collect()
    for name in {"a", "b", None}:
        own = [r for r in planned if r.source == name]
        taken, target = sum(r.size * r._copies for r in own), own[0]._target
        f = own[0]._rate % 1
        error = (f * (1 - f) * sum(r.size**2 for r in own)) ** 0.5  # the standard error of one seeded copy each
        assert abs(taken - target) < 3.5 * error + 1e-6 and error < 0.1 * target and max(r._copies for r in own) <= 3
    out = mixing.mix(docs, mixing.cycle_weights(docs))
    assert out.columns == docs.columns and out.count() == sum(r._copies for r in planned)
    assert sorted(r.doc_id for r in mixing.mix(docs.repartition(7), mixing.cycle_weights(docs)).collect()) == sorted(r.doc_id for r in out.collect())


def test_many_sources(spark):
    """Sources are numbered by code point over ranges, null last, however rows are dealt out."""
    names = [f"s{i:04d}" for i in range(500)] + ["S", "é", "", None]
    docs = documents(spark, *(["w"] * len(names)), sources=names).repartition(9)
    got = {r.source: r.weight for r in mixing.cycle_weights(docs).collect()}
    order = sorted(names[:-1], key=lambda x: x.encode()) + [None]
    assert got == {n: (5, 2, 1)[i % 3] for i, n in enumerate(order)}


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None), (2, None, "x")], "doc_id long, text string, source string")
    assert mixing.mix(docs, mixing.cycle_weights(docs)).count() == 0
    assert mixing.mix(docs.limit(0), mixing.cycle_weights(docs)).count() == 0
    some = spark.createDataFrame([(None, "a b", None), (1, "a b c", "x"), (1, "a b c", "x")], "doc_id long, text string, source string")
    got = mixing.mix(some, spark.createDataFrame([("x", 1.0), (None, None)], "source string, weight double")).collect()
    assert {r.source for r in got} == {"x"} and len(got) in (2, 4)


TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "\\", "\\\\<|end|>\\", "", "a\nb", "<|<|end|>", "é🙂<s>", "<\\|end|>", None]


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY if t is not None], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and not any(c in r.e for c in chat.CONTROL) for r in got)


def test_chains(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TRICKY)] + [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (2, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 0, "<|says|>", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.format_trees(chat.chain(turns))
    read = {r.conv_id: r for r in got.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(read) == {1, 2, 3, None}
    assert [(t.role, t.text) for t in read[1].turns] == [(r[2], r[3] or "") for r in rows[:10]]
    assert read[1].loss == "".join(t or "" for t in TRICKY[1::2]) and read[None].loss == "yo"
    assert [(t.role, t.text) for t in read[2].turns] == [("", "")]
    assert [(t.role, t.text) for t in read[3].turns] == [("<|says|>", "y"), ("assistant", "x"), ("assistant", "x")]
    assert chat.format_trees(chat.chain(turns.limit(0))).count() == 0


def test_best_branches(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, a root without replies, an orphan, and a cycle
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 9.0), ("t", 4, 2, 0.0), ("t", 3, 1, 1.0), ("t", 5, 3, 1.0), ("t", 6, 5, None), ("u", 1, None, 1.0), ("v", 7, 99, 1.0), ("w", 1, 2, 1.0), ("w", 2, 1, 1.0)]
    df = spark.createDataFrame([(*n, "user", f"text {n[1]}") for n in nodes], "conv_id string, node long, parent long, score double, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.format_trees(df).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {"t": ["text 1", "text 2", "text 4"], "u": ["text 1"], "v": ["text 7"]}
    two = chat.best_paths(df, "conv_id", "node", "parent", "score", 2).where("conv_id = 't'").orderBy("leaf", "place").collect()
    assert [(r.leaf, r.place, r.node) for r in two] == [(4, 0, 1), (4, 1, 2), (4, 2, 4), (6, 0, 1), (6, 1, 3), (6, 2, 5), (6, 3, 6)]


def test_deep_path(spark):
    n = 70
    df = spark.createDataFrame([("t", i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(n)], "conv_id string, node long, parent long, score double, role string, text string")
    turns = chat.format_trees(df).select(chat.read_back(F.col("formatted")).alias("t")).first().t
    assert [x.text for x in turns] == [str(i) for i in range(n)]


def test_probe_conversation(spark, sf_dir):
    r = op10_chat_formatting(spark, sf_dir).where("conv_id = -1").first()
    x = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(x), hashlib.sha256(x.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()


def test_a_node_given_twice_is_one_row(spark):
    """Parent, score, role and text come from the same row, the least, wherever the rows are."""
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "b", 2.0), (1, 2, 1, "assistant", "a", 2.0), (1, 2, 1, "zzz", "c", 1.0), (1, 3, 1, "assistant", "other", 1.5), (1, 3, None, "user", "top", 9.0)]
    schema = "conv_id long, node long, parent long, role string, text string, score double"
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = chat.format_trees(spark.createDataFrame(rows, schema).repartition(3), per_tree=3)
        got = sorted((r.leaf, r.formatted) for r in got.collect())
        want = want or got
        assert got == want
    turn = lambda role, text: f"<|turn|>{role}<|says|>{text}<|end|>"
    assert want == [(2, turn("user", "root") + turn("zzz", "c")), (3, turn("user", "top"))]
