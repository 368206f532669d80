from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidewatch.llm import quality_classifier as qc
from tidewatch.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(lines)


def test_measures():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "é 漢 x", "a b c d e a b c d e", "a\na\n \na b\n"]
    texts += ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "\u00a0", "\x1c"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t in texts:
        assert rules.measure(t) == brute(t), repr(t)


def test_hosts(spark):
    """Two planted bad hosts, one by short documents and one by symbols, and a tiny one that is not judged."""
    good, bad, signs = "one two three four five six seven eight nine ten", "too short", "one# two# three four five six seven eight nine ten"
    texts = [bad] * 60 + [good] * 5 + [good] * 290 + [bad] * 5 + [bad, good, None] + [signs] * 40 + [good] * 40
    sources = ["spam"] * 65 + ["fine"] * 295 + ["tiny", None, None] + ["signs"] * 80
    docs = documents(spark, *texts, sources=sources).withColumnRenamed("lang", "host").withColumn("n_lines", F.lit("x"))
    got = {r.doc_id: r for r in rules.judge_documents(docs).collect()}
    assert len(got) == len(texts) and all(got[i].base_failed == (t in (bad, None)) for i, t in enumerate(texts))
    assert not any(got[i].kept for i in range(65)) and got[64].host_rules == ["short"] and got[0].host_docs == 65
    assert all(got[i].kept and got[i].host_rules == [] for i in range(65, 355)) and not got[355].kept
    assert not got[360].host_failed and got[361].kept and not got[362].kept
    assert got[363].failed_symbols and got[440].host_rules == ["symbols"] and not got[440].kept
    rates = {r.host: r for r in rules.host_rates(rules.document_features(docs)).collect()}
    assert rates["spam"].n_short == 60 and 0.8 < rates["spam"].rate_short < 60 / 65 and rates["tiny"].rate_short < 1
    assert rules.judge_documents(docs.limit(0)).count() == 0


def test_long_and_repeated_documents(spark):
    words = [f"w{i}" for i in range(200_000)]
    docs = documents(spark, " ".join(words), " ".join(words[:50] * 3), "x " * 300_000, "a b\n" * 2000)
    got = rules.judge_documents(docs.unionByName(docs)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, True] + [False] * 6
    assert [r.n_words for r in got[::2]] == [200_000, 150, 300_000, 4000] and [r.failed_lines for r in got[::2]] == [False, False, False, True]


def test_ordinal_order():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        k = np.unique(np.concatenate([rng.integers(0, 50, 6), [100 + g], [200] if rng.random() < 0.3 else []]).astype(np.int32))
        rows.append((k, np.ones(len(k))))
        grades.append(g)
    flat, values, sizes = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows]), np.array([len(k) for k, _ in rows])
    model = qc.fit_ordinal(sizes, flat, values, np.array(grades), 3)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([model.weights[k].sum() for k, _ in rows])
    tails = model.tails(score)
    assert ((tails[:, 0] >= tails[:, 1]) & (tails >= 0).all(axis=1)).all()
    assert np.mean(np.round(tails.sum(axis=1)) == grades) > 0.95
    absent = qc.fit_ordinal(sizes, flat, values, np.minimum(grades, 1), 3)
    assert np.isfinite(absent.thresholds).all()


def test_held_out_accuracy(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = qc.fit(docs, qc.ratings(labels.where("doc_id % 4 <> 0")), 3)
    got = qc.grade_documents(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    clean, poor = got[(got.quality == 1) & (got.toxic == 0)], got[got.quality == 0]
    assert clean.kept.mean() > 0.9 and poor.kept.mean() < 0.2
    again = qc.fit(docs.repartition(3), qc.ratings(labels.where("doc_id % 4 <> 0")), 3)
    assert np.array_equal(model.weights, again.weights)


def test_no_labels_and_odd_rows(spark):
    docs = documents(spark, "a b", None, "", "a b").withColumnRenamed("lang", "kept")
    none = qc.fit(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    got = qc.grade_documents(docs, none).collect()
    assert none is None and all(r.kept is True and r.expected_grade is None for r in got)
    some = spark.createDataFrame([(0, 2), (0, 0), (1, 1), (None, 1), (9, 2)], "doc_id long, grade int")
    model = qc.fit(docs, some, 3)
    assert qc.grade_documents(docs, model).where("expected_grade is null").count() == 0
    assert qc.grade_documents(docs.limit(0), model).count() == 0


def small_problem(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 6, 60)
    row, flat = np.repeat(np.arange(60), sizes), rng.integers(0, 8, sizes.sum())
    return rng, row, flat, rng.uniform(0.5, 2, len(flat)), rng.integers(0, 4, 60), sizes


def test_gradient():
    """Finite differences, and the likelihood as the words say."""
    rng, row, flat, values, grades, _ = small_problem(1)
    loss = qc.ordinal_loss(row, flat, values, grades, 8, 4, 0.01)
    x = rng.standard_normal(11)
    value, grad = loss(x)
    for k in range(11):
        step = np.eye(11)[k] * 1e-6
        assert abs((loss(x + step)[0] - loss(x - step)[0]) / 2e-6 - grad[k]) < 1e-6
    cuts = [-np.inf, x[8], x[8] + np.exp(x[9]), x[8] + np.exp(x[9]) + np.exp(x[10]), np.inf]
    at = lambda z: 1 / (1 + np.exp(-z))
    score = [sum(x[f] * v for f, v, r in zip(flat, values, row, strict=True) if r == i) for i in range(60)]
    want = -np.mean([np.log(at(cuts[g + 1] - s) - at(cuts[g] - s)) for g, s in zip(grades, score, strict=True)]) + 0.005 * (x[:8] ** 2).sum()
    assert abs(value - want) < 1e-9


def test_fit_against_plain_descent():
    _, row, flat, values, grades, sizes = small_problem(2)
    loss = qc.ordinal_loss(row, flat, values, grades, 8, 4, 0.05)
    x = np.zeros(11)
    for _ in range(20_000):
        x -= 0.1 * loss(x)[1]
    model = qc.fit_ordinal(sizes, flat, values, grades, 4, 0.05, least=1)
    cuts = x[8] + np.concatenate([[0], np.cumsum(np.exp(x[9:]))])
    assert np.abs(model.weights[:8] - x[:8]).max() < 0.01 and np.abs(model.thresholds - cuts).max() < 0.01


def test_labels(spark):
    """Null ratings are no labels; an id with several texts counts once."""
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, None), (4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in qc.ratings(labels).collect() if r.grade is not None) == [(1, 2), (4, 0), (5, 2)]
    docs = documents(spark, None, "one two", "x", "y", "bad", "good " * 50_000)
    docs = docs.unionByName(docs.withColumn("text", F.concat(F.lit("other "), "text")))
    got = qc.labelled_sample(docs, qc.ratings(labels), "doc_id", "text", "grade", 10, 5).collect()
    assert sorted(r.grade for r in got) == [0, 2, 2]
    again = qc.labelled_sample(docs.repartition(7), qc.ratings(labels), "doc_id", "text", "grade", 10, 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_power_of_host_verdicts(spark):
    """Hosts of several sizes whose documents fail a rule at rates of their own, among 60 of the usual rate: clearly bad
    ones of 30 documents or more are found, no usual one of any size is, and a few bad documents condemn no host."""
    rng = random.Random(4)
    hosts = [(f"usual{i}", rng.choice([3, 20, 100, 1000]), 0.05) for i in range(60)]
    bad = [("bad30", 30, 0.6), ("bad100", 100, 0.4), ("bad1000", 1000, 0.25)]
    hosts += [*bad, ("tiny", 3, 1.0), ("twice", 1000, 0.09)]
    rows = [(h, i < round(n * rate)) for h, n, rate in hosts for i in range(n)]
    df = spark.createDataFrame(rows, "source string, failed_symbols boolean")
    others = {f"failed_{r}": F.lit(False) for r in rules.RULES if r != "symbols"}
    got = {r.host: r for r in rules.host_rates(df.withColumns(others | {"base_failed": F.lit(False)})).collect()}
    assert {h for h, r in got.items() if r.host_failed} == {h for h, _, _ in bad}
    assert all(r.host_rules == ["symbols"] for r in got.values() if r.host_failed)
