from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, documents
from tidewatch.llm import decontamination, filter_audit, merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- op11: filter audit ---

LABELS = "doc_id long, quality int, toxic int, text string"


def failures(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(w) < 50)
        fails += "B" * (100 * len(set(w)) < 65 * len(w))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows)
        out.append(fails)
    return out


def audited(rows, labels):
    """Every document taken through every order, one by one."""
    fails = failures(rows)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(d, f) for (d, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                before = [x for x in mine if x not in left]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, order, step] = {
                    "kept": len(left),
                    "removed": len(gone),
                    "redundant": sum(f in x[1] for x in mine) - len(gone),
                    "unique_fails": sum(x[1] == f for x in mine),
                    "good_lost": sum(any(i == d and q == 1 for i, q, _, _ in labels) for d, _ in gone if d is not None),
                    "toxic_lost": sum(any(i == d and t == 1 for i, _, t, _ in labels) for d, _ in gone if d is not None),
                }
                assert len(before) + len(gone) + len(left) == len(mine)
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = shapley[order[step - 1]]
    return out


def odd_documents():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 49, 50, 70]))) for _ in range(20)]
    texts += [None, "", "", "A " * 60, "costs $5 " * 30, " ".join(["same"] * 80), "word " * 30_000, "   ÄÖ ABC", texts[0], texts[0], None]
    rows = [(i, t, r.choice(["s", "t", None, ""])) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], "s"), (3, texts[3], "t"), (3, "another text", "t"), (None, None, None)]


def test_audit_equals_every_document_taken_through_every_order(spark):
    rows = odd_documents()
    labels = [(0, 1, 0, "x"), (1, 0, 1, "x"), (1, 1, 0, None), (2, None, None, None), (None, 1, 1, None), (28, 1, 1, None), (999, 1, 1, None)]
    docs = spark.createDataFrame([(*x, "more", 1) for x in rows], "doc_id long, text string, source string, part string, mask int")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = audited(rows, labels)
    assert len(got) == len(want) == 600 * 3
    for g in got:
        g = g.asDict()
        assert want[g.pop("part"), g.pop("filter_order"), g.pop("step")] == g


def test_audit_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    got = filter_audit.audit(documents(spark, "one"), labels).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(g.kept, g.removed, g.good_lost) for g in got] == [(1, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_fields_hold_any_count():
    """A sum of counters is right in every field for as many rows as a long can count."""
    counters = filter_audit.wide_counters()
    assert len(counters) == 32 and counters[0] == 0
    times = {m: (1 << 58) + m for m in range(32)}
    got = filter_audit.unpack(sum(k * counters[m] for m, k in times.items()))
    orders = list(permutations(range(5)))
    for o, step in ((0, 0), (17, 2), (63, 4), (119, 1), (119, 4)):
        f, before = orders[o][step], orders[o][:step]
        assert got[o, step] == sum(k for m, k in times.items() if m >> f & 1 and not any(m >> e & 1 for e in before))


def test_rows_of_a_part_are_counted_before_they_meet(spark):
    rows = spark.range(0, 50_000, 1, 8).select(F.lit("hot").alias("part"), (F.col("id") % 32).cast("int").alias("mask"), (F.col("id") % 2 == 0).alias("odd"))
    got = filter_audit.interactions(rows, flags=("odd",))
    first = got.where("filter_order = 'EDCBA' and step = 1").first()
    want = [m for m in (i % 32 for i in range(50_000)) if m >> 4 & 1]
    assert (first.removed, first.kept, first.odd_lost) == (len(want), 50_000 - len(want), sum(m % 2 == 0 for m in want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


# --- op12: benchmark decontamination ---


def leaked(texts, items, width=10):
    """By sets of words, window by window."""
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in windows[tuple(w[i : i + k])] if x is not None}
        out.append((len(w), len(hit), len(found), h(",".join(sorted(found))), bool(hit)))
    return out


def passages():
    r = random.Random(3)
    vocabulary = [*(f"v{i}" for i in range(60)), "Éte", "éte", "ÀB", "x1", "東京"]
    phrase = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(n)) for i, n in enumerate([30, 12, 10, 9, 4, 1, 11])]
    items += [(7, items[0][1]), (10, items[0][1].upper()), (11, None), (12, ""), (13, "--- !"), (2, phrase(15)), (None, phrase(20)), (14, items[1][1] + " " + items[2][1])]
    said = [t for _, t in items if t and len(t) > 5]
    texts = [phrase(r.randrange(3, 80)) for _ in range(15)]
    texts += [f"{phrase(7)}. {s} -- {phrase(5)}" for s in said] + [s.replace(" ", "\n,;") + "!" for s in said]
    texts += [f"{said[0]} {said[0]}", said[0][: len(said[0]) // 2], None, "", "...", said[1].upper(), " ".join([phrase(3000), said[2], phrase(3000)])]
    return texts, items


BENCHMARK = "item_id long, text string, doc_id string, key long"


@pytest.mark.parametrize("short", [True, False])
def test_overlaps_equal_sets_of_windows(spark, short):
    texts, items = passages()
    if not short:
        items = [x for x in items if len(words(x[1])) >= 10 or not words(x[1])]
    bench = spark.createDataFrame([(*x, "d", 1) for x in items], BENCHMARK)
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, doc string, key long, items string")
    got = decontamination.find_overlaps(docs, bench).orderBy("doc_id").collect()
    want = leaked(texts, items)
    assert [(g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) for g in got] == want
    assert sum(w[4] for w in want) > 15
    assert all(sum(s.end - s.start for s in g.spans) == g.n_hit and len(g["items"]) == g.n_items for g in got)


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    texts, items = passages()
    bench = spark.createDataFrame([(*x, "d", 1) for x in items], BENCHMARK)
    monkeypatch.setattr(decontamination, "FEW", 40)
    got = decontamination.find_overlaps(documents(spark, *texts), bench).orderBy("doc_id").collect()
    assert [(g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) for g in got] == leaked(texts, items)


def test_repeated_and_null_ids_and_no_items(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, item), (1, item), (1, "clean"), (None, item), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontamination.find_overlaps(docs, bench).collect()
    assert sorted((g.doc_id or 0, g.n_words, g.n_hit) for g in got) == [(0, 0, 0), (0, 12, 12), (1, 1, 0), (1, 12, 12), (1, 12, 12)]
    none = decontamination.find_overlaps(docs, bench.limit(0)).collect()
    assert len(none) == 5 and {(g.n_hit, g.n_items, g.contaminated, g.items_sha256) for g in none} == {(0, 0, False, h(""))}
    assert decontamination.find_overlaps(docs.limit(0), bench).count() == 0


def test_spans_or_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"Start, {item.replace(' ', ', ')}; the end.\n", "nothing of it\n", None, "", f"{item}.", f"a {item} b {item.upper()}\nc"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = decontamination.decontaminate(docs, bench).orderBy("doc_id")
    assert got.columns == docs.columns
    assert [r.text for r in got.collect()] == ["Start; the end.\n", "nothing of it\n", None, "", ".", "a b\nc"]
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench, whole=True).collect()) == [1, 2, 3]


def test_decontamination_runs_no_python(spark):
    docs, bench = documents(spark, "a b"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontamination.find_overlaps(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op13: Merkle manifest ---


def said(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(digests):
    """All levels, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    """(place, run) of a leaf at each level."""
    for level in levels[:-1]:
        start = i // 3 * 3
        yield i - start, level[start : start + 3]
        i //= 3


def manifests(rows):
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, sorted."""
    leaves = {}
    for row in rows:
        doc, text, lang, source, n = row
        of = lambda t: h(*map(said, (doc, source, lang, n, t)))  # noqa: B023, E731
        cut = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        leaves.setdefault(source, []).append((doc is not None, doc or 0, of(text), of(text.replace("\n", "")) if cut else of(text)))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(leaves[s])]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (there, doc, leaf, found) in enumerate(sorted(leaves[s])):
            runs = [*path(trees[s], i), *path(upper, k)]
            proof, folded = [], found
            for place, run in runs:
                proof += run[:place] + run[place + 1 :]
                folded = h(*run[:place], folded, *run[place + 1 :])
            out.append((doc if there else None, leaf, trees[s][-1][0], upper[-1][0], h(*proof), folded, folded == upper[-1][0]))
    return out


def check_manifest(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{DOCS}, tree long, digest string")
    got = merkle.manifest(docs, merkle.without_line_ends(), **options).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(manifests(rows), key=key)


def test_manifest_equals_trees_by_hand(spark):
    r = random.Random(2)
    rows = [(i, f"line {i}\nand{'x' * r.randrange(5)}\n", "en", r.choice(["a", "b", None, "", "é", "Z"]), i) for i in range(300)]
    rows += [(400, None, None, "a", None), (401, "", "en", "lone", 0), (402, "long\n" * 50_000, "en", "b", 5), (None, "x\ny", "en", "a", 3), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (7, "the same id\n", "en", rows[7][3], 2)]
    check_manifest(spark, rows)


@pytest.mark.parametrize("n", [1, 4, 27, 244])
def test_manifest_of_every_shape(spark, n):
    check_manifest(spark, [(i * 7, f"t\n{i}", "en", "s", i) for i in range(n)])


def test_a_large_source_is_many_subtrees_and_epochs(spark):
    check_manifest(spark, [(i, f"t\n{i}", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(700)], span=2)


def test_manifest_of_nothing_and_without_tampering(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    got = merkle.manifest(documents(spark, "a\n", "b\n", None)).collect()
    assert all(r.verified and r.folded_root == r.root for r in got) and len(got) == 3


def test_forward_and_backward_sweeps_agree_with_folding():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(25)]
    nodes = list(merkle.forward(list(range(25)), digests, merkle.height(25)))
    assert [x[:2] for x in nodes] == sorted(x[:2] for x in nodes)
    root = merkle.node(nodes[-1][2])
    proofs = merkle.backward(list(range(25)), digests, merkle.height(25), b"")
    assert {merkle.fold(d, p) for d, p in zip(digests, proofs, strict=True)} == {root}
    assert merkle.fold(digests[1], proofs[0]) != root
