from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import components, documents
from tidewatch.llm import embedding_dedup, line_dedup, simhash_dedup


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_fingerprints():
    rng = random.Random(1)
    texts = near_texts(rng, 40) + [None, "", " \n", "One", "one TWO", "É é É", "a\u00a0b c d"]
    for t in texts:
        assert simhash_dedup.fingerprint(t) & (1 << 64) - 1 == brute_fingerprint(t), t


def test_simhash_groups(spark):
    rng = random.Random(2)
    texts = near_texts(rng, 120) + [None, "", "x", "x", "X"]
    fps = [brute_fingerprint(t) for t in texts]
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    docs = documents(spark, *texts).withColumnRenamed("lang", "component_id")
    got = {r.doc_id: r for r in simhash_dedup.simhash_groups(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in enumerate(fps)) and len(set(want)) < len(want)
    kept = {r.doc_id for r in simhash_dedup.simhash_keep(docs).collect()}
    assert kept == set(want)
    assert simhash_dedup.simhash_groups(docs.limit(0)).count() == 0


def test_planted_fingerprints(spark):
    """Every pattern of up to three differing bits over chains and stars, and near misses."""
    rng = random.Random(3)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = set()
    for _ in range(40):
        center = rng.getrandbits(64)
        fps |= {center} | {flip(center, k) for k in (1, 2, 3, 3, 4, 5)}
        low = rng.getrandbits(32)
        fps |= {low | (rng.getrandbits(3) << 61) for _ in range(6)}
    fps = sorted(fps)
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from tidewatch.llm.common import connected_components

    parts = {r.id: r.component for r in connected_components(simhash_dedup.link_fingerprints(df)).collect()}
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(parts.get(f, f), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in range(len(fps)) if want[i] == c) for c in set(want))


def test_hot_keys(spark, monkeypatch):
    """Many unlike fingerprints with one equal half share keys: they are compared in parts, and no link is lost."""
    monkeypatch.setattr(simhash_dedup, "CELL", 32)
    rng = random.Random(5)
    low = rng.getrandbits(32)
    fps = {low | rng.getrandbits(32) << 32 for _ in range(150)}
    fps |= {f ^ (1 << rng.randrange(64) | 1 << rng.randrange(64)) for f in rng.sample(sorted(fps), 60)}
    fps = sorted(fps)
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(fps.index(r.a % (1 << 64)), fps.index(r.b % (1 << 64))) for r in simhash_dedup.link_fingerprints(df).collect()]
    assert components(len(fps), links) == want and len(set(want)) < len(fps)


def test_very_long_text(monkeypatch):
    """More shingles than are counted at once."""
    rng = random.Random(6)
    text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(150_000))
    whole = simhash_dedup.fingerprint(text)
    assert len(text.split()) > 2 * simhash_dedup._BLOCK and whole & (1 << 64) - 1 == brute_fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "_BLOCK", 7)
    assert simhash_dedup.fingerprint(text[:5000]) & (1 << 64) - 1 == brute_fingerprint(text[:5000])


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "other words are here")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash_dedup.simhash_groups(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert simhash_dedup.simhash_keep(docs).count() == 4


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_edit_similarity():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert abs(line_dedup.edit_similarity(a, b) - plain_edit(a, b)) < 1e-12
    long = ["w"] * 5000
    assert line_dedup.edit_similarity(long, long[:-100] + ["x"] * 100) == 1 - 100 / 5000


def edited(rng, words, share, vocabulary):
    """A copy with `share` of its words changed, dropped or doubled by a new one."""
    w = list(words)
    for _ in range(int(share * len(w) + 1e-9)):
        k = rng.randrange(len(w))
        w[k : k + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1, 1])
    return w


def test_blocks_against_brute_force():
    rng = random.Random(6)
    powers = line_dedup._Powers()
    texts = ["one  two\tthree four\nfive", " \n\n", "", "é ü\nü", "x" * 3000] + [" ".join(rng.choice(["a", "bb", "ccc"]) for _ in range(50))]
    hashes = {}
    for t in texts:
        got, starts, ends = line_dedup._words(np.frombuffer(t.encode(), np.uint8), powers)
        assert [t.encode()[a:b] for a, b in zip(starts, ends, strict=True)] == t.encode().split()
        assert all(hashes.setdefault(w, h) == h for w, h in zip(t.encode().split(), got.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes)
    units = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
    for width in (1, 2, 3, 4):
        turned = lambda i: [(int(units[i + k]) << 13 * k | int(units[i + k]) >> (64 - 13 * k)) & (1 << 64) - 1 for k in range(width)]  # noqa: B023, E731
        want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in turned(i)) > width) for i in range(40 - width + 1)]
        assert line_dedup.simhash_of(units, width).tolist() == want
        sizes = np.array([1, 7, 20, 2, 10])
        block, line = line_dedup.line_blocks(units, sizes, width, 5)
        assert np.bincount(line, minlength=5).tolist() == [max(0, min(5, n - width + 1)) for n in sizes]
        assert set(block.tolist()) <= set(want)


@pytest.mark.parametrize("n", [5, 6, 7, 9, 12, 20, 40, 80, 200])
def test_recall_of_blocks(n):
    """Pairs at the stated similarity, found by edit similarity alone, share a block: at least 0.98 of them."""
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 6, 9]))) for _ in range(3000)]
    table = line_dedup._LineTable(0.8, 5, 1e-3)
    import pyarrow as pa

    hits = pairs = 0
    for _ in range(300):
        a = [rng.choice(words) for _ in range(n)]
        b = edited(rng, a, 0.2, words)
        if plain_edit(a, b) < 0.8 or a == b or len(b) < 5:
            continue
        got = table.rows(pa.array([1]), pa.array([1]), [" ".join(a) + "\n" + " ".join(b)]).column("blocks").to_pylist()
        pairs += 1
        hits += bool(set(got[0]) & set(got[1]))
    assert pairs > 150 and hits >= (pairs if n < 10 else 0.98 * pairs)


@pytest.mark.parametrize("changed", [1, 2, 3, 4, 6, "every fifth"])
def test_recall_of_lines_of_one_form(changed):
    """Lines of 30 to 60 words that differ in a few words of 32 characters, as addresses and hashes are, or in every
    fifth word: at least 0.95 of the pairs share a block."""
    import pyarrow as pa

    rng = random.Random(str(changed))
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 6, 9]))) for _ in range(3000)]
    table, hits, pairs = line_dedup._LineTable(0.8, 5, 1e-3), 0, 300
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    for _ in range(pairs):
        a = [rng.choice(words) for _ in range(rng.randrange(30, 61))]
        b, at = list(a), range(4, len(a), 5) if changed == "every fifth" else rng.sample(range(len(a)), changed)
        for i in at:
            a[i], b[i] = (a[i], rng.choice(words)) if changed == "every fifth" else (token(), token())
        assert plain_edit(a, b) >= 0.8
        got = table.rows(pa.array([1]), pa.array([1]), [" ".join(a) + "\n" + " ".join(b)]).column("blocks").to_pylist()
        hits += bool(set(got[0]) & set(got[1]))
    assert hits >= 0.95 * pairs


def test_number_of_blocks():
    assert line_dedup.n_blocks(0.8, 3, 1e-3) == 9 and line_dedup.n_blocks(0.8, 3, 0.1) < 9 < line_dedup.n_blocks(0.7, 3, 1e-3)
    assert line_dedup.narrow_up_to(0.8, 3) == 6  # five words, one changed in the middle


def test_hot_blocks(spark, monkeypatch):
    """A block that most lines share is compared in parts, and no pair is lost."""
    monkeypatch.setattr(line_dedup, "CELL", 16)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(9)] for _ in range(150)]
    lines = [["common-passage-of", "three-very-long", "words-is-here", *w] for w in base + [edited(rng, rng.choice(base), 0.1, words) for _ in range(60)]]
    want = components(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if plain_edit(lines[i], lines[j]) >= 0.8])
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(documents(spark, *(" ".join(w) for w in lines))).collect()}
    assert [got[i] for i in range(len(lines))] == [int(c != i) for i, c in enumerate(want)] and 20 < sum(got.values())


def test_long_lines(spark):
    """Lines of many words, one of them a whole batch, and a very long word."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    long = [rng.choice(words) for _ in range(60_000)]
    texts = [" ".join(long), " ".join(edited(rng, long, 0.02, words)), " ".join(long[:40_000]), "y" * 2_000_000, "y" * 1_999_000 + "z" * 1000, "end"]
    got = [r.n_dropped for r in line_dedup.dedup_lines(documents(spark, *texts)).orderBy("doc_id").collect()]
    assert got == [0, 1, 0, 0, 1, 0]


def test_lines_against_edit_similarity(spark):
    """Plain edit similarity alone, over all pairs: words changed, dropped, put in and moved."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 6]))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([5, 6, 9, 15, 32, 41, 60]))] for _ in range(30)]
    lines = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.choice([0, 1, 1])
        lines.append(w if len(w) >= 5 else w + ["x"] * 5)
    lines += [["same"] * n for n in (5, 6, 8, 20)]
    similar = [(i, j) for i in range(len(lines)) for j in range(i) if plain_edit(lines[i], lines[j]) >= 0.8]
    want = components(len(lines), similar)
    docs = documents(spark, *(" ".join(w) for w in lines))
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(lines))] == [int(c != i) for i, c in enumerate(want)]
    assert len(set(want)) > 30
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_edits_are_counted_last(monkeypatch):
    """Lines that differ in places, and lines with too few units in common, are told by bounds; the rest by edits."""
    counted, count = [], line_dedup.edit_similarity
    monkeypatch.setattr(line_dedup, "edit_similarity", lambda a, b: counted.append(1) or count(a, b))
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(40)]

    def changed(n):
        return " ".join(rng.choice(words) if i in places else w for places in [set(rng.sample(range(40), n))] for i, w in enumerate(base))

    assert line_dedup._cell_links([changed(4), changed(4)], 0.8, 5) == [(0, 1)]
    assert line_dedup._cell_links([" ".join(base), changed(30)], 0.8, 5) == []
    assert line_dedup._cell_links([" ".join(["a"] * 30 + ["b"] * 10), " ".join(["a"] * 10 + ["b"] * 30)], 0.8, 5) == []
    assert len(line_dedup._cell_links([changed(2) for _ in range(50)], 0.8, 5)) == 49
    assert not counted
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(5, 15))] for _ in range(2))
        b = rng.choice([b, edited(rng, a, 0.2, "abcd"), a[1:] + ["x"]])
        for least in (0.5, 0.8, 1.0):
            assert line_dedup._cell_links([" ".join(a), " ".join(b)], least, 1) == [(0, 1)] * (plain_edit(a, b) >= least)
    assert counted


def test_larger_cells(monkeypatch):
    """Groups in a cell, some more than are kept at hand, are those of all pairs."""
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(12)] for _ in range(9)] + [["many"] * 12]
    lines = [edited(rng, rng.choice(base), rng.choice([0, 0.1, 0.2, 0.3]), words) for _ in range(120)]
    want = components(120, [(i, j) for i in range(120) for j in range(i) if plain_edit(lines[i], lines[j]) >= 0.8])
    links = line_dedup._cell_links([" ".join(x) for x in lines], 0.8, 5)
    assert components(120, links) == want and 9 < len(set(want)) < 110 and len(links) == 120 - len(set(want))


def test_plain_lines():
    """Keys are those of lines with single spaces, however the words stand."""
    import pyarrow as pa

    rng = random.Random(23)
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", " \r", "\x0b", "\n", "\n\n"])
    texts = ["", " ", "\n", "one", " one", "one ", *("".join(rng.choice(["É", "ab", "c", ""]) + gap() for _ in range(rng.randint(1, 30))) for _ in range(200))]
    ids = pa.array(range(len(texts)), pa.int64())
    got = line_dedup._LineTable(0.8, 5, 1e-3).rows(ids, ids, texts)
    rows = list(zip(*(got.column(c).to_pylist() for c in ("doc", "line_no", "key")), strict=True))
    lines = [(d, i, b" ".join(x.lower().encode().split())) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    assert [(d, i, k % (1 << 64)) for d, i, k in rows] == [(d, i, xxhash.xxh64_intdigest(x)) for d, i, x in lines if x]


def test_short_and_unspaced_lines(spark):
    """Exact repeats of any length go, empty lines stay; lines of few words are compared by characters."""
    rng = random.Random(9)
    base = ["".join(rng.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏") for _ in range(rng.choice([20, 24, 25, 31, 45, 90]))) for _ in range(8)]
    lines = []
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 5)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice("天地玄黃")] * rng.choice([0, 1])
        lines.append("".join(w))
    lines += ["", "a b", " A  b", "", "a c", "x", "x", "short one", "short one"]
    compared = [(i, j) for i in range(len(lines)) for j in range(i) if min(len(lines[i]), len(lines[j])) >= 20 and plain_edit(lines[i], lines[j]) >= 0.8]
    plain = [" ".join(x.lower().split()) for x in lines]
    want = components(len(lines), compared + [(i, j) for i in range(len(lines)) for j in range(i) if plain[i] and plain[i] == plain[j]])
    got = line_dedup.dedup_lines(documents(spark, "\n".join(lines))).first()
    assert got.text.split("\n") == [x for i, x in enumerate(lines) if want[i] == i]
    assert got.n_dropped == sum(c != i for i, c in enumerate(want)) > 30


def test_line_cases(spark):
    line = "one two three four five six"
    texts = [line, f"start\n{line.upper()}\n\n  One  two three FOUR five six \nend", None, "", line, "a b\na b"]
    docs = documents(spark, *texts).withColumnRenamed("lang", "n_lines").withColumn("key", F.lit(1))
    rows = docs.collect() + [docs.collect()[0]]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, docs.schema)).orderBy("doc_id").collect()
    assert [r.text for r in got] == [line, line, "start\n\nend", None, "", "", "a b"]
    assert [r.n_dropped for r in got] == [0, 0, 2, 0, 0, 1, 1] and [r.n_lines for r in got] == [1, 1, 5, 0, 1, 1, 2]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, line), (4, line)], "doc_id long, text string")
    assert [(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(nameless).orderBy("doc_id").collect()] == [(None, 1), (4, 0)]


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base[rng.integers(0, 30, 200)] + rng.standard_normal((200, 16)) * 0.12, np.repeat(base[:1], 70, axis=0) + rng.standard_normal((70, 16)) * 0.05, base[:3], base[:3] * 2])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(2000, rows[0][1]), (None, rows[0][1])], "vec_id long, embedding array<double>")
    u = np.concatenate([x, x[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(len(x)), 2000]
    comp = components(len(ids), [(i, j) for i, j in zip(*np.nonzero(near)) if j < i])
    got = embedding_dedup.embedding_groups(df, block=block, miss=1e-9).collect()
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == df.count()
    assert [by[i].n_links for i in ids] == near.sum(axis=1).tolist()
    assert [by[i].component_id for i in ids] == [ids[c] for c in comp]
    assert all(by[1000 + i].n_links == 0 and by[1000 + i].kept for i in range(len(odd)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in by.values())
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_repeated_vectors(spark):
    """Repeated rows count once; columns with the operator's own names do no harm."""
    v, w, u = [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(1, v), (1, v), (2, w), (3, v), (4, u), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, x, i, "x") for i, x in rows], "vec_id long, embedding array<double>, n_links long, node string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(df).collect()]
    assert sorted(got) == [(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False)] + [(5, 0, 5, True)] * 2


@pytest.mark.parametrize("cosine", [0.95, 0.99])
def test_recall_of_links(spark, cosine):
    """All pairs of 6,000 vectors by brute force, with the settings of production."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3000, 24))
    angle = np.arccos(cosine) * rng.uniform(0.2, 1.1, 3000)
    other = rng.standard_normal((3000, 24))
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    other -= (other * u).sum(axis=1, keepdims=True) * u
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate([u, np.cos(angle)[:, None] * u + np.sin(angle)[:, None] * other])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= cosine).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_groups(df, cosine=cosine).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= links).all() and links.sum() > 4000 and found.sum() >= 0.999 * links.sum()


def test_recall(spark):
    bits, tables = embedding_dedup.tables_for(10**9, 0.95)
    assert bits > 16 and 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 1 - 1e-4
    assert embedding_dedup.tables_for(0, 0.95)[0] == 4
