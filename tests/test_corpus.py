from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import corpus, retrieval
from tidewatch.sources import scratch


def chunks(spark, content, **options):
    df = spark.createDataFrame([("d", "T", content)], "document_id string, source_title string, content string")
    return corpus.chunk_documents(df, **options).orderBy("chunk_index").collect()


def test_overlap(spark):
    got = chunks(spark, " ".join(f"w{i}" for i in range(100)), max_words=60, overlap=10)
    assert [r.word_count for r in got] == [60, 50] and got[1].content.startswith("w50 ")
    assert got[0].chunk_id.startswith("d_chk_0_") and len(got[0].chunk_id) == len("d_chk_0_") + 8
    with pytest.raises(ValueError):
        corpus.overlap_pieces(F.lit("x"), 10, 10)


def test_headings(spark):
    short = chunks(spark, "# Intro\nfew words here\n\n## Details\nmore words")
    assert [(r.section_or_page, r.content) for r in short] == [("Details", "# Intro\nfew words here\n## Details\nmore words")]
    words = " ".join(["word"] * 20)
    got = chunks(spark, f"# Section A\n{words}\n# Section B\n{words}")
    assert [(r.section_or_page, r.word_count) for r in got] == [("Section A", 23), ("Section B", 23)]
    pages = chunks(spark, f"--- Page 1 ---\n{words}\n--- Page 2 ---\n{words}")
    assert [r.section_or_page for r in pages] == ["Page 1", "Page 2"]
    lead = chunks(spark, f"{words}\n# Later\nx")
    assert [(r.section_or_page, r.word_count) for r in lead] == [("General", 20), ("Later", 3)]
    assert chunks(spark, "") == [] and chunks(spark, "\n \n") == []


def test_many_headings(spark):
    """20,000 headings, as many sections: their names and texts, and short ones that join what follows."""
    words = " ".join(["word"] * 16)
    text = "\n".join(f"# H{i}\n{words} {i}" if i % 4 else f"# S{i}\nshort" for i in range(20_000))
    docs = spark.createDataFrame([("d", text), ("e", "no heading"), ("f", "# only")], "document_id string, content string")
    got = {(r.document_id, r.section_no): (r.section, r.text) for r in corpus.sections(docs).collect()}
    assert got["e", 0] == ("General", "no heading") and got["f", 0] == ("only", "# only")
    mine = [got["d", i] for i in range(len(got) - 2)]
    assert len(mine) == 15_000 and "\n".join(t for _, t in mine) == text
    assert mine[0] == ("H1", f"# S0\nshort\n# H1\n{words} 1") and mine[-1][0] == "H19999"


def test_clean(spark):
    got = spark.createDataFrame([("  Hello World  \n\n \t This is a test. \n",)], "t string").select(corpus.clean_text(F.col("t"))).first()[0]
    assert got == "Hello World\nThis is a test."


def named_files(spark, *rows):
    return spark.createDataFrame(list(rows), "filename string, content string").withColumn("sha256", F.sha2("content", 256))


def test_ingest(spark, tmp_path):
    folder = str(tmp_path)
    assert corpus.corpus_table(spark, folder, "documents") is None
    docs = named_files(spark, ("b.txt", "same text"), ("a.txt", "same text"), ("c.txt", "other text"))
    at = F.lit(dt.datetime(2026, 1, 1))
    assert [r.filename for r in corpus.ingest(spark, docs, folder, at).collect()] == ["b.txt"]
    again = named_files(spark, ("z.txt", "other text"), ("n.txt", "new"), ("n.txt", "new"))
    lost = corpus.ingest(spark, again, folder, F.lit(dt.datetime(2026, 1, 2)), more={"vectors": retrieval.indexed_vectors})
    assert sorted(r.filename for r in lost.collect()) == ["n.txt", "z.txt"]
    stored = corpus.corpus_table(spark, folder, "documents")
    assert [r.source_title for r in corpus.list_documents(stored).collect()][0] == "n.txt" and stored.count() == 3
    every = corpus.ordered_chunks(corpus.corpus_table(spark, folder, "chunks"), stored)
    assert every.count() == 3 and every.first().document_id.startswith("doc_")
    assert {r.n_words for r in corpus.document_sizes(every).collect()} == {1, 2}
    assert corpus.corpus_table(spark, folder, "vectors", corpus.commits(spark, folder)[1:]).count() == 1
    assert corpus.ingest(spark, docs, folder).count() == 3 and len(corpus.commits(spark, folder)) == 3


def test_an_ingest_that_breaks_off_counts_for_nothing(spark, tmp_path):
    """Wherever it breaks, the tables stay as they were, and a retry gives each chunk once."""
    folder, docs = str(tmp_path), named_files(spark, ("a.txt", "one text"), ("b.txt", "two texts"))
    corpus.ingest(spark, docs, folder)

    def breaks(_):
        raise RuntimeError("lost")

    more = named_files(spark, ("b.txt", "two texts"), ("c.txt", "three texts here"))
    for _ in range(2):
        with pytest.raises(RuntimeError):
            corpus.ingest(spark, more, folder, more={"index": breaks})
    assert corpus.corpus_table(spark, folder, "chunks").count() == 2 == corpus.corpus_table(spark, folder, "documents").count()
    assert [r.filename for r in corpus.ingest(spark, more, folder).collect()] == ["b.txt"]
    chunks = corpus.corpus_table(spark, folder, "chunks")
    assert chunks.count() == 3 == chunks.select("chunk_id").distinct().count()
    assert len(corpus.remove_uncommitted(spark, folder)) == 2 and corpus.remove_uncommitted(spark, folder) == []
    assert corpus.corpus_table(spark, folder, "chunks").count() == 3


def test_two_ingests_at_once(spark, tmp_path):
    folder = str(tmp_path)

    def meanwhile(chunks):
        corpus.ingest(spark, named_files(spark, ("b.txt", "text")), folder)
        return chunks

    with pytest.raises(corpus.IngestConflict):
        corpus.ingest(spark, named_files(spark, ("a.txt", "text")), folder, more={"other": meanwhile})
    assert [r.source_title for r in corpus.corpus_table(spark, folder, "documents").collect()] == ["b.txt"]


def test_copies_do_not_meet_in_one_task(spark):
    docs = spark.range(2000).select(F.format_string("f%05d", "id").alias("filename"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("content")).withColumn("sha256", F.sha2("content", 256))
    new, old = corpus.reject_duplicates(docs)
    assert new.count() == 2000 - 667 + 1 and old.count() == 666 and new.where("content = ''").first().filename == "f00000"
    window = [x for x in new._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert window and all("filename" in x for x in window)


TEXTS = [("c1", "apple is a fruit fruit"), ("c2", "banana is a yellow fruit"), ("c3", "a car is transportation")]


def test_tfidf(spark):
    docs = spark.createDataFrame(TEXTS, "chunk_id string, content string")
    ask = lambda *q: [(r.query_id, r.chunk_id) for r in retrieval.tfidf_search(docs, spark.createDataFrame(list(enumerate(q)), "query_id int, query string"), k=2).orderBy("query_id", "rank").collect()]
    assert ask("fruit", "transportation", "spaceship", "") == [(0, "c1"), (0, "c2"), (1, "c3")]
    none = retrieval.tfidf_search(docs.limit(0), spark.createDataFrame([(0, "x")], "query_id int, query string"))
    assert none.count() == 0


def test_embeddings(spark):
    rows = [("ssh", "ssh brute force failed login"), ("web", "sql injection xss web attack"), ("none", " !! ")]
    t = spark.createDataFrame(rows, "chunk_id string, content string")
    got = {r.chunk_id: r.embedding for r in retrieval.embed(t, "chunk_id", "content").collect()}
    assert all(len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())
    assert got["none"][0] == 1.0
    docs = spark.createDataFrame([(k, "d", "T", "S", c, 3) for k, c in rows[:2]], "chunk_id string, document_id string, source_title string, section_or_page string, content string, word_count int")
    q = spark.createDataFrame([(1, "ssh login failures"), (2, "xss and sql attack")], "query_id int, query string")
    top = retrieval.semantic_search(docs, q, k=1).orderBy("query_id").collect()
    assert [r.chunk_id for r in top] == ["ssh", "web"]
    half = retrieval.indexed_vectors(docs.limit(1))
    more = retrieval.extend_index(docs, half)
    assert more.count() == 1
    by_index = retrieval.semantic_search(docs, q, k=2, index=half.unionByName(more)).orderBy("query_id", "rank").collect()
    assert by_index == retrieval.semantic_search(docs, q, k=2).orderBy("query_id", "rank").collect()
    mine = retrieval.indexed_vectors(docs, lambda t: F.array(F.length(t).cast("double"), F.lit(0.0))).collect()
    assert [list(r.embedding) for r in mine] == [[1.0, 0.0]] * 2


def test_vector_search_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(20)], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "query_id int, embedding array<double>")
    got = [r.chunk_id for r in retrieval.vector_search(v, q, k=4).orderBy("rank").collect()]
    want = sorted(range(20), key=lambda i: (-(i % 3 + 2 * (i % 5)), i))[:4]
    assert got == want


def test_blocks_of_queries(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(20)], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "query_id int, embedding array<double>")
    one, many = (sorted(retrieval.vector_search(v, q, k=3, batch=n).collect()) for n in (100, 4))
    assert one == many and len(one) == 36


def test_long_texts(spark):
    """Pieces of a long text and norms of long vectors are worked out once."""
    long = " ".join(f"w{i}" for i in range(200_000))
    got = spark.createDataFrame([(long,)], "t string").select(F.size(corpus.overlap_pieces(F.col("t"))).alias("n")).first()
    assert got.n == -(-(200_000 - 400) // 350) + 1
    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: i.cast("double")).alias("v"))
    assert abs(v.select(F.aggregate(retrieval.normalised(F.col("v")), F.lit(0.0), lambda a, x: a + x * x).alias("s")).first().s - 1) < 1e-3


def packed(spark, rows, *args):
    df = spark.createDataFrame([("q", i, c, d, w) for i, (c, d, w) in enumerate(rows, 1)], "query_id string, rank int, chunk_id string, document_id string, word_count int")
    return [r.chunk_id for r in retrieval.pack_context(df, *args).orderBy("rank").collect()]


def test_packing(spark):
    assert packed(spark, [("c1", "d1", 10), ("c2", "d1", 10), ("c3", "d1", 10), ("c4", "d2", 10)]) == ["c1", "c2", "c4"]
    assert packed(spark, [("c1", "d1", 100), ("c2", "d2", 150), ("c3", "d3", 100)], 200) == ["c1", "c3"]
    # a chunk that does not fit uses up no place of its document
    assert packed(spark, [("c1", "d1", 100), ("c2", "d1", 150), ("c3", "d1", 50)], 200, 2) == ["c1", "c3"]


def best_by_sorting(v, q, k, digits=None, least=None):
    out = set()
    for i, x in q:
        scored = [(round(sum(a * b for a, b in zip(x, y)), digits) if digits else sum(a * b for a, b in zip(x, y)), key) for key, y in v if y and len(y) == len(x) and None not in y]
        scored = sorted(((s, key) for s, key in scored if least is None or s >= least), key=lambda p: (-p[0], p[1]))[:k]
        out |= {(i, key, n + 1) for n, (_, key) in enumerate(scored)}
    return out


def test_vector_search_equals_a_sort_of_all_pairs(spark):
    """Ties, equal vectors, nulls, other lengths, fewer vectors than asked for, in one and many blocks."""
    import random

    rng = random.Random(6)
    point = lambda: [rng.randrange(-3, 4) / 2 for _ in range(4)]
    v = [(f"c{i}", point()) for i in range(300)] + [(f"d{i}", [1.5, 1.5, 1.5, 1.5]) for i in range(9)] + [("n", None), ("m", [1.0, None, 0.0, 0.0]), ("two", [1.0, 2.0]), ("e", [])]
    q = [(i, point()) for i in range(40)] + [(90, [1.0, 1.0]), (91, [0.0] * 4)]
    vectors = spark.createDataFrame(v, "chunk_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(q, "query_id long, embedding array<float>")
    for options in ({"k": 7}, {"k": 3, "min_score": 2.0}, {"k": 400}, {"k": 5, "digits": 1, "batch": 9}):
        got = retrieval.vector_search(vectors, queries, **options).collect()
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == best_by_sorting(v, q, options["k"], options.get("digits"), options.get("min_score"))
    assert retrieval.vector_search(vectors.limit(0), queries).count() == 0 == retrieval.vector_search(vectors, queries.limit(0)).count()
    plan = retrieval.vector_search(vectors, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_blocks_that_hold_nothing_near_are_skipped(spark):
    """Of vectors in groups, those of a clustered table are skipped but for the nearest groups, with the same result."""
    import numpy as np

    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, 16))
    v = np.repeat(middles, 200, axis=0) + rng.normal(scale=0.02, size=(12_000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    mixed = rng.permutation(12_000)
    q = v[rng.integers(0, 12_000, 50)]
    frame = spark.createDataFrame([(int(i), v[i].tolist()) for i in mixed], "chunk_id long, embedding array<double>").repartition(4)
    shares, results = [], []
    for table in (frame, retrieval.clustered(frame, 60)):
        rows = table.collect()
        best = retrieval.Best(q, 5)
        for i in range(0, len(rows), 50):
            best.add(np.array([r.embedding for r in rows[i : i + 50]]), np.array([r.chunk_id for r in rows[i : i + 50]] + [None], object)[:-1])
        shares.append(best.skipped / best.compared)
        results.append(sorted(zip(best.query.tolist(), best.key.tolist(), strict=True)))
    assert results[0] == results[1] and len(results[0]) == 250
    assert shares[0] < 0.05 and shares[1] > 0.6
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [None]), (4, [])], "chunk_id long, embedding array<double>")
    assert sorted(r.chunk_id for r in retrieval.clustered(odd).collect()) == [1, 2, 3, 4] and retrieval.clustered(odd.limit(0)).count() == 0


def hashed_by_hand(text):
    import collections
    import hashlib
    import math
    import re

    w = collections.Counter()
    for t in re.findall(r"\b[a-z0-9]+\b", (text or "").lower()):
        for part, weight in [(t, 5), (t[:3], 4), (t[:4], 3)][: 3 if len(t) >= 4 else 1]:
            w[int(hashlib.md5(part.encode()).hexdigest()[:8], 16) % 384] += weight
    w = w or {0: 5}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {b: x / norm for b, x in w.items()}


def test_hashed_vectors_are_made_where_texts_are_read(spark):
    """Without a shuffle of tokens, in blocks of texts, with texts that are null or empty between them."""
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else " ".join(f"w{i * j % 97}rd" * (j % 3 + 1) + " ab é1" for j in range(i % 11)) for i in range(2500)]
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").coalesce(1)
    vectors, features = retrieval.embed(t, "chunk_id", "content"), retrieval.hashed_features(t, "chunk_id", "content")
    for df in (vectors, features):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and "Generate" not in plan
    want = {i: hashed_by_hand(x) for i, x in enumerate(texts)}
    sparse = {}
    for r in features.collect():
        sparse.setdefault(r.chunk_id, {})[r.bucket] = r.w
    assert sparse.keys() == want.keys() and all(sparse[i].keys() == want[i].keys() and all(abs(sparse[i][b] - x) < 1e-12 for b, x in want[i].items()) for i in want)
    got = vectors.collect()
    assert len(got) == 2500 and all(abs(x - want[r.chunk_id].get(b, 0.0)) < 1e-6 for r in got for b, x in enumerate(r.embedding))


def test_tfidf_equals_a_sum_over_all_pairs(spark):
    """Equal texts, terms beyond those sent to tasks, texts without tokens, null texts and keys, blocks of queries; no
    join gives a row for a pair of a query and a chunk."""
    import collections
    import math
    import random
    import re

    rng = random.Random(8)
    words = [f"t{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(words) if rng.random() < 0.8 else f"only{i}x{j}" for j in range(rng.randrange(12)))) for i in range(300)]
    texts += [(300 + i, texts[i][1]) for i in range(60)] + [(400, None), (401, "!"), (None, "t1 t2")]
    asked = [(f"q{i}", " ".join(rng.choice([*words, "unknown", "only7x0"]) for _ in range(rng.randrange(6)))) for i in range(25)]
    terms = lambda t: collections.Counter(re.findall(r"\b[a-z0-9]+\b", (t or "").lower()))
    bags = [(i, terms(t)) for i, t in texts]
    df = collections.Counter(t for _, b in bags for t in b)
    idf = {t: math.log(len(texts) / (1 + n)) + 1 for t, n in df.items()}
    weigh = lambda b: {t: n / max(b.values()) * idf[t] for t, n in b.items() if t in idf}
    length = lambda w: math.sqrt(sum(x * x for x in w.values()))
    chunks = spark.createDataFrame(texts, "chunk_id long, content string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, query string")
    for options in ({"k": 4}, {"k": 3, "common": 10, "batch": 7}, {"k": 200, "common": 0, "min_score": 0.3}):
        want = set()
        for q, text in asked:
            w = weigh(terms(text))
            scored = [(round(sum(x * v.get(t, 0) for t, x in w.items()) / length(w) / length(v), 6), i) for i, b in bags if i is not None and b and (v := weigh(b)) and w]
            scored = sorted((s for s in scored if s[0] >= options.get("min_score", 0.05)), key=lambda s: (-s[0], s[1]))[: options["k"]]
            want |= {(q, i, s, n + 1) for n, (s, i) in enumerate(scored)}
        got = retrieval.tfidf_search(chunks, queries, digits=6, **options)
        assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()} == want and want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


ODD = ["caf\u00e9 abc", "e\u0301x abc\u0301 x\u0301", "a\u200db c\u200cd e\u200bf", "x\u00b2 10\u00bd \u2460y", "\u24b6z z\u24d0", "\u0130X \u212a9 \u212a", "A_b a-b_c", "\U0001f600a \U0001d400b b\U0001d7ce", "\u0663abc abc\u203f", "\u65e5ab ab\u3002cd", "tail", "", None, "Head tail", "9"]


def test_tokens_are_the_matches_of_the_pattern(spark):
    """Letters, marks, digits, joiners and connectors of any script next to a token, texts that end in one."""
    import collections

    t = spark.createDataFrame(list(enumerate(ODD)), "k int, t string").coalesce(1)
    pattern = F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)\b[a-z0-9]+\b"), F.lit(0))
    want = set()
    for r in t.select("k", pattern.alias("w")).collect():
        n = collections.Counter(r.w or [])
        want |= {(r.k, w, x / max(n.values())) for w, x in n.items()}
    assert {tuple(r) for r in retrieval.term_frequencies(t, "k", "t").collect()} == want and len(want) > 15


def test_texts_are_looked_at_in_parts(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a b", None, "ccc", "d" * 50, "e", "", "f"])], ["k", "t"])
    monkeypatch.setattr(retrieval, "TEXT", 6)
    monkeypatch.setattr(retrieval, "TEXTS", 3)
    parts = list(retrieval._parts(batch))
    assert [p.num_rows for p in parts] == [3, 1, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    sizes, words = retrieval._words(batch.column(1))
    assert sizes.tolist() == [2, 0, 1, 1, 1, 0, 1] and words.to_pylist() == ["a", "b", "ccc", "d" * 50, "e", "f"]


def test_a_block_of_texts_has_each_term_once(spark):
    """What is written of 3,000 texts of 40 terms is one row with their terms, not a list of terms for each text."""
    import numpy as np

    docs = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("the the common words "), F.concat(F.lit("w"), F.col("id") % 36)).alias("t")).coalesce(1)
    (block,) = retrieval.counted_terms(docs, "k", "t").collect()
    sizes, at, n = (np.frombuffer(block[name], "<i4") for name in ("sizes", "at", "n"))
    assert block["keys"] == list(range(3000)) and block["terms"] == sorted(["the", "common", "words", *(f"w{i}" for i in range(36))])
    assert set(sizes) == {4} and [block["terms"][i] for i in at[:4]] == ["common", "the", "w0", "words"] and n[:4].tolist() == [1, 2, 1, 1]
    assert dict(zip(block["terms"], block["texts"], strict=True))["the"] == 3000 and sum(block["texts"]) == 12_000


def test_terms_of_one_frequency_need_no_join(spark):
    """If the terms that are not sent have one frequency, their weight is known without a join."""
    docs = spark.range(60).select(F.format_string("c%02d", "id").alias("chunk_id"), F.format_string("own%d other%d w%d w%d all", "id", "id", F.col("id") % 5, F.col("id") % 7).alias("content"))
    queries = spark.createDataFrame([(1, "w1 w3 own7"), (2, "all other9 w2")], "query_id int, query string")
    results = []
    for common in (1000, 8, 0):  # all, all but those of one text, none
        before = set(scratch_tables(spark, "norms"))
        results.append(sorted(retrieval.tfidf_search(docs, queries, k=20, digits=6, common=common).collect()))
        assert bool(set(scratch_tables(spark, "norms")) - before) == (common == 0)
    assert results[0] == results[1] == results[2] and len(results[0]) > 30


def scratch_tables(spark, name):
    import os

    folder = scratch.shared_folder(spark)
    return [x for x in os.listdir(folder) if x.startswith(name)] if os.path.isdir(folder) else []


def test_vectors_take_tokens_from_bytes(spark):
    """No regular expression runs over the texts, and no list of tokens leaves the JVM; long words share the buckets of their starts."""
    chunks = spark.createDataFrame([("a", "T", "S", "Failed failures café x"), ("b", "T", "S", None)], "chunk_id string, source_title string, section_or_page string, content string")
    vectors = retrieval.indexed_vectors(chunks)
    assert "regexp" not in vectors._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.chunk_id: {i: x for i, x in enumerate(r.embedding) if x} for r in vectors.collect()}
    want = hashed_by_hand("T S\nFailed failures café x")
    assert got["a"].keys() == want.keys() and all(abs(got["a"][i] - x) < 1e-6 for i, x in want.items()) and got["b"] == {0: 1.0}
