from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm.helpers import documents
from tidewatch.llm import bpe, token_counts
from tidewatch.llm.queries import CODE_VOCABULARY, PATTERN

RANKS = bpe.parse_vocabulary(bpe.read_vocabulary(CODE_VOCABULARY))
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, PATTERN)


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


def test_every_code_point():
    for c in range(0, 0x110000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            t = f"a{x}{x}1 {x}b"
            assert ids(t) == ORACLE.encode_ordinary(t), hex(c)


def test_random_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t'sé漢🙂.,!1 ") for _ in range(rng.randint(0, 200))) for _ in range(2000)]
    texts += ["ab" * 5000, "a" * 30000, " " * 999 + "x", "é" * 3000, "", " ", "\n", " a", "a ", "a  b", "don't we'll"]
    for t in texts:
        assert ids(t) == ORACLE.encode_ordinary(t), t[:50]
        assert CODEC.decode(CODEC.encode(t)) == t.encode()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 4)
    small = bpe.Codec(RANKS, PATTERN)
    text = "one two three four five six one two three " * 20
    assert small.encode(text) == CODEC.encode(text)


def test_other_patterns_and_vocabularies():
    ranks = bpe.parse_vocabulary(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pattern = r"\p{L}+|\s|[^\s\p{L}]+"
    oracle = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, pattern)
    t = "Some text,  with 12 signs\n!"
    assert np.frombuffer(codec.encode(t), "<u4").tolist() == oracle.encode_ordinary(t)


def test_frames(spark):
    texts = ["hello world", "", None, "hello world", "x" * 2000 + " end"]
    docs = documents(spark, *texts).withColumnRenamed("lang", "ids")
    got = {r.doc_id: r for r in bpe.digests(docs, CODE_VOCABULARY, PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = np.array(ORACLE.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, bytes(got[i].ids)) == (len(want) // 4, want)
        assert got[i].ids_sha256 == hashlib.sha256(want).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.decode(bpe.encode(docs, CODE_VOCABULARY, PATTERN), CODE_VOCABULARY, PATTERN)
    assert [bytes(r.decoded).decode() for r in coded.orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert bpe.digests(docs.limit(0), CODE_VOCABULARY, PATTERN).count() == 0
    counts = bpe.count_tokens(docs, CODE_VOCABULARY, PATTERN).orderBy("doc_id").collect()
    assert [r.n_tokens for r in counts] == [got[i].n_tokens for i in range(len(texts))]


def test_histogram_and_suffix_sums(spark):
    rng = random.Random(2)
    texts = [" ".join(["word"] * rng.choice([0, 1, 1, 3, 5, 9, 5000])) for _ in range(60)] + [None]
    lengths = sorted(len(ORACLE.encode_ordinary(t or "")) for t in texts)
    sums = token_counts.suffix_sums(token_counts.length_histogram(documents(spark, *texts), CODE_VOCABULARY, PATTERN)).cache()
    rows = sums.orderBy("length").collect()
    assert [r.length for r in rows] == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.length) and r.docs_longer == sum(x > r.length for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.length) and r.truncated_total == sum(min(x, r.length) for x in lengths)
        assert (r.total_docs, r.total_tokens, r.docs_up_to) == (len(lengths), sum(lengths), sum(x <= r.length for x in lengths))
    limits = [0, 1, 2, 4, 8, 4999, 10**6]
    got = {r.context_limit: (r.docs_longer, r.truncated_total) for r in token_counts.at_limits(sums, limits).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    qs = {r.share: r.length for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert all(qs[q] == min(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths)) for q in qs)
    empty = token_counts.suffix_sums(token_counts.length_histogram(documents(spark, "x").limit(0), CODE_VOCABULARY, PATTERN))
    assert empty.count() == 0 and token_counts.at_limits(empty, [5]).first().truncated_total == 0


def test_counts_of_odd_tables(spark):
    """Repeated rows count each, and a column with the operator's own name does no harm."""
    docs = documents(spark, "one two three", "one two three", None, "").withColumnRenamed("lang", "length").withColumnRenamed("source", "n_docs")
    got = {r.length: r.n_docs for r in token_counts.length_histogram(docs.unionByName(docs), CODE_VOCABULARY, PATTERN).collect()}
    assert got == {0: 4, len(ids("one two three")): 4}
