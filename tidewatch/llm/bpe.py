"""Byte-level BPE with a segment tree over pair ranks: encoding, decoding and counting."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Recent

#: A vocabulary file is read on the driver and broadcast; it may have this many bytes at most.
MOST_VOCABULARY_BYTES = 64 << 20
#: Words that a worker remembers: this many and up to as many from before. Results don't depend on it.
_REMEMBERED = 250_000
#: Rows whose results are put together at once.
_ROWS = 1000


#: Patterns of which no piece holds a space except as its first character, or in a run of white space.
#: A text may then be cut before every lone space, and words be looked up as they stand.
SPACE_LED = (public_tokenizers.PATTERN,)
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)").split
_OTHER_SPACE = re.compile(r"\s | \s|^ | $").search


class Codec:
    """Encodes and decodes by one vocabulary. ranks: token bytes to id; a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces, self.space_led = regex.compile(pattern).findall, pattern in SPACE_LED
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.of_byte = [ranks.get(bytes([x]), -1) for x in range(256)]
        #: Two neighbours' ids, packed, to the id that they merge to.
        self.pairs: dict[int, int] = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                    self.pairs[left << 24 | right] = i
        self.packed = Recent(self._pack, _REMEMBERED // 2).__getitem__
        self.word = Recent(lambda word: b"".join(map(self.packed, self.pieces(" " + word))), _REMEMBERED).__getitem__

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. A leaf of the tree stands for the pair that starts at a byte and holds
        its rank and, below it, the position; every node is the least of its 16 children, so the root
        is the leftmost pair of the lowest rank. A merge sets three leaves and the nodes above them."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, pair = len(piece), self.pairs.get
        ids = [self.of_byte[x] for x in piece]
        shift = n.bit_length()
        place, none = (1 << shift) - 1, 1 << shift + 26
        leaves = [none if (r := pair(x << 24 | y)) is None else r << shift | i for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False))]
        levels = [leaves]
        while len(levels[-1]) > 16:
            low = levels[-1]
            levels.append([min(low[k : k + 16]) for k in range(0, len(low), 16)])
        top, above = levels[-1], levels[1:]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours
        leaves.append(none)  # of the last byte, which starts no pair
        while (best := min(top)) < none:
            i = best & place
            gone, ids[i] = after[i], best >> shift
            after[i] = next_ = after[gone]
            leaves[gone] = leaves[i] = none
            if next_ < n:
                before[next_] = i
                if (r := pair(ids[i] << 24 | ids[next_])) is not None:
                    leaves[i] = r << shift | i
            if (p := before[i]) >= 0:
                leaves[p] = none if (r := pair(ids[p] << 24 | ids[i])) is None else r << shift | p
            if above:
                low, nodes = leaves, {gone >> 4, i >> 4, max(p, 0) >> 4}
                for level in above:
                    for k in nodes:
                        if k < len(level):
                            level[k] = min(low[16 * k : 16 * k + 16])
                    low, nodes = level, {k >> 4 for k in nodes}
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _pack(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        if not text:
            return b""
        if not self.space_led:
            return b"".join(map(self.packed, self.pieces(text)))
        # what follows a lone space is a word
        first, *words = _LONE_SPACE(text) if _OTHER_SPACE(text) else text.split(" ")
        return b"".join(map(self.packed, self.pieces(first))) + b"".join(map(self.word, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def read_vocabulary(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary may have {MOST_VOCABULARY_BYTES}")
    with open(path, "rb") as f:
        return f.read()


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(i) for token, i in (line.split() for line in data.splitlines() if line.strip())}


class CodecOnWorkers:
    """A codec for tasks: the vocabulary travels as a broadcast and is parsed once in each worker."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        data = read_vocabulary(path)
        self.key = hashlib.sha256(data + pattern.encode()).hexdigest()
        self.pattern, self.data = pattern, spark.sparkContext.broadcast(data)

    def get(self) -> Codec:
        if self.key not in _codecs:
            _codecs[self.key] = Codec(parse_vocabulary(self.data.value), self.pattern)
        return _codecs[self.key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a binary column of token ids, 4 little-endian bytes each.

    pattern cuts a text into pieces that are merged separately. Null and empty texts have no ids, a
    piece of any length takes n log n steps, equal rows get equal ids, and an existing column called
    `out` is replaced. Rows don't depend on each other, so nothing is shuffled.
    """
    codec = CodecOnWorkers(docs.sparkSession, vocabulary, pattern)

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec.get()
        for texts in batches:
            yield pd.Series([one.encode(t) for t in texts], dtype=object)

    return docs.withColumn(out, of(F.col(text)))


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes that a column of ids stands for; null ids give none."""
    codec = CodecOnWorkers(docs.sparkSession, vocabulary, pattern)

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec.get()
        for values in batches:
            yield pd.Series([one.decode(v or b"") for v in values], dtype=object)

    return docs.withColumn(out, of(F.col(ids)))


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a long column of the number of tokens of each text; null: 0."""
    codec = CodecOnWorkers(docs.sparkSession, vocabulary, pattern)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec.get()
        for texts in batches:
            yield pd.Series([len(one.encode(t)) // 4 for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each text encoded, and its ids decoded again, in one pass: (id_col, n_tokens, ids_sha256,
    decoded_sha256), and with `with_ids` the binary column ids. Rows are mapped in batches, so no row
    waits beside Python for its result."""
    codec = CodecOnWorkers(docs.sparkSession, vocabulary, pattern)
    own = docs.schema[id_col]
    schema = T.StructType([own, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    schema = schema.add("ids", T.BinaryType()) if with_ids else schema

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec.get()
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                rows = []
                for t in batch.column(1):
                    ids = one.encode(t.as_py())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(one.decode(ids)).hexdigest(), ids if with_ids else None))
                n, coded, decoded, every = map(list, zip(*rows, strict=True))
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(every, pa.binary())] if with_ids else columns, schema.names)

    return docs.select(id_col, text).mapInArrow(both, schema)
