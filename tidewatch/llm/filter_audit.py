"""Filter interaction audit: what each filter removes at each place of every order of the filters, from one
wide counter for each set of failed filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, few

#: The filters, one letter each; bit i of a mask stands for the i-th.
FILTERS = "ABCDE"
#: Bits of a field. No sum of fields is over the number of rows, and that is below 2^63.
FIELD = 64
_UPPER, _ODD = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: bytes, chars: int) -> int:
    """Bits 0 to 3 for the filters that a text of so many code points fails by itself. A: under 50 words;
    B: under 65 % distinct words; C: over 5 % of A-Z; D: holds one of #$%&*|."""
    words = text.split()  # on bytes, split knows ASCII white space only
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    odd = len(text) > len(text.translate(None, _ODD))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * upper > 5 * chars) << 2 | odd << 3


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) for each row of docs: the id as a long, the part as a string (null: empty) and the set of
    filters that it fails, E (the whole text is that of a row with a smaller id) as bit 4.

    Null texts are empty ones. A null id is neither smaller than another nor has it smaller ones; rows
    with one id and text fail E together or not at all. Texts are compared by SHA-256. The first id of a text
    is combined before the shuffle, and joined back to a written table of narrow rows, so that many
    copies of one text are no hot task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for t in batch.column("text"):
                s = t.as_py()
                raw = s.encode()
                masks.append(text_mask(raw, len(s)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    rows = cut(rows.mapInArrow(measured, "id long, part string, mask int, digest binary"))
    copies = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    got = rows.join(few(copies.select("digest", "first")), "digest", "left")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return got.select("id", "part", F.col("mask").bitwiseOR(F.shiftleft(again, 4)).alias("mask"))


def wide_counters(filters: str = FILTERS) -> list[int]:
    """For each mask an integer with a field for each step of each order of the filters (120 orders of 5
    steps: 600 fields), the first order's first step lowest. A field is 1 if a document with this mask is
    removed at that step: it fails the step's filter and none before it."""
    n = len(filters)
    out = [0] * (1 << n)
    for o, order in enumerate(permutations(range(n))):
        before = accumulate((1 << f for f in order), initial=0)
        for step, (f, earlier) in enumerate(zip(order, before, strict=False)):
            for mask in range(1 << n):
                if mask >> f & 1 and not mask & earlier:
                    out[mask] |= 1 << FIELD * (o * n + step)
    return out


def unpack(total: int, filters: str = FILTERS) -> np.ndarray:
    """The fields of a sum of counters, [order, step]."""
    n, orders = len(filters), len(list(permutations(filters)))
    return np.frombuffer(total.to_bytes(orders * n * FIELD // 8, "little"), "<u8").astype(np.int64).reshape(orders, n)


def interactions(rows: DataFrame, filters: str = FILTERS, flags: tuple[str, ...] = ()) -> DataFrame:
    """Of rows(part, mask, boolean flags), one row for each part, order of the filters and step: part,
    filter_order, step (from 1), kept (documents that are left after it), removed (by it), redundant (failing
    its filter, removed earlier), unique_fails (failing its filter only), <flag>_lost (removed by it, with the
    flag; null flags are false) and shapley (what its filter removes, summed over all orders).

    A mask's rows are counted before the shuffle: a part, however many rows it has, comes to one task
    as one row for each mask. There each mask's integer is taken as often as it has rows and the
    integers are summed. What a step leaves over follows from the fields: a filter that comes first removes
    all that fail it, one that comes last all that fail nothing else. No rows give no parts.
    """
    n, counters = len(filters), wide_counters(filters)
    orders = list(permutations(range(n)))
    names = ["".join(filters[f] for f in order) for order in orders]
    of = np.array(orders)  # the filter of each step
    first = np.array([next(o for o, order in enumerate(orders) if order[0] == f) for f in range(n)])
    last = np.array([next(o for o, order in enumerate(orders) if order[-1] == f) for f in range(n)])
    longs = ["kept", "removed", "redundant", "unique_fails", *(f"{f}_lost" for f in flags), "shapley"]
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags))

    def audited(masks: pa.Table) -> pa.Table:
        mask = masks.column("mask").to_pylist()
        sums = [unpack(sum(k * counters[m] for k, m in zip(masks.column(c).to_pylist(), mask, strict=True)), filters) for c in ("n", *flags)]
        removed = sums[0]
        fails, alone = removed[first, 0], removed[last, n - 1]
        shapley = np.array([removed[of == f].sum() for f in range(n)])
        kept = sum(masks.column("n").to_pylist()) - removed.cumsum(axis=1)
        columns = [kept, removed, fails[of] - removed, alone[of], *sums[1:], shapley[of]]
        size = len(orders) * n
        head = [pa.repeat(masks.column("part")[0], size), pa.array(np.repeat(names, n).tolist()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))]
        return pa.table([*head, *(pa.array(c.ravel().astype(np.int64)) for c in columns)], names=["part", "filter_order", "step", *longs])

    return counted.groupBy("part").applyInArrow(audited, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in longs)}")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """interactions() of the five filters on docs, with good_lost (quality = 1 in labels) and toxic_lost
    (toxic = 1). An id that labels has several times is good or toxic if one of its rows says so; one that it
    does not have, and a null one, is neither. Other columns of docs and labels are not read."""
    said = labels.select(F.col(id_col).cast("long").alias("id"), F.expr("coalesce(quality = 1, false)").alias("good"), F.expr("coalesce(toxic = 1, false)").alias("toxic"))
    said = said.where("id is not null and (good or toxic)").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    return interactions(failed_filters(docs, id_col, text, part).join(said, "id", "left"), flags=("good", "toxic"))
