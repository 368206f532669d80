"""Quality rules on documents and, with an empirical beta prior, on their hosts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, same, spare

#: Rules on one document: name and condition for failing.
BASE_RULES = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words"}
#: Rules beside the base: over one symbol in ten words; three or more repeated lines that are over 30 % of
#: all; words of under 3 or over 40 characters on average.
OWN_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "lengths": "n_words >= 10 and (word_chars < 3 * n_words or word_chars > 40 * n_words)",
}
RULES = BASE_RULES | OWN_RULES
_SPACE, _SYMBOLS, _WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of a
    whole text; null: none."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # on bytes, split knows ASCII white space only
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(_WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + _WINDOW] = b"\1" * _WINDOW
        repeated = sum(covered)
    return n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with long columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and booleans
    failed_<rule> and base_failed. Columns of these names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=names, dtype="int64")

    m = spare(docs, "_measures")
    got = docs.withColumn(m, of(F.col(text)))
    got = got.withColumns({n: F.col(f"{m}.{n}") for n in names}).drop(m)
    got = got.withColumns({f"failed_{r}": F.expr(c) for r, c in RULES.items()})
    return got.withColumn("base_failed", F.expr(" or ".join(f"failed_{r}" for r in BASE_RULES)))


def host_rates(features: DataFrame, host: str = "source", times: float = 2.0, sure: float = 3.0) -> DataFrame:
    """One row for each host: host, n_docs, n_base_failed, for each rule n_<rule> (documents that fail it)
    and rate_<rule>, host_rules (the rules that the host fails) and host_failed.

    A rule's rates are shrunk by a beta prior that the hosts themselves give by the method of moments:
    the mean is the share of failures over all documents, the spread is the variance of the hosts' rates
    beyond what chance gives hosts of their sizes. rate_<rule> is the posterior mean. A host fails a
    rule if its rate, less `sure` posterior standard deviations, is over `times` the mean: a small host
    is not judged by a few bad documents. Documents with a null host are on no host and have no row.
    Counts are combined before the shuffle, so a host with a third of all rows is one row from each
    task; the driver gets three sums a rule.
    """
    h = features.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    h = cut(h.agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_base_failed"), *(F.count_if(f"failed_{r}").alias(f"n_{r}") for r in RULES)))
    rate = {r: F.col(f"n_{r}") / F.col("n_docs") for r in RULES}
    sums = [f.alias(f"{n}_{r}") for r in RULES for n, f in (("k", F.sum(f"n_{r}")), ("a", F.avg(rate[r])), ("q", F.avg(rate[r] * rate[r])))]
    s = h.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(1 / F.col("n_docs")).alias("inverse"), *sums).first()
    failed = []
    for r in RULES:
        mean, strength = 0.5, 2.0
        if s.hosts:
            mean = s[f"k_{r}"] / s.docs
            spread = s[f"q_{r}"] - 2 * mean * s[f"a_{r}"] + mean * mean
            chance = mean * (1 - mean)
            between = max(spread - chance * s.inverse / s.hosts, 1e-9)
            strength = min(max(chance / between - 1, 1.0), 1e6) if chance else 1.0
        total = F.col("n_docs") + strength
        post = (F.col(f"n_{r}") + mean * strength) / total
        h = h.withColumn(f"rate_{r}", post)
        failed.append(F.when(post - sure * F.sqrt(post * (1 - post) / (total + 1)) > times * mean, r))
    h = h.withColumn("host_rules", F.array_compact(F.array(*failed)))
    return h.withColumn("host_failed", F.size("host_rules") > 0)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """(id_col, features, failed_<rule>, base_failed, host_docs, host_base_failed, host_rules,
    host_failed, kept) for each row.

    kept: the document passes all rules on documents and its host, if it has one, does not fail any by
    the rate of its documents. Null texts have no words and fail as short; repeated rows are judged
    each; columns of docs other than the three named are not read.
    """
    f = cut(document_features(docs.select(id_col, F.col(text).alias("_text"), F.col(host).alias("_host")), "_text").drop("_text"))
    rates = host_rates(f, "_host", **limits).select("host", F.col("n_docs").alias("host_docs"), F.col("n_base_failed").alias("host_base_failed"), "host_rules", "host_failed")
    got = f.join(rates, same(F.col("_host"), F.col("host")), "left").drop("host")
    passed = ~F.greatest(*(F.col(f"failed_{r}") for r in RULES))
    return got.withColumn("kept", passed & ~F.coalesce("host_failed", F.lit(False))).drop("_host")
