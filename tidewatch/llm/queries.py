"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, decontamination, embedding_dedup, filter_audit, line_dedup, merkle, mixing, quality_classifier, quality_rules, simhash_dedup, token_counts, url_filter

COUNT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CODE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

URL_RULES = [
    url_filter.prefix_rule("com", "/", "allow"),
    url_filter.prefix_rule("example.com", "/en/", "block"),
    url_filter.prefix_rule("www.example.com", "/en/", "allow"),
    url_filter.prefix_rule("net", "/es/", "block"),
    url_filter.prefix_rule("net", "/fr/", "block"),
]
PROBE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents"), COUNT_VOCABULARY, PATTERN))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", *(f"failed_{r}" for r in quality_rules.OWN_RULES), "host_docs", "host_base_failed", "host_failed")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), CODE_VOCABULARY, PATTERN)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.ratings(table(spark, sf_dir, "labels")), 3)
    return quality_classifier.grade_documents(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_probability", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return got.select("page_id", "host", "path", "rule", "verdict")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    got = mixing.plan_mix(docs, mixing.cycle_weights(docs))
    return got.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    got = chat.format_trees(chat.chain(turns.unionByName(probe)))
    got = got.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = merkle.manifest(docs, merkle.without_line_ends())
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_quality_rules, op3_byte_bpe, op4_quality_classifier, op5_line_dedup, op6_url_filters, op7_embedding_dedup, op8_simhash_dedup, op9_mixing, op10_chat_formatting, op11_filter_audit, op12_decontamination, op13_merkle_manifest)
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as w, row_number() over () as r from documents),
f as (select r, doc_id, source, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols from d),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
dup as (select r, count(*) as n_lines, (count(*) - count(distinct line))::bigint as n_dup_lines from l
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
g as (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5),
win as (select r, i, array_to_string(w[i:i+4], ' ') as s from g),
twice as (select r, i from (select r, i, count(*) over (partition by r, s) as c from win) where c > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from twice, range(0, 5) as t(k) group by r),
m as (select f.*, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from f left join dup using (r) left join rep using (r)),
b as (select *, {', '.join(f"({c}) as failed_{n}" for n, c in quality_rules.RULES.items())} from m),
c as (select doc_id, source, rule, failed from b unpivot (failed for rule in ({', '.join(f'failed_{n}' for n in quality_rules.RULES)}))),
h as (select source, rule, count(*) as n, count(*) filter (failed) as k from c where source is not null group by all),
p as (select rule, sum(k) / sum(n) as mean, count(*) as hosts, sum(1 / n) as inverse from h group by rule),
v as (select rule, mean, greatest(avg((k / n - mean) * (k / n - mean)) - mean * (1 - mean) * any_value(inverse / hosts), 1e-9) as between_hosts from h join p using (rule) group by rule, mean),
s as (select rule, mean, case when mean * (1 - mean) = 0 then 1.0 else least(greatest(mean * (1 - mean) / between_hosts - 1, 1.0), 1e6) end as strength from v),
q as (select source, mean, n + strength as total, (k + mean * strength) / (n + strength) as post from h join s using (rule)),
j as (select source, bool_or(post - 3 * sqrt(post * (1 - post) / (total + 1)) > 2 * mean) as host_failed from q group by source),
t as (select source, count(*) as n, count(*) filter ({' or '.join(f'failed_{n}' for n in quality_rules.BASE_RULES)}) as k from b where source is not null group by source)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, ({' or '.join(f'failed_{n}' for n in quality_rules.BASE_RULES)}) as base_failed,
    {', '.join(f'failed_{n}' for n in quality_rules.OWN_RULES)}, not ({' or '.join(f'failed_{n}' for n in quality_rules.RULES)}) and not coalesce(host_failed, false) as kept, n as host_docs, k as host_base_failed, host_failed
from b left join j using (source) left join t using (source)
"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The canonical URL as SQL can say it: without undoing percent forms and dot segments.
_CANONICAL = rf"""'.' || regexp_replace(regexp_replace({_HOST}, '(?s)^.*@', ''), ':[0-9]*$', '') || regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda x: not regexp_matches(x, '^(utm_[^=&]*|ref|gclid|fbclid)(=|$)')), '&'), ''), '')"""

OP6_SQL = rf"""
with u as (select page_id, {_CANONICAL} as c, {_HOST} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict from u, r
    where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select u.page_id, host, path, rule, coalesce(verdict, case when regexp_matches(c, '^[^/]*\.(spam|casino|cheap)-[^/]*\.')
    or ends_with(c, '.exe') or contains(c, '/wp-admin/') or regexp_matches(c, '[?&](page|sort|sessionid|replytocom)=') then 'block' else 'allow' end) as verdict
from u left join f on u.page_id = f.page_id
"""

OP7_SQL = """
with recursive e as (select distinct vec_id, embedding::double[] as v from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    and list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a),
n as (select a, count(distinct b) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on vec_id = c.a left join n on vec_id = n.a
"""

OP9_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, 3.0::double * source_size as cap from s),
o as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(cap) over before, 0) as cap_before, coalesce(sum(weight) over before, 0) as weight_before
    from w window before as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
t as (select min_by(total - cap_before, cap / weight) as share, min_by(weights - weight_before, cap / weight) as weight_left
    from o where cap / weight > (total - cap_before) / (weights - weight_before)),
g as (select o.source, source_size, coalesce(least(cap, t.share::double * weight / t.weight_left::double), cap)::double as target from o, t),
r as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double as u
    from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from r
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP10_SQL = f"""
with c as (select conv_id, turn, role, text from conversations union all
    select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
n as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k,
    coalesce(role, '') as role, coalesce(text, '') as text from c),
l as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by k) as turns,
    coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '') as loss,
    sum({len(chat.START + chat.SAYS + chat.END)} + length({_escaped('role')}) + length({_escaped('text')}))::bigint as formatted_chars from n group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from l
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {_WORDS} as w from documents),
f as (select text, min(doc_id) as first from d group by text),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, good, toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask
    from d join f using (text) left join l using (doc_id)),
c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, mask),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) as own,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k::int, 1)) - 65))), 0)::bigint as earlier
    from o, (select unnest(range(1, 6))::int as step)),
r as (select part, filter_order, step, own,
    coalesce(sum(n) filter (mask & own = 0 and mask & earlier = 0), 0) as kept, coalesce(sum(n) filter (mask & own <> 0 and mask & earlier = 0), 0) as removed,
    coalesce(sum(n) filter (mask & own <> 0 and mask & earlier <> 0), 0) as redundant, coalesce(sum(n) filter (mask = own), 0) as unique_fails,
    coalesce(sum(good) filter (mask & own <> 0 and mask & earlier = 0), 0) as good_lost, coalesce(sum(toxic) filter (mask & own <> 0 and mask & earlier = 0), 0) as toxic_lost
    from c, s group by part, filter_order, step, own)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""

OP12_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as pos from b where len(w) > 0),
v as (select distinct item_id, k, array_to_string(w[pos:pos + k - 1], ' ') as said from i),
p as (select r, w, k, unnest(range(1, len(w) - k + 2)) as pos from d, (select distinct k from v) where len(w) >= k),
h as (select r, pos, k, item_id from (select r, pos, k, array_to_string(w[pos:pos + k - 1], ' ') as said from p) join v using (k, said)),
n as (select r, count(distinct pos + j) as n_hit from (select r, pos, unnest(range(0, k)) as j from h) group by r),
t as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n using (r) left join t using (r)
"""


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}, '-')" for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""

OP13_SQL = f"""
with recursive c as (select *, case when doc_id is not null and {_CRC} & 1 = 0 then replace(text, chr(10), '') else text end as later from documents),
e as (select row_number() over () as r, doc_id, source, {_leaf('text')} as leaf, {_leaf('later')} as found from c),
l as (select *, dense_rank() over (order by source nulls first) - 1 as t, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from e),
up(t, lv, i, d) as (select t, 0::bigint, i, leaf from l
    union all select t, lv + 1, i // 3, sha256(string_agg(d, '' order by i)) from (select *, count(*) over (partition by t) as c from up) where c > 1 group by t, lv, i // 3),
s as (select t, arg_max(d, lv) as subroot from up group by t),
top(lv, i, d) as (select 0::bigint, t, subroot from s
    union all select lv + 1, i // 3, sha256(string_agg(d, '' order by i)) from (select *, count(*) over () as c from top) where c > 1 group by lv, i // 3),
z as (select arg_max(d, lv) as root from top),
m as (select r, up.lv, up.i, up.i = l.i // (3 ** up.lv)::bigint as own, d from l join up on up.t = l.t and up.i // 3 = l.i // (3 ** (up.lv + 1))::bigint
    where (select max(lv) from up u where u.t = l.t) > up.lv
    union all select r, 1000 + top.lv, top.i, top.i = l.t // (3 ** top.lv)::bigint, d from l join top on top.i // 3 = l.t // (3 ** (top.lv + 1))::bigint
    where (select max(lv) from top) > top.lv),
g as (select *, dense_rank() over (partition by r order by lv) as k from m),
p as (select r, string_agg(d, '' order by lv, i) filter (not own) as proof from m group by r),
fold(r, k, d) as (select r, 1::bigint, found from e
    union all select fold.r, fold.k + 1, sha256(string_agg(case when own then fold.d else g.d end, '' order by i)) from fold join g on g.r = fold.r and g.k = fold.k group by fold.r, fold.k),
w as (select r, arg_max(d, k) as folded_root from fold group by r)
select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = root as verified
from l join s using (t) cross join z left join p using (r) join w using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op6_url_filters": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op10_chat_formatting": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
