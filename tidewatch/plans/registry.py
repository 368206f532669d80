"""All queries of the security-log part by name, with DuckDB SQL for checking them. The SQL never
parses: it starts from the columns that the records were rendered from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import bursts, corpus, facts, normalize, privacy, reports, retrieval, scoring
from tidewatch.plans import incidents, render
from tidewatch.sources import scratch

YEAR = 2024
DAY = 86400
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from tidewatch.plans import file_queries  # noqa: F401 - it registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tidewatch.plans import file_queries  # noqa: F401

    return dict(_SQL)


_E = "select event_id, date_trunc('second', ts)::timestamp as ts, user_id, event_type, '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) as ip, (1024 + event_id % 60000)::int as port, 'user' || user_id as name from events"
_SHOWN = ("line_no", "ts", "source_ip", "user", "event_type", "port", "is_parsed")


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_SHOWN, *more).withColumn("ts", F.unix_seconds("ts"))


_SSH = f"""select *, 'log' || (user_id % 10) as source_id, event_type <> 'signup' as ok,
    case event_type when 'error' then 'failed_login' when 'click' then 'successful_login' when 'view' then 'disconnected' when 'purchase' then 'invalid_user' else 'unparsed_sshd' end as kind
    from ({_E})"""


def _ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_ssh(render.ssh_lines(spark, sf_dir), YEAR)


@query(f"""select event_id as line_no, epoch(ts)::bigint as ts, case when ok then ip end as source_ip, case when ok then name end as "user", kind as event_type,
    case when ok then port end as port, ok as is_parsed, source_id, false as ts_assumed,
    case event_type when 'error' then 'password' when 'click' then 'publickey' end as auth_method from ({_SSH})""")
def ssh_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ssh(spark, sf_dir), "source_id", "ts_assumed", "auth_method")


@query(f"""select event_id as line_no, epoch(ts)::bigint as ts, ip as source_ip, name as "user", case event_type when 'error' then 'failed_login' when 'click' then 'successful_login' else 'windows_event_4634' end as event_type,
    port, true as is_parsed from ({_E})""")
def windows_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalize.normalize(render.windows_lines(spark, sf_dir), "evtx"))


_ATTACK = "case event_id % 7 when 1 then 'sqli_attempt' when 2 then 'xss_attempt' when 3 then 'path_traversal' when 5 then 'sqli_attempt' when 6 then 'xss_attempt' end"


@query(f"""select event_id as line_no, epoch(ts)::bigint as ts, ip as source_ip, name as "user",
    coalesce({_ATTACK}, case event_type when 'error' then 'forbidden_access' when 'signup' then 'server_error' else 'successful_request' end) as event_type, null::int as port, true as is_parsed from ({_E})""")
def nginx_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalize.normalize(render.nginx_lines(spark, sf_dir), "web"))


@query(f"""select event_id as line_no, epoch(ts)::bigint as ts, ip as source_ip, name as "user",
    case event_type when 'error' then 'failed_login' when 'click' then 'successful_login' when 'purchase' then 'failed_aws_describeinstances' else 'aws_describeinstances' end as event_type, null::int as port, true as is_parsed from ({_E})""")
def cloudtrail_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalize.normalize(render.cloudtrail_lines(spark, sf_dir), "aws"))


@query(f"""select 'ssh' as kind, event_type, count(*) as n from (select kind as event_type from ({_SSH})) group by 2 union all
    select 'nginx', coalesce({_ATTACK}, case event_type when 'error' then 'forbidden_access' when 'signup' then 'server_error' else 'successful_request' end), count(*) from events group by 2""")
def mixed_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ssh = render.ssh_lines(spark, sf_dir).withColumn("log_type", F.lit("sshd")).withColumn("source_id", F.lit("ssh"))
    web = render.nginx_lines(spark, sf_dir).withColumn("log_type", F.lit("waf")).withColumn("source_id", F.lit("nginx"))
    both = normalize.normalize_mixed(ssh.unionByName(web), year=YEAR)
    return both.groupBy(F.col("source_id").alias("kind"), "event_type").agg(F.count("*").alias("n"))


@query(f"""select count(*) as n, coalesce({_ATTACK}, 'none') as attack from events group by 2""")
def web_attack_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = normalize.normalize_nginx(render.nginx_lines(spark, sf_dir))
    attack = F.when(F.col("event_type").isin("sqli_attempt", "xss_attempt", "path_traversal"), F.col("event_type")).otherwise("none")
    return e.groupBy(attack.alias("attack")).agg(F.count("*").alias("n"))


_IPS = f"""select source_id, ip, count(*) filter (kind in ('failed_login', 'invalid_user')) as failed_attempts, count(*) filter (kind = 'successful_login') as successful_attempts,
    epoch(min(ts))::bigint as first_seen, epoch(max(ts))::bigint as last_seen, list_sort(list(distinct name)) as users, min(event_id) as first_line from ({_SSH}) where ok group by 1, 2"""


@query(f"select source_id, ip, failed_attempts, successful_attempts, first_seen, last_seen, array_to_string(users, ',') as users_attempted, first_line, len(users) as n_users from ({_IPS})")
def ssh_ip_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.ip_facts(_ssh(spark, sf_dir))
    return f.withColumns({"first_seen": F.unix_seconds("first_seen"), "last_seen": F.unix_seconds("last_seen"), "users_attempted": F.array_join("users_attempted", ",")})


@query(f"""select source_id, count(*) as total_lines, count(*) filter (not ok) as unparsed_lines, epoch(min(ts))::bigint as start_time, epoch(max(ts))::bigint as end_time,
    '{facts.YEAR_LIMITATION.replace("'", "''")}' || case when count(*) filter (not ok) > 0 then '|' || (count(*) filter (not ok)) || ' line(s) could not be parsed.' else '' end as limitations from ({_SSH}) group by 1""")
def log_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.log_facts(_ssh(spark, sf_dir))
    return f.withColumns({"start_time": F.unix_seconds("start_time"), "end_time": F.unix_seconds("end_time"), "limitations": F.array_join("limitations", "|")})


@query(f"""select source_id, 'evidence log preservation incident triage' as tail, sum(failed_attempts)::bigint as total_failures, bool_or(failed_attempts > 0 and successful_attempts > 0) as success_after_failure,
    bool_or(len(users) > 1) as multiple_accounts, false as privileged from ({_IPS}) group by 1""")
def concept_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.concept_flags(facts.ip_facts(_ssh(spark, sf_dir))).withColumn("tail", F.lit("evidence log preservation incident triage"))


@query(f"""select source_id, array_to_string(list_sort(list_concat(['incident triage', 'evidence log preservation'],
    case when sum(failed_attempts) > 0 then ['SSH authentication failures'] else [] end, case when sum(failed_attempts) >= 5 then ['repeated password attempts'] else [] end,
    case when bool_or(len(users) > 1) then ['credential-access investigation', 'invalid-user login', 'brute force'] else [] end,
    case when bool_or(failed_attempts > 0 and successful_attempts > 0) then ['successful login after failures'] else [] end)), ' ') as query from ({_IPS}) group by 1""")
def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ssh(spark, sf_dir)
    return facts.retrieval_query(facts.log_facts(e), facts.concept_flags(facts.ip_facts(e)))


@query(f"""with n as (select source_id, ip, count(*) as n from ({_SSH}) where ok group by 1, 2),
    t as (select source_id, count(*) as unique_sources, arg_min(ip, (-n, ip)) as most_active_source, max(n) as most_active_events from n group by 1),
    r as (select source_id, array_to_string(list_sort(list(distinct name) filter (ok)), ',') as targeted_users, 0::bigint as privileged_attempts, count(*) filter (kind = 'invalid_user') as invalid_user_attempts,
        array_to_string(list_sort(list(distinct case event_type when 'error' then 'password' when 'click' then 'publickey' end) filter (event_type in ('error', 'click'))), ',') as auth_methods, (epoch(max(ts)) - epoch(min(ts)))::bigint as duration_seconds from ({_SSH}) group by 1)
    select * from r join t using (source_id)""")
def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts.activity_summary(_ssh(spark, sf_dir))
    return s.withColumns({"targeted_users": F.array_join("targeted_users", ","), "auth_methods": F.array_join("auth_methods", ",")})


_F = "select event_id as line_no, ts, user_id, epoch_us(ts) as us from events where event_type = 'error'"


@query(f"""select line_no, count(*) over w as n_recent, count(*) over w >= 3 as is_burst from ({_F})
    window w as (partition by user_id order by us range between {DAY * 1_000_000} preceding and current row)""")
def burst_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.burst_flags(render.failures(spark, sf_dir), ("source_ip",), 3, DAY).select("line_no", "n_recent", "is_burst")


@query(f"""with recursive f as (select *, row_number() over (partition by user_id order by us, line_no) as r from ({_F})),
    s(user_id, r, live, hit) as (select user_id, 0::bigint, []::struct(us bigint, n bigint)[], false from (select distinct user_id from f) union all
        select f.user_id, f.r, list_append(list_filter(case when s.hit then [] else s.live end, lambda x: x.us >= f.us - {DAY * 2 * 1_000_000}), {{'us': f.us, 'n': f.line_no}}),
            len(list_filter(case when s.hit then [] else s.live end, lambda x: x.us >= f.us - {DAY * 2 * 1_000_000})) + 1 >= 3 from s join f on f.user_id = s.user_id and f.r = s.r + 1)
    select 'user' || user_id as "user", live[-1].us as breach_us, len(live) as n_events, array_to_string(list_transform(live, lambda x: x.n), ',') as lines from s where hit""")
def burst_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bursts.burst_incidents(render.failures(spark, sf_dir), ("user",), 3, 2 * DAY)
    return got.select("user", F.unix_micros("breach_ts").alias("breach_us"), "n_events", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query(f"""select line_no, n_recent from (select event_id as line_no, count(*) over (partition by user_id order by epoch(date_trunc('second', ts)) range between {DAY} preceding and current row) as n_recent
    from events where event_type = 'error') where n_recent >= 3""")
def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.repeated_failures(render.failures(spark, sf_dir), "source_ip", 3, DAY).select("line_no", "n_recent")


@query(f"""select line_no, n_failures from (select event_id as line_no, event_type, count(*) filter (event_type = 'error') over (partition by user_id order by epoch(date_trunc('second', ts)) range between {DAY} preceding and current row) as n_failures from events)
    where event_type = 'click' and n_failures >= 2""")
def success_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.success_after_failures(render.failures(spark, sf_dir), least=2, seconds=DAY).select("line_no", "n_failures")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("filename"), F.col("text").alias("content"), F.sha2("text", 256).alias("sha256"))


@query("select doc_id, row_number() over (partition by sha256(text) order by doc_id) = 1 as is_new from documents")
def doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, again = corpus.reject_duplicates(_documents(spark, sf_dir))
    return fresh.select("doc_id", F.lit(True).alias("is_new")).unionByName(again.select("doc_id", F.lit(False).alias("is_new")))


@query(r"""with d as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w, text from documents),
    p as (select doc_id, w, text, unnest(range(0, greatest(ceil((len(w) - 400) / 350.0)::bigint, 0) + 1)) as piece from d)
    select doc_id, piece::int as piece, case when len(w) <= 400 then len(w) else least(400, len(w) - piece * 350) end::int as n_words,
        sha256(case when len(w) <= 400 then text else array_to_string(w[piece * 350 + 1 : piece * 350 + 400], ' ') end) as piece_sha256 from p""")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.table(spark, sf_dir, "documents")
    p = d.select("doc_id", F.posexplode(corpus.overlap_pieces(F.col("text"))).alias("piece", "content"))
    return p.select("doc_id", "piece", F.size(corpus.word_list(F.col("content"))).alias("n_words"), F.sha2("content", 256).alias("piece_sha256"))


@query(r"""select doc_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: x <> ''), chr(10))) as clean_sha256 from documents""")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "documents").select("doc_id", F.sha2(corpus.clean_text(F.col("text")), 256).alias("clean_sha256"))


_HEADINGS = r"""with recursive d as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 10 = 0 then '# Part ' || (i - 1) || chr(10) || x else x end), chr(10)) as t from documents),
    r as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as n from d),
    m as (select *, nullif(coalesce(nullif(regexp_extract(line, '^#+\s+(.+)$', 1), ''), regexp_extract(line, '^---\s+(Page\s+\d+)\s+---$', 1)), '') as mark from r),
    l as (select *, count(mark) over (partition by doc_id order by n) as b, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) as words from m where mark is not null or trim(line) <> ''),
    k as (select doc_id, b, any_value(mark) as mark, sum(words) as words, string_agg(line, chr(10) order by n) as text, row_number() over (partition by doc_id order by b) as r from l group by doc_id, b),
    f(doc_id, r, section_no, words, name) as (select doc_id, r, 0, words, coalesce(mark, 'General') from k where r = 1 union all
        select k.doc_id, k.r, section_no + (full_)::int, case when full_ then k.words else f_words + k.words end, coalesce(k.mark, name)
        from (select k.*, f.section_no, f.words as f_words, f.name, f.words > 15 and k.mark is not null as full_ from f join k on k.doc_id = f.doc_id and k.r = f.r + 1) k),
    s as (select doc_id, section_no, arg_max(name, r) as section, string_agg(text, chr(10) order by r) as text from f join k using (doc_id, r) group by 1, 2),
    w as (select *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from s),
    p as (select *, unnest(range(0, greatest(ceil((len(w) - 400) / 350.0)::bigint, 0) + 1)) as piece from w where len(w) > 0),
    c as (select doc_id, section, section_no, piece, case when len(w) <= 400 then text else array_to_string(w[piece * 350 + 1 : piece * 350 + 400], ' ') end as content, case when len(w) <= 400 then len(w) else least(400, len(w) - piece * 350) end::int as word_count from p),
    i as (select *, (row_number() over (partition by doc_id order by section_no, piece) - 1)::int as chunk_index from c)
    select 'doc_' || doc_id || '_chk_' || chunk_index || '_' || sha256(content)[1:8] as chunk_id, 'doc_' || doc_id as document_id, section as section_or_page, word_count, chunk_index from i"""


@query(_HEADINGS)
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading put before each tenth line."""
    d = render.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 10 == 0, F.concat(F.lit("# Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    rows = d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("title").alias("source_title"), F.array_join(lines, "\n").alias("content"))
    return corpus.chunk_documents(rows).drop("source_title", "content")


@query("""select 'd' || doc_id as document_id, count(*) as n_chunks, sum(n)::bigint as n_words from (
    select doc_id, unnest(range(0, greatest(ceil((len(w) - 400) / 350.0)::bigint, 0) + 1)) as piece, case when len(w) <= 400 then len(w) else least(400, len(w) - piece * 350) end as n
    from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents)) where n > 0 group by 1""")
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("t").alias("source_title"), F.col("text").alias("content"))
    return corpus.document_sizes(corpus.chunk_documents(rows))


#: The tokens of {0}: words in any script, of which those stay that are a-z and 0-9 alone.
_TOK = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


def _search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TFIDF = rf"""dt as (select doc_id, term, n / max(n) over (partition by doc_id) as tf from (select doc_id, term, count(*) as n from (select doc_id, unnest({_TOK.format('text')}) as term from documents) group by 1, 2)),
    idf as (select term, ln((select count(*) from documents) / (1 + count(*))) + 1 as idf from dt group by 1),
    dw as (select doc_id, term, tf * idf as w from dt join idf using (term)),
    dn as (select doc_id, sqrt(sum(w * w)) as norm from dw group by 1),
    qt as (select item_id, term, n / max(n) over (partition by item_id) as tf from (select item_id, term, count(*) as n from (select item_id, unnest({_TOK.format('text')}) as term from benchmark) group by 1, 2)),
    qw as (select item_id, term, tf * idf as w from qt join idf using (term)),
    qn as (select item_id, sqrt(sum(w * w)) as norm from qw group by 1),
    sc as (select item_id, doc_id, round(sum(qw.w * dw.w) / any_value(qn.norm) / any_value(dn.norm), 6) as score from qw join dw using (term) join dn using (doc_id) join qn using (item_id) group by 1, 2),
    top as (select item_id as query_id, doc_id as chunk_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from sc where score >= 0.05)"""


@query(f"with {_TFIDF} select query_id, chunk_id, score, rank from top where rank <= 5")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tfidf_search(_search_docs(spark, sf_dir), _search_queries(spark, sf_dir), digits=6)


@query(f"""with recursive {_TFIDF},
    r as (select query_id, chunk_id, rank, 's' || (chunk_id % 3) as document_id, (200 + chunk_id % 500)::int as word_count from top where rank <= 8),
    f(query_id, rank, words, kept) as (select distinct query_id, 0, 0, []::varchar[] from r union all
        select r.query_id, r.rank, case when ok then words + word_count else words end, case when ok then list_append(kept, document_id) else kept end from (
            select f.words, f.kept, r.*, len(list_filter(f.kept, lambda x: x = r.document_id)) < 2 and f.words + r.word_count <= 1500 as ok from f join r on r.query_id = f.query_id and r.rank = f.rank + 1) r),
    k as (select r.*, f.words, g.words as before from r join f using (query_id, rank) join f g on g.query_id = r.query_id and g.rank = r.rank - 1)
    select query_id, rank, chunk_id::varchar as chunk_id, document_id, word_count from k where words > before""")
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.tfidf_search(_search_docs(spark, sf_dir), _search_queries(spark, sf_dir), k=8, digits=6)
    doc, words = F.concat(F.lit("s"), (F.col("chunk_id") % 3).cast("string")), (200 + F.col("chunk_id") % 500).cast("int")
    return retrieval.pack_context(top.select("query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), doc.alias("document_id"), words.alias("word_count")))


def _hashed(key: str, text: str, table: str) -> str:
    """SQL for (key, bucket, w): the hashed unit vectors of a column."""
    return rf"""select {key}, bucket, w / sqrt(sum(w * w) over (partition by {key})) as w from (select {key}, coalesce(('0x' || md5(f)[1:8])::bigint % 384, 0)::int as bucket, sum(x) / 5 as w from (
        select {key}, t as f, 5 as x from (select {key}, unnest(tok) as t from (select {key}, {_TOK.format(text)} as tok from {table})) union all
        select {key}, t[1:3], 4 from (select {key}, unnest(tok) as t from (select {key}, {_TOK.format(text)} as tok from {table})) where length(t) >= 4 union all
        select {key}, t[1:4], 3 from (select {key}, unnest(tok) as t from (select {key}, {_TOK.format(text)} as tok from {table})) where length(t) >= 4 union all
        select {key}, null, 5 from {table} where len({_TOK.format(text)}) = 0) group by 1, 2)"""


@query(f"select doc_id, bucket, round(w, 6) as w from ({_hashed('doc_id', 'text', 'documents')})")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.hashed_features(_search_docs(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id"), "doc_id", "content")
    return got.withColumn("w", F.round("w", 6))


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0),
    s as (select q.vec_id as query_id, e.vec_id as chunk_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 5) as score from embeddings e, q)
    select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s) where rank <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = render.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return retrieval.vector_search(v, q, digits=5)


SEMANTIC = f"""with d as (select doc_id, bucket, w::float::double as w from ({_hashed('doc_id', "source || ' ' || lang || chr(10) || text", 'documents')})),
    q as (select item_id, bucket, w::float::double as w from ({_hashed('item_id', 'text', 'benchmark')})),
    s as (select item_id as query_id, 'c' || doc_id as chunk_id, round(sum(d.w * q.w), 4) as score from d join q using (bucket) group by 1, 2)
    select * from (select query_id, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank, chunk_id, score from s) where rank <= 5"""


@query(SEMANTIC)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("source_title"), F.col("lang").alias("section_or_page"), F.col("text").alias("content"))
    q = render.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.semantic_search(d, q, digits=4).select("query_id", "rank", "chunk_id", "score")


@query(f"""with {_TFIDF}, r as (select query_id, rank, chunk_id, chunk_id % 3 as document_id from top where rank <= 5),
    w as (select b.item_id as query_id, d.doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text)),
    h as (select query_id, count(w.chunk_id) as h, min(case when w.chunk_id is not null then rank end) as first, count(distinct document_id) as n_sources from r left join w using (query_id, chunk_id) group by 1),
    n as (select query_id, count(distinct chunk_id) as total from w group by 1)
    select query_id, round(coalesce(h, 0) / total, 6) as recall_at_k, round(coalesce(h, 0) / 5, 6) as precision_at_k, round(coalesce(1 / first, 0), 6) as reciprocal_rank, coalesce(n_sources, 0) as n_sources from n left join h using (query_id)""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the TF-IDF search against the documents that hold the benchmark's passage."""
    docs, asked = _search_docs(spark, sf_dir), _search_queries(spark, sf_dir)
    ranked = retrieval.tfidf_search(docs, asked, digits=6).withColumn("document_id", F.col("chunk_id") % 3)
    relevant = scratch.written(docs.join(F.broadcast(asked), F.contains("content", "query")).select("query_id", "chunk_id"), "relevant")
    q = retrieval.retrieval_quality(ranked, relevant)
    return q.select("query_id", "n_sources", *(F.round(c, 6).alias(c) for c in ("recall_at_k", "precision_at_k", "reciprocal_rank")))


_LABELS = "select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id"
_RISK = "case when toxic = 1 then 'high' when quality = 0 then 'medium' else 'low' end"


@query(f"""select 'inc_' || doc_id as incident_id, attempt, case when k in (1, 3, 4) then 'schema' when k = 2 then 'citation' end as reject_code, case when k in (0, 5) then {_RISK} end as risk_level
    from (select *, case when attempt = 1 then doc_id % 6 when doc_id % 5 = 0 then 1 else 0 end as k from ({_LABELS}), range(1, 3) t(attempt))""")
def assessment_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.check_outputs(render.model_outputs(spark, sf_dir), render.packed_ids(spark, sf_dir))
    return c.select("incident_id", F.col("attempt").cast("long").alias("attempt"), "reject_code", F.col("assessment.risk_level").alias("risk_level"))


_RESOLVED = f"""select doc_id, case when doc_id % 6 in (0, 5) then 1 else 2 end as n_attempts, doc_id % 6 in (0, 5) or doc_id % 5 <> 0 as ok, {_RISK} as risk,
    'Document ' || doc_id as text from ({_LABELS})"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.check_outputs(render.model_outputs(spark, sf_dir), render.packed_ids(spark, sf_dir))
    f = render.packed_ids(spark, sf_dir).select("incident_id").distinct().select("incident_id", F.lit(10).cast("long").alias("total_lines"), F.lit(1).cast("long").alias("unparsed_lines"), F.array(F.lit("x")).alias("limitations"), F.array(F.lit("10.0.0.1")).alias("ip_aggregations"))
    return reports.report_rows(reports.resolve_attempts(c), f)


@query(f"""select 'inc_' || doc_id as incident_id, case when ok then 'completed' else 'invalid_model_output' end as status, case when ok then text else 'Model output validation failed after ' || n_attempts || ' attempts.' end as summary,
    case when ok then risk else 'unknown' end as risk_level, case when ok then 'c1' else '' end as citations, case when ok then 'because' else 'Validation error: schema' end as risk_reasoning,
    case when ok then 'x' else 'x|{reports.FAILED_LIMITATION}' end as limitations from ({_RESOLVED})""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    return r.select("incident_id", "status", "summary", "risk_level", F.array_join("citations", ",").alias("citations"), "risk_reasoning", F.array_join("limitations", "|").alias("limitations"))


@query(f"""select 'inc_' || doc_id as incident_id, 'c1' as citation, 'Guide' as source_title, 'N' as section_or_page from ({_RESOLVED}) where ok""")
def shown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.range(1).select(F.lit("c1").alias("chunk_id"), F.lit("Guide").alias("source_title"), F.lit("N").alias("section_or_page"))
    return reports.shown_citations(_reports(spark, sf_dir), known).drop("place")


@query(f"""select 'inc_' || doc_id as incident_id, '<' || (32 + case when not ok then 5 when risk = 'high' then 2 when risk = 'medium' then 4 else 6 end) || '>1 2026-01-02T03:04:05.000000Z localhost tidewatch inc_' || doc_id || ' INCIDENT_REPORT [tidewatch@53457 incident_id="inc_' || doc_id || '" risk_level="'
    || case when ok then upper(risk) else 'UNKNOWN' end || '" status="' || case when ok then 'completed' else 'invalid_model_output' end || '"] ' || chr(65279) || '{{"incident_id":"inc_' || doc_id || '","status":"' || case when ok then 'completed' else 'invalid_model_output' end
    || '","risk_level":"' || case when ok then risk else 'unknown' end || '","citations":[' || case when ok then '"c1"' else '' end || ']}}' as line from ({_RESOLVED})""")
def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    line = reports.syslog_line(F.struct("incident_id", "status", "risk_level", "citations"), F.col("incident_id"), F.col("risk_level"), F.col("status"), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    return r.select("incident_id", line.alias("line"))


@query(f"""select 'inc_' || doc_id as incident_id, case when ok and risk = 'high' then 'High' else 'Medium' end as priority, case when not ok then '3' when risk = 'high' then '1' when risk = 'medium' then '2' else '3' end as urgency,
    '[Alert] ' || case when ok then upper(risk) || ': ' || text else 'UNKNOWN: Model output validation failed after ' || n_attempts || ' attempts.' end as summary,
    case when ok then concat_ws(chr(10), '**Incident Summary:** ' || text, '**Risk Level:** ' || upper(risk), '', '**Assessed Risk Reasoning:**', 'because', '', '**Evidence-Supported Interpretations:**', '- one', '', '**Recommended Defensive Actions:**', '- look', '', '**Knowledge Guidance Citations:** c1')
    else concat_ws(chr(10), '**Incident Summary:** Model output validation failed after ' || n_attempts || ' attempts.', '**Risk Level:** UNKNOWN', '', '**Assessed Risk Reasoning:**', 'Validation error: schema', '', '**Evidence-Supported Interpretations:**', '', '**Recommended Defensive Actions:**') end as description from ({_RESOLVED})""")
def ticket_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reports.ticket_payloads(_reports(spark, sf_dir), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    at = lambda path: F.get_json_object("payload", path)
    return p.select("incident_id", at("$.jira.fields.priority.name").alias("priority"), at("$.servicenow.urgency").alias("urgency"), at("$.jira.fields.summary").alias("summary"), at("$.jira.fields.description").alias("description"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = render.model_outputs(spark, sf_dir)
    r = reports.resolve_attempts(reports.check_outputs(o, render.packed_ids(spark, sf_dir)))
    r = r.select(F.concat(F.lit("p"), (F.substring("incident_id", 5, 20).cast("long") % 3).cast("string")).alias("profile"), F.col("incident_id").alias("case_id"), "status", F.col("assessment.risk_level").alias("risk_level"), F.col("assessment.citations").alias("citations"), "completion_tokens", "total_latency_ms", "time_to_first_token_ms")
    cases = render.packed_ids(spark, sf_dir).groupBy(F.col("incident_id").alias("case_id")).agg(F.collect_set("chunk_id").alias("chunk_ids")).withColumn("expected_risk_level", F.lit("LOW"))
    return scoring.evaluate(r, cases)


@query(f"""select 'p' || (doc_id % 3) as profile, 'inc_' || doc_id as case_id, ok::int::double as schema_compliance, (ok and risk = 'low')::int::double as risk_consistency, ok::int::double as citation_validity,
    case when ok and doc_id % 500 > 0 then round((doc_id % 500) / ((1000.0 + doc_id % 4000 - doc_id % 900) / 1000.0), 6) end as token_rate from ({_RESOLVED})""")
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("profile", "case_id", "schema_compliance", "risk_consistency", "citation_validity", F.round("token_rate", 6).alias("token_rate"))


@query(f"select 'p' || (doc_id % 3) as profile, count(*) as total_cases, count(*) filter (ok) as successful_cases, count(*) filter (not ok) as failed_cases from ({_RESOLVED}) group by 1")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.profile_summary(_scores(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    names = lambda n: F.transform(F.sequence(F.lit(1), (n + 1).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string")))
    return render.table(spark, sf_dir, "labels").select("doc_id").distinct().select(
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("profile"),
        F.floor(k / 9).alias("case_id"),
        (F.floor(k / 3) % 3).alias("repetition"),
        names(k % 5).alias("findings"),
        names(k % 4).alias("expected_findings"),
        (k % 3).alias("claims_cited"),
        (k % 4).alias("claims"),
        names(k % 2).alias("recommendation_kinds"),
        names(k % 3).alias("expected_kinds"),
        (k % 1000).cast("double").alias("total_latency_ms"),
        (k % 100).cast("double").alias("time_to_first_token_ms"),
        (k % 50).cast("double").alias("token_rate"),
    )


@query("""with k as (select distinct doc_id as k from labels) select 'p' || (k % 3) as profile, round(avg(least(k % 5 + 1, k % 4 + 1) / (k % 4 + 1)), 6) as finding_recall, sum(greatest(k % 5 - k % 4, 0))::bigint as unsupported_findings,
    round(avg(case when k % 4 > 0 then (k % 3) / (k % 4) end), 6) as citation_coverage, round(avg(least(k % 2 + 1, k % 3 + 1) / (k % 3 + 1)), 6) as recommendation_completeness,
    round(quantile_cont((k % 1000)::double, 0.5), 6) as median_latency_ms, round(quantile_cont((k % 1000)::double, 0.95), 6) as p95_latency_ms, round(quantile_cont((k % 100)::double, 0.5), 6) as median_first_token_ms, round(quantile_cont((k % 50)::double, 0.5), 6) as median_token_rate from k group by 1""")
def benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.benchmark_statistics(_runs(spark, sf_dir))
    return s.select("profile", "unsupported_findings", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("profile", "unsupported_findings")))


@query("""with k as (select distinct doc_id as k from labels), r as (select 'p' || (k % 3) as profile, k // 9 as case_id, k // 3 % 3 as repetition, k % 5 + 1 as n from k),
    f as (select profile, case_id, min(repetition) as r, arg_min(n, repetition) as m from r group by 1, 2)
    select profile, case_id, repetition, round(least(n, m) / greatest(n, m), 6) as agreement from r join f using (profile, case_id) where repetition <> r""")
def repeated_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.repeated_agreement(_runs(spark, sf_dir)).withColumn("agreement", F.round("agreement", 6))


@query("select source as profile, lang as category, round(avg(doc_id % 3), 6) as average, count(*) as n from documents group by 1, 2")
def rubric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = render.table(spark, sf_dir, "documents").select(F.col("source").alias("profile"), F.col("lang").alias("category"), (F.col("doc_id") % 3).alias("rating"))
    return scoring.rubric_averages(d).withColumn("average", F.round("average", 6))


@query("""with p as (select source as profile, count(*) % 2 = 0 as done, min(doc_id % 2) as language, max(n_chars)::double as readability, sum(n_chars)::double as latency from documents group by 1)
    select profile, row_number() over (order by readability desc, latency, profile)::int as place from p where done and language = 0""")
def eligible_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = render.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("profile")).agg((F.count("*") % 2 == 0).alias("all_cases_completed"), F.min(F.col("doc_id") % 2).alias("prohibited_language"), F.max("n_chars").alias("readability"), F.sum("n_chars").alias("median_latency_ms"))
    one = {c: F.lit(1.0) for c in ("schema_compliance", "citation_validity", "groundedness", "citation_coverage", "recommendation_completeness", "risk_consistency")}
    return scoring.eligible_profiles(p.withColumns(one | {"unsupported_findings": F.lit(0)})).select("profile", "place")


_SAID = "case doc_id % 4 when 1 then ' It is definitely an intrusion.' when 2 then ' Automatically block the host.' when 0 then ' This may be a scan.' else '' end"


@query(f"select doc_id, regexp_matches(text || {_SAID}, '{scoring.PROHIBITED.replace('(?iU)', '(?i)')}') as prohibited from documents")
def prohibited_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, some with a sentence at their end."""
    k = F.col("doc_id") % 4
    said = F.when(k == 1, " It is definitely an intrusion.").when(k == 2, " Automatically block the host.").when(k == 0, " This may be a scan.").otherwise("")
    d = render.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", said).alias("text"))
    return d.select("doc_id", scoring.prohibited_language(F.col("text")).alias("prohibited"))


@query(f"""select event_id as line_no, 'ip_' || sha256('salt' || ip)[1:12] as source_ip, 'user_' || sha256('salt' || name)[1:12] as "user" from ({_E})""")
def pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymize(render.failures(spark, sf_dir), "salt").select("line_no", "source_ip", "user")


@query("select event_id as line_no, case event_type when 'error' then 'T1110' when 'click' then 'T1078' end as technique_id from events")
def map_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.map_techniques(render.failures(spark, sf_dir)).select("line_no", "technique_id")


@query("select doc_id, length(text) <= 2000 as accepted, case when length(text) > 2000 then length(text) end::int as length from documents")
def overlong_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = privacy.split_overlong(render.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw")), 2000)
    return good.select("doc_id", F.lit(True).alias("accepted"), F.lit(None).cast("int").alias("length")).unionByName(bad.select("doc_id", F.lit(False).alias("accepted"), "length"))


@query(f"""select event_id as line_no, sha256(strftime(ts, '%b ') || day(ts) || strftime(ts, ' %H:%M:%S') || ' host sshd[' || port || ']: ' || case event_type when 'error' then 'Failed password for ' || name || ' from ' || ip || ' port ' || port || ' ssh2'
    when 'click' then 'Accepted publickey for ' || name || ' from ' || ip || ' port ' || port || ' ssh2' when 'view' then 'Disconnected from authenticating user ' || name || ' ' || ip || ' port ' || port when 'purchase' then 'Invalid user ' || name || ' from ' || ip || ' port ' || port else 'Server listening on 0.0.0.0 port 22.' end) as raw_sha256 from ({_E})""")
def without_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.without_raw(_ssh(spark, sf_dir)).select("line_no", "raw_sha256")


@query("""select page_id, 'reject_' || case page_id % 5 when 0 then 'none' when 1 then 'extension' when 2 then 'empty' when 3 then 'archive' else 'null_byte' end as outcome from pages""")
def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources import files

    k = F.col("page_id") % 5
    body = F.when(k == 2, F.lit("")).when(k == 3, F.concat(F.lit("PK"), F.col("url"))).when(k == 4, F.concat(F.col("url"), F.lit("\0"))).otherwise(F.col("url"))
    f = render.table(spark, sf_dir, "pages").select("page_id", F.when(k == 1, "a.exe").otherwise("a.log").alias("path"), F.encode(body, "UTF-8").alias("content"))
    good, bad = files.admit(f.withColumn("length", F.octet_length("content").cast("long")), files.UPLOADS)
    return good.select("page_id", F.lit("reject_none").alias("outcome")).unionByName(bad.select("page_id", F.concat(F.lit("reject_"), F.col("rejected_reason")).alias("outcome")))


@query("""select conv_id, sha256(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) order by turn)) as content_sha256 from conversations where trim(text) <> '' group by conv_id""")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources import files

    got = files.assemble_pages(render.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return got.select("conv_id", F.sha2("content", 256).alias("content_sha256"))


@query("""select conv_id, sha256('## Parser Findings (Deterministic Facts)' || chr(10) || '{"conv_id":' || conv_id || '}' || chr(10) || chr(10) || '## Retrieved Context (Security Guidance)' || chr(10)
    || string_agg('--- Chunk ID: ' || turn || ' ---' || chr(10) || 'Source: ' || role || chr(10) || 'Section: s' || chr(10) || 'Content:' || chr(10) || text || chr(10) || chr(10), '' order by turn)) as evidence_sha256 from conversations group by conv_id""")
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = render.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.col("turn").cast("string").alias("chunk_id"), F.col("role").alias("source_title"), F.lit("s").alias("section_or_page"), F.col("text").alias("content")).alias("c"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("chunks"))
    return rows.select("conv_id", F.sha2(reports.evidence(F.to_json(F.struct("conv_id")), F.col("chunks")), 256).alias("evidence_sha256"))


@query()
def incident_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = render.failures(spark, sf_dir).withColumn("ts_assumed", F.lit(False))
    found = bursts.burst_incidents(e, ("source_id", "user"), 3, 2 * DAY)
    d = render.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("source").alias("source_title"), F.col("text").alias("content"))
    chunks = scratch.written(corpus.chunk_documents(d), "chunks")
    got = incidents.incident_evidence(found, e, chunks, ("source_id", "user"))
    return got.select("incident_id", "query", F.array_join("packed_ids", ",").alias("packed_ids"), F.length("evidence").alias("evidence_chars"))
