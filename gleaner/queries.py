"""Registered queries of the analytics operators, each with its SQL where SQL can express it.

Each applies an operator to a whole table of the driver's; the mapping from
job-posting columns to those tables is in the query itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import salary as pay
from .functions import text as tx
from .functions import time as tm
from .functions import vector as vc
from .plans import pipelines
from .operators import analytics, audit, clusters, lifecycle, models, profile, silver, skills, sparse, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str | F.Column, n: int = 6) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n) for n in names})


# --- bins, audit, profile ---------------------------------------------------


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as \"rows\" from orders where o_orderdate is not null group by 1")
def volume_month(spark, d):
    return audit.volumes(_t(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts")))


@query("""select strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + interval 6 day, '%Y-%m-%d') as week, count(*) as "rows"
          from events where ts is not null group by 1""")
def volume_week(spark, d):
    return audit.volumes(_t(spark, d, "events"), size="W", label="week")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as \"rows\" from events where ts is not null group by 1")
def volume_day(spark, d):
    return audit.volumes(_t(spark, d, "events"), size="D", label="day")


@query("select strftime(ts, '%Y-%m-%d %H:00') as hour, count(*) as \"rows\" from events where ts is not null group by 1")
def volume_hour(spark, d):
    return audit.volumes(_t(spark, d, "events"), size="H", label="hour")


@query("""select strftime(ts, '%Y-%m-%d') as day, count(*) as "rows", count(*) filter (trim(coalesce(props, '')) <> '') as text_non_empty,
          count(*) filter (trim(coalesce(event_type, '')) <> '') as skills_non_empty,
          round(count(*) filter (trim(coalesce(props, '')) <> '') / count(*), 6) as text_coverage,
          round(count(*) filter (trim(coalesce(event_type, '')) <> '') / count(*), 6) as skills_coverage
          from events where ts is not null group by 1""")
def audit_coverage(spark, d):
    return _rounded(audit.coverage_by_bin(_t(spark, d, "events"), "props", "event_type", size="D", label="day"), "text_coverage", "skills_coverage")


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as month, o_orderdate from orders), c as (select month, count(*) as n from m where month is not null group by 1)
          select 'listed_time' as time_column, (select count(*) from m)::bigint as total_rows, (select count(o_orderdate) from m)::bigint as valid_rows,
          (select count(*) - count(o_orderdate) from m)::bigint as invalid_or_missing_rows, (select strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') from m) as min_date,
          (select strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') from m) as max_date, (select count(*) from c)::int as number_of_months,
          case when (select count(*) from c) < 2 then 'demo_only' when (select count(*) from c) < 6 then 'limited_temporal_coverage' else 'sufficient_temporal_coverage' end as reliability_label""")
def time_column_coverage(spark, d):
    jobs = _t(spark, d, "orders").select((F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long").alias("listed_time"))
    found = audit.column_coverage(jobs.withColumn("listed_time", F.timestamp_millis("listed_time")))
    return found.select("time_column", "total_rows", "valid_rows", "invalid_or_missing_rows", "min_date", "max_date", "number_of_months", "reliability_label")


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as parsed from events")
def parse_epoch_ms(spark, d):
    e = _t(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("raw"))
    return tm.with_time(e, "raw").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as parsed from orders")
def parse_iso_text(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("raw"))
    return tm.with_time(o, "raw", strict=True).select("o_orderkey", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("select trim(source) as value, count(*) as n from documents where trim(coalesce(source, '')) <> '' group by 1")
def value_counts(spark, d):
    return profile.value_counts(_t(spark, d, "documents"), "source")


@query("select trim(lang) as value, count(*) as n from documents where trim(coalesce(lang, '')) <> '' group by 1 order by 2 desc, 1 limit 3")
def top_values(spark, d):
    return profile.value_counts(_t(spark, d, "documents"), "lang", 3)


@query("""select trim(t) as token, count(*) as n from (select unnest(string_split(replace(p_name, ' ', ', ') || ',' || p_brand, ',')) as t from part) where trim(t) <> '' group by 1 order by 2 desc, 1 limit 20""")
def top_tokens(spark, d):
    p = _t(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(","), "p_brand").alias("skills_text"))
    return profile.token_counts(p, "skills_text", 20)


@query("""select count(*) as n_postings, count(distinct doc_id) as n_unique_job_ids, count(*) filter (trim(coalesce(source, '')) = '') as n_missing_titles,
          count(*) filter (trim(coalesce(text, '')) = '') as n_missing_descriptions, count(*) filter (trim(coalesce(lang, '')) = '') as n_jobs_without_skills,
          count(n_chars) as listed_time_n_total, count(*) filter (n_chars * 500000000 between 946684800000 and 2240524799999) as listed_time_n_parsed,
          round(count(*) filter (n_chars * 500000000 between 946684800000 and 2240524799999) / count(n_chars), 6) as listed_time_parse_rate from documents""")
def profile_summary(spark, d):
    docs = _t(spark, d, "documents")
    return profile.summary(docs.select(F.col("doc_id").alias("job_id"), F.col("source").alias("title"), F.col("text").alias("description"), F.col("lang").alias("skills_text"), (F.col("n_chars") * 500_000_000).alias("listed_time")))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def percentiles(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(_r(F.percentile("value", 0.5)).alias("p50"), _r(F.percentile("value", 0.95)).alias("p95"))


# --- text and skills --------------------------------------------------------

_CARD = "case when trim(coalesce({0}, '')) <> '' then '{1}: ' || trim({0}) end"


@query(f"""select doc_id, concat_ws(chr(10), {_CARD.format("source", "Title")}, {_CARD.format("lang", "Work type")}, {_CARD.format("lang || ', ' || source", "Skills")},
           case when regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '' then 'Description: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') end) as job_card_text from documents""")
def job_card(spark, d):
    c, none = F.col, F.lit(None).cast("string")
    return _t(spark, d, "documents").select("doc_id", tx.job_card(c("source"), none, c("lang"), none, F.concat("lang", F.lit(", "), "source"), c("text")).alias("job_card_text"))


@query("""select conv_id, turn, 'TITLE: ' || trim(regexp_replace(coalesce(role, ''), '\\s+', ' ', 'g')) || chr(10) || 'DESCRIPTION: ' || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as text from conversations""")
def eval_text(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.eval_text(F.col("role"), F.lit(""), F.col("text")).alias("text"))


_NAMES = "p_partkey, p_name || ' ; ' || p_brand || ', ' || p_type || ' |sql;' || lower(p_name) as s from part"
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" ; "), "p_brand", F.lit(", "), "p_type", F.lit(" |sql;"), F.lower("p_name")).alias("s"))


@query(f"select p_partkey, array_to_string(list_filter(list_transform(string_split(lower(s), ';'), lambda x: {_SQUEEZE.format('x')}), lambda x: x <> ''), '~') as skills from (select {_NAMES})")
def split_growth(spark, d):
    return _listed(spark, d).select("p_partkey", F.array_join(tx.split_growth(F.col("s")), "~").alias("skills"))


@query(f"select p_partkey, array_to_string(list_filter(list_transform(string_split_regex(lower(s), '[|,;]'), lambda x: {_SQUEEZE.format('x')}), lambda x: x <> ''), '~') as skills from (select {_NAMES})")
def split_cluster(spark, d):
    return _listed(spark, d).select("p_partkey", F.array_join(tx.split_cluster(F.col("s")), "~").alias("skills"))


@query(f"select p_partkey, array_to_string(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''), '~') as skills from (select {_NAMES})")
def split_profile(spark, d):
    return _listed(spark, d).select("p_partkey", F.array_join(tx.split_profile(F.col("s")), "~").alias("skills"))


@query(f"""with x as (select p_partkey, unnest(string_split_regex(s, '[;,|]')) as raw, generate_subscripts(string_split_regex(s, '[;,|]'), 1) as i from (select {_NAMES})),
           n as (select p_partkey, i, {_SQUEEZE.format("lower(raw)")} as low from x),
           c as (select p_partkey, i, case when low = 'sql' then 'SQL' else array_to_string(list_transform(string_split(low, ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as skill from n where low <> ''),
           f as (select p_partkey, skill, min(i) as i from c group by all)
           select p_partkey, string_agg(skill, '~' order by i) as skills from f group by 1""")
def split_evolution(spark, d):
    return _listed(spark, d).select("p_partkey", F.array_join(tx.split_evolution(F.col("s")), "~").alias("skills"))


@query("""select l_orderkey as job_id, string_agg(n_name, ', ' order by p, n_name) as skills_text from
          (select l_orderkey, n_name, min(l_linenumber) as p from lineitem join nation on l_partkey % 25 = n_nationkey group by 1, 2) group by 1""")
def skills_text(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 25).alias("skill_abr"), F.col("l_linenumber").alias("pos"))
    names = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("skill_abr"), F.col("n_name").alias("skill_name"))
    return silver.skills_text(lines, names)


@query("""select l_orderkey as job_id, max(l_quantity) as min_salary, max(l_extendedprice) as max_salary,
          arg_min(case when l_returnflag <> 'R' then l_returnflag end, case when l_returnflag <> 'R' then l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey end) as currency from lineitem group by 1""")
def collapse_salaries(spark, d):
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_quantity").alias("min_salary"), F.col("l_extendedprice").alias("max_salary"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).otherwise(" ").alias("currency"), pos.alias("pos"))
    return silver.collapse_salaries(rows)


@query("""with s as (select l_orderkey, string_agg(n_name, ', ' order by p, n_name) as skills_text from (select l_orderkey, n_name, min(l_linenumber) as p from lineitem join nation on l_suppkey % 25 = n_nationkey group by 1, 2) group by 1),
          m as (select l_orderkey, max(l_extendedprice) as max_salary from lineitem group by 1)
          select o_orderkey as job_id, trim(o_orderpriority) as title, trim(o_orderstatus) as description, coalesce(skills_text, '') as skills_text,
          concat_ws(chr(10), 'Title: ' || trim(o_orderpriority), 'Location: ' || o_custkey, case when skills_text is not null then 'Skills: ' || skills_text end, 'Description: ' || trim(o_orderstatus)) as job_card_text,
          o_custkey::varchar as location, max_salary from orders left join s on o_orderkey = s.l_orderkey left join m on o_orderkey = m.l_orderkey""")
def silver_table(spark, d):
    jobs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("description"), F.col("o_custkey").cast("string").alias("location"))
    lines = _t(spark, d, "lineitem")
    abr = lines.select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 25).alias("skill_abr"), F.col("l_linenumber").alias("pos"))
    names = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("skill_abr"), F.col("n_name").alias("skill_name"))
    return silver.build_silver(jobs, abr, names, lines.select(F.col("l_orderkey").alias("job_id"), F.col("l_extendedprice").alias("max_salary"), F.col("l_linenumber").alias("pos")))


@query("select l.* from lineitem l where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')")
def keep_children(spark, d):
    parents = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return silver.keep_children(_t(spark, d, "lineitem"), parents, "l_orderkey")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1")
def first_per_key(spark, d):
    return silver.first_per(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select event_id, regexp_extract(props, '(?s)\\{.*\\}') as object from events")
def json_objects(spark, d):
    return _t(spark, d, "events").select("event_id", tx.json_object(F.concat(F.lit("answer: "), "props", F.lit(" done"))).alias("object"))


_KEYWORDS = {n: "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + ")" for n, (_, words, _) in skills.DOMAINS.items()}
_BEST = "greatest(" + ", ".join(_KEYWORDS.values()) + ")"


@query(f"""with x as (select doc_id, trim(regexp_replace(regexp_replace(lower(replace(coalesce(text, ''), 'th', 'data site')), '[/;|]', ' ', 'g'), '\\s+', ' ', 'g')) as t from documents)
           select doc_id, case {" ".join(f"when {s} = {_BEST} then '{n}'" for n, s in _KEYWORDS.items())} end as domain, ({_BEST})::int as score from x""")
def keyword_domain(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", tx.keyword_text(F.replace("text", F.lit("th"), F.lit("data site"))).alias("t"))
    return docs.select("doc_id", skills.keyword_domain(F.col("t")).alias("k")).select("doc_id", "k.domain", "k.score")


@query("""with r as (select strftime(ts, '%Y-%m-%d') as month, event_type, user_id from events), e as (select min(month) as a, max(month) as b from r),
          l as (select month, unnest([lower(event_type), 'u' || (user_id % 9)]) as skill from r), c as (select skill, count(*) filter (month = a) as c0, count(*) filter (month = b) as c1, a, b from l, e where month in (a, b) group by skill, a, b),
          t as (select sum(c0) as t0, sum(c1) as t1 from c)
          select skill, a as first_month, b as last_month, c0 as first_count, c1 as last_count, round(case when t0 > 0 then c0 / t0 else 0 end, 6) as first_share,
          round(case when t1 > 0 then c1 / t1 else 0 end, 6) as last_share, round(c1 / t1 - c0 / t0, 6) as share_delta, case when c1 / t1 - c0 / t0 >= 0 then 'rising' else 'declining' end as trend from c, t""")
def skill_growth(spark, d):
    e = _t(spark, d, "events").select(tm.time_bin(F.col("ts"), "D").alias("month"), F.concat("event_type", F.lit("; u"), (F.col("user_id") % 9).cast("string")).alias("skills_text"))
    return _rounded(skills.skill_growth(e, "skills_text"), "first_share", "last_share", "share_delta")


def _domain_jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "events").withColumns({"time_bin": tm.time_bin(F.col("ts"), "D"), "domain": F.element_at(F.array(*map(F.lit, skills.DOMAINS)), (F.col("user_id") % 4 + 1).cast("int")), "job_id": F.col("event_id")})
    return e.select("job_id", "event_type"), e.select("job_id", "domain", "time_bin")


_JOBS = """j as (select event_id as job_id, strftime(ts, '%Y-%m-%d') as time_bin, (['health', 'tech', 'construction_industry', 'education', 'sales'])[(user_id % 4 + 1)::int] as domain,
           upper(event_type[1]) || lower(event_type[2:]) as skill from events),
           s as (select domain, time_bin, skill, count(distinct job_id) as skill_job_count from j group by all), t as (select domain, time_bin, count(distinct job_id) as job_count from j group by all)"""


@query("with " + _JOBS + " select domain, time_bin, skill, skill_job_count, job_count, round(100.0 * skill_job_count / job_count, 6) as share_pct from s join t using (domain, time_bin)")
def domain_skill_share(spark, d):
    rows, jobs = _domain_jobs(spark, d)
    return _rounded(skills.domain_skill_share(skills.skill_long(rows, "event_type"), jobs), "share_pct")


@query("with " + _JOBS + """ select g.domain, g.time_bin, coalesce(t.job_count, 0)::bigint as job_count from (select distinct time_bin, unnest(['health', 'tech', 'construction_industry', 'education', 'sales']) as domain from j) g
       left join t on g.domain = t.domain and g.time_bin = t.time_bin""")
def domain_bins(spark, d):
    return skills.domain_bins(_domain_jobs(spark, d)[1])


_TOP = " b as (select skill from s where domain = 'tech' group by 1 order by sum(skill_job_count) desc, 1 limit 3), x as (select time_bin, coalesce(b.skill, 'Other') as skill, skill_job_count as n, job_count from s join t using (domain, time_bin) left join b using (skill) where domain = 'tech'),"


@query("with " + _JOBS + "," + _TOP + """ a as (select time_bin, sum(n) as every, max(job_count) as job_count from x group by 1), g as (select * from a, (select skill from b union all select 'Other') k),
       c as (select time_bin, skill, sum(n) as n from x group by 1, 2)
       select g.time_bin, g.skill, coalesce(c.n, 0)::double as skill_job_count, round(coalesce(c.n, 0) / every, 6) as composition_share, g.job_count, g.job_count < 100 as low_support from g left join c on g.time_bin = c.time_bin and g.skill = c.skill""")
def skill_composition(spark, d):
    rows, jobs = _domain_jobs(spark, d)
    shares = skills.domain_skill_share(skills.skill_long(rows, "event_type"), jobs).where("domain = 'tech'")
    return _rounded(skills.skill_composition(shares, 3), "composition_share").drop("rank")


@query("with " + _JOBS + " select domain, skill, total, rank from (select domain, skill, sum(skill_job_count)::bigint as total, row_number() over (partition by domain order by sum(skill_job_count) desc, skill)::int as rank from s group by 1, 2) where rank <= 2")
def top_domain_skills(spark, d):
    rows, jobs = _domain_jobs(spark, d)
    return skills.top_skills(skills.domain_skill_share(skills.skill_long(rows, "event_type"), jobs), 2, ["domain"])


@query("""select * from (pivot (select strftime(ts, '%Y-%m-%d') as time_bin, event_type from events) on event_type in ('click', 'error', 'view') using count(*) group by time_bin)""")
def skill_pivot(spark, d):
    e = _t(spark, d, "events").select(tm.time_bin(F.col("ts"), "D").alias("time_bin"), "event_type")
    return e.groupBy("time_bin").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).fillna(0)


# --- vectors ----------------------------------------------------------------

_MEANS = """p as (select {k} as k, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i, {w} as w from embeddings where {k} is not null),
            m as (select k, i, sum(w * x) / sum(w) as x from p group by 1, 2)"""
_DRIFT = """, n as (select k, sqrt(sum(x * x)) as n from m group by 1), o as (select k, lag(k) over (order by k) as q from n),
            c as (select o.k, o.q, sum(a.x * b.x) / max(na.n) / max(nb.n) as s from o join m a on a.k = o.k join m b on b.k = o.q and a.i = b.i join n na on na.k = o.k join n nb on nb.k = o.q group by 1, 2)"""


@query("with " + _MEANS.format(k="label", w="1.0") + " select k as label, (i - 1)::int as pos, round(x, 6) as mean from m")
def centroids(spark, d):
    found = vectors.mean_vectors(_t(spark, d, "embeddings"), ["label"], "embedding")
    return found.select("label", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", _r("mean"))


@query("with " + _MEANS.format(k="label", w="1.0") + _DRIFT + " select o.k as label, o.q as previous_label, round(1 - s, 6) as centroid_drift, round(s, 6) as cosine_similarity from o left join c on o.k = c.k")
def centroid_drift(spark, d):
    found = vectors.normalized(vectors.mean_vectors(_t(spark, d, "embeddings"), ["label"], "embedding"))
    return _rounded(vectors.drift(found, "label"), "centroid_drift", "cosine_similarity").select("label", "previous_label", "centroid_drift", "cosine_similarity")


@query("with " + _MEANS.format(k="label", w="(1.0 + vec_id % 5)") + _DRIFT + " select k as label, q as previous_label, round(1 - s, 6) as centroid_drift from c")
def weighted_drift(spark, d):
    e = _t(spark, d, "embeddings")
    found = vectors.normalized(vectors.mean_vectors(e, ["label"], "embedding", (1.0 + F.col("vec_id") % 5)))
    return _rounded(vectors.drift(found, "label", keep_first=False), "centroid_drift").select("label", "previous_label", "centroid_drift")


@query("""select row_number() over (order by score desc, vec_id)::int as rank, vec_id, round(score, 6) as score from
          (select a.vec_id, list_inner_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a, (select embedding from embeddings where vec_id = 7) b where a.vec_id <> 7 order by 2 desc, 1 limit 10) where score >= 0""")
def dense_top_k(spark, d):
    return _rounded(vectors.top_k(_t(spark, d, "embeddings"), 7, 10, "vec_id", "embedding"), "score")


@query("""with e as (select vec_id, embedding::double[] as v from embeddings order by vec_id limit 500), p as (select a.vec_id as i, list_inner_product(a.v, b.v) as s from e a, e b where a.vec_id <> b.vec_id)
          select count(distinct i) as n_rows, count(*) as n_pairs, round(avg(s), 6) as mean_similarity, round(median(s), 6) as median_similarity from p""")
def similarity_sample(spark, d):
    pairs = vectors.similarity_pairs(_t(spark, d, "embeddings"), "vec_id", "embedding")
    return _rounded(vectors.similarity_summary(pairs), "mean_similarity", "median_similarity")


@query("""with h as (select doc_id, sha256(coalesce(text, '')) as h from documents), r as (select doc_id, i, (('0x' || h[2 * i + 1 : 2 * i + 2])::int) / 127.5 - 1.0 as x from h, range(16) t(i)),
          n as (select doc_id, sqrt(sum(x * x)) as n from r group by 1) select doc_id, i::int as pos, round(x / n, 5) as x from r join n using (doc_id)""")
def mock_embedding(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.posexplode(vc.mock_embedding(F.col("text"))).alias("pos", "x"))
    return docs.withColumn("x", _r("x", 5))


_TFIDF = """tok as (select doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) as term from documents),
            tf as (select doc_id, term, count(*) as tf from tok group by 1, 2), df as (select term, count(*) as df from tf group by 1 having count(*) >= 2), nd as (select count(*) as n from documents),
            w as (select doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join df using (term), nd),
            l as (select doc_id, sqrt(sum(w * w)) as l from w group by 1), p as (select doc_id, term, w / l as weight from w join l using (doc_id))"""
_PLAIN = sparse.Config(None, bigrams=False, min_df=2, sublinear=True)


@query("with " + _TFIDF + """, q as (select term, weight as q from p where doc_id = 3), s as (select doc_id, sum(weight * q) as s from p join q using (term) where doc_id <> 3 group by 1),
       a as (select d.doc_id, coalesce(s, 0) as score from documents d left join s on d.doc_id = s.doc_id where d.doc_id <> 3 order by round(coalesce(s, 0), 9) desc, 1 limit 10)
       select row_number() over (order by round(score, 9) desc, doc_id)::int as rank, doc_id, round(score, 6) as score from a""")
def sparse_top_k(spark, d):
    docs = _t(spark, d, "documents")
    return _rounded(sparse.sparse_top_k(sparse.tfidf(docs, "doc_id", "text", _PLAIN), docs, 3, 10, "doc_id"), "score")


@query("with " + _TFIDF + """, c as (select lang, count(*) as n from documents group by 1), g as (select lang, term, sum(weight) / max(c.n) as m from p join documents using (doc_id) join c using (lang) group by 1, 2)
       select lang, rank, term, round(m, 6) as mean_weight from (select *, row_number() over (partition by lang order by round(m, 9) desc, term)::int as rank from g) where rank <= 3""")
def top_terms(spark, d):
    docs = _t(spark, d, "documents")
    return _rounded(sparse.text_top_terms(docs, "doc_id", "text", "lang", _PLAIN), "mean_weight")


_BIGRAMS = """tok as (select doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}_]{2,}') as ws from documents),
            g as (select doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term from tok), tf as (select doc_id, term, count(*) as tf from g group by 1, 2),
            df as (select term, count(*) as df from tf group by 1 having count(*) >= 2 order by sum(tf) desc, term limit 30000), nd as (select count(*) as n from documents),
            w as (select doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join df using (term), nd),
            l as (select doc_id, sqrt(sum(w * w)) as l from w group by 1), p as (select doc_id, term, w / l as weight from w join l using (doc_id))"""


@query("with " + _BIGRAMS + """, q as (select term, weight as q from p where doc_id = 3), s as (select doc_id, sum(weight * q) as s from p join q using (term) where doc_id <> 3 group by 1),
       a as (select d.doc_id, coalesce(s, 0) as score from documents d left join s on d.doc_id = s.doc_id where d.doc_id <> 3 order by round(coalesce(s, 0), 9) desc, 1 limit 10)
       select row_number() over (order by round(score, 9) desc, doc_id)::int as rank, doc_id, round(score, 6) as score from a""")
def tfidf_retrieval(spark, d):
    docs = _t(spark, d, "documents")
    return _rounded(sparse.coded_top_k(sparse.coded(docs, "doc_id", "text", sparse.RETRIEVAL), docs, 3, 10, "doc_id"), "score")


@query("with " + _TFIDF + " select term, df, round(ln((1.0 + n) / (1.0 + df)) + 1, 6) as idf from df, nd")
def tfidf_vocabulary(spark, d):
    return _rounded(sparse.fit(_t(spark, d, "documents"), "doc_id", "text", _PLAIN), "idf")


@query()
def svd_vectors(spark, d):
    return models.svd_embeddings(sparse.doc_vectors(_t(spark, d, "documents"), "doc_id", "text", sparse.Config(2_000, bigrams=False, stop_words=sparse.ENGLISH_STOP_WORDS)), "doc_id", 16)


@query()
def kmeans_clusters(spark, d):
    labelled, _ = clusters.fit_clusters(_t(spark, d, "embeddings"), "embedding", 10, "vec_id")
    return labelled.select("vec_id", "cluster_id")


@query()
def bucket_encoding(spark, d):
    return models.encode_buckets(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


# --- clusters over time -----------------------------------------------------


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(
        F.col("event_id").alias("job_id"), tm.time_bin(F.col("ts"), "D").alias("time_bin"), (F.col("user_id") % 5).alias("cluster_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("normalized_salary"), F.concat("event_type", F.lit("; u"), (F.col("user_id") % 3).cast("string")).alias("skills_text"),
    )


_METRICS = """e as (select strftime(ts, '%Y-%m-%d') as time_bin, user_id % 5 as cluster_id, case when event_type <> 'error' and value > 0 then value end as pay, event_type, user_id from events),
              m as (select time_bin, cluster_id, count(*) as n_jobs, median(pay) as salary_median, avg(pay) as salary_mean, count(pay) as n_with_salary, count(*) as n_with_skills from e group by 1, 2),
              mm as (select *, n_jobs / sum(n_jobs) over (partition by time_bin) as share_jobs, n_with_salary / n_jobs as salary_coverage from m)"""


@query("with " + _METRICS + """, sk as (select time_bin, cluster_id, unnest([event_type, 'u' || (user_id % 3)]) as s from e), sc as (select time_bin, cluster_id, s, row_number() over (partition by time_bin, cluster_id order by count(*) desc, s) as r from sk group by 1, 2, 3),
       st as (select time_bin, cluster_id, string_agg(s, '; ' order by r) as top_skills from sc where r <= 5 group by 1, 2)
       select time_bin, cluster_id, n_jobs, round(salary_median, 6) as salary_median, round(salary_mean, 6) as salary_mean, n_with_salary, n_with_skills, round(share_jobs, 6) as share_jobs, round(salary_coverage, 6) as salary_coverage, top_skills from mm join st using (time_bin, cluster_id)""")
def cluster_metrics(spark, d):
    found = clusters.cluster_metrics(_clustered(spark, d), None, None, None, "skills_text")
    return _rounded(found, "salary_median", "salary_mean", "share_jobs", "salary_coverage")


@query("with " + _METRICS + " select cluster_id, round(arg_min(share_jobs, time_bin), 6) as first_share, round(arg_max(share_jobs, time_bin), 6) as last_share, round(arg_max(share_jobs, time_bin) - arg_min(share_jobs, time_bin), 6) as share_delta from mm group by 1")
def cluster_growth(spark, d):
    metrics = clusters.cluster_metrics(_clustered(spark, d), None, None, None, None)
    return _rounded(clusters.cluster_growth(metrics), "first_share", "last_share", "share_delta")


@query("with " + _METRICS + """, k as (select unnest(generate_series((select min(time_bin)::date from mm), (select max(time_bin)::date from mm), interval 1 day))::date as day)
       select day, s.cluster_id, coalesce(n_jobs, 0)::bigint as n_jobs, round(coalesce(share_jobs, 0), 6) as share_jobs from k cross join (select unnest([0, 2, 77])::bigint as cluster_id) s left join mm on mm.time_bin = strftime(day, '%Y-%m-%d') and mm.cluster_id = s.cluster_id""")
def daily_grid(spark, d):
    chosen = spark.createDataFrame([(0,), (2,), (77,)], "cluster_id long")
    metrics = clusters.cluster_metrics(_clustered(spark, d), None, None, None, None)
    return _rounded(clusters.daily_grid(metrics, chosen), "share_jobs")


@query("""with m as (select label as cluster_id, (vec_id // 100)::int as time_bin, embedding[1]::double as x, embedding[2]::double as y from embeddings where label is not null), t as (select cluster_id from m group by 1 order by count(*) desc, 1 limit 5),
          a as (select cluster_id, time_bin, count(*) as n, avg(x) as x, avg(y) as y from m join t using (cluster_id) group by 1, 2), s as (select cluster_id, min(time_bin) as lo, max(time_bin) as hi from a group by 1)
          select s.cluster_id, lo as start_bin, p.n as start_n, hi as end_bin, q.n as end_n, round(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2), 6) as projected_distance from s join a p on p.cluster_id = s.cluster_id and p.time_bin = lo join a q on q.cluster_id = s.cluster_id and q.time_bin = hi""")
def trajectories(spark, d):
    e = _t(spark, d, "embeddings").where("label is not null")
    points = e.select(F.col("label").alias("cluster_id"), F.expr("cast(vec_id div 100 as int)").alias("time_bin"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return _rounded(clusters.trajectories(points), "projected_distance").select("cluster_id", "start_bin", "start_n", "end_bin", "end_n", "projected_distance")


@query("with " + _METRICS + """, t as (select time_bin, sum(n_jobs) as n from mm group by 1), b as (select coalesce(min(time_bin) filter (n >= 100), min(time_bin)) as a, coalesce(max(time_bin) filter (n >= 100), max(time_bin)) as b from t),
       f as (select mm.*, coalesce(salary_median, (select median(salary_median) from mm), 75000) as salary from mm), p as (select f.* from f, b where time_bin = a), q as (select f.* from f, b where time_bin = b),
       v as (select coalesce(q.cluster_id, p.cluster_id) as cluster_id, coalesce(p.share_jobs, 0) as s0, coalesce(q.share_jobs, 0) as s1, case when q.cluster_id is not null then q.salary else p.salary end as salary, case when q.cluster_id is not null then q.n_jobs else p.n_jobs end as n_jobs from p full outer join q on p.cluster_id = q.cluster_id)
       select 'c' || cluster_id as cluster_label, n_jobs::bigint as n_jobs, round(s0 * (select greatest(sum(n_jobs), 1) from v) * salary, 4) as value_first, round(s1 * (select greatest(sum(n_jobs), 1) from v) * salary, 4) as value_last from v""")
def market_value(spark, d):
    metrics = clusters.cluster_metrics(_clustered(spark, d), None, None, None, None).withColumn("cluster_label", F.concat(F.lit("c"), F.col("cluster_id").cast("string")))
    found = analytics.market_value(metrics)
    return found.select("cluster_label", "n_jobs", _r("value_first", 4).alias("value_first"), _r("value_last", 4).alias("value_last"))


# --- lifecycle --------------------------------------------------------------

_SPANS = "d as (select o_orderpriority as cluster_id, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10 as t, l_linestatus = 'F' as e from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= o_orderdate)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_orderpriority").alias("cluster_id"), F.col("o_orderdate").alias("posted"), F.col("l_shipdate").alias("closed"), (F.col("l_linestatus") == "F").alias("done"))
    return lifecycle.durations(rows, "posted", "closed", keys=("cluster_id", "done")).withColumn("event_observed", F.col("done")).drop("done")


@query("with " + _SPANS + """ select cluster_id, count(*) as n_rows, count(*) filter (e) as n_events, count(*) filter (not e) as n_censored, round(sum(t), 4) as total_time_at_risk_days,
       round(count(*) filter (e) / sum(t), 9) as lambda, round(ln(2.0) / (count(*) filter (e) / sum(t)), 4) as half_life_days, round(sum(t) / count(*) filter (e), 4) as mean_lifetime_days, '' as warning from d group by 1""")
def exponential_decay(spark, d):
    found = lifecycle.exponential_decay(_spans(spark, d))
    return found.withColumns({"total_time_at_risk_days": _r("total_time_at_risk_days", 4), "lambda": _r("lambda", 9), "half_life_days": _r("half_life_days", 4), "mean_lifetime_days": _r("mean_lifetime_days", 4)})


@query("with " + _SPANS + """, a as (select cluster_id, t, count(*) filter (e) as k, count(*) filter (not e) as c, count(*) as n from d group by 1, 2),
       r as (select *, greatest(sum(n) over (partition by cluster_id) - coalesce(sum(c) over (partition by cluster_id order by t rows between unbounded preceding and 1 preceding), 0), 1) as risk from a), f as (select cluster_id, t, greatest(0.0, 1 - k / risk) as f from r where k > 0)
       select cluster_id, round(t, 6) as duration_days, round(case when min(f) over w <= 0 then 0 else exp(sum(ln(case when f > 0 then f end)) over w) end, 6) as survival from f window w as (partition by cluster_id order by t)
       union all select distinct cluster_id, 0.0, 1.0 from f""")
def observed_survival(spark, d):
    return _rounded(lifecycle.observed_survival(_spans(spark, d)), "duration_days", "survival")


@query("with " + _SPANS + """, a as (select cluster_id, t, count(*) filter (e) as k, count(*) as n from d group by 1, 2), r as (select *, sum(n) over (partition by cluster_id order by t rows between current row and unbounded following) as risk from a),
       f as (select cluster_id, t, 1 - k / risk as f from r where k > 0)
       select cluster_id, round(t, 6) as duration_days, round(case when min(f) over w <= 0 then 0 else exp(sum(ln(case when f > 0 then f end)) over w) end, 6) as survival from f window w as (partition by cluster_id order by t)""")
def kaplan_meier(spark, d):
    return _rounded(lifecycle.kaplan_meier(_spans(spark, d)), "duration_days", "survival")


@query("with " + _SPANS + """, a as (select cluster_id, t, count(*) filter (e) as k, count(*) filter (not e) as c, count(*) as n from d group by 1, 2),
       r as (select *, greatest(sum(n) over (partition by cluster_id) - coalesce(sum(c) over (partition by cluster_id order by t rows between unbounded preceding and 1 preceding), 0), 1) as risk from a), f as (select cluster_id, t, greatest(0.0, 1 - k / risk) as f from r where k > 0),
       v as (select cluster_id, t, case when min(f) over w <= 0 then 0 else exp(sum(ln(case when f > 0 then f end)) over w) end as s from f window w as (partition by cluster_id order by t) union all select distinct cluster_id, 0.0, 1.0 from f),
       x as (select cluster_id, t, min(s) as s from v group by 1, 2), g as (select cluster_id, i * greatest(max(t), 4000.0) / 89 as t from x, range(90) q(i) group by cluster_id, i),
       u as (select * from g union select cluster_id, t from x)
       select u.cluster_id, round(u.t, 6) as duration_days, round(coalesce(x.s, 1.0), 6) as survival from u asof left join x on u.cluster_id = x.cluster_id and u.t >= x.t""")
def dense_survival(spark, d):
    return _rounded(lifecycle.dense_survival(lifecycle.observed_survival(_spans(spark, d)), 4000.0), "duration_days", "survival")


# --- salary, sampling, evaluation, costs ------------------------------------

_PERIOD = "case o_orderpriority when '1-URGENT' then 12.0 when '2-HIGH' then 52.0 when '3-MEDIUM' then 1.0 when '4-NOT SPECIFIED' then 2080.0 end"
_PAY = f"""s as (select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, case when o_orderstatus <> 'P' then 'USD' else 'EUR' end as currency,
           coalesce(case when o_custkey % 3 = 0 then o_totalprice - 1000 end, (o_totalprice + o_totalprice / 2) / 2 * {_PERIOD}) as p from orders), a as (select o_orderkey, month, currency, case when p > 0 then p end as annual_salary from s),
           u as (select *, annual_salary is not null and currency = 'USD' and month is not null as usable from a), w as (select month, avg(ln(1 + annual_salary)) as m from u where usable group by 1)"""


def _paid(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    period = F.when(p == "1-URGENT", "monthly").when(p == "2-HIGH", "WEEKLY").when(p == "3-MEDIUM", "yearly").when(p == "4-NOT SPECIFIED", "HOURLY").otherwise("daily")
    return _t(spark, d, "orders").select("o_orderkey", tm.time_bin(F.col("o_orderdate"), "M").alias("month"), F.when(F.col("o_orderstatus") != "P", "usd").otherwise("EUR").alias("currency"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice") - 1000).alias("normalized_salary"), F.col("o_totalprice").alias("max_salary"), (F.col("o_totalprice") / 2).alias("min_salary"), period.alias("pay_period"))


@query("with " + _PAY + " select o_orderkey, round(annual_salary, 4) as annual_salary from a")
def annual_salary(spark, d):
    rows = _paid(spark, d)
    return rows.select("o_orderkey", _r(pay.annual_salary(rows.columns), 4).alias("annual_salary"))


@query("with " + _PAY + " select o_orderkey, usable as salary_usable, round(case when usable and m > 0 then least(greatest(ln(1 + annual_salary) / m, 0.25), 4.0) end, 6) as salary_weight from u left join w using (month)")
def salary_weights(spark, d):
    return analytics.salary_weights(_paid(spark, d)).select("o_orderkey", "salary_usable", _r("salary_weight").alias("salary_weight"))


@query("with " + _PAY + " select count(*) filter (usable) as salary_rows_used, round(count(*) filter (usable) / count(*), 6) as salary_coverage, count(*) filter (annual_salary is not null and currency <> 'USD') as salary_non_usd_excluded, count(*) filter (not usable) as salary_missing_or_unusable from u")
def salary_summary(spark, d):
    return _rounded(analytics.salary_summary(analytics.salary_weights(_paid(spark, d))), "salary_coverage")


@query("""with v as (select strftime(ts, '%Y-%m-%d') as day, count(*) as "rows" from events group by 1) select day, "rows", "rows" < 300 as low_support, round(40 + 160 * sqrt("rows" / (select max("rows") from v)), 6) as marker_size from v""")
def support_flags(spark, d):
    return _rounded(analytics.support_flags(audit.volumes(_t(spark, d, "events"), size="D", label="day"), "rows", 300), "marker_size")


@query("""with e as (select event_id, ts, strftime(ts, '%Y-%m-%d') as b from events where ts is not null), f as (select *, row_number() over (partition by b order by ts, event_id) as r from e),
          c as (select count(*) as n, count(distinct b) as k from e), g as (select *, row_number() over (order by ts, event_id) - 1 as i from f where r > 1), st as (select greatest(1, (n - k) // (500 - k)) as step, 500 - k as slots from c)
          select event_id from (select event_id, ts from f where r = 1 union all select event_id, ts from g, st where i % step = 0 and i // step < slots) order by ts, event_id limit 500""")
def stride_sample(spark, d):
    e = _t(spark, d, "events").withColumn("b", tm.time_bin(F.col("ts"), "D"))
    return analytics.stride_sample(e, 500, "ts", "b", "event_id").select("event_id")


@query("select event_id from events order by ts, event_id limit 100")
def head_sample(spark, d):
    return analytics.head_sample(_t(spark, d, "events"), 100, ["ts", "event_id"]).select("event_id")


@query()
def hash_sample(spark, d):
    return analytics.hash_sample(_t(spark, d, "events"), 100, "event_id").select("event_id")


_RANKED = "r as (select doc_id % 50 as q, quality as label, row_number() over (partition by doc_id % 50 order by sin(doc_id) desc, quality desc) as rank from labels), i as (select *, row_number() over (partition by q order by label desc, rank) as ideal from r)"


@query("with " + _RANKED + """, p as (select q, max(case when label > 0 and rank <= 10 then 1 else 0 end) as recall, min(case when label > 0 and rank <= 10 then rank end) as first, sum(case when rank <= 10 then (2 ** label - 1) / log2(rank + 1) else 0 end) as dcg,
       sum(case when ideal <= 10 then (2 ** label - 1) / log2(ideal + 1) else 0 end) as idcg from i group by 1)
       select count(*) as n_queries, round(avg(recall), 6) as recall, round(avg(coalesce(1.0 / first, 0)), 6) as mrr, round(avg(case when idcg > 0 then dcg / idcg else 0 end), 6) as ndcg from p""")
def retrieval_metrics(spark, d):
    scores = _t(spark, d, "labels").select((F.col("doc_id") % 50).alias("query_id"), F.col("quality").alias("label"), F.sin("doc_id").alias("score"))
    return _rounded(analytics.retrieval_metrics(analytics.rank_triplets(scores), 10), "recall", "mrr", "ndcg")


@query("select count(*) as n_hard, round(avg(case when toxic >= quality then 1.0 else 0.0 end), 6) as hard_negative_error_rate from labels where doc_id % 3 = 0")
def hard_negative_error(spark, d):
    rows = _t(spark, d, "labels").select(F.col("quality").alias("positive"), F.col("toxic").alias("negative"), F.when(F.col("doc_id") % 3 == 0, "Hard-negative").otherwise("easy").alias("difficulty"))
    return _rounded(analytics.hard_negative_error(rows), "hard_negative_error_rate")


@query("""with m as (select i as month, 1000.0 * pow(1.05, i) as jobs from range(36) t(i)), s as (select month, jobs, sum(jobs * 0.01) over (order by month) as total_gb from m)
          select month, round(jobs, 6) as jobs, round(total_gb, 6) as total_gb, round(greatest(least(total_gb, 50) - 0, 0) * 0.023 + greatest(least(total_gb, 500) - 50, 0) * 0.022 + greatest(least(total_gb, 1e18) - 500, 0) * 0.021, 6) as monthly_cost from s""")
def storage_projection(spark, d):
    tiers = [(0.0, 50.0, 0.023), (50.0, 500.0, 0.022), (500.0, 1e18, 0.021)]
    return _rounded(analytics.storage_projection(spark, 36, 0.05, 1000.0, 0.01, tiers), "jobs", "total_gb", "monthly_cost")


@query("""with m as (select strftime(range, '%Y-%m') as month from range(date '2025-01-01', date '2027-01-01', interval 1 month))
          select month, case when month >= '2026-06' then 0.5::double when month >= '2025-09' then 0.8 else 1.2 end as price from m""")
def step_price(spark, d):
    months = spark.range(24).select(F.date_format(F.add_months(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM").alias("month"))
    return months.select("month", analytics.step_price(F.col("month"), [("2025-01", 1.2), ("2025-09", 0.8), ("2026-06", 0.5)]).alias("price"))


@query("""with a as (select o_orderpriority as label, avg(o_totalprice) as v from orders where o_orderstatus = 'P' and o_orderpriority <> '5-LOW' group by 1), b as (select o_orderpriority as label, avg(o_totalprice) as v from orders where o_orderstatus = 'F' and o_orderpriority <> '2-HIGH' group by 1)
          select coalesce(a.label, b.label) as label, round(coalesce(a.v, 0), 4) as v_first, round(coalesce(b.v, 0), 4) as v_last from a full outer join b on a.label = b.label""")
def label_union(spark, d):
    at = lambda status, but: _t(spark, d, "orders").where((F.col("o_orderstatus") == status) & (F.col("o_orderpriority") != but)).groupBy(F.col("o_orderpriority").alias("label")).agg(F.avg("o_totalprice").alias("v"))
    found = analytics.label_union(at("P", "5-LOW"), at("F", "2-HIGH"), "label", "v")
    return found.select("label", _r("v_first", 4).alias("v_first"), _r("v_last", 4).alias("v_last"))


@query("""with c as (select user_id % 5 as cluster_id, event_type as title, count(*) as c from events group by 1, 2), r as (select *, row_number() over (partition by cluster_id order by c desc, title) as r from c)
          select cluster_id, sum(c)::bigint as n_jobs, string_agg(title, '; ' order by r) filter (where r <= 3) as titles from r group by 1""")
def cluster_titles(spark, d):
    return clusters.cluster_titles(_t(spark, d, "events").select((F.col("user_id") % 5).alias("cluster_id"), F.col("event_type").alias("title")), n=3)


@query("with " + _PAY + """, b as (select month, count(*) as n_jobs, count(*) filter (usable) as n_salary_jobs from u group by 1)
       select month, n_jobs, n_salary_jobs, round(n_salary_jobs / n_jobs, 6) as salary_coverage, n_salary_jobs < 100 as low_support, round((select sum(n_salary_jobs) / sum(n_jobs) from b), 6) as overall_coverage from b""")
def salary_coverage_plot(spark, d):
    by = analytics.salary_weights(_paid(spark, d)).groupBy("month").agg(F.count("*").alias("n_jobs"), F.count_if("salary_usable").alias("n_salary_jobs"))
    return _rounded(analytics.salary_coverage_plot(by.withColumn("salary_coverage", F.col("n_salary_jobs") / F.col("n_jobs")), 100), "salary_coverage", "overall_coverage")


@query("""select doc_id from (select d.doc_id from documents d left join labels l using (doc_id) where trim(coalesce(case when d.doc_id % 3 = 0 then '' else lang end, '')) = '' or coalesce(l.toxic = 1, true)) order by 1 limit 50""")
def enrichment_candidates(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("skills"))
    marks = _t(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_uncertain"))
    return analytics.enrichment_candidates(docs, marks, "skills", 50, "doc_id").select("doc_id")


@query()
def projection_2d(spark, d):
    return models.projection_2d(_t(spark, d, "embeddings"), "vec_id", "embedding")


@query("select conv_id, turn, sha256(coalesce(text, '')) as digest, length(text)::int as n from conversations")
def text_digest(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.length("text").alias("n"))


# --- whole runs -------------------------------------------------------------


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """The documents as postings of five months, with skills and salaries of a sort."""
    c, i = F.col, F.col("doc_id")
    month = F.add_months(F.lit("2024-01-01").cast("date"), (i % 5).cast("int"))
    return _t(spark, d, "documents").select(
        i.alias("job_id"), c("source").alias("title"), c("text").alias("description"), c("text").alias("job_card_text"), F.concat("lang", F.lit(", "), "source").alias("skills_text"),
        F.date_format(F.date_add(month, (i % 28).cast("int")), "yyyy-MM-dd").alias("listed_time"), F.when(i % 3 > 0, F.date_format(F.date_add(month, (i % 28 + i % 40).cast("int")), "yyyy-MM-dd")).alias("closed_time"),
        F.when(i % 4 > 0, (c("n_chars") * 10 + 20_000).cast("double")).alias("normalized_salary"), F.lit("USD").alias("currency"), F.lit("YEARLY").alias("pay_period"),
    )


def temporal_demo_run(spark: SparkSession, d: str, copies: int = 1) -> pipelines.Run:
    """The run over all jobs; ``copies`` repeats them under ids of their own, for a benchmark of larger tables."""
    jobs = _jobs(spark, d)
    if copies > 1:
        many = spark.range(copies).withColumnRenamed("id", "copy")
        jobs = jobs.crossJoin(F.broadcast(many)).withColumn("job_id", F.col("job_id") + F.col("copy") * 1_000_000_000).drop("copy")
    return pipelines.temporal_demo(jobs, salary=True)


def temporal_clusters_run(spark: SparkSession, d: str) -> pipelines.Run:
    return pipelines.temporal_clusters(_jobs(spark, d), k=12, size="D")


def skill_evolution_run(spark: SparkSession, d: str) -> pipelines.Run:
    return pipelines.skill_evolution(_jobs(spark, d), size="D")


#: Whole runs, all tables of which a benchmark writes; the queries below return what SQL can check of them.
RUNS = {"run_temporal_demo": temporal_demo_run, "run_temporal_clusters": temporal_clusters_run, "run_skill_evolution": skill_evolution_run, "run_temporal_demo_100k": lambda spark, d: temporal_demo_run(spark, d, 10)}
_DAY = "(date '2024-01-01' + to_months((doc_id % 5)::int) + to_days((doc_id % 28)::int))"


@query("""with s as (select doc_id % 5 as m, unnest([lower(trim(lang)), lower(trim(source))]) as skill from documents where lang is not null and source is not null),
          c as (select skill, count(*) filter (m = (select min(m) from s)) as a, count(*) filter (m = (select max(m) from s)) as b from s where skill <> '' group by 1), t as (select sum(a) as ta, sum(b) as tb from c)
          select skill, a as first_count, b as last_count, round(a / ta, 6) as first_share, round(b / tb, 6) as last_share, round(b / tb - a / ta, 6) as share_delta, case when b / tb - a / ta >= 0 then 'rising' else 'declining' end as trend from c, t where a + b > 0""")
def run_temporal_demo(spark, d):
    """Skill growth of the run."""
    found = temporal_demo_run(spark, d).tables["growth"].select("skill", "first_count", "last_count", "first_share", "last_share", "share_delta", "trend")
    return _rounded(found, "first_share", "last_share", "share_delta")


@query("""with j as (select doc_id % 5 as m, doc_id % 4 > 0 and n_chars * 10 + 20000 > 0 as paid from documents), c as (select m, count(*) as n, count(*) filter (paid) as p from j group by 1), s as (select *, lag(m) over (order by m) as pm, lag(n) over (order by m) as pn, lag(p) over (order by m) as pp from c)
          select strftime(date '2024-01-01' + to_months(m::int), '%Y-%m') as month, strftime(date '2024-01-01' + to_months(pm::int), '%Y-%m') as previous_month, pn as n_from, n as n_to, pp as n_salary_from, p as n_salary_to, round(pp / pn, 6) as salary_coverage_from, round(p / n, 6) as salary_coverage_to, true as drifts from s where pm is not null""")
def run_salary_drift(spark, d):
    """Bins, counts and coverages of the run's salary-weighted drift; the drift itself only lies in its range."""
    found = temporal_demo_run(spark, d).tables["salary_drift"].withColumn("drifts", F.col("centroid_drift").between(0.0, 2.0))
    return _rounded(found.drop("centroid_drift", "cosine_similarity"), "salary_coverage_from", "salary_coverage_to")


@query("select strftime(" + _DAY + """, '%Y-%m-%d') as time_bin, count(*) as n_jobs, 1.0::double as share_jobs, count(*) filter (doc_id % 4 > 0) as n_with_salary, count(*) filter (trim(lang || ', ' || source) <> '') as n_with_skills from documents group by 1""")
def run_temporal_clusters(spark, d):
    """The run's metrics summed over clusters, whatever these are."""
    found = temporal_clusters_run(spark, d).tables["metrics"]
    found = found.groupBy("time_bin").agg(*(F.sum(c).alias(c) for c in ("n_jobs", "share_jobs", "n_with_salary", "n_with_skills")))
    return _rounded(found, "share_jobs")


@query("""with s as (select distinct doc_id, strftime(""" + _DAY + """, '%Y-%m-%d') as time_bin, lower(trim(unnest([lang, source]))) as skill from documents where lang is not null and source is not null)
          select time_bin, skill, count(*) as skill_job_count from s where skill <> '' group by 1, 2""")
def run_skill_evolution(spark, d):
    """The run's skill counts summed over domains, whichever these are, with names in lower case."""
    found = skill_evolution_run(spark, d).tables["shares"]
    return found.groupBy("time_bin", F.lower("skill").alias("skill")).agg(F.sum("skill_job_count").alias("skill_job_count"))


@query("""select distinct job_id, skill from (select doc_id as job_id, case lower(trim(lang)) when 'r' then 'R' else upper(trim(lang))[1] || lower(trim(lang))[2:] end as skill from documents where trim(coalesce(lang, '')) <> ''
          union all select doc_id, case quality when 1 then 'Good' else 'Poor' end from labels union all select doc_id, 'En' from labels)""")
def append_skills(spark, d):
    docs, marks = _t(spark, d, "documents").withColumnRenamed("doc_id", "job_id"), _t(spark, d, "labels")
    more = marks.select(F.explode(F.array(F.when(F.col("quality") == 1, "Good").otherwise("Poor"), F.lit("En"))).alias("skill"), F.col("doc_id").alias("job_id"))
    return skills.append_skills(skills.skill_long(docs, "lang"), more)


def _hits(words: list[str]) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)


_ASSIGNED = "t as (select doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[/;|]', ' ', 'g'), '\\s+', ' ', 'g')) as low from documents), k as (select doc_id, [" + ", ".join(f"{{'s': {_hits(v[1])}, 'o': {-i}, 'd': '{n}'}}" for i, (n, v) in enumerate(skills.DOMAINS.items())) + "] as every from t), a as (select doc_id, list_max(every) as best from k)"


@query("with " + _ASSIGNED + """ select doc_id, best.s::int as keyword_score, case when best.s > 0 then best.d else 'health' end as domain, case when best.s >= 1 then 'keyword_fallback' else 'embedding' end as domain_source from a""")
def domain_assignment(spark, d):
    """Domains by keywords alone: without vectors every similarity is 0."""
    found = skills.assign_domains(_t(spark, d, "documents").select("doc_id", "text"), None, None, F.col("text"))
    return found.select("doc_id", "keyword_score", "domain", "domain_source")


@query("with " + _ASSIGNED + ", c as (select case when best.s > 0 then best.d else 'health' end as domain, doc_id from a), e as (select unnest([" + ", ".join(f"'{n}'" for n in skills.DOMAINS) + """]) as domain)
       select e.domain, count(doc_id) as n_jobs, count(doc_id) as n_uncertain from e left join c on c.domain = e.domain group by 1""")
def domain_counts(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("job_id"), "text")
    return skills.domain_counts(skills.assign_domains(docs, None, None, F.col("text"))).select("domain", "n_jobs", "n_uncertain")
