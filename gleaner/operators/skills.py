"""Skills and domains over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_text, split_evolution, split_growth
from ..functions.vector import dot

# The domains, in the order that breaks ties, with keywords and prompts.
DOMAINS = {
    "health": ("Health", ["patient", "nursing", "nurse", "medical", "clinic", "health care", "healthcare", "health", "hospital", "pharmacy", "physician", "therapy"], "Jobs in health care, hospitals, clinics, nursing, patient care, pharmacy, medical operations, therapy, public health, and clinical support."),
    "tech": ("Tech", ["software", "developer", "engineer", "information technology", "technology", "data", "python", "sql", "cloud", "machine learning", "cybersecurity", "devops"], "Jobs in software engineering, data science, analytics, cloud infrastructure, cybersecurity, IT, product engineering, and developer tools."),
    "construction_industry": ("Construction/Industry", ["construction", "manufacturing", "industrial", "warehouse", "logistics", "maintenance", "machinery", "site", "contractor", "safety", "electrical", "mechanical", "plant", "operator"], "Jobs in construction, industrial operations, manufacturing, logistics, maintenance, plant operations, trades, site safety, and engineering operations."),
    "education": ("Education", ["education", "students", "student", "teacher", "teaching", "school", "training", "curriculum", "classroom", "academic", "instructor", "learning"], "Jobs in education, schools, universities, teaching, curriculum, learning programs, academic administration, training, and student services."),
    "sales": ("Sales", ["sales", "business development", "customer service", "account", "revenue", "client", "crm", "lead generation", "retail", "territory", "quota"], "Jobs in sales, business development, account management, retail sales, customer success, revenue operations, client growth, and CRM workflows."),
}


def skill_growth(df: DataFrame, skills: str, month: str = "month") -> DataFrame:
    """Counts and shares of each skill's mentions in the first and the last month, and their difference.

    The endpoints are the first and last month that have rows at all. Shares
    are of the month's mentions. One scan: conditional counts, no join of
    months; always the full schema.
    """
    rows = df.where(F.col(month).isNotNull())
    ends = rows.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    long = rows.select(month, F.explode(split_growth(F.col(skills))).alias("skill")).crossJoin(F.broadcast(ends))
    long = long.where((F.col(month) == F.col("first_month")) | (F.col(month) == F.col("last_month")))
    counts = long.groupBy("skill", "first_month", "last_month").agg(F.count_if(F.col(month) == F.col("first_month")).alias("first_count"), F.count_if(F.col(month) == F.col("last_month")).alias("last_count"))
    totals = counts.agg(F.sum("first_count").alias("t0"), F.sum("last_count").alias("t1"))
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0)
    out = counts.crossJoin(F.broadcast(totals)).withColumns({"first_share": share("first_count", "t0"), "last_share": share("last_count", "t1")})
    out = out.withColumn("share_delta", F.col("last_share") - F.col("first_share"))
    out = out.withColumn("trend", F.when(F.col("share_delta") >= 0, "rising").otherwise("declining"))
    return out.select("skill", "first_month", "last_month", "first_count", "last_count", "first_share", "last_share", "share_delta", "trend")


def skill_long(df: DataFrame, skills: str | None, id_col: str = "job_id") -> DataFrame:
    """``(id, skill)``: a row for each distinct normalised skill of a job."""
    if skills is None or skills not in df.columns:
        return df.select(id_col, F.lit(None).cast("string").alias("skill")).where(F.lit(False))
    return df.select(id_col, F.explode(split_evolution(F.col(skills))).alias("skill"))


def append_skills(long: DataFrame, more: DataFrame) -> DataFrame:
    """The ``(id, skill)`` rows of both tables, each pair once; columns are matched by name."""
    return long.unionByName(more.select(*long.columns)).distinct()


def keyword_scores(text: Column) -> Column:
    """The keyword score of each domain, in their order, in a ``keyword_text``; as ``keyword_score``, with all keywords counted in one pass over the rows."""
    words = [w for _, w, _ in DOMAINS.values()]

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[sum(map(t.count, of)) for of in words] for t in texts.fillna("")], dtype=object)

    return run(text)


def keyword_domain(text: Column) -> Column:
    """Struct ``(score, order, domain)`` of the largest keyword score in a ``keyword_text``; the first domain of equals.

    It isn't wrapped in another struct: the optimiser would copy the scores to wherever a field is read.
    """
    scores = keyword_scores(text)
    return F.greatest(*(F.struct(scores[i].alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("domain")) for i, name in enumerate(DOMAINS)))


def assign_domains(df: DataFrame, vector: str | None, prompts: dict[str, list[float]] | None, text: Column, confidence: float = 0.15, margin: float = 0.03) -> DataFrame:
    """``df`` with the domain of each row: by the nearest prompt vector, or by keywords where those are stronger.

    Keywords win if they score 2, or 1 while the similarity is below
    ``confidence``. A row is uncertain if the similarity is, or is less than
    ``margin`` above the second. Without vectors all similarities are 0.
    """
    names = list(DOMAINS)
    near = [dot(F.col(vector), F.array(*(F.lit(float(x)) for x in prompts[n]))) if vector and prompts else F.lit(0.0) for n in names]
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("d")) for i, (n, s) in enumerate(zip(names, near, strict=True))))))
    out = df.withColumn("__r", ranked).withColumn("__k", keyword_domain(keyword_text(text)))
    best, second, kw = F.col("__r")[0]["s"], F.col("__r")[1]["s"], F.col("__k.score")
    by_keyword = (kw >= 2) | ((kw >= 1) & (best < confidence))
    labels = F.create_map(*(F.lit(x) for n, v in DOMAINS.items() for x in (n, v[0])))
    out = out.withColumns({
        "domain_score": best, "domain_margin": best - second, "embedding_domain": F.col("__r")[0]["d"],
        "keyword_domain": F.when(kw > 0, F.col("__k.domain")), "keyword_score": kw,
        # never null, and known to be: a join on it would otherwise filter by it first, and so count the keywords twice
        "domain": F.coalesce(F.when(by_keyword, F.col("__k.domain")).otherwise(F.col("__r")[0]["d"]), F.lit(names[0])),
        "domain_source": F.when(by_keyword, "keyword_fallback").otherwise("embedding"),
        "is_uncertain": (best < confidence) | (best - second < margin),
    })
    return out.withColumn("domain_label", labels[F.col("domain")]).drop("__r", "__k")


def domain_bins(jobs: DataFrame, spark_domains: list[str] | None = None) -> DataFrame:
    """``(domain, time_bin, job_count)``: distinct jobs, zero for combinations without any."""
    names = spark_domains or list(DOMAINS)
    counts = jobs.groupBy("domain", "time_bin").agg(F.countDistinct("job_id").alias("n"))
    bins = jobs.where("time_bin is not null").select("time_bin").distinct()
    grid = bins.withColumn("domain", F.explode(F.array(*map(F.lit, names))))
    return grid.join(counts, ["domain", "time_bin"], "left").select("domain", "time_bin", F.coalesce("n", F.lit(0)).cast("long").alias("job_count"))


def domain_skill_share(skills: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(domain, time_bin, skill, skill_job_count, job_count, share_pct)``: distinct jobs with a skill among a domain's in a bin."""
    known = skills.join(jobs.select("job_id", "domain", "time_bin"), "job_id").where("skill is not null and time_bin is not null and domain is not null")
    counts = known.groupBy("domain", "time_bin", "skill").agg(F.countDistinct("job_id").alias("skill_job_count"))
    totals = jobs.where("domain is not null and time_bin is not null").groupBy("domain", "time_bin").agg(F.countDistinct("job_id").alias("job_count"))
    share = F.when(F.col("job_count") > 0, 100.0 * F.col("skill_job_count") / F.col("job_count")).otherwise(0.0)
    return counts.join(totals, ["domain", "time_bin"], "left").withColumn("share_pct", F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)))


def domain_counts(jobs: DataFrame) -> DataFrame:
    """``(domain, domain_label, n_jobs, n_uncertain)`` of every domain, with zeros for those without a job."""
    spark = jobs.sparkSession
    every = spark.createDataFrame([(d, v[0]) for d, v in DOMAINS.items()], "domain string, domain_label string")
    found = jobs.groupBy("domain").agg(F.countDistinct("job_id").alias("n"), F.count_if("is_uncertain").alias("u"))
    return every.join(F.broadcast(found), "domain", "left").select("domain", "domain_label", F.coalesce("n", F.lit(0)).cast("long").alias("n_jobs"), F.coalesce("u", F.lit(0)).cast("long").alias("n_uncertain"))


def top_skills(shares: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n skills of the largest summed counts (for each ``by``), ties by name, with ``total`` and ``rank``."""
    keys = by or []
    sums = shares.groupBy(*keys, "skill").agg(F.sum("skill_job_count").alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), "skill")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def skill_composition(shares: DataFrame, n: int = 5, low_support: int = 100) -> DataFrame:
    """Shares of each bin's mentions by top skill and ``Other`` (rank 0); they sum to 1. Absent top skills have zero rows."""
    best = top_skills(shares, n).where("lower(skill) <> 'other'").select("skill", "rank")
    bins = shares.groupBy("time_bin").agg(F.sum("skill_job_count").alias("all"), F.max("job_count").alias("job_count")).where("all > 0")
    named = shares.join(F.broadcast(best), "skill", "left").select("time_bin", F.coalesce(F.when(F.col("rank").isNotNull(), F.col("skill")), F.lit("Other")).alias("skill"), "skill_job_count")
    counts = named.groupBy("time_bin", "skill").agg(F.sum("skill_job_count").alias("n"))
    slots = best.unionByName(best.sparkSession.createDataFrame([("Other", 0)], "skill string, rank int"))
    grid = bins.crossJoin(F.broadcast(slots)).join(counts, ["time_bin", "skill"], "left")
    out = grid.withColumn("skill_job_count", F.coalesce("n", F.lit(0)).cast("double"))
    return out.select("time_bin", "skill", "rank", "skill_job_count", (F.col("skill_job_count") / F.col("all")).alias("composition_share"), "job_count", (F.col("job_count") < low_support).alias("low_support"))
