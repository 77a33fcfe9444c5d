"""The clean jobs table: skills and salaries collapsed per job, joined, with a text card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import POSTINGS_OPTIONAL, SALARIES_OPTIONAL, SILVER_REQUIRED, TEMPORAL
from ..functions.text import job_card, non_empty, strip


def skills_text(job_skills: DataFrame, mapping: DataFrame, position: str = "pos") -> DataFrame:
    """``(job_id, skills_text)``: a job's distinct skill names in order of ``position``, joined by ``, ``.

    Skills without a name are named by their abbreviation's mapping only, so
    they are left out. The mapping is joined by whatever strategy its size
    allows; the aggregate is one shuffle on job_id.
    """
    named = job_skills.join(mapping.select("skill_abr", "skill_name"), "skill_abr", "left").where("skill_name is not null")
    first = named.groupBy("job_id", "skill_name").agg(F.min(position).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "skill_name")))
    return first.groupBy("job_id").agg(F.array_join(F.transform(ordered, lambda x: x["skill_name"]), ", ").alias("skills_text"))


def collapse_salaries(salaries: DataFrame, position: str = "pos") -> DataFrame:
    """One row for each job: the largest of each amount, the first non-blank of each text in order of ``position``."""
    amounts = [c for c in SALARIES_OPTIONAL[:3] if c in salaries.columns]
    texts = [c for c in SALARIES_OPTIONAL[3:] if c in salaries.columns]
    if not amounts and not texts:
        return salaries.select("job_id").distinct()
    return salaries.groupBy("job_id").agg(
        *(F.max(F.col(c).try_cast("double")).alias(c) for c in amounts),
        *(F.min_by(F.when(non_empty(F.col(c)), F.col(c)), F.when(non_empty(F.col(c)), F.col(position))).alias(c) for c in texts),
    )


def build_silver(postings: DataFrame, job_skills: DataFrame, mapping: DataFrame, salaries: DataFrame | None = None) -> DataFrame:
    """Postings with skills, salary columns and ``job_card_text``; rows with a blank card are dropped."""
    optional = [c for c in POSTINGS_OPTIONAL if c in postings.columns]
    clean = {"title": strip(F.col("title")), "description": strip(F.col("description")), "job_id": F.col("job_id").cast("long")}
    clean |= {c: strip(F.col(c)) for c in optional if c not in TEMPORAL} | {c: F.col(c).try_cast("double") for c in optional if c in TEMPORAL}
    jobs = postings.withColumns(clean)
    skills = skills_text(job_skills, mapping).withColumn("job_id", F.col("job_id").cast("long"))
    jobs = jobs.join(skills, "job_id", "left").withColumn("skills_text", F.coalesce("skills_text", F.lit("")))
    added: list[str] = []
    if salaries is not None:
        pay = collapse_salaries(salaries).withColumn("job_id", F.col("job_id").cast("long"))
        added = [c for c in SALARIES_OPTIONAL if c in pay.columns]
        if added:
            jobs = jobs.drop(*added).join(pay.select("job_id", *added), "job_id", "left")
    blank = F.lit("")
    have = lambda c: F.col(c) if c in jobs.columns else blank
    jobs = jobs.withColumn("job_card_text", job_card(F.col("title"), have("formatted_experience_level"), have("formatted_work_type"), have("location"), F.col("skills_text"), F.col("description")))
    keep = list(dict.fromkeys([*SILVER_REQUIRED, *(c for c in optional if c not in added), *added]))
    return jobs.select(*(c for c in keep if c in jobs.columns)).where(non_empty(F.col("job_card_text")))


def keep_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The children whose key is among the parents': a sample that keeps foreign keys whole."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
