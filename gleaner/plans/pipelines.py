"""Whole runs: build the jobs table, and the three temporal analyses.

Every run returns its tables as lazy DataFrames with a dict of metadata; the
command line writes them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import detect
from ..functions.text import join_texts
from ..functions.time import time_bin, with_time
from ..lineage import pin
from ..operators import analytics, audit, clusters, lifecycle, models, skills, sparse, vectors
from ..operators.silver import build_silver
from ..sources import tables


@dataclass
class Run:
    """A run's tables by name, and what is reported about it."""

    tables: dict[str, DataFrame]
    meta: dict[str, Any] = field(default_factory=dict)


def silver(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs table from a folder of CSV files."""
    return build_silver(tables.postings(spark, folder), tables.job_skills(spark, folder), tables.skills_mapping(spark, folder), tables.salaries(spark, folder))


def build_tfidf(jobs: DataFrame, config: sparse.Config = sparse.RETRIEVAL) -> Run:
    """Postings of the text cards, the ids they stand for, and the vocabulary, with which new texts can be transformed."""
    _require(jobs, "job_id", "job_card_text")
    vocab = pin(sparse.fit(jobs, "job_id", "job_card_text", config))
    return Run({"postings": sparse.tfidf(jobs, "job_id", "job_card_text", config, vocab), "ids": jobs.select("job_id"), "vocabulary": vocab}, {"config": asdict(config)})


def transform_tfidf(spark: SparkSession, folder: str, jobs: DataFrame) -> DataFrame:
    """Postings of new texts by the model that ``build_tfidf`` wrote to ``folder``."""
    meta = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    config = sparse.Config(**{**meta["config"], "stop_words": tuple(meta["config"]["stop_words"])})
    return sparse.tfidf(jobs, "job_id", "job_card_text", config, spark.read.parquet(f"{folder}/vocabulary"))


def _require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing required columns: {missing}")


def _prepare(jobs: DataFrame, time_column: str, size: str, sample: int | None, mode: str) -> DataFrame:
    timed = with_time(jobs, time_column, "ts", strict=True).withColumn("month", time_bin(F.col("ts"), size))
    if sample:
        if mode == "temporal-stride":
            timed = analytics.stride_sample(timed, sample, "ts", "month", "job_id")
        elif mode == "random":
            timed = analytics.hash_sample(timed, sample, "job_id")
        elif mode == "head":
            timed = analytics.head_sample(timed, sample, ["job_id"])
        else:
            raise ValueError(f"unsupported sampling mode {mode!r}")
    return timed.where("ts is not null")


def temporal_demo(jobs: DataFrame, time_column: str = "listed_time", size: str = "M", sample: int | None = None, mode: str = "temporal-stride", min_jobs: int = 1, representation: str = "tfidf_svd", encoder: models.Encoder | None = None, salary: bool = False) -> Run:
    """Centroid drift, skill growth, and on demand the salary-weighted drift and diagnostic clusters."""
    rows = _prepare(jobs, time_column, size, sample, mode)
    sizes = rows.groupBy("month").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_jobs).select("month")
    whole = rows.join(F.broadcast(sizes), "month", "left_semi")  # one row for each time bin
    rows = whole.drop("job_card_text", "description").cache()  # texts are read from the input, and not held
    if representation == "tfidf_svd":
        docs = sparse.coded(whole.select("job_id", "job_card_text"), "job_id", "job_card_text", sparse.DRIFT)
        held = models.fit_svd(docs, "job_id").embed(rows, docs, "job_id").cache()
    else:
        coder = encoder or models.MockEncoder()
        held = coder.encode(whole, "job_card_text").withColumnRenamed("embedding", "vector").drop("job_card_text", "description").cache()
    centroids = vectors.normalized(vectors.mean_vectors(held, ["month"], "vector"))
    out = {
        "drift": vectors.drift(centroids, "month", keep_first=representation == "tfidf_svd").withColumnRenamed("n", "jobs_in_month"),
        "growth": skills.skill_growth(rows, "skills_text") if "skills_text" in jobs.columns else None,
        "similarity": vectors.similarity_pairs(held, "job_id", "vector"),
    }
    if salary:
        weighted = analytics.salary_weights(held)
        out["salary_drift"] = salary_drift(weighted)
        out["salary_summary"] = analytics.salary_summary(weighted)
    months = {r["month"]: r["rows"] for r in audit.volumes(rows, size=size).collect()}
    labelled, centre, note = clusters.diagnostic_clusters(held, "vector", "job_id")
    if note is None:
        labelled = labelled.select("job_id", "cluster_id", "title", "month").cache()
        out |= {"clusters": labelled, "cluster_centroids": centre, "cluster_titles": clusters.cluster_titles(labelled)}
    return Run({k: v for k, v in out.items() if v is not None}, {"rows": sum(months.values()), "rows_per_month": months, "reliability": audit.reliability(months), "cluster_note": note})


def salary_drift(weighted: DataFrame) -> DataFrame:
    """Drift of salary-weighted centroids, with jobs, salaried jobs and coverage of both months."""
    centres = vectors.normalized(vectors.mean_vectors(weighted.where("salary_weight is not null"), ["month"], "vector", F.col("salary_weight")))
    counts = weighted.groupBy("month").agg(F.count("*").alias("jobs"), F.count("salary_weight").alias("paid"))
    found = vectors.drift(centres.drop("n").join(F.broadcast(counts), "month"), "month", keep_first=False)  # a row for each bin
    before = counts.select(F.col("month").alias("previous_month"), F.col("jobs").alias("n_from"), F.col("paid").alias("n_salary_from"))
    found = found.join(F.broadcast(before), "previous_month").withColumnsRenamed({"jobs": "n_to", "paid": "n_salary_to"})
    return found.select(
        "month", "previous_month", "n_from", "n_to", "n_salary_from", "n_salary_to", (F.col("n_salary_from") / F.col("n_from")).alias("salary_coverage_from"),
        (F.col("n_salary_to") / F.col("n_to")).alias("salary_coverage_to"), "cosine_similarity", "centroid_drift",
    )


def temporal_clusters(jobs: DataFrame, k: int = 12, size: str = "D", max_rows: int | None = None, time_column: str | None = None, closure_column: str | None = None, encoder: models.Encoder | None = None) -> Run:
    """Fixed clusters of all rows through time, with labels, growth and decay."""
    found = detect(jobs, time_column, closure_column)
    rows = analytics.hash_sample(jobs, max_rows, "job_id") if max_rows else jobs
    rows = with_time(rows, found.time, "posted").withColumn("time_bin", time_bin(F.col("posted"), size))
    rows = rows.withColumn("__text", join_texts([F.col(c) for c in found.text]))
    texts = rows.select("job_id", "__text")
    used = {"job_id", "posted", "time_bin", found.time, found.skill, found.closure, found.last_seen, *found.salary}
    heavy = [c for c in ("__text", "job_card_text", *found.text) if c not in used]  # texts are read from the input, and not held
    asked, why = encoder, models.available(encoder)
    encoder = None if why else encoder
    if encoder is None:
        docs = sparse.coded(texts, "job_id", "__text", sparse.CLUSTERS)
        held = models.fit_svd(docs, "job_id").embed(rows.drop(*heavy), docs, "job_id").cache()
    else:
        docs = sparse.coded(texts, "job_id", "__text", sparse.LABELS)
        held = encoder.encode(rows, "__text").withColumnRenamed("embedding", "vector").drop(*heavy).cache()
    labelled, centroids = clusters.fit_clusters(held, "vector", k, "job_id")
    labelled = labelled.cache()
    labels = pin(clusters.label_clusters(labelled, sparse.coded_top_terms(docs, labelled, "job_id", "cluster_id"), found.skill))  # a row for each cluster
    metrics = clusters.cluster_metrics(labelled, "vector", centroids, labels, found.skill)
    out = {"labels": labels, "metrics": metrics, "growth": clusters.cluster_growth(metrics), "centroids": centroids}
    used = {"requested": "tfidf_svd" if asked is None else asked.name, "used": "tfidf_svd" if encoder is None else encoder.name, "model": getattr(encoder, "model", None), "fallback_reason": why}
    meta: dict[str, Any] = {"columns": found.__dict__, "decay": found.decay_available, "embedding": used}
    focus = clusters.focus_clusters(labels, list(clusters.FOCUS), 5)
    if size == "D" and focus:
        chosen = rows.sparkSession.createDataFrame([(f["cluster_id"], f["display_label"]) for f in focus], "cluster_id int, display_label string")
        out["focus_grid"] = clusters.daily_grid(metrics, chosen)
    if found.decay_available:
        end = found.closure or found.last_seen
        closed = with_time(labelled, end, "__end")
        spans = lifecycle.durations(closed, "posted", "__end" if found.closure else None, "__end")
        out |= {"durations": spans, "decay": lifecycle.exponential_decay(spans), "survival": lifecycle.observed_survival(spans)}
        if focus:
            out["focus_decay"] = clusters.focus_decay(focus, out["decay"])
    else:
        meta["decay_reason"] = "No closure, expiration, taken, or last-seen column was found."
    return Run(out, meta)


def skill_evolution(jobs: DataFrame, size: str = "M", max_rows: int | None = None, time_column: str | None = None, confidence: float = 0.15, margin: float = 0.03, top_n: int = 8) -> Run:
    """Domains of dated rows, and each skill's share of a domain's jobs in each bin."""
    found = detect(jobs, time_column)
    rows = analytics.hash_sample(jobs, max_rows, "job_id") if max_rows else jobs
    rows = with_time(rows, found.time, "posted").where("posted is not null").withColumn("time_bin", time_bin(F.col("posted"), size))
    rows = rows.withColumn("__text", join_texts([F.col(c) for c in found.text])).cache()
    vocab = pin(sparse.fit(rows, "job_id", "__text", sparse.CLUSTERS))
    docs = sparse.coded(rows, "job_id", "__text", sparse.CLUSTERS, vocab)
    svd = models.fit_svd(docs, "job_id")
    # the prompts are transformed by what the jobs have taught, and teach nothing themselves
    prompts = rows.sparkSession.createDataFrame([(d, p) for d, (_, _, p) in skills.DOMAINS.items()], "domain string, __text string")
    named = {r["domain"]: r["vector"] for r in svd.embed(prompts, sparse.doc_vectors(prompts, "domain", "__text", sparse.CLUSTERS, vocab), "domain").collect()}
    held = svd.embed(rows, docs, "job_id")
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("__text", found.skill) if c))
    jobs_in = skills.assign_domains(held, "vector", named, text, confidence, margin).drop("vector", "__text").persist()
    long = skills.skill_long(rows, found.skill)
    shares = skills.domain_skill_share(long, jobs_in).persist()
    return Run({"domains": jobs_in, "skills": long, "domain_counts": skills.domain_counts(jobs_in), "shares": shares, "composition": skills.skill_composition(shares, 5), "top_skills": skills.top_skills(shares, top_n, ["domain"])})


def audit_run(jobs: DataFrame, time_column: str = "listed_time") -> Run:
    found = audit.audit(jobs, time_column)
    return Run({k: v for k, v in found.items() if isinstance(v, DataFrame)}, found["summary"])


def markdown(df: DataFrame, columns: list[str], rows: int = 20) -> str:
    """A Markdown table of the first rows; pipes in cells are escaped."""
    text = lambda v: "" if v is None else (f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|")
    body = ["| " + " | ".join(text(r[c]) for c in columns) + " |" for r in df.select(*columns).limit(rows).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *body])
