"""Command line: one subcommand for each run."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import reports
from .operators import analytics, models, profile, sparse, vectors
from .plans import pipelines
from .session import session
from .sources import tables

RUNS = ("build-silver", "build-tfidf", "recommend", "build-embeddings", "recommend-dense", "temporal-audit", "temporal-demo", "temporal-clusters", "profile-silver", "skill-evolution", "evaluate")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner")
    p.add_argument("run", choices=RUNS)
    p.add_argument("--input", required=True, help="folder of CSV files, a Parquet table, or an artefact's folder")
    p.add_argument("--output", default="out")
    p.add_argument("--config", default=None)
    p.add_argument("--job-id", type=int)
    p.add_argument("--top-k", type=int, default=None)
    p.add_argument("--time-column", default=None)
    p.add_argument("--closure-column", default=None)
    p.add_argument("--bin", default="M", choices=["H", "D", "W", "M"])
    p.add_argument("--k", type=int, default=12)
    p.add_argument("--max-rows", type=int, default=None)
    p.add_argument("--min-jobs", type=int, default=1)
    p.add_argument("--confidence", type=float, default=0.15)
    p.add_argument("--margin", type=float, default=0.03)
    p.add_argument("--sampling", default="temporal-stride", choices=["temporal-stride", "random", "head"])
    p.add_argument("--representation", default="tfidf_svd", choices=["tfidf_svd", "semantic_embeddings"])
    p.add_argument("--encoder", default=None)
    p.add_argument("--model", default="")
    p.add_argument("--salary-weighting", action="store_true")
    p.add_argument("--compare", default=None, help="output folder of an earlier temporal-demo, for a note on how the drift differs")
    p.add_argument("--export", default=None, choices=["csv", "json"], help="also write each table in this format")
    p.add_argument("--table-prefix", default=None, help="also save each table to the catalog, under this prefix and its name")
    return p


def vectoriser(config: dict) -> sparse.Config:
    """The retrieval vectoriser with what a configuration file says: max_features, ngram_range, sublinear_tf, min_df, max_df, stop_words."""
    said = dict(config.get("tfidf") or {})
    if "ngram_range" in said:
        low, high = said.pop("ngram_range")
        if (low, high) not in ((1, 1), (1, 2)):
            raise ValueError(f"unsupported ngram_range {[low, high]}")
        said["bigrams"] = high == 2
    if "sublinear_tf" in said:
        said["sublinear"] = said.pop("sublinear_tf")
    if "stop_words" in said:
        said["stop_words"] = tuple(said["stop_words"] or ())
    if unknown := sorted(set(said) - set(sparse.Config.__dataclass_fields__)):
        raise ValueError(f"unknown tfidf settings: {unknown}")
    return replace(sparse.RETRIEVAL, **said)


def _save(run: pipelines.Run, a: argparse.Namespace, began: float, spark: SparkSession, rows: int | None = None) -> dict:
    outputs = {}
    for table, df in run.tables.items():
        df.write.mode("overwrite").parquet(f"{a.output}/{table}")
        made = spark.read.parquet(f"{a.output}/{table}")
        outputs[table] = {"rows": made.count(), "path": f"{a.output}/{table}"}
        if a.export:
            tables.export(made, f"{a.output}/{table}.{a.export}", a.export)
        if a.table_prefix:
            made.write.mode("overwrite").saveAsTable(f"{a.table_prefix}{table}")
    meta = tables.manifest(a.run, a.input, rows, outputs, **reports.provenance(round(time.time() - began, 2)), tables=sorted(run.tables), **run.meta)
    if a.run in reports.REPORTS:
        more = ()
        if a.run == "temporal-demo" and a.compare:
            more = (reports.comparison_note(spark.read.parquet(f"{a.compare}/drift"), spark.read.parquet(f"{a.output}/drift")),)
        _text(spark, reports.REPORTS[a.run](run, *more), f"{a.output}/report")
    _text(spark, json.dumps(meta, default=str), f"{a.output}/manifest")
    return meta


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs a command; returns what it prints, as JSON, to standard output."""
    a = parser().parse_args(argv)
    spark = spark or session()
    began = time.time()
    config = tables.load_config(a.config)
    if level := (config.get("logging") or {}).get("level"):
        spark.sparkContext.setLogLevel("WARN" if level == "WARNING" else level)
    k = a.top_k or (config.get("retrieval") or {}).get("top_k_default", 10)
    read = lambda: spark.read.parquet(a.input)
    save = lambda run, rows=None: _save(run, a, began, spark, rows)
    if a.run == "build-silver":
        result = save(pipelines.Run({"jobs": pipelines.silver(spark, a.input)}, {"config": config}), tables.postings(spark, a.input).count())
    elif a.run == "build-tfidf":
        result = save(pipelines.build_tfidf(read(), vectoriser(config)), read().count())
    elif a.run == "build-embeddings":
        coder = models.encoder(a.encoder or "mock", a.model)
        jobs = analytics.hash_sample(read(), a.max_rows, "job_id") if a.max_rows else read()
        made = coder.encode(jobs.select("job_id", "job_card_text"), "job_card_text").select("job_id", F.col("embedding").cast("array<float>").alias("embedding"))
        result = save(pipelines.Run({"embeddings": made}, {"backend": coder.name, "model": coder.model, "dim": coder.dim}), jobs.count())
        if result["outputs"]["embeddings"]["rows"] != result["input_rows"]:
            raise ValueError(f"{result['outputs']['embeddings']['rows']} embeddings of {result['input_rows']} rows")
    elif a.run in ("recommend", "recommend-dense"):
        if a.run == "recommend":
            ids = spark.read.parquet(f"{a.input}/ids")
            if ids.where(F.col("job_id") == a.job_id).isEmpty():
                raise KeyError(a.job_id)
            found = sparse.sparse_top_k(spark.read.parquet(f"{a.input}/postings"), ids, a.job_id, k, "job_id")
        else:
            found = vectors.top_k(spark.read.parquet(f"{a.input}/embeddings"), a.job_id, k, "job_id", "embedding")
        result = {"query": a.job_id, "results": [{"rank": r["rank"], "job_id": r["job_id"], "score": round(r["score"], 6)} for r in found.orderBy("rank").collect()]}
    elif a.run == "profile-silver":
        result = profile.profile(read())
    elif a.run == "temporal-audit":
        result = save(pipelines.audit_run(read(), a.time_column or "listed_time"), read().count())
    elif a.run == "temporal-demo":
        coder = models.encoder(a.encoder or "mock", a.model) if a.representation != "tfidf_svd" else None
        result = save(pipelines.temporal_demo(read(), a.time_column or "listed_time", a.bin, a.max_rows, a.sampling, a.min_jobs, a.representation, coder, a.salary_weighting), read().count())
    elif a.run == "temporal-clusters":
        coder = models.encoder(a.encoder, a.model) if a.encoder else None
        result = save(pipelines.temporal_clusters(read(), a.k, a.bin, a.max_rows, a.time_column, a.closure_column, coder), read().count())
    elif a.run == "skill-evolution":
        result = save(pipelines.skill_evolution(read(), a.bin, a.max_rows, a.time_column, a.confidence, a.margin), read().count())
    else:
        result = evaluate(spark, a.input, a.top_k or 1, a.encoder or "buckets", a.model)
        _text(spark, reports.evaluation_report(result, a.top_k or 1), f"{a.output}/report")
    print(json.dumps(result, default=str))
    return result


def evaluate(spark: SparkSession, path: str, k: int, backend: str = "buckets", model: str = "") -> dict:
    """Recall, MRR, nDCG and hard-negative error of an encoder over triplets in JSON lines, with the latency of its batches.

    Every triplet is a query of its own, repeated ones too. Latencies are of
    the encoding of up to ``PROFILE_BATCHES`` batches of texts, one after another.
    """
    from .functions.vector import cosine

    coder = models.BucketEncoder() if backend == "buckets" else models.encoder(backend, model)
    if why := models.available(coder):
        raise RuntimeError(why)
    rows = tables.eval_triplets(spark, path).withColumn("query_id", F.monotonically_increasing_id()).cache()
    profile = reports.encode_profile(rows, ("anchor", "positive", "negative"), coder)
    for side in ("anchor", "positive", "negative"):
        rows = coder.encode(rows, side).withColumnRenamed("embedding", f"v_{side}")
    rows = rows.select("query_id", "difficulty", cosine(F.col("v_anchor"), F.col("v_positive"), 0.0).alias("positive"), cosine(F.col("v_anchor"), F.col("v_negative"), 0.0).alias("negative")).cache()
    scores = rows.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("positive").alias("score")), F.struct(F.lit(0).alias("label"), F.col("negative").alias("score")))).alias("x")).select("query_id", "x.*")
    found = analytics.retrieval_metrics(analytics.rank_triplets(scores), k).first().asDict() | analytics.hard_negative_error(rows).first().asDict()
    return {"backend": coder.name, "model_name": coder.model or "not_available", "device": getattr(coder, "device", "not_available"), "embedding_dim": coder.dim, **found, **profile}


if __name__ == "__main__":
    main()
