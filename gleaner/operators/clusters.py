"""Fixed clusters: fitting, labels, and their metrics through time."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.salary import annual_salary, usd_or_blank
from ..functions.text import keyword_score, non_empty, split_cluster
from ..functions.time import bin_start
from ..functions.vector import cosine_distance, unit
from .vectors import mean_vectors

# Domains that focus clusters are chosen for; a repeated keyword weighs more.
FOCUS = {
    "health": ("Health", "#d62728", ["patient", "nursing", "nurse", "medical", "clinic", "health care", "healthcare", "health"]),
    "technology": ("Tech", "#1f77b4", ["software", "developer", "engineer", "engineering", "information technology", "technology", "data", "python", "sql"]),
    "sales": ("Sales", "#2ca02c", ["sales", "sales", "sales", "business", "business", "business development", "customer service", "account"]),
    "construction": ("Construction", "#ff7f0e", ["construction", "project management", "project", "building", "site", "contractor"]),
    "education": ("Education", "#9467bd", ["education", "students", "student", "teacher", "teaching", "school", "training"]),
}
OTHER = ("other", "Other", "#7f7f7f")


def fit_clusters(df: DataFrame, vector: str, k: int, id_col: str, seed: int = 42, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``cluster_id``, and ``(cluster_id, centroid)``: the best of some k-means fits.

    Clusters are numbered by size, then by centroid, so that ids don't depend
    on the fit's own order. k is at most the number of distinct vectors.
    """
    data = df.select(id_col, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))
    data = data.coalesce(df.sparkSession.sparkContext.defaultParallelism).persist()  # read some 150 times: as many tasks as cores
    k = max(1, min(k, data.select("features").distinct().limit(k).count()))
    fits = [KMeans(k=max(2, k), seed=seed + i, maxIter=50).fit(data) for i in range(tries)] if k > 1 else []
    spark = df.sparkSession
    if not fits:
        centre = mean_vectors(df.withColumn("cluster_id", F.lit(0)), ["cluster_id"], vector).select("cluster_id", unit(F.col("centroid")).alias("centroid"))
        return df.withColumn("cluster_id", F.lit(0)), centre
    best = min(fits, key=lambda m: m.summary.trainingCost)
    sizes, centres = best.summary.clusterSizes, [list(map(float, c)) for c in best.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))
    number = F.create_map(*(F.lit(x) for new, old in enumerate(order) for x in (old, new)))
    found = best.transform(data).select(F.col(id_col).alias("__id"), number[F.col("prediction")].alias("cluster_id"))
    table = spark.createDataFrame([(new, centres[old]) for new, old in enumerate(order)], "cluster_id int, centroid array<double>")
    return df.join(found, df[id_col] == found["__id"]).drop("__id"), table.withColumn("centroid", unit(F.col("centroid")))


def top_skill_text(df: DataFrame, keys: list[str], skills: str, n: int) -> DataFrame:
    """``keys`` and ``top_skills``: a group's n most frequent skills joined by ``; ``, ties by name."""
    counts = df.select(*keys, F.explode(split_cluster(F.col(skills))).alias("s")).groupBy(*keys, "s").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("c"), "s")
    best = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("r", "s")))  # n at most
    return best.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "; ").alias("top_skills"))


def label_clusters(df: DataFrame, terms: DataFrame, skills: str | None) -> DataFrame:
    """``(cluster_id, cluster_label, n_jobs, top_terms, top_skills)`` from ``(cluster_id, rank, term)``."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    named = terms.groupBy("cluster_id").agg(F.transform(ordered, lambda x: x["term"]).alias("t"))
    out = df.groupBy("cluster_id").agg(F.count("*").alias("n_jobs")).join(named, "cluster_id", "left")
    if skills:
        out = out.join(top_skill_text(df, ["cluster_id"], skills, 8), "cluster_id", "left")
    else:
        out = out.withColumn("top_skills", F.lit(""))
    words = F.coalesce("t", F.array().cast("array<string>"))
    label = F.when(F.size(words) > 0, F.format_string("C%02d | %s", F.col("cluster_id"), F.array_join(words, " / "))).otherwise(F.format_string("C%02d", F.col("cluster_id")))
    return out.select("cluster_id", label.alias("cluster_label"), "n_jobs", F.array_join(words, ", ").alias("top_terms"), F.coalesce("top_skills", F.lit("")).alias("top_skills"))


def cluster_metrics(df: DataFrame, vector: str | None, centroids: DataFrame | None, labels: DataFrame | None, skills: str | None) -> DataFrame:
    """Volume, share, salary, skills and drift of each cluster in each ``time_bin``; rows without a bin don't count."""
    rows = df.where("time_bin is not null")
    pay = F.when(usd_or_blank(df.columns), annual_salary(df.columns))
    with_skills = F.count_if(non_empty(F.col(skills))) if skills else F.lit(0).cast("long")
    keys = ["time_bin", "cluster_id"]
    out = rows.withColumn("__pay", pay).groupBy(*keys).agg(
        F.count("*").alias("n_jobs"), F.median("__pay").alias("salary_median"), F.avg("__pay").alias("salary_mean"), F.count("__pay").alias("n_with_salary"), with_skills.alias("n_with_skills")
    )
    out = out.withColumn("share_jobs", F.col("n_jobs") / F.sum("n_jobs").over(Window.partitionBy("time_bin")))
    out = out.withColumn("salary_coverage", F.col("n_with_salary") / F.col("n_jobs"))
    out = out.join(top_skill_text(rows, keys, skills, 5), keys, "left") if skills else out.withColumn("top_skills", F.lit(""))
    out = out.withColumn("top_skills", F.coalesce("top_skills", F.lit("")))
    if vector:
        centres = mean_vectors(rows, keys, vector).select(*keys, F.col("centroid").alias("__c"))
        before = F.lag("__c").over(Window.partitionBy("cluster_id").orderBy("time_bin"))
        centres = centres.withColumn("centroid_drift_from_previous_bin", F.when(before.isNotNull(), cosine_distance(before, F.col("__c"))))
        if centroids is not None:
            centres = centres.join(F.broadcast(centroids.select("cluster_id", F.col("centroid").alias("__g"))), "cluster_id", "left")
            centres = centres.withColumn("centroid_drift_from_global", cosine_distance(F.col("__g"), F.col("__c"))).drop("__g")
        out = out.join(centres.drop("__c"), keys, "left")
    if labels is not None:
        out = out.join(F.broadcast(labels.select("cluster_id", "cluster_label")), "cluster_id", "left")
        out = out.withColumn("cluster_label", F.coalesce("cluster_label", F.format_string("C%02d", F.col("cluster_id").cast("int"))))
    return out


def cluster_growth(metrics: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Share in a cluster's own first and last bin, and the difference."""
    found = metrics.groupBy(key).agg(F.min_by("share_jobs", "time_bin").alias("first_share"), F.max_by("share_jobs", "time_bin").alias("last_share"))
    return found.withColumn("share_delta", F.col("last_share") - F.col("first_share"))


def daily_grid(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """A row for each selected cluster on each day from the first to the last; days without jobs have zeros."""
    timed = metrics.withColumn("day", bin_start(F.col("time_bin")).cast("date"))
    days = timed.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    grid = days.crossJoin(F.broadcast(selected))
    out = grid.join(timed.select("day", "cluster_id", "n_jobs", "share_jobs"), ["day", "cluster_id"], "left")
    return out.withColumns({"n_jobs": F.coalesce("n_jobs", F.lit(0)).cast("long"), "share_jobs": F.coalesce("share_jobs", F.lit(0.0))})


def focus_clusters(labels: DataFrame, domains: list[str], most: int) -> list[dict]:
    """The best cluster for each domain in turn, then the largest others: a choice among the k rows of a label table."""
    text = F.concat_ws(" ", F.coalesce("cluster_label", F.lit("")), F.coalesce("top_terms", F.lit("")), F.coalesce("top_skills", F.lit("")))
    rows: list[Row] = labels.select("cluster_id", "cluster_label", "n_jobs", *(keyword_score(text, FOCUS[d][2]).alias(d) for d in FOCUS)).collect()
    out: list[dict] = []

    def take(row: Row, key: str, name: str, color: str) -> None:
        out.append({"cluster_id": row["cluster_id"], "cluster_label": row["cluster_label"], "domain": key, "display_label": f"{name} (C{row['cluster_id']:02d})", "color": color})
        rows.remove(row)

    for key in (d for d in FOCUS if d in domains):
        if len(out) < most and (fit := [r for r in rows if r[key] > 0]):
            take(max(fit, key=lambda r: (r[key], r["n_jobs"], -r["cluster_id"])), key, *FOCUS[key][:2])
    for row in sorted(rows, key=lambda r: (-r["n_jobs"], r["cluster_id"])):
        if len(out) < most:
            take(row, *OTHER)
    return out


def focus_decay(focus: list[dict], decay: DataFrame) -> DataFrame:
    """The focus clusters, in their order, with the columns of their decay summary; null where a cluster has none."""
    chosen = decay.sparkSession.createDataFrame([(i, f["cluster_id"], f["cluster_label"], f["domain"], f["display_label"], f["color"]) for i, f in enumerate(focus)], "focus_rank int, cluster_id int, cluster_label string, domain string, display_label string, color string")
    summary = decay.drop("cluster_label").withColumnRenamed("cluster_id", "__id")
    return chosen.join(summary, chosen.cluster_id == F.col("__id"), "left").drop("__id")


def diagnostic_clusters(df: DataFrame, vector: str, id_col: str, most: int = 8) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """``fit_clusters`` with ``most`` clusters at most, and no note; or a note why there are none: too few rows, dimensions or distinct points."""
    some = df.select(F.size(vector).alias("n")).limit(8).collect()
    if len(some) < 8 or min(r["n"] for r in some) < 2:
        return None, None, "Skipped: fewer than 8 rows or fewer than 2 vector dimensions."
    if df.select(F.transform(F.col(vector), lambda x: F.round(x.cast("double"), 12)).alias("v")).distinct().limit(2).count() < 2:
        return None, None, "Skipped: fewer than 2 distinct vector points."
    return *fit_clusters(df, vector, most, id_col), None


def trajectories(points: DataFrame, top_n: int = 5) -> DataFrame:
    """Mean position ``(x, y)`` of the largest clusters in their first and last bin, and the distance between."""
    sizes = points.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(top_n).select("cluster_id")
    rows = points.join(F.broadcast(sizes), "cluster_id").where("time_bin is not null")
    at = rows.groupBy("cluster_id", "time_bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    ends = at.groupBy("cluster_id").agg(F.min_by(F.struct("time_bin", "n", "x", "y"), "time_bin").alias("a"), F.max_by(F.struct("time_bin", "n", "x", "y"), "time_bin").alias("b"))
    out = ends.select("cluster_id", *(F.col(f"{s}.{c}").alias(f"{e}_{n}") for s, e in (("a", "start"), ("b", "end")) for c, n in (("time_bin", "bin"), ("n", "n"), ("x", "x"), ("y", "y"))))
    return out.withColumn("projected_distance", F.sqrt(F.pow(F.col("end_x") - F.col("start_x"), 2) + F.pow(F.col("end_y") - F.col("start_y"), 2)))


def cluster_titles(df: DataFrame, title: str = "title", n: int = 5) -> DataFrame:
    """``(cluster_id, n_jobs, titles)``: a cluster's size and its n most frequent titles, ties by title."""
    counts = df.groupBy("cluster_id", title).agg(F.count("*").alias("c"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("c"), title)
    best = counts.where(F.col(title).isNotNull()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("r", title)))  # n at most
    named = best.groupBy("cluster_id").agg(F.array_join(F.transform(ordered, lambda x: x[title]), "; ").alias("titles"))
    return counts.groupBy("cluster_id").agg(F.sum("c").alias("n_jobs")).join(named, "cluster_id", "left").withColumn("titles", F.coalesce("titles", F.lit("")))
