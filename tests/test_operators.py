"""Operators on small tables with known results, and all registered queries against their SQL."""

from __future__ import annotations

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner import cli, queries, reports
from gleaner.operators import analytics, audit, clusters, lifecycle, models, profile, silver, skills, sparse, vectors
from gleaner.plans import pipelines
from gleaner.sources import acquire, tables
from gleaner.streaming import windows


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def jobs(spark):
    data = []
    for i in range(60):
        month, tech = i % 5 + 1, i % 2 == 0
        topic = "python software data cloud" if tech else "nursing patient hospital therapy"
        data.append((i, f"{'Engineer' if tech else 'Nurse'} {i}", f"{topic} role number {i}", f"{'Python, SQL' if tech else 'Patient Care'}", f"{topic} card {i % 7} text", f"2024-0{month}-1{i % 7}", f"2024-0{month + 1}-0{i % 7 + 1}" if i % 3 else None, float(50000 + i * 100) if i % 4 else None, "USD", "YEARLY"))
    return spark.createDataFrame(data, "job_id long, title string, description string, skills_text string, job_card_text string, listed_time string, closed_time string, normalized_salary double, currency string, pay_period string")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "mappings").mkdir()
    (tmp_path / "postings.csv").write_text('job_id,title,description,location,listed_time,normalized_salary,views\n1, Nurse ,"Line one\nline ""two""",Here,1709600000000,1.0,3\n2,,,,bad,,\n3,Dev,Text,,,,\n')
    (tmp_path / "jobs" / "job_skills.csv").write_text("job_id,skill_abr\n1,B\n1,A\n1,B\n3,Z\n")
    (tmp_path / "mappings" / "skills.csv").write_text("skill_abr,skill_name\nA,Alpha\nB,Beta\n")
    (tmp_path / "jobs" / "salaries.csv").write_text("job_id,min_salary,max_salary,pay_period,currency\n1,10,90,,USD\n1,20,100,HOURLY,EUR\n3,5,160,YEARLY,\n")
    return tmp_path


def test_silver_from_csv(spark, folder):
    got = {r.job_id: r for r in pipelines.silver(spark, str(folder)).collect()}
    assert set(got) == {1, 3}  # the blank card is dropped
    assert got[1].skills_text == "Beta, Alpha" and got[3].skills_text == ""
    assert (got[1].min_salary, got[1].max_salary, got[1].pay_period, got[1].currency) == (20.0, 100.0, "HOURLY", "USD")
    assert got[3].max_salary == 160.0 and got[1].listed_time == 1709600000000.0 and got[1].views == "3"
    assert got[1].job_card_text == 'Title: Nurse\nLocation: Here\nSkills: Beta, Alpha\nDescription: Line one\nline "two"'


def test_silver_without_salaries_and_errors(spark, folder):
    (folder / "jobs" / "salaries.csv").unlink()
    assert "max_salary" not in pipelines.silver(spark, str(folder)).columns
    (folder / "mappings" / "skills.csv").write_text("skill_abr\nA\n")
    with pytest.raises(ValueError, match="skill_name"):
        pipelines.silver(spark, str(folder))
    with pytest.raises(FileNotFoundError):
        tables.postings(spark, str(folder / "none"))


def test_jsonl_and_evaluation(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    lines = [{"anchor": "python developer", "positive": "python engineer", "negative": "night nurse", "difficulty": "easy"}, {"anchor": "nurse", "positive": "cook", "negative": "nurse", "difficulty": "hard"}]
    path.write_text("\n\n".join(map(json.dumps, lines)))
    got = cli.evaluate(spark, str(path), 1)
    assert got["n_queries"] == 2 and got["recall"] == 0.5 and got["hard_negative_error_rate"] == 1.0
    path.write_text('{"anchor": "a"}\nnot json\n')
    with pytest.raises(Exception, match="not a JSON object"):
        tables.eval_triplets(spark, str(path)).collect()


def test_cached_embeddings_encode_each_text_once(spark, tmp_path):
    seen = []
    coder = models.MockEncoder(4)

    def encode(df):
        seen.append(df.count())
        return coder.encode(df, "t")

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, t string")
    for extra in (df, df.unionByName(spark.createDataFrame([(4, "c")], df.schema))):
        out = tables.cached_embeddings(extra, "t", str(tmp_path / "cache"), "mock", "m", encode)
        assert out.count() == extra.count() and "embedding" in out.columns
    assert seen == [2, 1]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", "", "X, Y", "1709600000000"), (1, " ", "d", "", "5"), (2, "b", "d", "X", None)], "job_id long, title string, description string, skills_text string, listed_time string")
    got = profile.profile(df)
    assert (got["n_postings"], got["n_unique_job_ids"], got["n_missing_titles"], got["n_missing_descriptions"], got["n_jobs_without_skills"]) == (3, 2, 1, 1, 1)
    assert got["top_20_skills"] == [{"skill": "X", "count": 2}, {"skill": "Y", "count": 1}] and got["n_unique_skills"] == 2
    assert (got["listed_time_n_total"], got["listed_time_n_parsed"], got["listed_time_parse_rate"]) == (2, 1, 0.5)
    assert got["expiry_parse_rate"] is None and got["location_top_20"] is None
    with pytest.raises(ValueError, match="skills_text"):
        profile.profile(df.drop("skills_text"))


def test_reliability_gate():
    assert audit.reliability({})["label"] == "demo_only"
    two = audit.reliability({"2024-01": 5, "2024-02": 2000})
    assert two["label"] == "limited_temporal_coverage" and two["low_support_months"] == {"2024-01": 5} and len(two["warnings"]) == 4
    assert audit.reliability({f"2024-0{i}": 5000 for i in range(1, 7)})["label"] == "sufficient_temporal_coverage"


def test_audit_with_bad_times_and_absent_columns(spark):
    df = spark.createDataFrame([("2024-01-05", "x"), ("2024-02-10", ""), ("bad", "y"), (None, "z")], "listed_time string, job_card_text string")
    got = audit.audit(df)
    assert (got["summary"]["total_rows"], got["summary"]["valid_time_rows"], got["summary"]["number_of_months"]) == (4, 2, 2)
    assert rows(got["monthly"], "month", "rows", "text_non_empty", "skills_non_empty") == [("2024-01", 1, 1, 0), ("2024-02", 1, 0, 0)]
    assert got["columns"].first().valid_rows == 2 and got["summary"]["min_date"] == "2024-01-05T00:00:00"
    assert audit.audit(df.limit(0))["summary"]["parse_success_rate"] == 0.0


def test_drift_pairs_present_bins(spark):
    df = spark.createDataFrame([("2024-01", [1.0, 0.0]), ("2024-01", [1.0, 0.0]), ("2024-04", [0.0, 2.0])], "month string, v array<double>")
    got = vectors.drift(vectors.normalized(vectors.mean_vectors(df, ["month"], "v")), "month")
    assert rows(got, "month", "previous_month", "centroid_drift", "n") == [("2024-01", None, None, 2), ("2024-04", "2024-01", 1.0, 1)]
    assert vectors.drift(vectors.mean_vectors(df, ["month"], "v"), "month", keep_first=False).count() == 1
    weighted = vectors.mean_vectors(df.withColumn("w", F.lit(2.0)), ["month"], "v", F.col("w"))
    assert rows(weighted, "month", "centroid") == [("2024-01", [1.0, 0.0]), ("2024-04", [0.0, 2.0])]


def test_dense_ranking(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0]), (30, [0.99, 0.14]), (40, [-1.0, 0.0])], "job_id long, v array<double>")
    assert [(r["rank"], r.job_id) for r in vectors.top_k(df, 10, 2, "job_id", "v").collect()] == [(1, 30), (2, 20)]
    assert [r.job_id for r in vectors.top_k(df, 10, 9, "job_id", "v").collect()] == [30, 20]  # the opposite one is dropped
    with pytest.raises(KeyError):
        vectors.top_k(df, 99, 2, "job_id", "v")


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, "zz"), (4, "")], "i long, t string")
    got = {(r.i, r.term): r.weight for r in sparse.tfidf(df, "i", "t", sparse.Config(bigrams=False, sublinear=True)).collect()}
    idf = lambda n: math.log(5 / (1 + n)) + 1
    red, fish = (1 + math.log(2)) * idf(1), idf(2)
    assert math.isclose(got[1, "red"], red / math.hypot(red, fish)) and math.isclose(got[3, "zz"], 1.0) and not any(i == 4 for i, _ in got)
    pairs = sparse.terms(df, "i", "t", sparse.Config())
    assert {r.term for r in pairs.where("i = 1").collect()} == {"red", "fish", "red red", "red fish"}
    capped = sparse.tfidf(df, "i", "t", sparse.Config(1, bigrams=False))
    assert {r.term for r in capped.collect()} == {"fish"} or {r.term for r in capped.collect()} == {"red"}
    top = sparse.sparse_top_k(sparse.tfidf(df, "i", "t", sparse.Config(bigrams=False)), df, 1, 5, "i")
    assert [(r["rank"], r.i) for r in top.orderBy("rank").collect()] == [(1, 2), (2, 3), (3, 4)]


def test_svd_keeps_cosines(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    dense = rng.random((12, 3)) @ rng.random((3, 8))
    post = spark.createDataFrame([(i, [f"t{j}" for j in range(8)], dense[i].tolist()) for i in range(12)], "i long, terms array<string>, weights array<double>")
    got = {r.i: np.array(r.vector) for r in models.svd_embeddings(post, "i", 3).collect()}
    for a in range(12):
        for b in range(a):
            want = dense[a] @ dense[b] / np.linalg.norm(dense[a]) / np.linalg.norm(dense[b])
            assert math.isclose(got[a] @ got[b], want, abs_tol=1e-6)


def test_clusters_are_found_and_numbered_by_size(spark):
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(6)] + [(10 + i, [-1.0, 0.01 * i]) for i in range(4)], "i long, v array<double>")
    got, centres = clusters.fit_clusters(df, "v", 2, "i")
    assert {r.cluster_id for r in got.where("i < 10").collect()} == {0} and {r.cluster_id for r in got.where("i >= 10").collect()} == {1}
    assert centres.count() == 2
    same, _ = clusters.fit_clusters(df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0))), "v", 5, "i")
    assert {r.cluster_id for r in same.collect()} == {0}


def test_cluster_metrics_by_hand(spark):
    df = spark.createDataFrame([("2024-01", 0, 100.0, "USD", "a; b"), ("2024-01", 0, None, "USD", "b"), ("2024-01", 1, 50.0, "EUR", ""), ("2024-02", 0, 70.0, "", "c"), (None, 0, 1.0, "USD", "z")], "time_bin string, cluster_id int, normalized_salary double, currency string, skills string")
    got = clusters.cluster_metrics(df, None, None, None, "skills")
    assert rows(got, "time_bin", "cluster_id", "n_jobs", "share_jobs", "salary_median", "salary_coverage", "top_skills", "n_with_skills") == [
        ("2024-01", 0, 2, 2 / 3, 100.0, 0.5, "b; a", 2), ("2024-01", 1, 1, 1 / 3, None, 0.0, "", 0), ("2024-02", 0, 1, 1.0, 70.0, 1.0, "c", 1)]
    assert rows(clusters.cluster_growth(got), "cluster_id", "share_delta") == [(0, 1 - 2 / 3), (1, 0.0)]


def test_focus_clusters(spark):
    labels = spark.createDataFrame([(0, "C00 | sales", 5, "sales", ""), (1, "C01 | nurse", 9, "patient, nurse", ""), (2, "C02 | misc", 50, "misc", ""), (3, "C03 | data", 2, "python, data", "")], "cluster_id int, cluster_label string, n_jobs long, top_terms string, top_skills string")
    got = clusters.focus_clusters(labels, ["health", "technology", "sales"], 4)
    assert [(x["domain"], x["cluster_id"]) for x in got] == [("health", 1), ("technology", 3), ("sales", 0), ("other", 2)]
    assert clusters.focus_clusters(labels, [], 1)[0]["display_label"] == "Other (C02)" and clusters.focus_clusters(labels, ["health"], 0) == []


def test_decay_and_survival(spark):
    df = spark.createDataFrame([(0, 10.0, True), (0, 20.0, False), (0, 30.0, True), (1, 5.0, False), (2, 1.0, True), (2, 1.0, True)], "cluster_id int, duration_days double, event_observed boolean")
    got = {r.cluster_id: r for r in lifecycle.exponential_decay(df, min_rows=3).collect()}
    assert math.isclose(got[0]["lambda"], 2 / 60) and math.isclose(got[0].half_life_days, math.log(2) * 30) and got[0].n_censored == 1
    assert got[1]["lambda"] is None and got[1].warning == "insufficient data: n=1, events=0"
    curve = rows(lifecycle.observed_survival(df), "cluster_id", "duration_days", "survival")
    assert [(c, d, round(s, 9)) for c, d, s in curve] == [(0, 0.0, 1.0), (0, 10.0, round(2 / 3, 9)), (0, 30.0, round(1 / 3, 9)), (2, 0.0, 1.0), (2, 1.0, 0.0)]
    km = rows(lifecycle.kaplan_meier(df), "cluster_id", "duration_days", "survival")
    assert [(c, d, round(s, 9)) for c, d, s in km] == [(0, 10.0, round(2 / 3, 9)), (0, 30.0, 0.0), (2, 1.0, 0.0)]
    dense = lifecycle.dense_survival(lifecycle.observed_survival(df), 40.0, points=5)
    assert [(r.duration_days, round(r.survival, 6)) for r in dense.where("cluster_id = 0").orderBy("duration_days").collect()] == [(0.0, 1.0), (10.0, 0.666667), (20.0, 0.666667), (30.0, 0.333333), (40.0, 0.333333)]
    assert lifecycle.axis_scale(2.0)[1] == "hours" and lifecycle.axis_scale(9.0)[1] == "days"


def test_durations(spark):
    df = spark.createDataFrame([(0, datetime(2024, 1, 1), datetime(2024, 1, 3, 12)), (0, datetime(2024, 1, 5), datetime(2024, 1, 1)), (1, datetime(2024, 1, 1), None)], "cluster_id int, a timestamp, b timestamp")
    assert rows(lifecycle.durations(df, "a", "b"), "cluster_id", "duration_days", "event_observed") == [(0, 2.5, True)]
    assert rows(lifecycle.durations(df, "a", None, "b"), "duration_days", "event_observed") == [(2.5, False)]
    with pytest.raises(ValueError, match="closure"):
        lifecycle.durations(df, "a", None)


def test_salary_weights(spark):
    df = spark.createDataFrame([("m", 100.0, "USD"), ("m", 100.0, "usd"), ("m", 9.0, "EUR"), ("n", None, "USD"), (None, 5.0, "USD"), ("m", 8.0, None)], "month string, normalized_salary double, currency string")
    got = analytics.salary_weights(df)
    assert [r.salary_weight for r in got.where("salary_weight is not null").collect()] == [1.0, 1.0]
    assert tuple(analytics.salary_summary(got).first()) == (2, 2 / 6, 2, 4)


def test_growth_by_hand(spark):
    df = spark.createDataFrame([("01", "a, b"), ("01", "a"), ("02", "x"), ("03", "b; c"), ("03", ""), (None, "q")], "month string, s string")
    got = rows(skills.skill_growth(df, "s"), "skill", "first_count", "last_count", "share_delta", "trend")
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e in got] == [("a", 2, 0, -0.666667, "declining"), ("b", 1, 1, 0.166667, "rising"), ("c", 0, 1, 0.5, "rising")]
    assert skills.skill_growth(df.limit(0), "s").count() == 0


def test_domains(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "nothing"), (2, [1.0, 0.0], "python data sql"), (3, [0.1, 0.1], "teacher"), (4, [0.0, 0.0], "")], "job_id long, v array<double>, t string")
    prompts = {n: [1.0, 0.0] if n == "sales" else [0.0, 1.0] if n == "health" else [0.0, 0.0] for n in skills.DOMAINS}
    got = {r.job_id: r for r in skills.assign_domains(df, "v", prompts, F.col("t")).collect()}
    assert [(got[i].domain, got[i].domain_source) for i in (1, 2, 3, 4)] == [("sales", "embedding"), ("tech", "keyword_fallback"), ("education", "keyword_fallback"), ("health", "embedding")]
    assert got[4].is_uncertain and got[4].keyword_domain is None and not got[1].is_uncertain


def test_composition_sums_to_one(spark):
    df = spark.createDataFrame([("b1", "Nursing", 8, 10), ("b1", "Patient Care", 5, 10), ("b1", "X", 1, 10), ("b2", "Nursing", 3, 200)], "time_bin string, skill string, skill_job_count long, job_count long")
    got = skills.skill_composition(df, 2)
    assert [r.skill for r in got.where("time_bin = 'b1'").orderBy(F.when(F.col("rank") == 0, 9).otherwise(F.col("rank"))).collect()] == ["Nursing", "Patient Care", "Other"]
    assert {round(r.s, 9) for r in got.groupBy("time_bin").agg(F.sum("composition_share").alias("s")).collect()} == {1.0}
    assert got.where("time_bin = 'b2' and skill = 'Other'").first().skill_job_count == 0.0


def test_sampling(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1 + i % 5, 1 + i // 5)) for i in range(50)], "i long, ts timestamp").withColumn("b", F.date_format("ts", "yyyy-MM"))
    for parts in (1, 7):
        got = analytics.stride_sample(df.repartition(parts), 10, "ts", "b", "i")
        assert sorted({r.b for r in got.collect()}) == [f"2024-0{m}" for m in range(1, 6)] and got.count() == 10
    few = analytics.stride_sample(df, 3, "ts", "b", "i")
    assert few.count() == 3 and "2024-05" in {r.b for r in few.collect()}
    assert rows(analytics.hash_sample(df.repartition(5), 7, "i"), "i") == rows(analytics.hash_sample(df.coalesce(1), 7, "i"), "i")
    with pytest.raises(ValueError, match="positive"):
        analytics.stride_sample(df, 0, "ts", "b", "i")
    numbered = analytics.number_rows(df.repartition(6), ["ts", "i"])
    assert [r["__n"] for r in numbered.orderBy("ts", "i").collect()] == list(range(50))


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(q, r + 1, x) for q, labels in enumerate([[1, 0, 0], [0, 1, 0], [0, 0, 1]]) for r, x in enumerate(labels)], "query_id int, rank int, label int")
    at = lambda k: analytics.retrieval_metrics(ranked, k).first()
    assert math.isclose(at(1).recall, 1 / 3) and math.isclose(at(2).recall, 2 / 3) and math.isclose(at(3).mrr, (1 + 0.5 + 1 / 3) / 3)
    assert math.isclose(at(3).ndcg, (1 + 1 / math.log2(3) + 0.5) / 3)
    with pytest.raises(ValueError, match="positive"):
        at(0)
    tied = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "query_id int, label int, score double")
    assert rows(analytics.rank_triplets(tied), "rank", "label") == [(1, 1), (2, 0)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, datetime(2024, 1, 1, h)) for h in (1, 2, 3)] + [(2, datetime(2024, 1, 2, 5))], "k int, ts timestamp").write.parquet(source)
    for i, make in enumerate((lambda s: windows.tumbling_counts(s), lambda s: windows.sliding_counts(s, "2 hours", "1 hour"), lambda s: windows.sessions(s, "k", "90 minutes"))):
        stream = spark.readStream.schema("k int, ts timestamp").parquet(source)
        q = make(stream).writeStream.format("memory").queryName(f"w{i}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert rows(spark.table("w0"), "rows") == [(1,), (3,)]
    assert spark.table("w1").count() == 6 and rows(spark.table("w2"), "k", "rows") == [(1, 3), (2, 1)]
    q = windows.encode_new(spark.readStream.schema("k int, ts timestamp").parquet(source), lambda d: models.MockEncoder(4).encode(d.withColumn("t", F.col("k").cast("string")), "t"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_runs(spark, jobs, tmp_path):
    demo = pipelines.temporal_demo(jobs, salary=True)
    assert demo.tables["drift"].count() == 5 and demo.tables["salary_drift"].count() == 4 and demo.meta["reliability"]["label"] == "limited_temporal_coverage"
    found = pipelines.temporal_clusters(jobs, k=2, size="M")
    assert found.tables["metrics"].count() == 10 and {r.n_jobs for r in found.tables["labels"].collect()} == {30} and found.tables["decay"].count() == 2
    evolution = pipelines.skill_evolution(jobs)
    assert {r.domain for r in evolution.tables["domains"].select("domain").distinct().collect()} == {"tech", "health"}
    assert evolution.tables["shares"].where("skill = 'SQL' and domain = 'tech'").first().share_pct == 100.0
    assert "| a\\|b | 1.5000 |" in pipelines.markdown(spark.createDataFrame([("a|b", 1.5)], "x string, y double"), ["x", "y"])


def test_reports(spark, jobs):
    assert "sufficient" in reports.audit_report(pipelines.audit_run(jobs)) or "limited" in reports.audit_report(pipelines.audit_run(jobs))
    found = pipelines.temporal_clusters(jobs.drop("closed_time"), k=2, size="M")
    assert "Decay is not available" in reports.cluster_report(found)
    drift = spark.createDataFrame([("2024-01", None), ("2024-02", 0.5)], "month string, centroid_drift double")
    assert reports.comparison_note(drift, drift) == "- 2024-02: 0.5000, then 0.5000 (+0.0000)"
    assert reports.comparison_note(drift.limit(1), drift) == "The runs have no bin in common."
    assert "| recall@5 | 0.5000 |" in reports.evaluation_report({"recall": 0.5, "n_queries": 2}, 5)
    assert reports.ticks([str(i) for i in range(30)]) == ["0", "3", "6", "9", "12", "15", "18", "21", "24", "27", "29"] and reports.ticks([]) == []
    seen = reports.EncodeProfile([0.1, 0.2, 0.3, 0.4], 8)
    assert math.isclose(seen.percentile_ms(0.5), 250) and math.isclose(seen.percentile_ms(0.95), 385) and math.isclose(seen.texts_per_second, 8)
    with seen.batch(2):
        pass
    assert seen.texts == 10 and reports.EncodeProfile().percentile_ms(0.5) == 0.0
    assert reports.provenance(1.0)["pyspark"] == spark.version


def test_acquire(spark, folder, tmp_path):
    import zipfile

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert acquire.retry(flaky, wait=0) == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        acquire.retry(lambda: open("/none/at/all"), tries=2, wait=0)
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.write(folder / "postings.csv", "inner/postings.csv")
    assert acquire.unpack(tmp_path / "d.zip", tmp_path / "u").name == "inner"
    got = acquire.sample(spark, str(folder), str(tmp_path / "s"), 1)
    assert got == {"postings.csv": 1, "jobs/job_skills.csv": 3, "jobs/salaries.csv": 2, "mappings/skills.csv": 2}
    assert pipelines.silver(spark, str(tmp_path / "s")).count() == 1


def test_small_helpers(spark):
    by = spark.createDataFrame([("a", 10, 3, 0.3), ("b", 10, 3, 1.4)], "month string, n_jobs long, n_salary_jobs long, salary_coverage double")
    assert rows(analytics.salary_coverage_plot(by, 4), "month", "salary_coverage", "low_support", "overall_coverage") == [("a", 0.3, True, 0.3), ("b", 1.0, True, 0.3)]
    flat = models.projection_2d(spark.createDataFrame([(1, [1.0]), (2, [3.0])], "i long, v array<double>"), "i", "v")
    assert [(abs(r.x), r.y) for r in flat.orderBy("i").collect()] == [(1.0, 0.0), (3.0, 0.0)]


def test_command_line(spark, jobs, folder, tmp_path, capsys):
    out = str(tmp_path / "o")
    run = lambda *a: cli.main([*a], spark)
    assert run("build-silver", "--input", str(folder), "--output", f"{out}/s")["tables"] == ["jobs"]
    assert run("profile-silver", "--input", f"{out}/s/jobs")["n_postings"] == 2
    jobs.write.mode("overwrite").parquet(f"{out}/jobs")
    run("build-tfidf", "--input", f"{out}/jobs", "--output", f"{out}/t")
    first = run("recommend", "--input", f"{out}/t", "--job-id", "0", "--top-k", "3")["results"]
    assert len(first) == 3 and all(r["job_id"] % 2 == 0 for r in first)
    run("build-embeddings", "--input", f"{out}/jobs", "--output", f"{out}/e")
    assert len(run("recommend-dense", "--input", f"{out}/e", "--job-id", "0", "--top-k", "3")["results"]) <= 3
    with pytest.raises(KeyError):
        run("recommend", "--input", f"{out}/t", "--job-id", "999")
    assert run("temporal-audit", "--input", f"{out}/jobs", "--output", f"{out}/a")["number_of_months"] == 5
    assert json.loads(capsys.readouterr().out.splitlines()[0])["stage"] == "build-silver"


def test_market_value_has_one_salary_a_label(spark):
    made = [("2024-01", "a", 100, 0.5, 50.0), ("2024-01", "b", 100, 0.5, None), ("2024-02", "a", 300, 0.75, 200.0), ("2024-02", "b", 100, 0.25, None), ("2024-03", "a", 5, 1.0, 1.0)]
    schema = "time_bin string, cluster_label string, n_jobs long, share_jobs double, salary_median double"
    got = analytics.market_value(spark.createDataFrame(made, schema))
    # the third bin is too small to be an end; jobs are 300 + 100; b's salary is the median of 50, 200 and 1
    assert rows(got, "cluster_label", "n_jobs", "value_first", "value_last") == [("a", 300, 40_000.0, 60_000.0), ("b", 100, 10_000.0, 5_000.0)]
    gone = analytics.market_value(spark.createDataFrame([r for r in made if r[:2] != ("2024-02", "b")], schema))
    assert rows(gone, "cluster_label", "n_jobs", "value_last") == [("a", 300, 60_000.0), ("b", 100, 0.0)]
    bare = analytics.market_value(spark.createDataFrame([("2024-01", "a", 100, 1.0, None)], schema))
    assert rows(bare, "value_last") == [(7_500_000.0,)]
    assert analytics.market_value(spark.createDataFrame([], schema)).count() == 0


def test_prompts_teach_nothing_and_ids_may_be_text(spark, jobs):
    plain = pipelines.skill_evolution(jobs).tables
    named = pipelines.skill_evolution(jobs.withColumn("job_id", F.concat(F.lit("j"), (F.col("job_id") - 3).cast("string")))).tables
    assert rows(plain["domains"], "domain", "is_uncertain") == rows(named["domains"], "domain", "is_uncertain")
    counts = {r.domain: r.n_jobs for r in plain["domain_counts"].collect()}
    assert list(counts) and set(counts) == set(skills.DOMAINS) and counts["sales"] == 0 and sum(counts.values()) == jobs.count()


def test_runs_carry_coverage_focus_and_notes(spark, jobs):
    demo = pipelines.temporal_demo(jobs, salary=True)
    r = demo.tables["salary_drift"].orderBy("month").first()
    assert (r.n_from, r.n_to) == (12, 12) and r.salary_coverage_to == r.n_salary_to / r.n_to and demo.meta["cluster_note"] is None
    assert demo.tables["cluster_titles"].agg(F.sum("n_jobs")).first()[0] == jobs.count()
    few = pipelines.temporal_demo(jobs.limit(5))
    assert "clusters" not in few.tables and few.meta["cluster_note"].startswith("Skipped")
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "i long, v array<double>")
    assert clusters.diagnostic_clusters(same, "v", "i")[2] == "Skipped: fewer than 2 distinct vector points."
    found = pipelines.temporal_clusters(jobs, k=2, size="D", encoder=models.SentenceEncoder("none", 4))
    assert found.meta["embedding"]["used"] == "tfidf_svd" and "not installed" in found.meta["embedding"]["fallback_reason"]
    focus = found.tables["focus_decay"].orderBy("focus_rank").collect()
    assert len(focus) == 2 and all(f["lambda"] is not None for f in focus)
    grid = found.tables["focus_grid"]
    assert grid.count() == 2 * grid.select("day").distinct().count() and grid.agg(F.sum("n_jobs")).first()[0] == jobs.count()


def test_a_saved_model_transforms_new_texts(spark, jobs, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text("tfidf: {max_features: 40, ngram_range: [1, 1], min_df: 1, sublinear_tf: false}\nretrieval: {top_k_default: 2}\nlogging: {level: ERROR}\n")
    jobs.write.mode("overwrite").parquet(f"{tmp_path}/jobs")
    run = lambda *a: cli.main([*a], spark)
    made = run("build-tfidf", "--input", f"{tmp_path}/jobs", "--output", f"{tmp_path}/t", "--config", str(config), "--export", "csv")
    assert made["input_rows"] == jobs.count() and made["outputs"]["ids"]["rows"] == jobs.count() and made["outputs"]["vocabulary"]["rows"] <= 40
    assert tables.verified_rows(spark, made["outputs"]) == made["outputs"]
    with pytest.raises(ValueError, match="ids: "):
        tables.verified_rows(spark, {"ids": {"rows": 1, "path": f"{tmp_path}/t/ids"}})
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/postings.csv").count() == made["outputs"]["postings"]["rows"]
    again = pipelines.transform_tfidf(spark, f"{tmp_path}/t", jobs.limit(1))
    old = spark.read.parquet(f"{tmp_path}/t/postings")
    one = jobs.limit(1).first().job_id
    assert [(t, round(w, 9)) for t, w in rows(again, "term", "weight")] == [(t, round(w, 9)) for t, w in rows(old.where(F.col("job_id") == one), "term", "weight")]
    assert pipelines.transform_tfidf(spark, f"{tmp_path}/t", spark.createDataFrame([(9, "zzz qqq")], "job_id long, job_card_text string")).count() == 0
    assert len(run("recommend", "--input", f"{tmp_path}/t", "--job-id", "0", "--config", str(config))["results"]) == 2
    with pytest.raises(ValueError, match="unknown tfidf"):
        cli.vectoriser({"tfidf": {"max_feature": 1}})
    with pytest.raises(ValueError, match="missing required"):
        pipelines.build_tfidf(jobs.drop("job_card_text"))


def test_demo_compares_and_evaluation_reports(spark, jobs, tmp_path):
    jobs.write.mode("overwrite").parquet(f"{tmp_path}/jobs")
    run = lambda *a: cli.main([*a], spark)
    run("temporal-demo", "--input", f"{tmp_path}/jobs", "--output", f"{tmp_path}/a")
    run("temporal-demo", "--input", f"{tmp_path}/jobs", "--output", f"{tmp_path}/b", "--compare", f"{tmp_path}/a")
    report = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/b/report").collect())
    assert "## Comparison" in report and "(+0.0000)" in report
    line = '{"anchor": "desarrollador python", "positive": "python developer", "negative": "nurse", "difficulty": "hard"}\n'
    (tmp_path / "t.jsonl").write_text(line * 3)
    got = run("evaluate", "--input", f"{tmp_path}/t.jsonl", "--output", f"{tmp_path}/e")
    assert got["n_queries"] == 3 and got["recall"] == 1.0 and got["backend"] == "buckets" and got["latency_p95_ms"] >= got["latency_p50_ms"] > 0
    assert any("latency_p50_ms" in r.value for r in spark.read.text(f"{tmp_path}/e/report").collect())
    with pytest.raises(RuntimeError, match="not installed"):
        run("evaluate", "--input", f"{tmp_path}/t.jsonl", "--output", f"{tmp_path}/e", "--encoder", "sentence-transformers")
    (tmp_path / "bad.jsonl").write_text(line + "\n" + "[1]\n")
    with pytest.raises(Exception, match=r"bad.jsonl, line 3: not a JSON object: \[1\]"):
        tables.eval_triplets(spark, f"{tmp_path}/bad.jsonl").collect()


def test_svd_is_that_of_the_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.where(rng.random((60, 25)) < 0.3, rng.random((60, 25)), 0.0)
    docs = spark.createDataFrame([(i, [f"t{j:02d}" for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)], "i long, terms array<string>, weights array<double>")
    got = np.array([r.vector for r in models.truncated_svd(docs, "i", 3).orderBy("i").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got @ got.T, (u[:, :3] * s[:3] ** 2) @ u[:, :3].T, atol=0.05 * s[0] ** 2)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def against_sql(spark, folder, name, order):
    """Rows of a query over the documents in ``folder``, and those of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]}) order by {order}").fetchall()
    return [tuple(r) for r in df.orderBy(*order.split(", ")).collect()], want


def documents(spark, folder, texts):
    data = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "web", 10) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")


def test_keyword_domain_lowers_and_splits(spark, tmp_path):
    documents(spark, tmp_path, ["SOFTWARE Developer", "Nurse|PATIENT", "Lead;generation|CRM", "plain", None, " CUSTOMER /  service "])
    got, want = against_sql(spark, tmp_path, "keyword_domain", "doc_id")
    assert got == want
    assert [r[1:] for r in got] == [("tech", 2), ("health", 2), ("sales", 2), ("health", 0), ("health", 0), ("sales", 1)]


def test_keywords_of_domains_are_counted_once(spark, tmp_path):
    documents(spark, tmp_path, ["studentstudents data", "health care " * 50, "salesales nurse", None, "Software/Data"])
    for name in ("domain_counts", "domain_assignment", "keyword_domain"):
        got, want = against_sql(spark, tmp_path, name, "domain" if name == "domain_counts" else "doc_id")
        assert got == want
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 == plan.count("(?U)\\s+")


def test_documents_are_whole_over_batches_and_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sparse, "CHUNK", 3)
    rows_of = [(None, ["a"]), (None, ["b", "a"]), (1, ["c", "c", "d"]), (2, []), (3, ["e"]), (3, ["e", "f"]), (3, ["g"]), (4, ["h"])]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([w for _, w in part], pa.list_(pa.string()))], ["i", "w"]) for part in (rows_of[:1], rows_of[1:5], rows_of[5:6], rows_of[6:])]
    found = [(i, [words[r].as_py() for r in range(len(of)) if of[r] == at]) for ids, of, words in sparse._documents(iter(batches)) for at, i in enumerate(ids.to_pylist())]
    assert found == [(None, [["a"], ["b", "a"]]), (1, [["c", "c", "d"]]), (2, [[]]), (3, [["e"], ["e", "f"], ["g"]]), (4, [["h"]])]


def test_terms_are_counted_without_a_row_for_each(spark, tmp_path):
    documents(spark, tmp_path, [(7, "one two one"), (7, "two three"), (8, "one, Two; x three three"), (9, None), (10, "")])
    got, want = against_sql(spark, tmp_path, "tfidf_vocabulary", "term")
    assert got == want and [r[:2] for r in got] == [("one", 2), ("three", 2), ("two", 2)]
    plan = queries.QUERIES["tfidf_vocabulary"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [doc_id" not in plan
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(rows(sparse.terms(df.where("doc_id = 7"), "doc_id", "text", sparse.Config()), "term", "tf")) == [("one", 2), ("one two", 1), ("three", 1), ("two", 2), ("two one", 1), ("two three", 1)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    df = queries.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = found.fetchall()
    assert sorted(str([_plain(x) for x in r]) for r in want) == sorted(str([_plain(r[c]) for c in names]) for r in got)


def test_rare_terms_of_chunks_are_counted_when_they_matter(spark, monkeypatch):
    """A term that is rare in every chunk, but not in all of them, stays in a bounded vocabulary with its exact counts."""
    texts = [f"big dog big dog low{i} key{i % 2} far{i % 3}" for i in range(12)] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)
    for config in (sparse.Config(3, False), sparse.Config(4, min_df=2), sparse.Config(6, max_df=0.6), sparse.Config(5, stop_words=("big",)), sparse.Config(10**6)):
        found = []
        for rare in (0.0, 0.04, 0.06, 0.2):  # all, part or none of the counts are made at first
            monkeypatch.setattr(sparse, "RARE", rare)
            vectors = sparse.coded(df, "i", "t", config)
            found.append((rows(sparse.fit(df, "i", "t", config), "term", "df", "idf"), sorted((r.i, sorted((vectors.terms[t], round(w, 9)) for t, w in zip(r.t, r.w, strict=True))) for r in vectors.docs.collect())))
            assert vectors.terms == sorted(vectors.terms) and len(vectors.terms) == len(found[-1][0])
        assert all(f == found[0] for f in found)
    assert {r.term: r.df for r in sparse.fit(df, "i", "t", sparse.Config(4)).collect()} == {"big": 24, "big dog": 24, "dog": 24, "dog big": 24}


def test_held_words_are_whole_chunks():
    import pyarrow as pa

    part = lambda data: pa.RecordBatch.from_pylist([dict(zip("inwx", r)) for r in data], pa.schema([("i", pa.int64()), ("n", pa.bool_()), ("w", pa.list_(pa.int32())), ("x", pa.list_(pa.string()))]))
    batches = [part([(1, True, [0, 1], ["a", "b"]), (1, False, [1], None)]), part([(2, True, [], None)]), part([(3, True, [0], ["c"]), (4, True, [0], ["d"])]), part([(None, True, [], None)])]
    found = [(ids.to_pylist(), of.tolist(), row.tolist(), [names[c].as_py() for c in code]) for ids, of, row, code, names in sparse._held_chunks(iter(batches))]
    assert found == [([1, 2], [0, 0, 1], [0, 0, 1], ["a", "b", "b"]), ([3], [0], [0], ["c"]), ([4, None], [0, 1], [0], ["d"])]


def test_top_terms_and_top_k_by_number(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a1 b1 b1", "x"), (2, "b1 c1", "x"), (3, "c1 d1 d1", None), (4, None, "y"), (5, "a1 d1", "y"), (5, "b1", "y")], "i long, t string, g string")
    config, config2 = sparse.Config(50, sublinear=True), sparse.Config(2500, bigrams=False)
    vectors, postings = sparse.coded(df, "i", "t", config), sparse.tfidf(df, "i", "t", config)
    near = lambda d: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()]
    assert sorted(near(sparse.coded_top_terms(vectors, df, "i", "g"))) == sorted(near(sparse.top_terms(postings, df, "i", "g")))
    for common in (0, 2, 1000):  # none, some or all terms are summed where they lie
        monkeypatch.setattr(sparse, "COMMON", common)
        for plain in (sparse.Config(sublinear=True), sparse.Config(bigrams=False, min_df=2)):
            assert sorted(near(sparse.text_top_terms(df, "i", "t", "g", plain)), key=str) == sorted(near(sparse.top_terms(sparse.tfidf(df, "i", "t", plain), df, "i", "g")), key=str)
    many = spark.createDataFrame([(i, f"t{i} t{i} t{i % 7}", i) for i in range(3000)], "i long, t string, g long")  # 3,000 groups: their sums are not held
    assert sorted(near(sparse.coded_top_terms(sparse.coded(many, "i", "t", config2), many, "i", "g"))) == sorted(near(sparse.top_terms(sparse.tfidf(many, "i", "t", config2), many, "i", "g")))
    assert near(sparse.coded_top_k(vectors, df, 1, 9, "i")) == near(sparse.sparse_top_k(postings, df, 1, 9, "i"))
    assert rows(vectors.named("i"), "i")[-1] == (5,)


def test_runs_hold_no_texts(spark, jobs):
    """What a run holds does not grow with the texts: they are read, and only numbers are kept."""
    for made in (lambda: pipelines.temporal_demo(jobs, salary=True).tables["salary_drift"], lambda: pipelines.temporal_clusters(jobs, k=3).tables["metrics"]):
        spark.catalog.clearCache()
        plan = made()._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan
        assert not [line for line in plan.splitlines() if "InMemoryRelation" in line and ("description" in line or "job_card_text" in line or "__text" in line)]
    spark.catalog.clearCache()
