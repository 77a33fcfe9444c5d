"""Markdown reports, provenance, and small helpers for whoever draws the tables."""

from __future__ import annotations

import math
import platform
import subprocess
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.pipelines import Run, markdown


def provenance(runtime: float | None = None) -> dict[str, Any]:
    """Versions, commit and runtime of a run; what cannot be told is None."""
    found: dict[str, Any] = {"python": platform.python_version(), "runtime_seconds": runtime}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    try:
        found["git_commit"] = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        found["git_commit"] = None
    return found


def _section(title: str, *parts: str) -> list[str]:
    return [f"## {title}", "", *(p for x in parts for p in (x, ""))]


def _notes(gate: dict[str, Any]) -> str:
    return "\n".join([f"Reliability: **{gate['label']}**", *(f"- {w}" for w in [*gate["warnings"], *gate["known_limitations"]])])


def audit_report(run: Run) -> str:
    m = run.meta
    head = f"{m['valid_time_rows']} of {m['total_rows']} rows have a valid `{m['time_column']}` ({m['parse_success_rate']:.4f}), from {m['min_date']} to {m['max_date']}."
    return "\n".join([
        "# Temporal audit", "", head, "", *_section("Reliability", _notes(m["reliability"])),
        *_section("Months", markdown(run.tables["monthly"], ["month", "rows", "text_coverage", "skills_coverage"], 120)),
        *_section("Time columns", markdown(run.tables["columns"], ["time_column", "valid_rows", "parse_success_rate", "number_of_months", "reliability_label"])),
    ])


def demo_report(run: Run, before: str | None = None) -> str:
    growth = run.tables.get("growth")
    out = ["# Temporal comparison", "", f"{run.meta['rows']} rows.", "", *_section("Reliability", _notes(run.meta["reliability"]))]
    out += _section("Centroid drift", markdown(run.tables["drift"].orderBy("month"), ["month", "previous_month", "centroid_drift", "jobs_in_month"], 120))
    if growth is not None:
        for name, rows in (("Rising skills", growth.where("share_delta >= 0").orderBy(F.desc("share_delta"), "skill")), ("Declining skills", growth.where("share_delta < 0").orderBy("share_delta", "skill"))):
            out += _section(name, markdown(rows, ["skill", "first_count", "last_count", "share_delta"], 10))
    if "salary_drift" in run.tables:
        out += _section("Salary-weighted drift", markdown(run.tables["salary_drift"].orderBy("month"), ["month", "previous_month", "centroid_drift", "n_salary_from", "n_salary_to", "salary_coverage_from", "salary_coverage_to"], 120))
    if "cluster_titles" in run.tables:
        out += _section("Diagnostic clusters", markdown(run.tables["cluster_titles"].orderBy("cluster_id"), ["cluster_id", "n_jobs", "titles"], 8))
    elif run.meta.get("cluster_note"):
        out += _section("Diagnostic clusters", run.meta["cluster_note"])
    return "\n".join(out + ([] if before is None else _section("Comparison", before)))


def comparison_note(before: DataFrame, after: DataFrame) -> str:
    """How the drift of two runs over the same bins differs."""
    both = before.select("month", F.col("centroid_drift").alias("a")).join(after.select("month", F.col("centroid_drift").alias("b")), "month").where("a is not null and b is not null").orderBy("month").collect()
    if not both:
        return "The runs have no bin in common."
    return "\n".join(f"- {r['month']}: {r['a']:.4f}, then {r['b']:.4f} ({r['b'] - r['a']:+.4f})" for r in both)


def cluster_report(run: Run) -> str:
    t = run.tables
    out = ["# Clusters through time", "", *_section("Clusters", markdown(t["labels"].orderBy("cluster_id"), ["cluster_id", "cluster_label", "n_jobs", "top_skills"], 50))]
    for name, rows in (("Growing", t["growth"].where("share_delta >= 0").orderBy(F.desc("share_delta"))), ("Shrinking", t["growth"].where("share_delta < 0").orderBy("share_delta"))):
        out += _section(name, markdown(rows, ["cluster_id", "first_share", "last_share", "share_delta"], 10))
    if "focus_decay" in t:
        out += _section("Focus clusters", markdown(t["focus_decay"].orderBy("focus_rank"), ["cluster_id", "display_label", "domain", "n_rows", "lambda", "half_life_days"]))
    if "decay" in t:
        return "\n".join(out + _section("Decay", markdown(t["decay"].orderBy("cluster_id"), ["cluster_id", "n_rows", "n_events", "n_censored", "lambda", "half_life_days", "warning"], 50)))
    return "\n".join(out + _section("Decay is not available", run.meta["decay_reason"]))


def evolution_report(run: Run) -> str:
    t = run.tables
    return "\n".join([
        "# Skill evolution", "", *_section("Domains", markdown(t["domain_counts"].orderBy(F.desc("n_jobs"), "domain"), ["domain", "n_jobs", "n_uncertain"])),
        *_section("Top skills", markdown(t["top_skills"].orderBy("domain", "rank"), ["domain", "rank", "skill", "total"], 60)),
    ])


def evaluation_report(result: dict[str, Any], k: int) -> str:
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["# Retrieval evaluation", "", "| metric | value |", "| --- | --- |", *(f"| {name}{f'@{k}' if name in ('recall', 'mrr', 'ndcg') else ''} | {shown(value)} |" for name, value in result.items())])


#: Batches that are timed, and texts in each.
PROFILE_BATCHES, PROFILE_TEXTS = 20, 64


def encode_profile(df: DataFrame, columns: tuple[str, ...], coder: Any) -> dict[str, float]:
    """Latency p50 and p95 and throughput of an encoder over the first texts of ``columns``, in batches."""
    texts = [t for r in df.select(*columns).limit(PROFILE_BATCHES * PROFILE_TEXTS // len(columns)).collect() for t in r]
    profile = EncodeProfile()
    for a in range(0, len(texts), PROFILE_TEXTS):
        part = df.sparkSession.createDataFrame([(t,) for t in texts[a : a + PROFILE_TEXTS]], "text string").coalesce(1)
        with profile.batch(min(PROFILE_TEXTS, len(texts) - a)):
            coder.encode(part, "text").write.format("noop").mode("overwrite").save()
    return {"latency_p50_ms": profile.percentile_ms(0.5), "latency_p95_ms": profile.percentile_ms(0.95), "throughput_texts_per_sec": profile.texts_per_second}


REPORTS = {"temporal-audit": audit_report, "temporal-demo": demo_report, "temporal-clusters": cluster_report, "skill-evolution": evolution_report}


def ticks(labels: list[str], most: int = 12) -> list[str]:
    """At most about ``most`` of the labels, evenly, and always the last."""
    step = max(1, math.ceil(len(labels) / most))
    shown = labels[::step]
    return shown if not labels or shown[-1] == labels[-1] else [*shown, labels[-1]]


@dataclass
class EncodeProfile:
    """Latencies of batches, and throughput."""

    seconds: list[float] = field(default_factory=list)
    texts: int = 0

    @contextmanager
    def batch(self, n: int) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.seconds.append(time.perf_counter() - began)
        self.texts += n

    def percentile_ms(self, p: float) -> float:
        """With linear interpolation; 0 before the first batch."""
        if not self.seconds:
            return 0.0
        ordered = sorted(self.seconds)
        at = (len(ordered) - 1) * p
        low = math.floor(at)
        return 1000 * (ordered[low] + (at - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]))

    @property
    def texts_per_second(self) -> float:
        total = sum(self.seconds)
        return self.texts / total if total > 0 else 0.0
