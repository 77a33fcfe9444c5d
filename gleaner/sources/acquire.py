"""Getting a dataset's folder, and cutting a sample that keeps its keys whole."""

from __future__ import annotations

import tarfile
import time
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..operators.silver import keep_children
from .tables import CSV, exists

X = TypeVar("X")

# Tables of the dataset, with the key that ties them to the postings or to the companies.
CHILDREN = {"jobs/job_skills.csv": "job_id", "jobs/salaries.csv": "job_id", "jobs/benefits.csv": "job_id", "jobs/job_industries.csv": "job_id"}
BY_COMPANY = {"companies/companies.csv": "company_id", "companies/company_industries.csv": "company_id", "companies/company_specialities.csv": "company_id", "companies/employee_counts.csv": "company_id"}
WHOLE = ("mappings/skills.csv", "mappings/industries.csv")


def retry(action: Callable[[], X], tries: int = 4, wait: float = 1.0) -> X:
    """The action's result; a failure is tried again after a pause that doubles."""
    for i in range(tries):
        try:
            return action()
        except OSError:
            if i == tries - 1:
                raise
            time.sleep(wait * 2**i)
    raise ValueError("no tries")


def unpack(archive: Path, folder: Path) -> Path:
    """Unpacks a zip or tar file, and finds where the postings are."""
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            z.extractall(folder)
    else:
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
    found = next(iter(sorted(folder.rglob("postings.csv"))), None)
    if found is None:
        raise FileNotFoundError(f"no postings.csv in {archive}")
    return found.parent


def download(url: str, folder: str) -> Path:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    name = out / url.rsplit("/", 1)[-1]
    retry(lambda: urllib.request.urlretrieve(url, name))  # noqa: S310
    return unpack(name, out)


def sample(spark: SparkSession, source: str, target: str, n: int) -> dict[str, int]:
    """The n postings with the smallest ids, their children, companies and all mappings; returns rows by table."""
    read = lambda name: spark.read.options(**CSV, multiLine=True).csv(f"{source}/{name}")
    jobs = read("postings.csv")
    chosen = jobs.orderBy(jobs.job_id.cast("long")).limit(n).cache()
    tables: dict[str, DataFrame] = {"postings.csv": chosen}
    for names, key in ((CHILDREN, "job_id"), (BY_COMPANY, "company_id")):
        tables |= {name: keep_children(read(name), chosen, key) for name in names if key in jobs.columns and exists(spark, f"{source}/{name}")}
    tables |= {name: read(name) for name in WHOLE if exists(spark, f"{source}/{name}")}
    for name, df in tables.items():
        df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{target}/{name}")
    return {name: df.count() for name, df in tables.items()}
