"""Column functions and contracts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import contracts
from gleaner.functions import salary, text, time, vector


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.split_growth, "Excel; Data  Entry ;;excel", ["excel", "data entry", "excel"]),
        (text.split_growth, "a, b;c", ["a, b", "c"]),
        (text.split_growth, "a, B", ["a", "b"]),
        (text.split_growth, None, []),
        (text.split_cluster, "A|b, c;d|", ["a", "b", "c", "d"]),
        (text.split_cluster, None, []),
        (text.split_evolution, "sql, SQL; patient  care|c++", ["SQL", "Patient Care", "C++"]),
        (text.split_evolution, " .; ,", []),
        (text.split_profile, "A, a ,,B;c", ["A", "a", "B;c"]),
    ],
)
def test_splitters(spark, f, value, want):
    assert one(spark, f(lit(value))) == want


def test_normalize_skill(spark):
    for raw, want in (("  python ", "Python"), ("javaScript.", "JavaScript"), ("data   ENTRY", "Data Entry"), ("c#", "C#"), ("/r/", "R")):
        assert one(spark, text.normalize_skill(lit(raw))) == want


def test_keyword_score_counts_repeats_and_substrings(spark):
    assert one(spark, text.keyword_score(lit("Database data/DATA"), ["data"])) == 3
    assert one(spark, text.keyword_score(lit("sales"), ["sales", "sales", "sale"])) == 3
    assert one(spark, text.keyword_score(lit(None), ["x"])) == 0


def test_job_card_order_and_omission(spark):
    card = text.job_card(lit(" Nurse "), lit(""), lit("Full-time"), lit(None), lit("A, B"), lit("text\nmore "))
    assert one(spark, card) == "Title: Nurse\nWork type: Full-time\nSkills: A, B\nDescription: text\nmore"
    assert one(spark, text.job_card(*[lit(None)] * 6)) == ""


def test_eval_text(spark):
    assert one(spark, text.eval_text(lit("a  b"), lit(" "), lit("c\nd"))) == "TITLE: a b\nDESCRIPTION: c d"
    assert one(spark, text.eval_text(lit("a"), lit("x"), lit(None))) == "TITLE: a\nSKILLS: x\nDESCRIPTION: "


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip(lit("\t  a b \n"))) == "a b"
    assert one(spark, text.join_texts([lit("a"), lit(None), lit("b")])) == "a  b"
    assert one(spark, text.strip_accents(lit("naïve Ñandú ß ž"))) == "naive Nandu ß z"
    assert one(spark, text.strip_accents(lit("e\u0301 ﬁn ﬄ Ĳ ｆｕｌｌ ά й ①"))) == "e fin ffl IJ full α и 1"
    assert one(spark, text.json_object(lit('say {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'
    assert one(spark, text.json_object(lit("none"))) is None


@pytest.mark.parametrize(
    ("values", "strict", "want"),
    [
        (["2024-03-05", "2024-03-05 10:30:00", "bad", None], True, ["2024-03-05 00:00", "2024-03-05 10:30", None, None]),
        (["1709600000000", "1709686400000", "x"], False, ["2024-03-05 00:53", "2024-03-06 00:53", None]),
        (["1709600000", "1709686400"], False, ["2024-03-05 00:53", "2024-03-06 00:53"]),
        (["1709600000000", None], True, [None, None]),
        ([None, None], False, [None, None]),
    ],
)
def test_text_times(spark, values, strict, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = time.with_time(df, "t", strict=strict).orderBy("i").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("x"))
    assert [r.x for r in got.collect()] == want


def test_numbers_and_timestamps(spark):
    df = spark.createDataFrame([(1709600000000,), (None,)], "t long")
    assert [r.x for r in time.with_time(df, "t", strict=True).select(F.date_format("ts", "yyyy").alias("x")).collect()] == ["2024", None]
    stamped = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' as t")
    assert one(spark, F.lit(1)) == 1 and time.with_time(stamped, "t").select(F.date_format("ts", "HH:mm").alias("x")).first().x == "03:04"


@pytest.mark.parametrize(("size", "want"), [("H", "2024-03-06 10:00"), ("D", "2024-03-06"), ("W", "2024-03-04/2024-03-10"), ("M", "2024-03")])
def test_bins(spark, size, want):
    ts = F.lit("2024-03-06 10:11:12").cast("timestamp")
    assert one(spark, time.time_bin(ts, size)) == want
    assert one(spark, time.bin_start(time.time_bin(ts, size))) is not None
    with pytest.raises(ValueError, match="unsupported"):
        time.time_bin(ts, "Q")


def test_salary_golden_values(spark):
    rows = [(100000.0, None, None, None, None), (None, 50.0, None, None, "hourly"), (None, None, 10.0, 20.0, "MONTHLY"), (0.0, 50.0, None, None, "HOURLY"), (None, 5.0, None, None, "daily")]
    df = spark.createDataFrame(rows, "normalized_salary double, med_salary double, min_salary double, max_salary double, pay_period string")
    assert [r.x for r in df.select(salary.annual_salary(df.columns).alias("x")).collect()] == [100000.0, 104000.0, 180.0, None, None]
    bare = spark.createDataFrame([("7",), ("x",)], "normalized_salary string")
    assert [r.x for r in bare.select(salary.annual_salary(bare.columns).alias("x")).collect()] == [7.0, None]


def test_vectors(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, vector.cosine(arr(1.0, 0.0), arr(0.0, 0.0))) is None
    assert one(spark, vector.cosine(arr(1.0, 0.0), arr(0.0, 0.0), 0.0)) == 0.0
    assert math.isclose(one(spark, vector.cosine_distance(arr(1.0, 1.0), arr(1.0, 0.0))), 1 - 1 / math.sqrt(2))
    assert one(spark, vector.unit(arr(3.0, 4.0))) == [0.6, 0.8]
    import hashlib

    raw = np.frombuffer(hashlib.sha256("é".encode()).digest(), np.uint8)[np.arange(40) % 32] / 127.5 - 1
    assert np.allclose(one(spark, vector.mock_embedding(F.lit("é"), 40)), raw / np.linalg.norm(raw))


def test_contracts(spark):
    df = spark.createDataFrame([(1, "t")], "job_id long, title string")
    assert contracts.check_columns(df.columns, ("job_id", "x", "a")) == contracts.Columns(["a", "x"], ["title"])
    with pytest.raises(ValueError, match="postings.*missing.*description"):
        contracts.assert_columns(df, contracts.POSTINGS_REQUIRED, "postings")
    with pytest.raises(ValueError, match="time column"):
        contracts.detect(df)
    with pytest.raises(ValueError, match="no text column"):
        contracts.detect(df.select("job_id"))
    found = contracts.detect(df.withColumns({"listed_time": F.lit(1), "expiry": F.lit(1), "closed_time": F.lit(1)}))
    assert (found.time, found.closure, found.skill, found.decay_available) == ("listed_time", "closed_time", None, True)
