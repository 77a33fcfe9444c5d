"""URL filtering by hand-written rules and by association rules.

Where a hand-written rule fits a URL, the longest decides. The URLs so decided
are labels: Spark's FP-growth mines combinations of URL tokens that go with a
verdict, rules are pruned by support, confidence and generality, and the rest
are matched against them through an inverted index from tokens to rules.
DataFrame functions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import pin
from .common import small

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(host: F.Column, path: F.Column, rule: tuple[str, str, str]) -> F.Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def apply_rules(host: F.Column, path: F.Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> F.Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits; null if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*(F.when(_fits(host, path, r), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))) for r in ranked))


def tokens_of(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """A URL's tokens: scheme, top level, site, subdomains, depth, every folder by its place, and every key of the query. Numbers are one token."""
    labels = F.split(host, r"\.")
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = lambda x: F.regexp_replace(x, r"^\d+$", "#")
    kind = lambda name, value: F.concat(F.lit(f"{name}="), value)
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    found = F.array(
        kind("scheme", F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)),
        F.when(host != "", kind("top", F.element_at(labels, -1))),
        F.when(F.size(labels) > 1, kind("site", F.concat_ws(".", F.slice(labels, -2, 2)))),
        kind("depth", F.size(folders).cast("string")),
    )
    subs = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: kind("sub", x))
    places = F.transform(folders, lambda x, i: F.concat(F.lit("folder"), (i + 1).cast("string"), F.lit("="), plain(x)))
    keys = F.transform(query, lambda x: kind("key", F.regexp_extract(x, r"(?s)^([^=]*)", 1)))
    return F.array_distinct(F.concat(F.array_compact(found), subs, places, keys))


def frequent(labelled: DataFrame, min_support: float) -> list[str]:
    """Tokens on at least ``min_support`` of the rows; of tokens that stand on the same rows the first in order.

    Tokens that always come together say the same, and their combinations
    would double with each of them; a URL that is repeated often, however
    long, is one combination this way. At most ``tokens of a URL /
    min_support`` tokens come to the driver.
    """
    each = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), F.xxhash64("tokens").cast("decimal(20,0)").alias("row"))
    each = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).where(F.col("n") >= min_support * labelled.count())
    return sorted(r.token for r in each.groupBy("n", "rows").agg(F.min("token").alias("token")).collect())


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Association rules ``(rule_id, antecedent, verdict, confidence, support)`` from columns ``tokens`` and ``verdict``.

    A rule with a more general one of at least its confidence and the same
    verdict is pruned. Tokens that stand on the same rows are one (see
    ``frequent``). No labels, no rules.
    """
    spark = labelled.sparkSession
    schema = "rule_id long, antecedent array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    known = F.array_intersect("tokens", F.lit(frequent(labelled, min_support)).cast("array<string>"))
    items = labelled.select(F.array_append(known, F.concat(F.lit("verdict="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict=")).where(F.forall("antecedent", lambda x: ~x.startswith("verdict=")))
    rows = [(frozenset(r.antecedent), r.consequent[0].removeprefix("verdict="), r.confidence, r.support) for r in found.collect()]
    rows.sort(key=lambda r: (len(r[0]), sorted(r[0]), r[1]))
    kept: dict[tuple[frozenset[str], str], float] = {}
    for have, verdict, confidence, _ in rows:
        general = [kept[x, verdict] for x in _subsets(have) if (x, verdict) in kept]
        if all(c < confidence for c in general):
            kept[have, verdict] = confidence
    rows = [(i, sorted(h), v, c, s) for i, (h, v, c, s) in enumerate(r for r in rows if (r[0], r[1]) in kept)]
    return spark.createDataFrame(rows, schema)


def _subsets(items: frozenset[str]) -> list[frozenset[str]]:
    """Its proper subsets, which are as many frequent combinations."""
    out = [frozenset()]
    for x in sorted(items):
        out += [s | {x} for s in out]
    return [s for s in out if s != items]


def judge(pages: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow", min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (the association rule's tokens).

    Every row is judged: by the longest hand-written rule that fits, else by
    the association rule of highest confidence (then support, then fewest
    tokens, then first in order), else by ``default``. A null URL or one
    without ``://`` has an empty host and path. Rows repeat as they come.
    Of the tokens only those that a rule names are looked at, and each set of
    them is matched once, however many URLs share it.
    """
    url = F.col("__url")
    rows = pages.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(url_col).alias("__url"))
    rows = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rows = rows.withColumn("hand", apply_rules(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(url, F.col("host"), F.col("path"))).drop("__url")
    mined = mine(rows.where("hand is not null").select("tokens", F.col("hand.verdict").alias("verdict")), min_support, min_confidence)
    index = mined.select(F.explode("antecedent").alias("token"), "rule_id", F.size("antecedent").alias("need"))
    named = sorted({r.token for r in index.select("token").collect()})
    rows = rows.withColumn("tokens", F.array_sort(F.array_intersect("tokens", F.lit(named).cast("array<string>"))))
    sets = pin(rows.where(F.col("hand").isNull() & (F.size("tokens") > 0)).select("tokens").distinct())
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")  # as many rules as frequent combinations
    hits = hits.groupBy("tokens", "rule_id", "need").agg(F.count("*").alias("n")).where("n = need")
    best = hits.join(F.broadcast(mined), "rule_id").groupBy("tokens").agg(
        F.max_by(F.struct("verdict", "antecedent"), F.struct("confidence", "support", -F.col("need"), -F.col("rule_id"))).alias("best")
    )
    best = small(pin(best.withColumnRenamed("tokens", "t")), 50_000)
    chosen = rows.join(best, (F.col("tokens") == F.col("t")) & F.col("hand").isNull(), "left")
    return chosen.select(
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", F.col("hand.rule").alias("rule"),
        F.coalesce("hand.verdict", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.antecedent").alias("mined"),
    )
