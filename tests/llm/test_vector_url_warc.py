"""Nearest neighbours, lattice hashing, URL rules, WARC archives, and the pipeline."""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, lattice, urlrules, warc

VECS = "vec_id long, embedding array<float>, label int"


# --- nearest neighbours -----------------------------------------------------


def brute_nearest(rows, k, is_query):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in good:
        if is_query(q):
            scored = sorted((-float(np.dot(good[q], x)), i) for i, x in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def nearest(df, k, mod=2, **how):
    out = {}
    for r in ann.search(df, F.col("vec_id") % mod == 0, k, **how).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [v[i] for i in range(1, len(v) + 1)] for q, v in out.items()}


def test_nearest_with_ties_norms_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 + i % 4)).tolist(), 0) for i in range(60)]
    rows += [(100 + i, rows[3][1], 0) for i in range(30)]
    rows += [(200, None, 0), (202, [0.0] * 8, 0), (204, [float("nan")] * 8, 0), (206, [1.0, None] + [0.0] * 6, 0), (208, [], 0), (None, rows[0][1], 0), (2, rows[2][1], 0)]
    df = spark.createDataFrame(rows, VECS).withColumns({"leaf": F.lit(1), "score": F.lit(2), "id": F.lit(3), "rank": F.lit(4)})
    got, want = nearest(df, 20, confidence=1.0), brute_nearest([r for r in rows], 20, lambda i: i % 2 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-6 for q in got for a, b in zip(got[q], want[q], strict=True))
    assert ann.search(df.limit(0), F.lit(True), 5).count() == 0
    few = spark.createDataFrame(rows[:4], VECS)
    assert {q: len(v) for q, v in nearest(few, 20).items()} == {0: 3, 2: 3}


def test_recall_over_leaves_and_shards(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 64), ("MAX_LEAVES", 4), ("BLOCK_QUERIES", 16), ("BUCKET", 8)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + 0.3 * rng.normal(size=16)).tolist(), 0) for i in range(600)]
    got = nearest(spark.createDataFrame(rows, VECS), 10, 10)
    want = brute_nearest(rows, 10, lambda i: i % 10 == 0)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 10 * len(want)


def test_query_recall(spark):
    from gleaner.llm.queries import op2_nearest

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute_nearest(rows, 20, lambda i: i % 20 == 0)
    got = op2_nearest(spark, sf).collect()
    assert len(got) == 20 * len(want)
    assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) >= 0.9 * len(got)


def test_each_dimension_is_searched(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=(3, 2, 40)[i % 3]).tolist(), 0) for i in range(90)] + [(91, [1.0], 0), (94, [2.0], 0)]
    got = nearest(spark.createDataFrame(rows, VECS), 5, confidence=1.0)
    want = {}
    for d in (1, 2, 3, 40):
        want |= brute_nearest([r for r in rows if len(r[1]) == d], 5, lambda i: i % 2 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_query_recall(spark):
    from gleaner.llm.queries import op2_nearest

    sf = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(vectors.embedding).astype(np.float64), vectors.vec_id.to_numpy()
    asked = ids % 20 == 0
    score = x[asked] @ x.T
    score[np.arange(asked.sum()), np.flatnonzero(asked)] = -np.inf
    want = {(int(q), int(i)) for q, row in zip(ids[asked], score, strict=True) for i in ids[np.lexsort((ids, -row))[:20]]}
    got = {(r.query_id, r.vec_id) for r in op2_nearest(spark, sf).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_chi_square():
    assert abs(ann.chi2_cdf(np.array([15.507]), 8)[0] - 0.95) < 1e-4
    assert abs(ann.chi2_cdf(np.array([2.0]), 2)[0] - (1 - math.exp(-1))) < 1e-12


# --- lattice ----------------------------------------------------------------


def brute_lattice(rows, threshold):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    links = [{j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold} for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted((r[0], len(x), c, r[0] == c) for r, x, c in zip(rows, links, comp, strict=True))


@pytest.fixture
def batch_rows(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("block", "batch_rows"), [(512, 10_000), (4, 10_000), (512, 7), (4, 1)], indirect=["batch_rows"])
def test_lattice_against_brute_force(spark, monkeypatch, block, batch_rows):
    monkeypatch.setattr(lattice.class_links, "__defaults__", ("f8", block))
    rng = np.random.default_rng(3)
    rows, base = [], [rng.normal(size=24) for _ in range(6)]
    for i in range(120):
        b = base[i % 6]
        rows.append((i, (b + rng.choice([0.0, 0.02, 0.3, 3.0]) * rng.normal(size=24) * np.linalg.norm(b) / 5).astype(np.float32).tolist(), int(i % 6 // 2) if i % 11 else None))
    rows += [(500 + i, rows[1][1], rows[1][2]) for i in range(9)] + [(600, None, 1), (601, [0.0] * 24, 1), (602, [float("inf")] * 24, 1), (603, [1.0, 2.0], 1), (604, [2.0, 4.0], 1), (605, [], 1), (606, [None] * 24, 1)]
    rows += [(1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, VECS).withColumns({"salt": F.lit(1), "unit": F.lit(2), "id": F.lit(3), "n_links": F.lit(4)})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_dups(df).collect())
    assert got == brute_lattice(rows, 0.93)
    assert lattice.near_dups(df.limit(0)).count() == 0


def test_lattice_with_null_ids(spark):
    v, w = [1.0] * 9, [1.0] * 8 + [-1.0]
    df = spark.createDataFrame([(None, v, 1), (7, v, 1), (None, w, 2), (None, w, 2), (None, None, 1)], VECS)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_dups(df).collect()), key=str)
    assert got == sorted([(None, 1, 7, None), (7, 1, 7, True), (None, 1, None, None), (None, 1, None, None), (None, 0, None, None)], key=str)


def test_lattice_returns_no_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    rows = [(i, (base + 0.1 * rng.normal(size=32)).astype(np.float32).tolist(), 1) for i in range(400)]
    found = lattice._hashed(spark.createDataFrame([(i, 1, False, v) for i, v, _ in rows], "id long, salt long, bare boolean, v array<float>"), {})
    links = lattice.class_links(found.select(F.col("id").alias("cid"), "salt", "vec", "keys", F.lit(1).cast("long").alias("n")), 0.93, "f4").collect()
    linked = sum(r.more for r in links) // 2
    assert linked > 70_000 and len(links) < 400 * 18  # a row for each vector and group at most


def test_query_links(spark):
    from gleaner.llm.queries import op3_lattice

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op3_lattice(spark, sf).collect()) == brute_lattice(rows, 0.93)


def test_nearest_lattice_point():
    rng = np.random.default_rng(5)
    roots = lattice.e8_roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2)
    x = rng.normal(size=(400, 8)) * 3
    home = lattice.nearest_e8(x)
    assert (np.allclose(home * 2, np.rint(home * 2))) and (home.sum(1) % 2 == 0).all()
    mine = ((x - home) ** 2).sum(1)
    assert (mine <= 1 + 1e-9).all()  # the covering radius is 1
    assert (mine[:, None] <= ((x[:, None] - home[:, None] - roots) ** 2).sum(2) + 1e-9).all()


# --- URL rules --------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.org/x", "a.org", "/x", "org/", "allow"),
        ("HTTPS://WWW.Example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com/de/1://y.org/", "x.com", "/de/1://y.org/", "com/de/", "block"),
        ("http://a.org", "a.org", "", None, None),
        ("http://a.org?x=/", "a.org", "", None, None),
        ("http://a.org:80/", "a.org:80", "/", None, None),
        ("http://ÄB.org/", "Äb.org", "/", "org/", "allow"),
        ("x://a.net/\nfr/", "a.net", "/\nfr/", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string").withColumns({"hand": F.lit(1), "tokens": F.lit(2)})
    r = urlrules.judge(df).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == (verdict or "allow")


def brute_rules(items, support, confidence):
    """Association rules by counting every combination."""
    n, out = len(items), {}
    every = {}
    for tokens, verdict in items:
        tokens = sorted(tokens)
        for bits in range(1, 1 << len(tokens)):
            key = frozenset(t for i, t in enumerate(tokens) if bits >> i & 1)
            every.setdefault(key, []).append(verdict)
    for key, verdicts in every.items():
        for v in set(verdicts):
            c = verdicts.count(v)
            if c / n >= support and c / len(verdicts) >= confidence:
                out[key, v] = c / len(verdicts)
    return {(k, v) for (k, v), c in out.items() if not any(k2 < k and v2 == v and c2 >= c for (k2, v2), c2 in out.items())}


def test_mined_rules_against_brute_force(spark):
    items = [({"top=org", "folder1=en"}, "allow")] * 9 + [({"top=org", "folder1=es", "sub=w"}, "block")] * 5 + [({"top=com", "folder1=es"}, "block")] * 4 + [({"top=com", "folder1=en"}, "block")] * 1 + [({"top=com"}, "allow")] * 2
    df = spark.createDataFrame([(sorted(t), v) for t, v in items], "tokens array<string>, verdict string")
    got = {(frozenset(r.antecedent), r.verdict) for r in urlrules.mine(df, 0.1, 0.8).collect()}
    assert got == brute_rules(items, 0.1, 0.8)
    assert urlrules.mine(df.limit(0)).count() == 0


def test_mined_verdicts_and_hot_urls(spark):
    long = "http://w.example.org/es/7?" + "/".join(f"p{i}" for i in range(3000))
    rows = [(i, long) for i in range(40)] + [(100 + i, f"http://s{i}.example.org/en/{20 + i}") for i in range(40)] + [(200, "http://x.example.net/es/5?"), (201, "http://x.example.net/en/5"), (200, "http://x.example.net/es/5?"), (None, None)]
    got = {r.page_id: r.verdict for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "block" and got[201] == "allow" and got[0] == "block" and got[None] == "allow"
    assert urlrules.judge(spark.createDataFrame(rows, "page_id long, url string").limit(0)).count() == 0


def brute_tokens(url):
    url = url or ""
    scheme, sep, rest = url.partition("://")
    cut = min([len(rest), *(i for c in "/?#" if (i := rest.find(c)) >= 0)]) if sep else 0
    host = rest[:cut].lower() if sep else ""
    path = rest[cut:].partition("#")[0].partition("?")[0] if sep else ""
    query = url.partition("#")[0].partition("?")[2]
    folders = [x for x in path.split("/") if x]
    labels = host.split(".")
    out = {f"scheme={scheme if sep else ''}", f"depth={len(folders)}", *(f"folder{i + 1}={'#' if f.isdigit() else f}" for i, f in enumerate(folders)), *(f"key={k.partition('=')[0]}" for k in query.split("&") if k)}
    out |= {f"top={labels[-1]}"} if host else set()
    return out | ({f"site={'.'.join(labels[-2:])}"} | {f"sub={x}" for x in labels[:-2]} if len(labels) > 1 else set())


def test_tokens_are_those_of_the_whole_url(spark):
    urls = ["http://a.b.Example.org/x/12/y/z/q.html?k=1&&id=3&flag#k2=3", "https://h/?", "ftp://x.y", "none?a=1", "", None, "http://a.org/1/2/3/4/5/6/7/8/9/10/11"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    u = F.col("url")
    got = [set(r.t) for r in df.select(urlrules.tokens_of(u, urlrules.host_of(u), urlrules.path_of(u)).alias("t")).collect()]
    assert got == [brute_tokens(x) for x in urls]


def test_verdicts_against_enumerated_rules(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    more = [(10**6 + i, f"http://{h}/{a}/{b}?q={i}", ) for i, (h, a, b) in enumerate((h, a, b) for h in ("a.net", "w.example.net", "b.com") for a in ("en", "es", "fr", "de") for b in ("1", "docs"))]
    rows = pages.unionByName(spark.createDataFrame(more, "page_id long, url string"))
    got = {r.page_id: r for r in urlrules.judge(rows).collect()}
    tokens = {r.page_id: brute_tokens(r.url) for r in rows.collect()}
    hand = {i: r.verdict for i, r in got.items() if r.rule}
    where = {}
    for i in hand:
        for t in tokens[i]:
            where.setdefault(t, set()).add(i)
    reps = {}
    for t in sorted(where):
        if len(where[t]) >= 0.01 * len(hand):
            reps.setdefault(frozenset(where[t]), t)
    every = {}
    for i, v in hand.items():
        have = sorted(tokens[i] & set(reps.values()))
        for bits in range(1, 1 << len(have)):
            every.setdefault(frozenset(t for j, t in enumerate(have) if bits >> j & 1), []).append(v)
    rules = {(k, v): (vs.count(v) / len(vs), vs.count(v) / len(hand)) for k, vs in every.items() for v in set(vs)}
    rules = {r: c for r, c in rules.items() if c[1] >= 0.01 and c[0] >= 0.8}
    rules = {r: c for r, c in rules.items() if not any(x < r[0] and v == r[1] and d[0] >= c[0] for (x, v), d in rules.items())}
    order = sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]), r[1]))
    undecided = set(got) - set(hand)
    assert undecided and any(got[i].mined for i in undecided)
    for i in undecided:
        fit = [(*rules[r], -len(r[0]), -n, r) for n, r in enumerate(order) if r[0] <= tokens[i]]
        best = max(fit, key=lambda x: (round(x[0], 9), round(x[1], 9), *x[2:4]))[4] if fit else (None, "allow")
        assert (got[i].verdict, frozenset(got[i].mined) if got[i].mined else None) == (best[1], best[0]), i


# --- WARC -------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "große Seite " * 200
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (9, "v", "x" * 3_000_000), (5, "http://b/", big)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "refers_to": F.lit(2), "key": F.lit(3), "digest": F.lit(4)})
    got = warc.archive(df, str(tmp_path / "out")).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted(((i, len((h or "").encode()), sha(h), "revisit" if h == big and i in (1, 3) else "response", 5 if h == big and i in (1, 3) else None) for i, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert {bytes(r.payload) for r in got if r.page_id == 9} == {b"x" * 3_000_000}
    assert warc.archive(df.limit(0), str(tmp_path / "none")).count() == 0


def test_dictionary_leads_and_records_stand_alone(tmp_path):
    import struct

    import zstandard

    pages = [f"<html><body class='page'>{i} {'word ' * (i % 40)}</body></html>" * 20 for i in range(400)]
    writer = warc.Writer(f"file://{tmp_path}")
    made = [x for i, p in enumerate(pages) for x in writer.add(warc.record(i, f"http://h/{i}", p.encode(), None, False))] + list(writer.close())
    raw = open(made[0][0], "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size > 0 and made[0][1] == 400
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    first = zstd.decompressobj()
    out = first.decompress(raw[8 + size :])
    assert first.eof and warc.parse(out)[2] == pages[0].encode()
    assert [p for _, _, p in warc.read_records(io.BytesIO(raw))] == [p.encode() for p in pages]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(raw[:-3])))


def test_few_records_need_no_dictionary(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}")
    list(writer.add(warc.record(1, "u", b"x", None, False)))
    (name, n), = writer.close()
    assert n == 1 and [p for _, _, p in warc.read_records(open(name, "rb"))] == [b"x"]


# --- pipeline and SQL -------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as cp
    from gleaner.llm import simhash

    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "pack"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**9, "12345 !!", "en", "s", 8), (10**9 + 1, None, None, None, None), (10**9 + 2, "東京は日本の首都です。" * 20, None, "s", 200)], docs.schema)
    first = cp.language_id(spark, docs.unionByName(extra), sf)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert first.columns == docs.columns and kept == {r.doc_id for r in docs.select("doc_id").collect()}
    second = cp.line_dedup(spark, first, sf)
    assert second.columns == docs.columns and second.count() == first.count()
    rows = {r.doc_id: r.text for r in second.collect()}
    third = {r.doc_id for r in cp.near_dedup(spark, second, sf).collect()}
    for i in rows.keys() - third:  # what went is close to something that stands before it or links to it
        assert any(simhash.jaccard(rows[i], rows[j]) >= 0.8 for j in rows if j != i)
    seen = {}
    for i in sorted(rows):
        seen.setdefault(rows[i], i)
    assert all(i == seen[rows[i]] for i in third)
    packed = cp.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == third


def test_copies_are_not_boilerplate_in_the_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = [f"Menu of the site\nfirst{i} line{i} of{i} page{i} here{i}\nsecond{i} line{i} of{i} it{i} there{i}" for i in range(35)]
    one, two = "a hot text of two lines\nand its other words follow", "another text that is copied\nand has its own words too"
    rows = [(i, t, "en", "s") for i, t in enumerate([*pages, *[one] * 20, *[two] * 5])]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns)
    clean = cp.line_dedup(spark, df, sf)
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t.removeprefix("Menu of the site\n") for i, t, _, _ in rows}
    assert {r.doc_id for r in cp.near_dedup(spark, clean, sf).collect()} == {*range(35), 35, 55}


@pytest.mark.parametrize("name", ["op3_lattice", "op7_warc", "op9_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from gleaner.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(*names).collect())


def test_pipeline_stages_on_empty_and_repeated_rows(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    empty, twice = docs.limit(0), docs.unionByName(docs)
    once = {r.doc_id for r in cp.near_dedup(spark, docs, sf).collect()}
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
    assert cp.language_id(spark, twice, sf).count() == 2 * docs.count()
    assert cp.line_dedup(spark, twice, sf).count() == 2 * docs.count()
    assert sorted(r.doc_id for r in cp.near_dedup(spark, twice, sf).collect()) == sorted(once)
    assert cp.pack(spark, twice, sf).count() == 2 * cp.pack(spark, docs, sf).count()
