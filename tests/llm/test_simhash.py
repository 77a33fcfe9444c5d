"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprint_is_the_stated_one():
    for text in (None, "", " \t ", "One", "one TWO", "Ä b c d", "a b c a b c a b c", "x" * 5000 + " y z"):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_edge_rows(spark):
    rows = [(3, None, None, None, None), (1, "", "x", "s", 1), (2, "  \n", None, None, None), (None, "a b c d", None, None, None), (7, "a b c d", "en", "s", 7), (7, "a b c d", "en", "s", 7), (9, "z " * 30_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "fingerprint": F.lit("x"), "root": F.lit(2)})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dups(df).collect()), key=str)
    zero = "0" * 16
    same = f"{simhash.fingerprint('a b c d'):016x}"
    long = f"{simhash.fingerprint('z z z'):016x}"
    assert got == sorted([(3, zero, 1), (1, zero, 1), (2, zero, 1), (None, same, 7), (7, same, 7), (7, same, 7), (9, long, 9)], key=str)
    assert simhash.near_dups(df.limit(0)).count() == 0


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({simhash._signed(s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))) for s in seeds for _ in range(15)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash.links(df, 2, chain=False).collect()} == near
    chained = {(r.a, r.b) for r in simhash.links(df, 2).collect()}
    assert chained <= near
    linked = brute_components(fps, lambda a, b: (min(a, b), max(a, b)) in near)
    assert linked == brute_components(fps, lambda a, b: (min(a, b), max(a, b)) in chained)


def test_query_against_brute_force(spark, sf):
    from gleaner.llm.queries import op6_simhash

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fps = {i: brute_fingerprint(t) for i, t in docs}
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2) if len(fps) <= 60 else None
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, sf).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    if want is None:
        pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
        want = {i: i for i in fps}
        for _ in range(20):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
    assert {i: c for i, (_, c) in got.items()} == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 60)] + [(77, 77), (None, 3), (3, None)] + [(500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)} | {500: 500, 501: 500}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_dups_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    near = [*base]
    near[100] = "changed"
    other = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(5, " ".join(base)), (9, " ".join(base)), (7, " ".join(near)), (1, " ".join(other)), (2, "short"), (3, "other words"), (4, None), (6, None), (8, ""), (5, " ".join(base))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({"k": F.lit("k"), "n": F.lit(3)})
    got = simhash.drop_near_dups(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5]  # 4, 6 and 8 have no words
    assert simhash.drop_near_dups(df.limit(0)).count() == 0


def test_jaccard():
    assert simhash.jaccard("a b c d e f", "a b c d e f") == 1.0
    assert simhash.jaccard("a b c d e f", "a b c d e g") == 1 / 3
    assert simhash.jaccard("a", None) == 0.0
    assert simhash.jaccard(None, "") == 1.0


def test_hashed_jaccard_is_that_of_sets():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 60):
        a = [rng.choice("abcdef") for _ in range(n)]
        for b in (a, a[1:], [*a[: n // 2], "x", *a[n // 2 + 1 :]], ["z"] * n):
            x, y = (set(simhash.shingles_of([w.encode() for w in t], 5)) for t in (a, b))
            want = len(x & y) / len(x | y) if x or y else 1.0
            assert simhash.jaccard(" ".join(a), " ".join(b)) == want


def edits(rng, n):
    """Pairs of random texts at 0.8 or more, by kind of edit."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = {"appended": [], "cut": [], "replaced": []}
    while min(map(len, out.values())) < n:
        words = rng.choices(vocabulary, k=rng.randint(30, 300))
        block, at = max(1, len(words) // rng.randint(6, 20)), rng.randint(0, len(words) // 2)
        one = rng.sample(range(len(words)), max(1, len(words) // 70))
        made = {
            "appended": words + rng.choices(vocabulary, k=block),
            "cut": words[:at] + words[at + block :],
            "replaced": [rng.choice(vocabulary) if i in one else w for i, w in enumerate(words)],
        }
        kind = min(out, key=lambda k: len(out[k]))  # each text has one copy
        if simhash.jaccard(" ".join(words), " ".join(made[kind])) >= 0.8:
            out[kind].append((" ".join(words), " ".join(made[kind])))
    return out


def test_block_edits_and_short_texts_are_met(spark):
    pairs = [p for kind in edits(random.Random(5), 60).values() for p in kind]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = simhash.drop_near_dups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 2 * len(pairs), 2))


def closure(texts):
    """Smallest id of each text's group, by brute force."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: set(simhash.hashed_shingles(simhash.words_of(t), 5).tolist()) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in texts}


@pytest.mark.parametrize(("block", "pivots"), [(simhash.BLOCK, simhash.PIVOTS), (4000, 3)])
def test_large_groups_are_closed(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 4000 shingles: some 20 texts
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rng, rows = random.Random(11), []
    for changed in (3, 4, 5):  # words of 200: most copies are near their base alone
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for n in range(121):
            at = rng.sample(range(200), changed) if n else []
            rows.append(" ".join(f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(base)))
    rng.shuffle(rows)
    texts = dict(enumerate(rows))
    got = simhash.drop_near_dups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == closure(texts)


def test_whole_documents_are_closed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id for r in simhash.drop_near_dups(docs).collect()} == closure(texts)


def test_a_dissimilar_text_of_the_same_words_hides_no_link(spark):
    rng = random.Random(3)
    b = [f"w{i}" for i in range(300)]
    c = [*b]
    c[150], c[151] = c[151], c[150]
    a = rng.sample(b, len(b))
    for rows, kept in (([(1, a), (2, b), (3, c)], [1, 2]), ([(2, b), (3, c)], [2])):
        got = simhash.drop_near_dups(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == kept


def test_forest_connects_what_links_connect():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(2, 25))
        base = rng.choice(1 << 40, 30, replace=False).astype(np.uint64)
        sets = [np.unique(np.r_[base[rng.random(30) > 0.08], rng.choice(1 << 40, int(rng.integers(1, 4))).astype(np.uint64)]) for _ in range(n)]
        node, known = np.arange(n) + 100, rng.integers(0, n, n)
        each = [set(x.tolist()) for x in sets]
        near = [(i, j) for i in range(n) for j in range(i) if len(each[i] & each[j]) / len(each[i] | each[j]) >= 0.8]
        same = [(i, j) for i in range(n) for j in range(i) if known[i] == known[j]]
        found = [(a - 100, b - 100) for a, b in simhash.forest(node, known, sets, 0.8)]
        assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in near}
        want, got = ({**dict.fromkeys(range(n))} for _ in range(2))
        for links, out in ((near + same, want), (found + same, got)):
            out.update({i: i for i in range(n)})
            for _ in range(n):
                for i, j in links:
                    out[i] = out[j] = min(out[i], out[j])
        assert got == want and len(found) < n
