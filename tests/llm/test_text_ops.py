"""Language ID, line dedup, license scan, BPE and packing."""

from __future__ import annotations

import hashlib
import inspect
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import bpe, langid, licenses, linededup, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang"), more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)], DOCS)


# --- language ID ------------------------------------------------------------


def brute_bits(text, counts, order):
    """PPM by its definition, one byte at a time, from counts of whole windows."""
    raw = b"\0" * order + text.encode()
    total = 0.0
    for i in range(order, len(raw)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            ctx = raw[i - k : i]
            follow = {}
            for gram, n in counts.items():
                if gram[order - k : order] == ctx:
                    follow[gram[-1]] = follow.get(gram[-1], 0) + n
            if not follow:
                continue
            every = sum(follow.values()) + len(follow)
            if raw[i] in follow:
                total -= np.log2(follow[raw[i]] / every)
                break
            total -= np.log2(len(follow) / every)
    return total


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths_are_exact(order):
    taught = {"a": ["the cat sat on the mat", "a hat"], "b": ["der hund und die katze", "ein huhn"]}
    taught |= {x: [f"{x} the {x}hund", x * 5] for x in "cdefg"}  # more than a panel
    counts, plain = {}, {}
    for lang, texts in taught.items():
        grams, n = np.unique(np.concatenate([langid.grams_of(t, order) for t in texts]), return_counts=True)
        counts[lang] = (grams, n)
        plain[lang] = {int(g).to_bytes(4, "big")[3 - order :]: int(c) for g, c in zip(grams, n, strict=True)}
    model = langid.Ppm(counts, order)
    texts = ["the hat", "die hunde", "ñandú zzz", "x"]
    got = model.lengths(texts, chunk=5)
    want = [[brute_bits(t, plain[lang], order) for lang in model.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_a_models_size_follows_its_grams_not_the_square_of_its_languages():
    rng = np.random.default_rng(2)
    sizes = []
    for langs in (10, 40):
        counts = {f"l{i}": (rng.choice(1 << 32, 5000, replace=False).astype(np.uint32), np.ones(5000)) for i in range(langs)}
        tables = [x for panel in langid.Ppm(counts, 3).panels for t, cost in (*panel.seen, *panel.escape) for x in (t.rows, t.keys, cost)]
        sizes.append(sum(x.nbytes for x in tables) / (5000 * langs))
    assert sizes[1] < 1.2 * sizes[0] < 400


def test_hash_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000).astype(np.uint32))
    table = langid.Table(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all()
    assert (table.find(keys[1::2]) == -1).all()
    assert (langid.Table(keys[:0]).find(keys[:5]) == -1).all()


def test_language_of_edge_rows(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "en"), (None, "the the", None), (1, "the cat and the dog", "en"), (6, "die katze " * 20_000, "de")], "doc_id long, text string, lang string")
    df = df.withColumns({"lang_pred": F.lit("x"), "score": F.lit(3.0)})
    rows = langid.identify(df, langid.train(df)).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 8 and got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 6: "de"}
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = langid.train(df.limit(0))
    assert [r.lang_pred for r in langid.identify(df.limit(1), nothing).collect()] == ["und"]
    assert langid.identify(df.limit(0), nothing).count() == 0


def test_held_out_accuracy(spark):
    from gleaner.llm.queries import op1_language_id

    sf = "/root/testdata/sf0.01"
    found = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_a_language_of_copies_is_learned_whole(spark):
    texts = [f"text number {i} of a few" for i in range(5)]
    df = spark.createDataFrame([(t, "en") for t in texts for _ in range(40)], "text string, lang string")
    whole = langid.train(spark.createDataFrame([(t, "en") for t in texts], df.schema))
    model = langid.train(df, max_docs=5)  # of 200 rows, but 5 texts
    assert model.langs == ["en"] and (model.lengths(texts) == whole.lengths(texts)).all()


# --- line dedup -------------------------------------------------------------


def brute_lines(rows, ratio, least):
    out = []
    for _, text, host in rows:
        mine = [t for _, t, h in rows if h == host]
        if text is None:
            out.append((None, 0, 0))
            continue
        lines = text.split("\n")
        gone = [host is not None and x.strip(" ") != "" and (n := sum(x in (t or "").split("\n") for t in mine)) >= least and n > ratio * len(mine) for x in lines]
        out.append(("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), gone.count(False), gone.count(True)))
    return out


@pytest.mark.parametrize("limit", [linededup.BROADCAST_LINES, 0])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", limit)
    rows = [(i, f"menu\nbody {i}\n\n  \nmenu\nfoot {i % 3}", "a") for i in range(9)] + [(20, "menu\nalone", "b"), (21, None, "a"), (22, "menu", None), (23, "", "a"), (24, "menu", "a"), (None, "menu\nx", "a"), (24, "menu", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit(1), "lines_kept": F.lit("x"), "line": F.lit(2), "pages": F.lit(3)})
    got = sorted(((r.doc_id, r.text, r.lines_kept, r.lines_dropped) for r in linededup.dedup_lines(df, ratio=0.2, min_pages=3).collect()), key=str)
    assert got == sorted(((i, *b) for (i, _, _), b in zip(rows, brute_lines(rows, 0.2, 3), strict=True)), key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_very_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(60_000)) + "\n" + "y" * 500_000
    df = spark.createDataFrame([(i, f"menu\n{long if i == 0 else i}", "a") for i in range(9)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert got[0].text == long and got[0].lines_kept == 60_001 and got[0].lines_dropped == 1 and got[3].text == "3"


# --- licenses ---------------------------------------------------------------


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_every_template_is_found_whole_and_damaged():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        page = f"Some words before it.\n{text}\nand some after, once and again"
        hit = [h for h in licenses.scan_text(page, index) if h[0] == name]
        assert len(hit) == 1 and hit[0][1] == 1.0, name
        words = licenses.words_of(text)
        assert page[hit[0][4] : hit[0][5]].lower().endswith(words[-1][0]) and page[hit[0][4] :].lower().startswith(words[0][0])
        if len(words) >= 20:
            marks = licenses.telling([w for w, _, _ in words])
            broken = [w for i, (w, _, _) in enumerate(words) if i % 11 != 5 or i in marks]
            broken.insert(7, "inserted")
            hit = [h for h in licenses.scan_text(" ".join(broken), index) if h[0] == name]
            assert len(hit) == 1 and hit[0][2] == lcs([w for w, _, _ in words], broken), name


def test_every_template_is_found_with_any_word_changed_or_missing():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = [w for w, _, _ in licenses.words_of(text)]
        marks = licenses.telling(words)
        for i in range(len(words)):
            alone = i in marks and list(marks.values()).count(words[i]) == 1  # without it, it is another license
            for other in (["zzz"], []):
                page = ["before", "it", *words[:i], *other, *words[i + 1 :], "and", "after"]
                hit = [h for h in licenses.scan_text(" ".join(page), index) if h[0] == name]
                assert lcs(words, page) == len(words) - 1
                assert [h[2] for h in hit] == ([] if alone else [len(words) - 1]), (name, i)
        lost = set(range(4, len(words), 5)) - set(marks)  # evenly: the longest runs are as short as can be
        page = ["zzz" if i in lost else w for i, w in enumerate(words)]
        assert [h[2] for h in licenses.scan_text(" ".join(page), index) if h[0] == name] == [lcs(words, page)], name
    assert [h[0] for h in licenses.scan_text("Distributed under the MIT License", index)] == ["MIT-notice"]
    assert [h[0] for h in licenses.scan_text("Licensed under CC BY-SA 4.0", index)] == ["CC-BY-SA-4.0-notice"]


def test_licenses_are_told_apart():
    index = licenses.Index(licenses.TEMPLATES)
    for text, want in {
        "Licensed under CC BY 4.0": ["CC-BY-4.0-short"],
        "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0-notice"],
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0-notice"],
        "Licensed under CC BY-NC 4.0": ["CC-BY-NC-4.0-notice"],
        "Licensed under CC BY-NC-ND 4.0": [],
        "Licensed under CC BY NC 4.0": [],
        "Licensed under CC BY 3.0": [],
        "Licensed under the Apache License, Version 1.1": [],
        "Licensed under the Apache License, Version 2.0": ["Apache-2.0-notice"],
        "Released under the BSD License": [],
        "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0-notice"],
        "This work is licensed under the GNU General Public License, version 3": ["GPL-3.0-notice"],
        "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0-notice"],
        "This work is licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1-notice"],
        "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0-notice"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0-long"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": [],
    }.items():
        assert [h[0] for h in licenses.scan_text(f"Before. {text}. After.", index)] == want, text
    for name, text in licenses.TEMPLATES.items():
        assert [h[0] for h in licenses.scan_text(text, index)] == [name]


def test_scan_against_every_diagonal(spark, sf):
    index = licenses.Index(licenses.TEMPLATES)
    rng, texts = np.random.default_rng(6), [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    names = sorted(licenses.TEMPLATES)
    for i, n in enumerate(names * 2):  # notices, whole and damaged, amid the texts
        words = licenses.TEMPLATES[n].split()
        words = [w for w in words if rng.random() > 0.06 * (i % 2)]
        at = texts[i].split(" ")
        at[len(at) // 2 : len(at) // 2] = words
        texts[i] = " ".join(at)
    for text in texts:
        found = licenses.words_of(text)
        words = [w for w, _, _ in found]
        got = {}
        for n, coverage, _, _, start, end in licenses.scan_text(text, index):
            got.setdefault(n, []).append((coverage, start, end))
        want = {}
        for n, template in index.words.items():
            band, need, marks = max(2, len(template) // 8), 0.8 * len(template), index.marks[n]
            for d in range(-band, len(words)):
                window = set(words[max(0, d - band) : d + len(template) + band])
                if sum(w in window for w in template) >= need and licenses.fits(x := licenses.align(template, words, d, band, marks), template, marks, words, 0.8):
                    want.setdefault(n, []).append((x[0] / len(template), found[x[1]][1], found[x[2]][2]))
        beaten = {n for n in want for o in want if (n, o) in index.alike and max(want[o])[0] * len(index.words[o]) > max(want[n])[0] * len(index.words[n])}
        assert set(got) == set(want) - beaten
        for n, hits in got.items():
            best = max(want[n])
            assert max(hits)[0] == best[0], n
            assert all(any(s < e2 and s2 < e for _, s2, e2 in hits) for _, s, e in want[n])  # every occurrence is reported


def test_two_occurrences_and_none():
    index = licenses.Index(licenses.TEMPLATES)
    text = "Released under the MIT License. " + "filler " * 50 + "RELEASED under the mit license"
    found = [h for h in licenses.scan_text(text, index) if h[0] == "MIT-notice"]
    assert [text[h[4] : h[5]] for h in found] == ["Released under the MIT License", "RELEASED under the mit license"]
    for clean in (None, "", "a license to kill", "the mit", "permission denied"):
        assert licenses.scan_text(clean, index) == []
    assert licenses.scan_text("anything", licenses.Index({})) == []


def test_scan_edge_rows_and_corpus(spark, sf):
    df = docs(spark, [None, "", "x " * 60_000 + "Licensed under CC BY-NC 4.0.", "nothing"]).withColumns({"license": F.lit(1), "coverage": F.lit(2)})
    assert [(r.doc_id, r.license) for r in licenses.scan(df).collect()] == [(2, "CC-BY-NC-4.0-notice")]
    assert licenses.scan(df.limit(0)).count() == 0
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = ("Licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3", "Licensed under the Apache License, Version 2.0", "Released under the MIT License")
    want = {r.doc_id for r in corpus.select("doc_id", "text").collect() if any(x in r.text for x in lines)}
    assert {r.doc_id for r in licenses.scan(corpus).collect()} == want


# --- BPE --------------------------------------------------------------------

TEXTS = [None, "", " ", "hello world", "Hello, WORLD! it's we'll they've", "  two  spaces\n\n\ttabs \r\n", "ñandú größe 東京 🙂🙃", "<|endoftext|>a<|endoftext|> <|endoftext|", "1234567890 3.14", "a" * 3000, "́e e​x", "\x00\x01\x7f\x85\xa0"]


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoding_is_the_librarys(library):
    coder = bpe.Bpe(PATH, cache=40)
    for _ in range(2):  # again from memory, and after it was forgotten
        assert coder.encode_batch(TEXTS) == [ids_of(library, t) for t in TEXTS]
    for t in TEXTS:
        assert coder.decode(ids_of(library, t)) == library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text_round_trips(texts):
    library, coder = Tokenizer.from_file(PATH), bpe.load(PATH)
    blobs = coder.encode_batch(texts)
    assert blobs == [ids_of(library, t) for t in texts]
    assert [coder.decode(b) for b in blobs] == texts


def test_words_share_prefixes_but_not_results():
    coder = bpe.Bpe(PATH)
    words = ["inter", "international", "internationalization", "in", "interim", "zz", "z"]
    by_rank = [np.array([coder.by_bytes[p] for p in coder.merged(w.encode())], "<u4").tobytes() for w in words]
    assert coder.encode_words(words) == by_rank


def test_encode_and_decode_frames(spark, library):
    df = docs(spark, TEXTS).withColumns({"ids": F.lit("x"), "decoded": F.lit(1), "__x": F.lit(2)})
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert got == {i: (ids_of(library, t), t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.round_trip(df, PATH).collect()} == got
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).collect()] == [""]


def test_query_encodes_what_the_library_does(spark, library):
    from gleaner.llm.queries import op10_bpe

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_bpe(spark, sf).collect()} == want


def test_long_texts_and_null_ids_round_trip(spark, library):
    texts = ["word " * 200_000, "x" * 200_000, None]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((bytes(r.ids), r.decoded) for r in bpe.round_trip(df, PATH).collect())
    assert got == sorted((ids_of(library, t), t or "") for t in texts)


# --- packing ----------------------------------------------------------------


def check_packing(rows, texts, library, capacity):
    texts = texts if isinstance(texts, dict) else dict(enumerate(texts))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    for i, a in ids.items():
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(a)
        assert all(m[2] == capacity for m in mine[1:]) and (len(mine) == 1 or len(a) > capacity)
        at = 0
        for _, start, length, crc in mine:
            assert start == at and crc == zlib.crc32(a[start : start + length].tobytes())
            at += length
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(map(len, ids.values()))


def test_packing_fixture(spark, library):
    texts = [None, "", "one", "a b c d e f g h", *(f"w{i} " * (i % 37) for i in range(120)), "long text " * 500]
    df = docs(spark, texts).withColumns({"piece": F.lit("x"), "offset": F.lit(1), "sequence_id": F.lit(2), "length": F.lit(3)})
    rows = packing.pack(df, PATH, capacity=64).collect()
    made, tokens = check_packing(rows, texts, library, 64)
    assert made <= -(-tokens // 64) + 3
    split = packing.pack(df, PATH, capacity=64, group_pieces=30).collect()
    check_packing(split, texts, library, 64)
    full = packing.pack(df, PATH, capacity=64, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in full)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_query_packs_what_the_library_encodes(spark, library):
    from gleaner.llm.queries import op4_packing

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    made, tokens = check_packing(op4_packing(spark, sf).collect(), texts, library, 2048)
    assert made <= 1.01 * -(-tokens // 2048)


def test_the_querys_own_bounds_close_bins_and_pack_well(spark):
    rng = np.random.default_rng(5)
    lengths = [int(n) for n in np.minimum(2048, rng.lognormal(6.4, 0.8, 20_000) + 1)]
    rows = packing.place(spark.createDataFrame(list(enumerate(lengths)), "id long, length long")).orderBy("sequence_id", "offset").collect()
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(lengths))
    held = {}
    for r in rows:
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048 and len(held) <= 1.005 * -(-sum(lengths) // 2048)
    bins = packing.OpenBins(2048, inspect.signature(packing.place).parameters["most_open"].default)
    window = inspect.signature(packing.place).parameters["window_pieces"].default
    for i in range(0, len(lengths), window):
        for n in sorted(lengths[i : i + window], reverse=True):
            bins.place(n)
    assert bins.closed > 100


def test_long_texts_that_tiktoken_rejects_are_encoded_all_the_same(library):
    text = "a" + " " * 1_200_000 + "b"
    assert packing.FastBpe(PATH).encode(text) == ids_of(library, text)


def test_repeated_rows_and_null_ids_are_packed(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y")], "doc_id long, text string")
    assert len(packing.pack(df, PATH).collect()) == 3


def test_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # exactly fills the tighter one
    assert bins.place(9) == (2, 0)
    assert bins.place(8) == (3, 0)  # a third: the fullest, with 1 left, closes
    assert bins.place(1) == (3, 8)
    assert bins.place(4) == (0, 6)
    assert bins.place(10) == (4, 0) and bins.open == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 20))
def test_bins_never_overflow(sizes, most):
    bins, held = packing.OpenBins(50, most), {}
    for n in sizes:
        number, offset = bins.place(n)
        assert offset == held.get(number, 0)
        held[number] = offset + n
        assert held[number] <= 50 and bins.open <= most
    assert sorted(held) == list(range(len(held)))


def test_large_ids_stay_exact_beside_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "the cat", "en"), (None, None, None), (big + 2, "Licensed under CC BY-NC 4.0", "en")], "doc_id long, text string, lang string")
    want = {big, big + 2}
    for made in (langid.identify(df, langid.train(df)), packing.pack(df, PATH), bpe.encode(df, PATH)):
        assert {r.doc_id for r in made.collect()} == want | {None}
    assert [r.doc_id for r in licenses.scan(df).collect()] == [big + 2]
