"""Defined cases: NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gc
import random
import weakref
from fractions import Fraction
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwright.llm import ann, jaccard, licenses, lines, mixing, packing, quality, quotes, topk, urls
from foldwright.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, node long, component long, score double"


def documents(spark, rows):
    """Documents with columns that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 0.5) for i, t, s in rows], DOCS)


LONG = " ".join(f"word{i}" for i in range(20_000))
ODD = [
    (None, "no id at all here", None),
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n ", "a"),
    (4, LONG, "b"),
    (5, LONG, "b"),
    (6, LONG + " one more", "a"),
    (7, "a few words only", "a"),
    (7, "a few words only", "a"),
    (8, "A FEW words only", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, []).limit(0)


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 0.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [-1.0, -1.0]), (9, []), (10, [1.0])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")
    got = topk.exact_top_k(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 64 * 32 + 32 * 64), (2, 2, 4096), (3, 7, 0)]
    assert len(topk.exact_top_k(df, df.where("vec_id = 0"), 20).collect()) == 4
    assert topk.exact_top_k(df.limit(0), df.limit(0), 3).collect() == []
    got = ann.nearest_by_cosine(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 8]
    assert ann.nearest_by_cosine(df.limit(0), df.limit(0), 5).collect() == []


def test_top_k_against_all_pairs(spark):
    random_ = np.random.default_rng(3)
    centres = random_.standard_normal((20, 8)) * 3
    held = np.round(centres[random_.integers(0, 20, 5000)] + random_.standard_normal((5000, 8)) * 0.05, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, df.where("vec_id % 50 = 0"), 7).collect()
    whole = np.floor(held * 64)
    expected = set()
    for q in range(0, 5000, 50):
        score = whole @ whole[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(5000), -score))[:7]
        expected |= {(q, n + 1, int(v), int(score[v])) for n, v in enumerate(best)}
    assert {tuple(r) for r in got} == expected


def test_top_k_of_equal_vectors_and_shared_ids(spark):
    rows = [(i, [1.0, 0.25]) for i in range(3000)] + [(5, [1.0, 0.25]), (5, [1.0, 0.25]), (3, [2.0, 0.0]), (4000, [0.5, 0.5]), (4000, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, df.where("vec_id in (0, 3, 4000)"), 4).collect()
    ranked = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 3, 4000)}
    # Of the rows with id 3 the smallest vector is asked; no row with a query's own id is a candidate.
    assert ranked[0] == [3, 1, 2, 3] and ranked[3] == [0, 1, 2, 4]
    assert ranked[4000] == [3, 0, 1, 2]


def test_jaccard(odd, none):
    got = [tuple(r) for r in jaccard.similar_documents(odd, 3, Fraction(9, 10)).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(ODD)
    assert by[None][2] is None and by[None][1] == 3
    assert all(by[i][1:] == (0, i) for i in (1, 2, 3))
    assert by[4][2] == by[5][2] == by[6][2] == 4 and by[6][1] == by[4][1] + 2
    assert by[7][1:] == (2, 7) and by[8][1:] == (2, 7)
    assert jaccard.similar_documents(none).collect() == []
    kept = sorted(r["doc_id"] or 0 for r in jaccard.keep_one_per_group(odd).collect())
    assert kept == [0, 1, 2, 3, 4, 7, 7]


@pytest.mark.parametrize("width,similarity", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_jaccard_against_all_pairs(spark, width, similarity):
    draw = random.Random(7)
    base = [[f"w{draw.randrange(4000)}" for _ in range(draw.choice([3, 9, 12, 40, 150, 400]))] for _ in range(60)]
    rows = []
    for i in range(400):
        words = list(draw.choice(base))
        for _ in range(draw.randrange(0, max(2, len(words) // 12))):
            words[draw.randrange(len(words))] = f"w{draw.randrange(4000)}"
        rows.append((i, " ".join(words), "s"))
    sets = {}
    for i, text, _ in rows:
        w = text.split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))}
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * similarity.denominator >= len(sets[a] | sets[b]) * similarity.numerator]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    got = jaccard.similar_documents(documents(spark, rows).repartition(5), width, similarity).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), least[i]) for i in sets}


def test_sketches_bound_the_difference():
    draw, t = random.Random(1), Fraction(4, 5)
    bands = jaccard.Bands(t)
    for _ in range(300):
        n = draw.randrange(1, 200)
        a = {draw.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: draw.randrange(max(1, int(n * 0.7)), n + 1)]) | {draw.getrandbits(64) for _ in range(draw.randrange(0, n // 6 + 1))}
        flat = [np.sort(np.fromiter(x, np.uint64)) for x in (a, b)]
        linked = len(a & b) >= t * len(a | b)
        assert jaccard._similar(*flat, t, bands.apart(len(a) + len(b))) == linked
        if linked:
            sizes = np.array([len(a), len(b)])
            near = jaccard._NearSketches(t)([jaccard.folded_sketch(x) for x in flat], sizes, 0, np.array([1]))
            assert near.all()
            keys = [set(jaccard._word_keys(x, np.array([0, len(x)]), bands)[0].tolist()) for x in flat]
            assert a == b or keys[0] & keys[1]


RULES = [("allow", "org", "/"), ("block", "Example.org", "/es/"), ("block", "com", ""), ("allow", "com", "")]


def test_urls(spark):
    rows = ["http://EXAMPLE.org/es/1?x", "https://a.example.org/en", "http://org", "notexample.org/es/", None, "ftp://x.com#top",
            "http://badexample.org/es/", "x://com", "://org/", "http://a.org/b?c://d.com/", "http://" + "a." * 5000 + "org/" + "p" * 5000]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate([*rows, rows[0]])], "page_id long, url string, host int, rule int")
    got = {r["page_id"]: r for r in urls.filter_urls(df, RULES).collect()}
    assert len(got) == len(rows) + 1 and got[0]["host"] == got[len(rows)]["host"] == "example.org"
    assert [got[i]["rule"] for i in range(11)] == ["example.org/es/", "org/", None, None, None, "com", "org/", "com", "org/", "org/", "org/"]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4, 5)] == ["block", "allow", "allow", "allow", "block"]
    assert (got[3]["host"], got[3]["path"], got[4]["host"]) == ("", "", "")
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    joined = urls.filter_urls_by_join(df, table).collect()
    assert {r["page_id"]: r for r in joined} == got
    assert urls.filter_urls(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in urls.filter_urls(df, [], "block").collect()} == {"block"}
    with pytest.raises(ValueError):
        urls.filter_urls(df, [("maybe", "org", "/")])


def test_digests_that_collide(tmp_path):
    same = lambda text: 5
    urls.DigestArray.write(str(tmp_path), "x", [("allow", "a", "/"), ("block", "b", "/")], same)
    index = urls.DigestArray(str(tmp_path), "x")
    assert index.probe([urls._entry(h, b"/") for h in (b"a", b"b", b"c")], same) == ["allow", "block", None]


def test_licenses(spark, odd, none):
    rows = [(1, "prose\n  LICENSED under the apache license; version 2.0!\nprose", "s"), (2, None, "s"), (3, "", "s"), (4, LONG, "s"),
            (5, "All rights\nreserved", "s"), (5, "All rights\nreserved", "s"), (None, "Released under the MIT License", "s"), (6, "rights", "s")]
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    found = sorted((r["doc_id"] or 0, -1 if r["line_no"] is None else r["line_no"], r["license"], r["dice"]) for r in got)
    assert found == [(0, 0, "mit", 1.0), (1, 1, "apache-2.0", 1.0), (5, -1, "reserved", 1.0), (5, -1, "reserved", 1.0)]
    assert licenses.scan_licenses(none).collect() == licenses.scan_licenses(odd, {}).collect() == []


def test_licenses_inside_texts(spark):
    full, fill = licenses.full_texts(), "words of the code around it\n" * 30
    commented = "\n".join(f" * {line}" for line in full["apache-2.0-header"].split("\n"))
    rows = [(i, f"{fill}Copyright (c) 2020 Example\n{full[name]}\n{fill}", "s") for i, name in enumerate(sorted(full)) if name.endswith("-text")]
    rows += [(100, commented, "s"), (101, 'Licensed under the Apache License, Version 2.0 (the "License");', "s"),
             (102, "Licensed under the MIT License.", "s"), (103, "Copyright (c) 2020 Example. All rights reserved.", "s"),
             (104, "This code is\nreleased under\nthe MIT license and more.", "s"), (105, "The license is MIT, and rights are reserved to all.", "s"),
             (106, "All rights reserved.\nAgain: all rights reserved. Yes, all rights reserved!", "s")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    for i, name in enumerate(sorted(full)):
        if name.endswith("-text"):
            assert got[i, name]["dice"] > 0.99 and got[i, name]["line_no"] >= 30
    assert got[100, "apache-2.0-header"]["dice"] == got[100, "apache-2.0"]["dice"] == 1.0
    assert got[101, "apache-2.0"]["dice"] == got[102, "mit-notice"]["dice"] == got[103, "reserved"]["dice"] == 1.0
    assert got[104, "mit"]["line_no"] == 1 and not any(i == 105 for i, _ in got)
    found = licenses.scan_licenses(documents(spark, rows[-1:])).collect()
    assert [(r["line_no"], r["license"]) for r in found] == [(0, "reserved"), (1, "reserved"), (1, "reserved")]


def test_windows_against_all():
    draw = random.Random(4)
    index = licenses.WindowIndex({"t": "a b c d e f g h i j"}, Fraction(9, 10))
    for _ in range(1500):
        words = list("abcdefghij")
        for _ in range(draw.randrange(0, 3)):
            words[draw.randrange(0, 10)] = draw.choice("abxy")
        words = draw.choices("abcxy", k=draw.randrange(0, 6)) + words + draw.choices("abhijx", k=draw.randrange(0, 6))
        near = set()
        for x in range(len(words)):
            for y in range(x + 1, min(len(words), x + 12)):
                unit = set(zip(words[x:y], words[x + 1 : y + 1]))
                if 20 * len(unit & index.sets["t"]) >= 9 * (len(unit) + 9):
                    near.add((x, y))
        got = index.windows(words)
        assert bool(got) == bool(near) and all((x, y) in near for _, x, y, _, _ in got)


def test_quotes(spark):
    first = "Hello there everyone, this is the first message.\nSecond line of it, rather long."
    rows = [
        (1, 0, "u", first),
        (1, 1, "v", "On Monday A wrote:\n> Hello there everyone, this is the first message.\nI agree with this statement fully."),
        (1, 2, "w", "> > hello there   everyone, this is the first message.\n> I agree with this statement fully.\nNo, I do not."),
        (2, 0, "u", ">I agree with this statement fully.\nfrom another list"),
        (2, 1, "x", "> from another list"),
        (3, 0, "u", None),
        (None, 1, "u", "> from another list"),
        (3, None, "a", ""),
        (3, 1, "u", "> short\n>never said before by anyone"),
        (3, 1, "u", "> short\n>never said before by anyone"),
        (4, 0, "u", LONG),
        (4, 1, "u", "> " + LONG + "\nyes"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, message int, own int, depth int")
    got = quotes.link_quotations(df)
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert got.count() == len(rows)
    links = {k: (r["parent_conv"], r["parent_turn"], r["depth"], r["thread_conv"], r["position"]) for k, r in by.items()}
    assert links[1, 1] == (1, 0, 1, 1, 2) and links[1, 2] == (1, 1, 2, 1, 3)
    assert links[2, 0] == (1, 1, 2, 1, 4) and links[2, 1] == (2, 0, 3, 1, 5)
    assert links[4, 1] == (4, 0, 1, 4, 2) and by[4, 1]["own_text"] == "yes"
    assert links[3, 1][:4] == (None, None, 0, 3) and links[None, 1][:3] == (None, None, 0)
    assert by[1, 1]["own_text"] == "I agree with this statement fully." and by[1, 0]["own_text"] == first
    assert by[3, 0]["own_text"] is None and by[3, None]["own_text"] == "" and by[2, 1]["own_text"] == ""
    assert quotes.link_quotations(df.limit(0)).collect() == []


def test_packing(odd, none):
    got = packing.pack_documents(odd, tokenizer_path()).collect()
    assert sum(r["length"] == 1 for r in got if r["doc_id"] in (1, 2, 3)) == 3
    assert sum(r["doc_id"] == 7 for r in got) == 2
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, tokenizer_path()).collect() == []


def test_tokens_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b C", "It's DON'T we'll 'S", "x...y!! z).", "İstanbul ΣΑΣ ﬁ ½ 1,234.5 naïve ét́e", "", "  ", "''s.,;",
             "a.'s b,'t 12.", "<|ENDOFTEXT|>", "Å K ℌ ǅ", "\x1c a\x1db \x85c", "á ́b .́ e.", "中文 字。 word"]
    direct, encoder = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    for group in (texts, *[[t] for t in texts]):
        ids = list(encoder.encode(pa.array(group, pa.large_string())))
        for i, text in enumerate(group):
            assert ids[i].tolist() == direct.encode(text, add_special_tokens=False).ids


def test_tokens_with_few_kept_words(monkeypatch):
    """Words forgotten, kept and learned anew have the ids of whole texts, in small blocks too."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_KEPT_WORDS", 60)
    monkeypatch.setattr(packing, "_BLOCK_WORDS", 7)
    direct, encoder, draw = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path()), random.Random(3)
    for _ in range(60):
        texts = [" ".join(f"the, a{draw.choice('bcd')} word{draw.randrange(400)}." for _ in range(draw.randrange(12))) for _ in range(5)]
        for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.large_string())), strict=True):
            assert ids.tolist() == direct.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 60 + 180


def test_slices_are_bounded():
    import pyarrow as pa
    from foldwright.llm.words import text_slices

    texts = pa.array([None, "", "a" * 9, "b" * 40, "c", "d", None, "e"])
    assert list(text_slices(texts, 3, 10)) == [(0, 3), (3, 1), (4, 3), (7, 1)]
    assert list(text_slices(texts.slice(2, 3), 9, 10)) == [(0, 1), (1, 1), (2, 1)]
    assert list(text_slices(pa.array([], pa.string()), 3, 10)) == []


def test_groups_merge(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    draw = random.Random(2)
    rows = [(i, " ".join("a" for _ in range(draw.randrange(1, 60))), "s") for i in range(300)]
    got = packing.pack_documents(documents(spark, rows), tokenizer_path(), capacity=64).toPandas()
    assert sorted(got.doc_id) == list(range(300))
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 64


def test_short_passages_link_inside_their_conversation(spark):
    rows = [(1, 0, "u", "Which one?"), (1, 1, "v", "> Which one?\nThe second."), (2, 0, "u", "> Which one?\nNot said here.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in quotes.link_quotations(df).collect()}
    assert links == {(1, 0): (None, None), (1, 1): (1, 0), (2, 0): (None, None)}


def test_quality_sample_is_bounded_by_ids(spark):
    rows = [(i % 4, f"text {'good' if i % 2 else 'poor'} {i}", "s") for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    once = documents(spark, [(i, min(t for j, t, _ in rows if j == i), "s") for i in range(4)])
    assert np.array_equal(quality.fit_quality(docs, labels).odds(), quality.fit_quality(once, labels).odds())


def test_quality(spark, odd, none):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("aeioulnrst") for _ in range(draw.randrange(2, 8)))
    good = [(i, " ".join(word() for _ in range(60)), "s") for i in range(100)]
    bad = [(100 + i, " ".join(word() + "$$$" for _ in range(60)), "s") for i in range(100)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(0, 200, 2)] + [(None, 1), (1, None), (3, 0), (3, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert all((scores[i] >= 0.3) == (i < 100) for i in range(200))
    again = quality.fit_quality(docs, labels)
    assert np.array_equal(model.odds(), again.odds())
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["doc_id"]: r["score"] for r in rows}
    assert empty[1] == empty[2] == empty[3]
    assert quality.score_quality(none, model).collect() == []
    unfitted = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(odd, unfitted).collect()} == {0.5}
    # Whole texts count, and many at once score as each alone.
    features = quality.Features
    import pyarrow as pa

    texts = [t for _, t, _ in good[:3]] + ["", "one", "one one one"]
    together = features(pa.array(texts, pa.large_string()), model.shape)
    odds = model.odds()
    for i, value in enumerate(together.means(odds)):
        own_rows, counts = together.of(i)
        assert abs(value - (odds[own_rows] @ counts) / max(counts.sum(), 1)) < 1e-9


def test_mixing(odd, none):
    got = mixing.mix_to_targets(odd).collect()
    assert sum(r["twins"] for r in got) == len(ODD)
    for r in got:
        assert 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["copies"] == 0)
        assert r["source_size"] > 0 and r["target"] <= 3 * r["source_size"]
    assert {r["source"] for r in got} == {None, "a", "b"}
    assert mixing.mix_to_targets(none).collect() == []
    taken = mixing.mixed_documents(odd)
    assert taken.columns == odd.columns
    words = {}
    for r in taken.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    for r in got:
        assert abs(words.get(r["source"], 0) - r["target"]) <= 20_002


def test_mix_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    draw = random.Random(5)
    rows = [(i, "w " * draw.randrange(1, 50), draw.choice("aab")) for i in range(400)]
    got = mixing.mix_to_targets(documents(spark, rows)).toPandas()
    assert len(got) == 400
    for _, own in got.groupby("source"):
        assert abs((own.copies * own["size"]).sum() - own.target.iloc[0]) <= 50


def test_mix_of_twins(spark):
    """Rows without ids, alike in source and size: single rows are taken, so targets are met within one."""
    rows = [(None, f"w{i} " + "w " * 9, "a") for i in range(500)] + [(None, "v " * 10, "b") for _ in range(1_500)]
    rows += [(7, "x y z", "a"), (7, "x y", "a"), (8, None, "c"), (None, "", "b")]
    docs = documents(spark, rows).withColumn("_row", F.lit(1)).withColumn("twins", F.lit("t"))
    got = mixing.mix_to_targets(docs).toPandas()
    assert got.twins.sum() == len(rows) and got.copies.max() <= 3 and (got[got["size"] == 0].copies == 0).all()
    for (_, _, size), unit in got.groupby(["doc_id", "source", "size"], dropna=False):
        assert unit.copies.max() - unit.copies.min() <= 1
    for source, own in got.groupby("source"):
        assert abs((own.copies * own["size"] * own.twins).sum() - own.target.iloc[0]) <= 10
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    words, often = {}, {}
    for r in taken.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
        often[r["text"]] = often.get(r["text"], 0) + 1
    assert words == {s: w for s, w in (got.copies * got["size"] * got.twins).groupby(got.source).sum().items() if w}
    assert max(n for t, n in often.items() if t.startswith("w")) <= 3
    again = sorted(r["text"] for r in mixing.mixed_documents(docs).collect())
    assert again == sorted(t for t, n in often.items() for _ in range(n))


def test_lines(spark, odd, none):
    base = "This is a line of some length, really."
    rows = [(5, base + "\nshort\nshort", "s"), (2, "x\n" + base.replace("some", "sme") + "\ny", "s"), (9, base[:-1] + "!!", "s"),
            (None, base, "s"), (3, None, "s"), (4, "", "s"), (5, base + "\nshort\nshort", "s"), (6, LONG, "s"), (7, LONG + "!", "s")]
    got = lines.dedup_lines(documents(spark, rows))
    held = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["n_chars"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert (5, "short\nshort", 3, 1, 11) in held and (9, "", 1, 1, 0) in held and (None, base, 1, 0, len(base)) in held
    assert (3, None, 0, 0, None) in held and (4, "", 1, 0, 0) in held and (7, "", 1, 1, 0) in held
    left = lines.dedup_lines(documents(spark, rows), drop_emptied=True).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 2, 3, 4, 5, 5, 6]
    assert lines.dedup_lines(none).collect() == []
    assert len(lines.dedup_lines(odd).collect()) == len(ODD)


def test_line_texts_are_read_once_without_a_shuffle_of_documents(spark, monkeypatch):
    """Every round read the documents again, and shuffled them where many were wanted."""
    random.seed(3)
    base = ["".join(random.choices("abcdefghij ", k=40)) for _ in range(40)]
    # Chains of one edit a step take several rounds.
    rows = [(i, "\n".join(b[:j] + "#" * (i % 5) + b[j + i % 5 :] for j, b in enumerate(base, 2)), "a") for i in range(30)]
    plans, keep = [], lines.stored

    def stored(df, name="table", **more):
        if name == "texts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, **more)

    monkeypatch.setattr(lines, "stored", stored)
    monkeypatch.setattr(lines, "_BROADCAST_IDS", 0, raising=False)
    docs = documents(spark, rows)
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert texts[0].split("\n") == base and set(texts.values()) == {texts[0], ""}
    assert len(plans) == 1
    below = plans[0][plans[0].index("MapInArrow") :].split("Scan")[0]
    assert "Exchange" not in below
    # A table of few bits lets lines pass that were not wanted; results are the same.
    monkeypatch.setattr(lines, "_LEAST_BITS", 1 << 15, raising=False)
    monkeypatch.setattr(lines, "_MOST_BITS", 1 << 15, raising=False)
    many = [(i, "\n".join(f"{n:05d} line that is like {n % 7} others of {i % 3}" for n in range(i, i + 9)), "a") for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, many)).collect()}
    monkeypatch.undo()
    assert got == {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, many)).collect()}


def test_a_worker_drops_the_tokenizer_when_other_work_begins(monkeypatch):
    """It stayed for good, and took memory from every later stage."""

    class Frame:
        def __getattr__(self, name):
            return lambda f, *_: f if name == "mapInArrow" else self

    monkeypatch.setattr(packing, "F", MagicMock())
    monkeypatch.setattr(lines, "F", MagicMock())
    made = []

    class Counted(packing.WordTokenizer):
        def __init__(self, path):
            super().__init__(path)
            made.append(weakref.ref(self))

    monkeypatch.setattr(packing, "WordTokenizer", Counted)
    texts = pa.array(["one line of some length here", None])
    one = pa.RecordBatch.from_arrays([pa.array([1, 2])] * 2 + [texts], ["doc_id", "row", "text"])
    cut = packing.token_pieces(Frame(), tokenizer_path())
    found = [pa.Table.from_batches(cut(iter([one]))).to_pydict() for _ in range(2)]
    assert found[0] == found[1] and len(made) == 1 and made[0]() is not None
    list(lines.line_table(Frame(), 2, 20)(iter([one.select([0, 2])])))
    gc.collect()
    assert made[0]() is None


def test_short_lines(spark):
    rows = [(5, "short\n\nshort\n  \nshorter", "s"), (2, "Of.\nshort\n\n  ", "s"), (7, "Of.", "s"), (None, "Of.", "s")]
    got = lines.dedup_lines(documents(spark, rows), short_repeats=True)
    held = {(r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()}
    assert held == {(5, "\n  \nshorter", 2), (2, "Of.\nshort\n\n  ", 0), (7, "", 1), (None, "Of.", 0)}


def test_edits_against_plain_table():
    draw = random.Random(1)
    for _ in range(5000):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(0, 15)))
        b = list(a)
        for _ in range(draw.randrange(0, 5)):
            at = draw.randrange(0, len(b) + 1)
            b[at : at + draw.randrange(0, 2)] = draw.choice(["", "a", "b"])
        b = "".join(b)
        for edits in (1, 2, 3):
            near = lines._plain_distance(a, b) <= edits
            assert lines.within_edits(a, b, edits) == near
            if near and min(len(a), len(b)) > edits:
                s, l = sorted((a, b), key=len)
                cut = lambda x, e: {(len(x), i, x[p : p + n]) for i, (p, n) in enumerate(lines.segments(len(x), e))}
                probed = {(m, i, l[p : p + n]) for m, i, p, n in lines.probes(len(l), edits)}
                assert cut(s, edits) & (probed | cut(l, edits))
            if near:
                sizes = np.array([len(a), len(b)])
                assert lines._NearCounts(edits)([lines.counted(a), lines.counted(b)], sizes, 0, np.array([1])).all()


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_classes_need_no_common_centre(spark, monkeypatch, block_rows):
    from foldwright.llm import linking

    monkeypatch.setattr(linking, "BLOCK_ROWS", block_rows)
    draw = random.Random(8)
    buckets = [(k, n) for k in range(8) for n in draw.sample(range(60), 20)]
    true = {(a, b) for a in range(60) for b in range(a + 1, 60) if draw.random() < 0.02}
    links = spark.createDataFrame(sorted(true), "a long, b long")
    members = spark.createDataFrame([(k, n, n % 2 == 0) for k, n in buckets], "key long, node long, is_index boolean")
    sketches = lambda nodes: nodes.select("node", F.lit(1).cast("long").alias("size"), F.lit(b"").alias("sketch"))
    # A bound that passes most pairs, so that many are refused and rounds go on.
    bound = lambda held, sizes, n, others: (others * 7 + n) % 5 > -1
    verify = lambda pairs: pairs.join(links, ["a", "b"])
    got = {r["node"]: r["component"] for r in linking.link_classes(members, verify, sketches, bound).collect()}
    least = {n: n for _, n in buckets}
    together = {}
    for k, n in buckets:
        together.setdefault(k, set()).add(n)
    usable = [(a, b) for a, b in true if (a % 2 == 0 or b % 2 == 0) and any({a, b} <= t for t in together.values())]
    for _ in range(60):
        for a, b in usable:
            least[a] = least[b] = min(least[a], least[b])
    assert {n: got.get(n, n) for n in least} == least


def test_words_that_differ_in_closing_signs_are_encoded_once():
    """Words are looked up in Arrow; before, each of `leen***`, `leen&&&` and `leen$` was encoded anew and held as a Python object."""
    from tokenizers import Tokenizer

    texts = ["leen leen. leen*** leen&&& leen$ leen%,", "½* *½ é* *** a|** a>* don't*** x'* ℌ# <|endoftext|>* É& 中&", ""]
    direct, encoder = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.large_string())), strict=True):
        assert ids.tolist() == direct.encode(text, add_special_tokens=False).ids
    assert isinstance(encoder.known, pa.Array)
    units = encoder.units.to_pylist()
    assert len(units) == len(set(units)) and [u for u in units if u.startswith("leen")] == ["leen"]


def _classes(links):
    least = {n: n for link in links for n in link if link[0] != link[1]}
    while True:
        found = {n: min([least[n], *(least[a + b - n] for a, b in links if a != b and n in (a, b))]) for n in least}
        if found == least:
            return least
        least = found


@pytest.mark.parametrize("held", [7, 1000])
def test_components_in_tasks_and_in_rounds(spark, monkeypatch, held):
    """Links that one task holds are joined there, without rounds of shuffles; more go on in rounds."""
    from foldwright.llm import linking

    draw, tables, true = random.Random(8), [], linking.stored
    links = [(draw.randrange(-60, 60), draw.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3)]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    monkeypatch.setattr(linking, "_HELD_LINKS", held)
    monkeypatch.setattr(linking, "stored", lambda *a, **k: tables.append(a[1]) or true(*a, **k))
    got = linking.components(frame).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == _classes(links)
    assert (len(tables) == 2) == (held == 1000)
    assert linking.components(frame.where("a > 1000")).collect() == []
