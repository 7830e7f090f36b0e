"""Hard negatives, spelling variants and the n-gram join against plain versions, with nulls, ties, long texts and odd columns."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import jaccard, negatives, spelling

from . import brute

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id string, cell int, side int, grp string, part int, windows int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, "a", 1, 2, "g", 3, 4, 5) for i, v, x in rows], VECTORS)


def negatives_of(df, is_anchor="id % 4 = 0"):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, is_anchor).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def floors(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


@given(st.integers(1, 90), st.integers(1, 90), st.integers(0, 90), st.integers(0, 1000))
@settings(max_examples=40, deadline=None)
def test_strassen_is_exact(m, n, k, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << 30), 1 << 30, (m, k)), rng.integers(-(1 << 20), 1 << 20, (n, k))
    with np.errstate(over="ignore"):
        assert (negatives.strassen(a, b) == a @ b.T).all()


def test_strassen_recurses(monkeypatch):
    """Seven products of halves: no product of the whole is made."""
    monkeypatch.setattr(negatives, "PLAIN", 4)
    shapes = []
    kept = negatives.strassen

    def watched(a, b):
        shapes.append(a.shape)
        return kept(a, b)

    monkeypatch.setattr(negatives, "strassen", watched)
    a = np.arange(64 * 64).reshape(64, 64)
    assert (watched(a, a + 1) == a @ (a + 1).T).all()
    assert [shapes.count((64 >> k, 64 >> k)) for k in range(5)] == [7**k for k in range(5)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    """Ties, a label of half the rows, negative scores, several groups and cells, tiles smaller than a batch."""
    monkeypatch.setattr(negatives, "GROUP_BYTES", 8 * 6 * 5)
    monkeypatch.setattr(negatives, "CELL_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(160)]
    assert negatives_of(vectors(spark, rows)) == brute.hard_negatives([(i, x, floors(v)) for i, v, x in rows], lambda i: i % 4 == 0)


def test_negatives_of_odd_rows(spark):
    """Unusable rows take no part, repeated ids count once, shorter vectors go on in zeros."""
    good = [(i, [0.1 * (i % 7), 0.3, -0.2 * (i % 3)], i % 3) for i in range(24)] + [(40, [0.5], 0), (44, [], 1), (48, [0.5, 0.2, 0.1, 9.0], 2)]
    bad = [(60, None, 1), (61, [0.1, None], 1), (62, [float("nan"), 1.0], 0), (63, [float("inf")], 0), (64, [0.2], None), (None, [0.3], 1), (65, [1e30], 0)]
    want = brute.hard_negatives([(i, x, floors(v)) for i, v, x in good], lambda i: i % 4 == 0)
    assert negatives_of(vectors(spark, good + bad + good[:5])) == want and want
    assert negatives_of(vectors(spark, [])) == []
    assert negatives_of(vectors(spark, [(0, [1.0], 1)])) == []


def test_negatives_without_a_partner(spark):
    """One label only: positives, but no negatives. Each label once: no positives."""
    assert negatives_of(vectors(spark, [(i, [1.0, 0.5], 1) for i in range(8)])) == []
    assert negatives_of(vectors(spark, [(i, [1.0, 0.5], i) for i in range(8)])) == []


def variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()) or [], "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df).collect()}


def test_variants_equal_brute_force(spark, monkeypatch):
    """Short alphabets, so many words are near; repeated letters; borders in the midst of shared beginnings."""
    monkeypatch.setattr(spelling, "SAMPLED", 2)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"", "a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 149, "×÷ÿ", "×ÿ"}
    counts = {w: rng.choice([2, 3, 20, 30, 200, 2000]) for w in words}
    assert variants(spark, counts) == brute.spelling(counts)


def test_chains_of_forms_are_followed(spark):
    counts = {"abcdefg" + "x" * k: 10**k for k in range(10)}
    got = variants(spark, counts)
    assert got == brute.spelling(counts) and got["abcdefg"][1] == "abcdefg" + "x" * 9


def test_variants_of_nothing(spark):
    assert variants(spark, {}) == {}
    assert variants(spark, {"alone": 2}) == {"alone": (None, "alone", 2, 0, None)}


def test_counted_words(spark):
    rng = random.Random(6)
    some = ["Übermaß", "straßenÜ", "INFORMATION", "information", "naïveté", "x" * 5000, "short", "word's", "日本語", "école", "×××××××"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(40))) for i in range(60)] + [(None, "INFORMATION information"), (1, None), (2, ""), (3, "Übermaß" * 3)]
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in docs], "doc_id long, text string, id string, n int, h int")
    assert {r["word"]: r["n"] for r in spelling.counted_words(df).collect()} == brute.counted_words(docs)


def components(df, **how):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **how).collect())


def wanted(docs, k, percent):
    return sorted((str(i), n, root) for i, (n, root) in brute.near_components(docs, k, percent).items())


def texts(rng, n, size=60):
    """Texts of several originals with more and more words exchanged, so many pairs are close to the threshold."""
    base = [[rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(5, size))] for _ in range(6)]
    out = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = rng.choice(["neu", "alt", "rot"]) * rng.randint(1, 3)
        out.append(" ".join(own[rng.choice([0, 0, 1]) :]))
    return out


@pytest.mark.parametrize("shingle,percent", [(4, 85), (2, 80), (1, 60)])
def test_join_equals_brute_force(spark, shingle, percent):
    docs = list(enumerate(texts(random.Random(shingle), 150)))
    df = spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in docs], "doc_id long, text string, id string, node int, digest string, n int")
    assert components(df, shingle=shingle, percent=percent) == wanted(docs, shingle, percent)


def test_join_in_small_blocks(spark, monkeypatch):
    """One large component and many that it doesn't reach share buckets; blocks are far smaller than these."""
    from tallyspark.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "TRIED", 1)
    docs = list(enumerate(texts(random.Random(9), 200, 30)))
    assert components(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, percent=75) == wanted(docs, 2, 75)


def test_join_of_odd_rows(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 30) for _ in range(30000))
    docs = [(1, long), (2, long + " more"), (3, None), (4, ""), (5, " \n\t"), (6, "Two Words"), (7, "two\twords"), (8, "two words more"), (9, "x" * 100000), (9, "x" * 100000), (10, "É é"), (11, "é É")]
    got = components(spark.createDataFrame([*docs, (None, "two words")], "doc_id long, text string"), shingle=4, percent=85)
    expected = wanted(docs, 4, 85) + [(str(9), 1, 9), ("None", 1, None)]
    assert got == sorted(expected, key=str) or sorted(got, key=str) == sorted(expected, key=str)
    assert components(spark.createDataFrame([], "doc_id long, text string")) == []


def test_tree_finds_what_sets_share():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(60, rng.integers(1, 30)).astype(np.uint64)) for _ in range(80)]
    sets = list({s.tobytes(): s for s in sets}.values())
    tree = jaccard.PrefixTree(sets)
    for percent in (30, 60, 85):
        for s in sets:
            want = {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))}
            assert set(tree.search(s, np.arange(len(sets)), percent)) == want


def test_tree_leaves_subtrees(monkeypatch):
    """A subtree whose sets cannot reach the overlap is not gone through."""
    sets = [np.arange(100, dtype=np.uint64)] + [np.concatenate([[k + 1000], np.arange(2000, 2000 + 50)]).astype(np.uint64) for k in range(50)]
    tree = jaccard.PrefixTree(sets)
    looked = []
    kept = np.searchsorted
    monkeypatch.setattr(jaccard.np, "searchsorted", lambda *a, **b: looked.append(1) or kept(*a, **b))
    assert list(tree.search(sets[0], np.arange(len(sets)), 85)) == [0] and len(looked) < 2 * len(sets) + 10


def test_rarity_counts_all_documents(spark):
    docs = spark.createDataFrame([(k, "common common line " + "w" * (k + 1)) for k in range(300)], "doc_id long, text string")
    classes = jaccard.rarity(docs.repartition(5), "text", 2)
    assert classes.max() == round(2 * np.log2(300)) and (classes > 0).sum() == 2


def test_new_columns_are_of_the_stated_types(spark):
    got = negatives.op11_hard_negatives(spark, SF)
    assert [t for _, t in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert got.filter(F.col("anchor_id") % 100 != 0).isEmpty()
