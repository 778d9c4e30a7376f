import random
import re

import numpy as np
import pytest

from quillspark.llm import components as cc
from quillspark.llm.minhash_dedup import drop_near_duplicates, near_duplicates, similar_pairs
from quillspark.llm.words import WordHashes, shingles

from .fixtures import SCHEMA, documents, prose, touched

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    sets = {d: shingle_set(t, width) for d, t in rows}
    group = {d: d for d in sets}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


@pytest.mark.parametrize("width,block", [(4, 256), (5, 8), (4, 3)])
def test_equals_all_pairs(spark, width, block):
    rows = documents(width + block)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "component_id")  # a clashing name
    found = {r[0]: tuple(r[1:]) for r in near_duplicates(df, width=width, block=block).collect()}
    assert found == brute([(r[0], r[1]) for r in rows], width)


def test_large_group_in_many_blocks(spark):
    rng = random.Random(5)
    base = prose(rng, 90)
    rows = [(i, touched(rng, base, rng.randint(0, 5))) for i in range(150)] + [(1000 + i, base) for i in range(40)]
    found = {r[0]: tuple(r[1:]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, block=16).collect()}
    assert found == brute(rows, 4)


def test_repeated_and_missing_ids_and_empty_table(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (1, None), (2, text), (None, text), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert found == [(1, 6, 1, True), (2, 6, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 6, None, True)]
    kept = drop_near_duplicates(df).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_dropping_keeps_columns_that_are_named_like_helpers(spark):
    schema = "doc_id long, text string, id string, row string, `__dropped` string, `__again` string, kept string"
    rows = [(1, "a b c d e f", "x", "y", "z", "u", "v"), (2, "a b c d e f", "x", "y", "z", "u", "w"), (3, "other", *"xyzuv"), (3, "other", *"xyzut"), (None, None, *[None] * 5)]
    df = spark.createDataFrame(rows, schema)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.kept or "") for r in kept.collect()) == [(0, ""), (1, "v"), (3, "t")]
    assert drop_near_duplicates(df.limit(0)).columns == df.columns and drop_near_duplicates(df.limit(0)).collect() == []


def boilerplate(n, common=60, own=90):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(30_000)}"
    passage = [word() for _ in range(common)]
    return [(i, " ".join([*passage, *(word() for _ in range(own))])) for i in range(n)]


def test_links_of_texts_that_share_a_passage(spark):
    rng = random.Random(12)
    rows = boilerplate(300)
    rows += [(1000 + i, touched(rng, rows[i][1], rng.choice([0, 1, 2, 3, 4, 8]))) for i in range(150)]
    rows += [(2000 + i, " ".join(rows[0][1].split()[:110] + [f"x{i}-{k}" for k in range(40)])) for i in range(60)]  # alike in most words, no near duplicates
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows, 5)
    for block in (256, 8):
        found = {r[0]: tuple(r[1:]) for r in near_duplicates(df, block=block).collect()}
        assert found == wanted


def test_a_shared_passage_makes_no_family(spark, monkeypatch):
    """What is dealt for verification must not grow with the square of the documents that share a passage."""
    held = []

    def counted(links, a, b, shelf):
        held.append(links.count())
        return cc.components(links, a, b, shelf)

    monkeypatch.setattr("quillspark.llm.minhash_dedup.components", counted)
    for n in (1000, 4000):
        rows = near_duplicates(spark.createDataFrame(boilerplate(n), "doc_id long, text string"), block=16)
        assert rows.where("kept").count() == n
    assert sum(held) < 40


def test_crowded_buckets_are_cut_and_lose_nothing(spark):
    """Documents at all distances from a leader, in buckets of more than a block."""
    rng = random.Random(13)
    base = prose(rng, 200).split()
    rows = []
    for i in range(120):
        cut = rng.randint(30, 200)
        other = base[:cut] + [f"y{i // 2}-{k}" for k in range(200 - cut)]
        rows.append((i, touched(rng, " ".join(other), rng.randint(0, 4))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4, 256):
        found = {r[0]: tuple(r[1:]) for r in near_duplicates(df, width=4, block=block).collect()}
        assert found == brute(rows, 4)


def test_word_rules():
    hashes = WordHashes()
    assert (hashes.of("A\x0bb c d É") == hashes.of("a b c d É")).all()
    assert hashes.of("É")[0] != hashes.of("é")[0]
    assert len(shingles(hashes.of("a b a b a b"), 2)) == 2
    assert len(shingles(hashes.of("a b"), 5)) == 1 and len(shingles(hashes.of(" \n"), 5)) == 0


def test_similar_pairs_by_index():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    side = rng.integers(0, 3, 60)
    i, j = similar_pairs(sets, side, 60)
    wanted = {(a, b) for a in range(60) for b in range(a + 1, 60) if side[a] != side[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == wanted


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000, 2000), (1150, 5), (None, 3)]
    shelf = cc.Shelf(spark, "test")
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    found = dict(tuple(r) for r in cc.components(df, "a", "b", shelf).collect())
    assert all(found[i] == 0 for i in [*range(301), *range(1000, 1200)])
    assert cc.components(df.limit(0), "a", "b", shelf).collect() == []
