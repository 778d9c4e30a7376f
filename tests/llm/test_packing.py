import json
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm.packing import Stream, byte_bpe, cheapest_cuts, pack, powers
from quillspark.llm.queries import BYTE_BPE

from .fixtures import SCHEMA, documents, prose


def cost(places, penalty, cuts, length):
    return sum(length - (places[b] - places[a]) + penalty[b] for a, b in zip(cuts, cuts[1:]))


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 11)
        places = sorted(rng.sample(range(1, 4 * n), n - 1))
        places = [0, *places]
        penalty = [rng.choice([0, 1, 5]) for _ in places]
        length = max(b - a for a, b in zip(places, places[1:])) + rng.randint(0, 6)
        found = cheapest_cuts(places, penalty, length)
        best = min(
            cost(places, penalty, c, length)
            for k in range(n)
            for inner in combinations(range(1, n - 1), k)
            for c in [[0, *inner, n - 1]]
            if all(places[b] - places[a] <= length for a, b in zip(c, c[1:]))
        )
        assert found[0] == 0 and found[-1] == n - 1
        assert cost(places, penalty, found, length) == best


@pytest.mark.parametrize("length,stretch", [(2048, 256), (64, 8)])
def test_pieces_hold_every_id_once(spark, length, stretch):
    rng = random.Random(2)
    rows = documents(3) + [(10_000 + i, prose(rng, 400), "en", "src0", 1) for i in range(20)] + [(None, "no id here", "en", "src1", 1), (20_000, "the mark <|endoftext|> in a text<|endoftext|>", "en", "s", 1), (5, "again", "en", "s", 1), (5, "again", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "length").repartition(3, "doc_id")
    found = pack(df, BYTE_BPE, length=length, stretch=stretch).toPandas()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    total = 0
    for doc, group in found.groupby("doc_id", dropna=False):
        wanted = ids[None if np.isnan(doc) else int(doc)]
        total += group.length.sum()
        assert group.length.sum() == sum(map(len, wanted))
        for p in group.itertuples():
            assert p.doc_tokens == len(wanted[0])
            assert p.ids_crc32 == zlib.crc32(wanted[0][p.start : p.start + p.length].tobytes())
        if len(wanted) == 1:
            ordered = group.sort_values("start")
            assert (ordered.start == ordered.length.cumsum() - ordered.length).all()
    assert total == sum(len(x) for v in ids.values() for x in v)
    sequences = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (sequences.length.cumsum() - found.sort_values(["sequence_id", "offset"]).length == found.sort_values(["sequence_id", "offset"]).offset).all()
    assert sequences.length.sum().max() <= length


def test_added_tokens_have_their_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one.  <|endoftext|><|endoftext|>\n\n  two <|endoftext|", "<|ENDOFTEXT|> x<|endoftext|>x 's", "no such token", ""]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    found = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE_BPE).collect()
    pieces = {i: sorted((p.start, p.length, p.ids_crc32) for p in found if p.doc_id == i) for i in range(len(texts))}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert {p.doc_tokens for p in found if p.doc_id == i} == {len(ids)}
        assert pieces[i] == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n, _ in pieces[i]]
    assert 50256 in tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_stretches_cost_hardly_more_than_the_whole():
    """One dynamic program over a whole partition, by trying every transition, against stretches with carried windows."""
    rng = np.random.default_rng(3)
    ends = np.zeros(1000, bool)
    ends[:40] = True
    docs = [rng.integers(0, 1000, rng.integers(1, 700)).astype(np.uint32) for _ in range(150)]
    length, sentence, inside, grid = 128, 4, 16, 8

    def cuts_of(stretch):
        stream = Stream(ends, 1, length, sentence, inside, grid, stretch, 0)
        pieces = [p for i, d in enumerate(docs) for p in stream.add(i, d)] + list(stream.pieces(final=True))
        sizes = np.zeros(pieces[-1][5] + 1, int)
        for p in pieces:
            sizes[p[5]] += p[2]
        return np.r_[0, np.cumsum(sizes)]

    whole = Stream(ends, 1, length, sentence, inside, grid, 10**9, 0)
    stream = np.concatenate([np.append(d, 1) for d in docs]).astype(np.uint32)
    starts = np.r_[0, np.cumsum([len(d) + 1 for d in docs])][:-1]
    places, penalty = (x.tolist() for x in whole.places(starts, stream))
    at = {p: k for k, p in enumerate(places)}
    best, first = [0] * len(places), 0
    for i in range(1, len(places)):
        while places[i] - places[first] > length:
            first += 1
        best[i] = penalty[i] + min(best[j] + length - (places[i] - places[j]) for j in range(first, i))

    def cost(cuts):
        # what ends in powers of two, without padding, is left out on both sides
        inner = [c for c in cuts.tolist() if c in at and c <= places[-1] - length]
        return sum(length - (b - a) + penalty[at[b]] for a, b in zip(inner, inner[1:])), inner[-1]

    for stretch, more in ((10**9, 1.0), (64, 1.02), (12, 1.1)):
        found, upto = cost(cuts_of(stretch))
        assert best[at[upto]] <= found <= more * best[at[upto]] + length


def test_files_of_other_tokenizers_are_refused():
    file = json.loads(open(BYTE_BPE, "rb").read())
    for more in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**file["model"], "ignore_merges": True}}):
        with pytest.raises(ValueError):
            byte_bpe(json.dumps({**file, **more}).encode())


def test_files_with_other_added_tokens_are_refused():
    file = json.loads(open(BYTE_BPE, "rb").read())
    token = file["added_tokens"][0]
    for more in ({**token, "lstrip": True}, {**token, "content": token["content"] + "2", "id": 50257}):
        with pytest.raises(ValueError):
            byte_bpe(json.dumps({**file, "added_tokens": [token, more]}).encode())


def test_little_padding_and_order(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, prose(rng, rng.randint(5, 900))) for i in range(200)], "doc_id long, text string").coalesce(1)
    found = pack(df, BYTE_BPE).toPandas()
    sums = found.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sums)
    assert padding < 0.01 * sums.sum()
    order = found.sort_values(["sequence_id", "offset"])
    assert order.doc_id.is_monotonic_increasing


def test_empty_table_and_powers(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE).collect() == []
    assert powers(1300) == [1024, 256, 16, 4]
