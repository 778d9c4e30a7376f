import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm.mixing import Weights, mix_documents, select_tokens
from quillspark.llm.queries import MIX, domain_of

from .fixtures import SCHEMA, documents


def fill(children, budget):
    """Shares by repeated passes: whoever can't use its part is filled, the rest is dealt anew."""
    share, open_ = {}, {k for k, (w, c) in children.items() if w > 0}
    share.update({k: 0.0 for k in children})
    while open_:
        rest = budget - sum(share[k] for k in children if k not in open_)
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= rest * children[k][0] / total}
        if not full:
            share.update({k: rest * children[k][0] / total for k in open_})
            break
        share.update({k: children[k][1] for k in full})
        open_ -= full
    return share


def domain(source):
    m = re.match(r"^src([0-9]{1,4})$", source or "")
    return "books" if not m else "web" if int(m[1]) < 10 else "news" if int(m[1]) < 15 else "books"


def brute(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for d, t, lang, source, *_ in rows:
        tokens = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        leaves[(domain(source), lang or "(none)", source or "(none)")].append((d, tokens))
    w = lambda level, name: getattr(weights, level).get(name, weights.default)
    size = {k: sum(t for _, t in v) for k, v in leaves.items()}
    room = {k: size[k] * epochs if min(w("domain", k[0]), w("lang", k[1]), w("source", k[2])) > 0 else 0.0 for k in leaves}
    top = fill({a: (w("domain", a), sum(v for k, v in room.items() if k[0] == a)) for a in {k[0] for k in leaves}}, int(sum(size.values()) * share))
    out = []
    for a, budget in top.items():
        langs = fill({b: (w("lang", b), sum(v for k, v in room.items() if k[:2] == (a, b))) for b in {k[1] for k in leaves if k[0] == a}}, budget)
        for b, part in langs.items():
            for c, given in fill({k[2]: (w("source", k[2]), room[k]) for k in leaves if k[:2] == (a, b)}, part).items():
                leaf = (a, b, c)
                left, epoch = int(round(given, 3)), 0
                while left > 0 and size[leaf]:
                    epoch += 1
                    place = lambda x, e=epoch: (hashlib.md5(f"{seed}:{e}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0], x[1])
                    for d, t in sorted(leaves[leaf], key=place):
                        if left <= 0:
                            break
                        out.append((d, *leaf, epoch, t, min(t, left)))
                        left -= t
    return sorted(out)


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (1.0, 3), (9.0, 2)])
def test_equals_repeated_dealing(spark, share, epochs):
    rows = documents(11)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "domain")  # a clashing name
    found = select_tokens(df, MIX, domain_of(F.col("source")), budget_share=share, max_epochs=epochs, seed=5).collect()
    wanted = brute(rows, MIX, share, epochs, 5)
    # a leaf filled exactly to the end of an epoch may or may not name documents without tokens there
    strip = lambda rs: sorted(tuple(r) for r in rs if r[5] > 0)
    assert strip(found) == strip(wanted)


def test_zero_weights_and_empty_table(spark):
    rows = documents(12)
    df = spark.createDataFrame(rows, SCHEMA)
    weights = Weights(domain={"web": 1.0}, default=0.0, lang={"en": 1.0}, source={"src0": 1.0})
    found = select_tokens(df, weights, domain_of(F.col("source")), budget_share=1.0).collect()
    assert found and {(r.domain, r.lang, r.source) for r in found} == {("web", "en", "src0")}
    assert select_tokens(df.limit(0), MIX, domain_of(F.col("source")), budget_share=1.0).collect() == []
    with pytest.raises(ValueError):
        select_tokens(df, MIX, domain_of(F.col("source")))


def test_whole_documents_and_epochs(spark):
    rows = [(i, "w " * 10, "en", "src0", 1) for i in range(10)] + [(50, "w " * 10, "en", "src12", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mix_documents(df, Weights(), domain_of(F.col("source")), budget=100, max_epochs=4)
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert counts[50] == 4 and sum(v for k, v in counts.items() if k != 50) == 6
    assert found.columns == df.columns


def test_columns_named_like_helpers_and_cut_texts(spark):
    schema = "doc_id long, text string, lang string, source string, `__id` string, `__times` int, `__copy` int, key string, row string, copies string, taken int"
    rows = [(i, f" one  two\tthree {i}", "en", "src0", "a", 1, 2, "k", "r", "c", 9) for i in range(10)] + [(None, None, None, None, *[None] * 7)]
    df = spark.createDataFrame(rows, schema)
    for epochs in (1, 3):
        whole = mix_documents(df, Weights(), domain_of(F.col("source")), budget=14, max_epochs=epochs)
        assert whole.columns == df.columns and {r.text for r in whole.collect()} <= {r[1] for r in rows}
        cut = mix_documents(df, Weights(), domain_of(F.col("source")), cut=True, budget=14, max_epochs=epochs).collect()
        assert sum(len((r.text or "").split()) for r in cut) == 14
        assert [r.text for r in cut if r.text is not None and len(r.text.split()) < 4] == [" one  two"]
    empty = mix_documents(df.limit(0), Weights(), domain_of(F.col("source")), budget=14)
    assert empty.columns == df.columns and empty.collect() == []


def test_a_leaf_with_a_third_of_all_rows_among_many_siblings(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 20), "en", "src0" if i % 3 == 0 else f"host{i % 700}", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = select_tokens(df, MIX, domain_of(F.col("source")), budget_share=0.6, max_epochs=2, seed=3).collect()
    strip = lambda rs: sorted(tuple(r) for r in rs if r[5] > 0)
    assert strip(found) == strip(brute(rows, MIX, 0.6, 2, 3))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(documents(1), SCHEMA)
    plan = select_tokens(df, MIX, domain_of(F.col("source")), budget_share=1.0)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_random_trees_fill_their_budget(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 9), rng.choice("abc"), rng.choice(["src1", "src2", "src11", "x"]), 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = Weights(domain={"web": 3, "news": 1}, lang={"a": 5}, source={"src1": 0.1})
    found = select_tokens(df, weights, domain_of(F.col("source")), budget=300, max_epochs=1).agg(F.sum("taken")).first()[0]
    assert 300 - 12 <= found <= 300  # leaves round down


def test_whole_rows_are_joined_in_a_short_plan(spark):
    df = spark.createDataFrame(documents(2), SCHEMA)
    mixed = mix_documents(df, MIX, domain_of(F.col("source")), budget_share=0.9, max_epochs=1, seed=17)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    chosen = select_tokens(df, MIX, domain_of(F.col("source")), budget_share=0.9, max_epochs=1, seed=17)
    ids = [r.doc_id for r in mixed.collect()]
    assert sorted(ids) == sorted(r.doc_id for r in chosen.collect())
