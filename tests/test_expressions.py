import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.scalars import DRAWN, REGISTRY, Operator, register
from quillspark.operators.expressions import Call, Leaf, decode, encode
from quillspark.operators.generation import TreeSource, column_prior, depth_weights, normalised

NAMES = ["x0", "x1", "x2", "x3"]


def full_trees(depth):
    if depth == 0:
        return st.builds(Leaf, st.integers(0, 3))
    below = full_trees(depth - 1)
    unary = st.builds(lambda o, a: Call(o, (a,)), st.sampled_from(["abs", "square"]), below)
    return st.one_of(unary, st.builds(lambda o, a, b: Call(o, (a, b)), st.sampled_from(["add", "subtract", "multiply"]), below, below))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(full_trees))
def test_flat_form_round_trip(tree):
    assert decode(encode(tree)) == tree


def test_replay_gives_the_same_values(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in rng.normal(size=(50, 4))], "x0 double, x1 double, x2 double, x3 double")
    trees = TreeSource(3, 4).draw(40)
    inputs = [F.col(c) for c in NAMES]
    got = df.select(*[(t.column(inputs) - decode(encode(t)).column(inputs)).alias(f"d{i}") for i, t in enumerate(trees)]).toPandas()
    assert (got == 0).all().all()


def test_depth_and_operator_weights():
    assert depth_weights() == pytest.approx([4 / 7, 2 / 7, 1 / 7])
    source = TreeSource(1, 3)
    depths = [t.depth for t in source.draw(4000)]
    assert [depths.count(d) / 4000 for d in (1, 2, 3)] == pytest.approx([4 / 7, 2 / 7, 1 / 7], abs=0.03)
    source.learn([encode(Call("abs", (Leaf(0),)))] * 5)
    assert source.operator_weights.sum() == pytest.approx(1) and source.operator_weights.min() > 0
    assert source.uses["abs"] == 6


def test_column_prior_modes():
    assert column_prior([2, 2], [3, 1], None) == pytest.approx([0.5, 0.5])
    assert column_prior([2, 2], [3, 1], "comb") == pytest.approx([0.75, 0.25])
    assert column_prior([9, 1], [3, 1], "splits") == pytest.approx([0.75, 0.25])
    assert column_prior([9, 1], [3, 1], "anything") == pytest.approx([0.9, 0.1])
    assert normalised([0, float("nan")]) == pytest.approx([0.5, 0.5])


def test_malformed_flat_form():
    from quillspark.operators.expressions import Program

    with pytest.raises((ValueError, StopIteration)):
        decode(Program(1, (("add", 0),), (1, 2, 3)))


def test_own_operator(spark):
    half = Operator("half", 1, lambda a: a / 2)
    register(half)
    trees = TreeSource(0, 1, [half]).draw(3)
    assert all("half" in t.name(["x"]) for t in trees)
    with pytest.raises(ValueError):
        register(Operator("odd", 3, lambda a: a))
    with pytest.raises(ValueError):
        TreeSource(0, 1, [Operator("unknown", 1, lambda a: a)])
    REGISTRY.pop("half")
    assert [o.name for o in DRAWN] == ["multiply", "add", "subtract", "abs", "square"]


EDGE = [0.0, -0.0, 2.0, -2.0, float("nan"), float("inf"), 3.5e38, -3.5e38, None]
WANTED = {
    "reciprocal": [math.inf, -math.inf, 0.5, -0.5, math.nan, 0.0, 1 / 3.5e38, -1 / 3.5e38, None],
    "signed_log": [math.nan, math.nan, math.log(2), -math.log(2), math.nan, math.inf, math.log(3.5e38), -math.log(3.5e38), None],
    "signed_sqrt": [0.0, 0.0, math.sqrt(2), -math.sqrt(2), math.nan, math.inf, math.sqrt(3.5e38), -math.sqrt(3.5e38), None],
    "cube": [0.0, 0.0, 8.0, -8.0, math.nan, math.inf, 3.5e38**3, -(3.5e38**3), None],
    "clamp_float32": [0.0, 0.0, 2.0, -2.0, math.nan, 3.4028234663852886e38, 3.4028234663852886e38, -3.4028234663852886e38, None],
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_edge_values(spark, name):
    df = spark.createDataFrame(list(enumerate(EDGE)), "i int, x double")
    got = {r[0]: r[1] for r in df.select("i", REGISTRY[name].build(F.col("x")).cast("double")).collect()}
    for i, w in enumerate(WANTED[name]):
        g = got[i]
        assert g is None if w is None else math.isnan(g) if math.isnan(w) else g == pytest.approx(w), (EDGE[i], g, w)
