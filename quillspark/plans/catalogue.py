"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import group_stats
from ..functions.scalars import REGISTRY
from ..operators import importance, metrics, models, sampling, scaling, selection
from ..operators import paths as tree_paths_
from ..operators.expressions import PROGRAM_SCHEMA, Call, Leaf, decode, encode, row
from ..operators.generation import TreeSource, column_prior, depth_weights, operator_counts
from ..operators.importance import Trees
from ..sources import synthetic
from ..sources.datasets import LINE, catalogue, dataset
from ..sources.readers import prepare, read_table
from ..sources.scratch import scratch_dir
from ..streaming.apply import run_available
from .benchmarking import compare
from .synthesizer import FeatureModel, FeatureSynthesizer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEYS = ["l_orderkey", "l_linenumber"]
SHORT = ["qty", "price", "disc", "tax"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def line(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


def scaled_line(spark: SparkSession, d: str) -> tuple[DataFrame, scaling.Scale]:
    df = line(spark, d)
    return df, scaling.fit_min_max(df, LINE)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Scaling, encoding, projection -------------------------------------------------------------------------

S = ", ".join(f"(l.{c} - s.lo_{k}) / nullif(s.hi_{k} - s.lo_{k}, 0) AS {k}" for c, k in zip(LINE, SHORT, strict=True))
LIMITS = ", ".join(f"min({c}) AS lo_{k}, max({c}) AS hi_{k}" for c, k in zip(LINE, SHORT, strict=True))
SCALED = f"WITH s AS (SELECT {LIMITS} FROM lineitem), x AS (SELECT l.*, {S} FROM lineitem l, s) "


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, min({c})::double AS low, max({c})::double AS high FROM lineitem" for c in LINE) + ")")
def minmax_stats(spark, d):
    return scaling.min_max_stats(line(spark, d), LINE)


@query(SCALED + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({k}, 6) AS {k}" for k in SHORT) + " FROM x")
def minmax_scale(spark, d):
    df, scale = scaled_line(spark, d)
    return df.select(*KEYS, *[r6(c).alias(k) for c, k in zip(scale.of(), SHORT, strict=True)])


@query(
    "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{k}, stddev_pop({c}) AS s_{k}" for c, k in zip(LINE, SHORT, strict=True)) + " FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - m_{k}) / s_{k}, 6) AS {k}" for c, k in zip(LINE, SHORT, strict=True)) + " FROM lineitem, s"
)
def standard_scale(spark, d):
    df = line(spark, d)
    return df.select(*KEYS, *[r6(c).alias(k) for c, k in zip(scaling.fit_standard(df, LINE).of(), SHORT, strict=True)])


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS int) AS event_type FROM events")
def label_encode(spark, d):
    return scaling.label_encode(read_table(spark, d, "events").select("event_id", "event_type"), ["event_type"])


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0::double ELSE value END AS value FROM events")
def fillna_zero(spark, d):
    holed = read_table(spark, d, "events").select("event_id", F.expr("case when event_id % 14 = 0 then null when event_id % 7 = 0 then double('nan') else value end").alias("value"))
    return scaling.fill_missing(holed, ["value"])


@query("SELECT c_name, c_mktsegment FROM customer")
def select_by_dtype(spark, d):
    return scaling.text_columns(read_table(spark, d, "customer"))


@query("SELECT p_partkey, p_size FROM part")
def select_numeric(spark, d):
    return scaling.number_columns(read_table(spark, d, "part"), "p_retailprice")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def drop_target(spark, d):
    return read_table(spark, d, "part").drop("p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part")
def project_target(spark, d):
    return read_table(spark, d, "part").select("p_partkey", "p_retailprice")


@query("SELECT event_id, CAST(event_type = 'click' AS int) AS y FROM events")
def binarize_target(spark, d):
    return read_table(spark, d, "events").select("event_id", scaling.is_class(F.col("event_type"), "click").alias("y"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 700")
def first_n_rows(spark, d):
    return sampling.first_rows(read_table(spark, d, "events").select("event_id", "value"), 700, F.desc("value"), "event_id")


# Samples, splits, folds ---------------------------------------------------------------------------------

BUCKET = "(('0x' || substr(md5(CAST(event_id AS varchar)), 1, 8))::bigint % {n})"


@query(f"SELECT event_id, CASE WHEN {BUCKET.format(n=5)} = 0 THEN 'test' ELSE 'train' END AS split FROM events")
def train_test_split(spark, d):
    return sampling.split(read_table(spark, d, "events").select("event_id"), sampling.row_hash(["event_id"]))


@query(f"SELECT event_id, CAST({BUCKET.format(n=3)} AS int) AS fold FROM events")
def cv_folds(spark, d):
    return sampling.folds(read_table(spark, d, "events").select("event_id"), sampling.row_hash(["event_id"]))


@query("SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS varchar)) LIMIT (SELECT count(*) // 3 FROM events)")
def sample_third(spark, d):
    rows = read_table(spark, d, "events").select("event_id", "value")
    return sampling.exact_sample(rows, rows.count() // 3, sampling.row_hash(["event_id"]))


#: Few different rows, many copies of each: (flag, status) of every line, numbered among equal ones.
COPIES_SQL = (
    "WITH c AS (SELECT l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey) - 1 AS copy FROM lineitem), "
    "h AS (SELECT *, md5(l_returnflag || chr(31) || l_linestatus || chr(31) || CAST(copy AS varchar)) AS hash FROM c), "
    "b AS (SELECT *, ('0x' || substr(hash, 1, 8))::bigint AS bits FROM h) "
)


def copies(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    rows = sampling.numbered(line(spark, d).select("l_returnflag", "l_linestatus"))
    return rows, sampling.row_hash(rows.columns)


@query(COPIES_SQL + "SELECT l_returnflag, l_linestatus, copy FROM h ORDER BY hash LIMIT (SELECT count(*) // 3 FROM h)")
def sample_third_of_copies(spark, d):
    """A third of a table of few different rows, each copy drawn on its own."""
    rows, hash_ = copies(spark, d)
    return sampling.exact_sample(rows, rows.count() // 3, hash_).withColumnRenamed("__copy", "copy")


@query(COPIES_SQL + "SELECT l_returnflag, l_linestatus, copy, CASE WHEN bits % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM b")
def split_of_copies(spark, d):
    rows, hash_ = copies(spark, d)
    return sampling.split(rows, hash_).withColumnRenamed("__copy", "copy")


@query(COPIES_SQL + "SELECT l_returnflag, l_linestatus, copy, CAST(bits % 3 AS int) AS fold FROM b")
def folds_of_copies(spark, d):
    rows, hash_ = copies(spark, d)
    return sampling.folds(rows, hash_).withColumnRenamed("__copy", "copy")


@query(
    "SELECT doc_id, n_chars, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS int) AS lang, CAST(dense_rank() OVER (ORDER BY source) - 1 AS int) AS source, quality AS label, "
    "CASE WHEN (('0x' || substr(md5(CAST(doc_id AS varchar)), 1, 8))::bigint % 5) = 0 THEN 'test' ELSE 'train' END AS split "
    "FROM documents JOIN labels USING (doc_id)"
)
def prep_dataset(spark, d):
    rows = read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "lang", "source", "quality")
    return prepare(rows, "quality", ["doc_id"])


# Scalars ------------------------------------------------------------------------------------------------

X, Y = "(p_size - 25)::double", "(p_retailprice / 100)"


def scalar_query(name: str, operator: str, sql: str, factor: str | None = None, unit: float = 1.0) -> None:
    """A value, or null with ``kind`` saying which infinity or NaN it is.  The input is multiplied by ``factor`` and the value divided by ``unit``."""
    text = (
        f"SELECT p_partkey, CASE WHEN isfinite(v) THEN round(v, 6) END AS v, CASE WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN CASE WHEN v > 0 THEN 'inf' ELSE '-inf' END ELSE 'finite' END AS kind "
        f"FROM (SELECT p_partkey, {sql} AS v FROM part)"
    )

    def run(spark: SparkSession, d: str) -> DataFrame:
        part = read_table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
        found = REGISTRY[operator]
        if factor is not None:
            part = part.withColumn("x", F.col("x") * F.expr(factor))
        part = part.withColumn("v", found.build(*[F.col(c) for c in ("x", "y")[: found.arity]]).cast("double"))
        infinite = F.col("v").isin(float("inf"), float("-inf"))
        kind = F.when(F.isnan("v"), "nan").when(F.col("v") == float("inf"), "inf").when(infinite, "-inf").otherwise("finite")
        return part.select("p_partkey", F.when(~F.isnan("v") & ~infinite, r6(F.col("v") / F.lit(unit))).alias("v"), kind.alias("kind"))

    QUERIES[name], ORACLES[name] = run, text


scalar_query("sc_multiply", "multiply", f"{X} * {Y}")
scalar_query("sc_add", "add", f"{X} + {Y}")
scalar_query("sc_subtract", "subtract", f"{X} - {Y}")
scalar_query("sc_abs", "abs", f"abs({X})")
scalar_query("sc_square", "square", f"{X} * {X}")
scalar_query("sc_identity", "identity", X)
scalar_query("sc_cube", "cube", f"{X} * {X} * {X}")
#: Minus zero for even keys.
SIGNED = "(CASE WHEN p_partkey % 2 = 0 THEN -1.0 ELSE 1.0 END)::double"
scalar_query("sc_multinv", "reciprocal", f"CASE WHEN {X} = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '-inf'::double ELSE 'inf'::double END ELSE 1 / ({X} * {SIGNED}) END", "cast(case when p_partkey % 2 = 0 then -1.0 else 1.0 end as double)")
scalar_query("sc_sqrtabs", "signed_sqrt", f"sqrt(abs({X})) * sign({X})")
scalar_query("sc_logabs", "signed_log", f"CASE WHEN {X} = 0 THEN 'nan'::double ELSE ln(abs({X})) * sign({X}) END")
#: Most values are beyond the largest float32 on either side.
scalar_query("sc_clamp_f32", "clamp_float32", f"greatest(least({X} * 1e38::double, 3.4028234663852886e38::double), -3.4028234663852886e38::double)::float::double / 1e38::double", "1e38D", 1e38)


# Group features -----------------------------------------------------------------------------------------


def holed_events(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events")
    return rows.select("event_id", F.expr("case when event_id % 40 <> 3 then user_id end").alias("k"), F.expr("case when event_id % 50 <> 0 then value end").alias("v"))


HOLED = "(SELECT event_id, CASE WHEN event_id % 40 <> 3 THEN user_id END AS k, CASE WHEN event_id % 50 <> 0 THEN value END AS v FROM events)"
WHOLE = "CASE WHEN count(v) = count(*) THEN {} END"
GROUPED = {
    "mean": "avg(v)",
    "std": "stddev_pop(v)",
    "max": "max(v)",
    "min": "min(v)",
    "sum": "coalesce(sum(v), 0.0)",
    "mode": None,
    "len": "count(*)",
    "range": "max(v) - min(v)",
    "median": WHOLE.format("median(v)"),
    "p25": WHOLE.format("quantile_cont(v, 0.25)"),
    "p75": WHOLE.format("quantile_cont(v, 0.75)"),
}


def grouped_sql(how: str) -> str:
    if how == "mode":
        inner = "SELECT k, v AS g FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS n FROM e WHERE v IS NOT NULL GROUP BY k, v) WHERE n = 1"
    else:
        inner = f"SELECT k, {GROUPED[how]} AS g FROM e GROUP BY k"
    return f"WITH e AS {HOLED}, g AS ({inner}) SELECT event_id, round(g::double, 6) AS feature FROM e LEFT JOIN g ON e.k = g.k"


def group_query(name: str, how: str, windowed: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        make = group_stats.group_feature_windowed if windowed else group_stats.group_feature
        return make(holed_events(spark, d), "k", "v", how, "g").select("event_id", r6(F.col("g").cast("double")).alias("feature"))

    QUERIES[name], ORACLES[name] = run, grouped_sql(how)


for how_ in GROUPED:
    group_query(f"groupby_{how_}", how_)


@query("WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, round(m, 6) AS mean_price, round(s, 6) AS std_quantity FROM lineitem JOIN g USING (l_returnflag, l_linestatus)")
def groupby_mean_join(spark, d):
    """Two features of few large groups, of a key of two columns, joined back to the lines."""
    rows = line(spark, d).withColumn("k", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    rows = group_stats.group_feature(rows, "k", "l_extendedprice", "mean", "m")
    return group_stats.group_feature(rows, "k", "l_quantity", "std", "s").select(*KEYS, r6("m").alias("mean_price"), r6("s").alias("std_quantity"))


group_query("groupby_mean_window", "mean", windowed=True)
group_query("groupby_median_window", "median", windowed=True)
#: The seeded choice falls on one aggregate for good.
group_query("groupby_random", group_stats.random_aggregate(7))


# Programs -----------------------------------------------------------------------------------------------

L = [Leaf(i) for i in range(4)]
PROGRAMS = {
    "gen_depth1": (Call("multiply", (L[0], L[2])), "qty * disc"),
    "gen_depth2": (Call("subtract", (Call("abs", (L[1],)), Call("add", (L[3], L[0])))), "abs(price) - (tax + qty)"),
    "gen_depth3": (
        Call("square", (Call("subtract", (Call("multiply", (L[2], L[3])), Call("square", (L[1],)))),)),
        "(disc * tax - price * price) * (disc * tax - price * price)",
    ),
}
TREES = [t for t, _ in PROGRAMS.values()]


def model_of(spark: SparkSession, d: str, outputs: tuple[int, ...] | None = None) -> tuple[DataFrame, FeatureModel]:
    df, scale = scaled_line(spark, d)
    return df, FeatureModel(scale, tuple(TREES), outputs or tuple(range(len(TREES) + len(LINE))))


def program_query(name: str, how: Callable) -> None:
    tree, sql = PROGRAMS[name] if name in PROGRAMS else PROGRAMS["gen_depth3"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        df, scale = scaled_line(spark, d)
        return df.select(*KEYS, r6(how(tree).column(scale.of())).alias("feature"))

    QUERIES[name], ORACLES[name] = run, SCALED + f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS feature FROM x"


for name_ in PROGRAMS:
    program_query(name_, lambda t: t)
program_query("transform_replay", lambda t: decode(encode(t)))

ALL_SEVEN = ", ".join(f"round({sql}, 6) AS g{i}" for i, (_, sql) in enumerate(PROGRAMS.values())) + ", " + ", ".join(f"round({k}, 6) AS {k}" for k in SHORT)


def seven(spark: SparkSession, d: str) -> DataFrame:
    df, model = model_of(spark, d)
    return df.select(*KEYS, *[r6(c).alias(n) for c, n in zip(model.columns(), ["g0", "g1", "g2", *SHORT], strict=True)])


@query(SCALED + f"SELECT l_orderkey, l_linenumber, {ALL_SEVEN} FROM x")
def hstack_generated_original(spark, d):
    return seven(spark, d)


@query(SCALED + f"SELECT l_orderkey, l_linenumber, {ALL_SEVEN} FROM x")
def transform_stability(spark, d):
    """A saved and loaded model gives the same columns."""
    df, model = model_of(spark, d)
    again = FeatureModel.from_json(model.to_json())
    made = again.transform(df, KEYS).toDF(*KEYS, "g0", "g1", "g2", *SHORT)
    return made.select(*KEYS, *[r6(c).alias(c) for c in made.columns[2:]])


@query(ORACLES["transform_stability"])
def stream_transform(spark, d):
    """The same model on a stream of the table's files."""
    _, model = model_of(spark, d)
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    made = run_available(model, spark, d, "lineitem.parquet", out, KEYS).toDF(*KEYS, "g0", "g1", "g2", *SHORT)
    return made.select(*KEYS, *[r6(c).alias(c) for c in made.columns[2:]])


@query(SCALED + "SELECT l_orderkey, l_linenumber, round(qty * disc, 6) AS f0, round(abs(price) - (tax + qty), 6) AS f1, round(qty, 6) AS f2, round(disc, 6) AS f3 FROM x")
def transform_fanova(spark, d):
    """A model whose test kept two programs and two columns: the others are never computed."""
    df, model = model_of(spark, d, (0, 1, 3, 5))
    made = model.transform(df, KEYS).toDF(*KEYS, "f0", "f1", "f2", "f3")
    return made.select(*KEYS, *[r6(c).alias(c) for c in made.columns[2:]])


@query(SCALED + "SELECT l_orderkey, l_linenumber, round(qty * disc, 6) AS a0, round(abs(price) - (tax + qty), 6) AS a1, round(qty * disc, 6) AS b0, round((disc * tax - price * price) * (disc * tax - price * price), 6) AS b1 FROM x")
def combine_iterations(spark, d):
    """Kept programs of two rounds side by side, equal ones included."""
    df, scale = scaled_line(spark, d)
    kept = {"a0": TREES[0], "a1": TREES[1], "b0": TREES[0], "b1": TREES[2]}
    return df.select(*KEYS, *[r6(t.column(scale.of())).alias(n) for n, t in kept.items()])


@query(
    "SELECT * FROM (VALUES (0, 1, 'multiply:0', '0,2', '(x0*x2)'), (1, 2, 'abs:0,add:0,subtract:1', '1,3,0', '(abs(x1)-(x3+x0))'), "
    "(2, 3, 'multiply:0,square:0,subtract:1,square:2', '2,3,1', 'square(((x2*x3)-square(x1)))')) t(feature_id, depth, ops, ids, name)"
)
def program_table(spark, d):
    rows = literal(spark, [row(i, t, ["x0", "x1", "x2", "x3"]) for i, t in enumerate(TREES)], PROGRAM_SCHEMA)
    ops = F.array_join(F.transform("ops", lambda o: F.concat(o["op"], F.lit(":"), o["depth"].cast("string"))), ",")
    return rows.select("feature_id", "depth", ops.alias("ops"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "name")


#: Worked out by hand from the order of the draws.
GOLDEN = [
    (0, ["abs(x2)", "(x2-x1)", "square((abs(x2)+(x3-x0)))", "(x3*x3)", "square(abs((x3-x0)))", "(square(x2)*(x1-x3))", "(x0-x2)", "abs(square(x2))"]),
    (42, ["square(x2)", "((x0*x3)*abs(x2))", "square(x3)", "(x0*x1)", "(x1-x2)", "(x1+x1)", "((x2-x0)*abs(x0))", "square(x3)"]),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({s}, {i}, '{n}')" for s, names in GOLDEN for i, n in enumerate(names)) + ") t(seed, place, name)")
def gen_candidates(spark, d):
    rows = [(seed, i, t.name(["x0", "x1", "x2", "x3"])) for seed in (0, 42) for i, t in enumerate(TreeSource(seed, 4).draw(8))]
    return literal(spark, rows, "seed int, place int, name string")


# Weights ------------------------------------------------------------------------------------------------


@query("SELECT d AS depth, round(pow(0.5, d) / sum(pow(0.5, d)) OVER (), 6) AS weight FROM (VALUES (1), (2), (3)) t(d)")
def depth_weights_(spark, d):
    return literal(spark, [(k + 1, float(w)) for k, w in enumerate(depth_weights())], "depth int, weight double").select("depth", r6("weight").alias("weight"))


QUERIES["depth_weights"], ORACLES["depth_weights"] = QUERIES.pop("depth_weights_"), ORACLES.pop("depth_weights_")


@query("SELECT l_returnflag, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS weight FROM lineitem GROUP BY l_returnflag")
def normalize_weights(spark, d):
    sums = line(spark, d).groupBy("l_returnflag").agg(F.sum("l_quantity").alias("w"))
    total = sums.agg(F.sum("w").alias("total"))
    return sums.join(F.broadcast(total), F.lit(True)).select("l_returnflag", r6(F.col("w") / F.col("total")).alias("weight"))


IG, SPLITS = [0.4, 0.3, 0.2, 0.1], [5.0, 2.0, 2.0, 1.0]


@query(
    "WITH w AS (SELECT * FROM (VALUES (0, 0.4::double, 5.0::double), (1, 0.3, 2.0), (2, 0.2, 2.0), (3, 0.1, 1.0)) t(feature, ig, sp)), "
    "n AS (SELECT feature, ig / sum(ig) OVER () AS ig, sp / sum(sp) OVER () AS sp FROM w) "
    "SELECT feature, round(ig, 6) AS plain, round(ig * sp / sum(ig * sp) OVER (), 6) AS comb, round(sp, 6) AS splits FROM n"
)
def ig_comb_weights(spark, d):
    modes = [column_prior(IG, SPLITS, m) for m in (None, "comb", "splits")]
    rows = [(i, *(float(m[i]) for m in modes)) for i in range(4)]
    return literal(spark, rows, "feature int, plain double, comb double, splits double").select("feature", *[r6(c).alias(c) for c in ("plain", "comb", "splits")])


@query("SELECT * FROM (VALUES ('multiply', 3), ('add', 2), ('subtract', 3), ('abs', 2), ('square', 3)) t(op, uses)")
def operator_counts_(spark, d):
    return literal(spark, list(operator_counts(TREES).items()), "op string, uses int")


QUERIES["operator_counts"], ORACLES["operator_counts"] = QUERIES.pop("operator_counts_"), ORACLES.pop("operator_counts_")


# Paths --------------------------------------------------------------------------------------------------

PATHS = [(0, 0, [0, 1]), (0, 1, [0, 1]), (0, 2, [0, 2]), (1, 0, [3, 0]), (1, 1, [0]), (1, 2, [3, 0]), (2, 0, [])]
PATHS_SQL = (
    "WITH p AS (SELECT * FROM (VALUES (0, 0, [0, 1]), (0, 1, [0, 1]), (0, 2, [0, 2]), (1, 0, [3, 0]), (1, 1, [0]), (1, 2, [3, 0]), (2, 0, [])) t(tree_id, leaf_no, path)), "
    "b AS (SELECT *, coalesce(lag(path) OVER (PARTITION BY tree_id ORDER BY leaf_no), "
    "last_value(path) OVER (PARTITION BY tree_id ORDER BY leaf_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM p), "
    "k AS (SELECT tree_id, leaf_no, path FROM b WHERE path IS DISTINCT FROM before), "
    "m AS (SELECT DISTINCT tree_id, leaf_no, unnest(path) AS feature FROM k) "
)


def paths(spark: SparkSession) -> DataFrame:
    return literal(spark, PATHS, "tree_id int, leaf_no int, path array<int>")


@query(PATHS_SQL + "SELECT tree_id, leaf_no, array_to_string(path, ',') AS path FROM k")
def path_dedupe(spark, d):
    return tree_paths_.dedupe_table(paths(spark)).select("tree_id", "leaf_no", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(PATHS_SQL + "SELECT feature, count(*) AS paths FROM m GROUP BY feature")
def path_split_counts(spark, d):
    return tree_paths_.split_count_table(paths(spark))


@query(PATHS_SQL + "SELECT a.feature AS i, b.feature AS j, count(*) AS paths FROM m a JOIN m b USING (tree_id, leaf_no) GROUP BY ALL")
def path_combos(spark, d):
    return tree_paths_.combination_table(paths(spark))


# Feature statistics -------------------------------------------------------------------------------------

SIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "product", "double_quantity"]
SIX_SQL = "WITH x AS (SELECT *, l_quantity * l_discount AS product, 2 * l_quantity + l_tax AS double_quantity, CAST(l_quantity * l_discount > 1.0 AS int) AS y, l_quantity * l_discount + l_tax AS t FROM lineitem) "
PAIRS_SQL = SIX_SQL + ", p AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr({SIX[i]}, {SIX[j]})) AS corr FROM x" for j in range(6) for i in range(j)) + ") "


def six(spark: SparkSession, d: str) -> DataFrame:
    df = line(spark, d)
    product = F.col("l_quantity") * F.col("l_discount")
    return df.withColumns({"product": product, "double_quantity": 2 * F.col("l_quantity") + F.col("l_tax"), "y": (product > 1.0).cast("int"), "t": product + F.col("l_tax")})


@query(PAIRS_SQL + "SELECT i, j, round(corr, 6) AS corr FROM p")
def corr_pairs(spark, d):
    return selection.correlation_pairs(six(spark, d), SIX).withColumn("corr", r6("corr"))


@query(PAIRS_SQL + "SELECT i, j, round(corr, 6) AS corr FROM p UNION ALL SELECT j, i, round(corr, 6) FROM p UNION ALL SELECT r::int, r::int, 1.0 FROM range(6) t(r)")
def corr_matrix(spark, d):
    matrix = selection.correlation_matrix(six(spark, d), SIX)
    return literal(spark, [(i, j, float(matrix[i, j])) for i in range(6) for j in range(6)], "i int, j int, corr double").withColumn("corr", r6("corr"))


@query(PAIRS_SQL + "SELECT j FROM p GROUP BY j HAVING max(corr) > 0.8")
def corr_filter(spark, d):
    return selection.correlated_table(selection.correlation_pairs(six(spark, d), SIX))


ANOVA_SQL = SIX_SQL + ", f AS (" + " UNION ALL ".join(
    f"SELECT {k} AS place, '{c}' AS feature, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f "
    f"FROM (SELECT y, count(*)::double AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM x GROUP BY y)"
    for k, c in enumerate(SIX)
) + ") "


def log_f() -> Column:
    """Large F values magnify the last digits of their sums; on the logarithm both sides can agree."""
    return F.round(F.ln(1 + F.col("f")), 5).alias("log_f")


@query(ANOVA_SQL + "SELECT feature, round(ln(1 + f), 5) AS log_f FROM f")
def anova_f(spark, d):
    return selection.anova_f(six(spark, d), SIX, "y").select("feature", log_f())


@query(SIX_SQL + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(ln(1 + pow(corr({c}, t), 2) / (1 - pow(corr({c}, t), 2)) * (count(*) - 2)), 5) AS log_f FROM x" for c in SIX))
def f_regression(spark, d):
    return selection.regression_f(six(spark, d), SIX, "t").select("feature", log_f())


EDGES = ["perfect", "constant", "good", "noise"]
EDGES_SQL = (
    "WITH x AS (SELECT CAST(l_quantity > 25 AS int) AS y, 3.7 * CAST(l_quantity > 25 AS int)::double - 1.1 AS perfect, 5.3::double AS constant, l_extendedprice AS good, l_tax AS noise FROM lineitem) "
)
KIND = "CASE WHEN f IS NULL THEN 'none' WHEN isinf(f) THEN 'infinite' ELSE 'finite' END AS kind, CASE WHEN isfinite(f) THEN round(ln(1 + f), 5) END AS log_f"


def edges(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("l_quantity") > 25).cast("int")
    return line(spark, d).select(y.alias("y"), (3.7 * y.cast("double") - 1.1).alias("perfect"), F.lit(5.3).alias("constant"), F.col("l_extendedprice").alias("good"), F.col("l_tax").alias("noise"))


def kinds(found: DataFrame) -> DataFrame:
    infinite = F.col("f") == float("inf")
    return found.select("feature", F.when(F.col("f").isNull(), "none").when(infinite, "infinite").otherwise("finite").alias("kind"), F.when(~infinite, F.round(F.ln(1 + F.col("f")), 5)).alias("log_f"))


ANOVA_EDGES = EDGES_SQL + ", f AS (SELECT 'perfect' AS feature, 'inf'::double AS f UNION ALL SELECT 'constant', NULL UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) FROM (SELECT y, count(*)::double AS n, avg({c}) AS m, var_pop({c}) AS v FROM x GROUP BY y), (SELECT avg({c}) AS g FROM x)"
    for c in ("good", "noise")
) + ") "


@query(ANOVA_EDGES + f"SELECT feature, {KIND} FROM f")
def anova_f_edges(spark, d):
    """A column that tells the classes apart without error, a constant one, and two others."""
    return kinds(selection.anova_f(edges(spark, d), EDGES, "y"))


@query(
    EDGES_SQL + ", f AS (SELECT 'perfect' AS feature, 'inf'::double AS f UNION ALL SELECT 'constant', NULL UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', pow(corr({c}, y), 2) / (1 - pow(corr({c}, y), 2)) * (count(*) - 2) FROM x" for c in ("good", "noise")) + f") SELECT feature, {KIND} FROM f"
)
def f_regression_edges(spark, d):
    return kinds(selection.regression_f(edges(spark, d), EDGES, "y"))


@query(ANOVA_EDGES + "SELECT feature, CAST(row_number() OVER (ORDER BY CASE feature WHEN 'perfect' THEN 0 WHEN 'constant' THEN 1 WHEN 'good' THEN 2 ELSE 3 END) AS int) AS place FROM (SELECT * FROM f WHERE f IS NOT NULL ORDER BY f DESC LIMIT 2)")
def select_k_best_edges(spark, d):
    """The two highest in the columns' order: the perfect column is among them, the constant one isn't."""
    found = {r["feature"]: r["f"] for r in selection.anova_f(edges(spark, d), EDGES, "y").collect()}
    top = selection.k_best([found[c] for c in EDGES], 2)
    return literal(spark, [(EDGES[i], k + 1) for k, i in enumerate(top)], "feature string, place int")


def f_values(spark: SparkSession, d: str) -> list[float]:
    found = {r["feature"]: r["f"] for r in selection.anova_f(six(spark, d), SIX, "y").collect()}
    return [found[c] for c in SIX]


@query(ANOVA_SQL + "SELECT feature, CAST(5 - row_number() OVER (ORDER BY f DESC) AS int) AS place FROM f QUALIFY row_number() OVER (ORDER BY f DESC) <= 4")
def topk_features(spark, d):
    """The four highest, the highest last."""
    top = selection.top_ascending(f_values(spark, d), 4)
    return literal(spark, [(SIX[i], k + 1) for k, i in enumerate(top)], "feature string, place int")


@query(ANOVA_SQL + ", k AS (SELECT place, feature FROM f ORDER BY f DESC LIMIT 3) SELECT feature, CAST(row_number() OVER (ORDER BY place) AS int) AS place FROM k")
def select_k_best(spark, d):
    """The three highest in the columns' order."""
    top = selection.k_best(f_values(spark, d), 3)
    return literal(spark, [(SIX[i], k + 1) for k, i in enumerate(top)], "feature string, place int")


@query(
    "SELECT feature, round(sum(importance * score) / sum(score), 6) AS importance FROM (VALUES (0, 0, 0.5::double, 0.8::double), (0, 1, 0.5, 0.8), (1, 0, 0.1, 0.6), (1, 1, 0.9, 0.6)) "
    "t(tree, feature, importance, score) GROUP BY feature"
)
def weighted_importance_avg(spark, d):
    rows = literal(spark, [(0, 0, 0.5, 0.8), (0, 1, 0.5, 0.8), (1, 0, 0.1, 0.6), (1, 1, 0.9, 0.6)], "tree int, feature int, importance double, score double")
    return importance.weighted_average_table(rows).select("feature", r6("importance").alias("importance"))


# Metrics ------------------------------------------------------------------------------------------------


def predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = six(spark, d)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rows.select(
        "y", (F.col("l_discount") > 0.04).cast("int").alias("p"), F.round("l_discount", 2).alias("score"), "t", (F.col("l_quantity") * 0.05).alias("guess"),
        flag.alias("c"), (F.col("l_linenumber") % 3).alias("cp"), *KEYS,
    )


PRED_SQL = SIX_SQL + (
    ", e AS (SELECT y, CAST(l_discount > 0.04 AS int) AS p, round(l_discount, 2) AS score, t, l_quantity * 0.05 AS guess, "
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, l_linenumber % 3 AS cp, l_orderkey FROM x) "
)
F1_SQL = "2.0 * count(*) FILTER (y = 1 AND p = 1) / (2.0 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y <> p))"


@query(PRED_SQL + f"SELECT round({F1_SQL}, 6) AS f1 FROM e")
def metric_f1_binary(spark, d):
    return metrics.f1_binary(predictions(spark, d), "y", "p").select(r6("f1").alias("f1"))


@query(
    PRED_SQL + ", k AS (SELECT v, (SELECT count(*) FROM e WHERE c = v) AS n, (SELECT count(*) FROM e WHERE cp = v) AS g, (SELECT count(*) FROM e WHERE c = v AND cp = v) AS tp FROM (VALUES (0), (1), (2)) t(v)) "
    "SELECT round(sum(n * 2.0 * tp / (n + g)) / sum(n), 6) AS f1_weighted FROM k"
)
def metric_f1_weighted(spark, d):
    return metrics.f1_weighted(predictions(spark, d), "c", "cp").select(r6("f1_weighted").alias("f1_weighted"))


@query(PRED_SQL + "SELECT round(1 - sum((t - guess) * (t - guess)) / (var_pop(t) * count(*)), 6) AS r2 FROM e")
def metric_r2(spark, d):
    return metrics.r2(predictions(spark, d), "t", "guess").select(r6("r2").alias("r2"))


@query(PRED_SQL + "SELECT round(avg((t - guess) * (t - guess)), 6) AS mse FROM e")
def metric_mse(spark, d):
    return metrics.mean_squared_error(predictions(spark, d), "t", "guess").select(r6("mse").alias("mse"))


@query(
    PRED_SQL + ", k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM e) "
    "SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)::double * count(*) FILTER (y = 0)), 6) AS auc FROM k"
)
def metric_roc_auc(spark, d):
    return metrics.roc_auc(predictions(spark, d), "y", "score").select(r6("auc").alias("auc"))


RULES = {"by_discount": "l_discount > 0.04", "by_quantity": "l_quantity > 20", "by_both": "l_discount > 0.03 AND l_quantity > 15"}
CV_SQL = SIX_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, fold, {F1_SQL.replace('p ', 'pr ').replace('p)', 'pr)')} AS f1 FROM (SELECT y, CAST({r} AS int) AS pr, (('0x' || substr(md5(CAST(l_orderkey AS varchar)), 1, 8))::bigint % 3) AS fold FROM x) GROUP BY fold"
    for n, r in RULES.items()
) + "), m AS (SELECT model, avg(f1) AS score FROM s GROUP BY model) "


def cv_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fixed rules stand in for models, so that SQL can score them too."""
    rows = sampling.folds(six(spark, d), sampling.row_hash(["l_orderkey"]))
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.expr(f"cast({r} as int)").alias("p")) for n, r in RULES.items()]))
    tidy = rows.select("y", "fold", cases.alias("m")).select("y", "fold", "m.*")
    return metrics.f1_binary(tidy, "y", "p", by=["model", "fold"]).groupBy("model").agg(F.avg("f1").alias("score"))


@query(CV_SQL + "SELECT model, round(score, 6) AS score FROM m")
def cv_mean_score(spark, d):
    return cv_scores(spark, d).withColumn("score", r6("score"))


@query(CV_SQL + "SELECT model, round(score, 6) AS score FROM m ORDER BY m.score DESC, model LIMIT 1")
def select_best_model(spark, d):
    return metrics.best(cv_scores(spark, d), "model", "score").withColumn("score", r6("score"))


# Generated tables, ensembles, whole fits: no SQL gives these ----------------------------------------------


@query()
def gen_classification(spark, d):
    return synthetic.classes(spark)


@query()
def gen_regression(spark, d):
    return synthetic.linear(spark)


@query()
def gen_friedman1(spark, d):
    return synthetic.friedman1(spark)


@query()
def gen_friedman2(spark, d):
    return synthetic.friedman2(spark)


def importance_query(spark: SparkSession, d: str, estimator: str) -> DataFrame:
    table = dataset("line_product").table(spark, d)
    found, _ = importance.importances(table, LINE, "y", estimator, Trees())
    return literal(spark, [(c, float(v)) for c, v in zip(LINE, found, strict=True)], "feature string, importance double")


@query()
def rf_importances(spark, d):
    return importance_query(spark, d, "rf")


@query()
def avg_importances(spark, d):
    return importance_query(spark, d, "avg")


@query()
def summed_importances(spark, d):
    """Importances of three samples of a third each, summed."""
    counted = sampling.count_copies(dataset("line_product").table(spark, d)).persist()
    rows = sampling.each_copy(counted)
    k, total = rows.count() // 3, np.zeros(len(LINE))
    for seed in range(3):
        key = sampling.row_key(rows.columns, seed)
        found, _ = importance.importances(sampling.exact_sample(rows, k, key), LINE, "y", "rf", Trees())
        total += found
    counted.unpersist()
    return literal(spark, [(c, float(v)) for c, v in zip(LINE, total, strict=True)], "feature string, importance double")


@query()
def weighted_importances(spark, d):
    found = importance.weighted_importances(dataset("line_product").table(spark, d), LINE, "y", Trees())
    return literal(spark, [(c, float(v)) for c, v in zip(LINE, found, strict=True)], "feature string, importance double")


@query()
def tree_paths(spark, d):
    """(tree_id, leaf_no, path) of a fitted forest."""
    rows = importance.filled(dataset("line_product").table(spark, d), LINE, "y")
    _, forest = importance.forest_importance(rows, len(LINE), Trees())
    found = [(t, k, p) for t, each in enumerate(tree_paths_.tree_paths(forest)) for k, p in enumerate(each)]
    return literal(spark, found, "tree_id int, leaf_no int, path array<int>")


@query()
def select_estimator(spark, d):
    table = dataset("line_product").table(spark, d)
    scores = models.cross_validated(table, LINE, "y", "classification", ["dt", "lr"])
    return literal(spark, list(scores.items()), "model string, score double")


def fitted(spark: SparkSession, d: str, name: str, **options) -> tuple[DataFrame, FeatureModel]:
    data = dataset(name)
    table = data.table(spark, d)
    return table, FeatureSynthesizer(task=data.task, **options).fit(table, data.features, "y")


@query()
def fit_stability(spark, d):
    table, model = fitted(spark, d, "line_product")
    return model.transform(table, ["y"])


@query()
def fit_fanova(spark, d):
    table, model = fitted(spark, d, "line_planted", selection="fAnova")
    return model.transform(table, ["y"])


@query()
def bench_results(spark, d):
    """All datasets and end models of the harness, with the fit's defaults."""
    return compare(spark, d, [each for group in catalogue().values() for each in group])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_stability(spark, sf_dir)
