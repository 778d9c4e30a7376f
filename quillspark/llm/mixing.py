"""Mixing sources to target weights, with DataFrame operations only.

A token budget flows down a tree domain -> language -> source.  Each node gives its
children shares in proportion to their weights; a child that can't use its share (its
tokens times ``max_epochs``, over all of its subtree) leaves the rest to its siblings in
proportion to theirs, and only what all siblings together can't use goes back to the
ancestors.  With children sorted by capacity / weight this water level has a closed form of prefix sums, which
settles each level, top down, because a node's capacity already is the sum of its leaves'.  The prefix sums have two levels, over slices of
capacity / weight and within them, so that siblings may be as many as there are web hosts.

A leaf with T tokens and budget A passes floor(A / T) whole epochs; of the next epoch it
takes the prefix of A mod T tokens in that epoch's order, which is that of
md5(seed:epoch:id).  The prefix sum has levels: sums of 4096 slices of the hash, summed up digit by digit, then
running sums within a slice, so that a leaf with a third of all rows is dealt over thousands of groups.

Tokens are maximal runs outside ASCII white space.

Defined cases
    Null texts have no tokens; a document without tokens comes with every epoch begun that its place
    falls into.  Null domains, languages and sources are the node "(none)".  Nodes of weight 0 or less, and all below,
    get nothing.  A node that the weights don't name has the weight ``default``.  A budget beyond all
    capacity is used as far as it goes.  Repeated rows count each.  Null ids sort first in an epoch.  An empty table gives an empty result.
    Further columns are ignored by ``select_tokens`` and kept by ``mix_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import exactly
from .storage import Shelf

WORDS = r"[^\x20\x09-\x0D]+"
SLICE_DIGITS = 3
#: Slices of capacity / weight in a doubling.
FILL_SLICES = 32
LEAF = ["domain", "lang", "source"]


@dataclass
class Weights:
    """By name; ``source`` weights hold in every language and ``lang`` weights in every domain."""

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    default: float = 1.0

    def column(self, level: str) -> Column:
        out = F.lit(float(self.default))
        for name, weight in sorted(getattr(self, level).items()):
            out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
        return out


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_level(children: DataFrame, parent: list[str], name: str, budget: Column, shelf: Shelf) -> DataFrame:
    """Adds ``share``: the part of ``budget`` (the same for all rows of a parent) that each child gets.

    ``children`` has the columns ``weight`` and ``capacity``.  In the order of capacity / weight, child k is filled
    if it still is at level (budget - capacities before) / (weights from k on); the level of the first that isn't holds for all."""
    keys = parent or ["root"]
    rows = children if parent else children.withColumn("root", F.lit(0))
    usable = F.col("weight") > 0
    rows = rows.withColumn("fill", F.when(usable, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("w", F.when(usable, F.col("weight")).otherwise(0.0)).withColumn("c", F.when(usable, F.col("capacity")).otherwise(0.0))
    finite = (F.col("fill") > 0) & (F.col("fill") < float("inf"))
    slice_ = F.when(finite, F.floor(F.log2(F.when(finite, F.col("fill"))) * FILL_SLICES)).when(F.col("fill") > 0, 1 << 30).otherwise(-(1 << 30)).cast("int")
    rows = shelf.saved(rows.withColumn("slice", slice_))  # a row for each node; read several times
    # at most some ten thousand slices of a parent
    sizes = rows.groupBy(*keys, "slice").agg(F.sum("c").alias("slice_c"), F.sum("w").alias("slice_w"))
    all_, along = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select(
        *keys, "slice", (F.sum("slice_c").over(along) - F.col("slice_c")).alias("c_before"), (F.sum("slice_w").over(all_) - F.sum("slice_w").over(along) + F.col("slice_w")).alias("w_behind")
    )
    within = Window.partitionBy(*keys, "slice").orderBy("fill", name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sizes, [*keys, "slice"])
    rows = rows.withColumn("before", F.col("c_before") + F.sum("c").over(within) - F.col("c")).withColumn("behind", F.col("w_behind") - F.sum("w").over(within) + F.col("w"))
    rows = shelf.saved(rows.withColumn("level", F.when(usable, (budget - F.col("before")) / F.col("behind"))))
    lines = rows.groupBy(*keys).agg(F.max(F.when(F.col("fill") > F.col("level"), F.col("level"))).alias("line"))
    rows = rows.join(lines, keys)
    share = F.when(~usable, 0.0).when(F.col("line").isNull(), F.col("c")).otherwise(F.least(F.col("c"), F.col("w") * F.col("line")))
    return rows.withColumn("share", F.greatest(share, F.lit(0.0))).drop("root", "fill", "w", "c", "slice", "c_before", "w_behind", "before", "behind", "level", "line")


def budgets(leaves: DataFrame, weights: Weights, budget_share: float | None, budget: int | None, max_epochs: int, shelf: Shelf) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``: whole tokens for each leaf."""
    rows = leaves.select(*LEAF, "tokens", *[weights.column(level).alias(f"w_{level}") for level in LEAF])
    live = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    rows = rows.withColumn("room", F.when(live, F.col("tokens").cast("double") * max_epochs).otherwise(0.0))
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * float(budget_share))  # one number
    rows = rows.withColumn("total", F.lit(float(budget)))
    domains = rows.groupBy("domain", "w_domain", "total").agg(F.sum("room").alias("capacity")).withColumnRenamed("w_domain", "weight")
    domains = water_level(domains, [], "domain", F.col("total"), shelf).select("domain", F.col("share").alias("domain_share"))
    langs = rows.groupBy("domain", "lang", "w_lang").agg(F.sum("room").alias("capacity")).withColumnRenamed("w_lang", "weight").join(domains, "domain")
    langs = water_level(langs, ["domain"], "lang", F.col("domain_share"), shelf).select("domain", "lang", F.col("share").alias("lang_share"))
    sources = rows.select(*LEAF, "tokens", F.col("w_source").alias("weight"), F.col("room").alias("capacity")).join(langs, ["domain", "lang"])
    sources = water_level(sources, ["domain", "lang"], "source", F.col("lang_share"), shelf)
    return sources.select(*LEAF, "tokens", F.floor(F.round("share", 3)).cast("long").alias("budget"))


def sums_before(slices: DataFrame, digits: int) -> DataFrame:
    """(domain, lang, source, slice, before): the sum of ``n`` over a leaf's smaller slices, digit by digit, so
    that no window holds more than the 16 slices of one beginning."""
    begin = F.substring("slice", 1, digits - 1)
    within = Window.partitionBy(*LEAF, "begin").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slices.withColumn("begin", begin).withColumn("inside", F.sum("n").over(within) - F.col("n"))
    if digits == 1:
        return rows.select(*LEAF, "slice", F.col("inside").alias("before"))
    above = sums_before(rows.groupBy(*LEAF, F.col("begin").alias("slice")).agg(F.sum("n").alias("n")), digits - 1)
    above = above.withColumnRenamed("slice", "begin").withColumnRenamed("before", "outside")
    return rows.join(above, [*LEAF, "begin"]).select(*LEAF, "slice", (F.col("inside") + F.col("outside")).alias("before"))


def select_tokens(
    documents: DataFrame, weights: Weights, domain: Column, budget_share: float | None = None, budget: int | None = None, max_epochs: int = 1, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, taken): a row for each document and epoch that the mix uses.

    The budget is ``budget`` tokens, or ``budget_share`` of all tokens.  ``taken`` is less than ``tokens`` only
    for the document that the end of a leaf's budget falls into."""
    if (budget is None) == (budget_share is None):
        raise ValueError("give one of budget and budget_share")
    shelf = Shelf(documents.sparkSession, "mixing")
    named = {"domain": domain, "lang": F.col(lang_col), "source": F.col(source_col)}
    slim = documents.select(
        F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("(none)")).alias(level) for level, c in named.items()], tokens_of(F.col(text_col)).alias("tokens")
    )
    slim = shelf.saved(slim)  # the texts are read once
    leaves = shelf.saved(slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")))
    plan = budgets(leaves, weights, budget_share, budget, max_epochs, shelf).withColumnRenamed("tokens", "leaf_tokens")
    whole = F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens"))
    plan = shelf.saved(plan.where("budget > 0").drop("budget", "leaf_tokens"))

    rows = slim.join(plan, LEAF)
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole")))).withColumn("taken", F.col("tokens"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), (F.col("whole") + 1).cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    part = rows.where("rest > 0").withColumn("epoch", F.col("whole") + 1).withColumn("place", order).withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    within = Window.partitionBy(*LEAF, "slice").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # written, like the nodes' tables: the driver describes a plan anew with each step of it, so long ones fill its memory
    slices = shelf.saved(sums_before(shelf.saved(part.groupBy(*LEAF, "slice").agg(F.sum("tokens").alias("n"))), SLICE_DIGITS))
    slices = slices.withColumnRenamed("before", "slices_before")
    part = part.join(slices, [*LEAF, "slice"]).withColumn("before", F.col("slices_before") + F.sum("tokens").over(within) - F.col("tokens"))
    part = part.where("before < rest").withColumn("taken", F.least(F.col("tokens"), F.col("rest") - F.col("before")))
    columns = ["doc_id", *LEAF, "epoch", "tokens", "taken"]
    return full.select(*columns).union(part.select(*columns))


def mix_documents(documents: DataFrame, weights: Weights, domain: Column, cut: bool = False, **options) -> DataFrame:
    """The documents of the mix with all their columns, once for each epoch that takes them.

    The document that a leaf's budget ends in comes whole, or, with ``cut``, with its text up to the last token that the budget pays for.  Rows that share an id follow the
    row among them that comes most often; null ids are one id.  An empty table gives an empty result."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    chosen = select_tokens(documents, weights, domain, **options)
    # rows of an id within one epoch count once
    epochs = chosen.groupBy(F.struct("doc_id").alias("key"), "epoch").agg(F.max("tokens").alias("tokens"), F.max("taken").alias("taken"))
    part = F.col("taken") < F.col("tokens") if cut else F.lit(False)
    times = epochs.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", F.when(part, F.col("taken")).alias("taken")))), lambda e: e["taken"]).alias("copies"))
    times = Shelf(documents.sparkSession, "mixing").saved(times)  # a short row for each chosen id; keeps the plan of the whole rows short
    # the whole row is one column beside the id, so that no name of it can clash
    rows = documents.select(F.struct(F.col(id_col).alias("doc_id")).alias("key"), F.struct(*map(exactly, documents.columns)).alias("row"))
    rows = rows.join(times, "key").select("row", F.explode("copies").alias("taken"))
    if cut:
        text = F.col("row").getField(text_col)
        tokens = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORDS), F.lit(0))  # each with the space before it
        rows = rows.withColumn("row", F.when(F.col("taken").isNull(), F.col("row")).otherwise(F.col("row").withField(f"`{text_col}`", F.array_join(F.slice(tokens, F.lit(1), F.col("taken").cast("int")), ""))))
    return rows.select("row.*")
