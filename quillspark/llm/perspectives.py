"""Dialogues from every participant's perspective, with DataFrame operations only.

For each participant of a conversation the dialogue is rendered with that speaker as the
assistant, all others as named users and system messages as such; the spans that the assistant says (text and
end mark) are the ones to train on.

A dialogue comes in parts of at most ``per_part`` messages, in order, so that a conversation of any length never meets
in one row or one collected list; ``start`` is the part's place in the whole dialogue, which is the parts' texts one after the other.
A message's place in its conversation, and a part's place in the dialogue, are counted in levels, so the
windows of a long conversation are dealt over many tasks; they hold numbers, no texts.  Messages of one turn are dealt by a hash of what they say.

Defined cases
    Messages come in the order of turn, null turns first, and within a turn of md5(speaker, 0x1F, text); repeated rows are repeated messages.  A null role is the speaker
    "unknown", a null text is empty, null conversation ids are one conversation.  A conversation of system messages only has no participant and gives no row.
    In names, characters but letters, digits, "_" and "-" of ASCII become "_", and such a name ends in "-" and the first 8 digits of the speaker's md5, so that
    speakers that differ only there are told apart by the others too.  Start marks written in a text are broken by a space ("< |").  An empty table gives an empty
    result.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Shelf

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Characters that names can't hold.
OTHER = "[^A-Za-z0-9_-]"


def sums_before(counts: DataFrame, keys: list[str], at: str, n: str, width: int = 4096) -> DataFrame:
    """(keys, at, before): the sum of ``n`` over smaller ``at`` of the same keys, in two levels."""
    begin = F.floor(F.col(at) / width)
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("begin", begin)
    rows = rows.withColumn("inside", F.sum(n).over(upto([*keys, "begin"], at)) - F.col(n))
    above = rows.groupBy(*keys, "begin").agg(F.sum(n).alias("sum"))
    above = above.select(*keys, "begin", (F.sum("sum").over(upto(keys, "begin")) - F.col("sum")).alias("outside"))
    return rows.join(above, [*keys, "begin"]).select(*keys, at, (F.col("inside") + F.col("outside")).alias("before"))


def placed(messages: DataFrame, turns_per_slice: int, shelf: Shelf) -> DataFrame:
    """Adds ``place``: the message's number in its conversation, from 0."""
    mark = F.md5(F.concat(F.col("speaker"), F.lit("\x1f"), F.col("text")).cast("binary"))
    rows = messages.withColumn("moment", F.struct("turn")).withColumn("mark", mark).withColumn("digits", F.substring("mark", 1, 2))
    slice_ = F.coalesce(F.floor(F.col("moment.turn") / turns_per_slice), F.lit(-(2**62)))
    groups = shelf.saved(rows.groupBy("conv", "moment", "digits").agg(F.count("*").alias("n")).withColumn("slice", slice_))
    slices = sums_before(groups.groupBy("conv", "slice").agg(F.sum("n").alias("n")), ["conv"], "slice", "n")
    along = Window.partitionBy("conv", "slice").orderBy("moment", "digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 256 rows a turn
    groups = groups.withColumn("inside", F.sum("n").over(along) - F.col("n")).join(slices, ["conv", "slice"])
    groups = groups.select("conv", "moment", "digits", (F.col("before") + F.col("inside")).alias("first"))
    within = Window.partitionBy("conv", "moment", "digits").orderBy("mark")
    rows = rows.withColumn("k", F.row_number().over(within)).join(groups, ["conv", "moment", "digits"])
    return rows.withColumn("place", F.col("first") + F.col("k") - 1).drop("moment", "mark", "digits", "first", "k")


def spoken(message: Column, perspective: Column, system_roles: list[str]) -> tuple[Column, Column]:
    """Heading and body of a message as that perspective sees it."""
    plain = F.regexp_replace(message["speaker"], OTHER, "_")
    name = F.when(message["speaker"].rlike(OTHER), F.concat(plain, F.lit("-"), F.substring(F.md5(message["speaker"].cast("binary")), 1, 8))).otherwise(plain)
    heading = F.when(message["speaker"] == perspective, "assistant").when(message["speaker"].isin(system_roles), "system").otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), heading, F.lit("\n")), F.concat(F.replace(message["text"], F.lit("<|"), F.lit("< |")), F.lit(CLOSE))


def rotate_perspectives(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    system_roles: tuple[str, ...] = ("system",), per_part: int = 64, turns_per_slice: int = 64,
) -> DataFrame:
    """(conv_id, speaker, part, messages, start, dialogue, spans): spans is an array of (start, end), in
    characters of this part's dialogue, end exclusive."""
    roles = list(system_roles)
    # as a structure the key is never null, so that every step can share one way of dealing
    rows = messages.select(
        F.struct(F.col(conv_col).alias("conv_id")).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    shelf = Shelf(messages.sparkSession, "perspectives")
    parts = placed(rows, turns_per_slice, shelf).withColumn("part", F.expr(f"place div {per_part}"))
    parts = shelf.saved(parts.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("said")))

    # where each part begins is told by numbers alone: how long it is to others, and how much less to a participant whose own lines are in it
    message = F.col("m")
    heading, body = spoken(message, F.lit(None).cast("string"), roles)
    mine, _ = spoken(message, message["speaker"], roles)
    own = parts.select("conv", "part", F.explode("said").alias("m"))
    own = own.groupBy("conv", "part", message["speaker"].alias("speaker")).agg(F.sum(F.length(heading) + F.length(body)).alias("all"), F.sum(F.length(mine) - F.length(heading)).alias("change"))
    own = shelf.saved(own)
    people = own.where(~F.col("speaker").isin(roles)).select("conv", "speaker").distinct()
    sizes = own.groupBy("conv", "part").agg(F.sum("all").alias("all")).join(people, "conv").join(own.drop("all"), ["conv", "part", "speaker"], "left")
    sizes = shelf.saved(sizes.select("conv", "speaker", "part", (F.col("all") + F.coalesce("change", F.lit(0))).alias("n")))
    starts = sums_before(sizes, ["conv", "speaker"], "part", "n").withColumnRenamed("before", "start")
    both = parts.join(starts, ["conv", "part"])

    def lines(m: Column) -> Column:
        heading, body = spoken(m, F.col("speaker"), roles)
        return F.struct(heading.alias("heading"), body.alias("body"), (m["speaker"] == F.col("speaker")).alias("mine"))

    both = both.withColumn("lines", F.transform("said", lines)).drop("said")
    both = both.withColumn("dialogue", F.array_join(F.transform("lines", lambda x: F.concat(x["heading"], x["body"])), ""))
    # at most per_part lines: the quadratic prefix sums stay small
    ends = F.transform("lines", lambda x, i: F.aggregate(F.slice("lines", F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y["heading"]) + F.length(y["body"])))
    spans = F.transform(F.arrays_zip(ends.alias("end"), F.col("lines").alias("line")), lambda z: F.struct((z["end"] - F.length(z["line"]["body"])).alias("start"), z["end"].alias("end"), z["line"]["mine"].alias("mine")))
    spans = F.transform(F.filter(spans, lambda z: z["mine"]), lambda z: F.struct(z["start"], z["end"]))
    both = both.withColumn("spans", spans)
    return both.select("conv.conv_id", "speaker", "part", F.size("lines").alias("messages"), "start", "dialogue", "spans")


def span_text(spans: Column) -> Column:
    """ "start-end" of each span, with spaces between."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
