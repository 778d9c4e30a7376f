"""Order MinHash fingerprints of texts, with DataFrame operations only.

The letters of a text are its words (maximal runs outside ASCII white space; longer ones in pieces of
``LETTER`` characters, so that texts without spaces have letters too).  Its k-mers are runs of ``k`` letters, each
numbered by how often it came before in the text, so that all (k-mer, number) pairs of a text differ.  A hash deals the pairs over ``tuples`` bins.
Function f orders all pairs by their bin's place in f's own random order of the bins, in which bin f is first, and within a bin by the hash; it
selects the ``length`` pairs that are minimal in its order.  So a long text gives each function pairs of its own, and where a text is too short to fill
the bins, functions go on in orders that are independent of each other.  The selected pairs are put back in the order of the text
and hashed together.  The share of equal tuple hashes falls with the edit distance, of words moved as well as of words replaced.

Everything a text needs stays in its row: two sorted arrays of packed longs (hash above, position below), binary searches in them, no
shuffle.  Occurrence numbers come from a search only where a k-mer equals the one sorted before it.  A position takes ``PLACE_BITS`` bits, enough
for the letters of the longest text that a string can hold; the hash has the other 34, so that two different k-mers of a text of 20,000 words count as equal with a
chance of about 1 in 100, which then changes one occurrence number.

Defined cases
    Null texts are empty; a text without words has the empty fingerprint, like others of its kind 1.0, like any other text 0.0.
    Fewer than k letters make one k-mer; fewer pairs than ``length`` give shorter tuples.  Texts that differ in white space only have equal fingerprints.
    For the next document, rows are ordered by (id, hash of the text, text), null ids first; identical rows follow each other; the only row of a table follows itself.  An
    empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ladder import numbers, quantiles, rung

LETTER = 16
LETTERS = r"[^\x20\x09-\x0D]{1,%d}" % LETTER
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1


def bin_orders(tuples: int) -> list[list[int]]:
    """For each function the bins from first to last: its own, then the others as a fixed seed has them."""
    rng = np.random.RandomState(7)
    return [[f, *(int(b) for b in rng.permutation(tuples) if b != f)] for f in range(tuples)]


def powers_upto(n: Column) -> Column:
    """Descending powers of two up to n, for binary searches."""
    return F.filter(F.array(*[F.lit(1 << b) for b in range(PLACE_BITS, -1, -1)]), lambda b: b <= n)


def high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def fingerprint(rows: DataFrame, text_col: str, out: str, k: int, length: int, tuples: int) -> DataFrame:
    """Adds ``out``: an array of ``tuples`` ints, empty for texts without words."""
    t, s, v, b, e = (f"__{name}_{out}" for name in ("letters", "kmers", "pairs", "steps", "ends"))
    rows = rows.withColumn(t, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(LETTERS), F.lit(0)))
    rows = rows.withColumn(t, F.transform(t, lambda w: F.xxhash64(w)))
    last = F.greatest(F.size(t) - k, F.lit(0))
    kmer = lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)])
    pack = lambda h, i: F.shiftleft(high(h), PLACE_BITS).bitwiseOR(i.cast("long"))
    kmers = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: pack(kmer(i), i)))
    rows = rows.withColumn(s, F.when(F.size(t) > 0, kmers).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn(b, powers_upto(F.size(s)))

    def pair(x: Column, i: Column) -> Column:
        alike = lambda at: high(F.get(s, at)) == high(x)  # noqa: E731  null before the start
        number = F.aggregate(b, F.lit(0), lambda n, step: F.when(alike(i - n - step), n + step).otherwise(n))
        number = F.when(alike(i - 1), number).otherwise(F.lit(0))
        return pack(F.xxhash64(high(x), number), x.bitwiseAND(F.lit(PLACE)))

    rows = rows.withColumn(v, F.sort_array(F.transform(s, pair)))
    n = F.size(v)
    starts = [F.lit(-(2**63) + f * (2**64 // tuples)).cast("long") for f in range(tuples)]
    below = lambda point: F.aggregate(b, F.lit(0), lambda at, step: F.when(F.get(v, at + step - 1) < point, at + step).otherwise(at))
    rows = rows.withColumn(e, F.concat(F.transform(F.array(*starts), below), F.array(n)))  # where each bin begins among the sorted pairs, and the end

    def chosen(order: Column) -> Column:
        def more(held: Column, bin_: Column) -> Column:
            first, end = F.get(e, bin_), F.get(e, bin_ + 1)
            return F.when((F.size(held) >= length) | (first == end), held).otherwise(F.concat(held, F.slice(v, first + 1, F.least(F.lit(length) - F.size(held), end - first))))

        picked = F.aggregate(order, F.array().cast("array<long>"), more)
        # position above, pair below: sorted, the tuple is in the order of the text
        turned = F.transform(picked, lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS)))
        return F.xxhash64(F.transform(F.sort_array(turned), lambda x: F.shiftleft(x, PLACE_BITS))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    orders = F.array(*[F.array(*map(F.lit, order)) for order in bin_orders(tuples)])
    made = F.when(n > 0, F.transform(orders, chosen)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(out, made).drop(t, s, b, v, e)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(same / F.size(a))


def as_hex(fingerprint_: Column) -> Column:
    return F.array_join(F.transform(fingerprint_, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def with_next(documents: DataFrame, rows_per_block: int = 500, most_blocks: int = 65_536) -> DataFrame:
    """``documents`` (doc_id, text) dealt over blocks of neighbouring ids: (place, ghost, doc_id, text, mark).

    Blocks are cut at quantiles of the ids, at most ``most_blocks``, which are all that comes to the driver; beyond 33 million documents blocks grow, and their
    windows sort on disk.  Blocks that one id or null fills are cut into parts by the hash of the text, ``mark``, so that an id that comes very often isn't one task's
    work; ``place`` names block and part.  Each part ends in a ghost, a copy of the row that follows its last one (behind the last, the first row of all), so
    that every row's successor is in its own part, whose other rows needn't be seen."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, nulls = slim.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    blocks = min(max(1, -(-n // rows_per_block)), most_blocks)
    found = quantiles(slim, "doc_id", blocks, 20 * blocks)
    times = Counter(found)
    # an id that several quantiles fall on fills a block of its own
    edges = sorted({*found, *(x + 1 for x, t in times.items() if t > 1)})
    bits = [0, *((times[x] - 1).bit_length() + 1 if times[x] > 1 else 0 for x in edges)]
    null_bits = min(16, (nulls // rows_per_block).bit_length())
    block = rung(F.col("doc_id"), edges)
    mark, part = F.xxhash64("text"), F.lit(0)
    if any(bits) or null_bits:
        cut = F.when(F.col("doc_id").isNull(), F.lit(null_bits)).otherwise(F.get(numbers(bits), F.col("block"))).cast("int")
        part = F.when(cut > 0, F.call_function("shiftright", mark, 64 - cut)).otherwise(F.lit(0).cast("long"))
    rows = documents.withColumn("block", block)
    place = F.struct("block", F.col("doc_id").isNotNull().alias("named"), part.cast("long").alias("part")).alias("place")
    dealt = rows.select(place, F.lit(0).alias("ghost"), "doc_id", "text", mark.alias("mark"))
    # the first id of each part, without the texts unless parts are cut by them
    heads = dealt.groupBy("place").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("place")  # one short row per part, at most about twice most_blocks
    target = F.coalesce(F.lag("place").over(order), F.max("place").over(Window.partitionBy(F.lit(0))))
    heads = F.broadcast(heads.select(F.col("place").alias("own"), "head", target.alias("target")))
    ghosts = dealt.join(heads, (F.col("place") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")))
    ghosts = ghosts.groupBy("target").agg(F.min(F.struct("doc_id", "mark", "text")).alias("row"))
    return dealt.union(ghosts.select("target", F.lit(1), "row.doc_id", "row.text", "row.mark"))


def order_minhash(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, length: int = 2, tuples: int = 32) -> DataFrame:
    """(doc_id, fingerprint) with the fingerprint as an array of ints."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fingerprint(rows, "text", "fingerprint", k, length, tuples).select("doc_id", "fingerprint")


def edited_neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, length: int = 2, tuples: int = 32) -> DataFrame:
    """Each document's fingerprint against those of an edited form and of the next document.

    The edited form has the last quarter of the code points (rounded down) replaced by the first as many of the next document's."""
    rows = with_next(documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = fingerprint(rows, "text", "own", k, length, tuples)
    order = Window.partitionBy("place").orderBy("ghost", "doc_id", "mark", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order)).where("ghost = 0")
    n = F.length("text")
    quarter = F.expr("length(text) div 4").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = fingerprint(rows.drop("next_text"), "edited", "edited_own", k, length, tuples)
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("edited_own")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
