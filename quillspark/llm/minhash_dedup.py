"""Near-duplicate documents by MinHash with tensored banding, confirmed on full sets.

Method
    1. Each document becomes the set of its distinct word shingles (64-bit hashes).
       Documents with equal sets (128-bit digest) collapse to the one of smallest id.
    2. Tensored banding: two small collections of ``collection`` bands, each of
       ``rows`` minhashes, are computed; the key of table (i, j) combines band i of
       the first with band j of the second.  ``collection ** 2`` tables so cost
       ``2 * collection * rows`` minhashes.  A pair of similarity s meets in a table with
       probability (1 - (1 - s**rows)**collection)**2: 0.99985 at s = 0.8 and the defaults.
       Before the tables are formed, documents drop out that share no band of the first or
       none of the second collection with any other: they meet nobody in any table.
    3. The documents that meet in a table are candidates, no more: texts that share a long common passage meet often
       without being alike.  A signature of a byte for each minhash tells how alike two documents are, and
       its differences keep the triangle inequality.  In each table's bucket every member is held against one leader.  Those with a
       share ``NEAR`` of equal bytes or more are tied to it.  Where others are in the bucket, they and all
       members that could be ``PLAUSIBLE`` with one of them (less than ``NEAR + 1 - PLAUSIBLE`` alike to the leader, by the
       inequality) meet each other, a bucket's signatures in one task, and plausible pairs are tied.  Buckets of
       more than ``block`` such members are cut by a further band of either collection first.  A pair of similarity 0.8 isn't
       plausible with a probability below 1e-4.
    4. Documents that ties connect are a family, which is verified on full sets.  A family is dealt over blocks of about
       ``block`` documents, each block with the family's first ``ANCHORS`` documents, and all pairs
       of a block are compared by an inverted index.  Families of one block are done then.
       In larger ones, the components found so far are dealt anew and every pair of blocks
       that holds different components is compared; pairs within one component can't
       change the result and are skipped.  No pair of an equal bucket is ever emitted as a row.
    5. The components of the confirmed links are the groups.

    So work grows with the documents, with the square only of large families of texts more than half alike that are no near duplicates.

Defined cases
    Null and empty texts, or texts of white space only, have an empty set and link with nothing;
    fewer words than the width make one shingle.  Rows with a null id can't be named: they link with nothing and get a row each with a
    null component, kept.  Rows that repeat an id count as one document with the smallest of their texts; further columns are ignored, whatever
    their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, forest
from .names import exactly
from .storage import Shelf
from .words import WordHashes, mix, odd_multipliers, shingles

ANCHORS = 8
#: Shares of equal signature bytes: from NEAR on a document is tied to its bucket's leader, from PLAUSIBLE on two documents are tied.
NEAR, PLAUSIBLE = 0.5, 0.65
#: Products that a worker holds at once.
HELD = 65_536
SKETCH = "doc_id long, n_shingles long, set_hi long, set_lo long, first array<long>, second array<long>, signature binary"


def minima(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    step = max(1, HELD // len(values))
    return np.concatenate([(multipliers[at : at + step, None] * values[None, :]).min(axis=1) for at in range(0, len(multipliers), step)])


def bands(minhashes: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` minhashes."""
    low = minhashes.reshape(-1, rows)
    key = np.arange(len(low), dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
    return key.view(np.int64)


def sketcher(width: int, collection: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, multipliers = WordHashes(), odd_multipliers(2 * collection * rows, 99)
        none: list[int] = []
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(words.of(text.as_py()), width)
                if not len(found):
                    out.append((doc, 0, 0, 0, none, none, b""))
                    continue
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                low = minima(found, multipliers)
                keys = bands(low, rows)
                out.append((doc, len(found), (digest >> 64) - 2**63, digest % 2**64 - 2**63, keys[:collection], keys[collection:], mix(low).astype(np.uint8).tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in SKETCH.split(", ")])

    return run


def setter(width: int) -> Callable:
    """Texts to sorted 64-bit sets, other columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingles(words.of(t.as_py()), width).tobytes() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "members"])

    return run


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of the pairs with 100 * intersection >= percent * union and different ``side``.

    An inverted index over the shingles that two or more sets hold gives the sizes of all intersections at once.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    runs = np.diff(np.r_[starts, len(values)])
    shared = np.zeros(n * n, dtype=np.int64)
    pending: list[np.ndarray] = []
    held = 0
    for length in np.unique(runs):
        if length < 2:
            continue
        rows = owner[starts[runs == length][:, None] + np.arange(length)]
        step = max(1, 2_000_000 // (length * length))
        for at in range(0, len(rows), step):
            part = rows[at : at + step].astype(np.int64)
            i, j = np.triu_indices(length, 1)
            pending.append((part[:, i] * n + part[:, j]).ravel())
            held += pending[-1].size
            if held > 2_000_000:
                shared += np.bincount(np.concatenate(pending), minlength=n * n)
                pending, held = [], 0
    if pending:
        shared += np.bincount(np.concatenate(pending), minlength=n * n)
    i, j = np.divmod(np.flatnonzero(shared), n)
    both = shared[i * n + j]
    good = (100 * both >= percent * (sizes[i] + sizes[j] - both)) & (side[i] != side[j])
    return i[good], j[good]


def in_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first ``keys`` columns, which the input is sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def verifier(keys: int, percent: int) -> Callable:
    """Rows (keys..., doc_id, side, members) to a spanning forest of the links in each run; sides differ in a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for table in in_runs(batches, keys):
            doc, side = (table.column(k).to_numpy() for k in (keys, keys + 1))
            doc, first = np.unique(doc, return_index=True)
            side, members = side[first], table.column(keys + 2)
            sets = [np.frombuffer(members[int(k)].as_py(), np.uint64) for k in first]
            i, j = similar_pairs(sets, side, percent) if len(sets) > 1 else ([], [])
            if len(i):
                u, v = forest(doc[i], doc[j])
                a.append(u)
                b.append(v)
                held += len(u)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["u", "v"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["u", "v"])

    return run


def signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.uint8) for x in column])


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, leader, two signatures) to (doc_id, leader, share of equal bytes)."""
    for batch in batches:
        if batch.num_rows:
            share = (signatures(batch.column(2)) == signatures(batch.column(3))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["doc_id", "leader", "share"])


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, signature), sorted by bucket, to a spanning forest of each bucket's plausible pairs."""
    for table in in_runs(batches, 1):
        doc, found = table.column(1).to_numpy(), signatures(table.column(2))
        share = np.stack([(found == one).mean(axis=1) for one in found])
        i, j = np.nonzero(np.triu(share >= PLAUSIBLE, 1))
        if len(i):
            u, v = forest(doc[i], doc[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def plausible_links(reps: DataFrame, shelf: Shelf, block: int) -> DataFrame:
    """(u, v): links that connect every two documents of ``reps`` that meet in a table and are plausible."""

    def shared(side: str) -> DataFrame:
        """doc_id and those of its band keys that other documents have too."""
        keys = reps.select("doc_id", F.explode(side).alias("key"))
        often = keys.groupBy("key").count().where("count > 1").select("key")
        return keys.join(often, "key").groupBy("doc_id").agg(F.collect_list("key").alias(side))

    both = shelf.saved(shared("first").join(shared("second"), "doc_id"))
    tables = both.select("doc_id", "second", F.explode("first").alias("i")).select("doc_id", "i", F.explode("second").alias("j"))
    leaders = tables.groupBy("i", "j").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    met = shelf.saved(tables.join(leaders, ["i", "j"]).where("doc_id <> leader"))
    marks = reps.select("doc_id", "signature")
    pairs = met.select("doc_id", "leader").distinct().join(marks, "doc_id").join(marks.select(F.col("doc_id").alias("leader"), F.col("signature").alias("other")), "leader")
    judged = shelf.saved(pairs.select("doc_id", "leader", "signature", "other").mapInArrow(alike, "doc_id long, leader long, share double"))
    links = judged.where(F.col("share") >= NEAR).select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))

    far = judged.where(F.col("share") < NEAR + 1 - PLAUSIBLE)
    groups = met.where("n > 2").join(far, ["doc_id", "leader"]).select(F.xxhash64("i", "j").alias("bucket"), "i", "j", "doc_id", "share")
    strange = groups.where(F.col("share") < NEAR).select("bucket").distinct()
    groups = shelf.saved(groups.join(strange, "bucket", "left_semi").drop("share"))
    for side, used in (("first", "i"), ("second", "j"), (None, None)):
        sizes = groups.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b")).where("n > 1")
        once = sizes.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n")  # many tables hold the same documents
        groups = groups.join(once, "bucket")
        work = groups.where(F.col("n") <= block).join(marks, "doc_id").select("bucket", "doc_id", "signature")
        links = links.union(shelf.saved(work.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(plausible, "u long, v long")))
        large = shelf.saved(groups.where(F.col("n") > block).drop("n"))
        if large.isEmpty():
            return links
        if side:  # documents that are alike share further bands
            cut = large.join(both.select("doc_id", side), "doc_id").withColumn("key", F.explode(F.array_except(side, F.array(used))))
            groups = shelf.saved(cut.select(F.xxhash64("bucket", "key").alias("bucket"), "i", "j", "doc_id"))
    least = large.groupBy("bucket").agg(F.min("doc_id").alias("v"))
    return links.union(large.join(least, "bucket").select(F.col("doc_id").alias("u"), "v"))


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, collection: int = 18, rows: int = 4, block: int = 256
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document; ``component_id`` is the
    smallest id that links reach, ``kept`` marks it.  See the module's text for the method."""
    spark: SparkSession = documents.sparkSession
    shelf = Shelf(spark, "near-duplicates")
    given = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = given.where("doc_id is not null")
    sketches = shelf.saved(given.mapInArrow(sketcher(width, collection, rows), SKETCH))
    one = sketches.where("doc_id is not null")
    if not one.groupBy("doc_id").count().where("count > 1").isEmpty():
        plain = plain.groupBy("doc_id").agg(F.min("text").alias("text"))
        one = shelf.saved(plain.mapInArrow(sketcher(width, collection, rows), SKETCH))
    best = F.min(F.struct("doc_id", "first", "second", "signature")).alias("s")
    reps = shelf.saved(one.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(best).select("set_hi", "set_lo", "s.*"))
    links = plausible_links(reps, shelf, block)
    family = shelf.saved(components(links, "u", "v", shelf).select(F.col("node").alias("doc_id"), F.col("component").alias("family")))

    # all members of a family against those of their block and against its anchors
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = family.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # anchors: the first of a family by hash, found as its minima over ANCHORS slices of the ids
    slices = placed.where("blocks > 1").groupBy("family", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(ANCHORS)).alias("slice")).agg(F.min("doc_id").alias("doc_id"), F.first("blocks").alias("blocks"))
    anchors = slices.select("family", "doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tasks = placed.select("doc_id", "family", "block").union(anchors.select("doc_id", "family", "block"))
    wanted = family.select("doc_id")
    sets = shelf.saved(plain.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text").mapInArrow(setter(width), "doc_id long, members binary"))
    rows_ = tasks.join(sets, "doc_id").select("family", "block", "doc_id", F.col("doc_id").alias("side"), "members")
    dealt = rows_.repartition("family", "block").sortWithinPartitions("family", "block")
    links = shelf.saved(dealt.mapInArrow(verifier(2, percent), "u long, v long"))

    large = shelf.saved(placed.where("blocks > 1").select("doc_id", "family"))
    if not large.isEmpty():
        found = components(links, "u", "v", shelf).withColumnRenamed("node", "doc_id")
        state = large.join(found, "doc_id", "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("side"))
        by_side = state.groupBy("family", "side").agg(F.count("*").alias("n"))
        # a component that fills blocks of its own keeps to them; the others share blocks
        pooled = F.col("n") < block // 2
        home = by_side.select("family", "side", "n", pooled.alias("pooled"), F.when(pooled, 0).otherwise(F.col("side")).alias("own"))
        parts = home.groupBy("family", "pooled", "own").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
        home = home.join(parts, ["family", "pooled", "own"]).select("family", "side", "pooled", "own", "parts")
        key = F.when(F.col("pooled"), F.xxhash64("side")).otherwise(F.xxhash64("doc_id"))
        part = F.xxhash64("family", "pooled", "own", F.pmod(key, F.col("parts"))).alias("part")
        state = shelf.saved(state.join(home, ["family", "side"]).select("doc_id", "family", "side", "pooled", "own", part))
        blocks = state.select("family", "pooled", "own", "part").distinct()
        one_, two = blocks.alias("a"), blocks.alias("b")
        crossed = one_.join(two, F.expr("a.family = b.family and a.part <= b.part and (a.pooled or b.pooled or a.own <> b.own)"))
        crossed = crossed.select(F.col("a.family").alias("family"), F.col("a.part").alias("p"), F.col("b.part").alias("q"))
        ends = crossed.select("family", "p", "q", F.col("p").alias("part")).union(crossed.select("family", "p", "q", F.col("q").alias("part"))).distinct()
        work = state.join(ends, ["family", "part"]).select("doc_id", "side", "p", "q").join(sets, "doc_id").select("p", "q", "doc_id", "side", "members")
        more = work.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(verifier(2, percent), "u long, v long")
        links = shelf.saved(links.union(more))

    classes = components(links, "u", "v", shelf).withColumnRenamed("node", "rep")
    shelf.drop(sets)
    heads = reps.select("set_hi", "set_lo", F.col("doc_id").alias("rep")).join(classes, "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
    named = one.select("doc_id", "n_shingles", "set_hi", "set_lo").join(heads, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    nameless = sketches.where("doc_id is null").select("doc_id", "n_shingles", "doc_id", F.lit(True))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")).union(nameless)


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, whatever their names, one of each group: that of smallest id.

    Rows without an id stay.  Of rows that repeat an id one stays, with the smallest text."""
    found = near_duplicates(documents, id_col, text_col, **options)
    # the whole row is one column beside the id, so that no name of it can clash
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.struct(*map(exactly, documents.columns)).alias("row"))
    kept = rows.join(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")), "id", "left_anti")
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    if not repeated.isEmpty():
        text = F.col("row").getField(text_col)
        # equal ids of equal texts: the smallest of the whole rows' texts decides
        one = kept.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.struct(text, F.to_json("row"))).alias("row"))
        kept = kept.join(repeated, "id", "left_anti").unionByName(one)
    return kept.select("row.*")
