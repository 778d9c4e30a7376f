"""Cross-entropy difference of two matched n-gram models.

A target model and a background model share one vocabulary, the ids of a byte-level BPE file and a start
mark, and have the same form: interpolated bigrams,

    p(w | h) = keep * c(h, w) / c(h) + (1 - keep) * (c(w) + 1) / (N + V)        (keep = 0 where c(h) = 0)

with counts from all target documents and from all documents.  A document is scored by the counts of the others: its own
are taken off the background's and, if it is a target document, the target's, so that no document is likely just because
it was counted.  Its score is the mean over its tokens of -ln p_target + ln p_background: the lower, the more it is like the target.

One plan at any size
    1. Texts are encoded once and written as ids, in chunks of about ``CHUNK`` tokens of neighbouring documents.
    2. Each task adds up its documents' bigrams and hands on one row per different one; sums by bigram
       follow.  The bigram table so grows with the corpus and isn't cut; it is never broadcast or sent to the driver.  Target documents are
       found by a join of ids, without texts, and marked chunk by chunk.  Counts by word and by predecessor have at most V rows and are broadcast.
    3. Each chunk asks the bigram table for its different bigrams, one row each however often its documents hold them, and
       meets the answers in one group, where its documents look them up.

Defined cases
    Null and empty texts have no tokens and differences of 0.0.  Null ids are kept and are no target.  Rows that repeat an id are counted and scored each; they are target
    documents all or none.  Without target documents the target model is uniform; an empty table gives an empty result.  A text of any length is
    one document in one chunk.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_bpe
from .storage import Shelf

BITS = 20
#: Tokens of a chunk, about.
CHUNK = 2_000_000
#: Tokens, then sums, that a task holds before it adds up and hands on.
HELD = 2_000_000


def summed(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(w[order], first) if len(first) else w for w in weights]


def bigrams(parts: list[np.ndarray], start: int) -> np.ndarray:
    """(predecessor, word) of every token of id arrays that begin each with the start mark, as longs."""
    ids = np.concatenate([*parts, [start]]).astype(np.int64)
    keys = ids[:-1] << BITS | ids[1:]
    return keys[ids[1:] != start]


def encoded(source, small: bool) -> Callable:
    """(doc_id, text) to (chunk, doc_id, tokens, ids); ids in two bytes each if they are ``small``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = byte_bpe(source.value)
        context = TaskContext.get()
        chunk, size = (context.partitionId() if context else 0) << 32, 0
        for batch in batches:
            chunks, n, raw = [], [], []
            for text in batch.column(1):
                ids = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all")
                if size and size + len(ids) > CHUNK:
                    chunk, size = chunk + 1, 0
                size += len(ids) + 1  # empty texts fill chunks too
                chunks.append(chunk)
                n.append(len(ids))
                raw.append(ids.astype("<u2" if small else "<u4").tobytes())
            columns = [pa.array(chunks, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "tokens", "ids"])

    return run


def counter(start: int, small: bool) -> Callable:
    """(ids) to (key, n)."""
    kind, begin = "<u2" if small else "<u4", np.array([start], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        sums: list[tuple] = []
        tokens = 0

        def add_up() -> None:
            if parts:
                sums.append(np.unique(bigrams(parts, start), return_counts=True))
                parts.clear()

        def out() -> pa.RecordBatch:
            keys, (n,) = summed(np.concatenate([s[0] for s in sums]), [np.concatenate([s[1] for s in sums])])
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_py(), kind)
                parts += [begin, ids]
                tokens += len(ids)
                if tokens >= HELD:
                    add_up()
                    tokens = 0
                    if sum(len(s[0]) for s in sums) >= HELD:
                        yield out()
        add_up()
        if sums:
            yield out()

    return run


def asker(start: int, small: bool) -> Callable:
    """(chunk, ids), chunk after chunk, to (chunk, key): a chunk's different bigrams."""
    kind, begin = "<u2" if small else "<u4", np.array([start], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = np.unique(bigrams(parts, start))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), current), pa.int64()), pa.array(keys, pa.int64())], names=["chunk", "key"])

        parts: list[np.ndarray] = []
        current = None
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != current and parts:
                    yield out()
                    parts = []
                current = chunk
                parts += [begin, np.frombuffer(raw.as_py(), kind)]
        if parts:
            yield out()

    return run


def marker(documents: pa.Table, marks: pa.Table) -> pa.Table:
    """A chunk's documents with ``wanted``: whether their id is among the marks."""
    wanted = pc.is_in(documents.column("doc_id"), pa.array(marks.column("doc_id").to_pylist(), pa.int64()), skip_nulls=True)
    columns = [documents.column("chunk"), documents.column("doc_id"), documents.column("tokens"), wanted, documents.column("ids")]
    return pa.table(columns, names=["chunk", "doc_id", "tokens", "wanted", "ids"])


class Counts:
    """Counts by id: as word and as predecessor, in the target and in everything."""

    def __init__(self, rows: list, size: int, vocabulary: int):
        self.words, self.before = np.zeros((2, size)), np.zeros((2, size))
        self.vocabulary = vocabulary
        for side, at, target, everything in rows:
            (self.words if side == "w" else self.before)[:, at] = target, everything
        self.total = self.words.sum(axis=1)


def scorer(counts, start: int, small: bool, keep: float) -> Callable:
    """A chunk's documents (chunk, doc_id, tokens, wanted, ids) and answers (chunk, key, target, everything) to losses."""
    kind = "<u2" if small else "<u4"

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        known = counts.value
        keys = answers.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        table = [answers.column(c).to_numpy()[order] for c in ("target", "everything")]
        sums: list[tuple[float, float]] = []
        for wanted, raw in zip(documents.column("wanted").to_pylist(), documents.column("ids"), strict=True):
            ids = np.frombuffer(raw.as_py(), kind)
            if not len(ids):
                sums.append((0.0, 0.0))
                continue
            own, times = np.unique(bigrams([np.array([start]), ids], start), return_counts=True)
            h, w = own >> BITS, own & ((1 << BITS) - 1)
            at = np.searchsorted(keys, own)
            own_h, own_w = (np.bincount(np.unique(x, return_inverse=True)[1], times)[np.unique(x, return_inverse=True)[1]] for x in (h, w))
            both = []
            for side in (0, 1):
                off = 1 if side or wanted else 0
                pair, before = table[side][at] - off * times, known.before[side][h] - off * own_h
                single = (known.words[side][w] - off * own_w + 1) / (known.total[side] - off * len(ids) + known.vocabulary)
                some = before > 0
                p = np.where(some, keep * pair / np.where(some, before, 1) + (1 - keep) * single, single)
                both.append(float(times @ -np.log(p)))
            sums.append((both[0], both[1]))
        pairs = np.array(sums).reshape(-1, 2)
        return pa.table({"doc_id": documents.column("doc_id"), "tokens": documents.column("tokens"), "target_sum": pairs[:, 0], "background_sum": pairs[:, 1]})

    return run


def cross_entropy_difference(documents: DataFrame, targets: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.8) -> DataFrame:
    """(doc_id, tokens, target_loss, background_loss, difference), losses in nats per token.

    ``targets`` holds the ids of the target documents in its first column."""
    spark = documents.sparkSession
    shelf = Shelf(spark, "lm-difference")
    source = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    largest = byte_bpe(source.value)[0].max_token_value
    vocabulary = len(byte_bpe(source.value)[0].token_byte_values()) + 1
    start, small = largest + 1, largest < 1 << 16
    if start >= 1 << BITS:
        raise ValueError(f"ids must be below {(1 << BITS) - 1}")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = shelf.saved(rows.mapInArrow(encoded(source, small), "chunk long, doc_id long, tokens long, ids binary"))
    wanted = targets.select(F.col(targets.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # which rows are targets is found by ids alone; the marks then go to the rows' chunks
    marks = shelf.saved(tokens.select("chunk", "doc_id").distinct().join(wanted, "doc_id", "left_semi"))
    marked = shelf.saved(tokens.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(marker, "chunk long, doc_id long, tokens long, wanted boolean, ids binary"))
    shelf.drop(tokens)

    def counted(some: DataFrame, name: str) -> DataFrame:
        return some.select("ids").mapInArrow(counter(start, small), "key long, n long").groupBy("key").agg(F.sum("n").alias(name))

    everything = counted(marked, "everything")
    target = counted(marked.where("wanted"), "target")
    table = shelf.saved(everything.join(target, "key", "left").select("key", F.coalesce("target", F.lit(0)).alias("target"), "everything"))
    sides = []
    for side, at in (("h", F.shiftright("key", BITS)), ("w", F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)))):
        sides.append(table.groupBy(at.alias("at")).agg(F.sum("target").alias("target"), F.sum("everything").alias("everything")).select(F.lit(side).alias("side"), "at", "target", "everything"))
    found = [tuple(r) for r in sides[0].union(sides[1]).collect()]  # at most one row for each id of the vocabulary and side
    counts = spark.sparkContext.broadcast(Counts(found, start + 1, vocabulary))
    asked = marked.select("chunk", "ids").mapInArrow(asker(start, small), "chunk long, key long")
    answers = asked.join(table, "key").select("chunk", "key", "target", "everything")
    scored = marked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scorer(counts, start, small, keep), "doc_id long, tokens long, target_sum double, background_sum double")
    n = F.greatest(F.col("tokens"), F.lit(1))
    losses = [(F.col(f"{kind}_sum") / n).alias(f"{kind}_loss") for kind in ("target", "background")]
    return scored.select("doc_id", "tokens", *losses, ((F.col("target_sum") - F.col("background_sum")) / n).alias("difference"))
