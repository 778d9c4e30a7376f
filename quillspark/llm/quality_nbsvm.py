"""Document quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed into ``2 ** BITS`` slots: words and word pairs
(A-Z lower-cased) and byte trigrams of the text as written; with ``repeats`` also, whatever the word, how long its longest run
of one word is and what share of it such runs cover, an indicator for each power of two, as these are n-grams that pairs of certain words can't stand for.
Each is scaled by its log-count ratio r = log((a + n1) / (a + N1)) - log((a + n0) / (a + N0))
between the classes, rows are brought to length 1, and a linear hinge-loss model is fitted to
them by dual coordinate descent.  A logistic curve over margins from cross-validation, so of rows that
the fit behind them has not seen, turns a margin into a probability.

Bound of the fit: at most ``max_rows`` labelled documents, those of smallest ``xxhash64(id)``, with one text each.  Their slots (some thousand 4-byte
numbers a text) meet in one task, which fits the model; the driver only passes on two tables of ``2 ** BITS`` floats, compressed and never unpacked in the JVM.  Scoring covers every row
and whole texts.

Defined cases
    Null and empty texts have no n-gram; their score is the curve at the model's offset.  Label rows
    with a null id or label are ignored; of an id's several labels the smallest counts.  Without rows of
    both classes every score is the smoothed share of label 1 (0.5 with no labels).  Repeated documents get a row each;
    of the texts of an id that of smallest ``xxhash64``, then the smallest, teaches, however the table is stored.  An empty table gives an
    empty result.  Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .names import apart, fields, numbered
from .words import WordHashes, mix

BITS = 20
FOLDS = 5
PAIR, BYTES, RUNS = np.uint64(0x51_7CC1B7), np.uint64(0x2F_0B4C47), np.uint64(0x6C_8E9CF5)


def slots(text: str | None, words: WordHashes, repeats: bool = True) -> np.ndarray:
    """The sorted slots of a text's n-grams, each once."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    single = words.of(text)
    parts = [single]
    if len(single) > 1:
        parts.append(mix(single[:-1] + mix(single[1:] + PAIR)))
        edge = np.flatnonzero(np.diff(np.r_[False, single[1:] == single[:-1], False])) if repeats else ()
        if len(edge):
            again = edge[1::2] - edge[::2]
            steps = [np.arange(int(np.log2(again.max())) + 1), 32 + np.arange(int(np.log2(max(1, 256 * again.sum() // len(single)))) + 1)]
            parts.append(mix(np.concatenate(steps).astype(np.uint64) + RUNS))
    if len(raw) > 2:
        seen = np.unique(raw[:-2].astype(np.uint32) | raw[1:-1].astype(np.uint32) << 8 | raw[2:].astype(np.uint32) << 16)
        parts.append(mix(seen.astype(np.uint64) + BYTES))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weights: np.ndarray, size: int, epochs: int, tolerance: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum of weights * max(0, 1 - y (w x + b)); the offset is a constant feature of 1.

    Rows whose multiplier stays at a bound are left out until the others have settled, then all are looked at again."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    everything = np.arange(len(rows))
    active = everything
    for _ in range(epochs):
        most, moved = 0.0, []
        for i in rng.permutation(active):
            at, v, old = rows[i], values[i], alpha[i]
            slope = y[i] * (w[at] @ v + b) - 1.0
            new = min(max(old - slope / norm[i], 0.0), weights[i])
            step = new - old
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                b += step * y[i]
                most = max(most, abs(step))
                moved.append(i)
        if most < tolerance:
            if len(active) == len(rows):
                break
            active = everything
        else:
            active = np.array(moved)
    return w, b


def logistic(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(1) over the margin, by Newton's method with smoothed targets."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.c_[margins, np.ones(len(margins))]
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (target - p))
        theta = theta + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def packed(table: np.ndarray) -> bytes:
    """A float32 table without loss, the numbers' first bytes side by side, then their second ones and so on: these repeat."""
    return zlib.compress(table.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.float32).ravel()


@dataclass
class QualityModel:
    """ratio: r by slot; weight: w * r by slot; score = curve((sum of weight) / |r| + offset).  Pickled, so also broadcast, it is compressed."""

    ratio: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float
    shift: float
    repeats: bool = True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ratio": packed(self.ratio), "weight": packed(self.weight)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"ratio": unpacked(state["ratio"]), "weight": unpacked(state["weight"])}

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for k, at in enumerate(rows):
            r = self.ratio[at].astype(np.float64)
            length = np.sqrt(r @ r)
            out[k] = self.offset + (self.weight[at].astype(np.float64).sum() / length if length else 0.0)
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -700, 700)))

    def score(self, documents: DataFrame, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` (all, if None) and ``score_col``, which takes the place of a column of that name."""
        kept = [c for c in apart(documents.columns, [score_col]) if keep is None or c in keep]
        rows = documents.select(*numbered(kept), F.col(text_col).alias("text"))
        shared = documents.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, model = WordHashes(), shared.value
            for batch in batches:
                found = [slots(t.as_py(), words, model.repeats) for t in batch.column(len(kept))]
                score = pa.array(model.probability(model.margins(found)), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*kept, score_col])

        return rows.mapInArrow(run, StructType([*fields(documents, kept), StructField(score_col, DoubleType())]))


def featured(repeats: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found = [slots(t.as_py(), words, repeats).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "y", "slots"])

    return run


def fit_arrays(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0, cost: float = 4.0, epochs: int = 40, tolerance: float = 1e-2) -> QualityModel:
    """The model of labelled slot rows (y is 1 or 0), with a curve from cross-validation."""
    size = 1 << BITS
    flat = QualityModel(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    if min(y.sum(), (1 - y).sum()) < 2:
        return flat

    def fitted(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        some = [rows[i] for i in which]
        label = y[which]
        count = [np.bincount(np.concatenate([r for r, l in zip(some, label, strict=True) if l == c] or [np.empty(0, np.uint32)]), minlength=size) + smoothing for c in (0, 1)]
        n0, n1 = (label == 0).sum() + 2 * smoothing, (label == 1).sum() + 2 * smoothing
        ratio = np.log(count[1] / n1) - np.log(count[0] / n0)
        ratio[(count[0] + count[1]) == 2 * smoothing] = 0.0  # never seen: says nothing
        # frequent slots side by side: the fit's lookups then stay in the processor's cache
        rank = np.empty(size, np.int32)
        rank[np.argsort(-(count[0] + count[1]), kind="stable")] = np.arange(size, dtype=np.int32)
        values = []
        for r in some:
            v = ratio[r]
            length = np.sqrt(v @ v)
            values.append((v / length if length else v).astype(np.float32))
        share = label.mean()
        weights = cost * np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
        w, b = dual_coordinate_descent([rank[r] for r in some], values, np.where(label == 1, 1.0, -1.0), weights, size, epochs, tolerance * cost)
        return ratio, w[rank], b

    def model_of(which: np.ndarray) -> QualityModel:
        ratio, w, b = fitted(which)
        return QualityModel(ratio.astype(np.float32), (w * ratio).astype(np.float32), b, 1.0, 0.0)

    # the curve is laid through margins of models that haven't seen the row
    fold = np.empty(len(rows), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    margins = np.empty(len(rows))
    for k in range(FOLDS):
        held = np.flatnonzero(fold == k)
        if len(held):
            margins[held] = model_of(np.flatnonzero(fold != k)).margins([rows[i] for i in held])
    model = model_of(np.arange(len(rows)))
    model.slope, model.shift = logistic(margins, np.where(y == 1, 1.0, -1.0))
    return model


def fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (id, y, slots) rows to one row, the model."""
    ids, label, rows = [], [], []
    for batch in batches:
        ids.extend(batch.column(0).to_pylist())
        label.extend(batch.column(1).to_pylist())
        rows.extend(np.frombuffer(r, np.uint32) for r in batch.column(2).to_pylist())
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    order = order[np.random.default_rng(1).permutation(len(order))]
    model = fit_arrays([rows[i] for i in order], np.array(label, np.int64)[order])
    values = [[packed(model.ratio)], [packed(model.weight)], [model.offset], [model.slope], [model.shift]]
    types = [pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["ratio", "weight", "offset", "slope", "shift"])


def fit(documents: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6_000, repeats: bool = True) -> QualityModel:
    """Learn from the labelled rows that ``training``, a condition on the id, admits."""
    known = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # at most max_rows ids: small enough for every executor
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # a text for each, so at most max_rows for the task that fits
    one = texts.groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.select(F.xxhash64("id").alias("id"), "y", "text").mapInArrow(featured(repeats), "id long, y int, slots binary")
    # as Arrow: rows for Python would be copied several times in the driver's JVM
    found = rows.repartition(1).mapInArrow(fitter, "ratio binary, weight binary, offset double, slope double, shift double").toArrow().to_pylist()
    if not found:
        return fit_arrays([], np.empty(0, np.int64))
    tables = {name: unpacked(found[0].pop(name)) for name in ("ratio", "weight")}
    return QualityModel(**tables, **found[0], repeats=repeats)


def not_held_out(id_col: str = "doc_id") -> Column:
    """The rows to learn from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def predicted(score: Column, threshold: float = 0.3) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)
