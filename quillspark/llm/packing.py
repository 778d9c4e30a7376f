"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep the order in which the table holds them.  Each input partition is one
stream: its documents' ids, each with an end id, one after the other.  Windows of at most
``length`` ids are cut at document ends, at sentence ends (a small truncation penalty) or,
where no such place comes for ``grid`` ids, inside a sentence (a larger penalty).  The cost of a
window is its padding plus the penalty of the cut behind it, so with p the places of the cuts

    best[i] = penalty[i] + length - p[i] + min over p[i] - p[j] <= length of (best[j] + p[j])

and the minimum slides with i: a monotone queue gives every transition in constant time.
The stream goes through in stretches of ``stretch`` windows; the last ``CARRIED`` windows of a stretch are
decided again with the next, so memory is bounded by a stretch and one document.  The last window of
a partition, if padding costs more than penalties would, is cut into powers of two, which need no padding.

The result is a function of the partition's rows alone, so a lost task gives the same rows again;
window ids hold the partition number in their upper bits.

Defined cases
    Null and empty texts consist of the end id.  Repeated rows and ids are packed each; a null id stays null.
    An empty table gives an empty result.  Texts are encoded whole; a document longer than a window continues in the next.
    Further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CARRIED = 4
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# The splitting pattern and the printable stand-ins of bytes that public byte-level BPE files use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(maxsize=2)
def byte_bpe(source: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a byte-level BPE file in the JSON form of the ``tokenizers`` library, and
    which ids end a sentence.  Such a file merges in the order of its ids, which is checked, so that
    tiktoken gives the same ids several times faster.  The file's added tokens are the encoder's special tokens."""
    file = json.loads(source)
    splitter = {**(file.get("pre_tokenizer") or {}), "trim_offsets": None}
    if splitter != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True} or file.get("normalizer"):
        raise ValueError("this file splits or changes texts in another way than byte-level BPE with the usual pattern")
    if file["model"].get("type", "BPE") != "BPE" or any(file["model"].get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("this file's model is not plain byte-level BPE")
    model, added = file["model"], {t["content"]: t["id"] for t in file.get("added_tokens") or []}
    if any(t.get(flag) for t in file.get("added_tokens") or [] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("this file's added tokens depend on the text around them")
    if any(a != b and b in a for a in added for b in added):
        raise ValueError("one of this file's added tokens holds another")
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    raw = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(other)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in merges]
    if merged != sorted(merged):
        raise ValueError("this file's merges are not in the order of its ids")
    usable = {*merged, *(model["vocab"][c] for c in raw)}
    ranks = {bytes(raw[c] for c in token): i for token, i in model["vocab"].items() if i in usable}
    ends = np.zeros(max(ranks.values()) + 1, bool)
    for token, i in ranks.items():
        ends[i] = any(c in token for c in (b".", b"!", b"?", b"\n")) or token in ("。".encode(), "！".encode(), "？".encode())
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added), ends


def cheapest_cuts(places: list[int], penalty: list[int], length: int) -> list[int]:
    """Indices of the chosen cuts from the first place to the last; neighbours are at most ``length`` apart."""
    n = len(places)
    reach, back = [0] * n, [0] * n  # reach: best + place
    queue, head = [0] * n, 0
    tail = 1
    reach[0] = places[0]
    for i in range(1, n):
        low = places[i] - length
        while places[queue[head]] < low:
            head += 1
        j = queue[head]
        back[i] = j
        value = reach[j] + length + penalty[i]
        reach[i] = value
        while tail > head and reach[queue[tail - 1]] >= value:
            tail -= 1
        queue[tail] = i
        tail += 1
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Stream:
    """One partition's ids; ``add`` documents, take finished pieces from ``pieces``."""

    def __init__(self, ends: np.ndarray, end_id: int, length: int, sentence: int, inside: int, grid: int, stretch: int, first_id: int):
        self.ends, self.end_id, self.length, self.sentence, self.inside, self.grid = ends, end_id, length, sentence, inside, min(grid, length)
        self.room, self.next_id = stretch * length, first_id
        self.docs: list[tuple] = []  # (doc_id, ids, how many of them went out already)
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        ids = np.append(ids, np.uint32(self.end_id)).astype("<u4")
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)
        if self.size >= self.room:
            yield from self.pieces(final=False)

    def places(self, starts: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = np.flatnonzero(self.ends[np.minimum(stream, len(self.ends) - 1)] & (stream < len(self.ends))) + 1
        document = np.append(starts[1:], len(stream))
        places = np.union1d(np.append(stop, 0), document)
        gap = np.diff(places)
        wide = np.flatnonzero(gap > self.grid)
        if len(wide):
            places = np.union1d(places, np.concatenate([np.arange(places[k] + self.grid, places[k + 1], self.grid) for k in wide]))
        penalty = np.full(len(places), self.inside)
        penalty[np.searchsorted(places, stop)] = self.sentence
        penalty[np.searchsorted(places, document)] = 0
        return places, penalty

    def pieces(self, final: bool) -> Iterator[tuple]:
        """Windows of what is held, all of them if ``final``."""
        if not self.docs:
            return
        stream = np.concatenate([ids[gone:] for _, ids, gone in self.docs])
        starts = np.r_[0, np.cumsum([len(ids) - gone for _, ids, gone in self.docs])][:-1]
        places, penalty = self.places(starts, stream)
        cuts = places[cheapest_cuts(places.tolist(), penalty.tolist(), self.length)]
        if not final:
            cuts = cuts[: -CARRIED]
            if len(cuts) < 2:
                return
        elif self.length - (short := int(cuts[-1] - cuts[-2])) > self.inside * (len(powers(short)) - 1):
            cuts = np.r_[cuts[:-1], cuts[-2] + np.cumsum(powers(short))]
        limit = int(cuts[-1])
        edges = np.union1d(cuts, starts[starts < limit])
        which, window = np.searchsorted(starts, edges[:-1], "right") - 1, np.searchsorted(cuts, edges[:-1], "right") - 1
        raw = memoryview(stream.view(np.uint8))
        for k, a, b, w in zip(which.tolist(), edges[:-1].tolist(), edges[1:].tolist(), window.tolist(), strict=True):
            doc_id, ids, gone = self.docs[k]
            yield doc_id, a - int(starts[k]) + gone, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(ids), self.next_id + w, a - int(cuts[w])
        self.next_id += len(cuts) - 1
        last = int(np.searchsorted(starts, limit, "right")) - 1
        doc_id, ids, gone = self.docs[last]
        rest = [(doc_id, ids, gone + limit - int(starts[last]))] + self.docs[last + 1 :]
        self.docs = [d for d in rest if d[2] < len(d[1])]
        self.size = sum(len(ids) - gone for _, ids, gone in self.docs)


def packer(source, end_id: int, length: int, sentence: int, inside: int, grid: int, stretch: int) -> Callable:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = byte_bpe(source.value)
        context = TaskContext.get()
        stream = Stream(ends, end_id, length, sentence, inside, grid, stretch, (context.partitionId() if context else 0) << 40)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(stream.add(doc, encoder.encode_to_numpy(text.as_py() or "", allowed_special="all")))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        rows.extend(stream.pieces(final=True))
        if rows:
            yield batch_of(rows)

    return run


def pack(
    documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1,
    sentence: int = 4, inside: int = 16, grid: int = 32, stretch: int = 256,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; the file (a few MB) goes to the executors.
    Where a text holds one of the file's added tokens, that token's id stands, as ``tokenizers`` has it by default.
    """
    source = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packer(source, end_id, length, sentence, inside, grid, stretch), SCHEMA)
