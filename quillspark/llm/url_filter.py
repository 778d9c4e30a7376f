"""URL rules in a sorted digest array.

A rule is a verdict with a host and a path.  It fits its host and all subdomains if the url's
path starts with the rule's path; the longest fitting rule string (host + path) wins, of equally long ones
that with the longer host.  Without a fitting rule the verdict is ``default``.

The rules become files of sorted 64-bit xxhash keys with the full strings behind them, at most
``shard_bytes`` each, in the shared scratch folder, which Spark hands to every executor (``addFile``; a lost executor's successor fetches
them again; equal rules are the same files).  Workers memory-map the files, so a worker's own memory doesn't grow with the rules, probe whole batches
with a vectorised binary search, and compare the stored string of every hit, so that a collision of keys changes nothing.

Which strings of a url are looked up: host suffixes of as many labels as some rule's host has, and, where a
suffix is a rule's host, with it the path prefixes of as many characters as some rule's path has.

Defined cases
    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: what then follows up to ``?``, ``#``
    or the end.  Null urls and those without ``://`` have an empty host and path, which no rule fits.  Of a rule given twice the later
    verdict counts.  Repeated rows get a row each; null ids stay null; an empty table or no rules are fine.  A column of the input named like
    a result column, in any case of letters, gives way to it; others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.scratch import scratch_dir
from .names import apart, fields, numbered

HOST_PATH = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RESULT = ["host", "path", "rule", "verdict"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestFile:
    """Strings with a small number each: count, keys, offsets and numbers, then the strings."""

    @staticmethod
    def content(entries: list[tuple[str, int]]) -> bytes:
        rows = sorted((key_of(text), text.encode("utf-8", "surrogatepass"), number) for text, number in entries)
        offsets = np.r_[0, np.cumsum([len(r[1]) for r in rows])].astype("<u8")
        head = [np.array(x, "<u8").tobytes() for x in ([len(rows)], [r[0] for r in rows], offsets, [r[2] for r in rows])]
        return b"".join([*head, *(r[1] for r in rows)])

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<u8", 1)[0])
        at = lambda k, size: np.memmap(path, "<u8", "r", 8 * k, (size,)) if size else np.empty(0, "<u8")
        self.n = n
        self.keys, self.offsets, self.numbers = at(1, n), at(1 + n, n + 1), at(2 + 2 * n, n)
        self.strings = np.memmap(path, np.uint8, "r", 8 * (2 + 3 * n)) if n and self.offsets[n] else np.empty(0, np.uint8)

    def find(self, texts: list[str]) -> np.ndarray:
        """The number of each text, -1 for those not stored."""
        out = np.full(len(texts), -1, np.int64)
        if not self.n or not texts:
            return out
        probe = np.fromiter(map(key_of, texts), np.uint64, len(texts))
        place = np.searchsorted(self.keys, probe)
        open_ = np.flatnonzero((place < self.n) & (self.keys[np.minimum(place, self.n - 1)] == probe))
        while len(open_):  # equal keys lie side by side: go on until the string itself is found
            for k in open_:
                a, b = int(self.offsets[place[k]]), int(self.offsets[place[k] + 1])
                if self.strings[a:b].tobytes() == texts[k].encode("utf-8", "surrogatepass"):
                    out[k] = int(self.numbers[place[k]])
            open_ = open_[out[open_] < 0]
            place[open_] += 1
            open_ = open_[(place[open_] < self.n) & (self.keys[np.minimum(place[open_], self.n - 1)] == probe[open_])]
        return out


def share(spark: SparkSession, content: bytes) -> str:
    """The name under which every executor finds a file of this content.  It lies in the shared scratch folder; equal contents are one file."""
    name = f"url-rules-{xxhash.xxh3_128_hexdigest(content)}"
    if not any(known.endswith("/" + name) for known in spark.sparkContext.listFiles):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return name


@dataclass
class UrlRules:
    """What goes to the executors: names of the shared files, and which lengths occur in the rules."""

    hosts: list[str]
    rules: list[str]
    verdicts: list[str]
    labels: list[int]
    path_lengths: list[int]

    @staticmethod
    def build(spark: SparkSession, rules: Iterable[Rule], shard_bytes: int = 64 << 20) -> UrlRules:
        latest = {r.host.translate(LOWER) + r.path: (r.verdict, r.host.translate(LOWER), r.path) for r in rules if r.host}
        verdicts = sorted({v for v, _, _ in latest.values()})
        def shards(entries: list[tuple[str, int]]) -> list[str]:
            names, part, held = [], [], 0
            for k, entry in enumerate(entries):
                part.append(entry)
                held += 24 + 4 * len(entry[0])
                if held >= shard_bytes or k == len(entries) - 1:
                    names.append(share(spark, DigestFile.content(part)))
                    part, held = [], 0
            return names

        hosts = sorted({h for _, h, _ in latest.values()})
        return UrlRules(
            shards([(h, 0) for h in hosts]),
            shards([(text, verdicts.index(v)) for text, (v, _, _) in sorted(latest.items())]),
            verdicts, sorted({h.count(".") + 1 for h in hosts}), sorted({len(p) for _, _, p in latest.values()}, reverse=True),
        )

    def open(self) -> tuple[Callable, Callable]:
        """Look-ups over all shards of the hosts and of the rules."""

        def over(names: list[str]) -> Callable:
            files = [DigestFile(SparkFiles.get(n)) for n in names]

            def find(texts: list[str]) -> np.ndarray:
                out = np.full(len(texts), -1, np.int64)
                for f in files:
                    out = np.maximum(out, f.find(texts))
                return out

            return find

        return over(self.hosts), over(self.rules)


def host_path(url: str | None) -> tuple[str, str]:
    found = HOST_PATH.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def judge(pairs: list[tuple[str, str]], rules: UrlRules, find_host: Callable, find_rule: Callable, default: str) -> tuple[list, list]:
    """The winning rule string (or None) and the verdict for each (host, path)."""
    suffixes, owner = [], []
    for k, (host, _) in enumerate(pairs):
        if not host:
            continue
        # with n labels in the host, a suffix of m labels starts behind the (n - m)th dot
        most = rules.labels[-1] if rules.labels else 0
        tail = host.rsplit(".", most)
        for m in rules.labels:
            if m < len(tail) or m == len(tail) == host.count(".") + 1:
                suffixes.append(".".join(tail[len(tail) - m :]))
                owner.append(k)
    known = find_host(suffixes) >= 0
    texts, whose = [], []
    for k, suffix, hit in zip(owner, suffixes, known, strict=True):
        if hit:
            path = pairs[k][1]
            for n in rules.path_lengths:
                if n <= len(path):
                    texts.append(suffix + path[:n])
                    whose.append((k, len(suffix)))
    best: dict[int, tuple] = {}
    for (k, host_length), text, number in zip(whose, texts, find_rule(texts).tolist(), strict=True):
        if number >= 0 and (k not in best or (len(text), host_length) > best[k][:2]):
            best[k] = (len(text), host_length, text, rules.verdicts[number])
    chosen = [best.get(k) for k in range(len(pairs))]
    return [c and c[2] for c in chosen], [c[3] if c else default for c in chosen]


def judge_urls(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", keep: list[str] | None = None, default: str = "allow", shard_bytes: int = 64 << 20) -> DataFrame:
    """The columns ``keep`` (all, if None) and host, path, rule, verdict for every row."""
    index = UrlRules.build(pages.sparkSession, rules, shard_bytes)
    kept = [c for c in apart(pages.columns, RESULT) if keep is None or c in keep]
    rows = pages.select(*numbered(kept), F.col(url_col).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find_host, find_rule = index.open()
        for batch in batches:
            pairs = [host_path(u) for u in batch.column(len(kept)).to_pylist()]
            rule, verdict = judge(pairs, index, find_host, find_rule, default)
            columns = [[h for h, _ in pairs], [p for _, p in pairs], rule, verdict]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in columns)], names=[*kept, *RESULT])

    return rows.mapInArrow(run, StructType([*fields(pages, kept), *(StructField(c, StringType()) for c in RESULT)]))
