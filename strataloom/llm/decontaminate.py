"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import sliced, table

#: Tokens that a tile has at least, and the share of a benchmark text's tokens that tiles must cover to call a document contaminated.
MIN_MATCH, COVERAGE = 5, 0.6
#: Characters of benchmark text that one pass over the documents carries along; larger benchmarks take more passes.
BLOCK_CHARS = 4_000_000
#: Seed pairs up to which a document and a text are tiled from all their maximal matches at once.
SEED_PAIRS = 2_000_000
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _WORD.findall((text or "").lower())


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin values of all runs of length ids, by doubling: O(n log length) time, O(n) memory."""
    power, value, have = ids.astype(np.uint64) + np.uint64(1), np.zeros(len(ids) - length + 1, np.uint64), 0
    base = np.full(1, 0xD6E8FEB86659FD93, np.uint64)
    step = 1
    while length:  # power[i] is the value of the run of step ids from i, base = B ** step
        if length & 1:
            shift = power[have : have + len(value)]
            value = value * base + shift
            have += step
        length >>= 1
        if length:
            power = power[:-step] * base + power[step:]
            base = base * base
            step *= 2
    return value


def _matches(a: np.ndarray, b: np.ndarray, length: int, free_a: np.ndarray, free_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, run of b's positions that are equal, as order slices): unmarked runs of length of a that occur unmarked in b."""
    if min(len(a), len(b)) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_a = np.flatnonzero(np.convolve(~free_a, np.ones(length, np.int64), "valid") == 0)
    cum = np.concatenate([[0], np.cumsum(~free_b)])
    open_b = np.flatnonzero(cum[length:] == cum[:-length])
    ha, hb = rolled(a, length)[open_a], rolled(b, length)[open_b]
    hit = np.isin(ha, hb)
    return open_a[hit], open_b[np.isin(hb, ha[hit])]


def _tiles_by_length(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles in O(len(a) + len(b)) memory: the longest length with an unmarked match is searched, all its matches are marked, again."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out, high = [], min(len(a), len(b))
    while high >= least:
        low, top = least - 1, high
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if len(_matches(a, b, mid, free_a, free_b)[0]) else (low, mid - 1)
        if low < least:
            break
        at_a, at_b = _matches(a, b, low, free_a, free_b)
        values = rolled(b, low)
        where: dict[int, list[int]] = {}
        for j in at_b[::-1].tolist():
            where.setdefault(int(values[j]), []).append(j)
        keys = rolled(a, low)
        for i in at_a.tolist():
            if not free_a[i : i + low].all():
                continue
            stack = where.get(int(keys[i]), [])
            while stack:
                j = stack.pop()
                if free_b[j : j + low].all() and (a[i : i + low] == b[j : j + low]).all():
                    free_a[i : i + low] = free_b[j : j + low] = False
                    out.append((i, j, low))
                    break
        high = low if len(_matches(a, b, low, free_a, free_b)[0]) and len(out) else low - 1
    return out


def tiles(a: np.ndarray, b: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token ids: (start in a, start in b, length), longest first, none overlapping, each of least tokens.

    Of equal lengths the one that starts first in a, then in b, is marked first. Negative ids of b match nothing.
    """
    if min(len(a), len(b)) < least:
        return []
    ha, hb = rolled(a, least), rolled(b, least)
    order = np.argsort(ha, kind="stable")
    left, right = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    counts = right - left
    if counts.sum() > SEED_PAIRS:
        return _tiles_by_length(a, b, least)
    j = np.repeat(np.arange(len(hb)), counts)
    i = order[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(left, counts)]
    same = np.ones(len(i), bool)
    for k in range(least):
        same &= a[i + k] == b[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        return []
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    heap = [(-(e - s + least - 1), int(i[s]), int(j[s])) for s, e in zip([0, *breaks], [*breaks, len(i)], strict=True)]
    heapq.heapify(heap)
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    while heap:
        length, x, y = heapq.heappop(heap)
        length = -length
        free = free_a[x : x + length] & free_b[y : y + length]
        if free.all():
            free_a[x : x + length] = free_b[y : y + length] = False
            out.append((x, y, length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for s, e in edges.reshape(-1, 2).tolist():
            if e - s >= least:
                heapq.heappush(heap, (-(e - s), x + s, y + s))
    return out


class Index:
    """A block of benchmark texts: token ids, and the seeds of least tokens that lead to a text."""

    def __init__(self, items: list[tuple[int, str]], least: int, coverage: float) -> None:
        self.least, self.coverage = least, coverage
        self.ids: dict[str, int] = {}
        self.items = []
        seeds, owners = [], []
        for item, text in items:
            a = np.array([self.ids.setdefault(t, len(self.ids)) for t in tokens(text)], np.int64)
            least_here = min(least, len(a))  # a shorter text must occur whole
            if not len(a):
                continue
            self.items.append((item, a, least_here))
            seeds.append(rolled(a, least_here))
            owners.append(np.full(len(seeds[-1]), len(self.items) - 1))
        self.lengths = sorted({x[2] for x in self.items})
        self.seeds = {}
        for n in self.lengths:
            at = [k for k, x in enumerate(self.items) if x[2] == n]
            s, o = np.concatenate([seeds[k] for k in at]), np.concatenate([owners[k] for k in at])
            order = np.argsort(s, kind="stable")
            self.seeds[n] = (s[order], o[order])

    def best(self, text: str | None) -> tuple[int | None, float, int]:
        """(the text most covered by tiles, its coverage, how many texts reach the threshold)."""
        get = self.ids.get
        b = np.array([get(t, -1) for t in tokens(text)], np.int64)
        if not len(b):
            return None, 0.0, 0
        found: set[int] = set()
        for n, (seeds, owners) in self.seeds.items():
            if len(b) < n:
                continue
            bad = np.concatenate([[0], np.cumsum(b < 0)])
            whole = np.flatnonzero(bad[n:] == bad[:-n])
            if not len(whole):
                continue
            values = np.unique(rolled(b, n)[whole])
            left, right = np.searchsorted(seeds, values, "left"), np.searchsorted(seeds, values, "right")
            for x, y in zip(left[right > left].tolist(), right[right > left].tolist(), strict=True):
                found.update(owners[x:y].tolist())
        best, reached = (None, 0.0), 0
        for k in sorted(found, key=lambda k: self.items[k][0]):
            item, a, least = self.items[k]
            covered = sum(t[2] for t in tiles(a, b, least)) / len(a)
            reached += covered >= self.coverage
            if covered > best[1]:
                best = (item, covered)
        return *best, reached


def _blocks(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's texts in blocks of about chars characters, one block in the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    block, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(documents: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents with item_id, coverage, n_items and contaminated; the columns named alike before are replaced.

    item_id: the benchmark text (least id of equals) whose tokens greedy string tiling covers most, null
    if none shares a seed of least tokens; coverage: that share, 0 to 1; n_items: texts covered to the
    threshold; contaminated: n_items > 0. Tiles may come in any order, so reordered passages count.
    Benchmark texts of fewer tokens must occur whole; those without tokens or with a null match nothing.
    Null text is empty. Nothing is shuffled: documents stream past the benchmark, a block of bounded
    size at a time, whose seeds are looked up in a sorted table.
    """
    documents = documents.drop("item_id", "coverage", "n_items", "contaminated")
    spark, names = documents.sparkSession, documents.columns
    at, state = names.index("text"), ["item_id", "coverage", "n_items"]
    schema = T.StructType([*documents.schema.fields, T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_items", T.LongType())])
    out = documents.select("*", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_items"))
    for block in _blocks(benchmark, block_chars):
        index = spark.sparkContext.broadcast(Index(block, least, coverage))

        def run(batches, index=index):
            for batch in sliced(batches):
                found = [index.value.best(t) for t in batch.column(at).to_pylist()]
                n = len(names)
                old = list(zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True))
                new = [(o[0] if o[1] >= f[1] else f[0], max(o[1], f[1]), o[2] + f[2]) for o, f in zip(old, found, strict=True)]
                kinds = (pa.int64(), pa.float64(), pa.int64())
                extra = [pa.array([x[k] for x in new], kinds[k]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *extra], [*names, *state])

        out = out.mapInArrow(run, schema)
    return out.withColumn("contaminated", F.col("n_items") > 0)


def decontaminated(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """documents without the contaminated ones; its columns."""
    return contamination(documents, benchmark, **settings).where("NOT contaminated").select(*documents.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_items", "contaminated")
