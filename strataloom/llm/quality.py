"""Quality scores: random Fourier features of document statistics, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table, written

#: Random features, width of the Gaussian kernel in standard deviations a statistic, and ridge weight a row.
FEATURES, WIDTH, RIDGE = 256, 4.0, 1e-4
#: Bins of raw scores that isotonic calibration pools.
BINS = 1_000
#: Partial sums that one task adds up.
FAN_IN = 32
#: Score from which a document is predicted good.
GOOD = 0.7
STATS = 16
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_MARKS = np.array([*b"#$%&*+=<>@[]^_{}~\\/"])
_PLAIN = np.array([*b".,;:'\"()-?"])


def statistics(text: str | None) -> list[float]:
    """STATS numbers of a text's form: none of them depends on its language's words or on its length alone but the first two."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words = text.split()
    lines = text.split("\n")
    m, upper, lower = max(1, len(words)), float(c[_UPPER].sum()), float(c[_LOWER].sum())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    mean = float(lengths.sum()) / m
    alone = sum(1 for w in words if w == "|") / m
    repeats = sum(a == b for a, b in zip(words, words[1:])) / m
    return [
        np.log1p(len(words)),
        np.log1p(len(data)) / 4,
        mean / 4,
        float(lengths.std()) / 4 if words else 0.0,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        min(1.0, len(lines) / m),
        upper / max(1e-9, upper + lower),
        np.sqrt(float(c[_MARKS].sum())),
        np.sqrt(float(c[33])),
        np.sqrt(float(c[124])),
        np.sqrt(float(c[_DIGIT].sum())),
        np.sqrt(float(c[_PLAIN].sum())),
        float(c[128:].sum()),
        np.sqrt(alone),
        np.sqrt(repeats),
    ]


def _statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], np.float64).reshape(-1, STATS)


@dataclass
class Model:
    """A score from statistics; a few hundred kB, whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots_x: np.ndarray
    knots_y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        out = np.empty((len(stats), FEATURES + 1))
        out[:, :FEATURES] = np.sqrt(2.0 / FEATURES) * np.cos(z @ self.weights + self.phase)
        out[:, FEATURES] = 1
        return out

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots_x, self.knots_y)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y by weighted squares (pool adjacent violators); x ascending."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else y


def levels(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic levels of bins of n rows, with one row more of half either class, spread over all bins: it keeps sparse ends from extremes."""
    part = 1 / len(x)
    return isotonic(x, (y * n + 0.5 * part) / (n + part), n + part)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sums(model: Model):
    """One row a partition: its sums of x x' (upper triangle) and x y, with a key that FAN_IN partitions share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = FEATURES + 1
        gram, moment, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                x = model.features(_matrix(batch.column(0)))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                gram += x.T @ x
                moment += x.T @ y
                n += len(y)
        if n:
            flat = np.concatenate([gram[np.triu_indices(size)], moment, [n]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN]), pa.array([flat.tobytes()], pa.binary())], ["k", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, key = None, None
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total = np.frombuffer(b) + (0 if total is None else total)
            key = k // FAN_IN
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["k", "sums"])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)


def fit(documents: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """A model from labels(doc_id, quality) of documents that are not held out: three in four of all labelled ones, no sample.

    Rows whose crc32(doc_id) mod 4 is 0 or 1 give the ridge, those of 3 its calibration. A doc_id with
    several labels counts with each; null labels or ids are left out. Statistics are standardised by
    their mean and deviation. Normal equations are summed by partition, then FAN_IN at a time, so the
    driver receives at most FAN_IN sums of (FEATURES + 1)**2 / 2 numbers. No usable label: every score is 0.5.
    """
    spark = documents.sparkSession
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"), part.alias("part")).where("y IS NOT NULL AND part <> 2")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            stats = _statistics_of(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * STATS), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "stats"])

    wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(part != 2)
    stats = written(wanted.mapInArrow(described, "doc_id long, stats array<double>").join(known, "doc_id").select("stats", "y", "part"), "stats")
    moments = stats.agg(*(f(F.get("stats", F.lit(k))).alias(f"{n}{k}") for k in range(STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if moments["m0"] is None:
        return Model(np.zeros(STATS), np.ones(STATS), np.zeros((STATS, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    rng = np.random.default_rng(seed)
    scale = np.array([max(moments[f"s{k}"], 1e-3) for k in range(STATS)])
    model = Model(np.array([moments[f"m{k}"] for k in range(STATS)]), scale, rng.normal(size=(STATS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))

    sums = written(stats.where("part < 2").select("stats", "y").mapInArrow(_sums(model), "k long, sums binary"), "sums")
    while (rows := sums.count()) > FAN_IN:
        sums = written(sums.repartition(-(-rows // FAN_IN), "k").sortWithinPartitions("k").mapInArrow(_added, "k long, sums binary"), "sums")
    total = sum((np.frombuffer(r["sums"]) for r in sums.orderBy("k").collect()), np.zeros(1))
    if total.size == 1:
        return model
    size = FEATURES + 1
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = total[: size * (size + 1) // 2]
    gram = np.triu(gram) + np.triu(gram, 1).T
    n = total[-1]
    penalty = np.full(size, RIDGE * n)
    penalty[-1] = 1e-9 * n
    model.beta = np.linalg.solve(gram + np.diag(penalty), total[-1 - size : -1])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column(1)], ["bin", "raw", "y"])

    binned = stats.where("part = 3").select("stats", "y").mapInArrow(scored, "bin long, raw double, y double")
    pooled = binned.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS rows at most
    if pooled:
        x, y, w = (np.array([float(r[k]) for r in pooled]) for k in ("x", "y", "n"))
        order = np.argsort(x, kind="stable")
        x, y, w = x[order], y[order], w[order]
        level = levels(x, y, w)
        slope = (x - x[0]) / max(x[-1] - x[0], 1e-9)  # a thousandth keeps the raw order within a level
        model.knots_x, model.knots_y = x, np.clip(0.999 * level + 0.001 * slope, 0, 1)
    else:
        model.knots_x, model.knots_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, repeated ones too; null text is empty, null doc_id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_statistics_of(batch.column(1))))], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Model, least: float = GOOD) -> DataFrame:
    """documents that score least or more, all columns; texts stream past the model and are not shuffled."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(model.score(_statistics_of(batch.column(at))) >= least))

    return documents.mapInArrow(run, documents.schema)


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scores(documents, fit(documents, table(spark, sf_dir, "labels")))
