"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_name, table, written
from .shingles import word_counts

#: Weights that sources take in turn, in order of their names' code points, a null source last.
WEIGHTS = (5, 2, 1)
#: A target is at most this many times its source's size, and so is a document's part of the mix.
MOST = 3
#: Rows that a block of the flight phase holds, about, and units of each source that are kept for the landing.
BLOCK_ROWS, LANDING = 1_000, 15
_TOLERANCE = 1e-9


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, source, text, h = batch.columns
        yield pa.RecordBatch.from_arrays([doc_id, source, pa.array(word_counts(text)), h], ["doc_id", "source", "size", "h"])


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and h, a hash of the row, for each row; size counts runs of other characters than white space.

    Counted over Arrow's buffers: a pattern in the JVM makes a string a word, and its heap grows to its limit on them.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "source", "text").alias("h"))
    return rows.mapInArrow(_sizes, f"doc_id long, source {dict(rows.dtypes)['source']}, size long, h long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, n, source_size, target: shares of the sum of all sizes by weight, none above MOST times its source's size.

    What a source cannot take is shared again by weight among the others until none is above. Ranks
    come from a range partitioning with offsets a partition, and the driver sees sums alone, so the
    number of sources is free.
    """
    groups = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ordered = groups.repartitionByRange(F.asc_nulls_last("source")).withColumn("p", F.spark_partition_id())
    ordered = written(ordered, "sources")
    counts = ordered.groupBy("p").agg(F.count("*").alias("c"))  # a row a partition
    offsets = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    choice = F.lit(list(weights))
    known = ordered.join(F.broadcast(offsets), "p").withColumn("w", F.get(choice, F.pmod(rank, F.lit(len(weights))).cast("int")).cast("double"))
    known = written(known.select("source", "n", "source_size", "w"), "sources")
    ceiling = MOST * F.col("source_size").cast("double")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each turn caps one source more at least
        full = ceiling < F.col("w") * F.lit(level) if capped >= 0 else F.lit(False)
        state = known.agg(F.sum(F.when(full, ceiling).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"), F.count_if(full).alias("capped")).first()
        if state["capped"] == capped or not state["open"]:
            break
        capped, level = state["capped"], (total - state["taken"]) / state["open"]
    return known.select("source", "n", "source_size", F.least(ceiling, F.col("w") * F.lit(level)).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Moves inclusion probabilities until at most two are fractional, keeping sums of pi * size and of pi.

    Three fractional units have a direction in the null space of the two constraints, the cross product
    of (1, 1, 1) and their sizes; a step along it to the cube's side settles one of them. The side is
    drawn by a generator seeded by the data, in proportion that keeps each expectation.
    """
    out = pi.tolist()
    sizes = (size / max(1.0, float(size.max(initial=0)))).tolist()
    rng = np.random.default_rng(int(size.sum()) % (1 << 32) + len(out))
    draws = iter(rng.random(2 * len(out) + 8).tolist())
    todo = [k for k in range(len(out)) if _TOLERANCE < out[k] < 1 - _TOLERANCE]
    todo.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) == 3:
            a, b, c = (sizes[k] for k in active)
            u = [c - b, a - c, b - a]
            if max(map(abs, u)) < 1e-12:
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and abs(sizes[active[0]] - sizes[active[1]]) < 1e-12:
            u = [1.0, -1.0]
        else:
            break
        p = [out[k] for k in active]
        up = min(((1 - x) / v if v > 0 else -x / v) for x, v in zip(p, u, strict=True) if abs(v) > 1e-15)
        down = min((x / v if v > 0 else (x - 1) / v) for x, v in zip(p, u, strict=True) if abs(v) > 1e-15)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        keep = []
        for k, x, v in zip(active, p, u, strict=True):
            x += step * v
            x = 0.0 if x < _TOLERANCE else 1.0 if x > 1 - _TOLERANCE else x
            out[k] = x
            if 0.0 < x < 1.0:
                keep.append(k)
        active = keep
    return np.array(out)


def landing(pi: np.ndarray, size: np.ndarray, owed: float) -> np.ndarray:
    """0 or 1 for each of a few units: of all choices the one whose size comes nearest to owed, of equals nearest in number."""
    free = np.flatnonzero((pi > 0) & (pi < 1))
    out = (pi >= 1).astype(float)
    if len(free):
        bits = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
        miss = np.abs(bits @ size[free].astype(float) - (owed - float(size[pi >= 1].sum())))
        count = np.abs(bits.sum(1) - pi[free].sum())
        out[free] = bits[np.lexsort((count, np.round(miss, 6)))[0]]
    return out


_STATE = "source string, b long, k int, doc_id long, size long, source_size long, target double, h long, r long, whole long, pi double, spare boolean"


def _flights(last: bool):
    """A block at a time, rows sorted by h: the flight; where the source has no other block, the landing too."""

    def block(rows: list[tuple]) -> list[tuple]:
        size = np.array([r[4] for r in rows])
        pi = np.array([r[10] for r in rows])
        spare = np.array([r[11] for r in rows])
        if not last and rows[0][1] == 0 and not spare.any():
            open_ = np.flatnonzero((pi > 0) & (pi < 1) & (size > 0))
            order = open_[np.argsort(size[open_], kind="stable")]
            spare[order[np.unique(np.linspace(0, max(0, int(0.97 * len(order)) - 1), min(LANDING, len(order))).astype(int))]] = len(order) > 3
        free = ~spare
        pi[free] = flight(pi[free], size[free])
        return [(*r[:10], float(p), bool(s)) for r, p, s in zip(rows, pi, spare, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, names, schema = None, [], None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block(rows), strict=True), schema, strict=True)], names)

        for batch in batches:
            names, schema = batch.schema.names, batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[0], row[1]) != key:
                    if rows:
                        yield done()
                    key, rows = (row[0], row[1]), []
                rows.append(row)
        if rows:
            yield done()

    return run


def _landings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open units of a source, a few: settled. Column owed: words still due to the source."""
    key, rows, schema = None, [], None

    def done() -> pa.RecordBatch:
        pi = landing(np.array([r[10] for r in rows]), np.array([r[4] for r in rows]), rows[0][12])
        new = [(*r[:10], float(p), r[11]) for r, p in zip(rows, pi, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*new, strict=True), list(schema)[:12], strict=True)], schema.names[:12])

    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and rows:
                yield done()
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield done()


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of documents(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken, h, r.

    A source is taken at the rate target / source_size, 0 to MOST: each document floor(rate) times, and
    once more those that the cube method draws with the probability that is left, balanced on words and
    documents. taken = copies * size. h, r tell equal doc_ids apart: a hash of the row and a number
    among equal ones.

    Blocks of about block_rows rows by hash fly alone; they leave two open units each, which meet in
    fewer blocks, until each source has one; its last few units, and some of spread sizes that were
    kept back for this, land on the choice nearest to the words due. All order is by hash and id, so
    reruns agree; no source or block meets in one task beyond block_rows rows.

    Null text: size 0, never drawn. Null source: a source. Repeated rows count as documents. Empty
    table: no rows.
    """
    rows = written(sized(documents), "sizes")
    aims = written(targets(rows, weights).withColumnRenamed("source", "aim"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12).cast("long")
    left = F.greatest(rate - whole, F.lit(0.0))
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("long")
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("size")).cast("long"))
    state = numbered.join(F.broadcast(aims) if aims.limit(10_001).count() <= 10_000 else aims, F.col("source").eqNullSafe(F.col("aim")))
    state = state.select(
        "source", F.pmod(F.xxhash64("h", "doc_id", "r", F.lit(3)), blocks).alias("b"), blocks.alias("blocks"), "doc_id", "size", "source_size", "target", "h", "r", whole.alias("whole"),
        F.when((F.col("size") == 0) | (left < _TOLERANCE), 0.0).when(left > 1 - _TOLERANCE, 1.0).otherwise(left).alias("pi"), F.lit(False).alias("spare"),
    )
    most = aims.agg(F.max(F.ceil(F.col("n") / F.lit(block_rows)))).first()[0] or 0
    fields = [f.split()[0] for f in _STATE.split(", ")]
    done, level, open_ = [], 0, state.withColumn("k", F.lit(0))
    while True:
        flown = open_.select(*fields).repartition("source", "b").sortWithinPartitions("source", "b", "h", "doc_id", "r").mapInArrow(_flights(False), _STATE)
        flown = written(flown, "flight")
        settled = (F.col("pi") <= 0) | (F.col("pi") >= 1)
        done.append(flown.where(settled))
        open_ = flown.where(~settled)
        if most <= 1:
            break
        fewer = max(2, block_rows // 4)  # a block leaves two units, so blocks shrink by half of this at least
        most = -(-most // fewer)
        open_ = open_.withColumn("b", F.floor(F.col("b") / fewer)).withColumn("k", F.lit(level + 1))
        level += 1
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    given = settled.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("size") * (F.col("whole") + F.col("pi"))).alias("given"))
    again = open_.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("size") * F.col("whole")).alias("more"))
    due = given.join(again.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "full").select(F.coalesce("of", "of2").alias("of"), (F.coalesce("given", F.lit(0.0)) + F.coalesce("more", F.lit(0))).alias("given"))
    last = open_.join(due, F.col("source").eqNullSafe(F.col("of"))).withColumn("owed", F.col("target") - F.col("given"))
    landed = last.select(*fields, "owed").repartition("source").sortWithinPartitions("source", "h", "doc_id", "r").mapInArrow(_landings, _STATE)
    copies = (F.col("whole") + F.round("pi").cast("long")).alias("copies")
    out = settled.unionByName(landed).select("doc_id", "source", "size", "source_size", "target", copies, "h", "r")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents that the mix takes, all their columns, with size, target, copies (how often) and taken.

    Columns of documents that bear one of these four names are replaced. Rows equal in id, source and
    text are told apart by a hash of all columns, so reruns agree. Null text is never taken; null source
    is a source; empty table: no rows.
    """
    made = {c: fresh_name(documents, c) for c in ("mix_h", "mix_r", "mix_id", "mix_h2", "mix_r2")}
    own = ["size", "target", "copies", "taken"]
    documents = documents.drop(*own)
    mix = written(mixture(documents, weights), "mixture").where("r > 1 OR copies > 0")
    mix = mix.select(F.col("doc_id").alias(made["mix_id"]), F.col("h").alias(made["mix_h2"]), F.col("r").alias(made["mix_r2"]), *own)
    keyed = documents.withColumn(made["mix_h"], F.xxhash64(F.col("doc_id").cast("long"), "source", "text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(mix[made["mix_id"]]) & (keyed[made["mix_h"]] == mix[made["mix_h2"]])
    if not mix.where(F.col(made["mix_r2"]) > 1).isEmpty():  # rows that repeat are numbered; else texts move once
        alike = Window.partitionBy("doc_id", made["mix_h"]).orderBy(F.xxhash64(*documents.columns))
        keyed = keyed.withColumn(made["mix_r"], F.row_number().over(alike).cast("long"))
        same = same & (F.col(made["mix_r"]) == F.col(made["mix_r2"]))
    return keyed.join(mix, same).where("copies > 0").select(*documents.columns, *own)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
