"""MinHash near-duplicate detection with tensored banding, exact links and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import fresh_name, table, written
from .shingles import distinct, mix, set_digests, shingled

#: Sub-keys a collection and minhashes a sub-key. Two collections of M sub-keys give M * M tables whose
#: keys hold 2 * K minhashes, from 2 * M * K minhashes in all instead of 2 * M * M * K. At similarity s a
#: pair meets with (1 - (1 - s**K)**M)**2: 0.99998 at 0.85, 0.9986 at 0.8, 2e-6 at 0.2.
M, K = 24, 6
#: Shingles and sets that a cell of the exact comparison holds of each of its two parts, about.
CELL_SHINGLES, CELL_ROWS = 1_000_000, 512

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, 2 * M * K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 2 * M * K, dtype=np.uint64)


def minhashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * M * K minima for each (non-empty) row's shingles, a column for each row."""
    out = np.empty((2 * M * K, len(starts) - 1), np.uint64)
    buffer = np.empty_like(values)
    for f in range(2 * M * K):
        np.multiply(values, _A[f], out=buffer)
        np.add(buffer, _B[f], out=buffer)
        out[f] = np.minimum.reduceat(buffer, starts[:-1])
    return out


def sub_keys(minima: np.ndarray) -> np.ndarray:
    """(2 * M, rows): each sub-key from K minima, different for equal minima at another place."""
    grouped = minima.reshape(2 * M, K, -1)
    key = np.arange(1, 2 * M + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((1, grouped.shape[2]), np.uint64)
    for k in range(K):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + grouped[:, k])
    return key


_SKETCH = "doc_id long, t1 long, t2 long, n_shingles long, d binary, a array<long>, b array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shingled(batch.column(3)):
            values, starts = distinct(part)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            keys = np.zeros((part.n, 2 * M), np.int64)
            if len(full):
                keys[full] = sub_keys(minhashes(values, np.append(starts[full], len(values)))).T.view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(part.n + 1, dtype=np.int32) * M), pa.array(np.ascontiguousarray(keys[:, side]).ravel())) for side in (slice(0, M), slice(M, 2 * M))]
            own = [batch.column(k).slice(part.first, part.n) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), pa.array(set_digests(values, starts), pa.binary()), *lists], ["doc_id", "t1", "t2", "n_shingles", "d", "a", "b"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, body) of (node, text): the set, ascending, 8 bytes a shingle."""
    for batch in batches:
        for part in shingled(batch.column(1)):
            values, starts = distinct(part)
            body = pa.array([values[starts[k] : starts[k + 1]].tobytes() for k in range(part.n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(np.diff(starts)), body], ["node", "n", "body"])


def linked_pairs(values: np.ndarray, starts: np.ndarray, side: np.ndarray, threshold: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the sets that 100 * intersection >= threshold * union links.

    side: 0 or 1 for each set; where both occur, only sets of different sides are compared. labels: sets
    of one label are known to be connected and are not compared. Every pair's intersection is counted
    over the shingles that two sets at least share: exact, no bound on partners.
    """
    n = len(starts) - 1
    sizes = np.diff(starts)
    rows = np.repeat(np.arange(n), sizes)
    two_sides = bool(side.any()) and not side.all()
    _, run_of = np.unique(values, return_inverse=True)
    asked = (side == 0)[rows] if two_sides else np.ones(len(rows), bool)
    order = np.argsort(run_of[asked], kind="stable")
    sorted_rows = rows[asked][order]
    lengths = np.bincount(run_of[asked], minlength=run_of.max(initial=-1) + 1)
    runs = np.cumsum(lengths) - lengths
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for x in np.flatnonzero(side == 1) if two_sides else range(n):
        own = run_of[starts[x] : starts[x + 1]]
        own = own[lengths[own] > (0 if two_sides else 1)]
        if not len(own):
            continue
        first, size = runs[own], lengths[own]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        shared = np.bincount(sorted_rows[at], minlength=n)
        linked = (shared > 0) & (100 * shared >= threshold * (sizes[x] + sizes - shared))
        if not two_sides:
            linked &= np.arange(n) < x
        if labels is not None:
            linked &= labels != labels[x]
        for y in np.flatnonzero(linked):
            if (r := root(int(y))) != (s := root(int(x))):
                parent[r] = s
                forest.append((int(x), int(y)))
    return forest


_CELL = ["key", "i", "j"]


def _cells(threshold: int):
    """Over rows (key, i, j, node, side, label, body) in order of cell and node: links as (u, v)."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        found = linked_pairs(np.concatenate(sets), starts, np.array([r[4] for r in rows]), threshold, np.array([r[5] for r in rows]))
        return [(rows[x][3], rows[y][3]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[:3] != cell:
                    found += links(rows)
                    cell, rows = row[:3], []
                if not rows or row[3] != rows[-1][3]:  # a repeated row of the table
                    rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])
        if found := links(rows):
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _compared(cells: DataFrame, bodies: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) within cells(key, i, j, node, side, label); written."""
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    full = cells.join(bodies.select("node", "body"), "node").select(*_CELL, "node", "side", "label", "body")
    return written(full.repartition(tasks, *_CELL).sortWithinPartitions(*_CELL, "node").mapInArrow(_cells(threshold), "u long, v long"), "links")


def _parts(m: str, total: str, rows: int, shingles: int):
    """How many parts m sets with total shingles make."""
    return F.greatest(F.ceil(F.col(m) / F.lit(rows)), F.ceil(F.col(total) / F.lit(shingles))).cast("int")


def _star_cells(buckets: DataFrame, rows: int, shingles: int) -> DataFrame:
    """Cells of one centre and a part of the sets that choose it, from buckets(key, node, n, w).

    A bucket's centre is the set that meets most others in all buckets, as an original meets its copies
    oftener than they meet each other. Each set chooses the greatest of its buckets' centres: one
    comparison a set, none for a set that is the greatest itself.
    """
    met = buckets.groupBy("node").agg(F.sum("w").alias("met"))
    ranked = buckets.join(met, "node").withColumn("rank", F.struct("met", (-F.col("node")).alias("minus")))
    centres = ranked.groupBy("key").agg(F.max("rank").alias("centre"))
    chosen = ranked.join(centres, "key").groupBy("node").agg(F.max("centre").alias("centre"), F.first("n").alias("n"))
    edges = written(chosen.select("node", "n", (-F.col("centre.minus")).alias("centre")).where("node <> centre"), "stars")
    size = edges.groupBy("centre").agg(F.count("*").alias("m"), F.sum("n").alias("total")).select("centre", _parts("m", "total", rows, shingles).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")).cast("int")
    own = edges.join(size, "centre").select(F.col("centre").alias("key"), part.alias("i"), F.lit(0).alias("j"), "node", F.lit(1).alias("side"), F.col("node").alias("label"))
    mid = size.select(F.col("centre").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.col("centre").alias("node"), F.lit(0).alias("side"), F.col("centre").alias("label"))
    return own.unionByName(mid)


def _groups(buckets: DataFrame) -> DataFrame:
    """(node, key): the sets that buckets hold together, directly or by others, share a key."""
    least = buckets.groupBy("key").agg(F.min("node").alias("v"))
    return components(buckets.join(least, "key").select(F.col("node").alias("u"), "v")).select("node", F.col("label").alias("key"))


def _pair_cells(nodes: DataFrame, groups: DataFrame, rows: int, shingles: int) -> DataFrame:
    """Cells in which all pairs of different labels of each group meet, from nodes(node, n, label) and groups(node, key).

    A group of one label is done. In another the sets of its most frequent label, which are not compared
    with each other, meet the other sets part by part, and those each other: a large cluster with a few
    sets beside it costs little more than its own size.
    """
    of = nodes.join(groups, "node")
    labels = of.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    most = labels.groupBy("key").agg(F.max_by(F.struct("label", "m", "total"), F.struct("m", "label")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("m"), F.sum("total").alias("total")).where("labels > 1")
    size = most.select("key", F.col("top.label").alias("main"), _parts("top.m", "top.total", rows, shingles).alias("p"), F.greatest(F.ceil((F.col("m") - F.col("top.m")) / rows), F.ceil((F.col("total") - F.col("top.total")) / shingles)).cast("int").alias("q"))
    grouped = written(of.join(size, "key").withColumn("big", F.col("label") == F.col("main")), "groups")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("big"), F.col("p")).otherwise(F.col("q"))).cast("int")
    grouped = grouped.withColumn("part", part)
    across = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("big"), F.col("q")).otherwise(F.col("p")) - 1)))
    across = across.select("key", F.when(F.col("big"), F.col("part")).otherwise(F.col("other")).alias("i"), F.when(F.col("big"), F.col("other")).otherwise(F.col("part")).alias("j"), "node", F.when(F.col("big"), 0).otherwise(1).alias("side"), "label")
    others = grouped.where("NOT big").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    others = others.select("key", (-1 - low).alias("i"), high.alias("j"), "node", F.when(low == F.col("part"), 0).otherwise(1).alias("side"), "label")
    return across.unionByName(others)


def _buckets(sets: DataFrame) -> DataFrame:
    """(key, node, n, w): the buckets of two sets at least, one of those with the same members; w: its size times how many there are.

    Members are told apart by 128 bits, the exclusive or of their hashes, so a large bucket is counted
    in parts before anything of it meets.
    """
    first = sets.select("node", F.explode("a").alias("ka"))
    shared = first.groupBy("ka").agg(F.count("*").alias("c")).where("c > 1").select("ka")
    met = first.join(shared, "ka", "left_semi").groupBy("node").agg(F.collect_list("ka").alias("kas"))  # M at most
    keyed = met.join(sets.select("node", "b"), "node").select("node", F.explode("kas").alias("ka"), "b").select("node", "ka", F.explode("b").alias("kb")).select("node", F.xxhash64("ka", "kb").alias("key"))
    keyed = written(keyed, "keys")
    held = keyed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "node")).alias("y")).where("m > 1")
    chosen = held.groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("alike")).select("key", (F.col("m") * F.col("alike")).alias("w"))
    return written(keyed.join(chosen, "key").join(sets.select("node", "n"), "node").select("key", "node", "n", "w"), "buckets")


def _text_keys() -> list:
    """128 bits that stand for a row's text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t"), "text").alias("t2")]


def classes(documents: DataFrame, threshold: int = 85, cell_shingles: int = CELL_SHINGLES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row: doc_id, t1, t2 (of its text), n_shingles, class (null without words) and component_id. See near_duplicates."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(), F.col("text").alias("text"))
    sketch = written(rows.mapInArrow(_sketch, _SKETCH), "sketch")
    one = F.struct("doc_id", "t1", "t2")
    sets = sketch.where("n_shingles > 0").groupBy("d").agg(F.min("doc_id").alias("id"), F.min(one).alias("one"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    buckets = _buckets(sets)
    asked = sets.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("one.doc_id").alias("of"), F.col("one.t1").alias("u1"), F.col("one.t2").alias("u2"))
    # Merged at every size: a broadcast of the asked sets would only do for small inputs.
    texts = asked.hint("merge").join(rows, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")))
    bodies = written(texts.select("node", "text").mapInArrow(_bodies, "node long, n long, body binary"), "bodies")

    candidates = buckets.groupBy("node").agg(F.first("n").alias("n"))
    links = _compared(_star_cells(buckets, cell_rows, cell_shingles), bodies, threshold)
    labels = components(links)
    known = written(candidates.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")), "labels")
    more = _compared(_pair_cells(known, _groups(buckets), cell_rows, cell_shingles), bodies, threshold)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    nodes = sets.select("d", "id", "node")
    placed = nodes.join(labels, "node", "left").select("d", "id", F.coalesce("label", "node").alias("class"))
    least = placed.groupBy("class").agg(F.min("id").alias("component_id"))
    of_set = placed.join(least, "class").select("d", "class", "component_id")
    empty = F.col("n_shingles") == 0
    out = sketch.select("doc_id", "t1", "t2", "n_shingles", "d").join(of_set, "d", "left")
    return out.select("doc_id", "t1", "t2", "n_shingles", F.when(~empty, F.col("class")).alias("class"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(documents: DataFrame, threshold: int = 85, **cells) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_shingles, component_id, kept.

    Links sets of distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle) with
    100 * intersection >= threshold * union, threshold from 80. component_id is the least doc_id that
    links reach; kept marks it.

    1. Sketch each text; equal sets collapse to one node.
    2. Nodes that share a sub-key of the first collection take the table keys (pairs of sub-keys). Of
       the buckets of a table key those with the same members collapse too.
    3. Along stars: each node is compared on full sets with one centre among its buckets'. This settles
       an original with its copies at one comparison a node, however many there are; links join labels.
    4. Of the nodes that buckets hold together, directly or by others, all pairs of different labels are
       compared, in cells of at most cell_rows sets and cell_shingles shingles a side, so a group larger
       than a cell meets in many tasks. A group of one label is done.
    5. Components of the links.

    Null text is empty. A text without words: n_shingles 0, linked with nothing. Very long texts are one
    set as any other. Rows that repeat a doc_id with other texts are nodes of their own, whose links do
    not mix. Null doc_id: a node as any other, but never a component_id while a row of its component has
    one, and kept only in a component of null ids alone. Empty table: no rows. Other columns are ignored.
    """
    found = classes(documents, threshold, **cells).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(documents: DataFrame, threshold: int = 85, **cells) -> DataFrame:
    """documents with one row of each component, all its columns, and all rows without words.

    The row kept is the one of the least doc_id (nulls last), of equal ids that of the least hash of its
    text, of rows equal in both that of the least hash of all columns: rows that share an id but not a
    component both stay. Columns of any name stay as they are. Empty table: empty.
    """
    found = written(classes(documents, threshold, **cells).select("doc_id", "t1", "t2", "class"), "classes")
    made = {c: fresh_name(documents, c) for c in ("near_t1", "near_t2", "near_n", "near_id", "near_u1", "near_u2")}
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    best = found.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("least")).select("least.doc_id", "least.t1", "least.t2")
    wordless = found.where("class IS NULL").select("doc_id", "t1", "t2").distinct()
    wanted = best.unionByName(wordless).select(F.col("doc_id").alias(made["near_id"]), F.col("t1").alias(made["near_u1"]), F.col("t2").alias(made["near_u2"]))
    keyed = documents.withColumns({made["near_t1"]: F.xxhash64("text"), made["near_t2"]: F.xxhash64(F.lit("t"), "text")})
    same = documents["doc_id"].cast("long").eqNullSafe(F.col(made["near_id"])) & (F.col(made["near_t1"]) == F.col(made["near_u1"])) & (F.col(made["near_t2"]) == F.col(made["near_u2"]))
    out = keyed.join(wanted, same, "left_semi")
    repeated = found.where("class IS NOT NULL").groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("c")).where("c > 1")
    if not repeated.isEmpty():  # numbered only then: else texts are not sorted
        alike = Window.partitionBy("doc_id", made["near_t1"], made["near_t2"]).orderBy(F.xxhash64(*documents.columns))
        wordy = F.col("text").rlike(r"[^\x20\x09-\x0D]")
        out = out.withColumn(made["near_n"], F.row_number().over(alike)).where((F.col(made["near_n"]) == 1) | ~F.coalesce(wordy, F.lit(False)))
    return out.select(*documents.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
