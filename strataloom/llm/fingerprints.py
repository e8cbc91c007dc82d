"""One-permutation MinHash fingerprints with optimal densification, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import table, written

#: Bins of the one permutation, and low-order bits kept of each bin's minimum (one hexadecimal digit).
BINS, BITS = 128, 4
#: Words a shingle.
WIDTH = 5
#: Documents that a range of ids holds, about; neighbours are found within ranges.
RANGE_ROWS = 1_000
#: Ranges that one task puts in order, and ranges up to which their first ids are broadcast (16 bytes each).
GROUP_RANGES, BROADCAST_RANGES = 1_000, 1_000_000
_VALUE_BITS = 56
_EMPTY = (1 << _VALUE_BITS) - 1


def _probe(b: Column, t: Column | int) -> Column:
    """The t-th bin in which the empty bin b looks for a full one: (r + s * t) mod BINS, r and the odd s hashes of b.

    It is the same for all documents, so equal bins borrow alike; an odd step reaches every bin.
    """
    r, s = F.pmod(F.xxhash64(b, F.lit("r")), F.lit(BINS)), F.pmod(F.xxhash64(b, F.lit("s")), F.lit(BINS // 2)) * 2 + 1
    return F.pmod(r + s * t, F.lit(BINS)).cast("int")


def _shingle_keys(hashes: Column) -> Column:
    """Of each shingle of hashed words 7 bits of bin and 56 of value in a positive long. hashes: a plain column, as lambdas read it again and again."""
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WIDTH)))
    shingles = F.when(n >= WIDTH, many).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(shingles, lambda h: F.shiftrightunsigned(h, 1))


def fingerprint_columns(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with name: BINS hexadecimal digits for text's set of 5-word shingles; '' if it has no words.

    Words part at white space, A-Z lower-cased; a text of fewer words is one shingle. A shingle's one
    hash gives its bin and its value; a bin keeps its least value; an empty bin takes that of the first
    full bin in its own random order (optimal densification: every full bin is about as likely, whatever
    its place); 4 low-order bits of each value's hash with its
    bin are kept. Null text is empty.
    """
    words, keys, least = (f"{name}_{x}" for x in ("words", "keys", "least"))
    sentinels = F.lit([(b << _VALUE_BITS) | _EMPTY for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS)
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    full_words = F.filter(F.split(lowered, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    df = df.withColumn(words, F.transform(full_words, lambda w: F.xxhash64(w)))
    df = df.withColumn(keys, F.sort_array(F.concat(_shingle_keys(F.col(words)), sentinels)))
    first = F.filter(F.col(keys), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(keys), i - 1))))
    df = df.withColumn(least, F.transform(first, lambda x: x.bitwiseAND(F.lit(_EMPTY))))
    bins = F.col(least)
    full = lambda v: v != F.lit(_EMPTY)
    at = lambda b, t: F.get(bins, _probe(b, t))

    def borrowed(b: Column) -> Column:
        """The first probes one by one, as they mostly suffice, then all."""
        out = F.get(F.filter(F.transform(F.sequence(F.lit(3), F.lit(BINS - 1)), lambda t: at(b, t)), full), F.lit(0))
        for t in reversed(range(3)):
            out = F.when(full(at(b, t)), at(b, t)).otherwise(out)
        return out

    # The bin goes into the kept bits, so that bins which borrow one value agree by chance independently.
    digits = F.transform(bins, lambda v, b: F.lower(F.hex(F.xxhash64(F.when(full(v), v).otherwise(borrowed(b)), b).bitwiseAND(F.lit((1 << BITS) - 1)))))
    return df.withColumn(name, F.when(F.size(F.col(words)) > 0, F.array_join(digits, "")).otherwise(F.lit(""))).drop(words, keys, least)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1.

    Of the digits that agree, 2**-BITS of the others do by chance; the estimate takes that bias out.
    Both without words: 1; one of them: 0.
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    unbiased = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(unbiased)


class Ranges:
    """Ranges of doc_id of about range_rows rows: up to TOP quantiles, each cut into steps of equal width."""

    TOP = 1_000

    def __init__(self, ids: DataFrame, range_rows: int) -> None:
        stats = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        wanted = max(1, -(-stats["n"] // range_rows))
        top = min(wanted, self.TOP)
        cuts = ids.stat.approxQuantile("doc_id", [k / top for k in range(1, top)], 0.2 / top) if top > 1 else []
        self.cuts = sorted({int(c) for c in cuts})
        self.lows = [stats["lo"] or 0, *self.cuts]
        self.highs = [*self.cuts, (stats["hi"] or 0) + 1]
        self.steps = -(-wanted // top)

    def column(self) -> Column:
        """The number of the row's range, growing with doc_id; a null's is the least, as nulls come last."""
        top = F.size(F.filter(F.lit(self.cuts) if self.cuts else F.array().cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
        out = top.cast("long") * self.steps
        if self.steps > 1:
            low, high = F.get(F.lit(self.lows), top), F.get(F.lit(self.highs), top)
            step = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * self.steps)
            out += F.least(F.greatest(step, F.lit(0)), F.lit(self.steps - 1))
        return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(out).cast("long")


def following_heads(heads: DataFrame) -> DataFrame:
    """(head, k): for each range k of heads(k, head) the head of the range before it in k, for the least that of the greatest.

    Ranges follow each other within groups of GROUP_RANGES, and the groups' ends by one row a group.
    """
    group = F.floor(F.col("k") / F.lit(GROUP_RANGES)).alias("group")
    heads = heads.select("k", group, F.struct("head").alias("own"))
    tops = heads.groupBy(F.col("group").alias("of")).agg(F.max_by("own", "k").alias("top"))
    tops = tops.select("of", F.lead("top").over(Window.orderBy(F.desc("of"))).alias("beyond"), F.first("top").over(Window.orderBy(F.desc("of"))).alias("greatest"))
    inner = F.lead("own").over(Window.partitionBy("group").orderBy(F.desc("k")))
    found = heads.withColumn("inner", inner).join(tops, F.col("group") == F.col("of"))
    return found.select(F.coalesce("inner", "beyond", "greatest")["head"].alias("head"), "k")


def with_next(documents: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, WindowSpec]:
    """(rows, window): doc_id, text, k, ghost, and a window in which lead() is the next document in descending doc_id.

    Rows meet by ranges of ids (k). The first document of the range after it is added to each range as
    a ghost, after the last the first of all; so no task sees more than a range. The ranges' first ids
    stay distributed; up to BROADCAST_RANGES of them are broadcast to find their rows, more are joined
    by id. Ties of doc_id go by hash of the text, then the text; null ids come last.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    k = Ranges(ids, range_rows).column()
    wanted = written(following_heads(written(ids.groupBy(k.alias("k")).agg(F.max("doc_id").alias("head")), "heads")), "ghosts")
    few = wanted.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    wanted = F.broadcast(wanted) if few else wanted.hint("merge")
    ghost = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "k", F.lit(True).alias("ghost"))
    real = rows.select("doc_id", "text", k.alias("k"), F.lit(False).alias("ghost"))
    return real.unionByName(ghost), Window.partitionBy("k").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def compared(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of documents(doc_id, text): n_chars, fingerprint, that of its edited text, and likenesses.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the
    next document's (or all), by descending doc_id, after the last the first; one document alone
    follows itself. Null text is empty; repeated rows are documents of their own. Empty table: no rows.
    """
    rows, window = with_next(documents, range_rows)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    following = F.coalesce(F.lead("text").over(window), F.lit(""))
    rows = rows.withColumn("following", following)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("following", F.lit(1), third))).drop("following")
    rows = fingerprint_columns(rows, F.col("text"), "fingerprint")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(window)).where("NOT ghost")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint")
    rows = fingerprint_columns(rows, F.col("edited"), "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
