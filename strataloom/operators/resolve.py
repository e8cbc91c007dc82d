"""Reference resolution: scoped joins, first tier with exactly one candidate wins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dirname, stem
from ..functions.storage import materialised

#: Looked-up questions up to which their answers are broadcast to the references.
BROADCAST_ROWS = 200_000


def unique_by(symbols: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys and the qname of the one symbol that has them; keys with several symbols are left out."""
    return symbols.groupBy(*keys).agg(F.count("*").alias("n"), F.first("qname").alias(out)).where("n = 1").drop("n")


#: Columns that a symbol is looked up by, each set a scope.
SCOPES = {"file_name": ("file", "name"), "dir_name": ("dir", "name"), "name": ("name",), "file_recv": ("file", "recv", "name"), "dir_recv": ("dir", "recv", "name"), "recv": ("recv", "name"), "file": ("file",)}


def _key(scope: str, *parts: Column) -> Column:
    """A scope and up to three values as one key."""
    full = [*parts, *[F.lit("")] * (3 - len(parts))]
    return F.struct(F.lit(scope).alias("scope"), *(p.alias(n) for p, n in zip(full, "abc", strict=True)))


def unique_keys(symbols: DataFrame) -> DataFrame:
    """(key, qname) of every scope's keys that exactly one symbol has: one pass and one shuffle for all scopes."""
    rows = symbols.select("qname", "name", "file", dirname(F.col("file")).alias("dir"), F.coalesce("recv", F.lit("")).alias("recv"))
    keys = F.array(*(_key(scope, *map(F.col, columns)) for scope, columns in SCOPES.items()))
    return rows.select("qname", F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.first("qname").alias("found")).where("n = 1").select("key", "found")


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame, tasks: int | None = None) -> DataFrame:
    """refs(ref_id, caller_qname, caller_file, callee_name, callee_recv, allow_bare) with callee, null where unresolved.

    Tiers in order: HCL files (imported module, then file and directory, never global); a template's
    component file; an import whose alias is the name (named; default: the export, the name, the file's
    stem, the file's only symbol; a bare namespace alias ends the search); the receiver's import; the
    receiver's type in file, directory, anywhere, then with a capital, then without Rust's ' as Trait';
    and, unless bare names are not allowed, the name in file, directory, anywhere. A tier hits if
    exactly one symbol fits; none or several pass on to the next.

    What resolves a reference is its file, name, receiver and bareness alone, so equal ones are looked up
    once. Such a question becomes a row for each tier that applies; all meet the unique keys in one join,
    and the first tier that hits is a minimum that sums up by task.

    tasks: for large tables; so many tasks share the symbols, and references and answers are written once.
    """
    asked = ["caller_file", "callee_name", "callee_recv", "allow_bare"]
    if tasks:  # each symbol becomes a row for each scope, so few files of symbols must not be few tasks
        refs, symbols = materialised(refs), symbols.repartition(tasks, "qname")
    occurrences, refs = refs, refs.select(*asked).distinct()
    target = imports.groupBy(F.col("file").alias("__file"), F.col("alias").alias("__alias")).agg(F.max(F.struct("target_file", "target_name")).alias("__to"))
    name, recv, file = F.col("callee_name"), F.coalesce("callee_recv", F.lit("")), F.col("caller_file")
    hcl = file.rlike(r"\.(?:hcl|tf|tofu|tfvars|tofuvars)$")
    prefixed = hcl & recv.rlike("^hcl-(?:import|module|tgsource)")
    rows = refs
    for out, alias in (("__named", F.when(prefixed, recv).otherwise(name)), ("__of_recv", F.when(recv != "", recv))):
        rows = rows.join(target.select("__file", "__alias", F.col("__to").alias(out)), (file == F.col("__file")) & (alias == F.col("__alias")), "left").drop("__file", "__alias")
    folder, code = dirname(file), ~hcl
    to_file, to_name = F.col("__named.target_file"), F.col("__named.target_name")
    tiers: list[tuple[Column, Column]] = []

    def tier(applies: Column, scope: str, *parts: Column) -> None:
        tiers.append((applies, _key(scope, *parts)))

    tier(prefixed & to_file.isNotNull(), "file_name", to_file, name)
    tier(prefixed & to_file.isNotNull(), "dir_name", to_file, name)
    tier(hcl & ~prefixed, "file_name", file, name)
    tier(hcl & ~prefixed, "dir_name", folder, name)
    tier(code & file.endswith(".html"), "file_name", F.regexp_replace(file, r"\.html$", ".ts"), name)
    open_ = code & F.coalesce(to_name != "*", F.lit(True))
    tier(open_ & (to_name != "default"), "file_name", to_file, to_name)
    default = open_ & (to_name == "default")
    for part in (F.lit("default"), name, stem(to_file)):
        tier(default, "file_name", to_file, part)
    tier(default, "file", to_file)
    tier(open_ & F.col("__of_recv").isNotNull(), "file_name", F.col("__of_recv.target_file"), name)
    capital = F.concat(F.upper(F.substring(recv, 1, 1)), F.expr("substring(coalesce(callee_recv, ''), 2)"))
    for form, fits in ((recv, recv != ""), (capital, recv.rlike(r"^\p{Ll}")), (F.substring_index(recv, " as ", 1), recv.contains(" as "))):
        tier(open_ & fits, "file_recv", file, form, name)
        tier(open_ & fits, "dir_recv", folder, form, name)
        tier(open_ & fits, "recv", form, name)
    bare = open_ & F.col("allow_bare")
    tier(bare, "file_name", file, name)
    tier(bare, "dir_name", folder, name)
    tier(bare, "name", name)

    tries = F.array_compact(F.array(*(F.when(applies, F.struct(F.lit(k).alias("tier"), key.alias("key"))) for k, (applies, key) in enumerate(tiers))))
    looked = rows.select(*asked, F.explode(tries).alias("t")).select(*asked, "t.tier", "t.key")
    hits = looked.join(unique_keys(symbols), "key").groupBy(*(F.col(c).alias(f"__{c}") for c in asked)).agg(F.min_by("found", "tier").alias("callee"))
    if tasks:
        hits = materialised(hits)
        hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asked))
    return occurrences.join(hits, same, "left").select(*occurrences.columns, "callee")


def edges_of(resolved: DataFrame) -> DataFrame:
    """Distinct edges(src, dst, proven) of resolved references; a reference to oneself is none."""
    return resolved.where("callee IS NOT NULL AND callee <> caller_qname").select(F.col("caller_qname").alias("src"), F.col("callee").alias("dst")).distinct().withColumn("proven", F.lit(False))


def unresolved_count(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if(F.col("callee").isNull()).alias("unresolved"))


def numbered_qnames(tags: DataFrame) -> DataFrame:
    """tags(file, name, line, seq) with qname: file::name; from the second of a name on #line, from the second of a line on .2, .3 ..."""
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("seq"))
    later = tags.withColumn("__nth", nth)
    again = F.row_number().over(Window.partitionBy("file", "name", "line", F.col("__nth") > 1).orderBy("seq"))
    base = F.concat_ws("::", "file", "name")
    at = F.concat(base, F.lit("#"), F.col("line").cast("string"))
    qname = F.when(F.col("__nth") == 1, base).when(again == 1, at).otherwise(F.concat(at, F.lit("."), again.cast("string")))
    return later.withColumn("qname", qname).drop("__nth")


def innermost(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """refs(ref_id, file, start, end) with the qname of the smallest spans(file, qname, start, end, seq) around; the first listed of equals, file::(top-level) if none."""
    s = spans.select(F.col("file").alias("__f"), "qname", F.col("start").alias("__s"), F.col("end").alias("__e"), "seq")
    held = refs.join(s, (refs["file"] == s["__f"]) & (s["__s"] <= refs["start"]) & (refs["end"] <= s["__e"]), "left")
    best = held.groupBy(*refs.columns).agg(F.min_by("qname", F.struct(F.col("__e") - F.col("__s"), "seq")).alias("qname"))
    return best.withColumn("qname", F.coalesce("qname", F.concat(F.col("file"), F.lit("::(top-level)"))))
