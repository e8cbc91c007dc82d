"""Scalar building blocks: paths, identifiers, labels, token estimates, scores, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column, root: str = "") -> Column:
    """The part before the last '/'; root for a file at the top."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(root)).otherwise(d)


def extension(path: Column) -> Column:
    """With its dot, lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def file_of(qname: Column) -> Column:
    return F.substring_index(qname, "::", 1)


def display(lang: Column, recv: Column, name: Column) -> Column:
    """Name as people write it: Recv.name, Recv::name in Rust, name without a receiver."""
    joint = F.when(lang == "rust", "::").otherwise(".")
    return F.when(F.coalesce(recv, F.lit("")) == "", name).otherwise(F.concat(recv, joint, name))


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("int")


def clean_identifier(text: Column) -> Column:
    """Without quotes of SQL dialects and without a schema before the last dot."""
    bare = F.regexp_replace(F.trim(text), r"[`\"\[\]]", "")
    return F.substring_index(bare, ".", -1)


def node_id(text: Column) -> Column:
    """An identifier for diagrams: other characters become _, a leading digit gets n, nothing becomes n."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.when(safe == "", "n").when(safe.rlike("^[0-9]"), F.concat(F.lit("n"), safe)).otherwise(safe)


def participant_id(text: Column) -> Column:
    safe = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.when(safe == "", "_").when(safe.rlike("^[0-9]"), F.concat(F.lit("p_"), safe)).otherwise(safe)


def label(text: Column) -> Column:
    """Diagram label: quotes become ', angle brackets go, line ends become blanks."""
    return F.regexp_replace(F.translate(text, "\"`<>", "''"), r"[\r\n]", " ")


def escaped_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def blended(rank: Column, top_rank: Column, commits: Column, top_log: Column, weight: float, use_churn: bool) -> Column:
    """(1 - w) * rank / max rank + w * log1p(commits) / max log1p; the first alone without churn."""
    central = F.when(top_rank > 0, rank / top_rank).otherwise(0.0)
    if not use_churn:
        return central
    churn = F.when(top_log > 0, F.log1p(commits.cast("double")) / top_log).otherwise(0.0)
    return (1 - weight) * central + weight * churn


def pack_score(distance: Column, central: Column, churn: Column) -> Column:
    """Halved by each hop, raised by centrality and, half as much, by churn."""
    return F.pow(F.lit(0.5), distance) * (1 + central + 0.5 * churn)


def snippet(content: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text; '' if first is not one of its lines."""
    lines = F.split(content, "\n")
    good = (first >= 1) & (first <= F.size(lines))
    return F.when(good, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(1))), "\n")).otherwise("")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def iso_day(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)


def direction(text: Column) -> Column:
    """Reading order of a tour: the inside-out names, else outside-in."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("inside-out", "inside_out", "insideout", "inside out", "in-out"), "inside-out").otherwise("outside-in")
