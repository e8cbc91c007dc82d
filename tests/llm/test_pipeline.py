"""The pipeline's stages against their operators, and the registry with and without the subpackage."""

import importlib
import sys

import corpus_pipeline
from strataloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from strataloom.llm.queries import QUERIES
from strataloom.llm.shared import table, written

DIR = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    labels = table(spark, DIR, "labels")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, DIR), name)
        assert k == 4 or out.columns == columns
        kept.append(out)
        docs = out
    first, lines, near, clean, mix = kept
    good = {r.doc_id for r in quality.scores(table(spark, DIR, "documents"), quality.fit(table(spark, DIR, "documents"), labels)).where("predicted = 1").collect()}
    assert set(ids(first)) == good and len(good) < 200
    assert ids(lines) == ids(first) and sorted(map(tuple, lines.collect())) == sorted(map(tuple, line_dedup.without_boilerplate(first).select(*columns).collect()))
    assert ids(near) == sorted(r.doc_id for r in near_dedup.near_duplicates(lines, 80).where("kept").collect())
    assert ids(clean) == sorted(r.doc_id for r in decontaminate.contamination(near, table(spark, DIR, "benchmark")).where("NOT contaminated").collect()) and len(ids(clean)) < len(ids(near))
    taken = {r.doc_id: r.taken for r in mixing.mixture(clean).where("copies > 0").collect()}
    assert {r.doc_id: r.taken for r in mix.collect()} == taken
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(taken.items())


def test_empty_tables(spark):
    none = table(spark, DIR, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DIR)
        assert none.count() == 0


def test_registry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "strataloom.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        without = importlib.reload(entry)
        assert not any(n.startswith("op") or n == "pipeline" for n in without.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
