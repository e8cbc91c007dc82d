"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm import chat, decontaminate, fingerprints, licenses, line_dedup, mixing, near_dedup, pii, quality, shingles, token_counts
from strataloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


def docs_of(spark, rows, schema=SCHEMA):
    """(doc_id, text[, source]) as documents."""
    return spark.createDataFrame([(i, t, "en", s[0] if s else "s", None if t is None else len(t)) for i, t, *s in rows], schema)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "x" * 50_000), (8, "w " * 30_000), (None, "lonely text of more than five words"), (9, "é ü ß \U0001f600   z")]


# ---- shingles and components ------------------------------------------------------------------------


def test_shingle_sizes_and_digests():
    texts = ["a b c d e f", None, "", "x", "A  b\tc d e\nf", "one two three four", "a b c d e " * 400, "é b c d e f"]
    for part in shingles.shingled(pa.array(texts)):
        values, starts = shingles.distinct(part)
        assert np.diff(starts).tolist() == [len(shingle_set(t)) for t in texts]
        digests = shingles.set_digests(values, starts)
        assert digests[0] == digests[4] and len({digests[k] for k in (0, 3, 5, 6, 7)}) == 5


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array([" ".join(random.Random(k).choices("abcdefg", k=k)) for k in range(60)])
    whole = np.concatenate([p.shingles for p in shingles.shingled(texts)])
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 50)
    assert (np.concatenate([p.shingles for p in shingles.shingled(texts)]) == whole).all()


def test_word_counts(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \t", "one", " é\x0bü ", "a\x1cb\xa0c\u2003d", "\x00 \U0001f600"] + ["".join(rng.choices(" \t\n\x0c\raé\U0001f600", k=k)) for k in range(60)]
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(shingles, "CHUNK_BYTES", chunk)
        assert shingles.word_counts(pa.array(texts)).tolist() == want
        assert shingles.word_counts(pa.array(texts)[5:40]).tolist() == want[5:40]
    assert shingles.word_counts(pa.array([], pa.string())).tolist() == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (5, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            parent[root(a)] = root(b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    assert set(got) == nodes and all((got[a] == got[b]) == (root(a) == root(b)) for a in nodes for b in nodes if a < 300 and b < 300)
    assert len({got[k] for k in range(1000, 1061)}) == 1
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- op1 ------------------------------------------------------------------------------------------


def brute_lines(rows, ratio, least):
    pages, on = Counter(), Counter()
    for _, text, source in rows:
        pages[source] += 1
        for k in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""} if text is not None else ():
            on[source, k] += 1
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\x0b\x0c")) not in bad)) for i, t, s in rows), key=repr)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_line_dedup(spark, broadcast):
    rng = random.Random(2)
    rows = [(k % 70, "\n".join(rng.choice(["menu", " menu\r", "", "footer", f"line {k}", f"x{rng.randrange(9)}"]) for _ in range(rng.randrange(1, 7))), rng.choice(["a", "b", None])) for k in range(90)]
    rows += [(1, None, "a"), (2, "", "a"), (None, "menu\nonly", "a"), rows[3]]
    df = docs_of(spark, rows).withColumn("boiler_lines", F.lit(1)).withColumn("key", F.lit("k"))
    out = line_dedup.without_boilerplate(df, ratio=0.3, min_pages=3, broadcast_lines=broadcast)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute_lines(rows, 0.3, 3)
    assert sorted(out.columns) == sorted(df.columns) and out.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert line_dedup.without_boilerplate(df.where("false")).count() == 0


def test_line_dedup_small_hosts_keep_all(spark):
    assert line_dedup.without_boilerplate(docs_of(spark, [(1, "a"), (2, "a")])).where("text = 'a'").count() == 2


# ---- op2 ------------------------------------------------------------------------------------------


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        y, w = rng.integers(0, 5, 7).astype(float), rng.integers(1, 4, 7).astype(float)
        got = quality.isotonic(np.arange(7.0), y, w)
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 7)) for a in range(i + 1)) for i in range(7)]
        assert np.allclose(got, want)


def test_levels_do_not_hang_on_the_number_of_labels():
    def good_at_the_cut(n, rng):
        good = rng.random(n) < 0.8
        raw = np.sort(np.where(good, 1, 0) + rng.normal(0, 0.1, n))
        y = ((raw > 0.5) ^ (rng.random(n) < 0.1)).astype(float)
        return np.mean(quality.levels(raw, y, np.ones(n))[raw > 0.5] >= quality.GOOD)

    shares = {n: np.mean([good_at_the_cut(n, np.random.default_rng(k)) for k in range(60)]) for n in (22, 100, 1000)}
    assert min(shares.values()) > 0.93, shares
    ends = quality.levels(np.arange(22.0), np.repeat([0.0, 1.0], 11), np.ones(22))
    assert 0 < ends[0] < 0.05 and 0.95 < ends[-1] < 1


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    found = quality.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (quality.fold(r.doc_id) == 2) for r in found) and len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


@pytest.mark.parametrize("fan_in", [1_000, 2])
def test_ridge_is_the_direct_solution(spark, monkeypatch, fan_in):
    """The summed normal equations against least squares on all rows at once, with a row more for each penalty."""
    monkeypatch.setattr(quality, "FAN_IN", fan_in)
    documents, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(documents.repartition(6), labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    known = [(texts[r.doc_id], float(r.quality), quality.fold(r.doc_id)) for r in labels.collect() if r.quality is not None and r.doc_id in texts]
    stats = np.array([quality.statistics(t) for t, _, k in known if k != 2])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.maximum(stats.std(0), 1e-3))
    x = model.features(np.array([quality.statistics(t) for t, _, k in known if k < 2]))
    y = np.array([v for _, v, k in known if k < 2])
    penalty = np.full(x.shape[1], quality.RIDGE * len(y))
    penalty[-1] = 1e-9 * len(y)
    want = np.linalg.lstsq(np.vstack([x, np.diag(np.sqrt(penalty))]), np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]
    assert len(y) > 20 and np.allclose(x @ model.beta, x @ want, atol=1e-6) and np.allclose(model.beta, want, atol=1e-5)


def test_statistics_take_every_word():
    words = ["ab"] * 5_000
    words[4_321] = "x" * 700
    stats = quality.statistics(" ".join(words))
    assert np.isclose(stats[2], np.mean([len(w) for w in words]) / 4) and np.isclose(stats[3], np.std([len(w) for w in words]) / 4)


def test_quality_edges(spark):
    docs = docs_of(spark, [*ODD, (4, "one")])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)] + [(None, 1, 0), (3, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5} and quality.scores(docs.where("false"), none).count() == 0
    clash = docs.withColumn("score", F.lit("x")).withColumn("stats", F.lit(1))
    assert quality.accepted(clash, none, 0.4).count() == len(rows) and quality.accepted(clash, none, 0.4).columns == clash.columns and quality.accepted(clash, none).count() == 0


# ---- op3 ------------------------------------------------------------------------------------------


def brute_tiles(a, b, least):
    fa, fb, out = [1] * len(a), [1] * len(b), []
    while True:
        best = (0,)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append((i, j, k))
        fa[i : i + k], fb[j : j + k] = [0] * k, [0] * k


def test_tiles_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    cases = [([rng.randrange(3) for _ in range(rng.randrange(1, 20))], [rng.choice([-1, 0, 1, 2]) for _ in range(rng.randrange(1, 30))]) for _ in range(150)]
    for a, b in cases:
        assert decontaminate.tiles(np.array(a), np.array(b), 2) == brute_tiles(a, b, 2)
        assert sum(t[2] for t in decontaminate._tiles_by_length(np.array(a), np.array(b), 2)) == sum(t[2] for t in brute_tiles(a, b, 2))
    monkeypatch.setattr(decontaminate, "SEED_PAIRS", 10)
    assert decontaminate.tiles(np.zeros(40, int), np.zeros(4000, int), 5) == [(0, 0, 40)]


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    rows = [(1, f"before {item.upper()}, after"), (2, " ".join(w[10:] + ["between"] + w[:10])), (3, " ".join(w[:9])), (4, " ".join(w[::-1])), (5, "short"), (6, "tiny one"), *[(k + 100 if k else None, t) for k, t in ODD]]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny one"), (None, "x"), (7, item), (11, "alpha beta gamma delta epsilon zeta nothing more here is said")], "item_id long, text string")
    df = docs_of(spark, rows).withColumn("coverage", F.lit("old"))
    for chars in (10**6, 5):
        out = {r.doc_id: r for r in decontaminate.contamination(df, bench, block_chars=chars).collect()}
        assert {k for k, r in out.items() if r.contaminated} == {1, 2, 6} and len(out) == len(rows)
        assert out[1].item_id == 7 and out[1].coverage == 1.0 and out[2].coverage == 1.0 and out[3].coverage == pytest.approx(6 / 11) and out[4].coverage == 0 and out[6].item_id == 10
    kept = decontaminate.decontaminated(docs_of(spark, rows), bench)
    assert kept.count() == len(rows) - 3 and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert decontaminate.contamination(df.where("false"), bench).count() == 0 and decontaminate.contamination(df, bench.where("false")).where("contaminated").count() == 0


# ---- op4 ------------------------------------------------------------------------------------------


def test_escapes_round_trip_and_hide_control_strings():
    rng = random.Random(5)
    parts = ["<", "[", "\\", "|", "/", "s>", "INST]", "SYS>>", "x", "\n", "<|end|>\n", "|>", "%"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", e)


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("budget", [1, 40, 100_000])
def test_chat_windows(spark, budget):
    rng = random.Random(6)
    roles = ["system", "user", "assistant", "tool|<s>", None]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", "<|end|>\n", "[INST] x", "word " * rng.randrange(200), "é\U0001f600"])) for c in [None, *range(20)] for t in range(rng.randrange(1, 9))]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    windows = chat.formatted(df, budget)
    out = {r.conv_id: r for r in chat.read_back_digests(windows).collect()}
    by = defaultdict(list)
    first = lambda x: (x is not None, x if x is not None else 0)
    for c, t, r, x in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by[c].append((r or "", x or ""))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in out.items()} == {c: digests(t) for c, t in by.items()}
    assert {c: r.formatted_chars for c, r in out.items()} == {r.conv_id: r.n for r in windows.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("n")).collect()}
    for w in windows.collect():
        turns = chat.read_back(w.formatted)
        new = turns[w.n_repeated :]
        assert len(new) == 1 or sum(chat.tokens(t) for _, t in new) <= budget
        assert w.n_repeated <= chat.HISTORY_TURNS + 1 and (w.window == 0) <= (w.n_repeated == 0)
        if w.window and by[w.conv_id][0][0] == "system":
            assert turns[0] == by[w.conv_id][0]
    assert chat.read_back_digests(chat.formatted(df.where("false"))).count() == 0


def test_chat_query(spark):
    rows = {r.conv_id: r for r in chat.op4_chat_formatting(spark, DIR).collect()}
    said = "</s>[INST] ok [/INST]"
    assert (rows[-7].n_turns, rows[-7].turns_sha256, rows[-7].loss_chars, rows[-7].loss_sha256) == digests([("user", said), ("assistant", said)])
    assert rows[-7].formatted_chars > 2 * len(said)


# ---- op5 ------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and w and left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w if w else 0.0 for s in names}
        capped |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([1, 5, 30, 200, 2000]), rng.choice(["a", "b", "é", "z", "\U0001f600", None])) for k in range(2500)]
    rows += [(5000, "tiny", "small"), (5001, None, "a"), (5002, "", "void"), rows[0], rows[0], (None, "x y", "a")]
    df = docs_of(spark, rows)
    for block in (100, 5):
        out = mixing.mixture(df, block_rows=block).collect()
        assert len(out) == len(rows)
        sizes, taken = Counter(), Counter()
        for r in out:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        want = brute_targets(sizes)
        for r in out:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 3 * (s == "small")), s
        key = lambda rs: sorted((repr(r.doc_id), r.h, r.r, r.taken) for r in rs)
        assert key(out) == key(mixing.mixture(df.repartition(7), block_rows=block).collect())
    clash = df.withColumn("taken", F.lit("x")).withColumn("mix_h", F.lit(0)).withColumn("h", F.lit(1))
    mix = mixing.mixed(clash)
    assert mix.agg(F.sum("taken")).first()[0] == mixing.mixture(df).agg(F.sum("taken")).first()[0] and {"mix_h", "h", "copies"} <= set(mix.columns)
    assert mixing.mixture(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


def test_mixed_agrees_with_itself(spark):
    rows = [(k % 4, "w x y z " * (k % 4 % 3 + 1), f"l{k}", f"s{k % 2}", 1) for k in range(24)]  # equal in id, source and text, not in lang
    df = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mixed(df)
    assert mix.columns == [*df.columns, "size", "target", "copies", "taken"]
    assert sorted(mix.collect()) == sorted(mixing.mixed(df.repartition(5)).collect())


def test_mixing_of_a_small_table_writes_few_files(spark):
    df = docs_of(spark, [(k, "w " * (k % 50), f"s{k % 3}") for k in range(1500)])
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        out = mixing.mixture(df, block_rows=20)
        assert out.count() == 1500 and len(out.inputFiles()) <= 16  # one for each of 48 partitions that holds a block, before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_sizes_are_counted_without_a_string_a_word(spark):
    rows = ODD + [(20 + k, " \x0b\u2003é\x1c\tz" * k) for k in range(5)]
    sizes = mixing.sized(docs_of(spark, rows))
    assert "regexp" not in sizes._jdf.queryExecution().executedPlan().toString()  # regexp_count makes an array of all words
    assert {r.doc_id: r["size"] for r in sizes.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}


def test_flight_keeps_sums():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 900, 300)
    pi = np.full(300, 0.37)
    out = mixing.flight(pi.copy(), size)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2 and (out * size).sum() == pytest.approx((pi * size).sum()) and out.sum() == pytest.approx(pi.sum())
    assert set(np.unique(mixing.landing(out, size, float((pi * size).sum())))) <= {0.0, 1.0}


# ---- op6 ------------------------------------------------------------------------------------------


def brute_components(rows, threshold):
    ids = [i for i, _ in rows]
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= threshold * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(sets[x]), least.get(root(x)) if sets[x] else i) for x, i in enumerate(ids)), key=repr)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("cells", [{}, {"cell_shingles": 300}, {"cell_rows": 4}])
def test_near_duplicates_equal_brute_force(spark, cells):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 150, 400]))] for _ in range(25)]
    rows = [(k, " ".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4])))) for k in range(300)]
    chain = base[1]
    for k in range(300, 330):  # each links to its neighbours only
        chain = edited(rng, chain, 1)
        rows.append((k, " ".join(chain)))
    for k in range(330, 380):  # copies of one original that are farther from each other than from it
        rows.append((k, " ".join(base[2] if k == 377 else edited(rng, base[2], 3))))
    rows += [*((i and 500 + i, t) for i, t in ODD), (400, rows[0][1].upper()), (None, rows[0][1])]
    docs = docs_of(spark, rows).withColumn("d", F.lit(1)).withColumn("component_id", F.lit("x"))
    out = near_dedup.near_duplicates(docs, **cells).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = near_dedup.deduplicated(docs.unionByName(docs.where("doc_id = 1")), **cells)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for i, _, c in brute_components(rows, 85) if c is not None}) and kept.columns == docs.columns


def test_rows_that_share_an_id_stay_apart(spark):
    one, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, one), (1, other), (5, one + " x"), (7, other + " x"), (None, "z " + one), (None, other), (1, one), (2, ""), (2, ""), (None, None), (8, "lone words of a last text here")]
    docs = docs_of(spark, rows).withColumn("kept", F.lit(True))
    found = near_dedup.classes(docs).collect()
    of = {t: {r["class"] for r in found if r.n_shingles == len(shingle_set(t)) and r.component_id == 1} for t in (one, other)}
    assert all(r.component_id == 1 for r in found if r.n_shingles > 50) and len(of[one] | of[other]) == 2
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.deduplicated(docs).collect()), key=repr)
    assert kept == sorted([(1, one), (1, other), (2, ""), (2, ""), (None, None), (8, rows[-1][1])], key=repr)
    mixed_up = docs.where(F.col("doc_id") == 1).withColumn("lang", F.monotonically_increasing_id().cast("string"))
    assert near_dedup.deduplicated(mixed_up).count() == 2  # rows equal in id and text: one stays, always the same
    assert near_dedup.deduplicated(mixed_up).collect() == near_dedup.deduplicated(mixed_up).collect()


def test_linked_pairs_count_shared_shingles():
    rng = np.random.default_rng(8)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(9)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        side, labels = rng.integers(0, 2, 9), rng.integers(0, 6, 9)
        both = bool(side.any()) and not side.all()
        links = {(x, y) for x in range(9) for y in range(x) if labels[x] != labels[y] and (not both or side[x] != side[y]) and 100 * len(np.intersect1d(sets[x], sets[y])) >= 50 * len(np.union1d(sets[x], sets[y]))}
        group = lambda pairs: sorted(sorted(c) for c in _groups(9, pairs))
        found = near_dedup.linked_pairs(np.concatenate(sets), starts, side, 50, labels)
        assert {(max(p), min(p)) for p in found} <= links and group(found) == group(links)


def _groups(n, pairs):
    of = list(range(n))
    for x, y in pairs:
        a, b = of[x], of[y]
        of = [a if z == b else z for z in of]
    return [[k for k in range(n) if of[k] == z] for z in set(of)]


def test_near_duplicates_of_nothing(spark):
    none = docs_of(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.deduplicated(none).count() == 0


def test_tensored_tables_meet():
    for s, low, high in ((0.85, 0.9999, 1), (0.8, 0.998, 1), (0.2, 0, 1e-5)):
        assert low <= (1 - (1 - s**near_dedup.K) ** near_dedup.M) ** 2 <= high


# ---- op7 ------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = [t for _, t in ODD] + ["<|endoftext|>", "a<|endoftext|> <|endoftext|>\n\n b", "it's 12345 …   x", "\t \n", "word " * 600]
    rows = list(enumerate(texts)) + [(0, "again")]
    found = token_counts.token_counts(docs_of(spark, rows).withColumn("n_tokens", F.lit("x")), path).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want and all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert token_counts.token_counts(docs_of(spark, []), path).count() == 0


def test_token_counts_of_sample_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in token_counts.op7_token_counts(spark, DIR).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_remembered_pre_tokens_are_bounded_in_bytes(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(token_counts.TOKENIZER)
    texts = ["zq" * n + " qzx" + str(n) for n in range(1, 400)] + ["y" * 50_000]
    free = token_counts.Counter(path, token_counts.proven(path))
    want = [free.count(t) for t in texts]
    for limit in (0, 20_000):
        monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", limit)
        c = token_counts.Counter(path, token_counts.proven(path))
        assert [c.count(t) for t in texts] == want
        learned = set(c) - set(c.whole)
        assert sum(len(t) + token_counts.ENTRY_BYTES for t in learned) <= limit and bool(learned) == (limit > 0)


def test_unknown_tokenizer_files_are_refused(tmp_path):
    import public_tokenizers

    spec = json.load(open(public_tokenizers.path(token_counts.TOKENIZER), encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.counter(str(tmp_path / "t.json"))


# ---- op8 ------------------------------------------------------------------------------------------


def brute_spans(t):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_spans_go_by_start_then_kind():
    for text, want in (("4111111111111111@x.com", "email:0:22,card:0:16"), ("1.2.3.4@x.com", "email:0:13,ip:0:7"), ("0" * 5_000 + "1.2.3.4", "ip:0:5007"), ("9" * 5_000 + ".2.3.4", "")):
        assert pii.written_spans(pii.base_spans(text)) == want


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = [*"a@.-+1 0255() b_\n", "256", "4644348398010899", "a@b.c", "+1 (706) 555-3138", "192.168.1.1", "é"]
    for _ in range(40_000):
        t = "".join(rng.choices(parts, k=rng.randrange(16)))
        assert pii.base_spans(t) == brute_spans(t)


def test_long_runs_stay_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 50_000):
        assert isinstance(pii.base_spans(t), list)


def test_personal_data(spark):
    texts = [*[t for _, t in ODD], "mail bob@example.com or 10.0.0.1, 300.1.1.1", "call +1 (706) 555-3138 4644348398010899", "call (555) 123-4567 now", "write to john at acme dot com today", "met at nine, 2024-01-02, $100,200"]
    rows = list(enumerate(texts)) + [(0, "again 1.2.3.4")]
    found = pii.personal_data(docs_of(spark, rows).withColumn("spans", F.lit(1))).collect()
    by = {(r.doc_id, r.spans): r for r in found}
    assert len(found) == len(rows)
    for r in found:
        candidates = [t or "" for i, t in rows if i == r.doc_id]
        fits = [t for t in candidates if hashlib.sha256(pii.written_spans(brute_spans(t)).encode()).hexdigest() == r.base_sha256]
        assert fits
        counts = Counter(k for *_, k in brute_spans(fits[0]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert set(filter(None, pii.written_spans(brute_spans(fits[0])).split(","))) <= set(r.spans.split(","))
    added = {r.doc_id: r.spans for r in by.values() if r.n_added}
    assert added == {11: "phone:5:22", 12: "phone:5:19", 13: "email:9:29"}  # 11: both base matches run on into the next number and fail
    assert pii.personal_data(docs_of(spark, [])).count() == 0


def test_crf_on_sentences_not_trained_on():
    crf, rows = pii.model(), pii.labelled_table(200, 99)
    got = crf.decode([pii.features([w for w, _ in r]) for r in rows])
    assert np.mean([g == [y for _, y in r] for g, r in zip(got, rows, strict=True)]) >= 0.95


def added(text):
    return [text[a:b] for a, b, _ in pii.added_spans([(text, pii.base_spans(text))], pii.model())[0]]


def test_entities_after_an_earlier_trigger_are_found():
    for gap in range(1, 14):
        words = " ".join("on the office of Monday we had met for some more of these days".split()[:gap])
        assert added(f"We met at {words} john at example dot com for lunch") == ["john at example dot com"], gap
        assert added(f"In 2024 {words} call 555-123-4567 about lunch") == ["555-123-4567"], gap


def test_windows_hold_each_word_near_a_trigger_once():
    rng = random.Random(3)
    for _ in range(300):
        text = "  ".join(rng.choice(["x", "y,", "z\n", *["at"] * rng.randrange(2), "7"][: rng.randrange(3, 6)]) for _ in range(rng.randrange(60)))
        words = list(re.finditer(r"\S+", text))
        triggers = [k for k, w in enumerate(words) if w[0] in ("at", "7")]
        windows = [spans for _, spans in pii.windows_of(text)]
        assert [s for spans in windows for s in spans] == [w.span() for k, w in enumerate(words) if any(abs(k - t) <= pii.REACH for t in triggers)]
        for t in triggers:
            around = {w.span() for w in words[max(t - pii.REACH, 0) : t + pii.REACH + 1]}
            assert any(around <= set(spans) for spans in windows)


@pytest.mark.parametrize("piece", [pii.PIECE, 50])
def test_long_runs_are_not_cut(monkeypatch, piece):
    monkeypatch.setattr(pii, "PIECE", piece)
    phones = [f"({k:03}) 555-1{k:03}" for k in range(200)]
    assert added(" ".join(f"Tel: {p}" for p in phones)) == phones
    names = [f"na{chr(97 + k % 26)} at ho{chr(97 + k // 26)} dot com" for k in range(150)]
    assert added(" or ".join(names)) == names
    rng = random.Random(7)
    text = " ".join(rng.choice([*phones[:5], *names[:5], "at nine", "2024", "version 1.2", "of the"]) for _ in range(400))
    words = list(re.finditer(r"\S+", text))
    whole = pii.model().decode([pii.features([w[0] for w in words])])[0]
    begins = [w.start() for w, y in zip(words, whole, strict=True) if y % 2]
    found = pii.added_spans([(text, [])], pii.model())[0]
    assert len(found) > 100 and [a for a, *_ in found] == begins


def test_addresses_of_any_suffix_and_phones_of_other_lengths():
    for found in ("john at example dot gov", "john at example dot co dot uk", "john at example dot ch", "john at example dot museum", "john at mail dot example dot com"):
        assert added(f"please do write to {found} about the lunch of today") == [found]
    for found in ("91 123 45 67", "01 23 45 67 89", "0171 12345678"):
        assert added(f"for more of this call {found} before the lunch") == [found]
    for other in ("met at nine on 2024-01-02 with 1234567 units", "we sold 300 at $100,200 in 2023 2024", "version 1.2.3 dot release at noon", "pages 100-200 of 3000"):
        assert added(f"and so {other} of the lunch") == []


def kinds_added(text):
    return [(pii.KINDS[k], text[a:b]) for a, b, k in pii.added_spans([(text, pii.base_spans(text))], pii.model())[0]]


def test_secrets_and_names():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'so token = "{key}" then', f"the api_key: {key} of this", f'and then password = "{key}"!! more'):
        assert kinds_added(text) == [("secret", key)], text
    assert kinds_added("Yesterday Mr. John Smith came by") == [("name", "John Smith")]
    long = "ab12" * 40_000
    assert kinds_added(f"my secret = {long} and so on") == [("secret", long)]
    for text in (f"commit {key} of the day", f"sha256 {key}", "the token of the day was lost", "Dear reader of this", "he named them at will"):
        assert kinds_added(text) == [], text


def test_added_spans_keep_off_base_spans():
    rng = random.Random(2)
    for _ in range(2_000):
        spans = sorted(((a, a + rng.randrange(1, 9), 0) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))), key=lambda x: x[0])
        taken = pii._Taken(spans)
        a = rng.randrange(60)
        b = a + rng.randrange(1, 9)
        assert taken.overlaps(a, b) == any(x < b and a < y for x, y, _ in spans)


def test_crf_slope_is_that_of_the_likelihood():
    """The forward-backward sums against differences of the likelihood, itself against a sum over all label paths."""
    import itertools

    rng, crf = np.random.default_rng(3), pii.Crf()
    crf.emit[:], crf.move[:] = rng.normal(size=crf.emit.shape), rng.normal(size=crf.move.shape)
    windows = [[[int(x) for x in rng.integers(0, 50, 3)] for _ in range(n)] for n in (4, 3, 3, 1)]
    labels = [[0, 1, 2, 0], [3, 4, 0], [0, 0, 7], [5]]
    value = lambda y, w: sum(crf.emit[f, k].sum() for f, k in zip(w, y, strict=True)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False))
    total = 0.0
    for w, gold in zip(windows, labels, strict=True):
        legal = [y for y in itertools.product(range(len(pii.LABELS)), repeat=len(w)) if crf.start[y[0]] and all(crf.allowed[a, b] for a, b in zip(y, y[1:], strict=False))]
        total += np.log(np.exp([value(y, w) for y in legal]).sum()) - value(gold, w)
    loss, by_word, by_move = crf.gradients(windows, labels)
    assert loss == pytest.approx(total)
    for a, b in ((0, 0), (0, 1), (1, 2), (3, 4), (4, 0), (2, 5)):
        crf.move[a, b] += 1e-5
        assert (crf.gradients(windows, labels)[0] - loss) / 1e-5 == pytest.approx(by_move[a, b], abs=1e-3)
        crf.move[a, b] -= 1e-5
    slot, label = windows[0][2][1], 2
    uses = sum(x.count(slot) * row[label] for x, row in zip([x for w in windows for x in w], by_word, strict=True))
    crf.emit[slot, label] += 1e-5
    assert (crf.gradients(windows, labels)[0] - loss) / 1e-5 == pytest.approx(uses, abs=1e-3)


def test_viterbi_is_the_best_path():
    rng, crf = np.random.default_rng(1), pii.Crf()
    crf.emit[:] = rng.normal(size=crf.emit.shape)
    crf.move[:] = rng.normal(size=crf.move.shape)
    windows = [[[int(x) for x in rng.integers(0, 99, 3)] for _ in range(n)] for n in (1, 3, 4)]
    import itertools

    for w, got in zip(windows, crf.decode(windows), strict=True):
        value = lambda y, w=w: sum(crf.emit[f, k].sum() for f, k in zip(w, y, strict=True)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False))
        legal = [y for y in itertools.product(range(len(pii.LABELS)), repeat=len(w)) if crf.start[y[0]] and all(crf.allowed[a, b] for a, b in zip(y, y[1:], strict=False))]
        assert value(got) == pytest.approx(max(map(value, legal)))


# ---- op9 ------------------------------------------------------------------------------------------


def test_licenses(spark):
    notice = dict(reversed(licenses.TEMPLATES))
    long_mit = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    filler = " ".join(f"f{k}" for k in range(333))
    near = long_mit.replace("free of charge", "free of all charge")
    rows = [(1, f"{filler}. {notice['MIT']}"), (2, f"{filler} {long_mit.upper()} {filler}"), (3, near), (4, " ".join(long_mit.split()[:12])), (5, f"{notice['CC-BY-NC-4.0']} x. {notice['GPL-3.0']}"), (6, f"{filler} {notice['GPL-3.0']} {filler} {notice['GPL-3.0']}"), *[(k + 100 if k else None, t) for k, t in ODD]]
    out = {r.doc_id: r for r in licenses.licenses(docs_of(spark, rows).withColumn("licenses", F.lit(0))).collect()}
    assert {k: r.licenses for k, r in out.items() if r.n_licenses} == {1: "MIT", 2: "MIT", 3: "MIT", 5: "CC-BY-NC-4.0,GPL-3.0", 6: "GPL-3.0"} and len(out) == len(rows)
    assert out[6].n_places == 2 and out[1].containment == 1.0 and 0.8 <= out[3].containment < 1
    assert licenses.licenses(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates((("x", "too short"),))


def _license_shingles(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute_licenses(text):
    """(names, places, greatest containment) by every window of every template, no bands; names found in runs at every offset."""
    have, names, places, most, anywhere = _license_shingles(text), set(), 0, 0.0, set()
    for name, template in licenses.TEMPLATES:
        run = _license_shingles(template)
        wanted, reach = set(run), 1
        while reach < len(run):
            reach *= 2
        share = lambda part: len(wanted & set(part)) / len(wanted)  # noqa: B023, E731
        end = 0
        for at in range(0, len(have), reach):
            part = have[at : at + (2 * reach if reach > 1 else 1)]
            if share(part) >= licenses.CONTAINMENT:
                names.add(name)
                most = max(most, share(part))
                if at >= end:
                    places, end = places + 1, at + len(part)
        if any(share(have[at : at + len(run)]) >= licenses.CONTAINMENT for at in range(len(have))):
            anywhere.add(name)
    return ",".join(sorted(names)), places, most, anywhere


def test_licenses_equal_a_scan_of_every_window(spark):
    rng = random.Random(9)
    texts = [None, "", "a b c", "x " * 5_000 + licenses.TEMPLATES[0][1]]
    for _ in range(240):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([["other"], [], [words[k], "more"]])
            parts += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))] + words
        texts.append(rng.choice([" ", "  ", ", "]).join(parts))
    texts += [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    found = {r.doc_id: r for r in licenses.licenses(docs_of(spark, list(enumerate(texts)))).collect()}
    hits = 0
    for i, t in enumerate(texts):
        names, places, most, anywhere = brute_licenses(t)
        assert (found[i].licenses, found[i].n_places, found[i].containment) == (names, places, pytest.approx(most)), i
        assert anywhere <= set(names.split(","))
        hits += bool(names)
    assert 100 < hits < len(texts)


def test_license_retrieval_at_every_offset():
    known = licenses.Templates()
    filler = [f"f{k}" for k in range(200)]
    for name, text in licenses.TEMPLATES:
        for offset in range(0, 70, 3):
            t = pa.array([" ".join(filler[:offset] + text.split() + filler[offset:])])
            part = next(shingles.shingled(t, alnum=True))
            assert name in {known.names[k] for k in known.find(part.shingles)}


# ---- op10 -----------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_rows", [1_000, 7])
def test_fingerprints(spark, range_rows):
    rng = random.Random(12)
    rows = [(3 * k, " ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.choice([3, 8, 60, 500])))) for k in range(60)]
    longest = max((t for _, t in rows), key=len)
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "\U0001f600é x"), (1000, longest + " tail"), (999, longest)]
    out = {r.doc_id: r for r in fingerprints.compared(docs_of(spark, rows).withColumn("k", F.lit(1)), range_rows).collect()}
    order = sorted(rows, reverse=True)
    errors = []
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        edit = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        errors += [r.near_edited - jaccard(t, edit), r.near_next - jaccard(t, following)]
        assert len(r.fingerprint) == (fingerprints.BINS if t.split() else 0) and 0 <= r.near_edited <= 1
    assert len(out) == len(rows) and out[500].fingerprint == out[0].fingerprint and out[1000].near_next > 0.9
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_heads_follow_across_groups(spark, monkeypatch):
    heads = [(k, None if k == 0 else 10 * k) for k in (0, 1, 2, 3, 7, 8, 40)]
    for group in (1, 3, 1_000):
        monkeypatch.setattr(fingerprints, "GROUP_RANGES", group)
        found = {r.k: r.head for r in fingerprints.following_heads(spark.createDataFrame(heads, "k long, head long")).collect()}
        assert found == {k: heads[n - 1][1] for n, (k, _) in enumerate(heads)}


def test_fingerprints_joined_by_id(spark, monkeypatch):
    docs = docs_of(spark, [(k, f"a{k} b{k} c{k % 5} d e f g{k % 3}") for k in range(60)] + [(None, "x y")])
    few = sorted(map(tuple, fingerprints.compared(docs, 7).collect()), key=repr)
    monkeypatch.setattr(fingerprints, "GROUP_RANGES", 2)
    monkeypatch.setattr(fingerprints, "BROADCAST_RANGES", 0)
    assert sorted(map(tuple, fingerprints.compared(docs, 7).collect()), key=repr) == few and len(few) == 61


def test_fingerprints_of_few(spark):
    one = fingerprints.compared(docs_of(spark, [(1, "a b c d e f g h i")])).first()
    assert one.near_next == 1.0 and one.near_edited < 1
    assert fingerprints.compared(docs_of(spark, [])).count() == 0
    twice = fingerprints.compared(docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "x"), (2, "y")]), 2).collect()
    assert len(twice) == 4
    assert len(fingerprints.compared(docs_of(spark, [(k * k * k, f"t {k}") for k in range(50)]), 3).collect()) == 50
