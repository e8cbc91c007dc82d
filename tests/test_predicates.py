import pytest
from pyspark.sql import functions as F

from strataloom.functions import predicates as P
from strataloom.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "want"),
    [("a_test.go", True), ("a.test.ts", True), ("x.SPEC.js", True), ("b.cy.ts", True), ("test_x.py", True), ("contest_x.py", False), ("tests/a.py", True), ("src/__tests__/a.js", True), ("e2e/a.ts", True), ("m.tftest.hcl", True), ("benches/a.rs", True), ("benches/a.go", False), ("src/latest.go", False)],
)
def test_test_files(spark, path, want):
    assert value(spark, P.is_test_file(F.lit(path))) is want


@pytest.mark.parametrize(
    ("file", "name", "lang", "want"),
    [
        ("src/routes/+page.svelte", "x", "svelte", True), ("src/routes/+server.ts", "GET", "typescript", True), ("src/routes/+server.ts", "helper", "go", False), ("app/page.tsx", "default", "tsx", True), ("app/x/route.ts", "POST", "typescript", True),
        ("pages/a.tsx", "getStaticProps", "tsx", True), ("lib/page.tsx", "default", "go", False), ("app/routes/a.tsx", "loader", "tsx", True), ("a.ts", "ngOnInit", "typescript", True), ("a.stories.tsx", "x", "tsx", True), ("a.pb.go", "x", "go", True), ("mock_a.go", "x", "go", True), ("a.go", "x", "go", False),
    ],
)
def test_framework_entries(spark, file, name, lang, want):
    assert value(spark, P.is_framework_entry(F.lit(file), F.lit(name), F.lit(lang))) is want


def test_exported_and_names(spark):
    exported = lambda lang, name, public=False: value(spark, P.is_exported(F.lit(lang), F.lit(name), F.lit(public)))
    assert exported("go", "Éa") and not exported("go", "a") and exported("python", "a") and not exported("python", "_a") and exported("rust", "a", True) and not exported("Rust", "A")
    assert [value(spark, P.is_entry_name(F.lit(n))) for n in ("main", "init", "TestX", "Example", "mainly")] == [True, True, True, True, False]


def test_ignored_paths(spark):
    ignored = lambda p, keep=False: value(spark, P.is_ignored_path(F.lit(p), keep))
    assert ignored("a/node_modules/x.js") and ignored(".git/x") and not ignored("src/.eslintrc") and ignored(".github/w.yml") and not ignored(".github/w.yml", True)


def test_scalars(spark):
    assert value(spark, S.clean_identifier(F.lit('public."Users"'))) == "Users"
    assert [value(spark, S.node_id(F.lit(t))) for t in ("a/b", "1x", "")] == ["a_b", "n1x", "n"]
    assert value(spark, S.participant_id(F.lit("9a"))) == "p_9a"
    assert value(spark, S.label(F.lit('a"<b>`c\nd'))) == "a'b'c d"
    assert value(spark, S.escaped_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert [value(spark, S.tokens_of(F.lit(t))) for t in ("", "abc", "éééé", "x" * 9)] == [1, 1, 2, 2]
    assert [value(spark, S.dirname(F.lit(t), "(root)")) for t in ("a/b/c.go", "c.go")] == ["a/b", "(root)"]
    assert [value(spark, S.extension(F.lit(t))) for t in ("a.b/C.TXT", "a.b/c")] == [".txt", ""]
    assert value(spark, S.line_at(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert value(spark, S.display(F.lit("rust"), F.lit("T"), F.lit("f"))) == "T::f"
    assert value(spark, S.clamp(F.lit(1.5))) == 1.0
