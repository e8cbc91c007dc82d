"""Boolean and label expressions over symbols and paths."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import basename, dirname, file_of

# Fixed values.
HTTP_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")
TEST_FOLDERS = ("tests", "__tests__", "e2e", "cypress", "playwright")
ANGULAR_HOOKS = ("ngOnInit", "ngOnChanges", "ngDoCheck", "ngAfterContentInit", "ngAfterContentChecked", "ngAfterViewInit", "ngAfterViewChecked", "ngOnDestroy")
REVIEWABLE_KINDS = ("function", "method", "type", "class", "interface", "constructor")
IGNORED_FOLDERS = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv", "coverage", "bin", "obj")
JS_LANGS = ("javascript", "typescript", "tsx")


def _any(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def _under(path: Column, *folders: str) -> Column:
    return F.concat(F.lit("/"), path, F.lit("/")).rlike("/(?:" + "|".join(folders) + ")/")


def _capital(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def is_route_test_file(path: Column) -> Column:
    base = F.lower(basename(path))
    return _any(
        basename(path).endswith("_test.go"),
        base.rlike(r"\.(?:test|spec|cy)\."),
        base.startswith("test_"),
        base.endswith("_test"),
        base.rlike(r"\.(?:tf|tofu)test\.hcl$"),
        _under(F.lower(path), *TEST_FOLDERS),
    )


def is_test_file(path: Column) -> Column:
    return is_route_test_file(path) | (basename(path).endswith(".rs") & _under(F.lower(path), "benches"))


def is_test_qname(qname: Column, test: Column) -> Column:
    """test: the symbol's own flag, null where qname has no symbol."""
    return is_test_file(file_of(qname)) | F.coalesce(test, F.lit(False))


def is_entry_name(name: Column) -> Column:
    return name.rlike("^(?:main|init)$|^(?:Test|Benchmark|Fuzz|Example)")


def is_svelte_entry(file: Column, name: Column) -> Column:
    base = basename(file)
    component = base.endswith(".svelte") & base.rlike(r"\+(?:page|layout)")
    module = base.rlike(r"^\+(?:page|layout|server)\.") & name.isin("load", "actions", "default", *HTTP_VERBS)
    return component | module


def is_next_entry(file: Column, name: Column) -> Column:
    base, shown = basename(file), (name == "default") | _capital(name)
    special = base.rlike(r"^(?:(?:page|layout)\.[jt]sx?|(?:error|loading|not-found)\.tsx)$") & shown
    handler = base.isin("route.ts", "route.js") & name.isin(*HTTP_VERBS)
    page = _under(file, "pages") & (shown | name.isin("getServerSideProps", "getStaticProps", "getStaticPaths"))
    return (_under(file, "app", "pages") & (special | handler)) | page


def is_remix_entry(file: Column, name: Column, lang: Column) -> Column:
    return lang.isin(*JS_LANGS) & F.concat(F.lit("/"), file).contains("/routes/") & (name.isin("loader", "action", "headers", "meta", "default") | _capital(name))


def is_storybook(file: Column) -> Column:
    return F.lower(basename(file)).rlike(r"\.(?:stories|story)\.")


def is_generated(file: Column) -> Column:
    return F.lower(basename(file)).rlike(r"\.pb\.go|\.gen\.|generated|^mock_")


def is_framework_entry(file: Column, name: Column, lang: Column) -> Column:
    return _any(is_svelte_entry(file, name), is_next_entry(file, name), is_remix_entry(file, name, lang), name.isin(*ANGULAR_HOOKS), is_storybook(file), is_generated(file))


def is_weak_lead(file: Column, name: Column, lang: Column) -> Column:
    """React components, Angular files and public entry files: reached in ways that no call shows."""
    base = F.lower(basename(file))
    component = lang.isin(*JS_LANGS, "svelte") & _capital(name)
    return _any(component, base.rlike(r"\.(?:component|service|module|directive|pipe)\."), base.rlike(r"^(?:index\.[jt]sx?|lib\.go)$"))


def is_exported(lang: Column, name: Column, public: Column) -> Column:
    return F.when(F.lower(lang) == "rust", F.coalesce(public, F.lit(False))).when(F.lower(lang) == "go", _capital(name)).otherwise(~name.startswith("_"))


def callable_kind(kind: Column, recv: Column) -> Column:
    return F.when(F.coalesce(recv, F.lit("")) != "", "method").otherwise(kind)


def orphan_confidence(kind: Column, exported: Column, precise: bool) -> Column:
    return F.when(kind == "method", F.lit("medium" if precise else "low")).when(exported, "medium").otherwise("high")


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)


def is_reviewable(kind: Column) -> Column:
    return kind.isin(*REVIEWABLE_KINDS)


def has_lang(langs: Column, lang: str) -> Column:
    return F.exists(langs, lambda x: F.lower(x) == lang.lower())


def is_ignored_path(path: Column, keep_github: bool = False) -> Column:
    """A folder of the path is an ignored one or starts with a dot (scanners keep .github)."""
    folders = F.split(dirname(path), "/")

    def bad(x: Column) -> Column:
        dotted = x.startswith(".") & (x != ".github") if keep_github else x.startswith(".")
        return x.isin(*IGNORED_FOLDERS) | dotted

    return F.exists(folders, bad)
