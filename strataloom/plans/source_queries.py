"""Registered queries of the source readers: trees of text made from the sample tables, read by the readers, checked by SQL over the same rows.

Every row of a table becomes a line, call, column or file; the number of files grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import label, line_at, participant_id, snippet
from ..operators import resolve
from ..sources import files as files_
from ..sources import gitlog, manifests, recon, routes, schema, stacks, taggers
from . import tools
from .queries import query
from .relations import read

_ALL = 1 << 30


def _text(template: str, **columns: Column) -> Column:
    """A text with <name> replaced by columns."""
    parts: list[Column] = []
    rest = template
    while "<" in rest:
        before, _, after = rest.partition("<")
        name, closed, after_name = after.partition(">")
        if not closed or name not in columns:
            parts.append(F.lit(before + "<"))
            rest = after
            continue
        parts += [F.lit(before), columns[name].cast("string")]
        rest = after_name
    return F.concat(*parts, F.lit(rest))


def _joined(rows: DataFrame, path: Column, line: Column, order: Column, head: Column, tail: Column) -> DataFrame:
    """(path, content): the lines of a path in order, between its head and tail."""
    lines = rows.select(path.alias("path"), F.struct(order.alias("o"), line.alias("l")).alias("x"), head.alias("head"), tail.alias("tail"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "")
    return lines.groupBy("path").agg(F.concat(F.first("head"), body, F.first("tail")).alias("content"))


def _files(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return files_.from_table(out)


# ---- manifests ---------------------------------------------------------------------------------------


def _manifest_files(spark: SparkSession, d: str) -> DataFrame:
    part, customer, supplier, nation = (read(spark, d, t) for t in ("part", "customer", "supplier", "nation"))
    p, c, s, n = F.col("p_partkey"), F.col("c_custkey"), F.col("s_suppkey"), F.col("n_nationkey")
    group = F.floor(p / 40)
    go_line = _text("\texample.com/p<k> v<z>.0.0<i>\n", k=p, z=F.col("p_size"), i=F.when(F.col("p_size") % 5 == 0, " // indirect").otherwise(""))
    go = _joined(part, _text("go/<g>/go.mod", g=group), go_line, p, _text("module example.com/m<g>\n\ngo 1.22\n\nrequire (\n", g=group), F.lit(")\n"))
    hcl_line = (
        F.when(p % 3 == 0, _text('terraform {\n  required_providers {\n    p<k> = {\n      source  = "org/p<k>" # {\n      version = "~> <z>.0"\n    }\n  }\n}\n', k=p, z=F.col("p_size")))
        .when(p % 3 == 1, _text('module "m<k>" {\n  source  = "reg/m<k>/x"\n  version = "<z>.1"\n  tags = { version = "9" }\n}\n', k=p, z=F.col("p_size")))
        .otherwise(_text('module "near<k>" {\n  source = "../near<k>"\n}\n', k=p))
    )
    tf = _joined(part, _text("tf/<g>/main.tf", g=group), hcl_line, p, F.lit(""), F.lit(""))
    lock = _joined(part, _text("tf/<g>/.terraform.lock.hcl", g=group), _text('provider "reg/p<k>" {\n  version = "<z>.2.0"\n  hashes = ["h1:{"]\n}\n', k=p, z=F.col("p_size")), p, F.lit("# made\n"), F.lit(""))
    app = F.floor(c / 30)
    of_kind = lambda k: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array_sort(F.collect_list(F.when(c % 4 == k, _text('"c<k>": "^<n>.0"', k=c, n=F.col("c_nationkey")))))), ","), F.lit("}"))
    npm = customer.groupBy(app.alias("g")).agg(*(of_kind(k).alias(f"d{k}") for k in range(4)), F.min(app).alias("a"))
    text = _text('{"name":"app<g>","workspaces":["x"],"dependencies":<a>,"devDependencies":<b>,"peerDependencies":<c>,"optionalDependencies":<e>}', g=F.col("g"), a=F.regexp_replace("d0", r"^\{", F.concat(F.lit('{"app'), (F.col("g") - 1).cast("string"), F.lit('":"*",'))), b=F.col("d1"), c=F.col("d2"), e=F.col("d3"))
    npm = npm.select(_text("web/<g>/package.json", g=F.col("g")).alias("path"), text.alias("content"))
    pip_line = (
        F.when(s % 5 == 0, _text("s<k>>=<n>.1  # note\n", k=s, n=F.col("s_nationkey")))
        .when(s % 5 == 1, _text('s<k>[extra]==1.<n> ; python_version < "3"\n', k=s, n=F.col("s_nationkey")))
        .when(s % 5 == 2, _text("-r other<k>.txt\n", k=s))
        .when(s % 5 == 3, _text("  s<k>\n", k=s))
        .otherwise(_text("s<k> @ https://x.invalid/s<k>.whl#sha256=ab\n", k=s))
    )
    pip = _joined(supplier, _text("py/<g>/requirements.txt", g=F.floor(s / 10)), pip_line, s, F.lit("# all\n"), F.lit(""))
    crate_line = (
        F.when(n % 3 == 0, _text('[dependencies.n<k>]\nversion = "1.<k>"\n', k=n))
        .when(n % 3 == 1, _text('[dev-dependencies.n<k>]\nversion = "2.<k>"\n', k=n))
        .otherwise(_text('[target."cfg(unix)".dependencies.n<k>]\nversion = "3.<k>"\noptional = true\n', k=n))
    )
    crate = _joined(nation, _text("rs/<g>/Cargo.toml", g=F.col("n_regionkey")), crate_line, n, _text('[package]\nname = "r<g>"\n', g=F.col("n_regionkey")), F.lit(""))
    return _files(go, tf, lock, npm, pip, crate)


_DEPS = """deps AS (
  SELECT 'go/' || (p_partkey // 40) || '/go.mod' AS manifest, 'Go' AS ecosystem, 'example.com/m' || (p_partkey // 40) AS module, 'example.com/p' || p_partkey AS name, 'v' || p_size || '.0.0' AS version, '' AS kind, false AS optional, false AS dev, p_size % 5 = 0 AS indirect FROM part
  UNION ALL SELECT 'tf/' || (p_partkey // 40) || '/main.tf', 'Terraform/OpenTofu (HCL)', '', CASE p_partkey % 3 WHEN 0 THEN 'org/p' || p_partkey ELSE 'reg/m' || p_partkey || '/x' END, CASE p_partkey % 3 WHEN 0 THEN '~> ' || p_size || '.0' ELSE p_size || '.1' END,
    CASE p_partkey % 3 WHEN 0 THEN 'provider' ELSE 'module' END, false, false, false FROM part WHERE p_partkey % 3 < 2
  UNION ALL SELECT 'tf/' || (p_partkey // 40) || '/.terraform.lock.hcl', 'Terraform', '', 'reg/p' || p_partkey, p_size || '.2.0', 'locked', false, false, false FROM part
  UNION ALL SELECT 'web/' || (c_custkey // 30) || '/package.json', 'JavaScript/TypeScript (npm)', 'app' || (c_custkey // 30), 'c' || c_custkey, '^' || c_nationkey || '.0', (['normal', 'dev', 'peer', 'optional'])[c_custkey % 4 + 1], c_custkey % 4 = 3, c_custkey % 4 = 1, false FROM customer
  UNION ALL SELECT DISTINCT 'web/' || (c_custkey // 30) || '/package.json', 'JavaScript/TypeScript (npm)', 'app' || (c_custkey // 30), 'app' || (c_custkey // 30 - 1), '*', 'normal', false, false, false FROM customer
  UNION ALL SELECT 'py/' || (s_suppkey // 10) || '/requirements.txt', 'Python', '', 's' || s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '>=' || s_nationkey || '.1' WHEN 1 THEN '==1.' || s_nationkey WHEN 3 THEN '' ELSE '@ https://x.invalid/s' || s_suppkey || '.whl#sha256=ab' END, '', false, false, false FROM supplier WHERE s_suppkey % 5 <> 2
  UNION ALL SELECT 'rs/' || n_regionkey || '/Cargo.toml', 'Rust', 'r' || n_regionkey, 'n' || n_nationkey, (n_nationkey % 3 + 1) || '.' || n_nationkey, (['normal', 'dev', 'target'])[n_nationkey % 3 + 1], n_nationkey % 3 = 2, n_nationkey % 3 = 1, false FROM nation)"""


@query("s35_manifest_dependencies", "SELECT manifest, ecosystem, module, name, version, kind, optional, dev FROM deps WHERE NOT indirect", False, _DEPS)
def manifest_dependencies(spark, d):
    found = manifests.manifests(_manifest_files(spark, d), most=_ALL)
    return found.select("manifest", "ecosystem", "module", F.explode("direct").alias("x")).select("manifest", "ecosystem", "module", "x.name", "x.version", "x.kind", "x.optional", "x.dev")


@query("a10_manifest_totals", "SELECT count(*) FILTER (WHERE NOT indirect) AS total_direct, count(*) FILTER (WHERE indirect) AS indirect, count(DISTINCT manifest) AS manifests FROM deps", False, _DEPS)
def manifest_totals(spark, d):
    return manifests.totals(manifests.manifests(_manifest_files(spark, d), most=_ALL)).select(*(F.col(c).cast("long").alias(c) for c in ("total_direct", "indirect", "manifests")))


@query("j23_workspace_dependencies", "SELECT d.manifest, d.name AS dep, string_agg(DISTINCT o.manifest, ',' ORDER BY o.manifest) AS owners FROM deps d JOIN (SELECT DISTINCT manifest, module FROM deps WHERE module <> '') o ON o.module = d.name GROUP BY ALL", False, _DEPS)
def workspace_dependencies(spark, d):
    found = manifests.manifests(_manifest_files(spark, d), most=_ALL)
    return found.select("manifest", F.explode("workspace_deps").alias("w")).select("manifest", "w.dep", F.array_join("w.manifests", ",").alias("owners"))


# ---- schema ------------------------------------------------------------------------------------------


def _ddl(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    table = "CREATE TABLE IF NOT EXISTS public.s<k> (\n  id BIGINT PRIMARY KEY,\n  note VARCHAR(20) DEFAULT '),',\n  nation_id INT NOT NULL REFERENCES \"n<n>\"(id),\n  price DECIMAL(10,2),\n  key_id INT,\n  CONSTRAINT f FOREIGN KEY (price) REFERENCES [s<b>] (id),\n  UNIQUE (note, price)\n);\n"
    suppliers = _joined(read(spark, d, "supplier"), _text("db/<g>.sql", g=F.floor(s / 10)), _text(table, k=s, n=F.col("s_nationkey"), b=s - 1), s, F.lit("-- suppliers (\n"), F.lit(""))
    nations = _joined(read(spark, d, "nation"), F.lit("db/nations.SQL"), _text("create table `n<k>` (id int, region_<r> text, primary key (id));\n", k=n, r=F.col("n_regionkey")), n, F.lit(""), F.lit(""))
    return _files(suppliers, nations)


@query(
    "s45_ddl_columns",
    """SELECT 's' || s_suppkey AS entity, pos, name, type, pk, fk FROM supplier, (VALUES (0, 'id', 'BIGINT', true, false), (1, 'note', 'VARCHAR(20)', false, false), (2, 'nation_id', 'INT', false, true), (3, 'price', 'DECIMAL(10,2)', false, true), (4, 'key_id', 'INT', false, false)) c(pos, name, type, pk, fk)
UNION ALL SELECT 'n' || n_nationkey, 0, 'id', 'int', true, false FROM nation UNION ALL SELECT 'n' || n_nationkey, 1, 'region_' || n_regionkey, 'text', false, false FROM nation""",
)
def ddl_columns(spark, d):
    return schema.entities(_ddl(spark, d), max_files=_ALL)[1]


@query("j20_ddl_relationships", "SELECT 's' || s_suppkey AS \"from\", 'n' || s_nationkey AS \"to\", 'nation_id' AS \"column\" FROM supplier UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey - 1), 'price' FROM supplier WHERE s_suppkey > (SELECT min(s_suppkey) FROM supplier)")
def ddl_relationships(spark, d):
    return schema.entities(_ddl(spark, d), max_files=_ALL)[2]


# ---- routes ------------------------------------------------------------------------------------------


def _route_files(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    templates = [
        ("go/<k>.go", 'package a\n\nfunc f() {\n\tr.Route("/s<k>", func(r chi.Router) {\n\t\tr.Get("/n<n>", h) // r.Get("/no", h)\n\t})\n\tapi := r.Group("/g<k>")\n\tapi.POST("/p", h)\n\tmux.HandleFunc("/w<k>", h)\n\tx := `r.Get("/quoted", h)`\n}\n'),
        ("js/<k>.js", "app.delete('/c<k>', h) // app.get('/no')\nconst s = \"app.get('/quoted')\"\nrouter.put(`/d<k>/:id`, h)\ncache.get('plain')\n"),
        ("py/<k>.py", "@app.route('/o<k>', methods=['GET', \"PUT\"])\ndef a():\n    pass\n\n\n@app.route('/q<k>')\n@app.patch('/v<k>/<id>')\ndef b():\n    pass\n"),
        ("src/routes/(g)/s<k>/[id]/+page.svelte", ""),
        ("src/routes/api<k>/+server.ts", "export const GET = 1\nexport async function DELETE() {}\n"),
        ("app/(x)/n<k>/[...all]/page.tsx", ""),
        ("web/pages/api/k<k>/index.ts", ""),
        ("ng/<k>.ts", "const r = [{ path: 'a<k>', component: X, data: { z: 1 } }, { loadChildren: () => y, path: 'b<k>' }]\n"),
        ("re/<k>.tsx", "const r = [{ path: 'u<k>', element: e }, { path: 'x y', element: e }, { path: '/<n>.png' }]\n"),
        ("js/<k>.test.js", "app.get('/tested', h)\n"),
    ]
    rows = read(spark, d, "supplier")
    return _files(*(rows.select(_text(p, k=s, n=n).alias("path"), _text(t, k=s, n=n).alias("content")) for p, t in templates))


_ROUTES = """FROM supplier, (VALUES
  ('go/K.go', 'GET', '/sK/nN', 5, 'Go nested router group', 'high'), ('go/K.go', 'POST', '/gK/p', 8, 'Go nested router group', 'high'), ('go/K.go', 'ANY', '/wK', 9, 'Go nested router group', 'high'),
  ('js/K.js', 'DELETE', '/cK', 1, 'Express-style routing', 'medium'), ('js/K.js', 'PUT', '/dK/:id', 3, 'Express-style routing', 'medium'),
  ('py/K.py', 'GET', '/oK', 1, 'Flask/Python routing', 'medium'), ('py/K.py', 'PUT', '/oK', 1, 'Flask/Python routing', 'medium'), ('py/K.py', 'GET', '/qK', 6, 'Flask/Python routing', 'medium'), ('py/K.py', 'PATCH', '/vK/<id>', 7, 'Express-style routing', 'medium'),
  ('src/routes/(g)/sK/[id]/+page.svelte', 'GET', '/sK/:id', 1, 'SvelteKit page', 'high'),
  ('src/routes/apiK/+server.ts', 'GET', '/apiK', 1, 'SvelteKit server endpoint', 'high'), ('src/routes/apiK/+server.ts', 'DELETE', '/apiK', 1, 'SvelteKit server endpoint', 'high'),
  ('app/(x)/nK/[...all]/page.tsx', 'GET', '/nK/:all*', 1, 'Next.js App Router Page', 'high'), ('web/pages/api/kK/index.ts', 'ANY', '/api/kK', 1, 'Next.js Pages Router API', 'high'),
  ('ng/K.ts', 'ANY', '/aK', 1, 'Angular Router', 'high'), ('ng/K.ts', 'ANY', '/bK', 1, 'Angular Router', 'high'),
  ('re/K.tsx', 'ANY', '/uK', 1, 'React Router', 'medium'), ('re/K.tsx', 'ANY', '/N.png', 1, 'React Router', 'medium')) t(f, method, p, line, pattern, confidence)"""


@query("s49_routes", f"SELECT method, replace(replace(p, 'K', s_suppkey::VARCHAR), 'N', s_nationkey::VARCHAR) AS path, replace(f, 'K', s_suppkey::VARCHAR) AS file, line, pattern, confidence {_ROUTES}")
def route_calls(spark, d):
    return routes.routes(_route_files(spark, d), _ALL, _ALL).select("method", "path", "file", "line", "pattern", "confidence")


@query("t10_route_limits", "SELECT count(*) * 5 - 3 AS left_out FROM supplier")
def route_limits(spark, d):
    f = _route_files(spark, d).where("path LIKE 'go/%' OR path LIKE 'js/%' OR path LIKE 'py/%' OR path LIKE 'ng/%' OR path LIKE 're/%'")
    return spark.createDataFrame([(routes.left_out(f, 3),)], "left_out long")


# ---- stacks and HCL ------------------------------------------------------------------------------------


def _stack_files(spark: SparkSession, d: str) -> DataFrame:
    s, n, nk = F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_nationkey")
    supplier, nation = read(spark, d, "supplier"), read(spark, d, "nation")
    root = nation.select(_text("live/n<k>/root.hcl", k=nk).alias("path"), _text('remote_state {\n  backend = "b<m>"\n  config = {\n    key = "k<k>/{"\n  }\n}\ninputs = {\n  shared = 1\n}\n', k=nk, m=nk % 3).alias("content"))
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("least"))
    unit = 'include "root" {\n  path = find_in_parent_folders("root.hcl")\n}\nterraform {\n  source = "${get_repo_root()}//mods/m<m>"\n}\ndependency "first" {\n  config_path = "../s<l>"\n  mock_outputs = { id = { x = "}" } }\n}\ninputs = {\n  a<k> = dependency.first.outputs.id\n  z = { deep = 1 }\n}\n'
    units = supplier.join(first, "s_nationkey").select(_text("live/n<n>/s<k>/terragrunt.hcl", n=n, k=s).alias("path"), _text(unit, m=s % 3, l=F.col("least"), k=s).alias("content"))
    tf = supplier.where("s_suppkey % 4 = 0").select(_text("alone/s<k>/main.tf", k=s).alias("path"), _text('terraform {\n  backend "gcs" {\n    key = "k<k>"\n  }\n}\n', k=s).alias("content"))
    return _files(root, units, tf)


@query(
    "s53_stacks",
    """SELECT 'live/n' || s_nationkey || '/s' || s_suppkey AS path, 'terragrunt' AS kind, 'mods/m' || (s_suppkey % 3) AS source, true AS source_local, 'live/n' || s_nationkey || '/root.hcl' AS includes, 'live/n' || s_nationkey || '/s' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS dependencies,
  'b' || (s_nationkey % 3) AS backend, 'k' || s_nationkey || '/{' AS state_key, 'a' || s_suppkey || ',shared,z' AS inputs FROM supplier
UNION ALL SELECT 'alone/s' || s_suppkey, 'terraform-root', '', false, '', '', 'gcs', 'k' || s_suppkey, '' FROM supplier WHERE s_suppkey % 4 = 0""",
)
def stack_units(spark, d):
    lists = [F.array_join(c, ",").alias(c) for c in ("includes", "dependencies", "inputs")]
    return stacks.stacks(_stack_files(spark, d), _ALL).select("path", "kind", "source", "source_local", *lists, "backend", "state_key")


# ---- taggers and the resolver --------------------------------------------------------------------------


def _code_files(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier has a file a language; b is the supplier before it in its nation, null for the first."""
    s, n, b = F.col("s_suppkey"), F.col("s_nationkey"), F.col("b")
    rows = read(spark, d, "supplier").withColumn("b", F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    before = F.coalesce(b, s)
    templates = [
        # in the directory; methods of a type, whose receiver is written out; a name that many files have
        ("go/n<n>/s<k>.go", "package a\n\ntype T<k> struct{}\n\nfunc (t T<k>) Run() {\n\tGo<b>()\n}\n\nfunc Go<k>() {\n\tcommon()\n\tonly<k>()\n}\n\nfunc common() {}\n\nfunc only<k>() {}\n"),
        # in the file, then anywhere
        ("py/n<n>/s<k>.py", "def helper():\n    return 1\n\n\ndef py<k>():\n    helper()\n    return py<b>()\n"),
        # a named, a renamed and a whole import
        ("js/n<n>/s<k>.js", "import { js<b> as before } from './s<b>'\nimport * as all from './s<b>'\nimport { shared } from '../../lib/shared'\nexport function js<k>() {\n  before()\n  shared()\n  all.js<b>()\n}\n"),
        # the receiver of a path, in the file
        ("rs/n<n>/s<k>.rs", "pub struct R<k>;\n\nimpl R<k> {\n    pub fn new() -> Self { R<k> }\n}\n\nfn rs<k>() {\n    let _r = R<b>::new();\n}\n"),
    ]
    files = [rows.select(_text(p, k=s, n=n).alias("path"), _text(t, k=s, n=n, b=before).alias("content")) for p, t in templates]
    lib = spark.createDataFrame([("lib/shared.js", "export function shared() {}\n")], "path string, content string")
    return _files(*files, lib)


_CODE = """c AS (SELECT s_suppkey AS k, s_nationkey AS n, coalesce(lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), s_suppkey) AS b FROM supplier)"""


@query(
    "s11_tagged_symbols",
    """SELECT format(f, k, n) || '::' || format(q, k) AS qname, kind, line, lang FROM c, (VALUES
  ('go/n{1}/s{0}.go', 'T{0}', 'type', 3, 'go'), ('go/n{1}/s{0}.go', 'Run', 'method', 5, 'go'), ('go/n{1}/s{0}.go', 'Go{0}', 'function', 9, 'go'), ('go/n{1}/s{0}.go', 'common', 'function', 14, 'go'), ('go/n{1}/s{0}.go', 'only{0}', 'function', 16, 'go'),
  ('py/n{1}/s{0}.py', 'helper', 'function', 1, 'python'), ('py/n{1}/s{0}.py', 'py{0}', 'function', 5, 'python'), ('js/n{1}/s{0}.js', 'js{0}', 'function', 4, 'javascript')) t(f, q, kind, line, lang)
UNION ALL SELECT 'lib/shared.js::shared', 'function', 1, 'javascript'""",
    False,
    _CODE,
)
def tagged_symbols(spark, d):
    return taggers.symbols(taggers.tag(_code_files(spark, d))).where("lang <> 'rust'").select("qname", "kind", "line", "lang")


@query(
    "j1_resolved_code",
    """SELECT DISTINCT * FROM (
SELECT format('go/n{1}/s{0}.go::Run', k, n) AS src, format('go/n{1}/s{0}.go::Go{0}', b, n) AS dst FROM c
UNION ALL SELECT format('go/n{1}/s{0}.go::Go{0}', k, n), format('go/n{1}/s{0}.go::common', k, n) FROM c
UNION ALL SELECT format('go/n{1}/s{0}.go::Go{0}', k, n), format('go/n{1}/s{0}.go::only{0}', k, n) FROM c
UNION ALL SELECT format('py/n{1}/s{0}.py::py{0}', k, n), format('py/n{1}/s{0}.py::helper', k, n) FROM c
UNION ALL SELECT format('py/n{1}/s{0}.py::py{0}', k, n), format('py/n{1}/s{0}.py::py{0}', b, n) FROM c WHERE b <> k
UNION ALL SELECT format('js/n{1}/s{0}.js::js{0}', k, n), format('js/n{1}/s{0}.js::js{0}', b, n) FROM c WHERE b <> k
UNION ALL SELECT format('js/n{1}/s{0}.js::js{0}', k, n), 'lib/shared.js::shared' FROM c
UNION ALL SELECT format('rs/n{1}/s{0}.rs::rs{0}', k, n), format('rs/n{1}/s{0}.rs::new', b, n) FROM c) WHERE src <> dst""",
    False,
    _CODE,
)
def resolved_code(spark, d):
    files = _code_files(spark, d)
    rows = taggers.tag(files)
    return resolve.edges_of(resolve.resolve(taggers.references(rows), taggers.symbols(rows), taggers.imports(rows, files))).select("src", "dst")


@query("j10_import_targets", "SELECT format('js/n{1}/s{0}.js', k, n) AS file, alias, CASE alias WHEN 'shared' THEN 'lib/shared.js' ELSE format('js/n{1}/s{0}.js', b, n) END AS target_file, CASE alias WHEN 'all' THEN '*' WHEN 'shared' THEN 'shared' ELSE 'js' || b END AS target_name FROM c, (VALUES ('before'), ('all'), ('shared')) t(alias)", False, _CODE)
def import_targets(spark, d):
    files = _code_files(spark, d)
    return taggers.imports(taggers.tag(files), files).where("file LIKE 'js/%'").select("file", "alias", "target_file", "target_name")


# ---- files and the index -------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files before and after: of every tenth the text changes, every seventh goes, every eleventh is new."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders")
    old = o.where(k % 11 != 0).select(_text("f<k>.go", k=k).alias("path"), _text("// <s>\n", s=F.col("o_orderstatus")).alias("content"))
    new = o.where(k % 7 != 0).select(_text("f<k>.go", k=k).alias("path"), _text("// <s><n>\n", s=F.col("o_orderstatus"), n=F.when(k % 10 == 0, "new").otherwise("")).alias("content"))
    return files_.from_table(old), files_.from_table(new)


@query("s7_changed_files", "SELECT 'f' || o_orderkey || '.go' AS path, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 10 = 0 THEN 'tag' ELSE 'keep' END AS what FROM orders WHERE o_orderkey % 7 <> 0")
def changed_files(spark, d):
    old, new = _versions(spark, d)
    tag, keep = files_.split_changes(new, old)
    return tag.select("path", F.lit("tag").alias("what")).unionByName(keep.select("path", F.lit("keep").alias("what")))


@query("s4_languages", """SELECT page_id, (['go', 'python', 'tsx', 'hcl', NULL, 'dockerfile', NULL])[page_id % 7 + 1] AS lang, page_id % 7 NOT IN (4, 6) AND strlen(html) <= 4194304 AS indexed, page_id % 7 <> 2 AND page_id % 7 <> 6 AS kept FROM pages""")
def languages(spark, d):
    names = F.lit(["a.go", "b.py", "node_modules/c.TSX", "d.tofu", "e.unknown", "Dockerfile", ".git/f"])
    p = read(spark, d, "pages").select("page_id", F.get(names, F.pmod("page_id", F.lit(7)).cast("int")).alias("name"), "html")
    f = files_.from_table(p.select(F.concat(F.col("page_id").cast("string"), F.lit("/"), "name").alias("path"), F.col("html").alias("content")))
    from ..functions import predicates as P

    number = F.substring_index("path", "/", 1).cast("long")
    known = files_.indexable(f).select(F.col("path").alias("p"))
    out = f.join(known, f["path"] == known["p"], "left")
    return out.select(number.alias("page_id"), "lang", F.col("p").isNotNull().alias("indexed"), (~P.is_ignored_path(F.col("path"))).alias("kept"))


@query("s25_pattern_symbols", "SELECT 'r' || s_suppkey || '.rb::' || q AS qname, line FROM supplier, (VALUES ('A', 1), ('b', 2), ('b#5', 5)) t(q, line) UNION ALL SELECT 'j' || s_suppkey || '.java::X' || s_suppkey, 2 FROM supplier")
def pattern_symbols(spark, d):
    s = read(spark, d, "supplier")
    rb = s.select(_text("r<k>.rb", k=F.col("s_suppkey")).alias("path"), F.lit("class A\n  def b\n  end\n\n  def b\n  end\nend\n").alias("content"))
    java = s.select(_text("j<k>.java", k=F.col("s_suppkey")).alias("path"), _text("\npublic class X<k> {}\n", k=F.col("s_suppkey")).alias("content"))
    return files_.pattern_symbols(_files(rb, java)).select("qname", "line")


# ---- version control -----------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """(log, line_no, line): a log a customer group, an order a commit, a line of it a file."""
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("log"), "o_custkey", "o_orderdate")
    head = o.select("log", (F.col("o_orderkey") * 100).alias("line_no"), _text("\x1f<a>\x1f<t>", a=F.col("o_custkey"), t=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("line"))
    li = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    adds = F.when(F.col("l_linenumber") == 4, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    stat = li.select("log", (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), _text("<a>\t<b>\tp/<k>\t.go", a=adds, b=F.col("l_linenumber"), k=F.col("l_partkey")).alias("line"))
    return head.unionByName(stat)


@query(
    "s29_log_text",
    """, seq AS (SELECT o_orderkey, o_custkey, o_custkey % 40 AS log, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS commit_seq, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT log, commit_seq, o_custkey::VARCHAR AS author, day, count(*)::BIGINT AS files, sum(CASE WHEN l_linenumber = 4 THEN 0 ELSE l_quantity::INTEGER END)::BIGINT AS adds, sum(l_linenumber)::BIGINT AS dels, min('p/' || l_partkey || chr(9) || '.go') AS least
FROM seq JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def log_text(spark, d):
    commits, stats = gitlog.parse_log(_log(spark, d), "log")
    sums = stats.groupBy("log", "commit_seq").agg(F.count("*").alias("files"), F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), F.min("path").alias("least"))
    return commits.select("log", "commit_seq", "author", F.substring("date", 1, 10).alias("day")).join(sums, ["log", "commit_seq"])


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """(diff, line_no, line): a diff a customer, a file an order: changed, new, deleted or moved."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    kinds = [
        "diff --git a/f<k>.go b/f<k>.go\nindex 1..2 100644\n--- a/f<k>.go\n+++ b/f<k>.go\n@@ -5 +<s>,3 @@ func x\n+++ b/not\n-y\n@@ -20,2 +<t>,0 @@",
        "diff --git a/f<k>.go b/f<k>.go\nnew file mode 100644\n--- /dev/null\n+++ b/f<k>.go\n@@ -0,0 +1,<s> @@\n+a",
        "diff --git a/f<k>.go b/f<k>.go\ndeleted file mode 100644\n--- a/f<k>.go\n+++ /dev/null\n@@ -1,<s> +0,0 @@\n-a",
        "diff --git a/old<k>.go b/new/f<k>.go\nsimilarity index 90%\nrename from old<k>.go\nrename to new/f<k>.go\n--- a/old<k>.go\n+++ b/new/f<k>.go\n@@ -1 +<s> @@\n+a",
    ]
    start = k % 50 + 1
    text = F.get(F.array(*(_text(t, k=k, s=start, t=start + 100) for t in kinds)), F.pmod(k, F.lit(4)).cast("int"))
    lines = o.select(F.col("o_custkey").alias("diff"), k.alias("k"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return lines.select("diff", (F.col("k") * 100 + F.col("n")).alias("line_no"), "line")


@query("s31_diff_files", "SELECT o_custkey AS diff, CASE o_orderkey % 4 WHEN 3 THEN 'new/' ELSE '' END || 'f' || o_orderkey || '.go' AS path, (['M', 'A', 'D', 'R'])[o_orderkey % 4 + 1] AS status FROM orders")
def diff_files(spark, d):
    return gitlog.parse_diff(_diffs(spark, d), "diff")[0]


@query(
    "s34_diff_hunks",
    """, o AS (SELECT *, o_orderkey % 50 + 1 AS s FROM orders)
SELECT o_custkey AS diff, CASE o_orderkey % 4 WHEN 3 THEN 'new/' ELSE '' END || 'f' || o_orderkey || '.go' AS path, a::INTEGER AS start, b::INTEGER AS "end" FROM (
  SELECT *, s AS a, s + 2 AS b FROM o WHERE o_orderkey % 4 = 0 UNION ALL SELECT *, s + 100, s + 100 FROM o WHERE o_orderkey % 4 = 0
  UNION ALL SELECT *, 1, s FROM o WHERE o_orderkey % 4 = 1 UNION ALL SELECT *, s, s FROM o WHERE o_orderkey % 4 = 3)""",
)
def diff_hunks(spark, d):
    return gitlog.parse_diff(_diffs(spark, d), "diff")[1].select("diff", "path", "start", "end")


@query("a12_hunks_of_diffs", "SELECT CASE o_orderkey % 4 WHEN 3 THEN 'new/' ELSE '' END || 'f' || o_orderkey || '.go' AS path, (['M', 'A', 'D', 'R'])[o_orderkey % 4 + 1] AS status, ([2, 1, 0, 1])[o_orderkey % 4 + 1]::BIGINT AS hunks FROM orders")
def hunks_of_diffs(spark, d):
    files, hunks = gitlog.parse_diff(_diffs(spark, d), "diff")
    return tools.listed_changes(files, hunks)


# ---- a first look --------------------------------------------------------------------------------------


_NAMES = "go.mod main.go x_test.go Makefile next.config.js main.tf versions.tf .gitlab-ci.yml Dockerfile lib.rs server.test.ts policy.rego manage.py terragrunt.hcl tailwind.config.js plain.txt".split()


def _tree(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.get(F.lit(_NAMES), F.pmod(k, F.lit(len(_NAMES))).cast("int"))
    return files_.from_table(read(spark, d, "part").select(F.concat(F.lit("d"), F.floor(k / 64).cast("string"), F.lit("/"), name).alias("path"), _text("let x<k> = y.unwrap();\n", k=k).alias("content")))


@query(
    "s54_facets",
    f"""SELECT facet, label, count(*)::BIGINT AS files FROM (
  SELECT facet, CASE label WHEN 'PATH' THEN 'd' || (p_partkey // 64) || '/' || n WHEN 'DIR' THEN 'd' || (p_partkey // 64) ELSE label END AS label FROM (SELECT *, ([{", ".join(f"'{n}'" for n in _NAMES)}])[p_partkey % {len(_NAMES)} + 1] AS n FROM part) JOIN (VALUES
    ('go.mod', 'ecosystem', 'Go'), ('go.mod', 'manifest', 'PATH'), ('main.go', 'entry_point', 'PATH'), ('x_test.go', 'test_layout', 'DIR'), ('Makefile', 'tooling', 'Make'), ('next.config.js', 'framework', 'Next.js'), ('main.tf', 'ecosystem', 'Terraform (HCL)'), ('main.tf', 'entry_point', 'PATH'),
    ('versions.tf', 'ecosystem', 'Terraform (HCL)'), ('versions.tf', 'manifest', 'PATH'), ('.gitlab-ci.yml', 'tooling', 'GitLab CI'), ('Dockerfile', 'tooling', 'Docker'), ('server.test.ts', 'test_layout', 'DIR'), ('policy.rego', 'tooling', 'OPA/Conftest policies (Rego)'), ('manage.py', 'framework', 'Django'),
    ('terragrunt.hcl', 'ecosystem', 'Terragrunt'), ('terragrunt.hcl', 'manifest', 'PATH'), ('terragrunt.hcl', 'framework', 'Terragrunt'), ('terragrunt.hcl', 'entry_point', 'PATH'), ('tailwind.config.js', 'framework', 'Tailwind')) t(m, facet, label) ON m = n) GROUP BY ALL""",
)
def facets(spark, d):
    return recon.facets(_tree(spark, d)).groupBy("facet", "label").agg(F.count("*").alias("files"))


@query("t16_risk_hints", "SELECT 'd' || (p_partkey // 64) || '/lib.rs' AS file, 1 AS line, 'unwrap' AS label FROM part WHERE p_partkey % 16 = 9 ORDER BY file LIMIT 20")
def risk_hints(spark, d):
    return recon.risk_hints(_tree(spark, d))


@query("a9_top_extensions", "SELECT lower(regexp_extract(n, '(\\.[^.]*)$', 1)) AS ext, count(*)::BIGINT AS n FROM (SELECT (['" + "', '".join(_NAMES) + f"'])[p_partkey % {len(_NAMES)} + 1] AS n FROM part) WHERE ext <> '' GROUP BY ext ORDER BY 2 DESC, 1 LIMIT 5")
def top_extensions(spark, d):
    return recon.top_extensions(_tree(spark, d), 5)


@query("t6_folder_tree", "SELECT 'd' || (p_partkey // 64) AS dir, count(*)::BIGINT AS files FROM part GROUP BY ALL")
def folder_tree(spark, d):
    return recon.folder_tree(_tree(spark, d))


# ---- texts -----------------------------------------------------------------------------------------------


@query("f5_diagram_names", """SELECT p_partkey, CASE WHEN regexp_matches(raw, '^[0-9]') THEN 'p_' ELSE '' END || regexp_replace(raw, '[^A-Za-z0-9_]', '_', 'g') AS id, replace(replace(replace(raw, '"', ''''), '<', ''), '>', '') AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '' ELSE '' END || p_name || '"<' || p_brand || '>' AS raw FROM part)""")
def diagram_names(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(""), "p_name", F.lit('"<'), "p_brand", F.lit(">"))
    return read(spark, d, "part").select("p_partkey", participant_id(raw).alias("id"), label(raw).alias("label"))


@query("f7_line_of_offset", "SELECT doc_id, len(string_split(left(text, length(text) // 2), chr(10)))::INTEGER AS line FROM documents WHERE text IS NOT NULL")
def line_of_offset(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", line_at(F.col("text"), F.floor(F.char_length("text") / 2).cast("int")).cast("int").alias("line"))


@query("k7_snippets", "SELECT doc_id, array_to_string((string_split(text, chr(10)))[2:4], chr(10)) AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))
