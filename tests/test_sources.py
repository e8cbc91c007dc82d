import datetime as dt
import subprocess

import pytest

from strataloom.plans.tools import Repository, build_graph
from strataloom.sources import files as files_
from strataloom.sources import gitlog, guide, hcl, lexical, manifests, recon, routes, schema, stacks, taggers
from strataloom.streaming.incremental import index_stream


def repo(spark, rows, **more):
    return Repository(spark, files=files_.from_rows(spark, rows), **more)


APP = {"app.go": "package app\n\nfunc helper() {}\n\nfunc Run() { helper() }\n\nfunc Main() { Run() }\n", "app_test.go": "package app\nfunc TestRun() { Run() }\n"}


def edges(spark, rows):
    return {tuple(e)[:2] for e in build_graph(files_.from_rows(spark, rows)).edges.collect()}


def test_go_graph_and_tools(spark):
    r = repo(spark, APP)
    assert {tuple(e)[:2] for e in r.graph.edges.collect()} == {("app.go::Main", "app.go::Run"), ("app.go::Run", "app.go::helper"), ("app_test.go::TestRun", "app.go::Run")}
    t = r.trace_flow("Main", 4, "mermaid")
    assert [x.qname for x in t["nodes"].collect()] == ["app.go::Main", "app.go::Run", "app.go::helper"] and not t["truncated"]
    assert "app_go__Main->>app_go__Run: Run" in t["mermaid"]
    i = r.impact("helper")
    assert i["impacted_count"] == 3 and [x.qname for x in i["at_risk_tests"].collect()] == ["app_test.go::TestRun"]
    p = r.context_pack("Main")
    got = {x.qname: x.distance for x in p["items"].collect()}
    assert got["app.go::Main"] == 0 and got["app.go::Run"] == 1 and got["app.go::helper"] == 2 and p["pack"].startswith("// app.go:7")
    tight = r.context_pack("Main", 1)
    assert tight["included"] == 1 and tight["truncated"]
    assert [x.distance for x in r.context_pack("app.go")["items"].collect() if x.file == "app.go"] == [0, 0, 0]
    m = r.repo_map()
    assert m["map"].startswith("app.go\n  :3     function helper  (callers: 1)\n") and m["included"] == 4
    assert [x.symbol for x in r.dead_code()["orphans"].collect()] == ["Main"]
    with pytest.raises(ValueError):
        r.impact("")
    assert r.impact("nothing-like-it")["matched_symbol"] is None


def test_explain_diff_with_deleted_file(spark):
    diff = "diff --git a/app.go b/app.go\n--- a/app.go\n+++ b/app.go\n@@ -3 +3 @@\n-x\n+y\ndiff --git a/gone.go b/gone.go\ndeleted file mode 100644\n--- a/gone.go\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b"
    out = repo(spark, APP).explain_diff("b", diff=gitlog.numbered_lines(spark, diff), base_files=files_.from_rows(spark, {"gone.go": "func Gone() {}\n"}))
    assert [(x.qname, x.impacted_count) for x in out["changed_symbols"].collect()] == [("app.go::helper", 3), ("gone.go::Gone", 0)]
    assert [tuple(x) for x in out["changed_files"].collect()] == [("app.go", "M", 1), ("gone.go", "D", 0)]


def test_directory_map_renders(spark):
    rows = {"a/x.go": "func A() { B() }\n", "b/y.go": "func B() {}\n"}
    text = repo(spark, rows).render_map("t<p>", "mermaid")["content"]
    assert "  a --> b\n" in text and "%%   a = a/x.go" in text
    page = repo(spark, rows).render_map("t<p>")["content"]
    assert "<title>t&lt;p&gt;</title>" in page and "__" not in page.split("<script>")[0]


def test_javascript_tagger(spark):
    rows = {
        "src/util.ts": "export function help(a: number) { return a }\nexport const arrow = async (x) => help(x)\nexport interface Shape {}\n",
        "src/app.tsx": "import Main, { help as h } from './util'\nimport * as ns from '@/util'\nclass Box {\n  open() { this.shut(); h(1); ns.arrow(2) }\n  shut() {}\n}\nfunction App() { return <Widget /> } // help()\nfunction Widget() {}\nconst s = 'help()'\n",
    }
    got = edges(spark, rows)
    assert {("src/app.tsx::open", "src/app.tsx::shut"), ("src/app.tsx::open", "src/util.ts::help"), ("src/app.tsx::open", "src/util.ts::arrow"), ("src/app.tsx::App", "src/app.tsx::Widget"), ("src/util.ts::arrow", "src/util.ts::help")} <= got
    assert not any(a == "src/app.tsx::(top-level)" and b.endswith("::help") for a, b in got)


def test_rust_tagger(spark):
    rows = {"src/lib.rs": "pub struct Pump<'a> { x: &'a str }\nimpl<'a> Pump<'a> {\n    pub fn new() -> Self { Self::seal() }\n    fn seal() {}\n}\nimpl Drop for Pump<'_> {\n    fn drop(&mut self) { self.log() }\n}\nfn run() { Pump::new(); }\n#[test]\nfn checks() { run() }\n"}
    g = build_graph(files_.from_rows(spark, rows))
    by = {x.qname: x for x in g.symbols.collect()}
    assert by["src/lib.rs::new"].recv == "Pump" and by["src/lib.rs::new"].public and by["src/lib.rs::drop"].recv == "Pump as Drop" and by["src/lib.rs::checks"].test
    got = {tuple(e)[:2] for e in g.edges.collect()}
    assert {("src/lib.rs::new", "src/lib.rs::seal"), ("src/lib.rs::run", "src/lib.rs::new"), ("src/lib.rs::checks", "src/lib.rs::run")} <= got


def test_python_svelte_html(spark):
    rows = {
        "a.py": "class A:\n    def go(self):\n        return helper()\n\ndef helper():\n    pass\n\ndef helper():\n    pass\n",
        "V.svelte": "<script>\nimport { f } from './f'\nfunction local() { f() }\n</script>\n<button on:click={local}>{f}</button>\n",
        "f.js": "export function f() {}\n",
        "c.html": "<b (click)=\"open($event)\">{{ shown }}</b>",
        "c.ts": "function open() {}\nfunction shown() {}\n",
        "bad.py": "def broken(:\n",
    }
    g = build_graph(files_.from_rows(spark, rows))
    names = {x.qname for x in g.symbols.collect()}
    assert {"a.py::go", "a.py::helper", "a.py::helper#8", "V.svelte::default", "V.svelte::V", "V.svelte::local"} <= names
    got = {tuple(e)[:2] for e in g.edges.collect()}
    assert {("V.svelte::local", "f.js::f"), ("V.svelte::(top-level)", "V.svelte::local"), ("c.html::(top-level)", "c.ts::open"), ("c.html::(top-level)", "c.ts::shown")} <= got


HCL = {
    "root.hcl": '# state of every unit\nremote_state {\n  backend = "s3"\n  config = {\n    bucket = "b"\n  }\n}\n',
    "parts/network/inputs.tf": 'variable "zones" {}\n',
    "parts/network/plan.tf": "locals {\n  wide = { for z in var.zones : z => { size = 1 } }\n}\n",
    "parts/network/results.tf": 'output "wide_zones" {\n  value = local.wide\n}\n',
    "parts/alarms/all.tf": 'variable "zones" {}\nresource "pager_rule" "late" {\n  for_each = var.zones\n}\n',
    "parts/shop/unused.tf": 'variable "never_read" {}\n',
    "parts/shop/all.tf": 'variable "tier" {}\nmodule "network" {\n  source = "../network"\n  zones  = var.tier\n}\nmodule "alarms" {\n  source = "../alarms"\n  zones  = module.network.wide_zones\n}\n',
    "live/north/base/terragrunt.hcl": "inputs = {}\n",
    "live/north/shop/terragrunt.hcl": 'include "top" {\n  path = find_in_parent_folders("root.hcl")\n}\nterraform {\n  source = "${get_repo_root()}//parts/shop"\n}\ndependency "base" {\n  config_path = "../base"\n  mock_outputs = {\n    id = "{"\n  }\n}\ninputs = {\n  tier = dependency.base.outputs.id\n}\n',
}


def test_hcl_graph(spark):
    g = build_graph(files_.from_rows(spark, HCL))
    got = {tuple(e)[:2] for e in g.edges.collect()}
    shop, net, unit = "parts/shop/all.tf", "parts/network", "live/north/shop/terragrunt.hcl"
    want = {
        (f"{shop}::module.network", f"{net}/inputs.tf::var.zones"),
        (f"{shop}::module.alarms", "parts/alarms/all.tf::var.zones"),
        (f"{shop}::module.alarms", f"{shop}::module.network"),
        (f"{shop}::module.alarms", f"{net}/results.tf::output.wide_zones"),
        (f"{net}/results.tf::output.wide_zones", f"{net}/plan.tf::local.wide"),
        (f"{net}/plan.tf::local.wide", f"{net}/inputs.tf::var.zones"),
        (f"{unit}::shop", "root.hcl::root"),
        (f"{unit}::shop", f"{shop}::var.tier"),
        (f"{unit}::shop", f"{unit}::dependency.base"),
        (f"{unit}::dependency.base", "live/north/base/terragrunt.hcl::base"),
    }
    assert want <= got, want - got
    from strataloom.operators.changes import dead_code

    dead = {x.qname: x.confidence for x in dead_code(g.symbols, g.edges).collect()}
    assert dead["parts/shop/unused.tf::var.never_read"] == "high"
    assert f"{net}/inputs.tf::var.zones" not in dead and not any("module." in q or "pager_rule" in q for q in dead)


def test_hcl_blocks():
    text = 'a = "x"\nb "l" "m" {\n  c = { d = "}" , e = "f" } // g\n  h = [\n    1, "{",\n  ]\n  i { j = "${k("l")}" }\n  /* n = "o" */\n}\nz = foo("p", { q = 1 })\n'
    top = hcl.read(text)
    b = top.of("b")[0]
    assert top.literal("a") == "x" and b.labels == ["l", "m"] and b.object("c").values == [("d", '"}"'), ("e", '"f"')]
    assert b.expression("h").startswith("[") and b.expression("h").endswith("]") and b.of("i")[0].literal("j") == '${k("l")}' and b.inner_literal("e") == "f"
    assert top.expression("z") == 'foo("p", { q = 1 })' and not b.literal("n") and [x.kind for x in top.everywhere("i")] == ["i"]
    assert hcl.parent_folder_file('find_in_parent_folders("r.hcl")') == "r.hcl" and hcl.parent_folder_file("find_in_parent_folders()") == "" and hcl.parent_folder_file('"${find_in_parent_folders("a")}"') == "a" and hcl.parent_folder_file('"x"') is None
    assert hcl.read("a {").blocks[0].kind == "a" and hcl.read("} } = {").blocks == [] and hcl.read("").values == []


def test_terraform_manifests(spark):
    rows = {
        "a/versions.tf": 'terraform {\n  required_version = ">= 1.5"\n  required_providers {\n    aws = {\n      source  = "hashicorp/aws"\n      version = "~> 5.0" # five\n    }\n    null = { source = "hashicorp/null", version = "3.2" }\n  }\n}\nmodule "near" {\n  source = "./near"\n}\nmodule "far" {\n  source  = "org/far/aws"\n  version = "1.2.3"\n  tags = { version = "no" }\n}\n',
        "b/.terraform.lock.hcl": 'provider "registry.terraform.io/hashicorp/aws" {\n  version = "5.1.0"\n  hashes = [\n    "h1:{x",\n  ]\n}\n',
        "c/terragrunt.hcl": 'terraform {\n  source = "git::https://example.invalid/m.git?ref=v1"\n}\n',
    }
    by = {m.manifest: m for m in manifests.manifests(files_.from_rows(spark, rows)).collect()}
    deps = lambda m: [(d.name, d.version, d.kind) for d in by[m].direct]
    assert deps("a/versions.tf") == [("hashicorp/aws", "~> 5.0", "provider"), ("hashicorp/null", "3.2", "provider"), ("org/far/aws", "1.2.3", "module")] and by["a/versions.tf"].engines == {"terraform": ">= 1.5"}
    assert deps("b/.terraform.lock.hcl") == [("registry.terraform.io/hashicorp/aws", "5.1.0", "locked")] and by["b/.terraform.lock.hcl"].ecosystem == "Terraform"
    assert deps("c/terragrunt.hcl") == [("git::https://example.invalid/m.git?ref=v1", "", "module")]


def test_routes(spark):
    rows = {
        "main.go": 'func main() {\n r.GET("/users", h)\n r.POST("/users", h)\n mux.HandleFunc("/health", h)\n api := r.Group("/api")\n api.GET("/x", h)\n r.Route("/v1", func(r chi.Router) {\n  r.Get("/y", h)\n })\n r.GET("/z", h)\n cache.Get("timeout")\n}\n',
        "app.js": "app.get('/products', h);\nrouter.delete('/products/:id', h); // app.get('/no')\nconst s = \"app.get('/quoted')\";\n",
        "a.py": '@app.route("/orders", methods=["GET","POST"])\n@app.get("/orders/<id>")\n',
        "src/routes/(shop)/carts/[cartId]/+server.ts": "export const GET = 1; export async function POST() {}",
        "app/(group)/blog/[slug]/page.tsx": "",
        "pages/users/[id].tsx": "",
        "pages/index.tsx": "",
        "src/App.tsx": "const r=[{path: 'settings', e: 1},{ path: 'profile/:id' }]",
        "app/app.routes.ts": "[{path: 'users', component: U},{path: 'admin', loadChildren: () => 1}]",
        "a.test.js": "app.get('/tested')",
    }
    got = {(r.method, r.path, r.file) for r in routes.routes(files_.from_rows(spark, rows)).collect()}
    assert got == {
        ("GET", "/users", "main.go"), ("POST", "/users", "main.go"), ("ANY", "/health", "main.go"), ("GET", "/api/x", "main.go"), ("GET", "/v1/y", "main.go"), ("GET", "/z", "main.go"), ("GET", "/products", "app.js"), ("DELETE", "/products/:id", "app.js"),
        ("GET", "/orders", "a.py"), ("POST", "/orders", "a.py"), ("GET", "/orders/<id>", "a.py"), ("GET", "/carts/:cartId", "src/routes/(shop)/carts/[cartId]/+server.ts"), ("POST", "/carts/:cartId", "src/routes/(shop)/carts/[cartId]/+server.ts"), ("GET", "/blog/:slug", "app/(group)/blog/[slug]/page.tsx"),
        ("GET", "/users/:id", "pages/users/[id].tsx"), ("GET", "/", "pages/index.tsx"), ("ANY", "/settings", "src/App.tsx"), ("ANY", "/profile/:id", "src/App.tsx"), ("ANY", "/users", "app/app.routes.ts"), ("ANY", "/admin", "app/app.routes.ts"),
    }


def test_route_calls_in_nested_code(spark):
    go = 'func f() {\n s := `r.GET("/no")`\n r.Route("/a",\n  func(r chi.Router) {\n   r.Get("/b", func() { x := "}" })\n   r.Group("/c").Get("/d", h)\n })\n r.Get("/e", h); r.Put("/f", h)\n sub := r.PathPrefix("/g").Subrouter()\n sub.HandleFunc("/h", h)\n}\n'
    assert [(m, p) for m, p, _ in routes.go_routes(go)] == [("GET", "/a/b"), ("GET", "/e"), ("PUT", "/f"), ("ANY", "/g/h")]
    js = "const r = [{ path: 'top', children: [{ path: 'inner', component: X, data: { a: 1 } }], loadChildren: () => y }]"
    assert [(x[1], x[5]) for x in routes.code_routes("a.ts", js) if x[5] == "Angular Router"] == [("/top", "Angular Router"), ("/inner", "Angular Router")]


def test_caps_are_reported(spark, monkeypatch):
    rows = {f"f{k}.js": f"app.get('/p{k}', h)" for k in range(5)} | {f"s{k}.sql": f"create table t{k} (id int);" for k in range(3)} | {f"m{k}/go.mod": f"module m{k}\n" for k in range(3)} | {"bad/package.json": "{"}
    r = repo(spark, rows)
    assert not r.routes()["truncated"] and not r.deps()["truncated"] and not r.schema()["truncated"] and "bad/package.json" in r.deps()["note"]
    monkeypatch.setattr(routes, "MAX_ROUTES", 5)
    monkeypatch.setattr(manifests, "MAX_MANIFESTS", 3)
    assert not r.routes()["truncated"] and not r.deps()["truncated"]
    monkeypatch.setattr(routes, "MAX_ROUTES", 4)
    monkeypatch.setattr(manifests, "MAX_MANIFESTS", 2)
    assert r.routes()["truncated"] and r.routes()["routes"].count() == 4 and r.deps()["truncated"] and r.deps()["manifests"].count() == 2
    assert schema.left_out(r.scanned, 2) == 1 and routes.left_out(r.scanned, 3) == 2


def test_files_of_other_encodings_and_ignored_folders(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("# caf\xe9\ndef a():\n    pass\n".encode("latin-1"))
    (tmp_path / "b [x].py").write_text("def b():\n    a()\n")
    for hidden in ("node_modules", ".git", "deep/vendor"):
        (tmp_path / hidden).mkdir(parents=True)
        (tmp_path / hidden / "c.py").write_text("def c(): pass\n")
    (tmp_path / "deep" / "d.py").write_text("x = 1\n")
    found = {f.path: f.content for f in files_.walk(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.py", "b [x].py", "deep/d.py"} and "caf\ufffd" in found["a.py"]
    assert len(files_.kept_folders(str(tmp_path))) == 2
    assert files_.walk(spark, str(tmp_path / "deep" / "vendor")).count() == 1


def test_files_that_break_their_tagger_are_named(spark):
    r = repo(spark, {"ok.go": "func A() {}\n", "bad.py": "def broken(:\n"})
    assert [e.file for e in r.graph.errors.collect()] == ["bad.py"] and "bad.py" in r._notes()


def test_index_survives_a_failure_at_the_switch(spark, tmp_path, monkeypatch):
    index = str(tmp_path / "index")
    tags = lambda rows: taggers.tag(files_.from_rows(spark, rows))
    names = lambda: {r["name"] for r in files_.load_index(spark, index).where("row = 'symbol'").collect()}
    assert files_.load_index(spark, index) is None
    for k in range(4):
        files_.save_index(tags({"a.go": f"func A{k}() {{}}\n"}), index)
        assert names() == {f"A{k}"}

    def fails(fs, pointer):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(files_, "_point", fails)
        with pytest.raises(OSError):
            files_.save_index(tags({"a.go": "func Lost() {}\n"}), index)
    assert names() == {"A3"}
    files_.save_index(tags({"a.go": "func B() {}\n"}), index)
    assert names() == {"B"}
    import shutil

    last = sorted(p.name for p in (tmp_path / "index").glob("v1.*.current"))[-1].split(".")[2]
    shutil.rmtree(tmp_path / "index" / f"v1-{last}")
    with pytest.raises(Exception, match="v1-"):
        files_.load_index(spark, index)


def test_schema(spark):
    ddl = 'CREATE TABLE IF NOT EXISTS users (id SERIAL PRIMARY KEY, email VARCHAR(255), balance DECIMAL(10,2), key_id INT);\nCREATE TABLE "orders" (id INT, user_id INT REFERENCES users(id), item_id INT, PRIMARY KEY (id), CONSTRAINT f FOREIGN KEY (item_id) REFERENCES items(id));'
    entities, columns, links = schema.entities(files_.from_rows(spark, {"migrations/001_init.sql": ddl, "z.sql": "create table users (other int);"}))
    assert {(e.name, e.file) for e in entities.collect()} == {("users", "migrations/001_init.sql"), ("orders", "migrations/001_init.sql")}
    by = {(c.entity, c.name): (c.type, c.pk, c.fk) for c in columns.collect()}
    assert by["users", "id"] == ("SERIAL", True, False) and by["users", "balance"][0] == "DECIMAL(10,2)" and by["orders", "user_id"][2] and by["orders", "id"][1] and ("users", "key_id") in by
    assert [tuple(x) for x in links.collect()] == [("orders", "users", "user_id")]
    strict = schema.entities(files_.from_rows(spark, {"a.sql": ddl}), strict=True)[1]
    assert ("users", "key_id") not in {(c.entity, c.name) for c in strict.collect()}


def test_manifests(spark):
    rows = {
        "go.mod": "module example.com/proj\n\nrequire (\n\tfoo/bar v1.2.3\n\tbaz/qux v0.1.0 // indirect\n)\n",
        "package.json": '{"name":"top","workspaces":{"packages":["web"]},"dependencies":{"web":"*"},"packageManager":"yarn@4"}',
        "web/package.json": '{"name":"web","dependencies":{"react":"^18"},"devDependencies":{"jest":"29"}}',
        "web/vite.config.ts": "",
        "py/requirements.txt": "Django>=4.2 # c\nrequests[x]\n-r x\npkg @ https://example.invalid/pkg.whl#sha256=abc\n",
        "rs/Cargo.toml": '[package]\nname="mycrate"\n[dependencies]\nserde="1.0"\n[target.\'cfg(unix)\'.dependencies]\nnix="0.27"\n[dev-dependencies]\ncriterion={version="0.5"}\n',
        "bad/package.json": "{",
    }
    found = manifests.manifests(files_.from_rows(spark, rows))
    by = {m.manifest: m for m in found.collect()}
    deps = lambda m: [(d.name, d.version, d.kind, d.dev) for d in by[m].direct]
    assert by["go.mod"].module == "example.com/proj" and by["go.mod"].indirect == 1 and deps("go.mod") == [("foo/bar", "v1.2.3", "", False)]
    assert deps("web/package.json") == [("jest", "29", "dev", True), ("react", "^18", "normal", False)] and by["web/package.json"].tools == ["Jest", "Vite"]
    assert by["package.json"].tools == ["yarn workspaces"] and [(w.dep, w.manifests) for w in by["package.json"].workspace_deps] == [("web", ["web/package.json"])]
    assert deps("py/requirements.txt") == [("Django", ">=4.2", "", False), ("pkg", "@ https://example.invalid/pkg.whl#sha256=abc", "", False), ("requests", "", "", False)]
    assert ("nix", "0.27", "target", False) in deps("rs/Cargo.toml") and ("criterion", "0.5", "dev", True) in deps("rs/Cargo.toml")
    assert "bad/package.json" not in by
    over = found.where("manifest = 'rs/Cargo.toml'").select("manifest", "ecosystem", found.module, "direct", "indirect", "package_manager", "workspaces", "scripts", "engines").replace("mycrate", "meta")
    assert {m.manifest: m.module for m in manifests.manifests(files_.from_rows(spark, rows), over).collect()}["rs/Cargo.toml"] == "meta"
    text, cut = manifests.mermaid(found, 2)
    assert cut and text.startswith("flowchart LR\n  m0[")


def test_stacks(spark):
    got = {s.path: s for s in stacks.stacks(files_.from_rows(spark, HCL | {"standalone/main.tf": 'terraform {\n  backend "gcs" {\n    key = "k"\n  }\n}\n', "cloud/a.tf": "terraform {\n  cloud {\n  }\n}\n"})).collect()}
    app = got["live/north/shop"]
    assert (app.source, app.source_local, app.includes, app.dependencies, app.backend, app.inputs) == ("parts/shop", True, ["root.hcl"], ["live/north/base"], "s3", ["tier"])
    assert got["standalone"].kind == "terraform-root" and (got["standalone"].backend, got["standalone"].state_key) == ("gcs", "k") and got["cloud"].backend == "cloud"


def test_recon(spark):
    rows = {"go.mod": "", "main.go": "", "cmd/x_test.go": "", "Makefile": "", ".github/workflows/ci.yml": "", "src/lib.rs": "fn f() { x.unwrap(); }\n// y.unwrap()\nlet _ = 1;\n", "next.config.js": "", "modules/a/main.tf": ""}
    out = repo(spark, rows).recon()
    assert out["stack"] == ["Go", "Terraform (HCL)"] and out["manifests"] == ["go.mod"] and out["frameworks"] == ["Next.js"] and out["entry_points"] == ["main.go", "src/lib.rs"] and out["test_layout"] == ["cmd"] and out["tooling"] == ["GitHub Actions", "Make"]
    assert [tuple(r) for r in out["risk_hints"].collect()] == [("src/lib.rs", 1, "unwrap"), ("src/lib.rs", 3, "let _ =")]
    assert recon.top_extensions(files_.from_rows(spark, rows)).first().ext == ".go"


def test_pattern_symbols_where_no_tagger_knows(spark):
    g = build_graph(files_.from_rows(spark, {"a.rb": "class A\n  def b\n  end\n\n  def b\n  end\nend\n", "x.java": "\npublic class X {}\n"}))
    assert g.by_pattern and {(s.qname, s.line) for s in g.symbols.collect()} == {("a.rb::A", 1), ("a.rb::b", 2), ("a.rb::b#5", 5), ("x.java::X", 2)}


def test_diff_text(spark):
    text = "diff --git a/internal/x/y.go b/internal/x/y.go\n--- a/internal/x/y.go\n+++ b/internal/x/y.go\n@@ -9 +10,3 @@\n+a\n@@ -40 +41,2 @@\n+++ b/not a header\n@@ -50,2 +60,0 @@\ndiff --git a/new.go b/new.go\nnew file mode 100644\n--- /dev/null\n+++ b/new.go\n@@ -0,0 +1,5 @@\ndiff --git a/gone.go b/gone.go\ndeleted file mode 100644\n--- a/gone.go\n+++ /dev/null\n@@ -1,2 +0,0 @@\ndiff --git a/old b/new/name.go\nrename from old\nrename to new/name.go\n--- a/old\n+++ b/new/name.go\n@@ -1 +1 @@"
    diffs, hunks = gitlog.parse_diff(gitlog.numbered_lines(spark, text))
    assert {tuple(d) for d in diffs.collect()} == {("internal/x/y.go", "M"), ("new.go", "A"), ("gone.go", "D"), ("new/name.go", "R")}
    assert sorted(tuple(h) for h in hunks.collect()) == [("internal/x/y.go", 10, 12), ("internal/x/y.go", 41, 42), ("internal/x/y.go", 60, 60), ("new.go", 1, 5), ("new/name.go", 1, 1)]
    with pytest.raises(Exception, match="hunk"):
        gitlog.parse_diff(gitlog.numbered_lines(spark, "diff --git a/x b/x\n+++ b/x\n@@ -abc,2 +3,4 @@"))[1].collect()


def test_name_status():
    assert gitlog.name_status(b"M\0a b.go\0R100\0old.go\0new.go\0C75\0x\0y\0") == [("M", "a b.go", ""), ("R", "new.go", "old.go"), ("C", "y", "x")]


def test_git_history_guide_and_roots(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for k in range(3):
        (tmp_path / "a.txt").write_text(f"{k}\n")
        if not k:
            (tmp_path / "b.go").write_text("func B() {}\n")
        git("add", "-A")
        git("commit", "-qm", str(k))
    r = Repository(spark, str(tmp_path), allowed=[str(tmp_path.parent)])
    rows = [tuple(x)[:2] + tuple(x)[4:] for x in r.history()["files"].collect()]
    assert [x[:2] for x in rows] == [("a.txt", 3), ("b.go", 1)] and all(len(x[2]) == 10 and x[3] == 1 for x in rows)
    assert {f.path for f in r.files.collect()} == {"a.txt", "b.go"} and r.guide_delta()["state"] == "absent"
    r.guide_write("body")
    g = r.guide_read()
    assert g.body == "body" and g.mode == "full" and g.branch == "main" and r.guide_delta()["current"]
    sha = g.sha
    git("mv", "b.go", "c.go")
    git("commit", "-qm", "move")
    assert r.guide_delta()["changed"] == [("R", "c.go", "b.go")] and gitlog.tree_files(str(tmp_path), sha)["b.go"] == "func B() {}\n"
    assert gitlog.default_base(str(tmp_path)) == gitlog.head_sha(str(tmp_path))
    for bad in ("", "-x", "a\0", "nope"):
        with pytest.raises(gitlog.GitError):
            gitlog.valid_ref(str(tmp_path), bad)
    with pytest.raises(PermissionError):
        Repository(spark, str(tmp_path), allowed=[str(tmp_path / "x")])
    (tmp_path / "out").symlink_to("/tmp")
    with pytest.raises(PermissionError):
        files_.under_root(str(tmp_path), "out/x")


def test_guide_stamp(tmp_path):
    guide.write_guide(str(tmp_path), "b\n", "s", "m", "delta", dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC))
    assert guide.read_guide(str(tmp_path)) == guide.Guide(True, "s", "m", "delta", "2024-01-02T03:04:05Z", "b\n") and not guide.read_guide(str(tmp_path / "x")).exists


def test_skills(spark):
    skills = {"b": {"SKILL.md": "---\nname: b\ndescription: does b\n---\nText"}, "a": {"SKILL.md": "plain", "more.md": ""}}
    rows = guide.catalogue(spark, skills, ["b"]).collect()
    assert [(r["name"], r.description) for r in rows] == [("b", "does b"), ("a", "")] and rows[0].content == "Text" and rows[1].files == ["SKILL.md", "more.md"]
    assert guide.skill(guide.catalogue(spark, skills), "old", {"old": "b"}).first()["name"] == "b"


def test_incremental_index(spark, tmp_path):
    index, tagged = str(tmp_path / "index"), []

    def tag(files):
        tagged.append(sorted(r.path for r in files.select("path").collect()))
        return taggers.tag(files)

    rows = {"helper.go": "func Util() {}\n", "use.go": "func Use() { Util() }\n"}
    first = files_.refreshed(files_.from_rows(spark, rows), files_.load_index(spark, index), tag)
    files_.save_index(first, index)
    again = files_.refreshed(files_.from_rows(spark, rows | {"use.go": "func Use() { Util(); Util() }\n"}), files_.load_index(spark, index), tag)
    assert tagged == [["helper.go", "use.go"], ["use.go"]]
    g = build_graph(files_.from_rows(spark, rows), tags=again)
    assert {tuple(e)[:2] for e in g.edges.collect()} == {("use.go::Use", "helper.go::Util")}
    assert files_.load_index(spark, index, version=99) is None


def test_index_stream(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    put = lambda rows, seq: files_.from_rows(spark, rows).selectExpr("path", "lang", "size", "hash", "content", f"{seq}L as seq").write.mode("append").parquet(source)
    put({"a.go": "func A() {}\n", "b.go": "func B() {}\n"}, 1)
    schema_ = spark.read.parquet(source).schema
    go = lambda: index_stream(spark.readStream.schema(schema_).parquet(source), index, taggers.tag, str(tmp_path / "check")).awaitTermination()
    go()
    put({"b.go": "func B2() {}\n"}, 2)
    go()
    names = {r["name"] for r in files_.load_index(spark, index).where("row = 'symbol'").collect()}
    assert names == {"A", "B2"}


def test_lexical():
    text = "a // x\n'b // c' /* d\n */ e # f"
    assert lexical.without_comments(text) == "a     \n'b // c'     \n    e    "
    s = lexical.Strings("x = 'abc' + y")
    assert s.holds(6) and not s.holds(1) and not s.holds(12)
    assert lexical.joined("a/b", "../c") == "a/c" and lexical.joined("a", "../../c") is None and list(lexical.above("a/b/c.hcl")) == ["a", ""]


def test_tsconfig_prefixes(spark):
    rows = {
        "tsconfig.json": '{\n  // settings\n  "compilerOptions": {"baseUrl": ".", "paths": {"#lib/*": ["./code/lib/*"], "two/*": ["a/*", "b/*"], },}\n}',
        "code/lib/f.ts": "export function f() {}\n",
        "app.ts": "import { f } from '#lib/f'\nimport x from 'react'\nfunction run() { f() }\n",
    }
    assert [tuple(r) for r in taggers.path_prefixes(files_.from_rows(spark, rows)).collect()] == [("#lib/", "code/lib/")]
    assert ("app.ts::run", "code/lib/f.ts::f") in edges(spark, rows)


def test_cargo_metadata(spark, tmp_path):
    import json

    raw = {"workspace_members": ["a"], "packages": [{"id": "a", "name": "a", "manifest_path": f"{tmp_path}/rs/Cargo.toml", "dependencies": [{"name": "serde", "req": "^1", "kind": None}, {"name": "c", "req": "*", "kind": "dev"}], "targets": [{"name": "a", "kind": ["bin"], "src_path": f"{tmp_path}/rs/src/main.rs"}]}, {"id": "b", "name": "b", "manifest_path": "/x/Cargo.toml"}]}
    rows, targets = manifests.cargo_metadata(json.dumps(raw), str(tmp_path))
    assert targets == [("rs/Cargo.toml", "a", ["bin"], "rs/src/main.rs")]
    over = spark.createDataFrame(rows, manifests.SCHEMA)
    found = manifests.manifests(files_.from_rows(spark, {"rs/Cargo.toml": '[package]\nname="old"\n'}), over).collect()
    assert [(m.module, [d.name for d in m.direct]) for m in found] == [("a", ["c", "serde"])]
    assert manifests.manifests(files_.from_rows(spark, {"x.txt": ""}), over).count() == 0


def test_stats(spark):
    s = repo(spark, APP).stats()
    assert s == {"files": 2, "langs": ["go"], "definitions": 4, "edges": 3, "unresolved": 0}


def test_parsed_rows_are_handed_on_in_parts(spark):
    """5,000 files of three rows in one batch: no more than about 2,000 rows at a time, and none is lost."""
    import pandas as pd

    from strataloom.sources import files

    class Batches:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return list(run(iter([pd.DataFrame({"path": [f"f{k}" for k in range(5000)], "content": ["x"] * 5000})])))

    parts = files.per_file(Batches(), lambda path, content: [(path, n) for n in range(3)], "path string, n int")
    assert sum(map(len, parts)) == 15_000 and max(map(len, parts)) <= 2_002
