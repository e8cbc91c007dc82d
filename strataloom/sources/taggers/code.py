"""Taggers of programming languages and their templates."""

from __future__ import annotations

import ast
import re

from ..lexical import closing, folder, joined, without_comments, without_strings
from .base import Definition, FileTags, Import, Reference

# Words that a call form does not name.
_GO_WORDS = frozenset("func if for switch select go defer return range case type struct interface map chan var const import package else append cap clear close complex copy delete imag len make max min new panic print println real recover string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 bool byte rune error any".split())
_JS_WORDS = frozenset("if for while switch catch function return typeof instanceof new delete void in of do else await async yield super import export class const let var case throw try finally this null true false undefined".split())
_RUST_WORDS = frozenset("if while for match return fn let loop else in as move unsafe impl struct enum trait type mod use pub where Some None Ok Err Self self".split())
_EXTENSIONS = (".tsx", ".ts", ".jsx", ".js", ".svelte", "")


def _block_end(code: str, at: int, limit: int | None = None) -> int:
    """The end of the block that opens after this offset, or of the line where none does."""
    brace, stop = code.find("{", at), code.find(";", at)
    line = code.find("\n\n", at)
    if brace < 0 or (0 <= stop < brace) or (limit is not None and brace > limit) or (0 <= line < brace):
        end = code.find("\n", at)
        return len(code) if end < 0 else end
    end = closing(code, brace)
    return len(code) if end < 0 else end + 1


def go(path: str, text: str) -> FileTags:
    code = without_strings(without_comments(text, False))
    out = FileTags(path, text)
    named = set()
    for m in re.finditer(r"^func\s+(?:\(([^)]*)\)\s*)?([A-Za-z_]\w*)", code, re.M):
        recv = re.sub(r"\[.*", "", (m[1] or "").split()[-1].lstrip("*")) if (m[1] or "").strip() else ""
        named.add(m.start(2))
        out.definitions.append(Definition(m[2], "method" if m[1] is not None else "function", m.start(), _block_end(code, m.end()), recv))
    for m in re.finditer(r"^type\s+([A-Za-z_]\w*)", code, re.M):
        named.add(m.start(1))
        out.definitions.append(Definition(m[1], "type", m.start(), _block_end(code, m.end(), code.find("\n", m.end()))))
    out.definitions.sort(key=lambda d: d.start)
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", code):
        if m[1] not in _GO_WORDS and m.start(1) not in named:
            out.references.append(Reference(m[1], m.start(1), m.end(1)))
    return out


def python(path: str, text: str) -> FileTags:
    out, tree = FileTags(path, text), ast.parse(text)
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = text.splitlines()
    place = lambda line, col: starts[line - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore")) if line <= len(lines) else len(text)

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inside = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                out.definitions.append(Definition(child.name, "class" if is_class else "method" if owner else "function", place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), owner, child.name.startswith("test_"), not child.name.startswith("_")))
                inside = child.name if is_class else ""
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.references.append(Reference(name, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
            visit(child, inside)

    visit(tree, "")
    out.definitions.sort(key=lambda d: d.start)
    return out


def variants(base: str) -> list[str]:
    """Files that an import of base may mean, best first."""
    return [base + e for e in _EXTENSIONS] + [f"{base}/index{e}" for e in _EXTENSIONS if e]


def _candidates(path: str, source: str) -> list[str]:
    """Repository paths that an import may mean, best first; 'alias:' and the source where only a tsconfig can tell."""
    if source.startswith(("@/", "~/")):
        bases = [joined("src", source[2:]), joined(source[2:])]
    elif source.startswith("."):
        bases = [joined(folder(path), source)]
    else:
        return ["alias:" + source]
    return [v for base in bases if base for v in variants(base)]


def _js_imports(path: str, code: str) -> list[Import]:
    out = []
    for m in re.finditer(r"import\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s*['\"]([^'\"]+)['\"]", code):
        where = _candidates(path, m[2])
        if not where:
            continue
        head, _, names = m[1].partition("{")
        for part in filter(None, (p.strip() for p in head.split(","))):
            star = re.match(r"\*\s+as\s+([\w$]+)", part)
            out.append(Import(star[1] if star else part, "*" if star else "default", where))
        for part in filter(None, (p.strip() for p in names.rstrip("} \n").split(","))):
            name, _, alias = (x.strip() for x in part.removeprefix("type ").partition(" as "))
            out.append(Import(alias or name, name, where))
    for m in re.finditer(r"\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", code):
        where = _candidates(path, m[2])
        if not where:
            continue
        if m[1].startswith("{"):
            for part in filter(None, (p.strip() for p in m[1][1:-1].split(","))):
                name, _, alias = (x.strip() for x in part.partition(":"))
                out.append(Import(alias or name, name, where))
        else:
            out.append(Import(m[1], "default", where))
    return out


def javascript(path: str, text: str) -> FileTags:
    bare = without_comments(text, False)
    code = without_strings(bare)
    out, taken = FileTags(path, text, imports=_js_imports(path, bare)), set()

    def define(m: re.Match, kind: str, recv: str = "", group: int = 1) -> None:
        if m.start(group) not in taken:
            taken.add(m.start(group))
            exported = bool(re.search(r"\bexport\b", code[m.start() : m.start(group)]))
            out.definitions.append(Definition(m[group], kind, m.start() + len(m[0]) - len(m[0].lstrip()), _block_end(code, m.end(), None if kind != "type" else m.end()), recv, False, exported))

    lead = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
    for m in re.finditer(lead + r"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", code, re.M):
        define(m, "function")
    for m in re.finditer(lead + r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>", code, re.M):
        define(m, "function")
    for m in re.finditer(lead + r"interface\s+([A-Za-z_$][\w$]*)", code, re.M):
        define(m, "interface")
    for m in re.finditer(lead + r"type\s+([A-Za-z_$][\w$]*)[^=\n]*=", code, re.M):
        define(m, "type")
    for m in re.finditer(lead + r"(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", code, re.M):
        define(m, "class")
        owner = out.definitions[-1]
        for k in re.finditer(r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?\s*([A-Za-z_$#][\w$]*)\s*(?:<[^>\n]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{;\n]+)?\{", code[owner.start : owner.end], re.M):
            at, name = owner.start + k.start(1), k[1]
            if name not in _JS_WORDS and at not in taken:
                taken.add(at)
                end = closing(code, owner.start + k.end() - 1)
                out.definitions.append(Definition(name, "constructor" if name == "constructor" else "method", at, len(code) if end < 0 else end + 1, owner.name))
    out.definitions.sort(key=lambda d: d.start)
    for m in re.finditer(r"(?:([A-Za-z_$][\w$]*)\s*\??\.\s*)?\b([A-Za-z_$][\w$]*)\s*(?:<[\w\s,]+>)?\(", code):
        if m[2] in _JS_WORDS or m.start(2) in taken or re.search(r"\bfunction\s*\*?\s*$", code[max(0, m.start(2) - 12) : m.start(2)]):
            continue
        recv = "" if m[1] in (None, "this", "super") else m[1]
        out.references.append(Reference(m[2], m.start(2), m.end(2), recv, not recv))
    for pattern in (r"<([A-Z][\w$]*)[\s/>]", r":\s*([A-Z][\w$]*)\b", r"@([A-Za-z_$][\w$]*)(?!\s*\()", r"\bnew\s+([A-Z][\w$]*)(?!\s*[\w$(<])"):
        out.references += [Reference(m[1], m.start(1), m.end(1)) for m in re.finditer(pattern, code) if m.start(1) not in taken]
    out.references.sort(key=lambda r: r.start)
    return out


def _rust_owners(code: str) -> list[tuple[int, int, str]]:
    """(start, end, owner) of impl and trait blocks; 'impl Trait for Type' owns as 'Type as Trait'."""
    out = []
    for m in re.finditer(r"\b(impl|trait)\b([^{};]*)\{", code):
        head = re.sub(r"\s+", " ", re.sub(r"\bwhere\b.*", "", m[2], flags=re.DOTALL)).strip()
        depth, cut = 0, 0
        if head.startswith("<"):
            for k, c in enumerate(head):
                depth += (c == "<") - (c == ">")
                if not depth:
                    cut = k + 1
                    break
        plain = lambda t: re.sub(r"<.*|:.*", "", re.sub(r"^(?:&|mut |dyn |'\w+ )*", "", t.strip()).rsplit("::", 1)[-1]).strip()
        trait, found, kind = head[cut:].partition(" for ")
        end = closing(code, m.end() - 1)
        out.append((m.start(), len(code) if end < 0 else end, f"{plain(kind)} as {plain(trait)}" if found else plain(trait)))
    return out


def rust(path: str, text: str) -> FileTags:
    code = re.sub(r"'(?=\w+\b(?!'))", " ", without_comments(text, False))  # a lifetime opens no string
    code = without_strings(code)
    out, owners, taken = FileTags(path, text), _rust_owners(code), set()
    owner_at = lambda at: min(((e - s, o) for s, e, o in owners if s < at < e), default=(0, ""))[1]
    kinds = {"fn": "function", "struct": "type", "enum": "type", "trait": "interface", "type": "type", "mod": "module", "macro_rules!": "macro", "const": "constant", "static": "constant"}
    for m in re.finditer(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*(fn|struct|enum|trait|type|mod|macro_rules!|const|static)\s+(?:mut\s+)?([A-Za-z_]\w*)", code, re.M):
        recv = owner_at(m.start(3)) if m[2] == "fn" else ""
        before = text[max(0, m.start() - 768) : m.start()]
        attributes = before[max(before.rfind("}"), before.rfind(";")) + 1 :]
        test = bool(re.search(r"#\[(?:[\w:]*::)?test\]|#\[cfg\(test\)\]", attributes))
        taken.add(m.start(3))
        out.definitions.append(Definition(m[3], "method" if recv else kinds[m[2]], m.start() + len(m[0]) - len(m[0].lstrip()), _block_end(code, m.end()), recv, test, bool(m[1])))
    for m in re.finditer(r"(?:([A-Za-z_]\w*)(?:::<[^>]*>)?::|(self|[A-Za-z_]\w*::new\([^()]*\))\.|(\.)?)\b([A-Za-z_]\w*)(?:::<[^>]*>)?(!?)\s*[(\[{]", code):
        path_head, value, dotted, name, bang = m.groups()
        at = m.start(4)
        if at in taken or (name in _RUST_WORDS) or (not bang and m[0][-1] != "("):
            continue
        own = owner_at(at)
        recv = own if path_head == "Self" or value == "self" else path_head or (value.split("::")[0] if value else "")
        out.references.append(Reference(name, at, m.end(4), recv or "", True))
    return out


def svelte(path: str, text: str) -> FileTags:
    """Two component symbols, default and the file's name; scripts as JavaScript in place; calls in the markup from the top."""
    out = FileTags(path, text)
    stem = path.rpartition("/")[2].removesuffix(".svelte")
    out.definitions += [Definition(n, "component", 0, 0, public=True) for n in ("default", stem)]
    markup = re.sub(r"<style\b.*?</style>", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", markup, re.DOTALL):
        # Blanks in front keep every offset, and so every line, that of the component.
        script = javascript(path, re.sub(r"[^\n]", " ", text[: m.start(1)]) + m[1])
        out.definitions += script.definitions
        out.references += script.references
        out.imports += script.imports
        markup = markup[: m.start()] + re.sub(r"[^\n]", " ", m[0]) + markup[m.end() :]
    top = f"{path}::(top-level)"
    for m in re.finditer(r"\{[^{}]*\}|<([A-Z]\w*)", markup):
        names = [(m[1], m.start(1))] if m[1] else [(k[0], m.start() + k.start()) for k in re.finditer(r"[A-Za-z_$][\w$]*", m[0]) if k[0] not in _JS_WORDS]
        out.references += [Reference(n, at, at + len(n), caller=top) for n, at in names]
    return out


def html(path: str, text: str) -> FileTags:
    """Identifiers of bindings, interpolations and structural directives, each once, from the top."""
    out = FileTags(path, text)
    seen = set()
    for pattern in (r"\([\w.-]+\)\s*=\s*[\"']([^\"']*)[\"']", r"\{\{(.*?)\}\}", r"\[[\w.-]+\]\s*=\s*[\"']([^\"']*)[\"']", r"\*\w+\s*=\s*[\"']([^\"']*)[\"']"):
        for m in re.finditer(pattern, text, re.DOTALL):
            for k in re.finditer(r"[A-Za-z_$][\w$]*", re.sub(r"'[^']*'|\"[^\"]*\"", "", m[1])):
                if k[0] not in _JS_WORDS and k[0] not in seen:
                    seen.add(k[0])
                    out.references.append(Reference(k[0], m.start(), m.end(), caller=f"{path}::(top-level)"))
    return out
