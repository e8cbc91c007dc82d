"""Terraform, OpenTofu and Terragrunt configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..hcl import parent_folder_file, read, unquoted
from ..lexical import above, closing, folder, without_comments
from ..stacks import source_of
from .base import Definition, FileTags, Import, Reference

# Fixed values.
BUILTIN_ROOTS = frozenset("each count self path terraform terragrunt include".split())
MODULE_SETTINGS = frozenset("source version count for_each providers depends_on".split())
LAYER_BLOCKS = frozenset("remote_state generate include dependency dependencies terraform inputs locals".split())
_BLOCK = re.compile(r'^[ \t]*([A-Za-z_][\w-]*)((?:[ \t]+"[^"\n]*")*)[ \t]*\{', re.M)
_KEY = re.compile(r'^[ \t]*"?([A-Za-z_][\w-]*)"?[ \t]*=(?!=)', re.M)


def blocks(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, list[str], int, int, int]]:
    """(type, labels, start, body start, end) of the blocks at the top of a stretch of text."""
    at = start
    stop = len(text) if end is None else end
    while (m := _BLOCK.search(text, at, stop)) is not None:
        close = closing(text, m.end() - 1)
        close = stop if close < 0 else close
        yield m[1], re.findall(r'"([^"\n]*)"', m[2]), m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), close
        at = close + 1


def keys(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, start, end of value) of attributes at the top of a stretch; nested brackets are passed over."""
    at = start
    while (m := _KEY.search(text, at, end)) is not None:
        stop, k = m.end(), m.end()
        line_end = text.find("\n", k)
        stop = min(end, line_end if line_end >= 0 else end)
        for opener in re.finditer(r"[{\[(]", text[k:stop]):
            close = closing(text, k + opener.start(), {"{": "{}", "[": "[]", "(": "()"}[opener[0]])
            if close > stop:
                stop = min(end, close + 1)
            break
        yield m[1], m.start(1), stop
        at = stop
        nested = _BLOCK.search(text, at, end)
        following = _KEY.search(text, at, end)
        if nested and (not following or nested.start() < following.start()):
            close = closing(text, nested.end() - 1)
            at = close + 1 if close > 0 else end


def _attribute(text: str, start: int, end: int, name: str) -> str:
    m = re.compile(rf'\b{name}\s*=\s*"([^"]*)"').search(text, start, end)
    return m[1] if m else ""


def hcl(path: str, text: str) -> FileTags:
    """Names are Terraform addresses. A layer file (Terragrunt's shape) is a stack if it is a terragrunt.hcl, else a config."""
    code = without_comments(text)
    out = FileTags(path, text)
    tops = list(blocks(code))
    layer = path.endswith(".hcl") and (any(b[0] in LAYER_BLOCKS for b in tops) or bool(re.search(r"^(?:inputs|skip)\s*=", code, re.M)))
    here = folder(path)
    whole = ""
    if layer:
        base = path.rpartition("/")[2]
        whole = here.rpartition("/")[2] if base == "terragrunt.hcl" else base.removesuffix(".hcl")
        out.definitions.append(Definition(whole or "root", "stack" if base == "terragrunt.hcl" else "config", 0, len(text)))

    def refs(start: int, end: int, caller: str = "") -> None:
        for m in re.compile(r"(?<![\w.\"])([A-Za-z_][\w-]*)\.([A-Za-z_][\w-]*)(?:\.([A-Za-z_][\w-]*))?").finditer(code, start, end):
            root, a, b = m.groups()
            if root in BUILTIN_ROOTS:
                continue
            if root in ("var", "local"):
                out.references.append(Reference(f"{root}.{a}", m.start(), m.end(), caller=caller))
            elif root == "module":
                out.references.append(Reference(f"module.{a}", m.start(), m.end(), caller=caller))
                if b:
                    out.references.append(Reference(f"output.{b}", m.start(), m.end(), f"hcl-module:{a}", caller=caller))
            elif root == "dependency":
                out.references.append(Reference(f"dependency.{a}", m.start(), m.end(), caller=caller))
            elif root == "data" and b:
                out.references.append(Reference(f"data.{a}.{b}", m.start(), m.end(), caller=caller))
            elif "_" in root:
                out.references.append(Reference(f"{root}.{a}", m.start(), m.end(), caller=caller))

    for kind, labels, start, inner, end in tops:
        one = labels[0] if labels else ""
        name, what = {
            "variable": (f"var.{one}", "variable"), "output": (f"output.{one}", "output"), "module": (f"module.{one}", "module_call"), "provider": (f"provider.{one}", "provider"), "dependency": (f"dependency.{one}", "dependency"),
            "resource": (".".join(labels), "resource"), "data": ("data." + ".".join(labels), "data"),
        }.get(kind, ("", ""))
        if kind == "locals":
            for key, at, stop in keys(code, inner, end):
                out.definitions.append(Definition(f"local.{key}", "local", at, stop))
                refs(code.find("=", at), stop)
            continue
        if name and (one or kind in ("resource", "data")):
            out.definitions.append(Definition(name, what, start, end + 1))
        if kind == "module" and one:
            target, local = source_of(path, _attribute(code, inner, end, "source"))
            if local:
                out.imports.append(Import(f"hcl-module:{one}", one, [target]))
                for key, at, _ in keys(code, inner, end):
                    if key not in MODULE_SETTINGS:
                        out.references.append(Reference(f"var.{key}", at, at + len(key), f"hcl-module:{one}"))
        elif kind == "dependency" and one:
            target, local = source_of(path, _attribute(code, inner, end, "config_path") or "")
            if not local and target and "${" not in target:
                target, local = source_of(path, "./" + target)
            if local:
                alias = f"hcl-import:{one}"
                out.imports.append(Import(alias, one, [f"{target}/terragrunt.hcl"]))
                out.references.append(Reference(target.rpartition("/")[2], start, end, alias))
        elif kind == "include":
            label = one or "include"
            asked = read(code[inner:end]).expression("path")
            up, literal = parent_folder_file(asked), unquoted(asked)
            names = [up] if up else ["root.hcl", "terragrunt.hcl"]
            where = [f"{d}/{n}".lstrip("/") for n in names for d in above(path)] if up is not None else [source_of(path, literal)[0]] if literal and "${" not in literal else []
            if where:
                alias = f"hcl-import:include.{label}"
                stem = names[0].removesuffix(".hcl") if up is not None else literal.rpartition("/")[2].removesuffix(".hcl")
                out.imports.append(Import(alias, label, where))
                out.references.append(Reference(stem, start, end, alias))
        elif kind == "terraform" and layer:
            target, local = source_of(path, _attribute(code, inner, end, "source"))
            if local:
                out.imports.append(Import("hcl-tgsource", "source", [target]))
        refs(inner, end)
    covered = [(s, e) for _, _, s, _, e in tops]
    for m in re.finditer(r"^inputs\s*=\s*(?:merge\([^{]*)?\{", code, re.M):
        end = closing(code, m.end() - 1)
        end = len(code) if end < 0 else end
        for key, at, _ in keys(code, m.end(), end):
            out.references.append(Reference(f"var.{key}", at, at + len(key), "hcl-tgsource"))
        refs(m.end(), end)
        covered.append((m.start(), end))
    if path.endswith((".tfvars", ".tofuvars")):
        for key, at, stop in keys(code, 0, len(code)):
            out.references.append(Reference(f"var.{key}", at, at + len(key)))
            del stop
    return out
