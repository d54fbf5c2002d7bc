"""Source files to symbols, calls and imports: one Arrow pass over the files, which all three tables are read from.

Python is parsed with the standard library's grammar.  Other languages are read by declaration patterns and brace (or
``end``) matching: names, kinds, line ranges, bases and calls; good enough to rank and link, not a compiler.
A file that can't be parsed gives one row of kind ``corrupt``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.text import branch_complexity, quarter_tokens
from lodeseam.session import persisted, ship_package

ROW = "path string, language string, row string, fqn string, name string, parent string, kind string, first int, last int, signature string, decorators array<string>, exported boolean, docstring string, bases array<string>, params array<string>, attrs array<string>, body string, target string, module string, alias string, level int"

# fixed values: declarations of each language: kind and pattern (the name is the group ``n``)
_ID = r"[A-Za-z_$][\w$]*"
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_ID})(?:\s+extends\s+(?P<b>[\w$.]+))?"), ("interface", rf"^\s*(?:export\s+)?interface\s+(?P<n>{_ID})(?:\s+extends\s+(?P<b>[\w$., ]+))?"), ("type_alias", rf"^\s*(?:export\s+)?type\s+(?P<n>{_ID})\s*="), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<n>{_ID})"), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>{_ID})\s*\("), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>"), ("function", rf"^\s*(?:export\s+)?const\s+(?P<n>{_ID})\s*=\s*(?:React\.)?(?:memo|forwardRef|useCallback|connect)\b"), ("function", rf"^\s*(?:module\.)?exports\.(?P<n>{_ID})\s*=\s*(?:async\s*)?function"), ("method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_ID})\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{")],
    "go": [("method", r"^func\s+\(\s*\w*\s*\*?(?P<p>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)"), ("function", r"^func\s+(?P<n>\w+)"), ("struct", r"^type\s+(?P<n>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<n>\w+)\s+interface\b"), ("type_alias", r"^type\s+(?P<n>\w+)\s")],
    "java": [("class", r"^\s*(?:@\w+\s*)*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*class\s+(?P<n>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<b>[\w.]+))?"), ("interface", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*interface\s+(?P<n>\w+)(?:\s+extends\s+(?P<b>[\w., ]+))?"), ("enum", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*enum\s+(?P<n>\w+)"), ("method", r"^\s+(?:@\w+\s*)*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|synchronized\s+|default\s+)*(?:<[^>]+>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|else\b)\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w., ]+)?\s*\{")],
    "rust": [("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)(?:\s*:\s*(?P<b>[\w+ ]+))?"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<b>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<n>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<n>\w+)")],
    "cpp": [("namespace", r"^\s*namespace\s+(?P<n>\w+)"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<n>\w+)(?:\s*final)?(?:\s*:\s*(?:public|private|protected)\s+(?P<b>[\w:]+))?\s*\{?\s*$"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<n>\w+)(?:\s*:\s*(?:public\s+)?(?P<b>[\w:]+))?\s*\{"), ("macro", r"^\s*#define\s+(?P<n>\w+)"), ("function", r"^\s*(?:[\w:<>,*&~]+\s+)+[*&]*(?:(?P<p>\w+)::)?(?P<n>(?!if\b|for\b|while\b|switch\b|return\b|else\b)~?\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:\{|;|$)")],
    "csharp": [("namespace", r"^\s*namespace\s+(?P<n>[\w.]+)"), ("class", r"^\s*(?:\[[^\]]*\]\s*)*(?:public\s+|private\s+|internal\s+|protected\s+|static\s+|sealed\s+|abstract\s+|partial\s+)*(?:class|record)\s+(?P<n>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<b>[\w.<>, ]+))?"), ("interface", r"^\s*(?:public\s+|internal\s+)*interface\s+(?P<n>\w+)(?:\s*:\s*(?P<b>[\w., ]+))?"), ("struct", r"^\s*(?:public\s+|internal\s+|readonly\s+)*struct\s+(?P<n>\w+)"), ("enum", r"^\s*(?:public\s+|internal\s+)*enum\s+(?P<n>\w+)"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|virtual\s+|override\s+|async\s+|abstract\s+|sealed\s+)+(?:[\w<>\[\],.?]+\s+)?(?P<n>\w+)\s*(?:<[^>]*>)?\([^;]*\)")],
    "php": [("class", r"^\s*(?:abstract\s+|final\s+)*class\s+(?P<n>\w+)(?:\s+extends\s+(?P<b>[\w\\]+))?"), ("interface", r"^\s*interface\s+(?P<n>\w+)(?:\s+extends\s+(?P<b>[\w\\, ]+))?"), ("trait", r"^\s*trait\s+(?P<n>\w+)"), ("function", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*function\s+&?(?P<n>\w+)")],
    "ruby": [("module", r"^\s*module\s+(?P<n>[\w:]+)"), ("class", r"^\s*class\s+(?P<n>[\w:]+)(?:\s*<\s*(?P<b>[\w:]+))?"), ("function", r"^\s*def\s+(?:self\.)?(?P<n>[\w?!=]+)")],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
IMPORTS = {
    "javascript": [r"import\s+(?P<n>[^'\"]+?)\s+from\s+['\"](?P<m>[^'\"]+)", r"require\(\s*['\"](?P<m>[^'\"]+)"], "go": [r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<m>[\w./-]+)\"\s*$"], "java": [r"^import\s+(?:static\s+)?(?P<m>[\w.]+)\.(?P<n>[\w*]+);"],
    "rust": [r"^\s*use\s+(?P<m>[\w:]+)::(?P<n>[\w{}, *]+);"], "cpp": [r"^\s*#include\s+[<\"](?P<m>[^>\"]+)"], "csharp": [r"^\s*using\s+(?P<m>[\w.]+);"], "php": [r"^\s*use\s+(?P<m>[\w\\]+)\\(?P<n>\w+)"], "ruby": [r"^\s*require(?:_relative)?\s+['\"](?P<m>[^'\"]+)"],
}
IMPORTS["typescript"] = IMPORTS["javascript"]
TYPES = {"class", "struct", "interface", "trait", "enum", "impl", "module", "namespace"}
_CALL = re.compile(r"(?<![\w$.])((?:new\s+)?(?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "def", "class", "sizeof", "and", "or", "not", "in", "print"}


def _python(path: str, text: str) -> Iterator[dict]:
    lines = text.split("\n")
    tree = ast.parse(text)
    public = None
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            public = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}

    def exported(name: str, parent: str | None) -> bool:
        return name in public if public is not None and parent is None else not name.startswith("_") or name == "__init__"

    def walk(node: ast.AST, parents: list[str], owner: str) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            mine = owner
            into = parents
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                into = [*parents, child.name]
                mine = f"{path}::{'.'.join(into)}"
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                parent = ".".join(parents) or None
                body = "\n".join(lines[start - 1 : child.end_lineno])
                base = {"row": "symbol", "fqn": mine, "name": child.name, "parent": parent, "first": start, "last": child.end_lineno, "decorators": [ast.unparse(d).split("(")[0] for d in child.decorator_list], "exported": exported(child.name, parent), "docstring": (ast.get_docstring(child) or "").split("\n")[0], "body": body}
                if isinstance(child, ast.ClassDef):
                    kind = "dataclass" if any("dataclass" in d for d in base["decorators"]) else "enum" if any("Enum" in ast.unparse(b) for b in child.bases) else "class"
                    attrs = sorted({m for m in re.findall(r"self\.([A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)", body)})
                    yield base | {"kind": kind, "signature": f"class {child.name}({', '.join(map(ast.unparse, child.bases))})" if child.bases else f"class {child.name}", "bases": [ast.unparse(b) for b in child.bases], "params": [], "attrs": attrs}
                else:
                    a = child.args
                    names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
                    in_class = isinstance(node, ast.ClassDef)
                    kind = "constructor" if child.name == "__init__" else "method" if in_class else "async_function" if isinstance(child, ast.AsyncFunctionDef) else "generator" if any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(child)) else "function"
                    sig = f"{'async ' if isinstance(child, ast.AsyncFunctionDef) else ''}def {child.name}({ast.unparse(a)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                    yield base | {"kind": kind, "signature": sig, "bases": [], "params": [n for n in names if n not in ("self", "cls")], "attrs": []}
            elif isinstance(child, ast.Assign) and not parents:
                for t in child.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        yield {"row": "constant", "fqn": f"{path}::{t.id}", "name": t.id, "first": child.lineno, "last": child.end_lineno, "kind": "constant", "signature": ast.unparse(child)[:200], "exported": exported(t.id, None)}
            elif isinstance(child, ast.Import):
                for n in child.names:
                    yield {"row": "import", "fqn": f"{path}::__file__", "module": n.name, "name": None, "alias": n.asname or n.name.split(".")[0], "level": 0, "first": child.lineno}
            elif isinstance(child, ast.ImportFrom):
                for n in child.names:
                    yield {"row": "import", "fqn": f"{path}::__file__", "module": child.module or "", "name": n.name, "alias": n.asname or n.name, "level": child.level, "first": child.lineno}
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                target = ast.unparse(child.func)
                if re.fullmatch(r"[\w.]+", target):
                    last = target.split(".")[-1]
                    yield {"row": "call", "fqn": owner, "target": target, "name": last, "kind": "constructs" if last[:1].isupper() else "calls", "first": child.lineno}
            elif isinstance(child, ast.Raise) and child.exc is not None:
                name = ast.unparse(child.exc.func if isinstance(child.exc, ast.Call) else child.exc).split(".")[-1]
                yield {"row": "call", "fqn": owner, "target": name, "name": name, "kind": "raises", "first": child.lineno}
            yield from walk(child, into, mine)

    yield from walk(tree, [], f"{path}::__top_level__")


def _block_end(lines: list[str], at: int, language: str) -> int:
    """The last line of the block that begins at ``at`` (from 0)."""
    if language == "ruby":
        pad = len(lines[at]) - len(lines[at].lstrip())
        return next((i for i in range(at + 1, len(lines)) if re.match(rf"\s{{{pad}}}end\b", lines[i])), at)
    depth = seen = 0
    for i in range(at, len(lines)):
        plain = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i])
        depth += plain.count("{") - plain.count("}")
        seen |= "{" in plain
        if seen and depth <= 0:
            return i
        if not seen and (plain.rstrip().endswith(";") or i > at + 3):
            return at
    return len(lines) - 1


def _patterns(path: str, text: str, language: str) -> Iterator[dict]:
    lines = text.split("\n")
    rules = [(k, re.compile(p)) for k, p in DECLARATIONS[language]]
    open_types: list[tuple[str, int]] = []
    for i, line in enumerate(lines):
        while open_types and i > open_types[-1][1]:
            open_types.pop()
        for p in IMPORTS.get(language, []):
            if m := re.search(p, line):
                names = re.findall(r"[\w$*]+", (m.groupdict().get("n") or "").replace(" as ", " ")) or [None]
                for n in names:
                    yield {"row": "import", "fqn": f"{path}::__file__", "module": m["m"], "name": n, "alias": n or re.split(r"[./:\\]", m["m"])[-1], "level": 0, "first": i + 1}
                break
        for kind, rule in rules:
            if not (m := rule.match(line)):
                continue
            if kind == "method" and language in ("javascript", "typescript", "java") and not open_types:
                continue
            end = _block_end(lines, i, language)
            owner = m.groupdict().get("p") or ".".join(n for n, _ in open_types) or None
            full = f"{owner}.{m['n']}" if owner else m["n"]
            made = "method" if kind == "function" and owner else kind
            if owner and m["n"] in (owner.split(".")[-1], "constructor", "initialize", "__construct"):
                made = "constructor"
            bases = [b.strip() for b in (m.groupdict().get("b") or "").split(",") if b.strip()]
            params = re.findall(r"(\w+)\s*(?=[,):=])", (re.search(r"\(([^)]*\))", line) or ["", ""])[1])
            yield {"row": "symbol", "fqn": f"{path}::{full}", "name": m["n"], "parent": owner, "kind": "class" if made == "impl" else made, "first": i + 1, "last": end + 1, "signature": line.strip().rstrip("{").strip()[:300], "decorators": [], "exported": bool(re.search(r"\b(export|public|pub)\b", line)) or (language == "go" and m["n"][:1].isupper()) or language in ("ruby", "php"), "docstring": "", "bases": bases, "params": params, "attrs": sorted(set(re.findall(r"this\.(\w+)\s*=(?!=)", "\n".join(lines[i : end + 1])))) if kind == "class" else [], "body": "\n".join(lines[i : end + 1])}
            if kind in TYPES:
                open_types.append((m["n"], end))
            break
        for m in _CALL.finditer(line):
            target = re.sub(r"^new\s+", "", m[1])
            last = re.split(r"\.|::|->", target)[-1]
            if last not in _NOT_CALLS and not any(r.match(line) and r.match(line)["n"] == last for _, r in rules):
                yield {"row": "call", "fqn": None, "target": re.sub(r"::|->", ".", target), "name": last, "kind": "constructs" if m[1].startswith("new ") or (last[:1].isupper() and language in ("java", "csharp", "cpp")) else "calls", "first": i + 1}


COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def parse_one(path: str, language: str, text: str) -> list[dict]:
    try:
        rows = list(_python(path, text) if language == "python" else _patterns(path, text, language))
    except (SyntaxError, ValueError, RecursionError) as e:
        rows = [{"row": "corrupt", "signature": str(e)[:200]}]
    return [{c: r.get(c) for c in COLUMNS} | {"path": path, "language": language} for r in rows]


def parse(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """All rows of (path, language, content); written once, as three tables are read from it."""
    ship_package(spark)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, lang, t in zip(f["path"], f["language"], f["content"], strict=True) for r in parse_one(p, lang, t or "")]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("first", "last", "level"):
                out[c] = out[c].astype("Int32")
            yield out.astype({"exported": "boolean"})

    return persisted(spark, sources.select("path", "language", "content").mapInPandas(work, ROW), "parsed")


def symbols(parsed: DataFrame) -> DataFrame:
    """Symbols with file, complexity, tokens and the body's hash."""
    s = parsed.where("row in ('symbol', 'constant')")
    return s.select("fqn", F.col("path").alias("file"), "language", "name", F.split_part("fqn", F.lit("::"), F.lit(2)).alias("member"), F.col("name").alias("last"), "parent", "kind", "first", F.col("last").alias("last_line"), "signature", "decorators", "exported", branch_complexity(F.coalesce("body", F.lit(""))).alias("complexity"), quarter_tokens(F.col("body")).alias("tokens"), "docstring", "bases", "params", "attrs", "body", F.sha2(F.coalesce("body", F.lit("")), 256).alias("sha"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.where("row = 'import'").select("path", "module", "name", "alias", "level", "first")


def calls(parsed: DataFrame) -> DataFrame:
    """(path, caller, target, name, etype, line): callers that the parser doesn't know come from the line's innermost symbol."""
    c = parsed.where("row = 'call'").select("path", F.col("fqn").alias("caller"), "target", "name", F.col("kind").alias("etype"), F.col("first").alias("line"))
    return c
