"""Parsing: symbols, calls and pattern matches from source files, file by file in Arrow batches.

Python is parsed by its own grammar; other languages by line patterns that find definitions and brace or indentation
extents, which is approximate. Files that don't parse yield nothing rather than fail the job.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

from spelunka import schemas
from spelunka.functions import text as X

# A definition in other languages: kind and a pattern whose group is the name.
DEFINITIONS = {
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)")],
    "java": [("class", r"^\s*(?:public|private|protected|abstract|final|static|\s)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|synchronized|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\{")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)")],
    "c": [("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{"), ("type", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)")],
    "ruby": [("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*(?:class|module)\s+(\w+)")],
    "php": [("function", r"^\s*(?:public|private|protected|static|\s)*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)")],
}
LIKE = {"typescript": "javascript", "tsx": "javascript", "vue": "javascript", "kotlin": "java", "csharp": "java", "scala": "java", "dart": "java", "swift": "java", "cpp": "c", "objc": "c", "arduino": "c"}
BRANCH = re.compile(X.BRANCH)


def symbol_id(file: str, qualified: str, kind: str) -> str:
    return f"{file}::{qualified}#{kind}"


def nesting_of(body: str) -> int:
    depth = deepest = 0
    for c in body:
        if c in "([{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in ")]}":
            depth = max(0, depth - 1)
    return max(0, deepest - 1)


def _row(file, language, name, qualified, kind, body, signature, line, end, offset, length, docstring="", decorators=(), parent=None, params=0, calls=()):
    return {
        "id": symbol_id(file, qualified, kind), "file": file, "name": name, "qualified_name": qualified, "kind": kind, "language": language, "signature": signature, "docstring": docstring or "",
        "summary": ((docstring or "").strip().split("\n")[0] or signature)[:120], "decorators": list(decorators), "keywords": sorted(set(X.tokens_of(qualified)) - {name.lower()}), "parent": parent, "line": line, "end_line": end, "byte_offset": offset,
        "byte_length": length, "content_hash": hashlib.sha256(body.encode()).hexdigest(), "cyclomatic": len(BRANCH.findall(body)) + 1, "max_nesting": nesting_of(body), "param_count": params, "call_references": list(calls),
    }


def _called(node) -> str | None:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def python_symbols(file: str, text: str) -> list[dict]:
    """Classes, functions, methods and upper-case constants, in document order; calls belong to the innermost function or class."""
    tree = ast.parse(text)
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    out = []

    def calls_in(node):
        names, stack = [], list(ast.iter_child_nodes(node))
        while stack:
            x = stack.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call) and (n := _called(x)):
                names.append(n)
            stack += ast.iter_child_nodes(x)
        return sorted(set(names))

    def add(node, name, kind, parent, params=0, decorators=()):
        first, last = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno
        body = "\n".join(lines[first - 1 : last])
        qualified = f"{parent[0]}.{name}" if parent else name
        doc = ast.get_docstring(node) if not isinstance(node, (ast.Assign, ast.AnnAssign)) else ""
        out.append(_row(file, "python", name, qualified, kind, body, lines[node.lineno - 1].strip().rstrip(":"), first, last, starts[first - 1], len(body.encode()), doc, decorators, parent and parent[1], params, calls_in(node)))
        return qualified, out[-1]["id"]

    def walk(node, parent, inside):
        for x in getattr(node, "body", []):
            marks = [ast.unparse(d) for d in getattr(x, "decorator_list", [])]
            if isinstance(x, ast.ClassDef):
                walk(x, add(x, x.name, "class", parent, 0, marks), "class")
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = x.args
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                walk(x, add(x, x.name, "method" if inside == "class" else "function", parent, n, marks), "function")
            elif inside is None and isinstance(x, (ast.Assign, ast.AnnAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        add(x, t.id, "constant", None)

    walk(tree, None, None)
    return out


def other_symbols(file: str, language: str, text: str) -> list[dict]:
    rules = [(k, re.compile(p)) for k, p in DEFINITIONS.get(LIKE.get(language, language), [])]
    lines, out, offset = text.split("\n"), [], 0
    for i, line in enumerate(lines):
        for kind, rule in rules:
            if m := rule.match(line):
                depth, end, opened = 0, i, False
                for j in range(i, len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    opened = opened or "{" in lines[j]
                    end = j
                    if opened and depth <= 0 or not opened and j > i + 2:
                        break
                body = "\n".join(lines[i : end + 1])
                calls = sorted(set(re.findall(r"\b([A-Za-z_]\w*)\s*\(", body)) - {m[1], "if", "for", "while", "switch", "return", "function", "catch"})
                out.append(_row(file, language, m[1], m[1], kind, body, line.strip().rstrip("{").strip(), i + 1, end + 1, offset, len(body.encode()), calls=calls))
                break
        offset += len(line.encode()) + 1
    return out


def _parse(frames):
    for df in frames:
        rows = []
        for path, language, content in zip(df["path"], df["language"], df["content"]):
            text = bytes(content).decode("utf-8", "replace")
            try:
                rows += python_symbols(path, text) if language == "python" else other_symbols(path, language, text)
            except (SyntaxError, ValueError, RecursionError):
                continue
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.SYMBOLS.split(", ")])


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content); repeated ids get ordinals in document order."""
    from pyspark.sql import functions as F

    from spelunka.operators.history import overload_ids

    found = files.select("path", "language", "content").mapInPandas(_parse, schemas.SYMBOLS)
    return overload_ids(found).withColumn("id", F.col("unique_id")).drop("unique_id")


# -- pattern search -------------------------------------------------------------------------------------------------------

SEVERITY = {"error": 0, "warning": 1, "info": 2}
# The presets, their severities and thresholds.
PRESETS = {"empty_catch": "error", "bare_except": "warning", "deeply_nested": "warning", "nested_loops": "warning", "todo_fixme": "info", "eval_exec": "error", "hardcoded_secret": "error", "magic_number": "info", "god_function": "warning", "reassigned_param": "info"}
DEEP, LOOPS, LONG = 5, 3, 100
MARKER = re.compile(r"\b(TODO|FIXME|HACK|XXX|NOCOMMIT|TEMP)\b", re.I)
CREDENTIAL = re.compile(r"(?i)\b\w*(?:password|passwd|secret|api_?key|token|credential)\w*[\"']?\s*[:=]\s*[\"'][^\"']{4,}[\"']")
# Calls that run text as code, by language, and numbers that need no name.
DYNAMIC = {"eval", "exec", "compile", "__import__"}
DYNAMIC_BY = {"javascript": ["eval", "Function", "setTimeout", "setInterval"], "ruby": ["eval", "instance_eval", "class_eval", "module_eval", "send", "public_send"], "php": ["eval", "assert", "create_function", "call_user_func"], "c": ["system", "popen"]}
SAFE_NUMBERS = {-1, 0, 0.5, 1, 2, 100, 255, 256, 1000, 1024}
CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
LOOP = (ast.For, ast.AsyncFor, ast.While)
DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _deep(tree, kinds, most):
    """Outermost nodes of those kinds that reach a depth, not below one already found."""
    out, stack = [], [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, kinds):
            depth += 1
            if depth >= most:
                out.append(node)
                continue
        elif isinstance(node, DEF):
            depth = 0
        stack += [(x, depth) for x in ast.iter_child_nodes(node)]
    return out


def _own_nodes(function):
    """What is inside a function, but not inside functions in it."""
    stack = list(function.body)
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in ast.iter_child_nodes(node) if not isinstance(x, (*DEF, ast.Lambda))]


_COMMENT_OR_TEXT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CONTROL_HEAD = re.compile(r"\b(?:if|else|for|foreach|while|do|switch|match|try|catch|loop|select|with|using)\b")
_LOOP_HEAD = re.compile(r"\b(?:for|foreach|while|do|loop)\b")
_FUNCTION_HEAD = re.compile(r"([\w$]+)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)[^(){};]*$")
_CONSTANT_LINE = re.compile(r"\b(?:const|final|static|enum|#define|readonly)\b|^\s*[A-Z][A-Z0-9_]*\s*=")


def masked(text: str) -> str:
    """The text with comments and strings blanked, so that places stay the same."""
    return _COMMENT_OR_TEXT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def blocks(code: str) -> list[tuple[str, int, int, int]]:
    """(head, start, end, parent) of each pair of braces in masked code; head is what stands before it since the last statement."""
    out, stack, last = [], [], 0
    for m in re.finditer(r"[{};]", code):
        at = m.start()
        if m[0] == "{":
            out.append([code[last:at].strip(), at, len(code), stack[-1] if stack else -1])
            stack.append(len(out) - 1)
        elif m[0] == "}" and stack:
            out[stack.pop()][2] = at
        elif m[0] == ";" and code.count("(", last, at) > code.count(")", last, at):
            continue  # inside for (...; ...)
        last = at + 1
    return [tuple(b) for b in out]


def brace_matches(text: str, rules: set[str], language: str) -> list[tuple[str, int, int]]:
    """(rule, first line, last line) of a file in a language of braces, by its blocks: approximate where such a language has
    other forms."""
    code, out = masked(text), []
    line = lambda at: code.count("\n", 0, at) + 1
    hit = lambda rule, a, b: out.append((rule, line(a), line(b))) if rule in rules else None
    found, control, loops = blocks(code), {}, {}
    for k, (head, start, end, parent) in enumerate(found):
        is_control, is_function = bool(_CONTROL_HEAD.search(head)), _FUNCTION_HEAD.search(head)
        begin = start - len(head)
        nested = -1 if is_function and not is_control else parent
        control[k] = control.get(nested, 0) + is_control
        loops[k] = loops.get(nested, 0) + bool(_LOOP_HEAD.search(head))
        if is_control and control[k] == DEEP:
            hit("deeply_nested", begin, end)
        if _LOOP_HEAD.search(head) and loops[k] == LOOPS:
            hit("nested_loops", begin, end)
        if re.search(r"\bcatch\b", head):
            if not code[start + 1 : end].strip():
                hit("empty_catch", start, end)
            if re.search(r"\bcatch\s*\(\s*(?:\.\.\.|(?:final\s+)?(?:java\.lang\.)?(?:Exception|Throwable)\b)", head):
                hit("bare_except", start, end)
        if is_function and not is_control:
            if line(end) - line(start) + 1 > LONG:
                hit("god_function", start, end)
            names = {w[-1] for p in is_function[2].split(",") if (w := re.findall(r"[A-Za-z_$][\w$]*", re.split(r"[=:]", p)[0]))}
            inner = [(a, b) for h, a, b, p in found if a > start and b < end and _FUNCTION_HEAD.search(h) and not _CONTROL_HEAD.search(h)]
            for m in re.finditer(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:[-+*/%|&^]|\|\||&&|\?\?|<<|>>)?=(?![=>])", code[start:end]):
                if m[1] in names and not any(a < start + m.start() < b for a, b in inner) and not re.search(r"\b(?:let|var|const)\s+$", code[: start + m.start()][-8:]):
                    hit("reassigned_param", start + m.start(), start + m.start())
    calls = DYNAMIC_BY.get(LIKE.get(language, language), [])
    for m in re.finditer(r"(?<![\w$.])(?:" + "|".join(calls) + r")\s*\(", code) if calls else ():
        hit("eval_exec", m.start(), m.start())
    if "magic_number" in rules:
        lines = code.split("\n")
        for n, x in enumerate(lines, 1):
            if not _CONSTANT_LINE.search(x):
                out += [("magic_number", n, n) for m in re.finditer(r"(?<![\w.$])-?(\d+(?:\.\d+)?)(?![\w.])", x) if float(m[1]) not in SAFE_NUMBERS]
    return out


def python_matches(text: str, rules: set[str]) -> list[tuple[str, int, int]]:
    """(rule, first line, last line) of a Python file."""
    tree = ast.parse(text)
    out = []
    hit = lambda rule, node: out.append((rule, node.lineno, node.end_lineno)) if rule in rules else None
    empty = lambda b: all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) for x in b)
    parents = {c: p for p in ast.walk(tree) for c in ast.iter_child_nodes(p)}
    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler):
            if empty(node.body):
                hit("empty_catch", node)
            if node.type is None or isinstance(node.type, ast.Name) and node.type.id in ("Exception", "BaseException"):
                hit("bare_except", node)
        elif isinstance(node, ast.Call) and _called(node) in DYNAMIC and isinstance(node.func, ast.Name):
            hit("eval_exec", node)
        elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool) and node.value not in SAFE_NUMBERS:
            p, constant = node, False
            for _ in range(5):
                p = parents.get(p)
                constant = constant or isinstance(p, ast.Assign) and all(isinstance(t, ast.Name) and t.id.isupper() for t in p.targets)
            if not constant:
                hit("magic_number", node)
        elif isinstance(node, DEF):
            if node.end_lineno - node.lineno + 1 > LONG:
                hit("god_function", node)
            names = {a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]}
            for x in _own_nodes(node):
                targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AugAssign, ast.AnnAssign, ast.NamedExpr)) else []
                if any(isinstance(t, ast.Name) and t.id in names for t in targets):
                    hit("reassigned_param", x)
    for node in _deep(tree, CONTROL, DEEP):
        hit("deeply_nested", node)
    for node in _deep(tree, LOOP, LOOPS):
        hit("nested_loops", node)
    return out


def parse_pattern(pattern: str) -> tuple[str, str]:
    """call:, string:, comment:, nesting:, loops: or lines: and an argument."""
    kind, _, value = pattern.partition(":")
    if kind not in ("call", "string", "comment", "nesting", "loops", "lines") or not value:
        raise ValueError(f"unknown pattern {pattern!r}")
    return kind, value


def _custom(text: str, kind: str, value: str) -> list[tuple[str, int, int]]:
    rule = f"{kind}:{value}"
    if kind == "comment":
        return [(rule, i, i) for i, line in enumerate(text.split("\n"), 1) if (m := re.search(r"(#|//).*", line)) and value.lower() in m[0].lower()]
    tree = ast.parse(text)
    if kind == "call":
        return [(rule, x.lineno, x.end_lineno) for x in ast.walk(tree) if isinstance(x, ast.Call) and re.fullmatch(value.replace("*", ".*"), _called(x) or "")]
    if kind == "string":
        return [(rule, x.lineno, x.end_lineno) for x in ast.walk(tree) if isinstance(x, ast.Constant) and isinstance(x.value, str) and value.lower() in x.value.lower()]
    n = int(re.sub(r"\D", "", value))
    if kind == "lines":
        return [(rule, x.lineno, x.end_lineno) for x in ast.walk(tree) if isinstance(x, DEF) and x.end_lineno - x.lineno + 1 >= n]
    return [(rule, x.lineno, x.end_lineno) for x in _deep(tree, CONTROL if kind == "nesting" else LOOP, n)]


def _matcher(rules: set[str], pattern: tuple[str, str] | None):
    def work(frames):
        for df in frames:
            rows = []
            for path, language, content in zip(df["path"], df["language"], df["content"]):
                text = bytes(content).decode("utf-8", "replace")
                lines, found = text.split("\n"), []
                if "todo_fixme" in rules:
                    found += [("todo_fixme", i, i) for i, x in enumerate(lines, 1) if (m := re.search(r"(#|//|/\*).*", x)) and MARKER.search(m[0])]
                if "hardcoded_secret" in rules:
                    found += [("hardcoded_secret", i, i) for i, x in enumerate(lines, 1) if CREDENTIAL.search(x)]
                try:
                    if language == "python":
                        found += python_matches(text, rules)
                        found += _custom(text, *pattern) if pattern else []
                    else:
                        found += brace_matches(text, rules, language) if LIKE.get(language, language) in ("javascript", "go", "java", "rust", "c", "php") else []
                        found += _custom(text, *pattern) if pattern and pattern[0] == "comment" else []
                except (SyntaxError, ValueError, RecursionError):
                    pass
                rows += [{"file": path, "rule": r, "severity": PRESETS.get(r, "info"), "line": a, "end_line": b, "snippet": lines[a - 1].strip()[:200]} for r, a, b in found]
            yield pd.DataFrame(rows, columns=["file", "rule", "severity", "line", "end_line", "snippet"])

    return work


def search_ast(files: DataFrame, rules: list[str] | None = None, pattern: str | None = None, k: int = 50) -> DataFrame:
    """Matches of presets or of one pattern, all found before the k most severe are taken."""
    from pyspark.sql import functions as F

    known = set(rules if rules is not None else ([] if pattern else PRESETS))
    if known - set(PRESETS):
        raise ValueError(f"unknown rules {known - set(PRESETS)}")
    found = files.select("path", "language", "content").mapInPandas(_matcher(known, parse_pattern(pattern) if pattern else None), schemas.MATCHES)
    weight = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(weight, "file", "line", "rule").limit(k)
