"""Scalar text functions as native column expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers are cut at a lower-case letter before an upper-case one, then into ASCII runs of two or more.
CAMEL = "([a-z])([A-Z])"
TOKEN = "[a-zA-Z0-9]{2,}"
MIN_STEM_WORD = 5

# Fixed values: (suffix, replacement, least length of what stands before it), first match wins.
STEM_RULES = [
    ("ation", "", 3), ("izing", "ize", 3), ("ating", "ate", 3),
    ("nning", "n", 2), ("tting", "t", 2), ("pping", "p", 2), ("gging", "g", 2), ("bbing", "b", 2), ("dding", "d", 2), ("mming", "m", 2), ("lling", "l", 2),
    ("sses", "ss", 2), ("ness", "", 3), ("ment", "", 3), ("tion", "", 3), ("ized", "ize", 3), ("ling", "le", 3), ("ring", "r", 3), ("ning", "n", 3), ("ting", "t", 3), ("ping", "p", 3), ("bing", "b", 2), ("ding", "d", 3), ("ging", "g", 3), ("king", "k", 3), ("ming", "m", 3),
    ("lled", "ll", 3), ("nned", "n", 3), ("tted", "t", 3), ("pped", "p", 3), ("gged", "g", 3), ("bbed", "b", 3), ("dded", "d", 3),
    ("ing", "", 3), ("ies", "y", 3), ("ed", "", 3), ("er", "", 3), ("ly", "", 3), ("es", "", 4),
]

#: Words that programmers shorten, and how. Queries and postings are expanded both ways.
SHORT_FORMS = {
    "application": "app", "argument": "arg", "attribute": "attr", "authentication": "auth", "authorization": "auth authz", "average": "avg",
    "button": "btn", "calculate": "calc", "character": "char", "command": "cmd", "configuration": "cfg conf config", "connection": "conn",
    "context": "ctx", "counter": "cnt", "database": "db", "definition": "def", "delete": "del", "description": "desc", "destination": "dest dst",
    "dictionary": "dict", "directory": "dir", "document": "doc", "element": "elem", "environment": "env", "error": "err", "exception": "exc",
    "expression": "expr", "function": "fn func", "generate": "gen", "identifier": "id ident", "image": "img", "index": "idx",
    "initialize": "init", "integer": "int", "language": "lang", "length": "len", "library": "lib", "license": "lic", "manager": "mgr",
    "maximum": "max", "memory": "mem", "message": "msg", "minimum": "min", "number": "num", "object": "obj", "operation": "op",
    "package": "pkg", "parameter": "param", "password": "pwd", "permission": "perm", "pointer": "ptr", "position": "pos", "previous": "prev",
    "process": "proc", "property": "prop", "query": "qry", "receive": "recv", "reference": "ref", "repository": "repo", "request": "req",
    "response": "resp", "separator": "sep", "sequence": "seq", "service": "svc", "source": "src", "specification": "spec",
    "statistics": "stats", "string": "str", "synchronize": "sync", "system": "sys", "table": "tbl", "temporary": "temp tmp", "utility": "util",
    "value": "val", "variable": "var", "version": "ver", "window": "win",
}


def split_tokens(text: Column) -> Column:
    """Lower-case tokens of camelCase or snake_case text, in order."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL, "$1_$2"), F.lit(TOKEN), F.lit(0)), F.lower)


def tokens_of(text: str) -> list[str]:
    """The same for one Python string (query terms)."""
    return [t.lower() for t in re.findall(TOKEN, re.sub(CAMEL, r"\1_\2", text or ""))]


def stem(word: Column) -> Column:
    """Suffix stripping for lower-case words."""
    w = word
    found = F.when(F.length(w) < MIN_STEM_WORD, w)
    for suffix, new, least in STEM_RULES:
        base = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        found = found.when(w.endswith(suffix) & (F.length(w) >= least + len(suffix)), F.concat(base, F.lit(new)))
    plural = w.endswith("s") & ~w.endswith("ss")
    return found.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def stem_word(w: str) -> str:
    if len(w) < MIN_STEM_WORD:
        return w
    for suffix, new, least in STEM_RULES:
        if w.endswith(suffix) and len(w) - len(suffix) >= least:
            return w[: len(w) - len(suffix)] + new
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def stem_sql(w: str) -> str:
    """The same in DuckDB SQL."""
    rules = " ".join(f"WHEN suffix({w}, '{s}') AND length({w}) >= {least + len(s)} THEN left({w}, length({w}) - {len(s)}) || '{new}'" for s, new, least in STEM_RULES)
    return f"CASE WHEN length({w}) < {MIN_STEM_WORD} THEN {w} {rules} WHEN suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"


def abbreviation_pairs() -> list[tuple[str, str]]:
    """(term, other form) in both directions."""
    down = [(word, short) for word, forms in SHORT_FORMS.items() for short in forms.split()]
    return down + [(short, word) for word, short in down]


def expand_query(text: str) -> list[str]:
    """Query terms in order, with stems and abbreviation forms, each once."""
    out: dict[str, None] = {}
    for t in tokens_of(text):
        forms = dict.fromkeys((t, stem_word(t)))
        for x in [*forms, *(other for form in forms for term, other in abbreviation_pairs() if term == form)]:
            out.setdefault(x)
    return list(out)


def trigrams(text: Column) -> Column:
    """Distinct trigrams; the whole string if shorter."""
    several = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(several))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem_of_path(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a glob; a star crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] == "!" else i + 1)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body.startswith('!') else body}]"
            i = end
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_/" else c
        i += 1
    return f"^{out}$"


def glob(path: Column, pattern: str, variant: str = "path") -> Column:
    """path: the whole path; suffix: also below any folder; name: also the file name alone."""
    found = path.rlike("(?s)" + glob_regex(pattern))
    if variant == "suffix":
        return found | path.rlike("(?s)" + glob_regex("*/" + pattern))
    return found | basename(path).rlike("(?s)" + glob_regex(pattern)) if variant == "name" else found


def matches_glob(path: str, pattern: str) -> bool:
    return fnmatch.fnmatchcase(path, pattern)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    terms = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


# What counts as a branch, and the sides of a bracket.
BRANCH = r"\b(?:and|case|catch|do|elif|else|except|finally|for|if|or|when|while)\b|&&|\|\||\?(?!:)"


def cyclomatic(body: Column) -> Column:
    return F.size(F.regexp_extract_all(body, F.lit(BRANCH), F.lit(0))) + 1


def nesting(body: Column) -> Column:
    """Deepest bracket nesting, the first bracket at depth 0."""
    brackets = F.split(F.regexp_replace(body, r"[^\[\](){}]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s, c):
        d = F.when(c.isin("(", "[", "{"), s["d"] + 1).when(c.isin(")", "]", "}"), F.greatest(s["d"] - 1, F.lit(0))).otherwise(s["d"])
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(brackets, start, step, lambda s: F.greatest(s["m"] - 1, F.lit(0)))


def param_count(signature: Column) -> Column:
    """Commas at depth 0 between the outer parentheses, and one; none for empty or void. Brackets nest to any depth."""
    inner = F.trim(F.regexp_extract(signature, r"(?s)\((.*)\)", 1))

    def step(s, c):
        depth = F.when(c.isin("(", "[", "{", "<"), s["d"] + 1).when(c.isin(")", "]", "}", ">"), F.greatest(s["d"] - 1, F.lit(0))).otherwise(s["d"])
        return F.struct(depth.alias("d"), (s["n"] + F.when((c == ",") & (s["d"] == 0), 1).otherwise(0)).alias("n"))

    marks = F.split(F.regexp_replace(F.regexp_replace(inner, "[-=]>", ""), r"[^\[\](){}<>,]", ""), "")
    commas = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when((inner == "") | (inner == "void"), 0).otherwise(commas + 1)


def complexity_band(cyclomatic_col: Column) -> Column:
    return F.when(cyclomatic_col <= 4, "low").when(cyclomatic_col <= 10, "medium").otherwise("high")


#: A commit's category is the first one whose conventional prefix, or one of whose words, its subject has.
COMMIT_WORDS = {
    "revert": "revert reverts reverted undo backout",
    "rename": "rename renames renamed move moves moved relocate",
    "bugfix": "fix fixes fixed bug bugs bugfix hotfix crash repair regression",
    "perf": "perf performance speed faster optimise optimize latency throughput",
    "refactor": "refactor refactors refactored cleanup simplify restructure tidy split",
    "test": "test tests testing spec coverage fixture",
    "docs": "doc docs documentation readme changelog typo",
    "config": "build ci chore config docker deps bump upgrade workflow release",
    "feature": "feat feature add adds added introduce implement support new allow",
}


def commit_pattern(category: str) -> str:
    return r"(?i)\b(?:" + "|".join(COMMIT_WORDS[category].split()) + r")\b"


def commit_category(subject: Column) -> Column:
    found = F
    for name in COMMIT_WORDS:
        found = found.when(subject.rlike(commit_pattern(name)), name)
    return found.otherwise("evolution")


def commit_intent(message: Column) -> Column:
    """What a commit says it is for: its first body line that is no trailer (a dashed token and a colon) nor a comment; else the subject."""
    lines = F.transform(F.split(F.trim(message), "\r?\n"), lambda x: F.trim(x))
    told = F.filter(lines, lambda x, i: (i > 0) & (x != "") & ~x.rlike(r"^#|^[A-Za-z]+(?:-[A-Za-z]+)+:\s|^(?i:clos|fix|resolv|ref)\w{0,8}[ :]+#?\d"))
    return F.coalesce(F.get(told, F.lit(0)), F.get(lines, F.lit(0)))


#: Published shapes of credentials: (kind, what stands before it and stays, the secret itself).
SECRET_SHAPES = [
    ("aws_access_key", r"\b", r"A(?:KIA|SIA)[A-Z2-7]{16}\b"),
    ("aws_secret_key", r"(?i:aws\w{0,20}secret\w{0,20})\W{1,6}", r"[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])"),
    ("gcp_service_account", r"\b", r"[a-z][a-z0-9-]{5,29}@[a-z0-9-]+\.iam\.gserviceaccount\.com\b"),
    ("azure_storage_key", r"(?i:AccountKey)\s*=\s*", r"[A-Za-z0-9/+]{86}=="),
    ("azure_client_secret", r"(?i:client_?secret)\W{1,6}", r"[A-Za-z0-9~._-]{34,40}"),
    ("jwt", r"\b", r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"),
    ("bearer_token", r"(?i:bearer)\s+", r"[\w.~+/-]{20,}=*"),
    ("github_token", r"\b", r"(?:gh[opsur]_[A-Za-z0-9]{36,}|github_pat_\w{50,})"),
    ("slack_token", r"\b", r"xox[a-z]-[A-Za-z0-9-]{10,}"),
    ("private_key", r"", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    ("private_ipv4", r"(?<![\d.])", r"(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})(?![\d.])"),
]
NAMED_KEY = r"(?i)\b\w{0,20}(?:key|token|secret)\W{1,6}([\w-]{32,})"
MIN_ENTROPY = 3.5


#: What every match of a shape holds to the letter; shapes that are not here begin with words of ANY_CASE_MARKS or hold one.
SECRET_MARKS = {
    "aws_access_key": ["AKIA", "ASIA"], "gcp_service_account": [".iam.gserviceaccount.com"], "jwt": ["eyJ"], "slack_token": ["xox"], "private_key": ["-----BEGIN "],
    "github_token": ["ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_"], "private_ipv4": ["10.", "192.168.", "172."],
}
KEY_MARKS = ["key", "token", "secret"]  # of NAMED_KEY, in any case
ANY_CASE_MARKS = [*KEY_MARKS, "bearer"]


def holds_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hide(kind: str, before: str, secret: str) -> Callable[[Column], Column]:
    hidden = lambda t: F.regexp_replace(t, f"({before}){secret}", f"$1[REDACTED:{kind}]")
    if kind not in SECRET_MARKS:
        return hidden
    # Marks are asked of the text as it then is: what stands in for a secret may be part of a later match.
    return lambda text: with_value(text, lambda t: F.when(holds_any(t, SECRET_MARKS[kind]), hidden(t)).otherwise(t))


def redact(text: Column) -> Column:
    """Known kinds of secrets become [REDACTED:kind]; generic keys only if they look random. Texts that hold no mark of any
    shape, and so no match, are left as they are without trying the patterns."""

    def generic(t):
        keys = F.filter(F.regexp_extract_all(t, F.lit(NAMED_KEY), F.lit(1)), lambda k: k.rlike("[a-z]") & k.rlike("[A-Z]") & k.rlike("[0-9]") & (entropy(k) >= MIN_ENTROPY))
        return F.when(holds_any(F.lower(t), KEY_MARKS), F.aggregate(keys, t, lambda s, k: F.replace(s, k, F.lit("[REDACTED:generic_api_key]")))).otherwise(t)

    def every(t):
        for shape in SECRET_SHAPES:
            t = _hide(*shape)(t)
        return with_value(t, generic)

    marked = lambda t: holds_any(t, sum(SECRET_MARKS.values(), [])) | with_value(F.lower(t), lambda low: holds_any(low, ANY_CASE_MARKS))
    return with_value(text, lambda t: F.when(marked(t), every(t)).otherwise(t))


# Files that start something, files that gather exports, and what marks a test.
ENTRY_FILES = ["__main__.py", "conftest.py", "manage.py", "wsgi.py", "asgi.py", "setup.py", "app.py", "main.py", "run.py", "cli.py", "celery.py", "Makefile"]
BARREL_FILES = ["__init__.py", "index.ts", "index.js", "index.tsx", "index.jsx", "index.mjs", "index.cjs", "mod.rs"]
TEST_PATH = r"/tests/|/test/|/__tests__/|(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$|\.(spec|test)\.[^./]*$"
MAIN_GUARD = r"if\s+__name__\s*==\s*[\"']__main__[\"']"


def is_test(path: Column) -> Column:
    return F.translate(path, "\\", "/").rlike(TEST_PATH)


def is_entry(path: Column) -> Column:
    return basename(path).isin(ENTRY_FILES)


def is_barrel(path: Column) -> Column:
    return basename(path).isin(BARREL_FILES)


def bases_of(signature: Column) -> Column:
    """Base classes named in a class signature: behind extends and implements, else the capitalised names in its parentheses."""
    head = F.split(signature, r"\{", 2)[0]
    names = lambda s: F.regexp_extract_all(s, F.lit(r"[A-Za-z_][\w.]*"), F.lit(0))
    behind = F.filter(names(F.array_join(F.slice(F.split(head, r"\b(?:extends|implements)\b"), 2, 1000), ",")), lambda x: x != "")
    inside = F.filter(names(F.regexp_replace(F.regexp_extract(head, r"^[^(]*\bclass\s+\w+\s*\((.*)\)", 1), r"\w+\s*=\s*[\w.]+", "")), lambda x: x.rlike("^[A-Z]"))
    return F.when(F.size(behind) > 0, behind).otherwise(inside)


def package_name(name: Column) -> Column:
    """A Python distribution's name, normalised."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def summary_of(docstring: Column, signature: Column) -> Column:
    """First sentence or line of a docstring, at most 120 characters; else the signature."""
    first = F.trim(F.regexp_extract(F.trim(F.coalesce(docstring, F.lit(""))), r"^([^\n]*?(?:\.(?=\s|$)|$|(?=\n)))", 1))
    return F.when(first != "", F.substring(first, 1, 120)).otherwise(F.substring(F.coalesce(signature, F.lit("")), 1, 120))


def strip_jinja(sql: Column) -> Column:
    """SQL without template comments and statements; expressions become a name."""
    sql = F.regexp_replace(F.regexp_replace(sql, r"(?s)\{#.*?#\}", ""), r"(?s)\{%.*?%\}", "")
    sql = F.regexp_replace(sql, r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", "$1")
    sql = F.regexp_replace(sql, r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}", "$1.$2")
    return F.regexp_replace(sql, r"(?s)\{\{.*?\}\}", "placeholder")
