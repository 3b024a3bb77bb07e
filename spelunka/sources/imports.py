"""Import extraction by language and resolution of specifiers to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelunka.functions import text as X

# Per language, patterns whose first group is a specifier and whose second, if any, lists names.
PATTERNS = {
    "javascript": [r"import\s+(?:type\s+)?([\w*\s{},$]+?)\s+from\s*['\"]([^'\"]+)['\"]", r"import\s*['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"export\s+(?:\*|\{[^}]*\})[^'\"]*from\s*['\"]([^'\"]+)['\"]", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "python": [r"(?m)^[ \t]*from\s+([.\w]+)\s+import\s+\(?([^)#\n]+(?:\n[^)]*)?)\)?", r"(?m)^[ \t]*import\s+([\w., \t]+)"],
    "go": [r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([\w./-]+)\"", r"(?s)\bimport\s*\(([^)]*)\)"],
    "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"],
    "rust": [r"(?ms)^\s*(?:pub\s+)?use\s+([^;]+);"],
    "c": [r"(?m)^\s*#\s*(?:include|import)\s*[<\"]([^>\"]+)[>\"]"],
    "asm": [r"(?mi)^\s*[.%]?include\s+[\"']?([^\"'\s]+)"],
    "vhdl": [r"(?mi)^\s*library\s+(\w+)", r"(?mi)^\s*use\s+([\w.]+)"],
    "verilog": [r"(?m)^\s*`include\s+\"([^\"]+)\""],
    "ruby": [r"(?m)^\s*require(?:_relative)?\s*\(?['\"]([^'\"]+)['\"]"],
    "csharp": [r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+|\w+\s*=\s*)?([\w.]+)\s*;"],
    "php": [r"(?m)^\s*use\s+([\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"],
    "swift": [r"(?m)^\s*(?:@testable\s+)?import\s+(\w+)"],
    "scala": [r"(?m)^\s*import\s+([^\n;]+)"],
    "haskell": [r"(?m)^\s*import\s+(?:qualified\s+)?([\w.]+)"],
    "dart": [r"(?m)^\s*(?:import|export)\s+['\"]([^'\"]+)['\"]"],
    "sql": [r"\bref\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bsource\(\s*(['\"][^'\"]+['\"]\s*,\s*['\"][^'\"]+['\"])\s*\)"],
    "vue": [r"<([A-Z]\w+)[\s/>]"],
}
SAME = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "vue": "javascript", "kotlin": "java", "cpp": "c", "objc": "c", "arduino": "c"}
SCRIPT_ENDINGS = [".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".vue"]
ENDINGS = [*SCRIPT_ENDINGS, ".py", ".rb", ".go", ".java", ".rs", ".php", ".cs", ".swift", ".scala", ".hs", ".dart", ".kt"]


def _names(listed: Column) -> Column:
    plain = F.transform(F.split(F.regexp_replace(listed, r"[{}()\n\\]", " "), ","), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"^\s*(type|default)\s+", "")), r"^([\w$*]+)", 1))
    return F.filter(plain, lambda x: (x != "") & (x != "*"))


def _unfolded(path: Column, separator: str) -> Column:
    """a::{b, c::d as e} as a::b and a::c::d; lists inside lists keep what stands before their own brace."""
    path = F.regexp_replace(path, r"\s+(?:as|=>)\s+\w+", "")
    head = F.regexp_extract(path, r"^\s*([^{]*?)\s*(?:\{|$)", 1)
    inner = F.regexp_replace(F.regexp_extract(path, r"(?s)\{(.*)\}", 1), r"[\w:.]+\{[^{}]*\}", "")
    nested = F.flatten(F.transform(F.regexp_extract_all(F.regexp_extract(path, r"(?s)\{(.*)\}", 1), F.lit(r"[\w:.]+\{[^{}]*\}"), F.lit(0)), lambda x: F.transform(F.split(F.regexp_extract(x, r"\{([^{}]*)\}", 1), ","), lambda y: F.concat(F.regexp_extract(x, r"^([^{]*)\{", 1), F.trim(y)))))
    own = F.concat(F.transform(F.split(inner, ","), lambda x: F.trim(x)), nested)
    each = F.transform(F.filter(own, lambda x: x != ""), lambda x: F.when(x == "self", F.regexp_replace(head, r"[:.]+$", "")).otherwise(F.concat(head, x)))
    return F.when(path.contains("{"), each).otherwise(F.transform(F.split(path, ","), lambda x: F.trim(x)))


def extract(files: DataFrame) -> DataFrame:
    """file, specifier, names of the imports of files (file, language, text): native regular expressions, names of one
    specifier merged. Python names of `from` imports are kept for every such line."""
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])[F.col("language")], F.col("language"))
    rows = files.withColumn("family", base)
    rows = rows.unionByName(rows.where("language = 'vue'").withColumn("family", F.lit("vue")))  # a template's components, besides its script
    out = None
    for family, patterns in PATTERNS.items():
        for pattern in patterns:
            two = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(") > 1
            group = 2 if family == "javascript" and two else 1
            found = rows.where(F.col("family") == family).select("file", "language", F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("s"), F.regexp_extract_all("text", F.lit(pattern), F.lit(3 - group if two else group)).alias("n")).alias("z"))
            found = found.select("file", "language", F.explode("z").alias("z")).select("file", "language", F.col("z.s").alias("specifier"), (_names(F.col("z.n")) if two else F.array().cast("array<string>")).alias("names"))
            if family == "python" and not two:
                found = found.select("file", "language", F.explode(F.transform(F.split("specifier", ","), lambda x: F.regexp_extract(F.trim(x), r"^([\w.]+)", 1))).alias("specifier"), "names")
            if pattern.endswith(r"\(([^)]*)\)"):  # a block: its quoted strings
                found = found.select("file", "language", F.explode(F.regexp_extract_all("specifier", F.lit(r"\"([\w./-]+)\""), F.lit(1))).alias("specifier"), "names")
            if family in ("rust", "scala"):  # lists in braces
                found = found.select("file", "language", F.explode(_unfolded(F.col("specifier"), "::" if family == "rust" else ".")).alias("specifier"), "names")
            if family == "sql" and "source" in pattern:
                found = found.withColumn("specifier", F.array_join(F.regexp_extract_all("specifier", F.lit(r"[^'\",\s]+"), F.lit(0)), "."))
            if family == "vhdl":
                found = found.where(~F.lower("specifier").rlike(r"^work(\.|$)"))
            if family in ("java", "csharp"):
                found = found.withColumn("names", F.array(F.element_at(F.split("specifier", r"\."), -1)))
            out = found if out is None else out.unionByName(found)
    out = out.where("specifier <> '' and specifier <> '__future__'")
    return out.groupBy("file", "language", "specifier").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def _join_path(folder: Column, relative: Column) -> Column:
    """folder/relative with dot segments resolved."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    step = lambda s, x: F.when((x == "..") & (F.size(s) > 0), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x == "..", s).otherwise(F.concat(s, F.array(x)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def _with_endings(base: Column) -> Column:
    plain = F.array(base, *[F.concat(base, F.lit(e)) for e in ENDINGS], *[F.concat(base, F.lit("/index" + e)) for e in SCRIPT_ENDINGS[:4]], F.concat(base, F.lit("/__init__.py")))
    stem = F.regexp_replace(base, r"\.js$", "")
    return F.when(base.rlike(r"\.js$"), F.array(base, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")))).when(base.rlike(r"\.[A-Za-z]+$") & ~base.rlike(r"/[^/]*\.[^/]*\.[^/]*$"), F.concat(F.array(base), plain)).otherwise(plain)


def source_roots(files: DataFrame) -> DataFrame:
    """root: parents of packages that lie in no package; without packages, the first folders of Python files; and ''."""
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    packages = files.where(X.basename(F.col("file")) == "__init__.py").select(folder.alias("d")).distinct()
    parents = packages.select("d", F.regexp_replace("d", r"/?[^/]*$", "").alias("root"))
    top = parents.join(packages.select(F.col("d").alias("root")), "root", "left_anti").select("root").distinct()
    plain = files.where(F.col("file").endswith(".py")).select(F.when(F.col("file").contains("/"), F.element_at(F.split("file", "/"), 1)).otherwise("").alias("root")).distinct()
    some = packages.limit(1).select(F.lit(True).alias("some"))
    fallback = plain.join(some, F.lit(True), "left_anti")
    return top.unionByName(fallback).unionByName(files.sparkSession.createDataFrame([("",)], "root string")).distinct()


def resolve(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """src, dst, specifier: imports (file, specifier) that name a file. Each specifier yields candidate paths with priorities,
    in this order: relative, namespace, as it stands, dotted module (below each source root), alias, .sql stem. One equi-join
    finds which exist; the first of each import counts. Leading dots of Python modules mean parent folders."""
    s, folder = F.col("specifier"), F.regexp_replace("file", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract(s, r"^(\.+)", 1))
    module = s.rlike(r"^\.+\w*[\w.]*$") & F.col("file").endswith(".py")
    up = F.concat_ws("/", folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.translate(F.regexp_replace(s, r"^\.+", ""), ".", "/"))
    relative = F.when(module, _join_path(F.lit(""), up)).when(s.startswith("."), _join_path(folder, s))
    rows = imports.select("file", "specifier").distinct()
    dotted = ~s.startswith(".") & s.contains(".") & ~s.contains("/") & ~s.contains("\\")
    none = F.array().cast("array<string>")
    below = F.transform(_with_endings(F.translate(s, ".", "/")), lambda x: F.concat(F.lit("below:"), x))
    alias = F.lit(None).cast("string")
    for prefix, target in (aliases or {}).items():
        alias = F.when(s.startswith(prefix.rstrip("*")), F.concat(F.lit(target.rstrip("*")), F.substring(s, len(prefix.rstrip("*")) + 1, 1000))).otherwise(alias)
    space = F.lit(None).cast("string")
    for prefix, target in sorted((namespaces or {}).items(), key=lambda x: len(x[0])):
        space = F.when(s.startswith(prefix), F.concat(F.lit(target.rstrip("/") + "/"), F.translate(F.substring(s, len(prefix) + 1, 1000), "\\", "/"), F.lit(".php"))).otherwise(space)
    steps = [F.when(relative.isNotNull(), _with_endings(relative)).otherwise(none), F.when(space.isNotNull(), F.array(space)).otherwise(none), F.when(~s.startswith("."), _with_endings(s)).otherwise(none), F.when(dotted, below).otherwise(none), F.when(alias.isNotNull(), _with_endings(alias)).otherwise(none), F.when(~s.rlike(r"[./\\]"), F.array(F.concat(F.lit("sql:"), F.lower(s)))).otherwise(none)]
    tried = rows.select("file", "specifier", F.posexplode(F.concat(*steps)).alias("priority", "path"))
    own = files.select("file").distinct().select(F.col("file").alias("dst"), F.col("file").alias("path"))
    stems = files.where(F.col("file").endswith(".sql")).groupBy(F.concat(F.lit("sql:"), F.lower(X.stem_of_path(F.col("file")))).alias("path")).agg(F.min("file").alias("dst")).select("dst", "path")
    # Each file's path below each source root that holds it: a join with the roots, however many there are.
    folders = F.split(F.regexp_replace("file", r"/?[^/]*$", ""), "/")
    above = files.select("file", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/")))).alias("root")).distinct()
    rooted = above.join(source_roots(files), "root").select(F.col("file").alias("dst"), F.concat(F.lit("below:"), F.when(F.col("root") == "", F.col("file")).otherwise(F.expr("substring(file, length(root) + 2)"))).alias("path"))
    found = tried.join(own.unionByName(stems).unionByName(rooted), "path").groupBy("file", "specifier").agg(F.min_by("dst", F.struct("priority", F.length("dst"), "dst")).alias("dst"))
    return found.select(F.col("file").alias("src"), "dst", "specifier")


def file_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("src <> dst").select("src", "dst").distinct()
