"""Scans: source trees, slices of them, commit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spelunka.functions import text as X

# Folders and files that no scan reads, and the language of an extension.
SKIP_FOLDERS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", ".mypy_cache", "vendor"]
SECRET_FILES = r"(^|/)(\.env(\..+)?|id_rsa|id_dsa|id_ed25519|credentials(\.json)?|\.npmrc|\.pypirc|.*\.(pem|key|p12|pfx|jks))$"
SKIP_FILES = r"\.(min\.js|min\.css|map|lock)$|(^|/)package-lock\.json$"
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "vue": "vue", "go": "go", "java": "java",
    "kt": "kotlin", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "m": "objc", "ino": "arduino", "asm": "asm", "s": "asm", "vhd": "vhdl", "vhdl": "vhdl",
    "v": "verilog", "sv": "verilog", "rb": "ruby", "cs": "csharp", "php": "php", "swift": "swift", "scala": "scala", "hs": "haskell", "dart": "dart", "sql": "sql", "md": "markdown",
}
FIRST_FOLDERS = ["src", "lib", "pkg", "cmd", "internal"]
MAX_BYTES = 1 << 20


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("unknown"))


def ignore_rule(pattern: str, folder: str = "") -> str:
    """A regular expression, over paths from the root, of one line of an ignore file that lies in folder."""
    pattern = pattern.rstrip()
    only_folder = pattern.endswith("/")
    body = pattern.strip("/")
    rooted = "/" in body or pattern.startswith("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (body[i] if body[i].isalnum() or body[i] in "_/" else "\\" + body[i]), i + 1
    base = "^" + (folder.strip("/") + "/" if folder.strip("/") else "")
    return base + ("" if rooted else "(.*/)?") + out + ("/.*$" if only_folder else "(/.*)?$")


def ignored(path: Column, lines: list[tuple[str, str]]) -> Column:
    """Whether ignore lines (folder, pattern), in order, leave path out; later lines win, '!' takes back."""
    found = F.lit(False)
    for folder, line in lines:
        if not line.strip() or line.startswith("#"):
            continue
        take_back = line.startswith("!")
        found = F.when(path.rlike(ignore_rule(line.lstrip("!"), folder)), F.lit(not take_back)).otherwise(found)
    return found


def _hidden(spark: SparkSession, root: str) -> list[str]:
    """Files that Spark's readers pass over: names or folders that begin with a dot or an underscore. Names only; a tree's size."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    base = len(fs.makeQualified(top).toString().rstrip("/")) + 1
    out, files = [], fs.listFiles(top, True)
    while files.hasNext():
        uri = files.next().getPath().toString()
        if any(x[:1] in "._" for x in uri[base:].split("/")):
            out.append(uri)
    return out


def _read(frames):
    import pandas as pd
    from pyarrow import fs

    for df in frames:
        rows = []
        for uri in df["path"]:
            store, path = fs.FileSystem.from_uri(uri)
            info = store.get_file_info(path)
            with store.open_input_stream(path) as f:
                content = f.read()
            rows.append((uri, content, len(content), (info.mtime_ns or 0) // 1000))
        yield pd.DataFrame(rows, columns=["path", "content", "length", "us"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (from root), content, size_bytes, mtime_ns of every file below root, read by the executors."""
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", "length", F.unix_micros("modificationTime").alias("us"))
    if hidden := _hidden(spark, root):
        seen = seen.unionByName(spark.createDataFrame([(x,) for x in hidden], "path string").repartition(min(64, len(hidden))).mapInPandas(_read, "path string, content binary, length long, us long"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), "^" + "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in base) + "/", "")
    return seen.select(path.alias("path"), "content", F.col("length").alias("size_bytes"), (F.col("us") * 1000).alias("mtime_ns"))


def skip_reason(ignore: list[tuple[str, str]] = (), extra: list[str] = (), max_bytes: int = MAX_BYTES) -> Column:
    """Why a scanned file is left out: the first test it fails, or null."""
    p = F.col("path")
    folders = r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in SKIP_FOLDERS) + ")/"
    own = F.lit(False)
    for g in extra:
        own = own | X.glob(p, g, "name")
    return (
        F.when(p.rlike(folders), "skip_folder").when(p.rlike(SKIP_FILES), "skip_file").when(p.rlike(r"(^|/)\.\.(/|$)"), "path_traversal").when(ignored(p, list(ignore)), "gitignore").when(own, "extra_ignore")
        .when(p.rlike(SECRET_FILES), "secret").when(language_of(p) == "unknown", "unknown_extension").when(F.col("size_bytes") > max_bytes, "too_large").when(F.locate("\x00", F.decode(F.substring("content", 1, 8192), "ISO-8859-1")) > 0, "binary")
    )


def discover(files: DataFrame, limit: int | None = None, **rules) -> tuple[DataFrame, DataFrame]:
    """(files kept with language and hash, counts by skip reason). A limit keeps priority folders first, then shallow paths."""
    marked = files.withColumn("skip_reason", skip_reason(**rules))
    kept = marked.where("skip_reason is null").drop("skip_reason").withColumns({"language": language_of(F.col("path")), "hash": F.sha2("content", 256)})
    if limit is not None:
        first = F.array_position(F.array(*map(F.lit, FIRST_FOLDERS)), F.element_at(F.split("path", "/"), 1))
        kept = kept.orderBy(F.when(first == 0, len(FIRST_FOLDERS) + 1).otherwise(first), F.size(F.split("path", "/")), "path").limit(limit)
    return kept, marked.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def lines_of(files: DataFrame) -> DataFrame:
    """file, line (from 1), text."""
    text = F.decode(F.col("content"), "UTF-8")
    return files.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def commit_log(log: DataFrame) -> DataFrame:
    """Commits by file from log text (column value, one log a row) of `git log --name-only --format=%x01%H%x02%an%x02%at%x02%s`."""
    one = log.select(F.explode(F.filter(F.split("value", "\x01"), lambda x: x != "")).alias("c"))
    head = F.split(F.element_at(F.split("c", "\n"), 1), "\x02")
    names = F.filter(F.slice(F.split("c", "\n"), 2, 1_000_000), lambda x: F.trim(x) != "")
    return one.select(head[0].alias("sha"), head[1].alias("author"), F.timestamp_seconds(head[2].cast("long")).alias("ts"), head[3].alias("subject"), F.explode(names).alias("file"))


def package_names(manifests: DataFrame) -> DataFrame:
    """path, ecosystem, package from manifests (path, text)."""
    t, name = F.col("text"), X.basename(F.col("path"))
    quoted = lambda key: F.regexp_extract(t, rf"(?m)^\s*{key}\s*=\s*[\"']([^\"']+)[\"']", 1)
    package = (
        F.when(name == "pyproject.toml", X.package_name(quoted("name"))).when(name == "setup.cfg", X.package_name(F.regexp_extract(t, r"(?m)^\s*name\s*=\s*(\S+)", 1))).when(name == "package.json", F.get_json_object(t, "$.name"))
        .when(name == "go.mod", F.regexp_extract(t, r"(?m)^module\s+(\S+)", 1)).when(name == "Cargo.toml", quoted("name")).when(name.endswith(".csproj"), F.coalesce(F.nullif(F.regexp_extract(t, r"<PackageId>([^<]+)</PackageId>", 1), F.lit("")), X.stem_of_path(F.col("path"))))
    )
    kind = F.when(name.isin("pyproject.toml", "setup.cfg"), "python").when(name == "package.json", "npm").when(name == "go.mod", "go").when(name == "Cargo.toml", "rust").when(name.endswith(".csproj"), "nuget")
    return manifests.select("path", kind.alias("ecosystem"), package.alias("package")).where("package is not null and package <> ''")


def root_package(specifier: Column, language: Column) -> Column:
    """The package that an import specifier names, by language."""
    s = specifier
    npm = F.when(s.startswith("@"), F.regexp_extract(s, "^(@[^/]+/[^/]+)", 1)).otherwise(F.element_at(F.split(s, "/"), 1))
    go = F.when(F.size(F.split(s, "/")) >= 3, F.array_join(F.slice(F.split(s, "/"), 1, 3), "/")).otherwise(s)
    return (
        F.when(s.startswith("."), None).when(language == "python", X.package_name(F.element_at(F.split(s, r"\."), 1))).when(language.isin("javascript", "typescript", "tsx", "vue"), npm)
        .when(language == "go", go).when(language == "rust", F.element_at(F.split(s, "::"), 1)).when(language == "csharp", F.element_at(F.split(s, r"\."), 1)).otherwise(F.element_at(F.split(s, r"[./\\]"), 1))
    )


def infrastructure(files: DataFrame) -> DataFrame:
    """path, category, name, value from build and deployment files (path, text): one row a finding, regular expressions only."""
    p, t = F.col("path"), F.col("text")
    base = X.basename(p)
    rules = [
        ("docker", base.rlike(r"^Dockerfile"), "base_image", r"(?m)^FROM\s+(\S+)"), ("docker", base.rlike(r"^Dockerfile"), "port", r"(?m)^EXPOSE\s+(\d+)"), ("docker", base.rlike(r"^Dockerfile"), "env", r"(?m)^ENV\s+([A-Z_][A-Z0-9_]*)"), ("docker", base.rlike(r"^Dockerfile"), "entrypoint", r"(?m)^(?:ENTRYPOINT|CMD)\s+(.+)$"), ("docker", base.rlike(r"^Dockerfile"), "copy", r"(?m)^COPY\s+(\S+)"),
        ("compose", base.rlike(r"^(docker-)?compose.*\.ya?ml$"), "service", r"(?m)^  ([A-Za-z0-9_-]+):\s*$"), ("compose", base.rlike(r"^(docker-)?compose.*\.ya?ml$"), "image", r"(?m)^\s+image:\s*(\S+)"),
        ("k8s", t.rlike(r"(?m)^apiVersion:"), "kind", r"(?m)^kind:\s*(\S+)"), ("ci", p.rlike(r"\.github/workflows/.*\.ya?ml$"), "uses", r"(?m)uses:\s*(\S+)"), ("ci", p.rlike(r"\.github/workflows/.*\.ya?ml$") | (base == ".gitlab-ci.yml") | p.endswith(".circleci/config.yml"), "run", r"(?m)(?:run|script|command):\s*(\S.*)$"),
        ("env", base.rlike(r"^\.env\.(example|sample|template)$"), "variable", r"(?m)^([A-Z_][A-Z0-9_]*)="), ("make", base == "Makefile", "target", r"(?m)^([A-Za-z0-9_.-]+):"), ("scripts", base == "pyproject.toml", "script", r"(?m)^[\w-]+\s*=\s*[\"']([\w.]+:[\w.]+)[\"']"),
    ]
    found = F.concat(*[F.when(test, F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), _tagger(category, name))).otherwise(F.array().cast("array<struct<category:string,name:string,value:string>>")) for category, test, name, pattern in rules])
    return files.select("path", F.explode(found).alias("x")).select("path", "x.*")


def _tagger(category: str, name: str):
    return lambda v: F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), v.alias("value"))


def infra_references(findings: DataFrame, files: DataFrame) -> DataFrame:
    """path, value, file: path-like words of findings that end in an indexed file; joined on the last segment, shortest file first."""
    words = findings.select("path", F.explode(F.regexp_extract_all("value", F.lit(r"[\w./-]+\.[A-Za-z]+"), F.lit(0))).alias("value")).withColumn("base", X.basename(F.col("value")))
    found = words.join(files.select("file", X.basename(F.col("file")).alias("base")), "base").where((F.col("file") == F.col("value")) | F.col("file").endswith(F.concat(F.lit("/"), F.regexp_replace("value", r"^\./", ""))))
    first = Window.partitionBy("path", "value").orderBy(F.length("file"), "file")
    return found.withColumn("k", F.row_number().over(first)).where("k = 1").select("path", "value", "file")
