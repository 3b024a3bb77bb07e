import os

from pyspark.sql import functions as F

from spelunka.operators import hygiene as Y
from spelunka.sources import folder, imports, parser, store
from spelunka.streaming import watch

TREE = {
    "pkg/__init__.py": "from .core import Engine\n",
    "pkg/core.py": "import os\nfrom pkg.util import helper, other\n\nLIMIT = 5\n\n\nclass Base:\n    pass\n\n\nclass Engine(Base):\n    '''Runs things.'''\n\n    @property\n    def go(self, a, b=1):\n        # TODO later\n        return helper(a)\n",
    "pkg/util.py": "def helper(x):\n    try:\n        return eval(x)\n    except:\n        pass\n\n\ndef other(y):\n    y = 41\n    return helper(y)\n",
    "web/app.ts": "import { Foo } from './foo';\nexport function run(a) {\n  return Foo(a);\n}\n",
    "web/foo.ts": "export class Foo {\n}\n",
    "node_modules/x.js": "ignored()",
    ".env": "A=1",
    "logs/a.py": "x = 1",
    "broken.py": "def (",
    "data.bin": "x",
}


def tree(tmp_path):
    for name, text in TREE.items():
        p = tmp_path / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def test_scan_parse_resolve(spark, tmp_path):
    files, skipped = folder.discover(folder.scan(spark, tree(tmp_path)), ignore=[("", "logs/")])
    assert {r.skip_reason: r.n for r in skipped.collect()} == {"skip_folder": 1, "gitignore": 1, "secret": 1, "unknown_extension": 1}
    assert {r.path for r in files.collect()} == {"pkg/__init__.py", "pkg/core.py", "pkg/util.py", "web/app.ts", "web/foo.ts", "broken.py"}
    assert [r.path for r in folder.discover(folder.scan(spark, str(tmp_path)), limit=1, ignore=[("", "logs/")])[0].collect()] == ["pkg/__init__.py"]  # pkg is a priority folder
    symbols = parser.parse_symbols(files).cache()
    ids = {r.id for r in symbols.collect()}
    assert {"pkg/core.py::LIMIT#constant", "pkg/core.py::Engine.go#method", "pkg/util.py::helper#function", "web/app.ts::run#function", "web/foo.ts::Foo#class"} <= ids
    go = symbols.where("name = 'go'").first()
    assert go.parent == "pkg/core.py::Engine#class" and go.decorators == ["property"] and go.param_count == 3 and go.call_references == ["helper"] and go.line == 14
    content = files.where("path = 'pkg/core.py'").select(F.decode(F.substring("content", go.byte_offset + 1, go.byte_length), "UTF-8").alias("x")).first().x
    assert content.strip().startswith("@property") and content.strip().endswith("helper(a)")
    texts = files.select(F.col("path").alias("file"), "language", F.decode("content", "UTF-8").alias("text"))
    found = imports.resolve(imports.extract(texts), files.select(F.col("path").alias("file")))
    assert {(r.src, r.dst) for r in imports.file_edges(found).collect()} == {("pkg/__init__.py", "pkg/core.py"), ("pkg/core.py", "pkg/util.py"), ("web/app.ts", "web/foo.ts")}
    calls = symbols.select(F.col("id").alias("caller_id"), F.col("file").alias("caller_file"), F.explode("call_references").alias("name"))
    edges = imports.file_edges(found)
    got = {(r.caller_id, r.callee_id) for r in Y.callers(symbols, calls, edges).collect()}
    assert ("pkg/core.py::Engine.go#method", "pkg/util.py::helper#function") in got
    rules = {(r.file, r.rule) for r in parser.search_ast(files).collect()}
    assert {("pkg/util.py", "empty_catch"), ("pkg/util.py", "bare_except"), ("pkg/util.py", "eval_exec"), ("pkg/core.py", "todo_fixme"), ("pkg/util.py", "reassigned_param"), ("pkg/util.py", "magic_number")} <= rules
    assert parser.search_ast(files, pattern="call:helper").count() == 2


def test_manifests_and_log(spark):
    m = spark.createDataFrame([("a/pyproject.toml", "[project]\nname = 'My_Pkg'\n"), ("b/package.json", '{"name": "@x/y"}'), ("go.mod", "module example.org/z\n")], "path string, text string")
    assert {r.package for r in folder.package_names(m).collect()} == {"my-pkg", "@x/y", "example.org/z"}
    log = spark.createDataFrame([("\x01s1\x02Ann\x0286400\x02Fix\n\na.py\nb.py\n\x01s2\x02Bo\x02172800\x02Add\n\na.py\n",)], "value string")
    assert sorted((r.sha, r.file) for r in folder.commit_log(log).collect()) == [("s1", "a.py"), ("s1", "b.py"), ("s2", "a.py")]
    infra = folder.infrastructure(spark.createDataFrame([("Dockerfile", "FROM python:3\nCOPY app/run.py /x\nEXPOSE 80\nCMD python app/run.py\n")], "path string, text string"))
    assert {(r.name, r.value) for r in infra.collect()} == {("base_image", "python:3"), ("copy", "app/run.py"), ("port", "80"), ("entrypoint", "python app/run.py")}
    refs = folder.infra_references(infra, spark.createDataFrame([("app/run.py",), ("x/app/run.py",)], "file string"))
    assert {r.file for r in refs.collect()} == {"app/run.py"}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    df = spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, file string")
    s.save("symbols", df, "r1")
    s.save("symbols", df, "r2", "dev")
    s.update("symbols", spark.createDataFrame([("c", "f2")], "id string, file string"), spark.createDataFrame([("f1",)], "file string"), "file", "r1")
    assert [r.id for r in s.load("symbols", "r1").collect()] == ["c"] and s.load("symbols", "r2", "dev").count() == 2
    assert s.repositories().count() == 2
    s.drop("symbols", "r2", "dev")
    assert s.repositories().count() == 1


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "t" if i % 2 else "u", float(i), i % 5 != 0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, s string, tool string, duration_ms double, ok boolean").select("event_id", F.to_timestamp("s").alias("ts"), "tool", "duration_ms", "ok", F.lit(1).alias("user_id"), F.lit(2.0).alias("size"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def run(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    latency = {r.tool: r for r in run(watch.rolling_latency(stream()), "update", "lat")}
    assert latency["t"].n == 20 and latency["t"].p50 == 21.0 and latency["t"].max_ms == 39.0
    accepted = run(watch.rate_limit(stream(), "user_id", 10, 60), "append", "lim")
    assert sorted(r.event_id for r in accepted if r.accepted) == list(range(10))
    assert sum(r.n for r in run(watch.windowed_counts(stream(), width="10 seconds"), "complete", "win")) == 40
    assert [r.n for r in run(watch.turns(stream()), "complete", "turns")] == [40]
    seen = []
    watch.watch(spark, src, df.schema, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(c for _, c in seen) == 40


def test_classify_and_generations(spark):
    batch = spark.createDataFrame([("a", "h2", 1), ("b", "h", 2), (".git/x", "h", 3), ("c", None, 4), ("d", "same", 5)], "path string, hash string, seq long")
    known = spark.createDataFrame([("a", "h1"), ("c", "h"), ("d", "same")], "path string, hash string")
    assert {r.path: r.state for r in watch.classify(batch, known).collect()} == {"a": "modified", "b": "added", "c": "deleted"}
    g = watch.Generations()
    first, second = g.start("r"), g.start("r")
    assert not g.finish("r", first) and g.finish("r", second) and not g.stale("r")
