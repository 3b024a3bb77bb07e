"""Hygiene queries: dead and untested code, references, layers, renames, configuration audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spelunka.functions import text as X
from spelunka.operators import graph as G
from spelunka.operators import search as S


def dead_files(files: DataFrame, edges: DataFrame, include_tests: bool = False, patterns: list[str] = (), extra_roots: DataFrame | None = None) -> DataFrame:
    """file, confidence: 1.0 without importers (0.9 for a test), 0.7 if no importer is itself imported or live; others live."""
    path = F.col("file")
    root = X.is_entry(path) | (X.basename(path) == "__init__.py")
    if include_tests:
        root = root | X.is_test(path)
    for p in patterns:
        root = root | X.glob(path, p, "name")
    marked = files.select("file").distinct().withColumn("root", root)
    if extra_roots is not None:
        marked = marked.join(extra_roots.select("file").distinct().withColumn("x", F.lit(True)), "file", "left").select("file", (F.col("root") | F.coalesce("x", F.lit(False))).alias("root"))
    e = G.simple(edges)
    imported = e.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("importers"))
    state = marked.join(imported, "file", "left").fillna(0, ["importers"])
    live = state.where((F.col("importers") > 0) | F.col("root")).select(F.col("file").alias("src"))
    held = e.join(live, "src", "left_semi").select(F.col("dst").alias("file")).distinct().withColumn("held", F.lit(True))
    state = state.join(held, "file", "left").where(~F.col("root"))
    confidence = F.when(F.col("importers") == 0, F.when(X.is_test(path), 0.9).otherwise(1.0)).when(F.col("held").isNull(), 0.7)
    return state.select("file", confidence.alias("confidence")).where("confidence is not null")


def dead_symbols(symbols: DataFrame, reached: DataFrame, called: DataFrame, exported: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """symbols with three signals and their mean: file not reached, name never called, name not exported by a barrel."""
    flag = lambda d, c, name: d.select(c).distinct().withColumn(name, F.lit(False))
    s = symbols.join(flag(reached, "file", "unreachable_file"), "file", "left").join(flag(called, "name", "no_callers"), "name", "left").join(flag(exported, "name", "not_exported"), "name", "left")
    signals = ["unreachable_file", "no_callers", "not_exported"]
    s = s.fillna(True, signals)
    confidence = sum((F.col(c).cast("int") for c in signals), F.lit(0)) / 3.0
    return s.withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence)


def barrel_names(contents: DataFrame, barrels: DataFrame | None = None) -> DataFrame:
    """name: every identifier in the files that gather exports (column file, content)."""
    held = contents.where(X.is_barrel(F.col("file"))) if barrels is None else contents.join(barrels, "file", "left_semi")
    return held.select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name")).distinct()


def untested(symbols: DataFrame, test_imports: DataFrame, test_calls: DataFrame) -> DataFrame:
    """symbols, confidence, reason: 1.0 if no test imports the file, 0.7 if one does but none calls or names the symbol."""
    imported = test_imports.select("file").distinct().withColumn("i", F.lit(True))
    named = test_calls.select("file", "name").distinct().withColumn("c", F.lit(True))
    s = symbols.join(imported, "file", "left").join(named, ["file", "name"], "left").where(F.col("i").isNull() | F.col("c").isNull())
    return s.withColumns({"confidence": F.when(F.col("i").isNull(), 1.0).otherwise(0.7), "reason": F.when(F.col("i").isNull(), "unreached").otherwise("imported_not_called")}).drop("i", "c")


def extraction_candidates(symbols: DataFrame, callers: DataFrame, min_complexity: int, min_callers: int) -> DataFrame:
    """Complex functions that many files call (callers: id, file): score is complexity times callers."""
    per = callers.groupBy("id").agg(F.countDistinct("file").alias("callers")).where(F.col("callers") >= min_callers)
    return symbols.where(F.col("cyclomatic") >= min_complexity).join(per, "id").withColumn("score", F.col("cyclomatic") * F.col("callers"))


def layer_of(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The first layer one of whose prefixes the path has; null if none."""
    found = F
    for name, prefixes in layers:
        test = F.lit(False)
        for p in prefixes:
            test = test | path.startswith(p)
        found = found.when(test, name)
    return found.otherwise(F.lit(None).cast("string"))


def layer_violations(edges: DataFrame, layers: list[tuple[str, list[str]]], forbidden: dict[str, list[str]]) -> DataFrame:
    """src, dst and their layers where the source's layer may not import the target's. All literals: no join."""
    e = edges.select("src", "dst", layer_of(F.col("src").cast("string"), layers).alias("src_layer"), layer_of(F.col("dst").cast("string"), layers).alias("dst_layer"))
    bad = F.lit(False)
    for layer, others in forbidden.items():
        bad = bad | ((F.col("src_layer") == layer) & F.col("dst_layer").isin(others))
    return e.where(bad)


def rename_collisions(symbols: DataFrame, edges: DataFrame, target_id, new_name: str) -> DataFrame:
    """Symbols that already have new_name in the target's file or in a direct importer of it."""
    one = symbols.where(F.col("id") == F.lit(target_id)).select(F.col("file").alias("tf"))
    near = one.select(F.col("tf").alias("file")).unionByName(edges.join(one, edges["dst"] == one["tf"]).select(F.col("src").alias("file"))).distinct()
    return symbols.where((F.lower("name") == new_name.lower()) & (F.col("id") != F.lit(target_id))).join(near, "file", "left_semi")


def references(imports: DataFrame, name: str) -> DataFrame:
    """file, specifier, match_type of imports of a name: by imported name, else by the specifier's stem (imports: file, specifier, names)."""
    named = F.exists("names", lambda n: F.lower(n) == name.lower())
    stem = F.lower(X.stem_of_path(F.col("specifier"))) == name.lower()
    return imports.where(named | stem).select("file", "specifier", F.when(named, "named").otherwise("specifier").alias("match_type")).dropDuplicates(["file", "specifier"])


def content_references(lines: DataFrame, defining: DataFrame, name: str) -> DataFrame:
    """Lines that hold name outside the files that define it."""
    return lines.where(F.lower("text").contains(name.lower())).join(defining.select("file").distinct(), "file", "left_anti").withColumn("text", F.substring("text", 1, 200))


def callers(symbols: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """callee_id, caller_id: calls (caller_id, caller_file, name) of a symbol from its file or a file that imports it."""
    s = symbols.select(F.col("id").alias("callee_id"), "name", F.col("file").alias("seen"))
    c = calls.select("caller_id", "caller_file", "name").distinct()
    # What each caller's file sees comes first, so that symbols are joined on file and name, never on a common name alone.
    near = c.withColumn("seen", F.col("caller_file")).unionByName(c.join(G.simple(edges).select(F.col("src").alias("caller_file"), F.col("dst").alias("seen")), "caller_file"))
    return near.join(s, ["seen", "name"]).where("caller_id <> callee_id").select("callee_id", "caller_id").distinct()


def callees(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """caller_id, callee_id, resolution: resolved within the file, inferred elsewhere (imports are not asked)."""
    s = symbols.select(F.col("id").alias("callee_id"), "name", F.col("file").alias("callee_file"))
    pairs = calls.select("caller_id", "caller_file", "name").distinct().join(s, "name").where("caller_id <> callee_id")
    return pairs.select("caller_id", "callee_id", F.when(F.col("caller_file") == F.col("callee_file"), "ast_resolved").otherwise("ast_inferred").alias("resolution")).distinct()


def _by_rows_of_id(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols (callee_id, name, file) whose id stands in one distinct row, and the others."""
    s = symbols.distinct()
    again = s.groupBy("callee_id").count().where("count > 1").select("callee_id")
    return s.join(again, "callee_id", "left_anti"), s.join(again, "callee_id", "left_semi")


def caller_counts(symbols: DataFrame, calls: DataFrame, edges: DataFrame, itself: bool = False) -> DataFrame:
    """callee_id, callers: how many rows callers() has for each symbol, without making them.

    Symbols of one file and name have the same callers, so callers are counted by what they see and name, and the counts are
    joined; only ids that stand in several files or under several names are paired with callers. itself: calls of a symbol by
    itself count (or ids of callers and symbols are unrelated)."""
    s = symbols.select(F.col("id").alias("callee_id"), "name", F.col("file").alias("seen"))
    sees = G.simple(edges).unionByName(s.select(F.col("seen").alias("src"), F.col("seen").alias("dst")).distinct())
    near = calls.select("caller_id", "caller_file", "name").join(sees.select(F.col("src").alias("caller_file"), F.col("dst").alias("seen")), "caller_file").select("caller_id", "seen", "name").distinct()
    one, many = _by_rows_of_id(s)
    found = one.join(near.where("caller_id is not null").groupBy("seen", "name").agg(F.count("*").alias("callers")), ["seen", "name"]).select("callee_id", "callers")
    pairs = many.join(near, ["seen", "name"]).where("caller_id is not null").select("callee_id", "caller_id").distinct()
    found = found.unionByName(pairs.groupBy("callee_id").agg(F.count("*").alias("callers")))
    if not itself:
        own = near.join(s.withColumn("caller_id", F.col("callee_id")), ["caller_id", "seen", "name"]).select("callee_id").distinct().withColumn("own", F.lit(1))
        found = found.join(own, "callee_id", "left").select("callee_id", (F.col("callers") - F.coalesce("own", F.lit(0))).alias("callers")).where("callers > 0")
    return found


def callee_counts(symbols: DataFrame, calls: DataFrame, itself: bool = False) -> DataFrame:
    """caller_id, resolution, n: how many rows callees() has for each caller and resolution, without making them.

    Symbols are counted by name and by name and file; only ids that stand in several files or under several names are paired
    with callers. itself as in caller_counts()."""
    one, many = _by_rows_of_id(symbols.select(F.col("id").alias("callee_id"), "name", "file"))
    c = calls.select("caller_id", "caller_file", "name").distinct()
    here = one.groupBy("name", F.col("file").alias("caller_file")).agg(F.count("*").alias("here"))
    total = here.groupBy("name").agg(F.sum("here").alias("total"))
    # A name called from several files is elsewhere for one of them at least, wherever its symbols are.
    named = c.join(total, "name").join(here, ["name", "caller_file"], "left").groupBy("caller_id", "name").agg(F.sum(F.coalesce("here", F.lit(0))).alias("here"), F.count("*").alias("files"), F.max("total").alias("total"))
    sums = named.groupBy("caller_id").agg(F.sum("here").alias("ast_resolved"), F.sum(F.when(F.col("files") > 1, F.col("total")).otherwise(F.col("total") - F.col("here"))).alias("ast_inferred"))
    kind = F.when(F.col("caller_file") == F.col("file"), "ast_resolved").otherwise("ast_inferred").alias("resolution")
    pairs = c.join(many, "name").select("caller_id", "callee_id", kind).distinct().groupBy("caller_id", "resolution").agg(F.count("*").alias("n"))
    found = sums.unpivot("caller_id", ["ast_resolved", "ast_inferred"], "resolution", "n").unionByName(pairs)
    if not itself:
        own = c.join(one.unionByName(many).withColumn("caller_id", F.col("callee_id")), ["caller_id", "name"]).select("caller_id", kind).distinct()
        found = found.unionByName(own.withColumn("n", F.lit(-1).cast("long")))
    return found.groupBy("caller_id", "resolution").agg(F.sum("n").alias("n")).where("n > 0")


PRECEDENCE = ["dispatch", "lsp", "ast", "text"]


def combined_edges(sources: dict[str, DataFrame]) -> DataFrame:
    """caller_id, callee_id, source: union of edge sources, each pair once by the first source in PRECEDENCE."""
    out = None
    for name, df in sources.items():
        part = df.select("caller_id", "callee_id", F.lit(PRECEDENCE.index(name)).alias("p"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("caller_id", "callee_id").agg(F.min("p").alias("p"))
    return best.select("caller_id", "callee_id", F.element_at(F.array(*map(F.lit, PRECEDENCE)), F.col("p") + 1).alias("source"))


def enclosing(points: DataFrame, ranges: DataFrame, key: str = "file") -> DataFrame:
    """For each point (key, pos) the innermost range (key, start, end, id) around it: the last to start, of those the first to end.

    A range is cut into the aligned blocks of 2 ** level positions that fill it, two a level at most, and each block keeps its
    innermost range. A point looks into the one block of each level that holds it, so the join is an equi-join that finds at
    most one row a level, however many ranges overlap or however long they are."""
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    one = ranges.select(key, start.alias("start"), end.alias("end"), "id").where("start <= end").groupBy(key, "start", "end").agg(F.max("id").alias("id"))
    cut = one.withColumn("__level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("end") - F.col("start") + 1)) - 1)))
    below = -F.expr("shiftright(-start, __level)")  # the first block of the level that starts in the range, and behind the last that ends in it
    behind = F.expr("shiftright(end + 1, __level)")
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    used = F.filter(F.array(F.when(odd(below) & (below < behind), below), F.when(odd(behind) & (below < behind), behind - 1)), lambda x: x.isNotNull())
    inner = F.max(F.struct("start", (-F.col("end")).alias("until"), "id"))
    blocks = cut.select(key, "__level", F.explode(used).alias("__block"), "start", "end", "id").groupBy(key, "__level", "__block").agg(inner.alias("r"))
    tall = blocks.groupBy(key).agg(F.max("__level").alias("tall"))
    p = points.distinct().join(tall, key).withColumn("__level", F.explode(F.sequence(F.lit(0), "tall"))).withColumn("__block", F.expr("shiftright(cast(pos as long), __level)"))
    return p.join(blocks, [key, "__level", "__block"]).groupBy(*[c for c in points.columns]).agg(F.max("r").alias("r")).select(*points.columns, F.col("r.id").alias("id"))


def near_symbols(points: DataFrame, ranges: DataFrame, key: str = "file", within: int = 5, width: int = 64) -> DataFrame:
    """Pairs of a point and each range that holds it or starts within a few lines of it."""
    wide = ranges.withColumns({"lo": F.least("start", F.col("start") - within), "hi": F.greatest("end", F.col("start") + within)})
    r = wide.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    p = points.withColumn("bucket", F.floor(F.col("pos") / width))
    return p.join(r, [key, "bucket"]).where(F.col("pos").between(F.col("start"), F.col("end")) | (F.abs(F.col("pos") - F.col("start")) <= within)).drop("bucket", "lo", "hi")


def stale_references(refs: DataFrame, names: DataFrame, distance: int = 3) -> DataFrame:
    """ref, suggestion: last segments of references (longer than 3) that are no name, with the nearest name within distance.

    Candidates share what is left after at most distance deletions, as any two names within that distance do: no cross
    join, and none is missed. A name of n characters has about n ** 3 / 6 such remains at distance 3."""
    last = refs.select(F.element_at(F.split("ref", r"\."), -1).alias("ref")).where(F.length("ref") > 3).distinct()
    known = names.select("name").where(F.length("name") > 0).distinct()
    stale = last.join(known.withColumnRenamed("name", "ref"), "ref", "left_anti")
    near = S.deletions(stale, "ref", distance).join(S.deletions(known, "name", distance), "v").where(F.abs(F.length("ref") - F.length("name")) <= distance).select("ref", "name").distinct()
    close = near.withColumn("d", F.levenshtein("ref", "name", distance)).where("d >= 0").groupBy("ref").agg(F.min_by("name", F.struct("d", "name")).alias("suggestion"))
    return stale.join(close, "ref", "left")


def dead_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (column ref) that no file ends with: joined on the last segment, then the suffix is tested."""
    r = refs.select("ref").distinct().withColumn("base", X.basename(F.col("ref")))
    f = files.select("file").distinct().withColumn("base", X.basename(F.col("file")))
    found = r.join(f, "base").where(F.col("file").endswith(F.col("ref"))).select("ref").distinct()
    return r.join(found, "ref", "left_anti").select("ref")


def duplicate_runs(lines: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """file, start, length: runs of at least that many consecutive lines that each occur anywhere in other."""
    known = other.select(F.col("text")).where("text <> ''").distinct()
    shared = lines.join(known, "text", "left_semi")
    island = F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return shared.withColumn("island", island).groupBy("file", "island").agg(F.min("line").alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def bloat(files: DataFrame, text: str = "content", tokens: int = 2000) -> DataFrame:
    """files with token estimate and verdict: too long, or mostly code blocks."""
    blocks = F.regexp_extract_all(text, F.lit("(?s)```.*?```"), F.lit(0))
    share = F.aggregate(blocks, F.lit(0), lambda a, b: a + F.length(b)) / F.nullif(F.length(text), F.lit(0))
    n = X.token_estimate(F.col(text))
    return files.withColumns({"tokens": n, "verdict": F.when(n > tokens, "too_long").when((share > 0.5) & (F.size(blocks) > 2), "mostly_code").otherwise("ok")})


# -- reachability of code, end to end -----------------------------------------------------------------------------------


def live_roots(files: DataFrame, contents: DataFrame | None = None, manifests: DataFrame | None = None, patterns: list[str] = (), include_tests: bool = True) -> DataFrame:
    """file: entry points by name, main guards in contents (file, content), entries that manifests name (file), patterns, tests."""
    path = F.col("file")
    by_name = X.is_entry(path) | (X.is_test(path) if include_tests else F.lit(False))
    for p in patterns:
        by_name = by_name | X.glob(path, p, "name")
    roots = files.where(by_name).select("file")
    if contents is not None:
        roots = roots.unionByName(contents.where(F.col("content").rlike(X.MAIN_GUARD)).select("file"))
    if manifests is not None:
        roots = roots.unionByName(files.join(manifests, "file", "left_semi").select("file"))
    return roots.distinct()


def barrel_exports(contents: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """file, name: identifiers that a barrel file names, for itself and for what it imports, over at most hops re-exports."""
    barrels = contents.where(X.is_barrel(F.col("file")))
    own = barrels.select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    found = front = G.kept(own.distinct())
    e = G.simple(edges)
    for _ in range(hops):
        front = G.kept(front.join(e.select(F.col("src").alias("file"), "dst"), "file").select(F.col("dst").alias("file"), "name").distinct().join(found, ["file", "name"], "left_anti"))
        if front.isEmpty():
            break
        found = G.kept(found.unionByName(front))
    return found


DECORATED = r"(?i)(route|get|post|put|delete|command|task|fixture|event|listener|handler|register|hook)"
DECORATED_CAP = 0.5


def dead_code(symbols: DataFrame, edges: DataFrame, calls: DataFrame, exports: DataFrame, roots: DataFrame, min_confidence: float = 0.33) -> DataFrame:
    """id, file, name, confidence of symbols that nothing seems to use: the mean of three signals, that no root reaches the
    file (nor it a root's importer), that no call names the symbol, that no barrel exports it. Without any edges the call
    signal stands alone. What a decorator may register is capped at 0.5.

    symbols: id, file, name, decorators; calls: name; exports: from barrel_exports(); roots: from live_roots()."""
    start = roots.select(F.col("file").alias("node"))
    reached = G.reachable(edges, start).select(F.col("node").alias("file"))
    flag = lambda d, keys, name: d.select(*keys).distinct().withColumn(name, F.lit(0))
    s = symbols.join(flag(reached, ["file"], "unreached"), "file", "left").join(flag(calls, ["name"], "uncalled"), "name", "left").join(flag(exports, ["file", "name"], "unexported"), ["file", "name"], "left")
    s = s.fillna(1, ["unreached", "uncalled", "unexported"])
    mean = F.col("uncalled").cast("double") if edges.isEmpty() else (F.col("unreached") + F.col("uncalled") + F.col("unexported")) / 3.0
    capped = F.when(F.exists(F.coalesce("decorators", F.array()), lambda d: d.rlike(DECORATED)), F.least(mean, F.lit(DECORATED_CAP))).otherwise(mean)
    return s.select("id", "file", "name", F.round(capped, 4).alias("confidence")).where(F.col("confidence") >= min_confidence)


def blast_radius(edges: DataFrame, contents: DataFrame, changed: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """file, depth, level, tested: the files that import the changed ones (column file), directly or not. A direct importer
    whose content names the symbol is confirmed, the others are potential; tested says whether a test file imports it.
    The changed files themselves are left out."""
    levels = G.bfs(G.reverse(edges), changed.select(F.col("file").alias("node")), depth).select(F.col("node").alias("file"), "depth")
    named = G.mentions(contents, name).where("references > 0").select("file").distinct().withColumn("named", F.lit(True))
    tests = G.simple(edges).where(X.is_test(F.col("src"))).select(F.col("dst").alias("file")).distinct().withColumn("t", F.lit(True))
    found = levels.join(changed.select("file"), "file", "left_anti").join(named, "file", "left").join(tests, "file", "left")
    level = F.when((F.col("depth") == 1) & F.col("named"), "confirmed").otherwise("potential")
    return found.select("file", "depth", level.alias("level"), F.col("t").isNotNull().alias("tested"))


def gateway_kind(signature: Column, decorators: Column) -> Column:
    """What kind of way in a symbol is, by its decorators, else by its name: http, cli, event, task, test; null for none."""
    text = F.concat_ws(" ", decorators)
    return (
        F.when(text.rlike(r"(?i)\b(route|get|post|put|patch|delete|api)\b"), "http").when(text.rlike(r"(?i)\b(command|click|argument)\b"), "cli")
        .when(text.rlike(r"(?i)\b(on|event|listener|subscribe|receiver)\b"), "event").when(text.rlike(r"(?i)\b(task|job|schedule|cron)\b"), "task")
        .when(signature.rlike(r"\bmain\s*\("), "cli").when(signature.rlike(r"\btest_?\w*\s*\("), "test")
    )


def orphan_share(symbols: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: symbols, those that no gateway reaches (chains: from graph.signal_chains()), and their share in percent."""
    seen = chains.select(F.col("node").alias("id")).distinct().withColumn("s", F.lit(1))
    return symbols.join(seen, "id", "left").agg(F.count("*").alias("symbols"), F.sum(F.when(F.col("s").isNull(), 1).otherwise(0)).alias("orphans")).withColumn("percent", F.round(100.0 * F.col("orphans") / F.nullif("symbols", F.lit(0)), 2))


def scope_leaks(entries: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """file, line, text, scope: lines of an agent's configuration that name a path of another scope than their file's.
    entries: file, line, text; scopes: (name, path prefix). A file belongs to the first scope whose prefix it has."""
    own = layer_of(F.col("file"), [(name, [prefix]) for name, prefix in scopes])
    rows = entries.withColumn("own", own)
    named = F.array(*(F.when(F.col("text").contains(prefix), F.lit(name)) for name, prefix in scopes))
    return rows.withColumn("scope", F.explode(F.filter(named, lambda x: x.isNotNull()))).where("own is not null and scope <> own").select("file", "line", "text", "scope")
