"""Whole-project operators: packages and their repositories, summaries, context enrichment, outlines, health, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spelunka.functions import text as X
from spelunka.operators import graph as G

# Where agents keep their configuration; globs below a home folder or a project.
AGENT_FILES = {
    "global": ["*/.claude/CLAUDE.md", "*/.codeium/windsurf/memories/global_rules.md"],
    "project": ["CLAUDE.md", "*/CLAUDE.md", "AGENTS.md", "*/AGENTS.md", ".cursorrules", ".cursor/rules/*", ".github/copilot-instructions.md", ".windsurfrules"],
}
COMPACT_FROM = 5
CENTRAL, OUTLINE_FOLDERS, TWO_LEVELS_FROM = 10, 40, 500


def agent_files(files: DataFrame) -> DataFrame:
    """file and scope (global, project) of the files that configure agents."""
    scope = F
    for name, patterns in AGENT_FILES.items():
        test = F.lit(False)
        for p in patterns:
            test = test | X.glob(F.col("file"), p)
        scope = scope.when(test, name)
    return files.withColumn("scope", scope.otherwise(F.lit(None).cast("string"))).where("scope is not null").select("file", "scope")


def package_registry(packages: DataFrame) -> DataFrame:
    """package, repos (sorted): who provides each package. packages: repo, package."""
    return packages.groupBy("package").agg(F.array_sort(F.collect_set("repo")).alias("repos"))


def cross_repo_files(imports: DataFrame, packages: DataFrame, entries: DataFrame) -> DataFrame:
    """repo, package, provider, file: for each import (repo, package) the providers besides itself, and the entry file that
    each has for the package (entries: repo, file), the shortest, then the least."""
    providers = packages.select(F.col("repo").alias("provider"), "package").distinct()
    entry = entries.groupBy(F.col("repo").alias("provider")).agg(F.min_by("file", F.struct(F.length("file"), "file")).alias("file"))
    return imports.select("repo", "package").distinct().join(providers, "package").where("repo <> provider").join(entry, "provider", "left").select("repo", "package", "provider", "file")


def language_summary(symbols: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """category, n, files: symbols of the languages of each category (API, data, infrastructure)."""
    category = F
    for name, languages in kinds.items():
        category = category.when(F.col("language").isin(languages), name)
    return symbols.withColumn("category", category.otherwise(F.lit(None).cast("string"))).where("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def enriched(symbols: DataFrame, context: DataFrame) -> DataFrame:
    """symbols with the context that a provider gives their file (file, description, tags, properties): description becomes
    the summary where there is none, tags and the names of properties become keywords."""
    c = context.select("file", "description", F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce(F.map_keys("properties"), F.array().cast("array<string>")))).alias("__k"))
    both = symbols.join(c, "file", "left")
    words = F.array_sort(F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("__k", F.array().cast("array<string>")))))
    return both.withColumns({"keywords": words, "summary": F.when(F.coalesce("summary", F.lit("")) == "", F.coalesce("description", F.lit(""))).otherwise(F.col("summary"))}).drop("description", "__k")


def all_edges(edges: DataFrame, *extra: DataFrame) -> DataFrame:
    """Import edges and those that context providers add (src, dst), each once."""
    out = edges.select("src", "dst")
    for e in extra:
        out = out.unionByName(e.select("src", "dst"))
    return G.simple(out)


def named(symbols: DataFrame, wanted: str) -> DataFrame:
    """id, name, file, status of what a name or id may mean: the id alone if one has it, else all of that name; ok if it is
    one, ambiguous if several."""
    hits = symbols.where((F.col("id").cast("string") == wanted) | (F.col("name") == wanted)).withColumn("by_id", F.col("id").cast("string") == wanted)
    best = hits.agg(F.max("by_id").alias("any_id"))
    found = hits.join(F.broadcast(best)).where(F.col("by_id") | ~F.col("any_id"))
    n = found.agg(F.count("*").alias("n"))
    return found.join(F.broadcast(n)).select("id", "name", "file", F.when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("status"))


def detail_level(k: int, budget: int | None = None, debug: bool = False) -> str:
    """compact for several results that nothing else bounds, else standard."""
    return "compact" if budget is None and not debug and k >= COMPACT_FROM else "standard"


def top_folder(file: Column, two_levels: Column) -> Column:
    parts = F.split(file, "/")
    return F.when(F.size(parts) == 1, ".").when(two_levels & (F.size(parts) > 2), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def repo_outline(files: DataFrame, edges: DataFrame) -> DataFrame:
    """what, value, n: files by top folder (two levels beyond 500 files, if these are more), the 40 largest; the ten files
    imported more than once most often; the ten of highest rank."""
    paths = files.select("file").distinct()
    sizes = paths.agg(F.count("*").alias("n"), F.count_distinct(top_folder(F.col("file"), F.lit(False))).alias("one"), F.count_distinct(top_folder(F.col("file"), F.lit(True))).alias("two"))
    finer = sizes.select(((F.col("n") > TWO_LEVELS_FROM) & (F.col("two") > F.col("one"))).alias("finer"))
    folder = paths.join(F.broadcast(finer)).groupBy(top_folder(F.col("file"), F.col("finer")).alias("value")).agg(F.count("*").alias("n"))
    imported = G.simple(edges).groupBy(F.col("dst").alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    rank = G.pagerank(edges).select(F.col("node").alias("value"), F.col("rank").alias("n"))
    best = lambda df, what, k: df.orderBy(F.desc("n"), "value").limit(k).select(F.lit(what).alias("what"), F.col("value").cast("string").alias("value"), F.round(F.col("n").cast("double"), 6).alias("n"))
    return best(folder, "folder", OUTLINE_FOLDERS).unionByName(best(imported, "imported", CENTRAL)).unionByName(best(rank, "central", CENTRAL))


def cycles(edges: DataFrame) -> DataFrame:
    """component, size, members (sorted) of dependency cycles."""
    return G.strong_components(edges).groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))


def health(symbols: DataFrame, dead: DataFrame, hotspots: DataFrame, edges: DataFrame, least_confidence: float = 0.67) -> DataFrame:
    """One row: symbols, mean complexity, dead ones (dead: id, confidence), cycles, unstable modules, the worst hotspot."""
    base = symbols.agg(F.count("*").alias("symbols"), F.round(F.avg("cyclomatic"), 4).alias("complexity"))
    gone = dead.where(F.col("confidence") >= least_confidence).agg(F.count("*").alias("dead"))
    rings = G.strong_components(edges).agg(F.count_distinct("component").alias("cycles"))
    shaky = G.coupling(edges, G.nodes_of(edges)).agg(F.sum(F.when(F.col("assessment") == "unstable", 1).otherwise(0)).alias("unstable"))
    worst = hotspots.agg(F.max("hotspot").alias("worst_hotspot"))
    return base.join(gone).join(rings).join(shaky).join(worst)  # all one row each


def snippet_pack(snippets: DataFrame, budget: int, score: str = "references", size: str = "size") -> DataFrame:
    """file, id, used: snippets of the files in order of their references; inside a file the first that does not fit ends
    the file, and what is left of the budget goes on to the next. Sizes are positive: so no file takes more than the first
    rows whose own sum fits, and files of which not even the first row fits a whole budget are left out beforehand."""
    own = Window.partitionBy("file").orderBy(F.desc("weight"), "id")
    ranked = snippets.withColumn("__sum", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= budget)
    files = ranked.groupBy("file").agg(F.max(score).alias("__score"), F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id", F.col(size).alias("n")))).alias("items"))
    # A file takes at least 1, so no more than budget files can take anything before the budget is used up.
    first = files.orderBy(F.desc("__score"), "file").limit(budget)
    listed = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("__score")).alias("s"), "file", "items"))).alias("files"))
    taken = F.array().cast("array<struct<file:string,id:bigint,used:bigint>>")

    def item(s, x, file):
        fits = s["open"] & (s["used"] + x["n"] <= budget)
        used = F.when(fits, s["used"] + x["n"]).otherwise(s["used"])
        return F.struct(used.alias("used"), fits.alias("open"), F.when(fits, F.concat(s["taken"], F.array(F.struct(file.cast("string").alias("file"), x["id"].cast("long").alias("id"), used.alias("used"))))).otherwise(s["taken"]).alias("taken"))

    def one(s, f):
        inner = F.aggregate(f["items"], F.struct(s["used"].alias("used"), F.lit(True).alias("open"), s["taken"].alias("taken")), lambda a, x: item(a, x, f["file"]))
        return F.struct(inner["used"].alias("used"), inner["taken"].alias("taken"))

    packed = F.aggregate("files", F.struct(F.lit(0).cast("long").alias("used"), taken.alias("taken")), one, lambda s: s["taken"])
    return listed.select(F.explode(packed).alias("t")).select("t.*")
