"""Edit plans: renames and moves as rows of lines before and after."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelunka.operators import graph as G

# What an import line and a definition look like.
IMPORT_LINE = r"^\s*(import|from|use|using|include|export)\b|require\(|#\s*include"
DEFINES = r"\b(def|class|function|func|fn|struct|interface|type|enum|trait|const|let|var)\s+"


def line_kind(text: Column, name: str) -> Column:
    return F.when(text.rlike(IMPORT_LINE), "import").when(text.rlike(DEFINES + re.escape(name) + r"\b"), "definition").otherwise("usage")


def rename_plan(lines: DataFrame, files: DataFrame, old: str, new: str) -> DataFrame:
    """file, line, kind, before, after of every line of the files (column file) that has old as a whole word outside a line
    that is one string only."""
    word = rf"\b{re.escape(old)}\b"
    held = lines.where(F.col("text").rlike(word) & ~F.col("text").rlike(r"^\s*(['\"]).*\1[,;]?\s*$")).join(files.select("file").distinct(), "file", "left_semi")
    return held.select("file", "line", line_kind(F.col("text"), old).alias("kind"), F.col("text").alias("before"), F.regexp_replace("text", word, new.replace("\\", "\\\\").replace("$", "\\$")).alias("after"))


def affected_files(edges: DataFrame, defining: DataFrame, depth: int = 3) -> DataFrame:
    """The defining files (column file) and their importers up to depth."""
    start = defining.select(F.col("file").alias("node"))
    return G.bfs(G.reverse(edges), start, depth).select(F.col("node").alias("file")).unionByName(defining.select("file")).distinct()


def move_plan(symbols: DataFrame, lines: DataFrame, imports: DataFrame, symbol_id, target: str) -> dict[str, DataFrame]:
    """body: the lines of the symbol; needed: import names that occur in it; collisions: names that the target has already."""
    one = F.broadcast(symbols.where(F.col("id") == F.lit(symbol_id)).select(F.col("file").alias("sf"), "name", F.col("line").alias("lo"), F.col("end_line").alias("hi")).limit(1))
    body = lines.join(one, (F.col("file") == F.col("sf")) & F.col("line").between(F.col("lo"), F.col("hi"))).select("file", "line", "text")
    words = body.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name")).distinct()
    own = imports.join(one.select(F.col("sf").alias("file")), "file", "left_semi").select("specifier", F.explode("names").alias("name"))
    collisions = symbols.where(F.col("file") == target).join(one.select("name"), "name", "left_semi").select("id", "name")
    return {"body": body, "needed": own.join(words, "name", "left_semi"), "collisions": collisions}


def call_sites(lines: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """file, line, arguments of calls of a name, for changes of its signature. Brackets inside the arguments nest to any
    depth; a call that goes on behind its line has what stands on that line."""
    word = rf"\b{re.escape(name)}\s*\("
    found = lines.where(F.col("text").rlike(word) & ~F.col("text").rlike(DEFINES + re.escape(name) + r"\b")).join(files.select("file").distinct(), "file", "left_semi")
    # Each call's rest of the line, read letter by letter until its parenthesis closes.
    rests = F.slice(F.split("text", word), 2, 1_000_000)
    cut = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    whole = F.transform(F.sequence(F.lit(1), F.size(rests)), lambda i: F.concat(rests[i - 1], F.array_join(F.flatten(F.transform(F.sequence(i + 1, F.size(rests) + 1), lambda j: F.when(j <= F.size(rests), F.array(cut[j - 1], rests[j - 1])).otherwise(F.array()))), "")))

    def step(s, c):
        depth = F.when(s["d"] < 1, s["d"]).when(c.isin("(", "[", "{"), s["d"] + 1).when(c.isin(")", "]", "}"), s["d"] - 1).otherwise(s["d"])
        return F.struct(depth.alias("d"), F.when((s["d"] >= 1) & (depth >= 1), F.concat(s["t"], c)).otherwise(s["t"]).alias("t"))

    inside = lambda rest: F.aggregate(F.split(rest, ""), F.struct(F.lit(1).alias("d"), F.lit("").alias("t")), step, lambda s: s["t"])
    return found.select("file", "line", F.explode(F.transform(whole, inside)).alias("arguments"))


def _escaped(c: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _replaced(parts: Column, code: str, raw: str) -> Column:
    return F.transform(parts, lambda p: F.replace(p, F.lit(code), F.lit(raw)))


def _unescaped(c: Column) -> Column:
    parts = F.split(c, r"\\\\")  # each escaped backslash apart, so that what follows it is read by itself
    for code, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        parts = _replaced(parts, code, raw)
    return F.array_join(parts, "\\")


NULL = "\\N"  # how a cell is null
MIN_GAIN = 0.15


def compact_table(df: DataFrame, columns: list[str], min_uses: int = 4) -> tuple[DataFrame, DataFrame]:
    """(legend: value, code; rows: row): values of string columns that recur get short codes (@1, @2, ...); a row is its
    cells, tab-separated, with backslash escapes, so expanded_table() gives the table back. Cells that begin with @ are
    escaped as well."""
    from spelunka.operators.history import legend

    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    plain = lambda c: F.coalesce(F.regexp_replace(_escaped(F.col(c).cast("string")), "^@", r"\\@"), F.lit(NULL))
    if not texts:
        return df.sparkSession.createDataFrame([], "value string, code string"), df.select(F.concat_ws("\t", *map(plain, columns)).alias("row"))
    values = df.select(F.explode(F.array(*texts)).alias("value")).where("value is not null")
    best = legend(values, "value", min_uses=min_uses)
    coded = best.select("value").orderBy("value").selectExpr("value", "concat('@', cast(row_number() over (order by value) as string)) as code")
    table = F.broadcast(coded.agg(F.map_from_entries(F.collect_list(F.struct("value", "code"))).alias("codes")))  # at most the legend's size
    cell = lambda c: F.coalesce(F.try_element_at("codes", F.col(c)), plain(c)) if c in texts else plain(c)
    return coded, df.join(table).select(F.concat_ws("\t", *map(cell, columns)).alias("row"))


def expanded_table(legend: DataFrame, rows: DataFrame, schema: str) -> DataFrame:
    """The table that compact_table() encoded, with the columns and types of schema (a DDL string)."""
    from pyspark.sql import types as T

    table = F.broadcast(legend.agg(F.map_from_entries(F.collect_list(F.struct("code", "value"))).alias("codes")))  # at most the legend's size
    cells = rows.join(table).select(F.split("row", "\t").alias("cells"), "codes")

    def value(i):
        c = F.col("cells")[i]
        return F.when(c == NULL, None).when(c.startswith("@"), F.try_element_at("codes", c)).otherwise(_unescaped(F.regexp_replace(c, r"^\\@", "@")))

    return cells.select(*(value(i).cast(f.dataType).alias(f.name) for i, f in enumerate(T.StructType.fromDDL(schema).fields)))


def worth_encoding(df: DataFrame, legend: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: bytes of the plain rows, of legend and rows, and whether encoding saves at least 15 %."""
    size = lambda d, c: d.agg(F.coalesce(F.sum(F.octet_length(c) + 1), F.lit(0)).alias("n"))
    plain = size(df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("row")), "row").withColumnRenamed("n", "plain")
    coded = size(rows, "row").withColumnRenamed("n", "rows").join(size(legend.select(F.concat("code", "value").alias("v")), "v"))
    return plain.join(coded).select("plain", (F.col("rows") + F.col("n")).alias("encoded")).withColumn("worth", F.col("encoded") <= (1 - MIN_GAIN) * F.col("plain"))
