"""Greedy packing under a budget, over all candidates.

Packing is sequential by nature, so it folds over one list; but only few rows can be taken. What is used up only grows, so
once a row does not fit, no later row of its size or more does: of each size, the rows taken are the first ones, at most
budget / size of them. The list holds these alone (some budget x ln(budget) rows), and nothing that could be taken is left
out. Rows without a size are not taken; rows of size 0 or less always fit and join at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DECAY, PER_FILE = 0.5, 3


def _takeable(df: DataFrame, budget: int, order: list[Column], size: str, group: str | None, more: Column | int = 0) -> DataFrame:
    """Of each size the first rows, as many as fit the budget, and some more."""
    fits = df.where((F.col(size) > 0) & (F.col(size) <= budget))
    place = F.row_number().over(Window.partitionBy(*([group] if group else []), size).orderBy(*order))
    return fits.withColumn("__s", place).where(F.col("__s") <= F.floor(F.lit(budget) / F.col(size)) + more).drop("__s")


def _listed(df: DataFrame, order: list[Column], fields: list[str], group: str | None) -> DataFrame:
    """One row a group (or one in all): its rows as a list in order."""
    rows = df.withColumn("__k", F.row_number().over(Window.partitionBy(*([group] if group else [])).orderBy(*order)))
    items = F.array_sort(F.collect_list(F.struct("__k", *fields))).alias("items")
    return rows.groupBy(group).agg(items) if group else rows.agg(items)


def greedy_skip(df: DataFrame, budget: int, order: list[Column], size: str, key: str, group: str | None = None) -> DataFrame:
    """Rows taken in order while they fit; what doesn't fit is skipped and the walk goes on."""
    lists = _listed(_takeable(df, budget, order, size, group), order, [size, key], group)
    item = lists.schema["items"].dataType.elementType
    empty = F.array().cast(f"array<{item.simpleString()}>")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("taken"))

    def step(s, x):
        fits = s["used"] + x[size] <= budget
        return F.struct(F.when(fits, s["used"] + x[size]).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"))

    packed = lists.select(*([group] if group else []), F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x"))
    free = df.where(F.col(size) <= 0).select(*([group] if group else []), key, size)
    return packed.select(*([group] if group else []), F.col(f"x.{key}").alias(key), F.col(f"x.{size}").alias(size)).unionByName(free)


def diverse_pack(df: DataFrame, budget: int, order: list[Column], size: str, key: str, file: str, score: str, per_file: int = PER_FILE) -> DataFrame:
    """As greedy_skip, at most per_file rows of one file; a file's n-th further row counts half to the power n. Rows without
    a positive size are not taken.

    Of one size in one file at most per_file rows can be taken, the first ones. Beyond those that fit, a row may be passed
    over because its file is full; full files number at most budget / (per_file x least size), and each passes over at most
    per_file such rows of a size: so many more are listed."""
    in_file = _takeable(df, budget, order, size, file).withColumn("__f", F.row_number().over(Window.partitionBy(file, size).orderBy(*order))).where(F.col("__f") <= per_file).drop("__f")
    least = in_file.agg(F.min(size)).first()[0] or 1
    lists = _listed(_takeable(in_file, budget, order, size, None, int(budget // least) + per_file), order, [size, key, file, score], None)
    item = lists.schema["items"].dataType.elementType
    taken = F.array().cast(f"array<struct<x:{item.simpleString()},n:int>>")
    start = F.struct(F.lit(0).cast("long").alias("used"), taken.alias("taken"))

    def step(s, x):
        n = F.size(F.filter(s["taken"], lambda t: t["x"][file] == x[file]))
        fits = (s["used"] + x[size] <= budget) & (n < per_file)
        return F.struct(F.when(fits, s["used"] + x[size]).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, F.concat(s["taken"], F.array(F.struct(x.alias("x"), n.alias("n"))))).otherwise(s["taken"]).alias("taken"))

    packed = lists.select(F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("t"))
    return packed.select(F.col(f"t.x.{key}").alias(key), F.col(f"t.x.{file}").alias(file), F.col(f"t.x.{size}").alias(size), (F.col(f"t.x.{score}") * F.pow(F.lit(DECAY), F.col("t.n").cast("double"))).alias("adjusted"))


def prefix_pack(df: DataFrame, budget: int, order: list[Column], size: str) -> DataFrame:
    """Rows in order up to the first that does not fit (a break, not a skip). Sizes are at least 1, or the row counts as 1:
    so no more than budget rows can come before the break, and a top-k finds them."""
    first = df.withColumn("__size", F.greatest(F.col(size), F.lit(1))).orderBy(*order).limit(budget)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("__used", F.sum("__size").over(w)).where(F.col("__used") <= budget).drop("__used", "__size")


def bundle_order(strategy: str) -> list[Column]:
    """Orders of a context bundle: most_relevant by score, core_first by kind and centrality, compact by size."""
    if strategy == "most_relevant":
        return [F.desc("score"), F.col("id")]
    if strategy == "core_first":
        return [F.desc("is_target"), F.desc("centrality"), F.col("id")]
    if strategy == "compact":
        return [F.asc("size"), F.col("id")]
    raise ValueError(f"unknown strategy {strategy!r}")
