"""Telemetry, sessions, tuning and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RING = 512
GAP_SECONDS = 30
STEP, LEAST_CHANGE, LEAST_EVENTS = 0.05, 0.05, 50


def ring(events: DataFrame, key: str, k: int = RING, order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """The last k rows of each key; the window limit keeps k rows a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def at_index(sorted_values: Column, index: Column) -> Column:
    return F.get(sorted_values, index)


def latency(events: DataFrame, key: str, value: str = "duration_ms", ok: str = "ok", k: int = RING) -> DataFrame:
    """n, p50, p95, max, error_rate of each key's ring; percentiles by index n//2 and int(0.95 n), not interpolated."""
    v = F.sort_array(F.collect_list(value))
    out = ring(events, key, k).groupBy(key).agg(F.count("*").alias("n"), v.alias("v"), F.max(value).alias("max_ms"), F.avg(F.when(F.col(ok), 0.0).otherwise(1.0)).alias("error_rate"))
    p95 = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1).cast("int")
    return out.select(key, "n", at_index(F.col("v"), F.floor(F.col("n") / 2).cast("int")).alias("p50"), at_index(F.col("v"), p95).alias("p95"), "max_ms", F.round("error_rate", 4).alias("error_rate"))


def ledger(events: DataFrame, repo: str, tool: str, confidence: str) -> DataFrame:
    """Events by repo and tool, both and in all, with mean confidence and conditional counts: one pass."""
    return events.groupingSets([[F.col(repo), F.col(tool)], [F.col(repo)], []], F.col(repo), F.col(tool)).agg(
        F.count("*").alias("events"), F.round(F.avg(confidence), 3).alias("mean_confidence"), F.count_if(F.col("stale")).alias("stale"), F.count_if(F.col("identity_hit")).alias("identity"), F.count_if(F.col("semantic_used")).alias("semantic")
    )


def tuner_step(now: float, first: Column, second: Column, n: Column, low: float, high: float) -> Column:
    """A weight moves a step towards the condition with higher mean confidence, if there are events enough and the means differ."""
    delta = first - second
    new = F.when((n < LEAST_EVENTS) | delta.isNull() | (F.abs(delta) < LEAST_CHANGE), F.lit(now)).when(delta > 0, F.lit(now + STEP)).otherwise(F.lit(now - STEP))
    return F.least(F.lit(high), F.greatest(F.lit(low), new))


def tune(events: DataFrame, semantic: float = 0.5, identity: float = 1.0) -> DataFrame:
    """New weights from conditional means of confidence."""
    mean = lambda test: F.avg(F.when(test, F.col("confidence")))
    m = events.agg(F.count("confidence").alias("n"), mean(F.col("semantic_used")).alias("with_s"), mean(~F.col("semantic_used")).alias("no_s"), mean(F.col("identity_hit")).alias("with_i"), mean(~F.col("identity_hit")).alias("no_i"))
    return m.select("n", F.round(tuner_step(semantic, F.col("with_s"), F.col("no_s"), F.col("n"), 0.1, 0.8), 4).alias("semantic_weight"), F.round(tuner_step(identity, F.col("with_i"), F.col("no_i"), F.col("n"), 0.5, 2.0), 4).alias("identity_boost"))


def sessions(events: DataFrame, key: str, size: str, budget: float, gap: int = GAP_SECONDS, order: str = "event_id") -> DataFrame:
    """events with turn, used (running size in the turn) and state: a turn ends at a gap of more than so many seconds."""
    w = Window.partitionBy(key).orderBy("ts", order)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.when(us - F.lag(us).over(w) > gap * 1_000_000, 1).otherwise(0)
    turn = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = events.withColumn("__new", new).withColumn("turn", turn).drop("__new")
    used = F.sum(size).over(Window.partitionBy(key, "turn").orderBy("ts", order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("used", used).withColumn("state", F.when(F.col("used") >= budget, "over").when(F.col("used") >= 0.8 * budget, "warn").otherwise("ok"))


def offered_rate(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """events with offered, how many of the key came within the last seconds, this one included."""
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("offered", F.count("*").over(w)).drop("__us")


def journal(events: DataFrame, key: str, k: int = 10, by: str = "frequency") -> DataFrame:
    """key, n, last: the k most frequent or most recent."""
    out = events.groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    order = [F.desc("n"), F.col(key)] if by == "frequency" else [F.desc("last_ts"), F.col(key)]
    return out.orderBy(*order).limit(k)


def ranking_quality(predicted: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query, recall, mrr, ndcg at k: predicted has query, id, rank (from 1); relevant has query, id. Zero without relevant ids."""
    rel = relevant.select("query", "id").distinct()
    hits = predicted.where(F.col("rank") <= k).join(rel, ["query", "id"]).groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(1.0 + F.col("rank"))).alias("dcg"))
    total = rel.groupBy("query").agg(F.count("*").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(1.0 + i))
    out = predicted.select("query").distinct().join(total, "query", "left").join(hits, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query", zero(F.col("hits") / F.col("total")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.when(F.col("total") > 0, F.col("dcg") / ideal)).alias("ndcg"))


def soft_match(a: Column, b: Column) -> Column:
    """Equal, sharing a dot segment, or a dot prefix; case ignored."""
    a, b = F.lower(a), F.lower(b)
    return (a == b) | F.arrays_overlap(F.split(a, r"\."), F.split(b, r"\.")) | F.startswith(b, F.concat(a, F.lit("."))) | F.startswith(a, F.concat(b, F.lit(".")))


def soft_precision(predicted: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query, precision (of the k first, or of fewer if fewer came), recall (1 without relevant ids), by soft matches."""
    top = predicted.where(F.col("rank") <= k)
    seg = lambda d, c: d.select("query", F.col("id").alias(c), F.explode(F.split(F.lower("id"), r"\.")).alias("s"))
    pairs = seg(top, "p").join(seg(relevant, "r"), ["query", "s"]).select("query", "p", "r").distinct()  # every soft match shares a segment
    found = pairs.groupBy("query").agg(F.countDistinct("p").alias("good"), F.countDistinct("r").alias("got"))
    n, m = top.groupBy("query").agg(F.count("*").alias("n")), relevant.groupBy("query").agg(F.countDistinct("id").alias("m"))
    both = n.join(found, "query", "left").join(m, "query", "left")
    return both.select("query", (F.coalesce("good", F.lit(0)) / F.least(F.col("n"), F.lit(k))).alias("precision"), F.when(F.col("m").isNull(), 1.0).otherwise(F.coalesce("got", F.lit(0)) / F.col("m")).alias("recall"))


def drift(now: DataFrame, then: DataFrame, alarm: float = 0.05) -> DataFrame:
    """One row: largest and mean 1 - cosine between two snapshots (id, v), and whether it alarms."""
    from spelunka.operators.search import cosine

    d = now.select("id", F.col("v").alias("a")).join(then.select("id", F.col("v").alias("b")), "id").select((1 - cosine(F.col("a"), F.col("b"))).alias("d"))
    return d.agg(F.count("*").alias("n"), F.max("d").alias("worst"), F.avg("d").alias("mean")).withColumn("alarm", F.col("worst") > alarm)
