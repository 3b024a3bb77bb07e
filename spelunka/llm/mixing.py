"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Native: DataFrame functions only. Documents are summed once into cells of (source, language, topic); everything iterative
runs on cells. Each round rescales the cells' weights so that the marginals of source, then language, then topic meet
their targets: a sum by group, combined before it is shuffled, joined back to the cells; so a topic that a third of all
cells has is no large partition. ``rounds`` rounds are made, each step kept in the shared folder. A cell's sampling
probability is min(1, c x weight / tokens), with c such that the expected tokens are ``keep`` of all; c is found by a fixed
point that needs two sums over the cells a step. A document stays if the uniform number that its id gives is below its
cell's probability, so repeated runs and repeated rows agree.

Targets default to tempered shares: each value's tokens to the power ``temper``, normalised. The topic is the column
``topic`` of mixed(); by default it is the first of TOPICS whose pattern a text holds.

A document's tokens are estimated as a quarter of its bytes, at least 1. Cells and marginals are broadcast only after they
have been counted, up to ``max_broadcast_cells``; beyond it they are joined by Spark's own choice.

Defined results: nulls in source, language or topic form values of their own; a null text has no bytes; a null id draws
the number of the empty string; an empty table gives no rows. All columns of the table stay, but that __topic, __tokens,
__weight, __p and __kept replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import documents, durable, fresh, written

ROUNDS, TEMPER, KEEP = 10, 0.7, 0.7
STEPS = 24
MAX_BROADCAST_CELLS = 100_000
PARTS = ("source", "lang", "topic")

# The default topics, by the first pattern that a text holds, and the topic of the rest.
TOPICS = (("licence", "[Ll]icen[cs]e|[Cc]opyright"), ("contact", "@|https?://"), ("numbers", "[0-9][0-9][0-9]"))
REST = "prose"


def topic_of(text: Column) -> Column:
    found = F
    for name, pattern in TOPICS:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise(REST)


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def draw_of(doc_id: Column) -> Column:
    """A uniform number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def tempered(cells: DataFrame, part: str, temper: float) -> DataFrame:
    """Target share of each value of one part."""
    sums = cells.groupBy(part).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("power"))
    total = sums.agg(F.sum("power")).first()[0]
    return sums.select(part, (F.col("power") / F.lit(total or 1.0)).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, max_broadcast: int = MAX_BROADCAST_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) and weight, the fitted share of each cell. targets: for any part, (part, share)."""
    now, values = cells.withColumn("weight", F.col("tokens").cast("double")), cells.agg(*(F.count_distinct(F.struct(part)).alias(part) for part in PARTS)).first()
    sized = lambda part, df: F.broadcast(df) if values[part] <= max_broadcast else df
    for part in PARTS:
        want = (targets or {}).get(part)
        want = (tempered(cells, part, temper) if want is None else want).select(F.col(part).alias("__value"), F.col("share").alias(f"__{part}"))
        now = now.join(sized(part, want), F.col(part).eqNullSafe(F.col("__value")), "left").drop("__value").fillna(0.0, [f"__{part}"])
    now = written(now)
    for _ in range(rounds):
        for part in PARTS:
            have = now.groupBy(F.col(part).alias("__value")).agg(F.sum("weight").alias("__have"))
            met = F.when(F.col("__have") > 0, F.col("weight") * F.col(f"__{part}") / F.nullif("__have", F.lit(0.0))).otherwise(0.0)
            now = written(now.join(sized(part, have), F.col(part).eqNullSafe(F.col("__value"))).withColumn("weight", met).drop("__value", "__have"))
    return now.drop(*(f"__{part}" for part in PARTS))


def calibrated(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with p, the sampling probability."""
    wanted = cells.agg(F.sum("tokens")).first()[0] or 0
    budget, c = wanted * keep, 0.0
    for _ in range(STEPS):
        full = (F.col("weight") * F.lit(c) >= F.col("tokens")) & (F.col("weight") > 0)
        sums = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if not sums["rest"] or sums["rest"] <= 0:
            break
        new = max(c, (budget - sums["full"]) / sums["rest"])
        if new == c:
            break
        c = new
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(c) * F.col("weight") / F.col("tokens")))


def mixed(df: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, keep: float = KEEP, max_broadcast_cells: int = MAX_BROADCAST_CELLS) -> DataFrame:
    """df with __topic, __tokens, __weight (its cell's share), __p and __kept, for columns doc_id, text, lang and source."""
    topic = topic_of(F.col("text")) if topic is None else topic
    made = ("__topic", "__tokens", "__weight", "__p", "__kept")
    rows = df.withColumns({"__topic": topic, "__tokens": tokens_of(F.col("text"))}).drop(*made[2:])
    parts = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": F.col("__topic").cast("string")}
    cells = durable(rows.groupBy(*(c.alias(part) for part, c in parts.items())).agg(F.sum("__tokens").alias("tokens")))
    done = durable(calibrated(raked(cells, targets, rounds, temper, max_broadcast_cells), keep))
    own = {part: fresh(rows, f"__cell_{part}") for part in PARTS}
    rates = done.select(*(F.col(part).alias(own[part]) for part in PARTS), F.col("weight").alias("__weight"), F.col("p").alias("__p"))
    if done.count() <= max_broadcast_cells:
        rates = F.broadcast(rates)
    same = parts["source"].eqNullSafe(F.col(own["source"])) & parts["lang"].eqNullSafe(F.col(own["lang"])) & parts["topic"].eqNullSafe(F.col(own["topic"]))
    return rows.join(rates, same).drop(*own.values()).withColumn("__kept", draw_of(F.col("doc_id")) < F.col("__p"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its cell's fitted weight and probability, and whether it is sampled."""
    found = mixed(documents(spark, sf_dir))
    return found.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__weight", 9).alias("weight"), F.round("__p", 6).alias("probability"), F.col("__kept").cast("int").alias("sampled"))


def oracle_parts(rounds: int = ROUNDS, temper: float = TEMPER, keep: float = KEEP, table: str = "documents") -> str:
    """DuckDB: common table expressions that end in `cell_p` (source, lang, topic, tokens, weight, p) over `rows_`."""
    case = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    ctes = [
        f"rows_ AS (SELECT *, CASE {case} ELSE '{REST}' END AS topic_, greatest(1, coalesce(octet_length(encode(text)), 0) // 4)::BIGINT AS tokens_ FROM {table})",
        "cells_ AS MATERIALIZED (SELECT source, lang, topic_ AS topic, sum(tokens_)::BIGINT AS tokens FROM rows_ GROUP BY ALL)",
    ]
    for part in PARTS:
        ctes.append(f"want_{part} AS MATERIALIZED (SELECT {part} AS v, pow(sum(tokens)::DOUBLE, {temper}::DOUBLE) / sum(pow(sum(tokens)::DOUBLE, {temper}::DOUBLE)) OVER () AS share FROM cells_ GROUP BY {part})")
    ctes.append("fit_0 AS MATERIALIZED (SELECT c.*, tokens::DOUBLE AS weight, a.share AS t_source, b.share AS t_lang, d.share AS t_topic FROM cells_ c JOIN want_source a ON c.source IS NOT DISTINCT FROM a.v JOIN want_lang b ON c.lang IS NOT DISTINCT FROM b.v JOIN want_topic d ON c.topic IS NOT DISTINCT FROM d.v)")
    n = 0
    for _ in range(rounds):
        for part in PARTS:
            n += 1
            ctes.append(f"fit_{n} AS MATERIALIZED (SELECT * REPLACE (weight * t_{part} / sum(weight) OVER (PARTITION BY {part}) AS weight) FROM fit_{n - 1})")
    ctes.append("c_0 AS (SELECT 0.0::DOUBLE AS c)")
    for k in range(1, STEPS + 1):
        full = f"weight * (SELECT c FROM c_{k - 1}) >= tokens"
        ctes.append(f"c_{k} AS MATERIALIZED (SELECT greatest((SELECT c FROM c_{k - 1}), coalesce((sum(tokens) * {keep}::DOUBLE - coalesce(sum(tokens) FILTER (WHERE {full}), 0)) / nullif(coalesce(sum(weight) FILTER (WHERE NOT ({full})), 0), 0), 0)) AS c FROM fit_{n})")
    ctes.append(f"cell_p AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, least(1.0, (SELECT c FROM c_{STEPS}) * weight / tokens) AS p FROM fit_{n})")
    return ",\n".join(ctes)


DRAW_SQL = "(('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
ORACLE = f"""WITH {oracle_parts()}
SELECT r.doc_id, r.topic_ AS topic, r.tokens_ AS tokens, round(p.weight, 9) AS weight, round(p.p, 6) AS probability, ({DRAW_SQL} < p.p)::INTEGER AS sampled
FROM rows_ r JOIN cell_p p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic_ = p.topic"""
