"""Registry of the core queries, and the test tables seen as a code index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under name, with its DuckDB twin."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- projections: each in DataFrame form and as a DuckDB common table expression -----------------------------------------

#: Short-named symbols: parts.
SYMBOLS_SQL = """symbols AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS kind, p_size AS cyclomatic,
 lower(p_type) || ' ' || p_name || '(' || p_brand || ')' AS signature, p_partkey % 97 AS line, (p_partkey % 97 + p_size)::BIGINT AS end_line, (p_size * 10)::BIGINT AS byte_length FROM part)"""


def symbols(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("kind"), F.col("p_size").alias("cyclomatic"),
        F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.lit("("), "p_brand", F.lit(")")).alias("signature"),
        (F.col("p_partkey") % 97).alias("line"), (F.col("p_partkey") % 97 + F.col("p_size")).alias("end_line"), (F.col("p_size") * 10).cast("long").alias("byte_length"),
    )


#: A directed file graph: the three strongest trade partners of each nation.
EDGES_SQL = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM trade) WHERE k <= 3)"""


def trade(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    sellers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    # Orders take their buyer's nation first: sums by (nation, supplier) are few, those by (customer, supplier) as many as line items.
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    pairs = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "l_suppkey").count()
    both = pairs.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.sum("count").alias("n"))


def edges(spark, sf):
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return trade(spark, sf).withColumn("k", rank).where("k <= 3").select("src", "dst", "n")


#: Calls between conversation turns as (caller, callee) symbols.
LINES_SQL = "lines AS (SELECT doc_id, source AS file, i AS line, t[i] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents) s, unnest(range(1, len(t) + 1)) u(i))"


def lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select("doc_id", "file", (F.col("pos") + 1).cast("long").alias("line"), "text")


#: Telemetry: one row a call.
CALLS_SQL = "calls AS (SELECT event_id, ts, event_type AS tool, user_id, value AS duration_ms, event_type <> 'error' AS ok FROM events)"


def calls(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("tool"), "user_id", F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"))
