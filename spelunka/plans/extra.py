"""Further queries: context assembly, provenance, barrels, links, soft metrics, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spelunka.functions import text as X
from spelunka.operators import graph as G
from spelunka.operators import history as H
from spelunka.operators import hygiene as Y
from spelunka.operators import packing as P
from spelunka.operators import refactor as R
from spelunka.operators import search as S
from spelunka.operators import telemetry as T
from spelunka.plans.base import LINES_SQL, SYMBOLS_SQL, lines, query, symbols, table
from spelunka.plans.search import SCORES, doc_scores


@query("ranked_context", f"WITH {SCORES}, pr AS (SELECT source, count(*) AS n FROM documents GROUP BY source), c AS (SELECT r.id, d.source, 0.5 * r.score / (SELECT max(score) FROM ranked) + 0.5 * n::DOUBLE / (SELECT max(n) FROM pr) AS score FROM ranked r JOIN documents d ON d.doc_id = r.id JOIN pr USING (source)) SELECT id, source, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM c) WHERE k <= 3")
def ranked_context(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    size = d.groupBy("source").agg(F.count("*").alias("n"))
    lex = doc_scores(spark, sf)
    best = lex.agg(F.max("score").alias("best"))
    most = size.agg(F.max("n").alias("most"))
    c = lex.join(d, "id").join(size, "source").join(F.broadcast(best)).join(F.broadcast(most))
    c = c.select("id", "source", (0.5 * F.col("score") / F.col("best") + 0.5 * F.col("n") / F.col("most")).alias("score"))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id"))
    return c.withColumn("k", k).where("k <= 3").select("id", "source", F.round("score", 6).alias("score"))


@query("context_bundle", f"WITH RECURSIVE {SYMBOLS_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY size, id) AS k FROM (SELECT id, byte_length // 4 AS size FROM symbols WHERE file = 'Brand#7')), w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS size, 0::BIGINT AS used, false AS taken UNION ALL SELECT c.k, c.id, c.size, CASE WHEN used + c.size <= 1500 THEN used + c.size ELSE used END, used + c.size <= 1500 FROM w JOIN c ON c.k = w.k + 1) SELECT id, size FROM w WHERE taken")
def context_bundle(spark, sf):
    s = symbols(spark, sf).where("file = 'Brand#7'").select("id", F.floor(F.col("byte_length") / 4).alias("size"))
    return P.greedy_skip(s, 1500, P.bundle_order("compact"), "size", "id")


@query("detail_projection", f"WITH {SYMBOLS_SQL} SELECT id, name, kind, file, line, byte_length, signature, end_line FROM symbols WHERE kind = 'PROMO'")
def detail_projection(spark, sf):
    return symbols(spark, sf).where("kind = 'PROMO'").select("id", "name", "kind", "file", "line", "byte_length", "signature", "end_line")


@query("symbol_provenance", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n)::BIGINT AS commits, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM c GROUP BY user_id) SELECT t.*, (SELECT event_type FROM c WHERE c.user_id = t.user_id ORDER BY n DESC, event_type LIMIT 1) AS dominant FROM t")
def symbol_provenance(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return c.groupBy("user_id").agg(F.sum("n").alias("commits"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("dominant"))


@query("barrel_exports", "SELECT DISTINCT unnest(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM pages WHERE contains(url, '.org/')")
def barrel_exports(spark, sf):
    p = table(spark, sf, "pages")
    org = p.where("contains(url, '.org/')").select(F.col("url").alias("file"))
    return Y.barrel_names(p.select(F.col("url").alias("file"), F.col("html").alias("content")), org)


LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"


@query("page_links", f"WITH {LINKS} SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM links GROUP BY target")
def page_links(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("co_linked_targets", f"WITH {LINKS}, d AS (SELECT DISTINCT * FROM links) SELECT x.target AS a, y.target AS b, count(*) AS n FROM d x JOIN d y ON x.page_id = y.page_id AND x.target < y.target GROUP BY ALL")
def co_linked_targets(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return G.group_pairs(links, "page_id", "target")


@query("test_file_flags", "SELECT page_id, regexp_matches(url, '/tests/|/test/|/__tests__/|(^|/)test_[^/]*$|_test\\.py$|(^|/)conftest\\.py$|\\.(spec|test)\\.[^./]*$') AS is_test FROM pages")
def test_file_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.is_test(F.col("url")).alias("is_test"))


@query("soft_precision", """WITH p AS (SELECT user_id AS query, event_type || '.' || (event_id % 5) AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), top AS (SELECT * FROM p WHERE rank <= 5), rel AS (SELECT user_id AS query, event_type || '.x' AS id FROM events WHERE value > 60 GROUP BY ALL),
m AS (SELECT DISTINCT t.query, t.id AS p, r.id AS r FROM top t JOIN rel r ON t.query = r.query AND string_split(t.id, '.')[1] = string_split(r.id, '.')[1]), f AS (SELECT query, count(DISTINCT p) AS good, count(DISTINCT r) AS got FROM m GROUP BY query), n AS (SELECT query, count(*) AS n FROM top GROUP BY query), k AS (SELECT query, count(DISTINCT id) AS k FROM rel GROUP BY query)
SELECT query, round(coalesce(good, 0)::DOUBLE / least(n, 5), 6) AS precision, round(CASE WHEN k IS NULL THEN 1.0 ELSE coalesce(got, 0)::DOUBLE / k END, 6) AS recall FROM n LEFT JOIN f USING (query) LEFT JOIN k USING (query)""")
def soft_precision(spark, sf):
    e = table(spark, sf, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    p = e.select(F.col("user_id").alias("query"), F.concat("event_type", F.lit("."), (F.col("event_id") % 5).cast("string")).alias("id"), rank.alias("rank"))
    rel = e.where("value > 60").select(F.col("user_id").alias("query"), F.concat("event_type", F.lit(".x")).alias("id")).distinct()
    return T.soft_precision(p, rel).select("query", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("longest_prefix", "WITH n AS (SELECT DISTINCT upper(p_type) || '\\' || replace(p_name, ' ', '\\') AS name FROM part), px AS (SELECT DISTINCT upper(p_type) || '\\' AS prefix, lower(p_type) AS directory FROM part UNION SELECT DISTINCT upper(p_type) || '\\red\\', lower(p_type) || '/r' FROM part) SELECT name, prefix, directory FROM (SELECT n.name, px.prefix, px.directory, row_number() OVER (PARTITION BY n.name ORDER BY length(prefix) DESC) AS k FROM n JOIN px ON starts_with(n.name, px.prefix)) WHERE k = 1")
def longest_prefix(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.concat(F.upper("p_type"), F.lit("\\"), F.translate("p_name", " ", "\\")).alias("name")).distinct()
    plain = p.select(F.concat(F.upper("p_type"), F.lit("\\")).alias("prefix"), F.lower("p_type").alias("directory")).distinct()
    red = p.select(F.concat(F.upper("p_type"), F.lit("\\red\\")).alias("prefix"), F.concat(F.lower("p_type"), F.lit("/r")).alias("directory")).distinct()
    return H.longest_prefix(names, plain.unionByName(red))


@query("metric_means", "SELECT event_type, round(avg(value), 4) AS value, round(avg((props->>'k')::BIGINT), 4) AS k FROM events GROUP BY event_type")
def metric_means(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("long")), 4).alias("k"))


@query("hourly_windows", "SELECT event_type AS tool, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    out = table(spark, sf, "events").groupBy(w.alias("w"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    return out.select("tool", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("signature_counts", f"WITH {SYMBOLS_SQL} SELECT id, (cyclomatic % 6)::INTEGER AS params, CASE WHEN cyclomatic % 6 = 0 THEN 0 ELSE 1 + cyclomatic % 5 END::INTEGER AS nesting FROM symbols")
def signature_counts(spark, sf):
    """Signatures of 0 to 5 parameters, whose types nest up to five brackets deep with commas inside."""
    nested = F.concat(F.repeat(F.lit("map["), (1 + F.col("cyclomatic") % 5).cast("int")), F.lit("a, b"), F.repeat(F.lit("]"), (1 + F.col("cyclomatic") % 5).cast("int")))
    several = F.array_join(F.array_repeat(F.concat(F.lit("x: "), nested), (F.col("cyclomatic") % 6).cast("int")), ", ")
    s = symbols(spark, sf).withColumn("signature", F.concat(F.lit("def f("), several, F.lit(")")))
    return s.select("id", X.param_count(F.col("signature")).cast("int").alias("params"), X.nesting(F.col("signature")).alias("nesting"))


@query("line_totals", f"WITH {LINES_SQL} SELECT file, count(*) AS n_lines, count(DISTINCT text) AS distinct_lines FROM lines GROUP BY file")
def line_totals(spark, sf):
    return lines(spark, sf).groupBy("file").agg(F.count("*").alias("n_lines"), F.countDistinct("text").alias("distinct_lines"))


@query("batch_importers", "WITH keys AS (SELECT DISTINCT p_brand AS file FROM part WHERE p_size = 50), imp AS (SELECT DISTINCT p_type AS importer, p_brand AS file FROM part WHERE p_size > 45) SELECT k.file, i.importer FROM keys k LEFT JOIN imp i USING (file)")
def batch_importers(spark, sf):
    p = table(spark, sf, "part")
    keys = p.where("p_size = 50").select(F.col("p_brand").alias("file")).distinct()
    imports = p.where("p_size > 45").select(F.col("p_type").alias("importer"), F.col("p_brand").alias("file")).distinct()
    return keys.join(imports, "file", "left")


@query("hybrid_semantic_only", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3), s AS (SELECT label, list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v))) AS score FROM embeddings e, q) SELECT label, count(*) AS n, round(max(score), 6) AS best FROM s WHERE score > 0 GROUP BY label")
def hybrid_semantic_only(spark, sf):
    e = table(spark, sf, "embeddings")
    found = S.against(e, e.where("vec_id = 3"), "embedding").where("score > 0")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("rename_plan", f"WITH {LINES_SQL} SELECT doc_id, line, CASE WHEN regexp_matches(text, '^\\s*(import|from|use|using|include|export)\\b|require\\(|#\\s*include') THEN 'import' WHEN regexp_matches(text, '\\b(def|class|function|func|fn|struct|interface|type|enum|trait|const|let|var)\\s+License\\b') THEN 'definition' ELSE 'usage' END AS kind, md5(regexp_replace(text, '\\bLicense\\b', 'Licence', 'g')) AS after FROM lines WHERE regexp_matches(text, '\\bLicense\\b')")
def rename_plan(spark, sf):
    rows = lines(spark, sf).withColumn("file", F.col("doc_id"))
    plan = R.rename_plan(rows, rows, "License", "Licence")
    return plan.select(F.col("file").alias("doc_id"), "line", "kind", F.md5(F.col("after").cast("binary")).alias("after"))


@query("call_site_plan", "SELECT p_brand AS file, p_partkey AS line, unnest(['a(b(' || p_name || ')), ' || p_size, '[1, (2)]']) AS arguments FROM part")
def call_site_plan(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("x = print(a(b("), "p_name", F.lit(")), "), F.col("p_size").cast("string"), F.lit(") + print([1, (2)])"))
    rows = p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), text.alias("text"))
    return R.call_sites(rows, rows, "print")
