"""Search queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spelunka.functions import text as X
from spelunka.operators import graph as G
from spelunka.operators import search as S
from spelunka.plans.base import LINES_SQL, SYMBOLS_SQL, lines, query, symbols, table

QUERY = "apache license version for the und le"
TOKENS = "(SELECT {id} AS id, {field} AS w, lower(x) AS term, i AS pos FROM (SELECT {key} AS {id}, regexp_extract_all(regexp_replace({text}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{{2,}}') AS t FROM {table}) s, unnest(t) WITH ORDINALITY u(x, i))"
DOC_TOKENS = "tokens AS (SELECT doc_id AS id, lower(unnest(regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{2,}'))) AS term FROM documents)"
POSTINGS = DOC_TOKENS + ",\npostings AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY ALL),\nlengths AS (SELECT id, count(*) AS dl FROM postings GROUP BY id),\nstats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)"


def _terms(text):
    return "(" + ", ".join(f"'{t}'" for t in dict.fromkeys(X.tokens_of(text))) + ")"


SCORES = (
    POSTINGS
    + f""",
df AS (SELECT term, count(*) AS df FROM postings WHERE term IN {_terms(QUERY)} GROUP BY term),
scores AS (SELECT id, term, tf, ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) AS score
 FROM postings JOIN df USING (term) JOIN lengths USING (id), stats),
ranked AS (SELECT id, sum(score) AS score FROM scores GROUP BY id)"""
)


def doc_postings(spark, sf):
    return S.postings(table(spark, sf, "documents"), "doc_id", {"text": 1})


def doc_scores(spark, sf):
    return S.bm25_rows(table(spark, sf, "documents"), "doc_id", {"text": 1}, QUERY)


@query("bm25_topk", f"WITH {SCORES} SELECT id AS doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, id LIMIT 10")
def bm25_topk(spark, sf):
    return S.top(doc_scores(spark, sf), 10, F.desc("score"), "id").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("bm25_idf", f"WITH {POSTINGS} SELECT term, count(*) AS df, round(ln(((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5) + 1.0), 6) AS idf FROM postings GROUP BY term HAVING count(*) >= 5")
def bm25_idf(spark, sf):
    return S.idf(doc_postings(spark, sf)).where("df >= 5").select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings_df", f"WITH {POSTINGS} SELECT df, count(*) AS terms, sum(tf)::BIGINT AS occurrences FROM (SELECT term, count(*) AS df, sum(tf) AS tf FROM postings GROUP BY term) GROUP BY df")
def postings_df(spark, sf):
    per = doc_postings(spark, sf).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return per.groupBy("df").agg(F.count("*").alias("terms"), F.sum("tf").alias("occurrences"))


@query("term_breakdown", f"WITH {SCORES} SELECT id AS doc_id, term, tf::BIGINT AS tf, round(score, 6) AS score FROM scores WHERE id IN (SELECT id FROM ranked ORDER BY score DESC, id LIMIT 10)")
def term_breakdown(spark, sf):
    terms = list(dict.fromkeys(X.tokens_of(QUERY)))
    best = S.top(S.bag_scores(G.kept(S.bags(table(spark, sf, "documents"), "doc_id", {"text": 1}, terms)), terms), 10, F.desc("score"), "id")
    each = best.select(F.col("id").alias("doc_id"), F.explode(F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("tfs").alias("tf"), F.col("scores").alias("s"))).alias("x"))
    return each.select("doc_id", "x.term", F.col("x.tf").cast("long").alias("tf"), F.round("x.s", 6).alias("score")).where("tf > 0")


CONV_TOKENS = "raw0 AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{2,}') AS t FROM conversations)"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in X.abbreviation_pairs())
EXPANDED = f"""{CONV_TOKENS}, toks AS (SELECT id, lower(t[i]) AS term, i AS pos FROM raw0, unnest(range(1, len(t) + 1)) u(i)),
raw AS (SELECT id, term, count(*) AS tf, min(pos) AS pos FROM toks GROUP BY ALL), st AS (SELECT *, {X.stem_sql("term")} AS stem FROM raw),
abbr(term, form) AS (VALUES {_PAIRS}),
derived AS (SELECT id, pos, stem AS form FROM st WHERE stem <> term UNION ALL SELECT id, pos, form FROM st JOIN abbr USING (term) UNION ALL SELECT id, pos, form FROM st JOIN abbr ON st.stem = abbr.term WHERE stem <> st.term),
first AS (SELECT id, form AS term, min(pos) AS f FROM derived GROUP BY ALL),
expanded AS (SELECT coalesce(r.id, f.id) AS id, coalesce(r.term, f.term) AS term, coalesce(r.tf, 0) + CASE WHEN f IS NOT NULL AND (r.pos IS NULL OR f < r.pos) THEN 1 ELSE 0 END AS tf FROM raw r FULL JOIN first f ON r.id = f.id AND r.term = f.term)"""


@query("expanded_terms", f"WITH {EXPANDED} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM expanded WHERE tf > 0 GROUP BY term")
def expanded_terms(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return S.postings(turns, "key", {"text": 1}, expand=True).where("tf > 0").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("identity_rank", f"WITH {SYMBOLS_SQL} SELECT id, name, score FROM (SELECT id, name, CASE WHEN name = 'red plate' OR id::VARCHAR = 'red plate' THEN 50.0::DOUBLE WHEN starts_with(name, 'red plate') THEN 30.0 WHEN contains(id::VARCHAR, 'red plate') THEN 20.0 ELSE 0.0 END AS score FROM symbols) WHERE score > 0")
def identity_rank(spark, sf):
    s = symbols(spark, sf)
    return s.select("id", "name", S.identity(F.col("name"), F.col("id"), "red plate").alias("score")).where("score > 0")


@query("identity_prefix", f"WITH {SYMBOLS_SQL} SELECT name, score, count(*) AS n FROM (SELECT name, CASE WHEN name = 'red' OR file_id = 'red' THEN 50.0::DOUBLE WHEN starts_with(name, 'red') THEN 30.0 WHEN contains(file_id, 'red') THEN 20.0 ELSE 0.0 END AS score FROM (SELECT *, lower(file || '::' || name) AS file_id FROM symbols)) WHERE score > 0 GROUP BY ALL")
def identity_prefix(spark, sf):
    s = symbols(spark, sf).withColumn("file_id", F.concat("file", F.lit("::"), "name"))
    return s.select("name", S.identity(F.col("name"), F.col("file_id"), "Red").alias("score")).where("score > 0").groupBy("name", "score").agg(F.count("*").alias("n"))


_W = lambda c, w: " + ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN {w} ELSE 0 END" for t in ("hot", "ring"))


@query("legacy_weighted_search", f"WITH {SYMBOLS_SQL} SELECT id, score FROM (SELECT id, (CASE WHEN lower(name) = 'hot ring' THEN 20 WHEN contains(lower(name), 'hot ring') THEN 10 ELSE 0 END + {_W('name', 5)} + CASE WHEN contains(lower(signature), 'hot ring') THEN 8 ELSE 0 END + {_W('signature', 2)})::INTEGER AS score FROM symbols) WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def legacy_weighted_search(spark, sf):
    s = symbols(spark, sf)
    return S.top(s.select("id", S.legacy_score(s, "hot ring").alias("score")).where("score > 0"), 50, F.desc("score"), "id")


TRI = "CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) END"
FUZZY = f"""{SYMBOLS_SQL}, g AS (SELECT id, name, {TRI.format(c="lower(name)")} AS g, list_distinct(list_transform(range(1, 9), lambda i: substr('red widgit', i, 3))) AS q FROM symbols),
m AS (SELECT id, name, len(list_intersect(g, q))::DOUBLE / len(list_distinct(list_concat(g, q))) AS jaccard, levenshtein(lower(name), 'red widgit')::INTEGER AS edits FROM g)"""


@query("fuzzy_search", f"WITH {FUZZY} SELECT id, name, round(jaccard, 6) AS jaccard, edits FROM m WHERE jaccard >= 0.4 OR edits <= 2 ORDER BY edits, m.jaccard DESC, id LIMIT 60")
def fuzzy_search(spark, sf):
    found = S.fuzzy(symbols(spark, sf), "red widgit")
    return S.top(found, 60, "edits", F.desc("jaccard"), "id").select("id", "name", F.round("jaccard", 6).alias("jaccard"), "edits")


@query("fuzzy_name_pairs", f"WITH {SYMBOLS_SQL}, n AS (SELECT DISTINCT lower(name) AS x, {TRI.format(c='lower(name)')} AS g FROM symbols), p AS (SELECT a.x AS a, b.x AS b, len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS jaccard, levenshtein(a.x, b.x)::INTEGER AS edits FROM n a, n b WHERE a.x < b.x) SELECT a, b, round(jaccard, 6) AS jaccard, edits FROM p WHERE jaccard >= 0.4 OR edits <= 2")
def fuzzy_name_pairs(spark, sf):
    s = symbols(spark, sf)
    return S.fuzzy_pairs(s, s).where("a < b").select("a", "b", F.round("jaccard", 6).alias("jaccard"), "edits")


@query("text_search_lines", f"WITH {LINES_SQL} SELECT doc_id, line, substr(text, 1, 200) AS text FROM lines WHERE contains(lower(text), 'license')")
def text_search_lines(spark, sf):
    return S.search_lines(lines(spark, sf), "License").select("doc_id", "line", "text")


@query("regex_search", f"WITH {LINES_SQL} SELECT doc_id, line, substr(text, 1, 200) AS text FROM lines WHERE regexp_matches(text, '(?i)licensed?\\s+under|[0-9]{{4}}')")
def regex_search(spark, sf):
    return S.search_lines(lines(spark, sf), r"licensed?\s+under|[0-9]{4}", regex=True).select("doc_id", "line", "text")


@query("text_search_context", f"WITH {LINES_SQL}, w AS (SELECT *, coalesce(string_agg(text, chr(10) ORDER BY line) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(text, chr(10) ORDER BY line) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM lines) SELECT doc_id, line, md5(before) AS before, md5(after) AS after FROM w WHERE contains(lower(text), 'license')")
def text_search_context(spark, sf):
    return S.with_context(lines(spark, sf), "license", 2).select("doc_id", "line", F.md5(F.col("before").cast("binary")).alias("before"), F.md5(F.col("after").cast("binary")).alias("after"))


@query("column_search", """WITH c AS (SELECT DISTINCT p_type AS source, p_brand AS model, p_name AS "column", p_type || ' ' || p_size AS description FROM part), s AS (SELECT *, (CASE WHEN lower("column") = 'red ring' THEN 30 WHEN contains(lower("column"), 'red ring') THEN 15 ELSE CASE WHEN contains(lower("column"), 'red') THEN 5 ELSE 0 END + CASE WHEN contains(lower("column"), 'ring') THEN 5 ELSE 0 END END + CASE WHEN contains(lower(description), 'red ring') THEN 8 ELSE CASE WHEN contains(lower(description), 'red') THEN 2 ELSE 0 END + CASE WHEN contains(lower(description), 'ring') THEN 2 ELSE 0 END END)::INTEGER AS score FROM c) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, model, "column", source, description LIMIT 40""")
def column_search(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_type").alias("source"), F.col("p_brand").alias("model"), F.col("p_name").alias("column"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("description")).distinct()
    found = c.withColumn("score", S.column_score(F.col("column"), F.col("description"), "red ring")).where("score > 0")
    return S.top(found, 40, F.desc("score"), "model", "column", "source", "description")


@query("winnow_filter_chain", f"WITH {SYMBOLS_SQL} SELECT id, name, kind, cyclomatic FROM symbols WHERE kind IN ('PROMO', 'LARGE') AND cyclomatic >= 10 AND regexp_matches(name, '^(red|blue)') AND regexp_matches(file, '^Brand#1.$') ORDER BY cyclomatic DESC, id LIMIT 25")
def winnow_filter_chain(spark, sf):
    rules = [("kind", "in", ["PROMO", "LARGE"]), ("complexity", ">=", 10), ("name", "matches", "^(red|blue)"), ("file", "matches", "Brand#1?")]
    return S.winnow(symbols(spark, sf), rules, "complexity", "desc", 25).select("id", "name", "kind", "cyclomatic")


@query("glob_filter", "SELECT page_id, regexp_matches(url, '^https://.*[.]org/.*$') AS whole, regexp_matches(url, '^(.*/)?en/.*$') AS suffix, regexp_matches(url, '^[0-9].*[?].*$') OR regexp_matches(regexp_extract(url, '[^/]*$'), '^[0-9].*[?].*$') AS name FROM pages")
def glob_filter(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.glob(u, "https://*.org/*").alias("whole"), X.glob(u, "en/*", "suffix").alias("suffix"), X.glob(u, "[0-9]*[?]*", "name").alias("name"))


COS = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
COSINES = f"q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), sem AS (SELECT vec_id AS id, {COS} AS score FROM embeddings e, q)"


def cosines(spark, sf):
    e = table(spark, sf, "embeddings")
    return S.against(e, e.where("vec_id = 7"), "embedding").select(F.col("vec_id").alias("id"), "score")


@query("cosine_topk", f"WITH {COSINES} SELECT id, round(score, 6) AS score FROM sem ORDER BY sem.score DESC, id LIMIT 20")
def cosine_topk(spark, sf):
    return S.top(cosines(spark, sf), 20, F.desc("score"), "id").select("id", F.round("score", 6).alias("score"))


@query("hybrid_rank", f"WITH {SCORES}, {COSINES}, l AS (SELECT id, score / (SELECT max(score) FROM ranked) AS l FROM ranked), h AS (SELECT coalesce(l.id, s.id) AS id, 0.6 * coalesce(l, 0) + 0.4 * coalesce(s.score, 0) AS score FROM l FULL JOIN sem s ON l.id = s.id) SELECT id, round(score, 6) AS score FROM h WHERE score > 0 ORDER BY h.score DESC, id LIMIT 20")
def hybrid_rank(spark, sf):
    found = S.hybrid(doc_scores(spark, sf), cosines(spark, sf), 0.4)
    return S.top(found, 20, F.desc("score"), "id").select("id", F.round("score", 6).alias("score"))


FUSED = f"""{SCORES}, {COSINES}, chan AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS c FROM ranked
 UNION ALL SELECT id, 0.8 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM sem WHERE score >= 0.1
 UNION ALL SELECT doc_id, 0.4 / (60 + row_number() OVER (ORDER BY n_chars DESC, doc_id)) FROM documents),
fused AS (SELECT id, sum(c) AS score FROM chan GROUP BY id)"""


@query("wrr_fusion", f"WITH {FUSED} SELECT id, round(score, 8) AS score FROM fused ORDER BY fused.score DESC, id LIMIT 25")
def wrr_fusion(spark, sf):
    size = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    fused = S.fuse({"lexical": doc_scores(spark, sf), "similarity": cosines(spark, sf).where("score >= 0.1"), "structural": size})
    return S.top(fused, 25, F.desc("score"), "id").select("id", F.round("score", 8).alias("score"))


@query("confidence_score", """WITH r AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS k FROM events), t AS (SELECT event_type, user_id, max(value) FILTER (WHERE k = 1) AS a, max(value) FILTER (WHERE k = 2) AS b FROM r WHERE k <= 2 GROUP BY ALL)
SELECT event_type, user_id, round(exp(0.35 * ln(greatest(1e-6, CASE WHEN a <= 0 THEN 0 ELSE least(1, greatest(0, (a - coalesce(b, 0)) / a)) END)) + 0.35 * ln(greatest(1e-6, least(1, greatest(0, 1 - exp(-a / 4))))) + 0.15 * ln(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.6 END) + 0.15 * ln(CASE WHEN event_type = 'error' THEN 0.6 ELSE 1.0 END)), 3) AS confidence FROM t""")
def confidence_score(spark, sf):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy(F.desc("value"), "event_id"))
    two = table(spark, sf, "events").withColumn("k", k).where("k <= 2").groupBy("event_type", "user_id").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("b"))
    return two.select("event_type", "user_id", S.confidence(F.col("a"), F.col("b"), F.col("event_type") == "view", F.col("event_type") == "error").alias("confidence"))


@query("negative_evidence", f"WITH {SYMBOLS_SQL} SELECT CASE WHEN best IS NULL THEN 'no_implementation_found' WHEN best < 0.5 THEN 'low_confidence_matches' ELSE 'found' END AS verdict, best, (SELECT coalesce(string_agg(file, ',' ORDER BY file), '') FROM (SELECT DISTINCT file FROM symbols WHERE contains(lower(file), 'brand') ORDER BY file LIMIT 5)) AS related_files FROM (SELECT max(cyclomatic / 1000.0::DOUBLE) AS best FROM symbols WHERE name = 'red plate')")
def negative_evidence(spark, sf):
    s = symbols(spark, sf)
    return S.negative_evidence(s.where("name = 'red plate'").select((F.col("cyclomatic") / 1000.0).alias("score")), s.select("file"), "brand plate")


@query("combined_search", f"WITH {SYMBOLS_SQL}, imp AS (SELECT file, count(*) AS c FROM symbols GROUP BY file), s AS (SELECT id, CASE WHEN contains(name, 'red') THEN 1 ELSE 0 END + CASE WHEN contains(name, 'bolt') THEN 2.5 ELSE 0 END AS lex, 0.3 * ln(1 + c) AS bonus FROM symbols JOIN imp USING (file)) SELECT id, round(lex + bonus, 6) AS score FROM s WHERE lex > 0 ORDER BY lex + bonus DESC, id LIMIT 30")
def combined_search(spark, sf):
    s = symbols(spark, sf)
    centrality = s.groupBy("file").agg(F.count("*").alias("c"))
    lex = F.when(F.col("name").contains("red"), 1.0).otherwise(0.0) + F.when(F.col("name").contains("bolt"), 2.5).otherwise(0.0)
    found = s.withColumn("lex", lex).where("lex > 0").join(centrality, "file").select("id", (F.col("lex") + S.CENTRALITY * F.log1p("c")).alias("score"))
    return S.top(found, 30, F.desc("score"), "id").select("id", F.round("score", 6).alias("score"))


@query("plan_turn", f"WITH {SCORES} SELECT CASE WHEN max(score) >= 2 AND count(*) >= 3 THEN 'high' WHEN max(score) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS hits, round(max(score), 6) AS best FROM ranked")
def plan_turn(spark, sf):
    found = doc_scores(spark, sf).agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    level = F.when((F.col("best") >= 2) & (F.col("hits") >= 3), "high").when(F.col("best") >= 0.5, "medium").otherwise("low")
    return found.select(level.alias("confidence"), "hits", F.round("best", 6).alias("best"))


@query("keyword_topk", f"WITH {DOC_TOKENS} SELECT term, count(*) AS n FROM tokens GROUP BY term ORDER BY n DESC, term LIMIT 15")
def keyword_topk(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(X.split_tokens(F.col("text"))).alias("term"))
    return S.top(t.groupBy("term").agg(F.count("*").alias("n")), 15, F.desc("n"), "term")


@query("suggest_queries", f"WITH {SYMBOLS_SQL} SELECT * FROM (SELECT 'kind' AS what, kind AS value, count(*) AS n FROM symbols GROUP BY kind UNION ALL (SELECT 'file', file, count(*) FROM symbols GROUP BY file ORDER BY count(*) DESC, file LIMIT 8) UNION ALL (SELECT 'keyword', w, count(*) FROM (SELECT unnest(string_split(name, ' ')) AS w FROM symbols) GROUP BY w ORDER BY count(*) DESC, w LIMIT 15))")
def suggest_queries(spark, sf):
    s = symbols(spark, sf)
    count = lambda d, c, what: d.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    words = s.select(F.explode(F.split("name", " ")).alias("w"))
    return count(s, "kind", "kind").unionByName(S.top(count(s, "file", "file"), 8, F.desc("n"), "value")).unionByName(S.top(count(words, "w", "keyword"), 15, F.desc("n"), "value"))
