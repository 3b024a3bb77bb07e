"""Queries over whole code projects: symbol search, reach, dead code, changes, encodings, imports and stored tables.

Where no table of the test data has what an operator reads, its input is built from one by a rule that the DuckDB twin
states by itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spelunka.functions import text as X
from spelunka.operators import graph as G
from spelunka.operators import history as H
from spelunka.operators import hygiene as Y
from spelunka.operators import project as J
from spelunka.operators import refactor as R
from spelunka.operators import search as S
from spelunka.plans.base import EDGES_SQL, SYMBOLS_SQL, edges, query, symbols, table
from spelunka.plans.quality import FILES, file_edges, nation_files
from spelunka.sources import imports as I
from spelunka.sources import parser as A
from spelunka.sources import store as D
from spelunka.streaming import watch as W

# -- symbol search --------------------------------------------------------------------------------------------------------

_TERMS = ("red", "plate", "promo")
_BAG = "regexp_extract_all(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{{2,}}')"
SEARCHED = f"""{SYMBOLS_SQL}, f AS (SELECT *, list_transform({_BAG.format(c="name")}, lambda x: lower(x)) AS tn, list_transform({_BAG.format(c="signature")}, lambda x: lower(x)) AS ts FROM symbols WHERE regexp_matches(file, '^Brand#1.?$')),
b AS (SELECT *, len(list_distinct(list_concat(tn, ts))) AS dl, {", ".join(f"3 * len(list_filter(tn, lambda x: x = '{t}')) + 2 * len(list_filter(ts, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))} FROM f),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))} FROM b WHERE dl > 0),
sc AS (SELECT id, name, file, {" + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1.0) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))" for i in range(3))} AS lex FROM b, st),
cen AS (SELECT file, count(*) AS c FROM symbols GROUP BY file)"""


@query("search_symbols", f"WITH {SEARCHED} SELECT id, name, file, round(lex + 0.3 * ln(1 + c), 6) AS score FROM sc JOIN cen USING (file) WHERE lex > 0 ORDER BY lex + 0.3 * ln(1 + c) DESC, id LIMIT 20")
def search_symbols(spark, sf):
    s = symbols(spark, sf)
    found = S.search_symbols(s, "red plate promo", file_glob="Brand#1*", centrality=s.groupBy("file").agg(F.count("*").alias("n")))
    return found.select("id", "name", "file", F.round("score", 6).alias("score"))


@query("search_symbols_budget", f"WITH RECURSIVE {SYMBOLS_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY name, id) AS k FROM symbols WHERE kind = 'PROMO'), w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS id, '' AS name, '' AS file, 0::BIGINT AS used, false AS taken UNION ALL SELECT c.k, c.id, c.name, c.file, CASE WHEN used + byte_length <= 3000 THEN used + byte_length ELSE used END, used + byte_length <= 3000 FROM w JOIN c ON c.k = w.k + 1) SELECT id, name, file, 0.0::DOUBLE AS score FROM w WHERE taken")
def search_symbols_budget(spark, sf):
    """An empty query lists what the filters pass; the budget decides how many."""
    return S.search_symbols(symbols(spark, sf), "", kind="PROMO", sort_by="name", k=1000, budget=3000)


@query("search_symbols_fuzzy", f"WITH {SYMBOLS_SQL} SELECT DISTINCT name FROM symbols WHERE levenshtein(lower(name), 'rad plete') <= 2 OR len(list_intersect(list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3))), ['rad', 'ad ', 'd p', ' pl', 'ple', 'let', 'ete'])) / len(list_distinct(list_concat(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3)), ['rad', 'ad ', 'd p', ' pl', 'ple', 'let', 'ete'])))::DOUBLE >= 0.4")
def search_symbols_fuzzy(spark, sf):
    return S.search_symbols(symbols(spark, sf), "rad plete", k=100_000).select("name").distinct()


@query("global_ranks", f"WITH {SYMBOLS_SQL} SELECT id, row_number() OVER (ORDER BY cyclomatic DESC, id) AS rank FROM symbols")
def global_ranks(spark, sf):
    return S.ranked(symbols(spark, sf).select("id", "cyclomatic"), F.desc("cyclomatic"), "id").select("id", "rank")


# -- reach ----------------------------------------------------------------------------------------------------------------

CONTENTS = "contents AS (SELECT FILE_ AS file, 'import region' || chr(10) || 'use(' || r_name || ')' AS content FROM nation JOIN region ON n_regionkey = r_regionkey)".replace("FILE_", "CASE WHEN n_nationkey = 3 THEN 'main.py' WHEN n_nationkey % 7 = 0 THEN 'test_n' || n_nationkey || '.py' ELSE 'n' || n_nationkey || '.py' END")


def nation_contents(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    named = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").join(regions, "n_regionkey")
    return named.join(nation_files(spark, sf), "n_nationkey").select("file", F.concat(F.lit("import region\nuse("), "r_name", F.lit(")")).alias("content"))


_LEVELS = "lv AS (SELECT 'main.py' AS file, 0 AS depth UNION SELECT fe.src, lv.depth + 1 FROM lv JOIN fe ON fe.dst = lv.file WHERE lv.depth < 3)"


@query("blast_radius", f"WITH RECURSIVE {FILES}, {CONTENTS}, {_LEVELS} SELECT l.file, l.depth, CASE WHEN l.depth = 1 AND contains(c.content, 'ASIA') THEN 'confirmed' ELSE 'potential' END AS level, EXISTS (SELECT 1 FROM fe WHERE fe.dst = l.file AND starts_with(fe.src, 'test_') AND fe.src <> fe.dst) AS tested FROM (SELECT file, min(depth)::INTEGER AS depth FROM lv GROUP BY file) l JOIN contents c USING (file) WHERE l.file <> 'main.py'")
def blast_radius(spark, sf):
    changed = spark.createDataFrame([("main.py",)], "file string")
    return Y.blast_radius(file_edges(spark, sf), nation_contents(spark, sf), changed, "ASIA")


PART_SYMBOLS = f"{FILES}, ps AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 25 = 3 THEN 'main.py' WHEN p_partkey % 25 % 7 = 0 THEN 'test_n' || p_partkey % 25 || '.py' ELSE 'n' || p_partkey % 25 || '.py' END AS file, p_size FROM part)"


def part_symbols(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 25).alias("n_nationkey"), "p_size")
    decorators = F.when(F.col("p_size") % 10 == 0, F.array(F.lit("app.route('/x')"))).otherwise(F.array().cast("array<string>"))
    return p.join(nation_files(spark, sf).withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "n_nationkey").select("id", "name", "file", "p_size", decorators.alias("decorators"))


@query("dead_code", f"WITH RECURSIVE {PART_SYMBOLS}, reach AS (SELECT 'main.py' AS file UNION SELECT fe.dst FROM reach JOIN fe ON fe.src = reach.file), called AS (SELECT DISTINCT name FROM ps WHERE p_size > 44), ex AS (SELECT DISTINCT file, name FROM ps WHERE p_size < 8), s AS (SELECT id, file, name, ((file NOT IN (SELECT file FROM reach))::INT + (name NOT IN (SELECT name FROM called))::INT + (NOT EXISTS (SELECT 1 FROM ex WHERE ex.file = ps.file AND ex.name = ps.name))::INT) / 3.0 AS m, p_size FROM ps) SELECT id, file, name, round(CASE WHEN p_size % 10 = 0 THEN least(m, 0.5) ELSE m END, 4)::DOUBLE AS confidence FROM s WHERE round(CASE WHEN p_size % 10 = 0 THEN least(m, 0.5) ELSE m END, 4) >= 0.33")
def dead_code(spark, sf):
    s = part_symbols(spark, sf)
    roots = Y.live_roots(nation_files(spark, sf).select("file"), include_tests=False)
    return Y.dead_code(s, file_edges(spark, sf), s.where("p_size > 44").select("name"), s.where("p_size < 8").select("file", "name"), roots)


@query("barrel_hops", "SELECT * FROM (VALUES ('pkg/__init__.py', 'alpha'), ('pkg/__init__.py', 'from'), ('pkg/a/__init__.py', 'alpha'), ('pkg/a/__init__.py', 'from'), ('pkg/a/core.py', 'alpha'), ('pkg/a/core.py', 'from')) t(file, name)")
def barrel_hops(spark, sf):
    contents = spark.createDataFrame([("pkg/__init__.py", "from alpha"), ("pkg/a/__init__.py", ""), ("other.py", "beta")], "file string, content string")
    links = spark.createDataFrame([("pkg/__init__.py", "pkg/a/__init__.py"), ("pkg/a/__init__.py", "pkg/a/core.py"), ("other.py", "pkg/b.py")], "src string, dst string")
    return Y.barrel_exports(contents, links)


@query("orphan_share", f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT n_nationkey AS node, 0 AS d FROM nation WHERE n_nationkey IN (1, 2) UNION SELECT e.dst, d + 1 FROM r JOIN edges e ON e.src = r.node WHERE d < 2) SELECT 25::BIGINT AS symbols, 25 - count(DISTINCT node) AS orphans, round(100.0::DOUBLE * (25 - count(DISTINCT node)) / 25, 2) AS percent FROM r")
def orphan_share(spark, sf):
    gateways = table(spark, sf, "nation").where("n_nationkey in (1, 2)").select(F.col("n_nationkey").alias("node"))
    return Y.orphan_share(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), G.signal_chains(gateways, edges(spark, sf), 2))


@query("two_clique_plates", "SELECT * FROM (VALUES (1, 4::BIGINT, 1, 1.0::DOUBLE, 0.1::DOUBLE), (5, 4, 5, 1.0, 0.1)) t(label, size, anchor, cohesion, coupling)")
def two_clique_plates(spark, sf):
    """Two cliques of four, with one weak link: the ends of the link are inside their own plates, all weights inside are 1, so the least node is the anchor."""
    inside = [(a, b, 1.0) for k in (1, 5) for a in range(k, k + 4) for b in range(a + 1, k + 4)]
    pairs = spark.createDataFrame([*inside, (4, 5, 0.1)], "a int, b int, weight double")
    return G.plates(G.label_propagation(pairs), pairs).select("label", "size", "anchor", F.round("cohesion", 6).alias("cohesion"), F.round("coupling", 6).alias("coupling"))


@query("gateway_kinds", "SELECT p_partkey AS id, [NULL, 'http', 'cli', 'event', 'task', 'cli', 'test'][1 + p_partkey % 7] AS kind FROM part")
def gateway_kinds(spark, sf):
    decorated = F.array(*(F.lit(x) for x in ("pure", "app.route('/a')", "click.command()", "bus.listener", "celery.task", "", "")))
    named = F.array(*(F.lit(x) for x in ("def run()", "def a()", "def b()", "def c()", "def d()", "def main()", "def test_it()")))
    k = (1 + F.col("p_partkey") % 7).cast("int")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), Y.gateway_kind(F.element_at(named, k), F.array(F.element_at(decorated, k))).alias("kind"))


# -- changes and encodings ------------------------------------------------------------------------------------------------


@query("changed_symbols", f"WITH {SYMBOLS_SQL}, h AS (SELECT DISTINCT 'Brand#' || (s_nationkey + 1) AS file, s_suppkey % 150 AS lo, s_suppkey % 150 + greatest(s_suppkey % 7, 1) - 1 AS hi FROM supplier) SELECT id, s.file, name, sum(least(hi, end_line) - greatest(lo, line) + 1)::BIGINT AS lines FROM symbols s JOIN h ON s.file = h.file AND lo <= end_line AND hi >= line GROUP BY ALL")
def changed_symbols(spark, sf):
    hunks = table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("file"), (F.col("s_suppkey") % 150).alias("start"), (F.col("s_suppkey") % 7).alias("lines")).distinct()
    return H.changed_symbols(symbols(spark, sf), hunks)


@query("verified_source", "SELECT item_id AS id, substr(hex(encode(text)), 1, 8) AS source, item_id % 3 <> 0 AS intact FROM benchmark")
def verified_source(spark, sf):
    b = table(spark, sf, "benchmark")
    part = F.substring(F.col("text").cast("binary"), 1, 4)
    stored = F.when(F.col("item_id") % 3 == 0, "0").otherwise(F.sha2(part, 256))
    s = b.select(F.col("item_id").alias("id"), F.col("item_id").cast("string").alias("file"), F.lit(0).alias("byte_offset"), F.lit(4).alias("byte_length"), stored.alias("content_hash"))
    ascii_only = H.verified_source(s, b.select(F.col("item_id").cast("string").alias("path"), F.col("text").alias("content")))
    return ascii_only.join(b.select(F.col("item_id").alias("id"), F.hex(part).alias("h")), "id").select("id", F.col("h").alias("source"), "intact")


_ODD = "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN p_name || chr(9) || 'x' WHEN 2 THEN '@3' WHEN 3 THEN p_name || '\\t' WHEN 4 THEN '' WHEN 5 THEN 'a' || chr(10) || '\\\\N' WHEN 6 THEN '\\N' ELSE p_name END"


def odd_rows(spark, sf):
    p = table(spark, sf, "part")
    odd = (
        F.when(F.col("p_partkey") % 8 == 0, None).when(F.col("p_partkey") % 8 == 1, F.concat("p_name", F.lit("\tx"))).when(F.col("p_partkey") % 8 == 2, "@3").when(F.col("p_partkey") % 8 == 3, F.concat("p_name", F.lit("\\t")))
        .when(F.col("p_partkey") % 8 == 4, "").when(F.col("p_partkey") % 8 == 5, "a\n\\\\N").when(F.col("p_partkey") % 8 == 6, "\\N").otherwise(F.col("p_name"))
    )
    return p.select(F.col("p_partkey").alias("id"), odd.alias("name"), "p_brand", "p_size")


@query("compact_round_trip", f"SELECT p_partkey AS id, {_ODD} AS name, p_brand, p_size FROM part")
def compact_round_trip(spark, sf):
    """Encoded and decoded again: tabs, line ends, backslashes, nulls, empty texts and values that look like codes."""
    rows = odd_rows(spark, sf)
    legend, packed = R.compact_table(rows, ["id", "name", "p_brand", "p_size"])
    return R.expanded_table(legend, packed, "id long, name string, p_brand string, p_size int")


@query("compact_gain", "SELECT sum(octet_length(encode(p_partkey || chr(9) || p_name || chr(9) || p_brand || chr(9) || p_type)) + 1)::BIGINT AS plain, true AS worth FROM part")
def compact_gain(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    legend, packed = R.compact_table(rows, rows.columns)
    return R.worth_encoding(rows, legend, packed, rows.columns).select("plain", "worth")


@query("scope_leaks", "SELECT p_brand AS file, p_partkey AS line, text, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'two' ELSE 'one' END AS scope FROM (SELECT *, 'see ' || 'Brand#' || (1 + p_size % 3) || '/x' AS text FROM part) WHERE (starts_with(p_brand, 'Brand#1') AND contains(text, 'Brand#2')) OR (starts_with(p_brand, 'Brand#2') AND contains(text, 'Brand#1'))")
def scope_leaks(spark, sf):
    text = F.concat(F.lit("see Brand#"), (1 + F.col("p_size") % 3).cast("string"), F.lit("/x"))
    entries = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), text.alias("text"))
    return Y.scope_leaks(entries, [("one", "Brand#1"), ("two", "Brand#2")])


@query("column_files", "WITH c AS (SELECT DISTINCT p_type AS model, p_name AS col FROM part), f AS (SELECT DISTINCT 'models/' || lower(p_type) || '.sql' AS file, lower(p_type) AS stem FROM part) SELECT model, col, file FROM c LEFT JOIN f ON lower(model) = stem")
def column_files(spark, sf):
    p = table(spark, sf, "part")
    columns = p.select(F.col("p_type").alias("model"), F.col("p_name").alias("col")).distinct()
    files = p.select(F.concat(F.lit("models/"), F.lower("p_type"), F.lit(".sql")).alias("file")).distinct()
    return S.column_files(columns, files)


@query("base_classes", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Base' || p_size WHEN 1 THEN 'A' || p_size || ',B' ELSE '' END AS bases FROM part")
def base_classes(spark, sf):
    size = F.col("p_size").cast("string")
    signature = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("class X(Base"), size, F.lit(", metaclass=m):"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("class X extends A"), size, F.lit(" implements B {"))).otherwise("class X {")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.bases_of(signature), ",").alias("bases"))


@query("package_names", "SELECT DISTINCT p_name AS raw, replace(p_name, ' ', '-') AS name FROM part")
def package_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("raw")).distinct()
    return p.select("raw", X.package_name(F.replace(F.initcap("raw"), F.lit(" "), F.lit("_."))).alias("name"))


@query("main_guards", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS guarded FROM part")
def main_guards(spark, sf):
    content = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x = '"), "p_name", F.lit("'\nif  __name__ == '__main__':\n    run()"))).otherwise(F.concat(F.lit("main = '"), "p_name", F.lit("'")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), content.rlike(X.MAIN_GUARD).alias("guarded"))


@query("stripped_templates", "SELECT p_partkey AS id, 'select  from ' || replace(p_name, ' ', '_') || ' join raw.t' || p_size AS text FROM part")
def stripped_templates(spark, sf):
    name, size = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string")
    text = F.concat(F.lit("select {# note #}{% if a %} from {{ ref('"), name, F.lit("') }} join {{ source('raw', 't"), size, F.lit("') }}"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(X.strip_jinja(text), "  +from", "  from").alias("text"))


# -- sources and stored tables --------------------------------------------------------------------------------------------

#: For each language, a text with a name in it and the specifiers that it imports, in order.
IMPORT_SAMPLES = {
    "python": ("import os, {n}.core as c\nfrom .{n} import (a as x,\n  b)\n# import no", [".{n}", "os", "{n}.core"]),
    "javascript": ("import A, {{ b as c }} from './{n}';\nconst x = require('{n}/lib');\nimport 'side';", ["./{n}", "side", "{n}/lib"]),
    "go": ("import (\n  \"fmt\"\n  alias \"example.com/{n}\"\n)\nvar s = []string{{\n  \"no\",\n}}\n", ["example.com/{n}", "fmt"]),
    "java": ("import static org.{n}.Util.go;\nimport java.util.List;", ["java.util.List", "org.{n}.Util.go"]),
    "rust": ("use std::{{io, fmt::Display}};\nuse {n}::inner;", ["std::fmt::Display", "std::io", "{n}::inner"]),
    "c": ("#include <stdio.h>\n#include \"{n}.h\"", ["stdio.h", "{n}.h"]),
    "csharp": ("using Json = Lib.{n};\nusing System.Text;\nusing (var x = y) {{}}", ["Lib.{n}", "System.Text"]),
    "scala": ("import scala.{n}.{{Map, Set}}\nimport a.b", ["a.b", "scala.{n}.Map", "scala.{n}.Set"]),
    "ruby": ("require 'json'\nrequire_relative '{n}'", ["json", "{n}"]),
    "php": ("use App\\{n}\\Thing;\nrequire_once('{n}.php');", ["App\\{n}\\Thing", "{n}.php"]),
    "swift": ("@testable import {n}", ["{n}"]),
    "haskell": ("import qualified Data.{n} as M", ["Data.{n}"]),
    "dart": ("import 'package:{n}/a.dart';", ["package:{n}/a.dart"]),
    "sql": ("select * from {{{{ ref('{n}') }}}} join {{{{ source('raw', '{n}') }}}}", ["raw.{n}", "{n}"]),
    "vhdl": ("library {n};\nlibrary work;\nuse {n}.all;", ["{n}", "{n}.all"]),
    "verilog": ("`include \"{n}.vh\"", ["{n}.vh"]),
    "asm": ("%include \"{n}.inc\"", ["{n}.inc"]),
}
_WANTED = " UNION ALL ".join(f"SELECT '{lang}' AS language, unnest([{', '.join(repr(s) for s in found)}]) AS pattern" for lang, (_, found) in IMPORT_SAMPLES.items()).replace("\\\\", "\\")


@query("import_extraction", f"WITH n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS n FROM part), w AS ({_WANTED}) SELECT language || '/' || n AS file, replace(pattern, '{{n}}', n) AS specifier FROM n, w")
def import_extraction(spark, sf):
    """Files of every language, each with a name of part in its imports."""
    names = table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("n")).distinct()
    samples = F.array(*(F.struct(F.lit(lang).alias("language"), F.lit(text.format(n="%NAME%")).alias("text")) for lang, (text, _) in IMPORT_SAMPLES.items()))
    files = names.select("n", F.explode(samples).alias("x")).select(F.concat("x.language", F.lit("/"), "n").alias("file"), "x.language", F.replace("x.text", F.lit("%NAME%"), F.col("n")).alias("text"))
    return I.extract(files).select("file", "specifier")


_RESOLVED = [("app/main.py", "app/core/util.py", ".core.util"), ("app/main.py", "app/core/__init__.py", "app.core"), ("web/a.ts", "web/b.tsx", "./b"), ("web/a.ts", "web/lib/index.ts", "./lib"), ("web/a.ts", "web/lib/index.ts", "@lib"), ("web/lib/index.ts", "web/b.tsx", "../b"), ("m/x.sql", "m/stg_orders.sql", "stg_orders")]


@query("import_resolution", "SELECT * FROM (VALUES " + ", ".join(map(str, _RESOLVED)) + ") t(src, dst, specifier)")
def import_resolution(spark, sf):
    files = ["app/__init__.py", "app/main.py", "app/core/__init__.py", "app/core/util.py", "web/a.ts", "web/b.tsx", "web/lib/index.ts", "m/x.sql", "m/stg_orders.sql"]
    asked = [(src, specifier) for src, _, specifier in _RESOLVED] + [("app/main.py", "numpy"), ("web/a.ts", "react")]
    return I.resolve(spark.createDataFrame(asked, "file string, specifier string"), spark.createDataFrame([(f,) for f in files], "file string"), aliases={"@lib": "web/lib"})


CODE = {
    "python": "def f(a, b):\n    try:\n        a = eval(b)  # TODO check\n    except:\n        pass\n    return a * 37\n\nclass K(Base):\n    def m(self):\n        return f(1, 2)\n",
    "javascript": "export function f(a, b) {\n  try { a = eval(b); } // TODO check\n  catch (e) {}\n  return a * 37;\n}\nclass K extends Base {\n}\n",
}


def code_files(spark, sf):
    """Each brand's file, in one of two languages."""
    p = table(spark, sf, "part").select("p_brand").distinct()
    python = F.substring("p_brand", 7, 9).cast("int") % 2 == 0
    return p.select(F.col("p_brand").alias("path"), F.when(python, "python").otherwise("javascript").alias("language"), F.when(python, CODE["python"]).otherwise(CODE["javascript"]).cast("binary").alias("content"))


_HITS = {"python": [("bare_except", 4), ("empty_catch", 4), ("eval_exec", 3), ("magic_number", 6), ("reassigned_param", 3), ("todo_fixme", 3)], "javascript": [("empty_catch", 3), ("eval_exec", 2), ("magic_number", 4), ("reassigned_param", 2), ("todo_fixme", 2)]}


@query("ast_presets", "WITH b AS (SELECT DISTINCT p_brand, substr(p_brand, 7)::INT % 2 = 0 AS py FROM part), h AS (SELECT * FROM (VALUES " + ", ".join(f"({lang == 'python'}, '{rule}', {line})" for lang, hits in _HITS.items() for rule, line in hits) + ") t(py, rule, line)) SELECT p_brand AS file, rule, line FROM b JOIN h USING (py)")
def ast_presets(spark, sf):
    return A.search_ast(code_files(spark, sf), k=100_000).select("file", "rule", "line")


@query("parsed_symbols", "WITH b AS (SELECT DISTINCT p_brand, substr(p_brand, 7)::INT % 2 = 0 AS py FROM part), s AS (SELECT * FROM (VALUES (true, 'f', 'function', 1), (true, 'K', 'class', 8), (true, 'm', 'method', 9), (false, 'f', 'function', 1), (false, 'K', 'class', 6)) t(py, name, kind, line)) SELECT p_brand AS file, name, kind, line FROM b JOIN s USING (py)")
def parsed_symbols(spark, sf):
    return A.parse_symbols(code_files(spark, sf)).select("file", "name", "kind", "line")


@query("store_update", "SELECT p_brand AS repo, p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN p_size + 1000 ELSE p_size END AS size FROM part WHERE p_partkey % 3 <> 0 AND p_brand IN ('Brand#1', 'Brand#2')")
def store_update(spark, sf):
    """Three repositories saved; of two, a third of the keys goes and a third is replaced; of one, every key goes."""
    store = D.Store(spark, f"{G.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), "p_brand")
    for repo in ("Brand#1", "Brand#2", "Brand#3"):
        rows = p.where(F.col("p_brand") == repo).select("id", "size")
        store.save("symbols", rows, repo)
        if repo == "Brand#3":
            store.update("symbols", rows.limit(0), rows, "id", repo)
        else:
            store.update("symbols", rows.where("id % 3 = 1").withColumn("size", F.col("size") + 1000), rows.where("id % 3 = 0"), "id", repo)
    return store.load("symbols").select("repo", "id", "size")


# -- packages, context, outlines, health ----------------------------------------------------------------------------------


def brand_repos(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("package")).distinct()


@query("package_registry", "SELECT package, string_agg(repo, ',' ORDER BY repo) AS repos FROM (SELECT DISTINCT p_brand AS repo, p_name AS package FROM part) GROUP BY package")
def package_registry(spark, sf):
    return J.package_registry(brand_repos(spark, sf)).select("package", F.array_join("repos", ",").alias("repos"))


@query("cross_repo_files", "WITH p AS (SELECT DISTINCT p_brand AS repo, p_name AS package FROM part WHERE p_size < 10), i AS (SELECT DISTINCT p_brand AS repo, p_name AS package FROM part WHERE p_size > 45), e AS (SELECT p_brand AS repo, lower(p_type) || '/' || p_name AS file FROM part), f AS (SELECT repo, (SELECT file FROM e x WHERE x.repo = e.repo ORDER BY length(file), file LIMIT 1) AS file FROM e GROUP BY repo) SELECT i.repo, i.package, p.repo AS provider, f.file FROM i JOIN p ON i.package = p.package AND i.repo <> p.repo LEFT JOIN f ON f.repo = p.repo")
def cross_repo_files(spark, sf):
    p = table(spark, sf, "part")
    pairs = lambda test: p.where(test).select(F.col("p_brand").alias("repo"), F.col("p_name").alias("package"))
    return J.cross_repo_files(pairs("p_size > 45"), pairs("p_size < 10"), p.select(F.col("p_brand").alias("repo"), F.concat(F.lower("p_type"), F.lit("/"), "p_name").alias("file")))


@query("language_summary", "SELECT CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'api' ELSE 'data' END AS category, count(*) AS n, count(DISTINCT p_brand) AS files FROM part WHERE p_type IN ('PROMO', 'LARGE', 'SMALL') GROUP BY ALL")
def language_summary(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_type").alias("language"), F.col("p_brand").alias("file"))
    return J.language_summary(s, {"api": ["PROMO", "LARGE"], "data": ["SMALL"]})


@query("context_enrichment", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'own' WHEN substr(p_brand, 7)::INT % 3 = 0 THEN 'about ' || p_brand ELSE '' END AS summary, CASE WHEN substr(p_brand, 7)::INT % 3 = 0 THEN 'alpha,key,owner' ELSE 'key' END AS keywords FROM part")
def context_enrichment(spark, sf):
    p = table(spark, sf, "part")
    third = F.substring("p_brand", 7, 9).cast("int") % 3 == 0
    s = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.when(F.col("p_size") % 2 == 0, "own").otherwise("").alias("summary"), F.array(F.lit("key")).alias("keywords"))
    context = p.where(third).select(F.col("p_brand").alias("file")).distinct().select("file", F.concat(F.lit("about "), "file").alias("description"), F.array(F.lit("alpha"), F.lit("key")).alias("tags"), F.create_map(F.lit("owner"), F.lit("x")).alias("properties"))
    return J.enriched(s, context).select("id", "summary", F.array_join("keywords", ",").alias("keywords"))


@query("ambiguous_name", f"WITH {SYMBOLS_SQL} SELECT id, name, file, 'ambiguous' AS status FROM symbols WHERE name = 'red plate' UNION ALL SELECT id, name, file, 'ok' FROM symbols WHERE id = 7")
def ambiguous_name(spark, sf):
    return J.named(symbols(spark, sf), "red plate").unionByName(J.named(symbols(spark, sf), "7"))


@query("agent_config_files", "SELECT p_partkey || suffix AS file, scope FROM part, (VALUES ('/CLAUDE.md', 'project'), ('/.claude/CLAUDE.md', 'global'), ('/AGENTS.md', 'project')) t(suffix, scope) WHERE p_size = 7")
def agent_config_files(spark, sf):
    names = F.explode(F.array(*map(F.lit, ("/CLAUDE.md", "/.claude/CLAUDE.md", "/AGENTS.md", "/agents.txt", "/README.md"))))
    files = table(spark, sf, "part").where("p_size = 7").select("p_partkey", names.alias("s")).select(F.concat(F.col("p_partkey").cast("string"), "s").alias("file"))
    return J.agent_files(files)


@query("folder_outline", "WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS file FROM pages), p AS (SELECT file, string_split(file, '/') AS p FROM f), c AS (SELECT count(*) > 500 AND count(DISTINCT CASE WHEN len(p) = 1 THEN '.' WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END) > count(DISTINCT CASE WHEN len(p) = 1 THEN '.' ELSE p[1] END) AS finer FROM p) SELECT CASE WHEN len(p) = 1 THEN '.' WHEN finer AND len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END AS value, count(*)::DOUBLE AS n FROM p, c GROUP BY ALL ORDER BY n DESC, value LIMIT 40")
def folder_outline(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("file"))
    return J.repo_outline(files, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).where("what = 'folder'").select("value", "n")


@query("cycle_members", "SELECT * FROM (VALUES (1, 3::BIGINT, '1,2,3'), (7, 2, '7,8')) t(component, size, members)")
def cycle_members(spark, sf):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8), (8, 7), (9, 9)], "src int, dst int")
    return J.cycles(e).select("component", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("health_composed", f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src), scc AS (SELECT a, min(b) AS root FROM (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) GROUP BY a), d AS (SELECT node, sum(i) AS fi, sum(o) AS fo FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node) SELECT (SELECT count(*) FROM part) AS symbols, (SELECT round(avg(p_size), 4) FROM part) AS complexity, (SELECT count(*) FROM part WHERE p_size / 50.0 >= 0.67) AS dead, (SELECT count(DISTINCT root) FROM scc) AS cycles, (SELECT count(*) FROM d WHERE round(fo::DOUBLE / (fi + fo), 4) > 0.7) AS unstable, (SELECT max(p_size) FROM part)::INTEGER AS worst_hotspot")
def health_composed(spark, sf):
    s = symbols(spark, sf)
    return J.health(s, s.select("id", (F.col("cyclomatic") / 50.0).alias("confidence")), s.select(F.col("cyclomatic").alias("hotspot")), edges(spark, sf))


@query("snippet_pack", "SELECT * FROM (VALUES ('b', 3::BIGINT, 40::BIGINT), ('b', 4, 70), ('a', 1, 95)) t(file, id, used)")
def snippet_pack(spark, sf):
    """b is referenced most: 3 and 4 fit, 5 ends it; of a, 1 fits what is left and 2 ends it; c's first is too large."""
    rows = [("a", 1, 25, 2, 9), ("a", 2, 10, 2, 8), ("b", 3, 40, 5, 9), ("b", 4, 30, 5, 8), ("b", 5, 60, 5, 7), ("b", 6, 1, 5, 6), ("c", 7, 200, 1, 1)]
    return J.snippet_pack(spark.createDataFrame(rows, "file string, id long, size long, references int, weight int"), 100)


# -- streams ---------------------------------------------------------------------------------------------------------------


def streamed(spark, rows, schema=None):
    """rows, written to a folder and read as a stream."""
    folder = f"{G.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    return folder, spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


def drained(spark, folder, stream, mode):
    """Everything that the stream gives once it has read what there is."""
    keep = lambda batch, number: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def event_calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), "user_id", F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"))


@query("stream_windows", "SELECT event_type AS tool, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    folder, stream = streamed(spark, event_calls(spark, sf))
    return drained(spark, folder, W.windowed_counts(stream), "complete").select("tool", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_latency", "WITH r AS (SELECT event_type AS tool, value AS v, event_type = 'error' AS bad, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT tool, v, bad, row_number() OVER (PARTITION BY tool ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM r WHERE k <= 512) SELECT tool, n, max(v) FILTER (WHERE i = n // 2) AS p50, max(v) FILTER (WHERE i = least(floor(0.95 * n)::BIGINT, n - 1)) AS p95, max(v) AS max_ms, round(avg(bad::INT), 4) AS error_rate FROM s GROUP BY tool, n")
def stream_latency(spark, sf):
    folder, stream = streamed(spark, event_calls(spark, sf))
    return drained(spark, folder, W.rolling_latency(stream, "event_id"), "update")


@query("stream_changes", "WITH c AS (SELECT o_custkey || '.py' AS path, max_by(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END, o_orderkey) AS dummy, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey), l AS (SELECT o_custkey || '.py' AS path, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey IN (SELECT seq FROM c)), k AS (SELECT c_custkey || '.py' AS path, 'O' AS old FROM customer WHERE c_custkey % 2 = 0) SELECT state, count(*) AS n FROM (SELECT CASE WHEN hash IS NULL THEN 'deleted' WHEN old IS NULL THEN 'added' WHEN old = hash THEN 'same' ELSE 'modified' END AS state FROM l LEFT JOIN k USING (path)) WHERE state <> 'same' GROUP BY state")
def stream_changes(spark, sf):
    """A folder of change records watched once, classified against what is known, and written by batch."""
    path = F.concat(F.col("o_custkey").cast("string"), F.lit(".py"))
    changes = table(spark, sf, "orders").select(path.alias("path"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("hash"), F.col("o_orderkey").alias("seq"))
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit("O").alias("hash"))
    folder, _ = streamed(spark, changes)
    handle = lambda batch, number: W.classify(batch, known).write.mode("append").parquet(f"{folder}/out")
    W.watch(spark, f"{folder}/in", "path string, hash string, seq long", handle, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("state").agg(F.count("*").alias("n"))


@query("reindex_generations", "SELECT * FROM (VALUES ('a', 2::BIGINT, 2::BIGINT, 0::BIGINT), ('b', 2, 1, 1)) t(repo, begun, done, failures)")
def reindex_generations(spark, sf):
    """Two repositories; what an older generation writes is refused; the state outlives the object that wrote it."""
    folder = f"{G.shared_folder(spark)}/generations-{uuid.uuid4().hex}"
    one = W.Generations(spark, folder)
    first, _ = one.start("a"), one.finish("b", one.start("b"))
    second = W.Generations(spark, folder).start("a")
    assert not one.finish("a", first) and one.finish("a", second)
    one.start("b")
    one.fail("b")
    return W.Generations(spark, folder).table()
