import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spelunka.functions import text as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


def test_tokens_stems(spark):
    assert one(spark, "getUserName_v2 É x9y", X.split_tokens) == ["get", "user", "name", "v2", "x9y"]
    words = ["running", "caches", "class", "indexed", "relation", "batteries", "tokens", "add", "passes", "settings", "controller", "dbs"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [X.stem_word(r.w) for r in got]
    assert X.expand_query("dbConfig") == ["db", "database", "config", "configuration"]


def test_trigrams_entropy_nesting(spark):
    assert one(spark, "ab", X.trigrams) == ["ab"] and one(spark, "abcab", X.trigrams) == ["abc", "bca", "cab"]
    assert abs(one(spark, "aabb", X.entropy) - 1.0) < 1e-9 and one(spark, "", X.entropy) == 0.0
    assert one(spark, "f(a[b], {c: (d)})", X.nesting) == 2
    assert one(spark, "if a && b: for c", X.cyclomatic) == 4
    assert [one(spark, s, X.param_count) for s in ("f()", "f(void)", "f(a, b)", "f(a: Map<K, V>, g(x, y))")] == [0, 0, 2, 2]


def test_redact(spark):
    random_key = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vW"
    text = f"key AKIA{'A' * 16} api_key = '{random_key}' token=ghp_{'x' * 36} api_key='{'a' * 32}' at 10.0.0.1:80"
    got = one(spark, text, X.redact)
    assert "AKIA" not in got and random_key not in got and "ghp_" not in got and "a" * 32 in got and "10.0.0.1" not in got


def test_paths(spark):
    assert one(spark, "a/tests/b.py", X.is_test) and one(spark, "x/test_a.py", X.is_test) and not one(spark, "tests.py", X.is_test)
    assert one(spark, "a/b/main.py", X.is_entry) and one(spark, "a/index.ts", X.is_barrel)
    assert one(spark, "class A(Base, metaclass=M, Other):", X.bases_of) == ["Base", "Other"]
    assert one(spark, "class A extends B implements C, D {", X.bases_of) == ["B", "C", "D"]
    assert one(spark, "select {{ ref('a') }} {# x #} {% if y %} {{ z }}", X.strip_jinja).split() == ["select", "a", "placeholder"]
    assert one(spark, "Fix it\n\nSigned-off-by: x\nbecause of y", X.commit_intent) == "because of y"
    assert one(spark, "Fix the bug", X.commit_category) == "bugfix"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ab/.*?[]!x", max_size=6), st.text("ab/.x", max_size=6)), min_size=1, max_size=5))
def test_glob_like_fnmatch(pairs):
    import re

    for pattern, path in pairs:
        if "[" in pattern or "]" in pattern or "!" in pattern:
            continue
        assert bool(re.search("(?s)" + X.glob_regex(pattern), path)) == X.matches_glob(path, pattern)


def test_entropy_formula():
    assert math.log2(4) == 2
