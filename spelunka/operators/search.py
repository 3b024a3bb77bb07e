"""Lexical, fuzzy, semantic and fused search over symbols or documents.

Every operator takes DataFrames and column names and returns a lazy DataFrame. Ranked outputs end with a unique key, so
ties are settled alike on any partitioning; top-k plans as TakeOrderedAndProject.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spelunka.functions import text as X

# BM25's parameters; the identity channel; fusion weights; confidence weights.
K1, B = 1.5, 0.75
IDENTITY_EXACT, IDENTITY_PREFIX, IDENTITY_PART = 50.0, 30.0, 20.0
CENTRALITY = 0.3
RRF_K = 60
CHANNELS = {"lexical": 1.0, "structural": 0.4, "similarity": 0.8, "identity": 2.0}
CONFIDENCE = {"gap": 0.35, "strength": 0.35, "identity": 0.15, "freshness": 0.15}


def abbreviations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.abbreviation_pairs(), "term string, form string")


def postings(df: DataFrame, id_col: str, fields: dict[str, int], expand: bool = False) -> DataFrame:
    """id, term, tf: tokens of the fields, each counted with its field's weight.

    expand adds stems and abbreviation forms: one count each, unless the form has stood in the text before the first
    token that yields it. Terms are aggregated before anything else is joined.
    """
    def weighted(c, w):
        return F.transform(X.split_tokens(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    parts = [weighted(c, w) for c, w in fields.items()]
    tokens = df.select(F.col(id_col).alias("id"), F.posexplode(F.concat(*parts)).alias("pos", "t")).select("id", "pos", "t.term", "t.w")
    raw = tokens.groupBy("id", "term").agg(F.sum("w").alias("tf"), F.min("pos").alias("pos"))
    if not expand:
        return raw.select("id", "term", "tf")
    stemmed = raw.withColumn("stem", X.stem(F.col("term")))
    short = F.broadcast(abbreviations(df.sparkSession))  # a fixed table of under a hundred rows
    own = stemmed.where("stem <> term").select("id", "pos", F.col("stem").alias("form"))
    by_term = stemmed.join(short, "term").select("id", "pos", "form")
    by_stem = stemmed.where("stem <> term").select("id", "pos", F.col("stem").alias("term")).join(short, "term").select("id", "pos", "form")
    derived = own.unionByName(by_term).unionByName(by_stem).select("id", F.col("form").alias("term"), F.lit(0).cast("long").alias("tf"), F.lit(None).cast("int").alias("pos"), F.col("pos").alias("from"))
    both = raw.withColumn("from", F.lit(None).cast("int")).unionByName(derived).groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.min("pos").alias("pos"), F.min("from").alias("from"))
    extra = F.when(F.col("from").isNotNull() & (F.col("pos").isNull() | (F.col("from") < F.col("pos"))), 1).otherwise(0)
    return both.select("id", "term", (F.col("tf") + extra).alias("tf"))


def document_lengths(post: DataFrame) -> DataFrame:
    """id and dl, the distinct terms of each document."""
    return post.groupBy("id").agg(F.count("*").alias("dl"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """One row: n documents and their mean length."""
    return document_lengths(post).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(post: DataFrame) -> DataFrame:
    """term, df, idf."""
    n = post.select("id").distinct().agg(F.count("*").alias("n"))
    return post.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", idf_of("df", "n").alias("idf"))


def idf_of(df: str, n: str) -> Column:
    return F.log((F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1.0)


def term_scores(post: DataFrame, terms: list[str]) -> DataFrame:
    """id, term, score of each query term. Only the terms' postings are joined; lengths come from one aggregation."""
    lengths = document_lengths(post)
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = post.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    k = K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
    joined = hits.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(stats))  # df: a row a query term; stats: one row
    return joined.select("id", "term", (idf_of("df", "n") * F.col("tf") * (K1 + 1) / (F.col("tf") + k)).alias("score"))


def bm25(post: DataFrame, query: str, expand: bool = False) -> DataFrame:
    """id, score of every document that holds a query term, from stored postings."""
    terms = X.expand_query(query) if expand else list(dict.fromkeys(X.tokens_of(query)))
    return term_scores(post, terms).groupBy("id").agg(F.sum("score").alias("score"))


def bags(df: DataFrame, id_col: str, fields: dict[str, int], terms: list[str]) -> DataFrame:
    """id, dl (distinct terms) and tfs (weighted count of each term, in their order), all inside the row: ids are unique, so
    nothing is exploded and nothing is shuffled."""
    tokens = {c: X.split_tokens(F.col(c)) for c in fields}
    held = df.select(F.col(id_col).alias("id"), *(t.alias(f"t{i}") for i, t in enumerate(tokens.values())))
    columns = [(F.col(f"t{i}"), w) for i, w in enumerate(fields.values())]
    every = F.array_distinct(F.concat(*(t for t, _ in columns)))
    hits = [F.filter(t, lambda x: x.isin(terms)) for t, _ in columns]  # few tokens are left to be counted
    held = held.select("id", F.size(every).alias("dl"), *(h.alias(f"h{i}") for i, h in enumerate(hits)))
    count = lambda q: sum((w * F.size(F.filter(F.col(f"h{i}"), lambda x: x == q)) for i, (_, w) in enumerate(columns)), F.lit(0))
    return held.select("id", "dl", F.array(*(count(q) for q in terms)).alias("tfs"))


def bag_stats(found: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n documents with a term at all, their mean length, and dfs, each query term's document frequency."""
    dfs = F.array(*(F.sum(F.when(F.col("tfs")[i] > 0, 1).otherwise(0)) for i in range(len(terms))))
    return found.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), dfs.alias("dfs"))


def bag_scores(found: DataFrame, terms: list[str], stats: DataFrame | None = None) -> DataFrame:
    """found with scores, the score of each query term in order, and score, their sum; documents without any go."""
    stats = bag_stats(found, terms) if stats is None else stats
    k = K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
    weight = lambda i: F.log((F.col("n") - F.col("dfs")[i] + 0.5) / (F.col("dfs")[i] + 0.5) + 1.0) * F.col("tfs")[i] * (K1 + 1) / (F.col("tfs")[i] + k)
    scored = found.where(F.exists("tfs", lambda t: t > 0)).join(F.broadcast(stats))  # one row
    scored = scored.withColumn("scores", F.array(*(weight(i) for i in range(len(terms)))))
    return scored.withColumn("score", F.aggregate("scores", F.lit(0.0), lambda a, b: a + b)).drop("n", "avgdl", "dfs")


def bm25_rows(df: DataFrame, id_col: str, fields: dict[str, int], query: str) -> DataFrame:
    """id, score as bm25() gives, from the texts themselves: one scan, whose narrow result serves statistics and scores; no shuffle."""
    from spelunka.operators.graph import kept

    terms = list(dict.fromkeys(X.tokens_of(query)))
    return bag_scores(kept(bags(df, id_col, fields, terms)), terms).select("id", "score")


def top(df: DataFrame, k: int, *by) -> DataFrame:
    return df.orderBy(*by).limit(k)


def identity(name: Column, ident: Column, query: str) -> Column:
    """50 for an exact name or id, 30 for a prefix of the name, 20 for a part of the id."""
    raw, joined = query.lower(), " ".join(X.tokens_of(query))
    name, ident = F.lower(name), F.lower(ident.cast("string"))
    forms = [q for q in dict.fromkeys((raw, joined)) if q]
    if not forms:
        return F.lit(0.0)
    any_of = lambda test: reduce(or_, [test(F.lit(q)) for q in forms])
    return F.when(any_of(lambda q: (name == q) | (ident == q)), IDENTITY_EXACT).when(any_of(name.startswith), IDENTITY_PREFIX).when(any_of(ident.contains), IDENTITY_PART).otherwise(0.0)


def legacy_score(df: DataFrame, query: str, name: str = "name", signature: str = "signature", summary: str = "summary", docstring: str = "docstring", keywords: str = "keywords") -> Column:
    """Integer weights for substring hits in each field; missing columns count nothing."""
    q, words = query.lower(), sorted(set(query.lower().split()))
    field = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    hit = lambda test, w: F.when(test, w).otherwise(0)
    score = F.lit(0)
    if name in df.columns:
        score = score + F.when(field(name) == q, 20).when(field(name).contains(q), 10).otherwise(0) + sum((hit(field(name).contains(w), 5) for w in words), F.lit(0))
    if signature in df.columns:
        score = score + hit(field(signature).contains(q), 8) + sum((hit(field(signature).contains(w), 2) for w in words), F.lit(0))
    if summary in df.columns:
        score = score + hit(field(summary).contains(q), 5) + sum((hit(field(summary).contains(w), 1) for w in words), F.lit(0))
    if keywords in df.columns:
        score = score + 3 * F.size(F.array_intersect(F.col(keywords), F.array(*map(F.lit, words))))
    if docstring in df.columns:
        score = score + sum((hit(field(docstring).contains(w), 1) for w in words), F.lit(0))
    return score


def fuzzy(df: DataFrame, query: str, name: str = "name", min_jaccard: float = 0.4, max_edits: int = 2) -> DataFrame:
    """Rows whose name is close to query by trigrams or by edits, with both measures. One query is a literal: no join."""
    q = query.lower()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)}) or [q]
    found = df.withColumns({"jaccard": X.jaccard(X.trigrams(F.lower(name)), F.array(*map(F.lit, grams))), "edits": F.levenshtein(F.lower(name), F.lit(q))})
    return found.where((F.col("jaccard") >= min_jaccard) | (F.col("edits") <= max_edits))


def deletions(d: DataFrame, c: str, most: int) -> DataFrame:
    """c and v: the names of column c and what is left of each after at most that many deletions."""
    now = d.select(c, F.col(c).alias("v"))
    seen = now
    for _ in range(most):
        now = now.where(F.length("v") > 0).select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.concat(F.substring("v", F.lit(1), i - 1), F.substring(F.col("v"), i + 1, F.length("v"))))).alias("v")).distinct()
        seen = seen.unionByName(now)
    return seen.distinct()


def fuzzy_pairs(left: DataFrame, right: DataFrame, min_jaccard: float = 0.4, max_edits: int = 2) -> DataFrame:
    """Pairs of distinct names (columns `name`) that are close: blocked by trigram for the first test and by deleted
    characters for the second (names within e edits share a variant with at most e deletions), never a cross join."""
    a, b = left.select(F.lower("name").alias("a")).distinct(), right.select(F.lower("name").alias("b")).distinct()
    gram = lambda d, c: d.select(c, F.size(X.trigrams(F.col(c))).alias(f"n{c}"), F.explode(X.trigrams(F.col(c))).alias("g"))
    shared = gram(a, "a").join(gram(b, "b"), "g").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    by_gram = shared.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= min_jaccard).select("a", "b")

    by_edit = deletions(a, "a", max_edits).join(deletions(b, "b", max_edits), "v").select("a", "b").distinct().where(F.levenshtein("a", "b") <= max_edits)
    return by_gram.unionByName(by_edit).distinct().withColumns({"jaccard": X.jaccard(X.trigrams(F.col("a")), X.trigrams(F.col("b"))), "edits": F.levenshtein("a", "b")})


def search_lines(lines: DataFrame, query: str, regex: bool = False, file_glob: str | None = None) -> DataFrame:
    """Lines that hold query, case ignored; text clipped to 200 characters."""
    if regex:
        check_regex(query)
    found = lines.where(F.col("text").rlike(f"(?i){query}") if regex else F.lower("text").contains(query.lower()))
    if file_glob:
        found = found.where(X.glob(F.col("file"), file_glob, "suffix"))
    return found.withColumn("text", F.substring("text", 1, 200))


def check_regex(pattern: str, longest: int = 200) -> None:
    """Refuses patterns that are long or repeat a repetition."""
    import re

    if len(pattern) > longest:
        raise ValueError("pattern too long")
    if re.search(r"\([^()]*[+*{][^()]*\)\s*[+*{]", pattern):
        raise ValueError("nested repetition")
    re.compile(pattern)


def with_context(lines: DataFrame, query: str, around: int, partition: str = "doc_id") -> DataFrame:
    """Hits with the lines around them joined by newlines: before and after."""
    w = Window.partitionBy(partition).orderBy("line")
    hold = lines.withColumns({"before": F.array_join(F.collect_list("text").over(w.rowsBetween(-around, -1)), "\n"), "after": F.array_join(F.collect_list("text").over(w.rowsBetween(1, around)), "\n")})
    return hold.where(F.lower("text").contains(query.lower()))


def column_score(column: Column, description: Column, query: str) -> Column:
    """Column metadata search: 30 exact, 15 contained, else 5 a word; description 8 whole, else 2 a word."""
    q, words = query.lower(), sorted(set(query.lower().split()))
    c, d = F.lower(column), F.lower(description)
    count = lambda x, w: sum((F.when(x.contains(t), w).otherwise(0) for t in words), F.lit(0))
    return F.when(c == q, 30).when(c.contains(q), 15).otherwise(count(c, 5)) + F.when(d.contains(q), 8).otherwise(count(d, 2))


def columns_of(metadata: DataFrame) -> DataFrame:
    """source, model, column, description from a map source -> model -> column -> description (keys that end in _columns)."""
    return (
        metadata.select(F.explode("metadata").alias("source", "models"))
        .where(F.col("source").endswith("_columns"))
        .select("source", F.explode("models").alias("model", "cols"))
        .select("source", "model", F.explode("cols").alias("column", "description"))
    )


# -- filter algebra -----------------------------------------------------------------------------------------------------

OPERATIONS = {"kind": ("in", "eq"), "language": ("in", "eq"), "name": ("eq", "matches"), "file": ("matches",), "complexity": (">", "<", ">=", "<=", "=="), "churn": (">", "<", ">=", "<=", "=="), "decorator": ("contains",), "calls": ("contains",), "summary": ("contains",)}
AXES = {"complexity": "cyclomatic", "decorator": "decorators", "calls": "call_references"}
RANKS = {"importance": "importance", "complexity": "cyclomatic", "churn": "churn", "name": "name"}


def _holds(array: Column, needle: str) -> Column:
    return F.exists(array, lambda x: F.lower(x).contains(needle))


def criterion(axis: str, op: str, value, dtypes: dict[str, str] | None = None) -> Column:
    """One test as a column expression; unknown axes and operations are refused."""
    if op not in OPERATIONS.get(axis, ()):
        raise ValueError(f"no operation {op!r} on {axis!r}")
    if value is None or value == []:
        raise ValueError(f"{axis} needs a value")
    c = F.col(AXES.get(axis, axis))
    if op == "in":
        return c.isin(list(value))
    if op == "eq":
        return c == F.lit(value)
    if op == "matches":
        return X.glob(c, value) if axis == "file" else F.coalesce(c, F.lit("")).rlike(value)
    if op == "contains":
        needles = [str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]
        tests = [_holds(c, n) if axis != "summary" else F.lower(c).contains(n) for n in needles]
        return F.coalesce(reduce(or_, tests), F.lit(False))
    number = F.coalesce(c.try_cast("double"), F.lit(0.0))
    try:
        limit = F.lit(float(value))
    except (TypeError, ValueError):
        return F.lit(False)
    return {">": number > limit, "<": number < limit, ">=": number >= limit, "<=": number <= limit, "==": number == limit}[op]


def winnow(df: DataFrame, criteria: list[tuple], rank_by: str = "importance", order: str = "desc", k: int = 20, key: str = "id") -> DataFrame:
    """Rows that meet all criteria, ranked, at most k: one filter, one top-k."""
    if rank_by not in RANKS or order not in ("asc", "desc"):
        raise ValueError("unknown ranking")
    for c in criteria:
        df = df.where(criterion(*c))
    by = F.col(RANKS[rank_by])
    return df.orderBy(by.desc() if order == "desc" else by.asc(), key).limit(max(1, k))


# -- vectors and fusion -------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    sizes = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (sizes > 0), dot(a, b) / F.nullif(sizes, F.lit(0.0))).otherwise(0.0)


def against(df: DataFrame, query: DataFrame, vector: str) -> DataFrame:
    """df with score, the cosine with the one vector of query (one row, broadcast)."""
    one = query.select(F.col(vector).alias("__q")).limit(1)
    return df.join(F.broadcast(one)).withColumn("score", cosine(F.col(vector), F.col("__q"))).drop("__q")


def hybrid(lexical: DataFrame, semantic: DataFrame, weight: float) -> DataFrame:
    """id, score: (1 - weight) x lexical / its maximum + weight x semantic; not above 0 go."""
    best = lexical.agg(F.max("score").alias("best"))
    scaled = lexical.join(F.broadcast(best)).select("id", F.when(F.col("best") > 0, F.col("score") / F.nullif("best", F.lit(0.0))).otherwise(0.0).alias("l"))
    both = scaled.join(semantic.select("id", F.col("score").alias("s")), "id", "full")
    score = (1 - weight) * F.coalesce("l", F.lit(0.0)) + weight * F.coalesce("s", F.lit(0.0))
    return both.select("id", score.alias("score")).where("score > 0")


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rank, from 1, over all rows: sorted by ranges, numbered inside each, and shifted by the sizes of those before."""
    from spelunka.operators.graph import kept

    rows = kept(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__b")  # a row a partition
    return rows.withColumns({"__p": part, "__i": place}).join(F.broadcast(before), "__p").withColumn("rank", F.col("__b") + F.col("__i") + 1).drop("__p", "__i", "__b", "__m")


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """id, score: weighted reciprocal ranks over channels (id, score), of all rows; ties within a channel by id."""
    weights = CHANNELS | (weights or {})
    out = None
    for name, df in channels.items():
        part = ranked(df.select("id", "score"), F.desc("score"), "id").select("id", (F.lit(weights.get(name, 1.0)) / (k + F.col("rank"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def confidence(first: Column, second: Column, identity_hit: Column, stale: Column) -> Column:
    """Weighted geometric mean of gap, strength, identity and freshness, three decimals; null first: neutral."""
    gap = F.when(first.isNull(), 0.5).when(first <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (first - F.coalesce(second, F.lit(0.0))) / F.nullif(first, F.lit(0.0)))))
    strength = F.when(first.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.exp(-first / 4))))
    parts = {"gap": gap, "strength": strength, "identity": F.when(identity_hit.isNull(), 0.7).when(identity_hit, 1.0).otherwise(0.6), "freshness": F.when(stale, 0.6).otherwise(1.0)}
    return F.round(F.exp(sum((F.lit(CONFIDENCE[n]) * F.log(F.greatest(F.lit(1e-6), c)) for n, c in parts.items()), F.lit(0.0))), 3)


def negative_evidence(scores: DataFrame, files: DataFrame, query: str, weak: float = 0.5, k: int = 5) -> DataFrame:
    """verdict, and up to k files whose name holds a term, if the best score (column score) is weak."""
    terms = X.tokens_of(query)
    best = scores.agg(F.max("score").alias("best")).select(F.when(F.col("best").isNull(), "no_implementation_found").when(F.col("best") < weak, "low_confidence_matches").otherwise("found").alias("verdict"), F.round("best", 6).alias("best"))
    name = F.lower(X.basename(F.col("file")))
    held = reduce(or_, [name.contains(t) for t in terms], F.lit(False))
    near = files.where(held).select("file").distinct().orderBy("file").limit(k).agg(F.array_join(F.sort_array(F.collect_list("file")), ",").alias("related_files"))
    return best.join(F.broadcast(near))


# -- symbol search, end to end ------------------------------------------------------------------------------------------

#: What a term counts in each field of a symbol.
FIELDS = {"name": 3, "signature": 2, "summary": 1, "docstring": 1}
SORTS = ("relevance", "name", "file", "complexity")


def narrowed(symbols: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """Only symbols in one of whose fields a term stands as a part: a filter that the scan can apply before any tokens are cut."""
    return symbols.where(reduce(or_, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t) for c in fields for t in terms], F.lit(False)))


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, language: str | None = None, file_glob: str | None = None, sort_by: str = "relevance", k: int = 20, budget: int | None = None, centrality: DataFrame | None = None) -> DataFrame:
    """id, name, file, score of the best symbols: filters, candidates that hold a term, weighted BM25, the identity bonus,
    0.3 x ln(1 + centrality of the file); if nothing is found, fuzzy names. Sorted and cut to k; with a budget (of
    byte_length), packed into it.

    Frequencies are of all symbols that pass the filters, not of the candidates. An empty query lists what passes."""
    from spelunka.operators.packing import greedy_skip

    if sort_by not in SORTS:
        raise ValueError(f"no such order: {sort_by!r}")
    for c, value in (("kind", kind), ("language", language)):
        symbols = symbols.where(F.col(c) == value) if value else symbols
    symbols = symbols.where(X.glob(F.col("file"), file_glob, "name")) if file_glob else symbols
    fields = {c: w for c, w in FIELDS.items() if c in symbols.columns}
    terms = list(dict.fromkeys(X.tokens_of(query)))
    if terms:
        bag = bags(symbols, "id", fields, terms)
        scores = bag_scores(bags(narrowed(symbols, terms, list(fields)), "id", fields, terms), terms, bag_stats(bag, terms)).select("id", F.col("score").alias("lexical"))
        bonus = identity(F.col("name"), F.col("id"), query)
        found = symbols.join(scores, "id", "left").withColumn("score", F.coalesce("lexical", F.lit(0.0)) + bonus).where("score > 0").drop("lexical")
        if found.isEmpty():
            found = fuzzy(symbols, query).withColumn("score", F.col("jaccard")).drop("jaccard", "edits")
    else:
        found = symbols.withColumn("score", F.lit(0.0))
    if centrality is not None:
        found = found.join(centrality.select("file", F.col("n").alias("__n")), "file", "left").withColumn("score", F.col("score") + CENTRALITY * F.log1p(F.coalesce("__n", F.lit(0)))).drop("__n")
    order = {"relevance": [F.desc("score"), "id"], "name": ["name", "id"], "file": ["file", "id"], "complexity": [F.desc("cyclomatic"), "id"]}[sort_by]
    if budget is not None:
        packed = greedy_skip(found, budget, [F.col(c) if isinstance(c, str) else c for c in order], "byte_length", "id").select("id")
        found = found.join(packed, "id", "left_semi")
    return top(found, k, *order).select("id", "name", "file", "score")


def column_files(columns: DataFrame, files: DataFrame) -> DataFrame:
    """columns (model, ...) with the file whose stem is the model's name, case ignored; of several the least; null if none."""
    stems = files.groupBy(F.lower(X.stem_of_path(F.col("file"))).alias("__stem")).agg(F.min("file").alias("file"))
    return columns.join(stems, F.lower("model") == F.col("__stem"), "left").drop("__stem")
