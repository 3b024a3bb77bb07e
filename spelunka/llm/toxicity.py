"""Toxicity by compression distance: two trained zstandard dictionaries, window by window, and calibrated thresholds.

Learning uses at most ``sample_rows`` labelled rows of each class, those of the smallest hashes; this documented bound
fixes the size of the model and of everything that reaches the driver.

1. Contrast: byte n-grams of words are counted in both classes, over distinct contexts (the word and its two neighbours),
   so that copies of a text count once. The n-grams far more frequent in one class give that class's training text: the
   stretches of its words that they cover, as often as they occur.
2. Dictionaries: zstandard trains one on the toxic training text and one on the ordinary training text. Each follows a
   common base, which zstandard trains on at most ``base_windows`` windows of ordinary text (of the sample, by hash, and
   without contrasting words, so that wrong labels don't teach the base what tells the classes apart), so that both compress what is common alike; padding to equal lengths has the base indexed alike. zstandard indexes every
   third place of a dictionary, so a second pair holds each class's dictionary three times, once in each phase; of the two
   pairs, the one that classifies the sample better is used.
3. Windows: a text's words (runs of letters, lower case) are cut into windows. The gain of a window is its compressed
   length under the ordinary dictionary less that under the toxic one. A document's features are the sum of its gains, of
   its positive gains, its largest gain, and its number of words.
4. Calibration: a logistic regression on these features; then its threshold moves to where the F1 score on the sample,
   weighted as the classes are in all labelled rows, is best, and this becomes score 0.5.

Trained on all windows of each class alone, the dictionaries hold what is common in both and tell little: README.md has
the figures.

Defined results: null, empty and letterless texts have no windows and the score of no evidence; if the rows to learn from
lack one of the classes, every score is 0 or 1, as the only class says (0 with no rows at all). Labels count if 0 or 1;
rows with a null id or text teach nothing; a document with several label rows counts for each. Scores depend on the text
alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spelunka.llm.common import column, documents, durable, fold_of, slices

SAMPLE_ROWS = 6_000
WINDOW, GRAM = 8, 6
LEVEL = 3
BASE_BYTES, CLASS_BYTES, PHASES = 16 << 10, 2 << 10, 3
CONTRAST = 5.0
BASE_WINDOWS = 40_000
TRAINING_SAMPLES = 20_000  # stretches that a class's dictionary is trained on, repeated as often as they occur
_EDGES = b"\x00"


def words_of():
    import regex

    find = regex.compile(r"\p{L}+").findall
    return lambda text: [(" " + w).encode() for w in find(text.lower())] if text else []


def grams(word: bytes, n: int = GRAM) -> set[bytes]:
    word += b" "
    return {word[i : i + n] for i in range(max(1, len(word) - n + 1))}


def stretches(word: bytes, good: frozenset, n: int = GRAM) -> list[bytes]:
    """The parts of a word, with its borders, that n-grams of good cover."""
    word += b" "
    covered = bytearray(len(word))
    for i in range(len(word) - n + 1):
        if word[i : i + n] in good:
            covered[i : i + n] = b"\x01" * n
    out, start = [], None
    for i, c in enumerate(covered + b"\x00"):
        if c and start is None:
            start = i
        elif not c and start is not None:
            out.append(word[start:i])
            start = None
    return out


def _contexts(batches):
    """toxic, context (a hash) and word, once each in a slice."""
    from xxhash import xxh64_intdigest

    find = words_of()
    for batch in slices(batches, size=2 << 20):
        seen: dict[tuple[int, int], bytes] = {}
        for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist()):
            words = find(text)
            for a, w, b in zip([b"", *words], words, [*words[1:], b""]):
                seen[toxic, xxh64_intdigest(_EDGES.join((a, w, b)))] = w
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array(np.array([k[1] for k in keys], np.uint64).view(np.int64)), pa.array(list(seen.values()), pa.binary())], ["toxic", "context", "word"])


def _counted(of_word):
    """Counts of what of_word(word, toxic) gives, by class."""

    def work(batches):
        for batch in batches:
            words: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for toxic, word in zip(column(batch, "toxic").to_pylist(), column(batch, "word").to_pylist()):
                words[toxic][word] += 1
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for toxic in (0, 1):
                for word, n in words[toxic].items():
                    for x in of_word(word, toxic):
                        found[toxic][x] += n
            for toxic in (0, 1):
                if found[toxic]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found[toxic]), pa.binary()), pa.array([toxic] * len(found[toxic]), pa.int32()), pa.array(list(found[toxic].values()), pa.int64())], ["x", "toxic", "n"])

    return work


def _sampled(rows: DataFrame, sample_rows: int) -> tuple[DataFrame, list[int]]:
    """At most sample_rows rows of each class, those of the smallest hashes, and how many rows each class has."""
    hashed = rows.withColumn("h", F.xxhash64("id", "text"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    parts = []
    for toxic in (0, 1):
        part = hashed.where(F.col("toxic") == toxic)
        if totals.get(toxic, 0) > sample_rows:
            share = 1.05 * sample_rows / totals[toxic]  # first by hash alone, so that few rows are sorted
            part = part.where(F.pmod(F.col("h"), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))).orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "id").limit(sample_rows)
        parts.append(part)
    return parts[0].unionByName(parts[1]), [totals.get(0, 0), totals.get(1, 0)]


def _base_windows(contrast: frozenset):
    """Windows of four words, those with a contrasting word left out, and their hashes."""

    def work(batches):
        from xxhash import xxh64_intdigest

        find = words_of()
        for batch in slices(batches):
            out = []
            for text in column(batch, "text").to_pylist():
                words = [w for w in find(text) if contrast.isdisjoint(grams(w))]
                out += [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(np.array([xxh64_intdigest(x) >> 44 for x in out], np.int64))], ["w", "h"])

    return work


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary that zstandard trains on samples, or their end where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _repeated(counted: list[tuple[bytes, int]], samples: int = TRAINING_SAMPLES) -> list[bytes]:
    """Stretches as often as they occur, in all about that many, well mixed."""
    total = sum(n for _, n in counted)
    many = [x for x, n in sorted(counted) for _ in range(round(n * min(1.0, samples / max(1, total))))]
    return [many[i] for i in np.random.default_rng(0).permutation(len(many))]


def dictionaries(sample: DataFrame, base_windows: int = BASE_WINDOWS) -> list[tuple[bytes, bytes]]:
    """Pairs of (ordinary, toxic) raw dictionaries, learnt from rows (text, toxic): as trained, and each three times over."""
    context = durable(sample.mapInArrow(_contexts, "toxic int, context long, word binary").dropDuplicates(["toxic", "context"]))
    size = [0, 0]
    for r in context.groupBy("toxic").count().collect():
        size[r["toxic"]] = r["count"]
    least = max(16, 2e-5 * size[0]), max(8, 6e-5 * size[1])
    counts = context.mapInArrow(_counted(lambda w, _: grams(w)), "x binary, toxic int, n long").groupBy("x").agg(*(F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    far = [(F.col(f"n{c}") >= least[c]) & (F.col(f"n{c}") / size[c] >= CONTRAST * (F.col(f"n{1 - c}") + 1) / size[1 - c]) for c in (0, 1)]
    # A word has few n-grams, so no more than some tens of thousands of them reach these shares of all words.
    chosen = counts.select("x", *(far[c].alias(f"far{c}") for c in (0, 1))).where("far0 or far1").collect()
    picked = [frozenset(bytes(r["x"]) for r in chosen if r[f"far{c}"]) for c in (0, 1)]
    of_word = lambda w, toxic: stretches(w, picked[toxic])
    snippets = context.mapInArrow(_counted(of_word), "x binary, toxic int, n long").groupBy("toxic", "x").agg(F.sum("n").alias("n"))
    total = {r["toxic"]: r["n"] for r in snippets.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    least_n = F.when(F.col("toxic") == 0, total.get(0, 0)).otherwise(total.get(1, 0)) / (2 * TRAINING_SAMPLES)  # less than half a sample
    found = [(r["toxic"], bytes(r["x"]), r["n"]) for r in snippets.where(F.col("n") >= least_n).collect()]
    own = [_trained(_repeated([(x, n) for c, x, n in found if c == toxic]), CLASS_BYTES, 32, 8) for toxic in (0, 1)]
    windows = sample.where("toxic = 0").mapInArrow(_base_windows(picked[0] | picked[1]), "w binary, h long").where(F.col("w").isNotNull())
    base = _trained(windows.orderBy("h", "w").limit(base_windows).select("w").toPandas()["w"].map(bytes).tolist(), BASE_BYTES, 64, 6)
    pairs = []
    for laid in (own, [b"".join(b" " * ((len(x) + i) % 3) + x for i in range(PHASES)) for x in own]):
        longest = max(map(len, laid))
        pairs.append(tuple(base + bytes(longest - len(x)) + x for x in laid))
    return pairs


class Gains:
    """Compressed lengths of windows under both dictionaries."""

    def __init__(self, pair: tuple[bytes, bytes]):
        self.lengths = []
        for content in pair:
            known = zstandard.ZstdCompressionDict(content or b"\x00" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.lengths.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self.words = words_of()

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Sum of gains, of positive gains, largest gain, words."""
        words = self.words(text)
        ordinary, toxic = self.lengths
        gains = [len(ordinary(w)) - len(toxic(w)) for w in (b"".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW))]
        return float(sum(gains)), float(sum(g for g in gains if g > 0)), float(max(gains, default=0)), float(len(words))


def design(x: np.ndarray) -> np.ndarray:
    total, positive, largest, n = x.T
    return np.stack([np.ones(len(x)), 10 * total / (n + 50), 10 * positive / (n + 30), np.log1p(positive), np.maximum(largest, 0) / 4, np.log1p(n) / 4], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return best_cut(z, y, weight)[0]


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The middle between the two scores around the cut of best weighted F1, and that F1."""
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    last = np.r_[np.diff(z[order]) != 0, True]  # cut only where the score changes
    k = int(np.argmax(np.where(last, f1, -1)))
    return float(z[order][k] + (z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1)) / 2, float(f1[k])


def _measured(pair):
    def work(batches):
        gains = Gains(pair)
        for batch in slices(batches):
            found = np.array([gains.features(t) for t in column(batch, "text").to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["toxic", "a", "b", "c", "d"])

    return work


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, base_windows: int = BASE_WINDOWS) -> dict:
    """A model from rows (id, text, toxic): the two dictionaries and the regression."""
    sample, totals = _sampled(rows.where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & F.col("text").isNotNull()), sample_rows)
    if not all(totals):
        return {"only": float(totals[1] > 0)}
    sample = durable(sample.select("text", "toxic"))
    found = [calibrated(sample, pair, totals) for pair in dictionaries(sample, base_windows)]
    return max(found, key=lambda m: m["f1"])  # of equals the first


def calibrated(sample: DataFrame, pair: tuple[bytes, bytes], totals: list[int]) -> dict:
    """The regression over a pair's features, its threshold at score 0.5, and the F1 that it has there on the sample."""
    found = sample.mapInArrow(_measured(pair), "toxic int, a double, b double, c double, d double").toPandas().sort_values(["toxic", "a", "b", "c", "d"])
    y = found["toxic"].to_numpy(float)
    x = design(found[["a", "b", "c", "d"]].to_numpy())
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    b = fit_logistic(x, y, weight)
    cut, f1 = best_cut(x @ b, y, weight)
    b[0] -= cut
    return {"pair": pair, "b": b, "f1": f1}


def _scorer(sent, place: int):
    def work(batches):
        model = sent.value
        gains = Gains(model["pair"]) if "pair" in model else None
        for batch in slices(batches):
            texts = column(batch, "text").to_pylist()
            if gains is None:
                score = np.full(len(texts), model["only"])
            else:
                x = design(np.array([gains.features(t) for t in texts]).reshape(-1, 4))
                score = 1 / (1 + np.exp(-np.clip(x @ model["b"], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names[:place], "__score", "__predicted"])

    return work


def with_scores(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """df, all its columns as they are, and __score and __predicted (which replace columns of these names)."""
    kept = [f for f in df.schema.fields if f.name.lower() not in ("__score", "__predicted")]
    quoted = ["`" + f.name.replace("`", "``") + "`" for f in kept]
    rows = df.select(*(F.col(q).alias(f"c{i}") for i, q in enumerate(quoted)), F.col(text_col).alias("text"))  # plain names, whatever theirs are
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), T.StructField("__score", T.DoubleType()), T.StructField("__predicted", T.IntegerType())])
    return rows.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(model), len(kept)), schema).toDF(*(f.name for f in kept), "__score", "__predicted")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, text and toxic of the labelled documents to learn from: crc32 of the id modulo 5 is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(fold_of(F.col("doc_id"), 5) > 0)
    return texts.join(known, "id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, scored by what labels mark as toxic."""
    docs = documents(spark, sf_dir)
    model = learn(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return with_scores(rows, model).select("doc_id", "held_out", F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
