"""Language identification by segmentation-marginalised unigrams.

The model: each language gives each piece of a fixed public vocabulary a probability; a word's probability is the sum,
over all ways to cut it into pieces, of the product of its pieces' probabilities, computed by a forward algorithm. A
text's words are its runs of letters, in lower case, behind a word-start mark. The language of the largest posterior wins.

Learning is expectation maximisation over all rows to learn from: tasks count the words of each language in their slice
of the corpus, run forward and backward over each distinct word, and emit the expected counts of pieces, which one
aggregation adds up. What reaches the driver is at most one number for each piece and language. The first round starts
from the vocabulary's own order, which puts frequent pieces first.

Letters that no piece covers have a small probability of their own, the same in every language. Words of any length are
summed whole: sums over long words are scaled down as they grow, and the logarithms of the scales are kept.

One round is made by default: each round reads the corpus once more, and README.md has what a second one changes.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if there is nothing
to learn from; ties go to the language whose name sorts first; rows with a null language teach nothing; rows with a null
id are not held out. Repeated rows count each. Columns other than those named are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import column, documents, fold_of, slices

ROUNDS = 1
UNKNOWN = 1e-7
PRIOR = 0.05
SCALE = 50.0  # each letter's probability is multiplied by this, so that long words don't underflow; it cancels out
KNOWN_WORDS = 200_000
CELLS = 1 << 21  # numbers in each table of a task: of words by languages, and of letters by words by languages
SCALED_EVERY = 32
_MARK = "▁"


@lru_cache(maxsize=2)
def load_pieces(path: str) -> list[str]:
    """The pieces made of letters, with or without the word-start mark, in the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    found = (p for p in pieces if (body := p.removeprefix(_MARK)) and body.isalpha())
    return list(dict.fromkeys(p.lower() for p in found))


def first_probabilities(pieces: list[str]) -> np.ndarray:
    """(pieces, 1): falling with the place in the vocabulary; single letters stand at its end but count as its start."""
    weight = np.array([1.0 / (100 + (0 if len(p) == 1 else i)) for i, p in enumerate(pieces)])
    return (weight / weight.sum())[:, None]


def words_of():
    import regex

    find = regex.compile(r"\p{L}+").findall
    return lambda text: find(text.lower())


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # odd multipliers
_SLOT_BITS = 20


class PieceTable:
    """Finds pieces among many substrings by vector: two hash tables, the second for what collides in the first."""

    def __init__(self, pieces: list[str]):
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_M1) + ord(c) + 1) % 2**64
            keys[i] = h
        self.missing = len(pieces)
        self.keys = np.r_[keys, np.uint64(0)]
        self.tables = []
        rest = np.arange(len(pieces))
        for multiplier in (_M2, _M3):
            table = np.full(1 << _SLOT_BITS, self.missing, np.int32)
            slots = self._slots(keys[rest], multiplier)
            _, first = np.unique(slots, return_index=True)
            table[slots[first]] = rest[first]
            rest = np.delete(rest, first)
            self.tables.append((multiplier, table))
        self.rest = {int(keys[i]): int(i) for i in rest}  # hardly any

    @staticmethod
    def _slots(h: np.ndarray, multiplier: np.uint64) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * multiplier) >> np.uint64(64 - _SLOT_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash's piece, or the number of pieces."""
        (m, table), (m2, table2) = self.tables
        at = table[self._slots(h, m)]
        bad = self.keys[at] != h
        other = table2[self._slots(h, m2)]
        at = np.where(bad, np.where(self.keys[other] == h, other, self.missing), at)
        for key, i in self.rest.items():
            at[h == np.uint64(key)] = i
        return at


@lru_cache(maxsize=2)
def _table(pieces: tuple[str, ...]) -> PieceTable:
    return PieceTable(list(pieces))


class Lattice:
    """Sums over all segmentations of many words together."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.place = {p: i for i, p in enumerate(pieces)}
        self.table = _table(tuple(pieces))
        self.longest = max(map(len, pieces), default=1)
        scaled = probabilities * (SCALE ** np.array([len(p) for p in pieces], float))[:, None]
        self.languages = scaled.shape[1]
        # The last row stands for one unknown letter.
        self.unknown = len(pieces)
        self.p = np.concatenate([scaled, np.full((1, self.languages), UNKNOWN * SCALE)])

    def _arcs(self, words: list[str], n: int):
        """For each end, in order: (start, words that have a piece there or None for all, their pieces)."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        arcs: list = [[] for _ in range(n)]
        h = np.zeros(letters.shape, np.uint64)
        for size in range(1, min(n, self.longest) + 1):  # all places at once
            h = h[: n - size + 1] * _M1 + letters[size - 1 :]
            ids = self.table.find(h)
            if size == 1:
                for i in range(n):
                    arcs[i].append((i, None, ids[i]))  # the number of pieces is the unknown letter's row
                continue
            held = ids != self.table.missing
            for i in np.flatnonzero(held.any(axis=1)).tolist():
                rows = np.flatnonzero(held[i])
                arcs[i + size - 1].append((i, rows, ids[i][rows]))
        return arcs

    def _forward(self, arcs, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each place, and the logarithms of their scales; the last `longest` places share one scale."""
        alpha, shift = (np.zeros((len(arcs) + 1, count, self.languages)) for _ in range(2))
        alpha[0] = 1.0
        for j, row in enumerate(arcs, 1):
            shift[j] = shift[j - 1]
            for i, rows, ids in row:
                if rows is None:
                    alpha[j] += alpha[i] * self.p[ids]
                else:
                    alpha[j][rows] += alpha[i][rows] * self.p[ids]
            if j % SCALED_EVERY == 0:
                near = slice(max(0, j - self.longest + 1), j + 1)
                most = alpha[near].max(axis=0)
                alpha[near] /= most
                shift[near] += np.log(most)
        return alpha, shift

    def _backward(self, arcs, count: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(arcs)
        beta, shift = (np.zeros((n + 1, count, self.languages)) for _ in range(2))
        beta[n] = 1.0
        for j in range(n, 0, -1):  # beta[j] is complete: all arcs that start there end behind it
            if j % SCALED_EVERY == 0:
                near = slice(max(0, j - self.longest), min(n, j + self.longest) + 1)
                most = beta[near].max(axis=0)
                beta[near] /= most
                shift[near] += np.log(most)
                shift[: near.start] = shift[near.start]
            for i, some, ids in arcs[j - 1]:
                if some is None:
                    beta[i] += self.p[ids] * beta[j]
                else:
                    beta[i][some] += self.p[ids] * beta[j][some]
        return beta, shift

    def log_sums(self, words: list[str]) -> np.ndarray:
        """(words, languages): log of the sum over all segmentations, up to a constant of each word."""
        out = np.zeros((len(words), self.languages))
        for n, rows in self._by_length(words):
            group = [words[k] for k in rows.tolist()]
            alpha, shift = self._forward(self._arcs(group, n), len(group))
            out[rows] = np.log(alpha[-1]) + shift[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """(pieces, columns of counts): expected counts of pieces, given how often each word occurs in each language."""
        total = np.zeros((len(self.place) + 1, counts.shape[1]))
        for n, rows in self._by_length(words):
            group = [words[k] for k in rows.tolist()]
            arcs = self._arcs(group, n)
            (alpha, a), (beta, b) = self._forward(arcs, len(group)), self._backward(arcs, len(group))
            weight = counts[rows] / alpha[n]
            pieces, shares = [], []
            for j in range(1, n + 1):
                for i, some, ids in arcs[j - 1]:
                    share = alpha[i] * np.exp(a[i] + b[j] - a[n]) * beta[j] * weight if n >= SCALED_EVERY else alpha[i] * beta[j] * weight
                    pieces.append(ids)
                    shares.append(share * self.p[ids] if some is None else share[some] * self.p[ids])
            at, share = np.concatenate(pieces), np.concatenate(shares)
            for c in range(counts.shape[1]):
                total[:, c] += np.bincount(at, share[:, c], len(total))
        return total[: len(self.place)]

    def _by_length(self, words: list[str]):
        """Groups of words of one length, so many that their lattice stays small."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            rows, most = np.flatnonzero(sizes == n), max(1, min(8192, CELLS // (n * self.languages)))
            for at in range(0, len(rows), most):
                yield n, rows[at : at + most]


def _expecter(path: str, model):
    """Emits language, piece and expected count."""

    def work(batches):
        find, pieces = words_of(), load_pieces(path)
        lattice = Lattice(pieces, first_probabilities(pieces) if model is None else model.value[1])
        names = [] if model is None else model.value[0]
        counts: dict[str, Counter] = {}

        def emit():
            langs = sorted(counts)
            words = sorted(set().union(*counts.values()))
            table = np.array([[counts[g][w] for g in langs] for w in words], float)
            if model is not None:  # a column for each language that the model knows
                full = np.zeros((len(words), len(names)))
                full[:, [names.index(g) for g in langs]] = table
                table, langs = full, names
            found = lattice.expected([_MARK + w for w in words], table)
            piece, lang = np.nonzero(found)
            for at in range(0, len(piece), 1 << 16):
                p, g = piece[at : at + (1 << 16)], lang[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in g.tolist()]), pa.array(p.astype(np.int32)), pa.array(found[p, g])], ["lang", "piece", "n"])

        for batch in slices(batches):
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist()):
                if text and (words := find(text)):
                    counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > KNOWN_WORDS:
                yield from emit()
                counts.clear()
        if counts:
            yield from emit()

    return work


def learn(rows: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From rows (text, lang): language names, probabilities (pieces, languages), log priors by documents."""
    spark, model = rows.sparkSession, None
    shares = rows.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    names = [r["lang"] for r in shares]
    prior = np.log(np.array([r["count"] for r in shares], float) / sum(r["count"] for r in shares)) if shares else np.zeros(0)
    pieces = load_pieces(path)
    p = np.zeros((len(pieces), len(names)))
    for _ in range(rounds if names else 0):
        found = rows.mapInArrow(_expecter(path, model), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(pieces), len(names)), PRIOR)
        counts[found["piece"].to_numpy(), [names.index(g) for g in found["lang"]]] += found["n"].to_numpy()
        p = counts / counts.sum(axis=0)
        model = spark.sparkContext.broadcast((names, p))
    return names, p, prior


def _predictor(path: str, model):
    def work(batches):
        names, p, prior = model.value
        find, lattice = words_of(), Lattice(load_pieces(path), p) if names else None
        place: dict[str, int] = {}
        table = np.zeros((min(2 * KNOWN_WORDS, CELLS // max(1, len(names))), len(names)))
        for batch in slices(batches):
            split = [find(t) if t else [] for t in column(batch, "text").to_pylist()]
            langs, scores = ["und"] * len(split), [0.0] * len(split)
            new = list(set().union(*split).difference(place)) if names else []
            if new:
                if len(place) + len(new) > len(table):
                    place.clear()
                    new = list(set().union(*split))
                    if len(new) > len(table):
                        table = np.zeros((len(new), len(names)))
                table[len(place) : len(place) + len(new)] = lattice.log_sums([_MARK + w for w in new])
                place.update(zip(new, range(len(place), len(place) + len(new))))
            for k, words in enumerate(split):
                if words and names:
                    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    total = table[at].sum(axis=0) + prior
                    best = int(np.argmax(np.round(total, 9)))
                    langs[k] = names[best]
                    scores[k] = float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "held_out"), pa.array(langs), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return work


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def identify(df: DataFrame, model: tuple, path: str, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """id, held_out, lang_pred and score (posterior) of each text, by a model of learn()."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return rows.mapInArrow(_predictor(path, sent), "id long, held_out boolean, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents, learnt from three quarters of them."""
    docs, path = documents(spark, sf_dir), public_vocabulary()
    out = fold_of(F.col("doc_id"), 4) == 2
    model = learn(docs.where(~out & F.col("lang").isNotNull()).select("text", "lang"), path)
    return identify(docs, model, path, held_out=out).withColumnRenamed("id", "doc_id")
