import itertools

import numpy as np

from spelunka.llm import langid


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(4)
    pieces = ["a", "b", "ab", "ba", "aba", langid._MARK, langid._MARK + "a", "abab"]
    p = rng.random((len(pieces), 3))
    p /= p.sum(axis=0)
    lattice = langid.Lattice(pieces, p)
    words = [langid._MARK + "".join(x) for n in (1, 2, 5) for x in itertools.product("abz", repeat=n)][:60]

    def slow(word, c):
        if not word:
            return 1.0
        total = 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in lattice.place:
                total += p[lattice.place[word[:k]], c] * slow(word[k:], c)
            elif k == 1:
                total += langid.UNKNOWN * slow(word[1:], c)
        return total

    got = lattice.log_sums(words)
    for i, w in enumerate(words):
        for c in range(3):
            assert abs(got[i, c] - np.log(slow(w, c)) - len(w) * np.log(langid.SCALE)) < 1e-9
    counts = rng.integers(0, 5, (len(words), 3)).astype(float)
    found = lattice.expected(words, counts)
    eps = 1e-6
    for k in range(len(pieces)):  # expected counts are the derivative of the log likelihood by the log probability
        more = p.copy()
        more[k] *= 1 + eps
        diff = (counts * (langid.Lattice(pieces, more).log_sums(words) - got)).sum(axis=0) / np.log1p(eps)
        assert np.allclose(diff, found[k], atol=1e-3)


def slow_sum(word, p, place, unknown):
    """The sum over all segmentations, and each piece's expected count times that sum, by enumeration."""
    if not word:
        return 1.0, {}
    total, pieces = 0.0, {}
    for k in range(1, len(word) + 1):
        piece = word[:k]
        share = p[place[piece]] if piece in place else unknown if k == 1 else None
        if share is None:
            continue
        rest, inner = slow_sum(word[k:], p, place, unknown)
        total += share * rest
        for x, v in inner.items():
            pieces[x] = pieces.get(x, 0.0) + share * v
        if piece in place:
            pieces[piece] = pieces.get(piece, 0.0) + share * rest
    return total, pieces


def test_query_against_brute_force(spark):
    """Learning and prediction of a small table, again in plain Python over all segmentations."""
    docs = [(i, t, g) for i, (t, g) in enumerate([("the cat sat", "en"), ("der hund lag da", "de"), ("the dog and the cat", "en"), ("die katze und der hund", "de"), ("le chat dort", "fr"), ("un chien et le chat", "fr")] * 6)]
    df = spark.createDataFrame([*docs, (100, "the hund chat", None), (101, "Katze dort", None), (102, "12", "en"), (103, None, "en")], "doc_id long, text string, lang string")
    path = langid.public_vocabulary()
    model = langid.learn(df.where("lang is not null").select("text", "lang"), path)
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify(df, model, path).collect()}
    pieces = langid.load_pieces(path)
    place, start = {p: i for i, p in enumerate(pieces)}, langid.first_probabilities(pieces)[:, 0]
    names, prior, p = ["de", "en", "fr"], [12, 14, 12], []
    for g in names:
        counts = np.full(len(pieces), langid.PRIOR)
        for w in (w for _, t, lang in docs if lang == g for w in t.split()):
            total, each = slow_sum(langid._MARK + w, start, place, langid.UNKNOWN)
            for x, v in each.items():
                counts[place[x]] += v / total
        p.append(counts / counts.sum())
    assert model[0] == names and np.allclose(model[1], np.array(p).T, rtol=1e-9)
    for doc, text in [(i, t) for i, t, _ in docs] + [(100, "the hund chat"), (101, "katze dort")]:
        logs = np.array([np.log(prior[k] / 38) + sum(np.log(slow_sum(langid._MARK + w, p[k], place, langid.UNKNOWN)[0]) for w in text.split()) for k in range(3)])
        post = np.exp(logs - logs.max())
        post /= post.sum()
        assert got[doc][0] == names[int(post.argmax())] and abs(got[doc][1] - post.max()) < 1e-9
    assert got[102] == got[103] == ("und", 0.0)


def test_long_words_are_summed_whole():
    """A long word against the same recursion in logarithms; the expected pieces have as many letters as the word."""
    pieces = ["a", "b", "ab", "bab", "aabb", langid._MARK, langid._MARK + "a"]
    p = np.array([[0.2, 0.1], [0.1, 0.2], [0.3, 0.1], [0.1, 0.2], [0.1, 0.1], [0.1, 0.2], [0.1, 0.1]])
    lattice = langid.Lattice(pieces, p)
    for n in (31, 32, 33, 49, 200, 5000):
        word = langid._MARK + ("aabbabz" * n)[:n]
        logs = [np.zeros(2)]
        for j in range(1, len(word) + 1):
            terms = [logs[j - k] + np.log(p[lattice.place[word[j - k : j]]]) for k in range(1, min(j, 4) + 1) if word[j - k : j] in lattice.place]
            if word[j - 1] not in lattice.place:
                terms.append(logs[j - 1] + np.log(langid.UNKNOWN))
            logs.append(np.logaddexp.reduce(terms, axis=0))
        assert np.allclose(lattice.log_sums([word])[0] - len(word) * np.log(langid.SCALE), logs[-1], rtol=1e-10)
        found = lattice.expected([word], np.array([[2.0, 3.0]]))
        letters = (found * np.array([len(x) for x in pieces])[:, None]).sum(axis=0)
        assert np.allclose(letters, (len(word) - word.count("z")) * np.array([2.0, 3.0]))


def test_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op4_langid(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.97
    edge = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "fr"), (None, "hello", "en"), (5, "z" * 100000, None), (6, "hello", "en"), (6, "hello", "en"), (7, "bonjour éé", "fr")], "doc_id long, text string, lang string")
    path = langid.public_vocabulary()
    model = langid.learn(edge.where("lang is not null").select("text", "lang"), path, rounds=2)
    found = {r.id: r for r in langid.identify(edge, model, path).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[6].lang_pred == "en" and found[7].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = langid.learn(edge.limit(0).select("text", "lang"), path)
    assert {r.lang_pred for r in langid.identify(edge, empty, path).collect()} == {"und"}
