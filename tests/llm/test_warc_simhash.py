import hashlib
import re

import numpy as np
import pytest

from spelunka.llm import common, simhash, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_against_brute_force(spark):
    big = "é" * 600
    pages = [(0, "u", big), (1, "u\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 2000 + FAKE), (8, "u", FAKE * 3), (9, "u", "WARC/1.1\r\n"), (None, "u", big), (2, "u", big), (10, "u", "a\r\n\r\nb"), (11, "u", "z" * 999), (12, "u", "z" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "w" * 300000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, id string")
    found = warc.archived(df.repartition(3)).collect()
    assert all(r.sound for r in found)
    got = sorted(((r.id, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in found), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        last = max((p for p, _, h in pages if h == html and p is not None), default=None) if len(data) >= 1000 else None
        revisit = i is not None and last is not None and i != last
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_ids_of_64_bits(spark):
    big = "y" * 1200
    ids = [-(2**63), -5, 2**53 + 1, 10**18 + 3, 2**63 - 2, 2**63 - 1]
    pages = [(i, "u", big) for i in ids] + [(-7, "u", "a" * 1000), (-9, "u", "a" * 1000), (-1, "u", "small"), (None, "u", big)]
    got = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    want = [(i, 2**63 - 1 if i != 2**63 - 1 else None) for i in ids] + [(-7, None), (-9, -7), (-1, None), (None, None)]
    assert sorted(((r.id, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    """Pages of all sizes; what shares a payload still refers to it; no file holds much more than file_bytes or one page."""
    sizes = [0, 5, 90, 700, 1000, 1000, 5000, 40_000, 300_000, 2_000_000] * 6
    pages = spark.createDataFrame([(i, f"u{i}", "p" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), file_bytes=200_000)
    found = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert len(found) == 60 and {r.id: r.refers_to for r in found} == {i: max(j for j in range(60) if sizes[j] == n) if n >= 1000 and any(sizes[j] == n for j in range(i + 1, 60)) else None for i, n in enumerate(sizes)}
    assert all(r.size <= max(200_000 + 2048 * 600, r.payload_bytes + 1000) for r in found if r.kind == "response")
    assert max(r.size for r in found if r.payload_bytes < 10_000) < 300_000
    assert warc.size_classes(0, 1 << 20) == [(0, 512, 2048)]
    assert [c[2] for c in warc.size_classes(1 << 40, 1 << 26)] == [2048, 128, 8, 1]


@pytest.mark.parametrize("name", ["<urn:page:x1>", "<urn:page:9223372036854775808>", ""])
def test_warc_refuses_what_is_no_id(spark, tmp_path, name):
    (tmp_path / "part-0").write_text(FAKE.replace("<urn:page:999>", name), newline="")
    with pytest.raises(Exception, match="no valid page id"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_chain():
    one = FAKE.encode()
    data = one + one.replace(b"hello", FAKE.encode()).replace(b"Content-Length: 5", b"Content-Length: %d" % len(FAKE), 1) + one
    rows = warc.candidates(data)
    at, nxt = (np.array([r[k] for r in rows]) for k in ("at", "next"))
    assert len(rows) == 4 and warc.reachable(at, nxt, len(data)).tolist() == [True, True, False, True]
    with pytest.raises(warc.WarcError):
        warc.reachable(at, nxt, len(data) + 1)


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot_rows", [common.HOT_ROWS, 1])
def test_simhash_against_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(7)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "É", "x1", "delta,"], 60)) for _ in range(40)]
    texts = [None, "", "  \n", "one", "One two", "a b c", "a b c d", "A b\tc d"] + base + [b + " end" for b in base[:20]] + base[:10] + ["zz " + b for b in base[:15]] + ["w " * 30000]
    got = {r.id: r for r in simhash.near_duplicates(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_finds_every_link(spark):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(20):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 8)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = simhash.link_edges(df)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want = slow_components(fps)
    groups, mine = {}, {}
    for x, r in zip(fps, want):
        groups.setdefault(r, set()).add(x)
        mine.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    one = simhash.forest(np.array(fps, np.uint64)[np.argsort(simhash.gray_rank(np.array(fps, np.uint64)))], np.zeros(len(fps), np.int64), 4)
    assert len(set(one.tolist())) == len(groups)
