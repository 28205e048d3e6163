"""Periodic runs against the definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from twinlake.llm import runs


def plain_runs(w, exponent=4, least=6):
    """Every stretch that keeps a period as far as it can, the smallest one."""
    found, n = [], len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found)


def plain_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found).encode()
    return (doc_id, len(found), *first, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def random_words(rng, most=60):
    n, m = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(m) for _ in range(n)]
    if n > 8 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 5)])
def test_runs_of_words(exponent, least):
    rng = random.Random(exponent)
    for _ in range(1500):
        w = random_words(rng)
        assert runs.runs_of(w, exponent, least) == plain_runs(w, exponent, least), w


def test_suffix_automaton():
    """States and links: the lengths on the way from a prefix to the root are those at which its end positions change."""
    rng = random.Random(1)
    for _ in range(100):
        w = random_words(rng, 20)
        length, link, ends = runs.automaton(w)
        for i, x in enumerate(ends):
            where = [tuple(j for j in range(k - 1, len(w)) if w[j - k + 1 : j + 1] == w[i - k + 1 : i + 1]) for k in range(1, i + 2)]
            want = [k + 1 for k in range(i + 1) if k == i or where[k] != where[k + 1]]
            got = []
            while x > 1:
                got.append(length[x])
                x = link[x]
            assert got[::-1] == want


def test_access_reports_the_last_end_with_the_words_shared():
    rng = random.Random(2)
    for _ in range(150):
        w = random_words(rng, 40)
        length, link, ends = runs.automaton(w)
        paths = runs.Paths([0 if p == 1 else p for p in link])
        for i, x in enumerate(ends):
            got = [(e, length[at]) for e, at in paths.access(x, i)]
            want = {}
            for k in range(1, i + 1):  # the last k words: where did they end last?
                before = [j for j in range(k - 1, i) if w[j - k + 1 : j + 1] == w[i - k + 1 : i + 1]]
                if before:
                    want[before[-1]] = k
            assert sorted(got) == sorted(want.items())


def test_candidates_lose_no_run():
    rng = random.Random(3)
    for _ in range(800):
        rows = [random_words(rng) for _ in range(4)]
        group = np.repeat(np.arange(4), [len(r) for r in rows])
        flat = [x for r in rows for x in r]
        parts = runs.candidates(np.array(flat, np.uint64), group)
        begin = np.cumsum([0, *map(len, rows)])
        for k, row in enumerate(rows):
            for s, size, _ in plain_runs(row):
                assert any(a <= begin[k] + s and begin[k] + s + size <= b for a, b in parts)
        assert all(group[a] == group[b - 1] for a, b in parts)


def test_query(spark, edge, nothing):
    rng = random.Random(4)
    texts = [rng.choice([" ", "\n ", "\t"]).join(f"w{x}é" for x in random_words(rng)) for _ in range(400)]
    texts += ["a " * 3000, "a b c " * 700, ("x y z " * 9 + "q ") * 40, "a\x1cb " * 7]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)] * 2, "doc_id long, text string, period int")
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()))
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs.collect())
    short = edge.filter("coalesce(length(text), 0) < 9000")
    assert sorted(map(tuple, runs.periodic_runs(short).collect()), key=str) == sorted((plain_row(r.doc_id, r.text) for r in short.collect()), key=str)
    assert runs.periodic_runs(edge).count() == edge.count()
    assert runs.periodic_runs(nothing).collect() == []
