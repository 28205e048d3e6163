"""Ranked search against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from twinlake.llm import ranking


def terms(text):
    low = bytes(text or "", "utf-8").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain(docs, items, top=20):
    docs = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in items:
        found = []
        for doc, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort()
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(found[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, ranking.rank(d, q, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = ["the", "of", "The", "ÜBER", "über", "x1"] + [f"w{k}" for k in range(300)]
    weights = [400, 300, 100, 50, 50, 50] + [60 / (k + 1) for k in range(300)]
    make = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randint(0, most)))
    docs = [(k, make(60)) for k in range(300)] + [(k, "of the w3 w3 copy") for k in range(300, 420)]
    return docs, [(k, make(25)) for k in range(40)]


@pytest.mark.parametrize("shape", [{}, {"block": 16, "bundle": 7}, {"block": 50, "owners": ()}, {"block": 64, "owners": (0.01, 0.02, 0.05, 0.2, 0.5), "top": 3}])
def test_any_partitioning_gives_the_plain_result(spark, texts, shape):
    docs, items = texts
    assert run(spark, docs, items, **shape) == plain(docs, items, shape.get("top", 20))


def test_edges(spark, edge, nothing):
    odd = [(1, None), (2, ""), (3, "!!"), (4, "a b"), (4, "a b"), (None, "a b"), (None, "b"), (5, "a\x00B"), (6, "x " * 40_000 + "a"), (7, "ää Ä a_b")]
    items = [(1, "a b b"), (1, "a b b"), (None, "ä ÄÄ b"), (2, None), (3, "..."), (4, "missing")]
    assert run(spark, odd, items, block=2) == plain(odd, items)
    assert run(spark, [], items) == [] and run(spark, odd, []) == [] and run(spark, [(1, "a")], [(1, "a")]) == plain([(1, "a")], [(1, "a")])
    one = spark.createDataFrame([(1, "same text for naïve 42")], "item_id long, text string")
    want = plain([(r.doc_id, r.text) for r in edge.collect()], [(1, "same text for naïve 42")])
    assert sorted(map(tuple, ranking.rank(edge, one).collect()), key=str) == want
    assert ranking.rank(nothing, one).collect() == []


def test_a_stage_drops_only_what_cannot_return():
    """Bundles of one block through three owners, against sums without any pruning; most documents are dropped on the way."""
    rng = random.Random(8)
    for _ in range(30):
        size, stages, top = rng.randint(1, 60), 3, 5
        lists = {t: sorted(rng.sample(range(size), rng.randint(1, size))) for t in range(12)}
        part = {(t, d): rng.randint(1, 9) for t in lists for d in lists[t]}
        own = {t: t % stages for t in lists}
        asked = {t: rng.choice([1, 20, 400]) for t in rng.sample(range(12), 6)}
        bundle = pa.table({
            "grp": [0], "item": [1], "item_id": [1],
            "terms": [[{"owner": own[t], "tid": t, "weight": w, "most": max(part[t, d] for d in lists[t])} for t, w in asked.items()]],
            "docs": pa.array([[]], pa.list_(pa.int32())), "scores": pa.array([[]], pa.list_(pa.int64())), "open": [True], "floor": pa.array([0], pa.int64()),
        })
        for k in range(stages):
            rows = [(d, t, part[t, d]) for t in lists if own[t] == k for d in lists[t]]
            columns = list(zip(*rows)) or [(), (), ()]
            postings = pa.table({"doc": pa.array(columns[0], pa.int32()), "tid": pa.array(columns[1], pa.int64()), "part": pa.array(columns[2], pa.int32())})
            bundle = ranking._stage(k, top, k == stages - 1)(bundle, postings)
        full = Counter()
        for t, w in asked.items():
            for d in lists[t]:
                full[d] += w * part[t, d]
        want = sorted(full.items(), key=lambda x: (-x[1], x[0]))[:top]
        assert list(zip(bundle["docs"][0].as_py(), bundle["scores"][0].as_py())) == want


def test_filter_has_every_term(spark):
    words = [f"t{k}" for k in range(500)] + ["ÜX", "42"]
    bits = ranking._filter(spark.createDataFrame([(w,) for w in words], "text string"))
    h = ranking.words_of(pa.array(words), ranking.ALNUM)
    assert all(bits[w.hashes() >> np.uint64(64 - ranking.FILTER_BITS)].all() for _, _, w in h) and bits.sum() <= len(words)
