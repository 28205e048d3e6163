"""Operators over whole corpora, against brute force."""

import collections
import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.llm import common, components, crf, decontam, minmax, mixing, suffix, toxicity

UP = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus(seed=1, n=80):
    """Random texts with exact copies, near copies of several strengths, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.3:
            words[5:5] = passage
        texts.append(words)
    for _ in range(n):
        words = list(rng.choice(texts))
        for _ in range(rng.randint(0, 5)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        texts.append(words)
    return [" ".join(w) for w in texts] + [None, "", " ", "a b", "A  b", "a"]


def sets_of(texts, k):
    out = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().translate(UP).split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def groups_of(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


# ------------------------------------------------------------------ near duplicates


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    texts = corpus(k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = sets_of(texts, k)
    want = groups_of(sets, 80)
    rows = minmax.near_duplicates(df, k=k, percent=80).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(texts)


def test_near_duplicate_edge_cases(edge, nothing):
    rows = minmax.near_duplicates(edge, k=5).collect()
    assert len(rows) == 13 and minmax.near_duplicates(nothing, k=5).count() == 0
    got = {r.doc_id: r.component_id for r in rows}
    assert got[4] == 3 and got[6] == 5 and got[8] == 7 and got[0] == 0 and got[2] == 2


def test_near_duplicates_of_rows_with_the_same_id(spark):
    """An id with several texts is one document, linked by any of them; repeats of a row are copies. Against all pairs."""
    rng = random.Random(9)
    texts = corpus(9, 40)
    rows = [(rng.randrange(45), t) for t in texts] + [(i, t) for i, t in enumerate(texts[:5]) for _ in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, root = sets_of([t for _, t in rows], 5), {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for x in sets:
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(rows[x][0]), find(rows[y][0])
                root[max(a, b)] = min(a, b)
    got = minmax.near_duplicates(df, k=5, percent=80).collect()
    assert len(got) == len(rows) and all(r.component_id == find(r.doc_id) for r in got)
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(sets[n])) for n, (i, _) in enumerate(rows))


def test_repeats_of_linked_rows_are_compared_once(spark):
    """600 and 600 repeats of two linked rows: the join of their sets has one row, not 360,000."""
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*words[: 59 - n], *("x" * n)])) for n in range(2) for _ in range(600)]
    seen = []
    plain = minmax.confirmed
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def counted(pairs, sets, percent):
        seen.append((pairs.count(), sets.count()))
        return plain(pairs, sets, percent)

    minmax.confirmed = counted
    try:
        got = minmax.near_duplicates(df, k=5, percent=80).collect()
    finally:
        minmax.confirmed = plain
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 0)} and len(got) == 1200 and seen[0] == (1, 2)


def test_min_max_estimates_without_bias():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    values = np.concatenate([a, b])
    s = minmax.min_max(values, np.array([0, len(a), len(values)]), 2000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.03


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.components(df).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if x != 7}
    assert components.components(df.limit(0)).count() == 0


def test_later_links_merge_components(spark):
    """Links between components, or with ids of no component, give what all links at once give."""
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    label = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20, 30: 30, 31: 30, 5: 5, 40: 40, 41: 41}
    later = [(3, 11), (5, 21), (40, 41), (21, 5), (11, 10)]
    one = spark.createDataFrame(first, "a long, b long")
    by_label = spark.createDataFrame([(label[a], label[b]) for a, b in later], "a long, b long")
    got = components.merged(components.components(one), by_label)
    both = components.components(spark.createDataFrame(first + later, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, both.collect()))
    assert {r.component for r in got.filter("id in (10, 11)").collect()} == {1}
    assert {r.component for r in got.filter("id in (20, 21)").collect()} == {5}


# ------------------------------------------------------------------ repeats


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        spans = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(d) else 0
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 120])
def test_repeats_against_all_substrings(spark, anchor_bytes):
    texts = corpus(8, 40) + ["ab" * 200, "é" * 100, "x" * 40, "x" * 41]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffix.remove_repeats(df, length=40, gram=9, anchor_bytes=anchor_bytes, keep_bytes=True).collect()
    want = plain_removal(texts, 40)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert len(r.kept) == r.n_bytes - r.n_removed


def plain_maximal_repeats(texts, length):
    """{(bytes, doc, start)}: common prefixes of neighbours in suffix order, found everywhere, if no byte precedes all."""
    data = [(t or "").encode() for t in texts]
    suffixes = sorted(d[i:] for d in data for i in range(len(d) - length + 1))
    strings = {a[: suffix._common(a, b)] for a, b in zip(suffixes, suffixes[1:])}
    out = set()
    for w in strings:
        if len(w) >= length:
            at = [(i, j) for i, d in enumerate(data) for j in range(d.find(w), len(d) - len(w) + 1) if j >= 0 and d.startswith(w, j)]
            before = {data[i][j - 1] if j else None for i, j in at}
            if len(before) > 1 or None in before:
                out |= {(w, i, j) for i, j in at}
    return out


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 120])
def test_maximal_repeats_against_all_substrings(spark, nothing, anchor_bytes):
    texts = corpus(8, 40) + ["ab" * 60, "é" * 40, "x" * 40, "x" * 43, "x" * 40, "ab" * 40 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffix.maximal_repeats(df, length=40, gram=9, anchor_bytes=anchor_bytes).collect()
    data = [(t or "").encode() for t in texts]
    got = [(data[r.doc_id][r.start : r.start + r.length], r.doc_id, r.start) for r in rows]
    assert len(got) == len(set(got)) and set(got) == plain_maximal_repeats(texts, 40)
    assert len({w for w, *_ in got}) == len({r.repeat_id for r in rows}) and max(r.length for r in rows) > 80
    covered = [np.zeros(len(d), bool) for d in data]
    for w, doc, start in got:
        covered[doc][start : start + len(w)] = True
    want = plain_removal(texts, 40)
    assert [int(c.sum()) for c in covered] == [n for _, n, *_ in want]  # what removal takes out
    assert suffix.maximal_repeats(nothing).count() == 0


def test_repeat_edge_cases(edge, nothing):
    rows = edge.select("doc_id", "text").collect()
    got = suffix.remove_repeats(edge, length=20, gram=7, anchor_bytes=4000).collect()
    want = sorted((repr(r.doc_id), *w) for r, w in zip(rows, plain_removal([r.text for r in rows], 20)))
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    whole = {r.doc_id: r for r in suffix.remove_repeats(edge, length=200).collect()}
    assert whole[7].n_removed == whole[7].n_bytes and whole[0].n_bytes == 0 and suffix.remove_repeats(nothing).count() == 0


def test_repeats_of_rows_without_or_with_the_same_id(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    rows = [(None, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[3]), (None, "x" + texts[1][50:] + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.remove_repeats(df, length=60, gram=11).collect()
    want = sorted((repr(i), *w) for (i, _), w in zip(rows, plain_removal([t for _, t in rows], 60)))
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed > 0 for r in got) == 6


def test_many_repeats_of_a_row(spark):
    """Equal rows, with one id or none, are searched as one row; texts that share a passage with them are found."""
    rng = random.Random(12)
    long, other = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    texts = [(1, long)] * 4000 + [(None, other)] * 4000 + [(2, "x" + long[50:150] + "y"), (3, other[:70] + long[:20]), (4, "alone"), (5, "tiny"), (5, "tiny"), (6, "")] + [(7, "z" * 59)] * 2
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in suffix.remove_repeats(df, length=60, gram=11).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert {k: (len(v), set(v)) for k, v in got.items()} == {
        1: (4000, {(400, 400, 1)}), None: (4000, {(400, 400, 1)}), 2: (1, {(102, 100, 1)}), 3: (1, {(90, 70, 1)}), 4: (1, {(5, 0, 0)}), 5: (2, {(4, 0, 0)}), 6: (1, {(0, 0, 0)}), 7: (2, {(59, 0, 0)}),
    }


def shuffle_files(spark):
    """The names of the shuffle files on this machine's disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files.mkString(" ")))


def test_tables_of_steps_leave_no_shuffle_files(spark):
    setting = spark.conf.get(common.FILE_CLEANUP)
    dealt = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    tables = common.written(dealt), common.Scratch(spark).written(dealt), common.Scratch(spark).written(dealt, "k")
    for _ in range(50):  # Spark deletes them in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and spark.conf.get(common.FILE_CLEANUP) == setting
    assert [df.count() for df in (*tables, dealt)] == [7] * 4  # the frame itself can be used on


def test_anchors_go_before_texts_are_shuffled(spark, monkeypatch):
    """While contexts are cut out of the texts, only the runs of repeated anchors are on disk beside them."""
    folder = Path(common.shared_dir(spark).removeprefix("file://"), "tables")
    before, there, contexts = set(folder.glob("*")), [], suffix._contexts

    def watched(rows, length):
        tables = set(folder.glob("*")) - before
        there.append(([spark.read.parquet(str(t)).columns for t in tables], rows.columns))
        return contexts(rows, length)

    monkeypatch.setattr(suffix, "_contexts", watched)
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, text), (2, "x" + text), (3, "alone")], "doc_id long, text string")
    rows = suffix._rows(df, "doc_id", "text")
    assert suffix.repeated_ranges(rows, length=60, gram=11).count() == 2
    assert there == [([["k1", "k2", "runs"]], ["k1", "k2", "text", "runs"])]


def test_suffix_array_and_intervals():
    rng = random.Random(3)
    for _ in range(60):
        data = np.array([rng.choice(b"ab") for _ in range(rng.randint(30, 120))], np.uint8)
        depth = rng.randint(1, 25)
        starts = np.arange(len(data) - depth + 1)
        order, lcp = suffix.suffix_array(data, starts, depth)
        keys = [bytes(data[i : i + depth]) for i in starts]
        assert [keys[i] for i in order] == sorted(keys)
        for k in range(1, len(order)):
            a, b = keys[order[k - 1]], keys[order[k]]
            assert lcp[k] == next((n for n in range(depth) if a[n] != b[n]), depth)
        least = rng.randint(1, max(1, depth - 1))
        want = set()
        for i in range(len(order)):
            low = depth
            for j in range(i + 1, len(order)):
                low = min(low, int(lcp[j]))
                if low < least:
                    break
                if (i == 0 or lcp[i] < low) and (j == len(order) - 1 or lcp[j + 1] < low):
                    want.add((low, i, j))
        assert set(zip(*(x.tolist() for x in suffix.lcp_intervals(lcp, least)))) == want
        depths, first, last, parent, of_place = suffix.interval_tree(lcp, least)
        for x, (d, a, b) in enumerate(zip(depths, first, last)):  # the parent is the smallest interval around
            around = [(e - c, y) for y, (c, e) in enumerate(zip(first, last)) if c <= a and b <= e and y != x]
            assert parent[x] == (min(around)[1] if around else -1)
            assert all((of_place[k] == x) == (lcp[k] == d) or of_place[k] != x for k in range(a + 1, b + 1)) and any(of_place[k] == x for k in range(a + 1, b + 1))


def test_suffixes_of_unequal_length_and_nul_bytes():
    rng = random.Random(9)
    for _ in range(80):
        data = np.array([rng.choice(b"\0\0\0ab") for _ in range(rng.randint(1, 60))], np.uint8)
        starts = np.array(sorted(rng.choices(range(len(data)), k=rng.randint(1, 30))))
        sizes = np.array([rng.randint(0, len(data) - i) for i in starts])
        order, lcp = suffix.suffix_array(data, starts, sizes)
        keys = [bytes(data[i : i + n]) for i, n in zip(starts, sizes)]
        assert [keys[i] for i in order] == sorted(keys)
        for k in range(1, len(order)):
            a, b = keys[order[k - 1]], keys[order[k]]
            assert lcp[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


def test_maximal_depths_against_all_intervals():
    rng = random.Random(4)
    for _ in range(80):
        data = np.array([rng.choice(b"ab") for _ in range(rng.randint(5, 60))], np.uint8)
        starts = np.arange(1, len(data))
        order, lcp = suffix.suffix_array(data, starts, len(data) - starts)
        left, outer = data[starts[order] - 1], np.array([rng.random() < 0.1 for _ in order])
        least = rng.randint(1, 6)
        want = [0] * len(order)
        for d, a, b in zip(*(x.tolist() for x in suffix.lcp_intervals(lcp, least))):
            if len(set(left[a : b + 1])) > 1 or outer[a : b + 1].any():
                for k in range(a, b + 1):
                    want[k] = max(want[k], d)
        assert suffix.maximal_depths(lcp, left, outer, least).tolist() == want


def test_removal_goes_through_the_stack_scan(spark, monkeypatch):
    """The repeats of one anchor's contexts are nested and deeper than the least length."""
    seen = []
    plain = suffix.interval_tree

    def watched(lcp, least):
        out = plain(lcp, least)
        seen.append((int(out[0].max()) if len(out[0]) else 0, int((out[3] >= 0).sum())))
        return out

    monkeypatch.setattr(suffix, "interval_tree", watched)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(500))
    texts = [base[:k] + "#" + str(k) + base[k:] for k in range(0, 500, 9)]
    raw = [t.encode() for t in texts]
    first, anchor, context = [], [], []
    for d in raw:
        row, a, b, hashes = suffix.anchor_runs(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 40, 9)
        for x, y, h in zip(a.tolist(), b.tolist(), hashes.view(np.int64).tolist()):
            anchor.append(h)
            context.append(d[x - 1 : y + 40] if x else bytes([suffix.START]) + d[: y + 40])
    order = np.argsort(anchor, kind="stable")
    joined = [context[i] for i in order]
    n = len(order)
    suffix.scan_contexts(np.array(anchor)[order], np.arange(n), np.ones(n, int), np.full(n, -1), np.frombuffer(b"".join(joined), np.uint8), np.cumsum([0, *map(len, joined)]), 40, False)
    assert seen[0][0] > 40 and seen[0][1] > 0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, length=40, gram=9).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 40)


# ------------------------------------------------------------------ decontamination


def benchmark(spark, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40))).capitalize() + ". " + " ".join(rng.choice(words) for _ in range(7)) + ".") for i in range(40)]
    return items, words, spark.createDataFrame([*items, (100, None), (101, ""), (102, items[3][1])], "item_id long, text string")


def test_wand_retrieves_what_all_scores_give(spark):
    _, _, df = benchmark(spark)
    index = decontam.build_index(df)
    rng = random.Random(1)
    for _ in range(200):
        terms = rng.sample(range(len(index.top)), rng.randint(1, 120))
        threshold = rng.choice([0.02, 0.05, 0.1, 0.3])
        scores = collections.Counter()
        for t in terms:
            for item, impact in zip(*index.postings[t]):
                scores[item] += impact
        want = {i: s for i, s in scores.items() if s >= threshold - 1e-9}
        assert dict(index.search(terms, threshold)) == pytest.approx(want)


def test_decontamination_against_all_passages(spark, edge, nothing):
    items, words, bench = benchmark(spark)
    rng = random.Random(2)
    docs, planted = [], {}
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            item = rng.choice(items)
            at = rng.randint(0, len(body))
            body[at:at] = [item[1].upper() if i % 2 else item[1]]
            planted[i] = item[0]
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    rows = decontam.contaminated(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    index = decontam.build_index(bench)
    want = set()
    for i, text in docs:  # every passage, every item, all scores
        (w,) = decontam._hashes([text])
        for first in range(0, max(1, -(-len(w) // index.stride) - 1) * index.stride, index.stride):
            passage = w[first : first + 2 * index.stride]
            _, terms = index.lookup(np.unique(passage))
            scores = collections.Counter()
            for t in terms:
                for item, impact in zip(*index.postings[t]):
                    scores[item] += impact
            for item, s in scores.items():
                if s >= decontam.THRESHOLD and decontam.overlap(index.questions[item], passage) >= 0.8 and decontam.overlap(index.answers[item], passage) >= 0.5:
                    want.add((i, index.ids[item]))
    assert got == want and {(i, j) for i, j in planted.items()} <= got
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == set(range(120)) - set(planted)
    assert decontam.contaminated(edge, bench).count() == 0 and decontam.drop_contaminated(edge, bench).count() == 13
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.drop_contaminated(df, bench.limit(0)).count() == 120


def test_odd_items(spark, edge):
    text = "what is the capital of the far away land. it is the old town by the sea"
    items = spark.createDataFrame([("a", text), ("a", None), (None, text), ("b", "one"), ("c", "one two three four"), ("d", " ")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "he said: " + text.upper() + " and so on"), (2, "one"), (3, "one two three four"), (None, text)], "doc_id long, text string")
    rows = decontam.contaminated(docs, items).collect()
    short = [r for r in rows if r.whole_runs]
    assert sorted((r.doc_id, r.item_id, r.whole_runs, r.passages, r.score) for r in short) == [(2, "b", 1, 0, 1.0), (3, "b", 1, 0, 1.0), (3, "c", 1, 0, 1.0)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items, short=True).collect()] == []
    assert sorted((repr(r.doc_id), repr(r.item_id)) for r in rows if not r.whole_runs) == [("1", "'a'"), ("1", "None"), ("None", "'a'"), ("None", "None")]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [2, 3]
    assert decontam.drop_contaminated(edge, items).count() == 13


def test_short_items_against_word_lists(spark):
    rng = random.Random(4)
    words = ["a", "B", "ç", "dd", "e5"]
    items = [(f"i{n}", " ".join(rng.choices(words, k=rng.randint(1, 4)))) for n in range(60)] + [(None, "a, A!"), ("i0", "dd")]
    docs = [(n, rng.choice([" ", "\n", "-"]).join(rng.choices(words, k=rng.randint(0, 30)))) for n in range(200)] + [(900, None), (901, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: re.findall(r"[a-zç0-9]+", (t or "").lower())
    want = []
    for i, text in docs:
        w = split(text)
        for item, t in items:
            k = split(t)
            if n := sum(w[p : p + len(k)] == k for p in range(len(w) - len(k) + 1)):
                want.append((i, repr(item), n))
    assert sorted((r.doc_id, repr(r.item_id), r.whole_runs) for r in decontam.contaminated(df, bench).collect()) == sorted(want)
    assert decontam.drop_contaminated(df, bench).count() == len(docs)


# ------------------------------------------------------------------ language


def test_expected_transitions_against_pairs():
    rng = np.random.default_rng(3)
    n, k = 400, 5
    scores, start, move = rng.normal(size=(n, k)), rng.normal(size=k), rng.normal(size=(k, k))
    begins = rng.random(n) < 0.1
    begins[0] = True
    _, forward, behind = crf.forward_backward(scores, begins, start, move)
    want = np.zeros((k, k))
    for t in range(1, n):
        if not begins[t]:
            pair = forward[t - 1][:, None] * np.exp(move) * behind[t][None, :]
            want += pair / pair.sum()
    assert np.allclose(crf.expected_transitions(forward, behind, begins, move), want)


def test_short_and_long_chains_agree(monkeypatch):
    rng = np.random.default_rng(4)
    n, k = 900, 3
    scores, start, move = rng.normal(size=(n, k)), rng.normal(size=k), rng.normal(size=(k, k))
    begins = np.zeros(n, bool)
    begins[[0, 1, 2, 50, 260, 500, 740]] = True
    short = crf.forward_backward(scores, begins, start, move)
    monkeypatch.setattr(crf, "SHORT_CHAIN", 0)
    for a, b in zip(short, crf.forward_backward(scores, begins, start, move)):
        assert np.allclose(a, b)


def test_pieces_of_the_training_do_not_change_it(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ka", "ro", "shi"] if i % 2 else ["ung", "ver", "ich"]) for _ in range(30)) for i in range(20)]
    monkeypatch.setattr(crf, "TRAIN_WORDS", 600)
    whole = crf.train(texts, ["ab"[i % 2] for i in range(20)])
    monkeypatch.setattr(crf, "TRAIN_CELLS", 200)
    parts = crf.train(texts, ["ab"[i % 2] for i in range(20)])
    assert np.allclose(whole.table, parts.table, atol=1e-2) and np.allclose(whole.transition, parts.transition, atol=1e-2)


def test_many_labels_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = random.Random(8)
    monkeypatch.setattr(crf, "EPOCHS", 1)
    monkeypatch.setattr(crf, "TRAIN_WORDS", 60_000)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(40)) for _ in range(200)]
    tracemalloc.start()
    crf.train(texts, [f"l{i % 100}" for i in range(200)])
    assert tracemalloc.get_traced_memory()[1] < 900 << 20  # a cubic array would have 2.4 GB
    tracemalloc.stop()


def test_labelling_in_pieces_changes_nothing(monkeypatch):
    """Pieces that end inside of texts and at their ends, against one piece; with 256 labels, in bounded memory."""
    import tracemalloc

    import pyarrow as pa

    rng, random_ = np.random.default_rng(3), random.Random(3)
    texts = [" ".join("".join(random_.choice("abcdef") for _ in range(3)) for _ in range(n)) for n in (0, 7, 512, 505, 1, 2600, 0, 30)]
    ((_, _, words),) = list(common.words_of(pa.array(texts), common.ALPHA, 1 << 40))
    model = crf.Crf(["a", "b", "c"], rng.normal(size=(1 << crf.TABLE_BITS, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    whole = model.document_marginals(words)
    for cells in (1, 3 * 519, 3 * 1024):
        monkeypatch.setattr(crf, "LABEL_CELLS", cells)
        assert np.allclose(model.document_marginals(words), whole, atol=1e-5)
    assert np.allclose(whole.sum(1), words.counts > 0)
    monkeypatch.setattr(crf, "LABEL_CELLS", 1 << 20)
    k = 256
    model = crf.Crf([f"l{i}" for i in range(k)], np.zeros((1 << crf.TABLE_BITS, k), np.float32), np.zeros(k, np.float32), np.eye(k, dtype=np.float32))
    ((_, _, words),) = list(common.words_of(pa.array([" ".join(texts) * 20]), common.ALPHA, 1 << 40))
    tracemalloc.start()
    assert np.allclose(model.document_marginals(words), 1 / k, atol=1e-4)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # words x labels alone are 18 million cells, of which several arrays are needed
    tracemalloc.stop()


def test_a_label_of_long_texts_is_learned(spark):
    rng = random.Random(6)
    make = lambda syllables, n: " ".join("".join(rng.choice(syllables) for _ in range(2)) for _ in range(n))
    rows = [(i, make(["ka", "ro", "shi"], 30), "short") for i in range(30)] + [(100 + i, make(["ung", "ver", "ich"], 6000), "long") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in crf.identify(df, crf.fit(df)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_identification_against_a_plain_version(spark):
    """Features, emissions, marginals and the choice of the label, word by word."""
    rng = random.Random(12)
    vocabulary = {"a": ["karo", "shita", "naïve", "rota"], "b": ["ungver", "ichung", "über", "verich"]}
    rows = [(i, " ".join(rng.choice(vocabulary["ab"[i % 2]]) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(1, 25))), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame([*rows, (70, "karo ungver shita über karo", None), (71, "12 !", None)], "doc_id long, text string, lang string")
    model = crf.fit(df)

    def slot(kind, value):
        x = (value * 64 + kind) % 2**64
        return int(common.mix(np.array([x], np.uint64))[0] >> np.uint64(64 - crf.TABLE_BITS))

    def number(piece):
        value = 0
        for byte in piece:
            value = value * 257 + byte + 1
        return value

    def emission(word):
        slots = [slot(1, int(common.word_hash([word])[0]))]
        for n in range(1, min(crf.AFFIX, len(word)) + 1):
            slots += [slot(8 * n + 2, number(word[:n])), slot(8 * n + 3, number(word[-n:]))]
        for n in crf.GRAMS:
            slots += [slot(40 + n, number(word[i : i + n])) for i in range(len(word) - n + 1)]
        return model.table[slots].sum(0) / np.sqrt(len(slots))

    for r in crf.identify(df, model).collect():
        text = {i: t for i, t, _ in rows}.get(r.doc_id, "karo ungver shita über karo")
        words = plain_words(text)
        if r.doc_id == 71:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        e = np.exp(np.array([emission(w) for w in words], float))
        a, p = np.exp(model.transition.astype(float)), np.exp(model.start.astype(float))
        forward, backward = [p * e[0]], [np.ones(2)]
        for t in range(1, len(words)):
            forward.append(forward[-1] / forward[-1].sum() @ a * e[t])
        for t in range(len(words) - 1, 0, -1):
            v = a @ (e[t] * backward[0])
            backward.insert(0, v / v.sum())
        m = np.array(forward) * np.array(backward)
        mean = (m / m.sum(1, keepdims=True)).mean(0)
        assert r.lang_pred == model.labels[int(mean.argmax())] and r.score == pytest.approx(mean.max(), abs=1e-3)


def test_forward_backward_against_plain_recursion():
    rng = np.random.default_rng(0)
    n = 1500
    scores, start, move = rng.normal(size=(n, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    begins = rng.random(n) < 0.02
    begins[0] = True
    got, _, _ = crf.forward_backward(scores, begins, start, move)
    e, a, p = np.exp(scores), np.exp(move), np.exp(start)
    at = [*np.flatnonzero(begins), n]
    for x, y in zip(at, at[1:]):
        forward, backward = [p * e[x]], [np.ones(3)]
        for t in range(x + 1, y):
            forward.append((forward[-1] / forward[-1].sum()) @ a * e[t])
        for t in range(y - 1, x, -1):
            v = a @ (e[t] * backward[0])
            backward.insert(0, v / v.sum())
        want = np.array(forward) * np.array(backward)
        assert np.allclose(got[x:y], want / want.sum(1, keepdims=True))


def test_language_of_held_out_and_mixed_text(spark, edge, nothing):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "ro", "shi", "ta"], "bb": ["ung", "ver", "ich", "schl"], "cc": ["é", "eau", "tion", "qui"]}
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang if i % 10 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = crf.fit(df, per_label=60)
    got = {r.doc_id: r for r in crf.identify(df, model).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i, x in truth.items() if x]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, "karoshi taka roshi kata " * 3 + "ungver ichver " * 2)], "doc_id long, text string")
    r = crf.identify(mixed, model).first()
    assert r.lang_pred == "aa" and r.mixed > 0.1
    edges = {r.doc_id: r for r in crf.identify(edge, model).collect()}
    assert [edges[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4 and edges[0].score == 0 and edges[3].lang_pred != "und"
    assert crf.identify(nothing, model).count() == 0
    none = crf.fit(nothing.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in crf.identify(edge, none).collect()} == {"und"}


# ------------------------------------------------------------------ toxicity


def kadane(scores):
    """(sum, first, last) of the best run; the earliest and shortest of equals."""
    best, here, start = (0.0, 0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best[0] + 1e-9:
            best = (here, start, i)
    return best


def plain_maximal(scores):
    """All maximal segments by definition: the best one, then those left and right of it."""
    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        total, i, j = kadane(scores[lo:hi])
        if total > 1e-12:
            out.append((lo + i, lo + j, total))
            todo += [(lo, lo + i), (lo + j + 1, hi)]
    return sorted(out)


def plain_words(text):
    return re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().translate(UP))


class PlainToxicity:
    """The fit and the score, word by word."""

    def __init__(self, sample):
        folds = [[r for r in sample if r.fold == k] for k in (0, 1)]
        halves = all({r.toxic for r in f} == {0, 1} for f in folds)
        self.odds = self.count(sample)
        other = [self.count(folds[1 - k]) if halves else self.odds for k in (0, 1)]
        judged = [(r.toxic, *self.segments(r.text, other[r.fold])) for r in sample]
        best = np.array([max((s for *_, s in seg), default=0.0) for y, seg, _ in judged if y == 0])
        n = np.array([max(1, words) for y, _, words in judged if y == 0])
        grid = np.arange(0.001, 20, 0.001)
        likelihood = [np.log(x) - x * best.mean() - np.log(np.mean(n * np.exp(-x * best))) for x in grid]
        self.decay = float(grid[int(np.argmax(likelihood))])
        self.scale = len(best) / np.sum(n * np.exp(-self.decay * best))
        x, y = np.array([self.together(seg, words) for _, seg, words in judged]), np.array([y for y, *_ in judged])
        self.loss = lambda b, w: np.logaddexp(0, b + w * x).sum() - (y * (b + w * x)).sum() + 0.05 * (b * b + w * w)
        self.base, self.slope = min(((b, w) for b in np.arange(-8, 3, 0.1) for w in np.arange(0, 3, 0.02)), key=lambda c: self.loss(*c))

    def units(self, word):
        lo, hi = toxicity.LEAST_PREFIX, toxicity.LONGEST_PREFIX
        return [word[:n] for n in range(lo, min(hi, len(word)) + 1)] + [(word,)]

    def count(self, rows):
        seen = [collections.Counter(), collections.Counter()]
        for r in rows:
            seen[r.toxic].update({u for w in plain_words(r.text) for u in self.units(w)})
        share = sum(r.toxic for r in rows) / len(rows)
        p = {}

        def probability(chain):
            if not chain:
                return share
            u = chain[-1]
            if u not in p:
                t, c = seen[1][u], seen[0][u]
                above = probability(chain[:-1])
                m, n1 = toxicity.PRIOR_TEXTS, sum(r.toxic for r in rows)
                low, high = m * share / (len(rows) - n1 + m), (n1 + m * share) / (n1 + m)
                p[u] = min(max((t + m * above) / (t + c + m), low), high) if t + c >= toxicity.MIN_TEXTS else above
            return p[u]

        def odds(word):
            q = probability(self.units(word))
            return np.log(q / (1 - q)) - np.log(share / (1 - share))

        return odds

    def segments(self, text, odds):
        words = plain_words(text)
        known = {w: odds(w) - toxicity.COST for w in set(words)}
        return plain_maximal([known[w] for w in words]), len(words)

    def together(self, segments, n):
        x = sorted((self.decay * s - np.log(self.scale * max(1, n)) for *_, s in segments), reverse=True)
        out, total, x = [], 0.0, x[:1] + [v for v in x[1:] if v > -np.log(toxicity.E_VALUE)]
        for r, v in enumerate(x, 1):
            total += v
            out.append(total if r == 1 else total - (r - 1) * np.log(2 * total) + 2 * sum(np.log(k) for k in range(1, r + 1)) - np.log(r))
        return float(np.clip(max(out), toxicity.LOW, toxicity.HIGH)) if out else toxicity.LOW

    def score(self, text):
        segments, n = self.segments(text, self.odds)
        return 1 / (1 + np.exp(-(self.base + self.slope * self.together(segments, n))))


def test_maximal_segments_by_definition():
    rng = random.Random(7)
    for _ in range(200):
        scores = [rng.choice([-1, -1, 1]) * rng.uniform(0.1, 3) for _ in range(rng.randint(1, 60))]
        got = toxicity.maximal_segments(np.array(scores))
        want = plain_maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])
    assert toxicity.maximal_segments(np.zeros(0)) == []


def toxic_corpus(spark, n=600):
    rng = random.Random(11)
    plain, bad = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)], ["vile", "awful", "scummy"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ness", "ly"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs, labels, spark.createDataFrame([*labels, (None, 1), (1, None), (2, 5)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, edge, nothing):
    docs, labels, marks = toxic_corpus(spark)
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    right = sum((got[i].score >= 0.3) == bool(y) for i, y in labels)
    assert right / len(labels) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    assert any(r.passages for r in got.values())
    assert toxicity.drop_toxic(docs, model, threshold=0.3).count() == sum(r.score < 0.3 for r in got.values())
    assert toxicity.score_toxicity(edge, model).count() == 13 and toxicity.score_toxicity(nothing, model).count() == 0
    new = spark.createDataFrame([(1, "vilest vilest gaga"), (2, "gaga gaga gaga")], "doc_id long, text string")  # a form never seen
    a, b = sorted(toxicity.score_toxicity(new, model).collect())
    assert a.score > 0.5 > 0.3 > b.score and a.passages == "0:1:" + a.passages.rpartition(":")[2]


def test_odds_stay_finite_however_many_texts():
    n = 8
    unit = np.arange(1, n + 1).astype(np.uint64)
    units, odds = toxicity.unit_odds(unit, unit - np.uint64(1), np.arange(3, n + 3), np.full(n, 10**6), np.zeros(n, int), 10**6, 10**7)
    assert len(units) == n and np.isfinite(odds).all() and 14 < odds.min() <= odds.max() < 16


def test_fit_law_and_curve_against_a_plain_version(spark):
    docs, _, marks = toxic_corpus(spark, 360)
    model = toxicity.fit(docs, marks)
    plain = PlainToxicity(toxicity.labelled_sample(docs, marks).collect())
    assert model.decay == pytest.approx(plain.decay, abs=0.002) and model.scale == pytest.approx(plain.scale, rel=0.05)
    assert model.base == pytest.approx(plain.base, abs=0.2) and model.slope == pytest.approx(plain.slope, abs=0.05)
    assert plain.loss(model.base, model.slope) <= plain.loss(plain.base, plain.slope) + 1e-3
    plain.decay, plain.scale, plain.base, plain.slope = model.decay, model.scale, model.base, model.slope
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(rows[r.doc_id].score == pytest.approx(plain.score(r.text)) for r in docs.collect())


def test_scattered_toxic_words_count_together(spark):
    unit = np.sort(common.word_hash([b"vil"]))
    model = toxicity.Model(unit, np.array([5.5 + toxicity.COST]), 1.58, 0.0025)
    model.base, model.slope = -5.26, 0.45
    long = ["plain"] * 2000
    rows = [(0, long), (1, ["vile", *long[1:]]), (2, [*(["plain"] * 199 + ["vile"]) * 10])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert got[0].score < got[1].score < 0.2 and got[2].score > 0.9 and len(got[2].passages.split(",")) == 10
    assert {r.doc_id for r in toxicity.drop_toxic(df, model, threshold=0.3).collect()} == {0, 1}


def test_no_evidence_drops_nothing(spark, edge):
    labels = spark.createDataFrame([(3, 5), (None, 1), (4, None)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0), spark.createDataFrame([(3, 1)], "doc_id long, toxic int")):
        model = toxicity.fit(edge, marks)
        assert toxicity.drop_toxic(edge, model, threshold=0.3).count() == 13
        assert {round(r.score, 6) for r in toxicity.score_toxicity(edge, model).collect()} == {toxicity.NO_EVIDENCE}


# ------------------------------------------------------------------ mixing


def test_mixture_meets_weights_limits_and_blocks(spark, edge, nothing):
    rng = random.Random(13)
    rows = [(i, "big" if i % 3 else f"small{i % 7}", "w " * rng.randint(1, 30)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = mixing.mix_sources(df, repeats=2.0, blocks=8).collect()
    assert sorted(r.doc_id for r in out) == list(range(1500)) and all(1 <= r.copies <= 2 for r in out)
    tokens, placed, weight = collections.Counter(), collections.Counter(), {}
    for r in out:
        tokens[r.source] += r.n_tokens
        weight[r.source] = r.weight_ppm
        blocks = r.blocks.split(",")
        assert len(blocks) == r.copies and all(0 <= int(b) < 8 for b in blocks)
        for b in blocks:
            placed[r.source, int(b)] += r.n_tokens
    total = {s: sum(placed[s, b] for b in range(8)) for s in tokens}
    everything = sum(total.values())
    for s in tokens:
        assert abs(total[s] / everything - weight[s] / 1e6) < 0.01
        for b in range(8):
            assert abs(placed[s, b] - total[s] / 8) < 0.2 * total[s] / 8 + 60
    assert total["big"] == tokens["big"]  # the least repeated source is seen once
    few = mixing.mix_sources(df, budget=2000, blocks=4).collect()
    assert abs(sum(r.n_tokens * r.copies for r in few) - 2000) < 250
    assert mixing.mix_sources(nothing).count() == 0
    edges = mixing.mix_sources(edge).collect()
    assert len(edges) == 12 and sum(r.copies for r in edges) >= 13  # one row repeats
    assert "Python" not in mixing.mix_sources(df)._jdf.queryExecution().toString()


def test_mixture_keeps_documents_without_tokens(spark):
    texts = [None, "", " \n\t"]
    rows = [(i, "mostly empty" if i < 300 else "full", "w w w" if i % 100 == 0 or i >= 300 else texts[i % 3]) for i in range(303)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = mixing.mix_sources(df, blocks=8).collect()
    assert sorted(r.doc_id for r in out) == list(range(303))
    assert all(0 <= int(b) < 8 for r in out for b in r.blocks.split(","))
    twice = mixing.mix_sources(df.filter("doc_id < 301"), blocks=8).collect()  # one source three times the other
    assert sorted(r.doc_id for r in twice) == list(range(301)) and {r.copies for r in twice if r.source == "full"} == {2}


def test_exponent_by_plain_bisection(spark):
    shares = [0.5, 0.2, 0.2, 0.05, 0.05]
    df = spark.createDataFrame([(shares,)], "s array<double>")
    for entropy, repeats in ((0.95, 100.0), (0.9, 2.0), (0.1, 1e9), (1.0, 1.5)):
        got = df.select(mixing.exponent(F.col("s"), entropy, repeats)).first()[0]

        def h(a):
            w = np.array(shares) ** a
            w /= w.sum()
            return -(w * np.log(w)).sum()

        grid = np.linspace(0, 1, 100001)
        enough = [a for a in grid if h(a) >= entropy * np.log(5) - 1e-12]
        few = [a for a in grid if (10.0) ** (1 - a) <= repeats + 1e-12]
        assert got == pytest.approx(max(max(enough, default=0.0), min(few)), abs=3e-5)
