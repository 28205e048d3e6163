"""Toxicity by maximum-scoring segments over token log-odds.

Fit, on at most ``max_rows`` labelled rows (those with the smallest hash of their id): in how many toxic and
clean texts each unit occurs. Units are words and their prefixes of LEAST_PREFIX to LONGEST_PREFIX bytes, so
that an inflected word that was never seen has the odds of its stem. The toxic share of a unit's texts has a
Dirichlet prior of PRIOR_TEXTS texts that are split as those of the next shorter prefix are (of all texts, for
the shortest); it goes no further than that of a word that all toxic, or all clean, texts had. A token scores the log-odds of its longest known unit against those of all texts, negative ones too,
less COST: what a passage must gain from each of its tokens, so that common text scores below 0. Units in fewer
than MIN_TEXTS texts are left to the prior, so a token of unknown units has log-odds 0.

Score: one linear scan over each whole text finds all maximal scoring segments (Ruzzo and Tompa's scan; tokens
above 0 that follow each other are one step, and all between two steps are summed at once). By the extreme-value law
n tokens hold K * n * exp(-lambda * s) segments of score s or more by chance; lambda and K are the maximum
likelihood estimates from the best segments of the clean rows. Segments with an expected number below
``E_VALUE`` are the toxic passages. Several of them count together: the r best normalised scores have a sum of
at least t with probability about exp(-t) * t**(r-1) / (r! * (r-1)!) (Karlin and Altschul's sum statistic), and
the least likely r counts, each further segment at half the weight for the choice. A logistic curve maps the
result to a probability. The law and the curve are fitted on scores by the odds of the other half of the rows,
so that no text is judged by its own counts.

Cases: null and empty texts have no segment and get the score of such texts; labels other than 0 and 1
and null ids are not learned from (a null id is not held out either); without labelled rows of both kinds
there is no evidence, and every score is NO_EVIDENCE; copies of a text count once in the fit; an empty
table gives an empty result; other columns are not read, and ``drop_toxic`` keeps them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import ALPHA, U64, Lookup, Words, bounded_batches, mix, prefix_hash, span_hash, tidy, words_of

#: Bound on the labelled rows of the fit. All units of these that MIN_TEXTS texts hold are shipped to the tasks; a sample
#: whose texts hold more than MAX_UNITS of them is refused.
MAX_ROWS = 20_000
MAX_UNITS = 4 << 20
LEAST_PREFIX, LONGEST_PREFIX = 3, 10
PRIOR_TEXTS = 5.0
MIN_TEXTS = 3
COST = 1.5
#: Text bytes whose units are counted in one step.
UNIT_BYTES = 256 << 10
E_VALUE = 0.05
NO_EVIDENCE = 0.1
#: Normalised scores are kept within these bounds; the lower one is that of a text without a segment.
LOW, HIGH = -5.0, 30.0
_WHOLE = U64(0xA0761D6478BD642F)


def held_out(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic, fold) of at most max_rows labelled rows outside the held-out quarter, equal texts once."""
    ids = labels.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")  # at most max_rows ids
    once = rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold"))


def units_of(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, unit, parent, size) of all units of the given words; size 255 is the whole word, parent 0 none."""
    start, size = words.start[which], (words.end - words.start)[which]
    hashed = prefix_hash(words.data)
    out, parent, own = [], np.zeros(len(which), U64), np.arange(len(which))
    for n in range(LEAST_PREFIX, LONGEST_PREFIX + 1):
        long = np.flatnonzero(size >= n)
        unit = span_hash(hashed, start[long], start[long] + n)
        out.append((own[long], unit, parent[long], np.full(len(long), n)))
        parent[long] = unit
    out.append((own, mix(words.hashes()[which] ^ _WHOLE), parent, np.full(len(own), 255)))
    return tuple(np.concatenate(c) for c in zip(*out))


def unit_frequencies(sample: DataFrame) -> DataFrame:
    """unit, parent, size, and in how many toxic and clean texts of each fold it occurs (t0, c0, t1, c1)."""
    names = ["unit", "parent", "size", "t0", "c0", "t1", "c1"]

    def count(batches):
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False) != 1  # 0 toxic, 1 clean
            kind = kind + 2 * batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, words in words_of(batch.column(0), ALPHA, UNIT_BYTES):
                word, unit, parent, size = units_of(words, np.arange(len(words.start)))
                row = words.rows()[word]
                order = np.lexsort((row, unit))
                unit, row = unit[order], row[order]
                first = np.ones(len(unit), bool)
                first[1:] = (unit[1:] != unit[:-1]) | (row[1:] != row[:-1])
                keys, at, inverse = np.unique(unit, return_index=True, return_inverse=True)
                of = kind[i:j][row]
                sums = [np.bincount(inverse, first & (of == k), len(keys)).astype(np.int64) for k in range(4)] if len(keys) else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(parent[order][at].view(np.int64)), pa.array(size[order][at].astype(np.int64)), *map(pa.array, sums)], names
                )

    parts = sample.select("text", "toxic", "fold").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return parts.groupBy("unit").agg(F.min("parent").alias("parent"), F.min("size").alias("size"), *(F.sum(n).alias(n) for n in names[3:]))


def unit_odds(unit: np.ndarray, parent: np.ndarray, size: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, log-odds): of those in MIN_TEXTS texts at least, by their counts and their parents' shares."""
    share = n_toxic / (n_toxic + n_clean)
    bounds = PRIOR_TEXTS * share / (n_clean + PRIOR_TEXTS), (n_toxic + PRIOR_TEXTS * share) / (n_toxic + PRIOR_TEXTS)
    keep = np.flatnonzero(toxic + clean >= MIN_TEXTS)
    unit, parent, size, toxic, clean = (x[keep] for x in (unit, parent, size, toxic, clean))
    order = np.argsort(unit)
    at = np.minimum(np.searchsorted(unit[order], parent), max(0, len(unit) - 1))
    above = np.where(unit[order][at] == parent, order[at], -1) if len(unit) else at
    p = np.full(len(unit) + 1, share)  # the last is the root
    for n in np.unique(size):
        now = np.flatnonzero(size == n)
        # texts that a unit shares with its stem count again at each length, so the share is kept within bounds
        p[now] = np.clip((toxic[now] + PRIOR_TEXTS * p[above[now]]) / (toxic[now] + clean[now] + PRIOR_TEXTS), *bounds)
    return unit, (np.log(p) - np.log1p(-p))[:-1] - (math.log(share) - math.log1p(-share))


class Model:
    """Units with their scores, the extreme-value law and the logistic curve."""

    def __init__(self, units: np.ndarray, odds: np.ndarray, decay: float = 1.0, scale: float = 1.0):
        self.lookup, self.scores, self.decay, self.scale = Lookup(units), odds - COST, decay, scale
        self.base, self.slope = math.log(NO_EVIDENCE / (1 - NO_EVIDENCE)), 0.0

    def token_scores(self, words: Words) -> np.ndarray:
        h = words.hashes()
        if not len(h) or not len(self.scores):
            return np.full(len(h), -COST)
        _, which, inverse = np.unique(h, return_index=True, return_inverse=True)
        start, size = words.start[which], (words.end - words.start)[which]
        hashed = prefix_hash(words.data)
        value, alive = np.full(len(which), -COST), np.ones(len(which), bool)
        for n in range(LEAST_PREFIX, LONGEST_PREFIX + 1):
            long = np.flatnonzero(alive & (size >= n))
            hit, kind = self.lookup(span_hash(hashed, start[long], start[long] + n))
            alive[long] = False
            alive[long[hit]] = True
            value[long[hit]] = self.scores[kind]
        left = np.flatnonzero(alive)
        hit, kind = self.lookup(mix(h[which[left]] ^ _WHOLE))
        value[left[hit]] = self.scores[kind]
        return value[inverse]

    def normalised(self, scores: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """The log of how unlikely segments of these scores are among n tokens."""
        return self.decay * np.asarray(scores, float) - np.log(self.scale * np.maximum(n, 1))

    def together(self, scores: list[float], n: int) -> float:
        """The normalised score of all significant segments of a text of n tokens: that of the best one, or more."""
        if not scores:
            return LOW
        x = np.sort(self.normalised(scores, n))[::-1]
        x = np.concatenate([x[:1], x[1:][x[1:] > -math.log(E_VALUE)]])
        if len(x) > 1:
            r = np.arange(1, len(x) + 1)
            t = np.cumsum(x)
            logs = np.cumsum(np.log(r))  # of r!
            x = t - (r - 1) * np.log(2 * t) + 2 * logs - np.log(r)
        return float(np.clip(x.max(), LOW, HIGH))

    def curve(self, together: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * np.asarray(together))))

    def judge(self, words: Words):
        """(row, segments) of each row with a segment; segments: (first word, last word, score)."""
        scores = self.token_scores(words)
        rows = words.rows()
        for row in np.unique(rows[scores > 0]).tolist():
            yield row, maximal_segments(scores[words.bounds[row] : words.bounds[row + 1]])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's scan: all maximal scoring segments (first, last, score), in order."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    above = np.concatenate([[False], scores > 0, [False]])
    begin, end = np.flatnonzero(~above[:-1] & above[1:]), np.flatnonzero(above[:-1] & ~above[1:])
    low: list[float] = []  # sums before and after each candidate, its first and last place
    high: list[float] = []
    ends: list[tuple[int, int]] = []
    back: list[int] = []  # the nearest earlier candidate that starts lower
    for first, last, left, right in zip(begin.tolist(), (end - 1).tolist(), total[begin].tolist(), total[end].tolist()):
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = back[j]
            if j < 0 or high[j] >= right:
                low.append(left)
                high.append(right)
                ends.append((first, last))
                back.append(j)
                break
            left, first = low[j], ends[j][0]
            del low[j:], high[j:], ends[j:], back[j:]
    return [(a, b, h - x) for (a, b), x, h in zip(ends, low, high)]


def extreme_value_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of greatest likelihood for the best scores of clean texts of n tokens."""
    if not len(best):
        return 1.0, 1.0
    n = np.maximum(n, 1)

    def weights(decay: float) -> np.ndarray:
        return n * np.exp(-decay * (best - best.min()))

    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        w = weights(mid)
        if 1 / mid > best.mean() - np.sum(best * w) / w.sum():
            low = mid
        else:
            high = mid
    return low, float(len(best) / np.sum(n * np.exp(-low * best)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) by Newton steps, halved while they do not help, with a weak pull to (0, 0)."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.05 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + 0.1 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Model:
    """The model from the labelled rows; the driver gets all units in MIN_TEXTS texts or more, and a few numbers a sample row."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, max_rows).persist()
    try:
        sizes = np.zeros((2, 2))  # fold x (toxic, clean)
        for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
            sizes[r.fold, 1 - r.toxic] = r.n
        both = sizes.sum(0)
        if not both.all():
            return Model(np.zeros(0, U64), np.zeros(0))
        texts = F.col("t0") + F.col("c0") + F.col("t1") + F.col("c1")
        units = unit_frequencies(sample).filter(texts >= MIN_TEXTS).limit(MAX_UNITS + 1).toArrow()
        if units.num_rows > MAX_UNITS:
            raise ValueError(f"more than {MAX_UNITS} units in {MIN_TEXTS} of the {max_rows} sample texts or more; use fewer texts")
        unit, parent = (units.column(c).to_numpy().view(U64) for c in ("unit", "parent"))
        size, t0, c0, t1, c1 = (units.column(c).to_numpy() for c in ("size", "t0", "c0", "t1", "c1"))
        whole = unit_odds(unit, parent, size, t0 + t1, c0 + c1, *both)
        model = Model(*whole)
        others = [model, model]
        if sizes.all():  # each fold is judged by the counts of the other
            others = [Model(*unit_odds(unit, parent, size, *tc, *n)) for tc, n in (((t1, c1), sizes[1]), ((t0, c0), sizes[0]))]
        del units, unit, parent, size, t0, c0, t1, c1, whole
        shared = docs.sparkSession.sparkContext.broadcast(others)
        del others
        try:
            toxic, best, _, n_words = _judge_sample(sample, shared)
            model.decay, model.scale = extreme_value_law(best[toxic == 0], n_words[toxic == 0])
            toxic, _, together, _ = _judge_sample(sample, shared, (model.decay, model.scale))
        finally:
            shared.destroy()
        model.base, model.slope = logistic(together, toxic)
        return model
    finally:
        sample.unpersist()
        tidy(docs.sparkSession)


def _judge_sample(sample: DataFrame, shared: Broadcast, law: tuple[float, float] = (1.0, 1.0)) -> list[np.ndarray]:
    """toxic, best, together, n_words of the sample's rows, each by the model of its fold under the law."""

    def scan(batches):
        for m in shared.value:
            m.decay, m.scale = law
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            parts = [(m, batch.filter(pa.array(fold == k))) for k, m in enumerate(shared.value)]
            for m, part, (i, j, words) in ((m, part, step) for m, part in parts for step in words_of(part.column(0), ALPHA)):
                best, together = np.zeros(j - i), np.full(j - i, LOW)
                for row, segments in m.judge(words):
                    scores = [s for *_, s in segments]
                    best[row], together[row] = max(scores), m.together(scores, words.counts[row])
                yield pa.RecordBatch.from_arrays([part.column(1).slice(i, j - i).cast(pa.int64()), pa.array(best), pa.array(together), pa.array(words.counts)], ["toxic", "best", "together", "n_words"])

    columns = sample.select("text", "toxic", "fold").mapInArrow(scan, "toxic long, best double, together double, n_words long").toArrow().columns
    return [c.to_numpy().astype(float) for c in columns]


def score_toxicity(df: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, best (segment's score), score (0 to 1) and passages: the significant
    segments as first word, last word and score, joined by colons, and all by commas."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for batch in batches:
            for i, j, words in words_of(batch.column(1), ALPHA):
                best, together, found = np.zeros(j - i), np.full(j - i, LOW), [""] * (j - i)
                for row, segments in m.judge(words):
                    scores = [s for *_, s in segments]
                    best[row], together[row] = max(scores), m.together(scores, words.counts[row])
                    rate = m.scale * words.counts[row]
                    found[row] = ",".join(f"{a}:{b}:{s:.3f}" for a, b, s in segments if rate * math.exp(-m.decay * s) < E_VALUE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(words.counts), pa.array(best), pa.array(m.curve(together)), pa.array(found, pa.string())],
                    ["doc_id", "n_words", "best", "score", "passages"],
                )

    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, best double, score double, passages string")


def drop_toxic(df: DataFrame, model: Model, *, threshold: float, text: str = "text") -> DataFrame:
    """df without the rows whose score reaches the threshold; all columns, in place, without a shuffle."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    column = df.columns.index(text)

    def keep(batches):
        m = shared.value
        for batch in batches:
            together = np.full(batch.num_rows, LOW)
            for i, _, words in words_of(batch.column(column), ALPHA):
                for row, segments in m.judge(words):
                    together[i + row] = m.together([s for *_, s in segments], words.counts[row])
            yield batch.filter(pa.array(m.curve(together) < threshold))

    return df.mapInArrow(keep, df.schema)
