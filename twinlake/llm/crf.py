"""Language identification by a linear-chain conditional random field over words.

Each word's features are its prefixes and suffixes (up to AFFIX bytes), its byte n-grams and the word
itself (the lexicon), hashed into a table of emission weights; transitions between the labels of
neighbouring words are learned. Training maximises the conditional log-likelihood by gradient steps
with expectations from forward-backward, on sequences spliced from texts of different languages, so
that transitions are learned from code-switched text. A document's language is the label with the
largest sum of word marginals over its whole text; its score is that label's mean marginal.

Forward-backward over a batch of documents is exact and vectorised: the words of all documents form one
sequence with resets where documents begin, cut into equal strips. The strips' transfer matrices are
multiplied out side by side, chained, and then each strip's vectors are computed side by side. Labelling takes
LABEL_CELLS words times labels at once: the vectors at the ends of the pieces are kept from a first pass forwards, then
the pieces are worked through backwards, so memory depends neither on the number of labels nor on a text's length.

The fit uses at most PER_LABEL labelled rows a label (those with the smallest hash of their id), of texts over
MAX_TRAIN_CHARS that many characters from a place given by the hash, so a label of long texts is learned
too; everything else covers all rows and whole texts. Training works through its sequences in pieces of
TRAIN_CELLS words times labels, so the driver's memory does not grow with the square of the labels.

Cases: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal results; rows
without a label or an id are not learned from (nor is a null id held out); without any training row all is ``und``;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from twinlake.llm.common import ALPHA, U64, Words, bounded_batches, mix, words_of

PER_LABEL = 300
MAX_TRAIN_CHARS = 4_000
#: Labels are collected to the driver and index small matrices; more of them are refused.
MAX_LABELS = 256
AFFIX = 3
GRAMS = (2, 3)
TABLE_BITS = 16
#: Training: words in all, epochs, step, and the pull of weights to 0.
TRAIN_WORDS = 240_000
EPOCHS = 40
STEP = 0.08
DECAY = 1e-4
SPLICE = (5, 40)
#: Training ends early after PATIENCE epochs that lower the mean miss of the right label by less than ENOUGH.
ENOUGH, PATIENCE = 2e-5, 3
#: Words times labels (or features times labels) that one step of the training holds.
TRAIN_CELLS = 4 << 20
STRIP = 512
#: Chains of at most so many words are scanned side by side.
SHORT_CHAIN = 256
#: Text bytes scanned at a time; more of them make longer vectors.
SCAN_BYTES = 4 << 20
#: Words times labels that are labelled at once; longer texts are labelled in pieces, which changes no result.
LABEL_CELLS = 8 << 20


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots, bounds) of the given words; slots index the table of 2**TABLE_BITS rows."""
    start, size = words.start[which], (words.end - words.start)[which]
    data = words.data.astype(U64)
    slots, owners = [], []
    own = np.arange(len(which))

    def add(kind: int, value: np.ndarray, owner: np.ndarray) -> None:
        slots.append(mix(value * U64(64) + U64(kind)) >> U64(64 - TABLE_BITS))
        owners.append(owner)

    add(1, words.hashes()[which], own)
    for n in range(1, AFFIX + 1):
        long = np.flatnonzero(size >= n)
        for kind, at in ((2, start[long]), (3, start[long] + size[long] - n)):
            value = np.zeros(len(long), U64)
            for k in range(n):
                value = value * U64(257) + data[at + k] + U64(1)
            add(8 * n + kind, value, long)
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(own, count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = start[owner] + inside
        value = np.zeros(len(owner), U64)
        for k in range(n):
            value = value * U64(257) + data[at + k] + U64(1)
        add(40 + n, value, owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(which) + 1))


def emissions(table: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """words x labels: the mean weight of each word's features times their root number."""
    words, k = len(bounds) - 1, table.shape[1]
    out = np.zeros((words, k), table.dtype)
    at = 0
    while at < words:  # by pieces of bounded size
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 4 * TRAIN_CELLS // max(1, k), "right")) - 1)
        out[at:to] = np.add.reduceat(table[slots[bounds[at] : bounds[to]]], bounds[at:to] - bounds[at], axis=0)
        at = to
    return out / np.sqrt(np.diff(bounds))[:, None].astype(table.dtype)


def _scan_short(steps: np.ndarray, begin: np.ndarray, sizes: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """As _scan, for short chains: one word of every chain at a time."""
    order = np.argsort(-sizes, kind="stable")  # longest first, so that those still going on are the first ones
    begin, sizes = begin[order], sizes[order]
    out = np.empty_like(steps)
    vector = np.broadcast_to(first, (len(begin), len(first)))
    for t in range(int(sizes[0])):
        go = int(np.searchsorted(-sizes, -t, "left"))
        at = begin[:go] + t
        vector = (vector[:go] if t == 0 else vector[:go] @ transition) * steps[at]
        vector = vector / vector.sum(1, keepdims=True)
        out[at] = vector
    return out


def _scan(steps: np.ndarray, resets: np.ndarray, first: np.ndarray, transition: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
    """Normalised forward vectors of one long chain.

    steps: n x k positive emissions; resets: where a chain begins; first: k start weights; entry: the vector before the
    first word, if that is not the begin of a chain.
    """
    n, k = steps.shape
    begin = np.flatnonzero(resets)
    sizes = np.diff(np.append(begin, n))
    if len(begin) and begin[0] == 0 and sizes.max() <= SHORT_CHAIN:
        return _scan_short(steps, begin, sizes, first, transition)
    strips = max(1, -(-n // STRIP))
    width = -(-n // strips)
    e = np.ones((strips * width, k), steps.dtype)
    e[:n] = steps
    r = np.ones(strips * width, bool)
    r[:n] = resets
    e, r = e.reshape(strips, width, k).transpose(1, 0, 2), r.reshape(strips, width).T
    product = np.broadcast_to(np.eye(k, dtype=steps.dtype), (strips, k, k)).copy()
    for t in range(width):
        moved = product @ transition
        if r[t].any():
            moved = np.where(r[t][:, None, None], product.sum(2, keepdims=True) * first, moved)
        product = moved * e[t][:, None, :]
        product /= product.sum((1, 2), keepdims=True)
    entries = np.empty((strips, k), steps.dtype)
    vector = (first if entry is None else entry).copy()
    for s in range(strips):
        entries[s] = vector
        vector = vector @ product[s]
        vector = vector / vector.sum()
    out = np.empty((width, strips, k), steps.dtype)
    vector = entries
    for t in range(width):
        vector = np.where(r[t][:, None], vector.sum(1, keepdims=True) * first, vector @ transition) * e[t]
        vector = vector / vector.sum(1, keepdims=True)
        out[t] = vector
    return out.transpose(1, 0, 2).reshape(strips * width, k)[:n]


def _forward(e: np.ndarray, begins: np.ndarray, start: np.ndarray, transition: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
    a, p = np.exp(transition - transition.max()), np.exp(start - start.max())
    return _scan(e, begins, p.astype(e.dtype), a.astype(e.dtype), entry)


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(1, keepdims=True))


def forward_backward(
    scores: np.ndarray, begins: np.ndarray, start: np.ndarray, transition: np.ndarray, entry: np.ndarray | None = None, exit: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward, backward) of words in a row of chains; begins: where each chain begins.

    forward and backward vectors are normalised word by word. entry: the forward vector of the word before the first one, if
    that is in the same chain; exit: the backward vector of the word behind the last one, likewise.
    """
    e = _potentials(scores)
    forward = _forward(e, begins, start, transition, entry)
    # backwards: beta[t] = A (e[t+1] * beta[t+1]); the scan yields e[t] * beta[t], with ones at chain ends
    ends = np.append(begins[1:], exit is None)
    ones = np.ones(len(start), e.dtype)
    behind = _scan(e[::-1], ends[::-1], ones, np.exp(transition - transition.max()).T.astype(e.dtype), exit)[::-1]
    beta = behind / np.maximum(e, 1e-30)
    marginals = forward * beta
    marginals /= marginals.sum(1, keepdims=True)
    return marginals, forward, behind


def expected_transitions(forward: np.ndarray, behind: np.ndarray, begins: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """labels x labels: the expected number of each transition within the chains, by one matrix product."""
    inner = np.flatnonzero(~begins)
    a = np.exp(transition)
    before, after = forward[inner - 1].astype(np.float64), behind[inner].astype(np.float64)
    z = np.einsum("ti,ti->t", before @ a, after)
    return a * (before.T @ (after / z[:, None]))


class Crf:
    def __init__(self, labels: list[str], table: np.ndarray, start: np.ndarray, transition: np.ndarray):
        self.labels, self.table, self.start, self.transition = labels, table, start, transition

    def document_marginals(self, words: Words) -> np.ndarray:
        """rows x labels: the mean word marginals of each row with a word (others 0)."""
        h = words.hashes()
        out = np.zeros((len(words.counts), len(self.labels)))
        if not len(h) or not self.labels:
            return out
        full = np.flatnonzero(words.counts)
        begins = np.zeros(len(h) + 1, bool)
        begins[words.bounds[:-1][full]] = begins[-1] = True
        size = max(STRIP, LABEL_CELLS // len(self.labels))
        pieces = list(range(0, len(h), size))

        def scores(i: int) -> np.ndarray:
            _, which, inverse = np.unique(h[i : i + size], return_index=True, return_inverse=True)
            return emissions(self.table, *word_features(words, i + which))[inverse]

        entries = [None]  # of each piece the forward vector before it, where a text goes on from the one before
        for i in pieces[:-1]:
            entries.append(_forward(_potentials(scores(i)), begins[i : i + size], self.start, self.transition, entries[-1])[-1])
            if begins[i + size]:
                entries[-1] = None
        exit, rows = None, words.rows()
        for i, entry in zip(pieces[::-1], entries[::-1]):
            j = min(i + size, len(h))
            marginals, _, behind = forward_backward(scores(i), begins[i:j], self.start, self.transition, entry, exit)
            exit = None if begins[i] else behind[0]
            at = np.flatnonzero(np.append(True, rows[i + 1 : j] != rows[i : j - 1]))
            out[rows[i:j][at]] += np.add.reduceat(marginals.astype(np.float64), at, axis=0)
        out[full] /= words.counts[full][:, None]
        return out


def train(texts: list[str], languages: list[str], seed: int = 7) -> Crf:
    """Fit on whole texts with one language each; the same rows always give the same model."""
    labels = sorted(set(languages))
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels; at most {MAX_LABELS}")
    k, rng = len(labels), np.random.default_rng(seed)
    table = np.zeros((1 << TABLE_BITS, k), np.float32)
    crf = Crf(labels, table, np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    if k < 2:
        return crf
    ((_, _, words),) = list(words_of(pa.array(texts, pa.string()), ALPHA, 1 << 40))
    gold_row = np.array([labels.index(x) for x in languages])
    # splice runs of words from texts of random labels, so that labels switch as in mixed text
    by_label = [np.flatnonzero((gold_row == y) & (words.counts > 0)) for y in range(k)]
    usable = [y for y in range(k) if len(by_label[y])]
    picked, gold, begins = [], [], []
    want = min(TRAIN_WORDS, 4 * int(words.counts.sum()))
    n = 0
    while n < want and usable:
        begins.append(n)
        for _ in range(rng.integers(1, 6)):
            y = usable[rng.integers(len(usable))]
            row = by_label[y][rng.integers(len(by_label[y]))]
            size = min(int(words.counts[row]), int(rng.integers(*SPLICE)))
            at = words.bounds[row] + int(rng.integers(words.counts[row] - size + 1))
            picked.append(np.arange(at, at + size))
            gold.append(np.full(size, y))
            n += size
    if not n:
        return crf
    picked, gold = np.concatenate(picked), np.concatenate(gold)
    starts = np.zeros(n, bool)
    starts[begins] = True
    _, which, inverse = np.unique(words.hashes()[picked], return_index=True, return_inverse=True)
    slots, bounds = word_features(words, picked[which])
    owner, root = np.repeat(np.arange(len(which)), np.diff(bounds)), np.sqrt(np.diff(bounds))
    inner = np.flatnonzero(~starts)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    chains = np.append(begins, n)
    pieces = [0]  # whole chains, TRAIN_CELLS words times labels each
    while pieces[-1] < n:
        pieces.append(max(int(chains[np.searchsorted(chains, pieces[-1], "right")]), int(chains[np.searchsorted(chains, pieces[-1] + TRAIN_CELLS // k, "right") - 1])))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (crf.table, crf.start, crf.transition)]
    least, idle = np.inf, 0
    for epoch in range(1, EPOCHS + 1):
        scores = emissions(crf.table, slots, bounds)
        by_word, of_start, expected, missed = np.zeros((len(which), k)), np.zeros(k), np.zeros((k, k)), 0.0
        for a, b in zip(pieces, pieces[1:]):
            marginals, forward, behind = forward_backward(scores[inverse[a:b]], starts[a:b], crf.start, crf.transition)
            expected += expected_transitions(forward, behind, starts[a:b], crf.transition)
            miss = -marginals
            miss[np.arange(b - a), gold[a:b]] += 1
            missed += float(miss[np.arange(b - a), gold[a:b]].sum())
            for y in range(k):
                by_word[:, y] += np.bincount(inverse[a:b], miss[:, y], len(which))
            of_start += miss[starts[a:b]].sum(0)
        by_word /= root[:, None]
        grad_table = np.stack([np.bincount(slots, by_word[owner, y], 1 << TABLE_BITS) for y in range(k)], 1)
        for x, (m, v), g in zip((crf.table, crf.start, crf.transition), moments, (grad_table, of_start, seen - expected)):
            g = g / n - DECAY * x / 100
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += STEP * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        idle = idle + 1 if missed / n > least - ENOUGH else 0
        least = min(least, missed / n)
        if idle >= PATIENCE:
            break
    return crf


def labelled_sample(df: DataFrame, *, per_label: int = PER_LABEL) -> DataFrame:
    """(text, lang): per label the rows with the smallest hash of their id, outside the held-out quarter.

    Two scans, however many labels: one counts the rows of each, one takes those under a hash that leaves
    about twice as many as are wanted, of which the smallest are kept.
    """
    rows = df.filter((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    limits = df.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * per_label / r.n)) for r in sizes], "lang string, share double")
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    some = rows.withColumn("h", h).join(F.broadcast(limits), "lang").filter(F.col("h") < F.col("share") * (1 << 40))  # at most MAX_LABELS rows
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    n, h = F.length("text"), F.col("h")
    part = F.when(n > MAX_TRAIN_CHARS, F.substr("text", (1 + h % (n - MAX_TRAIN_CHARS + 1)).cast("int"), F.lit(MAX_TRAIN_CHARS))).otherwise(F.col("text"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= per_label).select(part.alias("text"), "lang")


def fit(df: DataFrame, *, per_label: int = PER_LABEL) -> Crf:
    """The model from the ``text`` and ``lang`` of a bounded sample of df (doc_id, text, lang)."""
    rows = sorted((r.lang, r.text) for r in labelled_sample(df, per_label=per_label).collect())
    return train([t for _, t in rows], [y for y, _ in rows])


def identify(df: DataFrame, model: Crf, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score per row, and mixed (the share of the second language)."""
    bounded_batches(df.sparkSession)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), letters.alias("letters"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        m = shared.value
        for batch in batches:
            has = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, words in words_of(batch.column(1), ALPHA, SCAN_BYTES):
                p = m.document_marginals(words)
                ok = has[i:j] & (words.counts > 0) & (len(m.labels) > 0)
                best = p.argmax(1) if len(m.labels) else np.zeros(j - i, int)
                order = np.sort(p, axis=1) if len(m.labels) else np.zeros((j - i, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([m.labels[y] if k else "und" for y, k in zip(best, ok)], pa.string()),
                        pa.array(np.where(ok, np.clip(order[:, -1], 0, 1), 0.0)),
                        pa.array(np.where(ok, order[:, -2], 0.0) if order.shape[1] > 1 else np.zeros(j - i)),
                    ],
                    ["doc_id", "lang_pred", "score", "mixed"],
                )

    return rows.mapInArrow(label, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, mixed double")
