"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Each text is cut into overlapping passages of whole words, so that a copy of any item lies whole in one of
them. A passage's distinct words query the index by block-max WAND, which retrieves every item whose score
reaches ``THRESHOLD`` of the item's score for its own words: postings are skipped where the bounds of terms,
then of blocks, stay below it. (The bounds of ranges of items are first summed for all passages at once; a
passage that stays below the threshold in each can retrieve nothing and is not searched further.)

A retrieved item is confirmed by the overlap of k-word shingles of its question and of its answer with the
passage. The answer is the item's last sentence, or its last third if it has but one.

Items of less than MIN_WORDS words have no shingle; they are found where all their words stand in a row (``ShortItems``),
and reported with the number of such places in ``whole_runs``. A word or two prove no copy, so documents with
short items only are dropped on request only (``drop_contaminated(short=True)``).

Words are runs of letters, digits and non-ASCII characters, in lower case. Cases: null and empty texts have
no passage; items without words are never found; equal items, and items that repeat an id, are all reported (under
their ids, which may be of any type, or null); an empty benchmark or table gives no rows; a null ``doc_id`` is passed
on; extra columns pass through ``drop_contaminated``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from twinlake.llm.common import ALNUM, U64, Lookup, Words, bounded_batches, mix, words_of

K1, B = 1.2, 0.75
THRESHOLD = 0.6
BLOCK = 16
#: Ranges of items for which all passages' bounds are computed at once.
RANGES = 64
SHINGLE = 5
QUESTION_OVERLAP = 0.8
ANSWER_OVERLAP = 0.5
LEAST_STRIDE = 32
#: Items of less words (as many as a shingle has) are looked for as whole runs of words.
MIN_WORDS = SHINGLE
#: The index is shipped to every task, so the benchmark's size is checked first and more is refused.
MAX_ITEMS = 500_000
MAX_BYTES = 256 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = len(words) - max(1, len(words) // 3)
    return " ".join(words[:at]), " ".join(words[at:])


class Texts:
    """The words (as hashes) of texts, end to end in one array; those of one text by its number."""

    def __init__(self, texts: list[str]):
        out, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, _, words in words_of(pc.utf8_lower(pa.array(texts, pa.string())), ALNUM):
            out.append(words.hashes())
            counts.append(words.counts)
        self.words = np.concatenate(out)
        self.counts = np.concatenate(counts)
        self.bounds = np.append(0, np.cumsum(self.counts))

    def __getitem__(self, n: int) -> np.ndarray:
        if n >= len(self.counts):
            raise IndexError(n)
        return self.words[self.bounds[n] : self.bounds[n + 1]]


def _hashes(texts: list[str]) -> Texts:
    return Texts(texts)


def grams(words: np.ndarray, k: int) -> set[bytes]:
    data = np.ascontiguousarray(words)
    return {data[i : i + k].tobytes() for i in range(len(data) - k + 1)} if k else set()


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """The share of the part's k-word shingles in the passage (parts shorter than k count as one; 1 if empty)."""
    k = min(SHINGLE, len(part))
    own = grams(part, k)
    return len(own & grams(passage, k)) / len(own) if own else 1.0


def _highest(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The highest value of each stretch from one begin to the next (none is empty)."""
    return np.maximum.reduceat(values, begin) if len(begin) else values[:0]


def run_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the run of ``size`` words that begins with each word."""
    n = max(0, len(words) - size + 1)
    keys = np.zeros(n, U64)
    for j in range(size):
        keys = mix(keys) + words[j : j + n]
    return keys


class ShortItems:
    """Items of one to MIN_WORDS - 1 words, by number, found where all their words stand in a row."""

    def __init__(self, words: dict[int, np.ndarray]):
        self.sizes = []  # (size, lookup of the distinct runs, their words, of each the items)
        for size in sorted({len(w) for w in words.values()}):
            items = [i for i, w in words.items() if len(w) == size]
            runs, of = np.unique(np.stack([words[i] for i in items]), axis=0, return_inverse=True)
            held: list[list[int]] = [[] for _ in runs]
            for i, run in zip(items, of.ravel().tolist()):
                held[run].append(i)
            keys = np.concatenate([run_keys(r, size) for r in runs])
            self.sizes.append((size, Lookup(keys), runs, held))

    def hits(self, words: Words):
        """(row, item number, places) of each item in each row that holds it."""
        h = words.hashes() if self.sizes else None
        for size, lookup, runs, held in self.sizes:
            at, run = lookup(run_keys(h, size))
            row = np.searchsorted(words.bounds, at, "right") - 1
            inside = at + size <= words.bounds[row + 1]
            for j in range(size):
                inside &= h[at + j] == runs[run, j]
            pairs, places = np.unique(row[inside] * len(runs) + run[inside], return_counts=True)
            for pair, n in zip(pairs.tolist(), places.tolist()):
                for item in held[pair % len(runs)]:
                    yield pair // len(runs), item, n


class Index:
    """Postings per term, by item, with impacts as shares of the item's score for its own words.

    All postings are end to end in flat arrays, those of term t from edges[t] to edges[t + 1], so that an index has
    some 20 bytes a word of its items and RANGES numbers a term.
    """

    def __init__(self, items: list[tuple[object, str | None]]):
        items = sorted(((i, t or "") for i, t in items), key=lambda x: (x[1], repr(x[0])))
        self.ids = [i for i, _ in items]
        split = [question_and_answer(t) for _, t in items]
        self.questions, self.answers = _hashes([q for q, _ in split]), _hashes([a for _, a in split])
        whole = _hashes([t for _, t in items])
        del split
        lengths = np.where(whole.counts >= MIN_WORDS, whole.counts, 0)
        self.longest = int(lengths.max()) if len(items) else 0
        self.short = ShortItems({i: whole[i] for i in np.flatnonzero((whole.counts > 0) & (lengths == 0)).tolist()})
        mean = lengths.mean() if lengths.sum() else 1.0
        n = max(1, len(items))
        terms, of = np.unique(whole.words[np.repeat(lengths > 0, whole.counts)], return_inverse=True)
        pairs, tf = np.unique(of * n + np.repeat(np.arange(len(items)), lengths), return_counts=True)
        del whole, of
        term, at = np.divmod(pairs, n)
        self.edges = np.searchsorted(term, np.arange(len(terms) + 1))
        held = np.diff(self.edges)
        idf = np.log(1 + (len(items) - held + 0.5) / (held + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[at] / mean))
        self.impact = impact / np.bincount(at, impact, n)[at]
        self.at = at.astype(np.int32)
        self.top = _highest(self.impact, self.edges[:-1])
        blocks = -(-held // BLOCK)
        self.blocks = np.append(0, np.cumsum(blocks))  # of each term its first block
        begin = np.repeat(self.edges[:-1], blocks) + BLOCK * (np.arange(self.blocks[-1]) - np.repeat(self.blocks[:-1], blocks))
        self.block_tops = _highest(self.impact, begin)
        self.block_ends = self.at[np.minimum(begin + BLOCK, np.repeat(self.edges[1:], blocks)) - 1]
        self.lookup = Lookup(terms)
        # highest impact of each term in each of RANGES ranges of items: the bounds for all passages at once
        self.range_tops = np.zeros((len(terms), RANGES), np.float32)
        cell = term * RANGES + at * RANGES // n
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        self.range_tops.ravel()[cell[first]] = _highest(np.nextafter(self.impact.astype(np.float32), np.float32(2)), first)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item number, score) of all items with at least the threshold, by block-max WAND."""
        at, impact, ends, tops = map(memoryview, (self.at, self.impact, self.block_ends, self.block_tops))
        t = np.asarray(terms, np.int64)
        # of each term the place in its postings, their begin and end, the highest impact, the first block and the one behind
        columns = (self.edges[t], self.edges[t], self.edges[t + 1], self.top[t], self.blocks[t], self.blocks[t + 1])
        lists = [list(x) for x in zip(*(c.tolist() for c in columns))]
        found = []
        eps = 1e-9
        while lists:
            lists.sort(key=lambda x: at[x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = at[lists[pivot][0]]
            while pivot + 1 < len(lists) and at[lists[pivot + 1][0]] == item:
                pivot += 1
            bound, behind = 0.0, None
            for x in lists[: pivot + 1]:
                b = bisect_left(ends, item, x[4] + (x[0] - x[1]) // BLOCK, x[5])
                if b < x[5]:
                    bound += tops[b]
                    behind = ends[b] if behind is None else min(behind, ends[b])
            if bound < threshold - eps:
                # no item up to the nearest block end, or before the next list, can reach the threshold
                to = (behind if behind is not None else item) + 1
                if pivot + 1 < len(lists):
                    to = min(to, at[lists[pivot + 1][0]])
                to = max(to, item + 1)
                moved = lists[: pivot + 1]
            elif at[lists[0][0]] == item:
                score = sum(impact[x[0]] for x in lists[: pivot + 1])
                if score >= threshold - eps:
                    found.append((item, score))
                to, moved = item + 1, lists[: pivot + 1]
            else:
                to, moved = item, [x for x in lists[: pivot + 1] if at[x[0]] < item]
            for x in moved:
                x[0] = bisect_left(at, to, x[0], x[2])
            lists = [x for x in lists if x[0] < x[2]]
        return found

    @cached_property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each term the items that hold it, and its impacts there."""
        return [(self.at[a:b], self.impact[a:b]) for a, b in zip(self.edges[:-1], self.edges[1:])]

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, self.longest + self.longest // 4)

    def passages(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first word in the row) of all passages of 2 * stride words, every stride words."""
        per_row = np.where(counts > 0, np.maximum(1, -(-counts // self.stride) - 1), 0)
        rows = np.repeat(np.arange(len(counts)), per_row)
        return rows, (np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * self.stride

    def bounds(self, words: Words, places: np.ndarray, terms: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each passage at least the highest score of any item: per range of items, the sum of its distinct
        terms' highest impacts there, and the largest of these sums.

        Rows are cut into cells of ``stride`` words; a passage is two cells, so its distinct terms are those of
        its first cell and those of its second that are not in its first.
        """
        cells = -(-words.counts // self.stride)
        cell_from = np.concatenate([[0], np.cumsum(cells)])
        row = np.searchsorted(words.bounds, places, "right") - 1
        cell = cell_from[row] + (places - words.bounds[row]) // self.stride
        v = max(1, len(self.top))
        pairs = np.unique(cell * v + terms)
        cell, terms = pairs // v, pairs % v
        before = pairs - v
        at = np.minimum(np.searchsorted(pairs, before), len(pairs) - 1) if len(pairs) else before
        new = pairs[at] != before if len(pairs) else np.zeros(0, bool)
        edges = np.searchsorted(cell, np.arange(cell_from[-1] + 1))
        tops = self.range_tops[terms]
        sums = []
        for weights in (tops, np.where(new[:, None], tops, np.float32(0))):
            total = np.zeros((cell_from[-1] + 1, RANGES), np.float32)
            full = np.flatnonzero(np.diff(edges))
            if len(full):
                total[full] = np.add.reduceat(weights, edges[:-1][full], axis=0)
            sums.append(total)
        one = cell_from[rows] + first // self.stride
        two = np.where(one + 1 < cell_from[rows + 1], one + 1, cell_from[-1])  # the last line is all 0
        return (sums[0][one] + sums[1][two]).max(axis=1) if len(rows) else np.zeros(0)

    def hits(self, words: Words, threshold: float = THRESHOLD):
        """(row, item number, score, question overlap, answer overlap, first word) of each confirmed passage."""
        if not self.ids:
            return
        h = words.hashes()
        places, terms = self.lookup(h)
        order = np.argsort(places)
        places, terms = places[order], terms[order]
        rows, first = self.passages(words.counts)
        begin = words.bounds[rows] + first
        end = np.minimum(begin + 2 * self.stride, words.bounds[rows + 1])
        a, b = np.searchsorted(places, begin), np.searchsorted(places, end)
        for p in np.flatnonzero(self.bounds(words, places, terms, rows, first) >= threshold - 1e-4).tolist():
            for item, score in self.search(np.unique(terms[a[p] : b[p]]).tolist(), threshold):
                passage = h[begin[p] : end[p]]
                q, r = overlap(self.questions[item], passage), overlap(self.answers[item], passage)
                if q >= QUESTION_OVERLAP and r >= ANSWER_OVERLAP:
                    yield int(rows[p]), item, float(score), q, r, int(first[p])


def build_index(benchmark: DataFrame, *, id: str = "item_id", text: str = "text") -> Index:
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()
    if size.n > MAX_ITEMS or size.b > MAX_BYTES:
        raise ValueError(f"benchmark of {size.n} items and {size.b} bytes; at most {MAX_ITEMS} and {MAX_BYTES} are shipped to the tasks")
    return Index([(r[0], r[1]) for r in benchmark.select(id, text).collect()])


def contaminated(df: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and confirmed item: doc_id, item_id, score (best passage), overlaps, passages, whole_runs.

    whole_runs is 0 but for items of less than MIN_WORDS words; those have score and overlaps 1, and no passages.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(kind)
    shared = df.sparkSession.sparkContext.broadcast(build_index(benchmark))
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passages", "whole_runs"]

    def search(batches):
        index = shared.value
        for batch in batches:
            best: dict[tuple[int, int], list] = {}
            for i, _, words in words_of(pc.utf8_lower(batch.column(1)), ALNUM):
                for row, item, score, q, a, _ in index.hits(words):
                    old = best.get((i + row, item), [0.0, 0.0, 0.0, 0, 0])
                    best[i + row, item] = [max(old[0], score), max(old[1], q), max(old[2], a), old[3] + 1, 0]
                for row, item, places in index.short.hits(words):
                    best[i + row, item] = [1.0, 1.0, 1.0, 0, places]
            if best:
                keys = list(best)
                values = list(zip(*best.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                        pa.array([index.ids[k[1]] for k in keys], item_type),
                        *(pa.array(list(v), pa.float64()) for v in values[:3]),
                        *(pa.array(list(v), pa.int64()) for v in values[3:]),
                    ],
                    names,
                )

    return rows.mapInArrow(search, f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {kind.simpleString()}, score double, question_overlap double, answer_overlap double, passages long, whole_runs long")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, text: str = "text", short: bool = False) -> DataFrame:
    """df without the rows in which an item is confirmed; all columns, in place, without a shuffle.

    short: rows that hold all words of an item of less than MIN_WORDS words in a row go too.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(build_index(benchmark))
    column = df.columns.index(text)

    def keep(batches):
        index = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for i, _, words in words_of(pc.utf8_lower(batch.column(column)), ALNUM):
                for row, *_ in index.hits(words):
                    clean[i + row] = False
                for row, *_ in index.short.hits(words) if short else ():
                    clean[i + row] = False
            yield batch.filter(pa.array(clean))

    return df.mapInArrow(keep, df.schema)
