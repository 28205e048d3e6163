"""Periodic runs of words: a suffix automaton whose tree of suffix links is walked by link-cut access.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends with period q. Reported
are runs of MIN_LENGTH words or more that hold their period EXPONENT times or more.

In the tree of suffix links, every node between an end position's state and the root is a suffix that ends there. A
node's colour is the last position at which it ended. Word after word, ``access`` walks from the state of the new end
to the root along paths of one colour; a path of colour e that is left at a node of length m says that the words up to e
and up to the new end i share exactly m last words. A distance i - e of at most m is a square of period i - e, and the
m shared words give its run's start; the run lasts while following words report the same distance. The walked path then
takes colour i. As in every link-cut tree, each path is a splay tree, so a walk takes O(log n) amortised steps, even for
one word repeated throughout. (A power's distance is never reported for a multiple of its period: a shorter distance
shares more words.) The automaton of a stretch is built first and its end positions are then accessed in order; paths
have the same colours and lengths as if each access followed its word at once.

A word of a run with EXPONENT periods stands in it at least EXPONENT times, and each three of its words at least three
times. Stretches in which every word and every three words recur like that are found first by counting hashes (equal
words have equal hashes, so no run is lost), and only they get an automaton. Words are compared by their bytes.

Cases: null and empty texts have no words and no run; a null id counts as not periodic (see ``rewritten``); equal rows have
equal results and all stay; an empty table gives an empty result; other columns are not looked at. A text is worked
on whole in one task, with memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinlake.llm.common import U64, Words, bounded_batches, mix, steps, utf8

EXPONENT, MIN_LENGTH = 4, 6
_SAME = np.arange(256, dtype=np.uint8)
_IN_WORD = np.array([b != 0x20 and not 9 <= b <= 13 for b in range(256)])


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """(length of each state, its suffix link, state of each prefix) of the suffix automaton; state 1 is the root, 0 none."""
    length, link, following = [0, 0], [0, 0], [{}, {}]
    ends, last = [], 1
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(1)
        following.append({})
        p = last
        while p and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p:
            q = following[p][c]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                following.append(following[q].copy())
                while p and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
        ends.append(new)
    return length, link, ends


class Paths:
    """A rooted forest cut into coloured paths (link-cut tree without rerooting); node 0 is none."""

    def __init__(self, parent: list[int]):
        self.up = parent  # in a splay tree its parent, at its root the node above the path
        self.left, self.right = [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)  # valid at roots of splay trees

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        self.colour[x] = self.colour[y]  # right at the latest when y was the root

    def access(self, x: int, new: int) -> list[tuple[int, int]]:
        """Colour the path from x to its root; (colour, deepest node) of the coloured path pieces it took, bottom up."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        took, below = [], 0
        while x:
            y = up[x]
            if y and (left[y] == x or right[y] == x):
                self._splay(x)
            old = colour[x]
            if old >= 0:
                took.append((old, x))
                if right[x]:
                    colour[right[x]] = old  # what hangs below keeps its colour
            right[x] = below
            below, x = x, up[x]
        colour[below] = new
        return took


def runs_of(words: list, exponent: int = EXPONENT, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= max(least, exponent * period), by start, then period."""
    length, link, ends = automaton(words)
    paths = Paths([0 if p == 1 else p for p in link])  # the root shares no word with anything
    access, more = paths.access, exponent - 1
    last, found = {}, []
    for i, x in enumerate(ends):
        for e, at in access(x, i):
            q = i - e
            if more * q <= length[at]:
                run = last.get(q)
                if run is not None and run[1] == i - 1:
                    run[1] = i
                else:
                    run = last[q] = [e - length[at] + 1, i, q]
                    found.append(run)
    return sorted((s, e - s + 1, q) for s, e, q in found if e - s + 1 >= least)


def candidates(hashes: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of stretches of words, all of one group, outside of which there is no run."""
    at = np.arange(len(hashes))
    while len(at):
        key = mix(hashes[at] + mix(group.astype(U64) + U64(1)))
        _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        good = counts[where] >= EXPONENT
        three = np.flatnonzero(good[:-2] & good[1:-1] & good[2:])
        three = three[(at[three + 2] - at[three] == 2) & (group[three] == group[three + 2])]
        _, where, counts = np.unique(mix(key[three]) + mix(key[three + 1] * U64(3)) + key[three + 2], return_inverse=True, return_counts=True)
        three = three[counts[where] >= 3]
        if not len(three):
            return []
        head = np.ones(len(three), bool)
        head[1:] = (np.diff(three) > 1) | (group[three[1:]] != group[three[:-1]])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(three))) + 2
        long = size >= MIN_LENGTH
        begin, size = at[three[first[long]]], size[long]
        kept = int(size.sum())
        if kept == len(at):
            return [(int(b), int(b + n)) for b, n in zip(begin, size)]
        # counts within the stretches found may say more
        group = np.repeat(np.arange(len(size)), size)
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(kept)
    return []


def rewritten(doc_id, n: int) -> tuple[int, int] | None:
    """(a, p) where the words of this document from a on repeat the p words from a; None where they stay as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _found(ids: list, words: Words, rewrite) -> list[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """For each row its runs and its words."""
    n = len(words.start)
    order = np.arange(n)
    if rewrite:
        for r, doc_id in enumerate(ids):
            base, size = int(words.bounds[r]), int(words.counts[r])
            if rule := rewrite(doc_id, size):
                a, p = rule
                order[base + a : base + size] = base + a + np.arange(size - a) % p
    row = words.rows()
    data = words.data.tobytes()
    out = [([], data[i:j].split()) for i, j in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())]
    for r in np.unique(row[order != np.arange(n)]).tolist():
        own, base = out[r][1], int(words.bounds[r])
        out[r] = ([], [own[k] for k in (order[base : base + len(own)] - base).tolist()])
    for begin, end in candidates(words.hashes()[order], row):
        r = int(row[begin])
        begin, end = begin - int(words.bounds[r]), end - int(words.bounds[r])
        out[r][0].extend((s + begin, length, q) for s, length, q in runs_of(out[r][1][begin:end]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    keep, done = [], 0
    for a, b in sorted((s + q, s + length) for s, length, q in runs):
        keep += words[done:a] if a > done else []
        done = max(done, b)
    return keep + words[done:]


def periodic_runs(docs: DataFrame, rewrite=rewritten) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of all runs and of the text without repetition.

    ``rewrite(doc_id, number of words)`` may name words that are to be replaced first; None for texts as they are.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                part = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], (_SAME, _IN_WORD))
                rows = []
                for runs, words in _found(batch.column(0).slice(i, j - i).to_pylist(), part, rewrite):
                    s, length, q = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                    kept = b" ".join(_collapsed(words, runs))
                    rows.append((len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS))], ["doc_id", *(f for f, _ in FIELDS)])

    kinds = ", ".join(f"{f} {'long' if t == pa.int64() else 'string'}" for f, t in FIELDS)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {id_type}, {kinds}")
