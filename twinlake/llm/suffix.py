"""Exact repeats of at least LENGTH bytes across and within documents, by the common-prefix interval tree of
enhanced suffix arrays.

A suffix array of a whole corpus cannot be split among machines as it is, so suffixes are dealt out first:

1. Of the GRAM-byte pieces of each LENGTH-byte string the one with the smallest hash (the leftmost of
   equals) is its anchor. Equal strings have equal anchors, so only suffixes with an anchor that occurs more
   than once can repeat, and those with the same anchor are brought together. Strings that follow each
   other with one anchor form one context: the byte before the first, and all bytes of the strings. Equal
   contexts are combined by an aggregation with partial sums before they are dealt out, so a passage that
   stands in any number of documents is one row.
2. The distinct contexts of whole anchors are put end to end. Their suffixes, up to the ends of their contexts,
   are sorted by their bytes to where they differ, with the lengths of common prefixes: an enhanced suffix array.
   (Suffixes whose first LENGTH bytes have a hash of their own cannot repeat and are left out.) A stack scan
   over the lengths yields the tree of common-prefix intervals: each is a repeated string with all its
   occurrences, not only neighbours.
3. An interval whose occurrences are preceded by different bytes cannot be extended to the left: it is a maximal
   repeat. Where an occurrence is the first of its context, its extension to the left belongs to another anchor, so
   the interval counts as maximal here. The bytes that ``remove_repeats`` takes out are those that the
   occurrences of these maximal repeats cover; a suffix in several nested ones counts by the deepest.
4. An anchor with more contexts than one task should hold (by bytes or by rows) is dealt out in parts. Each part
   hands on the first LENGTH bytes (as a 128-bit digest) of its outermost intervals and lone suffixes; equal
   ones of different parts are one interval of the whole array, and are joined by an aggregation.
5. ``maximal_repeats`` goes on from the strings that start a maximal repeat. The suffixes from there, as far as
   strings repeat, are sorted once more, now to their full length whatever their contexts, by groups of
   equal first LENGTH bytes, and the left-diverse intervals of all depths are listed with all occurrences.

Bytes are those of the UTF-8 text; matches never cross documents; overlapping occurrences count.

Rows are told apart by two hashes of id and text, never by the id alone. Cases: null and empty texts have no
bytes; texts under LENGTH bytes cannot repeat; equal texts repeat whole; a null id is an id like others; rows
that repeat an id are documents of their own, with the same text (then both repeat whole) or with different
ones; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import U64, Scratch, bounded_batches, mix, powers, prefix_hash, span_hash, steps, utf8, written

LENGTH = 200
GRAM = 48
#: Bytes of text, or of contexts, that one vectorised step works on.
TEXT_BYTES = 2 << 20
CONTEXT_BYTES = 1 << 20
#: Equal contexts are combined among so many bytes of distinct ones, or so many in all, before the aggregation.
COMBINE_BYTES, COMBINE_ROWS = 4 << 20, 100_000
#: Contexts of one anchor beyond so many bytes, or so many rows, are worked on in parts.
ANCHOR_BYTES = 1 << 20
ANCHOR_ROWS = 512
START = 255  # stands for the byte before a document's first; no byte of UTF-8


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first start, last start, anchor hash): runs of strings of ``length`` bytes with one anchor."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    prefix = prefix_hash(data)
    down = powers(n)[1]
    grams = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    bits = U64(n.bit_length())
    width = length - gram + 1
    blocks = -(-len(grams) // width)
    key = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    key[: len(grams)] = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    key = key.reshape(blocks, width)
    ahead = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(key, axis=1).ravel()
    windows = n - length + 1
    at = (np.minimum(ahead[:windows], behind[width - 1 : width - 1 + windows]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    marks = np.zeros(n + 1, np.int32)
    whole = np.flatnonzero(sizes >= length)
    marks[offsets[:-1][whole]] += 1
    marks[offsets[1:][whole] - length + 1] -= 1
    valid = np.cumsum(marks[:windows]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    begins[offsets[:-1][whole]] = True
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], last - offsets[row], grams[at[first]]


# ------------------------------------------------------------------ suffix arrays


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), U64)
    for b in range(8):
        out = out << U64(8) | padded[b : len(data) + b]
    return out


_MASK = np.array([0] + [((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9)], U64)  # of the first k bytes of a word


def suffix_array(data: np.ndarray, starts: np.ndarray, sizes: int | np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes data[start : start + size], common prefix of each with the one before).

    Suffixes are sorted by 8 bytes at a time; only those still equal are looked at again, and only those that
    differ in these bytes are sorted again. With ``classes`` (sorted numbers) they are sorted within each class.
    """
    n = len(starts)
    sizes = np.broadcast_to(np.asarray(sizes, np.int64), n)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, lcp
    words = np.append(big_endian_words(data), U64(0))
    head = np.zeros(n, bool)  # of the suffixes that begin a run of equal ones
    head[0] = True
    if classes is not None:
        head[1:] = classes[1:] != classes[:-1]
    lone = head & np.append(head[1:], True)
    open_, at = np.flatnonzero(~lone), 0
    while len(open_):
        here = order[open_]
        left = np.minimum(sizes[here] - at, 8)
        value = words[starts[here] + at] & _MASK[left]
        first = head[open_]
        differ = ~first[1:] & ((value[1:] != value[:-1]) | (left[1:] != left[:-1]))
        if differ.any():
            run = np.cumsum(first) - 1
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][differ]] = True
            move = np.flatnonzero(mixed[run])
            to = move[np.lexsort((left[move], value[move], run[move]))]
            order[open_[move]], value[move], left[move] = here[to], value[to], left[to]
            differ = ~first[1:] & ((value[1:] != value[:-1]) | (left[1:] != left[:-1]))
            split = np.flatnonzero(differ) + 1
            lcp[open_[split]] = at + np.minimum(_equal_bytes(value[split], value[split - 1]), np.minimum(left[split], left[split - 1]))
            head[open_[split]] = True
            first = head[open_]
        lcp[open_[~first]] = at + left[~first]
        lone = first & np.append(first[1:], True)
        open_ = open_[~lone & (left == 8)]
        at += 8
    return order, lcp


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes of two big-endian words are equal."""
    x = a ^ b
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += (x >> U64(64 - 8 * k)) == 0
    return out


def interval_tree(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of common-prefix intervals of at least that depth, by a stack scan over the lengths.

    Returns depth, first, last and parent (-1: none) of each interval, and for each place the interval of which
    its common prefix is the depth (-1: less than ``least``). Places with equal lengths that follow each other
    are one step of the scan; a stretch of one such step, between smaller lengths, is an interval as it is.
    """
    n = len(lcp)
    value = np.where(lcp >= least, lcp, 0)
    value[:1] = 0
    begin = np.flatnonzero(np.append([True], value[1:] != value[:-1])) if n else np.zeros(0, np.int64)
    end, value = np.append(begin[1:], n)[: len(begin)], value[begin]
    before, behind = np.append([0], value[:-1])[: len(value)], np.append(value[1:], 0)[: len(value)]
    flat = (value > 0) & (before == 0) & (behind == 0)
    of_step = np.full(len(value), -1)
    of_step[flat] = np.arange(flat.sum())
    depth, first, last = value[flat].tolist(), (begin[flat] - 1).tolist(), (end[flat] - 1).tolist()
    parent = [-1] * len(depth)
    # the other stretches, each with the step that ends it
    deep = np.flatnonzero(~flat & ((value > 0) | (before > 0) & np.append([False], ~flat[:-1])[: len(flat)]))
    stack: list[int] = []
    for step, v, at in zip(deep.tolist(), value[deep].tolist(), begin[deep].tolist()):
        start, under = at - 1, -1
        while stack and depth[stack[-1]] > v:
            x = stack.pop()
            start, last[x] = first[x], at - 1
            if stack and depth[stack[-1]] >= v:
                parent[x] = stack[-1]
            else:
                under = x
        if v:
            if not stack or depth[stack[-1]] < v:
                stack.append(len(depth))
                depth.append(v)
                first.append(start)
                last.append(n - 1)
                parent.append(-1)
                if under >= 0:
                    parent[under] = stack[-1]
            of_step[step] = stack[-1]
    while stack:
        x = stack.pop()
        parent[x] = stack[-1] if stack else -1
    of_place = np.repeat(of_step, end - begin)
    return (*(np.array(c, np.int64) for c in (depth, first, last, parent)), of_place)


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first, last) of the common-prefix intervals of at least that depth."""
    return interval_tree(lcp, least)[:3]


def maximal_depths(lcp: np.ndarray, left: np.ndarray, outer: np.ndarray, least: int) -> np.ndarray:
    """Of each suffix in order the depth of the deepest maximal repeat that it is an occurrence of, 0 if none.

    left: the bytes before the suffixes; outer: whether what stands before a suffix is not known here.
    """
    n = len(lcp)
    depth, first, last, parent, of_place = interval_tree(lcp, least)
    if not len(depth):
        return np.zeros(n, np.int64)
    changes, open_ = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    np.cumsum(left[1:] != left[:-1], out=changes[1:])
    np.cumsum(outer | (left == START), out=open_[1:])
    diverse = (changes[last] > changes[first]) | (open_[last + 1] > open_[first])
    none = len(depth)  # what has no maximal repeat around it
    up = np.append(np.where(diverse, np.arange(none), np.where(parent < 0, none, parent)), none)
    while (up[up] != up).any():
        up = up[up]
    # each suffix lies directly in the deeper one of the intervals with its neighbours
    behind = np.append(lcp[1:], 0)
    at = np.where(lcp >= behind, of_place, np.append(of_place[1:], -1))
    return np.append(depth, 0)[up[np.where(at < 0, none, at)]]


class Contexts:
    """Contexts put end to end (each a preceding byte and then text) and all their LENGTH-byte strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, use: np.ndarray):
        self.data, self.offsets, self.length = data, offsets, length
        which = np.flatnonzero(use)
        runs = np.diff(offsets)[which] - length
        self.owner = np.repeat(which, runs)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        self.starts = offsets[self.owner] + 1 + self.place
        self.hashes = span_hash(prefix_hash(data), self.starts, self.starts + length)
        # strings with equal hashes side by side; the others cannot repeat
        order = np.argsort(self.hashes, kind="stable")
        h = self.hashes[order]
        same = np.append([False], h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
        again = same | np.append(same[1:], False)[: len(same)]
        self.lone, self.pick = order[~again], order[again]
        sizes = offsets[self.owner[self.pick] + 1] - self.starts[self.pick]
        sorted_, self.lcp = suffix_array(data, self.starts[self.pick], sizes, h[again])
        self.pick = self.pick[sorted_]  # the suffix array

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, start, end): the stretches of text that occurrences of maximal repeats cover, in order."""
        left = self.data[self.starts[self.pick] - 1]
        depth = maximal_depths(self.lcp, left, self.place[self.pick] == 0, self.length)
        some = np.flatnonzero(depth)
        index = self.pick[some]
        back = np.argsort(index)
        index, end = index[back], self.starts[index[back]] + depth[some][back]
        owner, begin, end = merged(self.owner[index], self.starts[index], end)
        base = self.offsets[owner] + 1
        return owner, begin - base, end - base

    def diverse(self) -> np.ndarray:
        """The strings (by number) that repeat and are not all preceded by the same byte."""
        cut = np.append(self.lcp < self.length, True)
        left = self.data[self.starts[self.pick] - 1]
        out = np.zeros(len(self.pick), bool)
        if len(self.pick):
            at = np.flatnonzero(cut[:-1])
            members = np.diff(np.append(at, len(self.pick)))
            low, high = np.minimum.reduceat(left, at), np.maximum.reduceat(left, at)
            out = np.repeat((members > 1) & ((low != high) | (high == START)), members)
        return np.sort(self.pick[out])

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(one string of each distinct one, whether it is the only one)."""
        head = self.pick[self.lcp < self.length] if len(self.pick) else self.pick
        alone = np.append(self.lcp[1:] < self.length, True)[self.lcp < self.length] if len(self.pick) else np.zeros(0, bool)
        return np.append(self.lone, head), np.append(np.ones(len(self.lone), bool), alone)

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each of the strings."""
        other = span_hash(prefix_hash(self.data ^ np.uint8(0x5A)), self.starts[which], self.starts[which] + self.length)
        return self.hashes[which].view(np.int64), other.view(np.int64)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches sorted by start, with those that meet put together; those of different owners never meet."""
    if not len(start):
        return owner, start, end
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero((start[1:] > reach[:-1]) | (owner[1:] != owner[:-1]))
    return owner[np.append([0], cut + 1)], start[np.append([0], cut + 1)], reach[np.append(cut, len(start) - 1)]


def _lists(owner: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(the distinct owners, for each the list of its rows' values, row by row)."""
    at = np.flatnonzero(np.append([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    flat = np.stack(columns, 1).astype(np.int32).ravel()
    return owner[at], pa.ListArray.from_arrays(pa.array((np.append(at, len(owner)) * len(columns)).astype(np.int32)), pa.array(flat))


# ------------------------------------------------------------------ in parallel

_ROW = ("k1", "k2")


def _rows(df: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, text (not null), and two hashes of both that name the row."""
    rows = df.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"))


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def build(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for i, j in steps(offsets, TEXT_BYTES):
                row, first, last, anchor = anchor_runs(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchor.view(np.int64))], [*_ROW, "first", "last", "anchor"]
                )

    return rows.select(*_ROW, "text").mapInArrow(build, "k1 long, k2 long, first int, last int, anchor long")


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """k1, k2, first, anchor, cid (of the context) and, once for some MB of contexts, the context and its number."""

    def build(batches):
        out, texts, copies = [], [], []
        seen: dict[tuple[int, bytes], int] = {}
        size = 0

        def emit():
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            batch = pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary()), pa.array(copies, pa.int64())], [*_ROW, "first", "anchor", "cid", "context", "copies"])
            for x in (out, texts, copies, seen):
                x.clear()
            return batch

        for batch in batches:
            for k1, k2, text, runs in zip(*(batch.column(c).to_pylist() for c in range(4))):
                data = text.encode()
                for run in runs:
                    a, b, anchor = run["first"], run["last"], run["anchor"]
                    context = data[a - 1 : b + length] if a else bytes([START]) + data[: b + length]
                    known = seen.get((anchor, context))
                    cid = int.from_bytes(hashlib.blake2b(context, digest_size=8).digest(), "little", signed=True)
                    if known is None:
                        seen[anchor, context] = len(texts)
                        texts.append(context)
                        copies.append(1)
                        size += len(context)
                    else:
                        copies[known] += 1
                        texts.append(None)
                        copies.append(0)
                    out.append((k1, k2, a, anchor, cid))
                    if size >= COMBINE_BYTES or len(out) >= COMBINE_ROWS:
                        yield emit()
                        size = 0
        yield emit()

    return rows.mapInArrow(build, "k1 long, k2 long, first int, anchor long, cid long, context binary, copies long")


_FOUND = "anchor long, cid long, ranges array<int>, diverse array<int>, s1 long, s2 long, place int, left int, copies long"


def scan_contexts(anchor, cid, copies, part, data, offsets, length: int, left: bool) -> list[pa.RecordBatch]:
    """What the suffix array of these contexts (sorted by anchor) tells, as rows of _FOUND.

    ranges: the covered stretches of a context; diverse (if ``left``): ranges of the places of left-diverse strings;
    s1, s2, place, left, copies: a string handed on by an anchor in parts (cid is null if it repeats here).
    """
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())))
    out = []

    def rows(n: int, **columns) -> None:
        if n:
            given = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds[c]) for c, x in columns.items()}
            out.append(pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kinds[c]) for c in names], names))

    sizes = np.diff(offsets)
    change = np.append([True], anchor[1:] != anchor[:-1]) if len(anchor) else np.zeros(0, bool)
    alone = change & np.append(change[1:], True) & (part < 0) if len(anchor) else change
    c = Contexts(data, offsets, length, ~alone)
    # a context with copies is an occurrence of the repeat that it is itself, whole
    whole = np.flatnonzero(copies > 1)
    owner, start, end = c.covered()
    other = copies[owner] == 1
    owner, start, end = (np.append(x, y[other]) for x, y in ((whole, owner), (np.zeros(len(whole), np.int64), start), (sizes[whole] - 1, end)))
    order = np.argsort(owner, kind="stable")
    which, ranges = _lists(owner[order], start[order], end[order])
    rows(len(which), anchor=anchor[which], cid=cid[which], ranges=ranges)
    if left:
        index = c.diverse()
        begins = whole[data[offsets[whole]] == START]  # documents that begin alike
        owner, place = np.append(c.owner[index], begins), np.append(c.place[index], np.zeros(len(begins), np.int64))
        order = np.lexsort((place, owner))
        at = offsets[owner[order]] + place[order]
        owner, first, last = merged(owner[order], at, at + 1)
        which, ranges = _lists(owner, first - offsets[owner], last - 1 - offsets[owner])
        rows(len(which), anchor=anchor[which], cid=cid[which], diverse=ranges)
    index, only = (np.arange(len(c.owner)), np.ones(len(c.owner), bool)) if left else c.classes()
    keep = part[c.owner[index]] >= 0
    index, only = index[keep], only[keep]
    if len(index):
        s1, s2 = c.digests(index)
        own = c.owner[index]
        more = {"left": data[c.starts[index] - 1], "copies": copies[own]} if left else {}
        rows(len(index), anchor=anchor[own], cid=pa.array(cid[own], mask=~only), s1=s1, s2=s2, place=c.place[index], **more)
    return out


def _scan(dealt: DataFrame, length: int, left: bool) -> DataFrame:
    """scan_contexts over (anchor, cid, context, copies, part) sorted by anchor and part; an anchor, or a part of one,
    has a bounded size, and whole ones are gathered to CONTEXT_BYTES."""

    def scan(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.RecordBatch):
            data, offsets = _binary(rows.column(2))
            anchor, cid, copies, part = (np.asarray(rows.column(k)) for k in (0, 1, 3, 4))
            yield from scan_contexts(anchor, cid, copies, part, data, offsets, length, left)

        def together() -> pa.RecordBatch:
            return waiting[0] if len(waiting) == 1 else pa.concat_batches(waiting)

        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size < CONTEXT_BYTES:
                continue
            rows = together()
            offsets = _binary(rows.column(2))[1]
            anchor, part = np.asarray(rows.column(0)), np.asarray(rows.column(4))
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            at = 0
            while len(cuts) and offsets[cuts[-1]] - offsets[at] >= CONTEXT_BYTES:
                k = cuts[min(np.searchsorted(offsets[cuts], offsets[at] + CONTEXT_BYTES), len(cuts) - 1)]
                yield from solve(rows.slice(at, k - at))
                at = k
                cuts = cuts[cuts > at]
            waiting = [rows.slice(at)]
            size = int(offsets[-1] - offsets[at])
        if waiting:
            yield from solve(together())

    return dealt.select("anchor", "cid", "context", "copies", "part").mapInArrow(scan, _FOUND)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(column)
    return np.ascontiguousarray(raw), offsets


def _release(spark) -> None:
    """Let Spark drop the shuffle files of stages whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_ranges(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, anchor_bytes: int = ANCHOR_BYTES, left: bool = False) -> DataFrame:
    """k1, k2, hits: per document and context its first byte's place and the stretches (start, end, from there) that
    maximal repeats cover; documents without any have no row. rows: those of ``_rows``.

    With ``left`` each context also has the starts of left-diverse strings (``diverse``, as first and last of runs).
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as scratch:
        anchors = scratch.written(_anchors(rows, length, gram))
        # written, so that its join below has plain exchanges, whose hot partitions AQE can split
        often = scratch.written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
        # written, so that the anchors and their shuffles are gone before the texts are shuffled
        runs = scratch.written(anchors.join(often, "anchor", "left_semi").groupBy(*_ROW).agg(F.collect_list(F.struct("first", "last", "anchor")).alias("runs")))
        scratch.done(anchors, often)
        _release(spark)
        once = rows.select(*_ROW, "text").join(runs, list(_ROW)).select(*_ROW, "text", "runs")
        places = scratch.written(_contexts(once, length))
        scratch.done(runs)
        del once
        _release(spark)
        # equal contexts together, with partial sums on the map side
        whole = scratch.written(places.filter("context is not null").groupBy("anchor", "cid").agg(F.first("context").alias("context"), F.sum("copies").alias("copies")))
        _release(spark)
        # anchors with too many contexts are dealt out in parts
        parts = F.ceil(F.greatest(F.sum(F.octet_length("context")) / anchor_bytes, F.count("*") / ANCHOR_ROWS)).cast("long")
        large = scratch.written(whole.groupBy("anchor").agg(parts.alias("parts")).filter("parts > 1"))
        part = F.coalesce(F.pmod("cid", "parts"), F.lit(-1)).cast("int").alias("part")
        dealt = whole.join(large, "anchor", "left").select("anchor", "cid", "context", "copies", part)
        found = scratch.written(_scan(dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), length, left))
        scratch.done(whole, large)
        del dealt
        _release(spark)
        inside = found.filter("ranges is not null").select("anchor", "cid", "ranges")
        handed = found.filter("s1 is not null")
        again = handed.groupBy("s1", "s2").agg(F.count("*").alias("n")).filter("n > 1").select("s1", "s2")
        across = handed.filter("cid is not null").join(again, ["s1", "s2"], "left_semi").select("anchor", "cid", F.array(F.col("place"), F.col("place") + length).alias("ranges"))
        columns, both = ["ranges"], inside.union(across)
        if left:
            columns = ["ranges", "diverse"]
            same = found.filter("diverse is not null").select("anchor", "cid", "diverse")
            strings = handed.groupBy("s1", "s2").agg(F.sum("copies").alias("n"), F.min("left").alias("lo"), F.max("left").alias("hi"))
            strings = strings.filter(f"n > 1 and (lo < hi or hi = {START})").select("s1", "s2")
            apart = handed.join(strings, ["s1", "s2"], "left_semi").select("anchor", "cid", F.array("place", "place").alias("diverse"))
            both = both.unionByName(same.union(apart), allowMissingColumns=True)
        flagged = scratch.written(both.groupBy("anchor", "cid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in columns)))
        hits = places.select(*_ROW, "first", "anchor", "cid").join(flagged, ["anchor", "cid"])
        out = written(hits.groupBy(*_ROW).agg(F.collect_list(F.struct("first", *columns)).alias("hits")))
    _release(spark)
    return out


def _removed(hits: list | None) -> list[tuple[int, int]]:
    """Merged (start, end) byte runs that the hits cover."""
    if not hits:
        return []
    pairs = np.array([(h["first"] + r[k], h["first"] + r[k + 1]) for h in hits for r in (h["ranges"],) for k in range(0, len(r), 2)], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    _, start, end = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    return list(zip(start.tolist(), end.tolist()))


def _suffixes(rows: DataFrame, length: int) -> DataFrame:
    """From (doc_id, text, hits): key (digest of the first ``length`` bytes), doc_id, start, left (the byte before)
    and suffix (the text as far as strings repeat without a gap) of each left-diverse start."""

    def batch_of(out, kind):
        kinds = (pa.binary(), kind, pa.int32(), pa.int32(), pa.binary())
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "doc_id", "start", "left", "suffix"])

    def build(batches):
        for batch in batches:
            out, size = [], 0
            for doc, text, hits in zip(*(batch.column(c).to_pylist() for c in range(3))):
                data = text.encode()
                runs = _removed(hits)
                starts = sorted({h["first"] + p for h in hits for d in (h["diverse"],) for k in range(0, len(d), 2) for p in range(d[k], d[k + 1] + 1)})
                run = 0
                for at in starts:
                    while runs[run][1] <= at:
                        run += 1
                    suffix = data[at : runs[run][1]]
                    out.append((hashlib.blake2b(suffix[:length], digest_size=16).digest(), doc, at, data[at - 1] if at else START, suffix))
                    size += len(suffix)
                    if size >= CONTEXT_BYTES:
                        yield batch_of(out, batch.column(0).type)
                        out, size = [], 0
            yield batch_of(out, batch.column(0).type)

    return rows.mapInArrow(build, f"key binary, doc_id {dict(rows.dtypes)['doc_id']}, start int, left int, suffix binary")


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def maximal_repeats(df: DataFrame, *, length: int = LENGTH, gram: int = GRAM, anchor_bytes: int = ANCHOR_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """repeat_id (digest of the bytes), length, doc_id and start (in bytes) of every occurrence of every maximal
    repeat of at least ``length`` bytes: one that occurs more than once and whose occurrences have neither the
    same byte before them nor the same byte after them.

    Nested repeats are all listed, so the result can be far longer than the texts: a cluster of near copies
    has as many repeats as pairs of edits. Suffixes with the same first ``length`` bytes go to one task.
    """
    rows = _rows(df, id, text)
    hits = repeated_ranges(rows, length=length, gram=gram, anchor_bytes=anchor_bytes, left=True)
    suffixes = _suffixes(rows.join(hits, list(_ROW)).select("doc_id", "text", "hits"), length)
    kind = dict(rows.dtypes)["doc_id"]

    def extend(batches):
        key, docs, starts, left, lcp, last, firsts = None, [], [], [], [], b"", []

        def close(doc_type):
            """The repeats of the group just read, in batches."""
            for depth, a, b in zip(*(x.tolist() for x in lcp_intervals(np.array(lcp, np.int64), length))):
                before = set(left[a : b + 1])
                if len(before) > 1 or START in before:
                    name = hashlib.blake2b(firsts[a][:depth], digest_size=16).hexdigest()
                    n = b - a + 1
                    columns = [pa.array([name] * n), pa.array([depth] * n, pa.int32()), pa.array(docs[a : b + 1], doc_type), pa.array(starts[a : b + 1], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["repeat_id", "length", "doc_id", "start"])

        doc_type = None
        for batch in batches:
            doc_type = batch.column(1).type
            for k, doc, start, byte, suffix in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if k != key:
                    yield from close(doc_type)
                    key, docs, starts, left, lcp, last, firsts = k, [], [], [], [], b"", []
                lcp.append(_common(last, suffix) if docs else 0)
                # equal suffixes are kept once
                last = last if len(suffix) == len(last) == lcp[-1] else suffix
                firsts.append(last)
                docs.append(doc)
                starts.append(start)
                left.append(byte)
        if docs:
            yield from close(doc_type)

    ordered = suffixes.repartition("key").sortWithinPartitions("key", "suffix")
    return ordered.mapInArrow(extend, f"repeat_id string, length int, doc_id {kind}, start int")


def remove_repeats(df: DataFrame, *, length: int = LENGTH, gram: int = GRAM, anchor_bytes: int = ANCHOR_BYTES, id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    Rows that repeat an id and its text are found by their names first. One of them stands for all in the search, so that
    work does not grow with their number; each of them repeats whole if it has ``length`` bytes.
    """
    rows = _rows(df, id, text)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    repeated = written(rows.groupBy(*_ROW).agg(F.count("*").alias("n")).filter("n > 1").select(*_ROW))
    once, again = rows, None
    if not repeated.isEmpty():
        once, again = rows.join(repeated, list(_ROW), "left_anti"), rows.join(repeated, list(_ROW), "left_semi")
    searched = once if again is None else once.unionByName(again.dropDuplicates(list(_ROW)))
    hits = repeated_ranges(searched, length=length, gram=gram, anchor_bytes=anchor_bytes)

    def build(batches):
        for batch in batches:
            out = []
            for text_, found, whole in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                data = text_.encode()
                spans = _removed(found) if not whole else [(0, len(data))] if len(data) >= length else []
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in list(zip(columns, kinds))[: len(names) - 1])], names)

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    judged = once.join(hits, list(_ROW), "left").select("doc_id", "text", "hits", F.lit(False).alias("whole"))
    if again is not None:
        judged = judged.unionByName(again.select("doc_id", "text", F.lit(True).alias("whole")), allowMissingColumns=True)
    return judged.select("doc_id", "text", "hits", "whole").mapInArrow(build, schema)
