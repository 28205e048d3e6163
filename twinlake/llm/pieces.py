"""Encoding and decoding with a public sentencepiece BPE vocabulary, by vectorised merge rounds.

A text is normalised as the vocabulary says (a space becomes U+2581, one is put in front) and cut into words
where no piece of the vocabulary can reach across: between characters that are neighbours in no piece. The merges of
a word depend on the word alone, so of the words of many texts, which are one flat array, Arrow tells the different
ones, and a worker encodes those that it does not remember:

1. The characters of all new words are one flat numpy array of symbols.
2. A round takes in each word the pairs of the smallest rank (rank: place of the merged piece's score) and merges
   them at the same time from the left, overlapping ones left out. Where a merge makes a pair that is as good as the
   one just merged, one queue would take that next: the merges to its right wait for the next round.
3. The arrays are compacted, words without a pair leave them, until no pair remains. A word in which merge
   after merge waits like that (a long run of spaces, whose pieces all have one score) is finished by a queue, as
   rounds of one merge each would take quadratic time.

Ids, their decimal digits and what they decode to are then put together for whole groups of texts by taking from
the columns of the different words.

Characters that are no piece become the ids of their UTF-8 bytes. Results equal those of the sentencepiece library,
without begin and end ids and without sampling.

Cases: null and empty texts have no ids; equal texts have equal results, rows may repeat; rows without an id pass;
an empty table gives an empty result; columns beside ``doc_id`` and ``text`` are not looked at. Texts of any length are
encoded whole. A model of another kind (no BPE, no byte pieces, another normaliser, user-defined pieces) is refused.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from twinlake.llm.common import bounded_batches, steps

SPACE = "▁"
#: Words that a worker remembers, and the longest of them in characters. Bounds of memory only: other words are encoded anew.
MEMO_WORDS, MEMO_CHARS = 200_000, 64
#: Rounds of one word that ended early, after which a queue finishes it.
WAITS = 32
#: Characters that go through the rounds together (a longer word alone).
ROUND_CHARS = 1 << 17
#: Characters of texts that are taken together (a longer text alone).
GROUP_CHARS = 1 << 22
#: Characters whose neighbours are looked up in one step.
TOUCH_CHARS = 1 << 17
#: Characters whose neighbours are looked up in a square table; those of further characters by search.
NEAR = 1_000
_NO_RANK = np.int32(2**31 - 1)
_BITS = 21


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _fields(data: bytes):
    """(field number, value) of one protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[i : i + n]
            i += n


class _Places:
    """Place of int64 keys in a fixed table, by hashing; the number of keys where absent."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(10, (8 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.append(keys, -1)
        self.slots = np.full(1 << bits, len(keys), np.int32)
        for k, at in enumerate(self._home(keys).tolist()):
            while self.slots[at] < len(keys):
                at = (at + 1) & self.last
            self.slots[at] = k

    def _home(self, asked: np.ndarray) -> np.ndarray:
        return ((asked.view(np.uint64) * self.FACTOR) >> self.shift).view(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self._home(asked)
        out = self.slots[at]
        none = len(self.keys) - 1
        left = np.flatnonzero((self.keys[out] != asked) & (out < none))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            out[left] = found = self.slots[at[left]]
            left = left[(self.keys[found] != asked[left]) & (found < none)]
        return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first..first+size of all ranges, end to end."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _binary(data, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """The strings data[offsets[i]:offsets[i + 1]], not copied."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


def _parts(column: pa.LargeBinaryArray) -> tuple[pa.Buffer, np.ndarray]:
    """(bytes, offsets) of a column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return data or pa.py_buffer(b""), at


class Encoded:
    """Words of texts. Text t has the words which[bounds[t]:bounds[t + 1]], places among the different words; of these,
    word k has the ids ids[first[k]:first[k + 1]]."""

    def __init__(self, bounds: np.ndarray, which: np.ndarray, ids: np.ndarray, first: np.ndarray):
        self.bounds, self.which, self.ids, self.first = bounds, which, ids, first
        self.counts = np.diff(first)

    def strings(self, of_id: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """For each different word the strings of its ids end to end; of_id: the string of each id."""
        data, offsets = _parts(of_id.take(pa.array(self.ids)))
        return _binary(data, offsets[self.first])

    def joined(self, of_id: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """For each text the strings of its ids end to end."""
        data, offsets = _parts(self.strings(of_id).take(pa.array(self.which)))
        return _binary(data, offsets[self.bounds])

    def totals(self) -> np.ndarray:
        """For each text its number of ids."""
        sums = np.append(0, np.cumsum(self.counts[self.which]))
        return np.diff(sums[self.bounds])


class Vocabulary:
    """The pieces of a model with the tables of the rounds. ``model``: the bytes of its file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds, trainer, normal = [], [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                kinds.append(piece.get(3, 1))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        byte_ids = [i for i, k in enumerate(kinds) if k == 6]
        plain = normal.get(1) == b"identity" and not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
        if trainer.get(3) != 2 or len(byte_ids) != 256 or not plain or trainer.get(24) or {4, 5} & set(kinds):
            raise ValueError("not a BPE model with byte pieces, an identity normaliser and normal pieces only")
        self.kinds = np.array(kinds)
        self.of_byte = np.array(byte_ids)
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        #: What each id decodes to (byte pieces: that byte; control pieces: nothing).
        self.decoded = [bytes([self.byte_of[i]]) if k == 6 else b"" if k == 3 else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, kinds))]
        if 2 in kinds:
            self.decoded[kinds.index(2)] = trainer.get(44, " ⁇ ".encode())
        self.decoded_column = pa.array(self.decoded, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(self.pieces))], pa.large_binary())
        self.n = len(self.pieces)
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.of_char = np.arange(self.n, self.n + 0x110000, dtype=np.int32)  # a character that is no piece has a symbol of its own
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        ranks = {s: r for r, s in enumerate(sorted({float(scores[i]) for i in ids.values()}, reverse=True))}
        symbol = lambda x: ids.get(x, int(self.of_char[ord(x)]) if len(x) == 1 else None)
        pairs, touching = {}, set()
        for p, i in ids.items():
            for c, d in zip(p, p[1:]):
                touching.add(ord(c) << _BITS | ord(d))
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    pairs[left << _BITS | right] = (ranks[float(scores[i])], i)
        self.of_pair = pairs.get
        self.place = _Places(np.array(sorted(pairs), np.int64))
        found = [pairs[k] for k in sorted(pairs)] + [(_NO_RANK, 0)]
        self.ranks = np.array([r for r, _ in found], np.int32)
        self.merged = np.array([i for _, i in found], np.int32)
        self.touching = np.array(sorted(touching), np.int64)
        self._classes()
        self._forget()

    def _classes(self) -> None:
        """Classes of characters: 0 has no neighbour in a piece, the last one is looked up in touching, near is for the others."""
        left, right = self.touching >> _BITS, self.touching & ((1 << _BITS) - 1)
        chars, often = np.unique(np.concatenate([left, right]), return_counts=True)
        self.side = min(len(chars), NEAR) + 2
        self.all_near = len(chars) <= NEAR
        self.of_class = np.zeros(0x110000, np.int32)
        self.of_class[chars[np.argsort(-often, kind="stable")]] = np.minimum(np.arange(len(chars)) + 1, self.side - 1)
        self.near = np.zeros(self.side * self.side, bool)
        self.near[self.of_class[left] * self.side + self.of_class[right]] = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the piece that both make, its id); no rank where they make none."""
        k = self.place(left.astype(np.int64) << _BITS | right)
        return self.ranks[k], self.merged[k]

    def touch(self, codes: np.ndarray) -> np.ndarray:
        """Whether each character and the next one are neighbours in a piece."""
        if len(codes) > 1:
            return np.concatenate([self._touch(codes[a : a + TOUCH_CHARS + 1]) for a in range(0, len(codes) - 1, TOUCH_CHARS)])
        return np.zeros(0, bool)

    def _touch(self, codes: np.ndarray) -> np.ndarray:
        kind = self.of_class[codes]
        out = self.near[kind[:-1] * self.side + kind[1:]]
        if not self.all_near:
            far = kind == self.side - 1
            far = np.flatnonzero((far[:-1] | far[1:]) & (kind[:-1] > 0) & (kind[1:] > 0))
            asked = codes[far].astype(np.int64) << _BITS | codes[far + 1]
            out[far] = self.touching[np.minimum(np.searchsorted(self.touching, asked), len(self.touching) - 1)] == asked
        return out

    # ------------------------------------------------------------------ rounds

    def _queue(self, sym: list[int]) -> list[int]:
        """The same merges by a queue of (rank, place), for one word."""
        n = len(sym)
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
        heap: list = []

        def offer(i):
            j = after[i] if i >= 0 else n
            if j < n:
                rank, made = self.of_pair(sym[i] << _BITS | sym[j], (0, -1))
                if made >= 0:
                    heap.append((rank, i, j, live[i], live[j], made))
                    return True
            return False

        for i in range(n):
            offer(i)
        heapify(heap)
        while heap:
            _, i, j, a, b, made = heappop(heap)
            if live[i] != a or live[j] != b:
                continue
            sym[i], live[i], live[j], after[i] = made, live[i] + 1, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if offer(k):
                    heappush(heap, heap.pop())
        return [s if live[i] >= 0 else -1 for i, s in enumerate(sym)]

    def merge(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """codes: characters of words end to end, which begin at starts. Symbols after all merges; -1 where a character was merged away."""
        out = self.of_char[codes]
        sym = out.copy()
        cut = np.zeros(len(sym), bool)  # begins a word
        cut[starts] = True
        rank, made = np.full(len(sym), _NO_RANK), np.zeros(len(sym), np.int32)
        rank[:-1], made[:-1] = self.pair(sym[:-1], sym[1:])
        rank[:-1][cut[1:]] = _NO_RANK
        at, waits = np.arange(len(sym)), np.zeros(len(starts), np.int64)
        while len(sym):
            first = np.flatnonzero(cut)
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            # words that are done, or handed to the queue, leave
            slow = (waits > WAITS) & (best < _NO_RANK)
            for s in np.flatnonzero(slow):
                a, b = first[s], first[s] + size[s]
                sym[a:b] = self._queue(sym[a:b].tolist())
            done = slow | (best == _NO_RANK)
            if done.any():
                gone = np.repeat(done, size)
                out[at[gone]] = sym[gone]
                stay = ~gone
                sym, cut, rank, made, at = sym[stay], cut[stay], rank[stay], made[stay], at[stay]
                waits, best, size = waits[~done], best[~done], size[~done]
                if not len(sym):
                    break
            p = np.flatnonzero(rank == np.repeat(best, size))
            # of overlapping pairs every second one from the left
            head = np.ones(len(p), bool)
            head[1:] = np.diff(p) > 1
            p = p[(np.arange(len(p)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            new, low = made[p], rank[p]
            # what stands at both sides when the merge is done: merges at the left are done, those at the right not yet
            left = np.where(cut[p], np.int32(-1), sym[p - 1])
            follows = np.zeros(len(p), bool)
            follows[1:] = (p[1:] - p[:-1] == 2) & ~cut[p[1:]]
            left[follows] = new[:-1][follows[1:]]
            right = np.full(len(p), -1, np.int32)
            inner = np.flatnonzero(p + 2 < len(sym))
            inner = inner[~cut[p[inner] + 2]]
            right[inner] = sym[p[inner] + 2]
            to_left, to_right = np.full(len(p), _NO_RANK), np.full(len(p), _NO_RANK)
            for side, has in ((to_left, left >= 0), (to_right, right >= 0)):
                a, b = (left[has], new[has]) if side is to_left else (new[has], right[has])
                side[has] = self.pair(a, b)[0]
            bad = np.flatnonzero((to_left <= low) | (to_right <= low))
            if len(bad):
                group = np.cumsum(cut)[p] - 1
                limit = np.full(len(best), len(p))
                np.minimum.at(limit, group[bad], bad)
                keep = np.arange(len(p)) <= limit[group]
                waits[np.unique(group[bad])] += 1
                p, new = p[keep], new[keep]
            out[at[p + 1]] = -1
            sym[p] = new
            stay = np.ones(len(sym), bool)
            stay[p + 1] = False
            place = np.cumsum(stay) - 1
            sym, cut, rank, made, at = sym[stay], cut[stay], rank[stay], made[stay], at[stay]
            p = place[p]
            # pairs that changed: of a merged symbol with the next one, and of the one before with it
            changed = np.zeros(len(sym), bool)
            changed[p] = changed[p[~cut[p]] - 1] = True
            q = np.flatnonzero(changed)
            rank[q] = _NO_RANK
            q = q[q + 1 < len(sym)]
            q = q[~cut[q + 1]]
            rank[q], made[q] = self.pair(sym[q], sym[q + 1])
        return out

    def ids_of(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each word)."""
        sym = self.merge(codes, starts)
        width = np.ones(len(sym), np.int64)
        width[sym < 0] = 0
        odd = np.flatnonzero(sym >= self.n)  # in place of a character its bytes
        point = sym[odd] - self.n
        width[odd] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        ids = np.repeat(sym, width)
        first = np.cumsum(width) - width
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            here = width[odd] == n
            for k in range(n):
                bits = (point[here] >> 6 * (n - 1 - k)) & (0x3F if k else 0x7F)
                ids[first[odd[here]] + k] = self.of_byte[bits | (0x80 if k else lead)]
        return ids, np.add.reduceat(width, starts)

    # ------------------------------------------------------------------ texts

    def _forget(self) -> None:
        """No word is remembered. words: their characters, four bytes each; of word k, ids[first[k]:first[k + 1]]; uses: how often it was met."""
        self.known = {"words": pa.array([], pa.large_binary()), "ids": np.zeros(0, np.int32), "first": np.zeros(1, np.int64), "uses": np.zeros(0, np.int64)}

    def _remember(self, words: pa.LargeBinaryArray, ids: np.ndarray, first: np.ndarray, uses: np.ndarray) -> None:
        """Keep the words that are not too long; where they are too many, half of what may be kept, those met most."""
        keep = np.flatnonzero(np.diff(_parts(words)[1]) <= 4 * MEMO_CHARS)
        if len(keep) > MEMO_WORDS:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: MEMO_WORDS // 2]])
            uses = uses // 2
        counts = np.diff(first)[keep]
        self.known = {"words": words.take(pa.array(keep)), "ids": ids[_ranges(first[keep], counts)], "first": np.append(0, np.cumsum(counts)), "uses": uses[keep]}

    def words(self, texts: list[str | None]) -> Encoded:
        """The words of texts, all in one step."""
        full = [SPACE + t if t else "" for t in texts]
        codes = np.frombuffer("".join(full).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in full], dtype=np.int64)
        begins = np.ones(len(codes) + 1, bool)
        if len(codes):
            np.logical_not(self.touch(codes), out=begins[1:-1])
        begins[ends] = True
        at = np.flatnonzero(begins)
        bounds = np.append(0, np.searchsorted(at, ends))
        # which words differ; those remembered come first
        known = self.known
        n = len(known["words"])
        every = pa.concat_arrays([known["words"], _binary(pa.py_buffer(codes), 4 * at)]).dictionary_encode()
        words, which = every.dictionary, every.indices.to_numpy(zero_copy_only=False)
        fresh = np.ones(len(words), bool)
        fresh[which[:n]] = False
        fresh = np.flatnonzero(fresh)
        fresh = fresh[np.argsort(np.diff(_parts(words)[1])[fresh], kind="stable")]  # long words take many rounds: together
        data, offsets = _parts(words.take(pa.array(fresh)))
        new, offsets = np.frombuffer(data, np.uint32), offsets // 4
        ids, counts = [known["ids"]], [np.diff(known["first"])]
        for i, j in steps(offsets, ROUND_CHARS):
            own, size = self.ids_of(new[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
            ids.append(own)
            counts.append(size)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        # in the order of the dictionary
        order = np.empty(len(words), np.int64)
        order[which[:n]], order[fresh] = np.arange(n), np.arange(n, len(words))
        begin = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        ids, first = ids[_ranges(begin, counts)], np.append(0, np.cumsum(counts))
        uses = np.bincount(which[n:], minlength=len(words))
        uses[which[:n]] += known["uses"]
        self._remember(words, ids, first, uses)
        return Encoded(bounds, which[n:], ids, first)

    def words_of(self, texts: list[str | None]) -> list[list[tuple[int, bytes, bytes]]]:
        """For each text its words as (number of ids, ids joined by commas, what they decode to)."""
        w = self.words(texts)
        each = list(zip(w.counts.tolist(), [x[:-1] for x in w.strings(self.decimals).to_pylist()], w.strings(self.decoded_column).to_pylist()))
        return [[each[k] for k in w.which[a:b].tolist()] for a, b in zip(w.bounds, w.bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        w = self.words(texts)
        ids = w.ids[_ranges(w.first[w.which], w.counts[w.which])].tolist()
        ends = np.cumsum(w.totals()).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode() gives it."""
        parts, i, stripped = [], 0, False
        while i < len(ids):
            j = i
            while j < len(ids) and ids[j] in self.byte_of:
                j += 1
            if j > i:
                parts.append(_lenient(b"".join(self.decoded[x] for x in ids[i:j])))
                i = j
            else:
                piece = self.decoded[ids[i]].decode()
                if not stripped and not any(parts) and piece.startswith(" ") and self.kinds[ids[i]] == 1:
                    piece, stripped = piece[1:], True  # the space put in front of the text
                parts.append(piece)
                i += 1
        return "".join(parts)


def _lenient(data: bytes) -> str:
    """UTF-8, in which each byte that begins no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary for each model and process."""
    return Vocabulary(model)


def _batches(docs: DataFrame, model_path: str, schema: str, rows) -> DataFrame:
    """``rows(vocabulary, texts)`` gives the columns after doc_id of a list of texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))  # the file of a vocabulary, 0.5 MB here; executors need no copy of it
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        v = vocabulary(model.value)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, j in steps(np.append(0, np.cumsum(sizes, dtype=np.int64)), GROUP_CHARS):
                part = batch.slice(i, j - i)
                columns = rows(v, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {id_type}, {schema}")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded: every text encoded and decoded again."""

    def rows(v, texts):
        ids = v.encode(texts)
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([v.decode(x) for x in ids], pa.string())}

    return _batches(docs, model_path, "ids array<int>, decoded string", rows)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text)."""

    def rows(v, texts):
        w = v.words(texts)
        ids, decoded = w.joined(v.decimals), w.joined(v.decoded_column)
        sha = lambda column, cut: pa.array([hashlib.sha256(cut(memoryview(x.as_buffer()))).hexdigest() for x in column], pa.string())
        return {
            "n_tokens": pa.array(w.totals(), pa.int64()),
            "ids_sha256": sha(ids, lambda x: x[:-1]),  # no comma after the last one
            "decoded_sha256": sha(decoded, lambda x: x[1:] if x[:1] == b" " else x),  # without the space put in front
        }

    return _batches(docs, model_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
