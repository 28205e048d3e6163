"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from twinlake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "th", "e", " ", "  ", "   ", "\n", "▁", "é", "日", "本", "🙂", "\x00", "\t", ".", "0", "the ", "tion", "<s>", "<0x41>", "ing", "ß", "한", "‏", "́", " " * 17]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.read_model(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    point = lambda: chr(rng.choice([rng.randint(0, 127), rng.randint(0x80, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return mixed + ["".join(point() for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_equals_the_library(vocabulary, library):
    edge = ["", None, " ", "  ", "▁", "\n", " " * 100, " " * 3 + "x", "a" * 999, "ab" * 700, "▁" * 33 + "x", "=" * 77]
    texts = edge + random_texts(800)
    got = vocabulary.encode(texts)
    want = [library.encode(t or "") for t in texts]
    assert got == want
    assert [vocabulary.decode(x) for x in got] == [library.decode(x) for x in want]
    words = vocabulary.words_of(texts)
    assert [b"".join(d for _, _, d in w).removeprefix(b" ").decode() for w in words] == [library.decode(x) for x in want]


def test_decodes_any_ids(vocabulary, library):
    rng = random.Random(4)
    for top in (400, 31_999):
        for _ in range(500):
            ids = [rng.randint(0, top) for _ in range(10)]
            assert vocabulary.decode(ids) == library.decode(ids)


def test_long_words(vocabulary, library):
    rng = random.Random(5)
    for text in ("x" * 30_000, "".join(rng.choice("abcdefghij") for _ in range(30_000)), " " * 20_000 + "q", "über" * 9_000):
        assert vocabulary.encode([text]) == [library.encode(text)]


def test_ties_wait_for_the_merge_at_their_left(library):
    """Rounds without the queue give the same merges."""
    v = pieces.Vocabulary(pieces.read_model(MODEL))
    v._queue = None  # never reached
    for n in range(1, 32):
        assert v.encode([" " * n + "the"]) == [library.encode(" " * n + "the")]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(b"")


def test_query(spark, edge, nothing, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(map(tuple, pieces.digests(edge, MODEL).collect()), key=str)
    want = []
    for row in edge.collect():
        ids = library.encode(row.text or "")
        want.append((row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    assert pieces.digests(nothing, MODEL).collect() == []
    full = {(r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode(edge.filter("length(text) < 99"), MODEL).collect()}
    assert full == {(r.doc_id, tuple(library.encode(r.text)), r.text) for r in edge.filter("length(text) < 99").collect()}


def test_the_memory_of_words_changes_nothing(vocabulary, monkeypatch, library):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 3)
    texts = random_texts(50, 9)
    assert vocabulary.encode(texts) + vocabulary.encode(texts) == [library.encode(t) for t in texts] * 2


def test_a_word_is_encoded_once_whatever_stands_beside_it(vocabulary, monkeypatch, library):
    """Of 4,000 words with marks around them, only the 40 different ones and the marks go through the merges."""
    v = pieces.Vocabulary(pieces.read_model(MODEL))
    seen, merge = [], v.merge
    monkeypatch.setattr(v, "merge", lambda codes, starts: seen.append(len(codes)) or merge(codes, starts))
    texts = [" ".join(f"{'abcdefghij'[i]}ous{'klmn'[j]}eth{mark}" for mark in "+~*^|{}\"`;" for i in range(10) for j in range(4)) for _ in range(10)]
    assert v.encode(texts) == [library.encode(t) for t in texts]
    assert sum(seen) < 1_000
    seen.clear()
    assert v.encode(texts) == [library.encode(t) for t in texts]
    assert sum(seen) == 0  # remembered


def test_words_met_most_are_remembered(monkeypatch, library):
    v = pieces.Vocabulary(pieces.read_model(MODEL))
    monkeypatch.setattr(pieces, "MEMO_WORDS", 40)
    seen, merge = [], v.merge
    monkeypatch.setattr(v, "merge", lambda codes, starts: seen.append(len(codes)) or merge(codes, starts))
    often = "often told stories " * 9
    for i in range(5):
        texts = [often + " ".join(f"{c}{'xyzuv'[i]}{d}ng" for c in "bcdfghj" for d in "aeiou")]
        assert v.encode(texts) == [library.encode(t) for t in texts]
    seen.clear()
    assert v.encode([often.strip()]) == [library.encode(often.strip())]
    assert sum(seen) == 0


def test_sizes_of_steps_and_tables_change_nothing(monkeypatch, library):
    for name, value in (("ROUND_CHARS", 7), ("TOUCH_CHARS", 3), ("NEAR", 5)):
        monkeypatch.setattr(pieces, name, value)
    v = pieces.Vocabulary(pieces.read_model(MODEL))
    texts = random_texts(60, 12) + ["", None, "x", " "]
    assert v.encode(texts) == [library.encode(t or "") for t in texts]


def test_places_of_keys():
    rng = random.Random(6)
    keys = pieces.np.array(sorted({rng.randrange(1 << 42) for _ in range(5_000)}), pieces.np.int64)
    place = pieces._Places(keys)
    assert (place(keys) == pieces.np.arange(len(keys))).all()
    other = pieces.np.setdiff1d(pieces.np.array([rng.randrange(1 << 42) for _ in range(50_000)], pieces.np.int64), keys)
    assert (place(other) == len(keys)).all()
    assert place(keys[:0]).tolist() == []


def test_rows_of_one_batch_in_several_groups(spark, library):
    """Texts beyond one group of characters, with a null and an empty text at the borders."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    big = "tall trees, 12 of them " * 100_000
    rows = [(0, None), (1, big), (2, ""), (3, big + "!"), (4, None), (5, "▁▁ end"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, pieces.digests(docs, MODEL).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
