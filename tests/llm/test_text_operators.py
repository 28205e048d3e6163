"""Operators that judge one text at a time, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlake.llm import common, license, media, pii, urlfilter

UP, LOW = bytes(range(65, 91)), bytes(range(97, 123))


def random_texts(n=60, seed=1):
    rng = random.Random(seed)
    pieces = ["The", "cc", "BY", "by.", "\n", "  ", "général", "12", "all-rights", "reserved", "general", "PUBLIC license", "é", "", "\x0b", "a", "🙂x"]
    return ["".join(rng.choice(pieces) + rng.choice([" ", "", "-", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("kind", "pattern"), [("SPACED", rb"[^\x20\x09-\x0d]+"), ("ALNUM", rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")])
def test_words_and_hashes(kind, pattern):
    texts = random_texts()
    seen = {}
    for i, j, words in common.words_of(pa.array(texts), getattr(common, kind), 200):
        h = words.hashes()
        for row in range(j - i):
            want = re.findall(pattern, texts[i + row].encode().translate(bytes.maketrans(UP, LOW)))
            a, b = words.bounds[row], words.bounds[row + 1]
            got = [bytes(words.data[s:e]) for s, e in zip(words.start[a:b], words.end[a:b])]
            assert got == want
            for w, x in zip(want, h[a:b].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert common.word_hash([b"cc", b"by"]).tolist() == [seen[b"cc"], seen[b"by"]]


def test_lookup():
    keys = common.mix(np.arange(1000, dtype=np.uint64))
    hit, which = common.Lookup(keys[:500])(keys[::-1].copy())
    assert (keys[::-1][hit] == keys[:500][which]).all() and len(hit) == 500
    assert len(common.Lookup(keys[:0])(keys)[0]) == 0


# ------------------------------------------------------------------ urls

ALLOW, BLOCK = ["org/", "com/fr/", "www.x.net/a/b"], ["example.org/es/", "example.org/en/1", "com/de/"]


def plain_verdict(host, path):
    fits = []
    for rules, verdict in ((ALLOW, "allow"), (BLOCK, "block")):
        for rule in rules:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), verdict == "block", rule, verdict))
    if fits:
        return max(fits)[2:]
    return None, "allow" if host and all(host.split(".")) else "block"


def test_urls_against_all_rules(spark):
    rng = random.Random(2)
    urls = [None, "", "nothing", "http://", "http:///x", "HTTP://Example.ORG/es/1?x#y", "http://a..org/", "x://org", "x://org?/en", "http://example.org/en/123"]
    hosts = ["example.org", "a.example.org", "org", "notexample.org", "x.com", "com", "www.x.net", "Ü.com", ".org"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es', '/es/', '/en/1', '/en/12/3', '/fr/', '/de/x', '/a/b', '/a/bc', '/a'])}{rng.choice(['', '?q=1', '#f'])}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r.page_id: r for r in urlfilter.filter_urls(df, ALLOW, BLOCK).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(UP.decode(), LOW.decode()))
        path = re.match(r"[^?#]*", re.sub(r"^[^/?#]*", "", rest))[0]
        assert (rows[i].host, rows[i].path) == (host, path)
        assert (rows[i].rule, rows[i].verdict) == plain_verdict(host, path), url
    assert urlfilter.filter_urls(df.limit(0), ALLOW, BLOCK).count() == 0


def test_equal_rules_and_bad_rules():
    trie = urlfilter.build_trie(["a.b/c"], ["a.b/c"])
    assert trie.match("x.a.b", "/cd") == ("a.b/c", True)
    with pytest.raises(ValueError):
        urlfilter.build_trie(["nohost"], [])


def test_many_rules_on_one_host(spark):
    import time

    trie = urlfilter.build_trie((f"a.b/x{i}" for i in range(0, 50_000, 2)), (f"a.b/x{i}" for i in range(1, 50_000, 2)))
    assert trie.match("a.b", "/x49999/y") == ("a.b/x49999", True) and trie.match("c.a.b", "/x7") == ("a.b/x7", True) and trie.match("a.b", "/y") is None
    began = time.perf_counter()
    for i in range(2000):
        trie.match("a.b", f"/x{i}zz")
    assert (time.perf_counter() - began) / 2000 < 2e-4
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "`my-id` long, `my-url` string")
    got = sorted(urlfilter.filter_urls(df, ALLOW, BLOCK, id="my-id", url="my-url").collect())
    assert [(r.host, r.verdict) for r in got] == [("a.org", "allow"), ("", "block")]


# ------------------------------------------------------------------ media


def plain_fingerprint(samples):
    """Frames, transforms by definition, peaks and pairs, one by one."""
    n = max(1, 1 + -(-max(0, len(samples) - media.FRAME) // media.HOP))
    angle = -2j * np.pi / media.FRAME * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME))
    table = np.exp(angle)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    peaks = []
    for f in range(n):
        frame = [float(x) - 128 for x in samples[f * media.HOP : f * media.HOP + media.FRAME]]
        frame += [0.0] * (media.FRAME - len(frame))
        m = np.round(np.abs(table @ (np.array(frame) * window)).astype(np.float32), 2)
        local = [(-m[k], k) for k in range(1, len(m) - 1) if m[k] >= m[k - 1] and m[k] > m[k + 1]]
        peaks.append([k for _, k in sorted(local)[: media.PEAKS]])
    if n == 1:
        return [peaks[0][0] << 15] if peaks[0] else None
    codes = []
    for t in range(n):
        for d in range(1, media.FAN + 1):
            if t + d < n:
                codes += [t << 24 | p << 15 | peaks[t + d][0] << 6 | d for p in peaks[t]]
    return sorted(codes)


def test_fingerprint_by_definition():
    rng = random.Random(2)
    for size in (1, 3, 9):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(110 * size)).encode()
        samples = np.frombuffer(media.padded(text), np.uint8)
        got, want = media.fingerprint(samples).tolist(), plain_fingerprint(samples)
        assert len(got) == len(want) and len(set(got) & set(want)) >= 0.97 * len(set(want))  # single against double precision near ties


def test_registered_media_has_its_codes(spark, edge):
    full = {(r.doc_id, r.n_bytes): list(r.codes) for r in media.media_columns(edge).collect()}
    for r in media.media_digests(edge).collect():
        assert list(r.codes) == full[r.doc_id, r.n_bytes] and r.n_pairs == len(r.codes)
        assert r.feature == hashlib.sha256(np.array(r.codes, "<i8").tobytes()).hexdigest()


def test_media_round_trip_and_equality(spark, edge, nothing):
    rows = media.media_columns(edge).collect()
    texts = [r.text for r in edge.collect()]
    by_text = {}
    for r, t in zip(sorted(rows, key=lambda r: (r.n_bytes, str(r.doc_id))), sorted(((t or "").encode() for t in texts), key=len)):
        back = media.from_wav(bytes(r.wav))
        assert back[: r.n_bytes] == t or r.n_bytes == len(t)
        assert len(back) == r.payload_bytes and len(back) % 576 == 0 and len(back) > 0 and set(back[r.n_bytes :]) <= {255}
        assert by_text.setdefault(back, r.codes) == r.codes
        times = [c >> 24 for c in r.codes]
        assert times == sorted(times)
    digests = media.media_digests(edge.filter("doc_id = 3")).first()
    payload = b"one" + b"\xff" * 573
    assert digests.payload_sha256 == hashlib.sha256(payload).hexdigest() and digests.tail_crc32 == zlib.crc32(payload[-32:])
    assert media.media_digests(nothing).count() == 0


def test_spectra_do_not_depend_on_the_run_length(monkeypatch):
    samples = np.frombuffer(random.Random(1).randbytes(576 * 40), np.uint8)
    whole = media.fingerprint(samples)
    monkeypatch.setattr(media, "RUN", 7)
    assert (media.fingerprint(samples) == whole).all() and len(whole) > 100


# ------------------------------------------------------------------ licences


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(UP.decode(), LOW.decode())))
    hits = sorted((i, label) for p, label in license.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_licenses_against_word_lists(spark, edge, nothing):
    texts = random_texts(300, 3) + [t.text or "" for t in edge.collect()] + ["cc by cc by", "CC-BY/cc_by", "all rights reserved " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license.scan_licenses(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license.scan_licenses(edge).count() == 13 and license.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "order"),
    [
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]),
        ("(MIT OR GPL-2.0) AND X", ["MIT", "GPL-2.0", "or", "X", "and"]),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "or"]),
        ("MIT OR", None),
        ("(MIT", None),
        ("MIT)", None),
        ("MIT BSD", None),
        ("", None),
    ],
)
def test_expressions(text, order):
    assert license.postfix(text) == order


def test_expression_values():
    labels, freedom = license.evaluate("(GPL-3.0-or-later OR MIT) AND Apache-2.0")
    assert labels == {"gpl", "mit", "apache"} and freedom == license.FREEDOM["mit"]
    found = license.scan_text("// SPDX-License-Identifier: GPL-2.0-only WITH X OR MIT\nnext")
    assert found[7] == ["GPL-2.0-only WITH X OR MIT"] and found[5] == "gpl,mit" and found[6] == pytest.approx(0.1)


def test_families_and_tags_in_one_line():
    named = {"CC0-1.0": "cc0", "0BSD": "0bsd", "ISC": "isc", "EPL-2.0": "epl", "Unlicense": "unlicense", "Zlib": "zlib", "BSL-1.0": "bsl", "BUSL-1.1": "busl", "CC-BY-NC-SA-4.0": "cc-by-nc", "Thing-1": "other"}
    assert {k: license.label_of(k) for k in named} == named
    found = license.scan_text("SPDX-License-Identifier: ISC SPDX-License-Identifier: EPL-2.0 OR MIT\nx")
    assert found[5] == "epl,isc,mit" and found[7] == ["ISC", "EPL-2.0 OR MIT"]
    many = license.scan_text("SPDX-License-Identifier: MIT " * 20_000)  # linear in the number of tags
    assert many[5] == "mit" and len(many[7]) == 20_000 and set(many[7]) == {"MIT"}


# ------------------------------------------------------------------ personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def pii_texts():
    rng = random.Random(9)
    parts = ["a.b%c@x-y.com", "a@b", "@", "x@y.z.", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713000", "+1 (555) 123-4567", "+12", "++44 20 7946 0958", "é", "🙂", " ", "-", ".", "7", "12 34", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]


def test_base_spans_against_plain_patterns(spark, edge, nothing):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == want
    assert pii.find_pii(edge).count() == 13 and pii.find_pii(nothing).count() == 0


def test_checksums_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "my bank account GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "call +1 (555) 123-4567 or a@b.co now"), (4, None), (5, "test +1 (555) 123-4567")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert rows[1].spans.startswith("iban:16:") and rows[1].max_score == pytest.approx(1.0) and rows[2].spans == ""
    assert rows[3].max_score > rows[5].max_score
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[3] == "call [PHONE] or [EMAIL] now" and clean[4] is None and clean[1] == "my bank account [IBAN]." and clean[2].endswith("33")
    assert "Python" not in pii.find_pii(df)._jdf.queryExecution().toString()


def test_long_runs_take_linear_time(spark):
    df = spark.createDataFrame([(1, "a" * 300_000), (2, "1 " * 150_000), (3, "999." * 90_000), (4, "+1" + "-" * 200_000), (5, "A1" * 100_000)], "doc_id long, text string")
    assert pii.find_pii(df).filter("spans <> ''").count() == 0
    many = spark.createDataFrame([(1, "1." * 160_000)], "doc_id long, text string")
    assert pii.find_pii(many).first().n_ip == 40_000
    assert pii.redact(many).first().text == "[IP]." * 40_000
